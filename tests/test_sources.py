import pytest
from pyspark.sql import functions as F

from tracewell.sources import detectors, sequences

# frame, id, box, conf, class, visibility: two active pedestrians, one that is not active, a car and a distractor
GT = """
3,11,640,355.5,44,131,1,1,1
3,12,71.25,402,38,96,1,1,0.64

4,11,646,356,44,131,1,1,0.97
4,13,1010,12,25,61,0,1,0.8
7,40,333,500,210,144,1,3,0.41
7,41,-6,610,70,70,0,8,0.05
9,12,80,404,38,96,1,1,0.2
"""
DET = "3,-1,641.2,350,45,130,0.88\n4,-1,12,16,19,33,0.41\n\n4,-1,648.75,352,43,133,0.9\n8,-1,5,5,5,5,0.1\n"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "seqinfo.ini").write_text("[Sequence]\nname=YARD-3\nframeRate=12.5\nseqLength=9\nimWidth=1600\nimHeight=900\n")
    for d, text in (("gt", GT), ("det", DET)):
        (tmp_path / d).mkdir()
        (tmp_path / d / f"{d}.txt").write_text(text)
    (tmp_path / "img1").mkdir()
    for k in (3, 4, 7):
        (tmp_path / f"img1/{k:06d}.jpg").write_bytes(b"x")
    return tmp_path


def test_scans(spark, folder):
    s = sequences.Sequence(spark, str(folder))
    assert (s.info.im_dir, s.info.im_ext, s.info.resolution) == ("img1", ".jpg", (1600, 900)) and s.metadata().first().frame_rate == 12.5
    assert [s.ground_truth(*f).count() for f in ((), (True,), (False, True), (True, True), (False, False, 0.64))] == [7, 5, 5, 4, 4]
    assert sorted((r.frame, r.bb_left, r.conf) for r in s.detections(0.41).collect()) == [(3, 641.2, 0.88), (4, 12.0, 0.41), (4, 648.75, 0.9)]
    counts = {"total_annotations": 7, "active_pedestrians": 4, "pedestrian_tracks": 2, "total_detections": 4, "images_on_disk": 3}
    there = {"has_images": True, "has_ground_truth": True, "has_detections": True}
    assert s.summary() == {"name": "YARD-3", "frame_rate": 12.5, "seq_length": 9, "resolution": (1600, 900), "im_ext": ".jpg"} | there | counts
    assert s.has_images and s.frame_exists(4) and not s.frame_exists(5)
    assert sorted(r.frame_index for r in s.frames().collect()) == [3, 4, 7] and [r.frame_index for r in s.frames(1, 6, 3).collect()] == [4]
    with pytest.raises(ValueError):
        s.get_frame_path(0)


def test_a_written_sequence_reads_back(spark, folder, tmp_path):
    s = sequences.Sequence(spark, f"file://{folder}")
    copy = sequences.write(spark, f"{tmp_path}/copy", s.info, s.ground_truth())
    assert copy.info == s.info and not copy.has_detections and not copy.has_images and copy.frames().count() == 0
    assert sorted(map(tuple, copy.ground_truth().collect())) == sorted(map(tuple, s.ground_truth().collect()))
    assert "images_on_disk" not in copy.summary() and copy.summary()["pedestrian_tracks"] == 2


def test_bad_files(spark, folder):
    with pytest.raises(FileNotFoundError):
        sequences.Sequence(spark, str(folder / "none"))
    (folder / "gt/gt.txt").write_text("3,11,640,355.5,44\n")
    (folder / "det/det.txt").write_text("8,-1,5\n")
    s = sequences.Sequence(spark, str(folder))
    for rows in (s.ground_truth(), s.detections()):
        with pytest.raises(Exception, match="fewer than"):
            rows.collect()
    (folder / "seqinfo.ini").write_text("[Other]\nname=x\n")
    with pytest.raises(ValueError):
        _ = sequences.Sequence(spark, str(folder)).info


def test_ranges_and_names(spark):
    assert [r.frame_index for r in sequences.frame_range(spark, 10, 2, 99, 3).collect()] == [2, 5, 8]
    for bad in ((10, 0), (10, 11), (10, 5, 4)):
        with pytest.raises(ValueError):
            sequences.frame_range(spark, *bad)
    ids = spark.createDataFrame([(1,), (2,), (10,), (13,)], "c int")
    assert [r[0] for r in ids.select(sequences.class_name(F.col("c"))).collect()] == ["Pedestrian", "Person On Vehicle", "Occluder On The Ground", "Unknown (13)"]
    f = spark.createDataFrame([("s", 1), ("s", 1234567)], "seq_id string, frame_index int")
    assert [r[0] for r in f.select(sequences.frame_path(F.lit("d"), F.col("frame_index"), F.lit(".png"))).collect()] == ["d/000001.png", "d/1234567.png"]
    assert sequences.limit_frames(f, 1, 10).count() == 1 and sequences.limit_frames(f, None, 10).count() == 2


def test_detector_plug_in(spark):
    frames = spark.createDataFrame([("s", k) for k in range(1, 6)], "seq_id string, frame_index int")
    rows = detectors.detect(frames, lambda: lambda f, _: [(0.0, 0.0, 10.0 * f, 5.0, 0.9), (0.0, 0.0, 1.0, 1.0, 0.1)] if f != 3 else []).orderBy("frame_index").collect()
    assert [(r.frame_index, r.bb_width, r.class_name) for r in rows] == [(k, 10.0 * k, "person") for k in (1, 2, 4, 5)]
