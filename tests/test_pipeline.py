import json
import struct

import pytest

from tracewell.__main__ import main
from tracewell.config import Tracker
from tracewell.plans import pipeline


@pytest.fixture
def folder(tmp_path):
    """Two people who walk for five frames."""
    (tmp_path / "seqinfo.ini").write_text("[Sequence]\nname=CAM-09-A\nframeRate=30\nseqLength=6\nimWidth=1920\nimHeight=1080\n")
    det, gt = [], []
    for f in range(1, 6):
        for k, (x, y) in enumerate(((600 + 4 * f, 500), (300, 450 + 3 * f)), 1):
            det.append(f"{f},-1,{x},{y},50,120,0.9")
            gt.append(f"{f},{k},{x},{y},50,120,1,1,1.0")
    for d, rows in (("det", det), ("gt", gt)):
        (tmp_path / d).mkdir()
        (tmp_path / d / f"{d}.txt").write_text("\n".join(rows) + "\n")
    return tmp_path


def test_end_to_end(spark, folder):
    e = pipeline.of_sequence(spark, str(folder), pipeline.SCENES["09"], Tracker(min_hits=1))
    assert e.tracks.count() == e.footpoints.count() == 10
    assert all(r.passed for r in e.conservation().collect()) and all(r.passed for r in e.invariants().collect())
    assert e.visits.count() >= 2
    d, t = e.detection_metrics().first(), e.tracking_metrics().first()
    assert (d.tp, d.fp, d.fn, d.f1) == (10, 0, 0, 1) and (t.mota, t.id_switches, t.idf1) == (1, 0, 1)
    assert set(e.time()) >= {"tracks", "visits", "ground"}
    short = pipeline.of_sequence(spark, str(folder), pipeline.SCENES["09"], Tracker(min_hits=1), max_frames=2)
    assert short.tracks.count() == 4
    e.footpoints.unpersist()


def test_command_line(spark, folder, capsys):
    main(["inspect", str(folder)])
    main(["evaluate", str(folder), "--out", str(folder / "out"), "--min-hits", "1", "--pictures"])
    said = capsys.readouterr().out
    assert "total_detections: 10" in said
    report = json.loads((folder / "out/evaluation_CAM-09-A.json").read_text())
    assert report["detection"]["tp"] == 10 and report["trajectories"]["total_trajectories"] == 2
    assert (folder / "out/conservation_CAM-09-A.log").read_text().count("PASS") == 7
    text = (folder / "out/EVALUATION_REPORT_CAM_09.md").read_text()
    assert [line for line in text.split("\n") if line.startswith("### ")] == [f"### {k}. {s}" for k, s in enumerate(("Detection", "Tracking", "Trajectories", "Image space", "Ground space", "Both spaces compared", "Conservation", "Run"), 1)]
    assert text.count("| passed |") == 7 and "frames/s" in text and "## Limits" in text
    for kind, size in (("dual", (1920 + 2700, 1080)), ("heatmap", (1920, 1080))):
        data = (folder / f"out/{kind}_CAM-09-A.png").read_bytes()
        assert data[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", data[16:24]) == size
    assert "sample annotation: {'seq_id': 'CAM-09-A', 'frame': 1, 'track_id': 1" in said and "sample detection" in said


def test_more_commands(spark, folder, capsys):
    main(["detect", str(folder), "--max-frames", "3"])
    main(["track", str(folder), "--min-hits", "1"])
    main(["run", str(folder), "--min-hits", "1"])
    said = capsys.readouterr().out
    assert "detections: 6" in said and "tp: 6" in said and "identities: 2" in said and "idf1: 1.0000" in said
    assert said.count("PASSED INV-") == 7 and "all invariants hold" in said and "frames_per_second" in said
    main(["evaluate", str(folder), str(folder), "--out", str(folder / "two"), "--min-hits", "1"])
    assert (folder / "two/EVALUATION_REPORT.md").read_text().count("## CAM-09-A") == 2
