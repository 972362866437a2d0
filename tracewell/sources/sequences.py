"""Sequence directories: seqinfo.ini, gt/gt.txt, det/det.txt and numbered images, read with Spark."""

from __future__ import annotations

import configparser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.sources import files

# Class ids of annotations, in order from 1.
CLASSES = (
    "PEDESTRIAN", "PERSON_ON_VEHICLE", "CAR", "BICYCLE", "MOTORBIKE", "NON_MOTORIZED_VEHICLE",
    "STATIC_PERSON", "DISTRACTOR", "OCCLUDER", "OCCLUDER_ON_THE_GROUND", "OCCLUDER_FULL", "REFLECTION",
)

GT = "frame int, track_id int, bb_left double, bb_top double, bb_width double, bb_height double, conf double, class_id double, visibility double"
DET = "frame int, track_id int, bb_left double, bb_top double, bb_width double, bb_height double, conf double"


def class_name(class_id: Column) -> Column:
    """Title-case name of a class id; 'Unknown (id)' for others."""
    names = F.create_map(*[x for i, n in enumerate(CLASSES, 1) for x in (F.lit(i), F.initcap(F.lit(n.replace("_", " ").lower())))])
    return F.coalesce(names[class_id], F.concat(F.lit("Unknown ("), class_id.cast("string"), F.lit(")")))


def frame_path(folder: Column, frame: Column, ext: Column) -> Column:
    """Path of a frame's image; frames count from 1."""
    bad = F.raise_error(F.lit("frames count from 1"))
    return F.when(frame < 1, bad).otherwise(F.concat(folder, F.lit("/"), F.format_string("%06d", frame), ext))


@dataclass(frozen=True)
class Info:
    name: str
    im_dir: str
    frame_rate: float
    seq_length: int
    im_width: int
    im_height: int
    im_ext: str

    @property
    def resolution(self) -> tuple[int, int]:
        return self.im_width, self.im_height


class Sequence:
    """One directory, in any store that Spark reads. Tables carry its name as seq_id.

    Tables of rows may be single files or folders of part files.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, str(folder).rstrip("/")
        if not files.is_folder(spark, self.folder):
            raise FileNotFoundError(folder)
        self._info: Info | None = None

    @property
    def info(self) -> Info:
        if self._info is None:
            path = f"{self.folder}/seqinfo.ini"
            if not files.exists(self.spark, path):
                raise FileNotFoundError(path)
            ini = configparser.ConfigParser()
            ini.read_string(files.read_small(self.spark, path))
            if "Sequence" not in ini:
                raise ValueError("seqinfo.ini has no section [Sequence]")
            s = ini["Sequence"]
            try:
                self._info = Info(s["name"], s.get("imDir", "img1"), float(s["frameRate"]), int(s["seqLength"]), int(s["imWidth"]), int(s["imHeight"]), s.get("imExt", ".jpg"))
            except KeyError as e:
                raise ValueError(f"seqinfo.ini lacks {e}") from e
        return self._info

    def metadata(self) -> DataFrame:
        i = self.info
        return self.spark.createDataFrame([(i.name, i.im_dir, i.frame_rate, i.seq_length, i.im_width, i.im_height, i.im_ext)], "name string, im_dir string, frame_rate double, seq_length int, im_width int, im_height int, im_ext string")

    @property
    def has_ground_truth(self) -> bool:
        return files.exists(self.spark, f"{self.folder}/gt/gt.txt")

    @property
    def has_detections(self) -> bool:
        return files.exists(self.spark, f"{self.folder}/det/det.txt")

    def images(self) -> DataFrame:
        """(path, name) of the images that exist."""
        return files.listed(self.spark, f"{self.folder}/{self.info.im_dir}", f"*{self.info.im_ext}")

    @property
    def has_images(self) -> bool:
        return bool(self.images().take(1))

    def get_frame_path(self, frame: int) -> str:
        if frame < 1:
            raise ValueError("frames count from 1")
        return f"{self.folder}/{self.info.im_dir}/{frame:06d}{self.info.im_ext}"

    def frame_exists(self, frame: int) -> bool:
        return files.exists(self.spark, self.get_frame_path(frame))

    def _scan(self, path: str, schema: str, width: int) -> DataFrame:
        """Rows of a comma-separated file; a row with fewer than ``width`` fields or a bad number raises."""
        if not files.exists(self.spark, f"{self.folder}/{path}"):
            raise FileNotFoundError(f"{self.folder}/{path}")
        lines = self.spark.read.text(f"{self.folder}/{path}").filter(F.trim("value") != "")
        parts = F.split("value", ",")
        short = F.raise_error(F.concat(F.lit(f"fewer than {width} fields: "), F.col("value"))).cast("array<string>")
        lines = lines.select(F.when(F.size(parts) >= width, parts).otherwise(short).alias("p"))
        fields = [f.strip().split() for f in schema.split(",")]
        return lines.select(F.lit(self.info.name).alias("seq_id"), *[F.trim(F.col("p")[i]).cast(kind).alias(name) for i, (name, kind) in enumerate(fields)])

    def ground_truth(self, pedestrians_only: bool = False, active_only: bool = False, min_visibility: float = 0.0) -> DataFrame:
        gt = self._scan("gt/gt.txt", GT, 9).withColumn("class_id", F.col("class_id").cast("int"))
        return filter_ground_truth(gt, pedestrians_only, active_only, min_visibility)

    def detections(self, min_conf: float = 0.0) -> DataFrame:
        return self._scan("det/det.txt", DET, 7).filter(F.col("conf") >= min_conf)

    def frames(self, start: int = 1, end: int | None = None, stride: int = 1) -> DataFrame:
        """(seq_id, frame_index, path) of the images that exist in a range."""
        wanted = frame_range(self.spark, self.info.seq_length, start, end, stride)
        path = frame_path(F.lit(f"{self.folder}/{self.info.im_dir}"), F.col("frame_index"), F.lit(self.info.im_ext))
        named = wanted.withColumn("path", path).withColumn("name", F.element_at(F.split("path", "/"), -1))
        return named.join(self.images().select("name"), "name", "left_semi").select(F.lit(self.info.name).alias("seq_id"), "frame_index", "path")

    def summary(self) -> dict:
        """Totals; those of a missing file are left out."""
        i = self.info
        out: dict = {"name": i.name, "frame_rate": i.frame_rate, "seq_length": i.seq_length, "resolution": i.resolution, "im_ext": i.im_ext}
        out |= {"has_images": self.has_images, "has_ground_truth": self.has_ground_truth, "has_detections": self.has_detections}
        if out["has_images"]:
            out["images_on_disk"] = self.images().count()
        if out["has_ground_truth"]:
            out |= summary_of(self.ground_truth()).first().asDict()
        if out["has_detections"]:
            out["total_detections"] = self.detections().count()
        return out


def write(spark: SparkSession, folder: str, info: Info, gt: DataFrame | None = None, det: DataFrame | None = None) -> Sequence:
    """Write a sequence directory that Sequence reads: seqinfo.ini and, where given, the rows of GT and DET."""
    keys = {"name": info.name, "imDir": info.im_dir, "frameRate": info.frame_rate, "seqLength": info.seq_length, "imWidth": info.im_width, "imHeight": info.im_height, "imExt": info.im_ext}
    ini = spark.createDataFrame([("\n".join(["[Sequence]", *(f"{k}={v}" for k, v in keys.items())]),)], "value string")
    ini.coalesce(1).write.text(f"{folder}/seqinfo.ini")
    for name, schema, rows in (("gt", GT, gt), ("det", DET, det)):
        if rows is not None:
            columns = [F.col(f.split()[0]).cast(f.split()[1]).cast("string") for f in schema.split(", ")]
            rows.select(F.concat_ws(",", *columns).alias("value")).write.text(f"{folder}/{name}/{name}.txt")
    return Sequence(spark, folder)


def filter_ground_truth(gt: DataFrame, pedestrians_only: bool = False, active_only: bool = False, min_visibility: float = 0.0) -> DataFrame:
    if pedestrians_only:
        gt = gt.filter("class_id = 1")
    if active_only:
        gt = gt.filter("conf = 1.0")
    return gt.filter(F.col("visibility") >= min_visibility)


def summary_of(gt: DataFrame) -> DataFrame:
    active = (F.col("class_id") == 1) & (F.col("conf") == 1.0)
    return gt.agg(F.count("*").alias("total_annotations"), F.count_if(active).alias("active_pedestrians"), F.count_distinct(F.when(active, F.struct("seq_id", "track_id"))).alias("pedestrian_tracks"))


def frame_range(spark: SparkSession, seq_length: int, start: int = 1, end: int | None = None, stride: int = 1) -> DataFrame:
    """Frames from start to end, both included; the end is clamped to the sequence's."""
    if start < 1 or stride < 1:
        raise ValueError("a range starts at 1 and goes forward")
    last = min(end, seq_length) if end is not None else seq_length
    if start > last:
        raise ValueError("the range is empty")
    return spark.range(start, last + 1, stride).select(F.col("id").cast("int").alias("frame_index"))


def limit_frames(df: DataFrame, max_frames: int | None, seq_length: int) -> DataFrame:
    """Rows of the first frames: a limit on frames, not rows; none for None or under 1."""
    if max_frames is None or max_frames <= 0:
        return df
    return df.filter(F.col("frame_index") <= min(max_frames, seq_length))
