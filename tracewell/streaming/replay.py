"""Structured Streaming forms of the accumulators, of dwell and of the tracker."""

from __future__ import annotations

import json
import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracewell.config import Dwell, ImageGrid, Tracker, Zones
from tracewell.operators import heatmaps
from tracewell.operators.tracking import TRACKS, TwoStage, run_frames
from tracewell.operators.zones import zone_ids
from tracewell.sources.files import shared_folder


def read_files(spark: SparkSession, folder: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder that match a name, as a stream."""
    schema = spark.read.option("pathGlobFilter", name).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name).option("recursiveFileLookup", "true")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def run_to_end(stream: DataFrame, mode: str) -> DataFrame:
    """Process all that the source has now; the rows that came out, from files in the shared folder.

    Each batch writes its own folder, again if it runs again. In complete mode
    the last batch's rows are the result.
    """
    spark, path = stream.sparkSession, shared_folder(stream.sparkSession)
    done: list[int] = []

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")
        done.append(batch)

    q = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    if not done:
        return spark.createDataFrame([], stream.schema)
    kept = sorted(set(done))[-1:] if mode == "complete" else sorted(set(done))
    return spark.read.schema(stream.schema).parquet(*[f"{path}/rows/batch={k}" for k in kept])


def heatmap(points: DataFrame, grid: ImageGrid) -> DataFrame:
    """The image grid as a running sum; run it in complete mode."""
    return heatmaps.accumulate(heatmaps.image_cells(points, grid))


VISITS = "seq_id string, track_id int, zone_id string, entry_frame int, last_observed_frame int, observation_count long, closed boolean"


def dwell_step(max_gap_frames: int) -> Callable:
    """The stateful step of one track: rows in order in, visits that changed out.

    A visit is told again whenever it grows, and as closed once an observation
    outside, or too late, ends it. Rows at or before the last frame seen are
    late and count for nothing.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, opened = (state.get[0], json.loads(state.get[1])) if state.exists else (0, {})
        rows = pd.concat(list(batches), ignore_index=True).sort_values(["frame_index", "order"], kind="stable")
        told: dict[tuple[str, int], tuple] = {}
        for frame, ids in zip(rows["frame_index"].tolist(), rows["zone_ids"].tolist(), strict=True):
            if frame <= last:
                continue
            near = frame - last - 1 <= max_gap_frames
            for zone in list(opened):
                entry, end, n = opened[zone]
                if zone not in ids or not near:
                    told[zone, entry] = (*key, zone, entry, end, n, True)
                    del opened[zone]
            for zone in ids:
                entry, _, n = opened.get(zone, (frame, frame, 0))
                opened[zone] = (entry, frame, n + 1)
                told[zone, entry] = (*key, zone, entry, frame, n + 1, False)
            last = frame
        state.update((last, json.dumps(opened)))
        yield pd.DataFrame(list(told.values()), columns=[c.split()[0] for c in VISITS.split(", ")])

    return step


def dwell(points: DataFrame, zones: Zones, how: Dwell) -> DataFrame:
    """Changing visits of a stream of (seq_id, track_id, frame_index, x, y, order); run it in update mode."""
    rows = points.select("seq_id", "track_id", "frame_index", "order", zone_ids(F.col("x"), F.col("y"), zones).alias("zone_ids"))
    return rows.groupBy("seq_id", "track_id").applyInPandasWithState(dwell_step(how.max_gap_frames), VISITS, "last int, opened string", "update", GroupStateTimeout.NoTimeout)


def latest_visits(changes: DataFrame) -> DataFrame:
    """The last word on each visit: as if the stream had ended here."""
    keys = ["seq_id", "track_id", "zone_id", "entry_frame"]
    return changes.groupBy(*keys).agg(F.max("last_observed_frame").alias("last_observed_frame"), F.max("observation_count").alias("observation_count"), F.max("closed").alias("closed"))


def track(rows: DataFrame, how: Tracker = Tracker()) -> DataFrame:
    """Confirmed track rows of a stream of detections; a row with a null det_idx lists a frame that was seen.

    Frames of a sequence arrive in order; those at or before the last one are late.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tracker, last = pickle.loads(state.get[0]) if state.exists else (TwoStage(how), 0)  # noqa: S301  our own state
        pdf = pd.concat(list(batches), ignore_index=True)
        pdf = pdf[pdf["frame_index"] > last]
        frames = sorted(pdf["frame_index"].unique().tolist())
        made = list(run_frames(tracker, key[0], pdf[pdf["det_idx"].notna()], frames))
        state.update((pickle.dumps((tracker, frames[-1] if frames else last)),))
        yield pd.DataFrame(made, columns=[c.split()[0] for c in TRACKS.split(", ")])

    return rows.groupBy("seq_id").applyInPandasWithState(step, TRACKS, "tracker binary", "append", GroupStateTimeout.NoTimeout)
