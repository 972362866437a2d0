"""Matching of boxes frame by frame: candidate pairs, greedy matchers, optimal assignment, and their metrics."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import overlaps
from tracewell.functions.assignment import assign
from tracewell.functions.geometry import iou
from tracewell.operators.tracks import corners

#: side of the squares in which boxes are looked up, in pixels
SQUARE = 256.0


def active_pedestrians(gt: DataFrame) -> DataFrame:
    return gt.filter("class_id = 1 AND conf = 1.0")


def box_pairs(left: DataFrame, right: DataFrame, left_key: Sequence[str], right_key: Sequence[str], square: float = SQUARE) -> DataFrame:
    """Overlapping boxes of one frame, with their IoU; columns left_key and right_key are carried along.

    Both sides have seq_id, frame_index and a box. Each box is listed in the
    squares that it touches; a pair meets in all squares that both touch and
    counts in the one that holds the overlap's upper left corner. So a crowded
    frame costs its overlaps, not its pairs.
    """

    def spread(df: DataFrame, side: str, keys: Sequence[str]) -> DataFrame:
        c = corners(df).filter("bb_width > 0 AND bb_height > 0")
        axis = lambda lo, hi: F.sequence(F.floor(F.col(lo) / square), F.floor(F.col(hi) / square))
        c = c.withColumn("sx", F.explode(axis("x1", "x2"))).withColumn("sy", F.explode(axis("y1", "y2")))
        return c.select("seq_id", "frame_index", "sx", "sy", *keys, *[F.col(k).alias(f"{side}_{k}") for k in ("x1", "y1", "x2", "y2")])

    a, b = spread(left, "l", left_key), spread(right, "r", right_key)
    j = a.join(b, ["seq_id", "frame_index", "sx", "sy"])
    j = j.filter((F.col("l_x1") < F.col("r_x2")) & (F.col("r_x1") < F.col("l_x2")) & (F.col("l_y1") < F.col("r_y2")) & (F.col("r_y1") < F.col("l_y2")))
    j = j.filter((F.floor(F.greatest("l_x1", "r_x1") / square) == F.col("sx")) & (F.floor(F.greatest("l_y1", "r_y1") / square) == F.col("sy")))
    boxes = [[F.col(f"{s}_{k}") for k in ("x1", "y1", "x2", "y2")] for s in "lr"]
    return j.select("seq_id", "frame_index", *left_key, *right_key, iou(*boxes).alias("iou"))


def greedy(pairs: DataFrame, threshold: float = 0.5, in_detection_order: bool = False) -> DataFrame:
    """One-to-one matches (det_idx, gt_idx) of each frame, one of its ranked candidates after the other.

    By IoU, ties by det_idx, then gt_idx; or detection by detection, each
    taking its best free annotation. Only a frame's own candidates meet.
    """
    keys = ["seq_id", "frame_index", "det_idx", "gt_idx"]

    def choose(t: pa.Table) -> pa.Table:
        det, gt, iou = (t.column(c).to_numpy() for c in ("det_idx", "gt_idx", "iou"))
        order = overlaps.greedy_order(det, gt, iou, in_detection_order)
        return t.select(keys).take(order[overlaps.taken(det[order], gt[order])])

    near = pairs.filter(F.col("iou") >= threshold).select(*keys, "iou")
    return near.groupBy("seq_id", "frame_index").applyInArrow(choose, near.select(*keys).schema)


def _by_frame(left: DataFrame, right: DataFrame, left_key: str, right_key: str, choose: Callable, score: bool = False, count: bool = False) -> DataFrame:
    """One-to-one pairs that ``choose`` finds among the boxes of each frame, with their IoU where ``score``; or a row a frame, of their ``count`` and the boxes left over.

    Boxes meet in one task a frame, and their pairs never leave it: what is
    shuffled are boxes, where pairs grow with the square of a crowd.
    """
    box = ["bb_left", "bb_top", "bb_width", "bb_height"]
    of = lambda df, key: df.select("seq_id", "frame_index", key, *[F.col(c).cast("double") for c in box]).groupBy("seq_id", "frame_index")
    kinds = [dict(df.dtypes)[key] for df, key in ((left, left_key), (right, right_key))]
    seq, frame = (dict(left.dtypes)[c] for c in ("seq_id", "frame_index"))

    def corner(t: pa.Table) -> np.ndarray:
        x, y, w, h = (t.column(c).to_numpy() for c in box)
        return np.column_stack([x, y, x + w, y + h])

    def solve(a: pa.Table, b: pa.Table) -> pa.Table:
        ids = a.column(left_key), b.column(right_key)
        i, j, *iou = choose(corner(a), corner(b), *(x.to_numpy() for x in ids))
        if count:
            some = (a if a.num_rows else b).slice(0, 1)
            n = {"tp": len(i), "fp": a.num_rows - len(i), "fn": b.num_rows - len(i)}
            return pa.table({c: some.column(c) for c in ("seq_id", "frame_index")} | {k: pa.array([v], pa.int64()) for k, v in n.items()})
        cols = {"seq_id": a.column("seq_id").take(i), "frame_index": a.column("frame_index").take(i), left_key: ids[0].take(i), right_key: ids[1].take(j)}
        return pa.table(cols | ({"iou": iou[0]} if score else {}))

    pairs = f"{left_key} {kinds[0]}, {right_key} {kinds[1]}" + ", iou double" * score
    schema = f"seq_id {seq}, frame_index {frame}, " + ("tp long, fp long, fn long" if count else pairs)
    return of(left, left_key).cogroup(of(right, right_key)).applyInArrow(solve, schema)


def greedy_boxes(dets: DataFrame, gt: DataFrame, threshold: float = 0.5, in_detection_order: bool = False) -> DataFrame:
    """What ``greedy`` makes of the pairs of these boxes, without a table of pairs."""
    choose = lambda a, b, d, g: overlaps.greedy_pairs(a, b, d, g, threshold, in_detection_order)
    return _by_frame(dets, gt, "det_idx", "gt_idx", choose)


def greedy_frames(dets: DataFrame, gt: DataFrame, threshold: float = 0.5, in_detection_order: bool = False) -> DataFrame:
    """What ``per_frame`` makes of ``greedy_boxes``, counted where a frame's boxes meet: both sides are read once."""
    choose = lambda a, b, d, g: overlaps.greedy_pairs(a, b, d, g, threshold, in_detection_order)
    return _by_frame(dets, gt, "det_idx", "gt_idx", choose, count=True)


def per_frame(dets: DataFrame, gt: DataFrame, matches: DataFrame) -> DataFrame:
    """tp, fp, fn of every frame that has a detection or an annotation."""
    count = lambda df, name: df.groupBy("seq_id", "frame_index").agg(F.count("*").alias(name))
    keys = ["seq_id", "frame_index"]
    f = count(dets, "n_det").join(count(gt, "n_gt"), keys, "full").join(count(matches, "tp"), keys, "left").fillna(0)
    return f.select(*keys, "tp", (F.col("n_det") - F.col("tp")).alias("fp"), (F.col("n_gt") - F.col("tp")).alias("fn"))


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def detection_metrics(frames: DataFrame) -> DataFrame:
    """One row: sums of tp, fp, fn, and precision, recall, F1, where an empty denominator gives 0."""
    s = frames.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return s.select("tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def frame_scores(frames: DataFrame) -> DataFrame:
    """Precision, recall and F1 of each frame; all 1 where both sides are empty."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    none = tp + fp + fn == 0
    one = lambda c: F.when(none, 1.0).otherwise(c)
    return frames.withColumns({"precision": one(ratio(tp, tp + fp)), "recall": one(ratio(tp, tp + fn)), "f1": one(ratio(2 * tp, 2 * tp + fp + fn))})


def best_gt(pairs: DataFrame) -> DataFrame:
    """The best annotation of each detection, the first of equal ones, whether taken or not."""
    best = pairs.groupBy("seq_id", "frame_index", "det_idx").agg(F.min(F.struct((-F.col("iou")).alias("k"), "gt_idx")).alias("b"))
    return best.select("seq_id", "frame_index", "det_idx", F.col("b.gt_idx").alias("gt_idx"), (-F.col("b.k")).alias("iou"))


def optimal(pairs: DataFrame, left: str, right: str, threshold: float = 0.5) -> DataFrame:
    """Matches of each frame that maximise the total 32-bit IoU; those under the threshold go afterwards.

    A frame's overlapping pairs are few and bounded by what one image holds,
    so each frame is one group; its connected components are solved apart.
    """

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        score = pdf["iou"].to_numpy(np.float32)
        take = assign(pdf[left].to_numpy(), pdf[right].to_numpy(), score)
        out = pdf.loc[take & (score >= np.float32(threshold)), ["seq_id", "frame_index", left, right, "iou"]]
        return out.sort_values([left, right])

    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}
    schema = f"seq_id string, frame_index int, {left} {kinds[left]}, {right} {kinds[right]}, iou double"
    return pairs.select("seq_id", "frame_index", left, right, "iou").groupBy("seq_id", "frame_index").applyInPandas(solve, schema)


def optimal_boxes(left_boxes: DataFrame, right_boxes: DataFrame, left: str, right: str, threshold: float = 0.5) -> DataFrame:
    """What ``optimal`` makes of the pairs of these boxes, without a table of pairs; of equal totals, one where ids agree is taken first."""

    def choose(a: np.ndarray, b: np.ndarray, l: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:  # noqa: E741
        i, j, iou = overlaps.best_pairs(a, b, l, r)
        keep = iou.astype(np.float32) >= np.float32(threshold)
        return i[keep], j[keep], iou[keep]

    return _by_frame(left_boxes, right_boxes, left, right, choose, score=True)


def id_switches(matches: DataFrame) -> DataFrame:
    """Matches whose annotation was matched to another track the last time it was matched."""
    w = Window.partitionBy("seq_id", "gt_id").orderBy("frame_index")
    return matches.withColumn("previous_track", F.lag("track_id").over(w)).filter("previous_track <> track_id")


def overlap_counts(pairs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Frames that each (track, annotation) share at the threshold or above."""
    return pairs.filter(F.col("iou") >= threshold).groupBy("seq_id", "track_id", "gt_id").agg(F.count("*").alias("n_frames"))


def identity_score(counts: DataFrame, n_tracks: DataFrame, n_gt: DataFrame) -> DataFrame:
    """IDF1 of each sequence: the assignment of tracks to annotations that shares most frames.

    Groups are sequences; their (track, annotation) counts are bounded by the
    identities of one video.
    """

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        take = assign(pdf["track_id"].to_numpy(), pdf["gt_id"].to_numpy(), pdf["n_frames"].to_numpy(np.float64))
        return pd.DataFrame({"seq_id": pdf["seq_id"].iloc[:1], "idtp": [int(pdf["n_frames"][take].sum())]})

    hits = counts.groupBy("seq_id").applyInPandas(solve, "seq_id string, idtp long")
    t = n_tracks.groupBy("seq_id").agg(F.count("*").alias("n_track_rows"))
    g = n_gt.groupBy("seq_id").agg(F.count("*").alias("n_gt_rows"))
    s = t.join(g, "seq_id", "full").join(hits, "seq_id", "left").fillna(0)
    idtp = F.col("idtp")
    return s.select("seq_id", "idtp", (F.col("n_track_rows") - idtp).alias("idfp"), (F.col("n_gt_rows") - idtp).alias("idfn"), ratio(2 * idtp, F.col("n_track_rows") + F.col("n_gt_rows")).alias("idf1"))


def clear_mot(tracks: DataFrame, gt: DataFrame, matches: DataFrame) -> DataFrame:
    """CLEAR-MOT of each sequence: tp, fp, fn, id switches, MOTA, precision, recall.

    Both sides empty: all 1. No annotation: false positives alone, scores 0.
    No track: misses alone, scores 0.
    """
    f = per_frame(tracks, gt, matches).groupBy("seq_id").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    s = id_switches(matches).groupBy("seq_id").agg(F.count("*").alias("id_switches"))
    m = f.join(s, "seq_id", "left").fillna(0)
    tp, fp, fn, sw = F.col("tp"), F.col("fp"), F.col("fn"), F.col("id_switches")
    n = tp + fn
    some = (n > 0) & (tp + fp > 0)
    return m.select("seq_id", n.alias("total_gt"), "tp", "fp", "fn", "id_switches", F.when(some, 1 - (fn + fp + sw) / n).otherwise(0.0).alias("mota"), F.when(some, ratio(tp, tp + fp)).otherwise(0.0).alias("precision"), F.when(some, ratio(tp, n)).otherwise(0.0).alias("recall"))
