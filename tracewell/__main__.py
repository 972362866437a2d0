"""Command line: inspect a sequence directory, match its detections, track them, run image space, or evaluate both spaces."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.config import Tracker


def _args(args: list[str] | None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="tracewell")
    sub = p.add_subparsers(dest="command", required=True)
    told = {
        "inspect": "totals and a sample row of each file",
        "detect": "the public detections against the annotations",
        "track": "identities and their scores",
        "run": "image space: heatmap, zones, dwell, invariants",
        "evaluate": "both spaces, with reports; several folders give one more report over all of them",
    }
    for name, text in told.items():
        q = sub.add_parser(name, help=text)
        q.add_argument("folders" if name == "evaluate" else "folder", nargs="+" if name == "evaluate" else None)
        if name == "inspect":
            continue
        q.add_argument("--max-frames", type=int, default=0, help="0 for all")
        q.add_argument("--min-conf", type=float, default=0.5 if name == "detect" else 0.0)
        q.add_argument("--iou", type=float, default=0.5)
        if name != "detect":
            q.add_argument("--high", type=float, default=0.5)
            q.add_argument("--min-hits", type=int, default=2)
        if name in ("run", "evaluate"):
            q.add_argument("--scene", default="09", choices=("09", "02"))
        if name == "evaluate":
            q.add_argument("--out", default="reports")
            q.add_argument("--pictures", action="store_true", help="also write PNG pictures")
    return p.parse_args(args)


def _show(title: str, row: DataFrame) -> None:
    """A heading and the numbers of a one-row table."""
    print(f"{title}:")
    for k, v in row.first().asDict().items():
        print(f"  {k}: {v:.4f}" if isinstance(v, float) else f"  {k}: {v}")


def inspect(spark: SparkSession, got: argparse.Namespace) -> None:
    from tracewell.sources.sequences import Sequence

    s = Sequence(spark, got.folder)
    for k, v in s.summary().items():
        print(f"{k}: {v}")
    samples = {}
    if s.has_ground_truth:
        samples["sample annotation"] = s.ground_truth(True, True).orderBy("frame", "track_id")
    if s.has_detections:
        samples["sample detection"] = s.detections().orderBy("frame", F.desc("conf"))
    for name, rows in samples.items():
        for r in rows.take(1):
            print(f"{name}: {r.asDict()}")


def run(spark: SparkSession, got: argparse.Namespace) -> None:
    """detect, track and run: what each finds, on the console."""
    from tracewell.operators import audit, heatmaps, tracks
    from tracewell.plans import pipeline

    e = _evaluation(spark, got.folder, got)
    if got.command == "detect":
        print(f"detections: {e.detections.count()}")
        if e.gt is not None:
            _show("detection", e.detection_metrics(got.iou))
        return
    if got.command == "run":
        seconds, frames = e.time(pipeline.IMAGE_STAGES), e.frames.count()
        for k, v in seconds.items():
            print(f"{k}: {1000 * v:.1f} ms ({1000 * v / max(frames, 1):.3f} ms a frame)")
        for k, v in e.profile().items():
            print(f"{k}: {v:.2f}")
        if e.gt is not None:
            _show("detection", e.detection_metrics(got.iou))
    _show("tracks", e.tracks.agg(F.count("*").alias("rows"), F.count_distinct("seq_id", "track_id").alias("identities")))
    if e.gt is not None:
        _show("tracking", e.tracking_metrics(got.iou))
    if got.command == "run":
        _show("trajectories", tracks.summary(e.footpoints, e.scene.dwell.fps))
        _show("heatmap", heatmaps.diagnostics(e.cells, e.scene.grid.shape))
        for name, part in e.parts().items():
            if name in ("image_zones", "image_dwell"):
                _show(name, part)
        checks = e.invariants().collect()  # seven rows
        for r in checks:
            print(f"{'PASSED' if r.passed else 'FAILED'} {r.name}: {r.violations} violations")
        print("all invariants hold" if all(r.passed for r in checks) else "some invariants fail")
        print(f"driver's peak memory: {audit.peak_rss_mb():.1f} MB")


def evaluate(spark: SparkSession, got: argparse.Namespace) -> None:
    from tracewell.operators import audit
    from tracewell.plans import pipeline

    told = []
    for folder in got.folders:
        e = _evaluation(spark, folder, got)
        e.time()
        name = e.frames.first().seq_id
        for kind, path in (e.save(got.out, name) | (pipeline.draw(e, got.out, name) if got.pictures else {})).items():
            print(f"{kind}: {path}")
        told.append((name, e))
    if len(told) > 1:
        path = audit.report_path(got.out, "all")
        with open(path, "w", encoding="utf-8") as f:
            f.write(audit.markdown("Evaluation", [e.lines(name) for name, e in told]))
        print(f"markdown: {path}")


def _evaluation(spark: SparkSession, folder: str, got: argparse.Namespace):
    from tracewell.plans import pipeline

    how = Tracker(high=got.high, min_hits=got.min_hits) if hasattr(got, "high") else Tracker()
    return pipeline.of_sequence(spark, folder, pipeline.SCENES[getattr(got, "scene", "09")], how, got.max_frames or None, got.min_conf)


def main(args: list[str] | None = None) -> None:
    got = _args(args)
    spark = SparkSession.builder.appName("tracewell").getOrCreate()
    {"inspect": inspect, "evaluate": evaluate}.get(got.command, run)(spark, got)


if __name__ == "__main__":
    main()
