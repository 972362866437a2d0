"""Detectors as plug-ins: a callable over batches of images, one per worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

DETECTIONS = "seq_id string, frame_index int, det_idx int, bb_left double, bb_top double, bb_width double, bb_height double, confidence double, class_name string"

#: takes a frame's index and its image bytes, or None where only a path is known; gives x1, y1, x2, y2, confidence
Detector = Callable[[int, bytes | None], list[tuple[float, float, float, float, float]]]


def detect(frames: DataFrame, make: Callable[[], Detector], confidence_threshold: float = 0.5) -> DataFrame:
    """Run a detector over (seq_id, frame_index[, content]). ``make`` loads the model once a task."""
    cols = [c for c in ("seq_id", "frame_index", "content") if c in frames.columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detector = make()
        names = [c.split()[0] for c in DETECTIONS.split(", ")]
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                found = [d for d in detector(int(r.frame_index), getattr(r, "content", None)) if d[4] >= confidence_threshold]
                rows += [(r.seq_id, int(r.frame_index), k, x1, y1, x2 - x1, y2 - y1, c, "person") for k, (x1, y1, x2, y2, c) in enumerate(found, 1)]
            yield pd.DataFrame(rows, columns=names)

    return frames.select(*cols).mapInPandas(run, DETECTIONS)
