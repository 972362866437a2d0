"""Conservation equations, invariants, comparison of the two spaces, and reports."""

from __future__ import annotations

import resource
import sys
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ("seq_id", "track_id")

# Names of the checks.
EQUATIONS = (
    "AC-03: Projection State Conservation", "AC-04: Image Heatmap Conservation", "AC-05: Ground Heatmap Conservation", "AC-06a: Image Zone Conservation",
    "AC-06b: Ground Zone Conservation", "AC-07a: Image Dwell Overlap Conservation", "AC-07b: Ground Dwell Overlap Conservation",
)
INVARIANTS = (
    "INV-1: Lost-Frame Track Isolation", "INV-2: Track-to-Footpoint Propagation & Conservation", "INV-3: Footpoint Identity & Frame Fidelity", "INV-4: Trajectory Chronological Integrity",
    "INV-5: Footpoint-to-Zone Eligibility & Propagation", "INV-6: Gap-Dwell Observation Fidelity", "INV-7: Heatmap Conservation",
)


def _one_row(*sums: DataFrame) -> DataFrame:
    """One-row tables side by side."""
    return reduce(lambda a, b: a.join(F.broadcast(b)), sums)


def _total(condition: Column) -> Column:
    return F.coalesce(F.sum(condition.cast("long")), F.lit(0))


def _listed(row: DataFrame, names: tuple[str, ...], fields: list[Column]) -> DataFrame:
    """A row for each name, with the fields of its struct."""
    pairs = [F.struct(F.lit(name).alias("name"), f.alias("f")) for name, f in zip(names, fields, strict=True)]
    return row.select(F.inline(F.array(*pairs))).select("name", "f.*")


def conservation(points: DataFrame, ground: DataFrame, image_cells: DataFrame, ground_cells: DataFrame, image_members: DataFrame, ground_members: DataFrame, image_visits: DataFrame, ground_visits: DataFrame) -> DataFrame:
    """Seven equations; each side is counted from a table of its own, so that a check can fail. Each table is summed once."""
    n = F.size("zone_ids")
    states = F.when(~F.col("is_valid"), 1).when(F.col("is_extrapolated"), 1).when(~F.col("is_extrapolated"), 1).otherwise(0)
    known = lambda *s: _total(F.col("status").isin(*s))
    sided = F.when(n > 0, 1).otherwise(0) + F.when(n == 0, 1).otherwise(0)
    row = _one_row(
        points.agg(F.count("*").alias("points")),
        ground.agg(F.count("*").alias("ground"), _total(states).alias("states")),
        image_cells.agg(known("accumulated", "out_of_bounds", "invalid").alias("cells")),
        ground_cells.agg(known("accumulated", "out_of_bounds", "invalid", "extrapolated_rejected").alias("ground_cells")),
        image_members.agg(_total(sided).alias("members"), _total(n).alias("zones")),
        ground_members.agg(_total(sided).alias("ground_members"), _total(n).alias("ground_zones")),
        image_visits.agg(_total(F.col("observation_count")).alias("visited")),
        ground_visits.agg(_total(F.col("observation_count")).alias("ground_visited")),
    )
    sides = [("points", "states"), ("points", "cells"), ("ground", "ground_cells"), ("points", "members"), ("ground", "ground_members"), ("visited", "zones"), ("ground_visited", "ground_zones")]
    return _listed(row, EQUATIONS, [F.struct((F.col(a) == F.col(b)).alias("passed"), F.col(a).alias("left_value"), F.col(b).alias("right_value")) for a, b in sides])


def invariants(tracks: DataFrame, points: DataFrame, members: DataFrame, visits: DataFrame, cells: DataFrame) -> DataFrame:
    """Seven invariants as counts of violations, each 0 when it holds. Each table is summed once; points meet tracks in one union."""
    keys = [*KEYS, "frame_index"]
    both = tracks.select(*keys, F.lit(1).alias("t"), F.lit(0).alias("p")).unionByName(points.select(*keys, F.lit(0).alias("t"), F.lit(1).alias("p")))
    both = both.groupBy(*keys).agg(F.sum("t").alias("t"), F.sum("p").alias("p"))
    row = _one_row(
        tracks.agg(_total(F.col("state") != "confirmed").alias("v1")),
        both.agg(F.abs(_total(F.col("t")) - _total(F.col("p"))).alias("v2"), _total(F.when(F.col("t") == 0, F.col("p")).otherwise(0)).alias("v3"), _total(F.greatest(F.col("p") - 1, F.lit(0))).alias("v4"), _total(F.col("p")).alias("points")),
        members.agg(F.count("*").alias("members")),
        visits.agg(_total(F.col("observation_count") > F.col("last_observed_frame") - F.col("entry_frame") + 1).alias("v6")),
        cells.agg(_total(F.col("status").isNull()).alias("v7")),
    ).withColumn("v5", F.abs(F.col("points") - F.col("members")))
    counts = [F.col(f"v{k}") for k in range(1, 8)]
    return _listed(row, INVARIANTS, [F.struct((v == 0).alias("passed"), v.alias("violations")) for v in counts])


def agreement(image_members: DataFrame, ground_members: DataFrame, wanted: list[str] | None = None, mapping: dict[str, str] | None = None) -> DataFrame:
    """How often a point's zones are the same in both spaces. ``mapping`` renames ground zones first."""
    ids = F.col("ground_ids")
    if mapping:
        table = F.create_map(*[x for k, v in sorted(mapping.items()) for x in (F.lit(k), F.lit(v))])
        ids = F.transform(ids, lambda z: F.coalesce(table[z], z))
    keys = [*KEYS, "frame_index"]
    j = image_members.select(*keys, "zone_ids").join(ground_members.select(*keys, F.col("zone_ids").alias("ground_ids")), keys)
    a, b = F.col("zone_ids"), ids
    if wanted is not None:
        only = F.array(*map(F.lit, wanted))
        a, b = F.array_intersect(a, only), F.array_intersect(b, only)
    s = j.agg(F.count("*").alias("total_compared"), F.count_if(F.array_sort(a) == F.array_sort(b)).alias("agree"))
    return s.withColumn("agreement_ratio", F.coalesce(F.try_divide("agree", "total_compared"), F.lit(1.0)))


def visits_by_space(image_visits: DataFrame, ground_visits: DataFrame, fps: float) -> DataFrame:
    """Visits, visitors and seconds of each zone with visits, in both spaces."""
    both = image_visits.withColumn("space", F.lit("image")).unionByName(ground_visits.withColumn("space", F.lit("ground")))
    span = F.sum(F.col("last_observed_frame") - F.col("entry_frame")) / F.lit(float(fps))
    return both.groupBy("space", "zone_id").agg(F.count("*").alias("visits"), F.count_distinct("seq_id", "track_id").alias("visitors"), span.alias("dwell_seconds"))


def unpivot(report: DataFrame) -> DataFrame:
    """(path, kind, value) of a one-row report of numbers."""
    kinds = {c: "float" if t == "double" else "exact" for c, t in report.dtypes}
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("path"), F.lit(k).alias("kind"), F.col(c).cast("double").alias("value")) for c, k in kinds.items()]))
    return report.select(rows.alias("r")).select("r.path", "r.kind", "r.value")


def reproducibility(first: DataFrame, second: DataFrame, abs_tol: float = 1e-5) -> DataFrame:
    """Differences of two runs' (path, kind, value): exact values by equality, floats within a tolerance."""
    a, b = F.col("a.value"), F.col("b.value")
    j = first.alias("a").join(second.alias("b"), "path", "full")
    near = F.abs(a - b) <= F.greatest(1e-9 * F.greatest(F.abs(a), F.abs(b)), F.lit(abs_tol))
    kind = F.when(a.isNull() | b.isNull(), "MISSING").when((F.col("a.kind") == "float") & ~near, "FLOAT_TOLERANCE_EXCEEDED").when((F.col("a.kind") == "exact") & (a != b), "EXACT_MISMATCH")
    return j.select("path", a.alias("value1"), b.alias("value2"), kind.alias("difference")).filter("difference is not null")


def audit_log(audit: DataFrame) -> DataFrame:
    """One line a check."""
    return audit.select(F.format_string("%-10s %s %d == %d", F.substring("name", 1, 10), F.when(F.col("passed"), "PASS").otherwise("FAIL"), F.col("left_value"), F.col("right_value")).alias("line"))


def report_json(**parts: DataFrame) -> DataFrame:
    """One row of JSON with an object for each one-row part."""
    out = None
    for name, part in sorted(parts.items()):
        row = part.select(F.struct(*part.columns).alias(name))
        out = row if out is None else out.join(F.broadcast(row))
    return out.select(F.to_json(F.struct(*sorted(parts))).alias("report"))


#: sections of a sequence's report: title, and the parts whose numbers it lists
SECTIONS = (
    ("Detection", ("detection",)), ("Tracking", ("tracking",)), ("Trajectories", ("trajectories",)),
    ("Image space", ("image_heatmap", "image_zones", "image_dwell")), ("Ground space", ("projection", "ground_heatmap", "ground_zones", "ground_dwell")),
    ("Both spaces compared", ("agreement",)),
)
LIMITS = (
    "Ground coordinates are in units of the calibration's plane, which need not be metres.",
    "Times, rates and memory describe this run; no check depends on them.",
    "Scores of detection and tracking follow a local protocol over active pedestrians, not an official benchmark.",
)


def _shown(value: object) -> str:
    return f"{value:.4f}" if isinstance(value, float) else str(value)


def sequence_markdown(title: str, parts: dict[str, DataFrame], checks: DataFrame | None = None, seconds: dict[str, float] | None = None, frames: int = 0, rss_mb: float = 0.0) -> list[str]:
    """The lines of one sequence: its sections, the conservation checks and the run's profile. Parts are a row each, checks seven."""
    lines, number = [f"## {title}", ""], 0

    def section(name: str) -> None:
        nonlocal number
        number += 1
        lines.extend([f"### {number}. {name}", ""])

    for name, wanted in SECTIONS:
        section(name)
        have = [k for k in wanted if k in parts]
        for part in have:
            lines.extend([f"**{part}**", "", "| Metric | Value |", "|---|---|"])
            lines.extend(f"| {k} | {_shown(v)} |" for k, v in parts[part].first().asDict().items())
            lines.append("")
        if not have:
            lines.extend(["No annotations to compare with.", ""])
    for part in sorted(parts.keys() - {k for _, wanted in SECTIONS for k in wanted}):
        section(part)
        lines.extend([*(f"- {k}: {_shown(v)}" for k, v in parts[part].first().asDict().items()), ""])
    if checks is not None:
        section("Conservation")
        lines.extend(["| Check | Result | Balance |", "|---|---|---|"])
        lines.extend(f"| {r.name} | {'passed' if r.passed else 'FAILED'} | {r.left_value} == {r.right_value} |" for r in checks.collect())
        lines.append("")
    if seconds:
        section("Run")
        total = sum(seconds.values())
        lines.extend([f"- Wall clock: {total:.2f} s", f"- Throughput: {frames / total if total > 0 else 0:.2f} frames/s", f"- Driver's peak memory: {rss_mb:.1f} MB"])
        lines.extend(f"- {k}: {1000 * v:.1f} ms ({1000 * v / max(frames, 1):.3f} ms a frame)" for k, v in seconds.items())
        lines.append("")
    return lines


def markdown(title: str, sequences: list[list[str]]) -> str:
    """A report of several sequences' lines."""
    return "\n".join([f"# {title}", "", *(line for one in sequences for line in one), "## Limits", "", *(f"- {x}" for x in LIMITS), ""])


def peak_rss_mb() -> float:
    """The largest memory that this driver process has held so far."""
    most = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    return most / 1e6 if sys.platform == "darwin" else most / 1e3


def report_path(folder: str, sequence: str) -> str:
    """Where a sequence's Markdown report goes; that of 'all' is the common one."""
    if sequence == "all":
        return f"{folder}/EVALUATION_REPORT.md"
    return f"{folder}/EVALUATION_REPORT_{'_'.join(sequence.upper().split('-')[:2])}.md"


def save_json(report: DataFrame, path: str) -> None:
    """Write report_json's row as a JSON text file folder."""
    report.select(F.col("report").alias("value")).write.mode("overwrite").text(path)


def violations(visits: DataFrame, ground: DataFrame) -> DataFrame:
    """Counts of rows that break a record's constraints, by constraint."""
    v = visits.agg(
        F.count_if(F.col("entry_frame") < 1).alias("visit_entry"), F.count_if(F.col("last_observed_frame") < F.col("entry_frame")).alias("visit_order"),
        F.count_if((F.col("observation_count") < 1) | (F.col("observation_count") > F.col("last_observed_frame") - F.col("entry_frame") + 1)).alias("visit_count"), F.count_if(F.length("zone_id") == 0).alias("zone_id"),
    )
    g = ground.agg(F.count_if(F.col("track_id") < 0).alias("ground_track"), F.count_if(F.col("frame_index") < 1).alias("ground_frame"), F.count_if(F.col("is_valid") & (F.isnan("x") | F.isnan("y"))).alias("ground_finite"))
    return v.join(F.broadcast(g))
