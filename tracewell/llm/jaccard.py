"""Exact Jaccard join of documents on word shingles, by regions of a metric space.

One minus the Jaccard similarity is a metric. With a link at similarity r,
linked sets x, y lie within t = 1 - r of each other, and:

1. *Pivots and regions.* Far from every document pivot all distances are 1, so
   the first pivots are single shingles: d(x, {s}) < 1 only for s in x. Shingles
   are ranked, common ones last; the region of s holds the sets that have s
   among their first |x| - ceil(r |x|) + 1 shingles. That many boundary copies
   are what the triangle inequality asks for: two linked sets share a region,
   or their ranked heads would be disjoint and their distance above t.
2. *Cells.* Regions with the same least member are one cell, whose pivot that
   member is: copies of one text share dozens of shingles, but few cells.
3. *Windows.* Each set has a bit vector of shingle-count parities. The bits in
   which two sets differ are at most the shingles in which they do, so they
   bound the distance from below, and sizes bound it too. The pairs of a cell
   that neither bound rules out are candidates; a spanning forest of them
   stands for them, and its components are the groups in which links can lie.
   So far no text has moved; now each text that has a candidate moves, once.
4. *Joins.* A group is joined exactly in one task. Distances to pivots give
   windows: |d(x, p) - d(y, p)| > t rules a pair out. Links are returned as the
   stars of their components, so a group of n sets gives fewer than n rows.
5. *Recursion.* A group of more than ``CELL`` sets gets document pivots, drawn
   from it. Links to them join most of its sets to one component, whose inner
   pairs need no comparison. Each set has its home in the Voronoi region of its
   nearest pivot; every set outside that component also visits, as boundary
   copy, each region whose pivot is within 2 t of its nearest one. Sets at
   ``FAR`` or more from every pivot have a region of their own. A region is a
   group like the first: joined where it is small enough, else with pivots of
   its own. Regions that do not shrink are joined block by block.

Sets are nodes named by a 64-bit digest of their shingles' 64-bit hashes; equal
sets are joined once. Shingles are ranked by a fixed number of hashed counters
over the whole corpus; any ranking gives the same links, so neither the number
of counters nor a clash in them drops anything.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm import textscan
from tracewell.llm.components import components
from tracewell.llm.shared import KeyFilter, drop, kept
from tracewell.llm.textscan import Seen

#: sets that are joined at once, at most
CELL = 512
#: shingles that are joined at once, but for single pairs
CELL_SHINGLES = 4_000_000
#: a cell may have so many times CELL members while only their bits meet
THIN = 8
#: hashed counters of the shingles, and how many go in a block of them
COUNTERS, COUNTER_BLOCK = 1 << 22, 1 << 16
#: a count from which a region may be too large for one task's window
HOT = 1 << 16
#: pivots of a recursion step, and steps
PIVOTS, DEPTH = 16, 6
#: distance to the nearest pivot from which a set is in no pivot's region
FAR = 0.5
#: links that a task holds before it tells their components
EDGES = 100_000
#: members of a crowded cell that are streamed past its pivots in one part
PART = 1024


@dataclass(frozen=True)
class Shingling:
    """Sets of ``words``-word shingles; a link at 100 * overlap >= percent * union."""

    words: int = 4
    percent: int = 85

    def head(self, n: np.ndarray | int):
        """Shingles of a set of n that can be a linked pair's first shared one."""
        return n - (-(-self.percent * n // 100)) + 1

    def linked(self, both, n, m):
        return 100 * both >= self.percent * (n + m - both)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the distinct shingle hashes of each document, ascending; a short text is one shingle."""
    found = textscan.scan(data, offsets)
    h = found.hashes(fold=True)
    docs = found.docs
    size = np.diff(found.first)
    w = textscan.windows(h, words)
    doc = np.repeat(np.arange(docs), size)
    inside = doc[: len(w)] == doc[words - 1 :] if len(w) else np.zeros(0, bool)
    parts, first = [], np.zeros(docs + 1, np.int64)
    w_doc = doc[: len(w)][inside]
    w = w[inside]
    cuts = np.searchsorted(w_doc, np.arange(docs + 1))
    for d in range(docs):
        if size[d] >= words:
            s = np.unique(w[cuts[d] : cuts[d + 1]])
        elif size[d]:
            s = h[found.first[d] : found.first[d + 1]]
            x = np.full(1, 0x5851F42D4C957F2D + len(s), np.uint64)
            for v in s:
                x = textscan.mix(x * np.uint64(0x9E3779B97F4A7C15) + v)
            s = x
        else:
            s = np.zeros(0, np.uint64)
        parts.append(s)
        first[d + 1] = first[d] + len(s)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), first


def digests(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each set; equal sets have equal ones."""
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(textscan.mix(hashes + np.uint64(0x2545F4914F6CDD1D)), out=sums[1:])
    return textscan.mix(sums[first[1:]] - sums[first[:-1]] + (first[1:] - first[:-1]).astype(np.uint64)).view(np.int64)


def parity_bits(s: np.ndarray) -> bytes:
    """For each of 64 or more hash classes, about one a shingle, whether the set has an odd number in it."""
    size = 1 << max(6, int(len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size).astype(np.uint8) & 1).tobytes()


def signatures(docs: DataFrame, how: Shingling) -> DataFrame:
    """One pass over the texts of docs (doc_id, text_hash, text) for two kinds of rows.

    A row a document: doc_id, text_hash, the set's digest d, its size n and its
    parity bits. And rows with a ``block``: the task's counters of the shingles
    of its distinct sets, packed, in which nothing else is set.
    """
    names = ["doc_id", "text_hash", "d", "n", "bits", "block", "counts"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.binary()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        counts, seen = np.zeros(COUNTERS, np.uint16), Seen()
        for b in batches:
            for lo, hi, data, offsets in textscan.chunks(b.column(2)):
                h, first = shingle_sets(data, offsets, how.words)
                d, size = digests(h, first), np.diff(first)
                bits = [parity_bits(h[first[k] : first[k + 1]]) for k in range(hi - lo)]
                at, more = np.unique(h[np.repeat(seen.fresh(d), size)] & np.uint64(COUNTERS - 1), return_counts=True)
                at = at.astype(np.int64)
                counts[at] = np.minimum(counts[at] + more, 65535)
                made = [pa.array(d), pa.array(size.astype(np.int32)), pa.array(bits, pa.binary())]
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], b.column(1)[lo:hi], *made, pa.nulls(hi - lo, pa.int32()), pa.nulls(hi - lo, pa.binary())], names)
        z = zstandard.ZstdCompressor(level=1)
        for k, part in enumerate(counts.reshape(-1, COUNTER_BLOCK)):
            if part.any():
                yield pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in kinds[:5]), pa.array([k], pa.int32()), pa.array([z.compress(part.tobytes())], pa.binary())], names)

    return docs.mapInArrow(textscan.tidy(run), "doc_id long, text_hash long, d long, n int, bits binary, block int, counts binary")


def commonness(signed: DataFrame) -> np.ndarray:
    """The level of each counter, eight a doubling, from the counter rows of ``signed``: one byte each, summed in Spark."""

    def total(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, packed in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                part = np.frombuffer(zstandard.decompress(packed.as_py()), np.uint16)
                if k in sums:
                    sums[k] += part
                else:
                    sums[k] = part.astype(np.int64)
        for k, part in sums.items():
            level = np.minimum(np.round(8 * np.log2(1.0 + part)), 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([level.tobytes()], pa.binary())], ["block", "levels"])

    rows = signed.filter("block is not null").select("block", "counts").repartition("block")
    out = np.zeros((COUNTERS // COUNTER_BLOCK, COUNTER_BLOCK), np.uint8)
    for k, levels in zip(*(c.to_pylist() for c in rows.mapInArrow(textscan.tidy(total), "block int, levels binary").toArrow().columns), strict=True):
        out[k] = np.frombuffer(levels, np.uint8)
    return out.ravel()


def level_of(count: int) -> int:
    return min(255, round(8 * float(np.log2(1 + count))))


def heads(docs: DataFrame, how: Shingling, levels: np.ndarray, hot: bool = False) -> DataFrame:
    """(s, d): each set in each region that it belongs to, for regions of counts from HOT on or those below.

    A region is named by its shingle's rank: its level, then most of its hash.
    """
    edge = np.uint64(level_of(HOT) << 56)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for b in batches:
            for _, _, data, offsets in textscan.chunks(b.column(0)):
                h, first = shingle_sets(data, offsets, how.words)
                d, size = digests(h, first), np.diff(first)
                rank = levels[(h & np.uint64(COUNTERS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(56) | h >> np.uint64(8)
                parts, own = [], []
                for k in np.flatnonzero(seen.fresh(d) & (size > 0)):
                    n = int(how.head(int(size[k])))
                    x = np.partition(rank[first[k] : first[k + 1]], n - 1)[:n]
                    x = x[(x >= edge) == hot]
                    parts.append(x)
                    own.append(np.full(len(x), d[k]))
                if parts:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts).view(np.int64)), pa.array(np.concatenate(own))], ["s", "d"])

    return docs.select("text").mapInArrow(textscan.tidy(run), "s long, d long")


def cells(docs: DataFrame, how: Shingling, levels: np.ndarray) -> DataFrame:
    """(d, cell): the cells of each set, named by their least member. A region of one set makes none.

    Rows meet by region once. Regions whose count may be too large for that get
    their bounds from partial sums, and meet them in a join that Spark can split.
    """
    w = Window.partitionBy("s")
    found = heads(docs, how, levels).select("d", F.min("d").over(w).alias("cell"), F.max("d").over(w).alias("top"))
    found = found.filter("cell < top").select("d", "cell")
    if levels.max(initial=0) >= level_of(HOT):
        rows = kept(heads(docs, how, levels, hot=True))
        ends = kept(rows.groupBy("s").agg(F.min("d").alias("cell"), F.max("d").alias("top")).filter("cell < top"))
        found = found.union(rows.join(ends, "s").select("d", "cell"))
    return found.distinct()


class Forest:
    """Union-find over rows 0..n-1."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True

    def roots(self) -> np.ndarray:
        while True:
            up = self.up[self.up]
            if (up == self.up).all():
                return up
            self.up = up


def stars(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    """The same components as stars: (a, b) of every node a but the least of its component, b."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return pa.RecordBatch.from_arrays([pa.array(list(up), pa.int64()), pa.array([root(x) for x in list(up)], pa.int64())], ["a", "b"])


def bit_forest(n: np.ndarray, bits: list[bytes], how: Shingling) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets that may link, by size and parity bits; leaves no link out."""
    if len(n) < 2:
        return []
    order = np.argsort(n, kind="stable")
    n = np.asarray(n, np.int64)[order]
    wide = np.array([len(bits[i]) for i in order])
    cuts = np.flatnonzero(np.diff(wide, prepend=0, append=0))  # larger sets have as many bits or more
    forest, out = Forest(len(n)), []
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        to = int(np.searchsorted(n, n[hi - 1] * 100 // how.percent, side="right"))
        if to - lo < 2:
            continue
        mine = np.frombuffer(b"".join(bits[i] for i in order[lo:hi]), np.uint64).reshape(hi - lo, -1)
        if to > hi:  # sets with twice as many classes, folded to as few
            more = np.frombuffer(b"".join(bits[i] for i in order[hi:to]), np.uint64).reshape(to - hi, -1)
            while more.shape[1] > mine.shape[1]:
                half = more.shape[1] // 2
                more = more[:, :half] ^ more[:, half:]
            both = np.concatenate([mine, more])
        else:
            both = mine
        for i in range(hi - lo):
            end = int(np.searchsorted(n, n[lo + i] * 100 // how.percent, side="right")) - lo
            if end <= i + 1:
                continue
            apart = np.bitwise_count(both[i + 1 : end] ^ mine[i]).sum(1, dtype=np.int64)
            near = np.flatnonzero(apart * (100 + how.percent) <= (100 - how.percent) * (n[lo + i] + n[lo + i + 1 : lo + end]))
            for j in near.tolist():
                if forest.join(lo + i, lo + i + 1 + j):
                    out.append((int(order[lo + i]), int(order[lo + i + 1 + j])))
    return out


def join_sets(sets: list[np.ndarray], how: Shingling, across: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among the sets, exactly.

    Each set in turn is a pivot for those after it. A pair is compared unless
    its sizes, the window of an earlier pivot, or a chain of links that joins
    the two already make it needless. Pairs of two sets with ``across`` 0 need
    no comparison at all.
    """
    n = len(sets)
    if n < 2:
        return []
    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")
    size = size[order]
    side = across[order] if across is not None else None
    flat = np.concatenate([sets[i] for i in order])
    names, ids = np.unique(flat, return_inverse=True)
    start = np.concatenate([[0], np.cumsum(size)])
    mark = np.zeros(len(names), bool)
    forest, out = Forest(n), []
    far = 1 - how.percent / 100 + 1e-9
    seen: list[np.ndarray] = []  # distances to the first pivots
    for i in range(n - 1):
        if not size[i]:
            continue
        stop = int(np.searchsorted(size, size[i] * 100 // how.percent, side="right"))
        later = np.arange(i + 1, stop)
        if not len(later):
            continue
        # a set that shares nothing new to join needs no comparison
        roots = forest.roots()
        later = later[roots[later] != roots[i]]
        if side is not None and not side[i]:
            later = later[side[later] > 0]
        for d in seen:
            later = later[np.abs(d[later] - d[i]) <= far]
        if not len(later):
            continue
        whole = len(seen) < 4 and len(later) > 32
        if whole:
            later = np.arange(n)
        mark[ids[start[i] : start[i + 1]]] = True
        lens = size[later]
        take = np.repeat(start[later] - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(lens.sum())
        hit = np.concatenate([[0], np.cumsum(mark[ids[take]])])
        ends = np.cumsum(lens)
        both = hit[ends] - hit[ends - lens]
        mark[ids[start[i] : start[i + 1]]] = False
        if whole:
            seen.append(1 - both / np.maximum(size + size[i] - both, 1))
        ok = how.linked(both, lens, size[i]) & (later != i)
        if side is not None and not side[i]:
            ok &= side[later] > 0
        for j in later[ok]:
            if forest.join(i, int(j)):
                out.append((int(order[i]), int(order[j])))
    return out


def _sets_of(texts: list[bytes], words: int) -> list[np.ndarray]:
    import zstandard

    raw = [zstandard.decompress(t) for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    h, first = shingle_sets(np.frombuffer(b"".join(raw), np.uint8), offsets, words)
    return [h[first[i] : first[i + 1]] for i in range(len(raw))]


def _link_rows(batches: Iterable[pa.RecordBatch], how: Shingling) -> Iterator[pa.RecordBatch]:
    """Join each group of rows (cell, d, text, side) that come sorted by cell; (a, b) are digests."""
    links: list[tuple[int, int]] = []

    def solve(rows: dict[int, tuple[bytes, int]]) -> None:
        sides = np.array([side for _, side in rows.values()])
        if len(rows) < 2 or not sides.any():
            return
        names = list(rows)
        for i, j in join_sets(_sets_of([text for text, _ in rows.values()], how.words), how, None if sides.all() else sides):
            links.append((names[i], names[j]))

    def told() -> pa.RecordBatch:
        made = stars(links)
        links.clear()
        return made

    at, rows = None, {}
    for b in batches:
        cell, ds, side = (b.column(k).to_pylist() for k in (0, 1, 3))
        for i, text in enumerate(b.column(2)):
            if cell[i] != at:
                solve(rows)
                at, rows = cell[i], {}
                if len(links) > EDGES:
                    yield told()
            # a set may come as home member and as visitor, or in repeated rows
            if ds[i] not in rows or side[i] > rows[ds[i]][1]:
                rows[ds[i]] = (text.as_py(), side[i])
    solve(rows)
    if links:
        yield told()


def whole_cells(rows: DataFrame, *columns: str) -> DataFrame:
    """The rows with each cell whole in one partition, sorted by cell.

    Dealt by a hash of the cell: a repartition by the cell itself would be
    dropped behind a join on it, and such a join's partitions may be split.
    """
    return rows.select(*columns).repartition(F.xxhash64("cell", F.lit("deal"))).sortWithinPartitions("cell")


def join_cells(members: DataFrame, how: Shingling) -> DataFrame:
    """The components of the links of sets within each cell of (cell, d, text, side), as stars (a, b)."""
    dealt = whole_cells(members, "cell", "d", "text", "side")
    return dealt.mapInArrow(textscan.tidy(lambda batches: _link_rows(batches, how)), "a long, b long")


def candidates(found: DataFrame, first: DataFrame, how: Shingling, thin: int) -> DataFrame:
    """(a, b): stars of the components of the pairs in the cells of ``found`` (d, cell) that sizes and parity bits do not rule out.

    A cell of more than ``thin`` sets is one group as it is, without a task that sees all of it.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (cell, d, n, bits) come sorted by cell."""
        held: pa.Table | None = None
        edges: list[tuple[int, int]] = []

        def add(t: pa.Table) -> None:
            c, d, n, bits = t["cell"].to_numpy(), t["d"].to_pylist(), t["n"].to_numpy(), t["bits"].to_pylist()
            cuts = np.concatenate([[0], np.flatnonzero(c[1:] != c[:-1]) + 1, [len(c)]])
            edges.extend((d[i + x], d[i + y]) for i, j in zip(cuts[:-1], cuts[1:], strict=True) for x, y in bit_forest(n[i:j], bits[i:j], how))

        for b in batches:
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([held, t]).combine_chunks() if held is not None else t
            c = t["cell"].to_numpy()
            whole = int(np.searchsorted(c, c[-1])) if len(c) else 0
            if whole:
                add(t.slice(0, whole))
            held = t.slice(whole)
            if len(edges) > EDGES:
                yield stars(edges)
                edges.clear()
        if held is not None and held.num_rows:
            add(held)
        if edges:
            yield stars(edges)

    crowded = kept(found.groupBy("cell").agg(F.count("*").alias("size")).filter(F.col("size") > thin).select("cell"))
    rows, edges = found, None
    if crowded.take(1):
        rows = found.join(crowded, "cell", "left_anti")
        edges = found.join(crowded, "cell").filter("d <> cell").select(F.col("d").alias("a"), F.col("cell").alias("b"))
    rows = whole_cells(rows.join(first.select("d", "n", "bits"), "d"), "cell", "d", "n", "bits")
    pairs = rows.mapInArrow(textscan.tidy(run), "a long, b long")
    return pairs if edges is None else pairs.union(edges)


PLACED = "cell long, d long, n int, text binary, side int, home int, near array<int>, links array<long>, linked long"
#: the bit of members that were settled before
SETTLED = 1 << 62


def to_pivots(inside: DataFrame, how: Shingling, pivots: int) -> DataFrame:
    """Members (cell, d, n, text, side) with their exact distances to pivots drawn from each cell put to use.

    home: the nearest pivot, or -1 where none is nearer than FAR. near: the
    regions in which a linked set can have its home. One at home with pivot p
    is nearer than FAR to it, so p is within FAR + t of the member, and within
    2 t of its nearest; one at home in -1 is only linked to members that are
    FAR - t or more from all pivots. links: the pivots that the member links
    to; linked: their bits and its own, if it is a pivot. There are at most 62
    pivots. Members of side 1 are drawn first. A cell is dealt in parts, each led
    by all of its pivots, and streamed past them.
    """
    t = 1 - how.percent / 100
    parts = kept(inside.groupBy(F.col("cell").alias("of")).agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")))
    # of each residue of the members' hashes the least is a pivot: few rows leave each task
    drawn = inside.select("cell", "side", F.xxhash64("d", "cell").alias("h"), F.struct("d", "text").alias("p"))
    drawn = drawn.groupBy("cell", F.pmod("h", F.lit(pivots)).alias("slot")).agg(F.min_by("p", F.struct(-F.col("side"), "h")).alias("p"))
    leads = drawn.join(parts, F.col("cell") == F.col("of")).select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("member"), "p.d", F.lit(0).alias("n"), "p.text", F.lit(0).alias("side"))
    rows = inside.join(parts, F.col("cell") == F.col("of")).select("cell", F.pmod(F.xxhash64("d", F.lit("part")), F.col("parts")).cast("int").alias("part"), F.lit(True).alias("member"), "d", F.col("n").cast("int").alias("n"), "text", F.col("side").cast("int").alias("side"))
    dealt = leads.union(rows).repartition(F.xxhash64("cell", "part", F.lit("deal"))).sortWithinPartitions("cell", "part", "member", "d")
    names = [x.split()[0] for x in PLACED.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, named, held, lens = None, [], [], np.zeros(0)
        for b in batches:
            home, near, links, bits, rows = [], [], [], [], []
            cell, part, member, ds, side = (b.column(k).to_pylist() for k in (0, 1, 2, 3, 6))
            for i, text in enumerate(b.column(5)):
                if (cell[i], part[i]) != at:
                    at, named, held = (cell[i], part[i]), [], []
                mine = _sets_of([text.as_py()], how.words)[0]
                if not member[i]:
                    named.append(ds[i])
                    held.append(mine)
                    lens = np.array([len(p) for p in held])
                    continue
                both = np.array([len(np.intersect1d(mine, p, assume_unique=True)) for p in held])
                dist = 1 - both / np.maximum(lens + len(mine) - both, 1)
                rows.append(i)
                least = dist.min()
                home.append(int(dist.argmin()) if least < FAR else -1)
                near.append([*np.flatnonzero(dist <= min(least + 2 * t, FAR + t) + 1e-9).tolist(), *([-1] if least >= FAR - t - 1e-9 else [])])
                met = np.flatnonzero(how.linked(both, lens, len(mine))).tolist()
                links.append([named[k] for k in met if named[k] != ds[i]])
                bits.append(sum(1 << k for k in met) | (0 if side[i] else SETTLED))
            own = [b.column(k).take(pa.array(rows, pa.int64())) for k in (0, 3, 4, 5, 6)]
            made = [pa.array(home, pa.int32()), pa.array(near, pa.list_(pa.int32())), pa.array(links, pa.list_(pa.int64())), pa.array(bits, pa.int64())]
            yield pa.RecordBatch.from_arrays([*own, *made], names)

    return dealt.mapInArrow(textscan.tidy(run), PLACED)


def regions(placed: DataFrame) -> DataFrame:
    """(cell, d, n, text, side, of, parent): the Voronoi regions of each cell, with the cell and its size.

    A member's ``linked`` has a bit for each pivot that it links to or is, and
    one for what was settled before. Members whose bits meet, at once or by
    way of others, are one component. Of each cell the component with most sets
    is settled within itself: its members have side 0 and visit no region.
    """
    seen = placed.groupBy("cell", "linked").agg(F.count("*").alias("k")).groupBy("cell").agg(F.collect_list(F.struct("linked", "k")).alias("seen"), F.sum("k").alias("parent"))

    def grown(acc: Column, x: Column) -> Column:
        """Disjoint unions of bits, and the next bits joined to those that they meet."""
        meets = lambda y: y.bitwiseAND(x["linked"]) != 0
        joined = F.aggregate(F.filter(acc, meets), x["linked"], lambda a, y: a.bitwiseOR(y))
        return F.concat(F.filter(acc, lambda y: ~meets(y)), F.array(joined))

    unions = F.aggregate("seen", F.array().cast("array<long>"), grown)
    counted = F.transform(unions, lambda u: F.struct(F.aggregate(F.filter("seen", lambda x: x["linked"].bitwiseAND(u) != 0), F.lit(0).cast("long"), lambda a, x: a + x["k"]).alias("k"), u.alias("bits")))
    main = kept(seen.select(F.col("cell").alias("of"), F.array_max(counted)["bits"].alias("main"), "parent"))
    rows = placed.join(main, placed["cell"] == main["of"]).withColumn("side", (F.col("linked").bitwiseAND(F.col("main")) == 0).cast("int"))
    at = F.explode(F.when(F.col("side") > 0, F.col("near")).otherwise(F.array("home")))
    return rows.select("of", "d", "n", "text", "side", "parent", at.alias("region")).select(F.xxhash64("of", "region").alias("cell"), "d", "n", "text", "side", "of", "parent")


def blocks(rows: DataFrame, cell: int) -> DataFrame:
    """Cells (cell, d, text, side) in which every member of side 1 meets every other of its group, in blocks of either.

    ``rows`` also have their group's size and weight (in shingles), and those of its members of side 1.
    """
    half = max(cell // 2, 1)

    def parts(size: str, weight: str) -> Column:
        return F.greatest(F.ceil(F.col(size) / half), F.ceil(F.col(weight) / (CELL_SHINGLES // 2))).cast("int")

    def cut(of: str) -> Column:
        return F.pmod(F.xxhash64("d", F.lit("block")), F.col(of)).cast("int")

    def each(of: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(of) - 1))

    rows = rows.withColumn("hosts", parts("size", "weight")).withColumn("parties", parts("guests", "guest_weight"))
    a = rows.select("cell", "d", "text", F.lit(0).alias("side"), cut("hosts").alias("block"), each("parties").alias("party"))
    b = rows.filter("side > 0").select("cell", "d", "text", F.lit(1).alias("side"), each("hosts").alias("block"), cut("parties").alias("party"))
    return a.union(b).select(F.xxhash64("cell", "block", "party").alias("cell"), "d", "text", "side")


def join_large(members: DataFrame, how: Shingling, cell: int, pivots: int, depth: int = DEPTH, count: int | None = None) -> DataFrame:
    """Pairs (a, b) with the components of the links of sets within groups of any size, (cell, d, n, text), by Voronoi regions, recursively.

    A region is joined at once when it has at most ``cell`` members. A larger
    one gets pivots of its own while it has at most three quarters of its
    parent's members, and such regions together at most twice as many as it;
    else it is joined by blocks. A region without open members goes. ``count``:
    about how many sets there are.
    """
    rows, found, parts = members.withColumn("side", F.lit(1)), None, None
    for level in range(depth):
        placed = kept(to_pivots(rows, how, pivots))
        links = placed.select(F.col("d").alias("a"), F.explode("links").alias("b"))
        done, parts = parts, kept(regions(placed))
        sizes = parts.groupBy("cell").agg(F.count("*").alias("size"), F.sum("n").alias("weight"), F.sum("side").alias("guests"), F.sum(F.col("n") * F.col("side")).alias("guest_weight"), F.max("of").alias("of"), F.max("parent").alias("parent"))
        sizes = sizes.filter("guests > 0")
        fits = (F.col("size") <= cell) & ((F.col("weight") <= CELL_SHINGLES) | (F.col("size") <= 2))
        shrunk = (4 * F.col("size") <= 3 * F.col("parent")) if level + 1 < depth else F.lit(False)
        sizes = sizes.withColumn("next", F.when(fits, "join").when(shrunk, "regions").otherwise("blocks"))
        together = F.sum(F.when(F.col("next") == "regions", F.col("size"))).over(Window.partitionBy("of"))
        sizes = kept(sizes.withColumn("next", F.when((F.col("next") == "regions") & (together > 2 * F.col("parent")), "blocks").otherwise(F.col("next"))).drop("of", "parent"))
        sized = parts.join(sizes, "cell")
        links = links.union(join_cells(sized.filter("next = 'join'"), how)).union(join_cells(blocks(sized.filter("next = 'blocks'"), cell), how))
        before, found = found, kept((links if found is None else found.union(links)).distinct(), count)
        drop(placed, *([done, before] if level else []))
        if not sizes.filter("next = 'regions'").take(1):
            break
        rows = sized.filter("next = 'regions'").select("cell", "d", "n", "text", "side")
    return found


def _fetched(docs: DataFrame, wanted: DataFrame, how: Shingling) -> DataFrame:
    """(d, text): the compressed text of each wanted set (d, text_hash). Only texts that may be wanted are read into sets and move."""
    asked = KeyFilter.of(wanted, "text_hash")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z, seen = zstandard.ZstdCompressor(level=3), Seen()
        for b in batches:
            key = b.column(0).to_numpy()
            at = np.flatnonzero(asked.passes(key))
            at = at[seen.fresh(key[at])]
            if not len(at):
                continue
            key, texts = key[at], b.column(1).take(pa.array(at))
            for lo, hi, data, offsets in textscan.chunks(texts):
                d, raw = digests(*shingle_sets(data, offsets, how.words)), data.tobytes()
                packed = [z.compress(raw[offsets[i] : offsets[i + 1]]) for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([pa.array(key[lo:hi]), pa.array(d), pa.array(packed, pa.binary())], ["key", "of", "text"])

    packed = docs.select("text_hash", "text").mapInArrow(textscan.tidy(run), "key long, of long, text binary")
    return wanted.join(packed, (F.col("text_hash") == F.col("key")) & (F.col("d") == F.col("of"))).select("d", "text")


def groups(docs: DataFrame, how: Shingling = Shingling(), cell: int = CELL, pivots: int = PIVOTS, unnamed: bool = False) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, text_hash, n_shingles, component_id and stays.

    ``stays`` tells the row that stands for its component, the least by
    doc_id (null last), then by the hash of its text; rows that repeat one
    another share the answer. Rows without words stay. Rows with a null doc_id take part only with ``unnamed``; a
    component of such rows alone has a null component_id.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    part = F.lit(True) if unnamed else F.col("doc_id").isNotNull()
    whole = kept(signatures(docs, how))
    signed = whole.filter("block is null").drop("block", "counts")
    real = signed.filter((F.col("n") > 0) & part)
    levels, count = commonness(whole), whole.count()
    # each distinct set once, with the row that stands for it and a text of it
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    first = real.groupBy("d").agg(F.min(row).alias("least"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.min("doc_id").alias("rep"))
    near = kept(cells(docs.filter(part), how, levels), count)
    grouped = components(candidates(near, first, how, THIN * cell), rows=count)
    drop(near)
    wanted = kept(grouped.join(first.drop("bits"), grouped["node"] == first["d"]).select("d", "n", F.col("least.text_hash").alias("text_hash"), F.col("label").alias("cell")), count)
    sizes = wanted.groupBy("cell").agg(F.count("*").alias("size"), F.sum("n").alias("weight"))
    large = kept(sizes.filter((F.col("size") > cell) | (F.col("weight") > CELL_SHINGLES) & (F.col("size") > 2)).select("cell", F.lit(True).alias("large")))
    texts = _fetched(docs, wanted.select("d", "text_hash"), how).withColumnRenamed("d", "at")
    members = texts.join(wanted, F.col("at") == F.col("d")).select("cell", "d", "n", "text")
    if large.take(1):
        members = kept(members.join(large, "cell", "left"))
        few = members.filter("large is null")
        edges = join_cells(few.withColumn("side", F.lit(1)), how).union(join_large(members.filter("large").drop("large").dropDuplicates(["cell", "d"]), how, cell, pivots, count=count))
    else:
        edges = join_cells(members.withColumn("side", F.lit(1)), how)
    linked = components(edges, rows=count)
    drop(wanted, large, *([members] if hasattr(members, "kept_at") else []))
    # the least row of each component stands for it
    known = first.select(F.col("d"), "least", "rep")
    inside = kept(linked.join(known, linked["node"] == known["d"]).select("d", "label", "least", "rep"), count)
    ends = inside.groupBy("label").agg(F.min("least").alias("end"), F.min("rep").alias("component_id"))
    inside = inside.join(ends, "label").select(F.col("d").alias("of"), "end", "component_id")
    told = known.join(inside, F.col("d") == F.col("of"), "left").select(F.col("d").alias("set"), F.coalesce("end", "least").alias("end"), F.coalesce("component_id", "rep").alias("component_id"))
    told = kept(told, count)
    # both sides are read anew, so Spark may split the rows of one set that many documents have
    done = real.join(told, F.col("d") == F.col("set")).select("doc_id", "text_hash", F.col("n").cast("long").alias("n_shingles"), "component_id", (F.col("doc_id").eqNullSafe(F.col("end.doc_id")) & (F.col("text_hash") == F.col("end.text_hash"))).alias("stays"))
    rest = signed.filter(~((F.col("n") > 0) & part))
    return done.union(rest.select("doc_id", "text_hash", F.col("n").cast("long"), "doc_id", F.lit(True)))


def similar_components(docs: DataFrame, how: Shingling = Shingling(), cell: int = CELL, pivots: int = PIVOTS) -> DataFrame:
    """doc_id, n_shingles and component_id, the least doc_id reachable by links.

    Null and wordless texts have no shingles and link with nothing. Rows with
    a null doc_id get a null component and take no part. Repeated rows are
    copies of one another and give one row each; rows of one doc_id with
    different texts are documents of their own; extra columns are ignored; an
    empty table gives no rows.
    """
    return groups(docs, how, cell, pivots).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, how: Shingling = Shingling()) -> DataFrame:
    """The rows of docs, one of each component of near duplicates: the least by doc_id, a null one last, then by its text's hash.

    Of rows that repeat one another's id and text, the least by its other
    columns stays, so these must have an order. Rows without words all stay.
    Rows with a null doc_id take part like others. All columns stay as they
    are, whatever their names; an empty table gives no rows. Only rows that
    may have to go move.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("row")).select("row", F.col("row.doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce(F.col("row.text").cast("string"), F.lit(""))).alias("text_hash"))
    found = kept(groups(docs, how, unnamed=True))
    keys = found.filter("n_shingles > 0").groupBy(F.col("doc_id").alias("found_id"), F.col("text_hash").alias("found_hash")).agg(F.max("stays").alias("stays"), F.count("*").alias("rows"))
    keys = kept(keys.filter("rows > 1 or not stays"), found.count())
    named = F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")), "text_hash")
    asked = KeyFilter.of(keys.select(F.xxhash64(F.coalesce(F.col("found_id").cast("string"), F.lit("")), "found_hash").alias("key")), "key")
    sure, unsure = asked.split(rows.withColumn("key", named), "key")
    same = (F.col("text_hash") == F.col("found_hash")) & F.col("id").eqNullSafe(F.col("found_id"))
    other = unsure.join(keys, same, "left_anti").select("row")
    again = unsure.join(keys.filter("stays"), same, "left_semi").groupBy("id", "text_hash").agg(F.min("row").alias("row")).select("row")
    return sure.select("row").union(other).union(again).select("row.*")
