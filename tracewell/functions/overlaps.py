"""Boxes of one image against each other, in numpy: overlapping pairs in blocks, greedy and optimal one-to-one choices.

Memory is that of the boxes and a block of pairs, and for the greedy choice
that of the pairs at the threshold.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np

from tracewell.functions.assignment import assign

#: pairs looked at in one go; up to so many in all, no index is asked; neighbours remembered in a search
BLOCK, FEW, KNOWN = 1 << 16, 1 << 14, 1 << 22
#: bounds of the index are widened by so much of a coordinate; pairs are then tested exactly
SLACK = 1e-9
#: the best partner of a box is looked for at these overlaps first
LEVELS = (0.9, 0.5, 0.0)
#: a greedy choice by IoU lists pairs from these overlaps on first; one in the left one's order, those of so many shares of the boxes in turn
STEPS, SHARES = (0.9, 0.8, 0.7, 0.6), 16


def spans(start: np.ndarray, stop: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(k, at) for every position at in start[k]:stop[k], in blocks."""
    n = np.maximum(stop - start, 0)
    ends = np.cumsum(n)
    a = 0
    while a < len(n):
        base = ends[a] - n[a]
        b = max(a + 1, int(np.searchsorted(ends, base + BLOCK, "right")))
        first = start[a:b] - (ends[a:b] - n[a:b])
        yield np.repeat(np.arange(a, b), n[a:b]), np.arange(base, ends[b - 1]) + np.repeat(first, n[a:b])
        a = b


def sides(boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Width, height, and whether a box is finite and has both; where not, the sides are 0."""
    with np.errstate(invalid="ignore", over="ignore"):
        w, h = boxes[:, 2] - boxes[:, 0], boxes[:, 3] - boxes[:, 1]
        ok = np.isfinite(boxes).all(1) & np.isfinite(w) & np.isfinite(h) & (w > 0) & (h > 0)
    return np.where(ok, w, 0.0), np.where(ok, h, 0.0), ok


class Overlaps:
    """Boxes (x1, y1, x2, y2) of one image, to be asked what overlaps them.

    Those whose sides have the same powers of two are of one kind, sorted by
    strips of the image and then by x1. A pair with an IoU of t or more has
    sides that differ by no more than t and corners that are apart by no more
    than 1 - t of a side: so large boxes among small ones cost nothing, and
    only near boxes are tested.
    """

    def __init__(self, boxes: np.ndarray):
        self.boxes = boxes
        self._kinds: list[tuple] | None = None

    def kinds(self) -> list[tuple]:
        if self._kinds is None:
            w, h, ok = sides(self.boxes)
            at = np.flatnonzero(ok)
            power = np.frexp(w[at])[1].astype(np.int64) * 8192 + np.frexp(h[at])[1]
            self._kinds = [self._kind(at[power == k], w, h) for k in np.unique(power)]
        return self._kinds

    def _kind(self, rows: np.ndarray, w: np.ndarray, h: np.ndarray) -> tuple:
        x, step = self.boxes[rows, 0], h[rows].max() / 4
        strips, strip = np.unique(np.floor(self.boxes[rows, 1] / step), return_inverse=True)
        xs = np.sort(x)
        key = strip * (len(rows) + 1) + np.searchsorted(xs, x)
        order = np.argsort(key, kind="stable")
        rows = rows[order]
        return rows, _columns(self.boxes[rows]), key[order], strips, xs, step, (w[rows].min(), w[rows].max()), (h[rows].min(), h[rows].max())

    def meeting(self, boxes: np.ndarray, least: float = 0.0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(i, j, iou) of the pairs boxes[i], self.boxes[j] whose IoU is positive and at least ``least``, in blocks."""
        w, h, ok = sides(boxes)
        if len(boxes) * len(self.boxes) <= FEW:
            ours = np.flatnonzero(sides(self.boxes)[2])
            asked = np.flatnonzero(ok)
            yield _tested(_columns(boxes), _columns(self.boxes), np.repeat(asked, len(ours)), np.tile(ours, len(asked)), None, least)
            return
        part, more, asked = 1 - least, 1 + SLACK, _columns(boxes)
        for rows, held, key, strips, xs, step, (w0, w1), (h0, h1) in self.kinds():
            q = np.flatnonzero(ok & (w * more >= least * w0) & (w1 * more >= least * w) & (h * more >= least * h0) & (h1 * more >= least * h))
            x, y, u, v = boxes[q, 0], boxes[q, 1], w[q], h[q]
            dx, dy = SLACK * (np.abs(x) + u + w1), SLACK * (np.abs(y) + v + h1)
            left, right = np.searchsorted(xs, x - part * w1 - dx), np.searchsorted(xs, x + part * u + dx, "right")
            top, bottom = np.searchsorted(strips, np.floor((y - part * h1 - dy) / step)), np.searchsorted(strips, np.floor((y + part * v + dy) / step), "right")
            for k, strip in spans(top, bottom):
                base = strip * (len(rows) + 1)
                for m, at in spans(np.searchsorted(key, base + left[k]), np.searchsorted(key, base + right[k])):
                    yield _tested(asked, held, q[k[m]], at, rows, least)


def _columns(boxes: np.ndarray) -> np.ndarray:
    """x1, y1, x2, y2 and area, a row each."""
    with np.errstate(invalid="ignore", over="ignore"):
        return np.vstack([boxes.T, (boxes[:, 2] - boxes[:, 0]) * (boxes[:, 3] - boxes[:, 1])])


def _tested(a: np.ndarray, b: np.ndarray, i: np.ndarray, at: np.ndarray, rows: np.ndarray | None, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, iou) of those of the pairs a[:, i], b[:, at] that overlap enough; j is rows[at]."""
    ow = np.minimum(a[2][i], b[2][at]) - np.maximum(a[0][i], b[0][at])
    oh = np.minimum(a[3][i], b[3][at]) - np.maximum(a[1][i], b[1][at])
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        both = ow * oh
        iou = both / (a[4][i] + b[4][at] - both)
        keep = np.flatnonzero((ow > 0) & (oh > 0) & (iou > 0) & (iou >= least))
    at = at[keep]
    return i[keep], at if rows is None else rows[at], iou[keep]


def _listed(blocks: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    i, j, iou = zip(none, *blocks, strict=True)
    return np.concatenate(i), np.concatenate(j), np.concatenate(iou)


def taken(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Places of the pairs that are taken where each one in order is, unless one of its sides is gone."""
    gone, lost, out = set(), set(), []
    for k, (a, b) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
        if a not in gone and b not in lost:
            gone.add(a)
            lost.add(b)
            out.append(k)
    return np.array(out, np.int64)


def greedy_order(left: np.ndarray, right: np.ndarray, iou: np.ndarray, in_left_order: bool) -> np.ndarray:
    """By IoU, ties by left, then right; or left by left, each one's best first, ties by right."""
    return np.lexsort((right, -iou, left) if in_left_order else (right, left, -iou))


def greedy_pairs(left: np.ndarray, right: np.ndarray, left_ids: np.ndarray, right_ids: np.ndarray, threshold: float, in_left_order: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the boxes that a greedy one-to-one choice joins.

    Those of its pairs that come first are chosen from first, and pairs of
    boxes that are then gone are never listed: by IoU from the highest one
    down, or share by share in the left one's order.
    """
    _, li = np.unique(left_ids, return_inverse=True)
    _, ri = np.unique(right_ids, return_inverse=True)
    gone, lost = np.zeros(len(left), bool), np.zeros(len(right), bool)
    parts = [(0, len(left), threshold)]
    if len(left) * len(right) > FEW:
        if in_left_order:
            cuts = np.linspace(0, len(left), SHARES + 1).astype(int)
            parts = [(lo, hi, threshold) for lo, hi in zip(cuts, cuts[1:], strict=False)]
        else:
            parts = [(0, len(left), least) for least in (*(s for s in STEPS if s > threshold), threshold)]
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for lo, hi, least in parts:
        a, b = np.flatnonzero((li >= lo) & (li < hi) & ~gone[li]), np.flatnonzero(~lost[ri])
        i, j, iou = _by_left(left[a], right[b], least)
        i, j = a[i], b[j]
        order = greedy_order(li[i], ri[j], iou, in_left_order)
        i, j = i[order], j[order]
        k = taken(li[i], ri[j])
        gone[li[i[k]]] = lost[ri[j[k]]] = True
        out.append((i[k], j[k]))
    i, j = zip(*out, strict=True)
    return np.concatenate(i), np.concatenate(j)


def _by_left(left: np.ndarray, right: np.ndarray, least: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs (i, j, iou) of left[i] and right[j]."""
    return _listed(Overlaps(right).meeting(left, least))


def best_pairs(left: np.ndarray, right: np.ndarray, left_ids: np.ndarray, right_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, iou) of an assignment with the largest total of 32-bit IoU.

    Among equal totals, an annotation that may have the left one of its own
    id does so in the first round; that makes results stable where boxes are
    copies of each other. Where ids repeat, all pairs are listed.

    Shortest augmenting paths from the right, with prices: price[i] + value[j]
    >= score of each pair, equal for taken ones; a free one's price or value
    is 0. At first a value is the best score, so most take their best partner
    at once; a box's other partners are only looked up if a path reaches it.
    """
    if len(np.unique(left_ids)) < len(left_ids) or len(np.unique(right_ids)) < len(right_ids):
        i, j, iou = _by_left(left, right)
        take = assign(left_ids[i], right_ids[j], iou.astype(np.float32))
        return i[take], j[take], iou[take]
    index, value = Overlaps(left), np.zeros(len(right), np.float32)
    tight_j, tight_i = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    todo = np.arange(len(right))
    for least in LEVELS:
        found = []
        for j, i, iou in index.meeting(right[todo], least):
            j, score = todo[j], iou.astype(np.float32)
            np.maximum.at(value, j, score)
            keep = score == value[j]
            found.append((j[keep], i[keep], score[keep]))
        j, i, score = _listed(iter(found))
        keep = score == value[j]
        tight_j.append(j[keep])
        tight_i.append(i[keep])
        todo = todo[value[todo] == 0]
        if not len(todo):
            break
    mate_i, mate_j = np.full(len(left), -1), np.full(len(right), -1)
    j, i = np.concatenate(tight_j), np.concatenate(tight_i)
    own = left_ids[i] == right_ids[j]
    for a, b in zip(i[order := np.lexsort((i, j, ~own))].tolist(), j[order].tolist(), strict=True):
        if mate_i[a] < 0 and mate_j[b] < 0:
            mate_i[a], mate_j[b] = b, a
    _augment(index, right, value.astype(np.float64), mate_i, mate_j)
    j = np.flatnonzero(mate_j >= 0)
    return mate_j[j], j, _iou(left[mate_j[j]], right[j])


def _iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = a.T, b.T
    both = (np.minimum(a[2], b[2]) - np.maximum(a[0], b[0])) * (np.minimum(a[3], b[3]) - np.maximum(a[1], b[1]))
    return both / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both)


def _augment(index: Overlaps, right: np.ndarray, value: np.ndarray, mate_i: np.ndarray, mate_j: np.ndarray) -> None:
    """Complete an assignment whose pairs are tight, in place."""
    price, known, held = np.zeros(len(mate_i)), {}, 0
    for root in np.flatnonzero((mate_j < 0) & (value > 0)).tolist():
        dist: dict[int, float] = {}  # left ones reached, and from which right one
        came: dict[int, int] = {}
        done: dict[int, float] = {}
        reached, heap = {root: 0.0}, []
        best, end, j = value[root], ("right", root), root
        while True:
            so_far = reached[j]
            if j not in known:
                if held > KNOWN:
                    known, held = {}, 0
                _, i, iou = _listed(index.meeting(right[j : j + 1]))
                known[j] = i, iou.astype(np.float32).astype(np.float64)
                held += len(i)
            near, score = known[j]
            to = so_far + np.maximum(price[near] + value[j] - score, 0.0)
            some = np.flatnonzero(to < best)
            for i, d in zip(near[some].tolist(), to[some].tolist(), strict=True):
                if d < best and i not in done and d < dist.get(i, np.inf):
                    dist[i], came[i] = d, j
                    if mate_i[i] < 0:  # nothing is shorter that ends here
                        best, end = d, ("left", i)
                    else:
                        heapq.heappush(heap, (d, i))
            while heap and (heap[0][1] in done or heap[0][0] > dist[heap[0][1]]):
                heapq.heappop(heap)
            if not heap or heap[0][0] >= best:
                break
            d, i = heapq.heappop(heap)
            done[i] = d
            j = int(mate_i[i])
            reached[j] = d
            if d + value[j] < best:  # the right one that held i may stay free instead
                best, end = d + value[j], ("right", j)
        for j, d in reached.items():
            if d < best:
                value[j] -= best - d
        for i, d in done.items():
            if d < best:
                price[i] += best - d
        kind, node = end
        if kind == "right":
            if node == root:
                continue
            i = int(mate_j[node])
            mate_j[node] = -1
        else:
            i = node
        while True:
            j = came[i]
            before = int(mate_j[j])
            mate_i[i], mate_j[j] = j, i
            if j == root:
                break
            i = before
