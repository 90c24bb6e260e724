"""Short codes for vectors: every part of a vector is named by its nearest codebook entry, found with metric trees over the parts.

Vectors are made integers and cut into parts; each part position has a codebook that rounds of exact k-means improve. What costs, the search for
every part's nearest entry, goes through metric trees that are built once: tasks take bounded groups of vectors and arrange
each part position as an anchors hierarchy. About sqrt(n) anchors, each the point farthest from all before, take over what is nearer to them
than to its anchor; each anchor's points are parted in the same way, and the anchors' balls are merged upwards, two at a time, into one
(middle-out). A ball keeps its centre, radius, count and sum. Going down from the top, a ball is given the entries that may be nearest for
any of its points, and strikes out those that another beats everywhere within its radius; its children start with what is left. When a single entry is
left the ball is its own as a whole, and its cached sum and count go to that entry unread. In the leaves the few entries left are compared exactly.

Arithmetic is in integers, or in doubles where these hold every value exactly; balls strike entries out with a margin for rounding, so
results are those of comparing everything with everything, ties going to the lower index.

Defined cases: vectors that are NULL, empty, or hold NULL or non-finite components are dropped, as are those whose length is not the commonest one or
not divisible into equal parts; zero vectors stay; NULL ids come last and equal ids go by the vector where the first entries
are chosen; repeated rows count as often as they occur; NULL labels count as one label; components beyond MOST count as that; with
fewer vectors than entries, the codebooks are as much smaller.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass, fields
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import columns_of, null_safe_join, staged

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Largest size of a component, so that squared distances fit a long.
MOST = 2.0**14
#: A group of vectors that trees are built over: its most rows and components. Balls of so few points are not parted further.
GROUP_ROWS, GROUP_VALUES, LEAF_ROWS = 8192, 1 << 20, 32


def _lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", x, x))


def anchors(x: np.ndarray) -> list[np.ndarray]:
    """About sqrt(n) sets of places in `x`, each round an anchor that is no farther from its points than any other anchor is."""
    chosen, owner, away = [0], np.zeros(len(x), np.int64), _lengths(x - x[0])
    for _ in range(1, int(np.sqrt(len(x)))):
        far = int(away.argmax())
        if away[far] == 0:
            break
        # a point nearer to its anchor than half the way from there to the new one stays
        reached = np.flatnonzero(2 * away > _lengths(x[chosen] - x[far])[owner])
        nearer = _lengths(x[reached] - x[far])
        taken = nearer < away[reached]
        owner[reached[taken]], away[reached[taken]] = len(chosen), nearer[taken]
        chosen.append(far)
    return [np.flatnonzero(owner == a) for a in range(len(chosen))]


def merges(centres: np.ndarray, radii: np.ndarray, counts: np.ndarray) -> list[tuple[int, int]]:
    """Pairs to join, always the two whose common ball is smallest; pair number i becomes ball number len(centres) + i."""
    n = len(centres)
    centres, radii, counts = list(centres), list(radii), list(counts)
    live, made = list(range(n)), []

    def joined(a: int, others: list[int]):
        c, r, k = np.array([centres[b] for b in others]), np.array([radii[b] for b in others]), np.array([counts[b] for b in others])
        gap = _lengths(c - centres[a])
        return np.maximum(radii[a] + gap * k / (counts[a] + k), r + gap * counts[a] / (counts[a] + k))

    cost = np.full((n, n), np.inf)
    for i in range(1, n):
        cost[i, :i] = joined(i, live[:i])
    while len(live) > 1:
        i, j = divmod(int(cost.argmin()), len(live))
        a, b, total = live[i], live[j], counts[live[i]] + counts[live[j]]
        made.append((a, b))
        centres.append((centres[a] * counts[a] + centres[b] * counts[b]) / total)
        radii.append(cost[i, j])
        counts.append(total)
        rest = [k for k in range(len(live)) if k not in (i, j)]
        live, kept = [live[k] for k in rest], cost[np.ix_(rest, rest)]
        cost = np.full((len(rest) + 1, len(rest) + 1), np.inf)
        cost[:-1, :-1] = kept
        live.append(len(centres) - 1)
        if rest:
            cost[-1, :-1] = joined(live[-1], live[:-1])
    return made


@dataclass
class MetricTree:
    """Balls over the rows of one part, the top one first; a ball holds rows `order[begin:end]`, a leaf has no children (-1)."""

    order: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    left: np.ndarray
    right: np.ndarray
    radius: np.ndarray
    sums: np.ndarray

    @classmethod
    def over(cls, x: np.ndarray) -> MetricTree:
        """Of integer rows."""
        points, balls = x.astype(float), []  # a ball: (left, right, rows of a leaf)

        def grown(rows: np.ndarray) -> int:
            sets = anchors(points[rows]) if len(rows) > LEAF_ROWS else []
            if len(sets) < 2:
                balls.append((-1, -1, rows))
                return len(balls) - 1
            sets = [rows[s] for s in sets]
            numbers = [grown(s) for s in sets]
            centres = np.array([points[s].mean(0) for s in sets])
            radii = np.array([_lengths(points[s] - c).max() for s, c in zip(sets, centres)])
            for a, b in merges(centres, radii, np.array([len(s) for s in sets])):
                balls.append((numbers[a], numbers[b], None))
                numbers.append(len(balls) - 1)
            return numbers[-1]

        grown(np.arange(len(x)))
        size = len(balls)
        number, order, at = np.zeros(size, np.int32), [], 0
        begin, end, left, right = (np.full(size, -1, np.int32) for _ in range(4))
        stack, seen = [(size - 1, False)], 0
        while stack:  # down the left side first, so that a ball's rows are neighbours
            ball, done = stack.pop()
            if done:
                end[number[ball]] = at
                continue
            number[ball], seen = seen, seen + 1
            begin[number[ball]] = at
            one, two, rows = balls[ball]
            stack.append((ball, True))
            if rows is None:
                stack += [(two, False), (one, False)]
            else:
                order.append(rows)
                at += len(rows)
        for ball, (one, two, rows) in enumerate(balls):
            if rows is None:
                left[number[ball]], right[number[ball]] = number[one], number[two]
        order = np.concatenate(order).astype(np.int32)
        running = np.zeros((len(x) + 1, x.shape[1]), np.int64)
        np.cumsum(x[order], axis=0, out=running[1:])
        sums = running[end] - running[begin]
        radius = np.array([_lengths(points[order[a:b]] - s / (b - a)).max() for a, b, s in zip(begin, end, sums)])
        return cls(order, begin, end, left, right, radius * (1 + 1e-9) + 1e-6, sums)

    def to_bytes(self) -> bytes:
        held = io.BytesIO()
        np.savez(held, **{f.name: getattr(self, f.name) for f in fields(self)})
        return held.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> MetricTree:
        held = np.load(io.BytesIO(data), allow_pickle=False)
        return cls(**{f.name: held[f.name] for f in fields(cls)})

    def owners(self, x: np.ndarray, entries: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """Nearest entries: (balls, the entry that owns each), and (rows in no such ball, the entry of each)."""
        e = entries.astype(float)
        squares = (e * e).sum(1)
        spacing = np.sqrt(np.maximum(squares[:, None] + squares - 2 * e @ e.T, 0)) * (1 + 1e-9) + 1e-6
        counts = (self.end - self.begin)[:, None]
        candidates = np.zeros((1, len(e)), bool)
        candidates[0, np.unique(entries, axis=0, return_index=True)[1]] = True  # of equal entries the first
        opened, owned, rest = np.zeros(1, np.int64), [], []
        while len(opened):
            centre = self.sums[opened] / counts[opened]
            away = (centre * centre).sum(1)[:, None] + squares - 2 * centre @ e.T
            slack = 1e-9 * ((centre * centre).sum(1) + squares.max() + 1)[:, None]
            away[~candidates] = np.inf
            best = away.argmin(1)
            ahead = away - np.take_along_axis(away, best[:, None], 1)
            candidates &= ahead <= 2 * self.radius[opened][:, None] * spacing[best] + slack
            one, leaf = candidates.sum(1) == 1, self.left[opened] < 0
            owned.append((opened[one], best[one]))
            rest += [(ball, np.flatnonzero(c)) for ball, c in zip(opened[leaf & ~one], candidates[leaf & ~one])]
            inner = ~one & ~leaf
            candidates = np.concatenate([candidates[inner], candidates[inner]])
            opened = np.concatenate([self.left[opened[inner]], self.right[opened[inner]]])
        rows, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        exact = _exact(x, entries)
        points, e = x.astype(exact), entries.astype(exact)
        squares = (e * e).sum(1)
        for ball, few in rest:
            at = self.order[self.begin[ball] : self.end[ball]]
            # the point's own square is the same for every entry
            rows.append(at)
            found.append(few[(squares[few] - 2 * (points[at] @ e[few].T)).argmin(1)])
        return tuple(np.concatenate(c) for c in zip(*owned)), (np.concatenate(rows), np.concatenate(found))

    def totals(self, x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum and count of the rows nearest to each entry."""
        (balls, by_ball), (rows, by_row) = self.owners(x, entries)
        sums, counts = np.zeros(entries.shape, np.int64), np.zeros(len(entries), np.int64)
        np.add.at(sums, by_ball, self.sums[balls])
        np.add.at(counts, by_ball, (self.end - self.begin)[balls])
        np.add.at(sums, by_row, x[rows])
        np.add.at(counts, by_row, 1)
        return sums, counts

    def nearest(self, x: np.ndarray, entries: np.ndarray) -> np.ndarray:
        """The nearest entry of each row."""
        (balls, by_ball), (rows, by_row) = self.owners(x, entries)
        found = np.zeros(len(x), np.int64)
        for ball, entry in zip(balls, by_ball):
            found[self.order[self.begin[ball] : self.end[ball]]] = entry
        found[rows] = by_row
        return found


def _exact(x: np.ndarray, entries: np.ndarray) -> type:
    """A type in which squared distances are exact: doubles, or if they are too large 64-bit integers."""
    peak = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    return np.float64 if 4 * x.shape[1] * peak * peak < 2**53 else np.int64


def integer_vectors(table: DataFrame, name: str, vector: str, label: str, parts: int = PARTS) -> DataFrame:
    """`id`, `label`, `v`: the integer components of the vectors that take part."""
    slim = columns_of(table, name, vector, label)
    slim = slim.toDF("id", "v", "label").select(F.col("id").cast("long").alias("id"), "label", F.col("v").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    fine = slim.where(F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)) & (F.size("v") > 0) & (F.size("v") % parts == 0))
    common = fine.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    bounded = F.transform("v", lambda c: F.floor(F.greatest(F.least(c, F.lit(MOST)), F.lit(-MOST)) * SCALE).cast("int"))
    return fine.where(F.size("v") == (common["n"] if common else 0)).select("id", "label", bounded.alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(len(column), -1)


def forest(vectors: DataFrame, parts: int = PARTS) -> DataFrame:
    """Groups of vectors as rows: `ids`, `labels`, their components as one binary value, and a tree for each part position."""
    kind = vectors.schema["label"].dataType.simpleString()

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v")) if batch.num_rows else np.zeros((0, 1))
            size = max(LEAF_ROWS, min(GROUP_ROWS, GROUP_VALUES // max(x.shape[1], 1)))
            for at in range(0, batch.num_rows, size):
                group, rows = x[at : at + size], batch.slice(at, size)
                trees = [MetricTree.over(part).to_bytes() for part in np.split(group, parts, axis=1)]
                lists = [pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), rows.column(c)) for c in ("id", "label")]
                columns = [*lists, pa.array([group.tobytes()], pa.binary()), pa.array([trees], pa.list_(pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, ["ids", "labels", "v", "trees"])

    return staged(vectors.mapInArrow(plant, f"ids array<long>, labels array<{kind}>, v binary, trees array<binary>"))


def _groups(batches: Iterator[pa.RecordBatch], parts: int):
    """Of each stored group its row, its parts and their trees."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            x = np.frombuffer(row.column("v")[0].as_py(), np.int32).reshape(len(row.column("ids")[0]), -1)
            trees = [MetricTree.from_bytes(t.as_py()) for t in row.column("trees")[0]]
            yield row, np.split(x.astype(np.int64), parts, axis=1), trees


def improved(groups: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks (part, entry, place) after one round: every entry the floored mean of the parts nearest to it."""
    parts, entries, width = books.shape

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for _, pieces, trees in _groups(batches, parts):
            for p, (x, tree) in enumerate(zip(pieces, trees)):
                s, c = tree.totals(x, books[p])
                sums[p] += s
                counts[p] += c
        part, entry = np.nonzero(counts)
        columns = [part, entry, counts[part, entry], *sums[part, entry].T]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    names = ["part", "entry", "n", *[f"s{i}" for i in range(width)]]
    made = groups.select("ids", "v", "trees").mapInArrow(scan, ", ".join(f"{c} long" for c in names))
    better = books.copy()
    for row in made.groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in names[2:]]).collect():  # at most a row for each entry
        better[row["part"], row["entry"]] = [row[f"s{i}"] // row["n"] for i in range(width)]
    return better


def coded(groups: DataFrame, books: np.ndarray) -> DataFrame:
    """`id`, `label`, `code`, `error`: each vector's entries as hex digits, and its squared distance to them."""
    kind = groups.schema["labels"].dataType.elementType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, pieces, trees in _groups(batches, len(books)):
            digits, error = [], np.zeros(len(pieces[0]), np.int64)
            for x, tree, book in zip(pieces, trees, books):
                found = tree.nearest(x, book)
                error += ((x - book[found]) ** 2).sum(1)
                digits.append(found.astype(np.uint8))
            text = np.column_stack(digits).tobytes().hex()
            step = 2 * len(books)
            codes = pa.array([text[i : i + step] for i in range(0, len(text), step)], pa.string())
            yield pa.RecordBatch.from_arrays([row.column("ids").flatten(), row.column("labels").flatten(), codes, pa.array(error)], ["id", "label", "code", "error"])

    return groups.mapInArrow(scan, f"id long, label {kind}, code string, error long")


def books_digest(books: np.ndarray) -> str:
    return sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(
    table: DataFrame, name: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
) -> tuple[DataFrame, np.ndarray]:
    """`id`, `label`, `code`, `error`, `label_error` of the vectors that take part, and the codebooks (part, entry, place)."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits: up to 256 entries")
    vectors = integer_vectors(table, name, vector, label, parts)
    first = vectors.orderBy(F.col("id").isNull(), "id", "v").limit(entries).collect()
    if not first:
        return vectors.select("id", "label", F.lit("").alias("code"), *[F.lit(0).cast("long").alias(c) for c in ("error", "label_error")]), np.zeros((parts, 0, 0), np.int64)
    start = np.array([r["v"] for r in first], np.int64)
    books = np.stack(np.split(start, parts, axis=1))
    groups = forest(vectors, parts)
    for _ in range(rounds):
        books = improved(groups, books)
    made = staged(coded(groups, books))
    by_label = staged(made.groupBy("label").agg(F.sum("error").alias("label_error")))
    return null_safe_join(made, by_label, ["label"]).select("id", "label", "code", "error", "label_error"), books
