"""Quality rules: fixed bounds on what a text looks like, and a regression over hashed word and character n-grams.

N-grams of one and two words and of three and four characters are hashed into bins, a block of bins for each kind. A text's features are the
shares of each block's n-grams that fall into each bin, so its length does not matter, and its margin is a sum of bin
weights over all its n-grams: texts are scored in Arrow batches without making features of them.

The weights are those of a logistic regression on labelled rows. Features of a bounded sample of these are written once; each step of the
optimisation (L-BFGS) is a pass of the tasks over them that gives loss and gradient. Part of the sample is left out of this, and its margins
give the probability: a logistic curve over the margin (Platt's scaling).

Defined cases: a NULL text counts as empty; an empty text has the margin of no n-grams and fails the rules for want of words; labels that are NULL
teach nothing; of several labels of a document the majority counts, 1 in a tie; labels of documents that are not there are
ignored; with no labels, or labels of one kind only, the probability is the share of label 1 (1 without any).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm import arrays
from logloom.llm.arrays import U64
from logloom.llm.common import columns_of, staged
from logloom.llm.quality import held_out

#: Most labelled documents that are learnt from, the tasks that hold their features, and one in how many is for the calibration.
FIT_ROWS, FIT_TASKS, CALIBRATION_PART = 8_000, 12, 5
BLOCK_BITS, WORD_GRAMS, CHARACTER_GRAMS = 14, (1, 2), (3, 4)
BINS = (len(WORD_GRAMS) + len(CHARACTER_GRAMS)) << BLOCK_BITS
STEPS, PENALTY = 30, 1e-4
#: The fixed thresholds: fewest words, largest share of repeated words in per cent, least probability of label 1.
LEAST_WORDS, MOST_REPEATED, LEAST_PROBABILITY = 50, 50, 0.5
#: Characters whose n-grams are made at a time.
SLICE = 1 << 20
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _table(characters: bytes) -> np.ndarray:
    made = np.zeros(256, bool)
    made[list(characters)] = True
    return made


SYMBOLS = _table(b"#*$%&|<>")
LEAD = (np.arange(256) & 0xC0) != 0x80


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set from each offset to the next."""
    places = np.flatnonzero(flags)
    return np.diff(np.searchsorted(places, offsets))


def _counts(rows: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order in which equal (row, key) pairs are neighbours, where each run of them begins in it, and how long it is."""
    order = np.lexsort((keys, rows))
    if not len(order):
        return order, order, order
    r, k = rows[order], keys[order]
    begin = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (k[1:] != k[:-1])]))
    return order, begin, np.diff(np.append(begin, len(order)))


def _triples(h: np.ndarray) -> np.ndarray:
    return arrays.mixed(arrays.mixed(h[:-2] + U64(1)) + U64(3) * h[1:-1] + U64(5) * arrays.mixed(h[2:]))


class Texts:
    """The words of a group of texts and what is counted of them."""

    def __init__(self, column: pa.Array):
        self.data, self.offsets = arrays.flat(column)
        self.n = len(column)
        self.starts, self.ends, self.first = arrays.word_ranges(self.data, self.offsets)
        self.words = arrays.word_symbols(self.data, self.starts, self.ends)
        self.rows = np.repeat(np.arange(self.n), np.diff(self.first))

    def measures(self) -> list[np.ndarray]:
        """One array for each of MEASURES."""
        n_words = np.diff(self.first)
        characters = _per_row(LEAD[self.data], self.offsets) - _per_row(arrays.SPACE[self.data], self.offsets)
        return [n_words, characters, _per_row(SYMBOLS[self.data], self.offsets), self._repeated_lines(), self._repeated_words()]

    def _repeated_lines(self) -> np.ndarray:
        breaks = np.flatnonzero(self.data == 10)
        starts = np.unique(np.concatenate([self.offsets[:-1], breaks + 1]))
        starts = starts[starts < len(self.data)]
        ends = np.append(starts[1:], len(self.data))
        filled = np.searchsorted(self.starts, ends) > np.searchsorted(self.starts, starts)
        starts, ends = starts[filled], ends[filled]
        ends = ends - (self.data[ends - 1] == 10)
        rows = np.searchsorted(self.offsets, starts, "right") - 1
        order, begin, _ = _counts(rows, arrays.word_symbols(self.data, starts, ends))
        return np.bincount(rows, minlength=self.n) - np.bincount(rows[order[begin]], minlength=self.n)

    def _repeated_words(self) -> np.ndarray:
        inside = np.flatnonzero(self.rows[2:] == self.rows[:-2])
        order, _, lengths = _counts(self.rows[inside], _triples(self.words)[inside])
        again = inside[order[np.repeat(lengths, lengths) > 1]]
        covered = np.zeros(len(self.words), bool)
        for step in range(3):
            covered[again + step] = True
        return np.bincount(self.rows[covered], minlength=self.n)

    def grams(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(block, rows, bins) of all n-grams, a bounded number of characters at a time."""
        for block, n in enumerate(WORD_GRAMS):
            count = max(len(self.words) - n + 1, 0)
            h = self.words[:count]
            for step in range(1, n):
                h = arrays.mixed(h * U64(3) + self.words[step : step + count])
            inside = self.rows[:count] == self.rows[n - 1 :]
            yield block, self.rows[:count][inside], _bins(block, h[inside])
        leads = np.flatnonzero(LEAD[self.data])
        longest = max(CHARACTER_GRAMS)
        for at in range(0, len(leads), SLICE):
            some = leads[at : at + SLICE + longest]
            stop = leads[at + SLICE + longest] if at + SLICE + longest < len(leads) else len(self.data)
            places = np.append(some, stop)
            hashes = arrays.Ranges(arrays.BYTE_SYMBOLS[0][self.data[places[0] : stop]])
            rows = np.searchsorted(self.offsets, some, "right") - 1
            for block, n in enumerate(CHARACTER_GRAMS, len(WORD_GRAMS)):
                count = max(min(SLICE, len(some) - n + 1), 0)
                inside = np.flatnonzero(rows[:count] == rows[n - 1 : n - 1 + count])
                h = hashes.of(places[inside] - places[0], places[inside + n] - places[0])
                yield block, rows[inside], _bins(block, h)

    def margins(self, weights: np.ndarray, bias: float) -> np.ndarray:
        sums, totals = (np.zeros((BINS >> BLOCK_BITS, self.n)) for _ in range(2))
        for block, rows, bins in self.grams():
            sums[block] += np.bincount(rows, weights[bins], self.n)
            totals[block] += np.bincount(rows, minlength=self.n)
        return bias + (sums / np.maximum(totals, 1)).sum(0)

    def features(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, bins and shares of all filled bins, by row and bin."""
        keys, values, totals = [], [], np.zeros((BINS >> BLOCK_BITS, self.n))
        for block, rows, bins in self.grams():
            key, count = np.unique(rows.astype(np.int64) * BINS + bins, return_counts=True)
            keys.append(key)
            values.append(count)
            totals[block] += np.bincount(rows, minlength=self.n)
        key, at = np.unique(np.concatenate(keys), return_inverse=True)
        count = np.bincount(at, np.concatenate(values), len(key))
        rows, bins = key // BINS, key % BINS
        return rows, bins, count / totals[bins >> BLOCK_BITS, rows]


def _bins(block: int, h: np.ndarray) -> np.ndarray:
    return (h >> U64(64 - BLOCK_BITS)).astype(np.int64) + (block << BLOCK_BITS)


@dataclass
class Regression:
    """Bin weights, bias, and the calibrated curve: probability = 1 / (1 + exp(-(slope * margin + shift)))."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, margins: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * margins + self.shift)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return np.exp(-np.logaddexp(0, -z))


def constant(probability: float) -> Regression:
    held = min(max(probability, 1e-9), 1 - 1e-9)
    return Regression(np.zeros(BINS), 0.0, 0.0, 60.0 if probability == 1 else float(np.log(held / (1 - held))))


def calibrated(margins: np.ndarray, labels: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of Platt's scaling, by Newton's method; targets are smoothed by the number of each label."""
    ones = labels.sum()
    aims = np.where(labels > 0, (ones + 1) / (ones + 2), 1 / (len(labels) - ones + 2))
    x, at = np.column_stack([margins, np.ones(len(margins))]), np.zeros(2)

    def loss(a):
        z = x @ a
        return np.sum(np.logaddexp(0, z) - aims * z) + 1e-6 * a @ a

    for _ in range(rounds):
        p = _sigmoid(x @ at)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - aims) + 2e-6 * at)
        size = 1.0
        while loss(at - size * step) > loss(at) and size > 1e-6:
            size /= 2
        at = at - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return max(float(at[0]), 0.0), float(at[1])


def minimum(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int = STEPS, memory: int = 8) -> np.ndarray:
    """Where a smooth convex function is least, by L-BFGS; `f` gives value and gradient."""
    value, slope = f(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        way, kept = -slope, []
        for s, y in reversed(past):
            kept.append((s @ way) / (s @ y))
            way = way - kept[-1] * y
        if past:
            way = way * (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1])
        for (s, y), a in zip(past, reversed(kept)):
            way = way + (a - (y @ way) / (s @ y)) * s
        size = 1.0 if past else 1 / max(float(np.abs(slope).sum()), 1e-12)
        for _ in range(12):
            there, steep = f(x + size * way)
            if there <= value + 1e-4 * size * (slope @ way):
                break
            size /= 2
        else:
            break
        s, y = size * way, steep - slope
        if s @ y > 1e-12:
            past = [*past, (s, y)][-memory:]
        done = value - there < 1e-6 * max(value, 1e-12)
        x, value, slope = x + s, there, steep
        if done:
            break
    return x


def _sample(docs: DataFrame, labels: DataFrame, fit_rows: int) -> DataFrame:
    """`label`, `fold`, and the features (`bins`, `shares`) of the labelled documents with the least hashed doc_ids, written once."""
    named = columns_of(labels, "doc_id", "quality").where("quality IS NOT NULL AND doc_id IS NOT NULL")
    marks = named.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("label")).where(~held_out(F.col("doc_id")))
    there = marks.join(docs.select("doc_id"), "doc_id", "left_semi").withColumn("order", F.xxhash64("doc_id"))
    chosen = staged(there.orderBy("order", "doc_id").limit(fit_rows).select("doc_id", "label", F.pmod("order", F.lit(CALIBRATION_PART)).cast("int").alias("fold")))
    texts = docs.join(chosen, "doc_id").select("label", "fold", "text").repartition(FIT_TASKS)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrays.groups(batches, "text"):
            rows, bins, shares = Texts(part.column("text")).features()
            ends = pa.array(np.searchsorted(rows, np.arange(part.num_rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(v.astype(t))) for v, t in ((bins, np.int32), (shares, np.float32))]
            yield pa.RecordBatch.from_arrays([part.column("label"), part.column("fold"), *lists], ["label", "fold", "bins", "shares"])

    return staged(texts.mapInArrow(scan, "label double, fold int, bins array<int>, shares array<float>"))


def _sums(sample: DataFrame, part: Callable[..., np.ndarray]) -> np.ndarray:
    """What `part(labels, rows, bins, shares)` gives, summed over all batches: a vector from each of the FIT_TASKS tasks."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in batches:
            bins, shares = batch.column("bins"), batch.column("shares")
            rows = np.repeat(np.arange(batch.num_rows), bins.value_lengths().to_numpy())
            values = shares.flatten().to_numpy().astype(float)
            total = total + part(batch.column("label").to_numpy(), rows, bins.flatten().to_numpy(), values)
        yield pa.RecordBatch.from_arrays([pa.array([np.asarray(total, float).tobytes()], pa.binary())], ["total"])

    made = [np.frombuffer(r["total"]) for r in sample.select("label", "bins", "shares").coalesce(FIT_TASKS).mapInArrow(scan, "total binary").collect()]
    whole = [m for m in made if len(m) > 1]
    return np.sum(whole, axis=0) if whole else np.zeros(1)


def _raw_margins(weights: np.ndarray, labels, rows, bins, shares) -> np.ndarray:
    return np.bincount(rows, weights[bins] * shares, len(labels))


def learn(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, steps: int = STEPS, penalty: float = PENALTY) -> Regression:
    """The regression from documents (`doc_id`, `text`) and their labels (`doc_id`, `quality`), of rows that are not held out."""
    sample = _sample(docs, labels, fit_rows)
    counts = {(r["label"], r["calibrates"]): r["count"] for r in sample.groupBy("label", F.expr("fold = 0").alias("calibrates")).count().collect()}
    n, ones = sum(counts.values()), sum(c for (label, _), c in counts.items() if label > 0)
    if not n or ones in (0, n):
        return constant(ones / n if n else 1.0)
    taught = sample.where("fold > 0") if all((y, False) in counts for y in (0.0, 1.0)) else sample
    n = sum(c for (_, apart), c in counts.items() if not apart) if taught is not sample else n

    def squares(y, rows, bins, shares):
        return np.bincount(bins, shares * shares, BINS)

    # bins are weighed as if each had the same mean square; hardly filled ones stay small
    spread = np.sqrt(_sums(taught, squares) / n) + 1e-4

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        weights, bias = x[:-1] / spread, x[-1]

        def part(y, rows, bins, shares):
            z = _raw_margins(weights, y, rows, bins, shares) + bias
            p = _sigmoid(z)
            return np.concatenate([np.bincount(bins, (p - y)[rows] * shares, BINS), [(p - y).sum(), (np.logaddexp(0, z) - y * z).sum()]])

        total = _sums(taught, part) / n
        slope = np.append(total[:BINS] / spread, total[BINS])
        slope[:-1] += penalty * x[:-1]
        return total[-1] + penalty / 2 * float(x[:-1] @ x[:-1]), slope

    found = minimum(loss, np.zeros(BINS + 1), steps)
    weights, bias = found[:-1] / spread, float(found[-1])
    apart = sample.where("fold = 0") if all((y, True) in counts for y in (0.0, 1.0)) else sample

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.repeat(np.arange(batch.num_rows), batch.column("bins").value_lengths().to_numpy())
            margins = _raw_margins(weights, rows=rows, labels=batch.column("label"), bins=batch.column("bins").flatten().to_numpy(), shares=batch.column("shares").flatten().to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(margins + bias), batch.column("label")], ["margin", "label"])

    pairs = apart.select("label", "bins", "shares").mapInArrow(scan, "margin double, label double").toPandas()  # at most fit_rows rows
    slope, shift = calibrated(pairs["margin"].to_numpy(), pairs["label"].to_numpy())
    return Regression(weights, bias, slope, shift)


def judge(docs: DataFrame, labels: DataFrame, least_probability: float = LEAST_PROBABILITY, fit_rows: int = FIT_ROWS) -> DataFrame:
    """`doc_id`, each of MEASURES, `probability`, `base_failed` and `kept` for every row of `docs`."""
    slim = columns_of(docs, "doc_id", "text")
    model = learn(slim, labels, fit_rows)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrays.groups(batches, "text"):
            texts = Texts(part.column("text"))
            made = [pa.array(m, pa.int64()) for m in texts.measures()]
            scores = pa.array(model.probability(texts.margins(model.weights, model.bias)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *made, scores], ["doc_id", *MEASURES, "probability"])

    kind = slim.schema["doc_id"].dataType.simpleString()
    measured = slim.mapInArrow(scan, f"doc_id {kind}, " + ", ".join(f"{m} long" for m in MEASURES) + ", probability double")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    passed = F.col("probability") >= least_probability
    return measured.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & passed)
