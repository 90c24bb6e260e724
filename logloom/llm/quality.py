"""A quality classifier for documents: an additive model over shape features of the whole text.

Learnt from labelled documents whose crc32(doc_id) mod 4 is not 2; the others are held out. Features come from the text alone.
Defined cases: a NULL text counts as empty, and an empty text is scored by its (zero) features; labels that are NULL teach
nothing; of several labels of a document the majority counts, 1 in a tie; without any label every score is 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm import arrays
from logloom.llm.additive import AdditiveModel, fit
from logloom.llm.arrays import U64
from logloom.llm.common import columns_of, staged

#: Most rows that a model is learnt from; the driver holds their features.
FIT_ROWS = 40_000
THRESHOLD = 0.7
FEATURES = (
    "log_words", "word_length", "longest_word", "letter_share", "upper_share", "digit_share", "mark_share", "wide_share",
    "bare_words", "marked_words", "capital_words", "same_as_before", "repeated_words", "commonest_word", "repeated_triples",
    "line_words",
)


def _classes(*ranges) -> np.ndarray:
    made = np.zeros(256, bool)
    for a, b in ranges:
        made[a : b + 1] = True
    return made


UPPER, DIGIT, WIDE = _classes((65, 90)), _classes((48, 57)), _classes((128, 255))
LETTER = _classes((65, 90), (97, 122), (128, 255))
MARK = _classes((33, 47), (58, 64), (91, 96), (123, 126))
LEAD = _classes((0, 127), (192, 255))


def _packed(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return first.astype(U64) | (second.astype(U64) << U64(32))


# Two counters to a word, so that one running sum counts two classes.
COUNTED = [_packed(UPPER, DIGIT), _packed(LETTER, MARK), _packed(WIDE, _classes((10, 10)))]


def _repeats(keys: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """By row, how many values came before in the row, and how often its commonest value occurs."""
    if not len(keys):
        return np.zeros(n), np.zeros(n)
    ordered = np.sort((rows.astype(U64) << U64(40)) | (keys >> U64(24)))
    begin = arrays.runs(ordered)
    lengths = np.diff(np.append(begin, len(ordered)))
    of = (ordered[begin] >> U64(40)).astype(np.int64)
    edges = arrays.runs(of)
    most = np.zeros(n)
    most[of[edges]] = np.maximum.reduceat(lengths, edges)
    return np.bincount(of, lengths - 1, n), most


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text."""
    data, offsets = arrays.flat(texts)
    n, size = len(texts), np.diff(offsets)
    starts, ends, first = arrays.word_ranges(data, offsets)
    count = np.diff(first)
    rows = np.repeat(np.arange(n), count)
    sums = []
    for table in COUNTED:
        running = np.zeros(len(data) + 1, U64)
        np.cumsum(table[data], out=running[1:])
        sums.append(running)
    (upper, digit), (letter, mark), (wide, line) = [
        ((d := s[offsets[1:]] - s[offsets[:-1]]) & U64(0xFFFFFFFF), d >> U64(32)) for s in sums
    ]
    in_word = sums[1][ends] - sums[1][starts]
    letters, marks = in_word & U64(0xFFFFFFFF), in_word >> U64(32)
    h = arrays.word_symbols(data, starts, ends)
    twice = np.zeros(len(h), bool)
    twice[1:] = (h[1:] == h[:-1]) & (rows[1:] == rows[:-1])
    again, most = _repeats(h, rows, n)
    triples = arrays.mixed(h[:-2] + U64(3) * h[1:-1] + U64(5) * h[2:])
    inside = rows[2:] == rows[:-2]
    again3, _ = _repeats(triples[inside], rows[:-2][inside], n)
    lengths = (ends - starts).astype(float)
    longest = np.zeros(n)
    filled = count > 0
    if len(h):
        longest[filled] = np.maximum.reduceat(lengths, first[:-1][filled])
    words, chars = np.maximum(count, 1), np.maximum(size, 1)

    def of_words(mask):
        return np.bincount(rows, mask, n) / words

    return np.column_stack([
        np.log1p(count), np.bincount(rows, lengths, n) / words, np.log1p(longest), letter / chars,
        upper / np.maximum(letter, U64(1)), digit / chars, mark / chars, wide / chars,
        of_words(letters == 0), of_words(marks > 1), of_words(UPPER[data[starts]]), of_words(twice),
        again / words, most / words, again3 / np.maximum(count - 2, 1), np.minimum(count / (line.astype(float) + 1), 1000),
    ]).astype(float)


def _scan(keep: list[str], make) -> callable:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrays.groups(batches, "text"):
            made = make(features(part.column("text")))
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], *made.values()], [*keep, *made])

    return scan


def document_features(docs: DataFrame) -> DataFrame:
    """`doc_id` and a double for each of FEATURES."""
    made = _scan(["doc_id"], lambda x: {name: pa.array(x[:, j]) for j, name in enumerate(FEATURES)})
    schema = ", ".join(["doc_id long", *[f"{name} double" for name in FEATURES]])
    return columns_of(docs, "doc_id", "text").mapInArrow(made, schema)


def held_out(doc_id) -> F.Column:
    """Whether a document is kept out of learning."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(measured: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> AdditiveModel:
    """A model from measured documents and their labels `doc_id`, `quality`.

    At most `fit_rows` labelled documents are used, those whose hashed doc_id is least: a bounded random sample.
    """
    named = columns_of(labels, "doc_id", "quality").where("quality IS NOT NULL AND doc_id IS NOT NULL")
    marks = named.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("label"))
    known = marks.where(~held_out(F.col("doc_id"))).join(measured, "doc_id")
    sample = known.withColumn("order", F.xxhash64("doc_id")).orderBy("order", "doc_id").limit(fit_rows).toPandas()
    return fit(sample[list(FEATURES)].to_numpy(float), sample["label"].to_numpy(float))


def scores(measured: DataFrame, model: AdditiveModel) -> DataFrame:
    """`doc_id` and `score` from measured documents."""

    def scan(batches):
        for batch in batches:
            x = np.column_stack([batch.column(name).to_numpy(zero_copy_only=False) for name in FEATURES])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x))], ["doc_id", "score"])

    return measured.mapInArrow(scan, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS) -> DataFrame:
    """`doc_id`, `held_out`, `score` (0 to 1, higher for label 1), `predicted` for every row of `docs`."""
    measured = staged(document_features(docs))
    found = scores(measured, learn(measured, labels, fit_rows))
    return found.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The documents that score at least the threshold, with doc_id, text, lang, source and n_chars; others go.

    Texts are scored as they pass through; only the labelled documents' features are gathered beforehand.
    """
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    slim = columns_of(docs, *names)
    known = columns_of(labels, "doc_id").where("doc_id IS NOT NULL").distinct()
    model = learn(staged(document_features(slim)).join(known, "doc_id", "left_semi"), labels, fit_rows)
    scan = _scan(names, lambda x: {"score": pa.array(model.score(x))})
    passed = slim.mapInArrow(scan, slim.select(*names, F.lit(0.0).alias("score")).schema)
    return passed.where(F.col("score") >= threshold).select(*names)
