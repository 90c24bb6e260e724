"""What finding repeated stretches of words and of bytes has in common.

Every window of a sequence has an anchor, a short stretch in it that is chosen by content alone, so equal windows have equal
anchors at equal distances. Anchors are some twenty to eighty times fewer than windows, and a window can only repeat if its
anchor does.

The anchors are counted in a count-min sketch: tasks count the cells that they meet, the counts of all tasks are added,
and a cell's sum is never less than the number of times that any one of its anchors occurs. The sketch is a table with a row
for each cell that is met; it has a single row of 2^CELL_BITS cells, so wide that more rows would tell no more. Only windows
whose anchor is estimated to repeat are looked at again, and exactly; none that repeats is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm import arrays
from logloom.llm.arrays import U64
from logloom.llm.common import columns_of, staged

CELL_BITS = 56
LAST = 2**63 - 1
KEY = ["key_id", "row"]


def keyed(docs: DataFrame) -> DataFrame:
    """`doc_id`, `text` and what names a row: `key_id` (a NULL doc_id comes last) and `row`, a hash of the text."""
    slim = columns_of(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    return slim.select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("key_id"), F.xxhash64(F.lit(1), "text").alias("row"), "text")


def cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> U64(64 - CELL_BITS)).astype(np.int64)


def anchor_batch(part: pa.RecordBatch, rows: np.ndarray, hashes: np.ndarray) -> pa.RecordBatch:
    """The cells of anchors found in rows of a batch."""
    at = pa.array(rows)
    return pa.RecordBatch.from_arrays([part.column("key_id").take(at), part.column("row").take(at), pa.array(cells(hashes))], [*KEY, "cell"])


ANCHORS = "key_id long, row long, cell long"


def suspected(anchor_rows: DataFrame) -> DataFrame:
    """`key_id`, `row` and the array `cells` of those of its anchors that are estimated to occur at least twice."""
    kept = staged(anchor_rows)
    sketch = kept.groupBy("cell").agg(F.count("*").alias("estimate"))
    repeated = sketch.where("estimate > 1").select("cell")
    return kept.join(repeated, "cell").groupBy(*KEY).agg(F.collect_set("cell").alias("cells"))


def is_suspected(part: pa.RecordBatch, rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which anchors, given by row of the batch and hash, are among the row's `cells`."""
    lists = part.column("cells")
    of = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    name = lambda row, cell: arrays.mixed(cell.astype(U64) ^ arrays.mixed(row.astype(U64)))
    known = np.unique(name(of, lists.flatten().to_numpy()))
    asked = name(rows, cells(hashes))
    at = np.minimum(np.searchsorted(known, asked), max(len(known) - 1, 0))
    return known[at] == asked if len(known) else np.zeros(len(asked), bool)


SPANS = "key_id long, row long, spans binary"
BUCKETS = "bucket long, payload binary"
SPAN = np.dtype([("key_id", "<i8"), ("row", "<i8"), ("start", "<i8"), ("end", "<i8")])


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def joined(spans: np.ndarray) -> np.ndarray:
    """Ranges of documents (SPAN) as maximal ranges, in order of document."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans["start"], spans["row"], spans["key_id"]))]
    new = np.concatenate([[True], (spans["key_id"][1:] != spans["key_id"][:-1]) | (spans["row"][1:] != spans["row"][:-1])])
    # one document after another on one long axis, so that all are joined in one go
    owner, edge, reach = np.cumsum(new) - 1, np.flatnonzero(new), int(spans["end"].max()) + 1
    a, b = arrays.spans_of(spans["start"] + owner * reach, spans["end"] + owner * reach)
    owner = a // reach
    made = spans[edge[owner]]
    made["start"], made["end"] = a % reach, b - owner * reach
    return made


def bucketed(keys: np.ndarray, rows: np.ndarray, starts: np.ndarray, ends: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Ranges of documents, one row for each bucket of documents."""
    spans = np.empty(len(keys), SPAN)
    spans["key_id"], spans["row"], spans["start"], spans["end"] = keys, rows, starts, ends
    spans = joined(spans)
    of = (arrays.mixed(spans["key_id"].astype(U64)) % U64(buckets)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    edge = arrays.runs(of[order])
    return pa.RecordBatch.from_arrays([pa.array(of[order][edge]), arrays.binaries(spans[order], np.append(edge, len(spans)))], ["bucket", "payload"])


def by_document(buckets: DataFrame) -> DataFrame:
    """The ranges of each document in one binary value, from `bucketed` rows of all tasks."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = joined(np.frombuffer(b"".join(x for batch in batches for x in batch.column("payload").to_pylist()), SPAN))
        edge = np.union1d(arrays.runs(spans["key_id"]), arrays.runs(spans["row"]))
        pairs = np.stack([spans["start"], spans["end"]], axis=1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(spans["key_id"][edge]), pa.array(spans["row"][edge]), arrays.binaries(pairs, 2 * np.append(edge, len(spans)))], [*KEY, "spans"],
        )

    return buckets.repartition("bucket").mapInArrow(merge, SPANS)


def with_spans(base: DataFrame, spans: DataFrame) -> DataFrame:
    """Every document with its `spans`, if any."""
    return base.join(spans, KEY, "left").select(*base.columns, "spans")


def read_spans(value: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the ranges of a document."""
    pairs = np.frombuffer(value or b"", "<i8").reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]
