"""Removal of passages that already stand in an earlier document, by a count-min prefilter over word windows.

A window is WINDOW consecutive words of a document. A word goes if a window that covers it also starts in a document with a smaller
doc_id; windows are judged on the input. Windows whose anchor repeats (see `repeats`) are grouped exactly, by 128 bits of hash:
first within a group of documents, which settles all but the earliest there, then over all groups, dealt out by hash. A
passage that a third of all documents share thus arrives once from each group of documents.

Defined cases: a NULL or wordless text has no words and an empty result; a NULL doc_id comes after all others; rows that are
repeated whole have the same doc_id, so they don't take from each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from logloom.llm import arrays, repeats
from logloom.llm.arrays import U64, Ranges

WINDOW, GRAM = 50, 20
#: Slices of windows for each shuffle partition.
SLICES = 4
ENTRY = np.dtype([("h1", "<u8"), ("h2", "<u8"), ("key_id", "<i8"), ("row", "<i8"), ("start", "<i8")])


class _Words:
    """The words of a batch of documents as symbols."""

    def __init__(self, part: pa.RecordBatch):
        self.data, self.offsets = arrays.flat(part.column("text"))
        self.starts, self.ends, self.first = arrays.word_ranges(self.data, self.offsets)
        counts = np.diff(self.first)
        self.rows = np.repeat(np.arange(len(counts)), counts)
        self.row_ends = np.repeat(self.first[1:], counts)

    def ranges(self, lane: int) -> Ranges:
        return Ranges(arrays.word_symbols(self.data, self.starts, self.ends, lane), lane)


def _anchors(window: int, gram: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrays.groups(batches, "text"):
            words = _Words(part)
            _, places, hashes = arrays.anchors(words.ranges(0), window, gram, words.row_ends)
            new = arrays.runs(places)
            rows, hashes = words.rows[places[new]], hashes[new]
            # once for each document: a passage that only repeats within one is no concern here
            order = np.lexsort((hashes, rows))
            rows, hashes = rows[order], hashes[order]
            new = np.union1d(arrays.runs(rows), arrays.runs(hashes))
            yield repeats.anchor_batch(part, rows[new], hashes[new])

    return scan


def _taken(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries in order of window, and which of them have an equal window in a document with a smaller key."""
    entries = entries[np.lexsort((entries["key_id"], entries["h2"], entries["h1"]))]
    if not len(entries):
        return entries, np.zeros(0, bool)
    h1, h2 = entries["h1"], entries["h2"]
    edge = np.flatnonzero(np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]))
    least = np.repeat(entries["key_id"][edge], np.diff(np.append(edge, len(entries))))
    return entries, entries["key_id"] > least


def _spans(entries: np.ndarray, window: int, buckets: int) -> pa.RecordBatch:
    return repeats.bucketed(entries["key_id"], entries["row"], entries["start"], entries["start"] + window, buckets)


def _windows(window: int, gram: int, slices: int, buckets: int):
    """From suspected documents: spans that are settled here, by bucket, and by slice the windows that are not."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrays.groups(batches, "text"):
            words = _Words(part)
            first = words.ranges(0)
            starts, places, hashes = arrays.anchors(first, window, gram, words.row_ends)
            new = arrays.runs(places)
            asked = repeats.is_suspected(part, words.rows[places[new]], hashes[new])
            starts = starts[np.repeat(asked, np.diff(np.append(new, len(places))))]
            entries, rows = np.empty(len(starts), ENTRY), words.rows[starts]
            entries["h1"], entries["h2"] = first.of(starts, starts + window), words.ranges(1).of(starts, starts + window)
            entries["key_id"] = part.column("key_id").to_numpy()[rows]
            entries["row"] = part.column("row").to_numpy()[rows]
            entries["start"] = starts - words.first[rows]
            entries, taken = _taken(entries)
            done = _spans(entries[taken], window, buckets)
            yield pa.RecordBatch.from_arrays([done.column("bucket"), *done.columns], ["slice", "bucket", "payload"])
            left = entries[~taken]
            of = (left["h1"] % U64(slices)).astype(np.int64)
            order = np.argsort(of, kind="stable")
            edge = arrays.runs(of[order])
            payload = arrays.binaries(left[order], np.append(edge, len(left)))
            yield pa.RecordBatch.from_arrays([pa.array(of[order][edge]), pa.nulls(len(edge), pa.int64()), payload], ["slice", "bucket", "payload"])

    return scan


def _across(window: int, buckets: int):
    """Settles windows over all groups of documents; equal windows are in one task, which holds only its share of the slices."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            settled = pc.is_valid(batch.column("bucket"))
            yield batch.filter(settled).select(["bucket", "payload"])
            held += batch.filter(pc.invert(settled)).column("payload").to_pylist()
        entries, taken = _taken(np.frombuffer(b"".join(held), ENTRY))
        del held
        yield _spans(entries[taken], window, buckets)

    return scan


def repeated_spans(base: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Ranges of word numbers that go, for documents from `repeats.keyed`."""
    hits = repeats.suspected(base.mapInArrow(_anchors(window, gram), repeats.ANCHORS))
    suspects = base.join(hits, repeats.KEY).select(*base.columns, "cells")
    buckets = repeats.partitions(base)
    found = suspects.mapInArrow(_windows(window, gram, SLICES * buckets, buckets), f"slice long, {repeats.BUCKETS}")
    return repeats.by_document(found.repartition("slice").mapInArrow(_across(window, buckets), repeats.BUCKETS))


def without_repeated_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """`doc_id`, `text` (the words that stay, joined by one space), `n_words`, `n_removed` for every row of `docs`."""
    base = repeats.keyed(docs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrays.groups(batches, "text"):
            words, texts, removed = _Words(part), [], []
            data = words.data.tobytes()
            for row, spans in enumerate(part.column("spans").to_pylist()):
                starts, ends = repeats.read_spans(spans)
                first, last = words.first[row], words.first[row + 1]
                cover = np.zeros(last - first + 1, np.int64)
                cover[starts], cover[ends] = 1, -1
                at = first + np.flatnonzero(np.cumsum(cover)[:-1] == 0)
                texts.append(b" ".join([data[a:b] for a, b in zip(words.starts[at].tolist(), words.ends[at].tolist())]).decode())
                removed.append(last - first - len(at))
            n = pa.array(np.diff(words.first))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(texts, pa.string()), n, pa.array(removed, pa.int64())], ["doc_id", "text", "n_words", "n_removed"],
            )

    cutting = repeats.with_spans(base, repeated_spans(base, window, gram))
    return cutting.mapInArrow(cut, "doc_id long, text string, n_words long, n_removed long")
