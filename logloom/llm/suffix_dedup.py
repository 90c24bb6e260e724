"""Removal of byte strings that occur more than once, by suffix arrays over shards that equal strings share.

A byte goes if a string of LENGTH bytes that covers it also starts anywhere else, in any document. Windows of LENGTH bytes have
anchors (see `repeats`), and only stretches whose anchor is estimated to repeat are looked at: a piece is a run of
neighbouring windows with the same anchor. Pieces go to shards by anchor, so that equal windows are in one shard. A shard's suffix
array is induced linearly, and where two neighbouring suffixes share LENGTH bytes both windows repeat.

Equal pieces are told by 128 bits of hash before they travel: of several in a group of documents all windows repeat, and only one
of them is sent on, as a witness. So a passage that a third of all documents share arrives once from each group. Of
what arrives, equal pieces are settled in the same way, and suffix arrays are built of those that share an anchor but differ.

Defined cases: a NULL or empty text has no bytes; rows that are repeated whole are each other's repeats; a text of any length is gone
through in parts that overlap; what is left of a text may be no valid UTF-8, so it is given as bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from logloom.llm import arrays, repeats
from logloom.llm.arrays import BYTE_SYMBOLS, Ranges
from logloom.llm.suffix_array import permuted_common_prefixes, suffix_array

LENGTH, GRAM = 200, 32
# A part of 512 kB takes some 55 MB of arrays in its task, a suffix array 70 bytes for each byte of its shard.
PART_BYTES, SHARD_BYTES = 1 << 19, 1 << 19
# No UTF-8 text holds this byte; it ends every piece of a shard.
BETWEEN = 255
PIECES = "cell long, key_id long, row long, start long, known boolean, piece binary"
NAMES = ["cell", *repeats.KEY, "start", "known", "piece"]


def _parts(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """Windows of a batch of documents, part by part: starts, anchor places and hashes, and the part's bytes and place."""
    for first in range(0, len(data), PART_BYTES):
        part = data[first : first + PART_BYTES + length - 1]
        ends = offsets[1:][np.searchsorted(offsets[1:], np.arange(first, first + len(part)), "right")] - first
        starts, places, hashes = arrays.anchors(Ranges(BYTE_SYMBOLS[0][part]), length, gram, ends)
        here = slice(0, np.searchsorted(starts, PART_BYTES))
        yield first, part, starts[here], places[here], hashes[here]


def _anchors(length: int, gram: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.groups(batches, "text", PART_BYTES):
            data, offsets = arrays.flat(batch.column("text"))
            for first, _, starts, places, hashes in _parts(data, offsets, length, gram):
                new = arrays.runs(places)
                rows = np.searchsorted(offsets[1:], starts[new] + first, "right")
                yield repeats.anchor_batch(batch, rows, hashes[new])

    return scan


def _pieces(length: int, gram: int, buckets: int):
    """Pieces of suspected documents by anchor, one of equals; and the spans that are settled by equals, with their bucket for a key."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.groups(batches, "text", PART_BYTES):
            data, offsets = arrays.flat(batch.column("text"))
            keys, hashed = batch.column("key_id").to_numpy(), batch.column("row").to_numpy()
            for first, part, starts, places, hashes in _parts(data, offsets, length, gram):
                new = arrays.runs(places)
                rows = np.searchsorted(offsets[1:], starts[new] + first, "right")
                asked = repeats.is_suspected(batch, rows, hashes[new])
                begin = starts[new][asked]
                end = starts[np.append(new[1:], len(starts)) - 1][asked] + length
                rows, cells = rows[asked], repeats.cells(hashes[new][asked])
                h1, h2 = [Ranges(BYTE_SYMBOLS[lane][part], lane).of(begin, end) for lane in (0, 1)]
                order = np.lexsort((h2, h1))
                edge = np.union1d(arrays.runs(h1[order]), arrays.runs(h2[order]))
                copies = np.diff(np.append(edge, len(order)))
                settled = order[np.repeat(copies > 1, copies)]
                at = rows[settled]
                done = repeats.bucketed(keys[at], hashed[at], begin[settled] + first - offsets[at], end[settled] + first - offsets[at], buckets)
                none = pa.nulls(done.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [done.column("bucket"), done.column("bucket"), none, none, pa.nulls(done.num_rows, pa.bool_()), done.column("payload")], NAMES,
                )
                one, at = order[edge], rows[order[edge]]
                lengths = end[one] - begin[one]
                bounds = np.concatenate([[0], np.cumsum(lengths)])
                text = part[np.arange(bounds[-1]) + np.repeat(begin[one] - bounds[:-1], lengths)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cells[one]), pa.array(keys[at]), pa.array(hashed[at]), pa.array(begin[one] + first - offsets[at]),
                     pa.array(copies > 1), arrays.binaries(text, bounds)], NAMES,
                )

    return scan


def _repeats(text: np.ndarray, bounds: np.ndarray, length: int) -> np.ndarray:
    """Which bytes of a shard, given where its pieces begin, start a string that starts anywhere else in it."""
    lengths = np.diff(bounds)
    data = np.full(len(text) + len(lengths), BETWEEN, np.uint8)
    at = np.arange(len(text)) + np.repeat(np.arange(len(lengths)), lengths)
    data[at] = text
    sa = suffix_array(data)
    shared = permuted_common_prefixes(data, sa) >= length
    again = shared.copy()
    again[sa[:-1]] |= shared[sa[1:]]
    return again[at] & (np.repeat(bounds[1:], lengths) - np.arange(len(text)) >= length)


def _shards(length: int, buckets: int):
    """Spans that repeat among the pieces of a task, a shard at a time; an anchor's pieces are never parted."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            settled = pc.is_null(batch.column("start"))
            done = batch.filter(settled)
            yield pa.RecordBatch.from_arrays([done.column("key_id"), done.column("piece")], ["bucket", "payload"])
            held.append(batch.filter(pc.invert(settled)))
        table = pa.Table.from_batches(held).combine_chunks() if held else None
        if table is None or not table.num_rows:
            return
        del held
        cells, known = table.column("cell").to_numpy(), table.column("known").to_numpy()
        starts, keys, rows = [table.column(c).to_numpy() for c in ("start", *repeats.KEY)]
        texts = table.column("piece").chunk(0).dictionary_encode()
        del table
        same, texts = texts.indices.to_numpy(), texts.dictionary
        sizes = pc.binary_length(texts).to_numpy()
        # equal pieces of several groups of documents
        again = (np.bincount(same, minlength=len(texts)) > 1) | (np.bincount(same, known, len(texts)) > 0)
        at = np.flatnonzero(again[same] & ~known)
        yield repeats.bucketed(keys[at], rows[at], starts[at], starts[at] + sizes[same[at]], buckets)
        # a piece that is alone with its anchor repeats nowhere; the others that are still open may in part
        owner = np.empty(len(texts), np.int64)
        owner[same] = np.arange(len(same))
        order = np.argsort(cells[owner], kind="stable")
        edge = np.append(arrays.runs(cells[owner[order]]), len(order))
        open_pieces = np.add.reduceat(~again[order], edge[:-1])
        wanted = np.repeat((np.diff(edge) > 1) & (open_pieces > 0), np.diff(edge))
        order = order[wanted]
        total, edge = np.cumsum(sizes[order]), np.append(arrays.runs(cells[owner[order]]), len(order))
        low = 0
        while low < len(order):
            full = np.searchsorted(total, total[low] - sizes[order[low]] + SHARD_BYTES, "right")
            high = int(edge[max(np.searchsorted(edge, full, "right") - 1, np.searchsorted(edge, low, "right"))])
            shard = order[low:high]
            low = high
            text, bounds = arrays.flat(texts.take(pa.array(shard)))
            found = np.flatnonzero(_repeats(text, bounds, length))
            piece = np.searchsorted(bounds[1:], found, "right")
            found, piece = found[~again[shard[piece]]], piece[~again[shard[piece]]]
            at = owner[shard[piece]]
            begin = starts[at] + found - bounds[piece]
            yield repeats.bucketed(keys[at], rows[at], begin, begin + length, buckets)

    return scan


def repeated_spans(base: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Ranges of bytes that go, for documents from `repeats.keyed`."""
    hits = repeats.suspected(base.mapInArrow(_anchors(length, gram), repeats.ANCHORS))
    suspects = base.join(hits, repeats.KEY).select(*base.columns, "cells")
    buckets = repeats.partitions(base)
    pieces = suspects.mapInArrow(_pieces(length, gram, buckets), PIECES)
    return repeats.by_document(pieces.repartition("cell").mapInArrow(_shards(length, buckets), repeats.BUCKETS))


def without_repeated_strings(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """`doc_id`, `kept` (the bytes that stay), `n_bytes`, `n_removed`, `n_spans` for every row of `docs`."""
    base = repeats.keyed(docs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrays.groups(batches, "text"):
            data, offsets = arrays.flat(part.column("text"))
            kept, removed, counts = [], [], []
            for row, spans in enumerate(part.column("spans").to_pylist()):
                text = data[offsets[row] : offsets[row + 1]].tobytes()
                starts, ends = repeats.read_spans(spans)
                kept.append(b"".join([text[a:b] for a, b in zip([0, *ends.tolist()], [*starts.tolist(), len(text)])]))
                removed.append(len(text) - len(kept[-1]))
                counts.append(len(starts))
            numbers = [pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(kept, pa.binary()), *numbers], ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"],
            )

    cutting = repeats.with_spans(base, repeated_spans(base, length, gram))
    return cutting.mapInArrow(cut, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")
