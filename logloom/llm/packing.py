"""Best-fit packing of documents into sequences of a fixed number of tokens.

Each task best-fits its own pieces, the longest first. Bins that no piece left anywhere could still go into are finished; the
others become items of the next round, in fewer tasks, until one task of bounded size has them all or a round brings nothing.
A task holds at most CHUNK items at a time.

Defined cases: a NULL or empty text is one piece, the end mark alone; a document that is longer than a sequence is
cut from its end, so that its first piece is the shorter one; repeated rows are packed each for itself.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import columns_of, staged
from logloom.llm.tokens import default_tokenizer, tokenizer

LENGTH, END = 1024, 2
CHUNK = 200_000
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str | None = None, length: int = LENGTH, end: int = END, with_ids: bool = False) -> DataFrame:
    """The pieces of every document: `doc_id`, `piece`, `start`, `length`, `ids_crc32` and, if wanted, `ids`."""
    path = path or default_tokenizer()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tokenizer(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, rows, ids = batch.slice(at, 256), [], []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    all_ids = np.append(known.ids(text or ""), end).astype("<u4")
                    first = len(all_ids) % length or length
                    cuts = [0, *range(first, len(all_ids) + 1, length)]
                    for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        rows.append((doc_id, piece, a, b - a, zlib.crc32(all_ids[a:b].tobytes())))
                        ids.append(all_ids[a:b])
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                made = [pa.array(values, kind) for values, kind in zip(zip(*rows), types)]
                if with_ids:
                    bounds = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
                    made.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate(ids).astype(np.int32))))
                yield pa.RecordBatch.from_arrays(made, [*(x.split()[0] for x in PIECE.split(", ")), *["ids"] * with_ids])

    return columns_of(docs, "doc_id", "text").mapInArrow(encode, PIECE + ", ids array<int>" * with_ids)


def best_fit(fills: np.ndarray, length: int) -> list[list[int]]:
    """Bins of item numbers: the longest items first, each into the fullest bin that it fits into."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(length + 1)]
    rooms = 0  # a bit for each amount of room that some bin has
    for item in np.argsort(-fills, kind="stable").tolist():
        size = int(fills[item])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[at].append(item)
        else:
            room, at = length, len(bins)
            bins.append([item])
        by_room[room - size].append(at)
        rooms |= 1 << (room - size)
    return bins


def _round(bins: DataFrame, length: int, chunk: int) -> DataFrame:
    """Best-fits the bins within each task; what is inside a bin stays together."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def packed():
            table = pa.Table.from_batches(held).combine_chunks()
            fills = table.column("fill").to_numpy()
            made = best_fit(fills, length)
            order = pa.array([i for group in made for i in group])
            sizes = np.array([len(group) for group in made])
            first = np.concatenate([[0], np.cumsum(sizes)])
            items = table.column("items").combine_chunks().take(order)
            bounds = np.concatenate([[0], np.cumsum(items.value_lengths().to_numpy())])[first]
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), items.flatten())
            full = np.add.reduceat(fills[order.to_numpy()], first[:-1])
            for at in range(0, len(made), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(full[at : at + 10_000], pa.int64()), lists[at : at + 10_000]], ["fill", "items"])

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= chunk:
                yield from packed()
                held, n = [], 0
        if n:
            yield from packed()

    return bins.mapInArrow(fit, bins.schema)


def pack(items: DataFrame, length: int = LENGTH, chunk: int = CHUNK) -> DataFrame:
    """Pieces (columns of PIECE) with `sequence_id` and `offset`: no sequence is longer than `length`."""
    names = [x.split()[0] for x in PIECE.split(", ")]
    bins = items.where(F.col("length") < length).select(F.col("length").alias("fill"), F.array(F.struct(*names)).alias("items"))
    whole = items.where(F.col("length") >= length).select(F.col("length").alias("fill"), F.array(F.struct(*names)).alias("items"))
    finished, n, tasks = [whole], None, 0
    while True:
        bins = staged(_round(bins, length, chunk))
        if tasks == 1:
            break
        least = bins.agg(F.min("fill")).first()[0]
        if least is None:
            break
        can_grow = F.col("fill") + F.lit(least) <= length
        left = bins.where(can_grow).count()
        finished.append(bins.where(~can_grow))
        bins = bins.where(can_grow)
        # the least bin itself always counts as open
        if left < 2 or (n is not None and left > 0.99 * n):
            break
        n, tasks = left, -(-left // chunk)
        bins = bins.repartition(tasks)
    finished.append(bins)
    together = finished[0]
    for part in finished[1:]:
        together = together.unionByName(part)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("items")
            flat, sizes = lists.flatten(), lists.value_lengths().to_numpy()
            lengths = flat.field("length").to_numpy()
            ends = np.cumsum(lengths)
            first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
            offsets = ends - lengths - np.repeat((ends - lengths)[first], sizes)
            ids = np.repeat(batch.column("sequence_id").to_numpy(), sizes)
            yield pa.RecordBatch.from_arrays([*[flat.field(x) for x in names], pa.array(ids), pa.array(offsets)], [*names, "sequence_id", "offset"])

    named = together.select(F.monotonically_increasing_id().alias("sequence_id"), "items")
    return named.mapInArrow(places, f"{PIECE}, sequence_id long, offset long")


def packed_documents(docs: DataFrame, path: str | None = None, length: int = LENGTH, end: int = END) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    return pack(staged(pieces(docs, path, length, end)), length)


def sequences(docs: DataFrame, path: str | None = None, length: int = LENGTH, end: int = END) -> DataFrame:
    """The training sequences themselves: `sequence_id` and `ids`."""
    encoded = staged(pieces(docs, path, length, end, with_ids=True))
    key = [x.split()[0] for x in PIECE.split(", ")]
    texts = encoded.dropDuplicates(key).select(*[F.col(c).alias(f"{c}_of") for c in key], "ids")
    placed = staged(pack(encoded.select(*key), length))
    same = [F.col(c).eqNullSafe(F.col(f"{c}_of")) for c in key]
    parts = placed.join(texts, same).groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))
