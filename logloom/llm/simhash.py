"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint has a bit for each bit of XXH64 that is set in over half of a text's word shingles. Two fingerprints link if
they differ in at most `bits` places. Cut into segments, few enough that one of them differs by at most one place, each
fingerprint is indexed under every segment with every one of its places struck out (and without that place); linked
fingerprints share such a signature, so equal signatures are joined and the distance is verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm import arrays
from logloom.llm.arrays import U64
from logloom.llm.common import columns_of, staged
from logloom.llm.components import components

WORDS, BITS, SEED = 4, 4, 42

# The constants that XXH64 is defined by.
P1, P2, P3, P4, P5 = (
    U64(0x9E3779B185EBCA87), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9), U64(0x85EBCA77C2B2AE63), U64(0x27D4EB2F165667C5),
)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# The bits of a byte, the lowest first, one to each byte of a word.
SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(U64).ravel()


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << U64(by)) | (x >> U64(64 - by))


def _round(state, word):
    return _rotated(state + word * P2, 31) * P1


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of many ranges of one run of bytes."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded[:8].view(U64), (len(data) + 1,), (1,))
    four = np.lib.stride_tricks.as_strided(padded[:4].view(np.uint32), (len(data) + 1,), (1,))
    sizes, seed = ends - starts, U64(seed)
    h = np.full(len(starts), seed + P5, U64)
    with np.errstate(over="ignore"):
        active = np.flatnonzero(sizes >= 32)
        if len(active):
            lanes = [np.full(len(active), seed + x, U64) for x in (P1 + P2, P2, U64(0), U64(0) - P1)]
            stripes, at, live = sizes[active] // 32, starts[active], np.arange(len(active))
            for step in range(int(stripes.max())):
                live = live[stripes[live] > step]
                for i, lane in enumerate(lanes):
                    lane[live] = _round(lane[live], eight[at[live] + 32 * step + 8 * i])
            merged = _rotated(lanes[0], 1) + _rotated(lanes[1], 7) + _rotated(lanes[2], 12) + _rotated(lanes[3], 18)
            for lane in lanes:
                merged = (merged ^ _round(U64(0), lane)) * P1 + P4
            h[active] = merged
        h += sizes.astype(U64)
        at, left = starts + sizes // 32 * 32, sizes % 32
        for step in range(3):
            live = np.flatnonzero(left >= 8 * (step + 1))
            h[live] = _rotated(h[live] ^ _round(U64(0), eight[at[live] + 8 * step]), 27) * P1 + P4
        at, left = at + left // 8 * 8, left % 8
        live = np.flatnonzero(left >= 4)
        h[live] = _rotated(h[live] ^ four[at[live]].astype(U64) * P1, 23) * P2 + P3
        at, left = at + left // 4 * 4, left % 4
        for step in range(3):
            live = np.flatnonzero(left > step)
            h[live] = _rotated(h[live] ^ padded[at[live] + step].astype(U64) * P5, 11) * P1
        h = (h ^ (h >> U64(33))) * P2
        h = (h ^ (h >> U64(29))) * P3
        return h ^ (h >> U64(32))


def simhashes(texts: pa.Array, shingle: int = WORDS) -> np.ndarray:
    """The fingerprint of each text; zero without words."""
    data, offsets = arrays.flat(texts)
    starts, ends, first = arrays.word_ranges(data, offsets)
    made = np.zeros(len(texts), U64)
    counts = np.diff(first)
    if not len(starts):
        return made
    lengths = ends - starts
    new = np.concatenate([[0], np.cumsum(lengths + 1)])
    joined = np.full(new[-1], 0x20, np.uint8)
    inside = np.flatnonzero(~arrays.SPACE[data])
    joined[inside + np.repeat(new[:-1] - starts, lengths)] = LOWER[data[inside]]
    per_text = np.where(counts == 0, 0, np.maximum(counts - shingle + 1, 1))
    begin = np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(per_text)[:-1]]), per_text) + np.arange(per_text.sum())
    last = np.minimum(begin + shingle, np.repeat(first[1:], per_text)) - 1
    hashes = xxh64(joined, new[begin], new[last] + lengths[last])
    # sums of at most 255 hashes fit into one byte for each bit
    bounds = np.concatenate([[0], np.cumsum(per_text)])
    filled = np.flatnonzero(per_text)
    steps = -(-per_text[filled] // 255)
    block = np.concatenate([[0], np.cumsum(steps)])
    cuts = np.repeat(bounds[filled] - 255 * block[:-1], steps) + 255 * np.arange(block[-1])
    planes = hashes.view(np.uint8).reshape(-1, 8)
    sums = np.stack([np.add.reduceat(SPREAD[planes[:, i]], cuts).view(np.uint8).reshape(-1, 8) for i in range(8)], axis=1)
    totals = np.add.reduceat(sums.reshape(-1, 64).astype(np.int64), block[:-1], axis=0)
    bits = (2 * totals > per_text[filled][:, None]).astype(np.uint8)
    made[filled] = np.packbits(bits, axis=1, bitorder="little").view(U64).ravel()
    return made


def fingerprints(docs: DataFrame, shingle: int = WORDS, names: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`doc_id` (or the columns `names`, all long) and `fingerprint` (a long) of every row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrays.groups(batches, "text"):
            found = simhashes(part.column("text"), shingle).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(found)], [*names, "fingerprint"])

    return columns_of(docs, *names, "text").mapInArrow(scan, ", ".join(f"{c} long" for c in (*names, "fingerprint")))


def _choices(cuts: int, kept: int) -> list[list[int]]:
    """The places of every choice of `kept` among `cuts` segments."""
    edges = [64 * i // cuts for i in range(cuts + 1)]
    return [[p for s in chosen for p in range(edges[s], edges[s + 1])] for chosen in combinations(range(cuts), kept)]


def _mask(places: list[int]):
    mask = sum(1 << p for p in places)
    return F.lit(mask - (1 << 64) if mask >> 63 else mask)


def signatures(fingerprint, cuts: int, kept: int):
    """All signatures of a fingerprint: for each choice of segments, its places but one, the others cleared."""
    return F.array(*[
        fingerprint.bitwiseAND(_mask([p for p in places if p != out])) for places in _choices(cuts, kept) for out in places
    ])


def _first_shared(differing, cuts: int, kept: int):
    """Which is the first signature that two fingerprints share, from the places in which they differ."""
    found, base = F.lit(None).cast("int"), 0
    cases = []
    for places in _choices(cuts, kept):
        here, mask = differing.bitwiseAND(_mask(places)), _mask(places)
        below = F.coalesce(F.try_subtract(here, F.lit(1)), F.lit(2**63 - 1)).bitwiseAND(mask)
        cases += [(here == 0, F.lit(base)), (F.bit_count(here) == 1, F.lit(base) + F.bit_count(below))]
        base += len(places)
    for when, then in reversed(cases):
        found = F.when(when, then).otherwise(found)
    return found


def _check_cuts(bits: int, cuts: int, kept: int) -> None:
    # the worst case spreads the differing places evenly
    least = sum(sorted(bits // cuts + (i < bits % cuts) for i in range(cuts))[:kept])
    if not 0 < kept <= cuts <= 64 or least > 1:
        raise ValueError(f"{bits} differing places can leave {least} in the best {kept} of {cuts} segments; at most one is allowed")


def near_links(prints: DataFrame, bits: int = BITS, cuts: int | None = None, kept: int = 1) -> DataFrame:
    """Links `u` < `v` between distinct fingerprints (a long column `fingerprint`) that differ in at most `bits` places.

    By default the fewest segments are cut of which one differs by at most one place. Each fingerprint then has 64
    signatures of about 64 / cuts places; a pair is given at the first that it shares. With very many fingerprints, longer signatures keep chance meetings down:
    `cuts=6, kept=3` gives 640 of 32 places (for 4 bits).

    Both sides are shuffled and sorted, whatever Spark expects of them: it takes the signatures to be no larger than the fingerprints
    that they are made of, a sixty-fourth or less, and would send all of them through the driver.
    """
    cuts = cuts or bits // 2 + 1
    _check_cuts(bits, cuts, kept)
    one = prints.select(F.col("fingerprint").alias("u"), F.posexplode(signatures(F.col("fingerprint"), cuts, kept)).alias("at", "sign"))
    two = one.select(F.col("u").alias("v"), "at", "sign")
    differing = F.col("u").bitwiseXOR(F.col("v"))
    near = (F.col("u") < F.col("v")) & (F.bit_count(differing) <= bits) & (F.col("at") == _first_shared(differing, cuts, kept))
    return one.join(two.hint("merge"), ["at", "sign"]).where(near).select("u", "v")


def _groups(prints: DataFrame, bits: int, cuts: int | None, kept: int) -> DataFrame:
    """`known`, `root` and `component_id` of each distinct fingerprint of `prints` (doc_id, fingerprint)."""
    nodes = staged(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")))
    stars = components(near_links(nodes, bits, cuts, kept))
    rooted = nodes.join(stars, nodes.fingerprint == stars.node, "left").select(
        "fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"),
    )
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return staged(rooted.join(least, "root").select(F.col("fingerprint").alias("known"), "root", "component_id"))


def near_duplicates(
    docs: DataFrame, shingle: int = WORDS, bits: int = BITS, cuts: int | None = None, kept: int = 1,
) -> DataFrame:
    """`doc_id`, `fingerprint` (long), `root`, `component_id` for every row of `docs`.

    Components are those of the links between fingerprints, so copies count once; `component_id` is the least
    doc_id in it, `root` its least fingerprint. Defined cases: NULL or wordless text has fingerprint zero, linked like any other; a NULL
    doc_id is never the least unless all are; repeated rows keep their own result rows.
    """
    found = staged(fingerprints(docs, shingle))
    named = _groups(found, bits, cuts, kept)
    return found.join(named, F.col("fingerprint") == F.col("known")).select("doc_id", "fingerprint", "root", "component_id")


def one_of_each(
    docs: DataFrame, shingle: int = WORDS, bits: int = BITS, cuts: int | None = None, kept: int = 1,
) -> DataFrame:
    """One document of each group of near-duplicates, whole and once: the one with the least doc_id (NULL comes last).

    Of several rows with that id in a group it is the least by `row_1`, `row_2`, a hash of 128 bits of all columns, so the result
    does not depend on the order of tasks. Rows are found again by id and hash: equal doc_ids (or NULLs) in different groups are apart.
    Gives doc_id, text, lang, source and n_chars.
    """
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    slim = columns_of(docs, *columns)
    # NULLs are skipped by xxhash64, so that they are told by a column of their own
    told = F.concat(*[F.col(c).isNull().cast("int").cast("string") for c in columns])
    hashed = slim.select(*columns, *[F.xxhash64(F.lit(seed), told, *columns).alias(f"row_{seed}") for seed in (1, 2)])
    found = staged(fingerprints(hashed, shingle, ("doc_id", "row_1", "row_2")))
    named = _groups(found, bits, cuts, kept)
    row = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_1", "row_2")
    least = found.join(named, F.col("fingerprint") == F.col("known")).groupBy("root").agg(F.min(row).alias("least"))
    chosen = least.select(F.col("least.doc_id").alias("chosen"), F.col("least.row_1").alias("chosen_1"), F.col("least.row_2").alias("chosen_2"))
    same = F.col("doc_id").eqNullSafe(F.col("chosen")) & (F.col("row_1") == F.col("chosen_1")) & (F.col("row_2") == F.col("chosen_2"))
    # rows that are repeated whole have the same name
    return hashed.join(chosen, same).dropDuplicates(["doc_id", "row_1", "row_2"]).select(*columns)
