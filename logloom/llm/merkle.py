"""A Merkle manifest of documents: a content-addressed store of digests, and proofs read from it by descending from the root.

Leaves are digests of whole rows. Those of a source, ordered by doc_id, are hashed three by three, level by level, to the source's subroot,
and the subroots likewise to the root. The tree is built and stored in segments of LEVELS levels: a row of a store holds the records of one
segment (a node's digest to its children's digests) under the digest of the segment's top node. A request names a leaf by its rank. Requests
go down from the root segment by segment: the digits of the rank choose a child on each level, the digests not chosen are collected, and the
collected piece, turned round to run upwards, goes before what the levels above gave. All requests below one node of a segment go down
together, so the top of the tree is read once for each node and not once for each request.

Ranks come from a range sort and prefix sums over its parts, so a source of any size is sorted, numbered and hashed by many tasks.

Defined cases: NULL columns are part of a leaf (`-`); documents of a source with equal doc_ids, or NULL ones (they come first), go by their
leaves' digests; repeated rows are leaves of their own with the same digest; NULL is a source of its own, the first; without
documents there is no tree and the manifest has no root.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.common import columns_of, null_safe_join, staged

#: Children of a node; levels of a segment, which has so many leaves that a task can hold them.
FAN, LEVELS = 3, 5
SEGMENT = FAN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
DIGEST = 32
STORED = "tree long, rank long, height int, digest binary, records map<binary,binary>"
STEPS = "array<struct<before:string,after:string>>"


@dataclass
class Manifest:
    """Leaves (`tree`, `rank`, `leaf` and carried columns), trees (`tree`, `source`, `height`, `digest`), and the stores by height, lowest first."""

    leaves: DataFrame
    trees: DataFrame
    stores: list[DataFrame]
    top: list[DataFrame]
    root: str | None


def leaf_digest(*fields: Column) -> Column:
    """A row's digest as hex text: of every field in turn, its byte count and its value."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]).cast("binary"), 256)


def _parent(children: bytes) -> bytes:
    return sha256(children.hex().encode()).digest()


def _height(size: Column) -> Column:
    """How many levels above its leaves a tree of this size has."""
    return F.size(F.filter(F.array(*[F.lit(FAN**h) for h in range(40)]), lambda p: p < size))


def _rounds(height: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(height / LEVELS)).cast("int")


def ranked(rows: DataFrame, group: list[str], keys: list[str], groups: DataFrame | None = None) -> DataFrame:
    """`rows` with `rank`, their place from 0 in the order of `keys` (NULL first) within their `group`, and the columns that `groups` has for it.

    Rows are range-sorted, equal ones too are dealt out; only the number of rows in each part of each group is summed up further.
    """
    salted = rows.withColumn("salt", F.monotonically_increasing_id())
    order = [*group, *keys, "salt"]
    placed = salted.repartitionByRange(*order).sortWithinPartitions(*order).drop("salt").withColumn("at", F.monotonically_increasing_id())
    placed = staged(placed.withColumn("part", F.shiftright("at", 33)))
    before = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("part", *group).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    parts = parts.withColumn("shift", F.col("first") - F.coalesce(F.sum("n").over(before), F.lit(0))).select("part", "shift", *group)
    if groups is not None:
        parts = null_safe_join(parts, groups, group)
    return null_safe_join(placed, staged(parts), ["part", *group]).withColumn("rank", F.col("at") - F.col("shift")).drop("at", "part", "shift")


def _grown(nodes: DataFrame, height: int) -> list[DataFrame]:
    """The stores of trees with the leaves `tree`, `rank`, `height`, `digest`, the highest being `height`: one for each segment on the way up."""
    stores = []
    for done in range(0, max(height, 1), LEVELS):
        if stores:
            nodes = stores[-1].where(F.col("height") > done)
        segments = nodes.groupBy("tree", F.expr(f"rank div {SEGMENT}").alias("segment")).agg(
            F.first("height").alias("height"), F.array_sort(F.collect_list(F.struct("rank", "digest"))).alias("nodes"),
        )
        stores.append(staged(segments.mapInArrow(_hashed(done), STORED)))
    return stores


def _hashed(done: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heights, tops, keys, items, ends = batch.column("height").to_pylist(), [], [], [], [0]
            for height, nodes in zip(heights, batch.column("nodes")):
                level, records = nodes.values.field("digest").to_pylist(), {}
                for _ in range(min(LEVELS, height - done)):
                    runs = [b"".join(level[i : i + FAN]) for i in range(0, len(level), FAN)]
                    level = [_parent(run) for run in runs]
                    records.update(zip(level, runs))
                tops += level
                keys += records
                items += records.values()
                ends.append(len(keys))
            records = pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys, pa.binary()), pa.array(items, pa.binary()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("tree"), batch.column("segment"), batch.column("height"), pa.array(tops, pa.binary()), records],
                ["tree", "rank", "height", "digest", "records"],
            )

    return scan


def _roots(stores: list[DataFrame]) -> DataFrame:
    """`tree`, `height`, `digest` of the trees in `stores`."""
    found = [s.where(_rounds(F.col("height")) == i + 1).select("tree", "height", "digest") for i, s in enumerate(stores)]
    made = found[0]
    for more in found[1:]:
        made = made.unionByName(more)
    return made


def manifest(docs: DataFrame, carry: tuple[Column, ...] = ()) -> Manifest:
    """The manifest of all documents. `carry` are expressions over FIELDS that stay beside the leaves."""
    digest = F.unhex(leaf_digest(*[F.col(f) for f in FIELDS])).alias("leaf")
    rows = staged(columns_of(docs, *FIELDS).select("doc_id", "source", digest, *carry))
    sizes = rows.groupBy("source").agg(F.count("*").alias("size"))
    sources = staged(ranked(sizes, [], ["source"]).select("source", F.col("rank").alias("tree"), _height(F.col("size")).alias("height")))
    about = sources.agg(F.max("height"), F.count("*")).first()
    leaves = ranked(rows, ["source"], ["doc_id", "leaf"], sources)
    if not about[1]:
        return Manifest(leaves, sources.withColumn("digest", F.lit(b"")), [], [], None)
    leaves = staged(leaves)
    stores = _grown(leaves.select("tree", "rank", "height", F.col("leaf").alias("digest")), about[0])
    trees = staged(sources.join(_roots(stores).select("tree", "digest"), "tree"))
    height = next(h for h in range(40) if FAN**h >= about[1])
    top = _grown(trees.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("rank"), F.lit(height).alias("height"), "digest"), height)
    root = _roots(top).first()["digest"]
    return Manifest(leaves, trees, stores, top, bytes(root).hex())


def proofs(found: Manifest, requests: DataFrame) -> DataFrame:
    """For each of `requests` (`tree`, `rank` and any more) its row as `request`, its `leaf` and `subroot` as read from the stores, and its `steps`.

    `steps` are the levels from the leaf's up to the root's, each with the digests `before` and `after` the node in its run, as hex text.
    """
    if found.root is None:
        return requests.limit(0).select(F.struct("*").alias("request"), *[F.lit(b"").alias(n) for n in ("leaf", "subroot")], F.expr(f"CAST(array() AS {STEPS})").alias("steps"))
    asked = requests.select("tree").distinct().join(found.trees, "tree").select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("rank"), "height")
    start = _roots(found.top).select("tree", "height", "digest", F.col("digest").alias("subroot"), F.expr(f"CAST(array() AS {STEPS})").alias("steps"))
    above = _descend(found.top, start, asked)
    entries = above.select("request.rank", "request.height", "leaf", "steps").toDF("tree", "height", "digest", "steps").withColumn("subroot", F.col("digest"))
    return _descend(found.stores, staged(entries), requests)


def _descend(stores: list[DataFrame], entries: DataFrame, requests: DataFrame) -> DataFrame:
    """From the roots in `entries` (`tree`, `height`, `digest`, `subroot`, `steps`) down to the leaves that are asked for."""
    segment = F.expr(f"rank div {SEGMENT}")
    whole = requests.select("tree", "rank", F.struct(*requests.columns).alias("request"))
    asked = whole.groupBy("tree", segment.alias("rank")).agg(F.collect_list(F.struct(F.col("rank").alias("below"), "request")).alias("asked"))
    wanted = [staged(asked)]
    while len(wanted) < len(stores):
        ranks = wanted[-1].select("tree", "rank")
        wanted.append(staged(ranks.groupBy("tree", segment.alias("rank")).agg(F.collect_list(F.struct(F.col("rank").alias("below"))).alias("asked"))))
    entries = entries.withColumn("rank", F.lit(0).cast("long"))
    columns = ["tree", "rank", "height", "digest", "subroot", "steps"]
    opened = None
    for at in reversed(range(len(stores))):
        here = entries.where(_rounds(F.col("height")) == at + 1).select(*columns)
        opened = here if opened is None else opened.unionByName(here)
        records = stores[at].groupBy("digest").agg(F.any_value("records").alias("records"))  # equal segments are one record
        meeting = opened.join(wanted[at], ["tree", "rank"]).join(records, "digest")
        if at:
            made = meeting.mapInArrow(_walk(at), f"below struct<below:long>, tree long, height int, digest binary, subroot binary, steps {STEPS}")
            opened = staged(made.select("tree", "below.below", "height", "digest", "subroot", "steps").toDF(*columns))
        else:
            kind = asked.schema["asked"].dataType.elementType["request"].dataType.simpleString()
            made = meeting.mapInArrow(_walk(at), f"below struct<below:long,request:{kind}>, tree long, height int, digest binary, subroot binary, steps {STEPS}")
            return made.select("below.request", F.col("digest").alias("leaf"), "subroot", "steps")


def _walk(at: int):
    """Goes down one segment for each of its requests; the requests of a segment leave as one batch."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                digest, height = row.column("digest")[0].as_py(), row.column("height")[0].as_py()
                records, above = dict(row.column("records")[0].as_py()), row.column("steps").flatten()
                above = [above.field(name).to_pylist() for name in ("before", "after")]
                asked = row.column("asked").flatten()
                levels = min(LEVELS, height - LEVELS * at)
                digits = (asked.field("below").to_numpy()[:, None] // FAN ** np.arange(levels)[::-1]) % FAN
                before, after, leaves = [], [], []
                for path in (DIGEST * digits).tolist():
                    node, left, right = digest, [], []
                    for place in path:
                        children = records[node]
                        node = children[place : place + DIGEST]
                        left.append(children[:place].hex())
                        right.append(children[place + DIGEST :].hex())
                    before += left[::-1] + above[0]
                    after += right[::-1] + above[1]
                    leaves.append(node)
                n = len(leaves)
                steps = pa.StructArray.from_arrays([pa.array(before, pa.string()), pa.array(after, pa.string())], ["before", "after"])
                ends = pa.array(np.arange(n + 1) * (levels + len(above[0])), pa.int32())
                same = pa.array(np.zeros(n, np.int32))
                columns = [row.column(c).take(same) for c in ("tree", "height")]
                yield pa.RecordBatch.from_arrays(
                    [asked, *columns, pa.array(leaves, pa.binary()), row.column("subroot").take(same), pa.ListArray.from_arrays(ends, steps)],
                    ["below", "tree", "height", "digest", "subroot", "steps"],
                )

    return scan


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf (hex text) and the steps of a proof give."""
    return F.aggregate(steps, leaf, lambda node, step: F.sha2(F.concat(step["before"], node, step["after"]).cast("binary"), 256))


def proof_digest(steps: Column) -> Column:
    """The digest of all that a proof's steps hold."""
    return F.sha2(F.array_join(F.transform(steps, lambda step: F.concat(step["before"], step["after"])), "").cast("binary"), 256)


def hex_text(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def verified(docs: DataFrame, changed: Column) -> DataFrame:
    """Every document's proof, held against a later state of its row.

    `changed` gives a row's leaf as it is found later, as hex text, or NULL where the row is as it was. Gives `doc_id`, `source`, `leaf`, `subroot`, `root`, `steps`,
    `folded_root` (of the changed leaf and the steps) and `verified`.
    """
    made = manifest(docs, (F.unhex(changed).alias("changed"),))
    found = proofs(made, made.leaves.select("tree", "rank", "doc_id", "source", "changed"))
    root = F.lit(made.root).cast("string")
    shown = found.select(
        "request.doc_id", "request.source", hex_text(F.col("leaf")).alias("leaf"), hex_text(F.col("subroot")).alias("subroot"), root.alias("root"), "steps",
        hex_text(F.coalesce("request.changed", "leaf")).alias("found"),
    )
    return shown.withColumn("folded_root", folded(F.col("found"), F.col("steps"))).drop("found").withColumn("verified", F.col("folded_root") == F.col("root"))
