"""Mixing sources to target weights.

Each document gets a hash-random key; keys order the documents of a source, and equal ranges of key values cut
every source into parts that are sorted on their own. Word counts are summed per part, prefix sums over the parts of
a source find the one part that its budget ends in, and only that part is summed document by document. A
source of any size is thus spread over all parts, and texts are never sorted or moved for it.

Defined cases: a NULL text has size 0; a NULL source is a source of its own, the last; documents without words are
never taken; repeated rows count and are taken each for itself; with no words at all, nothing is taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.common import columns_of, n_words, staged, words

#: By a source's rank among the source names.
WEIGHTS = (5, 2, 1)
#: All that is taken, as a share of all there is; and how often at most a source may be gone through.
SHARE, MOST = 1.5, 2.0
#: Key ranges of each source.
PARTS = 1024
SEED = "mix"


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """`source`, `source_size`, `target` from `source`, `source_size`: one row per source, which one task orders.

    Targets are in proportion to weight, but none above `most` times its source's size; what is cut off is shared
    among the rest by weight, until none is above. In the order of size to weight that is one pass: a source is
    full if the rest of the budget, shared by weight from it on, would give it its limit.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    from_here = Window.orderBy("ratio", F.col("source").isNull(), "source")
    before, rest = from_here.rowsBetween(Window.unboundedPreceding, -1), from_here.rowsBetween(0, Window.unboundedFollowing)
    all_rows = Window.partitionBy()
    rank = F.row_number().over(by_name)
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (rank - 1) % len(weights))
    return (
        sizes.withColumn("weight", weight)
        .withColumn("limit", F.col("source_size") * F.lit(float(most)))
        .withColumn("ratio", F.col("limit") / F.col("weight"))
        .withColumn("left", F.sum("source_size").over(all_rows) * F.lit(float(share)) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.sum("weight").over(rest))
        .withColumn("full", F.col("level") >= F.col("ratio"))
        .withColumn("final", F.max(F.when(~F.col("full"), F.col("level"))).over(all_rows))
        .select("source", "source_size", F.when(F.col("full"), F.col("limit")).otherwise(F.col("final") * F.col("weight")).alias("target"))
    )


def _keyed(docs: DataFrame, seed: str) -> DataFrame:
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    key = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
    return docs.withColumn("key", key).withColumn("part", F.shiftright(F.col("key"), 50).cast("int"))


def mix(
    docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED, carry: tuple[str, ...] = (),
) -> DataFrame:
    """How many words the mix takes of each document.

    Gives `doc_id`, `source`, `size`, `source_size`, `target`, `taken`, and the columns to `carry`. Whole epochs of a source come
    first; what is left of its budget goes to its documents in key order, up to the exact word, so that the
    taken words of a source add up to its rounded target.
    """
    slim = columns_of(docs, *dict.fromkeys(("doc_id", "source", "text", *carry)))
    sized = _keyed(slim.withColumn("size", n_words(F.col("text"))), seed)
    kept = staged(sized.select("doc_id", "source", "size", "key", "part"))
    parts = kept.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    targets = source_targets(parts.groupBy("source").agg(F.sum("part_size").alias("source_size")), weights, share, most)
    renamed = targets.withColumnRenamed("source", "name")
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    cuts = staged(
        parts.withColumn("before", F.coalesce(F.sum("part_size").over(earlier), F.lit(0)))
        .join(renamed, F.col("source").eqNullSafe(F.col("name")))
        .withColumn("budget", F.round("target").cast("long"))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0)).cast("long"))
        .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size") - F.col("before"))
        .select("name", F.col("part").alias("cut_part"), "part_size", "source_size", "target", "epochs", "rest")
    )
    rows = sized if carry else kept
    found = rows.join(cuts, F.col("source").eqNullSafe(F.col("name")) & (F.col("part") == F.col("cut_part")))
    cut_inside = (F.col("rest") > 0) & (F.col("rest") < F.col("part_size"))
    in_order = Window.partitionBy("source", "part").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    whole = found.where(~cut_inside).withColumn("extra", F.when(F.col("rest") > 0, F.col("size")).otherwise(F.lit(0)))
    ahead = F.coalesce(F.sum("size").over(in_order), F.lit(0))
    split = found.where(cut_inside).withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - ahead)))
    wanted = ["doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("extra")).alias("taken")]
    return whole.unionByName(split).select(*wanted, *carry)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: a row for each time a document is taken, the one at a source's cut down to its first words.

    Gives doc_id, text, lang, source and n_chars. The words of a cut text are joined by one space.
    """
    whole, beyond = F.expr("taken div size"), F.expr("taken % size").cast("int")
    rows = mix(docs, carry=("text", "lang", "n_chars"), **options).where("taken > 0")
    rows = rows.withColumn("time", F.explode(F.sequence(F.lit(1), whole.cast("int") + (beyond > 0).cast("int"))))
    part, cut = F.array_join(F.slice(words(F.col("text")), 1, beyond), " "), F.col("time") > whole
    return rows.select(
        "doc_id", F.when(cut, part).otherwise(F.col("text")).alias("text"), "lang", "source",
        F.when(cut, F.length(part).cast("long")).otherwise(F.col("n_chars")).alias("n_chars"),
    )
