"""I-Match fingerprints of documents.

Terms are kept if their document frequency over all documents lies in a band; the distinct ones are sorted and hashed
under many randomised lexicon subsets. Subsets come in families: a family's own hash of the terms lets all of the lexicon into its
first subset, a quarter of that into the next, and so on until none of a text's terms is left, so that short and long texts alike have subsets that hold one or a few
of their terms. A local change spares the subsets that have no term in it. Two texts agree in a family if any of its subsets
holds terms of both and the same; the likeness of two fingerprints is the share of families that they agree in.

Document frequencies are exact. Each term is counted by itself, with the name of its document while it has only one. The terms beyond
the band are few whatever the corpus (their frequencies add up to at most all distinct terms of all documents) and are named in the plan;
the terms below it travel to the documents that they stand in. Of an edited text only the words at the two cuts can be in neither
of its documents, and are looked up.

Defined cases: a NULL text counts as empty; a text without terms in the band is hashed over all its terms; two texts without any
terms are wholly alike; a NULL doc_id comes before all others; rows repeated whole follow each other as one, and each gets the
same result; the next of the only document is itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.common import columns_of, staged, words

#: The band: in how many documents at least, and in which share of all documents at most, a term must be.
LEAST_DOCUMENTS, MOST_SHARE = 2, 0.01
FAMILIES, THINNING = 8, 4
# four to this power is all that a hash of 64 bits can tell apart
MOST_LEVELS = 31
FIRST = -(2**63)
# the word, or part of one, that a text ends in
TAIL = r"[^\x20\x09-\x0D]*\z"


@dataclass(frozen=True)
class Lexicon:
    """Which terms are in the band: `common` are beyond it (None if the band is empty), `below` has those under it by the document
    (`key_id`, `row`, `term`), `inside` has those in it (`term`)."""

    common: list[str] | None
    below: DataFrame
    inside: DataFrame


def lexicon(docs: DataFrame, least: int = LEAST_DOCUMENTS, most_share: float = MOST_SHARE) -> Lexicon:
    """The terms of all documents by their exact document frequency; every row of `docs` counts."""
    terms = docs.select(*_names(), F.explode(F.array_distinct(words(F.col("text")))).alias("term"))
    most = docs.count() * most_share
    # with one document, the least key_id and row are its name
    counts = staged(terms.groupBy("term").agg(F.count("*").alias("n"), F.min("key_id").alias("key_id"), F.min("row").alias("row")))
    if most < max(least, 1):
        return Lexicon(None, counts.limit(0).select("key_id", "row", "term"), counts.limit(0).select("term"))
    common = [r["term"] for r in counts.where(F.col("n") > most).select("term").collect()]  # at most 1 / most_share texts' worth of terms
    below = counts.where((F.col("n") < least) & (F.col("n") <= most))
    if least <= 2:
        below = below.select("key_id", "row", "term")
    else:
        below = terms.where(~F.col("term").isin(common)).join(below.select("term"), "term").select("key_id", "row", "term").distinct()
    return Lexicon(common, below, counts.where((F.col("n") >= least) & (F.col("n") <= most)).select("term"))


def terms_in_band(text: Column, common: list[str] | None, outside: Column) -> Column:
    """The distinct terms of a text that are neither common nor `outside`, sorted; all its terms if none is left."""
    terms = F.array_distinct(words(text))
    if common is None:
        return F.array_sort(terms)
    inside = F.filter(F.array_except(terms, outside), lambda t: ~t.isin(common))
    return F.array_sort(F.when(F.size(inside) > 0, inside).otherwise(terms))


def subset_hashes(terms: Column, families: int = FAMILIES) -> Column:
    """By family, the hash of the terms in each subset, as text, down to the last subset that has any of them."""

    def family(seed: int) -> Column:
        start = F.struct(terms.alias("left"), F.array().cast("array<string>").alias("made"))

        def step(state, level):
            left = state["left"]
            tag = F.lpad(F.lower(F.hex(F.xxhash64(left).bitwiseAND(0xFFFFFF))), 6, "0")
            share = F.pow(F.lit(THINNING), level + 1).cast("long")
            thinner = F.filter(left, lambda t: F.pmod(F.xxhash64(F.lit(seed), t), share) == 0)
            more = F.struct(thinner.alias("left"), F.concat(state["made"], F.array(tag)).alias("made"))
            return F.when(F.size(left) > 0, more).otherwise(state)

        return F.aggregate(F.sequence(F.lit(0), F.lit(MOST_LEVELS - 1)), start, step, lambda state: state["made"])

    return F.array(*[family(seed) for seed in range(families)])


def likeness(a: Column, b: Column) -> Column:
    """The share of families in which two texts agree; 1 if neither has any terms."""

    def agree(p: Column) -> Column:
        return F.exists(F.arrays_zip(p["a"].alias("x"), p["b"].alias("y")), lambda z: z["x"] == z["y"])

    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
    blank = (F.size(F.flatten(a)) == 0) & (F.size(F.flatten(b)) == 0)
    return F.when(blank, 1.0).otherwise(F.size(F.filter(pairs, agree)) / F.size(pairs))


def as_text(tags: Column) -> Column:
    """A fingerprint in one string."""
    return F.array_join(F.transform(tags, lambda family: F.array_join(family, ":")), ";")


def _names() -> list[Column]:
    return [F.coalesce("doc_id", F.lit(FIRST)).alias("key_id"), F.xxhash64(F.lit(1), "text").alias("row")]


def followers(keys: DataFrame) -> DataFrame:
    """Each distinct (`key_id`, `row`) with its `n_chars`, its `tail` and the next one's `next_id`, `next_row`; the first follows the last.

    The keys are sorted in ranges; only the borders of the ranges are ordered in one task.
    """
    ranges = staged(keys.distinct().repartitionByRange("key_id", "row").withColumn("range", F.spark_partition_id()))
    borders = ranges.groupBy("range").agg(F.min(F.struct("key_id", "row")).alias("first"))
    by_range = Window.orderBy("range")
    everywhere = by_range.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    borders = borders.select("range", F.coalesce(F.lead("first").over(by_range), F.first("first").over(everywhere)).alias("beyond"))
    inside = Window.partitionBy("range").orderBy("key_id", "row")
    led = ranges.withColumn("next", F.lead(F.struct("key_id", "row")).over(inside)).join(borders, "range")
    following = F.coalesce("next", "beyond")
    return led.select("key_id", "row", "n_chars", "tail", following["key_id"].alias("next_id"), following["row"].alias("next_row"))


def edited_likeness(docs: DataFrame, least: int = LEAST_DOCUMENTS, most_share: float = MOST_SHARE) -> DataFrame:
    """How each document's fingerprint withstands an edit: its last quarter is replaced by the start of the next document.

    Gives `doc_id`, `n_chars`, `text`, `edited`, `tags`, `edited_tags`, `near_edited`, `near_next`. Texts are dealt out once, by what names
    them: a document is sent the start of the next one, its fingerprint and which of its terms are below the band.
    All uses of the dealt-out texts read the same columns, so that Spark shuffles them once.
    """
    slim = columns_of(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    kept = F.substring("text", F.lit(1), (F.col("n_chars") - quarter).cast("int"))
    keys = slim.select(*_names(), "text", F.length("text").cast("long").alias("n_chars"))
    pairs = staged(followers(keys.select("key_id", "row", "n_chars", F.regexp_extract(kept, TAIL, 0).alias("tail"))))
    known = lexicon(slim, least, most_share)
    texts = keys.select("key_id", "row", "text").repartition("key_id", "row")
    none = F.array().cast("array<string>")
    below = known.below.groupBy("key_id", "row").agg(F.collect_list("term").alias("below"))
    below = below.select(F.col("key_id").alias("b_id"), F.col("row").alias("b_row"), "below")
    full = texts.join(below, (F.col("key_id") == F.col("b_id")) & (F.col("row") == F.col("b_row")), "left")
    full = full.select("key_id", "row", "text", F.coalesce("below", none).alias("below"))
    wanted = pairs.select(F.col("key_id").alias("of_id"), F.col("row").alias("of_row"), "n_chars", "tail", "next_id", "next_row")
    is_next = (F.col("key_id") == F.col("next_id")) & (F.col("row") == F.col("next_row"))
    head = F.substring("text", F.lit(1), quarter)
    # the first and the last word of what is joined at the cut: the only ones that may be in neither document
    cut = words(F.concat("tail", head))
    edges = texts.join(wanted, is_next).select("of_id", "of_row", F.explode(F.array_distinct(F.array_compact(F.array(F.get(cut, F.lit(0)), F.get(cut, F.size(cut) - 1))))).alias("term"))
    strange = edges.where(~F.col("term").isin(known.common or [])).join(known.inside, "term", "left_anti")
    strange = strange.groupBy("of_id", "of_row").agg(F.collect_set("term").alias("strange"))
    strange = strange.select(F.col("of_id").alias("s_id"), F.col("of_row").alias("s_row"), "strange")
    # a text is fingerprinted once, and its tags go to itself and to the one that it follows
    tagged = full.join(wanted, is_next).withColumn("terms", terms_in_band(F.col("text"), known.common, F.col("below")))
    tagged = tagged.select("key_id", "row", "of_id", "of_row", "n_chars", head.alias("head"), "below", subset_hashes(F.col("terms")).alias("tags"))
    to_former = F.struct("of_id", "of_row", "n_chars", "head", F.col("below").alias("next_below"), F.col("tags").alias("next_tags"), F.lit(None).cast("array<array<string>>").alias("tags"))
    to_itself = F.struct(
        F.col("key_id").alias("of_id"), F.col("row").alias("of_row"), F.lit(None).cast("long").alias("n_chars"), F.lit(None).cast("string").alias("head"),
        F.lit(None).cast("array<string>").alias("next_below"), F.lit(None).cast("array<array<string>>").alias("next_tags"), "tags",
    )
    sent = tagged.select(F.inline(F.array(to_former, to_itself)))
    sent = sent.groupBy("of_id", "of_row").agg(*[F.first(c, True).alias(c) for c in ("n_chars", "head", "next_below", "next_tags", "tags")])
    both = full.join(sent, (F.col("key_id") == F.col("of_id")) & (F.col("row") == F.col("of_row")))
    if known.common is not None:
        both = both.join(strange, (F.col("key_id") == F.col("s_id")) & (F.col("row") == F.col("s_row")), "left")
    else:
        both = both.withColumn("strange", none)
    changed = both.withColumn("edited", F.concat(kept, "head"))
    outside = F.concat("below", "next_below", F.coalesce("strange", none))
    changed = changed.withColumn("terms", terms_in_band(F.col("edited"), known.common, outside)).withColumn("edited_tags", subset_hashes(F.col("terms")))
    doc_id = F.when(F.col("key_id") != FIRST, F.col("key_id")).alias("doc_id")
    return changed.select(
        doc_id, "n_chars", "text", "edited", "tags", "edited_tags",
        likeness(F.col("tags"), F.col("edited_tags")).alias("near_edited"), likeness(F.col("tags"), F.col("next_tags")).alias("near_next"),
    )
