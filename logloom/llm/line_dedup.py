"""Removal of lines that repeat an earlier line, exactly or nearly, by an exact set-similarity join.

A line is the set of its words; two lines match if their Jaccard similarity is at least NUM / DEN. Words are ordered by rarity, so
that matching lines share one of the first few: those prefixes are joined, candidates are cut by length and by position, and
the rest is verified on the whole sets. A line is removed if any line before it in the input matches it, whether or not that
one stays. Lines come in the order of doc_id, then of a hash of the text, then of their number in the text.

All of it is built-in functions. Lines with equal sets are first brought down to one row per set, so copies never meet in the
join; a set's first line is the only one of its lines that can stay. Most near-copies are then settled by a neighbour, and the join is for
pairs in which one set is still open. Sets go without their words, which are read again where pairs are verified.

Defined cases: a line without words is neither matched nor removed; a NULL text stays NULL and has no lines; a NULL doc_id
comes before all others; rows that are repeated whole stand at the same place and are treated alike.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.common import BETWEEN_WORDS, columns_of, null_safe_join, staged_at
from logloom.sources.events import drop_folder

NUM, DEN = 4, 5
#: Counters of the rarity table, a fixed size for any corpus.
COUNTERS = 1 << 18
#: Sets of more words have a sketch of 128 bits, others of 64.
WIDE = 100
#: Words of a set by which it looks for near-copies first.
MARKS = 4
#: What BETWEEN_WORDS matches.
BLANKS = " \t\n\v\f\r"


def _has_word(text: Column) -> Column:
    return text.rlike(r"[^\x20\x09-\x0D]")


def _counter(word: Column) -> Column:
    return F.xxhash64(word).bitwiseAND(COUNTERS - 1).cast("int")


def rarity_levels(texts: DataFrame) -> bytes:
    """For each counter a byte that rises with the number of words that fall on it, over all of column `text`.

    Words that share a counter count together, so this overestimates; any order of words gives the same matches,
    and this one costs a fixed number of bytes. Empty strings at the ends of a text and NULL texts count as one more word.
    """
    counts = texts.select(F.explode_outer(F.split("text", BETWEEN_WORDS, -1)).alias("word")).groupBy(_counter(F.col("word")).alias("at")).count()
    # half octaves as printable bytes
    level = (F.lit(33) + F.floor(2 * F.log2("count"))).cast("int").alias("level")
    blocks = counts.groupBy(F.floor(F.col("at") / 4096).alias("block")).agg(F.collect_list(F.struct("at", level)).alias("counters"))
    made = bytearray([33]) * COUNTERS
    for block in blocks.collect():  # at most COUNTERS counters
        for at, value in block["counters"]:
            made[at] = value
    return bytes(made)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.withColumn("row", F.xxhash64(F.lit(1), "text"))


def _lines(rows: DataFrame) -> DataFrame:
    """`doc_id`, `row`, `line_no`, `line` of the lines with words."""
    # the outer form keeps the optimizer from splitting each text twice to see if it has lines
    lines = rows.select("doc_id", "row", F.posexplode_outer(F.split("text", "\n", -1)).alias("line_no", "line"))
    return lines.withColumn("line", F.btrim("line", F.lit(BLANKS))).where("line != ''")


def _at_least(numerator: Column, denominator: int) -> Column:
    """The ratio, rounded up."""
    return F.floor((numerator + (denominator - 1)) / denominator).cast("int")


def _packed(levels: bytes) -> Column:
    """The levels from 0 on, eight to a long; a constant."""
    eights = np.clip(np.frombuffer(levels, np.uint8).astype(np.int64) - 33, 0, 63).reshape(-1, 8)
    longs = (eights << (8 * np.arange(8))).sum(axis=1)
    return F.split(F.lit(" ".join(map(str, longs.tolist()))), " ").cast("array<bigint>")


def _keys(line: Column, levels: bytes) -> Column:
    """The words of a line as longs, the rarest first: 6 bits of level before 57 of the word's hash."""
    table = _packed(levels)

    def key(h: Column) -> Column:
        at = h.bitwiseAND(COUNTERS - 1).cast("int")
        level = F.call_function("shiftright", F.get(table, F.shiftright(at, 3)), F.shiftleft(at.bitwiseAND(7), 3)).bitwiseAND(63)
        return F.shiftleft(level, 57).bitwiseOR(F.shiftrightunsigned(h, 7))

    hashes = F.transform(F.split(line, BETWEEN_WORDS, -1), lambda w: F.xxhash64(w))
    return F.sort_array(F.transform(F.array_distinct(hashes), key))


def _sets(rows: DataFrame, levels: bytes, num: int, den: int) -> DataFrame:
    """One row per distinct set: `s1`, `s2` name it, `first` holds its first place and what it is joined by.

    That is its size `n`, a sketch of it (`bits`, `more`) and a hash of each word of its `prefix`, none for a set that
    matches no other by its size. The words stay behind; they are read again for the few sets that may match.
    """
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k.bitwiseAND(63).cast("int"))
    parity = lambda keys: F.aggregate(keys, F.lit(0).cast("long"), lambda bits, k: bits.bitwiseXOR(bit(k)))
    keyed = _lines(rows).select("doc_id", "row", "line_no", _keys(F.col("line"), levels).alias("keys"))
    sized = keyed.withColumn("n", F.size("keys"))
    # each word flips one of 64 or 128 bits, so two sets differ in at least as many words as bits
    upper = F.when(F.col("n") > WIDE, parity(F.filter("keys", lambda k: k.bitwiseAND(64) != 0))).otherwise(F.lit(0).cast("long"))
    sized = sized.withColumns({"s1": F.xxhash64("keys"), "s2": F.hash(F.lit(7), "keys"), "whole": parity(F.col("keys")), "more": upper})
    # a set with fewer words matches none but itself
    long = F.floor(F.col("n") * den / num) > F.col("n")
    length = F.when(long, F.col("n") - _at_least(F.col("n") * num, den) + 1).otherwise(0)
    prefix = F.transform(F.slice("keys", 1, length), lambda k: F.hash(k)).alias("prefix")
    found = sized.select("s1", "s2", F.struct("doc_id", "row", "line_no", "n", F.col("whole").bitwiseXOR(F.col("more")).alias("bits"), "more", prefix).alias("first"))
    return found.groupBy("s1", "s2").agg(F.min("first").alias("first")).select("s1", "s2", "first.*")


def _close(n_a: Column, n_b: Column, num: int, den: int) -> tuple[Column, Column, Column]:
    """Whether sets `a` and `b` may match by size and sketch; how many words they must share; how many bits differ."""
    least = _at_least((n_a + n_b) * num, num + den)
    bits, more = [F.col(f"a.{c}").bitwiseXOR(F.col(f"b.{c}")) for c in ("bits", "more")]
    differ = F.when((n_a > WIDE) & (n_b > WIDE), F.bit_count(bits) + F.bit_count(more)).otherwise(F.bit_count(bits.bitwiseXOR(more)))
    lengths = F.least(n_a, n_b) * den >= F.greatest(n_a, n_b) * num
    return lengths & (differ <= n_a + n_b - 2 * least), least, differ.cast("int")


def _neighbours(sets: DataFrame, num: int, den: int) -> DataFrame:
    """For each set, as `later`, its likeliest match, as `earlier`, among the first set and the one before it that have a prefix word of it.

    Only the words of the least hashes count, which near-copies mostly share. So most lines of a family of near-copies are
    settled without meeting all others; `_candidates` is for those that are not.
    """
    own = F.struct("place", "n", "bits", "more")
    order = Window.partitionBy("mark").orderBy("place")
    marked = sets.where(F.size("prefix") > 0).select(
        F.struct("doc_id", "row", "line_no", "s1", "s2").alias("place"), "n", "bits", "more", F.explode(F.slice(F.sort_array("prefix"), 1, MARKS)).alias("mark"),
    )
    first = F.first(own).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = marked.select(own.alias("a"), F.array(first, F.lag(own).over(order)).alias("before")).select("a", F.explode("before").alias("b"))
    may, _, differ = _close(F.col("a.n"), F.col("b.n"), num, den)
    near = found.where((F.col("b.place") < F.col("a.place")) & may).select(F.col("a.place").alias("later"), differ.alias("differ"), F.col("b.place").alias("earlier"))
    return near.groupBy("later").agg(F.min(F.struct("differ", "earlier")).alias("least")).select("later", "least.earlier")


def _candidates(sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs `u`, `v` (by `s1`) of sets, one of them `open`, that share a prefix word after which enough words follow in both.

    A matching pair is found at the first word that it shares: all others that it shares come later. Before that, most others fall
    to their lengths and to the number of words that they must differ in.

    Words are joined by a hash and sets are named by the longer one of their two; hashes that clash can only add candidates. The rows of
    the prefixes are shuffled and sorted, whatever Spark expects of them: it takes them to be no larger than the sets.
    """
    one = sets.where(F.size("prefix") > 0).select("s1", "n", "bits", "more", "open", F.posexplode("prefix").alias("i", "h"))
    place = ((F.col("n") * 2**31 + F.col("i")) * 2 + F.col("open").cast("int")).cast("long")
    one = one.select("h", place.alias("nio"), "s1", "bits", "more")
    # both sides read the same shuffled rows
    a, b = one.alias("a"), one.alias("b")
    (n_a, i_a), (n_b, i_b) = [(F.shiftright(f"{x}.nio", 32), F.shiftright(f"{x}.nio", 1).bitwiseAND(2**31 - 1)) for x in "ab"]
    may, least, _ = _close(n_a, n_b, num, den)
    either = F.col("a.nio").bitwiseOR(F.col("b.nio")).bitwiseAND(1) == 1
    positions = F.least(n_a - i_a, n_b - i_b) >= least
    met = a.join(b.hint("merge"), F.col("a.h") == F.col("b.h")).where((F.col("a.s1") < F.col("b.s1")) & either & positions & may)
    return met.select(F.col("a.s1").alias("u"), F.col("b.s1").alias("v")).distinct()


def _ordered(candidates: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs as `later` and `earlier`, by their first places; only those whose later set is `open`."""
    own = sets.select("s1", F.struct(F.struct("doc_id", "row", "line_no", "s1", "s2").alias("place"), "open").alias("own"))
    a, b = own.select(F.col("s1").alias("u"), F.col("own").alias("a")), own.select(F.col("s1").alias("v"), F.col("own").alias("b"))
    pairs = candidates.join(a, "u").join(b, "v").select(F.greatest("a", "b").alias("later"), F.least("a", "b").alias("earlier"))
    return pairs.where("later.open").select("later.place", "earlier.place").toDF("later", "earlier")


def _words(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """`s1`, `s2` and the `words` of every set of the pairs, from its first line."""
    named = pairs.select("later.*").union(pairs.select("earlier.*")).distinct()
    wanted = named.groupBy("doc_id", "row").agg(F.collect_list(F.struct("line_no", "s1", "s2")).alias("wanted"))
    texts = null_safe_join(rows, wanted, ["doc_id", "row"]).select(F.split("text", "\n", -1).alias("lines"), "wanted")
    lines = texts.select("lines", F.explode("wanted").alias("set")).select("set.s1", "set.s2", F.get("lines", F.col("set.line_no")).alias("line"))
    words = F.array_distinct(F.split(F.btrim("line", F.lit(BLANKS)), BETWEEN_WORDS, -1))
    # rows may be repeated whole
    return lines.dropDuplicates(["s1", "s2"]).select("s1", "s2", words.alias("words"))


def _verified(pairs: DataFrame, words: DataFrame, num: int, den: int) -> DataFrame:
    """The names `s1`, `s2` of the later sets of those pairs that match on their words."""
    names = pairs.select(*[F.col(f"{x}.{s}").alias(f"{s}_{x[0]}") for x in ("later", "earlier") for s in ("s1", "s2")])
    for x in "el":
        own = words.select(F.col("s1").alias(f"s1_{x}"), F.col("s2").alias(f"s2_{x}"), F.col("words").alias(x))
        # compressed, they look smaller than they are
        names = names.join(own.hint("merge"), [f"s1_{x}", f"s2_{x}"])
    common = F.size(F.array_intersect("e", "l"))
    match = common * den >= (F.size("e") + F.size("l") - common) * num
    return names.where(match).select(F.col("s1_l").alias("s1"), F.col("s2_l").alias("s2")).distinct()


def _kept_lines(rows: DataFrame, num: int, den: int) -> DataFrame:
    """`doc_id`, `row` and the numbers of the lines with words that stay; texts that lose all of them are missing.

    Every step is written before the next, and what it has read and shuffled goes as soon as it isn't needed.
    """
    spark = rows.sparkSession

    def written(df: DataFrame, *used: str) -> tuple[DataFrame, str]:
        made = staged_at(df, release=True)
        for folder in used:
            drop_folder(spark, folder)
        return made

    def matching(pairs: DataFrame, at: str) -> tuple[DataFrame, str]:
        words, words_at = written(_words(rows, pairs))
        return written(_verified(pairs, words, num, den), words_at, at)

    sets, sets_at = written(_sets(rows, rarity_levels(rows), num, den))
    settled, settled_at = matching(*written(_neighbours(sets, num, den)))
    marked = sets.join(settled.withColumn("settled", F.lit(True)), ["s1", "s2"], "left")
    sets, sets_at = written(marked.withColumn("open", F.col("settled").isNull()).drop("settled"), sets_at, settled_at)
    pairs, pairs_at = written(_candidates(sets, num, den))
    gone, gone_at = matching(*written(_ordered(pairs, sets), pairs_at))
    places = sets.where("open").join(gone, ["s1", "s2"], "left_anti").select("doc_id", "row", "line_no")
    kept, _ = written(places.groupBy("doc_id", "row").agg(F.collect_list("line_no").alias("kept")), sets_at, gone_at)
    return kept.select(F.col("doc_id").alias("kept_id"), F.col("row").alias("kept_row"), "kept")


def _joined(rows: DataFrame, kept: DataFrame) -> DataFrame:
    same = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("row") == F.col("kept_row"))
    found = rows.join(kept, same, "left")
    return found.withColumn("kept", F.coalesce("kept", F.array().cast("array<int>")))


def removed_lines(docs: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """`doc_id`, `n_lines` and `removed`, the numbers (from 0) of the lines that go, for every row of `docs`."""
    rows = _rows(columns_of(docs, "doc_id", "text"))
    worded = F.transform(F.split("text", "\n", -1), _has_word)
    slim = rows.select("doc_id", "row", worded.alias("worded"))
    numbers = F.transform("worded", lambda has, i: F.when(has & ~F.array_contains("kept", i), i))
    return _joined(slim, _kept_lines(rows, num, den)).select(
        "doc_id", F.when(F.col("worded").isNull(), 0).otherwise(F.size("worded")).cast("long").alias("n_lines"),
        F.coalesce(F.filter(numbers, lambda i: i.isNotNull()), F.array().cast("array<int>")).alias("removed"),
    )


def without_repeated_lines(docs: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """The documents with doc_id, text, lang, source and n_chars, their repeated lines taken out."""
    slim = columns_of(docs, "doc_id", "text", "lang", "source", "n_chars")
    rows = _rows(slim)
    stays = lambda line, i: ~_has_word(line) | F.array_contains("kept", i)
    left = F.array_join(F.filter(F.split("text", "\n", -1), stays), "\n")
    found = _joined(rows, _kept_lines(rows, num, den)).withColumn("left", left)
    changed = F.col("text").isNotNull() & (F.col("left") != F.col("text"))
    return found.select(
        "doc_id", F.when(changed, F.col("left")).otherwise(F.col("text")).alias("text"), "lang", "source",
        F.when(changed, F.length("left").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"),
    )
