"""I-Match against its contract, and how it tells edits from other texts."""

from __future__ import annotations

import hashlib
import random
import re
import struct
from collections import Counter

import pytest
import xxhash
from conftest_llm import WORD, plain
from pyspark.sql import functions as F

from logloom.llm import fingerprints
from logloom.llm.queries import QUERIES
from test_texts import xxh


@pytest.fixture(params=["documents", "messy", "odd", "empty"])
def docs(request):
    return request.getfixturevalue(request.param)


def test_edits_and_lengths(docs):
    rows = [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, xxh(r[1])))
    following = dict(zip(order, order[1:] + order[:1]))
    want = []
    for doc_id, text in rows:
        quarter = len(text) // 4
        want.append((doc_id, len(text), text[: len(text) - quarter] + following[(doc_id, text)][1][:quarter]))
    made = fingerprints.edited_likeness(docs)
    assert plain(made, "doc_id", "n_chars", "edited") == sorted(want, key=repr)
    for row in made.collect():
        assert 0 <= row["near_edited"] <= 1 and 0 <= row["near_next"] <= 1
        assert row["near_next"] == 1 or following[(row["doc_id"], row["text"])][1] != row["text"]


def test_equal_texts_have_equal_fingerprints(messy):
    made = fingerprints.edited_likeness(messy).groupBy("text").agg(F.countDistinct(fingerprints.as_text(F.col("tags"))).alias("n"))
    assert made.where("n > 1").count() == 0


def test_edits_stay_near_and_others_far(spark):
    rows = QUERIES["op9_i_match"](spark, "/root/testdata/sf0.01").collect()
    assert all(len(r["edited_sha256"]) == len(hashlib.sha256().hexdigest()) for r in rows)
    long = [r for r in rows if r["n_chars"] >= 200]
    assert sum(r["near_edited"] > r["near_next"] for r in long) > 0.95 * len(long)
    assert sum(r["near_edited"] for r in long) > 0.35 * len(long) and sum(r["near_next"] for r in long) < 0.05 * len(long)


def test_band_holds_for_terms_by_exact_frequency(spark):
    # some 60,000 terms of one document each, so that nearly every counter of a fixed table would be met twice
    rows = [(i, " ".join([*(f"only{i}x{j}" for j in range(200)), f"pair{i // 2}", "every"])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = fingerprints.lexicon(docs)
    assert known.common == ["every"]
    assert {r["term"] for r in known.inside.collect()} == {f"pair{i}" for i in range(150)}
    assert known.below.count() == 300 * 200
    made = {r["doc_id"]: r["tags"] for r in fingerprints.edited_likeness(docs).collect()}
    # the only term in the band is the pair's
    assert all(made[i] == made[i + 1] for i in range(0, 300, 2)) and len({str(t) for t in made.values()}) == 150


@pytest.mark.parametrize("least", [2, 3])
def test_edited_texts_are_judged_by_the_same_lexicon(spark, least):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("abcd") * rnd.randint(1, 3) + rnd.choice(["", " ", " "]) for _ in range(rnd.randint(0, 60))) for _ in range(300)]
    counts = Counter(w for t in texts for w in set(t.split()))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def terms(text):
        found = set(text.split())
        return sorted({w for w in found if least <= counts[w] <= 0.05 * len(texts)} or found)

    rows = fingerprints.edited_likeness(docs, least, 0.05).collect()
    want = spark.createDataFrame([(r["doc_id"], terms(r["text"]), terms(r["edited"])) for r in rows], "doc_id long, a array<string>, b array<string>")
    want = want.select("doc_id", fingerprints.subset_hashes(F.col("a")).alias("a"), fingerprints.subset_hashes(F.col("b")).alias("b"))
    assert plain(want, "doc_id", "a", "b") == sorted(((r["doc_id"], r["tags"], r["edited_tags"]) for r in rows), key=repr)


def test_long_texts_have_a_subset_of_few_terms(spark):
    # 200,000 terms: at a fixed 1/4096 some 49 would be left in the thinnest subset
    terms = spark.createDataFrame([([f"t{i}" for i in range(200_000)],), ([],)], "terms array<string>")
    terms = terms.select(F.array_sort("terms").alias("terms"))
    long, none = [r["tags"] for r in terms.select(fingerprints.subset_hashes(F.col("terms")).alias("tags")).collect()]
    assert all(8 <= len(family) <= 16 and "" not in family for family in long) and none == [[]] * fingerprints.FAMILIES


def hashed(*values) -> int:
    """Spark's xxhash64 of integers and texts, one after another."""
    made = 42
    for v in values:
        made = xxhash.xxh64(struct.pack("<i", v) if isinstance(v, int) else v.encode(), seed=made).intdigest()
    return made - (1 << 64) if made >> 63 else made


def plain_tags(terms):
    """By family the hashes of the terms that each subset of the lexicon leaves, until none is left."""
    made = []
    for seed in range(8):
        left, tags, level = list(terms), [], 0
        while left and level < 31:
            tags.append(f"{hashed(*left) & 0xFFFFFF:06x}")
            level += 1
            left = [t for t in left if hashed(seed, t) % 4**level == 0]
        made.append(tags)
    return made


def plain_likeness(a, b):
    if not any(a) and not any(b):
        return 1.0
    return sum(any(x == y for x, y in zip(p, q)) for p, q in zip(a, b)) / len(a)


@pytest.mark.parametrize("name", ["documents", "messy"])
def test_fingerprints_and_likeness_in_plain_python(request, name):
    docs = request.getfixturevalue(name)
    rows = [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]
    counts = Counter(w for _, t in rows for w in set(re.findall(WORD, t)))

    def terms(text):
        found = set(re.findall(WORD, text))
        inside = {w for w in found if 2 <= counts[w] <= 0.01 * len(rows)} if 0.01 * len(rows) >= 2 else set()
        return sorted(inside or found, key=str.encode)

    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, xxh(r[1])))
    following = dict(zip(order, order[1:] + order[:1]))
    tags = {t: plain_tags(terms(t)) for _, t in rows}
    for r in fingerprints.edited_likeness(docs).collect():
        beyond = following[(r["doc_id"], r["text"])][1]
        edited = plain_tags(terms(r["edited"]))
        assert (r["tags"], r["edited_tags"]) == (tags[r["text"]], edited)
        assert r["near_edited"] == plain_likeness(tags[r["text"]], edited) and r["near_next"] == plain_likeness(tags[r["text"]], tags[beyond])
