"""Operators on texts against brute force, on real documents and on messy ones."""

from __future__ import annotations

import hashlib
import os
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from conftest_llm import WORD, plain
from pyspark.sql import functions as F

from logloom.llm import attribution, line_dedup, simhash, suffix_dedup, window_dedup
from logloom.llm.common import RELEASE, staged, staged_at
from logloom.llm.suffix_array import permuted_common_prefixes, suffix_array
from logloom.llm.tokens import default_tokenizer, tokenizer


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(params=["documents", "messy", "odd", "empty"])
def docs(request):
    return request.getfixturevalue(request.param)


def test_simhash(docs):
    def fingerprint(text):
        found = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        shingles = [" ".join(found[i : i + 4]) for i in range(max(1, len(found) - 3))] if found else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    rows = [(doc_id, fingerprint(text)) for doc_id, text in rows_of(docs)]
    prints = sorted({f for _, f in rows})
    root = {f: f for f in prints}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                root[find(b)] = find(a)
    least = defaultdict(list)
    for doc_id, f in rows:
        least[find(f)].append(doc_id)
    least = {f: min((i for i in ids if i is not None), default=None) for f, ids in least.items()}
    want = sorted(((i, f - (1 << 64) * (f >> 63), least[find(f)]) for i, f in rows), key=repr)
    assert plain(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == want
    kept = plain(simhash.one_of_each(docs), "doc_id")
    assert len(kept) == len({find(f) for _, f in rows})


def test_one_of_each_takes_a_text_of_every_group(spark):
    rnd = np.random.default_rng(7)
    texts = [" ".join(f"w{i}" for i in rnd.integers(0, 10**6, 60)) for _ in range(12)]
    ids = [6, 6, None, None, None, 6, 1, 2, None, 6, 7, None]
    rows = [(i, t, "en", "a", n) for n, (i, t) in enumerate(zip(ids, texts))]
    rows += [rows[0], rows[2], (9, texts[1], "en", "b", 3), (6, texts[1], "en", "b", 4), (None, texts[6], None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    roots = {r["fingerprint"] for r in simhash.near_duplicates(docs).select("fingerprint").collect()}
    assert len(roots) == len(texts)
    made = [tuple(r) for r in simhash.one_of_each(docs).collect()]
    assert sorted(r[1] for r in made) == sorted(texts) and set(made) <= set(rows)
    assert [r[0] for t in texts for r in made if r[1] == t] == ids
    again = [tuple(r) for r in simhash.one_of_each(docs.orderBy(F.desc("n_chars")).repartition(7)).collect()]
    assert sorted(again, key=repr) == sorted(made, key=repr)


def test_signatures_are_not_sent_through_the_driver(spark, conf):
    conf("spark.sql.autoBroadcastJoinThreshold", "10m")
    rnd = np.random.default_rng(4)
    nodes = staged(spark.createDataFrame([(int(f),) for f in rnd.integers(0, 1 << 63, 500)], "fingerprint long"))
    links = simhash.near_links(nodes)
    assert links.collect() == []
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_more_segments_give_the_same_links(spark):
    rnd = np.random.default_rng(3)
    base = rnd.integers(0, 1 << 63, 40)
    near = [int(b) ^ sum(1 << int(p) for p in rnd.choice(63, rnd.integers(0, 7), replace=False)) for b in base for _ in range(6)]
    nodes = spark.createDataFrame([(f,) for f in sorted(set(near))], "fingerprint long")
    want = sorted((a, b) for a in set(near) for b in set(near) if a < b and (a ^ b).bit_count() <= 4)
    for cuts, kept in ((3, 1), (6, 3), (5, 2)):
        assert plain(simhash.near_links(nodes, 4, cuts, kept), "u", "v") == sorted(want, key=repr)
    with pytest.raises(ValueError):
        simhash.near_links(nodes, 4, 2, 1)


def test_line_dedup(docs):
    lines = []
    for doc_id, text in rows_of(docs):
        order = xxh(text)
        for n, line in enumerate(text.split("\n") if text is not None else []):
            words = frozenset(re.findall(WORD, line))
            if words:
                lines.append(((doc_id is not None, doc_id or 0, order, n), words))

    def alike(a, b):
        common = len(a & b)
        return 5 * common >= 4 * (len(a) + len(b) - common)

    sets = {}
    for place, words in lines:
        sets[words] = min(place, sets.get(words, place))
    stays = {sets[a] for a in sets if not any(sets[b] < sets[a] and len(a) * 4 <= len(b) * 5 and alike(a, b) for b in sets)}
    want = []
    for doc_id, text in rows_of(docs):
        split = text.split("\n") if text is not None else []
        gone = [n for n, line in enumerate(split) if re.search(WORD, line) and (doc_id is not None, doc_id or 0, xxh(text), n) not in stays]
        want.append((doc_id, len(split), gone))
    assert plain(line_dedup.removed_lines(docs), "doc_id", "n_lines", "removed") == sorted(want, key=repr)
    texts = [(d, t if t is None or not g else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in g)) for (d, t), (_, _, g) in zip(rows_of(docs), want)]
    assert plain(line_dedup.without_repeated_lines(docs), "doc_id", "text") == sorted(texts, key=repr)


def test_line_dedup_of_long_near_copies(spark):
    rnd, rows = np.random.default_rng(5), []
    for n in (4, 5, 9, 30, 95, 100, 101, 106, 140, 260):
        base = [f"w{i}" for i in rnd.integers(0, 10**5, n)]
        for edits in (0, 0.05, 0.1, 0.11, 0.12, 0.2, 0.25):
            line = [w if rnd.random() >= edits else f"x{rnd.integers(0, 10**5)}" for w in base] + [f"y{i}" for i in rnd.integers(0, 10**5, int(rnd.integers(0, 1 + n // 9)))]
            rows.append(" ".join(line))
    order = rnd.permutation(len(rows))
    made = [(i, "\n".join([rows[order[i]], "", rows[order[i - 1]] + " z"]), "en", "a", i) for i in range(len(rows))]
    test_line_dedup(spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long"))


def test_lines_of_a_family_do_not_all_meet(spark, monkeypatch):
    rnd = np.random.default_rng(6)
    base, texts = [f"w{i}" for i in range(60)], []
    for _ in range(240):
        line = list(base)
        for at in rnd.integers(0, 60, 2):
            line[at] = f"x{rnd.integers(0, 10**6)}"
        texts.append(" ".join(line))
    counted, ordered = [], line_dedup._ordered
    monkeypatch.setattr(line_dedup, "_ordered", lambda *a: (made := ordered(*a), counted.append(made.count()))[0])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = line_dedup.removed_lines(docs).where("removed = array()").count()
    assert 1 <= kept < 24 and len(counted) == 1 and counted[0] < 240 * 24


def test_prefixes_are_not_sent_through_the_driver(spark, conf, documents):
    conf("spark.sql.autoBroadcastJoinThreshold", "10m")
    rows = line_dedup._rows(documents.select("doc_id", "text"))
    sets = staged(line_dedup._sets(rows, line_dedup.rarity_levels(rows), 4, 5)).withColumn("open", F.lit(True))
    pairs = line_dedup._candidates(sets, 4, 5)
    assert pairs.count() > 0
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_shuffle_files_are_let_go(spark, conf, documents):
    conf(RELEASE, "false")
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return {name for folder in manager.localDirs() for _, _, names in os.walk(folder.getPath()) for name in names if name.startswith("shuffle_")}

    before = shuffled()
    made, _ = staged_at(documents.repartition("doc_id"), release=True)
    for _ in range(50):  # executors are told, not waited for
        if not shuffled() - before:
            break
        time.sleep(0.2)
    assert not shuffled() - before and spark.conf.get(RELEASE) == "false"
    assert made.count() == documents.count()


def xxh(text):
    """The row hash that orders equal ids, as Spark computes it; ids alone order all but the messy rows."""
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    if text not in xxh.known:
        spark = SparkSession.getActiveSession()
        xxh.known[text] = spark.range(1).select(F.xxhash64(F.lit(1), F.lit(text).cast("string"))).first()[0]
    return xxh.known[text]


xxh.known = {}


def test_window_dedup(docs):
    rows = [(i, re.findall(WORD, t or "")) for i, t in rows_of(docs)]
    first = {}
    for doc_id, words in rows:
        for i in range(len(words) - 49):
            key, at = tuple(words[i : i + 50]), float("inf") if doc_id is None else doc_id
            first[key] = min(at, first.get(key, at))
    want = []
    for doc_id, words in rows:
        gone = set()
        for i in range(len(words) - 49):
            if first[tuple(words[i : i + 50])] < (float("inf") if doc_id is None else doc_id):
                gone.update(range(i, i + 50))
        want.append((doc_id, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    assert plain(window_dedup.without_repeated_windows(docs), "doc_id", "n_words", "n_removed", "text") == sorted(want, key=repr)


def test_suffix_dedup(docs):
    rows = [(i, (t or "").encode()) for i, t in rows_of(docs)]
    counts = Counter(hash(t[i : i + 200]) for _, t in rows for i in range(len(t) - 199))
    want = []
    for doc_id, text in rows:
        gone, reach = bytearray(len(text)), 0
        for i in range(len(text) - 199):
            if counts[hash(text[i : i + 200])] > 1:
                gone[max(i, reach) : i + 200] = b"\1" * (i + 200 - max(i, reach))
                reach = i + 200
        kept = bytes(c for c, g in zip(text, gone) if not g)
        want.append((doc_id, len(text), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    got = suffix_dedup.without_repeated_strings(docs).selectExpr("*", "sha2(kept, 256) AS h")
    assert plain(got, "doc_id", "n_bytes", "n_removed", "n_spans", "h") == sorted(want, key=repr)


def test_windows_across_parts_of_a_long_text(spark, monkeypatch):
    rnd = np.random.default_rng(2)
    text = "".join(map(chr, rnd.integers(97, 123, 5000)))
    docs = spark.createDataFrame([(1, text + text[1000:1300]), (2, text[4000:4205])], "doc_id long, text string")
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", 700)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 300)
    assert plain(suffix_dedup.without_repeated_strings(docs), "doc_id", "n_removed", "n_spans") == [(1, 300 + 205 + 300, 3), (2, 205, 1)]


@pytest.mark.parametrize("data", [b"", b"a", b"mississippi", b"banana" * 9, b"aaaaaaaa", b"\xff\x00" * 9, bytes(range(255, -1, -1)), b"abc" * 40 + b"\xff" + b"abc" * 39])
def test_suffix_array(data):
    array = np.frombuffer(data, np.uint8)
    order = suffix_array(array)
    want = sorted(range(len(data)), key=lambda i: data[i:])
    assert order.tolist() == want
    shared = permuted_common_prefixes(array, order)
    for a, b in zip(want, want[1:]):
        k = 0
        while max(a, b) + k < len(data) and data[a + k] == data[b + k]:
            k += 1
        assert shared[b] == k


def test_section_tokens(docs):
    from tokenizers import Tokenizer

    known, want = Tokenizer.from_file(default_tokenizer()), []
    for doc_id, text in rows_of(docs):
        lines = text.split("\n") if text is not None else []
        starts = np.cumsum([0, *[len(x) + 1 for x in lines]])[: len(lines)].tolist()
        counts = [0] * (len(lines) + 1)
        for a, b in known.encode(text or "", add_special_tokens=False).offsets:
            shares = [max(0, min(b, s + len(x)) - max(a, s)) for s, x in zip(starts, lines)]
            counts[shares.index(max(shares)) if any(shares) else -1] += 1
        want += [(doc_id, n, s, s + len(x), c) for n, (s, x, c) in enumerate(zip(starts, lines, counts))]
        want.append((doc_id, -1, None, None, counts[-1]))
    assert plain(attribution.section_tokens(docs), "doc_id", "section", "start", "end", "n_tokens") == sorted(want, key=repr)


def test_given_sections_and_rules(spark):
    docs = spark.createDataFrame(
        [(1, "hello world again", [(0, 8), (8, 99), None, (3, 5)]), (2, None, None), (3, "abc", None)],
        "doc_id long, text string, fields array<struct<start:int,end:int>>",
    )
    split = attribution.section_tokens(docs, "fields", "split").where("doc_id = 1").orderBy("section")
    assert [round(r.n_tokens, 6) for r in split.collect()] == [0, 1.5, 1.5, 0]
    first = attribution.section_tokens(docs, "fields", "first").where("doc_id = 1").orderBy("section")
    assert [r.n_tokens for r in first.collect()] == [0, 2, 1, 0]
    rest = attribution.section_tokens(docs, "fields").where("doc_id > 1").orderBy("doc_id")
    assert [(r.doc_id, r.section, r.n_tokens) for r in rest.collect()] == [(2, -1, 0), (3, -1, 1)]
    with pytest.raises(ValueError):
        attribution.section_tokens(docs, rule="none")


def test_tokens_are_those_of_the_tokenizers_library(messy):
    from tokenizers import Tokenizer

    known, fast = Tokenizer.from_file(default_tokenizer()), tokenizer(default_tokenizer())
    for _, text in rows_of(messy):
        assert fast.ids(text or "").tolist() == known.encode(text or "", add_special_tokens=False).ids
