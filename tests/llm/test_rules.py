"""Quality rules: counts against plain Python, the regression on held-out labels, odd tables."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import WORD, plain

from logloom.llm import rules
from logloom.llm.queries import QUERIES


def counted(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    text = text or ""
    words, seen, again = re.findall(WORD, text), set(), 0
    for line in text.split("\n"):
        if re.search(WORD, line):
            again += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + step for i, w in enumerate(windows) if often[w] > 1 for step in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(covered)


def grams_of(text):
    """Shares of each kind of n-gram."""
    text = text or ""
    words = [w.encode() for w in re.findall(WORD, text)]
    kinds = [words, list(zip(words, words[1:])), [text[i : i + 3] for i in range(len(text) - 2)], [text[i : i + 4] for i in range(len(text) - 3)]]
    return [{g: c / len(k) for g, c in Counter(k).items()} for k in kinds]


LABELS = [(6, 1, 0), (7, 1, 0), (8, 1, 0), (None, 0, 1), (11, 0, 0), (11, 0, 0), (12, None, 0), (13, 0, 0), (14, 0, 1), (100, 1, 0), (103, 1, 1), (9999, 0, 0)]


@pytest.mark.parametrize("name", ["documents", "messy", "odd", "empty"])
def test_counts(request, spark, name):
    docs = request.getfixturevalue(name)
    labels = spark.createDataFrame([(*r, "x", 1.0) for r in LABELS], "doc_id long, quality int, toxic int, text string, label double")
    made = rules.judge(docs, labels)
    want = sorted(((r["doc_id"], *counted(r["text"])) for r in docs.select("doc_id", "text").collect()), key=repr)
    assert plain(made, "doc_id", *rules.MEASURES) == want
    for r in made.collect():
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed and 0 <= r["probability"] <= 1
        assert r["kept"] == (not failed and r["probability"] >= 0.5)


def test_lines_and_repeats():
    texts = ["a\na\n\n \na", "a\n a\na \na", "x y z x y z", "x x x x", "a b c\nd a b c", "", None, "\n", "a\r\na\r", "é 日本 😀"]
    made = list(zip(*rules.Texts(pa.array(texts)).measures()))
    assert [tuple(map(int, m)) for m in made] == [counted(t) for t in texts]


def test_n_grams(monkeypatch):
    """As many bins as n-grams, with their shares; the same in slices, and margins are sums over features."""
    texts = ["ab ab cd\nab cd", "aé日😀 aé日😀", "", None, "a", "the cat the cat sat", "abcdefgh" * 50, "ab ab cd\nab cd"]
    whole = rules.Texts(pa.array(texts))
    rows, bins, shares = whole.features()
    for i, text in enumerate(texts):
        got = [sorted(shares[(rows == i) & (bins >> rules.BLOCK_BITS == b)].round(9)) for b in range(4)]
        assert got == [sorted(np.round(list(k.values()), 9)) for k in grams_of(text)]
    assert (bins[rows == 0] == bins[rows == 7]).all()
    weights = np.random.default_rng(1).normal(size=rules.BINS)
    margins = whole.margins(weights, 0.5)
    assert margins == pytest.approx(0.5 + np.bincount(rows, weights[bins] * shares, len(texts)))
    monkeypatch.setattr(rules, "SLICE", 7)
    assert rules.Texts(pa.array(texts)).margins(weights, 0.5) == pytest.approx(margins)


def test_minimum_and_calibration():
    rnd = np.random.default_rng(2)
    a = rnd.normal(size=(30, 12))
    b = rnd.normal(size=30)
    found = rules.minimum(lambda x: (float(((a @ x - b) ** 2).sum()), 2 * a.T @ (a @ x - b)), np.zeros(12), steps=100)
    assert found == pytest.approx(np.linalg.lstsq(a, b, rcond=None)[0], abs=1e-2)
    margins = rnd.normal(size=20000)
    labels = (rnd.uniform(size=20000) < 1 / (1 + np.exp(-(2 * margins - 1)))).astype(float)
    assert rules.calibrated(margins, labels) == pytest.approx((2, -1), abs=0.1)


def test_little_to_learn_from(spark, messy):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    for some, probability in ((labels.limit(0), 1.0), (labels.where("quality = 1"), 1.0), (labels.where("quality = 0"), 0.0)):
        rows = rules.judge(messy, some).collect()
        assert len(rows) == messy.count() and {round(r["probability"], 6) for r in rows} == {probability}


def test_held_out_labels(spark):
    """The verdicts on labelled documents that nothing was learnt from, and that the probabilities are what they say."""
    folder = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op13_quality_rules"](spark, folder).collect() if r["doc_id"] in labels and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert len(rows) > 500
    sure = [r for r in rows if not r["base_failed"]]
    right = [(r["probability"] >= 0.5) == (labels[r["doc_id"]] == 1) for r in sure]
    assert np.mean(right) > 0.95
    good = [r["kept"] for r in sure if labels[r["doc_id"]] == 1]
    assert np.mean(good) > 0.97
    assert abs(np.mean([r["probability"] for r in rows]) - np.mean([labels[r["doc_id"]] for r in rows])) < 0.03
