"""Quality scores, mixing, packing and nearest neighbours."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest_llm import WORD, plain

from logloom.llm import mixing, nearest, packing, quality
from logloom.llm.additive import fit
from logloom.llm.queries import QUERIES
from logloom.llm.tokens import default_tokenizer


@pytest.fixture(params=["documents", "messy", "odd", "empty"])
def docs(request):
    return request.getfixturevalue(request.param)


def test_additive_model_learns_shapes_and_interactions():
    rnd = np.random.default_rng(1)
    x = rnd.uniform(-1, 1, (6000, 4))
    y = ((x[:, 0] ** 2 < 0.2) | (x[:, 1] * x[:, 2] > 0.2)).astype(float)
    model = fit(x[:4000], y[:4000])
    assert np.mean((model.score(x[4000:]) >= 0.5) == y[4000:]) > 0.9
    assert (1, 2) in model.pairs


def test_models_of_little():
    assert fit(np.zeros((0, 3)), np.zeros(0)).score(np.zeros((2, 3))).tolist() == [1, 1]
    assert (fit(np.zeros((9, 3)), np.ones(9)).score(np.ones((2, 3))) > 0.9).all()


def test_quality_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = QUERIES["op2_quality_scores"](spark, folder).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in held) > 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)


def test_scores_are_sums_of_table_entries(spark):
    """Every score read off the lookup tables by hand."""
    from bisect import bisect_right
    from math import exp

    folder = "/root/testdata/sf0.01"
    docs, labels = [spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels")]
    measured = quality.document_features(docs).cache()
    model = quality.learn(measured, labels)
    assert len(model.tables) == len(quality.FEATURES) and model.pairs
    made = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    for r in measured.collect():
        x = [r[name] for name in quality.FEATURES]
        total = model.intercept + sum(table[bisect_right(list(edges), v)] for edges, table, v in zip(model.edges, model.tables, x))
        for (i, j), table in zip(model.pairs, model.pair_tables):
            total += table[bisect_right(list(model.pair_edges[i]), x[i])][bisect_right(list(model.pair_edges[j]), x[j])]
        score = 1 / (1 + exp(-min(max(total, -500), 500)))
        assert made[r["doc_id"]]["score"] == pytest.approx(score, rel=1e-9) and made[r["doc_id"]]["predicted"] == (score >= 0.7)
    measured.unpersist()


def test_quality_of_messy_documents(spark, docs):
    labels = spark.createDataFrame([(6, 1, 0), (7, 1, 0), (None, 0, 1), (11, 0, 0), (11, 0, 0), (12, None, 0), (100, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.classify(docs, labels).count() == docs.count()
    assert quality.accepted(docs, labels).columns == ["doc_id", "text", "lang", "source", "n_chars"]
    none = labels.limit(0)
    assert {r["score"] for r in quality.classify(docs, none).collect()} <= {1.0}
    assert quality.accepted(docs, none).count() == docs.count()


def test_mix(docs):
    rows = [(r["doc_id"], r["source"], len(re.findall(WORD, r["text"] or ""))) for r in docs.select("doc_id", "source", "text").collect()]
    sizes = defaultdict(int)
    for _, source, size in rows:
        sizes[source] += size
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    targets, open_sources, left = {}, set(names), 1.5 * sum(sizes.values())
    while open_sources:
        share = left / sum(weight[s] for s in open_sources)
        over = {s for s in open_sources if share * weight[s] >= 2 * sizes[s]}
        for s in over or open_sources:
            targets[s] = 2 * sizes[s] if over else share * weight[s]
            left -= targets[s] if over else 0
        open_sources -= over or open_sources
    made = mixing.mix(docs).collect()
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in made) == Counter(rows)
    taken = defaultdict(int)
    for r in made:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(targets[r["source"]])
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - targets[s]) <= 0.5 for s in names)
    assert plain(mixing.mix(docs), "doc_id", "size", "taken") == sorted(((r["doc_id"], r["size"], r["taken"]) for r in made), key=repr)
    texts = defaultdict(int)
    for r in mixing.mixed_documents(docs).collect():
        texts[r["source"]] += len(re.findall(WORD, r["text"]))
    assert {s: n for s, n in taken.items() if n} == dict(texts)


def test_packing(docs):
    from tokenizers import Tokenizer

    known, want = Tokenizer.from_file(default_tokenizer()), []
    for row in docs.select("doc_id", "text").collect():
        ids = np.array([*known.encode(row["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        want += [(row["doc_id"], n, a, b - a, zlib.crc32(ids[a:b].tobytes())) for n, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    made = packing.packed_documents(docs).collect()
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in made), key=repr) == sorted(want, key=repr)
    whole = packing.sequences(docs).collect()
    assert sum(len(r["ids"]) for r in whole) == sum(w[3] for w in want)
    assert Counter(x for r in whole for x in r["ids"])[2] >= docs.count()
    check_sequences([(r["sequence_id"], r["offset"], r["length"]) for r in made])


def check_sequences(rows, length=1024):
    by_sequence = defaultdict(list)
    for sequence, offset, size in rows:
        by_sequence[sequence].append((offset, size))
    for parts in by_sequence.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= length
    return len(by_sequence)


def test_packing_in_rounds(spark):
    rnd = np.random.default_rng(4)
    sizes = [*rnd.integers(1, 1025, 3000).tolist(), *[600] * 500, *[1024] * 9]
    items = spark.createDataFrame([(i, 0, 0, int(s), 0) for i, s in enumerate(sizes)], packing.PIECE)
    made = packing.pack(items, chunk=200).collect()
    assert sorted(r["doc_id"] for r in made) == list(range(len(sizes)))
    bins = check_sequences([(r["sequence_id"], r["offset"], r["length"]) for r in made])
    assert bins <= 1.05 * max(sum(sizes) / 1024, sum(s > 512 for s in sizes))


def brute_nearest(rows, n):
    rows = [(i, np.array(v, float)) for i, v in rows]
    found = []
    for q, (i, v) in enumerate(rows):
        if i is not None and i % 20 == 0:
            others = sorted((-float((v * w).sum()), j is None, j or 0) for k, (j, w) in enumerate(rows) if k != q)
            found.append((i, [(-s, None if none else j) for s, none, j in others[:n]]))
    return found


def test_nearest_neighbours_of_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 2.0]), (3, [-1.0, 1.0]), (None, [9.0, 1.0]), (40, [0.0, 3.0]), (40, [0.0, 3.0])]
    bad = [(4, None), (60, [0.0, 0.0]), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [1.0]), (9, [])]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows + bad], "vec_id long, embedding array<float>, uid string, leaf int")
    made = defaultdict(list)
    for r in nearest.nearest_neighbours(table, nearest=5).orderBy("query_id", "rank").collect():
        made[r["query_id"]].append((r["score"], r["id"]))
    want = defaultdict(list)
    for i, found in brute_nearest(rows, 5):
        want[i] += found
    assert {i: sorted(f, key=repr) for i, f in made.items()} == {i: sorted(f, key=repr) for i, f in want.items()}
    few = nearest.nearest_neighbours(table.where("vec_id < 2"), nearest=20).orderBy("query_id", "rank")
    assert [(r["query_id"], r["rank"], r["id"]) for r in few.collect()] == [(0, 1, 1)]
    assert nearest.nearest_neighbours(table.limit(0)).count() == 0


def test_recall_and_ties(spark):
    rnd = np.random.default_rng(8)
    x = rnd.normal(size=(3000, 16)) + 3 * rnd.normal(size=(30, 16))[rnd.integers(0, 30, 3000)]
    x[1000:2200] = x[1000]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    made = defaultdict(list)
    for r in nearest.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect():
        made[r["query_id"]].append((r["score"], r["id"]))
    hits = 0
    want = brute_nearest(rows, 20)
    for i, found in want:
        assert len(made[i]) == 20 and made[i] == sorted(made[i], key=lambda p: (-p[0], p[1]))
        hits += len({j for _, j in found} & {j for _, j in made[i]})
        if 1000 <= i < 2200:
            assert [j for _, j in made[i]] == [j for _, j in found]
    assert hits >= 0.9 * 20 * len(want)


def test_enough_leaves_for_all_that_are_wanted():
    """Visits go on past the calibrated number while too few vectors have been seen."""
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(900, 4))
    tree = nearest.grow(x, branches=4, leaf_rows=8)
    rows = np.bincount(tree.assign(x), minlength=tree.leaves).tolist()
    for q in x[:20]:
        few = tree.visits(q, 1, rows, 21)
        assert few == tree.visits(q, len(few)) and sum(rows[leaf] for leaf in few) >= 21 > sum(rows[leaf] for leaf in few[:-1])
        assert len(tree.visits(q, 1, rows, 10**6)) == tree.leaves


def test_recall_on_the_given_embeddings(spark):
    """Queries divisible by 50 against all rows, held against brute force."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect() if r["embedding"] is not None]
    rows = [(i, np.array(v, float)) for i, v in rows if all(c is not None and np.isfinite(c) for c in v) and any(v)]
    ids, x = np.array([i for i, _ in rows]), np.stack([v for _, v in rows])
    made = defaultdict(set)
    for r in nearest.nearest_neighbours(table, is_query=lambda i: i % 50 == 0).collect():
        made[r["query_id"]].add(r["id"])
    hits = total = 0
    for i, v in rows:
        if i % 50 == 0:
            scores = np.where(ids == i, -np.inf, x @ v)
            want = set(ids[np.lexsort((ids, -scores))[:20]].tolist())
            assert len(made[i]) == 20
            hits, total = hits + len(made[i] & want), total + 20
    assert total and hits >= 0.9 * total
