"""Vector codes against plain k-means, and what the metric trees promise."""

from __future__ import annotations

import math
from hashlib import sha256

import numpy as np
import pytest
from compare import differences, oracle_connection

from logloom.llm import codebooks
from logloom.llm.codebooks import MetricTree
from logloom.llm.queries import ORACLES, QUERIES


def shapes():
    rnd = np.random.default_rng(3)
    yield rnd.integers(-900, 900, (500, 4))
    yield rnd.integers(-5, 5, (3000, 3)) + 40 * rnd.integers(-9, 9, (12, 3))[rnd.integers(0, 12, 3000)]
    yield np.repeat(rnd.integers(-9, 9, (5, 2)), 200, axis=0)
    yield np.zeros((400, 2), np.int64)
    yield rnd.integers(-(2**24), 2**24, (300, 5))
    yield np.array([[3, 4]])


@pytest.mark.parametrize("x", list(shapes()), ids=lambda x: str(x.shape))
def test_tree(x):
    tree = MetricTree.from_bytes(MetricTree.over(x).to_bytes())
    assert sorted(tree.order) == list(range(len(x)))
    for ball in range(len(tree.begin)):
        rows = x[tree.order[tree.begin[ball] : tree.end[ball]]]
        assert (rows.sum(0) == tree.sums[ball]).all()
        assert np.sqrt(((rows - rows.mean(0)) ** 2).sum(1)).max() <= tree.radius[ball]
        if tree.left[ball] >= 0:
            one, two = tree.left[ball], tree.right[ball]
            assert (tree.begin[ball], tree.end[one], tree.end[ball]) == (tree.begin[one], tree.begin[two], tree.end[two])
    entries = np.concatenate([x[:: max(1, len(x) // 20)], x[:3], x[:1] + 1])  # ties among equal entries too
    want = ((x[:, None, :].astype(object) - entries[None].astype(object)) ** 2).sum(-1).argmin(1)
    assert (tree.nearest(x, entries) == want).all()
    sums, counts = tree.totals(x, entries)
    assert (counts == np.bincount(want, minlength=len(entries))).all()
    assert all((sums[j] == x[want == j].sum(0)).all() for j in range(len(entries)))


def test_balls_are_owned_as_a_whole():
    """In well parted data nearly all rows are counted by balls and never looked at."""
    rnd = np.random.default_rng(5)
    centres = rnd.integers(-4000, 4000, (10, 8))
    x = centres[rnd.integers(0, 10, 4000)] + rnd.integers(-20, 20, (4000, 8))
    tree = MetricTree.over(x)
    (balls, _), (rows, _) = tree.owners(x, centres)
    assert len(balls) < 100 and len(rows) == 0


def brute(rows, parts, entries, rounds):
    """rows: (id, vector, label), all of them fine."""
    kept = sorted(((i is None, i or 0, [math.floor(1024 * c) for c in v], label, i) for i, v, label in rows), key=lambda r: r[:3])
    x = np.array([r[2] for r in kept], np.int64)
    width, codes, error, books = x.shape[1] // parts, [], np.zeros(len(x), np.int64), []
    for p in range(parts):
        q = x[:, p * width : (p + 1) * width]
        book = q[:entries].copy()
        for step in range(rounds + 1):
            away = ((q[:, None, :] - book[None]) ** 2).sum(-1)
            found = away.argmin(1)
            if step < rounds:
                for j in range(len(book)):
                    if (found == j).any():
                        book[j] = [int(s) // int((found == j).sum()) for s in q[found == j].sum(0)]
        codes.append(found)
        error += away[np.arange(len(x)), found]
        books += book.ravel().tolist()
    by_label = {}
    for r, e in zip(kept, error.tolist()):
        by_label[r[3]] = by_label.get(r[3], 0) + e
    made = [(r[4], "".join(f"{c[i]:02x}" for c in codes), int(error[i]), by_label[r[3]]) for i, r in enumerate(kept)]
    return sorted(made, key=repr), sha256(",".join(map(str, books)).encode()).hexdigest()


def given(found, books):
    return sorted(((r["id"], r["code"], r["error"], r["label_error"]) for r in found.collect()), key=repr), codebooks.books_digest(books)


def test_codes(spark):
    rnd = np.random.default_rng(9)
    x = (rnd.normal(size=(900, 12)) + 4 * rnd.normal(size=(15, 12))[rnd.integers(0, 15, 900)]).astype(np.float32)
    x[300:600] = x[300]  # a third are copies
    rows = [(i, v.tolist(), int(i) % 3 if i % 5 else None) for i, v in enumerate(x)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    assert given(*codebooks.compress(table, parts=3, entries=40, rounds=3)) == brute(rows, 3, 40, 3)


def test_odd_vectors(spark):
    """NULL, non-finite and misfit vectors go; copies, NULL ids and labels stay; more columns than needed, with clashing names."""
    inf, nan = float("inf"), float("nan")
    fine = [(5, [0.1, -0.1, 2.0, 0.0], 1), (5, [0.1, -0.1, 2.0, 0.0], 1), (5, [0.0, 0.0, 0.0, 0.0], None), (None, [1.0, 1.0, -1.0, 0.5], 2), (1, [-0.0001, 3.0, 0.25, 9.0], None)]
    bad = [(2, None, 1), (3, [None, 1.0, 1.0, 1.0], 1), (4, [nan, 1.0, 1.0, 1.0], 1), (6, [inf, 1.0, 1.0, 1.0], 1), (7, [1.0, -inf, 1.0, 1.0], 1), (8, [], 1), (9, [1.0, 1.0, 1.0], 1), (10, [1.0] * 8, 1)]
    table = spark.createDataFrame([(*r, "x", 7, 1.0) for r in fine + bad], "vec_id long, embedding array<double>, label int, v string, id int, error double")
    for entries in (2, 256):
        assert given(*codebooks.compress(table, parts=2, entries=entries, rounds=2)) == brute(fine, 2, entries, 2)
    huge = spark.createDataFrame([(0, [1e30, -1e30], 0), (1, [0.0, 0.0], 0)], "vec_id long, embedding array<double>, label int")
    found, books = codebooks.compress(huge, parts=2)
    assert books.ravel().tolist() == [2**24, 0, -(2**24), 0] and {r["error"] for r in found.collect()} == {0}


def test_no_vectors(spark):
    table = spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int")
    for rows in (table, table.limit(0)):
        found, books = codebooks.compress(rows)
        assert found.count() == 0 and found.columns == ["id", "label", "code", "error", "label_error"] and not books.size


def test_query_against_sql(spark):
    folder = "/root/testdata/sf0.01"
    name = "op12_vector_codes"
    assert differences(spark, oracle_connection(folder), name, folder, QUERIES[name], ORACLES[name]) == []
