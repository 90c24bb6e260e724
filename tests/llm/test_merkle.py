"""Merkle manifest: the store, descents from the root, tampered rows."""

from __future__ import annotations

from collections import Counter, defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from logloom.llm import merkle
from logloom.llm.queries import QUERIES


def h(text) -> str:
    return sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def leaf_of(doc_id, text, lang, source, n_chars) -> str:
    parts = [None if v is None else str(v).encode() for v in (doc_id, source, lang, n_chars, text)]
    return h(b"".join(b"-" if p is None else str(len(p)).encode() + b":" + p for p in parts))


def levels_of(nodes):
    """All levels of a tree, its leaves first."""
    made = [nodes]
    while len(made[-1]) > 1:
        made.append([h("".join(made[-1][i : i + 3])) for i in range(0, len(made[-1]), 3)])
    return made


def path_of(levels, rank):
    """Per level what stands before and after the node of a leaf in its run."""
    steps = []
    for nodes in levels[:-1]:
        first = rank - rank % 3
        steps.append(("".join(nodes[first:rank]), "".join(nodes[rank + 1 : first + 3])))
        rank //= 3
    return steps


def brute(rows):
    """(doc_id, leaf, subroot, root, steps) of every row."""
    by_source = defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        by_source[source].append((doc_id is not None, doc_id or 0, leaf_of(doc_id, text, lang, source, n_chars), doc_id))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = [levels_of([leaf for _, _, leaf, _ in sorted(by_source[s], key=lambda r: r[:3])]) for s in names]
    top, made = levels_of([t[-1][0] for t in trees]), []
    for at, (name, levels) in enumerate(zip(names, trees)):
        for rank, (_, _, leaf, doc_id) in enumerate(sorted(by_source[name], key=lambda r: r[:3])):
            made.append((doc_id, leaf, levels[-1][0], top[-1][0], tuple(path_of(levels, rank) + path_of(top, at))))
    return made


COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(docs):
    return [tuple(r) for r in docs.select(*COLUMNS).collect()]


def unchanged(docs):
    return merkle.verified(docs, F.lit(None).cast("string"))


@pytest.mark.parametrize("name", ["documents", "messy", "odd", "empty"])
def test_proofs(request, name):
    docs = request.getfixturevalue(name)
    made = unchanged(docs).collect()
    got = Counter((r["doc_id"], r["leaf"], r["subroot"], r["root"], tuple((s["before"], s["after"]) for s in r["steps"])) for r in made)
    assert got == Counter(brute(rows_of(docs)))
    assert all(r["verified"] and r["folded_root"] == r["root"] for r in made)


def test_trees_of_many_heights(spark):
    """One source of many segments, one of a single leaf, and more sources than a segment has leaves."""
    large = [(i, f"text {i}", "en", "large", i) for i in range(1100)]
    rows = large + [(5000 + i, "x", None, f"s{i}", None) for i in range(300)] + [(9, None, None, None, None)] * 4
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(7)
    got = Counter((r["doc_id"], r["leaf"], r["subroot"], r["root"], tuple((s["before"], s["after"]) for s in r["steps"])) for r in unchanged(docs).collect())
    assert got == Counter(brute(rows))


def test_one_document_is_its_own_root(spark):
    docs = spark.createDataFrame([(1, "a", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    row = unchanged(docs).first()
    assert row["leaf"] == row["subroot"] == row["root"] == leaf_of(1, "a", "en", "s", 1) and row["steps"] == []


def test_some_requests_only(spark, documents):
    """Proofs of a few leaves by rank, as a reader of the manifest asks for them."""
    found = merkle.manifest(documents)
    some = found.leaves.where("rank % 7 = 3").select("doc_id", "tree", "rank")
    made = merkle.proofs(found, some).select("request.doc_id", "steps", merkle.hex_text(F.col("leaf")).alias("leaf")).collect()
    want = {r[0]: r for r in brute(rows_of(documents))}
    assert len(made) == some.count() > 0
    for r in made:
        assert r["leaf"] == want[r["doc_id"]][1] and tuple((s["before"], s["after"]) for s in r["steps"]) == want[r["doc_id"]][4]


def test_store_is_addressed_by_content(spark, documents):
    """Every record stands under the digest of its children, and equal segments are one record."""
    found = merkle.manifest(documents.unionByName(documents))
    for store in found.stores + found.top:
        for row in store.collect():
            for digest, children in row["records"].items():
                assert bytes(digest) == sha256(bytes(children).hex().encode()).digest()


def test_tampering_is_found(spark):
    import zlib

    rows = {r["doc_id"]: r for r in QUERIES["op11_merkle_manifest"](spark, "/root/testdata/sf0.001").collect()}
    docs = {r["doc_id"]: r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    want = {r[0]: r for r in brute([tuple(docs[i][c] for c in COLUMNS) for i in docs])}
    assert set(rows) == set(docs)
    for i, row in rows.items():
        text = docs[i]["text"]
        touched = zlib.crc32(str(i).encode()) % 2 == 0 and "\n" in (text or "")
        node = leaf_of(i, text.replace("\n", ""), docs[i]["lang"], docs[i]["source"], docs[i]["n_chars"]) if touched else want[i][1]
        for before, after in want[i][4]:
            node = h(before + node + after)
        assert row["folded_root"] == node and row["verified"] == (not touched)
        assert row["proof_sha256"] == h("".join(b + a for b, a in want[i][4]))
