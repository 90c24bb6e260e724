"""The registered queries of the operators, each with equivalent SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import attribution, codebooks, fingerprints, line_dedup, merkle, mixing, nearest, packing, quality, rules, simhash, suffix_dedup, window_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register `fn(table)`; `table(name)` reads one of the given tables."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || md5('mix:' || doc_id)[1:15])::BIGINT AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight, source_size * 2.0::DOUBLE AS lim FROM s),
r AS (SELECT *, ((SELECT sum(source_size) FROM s)::DOUBLE * 1.5
                - coalesce(sum(lim) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
               / sum(weight) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM w),
t AS (SELECT source, source_size, CASE WHEN level >= lim / weight THEN lim
             ELSE (SELECT max(level) FROM r WHERE level < lim / weight) * weight END AS target FROM r),
o AS (SELECT d.*, source_size, target, round(target)::BIGINT AS budget, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS epochs,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, budget - epochs * source_size - ahead)))::BIGINT AS taken
FROM o"""


@query("op7_source_mix", MIX_SQL)
def _source_mix(table) -> DataFrame:
    """How often each document is taken in the mix of all sources."""
    return mixing.mix(table("documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op10_simhash_groups")
def _simhash_groups(table) -> DataFrame:
    """Every document's fingerprint and the least document of its group."""
    found = simhash.near_duplicates(table("documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


@query("op2_quality_scores")
def _quality_scores(table) -> DataFrame:
    """Every document's quality score and what it predicts."""
    return quality.classify(table("documents"), table("labels"))


LINES_SQL = r"""
WITH l AS (SELECT doc_id, unnest(list_zip(range(len(x)), x)) AS z FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
t AS (SELECT doc_id, z[1] AS line_no, list_sort(list_distinct(regexp_extract_all(z[2], '[^\x20\x09-\x0D]+'))) AS toks FROM l),
s AS (SELECT toks, min((doc_id, line_no)) AS place, row_number() OVER () AS id, len(toks) AS n FROM t WHERE len(toks) > 0 GROUP BY toks),
w AS (SELECT id, n, unnest(toks) AS w FROM s),
f AS (SELECT w, count(*) AS c FROM w GROUP BY w),
p AS (SELECT * FROM (SELECT id, n, w.w, row_number() OVER (PARTITION BY id ORDER BY c, w.w) AS r FROM w JOIN f USING (w)) WHERE r <= n - (4 * n + 4) // 5 + 1),
k AS (SELECT DISTINCT a.id AS a, b.id AS b FROM p a JOIN p b ON a.w = b.w AND a.id < b.id AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
m AS (SELECT CASE WHEN x.place > y.place THEN x.id ELSE y.id END AS id FROM k JOIN s x ON x.id = k.a JOIN s y ON y.id = k.b
      WHERE 5 * len(list_intersect(x.toks, y.toks)) >= 4 * (x.n + y.n - len(list_intersect(x.toks, y.toks)))),
g AS (SELECT t.*, len(t.toks) > 0 AND ((t.doc_id, t.line_no) <> s.place OR s.id IN (SELECT id FROM m)) AS gone FROM t LEFT JOIN s ON s.toks = t.toks)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_removed,
       coalesce(string_agg(line_no::VARCHAR, ',' ORDER BY line_no) FILTER (gone), '') AS removed_lines
FROM g GROUP BY doc_id"""


@query("op3_line_dedup", LINES_SQL)
def _line_dedup(table) -> DataFrame:
    """Which lines of each document repeat an earlier one."""
    found = line_dedup.removed_lines(table("documents"))
    return found.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.array_join("removed", ",").alias("removed_lines"))


@query("op8_best_fit_packing")
def _best_fit_packing(table) -> DataFrame:
    """Every document's pieces and their places in sequences of 1024 tokens."""
    return packing.packed_documents(table("documents"))


@query("op9_i_match")
def _i_match(table) -> DataFrame:
    """Every document's fingerprint and that of its edited text, with their likeness and that to the next document's."""
    found = fingerprints.edited_likeness(table("documents"))
    return found.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprints.as_text(F.col("tags")).alias("fingerprint"),
        fingerprints.as_text(F.col("edited_tags")).alias("edited_fingerprint"), "near_edited", "near_next",
    )


WINDOWS_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS x FROM documents),
p AS (SELECT doc_id, len(x) AS n, unnest(range(1, len(x) - 48)) AS i, x FROM w WHERE len(x) >= 50),
s AS (SELECT doc_id, i, md5(array_to_string(x[i : i + 49], ' ')) AS h FROM p),
m AS (SELECT h, min(doc_id) AS least FROM s GROUP BY h HAVING min(doc_id) < max(doc_id)),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS at FROM s JOIN m USING (h) WHERE doc_id > least),
t AS (SELECT doc_id, unnest(x) AS word, unnest(range(1, len(x) + 1)) AS at FROM w),
k AS (SELECT t.doc_id, string_agg(word, ' ' ORDER BY t.at) AS kept, count(*) AS n FROM t ANTI JOIN g ON g.doc_id = t.doc_id AND g.at = t.at GROUP BY t.doc_id)
SELECT w.doc_id, len(x)::BIGINT AS n_words, (len(x) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON k.doc_id = w.doc_id"""


@query("op4_window_dedup", WINDOWS_SQL)
def _window_dedup(table) -> DataFrame:
    """What is left of each document without the passages of earlier ones."""
    found = window_dedup.without_repeated_windows(table("documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query("op6_suffix_dedup")
def _suffix_dedup(table) -> DataFrame:
    """What is left of each document's bytes without strings that occur elsewhere."""
    found = suffix_dedup.without_repeated_strings(table("documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op5_nearest_neighbours")
def _nearest_neighbours(table) -> DataFrame:
    """The 20 nearest rows of every twentieth vector."""
    found = nearest.nearest_neighbours(table("embeddings"))
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


@query("op1_section_tokens")
def _section_tokens(table) -> DataFrame:
    """How many tokens each line of each document has, of one encoding of the whole text."""
    return attribution.section_tokens(table("documents"))


MANIFEST_SQL = r"""
WITH RECURSIVE d AS (
  SELECT *, concat(
      coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'),
      coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head,
    xor(4294967295::BIGINT, list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
      lambda acc, b: list_reduce([xor(acc, b), 0, 0, 0, 0, 0, 0, 0, 0],
        lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END))) AS crc
  FROM documents),
l AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN crc % 2 = 0 THEN sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) END AS other
  FROM d),
s AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM l GROUP BY source),
k AS (SELECT l.*, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank FROM l JOIN s ON l.source IS NOT DISTINCT FROM s.source),
n AS (
  SELECT tree, 0 AS level, rank, leaf AS digest, count(*) OVER (PARTITION BY tree) AS size FROM k
  UNION ALL
  SELECT tree, level + 1, rank // 3, sha256(string_agg(digest, '' ORDER BY rank)), any_value((size + 2) // 3) FROM n WHERE size > 1 GROUP BY tree, level, rank // 3),
m AS (
  SELECT 0 AS level, tree AS rank, digest, (SELECT count(*) FROM s) AS size FROM n WHERE size = 1
  UNION ALL
  SELECT level + 1, rank // 3, sha256(string_agg(digest, '' ORDER BY rank)), any_value((size + 2) // 3) FROM m WHERE size > 1 GROUP BY level, rank // 3),
a AS (SELECT tree, level, rank, digest, max(level) OVER (PARTITION BY tree) AS height FROM n UNION ALL SELECT -1, level, rank, digest, max(level) OVER () FROM m),
g AS (SELECT tree, level, rank // 3 AS run, string_agg(digest, '' ORDER BY rank) AS digests FROM a WHERE level < height GROUP BY tree, level, rank // 3),
p AS (
  SELECT k.tree, k.rank, g.level, digests, rank // (3 ** level)::BIGINT % 3 AS place FROM k JOIN g ON g.tree = k.tree AND g.run = rank // (3 ** (level + 1))::BIGINT
  UNION ALL
  SELECT k.tree, k.rank, 100 + g.level, digests, k.tree // (3 ** level)::BIGINT % 3 FROM k JOIN g ON g.tree = -1 AND g.run = k.tree // (3 ** (level + 1))::BIGINT),
q AS (
  SELECT tree, rank, sha256(coalesce(string_agg(left(digests, 64 * place) || substr(digests, 64 * place + 65), '' ORDER BY level), '')) AS proof,
    list((left(digests, 64 * place), substr(digests, 64 * place + 65)) ORDER BY level) AS steps
  FROM p GROUP BY tree, rank),
f AS (
  SELECT k.tree, k.rank, coalesce(other, leaf) AS node, steps, 1 AS step FROM k LEFT JOIN q ON k.tree = q.tree AND k.rank = q.rank
  UNION ALL
  SELECT tree, rank, sha256(steps[step][1] || node || steps[step][2]), steps, step + 1 FROM f WHERE step <= len(steps)),
r AS (SELECT tree, rank, node FROM f WHERE step = coalesce(len(steps), 0) + 1)
SELECT doc_id, leaf, sub.digest AS subroot, top.digest AS root, coalesce(proof, sha256('')) AS proof_sha256, node AS folded_root, node = top.digest AS verified
FROM k JOIN r ON k.tree = r.tree AND k.rank = r.rank LEFT JOIN q ON k.tree = q.tree AND k.rank = q.rank
  JOIN n AS sub ON sub.tree = k.tree AND sub.size = 1 JOIN m AS top ON top.size = 1"""


@query("op11_merkle_manifest", MANIFEST_SQL)
def _merkle_manifest(table) -> DataFrame:
    """Every document's proof by the manifest of all, held against a copy in which line ends of half the documents are lost."""
    less = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    lost = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.col("text").contains("\n")
    changed = F.when(lost, merkle.leaf_digest(*[less if f == "text" else F.col(f) for f in merkle.FIELDS]))
    found = merkle.verified(table("documents"), changed)
    return found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("steps")).alias("proof_sha256"), "folded_root", "verified")


def _codebooks_sql(rounds: int = codebooks.ROUNDS) -> str:
    """The rounds of k-means one after another, everything compared with everything."""
    nearest = "SELECT id, part, min((xx + c.yy - 2 * list_inner_product(x, c.y), entry)) AS m FROM p JOIN {0} c USING (part) GROUP BY id, part"
    steps = []
    for i in range(rounds):
        steps.append(f"a{i} AS ({nearest.format(f'c{i}')})")
        steps.append(f"""c{i + 1} AS (
  SELECT part, entry, coalesce(z, y) AS y, list_inner_product(coalesce(z, y), coalesce(z, y)) AS yy FROM c{i} LEFT JOIN (
    SELECT part, entry, list(floor(s / n) ORDER BY i) AS z FROM (
      SELECT part, m[2] AS entry, i, sum(x[i]) AS s, count(*) AS n FROM a{i} JOIN p USING (id, part), range(1, 1 + (SELECT max(len(x)) FROM p)) t(i)
      GROUP BY part, m[2], i) GROUP BY part, entry) USING (part, entry))""")
    return f"""
WITH e AS (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS id, vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * {codebooks.SCALE})) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT id, part, x, list_inner_product(x, x) AS xx FROM (
  SELECT id, part, v[part * len(v) // 4 + 1 : (part + 1) * len(v) // 4] AS x FROM e, range(4) t(part))),
c0 AS (SELECT part, id AS entry, x AS y, xx AS yy FROM p WHERE id < {codebooks.ENTRIES}),
{", ".join(steps)},
f AS ({nearest.format(f"c{rounds}")}),
g AS (SELECT id, string_agg(printf('%02x', m[2]), '' ORDER BY part) AS code, sum(m[1])::BIGINT AS error FROM f GROUP BY id),
b AS (SELECT sha256(string_agg(array_to_string(list_transform(y, lambda q: q::BIGINT), ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM e JOIN g USING (id), b"""


@query("op12_vector_codes", _codebooks_sql())
def _vector_codes(table) -> DataFrame:
    """Every vector's code and error, with its label's error and the digest of the codebooks."""
    found, books = codebooks.compress(table("embeddings"))
    return found.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(codebooks.books_digest(books)).alias("codebooks_sha256"))


@query("op13_quality_rules")
def _quality_rules(table) -> DataFrame:
    """What the rules count of each document, and whether it is kept."""
    return rules.judge(table("documents"), table("labels"))
