"""The subpackage's queries over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import string
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from folioframe.llm import decontaminate, embedding_dedup, erasure, license_scan, lm_scoring, merkle, mixing, ngram_join, quality, secret_scan, suffix_dedup, token_counts, topk
from folioframe.llm.shared import cut, folder, table


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


def _op1_sql() -> str:
    kinds, link = secret_scan.KINDS, secret_scan.ROLE
    valid = {
        "assign": f"length(regexp_extract(m, {_quoted(secret_scan.ASSIGN)}, 2)) >= 12",
        "short": f"length(regexp_extract(m, {_quoted(secret_scan.ASSIGN)}, 2)) BETWEEN 6 AND 11",
        "opaque": "regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[0-9]')",
    }
    found = " UNION ALL ".join(
        f"SELECT doc_id, {r} AS rank, '{k}' AS kind, '{link[k]}' AS role, unnest(range(1, len(m) + 1)) AS i, m, p FROM (SELECT doc_id, "
        f"regexp_extract_all(t, {_quoted(secret_scan.PATTERNS[k])}) AS m, regexp_split_to_array(t, {_quoted(secret_scan.PATTERNS[k])}) AS p FROM d)"
        for r, k in enumerate(kinds)
    )
    checks = " ".join(f"WHEN '{k}' THEN {v}" for k, v in valid.items())
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({found}),
a AS (SELECT doc_id, rank, kind, role, m[i] AS m,
  list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s FROM f),
v AS (SELECT doc_id, rank, kind, role, s::BIGINT AS s, (s + length(m))::BIGINT AS e FROM a WHERE CASE kind {checks} ELSE true END),
l AS (SELECT * FROM v WHERE rank < 3 OR EXISTS (SELECT 1 FROM v w WHERE w.doc_id = v.doc_id
  AND (CASE v.role WHEN 'secret' THEN w.role <> 'secret' ELSE w.role = 'secret' END)
  AND (w.e <= v.s OR w.s >= v.e) AND v.s - w.e <= {secret_scan.SCOPE} AND w.s - v.e <= {secret_scan.SCOPE})),
g AS (SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans
  FROM l GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)
"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_item", "n_common")


OP3_SQL = """
WITH w AS (
  SELECT 0 AS kind, doc_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
  UNION ALL SELECT 1, item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') FROM benchmark),
l AS (SELECT DISTINCT len(w) AS n FROM w WHERE kind = 1 AND len(w) BETWEEN 1 AND 4),
s AS (
  SELECT kind, id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g FROM w
  UNION SELECT kind, id, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) FROM w JOIN l ON len(w) >= n WHERE kind = 0),
i AS (SELECT id AS item_id, g, count(*) OVER (PARTITION BY id) AS n_item FROM s WHERE kind = 1)
SELECT s.id AS doc_id, item_id, n_item, count(*) AS n_common FROM s JOIN i USING (g) WHERE kind = 0
GROUP BY s.id, item_id, n_item HAVING 100 * count(*) >= 80 * n_item
"""


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return ngram_join.ngram_components(docs, k=3, num=90, den=100).select("doc_id", "n_shingles", "component_id")


OP4_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s
  FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
x AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT p.a, p.b FROM p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * c >= 90 * (na.n + nb.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY 1, 2
"""

#: A public vocabulary file, where the session's `folioframe.vocabulary` names no other; a parameter of the query's operator.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = spark.conf.get("folioframe.vocabulary", VOCABULARY)
    return token_counts.length_histogram(token_counts.encoded_lengths(table(spark, sf_dir, "documents"), vocabulary))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumn("kept", ~F.col("rejected"))


def op7_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = cut(table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("words")))  # the texts are read once
    mixed = mixing.mix(docs, F.array("source"), size=F.col("words"))
    return mixed.select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(table(spark, sf_dir, "documents"), min_words=50)


OP8_SQL = """
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
g AS (SELECT doc_id, i - 1 AS i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w)),
s AS (SELECT h, min(doc_id) AS least FROM g GROUP BY h HAVING min(doc_id) < max(doc_id)),
c AS (SELECT doc_id, i, least, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS island FROM g JOIN s USING (h))
SELECT doc_id, min(i)::INT AS start_word, (max(i) + 50)::INT AS end_word, (max(i) + 50 - min(i))::INT AS n_words, min(least) AS least_id
FROM c GROUP BY doc_id, island
"""


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.95)


OP9_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(embedding, lambda y: y <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON len(a.x) = len(b.x) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT r.a AS vec_id, coalesce(any_value(n.n), 0) AS n_links, min(r.b) AS component_id, r.a = min(r.b) AS kept FROM r LEFT JOIN n ON n.a = r.a GROUP BY r.a
"""


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_texts(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = {c: F.col(c) for c in merkle.COLUMNS}
    changed = fields | {"text": F.translate("text", string.ascii_uppercase, string.ascii_lowercase)}
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    found = merkle.leaf(list(fields.values()))
    held = merkle.manifest(docs, keep={"shown": F.when(chosen, merkle.leaf(list(changed.values()))).otherwise(found)})
    siblings = F.array_join(F.transform("proof", lambda p: F.concat(p["before"], p["after"])), "")
    held = held.select("doc_id", "leaf", "subroot", "root", merkle.digest(siblings).alias("proof_sha256"), merkle.fold(F.col("shown"), F.col("proof")).alias("folded_root"))
    return held.withColumn("verified", F.col("folded_root") == F.col("root"))


def _crc32(text: str) -> str:
    """DuckDB's expression of the CRC-32 of an ASCII text: the table's eight steps a byte written out."""
    bit = "list_reduce(list_prepend(xor({}, {}), range(8)::BIGINT[]), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))"
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)), lambda a, x: {bit.format('a', 'x')}), 4294967295)"


OP11_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, lang, text, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
  || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS ahead FROM documents),
l AS (SELECT doc_id, lang, sha256(ahead || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
  sha256(ahead || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) AS tampered FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM l),
t AS (SELECT lang, 0 AS lvl, i, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM p
  UNION ALL SELECT lang, lvl + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 7) // 8) FROM t WHERE n > 1 GROUP BY lang, lvl, i // 8),
r AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, lvl AS depth FROM t WHERE n = 1),
u AS (SELECT 0 AS lvl, i, subroot AS h, count(*) OVER () AS n FROM r
  UNION ALL SELECT lvl + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 7) // 8) FROM u WHERE n > 1 GROUP BY lvl, i // 8),
w AS (SELECT h AS root, lvl AS depth FROM u WHERE n = 1),
s AS (SELECT lang, lvl, i, coalesce(string_agg(h, '' ORDER BY i) OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
  coalesce(string_agg(h, '' ORDER BY i) OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM t WHERE n > 1 WINDOW run AS (PARTITION BY lang, lvl, i // 8 ORDER BY i)),
v AS (SELECT lvl, i, coalesce(string_agg(h, '' ORDER BY i) OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
  coalesce(string_agg(h, '' ORDER BY i) OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM u WHERE n > 1 WINDOW run AS (PARTITION BY lvl, i // 8 ORDER BY i)),
f AS (SELECT p.doc_id, p.lang, p.i, 0 AS k, leaf, CASE WHEN {_crc32("p.doc_id::VARCHAR")} % 3 = 0 THEN tampered ELSE leaf END AS h, '' AS proof, r.subroot, r.depth, r.i AS place
    FROM p JOIN r ON r.lang IS NOT DISTINCT FROM p.lang
  UNION ALL SELECT f.doc_id, f.lang, f.i, k + 1, leaf, sha256(coalesce(s.before, v.before) || h || coalesce(s.after, v.after)), proof || coalesce(s.before, v.before) || coalesce(s.after, v.after), subroot, f.depth, place
    FROM f CROSS JOIN w LEFT JOIN s ON s.lang IS NOT DISTINCT FROM f.lang AND s.lvl = k AND s.i = f.i // (8 ** k)::BIGINT
    LEFT JOIN v ON k >= f.depth AND v.lvl = k - f.depth AND v.i = place // (8 ** greatest(k - f.depth, 0))::BIGINT
    WHERE k < f.depth + w.depth)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified FROM f, w WHERE k = f.depth + w.depth
"""


def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


OP12_SQL = """
WITH v AS (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score FROM v q JOIN v c ON q.r <> c.r AND len(q.x) = len(c.x) WHERE q.vec_id % 50 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST))::INT AS rank, vec_id, score FROM s
QUALIFY rank <= 5
"""


def op13_cascading_erasure(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = [table(spark, sf_dir, name) for name in ("clients", "clicks", "sales", "sale_lines")]
    return erasure.erase_clients(*tables, at=f"{folder(spark)}/erased-{uuid.uuid4().hex}")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "pipeline": corpus_pipeline.run,
    "op1_secret_scans": op1_secret_scans,
    "op2_license_scans": op2_license_scans,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_token_counts": op5_token_counts,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_mixing_sources": op7_mixing_sources,
    "op8_suffix_array_dedup": op8_suffix_array_dedup,
    "op9_embedding_near_dedup": op9_embedding_near_dedup,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_exact_topk": op12_exact_topk,
    "op13_cascading_erasure": op13_cascading_erasure,
}
ORACLES: dict[str, str] = {
    "op1_secret_scans": _op1_sql(),
    "op3_benchmark_decontamination": OP3_SQL,
    "op4_ngram_jaccard_join": OP4_SQL,
    "op8_suffix_array_dedup": OP8_SQL,
    "op9_embedding_near_dedup": OP9_SQL,
    "op11_merkle_manifest": OP11_SQL,
    "op12_exact_topk": OP12_SQL,
}
