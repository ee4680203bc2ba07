"""One query per operator over whole tables, and DuckDB SQL where it can say the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom_search, decontaminate, divergence, exact_dedup, html_text, language, lm_scores, mixing, pii, quality, simhash, token_counts, vector_search
from .common import shared_dir, table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         substr(md5(coalesce(CAST(doc_id AS VARCHAR), '-' || text, '-') || ':mix-1'), 1, 16) AS k
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM d GROUP BY source
), r AS (
  SELECT *, 3 * source_size AS cap, sum(source_size) OVER () AS total,
         coalesce(sum(3 * source_size) OVER (ORDER BY CAST(3 * source_size AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(w) OVER (ORDER BY CAST(3 * source_size AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights_left
  FROM s
), c AS (SELECT *, (total - before) * w > cap * weights_left AS capped FROM r
), t AS (
  SELECT source, source_size,
         CASE WHEN capped THEN CAST(cap AS DOUBLE)
              ELSE CAST(w * (total - coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0)) AS DOUBLE)
                   / CAST(sum(CASE WHEN NOT capped THEN w END) OVER () AS DOUBLE) END AS target
  FROM c
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
         CASE WHEN t.source_size > 0 THEN CAST(floor(t.target) AS BIGINT) // t.source_size ELSE 0 END AS epochs,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id NULLS LAST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * epochs + least(size, greatest(0, budget - epochs * source_size - before)) AS BIGINT) AS taken
FROM p
"""


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))
    return marked.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), r AS (
  SELECT doc_id, norm, row_number() OVER w AS n, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size
  FROM d WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id NULLS LAST)
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, n = 1 AS kept, sha256(norm) AS text_sha256 FROM r
"""


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents")).select("doc_id", "pii")
    base = F.filter("pii", lambda s: s["rank"] < len(pii.BASE_KINDS))

    def count(kind: str) -> Column:
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts, more = [count(k) for k in pii.BASE_KINDS], [count(k) for k in pii.ADDED_KINDS]
    scores = F.array_join(F.transform("pii", lambda s: F.round(s["score"] * 100).cast("int").cast("string")), ",")
    digest = F.sha2(pii.span_list(base), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, pii.span_list(F.col("pii")).alias("spans"), *more, F.size("pii").cast("bigint").alias("n_spans"), scores.alias("scores"))


def _spans_sql(rank: int, kind: str, pattern: str, keep: str) -> str:
    """Spans of one kind with their scores in hundredths; g has what stands between the expression's matches f."""
    near = "translate(right(g[i], 40), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    score = rf"""least(100, {pii.VALID_SCORE[kind]} + CASE WHEN regexp_matches({near}, '{pii.names_one(pii.CONTEXT_WORDS[kind])}') THEN 30 ELSE 0 END
      - CASE WHEN regexp_matches({near}, '{pii.names_one(pii.EXAMPLE_WORDS)}') THEN 30 ELSE 0 END)"""
    return rf"""
  SELECT row, {rank} AS rank, '{kind}' AS kind, begin_at + length(m) AS end_at, begin_at AS start_at, score FROM (
    SELECT row, f[i] AS m, {score} AS score,
           list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i-1], lambda x: length(x))), 0) AS begin_at
    FROM (SELECT row, f, g, unnest(range(1, len(f) + 1)) AS i
          FROM (SELECT row, regexp_extract_all(t, '{pattern}') AS f, string_split_regex(t, '{pattern}') AS g FROM d))
  ) WHERE {keep}{'' if rank < 4 else ' AND score >= 60'}"""


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = rf"""length({_DIGITS}) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i:
      CASE WHEN (length({_DIGITS}) - i) % 2 = 0 THEN CAST(substr({_DIGITS}, i, 1) AS INT)
           ELSE (CAST(substr({_DIGITS}, i, 1) AS INT) * 2) // 10 + (CAST(substr({_DIGITS}, i, 1) AS INT) * 2) % 10 END)) % 10 = 0"""
_TURNED = "(substr(replace(m, ' ', ''), 5) || substr(replace(m, ' ', ''), 1, 4))"
_MOD97 = rf"""list_reduce(list_prepend(0, list_transform(range(1, length({_TURNED}) + 1), lambda i: ascii(substr({_TURNED}, i, 1)))),
      lambda a, c: CASE WHEN c < 58 THEN (a * 10 + c - 48) % 97 ELSE (a * 100 + c - 55) % 97 END) = 1"""

OP8_SQL = (
    "WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents), s AS ("
    + " UNION ALL ".join(
        [
            _spans_sql(0, "email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
            _spans_sql(1, "ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", r"list_max(list_transform(string_split(m, '.'), lambda x: coalesce(TRY_CAST(right(ltrim(x, '0'), 9) AS BIGINT), 0) + CASE WHEN length(ltrim(x, '0')) > 9 THEN 1000 ELSE 0 END)) <= 255"),
            _spans_sql(2, "card", r"[0-9](?:[\x20-]?[0-9])+", _LUHN),
            _spans_sql(3, "phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15"),
            _spans_sql(4, "iban", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?", _MOD97),
            _spans_sql(5, "ssn", r"[0-9]+-[0-9]+-[0-9]+", "regexp_matches(m, '^[0-9]{3}-[0-9]{2}-[0-9]{4}$') AND NOT regexp_matches(m, '^(?:000|666|9)|-00-|-0000$')"),
            _spans_sql(6, "account", r"[0-9]{8,}", "length(m) <= 12"),
            _spans_sql(7, "secret", r"[A-Za-z0-9_-]{20,}", "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]')"),
        ]
    )
    + """), a AS (
  SELECT row, """
    + ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in (*pii.BASE_KINDS, *pii.ADDED_KINDS))
    + """, count(*) AS n_spans,
         string_agg(kind || ':' || start_at || ':' || end_at, ',' ORDER BY start_at, rank) FILTER (rank < 4) AS base,
         string_agg(kind || ':' || start_at || ':' || end_at, ',' ORDER BY start_at, rank) AS spans, string_agg(CAST(score AS VARCHAR), ',' ORDER BY start_at, rank) AS scores
  FROM s GROUP BY row)
SELECT doc_id, """
    + ", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in (*pii.BASE_KINDS, *pii.ADDED_KINDS, "spans"))
    + """, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
FROM d LEFT JOIN a USING (row)"""
)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return marked.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


OP10_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), i AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), iw AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS k FROM i WHERE len(w) > 0)
), dw AS (
  SELECT row, k, n, array_to_string(w[k:k + n - 1], ' ') AS win
  FROM (SELECT row, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d CROSS JOIN (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)
), h AS (SELECT dw.row, dw.k, dw.n, iw.item FROM dw JOIN iw ON dw.n = iw.n AND dw.win = iw.win),
c AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(k, k + n)) AS p FROM h) GROUP BY row),
g AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, item FROM h) GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (row) LEFT JOIN g USING (row)
"""


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In two calls with a cache that begins empty, so that the second meets contents of the first: the shorter texts, then all."""
    import public_tokenizers

    path, cache = public_tokenizers.path("word_bpe_49k.json"), f"{shared_dir(spark)}/token-cache-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    token_counts.token_counts(docs.filter(F.length("text") < 1000), path, cache, by_piece=True)
    counts = token_counts.token_counts(docs, path, cache, by_piece=True)
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    part = F.crc32(F.col("doc_id").cast("string")) % 4
    docs = docs.withColumn("held_out", F.coalesce(part == 2, F.lit(False)))
    labelled = docs.filter(part != 2)
    found = language.identify_languages(docs.drop("lang"), labelled, keep=["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return quality.classify(docs, table(spark, sf_dir, "labels"), keep=["doc_id"])


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under the counts of nine tenths of them; what the others alone have backs off."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 8), 16, 10).cast("bigint") % 10 != 0
    return lm_scores.score_documents(docs, keep=["doc_id"], counted=counted)


OP9_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) % 10 <> 0 AS counted
  FROM documents
), t AS (
  SELECT row, counted, CASE WHEN k > 1 THEN w[k - 1] ELSE '' END AS before, w[k] AS word FROM (SELECT row, counted, w, unnest(range(1, len(w) + 1)) AS k FROM d)
), c1 AS (SELECT word, count(*) AS n FROM t WHERE counted GROUP BY word UNION ALL SELECT '', count(*) FROM d WHERE len(w) > 0 AND counted),
c2 AS (SELECT before, word, count(*) AS n FROM t WHERE counted GROUP BY ALL),
s AS (
  SELECT row, sum(CASE WHEN c2.n IS NOT NULL THEN ln(c2.n) - ln(b.n) ELSE ln(0.4) + ln(coalesce(o.n, 1)) - ln(greatest((SELECT count(*) FROM t WHERE counted), 1)) END) AS score
  FROM t LEFT JOIN c1 o ON t.word = o.word LEFT JOIN c1 b ON t.before = b.word LEFT JOIN c2 ON t.before = c2.before AND t.word = c2.word GROUP BY row
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, round(coalesce(score, 0), 6) AS log_score, CASE WHEN len(w) > 0 THEN round(score / len(w), 6) END AS mean_score
FROM d LEFT JOIN s USING (row)
"""


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


OP11_SQL = """
WITH e AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(range(1, least(len(q.v), len(c.v)) + 1), lambda i: q.v[i] * c.v[i])), 0) AS BIGINT) AS score
  FROM e q JOIN e c ON q.row <> c.row WHERE q.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergences(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), t AS (SELECT lang, source, row, term, count(*) AS n FROM (SELECT lang, source, row, unnest(w) AS term FROM d) GROUP BY ALL),
kept AS (SELECT lang, term, CAST(sum(n) AS HUGEINT) AS n FROM t GROUP BY lang, term HAVING count(*) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, CAST(sum(n) AS HUGEINT) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
tot AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
p AS (
  SELECT tot.lang, tot.source, k.term, coalesce(c.n, 0) AS n, CAST(1 + 1000000000 * (coalesce(c.n, 0) + 1) // (tot.total + v.v) AS HUGEINT) AS p,
         CAST(1 + 1000000000 * (k.n + 1) // (v.total + v.v) AS HUGEINT) AS q
  FROM tot JOIN v ON v.lang = tot.lang JOIN kept k ON k.lang = tot.lang LEFT JOIN c ON c.lang = tot.lang AND c.source = tot.source AND c.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL
), parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pairs.value, 0) AS value
  FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q
), r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM parts)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM r WHERE part = 'pair' OR rank <= 200
"""


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 50)


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), i AS (
  SELECT row_number() OVER () AS item, item_id, list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w
  FROM benchmark
), l AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(w)) AS BIGINT) AS words FROM d WHERE len(w) > 0),
it AS (SELECT item, unnest(w) AS term FROM i),
t AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(w) AS term FROM d) SEMI JOIN it USING (term) GROUP BY ALL),
wt AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS weight FROM (SELECT term, count(*) AS df FROM t GROUP BY term), l),
m AS (SELECT row, doc_id, 50 + (50 * CAST(len(w) AS BIGINT) * docs) // words AS m FROM d, l WHERE len(w) > 0),
s AS (
  SELECT it.item, t.row, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM it JOIN t USING (term) JOIN wt USING (term) JOIN m ON m.row = t.row GROUP BY ALL
), r AS (SELECT s.item, m.doc_id, s.score, row_number() OVER (PARTITION BY s.item ORDER BY s.score DESC, m.doc_id NULLS LAST) AS rank FROM s JOIN m ON m.row = s.row WHERE s.score > 0)
SELECT i.item_id, CAST(rank AS INT) AS rank, r.doc_id, r.score FROM r JOIN i ON i.item = r.item WHERE rank <= 50
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op4_html_text": op4_html_text,
    "op5_exact_dedup": op5_exact_dedup,
    "op2_language": op2_language,
    "op3_simhash": op3_simhash,
    "op6_quality": op6_quality,
    "op7_token_counts": op7_token_counts,
    "op8_pii": op8_pii,
    "op9_lm_scores": op9_lm_scores,
    "op10_decontamination": op10_decontamination,
    "op11_topk": op11_topk,
    "op12_divergence": op12_divergence,
    "op13_ranked_search": op13_ranked_search,
}
ORACLE_SQL: dict[str, str] = {"op1_mixing": OP1_SQL, "op5_exact_dedup": OP5_SQL, "op8_pii": OP8_SQL, "op9_lm_scores": OP9_SQL, "op10_decontamination": OP10_SQL, "op11_topk": OP11_SQL, "op12_divergence": OP12_SQL, "op13_ranked_search": OP13_SQL}
