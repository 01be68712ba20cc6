"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe, exact_dedup, filter_audit, html_text, jaccard_join, language_id, lm_scoring, mixing, quality,
               suffix_dedup, toxicity, url_filter, whitening)

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), width=3, percent=90)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 != 2
    return lm_scoring.score_documents(table(spark, sf_dir, "documents"), train)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.words_taken(table(spark, sf_dir, "documents"))
    return taken.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), VOCABULARY)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_text.extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = language_id.train(docs.filter(~F.coalesce(held, F.lit(True))))
    return language_id.predict(docs, model, keep=(held.alias("held_out"),))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held, keep={"held_out": held})


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (
    op1_jaccard_join, op2_lm_scoring, op3_mix_sources, op4_bpe, op5_url_filter, op6_quality_rules, op7_suffix_dedup,
    op8_exact_dedup, op9_html_text, op10_language_id, op11_filter_audit, op12_toxicity, op13_whitening)}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERM = "CASE WHEN regexp_matches(low, '(^|[^a-z0-9]){}([^a-z0-9]|$)') THEN 1 ELSE 0 END"


def _rule_cases() -> str:
    cases = []
    for _, rule in sorted(url_filter.RULES, key=lambda r: -len(r[1])):
        name, _, rest = rule.partition("/")
        cases.append(f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{rest}') THEN '{rule}'")
    return " ".join(cases)


_URL_SQL = f"""
WITH u AS (SELECT page_id, {_LOWER.format("coalesce(url, '')")} AS low,
    {_LOWER.format("coalesce(regexp_extract(url, '://([^/?#]*)', 1), '')")} AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT *, CASE {_rule_cases()} END AS rule,
    {" + ".join(_TERM.format(t) for t in url_filter.STRICT)} AS hard,
    {" + ".join(_TERM.format(t) for t in url_filter.SOFT)} AS soft FROM u)
SELECT page_id, host, path, rule, CASE {" ".join(f"WHEN rule = '{r}' THEN '{v}'" for v, r in url_filter.RULES)}
    WHEN hard > 0 OR soft >= 2 THEN 'block' ELSE 'allow' END AS verdict FROM r
"""

_PHRASES = " AND ".join(f"NOT contains(lower(x), '{p}')" for p in quality.BOILERPLATE)
_ENDS = "[" + ", ".join("'" + c.replace("'", "''") + "'" for c in quality.ENDS) + "]"
_TRIM = "rtrim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_QUALITY_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS rid FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
h AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1),
p AS (SELECT rid, count(DISTINCT i + k) AS n FROM h, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
l AS (SELECT rid, list_sum(list_transform(ls, lambda x: length({_TRIM}))) AS all_chars,
    list_sum(list_transform(list_filter(list_transform(list_distinct(ls), lambda x: {_TRIM}), lambda x: list_contains({_ENDS}, right(x, 1))
        AND length(x) - length(replace(x, ' | ', '')) < 9
        AND NOT (upper(left(x, 4)) = left(x, 4) AND lower(x) <> x AND upper(x) = x AND length(x) - length(replace(x, ' ', '')) >= 4)
        AND {_PHRASES}
        AND len(regexp_extract_all(x, '[#*$%&|<>]')) * 2 <= length(x) - length(replace(x, ' ', '')) + 1), lambda x: length(x))) AS good_chars FROM w),
b AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words, coalesce(all_chars, 0) AS a, coalesce(good_chars, 0) AS good
    FROM w JOIN l USING (rid) LEFT JOIN p USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
    (NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND a - good <= 0.5 * a) AS kept FROM b
"""

_EXACT_SQL = f"""
WITH d AS (SELECT doc_id, sha256({_LOWER.format("coalesce(text, '')")}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
    doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256 FROM d
"""

#: Every order is replayed on every mask: filter by filter, what is still there and fails goes.
_AUDIT_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
first AS (SELECT t, min(doc_id) AS least FROM t GROUP BY t),
w AS (SELECT t.*, least, regexp_extract_all(t.t, '[^\x20\x09-\x0D]+') AS ws FROM t JOIN first USING (t)),
l AS (SELECT doc_id, max(quality) AS q, max(toxic) AS x FROM labels GROUP BY doc_id),
m AS (SELECT part, (CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) THEN 'C' ELSE '' END)
    || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN w.doc_id > least THEN 'E' ELSE '' END) AS fails,
    count(*) AS n, sum(CASE WHEN q = 1 THEN 1 ELSE 0 END) AS good, sum(CASE WHEN x = 1 THEN 1 ELSE 0 END) AS toxic
    FROM w LEFT JOIN l ON w.doc_id = l.doc_id GROUP BY 1, 2),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e
    WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT filter_order, CAST(k AS INTEGER) AS step, substr(filter_order, k, 1) AS f, left(filter_order, k - 1) AS before
    FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS k)),
r AS (SELECT *, contains(fails, f) AS here, regexp_matches(fails, '[' || before || '-]') AS earlier FROM m, s),
g AS (SELECT part, filter_order, step, f, sum(CASE WHEN here OR earlier THEN 0 ELSE n END) AS kept,
    sum(CASE WHEN here AND NOT earlier THEN n ELSE 0 END) AS removed, sum(CASE WHEN here AND earlier THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = f THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN here AND NOT earlier THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN here AND NOT earlier THEN toxic ELSE 0 END) AS toxic_lost FROM r GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
    CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
    CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM g
"""

ORACLE_SQL: dict[str, str] = {"op5_url_filter": _URL_SQL, "op6_quality_rules": _QUALITY_SQL, "op8_exact_dedup": _EXACT_SQL,
                              "op11_filter_audit": _AUDIT_SQL}
