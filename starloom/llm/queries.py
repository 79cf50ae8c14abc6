"""Queries opN_<name> over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers

from starloom.llm import ann, decontaminate, html, importance, langid, linededup, mixing, periodic, pii, simhash, tokens, toxicity, urlfilter
from starloom.llm.common import table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_pages(table(spark, sf_dir, "pages"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), vocabulary or public_tokenizers.path("byte_bpe_50k.json"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(table(spark, sf_dir, "pages"))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.summary(periodic.detect(table(spark, sf_dir, "documents"), rewrite=periodic.looped))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.summary(linededup.drop_lines(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_simhash_near_dedup, op2_pii, op3_toxicity, op4_url_filter, op5_source_mixing, op6_language_id, op7_token_counts, op8_decontamination, op9_html_extraction, op10_nearest_neighbours,
            op11_importance_resampling, op12_periodic_runs, op13_line_dedup,
        )
    }


def _op4_sql() -> str:
    longest_first = sorted(urlfilter.HOST_RULES, key=lambda r: -len(r.name))
    fits = {r.name: f"(host = '{r.host}' OR suffix(host, '.{r.host}')) AND prefix(path, '{r.path}')" for r in longest_first}
    rule = " ".join(f"WHEN {fits[r.name]} THEN '{r.name}'" for r in longest_first)
    verdict = " ".join(f"WHEN {fits[r.name]} THEN '{r.verdict}'" for r in longest_first)
    blocked = " OR ".join(f"regexp_matches(folded, '{r.pattern}')" for r in urlfilter.PATTERN_RULES if r.verdict == "block")
    fold = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH u AS (SELECT page_id, {fold.format("url")} AS folded, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*', 0) ELSE '' END AS head FROM pages),
h AS (SELECT page_id, folded, {fold.format("regexp_extract(head, '^[^/]*', 0)")} AS host, substr(head, length(regexp_extract(head, '^[^/]*', 0)) + 1) AS path FROM u)
SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} WHEN strpos(folded, '://') > 0 AND ({blocked}) THEN 'block' ELSE 'allow' END AS verdict FROM h
"""


OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, text, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s),
c AS (SELECT *, source_size * 3 AS cap, CAST(source_size * 3 AS DOUBLE) / w AS q FROM r),
f AS (SELECT *, sum(source_size) OVER () AS budget, sum(w) OVER () AS all_w,
  sum(cap) OVER (ORDER BY q, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cap_upto,
  sum(w) OVER (ORDER BY q, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS w_upto FROM c),
g AS (SELECT *, CAST(cap_upto AS DOUBLE) + q * CAST(all_w - w_upto AS DOUBLE) <= CAST(budget AS DOUBLE) AS clamped FROM f),
t AS (SELECT source, source_size, CASE WHEN clamped THEN CAST(cap AS DOUBLE) ELSE w * (
  CAST(budget - sum(CASE WHEN clamped THEN cap ELSE 0 END) OVER () AS DOUBLE) / CAST(sum(CASE WHEN clamped THEN 0 ELSE w END) OVER () AS DOUBLE)) END AS target FROM g),
r2 AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target + 0.5e0) AS BIGINT) AS words,
  sum(d.size) OVER (PARTITION BY d.source ORDER BY substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), 'null') || '|17|' || md5(coalesce(d.text, ''))), 1, 15), d.rid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END AS whole FROM r2)
SELECT doc_id, size, source_size, target, CAST(whole * size + least(greatest(words - whole * source_size - before, 0), size) AS BIGINT) AS taken FROM e
"""

OP8_SQL = r"""
WITH dw AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
bw AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
wi AS (SELECT DISTINCT item, ws[i:i + 9] AS w FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM bw WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT len(w) AS m FROM wi),
sh AS (SELECT rid, i, m, ws[i:i + m - 1] AS w FROM (SELECT rid, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM dw, lens WHERE len(ws) >= m)),
hits AS (SELECT sh.rid, sh.i, sh.m, wi.item FROM sh JOIN wi ON sh.w = wi.w),
nw AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + m)) AS p FROM hits) GROUP BY rid),
it AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS named FROM hits GROUP BY rid)
SELECT dw.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(named, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN nw USING (rid) LEFT JOIN it USING (rid)
"""


OP11_SQL = r"""
WITH steps AS (SELECT list_transform(range(256), lambda b: list_reduce([CAST(b AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS step),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
df AS (SELECT rid, unnest(ws) AS f FROM d),
bf AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS f FROM benchmark),
fs AS (SELECT f, count(*) AS s FROM df GROUP BY f), ft AS (SELECT f, count(*) AS t FROM bf GROUP BY f),
e AS (SELECT f, coalesce(s, 0) AS s, coalesce(t, 0) AS t, hex(encode(f)) AS h FROM fs FULL JOIN ft USING (f)),
k AS (SELECT f, s, t, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(0, length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
  lambda c, b: xor(c >> 8, steps.step[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS b FROM e, steps),
b AS (SELECT b, sum(s) AS s, sum(t) AS t FROM k GROUP BY b), n AS (SELECT coalesce(sum(s), 0) AS s, coalesce(sum(t), 0) AS t FROM b),
g AS (SELECT b.b, CAST(floor(1000 * ln(CAST(b.t + 1 AS DOUBLE) * CAST(n.s + 10000 AS DOUBLE) / (CAST(b.s + 1 AS DOUBLE) * CAST(n.t + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM b, n),
w AS (SELECT df.rid, CAST(sum(g.gain) AS BIGINT) AS weight FROM df JOIN k USING (f) JOIN g USING (b) GROUP BY df.rid),
r AS (SELECT d.rid, d.doc_id, CAST(len(ws) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
  (CAST('0x' || substr(sha256('2024:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5e0) / 4294967296e0))) AS BIGINT) AS score FROM d LEFT JOIN w USING (rid)),
p AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id ASC NULLS LAST, rid) AS place, count(*) FILTER (n_features >= 20) OVER () AS fit FROM r)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * fit // 100 THEN place END AS rank FROM p
"""

OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT rid, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT key, max(doc_id) AS owner FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT rid) >= 3),
m AS (SELECT k.*, o.owner IS NOT NULL AND (k.doc_id IS NULL OR k.doc_id < o.owner) AS gone FROM k LEFT JOIN o USING (key))
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY rid, doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_url_filter": _op4_sql(), "op5_source_mixing": OP5_SQL, "op8_decontamination": OP8_SQL, "op11_importance_resampling": OP11_SQL, "op13_line_dedup": OP13_SQL}
