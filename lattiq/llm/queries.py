"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.llm import decontaminate, line_dedup, minmax_dedup, mixing, quality_rules, secret_scan, sharding, substring_dedup, token_files, url_filter
from lattiq.llm.common import read, scratch_path

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book, name = quality_rules.ledger(read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = quality_rules.passes(name["fail_bits"], quality_rules.BASE)
    full = quality_rules.passes(name["fail_bits"], quality_rules.FULL)
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~base).alias("base_failed"), (base & full).alias("kept"), "fail_bits",
    )


OP1_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS u, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT u, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT u, unnest(range(1, len(ws) - 6)) AS p, ws FROM w WHERE len(ws) >= 8),
h AS (SELECT u, p, array_to_string(ws[p:p + 7], ' ') AS k FROM g),
r AS (SELECT u, p FROM (SELECT u, p, count(*) OVER (PARTITION BY u, k) AS c FROM h) WHERE c > 1),
n AS (SELECT u, sum(least(8, coalesce(nx - p, 8))) AS n_repeat_words
      FROM (SELECT u, p, lead(p) OVER (PARTITION BY u ORDER BY p) AS nx FROM r) GROUP BY u),
m AS (SELECT w.u, doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
             len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
             len(regexp_extract_all(text, '[A-Z]'))::BIGINT AS n_upper, len(regexp_extract_all(text, '!'))::BIGINT AS n_exclaim
      FROM w LEFT JOIN n ON w.u = n.u),
f AS (SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
  + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 40 * n_lines THEN 8 ELSE 0 END
  + CASE WHEN 100 * n_upper > 40 * word_chars THEN 16 ELSE 0 END + CASE WHEN 2 * n_exclaim > n_words THEN 32 ELSE 0 END
  + CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 64 ELSE 0 END)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits
FROM f
"""


def op2_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each benchmark item that a document holds; other documents hold none."""
    hits = decontaminate.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return hits.select(F.col("key").alias("doc_id"), F.col("item").alias("item_id"), "cosine", "lcs", "answered", "start")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.judge(read(spark, sf_dir, "documents"))
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return found.select(
        F.col("doc").alias("doc_id"), "n_lines", F.size("removed").cast("long").alias("n_removed"), "n_links", joined("removed"), joined("match_docs")
    )


OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS u, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT u, doc_id, unnest(range(len(ls)))::INT AS line, unnest(ls) AS t FROM d),
s AS (SELECT u, doc_id, line, list_sort(list_distinct(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))) AS ws FROM l),
c AS (SELECT ws, len(ws) AS n, min({'doc': doc_id, 'line': line}) AS first, row_number() OVER () AS id FROM s WHERE len(ws) > 0 GROUP BY ws),
w AS (SELECT id, n, unnest(ws) AS word FROM c),
f AS (SELECT word, count(*) AS df FROM w GROUP BY word),
o AS (SELECT id, n, word, row_number() OVER (PARTITION BY id ORDER BY df, word) AS place FROM w JOIN f USING (word)),
p AS (SELECT id, n, word FROM o WHERE place <= n - (80 * n + 99) // 100 + 1),
m AS (SELECT DISTINCT x.id AS a, y.id AS b FROM p x JOIN p y USING (word) WHERE x.id <> y.id AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)),
k AS (SELECT a, b, y.first FROM m JOIN c x ON x.id = a JOIN c y ON y.id = b
      WHERE 180 * len(list_intersect(x.ws, y.ws)) >= 80 * (x.n + y.n)),
e AS (SELECT c.ws, least(c.first, coalesce(min(k.first), c.first)) AS earliest, count(k.a) AS n_links FROM c LEFT JOIN k ON k.a = c.id GROUP BY c.ws, c.first),
r AS (SELECT u, sum(n_links)::BIGINT AS n_links, count(*) FILTER (gone) AS n_removed,
             string_agg(line::VARCHAR, ',' ORDER BY line) FILTER (gone) AS removed, string_agg(earliest.doc::VARCHAR, ',' ORDER BY line) FILTER (gone) AS match_docs
      FROM (SELECT *, {'doc': doc_id, 'line': line} > earliest AS gone FROM s JOIN e USING (ws)) GROUP BY u)
SELECT doc_id, len(ls)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_links, 0)::BIGINT AS n_links,
       coalesce(removed, '') AS removed, coalesce(match_docs, '') AS match_docs FROM d LEFT JOIN r USING (u)
"""


def op4_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of LONG_DOCUMENT words and more are half as likely again to be drawn as others of their source."""
    mixed = mixing.mix(read(spark, sf_dir, "documents").select("doc_id", "source", "text"), propensity=mixing.by_length)
    return mixed.select(F.col("key").alias("doc_id"), "source", "size", "source_size", "target", "copies", "taken")


OP4_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n FROM d GROUP BY source),
w AS (SELECT *, ([3, 1, 2])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight, 2 * source_size AS cap FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
          / (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level,
        row_number() OVER o AS nr FROM w WINDOW o AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST)),
k AS (SELECT min(nr) AS first_open FROM l WHERE level * weight <= cap),
t AS (SELECT source, source_size, CASE WHEN nr >= first_open THEN (SELECT level FROM l l2 WHERE l2.nr = first_open) * weight ELSE cap::DOUBLE END AS target
      FROM l, k),
g AS (SELECT *, floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END)::BIGINT AS whole FROM t),
h AS (SELECT *, CASE WHEN target - whole * source_size >= 0.5 THEN target - whole * source_size ELSE 0 END AS remain FROM g),
u AS (SELECT d.doc_id, d.source, d.size, h.source_size, h.target, h.whole, h.remain,
             (('0x' || substr(md5('17:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u,
             least(greatest(h.remain / greatest(h.source_size, 1)::DOUBLE * CASE WHEN d.size >= 100 THEN 1.5::DOUBLE ELSE 1 END, 1e-12::DOUBLE), 1.0::DOUBLE - 1e-12::DOUBLE) AS p
      FROM d JOIN h ON d.source IS NOT DISTINCT FROM h.source),
r AS (SELECT *, (u / (1 - u)) / (p / (1 - p)) AS rank FROM u),
z AS (SELECT source, rank, remain, sum(size) AS z FROM r GROUP BY ALL),
c AS (SELECT source, rank, 2 * (remain - coalesce(sum(z) OVER (PARTITION BY source ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) > z AS hit FROM z),
f AS (SELECT r.*, least(whole + CASE WHEN remain > 0 AND hit THEN 1 ELSE 0 END, 2)::BIGINT AS copies
      FROM r JOIN c ON r.source IS NOT DISTINCT FROM c.source AND r.rank = c.rank)
SELECT doc_id, source, size, source_size, target, copies, (copies * size)::BIGINT AS taken FROM f
"""


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch_path(spark, "tokens")
    token_files.write(read(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.checksums(token_files.read_files(spark, path))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list holds the URLs of every page whose id is divisible by 50."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    listed = pages.filter(F.col("page_id") % 50 == 0).select("url")
    return url_filter.judge(pages, listed).select("page_id", "host", "path", "rule", "verdict", "listed")


_CANON = r"""regexp_replace(regexp_replace(h, '^(?:[^@]*@)?(?:www\.)?', ''), '(?::80|:443|\.)$', '')
  || regexp_replace(regexp_replace(p, '/index\.(?:html?|php)$', '/'), '/+$', '')
  || CASE WHEN len(qs) > 0 THEN '?' || array_to_string(qs, '&') ELSE '' END"""
OP6_SQL = rf"""
WITH a AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
b AS (SELECT page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS h,
             regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS p,
             list_sort(list_filter(string_split(regexp_extract(url, '(?s)^[^?#]*\?([^#]*)', 1), '&'),
               lambda x: x <> '' AND NOT regexp_matches(x, '^(?:utm_[a-z]+|ref|fbclid|gclid|sessionid)(?:=|$)'))) AS qs FROM a),
c AS (SELECT page_id, h, p, CASE WHEN h <> '' THEN {_CANON} END AS name FROM b),
d AS (SELECT *, name IS NOT NULL AND name IN (SELECT name FROM c WHERE page_id % 50 = 0 AND name IS NOT NULL) AS listed,
  CASE WHEN (h = 'www.example.com' OR ends_with(h, '.www.example.com')) AND starts_with(p, '/en/') THEN 'www.example.com/en/'
       WHEN (h = 'example.com' OR ends_with(h, '.example.com')) AND starts_with(p, '/en/') THEN 'example.com/en/'
       WHEN (h = 'com' OR ends_with(h, '.com')) AND starts_with(p, '/') THEN 'com/'
       WHEN (h = 'net' OR ends_with(h, '.net')) AND starts_with(p, '/es/') THEN 'net/es/'
       WHEN (h = 'net' OR ends_with(h, '.net')) AND starts_with(p, '/fr/') THEN 'net/fr/' END AS rule FROM c)
SELECT page_id, h AS host, p AS path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed FROM d
"""


def op7_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = substring_dedup.remove_repeats(read(spark, sf_dir, "documents"))
    return substring_dedup.digest(removed).withColumnRenamed("key", "doc_id")


OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS u, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT u, doc_id, unnest(range(1, len(ws) - 11)) AS p, ws FROM d WHERE len(ws) >= 13 AND doc_id IS NOT NULL),
h AS (SELECT u, doc_id, p, array_to_string(ws[p:p + 12], ' ') AS k FROM g),
f AS (SELECT u, p FROM (SELECT u, p, doc_id, min(doc_id) OVER (PARTITION BY k) AS earliest FROM h) WHERE earliest < doc_id),
c AS (SELECT DISTINCT u, unnest(range(p, p + 13)) AS p FROM f),
e AS (SELECT u, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS w FROM d),
k AS (SELECT u, string_agg(w, ' ' ORDER BY p) AS kept FROM (SELECT e.u, e.p, w FROM e ANTI JOIN c ON e.u = c.u AND e.p = c.p) GROUP BY u),
r AS (SELECT u, count(*) AS n FROM c GROUP BY u)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN r USING (u) LEFT JOIN k USING (u)
"""


def op8_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minmax_dedup.near_duplicates(read(spark, sf_dir, "documents"), width=3, percent=85)
    return found.withColumnRenamed("key", "doc_id")


OP8_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+') AS ws FROM documents),
x AS (SELECT doc_id, unnest(range(len(ws))) AS p, unnest(ws) AS w FROM d WHERE len(ws) >= 3),
y AS (SELECT doc_id, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o AS k FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
s AS (SELECT DISTINCT doc_id AS id, k FROM y WHERE k IS NOT NULL UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM d WHERE len(ws) IN (1, 2)),
w AS (SELECT id, k, count(*) OVER (PARTITION BY id) AS n FROM s),
m AS (SELECT x.id AS a, y.id AS b FROM w x JOIN w y ON x.k = y.k AND x.id < y.id AND 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n)
      GROUP BY x.id, y.id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
e AS (SELECT a, b FROM m UNION ALL SELECT b, a FROM m),
r(id, reached) AS (SELECT a, a FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.reached),
g AS (SELECT id, min(reached) AS component FROM r GROUP BY id),
z AS (SELECT id, count(*)::BIGINT AS n FROM s GROUP BY id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component, doc_id) AS component_id, coalesce(component, doc_id) = doc_id AS kept
FROM d LEFT JOIN z ON z.id = doc_id LEFT JOIN g ON g.id = doc_id
"""


def op9_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's owner is its source, its repository the part of the source in its language."""
    docs = read(spark, sf_dir, "documents")
    found = secret_scan.digest(secret_scan.scan(docs, repo=F.to_json(F.struct("source", "lang")), owner="source"))
    return found.withColumnRenamed("key", "doc_id")


def _op9_sql() -> str:
    """The patterns as RE2 takes them: letters of either case are spelled out."""
    either = lambda p: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in p)
    scans = []
    for rank, (kind, pattern, group, least) in enumerate([*secret_scan.KINDS, *secret_scan.MORE_KINDS]):
        if kind == "assign":
            head, tail = pattern.removeprefix("(?i)").split(")", 1)
            pattern = f"({either(head[1:])}){tail}"
        quoted = "'" + pattern.replace("'", "''") + "'"
        scans.append(f"""SELECT u, '{kind}' AS kind, {rank} AS rank, {least} AS least, unnest(range(len(hits))) AS i, unnest(hits) AS hit, unnest(vals) AS val, unnest(gaps[1:len(hits)]) AS gap
FROM (SELECT u, regexp_extract_all(t, {quoted}) AS hits, regexp_extract_all(t, {quoted}, {group}) AS vals, string_split_regex(t, {quoted}) AS gaps FROM d)""")
    return "WITH d AS (SELECT row_number() OVER () AS u, doc_id, coalesce(text, '') AS t, source, lang FROM documents),\nh AS (" + "\nUNION ALL ".join(scans) + r"""),
p AS (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY u, rank ORDER BY i) AS stop FROM h),
s AS (SELECT u, kind, rank, val, stop - length(hit) AS start, kind || ':' || (stop - length(hit))::VARCHAR || ':' || stop::VARCHAR AS span FROM p WHERE length(val) >= least),
o AS (SELECT val, count(DISTINCT coalesce('=' || source, '')) AS owners, count(DISTINCT {'s': source, 'l': lang}::VARCHAR) AS repos FROM s JOIN d USING (u) GROUP BY val),
j AS (SELECT s.*, owners > 2 OR repos > 4 AS copied,
        NOT (owners > 2 OR repos > 4) AND NOT regexp_matches(lower(val), 'example|placeholder|changeme|your|dummy|sample|xxxx|test|123456')
        AND NOT (length(val) > 1 AND val = repeat(val[1], length(val))) AS live FROM s JOIN o USING (val)),
r AS (SELECT u, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
        string_agg(span, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg(span, ',' ORDER BY start, rank) FILTER (rank < 3 OR live) AS spans,
        count(*) FILTER (live) AS n_live, count(*) FILTER (copied) AS n_example FROM j GROUP BY u)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_example, 0)::BIGINT AS n_example
FROM d LEFT JOIN r USING (u)
"""


def op10_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select(
        F.col("key").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy removes, from the ledger's bit patterns alone."""
    return quality_rules.ablation(quality_rules.ledger(read(spark, sf_dir, "documents").select("text"))[0])


ABLATION_SQL = f"""WITH b AS (SELECT fail_bits FROM ({OP1_SQL})),
p AS (SELECT unnest({[r for p in quality_rules.POLICIES for r in p.rules]}) AS rule, unnest({[p.name for p in quality_rules.POLICIES for _ in p.rules]}) AS policy,
             unnest({[p.mask for p in quality_rules.POLICIES for _ in p.rules]}) AS mask, unnest({[quality_rules.Policy("", 1, (r,)).mask for p in quality_rules.POLICIES for r in p.rules]}) AS bit)
SELECT policy, 1::INT AS version, rule, count(*) FILTER (fail_bits & bit <> 0) AS n_failed, count(*) FILTER (fail_bits & mask = bit) AS n_failed_alone,
       count(*) FILTER (fail_bits & mask & ~bit = 0) AS n_kept_without FROM b, p GROUP BY policy, rule"""


QUERIES: dict[str, Query] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_latent_decontamination": op2_latent_decontamination,
    "op3_line_dedup": op3_line_dedup,
    "op4_pareto_mix": op4_pareto_mix,
    "op5_token_files": op5_token_files,
    "op6_url_filter": op6_url_filter,
    "op7_block_anchors": op7_block_anchors,
    "op8_minmax_dedup": op8_minmax_dedup,
    "op9_secret_ownership": op9_secret_ownership,
    "op10_ring_shards": op10_ring_shards,
    "quality_ablation": quality_ablation,
}
ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": OP1_SQL,
    "op3_line_dedup": OP3_SQL,
    "op4_pareto_mix": OP4_SQL,
    "op6_url_filter": OP6_SQL,
    "op7_block_anchors": OP7_SQL,
    "op8_minmax_dedup": OP8_SQL,
    "op9_secret_ownership": _op9_sql(),
    "quality_ablation": ABLATION_SQL,
}
