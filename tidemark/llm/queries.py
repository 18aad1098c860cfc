"""Registered queries of the operators, next to the DuckDB SQL with the same rows where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bpe import BytePairCoder, round_trips, token_facts
from tidemark.llm.common import table
from tidemark.llm.leaks import leaks
from tidemark.llm.lines import drop_common_lines
from tidemark.llm.mixing import mixed_counts
from tidemark.llm.phrases import collocations
from tidemark.llm.quality import scored_quality
from tidemark.llm.ranked import ranked_search
from tidemark.llm.simhash import near_duplicate_groups
from tidemark.llm.tokens import tokenized
from tidemark.llm.toxicity import scored_toxicity
from tidemark.llm.urls import filter_urls, url_host, url_path
from tidemark.llm.vectors import nearest
from tidemark.llm.warc import archived_pages
from tidemark.session import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run

    return register


LINES = """
WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM parts),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
common AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (k IN (SELECT k FROM common))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (k NOT IN (SELECT k FROM common)), '')) AS kept_sha256
FROM keyed GROUP BY doc_id
"""


@query("op3_line_dedup", LINES)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    kept = drop_common_lines(table(spark, folder, "documents"), min_documents=10, min_length=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


@query("op5_source_mix")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return mixed_counts(table(spark, folder, "documents"), weights=(3, 1, 2), share=1.5, most=2.0)


@query("op6_token_files")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return tokenized(table(spark, folder, "documents"), shared_folder(spark, "tokens"), end_id=0)


WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
g AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM f)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM g
"""


@query("op7_warc_archive", WARC)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return archived_pages(table(spark, folder, "pages"), shared_folder(spark, "warc"), min_bytes=100)


URLS = r"""
WITH u AS (
  SELECT page_id, url, TIMESTAMP '2023-01-01 00:00:00' + to_seconds(((page_id % 1000003) * 61)::BIGINT) AS fetched_at,
         rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '.') AS host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages),
named AS (
  SELECT DISTINCT 'hosts' AS list, 'block' AS effect, 'host:' || host AS pattern FROM u WHERE host <> ''
  UNION SELECT 'domains', 'block', 'domain:' || array_to_string(list_slice(string_split(host, '.'), -3, NULL), '.') FROM u WHERE host <> ''
  UNION SELECT 'sections', 'allow', 'prefix:' || host || '/' || string_split(path, '/')[2] FROM u WHERE host <> '' AND string_split(path, '/')[2] <> ''
  UNION SELECT 'pages', 'block', 'url:' || regexp_replace(url, '#.*$', '') FROM u WHERE host <> ''),
drawn AS (
  SELECT *, ('0x' || substr(md5(pattern), 1, 4))::BIGINT AS a, ('0x' || substr(md5(pattern), 5, 4))::BIGINT AS b, ('0x' || substr(md5(pattern), 9, 4))::BIGINT AS c FROM named),
steps AS (
  SELECT list, effect, pattern, false AS removed, TIMESTAMP '2022-12-01 00:00:00' + to_seconds(a * 900) AS since FROM drawn WHERE c % 3 = 0
  UNION ALL SELECT list, effect, pattern, true, TIMESTAMP '2022-12-01 00:00:00' + to_seconds(a * 900 + b * 300) FROM drawn WHERE c % 3 = 0 AND c % 2 = 0
  UNION ALL SELECT list, effect, pattern, false, TIMESTAMP '2022-12-01 00:00:00' + to_seconds(a * 900 + b * 600) FROM drawn WHERE c % 3 = 0 AND c % 4 = 0),
settled AS (SELECT list, effect, pattern, since, bool_or(removed) AS removed FROM steps GROUP BY ALL),
spans AS (SELECT *, since AS valid_from, lead(since) OVER (PARTITION BY list, effect, pattern ORDER BY since) AS valid_to FROM settled),
labels AS (SELECT *, list_filter(string_split(host, '.'), lambda x: x <> '') AS ls, list_filter(string_split(path, '/'), lambda x: x <> '') AS ps FROM u WHERE host <> ''),
keys AS (
  SELECT page_id, url, fetched_at, 'host:' || host AS pattern FROM labels
  UNION SELECT page_id, url, fetched_at, 'url:' || regexp_replace(url, '#.*$', '') FROM labels
  UNION SELECT page_id, url, fetched_at, unnest(list_transform(range(1, len(ls) + 1), lambda i: 'domain:' || array_to_string(ls[i:], '.'))) FROM labels
  UNION SELECT page_id, url, fetched_at, unnest(list_transform(range(1, len(ps) + 1), lambda i: 'prefix:' || host || '/' || array_to_string(ps[1:i], '/'))) FROM labels),
met AS (
  SELECT k.page_id, k.url, k.fetched_at, s.* EXCLUDE (since, removed),
         row_number() OVER (PARTITION BY k.page_id, k.url, k.fetched_at ORDER BY length(s.pattern) DESC, s.effect <> 'block', s.list, s.pattern, s.valid_from) AS place,
         count(*) OVER (PARTITION BY k.page_id, k.url, k.fetched_at) AS n
  FROM keys k JOIN spans s ON k.pattern = s.pattern AND NOT s.removed AND k.fetched_at >= s.valid_from AND (s.valid_to IS NULL OR k.fetched_at < s.valid_to))
SELECT DISTINCT u.page_id, u.url, u.fetched_at, coalesce(m.n, 0)::BIGINT AS n_active, coalesce(m.effect, 'none') AS verdict, m.list, m.pattern, m.valid_from, m.valid_to
FROM u LEFT JOIN met m ON m.place = 1 AND m.page_id = u.page_id AND m.url = u.url AND m.fetched_at = u.fetched_at
"""


def _after(base: str, seconds) -> F.Column:
    return F.timestamp_seconds(F.unix_timestamp(F.lit(base).cast("timestamp")) + seconds)


def dated_lists(pages: DataFrame) -> DataFrame:
    """List entries named by the pages' own hosts, domains, sections and addresses, dated by the md5 of the pattern.

    A third of the patterns is listed, half of those is taken off again and half of these is listed anew.
    """
    host, path, url = url_host(F.col("url")), url_path(F.col("url")), F.col("url")
    section = F.get(F.split(path, "/"), F.lit(1))
    kinds = [
        ("hosts", "block", F.concat(F.lit("host:"), host), host != ""),
        ("domains", "block", F.concat(F.lit("domain:"), F.array_join(F.slice(F.split(host, r"\."), -F.least(F.size(F.split(host, r"\.")), F.lit(3)), F.lit(3)), ".")), host != ""),
        ("sections", "allow", F.concat(F.lit("prefix:"), host, F.lit("/"), section), (host != "") & (section != "")),
        ("pages", "block", F.concat(F.lit("url:"), F.regexp_replace(url, "#.*$", "")), host != ""),
    ]
    named = pages.select(F.explode(F.array(*[F.when(keep, F.struct(F.lit(n).alias("list"), F.lit(e).alias("effect"), p.alias("pattern"))) for n, e, p, keep in kinds])).alias("x"))
    named = named.where("x is not null").select("x.*").distinct()
    word = lambda at: F.conv(F.substring(F.md5("pattern"), at, 4), 16, 10).cast("long")
    drawn = named.select("*", word(1).alias("a"), word(5).alias("b"), word(9).alias("c")).where("c % 3 = 0")
    step = lambda action, seconds, keep: F.when(keep, F.struct(F.lit(action).alias("action"), _after("2022-12-01 00:00:00", seconds).alias("at")))
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    steps = F.array(step("add", a * 900, F.lit(True)), step("remove", a * 900 + b * 300, c % 2 == 0), step("add", a * 900 + b * 600, c % 4 == 0))
    return drawn.withColumn("s", F.explode(steps)).where("s is not null").select("list", "effect", "pattern", "s.action", "s.at")


@query("op9_url_lists", URLS)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_at", _after("2023-01-01 00:00:00", (F.col("page_id") % 1000003) * 61))
    verdicts = filter_urls(captures, dated_lists(pages))
    stamps = ("fetched_at", "valid_from", "valid_to")
    return verdicts.select(*[F.col(c).cast("timestamp_ntz").alias(c) if c in stamps else F.col(c) for c in verdicts.columns])


@query("op4_simhash_groups")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    groups = near_duplicate_groups(table(spark, folder, "documents"), words=3)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op1_attention_quality")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return scored_quality(table(spark, folder, "documents"), table(spark, folder, "labels"), threshold=0.3)


@query("op10_toxicity_models")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return scored_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"), threshold=0.5)


@query("op2_graph_neighbours")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(table(spark, folder, "embeddings"), k=10, every=100)


@query("op8_benchmark_leaks")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op11_byte_pair_round_trip")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return token_facts(round_trips(table(spark, folder, "documents"), BytePairCoder(spark)))


RANKED = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents WHERE text IS NOT NULL),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
z AS (SELECT count(*)::BIGINT AS docs, sum(len(ts))::BIGINT AS terms FROM d WHERE len(ts) > 0),
tf AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, len(ts)::BIGINT AS n, unnest(ts) AS term FROM d) SEMI JOIN i USING (term) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, z GROUP BY term),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))))::BIGINT AS score
      FROM tf JOIN w USING (term) JOIN i USING (term), z GROUP BY ALL HAVING score > 0)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM s QUALIFY rank <= 50
"""


@query("op13_ranked_search", RANKED)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search(table(spark, folder, "documents"), table(spark, folder, "benchmark"), k=50)


PHRASES = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
z AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS k))),
f AS (SELECT lang, k, phrase, count(*)::BIGINT AS a FROM g GROUP BY ALL HAVING a >= 100),
parts AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
cuts AS (SELECT *, unnest(range(1, k)) AS cut FROM parts),
met AS (
  SELECT c.lang, c.phrase, c.k, c.a, cut, x.a AS l, y.a AS r, z.n, ((1000::HUGEINT * c.a * z.n) // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(ws[1:cut], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(ws[cut + 1:], ' ') JOIN z ON z.lang = c.lang),
best AS (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_ AS (SELECT lang, a, array_to_string(ws[i:i + n - 1], ' ') AS phrase FROM (SELECT lang, a, ws, n, unnest(range(1, k - n + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS n FROM parts))),
longer AS (SELECT lang, phrase, max(a) AS longer FROM inner_ GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN longer o ON o.lang = b.lang AND o.phrase = b.phrase WHERE o.longer IS NULL OR 100 * o.longer < 100 * b.a)
SELECT lang, (row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase))::INTEGER AS rank, phrase, a, l, r, n, score FROM kept QUALIFY rank <= 2000
"""


@query("op12_phrase_collocations", PHRASES)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(table(spark, folder, "documents"), min_count=100, longest=5, top=2000)
