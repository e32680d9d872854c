"""The operators over the given tables, each with the SQL of equal result where there is one."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import alignment, fixity, grace, hosts, impacts, language, licences, minhash, mixing, pieces, pivots, quality, toxicity
from palimpsest.llm.tables import table
from palimpsest.llm.textstats import COUNTS
from palimpsest.operators.lineage import cut

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


@_query(
    "op8_minhash_near_dedup",
    r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 2 THEN list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))])
                      WHEN len(w) = 1 THEN w ELSE [] END AS s
  FROM words),
items AS MATERIALIZED (SELECT doc_id, unnest(s) AS x, len(s) AS n FROM sets),
links AS MATERIALIZED (
  SELECT a.doc_id AS p, b.doc_id AS q
  FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (
  SELECT doc_id AS p, doc_id AS q FROM sets
  UNION
  SELECT reach.p, links.q FROM reach JOIN links ON reach.q = links.p)
SELECT doc_id, len(s)::BIGINT AS n_shingles, c AS component_id, doc_id = c AS kept
FROM sets JOIN (SELECT p, min(q) AS c FROM reach GROUP BY p) ON p = doc_id
""",
)
def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-word shingles, similarity 0.8, over all documents."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), minhash.NearConfig(words=2))


@_query(
    "op4_grace_exact_dedup",
    r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT doc_id, text_sha256, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
""",
)
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts over all documents."""
    return grace.exact_duplicates(table(spark, sf_dir, "documents"))


@_query(
    "op5_mix_sources",
    r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS own, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS MATERIALIZED (
  SELECT source, source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source)),
rounds AS (
  SELECT 0 AS k, source, source_size, weight, false AS held,
         weight * (sum(source_size) OVER ())::DOUBLE / (sum(weight) OVER ())::DOUBLE AS target
  FROM s
  UNION ALL
  SELECT k + 1, source, source_size, weight, held,
         CASE WHEN held THEN (source_size * 3)::DOUBLE
              ELSE weight * (sum(source_size) OVER () - coalesce(sum(source_size * 3) FILTER (held) OVER (), 0))::DOUBLE
                   / (sum(weight) FILTER (NOT held) OVER ())::DOUBLE END
  FROM (SELECT k, source, source_size, weight, held OR target > source_size * 3 AS held FROM rounds WHERE k < 25)),
t AS (SELECT source, source_size, target FROM rounds WHERE k = 25),
u AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || own), 1, 15))::BIGINT::DOUBLE / 1152921504606846976.0::DOUBLE AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, size * (floor(rate) + (draw < rate - floor(rate))::INT)::BIGINT AS taken FROM u
""",
)
def mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents."""
    return mixing.mixed(table(spark, sf_dir, "documents")).select(
        "doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.size") * F.col("mix.copies")).alias("taken")
    )


@_query("op2_quality_rules")
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rule and trees over all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judged(docs, table(spark, sf_dir, "labels")).select(
        "doc_id", *[f"quality.{c}" for c in (*COUNTS, "base_failed", "kept", "score")]
    )


@_query("op3_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language.identified(docs).select("doc_id", "language.held_out", "language.lang_pred", "language.score")


@_query("op6_toxicity")
def toxic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.scored(docs, table(spark, sf_dir, "labels")).select("doc_id", "toxicity.held_out", "toxicity.score", "toxicity.predicted")


@_query(
    "op1_merkle_fixity",
    r"""
WITH r AS (
  SELECT page_id, 'pages-' || lpad((page_id // 256)::VARCHAR, 8, '0') || '.warc' AS file,
         strlen(coalesce(url, '')) + strlen(coalesce(html, '')) + 64 AS length,
         sha256(coalesce(url, '') || chr(10) || coalesce(html, '')) AS expected,
         CASE WHEN page_id % 193 = 7 THEN NULL WHEN page_id % 97 = 5 THEN sha256(coalesce(url, '') || chr(10) || replace(coalesce(html, ''), '<', '('))
              ELSE sha256(coalesce(url, '') || chr(10) || coalesce(html, '')) END AS found
  FROM pages),
o AS (SELECT *, (sum(length) OVER (PARTITION BY file ORDER BY page_id) - length)::BIGINT AS "offset" FROM r)
SELECT page_id, file, "offset", CASE WHEN found IS NULL THEN 'missing' ELSE 'altered' END AS status,
       expected AS expected_digest, found AS found_digest
FROM o WHERE found IS DISTINCT FROM expected
""",
)
def merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of all pages, laid out in archive files of 256, against a replica that Spark derives from them: in every 97th
    record a character is swapped, every 193rd is lost."""
    pages = table(spark, sf_dir, "pages")
    url, html = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    head = F.concat(url, F.lit("\n"))
    laid = cut(
        fixity.laid_out(
            pages.select(
                "page_id",
                (F.octet_length(url) + F.octet_length(html) + 64).alias("bytes"),
                F.sha2(F.concat(head, html).cast("binary"), 256).alias("digest"),
                F.sha2(F.concat(head, F.when(F.col("page_id") % 97 == 5, F.translate(html, "<", "(")).otherwise(html)).cast("binary"), 256).alias("copy"),
            ),
            F.format_string("pages-%08d.warc", F.floor(F.col("page_id") / 256)),
            ["page_id", "digest"],
            F.col("bytes"),
        )
    )
    replica = laid.filter("page_id % 193 <> 7").select("file", "offset", "length", F.col("copy").alias("digest"))
    found = fixity.faults(laid.select("file", "offset", "length", "digest"), replica)
    return found.join(laid.select("file", "offset", "page_id"), ["file", "offset"]).select(
        "page_id", "file", "offset", "status", "expected_digest", "found_digest"
    )


#: Verdict, host and path prefix of the rules that the pages are judged by.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


@_query(
    "op7_host_reputation",
    r"""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
p AS MATERIALIZED (
  SELECT *, CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
                 WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
                 WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
                 WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM u),
h AS MATERIALIZED (
  SELECT host, count(*) FILTER (rule IN ('net/', 'example.com/de/')) AS bad, count(*) FILTER (rule IN ('example.net/en/', 'org/fr/')) AS good,
         CASE WHEN regexp_full_match(array_to_string(string_split(host, '.')[-2:], '.'), '(?:ac|co|com|edu|go|gob|gouv|gov|mil|ne|net|nom|or|org|sch)\.[a-z][a-z]') THEN array_to_string(string_split(host, '.')[-3:], '.')
              ELSE array_to_string(string_split(host, '.')[-2:], '.') END AS domain,
         CASE WHEN regexp_full_match(array_to_string(string_split(host, '.')[-2:], '.'), '(?:ac|co|com|edu|go|gob|gouv|gov|mil|ne|net|nom|or|org|sch)\.[a-z][a-z]') THEN array_to_string(string_split(host, '.')[-2:], '.')
              ELSE string_split(host, '.')[-1] END AS suffix
  FROM p GROUP BY host),
s AS (SELECT suffix, sum(bad) AS bad, sum(good) AS good, sum(bad) + sum(good) AS n,
             (SELECT (coalesce(sum(bad), 0) + 1) / (coalesce(sum(bad), 0) + coalesce(sum(good), 0) + 2.0) FROM h) AS prior FROM h GROUP BY suffix),
sk AS (SELECT sum(n * (bad / n - prior) ** 2) AS spread, sum(prior * (1 - prior)) AS noise, sum((n - 1) * prior * (1 - prior)) AS scale FROM s WHERE n > 1),
ss AS (SELECT CASE WHEN spread > noise AND scale > 0 THEN least(100.0, greatest(1.0, scale / (spread - noise) - 1)) ELSE 100.0 END AS k FROM sk),
sp AS (SELECT suffix, (bad + k * prior) / (n + k) AS rate FROM s, ss),
d AS (SELECT domain, h.suffix, sum(bad) AS bad, sum(good) AS good, sum(bad) + sum(good) AS n, any_value(rate) AS prior
      FROM h JOIN sp ON h.suffix = sp.suffix GROUP BY domain, h.suffix),
dk AS (SELECT sum(n * (bad / n - prior) ** 2) AS spread, sum(prior * (1 - prior)) AS noise, sum((n - 1) * prior * (1 - prior)) AS scale FROM d WHERE n > 1),
ds AS (SELECT CASE WHEN spread > noise AND scale > 0 THEN least(100.0, greatest(1.0, scale / (spread - noise) - 1)) ELSE 100.0 END AS k FROM dk),
dp AS (SELECT domain, suffix, (bad + k * prior) / (n + k) AS rate FROM d, ds),
hp AS (SELECT host, bad, bad + good AS n, rate AS prior FROM h JOIN dp ON h.domain = dp.domain AND h.suffix = dp.suffix),
hk AS (SELECT sum(n * (bad / n - prior) ** 2) AS spread, sum(prior * (1 - prior)) AS noise, sum((n - 1) * prior * (1 - prior)) AS scale FROM hp WHERE n > 1),
hs AS (SELECT CASE WHEN spread > noise AND scale > 0 THEN least(100.0, greatest(1.0, scale / (spread - noise) - 1)) ELSE 100.0 END AS k FROM hk),
b AS (SELECT host, (bad + k * prior) / (n + k) AS rate, n + k AS strength FROM hp, hs)
SELECT page_id, p.host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN rate - 2 * sqrt(rate * (1 - rate) / (strength + 1)) > 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM p JOIN b ON p.host = b.host
""",
)
def host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on all pages. The tables label no pages, so the pages that a rule fits are the labelled outcomes."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return hosts.judged(pages, URL_RULES).select("page_id", "site.host", "site.path", "site.rule", "site.verdict")


#: Where the public vocabulary lies; read on the driver.
PIECES = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


@_query("op9_sentencepiece")
def sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents, decoded again: counts, digest of the ids, and whether the text came back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.withColumn("p", pieces.audit(spark, F.col("text"), pieces.read_pieces(PIECES))).select("doc_id", "p.*")


def _canonical_sql(text: str) -> str:
    """The canonical form of licence texts, in SQL."""
    line = lambda rule: rf"regexp_matches(l, '^[^a-z0-9]*{rule}')"
    body = rf"copyright\b[^\p{{L}}\p{{N}}]*(?:{licences._BODY})\b"
    statement = rf"{line(r'(?:\(c\)|©|all rights reserved)')} OR ({line(r'copyright\b.*[\p{L}\p{N}]')} AND NOT {line(body)})"
    plain = f"array_to_string(list_filter(string_split(lower(coalesce({text}, '')), chr(10)), lambda l: NOT ({statement})), chr(10))"
    words = rf"string_split(trim(regexp_replace(regexp_replace({plain}, '[-‐‑\x{{AD}}''’]', '', 'g'), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ')"
    return f"array_to_string(list_transform({words}, lambda w: coalesce(spelled[w], w)), ' ')"


def _licence_sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rows = lambda d: ", ".join(f"({quoted(k)}, {quoted(x)})" for k, of in d.items() for x in of)
    spelled = "MAP {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in licences.EQUIVALENT.items()) + "}"
    return f"""
WITH e AS (SELECT {spelled} AS spelled),
k AS (SELECT id, sha256({_canonical_sql('body')}) AS dg FROM (VALUES {rows(licences.built_in())}) AS t(id, body), e
      UNION ALL SELECT * FROM (VALUES {rows(licences.DIGESTS)})),
w AS (SELECT min(id) AS id, dg FROM k GROUP BY dg),
m AS (SELECT id, sha256({_canonical_sql('body')}) AS dg FROM (VALUES {rows(licences.NOTICES)}) AS t(id, body), e),
d AS (SELECT doc_id, text, sha256({_canonical_sql('text')}) AS dg FROM documents, e),
l AS (SELECT doc_id, sha256({_canonical_sql('line')}) AS dg
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) AS x, e WHERE regexp_matches(line, '(?i)licen[cs]')),
n AS (SELECT doc_id, array_to_string(list_sort(list_distinct(list(id))), ',') AS notices FROM l JOIN m ON l.dg = m.dg GROUP BY doc_id)
SELECT d.doc_id, d.dg AS canonical_sha256, w.id AS licence, coalesce(n.notices, '') AS notices
FROM d LEFT JOIN w ON d.dg = w.dg LEFT JOIN n ON d.doc_id = n.doc_id
"""


@_query("op10_licence_scan", _licence_sql())
def licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known licences and notices of all documents."""
    return licences.scanned(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "scan.canonical_sha256", "scan.licence", F.array_join("scan.notices", ",").alias("notices")
    )


#: Where the byte-level vocabulary lies; read on the driver.
BYTE_LEVEL = os.environ.get("BYTE_LEVEL_BPE", "/opt/tokenizers/byte_bpe_50k.json")


@_query("op11_tokenizer_alignment")
def tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tokenizers over all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.aligned(docs, alignment.read_vocabularies(BYTE_LEVEL, PIECES)).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )


@_query(
    "op12_ranked_search",
    r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x{00}-\x{2F}\x{3A}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+') AS t FROM documents),
c AS (SELECT count(*)::BIGINT AS nn, sum(len(t))::BIGINT AS ll FROM d WHERE len(t) > 0),
p AS MATERIALIZED (
  SELECT doc_id, term, count(*)::BIGINT AS tf, any_value(n)::BIGINT AS n FROM (SELECT doc_id, unnest(t) AS term, len(t) AS n FROM d) GROUP BY doc_id, term),
q AS (
  SELECT item_id, term, count(*)::BIGINT AS times
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x{00}-\x{2F}\x{3A}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+')) AS term FROM benchmark) GROUP BY item_id, term),
w AS (
  SELECT term, floor(1000 * ln((2 * any_value(nn) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM p, c WHERE term IN (SELECT term FROM q) GROUP BY term),
s AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // ll))))::BIGINT AS score
  FROM p JOIN w USING (term) JOIN q USING (term), c GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS "rank" FROM s WHERE score > 0)
SELECT item_id, "rank", doc_id, score FROM r WHERE "rank" <= 20
""",
)
def ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best of all documents for every benchmark item."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return impacts.ranked(docs, table(spark, sf_dir, "benchmark"))


@_query(
    "op13_pivot_search",
    r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS "rank" FROM s)
SELECT query_id, "rank", vec_id, score FROM r WHERE "rank" <= 5
""",
)
def pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of all embeddings for every fiftieth."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", pivots.quantised(F.col("embedding"), 256).alias("vector"))
    found = pivots.nearest(vectors, F.col("vec_id") % 50 == 0, id_col="vec_id")
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
