"""The opN queries over the driver's tables, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesela.llm import bpe, decontamination, lm, ngram_jaccard, quality, toxicity, warc
from tesela.llm.common import crc_mod, table
from tesela.llm.exact_dedup import exact_dedup
from tesela.llm.line_dedup import line_dedup
from tesela.llm.token_counts import token_counts


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the installed vocabulary package keeps a file; executors have the same package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.jaccard_join(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    weights = quality.fit(docs, labels, "quality", crc_mod("doc_id", 4) != 2)
    return _marked(quality.score(docs, weights), 0.7)


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.lm_scores(table(spark, sf_dir, "documents"), crc_mod("doc_id", 7) != 2)
    return scored.select(
        "doc_id",
        (~F.col("learn")).alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
    )


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    machine = toxicity.fit(docs, labels, "toxic", crc_mod("doc_id", 4) != 2)
    return _marked(toxicity.score(docs, machine), 0.3)


def _marked(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.select(
        "doc_id",
        (crc_mod("doc_id", 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_occurrences(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("hit_words").cast("bigint").alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        decontamination.is_contaminated().alias("contaminated"),
    )


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts(table(spark, sf_dir, "documents"), tokenizer_path())
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(table(spark, sf_dir, "documents"), tokenizer_path())
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


#: Crawl that op10 reads pages as: page k is fetched in full at second 2k and asked for again REFETCH seconds later.
REFETCH = 100_001


def page_crawl(pages: DataFrame) -> DataFrame:
    """WARC records of a crawl of the pages: a response for each, and a not-modified revisit with the same ETag."""
    etag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit("")).cast("binary")), F.lit('"'))

    def capture(kind: str, second, status: int, headers: dict) -> DataFrame:
        fields = [x for k, v in headers.items() for x in (F.lit(k), v)]
        return pages.select(
            F.concat(F.lit(f"{kind}:"), F.col("page_id").cast("string")).alias("record_id"),
            F.lit(kind).alias("type"),
            "url",
            F.timestamp_seconds(second).alias("ts"),
            F.lit(status).alias("status"),
            F.create_map(*fields).alias("headers"),
            (F.col("html") if kind == "response" else F.lit(None).cast("string")).alias("body"),
        )

    first, again = 2 * F.col("page_id"), 2 * F.col("page_id") + REFETCH
    size = F.octet_length(F.coalesce("html", F.lit(""))).cast("string")
    date = lambda second: second.cast("string")
    full = {"ETag": etag, "Date": date(first), "Content-Type": F.lit("text/html"), "Content-Length": size}
    same = {"etag": etag, "date": date(again), "Content-Length": F.lit("0"), "X-Cache": F.lit("hit")}
    return capture("response", first, 200, full).unionByName(capture("revisit", again, 304, same))


def op10_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    crawl = page_crawl(table(spark, sf_dir, "pages"))
    resolved = warc.with_bodies(warc.resolve_revisits(crawl), crawl)
    listed = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    number = lambda c: F.substring_index(c, ":", -1).cast("bigint")
    return resolved.select(
        number("record_id").alias("page_id"),
        "canonical_url",
        "outcome",
        number("refers_to").alias("refers_to"),
        F.sha2(listed.cast("binary"), 256).alias("headers_sha256"),
        F.when(F.col("outcome") == "resolved", F.sha2(F.coalesce("body", F.lit("")).cast("binary"), 256)).alias("body_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_quality": op3_quality,
    "op4_lm": op4_lm,
    "op5_toxicity": op5_toxicity,
    "op6_decontamination": op6_decontamination,
    "op7_token_counts": op7_token_counts,
    "op8_line_dedup": op8_line_dedup,
    "op9_bpe": op9_bpe,
    "op10_warc_revisits": op10_warc_revisits,
}

#: Lower-cases A to Z and nothing else.
_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    # Every pair that shares a shingle, counted exactly.
    "op1_ngram_jaccard": rf"""
        WITH RECURSIVE worded AS (
            SELECT doc_id, regexp_extract_all({_FOLDED}, '[^\x20\x09-\x0D]+') AS w FROM documents
        ), shingled AS (
            SELECT doc_id, CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
            FROM worded
        ), keyed AS (
            SELECT doc_id, s, md5(array_to_string(list_sort(s), '|')) AS k FROM shingled
        ), sets AS (
            SELECT k, min(doc_id) AS rep, count(*) AS n_docs, any_value(s) AS s FROM keyed GROUP BY k
        ), members AS (
            SELECT rep, len(s) AS n, unnest(s) AS x FROM sets
        ), pairs AS (
            SELECT a.rep AS a, b.rep AS b FROM members a JOIN members b ON a.x = b.x AND a.rep < b.rep
            GROUP BY a.rep, b.rep, a.n, b.n HAVING 5 * count(*) >= 4 * (a.n + b.n - count(*))
        ), links AS (
            SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs
        ), reach AS (
            SELECT rep AS a, rep AS b FROM sets UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
        ), classes AS (
            SELECT a, min(b) AS class_id FROM reach GROUP BY a
        ), others AS (
            SELECT l.a, sum(s.n_docs) AS n FROM links l JOIN sets s ON l.b = s.rep GROUP BY l.a
        )
        SELECT d.doc_id, c.class_id, CAST(s.n_docs - 1 + coalesce(o.n, 0) AS BIGINT) AS n_links,
               CAST(s.n_docs AS BIGINT) AS n_same
        FROM keyed d JOIN sets s ON d.k = s.k JOIN classes c ON s.rep = c.a LEFT JOIN others o ON s.rep = o.a
    """,
    # Every window of every length that items have, met by its whole text.
    "op6_decontamination": rf"""
        WITH worded AS (
            SELECT doc_id, regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        ), items AS (
            SELECT DISTINCT CAST(item_id AS VARCHAR) AS item,
                   regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
        ), item_starts AS (
            SELECT item, w, least(13, len(w)) AS m, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i
            FROM items WHERE len(w) > 0
        ), windows AS (
            SELECT DISTINCT m, array_to_string(w[i:i + m - 1], ' ') AS x, item FROM item_starts
        ), lengths AS (
            SELECT DISTINCT m FROM windows
        ), starts AS (
            SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM worded JOIN lengths ON len(w) >= m
        ), places AS (
            SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS x FROM starts
        ), hits AS (
            SELECT p.doc_id, p.i, p.m, v.item FROM places p JOIN windows v ON p.m = v.m AND p.x = v.x
        ), hit_words AS (
            SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS pos FROM hits) GROUP BY doc_id
        ), hit_items AS (
            SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS listed
            FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
        )
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit,
               CAST(coalesce(t.n, 0) AS BIGINT) AS n_items, sha256(coalesce(t.listed, '')) AS items_sha256,
               coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(d.w) AS contaminated
        FROM worded d LEFT JOIN hit_words h ON d.doc_id = h.doc_id LEFT JOIN hit_items t ON d.doc_id = t.doc_id
    """,
    # Every unit of up to three lines that is a run by itself, met by its whole text.
    "op8_line_dedup": r"""
        WITH cut AS (
            SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS raw FROM documents
        ), lines AS (
            SELECT doc_id, unnest(raw) AS raw, unnest(range(0, len(raw))) AS pos FROM cut
        ), filled AS (
            SELECT doc_id, pos, trim(raw, E' \t\n\x0B\f\r') AS line FROM lines
        ), numbered AS (
            SELECT doc_id, pos, line, len(regexp_split_to_array(line, '[ \t\n\x0B\f\r]+')) AS n,
                   row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k
            FROM filled WHERE line <> ''
        ), runs AS (
            SELECT doc_id, k, n, n + lead(n, 1) OVER d AS n2, lead(line, 2) OVER d IS NOT NULL AS three, line AS x,
                   line || chr(10) || lead(line, 1) OVER d AS x2,
                   line || chr(10) || lead(line, 1) OVER d || chr(10) || lead(line, 2) OVER d AS x3
            FROM numbered WINDOW d AS (PARTITION BY doc_id ORDER BY k)
        ), units AS (
            SELECT doc_id, k, 1 AS size, x FROM runs WHERE n >= 50
            UNION ALL SELECT doc_id, k, 2, x2 FROM runs WHERE n2 >= 50
            UNION ALL SELECT doc_id, k, 3, x3 FROM runs WHERE three
        ), later AS (
            SELECT doc_id, k, size, row_number() OVER (PARTITION BY size, x ORDER BY doc_id, k) AS place FROM units
        ), removed AS (
            SELECT DISTINCT doc_id, k FROM (SELECT doc_id, unnest(range(k, k + size)) AS k FROM later WHERE place > 1)
        ), gone AS (
            SELECT n.doc_id, n.pos FROM removed r JOIN numbered n ON r.doc_id = n.doc_id AND r.k = n.k
        ), kept AS (
            SELECT l.doc_id, string_agg(l.raw, chr(10) ORDER BY l.pos) AS text
            FROM lines l ANTI JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id
        ), counts AS (
            SELECT doc_id, count(*) AS n FROM numbered GROUP BY doc_id
        ), gone_counts AS (
            SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id
        )
        SELECT d.doc_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed,
               sha256(coalesce(k.text, '')) AS text_sha256
        FROM cut d LEFT JOIN counts c ON d.doc_id = c.doc_id LEFT JOIN gone_counts g ON d.doc_id = g.doc_id
        LEFT JOIN kept k ON d.doc_id = k.doc_id
    """,
    "op2_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
               count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
               row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC) = 1 AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
    """,
    "op10_warc_revisits": r"""
        WITH plain AS (
            SELECT page_id, coalesce(html, '') AS html,
                   regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS p
            FROM pages
        ), parted AS (
            SELECT page_id, html,
                   regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(p, '^([^/?]*)', 1)),
                       '^[^@]*@', ''), ':(80|443)$', ''), '^www[.]', '') AS host,
                   regexp_replace(regexp_extract(p, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
                   array_to_string(list_sort(list_filter(string_split(regexp_extract(p, '[?](.*)$', 1), '&'),
                       lambda q: q <> '' AND NOT starts_with(q, 'utm_'))), '&') AS query
            FROM plain
        ), pages_in_form AS (
            SELECT page_id, html, host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS canonical_url,
                   '"' || md5(html) || '"' AS etag
            FROM parted
        ), hits AS (
            SELECT a.page_id, a.canonical_url, a.etag, max(b.page_id) AS refers_to
            FROM pages_in_form a
            LEFT JOIN pages_in_form b ON a.canonical_url = b.canonical_url AND 2 * b.page_id < 2 * a.page_id + 100001
            GROUP BY a.page_id, a.canonical_url, a.etag
        ), told AS (
            SELECT h.*, b.html AS body, b.etag AS held,
                   CASE WHEN h.refers_to IS NULL THEN 'no-response'
                        WHEN h.etag <> b.etag THEN 'etag-mismatch' ELSE 'resolved' END AS outcome
            FROM hits h LEFT JOIN pages_in_form b ON h.refers_to = b.page_id
        )
        SELECT page_id, canonical_url, outcome, refers_to,
               sha256(CASE WHEN outcome = 'resolved'
                   THEN 'content-length=' || CAST(octet_length(encode(body)) AS VARCHAR) || ';content-type=text/html'
                   ELSE 'content-length=0' END
                   || ';date=' || CAST(2 * page_id + 100001 AS VARCHAR) || ';etag=' || etag || ';x-cache=hit')
                   AS headers_sha256,
               CASE WHEN outcome = 'resolved' THEN sha256(body) END AS body_sha256
        FROM told
    """,
}
