"""The registered queries of the operators: each applies one with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickbars.llm import fingerprints, infilling, langid, lines, lm, mixing, packing, runs, secrets, simhash, tokens, topk, urlfilter
from tickbars.llm.common import table
from tickbars.session import configure

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, of: str, sql: str | None = None):
    def register(build: Callable[[DataFrame], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(table(configure(spark), sf_dir, of))
        if sql is not None:
            ORACLES[name] = sql
        return build
    return register


@_query("op1_top_k_search", "embeddings", """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
        WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), scored AS (
        SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
        FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
    ), ranked AS (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
    )
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""")
def op1(vectors: DataFrame) -> DataFrame:
    return topk.top_k(vectors, every=50)


@_query("op2_language_id", "documents")
def op2(docs: DataFrame) -> DataFrame:
    return langid.identify(docs)


@_query("op3_fingerprints", "documents")
def op3(docs: DataFrame) -> DataFrame:
    return fingerprints.fingerprint_documents(docs)


@_query("op4_token_counts", "documents")
def op4(docs: DataFrame) -> DataFrame:
    return tokens.count_tokens(docs)


@_query("op5_line_dedup", "documents")
def op5(docs: DataFrame) -> DataFrame:
    """What stays of each document."""
    return lines.drop_repeated_lines(docs.select("doc_id", "text")).select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"), "text")


@_query("op6_secret_scan", "documents")
def op6(docs: DataFrame) -> DataFrame:
    return secrets.scan_documents(docs)


@_query("op7_pack_sequences", "documents")
def op7(docs: DataFrame) -> DataFrame:
    return packing.pack_documents(docs)


@_query("op8_simhash_near_dedup", "documents")
def op8(docs: DataFrame) -> DataFrame:
    groups = simhash.near_duplicate_groups(docs)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@_query("op9_mix_sources", "documents")
def op9(docs: DataFrame) -> DataFrame:
    return mixing.mix_report(docs).select("doc_id", "size", "source_size", "target", "taken")


@_query("op10_url_filters", "pages", """
    WITH rest AS (
        SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
    ), hosts AS (
        SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM rest
    ), parts AS (
        SELECT page_id, url, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               regexp_extract(substring(rest, length(raw) + 1), '^[^?#]*') AS path FROM hosts
    ), ruled AS (
        SELECT *, CASE
            WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND prefix(path, '/en/1') THEN 'example.org/en/1'
            WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND prefix(path, '/es/') THEN 'example.org/es/'
            WHEN (host = 'com' OR suffix(host, '.com')) AND prefix(path, '/fr/') THEN 'com/fr/'
            WHEN (host = 'com' OR suffix(host, '.com')) AND prefix(path, '/de/') THEN 'com/de/'
            WHEN (host = 'org' OR suffix(host, '.org')) AND prefix(path, '/') THEN 'org/' END AS rule,
            coalesce(bool_or(prefix(url, 'http://')) OVER (PARTITION BY host, path), false) AND host <> '' AS listed FROM parts
    )
    SELECT page_id, host, path, rule,
           CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN listed THEN 'block' ELSE 'allow' END AS verdict
    FROM ruled""")
def op10(pages: DataFrame) -> DataFrame:
    """The list holds what was read over plain http from any page."""
    return urlfilter.judge(pages, F.col("url").startswith("http://"))


@_query("op11_fill_in_middle", "documents", """
    WITH d AS (
        SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
    ), drawn AS (
        SELECT *, string_split(text, chr(10)) AS parts, CAST(concat('0x', substring(h, 1, 8)) AS BIGINT) AS h1,
               CAST(concat('0x', substring(h, 9, 8)) AS BIGINT) AS h2, CAST(concat('0x', substring(h, 25, 8)) AS BIGINT) AS h4 FROM d
    ), counted AS (
        SELECT *, len(parts) - CASE WHEN parts[len(parts)] = '' THEN 1 ELSE 0 END AS n FROM drawn
    ), ranked AS (
        SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
               text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') AS plain FROM counted
    ), cut AS (
        SELECT *, least(length(text), length(array_to_string(parts[1:a], chr(10))) + CASE WHEN a > 0 THEN 1 ELSE 0 END) AS pa,
               least(length(text), length(array_to_string(parts[1:b], chr(10))) + CASE WHEN b > 0 THEN 1 ELSE 0 END) AS pb FROM ranked
    ), pieces AS (
        SELECT *, substring(text, 1, pa) AS p, substring(text, pa + 1, pb - pa) AS m, substring(text, pb + 1) AS s FROM cut
    )
    SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
           CASE WHEN NOT plain THEN pa END AS prefix_chars, CASE WHEN NOT plain THEN pb - pa END AS middle_chars,
           sha256(CASE WHEN plain THEN text WHEN h4 % 100 < 50 THEN '<S>' || s || '<P>' || p || '<M>' || m
                       ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM pieces""")
def op11(docs: DataFrame) -> DataFrame:
    return infilling.fill_in_middle(docs).select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                                                 F.sha2(infilling.restored(), 256).alias("restored_sha256"))


@_query("op12_lm_scores", "documents")
def op12(docs: DataFrame) -> DataFrame:
    return lm.score_documents(docs)


@_query("op13_periodic_runs", "documents")
def op13(docs: DataFrame) -> DataFrame:
    """Every tenth document is given a tail of its own words over and over before its runs are sought."""
    found = runs.detect_runs(runs.with_repeated_tails(docs))
    best = F.col("best")
    listed = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(listed, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = _pipeline
