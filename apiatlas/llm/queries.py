"""The queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from apiatlas.llm import bpe, centroid_threshold, html_consensus, jaccard_join, line_windows, mixing, pivot_index, quality_ftrl
from apiatlas.llm import quality_gbt, suffix_decontam, token_alignment, toxicity, url_rules
from apiatlas.llm.common import crc_mod

#: Where the public vocabulary files lie; read on the driver only.
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
BYTE_LEVEL, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")

#: The URL rules of the contract (fixed values).
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document's whole text and the text of those ids, as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.encode_decode(docs, VOCABULARY)
    return out.select("doc_id", bpe.token_count(F.col("ids")).alias("n_tokens"),
                      F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by the rules; URLs that fit none are allowed."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judge_urls(pages, url_rules.rule_table(spark, URL_RULES)).select("page_id", "host", "path", "rule", "verdict")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes, from the draws of all shards."""
    draws = mixing.draw_mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return (draws.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("size").alias("size"),
                                     F.first("source_size").alias("source_size"), F.first("target").alias("target"),
                                     F.sum(F.when(F.col("shard").isNotNull(), F.col("words")).otherwise(0)).alias("taken"),
                                     F.sort_array(F.collect_list(F.when(F.col("shard").isNotNull(), F.struct("shard", "spot")))).alias("shards"))
            .select("doc_id", "size", "source_size", "target", "taken", "shards"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality, learned from the labelled ids outside crc32 mod 3 = 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rest = crc_mod(F.col("doc_id"), 3)
    out = quality_ftrl.quality_scores(docs, table(spark, sf_dir, "labels"), rest != 1)
    return out.select("doc_id", F.coalesce(rest == 1, F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learned from the labelled ids outside crc32 mod 5 = 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rest = crc_mod(F.col("doc_id"), 5)
    out = toxicity.toxicity_scores(docs, table(spark, sf_dir, "labels"), rest != 0)
    return out.select("doc_id", F.coalesce(rest == 0, F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    out = html_consensus.main_text(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts, the base rules and the trees' verdict."""
    return quality_gbt.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links at cosine 0.98 within its label, and its component."""
    return pivot_index.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without the later occurrences of repeated three-line windows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_windows.drop_repeated_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shingle-set size and its component of links at 0.75."""
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's cluster of 8 after 10 rounds, with exact distances and inertias."""
    out = centroid_threshold.cluster(table(spark, sf_dir, "embeddings"), k=8, rounds=10, seed=3, dims=64)
    return centroid_threshold.with_inertia(*out).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words inside occurrences of the benchmark's ten-word windows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = suffix_decontam.match_benchmark(docs, table(spark, sf_dir, "benchmark"))
    n_hit = suffix_decontam.hit_words(F.col("runs"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "longest")


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's aligned groups and links of two tokenizers, scored by corpus-wide pair counts."""
    return token_alignment.align(table(spark, sf_dir, "documents"), BYTE_LEVEL, PIECES)


QUERIES = {f.__name__: f for f in (
    op1_bpe_encode_decode,
    op2_url_filter,
    op3_mix_sources,
    op4_quality_classifier,
    op5_toxicity,
    op6_html_extraction,
    op7_quality_rules,
    op8_embedding_near_dedup,
    op9_line_dedup,
    op10_ngram_jaccard_join,
    op11_centroid_clustering,
    op12_benchmark_decontamination,
    op13_cross_tokenizer_alignment,
)}


def _rounds_sql(rounds: int) -> str:
    """The centroids after each round, as one common table expression a round."""
    near = """a{r} AS MATERIALIZED (SELECT rid, min(cluster) AS cluster, any_value(distance) AS distance FROM (
            SELECT rid, cluster, distance, min(distance) OVER (PARTITION BY rid) AS least FROM (
              SELECT rid, cluster, CAST(sum((x - m) * (x - m)) AS BIGINT) AS distance FROM long JOIN c{r} USING (dim) GROUP BY rid, cluster))
            WHERE distance = least GROUP BY rid)"""
    mean = """c{n} AS MATERIALIZED (SELECT cluster, dim, coalesce(s, m) AS m FROM c{r} LEFT JOIN (
            SELECT cluster, dim, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS s
            FROM long JOIN a{r} USING (rid) GROUP BY cluster, dim) USING (cluster, dim))"""
    parts = [near.format(r=0)]
    for r in range(rounds):
        parts += [mean.format(r=r, n=r + 1), near.format(r=r + 1)]
    return ",\n        ".join(parts)


ORACLE: dict[str, str] = {
    "op11_centroid_clustering": f"""
        WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(CAST(embedding AS DOUBLE[]),
                                   lambda e: CAST(floor(1024 * e) AS BIGINT)) AS v FROM embeddings
                WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
        long AS MATERIALIZED (SELECT rid, unnest(range(64)) AS dim, unnest(v) AS x FROM kept),
        c0 AS (SELECT cluster, unnest(range(64)) AS dim, unnest(v) AS m FROM (
               SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, v) - 1 AS cluster, v FROM kept) WHERE cluster < 8),
        {_rounds_sql(10)},
        names AS (SELECT cluster, sha256(string_agg(CAST(m AS VARCHAR), ',' ORDER BY dim)) AS centroid_sha256 FROM c10 GROUP BY cluster)
        SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
               CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
        FROM kept JOIN a10 USING (rid) JOIN names USING (cluster)""",
    "op12_benchmark_decontamination": r'''
        WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
        i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
        iw AS (SELECT item_id, w, least(10, len(w)) AS m, unnest(range(len(w) - least(10, len(w)) + 1)) AS p FROM i WHERE len(w) > 0),
        windows AS MATERIALIZED (SELECT DISTINCT item_id, m, p AS q, array_to_string(w[p + 1:p + m], ' ') AS win FROM iw),
        sizes AS (SELECT DISTINCT m FROM windows),
        dw AS (SELECT rid, w, m, unnest(range(len(w) - m + 1)) AS p FROM d JOIN sizes ON len(w) >= m),
        found AS MATERIALIZED (SELECT rid, p, m, item_id, p - q AS diagonal
                  FROM (SELECT rid, p, m, array_to_string(w[p + 1:p + m], ' ') AS win FROM dw) AS x JOIN windows USING (m, win)),
        hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(p, p + m)) AS p FROM (SELECT DISTINCT rid, p, m FROM found)) GROUP BY rid),
        ids AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
                FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM found WHERE item_id IS NOT NULL) GROUP BY rid),
        starts AS (SELECT *, coalesce(p - lag(p) OVER (PARTITION BY rid, item_id, diagonal ORDER BY p), 2) > 1 AS fresh FROM found),
        runs AS (SELECT *, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY rid, item_id, diagonal ORDER BY p) AS run FROM starts),
        far AS (SELECT rid, max(size) AS longest FROM (
                SELECT rid, max(p + m) - min(p) AS size FROM runs GROUP BY rid, item_id, diagonal, run) GROUP BY rid)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(longest, 0) AS longest
        FROM d LEFT JOIN hit USING (rid) LEFT JOIN ids USING (rid) LEFT JOIN far USING (rid)''',
    "op8_embedding_near_dedup": '''
        WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        good AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                 AND len(list_filter(e, lambda x: x <> 0)) > 0),
        links AS (SELECT a.vec_id AS u, b.vec_id AS w FROM good a JOIN good b
                  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
        reach(u, w) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.u, l.w FROM reach r JOIN links l ON l.u = r.w),
        comp AS (SELECT u, min(w) AS component_id FROM reach GROUP BY u),
        n AS (SELECT u, count(*) AS n_links FROM links GROUP BY u)
        SELECT v.vec_id, coalesce(n_links, 0) AS n_links, component_id, v.vec_id = component_id AS kept
        FROM v JOIN comp ON comp.u = v.vec_id LEFT JOIN n ON n.u = v.vec_id''',
    "op10_ngram_jaccard_join": r'''
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                               'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
        s AS (SELECT doc_id, list_distinct(CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3),
                               lambda i: array_to_string(words[i:i + 4], ' ')) WHEN len(words) > 0 THEN [array_to_string(words, ' ')]
                               ELSE [] END) AS toks FROM w),
        t AS (SELECT doc_id, len(toks) AS n, unnest(toks) AS tok FROM s),
        common AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb
                   FROM t a JOIN t b ON a.tok = b.tok AND a.doc_id <> b.doc_id GROUP BY ALL),
        links AS (SELECT u, v FROM common WHERE 100 * c >= 75 * (na + nb - c)),
        reach(u, v) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.u, l.v FROM reach r JOIN links l ON l.u = r.v),
        comp AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u)
        SELECT s.doc_id, len(toks) AS n_shingles, component_id FROM s JOIN comp ON comp.u = s.doc_id''',
    "op9_line_dedup": r'''
        WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
        l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line,
                     unnest(range(len(string_split(text, chr(10))))) AS pos FROM d),
        w AS (SELECT doc_id, text, pos, line,
                     lead(line, 1) OVER o AS line2, lead(line, 2) OVER o AS line3, lead(pos, 1) OVER o AS pos2, lead(pos, 2) OVER o AS pos3
              FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') WINDOW o AS (PARTITION BY doc_id, text ORDER BY pos)),
        n AS (SELECT *, row_number() OVER (PARTITION BY line, line2, line3 ORDER BY doc_id NULLS LAST, text, pos) AS nth
              FROM w WHERE pos3 IS NOT NULL),
        c AS (SELECT DISTINCT doc_id, text, unnest([pos, pos2, pos3]) AS pos FROM n WHERE nth > 1),
        kept AS (SELECT l.doc_id, l.text, count(*) AS n_lines, count(c.pos) AS n_removed,
                        coalesce(string_agg(CASE WHEN c.pos IS NULL THEN line END, chr(10) ORDER BY l.pos), '') AS cleaned
                 FROM l LEFT JOIN c ON l.doc_id IS NOT DISTINCT FROM c.doc_id AND l.text = c.text AND l.pos = c.pos GROUP BY ALL)
        SELECT documents.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, cleaned AS text
        FROM documents LEFT JOIN kept ON documents.doc_id IS NOT DISTINCT FROM kept.doc_id AND documents.text = kept.text''',
    "op2_url_filter": '''
        WITH rules(verdict, rule, r_host, r_path) AS (VALUES
            ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'),
            ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')),
        rests AS (SELECT page_id, row_number() OVER () AS rid,
                         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
        parts AS (SELECT page_id, rid,
                         coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM rests),
        fits AS (SELECT rid, arg_max(rule, length(rule)) AS rule, arg_max(rules.verdict, length(rule)) AS verdict
                 FROM parts JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
                 GROUP BY rid)
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fits USING (rid)''',
}
