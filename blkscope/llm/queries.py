"""The registered queries of the numbered operators, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, lexical, media, packing, pii, prefix_trie, quality, secret_scan, simhash, substring, url_filter, warc

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = bpe.encode_decode(table(spark, sf_dir, "documents"), TOKENIZER)
    return made.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"), shingle=4, k=4)


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = substring.substring_dedup(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secret_scan.scan(docs, *secret_scan.trained(docs))
    return found.select("doc_id", "at", "kind", F.sha2("value", 256).alias("value_sha256"), F.length("value").alias("length"), "probability", "is_secret")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"), TOKENIZER).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", F.col("offset")
    )


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(table(spark, sf_dir, "pages"), url_filter.rules_table(spark, url_filter.RULES))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.ordered_turns(table(spark, sf_dir, "conversations"))))


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    counts = [pii.count_of(F.col("base"), n).alias(f"n_{k}") for n, k in enumerate(pii.KINDS)]
    every = F.array_sort(F.concat("base", "added"))
    return found.select("doc_id", *counts, F.sha2(pii.named(F.col("base")), 256).alias("base_sha256"), pii.named(every).alias("spans"), F.size("added").cast("long").alias("n_added"))


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(lexical.build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), k=50)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_bpe, op2_simhash, op3_substring, op4_media, op5_quality, op6_secret_scan, op7_exact_dedup, op8_best_fit_packing, op9_warc, op10_url_filter, op11_prefix_trie, op12_pii, op13_lexical)
}

_BITS = "string_agg(substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * instr('0123456789abcdef', substr(h, CAST(i AS INTEGER), 1)) - 3, 4), '' ORDER BY i)"
_BASE32 = "string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + " + " + ".join(f"{16 >> k} * CAST(substr(b, CAST(5 * i + {k + 1} AS INTEGER), 1) AS INTEGER)" for k in range(5)) + ", 1), '' ORDER BY i)"

_CRC32 = "xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda s, e: CASE WHEN e >= 0 THEN xor(s, e) ELSE xor(s >> 1, CASE WHEN s % 2 = 1 THEN 3988292384 ELSE 0 END) END), 4294967295)"

ORACLE_SQL: dict[str, str] = {
    "op11_prefix_trie": f"""
        WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
                          row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos
                   FROM conversations WHERE conv_id IS NOT NULL),
        c AS (SELECT c, c - c % 100 AS b, {_CRC32} % 6 AS h FROM (SELECT DISTINCT c FROM t)),
        u AS (SELECT c.c, 0 AS part, pos, r, x FROM c JOIN t ON t.c = c.b AND pos < h UNION ALL SELECT c.c, 1, pos, r, x FROM c JOIN t ON t.c = c.c AND pos >= h),
        d AS (SELECT c, r, x, row_number() OVER (PARTITION BY c ORDER BY part, pos) AS d FROM u),
        p AS (SELECT c, d, length(x) AS chars, sha256(string_agg(length(r) || ':' || r || length(x) || ':' || x, '' ORDER BY d) OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING)) AS id FROM d
              UNION ALL SELECT c, 0, 0, '' FROM c),
        q AS (SELECT *, lag(id) OVER (PARTITION BY c ORDER BY d) AS up, d = max(d) OVER (PARTITION BY c) AS ends FROM p),
        n AS (SELECT id, any_value(up) AS up, any_value(d) AS d, any_value(chars) AS chars, min(c) AS c, count(*) AS n, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS e FROM q GROUP BY id),
        k AS (SELECT up, count(*) AS kids FROM n WHERE d > 0 GROUP BY up),
        m AS (SELECT n.*, coalesce(kids, 0) AS kids FROM n LEFT JOIN k ON k.up = n.id),
        s AS (SELECT q.id, sum(CASE WHEN kids = 0 THEN 1 ELSE 0 END) AS leaves, sum((n - 1) * m.chars) AS saved FROM m JOIN q ON q.c = m.c AND q.d <= m.d GROUP BY q.id)
        SELECT m.c AS conv_id, m.d AS depth, o.c AS parent_conv_id, m.n AS n_convs, m.kids AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, m.e AS ends_sha256
        FROM m JOIN s USING (id) LEFT JOIN n o ON o.id = m.up""",
    "op13_lexical": r"""
        WITH t AS (SELECT doc_id, row_number() OVER () AS j, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
        d AS (SELECT doc_id, j, len(terms) AS n FROM t WHERE len(terms) > 0),
        s AS (SELECT count(*) AS total, CAST(sum(n) AS BIGINT) AS long FROM d),
        f AS (SELECT j, term, count(*) AS tf FROM (SELECT j, unnest(terms) AS term FROM t) GROUP BY j, term),
        w AS (SELECT term, CAST(floor(1000 * ln((2 * total + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, s GROUP BY term, total),
        q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        r AS (SELECT item_id, j, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * total) // long)))) AS BIGINT) AS score FROM q JOIN f USING (term) JOIN w USING (term) JOIN d USING (j), s GROUP BY item_id, j),
        k AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r JOIN d USING (j) WHERE score > 0)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 50""",
    "op3_substring": r"""
        WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
        w AS (SELECT doc_id, unnest(words) AS w, unnest(range(1, len(words) + 1)) AS pos, len(words) AS n FROM d),
        s AS (SELECT *, CASE WHEN pos <= n - 49 THEN string_agg(w, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING) END AS s FROM w),
        f AS (SELECT s, min(doc_id) AS first FROM s WHERE s IS NOT NULL GROUP BY s),
        c AS (SELECT s.doc_id, pos, w, max(CASE WHEN first < s.doc_id THEN 1 ELSE 0 END) OVER (PARTITION BY s.doc_id ORDER BY pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM s LEFT JOIN f USING (s)),
        k AS (SELECT doc_id, sum(gone) AS gone, string_agg(w, ' ' ORDER BY pos) FILTER (gone = 0) AS kept FROM c GROUP BY doc_id)
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)""",
    "op9_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS x, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages),
        b AS (SELECT h, {_BITS} AS b FROM (SELECT DISTINCT h FROM p), range(1, 41) t(i) GROUP BY h),
        e AS (SELECT h, {_BASE32} AS digest FROM b, range(0, 32) t(i) GROUP BY h)
        SELECT page_id, strlen(x) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id < last THEN last END AS refers_to FROM p JOIN e USING (h)""",
    "op7_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS x FROM documents),
        g AS (SELECT doc_id, x, min(doc_id) OVER (PARTITION BY x) AS keep_id, count(*) OVER (PARTITION BY x) AS group_size,
                     row_number() OVER (PARTITION BY x ORDER BY doc_id) AS n FROM t)
        SELECT doc_id, keep_id, group_size, n = 1 AS kept, sha256(x) AS text_sha256 FROM g""",
    "op10_url_filter": r"""
        WITH rules(r_host, r_path, r_verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
             ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
        u AS (SELECT page_id, row_number() OVER () AS n,
                     CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        p AS (SELECT page_id, n, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
        f AS (SELECT p.*, r_host || r_path AS rule, r_verdict,
                     row_number() OVER (PARTITION BY n ORDER BY length(r_host || r_path) DESC NULLS LAST, length(r_host) DESC) AS k
              FROM p LEFT JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path))
        SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(r_verdict, 'allow') AS verdict FROM f WHERE k = 1""",
}
