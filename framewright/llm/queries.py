"""The queries opN_* and pipeline, with SQL where DuckDB can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontamination import benchmark_hits
from .language_id import identify_languages
from .line_dedup import drop_repeated_lines
from .ngram_join import similar_documents
from .packing import pack_documents
from .quality_rules import COMMON_WORDS, LEAST_CHARS, LEAST_WORDS, MOST_CLASS_DISTANCE, MOST_WORD_DISTANCE, quality_rules
from .substring_dedup import drop_repeated_windows
from .suffix_dedup import drop_repeated_substrings
from .token_counts import prefix_token_counts
from .warc import read_records, write_archives


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return prefix_token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), 4096)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_windows(table(spark, sf_dir, "documents"), 50)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return out.select("doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("item_ids", ",").cast("binary"), 256)
    return out.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_substrings(table(spark, sf_dir, "documents"), 200)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_archives(table(spark, sf_dir, "pages"), least_revisit_bytes=0)
    return read_records(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "copy_id", "n_links")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_quality_rules": op3_quality_rules,
    "op4_language_id": op4_language_id,
    "op5_line_dedup": op5_line_dedup,
    "op6_decontamination": op6_decontamination,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_warc": op8_warc,
    "op9_packing": op9_packing,
    "op10_ngram_join": op10_ngram_join,
    "pipeline": pipeline,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_COUNT = "(length(t) - length(regexp_replace(t, '{}', '', 'g')))"
_CLASSES = ["chars - word_chars", "strlen(t) - chars", "n_symbols", _COUNT.format("[0-9]"), _COUNT.format(r"[!\x22''()+,./:;=?@\[\\\]^_`{}~-]")]

ORACLES = {
    "op2_substring_dedup": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        win AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM d WHERE len(w) >= 50)),
        firsts AS (SELECT h, min(doc_id) AS first FROM win GROUP BY h),
        gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS p FROM win JOIN firsts USING (h) WHERE doc_id > first),
        lists AS (SELECT doc_id, list(p) AS gone FROM gone GROUP BY doc_id),
        pos AS (SELECT doc_id, w[p] AS word, p FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS p FROM d)),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text FROM pos ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
        FROM d LEFT JOIN lists USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op3_quality_rules": rf"""
        WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
        tri AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d WHERE len(w) >= 3)),
        rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM tri WHERE n > 1) GROUP BY doc_id),
        b0 AS (SELECT *, length(t) AS chars, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, {_COUNT.format("[#*$%&|<>]")}::BIGINT AS n_symbols,
            list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS lines FROM d),
        b AS (SELECT b0.*, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM b0 LEFT JOIN rep USING (doc_id)),
        c0 AS (SELECT doc_id, lang, chars, {", ".join(f"({x})::DOUBLE AS k{i}" for i, x in enumerate(_CLASSES))} FROM b),
        c AS (SELECT doc_id, lang, chars, unnest(['0', '1', '2', '3', '4', '5']) AS k, unnest([k0, k1, k2, k3, k4, greatest(0, chars - k0 - k1 - k2 - k3 - k4)]) AS n FROM c0),
        hit AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word FROM d) WHERE word IN ({", ".join(f"'{w}'" for w in COMMON_WORDS)}) GROUP BY ALL),
        words AS (SELECT unnest([{", ".join(f"'{w}'" for w in COMMON_WORDS)}]) AS word),
        g AS (SELECT d.doc_id, lang, word AS k, coalesce(hit.n, 0)::DOUBLE AS n FROM d CROSS JOIN words LEFT JOIN hit USING (doc_id, word)
            UNION ALL SELECT d.doc_id, lang, ' other', len(w) - coalesce((SELECT sum(n) FROM hit WHERE hit.doc_id = d.doc_id), 0) FROM d),
        h AS (SELECT 'c' AS kind, doc_id, lang, k, n FROM c UNION ALL SELECT 'w', doc_id, lang, k, n FROM g),
        r AS (SELECT kind, lang, k, sum(n) / sum(sum(n)) OVER (PARTITION BY kind, lang) AS q FROM h WHERE lang IS NOT NULL GROUP BY kind, lang, k),
        p AS (SELECT kind, doc_id, k, n / nullif(sum(n) OVER (PARTITION BY kind, doc_id), 0) AS p FROM h),
        js AS (SELECT kind, doc_id, r.lang, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2)) AS js
            FROM p JOIN r USING (kind, k) GROUP BY ALL),
        near AS (SELECT doc_id, min(js) FILTER (WHERE kind = 'c') AS jc, min(js) FILTER (WHERE kind = 'w') AS jw FROM js GROUP BY doc_id)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
            NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
            AND (chars < {LEAST_CHARS} OR n_words < {LEAST_WORDS} OR jc <= {MOST_CLASS_DISTANCE}) AND (n_words < {LEAST_WORDS} OR jw <= {MOST_WORD_DISTANCE}) AS kept
        FROM b LEFT JOIN near USING (doc_id)""",
    "op8_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h),
        hex AS (SELECT page_id, h, first, sha1(h) AS x FROM p JOIN f USING (h))
        SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
            array_to_string(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                (((('0x' || substr(x, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::INT, 1)), '') AS payload_digest,
            CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM hex""",
    "op5_line_dedup": f"""
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
            FROM documents),
        keyed AS (SELECT *, {_LOWER.format(f"trim(line, {_SPACES})")} AS key FROM lines),
        firsts AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key)
        SELECT doc_id, count(*)::BIGINT AS n_lines,
               (count(*) FILTER (WHERE coalesce(doc_id > first, false)))::BIGINT AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT coalesce(doc_id > first, false)), '')) AS kept_sha256
        FROM keyed LEFT JOIN firsts USING (key) GROUP BY doc_id""",
    "op6_decontamination": rf"""
        WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
        b AS (SELECT item_id, list_filter(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
        sizes AS (SELECT DISTINCT least(13, len(w)) AS n FROM b WHERE len(w) > 0),
        bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS win
               FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(generate_series(1, greatest(1, len(w) - 12))) AS i FROM b WHERE len(w) > 0)),
        dw AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
               FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
        h AS (SELECT doc_id, item_id, n, i FROM dw JOIN bw USING (n, win)),
        p AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS q FROM h) GROUP BY doc_id),
        m AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM h) GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN p USING (doc_id) LEFT JOIN m USING (doc_id)""",
}
