"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuyere.llm import exact_dedup, filter_audit, host_rules, html_text, lang_id, lm, mixing, pieces, ranked_search, sharding, simhash, tiff, token_files

#: Production parameters of the sharding query.
SHARDS = [f"shard-{k:03d}" for k in range(128)]


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    manifest = token_files.write_token_files(docs, tokenizer_file("byte_bpe_50k.json"))
    return token_files.read_token_files(spark, manifest).select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return pieces.encode_pieces(docs, tokenizer_file("piece_bpe_32k.model"), with_ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(_documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


def op5_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored form travels beside its pages' digests: a page row holds the document's columns on its first page."""
    stored = tiff.store_texts(_documents(spark, sf_dir))
    packed = stored.select(F.struct("doc_id", "n_bytes", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256")).alias("doc"), "media")
    pages = tiff.read_pages(packed, id_col="doc").select(F.col("doc_id.*"), "page", "pixels")

    def fold(batches):
        import pyarrow as pa

        fields = lambda kind: pa.schema([("doc_id", kind), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
        schema, held, parts = None, None, []

        def row():
            payload = b"".join(parts)
            return (held[0], held[1], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), held[2], held[3], tiff.features(payload))

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

        for batch in batches:
            schema = schema or fields(batch.schema.field("doc_id").type)
            out = []
            for doc_id, n_bytes, media_bytes, media_sha, page, pixels in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if page == 0:
                    if held is not None:
                        out.append(row())
                    held, parts = (doc_id, n_bytes, media_bytes, media_sha), []
                parts.append(pixels)
            yield batch_of(out)
        if held is not None:
            yield batch_of([row()])

    return pages.mapInArrow(fold, f"doc_id {pages.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return sharding.place(docs, SHARDS).select("doc_id", "slot", "shard", "n_bytes")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", "n_chars")


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_documents(spark, sf_dir))


def op10_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.identify(_documents(spark, sf_dir)).select("doc_id", "held_out", "lang_pred", "score")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.judge(_documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_token_files, op2_pieces, op3_exact_dedup, op4_simhash, op5_tiff, op6_sharding, op7_mixing, op8_html_text, op9_lm_score, op10_lang_id, op11_filter_audit, op12_host_rules, op13_ranked_search, pipeline)
}

ORACLE_SQL: dict[str, str] = {
    "op3_exact_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, sha256(body) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY body)""",
    "op7_mixing": r"""
        WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                          md5('7:' || doc_id) AS lot FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        o AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM s),
        c AS (SELECT *, CASE place % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS w, source_size * 3.0::DOUBLE AS cap FROM o),
        f AS (SELECT *, sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER b, 0) AS "left", sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS "open"
              FROM c WINDOW b AS (ORDER BY cap / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        l AS (SELECT arg_min("left" / "open", struct_pack(r := cap / w, p := place)) AS level FROM f WHERE cap / w > "left" / "open"),
        t AS (SELECT source, source_size, CASE WHEN cap / w <= "left" / "open" THEN cap ELSE w * coalesce((SELECT level FROM l), 0) END AS target FROM f),
        p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t),
        q AS (SELECT *, target - whole * source_size AS extra FROM p),
        r AS (SELECT d.*, q.source_size, q.target, q.whole, q.extra, substr(lot, 1, 3) AS bin,
                     sum(d.size) OVER (PARTITION BY d.source ORDER BY lot, doc_id, d.size ROWS UNBOUNDED PRECEDING) AS upto,
                     sum(d.size) OVER (PARTITION BY d.source ORDER BY substr(lot, 1, 3) RANGE UNBOUNDED PRECEDING) AS bin_upto,
                     sum(d.size) OVER (PARTITION BY d.source, substr(lot, 1, 3)) AS bin_size
              FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
        e AS (SELECT source, min(bin) AS edge FROM r WHERE bin_upto >= extra AND bin_upto - bin_size < extra GROUP BY source)
        SELECT doc_id, size, source_size, round(target, 6) AS target,
               (least(whole + CASE WHEN edge IS NULL THEN 0 WHEN bin < edge THEN 1 WHEN bin > edge THEN 0
                                   WHEN upto - size / 2.0 <= extra THEN 1 ELSE 0 END, 3) * size)::BIGINT AS taken
        FROM r LEFT JOIN e ON r.source IS NOT DISTINCT FROM e.source""",
    "op11_filter_audit": r"""
        WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body FROM documents),
        w AS (SELECT *, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY body) AS first FROM d),
        f AS (SELECT doc_id, part, (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
                     + 4 * (100 * (length(body) - length(regexp_replace(body, '[A-Z]', '', 'g'))) > 3 * length(body))::INT
                     + 8 * regexp_matches(body, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first, first IS NOT NULL)::INT AS mask FROM w),
        l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
        m AS (SELECT part, mask, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
        b AS (SELECT unnest([0, 1, 2, 3, 4]) AS k),
        p AS (SELECT [v.k, w.k, x.k, y.k, z.k] AS ks FROM b v, b w, b x, b y, b z WHERE len(list_distinct([v.k, w.k, x.k, y.k, z.k])) = 5),
        s AS (SELECT array_to_string(list_transform(ks, lambda k: chr(65 + k)), '') AS filter_order, (k + 1)::INT AS step, 1 << ks[k + 1] AS own,
                     coalesce(list_sum(list_transform(ks[1:k], lambda j: 1 << j)), 0)::INT AS before FROM p, b),
        r AS (SELECT part, filter_order, step, own, sum(n) FILTER (mask & (own | before) = 0) AS kept,
                     sum(n) FILTER (mask & own > 0 AND mask & before = 0) AS removed, sum(n) FILTER (mask & own > 0 AND mask & before > 0) AS redundant,
                     sum(n) FILTER (mask = own) AS unique_fails, sum(n) FILTER (mask & own > 0 AND mask & before = 0 AND good) AS good_lost,
                     sum(n) FILTER (mask & own > 0 AND mask & before = 0 AND toxic) AS toxic_lost FROM m, s GROUP BY ALL)
        SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
               coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
               coalesce(sum(removed) OVER (PARTITION BY part, own), 0)::BIGINT AS shapley FROM r""",
    "op12_host_rules": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS body FROM documents),
        a AS (SELECT *, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
        u AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS k FROM a),
        g AS (SELECT r, k, word, lead(word) OVER o AS second, lead(word, 2) OVER o AS third FROM u WINDOW o AS (PARTITION BY r ORDER BY k)),
        h AS (SELECT r, k, third IS NOT NULL AND count(*) OVER (PARTITION BY r, word, second, third) > 1 AS twice FROM g),
        c AS (SELECT r, count(*) AS n FROM (SELECT r, bool_or(twice) OVER (PARTITION BY r ORDER BY k ROWS 2 PRECEDING) AS inside FROM h) WHERE inside GROUP BY r),
        t AS (SELECT doc_id, source, len(words)::BIGINT AS n_words, length(regexp_replace(body, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
                     length(regexp_replace(body, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
                     coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines FROM a LEFT JOIN c USING (r)),
        x AS (SELECT source, unnest([n_words < 50, 100 * n_repeat_words > 50 * n_words, 10 * n_symbols > n_words, 10 * n_dup_lines > 3 * n_lines]) AS failed, unnest([1, 2, 3, 4]) AS rule FROM t),
        s AS (SELECT source, rule, count(*)::DOUBLE AS n, (count(*) FILTER (failed))::DOUBLE AS f FROM x GROUP BY ALL),
        v AS (SELECT rule, count(*) AS m, sum(n) AS n, sum(n * n) AS squares, sum(f) AS f, sum(f * f / n) AS q FROM s GROUP BY rule),
        e AS (SELECT rule, f / n AS mean, (q - f * f / n) / (m - 1) AS between_hosts, (f - q) / (n - m) AS within_hosts, (n - squares / n) / (m - 1) AS size FROM v),
        z AS (SELECT *, (between_hosts - within_hosts) / nullif(between_hosts + (size - 1) * within_hosts, 0) AS alike FROM e),
        i AS (SELECT rule, mean, CASE WHEN isfinite(alike) AND alike > 0 THEN least(10000, greatest(1 / alike - 1, 10)) ELSE 10000 END AS strength FROM z),
        j AS (SELECT source, n + strength AS total, (f + mean * strength) / (n + strength) AS rate FROM s JOIN i USING (rule)),
        k AS (SELECT source, bool_or(rate - 2 * sqrt(rate * (1 - rate) / (total + 1)) > 0.5) AS bad FROM j GROUP BY source)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
               NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR bad) AS kept FROM t JOIN k ON t.source IS NOT DISTINCT FROM k.source""",
    "op13_ranked_search": r"""
        WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
        a AS (SELECT * FROM w WHERE len(words) > 0),
        s AS (SELECT count(*) AS docs, sum(len(words))::BIGINT AS terms FROM a),
        m AS (SELECT r, doc_id, 75 + (25 * len(words) * docs) // terms AS m FROM a, s),
        t AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(words) AS term FROM a) GROUP BY ALL),
        b AS (SELECT row_number() OVER () AS item, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM benchmark),
        q AS (SELECT item, item_id, term, count(*) AS times FROM (SELECT item, item_id, unnest(words) AS term FROM b) GROUP BY ALL),
        f AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM t, s WHERE term IN (SELECT term FROM q) GROUP BY term, docs),
        p AS (SELECT item, item_id, doc_id, r, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
              FROM q JOIN f USING (term) JOIN t USING (term) JOIN m USING (r) GROUP BY ALL)
        SELECT item_id, rank::INT AS rank, doc_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM p WHERE score > 0) WHERE rank <= 20""",
}
