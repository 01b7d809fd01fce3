"""The registered queries of this subpackage: thin callers of the operators, with their contracts' columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, katz, line_dedup, near_join, personal_data, piece_codec, quality, resampling, sharding, simhash_near, source_audit, token_file
from .common import documents, scratch


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    token_file.write_tokens(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"), path)
    return token_file.read_documents(spark, path)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op3_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score_documents(documents(spark, sf_dir), quality.held_out(F.col("doc_id"), 10), stable=True)


def op4_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode_pieces(documents(spark, sf_dir), tokenizer("piece_bpe_32k.model"), digests=True).withColumnRenamed("decoded", "decoded_sha256")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join.near_components(documents(spark, sf_dir), k=4, percent=85)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir), [1.0] * 40)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    forest = quality.train(docs, labels.filter(~quality.held_out(F.col("doc_id"))))
    out = quality.score_documents(docs, forest)
    return out.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def _of_rank(rank: int) -> Callable[[Column], Column]:
    return lambda span: span["rank"] == rank


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.find_personal_data(documents(spark, sf_dir))
    counts = [F.size(F.filter("base", _of_rank(r))).cast("long").alias(f"n_{kind}") for r, kind in enumerate(personal_data.PATTERNS)]
    term = F.size(F.filter("spans", _of_rank(personal_data.KINDS.index("term")))).cast("long")
    return found.select(
        "doc_id", *counts, F.sha2(personal_data.spelled(F.col("base")), 256).alias("base_sha256"), personal_data.spelled(F.col("spans")).alias("spans"),
        (F.size("spans") - term).cast("long").alias("n_protected"), term.alias("n_terms"), F.sha2(personal_data.sanitised(F.col("text"), F.col("spans")), 256).alias("sanitised_sha256"),
    )


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_simhash_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_near.simhash_components(documents(spark, sf_dir))


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.divergence(documents(spark, sf_dir, "lang", "source"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_file, op2_line_dedup, op3_katz, op4_piece_codec, op5_decontaminate, op6_near_join, op7_sharding, op8_quality, op9_personal_data, op10_exact_dedup,
        op11_resampling, op12_simhash_near, op13_source_audit,
    )
}

_LINES = r"""
    SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
    FROM (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: The unsigned crc32 of the UTF-8 bytes of w: bytes from its hexadecimal digits, eight shifts a byte.
_CRC = """
    xor(list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(range(1, 2 * strlen(w), 2), lambda i: ('0x' || substr(hex(w), i, 2))::BIGINT)),
        lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda d, k: xor(d >> 1, 3988292384 * (d & 1)))
    ), 4294967295)
"""
_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".format(_LOWER)
_SHARE = "(1 + (1000000000::HUGEINT * ({n} + 2)) // ({total} + 2 * v))"

ORACLES = {
    "op2_line_dedup": f"""
        WITH lines AS ({_LINES}),
        shared AS (SELECT k, max(doc_id) AS last FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
        marked AS (SELECT l.*, coalesce(s.last IS NOT NULL AND l.doc_id <> s.last, false) AS gone FROM lines l LEFT JOIN shared s ON l.k = s.k)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
    "op10_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op11_resampling": f"""
        WITH docs AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
        own AS (SELECT doc_id, unnest(ws) AS w FROM docs),
        wanted AS (SELECT unnest({_WORDS}) AS w FROM benchmark),
        buckets AS (SELECT w, {_CRC} % 10000 AS bucket FROM (SELECT w FROM own UNION SELECT w FROM wanted)),
        placed AS (SELECT doc_id, bucket FROM own JOIN buckets USING (w)),
        s AS (SELECT bucket, count(*) AS s FROM placed GROUP BY bucket),
        t AS (SELECT bucket, count(*) AS t FROM wanted JOIN buckets USING (w) GROUP BY bucket),
        sums AS (SELECT (SELECT count(*) FROM own)::DOUBLE AS big_s, (SELECT count(*) FROM wanted)::DOUBLE AS big_t),
        gain AS (
            SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (big_s + 10000) / ((s + 1)::DOUBLE * (big_t + 10000))))::BIGINT AS gain
            FROM s LEFT JOIN t USING (bucket) CROSS JOIN sums),
        weighed AS (SELECT doc_id, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM placed JOIN gain USING (bucket) GROUP BY doc_id),
        scored AS (
            SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
                coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
            FROM docs LEFT JOIN weighed USING (doc_id)),
        ranks AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= 20)
        SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT 10 * count(*) // 100 FROM ranks) THEN rank END AS rank
        FROM scored LEFT JOIN ranks USING (doc_id)""",
    "op13_source_audit": f"""
        WITH docs AS (
            SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                regexp_extract_all({_LOWER}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
            FROM documents),
        each AS (SELECT r, lang, source, unnest(terms) AS term FROM docs),
        kept AS (SELECT lang, term, count(*) AS in_lang FROM each GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
        langs AS (SELECT lang, count(*) AS v, sum(in_lang) AS total FROM kept GROUP BY lang),
        n AS (SELECT lang, source, term, count(*) AS n FROM each JOIN kept USING (lang, term) GROUP BY lang, source, term),
        own AS (SELECT lang, source, sum(n) AS own FROM n GROUP BY lang, source),
        groups AS (SELECT lang, source, coalesce(own, 0) AS own FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN own USING (lang, source)),
        shares AS (
            SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n,
                {_SHARE.format(n="coalesce(n, 0)", total="own")} AS p, {_SHARE.format(n="in_lang", total="total")} AS q
            FROM groups g JOIN kept k USING (lang) JOIN langs USING (lang) LEFT JOIN n USING (lang, source, term)),
        sums AS (
            SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
            FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
        parts AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
            FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
            UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM shares WHERE n > 0 AND p > q)
        SELECT lang, source, part, item, value, rank::INTEGER AS rank
        FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
        WHERE part = 'pair' OR rank <= 10""",
}
