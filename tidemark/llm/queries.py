"""The operators' queries over the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, collocations, licenses, media, mixing, neardup, packing, quality, resharding, sentencepieces, topk_search, toxicity, url_filters


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file lies."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


URL_RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
SHARDS = 8
SEQUENCE = 2048


#: Bytes of the batches that go to Python workers: a batch is held by the executor and by the worker at once.
BATCH_BYTES = "4m"


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of Python workers for the rest of the session; results do not depend on it."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def _bounded(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return f(spark, sf_dir)

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [url_filters.Rule.parse(*r) for r in URL_RULES]
    return url_filters.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 20 == 0)


def op3_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    old = F.pmod(F.crc32(F.coalesce("source", F.lit("")).cast("binary")), F.lit(SHARDS))
    rows = resharding.reshard(docs, old, SHARDS)
    narrow = rows.select("doc_id", "size", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), "shard")
    return resharding.slots(narrow).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = media.add_media(table(spark, sf_dir, "documents").select("doc_id", "text"))
    size = F.octet_length("payload")
    prints = F.transform(F.arrays_zip("times", "codes"), lambda p: F.concat_ws(":", p["times"], p["codes"]))
    return rows.select(
        "doc_id", "n_bytes", size.cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.substring("payload", -media.UNIT, media.UNIT)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), F.concat(F.size("codes"), F.lit(":"), F.md5(F.concat_ws(",", prints).cast("binary"))).alias("feature"),
    )


def held_out(column: str, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text, modulo `parts`, is `part`."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts == part


def learnable(parts: int, part: int) -> Callable[[Column], Column]:
    """For the fit of a model: the rows that are not held out."""
    return lambda column: F.crc32(column.cast("string").cast("binary")) % parts != part


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), learnable(3, 1))
    return toxicity.score(docs, model).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan(docs, licenses.fit(docs))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokenizer_file("piece_bpe_32k.model")
    rows = sentencepieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model, merges=True, decoded=True)
    count = lambda c: (F.octet_length(c) / 4).cast("long")
    return rows.select(
        "doc_id", count("ids").alias("n_ids"), F.crc32("ids").alias("ids_crc32"), F.round("path_score", 3).alias("path_score"), count("merge_ids").alias("n_merge_ids"), F.crc32("merge_ids").alias("merge_ids_crc32"),
        (F.col("decoded_text") == F.col("normal_text")).alias("round_trip"),
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), learnable(5, 0))
    return quality.score(docs, model).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def pieces_of(docs: DataFrame) -> DataFrame:
    return packing.token_pieces(docs, tokenizer_file("word_bpe_49k.json"), SEQUENCE)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pieces_of(table(spark, sf_dir, "documents"))
    return packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), SEQUENCE)


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.measured(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), max_words=3, least=10, covered=50, most=2000)


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = mixing.fit(docs.where(~held_out("doc_id", 7, 2)))
    return mixing.score(docs, model).select("doc_id", held_out("doc_id", 7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {
        "op1_url_filters": op1_url_filters,
        "op2_topk_search": op2_topk_search,
        "op3_resharding": op3_resharding,
        "op4_toxicity": op4_toxicity,
        "op5_media": op5_media,
        "op6_packing": op6_packing,
        "op7_license_scans": op7_license_scans,
        "op8_sentencepiece": op8_sentencepiece,
        "op9_quality": op9_quality,
        "op10_minhash_near_dedup": op10_minhash_near_dedup,
        "op11_tokenizer_alignment": op11_tokenizer_alignment,
        "op12_phrase_collocations": op12_phrase_collocations,
        "op13_lm_scoring": op13_lm_scoring,
    }
    return {name: _bounded(f) for name, f in found.items()}


_URL_SQL = r"""
WITH rules(verdict, rule) AS (VALUES {rules}),
split AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM split),
hits AS (
  SELECT p.page_id, r.rule, r.verdict, row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rule) DESC, r.rule) AS n
  FROM parts p JOIN rules r ON starts_with(p.path, substr(r.rule, strpos(r.rule, '/')))
   AND (p.host = split_part(r.rule, '/', 1) OR ends_with(p.host, '.' || split_part(r.rule, '/', 1))))
SELECT p.page_id, p.host, p.path, h.rule, coalesce(h.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN hits h ON p.page_id = h.page_id AND h.n = 1
"""

_TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64.0 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

_PHRASE_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
split AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda w: w <> '') AS w FROM pieces),
rows AS (
  SELECT lang, 1 AS size, unnest(w) AS phrase FROM split
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM split
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM split),
f AS MATERIALIZED (SELECT lang, size, phrase, count(*) AS f, string_split(phrase, ' ') AS w FROM rows GROUP BY lang, size, phrase),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
candidates AS (SELECT * FROM f WHERE size > 1 AND f >= 10),
cuts AS (SELECT lang, phrase, f AS a, k, array_to_string(w[1:k], ' ') AS lp, array_to_string(w[k + 1:size], ' ') AS rp FROM candidates, (VALUES (1), (2)) AS c(k) WHERE k < size),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, ((1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.lp JOIN f y ON y.lang = c.lang AND y.phrase = c.rp),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (
  SELECT * FROM weakest p WHERE NOT EXISTS (
    SELECT 1 FROM candidates q WHERE q.lang = p.lang AND q.size = 3 AND (q.w[1] || ' ' || q.w[2] = p.phrase OR q.w[2] || ' ' || q.w[3] = p.phrase) AND 100 * q.f >= 50 * p.a))
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept k JOIN totals t ON t.lang = k.lang QUALIFY rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op12_phrase_collocations": _PHRASE_SQL, "op1_url_filters": _URL_SQL.format(rules=", ".join(f"('{v}', '{r}')" for v, r in URL_RULES)), "op2_topk_search": _TOP_K_SQL}
