"""The registered queries of this package: each applies one operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plantledger.llm.bucket_digest import fingerprints
from plantledger.llm.byte_cnn import fitted, identify
from plantledger.llm.chunk_recipes import exact_duplicates
from plantledger.llm.exact_packing import pack
from plantledger.llm.html_density import extract_pages
from plantledger.llm.importance_resampling import resample
from plantledger.llm.lattice_sampling import decoded, sample_segmentations
from plantledger.llm.lattice_scores import score_texts
from plantledger.llm.repeated_spans import remove_repeats
from plantledger.llm.secret_index import BASE, scan_secrets, span_text, spans_sql
from plantledger.llm.shingle_join import near_duplicates
from plantledger.llm.term_scan import rank_documents
from plantledger.llm.url_filter import Rule, judge_urls

Run = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Run] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Run], Run]:
    def register(run: Run) -> Run:
        QUERIES[run.__name__] = run
        if sql:
            SQL[run.__name__] = sql
        return run
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op1_html_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_pages(table(spark, sf_dir, "pages"))
    return found.select(F.col("_id").alias("page_id"), F.col("_url").alias("url"), "text", "n_chars")


@query()
def op2_bucket_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints(table(spark, sf_dir, "documents"))
    return found.withColumnRenamed("_id", "doc_id")


TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Path of a vocabulary file of the public tokenizers installed beside Python."""
    import public_tokenizers
    return public_tokenizers.path(name)


@query()
def op4_exact_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return found.withColumnRenamed("_id", "doc_id")


def held_out(number: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(number).cast("string").cast("binary")) % 3 == 1, F.lit(False))


@query()
def op6_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fitted(docs.where(F.col("doc_id").isNotNull() & ~held_out()))
    found = identify(docs, model)
    return found.select(F.col("_id").alias("doc_id"), held_out("_id").alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))


URL_RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


@query()
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge_urls(table(spark, sf_dir, "pages"), URL_RULES)
    return found.withColumnRenamed("_id", "page_id")


@query(spans_sql())
def op8_secret_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("_spans", lambda s: s["number"] < len(BASE))
    return found.select(F.col("_id").alias("doc_id"), *(count(rule.kind) for rule in BASE), F.sha2(span_text(base).cast("binary"), 256).alias("base_sha256"),
                        span_text(F.col("_spans")).alias("spans"))


@query(r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents
), r AS (
  SELECT doc_id, body, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
         row_number() OVER w AS place
  FROM t WINDOW w AS (PARTITION BY body ORDER BY n DESC, doc_id NULLS LAST)
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(body) AS text_sha256 FROM r""")
def op10_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("_id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


@query()
def op9_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("_id").alias("doc_id"), "n_shingles", "component_id")


@query()
def op3_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).withColumnRenamed("_id", "doc_id")


PIECES = "piece_bpe_32k.model"


@query()
def op5_lattice_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    model = tokenizer_path(PIECES)
    found = sample_segmentations(turns, model, ["conv_id", "turn"])
    return found.select(F.col("_key0").alias("conv_id"), F.col("_key1").alias("turn"), "sample", "ids", "n_pieces", "log_p", "score", "inclusion",
                        F.sha2(decoded("ids", model).cast("binary"), 256).alias("decoded_sha256"))


#: The checksum of a word's bytes, a table of 256 numbers at a time; DuckDB has no function for it.
CRC_SQL = """
bits AS (SELECT list(list_reduce([b::BIGINT, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY b) AS t
  FROM range(256) AS r(b)),
crcs AS (SELECT word, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(word))::BIGINT),
    lambda i: ('0x' || substr(hex(encode(word)), 2 * i::INT + 1, 2))::BIGINT)), lambda c, b: xor(c // 256, t[(xor(c, b) % 256 + 1)::INT]))) % 10000 AS bucket
  FROM (SELECT DISTINCT word FROM words), bits)"""


def _words_sql(name: str, key: str) -> str:
    return rf"""SELECT {key}, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM {name}"""


@query(f"""
WITH docs AS (SELECT row_number() OVER () AS place, doc_id, text FROM documents),
words AS ({_words_sql("docs", "place")} UNION ALL {_words_sql("benchmark", "NULL")}), {CRC_SQL},
counts AS (SELECT bucket, count(place) AS s, count(*) - count(place) AS t FROM words JOIN crcs USING (word) GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000) / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM counts),
bags AS (SELECT place, count(*) AS n, floor(sum(gain) / count(*))::BIGINT AS weight FROM words JOIN crcs USING (word) JOIN gains USING (bucket) WHERE place IS NOT NULL GROUP BY place),
scored AS (SELECT place, doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln(
    (('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM docs LEFT JOIN bags USING (place)),
ranked AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) END AS r FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 10 * (SELECT count(*) FROM scored WHERE n_features >= 20) // 100 THEN r END AS rank FROM ranked""")
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumnRenamed("_id", "doc_id")


def _terms_sql(name: str, key: str) -> str:
    return rf"""SELECT {key}, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM {name}"""


@query(f"""
WITH docs AS (SELECT row_number() OVER () AS place, doc_id, text FROM documents),
counts AS (SELECT place, doc_id, term, count(*) AS tf FROM ({_terms_sql("docs", "place, doc_id")}) GROUP BY ALL),
sizes AS (SELECT place, sum(tf)::BIGINT AS n FROM counts GROUP BY place),
totals AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS length FROM sizes),
asked AS (SELECT DISTINCT item_id, term FROM ({_terms_sql("benchmark", "item_id")})),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM counts, totals GROUP BY term, docs),
scores AS (SELECT item_id, doc_id, place, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // length))))::BIGINT AS score
  FROM asked JOIN counts USING (term) JOIN weights USING (term) JOIN sizes USING (place), totals GROUP BY item_id, doc_id, place),
ranked AS (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST))::INTEGER AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50""")
def op13_term_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("_item").alias("item_id"), "rank", F.col("_id").alias("doc_id"), "score")


@query()
def op12_lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    def remainder(number: str) -> Column:
        return F.crc32(F.col(number).cast("string").cast("binary")) % 10

    found = score_texts(table(spark, sf_dir, "documents"), tokenizer_path(PIECES), remainder("doc_id") != 0)
    return found.select(F.col("_id").alias("doc_id"), F.coalesce(remainder("_id") == 0, F.lit(False)).alias("held_out"),
                        "n_tokens", "n_known", "train_tokens", "base_score", "score")
