"""The thin queries over the operators of this subpackage, and their SQL where SQL can state the result."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, decontaminate, embedding_dedup, language, ngram_join, pii, quality, sharding, substring_dedup, warc
from .common import read_table
from .sql import SQL

#: Where the public vocabulary files are; a parameter of every operator that uses one.
TOKENIZERS = "/opt/tokenizers"


def held_out(doc_id: str = "doc_id"):
    """Rows that nothing is learnt from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def contaminated():
    """Benchmark words make up a twentieth of the document's."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.NeighbourDescent(read_table(spark, sf_dir, "embeddings")).links()


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.written(read_table(spark, sf_dir, "pages"))
    return warc.read_back(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.spotted(docs, pii.fit_tagger(docs), ["doc_id"])

    def line(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(kind):
        return F.size(F.filter("pii", lambda s: ~s["by_model"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    base = F.filter("pii", lambda s: ~s["by_model"])
    counts = [number(k) for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(line(base).cast("binary"), 256).alias("base_sha256"), line(F.col("pii")).alias("spans"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    rows = sharding.compacted_store(docs).rows()
    text = F.col("text").cast("binary")
    return rows.select("doc_id", "lang", "source", F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("text_sha256"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit_languages(docs.where(~held_out()), f"{TOKENIZERS}/piece_bpe_32k.model")
    out = language.identified(docs, model, ["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.NgramJoin(read_table(spark, sf_dir, "documents")).components()


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.Repeats(read_table(spark, sf_dir, "documents")).documents()


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    field = quality.fit_lines(docs, read_table(spark, sf_dir, "labels").where(~held_out()))
    out = quality.scored(docs, field, ["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode_decode(docs, f"{TOKENIZERS}/word_bpe_49k.json", keep=["doc_id"])
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


__all__ = ["QUERIES", "SQL"]

QUERIES = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_warc": op2_warc,
    "op3_pii": op3_pii,
    "op4_decontaminate": op4_decontaminate,
    "op5_sharding": op5_sharding,
    "op6_language": op6_language,
    "op7_ngram_join": op7_ngram_join,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_quality": op9_quality,
    "op10_bpe_roundtrip": op10_bpe_roundtrip,
}
