"""A corpus pipeline of five operators: each stage works on what the one before it kept."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomglass.llm import bpe, decontaminate, ngram_join, pii, quality
from loomglass.llm.common import dropped, read_table, settled
from loomglass.llm.queries import TOKENIZERS, contaminated, held_out

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field scores 0.5 or more; it learns from labels outside the held-out third."""
    labels = read_table(spark, sf_dir, "labels").where(~held_out())
    return quality.scored(docs, quality.fit_lines(docs, labels), COLUMNS).where("score >= 0.5").select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies.

    Rows repeated with one id and text stay once; rows without id stay. If an
    id has several texts, they stay if one of them stands for its group.
    """
    found = ngram_join.NgramJoin(docs).components().where("doc_id is not null")
    told = found.groupBy("doc_id").agg(F.max("component_id").alias("__group"), F.count("*").alias("__rows"))
    kept = docs.select(*COLUMNS).join(settled(told, "groups"), "doc_id", "left").where("__group is null or __group = doc_id")
    once = kept.where("__rows > 1").dropDuplicates(["doc_id", "text"])
    return kept.where("__rows is null or __rows = 1").union(once).select(*COLUMNS)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passages worth 5 % of their words."""
    found = decontaminate.contamination(docs, read_table(spark, sf_dir, "benchmark"), COLUMNS)
    return found.where(~contaminated()).select(*COLUMNS)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by the name of its kind."""
    found = pii.spotted(docs, pii.fit_tagger(docs), COLUMNS, redact=True)
    clean = F.when(F.size("pii") > 0, F.col("clean")).otherwise(F.col("text"))
    n_chars = F.when(F.size("pii") > 0, F.char_length("clean").cast("long")).otherwise(F.col("n_chars"))
    return found.select("doc_id", clean.alias("text"), "lang", "source", n_chars.alias("n_chars"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids, with digests of the ids and of what they decode to."""
    coded = bpe.encode_decode(docs, f"{TOKENIZERS}/word_bpe_49k.json", keep=["doc_id", "lang", "source"])
    return coded.select(
        "doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids",
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", without_benchmarks),
    ("PII", without_personal_data),
    ("BPE encoding and decoding", tokens),
]

#: SQL can't state the learnt stages; tests hold the whole against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = settled(stage(spark, docs, sf_dir), name.split()[0])
        if before is not None:
            dropped(spark, before)  # the table of the stage before
        before = docs
    return docs
