"""A cleaning pipeline over ``documents``: each stage works on all that the one before kept.

Language ID rejects documents that the model takes for none of the languages and
names the language of those without one; line dedup drops a
source's boilerplate lines; the n-gram Jaccard join keeps one document of each
group of near copies; the secret scan redacts what it reports; packing gives the
token sequences of what is left.  A stage's result is written as Parquet in the
cluster's shared folder and read again as the next one's documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilframe.llm import jaccard_join, language_id, line_dedup, packing, secret_scan
from vigilframe.llm.common import shared_folder


def _columns(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like``, with the number of characters of the text as it is now."""
    out = docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in like.columns else docs
    return out.select(*like.columns)


#: A text of this many n-grams at least whose evidence for its best language is lower is in none of the languages.
ENOUGH_GRAMS, LEAST_EVIDENCE = 40, 0.1


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text the model takes for one of the learned languages.

    A text without a letter goes, and one that is long enough to judge and shows next
    to nothing of any learned language (another script, random letters).  A document
    without ``lang`` gets the predicted one; other columns stay.  Where no row tells a
    language to learn, every text with a letter stays as it is.
    """
    model = language_id.fit(docs)
    if not model.languages:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    judged = docs.withColumn("__language", language_id.predicted(F.col("text"), model, spark))
    foreign = (F.col("__language.grams") >= ENOUGH_GRAMS) & (F.col("__language.evidence") < LEAST_EVIDENCE)
    kept = judged.where((F.col("__language.lang_pred") != "und") & ~foreign)
    return kept.withColumn("lang", F.coalesce("lang", "__language.lang_pred")).select(*docs.columns)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a tenth of their source's documents share.

    Near copies are the next stage's: by its measure, a group of them counts as one document here.
    """
    copies = lambda texts: jaccard_join.components(texts, id_col="__body", text_col="__text").withColumnRenamed("component_id", "component")
    return _columns(line_dedup.drop_site_lines(docs, "source", "text", ratio=0.1, min_pages=5, keep_whole=True, copies=copies), docs)


def keep_one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.deduplicate(docs).select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _columns(secret_scan.redact(docs), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    # The workers also run the other stages, so they keep nothing.
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), remember=False)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_boilerplate),
    ("ngram_jaccard_join", keep_one_of_copies),
    ("secret_scan", redact_secrets),
    ("packing", pack_sequences),
]

#: SQL cannot express the language model, the signatures or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
