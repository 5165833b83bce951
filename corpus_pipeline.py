"""The corpus pipeline: five stages over ``documents``, each calling one operator of
``navbuckets.llm``.

1. language ID: documents whose language cannot be told go: those without a letter, and those in
   which too few n-grams are common in the learned languages (unlearned languages, noise);
   in a corpus without a label nothing is learned, and only documents without a letter go;
2. n-gram Jaccard join: one document of each group of near copies stays (five-word shingles,
   similarity 0.8 or more);
3. benchmark decontamination: documents with a window of a benchmark item go;
4. PII: personal data is replaced by its kind in brackets, ``n_chars`` follows the text;
5. BPE: texts become token ids (and are decoded again as a check of the round trip).

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``docs``. ``run`` writes each stage's result as Parquet into the shared folder of
``spark.checkpoint.dir`` and reads it back as the next stage's input, so a lost executor costs
one stage at most. Null, empty and repeated texts follow the operators' own rules; an empty
table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from navbuckets.llm import bpe, langid, pii
from navbuckets.llm.common import table
from navbuckets.llm.decontam import decontaminated
from navbuckets.llm.jaccard import deduplicated
from navbuckets.session import scratch_path

TOKENIZER = "byte_bpe_50k.json"


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs, bounds=True)
    told = langid.identify(docs.withColumnsRenamed({c: f"in_{c}" for c in docs.columns if c != "text"}), model, familiar=True)
    kept = told.where("familiar")
    return kept.select(*[F.col(c if c == "text" else f"in_{c}").alias(c) for c in docs.columns])


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return deduplicated(docs, size=5, num=80, den=100)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminated(docs, table(spark, sf_dir, "benchmark"), window=10)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = pii.redact(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(TOKENIZER)
    coded = bpe.round_trip(docs, path, keep=["doc_id", "text"])
    return coded.select("doc_id", "n_tokens", "ids", F.col("decoded").eqNullSafe(F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [
    ("language ID", language_stage),
    ("n-gram Jaccard join", near_copy_stage),
    ("benchmark decontamination", decontamination_stage),
    ("PII", pii_stage),
    ("BPE encoding and decoding", bpe_stage),
]

#: classifiers, boosted trees and BPE are beyond SQL; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents`` of ``sf_dir``: (doc_id, n_tokens, ids, round_trip)."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = scratch_path(spark, "pipeline-" + name.replace(" ", "-").lower())
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
