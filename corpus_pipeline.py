"""The corpus pipeline: documents through five stages to token files.

Each stage takes (spark, docs, sf_dir) and returns the next one's documents, which run() writes to the
shared folder and reads back. All but the last return the columns of documents, whatever else these hold.
In every stage a null text counts as an empty one, and no documents give no rows; for the rest see each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm import decontam, mixing, quality, simhash, wavelet
from ledgerline.llm.common import drop, materialize, scratch


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the classifier, co-trained on the labels, rejects: junk and toxic documents.

    Null sources and languages are values of their own, null lengths count as 0. Repeated rows stay or go
    together. With fewer than 20 labelled documents, or labels of one kind alone, nothing or everything goes.
    """
    return quality.keep_good(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of copies and near copies: that of the least id, a null id last.

    Texts without words are copies of one another. Of rows equal in id and text one stays.
    """
    return simhash.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which a twentieth or more of the words are benchmark passages.

    Documents without words stay. Items without words match nothing. Repeated rows stay or go together.
    """
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take sources by weight: documents of short sources come twice, parts of long ones are left out.

    Null sources are one source. Rows equal in id, text and source are taken together. Documents without words
    count nothing and go where their hash falls.
    """
    return mixing.mix(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write token files and report each document as read back from them, in order of id, null ids first; rows of
    one id follow each other in order of a hash of their text. A document without tokens has its end id alone."""
    return wavelet.tokenize(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("near-dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token files", token_stage),
]

#: The classifier, the fingerprints and the tokenizer are beyond SQL; tests compare each stage with a brute-force form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token report of the documents that the stages keep. Each stage's documents, and the tables it wrote on the way, go when
    the next one's are written. A row of documents may hold nulls, and rows may repeat: see the stages. No documents: no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch() as made:
            after = made.keep(materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}"))
        drop(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
