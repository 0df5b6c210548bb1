"""Corpus pipeline: quality, near duplicates, personal data, mixture, packing.

Each stage is (spark, docs, sf_dir) -> DataFrame over whole texts; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom import runtime
from quadloom.llm import jaccard, mixing, packing, pii, quality


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from a bounded sample of all labels (quality.PER_CLASS).

    Null and empty texts are scored like others, long ones whole; repeated rows stand or fall together. Without labelled
    documents of both classes every text has the labels' rate as its score. Other columns pass; an empty table is empty.
    """
    model = quality.train(docs, runtime.table(spark, sf_dir, "labels"))
    return quality.keep(docs, model)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a Jaccard similarity of 0.8 or more on word 5-grams, the row with the smallest id stays.

    Rows without words (null and empty texts too) are linked with nothing and all stay; rows without an id come last in
    their group; of rows that repeat id and text one stays. Other columns pass; an empty table is empty.
    """
    return jaccard.deduplicate(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data get surrogates; n_chars follows the text (null for a null text).

    Null and empty texts stay; repeated rows are changed alike. Other columns pass; an empty table is empty.
    """
    count = runtime.free_names(docs.columns, "pii_entities")[0]
    out = pii.replace(docs, key=pii.session_key(spark), count_col=count)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("bigint"))
    return out.select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture's rows, once per epoch; the document where a leaf's prefix ends stays whole.

    Null and empty texts have no tokens and stay where their place in the order is before the prefix's end; null keys
    count as ''; rows that repeat an id stand or fall together. Other columns pass; an empty table is empty.
    """
    domain = runtime.free_names(docs.columns, "domain")[0]
    return mixing.mix_documents(docs, domain).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in sequences of 2048 tokens.

    Null and empty texts are the end token alone; repeated rows are packed each; other columns are not read; an empty
    table is empty.
    """
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the network nor the tokenizer; tests/llm/test_pipeline.py compares stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = runtime.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = runtime.materialize(docs, f"stage-{name}")
            runtime.release(spark)
    return docs
