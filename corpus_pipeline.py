"""A corpus pipeline of five operators: quality, near-dedup, substring dedup, decontamination, packing.

Each stage reads what the one before it kept, as Parquet in the shared scratch folder. All but the
last return the columns of documents (further columns and clashing names included, as they came).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontaminate, minhash, packing, quality, substring
from quern.llm.common import materialise, read, row_of, whole_row
from quern.llm.tokenizing import vocabulary


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id isn't among ids. The rows travel as one struct, so that no name can clash."""
    rows = docs.select(F.col("doc_id").alias("key"), row_of(docs).alias("row"))
    return whole_row(rows.join(ids.select(F.col("doc_id").alias("key")), "key", "left_anti"))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    return quality.accepted(spark, docs, read(spark, sf_dir, "labels"))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies; rows with a null id stay."""
    copies = minhash.near_duplicates(spark, docs).where("not kept").select("doc_id").distinct()
    return _without(docs, copies)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated word windows; words are then joined by one blank. A null text becomes an empty one."""
    return substring.replace_texts(spark, docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    bad = decontaminate.contaminated(spark, docs, read(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return _without(docs, bad)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(spark, docs, vocabulary("byte_bpe_50k.json"), with_ids=False)


STAGES = [
    ("quality", good_quality),
    ("near_dedup", one_of_near_copies),
    ("substring_dedup", without_repeats),
    ("decontamination", decontaminated),
    ("packing", packed),
]

#: The trained classifier and the tokenizer can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(spark, docs, f"stage-{name}")
    return docs
