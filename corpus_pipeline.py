"""The documents' way through the pipeline; part of the subpackage llm.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor
kept, and returns a DataFrame; all but the last return the columns of
documents.  Between stages the rows are written as Parquet and read again, by
``run`` as by any other runner of STAGES.

In all stages rows of null doc_id are documents like any other, null and empty
texts stay (they are not toxic, hold nothing twice and match no passage), columns
beyond those of documents stay with their rows, whatever their names, and an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weirflow.llm import decontam, packing, simhash, substrings, toxicity
from weirflow.llm.common import shared_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; without labels of both kinds none does."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays, of the texts without words too: that of least doc_id, rows without one last."""
    return simhash.keep_one(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings that an earlier document has go; documents of which nothing is left go with them.  Rows without a doc_id stay whole."""
    return substrings.deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark windows in a twentieth of their words or more go; an empty benchmark takes none."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, ids by their digest; a text without words is its end id alone."""
    return packing.packed(docs, digest=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("repeats", drop_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Scores of a trained model, components and tokens: SQL expresses none of these; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = shared_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
