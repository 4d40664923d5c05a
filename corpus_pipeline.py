"""A training corpus from raw documents: toxic and poor texts go, near copies are reduced to one, secrets are masked,
and what remains is packed into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm import linecrf, neardup, packing, secrets, toxicity
from starloom.llm.common import stage, table


def free_name(docs: DataFrame) -> str:
    """A name that no column has."""
    return "_" * (1 + max(map(len, docs.columns)))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose texts the machine doesn't reject. Null and empty texts are scored as texts without words; repeated rows are
    kept or go together; an empty table gives none; other columns stay, whatever their names."""
    machine = toxicity.trained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    score = free_name(docs)
    return toxicity.rated(docs, machine, score).where(F.col(score) < toxicity.THRESHOLD).drop(score)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose texts the field doesn't reject; odd rows as in drop_toxic(), null and empty texts as texts without lines."""
    field = linecrf.trained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    score = free_name(docs)
    return linecrf.rated(docs, field, score).where(F.col(score) >= linecrf.THRESHOLD).drop(score)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class, that of the least id; texts without a word are copies of equal ones alone; rows without an id
    stay, as nothing can name them; an empty table gives none; other columns stay."""
    return neardup.deduplicated(docs).select(docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, secrets in their texts masked and n_chars counted anew; null texts stay null with a null count; repeated
    rows stay; an empty table gives none; other columns stay."""
    return secrets.masked(docs, secrets.trained(docs)).withColumn("n_chars", F.length("text").cast("bigint")).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows in sequences; null and empty texts are an end id alone; repeated rows are packed each; an empty
    table gives none; other columns aren't read."""
    return packing.packed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near_duplicates", drop_near_copies),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: Trained models decide three stages, so no SQL gives these rows; tests hold each stage against its operator.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
