"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import checkpoint_dir

#: ASCII white space: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = "\t\n\x0b\x0c\r "
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(col: Column) -> Column:
    """A-Z to a-z, every other character as it is (pure ASCII takes the faster built-in)."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(
        F.translate(col, UPPER, UPPER.lower())
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which all executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage (a lost executor re-reads files instead of repeating
    the work), keeps columns prunable and lets several consumers share one
    evaluation.  The files belong to the run: they live below
    ``spark.checkpoint.dir`` and go when that folder is cleaned.
    """
    path = shared_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def own_exchange(key: Column) -> Column:
    """The same 64-bit key, but not known to be partitioned yet.

    A join right above an aggregate reuses the aggregate's partitioning, and
    adaptive execution splits hot keys only between two exchanges of the join
    itself.  This key gives the (small, aggregated) side an exchange of its own.
    """
    return key.bitwiseXOR(F.lit(0).cast("long"))


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns by name, ignoring case and names that are absent."""
    gone = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in gone])
