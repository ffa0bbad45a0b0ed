"""Where queries and their oracles are registered, and what they share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.sources import tables as src

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: Parameters shared by queries and oracles.
USER, OTHER, TAG, NODES = 5, 9, "Brand#1", 4


def query(oracle: str | None = None):
    """Register a query under its name, with its oracle."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def tab(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return src.table(spark, sf_dir, name)


def rounded(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


def folder(spark: SparkSession) -> str:
    """A place of its own for a query's files, in the shared folder."""
    return f"{src.shared_folder(spark)}/streams/{uuid.uuid4().hex}"
