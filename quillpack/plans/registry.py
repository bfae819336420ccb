"""Queries by name, each with the SQL that gives the same rows in DuckDB where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Fragments of DuckDB SQL.
S = r"[ \t\n\r\f\x0b]"


def duck_strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{S}+|{S}+$', '', 'g')"


def duck_words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array(coalesce({x}, ''), '{S}+'), lambda v: v <> '')"
