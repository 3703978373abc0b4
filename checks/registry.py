"""Registration of queries and composition of their SQL from named steps."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.fixtures import World

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
STEPS: dict[str, str] = {}
DIGITS = 6


def step(name: str, sql: str) -> None:
    """Name a SQL step that later steps and queries may read."""
    STEPS[name] = sql.strip()


def compose(sql: str) -> str:
    """Prefix a query with the steps it reads, directly or through other steps."""
    order = {name: place for place, name in enumerate(STEPS)}
    needed: set[str] = set()

    def visit(text: str) -> None:
        for word in set(re.findall(r"\b[a-z_][a-z0-9_]*\b", text)):
            if word in STEPS and word not in needed:
                needed.add(word)
                visit(STEPS[word])

    visit(sql)
    if not needed:
        return sql.strip()
    parts = [f"{n} AS MATERIALIZED ({STEPS[n]})" for n in sorted(needed, key=order.get)]
    text = sql.strip()
    joint = ",\n" + text[4:] if text.startswith("WITH") else "\n" + text
    return "WITH " + ",\n".join(parts) + joint


def tidy(df: DataFrame) -> DataFrame:
    """Round fractions and print lists, so that both engines show the same cells."""
    columns = []
    for field in df.schema.fields:
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            value = F.round(value.cast("double"), DIGITS) + F.lit(0.0)
        elif isinstance(field.dataType, T.DecimalType):
            value = value.cast("bigint")
        elif isinstance(field.dataType, T.ArrayType):
            value = F.array_join(F.transform(value, lambda x: x.cast("string")), ",")
        columns.append(value.alias(field.name))
    return df.select(*columns)


def check(name: str, sql: str | None = None) -> Callable:
    """Register ``function(world) -> DataFrame`` under a name."""

    def register(function: Callable[[World], DataFrame]) -> Callable:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return tidy(function(World.of(spark, sf_dir)))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = compose(sql)
        return function

    return register


def r(expression: str, name: str | None = None) -> str:
    """Rounded SQL fraction."""
    alias = name or expression
    return f"ROUND(CAST({expression} AS DOUBLE), {DIGITS}) + 0.0 AS {alias}"


def f32(expression: str, name: str) -> str:
    """Rounded SQL fraction that passes through single precision."""
    return r(f"CAST({expression} AS FLOAT)", name)
