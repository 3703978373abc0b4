"""CSV and TSV sinks, and the strict recommendation CSV source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from morrow.operators.quality import all_checks, count_as_violation, violation_counts

# The accepted decimal form of an id and of a JSON integer.
DECIMAL_ID = r"^(?:0|[1-9][0-9]*)$"
JSON_INTEGER = r"^-?(?:0|[1-9][0-9]*)$"
UINT64_MAX = 2**64 - 1
INT32_MIN, INT32_MAX = -(2**31), 2**31 - 1


def write_recommendations(recommendations: DataFrame, path: str) -> None:
    """``user_id,item_ids`` with a JSON list, files in user order."""
    rows = recommendations.select("user_id", F.to_json("item_ids").alias("item_ids"))
    ranged = rows.repartitionByRange("user_id").sortWithinPartitions("user_id")
    ranged.write.option("header", "true").option("escape", '"').csv(path)


def read_recommendation_text(spark: SparkSession, path: str) -> DataFrame:
    """The raw text cells; a row with other than two cells fails the read."""
    return (
        spark.read.schema("user_id string, item_ids string")
        .option("header", "true")
        .option("enforceSchema", "false")
        .option("escape", '"')
        .option("mode", "FAILFAST")
        .csv(path)
    )


def _elements(text: Column) -> Column:
    """Texts of the list elements; null when the cell is not a JSON list of scalars."""
    return F.from_json(text, "array<string>")


def recommendation_text_checks(rows: DataFrame, k: int = 20) -> DataFrame:
    """Every way in which text rows can break the strict format."""
    user = F.col("user_id")
    listed = F.col("item_ids").rlike(r"^\s*\[.*\]\s*$")
    parts = F.when(listed, _elements(F.col("item_ids")))
    # The raw text between commas tells 1 from 1.0, 1e0 and "1".
    raw = F.transform(
        F.split(F.regexp_replace("item_ids", r"^\s*\[|\]\s*$", ""), ","), lambda x: F.trim(x)
    )
    integers = F.forall(raw, lambda x: x.rlike(JSON_INTEGER))
    numbers = F.transform(raw, lambda x: x.try_cast("decimal(38,0)"))
    in_range = F.forall(
        numbers, lambda x: x.isNotNull() & (x >= INT32_MIN) & (x <= INT32_MAX)
    )
    wide = user.try_cast("decimal(38,0)")
    rules = {
        "user_not_decimal": ~user.rlike(DECIMAL_ID),
        "user_over_uint64": user.rlike(DECIMAL_ID)
        & (wide.isNull() | (wide > F.lit(str(UINT64_MAX)).cast("decimal(38,0)"))),
        "not_a_json_list": parts.isNull(),
        "wrong_length": parts.isNotNull() & (F.size(parts) != k),
        "not_integers": parts.isNotNull() & ~integers,
        "outside_int32": parts.isNotNull() & integers & ~in_range,
        "repeated_item": parts.isNotNull()
        & integers
        & (F.size(F.array_distinct(numbers)) != F.size(numbers)),
    }
    copies = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    return all_checks(
        violation_counts(rows, rules), count_as_violation(copies, "duplicate_user_id")
    )


def parse_recommendations(rows: DataFrame) -> DataFrame:
    """Typed recommendations from checked text rows; ids keep all 64 unsigned bits."""
    return rows.select(
        F.col("user_id").cast("decimal(20,0)").alias("user_id"),
        F.from_json("item_ids", "array<int>").alias("item_ids"),
    )


def write_training_rows(rows: DataFrame, path: str) -> None:
    """Tab-separated label, weight and features without a header."""
    rows.write.option("sep", "\t").option("header", "false").csv(path)


def write_grouped_rows(rows: DataFrame, path: str) -> None:
    """Tab-separated rows, the rows of one group next to each other in one file.

    A group holds at most a union cap of rows, so ranges of groups stay balanced.
    """
    ordered = rows.repartitionByRange("group_id").sortWithinPartitions("group_id", "item_id")
    columns = ["label", "group_id", *[c for c in rows.columns if c not in ("label", "group_id", "item_id")]]
    ordered.select(*columns).write.option("sep", "\t").option("header", "false").csv(path)


def column_description(
    spark: SparkSession, features: Sequence[str], *, second: str = "Weight"
) -> DataFrame:
    """Role of every column of the training text: Label, Weight or GroupId, Num."""
    rows = [(0, "Label", None), (1, second, None)]
    rows += [(i + 2, "Num", name) for i, name in enumerate(features)]
    return spark.createDataFrame(rows, "position int, role string, name string")
