"""Raw feedback: JSON-lines scan and the projection to implicit interactions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T


# The id columns of the review files and the column of the constant rating.
USER_COL, ITEM_COL, RATING_COL = "user_id", "business_id", "rating"


# Name of the parser's column for lines that it cannot read.
_BROKEN = "_broken"


@dataclass(frozen=True)
class Feedback:
    """A scan of JSON lines.

    ``rows``: the two id columns of the good lines.  ``rejected``: ``(file, line)`` of the others.
    ``seen``: counts ``lines``, ``rejected`` and ``incomplete`` (good lines with an id missing),
    known once an action has run over ``rows``.
    """

    rows: DataFrame
    rejected: DataFrame
    seen: Observation


def scan_feedback(
    spark: SparkSession,
    path: str | list[str],
    user_col: str = USER_COL,
    item_col: str = ITEM_COL,
) -> Feedback:
    """Scan JSON lines for the two id columns, setting lines aside that are not JSON objects.

    The explicit schema spares the inference pass, and the parser skips every other field of a
    line (review text and the like).  Blank lines do not count.
    """
    schema = T.StructType(
        [T.StructField(name, T.StringType()) for name in (user_col, item_col, _BROKEN)]
    )
    lines = spark.read.text(path).where(F.trim("value") != "")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN}
    parsed = F.from_json("value", schema, options)
    # Arrays, numbers and the like parse, but hold no event.
    object_ = F.ltrim("value").startswith("{")
    broken = ~object_ | F.col("event").isNull() | F.col(f"event.{_BROKEN}").isNotNull()
    read = lines.select("value", F.input_file_name().alias("file"), parsed.alias("event"))
    judged = read.withColumn("broken", broken)
    seen = Observation()
    missing = F.col(f"event.`{user_col}`").isNull() | F.col(f"event.`{item_col}`").isNull()
    counted = judged.observe(
        seen,
        F.count(F.lit(1)).alias("lines"),
        F.count_if("broken").alias("rejected"),
        F.count_if(~F.col("broken") & missing).alias("incomplete"),
    )
    rows = counted.where(~F.col("broken")).select(f"event.`{user_col}`", f"event.`{item_col}`")
    rejected = judged.where("broken").select("file", F.col("value").alias("line"))
    return Feedback(rows, rejected, seen)


def read_feedback(
    spark: SparkSession,
    path: str | list[str],
    user_col: str = USER_COL,
    item_col: str = ITEM_COL,
) -> DataFrame:
    """The rows of :func:`scan_feedback`: the two id columns of all lines that can be read."""
    return scan_feedback(spark, path, user_col, item_col).rows


def implicit(
    df: DataFrame,
    user_col: str = USER_COL,
    item_col: str = ITEM_COL,
    rating_col: str = RATING_COL,
) -> DataFrame:
    """Keep the two id columns and add the constant rating: a row is a signal by existing."""
    return df.select(user_col, item_col, F.lit(1.0).cast("float").alias(rating_col))
