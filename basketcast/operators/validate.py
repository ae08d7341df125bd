"""Data validation as one global aggregate; the rule order is applied to its one-row result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from basketcast.operators.clean import DATE_TYPES, KEYS, REQUIRED, missing_message

# Least numbers a table must reach, in the order they are checked.
MIN_ROWS, MIN_PRODUCTS, MIN_TRANSACTIONS, MIN_DAYS = 10, 2, 5, 7
MSG_ROWS = f"too few rows: at least {MIN_ROWS} are needed"
MSG_PRODUCTS = f"too few products: associations need at least {MIN_PRODUCTS}"
MSG_TXNS = f"too few transactions: at least {MIN_TRANSACTIONS} are needed"
MSG_SPAN = f"history too short: a forecast needs {MIN_DAYS} days or more"
MSG_WARN = ("usable, but some quantities are zero or negative: daily sales and inventory statistics "
            "keep those rows, basket lines leave them out")
MSG_OK = "data is usable"
MSG_DATE = "column Date does not hold dates"
MSG_QUANTITY = "column Quantity does not hold numbers"


def schema_problem(df: DataFrame) -> str | None:
    """What is wrong with the columns or their types, or None; looks at the schema only."""
    missing = [c for c in (*REQUIRED, *(k for k in KEYS if k not in REQUIRED)) if c not in df.columns]
    if missing:
        return missing_message(missing)
    if not isinstance(df.schema["Date"].dataType, DATE_TYPES):
        return MSG_DATE
    if not isinstance(df.schema["Quantity"].dataType, NumericType):
        return MSG_QUANTITY
    return None


def validation_profile(df: DataFrame) -> DataFrame:
    """One row: counts, date span, non-positive quantities, verdict and message.

    Checks, first failure wins: at least 10 rows, 2 products, 5 transactions and a
    7-day span; non-positive quantities keep the data valid with a warning. Missing
    columns and wrong types raise ``ValueError``.
    """
    problem = schema_problem(df)
    if problem:
        raise ValueError(problem)
    prof = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("ProductID").alias("n_products"),
        F.count_distinct("TransactionID").alias("n_transactions"),
        F.min(F.col("Date").cast("date")).alias("min_date"),
        F.max(F.col("Date").cast("date")).alias("max_date"),
        F.count_if(F.col("Quantity") <= 0).alias("n_nonpositive"),
    ).withColumn("date_span_days", F.datediff("max_date", "min_date"))
    message = (F.when(F.col("n_rows") < MIN_ROWS, F.lit(MSG_ROWS))
                .when(F.col("n_products") < MIN_PRODUCTS, F.lit(MSG_PRODUCTS))
                .when(F.col("n_transactions") < MIN_TRANSACTIONS, F.lit(MSG_TXNS))
                .when(F.coalesce(F.col("date_span_days"), F.lit(0)) < MIN_DAYS, F.lit(MSG_SPAN))
                .when(F.col("n_nonpositive") > 0, F.lit(MSG_WARN))
                .otherwise(F.lit(MSG_OK)))
    ok = ~message.isin(MSG_ROWS, MSG_PRODUCTS, MSG_TXNS, MSG_SPAN)
    return prof.select("n_rows", "n_products", "n_transactions", "min_date", "max_date",
                       "date_span_days", "n_nonpositive", ok.alias("is_valid"), message.alias("message"))


def validate(df: DataFrame) -> tuple[bool, str]:
    """``(is_valid, message)``; one job, one row to the driver, none if the schema already fails."""
    problem = schema_problem(df)
    if problem:
        return False, problem
    row = validation_profile(df).first()
    return bool(row["is_valid"]), row["message"]
