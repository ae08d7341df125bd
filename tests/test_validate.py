import datetime as dt

from basketcast.operators.validate import (MSG_DATE, MSG_OK, MSG_PRODUCTS, MSG_QUANTITY, MSG_ROWS, MSG_SPAN, MSG_TXNS,
                                             MSG_WARN, validate)


def _df(spark, rows):
    return spark.createDataFrame(rows, "TransactionID string, Date date, ProductID string, Quantity double")


def test_rule_order(spark):
    d0 = dt.date(2024, 1, 1)
    few = [(f"T{i}", d0, "A", 1.0) for i in range(5)]
    assert validate(_df(spark, few)) == (False, MSG_ROWS)
    one_product = [(f"T{i}", d0 + dt.timedelta(days=i), "A", 1.0) for i in range(12)]
    assert validate(_df(spark, one_product)) == (False, MSG_PRODUCTS)
    few_txn = [("T1" if i % 2 else "T2", d0 + dt.timedelta(days=i), "AB"[i % 2], 1.0) for i in range(12)]
    assert validate(_df(spark, few_txn)) == (False, MSG_TXNS)
    short = [(f"T{i}", d0, "AB"[i % 2], 1.0) for i in range(12)]
    assert validate(_df(spark, short)) == (False, MSG_SPAN)
    good = [(f"T{i}", d0 + dt.timedelta(days=i), "AB"[i % 2], 1.0) for i in range(12)]
    assert validate(_df(spark, good)) == (True, MSG_OK)
    warn = good + [("T99", d0, "A", 0.0)]
    assert validate(_df(spark, warn)) == (True, MSG_WARN)


def test_schema_is_judged_without_reading_rows(spark):
    text = spark.createDataFrame([("T", "2024-01-01", "A", 1.0)], "TransactionID string, Date string, ProductID string, Quantity double")
    assert validate(text) == (False, MSG_DATE)
    words = spark.createDataFrame([("T", dt.date(2024, 1, 1), "A", "x")], "TransactionID string, Date date, ProductID string, Quantity string")
    assert validate(words) == (False, MSG_QUANTITY)
    ok, message = validate(words.drop("Date", "TransactionID"))
    assert not ok and "Date" in message and "TransactionID" in message
