import datetime as dt

import pytest
from pyspark.sql import Row

from basketcast.functions.columns import standardize_column_names
from basketcast.operators.baskets import basket_lines, dataset_stats, preview
from basketcast.operators.clean import normalize_transactions
from basketcast.operators.ordering import position_within
from basketcast.sources import read_transactions, write_csv


def test_standardize_prefers_exact_names_dup_headers():
    # B1: ProductName / ProductCategory must not also become ProductID
    cols = ["Date", "TransactionID", "ProductID", "ProductName", "ProductCategory", "Quantity", "Price"]
    assert standardize_column_names(cols) == {}
    cols = ["order date", "Invoice-No", "item name", "qty", "sku"]
    mapping = standardize_column_names(cols)
    assert mapping["order date"] == "Date"
    assert mapping["Invoice-No"] == "TransactionID"
    assert mapping["qty"] == "Quantity"
    assert sum(1 for v in mapping.values() if v == "ProductID") == 1


def test_missing_required_column_raises(spark):
    df = spark.createDataFrame([("2024-01-01", "A")], "Date string, ProductID string")
    with pytest.raises(ValueError, match="Quantity"):
        normalize_transactions(df)


def test_bad_quantity_coerced_and_dropped(spark):
    # P6/P7: "x" and null quantities are dropped, 0 and negatives kept
    rows = [("T1", "2024-01-01", "A", "2"), ("T1", "2024-01-01", "B", "x"), ("T2", "2024-01-02", "A", None),
            ("T3", "2024-01-02", "C", "0"), ("T4", "2024-01-03", "C", "-1")]
    df = spark.createDataFrame(rows, "TransactionID string, Date string, ProductID string, Quantity string")
    out = normalize_transactions(df).orderBy("TransactionID").collect()
    assert [(r.TransactionID, r.Quantity) for r in out] == [("T1", 2.0), ("T3", 0.0), ("T4", -1.0)]
    assert out[0].Date == dt.date(2024, 1, 1)


def test_bad_date_raises(spark):
    df = spark.createDataFrame([("T1", "not a date", "A", 1.0)],
                               "TransactionID string, Date string, ProductID string, Quantity double")
    with pytest.raises(Exception):
        normalize_transactions(df).collect()


def test_timestamps_same_day_group_together(spark):
    # B3: two rows on one day at different hours are one daily group
    rows = [("T1", dt.datetime(2024, 1, 1, 9), "A", 1.0), ("T2", dt.datetime(2024, 1, 1, 17), "A", 2.0)]
    df = spark.createDataFrame(rows, "TransactionID string, Date timestamp, ProductID string, Quantity double")
    from basketcast.operators.daily import daily_sales
    out = daily_sales(normalize_transactions(df)).collect()
    assert len(out) == 1 and out[0].Quantity == 3.0


def test_synthesized_transaction_ids(spark):
    # P5: yyyyMMdd_k with k the running count inside the date, in row order
    rows = [("2024-01-02", "A", 1.0, 3), ("2024-01-01", "B", 1.0, 2), ("2024-01-02", "C", 1.0, 1),
            ("2024-01-01", "D", 1.0, 0)]
    df = spark.createDataFrame(rows, "Date string, ProductID string, Quantity double, seq int")
    out = {r.ProductID: r.TransactionID for r in normalize_transactions(df, order_cols=["seq"]).collect()}
    assert out == {"D": "20240101_0", "B": "20240101_1", "C": "20240102_0", "A": "20240102_1"}


def test_position_within_matches_window_with_hot_key(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    rows = [("hot" if i % 3 else f"k{i % 7}", i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, o int")
    got = position_within(df, ["g"], ["o"], out="pos", num_partitions=8)
    want = df.withColumn("pos", F.row_number().over(Window.partitionBy("g").orderBy("o")) - 1)
    assert sorted(got.collect()) == sorted(want.select("g", "o", "pos").collect())


def test_csv_scan_and_sink_round_trip(spark, tmp_path):
    src = tmp_path / "sample.csv"
    src.write_text("Date,TransactionID,ProductID,Quantity,Price,ProductCategory\n"
                   "2025-01-15,T1001,P001,2,10.5,Food\n2025-01-15,T1001,P002,1,3.0,Food\n"
                   "2025-01-16,T1002,P001,-1,10.5,Food\n")
    tx = normalize_transactions(read_transactions(spark, str(src)))
    assert tx.count() == 3
    assert dataset_stats(tx).first().n_transactions == 2
    lines = basket_lines(tx)
    out = write_csv(lines, str(tmp_path / "lines_out"))
    back = spark.read.option("header", True).csv(out)
    assert back.count() == 2
    with pytest.raises(ValueError):
        read_transactions(spark, str(tmp_path / "sample.xlsx"))


def test_preview_is_ordered_top_k(spark):
    rows = [Row(TransactionID=f"T{i:02d}", Date=dt.date(2024, 1, 1), ProductID="A", Quantity=1.0) for i in range(20)]
    out = preview(spark.createDataFrame(rows), n=3).collect()
    assert [r.TransactionID for r in out] == ["T00", "T01", "T02"]


def test_text_dates_in_many_formats(spark):
    same = ["2025-01-15", "2025-01-15 10:30:00", "01/15/2025", "1/15/2025 9:05", "Jan 15, 2025", "January 15, 2025", "15 Jan 2025",
            "15-Jan-2025", "2025/1/15", "20250115", "15/01/2025", "15.1.2025", " 2025-01-15 "]
    df = spark.createDataFrame([(f"T{i}", d, "A", 1.0) for i, d in enumerate(same)],
                               "TransactionID string, Date string, ProductID string, Quantity double")
    assert {r.Date for r in normalize_transactions(df).collect()} == {dt.date(2025, 1, 15)}
    blank = spark.createDataFrame([("T", "  ", "A", 1.0), ("U", None, "A", 1.0)],
                                  "TransactionID string, Date string, ProductID string, Quantity double")
    assert normalize_transactions(blank).count() == 0


def test_folders_and_globs(spark, tmp_path):
    for day in (1, 2):
        (tmp_path / f"d{day}").mkdir()
        (tmp_path / f"d{day}" / "part.csv").write_text(f"Date,TransactionID,ProductID,Quantity\n2025-01-0{day},T{day},P,2\n")
    assert read_transactions(spark, str(tmp_path / "*" / "*.csv")).count() == 2
    assert read_transactions(spark, str(tmp_path / "d1"), fmt="csv").count() == 1
    with pytest.raises(ValueError, match="fmt"):
        read_transactions(spark, str(tmp_path / "d1"))


def test_broadcast_is_bounded_by_bytes(spark):
    from basketcast import session
    wide = spark.range(100).selectExpr("id", "repeat('x', 2000000) AS s")
    assert session._measure(wide)[1] > session.DEFAULT_BROADCAST_BYTES
    table, rows, side = session.materialize(wide)
    assert rows == 100 and side is table


def test_one_date_format_per_column(spark):
    from basketcast.operators.clean import column_pattern
    def days(*values):
        df = spark.createDataFrame([(v, "p", 1.0, "t") for v in values], "Date string, ProductID string, Quantity double, TransactionID string")
        return column_pattern(df, "Date"), sorted(str(r.Date) for r in normalize_transactions(df).collect())
    # a value that is no month in first place makes the whole column day-first
    assert days("01/02/2025", "13/02/2025", None, " ")[1] == ["2025-02-01", "2025-02-13"]
    assert days("01/02/2025", "02/13/2025")[1] == ["2025-01-02", "2025-02-13"]
    assert days("2025-01-02", "2025-02-13 10:00:00") == (0, ["2025-01-02", "2025-02-13"])
    pattern, read = days("2025-01-02", "13/02/2025")  # mixed: value by value
    assert pattern is None and read == ["2025-01-02", "2025-02-13"]
    assert days(None, "")[0] is None


def test_texts_of_other_shapes_reach_no_date_parser(spark):
    import re
    from basketcast.operators.clean import DATE_PATTERNS, shape
    fitting = {"01/13/2025": ["M/d/yyyy"], "13/01/2025": ["d/M/yyyy"], "1/2/2025": ["M/d/yyyy", "d/M/yyyy"], "Jan 5, 2025": ["MMM d, yyyy"],
               "may 5, 2025": ["MMM d, yyyy", "MMMM d, yyyy"], "20250105": ["yyyyMMdd"], "2025-01-05": [], "n/a": [],
               "1/2/2025 23:59:01": ["M/d/yyyy H:mm:ss"]}
    for text, patterns in fitting.items():
        assert [p for p in DATE_PATTERNS if re.search(shape(p).replace("(?iu:", "(?i:"), text)] == patterns, text
    odd = [*fitting, "0001/02/2025", "12/31/-2025", "29 FEB 2025", "1-sep-24", "00/10/2025", "5.5.2025", "1/2/25", "9/9/99 ", "Sept 1, 2025"]
    df = spark.createDataFrame([(t,) for t in odd], "t string")
    from pyspark.sql import functions as F
    from basketcast.operators.clean import date_readings
    guarded = date_readings(F.trim("t"))[1:]
    plain = [F.try_to_timestamp(F.trim("t"), F.lit(p)).cast("date") for p in DATE_PATTERNS]
    for row in df.select("t", F.array(*guarded).cast("array<string>").alias("g"), F.array(*plain).cast("array<string>").alias("p")).collect():
        assert row.g == row.p, row.t
