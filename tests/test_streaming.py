import pytest

from basketcast.streaming import daily_sales_stream, transaction_stream

SCHEMA = "TransactionID string, Date string, ProductID string, Quantity string"


def test_daily_sales_over_arriving_files(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.csv").write_text("TransactionID,Date,ProductID,Quantity\nT1,2024-01-01,A,2\nT2,2024-01-01,A,3\n")
    stream = daily_sales_stream(transaction_stream(spark, str(src), SCHEMA))
    q = (stream.writeStream.outputMode("complete").format("memory").queryName("daily_uploads")
         .option("checkpointLocation", str(tmp_path / "ckpt")).start())
    try:
        q.processAllAvailable()
        (src / "b.csv").write_text("TransactionID,Date,ProductID,Quantity\nT3,2024-01-01,A,5\nT4,2024-01-02,B,x\n")
        q.processAllAvailable()
        rows = {(str(r.Date), r.ProductID): r.Quantity for r in spark.sql("SELECT * FROM daily_uploads").collect()}
    finally:
        q.stop()
    assert rows == {("2024-01-01", "A"): 10.0}


def test_stream_without_transaction_id_is_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="transaction id"):
        transaction_stream(spark, str(tmp_path), "Date string, ProductID string, Quantity string")
