"""File-stream form of the upload step (the reference itself has no streaming)."""

from basketcast.streaming.uploads import daily_sales_stream, transaction_stream

__all__ = ["transaction_stream", "daily_sales_stream"]
