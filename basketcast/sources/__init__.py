"""Sources (file scans, test-table view) and CSV sinks."""

from basketcast.sources.sinks import flatten_arrays, write_csv
from basketcast.sources.transactions import (file_format, read_transactions, table, tpch_lines,
                                             tpch_transactions)

__all__ = ["file_format", "read_transactions", "table", "tpch_lines", "tpch_transactions",
           "flatten_arrays", "write_csv"]
