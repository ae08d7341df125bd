"""Operators for large text corpora, built on DataFrames.

Nothing else in the library imports this subpackage.  Every operator takes a frame
with an integer id column and a text column (other columns are never looked at, so
clashing names cannot interfere), treats a null text as empty and an empty frame as
an empty result; each module states what it returns for ties and repeated rows.
"""
