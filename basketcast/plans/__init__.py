"""Compositions of the operators over the test tables: registered queries, fixtures, oracle SQL."""
