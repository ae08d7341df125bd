"""Column expressions and driver-side scalar lookups."""

from basketcast.functions.columns import standardize_column_names
from basketcast.functions.inventory import service_factor
from basketcast.functions.metrics import rule_order, with_rule_metrics

__all__ = ["standardize_column_names", "service_factor", "rule_order", "with_rule_metrics"]
