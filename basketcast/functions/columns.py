"""Column-name standardisation (schema level, evaluated on the driver from ``df.columns``)."""

from __future__ import annotations

CANONICAL = ("Date", "ProductID", "Quantity", "TransactionID")

# The name patterns that must match the reference's behaviour, in its order.
DATE_PATTERNS = ["date", "order_date", "transaction_date", "invoice_date"]
PRODUCT_PATTERNS = ["product", "product_id", "productid", "item", "item_id", "itemid", "sku"]
QUANTITY_PATTERNS = ["quantity", "qty", "amount", "units"]
TRANSACTION_PATTERNS = ["transaction", "transaction_id", "transactionid", "order", "order_id",
                        "orderid", "invoice", "invoice_no", "invoiceno"]

_GROUPS = (
    ("Date", DATE_PATTERNS),
    ("ProductID", PRODUCT_PATTERNS),
    ("Quantity", QUANTITY_PATTERNS),
    ("TransactionID", TRANSACTION_PATTERNS),
)


def _normal(name: str) -> str:
    return name.lower().replace(" ", "_").replace("-", "_")


def substring_target(name: str) -> str | None:
    """Canonical name whose pattern group first contains a substring of ``name``."""
    low = _normal(name)
    for canonical, patterns in _GROUPS:
        if any(p in low for p in patterns):
            return canonical
    return None


def standardize_column_names(columns: list[str]) -> dict[str, str]:
    """Map source columns to canonical names, at most one source per canonical name.

    An exact match (canonical name or one of its patterns) wins over a substring
    match, so ``ProductID`` beats ``ProductName`` and ``ProductCategory``; among
    substring matches the first column wins. Columns that lose pass through.
    """
    mapping: dict[str, str] = {}
    taken: set[str] = set()
    for canonical, patterns in _GROUPS:
        for col in columns:
            low = _normal(col)
            if col not in mapping and (low == canonical.lower() or low in patterns):
                mapping[col] = canonical
                taken.add(canonical)
                break
    for col in columns:
        if col in mapping:
            continue
        target = substring_target(col)
        if target is not None and target not in taken:
            mapping[col] = target
            taken.add(target)
    return {src: dst for src, dst in mapping.items() if src != dst}
