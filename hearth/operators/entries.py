"""The canonical list of spending: every euro once. Receipt items, plus bank payments without a receipt."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..schema import SPEND_KINDS, UNCATEGORIZED, Ledger
from .finders import bookings


def category_lookup(L: Ledger, flow: str | None = None) -> DataFrame:
    cats = L.categories if flow is None else L.categories.filter(F.col("flow") == flow)
    return cats.select(
        *[k for k in L.keys if k in cats.columns], F.col("key").alias("_found"), F.col("label").alias("label"),
        F.col("group_name").alias("group"), F.col("fixed").alias("fixed"), F.col("flow").alias("_flow"),
    )


def with_category(df: DataFrame, L: Ledger, column: str = "category", flow: str = "expense") -> DataFrame:
    """Adds key, label, group, fixed. Unknown, deleted or wrong-flow keys become 'uncategorized'."""
    look = category_lookup(L, flow).withColumnRenamed("_found", column).withColumn("_hit", F.lit(True))
    joined = df.join(look, [k for k in L.keys if k in L.categories.columns] + [column], "left")
    return joined.select(
        *[F.col(c) for c in df.columns if c != column],
        F.when(F.col("_hit"), F.col(column)).otherwise(F.lit(UNCATEGORIZED)).alias("key"),
        F.coalesce("label", F.lit("Uncategorized")).alias("label"),
        F.coalesce("group", F.lit("Other")).alias("group"), F.coalesce("fixed", F.lit(False)).alias("fixed"),
    )


def _in_range(column: str, first: dt.date | None, last: dt.date | None) -> Column:
    test = F.lit(True)
    if first is not None:
        test = test & (F.col(column) >= F.lit(first))
    if last is not None:
        test = test & (F.col(column) <= F.lit(last))
    return test


def spend_entries(L: Ledger, first: dt.date | None = None, last: dt.date | None = None) -> DataFrame:
    """(keys, source, amount_c, owner, store, date, key, label, group, fixed) between two days.

    Refunds to an account are not spending; deposit refunds on a receipt are (negative lines).
    """
    rc = L.receipts.filter(_in_range("purchase_date", first, last)).select(
        *L.keys, F.col("id").alias("receipt_id"), "store_name", "owner", "purchase_date"
    )
    # Lines carry the day of their receipt, so the range reaches their files too; a line without a day is left to the join.
    items = L.items.filter(F.col("date_purchased").isNull() | _in_range("date_purchased", first, last)) if first or last else L.items
    items = items.select(*L.keys, "receipt_id", "quantity", "unit_c", "discount_c", "spend_category")
    receipt_part = items.join(rc, L.on("receipt_id")).select(
        *L.keys, F.lit("receipt").alias("source"), E.line_total().alias("amount_c"), "owner",
        F.col("store_name").alias("store"), F.col("purchase_date").alias("date"),
        F.col("spend_category").alias("category"),
    )
    dated = (F.col("purchase_date").isNotNull() & _in_range("purchase_date", first, last)) | (
        F.col("purchase_date").isNull() & _in_range("booking_date", first, last)
    )
    unreceipted = L.bookings.filter(
        F.col("kind").isin(*SPEND_KINDS) & (F.col("amount_c") < 0) & F.col("receipt_id").isNull()
        & F.col("mirror_of").isNull() & dated
    )
    category = F.coalesce(F.nullif(F.col("category"), F.lit("")), E.default_category("kind"))
    bank_part = bookings(L.with_(bookings=unreceipted)).select(
        *L.keys, F.lit("bank").alias("source"), (-F.col("amount_c")).alias("amount_c"), "owner",
        F.col("counterparty").alias("store"), E.effective_date().alias("date"), category.alias("category"),
    )
    return with_category(receipt_part.unionByName(bank_part), L)
