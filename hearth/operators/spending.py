"""One month of spending: by category, group, owner and store, totals, and what does not fit together."""

from __future__ import annotations

import calendar
import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.money import euros, half_up, safe_pct
from ..schema import UNCATEGORIZED, Ledger
from .base import contains_join, month_of, top_k
from .entries import spend_entries
from .finders import bookings

TOP_STORES = 10


def month_bounds(year: int, month: int) -> tuple[dt.date, dt.date]:
    return dt.date(year, month, 1), dt.date(year, month, calendar.monthrange(year, month)[1])


def _two_months(L: Ledger, year: int, month: int) -> DataFrame:
    """This month and the one before in one scan; `now` marks this month."""
    first, last = month_bounds(year, month)
    before = (first - dt.timedelta(days=1)).replace(day=1)
    return spend_entries(L, before, last).withColumn("now", F.col("date") >= F.lit(first))


def _sum_if(test: Column, amount="amount_c") -> Column:
    return F.coalesce(F.sum(F.when(test, F.col(amount))), F.lit(0))


def _share(amount: str, L: Ledger) -> Column:
    return safe_pct(amount, F.sum(amount).over(W.partitionBy(*L.keys)), 1)


def month_categories(L: Ledger, year: int, month: int) -> DataFrame:
    """Per category: receipts, bank, total, share and the month before."""
    now = F.col("now")
    rows = (
        _two_months(L, year, month).groupBy(*L.keys, "key", "label", "group", "fixed")
        .agg(
            F.count_if(now).alias("n"), _sum_if(now).alias("amount_c"),
            _sum_if(now & (F.col("source") == "receipt")).alias("receipt_c"),
            _sum_if(now & (F.col("source") == "bank")).alias("bank_c"), _sum_if(~now).alias("previous_c"),
        )
        .filter(F.col("n") > 0)
    )
    return rows.select(
        *L.keys, "key", "label", "group", "fixed", euros("amount_c").alias("amount"),
        euros("receipt_c").alias("receipt_amount"), euros("bank_c").alias("bank_amount"),
        _share("amount_c", L).alias("share_pct"), euros("previous_c").alias("previous_amount"),
    )


def month_groups(L: Ledger, year: int, month: int) -> DataFrame:
    rows = spend_entries(L, *month_bounds(year, month)).groupBy(*L.keys, "group").agg(F.sum("amount_c").alias("amount_c"))
    return rows.select(*L.keys, "group", euros("amount_c").alias("amount"), _share("amount_c", L).alias("share_pct"))


def _named(column: str) -> Column:
    return F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit("Unknown"))


def month_owners(L: Ledger, year: int, month: int) -> DataFrame:
    rows = spend_entries(L, *month_bounds(year, month))
    return rows.groupBy(*L.keys, _named("owner").alias("owner")).agg(euros(F.sum("amount_c")).alias("amount"))


def month_stores(L: Ledger, year: int, month: int, top: int = TOP_STORES) -> DataFrame:
    rows = spend_entries(L, *month_bounds(year, month))
    totals = rows.groupBy(*L.keys, _named("store").alias("store")).agg(F.sum("amount_c").alias("amount_c"))
    best = top_k(totals, list(L.keys), [F.col("amount_c").desc(), F.col("store")], top)
    return best.select(*L.keys, "store", euros("amount_c").alias("amount"))


def month_totals(L: Ledger, year: int, month: int) -> DataFrame:
    """One row per household: totals, receipt facts and what has no category."""
    now, loose = F.col("now"), F.col("now") & (F.col("key") == UNCATEGORIZED)
    spent = _two_months(L, year, month).groupBy(*L.keys).agg(
        _sum_if(now).alias("total_c"), _sum_if(now & (F.col("source") == "receipt")).alias("receipt_c"),
        _sum_if(now & (F.col("source") == "bank")).alias("bank_c"), _sum_if(~now).alias("previous_c"),
        F.count_if(loose).alias("loose_n"), _sum_if(loose).alias("loose_c"),
    )
    first, last = month_bounds(year, month)
    rc = (
        L.receipts.filter(F.col("purchase_date").between(F.lit(first), F.lit(last))).groupBy(*L.keys)
        .agg(F.count("*").alias("n"), F.sum("total_c").alias("basket_c"),
             F.sum(F.coalesce("discount_c", F.lit(0))).alias("saved_c"))
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return spent.join(rc, list(L.keys), "full").select(
        *L.keys, euros(zero("total_c")).alias("total"), euros(zero("receipt_c")).alias("receipt_total"),
        euros(zero("bank_c")).alias("bank_only_total"), euros(zero("previous_c")).alias("previous_total"),
        zero("n").alias("receipts"),
        F.coalesce(euros(half_up("basket_c", F.col("n"))), F.lit(0.0)).alias("average_basket"),
        euros(zero("saved_c")).alias("discounts_saved"), zero("loose_n").alias("uncategorized_entries"),
        euros(zero("loose_c")).alias("uncategorized_amount"),
    )


def _months_with_statement(L: Ledger, at: int) -> DataFrame:
    st = L.statements.filter(F.col("month_index") == at).select(*L.keys, F.col("id").alias("statement_id"))
    filled = L.bookings.select(*L.keys, "statement_id")
    return st.join(filled, L.on("statement_id"), "left_semi").select(*L.keys).distinct()


def statement_presence(L: Ledger, year: int, month: int) -> DataFrame:
    """Whether the month has a statement, or receipts are still waiting for one."""
    first, last = month_bounds(year, month)
    with_st = _months_with_statement(L, month_of(year, month)).withColumn("s", F.lit(1))
    with_rc = L.receipts.filter(F.col("purchase_date").between(F.lit(first), F.lit(last))).select(*L.keys).distinct()
    both = with_st.join(with_rc.withColumn("r", F.lit(1)), list(L.keys), "full")
    return both.select(
        *L.keys, F.col("s").isNotNull().alias("has_statement"),
        (F.col("s").isNull() & F.col("r").isNotNull()).alias("awaiting_statement"),
    )


def unmatched_receipts(L: Ledger, year: int, month: int) -> DataFrame:
    """Receipts that no bank booking was matched to, once the month's statement exists."""
    first, last = month_bounds(year, month)
    rc = L.receipts.filter(F.col("purchase_date").between(F.lit(first), F.lit(last)) & ~F.col("linked"))
    rc = rc.join(_months_with_statement(L, month_of(year, month)), list(L.keys), "left_semi")
    return rc.select(
        *L.keys, F.col("id").alias("receipt_id"), F.col("store_name").alias("store"), F.col("purchase_date").alias("date"),
        euros("total_c").alias("total"), "owner",
    )


def missing_receipts(L: Ledger, year: int, month: int, exclude_mirrors: bool = False) -> DataFrame:
    """Bank payments at stores that ever gave a receipt, without one."""
    loose = L.bookings.filter((F.col("kind") == "spend") & (F.col("amount_c") < 0) & F.col("receipt_id").isNull())
    if exclude_mirrors:
        loose = loose.filter(F.col("mirror_of").isNull())
    rows = bookings(L.with_(bookings=loose)).filter(F.col("statement_month") == month_of(year, month))
    rows = rows.withColumn("_name", F.lower("counterparty"))
    names = rows.select(*L.keys, "_name").distinct()
    stores = L.receipts.select(*L.keys, F.lower("store_name").alias("_store")).distinct()
    keys = list(L.keys)
    known = (
        contains_join(names, stores, keys, "_name", "_store").select(*keys, "_name")
        .unionByName(contains_join(stores, names, keys, "_store", "_name").select(*keys, "_name")).distinct()
    )
    return rows.join(known, L.on("_name"), "left_semi").select(
        *L.keys, F.col("id").alias("transaction_id"), F.col("booking_date").alias("date"),
        euros(-F.col("amount_c")).alias("amount"), "counterparty",
    )
