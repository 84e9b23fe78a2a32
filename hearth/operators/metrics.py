"""Dashboard numbers: income and investments by statement month, spending by purchase month."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import exprs as E
from ..functions.money import euros, half_even, safe_pct
from ..schema import INVESTMENTS_KEY, UNCATEGORIZED_INCOME, Ledger
from .base import month_of, month_spine
from .entries import category_lookup, spend_entries
from .finders import bookings

SUMS = ("income_c", "invested_c", "spent_c", "fixed_c", "receipt_c", "bank_c", "receipts", "seen")


def _within(L: Ledger, start: int | None, end: int | None) -> tuple[Ledger, dt.date | None, dt.date | None]:
    """The ledger with statements and receipts of the months only, and the first and last day; filters that reach the files."""
    if start is None or end is None:
        return L, None, None
    first, last = dt.date(start // 12, start % 12 + 1, 1), dt.date((end + 1) // 12, (end + 1) % 12 + 1, 1) - dt.timedelta(days=1)
    return L.with_(
        statements=L.statements.filter(F.col("month_index").between(start, end)),
        receipts=L.receipts.filter(F.col("purchase_date").between(F.lit(first), F.lit(last))),
    ), first, last


def _facts(L: Ledger, start: int | None = None, end: int | None = None) -> DataFrame:
    """All sources of a month stacked as sums, so one shuffle brings them together; of the months start to end, if given.

    `seen` counts what makes a month exist: a statement labelled with it or a receipt dated in it.
    """
    every = L
    L, first, last = _within(L, start, end)
    moved = bookings(L).filter(F.col("mirror_of").isNull())
    money_in = (F.col("amount_c") > 0) & ~F.col("kind").isin("internal_transfer", "investment")
    invested = (F.col("kind") == "investment") & (F.col("amount_c") < 0)
    zero = F.lit(0).cast("bigint")

    def shape(df: DataFrame, month, **sums) -> DataFrame:
        return df.select(*L.keys, month.alias("month_index"), *[sums.get(s, zero).cast("bigint").alias(s) for s in SUMS])

    spent, receipt = F.col("amount_c"), F.col("source") == "receipt"
    return (
        shape(moved.filter(money_in | invested), F.col("statement_month"),
              income_c=F.when(money_in, F.col("amount_c")).otherwise(0),
              invested_c=F.when(invested, -F.col("amount_c")).otherwise(0))
        .unionByName(shape(spend_entries(every, first, last), E.month_index("date"), spent_c=spent,
                           fixed_c=F.when(F.col("fixed"), spent).otherwise(0),
                           receipt_c=F.when(receipt, spent).otherwise(0), bank_c=F.when(~receipt, spent).otherwise(0)))
        .unionByName(shape(L.statements, F.col("month_index"), seen=F.lit(1)))
        .unionByName(shape(L.receipts, E.month_index("purchase_date"), receipts=F.lit(1), seen=F.lit(1)))
    )


def _month_sums(L: Ledger, start: int | None = None, end: int | None = None) -> DataFrame:
    sums = _facts(L, start, end).groupBy(*L.keys, "month_index").agg(*[F.sum(s).alias(s) for s in SUMS])
    return sums.filter(F.col("seen") > 0)


def _rates(df: DataFrame, L: Ledger, *lead) -> DataFrame:
    spends = F.col("spent_c") > 0
    net = F.col("income_c") - F.col("spent_c")
    fixed_pct = F.when(spends, half_even(F.col("fixed_c") * 100, F.col("spent_c")))
    return df.select(
        *L.keys, *lead, euros("income_c").alias("gross_income"), euros("spent_c").alias("lifestyle_expenses"),
        euros(net).alias("net_savings"), safe_pct(net, "income_c", 2).alias("savings_rate_pct"),
        euros("invested_c").alias("total_invested"), E.split_line(fixed_pct, spends).alias("fixed_vs_variable_ratio"),
    )


def month_metrics(L: Ledger) -> DataFrame:
    """Every month that has a statement or a receipt."""
    return _rates(_month_sums(L), L, "month_index", E.month_label("month_index").alias("label"))


def _month_keys(L: Ledger, start: int | None = None, end: int | None = None) -> DataFrame:
    """Months with their category sums (income, spending, investments); of the months start to end, if given."""
    whole = L
    L, first, last = _within(L, start, end)
    has = [k for k in L.keys if k in L.categories.columns]
    income = category_lookup(L, "income").select(*has, F.col("_found").alias("_key"))
    every = category_lookup(L).select(*has, F.col("_found").alias("_key"))

    def found(df: DataFrame, dim: DataFrame, key, name: str) -> DataFrame:
        hit = dim.withColumn("_hit", F.col("_key"))
        return df.withColumn("_key", key).join(hit, [*has, "_key"], "left").withColumn(name, F.col("_hit")).drop("_key", "_hit")

    rows = bookings(L).filter(F.col("mirror_of").isNull())
    incoming = rows.filter((F.col("amount_c") > 0) & ~F.col("kind").isin("internal_transfer", "investment"))
    sums = incoming.groupBy(*L.keys, F.col("statement_month").alias("month_index"), "category", "kind").agg(
        F.sum("amount_c").alias("amount_c")
    )
    sums = found(sums, income, F.col("category"), "_own")
    sums = found(sums, income, F.when(F.col("kind") == "refund", F.lit("refunds_returns")), "_by_kind")
    # Not a bare literal: a join on a constant would be planned as a nested loop.
    sums = found(sums, every, F.when(F.col("amount_c").isNotNull(), F.lit("other_income")), "_other")
    key = F.coalesce("_own", "_by_kind", "_other", F.lit(UNCATEGORIZED_INCOME))
    part_in = sums.select(*L.keys, "month_index", key.alias("key"), F.lit("income").alias("flow"), "amount_c")
    part_inv = rows.filter((F.col("kind") == "investment") & (F.col("amount_c") < 0)).select(
        *L.keys, F.col("statement_month").alias("month_index"), F.lit(INVESTMENTS_KEY).alias("key"),
        F.lit("investment").alias("flow"), (-F.col("amount_c")).alias("amount_c"),
    )
    part_out = spend_entries(whole, first, last).select(
        *L.keys, E.month_index("date").alias("month_index"), "key", F.lit("expense").alias("flow"), "amount_c"
    )
    cells = part_in.unionByName(part_inv).unionByName(part_out)
    cells = cells.groupBy(*L.keys, "month_index", "key", "flow").agg(F.sum("amount_c").alias("amount_c"))
    present = L.statements.select(*L.keys, "month_index").unionByName(
        L.receipts.select(*L.keys, E.month_index("purchase_date").alias("month_index"))
    ).distinct()
    return cells.join(present, L.on("month_index"), "left_semi")


def _shares(cells: DataFrame, L: Ledger, *lead: str) -> DataFrame:
    whole = F.sum("amount_c").over(W.partitionBy(*L.keys, *lead, "flow"))
    return cells.select(
        *L.keys, *lead, "key", "flow", euros("amount_c").alias("total"),
        safe_pct("amount_c", whole, 2).alias("percentage_of_total"),
    )


def month_category_metrics(L: Ledger) -> DataFrame:
    """Share of every category in its own flow (income, spending, investments)."""
    return _shares(_month_keys(L), L, "month_index")


def month_sources(L: Ledger) -> DataFrame:
    """What a month is made of; `empty_statement` marks a statement without a single booking row."""
    filled = L.bookings.select(*L.keys, F.col("statement_id").alias("id")).distinct().withColumn("_f", F.lit(True))
    banks = (
        L.statements.join(filled, L.on("id"), "left").groupBy(*L.keys, "month_index")
        .agg(F.sort_array(F.collect_set("bank")).alias("statements"), F.max(F.col("_f").isNull()).alias("empty_statement"))
    )
    sums = _month_sums(L).join(banks, L.on("month_index"), "left")
    return sums.select(
        *L.keys, "month_index", F.coalesce(F.array_join("statements", ","), F.lit("")).alias("statements"), "receipts",
        euros("receipt_c").alias("receipt_total"), euros("bank_c").alias("bank_only_total"),
        F.coalesce("empty_statement", F.lit(False)).alias("empty_statement"),
    )


def _period(sums: DataFrame, L: Ledger) -> DataFrame:
    whole = sums.groupBy(*L.keys).agg(F.count("*").alias("period_months_count"), *[F.sum(s).alias(s) for s in SUMS])
    return _rates(whole, L, "period_months_count")


def period_stats(L: Ledger, start: tuple[int, int], end: tuple[int, int]) -> DataFrame:
    """A range of months as one: sums added up, ratios recomputed from the sums."""
    if month_of(*start) > month_of(*end):
        raise ValueError("the range of months ends before it starts")
    return _period(_month_sums(L, month_of(*start), month_of(*end)), L)


def period_categories(L: Ledger, start: tuple[int, int], end: tuple[int, int]) -> DataFrame:
    cells = _month_keys(L, month_of(*start), month_of(*end))
    return _shares(cells.groupBy(*L.keys, "key", "flow").agg(F.sum("amount_c").alias("amount_c")), L)


def missing_months(L: Ledger, start: tuple[int, int], end: tuple[int, int]) -> DataFrame:
    """Months of the range with nothing recorded, per household."""
    present = L.statements.select(*L.keys, "month_index").unionByName(
        L.receipts.select(*L.keys, E.month_index("purchase_date").alias("month_index"))
    ).distinct()
    spine = month_spine(present.select(*L.keys).distinct(), month_of(*start), month_of(*end))
    gaps = spine.join(present, L.on("month_index"), "left_anti")
    return gaps.select(*L.keys, "month_index", E.month_label("month_index").alias("label"))


def recent_stats(L: Ledger, today: dt.date, months: int = 3) -> DataFrame:
    """The last months, this one included; months without data are left out."""
    last = month_of(today.year, today.month)
    return _period(_month_sums(L, last - months + 1, last), L)
