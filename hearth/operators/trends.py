"""Months side by side, what moved, and how a month is going day by day."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import exprs as E
from ..functions.money import euros, half_even, half_up
from ..schema import Ledger
from .base import month_of, month_spine, top_k
from .entries import spend_entries
from .spending import _sum_if, month_bounds

MIN_MOVE_C = 1000
TOP_MOVERS = 5


def _cells(L: Ledger, months: int, end: tuple[int, int]) -> tuple[DataFrame, int, int]:
    """Spending per household, month and category: the one aggregate every trend is made of."""
    last = month_of(*end)
    first = last - months + 1
    days = month_bounds(first // 12, first % 12 + 1)[0], month_bounds(*end)[1]
    cells = (
        spend_entries(L, *days).withColumn("month_index", E.month_index("date"))
        .groupBy(*L.keys, "month_index", "key", "label", "group", "fixed").agg(F.sum("amount_c").alias("amount_c"))
    )
    return cells, first, last


def _month_sums(cells: DataFrame, L: Ledger) -> DataFrame:
    return cells.groupBy(*L.keys, "month_index").agg(
        F.sum("amount_c").alias("total_c"), _sum_if(F.col("fixed")).alias("fixed_c")
    )


def _finished(cells: DataFrame, L: Ledger, today: dt.date) -> DataFrame:
    """Finished months with any spending, newest first (rank), and how many there are."""
    w = W.partitionBy(*L.keys)
    done = _month_sums(cells, L).filter(
        (F.col("month_index") < month_of(today.year, today.month)) & (F.col("total_c") > 0)
    )
    return done.withColumn("rank", F.row_number().over(w.orderBy(F.col("month_index").desc()))).withColumn(
        "n", F.count("*").over(w)
    )


def trend_months(L: Ledger, months: int, end: tuple[int, int], today: dt.date) -> DataFrame:
    """One row per month, months without data kept."""
    cells, first, last = _cells(L, months, end)
    sums = _month_sums(cells, L)
    spine = month_spine(cells.select(*L.keys).distinct(), first, last)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return spine.join(sums, L.on("month_index"), "left").select(
        *L.keys, "month_index", E.month_label("month_index").alias("label"),
        (F.col("month_index") >= month_of(today.year, today.month)).alias("partial"),
        euros(zero("total_c")).alias("total"), euros(zero("fixed_c")).alias("fixed"),
        euros(zero("total_c") - zero("fixed_c")).alias("flexible"),
    )


def trend_by_category(L: Ledger, months: int, end: tuple[int, int]) -> DataFrame:
    cells, _, _ = _cells(L, months, end)
    return cells.select(*L.keys, "month_index", "key", euros("amount_c").alias("amount"))


def trend_by_group(L: Ledger, months: int, end: tuple[int, int]) -> DataFrame:
    cells, _, _ = _cells(L, months, end)
    return cells.groupBy(*L.keys, "month_index", "group").agg(euros(F.sum("amount_c")).alias("amount"))


def trend_matrix(L: Ledger, months: int, end: tuple[int, int]) -> DataFrame:
    """Categories down, months across (m0 = oldest): one shuffle, zero where nothing was spent."""
    cells, first, _ = _cells(L, months, end)
    return cells.groupBy(*L.keys, "key").agg(
        *[euros(_sum_if(F.col("month_index") == first + i)).alias(f"m{i}") for i in range(months)]
    )


def category_averages(L: Ledger, months: int, end: tuple[int, int], today: dt.date) -> DataFrame:
    """Total of the range and mean over the finished months (a month without data is not a zero)."""
    cells, _, _ = _cells(L, months, end)
    done = _finished(cells, L, today)
    count = done.groupBy(*L.keys).agg(F.max("n").alias("n"))
    base = cells.join(done.select(*L.on("month_index"), F.lit(True).alias("done")), L.on("month_index"), "left")
    rows = base.groupBy(*L.keys, "key", "label", "group", "fixed").agg(
        F.sum("amount_c").alias("total_c"), _sum_if(F.coalesce("done", F.lit(False))).alias("base_c")
    )
    return rows.join(count, list(L.keys), "left").select(
        *L.keys, "key", "label", "group", "fixed", euros("total_c").alias("total"),
        F.coalesce(euros(half_up("base_c", F.col("n"))), F.lit(0.0)).alias("average"),
    )


def trend_averages(L: Ledger, months: int, end: tuple[int, int], today: dt.date) -> DataFrame:
    cells, _, _ = _cells(L, months, end)
    rows = _finished(cells, L, today).groupBy(*L.keys).agg(
        F.sum("total_c").alias("t"), F.sum("fixed_c").alias("f"), F.count("*").alias("finished_months")
    )
    return rows.select(
        *L.keys, "finished_months", euros(half_up("t", F.col("finished_months"))).alias("average_total"),
        euros(half_up("f", F.col("finished_months"))).alias("average_fixed"),
    )


def spend_movers(
    L: Ledger, months: int, end: tuple[int, int], today: dt.date, min_move_c: int = MIN_MOVE_C, top: int = TOP_MOVERS
) -> DataFrame:
    """Latest finished month against the mean of the finished months before it."""
    cells, _, _ = _cells(L, months, end)
    done = _finished(cells, L, today).filter(F.col("n") >= 2)
    heads = done.filter(F.col("rank") == 1).select(
        *L.keys, E.month_label("month_index").alias("month"), (F.col("n") - 1).alias("baseline_months")
    )
    rows = cells.join(done.select(*L.on("month_index"), "rank"), L.on("month_index")).groupBy(*L.keys, "key", "label")
    rows = rows.agg(
        _sum_if(F.col("rank") == 1).alias("now_c"), _sum_if(F.col("rank") > 1).alias("base_c")
    ).join(heads, list(L.keys))
    diff = F.col("now_c") * F.col("baseline_months") - F.col("base_c")  # times the number of baseline months
    rows = rows.withColumn("diff", diff).filter(F.abs("diff") >= min_move_c * F.col("baseline_months"))
    pct = F.when(
        F.col("base_c") > 0,
        half_even(F.col("diff") * 100, F.col("base_c")),
    )
    rows = rows.select(
        *L.keys, "month", "baseline_months", "key", "label",
        F.when(F.col("diff") > 0, "up").otherwise("down").alias("direction"), euros("now_c").alias("now"),
        euros(half_up("base_c", F.col("baseline_months"))).alias("average"),
        half_up("diff", F.col("baseline_months")).alias("change_c"), pct.alias("change_pct"),
    )
    best = top_k(rows, L.on("direction"), [F.abs("change_c").desc(), F.col("key")], top)
    return best.withColumn("change", euros("change_c")).drop("change_c")


def _pace_days(L: Ledger, year: int, month: int) -> tuple[DataFrame, int, int]:
    first, last = month_bounds(year, month)
    before = (first - dt.timedelta(days=1)).replace(day=1)
    rows = spend_entries(L, before, last).withColumn(
        "which", F.when(F.col("date") >= F.lit(first), "current").otherwise("previous")
    )
    return rows, last.day, (first - dt.timedelta(days=1)).day


def _cutoff(year: int, month: int, days: int, today: dt.date) -> int:
    return min(days, today.day) if (year, month) == (today.year, today.month) else days


def spend_pace(L: Ledger, year: int, month: int, today: dt.date) -> DataFrame:
    """Running total per day, this month (up to today) and the whole month before."""
    rows, days, prev_days = _pace_days(L, year, month)
    cut = _cutoff(year, month, days, today)
    daily = rows.groupBy(*L.keys, "which", F.dayofmonth("date").alias("day")).agg(F.sum("amount_c").alias("amount_c"))
    spine = (
        daily.select(*L.keys).distinct()
        .withColumn("which", F.explode(F.array(F.lit("current"), F.lit("previous"))))
        .withColumn("day", F.explode(F.sequence(F.lit(1), F.when(F.col("which") == "current", cut).otherwise(prev_days))))
    )
    run = W.partitionBy(*L.keys, "which").orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    full = spine.join(daily, L.on("which", "day"), "left")
    return full.select(
        *L.keys, "which", "day", euros(F.sum(F.coalesce("amount_c", F.lit(0))).over(run)).alias("running_total")
    )


def pace_summary(L: Ledger, year: int, month: int, today: dt.date) -> DataFrame:
    rows, days, prev_days = _pace_days(L, year, month)
    cut = _cutoff(year, month, days, today)
    now, day, bank = F.col("which") == "current", F.dayofmonth("date"), F.col("source") == "bank"
    return rows.groupBy(*L.keys).agg(
        euros(_sum_if(now & (day <= cut))).alias("current_total"),
        euros(_sum_if(~now & (day <= min(cut, prev_days)))).alias("previous_same_day"),
        euros(_sum_if(~now)).alias("previous_total"),
        (F.max(~now & bank) & ~F.max(now & bank)).alias("unfair_comparison"),
    ).withColumn("in_progress", F.lit(cut < days or (year, month) == (today.year, today.month)))
