"""Savings plans: when they execute, what they cost, and their status."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..functions.money import euros, half_up
from ..schema import Ledger

FREQUENCY_LABEL = {"weekly": "every week", "biweekly": "every two weeks", "monthly": "every month"}
STEP_DAYS = {"weekly": 7, "biweekly": 14}
LOOKAHEAD_DAYS = 400


def execution_array(first: Column, last: Column) -> Column:
    """Array of the days a plan executes between two days; empty without an anchor day.

    Weekly rhythms repeat from the anchor in both directions; monthly plans keep the anchor's day of the month,
    or take the last day of a shorter month.
    """
    anchor = F.col("anchor_date")
    lo = F.greatest(first, F.col("start_date"))
    hi = F.least(last, F.col("end_date"))
    step = E.literal_map("frequency", STEP_DAYS, 7)
    k_lo = F.ceil(F.datediff(lo, anchor) / step).cast("int")
    k_hi = F.floor(F.datediff(hi, anchor) / step).cast("int")
    none = F.array().cast("array<date>")
    weekly = F.when(k_lo <= k_hi, F.transform(F.sequence(k_lo, k_hi), lambda k: F.date_add(anchor, (k * step).cast("int"))))
    m_lo, m_hi = E.month_index(lo), E.month_index(hi)

    def in_month(m: Column) -> Column:
        start = E.month_start(m)
        return F.date_add(start, F.least(F.dayofmonth(anchor), F.dayofmonth(F.last_day(start))) - 1)

    monthly = F.when(
        m_lo <= m_hi,
        F.filter(F.transform(F.sequence(m_lo, m_hi), in_month), lambda d: d.between(lo, hi)),
    )
    days = F.when(F.col("frequency").isin(*STEP_DAYS), weekly).otherwise(monthly)
    return F.when(anchor.isNull() | (last < first), none).otherwise(F.coalesce(days, none))


def execution_dates(plans: DataFrame, first, last) -> DataFrame:
    """One row per plan and execution day. `first` and `last` are days or columns."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return plans.withColumn("day", F.explode(execution_array(lit(first), lit(last))))


def plan_view(L: Ledger, today: dt.date) -> DataFrame:
    """Every plan with status, monthly cost and its next three executions; active first."""
    status = E.plan_status(today)
    upcoming = execution_array(F.lit(today), F.lit(today + dt.timedelta(days=LOOKAHEAD_DAYS)))
    rows = L.plans.select(
        *L.keys, "id", "broker", "instrument", euros("amount_c").alias("amount"), "frequency",
        E.literal_map("frequency", FREQUENCY_LABEL).alias("frequency_label"), "anchor_date", "start_date", "end_date",
        "note", status.alias("status"), euros(E.per_month_c("amount_c", "frequency")).alias("per_month"),
        F.when(status == "ended", F.array().cast("array<date>")).otherwise(F.slice(upcoming, 1, 3)).alias("next_dates"),
    )
    rank = E.literal_map("status", {"active": 0, "scheduled": 1, "ended": 2})
    return rows.orderBy(*L.keys, rank, F.col("per_month").desc(), F.lower("instrument"), "id")


def plan_summary(L: Ledger, today: dt.date) -> DataFrame:
    """Active and ended plans; exact monthly sums rounded once."""
    rows = L.plans.withColumn("status", E.plan_status(today))
    active = F.col("status") == "active"
    return rows.groupBy(*L.keys).agg(
        F.count_if(active).alias("active"), F.count_if(F.col("status") == "ended").alias("ended"),
        F.coalesce(F.sum(F.when(active, E.twelfths_c("amount_c", "frequency"))), F.lit(0)).alias("t"),
    ).select(*L.keys, "active", "ended", _monthly("t").alias("per_month"))


def _monthly(column: str) -> Column:
    return euros(half_up(column, F.lit(12).cast("bigint")))


def plan_summary_by_broker(L: Ledger, today: dt.date) -> DataFrame:
    rows = L.plans.filter(E.plan_status(today) == "active").groupBy(*L.keys, "broker").agg(
        F.sum(E.twelfths_c("amount_c", "frequency")).alias("t")
    )
    return rows.select(*L.keys, "broker", _monthly("t").alias("per_month"))
