"""Buying patterns: staples, what runs out, lost cash, price rises, regular essentials.

Days are collected as a set per product: at most one value per calendar day, whatever the number of rows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..functions.money import euros, half_up, safe_pct
from ..schema import Ledger
from .spending import _sum_if


def _cutoff(today: dt.date, days: int) -> Column:
    return F.lit(today - dt.timedelta(days=days))


def _staple_sums(recent: Column) -> list[Column]:
    day = F.when(recent, F.col("date_purchased"))
    return [
        F.collect_set(day).alias("days"), _sum_if(recent, "quantity").alias("units"),
        F.coalesce(F.sum(F.when(recent, F.col("unit_c") * F.col("quantity"))), F.lit(0)).alias("spend_c"),
        F.max(F.when(recent, E.product_title("name"))).alias("name"),
    ]


def _weeks(days: str) -> Column:
    return F.size(F.array_distinct(F.transform(F.col(days), lambda d: F.date_trunc("week", d))))


def _is_staple(min_days: int, min_weeks: int) -> Column:
    return (F.size("days") >= min_days) & (_weeks("days") >= min_weeks)


def rolling_staples(L: Ledger, today: dt.date, days: int = 90, min_days: int = 3, min_weeks: int = 2) -> DataFrame:
    recent = F.col("date_purchased") >= _cutoff(today, days)
    rows = L.items.filter(recent).groupBy(*L.keys, E.trimmed_lower("name").alias("product")).agg(
        *_staple_sums(F.lit(True))
    )
    return rows.filter(_is_staple(min_days, min_weeks)).select(
        *L.keys, "name", F.size("days").alias("purchase_frequency_days"), _weeks("days").alias("distribution_weeks"),
        F.col("units").alias("total_units_purchased"),
        euros(half_up("spend_c", F.col("units"))).alias("average_unit_cost_basis"),
    )


def pantry_deficits(
    L: Ledger, today: dt.date, days: int = 90, min_days: int = 3, min_weeks: int = 2
) -> DataFrame:
    """Staples whose latest purchase is used up or past its date: one scan, one shuffle."""
    recent = F.col("date_purchased") >= _cutoff(today, days)
    rows = L.items.groupBy(*L.keys, E.trimmed_lower("name").alias("product")).agg(
        *_staple_sums(recent),
        F.max(F.struct("date_purchased", "id", "status", "date_expiry")).alias("last"),
    ).filter(_is_staple(min_days, min_weeks))
    gone = F.col("last.status").isin("Consumed", "Spoiled", "Discarded")
    old = F.coalesce(F.col("last.date_expiry") < F.lit(today), F.lit(False))
    return rows.filter(gone | old).select(
        *L.keys, "name",
        F.when(gone, "MANUAL_STATUS_EXHAUSTION").otherwise("TEMPORAL_SHELF_LIFE_EXPIRED").alias("deficit_trigger"),
        F.col("last.status").alias("last_action_state"), F.col("last.date_purchased").alias("last_purchased_date"),
        F.when(~gone, F.col("last.date_expiry")).alias("expiry_date_passed"),
        F.when(gone, "CRITICAL").otherwise("MEDIUM").alias("urgency"),
    )


def waste_leakage(L: Ledger, today: dt.date, days: int = 30) -> DataFrame:
    """Lost cash of things bought in the window: per category, and '(all)' from the same pass."""
    lost = F.col("status").isin("Spoiled", "Discarded") | (F.col("wasted_quantity") > 0)
    rows = L.items.filter((F.col("date_purchased") >= _cutoff(today, days)) & lost)
    pieces = F.coalesce(F.nullif(F.col("wasted_quantity"), F.lit(0.0)), F.col("quantity").cast("double"))
    rows = rows.withColumn("fine", F.round(F.col("unit_c") * pieces * 100).cast("bigint"))
    keys = list(L.keys)
    sets = rows.groupingSets([[F.col(k) for k in keys], [F.col(k) for k in [*keys, "category"]]], *keys, "category")
    return sets.agg(F.grouping("category").alias("g"), F.sum("fine").alias("fine")).select(
        *keys, F.when(F.col("g") == 1, "(all)").otherwise(F.coalesce("category", F.lit("Other"))).alias("category"),
        euros(half_up("fine", F.lit(100).cast("bigint"))).alias("loss"),
    )


def price_inflation(L: Ledger, min_pct: int = 5) -> DataFrame:
    """First against latest unit price per product name, whatever its spelling."""
    at = F.struct("date_purchased", "id", "unit_c")
    rows = L.items.groupBy(*L.keys, E.trimmed_lower("name").alias("product")).agg(
        F.min(at).alias("a"), F.max(at).alias("b"), F.count("*").alias("n"), F.max(E.product_title("name")).alias("item_name")
    )
    old, new = F.col("a.unit_c"), F.col("b.unit_c")
    rows = rows.filter((F.col("n") >= 2) & (old > 0) & ((new - old) * 100 >= old * min_pct) & (new > old))
    return rows.select(
        *L.keys, "item_name", euros(old).alias("historical_base_price"), euros(new).alias("latest_market_price"),
        safe_pct(new - old, old, 1).alias("percentage_inflation_drift"),
        F.col("a.date_purchased").alias("first_tracked_date"), F.col("b.date_purchased").alias("latest_tracked_date"),
    )


def regular_essentials(L: Ledger, today: dt.date, days: int = 180) -> DataFrame:
    """Products bought on three or more days over a month or longer, with their rhythm."""
    rows = L.items.filter(F.col("date_purchased") >= _cutoff(today, days)).groupBy(
        *L.keys, E.trimmed_lower("name").alias("product")
    ).agg(
        F.collect_set("date_purchased").alias("days"), F.min("date_purchased").alias("a"), F.max("date_purchased").alias("b"),
        F.min(F.struct("date_purchased", "id", "category", "storage_condition", "brand")).alias("first"),
        F.max(E.product_title("name")).alias("name"),
    )
    n, span = F.size("days").cast("bigint"), F.datediff("b", "a").cast("bigint")
    rows = rows.withColumn("n", n).withColumn("span", span).filter((F.col("n") >= 3) & (F.col("span") >= 30))
    steps = F.col("n") - 1
    tier = (
        F.when(F.col("span") <= steps * 8, "Weekly Staple").when(F.col("span") <= steps * 16, "Bi-Weekly Refill")
        .otherwise("Monthly Cyclical")
    )
    return rows.select(
        *L.keys, "name", F.col("first.category").alias("category"),
        F.col("first.storage_condition").alias("storage_condition"),
        F.coalesce(F.nullif(F.col("first.brand"), F.lit("")), F.lit("Generic")).alias("brand"),
        F.col("n").alias("total_purchases_tracked"),
        (half_up(F.col("span") * 10, steps) / 10.0).alias("average_restock_interval_days"),
        tier.alias("consumption_pacing_profile"), F.col("span").alias("historical_span_days"),
    )
