"""What is at home, what to use first, and what was wasted."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..functions.money import euros, half_even, half_up
from ..schema import NOT_STOCK, Ledger
from .base import top_k
from .entries import category_lookup
from .finders import stock_base
from .spending import _sum_if

GROUPS = ("fridge", "freezer", "pantry", "home")
RESCUE_DAYS = 2
FINE = 10_000  # used value is summed in 1/10000 cent and rounded once


def with_stock_group(df: DataFrame, L: Ledger) -> DataFrame:
    """Adds group (fridge, freezer, pantry, home), is_food and the category label."""
    look = category_lookup(L).select(
        *[k for k in L.keys if k in L.categories.columns], F.col("_found").alias("spend_category"),
        F.col("label").alias("_label"), F.col("group").alias("_group_name"),
    )
    df = df.join(look, L.dim_on(L.categories, "spend_category"), "left")
    food = F.when(F.col("_group_name").isNotNull(), F.col("_group_name") == "Food").otherwise(
        F.col("category").isin("Food", "Drinks")
    )
    return df.withColumn("is_food", F.coalesce(food, F.lit(False))).withColumn(
        "group", E.stock_group("storage_condition", F.col("is_food"))
    )


def _left() -> Column:
    return F.coalesce(F.col("quantity_left"), F.col("quantity").cast("double"), F.lit(1.0))


def stock_views(L: Ledger, today: dt.date) -> DataFrame:
    """Everything still at home with its urgency (unsorted)."""
    base = with_stock_group(stock_base(L.with_(items=L.items.filter(F.col("quantity_left") > 0))), L)
    expiry = E.effective_expiry("group")
    df = base.withColumn("effective_expiry", expiry).withColumn(
        "days_left", F.datediff("effective_expiry", F.lit(today))
    )
    return df.select(
        *L.keys, "id", "receipt_id", "name", "brand", "quantity", _left().alias("quantity_left"),
        E.value_of(_left()).alias("value_c"), F.col("store_name").alias("store"), "purchase_date", "owner",
        F.coalesce("_label", "category").alias("category"), "spend_category", "group", "storage_condition", "location",
        "date_expiry", "effective_expiry", "days_left", E.urgency("days_left").alias("urgency"),
        E.is_stale("days_left").alias("stale"), "opened_on", "rating", "would_rebuy", "status",
    )


def _urgency_order() -> list[Column]:
    return [F.col("days_left").asc_nulls_last(), F.lower("name"), F.col("id")]


def stock_items(L: Ledger, today: dt.date) -> DataFrame:
    """Everything still at home, most urgent first."""
    df = stock_views(L, today).withColumn("value_left", euros("value_c")).drop("value_c")
    return df.orderBy(*L.keys, *_urgency_order())


def stock_summary(L: Ledger, today: dt.date) -> DataFrame:
    urgent = F.col("urgency").isin("expired", "soon") & ~F.col("stale")
    return stock_views(L, today).groupBy(*L.keys).agg(
        F.count("*").alias("items"), euros(F.sum("value_c")).alias("value"),
        *[F.count_if(F.col("group") == g).alias(g) for g in GROUPS],
        F.count("opened_on").alias("opened"), F.count_if(urgent).alias("use_soon"),
        euros(_sum_if(urgent, "value_c")).alias("value_at_risk"), F.count_if("stale").alias("stale"),
    )


def use_first(L: Ledger, today: dt.date, k: int = 25) -> DataFrame:
    """Food to use first, with when it goes off in words."""
    food = stock_views(L, today).filter(
        (F.col("group") != "home") & F.col("urgency").isin("expired", "soon", "week")
    )
    d = F.col("days_left")
    when = F.when(d < 0, F.lit("expired")).when(d == 0, F.lit("today")).otherwise(
        F.concat(F.lit("in "), d.cast("string"), F.lit(" days"))
    )
    return top_k(food, list(L.keys), _urgency_order(), k).select(
        *L.keys, "id", "name", "quantity_left", "group", F.col("opened_on").isNotNull().alias("opened"),
        when.alias("goes_off"),
    )


# ---- waste ---------------------------------------------------------------------------------------------
def _movements(L: Ledger, days: int, today: dt.date) -> DataFrame:
    """Stock lines with what of them was wasted and used inside the window."""
    start = F.lit(today - dt.timedelta(days=days))
    df = with_stock_group(stock_base(L), L)
    wasted_q = F.coalesce("wasted_quantity", F.lit(0.0))
    wasted = F.coalesce((wasted_q > 0) & (F.col("wasted_on") >= start), F.lit(False))
    finished = F.coalesce(F.col("finished_on") >= start, F.lit(False))
    used_q = F.greatest(F.lit(0.0), F.col("quantity") - wasted_q - F.coalesce("quantity_left", F.lit(0.0)))
    used_q = F.when(F.col("waste_reason").isin("gave_away", "cleared"), F.lit(0.0)).otherwise(used_q)
    fine = F.round(
        used_q * E.net_line_c() / F.greatest(F.coalesce("quantity", F.lit(1)), F.lit(1)) * FINE
    ).cast("bigint")
    spare = F.datediff(E.effective_expiry("group"), "finished_on")
    rescued = finished & (F.col("status") == "Consumed") & spare.between(0, RESCUE_DAYS)
    return df.select(
        *L.keys, "id", "name", "group", "waste_reason", "wasted_on", wasted.alias("wasted"),
        F.when(wasted, E.value_of("wasted_quantity")).alias("wasted_c"), F.when(finished, fine).alias("used_fine"),
        F.coalesce(rescued, F.lit(False)).alias("rescued"), E.value_of(used_q).alias("used_c"),
    )


def waste_score(L: Ledger, today: dt.date, days: int = 90) -> DataFrame:
    rows = _movements(L, days, today).groupBy(*L.keys).agg(
        F.coalesce(F.sum("wasted_c"), F.lit(0)).alias("w"), F.count_if("wasted").alias("wasted_items"),
        F.coalesce(F.sum("used_fine"), F.lit(0)).alias("u"), F.max("wasted_on").alias("last"),
    )
    whole = F.col("w") * FINE + F.col("u")
    tenths = F.when(whole > 0, half_up(F.col("w") * FINE * 1000, whole))
    return rows.withColumn("tenths", tenths).select(
        *L.keys, half_even(1000 - F.col("tenths"), F.lit(10).cast("bigint")).alias("score"),
        (F.col("tenths") / 10.0).alias("waste_rate_pct"), euros("w").alias("wasted_value"), "wasted_items",
        euros(half_up("u", F.lit(FINE).cast("bigint"))).alias("used_value"),
        F.datediff(F.lit(today), "last").alias("days_since_last_waste"),
    )


def _wasted(L: Ledger, days: int, today: dt.date) -> DataFrame:
    return _movements(L, days, today).filter("wasted")


def waste_by_reason(L: Ledger, today: dt.date, days: int = 90) -> DataFrame:
    reason = F.coalesce(F.nullif(F.col("waste_reason"), F.lit("")), F.lit("other"))
    return _wasted(L, days, today).groupBy(*L.keys, reason.alias("reason")).agg(euros(F.sum("wasted_c")).alias("value"))


def waste_by_group(L: Ledger, today: dt.date, days: int = 90) -> DataFrame:
    return _wasted(L, days, today).groupBy(*L.keys, "group").agg(euros(F.sum("wasted_c")).alias("value"))


def _waste_names(L: Ledger, days: int, today: dt.date) -> DataFrame:
    return _wasted(L, days, today).groupBy(*L.keys, E.product_key("name").alias("product")).agg(
        F.min_by("name", "id").alias("name"), F.count("*").alias("times"), F.sum("wasted_c").alias("value_c")
    )


def waste_by_product(L: Ledger, today: dt.date, days: int = 90, top: int = 5) -> DataFrame:
    best = top_k(_waste_names(L, days, today), list(L.keys), [F.col("value_c").desc(), F.col("product")], top)
    return best.select(*L.keys, "name", "times", euros("value_c").alias("value"))


def repeat_waste(L: Ledger, today: dt.date, days: int = 90) -> DataFrame:
    return _waste_names(L, days, today).filter(F.col("times") >= 2).select(*L.keys, "name", "times")


def rescued(L: Ledger, today: dt.date, days: int = 90) -> DataFrame:
    """Used up on the last days before going off."""
    return _movements(L, days, today).filter("rescued").groupBy(*L.keys).agg(
        F.count("*").alias("items"), euros(F.sum("used_c")).alias("value")
    )


def stock_duplicates(L: Ledger, today: dt.date) -> DataFrame:
    """The same product more than once at home. Places are counted first, so a long list stays short."""
    at = stock_views(L, today).groupBy(*L.keys, E.product_key("name").alias("product"), "location").agg(
        F.count("*").alias("n"), F.sum("quantity_left").alias("q"),
        F.min(F.struct(F.coalesce("days_left", F.lit(2**31 - 1)).alias("d"), "id", "name")).alias("first"),
    )
    place = F.concat(F.coalesce("location", F.lit("?")), F.lit(" x"), F.col("n").cast("string"))
    rows = at.groupBy(*L.keys, "product").agg(
        F.min("first").alias("first"), F.sum("n").alias("count"),
        F.array_join(F.sort_array(F.collect_list(place)), ", ").alias("locations"),
        F.round(F.sum("q"), 2).alias("total_left"),
    )
    return rows.filter(F.col("count") > 1).select(
        *L.keys, F.col("first.name").alias("name"), "count", "locations", "total_left"
    )


def product_opinions(L: Ledger, top: int = 10) -> DataFrame:
    """Liked (4 stars or buy again) and avoid (2 stars or never again); liked wins."""
    good = F.coalesce(F.col("rating") >= 4, F.lit(False)) | F.coalesce(F.col("would_rebuy"), F.lit(False))
    bad = F.coalesce(F.col("rating") <= 2, F.lit(False)) | F.coalesce(~F.col("would_rebuy"), F.lit(False))
    rows = stock_base(L).groupBy(*L.keys, E.product_key("name").alias("product")).agg(
        F.max_by(F.when(good, F.col("name")), F.when(good, F.col("id"))).alias("liked"),
        F.max(F.when(good, F.coalesce("rating", F.lit(0)))).alias("stars"),
        F.max(F.when(bad, F.struct("id", "name", "rating"))).alias("avoid"),
    )
    liked = rows.filter(F.col("liked").isNotNull()).select(
        *L.keys, "product", F.lit("liked").alias("opinion"), F.col("liked").alias("name"), F.col("stars").alias("rating")
    )
    avoid = rows.filter(F.col("liked").isNull() & F.col("avoid").isNotNull()).select(
        *L.keys, "product", F.lit("avoid").alias("opinion"), F.col("avoid.name").alias("name"),
        F.col("avoid.rating").alias("rating"),
    )
    liked = top_k(liked, list(L.keys), [F.col("rating").desc(), F.col("product")], top)
    return liked.unionByName(top_k(avoid, list(L.keys), [F.col("product")], top)).drop("product")


def clear_stale(L: Ledger, today: dt.date, only: DataFrame | None = None) -> DataFrame:
    """Next items table: stock long past its date counts as used up, neither eaten in time nor wasted.

    `only` (keys + receipt_id) restricts it to some receipts.
    """
    stale = stock_views(L, today).filter("stale")
    if only is not None:
        stale = stale.join(only, L.on("receipt_id"), "left_semi")
    hit = stale.select(*L.keys, "id", F.lit(True).alias("_stale"))
    return _cleared(L.items.join(hit, L.on("id"), "left"), today).select(*L.items.columns)


def clear_stale_rows(items: DataFrame, L: Ledger, today: dt.date) -> DataFrame:
    """`clear_stale` for new items that come with their receipts: a row tells by itself whether it is stale, nothing is joined but its category."""
    at_home = (F.col("quantity_left") > 0) & (F.col("spend_category").isNull() | ~F.col("spend_category").isin(*NOT_STOCK))
    days_left = F.datediff(E.effective_expiry("group"), F.lit(today))
    marked = with_stock_group(items, L).withColumn("_stale", at_home & E.is_stale(days_left))
    return _cleared(marked, today).select(*items.columns)


def _cleared(df: DataFrame, today: dt.date) -> DataFrame:
    """df with the items that are `_stale` used up."""
    old = F.coalesce("_stale", F.lit(False))
    status = F.when(F.coalesce("wasted_quantity", F.lit(0.0)) > 0, E.waste_status(F.lit("cleared"))).otherwise("Consumed")
    return (
        df.withColumn("status", F.when(old, status).otherwise(F.col("status")))
        .withColumn("quantity_left", F.when(old, 0.0).otherwise(F.col("quantity_left")))
        .withColumn("waste_reason", F.when(old, "cleared").otherwise(F.col("waste_reason")))
        .withColumn("finished_on", F.when(old, F.lit(today)).otherwise(F.col("finished_on")))
    )
