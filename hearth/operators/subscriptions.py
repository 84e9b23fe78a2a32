"""Recurring payments: the same payee, about the same amount, at a regular gap.

Payments are first collapsed to one row per (payee, day, amount).  Amounts of a payee that are too far apart
to ever meet in a cluster are separate islands, so a busy payee is spread over many tasks and the first-fit
clustering, which depends on order, only runs inside an island.
"""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..functions import exprs as E
from ..functions.money import euros
from ..schema import BILL_CATEGORIES, Ledger
from ..sources.scratch import written
from .base import sorted_fold, top_k
from .entries import category_lookup
from .finders import covered_until, recurring_payments

FREQUENCIES = ("monthly", "quarterly", "yearly")
# Shortest and longest gap of a period, days to the next payment, days until it counts as ended.
BANDS = {"monthly": (25, 36), "quarterly": (80, 100), "yearly": (345, 385)}
NEXT_DAYS = {"monthly": 30, "quarterly": 91, "yearly": 365}
ENDED_DAYS = {"monthly": 46, "quarterly": 136, "yearly": 548}
DUPLICATE_DAYS = 3
HISTORY = 12  # payments shown


def _far(a, b):
    """Amounts (cents) that are further apart than the larger of 1 euro and 12 % of b."""
    return F.abs(a - b) * 100 > F.greatest(F.lit(10_000).cast("bigint"), b * 12)


def payment_islands(payments: DataFrame, keys: list[str]) -> DataFrame:
    """Payments with the island their amount lies in: amounts of different islands never meet in a cluster."""
    own = [*keys, "payee"]
    rows = written(payments.select(*own, "id", "date", "amount_c", "name", "category"))
    by_amount = W.partitionBy(*own).orderBy("amount_c")
    amounts = rows.select(*own, "amount_c").distinct().withColumn("_before", F.lag("amount_c").over(by_amount))
    apart = F.coalesce(_far(F.col("_before"), F.col("amount_c")), F.lit(True)).cast("int")
    amounts = amounts.withColumn("island", F.sum(apart).over(by_amount.rowsBetween(W.unboundedPreceding, 0)))
    return rows.join(amounts.drop("_before"), [*own, "amount_c"])


class _Cluster:
    """Running median of amounts, and the last payment that was kept."""

    __slots__ = ("amounts", "counts", "low", "below", "total", "kept")

    def __init__(self, amount: int):
        self.amounts, self.counts = [amount], {amount: 1}
        self.low = self.below = 0
        self.total, self.kept = 1, None

    def centre2(self) -> int:
        """Twice the median, a whole number."""
        low = self.amounts[self.low]
        same = self.below + self.counts[low] > self.total // 2
        return low + (low if same else self.amounts[self.low + 1])

    def fits(self, amount: int) -> bool:
        m2 = self.centre2()
        return abs(2 * amount - m2) * 100 <= max(20_000, 12 * m2)

    def add(self, amount: int) -> None:
        if amount in self.counts:
            self.counts[amount] += 1
            if amount < self.amounts[self.low]:
                self.below += 1
        else:
            at = bisect.bisect_left(self.amounts, amount)
            self.amounts.insert(at, amount)
            self.counts[amount] = 1
            if at <= self.low:
                self.low += 1
                self.below += 1
        self.total += 1
        target = (self.total - 1) // 2
        while self.below + self.counts[self.amounts[self.low]] <= target:
            self.below += self.counts[self.amounts[self.low]]
            self.low += 1
        while self.below > target:
            self.low -= 1
            self.below -= self.counts[self.amounts[self.low]]


class _FirstFit:
    """In order a payment joins the first cluster it fits, else opens one. Yields the payments that stay."""

    def __init__(self):
        self.clusters: list[_Cluster] = []

    def row(self, r: dict):
        amount = int(r["amount_c"])
        for at, cluster in enumerate(self.clusters):
            if cluster.fits(amount):
                cluster.add(amount)
                break
        else:
            at, cluster = len(self.clusters), _Cluster(amount)
            self.clusters.append(cluster)
        first = cluster.kept is None
        keep = first or (r["date"] - cluster.kept).days > DUPLICATE_DAYS
        if keep:
            cluster.kept = r["date"]
            yield at, r["date"], amount, r["id"], r["name"], r["category"]

    def end(self):
        return ()


class _DropClose:
    """Drops a payment within three days of the last one that was kept."""

    def __init__(self):
        self.kept = None

    def row(self, r: dict):
        if self.kept is None or (r["date"] - self.kept).days > DUPLICATE_DAYS:
            self.kept = r["date"]
            yield r["date"], int(r["amount_c"]), r["first_id"], r["name"], r["category"]

    def end(self):
        return ()


def _fields(df: DataFrame, names: list[str]) -> list[T.StructField]:
    return [T.StructField(n, df.schema[n].dataType) for n in names]


KEPT = "date date, amount_c bigint, first_id bigint, name string, category string"


def cluster_amounts(payments: DataFrame, keys: list[str]) -> DataFrame:
    """Payments by amount cluster, near-duplicates dropped: (payee, island, cluster, date, amount_c, ...).

    Payments join in order of date and id, each for itself: equal ones of a day are not taken together, as others may lie between them.
    """
    rows = payment_islands(payments, keys)
    own = [*keys, "payee", "island"]
    schema = T.StructType(_fields(rows, own) + T.StructType.fromDDL("cluster int, " + KEPT).fields)
    return sorted_fold(rows.select(*own, "date", "id", "amount_c", "name", "category"), own, ["date", "id"], _FirstFit, schema)


def merge_duplicates(rows: DataFrame, own: list[str]) -> DataFrame:
    """One row per day, minus the days within three days of the last kept one."""
    daily = rows.groupBy(*own, "date").agg(
        F.min("id").alias("first_id"), F.min_by("amount_c", "id").alias("amount_c"),
        F.min_by("name", "id").alias("name"), F.min_by("category", "id").alias("category"),
    )
    schema = T.StructType(_fields(daily, own) + T.StructType.fromDDL(KEPT).fields)
    return sorted_fold(daily.select(*own, "date", "amount_c", "first_id", "name", "category"), own, ["date"], _DropClose, schema)


def payment_frequency(kept: DataFrame, own: list[str]) -> DataFrame:
    """The period the gaps fit: median gap in the band and 60 % of the gaps in it, over two months or more."""
    gap = F.datediff("date", F.lag("date").over(W.partitionBy(*own).orderBy("date")))
    inside = [F.count_if(F.col("gap").between(lo, hi)).alias(name) for name, (lo, hi) in BANDS.items()]
    rows = kept.withColumn("gap", gap).groupBy(*own).agg(
        F.count("*").alias("payments"), F.count("gap").alias("gaps"), F.median("gap").alias("median_gap"),
        F.size(F.collect_set(E.month_index("date"))).alias("months"), F.min("date").alias("first_date"), *inside,
    )
    frequency = F.lit(None).cast("string")
    for name, (lo, hi) in BANDS.items():
        regular = F.col("median_gap").between(lo, hi) & (F.col(name) * 10 >= F.col("gaps") * 6)
        frequency = F.when(regular, name).otherwise(frequency)
    rows = rows.withColumn("frequency", F.when(F.col("months") >= 2, frequency))
    return rows.select(*own, "payments", "median_gap", "months", "first_date", "frequency")


def detect_recurring(L: Ledger, payments: DataFrame | None = None) -> DataFrame:
    """Kept payments of every recurring payee, with evidence and frequency."""
    keys = list(L.keys)
    own = [*keys, "payee"]
    payments = recurring_payments(L) if payments is None else payments
    clustered = written(cluster_amounts(payments, keys))
    each = [*own, "island", "cluster"]
    starts = clustered.groupBy(*each).agg(F.min(F.struct("date", "first_id")).alias("start"))
    regular = payment_frequency(clustered, each).filter(F.col("frequency").isNotNull()).join(starts, each)
    best = F.row_number().over(W.partitionBy(*own).orderBy(F.col("payments").desc(), F.col("start")))
    best = regular.withColumn("_rank", best).filter(F.col("_rank") == 1).select(*each, "frequency")
    best = written(best)
    shape = [*own, "evidence", "frequency", "date", "amount_c", "first_id", "name", "category"]
    pattern = clustered.join(best, each).withColumn("evidence", F.lit("pattern")).select(*shape)

    # No regular cluster: guess from the category, for fixed costs only.
    has = [k for k in keys if k in L.categories.columns]
    fixed = category_lookup(L, "expense").filter("fixed").select(*has, F.col("_found").alias("category"))
    loose = payments.join(fixed, [*has, "category"], "left_semi").join(best.select(*own), own, "left_anti")
    latest = loose.groupBy(*own).agg(
        F.max_by("amount_c", F.struct("date", (-F.col("id")).alias("i"))).alias("latest_c")
    )
    near = loose.join(latest, own).filter(~_far(F.col("amount_c"), F.col("latest_c")))
    guessed = merge_duplicates(near, own).withColumn("evidence", F.lit("category")).withColumn("frequency", F.lit("monthly"))
    return pattern.unionByName(guessed.select(*shape))


def apply_rules(items: DataFrame, L: Ledger) -> DataFrame:
    """The household's own word on a payee: another frequency wins, hidden is marked. Needs payee, frequency, evidence."""
    rules = L.rules.select(
        *L.keys, F.col("key").alias("slug"), F.col("frequency").alias("_frequency"), F.col("hidden").alias("_hidden")
    )
    df = items.withColumn("slug", E.slug("payee")).join(rules, L.on("slug"), "left")
    said = F.coalesce(F.col("_frequency").isin(*FREQUENCIES), F.lit(False))
    return (
        df.withColumn("evidence", F.when(said, "you").otherwise(F.col("evidence")))
        .withColumn("frequency", F.when(said, F.col("_frequency")).otherwise(F.col("frequency")))
        .withColumn("hidden", F.coalesce("_hidden", F.lit(False))).drop("_frequency", "_hidden")
    )


def _most_common(kept: DataFrame, own: list[str], column: str) -> DataFrame:
    """Most frequent value; ties go to the one seen first, then by name."""
    counts = kept.filter(F.length(column) > 0).groupBy(*own, column).agg(
        F.count("*").alias("_n"), F.min(F.struct("date", "first_id")).alias("_at")
    )
    rank = F.struct((-F.col("_n")).alias("n"), "_at", column)
    return counts.groupBy(*own).agg(F.min_by(column, rank).alias(f"common_{column}"))


def subscription_items(L: Ledger, include_hidden: bool = False) -> DataFrame:
    keys = list(L.keys)
    own = [*keys, "payee"]
    payments = written(recurring_payments(L))
    kept = written(detect_recurring(L, payments))
    at = F.struct("date", "first_id", "amount_c")
    items = kept.groupBy(*own).agg(
        F.first("evidence").alias("evidence"), F.first("frequency").alias("frequency"), F.count("*").alias("payments"),
        F.min(at).alias("a"), F.max(at).alias("z"),
    )
    shown = top_k(kept, own, [F.col("date").desc(), F.col("amount_c").desc()], HISTORY)
    history = F.sort_array(F.collect_list(F.struct("date", euros("amount_c").alias("amount"))))
    items = items.join(shown.groupBy(*own).agg(history.alias("history")), own)
    items = apply_rules(items, L)
    items = items.join(_most_common(kept, own, "category"), own, "left").join(_most_common(kept, own, "name"), own, "left")
    items = items.join(covered_until(payments, keys), keys, "left")
    has = [k for k in keys if k in L.categories.columns]
    labels = category_lookup(L).select(*has, F.col("_found").alias("common_category"), F.col("label"))
    items = items.join(labels, [*has, "common_category"], "left")

    first, last, last_day = F.col("a.amount_c"), F.col("z.amount_c"), F.col("z.date")
    moved = (F.col("payments") >= 2) & (F.abs(last - first) * 100 > first * 2)
    wait = E.literal_map("frequency", ENDED_DAYS).cast("int")
    ended = F.coalesce(F.col("covered_until") >= F.date_add(last_day, wait), F.lit(False))
    cost = E.monthly_cost_c(last, "frequency")
    rows = items.select(
        *keys, F.col("slug").alias("key"), F.col("common_name").alias("name"), F.col("common_category").alias("category_key"),
        F.coalesce("label", F.lit("Uncategorized")).alias("category"),
        F.when(F.col("common_category").isin(*BILL_CATEGORIES), "bill").otherwise("subscription").alias("section"),
        euros(last).alias("amount"), "frequency", cost.alias("monthly_c"), euros(cost).alias("monthly_cost"),
        euros(cost * 12).alias("yearly_cost"), "payments", F.col("a.date").alias("first_date"), last_day.alias("last_date"),
        F.when(~ended, F.date_add(last_day, E.literal_map("frequency", NEXT_DAYS).cast("int"))).alias("next_expected"),
        F.when(ended, "ended").otherwise("active").alias("status"), "evidence",
        F.when(F.col("payments") >= 3, "confirmed").when(F.col("evidence") != "category", "likely").otherwise("assumed")
        .alias("confidence"),
        F.when(moved, euros(first)).alias("price_from"), F.when(moved, euros(last)).alias("price_to"), "history", "hidden",
    )
    if not include_hidden:
        rows = rows.filter(~F.col("hidden"))
    return rows


def sorted_items(items: DataFrame, L: Ledger) -> DataFrame:
    """Ended last, then by monthly cost."""
    return items.orderBy(*L.keys, F.col("status") == "ended", F.col("monthly_c").desc(), "key")


def subscription_summary(items: DataFrame, L: Ledger) -> DataFrame:
    active = items.filter((F.col("status") == "active") & ~F.col("hidden"))

    def part(test: Column) -> Column:
        return euros(F.coalesce(F.sum(F.when(test, F.col("monthly_c"))), F.lit(0)))

    return active.groupBy(*L.keys).agg(
        euros(F.sum("monthly_c")).alias("monthly_total"), euros(F.sum("monthly_c") * 12).alias("yearly_total"),
        F.count("*").alias("active"), part(F.col("confidence") == "assumed").alias("assumed_monthly"),
        part(F.col("section") == "subscription").alias("subscriptions_monthly"),
        part(F.col("section") == "bill").alias("bills_monthly"),
        F.count_if(F.col("price_to") > F.col("price_from")).alias("price_rises"),
    )
