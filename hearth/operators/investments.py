"""What was invested, per broker, month, year and instrument, and what each booking bought."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..functions import exprs as E
from ..functions.money import euros, half_up
from ..schema import ALWAYS_LISTED, BROKERS, MANUAL, UNKNOWN, Ledger
from ..sources.scratch import written
from .base import month_of, month_spine, sorted_fold
from .finders import investment_bookings
from .savings_plans import execution_dates
from .spending import _sum_if

WINDOW_DAYS = 3


def broker_months(L: Ledger) -> DataFrame:
    """Months with a statement, per broker."""
    st = L.statements.filter(F.col("bank").isin(*BROKERS))
    return st.select(*L.keys, F.col("bank").alias("broker"), "month_index").distinct()


def broker_coverage(L: Ledger) -> DataFrame:
    """How many months a broker has statements for, and the last day they reach."""
    rows = broker_months(L).groupBy(*L.keys, "broker").agg(
        F.count("*").alias("months"), F.max("month_index").alias("m")
    )
    return rows.select(*L.keys, "broker", "months", F.last_day(E.month_start("m")).alias("covered_until"))


# ---- what each booking bought --------------------------------------------------------------------------
class _Greedy:
    """Pairs expected executions with buys, smallest gap first, on day counts of one (broker, amount) island.

    Equal buys of one day are interchangeable up to their id order, so only counts per day are needed; pairs
    come out as rank ranges (slot day, first slot rank, buy day, first buy rank, how many).
    """

    def __init__(self):
        self.slots: dict[dt.date, list[int]] = {}
        self.buys: dict[dt.date, list[int]] = {}

    def row(self, r: dict):
        if r["n_slots"]:
            self.slots[r["day"]] = [int(r["n_slots"]), 0]
        if r["n_buys"]:
            self.buys[r["day"]] = [int(r["n_buys"]), 0]
        return ()

    def end(self):
        days = sorted(self.slots)
        for gap in range(WINDOW_DAYS + 1):
            for day in days:
                want = self.slots[day]
                for offset in ([0] if gap == 0 else [-gap, gap]):
                    have = self.buys.get(day + dt.timedelta(days=offset))
                    if have is None:
                        continue
                    n = min(want[0], have[0])
                    if n > 0:
                        yield day, want[1] + 1, day + dt.timedelta(days=offset), have[1] + 1, n
                        want[0], want[1] = want[0] - n, want[1] + n
                        have[0], have[1] = have[0] - n, have[1] + n


def assign_plan_buys(slots: DataFrame, buys: DataFrame, keys: list[str]) -> DataFrame:
    """Each expected execution gets at most one buy of its amount within three days, the closest first.

    slots: keys, broker, amount_c, day, plan_id.  buys: keys, broker, amount_c, day, id.
    Returns keys, broker, amount_c, plan_id, slot_day, id.
    """
    own = [*keys, "broker", "amount_c"]
    counted = (
        slots.groupBy(*own, "day").agg(F.count("*").alias("n_slots")).withColumn("n_buys", F.lit(0).cast("bigint"))
        .unionByName(buys.groupBy(*own, "day").agg(F.count("*").alias("n_buys")).withColumn("n_slots", F.lit(0).cast("bigint")))
        .groupBy(*own, "day").agg(F.sum("n_slots").alias("n_slots"), F.sum("n_buys").alias("n_buys"))
    )
    # No pair can reach over a gap of more than three days: the islands between such gaps are independent.
    by_day = W.partitionBy(*own).orderBy("day")
    gap = F.datediff("day", F.lag("day").over(by_day))
    islands = counted.withColumn("_new", F.coalesce(gap > WINDOW_DAYS, F.lit(True)).cast("int")).withColumn(
        "island", F.sum("_new").over(by_day.rowsBetween(W.unboundedPreceding, 0))
    )
    island = [*own, "island"]
    both = islands.groupBy(*island).agg(F.sum("n_slots").alias("s"), F.sum("n_buys").alias("b"))
    both = both.filter((F.col("s") > 0) & (F.col("b") > 0)).select(*island)
    work = islands.join(both, island, "left_semi").select(*island, "day", "n_slots", "n_buys")
    schema = T.StructType(
        [T.StructField(c, work.schema[c].dataType) for c in island]
        + T.StructType.fromDDL("slot_day date, slot_from bigint, buy_day date, buy_from bigint, n bigint").fields
    )
    ranges = written(sorted_fold(work, island, ["day"], _Greedy, schema))
    pairs = ranges.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1))).select(
        *own, "slot_day", (F.col("slot_from") + F.col("_i")).alias("slot_rank"), "buy_day",
        (F.col("buy_from") + F.col("_i")).alias("buy_rank"),
    )

    def ranked(df: DataFrame, order: str, day: str, rank: str) -> DataFrame:
        at = F.row_number().over(W.partitionBy(*own, "day").orderBy(order)).cast("bigint")
        return df.select(*own, F.col("day").alias(day), at.alias(rank), order)

    # Only slots of days that have a pair are ranked: the others need no exchange.
    paired = slots.join(ranges.select(*own, F.col("slot_day").alias("day")).distinct(), [*own, "day"], "left_semi")
    return (
        pairs.join(ranked(paired, "plan_id", "slot_day", "slot_rank"), [*own, "slot_day", "slot_rank"])
        .join(ranked(buys, "id", "buy_day", "buy_rank"), [*own, "buy_day", "buy_rank"])
        .select(*own, "plan_id", "slot_day", "id")
    )


def open_buys(L: Ledger, rows: DataFrame) -> DataFrame:
    """Buys that neither name what they bought nor were typed by the household."""
    typed = L.splits.select(*L.keys, F.col("booking_ref").alias("ref")).distinct()
    return rows.filter((F.col("amount_c") > 0) & F.col("code").isNull()).join(typed, L.on("ref"), "left_anti")


def plan_slots(L: Ledger, rows: DataFrame, today: dt.date) -> DataFrame:
    """Expected executions of the plans with a known day, up to where the statements reach."""
    floor = rows.groupBy(*L.keys, "broker").agg(F.min("date").alias("first_day"))
    plans = (
        L.plans.filter(F.col("anchor_date").isNotNull())
        .join(broker_coverage(L).drop("months"), L.on("broker"), "left").join(floor, L.on("broker"), "left")
    )
    now = F.lit(today)
    lowest = F.date_sub(F.coalesce("first_day", now), WINDOW_DAYS)
    horizon = F.least(F.coalesce("covered_until", now), now)
    # A plan is a row of a few bytes and unfolds into hundreds: the plans are dealt out before, or the few files they lie in would be all the tasks there are.
    plans = plans.repartition(int(L.spark.conf.get("spark.sql.shuffle.partitions")), *L.on("id"))
    return execution_dates(plans, F.coalesce(F.col("start_date"), lowest), F.greatest(horizon, lowest)).select(
        *L.keys, "broker", "amount_c", "day", F.col("id").alias("plan_id"), "instrument", "covered_until"
    )


def _covered_days(days: DataFrame, plans: DataFrame, own: list[str]) -> DataFrame:
    """Days on which any plan of the broker runs, with _any: a running maximum of the ends of the plans begun so far."""
    begun = F.coalesce("start_date", F.lit("0001-01-01").cast("date"))
    spans = plans.select(*own, begun.alias("day"), F.coalesce("end_date", F.lit("9999-12-31").cast("date")).alias("_end"))
    spans = spans.groupBy(*own, "day").agg(F.max("_end").alias("_end"))
    stacked = spans.unionByName(days.withColumn("_end", F.lit(None).cast("date")))
    so_far = F.max("_end").over(W.partitionBy(*own).orderBy("day").rangeBetween(W.unboundedPreceding, 0))
    asked = stacked.withColumn("_until", so_far).filter(F.col("_end").isNull() & (F.col("_until") >= F.col("day")))
    return asked.select(*own, "day", F.lit(True).alias("_any"))


def match_plan_amount(buys: DataFrame, L: Ledger) -> DataFrame:
    """Plans without a known day: the amount decides when only one instrument is meant.

    Works on (broker, amount, day) cells, so equal buys of a day are looked up once.
    Adds source (plan_amount, ambiguous, manual_buy or null), names and plan_id to the cells.
    """
    own = [*L.keys, "broker"]
    cells = buys.select(*own, "amount_c", F.col("date").alias("day")).distinct()
    running = (F.coalesce(F.col("start_date") <= F.col("day"), F.lit(True))) & (
        F.coalesce(F.col("end_date") >= F.col("day"), F.lit(True))
    )
    loose = L.plans.filter(F.col("anchor_date").isNull()).select(
        *own, "amount_c", "instrument", F.col("id").alias("plan_id"), "start_date", "end_date"
    )
    fits = cells.join(loose, [*own, "amount_c"]).filter(running).groupBy(*own, "amount_c", "day").agg(
        F.sort_array(F.collect_set("instrument")).alias("names"), F.min("plan_id").alias("plan_id")
    )
    covered = _covered_days(cells.select(*own, "day").distinct(), L.plans, own)
    rows = cells.join(fits, [*own, "amount_c", "day"], "left").join(covered, [*own, "day"], "left")
    n = F.coalesce(F.size("names"), F.lit(0))
    source = F.when(n == 1, "plan_amount").when(n > 1, "ambiguous").when(F.col("_any"), "manual_buy")
    return rows.withColumn("source", source).drop("_any")


@dataclass(frozen=True)
class Assigned:
    """Plans held against bookings, once for all that ask: the bookings, the open buys, the expected executions and which buy each got."""

    rows: DataFrame
    buys: DataFrame
    slots: DataFrame
    pairs: DataFrame


def assigned(L: Ledger, today: dt.date, rows: DataFrame | None = None) -> Assigned:
    rows = written(investment_bookings(L)) if rows is None else rows
    buys = written(open_buys(L, rows))
    slots = written(plan_slots(L, rows, today))
    pairs = assign_plan_buys(
        slots.select(*L.keys, "broker", "amount_c", "day", "plan_id"),
        buys.select(*L.keys, "broker", "amount_c", F.col("date").alias("day"), "id"), list(L.keys),
    )
    return Assigned(rows, buys, slots, written(pairs))


def resolve_instruments(L: Ledger, today: dt.date, rows: DataFrame | None = None, found: Assigned | None = None) -> DataFrame:
    """What each booking bought and how we know, strongest first:
    typed, named by the booking, a plan's day, a plan's amount, outside every plan, unknown."""
    found = found or assigned(L, today, rows)
    rows, buys, pairs = found.rows, found.buys, found.pairs
    typed = L.splits.select(*L.keys, F.col("booking_ref").alias("ref"), F.col("instrument").alias("_typed"))
    typed = typed.groupBy(*L.keys, "ref").agg(F.min("_typed").alias("_typed"))
    names = L.plans.select(*L.keys, F.col("id").alias("_plan"), F.col("instrument").alias("_planned"))
    planned = written(pairs.select(*L.keys, "id", F.col("plan_id").alias("_plan")).join(names, L.on("_plan"), "left"))
    rest = buys.join(planned.select(*L.keys, "id"), L.on("id"), "left_anti")
    cells = match_plan_amount(rest, L)
    guess = rest.select(*L.keys, "id", "broker", "amount_c", F.col("date").alias("day")).join(
        cells, L.on("broker", "amount_c", "day")
    ).select(
        *L.keys, "id", F.col("source").alias("_source"), F.col("plan_id").alias("_guess_plan"),
        F.when(F.col("source") == "plan_amount", F.get("names", F.lit(0)))
        .when(F.col("source") == "manual_buy", MANUAL).otherwise(UNKNOWN).alias("_guess"),
        F.when(F.col("source") == "ambiguous", F.col("names")).alias("_candidates"),
    )
    out = rows.join(typed, L.on("ref"), "left").join(planned, L.on("id"), "left").join(guess, L.on("id"), "left")
    named = F.when(F.col("code").isNotNull(), F.col("counterparty"))
    return out.select(
        *[F.col(c) for c in rows.columns],
        F.coalesce("_typed", named, "_planned", "_guess", F.lit(UNKNOWN)).alias("instrument"),
        F.when(F.col("_typed").isNotNull(), "manual").when(F.col("code").isNotNull(), "booking")
        .when(F.col("_planned").isNotNull(), "plan").otherwise(F.coalesce("_source", F.lit("unknown"))).alias("source"),
        F.when(F.col("_typed").isNull() & F.col("code").isNull(),
               F.coalesce("_plan", F.when(F.col("_source") == "plan_amount", F.col("_guess_plan")))).alias("plan_id"),
        F.when(F.col("_typed").isNull(), F.array_join("_candidates", ", ")).alias("candidates"),
    )


def missed_executions(L: Ledger, today: dt.date, found: Assigned | None = None) -> DataFrame:
    """Expected executions the statements already reach, with whether a buy was found."""
    held = found or assigned(L, today)
    slots, pairs = held.slots, held.pairs
    seen = F.date_add("day", WINDOW_DAYS) <= F.least(F.col("covered_until"), F.lit(today))
    found = pairs.select(*L.keys, "plan_id", F.col("slot_day").alias("day"), F.lit(True).alias("_found"))
    return (
        slots.filter(F.col("covered_until").isNotNull() & seen).join(found, L.on("plan_id", "day"), "left")
        .select(*L.keys, "broker", "plan_id", "instrument", "amount_c", "day", F.coalesce("_found", F.lit(False)).alias("found"))
    )


def plan_check(L: Ledger, today: dt.date) -> DataFrame:
    """Per broker with plans: expected, matched and missed executions, and the buys no plan explains."""
    keys = L.on("broker")
    found = assigned(L, today)
    slots = missed_executions(L, today, found).groupBy(*keys).agg(
        F.count("*").alias("expected"), F.count_if("found").alias("matched"), F.count_if(~F.col("found")).alias("missed")
    )
    active = E.plan_status(today) == "active"
    plans = L.plans.groupBy(*keys).agg(
        F.count_if(active & F.col("anchor_date").isNotNull()).alias("anchored_plans"),
        F.count_if(active & F.col("anchor_date").isNull()).alias("unanchored_plans"),
    )
    odd = resolve_instruments(L, today, found=found).groupBy(*keys).agg(
        *[c for s in ("manual_buy", "ambiguous") for c in (
            F.count_if(F.col("source") == s).alias(f"{s}_count"),
            euros(_sum_if(F.col("source") == s)).alias(f"{s}_net"),
        )]
    )
    zero = lambda c, z=0: F.coalesce(F.col(c), F.lit(z)).alias(c)
    return plans.join(slots, keys, "left").join(odd, keys, "left").select(
        *keys, zero("expected"), zero("matched"), zero("missed"), "anchored_plans", "unanchored_plans",
        zero("manual_buy_count"), zero("manual_buy_net", 0.0), zero("ambiguous_count"), zero("ambiguous_net", 0.0),
    )


# ---- totals --------------------------------------------------------------------------------------------
def broker_totals(L: Ledger, named: DataFrame) -> DataFrame:
    """Net, bookings and the unknown part per broker; the usual brokers are listed even when empty."""
    keys = L.on("broker")
    sums = named.groupBy(*keys).agg(
        F.sum("amount_c").alias("net_c"), F.count("*").alias("bookings"),
        _sum_if(F.col("instrument") == UNKNOWN).alias("unknown_c"),
    )
    listed = L.statements.select(*L.keys).distinct().withColumn(
        "broker", F.explode(F.array(*[F.lit(b) for b in ALWAYS_LISTED]))
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return listed.join(sums, keys, "full").select(
        *keys, euros(zero("net_c")).alias("net"), zero("bookings").alias("bookings"), euros(zero("unknown_c")).alias("unknown")
    )


def _months(L: Ledger, named: DataFrame, today: dt.date, by_broker: bool) -> DataFrame:
    """Every month from the first booking on: net, bought, sold, count, and whether it is covered."""
    own = L.on("broker") if by_broker else list(L.keys)
    cells = named.groupBy(*own, E.month_index("date").alias("month_index")).agg(
        F.sum("amount_c").alias("net_c"), _sum_if(F.col("amount_c") > 0).alias("bought_c"),
        F.coalesce(F.sum(F.when(F.col("amount_c") <= 0, -F.col("amount_c"))), F.lit(0)).alias("sold_c"),
        F.count("*").alias("count"),
    )
    span = cells.groupBy(*own).agg(F.min("month_index").alias("a"), F.max("month_index").alias("b"))
    spine = month_spine(span, F.col("a"), F.greatest(F.col("b"), F.lit(month_of(today.year, today.month)))).drop("a", "b")
    with_statement = broker_months(L).select(*own, "month_index").distinct().withColumn("_st", F.lit(True))
    rows = spine.join(cells, [*own, "month_index"], "left").join(with_statement, [*own, "month_index"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return rows.select(
        *own, "month_index", zero("net_c"), zero("bought_c"), zero("sold_c"), zero("count"),
        (F.col("_st").isNotNull() | F.col("count").isNotNull()).alias("covered"),
    )


def investment_months(L: Ledger, named: DataFrame, today: dt.date, by_broker: bool = False) -> DataFrame:
    own = L.on("broker") if by_broker else list(L.keys)
    return _months(L, named, today, by_broker).select(
        *own, "month_index", E.month_label("month_index").alias("label"), "covered", euros("net_c").alias("net"),
        euros("bought_c").alias("bought"), euros("sold_c").alias("sold"), "count",
    )


def investment_month_parts(L: Ledger, named: DataFrame, part: str) -> DataFrame:
    """Net per month and instrument or broker."""
    return named.groupBy(*L.keys, E.month_index("date").alias("month_index"), part).agg(
        euros(F.sum("amount_c")).alias("net")
    )


def _years(months: DataFrame, own: list[str]) -> DataFrame:
    year = F.floor(F.col("month_index") / 12).cast("int")
    rows = months.groupBy(*own, year.alias("year")).agg(
        *[F.sum(c).alias(c) for c in ("net_c", "bought_c", "sold_c", "count")], F.count_if("covered").alias("months")
    )
    average = F.when(F.col("months") > 0, half_up("net_c", F.col("months"))).otherwise(F.lit(0))
    return rows.withColumn("avg_c", average)


def investment_years(L: Ledger, named: DataFrame, today: dt.date) -> DataFrame:
    """Per year; the monthly average is the sum of every broker's own average over its covered months."""
    whole = _years(_months(L, named, today, False), list(L.keys)).drop("avg_c")
    parts = _years(_months(L, named, today, True), L.on("broker")).groupBy(*L.keys, "year").agg(F.sum("avg_c").alias("avg_c"))
    return whole.join(parts, L.on("year"), "left").select(
        *L.keys, "year", euros("net_c").alias("net"), euros("bought_c").alias("bought"), euros("sold_c").alias("sold"),
        "count", "months", euros(F.coalesce("avg_c", F.lit(0))).alias("avg_per_month"),
    )


def investment_avg12(L: Ledger, named: DataFrame, today: dt.date) -> DataFrame:
    """Average of the last twelve months over covered months only, per broker, and added up."""
    now = month_of(today.year, today.month)
    recent = _months(L, named, today, True).filter(
        (F.col("month_index") > now - 12) & (F.col("month_index") <= now) & F.col("covered")
    )
    per = recent.groupBy(*L.on("broker")).agg(F.sum("net_c").alias("n"), F.count("*").alias("m"))
    per = per.withColumn("avg_c", half_up("n", F.col("m")))
    whole = per.groupBy(*L.keys).agg(F.sum("avg_c").alias("avg_c")).withColumn("broker", F.lit("(all)"))
    return per.select(*L.keys, "broker", "avg_c").unionByName(whole.select(*L.keys, "broker", "avg_c")).select(
        *L.keys, "broker", euros("avg_c").alias("avg_per_month_12")
    )


def instrument_totals(L: Ledger, named: DataFrame) -> DataFrame:
    """Per instrument: a fund the booking names is one thing however its name is written, the rest goes by name."""
    own = L.on("thing")
    thing = F.coalesce(F.col("code"), F.concat(F.lit("name:"), F.col("instrument")))
    rows = named.withColumn("thing", thing).groupBy(*own, "instrument", "broker").agg(
        F.first("code", ignorenulls=True).alias("code"), F.sum("amount_c").alias("net_c"), F.count("*").alias("n"),
        F.count_if(F.col("amount_c") > 0).alias("buys"), F.min("date").alias("first"), F.max("date").alias("last"),
        F.collect_set(E.month_index("date")).alias("months"),
    )
    names = rows.groupBy(*own, "instrument").agg(F.sum("n").alias("n"), F.min("first").alias("f"))
    names = names.groupBy(*own).agg(F.min_by("instrument", F.struct((-F.col("n")).alias("n"), "f", "instrument")).alias("name"))
    brokers = F.transform(
        F.sort_array(F.collect_set(F.struct(E.broker_rank("broker").alias("r"), "broker"))), lambda s: s["broker"]
    )
    whole = rows.groupBy(*own).agg(
        F.first("code", ignorenulls=True).alias("code"), F.sum("net_c").alias("net_c"), F.sum("buys").alias("buys"),
        F.min("first").alias("first"), F.max("last").alias("last"),
        F.size(F.array_distinct(F.flatten(F.collect_set("months")))).cast("bigint").alias("active"),
        F.array_join(brokers, ", ").alias("brokers"),
    )
    total = F.sum("net_c").over(W.partitionBy(*L.keys))
    whole = whole.join(names, own).withColumn("total_c", total)
    rank = F.when(F.col("name") == MANUAL, 1).when(F.col("name") == UNKNOWN, 2).otherwise(0)
    size = half_up(F.col("net_c") * F.signum("total_c").cast("bigint") * 1000, F.abs("total_c"))
    return whole.orderBy(*L.keys, rank, F.col("net_c").desc(), "thing").select(
        *L.keys, "code", "name", euros("net_c").alias("net"),
        F.when(F.col("total_c") != 0, size / 10.0).otherwise(0.0).alias("share_pct"), "buys", "first", "last",
        euros(half_up("net_c", F.col("active"))).alias("per_month"), "brokers",
    )


def investment_totals(L: Ledger, named: DataFrame, today: dt.date) -> DataFrame:
    c, kind = F.col("amount_c"), F.col("instrument")
    sums = named.groupBy(*L.keys).agg(
        euros(F.sum(c)).alias("net"), euros(_sum_if(c > 0)).alias("bought"),
        euros(F.coalesce(F.sum(F.when(c < 0, -c)), F.lit(0))).alias("sold"),
        euros(_sum_if(F.year("date") == today.year)).alias("this_year"), F.count("*").alias("bookings"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        euros(_sum_if(kind == UNKNOWN)).alias("unknown_net"), F.count_if(kind == UNKNOWN).alias("unknown_count"),
        euros(_sum_if(kind == MANUAL)).alias("manual_net"), F.count_if(kind == MANUAL).alias("manual_count"),
    )
    months = _months(L, named, today, False).groupBy(*L.keys).agg(F.count_if("covered").alias("months_with_statement"))
    return sums.join(months, list(L.keys))


def known_instruments(L: Ledger) -> DataFrame:
    """Names to offer when typing what a booking was."""
    names = L.plans.select(*L.keys, "instrument").union(L.splits.select(*L.keys, "instrument")).distinct()
    return names.orderBy(*L.keys, F.lower("instrument"), "instrument")
