"""Batches of household decisions applied to the tables: stock, receipts, categories, plans, labels, rules.

Every function returns the next version of the tables it touches; what cannot be applied comes back with a reason.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..functions import exprs as E
from ..schema import (
    BROKERS, LEGACY_BANK_TO_KEY, LEGACY_ITEM_TO_KEY, MANUAL_REASON, NO_CATEGORY_KINDS, NOT_STOCK, UNCATEGORIZED,
    WASTE_STATUS, Ledger,
)
from ..sources.scratch import written
from .base import sorted_fold, top_k
from .finders import bookings
from .links import last_changes, patched
from .quality import validate_category
from .stock import with_stock_group
from .subscriptions import FREQUENCIES

FREEZER_DAYS = 90
STATE = (
    "status string, quantity_left double, wasted_quantity double, wasted_on date, waste_reason string, opened_on date, "
    "finished_on date, location string, rating int, would_rebuy boolean, storage_condition string, date_expiry date"
)
STATE_COLUMNS = [part.strip().split(" ")[0] for part in STATE.split(",")]


# ---- stock ---------------------------------------------------------------------------------------------
# An event is first turned into what it asks for, in columns: what speaks against it whatever the stock, what it needs of the stock, and
# what it sets or removes. The fold then knows nothing of actions: it weighs the request against the state and books it.
ALL_OF_IT = 1e300
REQUEST = (
    "day date, early string, late string, wants_stock boolean, chills boolean, opens boolean, moves boolean, removes double, is_waste boolean, "
    "why string, new_location string, new_date_expiry date, new_rating int, new_would_rebuy boolean"
)


def stock_requests(events: DataFrame, keep: list[str]) -> DataFrame:
    """keep and the REQUEST columns of stock events (day, action, amount, reason, location, date_expiry, rating, would_rebuy)."""
    action, amount = F.col("action"), F.col("amount")
    update, discard = action == "update", action == "discard"
    taken = F.when(action == "use", F.coalesce(amount, F.lit(1.0))).when(discard, F.coalesce(amount, F.lit(ALL_OF_IT))).when(action == "finish", F.lit(ALL_OF_IT))
    gift = F.col("reason").eqNullSafe("gave_away")
    early = F.when(update & ~F.col("rating").between(1, 5), "rating_out_of_range").when(
        discard & ~gift & ~F.coalesce(F.col("reason").isin(*WASTE_STATUS), F.lit(False)), "unknown_reason")
    late = F.when((action == "use") & (taken <= 0), "amount_not_positive").when(discard & (taken <= 0), "nothing_to_remove").when(
        ~F.coalesce(action.isin("update", "open", "freeze", "use", "finish", "discard"), F.lit(False)), "unknown_action")
    only = lambda test, c: F.when(test, F.col(c))
    columns = {
        "day": F.col("day"), "early": early, "late": late, "wants_stock": ~F.coalesce(update, F.lit(False)), "chills": action.eqNullSafe("freeze"),
        "opens": action.eqNullSafe("open"), "moves": F.coalesce(update & F.col("location").isNotNull(), F.lit(False)), "removes": taken, "is_waste": discard & ~gift,
        "why": only(discard, "reason"), "new_location": F.when(update, F.nullif(F.trim("location"), F.lit(""))),
        "new_date_expiry": F.when(update, F.col("date_expiry")).when(action == "freeze", F.date_add("day", FREEZER_DAYS)),
        "new_rating": only(update, "rating"), "new_would_rebuy": only(update, "would_rebuy"),
    }
    return events.select(*keep, *[c.cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(REQUEST) for c in [columns[f.name]]])


def stock_step(state: dict, request: dict) -> str | None:
    """Books a request on the state of one item; returns what speaks against it, or None."""
    left, chills = state["quantity_left"], request["chills"]
    problem = (
        request["early"] or ("nothing_left" if request["wants_stock"] and left <= 0 else None) or request["late"]
        or ("only_food_can_be_frozen" if chills and not state["is_food"] else None)
        or ("already_frozen" if chills and state["storage_condition"] == "Frozen" else None)
    )
    if problem:
        return problem
    for c in ("date_expiry", "rating", "would_rebuy"):
        if request[f"new_{c}"] is not None:
            state[c] = request[f"new_{c}"]
    if request["chills"] or request["moves"]:
        state["location"] = request["new_location"]
    if request["chills"]:
        state["storage_condition"], state["opened_on"] = "Frozen", None
    if request["opens"] and state["opened_on"] is None:
        state["opened_on"] = request["day"]
    if request["removes"] is not None:
        _take(state, min(request["removes"], state["quantity_left"]), request)
    return None


def _take(state: dict, amount: float, request: dict) -> None:
    rest = state["quantity_left"] - amount
    state["quantity_left"] = rest if rest > 0 else 0.0
    if request["why"]:
        state["waste_reason"] = request["why"]
    if request["is_waste"]:
        state["wasted_quantity"] += amount
        state["wasted_on"] = request["day"]
    if not state["quantity_left"]:
        state["finished_on"] = request["day"]
        state["status"] = WASTE_STATUS.get(state["waste_reason"], "Discarded") if state["wasted_quantity"] > 0 else "Consumed"


class _StockFold:
    """Row 0 is the item, the rest its events in order."""

    def __init__(self):
        self.state = None

    def row(self, r: dict):
        if r["event_id"] is None:
            self.state = {c: r[c] for c in STATE_COLUMNS}
            self.state["is_food"] = r["is_food"]
            return ()
        problem = "no_such_item" if self.state is None else stock_step(self.state, r)
        if problem:
            return [(int(r["event_id"]), problem, *[None] * len(STATE_COLUMNS))]
        return ()

    def end(self):
        if self.state is None:
            return ()
        return [(None, None, *[self.state[c] for c in STATE_COLUMNS])]


MANY_EVENTS = 1000  # items with more are folded row by row, the others in one expression


def _stock_base(L: Ledger) -> DataFrame:
    stock = L.items.filter(F.col("spend_category").isNull() | ~F.col("spend_category").isin(*NOT_STOCK))
    left = F.coalesce("quantity_left", F.col("quantity").cast("double"), F.lit(1.0))
    base = with_stock_group(stock, L).withColumn("item_id", F.col("id")).withColumn("quantity_left", left)
    return base.withColumn("wasted_quantity", F.coalesce("wasted_quantity", F.lit(0.0))).select(*L.on("item_id"), "is_food", *STATE_COLUMNS)


def stock_event_rows(L: Ledger, events: DataFrame) -> DataFrame:
    """Items that have events (as row 0) and their events, in one frame with one key."""
    own = L.on("item_id")
    base = _stock_base(L).join(events.select(*own).distinct(), own, "left_semi")
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(REQUEST).fields]
    rows = base.select(*own, F.lit(0).alias("step"), F.lit(None).cast("timestamp").alias("ts"), F.lit(None).cast("bigint").alias("event_id"), *blank, "is_food", *STATE_COLUMNS)
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(STATE).fields]
    asked = stock_requests(events.withColumn("step", F.lit(1)), [*own, "step", "ts", "event_id"])
    return rows.unionByName(asked.select("*", F.lit(None).cast("boolean").alias("is_food"), *none))


def _stock_step(state: Column, request: Column) -> Column:
    """`stock_step` as an expression: the state after the request, with `refused` longer by one where something speaks against it."""
    s, r = (lambda c: state[c]), (lambda c: request[c])
    chills = r("chills")
    against = F.coalesce(
        r("early"), F.when(r("wants_stock") & (s("quantity_left") <= 0), "nothing_left"), r("late"),
        F.when(chills & ~s("is_food"), "only_food_can_be_frozen"), F.when(chills & (s("storage_condition") == "Frozen"), "already_frozen"),
    )
    takes = r("removes").isNotNull()
    amount = F.when(s("quantity_left") < r("removes"), s("quantity_left")).otherwise(r("removes"))
    left = F.when(takes, F.greatest(s("quantity_left") - amount, F.lit(0.0))).otherwise(s("quantity_left"))
    why = F.when(takes & (F.length(r("why")) > 0), r("why")).otherwise(s("waste_reason"))
    wastes = takes & F.coalesce(r("is_waste"), F.lit(False))
    wasted = F.when(wastes, s("wasted_quantity") + amount).otherwise(s("wasted_quantity"))
    ends = takes & (left == 0)
    new = {
        "status": F.when(ends, F.when(wasted > 0, E.literal_map(why, WASTE_STATUS, "Discarded")).otherwise("Consumed")).otherwise(s("status")),
        "quantity_left": left, "wasted_quantity": wasted, "wasted_on": F.when(wastes, r("day")).otherwise(s("wasted_on")), "waste_reason": why,
        "opened_on": F.when(chills, F.lit(None)).when(r("opens"), F.coalesce(s("opened_on"), r("day"))).otherwise(s("opened_on")),
        "finished_on": F.when(ends, r("day")).otherwise(s("finished_on")),
        "location": F.when(chills | r("moves"), r("new_location")).otherwise(s("location")),
        "storage_condition": F.when(chills, "Frozen").otherwise(s("storage_condition")),
        **{c: F.coalesce(r(f"new_{c}"), s(c)) for c in ("rating", "would_rebuy", "date_expiry")},
    }
    refused = F.when(against.isNull(), s("refused")).otherwise(F.concat(s("refused"), F.array(_refusal(r("event_id"), against))))
    kept = [F.when(against.isNull(), new[f.name]).otherwise(s(f.name)).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(STATE)]
    return F.struct(*kept, s("is_food").alias("is_food"), refused.alias("refused"))


def _refusal(event_id: Column, problem: Column) -> Column:
    return F.struct(event_id.cast("bigint").alias("event_id"), problem.cast("string").alias("problem"))


def _stock_in_one(L: Ledger, events: DataFrame) -> DataFrame:
    """own, state (null: no such item) and refused of items with few events; Spark brings an item's events together and folds them in order."""
    own = L.on("item_id")
    asked = stock_requests(events, [*own, "ts", "event_id"])
    listed = asked.groupBy(*own).agg(F.sort_array(F.collect_list(F.struct(*[c for c in asked.columns if c not in own]))).alias("_events"))
    base = _stock_base(L).groupBy(*own).agg(F.max(F.struct(*STATE_COLUMNS, "is_food")).alias("_item"))  # an item that is there twice is one
    none = F.array().cast("array<struct<event_id: bigint, problem: string>>")
    fields = [F.col(f"_item.{f.name}").cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(STATE)]
    start = F.struct(*fields, F.col("_item.is_food").alias("is_food"), none.alias("refused"))
    after = F.aggregate("_events", start, _stock_step)
    lost = F.transform("_events", lambda r: _refusal(r["event_id"], F.lit("no_such_item")))
    out = listed.join(base, own, "left").withColumn("state", F.when(F.col("_item").isNotNull(), after))
    return out.select(*own, "state", F.coalesce(F.col("state.refused"), lost).alias("refused"))


def apply_stock_events(L: Ledger, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """events: keys, item_id, event_id, ts, day, action, amount, reason, location, date_expiry, rating, would_rebuy.

    Per item in order of (ts, event_id). Returns the next items table and the refused events with the reason.
    Only items that have events are looked at.
    """
    own = L.on("item_id")
    events = events.filter(F.col("event_id").isNotNull())
    many = written(events.groupBy(*own).count().filter(F.col("count") > MANY_EVENTS).select(*own))
    hot = not many.isEmpty()
    out = written(_stock_in_one(L, events.join(many, own, "left_anti") if hot else events))
    rejected = out.select(*own, F.explode("refused").alias("_r")).select(*own, "_r.event_id", "_r.problem")
    states = out.filter(F.col("state").isNotNull()).select(*own, *[f"state.{c}" for c in STATE_COLUMNS])
    if hot:
        rows = stock_event_rows(L, events.join(many, own, "left_semi"))
        schema = T.StructType([T.StructField(c, rows.schema[c].dataType) for c in own] + T.StructType.fromDDL("event_id bigint, problem string, " + STATE).fields)
        folded = written(sorted_fold(rows, own, ["step", "ts", "event_id"], _StockFold, schema))
        rejected = rejected.unionByName(folded.filter(F.col("problem").isNotNull()).select(*own, "event_id", "problem"))
        states = states.unionByName(folded.filter(F.col("event_id").isNull()).select(*own, *STATE_COLUMNS))
    return patched(L.items, states.withColumnRenamed("item_id", "id"), L.on("id"), STATE_COLUMNS), rejected


# ---- receipts and statements ---------------------------------------------------------------------------
def confirm_receipts(L: Ledger, fixes: DataFrame) -> Ledger:
    """fixes: receipt_id, purchase_date (null keeps it). A corrected date moves the lines and their expiry along."""
    days = F.max("purchase_date").alias("_day")  # of several fixes of a receipt the latest day holds
    f = fixes.groupBy(*L.keys, F.col("receipt_id").alias("id")).agg(days, F.lit(True).alias("_fix"))
    rc = L.receipts.join(f, L.on("id"), "left")
    shift = rc.filter(F.col("_day").isNotNull() & (F.col("_day") != F.col("purchase_date"))).select(
        *L.keys, F.col("id").alias("receipt_id"), "_day", F.datediff("_day", "purchase_date").alias("_shift")
    )
    rc = rc.withColumn("purchase_date", F.coalesce("_day", "purchase_date"))
    rc = rc.withColumn("status", F.when(F.col("_fix"), "ok").otherwise(F.col("status"))).select(*L.receipts.columns)
    items = L.items.join(shift, L.on("receipt_id"), "left")
    items = items.withColumn("date_purchased", F.coalesce("_day", "date_purchased")).withColumn(
        "date_expiry", F.when(F.col("_shift").isNotNull(), F.date_add("date_expiry", F.col("_shift"))).otherwise(F.col("date_expiry"))
    )
    return L.with_(receipts=rc, items=items.select(*L.items.columns))


def remove_receipts(L: Ledger, ids: DataFrame) -> Ledger:
    """ids: keys, id. Lines and questions go, the bank booking stays and is free again."""
    gone = ids.select(*L.keys, F.col("id").alias("receipt_id")).distinct()
    free = gone.withColumn("_gone", F.lit(True))
    tx = L.bookings.join(free, L.on("receipt_id"), "left")
    hit = F.col("_gone").isNotNull()
    for c in ("receipt_id", "link_status", "link_reason"):
        tx = tx.withColumn(f"_{c}", F.when(~hit, F.col(c)))
    tx = tx.select(*[F.col(f"_{c}").alias(c) if c in ("receipt_id", "link_status", "link_reason") else F.col(c) for c in L.bookings.columns])
    return L.with_(
        bookings=tx, items=L.items.join(gone, L.on("receipt_id"), "left_anti").select(*L.items.columns),
        receipts=L.receipts.join(gone.withColumnRenamed("receipt_id", "id"), L.on("id"), "left_anti"),
        questions=L.questions.join(gone, L.on("receipt_id"), "left_anti").select(*L.questions.columns),
    )


def remove_statements(L: Ledger, ids: DataFrame) -> Ledger:
    """ids: keys, id. Bookings and questions go; receipts, mirrors and transfer partners that pointed there are free."""
    st = ids.select(*L.keys, F.col("id").alias("statement_id")).distinct()
    gone = written(L.bookings.join(st, L.on("statement_id"), "left_semi").select(*L.keys, "id", "receipt_id", "transfer_group"))
    tx = L.bookings.join(st, L.on("statement_id"), "left_anti")
    mirror = gone.select(*L.keys, F.col("id").alias("mirror_of"), F.lit(True).alias("_m"))
    group = gone.filter(F.col("transfer_group").isNotNull()).select(*L.keys, "transfer_group", F.lit(True).alias("_g")).distinct()
    tx = tx.join(mirror, L.on("mirror_of"), "left").join(group, L.on("transfer_group"), "left")
    m, g = F.col("_m").isNotNull(), F.col("_g").isNotNull()
    clear = {"mirror_of": m, "transfer_group": g, "link_status": m | g, "link_reason": m | g}
    tx = tx.select(*[F.when(~clear[c], F.col(c)).alias(c) if c in clear else F.col(c) for c in L.bookings.columns])
    free = gone.filter(F.col("receipt_id").isNotNull()).select(*L.keys, F.col("receipt_id").alias("id"), F.lit(False).alias("linked")).distinct()
    q = L.questions
    for c in ("transaction_id", "other_transaction_id"):
        q = q.join(gone.select(*L.keys, F.col("id").alias(c)), L.on(c), "left_anti")
    return L.with_(
        statements=L.statements.join(st.withColumnRenamed("statement_id", "id"), L.on("id"), "left_anti"), bookings=tx,
        receipts=patched(L.receipts, free, L.on("id"), ["linked"]), questions=q.select(*L.questions.columns),
    )


# ---- categories ----------------------------------------------------------------------------------------
def category_usage(L: Ledger) -> DataFrame:
    """How often each category is used, entries without one included (one stacked pass, one shuffle)."""
    stacked = L.items.select(*L.keys, F.col("spend_category").alias("key"), F.lit(1).alias("i"), F.lit(0).alias("t")).unionByName(
        L.bookings.select(*L.keys, F.col("category").alias("key"), F.lit(0).alias("i"), F.lit(1).alias("t"))
    )
    return stacked.groupBy(*L.keys, "key").agg(F.sum("i").alias("items"), F.sum("t").alias("transactions"))


def remap_categories(L: Ledger, mapping: DataFrame) -> tuple[Ledger, DataFrame]:
    """mapping: source, target (null deletes). Same flow only; entries move, the pantry category follows."""
    has = [k for k in L.keys if k in L.categories.columns]
    cat = L.categories.select(*has, F.col("key").alias("_k"), F.col("flow").alias("_f"))
    m = mapping.join(cat.select(*has, F.col("_k").alias("source"), F.col("_f").alias("_sf")), [*has, "source"], "left")
    m = m.join(cat.select(*has, F.col("_k").alias("target"), F.col("_f").alias("_tf")), [*has, "target"], "left")
    problem = (
        F.when(F.col("_sf").isNull(), "unknown_category").when(F.col("target").isNull(), F.lit(None))
        .when(F.col("_tf").isNull() | (F.col("source") == F.col("target")), "pick_two_different").when(F.col("_sf") != F.col("_tf"), "different_flow")
    )
    m = written(m.withColumn("problem", problem))
    good, late = last_changes(m.filter(F.col("problem").isNull()).select(*has, "source", "target"), [*has, "source"], [])
    good = good.select(*has, "source", F.col("target").alias("_to"), F.lit(True).alias("_hit"))

    def moved(df: DataFrame, column: str) -> DataFrame:
        on = [k for k in has]
        j = df.join(good.withColumnRenamed("source", column), [*on, column], "left")
        return j.withColumn("_new", F.when(F.col("_hit"), F.col("_to")).otherwise(F.col(column)))

    items = moved(L.items, "spend_category")
    items = items.withColumn("category", F.when(F.col("_hit"), E.legacy_category("_new")).otherwise(F.col("category")))
    items = items.withColumn("spend_category", F.col("_new")).select(*L.items.columns)
    tx = moved(L.bookings, "category").withColumn("category", F.col("_new")).select(*L.bookings.columns)
    cats = L.categories.join(good.select(*has, F.col("source").alias("key")), [*has, "key"], "left_anti").select(*L.categories.columns)
    refused = m.filter(F.col("problem").isNotNull()).select(*has, "source", "target", "problem")
    return L.with_(items=items, bookings=tx, categories=cats), refused.unionByName(late.withColumn("problem", F.lit("mapped_again")))


def upsert_categories(cats: DataFrame, changes: DataFrame, keys: tuple = ()) -> tuple[DataFrame, DataFrame]:
    """changes: change_id, key (null: made from the label), label, group_name, flow, fixed, description, active, update.

    New keys get the next sort orders; the flow of a category never changes; duplicates are refused.
    `keys`: the tenant columns, when every household has its own list.
    """
    own = [*keys, "key"]
    named = changes.withColumn("key", F.when(F.col("update"), F.col("key")).otherwise(E.slugify(F.coalesce("key", "label"))))
    old = cats.select(*own, F.col("flow").alias("_flow"), F.lit(True).alias("_known"))
    rows = named.join(old, own, "left")
    nth = F.row_number().over(W.partitionBy(*own, "update").orderBy("change_id"))
    rows = rows.withColumn("_nth", nth)
    blank = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    problem = (
        F.when(F.col("update") & F.col("_known").isNull(), "unknown_category")
        .when(F.col("update") & (F.col("flow") != F.col("_flow")), "flow_cannot_change")
        .when(~F.col("update") & ~F.coalesce(F.col("flow").isin("expense", "income"), F.lit(False)), "unknown_flow")
        .when(~F.col("update") & (blank("label") | blank("group_name")), "needs_name_and_group")
        .when(~F.col("update") & ((F.col("key") == UNCATEGORIZED) | F.col("_known").isNotNull() | (F.col("_nth") > 1)), "already_exists")
    )
    rows = written(rows.withColumn("problem", problem))
    good = rows.filter(F.col("problem").isNull())
    fields = ["label", "group_name", "description", "fixed", "active"]
    # The latest word on each field wins.
    latest = good.filter("update").groupBy(*own).agg(*[
        F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("change_id"))).alias(f"_{c}") for c in fields
    ])
    kept = cats.join(latest, own, "left").select(*[F.coalesce(f"_{c}", F.col(c)).alias(c) if c in fields else F.col(c) for c in cats.columns])
    # Old rows first, then the new ones of a list in order: the running maximum is where the new ones start.
    start = cats.select(*own, F.lit(None).cast("bigint").alias("change_id"), F.col("sort_order").alias("_order")).unionByName(
        good.filter(~F.col("update")).select(*own, "change_id", F.lit(None).cast("int").alias("_order"))
    )
    listed = W.partitionBy(*keys).orderBy(F.col("change_id").asc_nulls_first(), "key").rowsBetween(W.unboundedPreceding, 0)
    start = start.withColumn("_top", F.coalesce(F.max("_order").over(listed), F.lit(0))).withColumn(
        "_n", F.count("change_id").over(listed)
    ).filter(F.col("change_id").isNotNull()).select(*own, "change_id", "_top", "_n")
    new = good.filter(~F.col("update")).join(start, [*own, "change_id"]).select(
        *own, F.trim("label").alias("label"), F.trim("group_name").alias("group_name"), "flow", F.coalesce("fixed", F.lit(False)).alias("fixed"),
        F.trim("description").alias("description"), (F.col("_top") + F.col("_n") * 10).cast("int").alias("sort_order"), F.lit(True).alias("active"),
    )
    return kept.unionByName(new.select(*cats.columns)), rows.filter(F.col("problem").isNotNull()).select(*own, "change_id", "problem")


def apply_category_changes(L: Ledger, changes: DataFrame) -> tuple[Ledger, DataFrame]:
    """changes: ref ('i12' receipt line, 't45' booking), category, and change_id where an entry may change more than once.

    The last change of an entry holds (by change_id, else the last category in order); the others and the refused ones come back.
    """
    one = changes.withColumn("_kind", F.substring("ref", 1, 1)).withColumn(
        "id", F.when(F.col("ref").rlike("^.-?[0-9]{1,19}$"), F.expr("try_cast(substring(ref, 2) AS bigint)")))
    items = L.items.select(*L.keys, "id", F.lit("i").alias("_kind"), F.lit("expense").alias("_flow_of"), F.lit(False).alias("_free"))
    tx = L.bookings.select(*L.keys, "id", F.lit("t").alias("_kind"), E.entry_flow("kind", "amount_c").alias("_flow_of"), F.col("kind").isin(*NO_CATEGORY_KINDS).alias("_free"))
    rows = one.join(items.unionByName(tx), L.on("_kind", "id"), "left")
    rows = validate_category(rows, L, "category", F.col("_flow_of"))
    problem = (
        F.when(F.col("id").isNull() | (F.col("_kind") == ""), "not_a_reference").when(F.col("_flow_of").isNull(), "no_such_entry")
        .when(F.col("_free"), "transfers_and_investments_have_none").otherwise(F.col("category_problem"))
    )
    rows = written(rows.withColumn("problem", problem))
    order = [c for c in ("change_id",) if c in changes.columns]
    good, late = last_changes(rows.filter(F.col("problem").isNull()), L.on("_kind", "id"), order)
    to_items = good.filter(F.col("_kind") == "i").select(*L.keys, "id", F.col("category").alias("spend_category"), E.legacy_category("category").alias("category"))
    to_tx = good.filter(F.col("_kind") == "t").select(*L.keys, "id", "category")
    out = L.with_(items=patched(L.items, to_items, L.on("id"), ["spend_category", "category"]), bookings=patched(L.bookings, to_tx, L.on("id"), ["category"]))
    refused = rows.filter(F.col("problem").isNotNull()).unionByName(late.withColumn("problem", F.lit("changed_again")))
    return out, refused.select(*L.keys, "ref", "category", "problem")


def backfill_categories(L: Ledger) -> Ledger:
    """Old keys to the present list; what still is ALL CAPS is left empty, fees and cash get their default."""
    items = L.items.withColumn("spend_category", F.coalesce(E.literal_map("category", LEGACY_ITEM_TO_KEY), "spend_category"))
    new = F.coalesce(E.literal_map("category", LEGACY_BANK_TO_KEY), "category")
    tx = L.bookings.withColumn("category", new)
    tx = tx.withColumn("category", F.when(F.col("category") != F.upper("category"), F.col("category")))
    tx = tx.withColumn("category", F.coalesce("category", E.default_category("kind")))
    return L.with_(items=items, bookings=tx)


def backfill_stock(items: DataFrame) -> DataFrame:
    """Stock columns from the old status: available is all there, thrown away was all of it."""
    wasted = F.col("status").isin("Spoiled", "Discarded")
    over = wasted | (F.col("status") == "Consumed")
    return (
        items.withColumn("quantity_left", F.when(F.col("status") == "Available", F.col("quantity").cast("double")).otherwise(0.0))
        .withColumn("wasted_quantity", F.when(wasted, F.col("quantity").cast("double")).otherwise(F.col("wasted_quantity")))
        .withColumn("wasted_on", F.when(wasted, F.col("date_purchased")).otherwise(F.col("wasted_on")))
        .withColumn("finished_on", F.when(over, F.col("date_purchased")).otherwise(F.col("finished_on")))
        .withColumn("waste_reason", F.when(F.col("status") == "Spoiled", "spoiled").when(wasted, "other").otherwise(F.col("waste_reason")))
    )


# ---- investments ---------------------------------------------------------------------------------------
def apply_kind_changes(L: Ledger, changes: DataFrame) -> tuple[Ledger, DataFrame]:
    """changes: transaction_id, kind. Between investment and own transfer, and back only what was moved by hand."""
    tx = bookings(L).select(*L.keys, F.col("id").alias("transaction_id"), "bank", F.col("kind").alias("_kind"), "transfer_group", "link_reason")
    rows = changes.join(tx, L.on("transaction_id"), "left")
    by_hand = (F.col("_kind") == "internal_transfer") & F.col("transfer_group").isNull() & F.col("link_reason").eqNullSafe(MANUAL_REASON)
    problem = (
        F.when(F.col("_kind").isNull(), "no_booking").when(~F.col("bank").isin(*BROKERS), "not_a_broker")
        .when((F.col("kind") == "internal_transfer") & (F.col("_kind") != "investment"), "not_an_investment")
        .when((F.col("kind") == "investment") & ~by_hand, "not_moved_by_hand")
        .when(~F.col("kind").isin("investment", "internal_transfer"), "unknown_kind")
    )
    rows = written(rows.withColumn("problem", problem))
    out = F.col("kind") == "internal_transfer"
    good, late = last_changes(rows.filter(F.col("problem").isNull()), L.on("transaction_id"), [c for c in ("change_id",) if c in changes.columns])
    change = good.select(
        *L.keys, F.col("transaction_id").alias("id"), "kind", F.when(out, "confirmed").alias("link_status"), F.when(out, MANUAL_REASON).alias("link_reason"))
    df = patched(L.bookings, change, L.on("id"), ["kind", "link_status", "link_reason"])
    df = df.withColumn("category", F.when(~F.col("kind").isin("internal_transfer") | (F.coalesce("link_reason", F.lit("")) != MANUAL_REASON), F.col("category")))
    refused = rows.filter(F.col("problem").isNotNull()).unionByName(late.withColumn("problem", F.lit("changed_again")))
    return L.with_(bookings=df), refused.select(*L.keys, "transaction_id", "kind", "problem")


def apply_instrument_labels(L: Ledger, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """labels: transaction_id, instrument (null forgets), ts. Returns the next splits table and the refused labels."""
    tx = bookings(L).select(*L.keys, F.col("id").alias("transaction_id"), "bank", "kind", (-F.col("amount_c")).alias("_c"), "booking_date", "description")
    rows = labels.join(tx, L.on("transaction_id"), "left").withColumn("_name", E.collapse_space("instrument"))
    allowed = F.coalesce(F.col("bank").isin(*BROKERS) & (F.col("kind") == "investment"), F.lit(False))
    problem = F.when(F.col("kind").isNull(), "no_booking").when(~allowed, "not_an_investment").when(F.col("instrument").isNotNull() & (F.col("_name") == ""), "type_what_it_was")
    rows = rows.withColumn("problem", problem).withColumn("ref", E.booking_ref("bank", "booking_date", "_c", "description"))
    rows = written(rows)
    good = top_k(rows.filter(F.col("problem").isNull()), L.on("ref"), [F.col("ts").desc(), F.col("transaction_id").desc()], 1)
    kept = L.splits.join(good.select(*L.keys, F.col("ref").alias("booking_ref")), L.on("booking_ref"), "left_anti")
    new = good.filter(F.col("instrument").isNotNull()).select(
        *L.keys, F.xxhash64(*L.keys, "ref").alias("id"), F.col("ref").alias("booking_ref"), F.col("_name").alias("instrument"), F.col("_c").alias("amount_c"))
    return kept.select(*L.splits.columns).unionByName(new), rows.filter(F.col("problem").isNotNull()).select(*L.keys, "transaction_id", "problem")


def apply_rule_changes(L: Ledger, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """changes: key, frequency, hidden, ts. The latest word per payee; neither frequency nor hidden removes the rule."""
    bad = F.coalesce(~F.col("frequency").isin(*FREQUENCIES), F.lit(False))
    last = top_k(changes.filter(~bad), L.on("key"), [F.col(c).desc_nulls_last() for c in ("ts", "hidden", "frequency")], 1)
    kept = L.rules.join(last.select(*L.on("key")), L.on("key"), "left_anti")
    new = last.filter(F.col("frequency").isNotNull() | F.col("hidden")).select(*L.on("key"), "frequency", "hidden")
    return kept.select(*L.rules.columns).unionByName(new), changes.filter(bad).select(*L.on("key"), "frequency", F.lit("unknown_frequency").alias("problem"))


# ---- savings plans -------------------------------------------------------------------------------------
PLAN = "broker string, instrument string, amount_c bigint, frequency string, anchor_date date, start_date date, end_date date, note string"
PLAN_COLUMNS = [part.strip().split(" ")[0] for part in PLAN.split(",")]


GIVEN = {"correct": PLAN_COLUMNS, "change": ["amount_c", "instrument", "frequency", "anchor_date"], "create": PLAN_COLUMNS}


def plan_requests(changes: DataFrame, keep: list[str]) -> DataFrame:
    """keep, action, on_date, form (what is wrong with the request by itself) and new_ plan fields: only those the action may set."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    create = F.col("action") == "create"
    may = {c: F.coalesce(F.col("action").isin(*[a for a, columns in GIVEN.items() if c in columns]), F.lit(False)) for c in PLAN_COLUMNS}
    needed = lambda c: may[c] & (create | F.col(c).isNotNull())
    known = lambda c, values: F.coalesce(F.col(c).isin(*values), F.lit(False))
    form = (
        F.when(needed("broker") & ~known("broker", BROKERS), "unknown_broker").when(needed("instrument") & blank("instrument").isNull(), "no_instrument")
        .when(needed("amount_c") & ~F.coalesce(F.col("amount_c") > 0, F.lit(False)), "amount_not_positive")
        .when(needed("frequency") & ~known("frequency", ("weekly", "biweekly", "monthly")), "unknown_frequency")
        .when(create & (F.col("end_date") < F.col("start_date")), "ends_before_it_starts")
        .when(~F.coalesce(F.col("action").isin("create", "correct", "suspend", "resume", "change", "delete"), F.lit(False)), "unknown_action")
    )
    tidy = {c: blank(c) if c in ("instrument", "note") else F.col(c) for c in PLAN_COLUMNS}
    return changes.select(*keep, "action", "on_date", form.alias("form"), *[F.when(may[c], tidy[c]).alias(f"new_{c}") for c in PLAN_COLUMNS])


def _over(plan: dict, day: dt.date) -> bool:
    return plan["end_date"] is not None and plan["end_date"] < day


def _begun(plan: dict, day: dt.date) -> bool:
    """Whether the plan runs, or has run, on the day before."""
    return plan["start_date"] is None or plan["start_date"] < day


#: What speaks against an action on the day, first come first named.
AGAINST = {
    "suspend": {"already_ended": _over, "not_started": lambda plan, day: not _begun(plan, day)},
    "resume": {"not_ended": lambda plan, day: not (_over(plan, day) and _begun(plan, day + dt.timedelta(days=1)))},
    "change": {"pick_a_later_day": lambda plan, day: not _begun(plan, day), "already_ended": _over},
}


class _PlanFold:
    """A plan as an interval of days with its terms. Row 0 is the plan, the rest its changes in order.

    Emits (change_id, problem, plan fields): the plan as it ends up has no change_id, plans opened by a change carry it, refused changes
    carry it with the problem.
    """

    def __init__(self):
        self.plan = None

    def _refused(self, r: dict) -> str | None:
        if r["action"] != "create" and self.plan is None:
            return "no_plan"
        tests = AGAINST.get(r["action"], {})
        return next((name for name, test in tests.items() if test(self.plan, r["on_date"])), None) or r["form"]

    def row(self, r: dict):
        terms = {c: r[f"new_{c}"] for c in PLAN_COLUMNS if r[f"new_{c}"] is not None}
        if r["change_id"] is None:
            self.plan = {c: r[c] for c in PLAN_COLUMNS}
            return ()
        change, problem, opened = int(r["change_id"]), self._refused(r), None
        if problem is None and r["action"] == "create":
            opened = dict.fromkeys(PLAN_COLUMNS) | terms
        elif problem is None and r["action"] == "correct":
            fixed = self.plan | terms
            if fixed["start_date"] and _over(fixed, fixed["start_date"]):
                problem = "ends_before_it_starts"
            else:
                self.plan = fixed
        elif problem is None:
            if r["action"] in ("resume", "change"):
                other_rhythm = terms.get("frequency", self.plan["frequency"]) != self.plan["frequency"]
                opened = self.plan | ({"anchor_date": None} if other_rhythm else {}) | terms | {"start_date": r["on_date"], "end_date": None}
            if r["action"] in ("suspend", "change"):
                self.plan["end_date"] = r["on_date"] - dt.timedelta(days=1)
            if r["action"] == "delete":
                self.plan = None
        shown = [opened[c] if opened and not problem else None for c in PLAN_COLUMNS]
        return [(change, problem, *shown)] if problem or opened else ()

    def end(self):
        return [(None, None, *[self.plan[c] for c in PLAN_COLUMNS])] if self.plan else ()


def apply_plan_changes(L: Ledger, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """changes: change_id, plan_id, action (create, correct, suspend, resume, change, delete), on_date, plan fields.

    History is kept: suspending ends a plan, resuming or changing opens a new one (id from the change).
    """
    own = L.on("plan_id")
    named = changes.withColumn("plan_id", F.when(F.col("action") == "create", F.xxhash64("change_id")).otherwise(F.col("plan_id")))
    touched = named.select(*own).distinct()
    base = L.plans.withColumnRenamed("id", "plan_id").join(touched, own, "left_semi")
    none = lambda ddl, p="": [F.lit(None).cast(f.dataType).alias(p + f.name) for f in T.StructType.fromDDL(ddl).fields]
    rows = base.select(*own, F.lit(None).cast("bigint").alias("change_id"), F.lit(None).cast("string").alias("action"), F.lit(None).cast("date").alias("on_date"), *PLAN_COLUMNS, *none(PLAN, "new_"))
    asked = plan_requests(named, [*own, "change_id"]).select("*", *none(PLAN))
    rows = rows.withColumn("form", F.lit(None).cast("string")).unionByName(asked)
    schema = T.StructType([T.StructField(c, rows.schema[c].dataType) for c in own] + T.StructType.fromDDL("change_id bigint, problem string, " + PLAN).fields)
    out = written(sorted_fold(rows, own, ["change_id"], _PlanFold, schema))
    untouched = L.plans.join(touched.withColumnRenamed("plan_id", "id"), L.on("id"), "left_anti")
    good = out.filter(F.col("problem").isNull())
    plan_id = F.when(F.col("change_id").isNull(), F.col("plan_id")).otherwise(F.xxhash64("change_id"))
    after = good.select(*L.keys, plan_id.alias("id"), *PLAN_COLUMNS)
    return untouched.select(*L.plans.columns).unionByName(after.select(*L.plans.columns)), out.filter(F.col("problem").isNotNull()).select(*own, "change_id", "problem")


