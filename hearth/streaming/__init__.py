"""The ledger as it arrives: documents, stock events, spending."""

from __future__ import annotations

import datetime as dt
import json
import pickle
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.loads import load_receipts, load_statements
from ..operators.reconcile import reconcile
from ..operators.stock import with_stock_group
from ..operators.upkeep import REQUEST, STATE_COLUMNS, stock_requests, stock_step
from ..schema import NOT_STOCK, Ledger
from ..sources.ledger import split_submissions, submission_schema
from ..sources.scratch import written
from ..sources.store import load_ledger, manifest, touched_buckets, update_ledger

KEPT_COLUMNS = [*STATE_COLUMNS, "is_food"]
NOTHING_ASKED = dict.fromkeys(["at", "event_id", *[part.strip().split(" ")[0] for part in REQUEST.split(",")]])
MOVE = "event_id bigint, problem string, status string, quantity_left double, wasted_quantity double"
MOVES_A_ROW = 1000


def stream_ingest(
    spark: SparkSession, in_dir: str, kind: str, ledger: str, outcomes: str, checkpoint: str, today: dt.date,
    keys: tuple = ("household_id",), max_files: int = 1000,
) -> StreamingQuery:
    """Loads new submission files (JSON lines) into the ledger at `ledger` and files an outcome per document.

    After statements the passes of `reconcile` run over the households of the batch. Works off what is there and stops (availableNow);
    the checkpoint remembers the files. The outcome is filed before the ledger is switched, and the ledger remembers the batch: one that
    was cut off before the switch is done again from the old ledger, one after it is skipped.
    """
    docs = (
        spark.readStream.schema(submission_schema(kind, keys)).option("maxFilesPerTrigger", max_files)
        .option("columnNameOfCorruptRecord", "unreadable").json(in_dir)
    )

    def load(batch: DataFrame, batch_id: int) -> None:
        state = manifest(spark, ledger)
        if state["batches"].get(checkpoint, -1) >= batch_id:
            return
        heads, lines, bad = split_submissions(written(batch), kind, keys)
        heads = written(heads)
        touched = touched_buckets(heads, keys, state["buckets"])
        L = load_ledger(spark, ledger, touched, keys)
        if kind == "receipt":
            after, outcome = load_receipts(heads, lines, L, today, whole=False)
            names: tuple = ("items", "receipts")
        else:
            after, outcome = load_statements(heads, lines, L)
            after = reconcile(after.with_(bookings=written(after.bookings)))
            names = ("bookings", "questions", "receipts", "statements")
            after = after.with_(**{n: written(getattr(after, n)) for n in names})  # the store reads them twice
        unreadable = bad.select(
            *[F.lit(None).cast("bigint").alias(k) for k in keys], F.xxhash64("unreadable").alias("doc_id"),
            F.lit("unreadable").alias("outcome"), F.col("unreadable").alias("reason"),
        )
        outcome.unionByName(unreadable).write.mode("overwrite").parquet(f"{outcomes}/batch={batch_id}")
        update_ledger(after, ledger, names, touched, (checkpoint, batch_id), adds=kind == "receipt")

    return (
        docs.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


class _Moves(StatefulProcessor):
    """Applies events to the kept states of a group of items; a finished item takes only ratings and the like.

    The states are there before the first batch: Spark hands over the items table once (`handleInitialState`). A group's items are one value, so
    a batch asks the state store once a group and not several times an item. Spark hands over cell by cell, which costs more than the step itself: an event
    comes as one text, the items of a group come as one text, so do the moves when they leave, and the kept value is bytes.
    """

    def __init__(self, own: list[str], evicts: bool):
        self.own, self.evicts = own, evicts
        self.names = (*own, *KEPT_COLUMNS, "leaves_at")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.items = handle.getValueState("items", "states binary")
        self.begun = None  # (group, its states) that was there at the beginning: its events come next

    def _held(self, key) -> dict[tuple, tuple]:
        """The states of a group, by item: values in the order of `names`."""
        begun, self.begun = self.begun, None
        if begun and begun[0] == key:
            return begun[1]
        held = self.items.get()
        return {values[:len(self.own)]: values for values in pickle.loads(held[0])} if held is not None else {}

    def _keep(self, states: dict[tuple, tuple]) -> None:
        self.items.update((pickle.dumps(list(states.values()), pickle.HIGHEST_PROTOCOL),))

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        states, n = {}, len(self.own)
        for row in json.loads(initialState["items"]):
            values = tuple(map(_numbers(row, "quantity_left", "wasted_quantity").get, self.names))
            if row.get("finished_on") is not None and not row["quantity_left"]:
                state = dict(zip(self.names, values))
                self._leaves(state, state["finished_on"] * 86_400_000)
                values = tuple(state.values())
            states[values[:n]] = values
        self._keep(states)
        self.begun = key, states

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        asked: dict[tuple, list[dict]] = {}
        for event in json.loads(f"[{','.join([row['event'] for row in rows])}]"):
            asked.setdefault(tuple(map(event.get, self.own)), []).append(_numbers(NOTHING_ASKED | event, "removes"))
        states, out = self._held(key), []
        for item, events in asked.items():
            if len(events) > 1:
                events.sort(key=lambda r: (r["at"], r["event_id"]))
            state = dict(zip(self.names, states[item])) if item in states else None
            had_any = bool(state and state["quantity_left"])
            for event in events:
                if state is None:
                    out.append((*item, event["event_id"], "no_such_item", None, None, None))
                else:
                    problem = stock_step(state, event)
                    out.append((*item, event["event_id"], problem, state["status"], state["quantity_left"], state["wasted_quantity"]))
            if had_any and not state["quantity_left"]:
                self._leaves(state, events[-1]["at"] // 1000)
            if state:
                states[item] = tuple(state.values())
        if states:
            self._keep(states)
        for start in range(0, len(out), MOVES_A_ROW):
            yield Row(moves=json.dumps(out[start:start + MOVES_A_ROW]))

    def _leaves(self, state: dict, at_ms: int) -> None:
        if self.evicts:
            state["leaves_at"] = max(at_ms, 1)
            self.handle.registerTimer(state["leaves_at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        left = {item: s for item, s in self._held(key).items() if s[-1] is None or s[-1] > now}
        if left:
            self._keep(left)
        else:
            self.items.clear()
        return iter(())


def _numbers(row: dict, *columns: str) -> dict:
    """row with its numbers as numbers: JSON writes those that are none (NaN, Infinity) as text."""
    for c in columns:
        if isinstance(row.get(c), str):
            row[c] = float(row[c])
    return row


def _as_text(df: DataFrame, own: list[str]) -> list[Column]:
    """The columns of df for a JSON text: keys as strings, days as numbers."""
    kinds = {f.name: f.dataType for f in df.schema}
    return [F.col(c).cast("string").alias(c) if c in own else F.unix_date(c).alias(c) if kinds[c] == T.DateType() else F.col(c) for c in df.columns]


def stream_stock(L: Ledger, events: DataFrame, keep_finished: str | None = "400 days", groups: int = 1 << 14) -> DataFrame:
    """Stock events as they arrive: one output row per event with the state of its item after it.

    The items table is read once, before the first batch, and lives in the RocksDB state store from then on, in `groups` groups by hash: a batch touches the
    groups it has events for and no others, and a checkpoint holds changes only. How many groups is a property of the checkpoint, chosen when it is begun
    (some hundreds of items each: a batch rewrites the groups it touches, and handing a group over has its price). An item with nothing left goes once events have come that are `keep_finished` younger
    (what still comes for it is `no_such_item`); events that much older than the newest are too late and dropped. None keeps and takes everything.
    """
    own = L.on("item_id")
    conf = L.spark.conf
    conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    stock = L.items.filter(F.col("spend_category").isNull() | ~F.col("spend_category").isin(*NOT_STOCK))
    left = F.coalesce("quantity_left", F.col("quantity").cast("double"), F.lit(1.0))
    base = with_stock_group(stock, L).withColumn("quantity_left", left).withColumn("wasted_quantity", F.coalesce("wasted_quantity", F.lit(0.0)))
    group = F.pmod(F.xxhash64(*own), F.lit(groups)).alias("stock_group")
    base = base.select(*L.keys, F.col("id").alias("item_id"), *KEPT_COLUMNS)
    held = base.groupBy(group).agg(F.to_json(F.collect_list(F.struct(*_as_text(base, own)))).alias("items"))
    timed = events.withWatermark("ts", keep_finished) if keep_finished else events
    named = stock_requests(timed.withColumn("at", F.unix_micros("ts")), [*own, "at", "event_id", "ts"])
    asked = F.to_json(F.struct(*_as_text(named.drop("ts"), own))).alias("event")
    moves = named.select(group, *(["ts"] if keep_finished else []), asked).groupBy("stock_group").transformWithState(
        statefulProcessor=_Moves(own, bool(keep_finished)), outputStructType="moves string", outputMode="append",
        timeMode="EventTime" if keep_finished else "None", initialState=held.groupBy("stock_group"),
    )
    columns = [*[(k, named.schema[k].dataType) for k in own], *[(f.name, f.dataType) for f in T.StructType.fromDDL(MOVE)]]
    move = F.explode(F.from_json("moves", "array<array<string>>")).alias("m")
    return moves.select(move).select(*[F.col("m")[i].cast(kind).alias(name) for i, (name, kind) in enumerate(columns)])


def stream_month_totals(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Running spending per month and category of an entry stream (keys, date, key, amount_c); use update mode.

    The state holds one row per household, month and category and entries may come years late, so no month ever leaves it.
    """
    timed = entries.withColumn("month", F.date_trunc("month", F.col("date").cast("timestamp")))
    return timed.groupBy(*keys, "month", "key").agg(F.sum("amount_c").alias("amount_c"), F.count("*").alias("entries"))
