"""Reads over the ledger: joins with the statement, finders, and the row sets other jobs start from."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..functions.money import euros, idiv
from ..schema import (
    BROKERS, INCOME_KINDS, MANUAL_REASON, MONTHS, NO_CATEGORY_KINDS, NOT_STOCK, PAYPAL, SPEND_KINDS, Ledger,
)
from .base import month_of, numbered, top_k

MAX_ROWS = 80
PAIRABLE = NO_CATEGORY_KINDS


def bookings(L: Ledger) -> DataFrame:
    """Bookings with bank, owner and month of their statement."""
    st = L.statements.select(
        *L.keys, F.col("id").alias("statement_id"), "bank", "owner", F.col("month_index").alias("statement_month")
    )
    return L.bookings.join(st, L.on("statement_id"))


def mirrored_ids(L: Ledger) -> DataFrame:
    """Ids of bank bookings that a payment-list row explains."""
    return L.bookings.filter(F.col("mirror_of").isNotNull()).select(*L.keys, F.col("mirror_of").alias("id")).distinct()


def stock_base(L: Ledger) -> DataFrame:
    """Receipt lines that are things kept at home, with their receipt."""
    rc = L.receipts.select(*L.keys, F.col("id").alias("receipt_id"), "store_name", "purchase_date", "owner")
    kept = L.items.filter(F.col("spend_category").isNull() | ~F.col("spend_category").isin(*NOT_STOCK))
    return kept.join(rc, L.on("receipt_id"))


def _within_cent(column: str, amount: float) -> Column:
    c = round(abs(amount) * 100)
    return F.col(column).between(c - 1, c + 1)


def find_receipts(
    L: Ledger, date_from: dt.date, date_to: dt.date, only_unlinked: bool = True, amount: float | None = None,
    limit: int = MAX_ROWS,
) -> DataFrame:
    df = L.receipts.filter(F.col("purchase_date").between(F.lit(date_from), F.lit(date_to)))
    if only_unlinked:
        df = df.filter(~F.col("linked"))
    if amount is not None:
        df = df.filter(_within_cent("total_c", amount))
    df = top_k(df, list(L.keys), [F.col("purchase_date"), F.col("id")], limit)
    return df.select(
        *L.keys, F.col("id").alias("receipt_id"), "owner", F.col("store_name").alias("store"), "purchase_date",
        euros("total_c").alias("total"), "payment_method", "payment_reference",
    )


def find_transactions(
    L: Ledger, date_from: dt.date, date_to: dt.date, only_unlinked: bool = True, amount: float | None = None,
    kind: str | None = "spend", bank: str | None = None, exclude_bank: str | None = None, unmirrored: bool = False,
    limit: int = MAX_ROWS,
) -> DataFrame:
    lo, hi = F.lit(date_from), F.lit(date_to)
    df = L.bookings.filter(F.col("booking_date").between(lo, hi) | F.col("purchase_date").between(lo, hi))
    if kind:
        df = df.filter(F.col("kind") == kind)
    if only_unlinked:
        df = df.filter(F.col("receipt_id").isNull())
    if amount is not None:
        c = round(abs(amount) * 100)
        df = df.filter(F.col("amount_c").between(-c - 1, -c + 1) | F.col("amount_c").between(c - 1, c + 1))
    df = bookings(L.with_(bookings=df))
    if bank:
        df = df.filter(F.col("bank") == bank)
    if exclude_bank:
        df = df.filter(F.col("bank") != exclude_bank)
    explained = mirrored_ids(L)
    if unmirrored:
        df = df.filter(F.col("mirror_of").isNull()).join(explained, L.on("id"), "left_anti")
    df = top_k(df, list(L.keys), [F.col("booking_date"), F.col("id")], limit)
    df = df.join(explained.withColumn("_explained", F.lit(True)), L.on("id"), "left")
    return df.select(
        *L.keys, F.col("id").alias("transaction_id"), "bank",
        (F.col("mirror_of").isNotNull() | F.coalesce("_explained", F.lit(False))).alias("mirrored"),
        "booking_date", "purchase_date", euros("amount_c").alias("amount"), "counterparty", "channel",
        "payment_reference", "kind", F.substring("description", 1, 160).alias("description"),
        F.col("receipt_id").alias("linked_receipt_id"), "transfer_group",
    )


def _statement_view(df: DataFrame, L: Ledger) -> DataFrame:
    return df.select(
        *L.keys, "id", "bank", "owner", E.month_abbr("month_index").alias("month"),
        F.floor(F.col("month_index") / 12).cast("int").alias("year"),
        euros("opening_c").alias("starting_balance"), euros("closing_c").alias("closing_balance"),
    )


def statements_for_month(L: Ledger, month: str, year: int) -> DataFrame:
    at = month_of(year, MONTHS.index(month) + 1)
    return _statement_view(L.statements.filter(F.col("month_index") == at), L)


def statements_in_range(L: Ledger, start: tuple[str, int], end: tuple[str, int]) -> DataFrame:
    """Newest first. A range may cross years; an unknown month or a start after the end is an error."""
    for name, _ in (start, end):
        if name not in MONTHS:
            raise ValueError("Invalid start or end month abbreviation provided.")
    first, last = (month_of(y, MONTHS.index(m) + 1) for m, y in (start, end))
    if first > last:
        raise ValueError("The start of the range cannot be after its end.")
    rows = L.statements.filter(F.col("month_index").between(first, last))
    return _statement_view(rows.orderBy(F.col("month_index").desc(), *L.keys, "id"), L)


def statements_latest_first(L: Ledger) -> DataFrame:
    return _statement_view(L.statements.orderBy(F.col("month_index").desc(), *L.keys, "id"), L)


def recheck_candidates(
    L: Ledger, from_categories: list[str | None] | None = None, include_uncategorized: bool = True,
    date_from: dt.date | None = None, date_to: dt.date | None = None,
) -> DataFrame:
    """Entries whose category may have to change, with the line a reviewer reads."""

    def picked(column: str) -> Column:
        if from_categories is None:
            return F.lit(True)
        named = F.col(column).isin([k for k in from_categories if k])
        if include_uncategorized or None in from_categories:
            return named | F.col(column).isNull()
        return named

    def dated(df: DataFrame, column: str) -> DataFrame:
        if date_from:
            df = df.filter(F.col(column) >= F.lit(date_from))
        return df.filter(F.col(column) <= F.lit(date_to)) if date_to else df

    now = lambda c: F.concat(F.lit(" | now="), F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("none")))
    bar = F.lit(" | ")
    rc = dated(L.receipts, "purchase_date").select(*L.keys, F.col("id").alias("receipt_id"), "store_name")
    items = L.items.filter(picked("spend_category")).join(rc, L.on("receipt_id"))
    item_ref = F.concat(F.lit("i"), F.col("id").cast("string"))
    items = items.select(
        *L.keys, F.lit(0).alias("part"), "id", item_ref.alias("ref"),
        F.concat(item_ref, bar, F.col("store_name"), bar, F.col("name"), bar, E.plain_euros(E.line_total()),
                 now("spend_category")).alias("line"),
    )
    tx = dated(L.bookings.filter(~F.col("kind").isin(*NO_CATEGORY_KINDS) & picked("category")), "booking_date")
    tx_ref = F.concat(F.lit("t"), F.col("id").cast("string"))
    tx = tx.select(
        *L.keys, F.lit(1).alias("part"), "id", tx_ref.alias("ref"),
        F.concat(tx_ref, bar, F.col("counterparty"), bar, F.substring("description", 1, 90), bar,
                 E.signed_euros("amount_c"), F.lit(" | kind="), F.col("kind"), now("category")).alias("line"),
    )
    return items.unionByName(tx)


def with_batches(df: DataFrame, keys: list[str], size: int = 100) -> DataFrame:
    """Fixed batches of candidates per household (batch 0, 1, ...)."""
    return numbered(df, keys, "part", "id", "_n").withColumn("batch", idiv(F.col("_n") - 1, size)).drop("_n")


def batch_counts(df: DataFrame, keys: list[str], size: int = 100) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("entries")).withColumn(
        "batches", F.ceil(F.col("entries") / size).cast("bigint")
    )


def open_questions(L: Ledger) -> DataFrame:
    rows = L.questions.filter(F.col("status") == "open").orderBy(*L.keys, "id")
    return rows.select(
        *L.keys, "id", "kind", "question", "transaction_id", "receipt_id", "other_transaction_id", "created_at"
    )


def unpaired_transfers(L: Ledger) -> DataFrame:
    rows = L.bookings.filter(F.col("kind").isin(*PAIRABLE) & F.col("transfer_group").isNull())
    return bookings(L.with_(bookings=rows)).select(
        *L.keys, "id", "bank", "booking_date", euros("amount_c").alias("amount"), "kind", "counterparty"
    )


def _text() -> Column:
    return F.substring(F.coalesce(F.nullif(F.col("description"), F.lit("")), F.col("counterparty")), 1, 90)


def _broker(df: DataFrame, broker: str | None) -> DataFrame:
    return df.filter(F.col("bank") == broker) if broker else df.filter(F.col("bank").isin(*BROKERS))


def moved_out(L: Ledger, broker: str | None = None) -> DataFrame:
    """Bookings the household took out of the investments by hand."""
    rows = L.bookings.filter(
        (F.col("kind") == "internal_transfer") & F.col("transfer_group").isNull()
        & (F.col("link_reason") == MANUAL_REASON)
    )
    return _broker(bookings(L.with_(bookings=rows)), broker).select(
        *L.keys, "id", F.col("bank").alias("broker"), F.col("booking_date").alias("date"),
        euros(-F.col("amount_c")).alias("amount"), _text().alias("text"),
    )


def investment_bookings(L: Ledger, broker: str | None = None) -> DataFrame:
    """Investment bookings, money into the market positive, with instrument code and fingerprint."""
    rows = _broker(bookings(L.with_(bookings=L.bookings.filter(F.col("kind") == "investment"))), broker)
    into = -F.col("amount_c")
    return rows.select(
        *L.keys, "id", F.col("bank").alias("broker"), F.col("booking_date").alias("date"), into.alias("amount_c"),
        "counterparty", "description", E.instrument_code("description").alias("code"),
        E.booking_ref("bank", "booking_date", into, "description").alias("ref"),
    )


def bookings_newest_first(L: Ledger, broker: str) -> DataFrame:
    rows = investment_bookings(L, broker).orderBy(F.col("date").desc(), F.col("id").desc())
    return rows.select(*L.keys, "id", "broker", "date", euros("amount_c").alias("amount"), "counterparty", "code")


def depot_side_flows(L: Ledger, broker: str | None = None) -> DataFrame:
    """Costs and money received that belong to the depot and are not investments."""
    rows = _broker(bookings(L.with_(bookings=L.bookings.filter(F.col("kind") != "investment"))), broker)
    cost = F.col("kind").isin("fee", "spend") & (F.col("amount_c") < 0) & (
        (F.col("kind") == "fee") | (F.col("category") == "taxes_fees")
    )
    side = F.when(F.col("kind").isin(*INCOME_KINDS) & (F.col("amount_c") > 0), "received").when(cost, "cost")
    return (
        rows.filter(E.is_depot_row("bank", "counterparty", "description"))
        .select(
            *L.keys, "id", F.col("bank").alias("broker"), F.col("booking_date").alias("date"),
            F.abs("amount_c").alias("amount_c"), _text().alias("text"), side.alias("side"),
        )
        .filter(F.col("side").isNotNull())
    )


def depot_side_totals(L: Ledger, broker: str | None = None) -> DataFrame:
    return depot_side_flows(L, broker).groupBy(*L.keys, "side").agg(
        euros(F.sum("amount_c")).alias("total"), F.count("*").alias("entries")
    )


def recurring_payments(L: Ledger) -> DataFrame:
    """Money that really left, by payee: the payment-list row is kept, the bank line it explains is dropped."""
    out = L.bookings.filter(
        F.col("kind").isin(*SPEND_KINDS) & (F.col("amount_c") < 0) & F.col("receipt_id").isNull()
    )
    explained = out.filter(F.col("mirror_of").isNotNull()).select(*L.keys, F.col("mirror_of").alias("id")).distinct()
    rows = bookings(L.with_(bookings=out)).join(explained, L.on("id"), "left_anti")
    return rows.select(
        *L.keys, "id", F.col("counterparty").alias("name"), E.payee_key("counterparty").alias("payee"),
        E.effective_date().alias("date"), (-F.col("amount_c")).alias("amount_c"), "category",
        F.when(F.col("bank") != PAYPAL, F.col("booking_date")).alias("bank_day"),
    )


def covered_until(payments: DataFrame, keys: list[str]) -> DataFrame:
    """How far the bank statements reach, per household."""
    return payments.groupBy(*keys).agg(F.max("bank_day").alias("covered_until"))
