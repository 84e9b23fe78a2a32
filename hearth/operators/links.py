"""Applying matches: links, transfer groups, mirrors, questions and the household's answers.

A ledger goes in, the next ledger comes out; every change is one join.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..functions import exprs as E
from ..schema import GENERIC_BANK_CATEGORIES, PAYPAL, Ledger
from ..sources.scratch import written
from .base import islands, sorted_fold
from .finders import bookings, mirrored_ids

KINDS = ("receipt_match", "transfer_match", "mirror_match")
COLUMNS = {
    "receipt_match": ("transaction_id", "receipt_id"), "transfer_match": ("out_id", "in_id"),
    "mirror_match": ("paypal_id", "bank_id"),
}


def last_changes(changes: DataFrame, on: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(the last change of each key, the others). Equal changes count once; what `order` leaves open, the values decide."""
    rank = F.row_number().over(W.partitionBy(*on).orderBy(*[F.col(c).desc_nulls_last() for c in [*order, *[c for c in changes.columns if c not in order]]]))
    ranked = written(changes.distinct().withColumn("_rank", rank))
    return ranked.filter("_rank = 1").drop("_rank"), ranked.filter("_rank > 1").drop("_rank")


def patched(df: DataFrame, changes: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """df with `columns` taken from `changes` where a change with the same key exists (nulls included).

    A row of df never becomes two: of several changes of a key the one with the greatest values holds. Callers that know which is the last pick it
    with `last_changes` and report the others.
    """
    once = changes.groupBy(*on).agg(F.max(F.struct(*columns)).alias("_new"))
    new = once.select(*on, *[F.col(f"_new.{c}").alias(f"_new_{c}") for c in columns], F.lit(True).alias("_changed"))
    out = df.join(new, on, "left")
    return out.select(*[
        F.when(F.col("_changed"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
        for c in df.columns
    ])


def _ids(df: DataFrame, L: Ledger, *columns: str) -> DataFrame:
    one = df.select(*L.keys, F.col(columns[0]).alias("id"))
    for c in columns[1:]:
        one = one.union(df.select(*L.keys, F.col(c).alias("id")))
    return one.distinct()


def close_questions(L: Ledger, tx_ids: DataFrame, receipt_ids: DataFrame | None = None, now: dt.datetime | None = None) -> DataFrame:
    """Open questions about these bookings or receipts become superseded: they were settled another way."""
    q = L.questions
    for column, ids in (("transaction_id", tx_ids), ("other_transaction_id", tx_ids), ("receipt_id", receipt_ids)):
        flag = f"_by_{column}"
        if ids is None:
            q = q.withColumn(flag, F.lit(None).cast("boolean"))
            continue
        q = q.join(ids.select(*L.keys, F.col("id").alias(column), F.lit(True).alias(flag)), L.on(column), "left")
    hit = F.coalesce("_by_transaction_id", "_by_other_transaction_id", "_by_receipt_id", F.lit(False))
    hit = hit & (F.col("status") == "open")
    return q.withColumn("answered_at", F.when(hit, F.lit(now).cast("timestamp")).otherwise(F.col("answered_at"))).withColumn(
        "status", F.when(hit, "superseded").otherwise(F.col("status"))
    ).select(*L.questions.columns)


# ---- may this pair be linked? --------------------------------------------------------------------------
def validate_links(pairs: DataFrame, L: Ledger, kind: str) -> DataFrame:
    """Adds `problem` (null when the pair may be linked), in the order the rules are checked."""
    a_name, b_name = COLUMNS[kind]
    side = ["id", "amount_c", "booking_date", "statement_id", "transfer_group", "receipt_id", "mirror_of", "bank"]
    tx = bookings(L).select(*L.keys, *side)
    a = tx.select(*L.keys, *[F.col(c).alias(a_name if c == "id" else f"a_{c}") for c in side])
    df = pairs.join(a, L.on(a_name), "left")
    asked = L.questions.filter((F.col("kind") == kind) & (F.col("status") == "no")).select(
        *L.keys, F.col("transaction_id").alias(a_name),
        F.col("receipt_id" if kind == "receipt_match" else "other_transaction_id").alias(b_name), F.lit(True).alias("_no"),
    ).distinct()
    if kind == "receipt_match":
        b = L.receipts.select(*L.keys, F.col("id").alias(b_name), "total_c", "linked")
        df = df.join(b, L.on(b_name), "left")
        rules = [
            ("no_transaction", F.col("a_amount_c").isNull()), ("no_receipt", F.col("total_c").isNull()),
            ("money_in", F.col("a_amount_c") >= 0),
            ("amounts_differ", F.abs(F.abs("a_amount_c") - F.col("total_c")) > 1),
            ("transaction_linked", F.col("a_receipt_id").isNotNull()), ("receipt_linked", F.col("linked")),
        ]
    else:
        b = tx.select(*L.keys, *[F.col(c).alias(b_name if c == "id" else f"b_{c}") for c in side])
        df = df.join(b, L.on(b_name), "left")
        missing = ("no_transaction", F.col("a_amount_c").isNull() | F.col("b_amount_c").isNull())
        differ = ("amounts_differ", F.abs(F.abs("a_amount_c") - F.abs("b_amount_c")) > 1)
        if kind == "transfer_match":
            rules = [
                missing, ("wrong_direction", ~((F.col("a_amount_c") < 0) & (F.col("b_amount_c") > 0))), differ,
                ("same_statement", F.col("a_statement_id") == F.col("b_statement_id")),
                ("already_paired", F.col("a_transfer_group").isNotNull() | F.col("b_transfer_group").isNotNull()),
            ]
        else:
            taken = mirrored_ids(L).select(*L.keys, F.col("id").alias(b_name), F.lit(True).alias("_taken"))
            df = df.join(taken, L.on(b_name), "left")
            rules = [
                missing, ("not_paypal", F.col("a_bank") != PAYPAL), ("both_paypal", F.col("b_bank") == PAYPAL),
                ("different_direction", (F.col("a_amount_c") < 0) != (F.col("b_amount_c") < 0)), differ,
                ("too_far_apart", F.abs(F.datediff("a_booking_date", "b_booking_date")) > 10),
                ("already_explains", F.col("a_mirror_of").isNotNull()), ("already_explained", F.col("_taken")),
            ]
    df = df.join(asked, L.on(a_name, b_name), "left")
    problem = F.lit(None).cast("string")
    for name, test in reversed([*rules, ("answered_no", F.col("_no"))]):
        problem = F.when(test, name).otherwise(problem)
    return df.select(*[F.col(c) for c in pairs.columns], problem.alias("problem"))


# ---- applying pairs ------------------------------------------------------------------------------------
def apply_receipt_links(L: Ledger, pairs: DataFrame, status: str = "auto") -> Ledger:
    """pairs: transaction_id, receipt_id, reason."""
    change = pairs.select(
        *L.keys, F.col("transaction_id").alias("id"), "receipt_id", F.lit(status).alias("link_status"),
        F.substring("reason", 1, 300).alias("link_reason"),
    )
    flags = pairs.select(*L.keys, F.col("receipt_id").alias("id"), F.lit(True).alias("linked")).distinct()
    return L.with_(
        bookings=patched(L.bookings, change, L.on("id"), ["receipt_id", "link_status", "link_reason"]),
        receipts=patched(L.receipts, flags, L.on("id"), ["linked"]),
        questions=close_questions(L, _ids(pairs, L, "transaction_id"), _ids(pairs, L, "receipt_id")),
    )


def apply_transfer_pairs(L: Ledger, pairs: DataFrame, status: str = "auto") -> Ledger:
    """pairs: out_id, in_id, reason. Both sides become one transfer named after the outgoing booking."""
    change = pairs.withColumn("id", F.explode(F.array("out_id", "in_id"))).select(
        *L.keys, "id", F.col("out_id").alias("transfer_group"), F.lit("internal_transfer").alias("kind"),
        F.lit(status).alias("link_status"), F.substring("reason", 1, 300).alias("link_reason"),
    )
    return L.with_(
        bookings=patched(L.bookings, change, L.on("id"), ["transfer_group", "kind", "link_status", "link_reason"]),
        questions=close_questions(L, _ids(pairs, L, "out_id", "in_id")),
    )


def apply_mirrors(L: Ledger, pairs: DataFrame, status: str = "auto") -> Ledger:
    """pairs: paypal_id, bank_id, reason. The opaque bank booking learns category and merchant from the list."""
    rows = L.bookings.select(*L.keys, F.col("id").alias("paypal_id"), F.col("category").alias("_cat"), F.col("counterparty").alias("_who"))
    full = pairs.join(rows, L.on("paypal_id"))
    listed = full.select(
        *L.keys, F.col("paypal_id").alias("id"), F.col("bank_id").alias("mirror_of"), F.lit(status).alias("link_status"),
        F.substring("reason", 1, 300).alias("link_reason"),
    )
    df = patched(L.bookings, listed, L.on("id"), ["mirror_of", "link_status", "link_reason"])
    known = full.select(*L.keys, F.col("bank_id").alias("id"), "_cat", "_who", F.lit(True).alias("_m"))
    df = df.join(known, L.on("id"), "left")
    generic = lambda c: F.col(c).isNull() | F.col(c).isin(*GENERIC_BANK_CATEGORIES)
    learns = F.coalesce(F.col("_m"), F.lit(False))
    df = df.withColumn("category", F.when(learns & generic("category") & ~generic("_cat"), F.col("_cat")).otherwise(F.col("category")))
    df = df.withColumn(
        "counterparty",
        F.when(learns & F.lower("counterparty").startswith("paypal"), F.col("_who")).otherwise(F.col("counterparty")),
    ).select(*L.bookings.columns)
    return L.with_(bookings=df, questions=close_questions(L, _ids(pairs, L, "paypal_id", "bank_id")))


APPLY = {"receipt_match": apply_receipt_links, "transfer_match": apply_transfer_pairs, "mirror_match": apply_mirrors}


# ---- questions -----------------------------------------------------------------------------------------
def questions_from(pairs: DataFrame, L: Ledger, kind: str) -> DataFrame:
    """New questions for likely pairs that were never asked (open, yes or no)."""
    a_name, b_name = COLUMNS[kind]
    receipt = kind == "receipt_match"
    df = pairs.select(
        *L.keys, F.col(a_name).alias("transaction_id"),
        (F.col(b_name) if receipt else F.lit(None).cast("bigint")).alias("receipt_id"),
        (F.lit(None).cast("bigint") if receipt else F.col(b_name)).alias("other_transaction_id"), "reason",
    )
    other = "receipt_id" if receipt else "other_transaction_id"
    asked = L.questions.filter((F.col("kind") == kind) & F.col("status").isin("open", "yes", "no"))
    df = df.join(asked.select(*L.on("transaction_id", other)).distinct(), L.on("transaction_id", other), "left_anti")
    side = ["booking_date", "purchase_date", "amount_c", "counterparty", "bank"]
    tx = bookings(L).select(*L.keys, "id", *side)
    df = df.join(tx.select(*L.keys, F.col("id").alias("transaction_id"), *[F.col(c).alias(f"t_{c}") for c in side]), L.on("transaction_id"))
    if receipt:
        rc = L.receipts.select(*L.keys, F.col("id").alias("receipt_id"), *[F.col(c).alias(f"r_{c}") for c in ("store_name", "purchase_date", "total_c")])
        df = df.join(rc, L.on("receipt_id"))
        text = E.receipt_question(F.col("reason"))
    else:
        df = df.join(tx.select(*L.keys, F.col("id").alias("other_transaction_id"), *[F.col(c).alias(f"o_{c}") for c in side]), L.on("other_transaction_id"))
        text = (E.transfer_question if kind == "transfer_match" else E.mirror_question)(F.col("reason"))
    return df.select(
        *L.keys, F.xxhash64(F.lit(kind), "transaction_id", other).alias("id"), F.lit(kind).alias("kind"), "transaction_id",
        "receipt_id", "other_transaction_id", text.alias("question"), F.lit("open").alias("status"),
        F.lit(None).cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("answered_at"),
    )


class _FirstCome:
    """Keeps a pair if neither of its ids is taken yet."""

    def __init__(self, a: str, b: str, columns: list[str]):
        self.a, self.b, self.columns, self.taken = a, b, columns, (set(), set())

    def row(self, r: dict):
        if r[self.a] in self.taken[0] or r[self.b] in self.taken[1]:
            return ()
        self.taken[0].add(r[self.a])
        self.taken[1].add(r[self.b])
        return [tuple(r[c] for c in self.columns)]

    def end(self):
        return ()


def _first_come(df: DataFrame, keys: list[str], a: str, b: str, order: list[str], cents: str, reach: int) -> DataFrame:
    """Pairs kept when taken in order and no id is used twice; pairs that share an id have amounts (`cents`) `reach` apart at most.

    Pairs whose ids nobody else claims are kept as they are. The others go through one fold per island of amounts: conflicts never reach from one island
    into another, however long their chains. The number of jobs does not depend on the data.
    """
    pairs = written(df)
    claimed = [pairs.groupBy(*keys, c).agg(F.count("*").alias("_n")).filter("_n > 1").select(*keys, c) for c in (a, b)]
    marked = pairs
    for c, several in zip((a, b), claimed):
        marked = marked.join(several.withColumn(f"_{c}", F.lit(True)), [*keys, c], "left")
    marked = written(marked.withColumn("_contested", F.coalesce(F.col(f"_{a}"), F.col(f"_{b}"), F.lit(False))).select(*df.columns, "_contested"))
    contested = islands(marked.filter("_contested").drop("_contested"), keys, cents, reach)
    own = [*keys, "island"]
    rest = [c for c in df.columns if c not in keys]
    schema = T.StructType([contested.schema[c] for c in [*own, *rest]])
    kept = sorted_fold(contested.select(*own, *rest), own, order, lambda: _FirstCome(a, b, rest), schema)
    return marked.filter("NOT _contested").select(*df.columns).unionByName(kept.select(*df.columns))


def apply_answers(L: Ledger, answers: DataFrame) -> tuple[Ledger, DataFrame]:
    """answers: question_id, yes, ts. Returns the next ledger and the answers that had no effect, with the reason.

    The first answer to a question counts. A 'yes' links when both sides are still free; inside one batch the
    earlier answer takes the booking. A 'no' is final.
    """
    first = answers.withColumn("_n", F.row_number().over(W.partitionBy(*L.keys, "question_id").orderBy("ts", F.col("yes").desc())))
    q = L.questions.select(*L.keys, F.col("id").alias("question_id"), "kind", "transaction_id", "receipt_id", "other_transaction_id", "status")
    rows = written(first.join(q, L.on("question_id"), "left"))
    late = rows.filter(F.col("status").isNull() | (F.col("status") != "open") | (F.col("_n") > 1)).select(
        *L.keys, "question_id", F.when(F.col("status").isNull(), "no_question").otherwise("already_answered").alias("problem")
    )
    live = rows.filter((F.col("status") == "open") & (F.col("_n") == 1))
    said = live.select(*L.keys, F.col("question_id").alias("id"), F.when(F.col("yes"), "yes").otherwise("no").alias("status"),
                       F.col("ts").alias("answered_at"))
    out = L.with_(questions=written(patched(L.questions, said, L.on("id"), ["status", "answered_at"])))
    problems = late
    for kind in KINDS:
        a, b = COLUMNS[kind]
        other = "receipt_id" if kind == "receipt_match" else "other_transaction_id"
        pairs = live.filter(F.col("yes") & (F.col("kind") == kind)).select(
            *L.keys, "question_id", "ts", F.col("transaction_id").alias(a), F.col(other).alias(b),
            F.lit("confirmed by household").alias("reason"),
        )
        checked = written(validate_links(pairs, out, kind))
        amounts = L.bookings.select(*L.keys, F.col("id").alias(a), F.abs("amount_c").alias("cents"))
        free = checked.filter(F.col("problem").isNull()).drop("problem").join(amounts, L.on(a))
        # both sides of a pair are a cent apart at most, so pairs with a common side are two cents apart at most
        good = written(_first_come(free, list(L.keys), a, b, ["ts", "question_id"], "cents", 2))
        lost = checked.join(good.select(*L.on("question_id")), L.on("question_id"), "left_anti")
        problems = problems.unionByName(lost.select(*L.keys, "question_id", F.coalesce("problem", F.lit("already_linked")).alias("problem")))
        out = APPLY[kind](out, good.drop("ts", "question_id", "cents"), "confirmed")
    return out, problems
