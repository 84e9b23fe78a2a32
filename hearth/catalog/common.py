"""Named queries: the Spark job and the SQL it is compared with, side by side."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..functions.money import sql_half_even, sql_half_up, sql_pct
from ..schema import SEED_CATEGORIES, Ledger
from ..sources.star import comparison_prelude, star_ledger

# The days the sample data is looked at from.
TODAY = dt.date(2001, 8, 2)
YEAR, MONTH = 1998, 5

MONTH_NAMES = "['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec']"


def label(index: str) -> str:
    return f"({MONTH_NAMES}[cast({index} % 12 + 1 AS int)] || ' ' || lpad(cast(({index} // 12) % 100 AS varchar), 2, '0'))"


def mi(date: str) -> str:
    return f"cast(year({date}) * 12 + month({date}) - 1 AS int)"


def big(expr: str) -> str:
    return f"cast({expr} AS bigint)"


SHARED = {
    "tx": "SELECT b.*, s.bank, s.owner, s.month_index AS statement_month FROM bookings b JOIN statements s "
          "ON s.household_id = b.household_id AND s.id = b.statement_id",
    "expense": "SELECT * FROM categories WHERE flow = 'expense'",
    "entries": """
SELECT e.household_id, e.source, e.amount_c, e.owner, e.store, e.date, coalesce(c.key, 'uncategorized') AS key,
       coalesce(c.label, 'Uncategorized') AS label, coalesce(c.group_name, 'Other') AS grp, coalesce(c.fixed, false) AS fixed
FROM (SELECT i.household_id, 'receipt' AS source, i.quantity * i.unit_c - i.discount_c AS amount_c, r.owner,
             r.store_name AS store, r.purchase_date AS date, i.spend_category AS category
      FROM items i JOIN receipts r ON r.id = i.receipt_id AND r.household_id = i.household_id
      UNION ALL
      SELECT household_id, 'bank', -amount_c, owner, counterparty, coalesce(purchase_date, booking_date),
             coalesce(category, CASE kind WHEN 'fee' THEN 'bank_fees' WHEN 'cash' THEN 'cash' END)
      FROM tx WHERE kind IN ('spend', 'fee', 'cash', 'other') AND amount_c < 0 AND receipt_id IS NULL
        AND mirror_of IS NULL) e LEFT JOIN expense c ON c.key = e.category""",
}


def with_prelude(sql: str) -> str:
    shared = ",\n".join(f"{name} AS ({text})" for name, text in SHARED.items())
    body = sql.strip()
    if body.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {comparison_prelude().removeprefix('WITH')},\n{shared},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"{comparison_prelude()},\n{shared},\n{body[5:]}"
    return f"{comparison_prelude()},\n{shared}\n{body}"


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[Ledger], DataFrame]
    sql: str | None = None
    raw: bool = False  # run(spark, sf_dir) instead of run(ledger)
    once: tuple = ()  # tables that run reads a single time

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        if self.raw:
            return self.run(spark, sf_dir)
        return self.run(star_ledger(spark, sf_dir, self.once))


__all__ = [
    "TODAY", "YEAR", "MONTH", "Query", "big", "dt", "label", "mi", "sql_half_even", "sql_half_up", "sql_pct",
    "with_prelude", "SEED_CATEGORIES",
]
