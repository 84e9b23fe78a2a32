"""A ledger written down row by row, and short names for tests."""

import datetime as dt

from pyspark.sql import functions as F

from hearth.schema import SCHEMAS, Ledger, seed_categories

D = dt.date


class Book:
    """A ledger written down row by row; columns that are not named take a default."""

    DEFAULTS = {
        "statements": dict(bank="Sparkasse", owner="Ann", has_balances=True, status="ok"),
        "bookings": dict(counterparty="Shop", description="", kind="spend"),
        "receipts": dict(store_name="Shop", linked=False, owner="Ann", status="ok", discount_c=0),
        "items": dict(
            name="Milk", quantity=1, unit_c=100, discount_c=0, category="Food", storage_condition="Normal", status="Available",
            spend_category="groceries", wasted_quantity=0.0,
        ),
        "questions": dict(status="open", question="?"), "rules": dict(hidden=False),
        "plans": dict(broker="N26", frequency="monthly"), "splits": dict(amount_c=0),
    }

    def __init__(self, spark):
        self.spark, self.rows = spark, {n: [] for n in SCHEMAS}

    def add(self, table, **values):
        row = {"household_id": 1, "id": len(self.rows[table]) + 1, **self.DEFAULTS[table], **values}
        if table == "items":
            row.setdefault("quantity_left", float(row["quantity"]))
            row.setdefault("date_purchased", D(2026, 4, 10))
        self.rows[table].append(row)
        return row["id"]

    def receipt(self, day, *items, **values):
        total = sum(i.get("quantity", 1) * i.get("unit_c", 100) - i.get("discount_c", 0) for i in items)
        rid = self.add("receipts", **{"purchase_date": day, "total_c": total, **values})
        for i in items:
            self.add("items", **{"receipt_id": rid, "date_purchased": day, **({"household_id": values["household_id"]} if "household_id" in values else {}), **i})
        return rid

    def statement(self, month, bank="Sparkasse", **values):
        year, number = month
        return self.add("statements", bank=bank, month_index=year * 12 + number - 1, **values)

    def ledger(self, categories=None):
        frames = {}
        for name, schema in SCHEMAS.items():
            if name == "categories":
                continue
            names = [p.strip().split(" ")[0] for p in schema.split(",")]
            rows = [tuple(r.get(c) for c in names) for r in self.rows[name]]
            frames[name] = self.spark.createDataFrame(rows, schema)
        return Ledger(categories=categories or seed_categories(self.spark), **frames)


def rows(df, *columns):
    """Sorted tuples of a frame."""
    found = df.select(*columns).collect() if columns else df.collect()
    return sorted((tuple(r) for r in found), key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


def one(df):
    found = df.collect()
    assert len(found) == 1, found
    return found[0].asDict()


__all__ = ["Book", "D", "F", "one", "rows"]
