"""A household ledger derived from the star-schema sample tables.

Every table is one SQL text that Spark and DuckDB both run (`~/` stands for whole-number division), so the
same data feeds an operator and its comparison query.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..schema import Later, Ledger, seed_categories, seed_rows
from .scratch import new_folder

SOURCES = ("orders", "lineitem", "part", "events", "customer")
TABLES = ("items", "receipts", "bookings", "statements", "questions", "rules", "plans", "splits")

# Order matters: later texts read earlier ones.
VIEWS = {
    "order_days": """
SELECT o_orderkey AS okey, o_custkey AS ckey, o_custkey % 50 AS household_id, (o_custkey ~/ 50) % 2 AS who,
       o_orderstatus AS ostatus, o_orderpriority AS oprio, cast(o_orderdate AS date) AS odate,
       cast(round(o_totalprice * 100) AS bigint) AS price_c
FROM orders""",
    "lines": """
SELECT o.okey, o.household_id, o.who, o.odate, p_name, p_brand, p_type, p_size, l_returnflag,
       cast(l_quantity AS int) AS qty, cast(round(l_extendedprice * 100) AS bigint) AS ext_c,
       cast(round(l_discount * 100) AS bigint) AS disc_pct,
       row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
           l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS rn
FROM lineitem JOIN order_days o ON o.okey = l_orderkey JOIN part ON p_partkey = l_partkey""",
    "items": """
SELECT household_id, okey * 1000 + rn AS id, okey AS receipt_id, p_name AS name, p_brand AS brand,
       qty AS quantity, ext_c ~/ qty AS unit_c, (ext_c * disc_pct) ~/ 100 AS discount_c,
       CASE p_type WHEN 'STANDARD' THEN 'Food' WHEN 'ECONOMY' THEN 'Drinks' WHEN 'MEDIUM' THEN 'Living'
            WHEN 'SMALL' THEN 'Medicine' WHEN 'PROMO' THEN 'Food' ELSE 'Other' END AS category,
       CASE p_size % 3 WHEN 0 THEN 'Normal' WHEN 1 THEN 'Kept Cool' ELSE 'Frozen' END AS storage_condition,
       odate AS date_purchased,
       CASE WHEN p_size % 10 = 0 THEN cast(NULL AS date) ELSE odate + cast(p_size * 8 AS int) END AS date_expiry,
       CASE WHEN p_size % 17 = 0 THEN cast(NULL AS string) WHEN p_type = 'STANDARD' THEN 'groceries'
            WHEN p_type = 'ECONOMY' THEN 'beverages' WHEN p_type = 'MEDIUM' THEN 'household_supplies'
            WHEN p_type = 'PROMO' THEN 'eating_out' WHEN p_type = 'SMALL' THEN 'pharmacy'
            ELSE 'old_key' END AS spend_category,
       CASE l_returnflag WHEN 'R' THEN 'Spoiled' WHEN 'A' THEN 'Consumed' ELSE 'Available' END AS status,
       CASE WHEN l_returnflag <> 'N' THEN cast(0 AS double) WHEN rn % 2 = 0 THEN cast(qty AS double) / 2
            ELSE cast(qty AS double) END AS quantity_left,
       CASE WHEN l_returnflag = 'R' THEN cast((qty + 1) ~/ 2 AS double) ELSE cast(0 AS double) END AS wasted_quantity,
       CASE WHEN l_returnflag = 'R' THEN odate + cast(10 + rn % 5 AS int) END AS wasted_on,
       CASE WHEN l_returnflag = 'R' THEN CASE okey % 4 WHEN 0 THEN 'expired' WHEN 1 THEN 'spoiled'
                 WHEN 2 THEN 'disliked' ELSE cast(NULL AS string) END
            WHEN l_returnflag = 'A' AND okey % 9 = 0 THEN 'gave_away'
            WHEN l_returnflag = 'A' AND okey % 9 = 1 THEN 'cleared' END AS waste_reason,
       CASE WHEN okey % 4 = 0 THEN odate + 3 END AS opened_on,
       CASE WHEN rn % 2 = 0 THEN 5 END AS days_once_opened,
       CASE WHEN l_returnflag = 'N' THEN cast(NULL AS date) WHEN l_returnflag = 'R' THEN odate + cast(10 + rn % 5 AS int)
            WHEN okey % 3 = 0 THEN odate + cast(p_size * 8 - 1 AS int) ELSE odate + 7 END AS finished_on,
       'shelf ' || cast(rn % 3 AS string) AS location,
       CASE WHEN okey % 6 > 0 THEN cast(okey % 6 AS int) END AS rating,
       CASE okey % 7 WHEN 0 THEN true WHEN 1 THEN false END AS would_rebuy
FROM lines""",
    "receipts": """
SELECT household_id, receipt_id AS id, 'Store ' || cast(receipt_id % 12 AS string) AS store_name, total_c, discount_c,
       purchase_date, receipt_id % 3 = 0 AS linked, 'P' || cast(who AS string) AS owner,
       'rcpt-' || cast(receipt_id AS string) AS file_hash,
       CASE WHEN receipt_id % 2 = 0 THEN 'R' || cast(receipt_id AS string) END AS receipt_number,
       CASE WHEN receipt_id % 4 = 0 THEN 'BC' || cast(receipt_id AS string) || '-77' END AS payment_reference,
       'Card' AS payment_method,
       CASE WHEN receipt_id % 11 = 0 THEN 'needs_review' ELSE 'ok' END AS status,
       CASE WHEN receipt_id % 11 = 0 THEN 'date not visible' END AS review_note
FROM (SELECT household_id, okey AS receipt_id, who, odate AS purchase_date,
             cast(sum(qty * (ext_c ~/ qty) - (ext_c * disc_pct) ~/ 100) AS bigint) AS total_c,
             cast(sum((ext_c * disc_pct) ~/ 100) AS bigint) AS discount_c
      FROM lines GROUP BY household_id, okey, who, odate) r""",
    "raw_bookings": """
SELECT household_id, id * 10 + 1 AS id, who,
       CASE WHEN id % 13 = 0 THEN 'N26' WHEN ckey % 3 = 0 THEN 'Sparkasse' WHEN ckey % 3 = 1 THEN 'N26'
            ELSE 'Commerzbank' END AS bank,
       pdate + cast(id % 5 AS int) AS booking_date,
       CASE WHEN id % 2 = 0 THEN pdate END AS purchase_date, -total_c AS amount_c,
       CASE WHEN id % 5 = 1 AND id % 3 <> 0 THEN 'PayPal Europe' WHEN id % 5 = 2 THEN 'STORE ' || cast(id % 12 AS string) || ' GmbH'
            ELSE 'Store ' || cast(id % 12 AS string) END AS counterparty,
       CASE WHEN id % 20 = 1 OR id % 20 = 6 THEN 'PayPal Europe PP' || cast(id AS string) || ' Einkauf'
            WHEN id % 5 = 1 THEN 'Ihr Einkauf bei Shop ' || cast(id % 9 AS string) || ', PayPal'
            ELSE 'Kartenzahlung   Store ' || cast(id % 12 AS string) END AS description,
       CASE WHEN id % 5 = 1 THEN 'PayPal' ELSE 'Card' END AS channel,
       CASE WHEN id % 4 = 0 THEN 'BC' || cast(id AS string) END AS payment_reference,
       CASE WHEN id % 13 = 0 THEN 'fee' WHEN id % 17 = 0 THEN 'cash' WHEN id % 19 = 0 THEN 'other' ELSE 'spend' END AS kind,
       CASE WHEN id % 13 = 0 OR id % 17 = 0 THEN cast(NULL AS string)
            ELSE CASE id % 7 WHEN 0 THEN 'groceries' WHEN 1 THEN 'eating_out' WHEN 2 THEN 'shopping_general'
                 WHEN 3 THEN 'old_key' WHEN 4 THEN cast(NULL AS string) WHEN 5 THEN 'rent' ELSE 'insurance' END END AS category,
       CASE WHEN id % 3 = 0 THEN id END AS receipt_id,
       CASE WHEN id % 3 = 0 THEN 'auto' END AS link_status,
       CASE WHEN id % 3 = 0 THEN 'same amount' END AS link_reason,
       cast(NULL AS bigint) AS transfer_group, cast(NULL AS bigint) AS mirror_of
FROM (SELECT r.household_id, r.id, r.total_c, r.purchase_date AS pdate, o.who, o.ckey
      FROM receipts r JOIN order_days o ON o.okey = r.id) s
UNION ALL
SELECT household_id, id * 10 + 2, cast(CASE owner WHEN 'P0' THEN 0 ELSE 1 END AS bigint), 'PayPal',
       purchase_date + cast(id % 4 AS int), cast(NULL AS date),
       CASE WHEN id % 7 = 0 THEN 1 - total_c ELSE -total_c END,
       'Shop ' || cast(id % 9 AS string), 'PayPal payment Shop ' || cast(id % 9 AS string), 'PayPal',
       'PP' || cast(id AS string), 'spend', CASE id % 4 WHEN 0 THEN 'hobbies' WHEN 1 THEN 'gifts' WHEN 2 THEN 'clothing' END,
       cast(NULL AS bigint), CASE WHEN id % 2 = 0 THEN 'auto' END, CASE WHEN id % 2 = 0 THEN 'same number' END,
       cast(NULL AS bigint), CASE WHEN id % 2 = 0 THEN id * 10 + 1 END
FROM receipts WHERE id % 5 = 1 AND id % 3 <> 0
UNION ALL
SELECT household_id, okey * 10 + 3, who, 'Sparkasse', odate, cast(NULL AS date),
       CASE WHEN okey % 3 = 0 THEN -10000 * (1 + okey % 5) ELSE -price_c END,
       'Own account', 'Umbuchung', 'SEPA', cast(NULL AS string),
       CASE WHEN okey % 8 = 0 THEN 'investment' ELSE 'internal_transfer' END, cast(NULL AS string),
       cast(NULL AS bigint), CASE WHEN okey % 10 = 0 THEN 'auto' END, CASE WHEN okey % 10 = 0 THEN 'same amount' END,
       CASE WHEN okey % 10 = 0 THEN okey * 10 + 3 END, cast(NULL AS bigint)
FROM order_days WHERE ostatus = 'P'
UNION ALL
SELECT household_id, okey * 10 + 4, who, 'N26', odate + cast(okey % 7 AS int), cast(NULL AS date),
       CASE WHEN okey % 3 = 0 THEN 10000 * (1 + okey % 5) WHEN okey % 6 = 1 THEN price_c + 1 ELSE price_c END,
       'Own account', 'Umbuchung', 'SEPA', cast(NULL AS string), 'internal_transfer', cast(NULL AS string),
       cast(NULL AS bigint), CASE WHEN okey % 10 = 0 THEN 'auto' END, CASE WHEN okey % 10 = 0 THEN 'same amount' END,
       CASE WHEN okey % 10 = 0 THEN okey * 10 + 3 END, cast(NULL AS bigint)
FROM order_days WHERE ostatus = 'P'
UNION ALL
SELECT household_id, okey * 10 + 5, who, CASE WHEN okey % 2 = 0 THEN 'N26' ELSE 'Commerzbank' END,
       odate, cast(NULL AS date),
       CASE WHEN okey % 11 = 0 THEN 1000 * (1 + okey % 5) ELSE -1000 * (1 + okey % 5) END,
       CASE WHEN okey % 2 = 0 THEN 'N26 Securities' ELSE 'ETF ' || cast(okey % 5 AS string) END,
       CASE WHEN okey % 2 = 1 THEN 'Sparplan WPKNR: A2DK0' || cast(okey % 5 AS string)
            WHEN okey % 9 = 0 THEN 'payment hold IE00B4L5Y98' || cast(okey % 10 AS string) || ' for buy'
            ELSE 'payment hold  for buy' END,
       'SEPA', cast(NULL AS string), CASE WHEN okey % 23 = 0 THEN 'internal_transfer' ELSE 'investment' END,
       cast(NULL AS string), cast(NULL AS bigint), CASE WHEN okey % 23 = 0 THEN 'confirmed' END,
       CASE WHEN okey % 23 = 0 THEN 'set by household: not an investment' END, cast(NULL AS bigint), cast(NULL AS bigint)
FROM order_days WHERE oprio = '1-URGENT'
UNION ALL
SELECT user_id % 50, event_id * 10 + 6, cast(0 AS bigint),
       CASE event_type WHEN 'error' THEN 'Commerzbank' WHEN 'view' THEN 'N26' ELSE 'Sparkasse' END,
       cast(ts AS date) + cast(30 * (event_id % 12) AS int), cast(NULL AS date),
       CASE WHEN event_type = 'purchase' AND event_id % 4 <> 0 THEN -(1000 + 500 * (event_id % 20))
            WHEN event_type IN ('signup', 'click') THEN cast(round(value * 100) AS bigint) + 100
            ELSE -cast(round(value * 100) AS bigint) - 1 END,
       CASE event_type WHEN 'purchase' THEN 'Payee ' || substr('abcdefghijklmnopqrst', cast(1 + event_id % 20 AS int), 1) || ' GmbH'
            WHEN 'signup' THEN 'Employer' WHEN 'click' THEN 'Shop' WHEN 'error' THEN 'Bank' ELSE 'N26' END,
       CASE WHEN event_type = 'view' AND event_id % 2 = 0 THEN 'Equities tax' ELSE event_type || ' booking' END,
       'SEPA', cast(NULL AS string),
       CASE event_type WHEN 'purchase' THEN 'spend' WHEN 'signup' THEN 'income' WHEN 'click' THEN 'refund'
            WHEN 'error' THEN 'fee' ELSE 'spend' END,
       CASE WHEN event_type = 'purchase' THEN CASE event_id % 5 WHEN 0 THEN 'subscriptions' WHEN 1 THEN 'insurance'
                 WHEN 2 THEN 'hobbies' WHEN 3 THEN cast(NULL AS string) ELSE 'internet_phone' END
            WHEN event_type = 'signup' THEN CASE event_id % 3 WHEN 0 THEN 'salary' WHEN 1 THEN cast(NULL AS string) ELSE 'rent' END
            WHEN event_type = 'view' THEN 'taxes_fees' END,
       cast(NULL AS bigint), cast(NULL AS string), cast(NULL AS string), cast(NULL AS bigint), cast(NULL AS bigint)
FROM events""",
    "bookings": """
SELECT household_id, id,
       ((year(booking_date) * 12 + month(booking_date) - 1) * 100 + household_id) * 10
         + CASE bank WHEN 'Sparkasse' THEN 0 WHEN 'N26' THEN 2 WHEN 'Commerzbank' THEN 4 ELSE 6 END + who AS statement_id,
       booking_date, purchase_date, cast(amount_c AS bigint) AS amount_c, counterparty, description, channel,
       payment_reference, kind, category, receipt_id, link_status, link_reason, transfer_group, mirror_of
FROM raw_bookings""",
    "statements": """
SELECT household_id, statement_id AS id,
       CASE (statement_id % 10) ~/ 2 WHEN 0 THEN 'Sparkasse' WHEN 1 THEN 'N26' WHEN 2 THEN 'Commerzbank' ELSE 'PayPal' END AS bank,
       CASE WHEN statement_id % 2 = 0 THEN 'P0' ELSE 'P1' END AS owner,
       cast(statement_id ~/ 1000 AS int) AS month_index,
       CASE WHEN partial_doc THEN cast(NULL AS bigint) ELSE cast(running_c - moved_c AS bigint) END AS opening_c,
       CASE WHEN partial_doc THEN cast(NULL AS bigint)
            ELSE cast(running_c + CASE WHEN (statement_id ~/ 10) % 97 = 0 THEN 5 ELSE 0 END AS bigint) END AS closing_c,
       NOT partial_doc AS has_balances,
       cast(date_trunc('month', first_day) AS date) AS period_start, last_day(first_day) AS period_end,
       'stmt-' || cast(statement_id AS string) AS file_hash, 'ok' AS status, cast(NULL AS string) AS review_note
FROM (SELECT household_id, statement_id, first_day, moved_c,
             (statement_id % 10) ~/ 2 = 3 OR (statement_id ~/ 1000) % 31 = 0 AS partial_doc,
             sum(moved_c) OVER (PARTITION BY household_id, statement_id % 10 ORDER BY statement_id
                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running_c
      FROM (SELECT household_id, statement_id, min(booking_date) AS first_day, sum(amount_c) AS moved_c
            FROM bookings GROUP BY household_id, statement_id) g) s""",
    "questions": """
SELECT household_id, okey * 10 AS id, 'receipt_match' AS kind, okey * 10 + 1 AS transaction_id, okey AS receipt_id,
       cast(NULL AS bigint) AS other_transaction_id, 'Same purchase?' AS question,
       CASE okey % 29 WHEN 0 THEN 'open' WHEN 1 THEN 'no' ELSE 'yes' END AS status
FROM order_days WHERE ostatus = 'O' AND okey % 29 < 3
UNION ALL
SELECT household_id, okey * 10 + 1, 'transfer_match', okey * 10 + 3, cast(NULL AS bigint), okey * 10 + 4,
       'Same money?', CASE okey % 31 WHEN 0 THEN 'open' ELSE 'no' END
FROM order_days WHERE ostatus = 'P' AND okey % 31 < 2""",
    "rules": """
SELECT DISTINCT user_id % 50 AS household_id,
       'payee-' || substr('abcdefghijklmnopqrst', cast(1 + event_id % 20 AS int), 1) AS key,
       CASE WHEN event_id % 20 = 5 THEN 'quarterly' END AS frequency, event_id % 20 = 3 AS hidden
FROM events WHERE event_type = 'purchase' AND event_id % 20 IN (3, 5)""",
    "plans": """
SELECT c_custkey % 50 AS household_id, c_custkey AS id,
       CASE WHEN c_custkey % 4 < 3 THEN 'N26' ELSE 'Commerzbank' END AS broker,
       'ETF ' || cast(c_custkey % 7 AS string) AS instrument, 1000 * (1 + (c_custkey ~/ 50) % 5) AS amount_c,
       CASE c_custkey % 3 WHEN 0 THEN 'weekly' WHEN 1 THEN 'biweekly' ELSE 'monthly' END AS frequency,
       CASE WHEN (c_custkey ~/ 50) % 4 <> 0 THEN date '1996-01-03' + cast(c_custkey % 29 AS int) END AS anchor_date,
       CASE WHEN c_custkey % 6 <> 0 THEN date '1995-06-01' + cast(c_custkey % 700 AS int) END AS start_date,
       CASE WHEN c_custkey % 5 = 0 THEN date '1997-12-01' + cast(c_custkey % 900 AS int) END AS end_date,
       cast(NULL AS string) AS note
FROM customer""",
    "splits": """
SELECT DISTINCT household_id, substr(sha1(CASE WHEN id % 20 = 5 THEN 'N26' ELSE 'Commerzbank' END || '|'
         || cast(booking_date AS string) || '|' || CASE WHEN amount_c > 0 THEN '-' ELSE '' END
         || cast(abs(amount_c) ~/ 100 AS string) || '.00|' || regexp_replace(description, '  ', ' ')), 1, 16) AS booking_ref,
       'Typed' AS instrument, -amount_c AS amount_c
FROM bookings WHERE id % 10 = 5 AND (id ~/ 10) % 37 = 0""",
}


def _duck(text: str) -> str:
    return text.replace("~/", "//")


def _literal(value) -> str:
    if value is None:
        return "cast(NULL AS varchar)"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, int):
        return str(value)
    return "'" + value.replace("'", "''") + "'"


def comparison_prelude() -> str:
    """WITH clause that gives DuckDB the same ledger tables."""
    rows = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in seed_rows())
    cats = (
        "categories AS (SELECT * FROM (VALUES " + rows + ") c(key, label, group_name, flow, fixed, description, "
        "sort_order, active))"
    )
    return "WITH " + ",\n".join([f"{name} AS ({_duck(text)})" for name, text in VIEWS.items()] + [cats])


# Spark joins the texts' tables in the order they are written in. With the order last, one exchange by order key serves the join, the numbering of the
# lines and the sum of a receipt; the rows are those of the text above.
AS_WRITTEN = "FROM lineitem JOIN order_days o ON o.okey = l_orderkey JOIN part ON p_partkey = l_partkey"
BY_ORDER = "FROM lineitem JOIN part ON p_partkey = l_partkey JOIN order_days o ON o.okey = l_orderkey"

# Where the items are written, receipts are summed from them: the lines of an order lie together there. `who` of the order is kept with them for that.
FROM_LINES = VIEWS["receipts"][VIEWS["receipts"].index("FROM (SELECT"):]
FROM_ITEMS = """FROM (SELECT household_id, receipt_id, _who AS who, date_purchased AS purchase_date,
             cast(sum(quantity * unit_c - discount_c) AS bigint) AS total_c, cast(sum(discount_c) AS bigint) AS discount_c
      FROM items GROUP BY household_id, receipt_id, _who, date_purchased) r"""

_DERIVED: dict[tuple[str, str, str], tuple[str, StructType]] = {}


def _derived(spark: SparkSession, sf_dir: str, name: str, write: bool = True, whole: bool = False) -> DataFrame:
    """A table of the sample or of the ledger. Ledger tables are written once per application, when they are first asked for; without `write` a table that is
    not there yet is derived where it is read. `whole` keeps the columns that serve other tables."""
    if name in SOURCES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    done = (spark.sparkContext.applicationId, sf_dir, name)
    if done not in _DERIVED:
        text = VIEWS[name].replace(AS_WRITTEN, BY_ORDER)
        if name == "receipts" and (*done[:2], "items") in _DERIVED:
            text = text.replace(FROM_LINES, FROM_ITEMS)
        if name == "items" and write:
            text = text.replace("\nFROM lines", ", who AS _who\nFROM lines")
        text = text.replace("~/", "div")
        used = {other: _derived(spark, sf_dir, other, whole=True) for other in re.findall(r"\b(?:FROM|JOIN) (\w+)\b", text) if other in SOURCES or other in VIEWS}
        for other, df in used.items():
            df.createOrReplaceTempView(f"star_{other}")
        rows = spark.sql(_prefixed(text, [*SOURCES, *VIEWS]))
        for other in used:
            spark.catalog.dropTempView(f"star_{other}")
        if name not in TABLES or not write:
            return rows
        path = new_folder(spark)
        rows.write.parquet(path)
        _DERIVED[done] = path, rows.schema
    path, schema = _DERIVED[done]
    return spark.read.schema(schema if whole else StructType([f for f in schema if not f.name.startswith("_")])).parquet(path)


def _prefixed(text: str, names: list[str]) -> str:
    return re.sub(r"\b(FROM|JOIN) (" + "|".join(names) + r")\b", r"\1 star_\2", text)


def star_ledger(spark: SparkSession, sf_dir: str, once: tuple = ()) -> Ledger:
    """The ledger over the sample tables in `sf_dir`. A table is derived and written when it is first asked for, with those it is made of, then only read.

    Tables in `once` are read a single time: they are derived as part of that reading, which carries the columns it needs and no others.
    """
    never = F.lit(None).cast("timestamp")
    more = {
        "questions": lambda df: df.withColumn("created_at", never).withColumn("answered_at", never),
        "splits": lambda df: df.withColumn("id", F.xxhash64("household_id", "booking_ref")),
    }
    made = lambda name: Later(lambda: more.get(name, lambda df: df)(_derived(spark, sf_dir, name, write=name not in once)))
    return Ledger(categories=seed_categories(spark), **{name: made(name) for name in TABLES})
