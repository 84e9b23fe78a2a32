"""Quality checks, loads, links and batches of changes, on submissions and changes derived from the whole ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as E
from ..operators import links as K
from ..operators import loads as O
from ..operators import matching as X
from ..operators import quality as Q
from ..operators import upkeep as U
from ..schema import SCHEMAS, Ledger, legacy_by_key
from ..sources import ledger as S
from ..sources.scratch import new_folder
from .common import MONTH, TODAY, YEAR, Query, big, mi

T = f"date '{TODAY}'"


def derived(L: Ledger, text: str):
    """Rows Spark derives from the ledger; the same text runs in the comparison."""
    used = {t: getattr(L, t) for t in SCHEMAS if "{" + t + "}" in text}
    return L.spark.sql(text.replace("~/", "div"), **used)


def plain(text: str) -> str:
    return text.format(**{t: t for t in SCHEMAS}).replace("~/", "//")


RECEIPT_HEADS = """
SELECT household_id, id AS doc_id, CASE WHEN id % 5 = 0 THEN 'rcpt-' || id ELSE 'new-' || id END AS doc_hash, owner,
 CASE WHEN id % 5 IN (1, 2, 3) THEN 'New ' || store_name ELSE store_name END AS store_name,
 CASE WHEN id % 37 = 0 THEN purchase_date + 4000 WHEN id % 41 = 0 THEN purchase_date - 2500 ELSE purchase_date END AS purchase_date,
 CASE WHEN id % 7 = 0 THEN total_c + 3 WHEN id % 43 = 0 THEN cast(-5 AS bigint) ELSE total_c END AS total_c, payment_method,
 receipt_number, payment_reference, CASE WHEN id % 6 = 0 THEN 'please look' END AS review_note FROM {receipts}"""
RECEIPT_LINES = """
SELECT household_id, receipt_id AS doc_id, id AS line_no, name, brand, quantity, CASE WHEN id % 50 = 1 THEN -unit_c ELSE unit_c END AS unit_c,
 discount_c, spend_category, storage_condition, cast(id % 90 AS int) AS estimated_shelf_life_days, days_once_opened FROM {items}"""
STATEMENT_HEADS = """
SELECT household_id, id AS doc_id, CASE WHEN id % 3 = 0 THEN file_hash ELSE 'again-' || id END AS doc_hash, owner, bank,
 CASE WHEN id % 13 = 0 THEN period_end + 5 ELSE period_start END AS period_start, period_end, opening_c,
 CASE WHEN id % 7 = 0 THEN closing_c + 10 ELSE closing_c END AS closing_c, CASE WHEN id % 11 = 0 THEN 'unsure' END AS review_note FROM {statements}"""
STATEMENT_LINES = """
SELECT household_id, statement_id AS doc_id, id AS line_no, CASE WHEN id % 19 = 0 THEN booking_date + 1 ELSE booking_date END AS booking_date,
 purchase_date, amount_c, counterparty, description, channel, payment_reference, kind, category FROM {bookings}"""
LINKS = {
    "receipt_match": "SELECT household_id, id * 10 + 1 AS transaction_id, CASE WHEN id % 4 = 0 THEN id + 1 ELSE id END AS receipt_id, 'asked' AS reason FROM {receipts}",
    "transfer_match": "SELECT household_id, id AS out_id, CASE WHEN id % 4 = 0 THEN id ELSE id + 1 END AS in_id, 'asked' AS reason FROM {bookings} WHERE kind IN ('internal_transfer', 'investment')",
    "mirror_match": "SELECT household_id, id * 10 + 2 AS paypal_id, id * 10 + 1 AS bank_id, 'asked' AS reason FROM {receipts}",
}
ANSWERS = """
SELECT household_id, id AS question_id, id % 3 <> 0 AS yes, cast('2001-08-02 10:00:00' AS timestamp) AS ts FROM {questions}"""
EVENTS = """
SELECT household_id, id AS item_id, id * 10 + 1 AS event_id, cast('2001-08-02 10:00:00' AS timestamp) AS ts, date '2001-08-02' AS day,
 CASE id % 7 WHEN 0 THEN 'use' WHEN 1 THEN 'finish' WHEN 2 THEN 'open' WHEN 3 THEN 'discard' WHEN 4 THEN 'freeze' WHEN 5 THEN 'update' ELSE 'use' END AS action,
 CASE WHEN id % 7 = 0 THEN cast(2 AS double) WHEN id % 7 = 3 AND id % 2 = 0 THEN cast(1 AS double) WHEN id % 7 = 6 THEN cast(-1 AS double) END AS amount,
 CASE WHEN id % 7 = 3 THEN CASE id % 5 WHEN 0 THEN 'spoiled' WHEN 1 THEN 'gave_away' WHEN 2 THEN 'nonsense' ELSE 'too_much' END END AS reason,
 CASE WHEN id % 7 = 5 THEN ' cellar ' END AS location, cast(NULL AS date) AS date_expiry, CASE WHEN id % 7 = 5 THEN cast(id % 8 AS int) END AS rating,
 cast(NULL AS boolean) AS would_rebuy FROM {items}
UNION ALL
SELECT household_id, id, id * 10 + 2, cast('2001-08-03 10:00:00' AS timestamp), date '2001-08-03', 'use', cast(1 AS double), cast(NULL AS string),
 cast(NULL AS string), cast(NULL AS date), cast(NULL AS int), cast(NULL AS boolean) FROM {items}"""
PLAN_CHANGES = """
SELECT household_id, id AS change_id, id AS plan_id, CASE id % 6 WHEN 0 THEN 'suspend' WHEN 1 THEN 'resume' WHEN 2 THEN 'change' WHEN 3 THEN 'delete'
 WHEN 4 THEN 'correct' ELSE 'create' END AS action, date '2001-08-02' AS on_date, CASE WHEN id % 6 = 5 THEN 'N26' END AS broker,
 CASE WHEN id % 6 = 5 THEN ' ETF new ' END AS instrument, CASE WHEN id % 6 IN (2, 4, 5) THEN amount_c + 500 END AS amount_c,
 CASE WHEN id % 6 = 5 THEN 'monthly' WHEN id % 12 = 2 THEN 'weekly' END AS frequency, cast(NULL AS date) AS anchor_date,
 cast(NULL AS date) AS start_date, cast(NULL AS date) AS end_date, cast(NULL AS string) AS note FROM {plans}"""
CATEGORY_MAP = """
SELECT source, target FROM (VALUES ('eating_out', 'takeaway'), ('beverages', cast(NULL AS string)), ('salary', 'rent'), ('old_key', 'groceries'),
 ('gifts', 'gifts'), ('pharmacy', 'medical')) m(source, target)"""
CATEGORY_CHANGES = """
SELECT household_id, CASE id % 10 WHEN 0 THEN 'x' || id WHEN 1 THEN 'i' || (id + 900) ELSE 'i' || id END AS ref,
 CASE id % 4 WHEN 0 THEN 'pets' WHEN 1 THEN 'salary' WHEN 2 THEN 'nothing' ELSE cast(NULL AS string) END AS category FROM {items}
UNION ALL SELECT household_id, 't' || id, CASE id % 3 WHEN 0 THEN 'pets' WHEN 1 THEN 'salary' ELSE 'gone' END FROM {bookings}"""

SUBMITTED = f"rh AS ({plain(RECEIPT_HEADS)}), rl AS ({plain(RECEIPT_LINES)}), sh AS ({plain(STATEMENT_HEADS)}), sl AS ({plain(STATEMENT_LINES)})"
CATEGORY_PROBLEM = ("CASE WHEN {c} IS NULL THEN 'missing_category' WHEN k.key IS NULL THEN 'unknown_category' WHEN k.flow <> {f} THEN 'wrong_flow' END")
RECEIPT_PROBLEMS = f"""{SUBMITTED},
lp AS (SELECT rl.*, {CATEGORY_PROBLEM.format(c='spend_category', f="'expense'")} AS cp FROM rl LEFT JOIN categories k ON k.key = spend_category AND k.active),
ls AS (SELECT household_id, doc_id, sum(quantity * unit_c - discount_c) AS sm, bool_or(unit_c < 0 AND spend_category IS DISTINCT FROM 'deposit') AS neg,
 string_agg(DISTINCT cp, ',' ORDER BY cp) AS cats FROM lp GROUP BY ALL),
rp AS (SELECT rh.*, concat_ws(',', CASE WHEN ls.doc_id IS NULL THEN 'no_items' END, CASE WHEN purchase_date > {T} THEN 'future_date' END,
 CASE WHEN {T} - purchase_date > 1830 THEN 'too_old' END, CASE WHEN total_c <= 0 THEN 'total_not_positive' END, CASE WHEN neg THEN 'negative_price' END,
 CASE WHEN abs(coalesce(sm, 0) - total_c) > 2 THEN 'sum_mismatch' END, cats) AS problems FROM rh LEFT JOIN ls USING (household_id, doc_id))"""
FLOW = "CASE WHEN kind IN ('income', 'refund') OR (kind = 'other' AND amount_c > 0) THEN 'income' ELSE 'expense' END"
STATEMENT_PROBLEMS = f"""{SUBMITTED},
lq AS (SELECT sl.*, CASE WHEN kind IN ('internal_transfer', 'investment') OR (category IS NULL AND kind IN ('fee', 'cash', 'other')) THEN NULL
  ELSE {CATEGORY_PROBLEM.format(c='category', f=FLOW)} END AS cp FROM sl LEFT JOIN categories k ON k.key = category AND k.active),
lt AS (SELECT household_id, doc_id, sum(amount_c) AS sm, min(booking_date) AS a, max(booking_date) AS b, string_agg(DISTINCT cp, ',' ORDER BY cp) AS cats FROM lq GROUP BY ALL),
sp AS (SELECT sh.*, concat_ws(',', CASE WHEN period_start > period_end THEN 'period_reversed' END, CASE WHEN b - a > 40 THEN 'mixed_days' END,
 CASE WHEN abs(sm - (closing_c - opening_c)) > 2 THEN 'balance_mismatch' END, cats) AS problems FROM sh LEFT JOIN lt USING (household_id, doc_id)),
mc AS (SELECT household_id, doc_id, {mi('booking_date')} AS m, count(*) AS n FROM sl GROUP BY ALL),
mm AS (SELECT household_id, doc_id, max(m) AS m, count(*) AS k FROM (SELECT *, max(n) OVER (PARTITION BY household_id, doc_id) AS top FROM mc) x WHERE n = top GROUP BY ALL),
sm AS (SELECT sh.*, cast(CASE WHEN k = 1 THEN m ELSE {mi('period_end')} END AS int) AS month_index FROM sh LEFT JOIN mm USING (household_id, doc_id))"""

WARNINGS = """CASE WHEN m.bank = 'PayPal' THEN '' ELSE concat_ws(',', CASE WHEN m.closing_c IS NOT NULL AND abs(p.closing_c - m.opening_c) > 2 THEN 'opening_differs' END,
 CASE WHEN m.closing_c IS NOT NULL AND abs(n.opening_c - m.closing_c) > 2 THEN 'closing_differs' END, CASE WHEN m.closing_c IS NULL THEN 'no_balances' END) END"""
NEIGHBOURS = """LEFT JOIN statements p ON p.household_id = m.household_id AND p.bank = m.bank AND p.owner = m.owner AND p.month_index = m.month_index - 1
LEFT JOIN statements n ON n.household_id = m.household_id AND n.bank = m.bank AND n.owner = m.owner AND n.month_index = m.month_index + 1"""
STOCK_EVENTS = """e0 AS (SELECT i.*, id % 7 AS a, spend_category IS NULL OR spend_category NOT IN ('eating_out', 'takeaway', 'deposit') AS known,
  CASE WHEN c.key IS NOT NULL THEN c.group_name = 'Food' ELSE i.category IN ('Food', 'Drinks') END AS food,
  CASE id % 5 WHEN 0 THEN 'spoiled' WHEN 1 THEN 'gave_away' WHEN 2 THEN 'nonsense' ELSE 'too_much' END AS why FROM items i LEFT JOIN categories c ON c.key = i.spend_category),
e1 AS (SELECT *, CASE WHEN NOT known THEN 'no_such_item' WHEN a = 5 THEN CASE WHEN id % 8 IN (0, 6, 7) THEN 'rating_out_of_range' END
  WHEN a = 3 AND why = 'nonsense' THEN 'unknown_reason' WHEN quantity_left <= 0 THEN 'nothing_left'
  WHEN a = 4 THEN CASE WHEN NOT food THEN 'only_food_can_be_frozen' WHEN storage_condition = 'Frozen' THEN 'already_frozen' END
  WHEN a = 6 THEN 'amount_not_positive' END AS p1 FROM e0),
e2 AS (SELECT *, p1 IS NULL AND a = 3 AS tossed, CASE WHEN id % 2 = 0 THEN least(1.0::double, quantity_left) ELSE quantity_left END AS amt FROM e1),
e3 AS (SELECT *, left1 > 0 AND left1 <= 1 AND known AS fin2, p1 IS NULL AND a IN (0, 1, 3) AND left1 <= 0 AS fin1 FROM (SELECT *, CASE WHEN p1 IS NOT NULL THEN quantity_left
   WHEN a = 0 THEN greatest(0.0::double, quantity_left - 2) WHEN a = 1 THEN 0.0::double WHEN a = 3 THEN quantity_left - amt ELSE quantity_left END AS left1,
  wasted_quantity + CASE WHEN tossed AND why <> 'gave_away' THEN amt ELSE 0 END AS wq, CASE WHEN tossed THEN why ELSE waste_reason END AS wr FROM e2) x)"""
PLAN_REFUSALS = """pc AS (SELECT *, id % 6 AS k, CASE
 WHEN id % 6 = 0 THEN CASE WHEN end_date < date '2001-08-02' THEN 'already_ended' WHEN date '2001-08-01' < start_date THEN 'not_started' END
 WHEN id % 6 = 1 THEN CASE WHEN end_date IS NULL OR end_date >= date '2001-08-02' OR coalesce(start_date > date '2001-08-02', false) THEN 'not_ended' END
 WHEN id % 6 = 2 THEN CASE WHEN date '2001-08-02' <= start_date THEN 'pick_a_later_day' WHEN end_date < date '2001-08-02' THEN 'already_ended' END END AS problem FROM plans)"""


def _receipts(L: Ledger):
    return derived(L, RECEIPT_HEADS), derived(L, RECEIPT_LINES)


def _statements(L: Ledger):
    return derived(L, STATEMENT_HEADS), derived(L, STATEMENT_LINES)


def _listed(L: Ledger):
    """A later, overlapping copy of every payment list: each stored payment again, and its amount once more."""
    lists = L.statements.filter(F.col("bank") == "PayPal").select("household_id", F.col("id").alias("statement_id"))
    rows = L.bookings.join(lists, ["household_id", "statement_id"])
    return rows, rows.unionByName(rows.withColumn("id", F.col("id") + 1).withColumn("counterparty", F.concat(F.lit(" "), F.upper("counterparty"))))


def _joined(df, column="problems"):
    return df.withColumn(column, F.array_join(column, ","))


def _json_round_trip(spark, L: Ledger):
    """Receipts written as nested JSON documents and read back with the fixed schema."""
    euro = lambda c: (F.col(c).cast("decimal(18,2)") / 100).cast("decimal(14,2)")
    line = F.struct(
        "name", "quantity", euro("unit_c").alias("unit_price"), euro("discount_c").alias("discount"), "spend_category",
        "storage_condition", F.lit(None).cast("int").alias("estimated_shelf_life_days"), "days_once_opened", "brand",
    )
    lines = L.items.groupBy("household_id", F.col("receipt_id").alias("id")).agg(F.collect_list(line).alias("items"))
    docs = L.receipts.join(lines, ["household_id", "id"]).select(
        "household_id", F.col("file_hash").alias("doc_hash"), "owner", "store_name", "purchase_date", euro("total_c").alias("total_amount"),
        "payment_method", "receipt_number", "payment_reference", "review_note", "items",
    )
    path = new_folder(spark)
    docs.write.json(path)
    heads, rows, _ = S.read_submissions(spark, path, "receipt")
    sums = rows.groupBy("household_id", "doc_id").agg(F.count("*").alias("lines"), F.sum(F.col("quantity") * F.col("unit_c") - F.col("discount_c")).alias("sum_c"))
    return heads.join(sums, ["household_id", "doc_id"]).select("household_id", "doc_hash", "store_name", "purchase_date", "total_c", "lines", "sum_c")


def _filed(spark, L: Ledger):
    path = new_folder(spark)
    S.write_by_month(L.receipts.select("household_id", "id", "owner", "purchase_date", "total_c"), path)
    return spark.read.parquet(path).groupBy("owner", "year", "month").agg(F.count("*").alias("receipts"), F.sum("total_c").alias("total_c"))


TX = ["household_id", "id", "kind", "category", "counterparty", "receipt_id", "transfer_group", "mirror_of", "link_status"]
PAIRS_SQL = {k: f"(SELECT * FROM ({plain(v)}) q)" for k, v in LINKS.items()}
LEGACY = "CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in legacy_by_key().items()) + " ELSE 'Other' END"

EURO = "cast(cast({} / 100.0 AS decimal(18,2)) AS varchar)"


def _asked(L: Ledger, kind: str):
    return K.questions_from(derived(L, LINKS[kind]), L, kind).select("household_id", "transaction_id", "other_transaction_id", "question", "status")


def _question_sql(kind: str, text: str) -> str:
    first, second = K.COLUMNS[kind]
    return f"""
SELECT p.household_id, p.{first} AS transaction_id, p.{second} AS other_transaction_id, substr({text}, 1, 600) AS question, 'open' AS status FROM {PAIRS_SQL[kind]} p
JOIN tx a ON a.household_id = p.household_id AND a.id = p.{first} JOIN tx b ON b.household_id = p.household_id AND b.id = p.{second}
WHERE NOT EXISTS (SELECT 1 FROM questions q WHERE q.kind = '{kind}' AND q.status IN ('open', 'yes', 'no') AND q.household_id = p.household_id AND q.transaction_id = p.{first} AND q.other_transaction_id = p.{second})"""


def statement_outcomes(columns: str = "household_id, doc_id, outcome", after: str = "") -> str:
    """What loading the derived statements comes to."""
    return f"""WITH {STATEMENT_PROBLEMS},
al AS (SELECT m.*, sp.problems, {WARNINGS} AS warnings, coalesce(o.has_balances, false) AS complete,
  EXISTS (SELECT 1 FROM statements k WHERE k.household_id = m.household_id AND k.file_hash = m.doc_hash) AS dup
 FROM sm m JOIN sp ON sp.household_id = m.household_id AND sp.doc_id = m.doc_id
 LEFT JOIN statements o ON o.household_id = m.household_id AND o.bank = m.bank AND o.owner = m.owner AND o.month_index = m.month_index
 {NEIGHBOURS}),
st AS (SELECT *, CASE WHEN dup THEN 'duplicate' WHEN problems <> '' AND review_note IS NULL THEN 'rejected'
  WHEN bank <> 'PayPal' AND closing_c IS NULL AND complete THEN 'kept_complete' END AS out FROM al),
lo AS (SELECT household_id, doc_id, CASE WHEN out IS NOT NULL THEN out
 WHEN bank <> 'PayPal' AND doc_id < max(doc_id) FILTER (out IS NULL) OVER (PARTITION BY household_id, bank, owner, month_index) THEN 'replaced_in_batch'
 WHEN review_note IS NOT NULL OR warnings <> '' THEN 'needs_review' ELSE 'ok' END AS outcome FROM st)
SELECT {columns} FROM lo {after}"""


QUERIES = [
    Query("document_identity", lambda spark, d: S.document_identity(
        spark.read.parquet(f"{d}/documents.parquet").withColumn("n", F.lit(0)), ["doc_id"], "n", "text"),
        "SELECT doc_id, sha256(text) AS sha256, cast(1 AS int) AS n_files FROM documents", raw=True),
    Query("folder_identity", lambda spark, d: S.document_identity(
        spark.read.parquet(f"{d}/conversations.parquet"), ["conv_id"], "turn", "text"), """
SELECT conv_id, CASE WHEN count(*) = 1 THEN min(sha256(text)) ELSE sha256(unhex(string_agg(sha256(text), '' ORDER BY turn))) END AS sha256, cast(count(*) AS int) AS n_files
FROM conversations GROUP BY conv_id""", raw=True),
    Query("statement_documents", lambda L: S.statement_documents(L).select("household_id", "id", F.array_join(F.transform(
        "transactions", lambda t: F.concat_ws(" ", t["date"], t["id"].cast("string"), t["description"], t["kind"])), "|").alias("transactions")), """
SELECT s.household_id, s.id, coalesce(string_agg(strftime(booking_date, '%d.%m.%Y') || ' ' || b.id || ' ' || counterparty || ': ' || description || ' ' || kind, '|' ORDER BY booking_date, b.id), '') AS transactions
FROM statements s LEFT JOIN bookings b ON b.statement_id = s.id AND b.household_id = s.household_id GROUP BY ALL"""),
    Query("receipts_with_items", lambda L: S.receipts_with_items(L, YEAR, MONTH).select("household_id", "id", "purchase_date", F.array_join(F.transform(
        "items", lambda t: F.concat_ws(" ", t["id"].cast("string"), t["name"], t["status"])), "|").alias("items")), f"""
SELECT r.household_id, r.id, purchase_date, string_agg(i.id || ' ' || name || ' ' || i.status, '|' ORDER BY i.id) AS items
FROM receipts r JOIN items i ON i.receipt_id = r.id WHERE year(purchase_date) = {YEAR} AND month(purchase_date) = {MONTH} GROUP BY ALL"""),
    Query("read_submissions", lambda L: _json_round_trip(L.spark, L), f"""
SELECT r.household_id, file_hash AS doc_hash, store_name, purchase_date, total_c, count(*) AS lines, {big('sum(quantity * unit_c - i.discount_c)')} AS sum_c
FROM receipts r JOIN items i ON i.receipt_id = r.id GROUP BY ALL"""),
    Query("write_by_month", lambda L: _filed(L.spark, L), f"""
SELECT owner, cast(year(purchase_date) AS int) AS year, ['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'][month(purchase_date)] AS month,
 count(*) AS receipts, {big('sum(total_c)')} AS total_c FROM receipts GROUP BY ALL"""),
    # checks
    Query("validate_category", lambda L: Q.validate_category(L.bookings.select("household_id", "id", "kind", "amount_c", "category"), L, "category",
          Q.E.submitted_flow("kind", "amount_c")).select("household_id", "id", "category_problem"),
          f"SELECT household_id, id, {CATEGORY_PROBLEM.format(c='category', f=FLOW)} AS category_problem FROM bookings b LEFT JOIN categories k ON k.key = category AND k.active"),
    Query("check_receipts", lambda L: _joined(Q.check_receipts(*_receipts(L), L, TODAY)).select("household_id", "doc_id", "problems"),
          f"WITH {RECEIPT_PROBLEMS} SELECT household_id, doc_id, problems FROM rp"),
    Query("check_statements", lambda L: _joined(Q.check_statements(*_statements(L), L)).select("household_id", "doc_id", "problems"),
          f"WITH {STATEMENT_PROBLEMS} SELECT household_id, doc_id, problems FROM sp"),
    Query("assign_statement_month", lambda L: O.assign_statement_month(*_statements(L), ["household_id"]).select("household_id", "doc_id", "month_index"),
          f"WITH {STATEMENT_PROBLEMS} SELECT household_id, doc_id, month_index FROM sm"),
    Query("statement_warnings", lambda L: _joined(Q.statement_warnings(O.assign_statement_month(*_statements(L), ["household_id"]), L), "warnings")
          .select("household_id", "doc_id", "warnings"), f"WITH {STATEMENT_PROBLEMS} SELECT m.household_id, doc_id, {WARNINGS} AS warnings FROM sm m {NEIGHBOURS}"),
    Query("route_submissions", lambda L: Q.route_submissions(Q.check_receipts(*_receipts(L), L, TODAY))[0].select("household_id", "doc_id", "status", "review_note"),
          f"""WITH {RECEIPT_PROBLEMS} SELECT household_id, doc_id, CASE WHEN review_note IS NULL THEN 'ok' ELSE 'needs_review' END AS status,
 CASE WHEN problems <> '' THEN review_note || ' | checks failed: ' || replace(problems, ',', ' ; ') ELSE review_note END AS review_note
FROM rp WHERE problems = '' OR review_note IS NOT NULL"""),
    Query("rejected_submissions", lambda L: Q.route_submissions(Q.check_receipts(*_receipts(L), L, TODAY))[1].select("household_id", "doc_id", "reason"),
          f"WITH {RECEIPT_PROBLEMS} SELECT household_id, doc_id, replace(problems, ',', ' ; ') AS reason FROM rp WHERE problems <> '' AND review_note IS NULL"),
    Query("known_documents", lambda L: X.known_documents(_receipts(L)[0].select("household_id", "doc_hash").union(_statements(L)[0].select("household_id", "doc_hash")), L),
          f"""WITH {SUBMITTED} SELECT d.household_id, doc_hash, kind, id FROM (SELECT household_id, doc_hash FROM rh UNION ALL SELECT household_id, doc_hash FROM sh) d
JOIN (SELECT household_id, file_hash, 'receipt' AS kind, id FROM receipts UNION ALL SELECT household_id, file_hash, 'statement', id FROM statements) k
 ON k.household_id = d.household_id AND k.file_hash = d.doc_hash"""),
    Query("find_duplicate_receipts", lambda L: X.find_duplicate_receipts(_receipts(L)[0], L).select("household_id", "doc_id", "duplicate_of"),
          f"""WITH {SUBMITTED} SELECT household_id, doc_id, coalesce((SELECT min(id) FROM receipts r WHERE r.household_id = rh.household_id AND r.file_hash = doc_hash),
 (SELECT min(id) FROM receipts r WHERE r.household_id = rh.household_id AND r.store_name = rh.store_name AND r.purchase_date = rh.purchase_date AND r.total_c = rh.total_c
  AND (rh.receipt_number IS NULL OR r.receipt_number = rh.receipt_number))) AS duplicate_of FROM rh"""),
    # loads
    Query("load_receipts", lambda L: O.load_receipts(*_receipts(L), L, TODAY)[1].select("household_id", "doc_id", "outcome"), f"""WITH {RECEIPT_PROBLEMS},
du AS (SELECT rp.*, EXISTS (SELECT 1 FROM receipts r WHERE r.household_id = rp.household_id AND (r.file_hash = doc_hash OR (r.store_name = rp.store_name AND r.purchase_date = rp.purchase_date
 AND r.total_c = rp.total_c AND (rp.receipt_number IS NULL OR r.receipt_number = rp.receipt_number)))) AS dup FROM rp)
SELECT household_id, doc_id, CASE WHEN dup OR EXISTS (SELECT 1 FROM du e WHERE NOT e.dup AND e.household_id = du.household_id AND e.doc_id < du.doc_id AND e.store_name = du.store_name
  AND e.purchase_date = du.purchase_date AND e.total_c = du.total_c AND (du.receipt_number IS NULL OR e.receipt_number = du.receipt_number)) THEN 'duplicate'
 WHEN problems <> '' AND review_note IS NULL THEN 'rejected' WHEN review_note IS NOT NULL THEN 'needs_review' ELSE 'ok' END AS outcome FROM du"""),
    Query("load_statements", lambda L: O.load_statements(*_statements(L), L)[1].select("household_id", "doc_id", "outcome"), statement_outcomes()),
    Query("loaded_bookings", lambda L: O.load_statements(*_statements(L), L)[0].bookings.select("household_id", "id", "statement_id", "receipt_id", "mirror_of")),
    Query("merge_payment_list", lambda L: O.merge_payment_list(*_listed(L), ["household_id", "statement_id"], "id").select(
        "household_id", "statement_id", "id", "counterparty"), """
WITH st AS (SELECT b.* FROM bookings b JOIN statements s ON s.id = b.statement_id AND s.household_id = b.household_id WHERE s.bank = 'PayPal'),
nw AS (SELECT household_id, statement_id, id, booking_date, amount_c, counterparty, payment_reference FROM st
 UNION ALL SELECT household_id, statement_id, id + 1, booking_date, amount_c, ' ' || upper(counterparty), payment_reference FROM st),
o AS (SELECT household_id, statement_id, booking_date, amount_c, lower(trim(counterparty)) AS who, trim(coalesce(payment_reference, '')) AS ref, count(*) AS k FROM st GROUP BY ALL)
SELECT n.household_id, n.statement_id, n.id, n.counterparty FROM nw n LEFT JOIN o ON o.household_id = n.household_id AND o.statement_id = n.statement_id AND o.booking_date = n.booking_date
 AND o.amount_c = n.amount_c AND o.who = lower(trim(n.counterparty)) AND o.ref = trim(coalesce(n.payment_reference, ''))
QUALIFY row_number() OVER (PARTITION BY n.household_id, n.statement_id, n.booking_date, n.amount_c, lower(trim(n.counterparty)), trim(coalesce(n.payment_reference, '')) ORDER BY n.id) > coalesce(k, 0)"""),
    Query("carry_over_links", lambda L: O.carry_over_links(
        L.bookings.withColumn("scope", F.col("statement_id")),
        L.bookings.withColumn("scope", F.col("statement_id")).withColumn("id", F.col("id") + 1_000_000_000_000).withColumn(
            "booking_date", F.expr("CASE WHEN id % 19 = 0 THEN booking_date + 1 ELSE booking_date END")).withColumn("receipt_id", F.lit(None).cast("bigint")).withColumn(
            "link_status", F.lit(None).cast("string")).withColumn("transfer_group", F.lit(None).cast("bigint")), L)[0].select("household_id", "id", "receipt_id", "link_status", "transfer_group"), """
WITH o AS (SELECT *, row_number() OVER (PARTITION BY household_id, statement_id, booking_date, amount_c, description ORDER BY id) AS k FROM bookings),
n0 AS (SELECT household_id, statement_id, id + 1000000000000 AS id, CASE WHEN (id + 1000000000000) % 19 = 0 THEN booking_date + 1 ELSE booking_date END AS booking_date, amount_c, description FROM bookings),
n AS (SELECT *, row_number() OVER (PARTITION BY household_id, statement_id, booking_date, amount_c, description ORDER BY id) AS k FROM n0)
SELECT n.household_id, n.id, o.receipt_id, o.transfer_group, CASE WHEN o.receipt_id IS NOT NULL OR o.transfer_group IS NOT NULL THEN o.link_status END AS link_status FROM n LEFT JOIN o ON o.household_id = n.household_id AND o.statement_id = n.statement_id
 AND o.booking_date = n.booking_date AND o.amount_c = n.amount_c AND o.description = n.description AND o.k = n.k"""),
    Query("replace_statements", lambda L: O.replace_statements(
        L, derived(L, STATEMENT_HEADS).join(L.statements.select("household_id", F.col("id").alias("doc_id"), "month_index"), ["household_id", "doc_id"]),
        derived(L, STATEMENT_LINES)).statements.select("household_id", "id", "opening_c", "closing_c", "has_balances"), f"""
WITH {SUBMITTED} SELECT household_id, doc_id AS id, opening_c, closing_c, opening_c IS NOT NULL AND closing_c IS NOT NULL AS has_balances FROM sh"""),
    Query("statement_link_summary", O.statement_link_summary, f"""
SELECT s.household_id, s.id AS statement_id, count(b.receipt_id) AS receipts, count(b.transfer_group) AS transfer_sides,
 count(b.mirror_of) + count(e.id) AS paypal_payments, {big('coalesce(sum(q.n), 0)')} AS questions
FROM statements s LEFT JOIN bookings b ON b.statement_id = s.id AND b.household_id = s.household_id
LEFT JOIN (SELECT DISTINCT household_id, mirror_of AS id FROM bookings WHERE mirror_of IS NOT NULL) e ON e.household_id = b.household_id AND e.id = b.id
LEFT JOIN (SELECT household_id, transaction_id, count(*) AS n FROM questions WHERE status = 'open' GROUP BY ALL) q ON q.household_id = b.household_id AND q.transaction_id = b.id
GROUP BY s.household_id, s.id"""),
    # links
    Query("validate_receipt_links", lambda L: K.validate_links(derived(L, LINKS["receipt_match"]), L, "receipt_match").drop("reason"), f"""
SELECT p.household_id, transaction_id, p.receipt_id, CASE WHEN t.id IS NULL THEN 'no_transaction' WHEN r.id IS NULL THEN 'no_receipt' WHEN t.amount_c >= 0 THEN 'money_in'
 WHEN abs(abs(t.amount_c) - r.total_c) > 1 THEN 'amounts_differ' WHEN t.receipt_id IS NOT NULL THEN 'transaction_linked' WHEN r.linked THEN 'receipt_linked'
 WHEN EXISTS (SELECT 1 FROM questions q WHERE q.kind = 'receipt_match' AND q.status = 'no' AND q.household_id = p.household_id AND q.transaction_id = p.transaction_id AND q.receipt_id = p.receipt_id) THEN 'answered_no' END AS problem
FROM {PAIRS_SQL['receipt_match']} p LEFT JOIN tx t ON t.household_id = p.household_id AND t.id = transaction_id LEFT JOIN receipts r ON r.household_id = p.household_id AND r.id = p.receipt_id"""),
    Query("validate_transfer_links", lambda L: K.validate_links(derived(L, LINKS["transfer_match"]), L, "transfer_match").drop("reason"), f"""
SELECT p.household_id, out_id, in_id, CASE WHEN a.id IS NULL OR b.id IS NULL THEN 'no_transaction' WHEN NOT (a.amount_c < 0 AND b.amount_c > 0) THEN 'wrong_direction'
 WHEN abs(abs(a.amount_c) - abs(b.amount_c)) > 1 THEN 'amounts_differ' WHEN a.statement_id = b.statement_id THEN 'same_statement'
 WHEN a.transfer_group IS NOT NULL OR b.transfer_group IS NOT NULL THEN 'already_paired'
 WHEN EXISTS (SELECT 1 FROM questions q WHERE q.kind = 'transfer_match' AND q.status = 'no' AND q.household_id = p.household_id AND q.transaction_id = out_id AND q.other_transaction_id = in_id) THEN 'answered_no' END AS problem
FROM {PAIRS_SQL['transfer_match']} p LEFT JOIN tx a ON a.household_id = p.household_id AND a.id = out_id LEFT JOIN tx b ON b.household_id = p.household_id AND b.id = in_id"""),
    Query("validate_mirror_links", lambda L: K.validate_links(derived(L, LINKS["mirror_match"]), L, "mirror_match").drop("reason"), f"""
SELECT p.household_id, paypal_id, bank_id, CASE WHEN a.id IS NULL OR b.id IS NULL THEN 'no_transaction' WHEN a.bank <> 'PayPal' THEN 'not_paypal' WHEN b.bank = 'PayPal' THEN 'both_paypal'
 WHEN (a.amount_c < 0) <> (b.amount_c < 0) THEN 'different_direction' WHEN abs(abs(a.amount_c) - abs(b.amount_c)) > 1 THEN 'amounts_differ' WHEN abs(a.booking_date - b.booking_date) > 10 THEN 'too_far_apart'
 WHEN a.mirror_of IS NOT NULL THEN 'already_explains' WHEN b.id IN (SELECT mirror_of FROM bookings WHERE mirror_of IS NOT NULL) THEN 'already_explained' END AS problem
FROM {PAIRS_SQL['mirror_match']} p LEFT JOIN tx a ON a.household_id = p.household_id AND a.id = paypal_id LEFT JOIN tx b ON b.household_id = p.household_id AND b.id = bank_id"""),
    Query("apply_receipt_links", lambda L: K.apply_receipt_links(L, derived(L, LINKS["receipt_match"])).bookings.select(*TX), f"""
SELECT b.household_id, b.id, kind, category, counterparty, CASE WHEN p.transaction_id IS NULL THEN b.receipt_id ELSE p.receipt_id END AS receipt_id, transfer_group, mirror_of,
 CASE WHEN p.transaction_id IS NULL THEN link_status ELSE 'auto' END AS link_status FROM bookings b LEFT JOIN {PAIRS_SQL['receipt_match']} p ON p.household_id = b.household_id AND p.transaction_id = b.id"""),
    Query("apply_transfer_pairs", lambda L: K.apply_transfer_pairs(L, X.pair_transfers(L)).bookings.groupBy("household_id", "kind", "link_status").agg(
        F.count("*").alias("n"), F.count("transfer_group").alias("paired")), """
WITH o AS (SELECT * FROM bookings WHERE kind IN ('internal_transfer', 'investment') AND transfer_group IS NULL AND amount_c <> 0),
c AS (SELECT a.household_id, a.id AS out_id, b.id AS in_id FROM o a JOIN o b ON a.household_id = b.household_id AND a.amount_c < 0 AND b.amount_c > 0
 AND a.statement_id <> b.statement_id AND abs(a.amount_c + b.amount_c) <= 1 AND abs(a.booking_date - b.booking_date) <= 5),
u AS (SELECT *, count(*) OVER (PARTITION BY household_id, out_id) AS x, count(*) OVER (PARTITION BY household_id, in_id) AS y FROM c),
g AS (SELECT household_id, unnest([out_id, in_id]) AS id, out_id FROM u WHERE x = 1 AND y = 1
 AND NOT EXISTS (SELECT 1 FROM questions q WHERE q.kind = 'transfer_match' AND q.status = 'no' AND q.transaction_id = out_id AND q.other_transaction_id = in_id))
SELECT b.household_id, CASE WHEN g.id IS NULL THEN kind ELSE 'internal_transfer' END AS kind, CASE WHEN g.id IS NULL THEN link_status ELSE 'auto' END AS link_status, count(*) AS n,
 count(coalesce(transfer_group, g.out_id)) AS paired FROM bookings b LEFT JOIN g ON g.household_id = b.household_id AND g.id = b.id GROUP BY ALL"""),
    Query("apply_mirrors", lambda L: K.apply_mirrors(L, derived(L, LINKS["mirror_match"])).bookings.select(*TX), f"""
SELECT b.household_id, b.id, b.kind, CASE WHEN w.id IS NOT NULL AND coalesce(b.category, 'other_expense') IN ('other_expense', 'shopping_general') AND coalesce(w.category, 'other_expense') NOT IN ('other_expense', 'shopping_general') THEN w.category ELSE b.category END AS category,
 CASE WHEN w.id IS NOT NULL AND starts_with(lower(b.counterparty), 'paypal') THEN w.counterparty ELSE b.counterparty END AS counterparty, b.receipt_id, b.transfer_group,
 CASE WHEN p.paypal_id IS NULL THEN b.mirror_of ELSE p.bank_id END AS mirror_of, CASE WHEN p.paypal_id IS NULL THEN b.link_status ELSE 'auto' END AS link_status
FROM bookings b LEFT JOIN {PAIRS_SQL['mirror_match']} p ON p.household_id = b.household_id AND p.paypal_id = b.id
LEFT JOIN {PAIRS_SQL['mirror_match']} r ON r.household_id = b.household_id AND r.bank_id = b.id LEFT JOIN bookings w ON w.household_id = b.household_id AND w.id = r.paypal_id"""),
    Query("questions_from", lambda L: K.questions_from(derived(L, LINKS["receipt_match"]), L, "receipt_match").drop("id", "created_at", "answered_at", "other_transaction_id"), f"""
SELECT p.household_id, 'receipt_match' AS kind, transaction_id, p.receipt_id, 'Is the ' || cast(cast(abs(amount_c) / 100.0 AS decimal(18,2)) AS varchar) || ' EUR payment to ' || counterparty || ' booked on ' || booking_date
 || CASE WHEN b.purchase_date IS NULL THEN '' ELSE ' (bought ' || b.purchase_date || ')' END || ' the ' || store_name || ' receipt from ' || r.purchase_date || ' (' || cast(cast(total_c / 100.0 AS decimal(18,2)) AS varchar) || ' EUR)? Why unsure: asked' AS question, 'open' AS status
FROM {PAIRS_SQL['receipt_match']} p JOIN bookings b ON b.household_id = p.household_id AND b.id = transaction_id JOIN receipts r ON r.household_id = p.household_id AND r.id = p.receipt_id
WHERE NOT EXISTS (SELECT 1 FROM questions q WHERE q.kind = 'receipt_match' AND q.status IN ('open', 'yes', 'no') AND q.household_id = p.household_id AND q.transaction_id = p.transaction_id AND q.receipt_id = p.receipt_id)"""),
    Query("transfer_questions", lambda L: _asked(L, "transfer_match"), _question_sql("transfer_match", f"""'Is the ' || {EURO.format('abs(a.amount_c)')} || ' EUR leaving ' || a.bank || ' on ' || a.booking_date
 || ' the same money as the ' || {EURO.format('b.amount_c')} || ' EUR arriving on ' || b.bank || ' on ' || b.booking_date || ' (a transfer between your own accounts)? Why unsure: asked'""")),
    Query("mirror_questions", lambda L: _asked(L, "mirror_match"), _question_sql("mirror_match", f"""'Is the ' || {EURO.format('abs(a.amount_c)')} || ' EUR PayPal payment to ' || a.counterparty || ' on ' || a.booking_date
 || ' the same payment as the ' || b.bank || ' booking of ' || {EURO.format('abs(b.amount_c)')} || ' EUR on ' || b.booking_date || ' (' || b.counterparty || ')? Why unsure: asked'""")),
    Query("booking_lines", lambda L: L.bookings.select("household_id", "id", E.booking_line().alias("line")), f"""
SELECT household_id, id, '#' || id || ' | ' || booking_date || coalesce(' (bought ' || purchase_date || ')', '') || ' | ' || CASE WHEN amount_c < 0 THEN '-' ELSE '+' END || {EURO.format('abs(amount_c)')}
 || ' | ' || counterparty || ' | ' || kind || coalesce(' | ref ' || nullif(payment_reference, ''), '') AS line FROM bookings"""),
    Query("apply_answers", lambda L: K.apply_answers(L, derived(L, ANSWERS))[0].questions.groupBy("household_id", "kind", "status").agg(F.count("*").alias("n")), """
SELECT household_id, kind, CASE WHEN status <> 'open' THEN status WHEN id % 3 <> 0 THEN 'yes' ELSE 'no' END AS status, count(*) AS n FROM questions GROUP BY ALL"""),
    Query("answer_problems", lambda L: K.apply_answers(L, derived(L, ANSWERS))[1], """
SELECT q.household_id, q.id AS question_id, CASE WHEN q.status <> 'open' THEN 'already_answered' WHEN q.kind = 'receipt_match' THEN CASE WHEN t.id IS NULL THEN 'no_transaction' WHEN r.id IS NULL THEN 'no_receipt' WHEN t.receipt_id IS NOT NULL THEN 'transaction_linked' END
 ELSE CASE WHEN abs(abs(t.amount_c) - abs(o.amount_c)) > 1 THEN 'amounts_differ' WHEN t.transfer_group IS NOT NULL THEN 'already_paired' END END AS problem
FROM questions q LEFT JOIN tx t ON t.household_id = q.household_id AND t.id = q.transaction_id LEFT JOIN receipts r ON r.household_id = q.household_id AND r.id = q.receipt_id
LEFT JOIN tx o ON o.household_id = q.household_id AND o.id = q.other_transaction_id
WHERE q.status <> 'open' OR (q.id % 3 <> 0 AND CASE WHEN q.kind = 'receipt_match' THEN t.id IS NULL OR r.id IS NULL OR t.receipt_id IS NOT NULL ELSE abs(abs(t.amount_c) - abs(o.amount_c)) > 1 OR t.transfer_group IS NOT NULL END)"""),
    # changes
    Query("apply_stock_events", lambda L: U.apply_stock_events(L, derived(L, EVENTS))[0].select("household_id", "id", *U.STATE_COLUMNS), f"""WITH {STOCK_EVENTS}
SELECT household_id, id, CASE WHEN fin1 OR fin2 THEN CASE WHEN wq > 0 THEN CASE WHEN wr IN ('expired', 'spoiled') THEN 'Spoiled' ELSE 'Discarded' END ELSE 'Consumed' END ELSE status END AS status,
 CASE WHEN known AND left1 > 0 THEN greatest(0.0::double, left1 - 1) ELSE left1 END AS quantity_left, wq AS wasted_quantity, CASE WHEN tossed AND wr <> 'gave_away' THEN date '2001-08-02' ELSE wasted_on END AS wasted_on,
 wr AS waste_reason, CASE WHEN p1 IS NULL AND a = 2 THEN coalesce(opened_on, date '2001-08-02') WHEN p1 IS NULL AND a = 4 THEN NULL ELSE opened_on END AS opened_on,
 CASE WHEN fin1 THEN date '2001-08-02' WHEN fin2 THEN date '2001-08-03' ELSE finished_on END AS finished_on,
 CASE WHEN p1 IS NULL AND a = 4 THEN NULL WHEN p1 IS NULL AND a = 5 THEN 'cellar' ELSE location END AS location, CASE WHEN p1 IS NULL AND a = 5 THEN cast(id % 8 AS int) ELSE rating END AS rating,
 would_rebuy, CASE WHEN p1 IS NULL AND a = 4 THEN 'Frozen' ELSE storage_condition END AS storage_condition, CASE WHEN p1 IS NULL AND a = 4 THEN date '2001-08-02' + 90 ELSE date_expiry END AS date_expiry
FROM e3"""),
    Query("refused_stock_events", lambda L: U.apply_stock_events(L, derived(L, EVENTS))[1], f"""WITH {STOCK_EVENTS}
SELECT household_id, id AS item_id, id * 10 + 1 AS event_id, p1 AS problem FROM e3 WHERE p1 IS NOT NULL
UNION ALL SELECT household_id, id, id * 10 + 2, CASE WHEN known THEN 'nothing_left' ELSE 'no_such_item' END FROM e3 WHERE NOT known OR left1 <= 0"""),
    Query("confirm_receipts", lambda L: U.confirm_receipts(L, derived(L, "SELECT household_id, id AS receipt_id, CASE WHEN id % 2 = 0 THEN purchase_date - 3 END AS purchase_date FROM {receipts} WHERE status = 'needs_review'"))
          .items.select("household_id", "id", "date_purchased", "date_expiry"), """
SELECT i.household_id, i.id, CASE WHEN r.id IS NULL THEN date_purchased ELSE r.purchase_date - 3 END AS date_purchased, CASE WHEN r.id IS NULL THEN date_expiry ELSE date_expiry - 3 END AS date_expiry
FROM items i LEFT JOIN (SELECT * FROM receipts WHERE status = 'needs_review' AND id % 2 = 0) r ON r.id = i.receipt_id AND r.household_id = i.household_id"""),
    Query("remove_receipts", lambda L: U.remove_receipts(L, L.receipts.filter("status = 'needs_review'").select("household_id", "id")).bookings.select(*TX), """
SELECT b.household_id, b.id, kind, category, counterparty, CASE WHEN r.id IS NULL THEN b.receipt_id END AS receipt_id, transfer_group, mirror_of, CASE WHEN r.id IS NULL THEN link_status END AS link_status
FROM bookings b LEFT JOIN (SELECT * FROM receipts WHERE status = 'needs_review') r ON r.id = b.receipt_id AND r.household_id = b.household_id"""),
    Query("remove_statements", lambda L: U.remove_statements(L, L.statements.filter("bank = 'N26'").select("household_id", "id")).bookings.select(*TX), """
WITH g AS (SELECT * FROM tx WHERE bank = 'N26')
SELECT household_id, id, kind, category, counterparty, receipt_id, CASE WHEN NOT tg THEN transfer_group END AS transfer_group, CASE WHEN NOT mg THEN mirror_of END AS mirror_of, CASE WHEN NOT (tg OR mg) THEN link_status END AS link_status
FROM (SELECT b.*, coalesce(transfer_group IN (SELECT transfer_group FROM g WHERE transfer_group IS NOT NULL), false) AS tg, coalesce(mirror_of IN (SELECT id FROM g), false) AS mg FROM tx b WHERE bank <> 'N26') x"""),
    Query("category_usage", U.category_usage, f"""
SELECT household_id, key, {big('sum(i)')} AS items, {big('sum(t)')} AS transactions FROM (SELECT household_id, spend_category AS key, 1 AS i, 0 AS t FROM items UNION ALL SELECT household_id, category, 0, 1 FROM bookings) x GROUP BY ALL"""),
    Query("remap_categories", lambda L: U.remap_categories(L, derived(L, CATEGORY_MAP))[0].items.select("household_id", "id", "spend_category", "category"), """
SELECT household_id, id, CASE spend_category WHEN 'eating_out' THEN 'takeaway' WHEN 'beverages' THEN NULL WHEN 'pharmacy' THEN 'medical' ELSE spend_category END AS spend_category,
 CASE spend_category WHEN 'eating_out' THEN 'Food' WHEN 'beverages' THEN 'Other' WHEN 'pharmacy' THEN 'Medicine' ELSE category END AS category FROM items"""),
    Query("apply_category_changes", lambda L: U.apply_category_changes(L, derived(L, CATEGORY_CHANGES))[1], f"""
WITH ch AS ({plain(CATEGORY_CHANGES)}), en AS (SELECT household_id, 'i' || id AS ref, 'expense' AS fl, false AS fr FROM items
 UNION ALL SELECT household_id, 't' || id, CASE WHEN kind IN ('income', 'refund') OR amount_c > 0 THEN 'income' ELSE 'expense' END, kind IN ('internal_transfer', 'investment') FROM bookings),
pr AS (SELECT ch.household_id, ch.ref, ch.category, CASE WHEN fl IS NULL THEN 'no_such_entry' WHEN fr THEN 'transfers_and_investments_have_none' ELSE {CATEGORY_PROBLEM.format(c='ch.category', f='fl')} END AS problem
 FROM ch LEFT JOIN en ON en.household_id = ch.household_id AND en.ref = ch.ref LEFT JOIN categories k ON k.key = ch.category AND k.active)
SELECT * FROM pr WHERE problem IS NOT NULL"""),
    Query("upsert_categories", lambda L: U.upsert_categories(L.categories, derived(L, """
SELECT row_number() OVER (ORDER BY name) AS change_id, cast(NULL AS string) AS key, name AS label, 'Things' AS group_name, 'expense' AS flow, false AS fixed, 'made from a product' AS description, true AS active, false AS update
FROM (SELECT DISTINCT name FROM {items}) n"""))[0].select("key", "label", "group_name", "flow", "fixed", "sort_order", "active"), """
SELECT key, label, group_name, flow, fixed, cast(sort_order AS int) AS sort_order, active FROM categories UNION ALL
SELECT regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), name, 'Things', 'expense', false, cast((SELECT max(sort_order) FROM categories) + 10 * row_number() OVER (ORDER BY name) AS int), true FROM (SELECT DISTINCT name FROM items) n"""),
    Query("apply_kind_changes", lambda L: U.apply_kind_changes(L, derived(L, "SELECT household_id, id AS transaction_id, CASE WHEN kind = 'investment' THEN 'internal_transfer' ELSE 'investment' END AS kind FROM {bookings}"))[0]
          .bookings.select(*TX), """
SELECT household_id, id, CASE WHEN a THEN 'internal_transfer' WHEN b THEN 'investment' ELSE kind END AS kind, category, counterparty, receipt_id, transfer_group, mirror_of, CASE WHEN a THEN 'confirmed' WHEN b THEN NULL ELSE link_status END AS link_status
FROM (SELECT *, bank <> 'PayPal' AND kind = 'investment' AS a, bank <> 'PayPal' AND kind = 'internal_transfer' AND transfer_group IS NULL AND coalesce(link_reason, '') = 'set by household: not an investment' AS b FROM tx) x"""),
    Query("apply_instrument_labels", lambda L: U.apply_instrument_labels(L, derived(L, "SELECT household_id, id AS transaction_id, CASE WHEN id % 3 = 0 THEN cast(NULL AS string) ELSE '  My   ETF ' || (id % 4) END AS instrument, cast('2001-08-02 10:00:00' AS timestamp) AS ts FROM {bookings} WHERE kind = 'investment'"))[0]
          .select("household_id", "booking_ref", "instrument", "amount_c"), """
WITH l AS (SELECT household_id, id, substr(sha1(bank || '|' || cast(booking_date AS varchar) || '|' || cast(cast(-amount_c / 100.0 AS decimal(18,2)) AS varchar) || '|' || trim(regexp_replace(description, '\\s+', ' ', 'g'))), 1, 16) AS ref, -amount_c AS amount_c
 FROM tx WHERE kind = 'investment' AND bank <> 'PayPal' QUALIFY row_number() OVER (PARTITION BY household_id, ref ORDER BY id DESC) = 1)
SELECT household_id, ref AS booking_ref, 'My ETF ' || (id % 4) AS instrument, amount_c FROM l WHERE id % 3 <> 0
UNION ALL SELECT household_id, booking_ref, instrument, amount_c FROM splits WHERE (household_id, booking_ref) NOT IN (SELECT household_id, ref FROM l)"""),
    Query("apply_rule_changes", lambda L: U.apply_rule_changes(L, derived(L, "SELECT household_id, key, CASE WHEN household_id % 3 = 0 THEN 'yearly' END AS frequency, household_id % 3 = 1 AS hidden, cast('2001-08-02 10:00:00' AS timestamp) AS ts FROM {rules}"))[0], """
SELECT household_id, key, CASE WHEN household_id % 3 = 0 THEN 'yearly' END AS frequency, household_id % 3 = 1 AS hidden FROM rules WHERE household_id % 3 < 2"""),
    Query("apply_plan_changes", lambda L: U.apply_plan_changes(L, derived(L, PLAN_CHANGES))[0].drop("note", "id"), f"""WITH {PLAN_REFUSALS}
SELECT household_id, broker, instrument, CASE WHEN k = 4 THEN amount_c + 500 ELSE amount_c END AS amount_c, frequency, anchor_date, start_date,
 CASE WHEN k IN (0, 2) AND problem IS NULL THEN date '2001-08-01' ELSE end_date END AS end_date FROM pc WHERE k <> 3
UNION ALL SELECT household_id, broker, instrument, CASE WHEN k = 2 THEN amount_c + 500 ELSE amount_c END, CASE WHEN id % 12 = 2 THEN 'weekly' ELSE frequency END,
 CASE WHEN id % 12 = 2 AND frequency <> 'weekly' THEN NULL ELSE anchor_date END, date '2001-08-02', NULL FROM pc WHERE k IN (1, 2) AND problem IS NULL
UNION ALL SELECT household_id, 'N26', 'ETF new', amount_c + 500, 'monthly', NULL, NULL, NULL FROM pc WHERE k = 5"""),
    Query("refused_plan_changes", lambda L: U.apply_plan_changes(L, derived(L, PLAN_CHANGES))[1], f"""WITH {PLAN_REFUSALS}
SELECT household_id, id AS plan_id, id AS change_id, problem FROM pc WHERE problem IS NOT NULL"""),
    Query("backfill_categories", lambda L: U.backfill_categories(L.with_(bookings=L.bookings.withColumn("category", F.expr("CASE WHEN id % 3 = 0 THEN 'BENZIN' WHEN id % 3 = 1 THEN 'FIXED_COSTS' ELSE category END"))))
          .bookings.select("household_id", "id", "category"), """
SELECT household_id, id, CASE WHEN id % 3 = 0 THEN 'fuel' WHEN id % 3 = 2 AND category IS NOT NULL THEN category ELSE CASE kind WHEN 'cash' THEN 'cash' WHEN 'fee' THEN 'bank_fees' END END AS category FROM bookings"""),
    Query("backfill_stock", lambda L: U.backfill_stock(L.items).select("household_id", "id", "quantity_left", "wasted_quantity", "wasted_on", "finished_on", "waste_reason"), """
SELECT household_id, id, CASE WHEN status = 'Available' THEN cast(quantity AS double) ELSE 0.0 END AS quantity_left, CASE WHEN status = 'Spoiled' THEN cast(quantity AS double) ELSE wasted_quantity END AS wasted_quantity,
 CASE WHEN status = 'Spoiled' THEN date_purchased ELSE wasted_on END AS wasted_on, CASE WHEN status <> 'Available' THEN date_purchased ELSE finished_on END AS finished_on,
 CASE WHEN status = 'Spoiled' THEN 'spoiled' ELSE waste_reason END AS waste_reason FROM items"""),
]
