"""Subscriptions, investments, plans and matching."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import exprs as E
from ..operators import finders as B
from ..operators import investments as I
from ..operators import matching as X
from ..operators import savings_plans as V
from ..operators import subscriptions as U
from ..schema import BILL_CATEGORIES, SCHEMAS, Ledger
from .common import TODAY, Query, big, dt, label, mi, sql_half_up
from .upkeep_queries import derived, plain

D = dt.date
T = f"date '{TODAY}'"
NOISE = "'" + "', '".join(E.NOISE_WORDS) + "'"


def payee(name: str) -> str:
    plain = f"regexp_replace(regexp_replace(lower({name}), '\\b([a-z])\\.([a-z])\\.', '\\1\\2', 'g'), '[^a-z0-9]+', ' ', 'g')"
    kept = (
        f"array_to_string(list_filter(string_split({plain}, ' '), lambda w: w <> '' AND w NOT IN ({NOISE}) "
        "AND NOT regexp_full_match(w, '[0-9]+')), ' ')"
    )
    return f"coalesce(nullif({kept}, ''), nullif(trim({plain}), ''), 'unknown')"


def _twins(table: str, where: str, more: int) -> str:
    """The rows of a table and, of those that fit, another one each with the id moved on by `more`."""
    columns = [part.strip().split(" ")[0] for part in SCHEMAS[table].split(",")]
    moved = ", ".join(f"id + {more}" if c == "id" else c for c in columns)
    return f"SELECT {', '.join(columns)} FROM {{{table}}} UNION ALL SELECT {moved} FROM {{{table}}} WHERE {where}"


CONTESTED = {
    "receipts": _twins("receipts", "id % 20 = 0", 1_000_000_000),
    "bookings": _twins("bookings", "id % 400 = 1", 5),
    "questions": "SELECT household_id, id, kind, transaction_id, receipt_id, status FROM {questions} UNION ALL SELECT household_id, id * 10 + 9, 'receipt_match', id * 10 + 1, id, 'no' "
                 "FROM {receipts} WHERE id % 15 IN (3, 8) OR id % 100 = 40",
}
CODE = ("coalesce(nullif(regexp_extract(description, 'WPKNR:\\s*([A-Z0-9]{6})', 1), ''), "
        "nullif(regexp_extract(description, '\\b([A-Z]{2}[A-Z0-9]{9}\\d)\\b', 1), ''))")
REF = ("substr(sha1(bank || '|' || cast(booking_date AS varchar) || '|' || cast(cast(-amount_c / 100.0 AS decimal(18,2)) AS varchar) || '|' "
       "|| trim(regexp_replace(description, '\\s+', ' ', 'g'))), 1, 16)")
BROKERS = "('N26', 'Commerzbank', 'Sparkasse')"
INV = f"""WITH inv AS (SELECT household_id, id, bank AS broker, booking_date AS date, -amount_c AS amount_c, counterparty, description,
 {CODE} AS code, {REF} AS ref, {mi('booking_date')} AS m FROM tx WHERE kind = 'investment' AND bank IN {BROKERS})"""
PAYMENTS = f"""WITH spent AS (SELECT * FROM tx WHERE kind IN ('spend', 'fee', 'cash', 'other') AND amount_c < 0 AND receipt_id IS NULL),
pay AS (SELECT household_id, id, counterparty AS name, {payee('counterparty')} AS payee, coalesce(purchase_date, booking_date) AS date,
 -amount_c AS amount_c, category, CASE WHEN bank <> 'PayPal' THEN booking_date END AS bank_day FROM spent s
 WHERE NOT EXISTS (SELECT 1 FROM spent e WHERE e.household_id = s.household_id AND e.mirror_of = s.id))"""
# For queries of sums: what a booking bought is taken from the booking alone, so SQL can follow.
NAMED = INV + ", nm AS (SELECT *, CASE WHEN code IS NOT NULL THEN counterparty WHEN id % 4 = 1 THEN 'Manual buys' ELSE 'Unknown' END AS instrument FROM inv)"


def _named(L: Ledger):
    own = F.when(F.col("code").isNotNull(), F.col("counterparty")).when(F.col("id") % 4 == 1, "Manual buys").otherwise("Unknown")
    return B.investment_bookings(L).withColumn("instrument", own)


CUT = TODAY.year * 12 + TODAY.month - 1


def _months(by_broker: bool) -> str:
    own = "household_id, broker" if by_broker else "household_id"
    on = " AND ".join(f"s.{c} = {{0}}.{c}" for c in own.split(", "))
    return f""", cell AS (SELECT {own}, m, {big('sum(amount_c)')} AS net_c, {big('coalesce(sum(amount_c) FILTER (amount_c > 0), 0)')} AS bought_c,
 {big('coalesce(sum(-amount_c) FILTER (amount_c <= 0), 0)')} AS sold_c, count(*) AS n FROM nm GROUP BY ALL),
spine AS (SELECT {own}, unnest(range(min(m), greatest(max(m), {CUT}) + 1)) AS m FROM cell GROUP BY {own}),
stm AS (SELECT DISTINCT household_id, bank AS broker, month_index AS m FROM statements WHERE bank IN {BROKERS}),
mon AS (SELECT s.*, coalesce(net_c, 0) AS net_c, coalesce(bought_c, 0) AS bought_c, coalesce(sold_c, 0) AS sold_c, coalesce(n, 0) AS n,
 n IS NOT NULL OR EXISTS (SELECT 1 FROM stm x WHERE {on.format('x')} AND x.m = s.m) AS covered
 FROM spine s LEFT JOIN cell c ON {on.format('c')} AND c.m = s.m)"""


EXEC = f"""WITH bounds AS (SELECT p.*, greatest(date '1996-02-10', start_date) AS lo, least(date '1997-04-20', end_date) AS hi FROM plans p WHERE anchor_date IS NOT NULL),
weekly AS (SELECT household_id, id, anchor_date + cast(k * step AS int) AS day FROM (SELECT *, unnest(range(cast(ceil((lo - anchor_date) / step) AS bigint),
  cast(floor((hi - anchor_date) / step) AS bigint) + 1)) AS k FROM (SELECT *, CASE frequency WHEN 'weekly' THEN 7 ELSE 14 END AS step FROM bounds WHERE frequency <> 'monthly') b) x),
monthly AS (SELECT household_id, id, lo, hi, make_date(cast(m // 12 AS int), cast(m % 12 + 1 AS int), 1) AS s, anchor_date FROM (
  SELECT *, unnest(range({mi('lo')}, {mi('hi')} + 1)) AS m FROM bounds WHERE frequency = 'monthly') x),
monthly_days AS (SELECT household_id, id, lo, hi, s + cast(least(day(anchor_date), day(last_day(s))) - 1 AS int) AS day FROM monthly)
"""
STATUS = f"CASE WHEN start_date > {T} THEN 'scheduled' WHEN end_date < {T} THEN 'ended' ELSE 'active' END"
PER = "CASE frequency WHEN 'weekly' THEN 52 WHEN 'biweekly' THEN 26 ELSE 12 END"

#: The fold over the payments of a payee, one step a payment: clusters with their amounts, the last day kept and the payment they began with.
CLUSTERS = PAYMENTS.replace("WITH ", "WITH RECURSIVE ", 1) + """,
sq AS (SELECT *, row_number() OVER (PARTITION BY household_id, payee ORDER BY date, id) AS k FROM pay),
fold AS (SELECT DISTINCT household_id, payee, cast(0 AS bigint) AS k, cast([] AS STRUCT(amounts bigint[], kept date, start bigint)[]) AS cl, cast(NULL AS bigint) AS id, cast(NULL AS bigint) AS start, false AS keep FROM pay
 UNION ALL SELECT household_id, payee, k, CASE WHEN hit IS NULL THEN list_append(cl, {'amounts': [amount_c], 'kept': date, 'start': id})
   ELSE list_transform(cl, lambda c, i: CASE WHEN i = hit THEN {'amounts': list_append(c.amounts, amount_c), 'kept': CASE WHEN date - c.kept > 3 THEN date ELSE c.kept END, 'start': c.start} ELSE c END) END,
  id, CASE WHEN hit IS NULL THEN id ELSE cl[hit].start END, hit IS NULL OR date - cl[hit].kept > 3
 FROM (SELECT f.household_id, f.payee, s.k, f.cl, s.amount_c, s.date, s.id,
   nullif(list_position(list_transform(f.cl, lambda c: abs(s.amount_c - list_aggregate(c.amounts, 'median')) * 100 <= greatest(10000, 12 * list_aggregate(c.amounts, 'median'))), true), 0) AS hit
  FROM fold f JOIN sq s ON s.household_id = f.household_id AND s.payee = f.payee AND s.k = f.k + 1) x),
kept AS (SELECT p.*, f.start FROM fold f JOIN pay p ON p.household_id = f.household_id AND p.id = f.id WHERE f.keep)"""
RECURRING = CLUSTERS + f""",
gp AS (SELECT *, date - lag(date) OVER (PARTITION BY household_id, payee, start ORDER BY date) AS gap FROM kept),
ag AS (SELECT household_id, payee, start, count(*) AS n, count(gap) AS gaps, median(gap) AS med, count(DISTINCT {mi('date')}) AS months, min(date) AS first_date,
 count(*) FILTER (gap BETWEEN 25 AND 36) AS a, count(*) FILTER (gap BETWEEN 80 AND 100) AS b, count(*) FILTER (gap BETWEEN 345 AND 385) AS c FROM gp GROUP BY ALL),
fq AS (SELECT *, CASE WHEN months < 2 THEN NULL WHEN med BETWEEN 25 AND 36 AND a * 10 >= gaps * 6 THEN 'monthly' WHEN med BETWEEN 80 AND 100 AND b * 10 >= gaps * 6 THEN 'quarterly'
  WHEN med BETWEEN 345 AND 385 AND c * 10 >= gaps * 6 THEN 'yearly' END AS frequency FROM ag),
best AS (SELECT household_id, payee, start, frequency FROM fq WHERE frequency IS NOT NULL QUALIFY row_number() OVER (PARTITION BY household_id, payee ORDER BY n DESC, first_date, start) = 1),
loose AS (SELECT p.* FROM pay p WHERE category IN (SELECT key FROM categories WHERE flow = 'expense' AND fixed) AND NOT EXISTS (SELECT 1 FROM best b WHERE b.household_id = p.household_id AND b.payee = p.payee)),
latest AS (SELECT household_id, payee, first(amount_c ORDER BY date DESC, id) AS last_c FROM loose GROUP BY ALL),
near AS (SELECT l.household_id, l.payee, l.date, min(l.id) AS id, arg_min(l.amount_c, l.id) AS amount_c, arg_min(l.name, l.id) AS name, arg_min(l.category, l.id) AS category
 FROM loose l JOIN latest t ON t.household_id = l.household_id AND t.payee = l.payee WHERE abs(l.amount_c - last_c) * 100 <= greatest(10000, last_c * 12) GROUP BY ALL),
hops AS (SELECT *, min(date) OVER (PARTITION BY household_id, payee ORDER BY date RANGE BETWEEN INTERVAL 4 DAYS FOLLOWING AND UNBOUNDED FOLLOWING) AS later, min(date) OVER (PARTITION BY household_id, payee) AS first_date FROM near),
walk AS (SELECT household_id, payee, date, later FROM hops WHERE date = first_date
 UNION ALL SELECT h.household_id, h.payee, h.date, h.later FROM walk w JOIN hops h ON h.household_id = w.household_id AND h.payee = w.payee AND h.date = w.later),
recurring AS (SELECT k.household_id, k.payee, 'pattern' AS evidence, frequency, date, amount_c, id AS first_id, name, category
  FROM kept k JOIN best b ON b.household_id = k.household_id AND b.payee = k.payee AND b.start = k.start
 UNION ALL SELECT n.household_id, n.payee, 'category', 'monthly', n.date, n.amount_c, n.id, n.name, n.category FROM near n JOIN walk w ON w.household_id = n.household_id AND w.payee = n.payee AND w.date = n.date)"""


def _common(column: str) -> str:
    """The most frequent value of each payee, then the one seen first, then by name."""
    return f"""(SELECT household_id, payee, {column} FROM (SELECT household_id, payee, {column}, count(*) AS n, min((date, first_id)) AS seen FROM recurring WHERE length({column}) > 0 GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY household_id, payee ORDER BY n DESC, seen, {column}) = 1)"""


BILLS = "('" + "', '".join(BILL_CATEGORIES) + "')"
ITEMS = RECURRING + f""",
it AS (SELECT household_id, payee, any_value(evidence) AS evidence0, any_value(frequency) AS frequency0, count(*) AS payments, min(date) AS first_date, max(date) AS last_date,
 first(amount_c ORDER BY date, first_id) AS first_c, first(amount_c ORDER BY date DESC, first_id DESC) AS last_c FROM recurring GROUP BY ALL),
hs AS (SELECT household_id, payee, string_agg(cast(date AS varchar) || ' ' || amount_c, ',' ORDER BY date, amount_c) AS history
 FROM (SELECT * FROM recurring QUALIFY row_number() OVER (PARTITION BY household_id, payee ORDER BY date DESC, amount_c DESC) <= 12) GROUP BY ALL),
cv AS (SELECT household_id, max(bank_day) AS covered_until FROM pay GROUP BY ALL),
sd AS (SELECT it.*, replace(payee, ' ', '-') AS key, CASE WHEN r.frequency IN ('monthly', 'quarterly', 'yearly') THEN 'you' ELSE evidence0 END AS evidence,
 CASE WHEN r.frequency IN ('monthly', 'quarterly', 'yearly') THEN r.frequency ELSE frequency0 END AS frequency, coalesce(r.hidden, false) AS hidden
 FROM it LEFT JOIN rules r ON r.household_id = it.household_id AND r.key = replace(it.payee, ' ', '-')),
pr AS (SELECT sd.*, hs.history, cn.name AS common_name, cc.category AS common_category, k.label AS label, covered_until,
 CASE frequency WHEN 'monthly' THEN 1 WHEN 'quarterly' THEN 3 ELSE 12 END AS per, CASE frequency WHEN 'monthly' THEN 30 WHEN 'quarterly' THEN 91 ELSE 365 END AS next_days,
 coalesce(covered_until >= last_date + CASE frequency WHEN 'monthly' THEN 46 WHEN 'quarterly' THEN 136 ELSE 548 END, false) AS ended,
 payments >= 2 AND abs(last_c - first_c) * 100 > first_c * 2 AS moved
 FROM sd LEFT JOIN hs ON hs.household_id = sd.household_id AND hs.payee = sd.payee LEFT JOIN {_common('name')} cn ON cn.household_id = sd.household_id AND cn.payee = sd.payee
 LEFT JOIN {_common('category')} cc ON cc.household_id = sd.household_id AND cc.payee = sd.payee LEFT JOIN cv ON cv.household_id = sd.household_id
 LEFT JOIN categories k ON k.key = cc.category),
mc AS (SELECT *, {big(sql_half_up('last_c', 'per'))} AS monthly_c FROM pr),
subs AS (SELECT household_id, key, common_name AS name, common_category AS category_key, coalesce(label, 'Uncategorized') AS category,
 CASE WHEN common_category IN {BILLS} THEN 'bill' ELSE 'subscription' END AS section, last_c / 100 AS amount, frequency, monthly_c, monthly_c / 100 AS monthly_cost, monthly_c * 12 / 100 AS yearly_cost,
 payments, first_date, last_date, CASE WHEN NOT ended THEN last_date + next_days END AS next_expected, CASE WHEN ended THEN 'ended' ELSE 'active' END AS status, evidence,
 CASE WHEN payments >= 3 THEN 'confirmed' WHEN evidence <> 'category' THEN 'likely' ELSE 'assumed' END AS confidence,
 CASE WHEN moved THEN first_c / 100 END AS price_from, CASE WHEN moved THEN last_c / 100 END AS price_to, history, hidden FROM mc WHERE NOT hidden)
"""


#: Expected executions and buys, paired one by one, the closest first.
PLANNED = INV.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
cov AS (SELECT household_id, bank AS broker, last_day(make_date(cast(max(month_index) // 12 AS int), cast(max(month_index) % 12 + 1 AS int), 1)) AS covered_until
 FROM statements WHERE bank IN {BROKERS} GROUP BY ALL),
flo AS (SELECT household_id, broker, min(date) AS first_day FROM inv GROUP BY ALL),
sp AS (SELECT p.*, covered_until, coalesce(first_day, {T}) - 3 AS lowest, least(coalesce(covered_until, {T}), {T}) AS horizon FROM plans p
 LEFT JOIN cov ON cov.household_id = p.household_id AND cov.broker = p.broker LEFT JOIN flo ON flo.household_id = p.household_id AND flo.broker = p.broker WHERE anchor_date IS NOT NULL),
""" + EXEC.removeprefix("WITH ").replace("greatest(date '1996-02-10', start_date)", "coalesce(start_date, lowest)").replace(
    "least(date '1997-04-20', end_date)", "least(greatest(horizon, lowest), end_date)").replace("FROM plans p WHERE anchor_date IS NOT NULL", "FROM sp p") + """,
slots AS (SELECT p.household_id, p.broker, p.amount_c, d.day, p.id AS plan_id, p.instrument, p.covered_until
 FROM (SELECT household_id, id, day FROM weekly UNION ALL SELECT household_id, id, day FROM monthly_days WHERE day BETWEEN lo AND hi) d JOIN sp p ON p.household_id = d.household_id AND p.id = d.id),
ob AS (SELECT * FROM inv WHERE amount_c > 0 AND code IS NULL AND (household_id, ref) NOT IN (SELECT household_id, booking_ref FROM splits)),
fit AS (SELECT s.household_id, s.broker, s.amount_c, s.plan_id, s.day AS slot_day, s.plan_id || ':' || s.day AS slot, b.id,
 row_number() OVER (PARTITION BY s.household_id, s.broker, s.amount_c ORDER BY abs(b.date - s.day), s.day, b.date, s.plan_id, b.id) AS k
 FROM slots s JOIN ob b ON b.household_id = s.household_id AND b.broker = s.broker AND b.amount_c = s.amount_c AND abs(b.date - s.day) <= 3),
gf AS (SELECT DISTINCT household_id, broker, amount_c, cast(0 AS bigint) AS k, cast([] AS varchar[]) AS slots, cast([] AS bigint[]) AS buys, cast(NULL AS bigint) AS plan_id, cast(NULL AS date) AS slot_day,
  cast(NULL AS bigint) AS id, false AS keep FROM fit
 UNION ALL SELECT household_id, broker, amount_c, k, CASE WHEN ok THEN list_append(slots, slot) ELSE slots END, CASE WHEN ok THEN list_append(buys, id) ELSE buys END, plan_id, slot_day, id, ok
 FROM (SELECT f.household_id, f.broker, f.amount_c, f.k, g.slots, g.buys, f.plan_id, f.slot_day, f.slot, f.id, NOT list_contains(g.slots, f.slot) AND NOT list_contains(g.buys, f.id) AS ok
  FROM gf g JOIN fit f ON f.household_id = g.household_id AND f.broker = g.broker AND f.amount_c = g.amount_c AND f.k = g.k + 1) x),
asg AS (SELECT household_id, broker, amount_c, plan_id, slot_day, id FROM gf WHERE keep)
"""
MISSED = f""",
missed AS (SELECT s.household_id, s.broker, s.plan_id, s.instrument, s.amount_c, s.day, a.id IS NOT NULL AS found FROM slots s
 LEFT JOIN asg a ON a.household_id = s.household_id AND a.plan_id = s.plan_id AND a.slot_day = s.day WHERE s.day + 3 <= least(s.covered_until, {T}) AND s.covered_until IS NOT NULL)
"""
RESOLVED = PLANNED + """,
rest AS (SELECT * FROM ob WHERE (household_id, id) NOT IN (SELECT household_id, id FROM asg)),
cl AS (SELECT DISTINCT household_id, broker, amount_c, date AS day FROM rest),
ac AS (SELECT c.*, p.id AS pid, p.instrument, p.amount_c AS pa, p.anchor_date FROM cl c JOIN plans p ON p.household_id = c.household_id AND p.broker = c.broker
 AND coalesce(p.start_date <= c.day, true) AND coalesce(p.end_date >= c.day, true)),
fi AS (SELECT household_id, broker, amount_c, day, string_agg(DISTINCT instrument, ', ' ORDER BY instrument) AS names, count(DISTINCT instrument) AS k, min(pid) AS plan_id
 FROM ac WHERE anchor_date IS NULL AND pa = amount_c GROUP BY ALL),
gs AS (SELECT cl.household_id, cl.broker, cl.amount_c, cl.day, names, plan_id, CASE WHEN k = 1 THEN 'plan_amount' WHEN k > 1 THEN 'ambiguous'
  WHEN EXISTS (SELECT 1 FROM ac WHERE ac.household_id = cl.household_id AND ac.broker = cl.broker AND ac.day = cl.day) THEN 'manual_buy' END AS src
 FROM cl LEFT JOIN fi USING (household_id, broker, amount_c, day)),
ty AS (SELECT household_id, booking_ref AS ref, min(instrument) AS typed FROM splits GROUP BY ALL),
resolved AS (SELECT i.household_id, i.id, i.broker, i.date, i.amount_c, i.counterparty, i.description, i.code, i.ref,
 coalesce(ty.typed, CASE WHEN i.code IS NOT NULL THEN i.counterparty END, p.instrument,
  CASE WHEN r.id IS NOT NULL THEN CASE src WHEN 'plan_amount' THEN names WHEN 'manual_buy' THEN 'Manual buys' ELSE 'Unknown' END END, 'Unknown') AS instrument,
 CASE WHEN ty.typed IS NOT NULL THEN 'manual' WHEN i.code IS NOT NULL THEN 'booking' WHEN p.instrument IS NOT NULL THEN 'plan' ELSE coalesce(src, 'unknown') END AS source,
 CASE WHEN ty.typed IS NULL AND i.code IS NULL THEN coalesce(a.plan_id, CASE WHEN src = 'plan_amount' THEN gs.plan_id END) END AS plan_id,
 CASE WHEN ty.typed IS NULL AND src = 'ambiguous' THEN names END AS candidates
 FROM inv i LEFT JOIN ty ON ty.household_id = i.household_id AND ty.ref = i.ref LEFT JOIN asg a ON a.household_id = i.household_id AND a.id = i.id
 LEFT JOIN plans p ON p.household_id = a.household_id AND p.id = a.plan_id LEFT JOIN rest r ON r.household_id = i.household_id AND r.id = i.id
 LEFT JOIN gs ON gs.household_id = r.household_id AND gs.broker = r.broker AND gs.amount_c = r.amount_c AND gs.day = r.date)
"""


def _with_start(clustered):
    """Clusters named by the payment they began with instead of by number."""
    first = F.min(F.struct("date", "first_id")).over(W.partitionBy("household_id", "payee", "island", "cluster"))
    return clustered.withColumn("start", first["first_id"]).drop("island", "cluster")


QUERIES = [
    # subscriptions
    Query("recurring_payments", B.recurring_payments, PAYMENTS + " SELECT * FROM pay"),
    Query("payments_covered_until", lambda L: B.covered_until(B.recurring_payments(L), list(L.keys)),
          PAYMENTS + " SELECT household_id, max(bank_day) AS covered_until FROM pay GROUP BY ALL"),
    Query("payment_frequency", lambda L: U.payment_frequency(
        B.recurring_payments(L).select("household_id", "payee", "date").distinct(), ["household_id", "payee"]), PAYMENTS + f""",
dd AS (SELECT DISTINCT household_id, payee, date FROM pay),
gp AS (SELECT *, date - lag(date) OVER (PARTITION BY household_id, payee ORDER BY date) AS gap FROM dd),
ag AS (SELECT household_id, payee, count(*) AS payments, count(gap) AS gaps, median(gap) AS med, count(DISTINCT {mi('date')}) AS months, min(date) AS first_date,
 count(*) FILTER (gap BETWEEN 25 AND 36) AS a, count(*) FILTER (gap BETWEEN 80 AND 100) AS b, count(*) FILTER (gap BETWEEN 345 AND 385) AS c FROM gp GROUP BY ALL)
SELECT household_id, payee, payments, cast(med AS double) AS median_gap, cast(months AS int) AS months, first_date,
 CASE WHEN months < 2 THEN NULL WHEN med BETWEEN 25 AND 36 AND a * 10 >= gaps * 6 THEN 'monthly' WHEN med BETWEEN 80 AND 100 AND b * 10 >= gaps * 6 THEN 'quarterly'
  WHEN med BETWEEN 345 AND 385 AND c * 10 >= gaps * 6 THEN 'yearly' END AS frequency FROM ag"""),
    Query("apply_rules", lambda L: U.apply_rules(
        B.recurring_payments(L).groupBy("household_id", "payee").agg(F.count("*").alias("payments"))
        .withColumn("frequency", F.lit("monthly")).withColumn("evidence", F.lit("pattern")), L), PAYMENTS + """
SELECT p.household_id, payee, payments, CASE WHEN r.frequency IS NOT NULL THEN r.frequency ELSE 'monthly' END AS frequency,
 CASE WHEN r.frequency IS NOT NULL THEN 'you' ELSE 'pattern' END AS evidence, replace(payee, ' ', '-') AS slug, coalesce(hidden, false) AS hidden
FROM (SELECT household_id, payee, count(*) AS payments FROM pay GROUP BY ALL) p LEFT JOIN rules r ON r.household_id = p.household_id AND r.key = replace(payee, ' ', '-')"""),
    Query("cluster_amounts", lambda L: _with_start(U.cluster_amounts(B.recurring_payments(L), list(L.keys))), CLUSTERS + """
SELECT household_id, payee, start, date, amount_c, id AS first_id, name, category FROM kept"""),
    Query("detect_recurring", U.detect_recurring, RECURRING + """
SELECT household_id, payee, evidence, frequency, date, amount_c, first_id, name, category FROM recurring"""),
    Query("subscription_items", lambda L: U.sorted_items(U.subscription_items(L), L).withColumn("history", F.array_join(F.transform(
        "history", lambda h: F.concat_ws(" ", h["date"].cast("string"), F.round(h["amount"] * 100).cast("bigint").cast("string"))), ",")), ITEMS + "SELECT * FROM subs"),
    Query("subscription_summary", lambda L: U.subscription_summary(U.subscription_items(L), L), ITEMS + f"""
SELECT household_id, {big('sum(monthly_c)')} / 100 AS monthly_total, {big('sum(monthly_c)')} * 12 / 100 AS yearly_total, count(*) AS active,
 {big("coalesce(sum(monthly_c) FILTER (confidence = 'assumed'), 0)")} / 100 AS assumed_monthly, {big("coalesce(sum(monthly_c) FILTER (section = 'subscription'), 0)")} / 100 AS subscriptions_monthly,
 {big("coalesce(sum(monthly_c) FILTER (section = 'bill'), 0)")} / 100 AS bills_monthly, count(*) FILTER (price_to > price_from) AS price_rises
FROM subs WHERE status = 'active' GROUP BY ALL"""),
    # investments
    Query("investment_bookings", B.investment_bookings, INV + "SELECT household_id, id, broker, date, amount_c, counterparty, description, code, ref FROM inv"),
    Query("bookings_newest_first", lambda L: B.bookings_newest_first(L, "N26"),
          INV + "SELECT household_id, id, broker, date, amount_c / 100 AS amount, counterparty, code FROM inv WHERE broker = 'N26'"),
    Query("depot_side_flows", B.depot_side_flows, f"""
WITH d AS (SELECT household_id, id, bank AS broker, booking_date AS date, abs(amount_c) AS amount_c, substr(description, 1, 90) AS text,
 CASE WHEN kind IN ('income', 'refund') AND amount_c > 0 THEN 'received'
  WHEN kind IN ('fee', 'spend') AND amount_c < 0 AND (kind = 'fee' OR category = 'taxes_fees') THEN 'cost' END AS side
 FROM tx WHERE kind <> 'investment' AND (bank = 'Commerzbank' OR (bank = 'N26' AND contains(lower(counterparty || ' ' || description), 'equities'))))
SELECT * FROM d WHERE side IS NOT NULL"""),
    Query("depot_side_totals", B.depot_side_totals, f"""
WITH d AS (SELECT household_id, abs(amount_c) AS c, CASE WHEN kind IN ('income', 'refund') AND amount_c > 0 THEN 'received'
  WHEN kind IN ('fee', 'spend') AND amount_c < 0 AND (kind = 'fee' OR category = 'taxes_fees') THEN 'cost' END AS side
 FROM tx WHERE kind <> 'investment' AND (bank = 'Commerzbank' OR (bank = 'N26' AND contains(lower(counterparty || ' ' || description), 'equities'))))
SELECT household_id, side, {big('sum(c)')} / 100 AS total, count(*) AS entries FROM d WHERE side IS NOT NULL GROUP BY ALL"""),
    Query("broker_coverage", I.broker_coverage, f"""
SELECT household_id, bank AS broker, count(DISTINCT month_index) AS months,
 last_day(make_date(cast(max(month_index) // 12 AS int), cast(max(month_index) % 12 + 1 AS int), 1)) AS covered_until
FROM statements WHERE bank IN {BROKERS} GROUP BY ALL"""),
    Query("broker_totals", lambda L: I.broker_totals(L, _named(L)), NAMED + f""",
g AS (SELECT household_id, broker, {big('sum(amount_c)')} AS c, count(*) AS n, {big("coalesce(sum(amount_c) FILTER (instrument = 'Unknown'), 0)")} AS u FROM nm GROUP BY ALL),
l AS (SELECT household_id, unnest(['N26', 'Commerzbank']) AS broker FROM (SELECT DISTINCT household_id FROM statements) h)
SELECT household_id, broker, coalesce(c, 0) / 100 AS net, coalesce(n, 0) AS bookings, coalesce(u, 0) / 100 AS unknown FROM g FULL JOIN l USING (household_id, broker)"""),
    Query("investment_months", lambda L: I.investment_months(L, _named(L), TODAY), NAMED + _months(False) + f"""
SELECT household_id, cast(m AS int) AS month_index, {label('m')} AS label, covered, net_c / 100 AS net, bought_c / 100 AS bought, sold_c / 100 AS sold, n AS count FROM mon"""),
    Query("investment_month_instruments", lambda L: I.investment_month_parts(L, _named(L), "instrument"), NAMED +
          f"SELECT household_id, m AS month_index, instrument, {big('sum(amount_c)')} / 100 AS net FROM nm GROUP BY ALL"),
    Query("investment_month_brokers", lambda L: I.investment_month_parts(L, _named(L), "broker"), NAMED +
          f"SELECT household_id, m AS month_index, broker, {big('sum(amount_c)')} / 100 AS net FROM nm GROUP BY ALL"),
    Query("investment_years", lambda L: I.investment_years(L, _named(L), TODAY), NAMED + _months(True) + f""",
b AS (SELECT household_id, broker, m // 12 AS y, {big('sum(net_c)')} AS net, count(*) FILTER (covered) AS k FROM mon GROUP BY ALL),
ba AS (SELECT household_id, y, sum(CASE WHEN k > 0 THEN {sql_half_up('net', 'k')} ELSE 0 END) AS a FROM b GROUP BY ALL),
w AS (SELECT household_id, m // 12 AS y, sum(net_c) AS net, sum(bought_c) AS bo, sum(sold_c) AS so, sum(n) AS n FROM mon GROUP BY ALL),
hc AS (SELECT household_id, m // 12 AS y, count(DISTINCT m) AS k FROM mon WHERE covered OR (household_id, m) IN (SELECT household_id, m FROM stm) GROUP BY ALL)
SELECT w.household_id, cast(w.y AS int) AS year, {big('net')} / 100 AS net, {big('bo')} / 100 AS bought, {big('so')} / 100 AS sold, {big('n')} AS count, coalesce(k, 0) AS months, {big('a')} / 100 AS avg_per_month
FROM w JOIN ba ON ba.household_id = w.household_id AND ba.y = w.y LEFT JOIN hc ON hc.household_id = w.household_id AND hc.y = w.y"""),
    Query("investment_avg12", lambda L: I.investment_avg12(L, _named(L), D(2001, 3, 2)), NAMED + _months(True) + f""",
r AS (SELECT household_id, broker, {sql_half_up(big('sum(net_c)'), 'count(*)')} AS a FROM mon WHERE covered AND m > {2001 * 12 + 2 - 12} AND m <= {2001 * 12 + 2} GROUP BY ALL)
SELECT household_id, broker, {big('a')} / 100 AS avg_per_month_12 FROM r UNION ALL SELECT household_id, '(all)', {big('sum(a)')} / 100 FROM r GROUP BY ALL"""),
    Query("instrument_totals", lambda L: I.instrument_totals(L, _named(L)), NAMED + f""",
t AS (SELECT *, coalesce(code, 'name:' || instrument) AS thing FROM nm),
ni AS (SELECT household_id, thing, instrument, count(*) AS n, min(date) AS f FROM t GROUP BY ALL),
nn AS (SELECT household_id, thing, first(instrument ORDER BY n DESC, f, instrument) AS name FROM ni GROUP BY ALL),
g AS (SELECT household_id, thing, any_value(code) AS code, {big('sum(amount_c)')} AS c, count(*) FILTER (amount_c > 0) AS buys, min(date) AS first, max(date) AS last, count(DISTINCT m) AS act,
 array_to_string(list_filter(['N26', 'Commerzbank', 'Sparkasse'], lambda b: list_contains(array_agg(broker), b)), ', ') AS brokers FROM t GROUP BY ALL),
w AS (SELECT *, {big('sum(c) OVER (PARTITION BY household_id)')} AS tot FROM g)
SELECT household_id, code, name, c / 100 AS net, CASE WHEN tot <> 0 THEN {sql_half_up('c * sign(tot) * 1000', 'abs(tot)')} / 10 ELSE 0.0 END AS share_pct, {big('buys')} AS buys, first, last,
 {sql_half_up('c', 'act')} / 100 AS per_month, brokers FROM w JOIN nn USING (household_id, thing)"""),
    Query("investment_totals", lambda L: I.investment_totals(L, _named(L), D(2000, 6, 1)), NAMED + _months(False).replace(str(CUT), str(2000 * 12 + 5)) + f""",
g AS (SELECT household_id, {big('sum(amount_c)')} / 100 AS net, {big('coalesce(sum(amount_c) FILTER (amount_c > 0), 0)')} / 100 AS bought,
 {big('coalesce(sum(-amount_c) FILTER (amount_c < 0), 0)')} / 100 AS sold, {big('coalesce(sum(amount_c) FILTER (year(date) = 2000), 0)')} / 100 AS this_year,
 count(*) AS bookings, min(date) AS first_date, max(date) AS last_date,
 {big("coalesce(sum(amount_c) FILTER (instrument = 'Unknown'), 0)")} / 100 AS unknown_net, count(*) FILTER (instrument = 'Unknown') AS unknown_count,
 {big("coalesce(sum(amount_c) FILTER (instrument = 'Manual buys'), 0)")} / 100 AS manual_net, count(*) FILTER (instrument = 'Manual buys') AS manual_count FROM nm GROUP BY ALL)
SELECT g.*, months_with_statement FROM g JOIN (SELECT household_id, count(*) FILTER (covered) AS months_with_statement FROM mon GROUP BY ALL) m USING (household_id)"""),
    Query("known_instruments", I.known_instruments, "SELECT household_id, instrument FROM plans UNION SELECT household_id, instrument FROM splits"),
    Query("match_plan_amount", lambda L: I.match_plan_amount(I.open_buys(L, B.investment_bookings(L)), L).withColumn("names", F.array_join("names", ",")), INV + """,
cl AS (SELECT DISTINCT household_id, broker, amount_c, date AS day FROM inv WHERE amount_c > 0 AND code IS NULL AND (household_id, ref) NOT IN (SELECT household_id, booking_ref FROM splits)),
ac AS (SELECT c.*, p.id AS pid, p.instrument, p.amount_c AS pa, p.anchor_date FROM cl c JOIN plans p ON p.household_id = c.household_id AND p.broker = c.broker
 AND coalesce(p.start_date <= c.day, true) AND coalesce(p.end_date >= c.day, true)),
fi AS (SELECT household_id, broker, amount_c, day, string_agg(DISTINCT instrument, ',' ORDER BY instrument) AS names, count(DISTINCT instrument) AS k, min(pid) AS plan_id
 FROM ac WHERE anchor_date IS NULL AND pa = amount_c GROUP BY ALL)
SELECT cl.*, names, plan_id, CASE WHEN k = 1 THEN 'plan_amount' WHEN k > 1 THEN 'ambiguous'
  WHEN EXISTS (SELECT 1 FROM ac WHERE ac.household_id = cl.household_id AND ac.broker = cl.broker AND ac.day = cl.day) THEN 'manual_buy' END AS source
FROM cl LEFT JOIN fi USING (household_id, broker, amount_c, day)"""),
    Query("assign_plan_buys", lambda L: I.assign_plan_buys(
        I.plan_slots(L, B.investment_bookings(L), TODAY).select("household_id", "broker", "amount_c", "day", "plan_id"),
        I.open_buys(L, B.investment_bookings(L)).select("household_id", "broker", "amount_c", F.col("date").alias("day"), "id"), list(L.keys)),
        PLANNED + "SELECT household_id, broker, amount_c, plan_id, slot_day, id FROM asg"),
    Query("resolve_instruments", lambda L: I.resolve_instruments(L, TODAY), RESOLVED + "SELECT * FROM resolved"),
    Query("missed_executions", lambda L: I.missed_executions(L, TODAY), PLANNED + MISSED + " SELECT * FROM missed"),
    Query("plan_check", lambda L: I.plan_check(L, TODAY), RESOLVED + MISSED + f"""
SELECT household_id, broker, coalesce(expected, 0) AS expected, coalesce(matched, 0) AS matched, coalesce(expected - matched, 0) AS missed, anchored_plans, unanchored_plans,
 coalesce(mc, 0) AS manual_buy_count, coalesce(mn, 0.0) AS manual_buy_net, coalesce(ac, 0) AS ambiguous_count, coalesce(an, 0.0) AS ambiguous_net
FROM (SELECT household_id, broker, count(*) FILTER ({STATUS} = 'active' AND anchor_date IS NOT NULL) AS anchored_plans, count(*) FILTER ({STATUS} = 'active' AND anchor_date IS NULL) AS unanchored_plans FROM plans GROUP BY ALL) p
LEFT JOIN (SELECT household_id, broker, count(*) AS expected, count(*) FILTER (found) AS matched FROM missed GROUP BY ALL) m USING (household_id, broker)
LEFT JOIN (SELECT household_id, broker, count(*) FILTER (source = 'manual_buy') AS mc, {big("coalesce(sum(amount_c) FILTER (source = 'manual_buy'), 0)")} / 100 AS mn,
 count(*) FILTER (source = 'ambiguous') AS ac, {big("coalesce(sum(amount_c) FILTER (source = 'ambiguous'), 0)")} / 100 AS an FROM resolved GROUP BY ALL) r USING (household_id, broker)"""),
    # plans
    Query("execution_dates", lambda L: V.execution_dates(L.plans, D(1996, 2, 10), D(1997, 4, 20)).select("household_id", "id", "day"), EXEC + """
SELECT * FROM weekly UNION ALL SELECT household_id, id, day FROM monthly_days WHERE day BETWEEN lo AND hi"""),
    Query("plan_view", lambda L: V.plan_view(L, TODAY).drop("note").withColumn(
        "next_dates", F.array_join(F.transform("next_dates", lambda d: d.cast("string")), ",")),
        EXEC.replace("greatest(date '1996-02-10', start_date)", f"greatest({T}, start_date)").replace("least(date '1997-04-20', end_date)", f"least({T} + 400, end_date)") + f""",
days AS (SELECT household_id, id, day FROM weekly UNION ALL SELECT household_id, id, day FROM monthly_days WHERE day BETWEEN lo AND hi),
nx AS (SELECT id, array_to_string(list_sort(list(cast(day AS varchar)))[1:3], ',') AS nd FROM days GROUP BY ALL)
SELECT household_id, p.id, broker, instrument, amount_c / 100 AS amount, frequency, CASE frequency WHEN 'weekly' THEN 'every week' WHEN 'biweekly' THEN 'every two weeks' ELSE 'every month' END AS frequency_label,
 anchor_date, start_date, end_date, {STATUS} AS status, {sql_half_up(f'amount_c * {PER}', '12')} / 100 AS per_month, CASE WHEN {STATUS} = 'ended' THEN '' ELSE coalesce(nd, '') END AS next_dates
FROM plans p LEFT JOIN nx ON nx.id = p.id"""),
    Query("plan_summary", lambda L: V.plan_summary(L, TODAY), f"""
SELECT household_id, count(*) FILTER ({STATUS} = 'active') AS active, count(*) FILTER ({STATUS} = 'ended') AS ended,
 {sql_half_up(big(f"coalesce(sum(amount_c * {PER}) FILTER ({STATUS} = 'active'), 0)"), '12')} / 100 AS per_month FROM plans GROUP BY ALL"""),
    Query("plan_summary_by_broker", lambda L: V.plan_summary_by_broker(L, TODAY), f"""
SELECT household_id, broker, {sql_half_up(big(f'sum(amount_c * {PER})'), '12')} / 100 AS per_month FROM plans WHERE {STATUS} = 'active' GROUP BY ALL"""),
    # matching
    Query("pair_transfers", X.pair_transfers, """
WITH o AS (SELECT * FROM bookings WHERE kind IN ('internal_transfer', 'investment') AND transfer_group IS NULL AND amount_c <> 0),
c AS (SELECT a.household_id, a.id AS out_id, b.id AS in_id FROM o a JOIN o b ON a.household_id = b.household_id AND a.amount_c < 0 AND b.amount_c > 0
 AND a.statement_id <> b.statement_id AND abs(a.amount_c + b.amount_c) <= 1 AND abs(a.booking_date - b.booking_date) <= 5),
u AS (SELECT *, count(*) OVER (PARTITION BY household_id, out_id) AS x, count(*) OVER (PARTITION BY household_id, in_id) AS y FROM c)
SELECT household_id, out_id, in_id, 'auto: same amount, 5 days or less apart, only possible partner' AS reason FROM u WHERE x = 1 AND y = 1
 AND NOT EXISTS (SELECT 1 FROM questions q WHERE q.kind = 'transfer_match' AND q.status = 'no' AND q.transaction_id = out_id AND q.other_transaction_id = in_id)"""),
    Query("mirror_payments", X.mirror_payments, """
WITH e AS (SELECT * FROM tx WHERE (amount_c < 0 AND kind IN ('spend', 'other', 'fee')) OR (amount_c > 0 AND kind = 'refund')),
p AS (SELECT *, trim(coalesce(payment_reference, '')) AS ref FROM e WHERE bank = 'PayPal' AND mirror_of IS NULL),
b AS (SELECT *, trim(coalesce(payment_reference, '')) AS ref FROM e WHERE bank <> 'PayPal' AND id NOT IN (SELECT mirror_of FROM bookings WHERE mirror_of IS NOT NULL)),
k AS (SELECT p.household_id, p.id AS pid, b.id AS bid, p.ref, sign(p.amount_c) = sign(b.amount_c) AS same, abs(p.booking_date - b.booking_date) AS gap,
  p.ref <> '' AND (p.ref = b.ref OR contains(b.description, p.ref)) AS by_ref,
  length(p.counterparty) >= 3 AND (contains(lower(b.counterparty), lower(p.counterparty)) OR contains(lower(b.description), lower(p.counterparty))) AS by_name
 FROM p JOIN b ON b.household_id = p.household_id AND abs(abs(p.amount_c) - abs(b.amount_c)) <= 1 AND abs(p.booking_date - b.booking_date) <= 10),
r1 AS (SELECT household_id, pid, any_value(ref) AS ref, min(bid) AS bid FROM k WHERE by_ref AND same GROUP BY household_id, pid HAVING count(*) = 1),
r2 AS (SELECT household_id, bid, min(pid) AS pid, arg_min(ref, pid) AS ref FROM r1 GROUP BY household_id, bid),
n AS (SELECT * FROM k WHERE by_name AND gap <= 5 AND pid NOT IN (SELECT pid FROM r2) AND bid NOT IN (SELECT bid FROM r2)),
f AS (SELECT household_id, pid, min(bid) AS bid FROM n WHERE same GROUP BY household_id, pid HAVING count(*) = 1),
g AS (SELECT household_id, bid, min(pid) AS pid FROM n GROUP BY household_id, bid HAVING count(*) = 1)
SELECT household_id, pid AS paypal_id, bid AS bank_id, 'auto: PayPal transaction number ' || ref || ' is on the bank booking' AS reason FROM r2
UNION ALL SELECT household_id, pid, bid, 'auto: same merchant, amount and date; only possible partner' FROM f JOIN g USING (household_id, pid, bid)"""),
    # receipts and bookings with a twin of the same reference, and refused pairs, the nearest ones among them
    Query("match_receipts", lambda L: X.match_receipts(L.with_(**{t: derived(L, text) for t, text in CONTESTED.items()})), f"""
WITH RECURSIVE rc AS ({plain(CONTESTED['receipts'])}), bk AS ({plain(CONTESTED['bookings'])}), qs AS ({plain(CONTESTED['questions'])}),
no AS (SELECT DISTINCT household_id, transaction_id AS tid, receipt_id AS rid FROM qs WHERE kind = 'receipt_match' AND status = 'no'),
t AS (SELECT household_id, id, -amount_c AS c, coalesce(purchase_date, booking_date) AS day, {payee('counterparty')} AS mer, payment_reference AS ref,
 CASE WHEN id IN (SELECT tid FROM no) THEN id END AS own FROM bk WHERE amount_c < 0 AND receipt_id IS NULL),
r AS (SELECT household_id, id, total_c AS c, purchase_date AS day, {payee('store_name')} AS mer, payment_reference AS ref FROM rc WHERE NOT linked),
tc AS (SELECT *, min(id) OVER (PARTITION BY household_id, ref, c, own) AS first FROM t WHERE ref <> ''),
pr AS (SELECT r.household_id, r.id AS rid, r.c AS rc, list(tc.id ORDER BY length(tc.ref) DESC, tc.c, tc.first, tc.id) AS tids
 FROM tc JOIN r ON r.household_id = tc.household_id AND abs(tc.c - r.c) <= 1 AND starts_with(r.ref, tc.ref)
 WHERE NOT EXISTS (SELECT 1 FROM no WHERE no.household_id = r.household_id AND no.tid = tc.id AND no.rid = r.id) GROUP BY ALL),
rr AS (SELECT *, row_number() OVER (PARTITION BY household_id ORDER BY rc, rid) AS k FROM pr),
fold AS (SELECT DISTINCT household_id, cast(0 AS bigint) AS k, cast([] AS bigint[]) AS used, cast(NULL AS bigint) AS tid, cast(NULL AS bigint) AS rid FROM rr
 UNION ALL SELECT household_id, k, CASE WHEN tid IS NULL THEN used ELSE list_append(used, tid) END, tid, rid
 FROM (SELECT f.household_id, rr.k, f.used, list_filter(rr.tids, lambda x: NOT list_contains(f.used, x))[1] AS tid, rr.rid FROM fold f JOIN rr ON rr.household_id = f.household_id AND rr.k = f.k + 1)),
pf AS (SELECT household_id, tid, rid FROM fold WHERE tid IS NOT NULL),
k AS (SELECT t.household_id, t.id AS tid, r.id AS rid, t.day - r.day AS gap FROM t JOIN r ON r.household_id = t.household_id AND r.mer = t.mer AND abs(t.c - r.c) <= 1 AND t.day - r.day BETWEEN 0 AND 14
 WHERE t.id NOT IN (SELECT tid FROM pf) AND r.id NOT IN (SELECT rid FROM pf)
  AND NOT EXISTS (SELECT 1 FROM no WHERE no.household_id = r.household_id AND no.tid = t.id AND no.rid = r.id)),
z AS (SELECT *, count(*) OVER (PARTITION BY household_id, tid) AS x, count(*) OVER (PARTITION BY household_id, rid) AS y, row_number() OVER (PARTITION BY household_id, tid ORDER BY gap, rid) AS rn FROM k)
SELECT household_id, tid AS transaction_id, rid AS receipt_id, 'certain' AS confidence, 'payment reference is on the receipt' AS reason FROM pf
UNION ALL SELECT household_id, tid, rid, CASE WHEN x = 1 AND y = 1 THEN 'certain' ELSE 'likely' END,
 CASE WHEN x = 1 AND y = 1 THEN 'same merchant and amount, only possible partner' ELSE 'same merchant and amount, several could fit' END FROM z WHERE rn = 1"""),
    Query("balance_chain_breaks", X.balance_chain_breaks, """
SELECT b.household_id, b.bank, b.owner, b.month_index, a.id AS previous_id, b.id, a.closing_c / 100 AS previous_closing, b.opening_c / 100 AS opening
FROM statements a JOIN statements b ON a.household_id = b.household_id AND a.bank = b.bank AND a.owner = b.owner AND b.month_index = a.month_index + 1
WHERE abs(b.opening_c - a.closing_c) > 2"""),
]
