from __future__ import annotations

from ..operators import entries as N
from ..operators import finders as B
from ..operators import metrics as M
from ..operators import spending as S
from ..operators import trends as R
from .common import MONTH, TODAY, YEAR, Query, big, dt, label, mi, sql_half_even, sql_half_up, sql_pct

D = dt.date
LO, HI = D(1998, 4, 1), D(1998, 6, 30)
NOW = f"year(date) = {YEAR} AND month(date) = {MONTH}"
PREV = f"year(date) = {YEAR} AND month(date) = {MONTH - 1}"
AT = YEAR * 12 + MONTH - 1
RANGE = (6, (1998, 5), D(1998, 5, 20))  # six months up to May 1998, looked at on 20 May
FIRST, LAST = AT - 5, AT

TX_COLUMNS = """household_id, id AS transaction_id, bank,
 (mirror_of IS NOT NULL OR EXISTS (SELECT 1 FROM bookings m WHERE m.mirror_of = t.id)) AS mirrored,
 booking_date, purchase_date, amount_c / 100 AS amount, counterparty, channel, payment_reference, kind,
 substr(description, 1, 160) AS description, receipt_id AS linked_receipt_id, transfer_group"""

CELLS = f"""WITH cells AS (SELECT household_id, {mi('date')} AS month_index, key, label, grp, fixed, {big('sum(amount_c)')} AS amount_c
  FROM entries WHERE {mi('date')} BETWEEN {FIRST} AND {LAST} GROUP BY ALL),
sums AS (SELECT household_id, month_index, {big('sum(amount_c)')} AS total_c,
  {big('coalesce(sum(amount_c) FILTER (fixed), 0)')} AS fixed_c FROM cells GROUP BY ALL),
done AS (SELECT *, row_number() OVER (PARTITION BY household_id ORDER BY month_index DESC) AS rk,
  count(*) OVER (PARTITION BY household_id) AS n FROM sums WHERE month_index < {AT} AND total_c > 0)
"""

STATEMENT_COLUMNS = """household_id, id, bank, owner,
 ['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'][cast(month_index % 12 + 1 AS int)] AS month,
 cast(month_index // 12 AS int) AS year, opening_c / 100 AS starting_balance, closing_c / 100 AS closing_balance"""

FACTS = f"""WITH facts AS (
 SELECT household_id, statement_month AS month_index, CASE WHEN amount_c > 0 AND kind NOT IN ('internal_transfer', 'investment') THEN amount_c ELSE 0 END AS income_c,
   CASE WHEN kind = 'investment' AND amount_c < 0 THEN -amount_c ELSE 0 END AS invested_c, 0 AS spent_c, 0 AS fixed_c, 0 AS receipt_c, 0 AS bank_c, 0 AS receipts, 0 AS seen
 FROM tx WHERE mirror_of IS NULL
 UNION ALL SELECT household_id, {mi('date')}, 0, 0, amount_c, CASE WHEN fixed THEN amount_c ELSE 0 END,
   CASE WHEN source = 'receipt' THEN amount_c ELSE 0 END, CASE WHEN source = 'bank' THEN amount_c ELSE 0 END, 0, 0 FROM entries
 UNION ALL SELECT household_id, month_index, 0, 0, 0, 0, 0, 0, 0, 1 FROM statements
 UNION ALL SELECT household_id, {mi('purchase_date')}, 0, 0, 0, 0, 0, 0, 1, 1 FROM receipts),
msums AS (SELECT household_id, month_index, {', '.join(f"{big(f'sum({c})')} AS {c}" for c in M.SUMS)}
 FROM facts GROUP BY ALL HAVING sum(seen) > 0)
"""
RATES = f"""income_c / 100 AS gross_income, spent_c / 100 AS lifestyle_expenses, (income_c - spent_c) / 100 AS net_savings,
 {sql_pct('income_c - spent_c', 'income_c', 2)} AS savings_rate_pct, invested_c / 100 AS total_invested,
 CASE WHEN spent_c > 0 THEN cast({sql_half_even('fixed_c * 100', 'spent_c')} AS varchar) || '% Fixed / '
   || cast(100 - {sql_half_even('fixed_c * 100', 'spent_c')} AS varchar) || '% Variable'
   ELSE '0% Fixed / 0% Variable' END AS fixed_vs_variable_ratio"""
KEYSUMS = f"""WITH income AS (SELECT key FROM categories WHERE flow = 'income'),
present AS (SELECT household_id, month_index FROM statements UNION SELECT household_id, {mi('purchase_date')} FROM receipts),
keysums AS (SELECT household_id, month_index, key, flow, {big('sum(amount_c)')} AS amount_c FROM (
 SELECT household_id, statement_month AS month_index,
  CASE WHEN category IN (SELECT key FROM income) THEN category WHEN kind = 'refund' THEN 'refunds_returns' ELSE 'other_income' END AS key,
  'income' AS flow, amount_c FROM tx WHERE mirror_of IS NULL AND amount_c > 0 AND kind NOT IN ('internal_transfer', 'investment')
 UNION ALL SELECT household_id, statement_month, 'investments', 'investment', -amount_c FROM tx
  WHERE mirror_of IS NULL AND amount_c < 0 AND kind = 'investment'
 UNION ALL SELECT household_id, {mi('date')}, key, 'expense', amount_c FROM entries) x
 WHERE (household_id, month_index) IN (SELECT household_id, month_index FROM present) GROUP BY ALL)
"""
P_START, P_END = (1998, 1), (1998, 6)
P_RANGE = f"month_index BETWEEN {1998 * 12} AND {1998 * 12 + 5}"


def _period(where: str) -> str:
    return FACTS + f""", p AS (SELECT household_id, count(*) AS period_months_count, {', '.join(f"{big(f'sum({c})')} AS {c}" for c in M.SUMS)}
 FROM msums WHERE {where} GROUP BY ALL) SELECT household_id, period_months_count, {RATES} FROM p"""


QUERIES = [
    # scans and finders
    Query("find_receipts", lambda L: B.find_receipts(L, LO, HI, limit=20), f"""
SELECT household_id, id AS receipt_id, owner, store_name AS store, purchase_date, total_c / 100 AS total, payment_method, payment_reference
FROM receipts WHERE purchase_date BETWEEN date '{LO}' AND date '{HI}' AND NOT linked
QUALIFY row_number() OVER (PARTITION BY household_id ORDER BY purchase_date, id) <= 20"""),
    Query("find_transactions", lambda L: B.find_transactions(L, LO, HI, exclude_bank="PayPal"), f"""
SELECT {TX_COLUMNS} FROM tx t WHERE (booking_date BETWEEN date '{LO}' AND date '{HI}' OR purchase_date BETWEEN date '{LO}' AND date '{HI}')
 AND kind = 'spend' AND receipt_id IS NULL AND bank <> 'PayPal'
QUALIFY row_number() OVER (PARTITION BY household_id ORDER BY booking_date, id) <= 80"""),
    Query("find_unmirrored", lambda L: B.find_transactions(L, LO, HI, only_unlinked=False, kind=None, unmirrored=True, limit=30), f"""
SELECT {TX_COLUMNS} FROM tx t WHERE (booking_date BETWEEN date '{LO}' AND date '{HI}' OR purchase_date BETWEEN date '{LO}' AND date '{HI}')
 AND mirror_of IS NULL AND NOT EXISTS (SELECT 1 FROM bookings m WHERE m.mirror_of = t.id)
QUALIFY row_number() OVER (PARTITION BY household_id ORDER BY booking_date, id) <= 30"""),
    Query("statements_for_month", lambda L: B.statements_for_month(L, "May", 1998),
          f"SELECT {STATEMENT_COLUMNS} FROM statements WHERE month_index = {AT}"),
    Query("statements_in_range", lambda L: B.statements_in_range(L, ("Nov", 1997), ("Feb", 1998)),
          f"SELECT {STATEMENT_COLUMNS} FROM statements WHERE month_index BETWEEN {1997 * 12 + 10} AND {1998 * 12 + 1}"),
    Query("statements_latest_first", B.statements_latest_first, f"SELECT {STATEMENT_COLUMNS} FROM statements"),
    Query("recheck_candidates", lambda L: B.recheck_candidates(L, ["old_key", "shopping_general"], True, LO, HI).drop("part"), f"""
SELECT i.household_id, i.id, 'i' || i.id AS ref, 'i' || i.id || ' | ' || store_name || ' | ' || name || ' | '
  || cast(cast((quantity * unit_c - i.discount_c) / 100.0 AS decimal(18,2)) AS varchar) || ' | now=' || coalesce(spend_category, 'none') AS line
FROM items i JOIN receipts r ON r.id = i.receipt_id
WHERE (spend_category IN ('old_key', 'shopping_general') OR spend_category IS NULL) AND purchase_date BETWEEN date '{LO}' AND date '{HI}'
UNION ALL SELECT household_id, id, 't' || id, 't' || id || ' | ' || counterparty || ' | ' || substr(description, 1, 90) || ' | '
  || CASE WHEN amount_c < 0 THEN '' ELSE '+' END || cast(cast(amount_c / 100.0 AS decimal(18,2)) AS varchar) || ' | kind=' || kind
  || ' | now=' || coalesce(category, 'none')
FROM bookings WHERE kind NOT IN ('internal_transfer', 'investment') AND (category IN ('old_key', 'shopping_general') OR category IS NULL)
 AND booking_date BETWEEN date '{LO}' AND date '{HI}'"""),
    Query("recheck_batches", lambda L: B.with_batches(B.recheck_candidates(L), list(L.keys)).select("household_id", "ref", "batch"), """
SELECT household_id, ref, cast((row_number() OVER (PARTITION BY household_id ORDER BY part, id) - 1) // 100 AS bigint) AS batch FROM (
 SELECT household_id, 0 AS part, id, 'i' || id AS ref FROM items UNION ALL
 SELECT household_id, 1, id, 't' || id FROM bookings WHERE kind NOT IN ('internal_transfer', 'investment')) x"""),
    Query("recheck_batch_counts", lambda L: B.batch_counts(B.recheck_candidates(L), list(L.keys)), """
SELECT household_id, count(*) AS entries, cast(ceil(count(*) / 100) AS bigint) AS batches FROM (
 SELECT household_id FROM items UNION ALL
 SELECT household_id FROM bookings WHERE kind NOT IN ('internal_transfer', 'investment')) x GROUP BY ALL"""),
    Query("open_questions", lambda L: B.open_questions(L).drop("created_at"),
          "SELECT household_id, id, kind, question, transaction_id, receipt_id, other_transaction_id FROM questions WHERE status = 'open'"),
    Query("unpaired_transfers", B.unpaired_transfers, """
SELECT household_id, id, bank, booking_date, amount_c / 100 AS amount, kind, counterparty FROM tx
WHERE kind IN ('internal_transfer', 'investment') AND transfer_group IS NULL"""),
    Query("moved_out", B.moved_out, """
SELECT household_id, id, bank AS broker, booking_date AS date, -amount_c / 100 AS amount, substr(description, 1, 90) AS text FROM tx
WHERE bank IN ('N26', 'Commerzbank', 'Sparkasse') AND kind = 'internal_transfer' AND transfer_group IS NULL
 AND link_reason = 'set by household: not an investment'"""),
    Query("bookings_with_statement", lambda L: B.bookings(L).select("household_id", "id", "bank", "owner", "statement_month"),
          "SELECT household_id, id, bank, owner, statement_month FROM tx"),
    Query("mirrored_ids", B.mirrored_ids, "SELECT DISTINCT household_id, mirror_of AS id FROM bookings WHERE mirror_of IS NOT NULL"),
    Query("stock_base", lambda L: B.stock_base(L).select("household_id", "id", "name", "store_name", "owner"), """
SELECT i.household_id, i.id, name, store_name, owner FROM items i JOIN receipts r ON r.id = i.receipt_id
WHERE spend_category IS NULL OR spend_category NOT IN ('eating_out', 'takeaway', 'deposit')"""),
    Query("category_fallback", lambda L: N.with_category(L.bookings.select("household_id", "id", "category"), L), """
SELECT household_id, id, coalesce(c.key, 'uncategorized') AS key, coalesce(label, 'Uncategorized') AS label,
 coalesce(group_name, 'Other') AS "group", coalesce(fixed, false) AS fixed FROM bookings b LEFT JOIN expense c ON c.key = b.category"""),
    # one month
    Query("spend_entries", lambda L: N.spend_entries(L, LO, HI).drop("label", "group"), f"""
SELECT household_id, source, amount_c, owner, store, date, key, fixed FROM entries WHERE date BETWEEN date '{LO}' AND date '{HI}'"""),
    Query("month_categories", lambda L: S.month_categories(L, YEAR, MONTH), f"""
WITH a AS (SELECT household_id, key, label, grp, fixed, {big(f'sum(amount_c) FILTER ({NOW})')} AS amount_c,
 {big(f"coalesce(sum(amount_c) FILTER ({NOW} AND source = 'receipt'), 0)")} AS receipt_c,
 {big(f"coalesce(sum(amount_c) FILTER ({NOW} AND source = 'bank'), 0)")} AS bank_c,
 {big(f'coalesce(sum(amount_c) FILTER ({PREV}), 0)')} AS previous_c FROM entries GROUP BY ALL HAVING count(*) FILTER ({NOW}) > 0),
b AS (SELECT *, {big('sum(amount_c) OVER (PARTITION BY household_id)')} AS t FROM a)
SELECT household_id, key, label, grp AS "group", fixed, amount_c / 100 AS amount, receipt_c / 100 AS receipt_amount, bank_c / 100 AS bank_amount,
 {sql_pct('amount_c', 't', 1)} AS share_pct, previous_c / 100 AS previous_amount FROM b"""),
    Query("month_groups", lambda L: S.month_groups(L, YEAR, MONTH), f"""
WITH a AS (SELECT household_id, grp, {big('sum(amount_c)')} AS amount_c FROM entries WHERE {NOW} GROUP BY ALL),
b AS (SELECT *, {big('sum(amount_c) OVER (PARTITION BY household_id)')} AS t FROM a)
SELECT household_id, grp AS "group", amount_c / 100 AS amount, {sql_pct('amount_c', 't', 1)} AS share_pct FROM b"""),
    Query("month_owners", lambda L: S.month_owners(L, YEAR, MONTH), f"""
SELECT household_id, coalesce(owner, 'Unknown') AS owner, {big('sum(amount_c)')} / 100 AS amount FROM entries WHERE {NOW} GROUP BY ALL"""),
    Query("month_stores", lambda L: S.month_stores(L, YEAR, MONTH, top=3), f"""
WITH a AS (SELECT household_id, store, {big('sum(amount_c)')} AS c FROM entries WHERE {NOW} GROUP BY ALL)
SELECT household_id, store, c / 100 AS amount FROM a QUALIFY row_number() OVER (PARTITION BY household_id ORDER BY c DESC, store) <= 3"""),
    Query("month_totals", lambda L: S.month_totals(L, YEAR, MONTH), f"""
WITH s AS (SELECT household_id, {big(f'coalesce(sum(amount_c) FILTER ({NOW}), 0)')} AS t,
 {big(f"coalesce(sum(amount_c) FILTER ({NOW} AND source = 'receipt'), 0)")} AS r, {big(f"coalesce(sum(amount_c) FILTER ({NOW} AND source = 'bank'), 0)")} AS b,
 {big(f'coalesce(sum(amount_c) FILTER ({PREV}), 0)')} AS p, count(*) FILTER ({NOW} AND key = 'uncategorized') AS un,
 {big(f"coalesce(sum(amount_c) FILTER ({NOW} AND key = 'uncategorized'), 0)")} AS uc FROM entries WHERE {NOW} OR {PREV} GROUP BY ALL),
q AS (SELECT household_id, count(*) AS n, {big('sum(total_c)')} AS bc, {big('sum(discount_c)')} AS dc FROM receipts
 WHERE year(purchase_date) = {YEAR} AND month(purchase_date) = {MONTH} GROUP BY ALL)
SELECT household_id, coalesce(t, 0) / 100 AS total, coalesce(r, 0) / 100 AS receipt_total, coalesce(b, 0) / 100 AS bank_only_total,
 coalesce(p, 0) / 100 AS previous_total, coalesce(n, 0) AS receipts, coalesce({sql_half_up('bc', 'n')} / 100, 0) AS average_basket,
 coalesce(dc, 0) / 100 AS discounts_saved, coalesce(un, 0) AS uncategorized_entries, coalesce(uc, 0) / 100 AS uncategorized_amount
FROM s FULL JOIN q USING (household_id)"""),
    Query("unmatched_receipts", lambda L: S.unmatched_receipts(L, YEAR, MONTH), f"""
SELECT household_id, id AS receipt_id, store_name AS store, purchase_date AS date, total_c / 100 AS total, owner FROM receipts
WHERE year(purchase_date) = {YEAR} AND month(purchase_date) = {MONTH} AND NOT linked
 AND household_id IN (SELECT household_id FROM tx WHERE statement_month = {AT})"""),
    Query("statement_presence", lambda L: S.statement_presence(L, YEAR, MONTH), f"""
WITH s AS (SELECT DISTINCT household_id, true AS s FROM tx WHERE statement_month = {AT}),
r AS (SELECT DISTINCT household_id, true AS r FROM receipts WHERE year(purchase_date) = {YEAR} AND month(purchase_date) = {MONTH})
SELECT household_id, s IS NOT NULL AS has_statement, s IS NULL AND r IS NOT NULL AS awaiting_statement FROM s FULL JOIN r USING (household_id)"""),
    Query("missing_receipts", lambda L: S.missing_receipts(L, YEAR, MONTH), f"""
SELECT household_id, id AS transaction_id, booking_date AS date, -amount_c / 100 AS amount, counterparty FROM tx t
WHERE statement_month = {AT} AND kind = 'spend' AND amount_c < 0 AND receipt_id IS NULL AND EXISTS (
 SELECT 1 FROM receipts r WHERE r.household_id = t.household_id AND (contains(lower(counterparty), lower(store_name)) OR contains(lower(store_name), lower(counterparty))))"""),
    # trends
    Query("trend_months", lambda L: R.trend_months(L, *RANGE), CELLS + f"""
SELECT h.household_id, cast(m AS int) AS month_index, {label('m')} AS label, m >= {AT} AS partial, coalesce(total_c, 0) / 100 AS total,
 coalesce(fixed_c, 0) / 100 AS fixed, (coalesce(total_c, 0) - coalesce(fixed_c, 0)) / 100 AS flexible
FROM (SELECT DISTINCT household_id FROM cells) h CROSS JOIN range({FIRST}, {LAST + 1}) r(m)
LEFT JOIN sums s ON s.household_id = h.household_id AND s.month_index = m"""),
    Query("trend_by_category", lambda L: R.trend_by_category(L, *RANGE[:2]),
          CELLS + "SELECT household_id, month_index, key, amount_c / 100 AS amount FROM cells"),
    Query("trend_by_group", lambda L: R.trend_by_group(L, *RANGE[:2]),
          CELLS + f'SELECT household_id, month_index, grp AS "group", {big("sum(amount_c)")} / 100 AS amount FROM cells GROUP BY ALL'),
    Query("trend_matrix", lambda L: R.trend_matrix(L, *RANGE[:2]), CELLS + "SELECT household_id, key, " + ", ".join(
        f"{big(f'coalesce(sum(amount_c) FILTER (month_index = {FIRST + i}), 0)')} / 100 AS m{i}" for i in range(6)) + " FROM cells GROUP BY ALL"),
    Query("category_averages", lambda L: R.category_averages(L, *RANGE), CELLS + f""",
a AS (SELECT c.household_id, key, label, grp, fixed, {big('sum(c.amount_c)')} AS t, {big('coalesce(sum(c.amount_c) FILTER (d.rk IS NOT NULL), 0)')} AS b
 FROM cells c LEFT JOIN done d ON d.household_id = c.household_id AND d.month_index = c.month_index GROUP BY ALL)
SELECT household_id, key, label, grp AS "group", fixed, t / 100 AS total, coalesce({sql_half_up('b', 'n')} / 100, 0) AS average
FROM a LEFT JOIN (SELECT household_id, max(n) AS n FROM done GROUP BY ALL) n USING (household_id)"""),
    Query("trend_averages", lambda L: R.trend_averages(L, *RANGE), CELLS + f"""
SELECT household_id, count(*) AS finished_months, {sql_half_up(big('sum(total_c)'), 'count(*)')} / 100 AS average_total,
 {sql_half_up(big('sum(fixed_c)'), 'count(*)')} / 100 AS average_fixed FROM done GROUP BY ALL"""),
    Query("spend_movers", lambda L: R.spend_movers(L, *RANGE), CELLS + f""",
m AS (SELECT c.household_id, key, c.label, max(d.n) - 1 AS k, {big('coalesce(sum(c.amount_c) FILTER (rk = 1), 0)')} AS nowc,
 {big('coalesce(sum(c.amount_c) FILTER (rk > 1), 0)')} AS basec FROM cells c JOIN done d ON d.household_id = c.household_id AND d.month_index = c.month_index
 WHERE n >= 2 GROUP BY ALL),
x AS (SELECT *, nowc * k - basec AS diff FROM m WHERE abs(nowc * k - basec) >= 1000 * k),
y AS (SELECT *, CASE WHEN diff > 0 THEN 'up' ELSE 'down' END AS direction, {sql_half_up('diff', 'k')} AS ch FROM x)
SELECT y.household_id, {label('h.month_index')} AS month, k AS baseline_months, key, y.label, direction, nowc / 100 AS now,
 {sql_half_up('basec', 'k')} / 100 AS average, ch / 100 AS change, CASE WHEN basec > 0 THEN {big(sql_half_even('diff * 100', 'basec'))} END AS change_pct
FROM y JOIN done h ON h.household_id = y.household_id AND h.rk = 1
QUALIFY row_number() OVER (PARTITION BY y.household_id, direction ORDER BY abs(ch) DESC, key) <= 5"""),
    Query("spend_pace", lambda L: R.spend_pace(L, YEAR, MONTH, D(1998, 5, 20)), f"""
WITH e AS (SELECT household_id, CASE WHEN {NOW} THEN 'current' ELSE 'previous' END AS which, day(date) AS d, {big('sum(amount_c)')} AS c FROM entries WHERE {NOW} OR {PREV} GROUP BY ALL),
s AS (SELECT household_id, which, cast(d AS int) AS day FROM (SELECT DISTINCT household_id FROM e) h
 CROSS JOIN (SELECT 'current' AS which, unnest(range(1, 21)) AS d UNION ALL SELECT 'previous', unnest(range(1, 31))) x)
SELECT s.household_id, s.which, s.day, {big('sum(coalesce(c, 0)) OVER (PARTITION BY s.household_id, s.which ORDER BY s.day)')} / 100 AS running_total
FROM s LEFT JOIN e ON e.household_id = s.household_id AND e.which = s.which AND e.d = s.day"""),
    Query("pace_summary", lambda L: R.pace_summary(L, YEAR, MONTH, D(1998, 5, 20)), f"""
SELECT household_id, {big(f'coalesce(sum(amount_c) FILTER ({NOW} AND day(date) <= 20), 0)')} / 100 AS current_total,
 {big(f'coalesce(sum(amount_c) FILTER ({PREV} AND day(date) <= 20), 0)')} / 100 AS previous_same_day,
 {big(f'coalesce(sum(amount_c) FILTER ({PREV}), 0)')} / 100 AS previous_total, true AS in_progress,
 bool_or({PREV} AND source = 'bank') AND NOT bool_or({NOW} AND source = 'bank') AS unfair_comparison
FROM entries WHERE {NOW} OR {PREV} GROUP BY ALL"""),
    # month metrics
    Query("month_metrics", M.month_metrics, FACTS + f"SELECT household_id, month_index, {label('month_index')} AS label, {RATES} FROM msums", once=("items",)),
    Query("month_category_metrics", M.month_category_metrics, KEYSUMS + f""",
w AS (SELECT *, {big('sum(amount_c) OVER (PARTITION BY household_id, month_index, flow)')} AS t FROM keysums)
SELECT household_id, month_index, key, flow, amount_c / 100 AS total, {sql_pct('amount_c', 't', 2)} AS percentage_of_total FROM w""", once=("items",)),
    Query("month_sources", M.month_sources, FACTS + f"""
SELECT m.household_id, m.month_index, coalesce(b.statements, '') AS statements, receipts, receipt_c / 100 AS receipt_total,
 bank_c / 100 AS bank_only_total, coalesce(e, false) AS empty_statement
FROM msums m LEFT JOIN (SELECT s.household_id, month_index, string_agg(DISTINCT bank, ',' ORDER BY bank) AS statements,
  bool_or(NOT EXISTS (SELECT 1 FROM bookings k WHERE k.statement_id = s.id)) AS e FROM statements s GROUP BY ALL) b
 ON b.household_id = m.household_id AND b.month_index = m.month_index""", once=("items",)),
    Query("period_stats", lambda L: M.period_stats(L, P_START, P_END), _period(P_RANGE), once=("items",)),
    Query("period_categories", lambda L: M.period_categories(L, P_START, P_END), KEYSUMS + f""",
k AS (SELECT household_id, key, flow, {big('sum(amount_c)')} AS c FROM keysums WHERE {P_RANGE} GROUP BY ALL),
w AS (SELECT *, {big('sum(c) OVER (PARTITION BY household_id, flow)')} AS t FROM k)
SELECT household_id, key, flow, c / 100 AS total, {sql_pct('c', 't', 2)} AS percentage_of_total FROM w""", once=("items",)),
    Query("missing_months", lambda L: M.missing_months(L, (1994, 10), (2002, 3)), f"""
WITH p AS (SELECT household_id, month_index FROM statements UNION SELECT household_id, {mi('purchase_date')} FROM receipts)
SELECT household_id, cast(m AS int) AS month_index, {label('m')} AS label FROM (SELECT DISTINCT household_id FROM p) h
CROSS JOIN range({1994 * 12 + 9}, {2002 * 12 + 3}) r(m) WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.household_id = h.household_id AND p.month_index = m)"""),
    Query("recent_stats", lambda L: M.recent_stats(L, TODAY), _period(f"month_index BETWEEN {TODAY.year * 12 + TODAY.month - 3} AND {TODAY.year * 12 + TODAY.month - 1}")),
]
