from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pantry as P
from ..operators import stock as S
from .common import TODAY, Query, big, sql_half_even, sql_half_up, sql_pct

T = f"date '{TODAY}'"
DAYS = 365

STOCK = f"""WITH st AS (SELECT i.*, r.store_name, r.owner, c.label, c.group_name,
  CASE WHEN storage_condition = 'Frozen' THEN 'freezer' WHEN storage_condition = 'Kept Cool' THEN 'fridge'
   WHEN CASE WHEN c.key IS NOT NULL THEN c.group_name = 'Food' ELSE i.category IN ('Food', 'Drinks') END THEN 'pantry' ELSE 'home' END AS grp,
  greatest(0, unit_c * quantity - i.discount_c) AS net_c
 FROM items i JOIN receipts r ON r.id = i.receipt_id AND r.household_id = i.household_id LEFT JOIN categories c ON c.key = i.spend_category
 WHERE spend_category IS NULL OR spend_category NOT IN ('eating_out', 'takeaway', 'deposit')),
sx AS (SELECT *, CASE WHEN opened_on IS NOT NULL AND grp <> 'home' THEN
   least(date_expiry, opened_on + coalesce(days_once_opened, CASE grp WHEN 'fridge' THEN 4 WHEN 'pantry' THEN 14 ELSE 30 END))
   ELSE date_expiry END AS expiry FROM st),
sv AS (SELECT *, cast(expiry - {T} AS int) AS days_left, cast(round(quantity_left * net_c / quantity) AS bigint) AS value_c,
   regexp_replace(lower(trim(name)), '\\s+', ' ', 'g') AS product FROM sx WHERE quantity_left > 0),
v AS (SELECT *, CASE WHEN days_left IS NULL THEN 'none' WHEN days_left < 0 THEN 'expired' WHEN days_left <= 3 THEN 'soon'
   WHEN days_left <= 7 THEN 'week' ELSE 'ok' END AS urgency, coalesce(days_left < -14, false) AS stale FROM sv)
"""
MOVES = STOCK + f""",
u AS (SELECT *, CASE WHEN waste_reason IN ('gave_away', 'cleared') THEN 0.0::double
   ELSE greatest(0.0::double, quantity - wasted_quantity - quantity_left) END AS used_q,
   wasted_quantity > 0 AND coalesce(wasted_on >= {T} - {DAYS}, false) AS wasted, coalesce(finished_on >= {T} - {DAYS}, false) AS finished FROM sx),
mv AS (SELECT *, CASE WHEN wasted THEN cast(round(wasted_quantity * net_c / quantity) AS bigint) END AS wasted_c,
   CASE WHEN finished THEN cast(round(used_q * net_c / quantity * 10000) AS bigint) END AS used_fine,
   cast(round(used_q * net_c / quantity) AS bigint) AS used_c,
   coalesce(finished AND status = 'Consumed' AND expiry - finished_on BETWEEN 0 AND 2, false) AS rescued,
   regexp_replace(lower(trim(name)), '\\s+', ' ', 'g') AS product FROM u)
"""
TITLE = "array_to_string(list_transform(regexp_extract_all(trim(name), '\\p{L}+|\\P{L}+'), lambda w: upper(w[1:1]) || lower(w[2:])), '')"


def _staples(days: int) -> str:
    return f"""WITH g AS (SELECT household_id, lower(trim(name)) AS product, max({TITLE}) AS name, count(DISTINCT date_purchased) AS d,
 count(DISTINCT date_trunc('week', date_purchased)) AS w, {big('sum(quantity)')} AS units, {big('sum(unit_c * quantity)')} AS spend
 FROM items WHERE date_purchased >= {T} - {days} GROUP BY ALL HAVING count(DISTINCT date_purchased) >= 3 AND count(DISTINCT date_trunc('week', date_purchased)) >= 2)
"""


QUERIES = [
    Query("stock_items", lambda L: S.stock_items(L, TODAY).withColumnRenamed("group", "grp"), STOCK + """
SELECT household_id, id, receipt_id, name, brand, quantity, quantity_left, value_c / 100 AS value_left, store_name AS store,
 date_purchased AS purchase_date, owner, coalesce(label, category) AS category, spend_category, grp, storage_condition, location,
 date_expiry, expiry AS effective_expiry, days_left, urgency, stale, opened_on, rating, would_rebuy, status FROM v"""),
    Query("stock_summary", lambda L: S.stock_summary(L, TODAY), STOCK + f"""
SELECT household_id, count(*) AS items, {big('sum(value_c)')} / 100 AS value, count(*) FILTER (grp = 'fridge') AS fridge,
 count(*) FILTER (grp = 'freezer') AS freezer, count(*) FILTER (grp = 'pantry') AS pantry, count(*) FILTER (grp = 'home') AS home,
 count(opened_on) AS opened, count(*) FILTER (urgency IN ('expired', 'soon') AND NOT stale) AS use_soon,
 {big("coalesce(sum(value_c) FILTER (urgency IN ('expired', 'soon') AND NOT stale), 0)")} / 100 AS value_at_risk,
 count(*) FILTER (stale) AS stale FROM v GROUP BY ALL"""),
    Query("use_first", lambda L: S.use_first(L, TODAY, 5).withColumnRenamed("group", "grp"), STOCK + """
SELECT household_id, id, name, quantity_left, grp, opened_on IS NOT NULL AS opened,
 CASE WHEN days_left < 0 THEN 'expired' WHEN days_left = 0 THEN 'today' ELSE 'in ' || days_left || ' days' END AS goes_off
FROM v WHERE grp <> 'home' AND urgency IN ('expired', 'soon', 'week')
QUALIFY row_number() OVER (PARTITION BY household_id ORDER BY days_left, lower(name), id) <= 5"""),
    Query("waste_score", lambda L: S.waste_score(L, TODAY, DAYS), MOVES + f""",
g AS (SELECT household_id, {big('coalesce(sum(wasted_c), 0)')} AS w, count(*) FILTER (wasted) AS n, {big('coalesce(sum(used_fine), 0)')} AS uf,
 max(wasted_on) AS last FROM mv GROUP BY ALL),
h AS (SELECT *, CASE WHEN w * 10000 + uf > 0 THEN {big(sql_half_up('w * 10000000', 'w * 10000 + uf'))} END AS tenths FROM g)
SELECT household_id, {big(sql_half_even('1000 - tenths', '10'))} AS score, tenths / 10 AS waste_rate_pct, w / 100 AS wasted_value,
 n AS wasted_items, {sql_half_up('uf', '10000')} / 100 AS used_value, cast({T} - last AS int) AS days_since_last_waste FROM h"""),
    Query("waste_by_reason", lambda L: S.waste_by_reason(L, TODAY, DAYS), MOVES +
          f"SELECT household_id, coalesce(waste_reason, 'other') AS reason, {big('sum(wasted_c)')} / 100 AS value FROM mv WHERE wasted GROUP BY ALL"),
    Query("waste_by_group", lambda L: S.waste_by_group(L, TODAY, DAYS).withColumnRenamed("group", "grp"), MOVES +
          f"SELECT household_id, grp, {big('sum(wasted_c)')} / 100 AS value FROM mv WHERE wasted GROUP BY ALL"),
    Query("waste_by_product", lambda L: S.waste_by_product(L, TODAY, DAYS), MOVES + f""",
n AS (SELECT household_id, product, arg_min(name, id) AS name, count(*) AS times, {big('sum(wasted_c)')} AS c FROM mv WHERE wasted GROUP BY ALL)
SELECT household_id, name, times, c / 100 AS value FROM n QUALIFY row_number() OVER (PARTITION BY household_id ORDER BY c DESC, product) <= 5"""),
    Query("repeat_waste", lambda L: S.repeat_waste(L, TODAY, DAYS), MOVES +
          "SELECT household_id, arg_min(name, id) AS name, count(*) AS times FROM mv WHERE wasted GROUP BY household_id, product HAVING count(*) >= 2"),
    Query("rescued", lambda L: S.rescued(L, TODAY, DAYS), MOVES +
          f"SELECT household_id, count(*) AS items, {big('sum(used_c)')} / 100 AS value FROM mv WHERE rescued GROUP BY ALL"),
    Query("stock_duplicates", lambda L: S.stock_duplicates(L, TODAY), STOCK + """,
p AS (SELECT household_id, product, location, count(*) AS n FROM v GROUP BY ALL),
q AS (SELECT household_id, product, string_agg(location || ' x' || n, ', ' ORDER BY location || ' x' || n) AS locations FROM p GROUP BY ALL)
SELECT household_id, first(name ORDER BY coalesce(days_left, 2147483647), id) AS name, count(*) AS count, any_value(locations) AS locations,
 round(sum(quantity_left), 2) AS total_left FROM v JOIN q USING (household_id, product) GROUP BY household_id, product HAVING count(*) > 1"""),
    Query("product_opinions", lambda L: S.product_opinions(L, 3), STOCK + """,
o AS (SELECT *, regexp_replace(lower(trim(name)), '\\s+', ' ', 'g') AS product, coalesce(rating >= 4, false) OR coalesce(would_rebuy, false) AS good,
  coalesce(rating <= 2, false) OR coalesce(NOT would_rebuy, false) AS bad FROM st),
g AS (SELECT household_id, product, arg_max(name, id) FILTER (good) AS liked, max(coalesce(rating, 0)) FILTER (good) AS stars,
  arg_max(name, id) FILTER (bad) AS avoid, first(rating ORDER BY id DESC) FILTER (bad) AS bad_stars FROM o GROUP BY ALL)
SELECT household_id, opinion, name, rating FROM (
 SELECT household_id, 'liked' AS opinion, liked AS name, stars AS rating, row_number() OVER (PARTITION BY household_id ORDER BY stars DESC, product) AS rn FROM g WHERE liked IS NOT NULL
 UNION ALL SELECT household_id, 'avoid', avoid, bad_stars, row_number() OVER (PARTITION BY household_id ORDER BY product) FROM g WHERE liked IS NULL AND avoid IS NOT NULL) x
WHERE rn <= 3"""),
    Query("clear_stale", lambda L: S.clear_stale(L, TODAY).select(
        "household_id", "id", "status", "quantity_left", "waste_reason", "finished_on"), STOCK + f"""
SELECT i.household_id, i.id, CASE WHEN v.id IS NULL THEN i.status WHEN i.wasted_quantity > 0 THEN 'Discarded' ELSE 'Consumed' END AS status,
 CASE WHEN v.id IS NULL THEN i.quantity_left ELSE 0 END AS quantity_left, CASE WHEN v.id IS NULL THEN i.waste_reason ELSE 'cleared' END AS waste_reason,
 CASE WHEN v.id IS NULL THEN i.finished_on ELSE {T} END AS finished_on FROM items i LEFT JOIN (SELECT id FROM v WHERE stale) v ON v.id = i.id"""),
    Query("rolling_staples", lambda L: P.rolling_staples(L, TODAY, 200), _staples(200) + f"""
SELECT household_id, name, cast(d AS int) AS purchase_frequency_days, cast(w AS int) AS distribution_weeks, units AS total_units_purchased,
 {sql_half_up('spend', 'units')} / 100 AS average_unit_cost_basis FROM g"""),
    Query("pantry_deficits", lambda L: P.pantry_deficits(L, TODAY, 200), _staples(200) + f""",
l AS (SELECT household_id, lower(trim(name)) AS product, status, date_expiry, date_purchased FROM items
 QUALIFY row_number() OVER (PARTITION BY household_id, lower(trim(name)) ORDER BY date_purchased DESC, id DESC) = 1),
j AS (SELECT l.*, g.name, status IN ('Consumed', 'Spoiled', 'Discarded') AS gone FROM l JOIN g USING (household_id, product))
SELECT household_id, name, CASE WHEN gone THEN 'MANUAL_STATUS_EXHAUSTION' ELSE 'TEMPORAL_SHELF_LIFE_EXPIRED' END AS deficit_trigger,
 status AS last_action_state, date_purchased AS last_purchased_date, CASE WHEN NOT gone THEN date_expiry END AS expiry_date_passed,
 CASE WHEN gone THEN 'CRITICAL' ELSE 'MEDIUM' END AS urgency FROM j WHERE gone OR coalesce(date_expiry < {T}, false)"""),
    Query("waste_leakage", lambda L: P.waste_leakage(L, TODAY, 200), f"""
WITH f AS (SELECT household_id, category, cast(round(unit_c * CASE WHEN wasted_quantity = 0 THEN quantity ELSE wasted_quantity END * 100) AS bigint) AS fine FROM items
 WHERE date_purchased >= {T} - 200 AND (status IN ('Spoiled', 'Discarded') OR wasted_quantity > 0)),
g AS (SELECT household_id, category, {big('sum(fine)')} AS fine FROM f GROUP BY ALL UNION ALL SELECT household_id, '(all)', {big('sum(fine)')} FROM f GROUP BY ALL)
SELECT household_id, category, {sql_half_up('fine', '100')} / 100 AS loss FROM g"""),
    Query("price_inflation", lambda L: P.price_inflation(L), f"""
WITH g AS (SELECT household_id, lower(trim(name)) AS product, max({TITLE}) AS item_name, count(*) AS n, first(unit_c ORDER BY date_purchased, id) AS a,
 first(unit_c ORDER BY date_purchased DESC, id DESC) AS b, min(date_purchased) AS d1, max(date_purchased) AS d2 FROM items GROUP BY household_id, lower(trim(name)))
SELECT household_id, item_name, a / 100 AS historical_base_price, b / 100 AS latest_market_price, {sql_pct('b - a', 'a', 1)} AS percentage_inflation_drift,
 d1 AS first_tracked_date, d2 AS latest_tracked_date FROM g WHERE n >= 2 AND a > 0 AND b > a AND (b - a) * 100 >= 5 * a"""),
    Query("regular_essentials", lambda L: P.regular_essentials(L, TODAY, 400), f"""
WITH g AS (SELECT household_id, lower(trim(name)) AS product, max({TITLE}) AS name, count(DISTINCT date_purchased) AS n,
 cast(max(date_purchased) - min(date_purchased) AS bigint) AS span, first(category ORDER BY date_purchased, id) AS category,
 first(storage_condition ORDER BY date_purchased, id) AS storage_condition, first(brand ORDER BY date_purchased, id) AS brand
 FROM items WHERE date_purchased >= {T} - 400 GROUP BY household_id, lower(trim(name)))
SELECT household_id, name, category, storage_condition, brand, n AS total_purchases_tracked, {sql_half_up('span * 10', 'n - 1')} / 10 AS average_restock_interval_days,
 CASE WHEN span <= (n - 1) * 8 THEN 'Weekly Staple' WHEN span <= (n - 1) * 16 THEN 'Bi-Weekly Refill' ELSE 'Monthly Cyclical' END AS consumption_pacing_profile,
 span AS historical_span_days FROM g WHERE n >= 3 AND span >= 30"""),
    Query("product_names", lambda L: L.items.select("household_id", "id", P.E.product_key("name").alias("product_key"),
          P.E.product_title("name").alias("title"), P.E.slugify(F.concat("name", F.lit(" "), "brand")).alias("slug")), f"""
SELECT household_id, id, regexp_replace(lower(trim(name)), '\\s+', ' ', 'g') AS product_key, {TITLE} AS title,
 regexp_replace(regexp_replace(lower(name || ' ' || brand), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM items"""),
    Query("item_values", lambda L: L.items.select("household_id", "id", (P.E.line_total() / 100.0).alias("line_total"),
          P.E.net_unit_price().alias("net_unit_price"), (P.E.value_of("quantity_left") / 100.0).alias("value_left")), """
SELECT household_id, id, (quantity * unit_c - discount_c) / 100 AS line_total, greatest(0, quantity * unit_c - discount_c) / quantity / 100 AS net_unit_price,
 cast(round(quantity_left * greatest(0, quantity * unit_c - discount_c) / quantity) AS bigint) / 100 AS value_left FROM items"""),
]
