from book import D, one, rows
from hearth.operators import metrics, spending, trends
from hearth.operators.entries import spend_entries


def test_a_month_of_receipts_only(book):
    book.receipt(D(2026, 4, 10), dict(unit_c=6000), dict(unit_c=3000, spend_category="pets"), dict(unit_c=1900, spend_category="gone"))
    L = book.ledger()
    total = one(spending.month_totals(L, 2026, 4))
    assert (total["total"], total["bank_only_total"], total["uncategorized_entries"]) == (109.0, 0.0, 1)
    assert one(spending.statement_presence(L, 2026, 4))["awaiting_statement"]
    assert spending.unmatched_receipts(L, 2026, 4).count() == 0
    assert {r["key"]: r["share_pct"] for r in spending.month_categories(L, 2026, 4).collect()} == {"groceries": 55.0, "pets": 27.5, "uncategorized": 17.4}


def test_linked_booking_and_explained_payment_count_once(book):
    rid = book.receipt(D(2026, 4, 10), dict(unit_c=5000), linked=True)
    st, pp = book.statement((2026, 4)), book.statement((2026, 4), bank="PayPal")
    book.add("bookings", statement_id=st, booking_date=D(2026, 4, 12), amount_c=-5000, receipt_id=rid)
    bank = book.add("bookings", statement_id=st, booking_date=D(2026, 4, 13), amount_c=-1000, category="pets")
    book.add("bookings", statement_id=pp, booking_date=D(2026, 4, 13), amount_c=-1000, mirror_of=bank)
    entries = spend_entries(book.ledger())
    assert rows(entries, "source", "amount_c", "key") == [("bank", 1000, "pets"), ("receipt", 5000, "groceries")]


def test_purchase_day_decides_the_month_and_fee_has_a_category(book):
    st = book.statement((2026, 5))
    book.add("bookings", statement_id=st, booking_date=D(2026, 5, 2), purchase_date=D(2026, 4, 30), amount_c=-1200, category="pets")
    book.add("bookings", statement_id=st, booking_date=D(2026, 5, 3), amount_c=-300, kind="fee")
    L = book.ledger()
    assert rows(spending.month_categories(L, 2026, 4), "key", "amount") == [("pets", 12.0)]
    assert rows(spending.month_categories(L, 2026, 5), "key", "amount", "previous_amount") == [("bank_fees", 3.0, 0.0)]


def test_gaps_are_reported_when_a_statement_exists(book):
    st = book.statement((2026, 4))
    book.receipt(D(2026, 4, 3), dict(unit_c=700), store_name="Kaufland")
    book.add("bookings", statement_id=st, booking_date=D(2026, 4, 9), amount_c=-900, counterparty="KAUFLAND Baden-Baden")
    book.add("bookings", statement_id=st, booking_date=D(2026, 4, 9), amount_c=-900, counterparty="Netflix")
    L = book.ledger()
    assert rows(spending.unmatched_receipts(L, 2026, 4), "store") == [("Kaufland",)]
    assert rows(spending.missing_receipts(L, 2026, 4), "counterparty") == [("KAUFLAND Baden-Baden",)]


def test_month_metrics_ignore_transfers(book):
    st, other = book.statement((2026, 4)), book.statement((2026, 4), bank="N26")
    for amount, kind, category in [
        (300000, "income", "salary"), (-40000, "spend", "groceries"), (-4000, "spend", "fitness"), (-1000, "fee", None),
        (10000, "refund", None), (-30000, "internal_transfer", None), (-12000, "investment", None), (-5000, "cash", None),
    ]:
        book.add("bookings", statement_id=st, booking_date=D(2026, 4, 5), amount_c=amount, kind=kind, category=category)
    book.add("bookings", statement_id=other, booking_date=D(2026, 4, 5), amount_c=30000, kind="internal_transfer")
    L = book.ledger()
    m = one(metrics.month_metrics(L))
    assert (m["gross_income"], m["lifestyle_expenses"], m["total_invested"]) == (3100.0, 500.0, 120.0)
    assert m["fixed_vs_variable_ratio"] == "10% Fixed / 90% Variable"
    keys = {r["key"]: r["percentage_of_total"] for r in metrics.month_category_metrics(L).collect()}
    assert keys["salary"] == 96.77 and keys["refunds_returns"] == 3.23 and keys["investments"] == 100.0
    # both lenses agree
    assert m["lifestyle_expenses"] == one(spending.month_totals(L, 2026, 4))["total"]
    assert one(metrics.month_sources(L))["statements"] == "N26,Sparkasse"


def test_period_ratios_are_recomputed(book):
    for month, income, spent in [(1, 1000, 100), (2, 3000, 2900)]:
        st = book.statement((2026, month))
        book.add("bookings", statement_id=st, booking_date=D(2026, month, 5), amount_c=income * 100, kind="income", category="salary")
        book.add("bookings", statement_id=st, booking_date=D(2026, month, 6), amount_c=-spent * 100, category="rent")
    p = one(metrics.period_stats(book.ledger(), (2026, 1), (2026, 2)))
    assert (p["period_months_count"], p["savings_rate_pct"]) == (2, 25.0)
    assert rows(metrics.missing_months(book.ledger(), (2025, 12), (2026, 3)), "label") == [("Dec 25",), ("Mar 26",)]


def test_trends_keep_empty_months_and_never_use_the_running_one(book):
    for month, euro in [(1, 100), (3, 300), (4, 900)]:
        book.receipt(D(2026, month, 5), dict(unit_c=euro * 100))
    L, end, today = book.ledger(), (2026, 4), D(2026, 4, 15)
    months = {r["label"]: (r["total"], r["partial"]) for r in trends.trend_months(L, 4, end, today).collect()}
    assert months == {"Jan 26": (100.0, False), "Feb 26": (0.0, False), "Mar 26": (300.0, False), "Apr 26": (900.0, True)}
    assert one(trends.category_averages(L, 4, end, today))["average"] == 200.0
    up = one(trends.spend_movers(L, 4, end, today))
    assert (up["month"], up["direction"], up["change"], up["change_pct"]) == ("Mar 26", "up", 200.0, 200)


def test_pace_stops_today(book):
    book.receipt(D(2026, 3, 2), dict(unit_c=1000))
    book.receipt(D(2026, 4, 2), dict(unit_c=500))
    book.receipt(D(2026, 4, 20), dict(unit_c=9900))
    L = book.ledger()
    days = {(r["which"], r["day"]): r["running_total"] for r in trends.spend_pace(L, 2026, 4, D(2026, 4, 15)).collect()}
    assert days[("current", 15)] == 5.0 and ("current", 16) not in days and days[("previous", 31)] == 10.0
    s = one(trends.pace_summary(L, 2026, 4, D(2026, 4, 15)))
    assert s["in_progress"] and s["previous_same_day"] == 10.0 and not s["unfair_comparison"]


def test_another_household_changes_nothing(book):
    book.receipt(D(2026, 4, 10), dict(unit_c=6000))
    before = rows(spending.month_categories(book.ledger(), 2026, 4))
    book.receipt(D(2026, 4, 11), dict(unit_c=123), household_id=2)
    assert [r for r in rows(spending.month_categories(book.ledger(), 2026, 4)) if r[0] == 1] == before
