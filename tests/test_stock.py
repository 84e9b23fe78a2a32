import datetime as dt

from book import D, F, one, rows
from hearth import streaming
from hearth.operators import pantry, stock, upkeep

TODAY = D(2026, 5, 1)


def test_groups_and_urgency(book):
    day = D(2026, 4, 28)
    book.receipt(
        day, dict(name="Milk", storage_condition="Kept Cool", date_expiry=D(2026, 5, 3)), dict(name="Peas", storage_condition="Frozen"),
        dict(name="Rice", date_expiry=D(2026, 6, 3)), dict(name="Pills", spend_category="pharmacy", category="Medicine"),
        dict(name="Old cola", spend_category=None, category="Drinks", date_expiry=D(2026, 4, 1)), dict(name="Lunch", spend_category="eating_out"),
    )
    L = book.ledger()
    view = {r["name"]: (r["group"], r["urgency"], r["stale"]) for r in stock.stock_items(L, TODAY).collect()}
    assert view == {
        "Milk": ("fridge", "soon", False), "Peas": ("freezer", "none", False), "Rice": ("pantry", "ok", False),
        "Pills": ("home", "none", False), "Old cola": ("pantry", "expired", True),
    }
    s = one(stock.stock_summary(L, TODAY))
    assert (s["items"], s["use_soon"], s["stale"], s["pantry"]) == (5, 1, 1, 2)
    assert [r["goes_off"] for r in stock.use_first(L, TODAY).collect()] == ["expired", "in 2 days"]
    cleared = stock.clear_stale(L, TODAY).filter("name = 'Old cola'")
    assert one(cleared.select("status", "quantity_left", "waste_reason")) == {"status": "Consumed", "quantity_left": 0.0, "waste_reason": "cleared"}


def test_opening_shortens_life_but_never_for_things(book):
    book.receipt(D(2026, 4, 20), dict(name="Jam", opened_on=D(2026, 4, 25), date_expiry=D(2026, 9, 1)),
                 dict(name="Soap", spend_category="personal_care", opened_on=D(2026, 4, 25)))
    found = {r["name"]: r["effective_expiry"] for r in stock.stock_items(book.ledger(), TODAY).collect()}
    assert found == {"Jam": D(2026, 5, 9), "Soap": None}


def test_waste_score_and_rescue(book):
    book.receipt(
        D(2026, 4, 1), dict(name="Cheese", unit_c=1000, quantity_left=0.0, status="Consumed", finished_on=D(2026, 4, 20), date_expiry=D(2026, 4, 21)),
        dict(name="Ham", unit_c=500, quantity_left=0.0, status="Spoiled", wasted_quantity=1.0, wasted_on=D(2026, 4, 20), finished_on=D(2026, 4, 20), waste_reason="expired"),
    )
    L = book.ledger()
    s = one(stock.waste_score(L, TODAY))
    assert (s["score"], s["waste_rate_pct"], s["days_since_last_waste"]) == (67, 33.3, 11)
    assert one(stock.rescued(L, TODAY))["value"] == 10.0
    assert rows(stock.waste_by_reason(L, TODAY), "reason", "value") == [("expired", 5.0)]


def test_opinions_liked_wins(book):
    book.receipt(D(2026, 4, 1), dict(name="Tea", rating=5), dict(name="tea", rating=1), dict(name="Soup", would_rebuy=False))
    assert rows(stock.product_opinions(book.ledger()), "opinion", "name") == [("avoid", "Soup"), ("liked", "Tea")]


def test_staples_deficits_inflation_essentials(book):
    for day, cents in [(D(2026, 2, 20), 100), (D(2026, 3, 10), 110), (D(2026, 4, 1), 120)]:
        book.receipt(day, dict(name="rye bread ", unit_c=cents, status="Consumed", quantity_left=0.0))
    L = book.ledger()
    assert rows(pantry.rolling_staples(L, TODAY), "name", "purchase_frequency_days", "average_unit_cost_basis") == [("Rye Bread", 3, 1.1)]
    assert one(pantry.pantry_deficits(L, TODAY))["urgency"] == "CRITICAL"
    assert one(pantry.price_inflation(L))["percentage_inflation_drift"] == 20.0
    e = one(pantry.regular_essentials(L, TODAY))
    assert (e["consumption_pacing_profile"], e["average_restock_interval_days"]) == ("Monthly Cyclical", 20.0)


EVENT = ("household_id bigint, item_id bigint, event_id bigint, ts timestamp, day date, action string, amount double, reason string, "
         "location string, date_expiry date, rating int, would_rebuy boolean")


def events(spark, *steps):
    found = []
    for n, (item, action, more) in enumerate(steps):
        found.append((1, item, n, dt.datetime(2026, 5, 1, 8, n), TODAY, action, more.get("amount"), more.get("reason"),
                      more.get("location"), None, more.get("rating"), None))
    return spark.createDataFrame(found, EVENT)


STEPS = (
    (1, "use", dict(amount=1.0)), (1, "discard", dict(reason="spoiled", amount=5.0)), (1, "use", {}), (1, "update", dict(rating=4)),
    (2, "freeze", {}), (2, "freeze", {}), (3, "freeze", {}), (4, "use", {}), (2, "update", dict(rating=9)),
)


def test_stock_events_in_order(book, spark):
    book.receipt(D(2026, 4, 30), dict(name="Milk", quantity=3), dict(name="Bread", date_expiry=D(2026, 5, 2)), dict(name="Soap", spend_category="personal_care"))
    items, refused = upkeep.apply_stock_events(book.ledger(), events(spark, *STEPS))
    milk = one(items.filter("name = 'Milk'"))
    assert (milk["status"], milk["wasted_quantity"], milk["quantity_left"], milk["rating"]) == ("Spoiled", 2.0, 0.0, 4)
    bread = one(items.filter("name = 'Bread'"))
    assert (bread["storage_condition"], bread["date_expiry"]) == ("Frozen", TODAY + dt.timedelta(days=90))
    assert rows(refused, "event_id", "problem") == [
        (2, "nothing_left"), (5, "already_frozen"), (6, "only_food_can_be_frozen"), (7, "no_such_item"), (8, "rating_out_of_range"),
    ]
    assert items.count() == 3


def test_streamed_stock_keeps_state_between_batches(book, spark, tmp_path):
    book.receipt(D(2026, 4, 30), dict(name="Milk", quantity=3), dict(name="Bread"), dict(name="Soap", spend_category="personal_care"))
    L, inbox, out = book.ledger(), str(tmp_path / "in"), str(tmp_path / "out")
    for part in (STEPS[:2], STEPS[:2] + STEPS[2:]):
        done = 0 if part == STEPS[:2] else 2
        events(spark, *part).filter(F.col("event_id") >= done).coalesce(1).write.mode("append").parquet(inbox)
        moves = streaming.stream_stock(L, spark.readStream.schema(EVENT).parquet(inbox))
        q = moves.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    found = spark.read.parquet(out)
    assert found.count() == len(STEPS)
    assert rows(found.filter("problem is not null"), "event_id", "problem") == [
        (2, "nothing_left"), (5, "already_frozen"), (6, "only_food_can_be_frozen"), (7, "no_such_item"), (8, "rating_out_of_range"),
    ]
