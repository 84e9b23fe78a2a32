import datetime as dt
import json

import pytest
from book import D, F, one, rows
from hearth import plans, streaming
from hearth.functions import exprs as E
from hearth.operators import finders, links, loads, matching, quality, savings_plans, upkeep
from hearth.sources import ledger as sources
from hearth.operators.reconcile import reconcile
from hearth.sources import ledger as ledger_source, store
from hearth.sources.store import load_ledger, save_ledger

TODAY = D(2026, 5, 20)


# ---- matching and links --------------------------------------------------------------------------------
def transfer_book(book):
    a, b = book.statement((2026, 4)), book.statement((2026, 4), bank="N26")
    for st, day, amount in [(a, 1, -50000), (b, 3, 50001), (a, 10, -7000), (a, 11, -7000), (b, 12, 7000), (a, 20, -900), (a, 20, 900)]:
        book.add("bookings", statement_id=st, booking_date=D(2026, 4, day), amount_c=amount, kind="internal_transfer")
    return book.ledger()


def test_only_the_one_possible_partner_is_paired(book):
    L = transfer_book(book)
    pairs = matching.pair_transfers(L)
    assert rows(pairs, "out_id", "in_id") == [(1, 2)]
    after = links.apply_transfer_pairs(L, pairs)
    assert rows(after.bookings.filter("transfer_group = 1"), "id", "link_status") == [(1, "auto"), (2, "auto")]


def test_a_no_is_final(book):
    book.add("questions", kind="transfer_match", transaction_id=1, other_transaction_id=2, status="no")
    assert matching.pair_transfers(transfer_book(book)).count() == 0


def test_mirror_by_number_then_by_name(book):
    bank, pp = book.statement((2026, 4)), book.statement((2026, 4), bank="PayPal")
    book.add("bookings", statement_id=bank, booking_date=D(2026, 4, 4), amount_c=-1999, counterparty="PayPal Europe", description="PP 5550001234567 purchase")
    book.add("bookings", statement_id=pp, booking_date=D(2026, 4, 1), amount_c=-1999, counterparty="Bookshop", payment_reference="5550001234567", category="books_media")
    book.add("bookings", statement_id=bank, booking_date=D(2026, 4, 10), amount_c=-500, counterparty="PayPal", description="Ihr Einkauf bei Spotify AB")
    book.add("bookings", statement_id=pp, booking_date=D(2026, 4, 9), amount_c=-500, counterparty="Spotify", category="subscriptions")
    for day in (20, 21):  # two possible bookings: left alone
        book.add("bookings", statement_id=bank, booking_date=D(2026, 4, day), amount_c=-800, counterparty="PayPal", description="Steam")
    book.add("bookings", statement_id=pp, booking_date=D(2026, 4, 20), amount_c=-800, counterparty="Steam")
    L = book.ledger()
    pairs = matching.mirror_payments(L)
    assert rows(pairs, "paypal_id", "bank_id") == [(2, 1), (4, 3)]
    after = links.apply_mirrors(L, pairs).bookings
    assert one(after.filter("id = 1").select("category", "counterparty")) == {"category": "books_media", "counterparty": "Bookshop"}


def receipt_book(book):
    st = book.statement((2026, 4))
    book.receipt(D(2026, 4, 3), dict(unit_c=1000), store_name="Kaufland")
    book.receipt(D(2026, 4, 5), dict(unit_c=2000), store_name="Aldi")
    book.receipt(D(2026, 4, 6), dict(unit_c=2000), store_name="Aldi")
    book.add("bookings", statement_id=st, booking_date=D(2026, 4, 5), amount_c=-1000, counterparty="KAUFLAND GmbH")
    book.add("bookings", statement_id=st, booking_date=D(2026, 4, 8), amount_c=-2000, counterparty="Aldi")
    book.add("bookings", statement_id=st, booking_date=D(2026, 4, 9), amount_c=-1000, counterparty="Elsewhere")
    return book.ledger()


def test_receipts_certain_likely_and_questions(book):
    L = receipt_book(book)
    pairs = matching.match_receipts(L)
    assert rows(pairs, "transaction_id", "receipt_id", "confidence") == [(1, 1, "certain"), (2, 3, "likely")]
    asked = links.questions_from(pairs.filter("confidence = 'likely'"), L, "receipt_match")
    assert "20.00 EUR payment to Aldi booked on 2026-04-08 the Aldi receipt from 2026-04-06" in one(asked)["question"]
    after = links.apply_receipt_links(L, pairs.filter("confidence = 'certain'"))
    assert rows(after.receipts.filter("linked"), "id") == [(1,)]


def test_a_refused_receipt_leaves_the_next_one(book):
    st = book.statement((2026, 4))
    for day in (5, 7):
        book.receipt(D(2026, 4, day), dict(unit_c=2000), store_name="Aldi")
    book.receipt(D(2026, 4, 10), dict(unit_c=3000), store_name="Bakery", payment_reference="BC9-1")
    book.receipt(D(2026, 4, 9), dict(unit_c=3000), store_name="Bakery")
    book.add("bookings", statement_id=st, booking_date=D(2026, 4, 8), amount_c=-2000, counterparty="Aldi")
    book.add("bookings", statement_id=st, booking_date=D(2026, 4, 8), amount_c=-2000, counterparty="Aldi")
    book.add("bookings", statement_id=st, booking_date=D(2026, 4, 10), amount_c=-3000, counterparty="Bakery", payment_reference="BC9")
    book.add("questions", kind="receipt_match", transaction_id=1, receipt_id=2, status="no")
    book.add("questions", kind="receipt_match", transaction_id=3, receipt_id=3, status="no")
    found = matching.match_receipts(book.ledger())
    assert rows(found, "transaction_id", "receipt_id", "confidence") == [(1, 1, "likely"), (2, 2, "likely"), (3, 4, "certain")]


def test_equal_references_are_assigned_one_to_one(book):
    st = book.statement((2026, 4))
    for ref in ("R7-a", "R7-b", "R7", "S1", "S1"):
        book.receipt(D(2026, 4, 3), dict(unit_c=1000), store_name=f"Shop {ref}", payment_reference=ref)
    for ref in ("R7", "R7", "R7-b", "S1", "S1", "S1"):
        book.add("bookings", statement_id=st, booking_date=D(2026, 4, 5), amount_c=-1000, counterparty="Card", payment_reference=ref)
    book.add("questions", kind="receipt_match", transaction_id=4, receipt_id=4, status="no")
    found = matching.match_receipts(book.ledger())
    assert rows(found, "transaction_id", "receipt_id", "confidence") == [(1, 1, "certain"), (2, 3, "certain"), (3, 2, "certain"), (4, 5, "certain"), (5, 4, "certain")]


def test_answers_first_come_inside_a_batch(book, spark):
    L = receipt_book(book)
    for rid in (2, 3):
        book.add("questions", kind="receipt_match", transaction_id=2, receipt_id=rid)
    book.add("questions", kind="receipt_match", transaction_id=1, receipt_id=1, status="no")
    L = book.ledger()
    said = spark.createDataFrame(
        [(1, 1, True, dt.datetime(2026, 5, 1, 9)), (1, 2, True, dt.datetime(2026, 5, 1, 8)), (1, 3, True, dt.datetime(2026, 5, 1, 7)), (1, 99, True, dt.datetime(2026, 5, 1, 7))],
        "household_id bigint, question_id bigint, yes boolean, ts timestamp")
    after, problems = links.apply_answers(L, said)
    assert rows(after.bookings.filter("receipt_id is not null"), "id", "receipt_id", "link_status") == [(2, 3, "confirmed")]
    assert rows(problems, "question_id", "problem") == [(1, "already_linked"), (3, "already_answered"), (99, "no_question")]


def test_chain_breaks_need_neighbours(book):
    for month, start, end in [(1, 0, 100), (2, 105, 200), (4, 900, 950)]:
        book.statement((2026, month), opening_c=start, closing_c=end)
    assert rows(matching.balance_chain_breaks(book.ledger()), "previous_id", "id") == [(1, 2)]


# ---- loading -------------------------------------------------------------------------------------------
def receipt_doc(**more):
    doc = dict(household_id=1, doc_hash="h1", owner="Ann", store_name="Corner Shop", purchase_date="2026-05-10", total_amount=17.35, items=[
        dict(name="Milk", quantity=4, unit_price=1.15, discount=0, spend_category="groceries", storage_condition="Kept Cool", estimated_shelf_life_days=5),
        dict(name="Cheese", quantity=1, unit_price=6.50, discount=0.85, spend_category="groceries", storage_condition="Kept Cool"),
        dict(name="Roll", quantity=5, unit_price=0.42, discount=0, spend_category="groceries", storage_condition="Normal"),
        dict(name="Deposit", quantity=8, unit_price=0.25, discount=0, spend_category="deposit", storage_condition="Normal"),
        dict(name="Juice", quantity=1, unit_price=3.00, discount=0, spend_category="beverages", storage_condition="Normal"),
    ])
    doc.update(more)
    return doc


def written(tmp_path, name, docs, bad=()):
    folder = tmp_path / name
    folder.mkdir(exist_ok=True)
    (folder / f"{len(list(folder.iterdir()))}.json").write_text("\n".join([*(json.dumps(d) for d in docs), *bad]))
    return str(folder)


def test_receipts_are_checked_routed_and_not_stored_twice(book, spark, tmp_path):
    docs = [receipt_doc(), receipt_doc(doc_hash="h2"), receipt_doc(doc_hash="h3", total_amount=99.0), receipt_doc(doc_hash="h4", total_amount=98.0, review_note="cropped"),
            receipt_doc(doc_hash="h5", receipt_number="77"), receipt_doc(doc_hash="h6", purchase_date="2020-01-01", total_amount=-1.0)]
    heads, lines, bad = sources.read_submissions(spark, written(tmp_path, "r", docs, ["{broken"]), "receipt")
    assert bad.count() == 1
    L = book.ledger()
    checked = {r["doc_hash"]: r["problems"] for r in quality.check_receipts(heads, lines, L, TODAY).collect()}
    assert checked["h1"] == [] and checked["h3"] == ["sum_mismatch"] and checked["h6"] == ["too_old", "total_not_positive", "sum_mismatch"]
    after, outcome = loads.load_receipts(heads, lines, L, TODAY)
    by_hash = {r["doc_hash"]: r["outcome"] for r in outcome.join(heads, ["household_id", "doc_id"]).collect()}
    assert sorted([by_hash["h1"], by_hash["h2"]]) == ["duplicate", "ok"]  # same shop, day and total
    assert (by_hash["h3"], by_hash["h4"], by_hash["h5"], by_hash["h6"]) == ("rejected", "needs_review", "ok", "rejected")
    assert after.items.count() == 15 and after.receipts.count() == 3
    again, outcome = loads.load_receipts(heads, lines, after, TODAY)
    assert again.receipts.count() == 3 and outcome.filter("outcome = 'duplicate'").count() == 4


def statement_doc(**more):
    row = lambda day, amount, **m: dict(booking_date=f"2026-04-{day:02d}", amount=amount, counterparty="Shop", description="x", kind="spend", category="groceries", **m)
    doc = dict(household_id=1, doc_hash="s1", owner="Ann", bank="Sparkasse", period_start="2026-04-01", period_end="2026-04-30", opening_balance=640.0,
               closing_balance=511.5, transactions=[row(2, -31.4), row(3, -82.0), row(4, -15.1)])
    doc.update(more)
    return doc


def test_statement_reimport_keeps_links_and_partial_never_overwrites(book, spark, tmp_path):
    load = lambda L, name, doc: loads.load_statements(*sources.read_submissions(spark, written(tmp_path, name, [doc]), "statement")[:2], L)
    book.receipt(D(2026, 4, 2), dict(unit_c=3140))
    first, outcome = load(book.ledger(), "a", statement_doc())
    assert one(outcome)["outcome"] == "ok" and one(first.statements)["month_index"] == 2026 * 12 + 3
    tx = one(first.bookings.filter("amount_c = -3140"))["id"]
    linked = links.apply_receipt_links(first, spark.createDataFrame([(1, tx, 1, "r")], "household_id bigint, transaction_id bigint, receipt_id bigint, reason string"))
    second, outcome = load(linked, "b", statement_doc(doc_hash="s2"))
    kept = one(second.bookings.filter("amount_c = -3140"))
    assert kept["receipt_id"] == 1 and kept["id"] != tx and second.bookings.count() == 3 and second.statements.count() == 1
    assert one(second.receipts)["linked"]
    dropped = statement_doc(doc_hash="s3", closing_balance=542.9, transactions=statement_doc()["transactions"][1:])
    third, _ = load(second, "c", dropped)
    assert third.bookings.count() == 2 and not one(third.receipts)["linked"]
    _, outcome = load(third, "d", statement_doc(doc_hash="s4", opening_balance=None, closing_balance=None))
    assert one(outcome)["outcome"] == "kept_complete"
    _, outcome = load(third, "e", statement_doc(doc_hash="s5", closing_balance=400.0))
    assert (one(outcome)["outcome"], one(outcome)["reason"]) == ("rejected", "balance_mismatch")


def test_the_same_document_twice_is_stored_once(book, spark, tmp_path):
    L = book.ledger()
    heads, lines, _ = sources.read_submissions(spark, written(tmp_path, "r2", [receipt_doc(), receipt_doc()]), "receipt")
    after, outcome = loads.load_receipts(heads, lines, L, TODAY)
    assert rows(outcome, "outcome") == [("duplicate",), ("ok",)] and (after.receipts.count(), after.items.count()) == (1, 5)
    heads, lines, _ = sources.read_submissions(spark, written(tmp_path, "s2", [statement_doc(), statement_doc()]), "statement")
    after, outcome = loads.load_statements(heads, lines, L)
    assert rows(outcome, "outcome") == [("duplicate",), ("ok",)] and after.bookings.count() == 3
    heads, lines, _ = sources.read_submissions(spark, written(tmp_path, "r3", [receipt_doc(purchase_date=None), receipt_doc(doc_hash="h7", store_name=None)]), "receipt")
    _, outcome = loads.load_receipts(heads, lines, L, TODAY)
    assert rows(outcome, "outcome", "reason") == [("rejected", "no_date"), ("rejected", "no_shop")]


def test_a_reimported_transfer_side_stays_paired(book, spark, tmp_path):
    other = book.statement((2026, 4), bank="N26")
    book.add("bookings", statement_id=other, booking_date=D(2026, 4, 3), amount_c=3140, kind="internal_transfer", transfer_group=77)
    load = lambda L, name, doc: loads.load_statements(*sources.read_submissions(spark, written(tmp_path, name, [doc]), "statement")[:2], L)[0]
    first = load(book.ledger(), "t1", statement_doc())
    first = first.with_(bookings=first.bookings.withColumn("transfer_group", F.when(F.col("amount_c") == -3140, F.lit(77)).otherwise(F.col("transfer_group"))))
    second = load(first, "t2", statement_doc(doc_hash="s9"))
    assert rows(second.bookings.filter("transfer_group = 77"), "amount_c") == [(-3140,), (3140,)]


def test_two_changes_of_one_row_do_not_double_it(book, spark, tmp_path):
    heads, lines, _ = sources.read_submissions(spark, written(tmp_path, "d", [receipt_doc()]), "receipt")
    L, _ = loads.load_receipts(heads, lines, book.ledger(), TODAY)
    item, receipt = L.items.first()["id"], L.receipts.first()["id"]
    changes = spark.createDataFrame([(1, f"i{item}", "groceries", 1), (1, f"i{item}", "beverages", 2), (1, "i99999999999999999999", "groceries", 3)], "household_id bigint, ref string, category string, change_id bigint")
    after, refused = upkeep.apply_category_changes(L, changes)
    assert one(after.items.filter(F.col("id") == item))["spend_category"] == "beverages" and after.items.count() == 5
    assert rows(refused, "problem") == [("changed_again",), ("not_a_reference",)]
    fixes = spark.createDataFrame([(1, receipt, D(2026, 5, 1)), (1, receipt, D(2026, 5, 2))], "household_id bigint, receipt_id bigint, purchase_date date")
    fixed = upkeep.confirm_receipts(L, fixes)
    assert one(fixed.receipts)["purchase_date"] == D(2026, 5, 2) and fixed.items.count() == 5
    mapping = spark.createDataFrame([("groceries", "beverages"), ("groceries", "household")], "source string, target string")
    moved, refused = upkeep.remap_categories(L, mapping)
    assert moved.items.count() == 5 and refused.count() == 1


def test_a_cut_off_batch_leaves_the_old_ledger_and_emptied_buckets_go(book, spark, tmp_path, monkeypatch):
    path = str(tmp_path / "v")
    book.statement((2026, 4))
    book.add("bookings", statement_id=1, booking_date=D(2026, 4, 4), amount_c=-100)
    book.add("questions", kind="receipt_match", transaction_id=1)
    save_ledger(book.ledger(), path, buckets=4)
    L = load_ledger(spark, path)
    touched = store.touched_buckets(L.statements, ("household_id",), 4)
    with monkeypatch.context() as m:
        m.setattr(store, "_publish", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            store.update_ledger(L.with_(bookings=L.bookings.limit(0)), path, ("bookings", "statements"), touched)
    assert load_ledger(spark, path).bookings.count() == 1
    store.update_ledger(L.with_(questions=L.questions.limit(0)), path, ("questions",), touched, ("s", 3))
    after = load_ledger(spark, path)
    assert after.questions.count() == 0 and after.bookings.count() == 1 and store.manifest(spark, path)["batches"] == {"s": 3}
    store.drop_old_versions(spark, path)
    assert load_ledger(spark, path).statements.count() == 1


def test_streamed_statements_are_reconciled(book, spark, tmp_path):
    path, inbox, out, cp = (str(tmp_path / n) for n in ("st", "sin", "sout", "scp"))
    book.receipt(D(2026, 4, 2), dict(unit_c=3140), store_name="Shop")
    save_ledger(book.ledger(), path)
    move = dict(kind="internal_transfer", category=None)
    ours = statement_doc(closing_balance=461.5)
    ours["transactions"].append(ours["transactions"][2] | move | dict(amount=-50.0))
    theirs = statement_doc(doc_hash="n1", bank="N26", opening_balance=0.0, closing_balance=50.0, transactions=[ours["transactions"][3] | dict(amount=50.0)])
    written(tmp_path, "sin", [ours, theirs])
    streaming.stream_ingest(spark, inbox, "statement", path, out, cp, TODAY).awaitTermination()
    after = load_ledger(spark, path)
    assert after.bookings.filter("transfer_group IS NOT NULL").count() == 2
    assert one(after.bookings.filter("receipt_id IS NOT NULL"))["amount_c"] == -3140 and one(after.receipts)["linked"]
    again = reconcile(after)
    assert rows(again.bookings) == rows(after.bookings) and again.questions.count() == after.questions.count()


def test_payment_lists_grow_by_real_repeats(book, spark, tmp_path):
    row = dict(booking_date="2026-04-02", amount=-5.0, counterparty="Steam", description="game", kind="spend", category="hobbies")
    doc = lambda h, n: dict(household_id=1, doc_hash=h, owner="Ann", bank="PayPal", period_start="2026-04-01", period_end="2026-04-30", transactions=[row] * n)
    L = book.ledger()
    for n, (count, stored) in enumerate([(2, 2), (2, 2), (3, 3)]):
        heads, lines, _ = sources.read_submissions(spark, written(tmp_path, f"p{n}", [doc(f"h{n}", count)]), "statement")
        L, outcome = loads.load_statements(heads, lines, L)
        assert L.bookings.count() == stored and L.statements.count() == 1


def test_streamed_ingest_is_restart_safe(book, spark, tmp_path):
    path, inbox, out, cp = (str(tmp_path / n) for n in ("store", "in", "out", "cp"))
    save_ledger(book.ledger(), path)
    written(tmp_path, "in", [receipt_doc()], ["{broken"])
    for extra in ([], [receipt_doc(doc_hash="h9"), receipt_doc(doc_hash="h10", store_name="Aldi")]):
        if extra:
            written(tmp_path, "in", extra)
        streaming.stream_ingest(spark, inbox, "receipt", path, out, cp, TODAY).awaitTermination()
    after = load_ledger(spark, path)
    assert after.receipts.count() == 2 and after.items.count() == 10
    assert rows(spark.read.parquet(out), "outcome") == [("duplicate",), ("ok",), ("ok",), ("unreadable",)]


# ---- upkeep --------------------------------------------------------------------------------------------
def test_confirming_a_date_moves_the_expiry_and_removing_unlinks(book, spark):
    rid = book.receipt(D(2026, 4, 10), dict(date_expiry=D(2026, 4, 20)), status="needs_review", linked=True)
    st = book.statement((2026, 4))
    book.add("bookings", statement_id=st, booking_date=D(2026, 4, 12), amount_c=-100, receipt_id=rid, link_status="auto")
    L = book.ledger()
    fixed = upkeep.confirm_receipts(L, spark.createDataFrame([(1, 1, D(2026, 4, 12))], "household_id bigint, receipt_id bigint, purchase_date date"))
    assert (one(fixed.items)["date_expiry"], one(fixed.receipts)["status"]) == (D(2026, 4, 22), "ok")
    ids = spark.createDataFrame([(1, 1)], "household_id bigint, id bigint")
    gone = upkeep.remove_receipts(L, ids)
    assert gone.items.count() == 0 and one(gone.bookings)["receipt_id"] is None
    gone = upkeep.remove_statements(L, ids)
    assert gone.bookings.count() == 0 and not one(gone.receipts)["linked"]


def test_categories_merge_delete_and_create(book, spark):
    book.receipt(D(2026, 4, 10), dict(spend_category="beverages", category="Drinks"), dict(spend_category="pharmacy"))
    L = book.ledger()
    mapping = spark.createDataFrame([("beverages", "groceries"), ("pharmacy", None), ("salary", "rent"), ("nope", "rent")], "source string, target string")
    after, refused = upkeep.remap_categories(L, mapping)
    assert rows(after.items, "spend_category", "category") == [("groceries", "Food"), (None, "Other")]
    assert rows(refused, "source", "problem") == [("nope", "unknown_category"), ("salary", "different_flow")]
    changes = spark.createDataFrame(
        [(1, None, "Pet Food!", "Shopping", "expense", False), (2, None, "Rent", "Home", "expense", False), (3, "rent", "Housing", None, None, True), (4, "rent", None, None, "income", True)],
        "change_id bigint, key string, label string, group_name string, flow string, update boolean",
    ).withColumn("fixed", F.lit(None).cast("boolean")).withColumn("description", F.lit(None).cast("string")).withColumn("active", F.lit(None).cast("boolean"))
    cats, refused = upkeep.upsert_categories(L.categories, changes)
    assert one(cats.filter("key = 'pet_food'"))["sort_order"] == 480 and one(cats.filter("key = 'rent'"))["label"] == "Housing"
    assert rows(refused, "change_id", "problem") == [(2, "already_exists"), (4, "flow_cannot_change")]


def test_plan_history_is_never_rewritten(book, spark):
    book.add("plans", instrument="World", amount_c=1000, frequency="weekly", start_date=D(2026, 1, 1), anchor_date=D(2026, 1, 5))
    fields = "household_id bigint, change_id bigint, plan_id bigint, action string, on_date date, broker string, instrument string, amount_c bigint, frequency string, anchor_date date, start_date date, end_date date, note string"
    none = [None] * 8
    changes = spark.createDataFrame([
        (1, 1, 1, "change", D(2026, 3, 1), None, None, 2000, "monthly", None, None, None, None),
        (1, 2, 1, "suspend", D(2026, 4, 1), *none), (1, 3, 1, "resume", D(2026, 5, 1), *none), (1, 4, 7, "delete", None, *none),
        (1, 5, None, "create", None, "N26", " Gold ", 500, "monthly", None, None, None, None), (1, 6, None, "create", None, "Bank", "x", 1, "daily", None, None, None, None),
    ], fields)
    after, refused = upkeep.apply_plan_changes(book.ledger(), changes)
    assert rows(after, "instrument", "amount_c", "frequency", "anchor_date", "start_date", "end_date") == [
        ("Gold", 500, "monthly", None, None, None), ("World", 1000, "weekly", D(2026, 1, 5), D(2026, 1, 1), D(2026, 2, 28)),
        ("World", 1000, "weekly", D(2026, 1, 5), D(2026, 5, 1), None), ("World", 2000, "monthly", None, D(2026, 3, 1), None),
    ]
    assert rows(refused, "change_id", "problem") == [(2, "already_ended"), (4, "no_plan"), (6, "unknown_broker")]


def test_execution_dates_clamp_and_repeat_both_ways(book):
    book.add("plans", instrument="A", amount_c=1, frequency="monthly", anchor_date=D(2026, 1, 31))
    book.add("plans", instrument="B", amount_c=1, frequency="biweekly", anchor_date=D(2026, 3, 20))
    found = rows(savings_plans.execution_dates(book.ledger().plans, D(2026, 2, 1), D(2026, 4, 5)), "instrument", "day")
    assert found == [("A", D(2026, 2, 28)), ("A", D(2026, 3, 31)), ("B", D(2026, 2, 6)), ("B", D(2026, 2, 20)), ("B", D(2026, 3, 6)), ("B", D(2026, 3, 20)), ("B", D(2026, 4, 3))]


def test_changes_by_reference(book, spark):
    book.receipt(D(2026, 4, 10), dict())
    st = book.statement((2026, 4))
    book.add("bookings", statement_id=st, booking_date=D(2026, 4, 12), amount_c=100, kind="income")
    book.add("bookings", statement_id=st, booking_date=D(2026, 4, 12), amount_c=-100, kind="investment")
    changes = spark.createDataFrame([(1, "i1", "pets"), (1, "t1", "pets"), (1, "t2", "pets"), (1, "zz", "pets"), (1, "i9", "pets")], "household_id bigint, ref string, category string")
    after, refused = upkeep.apply_category_changes(book.ledger(), changes)
    assert one(after.items)["spend_category"] == "pets"
    assert rows(refused, "ref", "problem") == [("i9", "no_such_entry"), ("t1", "wrong_flow"), ("t2", "transfers_and_investments_have_none"), ("zz", "not_a_reference")]


# ---- small things --------------------------------------------------------------------------------------
def test_expressions(spark):
    df = spark.createDataFrame([("Netflix International B.V.", "a  WPKNR: A2DKAR"), ("NETFLIX.COM 4711", "IE00B4L5Y983 x"), ("GmbH", "123e4567-e89b-12d3-a456-426614174000")], "n string, t string")
    assert [r[0] for r in df.select(E.payee_key("n")).collect()] == ["netflix", "netflix", "gmbh"]
    assert [r[0] for r in df.select(E.instrument_code("t")).collect()] == ["A2DKAR", "IE00B4L5Y983", None]
    import hashlib

    one_row = spark.range(1).select(E.booking_ref(F.lit("N26"), F.lit(D(2026, 1, 2)), F.lit(-1205).cast("bigint"), F.lit(" a  b ")).alias("r"))
    assert one_row.first()[0] == hashlib.sha1(b"N26|2026-01-02|-12.05|a b").hexdigest()[:16]


def test_document_hash_depends_on_content_and_order(spark, tmp_path):
    import hashlib

    folder = tmp_path / "doc"
    folder.mkdir()
    for name, text in (("1.txt", b"a"), ("2.txt", b"b")):
        (folder / name).write_bytes(text)
    whole = hashlib.sha256(hashlib.sha256(b"a").digest() + hashlib.sha256(b"b").digest()).hexdigest()
    found = one(sources.document_hashes(spark, str(tmp_path), folders=True))
    assert (found["sha256"], found["n_files"]) == (whole, 2)


def test_finders_refuse_bad_ranges_and_reports_are_complete(book):
    L = book.ledger()
    with pytest.raises(ValueError):
        finders.statements_in_range(L, ("Foo", 2026), ("Feb", 2026))
    with pytest.raises(ValueError):
        finders.statements_in_range(L, ("Mar", 2026), ("Feb", 2026))
    assert set(plans.month_report(L, 2026, 4)) >= {"totals", "categories", "stores", "missing_receipts"}
    assert set(plans.waste_report(L, TODAY)) >= {"score", "rescued", "opinions"}
    assert plans.subscription_report(L)["items"].count() == 0
    assert plans.investment_report(L, TODAY, "N26")["totals"].count() == 0


def _stored(path, table):
    return sorted(p for p in __import__("pathlib").Path(path, table).rglob("*.parquet"))


def test_a_batch_writes_what_it_changes_and_a_month_reads_its_files(book, spark, tmp_path):
    path = str(tmp_path / "m")
    st = book.statement((2026, 4))
    for day in range(1, 25):
        book.add("bookings", statement_id=st, booking_date=D(2026, 1 + day % 12, day), amount_c=-100 * day, counterparty=f"shop {day}")
    save_ledger(book.ledger(), path, buckets=2, file_rows=4)
    first = _stored(path, "bookings")
    assert len(first) >= 6  # one household, cut by days
    L = load_ledger(spark, path)
    store.update_ledger(L.with_(bookings=L.bookings.filter("id <> 3").withColumn("amount_c", F.when(F.col("id") == 5, -1).otherwise(F.col("amount_c")).cast("bigint"))), path, ("bookings",), [0, 1])
    new = [p for p in _stored(path, "bookings") if p not in first]
    written_rows = {"gone" if "-gone" in str(p) else "rows": spark.read.parquet(str(p)).count() for p in new}
    assert written_rows == {"rows": 1, "gone": 2}
    want = sorted((i, -1 if i == 5 else -100 * i) for i in range(1, 25) if i != 3)
    assert rows(load_ledger(spark, path).bookings, "id", "amount_c") == want
    may = load_ledger(spark, path, days=(D(2026, 5, 1), D(2026, 5, 31))).bookings
    assert rows(may.filter("month(booking_date) = 5"), "id") == [(4,), (16,)]
    assert len(may.inputFiles()) < len(load_ledger(spark, path).bookings.inputFiles())
    # a row whose day changes does not come back in its old month
    now = load_ledger(spark, path)
    moved = now.bookings.withColumn("booking_date", F.when(F.col("id") == 4, F.lit(D(2027, 1, 1))).otherwise(F.col("booking_date")))
    store.update_ledger(now.with_(bookings=moved), path, ("bookings",), [0, 1])
    may = load_ledger(spark, path, days=(D(2026, 5, 1), D(2026, 5, 31))).bookings
    assert rows(may.filter("booking_date between '2026-05-01' and '2026-05-31'"), "id") == [(16,)]
    store.compact(spark, path)
    store.drop_old_versions(spark, path)
    assert not any("-gone" in str(p) for p in _stored(path, "bookings"))
    assert rows(load_ledger(spark, path).bookings, "id", "amount_c") == want
    # a batch that changes nothing writes nothing
    same = load_ledger(spark, path)
    before = _stored(path, "bookings")
    store.update_ledger(same, path, ("bookings",), [0, 1])
    assert _stored(path, "bookings") == before


def test_rows_to_add_give_the_store_that_the_whole_content_gives(book, spark, tmp_path):
    st = book.statement((2026, 4))
    for day in range(1, 9):
        book.add("bookings", statement_id=st, booking_date=D(2026, 4, day), amount_c=-100 * day, counterparty="shop")
    L = book.ledger()
    stored = L.bookings.unionByName(L.bookings.filter("id = 2")).unionByName(L.bookings.filter("id = 4").withColumn("amount_c", F.lit(-7).cast("bigint")))
    stored = stored.unionByName(L.bookings.filter("id = 6").withColumn("household_id", F.lit(None).cast("bigint")))
    more = L.bookings.filter("id IN (1, 3)").withColumn("id", F.when(F.col("id") == 1, 100).otherwise(3).cast("bigint")).withColumn("amount_c", F.lit(-9).cast("bigint"))
    found = []
    for adds in (False, True):
        path = str(tmp_path / f"s{adds}")
        save_ledger(L.with_(bookings=stored), path, buckets=2)
        now = load_ledger(spark, path)
        store.update_ledger(now.with_(bookings=more if adds else now.bookings.unionByName(more)), path, ("bookings",), [0, 1], adds=adds)
        found.append(sorted((r.household_id is None, r.id, r.amount_c) for r in load_ledger(spark, path).bookings.collect()))
    assert found[0] == found[1] and {(False, 3, -9), (False, 100, -9)} <= set(found[0])


def test_only_documents_that_come_twice_are_numbered_together(spark):
    rows_ = [(1, "a", 1), (1, "a", 2), (2, "a", 3), (None, "b", 4), (None, "b", 5), (None, None, 6)]
    docs = spark.createDataFrame(rows_, "household_id long, doc_hash string, x int")
    found = ledger_source._numbered_copies(docs, ["household_id", "doc_hash"])
    copies = {r.x: r._copy for r in found.collect()}
    assert sorted((copies[1], copies[2])) == [1, 2] == sorted((copies[4], copies[5])) and copies[3] == copies[6] == 1 and len(copies) == 6


def test_a_chain_of_claims_takes_one_fold(book, spark, monkeypatch):
    """Answers that each claim what the one before claims too: alternate ones hold, in as many jobs as for two."""
    from hearth.operators.links import _first_come

    def chain(length):
        pairs = spark.createDataFrame([(1, k // 2 + k % 2, k // 2, k, 1000 + k % 2) for k in range(length)], "household_id bigint, a bigint, b bigint, at bigint, cents bigint")
        tracker = spark.sparkContext.statusTracker()
        spark.sparkContext.setJobGroup(f"chain{length}", "")
        kept = rows(_first_come(pairs, ["household_id"], "a", "b", ["at"], "cents", 2), "at")
        jobs = len(tracker.getJobIdsForGroup(f"chain{length}"))
        return kept, jobs

    def plain(length):
        a, b, kept = set(), set(), []
        for k in range(length):
            if k // 2 + k % 2 not in a and k // 2 not in b:
                a.add(k // 2 + k % 2)
                b.add(k // 2)
                kept.append((k,))
        return kept

    short, jobs = chain(4)
    long, more = chain(50)
    assert short == plain(4) and long == plain(50) and abs(more - jobs) <= 3


def test_references_are_given_out_as_a_loop_would(book):
    import random

    rng = random.Random(3)
    st = book.statement((2026, 4))
    tx, rc = [], []
    for _ in range(40):
        ref, cents = rng.choice(["A", "AB", "ABC", "B", "BX"]), 1000 + rng.randint(0, 3)
        tx.append((book.add("bookings", statement_id=st, booking_date=D(2026, 4, 4), amount_c=-cents, payment_reference=ref, counterparty=f"t{rng.random()}"), cents, ref))
    for _ in range(30):
        ref, cents = rng.choice(["ABCD", "ABX", "BXY", "AZ", "C"]), 1000 + rng.randint(0, 3)
        rc.append((book.receipt(D(2026, 4, 2), dict(unit_c=cents), payment_reference=ref, store_name=f"s{rng.random()}"), cents, ref))
    used, want = set(), []
    first = {}
    for i, cents, ref in tx:
        first[ref, cents] = min(first.get((ref, cents), i), i)
    for rid, cents, ref in sorted(rc, key=lambda r: (r[1], r[0])):
        fits = sorted((-len(t[2]), t[1], first[t[2], t[1]], t[0]) for t in tx if ref.startswith(t[2]) and abs(t[1] - cents) <= 1 and t[0] not in used)
        if fits:
            used.add(fits[0][3])
            want.append((fits[0][3], rid))
    assert rows(matching.match_receipts(book.ledger()).filter("reason LIKE 'payment%'"), "transaction_id", "receipt_id") == sorted(want)


def test_documents_that_all_come_once_are_read_once(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.sql("SELECT 1L AS household_id, 'h' || id AS doc_hash, id AS n FROM range(5)").write.parquet(path)
    found = ledger_source._numbered_copies(spark.read.parquet(path), ["household_id", "doc_hash"])
    assert rows(found, "n", "_copy") == [(n, 1) for n in range(5)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1 and "Join" not in plan


def test_lines_of_a_back_filled_receipt_tell_by_themselves_whether_they_are_stale(book, spark, tmp_path):
    line = lambda name, **m: dict(name=name, quantity=2, unit_price=1.0, discount=0.0, spend_category="groceries", storage_condition="Normal") | m
    old = [line("Milk", estimated_shelf_life_days=5), line("Rice", estimated_shelf_life_days=900), line("Salt"), line("Lunch", spend_category="eating_out", estimated_shelf_life_days=1)]
    docs = [receipt_doc(doc_hash="old", purchase_date="2025-06-01", total_amount=8.0, items=old)]
    L = book.ledger()
    after, _ = loads.load_receipts(*sources.read_submissions(spark, written(tmp_path, "back", docs), "receipt")[:2], L, TODAY, whole=False)
    assert rows(after.items, "name", "status", "quantity_left", "waste_reason") == [
        ("Lunch", "Available", 2.0, None), ("Milk", "Consumed", 0.0, "cleared"), ("Rice", "Available", 2.0, None), ("Salt", "Available", 2.0, None)]
    assert after.items._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1
