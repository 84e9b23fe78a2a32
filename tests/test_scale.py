"""What keeps the jobs in bounds on large tables: what is read, how it is dealt out, what is sent to the driver."""

from book import D

from hearth.operators.investments import plan_slots
from hearth.operators.finders import investment_bookings
from hearth.operators.base import contains_join
from hearth.operators.matching import band_join, match_receipts
from hearth.operators.quality import check_statements
from hearth.sources import star
from hearth.sources.scratch import written


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_a_ledger_table_is_derived_when_it_is_asked_for(spark, tmp_path):
    spark.sql("SELECT cast(id AS bigint) AS c_custkey FROM range(20)").write.parquet(f"{tmp_path}/customer.parquet")
    L = star.star_ledger(spark, str(tmp_path))  # no other table of the sample is there
    assert L.with_(keys=("household_id",)).plans.count() == 20
    assert {name for _, folder, name in star._DERIVED if folder == str(tmp_path)} == {"plans"}


def test_derived_lines_are_numbered_by_order_whatever_the_join_order(spark, tmp_path):
    spark.sql("SELECT 7L AS o_orderkey, 3L AS o_custkey, 'O' AS o_orderstatus, 10.0D AS o_totalprice, timestamp'1998-01-01' AS o_orderdate, 'x' AS o_orderpriority").write.parquet(
        f"{tmp_path}/orders.parquet")
    spark.sql("SELECT p_partkey, 'nut' AS p_name, 'B' AS p_brand, 'SMALL' AS p_type, 1 AS p_size FROM VALUES 1L, 2L AS v(p_partkey)").write.parquet(f"{tmp_path}/part.parquet")
    spark.sql("""SELECT k AS l_orderkey, p AS l_partkey, 1L AS l_suppkey, n AS l_linenumber, 2.0D AS l_quantity, 4.0D AS l_extendedprice, 0.5D AS l_discount, 0.0D AS l_tax,
 'N' AS l_returnflag, 'O' AS l_linestatus, timestamp'1998-02-01' AS l_shipdate FROM VALUES (7L, 2L, 1), (7L, 1L, 2), (7L, 9L, 3), (8L, 1L, 1) AS v(k, p, n)""").write.parquet(f"{tmp_path}/lineitem.parquet")
    L = star.star_ledger(spark, str(tmp_path))
    assert sorted((r.id, r.unit_c) for r in L.items.collect()) == [(7001, 200), (7002, 200)]
    assert [(r.id, r.total_c, r.discount_c) for r in L.receipts.collect()] == [(7, 400, 400)]


def test_plans_are_dealt_out_before_they_unfold(book, spark):
    book.add("plans", instrument="ETF", amount_c=1000, frequency="weekly", anchor_date=D(2026, 1, 5), start_date=D(2026, 1, 5))
    st = book.statement((2026, 2), bank="N26")
    book.add("bookings", statement_id=st, kind="investment", amount_c=-1000, booking_date=D(2026, 1, 5))
    L = book.ledger()
    L = L.with_(plans=L.plans.coalesce(1))
    slots = plan_slots(L, investment_bookings(L), D(2026, 3, 1))
    assert slots.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert slots.count() == 8


def test_category_problems_are_flags_not_sets(book, spark):
    heads = spark.sql("SELECT 1L AS household_id, d AS doc_id, date'2026-01-01' AS period_start, date'2026-01-31' AS period_end, 0L AS opening_c, cast(null AS bigint) AS closing_c FROM VALUES 1L, 2L, 3L AS v(d)")
    lines = spark.sql("""SELECT 1L AS household_id, d AS doc_id, date'2026-01-02' AS booking_date, -1L AS amount_c, k AS kind, c AS category
 FROM VALUES (1L, 'spend', 'nonsense'), (1L, 'spend', null), (1L, 'spend', 'salary'), (1L, 'fee', null), (2L, 'spend', 'rent') AS v(d, k, c)""")
    df = check_statements(heads, lines, book.ledger())
    assert "collect_set" not in plan_of(df)
    assert sorted((r.doc_id, r.problems) for r in df.collect()) == [
        (1, ["missing_category", "unknown_category", "wrong_flow"]), (2, []), (3, ["no_transactions"])]


def test_names_are_keyed_once(book):
    st = book.statement((2026, 4))
    book.add("bookings", statement_id=st, amount_c=-500, counterparty="ACME GmbH", booking_date=D(2026, 4, 11))
    book.receipt(D(2026, 4, 10), dict(unit_c=500), store_name="Acme")
    df = match_receipts(book.ledger())
    assert "regexp_replace" not in plan_of(df)
    assert [(r.transaction_id, r.receipt_id, r.confidence) for r in df.collect()] == [(1, 1, "certain")]


def test_cells_and_pieces_are_merged_not_broadcast(spark):
    left = spark.createDataFrame([(1, 100, D(2026, 1, 5))], "k bigint, cents bigint, day date")
    right = spark.createDataFrame([(1, 101, D(2026, 1, 9))], "k bigint, o_cents bigint, o_day date")
    near = band_join(left, right, ["k"], "day", "o_day", 5, 5, ("cents", "o_cents"))
    held = contains_join(spark.createDataFrame([(1, "a booking PP12")], "k bigint, long string"), spark.createDataFrame([(1, "PP12")], "k bigint, short string"), ["k"], "long", "short")
    for df in (near, held):
        assert df.count() == 1
        assert "Broadcast" not in plan_of(df)


def test_written_tables_are_not_taken_for_smaller_than_they_are(spark):
    df = written(spark.sql("SELECT id % 3 AS k, repeat('x', 2000) AS text FROM range(20000)"))
    assert df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() > 20 * 2000


def test_stock_items_share_a_group(book, spark, tmp_path):
    from test_stock import EVENT

    from hearth.streaming import stream_stock

    book.receipt(D(2026, 4, 10), dict(quantity=2), dict(quantity=3), dict(quantity=1))
    book.receipt(D(2026, 4, 10), dict(quantity=9), household_id=2)
    L = book.ledger()
    names = [part.strip().split(" ")[0] for part in EVENT.split(",")]
    steps = [(1, 1, 0, 2.0), (1, 2, 1, 1.0), (2, 4, 2, 4.0), (1, 99, 3, 1.0), (1, 2, 4, 5.0), (1, 1, 5, 1.0)]
    events = spark.createDataFrame([
        tuple({"household_id": h, "item_id": i, "event_id": e, "ts": __import__("datetime").datetime(2026, 4, 12, 10, e), "day": D(2026, 4, 12), "action": "use", "amount": a}.get(c) for c in names)
        for h, i, e, a in steps], EVENT)
    events.write.parquet(f"{tmp_path}/in")
    moves = stream_stock(L, spark.readStream.schema(EVENT).parquet(f"{tmp_path}/in"), keep_finished=None, groups=1)
    q = moves.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    found = spark.read.parquet(f"{tmp_path}/out")
    assert sorted((r.event_id, r.problem, r.quantity_left) for r in found.collect()) == [
        (0, None, 0.0), (1, None, 2.0), (2, None, 5.0), (3, "no_such_item", None), (4, None, 0.0), (5, "nothing_left", 0.0)]


def test_items_with_many_events_and_with_few_come_to_the_same(book, spark, monkeypatch):
    from pyspark.sql import functions as F
    from test_stock import EVENT

    from hearth.operators import upkeep

    book.receipt(D(2026, 4, 10), dict(quantity=6), dict(quantity=2, storage_condition="Frozen"), dict(quantity=3, spend_category="electronics", category="Electronics"))
    L = book.ledger()
    names = [part.strip().split(" ")[0] for part in EVENT.split(",")]
    actions = ["use", "discard", "freeze", "open", "update", "finish", "throw", "use", None]
    rows = []
    for item in (1, 2, 3, 9):
        for n, action in enumerate(actions * 2):
            values = {"household_id": 1, "item_id": item, "event_id": item * 100 + n, "day": D(2026, 4, 12), "action": action, "amount": [1.0, None, -1.0, 0.5][(n + item) % 4],
                      "reason": ["spoiled", "gave_away", "nonsense", ""][(n // 2 + item) % 4], "location": [" cellar ", None, " "][n % 3], "rating": [None, 4, 9][(n + item) % 3]}
            rows.append(tuple(values.get(c) for c in names))
    events = spark.createDataFrame(rows, EVENT).withColumn("ts", F.timestamp_seconds(F.col("event_id")))
    found = []
    for many in (1000, 0):
        monkeypatch.setattr(upkeep, "MANY_EVENTS", many)
        items, refused = upkeep.apply_stock_events(L, events)
        if many:
            assert "MapInArrow" not in plan_of(refused) and "mapInArrow" not in plan_of(refused)
        found.append((sorted(map(str, items.collect())), sorted((r.item_id, r.event_id, r.problem) for r in refused.collect())))
    assert found[0] == found[1] and len(found[0][1]) > 20


def _sample(spark, folder):
    """A small star-schema sample with lines that come twice, a missing part and an order of no household."""
    spark.sql("""SELECT id AS o_orderkey, CASE WHEN id <> 5 THEN id * 53 % 400 END AS o_custkey, element_at(array('O', 'P', 'F'), cast(id % 3 + 1 AS int)) AS o_orderstatus, 10.25D * id AS o_totalprice,
 cast(date_add(date'1998-01-20', cast(id * 3 AS int)) AS timestamp) AS o_orderdate, CASE WHEN id % 4 = 0 THEN '1-URGENT' ELSE 'x' END AS o_orderpriority FROM range(1, 40)""").write.parquet(f"{folder}/orders.parquet")
    spark.sql("SELECT id AS p_partkey, 'nut' AS p_name, 'B' AS p_brand, element_at(array('SMALL', 'STANDARD', 'MEDIUM'), cast(id % 3 + 1 AS int)) AS p_type, cast(id AS int) AS p_size FROM range(20)").write.parquet(
        f"{folder}/part.parquet")
    spark.sql("""SELECT id % 39 + 1 AS l_orderkey, id * 7 % 22 AS l_partkey, 1L AS l_suppkey, cast(id % 4 AS int) AS l_linenumber, 1.0D + id % 5 AS l_quantity, CASE WHEN id % 50 <> 0 THEN 3.17D * (id % 60) END AS l_extendedprice,
 0.05D AS l_discount, 0.0D AS l_tax, 'N' AS l_returnflag, 'O' AS l_linestatus, timestamp'1998-02-01' AS l_shipdate FROM range(300) LATERAL VIEW explode(array(1, 2)) t AS twice""").write.parquet(f"{folder}/lineitem.parquet")
    spark.sql("""SELECT id AS event_id, id % 90 AS user_id, timestamp'1998-03-01' AS ts, element_at(array('purchase', 'signup', 'click', 'error', 'view'), cast(id % 5 + 1 AS int)) AS event_type, 1.5D * id AS value
 FROM range(60)""").write.parquet(f"{folder}/events.parquet")
    return folder


def test_a_month_carries_the_columns_it_needs(spark, tmp_path):
    from hearth.catalog import all_queries

    first, second = _sample(spark, f"{tmp_path}/a"), _sample(spark, f"{tmp_path}/b")
    query = all_queries()["month_metrics"]
    found = query(spark, first)
    assert {name for _, folder, name in star._DERIVED if folder == first} == {"receipts", "bookings", "statements"}  # the items are not written for one reading
    assert not any(column in plan_of(found).split("== Physical Plan ==")[1] for column in ("p_name", "p_brand", "l_tax"))
    written_before = star.star_ledger(spark, second)
    assert written_before.items.count() > 0
    assert sorted(map(str, found.collect())) == sorted(map(str, query(spark, second).collect()))


def test_receipts_are_summed_from_written_items(spark, tmp_path):
    first, second = _sample(spark, f"{tmp_path}/a"), _sample(spark, f"{tmp_path}/b")
    from_lines = star.star_ledger(spark, first).receipts
    L = star.star_ledger(spark, second)
    assert "_who" not in L.items.columns
    for name in ("lineitem", "part"):  # read no more
        import shutil

        shutil.rmtree(f"{second}/{name}.parquet")
    assert sorted(map(str, from_lines.collect())) == sorted(map(str, L.receipts.collect()))
    assert L.receipts.filter("household_id IS NULL").count() == 1


def test_stored_rows_are_compared_by_digest(spark, monkeypatch):
    from hearth.sources import store

    kept = []
    monkeypatch.setattr(store, "written", lambda df: kept.append(df.columns) or written(df))
    old = spark.sql("SELECT * FROM VALUES (1, 1L, 'a'), (1, 2L, 'b'), (1, 3L, 'c'), (cast(null AS int), 4L, 'd') AS v(household_id, id, name)")
    own = ["household_id", "id"]
    fewer = old.filter("id <> 2 AND household_id IS NOT NULL")
    added, gone = store._difference(old.filter("household_id IS NOT NULL"), fewer, own)
    assert "Join" not in plan_of(added) and added.count() == 0  # nothing to add: no row travels
    assert [tuple(r) for r in gone.collect()] == [(1, 2)]
    changed = old.selectExpr("household_id", "id", "CASE WHEN id = 3 THEN 'x' ELSE name END AS name").unionByName(spark.sql("SELECT 1 AS household_id, 9L AS id, 'n' AS name"))
    added, gone = store._difference(old, changed, own)
    assert sorted((r.id, r.name) for r in added.collect()) == [(3, "x"), (4, "d"), (9, "n")]  # a row without a household is met by none
    assert sorted(r.id for r in gone.collect()) == [3, 4]
    assert all("name" not in columns for columns in kept) and len(kept) == 2


def test_streamed_events_and_items_are_handed_over_as_one_text(book, spark, tmp_path):
    import re

    from test_stock import EVENT

    from hearth.streaming import stream_stock

    book.receipt(D(2026, 4, 10), dict(quantity=3, name='"Öl"', location="shelf, 1\n"), dict(quantity=2, quantity_left=float("nan")))
    L = book.ledger()
    names = [part.strip().split(" ")[0] for part in EVENT.split(",")]
    events = spark.createDataFrame([
        tuple({"household_id": 1, "item_id": i, "event_id": e, "ts": __import__("datetime").datetime(2026, 4, 12, 10, e), "day": D(2026, 4, 12), "action": "use", "amount": a}.get(c) for c in names)
        for i, e, a in [(1, 0, 1.0), (1, 1, 0.1), (2, 2, 1.0), (None, 3, 1.0)]], EVENT)
    events.write.parquet(f"{tmp_path}/in")
    moves = stream_stock(L, spark.readStream.schema(EVENT).parquet(f"{tmp_path}/in"), keep_finished=None, groups=1)
    handed = re.search(r"TransformWithStateInPySpark[^\n]*\n[^\n]*Project \[([^\n]*)\]\n", moves._jdf.queryExecution().analyzed().toString()).group(1)
    assert set(re.findall(r"(\w+)#", handed)) == {"stock_group", "event"}
    q = moves.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    found = spark.read.parquet(f"{tmp_path}/out")
    assert sorted((r.event_id, r.item_id, r.problem, str(r.quantity_left)) for r in found.collect()) == [
        (0, 1, None, "2.0"), (1, 1, None, "1.9"), (2, 2, None, "0.0"), (3, None, "no_such_item", "None")]
