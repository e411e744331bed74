from docloom.operators import delivery_store as D
from tests.nodes import table, uid


def rows():
    return [{"pk": uid(1)}, {"pk": uid(2)}, {"pk": uid(1).upper()}, {"pk": None, "title": None}, {"pk": "{" + uid(2) + "}"}, {"pk": uid(1)}, {"pk": None, "title": "x"}, {"pk": None, "title": "x"}, {"pk": None, "title": None}]


def test_exactly_one_row_stays(spark):
    nodes = table(spark, rows())
    assert sorted(r.delivery_no for r in D.surplus_deliveries(nodes).collect()) == [2, 4, 5, 7]
    kept = D.exactly_once(nodes)
    assert sorted(r.delivery_no for r in kept.collect()) == [0, 1, 3, 6, 8]
    assert set(nodes.columns) < set(kept.columns)


def test_upsert_is_idempotent(spark):
    s = D.DeliveryStore(spark, "node", "no", 4)
    batch = spark.createDataFrame([("a", 3, "x"), ("a", 1, "y"), ("b", 2, None), (None, 9, "z")], "node string, no long, payload string")
    s.upsert(batch)
    s.upsert(batch)
    first = sorted(map(tuple, s.compact().collect()))
    s.upsert(batch)
    assert sorted(map(tuple, s.compact().collect())) == first == [("a", 1, "y"), ("b", 2, None)]
    s.upsert(spark.createDataFrame([("a", 0, "earlier")], "node string, no long, payload string"))
    assert sorted(map(tuple, s.compact().collect())) == [("a", 0, "earlier"), ("b", 2, None)]


def test_hot_identifier_and_missing_batches(spark):
    many = [{"pk": uid(7), "batch_no": None if i % 2 else i} for i in range(60)] + [{"pk": uid(i)} for i in range(30)]
    nodes = table(spark, many)
    assert D.surplus_deliveries(nodes).count() == 60  # 59 copies of the hot one and the one that equals uid(7)


def test_empty_and_clashing(spark):
    assert D.surplus_deliveries(table(spark, [])).count() == 0
    assert D.exactly_once(table(spark, [])).count() == 0
    assert D.surplus_deliveries(table(spark, rows(), "node string, kept long")).count() == 4


def test_runs_are_merged_without_shuffle_or_sort(spark):
    s = D.DeliveryStore(spark, "k", "o", 4)
    s.upsert(spark.range(300).selectExpr("cast(id as string) k", "id * 2 o", "id v"))
    s.upsert(spark.range(150, 450).selectExpr("cast(id as string) k", "id o", "-id v"))
    with D._sorted_buckets(spark):
        plan = s.merged(*s.runs)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
    got = {r.k: (r.o, r.v) for r in s.close().collect()}
    assert got == {str(i): (i, -i) if i >= 150 else (2 * i, i) for i in range(450)}


def test_full_buckets_are_doubled(spark, monkeypatch):
    monkeypatch.setattr(D, "BUCKET_ROWS", 10)
    s = D.DeliveryStore(spark, "k", "o", 2)
    for i in range(3):
        s.upsert(spark.range(40).selectExpr(f"cast(id + {i * 20} as string) k", f"id + {i} o"))
        s.compact()
    assert s.buckets == 4 and len(s.runs) == 1
    assert {r.k: r.o for r in s.compact().collect()} == {str(k): min(k - 20 * i + i for i in range(3) if 0 <= k - 20 * i < 40) for k in range(80)}
