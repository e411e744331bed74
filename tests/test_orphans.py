import datetime as dt

import pytest

from docloom.operators import orphans as O
from tests.nodes import table, uid

DEL = "deletion_no long, pk string, deleted_at timestamp_ntz, requested_by string"


def setup(spark):
    link = lambda pk: [{"text": None, "url": None, "pk": pk, "type": None}]
    nodes = table(spark, [
        {"pk": uid(1), "parent_id": uid(2), "left_sibling": "", "related_links": [*link("{" + uid(3).upper() + "}"), *link(uid(3)), *link(None)]},
        {"pk": uid(2), "parent_id": uid(9), "right_sibling": " "},
        {"pk": uid(4), "parent_id": uid(1), "left_sibling": uid(5)},
        {"pk": uid(5), "parent_id": uid(8)},
        {"pk": uid(5), "parent_id": uid(8)},
        {"pk": None, "title": None, "parent_id": uid(8)},
        {"pk": uid(6), "parent_id": uid(6), "related_links": None}])
    day = lambda m: dt.datetime(2025, 1, 1, 0, m)
    gone = spark.createDataFrame([(1, uid(4), day(30), None), (2, uid(5), day(3), "x"), (3, uid(5).upper(), day(2), None), (4, uid(77), day(1), None), (5, None, day(1), None), (6, uid(1), None, None)], DEL)
    return nodes, gone


# uid(4) is deleted; uid(5) came again after its last deletion; uid(1)'s deletion has no time
WANT = {(uid(1), "related_links", uid(3)), (uid(2), "parent_id", uid(9)), (uid(5), "parent_id", uid(8))}


@pytest.mark.parametrize("bits", [O.MAX_BITS, 64])
def test_references(spark, bits):
    nodes, gone = setup(spark)
    found = O.orphan_references(nodes, gone, bits)
    assert {(r.pk, r.ref_field, r.ref_pk) for r in found.collect()} == WANT
    assert found.count() == 3  # each once
    report = {(r.ref_field, r.month): (r.n_references, r.n_nodes, r.n_targets) for r in O.orphan_report(found).collect()}
    assert report == {("related_links", "2025-01"): (1, 1, 1), ("parent_id", "2025-01"): (2, 2, 2)}


def test_empty(spark):
    nodes, gone = setup(spark)
    assert O.orphan_references(nodes.limit(0), gone).count() == 0
    assert {r.ref_pk for r in O.orphan_references(nodes, gone.limit(0)).collect()} == {uid(3), uid(9), uid(8)}


def test_filter_never_loses_a_key(spark):
    keys = spark.range(5000).selectExpr("cast(id as string) as k")
    bloom = O.BloomFilter.of(keys, "k", 5000)
    assert keys.filter(~bloom.maybe("k")).count() == 0
    others = spark.range(10000, 30000).selectExpr("cast(id as string) as k")
    assert others.filter(bloom.maybe("k")).count() < 1500
