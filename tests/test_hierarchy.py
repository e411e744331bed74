import random

import pytest

from docloom.operators import hierarchy as H, skew
from tests.nodes import table, uid


def brute(parents):
    """node -> (root, depth, status, cycle minimum) by following the links."""
    out = {}
    for n in parents:
        seen, at = [], n
        while True:
            if at in seen:
                ring = seen[seen.index(at):]
                out[n] = (None, None, "cycle" if n in ring else "below_cycle", min(ring) if n in ring else None)
                break
            seen.append(at)
            p = parents[at]
            if p is None or p not in parents:
                out[n] = (at, len(seen) - 1, "tree" if p is None else "dangling", None)
                break
            at = p
    return out


def check(spark, parents, extra=""):
    rows = [{"pk": k, "parent_id": v} for k, v in parents.items()]
    nodes = table(spark, rows, extra)
    want = brute(parents)
    got = {r.pk: (r.root_pk, r.depth, r.status, r.cycle_pk) for r in H.hierarchy(nodes).collect()}
    assert got == want
    found = {(r.pk, r.cycle_pk) for r in H.found_cycles(nodes).collect()}
    assert found == {(k, v[3]) for k, v in want.items() if v[2] == "cycle"}


def test_shapes(spark):
    p = {uid(i): None for i in (0,)}
    p |= {uid(i): uid(i - 1) for i in range(1, 40)}  # a deep chain
    p |= {uid(100 + i): uid(3) for i in range(30)}  # many children
    p |= {uid(200): uid(200), uid(201): uid(200), uid(202): uid(201)}  # its own parent, with a tail
    p |= {uid(300 + i): uid(300 + (i + 1) % 7) for i in range(7)} | {uid(320): uid(303), uid(321): uid(320)}
    p |= {uid(400): uid(999), uid(401): uid(400)}  # the parent never came
    check(spark, p)


@pytest.mark.parametrize("seed", [1, 2])
def test_random(spark, seed):
    rng = random.Random(seed)
    p = {uid(i): rng.choice([None, *[uid(rng.randrange(60)) for _ in range(6)]]) for i in range(50)}
    check(spark, p)


def test_hot_parent_is_split(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 5)
    monkeypatch.setattr(skew, "MAX_HOT", 10)
    p = {uid(0): None, uid(1): uid(0)} | {uid(10 + i): uid(1) for i in range(60)} | {uid(200): uid(10)}
    check(spark, p)


def test_notations_copies_and_nulls(spark):
    rows = [
        {"pk": "{" + uid(1).upper() + "}", "parent_id": ""}, {"pk": uid(1).replace("-", ""), "parent_id": None}, {"pk": " urn:uuid:" + uid(2) + "\n", "parent_id": "urn:uuid:" + uid(1)},
        {"pk": None, "title": None, "parent_id": uid(1)}, {"pk": None, "title": "T", "parent_id": uid(2), "level": 2}]
    got = {r.pk: (r.root_pk, r.depth, r.n_descendants, r.level_agrees) for r in H.hierarchy(table(spark, rows)).collect()}
    import uuid

    named = str(uuid.uuid5(uuid.NAMESPACE_URL, "T"))
    assert got == {uid(1): (uid(1), 0, 2, None), uid(2): (uid(1), 1, 1, None), named: (uid(1), 2, 0, True)}
    below = {(r.pk, r.descendant_pk, r.distance) for r in H.descendants(H.hierarchy(table(spark, rows))).collect()}
    assert below == {(uid(1), uid(2), 1), (uid(1), named, 2), (uid(2), named, 1)}


def test_empty_and_clashing_columns(spark):
    assert H.hierarchy(table(spark, [])).count() == 0
    assert H.found_cycles(table(spark, [])).columns == ["pk", "cycle_pk"]
    check(spark, {uid(1): uid(2), uid(2): uid(1), uid(3): None}, "anc string, dist long, parent string, done boolean")
