"""Parent-child links to full hierarchies by pointer doubling.

Every node carries a pointer to an ancestor and the distance to it. Each round joins the pointers with themselves, so the
distance doubles: after k rounds every node of depth below 2^k knows its top. If a round resolves no node, none with a
depth in [2^(k-1), 2^k) exists, hence none deeper either: what is left lies on a cycle or hangs below one. Only unresolved
nodes take part in a round, and the rounds cut their lineage in the shared folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from docloom.functions.ids import canonical_id, node_id
from docloom.operators.skew import lookup_join
from docloom.session import drop_stash, stash, stash_counted


def parent_links(deliveries: DataFrame) -> DataFrame:
    """(pk, parent, level): one row for each node, the parent from its earliest delivery that names one.

    Rows whose id can't be derived (pk and title null) are no nodes. A missing reference is null.
    """
    rows = deliveries.select(
        node_id(F.col("pk"), F.col("title"), F.col("partition_name")).alias("pk"),
        canonical_id(F.col("parent_id")).alias("parent"),
        F.col("level").cast("long").alias("level"),
        F.col("delivery_no").cast("long").alias("no"),
    ).filter(F.col("pk").isNotNull())
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("no", c)))[c].alias(c)
    return rows.groupBy("pk").agg(first("parent"), first("level"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def resolve(links: DataFrame, paths: bool = False) -> tuple[list[DataFrame], DataFrame | None]:
    """Pointer doubling over ``links(pk, parent)``, pk unique.

    Returns the written parts of the resolved nodes (pk, anc = top node, dist = depth, dangling = the top's parent never
    came, and with ``paths`` seg = the ancestors from the parent up to the top) and the nodes on or below cycles
    (pk, anc = their parent, jump = where the doubled pointer leads), or None if there are none. An empty input gives empty
    parts.
    """
    base, counts = stash_counted(links.select("pk", "parent"), "links", n=F.lit(True))
    n = counts["n"]
    known = base.select(F.col("pk").alias("parent"), F.lit(True).alias("there"))
    start = lookup_join(base, known, "parent", n)
    top = ~F.coalesce("there", F.lit(False))
    state = start.select(
        "pk",
        F.when(top, F.col("pk")).otherwise(F.col("parent")).alias("anc"),
        F.when(top, 0).otherwise(1).cast("long").alias("dist"),
        top.alias("done"),
        (top & F.col("parent").isNotNull()).alias("dangling"),
        *([F.when(top, F.array().cast("array<string>")).otherwise(F.array("parent")).alias("seg")] if paths else []),
    )
    current, counts = stash_counted(state, "round", left=~F.col("done"))
    drop_stash(base)
    parts = [current.filter("done")]
    keep = ["pk", "anc", "dist", "done", "dangling"] + ["seg"] * paths
    left = counts["left"]
    first = current
    while left:
        jump = _union([*parts, current.filter("not done")])
        right = jump.select(F.col("pk").alias("anc"), *(F.col(c).alias(f"r_{c}") for c in keep[1:]))
        step = lookup_join(current.filter("not done").drop("done", "dangling"), right, "anc", left, "inner").select(
            "pk",
            F.col("r_anc").alias("anc"),
            (F.col("dist") + F.col("r_dist")).alias("dist"),
            F.col("r_done").alias("done"),
            F.col("r_dangling").alias("dangling"),
            *([F.concat("seg", "r_seg").alias("seg")] if paths else []),
        )
        before, last = left, current
        current, counts = stash_counted(step, "round", left=~F.col("done"))
        left = counts["left"]
        if left == before:  # nothing resolved: the rest never reaches a top
            drop_stash(current)
            far = last.filter("not done").select("pk", F.col("anc").alias("jump"))
            rest = far.select("pk", F.col("jump").alias("anc"), "jump") if last is first else first.select("pk", "anc").join(far, "pk")
            return parts, rest
        parts.append(current.filter("done"))
    return parts, None


def cycles(rest: DataFrame) -> DataFrame:
    """(pk, cycle_pk) of the nodes on cycles, out of nodes that all lead into one: ``rest(pk, anc = parent, jump)``.

    The images of the doubled step (from ``jump`` on, any number of steps up) shrink until they hold the cycles only (equal
    size twice: the step is one-to-one on them). On those, doubling with the minimum finds the smallest pk, two doublings a
    round; a round that changes nothing has seen whole cycles.
    """
    step, counts = stash_counted(rest.select("pk", F.col("jump").alias("anc")), "step", size=F.lit(True))
    size = counts["size"]
    image, counts = stash_counted(step.select("anc").distinct(), "image", n=F.lit(True))
    a = counts["n"]
    while True:
        doubled = stash(lookup_join(step, step.select(F.col("pk").alias("anc"), F.col("anc").alias("to")), "anc", size, "inner").select("pk", F.col("to").alias("anc")), "step")
        smaller, counts = stash_counted(doubled.select("anc").distinct(), "image", n=F.lit(True))
        if counts["n"] == a:
            on = image.select(F.col("anc").alias("pk"))
            break
        drop_stash(step)
        drop_stash(image)
        step, image, a = doubled, smaller, counts["n"]
    low = stash(rest.join(on, "pk", "left_semi").select("pk", "anc", F.least("pk", "anc").alias("cycle_pk")), "low")

    def doubled_low(now: DataFrame) -> DataFrame:
        right = now.select(F.col("pk").alias("anc"), F.col("anc").alias("to"), F.col("cycle_pk").alias("other"))
        changed = F.col("other") < F.col("cycle_pk")
        return now.join(right, "anc").select("pk", F.col("to").alias("anc"), F.least("cycle_pk", "other").alias("cycle_pk"), (F.col("changed") | changed if "changed" in now.columns else changed).alias("changed"))

    while True:
        following, counts = stash_counted(doubled_low(doubled_low(low)), "low", changed=F.col("changed"))
        drop_stash(low)
        low = following.drop("changed")
        low._docloom_path = following._docloom_path
        if not counts["changed"]:
            return low.select("pk", "cycle_pk")


def found_cycles(deliveries: DataFrame) -> DataFrame:
    """(pk, cycle_pk): the nodes on cycles of parent links; a node that is its own parent is one. Empty if none."""
    _, rest = resolve(parent_links(deliveries))
    if rest is None:
        return deliveries.sparkSession.createDataFrame([], "pk string, cycle_pk string")
    return cycles(rest)


def hierarchy(deliveries: DataFrame) -> DataFrame:
    """One row for each node: pk, root_pk, depth, path (ids from the top to the node), n_descendants, status, cycle_pk.

    status: ``tree``; ``dangling`` (the named parent of its top never came; the top is the last node that did);
    ``cycle``; ``below_cycle``. For the last two root_pk, depth, path and n_descendants are null. ``level_agrees`` tells
    whether the stored level equals the depth (null without a level).
    """
    links = stash(parent_links(deliveries), "parents")
    parts, rest = resolve(links, paths=True)
    trees = _union(parts)
    below = trees.select(F.explode("seg").alias("pk")).groupBy("pk").agg(F.count("*").alias("n_descendants"))
    out = trees.join(below, "pk", "left").select(
        "pk",
        F.col("anc").alias("root_pk"),
        F.col("dist").alias("depth"),
        F.concat(F.reverse("seg"), F.array("pk")).alias("path"),
        F.coalesce("n_descendants", F.lit(0)).cast("long").alias("n_descendants"),
        F.when(F.col("dangling"), "dangling").otherwise("tree").alias("status"),
        F.lit(None).cast("string").alias("cycle_pk"),
    )
    if rest is not None:
        on = cycles(rest)
        out = out.unionByName(
            rest.select("pk").join(on, "pk", "left").select("pk", F.when(F.col("cycle_pk").isNull(), "below_cycle").otherwise("cycle").alias("status"), "cycle_pk"),
            allowMissingColumns=True,
        )
    return out.join(links.select("pk", "level"), "pk").withColumn("level_agrees", F.col("level") == F.col("depth")).drop("level")


def descendants(tree: DataFrame) -> DataFrame:
    """(pk, descendant_pk, distance): all nodes below each node, out of ``hierarchy``; none for nodes at or below cycles."""
    exploded = tree.filter(F.col("path").isNotNull()).select(F.col("pk").alias("descendant_pk"), "depth", F.posexplode("path").alias("at", "pk"))
    return exploded.filter(F.col("pk") != F.col("descendant_pk")).select("pk", "descendant_pk", (F.col("depth") - F.col("at")).alias("distance"))
