"""Traversals and checks of the stored node graph."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window, functions as F

from docloom.functions.ids import canonical_id
from docloom.operators.skew import join_parts, ranged
from docloom.session import drop_stash, stash


def edges(nodes: DataFrame) -> DataFrame:
    """(kind, src, dst, pos): child, left and right edges of the nodes, for drawing a tree."""
    child = nodes.select(F.lit("child").alias("kind"), F.col("pk").alias("src"), F.posexplode("child_ids").alias("pos", "dst"))
    child = child.select("kind", "src", canonical_id(F.col("dst")).alias("dst"), "pos")
    side = lambda kind: nodes.select(F.lit(kind.split("_")[0]).alias("kind"), F.col("pk").alias("src"), canonical_id(F.col(kind)).alias("dst"), F.lit(0).alias("pos"))
    return child.unionByName(side("left_sibling")).unionByName(side("right_sibling")).filter("dst is not null")


def sibling_links(children: DataFrame, parent: str, key: str, order: str) -> DataFrame:
    """(key, left, right): neighbours under one parent by ``order``, a number, and key; '' at the ends.

    A parent of very many children is cut into ranges of the order, whose ends are then tied together.
    """
    rows = ranged(children.select(parent, key, order), order)
    w = Window.partitionBy(parent, "__range").orderBy(order, key)
    local = rows.withColumn("__left", F.lag(key).over(w)).withColumn("__right", F.lead(key).over(w))
    place = F.struct(order, key)
    ends = rows.groupBy(parent, "__range").agg(F.min_by(key, place).alias("__first"), F.max_by(key, place).alias("__last"))
    w = Window.partitionBy(parent).orderBy("__range")
    ends = ends.select(parent, "__range", F.lag("__last").over(w).alias("__before"), F.lead("__first").over(w).alias("__after"))
    return join_parts(local, ends, [parent]).select(key, F.coalesce("__left", "__before", F.lit("")).alias("left"), F.coalesce("__right", "__after", F.lit("")).alias("right"))


def number_titles(rows: DataFrame, parent: str, title: str, order: str) -> DataFrame:
    """``rows`` with ``unique_title``: the n-th equal title under a parent by ``order``, a number, gets ``_n`` from the second on."""
    by = list(dict.fromkeys([parent, title]))
    cut = ranged(rows, order)
    local = cut.withColumn("__n", F.row_number().over(Window.partitionBy(*by, "__range").orderBy(order)))
    sizes = cut.groupBy(*by, "__range").agg(F.count("*").alias("__size"))
    w = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(*by, "__range", F.coalesce(F.sum("__size").over(w), F.lit(0)).alias("__before"))
    n = F.col("__n") + F.col("__before")
    unique = F.when(n > 1, F.concat(title, F.lit("_"), n.cast("string"))).otherwise(F.col(title))
    return join_parts(local, before, by).withColumn("unique_title", unique).drop("__n", "__before", "__range")


def subtree_texts(nodes: DataFrame, paths: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, text): texts of a subtree in pre-order, joined by empty lines.

    ``nodes``: pk, text, pos (place under its parent); ``paths``: pk, path (ids from the top); ``roots``: root. A node's
    key is the list of places on its path, so sorting by it is pre-order; a null text counts as ''.
    """
    steps = paths.select("pk", F.posexplode("path").alias("depth", "up"))
    place = nodes.select(F.col("pk").alias("up"), F.coalesce("pos", F.lit(-1)).alias("pos"))
    keys = steps.join(place, "up", "left").groupBy("pk").agg(F.array_sort(F.collect_list(F.struct("depth", F.coalesce("pos", F.lit(-1)).alias("pos"), "up"))).alias("key"))
    inside = steps.select("pk", F.col("up").alias("root")).join(roots, "root")
    rows = inside.join(keys, "pk").join(nodes.select("pk", F.coalesce("text", F.lit("")).alias("text")), "pk")
    return rows.groupBy("root").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", "text"))), lambda x: x["text"]), "\n\n").alias("text"))


def dead_links(nodes: DataFrame) -> DataFrame:
    """(pk, target): internal links to nodes that aren't there."""
    links = nodes.select("pk", F.explode("related_links").alias("l")).filter("l.type = 'internal'").select("pk", canonical_id(F.col("l.pk")).alias("target")).filter("target is not null").distinct()
    return links.join(nodes.select(F.col("pk").alias("target")), "target", "left_anti").select("pk", "target")


def walk(nodes: DataFrame, starts: DataFrame, hops: int = 5, seed: int = 1) -> DataFrame:
    """(start, hop, pk): a walk over internal links for each start; it ends where no live link is.

    At each node the link with the smallest hash of (start, link, ``seed``) is taken.
    """
    links = nodes.select("pk", F.explode("related_links").alias("l")).filter("l.type = 'internal'").select("pk", canonical_id(F.col("l.pk")).alias("next")).filter("next is not null").distinct()
    links = stash(links.join(nodes.select(F.col("pk").alias("next")), "next", "left_semi"), "links")
    at = starts.select(F.col("pk").alias("start"), F.lit(0).alias("hop"), "pk")
    out = at
    for hop in range(1, hops + 1):
        # hops are few: each reads the chosen links once
        choice = F.min(F.struct(F.md5(F.concat("start", "next", F.lit(str(seed)))), "next"))["next"]
        at = stash(at.join(links, "pk").groupBy("start").agg(choice.alias("pk")).select("start", F.lit(hop).alias("hop"), "pk"), "hop")
        out = out.unionByName(at)
    return out


def frontier(links: DataFrame, starts: DataFrame) -> DataFrame:
    """(url, depth): pages reachable from ``starts(url)`` over ``links(src, dst)``, breadth first, each once.

    Every round joins only the newest pages; those seen before are taken out by an anti join. Stops when nothing is new.
    """
    seen = new = stash(starts.select("url").distinct().withColumn("depth", F.lit(0)), "seen")
    for depth in itertools.count(1):
        found = new.join(links, new["url"] == links["src"]).select(F.col("dst").alias("url")).distinct()
        new = stash(found.join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth)), "new")
        if not new.limit(1).count():
            drop_stash(new)
            break
        seen = seen.unionByName(new)
        if depth % 20 == 0:
            seen = stash(seen, "seen")  # keeps the plan short on deep graphs
    return seen


def tree_problems(nodes: DataFrame) -> DataFrame:
    """(pk, problem): parents that don't list a child, and children listed that name another parent."""
    listed = nodes.select(F.col("pk").alias("parent"), F.explode("child_ids").alias("c")).select("parent", canonical_id(F.col("c")).alias("pk")).filter("pk is not null").distinct()
    named = nodes.select("pk", canonical_id(F.col("parent_id")).alias("parent")).filter("parent is not null")
    there = named.join(nodes.select(F.col("pk").alias("parent")), "parent", "left_semi")
    unlisted = there.join(listed, ["pk", "parent"], "left_anti").select("pk", F.lit("not listed by its parent").alias("problem"))
    foreign = listed.join(nodes.select("pk"), "pk", "left_semi").join(named, ["pk", "parent"], "left_anti").select("pk", F.lit("listed by another node").alias("problem"))
    return unlisted.unionByName(foreign.distinct())
