"""Cycles in graphs of parties: strongly connected components."""

from __future__ import annotations

import itertools
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftlake.session import shared_folder

#: Ways out of a node, on average, that a part of the edges keeps of a dense graph, the share of its
#: edges that such a part may be at most, rounds in it, and parts that are tried one after another.
PART_WAYS, PART_SHARE, PART_ROUNDS, PARTS = 4, 1 / 2, 8, 3


def _kept(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read again, so that rounds do not add up to one long plan. (A
    checkpoint would keep the plan's estimated size, which is squared by each join with itself.)"""
    path = f"{shared_folder(df.sparkSession)}/rounds-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _contracted(edges: DataFrame, inner: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, members, rings) without nodes that have one way in and one way out.

    A chain of such nodes becomes one edge from the node before it to the node behind it; members
    (key, node, head, tail) tells which. Pointers to both sides are doubled in every round, so a
    chain takes as many rounds as its length has digits. What never leaves such nodes is a ring:
    rings (key, node, component).
    """
    back = edges.select("key", F.col("dst").alias("node"), F.col("src").alias("head"))
    forth = edges.select("key", F.col("src").alias("node"), F.col("dst").alias("tail"))
    now = _kept(inner.select("key", "node").join(back, ["key", "node"]).join(forth, ["key", "node"]).withColumn("low", F.col("node")))
    rounds = max(1, now.count()).bit_length() + 1
    for _ in range(rounds):
        left = now.select("key", F.col("node").alias("head"), F.col("head").alias("further_head"))
        right = now.select("key", F.col("node").alias("tail"), F.col("tail").alias("further_tail"), F.col("low").alias("low_there"))
        both = now.join(left, ["key", "head"], "left").join(right, ["key", "tail"], "left")
        moved = F.col("further_head").isNotNull() | F.col("further_tail").isNotNull()
        now = _kept(
            both.select(
                "key", "node", F.coalesce("further_head", "head").alias("head"), F.coalesce("further_tail", "tail").alias("tail"), F.least("low", "low_there").alias("low"), moved.alias("moved")
            )
        )
        if now.where("moved").isEmpty():
            break
    names = now.select("key", F.col("node").alias("tail"))
    rings = now.join(names, ["key", "tail"], "left_semi").select("key", "node", F.col("low").alias("component"))
    members = _kept(now.join(names, ["key", "tail"], "left_anti").select("key", "node", "head", "tail"))
    outside = edges.join(inner.select("key", F.col("node").alias("src")), ["key", "src"], "left_anti").join(inner.select("key", F.col("node").alias("dst")), ["key", "dst"], "left_anti")
    short = members.select("key", F.col("head").alias("src"), F.col("tail").alias("dst"))
    return outside.select("key", "src", "dst").unionByName(short).distinct(), members, rings


def _coloured(edges: DataFrame, rounds: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(components, rest): each node takes the greatest name that reaches it as its colour; those of
    a colour that also reach the node of that name are its component. rest: edges inside a colour
    between nodes that are in no component yet. With ``rounds`` both ways stop after so many: nodes
    of a component still reach each other, but it may lack some."""
    counted = lambda: itertools.count() if rounds is None else range(rounds)
    nodes = edges.select("key", F.col("src").alias("node")).unionByName(edges.select("key", F.col("dst").alias("node"))).distinct()
    colour = _kept(nodes.withColumn("colour", F.col("node")))
    for _ in counted():
        told = edges.join(colour.withColumnRenamed("node", "src"), ["key", "src"]).groupBy("key", F.col("dst").alias("node")).agg(F.max("colour").alias("told"))
        after = colour.join(told, ["key", "node"], "left").select("key", "node", F.greatest("colour", "told").alias("colour"), F.coalesce(F.col("told") > F.col("colour"), F.lit(False)).alias("moved"))
        after = _kept(after)
        colour = after.drop("moved")
        if after.where("moved").isEmpty():
            break
    both = edges.join(colour.select("key", F.col("node").alias("src"), F.col("colour").alias("a")), ["key", "src"]).join(colour.select("key", F.col("node").alias("dst"), F.col("colour").alias("b")), ["key", "dst"])
    inside = _kept(both.where("a = b").select("key", "src", "dst", F.col("a").alias("colour")))
    reached = _kept(colour.where("node = colour").select("key", "node", F.col("colour").alias("component")))
    border = reached
    for _ in counted():
        near = inside.join(border.select("key", F.col("node").alias("dst")), ["key", "dst"], "left_semi").select("key", F.col("src").alias("node"), F.col("colour").alias("component")).distinct()
        border = _kept(near.join(reached, ["key", "node"], "left_anti"))
        if border.isEmpty():
            break
        reached = _kept(reached.unionByName(border))
    done = reached.select("key", "node")
    rest = inside.join(done.withColumnRenamed("node", "src"), ["key", "src"], "left_anti").join(done.withColumnRenamed("node", "dst"), ["key", "dst"], "left_anti")
    several = reached.groupBy("key", "component").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return reached.join(several, ["key", "component"]).select("key", "node", "component"), rest.select("key", "src", "dst")


def _gathered(live: DataFrame, number: int = 0) -> DataFrame | None:
    """(key, node, component) of nodes that reach each other by a part of the edges alone; component
    is the name of one of them. None if the graph has too few edges to a node for such a part, or
    if it tells nothing.

    In a dense graph a few ways out of each node hold most of a component together, so rounds need
    not go over all edges. The part is chosen by a hash of the edge; ``number`` chooses another.
    """
    node = lambda end: F.approx_count_distinct(F.struct("key", end))
    n = live.agg(F.approx_count_distinct(F.struct("key", "src", "dst")).alias("edges"), F.greatest(node("src"), node("dst")).alias("nodes")).first()
    share = PART_WAYS * n["nodes"] / max(1, n["edges"])
    if share > PART_SHARE:
        return None
    scale = 1 << 20
    part = live.where(F.pmod(F.xxhash64(F.lit(number), "src", "dst"), F.lit(scale)) < int(share * scale)).where("src <> dst").distinct()
    # Rounds go over numbers, which are smaller than names. Nodes with a way in and a way out have one;
    # the greatest, which colours spread from, are those with the most ways.
    part = _kept(part)
    ways = [part.groupBy("key", F.col(end).alias("name")).agg(F.count("*").alias(f"{end}_ways")) for end in ("src", "dst")]
    nodes = ways[0].join(ways[1], ["key", "name"]).orderBy(F.least("src_ways", "dst_ways"))
    nodes = _kept(nodes.select("key", "name", F.monotonically_increasing_id().alias("node")))
    for end in ("src", "dst"):
        part = part.join(nodes.select("key", F.col("name").alias(end), F.col("node").alias(f"{end}_number")), ["key", end])
    part = _kept(part.select("key", F.col("src_number").alias("src"), F.col("dst_number").alias("dst")))
    groups = _coloured(part, PART_ROUNDS)[0]
    named = groups.join(nodes, ["key", "node"]).select("key", "component", F.col("name").alias("member"))
    named = _kept(named.join(nodes.select("key", F.col("node").alias("component"), F.col("name").alias("label")), ["key", "component"]).select("key", F.col("member").alias("node"), F.col("label").alias("component")))
    return None if named.isEmpty() else named


def _merged(live: DataFrame, groups: DataFrame) -> DataFrame:
    """The distinct edges that are left between nodes when those of a group become one."""
    for end in ("src", "dst"):
        name = groups.select("key", F.col("node").alias(end), F.col("component").alias("now")).hint("shuffle_hash")
        # Distinct after either end: most of a dense graph's edges are one by then.
        live = live.join(name, ["key", end], "left").withColumn(end, F.coalesce("now", end)).select("key", "src", "dst").where("src <> dst").distinct()
    return live


def strong_components(edges: DataFrame, key: str = "graph_key") -> DataFrame:
    """(key, party, component, size) of all parties on a cycle of an edge table (key, src, dst).

    Two parties share a component if each reaches the other; its name is the smallest of its
    parties. A party on no cycle gives no row; one with an edge to itself is a component. Edges with
    a null end or a null key are left out; repeated ones count once.

    Rounds alternate: nodes without a way in or out go; chains become one edge (pointers are
    doubled, so long ones take few rounds); and where neither changes anything, colours are spread
    along what is left and come back. Only the last takes as many rounds as the longest shortest
    way between branching nodes. All rounds are joins and groups over edges or nodes.

    Before that, nodes that a part of a dense graph's edges already shows to be of one component
    become one node, and so do the edges between them; the rounds go over all edges that are left.
    """
    live = _kept(edges.select(F.col(key).alias("key"), "src", "dst").where("key is not null and src is not null and dst is not null"))
    loops = _kept(live.where("src = dst").select("key", F.col("src").alias("node"), F.col("src").alias("component")).distinct())
    live = live.where("src <> dst")
    merged = []
    while len(merged) < PARTS and (groups := _gathered(live, len(merged))) is not None:
        merged.append(groups)
        live = _kept(_merged(live, groups))
    known = _kept(_components(live.distinct()))
    for groups in reversed(merged):
        # A node of a group is where the group's name is; the others stay.
        outer = known.select("key", F.col("node").alias("component"), F.col("component").alias("outer"))
        inside = groups.join(outer, ["key", "component"], "left").select("key", "node", F.coalesce("outer", "component").alias("component"))
        known = _kept(known.join(groups.select("key", "node"), ["key", "node"], "left_anti").unionByName(inside))
    known = _kept(known.unionByName(loops.join(known.select("key", "node"), ["key", "node"], "left_anti")))
    names = known.groupBy("key", "component").agg(F.min("node").alias("name"), F.count("*").alias("size"))
    return known.join(names, ["key", "component"]).select(F.col("key").alias(key), F.col("node").alias("party"), F.col("name").alias("component"), "size")


def _components(live: DataFrame) -> DataFrame:
    """(key, node, component) of the nodes that reach each other by distinct edges (key, src, dst)
    between different nodes, by rounds as ``strong_components`` says."""
    found, chains = [], []
    while True:
        live = _kept(live)
        out = live.groupBy("key", F.col("src").alias("node")).agg(F.count("*").alias("ways_out"))
        into = live.groupBy("key", F.col("dst").alias("node")).agg(F.count("*").alias("ways_in"))
        nodes = _kept(out.join(into, ["key", "node"]))
        n = live.count()
        if not n:
            break
        # Nodes with a way in and a way out: what leads to others goes.
        ends = nodes.select("key", "node")
        inner = nodes.where("ways_out = 1 and ways_in = 1")
        trimmed = live.join(ends.withColumnRenamed("node", "src"), ["key", "src"], "left_semi").join(ends.withColumnRenamed("node", "dst"), ["key", "dst"], "left_semi").select("key", "src", "dst")
        if not inner.isEmpty():
            live, members, rings = _contracted(live, inner)
            chains.append(members)
            found.append(rings)
            live = live.where("src <> dst")
        elif trimmed.count() < n:
            live = trimmed
        else:
            components, live = _coloured(live)
            found.append(components)
    known = live.select("key", F.col("src").alias("node"), F.col("src").alias("component")).where("false")
    for part in found:
        known = known.unionByName(part)
    known = _kept(known)
    for members in reversed(chains):
        # A chain that comes back to where it began makes a component of that node if it has none.
        rings = members.where("head = tail").select("key", F.col("head").alias("node"), F.col("head").alias("component")).distinct()
        known = known.unionByName(rings.join(known.select("key", "node"), ["key", "node"], "left_anti"))
        # A chain is part of a component if both its ends are in that one.
        head = known.select("key", F.col("node").alias("head"), "component")
        tail = known.select("key", F.col("node").alias("tail"), "component")
        known = _kept(known.unionByName(members.join(head, ["key", "head"]).join(tail, ["key", "tail", "component"]).select("key", "node", "component")))
    return known


def has_cycle(edges: DataFrame, key: str = "graph_key") -> DataFrame:
    """(key, has_cycle) for each graph of an edge table (key, src, dst).

    A part of a graph's edges that holds a cycle settles it; graphs without such a part, or whose
    part holds none, are looked at with all their edges.
    """
    every = _kept(edges.select(F.col(key).alias("key"), "src", "dst"))
    live = every.where("key is not null and src is not null and dst is not null")
    cyclic = live.where("src = dst").select("key").distinct()
    groups = _gathered(live)
    if groups is not None:
        cyclic = cyclic.unionByName(groups.select("key")).distinct()
    cyclic, keys = _kept(cyclic), _kept(every.select("key").distinct())
    open_ = keys.where("key is not null").join(cyclic, "key", "left_anti")
    if not open_.isEmpty():
        rest = strong_components(live.join(open_, "key", "left_semi"), "key").select("key")
        cyclic = cyclic.unionByName(rest).distinct()
    return keys.join(cyclic.withColumn("c", F.lit(True)), "key", "left").select(F.col("key").alias(key), F.coalesce("c", F.lit(False)).alias("has_cycle"))
