"""Graph operators: bounded walks with a visited set, bridge-safe clusters and their measures."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import CORE_GLUE_RELATIONS as GLUE



def held(df: DataFrame) -> DataFrame:
    """df computed once: in the checkpoint folder where one is set, else in memory and on disk."""
    return df.checkpoint() if df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined() else df.persist()


def walk(seeds: DataFrame, edges: DataFrame, depth: int, types: tuple[str, ...] | None = None) -> DataFrame:
    """(seed, node, depth): nodes within so many steps of each seed, at their nearest depth. edges (a, b) go both ways; with types, only those (a, b, type).

    Every step joins the frontier with the edges and drops what was visited, so that paths never multiply; steps are cut off from their lineage in the
    checkpoint folder where one is set.
    """
    edges = edges if types is None else edges.filter(F.col("type").isin(*types))
    both = held(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    frontier = seeds.select("seed", F.col("seed").alias("node")).distinct().withColumn("depth", F.lit(0))
    visited = frontier
    for k in range(1, depth + 1):
        reached = frontier.join(both, frontier["node"] == both["a"]).select("seed", F.col("b").alias("node")).distinct()
        frontier = reached.join(visited, ["seed", "node"], "left_anti").withColumn("depth", F.lit(k))
        frontier = held(frontier)
        visited = visited.unionByName(frontier)
    return visited


def bridges(pairs: list[tuple]) -> set[tuple]:
    """Edges whose removal parts their component, by low-links without recursion."""
    near: dict = {}
    for k, (a, b) in enumerate(pairs):
        near.setdefault(a, []).append((b, k))
        near.setdefault(b, []).append((a, k))
    seen, low, cut, clock = {}, {}, set(), 0
    for start in sorted(near):
        if start in seen:
            continue
        stack = [(start, -1, iter(near[start]))]
        seen[start] = low[start] = clock
        clock += 1
        while stack:
            node, by, rest = stack[-1]
            for other, k in rest:
                if k == by:
                    continue
                if other in seen:
                    low[node] = min(low[node], seen[other])
                else:
                    seen[other] = low[other] = clock
                    clock += 1
                    stack.append((other, k, iter(near[other])))
                    break
            else:
                stack.pop()
                if stack:
                    parent = stack[-1][0]
                    low[parent] = min(low[parent], low[node])
                    if low[node] > seen[parent]:
                        cut.add(pairs[by])
    return cut


def cores(edges: pd.DataFrame, core: float, least: int = 3) -> list[tuple]:
    """(node, cluster) of one component's edges (a, b, similarity, relation).

    Strong glue edges without bridges are taken by similarity, then ids; two groups are united unless a contradiction would fall inside. Groups of `least`
    are cores, named by their smallest node.
    """
    rows = list(edges[["a", "b", "similarity", "relation"]].itertuples(index=False, name=None))
    against: dict = {}
    for a, b, _, r in rows:
        if r == "CONTRADICTS":
            against.setdefault(a, set()).add(b)
            against.setdefault(b, set()).add(a)
    strong = sorted(((a, b, s) for a, b, s, r in rows if r in GLUE and s >= core), key=lambda x: (-x[2], x[0], x[1]))
    cut = bridges([(a, b) for a, b, _ in strong])
    group = {n: {n} for a, b, _, _ in rows for n in (a, b)}
    for a, b, _ in strong:
        if (a, b) in cut or group[a] is group[b]:
            continue
        small, large = sorted((group[a], group[b]), key=len)
        if any(against.get(n, set()) & large for n in small):
            continue
        large |= small
        for n in small:
            group[n] = large
    return [(n, min(g)) for g in {id(g): g for g in group.values()}.values() if len(g) >= least for n in g]


def attach_in_order(rows: pd.DataFrame) -> list[tuple]:
    """(node, cluster, score) of candidates (node, cluster, score, against) that contradict each other, in order of nodes: each joins its best cluster that
    none of those it contradicts has joined before it."""
    joined: dict = {}
    for node, own in rows.sort_values(["node", "score", "cluster"], ascending=[True, False, True]).groupby("node", sort=True):
        for r in own.itertuples():
            if all(joined.get(other, (None,))[0] != r.cluster for other in r.against):
                joined[node] = (r.cluster, r.score)
                break
    return [(n, c, s) for n, (c, s) in joined.items()]


def components(edges: DataFrame) -> DataFrame:
    """(node, component): smallest node that can be reached, by alternating large and small stars until nothing changes.

    Each round contracts every neighbourhood onto its smallest node, so the rounds grow with the logarithm of the longest chain, not with its length.
    """
    edges = held(edges.select("a", "b"))
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).filter("node is not null").distinct()
    stars = held(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("low"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).filter("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("low").alias("v")), F.struct(F.col("v").alias("u"), F.col("low").alias("v")))).alias("e"))
        stars = held(small.select("e.u", "e.v").filter("u != v").distinct())
        after = tuple(stars.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if after == before:
            break
        before = after
    return nodes.join(stars.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def clusters(edges: DataFrame, core: float = 0.82, attach: float = 0.76, least: int = 3, links: int = 2) -> DataFrame:
    """(node, cluster, role, score) over the whole graph (a, b, similarity, relation).

    Cores are folded per component of strong glue. Another node joins the core with the best mean of its four best links to that core's own members, by
    any relation but a contradiction, given `links` of `attach` and no contradiction with a member; equal means: the smallest cluster. Links are
    aggregates; only candidates that contradict each other are taken in order, in groups that their contradictions connect.
    """
    edges = held(edges.select("a", "b", "similarity", "relation"))
    of = components(edges.filter(F.col("relation").isin(list(GLUE)) & (F.col("similarity") >= core)))
    inside = edges.filter(F.col("relation").isin([*GLUE, "CONTRADICTS"])).join(of.withColumnRenamed("node", "a"), "a").join(of.select(F.col("node").alias("b"), F.col("component").alias("other")), "b").filter("component = other")

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(cores(rows, core, least), columns=["node", "cluster"])

    found = held(inside.select("component", "a", "b", "similarity", "relation").groupBy("component").applyInPandas(fold, "node long, cluster long"))
    out = found.select("node", "cluster", F.lit("core").alias("role"), F.lit(1.0).alias("score"))
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity", "relation"))
    reach = both.join(found.select(F.col("node").alias("b"), "cluster"), "b").join(found.select(F.col("node").alias("a")), "a", "left_anti")
    near = reach.filter((F.col("relation") != "CONTRADICTS") & (F.col("similarity") >= attach)).groupBy(F.col("a").alias("node"), "cluster").agg(F.collect_list("similarity").alias("s")).filter(F.size("s") >= links)
    four = F.slice(F.sort_array("s", asc=False), 1, 4)
    near = near.select("node", "cluster", F.round(F.aggregate(four, F.lit(0.0), lambda t, x: t + x) / F.size(four), 6).alias("score"))
    against = reach.filter("relation = 'CONTRADICTS'").select(F.col("a").alias("node"), "cluster").distinct()
    near = held(near.join(against, ["node", "cluster"], "left_anti"))
    nodes = near.select("node").distinct()
    foes = both.filter("relation = 'CONTRADICTS'").select("a", "b").join(nodes.withColumnRenamed("node", "a"), "a").join(nodes.withColumnRenamed("node", "b"), "b").distinct()
    foes = held(foes)
    calm = near.join(foes.select(F.col("a").alias("node")).distinct(), "node", "left_anti")
    calm = calm.groupBy("node").agg(F.min(F.struct((-F.col("score")).alias("s"), "cluster")).alias("m")).select("node", F.col("m.cluster").alias("cluster"), F.lit("fringe").alias("role"), (-F.col("m.s")).alias("score"))
    out = out.unionByName(calm)
    if foes.isEmpty():
        return out

    def order(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(attach_in_order(rows), columns=["node", "cluster", "score"])

    torn = near.join(foes.groupBy(F.col("a").alias("node")).agg(F.collect_list("b").alias("against")), "node").join(components(foes), "node")
    torn = torn.groupBy("component").applyInPandas(order, "node long, cluster long, score double")
    return out.unionByName(torn.select("node", "cluster", F.lit("fringe").alias("role"), "score"))


def outliers(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(node): nodes of edges that are in no cluster."""
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    return nodes.join(members.select("node"), "node", "left_anti")


def _within(members: DataFrame, edges: DataFrame) -> DataFrame:
    """edges with the clusters of both ends, of_a and of_b."""
    side = lambda c: members.select(F.col("node").alias(c), F.col("cluster").alias(f"of_{c}"))
    return edges.join(side("a"), "a", "left").join(side("b"), "b", "left")


def membership_metrics(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, cluster, affinity, links, strongest, similarity): the mean of a member's four best links inside its cluster, their number, and the best one.
    A member without such links has affinity 0 and no strongest neighbour."""
    inside = _within(members, edges).filter("of_a = of_b and relation != 'CONTRADICTS'")
    both = inside.select(F.col("a").alias("node"), F.col("b").alias("other"), "similarity").unionByName(inside.select(F.col("b").alias("node"), F.col("a").alias("other"), "similarity"))
    top = both.groupBy("node").agg(F.sort_array(F.collect_list(F.struct((-F.col("similarity")).alias("s"), "other"))).alias("x"))
    four = F.slice("x", 1, 4)
    top = top.select("node", F.round(F.aggregate(four, F.lit(0.0), lambda t, x: t - x["s"]) / F.size(four), 6).alias("affinity"), F.size("x").alias("links"), F.get("x", F.lit(0))["other"].alias("strongest"), (-F.get("x", F.lit(0))["s"]).alias("similarity"))
    return members.select("node", "cluster").join(top, "node", "left").na.fill(0, ["affinity", "links"])


def cluster_metrics(members: DataFrame, edges: DataFrame, k: int = 12) -> DataFrame:
    """(cluster, n, internal, density, cohesion, boundary, separation). Edges that leave a cluster are its boundary, of any relation; a contradiction inside
    counts for neither."""
    known = _within(members, edges)
    inside = known.filter("of_a = of_b and relation != 'CONTRADICTS'").groupBy(F.col("of_a").alias("cluster")).agg(F.count("*").alias("internal"), F.avg("similarity").alias("cohesion"))
    crossing = known.filter("not (of_a <=> of_b)")
    ends = reduce(DataFrame.unionByName, [crossing.select(F.col(c).alias("cluster"), "similarity") for c in ("of_a", "of_b")]).filter("cluster is not null")
    outside = ends.groupBy("cluster").agg(F.max("similarity").alias("boundary"))
    sizes = members.groupBy("cluster").agg(F.count("*").alias("n"))
    out = sizes.join(inside, "cluster", "left").join(outside, "cluster", "left").na.fill(0)
    room = F.least(F.col("n") * (F.col("n") - 1) / 2, F.col("n") * F.greatest(F.lit(1), F.least(F.lit(k), F.col("n") - 1)) / 2)
    return out.select(
        "cluster", "n", "internal", F.round(F.when(room > 0, F.least(F.lit(1.0), F.col("internal") / room)).otherwise(0.0), 6).alias("density"), F.round("cohesion", 6).alias("cohesion"),
        F.round("boundary", 6).alias("boundary"), F.round(F.greatest(F.lit(0.0), F.col("cohesion") - F.col("boundary")), 6).alias("separation"),
    )


def representatives(points: DataFrame, most: int = 8, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(cluster, place, id) of points (cluster, id, vector, core): the core member with the highest mean cosine to all core members, and then, one after
    another, the member least like any chosen so far; equal ones by id. All members, where a cluster has no core.

    The mean cosine to a set is the cosine to the mean of its unit vectors, so that no pairs are made; a place costs one aggregate over members.
    """
    norm = F.sqrt(F.aggregate(vector_col, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    own = points.select("cluster", F.col(id_col).alias("id"), F.coalesce("core", F.lit(False)).alias("core"), F.transform(vector_col, lambda x: x.cast("double")).alias("v"), norm.alias("n")).filter("n > 0 and n < double('infinity')")
    own = held(own.select("cluster", "id", "core", F.transform("v", lambda x: x / F.col("n")).alias("v")))
    cored = own.groupBy("cluster").agg(F.max("core").alias("cored"))
    chosen = own.join(cored, "cluster").filter("core or not cored")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    means = chosen.select("cluster", F.posexplode("v").alias("k", "x")).groupBy("cluster", "k").agg(F.avg("x").alias("x")).groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("mean"))
    first = chosen.join(means, "cluster").groupBy("cluster").agg(F.min(F.struct((-F.round(dot("v", "mean"), 9)).alias("s"), "id", "v")).alias("m"))
    last = held(first.select("cluster", F.lit(0).alias("place"), "m.id", "m.v"))
    out, left = [last], own.withColumn("like", F.lit(-2.0))
    for place in range(1, most):
        left = left.join(last.select("cluster", F.col("id").alias("_id"), F.col("v").alias("_v")), "cluster").filter("id != _id")
        left = held(left.select("cluster", "id", "core", "v", F.greatest("like", F.round(dot("v", "_v"), 9)).alias("like")))
        last = held(left.groupBy("cluster").agg(F.min(F.struct("like", "id", "v")).alias("m")).select("cluster", F.lit(place).alias("place"), "m.id", "m.v"))
        out.append(last)
    return reduce(DataFrame.unionByName, out).select("cluster", "place", "id")
