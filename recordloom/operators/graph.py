"""Strongly connected components and cycle groups of resolved relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordloom.session import cut

#: Edges up to which one sequential pass on the driver replaces the rounds.
DRIVER_EDGES = 50_000


def _tarjan(edges: list[tuple]) -> dict:
    """Least member of each node's component; iterative."""
    out: dict = {}
    after: dict = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
        after.setdefault(b, [])
    index, low, stack, on = {}, {}, [], set()
    for root in after:
        if root in index:
            continue
        work = [(root, iter(after[root]))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            v, nexts = work[-1]
            for w in nexts:
                if w not in index:
                    index[w] = low[w] = len(index)
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(after[w])))
                    break
                if w in on:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    members = []
                    while True:
                        w = stack.pop()
                        on.discard(w)
                        members.append(w)
                        if w == v:
                            break
                    out |= dict.fromkeys(members, min(members))
    return out


def _spread(labels: DataFrame, edges: DataFrame, source: str, target: str) -> DataFrame:
    """Least label along edges within one colour, to the fixed point. labels: v, label, colour."""
    while True:
        around = edges.join(labels.select(F.col("v").alias(source), "label", "colour"), source).select(F.col(target).alias("v"), F.col("label").alias("seen"), "colour")
        best = around.groupBy("v", "colour").agg(F.min("seen").alias("seen"))
        after = cut(labels.join(best, ["v", "colour"], "left").select("v", F.least("label", "seen").alias("label"), "colour", (F.col("seen") < F.col("label")).alias("moved")), "labels")
        moved = not after.where("moved").isEmpty()
        labels = after.drop("moved")
        if not moved:
            return labels


def strong_components(edges: DataFrame, driver_edges: int = DRIVER_EDGES) -> DataFrame:
    """edges a, b -> node, component (its least node), members; components of two nodes at least.

    Small graphs (checked by count) are solved in one pass on the driver. Others run in rounds: nodes without edges
    in or out go; least labels spread forward give colours; what a colour's root is reached from, within the colour,
    is its component, which then leaves."""
    edges = cut(edges.select("a", "b").where("a <> b").distinct(), "edges")
    spark, kind = edges.sparkSession, edges.schema["a"].dataType.simpleString()
    found = None
    if edges.limit(driver_edges + 1).count() <= driver_edges:
        labels = _tarjan(sorted((r.a, r.b) for r in edges.collect()))
        found = spark.createDataFrame(sorted(labels.items()), f"node {kind}, component {kind}")
    else:
        while True:
            while True:
                trimmed = cut(edges.join(edges.select(F.col("a").alias("b")).distinct(), "b", "left_semi").join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").select("a", "b"), "edges")
                same = trimmed.count() == edges.count()
                edges = trimmed
                if same:
                    break
            if edges.isEmpty():
                break
            nodes = cut(edges.select(F.col("a").alias("v")).union(edges.select("b")).distinct().select("v", F.col("v").alias("label"), F.lit(0).cast(kind).alias("colour")), "nodes")
            coloured = _spread(nodes, edges, "a", "b").select("v", F.col("label").alias("colour"))
            back = coloured.select("v", F.when(F.col("v") == F.col("colour"), 0).otherwise(1).alias("label"), "colour")
            inside = edges.join(coloured.select(F.col("v").alias("a"), F.col("colour").alias("ca")), "a").join(coloured.select(F.col("v").alias("b"), F.col("colour").alias("cb")), "b").where("ca = cb").select("a", "b")
            done = _spread(back, cut(inside, "edges"), "b", "a").where("label = 0").select(F.col("v").alias("node"), F.col("colour").alias("component"))
            found = done if found is None else found.union(done)
            edges = cut(edges.join(done.select(F.col("node").alias("a")), "a", "left_anti").join(done.select(F.col("node").alias("b")), "b", "left_anti").select("a", "b"), "edges")
        if found is None:
            found = spark.createDataFrame([], f"node {kind}, component {kind}")
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    return found.join(sizes, "component").select("node", "component", "members")


def cycle_groups(relations: DataFrame, components: DataFrame, sample: int = 10) -> DataFrame:
    """relations a, b (rows, not distinct): component, members, relation_edges, sample (its first members)."""
    at = components.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    to = components.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    inside = relations.where("a <> b").join(at, "a").join(to, "b").where("ca = cb").groupBy(F.col("ca").alias("component")).agg(F.count(F.lit(1)).alias("relation_edges"))
    order = W.partitionBy("component").orderBy("node")
    least = components.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= sample)
    ranked = least.groupBy("component").agg(F.first("members").alias("members"), F.array_sort(F.collect_list("node")).alias("sample"))
    return ranked.join(inside, "component").select("component", "members", "relation_edges", "sample")
