"""Graphs as edge tables: every round is a join on node ids, and cuts its lineage in the checkpoint folder; tables that later rounds supersede are deleted."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, uncut


def _cut(df: DataFrame) -> DataFrame:
    return cut(df, "graph")


class _Pieces:
    """A result that grows by a table each round: MANY tables become one, so neither is the whole rewritten each time nor does the plan grow without end."""

    MANY = 16

    def __init__(self, *tables: DataFrame):
        self.tables = list(tables)

    def add(self, table: DataFrame) -> None:
        self.tables.append(table)
        if len(self.tables) >= self.MANY:
            whole = _cut(self.frame())
            uncut(*self.tables)
            self.tables = [whole]

    def frame(self) -> DataFrame:
        out = self.tables[0]
        for t in self.tables[1:]:
            out = out.unionByName(t)
        return out


def _rounds(most: int | None):
    """1, 2, ... up to ``most``, which has to suffice."""
    for k in count(1):
        if most is not None and k > most:
            raise ValueError(f"no end after {most} rounds")
        yield k


def degrees(edges: DataFrame) -> DataFrame:
    """node, out_degree, in_degree; self-loops count on both sides."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    return ends.groupBy("x.node").agg(F.sum("x.o").alias("out_degree"), F.sum("x.i").alias("in_degree"))


def reach(edges: DataFrame, start: DataFrame, depth: int | None = None) -> DataFrame:
    """node, distance: nodes reachable from the ``node`` column of start (in at most ``depth`` steps, if given), and the fewest steps."""
    frontier = _cut(start.select("node").distinct().withColumn("distance", F.lit(0)))
    seen = _Pieces(frontier)
    step = _cut(edges.select("src", "dst"))  # computed once, however many rounds
    for d in count(1) if depth is None else range(1, depth + 1):
        ahead = frontier.where(F.col("distance") == d - 1).join(step, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        frontier = _cut(ahead.join(seen.frame(), "node", "left_anti").withColumn("distance", F.lit(d)))
        if frontier.isEmpty():
            break
        seen.add(frontier)
        frontier = seen.tables[-1]  # the table it is in now
    uncut(step)
    return seen.frame()


def shortest_paths(edges: DataFrame, start: DataFrame, rounds: int | None = None) -> DataFrame:
    """node, cost: the least sum of weights (negative ones count as 0), relaxed until nothing changes."""
    w = edges.select("src", "dst", F.greatest(F.col("w"), F.lit(0.0)).alias("w"))
    best = _cut(start.select("node").distinct().withColumn("cost", F.lit(0.0)))
    for _ in _rounds(rounds):
        via = best.join(w, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), (F.col("cost") + F.col("w")).alias("cost"))
        new = _cut(best.unionByName(via).groupBy("node").agg(F.min("cost").alias("cost")))
        done = new.exceptAll(best).isEmpty()
        uncut(best)
        if done:
            return new
        best = new


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """node, component: the smallest node reachable over edges in either direction; label spreading with pointer jumping."""
    both = _cut(edges.select("src", "dst").union(edges.select("dst", "src")).distinct())
    label = _cut(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.min("src")).alias("component")))
    for _ in _rounds(rounds):
        near = both.join(label, F.col("dst") == F.col("node")).groupBy(F.col("src").alias("node")).agg(F.min("component").alias("n"))
        spread = label.join(near, "node").select("node", F.least("component", "n").alias("component"), F.col("component").alias("was"))
        jump = label.select(F.col("node").alias("component"), F.col("component").alias("far"))
        new = _cut(spread.join(jump, "component", "left").select("node", F.least("component", F.coalesce("far", "component")).alias("component"), "was"))
        uncut(label)
        label = new.drop("was")
        if new.where("component <> was").isEmpty():
            uncut(both)
            return label


def topological_levels(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """node, level: the longest path from a source; nodes on or behind a cycle have none (null)."""
    e = _cut(edges.select("src", "dst").distinct())
    nodes = _cut(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct())
    done, left, rest = _Pieces(), e, nodes
    for level in (k - 1 for k in _rounds(rounds)):
        free = _cut(rest.join(left.select(F.col("dst").alias("node")), "node", "left_anti").withColumn("level", F.lit(level)))
        if free.isEmpty():
            break
        was = rest, left
        rest = _cut(rest.join(free, "node", "left_anti"))
        left = _cut(left.join(free.select(F.col("node").alias("src")), "src", "left_anti"))
        uncut(*was)
        done.add(free)
    stuck = rest.withColumn("level", F.lit(None).cast("int"))
    return done.frame().unionByName(stuck) if done.tables else stuck


def subgraph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges whose ends are both in the ``node`` column of nodes."""
    kept = nodes.select("node").distinct()
    return edges.join(kept.withColumnRenamed("node", "src"), "src", "left_semi").join(kept.withColumnRenamed("node", "dst"), "dst", "left_semi").select(*edges.columns)


def strong_components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """node, component: the smallest node among those that it reaches and that reach it.

    Every round takes off nodes that nothing enters or leaves, gives each other node the smallest
    node that reaches it, and from each of these goes back along edges inside its own
    colour: what it meets is one component. Nodes and edges so found leave the graph.
    """
    left = _cut(edges.select("src", "dst").where("src <> dst").distinct())
    nodes = _cut(edges.select(F.col("src").alias("node")).union(edges.select("dst")).where("node IS NOT NULL").distinct())
    done = _Pieces()
    for _ in _rounds(rounds):
        while True:
            inner = left.select(F.col("src").alias("node")).intersect(left.select("dst"))
            alone = _cut(nodes.join(inner, "node", "left_anti"))
            if alone.isEmpty():
                break
            was = nodes, left
            nodes = _cut(nodes.join(alone, "node", "left_anti"))
            left = _cut(subgraph(left, nodes))
            uncut(*was)
            done.add(_cut(alone.withColumn("component", F.col("node"))))
            uncut(alone)
        if nodes.isEmpty():
            break
        colour = _cut(nodes.withColumn("component", F.col("node")))
        while True:
            sent = colour.join(left, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), "component")
            new = _cut(colour.unionByName(sent).groupBy("node").agg(F.min("component").alias("component")))
            over = new.exceptAll(colour).isEmpty()
            uncut(colour)
            colour = new
            if over:
                break
        ends = left.join(colour.select(F.col("node").alias("src"), F.col("component").alias("a")), "src").join(colour.select(F.col("node").alias("dst"), F.col("component").alias("b")), "dst")
        back = _cut(ends.where("a = b").select("src", "dst"))
        frontier = _cut(colour.where("node = component").withColumn("step", F.lit(0)))
        found = _Pieces(frontier)
        for step in count(1):
            before = frontier.where(F.col("step") == step - 1).join(back, F.col("node") == F.col("dst")).select(F.col("src").alias("node"), "component").distinct()
            frontier = _cut(before.join(found.frame(), "node", "left_anti").withColumn("step", F.lit(step)))
            if frontier.isEmpty():
                break
            found.add(frontier)
            frontier = found.tables[-1]
        parts = _cut(found.frame().drop("step"))
        was = nodes, left
        nodes = _cut(nodes.join(parts, "node", "left_anti"))
        left = _cut(subgraph(left, nodes))
        uncut(*was, *found.tables, back, colour)
        done.add(parts)
    out = edges.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    return out.unionByName(done.frame()) if done.tables else out


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 20) -> DataFrame:
    """node, rank after a fixed number of rounds; a node without outgoing edges gives its rank to all alike."""
    e = edges.select("src", "dst")
    out = e.groupBy("src").agg(F.count("*").alias("k"))
    e = _cut(e.join(out, "src"))
    nodes = _cut(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct())
    n = nodes.count()
    rank = _cut(nodes.withColumn("rank", F.lit(1.0 / max(1, n))))
    for _ in range(rounds):
        sinks = rank.join(out, F.col("node") == F.col("src"), "left_anti").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("s"))
        got = rank.join(e, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") / F.col("k")).alias("g"))
        new = _cut(nodes.join(got, "node", "left").crossJoin(F.broadcast(sinks)).select("node", ((1 - damping) / n + damping * (F.coalesce("g", F.lit(0.0)) + F.col("s") / n)).alias("rank")))
        uncut(rank)
        rank = new
    return rank
