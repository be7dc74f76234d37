"""Call-graph operators over ``edges(project, src, dst, edge_ord)``.

Edges with a null end are dropped; repeated edges count once, at their first place; a self-call is an
edge. All operators work within a project and on all projects at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloam.session import materialise


def distinct_edges(edges: DataFrame) -> DataFrame:
    return edges.where("src IS NOT NULL AND dst IS NOT NULL").groupBy("project", "src", "dst").agg(F.min("edge_ord").alias("edge_ord"))


def adjacency(edges: DataFrame, inverse: bool = False) -> DataFrame:
    """``symbol`` and its callees (or callers) as an array, in order of first occurrence. For the edges of
    listed symbols only; of all symbols ``callees`` and ``inverse`` give rows."""
    a, b = ("dst", "src") if inverse else ("src", "dst")
    pairs = F.array_sort(F.collect_list(F.struct("edge_ord", F.col(b).alias("other"))))
    return distinct_edges(edges).groupBy("project", F.col(a).alias("symbol")).agg(F.transform(pairs, lambda x: x["other"]).alias("callers" if inverse else "callees"))


def degrees(edges: DataFrame) -> DataFrame:
    """Out- and in-degree of each symbol, in one aggregation over both ends."""
    e = distinct_edges(edges)
    ends = e.select("project", F.explode(F.array(F.struct(F.col("src").alias("symbol"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("symbol"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    return ends.groupBy("project", F.col("x.symbol").alias("symbol")).agg(F.sum("x.o").alias("out_degree"), F.sum("x.i").alias("in_degree"))


def _arcs(edges: DataFrame, direction: str) -> DataFrame:
    """(project, from, to, way, edge_ord): callees are way 0, callers way 1."""
    if direction not in ("out", "in", "both"):
        raise ValueError("direction is out, in or both")
    e = distinct_edges(edges)
    out = e.select("project", F.col("src").alias("from"), F.col("dst").alias("to"), F.lit(0).alias("way"), "edge_ord")
    back = e.select("project", F.col("dst").alias("from"), F.col("src").alias("to"), F.lit(1).alias("way"), "edge_ord")
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction]


def expand_graph(edges: DataFrame, seeds: DataFrame, hops: int = 2, direction: str = "both", most: int = 60) -> DataFrame:
    """Breadth-first search from ``seeds(project, symbol, ord)``: ``project``, ``symbol``, ``hop``, ``pos``.

    A symbol's place is that of its first discovery: by hop, place of the parent, callees before
    callers, and edge order. Each project keeps its first ``most``; seeds come first and count. A hop
    joins the frontier with the arcs, so hot symbols are handled by the join's skew handling, and a
    symbol's place is a minimum, which is combined before the shuffle. Seeds without edges stay.
    """
    if not 1 <= hops <= 3:
        raise ValueError("hops is 1 to 3")
    arcs = _arcs(edges, direction)
    key = F.struct("parent_ord", "way", "edge_ord")
    rank = Window.partitionBy("project").orderBy("key", "symbol")
    frontier = seeds.where("symbol IS NOT NULL").groupBy("project", "symbol").agg(F.min(F.struct(F.col("ord").cast("long").alias("parent_ord"), F.lit(0).alias("way"), F.lit(0).alias("edge_ord"))).alias("key"))
    frontier = frontier.withColumn("n", F.row_number().over(rank)).where(F.col("n") <= most)
    visited = materialise(frontier.select("project", "symbol", F.lit(0).alias("hop"), F.col("n").alias("pos")))
    level = visited
    for hop in range(1, hops + 1):
        # only symbols found early enough can have a child among the first ``most``
        step = level.join(arcs, (arcs["project"] == level["project"]) & (arcs["from"] == level["symbol"])).select(level["project"], F.col("to").alias("symbol"), F.struct(F.col("pos").alias("parent_ord"), "way", "edge_ord").alias("key"))
        fresh = step.groupBy("project", "symbol").agg(F.min("key").alias("key")).join(visited, ["project", "symbol"], "left_anti")
        count = visited.groupBy("project").agg(F.count("*").alias("before"))
        ranked = fresh.withColumn("n", F.row_number().over(rank)).where(F.col("n") <= most).join(count, "project").withColumn("pos", F.col("n") + F.col("before")).where(F.col("pos") <= most)
        level = materialise(ranked.select("project", "symbol", F.lit(hop).alias("hop"), F.col("pos").cast("int").alias("pos")))
        if level.isEmpty():
            break
        visited = visited.unionByName(level)
    return visited


def retrieval_expand(edges: DataFrame, hits: DataFrame) -> DataFrame:
    """Symbols two calls out of, or one call into, the hits ``(project, symbol)``, without the hits."""
    e = distinct_edges(edges)
    hits = hits.select("project", "symbol").distinct()
    forward = e.select("project", F.col("src").alias("symbol"), F.col("dst").alias("to"))
    backward = e.select("project", F.col("dst").alias("symbol"), F.col("src").alias("to"))
    follow = lambda a, arcs: a.join(arcs, ["project", "symbol"]).select("project", F.col("to").alias("symbol"))
    one = follow(hits, forward).distinct()
    two, back = follow(one, forward), follow(hits, backward)
    return one.unionByName(two).unionByName(back).distinct().join(hits, ["project", "symbol"], "left_anti")


def callees(edges: DataFrame) -> DataFrame:
    """``symbol``, ``callee``, ``edge_ord``: one row for each distinct call, at its first place."""
    return distinct_edges(edges).select("project", F.col("src").alias("symbol"), F.col("dst").alias("callee"), "edge_ord")


def inverse(edges: DataFrame) -> DataFrame:
    """``symbol``, ``caller``, ``edge_ord``: one row for each distinct call. A hub's callers can be a large
    part of all edges, so they are rows, not an array."""
    return distinct_edges(edges).select("project", F.col("dst").alias("symbol"), F.col("src").alias("caller"), "edge_ord")


def with_neighbours(results: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds ``callees`` and ``callers`` to a result list's rows; empty where there are none. Only edges
    of the listed symbols are read into arrays."""
    none = F.array().cast("array<string>")
    listed = results.select("project", "symbol").distinct()

    def of(end: str) -> DataFrame:
        return edges.join(listed.withColumnRenamed("symbol", end), ["project", end], "left_semi")

    joined = results.join(adjacency(of("src")), ["project", "symbol"], "left").join(adjacency(of("dst"), inverse=True), ["project", "symbol"], "left")
    return joined.withColumn("callees", F.coalesce("callees", none)).withColumn("callers", F.coalesce("callers", none))


def symbols_by_file(chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """Per file its symbols in order, with out- and in-degree."""
    symbols = chunks.where("symbol IS NOT NULL").select("project", "file", "symbol").distinct()
    d = symbols.join(degrees(edges), ["project", "symbol"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return d.groupBy("project", "file").agg(F.array_sort(F.collect_list(F.struct("symbol", zero("out_degree"), zero("in_degree")))).alias("symbols"))
