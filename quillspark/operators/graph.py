"""Graph operators on edge tables: reachability, cycles, components, PageRank, link resolution.

Loops run over frontiers, one join a level, each level stored by a checkpoint so that plans stay short
and lost executors cost one level.  Only counts reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, cap: int | None = None) -> DataFrame:
    """seed, node and depth (least number of edges) of what each seed reaches, itself at depth 0.

    edges: src, dst; seeds: node.  A seed's search ends after the level at which it has cap nodes.
    """
    e = edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct()
    seen = cut(seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("depth")).distinct())
    edge = seen
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = edge.join(e, edge.node == e.src).select("seed", F.col("dst").alias("node")).distinct()
        if cap is not None:
            step = step.join(seen.groupBy("seed").agg(F.count("*").alias("n")).where(F.col("n") < cap), "seed", "left_semi")
        new = cut(step.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if new.isEmpty():
            break
        seen, edge = cut(seen.unionByName(new)), new
    return seen


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def subtree(parents: DataFrame, roots: DataFrame, cap: int | None = None) -> DataFrame:
    """root and node of all descendants of roots, themselves included; parents: src (parent), dst (child)."""
    return reach(parents, roots, cap=cap).select(F.col("seed").alias("root"), "node", "depth")


def would_cycle(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Adds cycle to new edges (src, dst): whether src can already be reached from dst, or is dst."""
    found = reach(edges, new.select(F.col("dst").alias("node")).distinct()).select(F.col("seed").alias("dst"), F.col("node").alias("src"), F.lit(True).alias("cycle"))
    return new.join(found, ["src", "dst"], "left").withColumn("cycle", F.coalesce("cycle", F.lit(False)) | (F.col("src") == F.col("dst")))


def cyclic_nodes(edges: DataFrame) -> DataFrame:
    """node: those on a cycle or between cycles; the rest falls away by leaves, level by level."""
    now = cut(edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct())
    n = now.count()
    while n:
        dst, src = now.select(F.col("dst").alias("src")).distinct(), now.select(F.col("src").alias("dst")).distinct()
        now = cut(now.join(dst, "src", "left_semi").join(src, "dst", "left_semi"))
        left = now.count()
        if left == n:
            break
        n = left
    return now.select(F.col("src").alias("node")).union(now.select("dst")).distinct()


def strong_components(edges: DataFrame) -> DataFrame:
    """node and component (its greatest node) of all nodes that lie on a cycle with another node.

    Nodes that cannot lie on a cycle fall away first.  Then each node takes the greatest node that
    reaches it; those among its like that reach that node back make a component.  What is left goes
    through the same again.  A round shuffles the edges and a number for each node: no closure is formed.
    """
    live, found = cut(edges.where("src <> dst").select("src", "dst").distinct()), None
    while True:
        core = cyclic_nodes(live)
        live = cut(live.join(core.withColumnRenamed("node", "src"), "src", "left_semi").join(core.withColumnRenamed("node", "dst"), "dst", "left_semi"))
        if live.isEmpty():
            return found if found is not None else live.select(F.col("src").alias("node"), F.col("dst").alias("component"))
        colour = cut(live.select(F.col("src").alias("node")).union(live.select("dst")).distinct().withColumn("c", F.col("node")))
        while True:
            came = live.join(colour.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("c").alias("m"))
            new = cut(colour.join(came, "node", "left").select("node", F.greatest("c", F.coalesce("m", "c")).alias("c"), (F.coalesce("m", "c") > F.col("c")).alias("moved")))
            colour = new.drop("moved")
            if new.where("moved").isEmpty():
                break
        own = live.join(colour.select(F.col("node").alias("src"), "c"), "src").join(colour.select(F.col("node").alias("dst"), F.col("c").alias("d")), "dst").where("c = d").select("src", "dst")
        back = cut(own.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        seen = edge = cut(colour.where("node = c"))
        while True:
            edge = cut(back.join(edge.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), "c").distinct().join(seen, "node", "left_anti"))
            if edge.isEmpty():
                break
            seen = cut(seen.union(edge))
        part = seen.select("node", F.col("c").alias("component"))
        found = part if found is None else cut(found.union(part))
        gone = part.select("node")
        live = cut(live.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti"))


def closing_edges(edges: DataFrame) -> DataFrame:
    """src and dst of the edges that lie on a cycle: both ends in one strong component, or one node."""
    c = strong_components(edges)
    e = edges.select("src", "dst").distinct()
    of = lambda name: c.select(F.col("node").alias(name), F.col("component").alias(f"__{name}"))
    inner = e.join(of("src"), "src").join(of("dst"), "dst").where("__src = __dst").select("src", "dst")
    return e.where("src = dst").union(inner).distinct()


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node and component (its least node); edges: src, dst.  Alternating large and small stars."""
    now = cut(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    seen = mark(now)
    while seen[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        now = cut(small.where("u <> v").distinct())
        found = mark(now)
        if found == seen:
            break
        seen = found
    out = now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
    if nodes is None:
        return out
    return nodes.select("node").distinct().join(out, "node", "left").withColumn("component", F.coalesce("component", "node"))


def pagerank(edges: DataFrame, nodes: DataFrame | None = None, damping: float = 0.85, max_iter: int = 50, tol: float = 1e-6) -> DataFrame:
    """node and pagerank, min-max normalised (0.5 if all are equal).

    Repeated edges count each time, nodes without out-edges give to all.  edges: src, dst; nodes adds
    isolated ones.  Edges are grouped with their weights and stored once by source; an iteration
    shuffles one number for each edge's target, after partial sums.
    """
    e = edges.where("dst IS NOT NULL")
    all_nodes = e.select(F.col("src").alias("node")).union(e.select("dst"))
    all_nodes = cut((all_nodes.union(nodes.select("node")) if nodes is not None else all_nodes).distinct())
    n = all_nodes.count()
    if n == 0:
        return all_nodes.withColumn("pagerank", F.lit(0.5))
    weighted = e.groupBy("src", "dst").agg(F.count("*").alias("c"))
    degree = weighted.groupBy("src").agg(F.sum("c").alias("deg"))
    out = cut(weighted.join(degree, "src").select("src", "dst", (F.col("c") / F.col("deg")).alias("w")))
    scores = cut(all_nodes.join(degree.select(F.col("src").alias("node"), F.lit(False).alias("dangling")), "node", "left").select("node", F.coalesce("dangling", F.lit(True)).alias("dangling"), F.lit(1.0 / n).alias("s")))
    for _ in range(max_iter):
        lost = scores.where("dangling").agg(F.coalesce(F.sum("s"), F.lit(0.0))).first()[0]
        got = out.join(scores.select(F.col("node").alias("src"), "s"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("w") * F.col("s")).alias("g"))
        new = scores.join(got, "node", "left").select("node", "dangling", (F.lit((1 - damping) / n + damping * lost / n) + damping * F.coalesce("g", F.lit(0.0))).alias("s"), F.col("s").alias("old"))
        new = cut(new)
        delta = new.agg(F.max(F.abs(F.col("s") - F.col("old")))).first()[0]
        scores = new.drop("old")
        if delta < tol:
            break
    low, high = scores.agg(F.min("s"), F.max("s")).first()
    value = (F.col("s") - low) / (high - low) if high > low else F.lit(0.5)
    return scores.select("node", value.alias("pagerank"))


def fill_median(files: DataFrame, scores: DataFrame, key: str = "file_id") -> DataFrame:
    """files with pagerank; those without score get the median of all scores."""
    median = scores.agg(F.median("pagerank").alias("m"))
    out = files.join(scores.withColumnRenamed("node", key), key, "left").join(F.broadcast(median), how="cross")
    return out.withColumn("pagerank", F.coalesce("pagerank", "m")).drop("m")


def suffixes(path: Column) -> Column:
    """The path itself and each of its ends after a slash."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def resolve_links(links: DataFrame, files: DataFrame) -> DataFrame:
    """Adds target_file_id to links (target_path, link_type): the file whose path is the target, or ends in
    /target or /target.md; the shortest path wins, then the least id.  External links stay unresolved.

    An equi-join on all path ends instead of a LIKE over all pairs.
    """
    ends = files.select("file_id", "path", F.explode(suffixes(F.col("path"))).alias("end"))
    names = ends.select("file_id", "path", F.col("end").alias("target_path")).union(ends.where("end LIKE '%.md' AND end <> path").select("file_id", "path", F.expr("left(end, length(end) - 3)")))
    wanted = links.where("link_type <> 'external'").select("target_path").distinct()
    best = names.join(wanted, "target_path", "left_semi").groupBy("target_path").agg(F.min(F.struct(F.octet_length("path").alias("n"), "file_id")).alias("b"))
    out = links.join(best, "target_path", "left")
    return out.withColumn("target_file_id", F.when(F.col("link_type") != "external", F.col("b.file_id"))).drop("b")


def backlinks(links: DataFrame, targets: DataFrame) -> DataFrame:
    """Links whose target_path is asked for."""
    return links.join(targets.select("target_path").distinct(), "target_path", "left_semi")


def outlinks(links: DataFrame, sources: DataFrame) -> DataFrame:
    """source_file_id and target_file_id of resolved links that are not external, each once."""
    own = links.where("link_type <> 'external' AND target_file_id IS NOT NULL").join(sources.select("source_file_id").distinct(), "source_file_id", "left_semi")
    return own.select("source_file_id", "target_file_id").distinct()


def edges_of(edges: DataFrame, entities: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """id, direction and edge of every edge at either end of the entities (id), with position by created_at and ends."""
    e = edges.where(F.col("edge_kind").isin(kinds)) if kinds else edges
    ids = entities.select("id").distinct()
    out = e.withColumn("id", F.col("from_id")).withColumn("direction", F.lit("out")).unionByName(e.where("from_id <> to_id").withColumn("id", F.col("to_id")).withColumn("direction", F.lit("in")))
    order = [c for c in ("created_at", "from_id", "to_id", "edge_kind", "direction") if c in out.columns]
    return out.join(ids, "id", "left_semi").withColumn("position", F.row_number().over(Window.partitionBy("id").orderBy(*order)))
