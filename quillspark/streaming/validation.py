"""Validation of event logs: each event is judged by the state that the events before it leave.

An event that is rejected changes nothing, so that whether it is valid may hang on earlier rejections.
Tasks and edges need different means:

*Tasks.*  A created event counts if its task does not exist yet and its parent, if it has one, does.
The time from which a task exists is the least fixed point over its created events, found by one join
of the creations with parents a round, as many rounds as parents are nested at most.

*Dependencies.*  An edge is rejected if the edges alive when it comes lead back from its end to its
start.  An edge can only be part of a cycle within a strong component of all edges that may be alive
in a stretch of time.  So, for the stretch of the whole log: components are found as a Spark job; edges
outside of them are valid; a component of up to ``limit`` new edges is replayed in one task; a larger one
is cut into stretches of time, which are decided one after the other, as each stands on what the earlier
ones leave: the pairs of tasks that are linked when it begins, each once, however often they were added.
Where more than ``limit`` pairs are linked in a component, stretches are decided like the whole log, as
edges between components fall away again, or halved; one of a single event is a search by joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import reach, strong_components
from ..session import cut

#: Edges of a component that one task replays.
LIMIT = 100_000
_REF = "$.{}"


def numbered(events: DataFrame, order: tuple[str, ...] = ("timestamp", "event_id")) -> DataFrame:
    """events with seq, a number that rises in their order."""
    return cut(events.orderBy(*order).withColumn("seq", F.monotonically_increasing_id()))


def existing_since(created: DataFrame) -> DataFrame:
    """task_id and since: the seq of the created event that makes a task exist; created: task_id, parent (or null), seq."""
    nested = created.where("parent IS NOT NULL AND parent <> task_id")
    now = cut(created.where("parent IS NULL").groupBy("task_id").agg(F.min("seq").alias("since")))
    while True:
        came = nested.join(now.select(F.col("task_id").alias("parent"), F.col("since").alias("s")), "parent").where("s < seq").select("task_id", F.col("seq").alias("since"))
        # what is earlier than before, or new
        better = came.groupBy("task_id").agg(F.min("since").alias("n")).join(now, "task_id", "left").where("since IS NULL OR n < since").select("task_id", F.col("n").alias("since"))
        better = cut(better)
        if better.isEmpty():
            return now
        now = cut(now.join(better.select("task_id"), "task_id", "left_anti").union(better))


def _replay(rows):
    """Rows of one component in a pandas frame: event_id, src, dst, seq, until (-1: none), new."""
    import heapq

    rows = rows.sort_values(["new", "seq"])
    out: dict[str, dict[str, int]] = {}
    ends: list[tuple[int, str, str]] = []
    cycle = []
    for src, dst, seq, until, new in zip(rows["src"], rows["dst"], rows["seq"], rows["until"], rows["new"], strict=True):
        closed = False
        if new:
            while ends and ends[0][0] < seq:
                _, a, b = heapq.heappop(ends)
                out[a][b] -= 1
                if not out[a][b]:
                    del out[a][b]
            seen, todo = {dst}, [] if dst in out.get(src, ()) else [dst]  # what is linked already closes nothing
            while todo and not closed:
                after = out.get(todo.pop(), {})
                closed = src in after
                new_ones = after.keys() - seen
                seen |= new_ones
                todo.extend(new_ones)
        if not closed:
            at = out.setdefault(src, {})
            at[dst] = at.get(dst, 0) + 1
            if until >= 0:
                heapq.heappush(ends, (until, src, dst))
        cycle.append(closed)
    rows = rows.assign(cycle=cycle)
    return rows[rows["new"]][["event_id", "seq", "cycle"]]


def _alive(edges: DataFrame, at: int) -> DataFrame:
    """Edges that are alive after a seq, those that were added repeatedly once: all of a pair end together."""
    alive = edges.where((F.col("until") < 0) | (F.col("until") > at))
    return alive.groupBy(*[c for c in edges.columns if c not in ("event_id", "seq")]).agg(F.min("event_id").alias("event_id"), F.min("seq").alias("seq")).select(*edges.columns)


def _replayed(rows: DataFrame) -> DataFrame:
    """seq and cycle of the new edges of components: component, event_id, src, dst, seq, until, new."""
    kind = dict(rows.dtypes)["event_id"]
    columns = ("component", "event_id", "src", "dst", "seq", "until", "new")
    return rows.select(*columns).groupBy("component").applyInPandas(_replay, f"event_id {kind}, seq bigint, cycle boolean").select("seq", "cycle")


def _decide(base: DataFrame, block: DataFrame, limit: int) -> DataFrame:
    """seq and cycle of a block of edges, over valid edges before it; both: event_id, src, dst, seq, until."""
    first = block.agg(F.min("seq")).first()[0]
    if first is None:
        return block.select("seq", F.lit(False).alias("cycle"))
    base = _alive(base, first)
    rows = base.withColumn("new", F.lit(False)).union(block.withColumn("new", F.lit(True)))
    c = strong_components(rows)
    of = lambda n: c.select(F.col("node").alias(n), F.col("component").alias(f"__{n}"))
    inner = cut(rows.join(of("src"), "src").join(of("dst"), "dst").where("__src = __dst").drop("__dst").withColumnRenamed("__src", "component"))
    clear = block.join(inner.where("new").select("seq"), "seq", "left_anti").select("seq", F.lit(False).alias("cycle"))
    size = cut(inner.groupBy("component").agg(F.count("*").alias("n"), F.count_if("new").alias("n_new")))
    few = (F.col("n") - F.col("n_new") <= limit) & (F.col("n_new") <= limit)
    small = inner.join(size.where(few & (F.col("n_new") > 0)).select("component"), "component", "left_semi")
    out = clear.union(_replayed(small))
    large = size.where(~few & (F.col("n_new") > 0)).select("component")
    if large.isEmpty():
        return out
    rest = inner.join(large, "component", "left_semi")
    own = ("event_id", "src", "dst", "seq", "until", "component")
    old, new = cut(rest.where("NOT new").select(*own)), cut(rest.where("new").select(*own))
    n, last = new.agg(F.count("*"), F.max("seq")).first()
    if n == 1:
        one = new.first()
        there = reach(old, new.select(F.col("dst").alias("node"))).where(F.col("node") == one["src"])
        return out.union(new.select("seq", F.lit(not there.isEmpty()).alias("cycle")))
    pieces = max(2, -(-n // limit))
    cuts = new.agg(F.percentile_approx("seq", [i / pieces for i in range(1, pieces)], 100 * pieces + 10_000)).first()[0]
    since = None
    for till in [*sorted({min(c, last - 1) for c in cuts}), last]:
        piece = new.where(F.col("seq") <= till) if since is None else new.where((F.col("seq") > since) & (F.col("seq") <= till))
        linked = old.groupBy("component").count().agg(F.max("count")).first()[0] or 0
        if n > limit >= linked:  # a stretch of about limit events
            found = _replayed(old.withColumn("new", F.lit(False)).union(piece.withColumn("new", F.lit(True))))
        else:
            found = _decide(old.drop("component"), piece.drop("component"), limit)
        done = cut(found)
        out, since = out.union(done), till
        if till < last:
            old = cut(_alive(old.union(piece.join(done.where("NOT cycle").select("seq"), "seq", "left_semi").select(*own)), till))
    return out


def closing_events(added: DataFrame, removed: DataFrame, limit: int = LIMIT) -> DataFrame:
    """seq and cycle of added edges; added: event_id, src, dst (another node), seq; removed: src, dst, seq."""
    both = added.select("event_id", "src", "dst", "seq", F.lit(False).alias("end")).union(removed.select(F.lit(None).cast(added.schema["event_id"].dataType), "src", "dst", "seq", F.lit(True)))
    later = Window.partitionBy("src", "dst").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    until = F.coalesce(F.min(F.when(F.col("end"), F.col("seq"))).over(later), F.lit(-1))
    lives = cut(both.withColumn("until", until).where("NOT end").drop("end"))
    return _decide(lives.limit(0), lives, limit)


def _referenced(events: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """event_id, task_id, event_type, target, seq and problem (null: none but perhaps a cycle) of all events."""
    get = lambda n: F.get_json_object("payload", _REF.format(n))
    e = events.withColumn("task_id", F.col("task_id").cast("string")).select("event_id", "task_id", "event_type", "payload", *[c for c in order if c != "event_id"]).dropDuplicates(["event_id"])
    kind = F.col("event_type")
    parent = F.when(kind.isin("task_created", "parent_set"), get("parent_task_id"))
    e = numbered(e.withColumns({"parent": parent, "target": F.when(kind.isin("dependency_added", "dependency_removed"), get("depends_on_task_id"))}), order)
    since = existing_since(e.where(kind == "task_created").select("task_id", "parent", "seq"))
    known = lambda of, name: since.select(F.col("task_id").alias(of), F.col("since").alias(name))
    there = lambda name: F.coalesce(F.col(name) < F.col("seq"), F.lit(False))
    s = e.join(known("task_id", "own"), "task_id", "left").join(known("parent", "up"), "parent", "left").join(known("target", "to"), "target", "left")
    lone = F.col("parent") == F.col("task_id")
    created = F.when(F.col("own") == F.col("seq"), None).when(there("own"), "task exists").when(lone, "itself").otherwise("unknown parent")
    depends = F.when(~there("to"), "unknown dependency").when(F.col("target") == F.col("task_id"), "itself")
    moved = F.when(F.col("parent").isNull(), None).when(lone, "itself").when(~there("up"), "unknown parent")
    problem = F.when(kind == "task_created", created).when(~there("own"), "unknown task").when(kind == "dependency_added", depends).when(kind == "parent_set", moved)
    return s.withColumn("problem", problem.cast("string")).select("event_id", "task_id", "event_type", "target", "seq", "problem")


def unknown_references(events: DataFrame, order: tuple[str, ...] = ("timestamp", "event_id")) -> DataFrame:
    """``invalid_events`` but for dependencies that close a cycle, which need no search then: whether a task exists hangs on no dependency."""
    return _referenced(events, order).where("problem IS NOT NULL").select("event_id", "task_id", "problem")


def invalid_events(events: DataFrame, order: tuple[str, ...] = ("timestamp", "event_id"), limit: int = LIMIT) -> DataFrame:
    """event_id, task_id and problem of the events of a log that are rejected, by the first rule that they break.

    task_created: 'task exists', 'itself' (as parent), 'unknown parent'.  All others: 'unknown task'; then
    dependency_added: 'unknown dependency', 'itself', 'cycle'; parent_set: 'itself', 'unknown parent'.
    events: event_id, task_id, event_type, payload (JSON) and the columns of order; repeated rows of one
    event_id count once.
    """
    s = cut(_referenced(events, order))
    edge = lambda t: s.where((F.col("event_type") == t) & F.col("problem").isNull()).select("event_id", F.col("task_id").alias("src"), F.col("target").alias("dst"), "seq")
    closing = closing_events(edge("dependency_added"), edge("dependency_removed").select("src", "dst", "seq"), limit).where("cycle").select("seq")
    circle = s.join(closing, "seq", "left_semi").withColumn("problem", F.lit("cycle"))
    return s.where("problem IS NOT NULL").unionByName(circle).select("event_id", "task_id", "problem")
