"""Task graph: readiness, blocking, orders, counts, dependencies, sagas.

tasks: task_id, status, priority, task_type, due_ts, defer_until, blocked_reason, updated_at, space;
edges: from_id, to_id, edge_kind (blocks: from depends on to; parent_of: from is to's parent);
externals: task_id, blocking, resolved_at.  now is epoch seconds.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .graph import reach

TERMINAL = ("done", "cancelled")
#: Ids with a common prefix that are sorted as one group.
GROUP = 1_000_000
#: Allowed changes of a saga's status: (from, to).
TRANSITIONS = (("planning", "open"), ("open", "closed"), ("planning", "cancelled"), ("open", "cancelled"), ("closed", "open"), ("cancelled", "open"))


def unmet(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """task_id and n_unmet: dependencies that are not terminal or do not exist."""
    deps = edges.where("edge_kind = 'blocks'").select(F.col("from_id").alias("task_id"), F.col("to_id").alias("dep"))
    done = tasks.where(F.col("status").isin(*TERMINAL)).select(F.col("task_id").alias("dep"))
    return deps.join(done, "dep", "left_anti").groupBy("task_id").agg(F.count("*").alias("n_unmet"))


def flags(tasks: DataFrame, edges: DataFrame, externals: DataFrame, now: int) -> DataFrame:
    """tasks with dep_blocked, ext_blocked, deferred, held and ancestor_blocked."""
    ext = externals.where("blocking = 1 AND resolved_at IS NULL").select("task_id").distinct().withColumn("ext_blocked", F.lit(True))
    out = tasks.join(unmet(tasks, edges).select("task_id", F.lit(True).alias("dep_blocked")), "task_id", "left").join(ext, "task_id", "left")
    out = out.na.fill(False, ["dep_blocked", "ext_blocked"]).withColumn("deferred", F.coalesce(F.col("defer_until") > now, F.lit(False))).withColumn("held", F.col("blocked_reason").isNotNull())
    own = F.col("held") | F.col("deferred") | F.col("dep_blocked") | F.col("ext_blocked")
    stuck = out.where(own & ~F.col("status").isin(*TERMINAL)).select(F.col("task_id").alias("node"))
    parents = edges.where("edge_kind = 'parent_of'").select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"))
    below = under(parents, stuck).withColumn("ancestor_blocked", F.lit(True))
    return out.join(below, "task_id", "left").na.fill(False, ["ancestor_blocked"])


def under(parents: DataFrame, tops: DataFrame) -> DataFrame:
    """task_id of all descendants of tops, the tops left out unless below another; tops need no row each.

    One search for all tops together: a node is visited once, whichever top it hangs under.
    """
    one = tops.select("node").distinct()
    kids = one.join(parents, one.node == parents.src).select(F.col("dst").alias("node")).distinct()
    seen = edge = cut(kids)
    while not edge.isEmpty():
        edge = cut(edge.join(parents, edge.node == parents.src).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti"))
        seen = cut(seen.union(edge))
    return seen.select(F.col("node").alias("task_id"))


def _blocked() -> Column:
    return F.col("held") | F.col("deferred") | F.col("dep_blocked") | F.col("ext_blocked") | F.col("ancestor_blocked")


def ready(flagged: DataFrame, actionable: bool = False) -> DataFrame:
    """Open tasks that nothing blocks; actionable leaves out epics."""
    out = flagged.where(F.col("status").isin("open", "in_progress") & ~_blocked())
    return out.where("task_type <> 'epic'") if actionable else out


def blocked(flagged: DataFrame) -> DataFrame:
    """Tasks in work or blocked for which there is a reason to wait."""
    return flagged.where(F.col("status").isin("open", "in_progress", "blocked") & _blocked())


def list_order() -> list[Column]:
    """Priority, epics first, due (none last), latest change, id."""
    return [F.asc("priority"), F.when(F.col("task_type") == "epic", 0).otherwise(1).asc(), F.asc_nulls_last("due_ts"), F.desc("updated_at"), F.asc("task_id")]


def next_order() -> list[Column]:
    """In progress first, then priority, due (none last), latest change, id."""
    return [F.when(F.col("status") == "in_progress", 0).otherwise(1).asc(), F.asc("priority"), F.asc_nulls_last("due_ts"), F.desc("updated_at"), F.asc("task_id")]


def top(tasks: DataFrame, order: list[Column], k: int, by: str = "space") -> DataFrame:
    """The first k tasks of each space, with their position."""
    return tasks.withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("position") <= k)


def with_status(tasks: DataFrame, *status: str) -> DataFrame:
    return tasks.where(F.col("status").isin(*status))


def filtered(tasks: DataFrame, labels: DataFrame | None = None, priority: int | None = None, task_type: str | None = None, assignee: str | None = None, label: str | None = None, ids: DataFrame | None = None) -> DataFrame:
    """All given filters together; assignees compare without case of A-Z, ids come from a text search."""
    out = tasks
    if priority is not None:
        out = out.where(F.col("priority") == priority)
    if task_type is not None:
        out = out.where(F.col("task_type") == task_type)
    if assignee is not None:
        low = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        out = out.where(low(F.col("assignee")) == low(F.lit(assignee)))
    if label is not None and labels is not None:
        out = out.join(labels.where(F.col("label") == label).select("task_id").distinct(), "task_id", "left_semi")
    return out.join(ids.select("task_id"), "task_id", "left_semi") if ids is not None else out


def newly_unblocked(flagged: DataFrame, edges: DataFrame, completed: DataFrame) -> DataFrame:
    """completed_id and task_id: dependents of completed tasks that nothing holds any more (deferral aside)."""
    deps = edges.where("edge_kind = 'blocks'").select(F.col("from_id").alias("task_id"), F.col("to_id").alias("completed_id")).distinct()
    asked = deps.join(completed.select(F.col("task_id").alias("completed_id")).distinct(), "completed_id", "left_semi")
    held = F.col("held") | F.col("dep_blocked") | F.col("ext_blocked") | F.col("ancestor_blocked")
    free = flagged.where(F.col("status").isin("open", "in_progress") & ~held).select("task_id")
    return asked.join(free, "task_id", "left_semi").select("completed_id", "task_id")


def dependency_summary(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """task_id, total, done and blocking (ids of unmet dependencies, sorted) of tasks with dependencies."""
    deps = edges.where("edge_kind = 'blocks'").select(F.col("from_id").alias("task_id"), F.col("to_id").alias("dep")).distinct()
    state = deps.join(tasks.select(F.col("task_id").alias("dep"), "status"), "dep", "left")
    met = F.coalesce(F.col("status").isin(*TERMINAL), F.lit(False))
    return state.groupBy("task_id").agg(F.count("*").alias("total"), F.count_if(met).alias("done"), F.sort_array(F.collect_list(F.when(~met, F.col("dep")))).alias("blocking"))


def children(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """parent_id and its children by child_seq (none last), priority, creation, id, with position."""
    kids = edges.where("edge_kind = 'parent_of'").select(F.col("from_id").alias("parent_id"), F.col("to_id").alias("task_id"))
    order = [F.asc_nulls_last("child_seq"), F.asc("priority"), F.asc("created_at"), F.asc("task_id")]
    return kids.join(tasks, "task_id").withColumn("position", F.row_number().over(Window.partitionBy("parent_id").orderBy(*order)))


def dependents(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """blocker and task_id of open tasks that wait for it."""
    deps = edges.where("edge_kind = 'blocks'").select(F.col("to_id").alias("blocker"), F.col("from_id").alias("task_id")).distinct()
    return deps.join(tasks.where(~F.col("status").isin(*TERMINAL)), "task_id")


def next_child_seq(edges: DataFrame, tasks: DataFrame, parents: DataFrame) -> DataFrame:
    """parent_id and next_seq: one more than its children's greatest, 1 for none."""
    kids = edges.where("edge_kind = 'parent_of'").select(F.col("from_id").alias("parent_id"), F.col("to_id").alias("task_id")).join(tasks.select("task_id", "child_seq"), "task_id")
    most = kids.groupBy("parent_id").agg(F.max("child_seq").alias("m"))
    return parents.select("parent_id").distinct().join(most, "parent_id", "left").select("parent_id", (F.coalesce("m", F.lit(0)) + 1).alias("next_seq"))


def status_counts(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("status").agg(F.count("*").alias("n"))


def ready_blocked_counts(flagged: DataFrame) -> DataFrame:
    """space, ready and blocked in one pass."""
    r = F.col("status").isin("open", "in_progress") & ~_blocked()
    b = F.col("status").isin("open", "in_progress", "blocked") & _blocked()
    return flagged.groupBy("space").agg(F.count_if(r).alias("ready"), F.count_if(b).alias("blocked"))


def label_summary(labels: DataFrame) -> DataFrame:
    """label, n and task_ids (sorted)."""
    return labels.distinct().groupBy("label").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("task_id")).alias("task_ids"))


def label_counts(labels: DataFrame) -> DataFrame:
    """label and n, without the tasks: bounded whatever the label's size."""
    return labels.distinct().groupBy("label").agg(F.count("*").alias("n"))


def saga_stats(members: DataFrame, tasks: DataFrame) -> DataFrame:
    """Counts by status of each saga's tasks, orphans, and done in percent of those not cancelled (null for none)."""
    m = members.select("saga_id", "task_id").distinct().join(tasks.select("task_id", "status"), "task_id", "left")
    known = F.col("status").isNotNull()
    n = {s: F.count_if(F.col("status") == s).alias(s) for s in ("open", "in_progress", "blocked", "done", "cancelled")}
    out = m.groupBy("saga_id").agg(F.count_if(known).alias("total"), *n.values(), F.count_if(~known).alias("orphan"))
    left = F.col("total") - F.col("cancelled")
    return out.withColumn("completion_pct", F.when(left > 0, F.round(F.col("done") / left * 100, 6)))


def saga_labels(members: DataFrame, tasks: DataFrame, labels: DataFrame) -> DataFrame:
    """saga_id, label and n."""
    return members.select("saga_id", "task_id").distinct().join(tasks.select("task_id"), "task_id", "left_semi").join(labels.distinct(), "task_id").groupBy("saga_id", "label").agg(F.count("*").alias("n"))


def saga_members(members: DataFrame, tasks: DataFrame) -> DataFrame:
    """Members that exist, with position by added_at, task_id."""
    w = Window.partitionBy("saga_id").orderBy("added_at", "task_id")
    return members.join(tasks.drop("added_at"), "task_id").withColumn("position", F.row_number().over(w))


def saga_spaces(members: DataFrame, tasks: DataFrame) -> DataFrame:
    """saga_id and space, each pair once."""
    return members.join(tasks.select("task_id", "space"), "task_id").select("saga_id", "space").distinct()


def saga_list(sagas: DataFrame, members: DataFrame, tasks: DataFrame, exclude: list[str], space: str | None = None) -> DataFrame:
    """Sagas without the excluded statuses; with space, those that have a task in it."""
    out = sagas.where(~F.col("status").isin(exclude)) if exclude else sagas
    if space is not None:
        out = out.join(members.join(tasks.where(F.col("space") == space).select("task_id"), "task_id", "left_semi").select("saga_id").distinct(), "saga_id", "left_semi")
    return out


def frontier(sagas: DataFrame, members: DataFrame, flagged: DataFrame) -> DataFrame:
    """saga_id and its ready tasks with position; open sagas only."""
    live = sagas.where("status = 'open'").select("saga_id")
    own = members.select("saga_id", "task_id").distinct().join(live, "saga_id", "left_semi")
    return own.join(ready(flagged, actionable=True), "task_id").withColumn("position", F.row_number().over(Window.partitionBy("saga_id").orderBy(*next_order())))


def cascade(members: DataFrame, tasks: DataFrame, target: str) -> DataFrame:
    """saga_id, task_id and outcome of closing (done) or cancelling all members."""
    if target not in TERMINAL:
        raise ValueError(f"no terminal status: {target}")
    m = members.select("saga_id", "task_id").distinct().join(tasks.select("task_id", "status", "space"), "task_id", "left")
    orphan = F.col("status").isNull() | F.col("space").isNull() | (F.col("space") == "")
    outcome = F.when(F.col("status").isin(*TERMINAL), "skipped").when(orphan, "failed").otherwise("closed" if target == "done" else "cancelled")
    return m.select("saga_id", "task_id", outcome.alias("outcome"))


def valid_transition(now: Column, to: Column) -> Column:
    out = F.lit(False)
    for a, b in TRANSITIONS:
        out = out | ((now == a) & (to == b))
    return F.coalesce(out, F.lit(False))


def add_with_subtree(new: DataFrame, edges: DataFrame, members: DataFrame, cap: int = 2000) -> DataFrame:
    """saga_id and task_id to add: tasks with their descendants, less present members.

    Raises if a saga's tasks expand to more than cap.
    """
    parents = edges.where("edge_kind = 'parent_of'").select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"))
    tree = reach(parents, new.select(F.col("task_id").alias("node")).distinct(), cap=cap + 1).select(F.col("seed").alias("task_id"), "node")
    out = new.select("saga_id", "task_id").join(tree, "task_id").select("saga_id", F.col("node").alias("task_id")).distinct()
    if not out.groupBy("saga_id").count().where(F.col("count") > cap).isEmpty():
        raise ValueError(f"a saga's tasks expand to more than {cap}")
    return out.join(members.select("saga_id", "task_id"), ["saga_id", "task_id"], "left_anti")


def _telling(a: Column, b: Column, least: int, longest: int) -> Column:
    """The least length, from least on, at which the beginnings of a and b differ; least without b, and over longest where none does."""
    out, near = F.when(b.isNull(), least), min(longest, least + 64)
    for n in range(least, near + 1):
        out = out.when(F.left(a, F.lit(n)) != F.left(b, F.lit(n)), n)
    if near == longest or near < least:
        return out.otherwise(longest + 1)
    further = F.filter(F.sequence(F.lit(near + 1), F.lit(longest)), lambda n: F.left(a, n) != F.left(b, n))
    return out.otherwise(F.coalesce(F.try_element_at(further, F.lit(1)), F.lit(longest + 1)))


def compact_ids(ids: DataFrame, least: int = 8, most: int = GROUP) -> DataFrame:
    """task_id and short_id: the shortest prefix of at least least characters that no other id has, else all.

    Ids are shuffled once, into groups by a common prefix of about most ids at most, and sorted within them:
    of the other ids of its group an id has most in common with its neighbours, and those of other groups
    differ within the group's prefix.  A prefix of more ids gives groups by one character more.
    """
    t = ids.select(F.col("task_id").cast("string").alias("task_id"))
    low, high, longest = t.agg(F.min("task_id"), F.max("task_id"), F.max(F.length("task_id"))).first()
    if low == high:
        return t.distinct().select("task_id", F.left("task_id", F.lit(least)).alias("short_id"))
    depth = len(os.path.commonprefix([low, high])) + 1  # up to which all ids are alike
    grouped = t.withColumn("group", F.left("task_id", F.lit(depth)))
    while True:
        ripe = grouped.where(F.length("group") == depth).groupBy("group").agg(F.approx_count_distinct("task_id").alias("n"))
        large = cut(ripe.where(F.col("n") > most).select("group", F.lit(True).alias("large")))  # at most a row for each most ids
        if large.isEmpty():
            break
        depth += 1
        grouped = grouped.join(F.broadcast(large), "group", "left").select("task_id", F.when(F.col("large"), F.left("task_id", F.lit(depth))).otherwise(F.col("group")).alias("group"))
    by = Window.partitionBy("group").orderBy("task_id")
    one = grouped.repartition("group").dropDuplicates(["group", "task_id"]).withColumns({"before": F.lag("task_id").over(by), "after": F.lead("task_id").over(by)})
    own = F.col("task_id")
    n = F.greatest(F.length("group"), _telling(own, F.col("before"), least, longest), _telling(own, F.col("after"), least, longest))
    return one.select("task_id", F.left("task_id", n).alias("short_id"))


def as_markdown(tasks: DataFrame, edges: DataFrame, labels: DataFrame) -> DataFrame:
    """task_id and markdown: front matter, title, description, what it blocks and what blocks it (sorted)."""
    deps = edges.where("edge_kind = 'blocks'").select(F.col("from_id").alias("task_id"), F.col("to_id").alias("dep")).distinct()
    listed = lambda df, by, c, name: df.groupBy(by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(c)), lambda x: x.cast("string")), ", ").alias(name))
    t = tasks.join(listed(labels.distinct(), "task_id", "label", "__tags"), "task_id", "left")
    t = t.join(listed(deps, "task_id", "dep", "__by"), "task_id", "left").join(listed(deps, "dep", "task_id", "__blocks").withColumnRenamed("dep", "task_id"), "task_id", "left")
    day = lambda c: F.date_add(F.to_date(F.lit("1970-01-01")), F.floor(F.col(c) / 86400).cast("int")).cast("string")
    line = lambda before, c, after="\n": F.coalesce(F.concat(F.lit(before), c, F.lit(after)), F.lit(""))
    quoted = F.replace(F.replace(F.col("title"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    parts = [line("---\nid: ", F.col("task_id").cast("string")), line('title: "', quoted, '"\n'), line("status: ", F.col("status")), line("priority: ", F.col("priority").cast("string")), line("type: ", F.col("task_type")), line("created: ", day("created_at")), line("updated: ", day("updated_at")), line("assignee: ", F.col("assignee")), line("tags: [", F.col("__tags"), "]\n"), line("---\n\n# ", F.col("title"))]
    parts.append(F.when(F.coalesce("description", F.lit("")) != "", line("\n## Description\n\n", F.col("description"))).otherwise(""))
    parts.append(F.when(F.col("__by").isNotNull() | F.col("__blocks").isNotNull(), F.concat(F.lit("\n## Dependencies\n\n"), line("- Blocks: ", F.col("__blocks")), line("- Blocked by: ", F.col("__by")))).otherwise(""))
    return t.select("task_id", F.concat(*parts).alias("markdown"))
