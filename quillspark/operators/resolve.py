"""Ids from what users type, in bulk: whole ids, prefixes of ids, short hashes, and children by number.

An input is tried as

1. a task's id;
2. ``PARENT.N``: the N-th child of what PARENT resolves to, however deep;
3. a short hash (small hexadecimal, with or without a project's prefix of up to four characters and a
   dash), whole or a prefix;
4. a prefix of ids, in capitals, the project's prefix put before it if it has none.

The first of these that finds tasks decides: one task resolves the input, several make it ambiguous.

Prefixes are an equi-join: each id gives its prefixes of the lengths that inputs have (their number is
that of lengths, not of inputs), those that nobody asks for fall away, and the others are counted before
they meet the inputs, so that a prefix of all ids is one row.  Inputs with dots resolve after their
parents, a round for each dot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Least characters of a short hash and of a prefix of ids, and most characters of a project's prefix.
LEAST_HASH, LEAST_PREFIX, PROJECT = 3, 4, 4


def _counts(ids: DataFrame, asked: DataFrame) -> DataFrame:
    """prefix, scope (null: all spaces), n, least, exact: how many ids (id, name, space) have an asked prefix (prefix) of their name, and are it."""
    wanted = asked.where("prefix IS NOT NULL").select("prefix").distinct()
    lengths = [r[0] for r in wanted.select(F.length("prefix")).distinct().collect()]  # as many as ids are long
    if not lengths:
        return ids.limit(0).select(F.col("name").alias("prefix"), F.col("space").alias("scope"), F.lit(0).cast("long").alias("n"), F.col("id").alias("least"), F.lit(0).cast("long").alias("n_exact"), F.col("id").alias("exact"))
    each = ids.select("id", "name", "space", F.explode(F.array(*map(F.lit, lengths))).alias("l")).where("l <= length(name)")
    found = each.withColumn("prefix", F.left("name", F.col("l"))).join(wanted, "prefix", "left_semi").withColumn("own", F.when(F.col("name") == F.col("prefix"), F.col("id")))
    measures = [F.count("*").alias("n"), F.min("id").alias("least"), F.count("own").alias("n_exact"), F.min("own").alias("exact")]
    scoped = found.where("space IS NOT NULL").groupBy("prefix", F.col("space").alias("scope")).agg(*measures)
    return cut(scoped.union(scoped_all(found, measures)))


def scoped_all(found: DataFrame, measures: list[Column]) -> DataFrame:
    """The same over all spaces."""
    return found.groupBy("prefix").agg(*measures).select("prefix", F.lit(None).cast(dict(found.dtypes)["space"]).alias("scope"), "n", "least", "n_exact", "exact")


def resolve(inputs: DataFrame, tasks: DataFrame, edges: DataFrame, project: str = "BRN") -> DataFrame:
    """input, space, task_id (where it resolves), verdict (exact, child, unique, ambiguous, none, short) and n, the tasks that matched.

    inputs: input, space (null: all spaces); tasks: task_id, display_id (short hash), space, child_seq;
    edges: from_id (parent), to_id, edge_kind.
    """
    base = inputs.select(F.col("input").alias("top"), "input", "space").distinct()
    dotted = r"^(.*)\.(\d+)$"
    every, left = base.select("input", "space"), base.select("input", "space")
    while True:  # the parents of dotted inputs are inputs too
        left = cut(left.where(F.col("input").rlike(dotted)).select(F.regexp_extract("input", dotted, 1).alias("input"), "space").distinct())
        if left.isEmpty():
            break
        every = every.union(left)
    dash = F.locate("-", "input")
    bare = F.when(dash.between(2, PROJECT + 1), F.expr("substring(input, locate('-', input) + 1)")).otherwise(F.col("input"))
    hashed = F.when(bare.rlike(f"^[0-9a-f]{{{LEAST_HASH},}}$"), bare)
    big = F.translate("input", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    short = F.when(dash.between(2, PROJECT + 1), F.length(bare)).when(dash == 0, F.length("input")).otherwise(LEAST_PREFIX) < LEAST_PREFIX
    prefix = F.when(~short, F.when(dash > 0, big).otherwise(F.concat(F.lit(f"{project}-"), big)))
    rows = cut(every.distinct().withColumns({"hashed": hashed, "prefix": prefix, "short": short, "dots": F.length("input") - F.length(F.replace(F.col("input"), F.lit("."), F.lit("")))}))
    by_hash = _counts(tasks.where("display_id IS NOT NULL").select(F.col("task_id").alias("id"), F.col("display_id").alias("name"), "space"), rows.select(F.col("hashed").alias("prefix")))
    by_id = _counts(tasks.select(F.col("task_id").alias("id"), F.col("task_id").alias("name"), "space"), rows.select("prefix"))
    whole = tasks.select(F.col("task_id").alias("input"), F.lit(True).alias("is_id"))
    name = lambda c, p: c.select(F.col("prefix").alias(f"{p}_prefix"), F.col("scope").alias(f"{p}_scope"), *[F.col(x).alias(f"{p}_{x}") for x in ("n", "least", "n_exact", "exact")])
    h, i = name(by_hash, "h"), name(by_id, "i")
    m = rows.join(whole, "input", "left").join(h, (F.col("hashed") == F.col("h_prefix")) & F.col("space").eqNullSafe(F.col("h_scope")), "left").join(i, (F.col("prefix") == F.col("i_prefix")) & F.col("space").eqNullSafe(F.col("i_scope")), "left")
    steps = [("h_n_exact", "h_exact"), ("h_n", "h_least"), ("i_n", "i_least")]
    pick = lambda of: F.coalesce(*[F.when(F.col(n) > 0, of(n, x)) for n, x in steps])
    n = F.coalesce(pick(lambda n, x: F.col(n)), F.lit(0)).cast("long")
    m = cut(m.select("input", "space", "dots", "short", F.coalesce("is_id", F.lit(False)).alias("is_id"), n.alias("n"), F.when(n == 1, pick(lambda n, x: F.col(x))).alias("found")))
    verdict = F.when(F.col("is_id"), "exact").when(F.col("n") == 1, "unique").when(F.col("n") > 1, "ambiguous").when(F.col("short"), "short").otherwise("none")
    plain = m.select("input", "space", "dots", F.when(F.col("is_id"), F.col("input")).otherwise(F.col("found")).alias("task_id"), verdict.alias("verdict"), F.when(F.col("is_id"), F.lit(1)).otherwise(F.col("n")).cast("long").alias("n"))
    children = edges.where("edge_kind = 'parent_of'").select(F.col("from_id").alias("parent"), F.col("to_id").alias("task_id")).join(tasks.select("task_id", "child_seq"), "task_id").groupBy("parent", "child_seq").agg(F.min("task_id").alias("child"))
    deepest = rows.agg(F.max("dots")).first()[0] or 0
    done = cut(plain.where("dots = 0"))
    for depth in range(1, deepest + 1):
        now = plain.where(F.col("dots") == depth).withColumns({"up": F.regexp_extract("input", dotted, 1), "seq": F.try_to_number(F.regexp_extract("input", dotted, 2), F.lit("9" * 18)).cast("bigint")})
        parent = done.select(F.col("input").alias("up"), F.col("space").alias("s"), F.col("task_id").alias("parent"))
        got = now.join(parent, (now["up"] == parent["up"]) & now["space"].eqNullSafe(parent["s"]), "left").drop(parent["up"])
        got = got.join(children, (got["parent"] == children["parent"]) & (got["seq"] == children["child_seq"]), "left")
        child = F.col("child").isNotNull() & (F.col("verdict") != "exact")
        got = got.select("input", "space", "dots", F.when(child, F.col("child")).otherwise(F.col("task_id")).alias("task_id"), F.when(child, "child").otherwise(F.col("verdict")).alias("verdict"), F.when(child, 1).otherwise(F.col("n")).cast("long").alias("n"))
        done = cut(done.union(got))
    return base.select("input", "space").distinct().join(done.drop("dots").withColumnRenamed("space", "s").withColumnRenamed("input", "i"), (F.col("i") == F.col("input")) & F.col("s").eqNullSafe(F.col("space"))).select("input", "space", "task_id", "verdict", "n")
