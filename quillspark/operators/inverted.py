"""A stored inverted index: postings that searches read instead of the texts.

The index is a table of blocks.  Texts are dealt over slots of about ``slot`` texts by a hash of their
keys, and a block holds one term's postings (key, frequency, length of the text) in one slot, with the
greatest frequency and the least length, which bound the score of all its postings.  Blocks lie in
folders by a hash of their term, sorted by term, so that a search reads the folders of the asked terms
and of these, by the statistics of the files, the row groups with the terms.

A change of texts writes a run of its own, the blocks of the texts as they are now, and tombstones of
the former ones; the runs before stay as they are.  What a run takes from the numbers of texts by term
is written with it, so that all scores are those of an index built anew.  ``merge`` makes one run of all.
All states are snapshots: an update that fails leaves the index as it was.
An index for reading alone is built without what changes need, the terms by key: the texts are shuffled
once, whole, by slot, and all the terms of a slot are counted and gathered where its texts are.

Searches take queries in bulk.  With all terms required, only postings of a query's rarest term are
opened, and the other terms' in the slots where it occurs.  With any term, texts that have one of the
rarest terms are scored first; the k-th best score among them bounds the others: a text is looked at
only if it has a term without which the rest of the query's terms cannot reach the bound, and only in
slots whose blocks reach it together.  The result is exact in either mode.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut
from ..sources.snapshots import Snapshots
from .retrieval import B, CANDIDATES, K1, best_of, phrases, tokens

#: Texts of a slot, folders of terms, asked terms that are pushed into the scan by name.
SLOT, BUCKETS, PUSHED = 512, 64, 5_000
#: Texts that are scored first for the bound of any-term searches, as a multiple of k.
FIRST = 4


class InvertedIndex:
    """key: the column of texts' ids (any type that sorts); text: the column of texts; stem: of an array of terms."""

    def __init__(self, spark: SparkSession, path: str, key: str = "chunk_id", text: str = "content", stem: Callable[[Column], Column] | None = None, buckets: int = BUCKETS, slot: int = SLOT):
        self.spark, self.key, self.text, self.stem, self.slot = spark, key, text, stem or (lambda ts: ts), slot
        self.log = Snapshots(spark, path)
        self.buckets = self.log.state()[1].get("buckets", buckets)

    # --- writing -----------------------------------------------------------------------------------

    def _folder_of(self, c: str | Column) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(self.buckets)).cast("int")

    def _at(self, name: str) -> str:
        return f"{self.log.path}/{name}"

    def _terms(self, texts: DataFrame) -> DataFrame:
        """key, len, term and tf; a row of the empty term for each text.  All texts of a folder of keys are together."""
        words = texts.select(self.key, self.stem(tokens(F.col(self.text))).alias("ts")).withColumn("of", self._folder_of(self.key))
        rows = words.select(self.key, "of", F.size("ts").alias("len"), F.explode(F.concat("ts", F.array(F.lit("")))).alias("term"))
        return rows.groupBy("of", self.key, "len", "term").agg(F.count("*").alias("tf"))

    def _write(self, terms: DataFrame, run: int) -> dict:
        """The folders of a run: terms by key (forward), blocks by term."""
        forward, blocks = self.log.folder("forward"), self.log.folder("blocks")
        terms.hint("rebalance", "of").write.partitionBy("of").parquet(self._at(forward))
        stored = self._read(forward)
        stored = terms if stored is None else stored
        n, total = stored.where("term = ''").agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()
        slots = max(1, n // self.slot)
        number = F.lit(run << 40) + F.pmod(F.xxhash64(F.lit("slot"), self.key), F.lit(slots))
        one = stored.where("term <> ''").withColumn("slot", number).groupBy("term", "slot").agg(F.collect_list(F.struct(self.key, "tf", "len")).alias("postings"), F.count("*").alias("n"), F.max("tf").alias("max_tf"), F.min("len").alias("min_len"))
        one.withColumn("of", self._folder_of("term")).hint("rebalance", "of").sortWithinPartitions("of", "term").write.partitionBy("of").parquet(self._at(blocks))
        return {"run": run, "key": terms.schema[self.key].dataType.simpleString(), "forward": forward, "blocks": blocks, "n": n, "total": total}

    def _gathered(self, texts: DataFrame) -> dict:
        """The blocks of a run for reading alone; those of the empty term hold the texts themselves."""
        blocks, slots = self.log.folder("blocks"), max(1, texts.count() // self.slot)
        dealt = texts.select(self.key, self.text).withColumn("slot", F.pmod(F.xxhash64(F.lit("slot"), self.key), F.lit(slots))).repartition("slot")
        words = dealt.select(self.key, "slot", self.stem(tokens(F.col(self.text))).alias("ts"))
        rows = words.select(self.key, "slot", F.size("ts").alias("len"), F.explode(F.concat("ts", F.array(F.lit("")))).alias("term"))
        terms = rows.groupBy("slot", "term", self.key, "len").agg(F.count("*").alias("tf"))
        one = terms.groupBy("slot", "term").agg(F.collect_list(F.struct(self.key, "tf", "len")).alias("postings"), F.count("*").alias("n"), F.max("tf").alias("max_tf"), F.min("len").alias("min_len"))
        one = one.select("term", "slot", "postings", "n", "max_tf", "min_len", self._folder_of("term").alias("of"))
        one.hint("rebalance", "of").sortWithinPartitions("of", "term").write.partitionBy("of").parquet(self._at(blocks))
        stored, n, total = self._read(blocks), 0, 0
        if stored is not None:
            lengths = F.aggregate("postings", F.lit(0).cast("long"), lambda s, p: s + p["len"])
            of = self.spark.range(1).select(self._folder_of(F.lit(""))).first()[0]
            n, total = stored.where((F.col("of") == of) & (F.col("term") == "")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(lengths), F.lit(0))).first()
        return {"run": 0, "key": texts.schema[self.key].dataType.simpleString(), "blocks": blocks, "n": n, "total": total}

    def build(self, texts: DataFrame, changes: bool = True) -> None:
        """The index of texts, whatever it held before; changes: whether update and merge are to be possible."""
        version, _ = self.log.state()
        run = self._write(self._terms(texts), 0) if changes else self._gathered(texts)
        self.log.commit({"buckets": self.buckets, "runs": [run], "n_docs": run["n"], "total": run["total"]}, version)

    def update(self, texts: DataFrame, deleted: DataFrame | None = None) -> None:
        """texts: new ones and changed ones; deleted: keys of those that are gone."""
        version, state = self._changeable()
        run = 1 + max([-1, *(r["run"] for r in state.get("runs", []))])
        gone = texts.select(self.key) if deleted is None else texts.select(self.key).union(deleted.select(self.key))
        dead = self.log.folder("dead")
        gone.distinct().withColumn("run", F.lit(run)).write.parquet(self._at(dead))
        now = self._write(self._terms(texts), run)
        gone = self.spark.read.parquet(self._at(dead)).select(self.key)
        former = self._forward(state, gone).join(gone, self.key, "left_semi")
        less = self.log.folder("less")
        former.groupBy("term").agg(F.count("*").alias("less"), F.sum("len").alias("len")).withColumn("of", self._folder_of("term")).write.partitionBy("of").parquet(self._at(less))
        lost = self._read(less)
        lost = None if lost is None else lost.where("term = ''").select("less", "len").first()
        n, total = (lost["less"], lost["len"]) if lost else (0, 0)
        runs = [*state.get("runs", []), now | {"dead": dead, "less": less}]
        self.log.commit({"buckets": self.buckets, "runs": runs, "n_docs": state.get("n_docs", 0) + now["n"] - n, "total": state.get("total", 0) + now["total"] - total}, version)

    def _changeable(self) -> tuple[int, dict]:
        version, state = self.log.state()
        if any("forward" not in r for r in state.get("runs", [])):
            raise ValueError(f"the index at {self.log.path} was built for reading alone")
        return version, state

    def merge(self) -> None:
        """One run without tombstones in place of all."""
        version, state = self._changeable()
        terms = self._forward(state).select("of", self.key, "len", "term", "tf")
        run = self._write(terms, 0)
        self.log.commit({"buckets": self.buckets, "runs": [run], "n_docs": run["n"], "total": run["total"]}, version)

    def clean(self, keep: int = 1) -> None:
        """Removes folders of former snapshots."""
        self.log.clean(lambda s: {r[n] for r in s.get("runs", []) for n in ("forward", "blocks", "dead", "less") if n in r}, keep)

    def _read(self, folder: str) -> DataFrame | None:
        return self.spark.read.parquet(self._at(folder)) if any(n.startswith(("of=", "part-")) for n in self.log.names(folder)) else None

    def _union(self, state: dict, kind: str, of: list[int] | None = None) -> DataFrame | None:
        """All runs' folders of a kind, the run's number in __run."""
        out = None
        for r in state.get("runs", []):
            got = self._read(r[kind]) if kind in r else None
            if got is not None:
                got = (got.where(F.col("of").isin(of)) if of is not None else got).withColumn("__run", F.lit(r["run"]))
                out = got if out is None else out.unionByName(got)
        return out

    def _living(self, rows: DataFrame, state: dict) -> DataFrame:
        """Rows (key, __run) but those that a later run replaces."""
        dead = self._union(state, "dead")
        if dead is None:
            return rows.drop("__run")
        last = dead.groupBy(self.key).agg(F.max("run").alias("__last"))
        return rows.join(last, self.key, "left").where("__last IS NULL OR __run >= __last").drop("__last", "__run")

    def _forward(self, state: dict, keys: DataFrame | None = None) -> DataFrame:
        """Terms of all living texts, or of the folders of some keys."""
        of = None if keys is None else [r[0] for r in keys.select(self._folder_of(self.key)).distinct().collect()]  # at most all folders
        got = self._union(state, "forward", of)
        if got is None:
            return self.spark.createDataFrame([], f"`{self.key}` {(state.get('runs') or [{'key': 'bigint'}])[0]['key']}, len int, term string, tf bigint, of int")
        return self._living(got, state)

    # --- searching ---------------------------------------------------------------------------------

    def _blocks(self, state: dict, asked: DataFrame) -> DataFrame:
        """Blocks of the asked terms, read from their folders alone; few terms are named to the scan."""
        of = [r[0] for r in asked.select(self._folder_of("term")).distinct().collect()]  # at most all folders
        if not state:
            raise ValueError(f"no index at {self.log.path}")
        blocks = self._union(state, "blocks", of)
        if blocks is None:
            key = f"`{self.key}`:{state['runs'][0]['key']}"
            return self.spark.createDataFrame([], f"term string, slot bigint, postings array<struct<{key},tf:bigint,len:int>>, n bigint, max_tf bigint, min_len int, of int, __run int")
        some = [r[0] for r in asked.limit(PUSHED + 1).collect()]
        return blocks.where(F.col("term").isin(some)) if len(some) <= PUSHED else blocks.join(asked, "term", "left_semi")

    def _frequencies(self, state: dict, blocks: DataFrame) -> DataFrame:
        """term and df, the number of living texts with it."""
        n = blocks.select("term", F.col("n").cast("long").alias("n"))
        less = self._union(state, "less")
        if less is not None:
            n = n.union(less.join(n.select("term").distinct(), "term", "left_semi").select("term", -F.col("less")))
        return n.groupBy("term").agg(F.sum("n").alias("df")).where("df > 0")

    def search(self, queries: DataFrame, k: int = CANDIDATES, every: bool = True, texts: DataFrame | None = None) -> DataFrame:
        """query_id, key, bm25 and rank, as of ``retrieval.bm25`` over the texts; texts: key and text, for quoted phrases."""
        _, state = self.log.state()
        terms = cut(queries.select("query_id", F.explode(F.array_distinct(self.stem(tokens(F.col("text"))))).alias("term")))
        blocks = self._blocks(state, terms.select("term").distinct())
        df = cut(self._frequencies(state, blocks))
        n_docs, average = F.lit(state["n_docs"]), F.lit(state["total"] / max(1, state["n_docs"]))
        idf = F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weight = lambda tf, length: F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))
        asked = terms.join(df, "term").withColumn("idf", idf)

        def scored(candidates: DataFrame, of: DataFrame) -> DataFrame:
            """query_id, key, raw, n_hit: whole scores of at least the candidates; query_id, slot, keys."""
            few = F.size("keys") <= 32
            near = candidates.join(of, "query_id").join(blocks, ["term", "slot"])
            picked = F.when(few, F.filter("postings", lambda p: F.array_contains(F.col("keys"), p[self.key]))).otherwise(F.col("postings"))
            p = near.select("query_id", "__run", "idf", F.explode(picked).alias("p")).select("query_id", "__run", "idf", "p.*")
            return self._living(p, state).groupBy("query_id", self.key).agg(F.sum(weight(F.col("tf"), F.col("len"))).alias("raw"), F.count("*").alias("n_hit"))

        def opened(of: DataFrame) -> DataFrame:
            """query_id, slot and keys of the postings of some terms of queries (query_id, term); at most a slot's texts each."""
            p = of.join(blocks.select("term", "slot", F.col(f"postings.{self.key}").alias("k")), "term")
            return p.groupBy("query_id", "slot").agg(F.array_distinct(F.flatten(F.collect_list("k"))).alias("keys"))

        if every:
            known = terms.join(df, "term", "left").groupBy("query_id").agg(F.count("*").alias("n_terms"), F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term")).alias("r"))
            rarest = known.where("r.df > 0").select("query_id", F.col("r.term").alias("term"))
            # of the rarest term's slots, those without one of the terms have no result; no other slots are looked at
            near = cut(opened(rarest))
            there = near.select("query_id", "slot").join(asked.select("query_id", "term"), "query_id").join(blocks.select("term", "slot"), ["term", "slot"]).groupBy("query_id", "slot").agg(F.count("*").alias("n")).join(known, "query_id").where("n = n_terms").select("query_id", "slot")
            raw = scored(near.join(there, ["query_id", "slot"], "left_semi"), asked).join(known.select("query_id", "n_terms"), "query_id").where("n_hit = n_terms")
        else:
            quoted = queries.where(F.size(phrases(F.col("text"))) > 0).select("query_id")
            raw = self._any(asked, blocks, scored, opened, weight, k, quoted)
        whole = raw.select("query_id", self.key, F.round("raw", 9).alias("raw"))
        return best_of(whole, queries, texts, self.key, self.text, k)

    def _any(self, asked: DataFrame, blocks: DataFrame, scored, opened, weight, k: int, quoted: DataFrame) -> DataFrame:
        by = Window.partitionBy("query_id")
        before = F.coalesce(F.sum("df").over(by.orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        asked = cut(asked.withColumn("first", before < FIRST * k))
        some = cut(scored(opened(asked.where("first").select("query_id", "term")), asked.select("query_id", "term", "idf")))
        kth = some.withColumn("n", F.row_number().over(by.orderBy(F.desc("raw")))).where(F.col("n") == k).select("query_id", (F.col("raw") - 1e-8).alias("bound"))
        kth = kth.join(quoted, "query_id", "left_anti")  # phrases take results away: nothing bounds these queries
        # bounds of blocks, and of terms over all blocks
        bound = asked.select("query_id", "term", "idf", "first").join(blocks.select("term", "slot", "max_tf", "min_len"), "term").withColumn("most", weight(F.col("max_tf"), F.col("min_len")))
        bound = cut(bound.select("query_id", "term", "first", "slot", "most"))
        of_term = bound.groupBy("query_id", "term", "first").agg(F.max("most").alias("most")).join(kth, "query_id", "left").na.fill(0.0, ["bound"])
        upto = F.sum("most").over(by.orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0))
        needed = of_term.withColumn("upto", upto).where((F.col("upto") >= F.col("bound")) & ~F.col("first")).select("query_id", "term")
        slots = bound.groupBy("query_id", "slot").agg(F.sum("most").alias("most")).join(kth, "query_id", "left").where(F.col("most") >= F.coalesce("bound", F.lit(0.0))).select("query_id", "slot")
        more = scored(opened(needed).join(slots, ["query_id", "slot"], "left_semi"), asked.select("query_id", "term", "idf"))
        return some.unionByName(more).dropDuplicates(["query_id", self.key])
