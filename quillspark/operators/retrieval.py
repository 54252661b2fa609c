"""Hybrid retrieval in bulk: many queries against a whole corpus as one plan.

A query is a row (query_id, text, embedding, tags, profile); a single question is a batch of one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import estimate_tokens, let, recency, stub_capsule, trim
from ..session import cut
from .similarity import nearest

#: Fixed weights: vector, keyword, recency, links, tags, importance.
PROFILES = {
    "default": (1 / 6, 1 / 6, 1 / 6, 1 / 6, 1 / 6, 1 / 6),
    "lookup": (0.10, 0.40, 0.15, 0.15, 0.10, 0.10),
    "planning": (0.15, 0.10, 0.30, 0.25, 0.10, 0.10),
    "reflection": (0.15, 0.15, 0.35, 0.10, 0.10, 0.15),
    "synthesis": (0.40, 0.15, 0.10, 0.15, 0.10, 0.10),
}
SIGNALS = ("sim_vector", "bm25", "recency", "pagerank", "tag_match", "importance")
#: Fixed parameters of the pipeline.
CANDIDATES, ALIAS_DISCOUNT = 50, 0.7
RERANK_BELOW, CONFIDENCE_K, RERANK_DEPTH = 0.3, 5, 20
#: Pairs of question and text that a model gets at once.
PAIRS = 64
SEEDS, EXPANDED_FILES, DAMPING, STUB_COST = 10, 20, 0.5, 5
K1, B = 1.2, 0.75
TOKEN = r"[\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def phrases(text: Column) -> Column:
    """The quoted phrases of a query, each as its tokens with a space around them."""
    found = F.regexp_extract_all(text, F.lit(r'"([^"]+)"'), F.lit(1))
    return F.filter(F.transform(found, lambda p: F.concat(F.lit(" "), F.array_join(tokens(p), " "), F.lit(" "))), lambda p: F.length(p) > 2)


def bm25(docs: DataFrame, queries: DataFrame, key: str = "chunk_id", text: str = "content", k: int = CANDIDATES, stem: Callable[[Column], Column] | None = None, every: bool = True) -> DataFrame:
    """query_id, key, bm25 (over the best of the query's k results) and rank; all terms must occur (with
    every=False: any), and quoted phrases as such.

    Okapi BM25 with k1 = 1.2 and b = 0.75.  One scan of the texts gives the postings of terms that some
    query asks for, and a row for each text's length; numbers of texts and of texts by term are sums
    over the same rows.  If all are required, only texts with a query's rarest term are scored.  stem: of an array of terms.
    """
    stem = stem or (lambda ts: ts)
    terms = queries.select("query_id", F.explode(F.array_distinct(stem(tokens(F.col("text"))))).alias("term"))
    length = F.lit("")  # a term that no text has stands for the text itself
    asked = terms.select("term").union(queries.sparkSession.range(1).select(length.alias("term"))).distinct()
    words = docs.select(key, stem(tokens(F.col(text))).alias("ts"))
    hits = words.select(key, F.size("ts").alias("len"), F.explode(F.concat("ts", F.array(length))).alias("term")).join(asked, "term", "left_semi").groupBy(key, "len", "term").agg(F.count("*").alias("tf"))
    hits = cut(hits)  # read four times
    totals = hits.where("term = ''").agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"))
    df = hits.where("term <> ''").groupBy("term").agg(F.count("*").alias("df"))
    known = terms.join(df, "term", "left").groupBy("query_id").agg(F.count("*").alias("n_terms"), F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term")).alias("r"))
    rarest = known.where("r.df > 0").select("query_id", "n_terms", F.col("r.term").alias("term"))
    few = hits.join(rarest, "term").select("query_id", key, "n_terms").join(hits, key)
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    asked_of = terms.join(df, "term")
    found = few.join(asked_of, ["query_id", "term"]) if every else hits.join(asked_of, "term").withColumn("n_terms", F.lit(0))
    scored = found.join(F.broadcast(totals), how="cross").groupBy("query_id", key, "n_terms").agg(F.sum(weight).alias("raw"), F.count("*").alias("n_hit"))  # totals: one row
    whole = (scored.where("n_hit = n_terms") if every else scored).withColumn("raw", F.round("raw", 9))
    return best_of(whole, queries, docs, key, text, k)


def best_of(whole: DataFrame, queries: DataFrame, docs: DataFrame | None, key: str, text: str, k: int) -> DataFrame:
    """The k best of each query's scored texts (query_id, key, raw) that have its quoted phrases; without docs phrases are not looked at."""
    if docs is not None:
        quoted = queries.select("query_id", phrases(F.col("text")).alias("phrases")).where(F.size("phrases") > 0)
        docs = docs if quoted.head(1) else None  # without phrases the texts are not read
    if docs is not None:
        flat = F.concat(F.lit(" "), F.array_join(tokens(F.col(text)), " "), F.lit(" "))
        with_phrases = whole.join(quoted, "query_id").join(docs.select(key, flat.alias("flat")), key)
        missing = with_phrases.where(F.exists("phrases", lambda p: ~F.contains(F.col("flat"), p))).select("query_id", key)
        whole = whole.join(missing, ["query_id", key], "left_anti")
    ranked = whole.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("raw"), F.asc(key)))).where(F.col("rank") <= k)
    best = F.max("raw").over(Window.partitionBy("query_id"))
    return ranked.withColumn("bm25", F.when(best > 0, F.col("raw") / best).otherwise(F.lit(0.0))).select("query_id", key, "bm25", "rank")


def knn(vectors: DataFrame, queries: DataFrame, key: str = "chunk_id", k: int = CANDIDATES) -> DataFrame:
    """query_id, key, sim and rank of the k nearest vectors of each query that has one, exactly."""
    return nearest(vectors, queries, key, k)


def fuse(vector: DataFrame, keyword: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Candidates of either channel, absent signals 0."""
    v = vector.select("query_id", key, F.col("sim").alias("sim_vector"))
    w = keyword.select("query_id", key, "bm25")
    return v.join(w, ["query_id", key], "full_outer").na.fill(0.0, ["sim_vector", "bm25"])


def fusion_confidence(vector: DataFrame, keyword: DataFrame, queries: DataFrame, key: str = "chunk_id", k: int = CONFIDENCE_K) -> DataFrame:
    """query_id, confidence, k and overlap of the channels' best k; both empty 1, one empty 0."""
    count = lambda df, n: df.groupBy("query_id").agg(F.count("*").alias(n))
    sizes = queries.select("query_id").join(count(vector, "nv"), "query_id", "left").join(count(keyword, "nf"), "query_id", "left").na.fill(0)
    sizes = sizes.withColumn("k", F.least(F.lit(k), "nv", "nf").cast("long"))
    both = vector.select("query_id", key, F.col("rank").alias("rv")).join(keyword.select("query_id", key, F.col("rank").alias("rf")), ["query_id", key])
    overlap = both.join(sizes, "query_id").where("rv <= k AND rf <= k").groupBy("query_id").agg(F.count("*").alias("overlap"))
    out = sizes.join(overlap, "query_id", "left").na.fill(0, ["overlap"])
    confidence = F.when((F.col("nv") == 0) & (F.col("nf") == 0), 1.0).when(F.col("k") == 0, 0.0).otherwise(F.col("overlap") / F.col("k"))
    one_empty = ((F.col("nv") == 0) | (F.col("nf") == 0)) & ((F.col("nv") > 0) | (F.col("nf") > 0))
    return out.select("query_id", confidence.alias("confidence"), F.when(one_empty, F.lit(k)).otherwise(F.col("k")).cast("long").alias("k"), "overlap")


def expand_tags(tags: Column, members: Column) -> Column:
    """Lower-cased tags with all members of their classes, sorted, each once; members: map<tag, array<tag>>."""
    low = F.transform(tags, F.lower)
    more = F.flatten(F.transform(low, lambda t: F.coalesce(F.try_element_at(members, t), F.array().cast("array<string>"))))
    return F.array_sort(F.array_distinct(F.concat(low, more)))


def tag_match(query: Column, chunk: Column, canonical: Column | None = None, discount: float = ALIAS_DISCOUNT) -> Column:
    """(literal + discount * same class only) / classes of either; may exceed 1.  canonical: map<tag, class>."""
    q, c = F.array_distinct(F.transform(query, F.lower)), F.array_distinct(F.transform(chunk, F.lower))
    if canonical is None:
        qc, cc = q, c
    else:
        name = lambda t: F.coalesce(F.try_element_at(canonical, t), t)
        qc, cc = F.array_distinct(F.transform(q, name)), F.array_distinct(F.transform(c, name))
    literal, same = F.size(F.array_intersect(q, c)), F.size(F.array_intersect(qc, cc))
    score = (literal + discount * F.greatest(same - literal, F.lit(0))) / F.size(F.array_union(qc, cc))
    return F.when((F.size(query) > 0) & (F.size(chunk) > 0), score).otherwise(F.lit(0.0))


def resolve_profile(intent: str) -> str:
    """A profile's name; unknown intents and auto are the default."""
    return intent if intent in PROFILES else "default"


def expansion_reason() -> Column:
    v, k = F.col("sim_vector") > 0, F.col("bm25") > 0
    return F.when(v & k, "hybrid").when(v, "vector_only").when(k, "keyword_only").otherwise("hybrid")


def rank(candidates: DataFrame, profile: str = "default", key: str = "chunk_id", rounded: int = 9) -> DataFrame:
    """score and rank of each query's candidates with sim_vector, bm25, age_seconds, pagerank, tag_match and importance."""
    df = candidates.withColumn("recency", recency(F.col("age_seconds")))
    score = sum((F.lit(w) * F.col(s) for w, s in zip(PROFILES[resolve_profile(profile)], SIGNALS, strict=True)), F.lit(0.0))
    df = df.withColumn("score", F.round(score, rounded)).withColumn("reason", expansion_reason())
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(key))))


def kind_of(key: Column, summary_kind: Column | None = None) -> Column:
    """Kind of an object by the prefix of its id."""
    s = F.coalesce(summary_kind if summary_kind is not None else F.lit(None).cast("string"), F.lit("episode"))
    summary = F.when(s == "reflection", "reflection").when(s == "procedure", "procedure").when(s == "summary", "note").otherwise("episode")
    return F.when(key.startswith("sum:"), summary).when(key.startswith("task-outcome:"), "task_outcome").when(key.startswith("task:"), "task").when(key.startswith("record:"), "record").otherwise("note")


def post_filter(candidates: DataFrame, kinds: list[str] | None = None, after: int | None = None, before: int | None = None, require: list[list[str]] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Filters on kind, created_at and tags, for use after the candidates' limit: at least one tag of each
    required class, none of the excluded.  Rows without time (age 0) pass the time filter."""
    out = candidates
    tags = F.transform("tags", F.lower)
    if kinds:
        out = out.where(F.col("kind").isin(kinds))
    if after is not None:
        out = out.where((F.col("age_seconds") == 0) | (F.col("created_at") >= after))
    if before is not None:
        out = out.where((F.col("age_seconds") == 0) | (F.col("created_at") <= before))
    for group in require or []:
        out = out.where(F.arrays_overlap(tags, F.array(*[F.lit(t.lower()) for t in group])))
    if exclude:
        out = out.where(~F.arrays_overlap(tags, F.array(*[F.lit(t.lower()) for t in exclude])))
    return out


def graph_expand(candidates: DataFrame, links: DataFrame, chunks: DataFrame, seeds: int = SEEDS, files: int = EXPANDED_FILES, damping: float = DAMPING) -> DataFrame:
    """Adds the chunks of files that the best candidates link to.

    candidates: query_id, chunk_id, file_id, sim_vector, bm25, pagerank, tags, importance, age_seconds;
    links: source_file_id, target_file_id; chunks: chunk_id, file_id, pagerank, age_seconds.  A file
    takes the first seed that links to it; what is already a candidate keeps the greater similarity.
    """
    by = Window.partitionBy("query_id")
    s = candidates.withColumn("seed", F.row_number().over(by.orderBy(F.desc(F.col("sim_vector") + F.col("bm25") + F.col("pagerank")), "chunk_id"))).where(F.col("seed") <= seeds)
    out = s.join(links.where("target_file_id IS NOT NULL"), s.file_id == links.source_file_id).select("query_id", F.col("target_file_id").alias("file_id"), "seed", F.least(F.lit(1.0), F.col("sim_vector") + F.col("bm25")).alias("s"))
    first = out.groupBy("query_id", "file_id").agg(F.min(F.struct("seed", "s")).alias("f"))
    first = first.withColumn("n", F.row_number().over(by.orderBy("f.seed", "file_id"))).where(F.col("n") <= files)
    new = first.join(chunks, "file_id").select("query_id", "chunk_id", "file_id", (damping * F.col("f.s")).alias("sim_graph"), F.col("pagerank").alias("p2"), F.col("age_seconds").alias("a2"))
    both = candidates.join(new, ["query_id", "chunk_id"], "full_outer")
    return both.select(
        "query_id",
        "chunk_id",
        F.coalesce(candidates.file_id, new.file_id).alias("file_id"),
        F.greatest(F.coalesce("sim_vector", F.lit(0.0)), F.coalesce("sim_graph", F.lit(0.0))).alias("sim_vector"),
        F.coalesce("bm25", F.lit(0.0)).alias("bm25"),
        F.coalesce("pagerank", "p2").alias("pagerank"),
        F.coalesce("age_seconds", "a2").alias("age_seconds"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        F.coalesce("importance", F.lit(1.0)).alias("importance"),
    )


def federated_merge(results: DataFrame, key: str = "chunk_id", space: str = "space") -> DataFrame:
    """Best score of each chunk over spaces, ties to the first space by name; ranked again."""
    first = results.withColumn("n", F.row_number().over(Window.partitionBy("query_id", key).orderBy(F.desc("score"), F.asc(space)))).where("n = 1").drop("n")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(key))))


def rerank(ranked: DataFrame, confidence: DataFrame, score: Column, key: str = "chunk_id", below: float = RERANK_BELOW, depth: int = RERANK_DEPTH) -> DataFrame:
    """Where the channels disagree, the first depth results take another score; all are sorted again."""
    doubt = ranked.join(confidence.select("query_id", "confidence"), "query_id")
    again = F.when((F.col("confidence") < below) & (F.col("rank") <= depth), score).otherwise(F.col("score"))
    out = doubt.withColumn("score", again)
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(key))))


def rerank_by_model(ranked: DataFrame, confidence: DataFrame, make: Callable[[], Callable], queries: DataFrame, key: str = "chunk_id", text: str = "content", below: float = RERANK_BELOW, depth: int = RERANK_DEPTH, pairs: int = PAIRS) -> DataFrame:
    """rerank with a model: make() is called once a task and gives a function of a pandas frame (query_id, key,
    question, text) of up to pairs rows, which returns their scores.

    Only the first depth results of queries whose channels disagree reach it, as whole texts.  A score of
    NaN or None leaves the former one.  queries: query_id, text.
    """
    doubt = confidence.where(F.col("confidence") < below).select("query_id")
    fed = ranked.where(F.col("rank") <= depth).join(doubt, "query_id", "left_semi").join(queries.select("query_id", F.col("text").alias("question")), "query_id").select("query_id", key, "question", F.col(text).alias("text"))

    def run(frames):
        model = make()
        for pdf in frames:
            for at in range(0, len(pdf), pairs):
                part = pdf.iloc[at : at + pairs]
                yield part[["query_id", key]].assign(again=[None if s is None or s != s else float(s) for s in model(part)])

    kinds = dict(ranked.dtypes)
    again = fed.mapInPandas(run, f"query_id {kinds['query_id']}, `{key}` {kinds[key]}, again double")
    out = ranked.join(again, ["query_id", key], "left").withColumn("score", F.coalesce(F.when(~F.isnan("again"), F.col("again")), F.col("score"))).drop("again")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(key))))


def stubs(ranked: DataFrame) -> DataFrame:
    """Adds title, summary and stub_tokens; ranked: content, heading_path, and ml_summary where there is one."""
    heading = trim(F.regexp_replace(F.element_at(F.split("heading_path", " > "), -1), "^#+", ""))
    title = F.when(F.col("heading_path") != "", heading).otherwise(F.left(F.substring_index("content", "\n", 1), F.lit(80)))
    out = ranked.withColumn("title", title)
    ml = F.col("ml_summary") if "ml_summary" in ranked.columns else F.lit(None).cast("string")
    out = out.withColumn("summary", F.coalesce(ml, stub_capsule(F.col("title"), F.col("content"))))
    return out.withColumn("stub_tokens", estimate_tokens(F.col("title")) + estimate_tokens(F.col("summary")) + STUB_COST)


def pack(ranked: DataFrame, budget: int, k: int, cost: str = "stub_tokens") -> DataFrame:
    """The first k results while their cost fits the budget; the first always stays.  Adds slot and used."""
    w = Window.partitionBy("query_id").orderBy("rank")
    out = ranked.where(F.col("rank") <= k).withColumn("slot", F.row_number().over(w) - 1).withColumn("used", F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.where((F.col("slot") == 0) | (F.col("used") <= budget))


def expand(ranked: DataFrame, budget: int) -> DataFrame:
    """Whole contents while they fit; the next one is cut and marked if over 20 tokens remain.  Adds truncated.

    ranked: query_id, rank, content and token_estimate.
    """
    w = Window.partitionBy("query_id").orderBy("rank")
    out = ranked.withColumn("before", F.coalesce(F.sum("token_estimate").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = out.withColumn("truncated", F.col("before") + F.col("token_estimate") > budget)
    first = F.sum(F.col("truncated").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = out.withColumn("over", first).where((F.col("over") == 0) | F.col("truncated") & (F.col("over") == 1) & (budget - F.col("before") > 20))
    left = budget - F.col("before") - 5
    return out.withColumn("content", F.when(F.col("truncated"), F.concat(_cut_tokens(F.col("content"), left), F.lit("\n[truncated]"))).otherwise(F.col("content"))).drop("before", "over")


def _cut_tokens(s: Column, n: Column) -> Column:
    """The text within 4 bytes a token, back to its last '. ', else to its last space."""
    latin = F.decode(F.substring(F.encode(s, "UTF-8"), F.lit(1), (4 * n).cast("int")), "ISO-8859-1")
    chars = F.left(s, F.length(F.regexp_replace(latin, "[\\x{80}-\\x{BF}]", "")))
    whole = F.when(F.octet_length(chars) > 4 * n, F.left(s, F.length(chars) - 1)).otherwise(chars)
    cut = let(whole, lambda w: F.when(F.instr(w, ". ") > 0, F.regexp_extract(w, r"^([\s\S]*)\. ", 1)).when(F.instr(w, " ") > 0, F.regexp_extract(w, r"^([\s\S]*) ", 1)).otherwise(w))
    return F.when(F.octet_length(s) <= 4 * n, s).otherwise(trim(cut))


def search(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, now: int, profile: str = "default", k: int = CANDIDATES, links: DataFrame | None = None, score: Column | Callable[[], Callable] | None = None, keyword: Callable[[DataFrame], DataFrame] | None = None, **filters) -> DataFrame:
    """The pipeline: both channels, fusion, enrichment, rank; on request graph expansion, filters and a second score.

    chunks: chunk_id, content, created_at, pagerank, tags, importance (file_id with links, kind with kinds);
    vectors: chunk_id, embedding; queries: query_id, text, embedding, tags; links: source_file_id,
    target_file_id; score: a reranker's, over the result's columns, or what makes a model of ``rerank_by_model``; keyword: the keyword channel's results for queries, such as a stored
    index's (without it BM25 reads the chunks); filters: those of post_filter.
    """
    near, worded = knn(vectors, queries, k=k), bm25(chunks, queries, k=k) if keyword is None else keyword(queries)
    if links is not None or score is not None:
        near, worded = cut(near), cut(worded)
    fused = fuse(near, worded)
    plain = chunks.withColumns({"pagerank": F.coalesce("pagerank", F.lit(0.0)), "importance": F.coalesce("importance", F.lit(0.5)), "age_seconds": (F.lit(now) - F.col("created_at")).cast("double")})
    if links is not None:
        own = ("pagerank", "tags", "importance", "age_seconds")
        found = graph_expand(fused.join(plain.select("chunk_id", "file_id", *own), "chunk_id"), links, plain.select("chunk_id", "file_id", "pagerank", "age_seconds"))
        rows = found.drop("file_id").join(plain.drop(*own), "chunk_id")
    else:
        rows = fused.join(plain, "chunk_id")
    rows = rows.where(trim(F.col("content")) != "").join(queries.select("query_id", F.col("tags").alias("q_tags")), "query_id").withColumn("tag_match", tag_match(F.col("q_tags"), F.col("tags")))
    out = rank(post_filter(rows, **filters), profile)
    if score is None:
        return out
    confidence = fusion_confidence(near, worded, queries)
    return rerank(out, confidence, score) if isinstance(score, Column) else rerank_by_model(out, confidence, score, queries)


def resolve_lod(results: DataFrame, lods: DataFrame, now_iso: str, level: str = "L1") -> DataFrame:
    """Content at a level of detail: results (uri, content, source_hash), lods (uri, lod_level, content, source_hash, expires_at).

    L2 is the content.  L0: the stored abstract, fresh if its hash is the source's, else L2.  L1: the
    stored one, fresh if its hash fits and it has not expired (a stale one is served and queued), else
    L0, else L2, and queued.  Adds lod_content, actual_lod, lod_fresh and enqueue.
    """
    of = lambda name: lods.where(F.col("lod_level") == name).select("uri", F.col("content").alias(f"c_{name}"), F.col("source_hash").alias(f"h_{name}"), F.col("expires_at").alias(f"x_{name}"))
    out = results.join(of("L0"), "uri", "left").join(of("L1"), "uri", "left")
    l0, l1 = F.col("c_L0").isNotNull(), F.col("c_L1").isNotNull()
    fresh0, fresh1 = F.col("h_L0") == F.col("source_hash"), (F.col("h_L1") == F.col("source_hash")) & (F.col("x_L1").isNull() | (F.col("x_L1") > now_iso))
    if level == "L2":
        parts = (F.col("content"), F.lit("L2"), F.lit(True), F.lit(False))
    elif level == "L0":
        parts = (F.coalesce("c_L0", "content"), F.when(l0, "L0").otherwise("L2"), F.when(l0, fresh0).otherwise(True), F.lit(False))
    else:
        parts = (F.coalesce("c_L1", "c_L0", "content"), F.when(l1, "L1").when(l0, "L0").otherwise("L2"), F.when(l1, fresh1).when(l0, fresh0).otherwise(True), ~F.coalesce(l1 & fresh1, F.lit(False)))
    names = ("lod_content", "actual_lod", "lod_fresh", "enqueue")
    return out.select(*results.columns, *[p.alias(n) for p, n in zip(parts, names, strict=True)])
