"""Further queries, of the same form as those of queries.py: memory, records, search with all its parts, and folds."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.stemming import stems
from ..operators import episodes, graph, memory, records, resolve, retrieval
from ..sources import markdown
from ..streaming import folds
from .queries import _BM25, _FUSED, _HEAD, _chunks, _index, _keyword, _queries, _ranked_sql, _vectors, big, query
from .relations import NOW

# --- memory --------------------------------------------------------------------------------------

#: Stems of the words that the notes hold.
_STEMS = "stems AS (SELECT * FROM (VALUES ('viewing', 'view'), ('pages', 'page'), ('purchases', 'purchas'), ('purchase', 'purchas'), ('orders', 'order'), ('errors', 'error'), ('events', 'event'), ('were', 'were'), ('happily', 'happili'), ('processed', 'process'), ('relational', 'relat'), ('conditional', 'condit'), ('hoping', 'hope'), ('signups', 'signup'), ('clicks', 'click'), ('process', 'process'), ('relations', 'relat'), ('conditions', 'condit'), ('views', 'view'), ('hopes', 'hope')) v(word, stem))"
_NOTE_QUERIES = ((1, "views processed"), (2, "relations errors 7"), (3, 'hopes "signups by user"'), (4, "purchases"), (5, "nothing like it"))
_NOTES = (
    _STEMS
    + """, q AS (SELECT * FROM (VALUES (1, 'views'), (1, 'processed'), (2, 'relations'), (2, 'errors'), (2, '7'), (3, 'hopes'), (3, 'signups'), (3, 'by'), (3, 'user'), (4, 'purchases'), (5, 'nothing'), (5, 'like'), (5, 'it')) v(query_id, w)),
asked AS (SELECT DISTINCT query_id, coalesce(stem, w) AS term FROM q LEFT JOIN stems ON word = w),
raw_words AS (SELECT summary_id, pos, coalesce(stem, w) AS term FROM (SELECT summary_id, unnest(ts) AS w, generate_subscripts(ts, 1) AS pos FROM (SELECT summary_id, regexp_extract_all(lower(title || ' ' || content), '[\\p{L}\\p{N}]+') AS ts FROM notes)) LEFT JOIN stems ON word = w),
lens AS (SELECT summary_id, count(*) AS len FROM raw_words GROUP BY summary_id), totals AS (SELECT count(*) AS n_docs, avg(len) AS avg_len FROM lens),
tf AS (SELECT summary_id, len, term, count(*) AS tf FROM raw_words JOIN lens USING (summary_id) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), n_terms AS (SELECT query_id, count(*) AS n_terms FROM asked GROUP BY query_id),
raw AS (SELECT query_id, summary_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 9) AS raw, count(*) AS n_hit FROM tf JOIN df USING (term) JOIN asked USING (term), totals GROUP BY ALL),
kw0 AS (SELECT query_id, summary_id, raw, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, summary_id) AS rank FROM raw JOIN n_terms USING (query_id) JOIN notes USING (summary_id) WHERE n_hit = n_terms AND (query_id <> 3 OR contains(content, 'signups by user'))),
kw AS (SELECT query_id::INT AS query_id, summary_id, CASE WHEN max(raw) OVER (PARTITION BY query_id) > 0 THEN raw / max(raw) OVER (PARTITION BY query_id) ELSE 0 END AS bm25, rank FROM kw0 WHERE rank <= 50)"""
)


def _asked(get) -> DataFrame:
    return get("notes").sparkSession.createDataFrame(_NOTE_QUERIES, "query_id int, text string")


def _notes_index(get):
    return _index(get, "events", memory.bodies(get("notes")), "summary_id", "body", stems)


@query(f"WITH {_NOTES} SELECT query_id, summary_id, round(bm25, 6) AS bm25, rank FROM kw")
def summary_search(get):
    """Summaries by the stems of their words; one query has a phrase."""
    return big(memory.summary_search(get("notes"), _asked(get), index=_notes_index(get)), "rank").select("query_id", "summary_id", F.round("bm25", 6).alias("bm25"), "rank")


@query(f"WITH {_NOTES} SELECT query_id, summary_id, row_number() OVER (PARTITION BY query_id ORDER BY importance DESC, summary_id) AS position FROM kw JOIN notes USING (summary_id) WHERE trust IN ('trusted', 'vetted')")
def trusted_by_text(get):
    """Trusted ones of the best summaries by text, by importance."""
    return big(memory.trusted_by_text(get("notes"), _asked(get), index=_notes_index(get)), "position")


@query("SELECT * FROM (SELECT space, summary_id, row_number() OVER (PARTITION BY space ORDER BY importance DESC, summary_id) AS position FROM notes WHERE trust IN ('trusted', 'vetted') AND tag = 'k3') WHERE position <= 20")
def trusted_by_tag(get):
    return big(memory.trusted_by_tag(get("notes").withColumn("tags", F.array("tag", F.lit("all"))), "k3", 20), "position").select("space", "summary_id", "position")


@query("SELECT summary_id FROM notes WHERE kind IN ('episode', 'reflection', 'procedure') AND updated_at > coalesce(embedded_at, 0) ORDER BY summary_id LIMIT 256")
def stale_summaries(get):
    """A poll's first 256 (its limit) summaries to embed."""
    return memory.stale_summaries(get("notes")).select("summary_id")


@query("SELECT record_id FROM records WHERE record_id % 3 > 0 AND status = 'active' AND updated_at > CASE WHEN record_id % 2 = 0 THEN 1000400 ELSE 0 END ORDER BY record_id LIMIT 256")
def stale_records(get):
    """A poll's first 256 (its limit) records to embed."""
    r = get("records").withColumns({"searchable": (F.col("record_id") % 3 > 0).cast("int"), "embedded_at": F.when(F.col("record_id") % 2 == 0, 1000400)})
    return memory.stale_records(r).select("record_id")


@query("SELECT chunk_id, CASE WHEN chunk_id % 5 > 0 THEN path END AS path FROM chunks WHERE chunk_id % 3 = 0 ORDER BY chunk_id LIMIT 256")
def stale_chunks(get):
    """A poll's first 256 (its limit) chunks to embed, with their files."""
    c = get("chunks")
    return memory.stale_chunks(c.drop("path").withColumn("embedded_at", F.when(F.col("chunk_id") % 3 > 0, 1)), c.where("chunk_id % 5 > 0").select("file_id", "path")).select("chunk_id", "path")


@query("SELECT scope FROM (SELECT 'scope' || event_id AS scope, created_at FROM (SELECT summary_id AS event_id, created_at FROM notes) WHERE event_id % 3 = 0) ORDER BY created_at, scope LIMIT 100")
def stale_scopes(get):
    n = get("notes").select(F.concat(F.lit("scope"), F.col("summary_id").cast("string")).alias("scope"), (F.col("summary_id") % 3 == 0).cast("int").alias("stale"), F.col("created_at").alias("generated_at"))
    return memory.stale_scopes(n, 100).select("scope")


@query("""SELECT space, tag, CASE WHEN price > 1500 THEN 'new' ELSE canonical END AS canonical FROM (SELECT 's' || (p_size % 5) AS space, p_name || p_partkey AS tag, p_brand AS canonical, p_retailprice AS price FROM part) WHERE canonical <> 'Brand#3'
UNION ALL SELECT 's9', p_name, 'new' FROM part WHERE p_partkey % 10 = 0 AND p_partkey <= 200 GROUP BY p_name""")
def apply_aliases(get):
    """Aliases after a clustering: some changed, some new, one class gone."""
    p = get("part")
    a = get("aliases").select("space", "tag", "canonical")
    changed = p.where("p_retailprice > 1500").select(F.concat(F.lit("s"), (F.col("p_size") % 5).cast("string")).alias("space"), F.concat("p_name", F.col("p_partkey").cast("string")).alias("tag"))
    new = p.where("p_partkey % 10 = 0 AND p_partkey <= 200").select(F.lit("s9").alias("space"), F.col("p_name").alias("tag")).distinct()
    return memory.apply_aliases(a, changed.union(new).withColumn("canonical", F.lit("new")), a.where("canonical = 'Brand#3'"))


@query("SELECT space, kind AS lod_level, count(*) AS n FROM notes GROUP BY space, kind UNION ALL SELECT space, NULL, count(*) FROM notes GROUP BY space")
def lod_counts(get):
    return memory.lod_counts(get("notes").select("space", F.col("kind").alias("lod_level")))


@query("SELECT count(*) AS n_rows, (SELECT count(*) FROM notes WHERE summary_id % 4 > 0) + (SELECT count(*) FROM notes WHERE summary_id % 10 = 0) AS n_indexed, count(*) FILTER (WHERE summary_id % 4 = 0) AS n_missing, count(*) FILTER (WHERE summary_id % 10 = 0) AS n_orphans FROM notes")
def index_consistency(get):
    n = get("notes").select("summary_id")
    return memory.index_consistency(n, n.where("summary_id % 4 > 0").union(n.where("summary_id % 10 = 0").select(-F.col("summary_id") - 1)), "summary_id")


@query("SELECT 'r' || space AS reflection_id, summary_id AS source_id FROM notes WHERE kind = 'episode'")
def reflection_sources(get):
    """Sources of reflections that are committed, one for each space."""
    n = get("notes")
    r = n.where("kind = 'episode'").groupBy("space").agg(F.collect_list("summary_id").alias("source_ids")).withColumns({"summary_id": F.concat(F.lit("r"), "space"), "title": F.lit("t"), "content": F.lit("c"), "tags": F.array(F.lit("x"))})
    return memory.store_reflection(n.withColumn("summary_id", F.col("summary_id").cast("string")), r, NOW)[1]


@query("""WITH RECURSIVE r AS (SELECT task_id, sha256(task_id::VARCHAR) AS h, 3 AS l, row_number() OVER (PARTITION BY left(sha256(task_id::VARCHAR), 3) ORDER BY task_id) AS n FROM tasks
UNION ALL SELECT task_id, h, l + 1, row_number() OVER (PARTITION BY left(h, l + 1) ORDER BY task_id) FROM r WHERE n > 1) SELECT task_id, left(h, l) AS short_id FROM r WHERE n = 1""")
def short_ids(get):
    """The shortest free prefix of each task's hash, in order of ids."""
    return memory.short_ids(get("tasks"), "task_id", F.sha2(F.col("task_id").cast("string"), 256), "task_id")


@query("""WITH p AS (SELECT to_id AS task_id, min(from_id) AS parent_id FROM entity_links WHERE edge_kind = 'parent_of' GROUP BY to_id) SELECT t.task_id, CASE WHEN u.task_id IS NOT NULL THEN 'TSK-' || u.task_id || '.' || t.child_seq ELSE 'TSK-' || t.task_id END AS display
FROM tasks t LEFT JOIN p USING (task_id) LEFT JOIN tasks u ON u.task_id = p.parent_id""")
def display_ids(get):
    """Ids for people: a child's is its parent's and its number."""
    t = get("tasks")
    return memory.display_ids(t, get("entity_links"), t.select("task_id", F.col("task_id").cast("string").alias("short_id")), "TSK")


_MD = "'# Part ' || p_partkey || chr(10) || chr(10) || p_name || ' is one. And more.' || chr(10) || chr(10) || '## Of ' || p_brand || chr(10) || chr(10) || 'Text' || chr(10) || chr(10) || '### Deep' || chr(10) || chr(10) || 'x' || chr(10) || chr(10) || '## End' || chr(10)"


@query("SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 3 = 0 THEN 'Own' ELSE 'Part ' || p_partkey END || ' — ' || p_name || ' is one. — Sections: Part ' || p_partkey || ', Of ' || p_brand || ', End' AS capsule FROM part")
def document_capsules(get):
    """Capsules of markdown documents: title, first sentence, outline."""
    d = get("part").select(F.col("p_partkey").alias("doc_id"), F.expr(_MD.replace("chr(10)", "char(10)")).alias("text"))
    titles = d.where("doc_id % 3 = 0").select("doc_id", F.lit("Own").alias("title"))
    return memory.document_capsules(markdown.document_sections(d), titles)


# --- search with all its parts -------------------------------------------------------------------


def _full(get, **more) -> DataFrame:
    return retrieval.search(_chunks(get), _vectors(get), _queries(get), NOW, "default", keyword=functools.partial(_keyword, get), **more)


_SIXTH = f"{1 / 6!r}::DOUBLE"
_GRAPH = _FUSED + f""", c AS (SELECT f.*, pagerank FROM fused f JOIN chunks USING (chunk_id)), seeds AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim_vector + bm25 + pagerank DESC, chunk_id) AS seed FROM c),
o AS (SELECT query_id, target_file_id AS file_id, seed, least(1, sim_vector + bm25) AS s FROM seeds JOIN doc_links ON source_file_id = chunk_id WHERE seed <= 10), f1 AS (SELECT query_id, file_id, min(seed) AS seed, arg_min(s, (seed, s)) AS s FROM o GROUP BY query_id, file_id),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY seed, file_id) AS k FROM f1), new AS (SELECT query_id, chunk_id, 0.5 * s AS sim_graph FROM n JOIN chunks USING (file_id) WHERE k <= 20),
b AS (SELECT coalesce(c.query_id, new.query_id) AS query_id, coalesce(c.chunk_id, new.chunk_id) AS chunk_id, greatest(coalesce(sim_vector, 0), coalesce(sim_graph, 0)) AS sim_vector, coalesce(bm25, 0) AS bm25, c.chunk_id IS NULL AS came FROM c FULL JOIN new ON c.query_id = new.query_id AND c.chunk_id = new.chunk_id),
scored AS (SELECT query_id, chunk_id, came, round(round({_SIXTH} * sim_vector + {_SIXTH} * bm25 + {_SIXTH} * exp(-({NOW} - created_at)::DOUBLE / 2592000.0) + {_SIXTH} * pagerank
    + {_SIXTH} * CASE WHEN came THEN 0 ELSE len(list_intersect(['en', 'src' || (query_id % 20)], [lang, space]))::DOUBLE / len(list_distinct(['en', 'src' || (query_id % 20), lang, space])) END + {_SIXTH} * CASE WHEN came THEN 1.0 ELSE importance END, 9), 6) AS score
  FROM b JOIN chunks USING (chunk_id) WHERE trim(content) <> '')"""


@query(_GRAPH + " SELECT query_id, chunk_id, score FROM scored")
def search_with_links(get):
    """Hybrid search whose best candidates bring in what they link to."""
    return _full(get, links=get("doc_links")).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


@query(_ranked_sql("default").replace("WHERE trim(content) <> ''", f"WHERE trim(content) <> '' AND chunk_id % 3 < 2 AND (created_at = {NOW} OR created_at >= {NOW - 200 * 86400} AND created_at <= {NOW - 10 * 86400})") + " SELECT query_id, chunk_id, rank FROM ranked")
def search_with_filters(get):
    """Filters on kind and time after the candidates' limit; what is of this very moment counts as without time."""
    kinds = _chunks(get).withColumn("kind", F.when(F.col("chunk_id") % 3 == 0, "note").when(F.col("chunk_id") % 3 == 1, "task").otherwise("record"))
    out = retrieval.search(kinds, _vectors(get), _queries(get), NOW, "default", keyword=functools.partial(_keyword, get), kinds=["note", "task"], after=NOW - 200 * 86400, before=NOW - 10 * 86400)
    return big(out, "rank").select("query_id", "chunk_id", "rank")


_CONFIDENT = """, s0 AS (SELECT b.item_id AS query_id, (SELECT count(*) FROM vec WHERE query_id = b.item_id) AS nv, (SELECT count(*) FROM kw WHERE query_id = b.item_id) AS nf FROM benchmark b),
o0 AS (SELECT query_id, nv, nf, least(5, nv, nf) AS k, (SELECT count(*) FROM vec v JOIN kw w ON v.query_id = w.query_id AND v.chunk_id = w.chunk_id WHERE v.query_id = s0.query_id AND v.rank <= least(5, nv, nf) AND w.rank <= least(5, nv, nf)) AS overlap FROM s0),
conf AS (SELECT query_id, CASE WHEN nv = 0 AND nf = 0 THEN 1.0 WHEN k = 0 THEN 0.0 ELSE overlap / k END AS confidence FROM o0)"""


@query(_ranked_sql("default") + _CONFIDENT + """, again AS (SELECT query_id, chunk_id, CASE WHEN confidence < 0.3 AND rank <= 20 THEN (chunk_id % 100)::DOUBLE / 100 ELSE score END AS score FROM ranked JOIN conf USING (query_id))
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM again""")
def search_reranked(get):
    """A model's score for the first twenty where the channels disagree; this model knows only ids."""
    return big(_full(get, score=lambda: lambda pairs: pairs["chunk_id"] % 100 / 100), "rank").select("query_id", "chunk_id", "rank")


@query(_ranked_sql("lookup") + " SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS position FROM ranked WHERE rank <= 45 AND chunk_id % 3 = 2 QUALIFY position <= 15")
def record_search(get):
    """Records among three times as many results of the lookup profile."""
    kinds = _chunks(get).withColumn("kind", F.when(F.col("chunk_id") % 3 == 2, "record").otherwise("note"))
    out = retrieval.search(kinds, _vectors(get), _queries(get), NOW, "lookup", keyword=functools.partial(_keyword, get))
    return big(memory.record_search(out, 15), "position").select("query_id", "chunk_id", "position")


@query(_ranked_sql("default") + " SELECT query_id, chunk_id, CASE WHEN sim_vector > 0 AND bm25 > 0 THEN 'hybrid' WHEN sim_vector > 0 THEN 'vector_only' WHEN bm25 > 0 THEN 'keyword_only' ELSE 'hybrid' END AS reason FROM ranked")
def expansion_reasons(get):
    return _full(get).select("query_id", "chunk_id", "reason")


# --- links, folds and scalars --------------------------------------------------------------------


@query("SELECT source_file_id, target_file_id AS target_path FROM doc_links WHERE target_file_id % 10 = 0")
def backlinks(get):
    """Links to every tenth target."""
    l = get("doc_links").select("source_file_id", F.col("target_file_id").alias("target_path"))
    return graph.backlinks(l, l.where("target_path % 10 = 0"))


@query("SELECT DISTINCT source_file_id, target_file_id FROM doc_links WHERE source_file_id % 10 = 0 AND target_file_id % 3 > 0")
def outlinks(get):
    """Resolved links of every tenth file."""
    l = get("doc_links").withColumn("link_type", F.when(F.col("target_file_id") % 3 == 0, "external").otherwise("wiki"))
    return graph.outlinks(l, l.where("source_file_id % 10 = 0"))


@query("SELECT chunk_id AS file_id, round(CASE WHEN chunk_id % 4 > 0 THEN pagerank ELSE (SELECT median(pagerank) FROM chunks WHERE chunk_id % 4 > 0) END, 9) AS pagerank FROM chunks")
def fill_median(get):
    """Link ranks, the median for files without."""
    c = get("chunks")
    out = graph.fill_median(c.select("file_id"), c.where("chunk_id % 4 > 0").select(F.col("file_id").alias("node"), "pagerank"))
    return out.select("file_id", F.round("pagerank", 9).alias("pagerank"))


@query("""WITH g AS (SELECT task_id, 'c' || (event_id % 3) AS comment_id, arg_max(actor, (timestamp, event_id)) FILTER (WHERE event_type = 'comment_added') AS author, arg_max('b' || event_id, (timestamp, event_id)) AS body, min(timestamp) FILTER (WHERE event_type = 'comment_added') AS created_at, max(timestamp) AS updated_at
FROM task_log WHERE event_type IN ('comment_added', 'comment_updated') GROUP BY 1, 2) SELECT * FROM g WHERE created_at IS NOT NULL""")
def fold_comments(get):
    return folds.fold_comments(get("task_log"))


@query("SELECT task_id, arg_max(other, (timestamp, event_id)) AS parent_id FROM (SELECT *, event_id % 5 = 0 AS cleared FROM task_log WHERE event_type = 'parent_set') GROUP BY task_id HAVING NOT arg_max(cleared, (timestamp, event_id))")
def fold_parents(get):
    return folds.fold_parents(get("task_log"))


@query("WITH t AS (SELECT DISTINCT task_id FROM task_log) SELECT task_id, coalesce(arg_max('s' || (event_id % 4), (timestamp, event_id)) FILTER (WHERE event_type = 'task_transferred'), 'home') AS space, arg_max('d' || event_id, (timestamp, event_id)) FILTER (WHERE event_type = 'task_transferred') AS display_id FROM t JOIN task_log USING (task_id) GROUP BY task_id")
def fold_transfers(get):
    return folds.fold_transfers(get("task_log"), get("task_log").select("task_id", F.lit("home").alias("space")).distinct())


@query("""WITH n AS (SELECT task_id, event_id % 30 AS chunk_id FROM task_log WHERE event_type LIKE 'note%' GROUP BY ALL HAVING arg_max(event_type, (timestamp, event_id)) = 'note_linked')
SELECT task_id, n.chunk_id::VARCHAR AS chunk_id, CASE WHEN c.chunk_id % 7 > 0 THEN path END AS path FROM n LEFT JOIN chunks c ON c.chunk_id = n.chunk_id AND c.chunk_id % 5 > 0""")
def note_links(get):
    """Notes that tasks link to, with their files where both are there."""
    n = folds.fold_pairs(get("task_log"), "note_linked", "note_unlinked", "chunk_id", "chunk_id")
    c = get("chunks").withColumn("chunk_id", F.col("chunk_id").cast("string"))
    return folds.note_links(n, c.where("chunk_id % 5 > 0"), c.where("chunk_id % 7 > 0"))


_RECORD = "e AS (SELECT *, (timestamp, event_id) AS o FROM record_log)"


@query(f"WITH {_RECORD} SELECT record_id, tag FROM (SELECT record_id, 'x' || (event_id % 4) AS tag, event_type <> 'tag_removed' AS live, o FROM e WHERE event_type IN ('record_created', 'tag_added', 'tag_removed')) GROUP BY record_id, tag HAVING arg_max(live, o)")
def fold_record_tags(get):
    return folds.fold_record_tags(get("record_log"))


@query(f"WITH {_RECORD} SELECT record_id, NULL::VARCHAR AS task_id, chunk::VARCHAR AS chunk_id FROM e WHERE event_type LIKE 'link%' GROUP BY record_id, chunk HAVING arg_max(event_type, o) = 'link_added'")
def fold_record_links(get):
    return folds.fold_record_links(get("record_log"))


@query(f"""WITH {_RECORD} SELECT record_id, arg_max('r' || event_id, o) FILTER (WHERE event_type = 'record_created') AS title, arg_max(CASE WHEN event_type = 'record_created' THEN 'active' ELSE 'archived' END, o) FILTER (WHERE event_type IN ('record_created', 'record_archived')) AS status,
arg_max('c' || (event_id % 3), o) FILTER (WHERE event_type = 'retention_set') AS retention, (arg_max(CASE WHEN event_type = 'record_created' THEN 0 ELSE 1 END, o) FILTER (WHERE event_type IN ('record_created', 'record_pinned')))::INT AS pinned,
(arg_max(CASE WHEN event_type = 'record_created' THEN 1 ELSE 0 END, o) FILTER (WHERE event_type IN ('record_created', 'payload_evicted')))::INT AS payload_available FROM e GROUP BY record_id HAVING count(*) FILTER (WHERE event_type = 'record_created') > 0""")
def fold_records(get):
    return folds.fold_records(get("record_log")).select("record_id", "title", "status", "retention", "pinned", "payload_available")


@query("""SELECT summary_id, CASE WHEN trust = 'trusted' THEN 2 WHEN trust = 'vetted' THEN 1 ELSE 0 END AS trust_rank, 'mem://' || space || '/episode/' || summary_id AS uri, space, summary_id::VARCHAR AS id FROM notes""")
def uris_and_trust(get):
    """URIs built and taken apart, and ranks of trust."""
    n = get("notes").select("summary_id", T.trust_rank(F.col("trust")).alias("trust_rank"), T.build_uri("mem", F.col("space"), F.lit("episode"), F.col("summary_id").cast("string")).alias("uri"))
    return n.withColumn("p", T.uri_parts(F.col("uri"), "mem")).select("summary_id", "trust_rank", "uri", "p.space", "p.id")


@query("""SELECT record_id, kind IN ('document', 'plan', 'review') AS embed, kind IN ('document', 'plan') AS summarize, kind <> 'snapshot' AS search FROM records""")
def record_policies(get):
    return get("records").select("record_id", records.policy(F.col("kind")).alias("p")).select("record_id", "p.*")


@query("""SELECT page_id, 'wiki' AS link_type, url AS target, 'page ' || page_id AS link_text FROM pages WHERE url IS NOT NULL UNION ALL SELECT page_id, 'wiki', 'Note ' || page_id, 'Note ' || page_id FROM pages
UNION ALL SELECT page_id, 'markdown', 'n' || page_id || '.md', 'own' FROM pages""")
def wiki_links(get):
    """Wiki links with and without a name, a markdown link, and an image, which is none."""
    i = F.col("page_id").cast("string")
    url = F.coalesce(F.concat(F.lit("[["), "url", F.lit("|page "), i, F.lit("]]")), F.lit(""))
    text = F.concat(url, F.lit(" and [[ Note "), i, F.lit(" ]] and [own](n"), i, F.lit(".md) ![image](x.png)"))
    return markdown.links(get("pages").select("page_id", text.alias("text")), key="page_id")


@query("""WITH n AS (SELECT summary_id, title || ': ' || content AS x FROM notes) SELECT summary_id, x AS reflection, x AS procedure, 'Goal ' || summary_id AS episode FROM n""")
def memory_abstracts(get):
    """L0 abstracts of reflections, procedures and episodes."""
    n, goal = get("notes"), F.concat(F.lit("Goal: Goal "), F.col("summary_id").cast("string"), F.lit("\nActions: a\nOutcome: done"))
    return n.select("summary_id", T.reflection_l0(F.col("title"), F.col("content")).alias("reflection"), T.procedure_l0(F.col("title"), F.col("content")).alias("procedure"), T.episode_l0(goal).alias("episode"))


@query(f"""WITH h AS (SELECT chunk_id, space, content, {_HEAD.format("content", 500)} AS h FROM chunks)
SELECT chunk_id, 'T' || chr(10) || chr(10) || CASE WHEN strlen(content) <= 500 THEN content WHEN regexp_matches(h, '[.!?]') THEN regexp_extract(h, '(?s)^(.*[.!?])', 1) ELSE h END || chr(10) || chr(10) || 'Tags: ' || space AS abstract FROM h""")
def record_abstracts(get):
    return get("chunks").select("chunk_id", T.record_abstract(F.lit("T"), F.col("content"), F.array("space")).alias("abstract"))


@query("""SELECT scope, count(*) AS n, sum(strlen(content))::BIGINT AS bytes FROM (SELECT tag AS scope, summary_id::VARCHAR AS id, content FROM notes WHERE tag IN ('k1', 'k2') UNION ALL
SELECT tag, 'record:' || record_id, title FROM records WHERE kind IN ('document', 'plan') AND status = 'active' AND tag = 'Brand#2') GROUP BY scope""")
def tag_scopes(get):
    """Sources of tags' summaries: episodes and active records."""
    n, r = get("notes"), get("records")
    s = n.select(F.col("summary_id").cast("string").alias("summary_id"), F.to_json(F.array("tag", F.lit("other"))).alias("tags"), "content", "created_at")
    own = r.select(F.col("record_id").cast("string").alias("record_id"), "tag", "kind", "status", F.col("title").alias("content"), F.col("updated_at").alias("created_at"))
    tags = n.sparkSession.createDataFrame([("k1",), ("k2",), ("Brand#2",)], "tag string")
    return episodes.tag_sources(s, own, tags).groupBy("scope").agg(F.count("*").alias("n"), F.sum(F.octet_length("content")).cast("bigint").alias("bytes"))


# --- ids -----------------------------------------------------------------------------------------


@query("""WITH t AS (SELECT task_id, 'TSK-' || lpad(task_id::VARCHAR, 10, '0') AS id, left(sha256(task_id::VARCHAR), 8) AS h, child_seq, space FROM tasks),
kids AS (SELECT p.id AS parent, c.child_seq, min(c.id) AS child FROM entity_links l JOIN t p ON p.task_id = l.from_id JOIN t c ON c.task_id = l.to_id WHERE edge_kind = 'parent_of' GROUP BY ALL),
s AS (SELECT *, task_id // 100 AS z FROM t WHERE task_id % 100 = 0),
q AS (SELECT DISTINCT * FROM (SELECT id AS input, NULL AS scope FROM s UNION ALL SELECT substr(id, 5, 3 + z % 8), CASE WHEN z % 3 = 0 THEN space END FROM s UNION ALL SELECT left(h, 2 + z % 7), CASE WHEN z % 2 = 0 THEN space END FROM s UNION ALL SELECT lower(left(id, 4 + z % 11)), NULL FROM s UNION ALL SELECT id || '.' || z % 10, NULL FROM s)),
b AS (SELECT input, scope, CASE WHEN instr(input, '-') > 0 THEN substr(input, 5) ELSE input END AS bare, CASE WHEN instr(input, '-') > 0 THEN upper(input) ELSE 'TSK-' || upper(input) END AS big FROM q),
c AS (SELECT *, regexp_full_match(bare, '[0-9a-f]{3,}') AS hex FROM b),
m AS (SELECT input, scope, bare, list(DISTINCT t.id) FILTER (WHERE hex AND t.h = bare) AS m1, list(DISTINCT t.id) FILTER (WHERE hex AND starts_with(t.h, bare)) AS m2, list(DISTINCT t.id) FILTER (WHERE length(bare) >= 4 AND starts_with(t.id, big)) AS m3
      FROM c LEFT JOIN t ON (starts_with(t.h, bare) OR starts_with(t.id, big)) AND (scope IS NULL OR t.space = scope) GROUP BY ALL),
f AS (SELECT m.*, coalesce(m1, m2, m3, []) AS f, input IN (SELECT id FROM t) AS is_id, k.child FROM m LEFT JOIN kids k ON k.parent = regexp_extract(input, '^(.*)[.]([0-9]+)$', 1) AND k.child_seq = TRY_CAST(regexp_extract(input, '^(.*)[.]([0-9]+)$', 2) AS BIGINT))
SELECT input, scope AS space, CASE WHEN is_id THEN input WHEN child IS NOT NULL THEN child WHEN len(f) = 1 THEN f[1] END AS task_id,
  CASE WHEN is_id THEN 'exact' WHEN child IS NOT NULL THEN 'child' WHEN len(f) = 1 THEN 'unique' WHEN len(f) > 1 THEN 'ambiguous' WHEN length(bare) < 4 THEN 'short' ELSE 'none' END AS verdict,
  CASE WHEN is_id OR child IS NOT NULL THEN 1 ELSE len(f) END AS n FROM f""")
def resolve_ids(get):
    """Ids, prefixes, short hashes and numbers of children, as typed for tasks with ids divisible by 100."""
    name = lambda c: F.concat(F.lit("TSK-"), F.lpad(F.col(c).cast("string"), 10, "0"))
    t = get("tasks").select("task_id", name("task_id").alias("id"), F.left(F.sha2(F.col("task_id").cast("string"), 256), F.lit(8)).alias("h"), "space", "child_seq")
    s = t.where("task_id % 100 = 0").withColumn("z", F.expr("cast(task_id div 100 as int)"))
    pair = lambda text, space="CAST(NULL AS STRING)": F.struct(F.expr(text).alias("input"), F.expr(space).alias("space"))
    typed = F.array(pair("id"), pair("substring(id, 5, 3 + z % 8)", "if(z % 3 = 0, space, NULL)"), pair("left(h, 2 + z % 7)", "if(z % 2 = 0, space, NULL)"), pair("lower(left(id, 4 + z % 11))"), pair("id || '.' || cast(z % 10 as string)"))
    inputs = s.select(F.explode(typed).alias("i")).select("i.input", "i.space").distinct()
    edges = get("entity_links").select(name("from_id").alias("from_id"), name("to_id").alias("to_id"), "edge_kind")
    return resolve.resolve(inputs, t.select(F.col("id").alias("task_id"), F.col("h").alias("display_id"), "space", "child_seq"), edges, project="TSK")
