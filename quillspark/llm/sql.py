"""DuckDB SQL for the rows of the queries that SQL can express."""

from __future__ import annotations

from .decontaminate import WIDTH
from .filter_audit import CAPITAL_PERCENT, DISTINCT_PERCENT, FEWEST_WORDS, FILTERS
from .line_dedup import MANY, MIN_PAGES, RATIO
from .quality_rules import RULES, STOP_FORMS
from .secret_scan import ALL_HEX, ALLOW, ALNUM, BASE, CLASSES, RUN


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


OP2 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, text FROM documents),
l AS (SELECT rid, source, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
t AS (SELECT rid, source, text, pos, line, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM l),
n AS (SELECT source, count(*) AS n_host FROM d GROUP BY source),
u AS (SELECT DISTINCT rid, source, text, key FROM t WHERE key <> ''),
asked AS (SELECT source, key, count(*) AS n_pages, n_host FROM u JOIN n USING (source) GROUP BY source, key, n_host
          HAVING count(*) >= {MIN_PAGES} AND count(DISTINCT text) > 1 AND count(*) > {RATIO}::DOUBLE * n_host),
alone AS (SELECT rid FROM d LEFT JOIN (SELECT rid, count(*) AS n, count(asked.key) AS n_asked FROM u LEFT JOIN asked ON u.source = asked.source AND u.key = asked.key GROUP BY rid) USING (rid)
          WHERE 2 * coalesce(n_asked, 0) <= coalesce(n, 0)),
n2 AS (SELECT source, count(*) AS n_host FROM d JOIN alone USING (rid) WHERE text IS NOT NULL GROUP BY source),
bad AS (SELECT u.source, u.key FROM u JOIN alone USING (rid) JOIN asked ON u.source = asked.source AND u.key = asked.key JOIN n2 ON n2.source = u.source GROUP BY u.source, u.key, n2.n_host
        HAVING count(*) >= {MIN_PAGES} AND count(DISTINCT text) > 1 AND count(*) > {RATIO}::DOUBLE * n2.n_host
        UNION SELECT source, key FROM asked WHERE 2 * n_pages > n_host AND n_pages >= {MANY}),
kept AS (SELECT t.rid, string_agg(t.line, chr(10) ORDER BY t.pos) FILTER (WHERE bad.key IS NULL) AS text,
                count(*) FILTER (WHERE t.key <> '') AS n_lines, count(*) FILTER (WHERE bad.key IS NOT NULL) AS n_dropped
         FROM t LEFT JOIN bad ON t.source = bad.source AND t.key = bad.key GROUP BY t.rid)
SELECT d.doc_id, d.source, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text,
       coalesce(kept.n_lines, 0) AS n_lines, coalesce(kept.n_dropped, 0) AS n_dropped
FROM d LEFT JOIN kept USING (rid)
"""


def _rule(r) -> str:
    named = {"mean_word_chars": "word_chars / w", "symbol_ratio": "n_symbols / w", "shout_ratio": "n_shouts / w", "stop_word_ratio": "n_stop_words / w", "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)::DOUBLE", "repeat_word_ratio": "n_repeat_words / w"}
    tests = [f"{named[r.measure]} >= {r.low}"] * (r.low is not None) + [f"{named[r.measure]} <= {r.high}"] * (r.high is not None)
    return f"(n_words < {r.min_words} OR ({' AND '.join(tests)}))"


OP10 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT rid, i, list_reduce(words[i:i + 4], lambda a, b: a || chr(10) || b) AS g
        FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM s WHERE len(words) >= 5)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM rep, range(5) r(k) GROUP BY rid),
m AS (SELECT s.doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, length(regexp_replace(text, '[^!]', '', 'g'))::BIGINT AS n_shouts,
             len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
             len(list_filter(words, lambda x: x IN ({", ".join(map(quoted, STOP_FORMS))})))::BIGINT AS n_stop_words, greatest(len(words), 1)::DOUBLE AS w
      FROM s LEFT JOIN cov USING (rid)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {" AND ".join(map(_rule, RULES))} AS kept, n_stop_words FROM b
"""

_KINDS = " ".join(f"WHEN {k} THEN '{kind}'" for k, kind in enumerate([b[0] for b in BASE] + [c.kind for c in CLASSES]))


def _candidates(k: int, c) -> str:
    run = 3 if c.run == ALNUM else 4
    hexes = f" AND regexp_matches(m, '{ALL_HEX}')" if "hex" in c.kind else ""
    return f"SELECT rid, m, start, {k} AS kind, {c.width} AS w, {c.bits}::DOUBLE AS bits FROM cand WHERE run = {run} AND length(m) BETWEEN {c.least} AND {c.most}{hexes}"


OP9 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
f AS (
  SELECT rid, text, 0 AS kind, regexp_extract_all(text, {quoted(BASE[0][1])}, 0) AS ms, regexp_extract_all(text, {quoted(BASE[0][1])}, 2) AS gs FROM d
  UNION ALL SELECT rid, text, 1, regexp_extract_all(text, {quoted(BASE[1][1])}), NULL FROM d
  UNION ALL SELECT rid, text, 2, regexp_extract_all(text, {quoted(BASE[2][1])}), NULL FROM d
  UNION ALL SELECT rid, text, 3, regexp_extract_all(text, '{ALNUM}'), NULL FROM d
  UNION ALL SELECT rid, text, 4, regexp_extract_all(text, '{RUN}'), NULL FROM d
),
e AS (SELECT rid, kind, i, ms[i] AS m, gs[i] AS g, list_reduce(list_prepend({{'at': 0, 'm': ''}}, list_transform(ms[1:i], lambda m: {{'at': 0, 'm': m}})),
        lambda a, b: {{'at': a.at + instr(substr(text, a.at + 1), b.m) - 1 + length(b.m), 'm': b.m}}).at AS stop
      FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM f)),
base AS (SELECT rid, kind, stop - length(m) AS start, stop FROM e WHERE kind IN (1, 2) OR kind = 0 AND length(g) >= 8),
cand AS (SELECT rid, m, kind AS run, stop - length(m) AS start FROM e WHERE kind >= 3 AND NOT ({" OR ".join(f"regexp_matches(m, {quoted(a)})" for a in ALLOW)})),
classed AS ({" UNION ALL ".join(_candidates(k, c) for k, c in enumerate(CLASSES, len(BASE)))}),
win AS (SELECT rid, start, kind, w, list_filter(range(0, length(m) - w + 1), lambda i: list_aggregate(string_split(substr(m, i + 1, w), ''), 'entropy') >= bits - 1e-9 / w) AS hits FROM classed),
found AS (SELECT rid, kind, start, stop FROM base UNION ALL SELECT rid, kind, start + hits[1], start + hits[-1] + w FROM win WHERE len(hits) > 0),
named AS (SELECT rid, kind, start, stop, (CASE kind {_KINDS} END) || ':' || start || ':' || stop AS s FROM found),
agg AS (SELECT rid, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
               string_agg(s, ',' ORDER BY start, kind) FILTER (WHERE kind < 3) AS base, string_agg(s, ',' ORDER BY start, kind, stop) AS spans FROM named GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN agg USING (rid)
"""

OP7 = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT rid, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM d),
s AS (SELECT DISTINCT rid, list_reduce(words[i:i + 2], lambda a, b: a || ' ' || b) AS g
      FROM (SELECT rid, words, unnest(range(1, greatest(len(words) - 2, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
p AS (SELECT a.rid AS x, b.rid AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.rid < b.rid GROUP BY a.rid, b.rid),
e AS (SELECT x, y FROM p JOIN n a ON a.rid = x JOIN n b ON b.rid = y WHERE 100 * k >= 90 * (a.n + b.n - k)),
e2 AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT rid AS x, rid AS y FROM d UNION SELECT r.x, e2.y FROM r JOIN e2 ON r.y = e2.x),
c AS (SELECT r.x AS rid, min(d.doc_id) AS component_id FROM r JOIN d ON d.rid = r.y GROUP BY r.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM d LEFT JOIN n USING (rid) LEFT JOIN c USING (rid)
"""

_WORDS8 = r"coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"
OP8 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS8} AS words FROM documents),
b AS (SELECT item_id, {_WORDS8} AS words FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(words), {WIDTH}) AS k, list_reduce(words[i:i + {WIDTH - 1}], lambda a, b: a || ' ' || b) AS g
       FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - {WIDTH - 1}, 1) + 1)) AS i FROM b WHERE len(words) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT rid, k, i, list_reduce(words[i:i + k - 1], lambda a, b: a || ' ' || b) AS g
       FROM (SELECT rid, k, words, unnest(range(1, len(words) - k + 2)) AS i FROM d, ks WHERE len(words) >= k)),
h AS (SELECT rid, i, bw.k, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.k = bw.k),
n AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS pos FROM h) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM h) GROUP BY rid)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN t USING (rid)
"""

OP11 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
win AS (SELECT rid, doc_id, i, list_reduce(words[i:i + 19], lambda a, b: a || ' ' || b) AS g
        FROM (SELECT rid, doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM d WHERE len(words) >= 20)),
hit AS (SELECT rid, i FROM (SELECT rid, doc_id, i, first_value({'d': doc_id, 'i': i}) OVER (PARTITION BY g ORDER BY doc_id, i) AS f FROM win)
        WHERE doc_id > f.d OR doc_id = f.d AND i > f.i),
cov AS (SELECT DISTINCT rid, i + k AS pos FROM hit, range(20) r(k)),
w AS (SELECT rid, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM d),
k AS (SELECT w.rid, count(*) FILTER (WHERE cov.pos IS NOT NULL) AS n_removed, string_agg(word, ' ' ORDER BY w.pos) FILTER (WHERE cov.pos IS NULL) AS kept
      FROM w LEFT JOIN cov ON w.rid = cov.rid AND w.pos = cov.pos GROUP BY w.rid)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (rid)
"""

OP13 = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM d),
f AS (SELECT doc_id, part, [len(words) < {FEWEST_WORDS}, 100 * len(list_distinct(words)) < {DISTINCT_PERCENT} * len(words),
             100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {CAPITAL_PERCENT} * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(least < doc_id, false)] AS fails,
             coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1), false) AS good, coalesce(doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1), false) AS toxic FROM w),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f GROUP BY part, fails),
x(k) AS (SELECT unnest(range(1, 6))),
o AS (SELECT [a.k, b.k, c.k, d.k, e.k] AS ks FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
s AS (SELECT ks, list_reduce(list_transform(ks, lambda k: '{FILTERS}'[k]), lambda a, b: a || b) AS filter_order, unnest(range(1, 6)) AS step FROM o),
r AS (SELECT part, filter_order, step, ks[step] AS own, fails[ks[step]] AS bad, len(list_filter(ks[:step - 1], lambda k: fails[k])) > 0 AS before,
             len(list_filter(fails, lambda y: y)) AS n_fails, n, good, toxic FROM c, s),
t AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (WHERE NOT bad AND NOT before), 0) AS kept, coalesce(sum(n) FILTER (WHERE bad AND NOT before), 0) AS removed,
             coalesce(sum(n) FILTER (WHERE bad AND before), 0) AS redundant, coalesce(sum(n) FILTER (WHERE bad AND n_fails = 1), 0) AS unique_fails,
             coalesce(sum(good) FILTER (WHERE bad AND NOT before), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE bad AND NOT before), 0) AS toxic_lost
      FROM r GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM t
"""

ORACLE_SQL = {"op11_substring_dedup": OP11, "op13_filter_audit": OP13, "op7_ngram_jaccard": OP7, "op8_decontaminate": OP8, "op2_line_dedup": OP2, "op9_secret_scan": OP9, "op10_quality_rules": OP10}
