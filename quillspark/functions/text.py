"""Text scalars as Column expressions: token estimates, hashes, capsules, abstracts, links, URIs.

All run on the JVM.  Byte limits are those of UTF-8, as token estimates count bytes.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

L0_BYTES, L1_BYTES, EXCERPT_BYTES = 400, 8000, 500
SPACES = r"\s"
#: Fixed patterns: code in backticks, identifiers in capitals, identifiers in camel case.
BACKTICK, CAPITALS, CAMEL = r"`([^`]{2,40})`", r"[A-Z][A-Z0-9_]{2,}", r"[A-Z][a-z]+(?:[A-Z][a-z]+)+"
#: Bounds of a word in any script, the same in all versions of Java.
BEFORE, AFTER = r"(?<![\p{L}\p{M}\p{N}_])", r"(?![\p{L}\p{M}\p{N}_])"
WIKI, MARKDOWN = r"\[\[([^\]\|]+?)(?:\|([^\]]+?))?\]\]", r"(!)?\[([^\]]*)\]\(([^)]+)\)"
PRIORITIES = {0: "critical", 1: "high", 2: "medium", 3: "low"}


def let(value: Column, body) -> Column:
    """body(value), with value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def trim(s: Column) -> Column:
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def estimate_tokens(s: Column) -> Column:
    """ceil(UTF-8 bytes / 4)."""
    return F.ceil(F.octet_length(s) / 4).cast("long")


def normalize(s: Column) -> Column:
    """LF line ends, no white space at line ends, no final newline."""
    s = F.regexp_replace(F.regexp_replace(s, "\r\n", "\n"), r"\n$(?![\s\S])", "")
    return F.regexp_replace(s, r"[^\S\n]+(?=\n|$(?![\s\S]))", "")


def content_hash(s: Column) -> Column:
    """SHA-256 of the normalised text: equal for texts that differ in line ends and trailing blanks alone."""
    return F.sha2(normalize(s), 256)


def ts_to_iso(ts: Column) -> Column:
    """Epoch seconds as RFC 3339 in UTC, whatever the session's zone."""
    day = F.date_add(F.to_date(F.lit("1970-01-01")), F.floor(ts / 86400).cast("int"))
    rest = F.pmod(ts, F.lit(86400))
    return F.format_string("%sT%02d:%02d:%02d+00:00", day.cast("string"), F.floor(rest / 3600), F.floor(F.pmod(rest, F.lit(3600)) / 60), F.pmod(rest, F.lit(60)))


def parse_timestamp(s: Column) -> Column:
    """Epoch seconds of an integer, an RFC 3339 text or a naive ISO text (taken as UTC); else null."""
    zoned = F.when(s.rlike(r"(Z|z|[+-]\d\d:\d\d)$"), s).otherwise(F.concat(s, F.lit("Z")))
    iso = F.when(s.rlike(r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?(Z|z|[+-]\d\d:\d\d)?$"), F.expr("1")).isNotNull()
    return F.coalesce(F.when(s.rlike(r"^[+-]?\d+$"), s).try_cast("long"), F.when(iso, zoned).try_cast("timestamp").cast("long"))


def recency(age_seconds: Column) -> Column:
    """e-folding of 30 days."""
    return F.exp(-age_seconds / F.lit(30 * 24 * 3600.0))


def sentence_end(s: Column) -> Column:
    """Up to and with the first full stop before a space; else all."""
    at = F.instr(s, ". ")
    return F.when(at > 0, F.substring(s, F.lit(1), at)).otherwise(s)


def first_sentence(content: Column) -> Column:
    """The first sentence of the first paragraph, trimmed content given."""

    def of(c: Column) -> Column:
        at = F.instr(c, "\n\n")
        first = trim(F.substring(c, F.lit(1), at - 1))
        return F.when((at > 0) & (first != ""), sentence_end(first)).otherwise(sentence_end(c))

    return let(trim(content), of)


def key_terms(content: Column) -> Column:
    """Up to five distinct terms: code in backticks, then capitals, then camel case, in order of the text."""
    found = F.concat(F.regexp_extract_all(content, F.lit(BACKTICK), F.lit(1)), F.regexp_extract_all(content, F.lit(BEFORE + CAPITALS + AFTER), F.lit(0)), F.regexp_extract_all(content, F.lit(BEFORE + CAMEL + AFTER), F.lit(0)))
    return F.slice(F.array_distinct(found), 1, 5)


def head(s: Column, n_bytes: int) -> Column:
    """The characters that begin within the first n bytes."""
    latin = F.decode(F.substring(F.encode(s, "UTF-8"), 1, n_bytes), "ISO-8859-1")
    return F.when(F.octet_length(s) <= n_bytes, s).otherwise(F.left(s, F.length(F.regexp_replace(latin, "[\\x{80}-\\x{BF}]", ""))))


def cut_at_word(s: Column, n_bytes: int) -> Column:
    """head, back to its last space if that lies in its second half (by bytes)."""

    def of(h: Column) -> Column:
        at = F.length(h) - F.instr(F.reverse(h), " ")
        before = F.left(h, at.cast("int"))
        return F.when((F.instr(h, " ") > 0) & (F.octet_length(before) > F.floor(F.octet_length(h) / 2)), before).otherwise(h)

    return F.when(F.octet_length(s) <= n_bytes, s).otherwise(let(head(s, n_bytes), of))


def _with_terms(text: Column, before: str, terms: Column) -> Column:
    return let(terms, lambda t: F.when(F.size(t) > 0, F.concat(text, F.lit(before), F.array_join(t, ", "))).otherwise(text))


def _titled(title: Column, text: Column) -> Column:
    return F.when(title == "", text).otherwise(F.concat(title, F.lit(": "), text))


def chunk_l0(heading_path: Column, content: Column) -> Column:
    """heading: first sentence | key terms, within 400 bytes; the heading alone for empty content."""
    full = let(trim(content), lambda c: cut_at_word(_with_terms(_titled(heading_path, first_sentence(c)), " | ", key_terms(c)), L0_BYTES))
    return F.when(trim(content) == "", heading_path).otherwise(full)


def episode_l0(content: Column) -> Column:
    """The goal in the first line, else the first outcome that is not empty."""

    def of(lines: Column) -> Column:
        first = lines[0]
        goal = trim(F.when(first.startswith("Goal:"), F.substring(first, F.lit(6), F.length(first))).otherwise(first))
        outcomes = F.filter(F.transform(F.filter(F.slice(lines, F.lit(2), F.size(lines)), lambda x: x.startswith("Outcome:")), lambda x: trim(F.substring(x, F.lit(9), F.length(x)))), lambda x: x != "")
        return F.when(goal != "", cut_at_word(goal, L0_BYTES)).otherwise(cut_at_word(F.coalesce(F.get(outcomes, F.lit(0)), F.lit("")), L0_BYTES))

    return let(F.split(trim(content), "\r?\n"), of)


def reflection_l0(title: Column, content: Column) -> Column:
    """title: first paragraph. Key: terms."""

    def of(c: Column) -> Column:
        return F.when(c == "", cut_at_word(title, L0_BYTES)).otherwise(cut_at_word(_with_terms(_titled(title, trim(F.substring_index(c, "\n\n", 1))), ". Key: ", key_terms(c)), L0_BYTES))

    return let(trim(content), of)


def procedure_l0(title: Column, content: Column) -> Column:
    """title: first line. Key: terms."""

    def of(c: Column) -> Column:
        return F.when(c == "", cut_at_word(title, L0_BYTES)).otherwise(cut_at_word(_with_terms(_titled(title, trim(F.substring_index(c, "\n", 1))), ". Key: ", key_terms(c)), L0_BYTES))

    return let(trim(content), of)


def extractive_l1(content: Column) -> Column:
    """Three paragraphs and the key terms of the rest, within 8000 bytes."""

    def of(paras: Column) -> Column:
        lead = F.array_join(F.slice(paras, 1, 3), "\n\n")
        rest = let(key_terms(F.array_join(F.slice(paras, F.lit(4), F.greatest(F.size(paras) - 3, F.lit(0))), " ")), lambda t: F.when(F.size(t) > 0, F.concat(F.lit("\n\n...\n\nKey terms: "), F.array_join(t, ", "))).otherwise(F.lit("\n\n...")))
        return cut_at_word(F.when(F.size(paras) > 3, F.concat(lead, rest)).otherwise(lead), L1_BYTES)

    return let(F.split(trim(content), "\n\n"), of)


def stub_sentence(content: Column) -> Column:
    """First sentence of a stub: to the first '. ', else 200 bytes of a text that ends in a full stop, else its first line or 200 bytes."""

    def of(c: Column) -> Column:
        line = F.instr(c, "\n")
        other = F.when(c.endswith("."), head(c, 200)).when(line > 0, F.substring(c, F.lit(1), line - 1)).otherwise(head(c, 200))
        return trim(F.when(F.instr(c, ". ") > 0, sentence_end(c)).otherwise(other))

    return let(trim(content), of)


def stub_capsule(title: Column, content: Column) -> Column:
    """title — first sentence, whichever is there."""
    parts = F.filter(F.array(trim(F.coalesce(title, F.lit(""))), stub_sentence(F.coalesce(content, F.lit("")))), lambda x: x != "")
    return F.array_join(parts, " — ")


def _summary(description: Column) -> Column:
    """First sentence by '. ', else first line; empty for none."""

    def of(d: Column) -> Column:
        line = F.instr(d, "\n")
        return F.when(F.instr(d, ". ") > 0, sentence_end(d)).when(line > 0, F.substring(d, F.lit(1), line - 1)).otherwise(d)

    return let(trim(F.coalesce(description, F.lit(""))), of)


def _sentences(parts: list[Column]) -> Column:
    return F.concat(F.array_join(F.filter(F.array(*parts), lambda x: x != ""), ". "), F.lit("."))


def _tagged(labels: Column) -> Column:
    return F.when(F.size(labels) > 0, F.concat(F.lit("Tags: "), F.array_join(labels, ", "))).otherwise(F.lit(""))


def priority_label(priority: Column) -> Column:
    out = F.lit("backlog")
    for k, name in PRIORITIES.items():
        out = F.when(priority == k, name).otherwise(out)
    return out


def task_capsule(title: Column, description: Column, labels: Column, priority: Column) -> Column:
    """title. summary (1000 characters). Tags: labels. Priority: label."""
    return _sentences([title, F.left(_summary(description), F.lit(1000)), _tagged(labels), F.concat(F.lit("Priority: "), priority_label(priority))])


def outcome_capsule(title: Column, reason: Column) -> Column:
    r = trim(F.coalesce(reason, F.lit("")))
    return F.when(r == "", F.concat(title, F.lit(". Completed."))).otherwise(F.concat(title, F.lit(". Outcome: "), r, F.lit(".")))


def record_capsule(title: Column, kind: Column, description: Column, tags: Column) -> Column:
    """title. Kind: kind. summary (200 bytes, no final stops). Tags: tags."""
    return _sentences([title, F.concat(F.lit("Kind: "), kind), F.regexp_replace(head(_summary(description), 200), r"\.+$", ""), _tagged(tags)])


def record_abstract(title: Column, content: Column, tags: Column) -> Column:
    """title, an excerpt of 500 bytes back to its last sentence end, tags."""
    ended = let(head(content, EXCERPT_BYTES), lambda h: F.when(h.rlike(r"[.!?]"), F.regexp_extract(h, r"^([\s\S]*[.!?])", 1)).otherwise(h))
    excerpt = F.when(F.octet_length(content) <= EXCERPT_BYTES, content).otherwise(ended)
    return F.concat(title, F.lit("\n\n"), excerpt, F.when(F.size(tags) > 0, F.concat(F.lit("\n\nTags: "), F.array_join(tags, ", "))).otherwise(F.lit("")))


def extract_links(content: Column) -> Column:
    """array<struct<target, link_text, link_type>>: wiki links, then markdown links that are not images."""
    wiki = F.transform(
        F.arrays_zip(F.regexp_extract_all(content, F.lit(WIKI), F.lit(1)).alias("t"), F.regexp_extract_all(content, F.lit(WIKI), F.lit(2)).alias("d")),
        lambda x: F.struct(trim(x["t"]).alias("target"), F.when(F.coalesce(x["d"], F.lit("")) == "", trim(x["t"])).otherwise(trim(x["d"])).alias("link_text"), F.lit("wiki").alias("link_type")),
    )
    md = F.arrays_zip(*[F.regexp_extract_all(content, F.lit(MARKDOWN), F.lit(k)).alias(n) for k, n in ((1, "i"), (2, "t"), (3, "u"))])
    plain = F.transform(F.filter(md, lambda x: F.coalesce(x["i"], F.lit("")) != "!"), lambda x: F.struct(trim(x["u"]).alias("target"), x["t"].alias("link_text"), link_type(trim(x["u"])).alias("link_type")))
    return F.concat(wiki, plain)


def link_type(url: Column) -> Column:
    return F.when(url.startswith("http://") | url.startswith("https://"), "external").otherwise("markdown")


DOMAINS = "record|task|memory|episode|reflection|procedure"


def uri_parts(uri: Column, scheme: str) -> Column:
    """struct<space, domain, id> of scheme://space/domain/id; null for anything else."""
    p = rf"^{scheme}://([^/]+)/({DOMAINS})/([^/]+)$"
    return F.when(uri.rlike(p), F.struct(*[F.regexp_extract(uri, p, k).alias(n) for k, n in ((1, "space"), (2, "domain"), (3, "id"))]))


def build_uri(scheme: str, space: Column, domain: Column, id_: Column) -> Column:
    return F.concat(F.lit(f"{scheme}://"), space, F.lit("/"), domain, F.lit("/"), id_)


def trust_rank(trust: Column) -> Column:
    """untrusted < vetted < trusted."""
    return F.when(trust == "trusted", 2).when(trust == "vetted", 1).otherwise(0)


def backoff_seconds(attempts: Column) -> Column:
    """30 s, doubled for each attempt after the first, at most six times."""
    return (30 * F.pow(F.lit(2.0), F.least(F.greatest(attempts - 1, F.lit(0)), F.lit(6)))).cast("long")


def sanitize_query(s: str) -> str:
    """Bare tokens in quotes, phrases as they are, an open quote closed."""
    out, i = [], 0
    s = s.strip()
    while i < len(s):
        if s[i] == '"':
            end = s.find('"', i + 1)
            out.append(s[i:] + '"' if end < 0 else s[i : end + 1])
            i = len(s) if end < 0 else end + 1
        elif s[i].isspace():
            out.append(s[i])
            i += 1
        else:
            end = i
            while end < len(s) and not s[end].isspace() and s[end] != '"':
                end += 1
            out.append(f'"{s[i:end]}"')
            i = end
    return "".join(out)


def time_scope(scope: str, now: int) -> int | None:
    """Epoch seconds of '7d' or '24h' before now; None for anything else."""
    scope = scope.strip()
    n, unit = scope[:-1].strip(), scope[-1:]
    return now - int(n) * {"d": 86400, "h": 3600}[unit] if n.isdigit() and unit in ("d", "h") else None


#: Fixed words that say nothing about a project.
NOISE = ("app", "application", "service", "svc", "server", "api", "the")


def project_prefix(name: str) -> str:
    """Three capitals for a project's name.

    One word: its first letter and the consonants after it; two: both first letters and a consonant
    of the longer word next to its letter; more: the first letters, each once.
    """
    words = [w for w in re.split(r"[-_ ]+", name) if w and not re.fullmatch(r"[0-9]+", w) and w.lower() not in NOISE]
    consonants = lambda w: re.findall(r"[B-DF-HJ-NP-TV-Zb-df-hj-np-tv-z]", w[1:])
    if not words:
        return "BRN"
    if len(words) == 1:
        w = words[0]
        raw = (w[0] + "".join(consonants(w)[:2]))[:3]
        raw += "".join(re.findall(r"[A-Za-z]", w[1:]))[: 3 - len(raw)]
    elif len(words) == 2:
        a, b = words
        longer = a if len(a.encode()) >= len(b.encode()) else b
        extra = (consonants(longer) or [longer[1:2] or "X"])[0]
        raw = a[0] + extra + b[0] if longer is a else a[0] + b[0] + extra
    else:
        letters = list(dict.fromkeys(w[0].upper() for w in words))[:3]
        for w in words:
            new = [c.upper() for c in consonants(w) if c.upper() not in letters]
            if len(letters) < 3 and new:
                letters.append(new[0])
        raw = "".join(letters)
    letters = re.sub(r"[^A-Z]", "", raw.upper())
    return (letters + "XXX")[:3] if letters else "BRN"
