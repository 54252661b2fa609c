"""Markdown sources: scans of folders, sections by headings, chunks within a token limit."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_hash, extract_links

MAX_TOKENS, CHUNKER_VERSION = 400, 2
CHUNK_SCHEMA = "ord int, content string, heading_path string, byte_start bigint, byte_end bigint, token_estimate bigint"
FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})")
ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
SETEXT = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")
INLINE = re.compile(r"!?\[([^\]]*)\]\([^)]*\)|(\*\*|__|\*|~~|`)(?=\S)(.+?)(?<=\S)\2")
BREAK = re.compile(rb"\r?\n\r?\n")


def scan_folder(spark: SparkSession, path: str, ignore: str | None = None) -> DataFrame:
    """path, content and modified of all *.md files below a folder; hidden ones and those that match ignore are left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(path)
    out = raw.select("path", F.decode("content", "UTF-8").alias("content"), F.col("modificationTime").alias("modified"))
    out = out.where(~F.col("path").rlike(r"/\.[^/]+"))
    return out.where(~F.col("path").rlike(ignore)) if ignore else out


def tokens(b: bytes) -> int:
    return -(-len(b) // 4)


def frontmatter(text: str) -> tuple[dict, int]:
    """The YAML block at a text's beginning, and the characters that it takes."""
    m = re.match(r"---[ \t]*\n(.*?)^(?:---|\.\.\.)[ \t]*(?:\n|$)", text, re.S | re.M)
    if not m:
        return {}, 0
    try:
        import yaml

        got = yaml.safe_load(m[1])
    except Exception:  # a block that is no YAML has no values
        got = None
    return got if isinstance(got, dict) else {}, m.end()


def plain(heading: str) -> str:
    """A heading's text without inline marks."""
    while (new := INLINE.sub(lambda m: m[1] if m[1] is not None else m[3], heading)) != heading:
        heading = new
    return heading


def headings(text: str, start: int) -> list[tuple[int, str, int, int]]:
    """(level, text, begin, end) in characters of ATX and setext headings outside of code."""
    out, at, fence, para = [], start, None, None
    for line in text[start:].splitlines(keepends=True):
        bare = line.rstrip("\r\n")
        f = FENCE.match(bare)
        if fence:
            if f and f[1][0] == fence[0] and len(f[1]) >= len(fence) and not bare.strip().strip(fence[0]):
                fence = None
            para = None
        elif f:
            fence, para = f[1], None
        elif m := ATX.match(bare):
            out.append((len(m[1]), plain((m[2] or "").strip()), at, at + len(line)))
            para = None
        elif para and SETEXT.match(bare):
            out.append((1 if bare.strip()[0] == "=" else 2, plain(text[para[0] : para[1]].strip()), para[0], at + len(line)))
            para = None
        elif bare.strip() and not bare.startswith(("    ", "\t", ">", "- ", "* ", "+ ")):
            para = (para[0] if para else at, at + len(bare))
        else:
            para = None
        at += len(line)
    return out


def sections(text: str) -> list[tuple[str, bytes, int, int, int]]:
    """(heading path, content, begin, end, begin of content) in bytes; headings nest by level."""
    _, start = frontmatter(text)
    found = headings(text, start)
    size = lambda s: len(s.encode())
    spans = [("", start, start, found[0][2] if found else len(text))]
    stack: list[tuple[int, str]] = []
    for k, (level, name, begin, end) in enumerate(found):
        stack = [x for x in stack if x[0] < level] + [(level, name)]
        spans.append((" > ".join(f"{'#' * n} {t}" for n, t in stack), begin, end, found[k + 1][2] if k + 1 < len(found) else len(text)))
    out = []
    for k, (path, begin, inner, end) in enumerate(spans):
        raw = text[inner:end]
        content = raw.strip()
        if content or k:
            lead = size(text[:inner]) + size(raw[: len(raw) - len(raw.lstrip())])
            out.append((path, content.encode(), size(text[:begin]), size(text[:end]), lead))
    return out


def sentences(b: bytes, most: int) -> list[bytes]:
    """Pieces of at most most tokens, each to the last full stop, question or exclamation mark within."""
    out = []
    b = b.strip()
    while tokens(b) > most:
        end = min(len(b), most * 4)
        while end < len(b) and b[end] & 0xC0 == 0x80:
            end -= 1
        at = max(b.rfind(c, 0, end - 1) for c in (b".", b"?", b"!"))
        cut = at + 1 if at >= 0 else end
        out.append(b[:cut].strip())
        b = b[cut:].lstrip()
    return [x for x in [*out, b] if x]


def paragraphs(b: bytes) -> list[tuple[bytes, int]]:
    """Paragraphs and where they begin; blank lines part them."""
    out, at = [], 0
    for end, after in [*(m.span() for m in BREAK.finditer(b)), (len(b), len(b))]:
        raw = b[at:end]
        if raw.strip():
            out.append((raw.strip(), at + len(raw) - len(raw.lstrip())))
        at = after
    return out


def pack_section(path: str, b: bytes, end: int, base: int, most: int) -> list[tuple[str, str, int, int, int]]:
    """Chunks of a section over the limit: paragraphs packed greedily, long ones by sentences."""
    out: list[tuple[str, str, int, int, int]] = []
    held, begin = b"", None

    def put(piece: bytes, a: int, z: int) -> None:
        out.append((path, piece.decode(), a, z, tokens(piece)))

    for para, at in paragraphs(b):
        a = base + at
        begin = a if begin is None else begin
        if tokens(para) > most:
            if held:
                put(held, begin, a)
            held, p = b"", a
            for piece in sentences(para, most):
                put(piece, p, p + len(piece))
                p += len(piece)
                while p < a + len(para) and b[p - base : p - base + 1].isspace():
                    p += 1
            begin = a + len(para)
            continue
        if held and tokens(held) + tokens(para) + 1 > most:
            put(held, begin, a)
            held, begin = b"", a
        held = held + b"\n\n" + para if held else para
    if held:
        put(held, begin, end)
    return out


def chunk(text: str | None, most: int = MAX_TOKENS) -> list[tuple[int, str, str, int, int, int]]:
    """(ord, content, heading path, begin, end, tokens) of a text's chunks; bytes."""
    out = []
    for path, b, begin, end, base in sections(text or ""):
        if not b:
            continue
        if tokens(b) <= most:
            out.append((path, b.decode(), begin, end, tokens(b)))
        else:
            out.extend(pack_section(path, b, end, base, most))
    return [(k, content, path, a, z, n) for k, (path, content, a, z, n) in enumerate(out)]


def chunk_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = MAX_TOKENS) -> DataFrame:
    """key and the chunks of each text, with chunk_hash."""

    def run(batches):
        for pdf in batches:
            rows = [(k, *c) for k, t in zip(pdf[key], pdf[text], strict=True) for c in chunk(t, most)]
            yield pd.DataFrame(rows, columns=[key, "ord", "content", "heading_path", "byte_start", "byte_end", "token_estimate"])

    schema = f"{key} {docs.schema[key].dataType.simpleString()}, {CHUNK_SCHEMA}"
    return docs.select(key, text).mapInPandas(run, schema).withColumn("chunk_hash", content_hash(F.col("content")))


def document_sections(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ord, heading_path and content of each text's sections, in order."""

    def run(batches):
        for pdf in batches:
            rows = [(k, n, path, body.decode()) for k, t in zip(pdf[key], pdf[text], strict=True) for n, (path, body, *_) in enumerate(sections(t or ""))]
            yield pd.DataFrame(rows, columns=[key, "ord", "heading_path", "content"])

    return docs.select(key, text).mapInPandas(run, f"{key} {docs.schema[key].dataType.simpleString()}, ord int, heading_path string, content string")


def links(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, target, link_text and link_type of every link."""
    return docs.select(key, F.explode(extract_links(F.col(text))).alias("l")).select(key, "l.*")


def signals(fm: dict) -> tuple[list[str], float]:
    """Tags and importance (0.5 without one, within 0 and 1) of a front matter."""
    tags = fm.get("tags")
    tags = [str(t) for t in tags if isinstance(t, (str, int, float))] if isinstance(tags, list) else []
    value = fm.get("importance")
    return tags, min(max(float(value), 0.0), 1.0) if isinstance(value, (int, float)) and not isinstance(value, bool) else 0.5
