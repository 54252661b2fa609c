"""Secret scans on DataFrame functions alone: three base patterns, and sliding-window Shannon
entropy per character class over candidate strings.

Base patterns (leftmost, non-overlapping per kind; matches that fail the length are dropped after
they have consumed their text): assign, access, hex.  The entropy method adds spans and never
removes one.  Candidates are maximal runs: of letters and digits (16 to 23 of them, or 24 and more of
hex digits alone), and of these and + / _ = - (24 and more).  So KEY=HEX is seen, and hex digits
within a longer word are not.  A window of ``width`` characters
slides over a candidate, and the counts of its characters, hence sum(c * log2 c), change by one character in
and one out at each step.  The span runs from the first to the last window whose entropy reaches the
class's threshold.  Candidates that the allow-list fits (words, UUIDs, placeholders, alphabets, runs
of digits) are suppressed; the allow-list never touches base spans.

Null texts count as empty and have no spans.  Texts are scanned whole; positions are code points,
ends exclusive.  Each input row gives one output row; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick
from .quality_rules import let

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: kind, pattern, group whose length counts, least length.  hex runs and access keys are maximal, so
#: that their length may stand in the pattern without changing what is consumed.
BASE = (("assign", ASSIGN, 2, 8), ("access", r"AKIA[A-Z0-9]{12,}", 0, 16), ("hex", r"[0-9a-f]{32,}", 0, 32))


@dataclass(frozen=True)
class CharClass:
    """A kind of candidates: runs of a pattern of some length, all of an alphabet's characters."""

    kind: str
    run: str
    alphabet: str
    width: int
    bits: float
    least: int
    most: int = 2**31 - 1


DIGITS, LOW, UP = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALNUM, RUN, ALL_HEX = r"[A-Za-z0-9]{16,}", r"[A-Za-z0-9+/_=-]{24,}", r"^[0-9A-Fa-f]*$"
CLASSES = (
    CharClass("entropy_hex", ALNUM, DIGITS + "abcdefABCDEF", 24, 3.05, 24),
    CharClass("entropy_base64", RUN, DIGITS + LOW + UP + "+/_=-", 24, 3.93, 24),
    CharClass("entropy_short_hex", ALNUM, DIGITS + "abcdefABCDEF", 16, 2.75, 16, 23),
    CharClass("entropy_short", ALNUM, DIGITS + LOW + UP, 16, 3.4, 16, 23),
)
#: A candidate that any of these fits is no secret.
ALLOW = (
    r"^[A-Za-z/_=-]*$",
    r"^[0-9/_=+-]*$",
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"(?i)example|placeholder|changeme|abcdefgh|01234567|xxxxxx",
)


BLOCK = 256


def sums_before(numbers: Column) -> Column:
    """For each number of an array the sum of those before it: in blocks, so that no long array grows by single elements."""
    zero = F.lit(0).cast("bigint")
    some = F.array().cast("array<bigint>")

    def in_block(block: Column) -> Column:
        return F.aggregate(block, F.struct(zero.alias("at"), some.alias("out")), lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))

    def whole(xs: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int"))
        blocks = F.transform(starts, lambda k: in_block(F.slice(xs, k * BLOCK + 1, F.lit(BLOCK))))
        first = F.struct(zero.alias("at"), F.array().cast("array<array<bigint>>").alias("out"))
        return F.flatten(F.aggregate(blocks, first, lambda a, b: F.struct((a["at"] + b["at"]).alias("at"), F.concat(a["out"], F.array(F.transform(b["out"], lambda x: x + a["at"]))).alias("out")))["out"])

    return let(numbers, lambda xs: F.when(F.size(xs) == 0, some).otherwise(whole(xs)))


def located(text: Column, pattern: str, group: int) -> Column:
    """array<struct<start, end, match, size>> of a pattern's matches, in order; size: the length of a group.

    What lies between the matches comes from splitting at them, so places follow from running lengths.
    """
    empty = F.array().cast("array<struct<start:bigint,end:bigint,match:string,size:int>>")

    def placed(found: Column) -> Column:
        # lengths once for all elements, not once for each
        gaps = F.transform(F.split(text, pattern, -1), F.length)
        steps = F.transform(F.slice(F.arrays_zip(gaps.alias("g"), found.alias("m")), F.lit(1), F.size(found)), lambda x: (x["g"] + F.length(x["m"]["match"])).cast("bigint"))
        ends = let(steps, lambda n: F.transform(F.arrays_zip(sums_before(n).alias("s"), n.alias("n")), lambda x: x["s"] + x["n"]))
        both = F.arrays_zip(ends.alias("end"), found.alias("m"))
        return F.transform(both, lambda x: F.struct((x["end"] - F.length(x["m"]["match"])).cast("bigint").alias("start"), x["end"].alias("end"), x["m"]["match"].alias("match"), x["m"]["size"].alias("size")))

    return let(matches(text, pattern, group), lambda found: F.when(F.size(found) == 0, empty).otherwise(placed(found)))


def matches(text: Column, pattern: str, group: int) -> Column:
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if group == 0:
        return F.transform(whole, lambda m: F.struct(m.alias("match"), F.length(m).alias("size")))
    return F.transform(F.arrays_zip(whole.alias("m"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("g")), lambda x: F.struct(x["m"].alias("match"), F.length(x["g"]).alias("size")))


def _clog(c: Column) -> Column:
    """c * log2(c), 0 for 0."""
    return F.when(c > 1, c * F.log2(c)).otherwise(F.lit(0.0))


def entropy_window(candidate: Column, c: CharClass) -> Column:
    """struct<first, last>: starts of the first and last window at or over the threshold (-1: none)."""
    index = F.transform(F.split(candidate, ""), lambda ch: F.instr(F.lit(c.alphabet), ch))
    most = c.width * (F.log2(F.lit(float(c.width))) - c.bits) + 1e-9
    zero = F.struct(F.array_repeat(F.lit(0), len(c.alphabet)).alias("counts"), F.lit(0.0).alias("s"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))

    def run(ix: Column) -> Column:
        def step(a: Column, i: Column) -> Column:
            came, went = F.get(ix, i) - 1, F.when(i >= c.width, F.get(ix, i - c.width) - 1).otherwise(F.lit(-1))

            def moved(x: Column) -> Column:
                def at(k: Column) -> Column:
                    return F.coalesce(F.get(a["counts"], k), F.lit(0))

                same = x["came"] == x["went"]
                add = _clog(at(x["came"]) + 1) - _clog(at(x["came"]))
                take = F.when(x["went"] >= 0, _clog(at(x["went"])) - _clog(at(x["went"]) - 1)).otherwise(F.lit(0.0))
                s = F.when(same, a["s"]).otherwise(a["s"] + add - take)
                counts = F.when(same, a["counts"]).otherwise(F.transform(a["counts"], lambda n, k: n + F.when(k == x["came"], 1).when(k == x["went"], -1).otherwise(0)))
                full = i >= c.width - 1

                def put(v: Column) -> Column:
                    hit = full & (v <= most)
                    begin = i - (c.width - 1)
                    return F.struct(counts.alias("counts"), v.alias("s"), F.when(hit & (a["first"] < 0), begin).otherwise(a["first"]).alias("first"), F.when(hit, begin).otherwise(a["last"]).alias("last"))

                return let(s, put)

            return let(F.struct(came.alias("came"), went.alias("went")), moved)

        return F.aggregate(F.sequence(F.lit(0), F.length(candidate) - 1), zero, step, lambda a: F.struct(a["first"].alias("first"), a["last"].alias("last")))

    return let(index, run)


def spans(text: Column) -> Column:
    """array<struct<kind, rank, start, end>>, by start, then kind as listed."""

    def of(kind: str, rank: int, start: Column, end: Column) -> Column:
        return F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"))

    def base(k: int, kind: str, pattern: str, group: int, least: int) -> Column:
        ok = F.filter(located(text, pattern, group), lambda m: m["size"] >= least)
        return F.transform(ok, lambda m: of(kind, k, m["start"], m["end"]))

    def allowed(m: Column) -> Column:
        out = F.lit(False)
        for rule in ALLOW:
            out = out | m["match"].rlike(rule)
        return out

    def entropic(k: int, c: CharClass, runs: Column) -> Column:
        own = lambda m: m["match"].rlike(ALL_HEX) if "hex" in c.kind else F.lit(True)
        found = F.filter(runs, lambda m: m["size"].between(c.least, c.most) & own(m) & ~allowed(m))
        seen = F.transform(found, lambda m: F.struct(m["start"].alias("start"), entropy_window(m["match"], c).alias("w")))
        seen = F.filter(seen, lambda m: m["w"]["first"] >= 0)
        return F.transform(seen, lambda m: of(c.kind, k, m["start"] + m["w"]["first"], m["start"] + m["w"]["last"] + c.width))

    def of_run(pattern: str) -> Column:
        mine = [(k, c) for k, c in enumerate(CLASSES, len(BASE)) if c.run == pattern]
        return let(located(text, pattern, 0), lambda runs: F.concat(*[entropic(k, c, runs) for k, c in mine]))

    return F.sort_array(F.concat(*[base(k, *rule) for k, rule in enumerate(BASE)], of_run(ALNUM), of_run(RUN)))


def secret_scan(docs: DataFrame) -> DataFrame:
    """doc_id and spans array<struct<start, rank, end, kind>>."""
    return pick(docs, "doc_id", "text").select("doc_id", spans(F.coalesce("text", F.lit(""))).alias("spans"))


def digest(scanned: DataFrame) -> DataFrame:
    """Per document: counts of the base kinds, the digest of base spans and all spans as a string."""
    named = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    kinds = [k for k, *_ in BASE]

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return scanned.select("doc_id", *map(count, kinds), F.sha2(named(F.filter("spans", lambda x: x["rank"] < len(BASE))), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"))
