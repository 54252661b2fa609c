"""English stemming by suffixes (Porter 1980), as a chain of replacements on an array of terms.

Each step is a list of rules (suffix, replacement, condition on the stem); the longest suffix that fits
a term decides, whether its condition holds or not.  All is one Column expression: no user function.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed parts of the algorithm: consonants and vowels as patterns (y is a vowel after a consonant).
C, V = "(?:[^aeiouy]|(?<=[aeiou])y|^y)", "(?:[aeiou]|(?<=[^aeiou])(?<!^)y)"
HAS_VOWEL = f"{V}"
MEASURE_1 = f"^{C}*{V}+{C}"
MEASURE_2 = f"^{C}*{V}+{C}+{V}+{C}"
ONE_EXACTLY = f"^{C}*{V}+{C}+{V}*$"
DOUBLE = r"([^aeiouy])\1$"
CVC = f"{C}{V}(?:[^aeiouywx])$"

Rule = tuple[str, str, str]
#: Fixed rules of steps 1a, 2, 3 and 4.
STEP_1A: tuple[Rule, ...] = (("sses", "ss", ""), ("ies", "i", ""), ("ss", "ss", ""), ("s", "", ""))
STEP_2: tuple[Rule, ...] = tuple((a, b, MEASURE_1) for a, b in (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")))
STEP_3: tuple[Rule, ...] = tuple((a, b, MEASURE_1) for a, b in (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")))
STEP_4: tuple[Rule, ...] = tuple((a, "", MEASURE_2) for a in ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")) + (("ion", "", f"(?=.*[st]$)(?:{MEASURE_2})"),)


def _cut(w: Column, n: int) -> Column:
    return F.left(w, F.length(w) - n)


def _step(w: Column, rules: tuple[Rule, ...]) -> Column:
    out = None
    for suffix, to, condition in sorted(rules, key=lambda r: -len(r[0])):
        stem = _cut(w, len(suffix))
        ok = stem.rlike(condition) if condition else F.lit(True)
        then = F.when(ok, F.concat(stem, F.lit(to))).otherwise(w)
        fits = w.endswith(suffix)
        out = F.when(fits, then) if out is None else out.when(fits, then)
    return out.otherwise(w)


def _step_1b(w: Column) -> Column:
    eed = F.when(_cut(w, 3).rlike(MEASURE_1), _cut(w, 1)).otherwise(w)

    def mended(s: Column) -> Column:
        return F.when(s.rlike("(at|bl|iz)$"), F.concat(s, F.lit("e"))).when(s.rlike(DOUBLE) & ~s.rlike("[lsz]$"), _cut(s, 1)).when(s.rlike(ONE_EXACTLY) & s.rlike(CVC), F.concat(s, F.lit("e"))).otherwise(s)

    short = F.when(w.endswith("ed") & _cut(w, 2).rlike(HAS_VOWEL), _cut(w, 2)).when(w.endswith("ing") & _cut(w, 3).rlike(HAS_VOWEL), _cut(w, 3))
    return F.when(w.endswith("eed"), eed).when(short.isNotNull(), mended(short)).otherwise(w)


def _step_1c(w: Column) -> Column:
    return F.when(w.endswith("y") & _cut(w, 1).rlike(HAS_VOWEL), F.concat(_cut(w, 1), F.lit("i"))).otherwise(w)


def _step_5(w: Column) -> Column:
    s = _cut(w, 1)
    e = F.when(w.endswith("e") & (s.rlike(MEASURE_2) | s.rlike(MEASURE_1) & ~(s.rlike(ONE_EXACTLY) & s.rlike(CVC))), s).otherwise(w)
    return e


def _step_5b(w: Column) -> Column:
    return F.when(w.endswith("ll") & w.rlike(MEASURE_2), _cut(w, 1)).otherwise(w)


def stems(terms: Column) -> Column:
    """The stems of an array of lower-cased terms; terms of other than a-z, or of one or two letters, stay."""
    steps: list[Callable[[Column], Column]] = [lambda w: _step(w, STEP_1A), _step_1b, _step_1c, lambda w: _step(w, STEP_2), lambda w: _step(w, STEP_3), lambda w: _step(w, STEP_4), _step_5, _step_5b]

    def own(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
        return lambda w: F.when(w.rlike("^[a-z]{3,}$"), f(w)).otherwise(w)

    out = terms
    for f in steps:  # a transform a step, so that no expression holds another many times
        out = F.transform(out, own(f))
    return out
