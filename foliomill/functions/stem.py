"""English stems by the Porter2 rules, as SQL that Spark and other engines run alike.

A word is [a-z0-9]+. Each step is one CASE over the word's ending: the longest ending that a step lists decides, whether or not its
condition holds. Regions: R1 begins after the first consonant that follows a vowel (after a few prefixes, at once), R2 the same way within R1; an
ending lies in a region if it begins there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words with stems of their own, words that stay, words that stay once a plural is off, prefixes before R1.
SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
KEPT = ["sky", "news", "howe", "atlas", "cosmos", "bias", "andes"]
KEPT_SINGULAR = ["inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"]
PREFIXES = ["gener", "commun", "arsen"]
#: Endings of steps 2, 3 and 4, and what they become; those of step 4 go.
STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate",
    "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive",
    "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less",
}
STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize"]

VOWEL, OTHER = "[aeiouy]", "[^aeiouy]"
SHORT = rf"({OTHER}{VOWEL}[^aeiouywxY]|^{VOWEL}{OTHER})$"

Like = Callable[[str, str], str]


def _ends(word: str, ending: str) -> str:
    return f"right({word}, {len(ending)}) = '{ending}'"


def _cut(n: int, tail: str = "") -> str:
    cut = f"left(x.w, length(x.w) - {n})"
    return f"concat({cut}, '{tail}')" if tail else cut


def _case(rules: list[tuple[str, str]]) -> str:
    """The first condition that holds decides; the word stays if none does."""
    return "CASE " + " ".join(f"WHEN {when} THEN {then}" for when, then in rules) + " ELSE x.w END"


def _by_ending(rules: dict[str, tuple[str, str]]) -> str:
    """By the longest ending: its condition and its result."""
    return _case([(_ends("x.w", e), f"CASE WHEN {when} THEN {then} ELSE x.w END") for e, (when, then) in sorted(rules.items(), key=lambda r: -len(r[0]))])


def steps(like: Like) -> list[str]:
    """Expressions over x.w, x.r1 and x.r2 (letters before each region), one after the other; like is the engine's test of a pattern."""
    in1, in2 = (lambda n: f"length(x.w) - {n} >= x.r1"), (lambda n: f"length(x.w) - {n} >= x.r2")
    vowel = lambda n: like(f"left(x.w, length(x.w) - {n})", VOWEL)
    plural = {"sses": ("true", _cut(2)), "ied": ("true", f"CASE WHEN length(x.w) > 4 THEN {_cut(2)} ELSE {_cut(1)} END"), "us": ("false", "x.w"), "ss": ("false", "x.w"), "s": (vowel(2), _cut(1))}
    plural["ies"] = plural["ied"]
    # what is left of -ed and -ing words gets an e, loses a double consonant, or stays
    mended = lambda n: f"CASE WHEN {like(_cut(n), '(at|bl|iz)$')} THEN {_cut(n, 'e')} WHEN {like(_cut(n), '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$')} THEN {_cut(n + 1)} WHEN length(x.w) - {n} <= x.r1 AND {like(_cut(n), SHORT)} THEN {_cut(n, 'e')} ELSE {_cut(n)} END"
    past = {e: (vowel(len(e)), mended(len(e))) for e in ("ed", "edly", "ing", "ingly")} | {e: (in1(len(e)), _cut(len(e), "ee")) for e in ("eed", "eedly")}
    two = {e: (in1(len(e)), _cut(len(e), to)) for e, to in STEP2.items()}
    two |= {"ogi": (f"{in1(3)} AND {_ends(_cut(3), 'l')}", _cut(1)), "li": (f"{in1(2)} AND {like(_cut(2), '[cdeghkmnrt]$')}", _cut(2))}
    three = {e: (in1(len(e)), _cut(len(e), to)) for e, to in STEP3.items()} | {"ative": (in2(5), _cut(5))}
    four = {e: (in2(len(e)), _cut(len(e))) for e in STEP4} | {"ion": (f"{in2(3)} AND {like(_cut(3), '[st]$')}", _cut(3))}
    five = {"e": (f"{in2(1)} OR ({in1(1)} AND NOT {like(_cut(1), SHORT)})", _cut(1)), "l": (f"{in2(1)} AND {_ends(_cut(1), 'l')}", _cut(1))}
    stays = f"x.w IN ({', '.join(repr(x) for x in KEPT_SINGULAR)})"
    after = lambda then: f"CASE WHEN {stays} THEN x.w ELSE {then} END"
    return [_by_ending(plural), after(_by_ending(past)), after(_case([(like("x.w", f"^.+{OTHER}[yY]$"), _cut(1, "i"))])), *[after(_by_ending(x)) for x in (two, three, four, five)]]


def marked(word: str, replace: Callable[[str, str, str], str], group: str) -> str:
    """The word with Y for a y that is a consonant."""
    return replace(replace(word, "^y", "Y"), f"({VOWEL})y", f"{group}1Y")


def region(text: str, extract: Callable[[str, str], str]) -> str:
    """How many letters stand before the region of a text: all, if there is none."""
    return f"CASE WHEN {extract(text, f'^{OTHER}*{VOWEL}+{OTHER}')} = '' THEN length({text}) ELSE length({extract(text, f'^{OTHER}*{VOWEL}+{OTHER}')}) END"


def first_region(extract: Callable[[str, str], str]) -> str:
    prefixes = " ".join(f"WHEN left(x.w, {len(p)}) = '{p}' THEN {len(p)}" for p in PREFIXES)
    return f"CASE {prefixes} ELSE {region('x.w', extract)} END"


def finished() -> str:
    special = " ".join(f"WHEN word = '{a}' THEN '{b}'" for a, b in SPECIAL.items())
    return f"CASE WHEN length(word) <= 2 OR word IN ({', '.join(repr(w) for w in KEPT)}) THEN word {special} ELSE replace(x.w, 'Y', 'y') END"


def with_stem(rows: DataFrame, stem: str = "lexeme") -> DataFrame:
    """Rows (word, ...) with the stem of their word, in native expressions.

    Each step is a function of an array of one element, so that its word is computed once and the expression stays as long as the rules.
    """
    like = lambda w, p: f"({w} rlike '{p}')"
    extract = lambda w, p: f"regexp_extract({w}, '{p}', 0)"
    replace = lambda w, p, to: f"regexp_replace({w}, '{p}', '{to}')"
    held = lambda of, w, r1="x.r1", r2="x.r2": f"transform({of}, x -> named_struct('w', {w}, 'r1', {r1}, 'r2', {r2}))"
    out = held(f"array(named_struct('w', {marked('word', replace, '$')}))", "x.w", first_region(extract), "0")
    out = held(out, "x.w", r2=f"x.r1 + {region('substring(x.w, x.r1 + 1)', extract)}")
    for step in steps(like):
        out = held(out, step)
    return rows.select("*", F.expr(f"get(transform({out}, x -> {finished()}), 0)").alias(stem))


def stem_sql(source: str, stem: str = "lexeme") -> str:
    """DuckDB SQL for the same: a query over the query source, which has a column word."""
    like = lambda w, p: f"regexp_matches({w}, '{p}')"
    extract = lambda w, p: f"regexp_extract({w}, '{p}')"
    replace = lambda w, p, to: f"regexp_replace({w}, '{p}', '{to}', 'g')"
    q = f"SELECT *, {marked('word', replace, chr(92))} AS w FROM ({source})"
    q = f"SELECT *, {first_region(extract)} AS r1 FROM ({q}) x"
    q = f"SELECT *, x.r1 + {region('substring(x.w, x.r1 + 1)', extract)} AS r2 FROM ({q}) x"
    for step in steps(like):
        q = f"SELECT * REPLACE ({step} AS w) FROM ({q}) x"
    return f"SELECT * EXCLUDE (w, r1, r2), {finished()} AS {stem} FROM ({q}) x"
