r"""Regular expressions with Python's Unicode meaning on Spark's regex engine.

Rule sets and pattern lists are written in Python's dialect. Java reads ``\w``,
``\d``, ``\s`` and ``\b`` as ASCII (or half Unicode), so they are spelled out as
explicit classes. The classes themselves are also valid in RE2.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"\p{L}\p{N}_"
# Python's whitespace, one by one: single Latin-1 characters are a table lookup in Java
_LATIN_SPACE = r" \t\n\x{0B}\f\r\x{1C}\x{1D}\x{1E}\x{1F}\x{85}\x{A0}"
_WIDE_SPACE = r"\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SPACE = _LATIN_SPACE + _WIDE_SPACE
# the same set for use outside brackets; one range test dismisses most letters
SPACE_CLASS = rf"[{_LATIN_SPACE}[\x{{1680}}-\x{{3000}}&&[{_WIDE_SPACE}]]]"
SPACE_CHARS = "".join(
    chr(c)
    for c in [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680,
              *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)
DIGIT = r"\p{Nd}"
BOUNDARY = rf"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"

TOKEN = rf"[{WORD}]+|[^{WORD}{SPACE}]"
SENTENCE_END = rf"[.!?]+(?:[{SPACE}]|\z)"
LINE_BREAK = r"\r\n|[\n\r\x{0B}\x{0C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"

# case-insensitive as in Python; "d" keeps "." away from \n only
IGNORE_CASE = "(?iud)"

_CLASSES = {"w": WORD, "s": SPACE, "d": DIGIT}


def unicode_pattern(pattern: str, boundary: str = BOUNDARY) -> str:
    r"""Spell out ``\w \s \d`` (and negations) and ``\b`` of a Python pattern."""
    out, in_class, i = [], False, 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            name = pattern[i + 1]
            body = _CLASSES.get(name.lower())
            if name == "b" and not in_class:
                out.append(boundary)
            elif body is None:
                out.append(ch + name)
            elif in_class and name.islower():
                out.append(body)
            elif name == "s":
                out.append(SPACE_CLASS)
            elif in_class:
                raise ValueError(f"negated class inside brackets: {pattern!r}")
            else:
                out.append(f"[{'' if name.islower() else '^'}{body}]")
            i += 2
            continue
        if ch == "[" and not in_class:
            in_class = True
        elif ch == "]" and in_class:
            in_class = False
        out.append(ch)
        i += 1
    return "".join(out)


def escape_literal(text: str) -> str:
    """Escape a literal for both Java and RE2."""
    return "".join("\\" + c if c in r"\.^$|?*+()[]{}-/#&~" else c for c in text)


def _is_word(c: str) -> bool:
    return c.isalnum() or c == "_"


def whole_feature(feature: str) -> str:
    r"""``\bFEATURE\b`` for a literal feature, literal first so that it is searched for.

    Next to a word character the outside must be an edge or a non-word character;
    next to any other character the outside must be a word character.
    """
    literal = escape_literal(feature)
    left = f"(?<![{WORD}]{literal})" if _is_word(feature[0]) else f"(?<=[{WORD}]{literal})"
    right = f"(?![{WORD}])" if _is_word(feature[-1]) else f"(?=[{WORD}])"
    return literal + right + left


def whole_words(words: list[str]) -> str:
    r"""``\b(w1|w2|...)\b`` for words; the first letter is tested before the edges."""
    longest_first = sorted(words, key=len, reverse=True)
    first = "".join(sorted({w[0] for w in words}))
    return f"(?=[{first}])(?<![{WORD}])(?:{'|'.join(longest_first)})(?![{WORD}])"


# Letters a case-insensitive match equates with another letter,
# although their lower case differs.
_FOLD_FROM, _FOLD_TO = "İıſµ", "iisμ"


def fold_case(text: Column) -> Column:
    """Lower case that keeps equal what ``(?iu)`` calls equal, for :func:`feature_sql`."""
    rare = reduce(lambda a, b: a | b, [text.contains(c) for c in _FOLD_FROM])
    return F.lower(F.when(rare, F.translate(text, _FOLD_FROM, _FOLD_TO)).otherwise(text))


def fold_literal(text: str) -> str | None:
    """The same folding for a literal; None if it has letters the folding may miss."""
    folded = text.translate(str.maketrans(_FOLD_FROM, _FOLD_TO)).lower()
    return folded if all(c.isascii() or c == "μ" for c in folded) else None


def feature_words(feature: str) -> list[str]:
    return re.findall(r"\w+", fold_literal(feature) or "")


def known_words(folded: Column, features: Iterable[str]) -> Column:
    """Distinct words of the text that occur in any of the features."""
    vocabulary = sorted({w for f in features for w in feature_words(f)})
    words = F.split(folded, f"[^{WORD}]+")
    return F.array_intersect(words, F.split(F.lit(" ".join(vocabulary)), " "))


def sql_literal(text: str) -> str:
    """A string as Spark SQL text; raw where possible, so patterns stay readable."""
    for quote in "'\"":
        if quote not in text and not text.endswith("\\"):
            return f"r{quote}{text}{quote}"
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def required_literals(pattern: str) -> list[list[str]]:
    """Literals a match must contain: of every inner list at least one.

    Looks at the top level only: literal runs, and groups of plain alternatives
    joined with the literals next to them. Anything else ends a run, so the answer
    may be incomplete but never wrong.
    """
    runs: list[list[str]] = []
    run: list[str] | None = None
    i = 0

    def extend(alternatives: list[str]) -> None:
        nonlocal run
        run = [a + b for a in (run or [""]) for b in alternatives]

    def stop() -> None:
        nonlocal run
        if run and all(len(x.strip()) > 0 for x in run) and len(run) <= 16:
            runs.append(run)
        run = None

    while i < len(pattern):
        ch, step, found = pattern[i], 1, None
        if ch == "|":
            return []
        if ch == "\\":
            step = 2
            found = None if pattern[i + 1].isalnum() else [pattern[i + 1]]
        elif ch == "[":
            step = pattern.index("]", i) + 1 - i
        elif ch == "(":
            depth, j = 1, i + 1
            while depth:
                depth += {"(": 1, ")": -1}.get(pattern[j], 0) * (pattern[j - 1] != "\\")
                j += 1
            step = j - i
            body = pattern[i + 1 : j - 1].removeprefix("?:")
            plain = re.fullmatch(r"[A-Za-z ]+(\|[A-Za-z ]+)*", body)
            found = body.split("|") if plain else None
        elif ch not in ".^$":
            found = [ch]
        i += step
        quantifier = pattern[i] if i < len(pattern) and pattern[i] in "?*+{" else ""
        if found and quantifier in ("", "+"):
            extend(found)
        if not found or quantifier:
            stop()
        if quantifier:
            i = pattern.index("}", i) + 1 if quantifier == "{" else i + 1
    stop()
    return runs


def pattern_sql(text: str, folded: str, pattern: str) -> str:
    """``re.search(pattern, text, IGNORECASE)`` as SQL text over two column names.

    Byte-wise substring tests for the literals a match needs come first.
    """
    tests = []
    for literals in required_literals(pattern):
        needles = [fold_literal(x) for x in literals]
        if None not in needles:
            tests.append("(" + " OR ".join(f"contains({folded}, {sql_literal(n)})" for n in needles) + ")")
    tests.append(f"{text} RLIKE {sql_literal(IGNORE_CASE + unicode_pattern(pattern))}")
    return " AND ".join(tests)


def feature_sql(text: str, folded: str, words: str, feature: str) -> str:
    """Whole-feature hit, ignoring case, as SQL text over three column names.

    ``words`` are the text's :func:`known_words`. A one-word feature is a lookup in
    that short list; any other feature is searched for only if all its words are in
    it. Letters the folding does not cover are left to the regex engine.
    """
    needle = fold_literal(feature)
    if needle is None:
        return f"{text} RLIKE {sql_literal('(?iu)' + whole_feature(feature))}"
    parts = feature_words(feature)
    if parts == [needle]:
        return f"array_contains({words}, {sql_literal(needle)})"
    tests = [f"array_contains({words}, {sql_literal(w)})" for w in dict.fromkeys(parts)]
    tests.append(f"contains({folded}, {sql_literal(needle)})")
    tests.append(f"{folded} RLIKE {sql_literal(whole_feature(needle))}")
    return " AND ".join(tests)


def _worth_a_look(pattern: str, text: Column, folded: Column | None) -> Column:
    """False only where the pattern cannot match."""
    where = text if folded is None else folded
    tests = [F.lit(True)]
    for literals in required_literals(pattern):
        needles = literals if folded is None else [fold_literal(x) for x in literals]
        if None not in needles:
            tests.append(reduce(lambda a, b: a | b, [where.contains(n) for n in needles]))
    return reduce(lambda a, b: a & b, tests)


def count_matches(text: Column, pattern: str, folded: Column | None = None) -> Column:
    """Number of matches; ignoring case if the :func:`fold_case` of the text is given."""
    flags = "(?d)" if folded is None else IGNORE_CASE
    count = F.regexp_count(text, F.lit(flags + unicode_pattern(pattern)))
    return F.when(_worth_a_look(pattern, text, folded), count).otherwise(0)


def all_matches(text: Column, pattern: str, folded: Column | None = None) -> Column:
    """All matches in order; ignoring case if the :func:`fold_case` of the text is given."""
    flags = "(?d)" if folded is None else IGNORE_CASE
    found = F.regexp_extract_all(text, F.lit(flags + unicode_pattern(pattern)), F.lit(0))
    return F.when(_worth_a_look(pattern, text, folded), found).otherwise(
        F.array().cast("array<string>")
    )


def tokens(text: Column) -> Column:
    """Words and single marks, the unit of every word count."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_CHARS))


def split_lines(text: Column) -> Column:
    """Python's ``splitlines``, except that a trailing break leaves an empty line."""
    return F.split(text, LINE_BREAK)


def to_number(text: Column) -> Column:
    """Python's ``float(text)`` on plain numbers, NULL where it would raise."""
    trimmed = strip(text)
    plain = trimmed.rlike(r"\A[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z")
    return F.when(plain, trimmed.try_cast("double"))
