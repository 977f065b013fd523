"""Patterns as Python reads them, run by Spark's own engine.

``re``'s parser gives the parts of a pattern; each is written in the syntax of Java's engine with the characters that
Python means: ``\\d`` any decimal digit, ``\\w`` letters and numbers of any script but no marks, ``\\s`` with the four
separators below U+0020, ``$`` before a last line feed only, letters without case by Python's table.  What Java's engine
would read otherwise, or on long texts only with a deep stack, isn't translated: ``java`` returns None, and the column
functions here run such a pattern with ``re`` itself, over Arrow.  A pattern that ``re`` can't read is an error everywhere.
"""

from __future__ import annotations

import re
from _sre import unicode_tolower
from functools import lru_cache
from re import _casefix as casefix
from re import _constants as sre
from re import _parser as parser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"\t-\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WORD, DIGIT = r"\p{L}\p{N}_", r"\p{Nd}"
ASCII = {"word": "0-9A-Za-z_", "digit": "0-9", "space": r"\t-\r\x{20}"}
UNICODE = {"word": WORD, "digit": DIGIT, "space": SPACE}
#: Repeats of more than one character beyond this many rounds run by recursion in Java's engine.
ROUNDS = 200
#: Java's engine looks behind by code points, not by halves of them, only where such a character follows in the pattern; none is asked for.
BY_CODE_POINTS = "(?:\U00010000){0}"


class Untranslatable(Exception):
    """Java's engine has no equal of this part."""


@lru_cache(1)
def _by_lower() -> dict[int, tuple[int, ...]]:
    """By lower-case code point: the code points that have it, where that is more than itself."""
    out: dict[int, list[int]] = {}
    for c in range(0x110000):
        if (low := unicode_tolower(c)) != c:
            out.setdefault(low, [low] if unicode_tolower(low) == low else []).append(c)
    return {k: tuple(v) for k, v in out.items()}


def _of_lower(low: int) -> set[int]:
    """All code points that a pattern without case takes for this lower-case one."""
    return {x for k in (low, *casefix._EXTRA_CASES.get(low, ())) for x in _by_lower().get(k, (k,))}


def _letters(c: int, ascii_only: bool) -> list[int]:
    if ascii_only:
        return sorted({c, ord(chr(c).swapcase())}) if c < 128 else [c]
    return sorted(_of_lower(unicode_tolower(c)))


def _one(c: int) -> str:
    return chr(c) if c < 128 and chr(c).isalnum() else f"\\x{{{c:X}}}"


def _category(name, flags: int) -> tuple[bool, str]:
    """(whether negated, the inside of a class) of a category such as CATEGORY_NOT_DIGIT."""
    parts = str(name).lower().split("_")
    return "not" in parts, (ASCII if flags & re.ASCII else UNICODE)[parts[-1]]


def _range_letters(first: int, last: int, ascii_only: bool) -> str:
    """What a range without case takes in besides itself."""
    if ascii_only:
        more = {x for c in range(first, min(last, 127) + 1) for x in _letters(c, True)}
    else:
        more = {x for low in {*_by_lower(), *casefix._EXTRA_CASES} if any(first <= c <= last for c in _by_lower().get(low, (low,))) for x in _of_lower(low)}
    return "".join(_one(c) for c in sorted(more) if not first <= c <= last)


def _class(parts: list, flags: int) -> str:
    out, negated, fold = [], False, flags & re.IGNORECASE
    for op, value in parts:
        if op is sre.NEGATE:
            negated = True
        elif op is sre.LITERAL:
            out.append("".join(map(_one, _letters(value, bool(flags & re.ASCII)))) if fold else _one(value))
        elif op is sre.RANGE:
            out.append(f"{_one(value[0])}-{_one(value[1])}" + (_range_letters(*value, bool(flags & re.ASCII)) if fold else ""))
        elif op is sre.CATEGORY:
            inverse, inside = _category(value, flags)
            out.append(f"[^{inside}]" if inverse else inside)
        else:
            raise Untranslatable(str(op))
    return f"[{'^' if negated else ''}{''.join(out)}]"


def _at(value, flags: int) -> str:
    w = f"[{(ASCII if flags & re.ASCII else UNICODE)['word']}]"
    lines = flags & re.MULTILINE
    if value is sre.AT_BEGINNING:
        return r"(?<![^\n])" if lines else r"\A"
    if value is sre.AT_END:
        return r"(?![^\n])" if lines else r"(?=\n?\z)"
    if value is sre.AT_BEGINNING_STRING:
        return r"\A"
    if value is sre.AT_END_STRING:
        return r"\z"
    if value is sre.AT_BOUNDARY:
        return f"(?:(?<={w})(?!{w})|(?<!{w})(?={w}))"
    if value is sre.AT_NON_BOUNDARY:
        # An empty text holds no place inside or outside words, to Python.
        return f"(?:(?<={w})(?={w})|(?<!{w})(?!{w})(?!\\A\\z))"
    raise Untranslatable(str(value))


def _in_word(op, value) -> bool:
    """Whether a part must begin with a character of a word."""
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
        return value[0] > 0 and len(value[2]) > 0 and _in_word(*value[2][0])
    inside = lambda c: c < 128 and (chr(c).isalnum() or c == ord("_"))
    if op is sre.LITERAL:
        return inside(value)
    return op is sre.IN and all(
        k is sre.LITERAL and inside(v) or k is sre.RANGE and v[1] < 128 and all(map(inside, range(v[0], v[1] + 1))) or k is sre.CATEGORY and v in (sre.CATEGORY_DIGIT, sre.CATEGORY_WORD) for k, v in value
    )


def _write(parsed, flags: int, kept: set[int]) -> str:
    out = []
    for k, (op, value) in enumerate(parsed):
        then = next(((o, v) for o, v in parsed[k + 1 :] if o not in (sre.AT, sre.ASSERT, sre.ASSERT_NOT)), None)
        if op is sre.AT and value is sre.AT_BOUNDARY and then and not flags & re.IGNORECASE and _in_word(*then):
            # A border before what is a word's in any case: one look behind instead of four around.
            out.append(f"(?<![{(ASCII if flags & re.ASCII else UNICODE)['word']}])")
        else:
            out.append(_part(op, value, flags, kept))
    return "".join(out)


def _part(op, value, flags: int, kept: set[int]) -> str:
    fold, ascii_only = flags & re.IGNORECASE, bool(flags & re.ASCII)
    if op is sre.LITERAL:
        return _class([(op, value)], flags) if fold and len(_letters(value, ascii_only)) > 1 else _one(value)
    if op is sre.NOT_LITERAL:
        return _class([(sre.NEGATE, None), (sre.LITERAL, value)], flags)
    if op is sre.ANY:
        return r"(?s:.)" if flags & re.DOTALL else r"[^\n]"
    if op is sre.IN:
        return _class(value, flags)
    if op is sre.AT:
        return _at(value, flags)
    if op is sre.BRANCH:
        return f"(?:{'|'.join(_write(one, flags, kept) for one in value[1])})"
    if op is sre.SUBPATTERN:
        group, added, gone, inner = value
        return f"({'' if group in kept else '?:'}{_write(inner, (flags | added) & ~gone, kept)})"
    if op is sre.ATOMIC_GROUP:
        return f"(?>{_write(value, flags, kept)})"
    if op in (sre.ASSERT, sre.ASSERT_NOT):
        side, inner = value
        return f"(?{'<' if side < 0 else ''}{'=' if op is sre.ASSERT else '!'}{_write(inner, flags, kept)})"
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
        least, most, inner = value
        single = len(inner) == 1 and inner[0][0] in (sre.LITERAL, sre.NOT_LITERAL, sre.ANY, sre.IN)
        if not single and (most is sre.MAXREPEAT or most > ROUNDS or inner.getwidth()[0] == 0 and most > 1):
            raise Untranslatable("a repeat of more than one character")
        times = f"{{{least},{'' if most is sre.MAXREPEAT else most}}}" + {sre.MAX_REPEAT: "", sre.MIN_REPEAT: "?", sre.POSSESSIVE_REPEAT: "+"}[op]
        return f"(?:{_write(inner, flags, kept)}){times}"
    if op is sre.GROUPREF and not fold:
        return f"(?:\\{sorted(kept).index(value) + 1})"
    raise Untranslatable(str(op))


def _begins(parsed, flags: int) -> str:
    """A look at the first character where few fit, for a pattern that would look behind or for a border at every place before it reads one."""
    behind = False
    for op, value in parsed:
        if op is sre.AT or op in (sre.ASSERT, sre.ASSERT_NOT):
            behind = behind or value in (sre.AT_BOUNDARY, sre.AT_NON_BOUNDARY) or op is not sre.AT and value[0] < 0
            continue
        while op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and value[0] > 0 and len(value[2]):
            op, value = value[2][0]
        few = op is sre.LITERAL or op is sre.IN and all(k in (sre.LITERAL, sre.RANGE) or k is sre.CATEGORY and v is sre.CATEGORY_DIGIT for k, v in value)
        return f"(?={_part(op, value, flags, set())})" if behind and few else ""
    return ""


def _referred(parsed) -> set[int]:
    """Numbers of the groups that the pattern refers back to."""
    out: set[int] = set()
    todo = [parsed]
    while todo:
        one = todo.pop()
        if isinstance(one, tuple) and len(one) == 2 and one[0] is sre.GROUPREF:
            out.add(one[1])
        elif isinstance(one, (tuple, list, parser.SubPattern)):
            todo += list(one)
    return out


@lru_cache(1024)
def java(pattern: str) -> str | None:
    """The same pattern in Java's syntax, without groups but those it refers back to; None if only Python can run it."""
    re.compile(pattern)
    parsed = parser.parse(pattern)
    try:
        out = _begins(parsed, parsed.state.flags) + _write(parsed, parsed.state.flags, _referred(parsed))
    except Untranslatable:
        return None
    return out + BY_CODE_POINTS if "(?<" in out else out


def readable(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except (re.error, OverflowError, RecursionError):
        return False
    return True


def has_groups(pattern: str) -> bool:
    return re.compile(pattern).groups > 0


def may_be_empty(pattern: str) -> bool:
    return parser.parse(pattern).getwidth()[0] == 0


def search(text: Column, pattern: str) -> Column:
    """Whether the pattern is found anywhere in the text; null for a null text."""
    if (same := java(pattern)) is not None:
        return text.rlike(same)

    @F.pandas_udf("boolean")
    def found(texts: pd.Series) -> pd.Series:
        compiled = re.compile(pattern)
        return texts.map(lambda t: None if t is None else compiled.search(t) is not None)

    return found(text)
