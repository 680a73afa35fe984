"""NFKC with case folding as expressions: tables by code point, made from the running Python's Unicode data.

Texts whose letters fold as lower() folds them take that way. Other characters
are looked up one by one: a table has an entry for each character of the blocks
that change (256 code points each), found by the block's place in a list, so a
look-up costs the same for any character. Characters that can melt into the one
before them make a cluster with it, which is decomposed, ordered by combining
class and composed again. Surrogates stand for nothing.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Between the entries of a table; no entry has it.
_APART = ""
# Hangul syllables are numbered by their parts.
_FIRST, _L, _V, _T, _VS, _TS = 0xAC00, 0x1100, 0x1161, 0x11A7, 21, 28
#: Ranges of so many characters that none of a class is in are asked for before the class is.
_LONG = 100
#: Below it, letters whose lower case is their folded form are left to lower().
_LOWERED = 0x530


@functools.lru_cache(maxsize=1)
def _every() -> list[str]:
    """Characters of the planes in use: what others have stays as it is."""
    return [chr(c) for c in [*range(0x40000), *range(0xE0000, 0xE1000)] if not 0xD800 <= c < 0xE000]


@functools.lru_cache(maxsize=1)
def _seconds() -> frozenset[str]:
    """Characters whose decomposition begins with one that can move before or melt into what stands before it."""
    parts = [unicodedata.decomposition(c).split() for c in _every()]
    seconds = {chr(int(p[1], 16)) for p in parts if len(p) == 2 and not p[0].startswith("<")} | {chr(c) for c in [*range(_V, _V + _VS), *range(_T + 1, _T + _TS)]}
    return frozenset(c for c in _every() if unicodedata.combining(d := unicodedata.normalize("NFKD", c)[:1]) or d in seconds)


def _ranges(chars: list[str]) -> list[list[int]]:
    out: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return out


def _class_of(ranges: list[list[int]]) -> str:
    """A character class of a pattern, as ranges."""
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]"


def _rare(chars: list[str]) -> str:
    """A pattern of one of the characters. A class of a thousand ranges costs as much for each character that is not in it, so the long ranges between them are asked for first, Latin ones before all."""
    ranges = _ranges(chars)
    between = [[a + 1, b - 1] for (_, a), (b, _) in zip([[0, -1], *ranges], [*ranges, [sys.maxunicode + 1, 0]], strict=True) if b - a > _LONG]
    latin = [r for r in between if r[0] < 0x180]
    return "".join(f"(?!{_class_of(r)})" for r in (latin, between) if r) + _class_of(ranges)


@functools.lru_cache(maxsize=4)
def _table(kind: str) -> tuple[str, str]:
    """(entries one after another, where each block's entries begin); the empty entry says that the character stays."""
    of: dict[str, Callable[[str], str]] = {
        "fold": lambda c: unicodedata.normalize("NFKC", c).casefold(),
        "decomposed": lambda c: unicodedata.normalize("NFKD", c),
        "class": lambda c: str(unicodedata.combining(c)) if unicodedata.combining(c) else c,
    }
    entries, begins = [""] * 256, []
    used = {ord(c) >> 8 for c in _every()}
    for block in range((sys.maxunicode + 1) >> 8):
        chars = [chr(block << 8 | i) for i in range(256)] if block in used else []
        found = ["" if (f := of[kind](c)) == c else f for c in chars]
        begins.append(len(entries) if any(found) else 0)
        entries += found if any(found) else []
    return _APART.join(entries), ",".join(map(str, begins))


def _looked_up(char: Column, kind: str) -> Column:
    """The character's entry, empty if it stays. Both lists are constants, which the optimizer makes once."""
    entries, begins = _table(kind)
    code = F.ascii(char)
    begin = F.get(F.split(F.lit(begins), ",").cast("array<int>"), F.shiftright(code, 8))
    return F.get(F.split(F.lit(entries), _APART), begin + code.bitwiseAND(F.lit(255)))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once however often it stands in there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _mapped(text: Column, kind: str) -> Column:
    return F.array_join(F.transform(_chars(text), lambda c: bound(_looked_up(c, kind), lambda found: F.when(found == "", c).otherwise(found))), "")


@functools.lru_cache(maxsize=1)
def _pairs() -> str:
    """Each composed character after its two parts, with a mark before; Hangul is numbered instead."""
    out = []
    for c in _every():
        parts = unicodedata.decomposition(c).split()
        if len(parts) == 2 and not parts[0].startswith("<") and unicodedata.normalize("NFC", c) == c:
            out.append(_APART + chr(int(parts[0], 16)) + chr(int(parts[1], 16)) + c)
    return "".join(out)


def _composed(a: Column, b: Column) -> Column:
    """The character that a and b make, null if none."""
    at = F.instr(F.lit(_pairs()), F.concat(F.lit(_APART), a, b))
    x, y = F.ascii(a), F.ascii(b)
    char = lambda code: F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")
    lead = x.between(_L, _L + 18) & y.between(_V, _V + _VS - 1)
    tail = x.between(_FIRST, _FIRST + 11171) & ((x - _FIRST) % _TS == 0) & y.between(_T + 1, _T + _TS - 1)
    return F.when(at > 0, F.substring(F.lit(_pairs()), at + 3, F.lit(1))).when(lead, char(((x - _L) * _VS + (y - _V)) * _TS + _FIRST)).when(tail, char(x + (y - _T)))


def _cluster(text: Column) -> Column:
    """NFKC of a few characters."""
    marked = F.transform(_chars(_mapped(text, "decomposed")), lambda c: F.struct(c.alias("c"), F.coalesce(F.nullif(_looked_up(c, "class"), F.lit("")).cast("int"), F.lit(0)).alias("k")))
    # Marks between two starters are put in the order of their classes.
    run = lambda x, i: F.size(F.filter(F.slice(x, F.lit(1), i + 1), lambda y: y["k"] == 0))
    ordered = bound(marked, lambda m: F.sort_array(F.transform(m, lambda x, i: F.struct(run(m, i).alias("run"), x["k"].alias("k"), i.alias("i"), x["c"].alias("c")))))
    state = lambda done, starter, marks, last: F.struct(done.alias("done"), starter.alias("starter"), marks.alias("marks"), last.alias("last"))
    none = F.lit("")

    def step(acc: Column, x: Column) -> Column:
        whole = F.when((acc["starter"] != "") & ((acc["marks"] == "") | (acc["last"] < x["k"])), _composed(acc["starter"], x["c"]))
        fresh = state(F.concat(acc["done"], acc["starter"], acc["marks"]), x["c"], none, F.lit(0))
        return F.when(whole.isNotNull(), state(acc["done"], whole, acc["marks"], acc["last"])).when(x["k"] == 0, fresh).otherwise(state(acc["done"], acc["starter"], F.concat(acc["marks"], x["c"]), x["k"]))

    return F.aggregate(ordered, state(none, none, none, F.lit(0)), step, lambda acc: F.concat(acc["done"], acc["starter"], acc["marks"]))


@functools.lru_cache(maxsize=1)
def _classes() -> tuple[str, str, str]:
    """(a pattern of characters that lower() and `ss` for ß don't fold, one of those that can melt into the one before them, the class of these)."""
    seconds = _seconds()

    def like_lower(c: str) -> bool:
        folded = unicodedata.normalize("NFKC", c).casefold()
        # What Python doesn't know yet, the JVM may have a lower case for.
        return c == "ß" or unicodedata.category(c) != "Cn" and c not in seconds and c not in "Σİ" and folded == c.lower() and (folded == c or ord(c) < _LOWERED)

    return _rare([c for c in _every() if not like_lower(c)]), _rare(list(seconds)), _class_of(_ranges(list(seconds)))


def fold_case(text: Column) -> Column:
    """NFKC of a text, case folded, as Python has them; null stays null."""
    special, joining, joins = _classes()
    pieces = f"(?s).{joins}+|[^{joins[1:-1]}]+?(?=.{joins}|\\z)|{joins}+"

    def joined(t: Column) -> Column:
        whole = F.array_join(F.transform(F.regexp_extract_all(t, F.lit(pieces), F.lit(0)), lambda c: F.when(c.rlike(joins), _cluster(c)).otherwise(c)), "")
        return F.when(t.rlike(joining), whole).otherwise(t)

    ascii_only = lambda t: F.octet_length(t) == F.char_length(t)
    return bound(text, lambda t: F.when(ascii_only(t), F.lower(t)).when(t.rlike(special), _mapped(joined(t), "fold")).otherwise(F.lower(F.replace(t, F.lit("ß"), F.lit("ss")))))
