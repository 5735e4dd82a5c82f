"""Passenger name normalisation, transliteration and fake-name score."""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from functools import cache

from pyspark.sql import Column, functions as F

from farewatch import constants as K
from farewatch.functions.text import _c


def _kept_letters() -> str:
    kept = re.compile(f"[{K.NAME_KEEP_CLASS}]")
    lower = [chr(c) for c in range(0x61, 0x530) if kept.match(chr(c))]
    return "".join(lower) + "".join(c.upper() for c in lower)


def _char_class(chars: list[str]) -> str:
    """A pattern's class of the characters, as ranges."""
    codes, ranges = sorted(map(ord, chars)), []
    for c in codes:
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges)


def _marks() -> list[str]:
    return [chr(c) for c in range(0x300, 0x10000) if unicodedata.combining(chr(c))]


@cache
def _near_marks() -> str:
    """Few ranges that hold all marks, and no letter of the Latin and Cyrillic blocks."""
    marks = _marks()
    return _char_class([m for m in marks if m < "\u0590"] + [chr(c) for c in range(0x590, ord(max(marks)) + 1)])


@cache
def _composing() -> tuple[list[tuple[str, str]], str, list[tuple[str, str]]]:
    """(kept compositions as pattern and replacement, pattern of compositions that leave the alphabet, marks that stand for others).

    Marks are put in order by their combining class before they compose, and a
    mark is blocked by an earlier one of its own class.  So a letter composes with
    the first mark of a class wherever that stands in the run of marks after it.
    """
    marks = _marks()
    others = {n: _char_class([m for m in marks if unicodedata.combining(m) != n]) for n in {unicodedata.combining(m) for m in marks}}
    kept, lost = [], defaultdict(list)
    for mark in marks:
        for letter in _kept_letters():
            one = unicodedata.normalize("NFC", letter + mark)
            if len(one) == 1 and len(one.lower()) == 1 and len(unicodedata.normalize("NFD", mark)) == 1:
                if one in _kept_letters():
                    kept.append((f"{letter}([{others[unicodedata.combining(mark)]}]*){mark}", f"{one}$1"))
                else:
                    lost[mark].append(letter)
    by_class = defaultdict(list)
    for mark, letters in lost.items():
        by_class[unicodedata.combining(mark)].append(f"[{''.join(letters)}][{others[unicodedata.combining(mark)]}]*{mark}")
    spelt = [(m, unicodedata.normalize("NFD", m)) for m in marks if unicodedata.normalize("NFD", m) != m]
    return kept, "|".join(p for ps in by_class.values() for p in ps), spelt


def _composed(s: Column) -> Column:
    """What NFC does to the letters of names: й and ё are composed, and a letter
    that composes with a mark after it to a letter outside the alphabet becomes a space.
    The patterns are applied to names that hold a mark."""
    kept, lost, spelt = _composing()
    out = s
    for mark, parts in spelt:
        out = F.replace(out, F.lit(mark), F.lit(parts))
    for pattern, one in kept:
        out = F.regexp_replace(out, pattern, one)
    # Most names end at the test of few ranges.
    marked = F.rlike(s, F.lit(f"[{_near_marks()}]")) & F.rlike(s, F.lit(f"[{_char_class(_marks())}]"))
    return F.when(marked, F.regexp_replace(out, lost, " ")).otherwise(s)


def _normalised(raw: Column) -> Column:
    """Lower-case; every run of characters outside the kept letters becomes one
    space (whitespace included); noise tokens removed; trimmed.

    Equivalent to "non-letters -> space, split on whitespace, drop noise
    tokens, join by one space": tokens are the maximal runs of kept letters.
    Pure string expressions (whole-stage codegen), no array lambdas.
    """
    s = F.concat(F.lit(" "), F.regexp_replace(F.lower(_composed(raw)), f"[^{K.NAME_KEEP_CLASS}]+", " "), F.lit(" "))
    words = [t for t in K.NAME_NOISE_TOKENS if t and all(ch.isalpha() for ch in t)]
    noise = " (?:" + "|".join(sorted(words, key=len, reverse=True)) + ")(?= )"
    return F.trim(F.regexp_replace(s, noise, ""))


def transliterate(col) -> Column:
    """P10: Cyrillic/Kazakh -> Latin on lower-case text (ъ, ь dropped)."""
    s = _c(col)
    singles_from = "".join(k for k, v in K.TRANSLIT_PAIRS if len(v) == 1)
    singles_to = "".join(v for k, v in K.TRANSLIT_PAIRS if len(v) == 1)
    for k, v in K.TRANSLIT_PAIRS:
        if len(v) != 1:
            s = F.replace(s, F.lit(k), F.lit(v))
    return F.translate(s, singles_from, singles_to)


def clean_name(col, translit: bool = False) -> Column:
    """Normalised upper-case name; null/empty -> ''."""
    raw = _c(col)
    joined = _normalised(F.coalesce(raw, F.lit("")))
    if translit:
        joined = transliterate(joined)
    return F.upper(joined)


def fake_name_score(col) -> Column:
    """Heuristic 0..1 on a cleaned name; '' -> 1.0.  Added in rule order."""
    s = F.coalesce(_c(col), F.lit(""))
    low = F.lower(s)
    junk = F.lit(False)
    for t in K.FAKE_NAME_JUNK:
        junk = junk | F.contains(low, F.lit(t))
    letters = F.regexp_replace(low, r"\P{L}+", "")
    n_distinct = F.when(letters == "", F.lit(0)).otherwise(F.size(F.array_distinct(F.split(letters, ""))))
    ws = f"[{K.WHITESPACE_CLASS}]+"
    body = F.regexp_replace(s, f"^{ws}|{ws}$", "")
    tokens = F.split(body, ws)
    n_tok = F.when(body == "", F.lit(0)).otherwise(F.size(tokens))
    total_len = F.length(F.regexp_replace(s, ws, ""))
    score = (
        F.lit(0.0)
        + F.when(junk, K.FAKE_JUNK_WEIGHT).otherwise(0.0)
        + F.when(n_distinct <= K.FAKE_FEW_LETTERS_MAX, K.FAKE_FEW_LETTERS_WEIGHT).otherwise(0.0)
        + F.when(n_tok < 2, K.FAKE_ONE_TOKEN_WEIGHT).otherwise(0.0)
        + F.when((n_tok > 1) & (F.size(F.array_distinct(tokens)) == 1), K.FAKE_REPEATED_TOKEN_WEIGHT).otherwise(0.0)
        + F.when(total_len < K.FAKE_SHORT_TOTAL, K.FAKE_SHORT_WEIGHT).otherwise(0.0)
    )
    return F.when(s == "", F.lit(1.0)).otherwise(F.least(score, F.lit(1.0)))
