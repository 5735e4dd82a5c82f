"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared in a normal form: lower case, every run of
characters that are not letters or digits as one space.  An item of length n
may occur with up to ``floor(ERROR_RATE * n)`` = k character edits.  It is cut
into k + 1 pieces; an occurrence with at most k edits contains at least one
piece unchanged.  One automaton finds all pieces of all items in a text; the
text around each hit is verified with Myers' bit-parallel edit distance.
Items too short for an edit occur as whole words; items without letters and
digits are searched in the raw text instead of the normal form.

The items are the stated query set.  They go to the tasks in blocks of bounded
size, one scan of the documents per block; documents are scanned where they
are and never shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from farewatch.llm.common import save

ERROR_RATE = 0.075
# Items with fewer characters are not searched: items of every length are.
MIN_CHARS = 1
# Items without an edit and with fewer characters than this occur as whole words only.
WORD_CHARS = 14
# Text bytes of the items sent to the tasks at once.
BLOCK_BYTES = 4 << 20
MATCHES = "doc_id long, item_id long, distance int, match_end long"
_GAP = re.compile(r"[\W_]+")
# Scripts written without spaces between words: Thai to Lao, Myanmar, Khmer, kana and ideographs.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff"
                       "\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")


def normal_form(text: str | None) -> str:
    return _GAP.sub(" ", text.lower()).strip() if text else ""


def raw_form(text: str | None) -> str:
    """The text with every run of white space as one space."""
    return " ".join(text.split()) if text else ""


def whole_words(line: str, begin: int, end: int) -> bool:
    """Whether words begin and end at both edges of ``line[begin:end]``, a part of a normal form."""
    return all(a == " " or b == " " or _UNSPACED.match(a) or _UNSPACED.match(b)
               for a, b in (line[at - 1:at + 1] for at in (begin, end) if 0 < at < len(line)))


def pieces(pattern: str, k: int) -> list[tuple[int, str]]:
    """(offset, piece) of k + 1 pieces of near-equal length that make up the pattern."""
    cuts = [i * len(pattern) // (k + 1) for i in range(k + 2)]
    return [(a, pattern[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def char_masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def best_match(masks: dict[str, int], m: int, text: str, k: int) -> tuple[int, int] | None:
    """(distance, end) of the occurrence with the fewest edits anywhere in ``text``, if at most ``k``.

    Of equal distances the first end is taken.  One step per character on
    m-bit integers.
    """
    full, high = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, at = k + 1, 0
    for j, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        vertical = eq | down
        across = (((eq & up) + up) ^ up) | eq
        grow = down | ~(across | up)
        shrink = up & across
        if grow & high:
            score += 1
        elif shrink & high:
            score -= 1
            if score < best:
                best, at = score, j
        grow <<= 1
        shrink <<= 1
        up = (shrink | ~(vertical | grow)) & full
        down = grow & vertical & full
    return (best, at) if best <= k else None


class Patterns:
    """Items in one form: piece automaton and verification tables."""

    def __init__(self, items: list[tuple[int | None, str]], error_rate: float, words: bool):
        import ahocorasick

        self.items, found = [], {}
        for number, (item_id, pattern) in enumerate(items):
            k = int(error_rate * len(pattern))
            bounded = words and not k and len(pattern) < WORD_CHARS
            self.items.append((item_id, pattern, k, char_masks(pattern) if k else None, bounded))
            for offset, piece in pieces(pattern, k):
                found.setdefault(piece, []).append((number, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), places))
        if found:
            self.automaton.make_automaton()

    def matches(self, line: str) -> list[tuple[int | None, int, int]]:
        """(item_id, distance, end) of each item that occurs in ``line``."""
        starts: dict[int, set[int]] = {}
        exact: dict[int, int] = {}
        for end, (length, places) in self.automaton.iter(line):
            for number, offset in places:
                _, _, k, _, bounded = self.items[number]
                if k:
                    starts.setdefault(number, set()).add(end + 1 - length - offset)
                elif number not in exact and (not bounded or whole_words(line, end + 1 - length, end + 1)):
                    exact[number] = end + 1
        out = [(self.items[number][0], 0, end) for number, end in exact.items()]
        for number, begins in starts.items():
            item_id, pattern, k, masks, _ = self.items[number]
            best, reach = None, None
            # Hits whose windows overlap are verified in one go.
            for begin in [*sorted(begins), None]:
                if reach is not None and (begin is None or begin - k > reach[1]):
                    a = max(0, reach[0])
                    hit = best_match(masks, len(pattern), line[a:reach[1]], k)
                    if hit and (best is None or hit[0] < best[0]):
                        best = (hit[0], hit[1] + a)
                    reach = None
                if begin is not None:
                    reach = (begin - k if reach is None else reach[0], begin + len(pattern) + k)
            if best is not None:
                out.append((item_id, *best))
        return out


class Matcher:
    """All items of a block: those with a normal form, and the rest by their raw form."""

    def __init__(self, items: list[tuple[int | None, str]], error_rate: float, min_chars: int):
        normal = [(item_id, normal_form(text)) for item_id, text in items]
        raw = [(item_id, raw_form(text)) for (item_id, text), (_, pattern) in zip(items, normal, strict=True) if not pattern]
        self.groups = []
        for form, forms, words in ((normal_form, normal, True), (raw_form, raw, False)):
            searched = [(item_id, pattern) for item_id, pattern in forms if len(pattern) >= max(1, min_chars)]
            if searched:
                self.groups.append((form, Patterns(searched, error_rate, words)))

    def matches(self, text: str | None) -> list[tuple[int | None, int, int]]:
        """(item_id, distance, end in the item's form of the text) of each item that occurs in ``text``."""
        return [m for form, patterns in self.groups for m in patterns.matches(form(text))] if text else []


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES):
    """The items as lists of (item_id, text), each of about ``block_bytes`` at most."""
    items = save(benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
                 .where("text IS NOT NULL"), "benchmark-items")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes)
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        yield [(r["item_id"], r["text"]) for r in own.collect()]


def _match_task(items, error_rate: float, min_chars: int):
    def run(batches):
        import pyarrow as pa

        matcher = Matcher(items, error_rate, min_chars)
        for batch in batches:
            rows = [(doc, *m) for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True)
                    for m in matcher.matches(text.as_py())]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)],
                names=["doc_id", "item_id", "distance", "match_end"])
    return run


def _clean_task(items, error_rate: float, min_chars: int):
    def run(batches):
        import pyarrow as pa

        matcher = Matcher(items, error_rate, min_chars)
        for batch in batches:
            yield batch.filter(pa.array([not matcher.matches(t.as_py()) for t in batch.column("text")], pa.bool_()))
    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per document and benchmark item that occurs in it.

    Columns: doc_id, item_id, distance (fewest edits), match_end (end of the
    first such occurrence, in characters of the normal form).  Items of every
    length are searched: without room for an edit (under 14 characters at the
    default rate) as whole words, where each character of a script written
    without spaces is a word.  Items without letters and digits are searched,
    and their match_end counted, in the raw text with white space runs as one
    space.  Null and empty texts match nothing; null and blank item texts, and
    items under ``min_chars`` characters, are not searched; repeated rows of either table give repeated rows; rows with a null
    id are matched like others.  Without items or documents there are no rows.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for items in item_blocks(benchmark):
        found = texts.mapInArrow(_match_task(items, error_rate, min_chars), MATCHES)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], MATCHES) if out is None else out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, min_chars: int = MIN_CHARS) -> DataFrame:
    """The rows of ``docs``, all columns, in which no item occurs (see ``find_leaks``)."""
    for items in item_blocks(benchmark):
        docs = docs.mapInArrow(_clean_task(items, error_rate, min_chars), docs.schema)
    return docs
