"""Spelling variants: words one edit apart, found by bidirectional FM-index search schemes.

A pair of words one edit apart agrees on the left half or on the right half of
either word.  So each query word is searched twice: its left half is matched
exactly up to the opening delimiter and then extended to the right over the
rest with one error, and its right half is matched exactly up to the closing
delimiter and then extended to the left with one error.  Both searches run on
a pair of FM-indexes, of the delimited vocabulary and of its reversal, whose
suffix-rank intervals are kept in step while a half is matched.

The vocabulary is dealt out twice: by the first three code points for the
searches with an exact left half, and by the last three for those with an
exact right half (words have seven code points at least, so a half has three).
Keys are gathered into cells of about ``CELL_WORDS`` words; a key with more is
cut into a grid of (index slice, query slice) cells, so that no task holds more
and no pair is lost.  An index lives only inside the task of its cell.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from farewatch.llm.common import CRC32_TABLE_SQL, crc32_sql, save

MIN_LENGTH = 7
MIN_COUNT = 2
KEY_LENGTH = 3
# A word's near word is its form if it is so many times as frequent.
FORM_FACTOR = 10
# One in so many occurrences loses a code point (the noise of the stated input).
NOISE_DIVISOR = 31
CELL_WORDS = 8192
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
RUN_PATTERN = r"[a-zÀ-ÿ]"
PAIRS = "word string, near string, near_n long"
# Codes of the text of an index: its end, the delimiter; letters keep their Latin-1 code.
END, DELIMITER = 0, 1


# -- the index --------------------------------------------------------------

def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the sorted suffixes of a byte text that ends in a unique smallest byte."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, dtype=np.uint8)]).astype(np.uint64)
    key = np.zeros(n, dtype=np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | padded[j:j + n]
    step = 8
    while True:
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        fresh = np.r_[0, (ranked[1:] != ranked[:-1]).astype(np.int64)].cumsum()
        if fresh[-1] == n - 1:
            return order
        rank = np.empty(n, dtype=np.uint64)
        rank[order] = fresh.astype(np.uint64)
        later = np.zeros(n, dtype=np.uint64)
        later[:max(0, n - step)] = rank[step:] + np.uint64(1)
        key = rank * np.uint64(n + 1) + later
        step *= 2


class FmIndex:
    """Suffix ranks of one text; a match is an interval (lo, size) of ranks."""

    def __init__(self, text: np.ndarray):
        self.n = len(text)
        self.sa = suffix_array(text)
        self.bwt = text[self.sa - 1]
        order = np.argsort(self.bwt, kind="stable")
        self.symbols = np.unique(self.bwt)
        # (symbol, place) of the last column in order: the rank of (c, i) is the
        # first suffix rank after extending by c.
        self.places = self.bwt[order].astype(np.int64) * (self.n + 1) + order
        self.next = np.empty(self.n, dtype=np.int64)
        self.next[order] = np.arange(self.n)

    def extend(self, lo: np.ndarray, size: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals after putting ``symbol`` before each match."""
        at = symbol.astype(np.int64) * (self.n + 1) + lo
        first = np.searchsorted(self.places, at)
        return first, np.searchsorted(self.places, at + size) - first

    def smaller(self, lo: np.ndarray, size: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """How many matches have a smaller symbol than ``symbol`` before them."""
        out = np.zeros(len(lo), dtype=np.int64)
        for c in self.symbols:
            less = np.flatnonzero(symbol > c)
            if len(less):
                out[less] += self.extend(lo[less], size[less], np.full(len(less), c))[1]
        return out

    def branches(self, lo: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All extensions of each match: (number of the match, symbol, lo, size).

        Equal matches are read once, so a step reads each place of the text at most once a depth.
        """
        distinct, inverse = np.unique(lo * (self.n + 1) + size, return_inverse=True)
        start, length = distinct // (self.n + 1), distinct % (self.n + 1)
        owner = np.repeat(np.arange(len(distinct)), length)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(length) - length, length) + start[owner]
        key, first, count = np.unique(owner * 256 + self.bwt[place], return_index=True, return_counts=True)
        per = np.bincount(key >> 8, minlength=len(distinct))
        begin = np.cumsum(per) - per
        state = np.repeat(np.arange(len(lo)), per[inverse])
        row = np.arange(len(state)) - np.repeat(np.cumsum(per[inverse]) - per[inverse], per[inverse]) + begin[inverse][state]
        return state, (key & 255)[row], self.next[place[first]][row], count[row]


class Vocabulary:
    """The two indexes of a delimited list of distinct words, and the way back from a match to its word."""

    def __init__(self, words: list[bytes]):
        text = np.frombuffer(b"\x01" + b"\x01".join(words) + b"\x01", dtype=np.uint8)
        end = np.zeros(1, dtype=np.uint8)
        self.left = FmIndex(np.concatenate([text, end]))
        self.right = FmIndex(np.concatenate([text[::-1], end]))
        self.delimiters = np.flatnonzero(text == DELIMITER)
        self.length = len(text)

    def opening(self, rank: np.ndarray) -> np.ndarray:
        """Words whose opening delimiter starts the suffix of this rank of the left index."""
        return np.searchsorted(self.delimiters, self.left.sa[rank])

    def closing(self, rank: np.ndarray) -> np.ndarray:
        """Words whose closing delimiter starts the suffix of this rank of the right index."""
        return np.searchsorted(self.delimiters, self.length - 1 - self.right.sa[rank]) - 1


def match_half(exact: np.ndarray, first: FmIndex, second: FmIndex) -> tuple[np.ndarray, np.ndarray]:
    """Match the rows of ``exact``, symbol by symbol, in ``first``; returns the intervals in ``second``.

    Both intervals are kept: extending a match by c moves the interval of the
    other index past the matches that are extended by smaller symbols.
    """
    rows, inverse = np.unique(exact, axis=0, return_inverse=True)
    inverse = inverse.reshape(-1)
    lo, other, size = (np.full(len(rows), x, dtype=np.int64) for x in (0, 0, first.n))
    for symbol in rows.T:
        other = other + first.smaller(lo, size, symbol)
        lo, size = first.extend(lo, size, symbol)
    return other[inverse], size[inverse]


def extend_with_error(rest: np.ndarray, lo: np.ndarray, size: np.ndarray, index: FmIndex) -> tuple[np.ndarray, np.ndarray]:
    """(query, suffix rank) of what continues each match by its row of ``rest`` with exactly one error.

    The last symbol of a row is the delimiter.  An inserted symbol differs from the
    one that follows and a deleted one from the next, which leaves out only
    repetitions of the same word.
    """
    live = np.flatnonzero(size > 0)
    lo, size = lo[live], size[live]
    none = np.zeros(0, dtype=np.int64)
    query, at, n = none, none, none  # matches with their error behind them
    for j in range(rest.shape[1]):
        expected = rest[live, j]
        state, symbol, b_lo, b_size = index.branches(lo, size)
        letter = (symbol > DELIMITER) & (symbol != expected[state])
        # Inserted here, then the expected symbol.
        query, at, n = (np.concatenate(p) for p in zip(
            (query, at, n), (live[state[letter]], b_lo[letter], b_size[letter]), strict=True))
        at, n = index.extend(at, n, rest[query, j])
        found = n > 0
        query, at, n = query[found], at[found], n[found]
        # Replaced, or left out.
        swap = letter & (expected[state] != DELIMITER)
        skip = expected != DELIMITER
        if j + 1 < rest.shape[1]:
            skip &= expected != rest[live, j + 1]
        query, at, n = (np.concatenate(p) for p in zip(
            (query, at, n), (live[state[swap]], b_lo[swap], b_size[swap]), (live[skip], lo[skip], size[skip]), strict=True))
        lo, size = index.extend(lo, size, expected)
        on = size > 0
        live, lo, size = live[on], lo[on], size[on]
    return query, at


def near_of_length(queries: np.ndarray, words: Vocabulary, left_exact: bool) -> tuple[np.ndarray, np.ndarray]:
    """(query, word) pairs one edit apart, for queries of one length as rows of symbols.

    ``left_exact``: those that agree with the query's left half; otherwise those
    that agree with its right half and not with its left half.
    """
    half = queries.shape[1] // 2
    edge = np.full((len(queries), 1), DELIMITER, dtype=np.uint8)
    left, right = np.concatenate([queries[:, :half][:, ::-1], edge], axis=1), np.concatenate([queries[:, half:], edge], axis=1)
    exact, rest = (left, right) if left_exact else (right, left)
    first, second = (words.left, words.right) if left_exact else (words.right, words.left)
    query, rank = extend_with_error(rest, *match_half(exact, first, second), second)
    return query, (words.closing if left_exact else words.opening)(rank)


def _cell(group: pd.DataFrame) -> pd.DataFrame:
    indexed = group[group["indexed"]]
    left_exact = bool(group["left"].iloc[0])
    texts, counts = indexed["word"].to_numpy(), indexed["n"].to_numpy()
    queries = group.loc[~group["indexed"], "word"].to_numpy()
    out = []
    if len(texts) and len(queries):
        words = Vocabulary([t.encode("latin-1") for t in texts])
        lengths = np.array([len(q) for q in queries])
        for length in np.unique(lengths):
            own = queries[lengths == length]
            codes = np.frombuffer("".join(own).encode("latin-1"), dtype=np.uint8).reshape(len(own), length)
            query, word = near_of_length(codes, words, left_exact)
            pairs = np.unique(query * len(texts) + word)
            query, word = pairs // len(texts), pairs % len(texts)
            frame = pd.DataFrame({"word": own[query], "near": texts[word], "near_n": counts[word]})
            if not left_exact:
                half = length // 2
                frame = frame[[w[:half] != x[:half] for w, x in zip(frame["word"], frame["near"], strict=True)]]
            out.append(frame)
    return pd.concat(out) if out else pd.DataFrame(columns=["word", "near", "near_n"]).astype({"near_n": "int64"})


# -- on Spark ---------------------------------------------------------------

def noisy(doc_id: Column, run: Column) -> Column:
    """The run without one code point where NOISE_DIVISOR divides the crc32 of ``<doc_id>:<run>``."""
    h = F.crc32(F.encode(F.concat(doc_id.cast("string"), F.lit(":"), run), "UTF-8"))
    at = (h % F.char_length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + F.lit(2), F.char_length(run)))
    return F.when(h % NOISE_DIVISOR == 0, cut).otherwise(run)


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): the words of at least MIN_LENGTH code points and MIN_COUNT occurrences in all texts."""
    runs = F.regexp_extract_all(F.translate("text", UPPER, UPPER.lower()), F.lit(f"({RUN_PATTERN}{{{MIN_LENGTH},}})"), F.lit(1))
    words = docs.select(F.col("doc_id").alias("id"), F.explode(runs).alias("run"))
    words = words.select(noisy(F.col("id"), F.col("run")).alias("noisy"), "run").select(F.coalesce("noisy", "run").alias("word"))
    return (words.where(F.char_length("word") >= MIN_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= MIN_COUNT))


def near_pairs(words: DataFrame, cell_words: int = CELL_WORDS) -> DataFrame:
    """(word, near, near_n): every ordered pair of the distinct ``words`` (word, n) that are one edit apart.

    Words are of Latin-1 letters and at least 2 * KEY_LENGTH code points.
    """
    sides = words.select("word", "n", F.explode(F.array(
        F.struct(F.lit(True).alias("left"), F.substring("word", 1, KEY_LENGTH).alias("key")),
        F.struct(F.lit(False).alias("left"), F.expr(f"right(word, {KEY_LENGTH})").alias("key")))).alias("s")).select("word", "n", "s.*")
    keys = sides.groupBy("left", "key").agg(F.count(F.lit(1)).alias("m"))
    keys = keys.select("left", "key", F.ceil(F.col("m") / cell_words).cast("int").alias("slices"))
    cells = max(1, words.count() // cell_words)
    placed = (sides.join(save(keys, "spelling-keys"), ["left", "key"])
              .withColumn("cell", F.pmod(F.xxhash64("key"), F.lit(cells)))
              .withColumn("own", F.pmod(F.xxhash64("word"), F.col("slices")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))))
    # A word is indexed in every cell of its row of the grid and asked in every cell of its column.
    rows = placed.select("left", "cell", "word", "n", F.explode(F.array(
        F.struct(F.lit(True).alias("indexed"), F.col("own").alias("i"), F.col("other").alias("j")),
        F.struct(F.lit(False).alias("indexed"), F.col("other").alias("i"), F.col("own").alias("j")))).alias("g"))
    return (rows.select("left", "cell", "word", "n", "g.*").groupBy("left", "cell", "i", "j")
            .applyInPandas(_cell, PAIRS))


def follow_forms(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form, n): forms followed to the last, by doubling the steps.

    A form is FORM_FACTOR times as frequent as its word, which bounds the chain's
    length by the logarithm of the largest count.
    """
    top = forms.agg(F.max("n")).first()[0] or 1
    steps = save(forms.select("word", F.coalesce("form", "word").alias("root")), "spelling-roots")
    reach, longest = 1, len(str(top // MIN_COUNT))
    while reach < longest:
        # Only words that lead somewhere are joined, with what those lead to.
        moving = steps.where("word <> root")
        onward = moving.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = moving.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
        steps = save(steps.where("word = root").unionByName(moved), "spelling-roots")
        reach *= 2
    return steps


def spelling_variants(docs: DataFrame) -> DataFrame:
    """One row per word: word, form, root (string), n, n_near, form_n (long).

    Words are the runs of Latin letters of all texts, A-Z lower-cased, with the
    stated noise, of at least MIN_LENGTH code points and MIN_COUNT occurrences.
    Two words are near if one code point is inserted, deleted or replaced.
    ``form`` is the near word of largest n (ties: smallest in code-point order)
    if that is at least FORM_FACTOR times the word's n, else null; ``root`` follows
    the forms to the last.  Null and empty texts have no words; the runs of a row
    with a null doc_id keep all code points; repeated rows count as often as
    they occur; an empty table gives no rows.  Other columns are not read.
    """
    words = save(vocabulary(docs), "spelling-words")
    best = near_pairs(words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("rank"), "near")).alias("best"))
    known = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        (-F.col("best.rank")).alias("near_n"), F.col("best.near").alias("near"))
    is_form = F.col("near_n") >= FORM_FACTOR * F.col("n")
    known = save(known.select("word", "n", "n_near", F.when(is_form, F.col("near")).alias("form"),
                              F.when(is_form, F.col("near_n")).alias("form_n")), "spelling-forms")
    return known.join(follow_forms(known), "word").select("word", "form", "root", "n", "n_near", "form_n")


@cache
def oracle_sql() -> str:
    return f"""
WITH RECURSIVE {CRC32_TABLE_SQL},
runs AS (SELECT doc_id, run, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents) GROUP BY ALL),
hashed AS (SELECT run, k, {crc32_sql('s')} AS h
  FROM (SELECT run, k, coalesce(CAST(doc_id AS VARCHAR) || ':' || run, '') AS s FROM runs), crc),
w AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (SELECT k, CASE WHEN h % {NOISE_DIVISOR} = 0 THEN
    substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(k) >= {MIN_COUNT}),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS c
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
near AS (SELECT a.word, a.n, b.word AS x, b.n AS xn FROM cut a JOIN cut b ON a.c = b.c AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM cut a JOIN w b ON a.c = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM cut a JOIN w b ON a.c = b.word),
best AS (SELECT word, count(*) AS n_near, max(xn) AS xn, arg_min(x, (-xn, encode(x))) AS x FROM near GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN xn >= {FORM_FACTOR} * w.n THEN x END AS form,
    CASE WHEN xn >= {FORM_FACTOR} * w.n THEN xn END AS form_n FROM w LEFT JOIN best USING (word)),
chain(word, last, form) AS (SELECT word, word, form FROM forms
  UNION ALL SELECT c.word, c.form, f.form FROM chain c JOIN forms f ON f.word = c.form)
SELECT f.word, f.form, c.last AS root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c ON c.word = f.word AND c.form IS NULL"""
