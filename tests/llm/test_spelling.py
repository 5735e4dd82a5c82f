"""Spelling variants against brute force, awkward rows, hot keys."""

import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from farewatch.llm import spelling

DOCS = "doc_id long, text string, word string, n int, form string"
LETTERS = {chr(c) for c in [*range(65, 91), *range(97, 123), *range(0xC0, 0x100)]}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def brute(rows):
    count = Counter()
    for doc, text in rows:
        for letters, run in itertools.groupby(text or "", lambda c: c in LETTERS):
            word = "".join(run)
            if not letters:
                continue
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in word)
            h = zlib.crc32(f"{doc}:{word}".encode())
            if doc is not None and h % 31 == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            count[word] += 1
    words = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted(((w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()), key=str)


def vocabulary_texts(seed):
    """Frequent words, their variants in a tenth of the number, variants of variants, short and accented words."""
    rng = random.Random(seed)
    rows, bag = [], []
    for _ in range(25):
        word = "".join(rng.choice("abcdeé×") for _ in range(rng.randint(6, 11)))
        for n in (300, 25, 2):
            bag += [word] * n
            i = rng.randrange(len(word))
            word = rng.choice([word[:i] + "z" + word[i:], word[:i] + word[i + 1:], word[:i] + "ÿ" + word[i + 1:]])
    bag += ["aaaaaaa"] * 3 + ["aaaaaaaa"] * 40 + ["aaaaaaaaa"] * 40 + ["ÀBCDEFGH", "Àbcdefgh", "àbcdefgh", "àbcdefgh"]
    rng.shuffle(bag)
    for i, at in enumerate(range(0, len(bag), 40)):
        words = [w.upper() if rng.random() < 0.2 and w.isascii() else w for w in bag[at:at + 40]]
        rows.append((i if i != 5 else None, rng.choice([" ", "1", "-", "\n\t"]).join(words)))
    return rows + [(900, None), (901, ""), (902, "€€ 12 - "), (3, rows[3][1]), (3, rows[3][1]), (904, "longword" * 3000), (905, "longword" * 3000)]


def run(spark, rows):
    table = spark.createDataFrame([(d, t, "w", 1, "f") for d, t in rows], DOCS).repartition(3)
    return sorted((tuple(r) for r in spelling.spelling_variants(table).collect()), key=str)


def test_variants_equal_brute_force(spark):
    rows = vocabulary_texts(1)
    want = brute(rows)
    assert run(spark, rows) == want
    assert any(f for _, f, *_ in want) and any(r != (f or w) for w, f, r, *_ in want)


def test_hot_key_is_cut_into_a_grid(spark):
    """All words share their first and last letters; cells hold a few words each."""
    rng = random.Random(2)
    words = sorted({"aaa" + "".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) + "bbb" for _ in range(150)})
    table = spark.createDataFrame([(w, i + 2) for i, w in enumerate(words)], "word string, n long")
    got = Counter(tuple(r) for r in spelling.near_pairs(table, cell_words=20).collect())
    count = {w: i + 2 for i, w in enumerate(words)}
    assert got == Counter((a, b, count[b]) for a, b in itertools.permutations(words, 2) if one_edit(a, b))


@pytest.mark.parametrize("seed", [1, 2])
def test_intervals_of_both_indexes_agree(seed):
    rng = random.Random(seed)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(3, 6))) for _ in range(60)})
    vocabulary = spelling.Vocabulary([w.encode() for w in words])
    text = "\x01" + "\x01".join(words) + "\x01"
    halves = [text[i:i + 3] for i in range(len(text) - 2)] + ["cca", "zzz"]
    codes = np.frombuffer("".join(halves).encode(), dtype=np.uint8).reshape(-1, 3)
    lo, size = spelling.match_half(codes[:, ::-1], vocabulary.left, vocabulary.right)
    back = text[::-1] + "\x00"
    order = sorted(range(len(back)), key=lambda i: back[i:])
    for half, a, n in zip(halves, lo, size):
        starts = [k for k, i in enumerate(order) if back[i:].startswith(half[::-1])]
        assert n == len(starts) and (not starts or a == starts[0])


def test_empty_table(spark):
    assert run(spark, []) == []
