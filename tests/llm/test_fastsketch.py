"""Fast similarity sketching against plain sketches, brute-force links and awkward rows."""

import itertools
import random
import re

import numpy as np
import pytest

from farewatch.llm import fastsketch, jaccard
from farewatch.llm.texthash import mix

DOCS = "doc_id long, text string, row int, part string, component_id long, kept string"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text, k=4):
    w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in WORD.findall((text or "").encode())]
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, threshold=80):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if rows[a][0] is None or rows[b][0] is None or not sets[a] or not sets[b]:
            continue
        o = len(sets[a] & sets[b])
        if rows[a][0] == rows[b][0] or 100 * o >= threshold * (len(sets[a]) + len(sets[b]) - o):
            parent[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            # Texts without words link with nothing, not even with another text of their document.
            least[find(i)] = min(least.get(find(i), d), d)
    of_doc = {}
    for i, (d, _) in enumerate(rows):
        if d is not None and sets[i]:
            of_doc[d] = least[find(i)]
    out = []
    for i, (d, _) in enumerate(rows):
        c = None if d is None else of_doc.get(d, d)
        out.append((d, len(sets[i]), c, d is None or c == d))
    return sorted(out, key=str)


def run(spark, rows, parts=3):
    table = spark.createDataFrame([(d, t, 1, "p", 2, "k") for d, t in rows], DOCS).repartition(parts)
    return sorted((tuple(r) for r in fastsketch.near_duplicates(table).collect()), key=str)


def corpus(seed, groups=5, size=14):
    """Groups of chained edits, documents around a shared passage, short, empty and repeated ones."""
    rng = random.Random(seed)
    word = [f"w{i}" for i in range(4000)]
    texts = [None, "", " \n", "one", "One", "one two three", "a b c d", "A b c d", "a b c d e", "x " * 400, "x " * 30]
    for _ in range(groups):
        text = rng.choices(word, k=rng.randint(25, 120))
        for _ in range(size):
            text = list(text)
            for _ in range(rng.randint(0, 2)):
                text[rng.randrange(len(text))] = rng.choice(word)
            texts.append(" ".join(text))
    passage = rng.choices(word, k=60)
    texts += [" ".join(passage + rng.choices(word, k=rng.randint(4, 40))) for _ in range(60)]
    texts += rng.choices(texts, k=30) + [" ".join(rng.choices(word, k=20_000))] * 2
    rng.shuffle(texts)
    return [(i * 3 + 2, t) for i, t in enumerate(texts)]


def test_sketches_equal_the_plain_algorithm():
    rng = np.random.default_rng(1)
    sizes = [1, 2, 3, 10, 127, 500, 3000]
    items = [rng.integers(0, 2**63, n, dtype=np.uint64) for n in sizes]
    got = fastsketch.similarity_sketches(np.concatenate(items), np.cumsum([0, *sizes]))
    t = fastsketch.COORDINATES
    for own, sketch in zip(items, got):
        want = [None] * t
        for number in range(2 * t):
            hashes = mix(own + np.uint64(fastsketch._ROUND_SALT * (number + 1) % 2**64)).tolist()
            for h in hashes:
                at = h >> (64 - 7) if number < t else number - t
                value = (number, h % 2**fastsketch._VALUE_BITS)
                if want[at] is None or value < want[at]:
                    want[at] = value
        assert [(v >> fastsketch._VALUE_BITS, v % 2**fastsketch._VALUE_BITS) for v in sketch.tolist()] == want


@pytest.mark.parametrize("n", [8, 60, 400])
def test_every_bin_fills_and_agreement_estimates_similarity(n):
    rng = np.random.default_rng(n)
    shared, errors = n * 3 // 4, []
    similarity = shared / (2 * n - shared)
    for _ in range(60):
        pool = rng.integers(0, 2**63, 2 * n - shared, dtype=np.uint64)
        pair = np.concatenate([pool[:n], pool[n - shared:]])
        a, b = fastsketch.similarity_sketches(pair, np.array([0, n, 2 * n]))
        assert (a != fastsketch._EMPTY).all() and (b != fastsketch._EMPTY).all()
        errors.append((a == b).mean() - similarity)
    sigma = (similarity * (1 - similarity) / fastsketch.COORDINATES) ** 0.5
    assert abs(np.mean(errors)) < 4 * sigma / 60**0.5 and np.std(errors) < 1.4 * sigma


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_equal_brute_force(spark, seed):
    rows = corpus(seed)
    rows += [(None, rows[5][1]), (None, rows[5][1]), (8, rows[9][1]), (8, rows[9][1])]
    assert run(spark, rows) == brute(rows)


def test_repeated_ids_with_different_texts(spark):
    """Links of a document's several texts are found however its rows are spread."""
    rng = random.Random(4)
    word = [f"w{i}" for i in range(500)]
    a, b = (" ".join(rng.choices(word, k=40)) for _ in range(2))
    near = b + " extra"
    rows = [(1, a), (2, a), (2, b), (3, near), (4, "alone and short"), (4, "")]
    want = brute(rows)
    assert {d: c for d, _, c, _ in want} == {1: 1, 2: 1, 3: 1, 4: 4}
    for parts in (1, 4):
        assert run(spark, rows, parts) == want


def test_large_buckets_of_different_classes(spark, monkeypatch):
    """Documents that share most of their words, but not enough, with linked pairs among them."""
    monkeypatch.setattr(fastsketch, "CENTRE_SHARE", 4)
    monkeypatch.setattr(jaccard, "LIST_CELL", 8)
    rng = random.Random(9)
    word = [f"w{i}" for i in range(9000)]
    passage, rows = rng.choices(word, k=70), []
    for _ in range(40):
        own = rng.choices(word, k=25)
        for _ in range(2):
            text = passage + own
            text[rng.randrange(len(text))] = rng.choice(word)
            rows.append((len(rows), " ".join(text)))
    want = brute(rows)
    assert len({c for _, _, c, _ in want}) > 20
    assert run(spark, rows) == want


def test_empty_table(spark):
    assert run(spark, []) == []
