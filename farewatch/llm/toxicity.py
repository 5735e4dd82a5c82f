"""Toxicity scores from a bidirectional gated recurrent network with attention pooling.

A word's input is a word vector (vocabulary of the training sample; one vector
for all other words) beside the mean vectors of its character trigrams and of
its beginnings of 4 to 8 characters (as UTF-8 bytes).  Two
gated recurrent layers read a window of ``WINDOW`` words forwards and backwards;
attention pools their states; a logistic unit gives the window's probability.
Every text is scored in overlapping windows to its end; the document's score
is its highest window.

Training (numpy, in one task) uses a bounded sample of labelled documents; the
driver sees only the finished network.
Documents, not windows, carry labels: after a first phase that labels every
window like its document, a toxic document is represented by its currently
highest window, while windows of clean documents (half of them such highest ones) stay
examples of label 0.

Scoring runs where the documents are, without a shuffle; per task block the
vectors of each distinct word are projected once.
"""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from farewatch.llm.texthash import Hasher, mix, text_blocks

WINDOW, STRIDE = 64, 32
THRESHOLD = 0.3
# The sample: labelled documents per class and bytes of one of them, at most.
TRAIN_DOCS = {1: 1000, 0: 2000}
TRAIN_BYTES = 16000
VOCABULARY, MIN_DOCS = 20_000, 2
WORD_DIM, CHAR_DIM, HIDDEN = 8, 8, 8
TRIGRAMS, BEGINNINGS, BEGIN_FROM, BEGIN_TO = 4096, 1 << 17, 4, 8
STEPS, WEAK_STEPS, BATCH, TOXIC_SHARE, RATE, UNKNOWN_RATE = 400, 80, 150, 6, 0.01, 0.3
N_REPEATED = 20
HELD_OUT_PARTS, HELD_OUT = 4, 2
CHUNK = 4096
SCORES = "doc_id long, score double"


def separators() -> np.ndarray:
    """ASCII bytes that are not letters or digits end a word here."""
    table = np.zeros(256, dtype=bool)
    table[:128] = [not chr(c).isalnum() for c in range(128)]
    return table


def word_hasher() -> Hasher:
    return Hasher(1, fold_case=True, space=separators())


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % HELD_OUT_PARTS == HELD_OUT


def char_codes(block, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Character input of the given words of a block: trigram buckets, the start of each word's run
    of them, and a matrix of the buckets of its beginnings.  Beyond a word's edges counts as 0."""
    data = block.data.astype(np.int64)
    data[(data >= 65) & (data <= 90)] += 32
    starts, ends = block.starts[words], block.ends[words]
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    at = np.repeat(starts - first, sizes) + np.arange(int(sizes.sum()))
    before = np.where(at == np.repeat(starts, sizes), 0, data[np.maximum(at - 1, 0)])
    after = np.where(at == np.repeat(ends, sizes) - 1, 0, data[np.minimum(at + 1, len(data) - 1)])
    code = (before * 65599 + data[at]) * 65599 + after
    begin, begins = np.zeros(len(words), dtype=np.uint64), []
    for i in range(BEGIN_TO):
        begin = begin * np.uint64(1099511628211) + np.where(i < sizes, data[np.minimum(starts + i, len(data) - 1)], 0).astype(np.uint64)
        if i >= BEGIN_FROM - 1:
            begins.append((mix(begin) % np.uint64(BEGINNINGS)).astype(np.int64))
    return (code * 2654435761 >> 12) % TRIGRAMS, first, np.stack(begins, axis=1)


def window_starts(n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, first word in the text) of all windows; texts without words have none."""
    count = np.where(n_words > 0, np.maximum(1, -(-(n_words - WINDOW) // STRIDE) + 1), 0)
    texts = np.repeat(np.arange(len(n_words)), count)
    return texts, (np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)) * STRIDE


def sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


def scatter(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the values that go to each of ``n`` rows."""
    return np.stack([np.bincount(rows, values[:, c], n) for c in range(values.shape[1])], axis=1).astype(values.dtype)


class Network:
    """Parameters ``p`` and the two passes over (windows x words) inputs."""

    def __init__(self, vocabulary: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)

        def normal(*shape, scale=0.3):
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        self.vocabulary = vocabulary  # sorted word hashes; vector i + 1 is word i's, 0 that of all others
        inputs, both = WORD_DIM + 2 * CHAR_DIM, 2 * HIDDEN
        self.p = {"word": normal(len(vocabulary) + 1, WORD_DIM), "char": normal(TRIGRAMS, CHAR_DIM), "begin": normal(BEGINNINGS, CHAR_DIM, scale=0.01),
                  "att": normal(both, both), "att_v": normal(both), "out": normal(both), "out_b": np.array([-2.0], np.float32)}
        for d in "fb":
            self.p |= {f"w{d}": normal(inputs, 3 * HIDDEN), f"u{d}": normal(HIDDEN, 3 * HIDDEN), f"b{d}": np.zeros(3 * HIDDEN, np.float32)}

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, vocabulary=self.vocabulary, **self.p)
        return out.getvalue()

    @classmethod
    def load(cls, content: bytes) -> Network:
        with np.load(io.BytesIO(content)) as arrays:
            net = cls(arrays["vocabulary"])
            net.p = {k: arrays[k] for k in net.p}
        return net

    def word_ids(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(hashes), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)

    def inputs(self, ids: np.ndarray, grams: np.ndarray, first: np.ndarray, begins: np.ndarray) -> np.ndarray:
        sizes = np.diff(np.r_[first, len(grams)]).astype(np.float32)[:, None]
        chars = np.add.reduceat(self.p["char"][grams], first, axis=0) / sizes if len(first) else np.zeros((0, CHAR_DIM), np.float32)
        return np.concatenate([self.p["word"][ids], chars, self.p["begin"][begins].mean(axis=1)], axis=1)

    def _direction(self, d: str, gates: np.ndarray, mask: np.ndarray, keep: list | None):
        """States (time x windows x HIDDEN) of one direction; ``gates`` are the projected inputs."""
        u, n_steps = self.p[f"u{d}"], gates.shape[0]
        h = np.zeros((gates.shape[1], HIDDEN), dtype=np.float32)
        out = np.empty((n_steps, gates.shape[1], HIDDEN), dtype=np.float32)
        for t in range(n_steps) if d == "f" else range(n_steps - 1, -1, -1):
            g, hu = gates[t], h @ u
            zr = sigmoid(g[:, :2 * HIDDEN] + hu[:, :2 * HIDDEN])
            z, r, hn = zr[:, :HIDDEN], zr[:, HIDDEN:], hu[:, 2 * HIDDEN:]
            n = np.tanh(g[:, 2 * HIDDEN:] + r * hn)
            new = n + z * (h - n)
            if keep is not None:
                keep.append((t, h, z, r, n, hn))
            h = np.where(mask[t][:, None], new, h)
            out[t] = h
        return out

    def forward(self, gates: dict[str, np.ndarray], mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logit per window; ``gates`` per direction and ``mask`` are (time x windows [x 3 HIDDEN])."""
        steps = {d: [] if keep is not None else None for d in "fb"}
        states = np.concatenate([self._direction(d, gates[d], mask, steps[d]) for d in "fb"], axis=2)
        a = np.tanh(states @ self.p["att"])
        e = np.where(mask, a @ self.p["att_v"], np.float32(-1e9))
        e = np.exp(e - e.max(axis=0))
        alpha = e / e.sum(axis=0)
        context = np.einsum("tb,tbh->bh", alpha, states)
        if keep is not None:
            keep |= {"steps": steps, "states": states, "a": a, "alpha": alpha, "context": context}
        return context @ self.p["out"] + self.p["out_b"][0]

    def gradients(self, x: np.ndarray, inverse: np.ndarray, mask: np.ndarray, labels: np.ndarray, weights: np.ndarray):
        """(loss, gradients, gradient of x) for windows whose words are ``x[inverse]`` (time x windows)."""
        gates = {d: (x @ self.p[f"w{d}"] + self.p[f"b{d}"])[inverse] for d in "fb"}
        keep: dict = {}
        logit = self.forward(gates, mask, keep)
        prob = sigmoid(logit)
        loss = -(weights * np.where(labels > 0, np.log(prob + 1e-7), np.log(1 - prob + 1e-7))).sum()
        d_logit = (weights * (prob - labels)).astype(np.float32)
        states, a, alpha, context = (keep[k] for k in ("states", "a", "alpha", "context"))
        g = {"out": context.T @ d_logit, "out_b": np.array([d_logit.sum()], np.float32)}
        d_context = d_logit[:, None] * self.p["out"]
        d_alpha = np.einsum("bh,tbh->tb", d_context, states)
        d_e = alpha * (d_alpha - (alpha * d_alpha).sum(axis=0))
        d_a = d_e[:, :, None] * self.p["att_v"] * (1 - a * a)
        g["att_v"] = np.einsum("tb,tbh->h", d_e, a)
        g["att"] = np.einsum("tbh,tbk->hk", states, d_a)
        d_states = alpha[:, :, None] * d_context + d_a @ self.p["att"].T
        d_x = np.zeros_like(x)
        for i, d in enumerate("fb"):
            u = self.p[f"u{d}"]
            d_h = np.zeros((mask.shape[1], HIDDEN), dtype=np.float32)
            d_gates = np.empty_like(gates[d])
            g[f"u{d}"] = np.zeros_like(u)
            for t, h, z, r, n, hn in reversed(keep["steps"][d]):
                d_h = d_h + d_states[t, :, i * HIDDEN:(i + 1) * HIDDEN]
                live = mask[t][:, None]
                d_new = d_h * live
                d_n = d_new * (1 - z) * (1 - n * n)
                d_z = d_new * (h - n) * z * (1 - z)
                d_r = d_n * hn * r * (1 - r)
                d_gates[t] = np.concatenate([d_z, d_r, d_n], axis=1)
                d_hu = np.concatenate([d_z, d_r, d_n * r], axis=1)
                g[f"u{d}"] += h.T @ d_hu
                d_h = d_h * ~live + d_new * z + d_hu @ u.T
            by_word = scatter(inverse.ravel(), d_gates.reshape(-1, 3 * HIDDEN), len(x))
            g[f"w{d}"], g[f"b{d}"] = x.T @ by_word, by_word.sum(axis=0)
            d_x += by_word @ self.p[f"w{d}"].T
        return loss, g, d_x


class Sample:
    """The training documents as windows of distinct-word numbers."""

    def __init__(self, texts: list[str], labels: list[int]):
        import pyarrow as pa

        hasher, hashes, grams, sizes, begins, rows = word_hasher(), [], [], [], [], []
        self.labels = np.array(labels)
        base = 0
        for block in text_blocks(pa.array(texts, pa.string()), hasher):
            _, at, inverse = np.unique(block.hashes[0], return_index=True, return_inverse=True)
            code, first, begin = char_codes(block, at)
            begins.append(begin)
            hashes.append(block.hashes[0][at])
            grams.append(code)
            sizes.append(np.diff(np.r_[first, len(code)]))
            rows += [inverse[a:b] + base for a, b in zip(block.first[:-1], block.first[1:], strict=True)]
            base += len(at)
        self.hashes, self.grams = np.concatenate(hashes), np.concatenate(grams)
        self.sizes, self.begins = np.concatenate(sizes), np.concatenate(begins)
        self.first = np.cumsum(self.sizes) - self.sizes
        docs, offsets = window_starts(np.array([len(r) for r in rows]))
        self.docs = docs
        self.words = np.zeros((WINDOW, len(docs)), dtype=np.int64)
        self.mask = np.zeros((WINDOW, len(docs)), dtype=bool)
        for w, (doc, a) in enumerate(zip(docs, offsets, strict=True)):
            own = rows[doc][a:a + WINDOW]
            self.words[:len(own), w], self.mask[:len(own), w] = own, True
        seen: dict[int, int] = {}
        for r in rows:
            for h in np.unique(self.hashes[r]).tolist():
                seen[h] = seen.get(h, 0) + 1
        common = sorted((h for h, n in seen.items() if n >= MIN_DOCS), key=lambda h: (-seen[h], h))[:VOCABULARY]
        self.vocabulary = np.array(sorted(common), dtype=np.uint64)

    def distinct(self, words: np.ndarray):
        """(word numbers, inverse, character input) of the distinct words of some windows."""
        used, inverse = np.unique(words, return_inverse=True)
        sizes = self.sizes[used]
        first = np.cumsum(sizes) - sizes
        at = np.repeat(self.first[used] - first, sizes) + np.arange(int(sizes.sum()))
        return used, inverse.reshape(words.shape), (self.grams[at], first, self.begins[used])

    def logits(self, net: Network, windows: np.ndarray) -> np.ndarray:
        out = []
        for a in range(0, len(windows), CHUNK):
            some = windows[a:a + CHUNK]
            used, inverse, chars = self.distinct(self.words[:, some])
            x = net.inputs(net.word_ids(self.hashes[used]), *chars)
            gates = {d: (x @ net.p[f"w{d}"] + net.p[f"b{d}"])[inverse] for d in "fb"}
            out.append(net.forward(gates, self.mask[:, some]))
        return np.concatenate(out) if out else np.zeros(0, dtype=np.float32)


def summed(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct row numbers and the sums of their values."""
    distinct, inverse = np.unique(rows, return_inverse=True)
    return distinct, scatter(inverse, values, len(distinct))


def highest_windows(net: Network, sample: Sample, windows: np.ndarray) -> np.ndarray:
    """Of some windows, each document's highest."""
    order = np.lexsort((-sample.logits(net, windows), sample.docs[windows]))
    return windows[order[np.flatnonzero(np.diff(sample.docs[windows][order], prepend=-1))]]


def train(texts: list[str], labels: list[int], steps: int = STEPS, weak_steps: int = WEAK_STEPS, seed: int = 7) -> Network | None:
    """A fitted network, or None if the sample lacks one of the classes."""
    usable = [(t, y) for t, y in zip(texts, labels, strict=True) if t and t.strip()]
    if len({y for _, y in usable}) < 2:
        return None
    sample = Sample([t for t, _ in usable], [y for _, y in usable])
    if not len(sample.docs):
        return None
    net, rng = Network(sample.vocabulary, seed), np.random.default_rng(seed)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    toxic = np.flatnonzero(sample.labels[sample.docs] == 1)
    clean = np.flatnonzero(sample.labels[sample.docs] == 0)
    if not len(toxic) or not len(clean):
        return None
    n_toxic, n_hard = BATCH // TOXIC_SHARE, (BATCH - BATCH // TOXIC_SHARE) // 2
    ones, hard = toxic, clean
    for step in range(1, steps + 1):
        if step > weak_steps and (step - weak_steps) % 50 == 1:
            ones = highest_windows(net, sample, toxic)
            # Some clean documents' highest windows, anew each time.
            some = rng.choice(np.unique(sample.docs[clean]), min(800, len(np.unique(sample.docs[clean]))), replace=False)
            hard = highest_windows(net, sample, clean[np.isin(sample.docs[clean], some)])
        picked = np.concatenate([rng.choice(ones, n_toxic), rng.choice(hard, n_hard), rng.choice(clean, BATCH - n_toxic - n_hard)])
        label = (sample.labels[sample.docs[picked]] == 1).astype(np.float32)
        # The last clean windows become one of their words over and over: repetition is no evidence.
        words = sample.words[:, picked]
        words[:, -N_REPEATED:] = words[rng.integers(0, np.maximum(1, sample.mask[:, picked[-N_REPEATED:]].sum(axis=0))), np.arange(-N_REPEATED, 0)]
        used, inverse, (grams, first, begins) = sample.distinct(words)
        ids = net.word_ids(sample.hashes[used])
        ids = np.where(rng.random(len(ids)) < UNKNOWN_RATE, 0, ids)
        x = net.inputs(ids, grams, first, begins)
        _, grad, d_x = net.gradients(x, inverse, sample.mask[:, picked], label, np.full(BATCH, 1 / BATCH, np.float32))
        sizes = np.diff(np.r_[first, len(grams)])
        d_char, d_begin = d_x[:, WORD_DIM:WORD_DIM + CHAR_DIM], d_x[:, WORD_DIM + CHAR_DIM:] / begins.shape[1]
        rows = {"word": summed(ids, d_x[:, :WORD_DIM]), "char": summed(grams, np.repeat(d_char / sizes[:, None], sizes, axis=0)),
                "begin": summed(begins.ravel(), np.repeat(d_begin, begins.shape[1], axis=0))}
        for k, v in net.p.items():
            at, g = rows[k] if k in rows else (slice(None), grad[k])
            m, q = moments[k]
            m[at] += 0.1 * (g - m[at])
            q[at] += 0.01 * (g**2 - q[at])
            v[at] -= (RATE * (m[at] / (1 - 0.9**step)) / (np.sqrt(q[at] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def training_sample(docs: DataFrame, labels: DataFrame, train_docs: dict[int, int] | None = None,
                    train_bytes: int = TRAIN_BYTES) -> DataFrame:
    """(doc_id, text, y): a bounded sample of labelled rows that are not held out, by hash order of their ids."""
    limits = train_docs or TRAIN_DOCS
    known = (labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("y"))
             .where(~held_out(F.col("doc_id"))))
    texts = docs.select("doc_id", "text").where(F.octet_length("text").between(1, train_bytes))
    out = None
    for y, limit in limits.items():
        # At most ``limit`` ids go to the tasks; texts are looked up where they are.
        chosen = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
        rows = texts.join(F.broadcast(chosen), "doc_id").orderBy("doc_id", "text").limit(limit).select("doc_id", "text", "y")
        out = rows if out is None else out.unionByName(rows)
    return out


def _train_task(batches):
    import pyarrow as pa

    rows = sorted((r["doc_id"], r["text"], int(r["y"])) for batch in batches for r in batch.to_pylist())
    net = train([r[1] for r in rows], [r[2] for r in rows])
    if net is not None:
        yield pa.RecordBatch.from_pydict({"network": pa.array([net.dump()], pa.binary())})


def fit(docs: DataFrame, labels: DataFrame, **sizes) -> Network | None:
    """The network of the sample, trained in one task on its at most ``TRAIN_DOCS`` rows."""
    trained = training_sample(docs, labels, **sizes).repartition(1).mapInArrow(_train_task, "network binary").collect()
    return Network.load(bytes(trained[0]["network"])) if trained else None


def score_texts(net: Network | None, column, hasher: Hasher) -> np.ndarray:
    """Score per text of an Arrow string column: its highest window; 0 without words."""
    out = np.zeros(len(column))
    if net is None:
        return out
    for block in text_blocks(column, hasher):
        texts, begins = window_starts(np.diff(block.first))
        if not len(texts):
            continue
        _, at, inverse = np.unique(block.hashes[0], return_index=True, return_inverse=True)
        x = net.inputs(net.word_ids(block.hashes[0][at]), *char_codes(block, at))
        gates = {d: (x @ net.p[f"w{d}"] + net.p[f"b{d}"]).astype(np.float32) for d in "fb"}
        begins = begins + block.first[texts]
        best = np.full(len(block.rows), -np.inf, dtype=np.float32)
        step = np.arange(WINDOW)[:, None]
        for a in range(0, len(texts), CHUNK):
            own = texts[a:a + CHUNK]
            word = begins[a:a + CHUNK] + step
            mask = word < block.first[own + 1]
            ids = inverse[np.minimum(word, len(inverse) - 1)]
            np.maximum.at(best, own, net.forward({d: gates[d][ids] for d in "fb"}, mask))
        scored = best > -np.inf
        out[block.rows[scored]] = sigmoid(best[scored].astype(np.float64))
    return out


def _score_task(shared):
    def run(batches):
        import pyarrow as pa

        net, hasher = shared.value, word_hasher()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score_texts(net, batch.column("text"), hasher))],
                                             names=["doc_id", "score"])
    return run


def score(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id and score of every row.

    Null and empty texts, and texts without letters or digits, score 0.  Rows
    are scored one by one, so repeated rows get equal scores; null ids are
    kept; an empty table gives no rows; other columns are not read.  Without a
    network (a sample without both classes) all scores are 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _score_task(shared), SCORES)


def drop_toxic(docs: DataFrame, net: Network | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that score under ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        import pyarrow as pa

        hasher = word_hasher()
        for batch in batches:
            yield batch.filter(pa.array(score_texts(shared.value, batch.column("text"), hasher) < threshold))

    return docs.mapInArrow(run, docs.schema)
