"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

Input of a word: an embedding of the word itself (if training saw it in several documents) and one of
its character n-grams. The network reads windows of words in both directions, pools the states by
attention and gives each window a logit. A text's logit is that of the power sum of the odds of all its
overlapping windows, so one toxic window is enough. Training follows the same rule: a document's
gradient goes to its windows by their share of the sum. With a high power the highest window counts, so
that length alone says little.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmatch.llm.shared import cache_of, slices
from quillmatch.llm.wordtable import WordTable, batches_of, gram_buckets, row_sums

PER_LABEL = 1_200  #: Labelled documents of each label that are trained on, at most.
WINDOW, STRIDE = 32, 16  #: Words of a window, and from one to the next; training and scoring take all windows of a text.
CHUNK = 4096  #: Windows that are computed at once.
HIDDEN = 8
WORD_DIM = CHAR_DIM = 8
CHAR_BUCKETS = 1 << 13
LEAST_DOCS = 3  #: Training documents that a word has to be in to get an embedding of its own.
WORDS = 20_000  #: Words with an embedding of their own, at most.
EPOCHS, DOCS_A_STEP, RATE = 3, 32, 0.01
POWER = 4.0  #: A text's odds are the sum of its windows' odds to this power, to one over it: n equal windows raise its logit by log(n) / POWER.
LEAST_STEPS = 150  #: Few documents are gone over more often, until so many steps are taken.


def normal(word: str) -> str:
    return word.lower() if word.isalnum() else "".join(filter(str.isalnum, word.lower()))


@dataclass
class Model:
    """Parameters; ``w`` are the network's, forward and backward direction stacked on the first axis."""

    words: dict[str, int]
    p: dict[str, np.ndarray]

    @classmethod
    def new(cls, words: dict[str, int], seed: int = 7) -> "Model":
        r = np.random.default_rng(seed)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        f = lambda *s, k=0.1: (r.standard_normal(s) * k).astype(np.float32)
        p = {"E": f(len(words) + 1, WORD_DIM), "C": f(CHAR_BUCKETS, CHAR_DIM, k=0.2), "W": f(2, d, 3 * h, k=d**-0.5), "U": f(2, h, 3 * h, k=h**-0.5), "B": f(2, 3 * h, k=0.0), "a": f(2, h, k=0.3), "o": f(2, h, k=0.5), "c": np.array([-3.0], np.float32)}
        p["E"][0] = 0
        return cls(words, p)

    def known(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What the network sees of words: their embedding's row (0: none), their n-grams one after the other, how many each has."""
        plain = list(map(normal, words))
        own = np.array([self.words.get(w, 0) for w in plain], np.int64)
        return own, *gram_buckets(plain, (3, 4, 5), CHAR_BUCKETS)

    def inputs(self, own: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        starts = np.cumsum(sizes) - sizes
        chars = np.add.reduceat(self.p["C"][flat], starts, axis=0) / np.sqrt(sizes)[:, None].astype(np.float32)
        return np.concatenate([self.p["E"][own], chars], axis=1).astype(np.float32)

    def projected(self, words: list[str]) -> np.ndarray:
        """Gate inputs of words in both directions, side by side."""
        x = self.inputs(*self.known(words))
        return np.concatenate([x @ self.p["W"][k] + self.p["B"][k] for k in (0, 1)], axis=1)

    def logits(self, gates: np.ndarray, at: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Logits of windows: ``at`` (windows x words) are rows of ``gates``; ``mask`` says which words are there."""
        n, steps = at.shape
        h = HIDDEN
        top = np.zeros((n,), np.float32)
        den = np.zeros((n,), np.float32)
        pooled = []
        for k in (0, 1):
            state = np.zeros((n, h), np.float32)
            num = np.zeros((n, h), np.float32)
            u_zr, u_c = np.ascontiguousarray(self.p["U"][k][:, : 2 * h]), np.ascontiguousarray(self.p["U"][k][:, 2 * h :])
            for t in range(steps) if k == 0 else range(steps - 1, -1, -1):
                x = gates[at[:, t], 3 * h * k : 3 * h * (k + 1)]
                zr = x[:, : 2 * h] + state @ u_zr
                zr *= 0.5
                np.tanh(zr, out=zr)
                zr += 1
                zr *= 0.5
                new = np.tanh(x[:, 2 * h :] + (zr[:, h:] * state) @ u_c)
                new -= state
                new *= zr[:, :h]
                new *= mask[:, t, None]
                state = state + new
                e = np.exp(np.clip(state @ self.p["a"][k], -20, 20)) * mask[:, t]
                num += e[:, None] * state
                den += e
            pooled.append(num)
        for k in (0, 1):
            top += (pooled[k] / np.maximum(den, 1e-9)[:, None]) @ self.p["o"][k]
        return top + self.p["c"][0]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def loss_of(logit: np.ndarray, owner: np.ndarray, label: np.ndarray, power: float = POWER) -> tuple[float, np.ndarray]:
    """Loss of documents from their windows' logits, and its gradient: log of the power sum of odds, its sigmoid against the label."""
    docs = len(label)
    top = np.full(docs, -np.inf, np.float32)
    np.maximum.at(top, owner, logit)
    odds = np.exp(power * (logit - top[owner]))
    total = np.bincount(owner, odds, docs)
    s = top + np.log(total) / power
    loss = float((np.logaddexp(0, s) - label * s).mean())
    return loss, (((_sigmoid(s) - label) / docs)[owner] * odds / total[owner]).astype(np.float32)


def gradient(model: Model, seen: tuple[np.ndarray, np.ndarray, np.ndarray], at: np.ndarray, mask: np.ndarray, owner: np.ndarray, label: np.ndarray, chunk: int = CHUNK, power: float = POWER) -> tuple[float, dict]:
    """Loss and gradient of documents given as windows (``at`` into the words ``seen``, ``owner``: document of a window).

    Of more than ``chunk`` windows all logits come first; the gradient is then added up chunk by chunk.
    """
    x = model.inputs(*seen)
    if len(at) <= chunk:
        return backward(model, seen, x, at, mask, lambda logit: loss_of(logit, owner, label, power))
    gates = np.concatenate([x @ model.p["W"][k] + model.p["B"][k] for k in (0, 1)], axis=1)
    cuts = range(0, len(at), chunk)
    loss, share = loss_of(np.concatenate([model.logits(gates, at[c : c + chunk], mask[c : c + chunk]) for c in cuts]), owner, label, power)
    whole: dict = {}
    for c in cuts:
        _, grad = backward(model, seen, x, at[c : c + chunk], mask[c : c + chunk], lambda _, c=c: (loss, share[c : c + chunk]))
        for k, g in grad.items():
            old = whole.get(k)
            whole[k] = g if old is None else (g[0], old[1] + g[1]) if isinstance(g, tuple) else old + g
    return loss, whole


def backward(model: Model, seen: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray, at: np.ndarray, mask: np.ndarray, loss_at) -> tuple[float, dict]:
    """Gradient for windows of the inputs ``x``; ``loss_at(logits)`` gives the loss and its gradient by logit."""
    p, h = model.p, HIDDEN
    own, flat, sizes = seen
    n, steps = at.shape
    kept, scores = [], []
    for k in (0, 1):
        gates = x @ p["W"][k] + p["B"][k]
        state = np.zeros((n, h), np.float32)
        trace = []
        order = list(range(steps)) if k == 0 else list(range(steps - 1, -1, -1))
        for t in order:
            g = gates[at[:, t]]
            zr = _sigmoid(g[:, : 2 * h] + state @ p["U"][k][:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            c = np.tanh(g[:, 2 * h :] + (r * state) @ p["U"][k][:, 2 * h :])
            m = mask[:, t, None]
            new = state + m * z * (c - state)
            trace.append((t, state, z, r, c, m, new))
            state = new
        kept.append(trace)
        scores.append(np.stack([np.exp(np.clip(new @ p["a"][k], -20, 20)) * m[:, 0] for (_, _, _, _, _, m, new) in trace]))
    den = np.maximum(scores[0].sum(0) + scores[1].sum(0), 1e-9)
    pooled = [sum((scores[k][i] / den)[:, None] * kept[k][i][6] for i in range(steps)) for k in (0, 1)]
    logit = pooled[0] @ p["o"][0] + pooled[1] @ p["o"][1] + p["c"][0]
    loss, d_logit = loss_at(logit)
    grad = {k: np.zeros_like(v) for k, v in p.items() if k not in ("E", "C")}
    by_word = np.argsort(at.T.ravel(), kind="stable")
    grad["c"][0] = d_logit.sum()
    dx = np.zeros_like(x)
    both = sum(pooled[k] @ p["o"][k] for k in (0, 1))
    for k in (0, 1):
        grad["o"][k] = pooled[k].T @ d_logit
        d_state = np.zeros((n, h), np.float32)
        d_steps = np.zeros((steps, n, 3 * h), np.float32)
        u = p["U"][k]
        for i in range(steps - 1, -1, -1):
            t, state, z, r, c, m, new = kept[k][i]
            alpha = scores[k][i] / den
            d_e = alpha * (new @ p["o"][k] - both) * d_logit  # through the attention weight
            d_new = d_state + (alpha * d_logit)[:, None] * p["o"][k] + d_e[:, None] * p["a"][k]
            grad["a"][k] += new.T @ d_e
            d_new_m = d_new * m
            d_z = d_new_m * (c - state) * z * (1 - z)
            d_c = d_new_m * z * (1 - c * c)
            d_state = d_new - d_new_m * z
            d_rs = d_c @ u[:, 2 * h :].T
            d_r = d_rs * state * r * (1 - r)
            d_zr = np.concatenate([d_z, d_r], axis=1)
            d_state = d_state + d_rs * r + d_zr @ u[:, : 2 * h].T
            grad["U"][k][:, : 2 * h] += state.T @ d_zr
            grad["U"][k][:, 2 * h :] += (r * state).T @ d_c
            d_steps[t, :, : 2 * h], d_steps[t, :, 2 * h :] = d_zr, d_c
        d_gates = row_sums(at.T.ravel(), d_steps.reshape(-1, 3 * h), len(own), by_word)
        grad["W"][k] = x.T @ d_gates
        grad["B"][k] = d_gates.sum(0)
        dx += d_gates @ p["W"][k].T
    grad["E"] = (own, dx[:, :WORD_DIM])
    grad["C"] = (flat, np.repeat(dx[:, WORD_DIM:] / np.sqrt(sizes)[:, None], sizes, axis=0))
    return loss, grad


class Adam:
    def __init__(self, p: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.t = p, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}

    def step(self, grad: dict) -> None:
        self.t += 1
        scale = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, g in grad.items():
            if isinstance(g, tuple):  # rows of a table
                rows, inverse = np.unique(g[0], return_inverse=True)
                value = row_sums(inverse, g[1], len(rows))
                if k == "E":
                    value[rows == 0] = 0
                m = self.m[k][rows] = 0.9 * self.m[k][rows] + 0.1 * value
                v = self.v[k][rows] = 0.999 * self.v[k][rows] + 0.001 * value * value
                self.p[k][rows] -= scale * m / (np.sqrt(v) + 1e-6)
            else:
                self.m[k] = 0.9 * self.m[k] + 0.1 * g
                self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
                self.p[k] -= scale * self.m[k] / (np.sqrt(self.v[k]) + 1e-6)


def windows(n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, length and document of all overlapping windows of texts with ``n_words`` words each."""
    per = np.where(n_words > WINDOW, (np.maximum(n_words - WINDOW, 0) + STRIDE - 1) // STRIDE + 1, (n_words > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(n_words)), per)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    first = np.repeat(np.cumsum(n_words) - n_words, per) + nth * STRIDE
    size = np.minimum(WINDOW, np.repeat(n_words, per) - nth * STRIDE)
    return first, size, doc


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = 7) -> Model:
    """A model from labelled texts; with fewer than two kinds of label it gives the label's share to all."""
    seen: Counter = Counter()
    split = [t.split() for t in texts]
    for own in split:
        seen.update({normal(w) for w in own})
    seen.pop("", None)
    common = [w for w, n in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:WORDS] if n >= LEAST_DOCS]
    model = Model.new({w: i + 1 for i, w in enumerate(common)}, seed)
    if len(set(labels)) < 2:
        model.p["o"][:] = 0
        model.p["c"][0] = 4.0 if labels and labels[0] else -4.0
        return model
    rng, adam = np.random.default_rng(seed), Adam(model.p, RATE)
    y = np.array(labels, np.float32)
    steps = np.arange(WINDOW)
    vocabulary: dict[str, int] = {}
    rows_of = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in own], np.int64) for own in split]
    own, flat, sizes = model.known(list(vocabulary))
    starts = np.cumsum(sizes) - sizes
    epochs = max(epochs, -(-LEAST_STEPS * DOCS_A_STEP // len(texts)))
    for epoch in range(epochs):
        early = epoch < epochs * 0.6
        adam.rate, power = RATE * (1 if early else 0.3), 1.0 if early else POWER  # at first all windows of a text learn
        order = rng.permutation(len(texts))
        for a in range(0, len(order), DOCS_A_STEP):
            chosen = [i for i in order[a : a + DOCS_A_STEP] if split[i]]
            if not chosen:
                continue
            at = np.concatenate([rows_of[i] for i in chosen])
            first, size, doc = windows(np.array([len(rows_of[i]) for i in chosen]))
            mask = (steps[None, :] < size[:, None]).astype(np.float32)
            used, rows = np.unique(at[np.minimum(first[:, None] + steps, len(at) - 1)], return_inverse=True)
            n = sizes[used]
            grams = flat[np.repeat(starts[used] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            _, grad = gradient(model, (own[used], grams, n), rows.reshape(mask.shape), mask, doc, y[chosen], power=power)
            adam.step(grad)
    return model


def score_texts(model: Model, table: WordTable, texts: list[str | None]) -> np.ndarray:
    """Probability of label 1 for each whole text, from all its windows."""
    steps = np.arange(WINDOW)
    out = np.zeros(len(texts))
    for a, b in batches_of(texts, 2_000_000):
        at, ends = table.look_up(texts[a:b])
        first, size, doc = windows(np.diff(np.r_[0, ends]))
        logit = np.zeros(len(doc), np.float64)
        for i in range(0, len(doc), CHUNK):
            f, s = first[i : i + CHUNK], size[i : i + CHUNK]
            mask = (steps[None, :] < s[:, None]).astype(np.float32)
            logit[i : i + CHUNK] = model.logits(table.rows, at[np.minimum(f[:, None] + steps, max(len(at) - 1, 0))], mask)
        top = np.full(b - a, -np.inf)
        np.maximum.at(top, doc, logit)
        total = np.bincount(doc, np.exp(POWER * (logit - np.where(np.isfinite(top), top, 0)[doc])), b - a)
        with np.errstate(divide="ignore"):
            s = np.where(np.isfinite(top), top + np.log(np.maximum(total, 1e-300)) / POWER, float(model.p["c"][0]))
        out[a:b] = 1 / (1 + np.exp(-np.clip(s, -500, 500)))
    return out


def training_rows(docs: DataFrame, labels: DataFrame, folds: int, held: int, per_label: int) -> tuple[list[str], list[int]]:
    """Texts and labels of at most ``per_label`` documents of each label, the first by a hash of the id."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds))
    y = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    y = y.filter(fold != held).withColumn("h", F.xxhash64(F.lit("toxic"), "doc_id"))
    nth = F.row_number().over(Window.partitionBy("y").orderBy("h", "doc_id"))
    # A hash cut first, so that the order by label is over about the rows that are wanted.
    sizes = {r["y"]: r["count"] for r in y.groupBy("y").count().collect() if r["y"] in (0, 1)}
    cut = F.lit(False)
    for label, n in sizes.items():
        share = min(1.0, 1.2 * per_label / n)
        cut = cut | ((F.col("y") == label) & (F.pmod("h", F.lit(1_000_000)) < int(1_000_000 * share)))
    chosen = y.filter(cut).withColumn("nth", nth).filter(F.col("nth") <= per_label)
    rows = docs.filter("text is not null").select("doc_id", "text").join(F.broadcast(chosen.select("doc_id", "y")), "doc_id")
    rows = rows.groupBy("doc_id", "y").agg(F.min("text").alias("text"))  # of rows that repeat an id one
    got = sorted((r["doc_id"], r["y"], r["text"]) for r in rows.collect())  # bounded by per_label a label
    return [t for _, _, t in got], [v for _, v, _ in got]


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, per_label: int = PER_LABEL) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``doc_id, held_out, score, predicted``.

    Learns from ``labels(doc_id, toxic)`` whose ``crc32(doc_id) mod folds`` is not ``held``, at most
    ``per_label`` documents of each label; null labels, ids and texts teach nothing, of repeated
    labels the larger counts, and of rows that repeat an id the smallest text. Null and empty texts get the score of no evidence; without both labels
    all texts get the one label's. Scores come from the text alone; repeated rows each get a row; an
    empty table gives an empty result.
    """
    texts, y = training_rows(docs, labels, folds, held, per_label)
    model = train(texts, y)
    key = uuid.uuid4().hex
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: WORDS and CHAR_BUCKETS rows
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds))
    rows = docs.select("doc_id", F.coalesce(fold == held, F.lit(False)).alias("held_out"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        held = cache_of("toxicity")
        if key not in held:
            held.clear()
            held[key] = WordTable(own.projected, 6 * HIDDEN)
        for batch in slices(batches, 2):
            p = np.round(score_texts(own, held[key], batch.column("text").to_pylist()), 6)  # beyond that it depends on what else is in the batch
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"]
            )

    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
