"""Language identification by a mixture of n-gram models fitted to each document.

Words are drawn from languages in unknown proportions. Each word's likelihood under each language
comes from character n-grams; expectation-maximisation estimates a document's proportions; the set of
its languages is the one of the best likelihood less a penalty for each language; the prediction is
the largest language of the set.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmatch.llm.shared import cache_of
from quillmatch.llm.wordtable import WordTable, batches_of, gram_buckets

SAMPLE = 3_000  #: Labelled documents of each language that its n-gram model is counted on, at most about.
BUCKETS = 1 << 16  #: Hash buckets of n-grams.
ORDERS = (1, 2, 3, 4)
SMOOTH = 0.5
SHARPNESS = 0.5  #: Power of a word's likelihood: n-grams of one word overlap.
ROUNDS = 8
PENALTY = 3.0  #: Log-likelihood that each further language has to bring, times log of the words.


def letters(word: str) -> str:
    return word.lower() if word.isalpha() else "".join(filter(str.isalpha, word.lower()))


def counts(docs: DataFrame) -> DataFrame:
    """``lang, gram, n`` over whole texts of ``docs(text, lang)``; words are counted before their n-grams."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for lang, own in frame.groupby("lang"):
                words: Counter = Counter()
                for text in own["text"]:
                    words.update(text.split())
                total = np.zeros(BUCKETS)
                names = list(words)
                for a in range(0, len(names), 50_000):
                    flat, sizes = gram_buckets(list(map(letters, names[a : a + 50_000])), ORDERS, BUCKETS)
                    times = np.fromiter(map(words.__getitem__, names[a : a + 50_000]), np.int64)
                    total += np.bincount(flat, np.repeat(times, sizes), BUCKETS)
                total[0] = 0  # words without letters
                some = np.flatnonzero(total)
                yield pd.DataFrame({"lang": lang, "gram": some, "n": total[some].astype(np.int64)})

    return docs.select("text", "lang").mapInPandas(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Language values and ``log p(n-gram | language)``, from a hash sample of about ``sample`` labelled rows of each language.

    A language of fewer rows is learned from all of them. What reaches the driver is one row of
    ``BUCKETS`` numbers for each language.
    """
    usable = labelled.filter("text is not null and lang is not null")
    share = usable.groupBy("lang").agg((1e6 * F.least(F.lit(1.0), sample / F.count("*"))).cast("bigint").alias("upto"))
    chosen = usable.join(F.broadcast(share), "lang")  # one row a language
    chosen = chosen.filter(F.pmod(F.xxhash64(F.lit("langid"), "doc_id", F.length("text")), F.lit(1_000_000)) < F.col("upto"))

    def model(frame: pd.DataFrame) -> pd.DataFrame:
        c = np.full(BUCKETS, SMOOTH)
        c[frame["gram"].to_numpy()] += frame["n"].to_numpy()
        return pd.DataFrame({"lang": frame["lang"].iloc[:1], "logs": [np.log(c / c.sum()).astype("<f4").tobytes()]})

    rows = sorted(counts(chosen).groupBy("lang").applyInPandas(model, "lang string, logs binary").collect())  # a group has BUCKETS rows at most
    logs = np.zeros((BUCKETS, max(len(rows), 1)), np.float32)
    for k, row in enumerate(rows):
        logs[:, k] = np.frombuffer(row["logs"], "<f4")
    return [row["lang"] for row in rows], logs


def word_likelihoods(words: list[str], logs: np.ndarray) -> np.ndarray:
    """Each word's likelihood under each language up to a factor, and in a last column if it has letters."""
    plain = list(map(letters, words))
    flat, sizes = gram_buckets(plain, ORDERS, BUCKETS)
    logp = SHARPNESS * np.add.reduceat(logs[flat], np.cumsum(sizes) - sizes, axis=0)
    p = np.exp(logp - logp.max(axis=1, keepdims=True)) + 1e-5
    has = np.fromiter(map(bool, plain), np.float32, len(plain))[:, None]
    return np.concatenate([has * p / p.sum(axis=1, keepdims=True), has], axis=1).astype(np.float32)


def mixtures(p: np.ndarray, doc: np.ndarray, n_docs: int, allowed: np.ndarray | None = None, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood of each document by expectation-maximisation, over ``allowed`` languages."""
    langs = p.shape[1]
    share = np.full((n_docs, langs), 1.0 / langs, np.float32) if allowed is None else (allowed / np.maximum(allowed.sum(axis=1, keepdims=True), 1)).astype(np.float32)
    starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, np.int64)
    owners = doc[starts] if len(doc) else starts
    sizes = np.diff(np.r_[starts, len(doc)])[:, None]
    like = np.zeros(n_docs, np.float64)
    for _ in range(rounds):
        weight = p * share[doc]
        norm = weight.sum(axis=1, keepdims=True)
        weight /= norm
        if len(doc):
            share[owners] = np.add.reduceat(weight, starts, axis=0) / sizes
    if len(doc):
        like[owners] = np.add.reduceat(np.log((p * share[doc]).sum(axis=1)).astype(np.float64), starts)
    return share, like


def identify(p: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per document: best language, its proportion, and the penalised choice of how many languages it has.

    Sets grow by the languages in the order of their proportions, as long as any document's penalised
    likelihood still rises: a likelihood that rises no more with one language does not with two, as
    proportions fall and the penalty is the same.
    """
    langs = p.shape[1]
    full, _ = mixtures(p, doc, n_docs)
    rank = np.argsort(np.argsort(-full, axis=1, kind="stable"), axis=1)
    words = np.bincount(doc, minlength=n_docs)
    best = np.full(n_docs, -np.inf)
    share, size = full.copy(), np.ones(n_docs, np.int64)
    for k in range(1, langs + 1):
        own, like = mixtures(p, doc, n_docs, (rank < k), 1 if k == 1 else ROUNDS // 2)
        like = like - PENALTY * (k - 1) * np.log(np.maximum(words, 2))
        better = like > best
        if not better.any():
            break
        best[better], share[better], size[better] = like[better], own[better], k
    return share.argmax(axis=1), share.max(axis=1), size


def predict(docs: DataFrame, langs: list[str], logs: np.ndarray, key: str) -> DataFrame:
    """``docs`` without its text, with ``lang_pred``, ``score`` and ``n_langs``."""
    kept = [c for c in docs.columns if c != "text"]
    model = docs.sparkSession.sparkContext.broadcast(logs)  # bounded: buckets x languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = cache_of("langid")
        if key not in held:
            held.clear()
            held[key] = WordTable(lambda words: word_likelihoods(words, model.value), logs.shape[1] + 1)
        table = held[key]
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            pred, score, size = [], [], []
            for a, b in batches_of(texts):
                at, ends = table.look_up(texts[a:b])
                rows = table.rows[at]
                doc = np.repeat(np.arange(b - a), np.diff(np.r_[0, ends]))
                lettered = rows[:, -1] > 0
                rows, doc = rows[lettered, :-1], doc[lettered]
                seen = np.bincount(doc, minlength=b - a) > 0
                if langs:
                    lang, share, n = identify(rows, doc, b - a)
                    pred += [langs[x] if ok else "und" for x, ok in zip(lang.tolist(), seen)]
                    score += np.where(seen, np.clip(share, 0, 1), 0.0).astype(float).tolist()
                    size += np.where(seen, n, 0).tolist()
                else:
                    pred += ["und"] * (b - a)
                    score += [0.0] * (b - a)
                    size += [0] * (b - a)
            old = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*old, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(size, pa.int64())], names=[*kept, "lang_pred", "score", "n_langs"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(run, f"{schema}, lang_pred string, score double, n_langs bigint")


def languages(docs: DataFrame, folds: int = 4, held: int = 2, sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``docs(doc_id, text, lang)``: ``doc_id, held_out, lang_pred, score, n_langs``.

    Models are counted on rows whose ``crc32(doc_id) mod folds`` is not ``held``; rows with a null id,
    text or language teach nothing. A null text or one without letters is ``und`` with score 0, as
    is every text where nothing could be learned. The id, language and source are no inputs of a
    prediction. Whole texts are read; repeated rows each get a row; an empty table an empty result.
    """
    import uuid

    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds))
    langs, logs = fit(docs.select("doc_id", "text", "lang").filter(fold != held), sample)
    rows = docs.select("doc_id", F.coalesce(fold == held, F.lit(False)).alias("held_out"), "text")
    return predict(rows, langs, logs, uuid.uuid4().hex)
