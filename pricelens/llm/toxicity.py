"""Toxicity by multiple-instance learning: sentences scored, documents by noisy-or.

A document is toxic if any sentence is, or for no visible reason (the leak, which takes the
labels that no sentence explains): ``P(doc) = 1 - (1 - leak) * prod(1 - P(sentence))``.
Sentence weights are learned from document labels through that formula, and then also say
which sentences gave a document its score.

A sentence's features are its words and their beginnings (so that inflected words share
one), in lower case. Spark counts in how many sampled documents of each class each feature
occurs; the most telling ones make the model, and only their places in the sampled sentences
come to the driver, where the weights are fitted.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..tables import checkpointed, table
from .arrays import joined, mix, running, slices, spans

#: The model is fitted on this many labelled documents of each class at most (the least hashes of their keys), and on whole documents with this many feature places in all (again by hash; the first of a class always).
SAMPLE, SAMPLE_PLACES = 4000, 4_000_000
#: Bytes of the beginnings of words that are features, besides whole words.
BEGINNINGS = (4, 5, 6, 7, 8)
#: The model has this many features at most, those with the greatest likelihood ratio between the classes, each in this many documents at least and with a ratio that grows with the smaller class of the sample, from the first to the second value.
FEATURES, LEAST_DOCS, LEAST_RATIO, FULL_RATIO, FULL_DOCS = 4096, 3, 6.0, 12.0, 400
#: Penalties tried; the one with the best likelihood of the sample's fourth that a first fit leaves out is taken.
PENALTIES, STEPS, RATE = (3e-5, 3e-4, 3e-3), 150, 0.1
_BREAK = np.ones(256, dtype=bool)
_BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_STOP = np.zeros(256, dtype=bool)
_STOP[[10, 13, 33, 46, 63]] = True  # line ends, !, ., ?


class Model(NamedTuple):
    """Sorted feature hashes, their weights, the constant of a sentence and that of the leak (as log odds)."""

    features: np.ndarray
    weights: np.ndarray
    constant: float
    leak: float


def _lowered(text: bytes) -> bytes:
    """In lower case, character by character where that would move the bytes behind."""
    if text.isascii():
        return text.lower()
    own = text.decode("utf-8", "surrogatepass")
    low = own.lower().encode("utf-8", "surrogatepass")
    if len(low) == len(text):
        return low
    pairs = ((c.encode("utf-8", "surrogatepass"), c.lower().encode("utf-8", "surrogatepass")) for c in own)
    return b"".join(small if len(small) == len(c) else c for c, small in pairs)


def _instances(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Feature hashes, each one's sentence, each sentence's text, and each sentence's span in its text (sentences without words have none)."""
    data, start, _ = joined([_lowered(t) for t in texts])
    inside = np.concatenate([[False], ~_BREAK[data], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    first, last = edge[::2], edge[1::2]
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 2), np.int64)
    text = np.searchsorted(start, first, side="right") - 1
    stops = np.cumsum(_STOP[data])
    new = np.concatenate([[True], (stops[first[1:]] != stops[first[:-1]]) | (text[1:] != text[:-1])])
    sentence, begin = np.cumsum(new) - 1, np.flatnonzero(new)
    span = np.stack([first[begin], last[np.concatenate([begin[1:], [len(first)]]) - 1]], axis=1) - start[text[begin]][:, None]
    sums = running(data)
    hashes, owner = [spans(sums, first, last)], [sentence]
    for k in BEGINNINGS:
        longer = last - first > k
        hashes.append(mix(spans(sums, first[longer], first[longer] + k), k))
        owner.append(sentence[longer])
    return np.concatenate(hashes), np.concatenate(owner), text[begin], span


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


def _risk(v: np.ndarray, rows: np.ndarray, column: np.ndarray, own: np.ndarray, docs: int, idle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores of the sentences that have features, and ``-log P(clean)`` of each document, whose other sentences are only counted."""
    z = np.bincount(rows, weights=v[column], minlength=len(own)) + v[-2]
    return z, np.bincount(own, weights=_softplus(z), minlength=docs) + idle * _softplus(v[-2]) + _softplus(v[-1])


def _descend(rows: np.ndarray, column: np.ndarray, own: np.ndarray, idle: np.ndarray, toxic: np.ndarray, weight: np.ndarray, n: int, penalty: float) -> np.ndarray:
    """Weights and both constants of the penalised noisy-or likelihood, by gradient steps (Adam)."""
    v = np.concatenate([np.zeros(n), [-6.0, -2.0]])
    m, s = np.zeros_like(v), np.zeros_like(v)
    for step in range(1, STEPS + 1):
        z, risk = _risk(v, rows, column, own, len(toxic), idle)
        slope = np.where(toxic, -1 / np.expm1(np.clip(risk, 1e-6, 50)), 1.0) * weight
        dz = slope[own] * _sigmoid(z)
        grad = np.concatenate([np.bincount(column, weights=dz[rows], minlength=n) + penalty * v[:-2], [dz.sum() + (slope * idle).sum() * _sigmoid(v[-2]), slope.sum() * _sigmoid(v[-1])]])
        m, s = 0.9 * m + 0.1 * grad, 0.99 * s + 0.01 * grad * grad
        v -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return v


def fit(sample: pd.DataFrame, features: np.ndarray) -> Model:
    """The model of sampled documents as :func:`_places` packs them.

    Both classes weigh the same, so 0.5 is where a document is as likely under the one as under the other.
    """
    toxic = sample["toxic"].to_numpy(dtype=bool)
    if toxic.all() or not toxic.any() or not len(features):
        return Model(features[:0], np.zeros(0), -20.0, -20.0)
    active = sample["active"].to_numpy(dtype=np.int64)
    before = np.cumsum(active) - active
    unpack = lambda c: [np.frombuffer(x, dtype=np.int32) for x in sample[c]]
    rows = np.concatenate([x + n for x, n in zip(unpack("rows"), before.tolist(), strict=True)])
    column, own = np.concatenate(unpack("columns")), np.repeat(np.arange(len(sample)), active)
    idle = sample["sentences"].to_numpy(dtype=np.float64) - active
    weight = np.where(toxic, 0.5 / toxic.sum(), 0.5 / (~toxic).sum())
    apart = (sample["doc"].to_numpy().astype(np.uint64) >> np.uint64(3)) % np.uint64(4) == 0
    if len(PENALTIES) > 1 and (toxic & apart).any() and (toxic & ~apart).any() and (~toxic & apart).any():
        tried = []
        for penalty in PENALTIES:
            v = _descend(rows, column, own, idle, toxic, np.where(apart, 0, weight), len(features), penalty)
            _, risk = _risk(v, rows, column, own, len(toxic), idle)
            loss = np.where(toxic, -np.log(-np.expm1(-np.clip(risk, 1e-6, 50))), risk)
            tried.append(((loss * weight)[apart].sum(), penalty))
        penalty = min(tried)[1]
    else:
        penalty = PENALTIES[-1]
    v = _descend(rows, column, own, idle, toxic, weight, len(features), penalty)
    return Model(features, v[:-2], float(v[-2]), float(v[-1]))


def _occurrences(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """In how many of a slice's documents of each class each feature occurs."""
    for frame, texts in slices(frames):
        feature, sentence, text, _ = _instances(texts)
        found = np.unique(np.stack([feature, text[sentence].astype(np.uint64)], axis=1), axis=0)
        toxic = frame["toxic"].to_numpy(dtype=np.int64)[found[:, 1].astype(np.int64)]
        value, first = np.unique(found[:, 0], return_index=True)
        counts = np.add.reduceat(np.stack([1 - toxic, toxic], axis=1), first, axis=0) if len(value) else np.zeros((0, 2), np.int64)
        yield pd.DataFrame({"feature": value.view(np.int64), "clean": counts[:, 0], "toxic": counts[:, 1]})


def _matched(features: np.ndarray, feature: np.ndarray, sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``features`` and sentences, each pair once."""
    if not len(features):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.minimum(np.searchsorted(features, feature), len(features) - 1)
    hit = features[place] == feature
    both = np.unique(sentence[hit] * len(features) + place[hit])
    return both % len(features), both // len(features)


def _places(frames: Iterator[pd.DataFrame], features: np.ndarray) -> Iterator[pd.DataFrame]:
    """Sampled documents with their number of ``sentences``, how many of them are ``active`` (have a feature of the model), and the places of features in these, packed as numbers of 32 bits: ``rows`` and ``columns``."""
    for frame, texts in slices(frames):
        feature, sentence, text, _ = _instances(texts)
        column, row = _matched(features, feature, sentence)
        edge = np.searchsorted(text[row], np.arange(len(texts) + 1))
        packed = []
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            found, own = np.unique(row[a:b], return_inverse=True)
            packed.append((len(found), own.astype(np.int32).tobytes(), column[a:b].astype(np.int32).tobytes()))
        yield pd.DataFrame(packed, columns=["active", "rows", "columns"]).assign(doc=frame["doc"].to_numpy(), toxic=frame["toxic"].to_numpy(), sentences=np.bincount(text, minlength=len(texts)), places=np.diff(edge))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> Model:
    """The model learned from the texts of ``docs`` (``key``, ``text``) whose key ``labels`` (``key``, ``toxic``) marks 0 or 1.

    Null keys and labels are left out; a key with both labels counts as toxic, equal texts of
    a key and class count once, empty and null ones not. Up to :data:`SAMPLE` documents of each
    class are read, whole ones of any length. Without labels of either class nothing is
    learned and every score stays near 0.
    """
    spark = docs.sparkSession
    marks = labels.where(F.col(key).isNotNull() & F.col("toxic").isin(0, 1)).groupBy(key).agg(F.max("toxic").alias("toxic"))
    there = docs.where(F.length("text") > 0).select(key).join(marks, key).distinct()
    order = [F.xxhash64(F.col(key).cast("string")), F.col(key)]
    picked = there.where("toxic = 1").orderBy(*order).limit(SAMPLE).union(there.where("toxic = 0").orderBy(*order).limit(SAMPLE))
    texts = docs.where(F.length("text") > 0).select(key, "text").join(F.broadcast(picked), key)  # 2 * SAMPLE keys
    named = texts.select(F.xxhash64(F.col(key).cast("string"), "text").alias("doc"), "toxic", "text").dropDuplicates(["doc"])
    sample = named.where("toxic = 1").orderBy("doc").limit(SAMPLE).union(named.where("toxic = 0").orderBy("doc").limit(SAMPLE))  # a key may have many rows
    sample = checkpointed(sample.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc"))  # chosen once, read three times
    sizes = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return fit(pd.DataFrame({"toxic": []}), np.zeros(0, np.uint64))
    counts = sample.mapInPandas(_occurrences, "feature long, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    p, q = F.col("toxic") / sizes[1], F.col("clean") / sizes[0]
    both = (F.col("toxic") + F.col("clean")) / (sizes[0] + sizes[1])
    part = lambda k, r, base: F.when(k > 0, k * F.log(r / base)).otherwise(0.0)
    rest = lambda n, r: (n * (1 - r)) * F.when(r < 1, F.log((1 - r) / F.greatest(1 - both, F.lit(1e-9)))).otherwise(0.0)
    ratio = 2 * (part(F.col("toxic"), p, both) + part(F.col("clean"), q, both) + rest(F.lit(sizes[1]), p) + rest(F.lit(sizes[0]), q))
    least = LEAST_RATIO + (FULL_RATIO - LEAST_RATIO) * min(1.0, min(sizes.values()) / FULL_DOCS)
    telling = counts.where(F.col("toxic") + F.col("clean") >= LEAST_DOCS).select("feature", ratio.alias("ratio")).where(F.col("ratio") >= least)
    features = np.sort(telling.orderBy(F.desc("ratio"), "feature").limit(FEATURES).select("feature").toPandas()["feature"].to_numpy(dtype=np.int64).view(np.uint64))
    packed = sample.mapInPandas(partial(_places, features=features), "doc long, toxic int, sentences long, active int, rows binary, columns binary, places long")
    turn = Window.partitionBy("toxic").orderBy("doc")  # SAMPLE rows a class
    packed = packed.withColumns({"_sum": F.sum("places").over(turn), "_n": F.row_number().over(turn)}).where((F.col("_sum") <= SAMPLE_PLACES) | (F.col("_n") == 1))
    return fit(packed.toPandas().sort_values("doc").reset_index(drop=True), features)  # 8 bytes a place


def _score(frames: Iterator[pd.DataFrame], model, keep_text: bool) -> Iterator[pd.DataFrame]:
    features, weights, constant, leak = model.value
    for frame, texts in slices(frames):
        feature, sentence, text, span = _instances(texts)
        column, row = _matched(features, feature, sentence)
        z = np.bincount(row, weights=weights[column], minlength=len(text)) + constant
        n = np.bincount(text, minlength=len(texts))
        risk = np.bincount(text, weights=_softplus(z), minlength=len(texts)) + np.where(n > 0, _softplus(leak), 0.0)
        offending = np.bincount(text[z >= 0], minlength=len(texts))
        worst = np.lexsort((-np.arange(len(z)), z, text))
        last = np.cumsum(n) - 1
        where = [texts[i][slice(*span[worst[last[i]]])].decode("utf-8", "replace") if n[i] else None for i in range(len(texts))]
        yield (frame if keep_text else frame.drop(columns=["text"])).assign(score=-np.expm1(-risk), n_sentences=n, n_offending=offending, worst_sentence=where)


def score(docs: DataFrame, model: Model, keep_text: bool = False) -> DataFrame:
    """``docs`` (without ``text`` unless it is to be kept) with ``score``, ``n_sentences``, ``n_offending`` (each alone at 0.5 or more) and ``worst_sentence`` (the first of the likeliest).

    Null texts and texts without words score 0 and have no sentence. Other columns pass
    through, but for those with a result's name, which are replaced; repeated rows stay.
    """
    docs = docs.drop("score", "n_sentences", "n_offending", "worst_sentence")
    schema = T.StructType([f for f in docs.schema.fields if keep_text or f.name != "text"]).add("score", "double").add("n_sentences", "long").add("n_offending", "long").add("worst_sentence", "string")
    return docs.mapInPandas(partial(_score, model=docs.sparkSession.sparkContext.broadcast(model), keep_text=keep_text), schema)


def op9_toxicity(spark, sf_dir):
    """The toxicity of every document, learned from the labels of four in five; a null ``doc_id`` is learned from by no model and not held out. Other columns are not read."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = train(docs, labels.where(~held_out))
    scored = score(docs.withColumn("held_out", F.coalesce(held_out, F.lit(False))), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_sentences", "n_offending", "worst_sentence")
