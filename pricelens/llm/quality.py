"""Quality by pairwise ranking: a Bradley-Terry model of documents, cut at a quantile.

Of two documents the better one is preferred with probability ``sigmoid(s(a) - s(b))``. A
document's strength ``s`` is a sum over its features, each read off at the feature's place
among quantiles, so that both ends of a feature may be bad. Pairs of a document labelled 1 and
one labelled 0 are the preferences, and the logistic loss of their feature differences gives
the weights. Strengths have no zero of their own: documents that a fit has left out are
scored, and the quantile of these scores at the share of label 0 becomes the score 0.7.

The model is fitted on every labelled document. These are dealt into blocks by hash, and both
ends of a pair are in one block; steps and quantile are exact order statistics from counts,
and each gradient step is a Spark job that sums the gradients of all blocks' pairs.

Features are shares and means of the whole text: kinds of bytes, words, sentences, and what
repeats in it. Nothing but the text is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..tables import checkpointed, parts as shuffled, table
from .arrays import _SPACE, joined, mix, running, slices, spans

#: Documents of the larger class in a block, about; pairs are made within blocks.
BLOCK = 4096
#: A block gets this many documents of the smaller class at least, or all there are: where they are too few, copies of them go to several blocks.
LEAST = 256
#: Each document of the larger class stands in this many preference pairs.
PAIRS = 16
#: No part is left out.
WHOLE = -1
BLOCKS = "block long, values binary, good binary, part binary, copy binary"
#: Where a feature's steps lie among the labelled documents; close at both ends, where the odd ones are.
LEVELS = (0.002, 0.005, 0.01, 0.02, 0.04, 0.08, 0.15, 0.3, 0.5, 0.7, 0.85, 0.92, 0.96, 0.98, 0.99, 0.995, 0.998)
#: Penalties tried (the best likelihood of the left-out pairs is taken), parts of the documents left out in turn, and steps of a fit.
PENALTIES, FOLDS, STEPS, RATE = (1e-4, 1e-3, 1e-2), 4, 150, 0.1
#: Score at and above which a document counts as good.
GOOD = 0.7
_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_LOWER, _UPPER, _DIGIT, _HIGH, _BLANK, _CONTROL = range(6)
_KIND = np.full(256, _CONTROL, dtype=np.int64)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:], _KIND[_SPACE] = _LOWER, _UPPER, _DIGIT, _HIGH, _BLANK
_KIND[np.frombuffer(_PUNCTUATION, np.uint8)] = np.arange(6, 6 + len(_PUNCTUATION))
_KINDS = 6 + len(_PUNCTUATION)
_STOP = np.isin(np.arange(256), np.frombuffer(b".!?", np.uint8))
_LINE = np.isin(np.arange(256), np.frombuffer(b"\n", np.uint8))
NAMES = ["bytes", "words", "upper", "digits", "high", "control", *(chr(c) for c in _PUNCTUATION), "word_bytes", "short_words", "long_words", "capitals", "marked_ends", "same_as_last", "sentence_words", "line_words", "repeated_threes", "repeated_lines"]


class Model(NamedTuple):
    """Steps of each feature (features by levels), the weight of each place between them, and the strength whose score is :data:`GOOD`."""

    steps: np.ndarray
    weights: np.ndarray
    threshold: float


def _again(value: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """How many of each text's values it has had before."""
    key = mix(value ^ mix(text, 3))
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key), dtype=bool)
    same[order[1:]] = key[order[1:]] == key[order[:-1]]
    return np.bincount(text[same], minlength=n)


def features(texts: list[bytes]) -> np.ndarray:
    """A row of :data:`NAMES` for each text; all zero for an empty one."""
    n = len(texts)
    data, start, end = joined(texts)
    size = end - start
    kinds = np.bincount(np.repeat(np.arange(n), size + 1) * _KINDS + _KIND[data], minlength=n * _KINDS).reshape(n, _KINDS).astype(np.float64)
    kinds[:, _BLANK] -= 1  # the gap
    inside = np.concatenate([[False], ~_SPACE[data], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    first, last = edge[::2], edge[1::2]
    text = np.searchsorted(start, first, side="right") - 1
    words = np.bincount(text, minlength=n)
    sums = running(data)
    word = spans(sums, first, last)
    count = lambda which: np.bincount(text[which], minlength=n)
    share = lambda a, b: a / np.maximum(b, 1)
    behind = np.zeros(len(word), dtype=bool)
    behind[1:] = (word[1:] == word[:-1]) & (text[1:] == text[:-1])
    threes = np.flatnonzero(text[2:] == text[:-2])
    three = mix(mix(word[threes], 1) ^ mix(word[threes + 1], 2) ^ word[threes + 2])
    ends = np.flatnonzero(_LINE[data])
    begins = np.concatenate([[0], ends[:-1] + 1])
    full = ends > begins
    line, line_text = spans(sums, begins[full], ends[full]), np.searchsorted(start, begins[full], side="right") - 1
    letters = kinds[:, [_LOWER, _UPPER, _HIGH]].sum(axis=1)
    columns = [
        np.log1p(size), np.log1p(words), share(kinds[:, _UPPER], letters), share(kinds[:, _DIGIT], size), share(kinds[:, _HIGH], size), share(kinds[:, _CONTROL], size),
        *(share(kinds[:, k], size) for k in range(6, _KINDS)),
        share(np.bincount(text, weights=last - first, minlength=n), words), share(count(last - first <= 3), words), share(count(last - first >= 12), words),
        share(count(_KIND[data[first]] == _UPPER), words), share(count(_KIND[data[last - 1]] >= 6), words), share(count(behind), words),
        share(words, count(_STOP[data[last - 1]])), share(words, np.bincount(line_text, minlength=n)), share(_again(three, text[threes], n), words), share(_again(line, line_text, n), np.bincount(line_text, minlength=n)),
    ]
    return np.stack(columns, axis=1).astype(np.float64)


def _places(steps: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Column of the one place that each feature of each row has among its steps."""
    wide = steps.shape[1] + 1
    return np.stack([np.searchsorted(own, values[:, k], side="left") + k * wide for k, own in enumerate(steps)], axis=1)


def _pairs(good: np.ndarray, bad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows preferred and rows they are preferred to: each document of the larger class with :data:`PAIRS` of the other, dealt evenly."""
    large, small = (good, bad) if len(good) >= len(bad) else (bad, good)
    stride = max(1, len(small) // PAIRS)
    other = np.concatenate([small[(np.arange(len(large)) + k * stride) % len(small)] for k in range(min(PAIRS, len(small)))])
    own = np.tile(large, min(PAIRS, len(small)))
    return (own, other) if large is good else (other, own)


def _quantile(values: np.ndarray, weights: np.ndarray, level: float) -> float:
    """Half way between the values on both sides of ``level``."""
    order = np.argsort(values, kind="stable")
    share = np.cumsum(weights[order]) / weights.sum()
    k = min(int(np.searchsorted(share, level - 1e-9)), len(values) - 2)
    return float((values[order[k]] + values[order[k + 1]]) / 2)


def _keys(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of ``values``."""
    bits = (values + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def _values(keys: np.ndarray) -> np.ndarray:
    """The values of :func:`_keys`."""
    return np.where(keys >> np.uint64(63), keys ^ np.uint64(1 << 63), ~keys).view(np.float64)


def _digits(frames: Iterator[pd.DataFrame], of, begun: list[np.ndarray], shift: int) -> Iterator[pd.DataFrame]:
    """How many values of each column go on with each digit after each of its beginnings; ``of`` gives a block's values, column by column."""
    for frame in frames:
        for _, block in frame.iterrows():
            for k, (own, known) in enumerate(zip(of(block), begun, strict=True)):
                key = _keys(own) >> np.uint64(shift)
                at = np.minimum(np.searchsorted(known, key >> np.uint64(8)), len(known) - 1)
                hit = known[at] == key >> np.uint64(8)
                slot, n = np.unique(at[hit] << 8 | (key[hit] & np.uint64(255)).astype(np.int64), return_counts=True)
                yield pd.DataFrame({"k": k, "slot": slot, "n": n})


def _ranked(blocks: DataFrame, of, ranks: np.ndarray) -> np.ndarray:
    """For each column of a block's values (``of``), over all blocks, the values at its ``ranks`` (columns by ranks, from 0): exact, digit by digit, from counts that Spark sums."""
    begun, rest = np.zeros(ranks.shape, dtype=np.uint64), ranks.astype(np.int64).copy()
    for shift in range(56, -8, -8):
        known = [np.unique(own) for own in begun]
        found = blocks.mapInPandas(partial(_digits, of=of, begun=known, shift=shift), "k int, slot long, n long").groupBy("k", "slot").agg(F.sum("n").alias("n")).toPandas()
        for k, own in enumerate(known):
            n = np.zeros((len(own), 256), dtype=np.int64)
            mine = found[found["k"] == k]
            n.flat[mine["slot"].to_numpy()] = mine["n"].to_numpy()
            upto = n.cumsum(axis=1)
            for i, at in enumerate(np.searchsorted(own, begun[k])):
                digit = int(np.searchsorted(upto[at], rest[k, i], side="right"))
                rest[k, i] -= upto[at, digit] - n[at, digit]
                begun[k, i] = begun[k, i] << np.uint64(8) | np.uint64(digit)
    return _values(begun)


def _measured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame, texts in slices(frames):
        yield frame.drop(columns=["text"]).assign(values=[x.tobytes() for x in features(texts)])


def _block(frame: pd.DataFrame) -> pd.DataFrame:
    """A block's documents in one row: their features behind one another, which are good, the part of each, and which are no copies."""
    frame = frame.sort_values("doc")
    pack = lambda c: frame[c].to_numpy(dtype=np.int8).tobytes()
    return pd.DataFrame({"block": [frame["block"].iloc[0]], "values": [b"".join(frame["values"])], "good": [pack("quality")], "part": [pack("part")], "copy": [pack("copy")]})


def _flags(block: pd.Series, name: str) -> np.ndarray:
    return np.frombuffer(block[name], dtype=np.int8)


def _features_once(block: pd.Series) -> list[np.ndarray]:
    own = np.frombuffer(block["values"]).reshape(-1, len(NAMES))[_flags(block, "copy") == 0]
    return list(np.ascontiguousarray(own.T))


def _placed(frames: Iterator[pd.DataFrame], steps: np.ndarray) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield frame.assign(values=[_places(steps, np.frombuffer(x).reshape(-1, len(NAMES))).astype(np.int16).tobytes() for x in frame["values"]])


def _strengths(places: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Strengths of documents (rows) under several models (columns)."""
    total = np.zeros((len(places), v.shape[1]))
    for own in places.T:
        total += v[own]
    return total


def _preferred(block: pd.Series, part: int, left_out: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a block without the documents of ``part`` (of these alone if ``left_out``)."""
    good, own = _flags(block, "good") == 1, _flags(block, "part")
    which = own == part if left_out else own != part
    first, second = np.flatnonzero(good & which), np.flatnonzero(~good & which)
    return _pairs(first, second) if len(first) and len(second) else (first[:0], second[:0])


def _slopes(frames: Iterator[pd.DataFrame], v: np.ndarray, parts: list[int]) -> Iterator[pd.DataFrame]:
    """Gradients of the loss of a task's pairs, summed (places by models, those of each left-out part one after the other), and numbers of pairs."""
    total, pairs, each = np.zeros_like(v), np.zeros(len(parts), dtype=np.int64), v.shape[1] // len(parts)
    for frame in frames:
        for _, block in frame.iterrows():
            places = np.frombuffer(block["values"], dtype=np.int16).reshape(-1, len(NAMES)).astype(np.int64)
            strength, slope = _strengths(places, v), np.zeros((len(places), v.shape[1]))
            for k, part in enumerate(parts):
                better, worse = _preferred(block, part)
                pairs[k] += len(better)
                for c in range(k * each, (k + 1) * each):
                    own = strength[:, c]
                    doubt = 0.5 * (1 - np.tanh((own[better] - own[worse]) / 2))
                    slope[:, c] = np.bincount(worse, weights=doubt, minlength=len(own)) - np.bincount(better, weights=doubt, minlength=len(own))
            flat = places.ravel()
            for c in range(v.shape[1]):
                total[:, c] += np.bincount(flat, weights=np.repeat(slope[:, c], len(NAMES)), minlength=len(v))
    yield pd.DataFrame({"slope": [total.tobytes()], "pairs": [pairs.tobytes()]})


def _descend(blocks: DataFrame, parts: list[int], penalties: tuple[float, ...], width: int) -> np.ndarray:
    """Weights (places by models) of the penalised logistic loss of differences, by gradient steps (Adam) over the pairs of all blocks: for each of ``parts`` left out the models of all penalties."""
    v = np.zeros((width, len(parts) * len(penalties)))
    m, s = np.zeros_like(v), np.zeros_like(v)
    for step in range(1, STEPS + 1):
        sums = blocks.mapInPandas(partial(_slopes, v=v, parts=parts), "slope binary, pairs binary").collect()
        pairs = np.sum([np.frombuffer(r["pairs"], dtype=np.int64) for r in sums], axis=0)
        slope = np.sum([np.frombuffer(r["slope"]) for r in sums], axis=0).reshape(v.shape)
        grad = slope / np.repeat(np.maximum(pairs, 1), len(penalties)) + np.tile(penalties, len(parts)) * v
        m, s = 0.9 * m + 0.1 * grad, 0.99 * s + 0.01 * grad * grad
        v -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return v


def _losses(frames: Iterator[pd.DataFrame], v: np.ndarray, parts: list[int]) -> Iterator[pd.DataFrame]:
    """Of each part's pairs in each block the loss under the models that left it out, by penalty."""
    each = v.shape[1] // len(parts)
    for frame in frames:
        for _, block in frame.iterrows():
            strength = _strengths(np.frombuffer(block["values"], dtype=np.int16).reshape(-1, len(NAMES)), v)
            for k, part in enumerate(parts):
                better, worse = _preferred(block, part, left_out=True)
                own = strength[:, k * each : (k + 1) * each]
                yield pd.DataFrame({"penalty": range(each), "loss": np.logaddexp(0, own[worse] - own[better]).sum(axis=0)})


def _left_out(block: pd.Series, v: np.ndarray, parts: list[int]) -> list[np.ndarray]:
    """Strengths of a block's documents, without copies, under the one model that left each out; others are not there."""
    strength, once = _strengths(np.frombuffer(block["values"], dtype=np.int16).reshape(-1, len(NAMES)), v), _flags(block, "copy") == 0
    if parts == [WHOLE]:
        return [strength[once, 0]]
    return [np.concatenate([strength[once & (_flags(block, "part") == part), k] for k, part in enumerate(parts)])]


def fit_pairs(documents: DataFrame) -> Model:
    """The model of ``documents``: ``doc`` (a hash), ``quality`` (0 or 1) and ``values`` (packed features), each once."""
    spark = documents.sparkSession
    documents = documents.withColumn("part", F.pmod(F.shiftrightunsigned("doc", 3), F.lit(FOLDS)).cast("int"))
    n = np.zeros((FOLDS, 2), dtype=np.int64)
    for row in documents.groupBy("part", "quality").count().collect():
        n[row["part"], row["quality"]] = row["count"]
    totals = n.sum(axis=0)
    if not totals.all():
        return Model(np.zeros((len(NAMES), 0)), np.zeros(len(NAMES)), -np.inf if totals[1] else np.inf)
    small, count = int(totals[1] <= totals[0]), max(1, -(-int(totals.max()) // BLOCK))
    copies = min(count, -(-count * LEAST // int(totals[small])))
    copy = F.explode(F.sequence(F.lit(0), F.when(F.col("quality") == small, copies - 1).otherwise(0)))
    dealt = documents.select("*", copy.alias("copy")).withColumn("block", F.pmod(F.shiftrightunsigned("doc", 5) + F.col("copy"), F.lit(count))).withColumn("copy", F.least("copy", F.lit(1)))
    blocks = checkpointed(dealt.groupBy("block").applyInPandas(_block, BLOCKS))
    ranks = np.floor(np.array(LEVELS) * (int(totals.sum()) - 1)).astype(np.int64)
    steps = _ranked(blocks, _features_once, np.tile(ranks, (len(NAMES), 1)))
    blocks = checkpointed(blocks.mapInPandas(partial(_placed, steps=steps), BLOCKS).repartition(min(count, shuffled(blocks))))
    parts = [k for k in range(FOLDS) if n[k].all() and (totals - n[k]).all()]
    every = _descend(blocks, [*parts, WHOLE], PENALTIES if parts else PENALTIES[-1:], steps.size + len(steps))
    last, best = every[:, len(parts) * len(PENALTIES) :], 0
    if parts:
        tried = every[:, : len(parts) * len(PENALTIES)]
        losses = blocks.mapInPandas(partial(_losses, v=tried, parts=parts), "penalty int, loss double").groupBy("penalty").agg(F.sum("loss").alias("loss"))
        best = min((r["loss"], r["penalty"]) for r in losses.collect())[1]
        scored, apart, known = tried[:, best :: len(PENALTIES)], parts, n[parts].sum(axis=0)
    else:
        scored, apart, known = last, [WHOLE], totals
    level, of = totals[0] / totals.sum(), int(known.sum())
    at = int(np.clip(np.ceil((level - 1e-9) * of) - 1, 0, of - 2))
    sides = _ranked(blocks, partial(_left_out, v=scored, parts=apart), np.array([[at, at + 1]]))[0]
    return Model(steps, last[:, best].copy(), _quantile(sides, np.array([at + 1.0, of - at - 1.0]), level))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> Model:
    """The model learned from all texts of ``docs`` (``key``, ``text``) whose key ``labels`` (``key``, ``quality``) marks 0 or 1.

    Null keys and labels are left out, and null texts, which show nothing; a key with both
    labels counts as 0, equal texts of a key count once. With one label only, every score is 0
    or 1 accordingly; with none, 0.
    """
    marks = labels.where(F.col(key).isNotNull() & F.col("quality").isin(0, 1)).groupBy(key).agg(F.min("quality").alias("quality"))
    texts = docs.where(F.col(key).isNotNull() & F.col("text").isNotNull()).select(key, F.xxhash64(F.col(key).cast("string"), "text").alias("doc"), "text")
    measured = texts.mapInPandas(_measured, T.StructType([texts.schema[key]]).add("doc", "long").add("values", "binary"))  # before the join: features move, not texts
    measured = measured.join(marks, key).groupBy("doc").agg(F.first("quality").cast("int").alias("quality"), F.first("values").alias("values"))
    return fit_pairs(checkpointed(measured))


def strengths(model: Model, texts: list[bytes]) -> np.ndarray:
    return model.weights[_places(model.steps, features(texts))].sum(axis=1)


def _scored(frames: Iterator[pd.DataFrame], model) -> Iterator[pd.DataFrame]:
    own = model.value
    for frame, texts in slices(frames):
        odds = strengths(own, texts) - own.threshold + np.log(GOOD / (1 - GOOD))
        yield frame.drop(columns=["text"]).assign(score=0.5 * (1 + np.tanh(odds / 2)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without ``text``, with ``score`` from 0 to 1; a null text counts as an empty one. Other columns pass through (a ``score`` is replaced), repeated rows stay."""
    docs = docs.drop("score")
    schema = T.StructType([f for f in docs.schema.fields if f.name != "text"]).add("score", "double")
    return docs.mapInPandas(partial(_scored, model=docs.sparkSession.sparkContext.broadcast(model)), schema)


def op13_quality(spark, sf_dir):
    """The quality of every document, learned from the labels of three in four; a null ``doc_id`` is learned from by no model and not held out."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = train(docs, labels.where(~held_out))
    scored = score(docs.withColumn("held_out", F.coalesce(held_out, F.lit(False))), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))
