"""Language identification with bit-sliced Bloom filters over character n-grams.

One table holds the filters of all languages: cell ``p`` is a bitmask of the languages that
set bit ``p`` (in several words beyond 63 languages). The AND of the cells that an n-gram
hashes to names every language that has it. A text's hits per language, corrected for the
language's false-positive rate, decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..tables import table
from .arrays import mix, slices

#: Cells of the table (8 bytes each), hashes for each n-gram, characters of an n-gram.
CELLS, HASHES, NGRAM = 1 << 20, 3, 4
#: The model is fitted on this many documents of each language at most (the least hashes of their keys).
SAMPLE = 1000
#: An n-gram is a language's from this many uses in its sample on.
LEAST_USES = 2
#: Languages in one word of the bitmask.
WORD = 63
_LETTERS = regex.compile(r"\p{L}+")


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-grams of every text, their text's number, and whether each text has a letter.

    Letters are lower-cased; every run of other characters is one space.
    """
    runs = [" " + " ".join(_LETTERS.findall(t.decode("utf-8", "replace").lower())) + " " for t in texts]
    letters = np.array([len(r) > 2 for r in runs], dtype=bool)
    size = np.fromiter(map(len, runs), dtype=np.int64, count=len(runs))
    code = np.frombuffer("".join(runs).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    text = np.repeat(np.arange(len(runs)), size)
    if len(code) < NGRAM:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), letters
    value = np.zeros(len(code) - NGRAM + 1, dtype=np.uint64)
    for i in range(NGRAM):
        value = value * np.uint64(0x110001) + code[i : len(code) - NGRAM + 1 + i]
    whole = text[: len(value)] == text[NGRAM - 1 :]
    return mix(value[whole]), text[: len(value)][whole], letters


def _cells(grams: np.ndarray) -> list[np.ndarray]:
    return [(mix(grams, seed) & np.uint64(CELLS - 1)).astype(np.int64) for seed in range(1, HASHES + 1)]


def _count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Uses of each n-gram in each language, by slice."""
    for frame, texts in slices(frames):
        grams, text, _ = _grams(texts)
        if len(grams):
            out = pd.DataFrame({"lang": frame["lang"].to_numpy()[text], "gram": grams.view(np.int64)})
            yield out.groupby(["lang", "gram"], as_index=False).size().rename(columns={"size": "uses"})


def train(labelled: DataFrame, key: str = "doc_id") -> dict:
    """Filters learned from ``labelled`` (``key``, ``text``, ``lang``; null languages are left out).

    The sample has up to :data:`SAMPLE` documents a language, fewer than Spark's limit for
    ranking within a group before the shuffle. An n-gram enters the filter of each language
    that uses it :data:`LEAST_USES` times or more.
    """
    known = labelled.where(F.col("lang").isNotNull())
    order = Window.partitionBy("lang").orderBy(F.xxhash64(F.col(key).cast("string")), key)
    picked = known.select(key, "lang").distinct().withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= SAMPLE).drop("_n")
    texts = known.join(F.broadcast(picked), [key, "lang"]).select("text", "lang")  # SAMPLE keys a language at most
    names = [r[0] for r in picked.select("lang").distinct().orderBy("lang").collect()]
    words = max(1, -(-len(names) // WORD))
    table_ = np.zeros((words, CELLS), dtype=np.int64)
    if names:
        uses = texts.mapInPandas(_count, "lang string, gram long, uses long").groupBy("gram", "lang").agg(F.sum("uses").alias("uses")).where(F.col("uses") >= LEAST_USES)
        place = uses.withColumn("place", F.create_map(*(F.lit(x) for i, n in enumerate(names) for x in (n, i)))[F.col("lang")])
        bits = place.groupBy("gram", F.floor(F.col("place") / WORD).cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(place % {WORD} as int))")).alias("mask"))
        cells = bits.mapInPandas(_positions, "word int, cell int, mask long").groupBy("word", "cell").agg(F.bit_or("mask").alias("mask")).toPandas()  # a row a cell at most
        table_[cells["word"].to_numpy(), cells["cell"].to_numpy()] = cells["mask"].to_numpy()
    full = [float(np.mean((table_[i // WORD] >> (i % WORD)) & 1)) for i in range(len(names))]
    return {"languages": names, "cells": table_, "false_rate": [f**HASHES for f in full]}


def _positions(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        cells = _cells(frame["gram"].to_numpy().view(np.uint64))
        yield pd.DataFrame({"word": np.tile(frame["word"].to_numpy(), HASHES), "cell": np.concatenate(cells).astype(np.int32), "mask": np.tile(frame["mask"].to_numpy(), HASHES)})


def _predict(frames: Iterator[pd.DataFrame], model) -> Iterator[pd.DataFrame]:
    names, cells, false_rate = model.value["languages"], model.value["cells"], np.array(model.value["false_rate"])
    for frame, texts in slices(frames):
        grams, text, letters = _grams(texts)
        mask = np.full((len(cells), len(grams)), -1, dtype=np.int64)
        for at in _cells(grams):
            mask &= cells[:, at]
        n = np.bincount(text, minlength=len(texts)).astype(float)
        hits = np.array([np.bincount(text[(mask[i // WORD] >> (i % WORD) & 1).astype(bool)], minlength=len(texts)) for i in range(len(names))]).reshape(len(names), len(texts))
        share = np.clip((hits / np.maximum(n, 1) - false_rate[:, None]) / np.maximum(1 - false_rate[:, None], 1e-9), 0, 1)
        if names:
            best = share.argmax(0)
            lang = np.where(letters, np.array(names, dtype=object)[best], "und")
            score = np.where(letters, share[best, np.arange(len(texts))], 0.0)
        else:
            lang, score = np.full(len(texts), "und", dtype=object), np.zeros(len(texts))
        yield frame.drop(columns=["text"]).assign(lang_pred=lang, score=score)


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` without ``text``, with ``lang_pred`` and ``score`` (the corrected share of its n-grams that the language has).

    Equal shares go to the first language by name. A null text, one without letters, and any
    text under a model without languages get ``und`` and 0. Other columns pass through, except
    those with a result's name, which are replaced; repeated rows stay.
    """
    docs = docs.drop("lang_pred", "score")
    schema = T.StructType([f for f in docs.schema.fields if f.name != "text"]).add("lang_pred", "string").add("score", "double")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # CELLS numbers, whatever the corpus
    return docs.mapInPandas(partial(_predict, model=shared), schema)


def op2_language_id(spark, sf_dir):
    """The language of every document, learned from three in four; a null ``doc_id`` is learned from by no model and not held out. Other columns are not read."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = train(docs.where(~held_out).select("doc_id", "text", "lang"))
    return predict(docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out")), model)
