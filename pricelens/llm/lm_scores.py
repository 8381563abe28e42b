"""Stupid-backoff scores of documents under n-gram counts of all other documents.

Documents are dealt into blocks. Length by length, a block's distinct n-grams with their uses
in the block are dealt into slots, ranges of their hashes; the count table is the sum over all
blocks of a slot, and what is used outside a block returns to it, in the order it was sent. An
n-gram that others use has only parts that others use, so each length sends only n-grams whose
two parts have been found elsewhere. At last a block's counts are looked up and summed per
document. A frequent n-gram is sent once a block, not once a use. What a block has for a slot is
one row of packed numbers: a row for each n-gram takes twice the bytes there, and more back.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..tables import table
from .arrays import mix, slices, word_hashes

#: Longest n-gram, and the factor of each step to a shorter context.
ORDER, BACKOFF = 3, 0.4
#: Bytes of text of a block, and words of the corpus for each slot, about.
BLOCK_BYTES, SLOT_WORDS = 12 << 20, 1 << 22


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes and text numbers, with memory for one slice's bytes at a time."""
    hashes, owner, before = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    begin = 0
    while begin < len(texts):
        stop, size = begin + 1, len(texts[begin])
        while stop < len(texts) and size < 1 << 20:
            size += len(texts[stop])
            stop += 1
        h, t, *_ = word_hashes(texts[begin:stop])
        hashes.append(h)
        owner.append(t + before)
        before, begin = before + stop - begin, stop
    return np.concatenate(hashes), np.concatenate(owner)


def _grams(words: np.ndarray, text: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length the hash of the n-gram that ends at each word, and whether the text has that many words before."""
    gram, whole = mix(words, 1), np.ones(len(words), dtype=bool)
    for n in range(1, order + 1):
        if n > 1:
            longer = np.zeros_like(gram)
            longer[1:] = mix(gram[:-1] * np.uint64(0x9E3779B1) + words[1:], n)
            gram = longer
            whole = whole & np.concatenate([[False] * min(n - 1, len(words)), text[n - 1 :] == text[: len(text) - n + 1]])
        yield gram, whole


def _pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import zstandard

    press = zstandard.ZstdCompressor(level=3).compress
    for frame in frames:
        yield frame.drop(columns=["text"]).assign(data=[press(b"" if t is None else t.encode("utf-8", "surrogatepass")) for t in frame["text"]])


def _open(frame: pd.DataFrame) -> list[bytes]:
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    return [unpack(x) for x in frame["data"]]


def _press(arrays: list[np.ndarray]) -> list[bytes]:
    """Whole numbers by planes of their bytes, so that high bytes, which are mostly 0, take no room."""
    import zstandard

    press = zstandard.ZstdCompressor(level=3).compress
    return [press(np.ascontiguousarray(x.astype(np.uint64).view(np.uint8).reshape(-1, 8).T)) for x in arrays]


def _unpress(packed: Iterable[bytes]) -> list[np.ndarray]:
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    return [np.ascontiguousarray(np.frombuffer(unpack(x), dtype=np.uint8).reshape(8, -1).T).view(np.uint64).ravel() for x in packed]


def _rows(block: int, gram: np.ndarray, slots: int) -> pd.DataFrame:
    """A row for each slot: the block's distinct n-grams by hash, as differences, and their uses."""
    distinct, uses = np.unique(gram, return_counts=True)
    slot = (distinct >> np.uint64(32)) * np.uint64(slots) >> np.uint64(32)
    begin = np.flatnonzero(np.diff(slot, prepend=np.uint64(slots)))
    steps = np.diff(distinct, prepend=np.uint64(0))
    steps[begin] = distinct[begin]
    return pd.DataFrame({"slot": slot[begin].astype(np.int64), "block": np.int64(block), "grams": _press(np.split(steps, begin)[1:]), "uses": _press(np.split(uses, begin)[1:])})


def _count(rows: pd.DataFrame) -> pd.DataFrame:
    """A slot's count table, joined to what the blocks sent: how often each n-gram is used outside its block."""
    steps, uses = _unpress(rows["grams"]), np.concatenate(_unpress(rows["uses"])).astype(np.int64)
    sizes = np.array([len(x) for x in steps])
    ends, sums = np.cumsum(sizes), np.cumsum(np.concatenate(steps))  # sums wrap around, and back when one is taken from another
    gram = sums - np.repeat(np.append(np.uint64(0), sums[ends[:-1] - 1]), sizes)
    by = np.argsort(gram)
    other = np.ones(len(by), dtype=bool)
    other[1:] = gram[by[1:]] != gram[by[:-1]]
    outside = -uses
    outside[by] += np.add.reduceat(uses[by], np.flatnonzero(other))[np.cumsum(other) - 1]
    return pd.DataFrame({"block": rows["block"], "slot": rows["slot"], "outside": _press(np.split(outside, ends[:-1]))})


def _runs(begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lengths of runs, and the run of each place; ``begins`` says where one begins."""
    return np.diff(np.append(np.flatnonzero(begins), len(begins))), np.cumsum(begins) - 1


def _elsewhere(gram: np.ndarray, text: np.ndarray, outside: np.ndarray) -> np.ndarray:
    """How often other documents use each n-gram; ``outside`` has the uses outside the block of the distinct ones by hash."""
    by = np.argsort(gram, kind="stable")  # so an n-gram's uses in one text stay together
    other = np.ones(len(by), dtype=bool)
    other[1:] = gram[by[1:]] != gram[by[:-1]]
    uses, which = _runs(other)
    other[1:] |= text[by[1:]] != text[by[:-1]]
    own, same = _runs(other)
    rest = np.empty(len(by), dtype=np.int64)
    rest[by] = (uses + outside)[which] - own[same]
    return rest


def _both(rest: np.ndarray) -> np.ndarray:
    """Where others use the n-gram here and the one before, the two parts of a longer one."""
    found = rest > 0
    return found & np.concatenate([[False], found[:-1]])[: len(found)]


def _levels(words: np.ndarray, text: np.ndarray, counts: pd.DataFrame, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length how often other documents use the n-gram that ends at each word, and whether there is one.

    What was not sent has a part that is used in one document only, and so is used there only.
    """
    sent = np.ones(len(words), dtype=bool)
    for n, (gram, whole) in enumerate(_grams(words, text, order), 1):
        sent &= whole
        packed = counts.loc[counts["n"] == n].sort_values("slot")["outside"]
        rest = np.zeros(len(words), dtype=np.int64)
        rest[sent] = _elsewhere(gram[sent], text[sent], np.concatenate([np.zeros(0, np.int64), *_unpress(packed)]).astype(np.int64))
        yield rest, whole
        sent = _both(rest)


def _explode(block: pd.DataFrame, counts: pd.DataFrame | None, n: int, slots: int) -> pd.DataFrame:
    """A block's n-grams of which both parts are used in other documents, with their uses; ``counts`` are those of all shorter ones."""
    words, text = _words(_open(block))
    *_, (gram, sent) = _grams(words, text, n)
    if n > 1:
        *_, (part, _) = _levels(words, text, counts, n - 1)
        sent = sent & _both(part)
    return _rows(block["block"].iloc[0] if len(block) else 0, gram[sent], slots)


def _sum(block: pd.DataFrame, counts: pd.DataFrame, order: int, total: int, columns: list[str]) -> pd.DataFrame:
    words, text = _words(_open(block))
    sizes = np.bincount(text, minlength=len(block))
    score, shorter, backed = np.zeros(len(words)), np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=bool)
    for n, (rest, whole) in enumerate(_levels(words, text, counts, order), 1):
        if n == 1:
            score = np.log10(np.maximum(rest, 1) / np.maximum(total - sizes, 1)[text])
        else:
            context, seen = np.concatenate([[0], shorter[:-1]])[: len(words)], rest > 0
            score = np.where(seen, np.log10(np.where(seen, rest, 1) / np.where(seen, context, 1)), np.where(whole, np.log10(BACKOFF) + score, score))
            backed = np.where(whole, ~seen, backed)
        shorter = rest
    return block[columns].assign(n_words=sizes, n_backed_off=np.bincount(text[backed], minlength=len(block)), log_score=np.bincount(text, weights=score, minlength=len(block)))


def _exploder(n: int, slots: int):
    return (lambda block: _explode(block, None, n, slots)) if n == 1 else (lambda block, counts: _explode(block, counts, n, slots))


def _size(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for _, texts in slices(frames):
        yield pd.DataFrame({"words": [len(word_hashes(texts)[0])], "bytes": [sum(map(len, texts))]})


def backoff_scores(docs: DataFrame, order: int = ORDER, key: str = "doc_id") -> DataFrame:
    """``docs`` without ``text``, with ``n_words``, ``n_backed_off`` and ``log_score``.

    Words are parted by ASCII white space, A-Z lower-cased. A word's score is the uses of the
    n-gram that ends at it over those of its context, for the longest n-gram up to ``order``
    that *other* documents use, times :data:`BACKOFF` for each shortening; with a single word,
    its uses (at least 1) over all words of other documents. A document's own uses don't count,
    so copies vouch for each other but no text for itself. Words at the start have the context
    there is. ``log_score`` is the sum of decimal logarithms, ``n_backed_off`` the number of
    words whose longest n-gram no other document has. Null and empty texts have 0 in all.
    Columns with a result's name are replaced; other columns and repeated rows stay.
    """
    docs = docs.drop("n_words", "n_backed_off", "log_score")
    size = docs.select("text").mapInPandas(_size, "words long, bytes long").agg(F.sum("words"), F.sum("bytes")).first()
    words, blocks = size[0] or 0, max(1, -(-(size[1] or 0) // BLOCK_BYTES))
    columns = [c for c in docs.columns if c != "text"]
    named = docs.toDF(*(c if c == "text" else f"_{i}" for i, c in enumerate(docs.columns)))
    names = [c for c in named.columns if c != "text"]
    dealt = named.withColumn("block", F.pmod(F.xxhash64(F.col(f"_{docs.columns.index(key)}").cast("string"), "text"), F.lit(blocks)))
    fields = [f for f in dealt.schema.fields if f.name != "text"]
    dealt = dealt.mapInPandas(_pack, T.StructType([*fields]).add("data", "binary"))
    counts, slots, schema = None, max(1, -(-words // SLOT_WORDS)), "slot long, block long, grams binary, uses binary"
    for n in range(1, order + 1):
        sender = dealt.groupBy("block") if n == 1 else dealt.groupBy("block").cogroup(counts.groupBy("block"))
        rows = sender.applyInPandas(_exploder(n, slots), schema)
        own = rows.groupBy("slot").applyInPandas(_count, "block long, slot long, outside binary").withColumn("n", F.lit(n))
        counts = own if counts is None else counts.unionByName(own)
    result = T.StructType([f for f in fields if f.name != "block"]).add("n_words", "long").add("n_backed_off", "long").add("log_score", "double")
    scored = dealt.groupBy("block").cogroup(counts.groupBy("block")).applyInPandas(lambda block, own: _sum(block, own, order, words, names), result)
    return scored.toDF(*columns, "n_words", "n_backed_off", "log_score")


def op5_lm_scores(spark, sf_dir):
    scored = backoff_scores(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scored.select("doc_id", "n_words", "n_backed_off", F.round("log_score", 4).alias("log_score"))


OP5_SQL = r"""
WITH word AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
at_ AS (SELECT doc_id, i, w[i] AS w, CASE WHEN i > 1 THEN w[i - 1] END AS v, CASE WHEN i > 2 THEN w[i - 2] END AS u FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM word)),
total AS (SELECT count(*) AS n FROM at_), own AS (SELECT doc_id, count(*) AS n FROM at_ GROUP BY doc_id),
one AS (SELECT w, count(*) AS c FROM at_ GROUP BY w), one_own AS (SELECT doc_id, w, count(*) AS c FROM at_ GROUP BY ALL),
two AS (SELECT v, w, count(*) AS c FROM at_ WHERE v IS NOT NULL GROUP BY ALL), two_own AS (SELECT doc_id, v, w, count(*) AS c FROM at_ WHERE v IS NOT NULL GROUP BY ALL),
three AS (SELECT u, v, w, count(*) AS c FROM at_ WHERE u IS NOT NULL GROUP BY ALL), three_own AS (SELECT doc_id, u, v, w, count(*) AS c FROM at_ WHERE u IS NOT NULL GROUP BY ALL),
use_ AS (
  SELECT a.doc_id, a.u, a.v, one.c - one_own.c AS cw, v1.c - v1o.c AS cv, two.c - two_own.c AS cvw, v2.c - v2o.c AS cuv, three.c - three_own.c AS cuvw, greatest(total.n - own.n, 1) AS n
  FROM at_ a CROSS JOIN total JOIN own ON own.doc_id = a.doc_id JOIN one ON one.w = a.w JOIN one_own ON one_own.doc_id = a.doc_id AND one_own.w = a.w
  LEFT JOIN one v1 ON v1.w = a.v LEFT JOIN one_own v1o ON v1o.doc_id = a.doc_id AND v1o.w = a.v
  LEFT JOIN two ON two.v = a.v AND two.w = a.w LEFT JOIN two_own ON two_own.doc_id = a.doc_id AND two_own.v = a.v AND two_own.w = a.w
  LEFT JOIN two v2 ON v2.v = a.u AND v2.w = a.v LEFT JOIN two_own v2o ON v2o.doc_id = a.doc_id AND v2o.v = a.u AND v2o.w = a.v
  LEFT JOIN three ON three.u = a.u AND three.v = a.v AND three.w = a.w LEFT JOIN three_own ON three_own.doc_id = a.doc_id AND three_own.u = a.u AND three_own.v = a.v AND three_own.w = a.w),
step AS (SELECT *, CASE WHEN v IS NULL THEN log10(greatest(cw, 1) / n) WHEN cvw > 0 THEN log10(cvw / cv) ELSE log10(0.4) + log10(greatest(cw, 1) / n) END AS s2 FROM use_),
score AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE CASE WHEN u IS NOT NULL THEN cuvw = 0 ELSE v IS NOT NULL AND cvw = 0 END) AS n_backed_off,
  sum(CASE WHEN u IS NULL THEN s2 WHEN cuvw > 0 THEN log10(cuvw / cuv) ELSE log10(0.4) + s2 END) AS s FROM step GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_backed_off, 0)::BIGINT AS n_backed_off, round(coalesce(s, 0), 4)::DOUBLE AS log_score FROM documents d LEFT JOIN score USING (doc_id)
"""
