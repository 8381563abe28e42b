"""Document fingerprints: content-defined chunks as weighted digest sets.

A gear hash over the last 32 bytes proposes boundaries; a strict mask applies before the
normal chunk size and a loose one after it (normalised chunking), so sizes stay near the
normal. A fingerprint is the set of chunk digests with their lengths. Edits move only the
boundaries near them, so what two texts share keeps its digests, wherever it stands.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..tables import table
from .arrays import _G, SLICE_BYTES, joined, running, spans

#: Bytes of a chunk: least, normal and most.
LEAST, NORMAL, MOST = 8, 32, 128
#: Hash bits that must be 0 at a boundary before and after the normal size.
STRICT_BITS, LOOSE_BITS = 7, 4
WINDOW = 32
_GEAR = (_G >> np.uint64(32)).astype(np.uint32)
_GEAR[0] = 0
#: Rows for one range of keys, about, and ranges at most: enough to spread the work.
RANGE_ROWS, RANGES = 2000, 20_000


def _boundaries(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunks of all texts in ``data`` (parted by WINDOW zero bytes): text number, start, end."""
    gear = _GEAR[data]
    for step in (1, 2, 4, 8, 16):  # after a step of k the value covers 2k bytes
        gear[step:] += gear[:-step] << np.uint32(step)
    loose = np.flatnonzero(gear >> np.uint32(32 - LOOSE_BITS) == 0) + 1
    strict = (loose[gear[loose - 1] >> np.uint32(32 - STRICT_BITS) == 0]).tolist()
    loose = loose.tolist()
    text, cuts, begins = [], [], []
    for i, (at, stop) in enumerate(zip(start.tolist(), end.tolist(), strict=True)):
        s, e = bisect_left(strict, at), bisect_left(loose, at)
        while at < stop:
            cut, normal = min(at + MOST, stop), at + NORMAL
            s = bisect_left(strict, at + LEAST, s)
            if s < len(strict) and strict[s] < normal:
                cut = min(strict[s], cut)
            elif normal < cut:
                e = bisect_left(loose, normal, e)
                if e < len(loose) and loose[e] < cut:
                    cut = loose[e]
            text.append(i)
            begins.append(at)
            cuts.append(cut)
            at = cut
    return np.array(text, np.int64), np.array(begins, np.int64), np.array(cuts, np.int64)


def digest_sets(texts: list[bytes]) -> list[np.ndarray]:
    """For each text its sorted distinct chunk digests: 48 bits of hash over 16 bits of length."""
    out: list[np.ndarray] = []
    begin = 0
    while begin < len(texts):
        stop, size = begin + 1, len(texts[begin])
        while stop < len(texts) and size + len(texts[stop]) <= SLICE_BYTES:
            size += len(texts[stop])
            stop += 1
        data, start, end = joined(texts[begin:stop], b"\0" * WINDOW)
        text, first, last = _boundaries(data, start, end)
        value = (spans(running(data), first, last) & ~np.uint64(0xFFFF)) | (last - first).astype(np.uint64)
        edges = np.searchsorted(text, np.arange(stop - begin + 1))
        out += [np.unique(value[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        begin = stop
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Containment: the shared chunks' bytes over those of the smaller set. Two empty sets are alike (1), an empty and another not (0)."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    weigh = lambda x: int((x & np.uint64(0xFFFF)).sum())
    return weigh(np.intersect1d(a, b, assume_unique=True)) / min(weigh(a), weigh(b))


def encoded(digests: np.ndarray) -> str:
    """The set as base64 of big-endian 8-byte values."""
    return base64.b64encode(digests.astype(">u8").tobytes()).decode()


def decoded(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), dtype=">u8").astype(np.uint64)


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without ``text`` but with ``fingerprint``; null counts as empty, whose fingerprint is the empty string. No shuffle."""
    docs = docs.drop("fingerprint")
    schema = docs.drop(text).withColumn("fingerprint", F.lit("")).schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in frame[text]]
            yield frame.drop(columns=[text]).assign(fingerprint=[encoded(x) for x in digest_sets(texts)])

    return docs.mapInPandas(run, schema)


def _packed(frames: Iterator[pd.DataFrame], cuts: np.ndarray, firsts) -> Iterator[pd.DataFrame]:
    """Each row to its range of keys; the first row of a range also to the end of the range before it."""
    import zstandard

    press = zstandard.ZstdCompressor(level=3).compress
    for frame in frames:
        part = np.searchsorted(-cuts, -frame["_key"].to_numpy(dtype=np.float64), side="right")
        data = [press((t or "").encode("utf-8", "surrogatepass")) for t in frame["text"]]
        rows = pd.DataFrame({"part": part, "last": 0, "key": frame["_key"], "tie": frame["_tie"], "doc_id": frame["doc_id"].astype("Int64"), "data": data})
        yield rows
        begins = [(i, firsts.value[p][2]) for i, p, k, t in zip(range(len(rows)), part.tolist(), rows["key"].tolist(), rows["tie"].tolist(), strict=True) if firsts.value[p][:2] == (k, t)]
        if begins:
            extra = rows.iloc[[i for i, _ in begins]].copy()
            yield extra.assign(part=[p for _, p in begins], last=1)


def _paired(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in order of range and key, descending; each but a range's closing rows gives a result, with the row after it as the next document."""
    import zstandard

    open_ = zstandard.ZstdDecompressor().decompress
    held = None  # the row before, whose next one is still to come
    columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    for frame in frames:
        for begin in range(0, len(frame), 500):
            piece = frame.iloc[begin : begin + 500]
            texts = [open_(x) for x in piece["data"]]
            rows = list(zip(piece["part"], piece["last"], piece["doc_id"], [t.decode("utf-8", "surrogatepass") for t in texts], digest_sets(texts), strict=True))
            pairs = []
            for row in rows:
                if held is not None and held[0] == row[0]:
                    pairs.append((held, row))
                held = row if not row[1] else None
            edited = [a[3][: len(a[3]) - len(a[3]) // 2] + b[3][: len(a[3]) // 2] for a, b in pairs]
            coded = [t.encode("utf-8", "surrogatepass") for t in edited]
            yield pd.DataFrame(
                [(a[2], len(a[3]), hashlib.sha256(raw).hexdigest(), encoded(a[4]), encoded(own), likeness(a[4], own), likeness(a[4], b[4])) for (a, b), raw, own in zip(pairs, coded, digest_sets(coded), strict=True)], columns=columns
            ).astype({"doc_id": "Int64"})


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document (``doc_id``, ``text``) and of its text edited with the next one's.

    The next document is the one after it by descending ``doc_id``; repeated ids go by a hash
    of the text, null ids come last, and the first document follows the last. The edited text
    has the last half of the code points (rounded down) replaced by as many first ones of the
    next document, or all it has. Null texts count as empty. Texts are moved once, to ranges
    of ids: only a row per range comes to the driver.
    """
    docs = docs.select("doc_id", "text").withColumns({"_key": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), "_tie": F.xxhash64(F.coalesce("text", F.lit("")))})
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    ranges = min(RANGES, docs.count() // RANGE_ROWS + 1)
    cuts = np.array(sorted(set(docs.select(F.col("_key").cast("double").alias("k")).approxQuantile("k", [i / ranges for i in range(1, ranges)], 0.1 / ranges)), reverse=True) if ranges > 1 else [], dtype=np.float64)
    def first_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(part=np.searchsorted(-cuts, -f["_key"].to_numpy(dtype=np.float64), side="right"))

    head = F.max(F.struct("_key", "_tie")).alias("head")
    found = sorted((r["part"], r["head"]["_key"], r["head"]["_tie"]) for r in docs.select("_key", "_tie").mapInPandas(first_rows, "_key long, _tie long, part long").groupBy("part").agg(head).collect())  # a row per range
    firsts = {p: (k, t, found[i - 1][0]) for i, (p, k, t) in enumerate(found)}  # the range before the first is the last
    shared = docs.sparkSession.sparkContext.broadcast(firsts)
    packed = docs.mapInPandas(partial(_packed, cuts=cuts, firsts=shared), "part long, last int, key long, tie long, doc_id long, data binary")
    dealt = packed.repartition(max(1, min(len(firsts), 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))), "part")
    ordered = dealt.sortWithinPartitions("part", "last", F.desc("key"), F.desc("tie"))
    return ordered.mapInPandas(_paired, schema)


def op1_fingerprints(spark, sf_dir):
    """The fingerprint of every document and of its edited text. Other columns are not read."""
    return compare_edited(table(spark, sf_dir, "documents"))
