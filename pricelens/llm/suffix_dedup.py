"""Repeated substrings, found by sorting suffixes blockwise with a difference cover.

Every window of ``LENGTH`` bytes belongs to one suffix bucket: its anchor, the 100-byte
string with the least hash that starts in its first half. Equal windows have equal anchors.
Only anchors that occur twice are followed: the bytes around them, each distinct string of
them once with its number of places, are dealt by anchor, and a task sorts the suffixes of a
few buckets at a time. Suffixes with equal heads are told apart by the ranks of a
difference-cover sample (positions whose residues mod 31 lie in a set with every
difference), sorted once for the block, so that memory is bounded by the block. An anchor
with very many places is dealt by longer strings, a window each, to the same sort.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..tables import checkpointed, table
from .arrays import SLICE_BYTES, joined, running, spans

LENGTH = 200
#: Bytes of an anchor; windows of LENGTH bytes have LENGTH - ANCHOR + 1 of them.
ANCHOR = 100
#: Modulus and residues of the difference cover: every difference mod 31 occurs.
MODULUS, COVER = 31, (1, 5, 11, 24, 25, 27)
#: Bytes at either end of a window that are compared as they are; ranks are of what is between them.
END = 45
#: Anchors with more places than this are dealt by whole windows.
HOT = 50_000
BLOCK_BYTES = 2 << 20
#: Longer texts are cut into overlapping pieces for the search of anchors.
PIECE = 4 << 20

#: Words of eight bytes that cover a window's ends.
_HEAD = (*range(0, END - 8, 8), END - 8)
_TAIL = (*range(LENGTH - END, LENGTH - 8, 8), LENGTH - 8)
_IN_COVER = np.isin(np.arange(2 * MODULUS) % MODULUS, COVER)
#: For two residues the first shift that moves both into the cover.
_SHIFT = np.array([[next(d for d in range(MODULUS) if _IN_COVER[i + d] and _IN_COVER[j + d]) for j in range(MODULUS)] for i in range(MODULUS)])


def _runs(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Runs of windows with the same anchor: text number, first window, number of windows, anchor's place in the text, anchor's hash."""
    out = []
    data, start, end = joined(texts)
    if len(data) < LENGTH:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    sums = running(data)
    at = np.arange(len(data) - ANCHOR + 1)
    value = spans(sums, at, at + ANCHOR)
    least = (value & ~np.uint64(0xFFFFFF)) | at.astype(np.uint64)  # equal hashes: the leftmost
    width, size = LENGTH - ANCHOR + 1, 1
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
    anchor = (least & np.uint64(0xFFFFFF)).astype(np.int64)
    window = np.arange(len(anchor))
    text = np.searchsorted(start, window, side="right") - 1
    valid = window + LENGTH <= end[text]
    window, text, anchor = window[valid], text[valid], anchor[valid]
    if not len(window):
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]))
    count = np.diff(np.concatenate([new, [len(window)]]))
    out = (text[new], window[new] - start[text[new]], count, anchor[new] - start[text[new]], value[anchor[new]])
    return out


def _runs_of(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """The runs of all texts, slice by slice; long texts piece by piece."""
    held, number, size = [], [], 0
    for i, t in enumerate(texts):
        for k in range(0, max(1, len(t)), PIECE):
            piece = t[k : k + PIECE + LENGTH - 1] if len(t) > PIECE else t
            if held and size + len(piece) > SLICE_BYTES:
                yield _numbered(held, number)
                held, number, size = [], [], 0
            held.append(piece)
            number.append((i, k))
            size += len(piece)
    if held:
        yield _numbered(held, number)


def _numbered(held: list[bytes], number: list[tuple[int, int]]) -> tuple[np.ndarray, ...]:
    part, first, count, anchor, key = _runs(held)
    which = np.array(number, dtype=np.int64).reshape(-1, 2)
    return which[part, 0], first + which[part, 1], count, anchor + which[part, 1], key


def _utf8(frame: pd.DataFrame, column: str = "text") -> list[bytes]:
    return [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in frame[column]]


def _anchors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        ids = frame["t"].to_numpy()
        for text, first, count, anchor, key in _runs_of(_utf8(frame)):
            yield pd.DataFrame({"key": key.view(np.int64), "t": ids[text], "first": first, "n": count.astype(np.int32)})


def _distinct(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts compressed; copies within a task once (as far as a bounded memory of them reaches)."""
    import zstandard

    press, seen = zstandard.ZstdCompressor(level=3).compress, set()
    for frame in frames:
        frame = frame.drop_duplicates(["t", "u"])
        frame = frame[[x not in seen for x in zip(frame["t"].tolist(), frame["u"].tolist(), strict=True)]]
        seen = seen if len(seen) < 200_000 else set()
        seen.update(zip(frame["t"].tolist(), frame["u"].tolist(), strict=True))
        yield pd.DataFrame({"t": frame["t"], "u": frame["u"], "data": [press(x) for x in _utf8(frame)]})


def _opened(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list[bytes]]]:
    import zstandard

    for frame in frames:
        for begin in range(0, len(frame), 200):
            piece = frame.iloc[begin : begin + 200]
            open_ = zstandard.ZstdDecompressor().decompress
            yield piece, [open_(x) for x in piece["data"]]


def _spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows of runs, and their run's number."""
    run = np.repeat(np.arange(len(first)), count)
    return first[run] + np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count), run


def _contexts(frames: Iterator[pd.DataFrame], with_data: bool) -> Iterator[pd.DataFrame]:
    """The bytes under the runs of each text (its contexts), by key and two hashes; equal ones of a text in one row, with all their places."""
    names = ["key", "h1", "h2", "hot", "n", *(["data", "places"] if with_data else ["t", "u", "firsts"])]
    for frame, texts in _opened(frames):
        rows = []
        for t, u, data, runs in zip(frame["t"].tolist(), frame["u"].tolist(), texts, frame["runs"], strict=True):
            key, first, count, hot = (np.array([r[f] for r in runs], dtype=np.int64) for f in ("key", "first", "n", "hot"))
            own = np.flatnonzero(first + count + LENGTH - 1 <= len(data))  # runs of another text of the same hash may reach beyond
            key, first, count, hot = key[own], first[own], count[own], hot[own]
            raw, end = np.frombuffer(data, dtype=np.uint8), first + count + LENGTH - 1
            h1, h2 = (spans(running(raw ^ np.uint8(k)), first, end).view(np.int64) for k in (0, 0x5A))
            order = np.lexsort((first, h2, h1, key))
            new = np.flatnonzero(np.concatenate([[True], (key[order][1:] != key[order][:-1]) | (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])])[: len(order)])
            for x, y in zip(new.tolist(), [*new[1:].tolist(), len(order)], strict=True):
                k = order[x]
                mine = (data[first[k] : end[k]], y - x) if with_data else (t, u, first[order[x:y]].tolist())
                rows.append((int(key[k]), int(h1[k]), int(h2[k]), bool(hot[k]), int(count[k]), *mine))
        yield pd.DataFrame(rows, columns=names)


def _windows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Contexts of very frequent anchors, a row and a bucket for each window."""
    for frame in frames:
        for row in frame.to_dict("records"):
            at = np.arange(row["n"])
            bucket = spans(running(np.frombuffer(row["data"], dtype=np.uint8)), at, at + LENGTH).view(np.int64)
            yield pd.DataFrame({"key": row["key"], "h1": row["h1"], "h2": row["h2"], "n": 1, "data": [row["data"][i : i + LENGTH] for i in at.tolist()], "places": row["places"], "bucket": bucket, "at": at})


def _word(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes at each place as a number that sorts like them."""
    return np.lib.stride_tricks.sliding_window_view(data, 8)[at].view(">u8").reshape(-1).astype(np.uint64)


def _ranks(keys: list[np.ndarray]) -> np.ndarray:
    """The rank of each row of ``keys``, first key first; equal rows have equal ranks."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), dtype=np.int64)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(new)
    return out


def _ties(group: np.ndarray, places: np.ndarray, data: np.ndarray, offsets: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted within their group by the bytes at the offsets; only those that tie with another stay, in finer groups."""
    for k in offsets:
        word = _word(data, places + k)
        order = np.lexsort((word, group))
        group, places, word = group[order], places[order], word[order]
        if not len(group):
            break
        fine = np.cumsum(np.concatenate([[0], (group[1:] != group[:-1]) | (word[1:] != word[:-1])]))
        tied = np.bincount(fine)[fine] > 1
        group, places = fine[tied], places[tied]
    return group, places


def _cover_ranks(data: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Alphabetical ranks of the LENGTH - END bytes at the cover's positions where ``wanted``, by doubling from those of MODULUS bytes."""
    middle = LENGTH - END
    sample = np.flatnonzero(_IN_COVER[np.arange(len(data)) % MODULUS] & wanted)
    sample = sample[sample + MODULUS <= len(data)]
    place = np.full(len(data) + middle, len(sample), dtype=np.int32)
    place[sample] = np.arange(len(sample), dtype=np.int32)
    short = _ranks([_word(data, sample + k) for k in (0, 8, 16, MODULUS - 8)])
    far = lambda rank, k: np.append(rank, -1)[place[sample + k]]  # noqa: E731  the sample holds every MODULUS-th position after its own
    rank, size = short, MODULUS
    while size * 2 <= middle:
        rank, size = _ranks([rank, far(rank, size)]), size * 2
    if size < middle:
        rank = _ranks([rank, far(short, size)])
    out = np.full(len(data) + MODULUS, -1, dtype=np.int32)
    out[sample] = rank
    return out


def _resolve(buckets: np.ndarray, counts: np.ndarray, contexts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Which windows of a block repeat among its contexts: number of the context, and place in it."""
    data, start, end = joined(contexts, b"")
    suffix, which = _spread(start, counts)
    group, places = _ties(np.unique(buckets, return_inverse=True)[1][which], suffix, data, _HEAD + _TAIL)
    if not len(places):
        return places, places
    owner = np.searchsorted(start, places, side="right") - 1
    wanted = np.zeros(len(contexts) + 1, dtype=bool)
    wanted[owner] = True
    rank = _cover_ranks(data, np.repeat(wanted[:-1], end - start))
    held, left = [], np.arange(len(places))
    while len(left):
        own = group[left]
        lead = left[np.searchsorted(own, own)]  # the first that is left of each tie
        shift = _SHIFT[places[left] % MODULUS, places[lead] % MODULUS]
        same = rank[places[left] + shift] == rank[places[lead] + shift]
        several = np.bincount(own[same], minlength=int(own[-1]) + 1) > 1
        held.append(places[left[same & several[own]]])
        left = left[~same]
    places = np.concatenate(held)
    owner = np.searchsorted(start, places, side="right") - 1
    return owner, places - start[owner]


def _blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Repeated spans of contexts sorted by bucket, as places in the context; of a context with several places all is repeated."""
    none = pd.DataFrame({"key": [], "h1": [], "h2": [], "first": [], "n": []}).astype("int64")

    def settled(rows: pd.DataFrame) -> pd.DataFrame:
        twice = rows["places"] > 1
        whole = rows.loc[twice, ["key", "h1", "h2"]].assign(first=rows.loc[twice, "at"], n=rows.loc[twice, "n"] + LENGTH - 1)
        rows = rows[rows["bucket"].duplicated(keep=False)]
        rows = rows[(rows["places"] == 1).groupby(rows["bucket"]).transform("any")] if len(rows) else rows
        if not len(rows):
            return whole.astype("int64")
        which, place = _resolve(rows["bucket"].to_numpy(), rows["n"].to_numpy(dtype=np.int64), list(rows["data"]))
        alone = rows["places"].to_numpy()[which] == 1
        which, place = which[alone], place[alone]
        order = np.lexsort((place, which))
        which, place = which[order], place[order]
        if not len(place):
            return whole.astype("int64")
        new = np.flatnonzero(np.concatenate([[True], (which[1:] != which[:-1]) | (place[1:] > place[:-1] + LENGTH)]))
        last = np.concatenate([new[1:], [len(place)]]) - 1
        found = rows[["key", "h1", "h2"]].iloc[which[new]].assign(first=rows["at"].to_numpy()[which[new]] + place[new], n=place[last] + LENGTH - place[new])
        return pd.concat([whole, found]).astype("int64")

    held: list[pd.DataFrame] = []
    size = 0
    for frame in frames:
        held.append(frame)
        size += int(frame["data"].map(len).sum())
        if size > BLOCK_BYTES:
            rows = pd.concat(held)
            open_ = rows["bucket"] == rows["bucket"].iloc[-1]  # its other rows may be still to come
            held, ready = [rows[open_]], rows[~open_]
            size = int(held[0]["data"].map(len).sum())
            if len(ready):
                step = np.cumsum(ready["data"].map(len).to_numpy())
                group = ready["bucket"].ne(ready["bucket"].shift()).cumsum().to_numpy()
                block = step[np.searchsorted(group, group, side="left")] // BLOCK_BYTES  # a bucket's rows stay together
                for b in np.unique(block):
                    yield settled(ready[block == b])
    rows = pd.concat(held) if held else none
    if len(rows):
        yield settled(rows)


def _cut(frames: Iterator[pd.DataFrame], want_text: bool) -> Iterator[pd.DataFrame]:
    for frame, texts in _opened(frames):
        rows = []
        for t, u, data, found in zip(frame["t"].tolist(), frame["u"].tolist(), texts, frame["found"], strict=True):
            begin, size = [], []
            for x in found:
                places, first = np.asarray(x["firsts"], dtype=np.int64), np.array([s["first"] for s in x["spans"]], dtype=np.int64)
                begin.append((places[:, None] + first).reshape(-1))
                size.append(np.tile(np.array([s["n"] for s in x["spans"]], dtype=np.int64), len(places)))
            begin, size = np.concatenate(begin), np.concatenate(size)
            order = np.argsort(begin, kind="stable")
            begin, reach = begin[order], np.maximum.accumulate((begin + size)[order])
            new = np.flatnonzero(np.concatenate([[True], begin[1:] > reach[:-1]]))
            begin, end = begin[new], reach[np.concatenate([new[1:], [len(reach)]]) - 1]
            kept = b"".join(data[a:b] for a, b in zip([0, *end.tolist()], [*begin.tolist(), len(data)], strict=True))
            rows.append((t, u, int((end - begin).sum()), len(begin), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if want_text else None))
        yield pd.DataFrame(rows, columns=["t", "u", "n_removed", "n_spans", "kept_sha256", "kept"])


def repeated_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What repeats in the texts of ``docs`` (``text``, and ``t`` and ``u``, two hashes of it), and the texts where it may, by both.

    A row (``t``, ``u``, ``firsts``, ``spans``) says that at each of some places of a text the
    spans (``first``, ``n``) are under a repeated window of LENGTH bytes. A text counts once
    here, whatever its copies. Spans of a text may overlap.
    """
    anchors = docs.mapInPandas(_anchors, "key long, t long, first long, n int")
    place = F.xxhash64("t", "first")
    keys = anchors.groupBy("key").agg(F.min(place).alias("lo"), F.max(place).alias("hi"), F.count("*").alias("places")).where("lo <> hi")
    keys = checkpointed(keys.select("key", (F.col("places") > HOT).alias("hot")))
    # copies of a text meet here; the set holds one text's own runs
    by_text = checkpointed(anchors.join(keys, "key").groupBy("t").agg(F.collect_set(F.struct("key", "first", "n", "hot")).alias("runs")))
    # texts are moved once, by their hash; only those with such anchors are kept, for all later steps
    texts = docs.mapInPandas(_distinct, "t long, u long, data binary").repartition("t").dropDuplicates(["t", "u"])
    own, id_ = checkpointed(texts.join(by_text, "t")), ["key", "h1", "h2"]
    parts = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    contexts = own.mapInPandas(partial(_contexts, with_data=True), "key long, h1 long, h2 long, hot boolean, n long, data binary, places long")
    once = [F.first("n").alias("n"), F.first("data").alias("data"), F.sum("places").alias("places")]
    # one shuffle deals the contexts by anchor and brings equal ones together
    cold = contexts.where("not hot").repartition(parts, "key").groupBy(*id_).agg(*once).withColumns({"bucket": F.col("key"), "at": F.lit(0).cast("long")}).sortWithinPartitions("bucket")
    schema = "key long, h1 long, h2 long, first long, n long"
    found = cold.mapInPandas(_blocks, schema)
    if keys.where("hot").limit(1).count():
        hot = contexts.where("hot").groupBy(*id_).agg(*once).mapInPandas(_windows, "key long, h1 long, h2 long, n long, data binary, places long, bucket long, at long")
        found = found.unionByName(hot.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInPandas(_blocks, schema))
    found = found.groupBy(*id_).agg(F.collect_list(F.struct("first", "n")).alias("spans"))  # one context's own
    places = own.mapInPandas(partial(_contexts, with_data=False), "key long, h1 long, h2 long, hot boolean, n long, t long, u long, firsts array<long>")
    return places.select(*id_, "t", "u", "firsts").join(found, id_).select("t", "u", "firsts", "spans"), own.drop("runs")


def remove_repeats(docs: DataFrame, want_text: bool = True) -> DataFrame:
    """``docs`` with every byte removed that a repeated string of LENGTH bytes covers: ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``, ``kept``.

    Texts are taken as UTF-8 (null: empty); strings are sought in the texts as given, so no
    place is the original: copies of a text of LENGTH bytes or more lose all of it. ``kept``
    is the remaining text, without characters of which bytes were cut (null for a null text,
    and null throughout with ``want_text`` false). Columns with a result's name are replaced;
    other columns and repeated rows stay; an empty table gives an empty result.
    """
    docs = docs.drop("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
    columns = [c for c in docs.columns if c != "text" or want_text]
    text = F.coalesce("text", F.lit(""))
    t, u = F.xxhash64(text), F.xxhash64(F.lit(LENGTH), text, F.length(text))  # a text's two hashes
    hashed = docs.select(t.alias("t"), u.alias("u"), text.alias("text"))
    copies = hashed.groupBy("t", "u").count().withColumnRenamed("count", "copies")
    found, texts = repeated_spans(hashed)
    found = found.groupBy("t", "u").agg(F.collect_list(F.struct("firsts", "spans")).alias("found"))  # a text's own
    cut = texts.join(found, ["t", "u"]).mapInPandas(partial(_cut, want_text=want_text), "t long, u long, n_removed long, n_spans long, kept_sha256 string, kept string")
    cut = copies.join(cut, ["t", "u"], "left").where("copies > 1 or n_removed is not null")
    names = [f"_{i}" for i in range(len(columns))]
    rows = docs.select(*(F.col(c).alias(x) for c, x in zip(columns, names, strict=True)), t.alias("t"), u.alias("u"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("_sha"))
    whole = (F.coalesce("copies", F.lit(1)) > 1) & (F.col("n_bytes") >= LENGTH)
    out = rows.join(cut.select("t", "u", "copies", "n_removed", "n_spans", "kept_sha256", *(["kept"] if want_text else [])), ["t", "u"], "left")
    given = F.col(names[columns.index("text")]) if want_text else None
    return out.select(
        *(F.col(x).alias(c) for c, x in zip(columns, names, strict=True)),
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "_sha")).alias("kept_sha256"),
        *([F.when(given.isNotNull(), F.when(whole, F.lit("")).otherwise(F.coalesce("kept", given))).alias("kept")] if want_text else []),
    )


def op6_suffix_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), want_text=False)


OP6_SQL = """
WITH doc AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
size AS (SELECT doc_id, x, length(x) // 2 AS n_bytes FROM doc),
string AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 400)) AS s FROM (SELECT *, unnest(range(0, n_bytes - 199)) AS i FROM size WHERE n_bytes >= 200)),
twice AS (SELECT s FROM string GROUP BY s HAVING count(*) > 1),
place AS (SELECT doc_id, i, i > lag(i) OVER w + 200 OR lag(i) OVER w IS NULL AS fresh FROM string SEMI JOIN twice USING (s) WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
span AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM (SELECT *, count(*) FILTER (WHERE fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM place) GROUP BY doc_id, k),
cut AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b FROM span GROUP BY doc_id)
SELECT doc_id, n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN n_removed IS NULL THEN x ELSE array_to_string(list_transform(range(0, len(a) + 1), lambda k: substr(x, 2 * (CASE WHEN k = 0 THEN 0 ELSE b[k] END) + 1, 2 * ((CASE WHEN k = len(a) THEN n_bytes ELSE a[k + 1] END) - (CASE WHEN k = 0 THEN 0 ELSE b[k] END)))), '') END)) AS kept_sha256
FROM size LEFT JOIN cut USING (doc_id)
"""
