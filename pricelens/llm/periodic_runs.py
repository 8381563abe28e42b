"""Runs of words that repeat with a period, found by seeds on diagonals.

A run with smallest period ``q`` has at least ``max(6, 4 * q)`` words, so at lag ``q`` at least
``max(5, 3 * q)`` successive words have an equal word ``q`` places on. For the lags of each
octave, ``2**j <= q < 2**(j + 1)``, the index therefore holds the k-grams of the overlap that
every such run guarantees, ``k = max(5, 3 * 2**j)``. As ``k`` is no less than any lag of the
octave, two occurrences of a k-gram in a run are whole periods apart, so pairs of *successive*
occurrences are enough: a document gives fewer pairs than it has words for each octave. A pair
whose start a stretch found at its lag has already covered is not extended again; each other
pair is, in both directions, word by word. Words are compared themselves, not by hashes.

Only words whose k-gram repeats in their document go on to the next octave, so text without
repetition is indexed once.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..tables import table
from .arrays import _power, mix, slices

#: A run has this many words at least, and this many periods.
LEAST, PERIODS = 6, 4
#: Words compared at once when a stretch is extended; doubled as long as all are equal.
REACH = 32


def edited_places(h: int, n: int) -> np.ndarray | None:
    """For each of ``n`` words of a document with hash ``h`` the place of the word that stands there instead, or None where nothing is edited."""
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return np.concatenate([np.arange(a), a + np.arange(n - a) % (1 + (n - a) // (3 + g % 8))])


def _agree(word: np.ndarray, i: int, lag: int, stop: int, step: int) -> int:
    """How many successive words from ``i`` on, in the direction ``step``, equal the one ``lag`` further; ``stop`` is the last place tried, and the one beyond it."""
    found, reach = 0, REACH
    while (left := (stop - i) * step) > 0:
        n = min(left, reach)
        a = i if step > 0 else i - n + 1
        differ = np.flatnonzero(word[a : a + n] != word[a + lag : a + lag + n])
        if len(differ):
            return found + (int(differ[0]) if step > 0 else n - 1 - int(differ[-1]))
        found, i, reach = found + n, i + n * step, reach * 2
    return found


def _repeated(gram: np.ndarray) -> np.ndarray:
    """Which entries occur more than once, or share their last 16 bits with one that does."""
    ordered = np.sort(gram)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    mark = np.zeros(1 << 16, dtype=bool)
    mark[again & np.uint64(0xFFFF)] = True
    return mark[gram & np.uint64(0xFFFF)]


def periodic_runs(word: np.ndarray, first: np.ndarray) -> np.ndarray:
    """All runs of documents that stand behind one another: rows of start, end (exclusive) and period, by start, then period.

    ``word`` numbers the words so that equal ones have equal numbers, ``first`` says where each
    document starts, with the end of the last one behind.
    """
    found: list[tuple[int, int, int]] = []
    sums = np.zeros(len(word) + 1, dtype=np.uint64)
    np.cumsum(mix(word) * _power(len(word), False)[: len(word)], out=sums[1:])
    inverse = _power(len(sums), True)
    size = np.diff(first)
    owner = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(word))
    for octave in range(64):
        k = max(LEAST - 1, 3 << octave)
        at = at[at + k <= first[owner[at] + 1]]
        if not len(at):
            break
        gram = mix((sums[at + k] - sums[at]) * inverse[at] ^ mix(owner[at], 1))
        several = _repeated(gram)
        at, gram = at[several], gram[several]
        order = np.argsort(gram, kind="stable")
        same = gram[order][1:] == gram[order][:-1]
        here, there = at[order[:-1][same]], at[order[1:][same]]
        at = np.unique(np.concatenate([here, there]))
        lag = there - here
        own = (lag >> octave) == 1
        here, lag = here[own], lag[own]
        order = np.lexsort((here, lag))
        here, lag = here[order], lag[order]
        # a seed right behind another of its lag is covered by what that one extends to; the table is asked for the others
        head = np.ones(len(here), dtype=bool)
        head[1:] = (lag[1:] != lag[:-1]) | (here[1:] != here[:-1] + 1)
        covered: dict[int, int] = {}
        for i, q in zip(here[head].tolist(), lag[head].tolist(), strict=True):
            if i < covered.get(q, 0):
                continue
            begin, end = int(first[owner[i]]), int(first[owner[i] + 1])
            right = i + _agree(word, i, q, end - q, 1)
            left = i - _agree(word, i - 1, q, begin - 1, -1)
            covered[q] = right
            if right + q - left >= max(LEAST, PERIODS * q):
                found.append((left, right + q, q))
    return np.array(sorted(found, key=lambda r: (r[0], r[2])), dtype=np.int64).reshape(-1, 3)


def _collapsed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame, texts in slices(frames):
        number: dict[bytes, int] = {}
        words, ids = [], []
        for text, h in zip(texts, frame["_edit"], strict=True):
            own = text.split()
            places = None if h is None or h != h else edited_places(int(h), len(own))
            if places is not None:
                own = [own[i] for i in places.tolist()]
            words.append(own)
            ids += [number.setdefault(w, len(number)) for w in own]
        first = np.concatenate([[0], np.cumsum([len(w) for w in words])])
        runs = periodic_runs(np.array(ids, dtype=np.int64), first)
        edge = np.searchsorted(runs[:, 0], first)
        out = []
        for own, a, r in zip(words, first[:-1].tolist(), np.split(runs, edge[1:-1]), strict=True):
            start, length, period = r[:, 0] - a, r[:, 1] - r[:, 0], r[:, 2]
            said = sha256("".join(f"{s},{n},{q}\n" for s, n, q in zip(start.tolist(), length.tolist(), period.tolist(), strict=True)).encode()).hexdigest()
            if not len(r):
                out.append((0, None, None, None, None, said, b" ".join(own)))
                continue
            drop = np.zeros(len(own) + 1, dtype=np.int64)
            np.add.at(drop, start + period, 1)
            np.add.at(drop, start + length, -1)
            kept = np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist()
            best = np.lexsort((period, start, -length))[0]
            out.append((len(r), int(start[best]), int(length[best]), int(period[best]), 1000 * int(length[best]) // int(period[best]), said, b" ".join([own[i] for i in kept])))
        done = pd.DataFrame(out, columns=RESULTS, index=frame.index)
        done = done.astype(dict.fromkeys(RESULTS[:5], "Int64"))
        done["collapsed"] = [x.decode("utf-8", "surrogatepass") for x in done["collapsed"]]
        yield pd.concat([frame.drop(columns=["text", "_edit"]), done], axis=1)


RESULTS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed"]


def collapse_runs(docs: DataFrame, edit: Column | None = None) -> DataFrame:
    """``docs`` without ``text``, with the number of periodic runs of its words, ``start`` (from 0), ``length``, ``period`` and ``exponent_milli`` of the longest (ties: first start, then least period), ``runs_sha256`` over all runs, and ``collapsed``: the words but for those that repeat a run's first period, joined by single spaces.

    Words are what white space ``[\\x20\\x09-\\x0D]`` parts; a null, empty or blank text has
    none, no run, and an empty ``collapsed``. ``edit``: an unsigned 32-bit number for each row,
    from which :func:`edited_places` first makes a periodic stretch; null edits nothing.
    Every row comes back, repeated rows too; columns with a result's name are replaced.
    Whole texts are read; a task holds about half a megabyte of text or one longer one.
    """
    docs = docs.drop(*RESULTS, "_edit")
    whole = T.StructType([f for f in docs.schema.fields if f.name != "text"])
    for name in RESULTS:
        whole = whole.add(name, "long" if name in RESULTS[:5] else "string")
    return docs.withColumn("_edit", F.lit(None).cast("long") if edit is None else edit).mapInPandas(_collapsed, whole)


def op11_periodic_runs(spark, sf_dir):
    """The runs of every document, a tenth of them edited to be periodic; a null ``doc_id`` edits nothing."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    runs = collapse_runs(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")))
    return runs.withColumn("collapsed_sha256", F.sha2(F.col("collapsed").cast("binary"), 256)).drop("collapsed")


def _op11_sql(octaves: int = 15) -> str:
    """Successive occurrences of k-grams by ``lead``, seeds of a lag joined to islands; k-gram names by doubling. For texts of fewer than ``2**(octaves + 2)`` words."""
    crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)), lambda a, c: list_reduce(list_prepend(xor(a, c), range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"
    ahead = lambda name, by: f"lead({name}, {by}) OVER (PARTITION BY d ORDER BY i)"
    parts = [
        rf"""doc AS (SELECT row_number() OVER () AS d, doc_id, {crc} AS h, list_filter(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda w: w <> '') AS w0 FROM documents)""",
        "cut AS (SELECT *, len(w0) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w0) > 0 THEN (h // 10) % len(w0) END AS a FROM doc)",
        "word AS (SELECT d, i, w0[CASE WHEN a IS NULL OR i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END + 1] AS w FROM (SELECT d, w0, n, g, a, unnest(range(n)) AS i FROM cut))",
        "g0 AS (SELECT d, i, hash(w) AS x FROM word)",
        f"seed0 AS (SELECT d, i, 1 AS q FROM (SELECT d, i, w, {', '.join(f'{ahead("w", m)} AS w{m}' for m in range(1, 6))} FROM word) WHERE w = w1 AND w1 = w2 AND w2 = w3 AND w3 = w4 AND w4 = w5)",
    ]
    for j in range(1, octaves):
        b = 1 << (j - 1)
        parts.append(f"g{j} AS (SELECT d, i, hash(x, y) AS x FROM (SELECT d, i, x, {ahead('x', b)} AS y FROM g{j - 1}) WHERE y IS NOT NULL)")
        parts.append(f"seed{j} AS (SELECT d, i, nxt - i AS q FROM (SELECT d, i, lead(i) OVER (PARTITION BY d, x, y, z ORDER BY i) AS nxt FROM (SELECT d, i, x, {ahead('x', b * 2)} AS y, {ahead('x', b * 4)} AS z FROM g{j}) WHERE y IS NOT NULL AND z IS NOT NULL) WHERE nxt - i BETWEEN {1 << j} AND {(2 << j) - 1})")
    parts += [
        "seed AS (" + " UNION ALL ".join(f"SELECT d, i, q, {max(5, 3 << j)} AS k FROM seed{j}" for j in range(octaves)) + ")",
        "run AS (SELECT d, min(i) AS s, max(i) + any_value(k) + q - min(i) AS n, q FROM (SELECT *, i - row_number() OVER (PARTITION BY d, q ORDER BY i) AS island FROM seed) GROUP BY d, q, island HAVING max(i) + any_value(k) + q - min(i) >= greatest(6, 4 * q))",
        "best AS (SELECT d, count(*) AS n_runs, first(struct_pack(s, n, q) ORDER BY n DESC, s, q) AS b, string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q) AS said FROM run GROUP BY d)",
        "gone AS (SELECT DISTINCT d, unnest(range(s + q, s + n)) AS i FROM run)",
        "kept AS (SELECT d, string_agg(w, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (d, i) GROUP BY d)",
    ]
    return f"""WITH {", ".join(parts)}
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, b.s::BIGINT AS start, b.n::BIGINT AS length, b.q::BIGINT AS period, (b.n * 1000 // b.q)::BIGINT AS exponent_milli, sha256(coalesce(said, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM doc LEFT JOIN best USING (d) LEFT JOIN kept USING (d)"""


OP11_SQL = _op11_sql()
