"""Periodic runs, whitening and pairwise quality against plain Python, on odd rows and on whole small tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricelens.llm import periodic_runs, quality, whitening
from tests.llm.test_cases import ALL, LONG, ROWS, SCHEMA, ids, prose


def brute_runs(w):
    """Lag by lag over all words; a stretch counts if no shorter lag explains it."""
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            z = w[s : i + q]
            if len(z) >= max(6, 4 * q) and not any(z[p:] == z[:-p] for p in range(1, q)):
                out.append((s, i + q, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def split(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def edited(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not w:
        return w
    a = h // 10 % len(w)
    p = 1 + (len(w) - a) // (3 + h // 10 % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]


def expected(w):
    runs = brute_runs(w)
    gone = {i for s, e, q in runs for i in range(s + q, e)}
    best = min(runs, key=lambda r: (r[0] - r[1], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    longest = (None,) * 4 if best is None else (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2])
    return len(runs), *longest, sha("".join(f"{s},{e - s},{q}\n" for s, e, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))


def test_runs_of_small_alphabets():
    pick = random.Random(5)
    docs = []
    for _ in range(1500):
        base = [pick.randrange(pick.choice([1, 2, 3, 5])) for _ in range(pick.randrange(60))]
        if base and pick.random() < 0.6:
            base = base[: pick.randrange(len(base))] + [pick.randrange(4) for _ in range(pick.randrange(1, 14))] * pick.randrange(2, 9) + base[:20]
        docs.append(base)
    first = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    got = periodic_runs.periodic_runs(np.array(sum(docs, []), dtype=np.int64), first)
    assert [tuple(r) for r in got.tolist()] == [(s + a, e + a, q) for d, a in zip(docs, first.tolist()) for s, e, q in brute_runs(d)]


def test_runs_on_whole_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 6000 or text is null").select("doc_id", "text")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    got = {r["doc_id"]: r for r in periodic_runs.collapse_runs(docs, F.crc32(F.col("doc_id").cast("string").cast("binary"))).collect()}
    rows = docs.collect()
    assert len(got) == len(rows) > 100 and sum(r["n_runs"] > 0 for r in got.values()) > 10
    for r in rows:
        want, g = expected(edited(r["doc_id"], split(r["text"]))), got[r["doc_id"]]
        assert (g["n_runs"], g["start"], g["length"], g["period"], g["exponent_milli"], g["runs_sha256"], hashlib.sha256(g["collapsed"].encode()).hexdigest()) == want


def test_runs_of_odd_rows(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    assert periodic_runs.collapse_runs(docs.limit(0)).count() == 0
    got = periodic_runs.collapse_runs(docs.withColumns({"start": F.lit("x"), "collapsed": F.lit(3), "_edit": F.lit(1)})).toPandas()
    assert ids(got) == ALL and "text" not in got and (got["doc_id"] == 7).sum() == 2
    assert got[got["doc_id"] == 10]["n_runs"].iloc[0] == 1 and got[got["doc_id"] == 10]["collapsed"].iloc[0] == "Ünïcode ß — 東京"
    assert got[got["doc_id"] == 6]["collapsed"].iloc[0] == LONG and set(got[got["doc_id"].isin([1, 2, 3])]["collapsed"]) == {""}
    ties = "a a a a a a b c c c c c c"
    long = "x " * 60_000 + LONG
    got = {r["doc_id"]: r for r in periodic_runs.collapse_runs(spark.createDataFrame([(1, ties), (2, long)], "doc_id long, text string")).collect()}
    assert (got[1]["n_runs"], got[1]["start"], got[1]["length"], got[1]["collapsed"]) == (2, 0, 6, "a b c")
    assert (got[2]["n_runs"], got[2]["length"], got[2]["collapsed"]) == (1, 60_000, "x " + LONG)


def plain_whitening(vectors):
    x = np.floor(64 * np.array(vectors, dtype=np.float64)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    centred = (n * x - sums) / n
    u, s, w = np.linalg.svd(centred, full_matrices=False)
    kept = s > s[0] * 1e-12
    deviation = [sum(int(n * a - b) ** 2 for a, b in zip(row, sums)) for row in x.tolist()]
    return u[:, kept] * np.sqrt(n), (s**2 / (s**2).sum())[kept], deviation


def compare_whitening(frame, vectors, most=32, gap=1e-6):
    whole, explained, deviation = plain_whitening(vectors)
    m = min(most, whole.shape[1])
    frame = frame.sort_values(["vec_id", "component"])
    assert len(frame) == len(vectors) * m and set(frame["n"]) == {len(vectors)} and frame["identity_error"].nunique() == 1
    assert frame["identity_error"].iloc[0] < 1e-6
    got = frame["whitened"].to_numpy().reshape(len(vectors), m)
    own = frame["deviation"].to_numpy().reshape(len(vectors), m)[:, 0]
    assert [None if np.isnan(x) else int(x) for x in own] == [x if x < 2**63 else None for x in deviation]
    assert np.allclose(frame["explained"].to_numpy().reshape(len(vectors), m)[0], explained[:m], rtol=1e-6)
    assert np.abs(got.T @ got / len(vectors) - np.eye(m)).max() < 1e-6
    for k in range(m):
        near = np.abs(explained - explained[k]) < gap * explained[k]
        if near.sum() == 1:
            sign = np.sign(got[:, k] @ whole[:, k])
            assert np.abs(got[:, k] * sign - whole[:, k]).max() < 1e-5


def test_whitening_of_the_table(spark, sf):
    rows = [r for r in spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect() if r["embedding"] is not None and np.isfinite(np.array(r["embedding"], dtype=float)).all()]
    compare_whitening(whitening.op12_whitening(spark, sf).toPandas(), [r["embedding"] for r in rows])


def test_whitening_of_ill_conditioned_vectors(spark):
    pick = np.random.default_rng(3)
    scales = np.geomspace(4e3, 0.02, 12)
    vectors = (pick.normal(size=(900, 12)) * scales) @ np.linalg.qr(pick.normal(size=(12, 12)))[0]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(7)
    compare_whitening(whitening.whiten(frame).toPandas(), vectors)
    few = whitening.whiten(frame, components=3).toPandas()
    assert sorted(set(few["component"])) == [1, 2, 3]


def test_whitening_of_odd_rows(spark):
    schema = "vec_id long, embedding array<float>, component string, n int"
    pick = np.random.default_rng(4)
    good = [pick.normal(size=5).astype(np.float32).tolist() for _ in range(60)]
    good = [[v[0], v[1], v[0], 2.0, v[4]] for v in good]  # one dimension twice, one constant
    rows = [(i, v, "c", 1) for i, v in enumerate(good)] + [(100, None, "c", 1), (101, [1.0, None, 2.0, 3.0, 4.0], "c", 1), (102, [float("nan")] * 5, "c", 1), (103, [float("inf"), 1.0, 1.0, 1.0, 1.0], "c", 1), (104, [1.0, 2.0], "c", 1), (105, [], "c", 1), (106, [1e30] * 5, "c", 1)]
    frame = spark.createDataFrame(rows, schema)
    got = whitening.whiten(frame).toPandas()
    assert set(got["vec_id"]) == set(range(60)) and got["component"].max() == 3
    compare_whitening(got, good)
    twice = whitening.whiten(frame.union(frame)).toPandas()
    assert len(twice) == 2 * len(got) and set(twice["n"]) == {120}
    for none in (frame.limit(0), frame.where("vec_id >= 100 and vec_id < 104"), frame.where("vec_id = 3"), frame.where("vec_id = 105")):
        assert whitening.whiten(none).count() == 0


def test_quality_held_out(spark, sf):
    got = quality.op13_quality(spark, sf.replace("0.001", "0.01"))
    labels = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/labels.parquet")
    rows = got.join(labels, "doc_id").toPandas()
    held = rows[rows["held_out"]]
    assert len(held) > 60 and (held["predicted"] == held["quality"]).mean() > 0.93
    assert got.count() == 1000 and got.toPandas()["score"].between(0, 1).all()


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    loud = [(100 + i, (prose(i, 40) + "!! ").upper() * 2) for i in range(30)] + [(200 + i, prose(500 + i, 80)) for i in range(30)]
    labels = spark.createDataFrame([(i, int(i >= 200)) for i, _ in loud] + [(None, 1), (1, 0), (2, None), (7, 5)], "doc_id long, quality int")
    texts = spark.createDataFrame(loud, "doc_id long, text string")
    model = quality.train(texts.union(docs.select("doc_id", "text")), labels)
    got = quality.score(docs.withColumn("score", F.lit("x")), model).toPandas()
    assert ids(got) == ALL and got["score"].between(0, 1).all() and got[got["doc_id"] == 7]["score"].nunique() == 1
    own = quality.score(texts, model).toPandas()
    assert ((own["score"] >= quality.GOOD) == (own["doc_id"] >= 200)).all()
    assert quality.score(docs.limit(0), model).count() == 0
    for part, score in ((labels.where("quality = 1"), 1), (labels.where("quality = 0"), 0), (labels.limit(0), 0)):
        assert set(quality.score(texts, quality.train(texts, part)).toPandas()["score"]) == {score}


def test_quality_pairs_and_quantile():
    better, worse = quality._pairs(np.arange(50), np.arange(50, 53))
    assert set(better) == set(range(50)) and set(worse) == {50, 51, 52} and len(better) == 150
    assert quality._quantile(np.array([3.0, 1.0, 2.0, 10.0]), np.ones(4), 0.5) == 2.5
    rows = quality.features([b"", b"Ab ab\nAb ab\n", "Éa 12!".encode()])
    assert not rows[0].any()
    at = quality.NAMES.index
    assert rows[1][at("repeated_lines")] == 0.5 and rows[1][at("upper")] == 0.25 and rows[2][at("digits")] == 2 / 7 and rows[2][at("!")] == 1 / 7


def test_quality_learns_from_every_labelled_document(spark, monkeypatch):
    monkeypatch.setattr(quality, "STEPS", 2)
    monkeypatch.setattr(quality, "BLOCK", 700, raising=False)
    rows = [(i, f"{prose(i, 3 + i % 9)} {'!' * (i % 5)}{i}", int(i % 50 > 0)) for i in range(4600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.train(docs.select("doc_id", "text"), docs.select("doc_id", "quality"))
    values = quality.features([text.encode() for _, text, _ in rows])
    assert (model.steps == np.quantile(values, quality.LEVELS, axis=0, method="lower").T).all()
    few = docs.select(F.xxhash64("doc_id").alias("doc"), "quality", "text").where("quality = 1 or pmod(doc, 40) = 0")
    few = few.mapInPandas(quality._measured, "doc long, quality int, values binary")
    assert 0 < few.where("quality = 0").count() < 20 and np.isfinite(quality.fit_pairs(few).threshold)


def test_whitening_where_deviations_leave_64_bits(spark):
    rows = [(i, [float(i % 3 * 3e7), float(i)]) for i in range(300)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    assert len(got) == 600 and got["deviation"].isna().any() and got["identity_error"].max() < 1e-9
