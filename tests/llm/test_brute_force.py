"""Queries that SQL can't express, against plain Python on whole small tables."""

import hashlib
import heapq
import random
import re

import corpus_pipeline
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pricelens.llm import arrays, decontamination, fingerprints, jaccard_join, language_id, mixing, token_counts, toxicity
from tests.llm.test_cases import brute_components, brute_repeats, prose

M = 2**64


def mixed(x, seed=0):
    x = (x + seed * 0xD1B54A32D192ED03 + 0x9E3779B97F4A7C15) % M
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % M
    x = (x ^ x >> 27) * 0x94D049BB133111EB % M
    return x ^ x >> 31


GEAR = [int(g) for g in fingerprints._GEAR]
POINTS = [int(g) for g in arrays._G]


def brute_fingerprint(data):
    """Chunk by chunk: the gear hash of the last 32 bytes of the text so far, tested byte by byte."""
    found, at = set(), 0
    padded = b"\0" * 32 + data
    while at < len(data):
        cut = min(at + fingerprints.MOST, len(data))
        for end in range(at + fingerprints.LEAST, cut):
            gear = sum(GEAR[b] << k for k, b in enumerate(reversed(padded[end : end + 32]))) % 2**32
            bits = fingerprints.STRICT_BITS if end < at + fingerprints.NORMAL else fingerprints.LOOSE_BITS
            if gear >> (32 - bits) == 0:
                cut = end
                break
        value = sum(POINTS[b] * pow(0x9E3779B97F4A7C15, i, M) for i, b in enumerate(data[at:cut])) % M
        found.add((mixed(value) & ~0xFFFF) | (cut - at))
        at = cut
    return found


def alike(a, b):
    size = lambda s: sum(x & 0xFFFF for x in s)
    return size(a & b) / min(size(a), size(b)) if a and b else float(len(a) == len(b))


def test_fingerprints(spark, sf):
    docs = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 4000 or text is null").collect()), reverse=True)
    got = {r.doc_id: r for r in fingerprints.compare_edited(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert len(got) == len(docs) > 100
    pick = random.Random(1)
    for i in pick.sample(range(len(docs)), 40):
        (key, text), (_, after) = docs[i], docs[(i + 1) % len(docs)]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, changed, other = (brute_fingerprint(t.encode()) for t in (text, edited, after))
        r = got[key]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert set(map(int, fingerprints.decoded(r.fingerprint))) == own and set(map(int, fingerprints.decoded(r.edited_fingerprint))) == changed
        assert r.near_edited == pytest.approx(alike(own, changed)) and r.near_next == pytest.approx(alike(own, other))


def test_language_id(spark, sf):
    """Exact sets of n-grams in place of filters give the same languages, and nearly the same scores."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2).alias("held")).collect()

    def grams(text):
        run = " " + " ".join("".join(c if c.isalpha() else " " for c in (text or "").lower()).split()) + " "
        return [run[i : i + 4] for i in range(len(run) - 3)] if len(run) > 2 else []

    uses = {}
    for r in docs:
        if not r.held and r.lang is not None:
            for g in grams(r.text):
                uses.setdefault(r.lang, {})[g] = uses.setdefault(r.lang, {}).get(g, 0) + 1
    known = {n: {g for g, k in u.items() if k >= language_id.LEAST_USES} for n, u in uses.items()}
    got = {r.doc_id: r for r in language_id.op2_language_id(spark, sf).collect()}
    assert len(got) == len(docs) and {r.held_out for r in got.values()} == {True, False}
    for r in docs:
        own = grams(r.text)
        share = {n: sum(g in s for g in own) / len(own) for n, s in sorted(known.items())} if own else {}
        best = max(share, key=share.get, default="und")
        assert got[r.doc_id].lang_pred == best and got[r.doc_id].score == pytest.approx(share.get(best, 0), abs=0.02)


def test_more_languages_than_a_word_has_bits(spark):
    pick = random.Random(2)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 20 * 140)]
    words = lambda i: " ".join("".join(pick.choice(letters[20 * i : 20 * i + 20]) for _ in range(4)) for _ in range(400))
    rows = [(i * 2 + k, words(i), f"l{i:03}") for i in range(140) for k in range(2)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.predict(frame, language_id.train(frame)).toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.99


def test_mixing(spark, sf):
    """A simulation of all slots, one by one, block after block."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source")
    got = {r.doc_id: (r.block, r.slot, r.seat, r.on_target) for r in mixing.mix_sources(docs).collect()}
    rows = docs.withColumns({"h": F.xxhash64(F.col("doc_id").cast("string")), "r": F.xxhash64("doc_id", "source")}).collect()
    by = {}
    for r in sorted(rows, key=lambda r: ((b := 0), r.h, r.r)):
        by.setdefault(r.source, []).append(r)
    buckets = max(1, -(-max(map(len, by.values())) // mixing.BUCKET_ROWS))
    parts = mixing.units({f"={s}": len(x) ** 0.5 for s, x in by.items()}, max(mixing.ROUND, 4 * len(by)))
    slots = sum(parts.values())
    blocks = {}
    for s, own in by.items():
        own.sort(key=lambda r: (r.h % buckets, r.h, r.r))
        for i, r in enumerate(own):
            blocks.setdefault((s, i // 16), []).append((r.doc_id, i % 16))
    last = {s: -(-len(x) // 16) for s, x in by.items()}
    horizon, done, slot, empty = max(-(-n * slots // parts[f"={s}"]) for s, n in last.items()) + slots, dict.fromkeys(by, 0), 0, None
    want = {}
    while slot < horizon and len(want) < len(rows):
        ready = [(-(-(j + 1) * slots // parts[f"={s}"]), f"={s}", s, j) for s, j in done.items() if j * slots // parts[f"={s}"] <= slot]
        _, _, s, j = min(ready)
        if (s, j) in blocks:
            for d, seat in blocks[s, j]:
                want[d] = (j, slot, seat)
        elif empty is None:
            empty = slot
        done[s] += 1
        slot += 1
    assert {d: x[:3] for d, x in got.items()} == want
    assert all(x[3] == (empty is None or x[1] < empty) for x in got.values())
    assert heapq.nsmallest(1, want.values())


def test_toxicity_held_out_beats_a_constant(spark):
    """A model that calls everything clean catches nothing; one that calls everything toxic leaves nothing alone."""
    sf = "/root/testdata/sf0.1"
    got = toxicity.op9_toxicity(spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    held = got[got["held_out"]]
    bad, good = held[held["toxic"] == 1], held[held["toxic"] == 0]
    assert len(bad) > 60 and len(good) > 500
    assert (bad["predicted"] == 1).mean() > 0.85 and (good["predicted"] == 0).mean() > 0.97
    assert (bad["score"] > good["score"].quantile(0.9)).mean() > 0.9


def test_toxicity_of_repeated_keys_and_long_texts(spark):
    """A key with very many rows doesn't fill the sample, a text beyond its bound isn't read for it, and equal sentences tie to the first."""
    rows = [(i, f"you vile creep number{i % 7} " + prose(i, 20) if i % 3 == 0 else prose(i, 24)) for i in range(150)]
    rows += [(0, "you vile creep")] * 300 + [(500, ("vile creep. " + prose(9, 30) + ". ") * 2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(150)] + [(500, 1)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, labels)).toPandas()
    assert len(got) == len(rows) and (got[got["doc_id"] % 3 == 0]["score"] > 0.5).mean() > 0.95
    long = got[got["doc_id"] == 500].iloc[0]
    assert long["worst_sentence"] == "vile creep" and long["n_sentences"] == 4000


def test_token_counts_of_new_words_in_any_order(monkeypatch):
    loaded = token_counts.load_vocabulary(token_counts.VOCABULARY)
    words = [f"▁{a}{b}{c}" for a in ("the", "Straße", "x9", "ing") for b in ("ing", "", "ß", "\U0001f600") for c in ("", "s", "ation", "x" * 1_200)]
    trie = token_counts.Trie(*loaded)
    want = {word: token_counts.Trie(*loaded).insert(word) for word in words}
    for order in (words, sorted(words), sorted(words, reverse=True)):
        assert [trie.insert(word) for word in order] == [want[word] for word in order]
        trie.clear()
    list(map(trie.insert, words))
    assert len({step & 0xFFFFF for step in trie.child}) > len(trie.child) // 2  # else every step of a walk collides with many
    texts = [" ".join(word[1:] for word in words[i::3]) for i in range(3)] + [None, ""]
    for few in (1, 10**6):
        monkeypatch.setattr(token_counts, "WAITING", few)
        got = next(token_counts._count(iter([pd.DataFrame({"text": texts})]), token_counts.VOCABULARY, "text"))
        assert got["n_tokens"].tolist() == [sum(want[word] for word in words[i::3]) for i in range(3)] + [0, 0]


def test_token_counts_of_long_words():
    pieces, unknown = token_counts.load_vocabulary(token_counts.VOCABULARY)
    trie = token_counts.Trie(pieces, unknown)
    pick = random.Random(4)
    word = "▁" + "".join(pick.choice(["the", "station", "é", "東", "x", "ing", "un"]) for _ in range(400))
    assert len(word) > token_counts.LONG
    count = trie._rolled(word)
    assert len(trie.score) == 1 and trie.insert(word) == count
    trie_count = token_counts.Trie(pieces, unknown)
    token_counts.LONG, kept = 10**9, token_counts.LONG
    try:
        assert trie_count.insert(word) == count
    finally:
        token_counts.LONG = kept


def test_decontamination_of_a_very_long_text(spark):
    item = "In 1995 Maria Lopez drove a car for 120 km from the old harbour to the small station and back again in 3 hours"
    other = item.replace("1995", "2004").replace("120", "75").replace("Maria Lopez", "Anna")
    rows = spark.createDataFrame([(1, prose(1, 120_000) + " " + other + " " + prose(2, 80_000)), (2, prose(3, 200_000))], "doc_id long, text string")
    got = {r.doc_id: r.item_ids for r in decontamination.decontaminate(rows, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {1: "1", 2: ""}


def test_jaccard_blocks_of_a_hub(spark, monkeypatch):
    """Small blocks: outsiders meet every block of their group, and no link between them is lost."""
    monkeypatch.setattr(jaccard_join, "GROUP", 4)
    monkeypatch.setattr(jaccard_join, "BLOCK_TOKENS", 300)
    monkeypatch.setattr(jaccard_join, "FREQUENT", 6)
    pick, rows = random.Random(8), []
    for cluster in range(2):
        base = prose(cluster, 50).split()
        for i in range(60):
            words = list(base)
            for _ in range(pick.randrange(1, 5)):
                words[pick.randrange(len(words))] = f"e{pick.randrange(12)}"
            rows.append((len(rows), " ".join(words)))
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).toPandas().set_index("doc_id")
    assert [(int(got.loc[k, "n_shingles"]), int(got.loc[k, "component_id"])) for k, _ in rows] == brute_components(rows)


def test_pipeline_stage_by_stage(spark, sf):
    """Each stage's rows on the stage's own input: near copies by all pairs, repeats by all windows, leaks by the operator's SQL's own rule of whole items."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 6000 or text is null")
    stages = dict(corpus_pipeline.STAGES)
    clean = corpus_pipeline.checkpointed(stages["toxicity"](spark, docs, sf))
    model = toxicity.train(docs.select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"))
    kept = {r.doc_id for r in toxicity.score(docs, model).where(F.col("score") < corpus_pipeline.TOXIC).collect()}
    assert {r.doc_id for r in clean.collect()} == kept

    rows = [(r.doc_id, r.text) for r in clean.collect()]
    single = corpus_pipeline.checkpointed(stages["n-gram Jaccard join"](spark, clean, sf))
    want = {k for (k, t), (n, c) in zip(rows, brute_components(rows), strict=True) if c == k or n == 0}
    assert {r.doc_id for r in single.collect()} == want

    rows = sorted((r.doc_id, r.text) for r in single.collect())
    cut = corpus_pipeline.checkpointed(stages["suffix-array dedup"](spark, single, sf))
    got = {r.doc_id: r for r in cut.collect()}
    sizes = {k: n - gone for (k, _), (n, gone, *_) in zip(rows, brute_repeats([t for _, t in rows], 200), strict=True)}
    for k, t in rows:
        size = len((got[k].text or "").encode())
        assert sizes[k] - 6 * 4 * 20 <= size <= sizes[k] and got[k].n_chars == len(got[k].text or "")

    left = stages["benchmark decontamination"](spark, cut, sf)
    items = {re.sub(r"\s+", " ", r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    holds = {k for k, r in got.items() if any(i in re.sub(r"\s+", " ", r.text or "") for i in items)}
    remaining = {r.doc_id for r in left.collect()}
    assert holds.isdisjoint(remaining) and remaining <= set(got)


def word_value(data):
    return mixed(sum(POINTS[b] * pow(0x9E3779B97F4A7C15, i, M) for i, b in enumerate(data)) % M)


def brute_toxicity(text, model):
    """Sentence by sentence: 1 - (1 - leak) * prod(1 - P(sentence)), words and their beginnings as features."""
    import math

    known = dict(zip(model.features.tolist(), model.weights.tolist()))
    clean, seen, offending, worst = 1.0, 0, 0, (-math.inf, None)
    for sentence in re.split(rb"[\n\r.!?]", (text or "").lower().encode()):
        words = re.findall(rb"[0-9A-Za-z\x80-\xff]+", sentence)
        if not words:
            continue
        found = {word_value(w) for w in words} | {mixed(word_value(w[:k]), k) for w in words for k in toxicity.BEGINNINGS if len(w) > k}
        z = model.constant + sum(known.get(f, 0.0) for f in found)
        clean *= 1 - 1 / (1 + math.exp(-z))
        seen, offending, worst = seen + 1, offending + (z >= 0), max(worst, (z, sentence), key=lambda x: x[0])
    leak = 1 / (1 + math.exp(-model.leak)) if seen else 0.0
    return 1 - clean * (1 - leak), seen, offending, worst[1]


def test_toxicity_scores(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    odd = [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "... !\n?"), (10**6 + 3, "Word. Word! other"), (10**6 + 4, "ÜBER straße " * 400)]
    docs = docs.union(spark.createDataFrame(odd, "doc_id long, text string"))
    pick = random.Random(4)
    vocabulary = sorted({w for r in docs.collect() for w in re.findall(r"[a-z]{3,}", (r["text"] or "").lower())})
    words = [w.encode() for w in pick.sample(vocabulary, 150)]
    features = sorted({word_value(w) for w in words} | {mixed(word_value(w[:4]), 4) for w in words if len(w) > 4})
    model = toxicity.Model(arrays.np.array(features, dtype=arrays.np.uint64), arrays.np.array([pick.uniform(-2, 3) for _ in features]), -4.0, -3.0)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    for r in docs.collect():
        p, seen, offending, _ = brute_toxicity(r["text"], model)
        g = got[r["doc_id"]]
        assert abs(g["score"] - p) < 1e-9 and (g["n_sentences"], g["n_offending"]) == (seen, offending)


def test_toxicity_learns_from_whole_long_documents(spark):
    pick = random.Random(8)
    rows = [(i, prose(i, 40) + (". " + " ".join(pick.choice(["vilest", "rotten", "scum"]) for _ in range(3)) if i % 3 == 0 else "")) for i in range(150)]
    long = [(1000 + i, ". ".join(prose(5000 + i * 9 + j, 300) for j in range(60)) + (". vilest rotten scum" if i % 2 else "")) for i in range(6)]
    texts = spark.createDataFrame(rows + long, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int("scum" in t or "vilest" in t or "rotten" in t)) for i, t in rows + long] + [(10**7 + i, 1) for i in range(50)], "doc_id long, toxic int")
    model = toxicity.train(texts, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(texts, model).collect()}
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    assert all((s >= 0.5) == (truth[i] == 1) for i, s in got.items())
