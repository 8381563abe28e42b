"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pricelens.llm import decontamination, fingerprints, jaccard_join, language_id, lm_scores, mixing, suffix_dedup, token_counts, toxicity, url_rules

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(400)]


def prose(seed, n):
    pick = random.Random(seed)
    return " ".join(pick.choice(WORDS) for _ in range(n))


LONG = prose(1, 30_000)
ROWS = [
    (1, None, "en", "a", 0), (2, "", "en", None, 0), (3, " \n\t ", None, "a", 3), (4, "Only two", "en", "a", 8), (None, prose(2, 60), "en", "a", None),
    (6, LONG, "en", "b", len(LONG)), (7, prose(3, 80), "en", "a", 1), (7, prose(3, 80), "en", "a", 1), (8, prose(3, 80), "en", "a", 1), (9, "a" * 900, "de", "b", 900),
    (10, "Ünïcode ß — 東京 " * 30, "de", "b", 1), (11, prose(3, 79) + " other", None, None, None), (12, "123 456 ... !", "en", "a", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def ids(frame):
    return sorted(frame["doc_id"].fillna(-1).astype(int))


ALL = sorted(-1 if r[0] is None else r[0] for r in ROWS)


def test_fingerprints(spark, docs, none):
    assert fingerprints.compare_edited(none).count() == 0
    got = fingerprints.compare_edited(docs).toPandas()
    assert ids(got) == ALL
    order = sorted(ROWS, key=lambda r: -(2**63) if r[0] is None else r[0], reverse=True)
    texts = {r[0]: r[1] or "" for r in order}
    after = {6: 4, 9: 8, 12: 11, None: 12, 1: None}
    for k, n in after.items():
        row = got[got["doc_id"].isna()].iloc[0] if k is None else got[got["doc_id"] == k].iloc[0]
        half = len(texts[k]) // 2
        edited = (texts[k][: len(texts[k]) - half] + texts[n][:half]).encode()
        assert row["edited_sha256"] == hashlib.sha256(edited).hexdigest() and row["n_chars"] == len(texts[k])
        own, other = fingerprints.digest_sets([texts[k].encode(), edited])
        assert row["fingerprint"] == fingerprints.encoded(own) and row["near_edited"] == fingerprints.likeness(own, other)
    assert got[got["doc_id"] == 1]["fingerprint"].iloc[0] == ""
    one = fingerprints.compare_edited(docs.where("doc_id = 4")).toPandas()
    assert len(one) == 1 and one["near_next"].iloc[0] == 1
    plain = fingerprints.fingerprint(docs.withColumn("fingerprint", F.lit(1))).toPandas()
    assert ids(plain) == ALL and plain[plain["doc_id"] == 7]["fingerprint"].nunique() == 1


def test_fingerprints_resist_shifts():
    text = LONG.encode()
    whole, shifted, other = fingerprints.digest_sets([text, b"some words first " + text, prose(99, 30_000).encode()])
    assert fingerprints.likeness(whole, shifted) > 0.99 and fingerprints.likeness(whole, other) < 0.01
    assert (fingerprints.decoded(fingerprints.encoded(whole)) == whole).all()
    sizes = whole & fingerprints.np.uint64(0xFFFF)
    assert sizes.max() <= fingerprints.MOST and sorted(sizes)[1] >= fingerprints.LEAST


def test_fingerprint_chunks_cover_the_text():
    texts = [b"", b"ab", LONG.encode()[:5000], b"x" * 1000]
    data, start, end = fingerprints.joined(texts, b"\0" * fingerprints.WINDOW)
    text, first, last = fingerprints._boundaries(data, start, end)
    for i, t in enumerate(texts):
        assert b"".join(data[a:b].tobytes() for a, b in zip(first[text == i], last[text == i])) == t


def test_language_id(spark, docs, none):
    model = language_id.train(docs.select("doc_id", "text", "lang"))
    got = language_id.predict(docs.select("doc_id", "text", F.lit("x").alias("score")), model).toPandas()
    assert ids(got) == ALL
    known = dict(zip(got["doc_id"], got["lang_pred"]))
    assert known[1] == known[2] == known[3] == known[12] == "und" and known[6] == "en" and known[10] == "de"
    assert got["score"].between(0, 1).all()
    empty = language_id.train(none)
    assert set(language_id.predict(docs.select("doc_id", "text"), empty).toPandas()["lang_pred"]) == {"und"}
    assert language_id.predict(none.select("doc_id", "text"), model).count() == 0


def test_language_id_held_out(spark, sf):
    got = language_id.op2_language_id(spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").toPandas(), on="doc_id")
    held = got[got["held_out"]]
    assert len(held) > 20 and (held["lang"] == held["lang_pred"]).mean() > 0.97


def brute_components(docs):
    """Union-find over all pairs."""
    import re

    sets = []
    for _, text in docs:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = [w for w in re.split("[\x20\x09-\x0d]+", lower) if w]
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(docs):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return [(len(s), least.get(find(i))) for i, s in enumerate(sets)]


@pytest.mark.parametrize("group", [3, 16])
def test_jaccard_join_equals_all_pairs(spark, monkeypatch, group):
    """Small groups force hubs, distance bands and later links."""
    monkeypatch.setattr(jaccard_join, "GROUP", group)
    pick, rows = random.Random(5), []
    for cluster in range(6):
        base = prose(cluster, 60).split()
        for _ in range(14):
            words = list(base)
            for _ in range(pick.randrange(0, 6)):
                words[pick.randrange(len(words))] = f"e{pick.random()}"
            rows.append((len(rows) * 3 + 5, " ".join(words)))
    shared = prose(77, 12)
    rows += [(1000 + i, shared + " " + prose(100 + i, 30)) for i in range(20)]
    rows += [(2000 + i, t) for i, t in enumerate([None, "", "a b", "A  b\n", "a b c d e", "x y z", " "])]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).toPandas().set_index("doc_id")
    want = brute_components(rows)
    assert [(int(got.loc[k, "n_shingles"]), int(got.loc[k, "component_id"])) for k, _ in rows] == want


def test_jaccard_join_cases(spark, docs, none):
    assert jaccard_join.jaccard_components(none).count() == 0
    got = jaccard_join.jaccard_components(docs.withColumn("sig", F.lit(1)).withColumn("c", F.lit("x"))).toPandas()
    assert ids(got) == ALL and set(got["c"]) == {"x"}
    found = dict(zip(got["doc_id"], got["component_id"]))
    assert found[8] == found[7] == found[11] == 7 and found[1] == 1 and found[2] == 2
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert ids(kept.toPandas()) == [-1, 1, 2, 3, 4, 6, 7, 9, 10, 12]
    assert jaccard_join.keep_one(none).count() == 0


def test_decontamination(spark, docs, none):
    item = "In 1995 Maria Lopez drove a car for 120 km from the old harbour to the small station and back again in 3 hours"
    other = "In 2011 Peter Smith drove a car for 75 km from the old harbour to the small station and back again in 9 hours"
    mixed = item.replace("Maria", "Anna") + " " + "and then for 3 hours " + prose(4, 20)
    benchmark = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "short one here"), (5, item)], "item_id long, text string")
    rows = spark.createDataFrame([(1, prose(5, 40) + " " + item + " " + prose(6, 40)), (2, other), (3, None), (4, ""), (5, prose(7, 300)), (6, mixed), (7, "a short one here"), (7, "a short one here"), (None, item)], "doc_id long, text string").withColumn("n_items", F.lit("clash"))
    got = decontamination.decontaminate(rows, benchmark).toPandas()
    hit = {(-1 if k != k or k is None else int(k)): v for k, v in zip(got["doc_id"], got["item_ids"])}
    assert hit == {1: "1", 2: "1", 3: "", 4: "", 5: "", 6: "1", 7: "4", -1: "1"} and len(got) == 9
    assert decontamination.decontaminate(docs, benchmark.limit(0)).where("contaminated").count() == 0
    assert decontamination.decontaminate(none, benchmark).count() == 0


def test_decontamination_needs_consistent_slots(spark):
    item = "the train leaves at 7 and the bus leaves at 7 and they meet at 7 near the bridge"
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = spark.createDataFrame([(1, item.replace("7", "9")), (2, "the train leaves at 4 and the bus leaves at 5 and they meet at 6 near the bridge")], "doc_id long, text string")
    got = {r["doc_id"]: r["contaminated"] for r in decontamination.decontaminate(rows, benchmark).collect()}
    assert got == {1: True, 2: False}


def test_decontamination_takes_copies_with_an_edited_slot(spark):
    item = "The boat leaves the harbour before noon. The captain counts all crates on the deck. The wind is calm today and the sea is flat."
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    digits = "at 7 the boat leaves the old harbour and at 7 the captain counts all crates on the deck and at 7 the crew sleeps"
    both = benchmark.union(spark.createDataFrame([(2, digits)], benchmark.schema))
    rows = spark.createDataFrame([(1, item.replace("The captain", "A captain")), (2, digits.replace("at 7 the crew", "at 8 the crew")), (3, item.replace("The", "A", 1)), (4, item[item.index("counts") :])], "doc_id long, text string")
    got = {r["doc_id"]: r["item_ids"] for r in decontamination.decontaminate(rows, both).collect()}
    assert got == {1: "1", 2: "2", 3: "1", 4: "1"}


def test_decontamination_finds_items_of_few_literal_words(spark):
    items = ["What is 17 * 24 + 305?", "Solve 12 + 7 * 3 - 44 / 4 for X and Y", "THE BOAT LEAVES THE HARBOUR BEFORE NOON WITH ALL CRATES", "4 8 15 16 23 42"]
    benchmark = spark.createDataFrame(list(enumerate(items, 1)), "item_id long, text string")
    texts = [*(prose(i, 30) + " " + t + " " + prose(i + 9, 30) for i, t in enumerate(items)), items[1].replace("44", "45"), "Solve 1 + 2 * 3 for X", "4 8 15 16 23 43", "THE CAR STOPS AT A STATION BEFORE NIGHT WITH NO CRATES"]
    rows = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")
    got = {r["doc_id"]: r["item_ids"] for r in decontamination.decontaminate(rows, benchmark).collect()}
    assert got == {1: "1", 2: "2", 3: "3", 4: "4", 5: "2", 6: "", 7: "", 8: ""}


def test_decontamination_takes_names_of_another_length(spark):
    item = "Maria Lopez sold 12 boxes of red apples to Peter and then paid John Smith 5 dollars for a ride back to the market"
    other = "Anna sold 30 boxes of red apples to Mary Ann Jones and then paid Bob 7 dollars for a ride back to the market"
    parts = "we took the old road from the mill to the lake", "and saw a bird on each stone before the rain", "came down on us all at once"
    long, split = " ".join(parts), " then ".join(parts)  # 4, 3 and 0 of 21 windows, at three shifts
    benchmark = spark.createDataFrame([(1, item), (2, long)], "item_id long, text string")
    rows = spark.createDataFrame([(1, other), (2, prose(5, 30) + " " + other + " " + prose(6, 30)), (3, split), (4, prose(7, 90)), (5, "CAPITALS " * 30_000)], "doc_id long, text string")
    got = {r["doc_id"]: r["item_ids"] for r in decontamination.decontaminate(rows, benchmark).collect()}
    assert got == {1: "1", 2: "1", 3: "2", 4: "", 5: ""}


def test_lm_scores(spark, docs, none):
    assert lm_scores.backoff_scores(none).count() == 0
    got = lm_scores.backoff_scores(docs.withColumn("n_words", F.lit(0)), order=3).toPandas()
    assert ids(got) == ALL
    copies = got[got["doc_id"].isin([7, 8])]
    assert set(copies["n_backed_off"]) == {0} and copies["log_score"].round(9).nunique() == 1
    assert list(got[got["doc_id"].isin([1, 2, 3])]["n_words"]) == [0, 0, 0]


def brute_scores(texts, order):
    """``n_words``, ``n_backed_off`` and ``log_score`` of each text, from its definition."""
    docs = [(t or "").lower().split() for t in texts]
    own = [Counter(tuple(d[i : i + n]) for n in range(1, order + 1) for i in range(len(d) - n + 1)) for d in docs]
    all_, words = sum(own, Counter()), sum(map(len, docs))

    def score(d, gram):
        rest = all_[gram] - own[d][gram]
        if len(gram) == 1:
            return math.log10(max(rest, 1) / max(words - len(docs[d]), 1)), False
        context = gram[:-1]
        return (math.log10(rest / (all_[context] - own[d][context])), False) if rest else (math.log10(lm_scores.BACKOFF) + score(d, gram[1:])[0], True)

    at = [[score(d, tuple(w[max(0, i - order + 1) : i + 1])) for i in range(len(w))] for d, w in enumerate(docs)]
    return [(len(x), sum(b for _, b in x), sum(v for v, _ in x)) for x in at]


@pytest.mark.parametrize("order", [1, 3, 4])
def test_lm_scores_of_many_blocks_and_slots_equal_brute_force(spark, monkeypatch, order):
    monkeypatch.setattr(lm_scores, "BLOCK_BYTES", 2_000)
    monkeypatch.setattr(lm_scores, "SLOT_WORDS", 300, raising=False)
    texts = [prose(i % 9, 5 + 7 * i) for i in range(20)] + [None, "", " \n", "one", "One one", prose(3, 40), prose(3, 40), "alone " * 50, "common " * 400, "common common", "a b " * 700]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = lm_scores.backoff_scores(rows, order=order).toPandas().set_index("doc_id").sort_index()
    n_words, n_backed_off, log_score = zip(*brute_scores(texts, order))
    assert (list(got["n_words"]), list(got["n_backed_off"])) == (list(n_words), list(n_backed_off))
    assert list(got["log_score"]) == pytest.approx(list(log_score), abs=1e-6)


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
    out = {}
    while files.hasNext():
        file = files.next()
        if file.getName().startswith("shuffle_"):
            out[file.getPath()] = file.length()
    return out


def test_lm_scores_shuffle_less_than_four_times_their_texts(spark, monkeypatch):
    monkeypatch.setattr(lm_scores, "BLOCK_BYTES", 1 << 19)
    monkeypatch.setattr(lm_scores, "SLOT_WORDS", 1 << 16, raising=False)
    pick = random.Random(5)
    vocabulary = ["".join(pick.choices("abcdefghijklmnopqrstuvwxyz", k=pick.randint(2, 6))) for _ in range(600)]
    texts = [" ".join(pick.choices(vocabulary, k=400)) for _ in range(1000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    before = shuffle_files(spark)
    assert len(lm_scores.backoff_scores(rows).toPandas()) == 1000
    written = sum(size for path, size in shuffle_files(spark).items() if path not in before)
    assert 0 < written < 4 * sum(map(len, texts))


def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = {}
    for d, b in enumerate(data):
        for i in range(len(b) - length + 1):
            seen.setdefault(b[i : i + length], []).append((d, i))
    gone = [bytearray(len(b)) for b in data]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                gone[d][i : i + length] = b"\1" * length
    return [(len(b), sum(g), len([1 for i in range(len(g)) if g[i] and (i == 0 or not g[i - 1])]), hashlib.sha256(bytes(c for c, x in zip(b, g) if not x)).hexdigest()) for b, g in zip(data, gone)]


@pytest.mark.parametrize("hot, piece", [(20_000, 4 << 20), (1, 700)])
def test_suffix_dedup_equals_brute_force(spark, monkeypatch, hot, piece):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    passage = prose(11, 70)
    texts = [prose(i, 100) + " " + passage[i : i + 260] + " " + prose(i + 50, 60) for i in range(12)]
    texts += [None, "", "short", "z" * 450, "ab" * 300, prose(3, 90), prose(3, 90), passage[:199], "é" * 150, prose(20, 300), "x" + prose(20, 300)[5:900], passage[:250] + "é" + passage[30:300]]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = suffix_dedup.remove_repeats(rows).toPandas().set_index("doc_id").sort_index()
    want = brute_repeats(texts, 200)
    assert list(zip(got["n_bytes"], got["n_removed"], got["n_spans"], got["kept_sha256"])) == want


def test_suffix_dedup_cases(docs, none):
    assert suffix_dedup.remove_repeats(none).count() == 0
    got = suffix_dedup.remove_repeats(docs.withColumns({"kept": F.lit(1), "t": F.lit("x")}).drop("t")).toPandas()
    assert ids(got) == ALL and got[got["doc_id"] == 1]["kept"].isna().all() and set(got[got["doc_id"] == 7]["kept"]) == {""}


def test_difference_cover_is_one():
    cover = set(suffix_dedup.COVER)
    assert {(a - b) % suffix_dedup.MODULUS for a in cover for b in cover} == set(range(suffix_dedup.MODULUS))


def test_mixing_stays_within_one_block():
    parts = mixing.units({"a": 5, "b": 3, "c": 1.5, "d": 0.001}, 1000)
    assert sum(parts.values()) == 1000 and min(parts.values()) >= 1
    done = dict.fromkeys(parts, 0)
    for t, (s, j, slot) in enumerate(mixing.round_schedule(parts)):
        assert t == slot and j == done[s] and j * 1000 // parts[s] <= slot < -(-(j + 1) * 1000 // parts[s])
        done[s] += 1
        assert all(abs(done[x] - parts[x] * (t + 1) / 1000) < 1 for x in parts)
    assert done == parts


def test_mixing(spark, docs, none):
    assert mixing.mix_sources(none).count() == 0
    got = mixing.mix_sources(docs.withColumns({"slot": F.lit("x"), "_s": F.lit(1)}).drop("_s"), block_rows=2).toPandas()
    assert ids(got) == ALL and not got[["slot", "seat"]].duplicated().any()
    big = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, "mid").otherwise("rest").alias("source"))
    mixed = mixing.mix_sources(big, {"hot": 1, "mid": 1, "rest": 2}, block_rows=4).toPandas()
    assert len(mixed) == 4000 and not mixed[["slot", "seat"]].duplicated().any() and set(mixed.groupby(["source", "block"]).size()) <= {1, 2, 3, 4}
    front = mixed[mixed["on_target"]].drop_duplicates(["slot"]).sort_values("slot")
    assert list(front["slot"]) == list(range(len(front)))
    for s, w in (("hot", 0.25), ("mid", 0.25), ("rest", 0.5)):
        assert ((front["source"] == s).cumsum().to_numpy() - w * (front["slot"].to_numpy() + 1)).__abs__().max() < 1.5


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://", "https://A.Example.COM/en/7x?q#f", "https://example.com/en/8", "http://com/en/", "http://notcom/en/1", "http://x.net/de/", "http://example.net/de/85", "ftp://u@example.org:80/es/", "http://example.org/es/#", "http://a://com/en/", "http://example.net/de/8", "http://example.net/de/8"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    rules = spark.createDataFrame([*url_rules.RULES, (None, "a", "/"), ("allow", "net", None)], "action string, host string, path string")
    got = url_rules.judge_urls(pages, rules).toPandas().sort_values("page_id")

    def judge(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = rest.split("/")[0].split("?")[0].split("#")[0]
        path = rest[len(host) :].split("?")[0].split("#")[0]
        host = host.lower()
        fit = [(len(h + p), h + p, a) for a, h, p in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=(0, None, "allow"))
        return host, path, best[1], best[2]

    assert [(h, p, r if r == r else None, v) for h, p, r, v in zip(got["host"], got["path"], got["rule"], got["verdict"])] == [judge(u) for u in urls]
    assert set(url_rules.judge_urls(pages, rules.limit(0)).toPandas()["verdict"]) == {"allow"}
    assert url_rules.judge_urls(pages.limit(0), rules).count() == 0


def test_toxicity(spark, docs, none):
    pick = random.Random(3)
    rows, labels = [], []
    for i in range(300):
        bad = i % 5 == 0
        text = prose(i, 40) + ". " + ("You vile creep " + prose(i, 3) if bad else prose(i + 900, 6)) + ". " + prose(i + 500, 30)
        rows.append((i, text))
        labels.append((i, int(bad)) if pick.random() < 0.9 else (i, None))
    train = spark.createDataFrame(rows, "doc_id long, text string")
    weights = toxicity.train(train, spark.createDataFrame([*labels, (None, 1), (5, 1)], "doc_id long, toxic int"))
    got = toxicity.score(train, weights).toPandas()
    assert ((got["score"] >= 0.5) == (got["doc_id"] % 5 == 0)).mean() > 0.98
    assert got[got["score"] >= 0.5]["worst_sentence"].str.startswith("You vile creep").mean() > 0.9
    cases = toxicity.score(docs.withColumn("score", F.lit("x")), weights).toPandas()
    assert ids(cases) == ALL and (cases[cases["doc_id"].isin([1, 2, 3])]["score"] == 0).all()
    assert toxicity.score(none, weights).count() == 0
    nothing = toxicity.train(none, spark.createDataFrame([], "doc_id long, toxic int"))
    assert (toxicity.score(docs, nothing).toPandas()["score"] < 1).all()


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = toxicity.op9_toxicity(spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    held = got[got["held_out"]]
    assert len(held) > 40 and ((held["toxic"] == held["predicted"]).mean() > 0.88) and not ((held["predicted"] == 1) & (held["toxic"] == 0)).any()


def test_toxicity_chooses_its_sample_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(frames):
        for frame in frames:
            read.add(len(frame))
            yield frame

    texts = spark.createDataFrame([(i, f"{prose(i, 20)} {'vile ' * (i % 2)}") for i in range(60)], "doc_id long, text string")
    toxicity.train(texts.mapInPandas(counted, texts.schema), spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int"))
    assert read.value <= 60 * 3  # before: 360


def test_token_counts(spark, docs, none):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    assert token_counts.count_tokens(none).count() == 0
    got = token_counts.count_tokens(docs.withColumn("n_tokens", F.lit("x"))).toPandas()
    assert ids(got) == ALL and list(got[got["doc_id"].isin([1, 2])]["n_tokens"]) == [0, 0]
    pieces, unknown = token_counts.load_vocabulary(token_counts.VOCABULARY)

    def brute(word):
        best = {0: (0.0, 0)}
        for end in range(1, len(word) + 1):
            choices = [(best[s][0] + pieces[word[s:end]], best[s][1] + 1) for s in range(end) if word[s:end] in pieces]
            if word[end - 1] not in pieces:
                choices.append((best[end - 1][0] + unknown, best[end - 1][1] + len(word[end - 1].encode())))
            best[end] = next(c for c in choices if c[0] == max(x[0] for x in choices))
        return best[len(word)][1]

    for r in ROWS:
        if r[1] and len(r[1]) < 3000:
            want = sum(brute(w) for w in token_counts.pretokens(r[1]))
            assert set(got[got["doc_id"].isna()]["n_tokens"] if r[0] is None else got[got["doc_id"] == r[0]]["n_tokens"]) == {want}
    model = sentencepiece_model_pb2.ModelProto()
    with open(token_counts.VOCABULARY, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    trie = token_counts.Trie(pieces, unknown, nodes=50)
    for word in sorted(set("the harbour station unbelievable tokenisation of Zusammenhang queremos".split())):
        best = library.nbest_encode_as_pieces(word, 3)[0]
        assert trie.insert("▁" + word) == len(best)


def test_hash_slices_agree():
    """Word hashes don't depend on what stands around the word."""
    from pricelens.llm.arrays import word_hashes

    a, *_ = word_hashes([b"one two", b"Three"])
    b, *_ = word_hashes([b"x y three ONE", b"", b"two"])
    assert a[0] == b[3] and a[1] == b[4] and a[2] == b[2]
