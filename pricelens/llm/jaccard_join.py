"""N-gram Jaccard self-join with prefix filters under several global token orders.

Two sets with Jaccard similarity t or more share l tokens among the first
``n - ceil(t * n) + l`` of each, under any order of all tokens. Three orders are used:

1. A hash order says which sets can have a partner at all: those that share enough of their
   prefix tokens with other sets. Only their tokens go on.
2. Among these sets tokens are ordered by their exact number of sets, rare ones first. Tokens
   of one set need not be compared, and what is left of a prefix makes the candidates.
3. A candidate pair must also share a prefix token under the first order and under a further
   hash order, before the sets meet.

Tokens of few sets give all their pairs. For a token of many sets one of them, the hub, is
paired with all; what doesn't link to the hub is then compared with its group in packed
blocks, passing over pairs that bounds exclude or that are already connected. The result is
the components, which lose no link by that. Texts are read twice and never compared; sets
meet as arrays of those tokens that several sets have.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..tables import checkpointed, table
from .arrays import mix, slices, word_hashes
from .components import components

#: Words of a shingle, and the similarity of a link in hundredths.
WORDS, PERCENT = 5, 75
#: The hash orders: tokens are hashes, so their own order and that after an exclusive or with the second number.
FIRST_ORDER, THIRD_ORDER = 0, 0x2545F4914F6CDD1D
#: The first order's prefixes are longer by one in this many tokens, and as many must be shared.
LONGER = 16
#: Tokens with more sets in their prefix group get a hub.
GROUP = 16
#: Sets sampled for tokens that need no counting, about, and in how many of them such a token is: these come last in the second order. This spreads hot tokens and changes the work only, not the result.
SAMPLE, FREQUENT, SALTS = 2_000, 20, 4096
#: Up to this many signatures (8 bytes each) are broadcast to the texts; more are joined by shuffle.
BROADCAST_SETS = 1_000_000
#: Tokens of the sets of a packed block, about.
BLOCK_TOKENS = 100_000
_LAST = (1 << 31) - 1


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words is one shingle, one without words has none."""
    hashed, text, *_ = word_hashes(texts)
    edges = np.searchsorted(text, np.arange(len(texts) + 1))
    if len(hashed) >= WORDS:
        grams = mix(hashed[: len(hashed) - WORDS + 1])
        for k in range(1, WORDS):
            grams = mix(grams * np.uint64(31) + hashed[k : len(hashed) - WORDS + 1 + k], k)
    out = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if b - a >= WORDS:
            out.append(np.unique(grams[a : b - WORDS + 1]))
        else:
            value = np.zeros(min(1, b - a), dtype=np.uint64)
            for h in hashed[a:b]:
                value = mix(value * np.uint64(37) + h, 99)
            out.append(value)
    return out


def _signature(tokens: np.ndarray) -> int:
    """64 bits that stand for the set."""
    if not len(tokens):
        return 0
    return int(mix(np.array([mix(tokens, 7).sum(dtype=np.uint64) ^ (mix(tokens, 8).sum(dtype=np.uint64) << np.uint64(1)) ^ np.uint64(len(tokens))]), 9).view(np.int64)[0])


def _least_shared(n: int) -> int:
    """What a set of ``n`` tokens shares at least with any that it links to."""
    return -(-PERCENT * n // 100)


def _cut(tokens: np.ndarray, order: int, longer: int = 0) -> int:
    """The greatest value of the first tokens under a hash order, as a signed number."""
    value, size = tokens.view(np.int64) ^ np.int64(order), len(tokens) - _least_shared(len(tokens)) + 1 + longer
    return int(np.partition(value, size - 1)[size - 1] if size < len(value) else value.max())


def _ids(frames: Iterator[pd.DataFrame], keep_text: bool = False) -> Iterator[pd.DataFrame]:
    for frame, texts in slices(frames):
        sets = shingle_sets(texts)
        yield (frame if keep_text else frame.drop(columns=["text"])).assign(sig=[_signature(s) for s in sets], n_shingles=[len(s) for s in sets])


def _fresh(frames: Iterator[pd.DataFrame]) -> Iterator[list[tuple[int, np.ndarray, bytes]]]:
    """By slices: signature, set and text of each document whose set is not one just seen in this task."""
    seen: set[int] = set()
    for _, texts in slices(frames):
        found = []
        for s, text in zip(shingle_sets(texts), texts, strict=True):
            if len(s) and (sig := _signature(s)) not in seen:
                if len(seen) >= 200_000:
                    seen.clear()
                seen.add(sig)
                found.append((sig, s, text))
        yield found


def _first_prefixes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Prefix tokens under the first order, in 48 bits (a chance meeting lets a set pass here, no more); ``hits`` counts for the set if another one has the token too.

    A token that several sets of a slice have is known to be shared: the sets get their hits
    in the row with their own signature as the token and a least number of hits, and two rows
    let sets elsewhere know. So a hot token is two rows a slice at most.
    """
    for found in _fresh(frames):
        own = [(s[s.view(np.int64) <= _cut(s, FIRST_ORDER, len(s) // LONGER)]) >> np.uint64(16) for _, s, _ in found]
        if not own:
            continue
        tokens, which = np.concatenate(own), np.repeat(np.arange(len(own)), [len(x) for x in own])
        sig = np.array([f[0] for f in found], dtype=np.int64)
        _, first, same, times = np.unique(tokens, return_index=True, return_inverse=True, return_counts=True)
        alone = times[same] == 1
        last = np.zeros(len(first), dtype=np.int64)
        last[same] = np.arange(len(tokens))
        shared = times > 1
        parts = [(tokens[alone], which[alone], 1), (tokens[first[shared]], which[first[shared]], 0), (tokens[last[shared]], which[last[shared]], 0)]
        token, at = np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts])
        order = np.argsort(at, kind="stable")
        hits = np.repeat([p[2] for p in parts], [len(x[0]) for x in parts])
        yield pd.DataFrame({"token": token[order].astype(np.int64), "sig": sig[at[order]], "hits": hits[order].astype(np.int32), "least": np.int32(0)})
        least = [max(1, _least_shared(len(f[1])) // LONGER) for f in found]
        yield pd.DataFrame({"token": sig, "sig": sig, "hits": np.bincount(which[~alone], minlength=len(own)).astype(np.int32), "least": np.array(least, dtype=np.int32)})


def _texts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each set's size, the ends of its prefixes under the hash orders, and its text once a task, compressed."""
    import zstandard

    press = zstandard.ZstdCompressor(level=3).compress
    for found in _fresh(frames):
        rows = [(sig, len(s), _cut(s, FIRST_ORDER), _cut(s, THIRD_ORDER), press(text)) for sig, s, text in found]
        yield pd.DataFrame(rows, columns=["sig", "n", "first", "third", "data"])


def _sets(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[int, np.ndarray]]:
    import zstandard

    open_ = zstandard.ZstdDecompressor().decompress
    for frame in frames:
        for begin in range(0, len(frame), 200):
            piece = frame.iloc[begin : begin + 200]
            yield from zip(piece["sig"].tolist(), shingle_sets([open_(x) for x in piece["data"]]), strict=True)


def _frequent(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for _, tokens in _sets(frames):
        yield pd.DataFrame({"token": tokens.view(np.int64)})


def _tokens(frames: Iterator[pd.DataFrame], last) -> Iterator[pd.DataFrame]:
    """All tokens of each set; those that come last, whatever their number, with a salt."""
    held: list[pd.DataFrame] = []
    size = 0
    for sig, tokens in _sets(frames):
        place = np.minimum(np.searchsorted(last.value, tokens), len(last.value) - 1)
        often = last.value[place] == tokens if len(last.value) else np.zeros(len(tokens), dtype=bool)
        held.append(pd.DataFrame({"token": tokens.view(np.int64), "sig": sig, "salt": (often * (1 + sig % SALTS)).astype(np.int32)}))
        size += len(tokens)
        if size > 100_000:
            yield pd.concat(held)
            held, size = [], 0
    if held:
        yield pd.concat(held)


def _linked(shared: Column, n: Column, m: Column) -> Column:
    return shared * 100 >= PERCENT * (n + m - shared)


def _live(texts: DataFrame) -> DataFrame:
    """Signatures of sets that share enough prefix tokens under the first order to have a partner."""
    rows = texts.mapInPandas(_first_prefixes, "token long, sig long, hits int, least int")
    same = Window.partitionBy("token")  # one shuffle: each row learns whether its token has another set
    shared = rows.withColumn("several", F.min("sig").over(same) < F.max("sig").over(same)).where("least > 0 or (several and hits > 0)")
    return shared.groupBy("sig").agg(F.sum("hits").alias("hits"), F.max("least").alias("least")).where("hits >= least").select("sig")


def _cores(texts: DataFrame) -> DataFrame:
    """For each set that can have a partner: ``sig``, its size ``n``, its tokens that other such sets have (``core``, in the second order), how many of these are prefix tokens (``k``), and those in the prefixes of the hash orders (``first``, ``third``)."""
    spark = texts.sparkSession
    live = checkpointed(_live(texts))
    if live.count() <= BROADCAST_SETS:
        live = F.broadcast(live)
    sets = checkpointed(texts.mapInPandas(_texts, "sig long, n int, first long, third long, data binary").join(live, "sig", "left_semi").dropDuplicates(["sig"]))
    share = min(1.0, SAMPLE / max(1, sets.count()))
    sampled = sets.where(F.pmod(F.xxhash64("sig"), F.lit(1 << 20)) < int(share * (1 << 20))).select("sig", "data")
    often = sampled.mapInPandas(_frequent, "token long").groupBy("token").count().where(F.col("count") >= FREQUENT).select("token")
    last = np.sort(often.toPandas()["token"].to_numpy(dtype=np.int64).view(np.uint64))  # of a bounded sample
    rows = sets.select("sig", "data").mapInPandas(partial(_tokens, last=spark.sparkContext.broadcast(last)), "token long, sig long, salt int")
    # a token of very many sets is not counted, so its rows may be anywhere
    count = F.when(F.col("salt") > 0, F.lit(_LAST)).otherwise(F.count("*").over(Window.partitionBy("token", "salt")).cast("int"))
    counted = rows.withColumn("sets", count).where("sets > 1").select("sig", "sets", "token")
    own = counted.repartition("sig").groupBy("sig").agg(F.array_sort(F.collect_list(F.struct("sets", "token"))).alias("own"))  # one set's own tokens
    own = own.join(sets.drop("data"), "sig")
    least = F.ceil(F.col("n") * PERCENT / 100)
    own = own.where(F.size("own") >= least).withColumn("k", (F.size("own") - least + 1).cast("int")).withColumn("core", F.col("own.token"))  # the tokens of one set come before
    below = lambda order, end: F.filter("core", lambda x: x.bitwiseXOR(F.lit(order)) <= F.col(end)).alias(end)
    return checkpointed(own.select("sig", "n", "core", "k", below(FIRST_ORDER, "first"), below(THIRD_ORDER, "third")))


def _with(pairs: DataFrame, cores: DataFrame, columns: list[str]) -> DataFrame:
    """Columns of both sides' sets next to the pairs ``a``, ``b``, with ``_a`` and ``_b`` in their names."""
    for side in ("a", "b"):
        pairs = pairs.join(cores.select(F.col("sig").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in columns)), side)
    return pairs


def _compared(pairs: DataFrame, cores: DataFrame) -> DataFrame:
    """What the sets of the pairs share, for those that share prefix tokens under the other orders too."""
    both = _with(pairs, cores, ["first", "third"]).where(F.arrays_overlap("first_a", "first_b") & F.arrays_overlap("third_a", "third_b")).select("a", "b")
    met = _with(both, cores, ["n", "core"])
    return met.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("core_a", "core_b")).alias("shared"))


def _between(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links between the sets of two packed blocks that are not connected yet."""
    for frame in frames:
        for row in frame.itertuples(index=False):
            left, right = row.left, row.right
            tokens, place = np.unique(np.concatenate([np.asarray(x["core"], dtype=np.int64) for x in (*left, *right)]), return_inverse=True)
            size = np.array([len(x["core"]) for x in (*left, *right)])
            start = np.concatenate([[0], np.cumsum(size)[:-1]])
            sig, n, c, hub, more = (np.array([x[f] for x in (*left, *right)], dtype=np.int64) for f in ("sig", "n", "c", "on_hub", "off_hub"))
            a, b, mark, of = [], [], np.zeros(len(tokens), dtype=np.int64), slice(len(left), None)
            for i in range(len(left)):
                most = np.minimum(hub[i], hub[of]) + np.minimum(more[i], more[of])
                near = np.flatnonzero((c[of] != c[i]) & ((100 + PERCENT) * most >= PERCENT * (n[i] + n[of]))) + len(left)
                if not len(near):
                    continue
                mark[place[start[i] : start[i] + size[i]]] = 1
                for j in near:
                    shared = int(mark[place[start[j] : start[j] + size[j]]].sum())
                    if 100 * shared >= PERCENT * (n[i] + n[j] - shared):
                        a.append(sig[i])
                        b.append(sig[j])
                mark[place[start[i] : start[i] + size[i]]] = 0
            yield pd.DataFrame({"a": np.array(a, dtype=np.int64), "b": np.array(b, dtype=np.int64)})


def _rest(spokes: DataFrame, compared: DataFrame, links: DataFrame, cores: DataFrame) -> DataFrame:
    """Links within a hub's group that are not with the hub itself: between sets outside the hub's component and the others.

    The sets are packed into blocks, and a block of outsiders meets each block of its group
    once: a row holds two blocks, no pair is a row. Tokens that both share with the hub, and
    those that are not the hub's, bound what two sets can share.
    """
    connected = components(links)
    label = lambda of, name: connected.select(F.col("v").alias(of), F.col("c").alias(name))
    member = spokes.join(compared.select("a", "b", "shared"), ["a", "b"], "left").select(F.col("a").alias("hub"), F.col("b").alias("sig"), "shared")
    member = member.join(label("sig", "c"), "sig", "left").join(label("hub", "home"), "hub", "left").withColumns({"c": F.coalesce("c", "sig"), "home": F.coalesce("home", "hub")})
    member = member.join(cores.select("sig", "n", "core"), "sig").withColumns({"on_hub": F.coalesce("shared", F.size("core")), "off_hub": F.size("core") - F.coalesce("shared", F.lit(0)), "out": F.col("c") != F.col("home")})
    member = checkpointed(member)
    sizes = member.groupBy("hub").agg((F.sum(F.size("core")) / BLOCK_TOKENS).cast("int").alias("of"), (F.sum(F.when(F.col("out"), F.size("core"))) / BLOCK_TOKENS).cast("int").alias("of_out")).where("of_out is not null")
    sized = member.join(sizes, "hub").withColumn("part", F.xxhash64("sig"))
    packed = F.collect_list(F.struct("sig", "n", "c", "on_hub", "off_hub", "core"))
    right = sized.groupBy("hub", F.pmod("part", F.col("of") + 1).alias("to")).agg(packed.alias("right"))  # BLOCK_TOKENS, about
    left = sized.where("out").groupBy("hub", F.pmod("part", F.col("of_out") + 1).alias("_"), "of").agg(packed.alias("left"))
    met = left.withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("of").cast("long")))).join(right, ["hub", "to"]).select("left", "right")
    return met.mapInPandas(_between, "a long, b long")


def _connected(texts: DataFrame) -> DataFrame:
    """``(v, c)``: the label of the component of each set that links to another."""
    cores = _cores(texts)
    before = F.col("n") - F.size("core")
    prefix = cores.select("sig", "n", before.alias("before"), F.posexplode(F.slice("core", F.lit(1), F.col("k"))).alias("at", "token")).select("token", "sig", "n", (F.col("n") - F.col("before") - F.col("at")).alias("left"))
    size = prefix.groupBy("token").agg(F.count("*").alias("size")).where("size > 1")
    sized = prefix.join(size, "token")
    cold = sized.where(F.col("size") <= GROUP).groupBy("token").agg(F.collect_list(F.struct("sig", "n", "left")).alias("x"))  # GROUP at most
    cold = cold.select(F.explode("x").alias("p"), "x").select("p", F.explode("x").alias("q")).where("p.sig < q.sig")
    n, m = F.col("p.n"), F.col("q.n")
    fit = (100 * F.least(n, m) >= PERCENT * F.greatest(n, m)) & ((100 + PERCENT) * F.least("p.left", "q.left") >= PERCENT * (n + m))  # what is left from the token on, it included
    cold = cold.where(fit).select(F.col("p.sig").alias("a"), F.col("q.sig").alias("b")).distinct()
    hot = checkpointed(sized.where(F.col("size") > GROUP).select("token", "sig", "n"))
    # the hub of a token: the set with the largest share of its tokens in large groups
    weight = hot.groupBy("sig").agg((F.count("*") / F.max("n")).alias("weight"))
    hubs = hot.join(weight, "sig").groupBy("token").agg(F.max(F.struct("weight", F.xxhash64("sig").alias("h"), "sig")).alias("hub"))
    spokes = checkpointed(hot.join(hubs, "token").select(F.col("hub.sig").alias("a"), F.col("sig").alias("b")).where("a <> b").distinct())
    compared = checkpointed(_compared(checkpointed(cold.unionByName(spokes).distinct()), cores))
    links = compared.where(_linked(F.col("shared"), F.col("n_a"), F.col("n_b"))).select("a", "b")
    if spokes.limit(1).count():
        links = links.unionByName(_rest(spokes, compared, links, cores))
    return components(links)


def _labelled(docs: DataFrame) -> DataFrame:
    """``docs`` without ``text``, with ``sig``, ``n_shingles`` and ``c``, a label of the component (null without words)."""
    schema = docs.drop("text").withColumns({"sig": F.lit(0).cast("long"), "n_shingles": F.lit(0).cast("long")}).schema
    ids, connected = checkpointed(docs.mapInPandas(_ids, schema)), _connected(docs.select("text"))  # read twice
    return ids.join(connected.select(F.col("v").alias("sig"), "c"), "sig", "left").withColumn("c", F.when(F.col("n_shingles") > 0, F.coalesce("c", "sig")))


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without its text, with ``n_shingles`` and ``component_id``.

    A document's set has its distinct shingles of five words (A-Z lower-cased, words parted by
    ASCII white space); with fewer words the whole sequence is the only shingle; null texts
    and texts without words have none and stay alone. Two documents link at a similarity of
    0.75 or more. ``component_id`` is the least ``key`` in the component (null keys are passed
    over; a component of null keys has null). Documents of equal sets are one vertex.
    Columns with a result's name are replaced; other columns and repeated rows stay.
    """
    docs = docs.drop("n_shingles", "component_id")
    vertices = _labelled(docs.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{i}") for i, c in enumerate(docs.columns) if c != text), F.col(text).alias("text")))
    least = vertices.where("c is not null").groupBy("c").agg(F.min("_key").alias("component_id"))
    named = vertices.join(least, "c", "left")
    own = [F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns) if c != text]
    return named.select(*own, "n_shingles", F.when(F.col("c").isNull(), F.col("_key")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component: the least ``key`` (null last), of equal keys the least text hash, of equal rows any.

    Rows without words link with nothing, so all of them stay. Columns are those of ``docs``.
    """
    columns = [f"_{i}" for i in range(len(docs.columns))]
    named = docs.toDF(*columns).withColumns({"_key": F.col(columns[docs.columns.index(key)]), "text": F.col(columns[docs.columns.index(text)])}).drop(columns[docs.columns.index(text)])
    worded = F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    vertices = _labelled(named.where(worded).select("_key", "text"))
    first = vertices.groupBy("c").agg(F.min(F.struct(F.col("_key").isNull().alias("none"), "_key", "sig")).alias("first")).select("first._key", "first.sig")
    schema = T.StructType([*named.schema.fields]).add("sig", "long").add("n_shingles", "long")
    rows = named.where(worded).mapInPandas(partial(_ids, keep_text=True), schema)
    first = first.select(F.coalesce(F.hash("_key"), F.lit(0)).alias("_h"), F.col("sig"), F.col("_key").alias("_first"))
    kept = rows.withColumn("_h", F.coalesce(F.hash("_key"), F.lit(0))).join(first, ["sig", "_h"]).where(F.col("_key").eqNullSafe(F.col("_first")))
    kept = kept.withColumn("_n", F.row_number().over(Window.partitionBy("sig", "_h").orderBy(F.xxhash64("text")))).where("_n = 1")
    every = kept.select(*named.columns).unionByName(named.where(~worded))
    return every.select(*(F.col("text" if c == text else columns[i]).alias(c) for i, c in enumerate(docs.columns)))


def op3_jaccard_join(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def components_sql(docs: str) -> str:
    """Tables up to ``component(doc_id, n_shingles, component_id)`` for the documents in ``docs``."""
    return rf"""
word AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM {docs}),
gram AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i : i + 4], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM word WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM gram GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM gram a JOIN gram b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM both_ JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(a, b) AS (SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a),
component AS (SELECT d.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS component_id FROM {docs} d LEFT JOIN size s ON s.doc_id = d.doc_id LEFT JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id)
"""


OP3_SQL = f"WITH RECURSIVE {components_sql('documents')} SELECT doc_id, n_shingles, component_id FROM component"
