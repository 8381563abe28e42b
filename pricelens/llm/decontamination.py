"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Words become templates: numbers, quantities (a number and its unit) and names (a run of words
with a capital first) are replaced by typed placeholders, one for each run. Windows of a document's template meet windows of
the benchmark items' templates in a hash join. Along one alignment of a document and an item,
each value that fills an item's placeholders stands for the value that the document mostly
has there; windows with another one don't count, unless they are equal word for word. So a
question asked with other numbers and names is caught, a copy with a few edits too, and a
chance meeting of templates is not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..tables import checkpointed, table

#: Words of a window, and how many of them must not be placeholders.
WINDOW, LITERALS = 8, 4
#: An alignment counts from this share of the item's windows on.
COVER = 0.3
#: For items without such windows: literal words of a window that is compared as a template, and the share of them.
WEAK_LITERALS, WEAK_COVER = 2, 0.8
#: Item windows up to this many are broadcast (some 100 bytes each); more are joined by shuffle.
BROADCAST_WINDOWS = 200_000
#: Keys of texts with hits up to this many are broadcast (12 bytes each).
BROADCAST_TEXTS = 500_000
#: Words read as units after a number.
UNITS = ("mm", "cm", "m", "km", "in", "ft", "yd", "mi", "mg", "g", "kg", "t", "oz", "lb", "lbs", "ml", "cl", "l", "s", "sec", "min", "h", "hr", "hrs", "ms", "hz", "khz", "mhz", "w", "kw", "v", "a", "k", "c", "f", "meters", "metres", "kilometers", "miles", "feet", "inches", "grams", "kilograms", "pounds", "liters", "litres", "seconds", "minutes", "hours", "days", "weeks", "months", "years", "dollars", "euros", "cents", "percent")
WORD = r"[0-9]+(?:[.,][0-9]+)*|\p{L}+"
NUMBER, NAME, QUANTITY = "<num>", "<name>", "<quantity>"
#: Runs in words that are joined by blanks; possessive, so that a long run needs no stack.
RUN = rf"\p{{Lu}}\p{{L}}*+(?: \p{{Lu}}\p{{L}}*+)*+|[0-9][0-9.,]*+(?: (?:{'|'.join(UNITS)})(?!\p{{L}}))?+|\p{{L}}++"
#: Windows of an item whose shifts in a text lie as near to each other are one alignment.
NEAR = 4


def words(text: Column) -> Column:
    """Numbers and runs of letters, in order; null gives none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def _capital(word: Column) -> Column:
    first = F.substring(word, 1, 1)
    return (first != F.lower(first)) & (first == F.upper(first))


def starters(items: DataFrame) -> list[str]:
    """Words that begin a sentence of ``items`` (column ``text``) and are no names: more uses there are in lower case than with a capital within a sentence.

    They depend on the benchmark alone, so its items and all documents are read alike.
    """
    marked = F.regexp_extract_all(F.concat(F.lit(". "), F.coalesce(F.col("text"), F.lit(""))), F.lit(r"(?:[.!?:]\P{L}*)?\p{L}+"), F.lit(0))
    word = F.regexp_extract("marked", r"\p{L}+", 0)
    uses = items.select(F.explode(marked).alias("marked")).select(word.alias("word"), F.col("marked").rlike(r"^\P{L}").alias("begins"))
    lower = F.concat(F.lower(F.substring("word", 1, 1)), F.expr("substring(word, 2)"))
    counts = uses.withColumn("capital", _capital(F.col("word"))).groupBy(lower.alias("lower")).agg(
        F.max(F.col("capital") & F.col("begins")).alias("begins"), F.count_if(~F.col("capital")).alias("plain"), F.count_if(F.col("capital") & ~F.col("begins")).alias("named")
    )
    rows = counts.where(F.col("begins") & (F.col("plain") > F.col("named"))).select(F.concat(F.upper(F.substring("lower", 1, 1)), F.expr("substring(lower, 2)"))).collect()
    return sorted(r[0] for r in rows)


def runs(tokens: Column, plain: list[str]) -> Column:
    """The words, with those of a name or a quantity in one; those of ``plain`` are no names, but in lower case."""
    lowered = F.transform(tokens, lambda t: F.when(t.isin(plain), F.lower(t)).otherwise(t)) if plain else tokens
    return F.regexp_extract_all(F.array_join(lowered, " "), F.lit(RUN), F.lit(0))


def template(tokens: Column) -> Column:
    """The runs with numbers, quantities and names as placeholders."""
    return F.transform(tokens, lambda t: F.when(F.substring(t, 1, 1).between("0", "9"), F.when(F.contains(t, F.lit(" ")), QUANTITY).otherwise(NUMBER)).when(_capital(t), NAME).otherwise(t))


def _windows(form: Column, width: Column | int) -> Column:
    """Hashes of all windows of ``width`` words, in order.

    Each word is hashed once. Windows of WINDOW words are put together by doubling: pairs of
    hashes, then pairs of pairs; those of short items word by word.
    """
    hashes = F.transform(form, lambda t: F.xxhash64(t))
    none = F.array().cast("array<bigint>")
    width = F.lit(width) if isinstance(width, int) else width

    def doubled(one: Column, size: int = 1) -> Column:
        if size == WINDOW:
            return F.slice(one, F.lit(1), F.size(one) - WINDOW + 1)  # the last ones have no whole window
        return let(F.zip_with(one, F.slice(one, F.lit(size + 1), F.size(one)), lambda x, y: F.xxhash64(x, y)), lambda two: doubled(two, size * 2))

    short = lambda one: F.transform(F.sequence(F.lit(1), F.size(one) - width + 1), lambda i: F.xxhash64(F.slice(one, i, width)))
    return let(hashes, lambda one: F.when(F.size(one) < width, none).when(width == WINDOW, doubled(one)).otherwise(short(one)))


def let(value: Column, then) -> Column:
    """``then(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _key(text: Column) -> tuple[Column, Column]:
    """Two hashes, 96 bits together, that stand for a text."""
    text = F.coalesce(text, F.lit(""))
    return F.xxhash64(text).alias("_k1"), F.hash(text, F.length(text)).alias("_k2")


def _agreeing(hit: DataFrame, line: list[str]) -> DataFrame:
    """The windows of ``hit`` (``pairs``, ``same``) whose slots all have their alignment's most frequent value for the item's, and those of equal words.

    Of values as frequent the least counts. ``line`` names the columns of an alignment.
    """
    slot = hit.select(*line, "shift", "at", F.explode("pairs").alias("slot")).select(*line, "shift", "at", "slot.*")
    # a window with two values for one of the item's disagrees with any
    chosen = slot.groupBy(*line, "kind", "item").agg(F.mode("doc", True).alias("chosen"))
    off = slot.join(chosen, [*line, "kind", "item"]).where(F.col("doc") != F.col("chosen")).select(*line, "shift", "at").distinct().withColumn("off", F.lit(True))
    return hit.join(off, [*line, "shift", "at"], "left").where(F.col("same") | F.col("off").isNull())


def contaminated_texts(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each text of ``docs`` (column ``text``) that holds an item of ``benchmark`` (``item_id``, ``text``): its key (``_k1``, ``_k2``), ``n_items`` and ``item_ids`` (ascending, joined by commas).

    Items of equal text are one, under the least id. Items of fewer words than a window are
    matched whole. Templates are compared in windows with :data:`LITERALS` words besides
    placeholders (for short items, half of the words), and for items without any in windows
    with :data:`WEAK_LITERALS`, of which :data:`WEAK_COVER` must agree. These items' windows are
    also compared word for word, so an item of mere placeholders is found verbatim.
    An item without words or with a null text matches nothing.
    """
    plain = starters(benchmark)
    items = benchmark.groupBy("text").agg(F.min("item_id").alias("item_id")).withColumn("words", words(F.col("text"))).withColumn("tokens", runs(F.col("words"), plain))
    items = items.where((F.size("tokens") > 0) & F.col("item_id").isNotNull()).withColumn("form", template(F.col("tokens"))).withColumn("width", F.least(F.lit(WINDOW), F.size("tokens")))
    windows = items.select("item_id", "tokens", "form", "width", F.posexplode(_windows(F.col("form"), F.col("width"))).alias("at", "window"))
    windows = windows.withColumns({"form": F.slice("form", F.col("at") + 1, F.col("width")), "tokens": F.slice("tokens", F.col("at") + 1, F.col("width"))})
    windows = windows.withColumn("literals", F.size(F.filter("form", lambda t: ~t.isin(NUMBER, NAME, QUANTITY))))  # of the window, not again a part of it
    windows = windows.withColumn("strong", F.col("literals") >= F.least(F.lit(LITERALS), F.ceil(F.col("width") / 2)))
    kinds = windows.groupBy("item_id").agg(F.max("strong").alias("any"))
    share = F.when(F.col("any"), COVER).otherwise(WEAK_COVER).alias("share")
    by_template = windows.join(kinds, "item_id").where(F.when(F.col("any"), F.col("strong")).otherwise(F.col("literals") >= WEAK_LITERALS)).select("item_id", F.lit(False).alias("exact"), "width", "at", "window", "form", "tokens", share)
    nothing = F.array().cast("array<string>")
    by_words = items.join(kinds.where("not any"), "item_id", "left_semi").withColumn("width", F.least(F.lit(WINDOW), F.size("words"))).select("item_id", "width", F.posexplode(_windows(F.col("words"), F.col("width"))).alias("at", "window"))
    by_words = by_words.join(kinds, "item_id").select("item_id", F.lit(True).alias("exact"), "width", "at", "window", nothing.alias("form"), nothing.alias("tokens"), share)
    windows = checkpointed(by_template.unionByName(by_words))
    sizes = windows.groupBy("item_id", "exact").agg(F.count("*").alias("of"))
    widths = sorted((r[0], r[1]) for r in windows.groupBy("width").agg(F.collect_set("exact")).collect())  # WINDOW values at most
    few = windows.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS
    windows = windows.join(sizes, ["item_id", "exact"]).withColumn("need", F.col("of") * F.col("share")).drop("share", "of")

    forms = docs.select(*_key(F.col("text")), words(F.col("text")).alias("words")).withColumn("forms", template(runs(F.col("words"), plain)))
    hits = []
    for width, paths in widths:
        none = F.array().cast("array<bigint>")
        own = _windows(F.col("forms"), width) if False in paths else none
        exact = _windows(F.col("words"), width) if True in paths else none
        first = F.greatest(F.size("forms") - width + 1, F.lit(0)) if False in paths else F.lit(0)  # place of the first window of words
        # only hashes are exploded: a row that had the text's words would make the work grow with the square of its length
        found = forms.select("_k1", "_k2", first.alias("first"), F.posexplode(F.concat(own, exact)).alias("place", "window"))
        found = found.select("_k1", "_k2", "window", (F.col("place") >= F.col("first")).alias("exact"), F.when(F.col("place") < F.col("first"), F.col("place")).otherwise(F.col("place") - F.col("first")).alias("place"))
        side = windows.where(F.col("width") == width)
        hits.append(found.join(F.broadcast(side) if few else side, ["window", "exact"]).select("_k1", "_k2", "item_id", "exact", "at", "need", "width", "form", "tokens", "place"))
    if not hits:
        return docs.sparkSession.createDataFrame([], "_k1 long, _k2 int, n_items long, item_ids string")
    hit = hits[0]
    for more in hits[1:]:
        hit = hit.unionByName(more)
    # copies of a text meet here before the shuffle; read several times below, the documents twice
    hit = checkpointed(hit.dropDuplicates(["_k1", "_k2", "item_id", "exact", "place", "at"]))
    wanted = hit.where("not exact").select("_k1", "_k2").distinct()
    wanted = F.broadcast(wanted) if wanted.limit(BROADCAST_TEXTS + 1).count() <= BROADCAST_TEXTS else wanted
    texts = docs.select(*_key(F.col("text")), "text").join(wanted, ["_k1", "_k2"], "left_semi").dropDuplicates(["_k1", "_k2"])
    texts = texts.select("_k1", "_k2", runs(words(F.col("text")), plain).alias("runs"))
    templates = hit.where("not exact").join(texts, ["_k1", "_k2"]).withColumn("own", F.slice("runs", F.col("place") + 1, F.col("width"))).drop("runs")
    hit = templates.unionByName(hit.where("exact").withColumn("own", nothing)).withColumn("shift", F.col("place") - F.col("at"))
    slots = F.filter(F.arrays_zip("form", "tokens", "own"), lambda x: x["form"].isin(NUMBER, NAME, QUANTITY))
    pairs = F.transform(slots, lambda x: F.struct(x["form"].alias("kind"), x["tokens"].alias("item"), x["own"].alias("doc")))
    same = F.forall(pairs, lambda x: x["item"] == x["doc"])
    hit = checkpointed(hit.select("_k1", "_k2", "item_id", "exact", "shift", "at", "need", pairs.alias("pairs"), same.alias("same")))
    # shifts of an item in a text, in order; a wider step begins an alignment
    by = Window.partitionBy("_k1", "_k2", "item_id", "exact").orderBy("shift")
    step = hit.select("_k1", "_k2", "item_id", "exact", "shift").distinct().withColumn("new", F.coalesce(F.col("shift") - F.lag("shift").over(by) > NEAR, F.lit(True)).cast("int"))
    line = ["_k1", "_k2", "item_id", "exact", "line"]
    hit = hit.join(step.select("_k1", "_k2", "item_id", "exact", "shift", F.sum("new").over(by).alias("line")), ["_k1", "_k2", "item_id", "exact", "shift"])
    leak = _agreeing(hit, line).groupBy(*line).agg(F.countDistinct("at").alias("n"), F.max("need").alias("need")).where(F.col("n") >= F.col("need"))
    return leak.groupBy("_k1", "_k2").agg(F.countDistinct("item_id").alias("n_items"), F.array_join(F.sort_array(F.collect_set("item_id")).cast("array<string>"), ",").alias("item_ids"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` (with a column ``text``) with ``n_items``, ``item_ids`` and ``contaminated``.

    Null and empty texts are clean, with 0 items and an empty list. Columns with a result's
    name are replaced, other columns and repeated rows stay; with an empty benchmark all is clean.
    """
    docs = docs.drop("n_items", "item_ids", "contaminated")
    found = contaminated_texts(docs, benchmark)
    k1, k2 = _key(docs["text"])
    joined = docs.withColumns({"_k1": k1, "_k2": k2}).join(found, ["_k1", "_k2"], "left")
    return joined.select(*docs.columns, F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("item_ids", F.lit("")).alias("item_ids"), F.col("n_items").isNotNull().alias("contaminated"))


def op4_decontamination(spark, sf_dir):
    docs, benchmark = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    found = contaminated_texts(docs, benchmark)
    k1, k2 = _key(F.col("text"))
    ids = docs.select("doc_id", k1, k2)  # the texts need not move
    joined = ids.join(found, ["_k1", "_k2"], "left")
    return joined.select("doc_id", F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("item_ids", F.lit("")).alias("item_ids"), F.col("n_items").isNotNull().alias("contaminated"))


def _op4_sql() -> str:
    """The operator's rules as one statement: starters, runs, windows of both kinds, alignments of neighbouring shifts, agreement by the most frequent value."""
    capital = lambda t: f"({t}[1] <> lower({t}[1]) AND {t}[1] = upper({t}[1]))"
    said = f"regexp_extract_all(coalesce(text, ''), '{WORD}')"
    run = rf"\p{{Lu}}\p{{L}}*(?: \p{{Lu}}\p{{L}}*)*|[0-9][0-9.,]*(?: (?:{'|'.join(UNITS)})(?: |$))|[0-9][0-9.,]*|\p{{L}}+"
    lowered = "array_to_string(list_transform(w, lambda t: CASE WHEN list_contains(known, t) THEN lower(t) ELSE t END), ' ')"
    tokens = f"list_transform(regexp_extract_all({lowered}, '{run}'), lambda t: trim(t))"
    form = f"list_transform(r, lambda t: CASE WHEN t[1] BETWEEN '0' AND '9' THEN CASE WHEN contains(t, ' ') THEN '{QUANTITY}' ELSE '{NUMBER}' END WHEN {capital('t')} THEN '{NAME}' ELSE t END)"
    slots = f"('{NUMBER}', '{NAME}', '{QUANTITY}')"
    cut = lambda of: f"SELECT *, unnest(range(0, greatest(len({of}) - width + 1, 0))) AS pos"
    line = "text, item_id, exact, line"
    return rf"""WITH mark AS (SELECT unnest(regexp_extract_all('. ' || coalesce(text, ''), '(?:[.!?:]\P{{L}}*)?\p{{L}}+')) AS m FROM benchmark),
spoken AS (SELECT regexp_extract(m, '\p{{L}}+') AS word, regexp_matches(m, '^\P{{L}}') AS begins FROM mark),
counted AS (SELECT lower(word[1]) || word[2:] AS l, {capital("word")} AS cap, begins FROM spoken),
plain AS (SELECT upper(l[1]) || l[2:] AS word FROM counted GROUP BY l HAVING bool_or(cap AND begins) AND count(*) FILTER (WHERE NOT cap) > count(*) FILTER (WHERE cap AND NOT begins)),
words_ AS (SELECT coalesce(list(word), []::VARCHAR[]) AS known FROM plain),
item0 AS (SELECT item_id, w, {tokens} AS r FROM (SELECT min(item_id) AS item_id, {said} AS w FROM benchmark GROUP BY text), words_),
item AS (SELECT item_id, w, r, {form} AS f, least({WINDOW}, len(r)) AS width FROM item0 WHERE len(r) > 0 AND item_id IS NOT NULL),
window0 AS (SELECT item_id, width, pos, f[pos + 1 : pos + width] AS f, r[pos + 1 : pos + width] AS r FROM ({cut("f")} FROM item)),
window1 AS (SELECT *, len(list_filter(f, lambda t: t NOT IN {slots})) AS literals FROM window0),
window2 AS (SELECT *, literals >= least({LITERALS}, ceil(width / 2)) AS strong, bool_or(literals >= least({LITERALS}, ceil(width / 2))) OVER (PARTITION BY item_id) AS any_ FROM window1),
used AS (SELECT item_id, false AS exact, width, pos, f AS key, f, r, any_ FROM window2 WHERE CASE WHEN any_ THEN strong ELSE literals >= {WEAK_LITERALS} END
  UNION ALL SELECT item_id, true, width, pos, w[pos + 1 : pos + width], [], [], false FROM ({cut("w")} FROM (SELECT item_id, w, least({WINDOW}, len(w)) AS width FROM item WHERE item_id IN (SELECT item_id FROM window2 WHERE NOT any_)))),
needed AS (SELECT *, count(*) OVER (PARTITION BY item_id, exact) * CASE WHEN any_ THEN {COVER}::DOUBLE ELSE {WEAK_COVER}::DOUBLE END AS need FROM used),
doc0 AS (SELECT text, w, {tokens} AS r FROM (SELECT text, {said} AS w FROM documents WHERE text IS NOT NULL GROUP BY text), words_),
doc AS (SELECT text, w, r, {form} AS f FROM doc0),
place AS (SELECT text, false AS exact, width, pos, f[pos + 1 : pos + width] AS key, r[pos + 1 : pos + width] AS own FROM ({cut("f")} FROM doc, (SELECT DISTINCT width FROM needed WHERE NOT exact))
  UNION ALL SELECT text, true, width, pos, w[pos + 1 : pos + width], [] FROM ({cut("w")} FROM doc, (SELECT DISTINCT width FROM needed WHERE exact))),
hit0 AS (SELECT p.text, n.item_id, n.exact, p.pos - n.pos AS shift, n.pos, n.need, list_filter(list_transform(range(1, len(n.f) + 1), lambda k: {{kind: n.f[k], item: n.r[k], doc: p.own[k]}}), lambda x: x.kind IN {slots}) AS pairs FROM place p JOIN needed n ON p.exact = n.exact AND p.width = n.width AND p.key = n.key),
hit1 AS (SELECT *, len(list_filter(pairs, lambda x: x.item <> x.doc)) = 0 AS same FROM hit0),
step AS (SELECT text, item_id, exact, shift, CASE WHEN shift - lag(shift) OVER s > {NEAR} OR lag(shift) OVER s IS NULL THEN 1 ELSE 0 END AS new FROM (SELECT DISTINCT text, item_id, exact, shift FROM hit1) WINDOW s AS (PARTITION BY text, item_id, exact ORDER BY shift)),
lined AS (SELECT *, sum(new) OVER (PARTITION BY text, item_id, exact ORDER BY shift) AS line FROM step),
hit AS (SELECT h.*, l.line FROM hit1 h JOIN lined l USING (text, item_id, exact, shift)),
slot AS (SELECT {line}, shift, pos, x.kind AS kind, x.item AS item, x.doc AS doc FROM (SELECT {line}, shift, pos, unnest(pairs) AS x FROM hit)),
chosen AS (SELECT {line}, kind, item, doc AS value FROM (SELECT {line}, kind, item, doc, count(*) AS n FROM slot GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY {line}, kind, item ORDER BY n DESC, doc) = 1),
off AS (SELECT DISTINCT {line}, shift, pos FROM slot JOIN chosen USING ({line}, kind, item) WHERE doc <> value),
kept AS (SELECT * FROM hit WHERE same UNION ALL SELECT * FROM (SELECT * FROM hit WHERE NOT same) ANTI JOIN off USING ({line}, shift, pos)),
leak AS (SELECT DISTINCT text, item_id FROM (SELECT {line}, count(DISTINCT pos) AS n, max(need) AS need FROM kept GROUP BY {line}) WHERE n >= need),
leaks AS (SELECT text, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS item_ids FROM leak GROUP BY text)
SELECT d.doc_id, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(item_ids, '') AS item_ids, n_items IS NOT NULL AS contaminated FROM documents d LEFT JOIN leaks USING (text)"""


OP4_SQL = _op4_sql()
