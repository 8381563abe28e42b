"""Candidate pairs: blocking, triage, ranking, choice of the best."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import vocabulary as V
from ..functions.attributes import attributes, rich_attributes, strong_codes, unit_price
from ..functions.gates import brands_conflict, gate_reason, in_band, kinds_clash, text_traits, traits
from ..functions.names import distinguishing, let, normalize, specific, tokens, words
from ..functions.similarity import attribute_score, brand_score, embed, fuzz, fuzz_each, pack_score, score, sparse_dot, token_overlap, verdict
from ..functions.specs import compare_specs, describe, sized
from ..tables import checkpointed, parts


def block(searches: DataFrame, candidates: DataFrame, on: list[str] = [], name: str = "name", key: str = "search_id", other: str = "candidate_id") -> DataFrame:  # noqa: B006
    """Pairs that share a distinguishing token and the columns ``on``, once each: an equi-join on exploded tokens, never all with all.

    Both tables have a ``name``; columns other than ``on`` come back as ``s_`` and ``c_``, what
    :func:`profile` added as :func:`triage` and :func:`structured_match` ask for it. A search
    without tokens meets all candidates with its ``on`` columns; where there are none to join
    by, it meets nothing. Rows go to their tokens, and a pair is made at the first token that
    its names share: no pair is moved. Of rows with equal keys (candidates: within ``on``) one
    counts; profiled rows must have keys of their own.
    """
    s_key, c_key = f"s_{key}", f"c_{other}"
    sided = lambda rows, side: rows.select(*on, *(F.col(c).alias(_SIDES[c][side == "c"] if c in _SIDES else f"{side}_{c}") for c in rows.columns if c not in on))
    once = lambda rows, keys: rows if "_traits" in rows.columns else rows.dropDuplicates(keys)
    left = sided(once(searches, [key]), "s").withColumn("_wanted", F.coalesce(distinguishing(F.col(f"s_{name}")), F.array().cast("array<string>")))
    right = sided(once(candidates, [*on, other]), "c").withColumn("_offered", distinguishing(F.col(f"c_{name}")))
    met = left.withColumn("_token", F.explode("_wanted")).join(right.withColumn("_token", F.explode("_offered")), [*on, "_token"])
    met = met.where(F.col("_token") == F.get(F.array_intersect("_wanted", "_offered"), F.lit(0)))
    if on:
        met = met.drop("_token").unionByName(left.where(F.size("_wanted") == 0).join(right, on))
    return met.drop(*on, "_token", "_wanted", "_offered").where(F.col(s_key).isNotNull() & F.col(c_key).isNotNull())


def prefilter(candidates: DataFrame, searches: DataFrame, on: list[str]) -> DataFrame:
    """Candidates that share a distinguishing token with any search of their group ``on``; where a group's searches have no tokens, all of its candidates stay. Repeated rows come once."""
    wanted = searches.select(*on, F.explode(distinguishing(F.col("name"))).alias("_token")).distinct()
    shared = candidates.withColumn("_token", F.explode(distinguishing(F.col("name")))).join(wanted, [*on, "_token"], "left_semi").drop("_token")
    blank = searches.select(*on).distinct().join(wanted.select(*on).distinct(), on, "left_anti") if on else None
    if on:
        every = candidates.join(blank, on, "left_semi")
    else:
        every = candidates if searches.limit(1).count() and not wanted.limit(1).count() else candidates.limit(0)
    return shared.unionByName(every).distinct()


#: Columns of :func:`profiled` besides the normal forms.
PROFILE = ("_a", "_b", "_aw", "_bw", "_ag", "_bg", "_at", "_bt", "_av", "_bv")
#: What :func:`profile` adds to a record, and what it is called in a pair, for the search and for the candidate.
_SIDES = {"_own": ("_a", "_b"), "_words": ("_aw", "_bw"), "_traits": ("_ag", "_bg"), "_tokens": ("_at", "_bt"), "_vector": ("_av", "_bv"), "_rich": ("_ra", "_rb"), "_line": ("_sv", "_cv"), "_text": ("_stold", "_told")}


def _name_profile(names: DataFrame) -> DataFrame:
    """``names`` with the normal form of ``name`` and the first five of :data:`_SIDES`, dealt to all tasks and written once."""
    norm = F.col("norm")
    known = names.repartition(parts(names)).withColumn("norm", normalize(F.col("name")))
    known = known.select(*names.columns, "norm", attributes(norm).alias("_own"), words(norm).alias("_words"), F.array_distinct(tokens(norm)).alias("_tokens"), embed(norm).alias("_vector"))
    return checkpointed(known.select("*", traits(norm, F.col("_own.brand")).alias("_traits")))


def _record_profile(records: DataFrame) -> DataFrame:
    """``records`` (``name``, ``norm``, ``description``, ``packaging``) with the last three of :data:`_SIDES`, written once."""
    head = F.substring("description", 1, 240)
    described = F.coalesce("description", F.lit("")) != ""
    return checkpointed(records.select("*", rich_attributes(F.col("name"), F.col("description"), F.col("packaging")).alias("_rich"), F.when(described, embed(F.concat_ws(" ", "norm", head))).alias("_line"), F.when(described, text_traits(head)).alias("_text")))


def profile(records: DataFrame, rich: bool = False) -> DataFrame:
    """``records`` with all that :func:`triage` (``rich``: :func:`structured_match`) asks of one of them, worked out before :func:`block` makes pairs of them, so that no pair is moved for it. It is worked out row by row: give a row for each name, not for each of its copies."""
    known = _name_profile(records)
    return _record_profile(known) if rich else known


def profiled(pairs: DataFrame) -> DataFrame:
    """``pairs`` (``s_name``, ``c_name``), written once, with both names' normal form, attributes, words, what the gates ask, tokens and vector, worked out once for each distinct name; null names have nulls."""
    return _named(checkpointed(pairs))


def _named(pairs: DataFrame) -> DataFrame:
    known = _name_profile(pairs.select(F.explode(F.array("s_name", "c_name")).alias("name")).where("name is not null").distinct())
    for k, side in enumerate(("s", "c")):
        own = known.select(F.col("name").alias(f"{side}_name"), F.col("norm").alias(f"{side}_norm"), *(F.col(c).alias(to[k]) for c, to in _SIDES.items() if c in known.columns))
        pairs = pairs.join(own, f"{side}_name", "left")
    return pairs


def _rich(pairs: DataFrame, written: DataFrame) -> DataFrame:
    """``pairs`` (made of the rows ``written``) with ``_ra`` and ``_rb``, the rich attributes of both records, the vector of each name with its description (``_sv``, ``_cv``), and the text traits of the candidate's description (``_told``): once for each distinct record."""
    fields = ("name", "description", "packaging")
    records = written.select(F.explode(F.array(*(F.struct(*(F.col(f"{side}_{f}").alias(f) for f in fields)) for side in ("s", "c")))).alias("r")).select("r.*").distinct()
    known = _record_profile(records.repartition(parts(records)).withColumn("norm", normalize(F.col("name")))).withColumn("_key", F.xxhash64(*fields))
    for side, names in (("s", {"_rich": "_ra", "_line": "_sv"}), ("c", {"_rich": "_rb", "_line": "_cv", "_text": "_told"})):
        own = known.select("_key", *(F.col(f).alias(f"_k{f}") for f in fields), *(F.col(f).alias(n) for f, n in names.items()))
        same = [F.col(f"_k{f}").eqNullSafe(F.col(f"{side}_{f}")) for f in fields]
        pairs = pairs.withColumn("_skey", F.xxhash64(*(f"{side}_{f}" for f in fields))).join(own, (F.col("_skey") == F.col("_key")) & same[0] & same[1] & same[2], "left").drop("_key", "_skey", *(f"_k{f}" for f in fields))
    return pairs


def triage(pairs: DataFrame, with_text: bool = True) -> DataFrame:
    """``pairs`` (``s_name``, ``c_name``) with ``gate``, the features, ``score`` and ``verdict``.

    Vetoed pairs score null and are rejected; the costly features get nulls for them. Normal
    forms and what the gates ask are functions of one name, so they are worked out once for
    each distinct name and joined to the pairs, unless these were made of records with their
    :func:`profile`. ``with_text`` adds the fuzzy ratio and the vectors' cosine.
    """
    gated = (pairs if "_ag" in pairs.columns else profiled(pairs)).withColumn("gate", F.when((F.col("s_norm") == "") | (F.col("c_norm") == ""), "empty name").otherwise(gate_reason(F.col("s_norm"), F.col("c_norm"))))
    open_ = F.col("gate").isNull()
    a, b = F.col("_a"), F.col("_b")
    features = {
        "token": F.when(open_, token_overlap(F.col("_at"), F.col("_bt"))),
        "brand": F.when(open_, brand_score(a["brand"], b["brand"])),
        "pack": F.when(open_, pack_score(a["pack_count"], b["pack_count"])),
        "attr": F.when(open_, attribute_score(a, b)),
    }
    if with_text:
        features["cosine"] = F.when(open_, sparse_dot(F.col("_av"), F.col("_bv")))
    out = gated.withColumns(features).drop(*PROFILE)
    if with_text:  # Python gets rows without what was asked of the names
        asked = lambda c: F.when(open_, F.col(c))  # noqa: E731  the function sees nulls for vetoed pairs
        features["fuzz"] = F.when(open_, fuzz(asked("s_norm"), asked("c_norm")))
        out = out.withColumn("fuzz", features["fuzz"])
    out = out.withColumn("score", score(**{k: F.col(k) for k in features}))
    return out.withColumn("verdict", F.when(F.col("score").isNull(), "rejected").otherwise(verdict(F.col("score"))))


def top(pairs: DataFrame, by: list[str], order: list[Column], k: int = V.TOP) -> DataFrame:
    """The first ``k`` of each group, with their ``rank``; the order must have no ties."""
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def top_with_rescue(pairs: DataFrame, by: list[str], order: list[Column], key: str, k: int = V.TOP, more: int = V.RESCUED) -> DataFrame:
    """The first ``k`` that aren't rejected, and of the others the first ``more`` that share a specific token; ``rescued`` tells them apart.

    The pairs are read twice, so they are written once; a filter on the verdict must not pull
    the whole of its making into its condition either.
    """
    pairs = checkpointed(pairs)
    best = top(pairs.where("verdict <> 'rejected'"), by, order, k).withColumn("rescued", F.lit(False))
    others = pairs.join(best.select(*by, key), [*by, key], "left_anti").where(F.arrays_overlap(specific(F.col("s_name")), specific(F.col("c_name"))))
    return best.unionByName(top(others, by, order, more).withColumn("rescued", F.lit(True)))


VERDICT_RANK = {"confirmed": 3, "possible": 2, "variant": 1}


def verdict_rank(column: Column, ranks: dict[str, int] = VERDICT_RANK) -> Column:
    out = F.lit(0)
    for v, r in ranks.items():
        out = F.when(column == v, r).otherwise(out)
    return out


def best_cell(cells: DataFrame, by: list[str], position: str) -> DataFrame:
    """One cell of each group: the best verdict, then confidence, then the first. Aggregated before the shuffle; positions are numbers, and unique in a group."""
    rest = [c for c in cells.columns if c not in by]
    first = F.struct(verdict_rank(F.col("verdict")).alias("_rank"), F.col("confidence").alias("_sure"), (-F.col(position)).alias("_at"), F.struct(*rest).alias("_cell"))
    return cells.groupBy(*by).agg(F.max(first).alias("_best")).select(*by, "_best._cell.*").select(*cells.columns)


def structured_match(pairs: DataFrame) -> DataFrame:
    """``pairs`` of rich records with ``outcome`` (confirmed, borderline, rejected), ``reason`` and ``pack_note``.

    Columns, each with ``s_`` and ``c_``: name, description, packaging, price, unit_price,
    pack_size, spec (a composition or null).
    """
    if "_ra" in pairs.columns:
        p = pairs
    else:
        written = checkpointed(pairs)
        p = _rich(_named(written), written)
    p = p.withColumn("gate", F.when((F.col("s_norm") == "") | (F.col("c_norm") == ""), "empty name").otherwise(gate_reason(F.col("s_norm"), F.col("c_norm"), F.col("_told"))))
    p = p.drop("_a", "_b").withColumnsRenamed({"_ra": "_a", "_rb": "_b"})
    a, b = F.col("_a"), F.col("_b")
    fields = ("iso_size", "shade", "concentration", "taper", "slot", "viscosity", "material", "dimension", "wire_form", "tip_number")
    known = [a[f].isNotNull() & b[f].isNotNull() for f in fields]
    differ = F.concat_ws("; ", *(F.when(a[f] != b[f], F.concat(F.lit(f"{f} mismatch: "), a[f].cast("string"), F.lit(" vs "), b[f].cast("string"))) for f in fields))
    codes = strong_codes(F.col("s_name"))
    missing = (F.size(codes) > 0) & ~F.exists(codes, lambda c: F.contains(F.lower(F.col("c_name")), c))
    price = lambda s: F.coalesce(F.nullif(F.col(f"{s}_unit_price"), F.lit(0.0)), F.col(f"{s}_price"), F.lit(0.0))
    blank = lambda s: F.concat_ws("", f"{s}_description", f"{s}_packaging") == ""
    # names with the first 240 characters of their descriptions, where both have one
    told = sparse_dot(F.col("_sv"), F.col("_cv"))
    p = p.withColumns({
        "_compared": sum((k.cast("int") for k in known), F.lit(0)), "_differ": differ, "token": token_overlap(F.col("_at"), F.col("_bt")), "cosine": F.greatest(sparse_dot(F.col("_av"), F.col("_bv")), told),
        "spec": compare_specs(F.col("s_spec"), F.col("c_spec")), "unit_ratio": F.when((price("s") > 0) & (price("c") > 0), price("c") / price("s")), "thin": blank("s") | blank("c"), "_clash": kinds_clash(F.col("s_norm"), F.col("c_norm")),
        "_conflict": brands_conflict(a["brand"], b["brand"], F.col("s_name"), F.col("c_name")), "_brands": F.struct(a["brand"].alias("s"), b["brand"].alias("c")),
    }).drop(*PROFILE, "_sv", "_cv", "_told", "_stold").withColumn("fuzz", fuzz("s_norm", "c_norm"))
    own, other = F.col("_brands.s"), F.col("_brands.c")
    near = (F.col("fuzz") >= V.CONFIRM_FUZZ) | (F.col("token") >= V.NEAR_TOKEN)
    inside = in_band(price("c"), price("s"))
    far = ~F.coalesce(F.col("unit_ratio").between(1 / V.HARD_BAND, V.HARD_BAND), F.lit(True))
    backed = (F.col("_compared") >= 1) | F.col("spec").isin("exact", "same-tier")
    sound = ~F.col("thin") | ((F.col("_compared") >= 1) & (F.col("fuzz") >= V.THIN_FUZZ)) | (F.col("spec") == "exact")
    line = (F.col("cosine") >= V.CONFIRM_COSINE) | (F.col("fuzz") >= V.CONFIRM_FUZZ)
    brand_ok = (own == "") | (other == "") | (own == other)
    sure = line & brand_ok & (inside | near) & sound & (F.col("spec") != "different-formulation") & ((F.col("_compared") >= 1) | (F.col("cosine") >= V.STRONG_COSINE) | near)
    why = F.coalesce(
        F.col("gate"), F.when(F.col("_conflict"), F.concat(F.lit("brand conflict: "), own, F.lit(" vs "), other)),
        F.when(missing, F.concat(F.lit("model code '"), F.array_min(codes), F.lit("' absent"))), F.nullif("_differ", F.lit("")),
        F.when(F.col("_clash") & ~inside, "different product: container vs kit/bundle"), F.when(far & ~backed & ~near, "different product: per-unit price apart"),
    )
    packs = F.when((F.col("s_pack_size") != F.col("c_pack_size")) & (F.col("s_pack_size") > 0) & (F.col("c_pack_size") > 0), F.concat(F.col("s_pack_size").cast("string"), F.lit("/pack vs "), F.col("c_pack_size").cast("string"), F.lit("/pack")))
    note = F.when(F.col("spec") == "different-size", F.concat(describe(F.col("s_spec")), F.lit(" vs "), describe(F.col("c_spec")))).otherwise(packs)
    out = p.withColumns({"reason": why, "pack_note": note})
    return out.withColumn("outcome", F.when(F.col("reason").isNotNull(), "rejected").when(sure, "confirmed").otherwise("borderline")).drop("_compared", "_differ", "_clash", "_conflict", "_brands", "gate")


#: So many combinations of names may be sent to every task.
_SENT = 10_000


def _with_name_hits(listings: DataFrame) -> DataFrame:
    """``listings`` with ``_hits``: for each of the children's names (``_names``) the number of its tokens that the search adds to the listing's name, and the fuzzy ratio; worked out once for each combination of names."""
    by = ("s_name", "c_name", "_names")
    met = listings.where("_names is not null").select(*by).distinct()
    met = met.repartition(parts(met)).withColumns({"_own": F.array_except(distinguishing(F.col("s_name")), distinguishing(F.col("c_name"))), "_s": normalize(F.col("s_name"))})
    met = met.select(*by, F.col("_s"), F.transform("_names", lambda n: normalize(n)).alias("_vs"), F.transform("_names", lambda n: F.size(F.array_intersect(distinguishing(n), F.col("_own")))).alias("_n"))
    hits = F.arrays_zip(F.col("_n").alias("hits"), fuzz_each("_s", "_vs").alias("fuzz"))
    known = checkpointed(met.select(*(F.col(c).alias(f"_k{c}") for c in by), hits.alias("_hits")))
    few = known.limit(_SENT + 1).count() <= _SENT
    return listings.join(F.broadcast(known) if few else known, [F.col(c).eqNullSafe(F.col(f"_k{c}")) for c in by], "left").drop(*(f"_k{c}" for c in by))


def select_variant(listings: DataFrame) -> DataFrame:
    """Each listing as the child among its ``variants`` (name, price, spec) that the search means.

    The child's price and composition take the listing's place, and of ``mrp``, ``pack_size``,
    ``unit_price`` and ``image`` those that children and listing both have, where the child
    states them; without a unit price of its own the child's is its price over its pack.

    Children of another formulation are passed over; the rest go by composition, shared
    tokens that the search adds to the listing's name, fuzzy ratio, nearness of the price, and
    place. A listing with fewer than two real children, or nothing to choose by, stays. The
    name changes only if the search's own words single the child out.
    """
    real = F.filter("variants", lambda v: ~F.lower(F.trim(F.coalesce(v["name"], F.lit("")))).isin("", "default title") & (v["price"] > 0))
    base = listings.withColumn("_real", real).withColumn("_names", F.when(F.size("_real") >= 2, F.transform("_real", lambda v: v["name"])))
    base = _with_name_hits(base)
    ranks = F.create_map(*map(F.lit, ("exact", 0, "same-tier", 1, "unknown", 2, "different-size", 3)))
    far = lambda v: F.when(F.col("s_price") > 0, F.abs(v["price"] - F.col("s_price"))).otherwise(0.0)
    turn = lambda v, i: let(compare_specs(F.col("s_spec"), v["spec"]), lambda m: F.when(m != "different-formulation", F.struct(
        ranks[m].alias("rank"), (-F.get(F.col("_hits"), i)["hits"]).alias("hits"), (-F.get(F.col("_hits"), i)["fuzz"]).alias("fuzz"), far(v).alias("far"), i.alias("pos"))))
    # all of a listing's children stand in its row: the first two turns decide, and no row is moved
    base = base.withColumn("_turns", F.when(F.col("_hits").isNotNull(), F.array_sort(F.array_compact(F.transform("_real", turn)))))
    first, second = F.get("_turns", F.lit(0)), F.get("_turns", F.lit(1))
    hits, fuzz_ = [-first[f] for f in ("hits", "fuzz")]
    hits2, fuzz2 = F.coalesce(-second["hits"], F.lit(0)), F.coalesce(-second["fuzz"], F.lit(0.0))
    pins = (hits > 0) & ((hits > hits2) | ((hits == hits2) & (fuzz_ > fuzz2)))
    said = sized(F.col("s_spec")) | F.exists("_real", lambda v: sized(v["spec"]))
    base = base.withColumn("_pins", F.coalesce(pins, F.lit(False))).withColumn("v", F.when(first.isNotNull() & (F.coalesce(said, F.lit(False)) | F.col("_pins")), F.get("_real", first["pos"])))
    out = base.withColumn("_pins", F.when(F.col("v").isNotNull(), F.col("_pins")))
    kin = listings.schema["variants"].dataType.elementType.fieldNames()
    more = {f"c_{f}": F.coalesce(F.col(f"v.{f}"), F.col(f"c_{f}")) for f in ("mrp", "pack_size", "image") if f in kin and f"c_{f}" in listings.columns}
    if "c_unit_price" in listings.columns:
        own = F.when(F.col("v.pack_size") > 1, unit_price(F.col("v.price"), F.col("v.pack_size"))).otherwise(F.col("v.price")) if "pack_size" in kin else F.col("v.price")
        more["c_unit_price"] = F.coalesce(*([F.col("v.unit_price")] if "unit_price" in kin else []), own, "c_unit_price")
    return out.withColumns(more | {"c_price": F.coalesce("v.price", "c_price"), "c_name": F.when(F.col("_pins"), F.col("v.name")).otherwise(F.col("c_name")), "c_spec": F.coalesce("v.spec", "c_spec"), "pinned": F.coalesce("_pins", F.lit(False))}).drop("_real", "_names", "_hits", "_turns", "v", "_pins")


def judged(pairs: DataFrame, by: list[str], position: str, budget: int = V.JUDGE_BUDGET) -> DataFrame:
    """The final verdict: borderline pairs by the judge's columns ``same_product`` and ``same_variant``, for the first ``budget`` of each group; without a judgement possible, or rejected outside the price band; thin data never confirmed."""
    turn = F.row_number().over(Window.partitionBy(*by, F.col("outcome") == "borderline").orderBy(position))
    asked = (F.col("outcome") == "borderline") & (turn <= budget) & F.col("same_product").isNotNull()
    said = F.when(F.col("same_product") & F.col("same_variant"), "confirmed").when(F.col("same_product"), "variant").otherwise("rejected")
    final = F.when(F.col("outcome") == "confirmed", "confirmed").when(F.col("outcome") == "rejected", "rejected").when(asked, said).when(F.col("in_band"), "possible").otherwise("rejected")
    return pairs.withColumn("final", final).withColumn("final", F.when((F.col("final") == "confirmed") & F.col("thin"), "possible").otherwise(F.col("final")))
