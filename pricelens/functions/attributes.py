"""Variant attributes of a product name, as one struct of Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import vocabulary as V
from .names import brand, let, strings


def first(text: Column, pattern: str, group: int = 1) -> Column:
    """The first match's group, or null."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def every(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _led(prefix: str, found: Column, suffix: str = "") -> Column:
    return F.transform(found, lambda x: F.concat(F.lit(prefix), F.lower(x), F.lit(suffix)))


def model_codes(name: Column) -> Column:
    """Codes and hard sizes that tell products apart, distinct."""
    pairs = F.transform(every(name, V.INTEGER_PAIR, 0), lambda x: F.array_join(F.regexp_extract_all(x, F.lit(r"\d+"), F.lit(0)), "x"))
    return F.array_distinct(
        F.concat(
            _led("", every(name, V.MODEL)),
            F.filter(_led("", every(name, V.SKU)), lambda c: ~c.rlike(V.SKU_STOP)),
            _led("", every(name, V.SUTURE), "-0"),
            pairs,
            _led("", every(name, V.MICRONS), "u"),
            _led("", every(name, V.OUNCES), "oz"),
            every(name, V.FRACTION),
            _led("sz", every(name, V.DECIMAL_SIZE)),
            _led("ml_", F.filter(every(name, V.LETTER, 0), lambda c: ~c.isin(*V.LETTER_STOP))),
            F.filter(_led("", every(name, V.SHORT_CODE)), lambda c: ~c.isin(*V.SHORT_CODE_STOP)),
        )
    )


def contained(text: Column, choices) -> Column:
    """The value of the first ``(needle, value)`` whose needle the text has."""
    return F.coalesce(*(F.when(F.contains(text, F.lit(n)), F.lit(v)) for n, v in choices))


def pack_count(name: Column) -> Column:
    # one pattern with two groups: which of them filled is the match's own choice
    return F.coalesce(first(name, V.PACK, 1), first(name, V.PACK, 2)).try_cast("int")


def attributes(name: Column) -> Column:
    """The struct of all attributes; a null field is unknown and never compared."""
    low, count, tip = F.lower(name), pack_count(name), first(name, V.TIP).try_cast("int")
    across = first(low, V.DIMENSION, 1)
    return F.struct(
        brand(name).alias("brand"),
        model_codes(name).alias("model_codes"),
        first(name, V.ISO_SIZE).try_cast("int").alias("iso_size"),
        F.lower(first(name, V.SHADE)).alias("shade"),
        first(name, V.CONCENTRATION).try_cast("double").alias("concentration"),
        first(name, V.TAPER).alias("taper"),
        first(name, V.SLOT).alias("slot"),
        count.alias("pack_count"),
        contained(low, [(v, v) for v in V.VISCOSITIES]).alias("viscosity"),
        contained(low, V.MATERIALS).alias("material"),
        F.concat(across, F.lit("x"), first(low, V.DIMENSION, 2)).alias("dimension"),
        first(low, V.WIRE_FORM).alias("wire_form"),
        F.when(tip.eqNullSafe(count), None).otherwise(tip).alias("tip_number"),
        F.array_intersect(F.regexp_extract_all(low, F.lit("[a-z]+"), F.lit(0)), strings(V.COLORS)).alias("colors"),
    )


def _only(text: Column, pattern: str) -> Column:
    """The value if the text has a single distinct one."""
    found = F.array_distinct(F.transform(every(text, pattern), F.lower))
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))


def rich_attributes(name: Column, description: Column, packaging: Column) -> Column:
    """Attributes of the name; what it lacks comes from the other texts where they leave no doubt."""
    extra = F.trim(F.concat_ws(" ", F.coalesce(description, F.lit("")), F.coalesce(packaging, F.lit(""))))
    own, other = attributes(name), attributes(extra)
    both_wires = F.size(F.array_distinct(every(F.lower(extra), V.WIRE_FORM))) > 1
    fill = {
        "shade": _only(extra, V.SHADE), "concentration": _only(extra, V.CONCENTRATION).try_cast("double"), "iso_size": _only(extra, V.ISO_SIZE).try_cast("int"),
        "wire_form": F.when(~both_wires, other["wire_form"]), **{f: other[f] for f in ("material", "dimension", "viscosity", "pack_count")},
    }
    fields = ("brand", "model_codes", "iso_size", "shade", "concentration", "taper", "slot", "pack_count", "viscosity", "material", "dimension", "wire_form", "tip_number", "colors")
    return F.struct(*(F.coalesce(own[f], fill[f]).alias(f) if f in fill else own[f].alias(f) for f in fields))


def strong_codes(name: Column) -> Column:
    """Manufacturers' codes outside parentheses."""
    return F.array_distinct(every(F.lower(F.regexp_replace(name, r"\([^)]*\)", " ")), V.STRONG_CODE, 0))


def serials(name: Column) -> Column:
    """Numbers and serials that are no pack counts."""
    return F.array_distinct(every(F.regexp_replace(F.lower(name), V.PACK_CONTEXT, " "), V.SERIAL, 0))


def pack_size(name: Column, description: Column | None = None, url: Column | None = None) -> Column:
    """Pieces in the pack from 2 to 10,000 by the first phrase that states them, or 1; gifts don't count."""
    blank = F.lit("")
    slug = F.regexp_replace(F.coalesce(url if url is not None else blank, blank), "[-_/]", " ")
    text = F.lower(F.concat_ws(" ", name, F.coalesce(description if description is not None else blank, blank), slug))
    for gift in V.FREEBIES:
        text = F.regexp_replace(text, gift, " ")
    def stated(t: Column) -> Column:
        counts = F.array(*(first(t, p).try_cast("long") for p in V.PACK_PHRASES))
        return F.get(F.filter(counts, lambda n: n.between(2, 10_000)), F.lit(0))

    return F.coalesce(let(text, stated), F.lit(1)).cast("int")


def unit_price(price: Column, pieces: Column) -> Column:
    """Price of a piece, to the cent; without a positive price or more than one piece the price itself."""
    return F.when((price > 0) & (pieces > 1), F.floor(price / pieces * 100 + 0.5) / 100).otherwise(price)


def equivalent_price(price: Column, pack: Column, reference: Column) -> Column:
    """What as much as the reference's pack would cost, to two places; the price as it is where a pack isn't known."""
    return F.when((pack > 0) & (reference > 0), F.floor(price / pack * reference * 100 + 0.5) / 100).otherwise(price)
