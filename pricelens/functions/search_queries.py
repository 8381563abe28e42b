"""Search queries from special to broad for a product name, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from .attributes import every, model_codes
from .names import let, strings

# Words that don't search, and product types (the longest found counts).
NOISE = (
    "dental", "dentist", "for", "with", "and", "the", "of", "in", "to", "a", "an", "is", "on", "by", "from", "new", "original", "genuine", "buy", "online", "price", "best", "india", "product", "products",
    "free", "delivery", "shipping", "sale", "offer", "discount", "medical", "surgical", "supplies", "equipment", "devices", "type", "shape", "style", "model", "series", "version", "ss", "stainless", "steel", "special", "pack",
)
TYPES = (
    "rongeur", "forceps", "elevator", "excavator", "scaler", "curette", "explorer", "probe", "mirror", "retractor", "plugger", "spreader", "condenser", "scissors", "plier", "pliers", "cutter", "clamp", "tweezer", "needle holder", "matrix",
    "handpiece", "bur", "burs", "diamond bur", "carbide bur", "contra angle", "turbine", "file", "files", "k-file", "h-file", "rotary file", "gutta percha", "obturator", "apex locator", "endomotor",
    "composite", "resin", "cement", "adhesive", "bonding", "primer", "sealant", "sealer", "liner", "etchant", "etching", "filling", "restoration", "crown", "bridge", "veneer", "denture", "impression", "alginate", "silicone", "articular", "facebow", "articulator",
    "bracket", "brackets", "wire", "wires", "elastic", "elastics", "band", "bands", "archwire", "ligature", "gloves", "mask", "gown", "syringe", "needle", "needles", "cotton", "gauze", "suture", "blade", "polystrip", "polystrips", "sterilization", "pouch", "disinfectant",
    "implant", "abutment", "bone graft", "membrane", "bone plate", "bone screw", "bleaching", "whitening", "curing light", "light cure", "scanner", "camera", "chair", "unit", "autoclave", "ultrasonic", "wax", "investment", "acrylic", "stone", "plaster",
    "coating", "varnish", "protective coating", "refill", "refills", "tip refills", "cartridge", "composite system", "bulk fill composite", "toothbrush", "brush", "paste", "mouthwash", "floss", "gel", "height gauge", "positioning gauge", "gauge",
    "caliper", "ruler", "measuring", "luxating instrument", "periotome", "badge", "tray", "articulating paper",
)
# What is taken from a name before its words are read, in order, and the codes in it.
CLEAN = (
    (r"<[^>]*>", " "), (r"\([^)]*\)", ""), (r"\b[A-Z]{2,5}\d{1,4}\b", ""), (r"(?i)\bsize\s+[\d/.\-]+\s*(oz|mm|cm|ml|gm)?\b", ""), (r"\b\d+/\d+\b", ""), (r"(?i)\b\d+(\.\d+)?\s*(cm|mm|ml|gm|gms|kg|inch|inches|degree|oz)\b", ""),
    (r"(?i)\b(pack|set|combo|box|kit)\s*(of\s*)?\d+\b", ""), (r"(?i)\b\d+\s*(pcs|pieces?|units?|nos?|pc|tips?)\b", ""), (r"(?i)\b(micro|mini|premium|professional|standard|regular|extra|super)\b", ""), (r"(?i)\b(small|medium|large|xl|xxl|light|heavy)\b", ""), (r"\s*-\s*", " "), (r"\s+", " "),
)
CODE, PAREN_CODE, SHORT_CODE = r"\b([A-Z]{1,3}-?\d{3,6}[A-Z]?)\b", r"\(([A-Z0-9-]{3,12})\)", r"^[a-z]{1,5}-?\d{1,4}[a-z]?$"


def clean(name: Column) -> Column:
    """Without markup, parentheses, codes, measures, pack sizes and size words."""
    return F.trim(reduce(lambda c, s: F.regexp_replace(c, *s), CLEAN, name))


def product_type(text: Column, more: Column | None = None) -> Column:
    """The longest product type in the text, else in ``more``; of equally long ones the first listed."""
    order = sorted(TYPES, key=len, reverse=True)
    find = lambda t: F.get(F.filter(strings(order), lambda x: F.contains(F.lower(t), x)), F.lit(0))
    return find(text) if more is None else F.coalesce(find(text), find(F.concat_ws(" ", text, more)))


def search_queries(name: Column, description: Column | None = None, sku: Column | None = None, packaging: Column | None = None, maker: Column | None = None) -> Column:
    """The queries in order, each of 3 characters or more, once whatever its case; without any the first four words that search.

    The product type is sought in the name, then in ``description`` and ``packaging`` too. The
    brand is the name's; where no word of it searches, the first of ``maker`` (the catalogue's
    brand or maker).
    """
    short = clean(name)
    useful = F.filter(F.split(short, " "), lambda w: (F.length(w) > 1) & ~F.lower(w).isin(*NOISE) & ~w.rlike(r"^\d+$"))
    given = F.struct(short.alias("short"), useful.alias("useful"), product_type(short, None if description is None and packaging is None else F.concat_ws(" ", *(c for c in (description, packaging) if c is not None))).alias("kind"), model_codes(name).alias("codes"), name.alias("name"), (F.lit("") if maker is None else F.coalesce(F.get(F.split(F.trim(maker), r"\s+"), F.lit(0)), F.lit(""))).alias("maker"))
    return let(given, lambda g: let(_brand_and_line(g), lambda b: _distinct(_made(g, b, description, sku), g)))


def _brand_and_line(g: Column) -> Column:
    lead = F.coalesce(F.get(g["useful"], F.lit(0)), F.nullif(g["maker"], F.lit("")))
    brand = F.coalesce(F.nullif(F.regexp_extract(lead, "(?i)^[a-z0-9]+", 0), F.lit("")), lead, F.lit(""))
    line = lambda b: F.filter(g["useful"], lambda w: (F.lower(w) != F.lower(b)) & F.coalesce(~F.contains(F.lower(w), g["kind"]), F.lit(True)))
    return let(brand, lambda b: F.struct(b.alias("brand"), line(b).alias("line")))


def _made(g: Column, b: Column, description: Column | None, sku: Column | None) -> Column:
    brand, line, kind = b["brand"], b["line"], g["kind"]
    say = lambda *parts: F.trim(F.concat_ws(" ", *(F.nullif(p, F.lit("")) for p in parts)))
    with_kind = lambda base: let(base, lambda x: F.when(kind.isNull() | F.contains(F.lower(x), kind), x).otherwise(say(x, kind)))
    code = F.array_distinct(F.filter(F.concat(every(g["name"], CODE), every(g["name"], PAREN_CODE)), lambda c: (F.length(c) >= 4) & ~c.rlike(r"^\d+$")))
    first_two = F.array_join(F.slice(line, 1, 2), " ")
    out = [F.array(with_kind(say(brand, first_two)), F.when(kind.isNotNull(), say(brand, kind)))]
    if description is not None:
        model = F.get(F.filter(F.split(description, r"\s+"), lambda w: (F.length(w) > 2) & w.rlike("^[A-Z]") & ~F.lower(w).isin(*NOISE) & ~F.contains(F.lower(g["short"]), F.lower(w))), F.lit(0))
        out.append(F.array(let(model, lambda m: F.when(m.isNotNull(), say(brand, m, kind)))))
    out.append(F.array(F.when(F.size(line) > 0, say(brand, F.get(line, F.lit(0))))))
    out.append(F.flatten(F.transform(F.slice(code, 1, 2), lambda c: F.array(say(brand, c), c))))
    out.append(F.filter(g["codes"], lambda c: c.rlike(SHORT_CODE)))
    if sku is not None:
        out.append(F.array(F.when(sku.isNotNull(), say(brand, sku)), sku))
    out.append(F.array(F.when(F.size(line) >= 2, with_kind(F.array_join(F.slice(line, 1, 3), " "))), F.when(F.length(first_two) >= 4, first_two)))
    return F.concat(*out)


def _distinct(made: Column, g: Column) -> Column:
    asked = F.filter(made, lambda q: q.isNotNull() & (F.length(q) >= 3))
    once = lambda a: let(F.transform(a, F.lower), lambda low: F.filter(a, lambda q, i: F.array_position(low, F.lower(q)) == i + 1))
    return let(let(asked, once), lambda a: F.when(F.size(a) > 0, a).otherwise(F.filter(F.array(F.array_join(F.slice(g["useful"], 1, 4), " ")), lambda q: F.length(q) >= 3)))
