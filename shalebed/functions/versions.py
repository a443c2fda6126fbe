"""Versions, file names and product names as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Name patterns of each brand, extensions, key rules.
EXTENSION = r"(?i)\.(bin|img|trx|chk|zip|rom)$"
#: Brands, whether the name must hold one version only, and where the version stands.
VERSION_NAMES = [
    (["netgear"], False, r"[-_][Vv](\d+(?:\.\d+){2,3})(?=[_.\-]|$)"),
    (["netgear"], False, r"-(\d+(?:\.\d+){3})(?=_|$)"),
    (["netgear"], False, r"_(\d+(?:_\d+){2,3})(?=_|$)"),
    (["asus"], False, r"_(\d+(?:\.\d+){2,5}(?:_\d{2,6}){0,2})(?:-g[0-9a-f]+)?(?:_combo)?(?:\.[A-Z])?$"),
    (["belkin"], False, r"[_\-\s][vV]?(\d+\.\d+\.\d+)(?=$|[_.\-\s(])"),
    (["dlink"], True, r"(?<![\d.])(\d+(?:\.\d+){1,5})(?![\d])(?!\.?[A-Za-z])"),
    (["tp_link", "tplink"], False, r"_(\d+(?:_\d+){2})(?=_up|_\d{6}R\d+)"),
    (["tp_link", "tplink"], False, r"_(\d+\.\d+\.\d+)_\[\d{8}-rel\d+\]"),
]
DATE = r"^\d{4}\.\d{1,2}\.\d{1,2}$"
MODEL_WITHOUT_HYPHEN = r"(?i)^([a-z]{2,5})(\d.*)$"
VERSIONED_MODEL = r"(?i)^([a-z][a-z0-9-]*\d[a-z0-9-]*)_(\d+\.\d.*)$"
THIRD_PARTY = "webflash"
FROM_FOLDER, FROM_NAME = "directory", "filename"


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    m = F.regexp_extract(text, pattern, group)
    return F.when(m != "", m)


def parse_version(raw: Column) -> Column:
    """array<long> of the leading numbers, or null if the text begins with none."""
    lead = F.regexp_extract(F.trim(raw), r"^\d+(?:\.\d+)*", 0)
    return F.when(lead != "", F.split(lead, r"\.").cast("array<bigint>"))


def padded(version: Column) -> Column:
    """The version without trailing zeros: arrays then compare as if padded."""
    last = F.array_max(F.transform(version, lambda v, i: F.when(v != 0, i + 1).otherwise(0)))
    return F.when(version.isNotNull(), F.slice(version, 1, F.coalesce(last, F.lit(0))))


def versions_equal(a: Column, b: Column) -> Column:
    return padded(a) == padded(b)


def version_in_range(
    version: Column,
    start_including: Column | None = None,
    start_excluding: Column | None = None,
    end_including: Column | None = None,
    end_excluding: Column | None = None,
) -> Column:
    """All given bounds hold; a null bound is no bound."""
    v = padded(version)
    tests = []
    for bound, test in (
        (start_including, lambda b: v >= b),
        (start_excluding, lambda b: v > b),
        (end_including, lambda b: v <= b),
        (end_excluding, lambda b: v < b),
    ):
        if bound is not None:
            tests.append(bound.isNull() | test(padded(bound)))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def unquoted(name: Column) -> Column:
    """Percent-decoded; a plus sign stays, and so does a name with broken escapes."""
    return F.coalesce(F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), name)


def infer_version(brand: Column, name: Column) -> Column:
    """The version in a file name: the first of the brand's rules that finds one. A
    rule for sole versions leaves out dates and wants one version, however often.
    """
    stem = F.regexp_replace(unquoted(name), EXTENSION, "")
    key = F.lower(F.trim(brand))

    def told(sole: bool, pattern: str) -> Column:
        found = F.transform(F.regexp_extract_all(stem, F.lit(pattern), F.lit(1)), lambda v: F.replace(v, F.lit("_"), F.lit(".")))
        if not sole:
            return F.get(found, 0)
        versions = F.array_distinct(F.filter(found, lambda v: ~v.rlike(DATE)))
        return F.when(F.size(versions) == 1, F.get(versions, 0))

    return F.coalesce(*[F.when(key.isin(*brands), told(sole, pattern)) for brands, sole, pattern in VERSION_NAMES])


def path_parts(path: Column) -> Column:
    """array<string>: the folders and the name of a relative path; null of an
    absolute one and of one that climbs.
    """
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    return F.when(~F.startswith(path, F.lit("/")) & ~F.array_contains(parts, ".."), parts)


def path_identity(path: Column) -> Column:
    """struct<brand, model, label, version, version_source> of brand/model/name, all
    null for other paths. A version behind the model's name goes before one in the
    file's name; images of third parties have none.
    """
    parts = path_parts(path)
    brand, folder, name = F.lower(F.trim(F.get(parts, 0))), F.trim(F.get(parts, 1)), F.get(parts, 2)
    versioned = folder.rlike(VERSIONED_MODEL)
    model = F.lower(F.when(versioned, F.regexp_extract(folder, VERSIONED_MODEL, 1)).otherwise(folder))
    known = F.coalesce((F.size(parts) == 3) & (brand != "") & (model != "") & (F.trim(name) != ""), F.lit(False))
    own = known & ~F.contains(F.lower(name), F.lit(THIRD_PARTY))
    inferred = infer_version(brand, name)
    fields = {
        "brand": F.when(known, brand),
        "model": F.when(known, model),
        "label": F.when(known, F.concat_ws("_", brand, model)),
        "version": F.when(own, F.when(versioned, F.regexp_extract(folder, VERSIONED_MODEL, 2)).otherwise(inferred)),
        "version_source": F.when(own & versioned, FROM_FOLDER).when(own & inferred.isNotNull(), FROM_NAME),
    }
    return F.struct(*[e.alias(n) for n, e in fields.items()])


def relative_to(path: Column, root: Column) -> Column:
    """The path below root, both absolute or both relative; null if it isn't below."""
    folder = F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))
    below = F.substr(path, F.length(folder) + 1)
    return F.when(F.startswith(path, folder) & path_parts(below).isNotNull(), below)


def off_layout(path: Column, root: Column) -> Column:
    """Whether a file isn't root/brand/model/name."""
    below = relative_to(path, root)
    return below.isNull() | path_identity(below)["brand"].isNull()


def model_key(brand: Column, model: Column) -> Column:
    """Lower case without dashes, underscores and spaces, as brand/model."""
    plain = lambda c: F.translate(F.lower(c), "-_ ", "")
    return F.concat_ws("/", plain(brand), plain(model))


def cache_key(brand: Column, model: Column) -> Column:
    """brand/model trimmed and lower-cased; null where one is blank."""
    a, b = F.lower(F.trim(brand)), F.lower(F.trim(model))
    return F.when((a != "") & (b != ""), F.concat_ws("/", a, b))


def canonical(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def canonical_product(name: Column) -> Column:
    return F.regexp_replace(canonical(name), "firmware$", "")


def product_of(criteria: Column) -> Column:
    """struct<part, vendor, product, version, update> of a CPE 2.3 name of 13 fields, else null."""
    p = F.split(criteria, ":")
    ok = (F.size(p) == 13) & (F.get(p, 0) == "cpe") & (F.get(p, 1) == "2.3")
    return F.when(
        ok,
        F.struct(
            F.get(p, 2).alias("part"),
            canonical(F.get(p, 3)).alias("vendor"),
            canonical_product(F.get(p, 4)).alias("product"),
            F.get(p, 5).alias("version"),
            F.get(p, 6).alias("update"),
        ),
    )


def normalized_model(model: Column) -> Column:
    """Upper case with hyphens for underscores, and between leading letters and digits where there is none."""
    dashed = F.replace(model, F.lit("_"), F.lit("-"))
    split = F.regexp_replace(dashed, MODEL_WITHOUT_HYPHEN, "$1-$2")
    return F.upper(F.when(F.contains(dashed, F.lit("-")), dashed).otherwise(split))


def _spaced(base: Column) -> Column:
    """array<string>: each hyphen kept or made a space, the first hyphen's choice changing fastest."""
    parts = F.split(base, "-")
    joints = F.size(parts) - 1

    def one(mask: Column) -> Column:
        return F.aggregate(
            F.transform(F.slice(parts, 2, F.greatest(joints, F.lit(0))), lambda p, i: F.struct(p.alias("p"), i.alias("i"))),
            F.get(parts, 0),
            lambda text, x: F.concat(text, F.when(F.lit(1) == F.floor(mask / F.pow(F.lit(2), x["i"])).cast("int") % 2, " ").otherwise("-"), x["p"]),
        )

    return F.transform(F.sequence(F.lit(0), (F.pow(F.lit(2), joints) - 1).cast("int")), one)


def search_variants(model: Column, *vendors: Column) -> Column:
    """array<string>: the vendor spellings with all spellings of a model, each once, in order."""
    dashed = F.replace(model, F.lit("_"), F.lit("-"))
    bare = ~F.contains(dashed, F.lit("-")) & dashed.rlike(MODEL_WITHOUT_HYPHEN)
    names = F.concat(_spaced(normalized_model(model)), F.when(bare, F.array(F.upper(dashed))).otherwise(F.array().cast("array<string>")))
    every = F.flatten(F.transform(names, lambda n: F.array(*[F.concat_ws(" ", v, n) for v in vendors])))
    return F.array_distinct(every)


def best_score(v31: Column, v30: Column, v2: Column) -> Column:
    """The highest score of the newest metric that has any; arrays of doubles."""
    return F.coalesce(*[F.array_max(a) for a in (v31, v30, v2)], F.lit(0.0))


def severity_bucket(severity: Column) -> Column:
    return F.when(F.coalesce(severity, F.lit("")) == "", F.lit("NONE")).otherwise(F.upper(severity))


# Models in flat file names (fixed values of each vendor's names).
ASUS_ROUTERS = r"^(RT[-_]|DSL[-_]|GT[-_]|BRT_|BLUECAVE|6338|ZEN[-_]?WIFI|WL[-_])"
#: Vendors, what goes before the model, where it stands, and what routers' models look like.
MODEL_NAMES = [
    ("asus", "", r"(?i)^FW_([A-Z0-9][A-Z0-9_\-]+?)_[\d.]", ASUS_ROUTERS),
    ("asus", "", r"(?i)^Rescue_([A-Z0-9][A-Z0-9_\-]+?)(?:_[\d]|-[A-Z0-9]+_[\d])", None),
    ("asus", "", r"(?i)^Asus-([A-Za-z0-9]+)-webflash", None),
    ("tp_link", "archer ", r"(?i)^Archer[_ ]?([A-Za-z0-9]+(?:[ \-][A-Za-z0-9]+)?)[\s(_]", None),
    ("tp_link", "", r"(?i)^((?:TL|TD)-[A-Z0-9]+)", None),
    ("tp_link", "", r"(?i)^([a-z]+-[a-z0-9]+?)(?:v\d+)?-webflash", None),
    ("netgear", "", r"(?i)^([A-Z][A-Z0-9]+?)(?:[-_](?:FW|Firmware|V\d)|_V\d|-V\d)", None),
]


def model_of_file(vendor: Column, name: Column) -> Column:
    """The model in a flat file name, by the first of the vendor's rules that matches;
    null if none does or the model is no router.
    """
    told = F.when(F.lit(False), F.lit(None).cast("string"))
    for maker, before, pattern, router in MODEL_NAMES:
        found = _found(name, pattern)
        model = F.translate(F.lower(F.concat(F.lit(before), F.trim(found))), "_ ", "--")
        told = told.when((vendor == maker) & found.isNotNull(), F.when(F.upper(found).rlike(router), model) if router else model)
    return told


def resolved_product(candidates: Column, vendor: Column, model: Column) -> Column:
    """struct<cpe_name, accepted>: the products of candidate names that are the
    vendor's model, generalised; the name if one of the preferred part (software
    before hardware) is left.
    """
    def generalised(c: Column) -> Column:
        return F.concat_ws(":", F.slice(F.split(c, ":"), 1, 5), F.lit(":".join(["*"] * 8)))

    def ours(c: Column) -> Column:
        p = product_of(c)
        same = p["part"].isin("o", "h") & (p["vendor"] == canonical(vendor)) & (p["product"] == canonical(model))
        return F.coalesce(same, F.lit(False))

    accepted = F.array_sort(F.array_distinct(F.transform(F.filter(candidates, ours), generalised)))
    software = F.filter(accepted, lambda c: F.get(F.split(c, ":"), 2) == "o")
    preferred = F.when(F.size(software) > 0, software).otherwise(accepted)
    return F.struct(F.when(F.size(preferred) == 1, F.get(preferred, 0)).alias("cpe_name"), accepted.alias("accepted"))
