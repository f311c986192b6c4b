"""Facets of a path: jurisdiction, tier, code family, edition year, and their labels.

Paths follow fixed grammars by first folder; everything is a column expression, and the
location table is small by its nature.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from spindrift.functions.text import text_of, year_in

# Tiers by location key, default location, display names, local jurisdictions.
LOCATION_TIERS = {
    "durham-nc": ("model", "federal", "state", "local-durham", "other"),
    "alamance-county-nc": ("model", "federal", "state", "local-alamance", "other"),
    "burlington-nc": ("model", "federal", "state", "local-burlington", "other"),
    "graham-nc": ("model", "federal", "state", "local-graham", "other"),
    "alamance-towns-nc": ("model", "federal", "state", "local-alamance-towns", "other"),
    "north-carolina": ("model", "federal", "state", "other"),
    "model": ("model",),
}
DEFAULT_LOCATION = "durham-nc"
MODEL_NAMES = {
    "ibc": "IBC", "irc": "IRC", "ipc": "IPC", "imc": "IMC", "ifgc": "IFGC", "ifc": "IFC", "iebc": "IEBC", "iecc": "IECC",
    "iecc-ashrae": "IECC + ASHRAE 90.1", "ipmc": "IPMC", "iccpc": "ICCPC", "ipsdc": "IPSDC", "ispsc": "ISPSC",
    "iwuic": "IWUIC", "izc": "IZC", "igcc": "IGCC",
}
STATE_NAMES = {
    "ncbc": "NC Building Code", "ncrc": "NC Residential Code", "ncpc": "NC Plumbing Code", "ncmc": "NC Mechanical Code",
    "ncfgc": "NC Fuel Gas Code", "ncfc": "NC Fire Prevention Code", "ncebc": "NC Existing Building Code",
    "ncecc": "NC Energy Conservation Code", "ncapc": "NC Administrative Code",
}
LOCAL_NAMES = {"alamance": "Alamance County", "alamance-towns": "Alamance County town", "burlington": "City of Burlington", "graham": "City of Graham"}
YEAR = r"(?:19|20)\d{2}"


def _lookup(names: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*map(F.lit, chain(*names.items()))), key)


def tier(juris: Column | str) -> Column:
    """Regulatory tier of a jurisdiction; ``other`` if no rule knows it."""
    j = F.lower(F.trim(text_of(juris)))
    return (
        F.when(j.isin("model", "federal"), j)
        .when(j.isin("north-carolina", "nc-state", "ncdot") | j.startswith("nc-") | j.startswith("nc_"), "state")
        .when(j.startswith("durham"), "local-durham")
        .when(j == "alamance-towns", "local-alamance-towns")
        .when(j.startswith("alamance"), "local-alamance")
        .when(j.isin("burlington", "graham"), F.concat(F.lit("local-"), j))
        .otherwise("other")
    )


def location_table(spark: SparkSession) -> DataFrame:
    """``location, tier``: which tiers apply in which place."""
    rows = [(k, t) for k, tiers in LOCATION_TIERS.items() for t in tiers]
    return spark.createDataFrame(rows, "location string, tier string")


def location_key(key: Column | str) -> Column:
    """A known key in lower case; any other stands for the default location."""
    k = F.lower(F.trim(text_of(key)))
    return F.when(k.isin(*LOCATION_TIERS), k).otherwise(DEFAULT_LOCATION)


def location_allows(key: Column | str, juris: Column | str) -> Column:
    tiers = F.create_map(*chain(*[(F.lit(k), F.array(*map(F.lit, t))) for k, t in LOCATION_TIERS.items()]))
    return F.array_contains(F.element_at(tiers, location_key(key)), tier(juris))


def _dashes(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def _stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=[^.])\.[^.]*$", "")


def facet_columns(path: Column | str, edition: Column | str) -> dict[str, Column]:
    """``jurisdiction, family, year, doc_key, doc_label`` of a path; year may be null."""
    p = F.ltrim(F.translate(text_of(path), "\\", "/"), F.lit("/"))
    parts = F.split(p, "/")
    n = F.size(parts)
    seg = lambda i: F.coalesce(F.get(parts, F.lit(i)), F.lit(""))
    juris, last = F.get(parts, F.lit(0)), F.lower(F.element_at(parts, -1))
    dated = (n >= 3) & seg(1).rlike(f"^{YEAR}$")
    file = F.lower(seg(1))
    own = F.when(file.contains("international_building_code") | file.rlike(r"\bibc\b"), "ibc").otherwise(_dashes(_stem(file)))
    word = F.regexp_extract(seg(1), "^[a-zA-Z]+", 0)
    local = F.when(n > 1, F.nullif(_dashes(_stem(last)), F.lit("")))
    family = (
        F.when(juris == "model", F.when(dated, F.lower(seg(2))).otherwise(own))
        .when(juris == "north-carolina", F.lower(F.when(word != "", word).otherwise(seg(1))))
        .when(juris == "durham", "udo")
        .when(juris.isin(*LOCAL_NAMES), F.coalesce(local, juris))
        .otherwise(F.when(n > 1, F.lower(seg(1))).otherwise(juris))
    )
    stated = F.coalesce(year_in(edition), year_in(p))
    year = (
        F.when(juris == "model", F.when(dated, seg(1)).otherwise(year_in(seg(1))))
        .when(juris == "north-carolina", F.coalesce(year_in(seg(1)), F.lit("2024")))
        .when(juris.isin(*LOCAL_NAMES), F.coalesce(year_in(F.when(n > 1, F.element_at(parts, -1))), stated))
        .otherwise(stated)
    )
    key = F.concat(juris, F.lit(":"), family)
    return {"jurisdiction": juris, "family": family, "year": year, "doc_key": key, "doc_label": doc_label(juris, family, edition)}


def facet(path: Column | str, edition: Column | str) -> Column:
    """:func:`facet_columns` as a struct."""
    return F.struct(*[c.alias(n) for n, c in facet_columns(path, edition).items()])


def doc_label(juris: Column, family: Column, edition: Column | str) -> Column:
    """A document's name without its edition."""
    e = text_of(edition)
    bare = F.regexp_replace(F.regexp_replace(e, rf"\b{YEAR}\b", ""), "^[ :-]+|[ :-]+$", "")
    pretty = F.initcap(F.trim(F.replace(family, F.lit("-"), F.lit(" "))))
    place = _lookup(LOCAL_NAMES, juris)
    return (
        F.when(juris == "model", F.concat(F.coalesce(_lookup(MODEL_NAMES, family), F.upper(family)), F.lit(" (model)")))
        .when(juris == "north-carolina", F.coalesce(_lookup(STATE_NAMES, family), F.concat(F.lit("NC "), F.upper(family))))
        .when(juris == "durham", "Durham UDO")
        .when(place.isNotNull(), F.concat_ws(" — ", place, F.nullif(pretty, F.lit(""))))
        .when(e != "", F.coalesce(F.nullif(bare, F.lit("")), e))
        .otherwise(F.upper(family))
    )


def corpus_versions(chunks: DataFrame) -> DataFrame:
    """Documents of a corpus (``path, edition``) with their years, latest first; ``versioned`` if there are several."""
    f = chunks.select("path", "edition").distinct().select(facet("path", "edition").alias("f"), "path").select("f.*", "path")
    return f.groupBy("doc_key").agg(
        F.min_by("doc_label", "path").alias("doc_label"),
        F.first("jurisdiction").alias("jurisdiction"),
        F.first("family").alias("family"),
        F.sort_array(F.collect_set("year"), asc=False).alias("years"),
        F.max("year").alias("default_year"),
        (F.countDistinct("year") > 1).alias("versioned"),
    )


def resolve_versions(versions: DataFrame, overrides: DataFrame) -> DataFrame:
    """``doc_key, year`` for versioned documents: the override (``doc_key, wanted``) if the document has it, else the latest."""
    v = versions.filter("versioned").join(overrides.select("doc_key", "wanted"), "doc_key", "left")
    good = F.array_contains("years", F.col("wanted"))
    return v.select("doc_key", F.when(good, F.col("wanted")).otherwise(F.col("default_year")).alias("year"))
