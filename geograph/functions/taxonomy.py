"""Cluster facets of a node: type, subtype, era band, district and craft family."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import slug, text

# Cluster ids, names and the rules that lead to them.
ROOT = ("root-rajasthan", "Rajasthan")
GROUPS = {
    "tangible": ("heritage-tangible", "Tangible Heritage", "Physical monuments, architecture, and archaeological sites."),
    "intangible": ("heritage-intangible", "Intangible Heritage", "Performing arts, festivals, and living traditions."),
    "gastro": ("heritage-gastro", "Gastronomy & Craft", "GI-tagged foods, crafts, and culinary heritage."),
}
# By id, as it is read both ways: from a category to its subtype, and from the table to the list of known categories.
SUBTYPES = {
    "subtype-forts-castles": ("Forts & Castles", ["TANGIBLE_FORT", "TANGIBLE_CASTLE"]),
    "subtype-asi-protected": ("ASI Protected Monuments", ["TANGIBLE_ASI_PROTECTED"]),
    "subtype-city-gates": ("City Gates & Walls", ["TANGIBLE_CITY_GATE"]),
    "subtype-stepwells": ("Stepwells & Water Architecture", ["TANGIBLE_STEPWELL"]),
    "subtype-tombs-memorials": ("Tombs & Memorials", ["TANGIBLE_TOMB", "TANGIBLE_MEMORIAL"]),
    "subtype-archaeological": ("Archaeological Sites & Ruins", ["TANGIBLE_ARCHAEOLOGICAL_SITE", "TANGIBLE_RUINS"]),
    "subtype-manors-havelis": ("Manors & Havelis", ["TANGIBLE_MANOR"]),
    "subtype-shrines-temples": ("Shrines & Temples", ["TANGIBLE_WAYSIDE_SHRINE"]),
    "subtype-military-relics": ("Military & Colonial Relics", ["TANGIBLE_CANNON", "TANGIBLE_AIRCRAFT", "TANGIBLE_BOMB_CRATER"]),
    "subtype-general-monuments": ("General Monuments", ["TANGIBLE_HERITAGE", "TANGIBLE_MONUMENT", "TANGIBLE_BUILDING", "TANGIBLE_YES", "TANGIBLE_FOR"]),
    "subtype-festivals": ("Festivals", ["INTANGIBLE_FESTIVAL"]),
    "subtype-music": ("Music Traditions", ["INTANGIBLE_MUSIC"]),
    "subtype-dance": ("Dance Traditions", ["INTANGIBLE_DANCE"]),
    "subtype-craft-traditions": ("Craft Traditions", ["INTANGIBLE_CRAFT"]),
    "subtype-gi-tagged": ("GI-Tagged Handicrafts & Foods", ["GASTRONOMY_OR_CRAFT_GI_TAG"]),
    "subtype-food-heritage": ("Food Heritage", ["GASTRONOMY_HERITAGE"]),
    "subtype-food-festivals": ("Food Festivals", ["GASTRONOMY_FESTIVAL"]),
}
OTHER_SUBTYPE = "subtype-general-monuments"
CRAFTS = [
    ("craft-block-printing", "Block Printing Family", ["block printing", "hand block", "sanganeri", "bagru"]),
    ("craft-pottery", "Pottery & Ceramics", ["pottery", "clay work", "ceramic", "blue pottery"]),
    ("craft-puppetry", "Puppetry & String Arts", ["puppet", "kathputli"]),
    ("craft-textile-weave", "Textile & Weaving Family", ["doria", "phulkari", "weav", "textile", "print"]),
    ("craft-metal-enamel", "Metalwork & Enamel", ["thewa", "enamel", "metal work"]),
    ("craft-stone-carving", "Stone & Marble Carving", ["marble", "stone carving", "sculpture", "makrana"]),
    ("craft-painting-mural", "Painting & Mural Traditions", ["painting", "mural", "art work"]),
    ("craft-food-sweets", "Food & Confectionery Heritage", ["bhujia", "mehndi", "sangri", "sweet", "cuisine", "food"]),
]
ERAS = {
    "era-ancient": "Ancient Era (pre-7th century)",
    "era-early-medieval": "Early Medieval Era (7th–14th century)",
    "era-rajput-mughal": "Rajput & Mughal Era (15th–18th century)",
    "era-colonial": "Colonial Era (19th century)",
    "era-modern": "Modern Era (20th century–present)",
    "era-undated": "Undated Traditional Heritage",
}


def named(ids: Column, names: dict[str, str]) -> Column:
    """The name of each id."""
    return F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[ids]


def subtype_id(category: Column | str) -> Column:
    by_category = {c: k for k, (_, categories) in SUBTYPES.items() for c in categories}
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in by_category.items() for x in pair]), text(category)), F.lit(OTHER_SUBTYPE))


def craft_id(title: Column | str) -> Column:
    """Family of the first rule that has a keyword in the title; null if none has."""
    lower = F.lower(text(title))
    return F.coalesce(*[F.when(lower.rlike("|".join(words)), F.lit(k)) for k, _, words in CRAFTS])


def era_id(era: Column | str) -> Column:
    """Band of an era by the word 'ancient' or the century that it names."""
    century = F.regexp_extract(text(era), r"(?iU)(\d{1,2})(?:st|nd|rd|th)\s+century", 1).try_cast("int")
    return (
        F.when(text(era).rlike(r"(?iU)\bancient\b") | (century <= 6), "era-ancient")
        .when(century <= 14, "era-early-medieval")
        .when(century <= 18, "era-rajput-mughal")
        .when(century == 19, "era-colonial")
        .when(century.isNotNull(), "era-modern")
        .otherwise("era-undated")
    )


def district_id(district: Column | str) -> Column:
    return F.concat(F.lit("district-"), slug(district))


def facets(title: str = "title", category: str = "category", group: str = "heritage_group", era: str = "era", district: str = "district") -> Column:
    """All clusters of a node, as structs of cluster_id, name, kind, parent_id, description."""
    one = lambda i, n, kind, parent, note="": F.struct(i.alias("cluster_id"), n.alias("name"), F.lit(kind).alias("kind"), (parent if isinstance(parent, Column) else F.lit(parent).cast("string")).alias("parent_id"), (note if isinstance(note, Column) else F.lit(note)).alias("description"))
    known = F.when(F.col(group).isin(list(GROUPS)), F.col(group)).otherwise("tangible")
    heritage = F.concat(F.lit("heritage-"), known)
    subtype, craft, band = subtype_id(category), craft_id(title), era_id(era)
    found = F.array(
        one(F.lit(ROOT[0]), F.lit(ROOT[1]), "root", None),
        one(heritage, named(known, {k: v[1] for k, v in GROUPS.items()}), "heritage_type", ROOT[0], named(known, {k: v[2] for k, v in GROUPS.items()})),
        one(subtype, named(subtype, {k: v[0] for k, v in SUBTYPES.items()}), "subtype", heritage),
        one(band, named(band, ERAS), "era_band", ROOT[0]),
        F.when(text(district) != "", one(district_id(district), F.initcap(F.col(district)), "district", ROOT[0])),
        F.when(craft.isNotNull(), one(craft, named(craft, {k: n for k, n, _ in CRAFTS}), "craft_family", None)),
    )
    return F.array_compact(found)
