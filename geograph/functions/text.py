"""Column functions that read facts out of templated node texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and patterns that results depend on.
KNOWN_PLACES = [
    "jaipur", "jodhpur", "udaipur", "jaisalmer", "bikaner", "ajmer", "kota", "bharatpur", "alwar", "bundi", "chittorgarh", "pali",
    "sikar", "nagaur", "dungarpur", "banswara", "barmer", "jhunjhunu", "jalore", "sirohi", "tonk", "dausa", "karauli", "dholpur",
    "bhilwara", "rajsamand", "pratapgarh", "churu", "hanumangarh", "ganganagar", "baran", "jhalawar", "sawai madhopur", "bagru",
    "sanganer", "pushkar", "nathdwara", "osian", "ranakpur", "deshnoke", "kumbhalgarh", "mandawa", "shekhawati", "abu", "mount abu",
    "kuldhara", "pokaran", "tijara",
]
GENERIC_TITLE_WORDS = [
    "fort", "forts", "fortress", "temple", "temples", "monument", "monuments", "gate", "gates", "palace", "palaces", "haveli",
    "havelis", "chhatri", "chhatris", "ruins", "memorial", "memorials", "museum", "museums", "tomb", "tombs", "shrine", "shrines",
    "castle", "castles", "building", "buildings", "statue", "statues", "inscriptions", "old", "ancient", "historic", "historical",
    "house", "wall", "walls", "city", "garden", "gardens", "well", "stepwell", "step",
]
STOP_WORDS = [
    "a", "an", "the", "of", "in", "on", "at", "to", "for", "and", "or", "with", "by", "is", "are", "was", "were", "this", "that",
    "these", "those", "its", "it", "as", "from", "near",
]
GENERIC_ERAS = ["local heritage", "government protected antiquity", "historical database", "historical heritage", "traditional heritage", "annual cultural event"]
DISTRICT = r"(?iU)located in the ([A-Za-z\s]+?) district"
ORIGIN = r"(?i)officially originates from ([^.]+)\."
TYPE = r"(?U)Type:\s*([A-Z\s]+)\."
BOILERPLATE = [
    r"^A local .+ documented by open-source ground mapping\.$",
    r"^A prominent (architectural|cultural) landmark",
    r"^A centrally protected monument located in the .+ district\.$",
    r"represents the grassroots cultural infrastructure of Rajasthan\.?$",
    r"stands as an important (node|monument)",
    r"^A legally protected Geographical Indication",
    r"^Registered under the Geographical Indications of Goods Act\.",
]
KEPT_UPPER = ["ASI", "GI"]


def text(c: Column | str) -> Column:
    """A column with null as empty."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(""))


def strip(c: Column) -> Column:
    """Without white space, of any kind, at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def tokens(c: Column | str) -> Column:
    """Lower-case words of letters and digits, three characters at least, without stop words; repeats stay."""
    words = F.split(F.regexp_replace(F.lower(text(c)), r"(?U)[^a-z0-9\s]", " "), r"(?U)\s+")
    return F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(STOP_WORDS))


def title_tokens(c: Column | str) -> Column:
    """Distinct tokens of four characters at least that are no generic title word."""
    return F.array_distinct(F.filter(tokens(c), lambda w: (F.length(w) >= 4) & ~w.isin(GENERIC_TITLE_WORDS)))


def first_known_place(c: Column) -> Column:
    places = F.array(*[F.lit(p) for p in KNOWN_PLACES])
    return F.get(F.filter(places, lambda p: F.contains(c, p)), F.lit(0))


def place(title: Column | str, famous_for: Column | str, details: Column | str) -> Column:
    """District named in famous_for; else the origin named in the details, as a known
    place if it holds one; else the first known place in the title; else null."""
    district = blank_to_null(F.lower(strip(F.regexp_extract(text(famous_for), DISTRICT, 1))))
    origin = blank_to_null(F.lower(strip(F.regexp_extract(text(details), ORIGIN, 1))))
    return F.coalesce(district, first_known_place(origin), origin, first_known_place(F.lower(text(title))))


def gi_type(details: Column | str) -> Column:
    return blank_to_null(F.lower(strip(F.regexp_extract(text(details), TYPE, 1))))


def specific_era(era: Column | str) -> Column:
    trimmed = strip(text(era))
    return F.when((trimmed != "") & ~F.lower(trimmed).isin(GENERIC_ERAS), trimmed)


def is_boilerplate(famous_for: Column | str, details: Column | str) -> Column:
    """True if a text matches a template, or both together have under 40 characters."""
    fields = [text(famous_for), text(details)]
    hit = reduce(lambda a, b: a | b, [f.rlike(f"(?i){p}") for f in fields for p in BOILERPLATE])
    return hit | (F.length(strip(F.concat_ws(" ", *fields))) < 40)


def normal_title(title: Column | str) -> Column:
    """Lower case without bracketed parts, signs and needless space; may be empty."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text(title)), r"\(.*?\)", ""), r"(?U)[^a-z0-9\s]", "")
    return F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))


def group_of(category: Column | str) -> Column:
    upper = F.upper(text(category))
    return F.when(upper.startswith("INTANGIBLE"), "intangible").when(upper.startswith("GASTRONOMY"), "gastro").otherwise("tangible")


def pretty_category(category: Column | str) -> Column:
    """Words of a category, each capitalised but for known abbreviations; a missing one is a heritage site."""
    c = text(category)
    words = F.transform(F.split(c, "_"), lambda w: F.when(w.isin(KEPT_UPPER), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 20)))))
    return F.when(c == "", "Heritage Site").otherwise(F.array_join(words, " "))


def slug(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def community_id(title: Column | str, submission_id: Column | str) -> Column:
    """Node id of a submission; the suffix is a digest of its id, so that a retry gives the same."""
    return F.concat(F.lit("community-"), F.substring(slug(title), 1, 40), F.lit("-"), F.substring(F.sha2(F.col(submission_id) if isinstance(submission_id, str) else submission_id, 256), 1, 6))


def code_id(prefix: str, title: Column | str, index: Column, width: int = 3) -> Column:
    """prefix-TITLE-007: up to ten letters and digits of the title, and a padded number."""
    return F.concat(F.lit(prefix), F.substring(F.regexp_replace(F.upper(text(title)), "[^A-Z0-9]", ""), 1, 10), F.lit("-"), padded(index, width))


def padded(index: Column, width: int) -> Column:
    """A number with leading zeros, never cut."""
    digits = index.cast("string")
    return F.when(F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits)


def wkt_point(c: Column | str) -> tuple[Column, Column]:
    """(longitude, latitude) of 'Point(lng lat)', null where there is none."""
    pattern = r"(?U)Point\(([-\d\.]+)\s+([-\d\.]+)\)"
    return tuple(F.regexp_extract(text(c), pattern, i).try_cast("double") for i in (1, 2))


def event_title(title: Column | str) -> Column:
    """A cleaned event title, or null where the text is none: too long, a banner, not an
    event word, or nothing left."""
    raw = text(title)
    banner = F.contains(F.upper(raw), F.lit("FESTIVALS")) & (F.size(F.filter(F.split(raw, r"(?U)\s+"), lambda w: w != "")) > 6)
    clean = strip(F.replace(strip(F.regexp_replace(raw, r"(?U)[-–—]\s*\d{4}.*", "")), F.lit("FESTIVALS"), F.lit("")))
    event = raw.rlike("Festival|Fair|Utsav")
    return F.when((F.length(raw) <= 50) & ~banner & event & (F.length(clean) >= 3), clean)
