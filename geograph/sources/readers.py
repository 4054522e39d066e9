"""Readers of feeds and saved payloads."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, event_title, padded, strip, text
from .html_tree import Element, Page, read_pages
from .schemas import BINDINGS, ELEMENTS, POI, RAW_NODES


def read_nodes_json(spark: SparkSession, path: str) -> DataFrame:
    """Nodes in a JSON array. A missing file is an error."""
    return spark.read.schema(RAW_NODES).json(path, multiLine=True)


def read_poi_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=POI)


def read_bindings(spark: SparkSession, path: str) -> DataFrame:
    return flatten_bindings(spark.read.schema(BINDINGS).json(path, multiLine=True))


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    return flatten_elements(spark.read.schema(ELEMENTS).json(path, multiLine=True))


def flatten_bindings(df: DataFrame, *keep: str) -> DataFrame:
    """The columns of keep, pos, label, coord, image of each query binding; a missing label is 'Unknown Site', the rest empty."""
    rows = df.select(*keep, F.posexplode("results.bindings").alias("pos", "b"))
    return rows.select(*keep, "pos", strip(F.coalesce("b.itemLabel.value", F.lit("Unknown Site"))).alias("label"), text("b.coord.value").alias("coord"), text("b.image.value").alias("image"))


def flatten_elements(df: DataFrame, *keep: str) -> DataFrame:
    """The columns of keep, pos, label, historic, lat, lng of each map element. Where an element's own
    coordinate is null or zero its centre's counts."""
    rows = df.select(*keep, F.posexplode("elements").alias("pos", "e"))
    pick = lambda own, centre: F.coalesce(F.nullif(F.col(own), F.lit(0.0)), F.col(centre))
    tag = lambda name: F.try_element_at(F.col("e.tags"), F.lit(name))
    return rows.select(*keep, "pos", strip(text(tag("name"))).alias("label"), F.coalesce(tag("historic"), F.lit("heritage site")).alias("historic"), pick("e.lat", "e.center.lat").alias("lat"), pick("e.lon", "e.center.lon").alias("lng"))


def elements(pages: DataFrame, tags: list[str], class_pattern: str | None = None, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id, pos, tag, inner, text of each element of the given tags whose class fits the
    pattern, in page order; elements inside others have rows of their own."""
    names, pattern = frozenset(tags), class_pattern and re.compile(class_pattern, re.I)

    def found(page: Page) -> Iterator[tuple]:
        for pos, e in enumerate(page.inside(None, names, pattern)):
            yield pos, e.tag, page.inner(e), page.text(e)

    return read_pages(pages, found, "pos int, tag string, inner string, text string", id_col, html_col).withColumn("text", strip(F.col("text")))


_PARTS, _CELLS = frozenset(["thead", "tbody", "tfoot"]), frozenset(["td", "th"])


def _rows_of(page: Page, table: Element, own: bool) -> Iterator[list[Element]]:
    """The cells of each row of a table; see table_rows()."""
    if not own:
        yield from (list(page.inside(row, _CELLS)) for row in page.inside(table, frozenset(["tr"])))
        return
    for part in table.children:
        for row in [part] if part.tag == "tr" else page.inside(part, frozenset(["tr"])) if part.tag in _PARTS else []:
            yield [e for e in row.children if e.tag in _CELLS]


def table_rows(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", class_name: str | None = None, own: bool = True) -> DataFrame:
    """id, table, row, cells of each row of each table of a class. With `own` a table's rows
    are its children and what its head, body and foot hold, and a row's cells its
    children; else all rows and cells inside, those of tables in cells too."""

    def layout(page: Page) -> list:
        tables = [e for e in page.inside(None, frozenset(["table"])) if class_name is None or class_name in e.classes()]
        return [(n, k, cells) for n, table in enumerate(tables) for k, cells in enumerate(_rows_of(page, table, own))]

    def found(page: Page, rows: list) -> Iterator[tuple]:
        return ((n, k, page.stripped(cells)) for n, k, cells in rows)

    return read_pages(pages, found, "table int, row int, cells array<string>", id_col, html_col, layout)


def extract_table_rows(pages: DataFrame, name_header: str, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id, pos, values (header -> cell) of the first table's rows; headers are stripped,
    and rows whose named cell is blank or 'nan' are left out. A page is read once, and its
    rows leave the task with their headers."""

    def layout(page: Page) -> list:
        first = next(page.inside(None, frozenset(["table"])), None)
        return [] if first is None else list(_rows_of(page, first, True))

    def found(page: Page, rows: list) -> Iterator[tuple]:
        heads = page.stripped(rows[0]) if rows else []
        return ((k, heads, page.stripped(cells)) for k, cells in enumerate(rows[1:]))

    filled = read_pages(pages, found, "pos int, heads array<string>, cells array<string>", id_col, html_col, layout)
    n = F.least(F.size("heads"), F.size("cells"))
    values = F.map_from_arrays(F.slice("heads", 1, n), F.slice("cells", 1, n))
    out = filled.select(id_col, "pos", values.alias("values"))
    name = text(F.try_element_at("values", F.lit(name_header)))
    return out.where(~name.isin("", "nan"))


def extract_filtered_rows(pages: DataFrame, term: str, class_name: str = "wikitable", id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id, table, pos, name, kind of the rows, but for headers, of all tables of a class
    that name the term and have four cells at least. A name of digits alone stands
    one cell too far left where there is a fifth."""
    rows = table_rows(pages, id_col, html_col, class_name, own=False).where("row > 0")
    kept = rows.where(F.contains(F.array_join("cells", " | "), F.lit(term)) & (F.size("cells") >= 4))
    shift = F.when(F.get("cells", F.lit(2)).rlike(r"^\d+$") & (F.size("cells") > 4), 1).otherwise(0)
    return kept.select(id_col, "table", (F.col("row") - 1).alias("pos"), F.get("cells", shift + 2).alias("name"), F.upper(F.get("cells", shift + 3)).alias("kind"))


def first_rows(df: DataFrame, key: Column, *order: str) -> DataFrame:
    """The first row of each key, in the given order."""
    from pyspark.sql.window import Window

    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def extract_blocks(pages: DataFrame, tags: list[str] = ("h3", "h4", "div"), class_pattern: str | None = "title|heading|fest", words: tuple[str, str] = ("Festival", "Fair"), id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id, pos, title of heading-like blocks: over four characters and the first word in
    it, or the second word in it, however short. A title stays once, where it comes first."""
    blocks = elements(pages, list(tags), class_pattern, id_col, html_col).select(id_col, "pos", F.col("text").alias("title"))
    event = ((F.length("title") > 4) & F.contains("title", F.lit(words[0]))) | F.contains("title", F.lit(words[1]))
    return first_rows(blocks.where(event), F.col("title"), id_col, "pos")


# What a card says that describes nothing.
NO_DESCRIPTION = "A cultural event officially listed on the Rajasthan Tourism portal."


def extract_cards(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id, pos, title, description, summary of event cards; a page without cards gives
    its h2 and h3 headings instead. A card's title is its first heading, link or
    strong text, its description its first paragraph or span, however deep they
    lie. Titles are cleaned, and each stays once, whatever its case, where it comes
    first."""
    kinds, fitting = frozenset(["div", "article", "li"]), re.compile("card|item|fest|event", re.I)
    titles, texts = frozenset(["h3", "h4", "a", "strong"]), frozenset(["p", "span"])

    def found(page: Page) -> Iterator[tuple]:
        cards = list(page.inside(None, kinds, fitting)) or page.inside(None, frozenset(["h2", "h3"]))
        for pos, e in enumerate(cards):
            title = page.first_text(e, titles)
            yield pos, page.text(e) if title is None else title, page.first_text(e, texts)

    both = read_pages(pages, found, "pos int, raw string, described string", id_col, html_col)
    read = both.select(id_col, "pos", event_title(strip(F.col("raw"))).alias("title"), F.coalesce(strip(F.col("described")), F.lit(NO_DESCRIPTION)).alias("description"))
    short = F.when(F.length("description") > 150, F.concat(F.substring("description", 1, 150), F.lit("..."))).otherwise(F.col("description"))
    return first_rows(read.where("title is not null").withColumn("summary", short), F.lower("title"), id_col, "pos")


# Each feed's wording. {0} stands for the label, {1} for the kind in lower case, {2} for a second part.
FEEDS = {
    "csv": ("IN-RJ-CSV-", 3, "TANGIBLE_HERITAGE", "Historical Heritage", "A prominent cultural landmark known as {0}.", "Local Rajasthani art and traditions.", "{0} stands as an important monument.", "Wikimedia Commons", "verified", "Part of the wider architectural network."),
    "wiki": ("IN-RJ-WIKI-", 3, "TANGIBLE_HERITAGE", "Historical Database", "A prominent architectural landmark located in Rajasthan.", "Rajasthani architecture and traditions.", "{0} stands as an important node in India's cultural grid.", "Wikimedia Commons", "verified", "Architecturally linked to Rajputana defensive network."),
    "osm": ("IN-RJ-OSM-", 4, "TANGIBLE_{3}", "Local Heritage", "A local {1} documented by open-source ground mapping.", "Deep regional heritage.", "This {1} represents the grassroots cultural infrastructure of Rajasthan.", "OpenStreetMap Contributors", "community_verified", "Part of the local micro-heritage network."),
    "asi": ("IN-RJ-ASI-", 3, "TANGIBLE_ASI_PROTECTED", "Government Protected Antiquity", "A centrally protected monument located in the {2} district.", "Regional heritage of {2}.", "Officially gazetted by the Archaeological Survey of India (ASI) Jaipur Circle. Locality: {1}.", "ASI Jaipur Circle", "government_verified", "Included in the Central Protected Monuments national registry."),
    "gi": ("IN-RJ-GI-", 3, "GASTRONOMY_OR_CRAFT_GI_TAG", "Traditional Heritage", "A legally protected Geographical Indication (GI) from Rajasthan.", "Deep regional heritage.", "Registered under the Geographical Indications of Goods Act. Type: {3}.", "Wikipedia/GI Registry", "government_verified", "Recognized for unique qualities derived from its geographical origin."),
    "festival": ("IN-RJ-LIVE-FEST-", 3, "INTANGIBLE_FESTIVAL", "Annual Cultural Event", "A cultural event officially listed on the Rajasthan Tourism portal.", "", "Live-scraped from tourism.rajasthan.gov.in.", "Rajasthan Tourism", "government_verified", "Automated pipeline extraction from official state directories."),
}


def map_feed(df: DataFrame, feed: str) -> DataFrame:
    """Rows of a feed (pos, label, lat, lng, image, kind, second) as raw nodes, by the
    feed's wording. Columns that the feed does not have count as missing. The number
    in the id is the row's place in the feed, so that gaps show what was left out.
    The map feed leaves out rows without label or with a zero coordinate."""
    prefix, width, *wording = FEEDS[feed]
    has = lambda name, kind="string": F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)
    label, kind, second = text("label"), text(has("kind")), text(has("second"))

    def fill(template: str) -> Column:
        c = F.lit(template)
        lower = kind if feed == "asi" else F.lower(kind)
        for mark, value in (("{0}", label), ("{1}", lower), ("{2}", second), ("{3}", F.upper(kind))):
            if mark in template:
                c = F.replace(c, F.lit(mark), value)
        return c

    category, era, famous, nearby, details, attribution, trust, link = (fill(x) for x in wording)
    name = F.substring(F.regexp_replace(F.upper(label), "[^A-Z0-9]", ""), 1, 10)
    number = padded(F.col("pos"), width)
    node_id = F.concat(F.lit(prefix), name, F.lit("-"), number) if feed == "gi" else F.concat(F.lit(prefix), number)
    point = F.when(has("lat", "double").isNotNull() & has("lng", "double").isNotNull(), F.struct(has("lat", "double").alias("lat"), has("lng", "double").alias("lng")))
    located = F.concat_ws(", ", has("kind"), has("second")) if feed == "asi" else F.lit("Rajasthan") if feed in ("gi", "festival") else F.lit(None).cast("string")
    out = df.select(
        F.col("pos").cast("long").alias("pos"), node_id.alias("node_id"), label.alias("title"), category.alias("category"), point.alias("coordinates"), located.alias("location_text"), era.alias("era"), famous.alias("famous_for"),
        blank_to_null(nearby).alias("nearby_culture"), details.alias("docent_details"), F.struct(text(has("image")).alias("photo_url"), attribution.alias("attribution")).alias("media"), trust.alias("trust_status"), F.array(F.struct(link.alias("connection"))).alias("synapses"),
    )
    if feed == "osm":
        out = out.where((F.col("title") != "") & (F.coalesce("coordinates.lat", F.lit(0.0)) != 0) & (F.coalesce("coordinates.lng", F.lit(0.0)) != 0))
    if feed == "wiki":
        out = out.where(~F.col("title").rlike("^Q[0-9]+$"))
    return out
