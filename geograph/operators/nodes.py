"""Nodes: normalising, de-duplicating, facets, photos, prompts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from ..functions import taxonomy
from ..functions.text import blank_to_null, gi_type, group_of, is_boilerplate, normal_title, place, pretty_category, specific_era, strip, text

# Photos by the first of these words in the category, in this order.
PHOTO_WORDS = [("ASI", "ASI"), ("GI_TAG", "GI_TAG"), ("GASTRONOMY", "GASTRONOMY"), ("INTANGIBLE", "INTANGIBLE"), ("FESTIVAL", "INTANGIBLE"), ("TANGIBLE", "TANGIBLE")]
FILE_PATH = "https://commons.wikimedia.org/wiki/Special:FilePath/"
PHOTOS = {
    "TANGIBLE": FILE_PATH + "Amber_Fort_Jaipur_Rajasthan.jpg",
    "ASI": FILE_PATH + "Hawa_Mahal_2013.jpg",
    "GI_TAG": FILE_PATH + "Blue_pottery_of_Jaipur.jpg",
    "GASTRONOMY": FILE_PATH + "Dal_Baati_Churma.jpg",
    "INTANGIBLE": FILE_PATH + "Kalbelia.jpg",
    "DEFAULT": FILE_PATH + "Mehrangarh_Fort_Jodhpur.jpg",
}
#: Where things of no known place are put.
STATE_CENTRE = (26.58, 73.84, "Rajasthan (Statewide)")


def normalize_nodes(raw: DataFrame) -> DataFrame:
    """Raw nodes as rows of the node table. Rows without id or with a null coordinate go;
    empty texts count as missing; a coordinate of 0 stays."""
    famous, details, title = text("famous_for"), text("docent_details"), F.coalesce(blank_to_null("title"), F.lit("Untitled Node"))
    category = F.coalesce(blank_to_null("category"), F.lit("TANGIBLE_HERITAGE"))
    usable = raw.where(F.col("coordinates.lat").isNotNull() & F.col("coordinates.lng").isNotNull() & (text("node_id") != ""))
    return usable.select(
        "node_id",
        title.alias("title"),
        category.alias("category"),
        group_of(category).alias("heritage_group"),
        blank_to_null("era").alias("era"),
        place(title, famous, details).alias("district"),
        gi_type(details).alias("gi_type"),
        F.col("coordinates.lat").alias("latitude"),
        F.col("coordinates.lng").alias("longitude"),
        blank_to_null("famous_for").alias("famous_for"),
        blank_to_null("docent_details").alias("docent_details"),
        blank_to_null("nearby_culture").alias("nearby_culture"),
        F.coalesce(blank_to_null("docent_details"), blank_to_null("famous_for"), F.concat(title, F.lit(" is a documented cultural node in Rajasthan."))).alias("content"),
        F.lit("original").alias("content_source"),
        F.coalesce(blank_to_null("trust_status"), F.lit("verified")).alias("trust_status"),
        F.lit(None).cast("string").alias("merged_into"),
        blank_to_null(strip(text("media.photo_url"))).alias("photo_url"),
    )


def flatten_nodes(raw: DataFrame) -> DataFrame:
    """Raw nodes with flat names, for display and linking."""
    return raw.select(
        F.col("node_id").alias("id"), "title", "category", group_of("category").alias("heritage_group"), F.col("coordinates.lat").alias("lat"), F.col("coordinates.lng").alias("lng"), "era", "famous_for", "nearby_culture", "docent_details", F.col("trust_status").alias("trust"), F.col("media.photo_url").alias("photo")
    )


def with_facts(nodes: DataFrame) -> DataFrame:
    """nodes with place, era_fact, gi_fact and norm_title, read from their texts."""
    return nodes.withColumns({"place": place("title", "famous_for", "docent_details"), "era_fact": specific_era("era"), "gi_fact": gi_type("docent_details"), "norm_title": normal_title("title")})


def first_per_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order, as the feeds were read."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def add_unseen(base: DataFrame, feed: DataFrame, order: list[str]) -> DataFrame:
    """base and the feed's rows whose title, whatever its case, is neither in base nor
    earlier in the feed."""
    lower = lambda df: df.withColumn("_t", F.lower("title"))
    new = first_per_key(lower(feed), ["_t"], order).join(lower(base).select("_t").distinct(), "_t", "left_anti").drop("_t")
    return base.unionByName(new, allowMissingColumns=True)


def title_dedupe(nodes: DataFrame, id_col: str = "node_id", title_col: str = "title") -> DataFrame:
    """nodes with `canonical`, the least id with the same normal title, and `is_merged`.
    Titles that are empty when normal stand alone. The least id comes from an
    aggregate and a join rather than a window, so that a title shared by many nodes
    is reduced before it moves."""
    titled = nodes.withColumn("_norm", normal_title(title_col))
    least = titled.where("_norm <> ''").groupBy("_norm").agg(F.min(id_col).alias("_least"))
    found = titled.join(least, "_norm", "left")
    return found.withColumn("canonical", F.coalesce("_least", id_col)).withColumn("is_merged", F.col("canonical") != F.col(id_col)).drop("_norm", "_least")


def merge_titles(nodes: DataFrame) -> DataFrame:
    """The node table with title duplicates marked; nodes merged before stay as they are."""
    found = title_dedupe(nodes.where("merged_into is null"))
    marked = found.withColumns({"merged_into": F.when(F.col("is_merged"), F.col("canonical")), "trust_status": F.when(F.col("is_merged"), F.lit("merged_duplicate")).otherwise(F.col("trust_status"))})
    return marked.drop("canonical", "is_merged").unionByName(nodes.where("merged_into is not null"))


def memberships(nodes: DataFrame) -> DataFrame:
    """node_id and each cluster that the node belongs to, with the cluster's own columns."""
    return nodes.select("node_id", F.explode(taxonomy.facets()).alias("c")).select("node_id", "c.*")


def build_clusters(members: DataFrame) -> DataFrame:
    """One row a cluster. Where nodes name different parents, that of the greatest node
    id holds. The fixed root and group clusters are there even without nodes."""
    spark = members.sparkSession
    fixed = spark.createDataFrame([(*taxonomy.ROOT, "root", None, "")] + [(i, n, "heritage_type", taxonomy.ROOT[0], d) for i, n, d in taxonomy.GROUPS.values()], "cluster_id string, name string, kind string, parent_id string, description string")
    rows = members.groupBy("cluster_id").agg(F.max_by(F.struct("name", "kind", "parent_id", "description"), "node_id").alias("c")).select("cluster_id", "c.*")
    return rows.unionByName(fixed.join(rows.select("cluster_id"), "cluster_id", "left_anti"))


def node_subtype(nodes: DataFrame, members: DataFrame, clusters: DataFrame) -> DataFrame:
    """nodes with the id and name of their subtype cluster, by membership, else by rule."""
    own = members.join(clusters.where("kind = 'subtype'").select("cluster_id", "name"), "cluster_id").groupBy("node_id").agg(F.min(F.struct("cluster_id", "name")).alias("s"))
    rule = taxonomy.subtype_id("category")
    names = {k: v[0] for k, v in taxonomy.SUBTYPES.items()}
    return nodes.join(own, "node_id", "left").withColumns({"subtype_id": F.coalesce("s.cluster_id", rule), "subtype_name": F.coalesce("s.name", taxonomy.named(rule, names))}).drop("s")


def enrich_candidates(nodes: DataFrame, limit: int | None = None) -> DataFrame:
    """Active nodes, not rewritten yet, whose texts are boilerplate."""
    found = nodes.where("merged_into is null and content_source <> 'ai_enriched'").where(is_boilerplate("famous_for", "docent_details"))
    return found.orderBy("node_id").limit(limit) if limit else found


def embed_pending(nodes: DataFrame) -> DataFrame:
    return nodes.where("merged_into is null and vector_embedding is null")


def apply_rewrites(nodes: DataFrame, rewrites: DataFrame) -> DataFrame:
    """New descriptions (node_id, description) as content; the vector is dropped, so that
    the node is embedded again. Blank descriptions do nothing."""
    new = rewrites.select("node_id", strip(text("description")).alias("_new")).where("_new <> ''")
    both = nodes.join(new, "node_id", "left")
    hit = F.col("_new").isNotNull()
    return both.withColumns({"content": F.coalesce("_new", "content"), "content_source": F.when(hit, F.lit("ai_enriched")).otherwise(F.col("content_source")), "vector_embedding": F.when(~hit, F.col("vector_embedding"))}).drop("_new")


def fill_photo(nodes: DataFrame, photos: dict[str, str] = PHOTOS, only_empty: bool = True) -> DataFrame:
    """photo_url by the category's first word of PHOTO_WORDS, for nodes without a photo or for all."""
    c = F.upper(text("category"))
    picked = F.coalesce(*[F.when(F.contains(c, F.lit(w)), F.lit(photos[k])) for w, k in PHOTO_WORDS], F.lit(photos["DEFAULT"]))
    return nodes.withColumn("photo_url", F.when(text("photo_url") == "", picked).otherwise(F.col("photo_url")) if only_empty else picked)


def rebuild_photo_url(nodes: DataFrame, prefix: str = FILE_PATH) -> DataFrame:
    """Photos of forts, temples and palaces named after their titles."""
    quoted = F.replace(F.replace(F.replace(F.url_encode("title"), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/")), F.lit("*"), F.lit("%2A"))
    return nodes.withColumn("photo_url", F.when(text("title").rlike("Fort|Temple|Palace"), F.concat(F.lit(prefix), F.replace(quoted, F.lit("%7E"), F.lit("~")), F.lit(".jpg"))).otherwise(F.col("photo_url")))


def needs_photo(nodes: DataFrame, prefix: str | None = None) -> DataFrame:
    """Nodes without a photo, or whose photo begins with the prefix."""
    url = text("photo_url")
    return nodes.where((strip(url) == "") | (url.startswith(prefix) if prefix else F.lit(False)))


def join_photo_lookup(nodes: DataFrame, lookup: DataFrame, attribution: str) -> DataFrame:
    """Photos from a table of (title, thumb) for nodes without one."""
    found = first_per_key(lookup.where(text("thumb") != "").select("title", "thumb"), ["title"], ["thumb"])
    both = nodes.join(found, "title", "left")
    hit = (strip(text("photo_url")) == "") & F.col("thumb").isNotNull()
    return both.withColumns({"attribution": F.when(hit, F.lit(attribution)), "photo_url": F.when(hit, F.col("thumb")).otherwise(F.col("photo_url"))}).drop("thumb")


#: Bytes of keys in one automaton; more go in blocks, one after the other.
KEY_BYTES = 8_000_000
_automata: dict[str, object] = {}


def _automaton(name: str, listed: list[tuple]) -> object:
    """The automaton of a list of keys, made once in each worker."""
    import ahocorasick

    if name not in _automata:
        _automata.clear()
        made = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for place, (key, *_) in reversed(list(enumerate(listed))):  # of equal keys the first stays
            made.add_word(key, place)
        made.make_automaton()
        _automata[name] = made
    return _automata[name]


def _first_contained(df: DataFrame, title: Column, keys: DataFrame, out: str) -> DataFrame:
    """df with a struct (ord, key, lat, lng, city) of the first key, by ord, that the title
    contains. Titles are read once by an automaton of all keys (of a block, where keys
    have over KEY_BYTES bytes), whatever their number."""
    n = max(1, -(-(keys.agg(F.sum(F.octet_length("key") + 16)).first()[0] or 0) // KEY_BYTES))
    kind = F.struct(keys["ord"], "key", "lat", "lng", "city")
    hit = keys.select(kind.alias("h")).schema["h"].dataType
    found = df.withColumn("_title", title)
    for i in range(n):
        own = keys.where(F.pmod(F.xxhash64("key"), F.lit(n)) == i).orderBy("ord", "key", "lat", "lng", "city").select("key", "ord", "lat", "lng", "city")
        shared = df.sparkSession.sparkContext.broadcast([tuple(r) for r in own.collect()])  # about KEY_BYTES bytes of keys
        schema = T.StructType([*found.schema, T.StructField(f"_h{i}", hit)])

        def find(batches: Iterator[pa.RecordBatch], shared=shared, schema=schema, name=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            listed = shared.value
            automaton = _automaton(name, listed) if listed else None
            kinds = to_arrow_type(schema[-1].dataType)
            for b in batches:
                first = [min((place for _, place in automaton.iter(t)), default=None) if automaton and t else None for t in b.column("_title").to_pylist()]
                hits = [None if at is None else dict(zip(("key", "ord", "lat", "lng", "city"), listed[at], strict=True)) for at in first]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hits, kinds)], names=schema.names)

        found = found.mapInArrow(find, schema)
    return found.withColumn(out, F.array_min(F.array(*[F.col(f"_h{i}") for i in range(n)]))).drop("_title", *[f"_h{i}" for i in range(n)])


def gazetteer_substring(df: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """df with lat, lng and city of the first key (by `ord`) that its upper-case title
    contains, else the centre of the state. Matches add a sentence on the origin to
    the details. gazetteer: ord, key, lat, lng, city. Null and empty keys match nothing."""
    rows = gazetteer.where(F.col("key") != "").select("ord", "key", F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lng"), "city")
    found = _first_contained(df, F.upper(text("title")), rows, "_hit")
    lat, lng, label = STATE_CENTRE
    return found.withColumns(
        {
            "lat": F.coalesce("_hit.lat", F.lit(lat)),
            "lng": F.coalesce("_hit.lng", F.lit(lng)),
            "location_text": F.coalesce("_hit.city", F.lit(label)),
            "docent_details": F.when(F.col("_hit").isNotNull(), F.concat(text("docent_details"), F.lit(" Officially originates from "), F.col("_hit.city"), F.lit("."))).otherwise(F.col("docent_details")),
        }
    ).drop("_hit")


def geocode(df: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """df with lat and lng of its title, else of its location_text; rows of neither go.
    gazetteer: name, lat, lng; a coordinate of 0 counts as not found."""
    known = first_per_key(gazetteer.where("lat <> 0 and lng <> 0").select("name", F.struct("lat", "lng").alias("point")), ["name"], ["point"])
    by = lambda c, p: known.select(F.col("name").alias(c), F.col("point").alias(p))
    both = df.join(by("title", "_a"), "title", "left").join(by("location_text", "_b"), "location_text", "left")
    return both.withColumn("_p", F.coalesce("_a", "_b")).where("_p is not null").withColumns({"lat": F.col("_p.lat"), "lng": F.col("_p.lng")}).drop("_a", "_b", "_p")


def find_node(nodes: DataFrame, query: str, order: str = "pos") -> DataFrame:
    """The first node, in input order, whose title contains the query in any case."""
    return nodes.where(F.contains(F.lower(text("title")), F.lit(query.lower()))).orderBy(order).limit(1)


def describe(prefix: str = "") -> Column:
    """One line on a node for a prompt."""
    c = lambda name: F.col(f"{prefix}{name}")
    return F.concat(F.lit("Title: "), text(c("title")), F.lit("; Category: "), pretty_category(c("category")), F.lit("; District: "), F.coalesce(blank_to_null(c("district")), F.lit("unknown")), F.lit("; Era: "), F.coalesce(blank_to_null(c("era")), F.lit("unspecified")), F.lit("; Content: "), text(c("content")))


def hints(a: str = "a_", b: str = "b_") -> Column:
    """What two nodes share. Nulls share nothing, but two unknown groups are the same."""
    same = lambda name, label: F.when((text(f"{a}{name}") != "") & (F.col(f"{a}{name}") == F.col(f"{b}{name}")), F.concat(F.lit(f"same {label} ("), F.col(f"{a}{name}"), F.lit(")")))
    group = F.when(F.col(f"{a}heritage_group").eqNullSafe(F.col(f"{b}heritage_group")), F.lit("same heritage group"))
    return F.coalesce(blank_to_null(F.concat_ws("; ", same("district", "district"), same("era", "specific era"), same("gi_type", "GI type"), group)), F.lit("no structural overlap detected"))


def enrich_prompt() -> Column:
    """What is known of a node, a line each; a note that is boilerplate is left out."""
    line = lambda label, c: F.when(text(c) != "", F.concat(F.lit(f"{label}: "), F.col(c)))
    note = F.when(~is_boilerplate("famous_for", F.lit("")), line("Existing note", "famous_for"))
    return F.concat_ws("\n", F.concat(F.lit("Title: "), text("title")), F.concat(F.lit("Category: "), pretty_category("category")), line("Era", "era"), line("District/region", "district"), line("GI type", "gi_type"), line("Nearby culture note", "nearby_culture"), note)


def content_document() -> Column:
    """A node as a Markdown document, from flat columns with facts."""
    details = F.when((text("docent_details") != "") & ~F.col("docent_details").eqNullSafe(F.col("famous_for")), F.concat(F.lit("\n"), F.col("docent_details")))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("# "), text("title")),
        F.lit(""),
        F.concat(F.lit("**Category:** "), pretty_category("category"), F.lit("  ")),
        F.when(text("era") != "", F.concat(F.lit("**Era:** "), F.col("era"), F.lit("  "))),
        F.when(F.col("place").isNotNull(), F.concat(F.lit("**Region:** "), F.initcap("place"), F.lit("  "))),
        F.concat(F.lit("**Trust status:** "), F.coalesce(blank_to_null("trust"), F.lit("verified")), F.lit("  ")),
        F.lit(""),
        blank_to_null("famous_for"),
        details,
        F.when(text("nearby_culture") != "", F.concat(F.lit("\n**Nearby culture:** "), F.col("nearby_culture"))),
    )


