"""Review of community submissions: validation, patches, verdicts and promotion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.taxonomy import SUBTYPES
from ..functions.text import blank_to_null, community_id, group_of, is_boilerplate, normal_title, place, strip, text
from ..sources.sinks import update_by_key
from .nodes import memberships
from .vectors import DUPLICATE_FROM, LEAST_COSINE, NEIGHBOURS, alike, best_alike, confirmed_alike

# Photos that are taken.
IMAGE_TYPES = ["image/jpeg", "image/png", "image/webp", "image/gif"]
MAX_PHOTO_BYTES = 8 * 1024 * 1024


def categories(spark: SparkSession) -> DataFrame:
    """The categories that have a rule, sorted."""
    return spark.createDataFrame([(c,) for c in sorted({c for _, cs in SUBTYPES.values() for c in cs})], "category string")


def edit_tags(df: DataFrame, edits: DataFrame) -> DataFrame:
    """Submissions with their tags edited: edits (submission_id, remove_at, add) drop the tag
    at an index from 0 and add one at the end. Tags are stripped; blank ones and ones
    that are there already are not added; an index beyond the list drops nothing."""
    both = df.join(edits, "submission_id", "left")
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    left = F.filter(tags, lambda x, i: F.col("remove_at").isNull() | (i != F.col("remove_at")))
    new = blank_to_null(strip(text("add")))
    added = F.when(new.isNotNull() & ~F.coalesce(F.array_contains(left, new), F.lit(False)), F.concat(left, F.array(new))).otherwise(left)
    return both.withColumn("tags", F.when(F.col("remove_at").isNotNull() | F.col("add").isNotNull(), added).otherwise(F.col("tags"))).select(*df.columns)


def validate_submissions(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejects). Valid rows are trimmed and pending; rejects have a `reason`.
    Columns: title, description, photo_type and photo_bytes (null without photo),
    contributor_name, contributor_note, and any other."""
    reason = (
        F.when((strip(text("title")) == "") | (strip(text("description")) == ""), "title and description are required")
        .when(F.col("photo_type").isNotNull() & ~F.col("photo_type").isin(IMAGE_TYPES), "unsupported photo type")
        .when(F.col("photo_bytes") > MAX_PHOTO_BYTES, "photo too large")
    )
    judged = df.withColumn("reason", reason)
    trimmed = {"title": strip(text("title")), "description": strip(text("description")), "contributor_name": blank_to_null(strip(text("contributor_name"))), "contributor_note": blank_to_null(strip(text("contributor_note"))), "status": F.lit("pending")}
    return judged.where("reason is null").drop("reason").withColumns(trimmed), judged.where("reason is not null")


def list_submissions(df: DataFrame, status: str, photo_base: str) -> DataFrame:
    """Submissions of a status, newest first, with the address of their photo."""
    url = F.when(text("photo_path") != "", F.concat(F.lit(photo_base), F.col("photo_path")))
    return df.where(F.col("status") == status).withColumn("photo_url", url).orderBy(F.desc("created_at"), "submission_id")


def patch_submissions(df: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(submissions, errors): the patches' non-null category and tags overwrite; a patch of
    nulls alone, or of an unknown id, is an error."""
    empty = F.col("category").isNull() & F.col("tags").isNull()
    unknown = patches.where(~empty).join(df.select("submission_id"), "submission_id", "left_anti").select("submission_id", F.lit("submission not found").alias("error"))
    errors = patches.where(empty).select("submission_id", F.lit("nothing to update").alias("error")).unionByName(unknown)
    return update_by_key(df, patches.where(~empty), "submission_id"), errors


def reject(df: DataFrame, ids: DataFrame, reviewed_by: str, at: Column | None = None) -> DataFrame:
    """Submissions of the ids (submission_id) as rejected, whatever their status was."""
    patch = ids.select("submission_id", F.lit("rejected").alias("status"), F.lit(reviewed_by).alias("reviewed_by"), (at if at is not None else F.current_timestamp()).alias("reviewed_at"))
    return update_by_key(df, patch, "submission_id")


def approval_gate(df: DataFrame, ids: DataFrame) -> DataFrame:
    """submission_id, outcome: 'ok', 'missing' or 'conflict' with a status other than pending."""
    found = ids.join(df.select("submission_id", "status"), "submission_id", "left")
    return found.select("submission_id", F.when(F.col("status").isNull(), "missing").when(F.col("status") != "pending", "conflict").otherwise("ok").alias("outcome"))


def derive_nodes(submissions: DataFrame) -> DataFrame:
    """Submissions as nodes. Their description stands for both texts; era and GI type stay
    unknown. Ids follow from title and submission, so that a retry gives the same."""
    category = F.coalesce(blank_to_null("category"), F.lit("TANGIBLE_HERITAGE"))
    return submissions.select(
        "submission_id",
        community_id("title", "submission_id").alias("node_id"),
        "title",
        category.alias("category"),
        group_of(category).alias("heritage_group"),
        F.lit(None).cast("string").alias("era"),
        place("title", "description", F.lit("")).alias("district"),
        F.lit(None).cast("string").alias("gi_type"),
        "latitude",
        "longitude",
        F.col("description").alias("famous_for"),
        F.col("description").alias("docent_details"),
        F.col("contributor_note").alias("nearby_culture"),
        F.col("description").alias("content"),
        F.lit("original").alias("content_source"),
        F.lit("community_contributed").alias("trust_status"),
        is_boilerplate("description", "description").alias("is_thin"),
    )


def promote(new: DataFrame, nodes: DataFrame, same_subject: DataFrame, link_verdicts: DataFrame, duplicate_from: float = DUPLICATE_FROM, k: int = NEIGHBOURS, least: float = LEAST_COSINE, vectors: tuple[DataFrame, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Approved submissions (derive_nodes() with `embedding`) in the graph of active nodes
    (node_id, title, embedding).

    outcome: submission_id, status ('added' or 'merged'), node_id, merged_into,
    edges_formed. A duplicate is the first node, by id, of the same normal title, or
    else the first of a cosine of duplicate_from that same_subject (node_id,
    other_id) confirms. nodes, clusters, edges: what is added. Edges go to the k
    nearest nodes of a cosine of `least` that link_verdicts (node_id, other_id,
    connect, tier, rationale) connects. The submissions of one batch do not see
    each other. Equal vectors are searched for once, and of same_subject's pairs alone
    it is measured whether they reach duplicate_from. vectors: alike() of new and of
    nodes, where the caller has them.
    """
    asked, there = vectors or (alike(new, "node_id"), alike(nodes, "node_id"))
    titled = nodes.select(F.col("node_id").alias("other_id"), normal_title("title").alias("norm")).where("norm <> ''").groupBy("norm").agg(F.min("other_id").alias("by_title"))
    said = same_subject.select(F.col("node_id").alias("query_id"), F.col("other_id").alias("node_id")).distinct()
    confirmed = confirmed_alike(said, asked, there, duplicate_from).select(F.col("query_id").alias("node_id"), F.col("node_id").alias("other_id")).groupBy("node_id").agg(F.min("other_id").alias("by_vector"))
    judged = new.withColumn("norm", normal_title("title")).join(titled, "norm", "left").join(confirmed, "node_id", "left").withColumn("merged_into", F.coalesce("by_title", "by_vector"))
    added = judged.where("merged_into is null").drop("norm", "by_title", "by_vector")
    ranked = best_alike(asked, there, k, least, only=added.select(F.col("node_id").alias("id"))).select(F.col("query_id").alias("node_id"), F.col("node_id").alias("other_id"), "similarity")
    valid = link_verdicts.where("connect").withColumn("rationale", F.trim("rationale")).where(F.col("tier").isin("verified", "source_supported", "potential", "contradictory") & (F.col("rationale") != ""))
    edges = ranked.join(valid, ["node_id", "other_id"]).select("node_id", F.least("node_id", "other_id").alias("source_id"), F.greatest("node_id", "other_id").alias("target_id"), "tier", F.round("similarity", 4).alias("score"), "rationale")
    formed = edges.groupBy("node_id").agg(F.count("*").alias("n"))
    outcome = judged.join(formed, "node_id", "left").select("submission_id", F.when(F.col("merged_into").isNull(), "added").otherwise("merged").alias("status"), "node_id", "merged_into", F.coalesce("n", F.lit(0)).cast("long").alias("edges_formed"))
    return {"outcome": outcome, "nodes": added.drop("merged_into"), "clusters": memberships(added), "edges": edges.drop("node_id")}
