"""Schemas of the tables and payloads, in DDL; no read infers one."""

from __future__ import annotations


NODES = (
    "node_id string, title string, category string, heritage_group string, era string, district string, gi_type string, latitude double, longitude double, famous_for string, docent_details string, "
    "nearby_culture string, content string, content_source string, trust_status string, merged_into string, vector_embedding array<float>, photo_url string, source_refs string, created_at timestamp, updated_at timestamp"
)
CLUSTERS = ("cluster_id string, name string, kind string, parent_id string, description string, created_at timestamp")
NODE_CLUSTERS = ("node_id string, cluster_id string")
EDGES = ("edge_id long, source_id string, target_id string, tier string, score double, rationale string, formed_by string, created_at timestamp")
VERDICTS = ("source_id string, target_id string, score double, connect boolean, tier string, rationale string")
SUBMISSIONS = (
    "submission_id string, title string, description string, category string, tags array<string>, latitude double, longitude double, photo_path string, contributor_name string, contributor_note string, "
    "status string, promoted_node_id string, reviewed_by string, reviewed_at timestamp, created_at timestamp"
)
SCANS = ("session_id string, event_id long, ts timestamp, latitude double, longitude double, radius_km double, is_teleport_mode boolean, is_reset boolean")
RAW_NODES = (
    "node_id string, title string, category string, coordinates struct<lat: double, lng: double>, location_text string, era string, famous_for string, nearby_culture string, docent_details string, "
    "media struct<photo_url: string, attribution: string>, trust_status string, synapses array<struct<connection: string>>"
)
POI = ("item string, itemLabel string, coord string, image string")
BINDINGS = ("results struct<bindings: array<struct<itemLabel: struct<value: string>, coord: struct<value: string>, image: struct<value: string>>>>")
ELEMENTS = ("elements array<struct<lat: double, lon: double, center: struct<lat: double, lon: double>, tags: map<string, string>>>")
LINK_VERDICTS = "struct<results: array<struct<index: int, connect: boolean, tier: string, rationale: string>>>"
DUPLICATE_VERDICT = "struct<same_subject: boolean, reason: string>"
REWRITE = "struct<description: string>"

TIERS = ["verified", "source_supported", "potential", "contradictory"]
SHOWN_TIERS = TIERS[:3]
STATUSES = ["pending", "approved", "rejected"]
