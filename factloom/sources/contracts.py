"""The contract tables: columns, keys and references as data, and checks made from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns as name:type, the primary key first (s string, l bigint, b boolean, d double, a array of strings).
_TABLES = {
    "raw_inventory": "inventory_row_id:s raw_candidate_id:s raw_kind:s relative_path:s raw_blob_sha256:s filename_sha256:s filename_hash_status:s bytes:l content_type_detected:s content_type_basis:s read_status:s read_error:s hash_computed_now:b historical_hash_evidence_status:s historical_hash_evidence_count:l source_provenance_status:s strict_input_eligible:b unknown_reason:s",
    "raw_hash_audit": "hash_audit_id:s raw_candidate_id:s relative_path:s bytes:l computed_sha256:s hash_computed_now:b filename_sha256:s filename_hash_status:s historical_hash_evidence_status:s historical_hash_evidence_count:l read_status:s read_error:s",
    "retrievals": "retrieval_id:s raw_blob_sha256:s source_id:s requested_url:s final_url:s retrieved_at_real:s archive_datetime:s recorded_event_at:s recorded_event_time_field:s provenance_status:s strict_source_input_eligible:b evidence_path:s evidence_locator:s evidence_file_sha256:s evidence_record_sha256:s",
    "source_versions": "source_version_id:s raw_blob_sha256:s retrieval_id:s source_id:s canonical_or_final_url:s retrieved_at_real:s archive_datetime:s source_version_status:s strict_source_input_eligible:b evidence_path:s evidence_locator:s",
    "provenance_recovery_ledger": "ledger_id:s raw_blob_sha256:s field_name:s recovered_value:s recovery_status:s reason:s evidence_path:s evidence_locator:s evidence_file_sha256:s",
    "body_variants": "body_variant_id:s body_text_sha256:s body_blob_relative_path:s parser_version:s parser_fingerprint_sha256:s decoder:s selector:s text_char_count:l extraction_status:s quality_flags_json:s",
    "document_memberships": "membership_id:s raw_blob_sha256:s raw_candidate_id:s body_variant_id:s exact_cluster_id:s retrieval_ids_json:s source_provenance_status:s strict_input_eligible:b membership_status:s reason:s",
    "document_clusters": "cluster_id:s cluster_type:s body_variant_id:s member_count:l member_ids_json:s dedup_method:s policy_status:s",
    "lineage_edges": "lineage_edge_id:s from_source_version_id:s to_source_version_id:s relation_type:s evidence_status:s reason:s evidence_path:s",
    "near_duplicate_candidates": "candidate_id:s left_body_variant_id:s right_body_variant_id:s candidate_generation_status:s reason:s policy_status:s",
    "missing_coverage_ledger": "issue_id:s issue_type:s raw_candidate_id:s raw_blob_sha256:s severity:s blocks_strict_input:b reason:s recommended_next_action:s",
    "coverage_ledger": "coverage_row_id:s upstream_scope:s upstream_observation_count:l upstream_unique_url_count:l raw_blob_count:l recovered_retrieval_count:l strict_retrieval_count:l comparison_status:s reason:s",
    "extracted_claims": "claim_id:s body_variant_id:s source_id:s subject_mention:s relation_name:s object_mention:s evidence_span_start:l evidence_span_end:l evidence_text_hash:s valid_from_extracted:s valid_to_extracted:s is_negative:b is_speculative:b",
    "claim_provenance": "provenance_id:s claim_id:s membership_id:s source_version_id:s retrieval_id:s raw_blob_sha256:s publisher_source_id:s source_url:s",
    "fact_versions": "fact_version_id:s supporting_claim_ids:a logical_fact_id:s subject_id:s relation_id:s object_id:s valid_from:s valid_to:s evidence_observed_at:s ingested_at_real:s supersedes_version_id:s revision_type:s source_id:s source_url:s evidence_span_start:l evidence_span_end:l evidence_text_hash:s extractor_version:s entity_map_version:s confidence:d adjudication_status:s",
    "snapshot_edges": "edge_id:s subject_id:s relation_id:s object_id:s snapshot_id:s",
    "snapshot_edge_support": "support_id:s provenance_id:s edge_id:s fact_version_id:s claim_id:s source_version_id:s raw_blob_sha256:s",
    "snapshot_exclusions": "exclusion_id:s record_id:s fact_version_id:s reason_code:s severity:s stage:s field:s detail:s",
    "entity_mapping_versions": "entity_mapping_id:s mention:s canonical_entity_id:s mapping_available_at:s entity_map_version:s supersedes_mapping_id:s mapping_basis:s mapping_confidence:d",
    "adjudication_decisions": "decision_id:s claim_id:s fact_version_id:s decision_type:s rule_id:s decider:s evaluated_at_real:s reason:s",
}
_KINDS = {"s": T.StringType(), "l": T.LongType(), "b": T.BooleanType(), "d": T.DoubleType(), "a": T.ArrayType(T.StringType())}
SCHEMA_VERSION = "1.0.0"


def schema(table: str) -> T.StructType:
    """The contract's columns, schema_version first."""
    pairs = [c.split(":") for c in _TABLES[table].split()]
    return T.StructType([T.StructField("schema_version", T.StringType(), False), *[T.StructField(n, _KINDS[k]) for n, k in pairs]])


def tables() -> list[str]:
    return list(_TABLES)


def primary_key(table: str) -> str:
    return _TABLES[table].split(":", 1)[0]


def conform(df: DataFrame, table: str) -> DataFrame:
    """df with exactly the contract's columns: missing ones are null, unknown ones an error."""
    want = schema(table)
    unknown = set(df.columns) - set(want.names)
    if unknown:
        raise ValueError(f"{table}: unknown columns {sorted(unknown)}")
    out = [F.lit(SCHEMA_VERSION).alias("schema_version")]
    out += [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want.fields[1:]]
    return df.select(out)


def schema_audit(df: DataFrame, table: str) -> DataFrame:
    """(table_name, field, problem): fields that are missing, added or of another type."""
    want, have = dict((f.name, f.dataType.simpleString()) for f in schema(table)), dict(df.dtypes)
    rows = [(table, c, "MISSING") for c in want if c not in have] + [(table, c, "ADDED") for c in have if c not in want] + [(table, c, "TYPE") for c in want if c in have and want[c] != have[c]]
    return df.sparkSession.createDataFrame(rows, "table_name string, field string, problem string")


def key_violations(df: DataFrame, table: str, key: str | None = None) -> DataFrame:
    """(table_name, key, problem, n): null keys and keys of several rows."""
    key = key or primary_key(table)
    g = df.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"))
    return g.filter("key is null or n > 1").select(F.lit(table).alias("table_name"), "key", F.when(F.col("key").isNull(), "NULL_KEY").otherwise("DUPLICATE_KEY").alias("problem"), "n")


def hash_violations(df: DataFrame, table: str) -> DataFrame:
    """(table_name, field, n): values of *_sha256 and *_hash columns that are no lower-case SHA-256."""
    fields = [c for c in df.columns if c.endswith(("_sha256", "_hash"))]
    bad = [F.sum((~F.col(c).rlike("^[0-9a-f]{64}$")).cast("long")).alias(c) for c in fields]
    one = df.agg(*bad)
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.coalesce(F.col(c), F.lit(0)).alias("n")) for c in fields])).alias("x")).select(F.lit(table).alias("table_name"), "x.*")


def foreign_violations(child: DataFrame, field: str, parent: DataFrame, key: str) -> DataFrame:
    """(ref, n): keys without parent row and the number of rows that name them; null names nothing."""
    refs = child.filter(F.col(field).isNotNull()).groupBy(F.col(field).alias("ref")).agg(F.count("*").alias("n"))
    return refs.join(parent.select(F.col(key).alias("ref")).filter("ref is not null").distinct(), "ref", "left_anti")


def status_fold(checks: DataFrame, status: str = "status") -> DataFrame:
    """(status): the gravest of FAIL, BLOCKED, NOT_RUN, PASS; NOT_RUN without any check."""
    order = ["PASS", "NOT_RUN", "BLOCKED", "FAIL"]
    rank = reduce(lambda c, kv: F.when(F.col(status) == kv[1], kv[0]).otherwise(c), enumerate(order), F.lit(1))
    return checks.agg(F.max(rank).alias("r")).select(F.element_at(F.array(*map(F.lit, order)), F.coalesce("r", F.lit(1)) + 1).alias("status"))
