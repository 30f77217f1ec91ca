"""Checks over the domain tables, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, graph
from ..operators.timestamps import iso_micros
from ..runtime import load, staged
from ..sources import contracts
from ..sources.bindings import EDGES_SQL, edges
from .evidence_plan import _ADJ, _GROUND, claims_adjudicated, claims_grounded


def strict_retrievals(spark: SparkSession, d: str) -> DataFrame:
    """Source versions, one row a delivery that differs, with what keeps them from being strict."""
    return load(spark, d, "source_versions").select("source_version_id", audit.retrieval_problem().alias("problem")).distinct()


def blob_provenance(spark: SparkSession, d: str) -> DataFrame:
    """Blobs that claims name against the retrievals of source versions."""
    return audit.blob_provenance(load(spark, d, "claim_provenance"), load(spark, d, "source_versions"))


def claims_conserved(spark: SparkSession, d: str) -> DataFrame:
    return audit.conservation(load(spark, d, "extracted_claims"), claims_adjudicated(spark, d), "claim_id")


def edge_support_parity(spark: SparkSession, d: str) -> DataFrame:
    """Edges of each snapshot against those that its supports name."""
    return audit.parity_by(load(spark, d, "snapshot_edges"), load(spark, d, "snapshot_edge_support"), "snapshot_id", "edge_id")


def edge_identifiers(spark: SparkSession, d: str) -> DataFrame:
    return audit.blank_identifiers(load(spark, d, "snapshot_edges"), ["edge_id", "subject_id", "relation_id", "object_id", "snapshot_id"])


def edge_temporal_support(spark: SparkSession, d: str) -> DataFrame:
    """The facts behind each edge with their times: a row per edge and fact version, however many an edge has."""
    s = load(spark, d, "snapshot_edge_support").select("edge_id", "fact_version_id").filter("edge_id is not null and fact_version_id is not null").distinct()
    f = load(spark, d, "fact_versions").filter("fact_version_id is not null").groupBy("fact_version_id").agg(F.min(iso_micros(F.col("valid_from"))).alias("valid_from_us"), F.min(iso_micros(F.col("valid_to"))).alias("valid_to_us"), F.min(iso_micros(F.col("ingested_at_real"))).alias("accepted_us"))
    e = load(spark, d, "snapshot_edges").select("edge_id").distinct()
    return s.join(f, "fact_version_id").join(e, "edge_id", "left_semi").select("edge_id", "fact_version_id", "valid_from_us", "valid_to_us", "accepted_us")


def _facts_by_key(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """One row per (s, r, o, hash), the least of those that share it."""
    key = ["s", "r", "o", "h"]
    d = df.select(*[F.col(c).alias(n) for n, c in names.items()]).dropna(subset=key)
    rest = [n for n in names if n not in key]
    return d.groupBy(*key).agg(F.min(F.struct(*rest)).alias("v")).select(*key, "v.*")


def extraction_quality_by_kind(spark: SparkSession, d: str) -> DataFrame:
    """Claims as predictions against fact versions as gold: relations by ends and evidence, then spans and dates."""
    gold = load(spark, d, "fact_versions").withColumn("day_from", F.substring("valid_from", 1, 10)).withColumn("day_to", F.substring("valid_to", 1, 10))
    g = _facts_by_key(gold, {"s": "subject_id", "r": "relation_id", "o": "object_id", "h": "evidence_text_hash", "a": "evidence_span_start", "z": "evidence_span_end", "f": "day_from", "t": "day_to"})
    p = _facts_by_key(load(spark, d, "extracted_claims"), {"s": "subject_mention", "r": "relation_name", "o": "object_mention", "h": "evidence_text_hash", "a": "evidence_span_start", "z": "evidence_span_end", "f": "valid_from_extracted", "t": "valid_to_extracted"})
    return audit.quality_by_kind(g, p, ["s", "r", "o", "h"], {"span": ["a", "z"], "temporal": ["f", "t"]})


def claim_occurrences(spark: SparkSession, d: str) -> DataFrame:
    """The places in bodies that claims cite, with the number of claims."""
    c = load(spark, d, "extracted_claims").filter("body_variant_id is not null and evidence_span_start is not null and evidence_span_end is not null")
    return c.groupBy(audit.occurrence_id().alias("occurrence_id")).agg(F.countDistinct("claim_id").alias("claims"))


def entity_names_latest(spark: SparkSession, d: str) -> DataFrame:
    """The name that was last decided for each entity: by availability, then id, then spelling."""
    m = load(spark, d, "entity_mapping_versions").filter("canonical_entity_id is not null and mention is not null")
    at = iso_micros(F.col("mapping_available_at"))
    return m.filter(at.isNotNull()).groupBy("canonical_entity_id").agg(F.max_by("mention", F.struct(at, F.col("entity_mapping_id"), F.col("mention"))).alias("name"))


def anchors_by_degree(spark: SparkSession, d: str) -> DataFrame:
    """Fit and holdout inside of every exact degree."""
    k = graph.degrees(edges(spark, d))
    return graph.hash_split(k, 0.6, "degree_split_v1", ["snapshot_id", "degree"]).select("snapshot_id", "entity", "role")


def structure_gate(spark: SparkSession, d: str) -> DataFrame:
    """One row per structural check with its number of failures: spans, clocks, conservation, supports, identifiers."""
    g = staged(claims_grounded(spark, d), "grounded")
    f = load(spark, d, "fact_versions").select(iso_micros(F.col("valid_from")).alias("a"), iso_micros(F.col("valid_to")).alias("b"))
    one = lambda name, df: df.agg(F.lit(name).alias("check"), F.count("*").alias("n"))
    parts = [
        one("SPAN_OR_HASH", g.filter("problem in ('SPAN_OUT_OF_RANGE', 'HASH_MISMATCH')")),
        one("MISSING_BODY", g.filter("problem = 'MISSING_BODY'")),
        one("ENDS_BEFORE_START", f.filter("b < a")),
        one("EDGE_WITHOUT_SUPPORT", load(spark, d, "snapshot_edges").select("edge_id").distinct().join(load(spark, d, "snapshot_edge_support").select("edge_id").distinct(), "edge_id", "left_anti")),
        one("BLANK_IDENTIFIER", audit.blank_identifiers(load(spark, d, "snapshot_edges"), ["subject_id", "relation_id", "object_id"]).filter("n > 0")),
        claims_conserved(spark, d).agg(F.lit("CONSERVATION").alias("check"), F.sum("n").alias("n")),
    ]
    d2 = reduce(DataFrame.unionByName, parts)
    return d2.select("check", "n", F.when(F.col("n") > 0, "FAIL").otherwise("PASS").alias("status"))


def structure_status(spark: SparkSession, d: str) -> DataFrame:
    return contracts.status_fold(structure_gate(spark, d))


def document_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    """Per source: rows, different addresses, blobs and bodies, and rows without text."""
    t = load(spark, d, "documents")
    return t.groupBy("source").agg(F.count("*").alias("rows"), F.countDistinct("url").alias("urls"), F.countDistinct("raw_blob_sha256").alias("blobs"), F.countDistinct("body_variant_id").alias("bodies"), F.count_if(audit.blank("text")).alias("without_text"))


QUERIES = {
    f.__name__: f
    for f in (
        strict_retrievals, blob_provenance, claims_conserved, edge_support_parity, edge_identifiers, edge_temporal_support, extraction_quality_by_kind, claim_occurrences, entity_names_latest, anchors_by_degree, structure_gate,
        structure_status, document_reconciliation,
    )
}

_blank = lambda c: f"coalesce(trim({c}, ' '), '') = ''"
_ZONED = "regexp_full_match(trim(retrieved_at_real), '\\d{4}-\\d{2}-\\d{2}[Tt ]\\d{2}:\\d{2}(:\\d{2}([.]\\d+)?)?\\s?([Zz]|[+-]\\d{2}(:?\\d{2})?)')"
_PROBLEM = "CASE " + " ".join(f"WHEN {_blank(c)} THEN 'BLANK_{c.upper()}'" for c in audit.RETRIEVAL_FIELDS) + f" WHEN NOT {_ZONED} THEN 'TIME_WITHOUT_ZONE' WHEN NOT regexp_full_match(raw_blob_sha256, '[0-9a-f]{{64}}') THEN 'BAD_HASH' WHEN source_version_status <> 'OK' THEN 'STATUS' WHEN NOT strict_source_input_eligible THEN 'NOT_ELIGIBLE' END"
_CONSERVED = f"WITH {_ADJ}, u AS (SELECT DISTINCT claim_id FROM extracted_claims WHERE claim_id IS NOT NULL), dn AS (SELECT claim_id, count(*) AS n FROM dec WHERE claim_id IS NOT NULL GROUP BY 1)"
_SIDES = "SELECT 'UNDECIDED' AS side, count(*) AS n FROM u ANTI JOIN dn USING (claim_id) UNION ALL SELECT 'UNKNOWN', count(*) FROM dn ANTI JOIN u USING (claim_id) UNION ALL SELECT 'REPEATED', count(*) FROM dn SEMI JOIN u USING (claim_id) WHERE n > 1"
_us = lambda c: f"epoch_us(CAST({c} AS timestamptz))"
_GATE = f"""{_CONSERVED}, {_GROUND}, ck AS (SELECT 'SPAN_OR_HASH' AS "check", count(*) AS n FROM r WHERE problem IN ('SPAN_OUT_OF_RANGE', 'HASH_MISMATCH') UNION ALL SELECT 'MISSING_BODY', count(*) FROM r WHERE problem = 'MISSING_BODY'
UNION ALL SELECT 'ENDS_BEFORE_START', count(*) FROM fact_versions WHERE {_us("valid_to")} < {_us("valid_from")} UNION ALL SELECT 'EDGE_WITHOUT_SUPPORT', count(*) FROM (SELECT DISTINCT edge_id FROM snapshot_edges) e ANTI JOIN snapshot_edge_support s ON s.edge_id = e.edge_id
UNION ALL SELECT 'BLANK_IDENTIFIER', (SELECT count(*) FILTER ({_blank("subject_id")}) > 0 FROM snapshot_edges)::bigint + (SELECT count(*) FILTER ({_blank("relation_id")}) > 0 FROM snapshot_edges)::bigint + (SELECT count(*) FILTER ({_blank("object_id")}) > 0 FROM snapshot_edges)::bigint
UNION ALL SELECT 'CONSERVATION', CAST(sum(n) AS bigint) FROM ({_SIDES}))"""
_KEYED = """SELECT s, r, o, h, min({{'a': a, 'z': z, 'f': f, 't': t}}) AS v FROM (SELECT {cols} FROM {table}) WHERE s IS NOT NULL AND r IS NOT NULL AND o IS NOT NULL AND h IS NOT NULL GROUP BY ALL"""
_GOLD = _KEYED.format(cols="subject_id AS s, relation_id AS r, object_id AS o, evidence_text_hash AS h, evidence_span_start AS a, evidence_span_end AS z, substr(valid_from, 1, 10) AS f, substr(valid_to, 1, 10) AS t", table="fact_versions")
_PRED = _KEYED.format(cols="subject_mention AS s, relation_name AS r, object_mention AS o, evidence_text_hash AS h, evidence_span_start AS a, evidence_span_end AS z, valid_from_extracted AS f, valid_to_extracted AS t", table="extracted_claims")

SQL = {
    "strict_retrievals": f"SELECT DISTINCT source_version_id, {_PROBLEM} AS problem FROM source_versions",
    "blob_provenance": f"""WITH h AS (SELECT DISTINCT raw_blob_sha256 AS blob FROM claim_provenance WHERE raw_blob_sha256 IS NOT NULL), k AS (SELECT *, {_PROBLEM} IS NULL AS ok FROM source_versions WHERE raw_blob_sha256 IS NOT NULL),
v AS (SELECT raw_blob_sha256 AS blob, count(DISTINCT retrieval_id) AS retrievals, count(DISTINCT retrieval_id) FILTER (ok) AS strict, count(DISTINCT source_id) FILTER (ok) AS sources FROM k GROUP BY 1)
SELECT coalesce(h.blob, v.blob) AS blob, coalesce(retrievals, 0) AS retrievals, coalesce(strict, 0) AS strict, CASE WHEN h.blob IS NULL THEN 'ABSENT' WHEN v.blob IS NULL THEN 'UNKNOWN' WHEN sources > 1 THEN 'CONFLICT' WHEN strict > 0 THEN 'RECOVERED' ELSE 'WEAK' END AS status FROM h FULL JOIN v ON h.blob = v.blob""",
    "claims_conserved": f"{_CONSERVED} {_SIDES}",
    "edge_support_parity": """WITH a AS (SELECT DISTINCT snapshot_id AS s, edge_id AS e FROM snapshot_edges), b AS (SELECT DISTINCT snapshot_id AS s, edge_id AS e FROM snapshot_edge_support), u AS (SELECT s, e, true AS l, false AS r FROM a UNION ALL SELECT s, e, false, true FROM b),
g AS (SELECT s, e, bool_or(l) AS l, bool_or(r) AS r FROM u GROUP BY s, e) SELECT s AS snapshot_id, CASE WHEN NOT l THEN 'RIGHT_ONLY' WHEN NOT r THEN 'LEFT_ONLY' ELSE 'BOTH' END AS side, count(*) AS n FROM g GROUP BY ALL""",
    "edge_identifiers": " UNION ALL ".join(f"SELECT '{c}' AS field, count(*) FILTER ({_blank(c)}) AS n FROM snapshot_edges" for c in ("edge_id", "subject_id", "relation_id", "object_id", "snapshot_id")),
    "edge_temporal_support": f"""WITH f AS (SELECT fact_version_id, min({_us("valid_from")}) AS valid_from_us, min({_us("valid_to")}) AS valid_to_us, min({_us("ingested_at_real")}) AS accepted_us FROM fact_versions GROUP BY 1)
SELECT DISTINCT s.edge_id, s.fact_version_id, valid_from_us, valid_to_us, accepted_us FROM snapshot_edge_support s JOIN f ON f.fact_version_id = s.fact_version_id WHERE s.edge_id IN (SELECT edge_id FROM snapshot_edges)""",
    "extraction_quality_by_kind": f"""WITH g AS ({_GOLD}), p AS ({_PRED}), m AS (SELECT g.v AS gv, p.v AS pv FROM g JOIN p USING (s, r, o, h)), c AS (SELECT (SELECT count(*) FROM g) AS gold, (SELECT count(*) FROM p) AS predicted, (SELECT count(*) FROM m) AS hit,
  (SELECT coalesce(sum((gv.a IS NOT DISTINCT FROM pv.a)::int + (gv.z IS NOT DISTINCT FROM pv.z)::int), 0) FROM m) AS span, (SELECT coalesce(sum((gv.f IS NOT DISTINCT FROM pv.f)::int + (gv.t IS NOT DISTINCT FROM pv.t)::int), 0) FROM m) AS temporal),
k AS (SELECT 'relation_precision' AS metric, hit AS numerator, predicted AS denominator FROM c UNION ALL SELECT 'relation_recall', hit, gold FROM c UNION ALL SELECT 'span_accuracy', span, 2 * gold FROM c UNION ALL SELECT 'temporal_accuracy', temporal, 2 * gold FROM c)
SELECT metric, CAST(numerator AS bigint) AS numerator, CAST(denominator AS bigint) AS denominator, CASE WHEN denominator > 0 THEN numerator / denominator END AS value FROM k""",
    "claim_occurrences": """SELECT 'mention_' || substr(sha256('["' || body_variant_id || '","' || evidence_span_start || '","' || evidence_span_end || '"]'), 1, 32) AS occurrence_id, count(DISTINCT claim_id) AS claims FROM extracted_claims WHERE body_variant_id IS NOT NULL AND evidence_span_start IS NOT NULL AND evidence_span_end IS NOT NULL GROUP BY 1""",
    "entity_names_latest": f"SELECT canonical_entity_id, arg_max(mention, {{'a': {_us('mapping_available_at')}, 'b': entity_mapping_id, 'c': mention}}) AS name FROM entity_mapping_versions WHERE canonical_entity_id IS NOT NULL AND mention IS NOT NULL GROUP BY 1",
    "anchors_by_degree": f"WITH {EDGES_SQL}, deg AS (SELECT snapshot_id, entity, count(*) AS degree FROM (SELECT snapshot_id, unnest([h, t]) AS entity FROM e) GROUP BY ALL) SELECT snapshot_id, entity, CASE WHEN row_number() OVER (PARTITION BY snapshot_id, degree ORDER BY sha256('degree_split_v1:' || entity), entity) <= greatest(1, least(count(*) OVER (PARTITION BY snapshot_id, degree) - 1, round_even(0.6 * count(*) OVER (PARTITION BY snapshot_id, degree), 0))) THEN 'fit' ELSE 'holdout' END AS role FROM deg",
    "structure_gate": f"""{_GATE} SELECT "check", n, CASE WHEN n > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM ck""",
    "structure_status": f"{_GATE} SELECT CASE WHEN max(n) > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM ck",
    "document_reconciliation": "SELECT source, count(*) AS rows, count(DISTINCT url) AS urls, count(DISTINCT raw_blob_sha256) AS blobs, count(DISTINCT body_variant_id) AS bodies, count(*) FILTER (coalesce(trim(text, ' '), '') = '') AS without_text FROM documents GROUP BY 1",
}
