"""As-of snapshots, cuts and document times, with their SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import asof_snapshot as op
from ..operators.timestamps import iso_micros
from ..runtime import load, staged
from ..sources.bindings import facts
from .general import _INSTANTS

CUTOFFS = [(f"S{i + 1:02d}", datetime(*at)) for i, at in enumerate([(2025, 4, 1), (2025, 7, 1), (2025, 10, 1), (2026, 1, 1), (2026, 4, 1), (2026, 7, 1), (2026, 10, 1), (2026, 12, 1)])]


def _status(spark: SparkSession, d: str) -> DataFrame:
    return op.snapshot_status(facts(spark, d), CUTOFFS)


def _active(spark: SparkSession, d: str) -> DataFrame:
    return op.resolve_ends(_status(spark, d), load(spark, d, "entity_mapping_versions"))


def asof_edges(spark: SparkSession, d: str) -> DataFrame:
    return op.snapshot_edges(_active(spark, d))


def asof_exclusions(spark: SparkSession, d: str) -> DataFrame:
    return _status(spark, d).filter("reason is not null").select("snapshot", "version", "reason")


def asof_reason_counts(spark: SparkSession, d: str) -> DataFrame:
    return _status(spark, d).groupBy("snapshot", F.coalesce("reason", F.lit("INCLUDED")).alias("reason")).agg(F.count("*").alias("n"))


def asof_support(spark: SparkSession, d: str) -> DataFrame:
    """Every provenance row of every claim that supports an active fact, with what keeps it from being exact."""
    return op.edge_support(_active(spark, d), load(spark, d, "claim_provenance"))


def asof_first_events(spark: SparkSession, d: str) -> DataFrame:
    return op.first_events(_active(spark, d))


def asof_manifest(spark: SparkSession, d: str) -> DataFrame:
    """One row per snapshot: numbers of versions, edges, exclusions and the graph's hash."""
    s = staged(_status(spark, d), "status")
    e = op.snapshot_edges(op.resolve_ends(s, load(spark, d, "entity_mapping_versions")))
    counts = s.groupBy("snapshot").agg(F.sum(F.col("reason").isNull().cast("long")).alias("supports"), F.sum(F.col("reason").isNotNull().cast("long")).alias("exclusions"))
    return op.graph_hash(e).join(counts, "snapshot")


def asof_acceptance(spark: SparkSession, d: str) -> DataFrame:
    """Acceptance of a triple at a cutoff: the latest of its versions' observation and acceptance."""
    s = _active(spark, d)
    return s.groupBy("snapshot", "subject", "relation", "object").agg(F.greatest(F.max("observed"), F.max("accepted")).alias("accepted_at"))


def asof_members_nested(spark: SparkSession, d: str) -> DataFrame:
    """Triples of a snapshot that the next one lacks, per pair of consecutive snapshots."""
    e = staged(op.snapshot_edges(_active(spark, d)).select("snapshot", "subject", "relation", "object"), "edges")
    names = [n for n, _ in CUTOFFS]
    nxt = F.element_at(F.create_map(*[F.lit(x) for p in zip(names, names[1:]) for x in p]), F.col("snapshot"))
    earlier = e.filter(F.col("snapshot") != names[-1]).select(nxt.alias("snapshot"), "subject", "relation", "object")
    lost = earlier.exceptAll(e.filter(F.col("snapshot") != names[0]))
    return lost.groupBy("snapshot").agg(F.count("*").alias("lost"))


def revision_violations(spark: SparkSession, d: str) -> DataFrame:
    return op.revision_violations(facts(spark, d))


def append_only_violations(spark: SparkSession, d: str) -> DataFrame:
    """The first delivery of each fact version against its last one, as they are written: what a redelivery changed."""
    f = load(spark, d, "fact_versions").filter("fact_version_id is not null")
    said = F.struct(*[F.coalesce(c, F.lit("-")).alias(c) for c in ("logical_fact_id", "subject_id", "object_id", "supersedes_version_id", "valid_from", "valid_to")])
    at = F.struct(iso_micros(F.col("ingested_at_real")).alias("at"), said.alias("said"))
    d2 = f.groupBy("fact_version_id").agg(F.min(at).alias("a"), F.max(at).alias("b"))
    return op.append_only_violations(d2.select("fact_version_id", "a.said.*"), d2.select("fact_version_id", "b.said.*"), "fact_version_id")


def event_cuts(spark: SparkSession, d: str) -> DataFrame:
    return op.balanced_cuts(load(spark, d, "events").withColumn("at", F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz")), "at", 7)


def event_boundaries(spark: SparkSession, d: str) -> DataFrame:
    return op.nearest_boundaries(load(spark, d, "events"), "ts", 10)


def document_times_resolved(spark: SparkSession, d: str) -> DataFrame:
    """Source versions: the archive capture, or the retrieval as publication, decides the evidence time."""
    v = load(spark, d, "source_versions").filter("source_version_id is not null")
    ntz = lambda c: F.expr(f"cast(timestamp_micros({c}) as timestamp_ntz)")
    v = v.select("source_version_id", iso_micros(F.col("archive_datetime")).alias("a"), iso_micros(F.col("retrieved_at_real")).alias("r"), "ingested_at_real", "source_version_status").select("source_version_id", ntz("a").alias("a"), ntz("r").alias("p"), F.col("ingested_at_real").alias("r"), "source_version_status")
    t = op.document_time("a", "p", "r", F.col("source_version_status") == "PARTIAL")
    return v.select("source_version_id", t.alias("t")).select("source_version_id", "t.*").distinct()


QUERIES = {f.__name__: f for f in (asof_edges, asof_exclusions, asof_reason_counts, asof_support, asof_first_events, asof_manifest, asof_acceptance, asof_members_nested, revision_violations, append_only_violations, event_cuts, event_boundaries, document_times_resolved)}

_CUT = "cu AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {op.micros(t)})" for n, t in CUTOFFS) + ") x(snapshot, cutoff))"
_us = lambda c: f"epoch_us(CAST({c} AS timestamptz))"
_FACTS = f"""WITH {_INSTANTS}, o AS (SELECT record_id, min(us) AS observed FROM inst WHERE rec_table = 'fact_versions' GROUP BY 1),
fv AS (SELECT fact_version_id AS version, min(logical_fact_id) AS logical, min(subject_id) AS subject, min(relation_id) AS relation, min(object_id) AS object, any_value(observed) AS observed, min({_us("ingested_at_real")}) AS accepted, min({_us("valid_from")}) AS valid_from, min({_us("valid_to")}) AS valid_to,
  min(supersedes_version_id) AS supersedes, min(revision_type) IS NOT DISTINCT FROM 'retraction' AS retraction, min(supporting_claim_ids) AS claims FROM fact_versions LEFT JOIN o ON record_id = fact_version_id WHERE fact_version_id IS NOT NULL GROUP BY 1)"""
_STATUS = f"""{_FACTS}, {_CUT},
x AS MATERIALIZED (SELECT fv.*, snapshot, cutoff, CASE WHEN observed IS NULL OR observed > cutoff THEN 'FUTURE_EVIDENCE_OBSERVED_AT' WHEN accepted > cutoff THEN 'FUTURE_KG_ACCEPTANCE'
  WHEN valid_from > cutoff THEN 'FUTURE_WORLD_VALIDITY' WHEN valid_to <= cutoff THEN 'EXPIRED_WORLD_VALIDITY' END AS clock FROM fv, cu),
ch AS (SELECT snapshot, logical, supersedes AS version, max(version) AS winner FROM x WHERE clock IS NULL AND supersedes IS NOT NULL GROUP BY ALL),
lo AS (SELECT ch.* FROM ch JOIN x ON x.snapshot = ch.snapshot AND x.logical = ch.logical AND x.version = ch.version AND x.clock IS NULL),
tm AS (SELECT DISTINCT snapshot, supersedes AS version FROM x WHERE retraction AND supersedes IS NOT NULL AND (clock IS NULL OR clock = 'EXPIRED_WORLD_VALIDITY')),
st AS MATERIALIZED (SELECT x.*, CASE WHEN clock IS NOT NULL THEN clock WHEN ch.version IS NOT NULL OR lo.winner <> x.version THEN 'SUPERSEDED_BY_REVISION' WHEN retraction THEN 'RETRACTION_TOMBSTONE' WHEN tm.version IS NOT NULL THEN 'RETRACTED' END AS reason
  FROM x LEFT JOIN ch ON ch.snapshot = x.snapshot AND ch.logical = x.logical AND ch.version = x.version LEFT JOIN lo ON lo.snapshot = x.snapshot AND lo.logical = x.logical AND lo.version = x.supersedes LEFT JOIN tm ON tm.snapshot = x.snapshot AND tm.version = x.version)"""
_ACTIVE = f"""{_STATUS}, mp AS (SELECT entity_mapping_id AS id, lower(mention) AS k, min({_us("mapping_available_at")}) AS av, min(supersedes_mapping_id) AS sup FROM entity_mapping_versions WHERE mention IS NOT NULL AND entity_mapping_id IS NOT NULL GROUP BY 1, 2),
mk AS (SELECT snapshot, mp.* FROM cu JOIN mp ON av <= cutoff), ms AS (SELECT DISTINCT snapshot, k, sup AS id FROM mk WHERE sup <> id),
mb AS (SELECT mk.snapshot, mk.k, arg_min(mk.id, {{'a': -av, 'b': mk.id}}) AS id FROM mk ANTI JOIN ms ON ms.snapshot = mk.snapshot AND ms.k = mk.k AND ms.id = mk.id GROUP BY 1, 2),
mc AS (SELECT entity_mapping_id AS id, min(canonical_entity_id) AS e FROM entity_mapping_versions GROUP BY 1), mr AS (SELECT snapshot, k, e FROM mb JOIN mc USING (id) WHERE e IS NOT NULL),
ac AS MATERIALIZED (SELECT st.* REPLACE (coalesce(s.e, subject) AS subject, coalesce(o.e, object) AS object) FROM st LEFT JOIN mr s ON s.snapshot = st.snapshot AND s.k = lower(subject) LEFT JOIN mr o ON o.snapshot = st.snapshot AND o.k = lower(object) WHERE reason IS NULL)"""
_ID = "'edge_' || snapshot || '_' || substr(sha256(subject || '|' || relation || '|' || object), 1, 16)"
_EDGES = f"{_ACTIVE}, ed AS (SELECT snapshot, {_ID} AS edge_id, subject, relation, object, count(*) AS support FROM ac GROUP BY ALL)"
_GROUPS = "g AS (SELECT tm, count(*) AS c, sum(count(*)) OVER (ORDER BY tm) AS cum, sum(count(*)) OVER () AS total FROM t GROUP BY tm)"

SQL = {
    "asof_edges": f"{_EDGES} SELECT * FROM ed",
    "asof_exclusions": f"{_STATUS} SELECT snapshot, version, reason FROM st WHERE reason IS NOT NULL",
    "asof_reason_counts": f"{_STATUS} SELECT snapshot, coalesce(reason, 'INCLUDED') AS reason, count(*) AS n FROM st GROUP BY ALL",
    "asof_support": f"""{_ACTIVE}, p AS (SELECT provenance_id, any_value(claim_id) AS claim_id, any_value(membership_id) AS membership_id, any_value(source_version_id) AS source_version_id, any_value(retrieval_id) AS retrieval_id, any_value(raw_blob_sha256) AS raw_blob_sha256 FROM (SELECT * FROM claim_provenance WHERE provenance_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY provenance_id ORDER BY claim_id NULLS FIRST, membership_id NULLS FIRST, source_version_id NULLS FIRST, retrieval_id NULLS FIRST, raw_blob_sha256 NULLS FIRST) = 1) GROUP BY 1),
u AS (SELECT {_ID} AS edge_id, version AS fact_version_id, unnest(CASE WHEN len(claims) > 0 THEN list_distinct(claims) ELSE [NULL] END) AS claim_id FROM ac)
SELECT 'supp_' || edge_id || '_' || fact_version_id || '_' || substr(sha256(provenance_id), 1, 16) AS support_id, edge_id, fact_version_id, u.claim_id, provenance_id, source_version_id, raw_blob_sha256,
  CASE WHEN provenance_id IS NULL THEN 'MISSING_PROVENANCE' WHEN coalesce(trim(membership_id), '') = '' OR coalesce(trim(source_version_id), '') = '' OR coalesce(trim(retrieval_id), '') = '' OR coalesce(trim(raw_blob_sha256), '') = '' THEN 'INCOMPLETE' WHEN NOT regexp_full_match(raw_blob_sha256, '[0-9a-f]{{64}}') THEN 'BAD_HASH' END AS problem
FROM u LEFT JOIN p ON p.claim_id = u.claim_id""",
    "asof_first_events": f"{_ACTIVE} SELECT subject, relation, object, arg_min(version, {{'o': observed, 'v': version}}) AS version, min(observed) AS observed FROM ac GROUP BY ALL",
    "asof_manifest": f"""{_EDGES}, bk AS (SELECT snapshot, substr(sha256(subject), 1, 2) AS bucket, sha256(string_agg(subject || chr(9) || relation || chr(9) || object, chr(10) ORDER BY subject || chr(9) || relation || chr(9) || object)) AS h, count(*) AS n FROM ed GROUP BY 1, 2)
SELECT bk.snapshot, CAST(sum(n) AS bigint) AS edges, sha256(string_agg(h, chr(10) ORDER BY bucket)) AS graph_sha256, any_value(supports) AS supports, any_value(exclusions) AS exclusions
FROM bk JOIN (SELECT snapshot, count(*) FILTER (reason IS NULL) AS supports, count(*) FILTER (reason IS NOT NULL) AS exclusions FROM st GROUP BY 1) k ON bk.snapshot = k.snapshot GROUP BY 1""",
    "asof_acceptance": f"{_ACTIVE} SELECT snapshot, subject, relation, object, greatest(max(observed), max(accepted)) AS accepted_at FROM ac GROUP BY ALL",
    "asof_members_nested": f"{_EDGES}, n AS (SELECT snapshot, lead(snapshot) OVER (ORDER BY snapshot) AS nxt FROM cu) SELECT nxt AS snapshot, count(*) AS lost FROM ed JOIN n USING (snapshot) ANTI JOIN ed y ON y.snapshot = nxt AND y.subject = ed.subject AND y.relation = ed.relation AND y.object = ed.object WHERE nxt IS NOT NULL GROUP BY 1",
    "revision_violations": f"""{_FACTS}, s AS (SELECT supersedes, count(*) > 1 AS shared FROM fv WHERE supersedes IS NOT NULL GROUP BY 1),
j AS (SELECT fv.version, CASE WHEN p.version IS NULL THEN 'MISSING_PARENT' WHEN p.logical <> fv.logical THEN 'OTHER_FACT' WHEN p.accepted > fv.accepted THEN 'ACCEPTED_BEFORE_PARENT' WHEN shared THEN 'COMPETING_REVISION' END AS problem FROM fv JOIN s USING (supersedes) LEFT JOIN fv p ON p.version = fv.supersedes)
SELECT version, problem FROM j WHERE problem IS NOT NULL""",
    "append_only_violations": f"""WITH k AS (SELECT fact_version_id, {{'at': {_us("ingested_at_real")}, 'l': coalesce(logical_fact_id, '-'), 's': coalesce(subject_id, '-'), 'o': coalesce(object_id, '-'), 'p': coalesce(supersedes_version_id, '-'), 'f': coalesce(valid_from, '-'), 't': coalesce(valid_to, '-')}} AS r FROM fact_versions WHERE fact_version_id IS NOT NULL),
g AS (SELECT fact_version_id, min(r) AS a, max(r) AS b FROM k GROUP BY 1) SELECT fact_version_id, 'CHANGED' AS problem FROM g WHERE (a.l, a.s, a.o, a.p, a.f, a.t) <> (b.l, b.s, b.o, b.p, b.f, b.t)""",
    "event_cuts": f"""WITH t AS (SELECT date_trunc('hour', ts) AS tm FROM events), {_GROUPS}, k AS (SELECT unnest(range(1, 7)) AS k, (SELECT count(*) FROM t) AS n)
SELECT CAST(k AS int) AS k, CAST(cum AS bigint) AS rows_before FROM k JOIN g ON cum >= round_even(k * n / 7.0, 0) AND cum - c < round_even(k * n / 7.0, 0) UNION ALL SELECT 0, 0 UNION ALL SELECT 7, count(*) FROM t""",
    "event_boundaries": f"WITH t AS (SELECT ts AS tm FROM events), {_GROUPS}, p AS (SELECT CAST(unnest(range(1, 11)) AS int) AS position) SELECT position, arg_min(tm, {{'d': abs(cum * 10 - total * position), 'tm': tm}}) AS cutoff FROM g, p GROUP BY 1",
    "document_times_resolved": """WITH v AS (SELECT source_version_id, CAST(archive_datetime AS timestamptz) AT TIME ZONE 'UTC' AS a, CAST(retrieved_at_real AS timestamptz) AT TIME ZONE 'UTC' AS p, ingested_at_real AS r, source_version_status = 'PARTIAL' AS chrome FROM source_versions WHERE source_version_id IS NOT NULL)
SELECT DISTINCT source_version_id, CASE WHEN a IS NOT NULL THEN a WHEN chrome OR p IS NULL OR p > r THEN NULL ELSE p END AS observed_at,
 CASE WHEN a IS NOT NULL THEN 'wayback_archive_datetime' WHEN chrome OR p IS NULL OR p > r THEN NULL ELSE 'publisher_declared_published_at' END AS basis,
 CASE WHEN a IS NOT NULL THEN 'high' WHEN chrome OR p IS NULL OR p > r THEN NULL ELSE 'medium' END AS confidence,
 CASE WHEN a IS NOT NULL THEN CASE WHEN p > a THEN 'PUBLISHED_AFTER_ARCHIVE_IGNORED' END WHEN chrome THEN 'CHROME_TEXT_ONLY' WHEN p > r THEN 'PUBLISHED_AFTER_RETRIEVAL' END AS flag,
 CASE WHEN a IS NOT NULL THEN NULL WHEN chrome THEN 'CHROME_TEASER_EVIDENCE_TIME_UNKNOWN' WHEN p IS NULL THEN 'NO_EVIDENCE_TIME_SOURCE' WHEN p > r THEN 'PUBLISHED_AFTER_RETRIEVAL' END AS exclusion_reason FROM v""",
}
