"""Contracts, evidence, provenance, adjudication and entity maps, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expressions as x
from ..functions import html
from ..operators import provenance as op
from ..operators.asof import decision_periods
from ..operators.history import lineage_roots
from ..runtime import load
from ..sources import contracts

_KEYED = ["extracted_claims", "claim_provenance", "fact_versions", "snapshot_edges", "snapshot_edge_support", "entity_mapping_versions", "source_versions"]
# Child, field, parent, key.
_FOREIGN = [
    ("claim_provenance", "claim_id", "extracted_claims", "claim_id"),
    ("claim_provenance", "source_version_id", "source_versions", "source_version_id"),
    ("snapshot_edge_support", "edge_id", "snapshot_edges", "edge_id"),
    ("snapshot_edge_support", "fact_version_id", "fact_versions", "fact_version_id"),
    ("snapshot_edge_support", "claim_id", "extracted_claims", "claim_id"),
    ("snapshot_edge_support", "provenance_id", "claim_provenance", "provenance_id"),
    ("fact_versions", "supersedes_version_id", "fact_versions", "fact_version_id"),
    ("entity_mapping_versions", "supersedes_mapping_id", "entity_mapping_versions", "entity_mapping_id"),
]


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def contract_key_violations(spark: SparkSession, d: str) -> DataFrame:
    return _union([contracts.key_violations(load(spark, d, t), t) for t in _KEYED])


def contract_foreign_violations(spark: SparkSession, d: str) -> DataFrame:
    parts = [contracts.foreign_violations(load(spark, d, c), f, load(spark, d, p), k).select(F.lit(c).alias("child"), F.lit(f).alias("field"), "ref", "n") for c, f, p, k in _FOREIGN]
    return _union(parts)


def contract_hash_violations(spark: SparkSession, d: str) -> DataFrame:
    return _union([contracts.hash_violations(load(spark, d, t), t) for t in ("extracted_claims", "claim_provenance", "fact_versions", "saved_null_observations_v1")])


def contract_gate(spark: SparkSession, d: str) -> DataFrame:
    """The gravest status of the checks on keys and references."""
    keys = contract_key_violations(spark, d).agg(F.when(F.count("*") > 0, "FAIL").otherwise("PASS").alias("status"))
    refs = contract_foreign_violations(spark, d).agg(F.when(F.count("*") > 0, "BLOCKED").otherwise("PASS").alias("status"))
    return contracts.status_fold(keys.unionByName(refs))


def claims_grounded(spark: SparkSession, d: str) -> DataFrame:
    g = op.ground_claims(load(spark, d, "extracted_claims").drop("schema_version").distinct(), load(spark, d, "documents"), "body_variant_id", "text")
    return g.select("claim_id", "ingested_at_real", "problem")


def claim_problem_counts(spark: SparkSession, d: str) -> DataFrame:
    return claims_grounded(spark, d).groupBy(F.coalesce("problem", F.lit("GROUNDED")).alias("problem")).agg(F.count("*").alias("n"))


def exact_clusters(spark: SparkSession, d: str) -> DataFrame:
    return op.exact_clusters(load(spark, d, "documents"), "doc_id", "text")


def exact_cluster_members(spark: SparkSession, d: str) -> DataFrame:
    """The cluster of every document with a text."""
    return op.cluster_members(load(spark, d, "documents"), "doc_id", "text")


def provenance_chain(spark: SparkSession, d: str) -> DataFrame:
    return op.provenance_chain(load(spark, d, "extracted_claims"), load(spark, d, "claim_provenance"), load(spark, d, "source_versions"))


def source_claim_rows(spark: SparkSession, d: str) -> DataFrame:
    return op.source_claims(load(spark, d, "extracted_claims"), load(spark, d, "claim_provenance"))


def claim_match_histogram(spark: SparkSession, d: str) -> DataFrame:
    keys = ["subject_id", "relation_id", "object_id", "evidence_text_hash"]
    c = load(spark, d, "extracted_claims").select(F.col("subject_mention").alias("subject_id"), F.col("relation_name").alias("relation_id"), F.col("object_mention").alias("object_id"), "evidence_text_hash")
    return op.match_histogram(load(spark, d, "fact_versions").select(*keys), c, keys)


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "extracted_claims").filter("claim_id is not null")
    c = c.groupBy("claim_id").agg(F.min("ingested_at_real").alias("at"), *[F.min(k).alias(k) for k in ("subject_mention", "object_mention", "relation_name", "is_negative", "is_speculative")])
    m = load(spark, d, "entity_mapping_versions").filter("mapping_basis = 'catalog'").select("mention", F.col("canonical_entity_id").alias("entity"))
    return op.resolve_mentions(c, m)


def claims_adjudicated(spark: SparkSession, d: str) -> DataFrame:
    return op.adjudicate(_resolved(spark, d), "at")


def fact_support(spark: SparkSession, d: str) -> DataFrame:
    return op.fact_support(claims_adjudicated(spark, d))


def fact_support_claims(spark: SparkSession, d: str) -> DataFrame:
    """Every accepted or merged claim of every fact."""
    return op.supporting_claims(claims_adjudicated(spark, d))


def latest_fact(spark: SparkSession, d: str) -> DataFrame:
    """The last version of each logical fact by (arrival, id)."""
    f = load(spark, d, "fact_versions")
    return f.groupBy("logical_fact_id").agg(F.max_by("fact_version_id", F.struct("ingested_at_real", "fact_version_id")).alias("fact_version_id"), F.max("ingested_at_real").alias("ingested_at_real"))


def extraction_quality(spark: SparkSession, d: str) -> DataFrame:
    """Subject and relation of fact versions, as gold, against those of claims."""
    gold = load(spark, d, "fact_versions").select(F.col("subject_id").alias("s"), F.col("relation_id").alias("r"))
    claims = load(spark, d, "extracted_claims").filter("not is_negative and not is_speculative").select(F.col("subject_mention").alias("s"), F.col("relation_name").alias("r"))
    return op.quality(gold, claims, ["s", "r"])


def edge_parity(spark: SparkSession, d: str) -> DataFrame:
    """Every snapshot and the one before it as multisets of triples; snapshot_id is the later one."""
    return op.consecutive_differences(load(spark, d, "snapshot_edges"), "snapshot_id", ["subject_id", "relation_id", "object_id"])


def document_scope(spark: SparkSession, d: str) -> DataFrame:
    """Why each document is in scope or not: source, time of fetching, key words."""
    t = load(spark, d, "documents")
    reason = (
        F.when(F.col("source").isNull() | F.col("source").rlike("^src_n"), "SOURCE_NOT_ALLOWED")
        .when(F.col("fetched_at").isNull() | ~F.col("fetched_at").between("2025-01-01", "2026-06-30 23:59:59"), "OUTSIDE_WINDOW")
        .when(~F.coalesce(F.lower("text").rlike("model|partnership|mô hình"), F.lit(False)), "NO_KEYWORD")
        .otherwise("IN_SCOPE")
    )
    return t.select("doc_id", reason.alias("reason"))


def document_profile(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "documents").select(x.content_type("text").alias("content_type"), F.length("text").alias("n"))
    return t.groupBy("content_type").agg(F.count("*").alias("docs"), F.sum("n").alias("chars"), F.max("n").alias("longest"))


def document_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Per body: documents, first fetch and its source, number of different blobs."""
    t = load(spark, d, "documents").filter("body_variant_id is not null")
    return t.groupBy("body_variant_id").agg(F.count("*").alias("docs"), F.min("fetched_at").alias("first_fetched_at"), F.min_by("source", F.struct("fetched_at", "doc_id")).alias("first_source"), F.countDistinct("raw_blob_sha256").alias("blobs"))


def article_number_fit(spark: SparkSession, d: str) -> DataFrame:
    """The number at the end of the URL against the day of fetching: linear fit and spread of the deviation."""
    t = load(spark, d, "documents").select(F.regexp_extract("url", r"-(\d+)\.htm$", 1).try_cast("double").alias("n"), F.datediff("fetched_at", F.lit("2024-01-01")).cast("double").alias("day")).filter("n is not null and day is not null")
    fit = t.agg(F.regr_slope("day", "n").alias("slope"), F.regr_intercept("day", "n").alias("intercept"))
    dev = t.join(F.broadcast(fit)).select("slope", "intercept", F.abs(F.col("day") - (F.col("slope") * F.col("n") + F.col("intercept"))).alias("dev"))
    return dev.groupBy("slope", "intercept").agg(F.percentile("dev", 0.5).alias("median"), F.percentile("dev", 0.9).alias("p90"), F.max("dev").alias("max")).select(*[F.round(c, 6).alias(c) for c in ("slope", "intercept", "median", "p90", "max")])


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    """(mention, nfc): the different mentions of claims and mappings, as written and in composed form."""
    c = load(spark, d, "extracted_claims").select(F.explode(F.array("subject_mention", "object_mention")).alias("mention"))
    m = c.unionByName(load(spark, d, "entity_mapping_versions").select("mention")).filter("mention is not null").distinct()
    return m.select("mention", html.normal_form("mention").alias("nfc"))


def mention_keys(spark: SparkSession, d: str) -> DataFrame:
    m = _mentions(spark, d).withColumn("key", x.mention_key("nfc"))
    return m.select("mention", "key", x.is_generic("nfc").alias("generic"), x.entity_id("key").alias("entity"))


def entity_surfaces(spark: SparkSession, d: str) -> DataFrame:
    """The primary spelling of each canonical entity: most rows, then shortest, then first."""
    m = load(spark, d, "entity_mapping_versions").filter("mention is not null").groupBy("canonical_entity_id", "mention").agg(F.count("*").alias("n"))
    w = Window.partitionBy("canonical_entity_id").orderBy(F.desc("n"), F.length("mention"), "mention")
    return m.withColumn("r", F.row_number().over(w)).filter("r = 1").select("canonical_entity_id", F.col("mention").alias("primary_mention"), "n")


def entity_merge_actions(spark: SparkSession, d: str) -> DataFrame:
    """MERGE for canonical entities whose mentions have several keys, else KEEP."""
    m = load(spark, d, "entity_mapping_versions").filter("mention is not null").select("canonical_entity_id", x.mention_key(html.normal_form("mention")).alias("key"))
    return m.groupBy("canonical_entity_id").agg(F.countDistinct("key").alias("keys")).withColumn("action", F.when(F.col("keys") > 1, "MERGE").otherwise("KEEP"))


def entity_first_seen(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "snapshot_edges")
    both = e.select(F.explode(F.array("subject_id", "object_id")).alias("entity_id"), "ingested_at_real", "snapshot_id").filter("entity_id is not null")
    return both.groupBy("entity_id").agg(F.min("ingested_at_real").alias("first_seen"), F.min("snapshot_id").alias("first_snapshot"), F.countDistinct("snapshot_id").alias("snapshots"))


def mappings_at_cutoff(spark: SparkSession, d: str) -> DataFrame:
    """The decision of each mention that holds on 2025-06-01, and what every fact's subject resolves to then."""
    at = 1_748_736_000_000_000
    p = decision_periods(load(spark, d, "entity_mapping_versions"), "entity_mapping_id", "mention", "mapping_available_at", "supersedes_mapping_id")
    held = p.filter((F.col("since") <= at) & (F.col("until").isNull() | (F.col("until") > at))).select("entity", F.col("id").alias("entity_mapping_id"))
    s = load(spark, d, "fact_versions").select(F.col("subject_id").alias("mention")).filter("mention is not null").distinct()
    to = load(spark, d, "entity_mapping_versions").groupBy("entity_mapping_id").agg(F.min("canonical_entity_id").alias("c"))
    j = s.join(held, F.lower("mention") == F.col("entity"), "left").join(to, "entity_mapping_id", "left")
    return j.select("mention", "entity_mapping_id", F.coalesce("c", "mention").alias("resolved"))


def acronym_proposals(spark: SparkSession, d: str) -> DataFrame:
    """Names with the acronym that they carry in parentheses, where another name carries it too; acronym_aliases has those that occur alone."""
    c = load(spark, d, "extracted_claims")
    m = c.select(F.explode(F.array("subject_mention", "object_mention")).alias("mention")).filter("mention is not null").distinct()
    a = m.select("mention", F.regexp_extract("mention", r"\(([A-Z]{2,6})\)\s*$", 1).alias("acronym")).filter("acronym <> ''")
    return a.alias("a").join(a.alias("b"), F.expr("a.acronym = b.acronym and a.mention < b.mention")).select("a.acronym", F.col("a.mention").alias("name_a"), F.col("b.mention").alias("name_b"))


def acronym_aliases(spark: SparkSession, d: str) -> DataFrame:
    """Names with an acronym in parentheses, and the mentions of claims and mappings whose key is that acronym alone."""
    m = _mentions(spark, d).withColumn("key", x.mention_key("nfc"))
    a = m.select(F.col("mention").alias("name"), F.col("key").alias("name_key"), F.regexp_extract("mention", r"\(([A-Z]{2,6})\)\s*$", 1).alias("acronym")).filter("acronym <> ''")
    return a.join(m, (F.lower("acronym") == F.col("key")) & ~F.col("name_key").eqNullSafe(F.col("key"))).select("acronym", "name", F.col("mention").alias("alias"))


def suffix_proposals(spark: SparkSession, d: str) -> DataFrame:
    """Keys that equal another one but for their last word."""
    k = _mentions(spark, d).select(x.mention_key("nfc").alias("k")).filter("k <> ''").distinct()
    a = k.select(F.col("k").alias("long_key"), F.regexp_replace("k", " [^ ]+$", "").alias("base")).filter("base <> long_key")
    return a.join(k.select(F.col("k").alias("base")), "base").select("long_key", "base")


def version_lineage(spark: SparkSession, d: str) -> DataFrame:
    """The first version of each chain of revisions and the number of revisions since."""
    return lineage_roots(load(spark, d, "fact_versions"), "fact_version_id", "supersedes_version_id")


def mapping_lineage(spark: SparkSession, d: str) -> DataFrame:
    return lineage_roots(load(spark, d, "entity_mapping_versions"), "entity_mapping_id", "supersedes_mapping_id")


QUERIES = {
    f.__name__: f
    for f in (
        contract_key_violations, contract_foreign_violations, contract_hash_violations, contract_gate, claims_grounded, claim_problem_counts, exact_clusters, exact_cluster_members, provenance_chain, source_claim_rows,
        claim_match_histogram, claims_adjudicated, fact_support, fact_support_claims, latest_fact, extraction_quality, edge_parity, document_scope, document_profile, document_ledger, article_number_fit, mention_keys,
        entity_surfaces, entity_merge_actions, entity_first_seen, mappings_at_cutoff, acronym_proposals, acronym_aliases, suffix_proposals, version_lineage, mapping_lineage,
    )
}

_KEYS = " UNION ALL ".join(f"SELECT '{t}' AS table_name, {contracts.primary_key(t)} AS key, CASE WHEN {contracts.primary_key(t)} IS NULL THEN 'NULL_KEY' ELSE 'DUPLICATE_KEY' END AS problem, count(*) AS n FROM {t} GROUP BY {contracts.primary_key(t)} HAVING {contracts.primary_key(t)} IS NULL OR count(*) > 1" for t in _KEYED)
_REFS = " UNION ALL ".join(f"SELECT '{c}' AS child, '{f}' AS field, {f} AS ref, count(*) AS n FROM {c} WHERE {f} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {p} p WHERE p.{k} = {c}.{f}) GROUP BY {f}" for c, f, p, k in _FOREIGN)
_HASHED = [("extracted_claims", ["evidence_text_hash"]), ("claim_provenance", ["raw_blob_sha256"]), ("fact_versions", ["evidence_text_hash"]), ("saved_null_observations_v1", ["alignment_sha256", "anchor_plan_hash", "source_checkpoint_sha256", "target_checkpoint_sha256"])]
_GROUND = """b AS (SELECT body_variant_id AS bid, min(text) AS t FROM documents WHERE text IS NOT NULL GROUP BY 1),
g AS (SELECT c.*, bid, CASE WHEN evidence_span_start >= 0 AND evidence_span_end > evidence_span_start AND evidence_span_end <= length(t) THEN substring(t, evidence_span_start + 1, evidence_span_end - evidence_span_start) END AS s
  FROM (SELECT DISTINCT * EXCLUDE (schema_version) FROM extracted_claims) c LEFT JOIN b ON c.body_variant_id = b.bid),
r AS (SELECT claim_id, ingested_at_real, CASE WHEN coalesce(trim(subject_mention) = '', true) OR coalesce(trim(object_mention) = '', true) THEN 'MISSING_MENTION' WHEN bid IS NULL THEN 'MISSING_BODY' WHEN s IS NULL THEN 'SPAN_OUT_OF_RANGE'
  WHEN sha256(s) IS DISTINCT FROM evidence_text_hash THEN 'HASH_MISMATCH' WHEN NOT contains(lower(s), lower(trim(subject_mention))) THEN 'SUBJECT_NOT_IN_SPAN' WHEN NOT contains(lower(s), lower(trim(object_mention))) THEN 'OBJECT_NOT_IN_SPAN' END AS problem FROM g)"""
_ADJ = """c AS (SELECT claim_id, min(ingested_at_real) AS tm, min(subject_mention) AS sm, min(object_mention) AS om, min(relation_name) AS rn, min(is_negative) AS neg, min(is_speculative) AS spec FROM extracted_claims WHERE claim_id IS NOT NULL GROUP BY 1),
k AS (SELECT lower(trim(mention)) AS m, min(canonical_entity_id) AS e FROM entity_mapping_versions WHERE mapping_basis = 'catalog' AND mention IS NOT NULL GROUP BY 1 HAVING min(canonical_entity_id) = max(canonical_entity_id)),
j AS (SELECT c.*, a.e AS s, b.e AS o FROM c LEFT JOIN k a ON lower(trim(sm)) = a.m LEFT JOIN k b ON lower(trim(om)) = b.m),
q AS (SELECT *, CASE WHEN neg THEN 'QUEUED_NEGATED' WHEN spec THEN 'QUEUED_SPECULATIVE' WHEN s IS NULL THEN 'QUEUED_UNRESOLVED_SUBJECT' WHEN o IS NULL THEN 'QUEUED_UNRESOLVED_OBJECT' WHEN s = o THEN 'QUEUED_SELF_LOOP' END AS reason FROM j),
l AS (SELECT *, CASE WHEN reason IS NULL THEN substr(sha256(concat_ws('|', s, rn, o)), 1, 16) END AS logical_fact_id FROM q),
dec AS (SELECT claim_id, CASE WHEN reason IS NOT NULL THEN reason WHEN row_number() OVER (PARTITION BY logical_fact_id, reason ORDER BY tm, claim_id) = 1 THEN 'ACCEPTED' ELSE 'MERGED' END AS decision, logical_fact_id FROM l)"""
_BEFORE = "|".join(x.CLASS_WORDS)
_K1 = r"""trim(regexp_replace(trim(nfc_normalize(mention)), '^(.*?\S)(?:\s*\([^()\p{Nd}]*\))+\s*$', '\1'))"""
_K2 = rf"""regexp_replace(regexp_replace(regexp_replace(regexp_replace({_K1}, '[‐-―_\-]+', ' ', 'g'), '["''“”‘’]+', '', 'g'), '\s+', ' ', 'g'), '^[ .,;:]+|[ .,;:]+$', '', 'g')"""
_K3 = rf"CASE WHEN regexp_matches({_K2}, '^(?i)bà rịa( |$)') THEN {_K2} ELSE regexp_replace({_K2}, '^(?i:{_BEFORE}) ([\p{{Lu}}\p{{Nd}}].*)$', '\1') END"
_MKEY = rf"regexp_replace(lower({_K3}), ' (?:{'|'.join(x.LEGAL_WORDS)})\.*$', '')"
_ALL = "SELECT DISTINCT mention FROM (SELECT unnest([subject_mention, object_mention]) AS mention FROM extracted_claims UNION ALL SELECT mention FROM entity_mapping_versions) WHERE mention IS NOT NULL"
_NFC = r"regexp_replace(trim(nfc_normalize(mention)), '\s+', ' ', 'g')"
_GENERIC = rf"({_NFC} = '' OR lower({_NFC}) IN ({', '.join(f"'{w}'" for w in x.NOBODY)}) OR regexp_full_match({_NFC}, '\p{{Ll}}[\p{{Ll}}\p{{Lo}}\p{{Lm}}]*(?: [\p{{Ll}}\p{{Lo}}\p{{Lm}}]+)+'))"

_LINE = """WITH RECURSIVE v AS (SELECT {k} AS k, min({p}) AS p FROM {t} WHERE {k} IS NOT NULL GROUP BY 1), w AS (SELECT k, k AS pos, 0 AS depth FROM v UNION ALL SELECT w.k, v.p, depth + 1 FROM w JOIN v ON v.k = w.pos JOIN v q ON q.k = v.p)
SELECT k AS {k}, arg_max(pos, depth) AS root, CAST(max(depth) AS bigint) AS depth FROM w GROUP BY 1"""

SQL = {
    "version_lineage": _LINE.format(t="fact_versions", k="fact_version_id", p="supersedes_version_id"),
    "mapping_lineage": _LINE.format(t="entity_mapping_versions", k="entity_mapping_id", p="supersedes_mapping_id"),
    "contract_key_violations": _KEYS,
    "contract_foreign_violations": _REFS,
    "contract_hash_violations": " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS field, count(*) FILTER (NOT regexp_full_match({c}, '[0-9a-f]{{64}}')) AS n FROM {t}" for t, cs in _HASHED for c in cs),
    "contract_gate": f"SELECT CASE WHEN EXISTS (SELECT 1 FROM ({_KEYS})) THEN 'FAIL' WHEN EXISTS (SELECT 1 FROM ({_REFS})) THEN 'BLOCKED' ELSE 'PASS' END AS status",
    "claims_grounded": f"WITH {_GROUND} SELECT * FROM r",
    "claim_problem_counts": f"WITH {_GROUND} SELECT coalesce(problem, 'GROUNDED') AS problem, count(*) AS n FROM r GROUP BY 1",
    "exact_clusters": "SELECT sha256(text) AS body_sha256, count(*) AS members, min(doc_id) AS first_member FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "exact_cluster_members": "SELECT doc_id, sha256(text) AS body_sha256 FROM documents WHERE text IS NOT NULL",
    "provenance_chain": """WITH c AS (SELECT DISTINCT claim_id FROM extracted_claims WHERE claim_id IS NOT NULL), p AS (SELECT DISTINCT claim_id, provenance_id, source_version_id, raw_blob_sha256, retrieval_id FROM claim_provenance),
v AS (SELECT source_version_id, min(raw_blob_sha256) AS vb, min(retrieval_id) AS vr FROM source_versions WHERE source_version_id IS NOT NULL GROUP BY 1)
SELECT c.claim_id, provenance_id, p.source_version_id, CASE WHEN provenance_id IS NULL THEN 'NO_PROVENANCE' WHEN v.source_version_id IS NULL THEN 'NO_SOURCE_VERSION' WHEN vb IS DISTINCT FROM raw_blob_sha256 THEN 'BLOB_MISMATCH' WHEN vr IS DISTINCT FROM p.retrieval_id THEN 'RETRIEVAL_MISMATCH' ELSE 'COMPLETE' END AS status
FROM c LEFT JOIN p ON c.claim_id = p.claim_id LEFT JOIN v ON p.source_version_id = v.source_version_id""",
    "source_claim_rows": "SELECT DISTINCT 'sc_' || substr(sha256(claim_id || '|' || provenance_id), 1, 32) AS source_claim_id, claim_id, provenance_id FROM claim_provenance WHERE provenance_id IS NOT NULL AND claim_id IN (SELECT claim_id FROM extracted_claims WHERE claim_id IS NOT NULL)",
    "claim_match_histogram": """WITH r AS (SELECT subject_mention AS s, relation_name AS rn, object_mention AS o, evidence_text_hash AS h, count(*) AS m FROM extracted_claims GROUP BY ALL)
SELECT coalesce(m, 0) AS matches, count(*) AS n FROM fact_versions f LEFT JOIN r ON f.subject_id = s AND f.relation_id = rn AND f.object_id = o AND f.evidence_text_hash = h GROUP BY 1""",
    "claims_adjudicated": f"WITH {_ADJ} SELECT * FROM dec",
    "fact_support": f"WITH {_ADJ} SELECT logical_fact_id, count(*) AS supporting_claims, min(claim_id) AS first_claim FROM dec WHERE logical_fact_id IS NOT NULL GROUP BY 1",
    "fact_support_claims": f"WITH {_ADJ} SELECT logical_fact_id, claim_id FROM dec WHERE logical_fact_id IS NOT NULL",
    "latest_fact": "SELECT logical_fact_id, arg_max(fact_version_id, {'a': ingested_at_real, 'b': fact_version_id}) AS fact_version_id, max(ingested_at_real) AS ingested_at_real FROM fact_versions GROUP BY 1",
    "extraction_quality": """WITH a AS (SELECT DISTINCT subject_id AS s, relation_id AS r FROM fact_versions), b AS (SELECT DISTINCT subject_mention AS s, relation_name AS r FROM extracted_claims WHERE NOT is_negative AND NOT is_speculative),
n AS (SELECT (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS tp, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS fp, (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS fn)
SELECT tp, fp, fn, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1 FROM n""",
    "edge_parity": """WITH i AS (SELECT snapshot_id AS a, lead(snapshot_id) OVER (ORDER BY snapshot_id) AS b FROM (SELECT DISTINCT snapshot_id FROM snapshot_edges WHERE snapshot_id IS NOT NULL)),
k AS (SELECT snapshot_id, subject_id AS s, relation_id AS r, object_id AS o, count(*) AS n FROM snapshot_edges GROUP BY ALL), t AS (SELECT b, s, r, o, n AS x, 0 AS y FROM i JOIN k ON snapshot_id = a WHERE b IS NOT NULL UNION ALL SELECT b, s, r, o, 0, n FROM i JOIN k ON snapshot_id = b),
g AS (SELECT b, sum(x) AS x, sum(y) AS y FROM t GROUP BY b, s, r, o) SELECT b AS snapshot_id, 'LEFT' AS side, CAST(sum(greatest(x - y, 0)) AS bigint) AS n FROM g GROUP BY 1 UNION ALL SELECT b, 'RIGHT', CAST(sum(greatest(y - x, 0)) AS bigint) FROM g GROUP BY 1""",
    "document_scope": """SELECT doc_id, CASE WHEN source IS NULL OR source LIKE 'src_n%' THEN 'SOURCE_NOT_ALLOWED' WHEN fetched_at IS NULL OR NOT fetched_at BETWEEN TIMESTAMP '2025-01-01' AND TIMESTAMP '2026-06-30 23:59:59' THEN 'OUTSIDE_WINDOW'
WHEN NOT coalesce(regexp_matches(lower(text), 'model|partnership|mô hình'), false) THEN 'NO_KEYWORD' ELSE 'IN_SCOPE' END AS reason FROM documents""",
    "document_profile": """WITH t AS (SELECT length(text) AS n, lower(ltrim(substring(text, 1, 16384), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS h FROM documents)
SELECT CASE WHEN h IS NULL OR h = '' THEN 'empty' WHEN contains(substring(h, 1, 1024), '<!doctype html') OR contains(substring(h, 1, 4096), '<html') THEN 'text/html' WHEN h LIKE '<?xml%' THEN 'application/xml' WHEN h LIKE '{%' OR h LIKE '[%' THEN 'application/json' ELSE 'text/plain' END AS content_type,
count(*) AS docs, CAST(sum(n) AS bigint) AS chars, max(n) AS longest FROM t GROUP BY 1""",
    "document_ledger": "SELECT body_variant_id, count(*) AS docs, min(fetched_at) AS first_fetched_at, arg_min(source, {'f': fetched_at, 'd': doc_id}) AS first_source, count(DISTINCT raw_blob_sha256) AS blobs FROM documents WHERE body_variant_id IS NOT NULL GROUP BY 1",
    "article_number_fit": r"""WITH t AS (SELECT TRY_CAST(nullif(regexp_extract(url, '-(\d+)\.htm$', 1), '') AS double) AS n, CAST(date_diff('day', DATE '2024-01-01', CAST(fetched_at AS date)) AS double) AS day FROM documents),
u AS (SELECT * FROM t WHERE n IS NOT NULL AND day IS NOT NULL), f AS (SELECT regr_slope(day, n) AS slope, regr_intercept(day, n) AS intercept FROM u), v AS (SELECT slope, intercept, abs(day - (slope * n + intercept)) AS dev FROM u, f)
SELECT round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(quantile_cont(dev, 0.5), 6) AS median, round(quantile_cont(dev, 0.9), 6) AS p90, round(max(dev), 6) AS max FROM v GROUP BY slope, intercept""",
    "mention_keys": f"WITH m AS ({_ALL}), k AS (SELECT mention, {_MKEY} AS key, {_GENERIC} AS generic FROM m) SELECT *, 'ent2_' || substr(sha256('{x.ENTITY_VERSION}|' || key), 1, 8) AS entity FROM k",
    "entity_surfaces": "WITH m AS (SELECT canonical_entity_id, mention, count(*) AS n FROM entity_mapping_versions WHERE mention IS NOT NULL GROUP BY ALL) SELECT canonical_entity_id, mention AS primary_mention, n FROM m QUALIFY row_number() OVER (PARTITION BY canonical_entity_id ORDER BY n DESC, length(mention), mention) = 1",
    "entity_merge_actions": f"WITH k AS (SELECT canonical_entity_id, {_MKEY} AS key FROM entity_mapping_versions WHERE mention IS NOT NULL) SELECT canonical_entity_id, count(DISTINCT key) AS keys, CASE WHEN count(DISTINCT key) > 1 THEN 'MERGE' ELSE 'KEEP' END AS action FROM k GROUP BY 1",
    "entity_first_seen": "WITH b AS (SELECT unnest([subject_id, object_id]) AS entity_id, ingested_at_real, snapshot_id FROM snapshot_edges) SELECT entity_id, min(ingested_at_real) AS first_seen, min(snapshot_id) AS first_snapshot, count(DISTINCT snapshot_id) AS snapshots FROM b WHERE entity_id IS NOT NULL GROUP BY 1",
    "mappings_at_cutoff": """WITH m AS (SELECT entity_mapping_id AS id, lower(mention) AS k, min(CAST(mapping_available_at AS timestamptz)) AS av, min(supersedes_mapping_id) AS sup, min(canonical_entity_id) AS c FROM entity_mapping_versions GROUP BY 1, 2),
a AS (SELECT * FROM m WHERE av <= TIMESTAMPTZ '2025-06-01 00:00:00+00'), h AS (SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM a b WHERE b.sup = a.id AND b.k = a.k AND b.id <> a.id)),
s AS (SELECT DISTINCT subject_id AS mention FROM fact_versions WHERE subject_id IS NOT NULL) SELECT mention, id AS entity_mapping_id, coalesce(c, mention) AS resolved FROM s LEFT JOIN h ON lower(mention) = k""",
    "acronym_proposals": r"""WITH m AS (SELECT DISTINCT unnest([subject_mention, object_mention]) AS mention FROM extracted_claims), a AS (SELECT mention, regexp_extract(mention, '\(([A-Z]{2,6})\)\s*$', 1) AS acronym FROM m WHERE mention IS NOT NULL AND regexp_extract(mention, '\(([A-Z]{2,6})\)\s*$', 1) <> '')
SELECT a.acronym, a.mention AS name_a, b.mention AS name_b FROM a JOIN a b ON a.acronym = b.acronym AND a.mention < b.mention""",
    "acronym_aliases": rf"""WITH m AS ({_ALL}), k AS (SELECT mention, {_MKEY} AS key, regexp_extract(mention, '\(([A-Z]{{2,6}})\)\s*$', 1) AS acronym FROM m)
SELECT a.acronym, a.mention AS name, b.mention AS alias FROM k a JOIN k b ON a.acronym <> '' AND lower(a.acronym) = b.key AND a.key IS DISTINCT FROM b.key""",
    "suffix_proposals": f"WITH m AS ({_ALL}), k AS (SELECT DISTINCT {_MKEY} AS k FROM m), n AS (SELECT k AS long_key, regexp_replace(k, ' [^ ]+$', '') AS base FROM k WHERE k <> '') SELECT long_key, base FROM n SEMI JOIN k ON k.k = n.base AND k.k <> '' WHERE base <> long_key",
}
