"""From claims to their sources: grounding, provenance chains, adjudication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as x
from .snapshots import snapshot_sequence


def exact_clusters(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(body_sha256, members, first_member) of equal texts; null texts belong to none.

    cluster_members has the class of every document: no list is made of a class.
    """
    h = docs.filter(F.col(text).isNotNull()).select(F.sha2(text, 256).alias("body_sha256"), F.col(key).alias("m"))
    return h.groupBy("body_sha256").agg(F.count("*").alias("members"), F.min("m").alias("first_member"))


def cluster_members(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, body_sha256): the class of each document with a text, one row a document, without list and cap.

    Nothing is shuffled, so a body that many documents share is no hot key.
    """
    return docs.filter(F.col(text).isNotNull()).select(key, F.sha2(text, 256).alias("body_sha256"))


def ground_claims(claims: DataFrame, bodies: DataFrame, body_key: str, text: str, relations: list[str] | None = None) -> DataFrame:
    """claims with ``problem``: null for claims whose span, hash and mentions the text bears out.

    The first that applies of MISSING_MENTION, RELATION_NOT_IN_ONTOLOGY,
    MISSING_BODY, SPAN_OUT_OF_RANGE, HASH_MISMATCH, SUBJECT_NOT_IN_SPAN and
    OBJECT_NOT_IN_SPAN.  A body that occurs several times counts with its least text.
    """
    b = bodies.filter(F.col(text).isNotNull()).groupBy(F.col(body_key).alias("_b")).agg(F.min(text).alias("_t"))
    d = claims.join(b, F.col("body_variant_id") == F.col("_b"), "left").withColumn("_s", x.span("_t", "evidence_span_start", "evidence_span_end"))
    inside = lambda m: F.contains(F.lower("_s"), F.lower(F.trim(m)))
    blank = lambda m: F.coalesce(F.trim(m) == "", F.lit(True))
    p = F.when(blank("subject_mention") | blank("object_mention"), "MISSING_MENTION")
    if relations is not None:
        p = p.when(~F.coalesce(F.col("relation_name").isin(*relations), F.lit(False)), "RELATION_NOT_IN_ONTOLOGY")
    p = (
        p.when(F.col("_b").isNull(), "MISSING_BODY")
        .when(F.col("_s").isNull(), "SPAN_OUT_OF_RANGE")
        .when(~F.sha2("_s", 256).eqNullSafe(F.col("evidence_text_hash")), "HASH_MISMATCH")
        .when(~inside("subject_mention"), "SUBJECT_NOT_IN_SPAN")
        .when(~inside("object_mention"), "OBJECT_NOT_IN_SPAN")
    )
    return d.withColumn("problem", p).drop("_b", "_t", "_s")


def provenance_chain(claims: DataFrame, provenance: DataFrame, versions: DataFrame) -> DataFrame:
    """(claim_id, provenance_id, source_version_id, status): each claim's way to a source version.

    COMPLETE, or the first link that fails: NO_PROVENANCE, NO_SOURCE_VERSION,
    BLOB_MISMATCH, RETRIEVAL_MISMATCH.  Redelivered rows are one.
    """
    c = claims.select("claim_id").filter("claim_id is not null").distinct()
    p = provenance.select("claim_id", "provenance_id", "source_version_id", "raw_blob_sha256", "retrieval_id").distinct()
    v = versions.filter("source_version_id is not null").groupBy("source_version_id").agg(F.min("raw_blob_sha256").alias("v_blob"), F.min("retrieval_id").alias("v_ret"), F.lit(True).alias("v"))
    d = c.join(p, "claim_id", "left").join(v, "source_version_id", "left")
    status = F.when(F.col("provenance_id").isNull(), "NO_PROVENANCE").when(F.col("v").isNull(), "NO_SOURCE_VERSION").when(~F.col("v_blob").eqNullSafe(F.col("raw_blob_sha256")), "BLOB_MISMATCH").when(~F.col("v_ret").eqNullSafe(F.col("retrieval_id")), "RETRIEVAL_MISMATCH").otherwise("COMPLETE")
    return d.select("claim_id", "provenance_id", "source_version_id", status.alias("status"))


def source_claims(claims: DataFrame, provenance: DataFrame) -> DataFrame:
    """(source_claim_id, claim_id, provenance_id): one row per claim and source path of known claims."""
    c = claims.select("claim_id").filter("claim_id is not null").distinct()
    p = provenance.filter("provenance_id is not null").select("claim_id", "provenance_id").distinct()
    return p.join(c, "claim_id").select(F.concat(F.lit("sc_"), F.substring(F.sha2(F.concat_ws("|", "claim_id", "provenance_id"), 256), 1, 32)).alias("source_claim_id"), "claim_id", "provenance_id")


def match_histogram(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(matches, n): how many rows of left have how many equal rows in right; null keys equal nothing."""
    r = right.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("_m"))
    return left.join(r, keys, "left").groupBy(F.coalesce("_m", F.lit(0)).alias("matches")).agg(F.count("*").alias("n"))


def resolve_mentions(claims: DataFrame, catalog: DataFrame) -> DataFrame:
    """claims with subject_id and object_id by letter-case-free equality with the catalog (mention, entity); ambiguous mentions stay null."""
    c = catalog.filter("mention is not null").groupBy(F.lower(F.trim("mention")).alias("_m")).agg(F.min("entity").alias("lo"), F.max("entity").alias("hi")).filter("lo = hi").select("_m", F.col("lo").alias("_e"))
    d = claims.join(c.select(F.col("_m").alias("_sm"), F.col("_e").alias("subject_id")), F.lower(F.trim("subject_mention")) == F.col("_sm"), "left")
    return d.join(c.select(F.col("_m").alias("_om"), F.col("_e").alias("object_id")), F.lower(F.trim("object_mention")) == F.col("_om"), "left").drop("_sm", "_om")


def adjudicate(claims: DataFrame, arrival: str) -> DataFrame:
    """(claim_id, decision, logical_fact_id): what becomes of each resolved claim.

    QUEUED_... with the first reason (negated, speculative, unresolved subject or
    object, self-loop), ACCEPTED for the first claim of its fact by (arrival, id),
    MERGED for the others, whose ids support that fact.
    """
    reason = (
        F.when(F.col("is_negative"), "QUEUED_NEGATED")
        .when(F.col("is_speculative"), "QUEUED_SPECULATIVE")
        .when(F.col("subject_id").isNull(), "QUEUED_UNRESOLVED_SUBJECT")
        .when(F.col("object_id").isNull(), "QUEUED_UNRESOLVED_OBJECT")
        .when(F.col("subject_id") == F.col("object_id"), "QUEUED_SELF_LOOP")
    )
    d = claims.withColumn("reason", reason).withColumn("logical_fact_id", F.when(F.col("reason").isNull(), x.logical_fact_id("subject_id", "relation_name", "object_id")))
    ok = d.filter("reason is null")
    first = ok.groupBy("logical_fact_id").agg(F.min(F.struct(arrival, "claim_id")).alias("f")).select("logical_fact_id", F.col("f.claim_id").alias("first_claim"))
    taken = ok.join(first, "logical_fact_id").select("claim_id", F.when(F.col("claim_id") == F.col("first_claim"), "ACCEPTED").otherwise("MERGED").alias("decision"), "logical_fact_id")
    return taken.unionByName(d.filter("reason is not null").select("claim_id", F.col("reason").alias("decision"), "logical_fact_id"))


def fact_support(decisions: DataFrame) -> DataFrame:
    """(logical_fact_id, supporting_claims, first_claim): number and least id of the accepted and merged claims of each fact.

    supporting_claims has every one of them.
    """
    d = decisions.filter("logical_fact_id is not null").select("logical_fact_id", "claim_id").distinct()
    return d.groupBy("logical_fact_id").agg(F.count("*").alias("supporting_claims"), F.min("claim_id").alias("first_claim"))


def supporting_claims(decisions: DataFrame) -> DataFrame:
    """(logical_fact_id, claim_id): every accepted or merged claim of each fact, one row a claim."""
    return decisions.filter("logical_fact_id is not null").select("logical_fact_id", "claim_id").distinct()


def compare_outer(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(side, n): different key combinations in both tables, only left, only right."""
    l, r = left.select(*keys).distinct().withColumn("_l", F.lit(1)), right.select(*keys).distinct().withColumn("_r", F.lit(1))
    on = [F.expr(f"l.`{k}` <=> r.`{k}`") for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    d = l.alias("l").join(r.alias("r"), cond, "full_outer")
    return d.groupBy(F.when(F.col("_l").isNull(), "RIGHT_ONLY").when(F.col("_r").isNull(), "LEFT_ONLY").otherwise("BOTH").alias("side")).agg(F.count("*").alias("n"))


def quality(gold: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """(tp, fp, fn, precision, recall, f1) of different keys."""
    c = compare_outer(gold, predicted, keys)
    n = lambda s: F.coalesce(F.sum(F.when(F.col("side") == s, F.col("n"))), F.lit(0))
    s = c.agg(n("BOTH").alias("tp"), n("RIGHT_ONLY").alias("fp"), n("LEFT_ONLY").alias("fn"))
    ratio = lambda a, b: F.when(b > 0, a / b)
    s = s.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return s.withColumn("f1", ratio(2 * F.col("tp").cast("double"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def multiset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """(side, n): rows of one table that the other has less often."""
    a, b = left.exceptAll(right), right.exceptAll(left)
    return a.agg(F.lit("LEFT").alias("side"), F.count("*").alias("n")).unionByName(b.agg(F.lit("RIGHT").alias("side"), F.count("*").alias("n")))


def consecutive_differences(df: DataFrame, snapshot: str, fields: list[str]) -> DataFrame:
    """(snapshot_id, side, n): multiset_difference of every snapshot, as RIGHT, with the one before it, as LEFT.

    snapshot_id is the later one.  Nulls equal each other, rows without snapshot
    belong to none; each pair has both sides, where nothing differs with 0.
    """
    pairs = snapshot_sequence(df, snapshot)
    cells = df.groupBy(F.col(snapshot).alias("snapshot"), *fields).agg(F.count("*").alias("c"))
    # A row counts for the comparison that ends in its snapshot and against the one that starts there.
    ends = cells.join(pairs.filter("following is not null").select(F.col("following").alias("snapshot")), "snapshot").select(F.col("snapshot").alias("snapshot_id"), *fields, "c")
    starts = cells.join(pairs, "snapshot").filter("following is not null").select(F.col("following").alias("snapshot_id"), *fields, (-F.col("c")).alias("c"))
    gap = ends.unionByName(starts).groupBy("snapshot_id", *fields).agg(F.sum("c").alias("c"))
    sums = gap.groupBy("snapshot_id").agg(F.sum(F.greatest(-F.col("c"), F.lit(0))).alias("l"), F.sum(F.greatest("c", F.lit(0))).alias("r"))
    return sums.select("snapshot_id", F.stack(F.lit(2), F.lit("LEFT"), "l", F.lit("RIGHT"), "r").alias("side", "n"))
