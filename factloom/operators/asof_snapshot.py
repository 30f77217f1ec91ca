"""As-of snapshots of bitemporal facts at many cutoffs in one job.

A fact version is in the snapshot of a cutoff if it was observed and accepted by
then, is valid then, is not superseded by another version that is, is no
retraction and not retracted.  Whatever is out keeps the first reason that
applies.  Only then are its ends resolved, by the decisions on their mentions that
are known at the cutoff.  All cutoffs are handled together: every fact meets the
few cutoffs, which are a literal array, without a join.

Facts are (version, logical, subject, relation, object, observed, accepted,
valid_from, valid_to, supersedes, retraction) with clocks in microseconds.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import staged
from .asof import decision_periods, join_as_known

REASONS = ["FUTURE_EVIDENCE_OBSERVED_AT", "FUTURE_KG_ACCEPTANCE", "FUTURE_WORLD_VALIDITY", "EXPIRED_WORLD_VALIDITY", "SUPERSEDED_BY_REVISION", "RETRACTION_TOMBSTONE", "RETRACTED"]


def micros(at: datetime) -> int:
    return (at - datetime(1970, 1, 1)) // timedelta(microseconds=1)


def at_cutoffs(facts: DataFrame, cutoffs: Sequence[tuple[str, datetime]]) -> DataFrame:
    """Each fact once per cutoff, by exploding a literal array: no join at all."""
    points = F.array(*[F.struct(F.lit(n).alias("snapshot"), F.lit(micros(c)).alias("cutoff")) for n, c in cutoffs])
    return facts.withColumn("_c", F.explode(points)).select("*", "_c.snapshot", "_c.cutoff").drop("_c")


def clock_reason(cutoff: str = "cutoff") -> Column:
    """The first clock that keeps a fact out; null where none does.

    A fact without observation is never known; of the other clocks a null one keeps nothing out.
    """
    c = F.col(cutoff)
    return (
        F.when(F.col("observed").isNull() | (F.col("observed") > c), REASONS[0])
        .when(F.col("accepted") > c, REASONS[1])
        .when(F.col("valid_from") > c, REASONS[2])
        .when(F.col("valid_to") <= c, REASONS[3])
    )


def snapshot_status(facts: DataFrame, cutoffs: Sequence[tuple[str, datetime]], strict: bool = False) -> DataFrame:
    """facts x cutoffs with ``reason``: null for the versions that make the snapshot.

    ``strict``: a known fact without acceptance is an error when it is read.  Versions
    are unique; of several valid revisions of one version the greatest wins.
    """
    if strict:
        missing = F.raise_error(F.concat(F.lit("no acceptance of version "), F.col("version").cast("string"))).cast("long")
        facts = facts.withColumn("accepted", F.when(F.col("observed").isNotNull() & F.col("accepted").isNull(), missing).otherwise(F.col("accepted")))
    d = staged(at_cutoffs(facts, cutoffs).withColumn("clock", clock_reason()), "clocks")
    # What a version's revisions do to it, and to each other, is one row per revised version.
    revised = d.filter("supersedes is not null and clock is null").groupBy("snapshot", "logical", F.col("supersedes").alias("version")).agg(F.max("version").alias("winner"))
    tomb = d.filter("retraction and supersedes is not null and (clock is null or clock = 'EXPIRED_WORLD_VALIDITY')").select("snapshot", F.col("supersedes").alias("version"), F.lit(True).alias("retracted")).distinct()
    held = d.filter("clock is null").select("snapshot", "logical", "version")
    lost = revised.join(held, ["snapshot", "logical", "version"], "left_semi").withColumnRenamed("version", "supersedes")
    d = d.join(revised.select("snapshot", "logical", "version", F.lit(True).alias("superseded")), ["snapshot", "logical", "version"], "left")
    d = d.join(lost, ["snapshot", "logical", "supersedes"], "left").join(tomb, ["snapshot", "version"], "left")
    out = F.coalesce(F.col("superseded"), F.col("winner") != F.col("version"), F.lit(False))
    reason = F.coalesce("clock", F.when(out, REASONS[4]).when(F.col("retraction"), REASONS[5]).when(F.col("retracted"), REASONS[6]))
    return d.withColumn("reason", reason).drop("clock", "superseded", "winner", "retracted")


def resolve_ends(status: DataFrame, mappings: DataFrame) -> DataFrame:
    """status of the versions in a snapshot with subject and object replaced by the entity that their mention is mapped to at the cutoff.

    A mention without a known decision stays; of several decisions that nothing
    supersedes the latest counts (then the least id).  Letter case does not matter.
    """
    active = staged(status.filter("reason is null"), "active")
    asked = active.select("snapshot", "cutoff", F.explode(F.array("subject", "object")).alias("mention")).filter("mention is not null").withColumn("mention", F.lower("mention")).distinct()
    periods = decision_periods(mappings, "entity_mapping_id", "mention", "mapping_available_at", "supersedes_mapping_id")
    known = join_as_known(asked, "mention", "cutoff", periods.withColumn("id", F.struct("since", "id")))
    best = known.groupBy("snapshot", "mention").agg(F.min_by(F.col("id.id"), F.struct(-F.col("id.since"), F.col("id.id"))).alias("id"))
    entity = mappings.filter("entity_mapping_id is not null").groupBy(F.col("entity_mapping_id").alias("id")).agg(F.min("canonical_entity_id").alias("entity"))
    to = staged(best.join(entity, "id").select("snapshot", "mention", "entity").filter("entity is not null"), "resolved")
    for end in ("subject", "object"):
        own = to.select("snapshot", F.col("mention").alias("_m"), F.col("entity").alias("_e"))
        active = active.withColumn("_m", F.lower(end)).join(own, ["snapshot", "_m"], "left").withColumn(end, F.coalesce("_e", end)).drop("_m", "_e")
    return active


def snapshot_edges(active: DataFrame) -> DataFrame:
    """(snapshot, edge_id, subject, relation, object, support): different triples with their number of versions."""
    e = active.groupBy("snapshot", "subject", "relation", "object").agg(F.count("*").alias("support"))
    return e.select("snapshot", edge_id(), "subject", "relation", "object", "support")


def edge_id() -> Column:
    return F.concat(F.lit("edge_"), "snapshot", F.lit("_"), F.substring(F.sha2(F.concat_ws("|", "subject", "relation", "object"), 256), 1, 16)).alias("edge_id")


def graph_hash(edges: DataFrame, digits: int = 2) -> DataFrame:
    """(snapshot, edges, graph_sha256) over tab-separated lines in order of the triples.

    Lines are hashed per bucket of the subject's hash and those hashes again, so no
    snapshot is gathered into one task; ``digits`` of that hash make the buckets, 16
    to their power.  It is not the hash of all lines in one text.
    """
    line = F.concat_ws("\t", "subject", "relation", "object")
    per = edges.groupBy("snapshot", F.substring(F.sha2("subject", 256), 1, digits).alias("bucket")).agg(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(line))), 256).alias("h"), F.count("*").alias("n"))
    return per.groupBy("snapshot").agg(F.sum("n").alias("edges"), F.sha2(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("bucket", "h"))), lambda x: x["h"])), 256).alias("graph_sha256"))


def edge_support(active: DataFrame, provenance: DataFrame) -> DataFrame:
    """(support_id, edge_id, fact_version_id, claim_id, provenance_id, source_version_id, raw_blob_sha256, problem) of each active fact.

    One row per provenance row of each claim that supports the fact; redelivered
    provenance is one row (the least).  problem names what keeps a row from being
    exact support: MISSING_PROVENANCE for a claim without any, INCOMPLETE for one
    without all of its ids, BAD_HASH for a blob hash that is none.
    """
    fields = ["claim_id", "membership_id", "source_version_id", "retrieval_id", "raw_blob_sha256"]
    p = provenance.filter("provenance_id is not null").groupBy("provenance_id").agg(F.min(F.struct(*fields)).alias("p")).select("provenance_id", "p.*")
    f = active.select(edge_id(), F.col("version").alias("fact_version_id"), F.explode_outer(F.array_distinct("claims")).alias("claim_id"))
    d = f.join(p, "claim_id", "left")
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    incomplete = blank(fields[0])
    for c in fields[1:]:
        incomplete = incomplete | blank(c)
    problem = F.when(F.col("provenance_id").isNull(), "MISSING_PROVENANCE").when(incomplete, "INCOMPLETE").when(~F.col("raw_blob_sha256").rlike("^[0-9a-f]{64}$"), "BAD_HASH")
    ident = F.concat(F.lit("supp_"), "edge_id", F.lit("_"), "fact_version_id", F.lit("_"), F.substring(F.sha2("provenance_id", 256), 1, 16))
    return d.select(ident.alias("support_id"), "edge_id", "fact_version_id", "claim_id", "provenance_id", "source_version_id", "raw_blob_sha256", problem.alias("problem"))


def revision_violations(facts: DataFrame) -> DataFrame:
    """(version, problem): revisions whose parent is missing, of another fact, accepted later, or shared."""
    p = facts.select(F.col("version").alias("supersedes"), F.col("logical").alias("p_logical"), F.col("accepted").alias("p_accepted"), F.lit(True).alias("p"))
    shared = facts.filter("supersedes is not null").groupBy("supersedes").agg((F.count("*") > 1).alias("shared"))
    d = facts.filter("supersedes is not null").join(p, "supersedes", "left").join(shared, "supersedes")
    problem = F.when(F.col("p").isNull(), "MISSING_PARENT").when(F.col("p_logical") != F.col("logical"), "OTHER_FACT").when(F.col("p_accepted") > F.col("accepted"), "ACCEPTED_BEFORE_PARENT").when(F.col("shared"), "COMPETING_REVISION")
    return d.withColumn("problem", problem).filter("problem is not null").select("version", "problem")


def append_only_violations(previous: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """(key, problem): rows of the previous store that the current one lacks or holds differently."""
    columns = previous.columns
    gone = previous.select(*columns).exceptAll(current.select(*columns))
    held = current.select(F.col(key), F.lit(True).alias("_held")).distinct()
    return gone.join(held, key, "left").select(key, F.when(F.col("_held"), "CHANGED").otherwise("REMOVED").alias("problem"))


def balanced_cuts(events: DataFrame, at: str, n: int) -> DataFrame:
    """(k, rows_before): where n event-balanced snapshots start, never inside of equal times.

    Counts per instant are summed, not rows: the ideal index round-half-even(k*N/n)
    moves to the end of its group of equal times.  A boundary that leaves a
    snapshot empty fails.
    """
    groups = events.groupBy(at).agg(F.count("*").alias("c"))
    # Instants are counted in day blocks first, so that the ordered sum is over few rows.
    groups = groups.withColumn("day", F.to_date(at))
    days = groups.groupBy("day").agg(F.sum("c").alias("dc")).withColumn("before", F.coalesce(F.sum("dc").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    g = groups.join(days.select("day", "before"), "day").withColumn("end", F.col("before") + F.sum("c").over(Window.partitionBy("day").orderBy(at)))
    total = events.agg(F.count("*").alias("total"))
    ks = total.select("total", F.explode(F.sequence(F.lit(0), F.lit(n))).alias("k"))
    ideal = ks.withColumn("ideal", F.bround(F.col("k") * F.col("total") / n, 0).cast("long"))
    inner = F.broadcast(ideal.filter((F.col("k") > 0) & (F.col("k") < n)))
    cut = g.join(inner, (F.col("end") >= F.col("ideal")) & (F.col("end") - F.col("c") < F.col("ideal"))).select("k", F.col("end").alias("rows_before"))
    ends = ideal.filter((F.col("k") == 0) | (F.col("k") == n)).select("k", F.when(F.col("k") == 0, F.lit(0)).otherwise(F.col("total")).alias("rows_before"))
    return ends.unionByName(cut)


def nearest_boundaries(events: DataFrame, at: str, target: int) -> DataFrame:
    """(position, cutoff): the instant whose cumulative count is nearest to position/target of all, the earlier on ties."""
    groups = events.groupBy(at).agg(F.count("*").alias("c")).withColumn("day", F.to_date(at))
    days = groups.groupBy("day").agg(F.sum("c").alias("dc")).withColumn("before", F.coalesce(F.sum("dc").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("dc").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    g = groups.join(days.select("day", "before", "total"), "day").withColumn("cum", F.col("before") + F.sum("c").over(Window.partitionBy("day").orderBy(at)))
    p = g.withColumn("position", F.explode(F.sequence(F.lit(1), F.lit(target))))
    return p.groupBy("position").agg(F.min_by(at, F.struct(F.abs(F.col("cum") * target - F.col("total") * F.col("position")), F.col(at))).alias("cutoff"))


def document_time(archive: str, published: str, retrieved: str, chrome: Column) -> Column:
    """struct(observed_at, basis, confidence, flag, exclusion_reason): an archive capture decides, then publication."""
    a, p, r = F.col(archive), F.col(published), F.col(retrieved)
    none = F.lit(None).cast("string")

    def row(at, basis, confidence, flag, reason):
        return F.struct(at.alias("observed_at"), basis.alias("basis"), confidence.alias("confidence"), flag.alias("flag"), reason.alias("exclusion_reason"))

    nothing = F.lit(None).cast("timestamp_ntz")
    return (
        F.when(a.isNotNull(), row(a, F.lit("wayback_archive_datetime"), F.lit("high"), F.when(p > a, "PUBLISHED_AFTER_ARCHIVE_IGNORED"), none))
        .when(chrome, row(nothing, none, none, F.lit("CHROME_TEXT_ONLY"), F.lit("CHROME_TEASER_EVIDENCE_TIME_UNKNOWN")))
        .when(p.isNull(), row(nothing, none, none, none, F.lit("NO_EVIDENCE_TIME_SOURCE")))
        .when(p > r, row(nothing, none, none, F.lit("PUBLISHED_AFTER_RETRIEVAL"), F.lit("PUBLISHED_AFTER_RETRIEVAL")))
        .otherwise(row(p, F.lit("publisher_declared_published_at"), F.lit("medium"), none, none))
    )


def first_events(active: DataFrame) -> DataFrame:
    """(subject, relation, object, version, observed): the earliest version that ever made a snapshot, per triple."""
    return active.groupBy("subject", "relation", "object").agg(F.min(F.struct("observed", "version")).alias("m")).select("subject", "relation", "object", "m.version", "m.observed")
