"""References to records that do not exist (problem 3).

The distinct non-null keys that a child table names are anti-joined to the keys
that its parent table holds in time; only the few that fail are joined back to
the children, for the records and for counts per table and period of arrival.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Reference:
    child: str
    record: str
    field: str
    parent: str
    key: str


REFERENCES = [
    Reference("snapshot_edge_support", "support_id", "fact_version_id", "fact_versions", "fact_version_id"),
    Reference("snapshot_edge_support", "support_id", "edge_id", "snapshot_edges", "edge_id"),
    Reference("source_claims", "source_claim_id", "claim_id", "extracted_claims", "claim_id"),
    Reference("claim_provenance", "provenance_id", "source_version_id", "source_versions", "source_version_id"),
]


def _instant(df: DataFrame, c: str):
    """Arrival as a timestamp; ISO strings of fact versions have a zone."""
    if dict(df.dtypes)[c] == "string":
        return F.try_to_timestamp(F.col(c)).cast("timestamp")
    return F.col(c).cast("timestamp")


def first_arrivals(child: DataFrame, record: str, field: str, arrival: str = "ingested_at_real") -> DataFrame:
    """(record_id, ref, at): a record by its first arrival; of equal arrivals the least key counts.

    Records without id cannot be reported and are left out.  A null arrival comes last.
    """
    at = _instant(child, arrival)
    order = F.struct(at.isNull(), at, F.col(field).isNull(), F.col(field))
    return (
        child.filter(F.col(record).isNotNull())
        .groupBy(F.col(record).alias("record_id"))
        .agg(F.min(order).alias("_m"), F.min(at).alias("at"))
        .select("record_id", F.col(f"_m.{field}").alias("ref"), "at")
    )


def find_orphans(child: DataFrame, record: str, field: str, parent: DataFrame, key: str, deleted: DataFrame | None = None, arrival: str = "ingested_at_real") -> DataFrame:
    """(record_id, ref, at, reason) of the records whose reference is an orphan.

    Null and blank references name nothing and are no orphans.  reason: ``missing``
    (no such key), ``deleted`` (its key is in ``deleted(record_id)``) or ``late``
    (the parent first arrives after the record).  Keys compare exactly as stored.
    Unknown arrival of either side is never late.
    """
    refs = first_arrivals(child, record, field, arrival).filter(F.coalesce(F.trim(F.regexp_replace("ref", r"\s+", "")) != "", F.lit(False)))
    keys = refs.groupBy("ref").agg(F.min("at").alias("first_at"))
    held = parent.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min(_instant(parent, arrival)).alias("parent_at"))
    gone = (deleted if deleted is not None else keys.select(F.col("ref").alias("record_id")).limit(0)).select(F.col("record_id").alias("key")).filter("key is not null").distinct()
    live = held.join(gone, "key", "left_anti")
    in_time = (keys.ref == live.key) & (F.coalesce(live.parent_at <= keys.first_at, F.lit(True)))
    failing = keys.join(live, in_time, "left_anti").select("ref")
    # The failing keys are few; what is known of their parents decides the reason.
    named = "_gone is not null" if deleted is not None else "false"
    reason = F.when(F.expr(named), "deleted").when(F.col("_known").isNull(), "missing").when(F.col("parent_at") > F.col("at"), "late")
    why = failing.join(held.select(F.col("key").alias("ref"), "parent_at", F.lit(True).alias("_known")), "ref", "left").join(gone.select(F.col("key").alias("ref"), F.lit(True).alias("_gone")), "ref", "left")
    return refs.join(why, "ref").withColumn("reason", reason).filter("reason is not null").select("record_id", "ref", "at", "reason")


def orphans_of(tables: dict[str, DataFrame], references: list[Reference] = REFERENCES, deletions: DataFrame | None = None) -> DataFrame:
    """(child_table, ref_field, record_id, ref, at, reason) over all references."""
    parts = []
    for r in references:
        gone = None if deletions is None else deletions.filter(F.col("table_name") == r.parent).select("record_id")
        found = find_orphans(tables[r.child], r.record, r.field, tables[r.parent], r.key, gone)
        parts.append(found.select(F.lit(r.child).alias("child_table"), F.lit(r.field).alias("ref_field"), "record_id", "ref", "at", "reason"))
    return reduce(DataFrame.unionByName, parts)


def count_orphans(tables: dict[str, DataFrame], references: list[Reference] = REFERENCES, deletions: DataFrame | None = None) -> DataFrame:
    """(child_table, ref_field, period, records, orphans): per month of first arrival, null where unknown."""
    month = lambda c: F.date_format(c, "yyyy-MM").alias("period")
    totals = [
        first_arrivals(tables[r.child], r.record, r.field).groupBy(F.lit(r.child).alias("child_table"), F.lit(r.field).alias("ref_field"), month("at")).agg(F.count("*").alias("records"))
        for r in references
    ]
    total = reduce(DataFrame.unionByName, totals)
    bad = orphans_of(tables, references, deletions).groupBy("child_table", "ref_field", month("at")).agg(F.count("*").alias("orphans"))
    on = [total[c].eqNullSafe(bad[c]) for c in ("child_table", "ref_field", "period")]
    return total.join(bad, reduce(lambda a, b: a & b, on), "left").select(total.child_table, total.ref_field, total.period, "records", F.coalesce("orphans", F.lit(0)).alias("orphans"))
