"""Checks and reconciliations over whole tables: retrievals, provenance, supports, quality by kind, selection of runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as x
from ..runtime import same
from .timestamps import iso_micros

RETRIEVAL_FIELDS = ("source_version_id", "raw_blob_sha256", "retrieval_id", "source_id", "canonical_or_final_url", "retrieved_at_real")


def blank(c: Column | str) -> Column:
    return F.coalesce(F.trim(F.col(c) if isinstance(c, str) else c) == "", F.lit(True))


def retrieval_problem() -> Column:
    """What keeps a source version from being a strict retrieval: a blank field, a time without zone, a blob hash that is none, or a status that is not OK."""
    first = F.lit(None).cast("string")
    for c in reversed(RETRIEVAL_FIELDS):
        first = F.when(blank(c), "BLANK_" + c.upper()).otherwise(first)
    rest = F.when(iso_micros(F.col("retrieved_at_real")).isNull(), "TIME_WITHOUT_ZONE").when(~F.col("raw_blob_sha256").rlike("^[0-9a-f]{64}$"), "BAD_HASH").when(F.col("source_version_status") != "OK", "STATUS").when(~F.col("strict_source_input_eligible"), "NOT_ELIGIBLE")
    return F.coalesce(first, rest)


def blob_provenance(blobs: DataFrame, versions: DataFrame, blob: str = "raw_blob_sha256") -> DataFrame:
    """(blob, retrievals, strict, status) of every blob that is held or was retrieved.

    RECOVERED with a strict retrieval, WEAK with others only, CONFLICT where strict
    retrievals name several publishers, UNKNOWN without any, ABSENT where only a
    retrieval knows the blob.
    """
    held = blobs.filter(F.col(blob).isNotNull()).select(F.col(blob).alias("blob")).distinct().withColumn("held", F.lit(True))
    ok = retrieval_problem().isNull()
    v = versions.filter(F.col(blob).isNotNull()).groupBy(F.col(blob).alias("blob")).agg(F.countDistinct("retrieval_id").alias("retrievals"), F.countDistinct(F.when(ok, F.col("retrieval_id"))).alias("strict"), F.countDistinct(F.when(ok, F.col("source_id"))).alias("sources"))
    d = held.join(v, "blob", "full_outer")
    status = F.when(F.col("held").isNull(), "ABSENT").when(F.col("retrievals").isNull(), "UNKNOWN").when(F.col("sources") > 1, "CONFLICT").when(F.col("strict") > 0, "RECOVERED").otherwise("WEAK")
    return d.select("blob", F.coalesce("retrievals", F.lit(0)).alias("retrievals"), F.coalesce("strict", F.lit(0)).alias("strict"), status.alias("status"))


def conservation(units: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """(side, n): units without decision (UNDECIDED), decisions on no unit (UNKNOWN), units decided more than once (REPEATED)."""
    u = units.filter(F.col(key).isNotNull()).select(key).distinct()
    d = decisions.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    j = u.withColumn("_u", F.lit(True)).join(d, key, "full_outer")
    n = lambda c: F.count_if(c)
    s = j.agg(n(F.col("_n").isNull()).alias("a"), n(F.col("_u").isNull()).alias("b"), n(F.col("_u").isNotNull() & (F.col("_n") > 1)).alias("c"))
    return s.select(F.stack(F.lit(3), F.lit("UNDECIDED"), "a", F.lit("UNKNOWN"), "b", F.lit("REPEATED"), "c").alias("side", "n"))


def parity_by(left: DataFrame, right: DataFrame, group: str, key: str) -> DataFrame:
    """(group, side, n): different keys of each group that both tables have, only the left or only the right."""
    keys = [group, key]
    a, b = left.select(*keys).distinct().withColumn("_l", F.lit(1)), right.select(*keys).distinct().withColumn("_r", F.lit(1))
    d = a.alias("a").join(b.alias("b"), F.expr(same("a", "b", keys)), "full_outer")
    # Either side has the group; where both lack it, it is null.
    side = F.when(F.col("_l").isNull(), "RIGHT_ONLY").when(F.col("_r").isNull(), "LEFT_ONLY").otherwise("BOTH")
    return d.groupBy(F.coalesce(f"a.{group}", f"b.{group}").alias(group), side.alias("side")).agg(F.count("*").alias("n"))


def blank_identifiers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(field, n): rows whose identifier is null or blank."""
    s = df.agg(*[F.count_if(blank(c)).alias(c) for c in columns])
    return s.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("n")) for c in columns])).alias("s")).select("s.*")


def quality_by_kind(gold: DataFrame, predicted: DataFrame, key: Sequence[str], kinds: dict[str, Sequence[str]]) -> DataFrame:
    """(metric, numerator, denominator, value): precision and recall of facts by their key, and per kind the share of the gold fields that matched facts have right.

    gold and predicted have one row a key.  A kind of several fields counts each of
    them; its denominator is all gold facts, so what is not found is wrong.
    """
    fields = sorted({c for cs in kinds.values() for c in cs})
    own = lambda d, side: d.select(*key, *[F.col(c).alias(f"_{side}_{c}") for c in fields], F.lit(True).alias(f"_{side}"))
    d = own(gold, "g").alias("g").join(own(predicted, "p").alias("p"), F.expr(same("g", "p", list(key))), "full_outer")
    hit = F.coalesce(F.col("_g") & F.col("_p"), F.lit(False))
    sums = [F.count_if(F.col("_g").isNotNull()).alias("gold"), F.count_if(F.col("_p").isNotNull()).alias("predicted"), F.count_if(hit).alias("hit")]
    for k, cs in kinds.items():
        right = F.lit(0)
        for c in cs:
            right = right + F.when(hit & F.col(f"_g_{c}").eqNullSafe(F.col(f"_p_{c}")), 1).otherwise(0)
        sums.append(F.coalesce(F.sum(right), F.lit(0)).alias(f"k_{k}"))
    s = d.agg(*sums)
    rows = [("relation_precision", F.col("hit"), F.col("predicted")), ("relation_recall", F.col("hit"), F.col("gold")), *[(f"{k}_accuracy", F.col(f"k_{k}"), F.col("gold") * len(cs)) for k, cs in kinds.items()]]
    e = s.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), a.cast("long").alias("numerator"), b.cast("long").alias("denominator")) for n, a, b in rows])).alias("r")).select("r.*")
    return e.withColumn("value", F.when(F.col("denominator") > 0, F.col("numerator") / F.col("denominator")))


def tied_best(scores: DataFrame, config: str, group: str, score: str, tolerance: float = 0.005) -> DataFrame:
    """(config, score, best): configurations whose mean over group means is within the tolerance of the highest; best is the least of those that have the highest.

    A row per configuration is left after the two means.
    """
    s = scores.groupBy(config, group).agg(F.avg(score).alias("m")).groupBy(config).agg(F.avg("m").alias("score"))
    top = s.agg(F.max("score").alias("top"), F.min_by(config, F.struct(-F.col("score"), F.col(config))).alias("first"))
    d = s.join(F.broadcast(top)).filter(F.col("score") >= F.col("top") - tolerance)
    return d.select(config, "score", (F.col(config) == F.col("first")).alias("best"))


def stability_plateau(noise: DataFrame, group: str, epoch: str, value: str, tolerance: float) -> DataFrame:
    """(group, epoch, stable): whether the noise of an epoch is above that of the next one by at most the tolerance; the last epoch has no answer.

    A group has a row per probed epoch.
    """
    d = noise.groupBy(group, epoch).agg(F.avg(value).alias("v"))
    nxt = F.lead("v").over(Window.partitionBy(group).orderBy(epoch))
    return d.select(group, epoch, (F.col("v") - nxt <= tolerance).alias("stable"))


def occurrence_id() -> Column:
    """The id of a mention's place in a body: body variant and span."""
    return x.stable_id("mention", "body_variant_id", "evidence_span_start", "evidence_span_end")
