"""Scalar functions as column expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# Text and identity -----------------------------------------------------------------------------


def stable_id(prefix: str, *parts: Column | str) -> Column:
    """prefix_ and 32 hex digits over the parts; nulls differ from every text."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.to_json(F.array(*[_c(p).cast("string") for p in parts])), 256), 1, 32))


def logical_fact_id(*parts: Column | str) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *map(_c, parts)), 256), 1, 16)


def canonical_json(*columns: str) -> Column:
    """The columns as one JSON object with sorted names, nulls kept and no spaces: equal rows have equal texts."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def json_hash(*columns: str) -> Column:
    return F.sha2(canonical_json(*columns), 256)


def vector_hash(vector: Column | str, digits: int = 7) -> Column:
    """The hash of a vector rounded to some digits, minus zero being zero: equal fits have equal hashes."""
    return F.sha2(F.array_join(F.transform(_c(vector), lambda v: F.format_number(F.round(v, digits) + F.lit(0.0), digits)), ","), 256)


def joined_hash(*parts: Column | str) -> Column:
    return F.sha2(F.concat_ws("|", *map(_c, parts)), 256)


def salted_number(hex_digits: int, *parts: Column | str) -> Column:
    """The first hex digits of the parts' hash as a number."""
    return F.conv(F.substring(joined_hash(*parts), 1, hex_digits), 16, 10).cast("bigint")


def first_text(*fields: Column | str) -> Column:
    """The first field that is not blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(_c(f)), F.lit("")) for f in fields])


def span(text: Column | str, start: Column | str, end: Column | str) -> Column:
    """Code points [start, end) of the text; null where the span is not inside of it."""
    t, a, z = _c(text), _c(start), _c(end)
    return F.when((a >= 0) & (z > a) & (z <= F.length(t)), F.substring(t, a.cast("int") + 1, (z - a).cast("int")))


def byte_variants(text: Column | str) -> Column:
    """Hashes of the text's line-end and mark variants: as is, LF, CRLF, with BOM, without final line end."""
    lf = F.replace(_c(text), F.lit("\r\n"), F.lit("\n"))
    return F.array(*[F.sha2(x, 256) for x in (_c(text), lf, F.replace(lf, F.lit("\n"), F.lit("\r\n")), F.concat(F.lit("﻿"), _c(text)), F.regexp_replace(_c(text), r"[\r\n]+$", ""))])


def content_type(text: Column | str) -> Column:
    """What a body looks like by its beginning: a page where its marks stand within the first 1,024 or 4,096 characters after white space."""
    head = F.lower(F.regexp_replace(F.substring(_c(text), 1, 16384), r"^[ \t\n\r\f\x0B]+", ""))
    return (
        F.when(head.isNull() | (head == ""), "empty")
        .when(F.contains(F.substring(head, 1, 1024), F.lit("<!doctype html")) | F.contains(F.substring(head, 1, 4096), F.lit("<html")), "text/html")
        .when(head.startswith("<?xml"), "application/xml")
        .when(head.startswith("{") | head.startswith("["), "application/json")
        .otherwise("text/plain")
    )


def aware_instant(value: Column | str) -> Column:
    """A timestamp of an ISO text with Z or offset; null for text without zone."""
    v = _c(value)
    return F.try_to_timestamp(F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}([.]\d+)?)?(Z|[+-]\d{2}:?\d{2})$"), v))


def url_instant(url: Column | str, offset_hours: int = 7) -> Column:
    """The instant in an article number of 17 digits (yyyyMMddHHmmssSSS in a fixed zone) before .htm; null where it is none."""
    d = F.regexp_extract(_c(url), r"-(20\d{15})\.htm", 1)
    local = F.try_to_timestamp(F.nullif(F.substring(d, 1, 14), F.lit("")), F.lit("yyyyMMddHHmmss"))
    return local - F.expr(f"INTERVAL {offset_hours} HOURS")


# Words before a name, words after it, and mentions that name nobody.
CLASS_WORDS = ("tập đoàn", "công ty", "hãng", "ông", "bà")
NOT_BEFORE = {"bà": "rịa"}
LEGAL_WORDS = ("corporation", "corp", "inc", "ltd", "llc", "plc", "group", "co")
NOBODY = (
    "ông", "bà", "anh", "chị", "cô", "em", "họ", "hắn", "nó", "người này", "người đó", "công ty", "hãng", "tập đoàn", "doanh nghiệp", "startup", "công ty này", "hãng này",
    "chatbot", "mô hình", "ai", "học viện", "trường", "ứng dụng", "sản phẩm", "hệ thống", "nền tảng", "dịch vụ", "công cụ", "tính năng", "người dùng",
)
ENTITY_VERSION = "entity_map_v2"


def mention_key(name: Column | str) -> Column:
    """The key of a mention in composed form (NFC), in lower case.

    Parentheses without a digit at its end go, unless nothing is left; so do quotes,
    dashes and marks at the ends, a class word before a capital or a digit, and a
    legal word after another word.
    """
    n = F.regexp_replace(F.trim(_c(name)), r"^(.*?\S)(?:\s*\([^()\p{Nd}]*\))+\s*$", "$1")
    n = F.regexp_replace(F.regexp_replace(n, r"[‐-―_\-]+", " "), r"[\"'“”‘’]+", "")
    n = F.regexp_replace(F.regexp_replace(n, r"\s+", " "), r"^[ .,;:]+|[ .,;:]+$", "")
    words = "|".join(f"{w}(?! {NOT_BEFORE[w]}(?: |$))" if w in NOT_BEFORE else w for w in CLASS_WORDS)
    n = F.regexp_replace(n, rf"^(?iu:{words}) (?=[\p{{Lu}}\p{{Nd}}])", "")
    return F.regexp_replace(F.lower(n), rf" (?:{'|'.join(LEGAL_WORDS)})\.*$", "")


def is_generic(name: Column | str) -> Column:
    """Mentions that name nobody: listed words, or several words of small letters alone.  The name is in composed form."""
    n = F.regexp_replace(F.trim(_c(name)), r"\s+", " ")
    return (n == "") | F.lower(n).isin(*NOBODY) | n.rlike(r"^\p{Ll}[\p{Ll}\p{Lo}\p{Lm}]*(?: [\p{Ll}\p{Lo}\p{Lm}]+)+$")


def entity_id(key: Column | str, digits: int = 8) -> Column:
    return F.concat(F.lit("ent2_"), F.substring(F.sha2(F.concat_ws("|", F.lit(ENTITY_VERSION), _c(key)), 256), 1, digits))


def degree_bucket(degree: Column | str, low: int = 3, high: int = 6) -> Column:
    d = _c(degree)
    return F.when(d < low, "low").when(d < high, "medium").otherwise("high")


def finite(x: Column | str) -> Column:
    """x, or null where it is NaN or infinite."""
    c = _c(x)
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def money(x: Column | str) -> Column:
    """A positive amount with six decimals; null for everything else."""
    v = _c(x).try_cast("decimal(18,6)")
    return F.when(v > 0, v)


# Paths (arrays that alternate entity, relation, entity, ...) ------------------------------------


def path_entities(path: Column | str) -> Column:
    return F.array_distinct(F.filter(_c(path), lambda x, i: i % 2 == 0))


def path_relations(path: Column | str) -> Column:
    return F.filter(_c(path), lambda x, i: i % 2 == 1)


# Vectors (arrays of doubles) ---------------------------------------------------------------------


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def normalise(a: Column | str, eps: float = 1e-12) -> Column:
    """a of length 1; zeros where it is shorter than eps."""
    n = norm(a)
    return F.transform(_c(a), lambda x: F.when(n > eps, x.cast("double") / n).otherwise(F.lit(0.0)))


def add(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") + y.cast("double"))


def subtract(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") - y.cast("double"))


def distance(a: Column | str, b: Column | str) -> Column:
    return norm(subtract(a, b))


def cosine(a: Column | str, b: Column | str, floor: float = 1e-12) -> Column:
    """Between -1 and 1; 0 where a vector is shorter than the floor."""
    na, nb = norm(a), norm(b)
    return F.when((na > floor) & (nb > floor), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / (na * nb)))).otherwise(F.lit(0.0))


def cosine_distance(a: Column | str, b: Column | str, floor: float = 1e-12) -> Column:
    """1 - cosine, at least 0; null where a vector is shorter than the floor and so has no direction."""
    return F.when((norm(a) > floor) & (norm(b) > floor), F.greatest(F.lit(0.0), 1 - cosine(a, b, floor)))


def transpose(q: Column | str) -> Column:
    """The columns of a matrix of rows."""
    return F.transform(F.sequence(F.lit(0), F.size(_c(q)[0]) - 1), lambda j: F.transform(_c(q), lambda row: row[j]))


def times_matrix(v: Column | str, q: Column | str) -> Column:
    """v Q for a matrix of rows."""
    return F.transform(transpose(q), lambda c: dot(_c(v), c))


def align_centred(v: Column | str, q: Column | str, source_mean: Column | str) -> Column:
    """(v - source mean) Q: a source vector about its mean, turned."""
    return times_matrix(subtract(v, source_mean), q)


def align_affine(v: Column | str, q: Column | str, source_mean: Column | str, target_mean: Column | str) -> Column:
    """(v - source mean) Q + target mean: a source vector where its target should lie."""
    return add(align_centred(v, q, source_mean), target_mean)


def all_finite(v: Column | str) -> Column:
    return F.coalesce(F.forall(_c(v), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def random_mrr(n: Column | str) -> Column:
    """The expected reciprocal rank of a random order of n candidates."""
    return F.when(_c(n) > 0, F.aggregate(F.sequence(F.lit(1), _c(n).cast("int")), F.lit(0.0), lambda s, k: s + F.lit(1.0) / k) / _c(n))
