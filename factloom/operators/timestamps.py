"""Mixed timestamp notations to one UTC instant (problem 4).

Every value is first rewritten by one anchored pattern per notation into the
fields ``notation;y;p1;p2;H;M;S;fraction;ampm;zone;region`` and then read in every
way that is valid: with day or month first, a repeated local hour as the first or
the second, twelve digits as a date or as a count.  A value so has an array of
readings.  Which one holds is decided for all records of a source together by a
Viterbi over their order of arrival: a change of the order of day and month and a
jump backward in time cost, and so does a reading that the source's declared order,
or the rule that the first of two equal local times counts, speaks against.

The chain of a source is cut wherever its records, in order, lie in several
partitions; a stretch is summarised by the matrix of its cheapest costs between its
first and last state, and the matrices are combined per source.  So no source is
gathered into one task.  Inside of a partition many blocks advance together.

Defined results: null, blank, relative and placeholder values, dates or times
that do not exist, and zoneless values of unlisted publishers (unless archived)
have a null instant, as have dates that do not exist in the declared order.
Repeated rows each keep their result.  Records without arrival come first.
"""

from __future__ import annotations

import zoneinfo
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import staged, tasks_for

ARCHIVE_BASIS = "wayback_archive_datetime"

# Notations, each with its rewriting.
_ZONE = r"(Z|z|(?:UTC|GMT)?\s?[+-]\d{1,2}(?::?\d{2})?|[A-Za-z]{2,5})"
_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9})\d*)?)?(?:\s?([AaPp][Mm]))?"
_DAY_NAME = r"(?:[^\d\s,;]+(?:\s[^\d\s,;]+)?,\s*)?"
_TAIL = rf"(?:\s*\(?{_ZONE}\)?)?(?:\[([^\]\s;]+)\])?"
_NOTATIONS: list[tuple[str, str, str]] = [
    ("ymd", rf"^(\d{{4}})([-/.])(\d{{1,2}})\2(\d{{1,2}})(?:(?:[Tt]|,?\s+){_TIME}{_TAIL})?$", "$1;$3;$4;$5;$6;$7;$8;$9;$10;$11"),
    ("ymd", rf"^(\d{{4}})(\d{{2}})(\d{{2}})(?:[Tt]?(\d{{2}})(\d{{2}})(\d{{2}})?()()(?:\s?{_ZONE})?())?$", "$1;$2;$3;$4;$5;$6;$7;$8;$9;$10"),
    ("num", rf"^{_DAY_NAME}(\d{{1,2}})([-/.])(\d{{1,2}})\2(\d{{4}})(?:(?:[Tt]|,?\s+){_TIME}{_TAIL})?$", "$4;$1;$3;$5;$6;$7;$8;$9;$10;$11"),
    ("num", rf"^{_TIME},?\s+{_DAY_NAME}(\d{{1,2}})([-/.])(\d{{1,2}})\7(\d{{4}}){_TAIL}$", "$9;$6;$8;$1;$2;$3;$4;$5;$10;$11"),
    ("dmonth", rf"^{_DAY_NAME}(\d{{1,2}})[\s-]([A-Za-z]{{3,9}})\.?,?[\s-](\d{{4}})(?:,?\s+{_TIME}{_TAIL})?$", "$3;$1;$2;$4;$5;$6;$7;$8;$9;$10"),
    ("monthd", rf"^{_DAY_NAME}([A-Za-z]{{3,9}})\.?\s+(\d{{1,2}}),?\s+(\d{{4}})(?:,?\s+{_TIME}{_TAIL})?$", "$3;$1;$2;$4;$5;$6;$7;$8;$9;$10"),
]
_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

SWITCH_COST = 1.0
BACKWARD_COST = 0.25
#: More than a path can save by one reading: two switches and two backward jumps.
AGAINST_COST = 16.0

#: Readings of a value: day first or month first, each as the usual or the other instant
#: (the second of two equal local times, or a count instead of a written date).
DAY_FIRST, MONTH_FIRST, DAY_FIRST_OTHER, MONTH_FIRST_OTHER = range(4)
PART_ROWS = 50_000
BLOCK_ROWS = 128


def _local_seconds(ts: Column) -> Column:
    """Seconds of a timestamp without zone since 1970, free of the session's zone."""
    day = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long")
    return day * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def _utc_seconds(ts: Column, zone: Column) -> Column:
    """A repeated local time is the first; a skipped one moves on by the gap."""
    return _local_seconds(F.convert_timezone(zone, F.lit("UTC"), ts))


def _known_zone(zone: Column) -> Column:
    return F.when(zone.isin(*sorted(zoneinfo.available_timezones())), zone)


def interpretations(df: DataFrame, value: str, zone: str, order: str, std: str, dst: str, archived: Column) -> DataFrame:
    """df with ``readings`` (four instants in microseconds, null where a reading is not valid) and ``declared``.

    Readings are in the order of the constants above.  The usual readings are equal
    where day and month cannot be taken for each other.  ``declared`` is 0 where the
    source puts the day first, 1 for the month, else null.  The result is written to
    the shared folder: nothing may be merged into these expressions.
    """
    keep = df.columns
    v = F.regexp_replace(F.regexp_replace(F.col(value), r"^[\s 　]+|[\s 　]+$", ""), ";", "\u0001")
    df = df.withColumn("_v", v)
    canon: Column = F.lit(None).cast("string")
    for name, pattern, rewrite in reversed(_NOTATIONS):
        canon = F.when(F.col("_v").rlike(pattern), F.concat(F.lit(name + ";"), F.regexp_replace(F.col("_v"), pattern, rewrite))).otherwise(canon)
    df = df.withColumn("_f", F.split(F.when(F.col("_v").rlike(r"\d"), canon), ";"))
    f = lambda i: F.nullif(F.col("_f")[i], F.lit(""))
    whole = lambda i: f(i).try_cast("int")
    df = df.select(
        "*",
        F.col("_f")[0].alias("_notation"),
        whole(1).alias("_y"),
        whole(2).alias("_i2"),
        whole(3).alias("_i3"),
        F.when(F.col("_f")[0] == "dmonth", f(3)).otherwise(f(2)).alias("_word"),
        F.coalesce(whole(4), F.lit(0)).alias("_h"),
        F.coalesce(whole(5), F.lit(0)).alias("_mi"),
        F.coalesce(whole(6), F.lit(0)).alias("_sec"),
        F.coalesce(F.rpad(F.substring(f(7), 1, 6), 6, "0").try_cast("long"), F.lit(0).cast("long")).alias("_micros"),
        F.lower(f(8)).alias("_ampm"),
        F.upper(f(9)).alias("_token"),
        f(10).alias("_bracket"),
        F.array_position(F.array(F.lit("dmy"), F.lit("mdy")), F.lower(F.col(order))).alias("_which"),
    )
    h, ampm = F.col("_h"), F.col("_ampm")
    clock = F.when(ampm.isNull(), h).when(h.between(1, 12), h % 12 + F.when(ampm == "pm", 12).otherwise(0))
    name = F.nullif(F.array_position(F.array(*map(F.lit, _MONTHS)), F.lower(F.substring("_word", 1, 3))).cast("int"), F.lit(0))
    signed = r"^(?:UTC|GMT)?\s?([+-]\d{1,2}):?(\d{2})?$"
    token = F.coalesce("_token", F.lit(""))
    df = df.select("*", clock.alias("_clock"), name.alias("_named"), F.nullif(F.regexp_extract(token, signed, 1), F.lit("")).alias("_hh"), F.coalesce(F.nullif(F.regexp_extract(token, signed, 2), F.lit("")).try_cast("int"), F.lit(0)).alias("_mm"))
    notation, i2, i3 = F.col("_notation"), F.col("_i2"), F.col("_i3")
    ok = F.col("_clock").between(0, 23) & F.col("_mi").between(0, 59) & F.col("_sec").between(0, 59) & (F.col("_y") >= 1)
    numeric_date = F.coalesce(notation == "num", F.lit(False))
    m = F.when(notation == "ymd", i2).when(notation == "num", i3).otherwise(F.col("_named"))
    d = F.when(notation.isin("num", "dmonth"), i2).otherwise(i3)
    df = df.select("*", ok.alias("_ok"), m.alias("_m"), d.alias("_d"), numeric_date.alias("_num"), (F.nullif(F.col("_which"), F.lit(0)) - 1).cast("int").alias("declared"))

    def local(month: Column, day: Column) -> Column:
        fits = F.col("_ok") & month.between(1, 12) & day.between(1, 31)
        return F.when(fits, F.try_make_timestamp_ntz(F.col("_y"), month, day, F.col("_clock"), F.col("_mi"), F.col("_sec").cast("decimal(16,6)")))

    df = df.select("*", local(F.col("_m"), F.col("_d")).alias("_l0"), F.when(F.col("_num"), local(F.col("_d"), F.col("_m"))).alias("_l1"))
    # A date that does not exist in the declared order is none, whatever the other order makes of it.
    gone = F.col("_num") & F.coalesce(((F.col("declared") == 0) & F.col("_l0").isNull()) | ((F.col("declared") == 1) & F.col("_l1").isNull()), F.lit(False))
    df = df.withColumns({c: F.when(~gone, F.col(c)) for c in ("_l0", "_l1")})
    hours = F.col("_hh").try_cast("int")
    span = F.abs(hours) * 3600 + F.col("_mm") * 60
    numeric = F.when((F.abs(hours) <= 18) & (F.col("_mm") < 60), F.when(F.col("_hh").startswith("-"), -span).otherwise(span))
    token = F.col("_token")

    def in_month(month: int) -> Column:
        """The offset of the source's zone in a month of the value's own year."""
        probe = F.try_make_timestamp_ntz(F.col("_y"), F.lit(month), F.lit(15), F.lit(12), F.lit(0), F.lit(0).cast("decimal(16,6)"))
        return _local_seconds(probe) - _utc_seconds(probe, F.col(zone))

    own = F.when(token == F.upper(F.col(std)), F.least(in_month(1), in_month(7))).when(token == F.upper(F.col(dst)), F.greatest(in_month(1), in_month(7)))
    named = F.when(token.isin("UTC", "GMT", "Z") & ~F.coalesce(token.isin(F.upper(F.col(std)), F.upper(F.col(dst))), F.lit(False)), F.lit(0)).otherwise(own)
    # What a value itself says of its zone: an offset in seconds, or a region.
    region = F.when(token.isNotNull(), F.lit(None).cast("string")).when(F.col("_bracket").isNotNull(), _known_zone(F.col("_bracket"))).when(archived, F.lit("UTC")).otherwise(F.col(zone))
    df = df.select("*", F.when(F.col("_hh").isNotNull(), numeric).otherwise(named).alias("_off"), region.alias("_region"))

    def utc(at: str) -> Column:
        return F.coalesce(_local_seconds(F.col(at)) - F.col("_off"), _utc_seconds(F.col(at), F.col("_region")))

    df = df.select("*", utc("_l0").alias("_u0"), utc("_l1").alias("_u1"))

    def repeated(at: str, first: str) -> Column:
        """The second instant of a local time that its zone has twice."""
        z, after = F.col("_region"), F.col(first) + 3 * 3600
        clock_at = lambda us: _local_seconds(F.convert_timezone(F.lit("UTC"), z, F.timestamp_seconds(us).cast("timestamp_ntz")))
        second = _local_seconds(F.col(at)) - (clock_at(after) - after)
        return F.when(F.col("_off").isNull() & (second > F.col(first)) & (clock_at(second) == _local_seconds(F.col(at))), second)

    digits = F.length(F.regexp_replace(F.col("_v"), "^[+-]|[.].*$", ""))
    count = F.when(F.col("_f").isNull() & F.col("_v").rlike(r"^[+-]?\d{1,20}([.]\d+)?$"), F.col("_v").try_cast("decimal(38,9)"))
    # A plain number counts seconds, milliseconds, microseconds or nanoseconds by its
    # length; 8 and 14 digits are the lengths of a written date and count as nothing else.
    unit = F.when(digits.isin(8, 14), F.lit(None).cast("decimal(20,9)")).when(digits <= 11, F.lit(1_000_000)).when(digits <= 14, F.lit(1_000)).when(digits <= 17, F.lit(1)).otherwise(F.lit(0.001).cast("decimal(4,3)"))
    plain = F.floor(count * unit).try_cast("long")
    # Twelve digits may be a date without seconds; where they are no date, they count.
    twelve = F.when(F.col("_v").rlike(r"^\d{12}$"), F.col("_v").try_cast("long") * 1000)
    us = lambda c: c * 1_000_000 + F.col("_micros")
    number = F.coalesce(plain, F.when(F.col("_l0").isNull(), twelve))
    df = df.select("*", number.alias("_n"), F.when(F.col("_l0").isNotNull(), twelve).alias("_count"), repeated("_l0", "_u0").alias("_s0"), repeated("_l1", "_u1").alias("_s1"))
    first = F.coalesce(us(F.col("_u0")), F.col("_n"))
    other = F.coalesce(us(F.col("_s0")), F.col("_count"))
    readings = F.array(first, F.when(F.col("_num"), us(F.col("_u1"))).otherwise(first), other, F.when(F.col("_num"), us(F.col("_s1"))).otherwise(other))
    return staged(df.select(*keep, readings.alias("readings"), "declared"), "readings")


# The chooser.  A state is a reading; _SWITCH has what going from one to another costs.
_ORDER = np.arange(4) % 2
_SWITCH = SWITCH_COST * (_ORDER[:, None] != _ORDER[None, :])


def _priors(us: np.ndarray, valid: np.ndarray, declared: np.ndarray) -> np.ndarray:
    """(n, 4): what each reading costs by itself; infinite where it is not valid."""
    against = (declared[:, None] >= 0) & (declared[:, None] != _ORDER[None, :])
    return np.where(valid, AGAINST_COST * (against + (np.arange(4) >= 2)[None, :]), np.inf)


def _step(before: np.ndarray, now: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """(n, 4, 4): the cost of going from each reading of the record before to each of this one."""
    return _SWITCH + BACKWARD_COST * (now[:, None, :] < before[:, :, None]) + prior[:, None, :]


def _then(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cheapest costs of two stretches one after the other."""
    return (a[..., :, :, None] + b[..., None, :, :]).min(axis=-2)


def _route(costs: list[np.ndarray], steps: list[np.ndarray], enter: np.ndarray, end: int | None = None) -> list[tuple[int, int]]:
    """The first and last state of every stretch on the cheapest path.

    costs: each stretch's matrix; steps: of going into each stretch from the one before
    (the first is not used); enter: the costs of beginning in each state.
    """
    at, ins, outs = enter, [], []
    for i, m in enumerate(costs):
        if i:
            at = (outs[-1][:, None] + steps[i]).min(axis=0)
        ins.append(at)
        outs.append((at[:, None] + m).min(axis=0))
    state, out = (int(outs[-1].argmin()) if end is None else end), []
    for i in range(len(costs) - 1, -1, -1):
        first = int((ins[i] + costs[i][:, state]).argmin())
        out.append((first, state))
        if i:
            state = int((outs[i - 1] + steps[i][:, first]).argmin())
    return out[::-1]


class _Part:
    """The records of a partition in order: segments of one source each, cut into blocks that advance together."""

    def __init__(self, source: np.ndarray, us: np.ndarray, valid: np.ndarray, declared: np.ndarray, block: int = BLOCK_ROWS):
        n = len(source)
        self.us, self.prior = us, _priors(us, valid, declared)
        self.steps = np.concatenate([np.zeros((1, 4, 4)), _step(us[:-1], us[1:], self.prior[1:])]) if n else np.zeros((0, 4, 4))
        cuts = np.flatnonzero(np.concatenate([[True], source[1:] != source[:-1]])) if n else np.zeros(0, int)
        self.segments = list(zip(cuts.tolist(), [*cuts[1:].tolist(), n]))
        self.starts = np.array([i for a, z in self.segments for i in range(a, z, block)], int)
        self.ends = np.array([min(i + block, z) for a, z in self.segments for i in range(a, z, block)], int)
        self.costs = np.where(np.eye(4, dtype=bool), 0.0, np.inf)[None].repeat(len(self.starts), axis=0)
        for j in range(1, int((self.ends - self.starts).max(initial=1))):
            on = np.flatnonzero(self.starts + j < self.ends)
            self.costs[on] = _then(self.costs[on], self.steps[self.starts[on] + j])

    def _blocks(self, segment: tuple[int, int]) -> range:
        return range(int(np.searchsorted(self.starts, segment[0])), int(np.searchsorted(self.starts, segment[1])))

    def summary(self, segment: tuple[int, int]) -> np.ndarray:
        first, *rest = self._blocks(segment)
        m = self.costs[first]
        for b in rest:
            m = _then(_then(m, self.steps[self.starts[b]]), self.costs[b])
        return m

    def decide(self, ways: dict[int, tuple[int, int]]) -> np.ndarray:
        """The state of every record; ways: first and last state of each segment by its start."""
        enter, leave = np.zeros(len(self.starts), int), np.zeros(len(self.starts), int)
        for segment in self.segments:
            own, (first, last) = self._blocks(segment), ways[segment[0]]
            begin = np.full(4, np.inf)
            begin[first] = 0.0
            for b, (x, y) in zip(own, _route([self.costs[b] for b in own], [self.steps[self.starts[b]] for b in own], begin, last)):
                enter[b], leave[b] = x, y
        size = int((self.ends - self.starts).max(initial=0))
        cost = np.full((len(enter), 4), np.inf)
        cost[np.arange(len(enter)), enter] = 0.0
        back = np.zeros((size, len(enter), 4), np.int8)
        for j in range(1, size):
            on = np.flatnonzero(self.starts + j < self.ends)
            all_ways = cost[on][:, :, None] + self.steps[self.starts[on] + j]
            back[j, on] = all_ways.argmin(axis=1)
            cost[on] = all_ways.min(axis=1)
        out, state = np.zeros(len(self.us), int), leave
        for j in range(size - 1, -1, -1):
            on = np.flatnonzero(self.starts + j < self.ends)
            out[self.starts[on] + j] = state[on]
            if j:
                state[on] = back[j, on, state[on]]
        return out


def _numbers(readings) -> tuple[np.ndarray, np.ndarray]:
    """(us, valid) of a column of readings."""
    flat = readings.flatten()
    valid = flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, 4)
    return flat.fill_null(0).to_numpy(zero_copy_only=False).reshape(-1, 4), valid


def _part_of(t: pa.Table) -> _Part:
    t = t.combine_chunks()
    one = lambda c: t.column(c).chunk(0) if t.num_rows else pa.array([], t.schema.field(c).type)
    codes = one("src").dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    return _Part(codes, *_numbers(one("readings")), one("declared").fill_null(-1).to_numpy(zero_copy_only=False))


def choose_readings(df: DataFrame, key: str, source: str, arrival: str, part_rows: int = PART_ROWS) -> DataFrame:
    """(key, us): of every record with a reading the one that the cheapest path of its source takes.

    df has ``readings`` and ``declared`` of :func:`interpretations`, of which at least
    one must be valid, and ``arrival`` in microseconds.
    """
    kind = dict(df.dtypes)[key]
    rows = df.select(F.col(key).alias("key"), F.col(source).cast("string").alias("src"), F.col(arrival).alias("at"), "readings", "declared")
    ordered = rows.repartitionByRange(tasks_for(df.count(), part_rows, 1), "src", "at", "key", "readings").sortWithinPartitions("src", "at", "key", "readings")
    columns = ["part", "pos", "key", "src", "readings", "declared", "last", "costs"]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The records with their place, and a row with the costs of each source's stretch."""
        part, held = TaskContext.get().partitionId(), list(batches)
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        n, p = t.num_rows, _part_of(t)
        numbers, null = [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(n, dtype=np.int32))], pa.nulls(n, pa.list_(pa.int64()))
        yield from pa.Table.from_arrays([*numbers, *[t.column(c) for c in columns[2:6]], null, pa.nulls(n, pa.list_(pa.float64()))], names=columns).to_batches(max_chunksize=10_000)
        at = pa.array([a for a, _ in p.segments])
        last = t.column("readings").take(pa.array([z - 1 for _, z in p.segments]))
        costs = pa.array([p.summary(s).ravel().tolist() for s in p.segments], pa.list_(pa.float64()))
        m = len(p.segments)
        firsts = [t.column(c).take(at) for c in ("src", "readings", "declared")]
        yield from pa.Table.from_arrays([pa.array(np.full(m, part, np.int32)), at.cast(pa.int32()), pa.nulls(m, t.schema.field("key").type), *firsts, last, costs], names=columns).to_batches()

    def chain(t: pa.Table) -> pa.Table:
        """The states in which the cheapest path enters and leaves each stretch of one source: a row a partition."""
        t = t.sort_by("part").combine_chunks()
        us, valid = _numbers(t.column("readings").chunk(0))
        last, _ = _numbers(t.column("last").chunk(0))
        prior = _priors(us, valid, t.column("declared").fill_null(-1).to_numpy())
        steps = [np.zeros((4, 4)), *_step(last[:-1], us[1:], prior[1:])]
        costs = t.column("costs").chunk(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, 4, 4)
        ways = np.array(_route(list(costs), steps, prior[0]), np.int32)
        return pa.table({"part": t.column("part"), "pos": t.column("pos"), "enter": ways[:, 0], "leave": ways[:, 1]})

    def decide(a: pa.Table, b: pa.Table) -> pa.Table:
        a = a.sort_by("pos")
        ways = {p: (x, y) for p, x, y in zip(*[b.column(c).to_pylist() for c in ("pos", "enter", "leave")])}
        p = _part_of(a)
        us = p.us[np.arange(len(p.us)), p.decide(ways)]
        return pa.table({"key": a.column("key"), "us": pa.array(us, pa.int64())})

    d = staged(ordered.mapInArrow(number, f"part int, pos int, key {kind}, src string, readings array<bigint>, declared int, last array<bigint>, costs array<double>"), "ordered")
    path = d.filter("costs is not null").groupBy("src").applyInArrow(chain, "part int, pos int, enter int, leave int")
    records = d.filter("costs is null").select("part", "pos", "key", "src", "readings", "declared")
    return records.groupBy("part").cogroup(path.groupBy("part")).applyInArrow(decide, f"key {kind}, us bigint").withColumnRenamed("key", key)


def normalise_timestamps(df: DataFrame, key: str, value: str, source: str, basis: str, arrival: str, zones: DataFrame) -> DataFrame:
    """(key, us) of every row of df; us is null where the value names no instant.

    ``zones``: source_id, zone_name, date_order, std_abbrev, dst_abbrev, one row a
    source (of repeated ones the first by name counts).  ``arrival`` orders the
    records of a source, as a timestamp or an ISO string.
    """
    d = df.select(F.col(key).alias("_k"), F.col(value).alias("_val"), F.col(source).alias("_s"), F.col(basis).alias("_b"), arrival_us(df, arrival).alias("_arr"))
    d = d.join(one_zone(zones).withColumnRenamed("source_id", "_s"), "_s", "left").select("_k", "_val", "_s", "_b", "_arr", *[F.col(f"_z.{a}").alias(b) for a, b in (("zone_name", "_zone"), ("date_order", "_order"), ("std_abbrev", "_std"), ("dst_abbrev", "_dst"))])
    d = interpretations(d, "_val", "_zone", "_order", "_std", "_dst", F.coalesce(F.col("_b") == ARCHIVE_BASIS, F.lit(False)))
    d = d.select("_k", F.col("_s").cast("string").alias("_s"), F.coalesce("_arr", F.lit(-(2**63))).alias("_at"), "readings", "declared")
    ways = F.array_compact("readings")
    out = lambda x, us: x.select(F.col("_k").alias(key), us.cast("long").alias("us"))
    nothing = out(d.filter(F.size(ways) == 0), F.lit(None))
    named = d.filter(F.size(ways) > 0)
    # Sources all of whose values have one reading need no choice; their number is that of publishers.
    open_sources = staged(named.filter(F.size(F.array_distinct(ways)) > 1).select("_s").distinct(), "sources")
    same_source = F.expr("a._s <=> b._s")
    settled = out(named.alias("a").join(open_sources.alias("b"), same_source, "left_anti"), ways[0])
    chosen = choose_readings(named.alias("a").join(open_sources.alias("b"), same_source, "left_semi"), "_k", "_s", "_at")
    return nothing.unionByName(settled).unionByName(chosen.withColumnRenamed("_k", key))


def one_zone(zones: DataFrame) -> DataFrame:
    """(source_id, _z): one row a source; unknown zone names are null."""
    return zones.groupBy("source_id").agg(F.min_by(F.struct(_known_zone(F.col("zone_name")).alias("zone_name"), "date_order", "std_abbrev", "dst_abbrev"), F.struct("zone_name", "date_order")).alias("_z"))


def iso_micros(c: Column) -> Column:
    """Microseconds of an ISO instant with Z or offset; null for anything else."""
    zoned = F.when(F.trim(c).rlike(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}(:\d{2}([.]\d+)?)?\s?([Zz]|[+-]\d{2}(:?\d{2})?)$"), F.upper(F.trim(c)))
    return F.unix_micros(F.try_to_timestamp(zoned))


def arrival_us(df: DataFrame, arrival: str) -> Column:
    kind = dict(df.dtypes)[arrival]
    if kind == "string":
        return iso_micros(F.col(arrival))
    c = F.col(arrival)
    return _local_seconds(c) * 1_000_000 + F.pmod(F.extract(F.lit("SECONDS"), c) * 1_000_000, F.lit(1_000_000)).cast("long") if kind == "timestamp_ntz" else F.unix_micros(c)
