"""Plain Python versions of the operators that SQL does not express, for comparison."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()


def micros(d: datetime) -> int:
    x = d - EPOCH
    return (x.days * 86_400 + x.seconds) * 1_000_000 + x.microseconds


def in_zone(d: datetime, name: str) -> datetime:
    z = ZoneInfo(name)
    first = d.replace(tzinfo=z, fold=0)
    back = first.astimezone(timezone.utc).astimezone(z).replace(tzinfo=None)
    if back == d:
        return first.astimezone(timezone.utc)
    # A skipped time: read with the offset before the gap it moves on by the gap's length.
    return (d - first.utcoffset()).replace(tzinfo=timezone.utc)


def instant(value, source, basis, zones) -> int | None:
    if value is None or not (s := value.strip()):
        return None
    zone = zones.get(source)
    if re.fullmatch(r"\d+", s) and len(s) in (10, 13, 16):
        return int(s) * {10: 10**6, 13: 1000, 16: 1}[len(s)]
    region = frac = None
    if m := re.search(r"\[(.+)\]$", s):
        s = s[: m.start()]
    s = re.sub(r"^[^\d,]+, ", "", s)
    off = None
    if m := re.search(r"\s*\(GMT([+-])(\d+)(?::(\d+))?\)$", s):
        off = (int(m[2]) * 60 + int(m[3] or 0)) * (-1 if m[1] == "-" else 1)
    elif re.match(r"\d{4}-.*:|.*\d{4} \d\d:\d\d:\d\d ", s) and (m := re.search(r"\s*([+-])(\d\d):?(\d\d)?$", s)):
        off = (int(m[2]) * 60 + int(m[3] or 0)) * (-1 if m[1] == "-" else 1)
    elif m := re.search(r"(?<=\d)[zZ]$", s):
        off = 0
    elif (m := re.search(r" ([A-Z]{3,4})$", s)) and m[1] not in ("AM", "PM"):
        if zone is None or m[1] not in (zone["std_abbrev"], zone["dst_abbrev"]):
            return None
        z = ZoneInfo(zone["zone_name"])
        both = sorted(datetime(2025, k, 1, tzinfo=z).utcoffset() for k in (1, 7))
        off = int((both[0] if m[1] == zone["std_abbrev"] else both[1]).total_seconds() // 60)
    if m:
        s = s[: m.start()]
    if m := re.search(r"(?<=:\d\d)[.,](\d+)$", s):
        frac, s = m[1], s[: m.start()]
    num = "%m{0}%d{0}%Y" if zone and zone["date_order"] == "mdy" else "%d{0}%m{0}%Y"
    tries = ["%Y-%m-%d", "%Y%m%d%H%M%S", "%d %b %Y %H:%M:%S", "%b %d, %Y %I:%M %p", "%H:%M " + num.format("/")]
    tries += [f"%Y-%m-%d{t}{c}" for t in "Tt " for c in ("%H:%M:%S", "%H:%M")]
    tries += [num.format(x) + y for x in "/.-" for y in (" %H:%M", " %H:%M:%S", ", %H:%M", " %I:%M %p")]
    for f in tries:
        try:
            d = datetime.strptime(s, f)
        except ValueError:
            continue
        if (f == "%Y%m%d%H%M%S") != (re.fullmatch(r"\d{14}", s) is not None):
            continue
        break
    else:
        return None
    d = d.replace(microsecond=int((frac or "0")[:6].ljust(6, "0")))
    if off is not None:
        return micros(d.replace(tzinfo=timezone.utc)) - off * 60_000_000
    if region or basis == "wayback_archive_datetime":
        return micros(d.replace(tzinfo=timezone.utc))
    return micros(in_zone(d, zone["zone_name"])) if zone else None


def known(events, decisions):
    """events: (id, endpoint, mention, us); decisions: (id, mention, us, supersedes)."""
    by = {}
    for d in set(decisions):
        by.setdefault(d[1].lower(), []).append(d)
    out = set()
    for e, end, mention, us in events:
        c = [d for d in by.get((mention or "").lower(), []) if us is not None and d[2] <= us]
        old = {d[3] for d in c if d[3] != d[0]}
        left = [d for d in c if d[0] not in old]
        if left:
            out.add((e, end, max(left, key=lambda d: d[2])[0]))
    return out


__all__ = ["instant", "known", "micros", "in_zone", "timedelta"]
