"""Instants from texts in many notations, precisions and clocks.

All notations are compiled into one regular expression: an alternation whose branches name
their components.  A value is matched once; the components of the branch that matched are
checked against the calendar and put together by integer day arithmetic.  A zone or offset
in the value counts, else the zone given with it.  Local times that occur twice are their
first occurrence, skipped ones move on by the length of the skip.  Digits beyond
microseconds are cut off.  Words, impossible dates, clock times beyond 23:59:59 (hour 24 and
leap seconds too), weeks and days of the year, local values without a known zone and yearless
values without a year denote nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime
from functools import lru_cache
from zoneinfo import ZoneInfo

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Month names and abbreviations in French and English, without accents and dots.
MONTHS = {
    name: number
    for number, names in enumerate(
        (
            ("janvier", "janv", "jan", "january"),
            ("fevrier", "fevr", "fev", "february", "feb"),
            ("mars", "mar", "march"),
            ("avril", "avr", "april", "apr"),
            ("mai", "may"),
            ("juin", "june", "jun"),
            ("juillet", "juil", "july", "jul"),
            ("aout", "august", "aug"),
            ("septembre", "sept", "september", "sep"),
            ("octobre", "oct", "october"),
            ("novembre", "nov", "november"),
            ("decembre", "dec", "december"),
        ),
        1,
    )
    for name in names
}
# Hours east of Greenwich of zone abbreviations.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 1, "BST": 1, "CET": 1, "CEST": 2, "MEZ": 1, "MESZ": 2, "EET": 2, "EEST": 3,
    "MSK": 3, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7, "IST": 5.5, "RET": 4, "GFT": -3,
}
_UNACCENT = str.maketrans("éèêëàâäûùüôöîïç", "eeeeaaauuuooiic")

_TIME = r"(?P<h>\d{1,2}):(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d{1,30}))?)?(?:\s*(?P<ap>[ap])\.?m\b\.?)?"
_HOUR = r"(?P<h>\d{1,2})\s?(?:h|:)\s?(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d{1,30}))?)?(?:\s*(?P<ap>[ap])\.?m\b\.?)?"
_ZONE = r"(?:\s*(?:(?P<z>z)|(?:(?:utc|gmt)\s?)?(?P<o>[-+−]\d{1,2}(?::?\d{2})?)(?::\d{2})?(?:\s*\[[a-z_/+-]+\])?|\[?(?P<zn>[a-z]+(?:/[a-z_+-]+)+)\]?|(?P<za>[a-z]{2,5})))?"
_DAY = r"(?P<d>\d{1,2})(?:er|st|nd|rd|th)?"
_WEEK = r"(?:[^\W\d_]{2,9}\.?,?\s+)?"
_MONTH = r"(?P<mn>[^\W\d_]{3,9})\.?"

#: The notations, most specific first.
FORMATS: dict[str, str] = {
    "iso": rf"(?P<y>\d{{4}})(?P<sep>[-/.])(?P<mo>\d{{1,2}})(?P=sep)(?P<d>\d{{1,2}})(?:(?:t|\s+|,\s*){_TIME}{_ZONE})?",
    "iso_month": r"(?P<y>\d{4})[-/.](?P<mo>\d{1,2})",
    "compact": r"(?P<y>\d{4})(?P<mo>\d{2})(?P<d>\d{2})(?:[t\s]?(?P<h>\d{2})(?P<mi>\d{2})(?P<s>\d{2})?(?:[.,](?P<f>\d{1,30}))?" + _ZONE + ")?",
    "epoch": r"(?P<n>-?\d{9,10}|\d{13}|\d{16}|\d{19})(?:\.(?P<f>\d{1,30}))?",
    "numeric": rf"(?P<a>\d{{1,2}})(?P<sep>[-/.])(?P<b>\d{{1,2}})(?P=sep)(?P<y>\d{{4}}|\d{{2}})(?:(?:t|\s+|,\s*){_TIME}{_ZONE})?",
    "numeric_yearless": rf"(?P<a>\d{{1,2}})[-/.](?P<b>\d{{1,2}})(?:\s+|,\s*){_TIME}{_ZONE}",
    "month": r"(?P<mo>\d{1,2})[-/.](?P<y>\d{4})",
    "year": r"(?P<y>\d{4})",
    "day_name": rf"{_WEEK}{_DAY}[\s-]+{_MONTH}(?:[\s,-]+(?P<y>\d{{4}}|\d{{2}}))?(?:(?:\s*,?\s+|,\s*)(?:(?:à|a|at)\s+)?{_HOUR}{_ZONE})?",
    "name_day": rf"{_WEEK}{_MONTH}\s+{_DAY}(?:,?\s+(?P<y>\d{{4}}))?(?:(?:\s*,?\s+|,\s*)(?:at\s+)?{_HOUR}{_ZONE})?",
    "name_year": rf"{_MONTH}\s+(?P<y>\d{{4}})",
}
_NAMES = list(FORMATS)


def _branch(k: int, pattern: str) -> str:
    """A branch whose group names carry its number, within a group of its own that ends last."""
    pattern = re.sub(r"\(\?P<(\w+)>", rf"(?P<\g<1>{k}>", pattern)
    return rf"(?P<F{k}>{re.sub(r'\(\?P=(\w+)\)', rf'(?P=\g<1>{k})', pattern)})"


NOTATIONS = re.compile(r"\s*(?:" + "|".join(_branch(k, FORMATS[n]) + r"\s*\Z" for k, n in enumerate(_NAMES)) + ")", re.I)
_GROUPS = [
    {re.sub(r"\d+\Z", "", g): i for g, i in NOTATIONS.groupindex.items() if g[-len(str(k)) :] == str(k) and g.rstrip("0123456789") + str(k) == g and g[0] != "F"}
    for k in range(len(_NAMES))
]

DAYS_IN_MONTH = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)


def days_from_civil(y: int, m: int, d: int) -> int:
    """Days since 1970-01-01 in the proleptic Gregorian calendar."""
    y -= m <= 2
    era, yoe = y // 400, y % 400
    doy = (153 * ((m + 9) % 12) + 2) // 5 + d - 1
    return era * 146097 + yoe * 365 + yoe // 4 - yoe // 100 + doy - 719468


def is_day(y: int, m: int, d: int) -> bool:
    if not (1 <= y <= 9999 and 1 <= m <= 12 and d >= 1):
        return False
    leap = m == 2 and y % 4 == 0 and (y % 100 != 0 or y % 400 == 0)
    return d <= DAYS_IN_MONTH[m - 1] + leap


@lru_cache(maxsize=1024)
def _zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except Exception:  # noqa: BLE001  unknown names and unreadable keys alike
        return None


@lru_cache(maxsize=1024)
def _zone_any_case(name: str) -> ZoneInfo | None:
    return _zone(name) or _zone("/".join("_".join(p.capitalize() for p in part.split("_")) for part in name.split("/")))


def instant(text: str | None, year: float | None, zone: str | None, order: str | None) -> int | None:
    """Microseconds since 1970-01-01 UTC that ``text`` denotes, or None.

    ``year`` helps yearless values, ``zone`` those without a zone, and ``order`` (DMY or MDY)
    numeric dates without a leading year; without an order those denote nothing.
    """
    m = NOTATIONS.match(text) if text else None
    if m is None:
        return None
    k = int(m.lastgroup[1:])
    kind, at = _NAMES[k], _GROUPS[k]
    get = lambda name: m[at[name]] if name in at else None
    fraction = int(((get("f") or "") + "000000")[:6])
    if kind == "epoch":
        number, scale = int(get("n")), {13: 1_000, 16: 1_000_000, 19: 1_000_000_000}.get(len(get("n")), 1)
        past = -1 if get("n")[0] == "-" else 1  # only counts of seconds may be negative
        return number // 1000 if scale == 1_000_000_000 else number * (1_000_000 // scale) + (past * fraction if scale == 1 else 0)
    y = get("y")
    if y is not None:
        y = int(y) + (2000 if len(y) == 2 else 0)
    elif year is None or year != year or year != int(year):
        return None
    else:
        y = int(year)
    if "a" in at:
        if order not in ("DMY", "MDY"):
            return None
        d, mo = (int(get("a")), int(get("b"))) if order == "DMY" else (int(get("b")), int(get("a")))
    elif "mn" in at:
        mo, d = MONTHS.get(get("mn").lower().translate(_UNACCENT), 0), int(get("d") or 1)
    else:
        mo, d = int(get("mo") or 1), int(get("d") or 1)
    if not is_day(y, mo, d):
        return None
    h, mi, s, half = int(get("h") or 0), int(get("mi") or 0), int(get("s") or 0), get("ap")
    if half:
        if not 1 <= h <= 12:
            return None
        h = h % 12 + (12 if half in "pP" else 0)
    if h > 23 or mi > 59 or s > 59:
        return None
    seconds = days_from_civil(y, mo, d) * 86400 + h * 3600 + mi * 60 + s
    if offset := get("o"):
        digits = offset[1:].replace(":", "")
        hours, minutes = (int(digits), 0) if len(digits) <= 2 else (int(digits[:-2]), int(digits[-2:]))
        if hours > 18 or minutes > 59:
            return None
        shift = (hours * 60 + minutes) * 60 * (1 if offset[0] == "+" else -1)
    elif get("z"):
        shift = 0
    elif short := get("za"):
        if (hours := ABBREVIATIONS.get(short.upper())) is None:
            return None
        shift = int(hours * 3600)
    else:
        name = get("zn")
        tz = _zone_any_case(name) if name else _zone(zone) if zone else None
        if tz is None:
            return None
        # fold 0: the first of two occurrences; in a skip the offset before it, which moves the time on
        shift = int(datetime(y, mo, d, h, mi, s, tzinfo=tz).utcoffset().total_seconds())
    return (seconds - shift) * 1_000_000 + fraction


def plain_day(column: F.Column) -> F.Column:
    """Whether a text is an existing day written exactly ``yyyy-mm-dd``."""
    written = column.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z") & ~column.startswith("0000")
    return written & F.coalesce(column.try_cast("date").isNotNull(), F.lit(False))


def normalise_instants(df: DataFrame, key: str, fields: list[str], year: str, zone: str, order: str, plain_days: bool = False) -> DataFrame:
    """(key, field_name, utc_us): one row for each value of ``fields`` that denotes a time.

    Values that are plain existing days are left out unless ``plain_days``.  Narrow: the
    fields are stacked, filtered in the JVM, and parsed in Arrow batches.  Null values, null
    helpers and empty tables are fine; ``key`` may repeat or be null.
    """
    fixed = [F.col(key).alias("k"), F.col(year).cast("double").alias("y"), F.col(zone).cast("string").alias("z"), F.col(order).cast("string").alias("o")]
    stacked = df.select(
        *fixed, F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).cast("string").alias("v")) for f in fields])).alias("x")
    ).select("k", "x.f", "x.v", "y", "z", "o")
    src = stacked.where(F.col("v").isNotNull())
    if not plain_days:
        src = src.where(~plain_day(F.col("v")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lru_cache(maxsize=50_000)(instant)
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(2, 6)]
            found = [known(*row) for row in zip(*columns)]
            keep = pa.array(np.flatnonzero([x is not None for x in found]))
            own = batch.take(keep)
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array([x for x in found if x is not None], pa.int64())], names=[key, "field_name", "utc_us"])

    return src.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, field_name string, utc_us bigint")
