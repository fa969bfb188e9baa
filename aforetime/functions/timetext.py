"""Times written as text in many formats, precisions and zones, read as one UTC instant.

Every text is reduced to its shape mask (digits to 9, letters to a). A mask is
compiled once into a parser, that is, the character positions of its fields;
all texts of one mask are then read together as character matrices. Local
times are converted through zone transition tables with one binary search.

Defined results
---------------
* Null, blank, placeholder (years 0, 1 and 9999) and impossible texts give null.
* An offset in the text holds before a zone, a zone before `clock_zone`; a null
  or blank `clock_zone` means UTC, an unknown one gives null for local times.
* The locale decides day and month order of slashed and dashed dates (en-US
  month first, all others day first); dotted dates are day first. Month names
  are read in English and German whatever the locale.
* Two-digit years are 20xx; digits finer than microseconds are cut.
* A local time that occurs twice is the first occurrence; a skipped one is
  read with the offset before the change.
"""

from __future__ import annotations

import re
import zoneinfo
from datetime import datetime, timedelta, timezone
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names in English and German.
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8,
    "september": 9, "october": 10, "november": 11, "december": 12,
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dec": 12,
    "januar": 1, "jänner": 1, "februar": 2, "märz": 3, "mrz": 3, "mär": 3, "mai": 5, "juni": 6, "juli": 7,
    "oktober": 10, "okt": 10, "dezember": 12, "dez": 12,
}
# Zone abbreviations, minutes east of UTC.
ABBREVIATIONS = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "mez": 60, "mesz": 120,
    "eet": 120, "eest": 180, "msk": 180, "ist": 330, "jst": 540, "est": -300, "edt": -240, "cst": -360, "cdt": -300,
    "mst": -420, "mdt": -360, "pst": -480, "pdt": -420,
}
HALVES = {"am": 0, "pm": 12}
IDLE_WORDS = {"uhr", "h"}
PLACEHOLDER_YEARS = (0, 1, 9999)

_MASK = re.compile(
    r"(?:(?:a+\.?,? )?"
    r"(?:(?P<y>9999)(?P<sep>[-/.])(?P<m>99?)(?P=sep)(?P<d>99?)"
    r"|(?P<cy>9999)(?P<cm>99)(?P<cd>99)(?=a999999)"
    r"|(?P<nd>99?)\.?[ -](?P<nm>a{3,})\.?[ -](?P<ny>9999|99)"
    r"|(?P<mm>a{3,})\.? (?P<md>99?),? (?P<my>9999)"
    r"|(?P<s1>99?)(?P<osep>[-/.])(?P<s2>99?)(?P=osep)(?P<sy>9999|99)))"
    r"(?:(?P<tsep>,? |a)(?:(?P<H>99?):(?P<M>99)(?::(?P<S>99)(?:[.,](?P<f>9+))?)?|(?P<cH>99)(?P<cM>99)(?P<cS>99)(?:[.,](?P<cf>9+))?)"
    r"(?: ?(?P<w1>a+))?(?: (?P<w2>a+))?"
    r"(?: ?(?P<sign>[+-])(?P<oh>99)(?::?(?P<om>99))?)?"
    r"(?P<zone>\[[^\]]+\])?)?"
)
_FIRST, _LAST = datetime(1900, 1, 1, tzinfo=timezone.utc), datetime(2100, 1, 1, tzinfo=timezone.utc)


class _Letters(dict):
    """translate() table: any letter to a, any decimal digit 0–9 to 9, all else as it is."""

    def __missing__(self, code: int) -> int:
        char = chr(code)
        self[code] = to = 97 if char.isalpha() else 57 if "0" <= char <= "9" else code
        return to


_SHAPES = _Letters()


def mask_of(text: str) -> str:
    return text.translate(_SHAPES)


@lru_cache(maxsize=4096)
def _compiled(mask: str) -> dict[str, slice] | None:
    """Field positions of a mask; None for a shape that is no time."""
    found = _MASK.fullmatch(mask)
    return {k: slice(*found.span(k)) for k, v in found.groupdict().items() if v is not None} if found else None


def zone_version() -> str:
    """Version of the zone data that the tables are built from."""
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:
        return "system"


@lru_cache(maxsize=2048)
def zone_table(name: str, version: str) -> tuple[np.ndarray, np.ndarray] | None:
    """(local second from which an offset holds, offset in seconds) of a zone; None if it is unknown.

    At a change both the skipped and the repeated local times belong to the
    offset before it, so the new one begins at change + max(old, new).
    """
    try:
        zone = zoneinfo.ZoneInfo(name)
    except (zoneinfo.ZoneInfoNotFoundError, ValueError, OSError):
        return None

    def offset(moment: datetime) -> int:
        return int(moment.astimezone(zone).utcoffset().total_seconds())

    starts, offsets = [-(2**62)], [offset(_FIRST)]
    moment, step = _FIRST, timedelta(days=5)
    while moment < _LAST:
        if (new := offset(moment + step)) != offsets[-1]:
            low, high = moment, moment + step
            while high - low > timedelta(seconds=1):
                middle = low + timedelta(seconds=int((high - low).total_seconds()) // 2)
                low, high = (low, middle) if offset(middle) != offsets[-1] else (middle, high)
            starts.append(int(high.timestamp()) + max(offsets[-1], new))
            offsets.append(new)
        moment += step
    return np.array(starts), np.array(offsets)


def _digits(chars: np.ndarray, where: slice) -> np.ndarray:
    block = chars[:, where].astype(np.int64) - 48
    return block @ (10 ** np.arange(block.shape[1] - 1, -1, -1, dtype=np.int64))


def _words(chars: np.ndarray, where: slice, known: dict[str, int]) -> np.ndarray:
    """Values of a letter field, -9999 where it is unknown."""
    block = np.ascontiguousarray(chars[:, where])
    words = block.view(f"U{block.shape[1]}").ravel()
    distinct, inverse = np.unique(words, return_inverse=True)
    return np.array([known.get(str(w).casefold(), -9999) for w in distinct])[inverse]


def _read_mask(
    texts: list[str], fields: dict[str, slice], month_first: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str] | None]:
    """(local microseconds, ok, offset seconds or -2**40 where none, bracketed zone) of texts of one mask."""
    n, width = len(texts), len(texts[0])
    chars = np.array(texts, dtype=f"U{width}").view(np.uint32).reshape(n, width)

    def get(*names: str) -> np.ndarray | None:
        return next((_digits(chars, fields[x]) for x in names if x in fields), None)

    ok = np.ones(n, bool)
    year = get("y", "cy", "ny", "my", "sy")
    short = next(x for x in ("y", "cy", "ny", "my", "sy") if x in fields)
    if fields[short].stop - fields[short].start == 2:
        year = year + 2000
    if "s1" in fields:
        first, second = get("s1"), get("s2")
        dotted = chars[:, fields["osep"].start] == ord(".")
        swap = month_first & ~dotted
        day, month = np.where(swap, second, first), np.where(swap, first, second)
    else:
        day = get("d", "cd", "nd", "md")
        month = get("m", "cm")
        if month is None:
            month = _words(chars, fields.get("nm") or fields["mm"], MONTHS)
    if "tsep" in fields and fields["tsep"].stop - fields["tsep"].start == 1:
        mark = chars[:, fields["tsep"].start]
        ok &= (mark == 32) | (mark == ord("T")) | (mark == ord("t"))
    zero = np.zeros(n, np.int64)
    hour, minute, second = (x if x is not None else zero for x in (get("H", "cH"), get("M", "cM"), get("S", "cS")))
    micros = zero
    if part := fields.get("f") or fields.get("cf"):
        length = min(6, part.stop - part.start)
        micros = _digits(chars, slice(part.start, part.start + length)) * 10 ** (6 - length)
    offset = np.full(n, -(2**40))
    for field in ("w1", "w2"):
        if field not in fields:
            continue
        half = _words(chars, fields[field], HALVES)
        idle = _words(chars, fields[field], dict.fromkeys(IDLE_WORDS, 1)) == 1
        abbreviation = _words(chars, fields[field], ABBREVIATIONS)
        has_half = half >= 0
        ok &= (has_half | idle | (abbreviation > -9999)) & ~(has_half & ((hour > 12) | (hour < 1)))
        hour = np.where(has_half, hour % 12 + np.maximum(half, 0), hour)
        offset = np.where(~has_half & ~idle & (abbreviation > -9999), abbreviation * 60, offset)
    if "sign" in fields:
        oh, om = get("oh"), get("om")
        om = zero if om is None else om
        sign = np.where(chars[:, fields["sign"].start] == ord("-"), -1, 1)
        ok &= (oh <= 14) & (om < 60)
        offset = sign * (oh * 3600 + om * 60)
    ok &= (month >= 1) & (month <= 12) & (hour < 24) & (minute < 60) & (second < 60) & (day >= 1)
    ok &= ~np.isin(year, PLACEHOLDER_YEARS)
    months = np.where(ok, (year - 1970) * 12 + month - 1, 0)
    begin = months.astype("M8[M]").astype("M8[D]").astype(np.int64)
    after = (months + 1).astype("M8[M]").astype("M8[D]").astype(np.int64)
    ok &= day <= after - begin
    local = ((begin + day - 1) * 86400 + hour * 3600 + minute * 60 + second) * 1_000_000 + micros
    zones = [t[fields["zone"].start + 1 : -1] for t in texts] if "zone" in fields else None
    return local, ok, offset, zones


def _epoch(text: str) -> int | None:
    whole, _, part = text.partition(".")
    scale = {10: 1_000_000, 13: 1000, 16: 1}.get(len(whole))
    if scale is None or (part and len(whole) != 10):
        return None
    return int(whole) * scale + (int(part[:6].ljust(6, "0")) if part else 0)


def instants(
    texts: list[str | None], clock_zones: list[str | None], locales: list[str | None], version: str
) -> list[int | None]:
    """Microseconds since 1970 of each text, None where it names no real instant."""
    out: list[int | None] = [None] * len(texts)
    by_mask: dict[str, list[int]] = {}
    bare = [(t or "").strip() for t in texts]
    for i, t in enumerate(bare):
        if t:
            by_mask.setdefault(mask_of(t), []).append(i)
    for mask, at in by_mask.items():
        if re.fullmatch(r"9{10,}(\.9+)?", mask):
            if mask != "9" * 14:
                for i in at:
                    out[i] = _epoch(bare[i])
                continue
            group = [f"{t[:8]}T{t[8:]}" for t in (bare[i] for i in at)]
            fields = _compiled("99999999a999999")
        else:
            group, fields = [bare[i] for i in at], _compiled(mask)
        if fields is None:
            continue
        month_first = np.array([(locales[i] or "").strip().lower().replace("_", "-") == "en-us" for i in at])
        local, ok, offset, named = _read_mask(group, fields, month_first)
        bound = offset > -(2**40)
        zones = np.array([(named[k] if named else clock_zones[i]) or "" for k, i in enumerate(at)], dtype=object)
        for zone in set(zones[~bound & ok]):
            table = zone_table(zone.strip() or "UTC", version)
            mine = ~bound & (zones == zone)
            if table is None:
                ok &= ~mine
                continue
            starts, offsets = table
            offset = np.where(mine, offsets[np.searchsorted(starts, local // 1_000_000, side="right") - 1], offset)
        utc = local - offset * 1_000_000
        for k in np.flatnonzero(ok):
            out[at[k]] = int(utc[k])
    return out


def instant_us(text: Column, clock_zone: Column, locale: Column) -> Column:
    """UTC microseconds since 1970 of a time text as a bigint Column.

    The zone tables' version is fixed on the driver; a worker with other zone
    data fails instead of giving other instants.
    """
    version = zone_version()

    def read(texts: pd.Series, zones: pd.Series, tags: pd.Series) -> pd.Series:
        if zone_version() != version:
            raise RuntimeError(f"zone data {zone_version()} here, {version} on the driver")
        lists = ([None if x is None or x != x else x for x in s.tolist()] for s in (texts, zones, tags))
        return pd.Series(pd.array(instants(*lists, version), dtype="Int64"))

    # marked so that a filter on the result doesn't make Spark parse every text twice
    return F.pandas_udf(read, "bigint").asNondeterministic()(text, clock_zone, locale)
