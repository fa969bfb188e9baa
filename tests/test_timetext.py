from __future__ import annotations

from datetime import datetime, timezone

import pytest

from aforetime.functions.timetext import instants, zone_version


def read(text, zone=None, locale=None):
    return instants([text], [zone], [locale], zone_version())[0]


def us(*parts, micro=0):
    return int(datetime(*parts, tzinfo=timezone.utc).timestamp()) * 1_000_000 + micro


@pytest.mark.parametrize(
    ("text", "zone", "locale", "wanted"),
    [
        ("2003-07-09T13:30:01+05:30", "Asia/Kolkata", "en-GB", us(2003, 7, 9, 8, 0, 1)),
        ("25 Sep 2003 10:00:01 CEST", "America/New_York", "de-DE", us(2003, 9, 25, 8, 0, 1)),
        ("Tue, 16 Sep 2003 10:00:01 +0200", None, None, us(2003, 9, 16, 8, 0, 1)),
        ("14. März 2003 10:00 Uhr", "Europe/Berlin", "de-DE", us(2003, 3, 14, 9)),
        ("28 October 2003, 09:00", "Europe/London", "en-GB", us(2003, 10, 28, 9)),
        ("7/8/2003 4:00:01 PM", "America/New_York", "en-US", us(2003, 7, 8, 20, 0, 1)),
        ("7/8/2003 04:00:01", "UTC", "en-GB", us(2003, 8, 7, 4, 0, 1)),
        ("12/27/2016 12:00:01 AM", "UTC", "en-US", us(2016, 12, 27, 0, 0, 1)),
        ("Feb 25, 2004 03:00 AM", "America/Chicago", "en-US", us(2004, 2, 25, 9)),
        ("30-Jan-2004 09:00", "Europe/London", "en-GB", us(2004, 1, 30, 9)),
        ("21.12.03 03:00", "America/Chicago", "de-DE", us(2003, 12, 21, 9)),
        ("2004-01-26T18:00:01+09:00[Asia/Tokyo]", "Europe/Helsinki", None, us(2004, 1, 26, 9, 0, 1)),
        ("2004-04-08T08:00:01.123456789Z ", None, None, us(2004, 4, 8, 8, 0, 1, micro=123456)),
        ("2012-06-16T17:00:01,427+09:00", None, None, us(2012, 6, 16, 8, 0, 1, micro=427000)),
        ("1064649601.250", None, None, 1064649601_250000),
        ("1064649601", "Asia/Tokyo", None, 1064649601_000000),
        ("1064649601123", None, None, 1064649601_123000),
        ("1201770001531168", None, None, 1201770001531168),
        ("20050612030001", "Europe/Berlin", None, us(2005, 6, 12, 1, 0, 1)),
        ("20031116T090001Z", "Asia/Tokyo", None, us(2003, 11, 16, 9, 0, 1)),
        ("2009-10-25", "America/New_York", None, us(2009, 10, 25, 4)),
        ("2009-03-29 02:30", "Europe/Berlin", None, us(2009, 3, 29, 1, 30)),  # skipped: offset before the change
        ("2009-10-25 02:30", "Europe/Berlin", None, us(2009, 10, 25, 0, 30)),  # twice: the first one
        ("2009-10-25 03:00", "Europe/Berlin", None, us(2009, 10, 25, 2)),
    ],
)
def test_real_instants(text, zone, locale, wanted):
    assert read(text, zone, locale) == wanted


@pytest.mark.parametrize(
    "text",
    [None, "", "  ", "n/a", "-", "pending", "T10:00:01", "0000-00-00 00:00:00", "0001-01-01T00:00:00+00:00", "x" * 5000,
     "9999-12-31T23:59:59Z", "2011-02-30T10:00:00Z", "2009-13-04 09:00:00", "31.04.2012 08:15:00", "123456789", "2009-01-01 24:00"],
)
def test_no_instants(text):
    assert read(text, "Europe/Berlin", "de-DE") is None


def test_unknown_zone_only_matters_for_local_times():
    assert read("2009-01-01 10:00", "Nowhere/Land") is None
    assert read("2009-01-01T10:00:00Z", "Nowhere/Land") == us(2009, 1, 1, 10)
