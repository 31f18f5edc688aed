from datetime import date, datetime, timezone

import pytest

from boskage.functions.timestamps import days_from_civil, instant, is_day, normalise_instants


def us(text):
    return round(datetime.fromisoformat(text).replace(tzinfo=timezone.utc).timestamp() * 1_000_000)


@pytest.mark.parametrize(
    ("text", "utc"),
    [
        ("2014-10-22 02:06:56 CET", "2014-10-22 01:06:56"),
        ("2004-06-01 08:57:26 CET", "2004-06-01 07:57:26"),
        ("2006-12-15T09:14:08+0400", "2006-12-15 05:14:08"),
        ("2008-12-20T08:17:16+05:30", "2008-12-20 02:47:16"),
        ("2004-10-20T17:27:13-03", "2004-10-20 20:27:13"),
        ("2008-09-05 20:53:37Z", "2008-09-05 20:53:37"),
        (" 2012-05-01  14:39:05 ", "2012-05-01 12:39:05"),
        ("2006-06-06T14:04:46.937656999Z", "2006-06-06 14:04:46.937656"),
        ("2006-06-06T14:04:46,5Z", "2006-06-06 14:04:46.500000"),
        ("2005-04-28T07:02:05[America/New_York]", "2005-04-28 11:02:05"),
        ("2005-04-28T07:02:05 America/New_York", "2005-04-28 11:02:05"),
        ("2004-05-26 04:37:04 UTC-5", "2004-05-26 09:37:04"),
        ("2004-02-17 21:41:45 GMT+02:00", "2004-02-17 19:41:45"),
        ("2013-03-31 02:30:00", "2013-03-31 01:30:00"),
        ("2013-10-27 02:30:00", "2013-10-27 00:30:00"),
        ("05/06 00:06", "2011-06-04 22:06:00"),
        ("2004", "2003-12-31 23:00:00"),
        ("01/2007", "2006-12-31 23:00:00"),
        ("05-2004", "2004-04-30 22:00:00"),
        ("2006-06", "2006-05-31 22:00:00"),
        ("20040524", "2004-05-23 22:00:00"),
        ("20040524115653", "2004-05-24 09:56:53"),
        ("20040202T011313Z", "2004-02-02 01:13:13"),
        ("1074568450", "2004-01-20 03:14:10"),
        ("1077836356981", "2004-02-26 22:59:16.981000"),
        ("14/06/09", "2009-06-13 22:00:00"),
        ("10.4.2018 01:56", "2018-04-09 23:56:00"),
        ("10 février 2016 à 17h24", "2016-02-10 16:24:00"),
        ("1er fevrier 2014 à 9h01", "2014-02-01 08:01:00"),
        ("13 AOÛT 2020", "2020-08-12 22:00:00"),
        ("11 juillet, 16h10", "2011-07-11 14:10:00"),
        ("02 janv. 2005 19:28", "2005-01-02 18:28:00"),
        ("December 17, 2006 8:18 PM", "2006-12-17 19:18:00"),
        ("Jan 17, 2008 12:05 AM", "2008-01-16 23:05:00"),
        ("04-Jun-2015 07:16:05", "2015-06-04 05:16:05"),
        ("Thu, 05 Feb 2009 14:58:25 -0400", "2009-02-05 18:58:25"),
    ],
)
def test_notations(text, utc):
    assert instant(text, 2011.0, "Europe/Paris", "DMY") == us(utc)


@pytest.mark.parametrize(
    "text",
    [None, "", "?", "n.d.", "NaT", "inconnu", "voir notes", "à préciser", "0000-00-00", "2004-02-30", "31/02/2015", "2010-06-31T08:00:00",
     "2010-06-30T25:00:00", "2010-06-30T10:61:00", "10 brumaire 2004", "12:30", "2010-06-30T10:00:00 XYZ", "2010-06-30T10:00:00[No/Where]"],
)
def test_nothing(text):
    assert instant(text, 2011.0, "Europe/Paris", "DMY") is None


def test_helpers():
    assert instant("03/04/2015", 2011.0, "UTC", "MDY") == us("2015-03-04 00:00:00")
    assert instant("03/04/2015", 2011.0, "UTC", "DMY") == us("2015-04-03 00:00:00")
    assert instant("03/04/2015", None, "UTC", None) is None
    assert instant("03/04 10:00", float("nan"), "UTC", "DMY") is None
    assert instant("2015-04-03 10:00", None, None, None) is None
    assert instant("2015-04-03 10:00Z", None, None, None) == us("2015-04-03 10:00:00")


def test_integer_calendar():
    for y in (1, 1600, 1900, 1970, 2000, 2024, 2100):
        for m in range(1, 13):
            for d in (1, 28, 29, 30, 31):
                try:
                    want = (date(y, m, d) - date(1970, 1, 1)).days
                except ValueError:
                    assert not is_day(y, m, d)
                else:
                    assert is_day(y, m, d) and days_from_civil(y, m, d) == want


def test_operator(spark):
    rows = [
        (1, "2015-04-03", "2015-04-03 10:00", 2015.0, "UTC", "DMY"), (2, "2015-02-30", None, None, None, None),
        (None, "03/04 10:00", "rubbish", float("nan"), "UTC", "DMY"), (3, "1074568450", "2004", 1.0, "UTC", "MDY"), (3, "1074568450", "2004", 1.0, "UTC", "MDY"),
    ]
    df = spark.createDataFrame(rows, "id long, s string, e string, year double, z string, o string").selectExpr("*", "1 as v", "2 as field_name")
    got = sorted(map(tuple, normalise_instants(df, "id", ["s", "e"], "year", "z", "o").collect()))
    assert got == sorted([(1, "e", us("2015-04-03 10:00:00"))] + [(3, "e", us("2004-01-01 00:00:00")), (3, "s", 1074568450000000)] * 2)
    assert normalise_instants(df.limit(0), "id", ["s", "e"], "year", "z", "o").count() == 0
    assert normalise_instants(df, "id", ["s"], "year", "z", "o", plain_days=True).count() == 3


def test_negative_counts_take_their_fraction_along():
    assert instant("-1234567890.5", None, None, None) == -1_234_567_890_500_000
    assert instant("1234567890.5", None, None, None) == 1_234_567_890_500_000
    assert instant("2020-01-01 24:00:00Z", None, None, None) is instant("2020-W05-1", None, None, None) is None
