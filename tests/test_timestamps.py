"""The cascade against a plain implementation with datetime and zoneinfo."""

import datetime as dt
import zoneinfo

import pytest
from pyspark.sql import types as T

from tidemark.functions.timestamps import entry_instants, normalise_timestamps

UTC = dt.timezone.utc


def us(y, mo, d, h=0, mi=0, s=0, micro=0, minutes=0):
    t = dt.datetime(y, mo, d, h, mi, s, micro, tzinfo=UTC) - dt.timedelta(minutes=minutes)
    return round((t - dt.datetime(1970, 1, 1, tzinfo=UTC)) / dt.timedelta(microseconds=1))


def local(tz, y, mo, d, h=0, mi=0, s=0):
    z = zoneinfo.ZoneInfo(tz)
    t = dt.datetime(y, mo, d, h, mi, s, tzinfo=z, fold=0)
    return round((t - dt.datetime(1970, 1, 1, tzinfo=UTC)) / dt.timedelta(microseconds=1))


Z, NY = "Europe/Zurich", "America/New_York"
CASES = [
    ("2024-01-02T22:12:14Z", None, None, us(2024, 1, 2, 22, 12, 14)),
    ("2022-09-02T01:31:17.657308999-07:00", None, None, us(2022, 9, 2, 1, 31, 17, 657308, -420)),
    ("2022-08-18T20:37:10+0545", None, None, us(2022, 8, 18, 20, 37, 10, 0, 345)),
    ("2022-04-20T18:14:42-05", None, None, us(2022, 4, 20, 18, 14, 42, 0, -300)),
    ("2022-07-04 19:32:50 CET", NY, True, us(2022, 7, 4, 19, 32, 50, 0, 60)),  # a fixed offset, in summer too
    ("2022-03-01 15:34:02 Europe/London", Z, True, us(2022, 3, 1, 15, 34, 2)),
    ("2022-10-30T01:56:19[Europe/Zurich]", None, None, local(Z, 2022, 10, 30, 1, 56, 19)),
    ("2022-10-30 02:30:00", Z, True, us(2022, 10, 30, 0, 30)),  # twice: the earlier
    ("2022-03-27 02:30:00", Z, True, us(2022, 3, 27, 1, 30)),  # skipped: 03:30 summer time
    ("Tue, 31 May 2022 22:21:50 +1000", None, None, us(2022, 5, 31, 22, 21, 50, 0, 600)),
    ("Tue Mar  8 01:06:02 2022", NY, True, local(NY, 2022, 3, 8, 1, 6, 2)),
    ("31 Mar 2022 10:42 +0000", None, None, us(2022, 3, 31, 10, 42)),
    ("05.09.2022 12:20", Z, None, local(Z, 2022, 9, 5, 12, 20)),
    ("20.06.22 12:50", Z, False, local(Z, 2022, 6, 20, 12, 50)),
    ("9.7.2022, 08:55 Uhr", Z, True, local(Z, 2022, 7, 9, 8, 55)),
    ("5/10/2025 02:56", NY, False, local(NY, 2025, 5, 10, 2, 56)),
    ("5/10/2025 02:56", NY, True, local(NY, 2025, 10, 5, 2, 56)),
    ("19/04/2022 12:39 AM", NY, True, local(NY, 2022, 4, 19, 0, 39)),
    ("May 22, 2022 4:36 PM", Z, True, local(Z, 2022, 5, 22, 16, 36)),
    ("22. März 2022, 05:01 Uhr", Z, True, local(Z, 2022, 3, 22, 5, 1)),
    ("1er octobre 2022 à 09h58", Z, True, local(Z, 2022, 10, 1, 9, 58)),
    ("15 de junio de 2023, 02:59 h", Z, True, local(Z, 2023, 6, 15, 2, 59)),
    ("20 luglio 2022, ore 03:15", Z, True, local(Z, 2022, 7, 20, 3, 15)),
    ("2022-W22-2T06:07", "UTC", True, us(2022, 5, 31, 6, 7)),
    ("2020-W53-5", "UTC", True, us(2021, 1, 1)),
    ("2022-366", "UTC", True, None),
    ("2024-366", "UTC", True, us(2024, 12, 31)),
    ("20220522T041638Z", None, None, us(2022, 5, 22, 4, 16, 38)),
    ("1665473869", None, None, 1665473869000000),
    ("1669262972525", None, None, 1669262972525000),
    ("1672111541003018", None, None, 1672111541003018),
    ("1649606375.890", None, None, 1649606375890000),
    (" \t2022-09-21 \t", "UTC", True, us(2022, 9, 21)),
    ("2022-09-21", None, None, None),
    ("2023-02-29", "UTC", True, None),
    ("31.04.2023", "UTC", True, None),
    ("2022-13-01", "UTC", True, None),
    ("2022-01-01 24:00", "UTC", True, None),
    ("13:00 PM", "UTC", True, None),
    ("3/4/2022", None, None, None),
    ("2022-06-", "UTC", True, None),
    ("2022-01-01 10:00 Mars/Base", "UTC", True, None),
    ("gestern", "UTC", True, None),
    ("", "UTC", True, None),
    (None, "UTC", True, None),
    ("9" * 5000, "UTC", True, None),
]


def test_every_notation(spark):
    schema = T.StructType([T.StructField("i", T.LongType()), T.StructField("value", T.StringType()), T.StructField("tz", T.StringType()), T.StructField("day_first", T.BooleanType()), T.StructField("__ts", T.LongType())])
    df = spark.createDataFrame([(i, v, z, f, 5) for i, (v, z, f, _) in enumerate(CASES)], schema)
    out = {r.i: r for r in normalise_timestamps(df, "value", "tz", "day_first").collect()}
    assert all(r["__ts"] == 5 for r in out.values())  # a clashing column passes through
    wrong = [(CASES[i][0], r.utc_us, CASES[i][3]) for i, r in out.items() if r.utc_us != CASES[i][3]]
    assert not wrong


def test_entries(spark):
    e = spark.createDataFrame([(1, "2022-09-21", "a"), (1, "2022-09-21", "a"), (2, "2022-09-21", None), (3, None, "a"), (None, "2022-09-21", "a"), (4, "1", None)], "id long, published_date string, source_name string")
    f = spark.createDataFrame([("a", Z, True, 1), (None, Z, True, 1)], "source_name string, home_tz string, day_first boolean, id int")
    assert sorted(map(tuple, entry_instants(e, f).collect())) == [(1, local(Z, 2022, 9, 21)), (4, 1_000_000)]
    assert entry_instants(e.where("id > 9"), f).count() == 0


@pytest.mark.parametrize("column", ["published_date"])
def test_whole_table(spark, data, column):
    n = entry_instants(spark.read.parquet(f"{data}/entries.parquet"), spark.read.parquet(f"{data}/feeds.parquet"))
    assert n.count() > 80 and n.select("id").distinct().count() == n.count()
