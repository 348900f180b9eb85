"""Sites that hand out entries and labels over HTTP, as a Spark data source and an outbox.

``register(spark)`` adds the format ``tidemark_site``; options: ``url`` (``http(s)://`` or ``file://``, the latter a recorded answer),
``what`` (``entries`` or ``labels``), ``since``, ``limit``, ``key``.
"""

from __future__ import annotations

import json
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_FIELDS = {
    "entries": "entry_type string, entry_id string, title string, description string, content string, link string, author string, published_date string, source_name string, source_category string, source_type string",
    "labels": "entry_type string, entry_id string, label string, reasoning string, labeled_at string",
}


def address(url: str, what: str, since: str | None = None, limit: int | None = None, entry_type: str | None = None) -> str:
    """A request's full address; recorded answers are taken as they are."""
    if url.startswith("file:"):
        return url
    args = {k: v for k, v in (("what", what), ("since", since), ("limit", limit), ("type", entry_type)) if v}
    return f"{url}{'&' if '?' in url else '?'}{urllib.parse.urlencode(args)}"


def full_pull_limit(expected: int) -> int:
    return max(1000, expected + 250)


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(u) for u in self.options["url"].split("|")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        o = self.options
        what = o.get("what", "entries")
        req = urllib.request.Request(address(partition.value, what, o.get("since"), o.get("limit"), o.get("type")))
        if o.get("key"):
            req.add_header("Authorization", f"Bearer {o['key']}")
        with urllib.request.urlopen(req, timeout=float(o.get("timeout", 30))) as r:
            doc = json.loads(r.read().decode("utf-8"))
        names = [f.split()[0] for f in _FIELDS[what].split(", ")]
        for row in doc.get(what) or []:
            if isinstance(row, dict):
                yield tuple(None if row.get(n) is None else str(row[n]) for n in names)


class SiteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidemark_site"

    def schema(self) -> str:
        return _FIELDS[self.options.get("what", "entries")]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SiteSource)


def pull(spark: SparkSession, url: str, what: str, **options: str) -> DataFrame:
    """A site's rows with whole-number ids; rows without one are left out."""
    register(spark)
    df = spark.read.format("tidemark_site").option("url", url).option("what", what).options(**options).load()
    return df.withColumn("entry_id", F.trim("entry_id").try_cast("long")).where("entry_id IS NOT NULL AND entry_type IS NOT NULL")


def paired(url: Column, key: Column) -> Column:
    """Address and key are both given or both missing."""
    return (F.trim(F.coalesce(url, F.lit(""))) == "") == (F.trim(F.coalesce(key, F.lit(""))) == "")


def status_ok(doc: Column) -> Column:
    """Does a status answer report success, in any of its forms?"""
    v = F.try_parse_json(doc)
    get = lambda p, t: F.try_variant_get(v, p, t)
    word = F.lower(F.coalesce(get("$.status", "string"), get("$.data.status", "string"), F.lit("")))
    flag = F.coalesce(get("$.success", "boolean"), get("$.ok", "boolean"), get("$.data.success", "boolean"), F.lit(False))
    return F.coalesce(word.isin("ok", "success", "healthy") | flag, F.lit(False))


def score_payload(scores: DataFrame, explanations: DataFrame, key: list[str]) -> DataFrame:
    """JSON lines of scores with their explanations."""
    j = scores.join(explanations, key, "left")
    return j.select(F.to_json(F.struct(*j.columns)).alias("value"))


def label_payload(labels: DataFrame) -> DataFrame:
    return labels.select(F.to_json(F.struct("entry_type", "entry_id", "label", "reasoning", F.col("updated_at").alias("labeled_at"))).alias("value"))


def to_outbox(payload: DataFrame, path: str) -> None:
    """Append JSON lines to an outbox folder that a sender empties; the write is distributed and atomic by file."""
    payload.write.mode("append").text(path)


def post(payload: DataFrame, url: str, key: str | None = None, batch: int = 500, timeout: float = 30) -> None:
    """Send JSON lines in batches from the executors; a repeated task sends again, receivers upsert by key."""

    def send(rows: Iterator) -> None:
        def flush(buf: list[str]) -> None:
            req = urllib.request.Request(url, data=("[" + ",".join(buf) + "]").encode("utf-8"), headers={"Content-Type": "application/json"})
            if key:
                req.add_header("Authorization", f"Bearer {key}")
            urllib.request.urlopen(req, timeout=timeout).close()

        buf: list[str] = []
        for r in rows:
            buf.append(r["value"])
            if len(buf) >= batch:
                flush(buf)
                buf = []
        if buf:
            flush(buf)

    payload.foreachPartition(send)
