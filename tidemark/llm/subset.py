"""Choosing a varied subset of given size (problem 1).

Method: the local density of a record is the mean count of the buckets it falls into under ``TABLES``
independent sign-projection hashes of its vector; a fixed-size weighted sample is drawn with
probability inverse to it, by an exponential race (smallest ``-ln(u) / weight`` first, weight = 1 / density, u from a
hash of the key).  The hashes are worked out once, ``DEEP`` bits long, in one pass over the vectors; the counts use the leading
bits, one more for every eightfold number of rows (``bits_for``): as for any density estimate the bandwidth may shrink with a small power of the
rows only, else lone vectors outweigh every topic.  Densities are those among the records a request may choose from (its scope).

Categories and sources enter as strata that correct the draw: a record's probability is

    1 / density * (0.5 / (C * weight of its category) + 0.5 / (S * weight of its source)),

the weights being sums of 1 / density and C and S the numbers of categories and sources, so each category holds half a C-th of the
sample at least and each source half an S-th, and inside both crowded regions count no more than sparse ones.  The draw is
systematic over kinds (category, source): a kind's r-th record in the race has its turn at ``(r - offset) / mass`` with a
random offset, so a kind gets its expected number of places rounded up or down, and exhausted kinds give way; the size is exact.

The first record of every kind whose share is one place or more goes before all this, so each such kind is in the
subset.  Then come the first records of the categories, then of the sources, that have such a share without one of their
kinds having it: the categories always find room, the sources as far as places go.

Scale: the vectors are read once and never shuffled.  Bucket counts are aggregated by Spark and broadcast: a scope has at most
``TABLES * 2**bits`` (6 MB at 10**12 rows), and what is not broadcast for want of that bound is joined.  Ranks within a kind and within a request are counted by bins of the ordering value first and only
ordered inside a bin, so neither a kind nor a request is gathered in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import spread
from tidemark.llm.vectors import unit_rows, usable
from tidemark.session import cut

TABLES = 12
DEEP = 24  # bits a hash has; the counts use the leading ones
#: So many bits at so many rows, one more for each eightfold number.
BITS, AT_ROWS, LEAST_BITS = 8, 1 << 17, 4
#: So many bucket counts (of all scopes together) are broadcast; more are joined.
BROADCAST_BUCKETS = 1 << 22
#: Kinds of more rows are ranked by bins.
BIG_KIND = 1 << 20
BROADCAST_KINDS = 100_000


def _planes(dim: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, TABLES * DEEP)).astype(np.float32)


def bucket_codes(x: np.ndarray, seed: int = 7) -> np.ndarray:
    """Bucket numbers of ``DEEP`` bits, rows x ``TABLES``; the table's number stands above them."""
    bits = (x @ _planes(x.shape[1], seed) > 0).reshape(len(x), TABLES, DEEP)
    return bits.astype(np.int64) @ (1 << np.arange(DEEP - 1, -1, -1, dtype=np.int64)) + (np.arange(TABLES, dtype=np.int64) << DEEP)


def bits_for(rows: int) -> int:
    """Leading bits to count by."""
    return int(min(DEEP, max(LEAST_BITS, round(BITS + np.log2(max(1, rows) / AT_ROWS) / 3))))


def with_codes(df: DataFrame, embedding: str = "embedding", dim: int = 64) -> DataFrame:
    """``df`` without its vector, with ``codes`` (array of long): one bucket a table, or ``[-1]`` without a usable vector."""
    rest = [c for c in df.columns if c != embedding]
    cols = spread(df.select(*rest, F.when(usable(embedding, dim), F.col(embedding)).alias("__e")))
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest) + ", codes array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e = b.column(len(rest))
            have = e.is_valid().to_numpy(zero_copy_only=False)
            n = np.where(have, TABLES, 1)
            flat = np.full(int(n.sum()), -1, np.int64)
            if have.any():
                flat[np.repeat(have, n)] = bucket_codes(unit_rows(e.drop_null(), dim)).ravel()
            codes = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(rest))), codes], names=[*rest, "codes"])

    return cols.mapInArrow(run, schema)


def with_density(df: DataFrame, rows: int, most: int = BROADCAST_BUCKETS) -> DataFrame:
    """``df`` (unique by ``scope, id``, with ``codes``; ``rows`` in all) with ``density`` (double) instead of the codes: the mean number of
    records of the scope in a record's buckets.  Records without a usable vector form one bucket: their density is their number."""
    spark = df.sparkSession
    drop = DEEP - bits_for(rows)
    short = df.withColumn("codes", F.transform("codes", lambda c: F.when(c < 0, c).otherwise(F.shiftright(c, drop))))
    counts = cut(short.select("scope", F.explode("codes").alias("code")).groupBy("scope", "code").agg(F.count("*").alias("n")))
    rest = [c for c in df.columns if c != "codes"]
    if counts.count() > most:
        # many scopes: a bucket's rows are the codes of one scope, summed up by record without any table in memory
        n = short.select("scope", "id", F.explode("codes").alias("code")).join(counts, ["scope", "code"]).groupBy("scope", "id").agg(F.avg("n").alias("density"))
        return df.select(*rest).join(n, ["scope", "id"])
    t = counts.toArrow()
    scope, code, n = np.array(t["scope"].to_pylist(), object), t["code"].to_numpy(), t["n"].to_numpy()
    known = {}
    for s in set(scope):
        mine = np.flatnonzero(scope == s)
        mine = mine[np.argsort(code[mine])]
        known[s] = (code[mine], n[mine])
    table = spark.sparkContext.broadcast(known)
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = b.column(b.schema.get_field_index("codes"))
            size = np.diff(codes.offsets.to_numpy())
            owner, flat = np.repeat(np.arange(b.num_rows), size), codes.flatten().to_numpy()
            found = np.zeros(len(flat))
            names = b.column(b.schema.get_field_index("scope")).dictionary_encode()
            of = names.indices.to_numpy()[owner]
            for i, s in enumerate(names.dictionary.to_pylist()):
                at = np.flatnonzero(of == i)
                have, many = table.value[s]
                found[at] = many[np.searchsorted(have, flat[at])]
            density = np.bincount(owner, weights=found, minlength=b.num_rows) / np.maximum(size, 1)
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in rest), pa.array(density)], names=[*rest, "density"])

    return short.mapInArrow(run, f"{schema}, density double")


def _bin(value: Column, steps: int) -> Column:
    """Number of the bin of a positive value, ``steps`` to a doubling."""
    return F.floor(F.log2(F.greatest(value, F.lit(1e-300))) * steps).cast("int")


def first_places(df: DataFrame, keys: list[str], bin_: str, order: list[str], most: str, name: str) -> DataFrame:
    """The rows of ``df`` that are among the first ``most`` (a column) of their group, with their place as ``name``.

    Groups are ordered by ``bin_``, which must rise with ``order``: bins are counted, and only those that can hold one of the first are ordered.
    """
    counts = df.groupBy(*keys, bin_).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy(bin_)) - F.col("__n")
    counts = counts.select(*[F.col(k).alias(f"__{k}") for k in [*keys, bin_]], before.alias("__before"))
    j = df.join(counts, [F.col(k) == F.col(f"__{k}") for k in [*keys, bin_]]).drop(*[f"__{k}" for k in [*keys, bin_]]).where(F.col("__before") < F.col(most))
    place = F.col("__before") + F.row_number().over(Window.partitionBy(*keys, bin_).orderBy(*order))
    return j.withColumn(name, place).where(F.col(name) <= F.col(most)).drop("__before")


def varied_subset(entries: DataFrame, requests: DataFrame, dim: int = 64, seed: int = 11) -> DataFrame:
    """``(request_id, id)``: for each request that many different entries of its type (null: of any type), or all of them.

    Repeated rows of an entry count once; entries with a null id and requests without a positive size give
    nothing.  Categories are compared trimmed and in lower case, blank ones as null; null sources are a
    source.  The draw depends on the ids and ``seed`` only.
    """
    category = F.lower(F.trim(F.coalesce(F.col("source_category"), F.lit(""))))
    e = entries.select(
        F.col("id").cast("long").alias("id"), "entry_type", category.alias("category"), F.coalesce("source_name", F.lit("")).alias("source"), "embedding"
    ).where("id IS NOT NULL")
    wanted = requests.where("request_id IS NOT NULL AND subset_size > 0").dropDuplicates(["request_id"])
    wanted = cut(wanted.select("request_id", F.coalesce("entry_type", F.lit("*")).alias("scope"), F.col("subset_size").cast("long").alias("subset_size")))
    scopes = wanted.groupBy("scope").agg(F.max("subset_size").alias("most"))

    # Narrow rows from here on: the vectors are read once.
    once = cut(with_codes(e, "embedding", dim).dropDuplicates(["id"]))
    scoped = once.withColumn("scope", F.explode(F.array("entry_type", F.lit("*")))).join(scopes, "scope").drop("entry_type")
    u = (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    race = cut(with_density(scoped, once.count()).withColumn("race", -F.log(u) * F.col("density")))

    kinds = cut(race.groupBy("scope", "category", "source").agg(F.count("*").alias("n"), F.sum(1 / F.col("density")).alias("w")))
    wc, ws = (F.sum("w").over(Window.partitionBy("scope", c)) for c in ("category", "source"))
    number = kinds.groupBy("scope").agg(F.countDistinct("category").alias("c"), F.countDistinct("source").alias("s"))
    mass = F.col("w") * (0.5 / (F.col("c") * F.col("wc")) + 0.5 / (F.col("s") * F.col("ws")))
    offset = (F.pmod(F.xxhash64("scope", "category", "source", F.lit(seed)), F.lit(1 << 20)) + 0.5) / float(1 << 20)
    sizes = kinds.select("*", wc.alias("wc"), ws.alias("ws")).join(number, "scope").select("scope", "category", "source", "n", mass.alias("mass"), offset.alias("offset"))
    if kinds.count() <= BROADCAST_KINDS:
        sizes = F.broadcast(sizes)

    sized = race.join(sizes, ["scope", "category", "source"]).select("scope", "category", "source", "id", "race", "most", "mass", "offset", F.when(F.col("n") > BIG_KIND, _bin(F.col("race"), 64)).otherwise(0).alias("bin"))
    ranked = first_places(sized, ["scope", "category", "source"], "bin", ["race", "id"], "most", "rank")
    turn = cut(ranked.select("scope", "id", ((F.col("rank") - F.col("offset")) / F.col("mass")).alias("turn"), "category", "source", "rank", "mass"))
    first = turn.where("rank = 1")
    for c in ("category", "source"):
        whole = Window.partitionBy("scope", c)
        first = first.withColumns({f"{c}_first": F.row_number().over(whole.orderBy("turn", "id")), f"{c}_mass": F.sum("mass").over(whole), f"{c}_most": F.max("mass").over(whole)})
    turn = first.drop("category", "source", "rank").unionByName(turn.where("rank > 1").drop("category", "source", "rank"), allowMissingColumns=True)
    place = lambda mass: F.col(mass) * F.col("subset_size") >= 1 - 1e-9
    ahead = F.when(F.col("category_first").isNotNull() & place("mass"), 0)
    for i, c in enumerate(("category", "source")):
        ahead = ahead.when((F.col(f"{c}_first") == 1) & place(f"{c}_mass") & ~place(f"{c}_most"), i + 1)
    asked = turn.join(wanted, "scope").withColumn("ahead", ahead.otherwise(3))
    asked = asked.withColumn("bin", F.when(F.col("ahead") < 3, F.col("ahead") - 100_000).otherwise(_bin(F.col("turn"), 256)))
    return first_places(asked, ["request_id"], "bin", ["ahead", "turn", "id"], "subset_size", "place").select("request_id", "id")
