import numpy as np

from tidemark.llm.subset import _bin, bits_for, bucket_codes, first_places, varied_subset, with_codes, with_density

SCHEMA = "id long, entry_type string, source_category string, source_name string, embedding array<float>, density int, scope string"
REQ = "request_id long, entry_type string, subset_size long"


def rows():
    rng = np.random.default_rng(0)
    big, small = rng.standard_normal(64), rng.standard_normal((10, 64))
    out = [(i, "feed_item", "politics", "a", (big + 0.05 * rng.standard_normal(64)).tolist()) for i in range(300)]
    out += [(300 + i, "feed_item", ["Sports", " sports", None, "", "law"][i % 5], f"s{i % 7}", small[i % 10].tolist()) for i in range(60)]
    out += [(400 + i, "email", "law", None, e) for i, e in enumerate([None, [], [0.0] * 64, [float("nan")] * 64, [1.0] * 3])]
    return [(*r, 1, "x") for r in out]


def test_sizes_and_coverage(spark):
    e = spark.createDataFrame(rows() + rows()[:40] + [(None, "email", "x", "y", None, 1, "x")], SCHEMA)
    r = spark.createDataFrame([(1, None, 20), (2, "email", 50), (3, "feed_item", 30), (3, "feed_item", 30), (4, "none", 5), (5, None, 0), (6, None, None), (7, None, 10_000), (None, None, 3)], REQ)
    got = {}
    for x in varied_subset(e, r).collect():
        got.setdefault(x.request_id, []).append(x.id)
    assert {k: len(v) for k, v in got.items()} == {1: 20, 2: 5, 3: 30, 7: 365}
    assert all(len(set(v)) == len(v) and None not in v for v in got.values())
    source = {x[0]: x[3] for x in rows()}
    assert len({source[i] for i in got[3]}) == 8  # every source, though one has five sixths of the rows
    assert sum(1 for i in got[3] if i < 300) <= 15
    assert sorted(got[1]) == sorted(x.id for x in varied_subset(e, r).collect() if x.request_id == 1)  # a rerun draws the same


def test_dense_topics_do_not_crowd(spark):
    rng = np.random.default_rng(1)
    topics = rng.standard_normal((10, 64))
    many = [(i, "t", "c", "s", topics[0].tolist(), 1, "x") for i in range(900)] + [(900 + i, "t", "c", "s", topics[1 + i % 9].tolist(), 1, "x") for i in range(90)]
    got = [x.id for x in varied_subset(spark.createDataFrame(many, SCHEMA), spark.createDataFrame([(1, None, 40)], REQ)).collect()]
    assert sum(1 for i in got if i < 900) < 15  # 91 % of the rows, one of ten topics


def test_kinds_in_a_crowded_topic_keep_their_place(spark):
    """Sources that write about one topic only are all in, though other sources offer many fresh topics."""
    rng = np.random.default_rng(2)
    topics = rng.standard_normal((60, 64))
    e = [(i, "t", "c", f"s{i % 10}", topics[0].tolist(), 1, "x") for i in range(100)] + [(100 + i, "t", "c", "wide", topics[i % 60].tolist(), 1, "x") for i in range(600)]
    source = {x[0]: x[3] for x in e}
    got = [x.id for x in varied_subset(spark.createDataFrame(e, SCHEMA), spark.createDataFrame([(1, None, 30)], REQ)).collect()]
    assert len(got) == 30 and {source[i] for i in got} == set(source.values())


def test_empty(spark):
    e, r = spark.createDataFrame(rows(), SCHEMA), spark.createDataFrame([(1, None, 20)], REQ)
    assert varied_subset(e.limit(0), r).count() == 0 and varied_subset(e, r.limit(0)).count() == 0


def test_codes_depend_on_direction_only():
    x = np.random.default_rng(0).standard_normal((5, 64)).astype(np.float32)
    assert (bucket_codes(x) == bucket_codes(x * 7)).all()


def test_inclusion_falls_as_the_inverse_of_the_density(spark):
    """Three topics of 30, 120 and 480 records: a record's chance is inverse to its topic's size, so the topics share the draws."""
    rng = np.random.default_rng(4)
    topic = rng.standard_normal((3, 64))
    of = [0] * 30 + [1] * 120 + [2] * 480
    e = spark.createDataFrame([(i, "t", "c", "s", topic[t].tolist(), 1, "x") for i, t in enumerate(of)], SCHEMA).cache()
    r = spark.createDataFrame([(1, None, 15)], REQ)
    drawn = np.bincount([of[x.id] for seed in range(4) for x in varied_subset(e, r, seed=seed).collect()], minlength=3)
    assert drawn.sum() == 60 and drawn.min() >= 11 and drawn.max() <= 30  # 20 each is expected; by size it would be 3, 11 and 46


def test_many_buckets_are_joined_with_the_same_result(spark):
    e = spark.createDataFrame(rows(), SCHEMA).selectExpr("id", "'*' AS scope", "embedding")
    c = with_codes(e).cache()
    a, b = ({x.id: x.density for x in with_density(c, 365, most).collect()} for most in (1 << 22, 0))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a) and len(a) == 365
    assert bits_for(1 << 17) == 8 and bits_for(1 << 20) == 9 and bits_for(0) == 4


def test_places_by_bins_are_those_of_a_sort(spark):
    df = spark.range(500).selectExpr("id % 3 AS g", "id", "pmod(hash(id), 97) + 1 AS v", "id % 3 * 40 + 5 AS most")
    df = df.withColumn("bin", _bin(df.v, 4))
    got = {(x.g, x.id): x.place for x in first_places(df, ["g"], "bin", ["v", "id"], "most", "place").collect()}
    want = {}
    for g in range(3):
        mine = sorted((x.v, x.id) for x in df.collect() if x.g == g)
        want |= {(g, i): n + 1 for n, (_, i) in enumerate(mine[: g * 40 + 5])}
    assert got == want
