import random
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.packing import differencing, fill, pack, pack_documents


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60), st.integers(1, 9))
def test_differencing_is_a_partition(sizes, k):
    g = differencing(sizes, k)
    assert sorted(i for x in g for i in x) == list(range(len(sizes))) and len(g) <= max(k, 0) or not sizes


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_fill_keeps_the_capacity(sizes):
    g = fill(sizes, 64)
    assert sorted(i for x in g for i in x) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in x) <= 64 for x in g)


def test_fill_places_every_item_once_where_containers_overflow():
    """Two or three items a container, where differencing cannot meet the capacity at the least count."""
    rng = random.Random(2)
    for _ in range(5):
        sizes = [min(511, max(1, int(rng.lognormvariate(5, 0.9)))) for _ in range(600)]
        g = fill(sizes, 512)
        assert sorted(i for x in g for i in x) == list(range(600)) and max(sum(sizes[i] for i in x) for x in g) <= 512
        assert len(g) <= 1.08 * -(-sum(sizes) // 512)


def test_differencing_balances():
    sums = [sum([8, 7, 6, 5, 4][i] for i in g) for g in differencing([8, 7, 6, 5, 4], 2)]
    assert max(sums) - min(sums) <= 2


def check(rows, sizes, capacity):
    load, parts = defaultdict(int), defaultdict(list)
    for r in rows:
        assert 0 <= r.token_from < r.token_to
        load[r.container] += r.token_to - r.token_from
        parts[r.doc_id].append((r.token_from, r.token_to))
    assert max(load.values()) <= capacity
    for k, n in sizes.items():
        p = sorted(parts.get(k, []))
        assert [a for a, _ in p] == [0, *[z for _, z in p[:-1]]][: len(p)] and (p[-1][1] if p else 0) == n
        if n <= capacity:
            assert len(p) <= 1  # only what is longer than the capacity is divided
    return sum(load.values()) / (len(load) * capacity)


def test_frame(spark):
    sizes = {1: 5, 2: 64, 3: 200, 4: 0, 5: 60, 6: 1} | {i: 1 + i * 7 % 60 for i in range(10, 400)}
    rows = [(1, 64, k, n, "x") for k, n in sizes.items()] + [(2, 1000, k, n, "x") for k, n in sizes.items()] + [(1, 64, 999, None, "x"), (3, 0, 1, 5, "x")]
    df = spark.createDataFrame(rows, "spec_id long, capacity long, doc_id long, n_tokens long, window string")
    out = pack(df).collect()
    assert check([r for r in out if r.spec_id == 1], sizes, 64) > 0.97
    assert check([r for r in out if r.spec_id == 2], sizes, 1000) > 0.9
    assert not [r for r in out if r.spec_id == 3 or r.doc_id in (4, 999)]
    assert pack(df.limit(0)).collect() == []


def test_whole_table(spark, data):
    docs, specs = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/pack_spec.parquet")
    out = pack_documents(docs, specs)
    with_text = docs.where("length(text) > 0").count()
    for s in specs.collect():
        mine = out.where(f"spec_id = {s.spec_id}")
        assert mine.select("doc_id").distinct().count() == with_text
        once = mine.groupBy("doc_id").agg({"token_to": "max", "token_from": "min"}).join(mine.selectExpr("doc_id", "token_to - token_from AS n").groupBy("doc_id").sum("n"), "doc_id")
        assert once.where("`max(token_to)` != `sum(n)` OR `min(token_from)` != 0").count() == 0  # every token once
        assert mine.selectExpr("container", "token_to - token_from AS n").groupBy("container").sum("n").agg({"sum(n)": "max"}).first()[0] <= s.capacity
    assert pack_documents(docs.limit(0), specs).count() == 0 and pack_documents(docs, specs.limit(0)).count() == 0
