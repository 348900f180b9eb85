"""Filling fixed-capacity containers (problem 7).

Method: Karmarkar-Karp multiway differencing.  Items are spread by a hash of their key over windows of
about ``window_bins`` containers' worth of tokens; each window is split into k near-equal containers
by largest differencing (the two partial partitions of greatest spread are merged with opposing
imbalances), k starting at the least possible count.  Where containers exceed the capacity, the well-filled ones are closed and the
items of the others are differenced again; where nothing can be closed, k rises.  No other heuristic places anything.
Only an item longer than the capacity is divided: its full slices fill containers of their own and the
rest is an item like any other.

The windows' expected size is fixed, in tokens and in items, so no task grows with the input.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut, partitions_for

WINDOW_BINS, WINDOW_ITEMS = 256, 8192
#: So many specs are broadcast; more are joined by a shuffle.
SPEC_ROWS = 10_000


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """k-way Karmarkar-Karp: indices of ``sizes`` in k groups of near-equal sums.

    A partial partition is its non-empty groups, largest first; absent groups count as empty, which is
    where the largest group of the partner goes, so early merges touch few groups.
    """
    heap = []
    for i, s in enumerate(sizes):
        heap.append((-s, i, [(s, (i,))]))
    heapq.heapify(heap)
    tie = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        over = len(a) + len(b) - k
        if over <= 0:
            merged = a + b
        else:
            # a's smallest `over` groups meet b's smallest, the largest of these with the smallest of those
            merged = a[: len(a) - over] + b[: len(b) - over]
            merged += [(x[0] + y[0], (x[1], y[1])) for x, y in zip(a[len(a) - over :], reversed(b[len(b) - over :]))]
        merged.sort(key=lambda g: -g[0])
        if len(merged) == k and (low := merged[-1][0]):
            spread = merged[0][0] - low
        else:
            spread = merged[0][0]
        heapq.heappush(heap, (-spread, tie, merged))
        tie += 1
    groups = []
    for _, tree in heap[0][2] if heap else []:
        flat, todo = [], [tree]
        while todo:
            t = todo.pop()
            for x in t:
                todo.append(x) if isinstance(x, tuple) else flat.append(x)
        groups.append(flat)
    return groups


#: Containers filled to within this share of the capacity are closed; k rises by a part of itself.
CLOSED, PART = 0.06, 60


def fill(sizes: list[int], capacity: int) -> list[list[int]]:
    """Groups with sums of at most ``capacity``; every size is at most ``capacity``. All of them are differencing's.

    Differencing runs with k from the least possible count.  Where some of its containers exceed the capacity, those that are full to
    within ``CLOSED`` of it are closed and the other items are differenced anew; where none is, k rises by a ``PART``-th.
    """
    out, rest, more = [], list(range(len(sizes))), 0
    while rest:
        k = max(1, -(-sum(sizes[i] for i in rest) // capacity)) + more
        groups = [[rest[i] for i in g] for g in differencing([sizes[i] for i in rest], k)]
        loads = [sum(sizes[i] for i in g) for g in groups]
        if max(loads) <= capacity:
            return out + groups
        rest = []
        for g, load in zip(groups, loads):
            out.append(g) if capacity * (1 - CLOSED) <= load <= capacity else rest.extend(g)
        if len(rest) == sum(map(len, groups)):
            more += max(1, k // PART)
    return out


def pack(sizes: DataFrame, key: str = "doc_id", window_bins: int = WINDOW_BINS) -> DataFrame:
    """Assign items to containers.

    ``sizes``: ``spec_id, capacity, <key>, n_tokens``.  Returns ``spec_id, container, <key>, token_from,
    token_to`` (half-open range).  Rows without tokens, with a null size or a capacity below 1 need no
    place and are left out.  Container numbers are unique within a spec.
    """
    spark = sizes.sparkSession
    items = sizes.where("n_tokens > 0 AND capacity > 0").select("spec_id", "capacity", F.col(key).cast("long").alias("k"), "n_tokens")
    totals = items.groupBy("spec_id").agg(F.sum("n_tokens").alias("total"), F.count("*").alias("n"))
    counted = totals.agg(F.sum("n").alias("rows"), F.count("*").alias("specs")).first()
    if counted["specs"] <= SPEC_ROWS:
        totals = F.broadcast(totals)
    windows = F.greatest(F.lit(1), F.ceil(F.col("total") / (F.col("capacity") * window_bins)).cast("long"), F.ceil(F.col("n") / WINDOW_ITEMS).cast("long"))
    placed = items.join(totals, "spec_id").withColumn("window", F.pmod(F.xxhash64("k", "n_tokens"), windows))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        spec, cap, window = int(pdf.spec_id.iloc[0]), int(pdf.capacity.iloc[0]), int(pdf.window.iloc[0])
        pdf = pdf.sort_values(["n_tokens", "k"], ascending=[False, True], kind="stable")
        rows, at, rest = [], 0, []
        for k, n in zip(pdf.k.tolist(), pdf.n_tokens.tolist()):
            full = n // cap
            for i in range(full):
                rows.append((at, k, i * cap, (i + 1) * cap))
                at += 1
            if n % cap:
                rest.append((n - full * cap, k, full * cap, n))
        rest.sort(key=lambda r: -r[0])
        for group in fill([r[0] for r in rest], cap):
            for i in group:
                rows.append((at, *rest[i][1:]))
            at += 1
        out = pd.DataFrame(rows, columns=["c", "k", "token_from", "token_to"])
        out["container"] = window * (1 << 24) + out.c
        out["spec_id"] = spec
        return out[["spec_id", "container", "k", "token_from", "token_to"]]

    placed = placed.repartition(partitions_for(spark, counted["rows"] or 0, 20_000), "spec_id", "window")
    out = placed.groupBy("spec_id", "window").applyInPandas(one, "spec_id long, container long, k long, token_from long, token_to long")
    return out.withColumnRenamed("k", key)


def pack_documents(documents: DataFrame, specs: DataFrame, folder: str | None = None) -> DataFrame:
    """Sizes by every tokenizer the specs name, then :func:`pack`.

    The specs are a small configuration table; only its distinct tokenizer names come to the driver.
    The counted sizes are cut into the shared folder because they are read for the totals and again for
    the packing.
    """
    from tidemark.llm.common import TOKENIZER_DIR
    from tidemark.llm.tokenize import token_counts

    names = sorted(r[0] for r in specs.where("tokenizer IS NOT NULL").select("tokenizer").distinct().collect())
    sizes = cut(token_counts(documents, names, folder=folder or TOKENIZER_DIR).where("n_tokens > 0"))
    once = specs.select("spec_id", "tokenizer", "capacity").dropDuplicates(["spec_id"])
    if once.limit(SPEC_ROWS + 1).count() <= SPEC_ROWS:
        once = F.broadcast(once)  # else every tokenizer would be one join key for all documents
    return pack(sizes.join(once, "tokenizer"))
