"""Active learning: which entries to label next, and the views of the best ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scores import entropy
from tidemark.functions.text import blank, percent
from tidemark.operators.queries import category_counts, newest, unlabeled
from tidemark.operators.recipe import recipe_scores
from tidemark.operators.training import hash_order
from tidemark.schemas import CLASSES, KEY
from tidemark.session import cut

# Pool sizes and the order in which pools claim an entry.
CANDIDATES, UNCERTAIN, CONFLICT, DIVERSE, NEW = 200, 10, 5, 5, 15
POOLS = {"uncertain": 1, "conflict": 2, "diverse": 3, "new": 4}
# The order of pools for machine labelling, the least size of its queue, and the greatest of its batch.
MACHINE_ORDER = {"uncertain": 0, "new": 1, "conflict": 2, "diverse": 3}
MACHINE_QUEUE, MACHINE_MOST = 120, 200


def first_scores(scores: DataFrame) -> DataFrame:
    """One score a key, the first by its own values."""
    w = Window.partitionBy(*KEY).orderBy(*[F.col(c) for c in scores.columns if c not in KEY])
    return scores.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def uncertain(candidates: DataFrame, scores: DataFrame, n: int = UNCERTAIN) -> DataFrame:
    """The n candidates of highest entropy over the (rounded) class probabilities."""
    e = scores.select(*KEY, F.round(entropy(F.array(*[F.col(f"p_{c}") for c in CLASSES])), 6).alias("entropy"), F.greatest(*[f"p_{c}" for c in CLASSES]).alias("top"), "predicted_label")
    j = candidates.select(*KEY).join(e, KEY)
    rows = j.orderBy(F.col("entropy").desc(), *KEY).limit(n)
    return rows.withColumn("reason", F.concat(blank("predicted_label"), F.lit(" ("), percent(F.col("top")), F.lit(")"))).drop("predicted_label")


def conflicts(candidates: DataFrame, scores: DataFrame, recipe: DataFrame, n: int = CONFLICT, tokenizer: str = "space") -> DataFrame:
    """The newest n candidates on which model and recipe disagree."""
    guess = recipe_scores(candidates, recipe, tokenizer).select(*KEY, F.col("predicted_label").alias("recipe_label"))
    model = scores.select(*KEY, F.col("predicted_label").alias("model_label"))
    j = candidates.select(*KEY, "published_date").join(model, KEY).join(guess, KEY).where("model_label != recipe_label")
    return j.orderBy(*newest()).limit(n).drop("published_date")


def diverse(entries: DataFrame, labels: DataFrame, profile_id: int, n: int = DIVERSE) -> DataFrame:
    """The newest unlabelled entry of the n categories with the fewest labels (blank categories left out)."""
    free = unlabeled(entries.where(F.trim(blank("source_category")) != ""), labels, profile_id)
    newest_of = Window.partitionBy("source_category").orderBy(*newest())
    first = free.withColumn("rn", F.row_number().over(newest_of)).where("rn = 1")
    counts = category_counts(entries, labels.where(F.col("profile_id") == profile_id)).select("source_category", F.col("n").alias("labelled"))
    j = first.join(counts, "source_category", "left").withColumn("labelled", F.coalesce("labelled", F.lit(0)))
    return j.orderBy("labelled", *newest()).limit(n).select(*KEY, "source_category", "labelled")


def smart_queue(entries: DataFrame, labels: DataFrame, scores: DataFrame, recipe: DataFrame, profile_id: int, limit: int = 30) -> DataFrame:
    """``(key, pool, place)``: what to label next, each entry once under the first pool that claims it."""
    pool = cut(unlabeled(entries, labels, profile_id).orderBy(*newest()).limit(CANDIDATES))
    u = uncertain(pool, scores).select(*KEY, F.lit("uncertain").alias("pool"), F.row_number().over(Window.orderBy(F.col("entropy").desc(), *KEY)).alias("rank"))
    dated = pool.select(*KEY, "published_date")
    c = conflicts(pool, scores, recipe).join(dated, KEY)
    c = c.select(*KEY, F.lit("conflict").alias("pool"), F.row_number().over(Window.orderBy(*newest())).alias("rank"))
    d = diverse(entries, labels, profile_id).join(entries.select(*KEY, "published_date"), KEY)
    d = d.select(*KEY, F.lit("diverse").alias("pool"), F.row_number().over(Window.orderBy("labelled", *newest())).alias("rank"))
    n = dated.orderBy(*newest()).limit(NEW).select(*KEY, F.lit("new").alias("pool"), F.row_number().over(Window.orderBy(*newest())).alias("rank"))
    return merge_pools(u.unionByName(c).unionByName(d).unionByName(n), limit)


def merge_pools(rows: DataFrame, limit: int) -> DataFrame:
    """Pools of a few rows each in order of their claim; each key once; cut to the limit."""
    order = F.element_at(F.create_map(*[F.lit(x) for kv in POOLS.items() for x in kv]), F.col("pool"))
    r = rows.withColumn("o", order)
    once = r.withColumn("k", F.row_number().over(Window.partitionBy(*KEY).orderBy("o", "rank"))).where("k = 1")
    return once.orderBy("o", "rank").limit(limit).withColumn("place", F.row_number().over(Window.orderBy("o", "rank"))).select(*KEY, "pool", "place")


def shuffled_page(entries: DataFrame, labels: DataFrame, profile_id: int, seed: int, n: int = 20, newest_of: int = 500) -> DataFrame:
    """A page of ``n`` of the newest unlabelled entries in an order that only the seed decides."""
    free = unlabeled(entries.select(*KEY, "published_date"), labels, profile_id).orderBy(*newest()).limit(newest_of)
    return free.orderBy(hash_order(seed), *KEY).limit(n).select(*KEY)


def machine_batch(limit: int) -> tuple[int, int]:
    """Size of a batch for machine labelling, held between 1 and ``MACHINE_MOST``, and of the smart queue it is taken from."""
    n = max(1, min(MACHINE_MOST, limit))
    return n, max(MACHINE_QUEUE, 2 * n)


def synthetic_rank(queue: DataFrame, limit: int) -> DataFrame:
    """A smart queue (of the size :func:`machine_batch` tells) reordered for machine labelling: uncertain, new, conflict, diverse, each in
    the queue's order; cut to the batch's size."""
    order = F.element_at(F.create_map(*[F.lit(x) for kv in MACHINE_ORDER.items() for x in kv]), F.col("pool"))
    n, _ = machine_batch(limit)
    return queue.withColumn("o", order).orderBy("o", "place").limit(n).withColumn("turn", F.row_number().over(Window.orderBy("o", "place"))).select(*KEY, "pool", "turn")


def top_recent(entries: DataFrame, labels: DataFrame, scores: DataFrame, profile_id: int, limit: int = 30) -> DataFrame:
    """The best-scored unlabelled entries of ``entries`` (already cut to the days wanted)."""
    j = unlabeled(entries.select(*KEY, "published_date"), labels, profile_id).join(first_scores(scores), KEY)
    return j.orderBy(F.col("relevance_score").desc(), *newest()).limit(limit).select(*KEY, "relevance_score", "predicted_label")


def mismatches(labels: DataFrame, scores: DataFrame, profile_id: int) -> DataFrame:
    """Labelled entries the model would label otherwise."""
    mine = labels.where(F.col("profile_id") == profile_id).select(*KEY, F.col("label").alias("user_label"))
    return mine.join(first_scores(scores), KEY).where("user_label != predicted_label").select(*KEY, "user_label", "predicted_label", "relevance_score")


def shown_accuracy(labels: DataFrame, scores: DataFrame) -> DataFrame:
    """Per profile: labelled and scored entries, and the per cent on which both agree."""
    j = labels.select("profile_id", *KEY, "label").join(first_scores(scores), KEY)
    right = F.sum(F.when(F.col("label") == F.col("predicted_label"), 1).otherwise(0))
    return j.groupBy("profile_id").agg(F.count("*").alias("n"), F.round(right * 100.0 / F.count("*"), 1).alias("accuracy"))


def pool_histogram(queue: DataFrame) -> DataFrame:
    return queue.groupBy("pool").agg(F.count("*").alias("n"))
