"""Why an entry got its score."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import label_display
from tidemark.operators.recipe import contributions
from tidemark.operators.terms import largest_products
from tidemark.schemas import CLASSES, KEY
from tidemark.session import cut

ROWS, LEAST, CLASS_ROWS_BELOW, POSITIVE_ABOVE = 8, 0.001, 4, 0.25


def explain_linear(vectors: DataFrame, terms: list[str], weights: DataFrame, n: int = ROWS, least: float = LEAST) -> DataFrame:
    """``(key, rank, feature, weight, direction)``: coefficient times value for the predicted class, the n largest.

    ``vectors``: the key, ``class`` and the stored form of MLlib's vectors over ``terms``. All that concerns an entry is in its row.
    """
    at = {t: i for i, t in enumerate(terms)}
    w = np.zeros((len(CLASSES), len(terms)))
    for r in weights.where("term != ''").collect():  # as many as the head's coefficients
        w[CLASSES.index(r["class"]), at[r["term"]]] = r["weight"]
    c = largest_products(vectors.where("class IS NOT NULL"), w, terms, CLASSES, n, least)
    rounded = F.transform("c", lambda x: F.struct(F.round(x["weight"], 4).alias("weight"), x["feature"].alias("feature")))
    ranked = F.transform(F.filter(rounded, lambda x: F.abs(x["weight"]) > least), lambda x: F.struct((-F.abs(x["weight"])).alias("o"), x["feature"].alias("feature"), x["weight"].alias("weight")))
    top = c.select(*KEY, F.posexplode(F.slice(F.sort_array(ranked), 1, n)).alias("rank", "x"))
    return top.select(*KEY, (F.col("rank") + 1).alias("rank"), "x.feature", "x.weight", F.when(F.col("x.weight") > 0, "positive").otherwise("negative").alias("direction"))


def explain_recipe(entries: DataFrame, recipe: DataFrame, scores: DataFrame) -> DataFrame:
    """Recipe phrases behind each score; entries with fewer than four get their class probabilities as further rows."""
    # written once: it is read for the rows and for their number
    c = cut(contributions(entries, recipe, scores, ROWS, LEAST).select(*KEY, "rank", F.col("term").alias("feature"), F.col("contribution").cast("double").alias("weight"), "direction"))
    n = scores.select(*KEY).join(c.groupBy(*KEY).agg(F.count("*").alias("n")), KEY, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    classes = F.array(*[F.struct(label_display(F.lit(k)).alias("feature"), F.col(f"p_{k}").alias("p"), F.lit(i + 1).alias("o")) for i, k in enumerate(CLASSES)])
    few = scores.join(n.where(F.col("n") < CLASS_ROWS_BELOW), KEY).select(*KEY, "n", F.explode(classes).alias("x"))
    rows = few.select(*KEY, (F.col("n") + F.col("x.o")).cast("int").alias("rank"), "x.feature", F.col("x.p").alias("weight"), F.when(F.col("x.p") > POSITIVE_ABOVE, "positive").otherwise("negative").alias("direction"))
    return c.unionByName(rows)


def explanations(rows: DataFrame, scores: DataFrame) -> DataFrame:
    """One struct row an entry: prediction, confidence, relevance and its features in order of rank."""
    top = rows.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("rank", "feature", "weight", "direction"))).alias("top_features"))
    conf = F.greatest(*[F.col(f"p_{c}") for c in CLASSES])
    return scores.join(top, KEY, "left").select(*KEY, F.col("predicted_label").alias("prediction"), conf.alias("confidence"), "relevance_score", "top_features")
