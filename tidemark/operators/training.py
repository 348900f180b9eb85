"""Sample weights, splits, heads, calibration and metrics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler, StringIndexerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tidemark.functions.scores import argmax, lead_blend, log_probabilities, relevance, softmax, temperature_grid, time_decay
from tidemark.functions.text import blank
from tidemark.schemas import CLASSES, KEY
from tidemark.session import scratch

#: Alphabetical, the order the heads number their classes in.
HEAD_CLASSES = sorted(CLASSES)
#: What the terms of source types begin with.
SOURCE_TERM = "source_type_"


def sample_weights(labels: DataFrame, now: str, half_life_days: float = 0, floor: float = 0.2, reasoning_boost: float = 1.0) -> DataFrame:
    """``labels`` with ``weight``: time decay of the last change times the boost of labels that give a reason (0 counts as 1)."""
    boost = F.when(F.trim(blank("reasoning")) != "", F.lit(float(reasoning_boost or 1.0))).otherwise(1.0)
    return labels.withColumn("weight", time_decay(F.col("updated_at"), F.col("created_at"), now, half_life_days, floor) * boost)


def hash_order(seed: int, *cols: str) -> Column:
    """A fixed pseudo-random order of keys, the same on any engine with md5."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in (cols or KEY)], F.lit(str(seed))))


def stratified_split(rows: DataFrame, label: str, share: float, seed: int, key: list[str] = KEY) -> DataFrame:
    """``rows`` with ``is_test``: of each class the first ``round(share * n)`` in hash order.

    With fewer than twice as many rows as classes the split ignores classes; the share is held between k/n and 1 - k/n.
    """
    n = rows.agg(F.count("*").alias("n"), F.countDistinct(label).alias("k")).first()
    by_class = n.n >= 2 * n.k
    held = max(n.k / n.n, min(1 - n.k / n.n, share)) if by_class and n.n else share
    ranked = hash_ranked(rows, [label] if by_class else [], seed, key)
    return ranked.withColumn("is_test", (F.col("__rank") <= F.round(F.col("__size") * held)).cast("int")).drop("__rank", "__size")


def hash_ranked(rows: DataFrame, part: list[str], seed: int, key: list[str] = KEY) -> DataFrame:
    """``rows`` with ``__rank`` (from 1, in hash order) and ``__size`` of their part.

    A part may hold most of all rows, so it is not ordered in one task: rows are ranked within 4,096 slices of the hash,
    and the slices' counts, a small table, give what comes before each.
    """
    keys = [*part, "__slice"]
    h = rows.withColumn("__h", hash_order(seed, *key)).withColumn("__slice", F.substring("__h", 1, 3))
    counts = h.groupBy(*keys).agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.sum("__n").over(Window.partitionBy(*part).orderBy("__slice")) - F.col("__n")).withColumn("__size", F.sum("__n").over(Window.partitionBy(*part)))
    inside = h.withColumn("__in", F.row_number().over(Window.partitionBy(*keys).orderBy("__h", *key)))
    return inside.join(before.drop("__n"), keys).withColumn("__rank", F.col("__before") + F.col("__in")).select(*rows.columns, "__rank", "__size")


def default_share(rows: DataFrame, label: str) -> float:
    """Test share: a class's smallest part of all rows, held between 0.1 and 0.2."""
    c = rows.groupBy(label).count().agg(F.min("count").alias("m"), F.sum("count").alias("n")).first()
    return max(0.1, min(0.2, c.m / c.n)) if c.n else 0.2


def replicate(rows: DataFrame, weight: str = "weight", most: int = 5) -> DataFrame:
    """Rows repeated by their weight relative to the smallest one, between 1 and ``most`` times (halves to even), with ``copy`` from 1."""
    low = rows.agg(F.greatest(F.min(weight), F.lit(1e-6)))
    n = F.least(F.lit(most), F.greatest(F.lit(1), F.bround(F.col(weight) / low.scalar(), 0).cast("int")))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), n)))


def oversample(rows: DataFrame, label: str, key: list[str] = KEY, seed: int = 42) -> DataFrame:
    """Smaller classes filled up to the largest by repeating their rows in turn (hash order), with ``turn`` from 0."""
    top = rows.groupBy(label).agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)))
    ranked = hash_ranked(rows, [label], seed, key)
    turns = F.floor((top.scalar() - F.col("__rank")) / F.col("__size")).cast("int")
    return ranked.withColumn("turn", F.explode(F.sequence(F.lit(0), turns))).drop("__rank", "__size")


def class_balanced(rows: DataFrame, label: str, weight: str | None = None) -> DataFrame:
    """``rows`` with ``w``: ``n / (k * n_class)``, times a given weight."""
    counts = {r[label]: r["n"] for r in rows.where(F.col(label).isin(CLASSES)).groupBy(label).agg(F.count("*").alias("n")).collect()}  # four classes at most
    total = sum(counts.values())
    w = F.lit(None).cast("double")
    for c, n in counts.items():
        w = F.when(F.col(label) == c, F.lit(total / (len(counts) * n))).otherwise(w)
    return rows.withColumn("w", w * (F.col(weight) if weight else F.lit(1.0))).where("w IS NOT NULL")


def _indexer() -> StringIndexerModel:
    return StringIndexerModel.from_labels(HEAD_CLASSES, inputCol="label", outputCol="y", handleInvalid="skip")


def with_features(df: DataFrame, embedding: str = "embedding") -> DataFrame:
    """Vectors for MLlib from arrays; rows without one are left out."""
    return df.where(F.col(embedding).isNotNull()).withColumn("features", array_to_vector(F.col(embedding).cast("array<double>")))


def fit_logistic(rows: DataFrame, weight: str | None = None, c: float = 1.0, iterations: int = 1000) -> PipelineModel:
    """Class-balanced multinomial logistic regression on ``features`` and ``label``; ``regParam`` is ``1 / (C * sum of weights)``."""
    data = class_balanced(rows, "label", weight)
    total = data.agg(F.sum("w").alias("t")).first()["t"] or 1.0
    lr = LogisticRegression(
        featuresCol="features", labelCol="y", weightCol="w", family="multinomial", standardization=False, elasticNetParam=0.0, regParam=1.0 / (c * total), maxIter=iterations, tol=1e-6
    )
    return Pipeline(stages=[_indexer(), lr]).fit(data)


def fit_mlp(rows: DataFrame, hidden: int = 256, iterations: int = 100, seed: int = 42) -> PipelineModel:
    """Standardised features into one hidden layer."""
    dim = len(rows.select("features").first()["features"])
    mlp = MultilayerPerceptronClassifier(featuresCol="z", labelCol="y", layers=[dim, hidden, len(HEAD_CLASSES)], maxIter=iterations, seed=seed)
    return Pipeline(stages=[_indexer(), StandardScaler(inputCol="features", outputCol="z", withMean=True, withStd=True), mlp]).fit(rows)


def text_values(entries: DataFrame, lengths: tuple[int, ...] = (1, 2, 3), words=None) -> tuple[DataFrame, DataFrame]:
    """``(values, vocabulary)``; values are ``(key, term, value)``: TF-IDF of a text's words, pairs and triples (sublinear, smoothed, length 1;
    10,000 terms, those of two entries or more and of 95 in 100 at most; where that leaves none, 5,000 of any) and ``source_type_<x>``
    with 1 for its source type."""
    from tidemark.functions.text import analysed_words, full_text
    from tidemark.operators.features import fit_tfidf

    values, vocabulary = fit_tfidf(entries, full_text(), lengths, words or analysed_words)
    return values.select(*KEY, "term", "value").unionByName(_source_values(entries)), vocabulary


def text_values_by(entries: DataFrame, vocabulary: DataFrame, lengths: tuple[int, ...] = (1, 2, 3), words=None) -> DataFrame:
    """The values of other entries by a vocabulary fitted before."""
    from tidemark.functions.text import analysed_words, full_text
    from tidemark.operators.features import term_counts, tfidf

    counts = term_counts(entries, full_text(), lengths, words or analysed_words)
    return tfidf(counts, vocabulary).select(*KEY, "term", "value").unionByName(_source_values(entries))


def source_name() -> Column:
    """An entry's source type, ``unknown`` where it has none."""
    return F.coalesce(F.nullif("source_type", F.lit("")), F.lit("unknown"))


def _source_values(entries: DataFrame) -> DataFrame:
    return entries.select(*KEY, F.concat(F.lit(SOURCE_TERM), source_name()).alias("term"), F.lit(1.0).alias("value"))


def fit_text_head(rows: DataFrame, values: DataFrame, iterations: int = 1000) -> DataFrame:
    """``(class, term, weight)`` of a class-balanced logistic head over ``values``; the intercepts have the empty term.

    ``rows``: key, ``label`` and, if any, ``weight``.  The vocabulary is bounded (``text_values``) and numbered on the driver.
    """
    spark = rows.sparkSession
    known = rows.where(F.col("label").isin(HEAD_CLASSES))
    mine = values.join(known.select(*KEY), KEY, "left_semi")
    terms = [r.term for r in mine.select("term").distinct().orderBy("term").collect()]
    number = F.broadcast(spark.createDataFrame(pa.table({"i": pa.array(range(len(terms)), pa.int32()), "term": pa.array(terms, pa.string())})))
    x = mine.join(number, "term").groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("i", "value"))).alias("x"))
    some = F.coalesce("x", F.array().cast("array<struct<i:int,value:double>>"))
    vector = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(len(terms)).alias("size"), F.transform(some, lambda e: e["i"]).alias("indices"), F.transform(some, lambda e: e["value"]).alias("values"))
    data = known.join(x, KEY, "left").select("label", *(["weight"] if "weight" in rows.columns else []), vector.alias("features"))
    return fit_vectors(stored_vectors(data)[1], terms, iterations)


def stored_vectors(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``features`` in MLlib's stored form, written to the shared folder and read back twice: as they are, and as MLlib's
    vectors, so no row passes through Python."""
    spark, path = rows.sparkSession, scratch(rows.sparkSession, "vectors")
    rows.write.parquet(path)
    typed = StructType([StructField(f.name, VectorUDT() if f.name == "features" else f.dataType) for f in rows.schema])
    return spark.read.schema(rows.schema).parquet(path), spark.read.schema(typed).parquet(path)


def fit_vectors(rows: DataFrame, names: list[str], iterations: int = 1000) -> DataFrame:
    """The head of ``fit_text_head`` from ``label``, ``features`` and, if any, ``weight``; ``names`` has the features' terms."""
    spark = rows.sparkSession
    data = class_balanced(rows.where(F.col("label").isin(HEAD_CLASSES)), "label", "weight" if "weight" in rows.columns else None)
    y = (F.array_position(F.array(*[F.lit(c) for c in HEAD_CLASSES]), F.col("label")) - 1).cast("double")
    data = data.select(y.alias("y"), "w", "features")
    seen = data.agg(F.countDistinct("y").alias("k"), F.sum("w").alias("t")).first()
    if not names or seen["k"] < 2:
        return spark.createDataFrame([], "class string, term string, weight double")
    lr = LogisticRegression(featuresCol="features", labelCol="y", weightCol="w", family="multinomial", standardization=False, regParam=1.0 / seen["t"], maxIter=iterations, tol=1e-6)
    m = lr.fit(data)
    c, b = m.coefficientMatrix.toArray(), m.interceptVector.toArray()
    classes = [HEAD_CLASSES[i] for i in range(len(c))]
    at = [(i, j) for i in range(len(c)) for j in np.flatnonzero(c[i])]
    cols = [[classes[i] for i, _ in at] + classes, [names[j] for _, j in at] + [""] * len(classes), [float(c[i, j]) for i, j in at] + b.tolist()]
    return spark.createDataFrame(pa.table({"class": pa.array(cols[0], pa.string()), "term": pa.array(cols[1], pa.string()), "weight": pa.array(cols[2], pa.float64())}))


def text_logits(values: DataFrame, head: DataFrame) -> DataFrame:
    """``(key, logits)`` by a text head: the sum of value times weight of each class, by a join; terms it does not know count nothing."""
    base = {r["class"]: r["weight"] for r in head.where("term = ''").collect()}  # four at most
    per = values.join(F.broadcast(head.where("term != ''")), "term", "left").groupBy(*KEY).agg(*[F.sum(F.when(F.col("class") == c, F.col("value") * F.col("weight")).otherwise(0.0)).alias(c) for c in HEAD_CLASSES])
    return per.select(*KEY, F.array(*[F.col(c) + F.lit(float(base.get(c, 0.0))) for c in HEAD_CLASSES]).alias("logits"))


def logits(df: DataFrame) -> DataFrame:
    """The head's raw outputs as an array in the order of ``HEAD_CLASSES``; where a head has none, the logs of its probabilities."""
    if "rawPrediction" in df.columns:
        return df.withColumn("logits", vector_to_array("rawPrediction"))
    return df.withColumn("logits", log_probabilities(vector_to_array("probability")))


def calibrated(df: DataFrame, temperature: float = 1.0, blend: float = 0.0) -> DataFrame:
    """Scores from ``logits``: the key, ``relevance_score``, ``predicted_label`` and ``p_<class>``, rounded to four places."""
    p = df.withColumn("p", softmax(F.col("logits"), temperature))
    rel = lead_blend(relevance(F.col("p"), HEAD_CLASSES), F.col("p")[HEAD_CLASSES.index(CLASSES[0])], blend)
    return p.select(
        *KEY, F.round(rel, 4).alias("relevance_score"), argmax(F.col("p"), HEAD_CLASSES).alias("predicted_label"),
        *[F.round(F.col("p")[HEAD_CLASSES.index(c)], 4).alias(f"p_{c}") for c in CLASSES],
    )


def temperature_losses(rows: DataFrame, classes: list[str] = HEAD_CLASSES) -> DataFrame:
    """``(i, temperature, nll)``: mean negative log-likelihood of ``label`` given ``logits`` at each grid temperature."""
    y = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("label")).cast("int")
    # one aggregate over the rows: the forty losses are an array, so no row is multiplied in a shuffle
    loss = F.transform(temperature_grid(), lambda t: -F.log(F.greatest(F.element_at(softmax(F.col("logits"), t), y), F.lit(1e-9))))
    each = rows.where(y > 0).select(F.posexplode(loss).alias("i", "loss"))
    grid = F.element_at(temperature_grid(), F.col("i") + 1)
    return each.groupBy("i").agg(F.avg("loss").alias("nll")).withColumn("temperature", grid)


def fit_temperature(rows: DataFrame, classes: list[str] = HEAD_CLASSES) -> float:
    """The grid temperature of least loss, the first on ties; 1.0 with fewer than three rows or an unknown label."""
    s = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("label").isin(classes), 0).otherwise(1)), F.lit(0)).alias("bad")).first()
    if s.n < 3 or s.bad:
        return 1.0
    return temperature_losses(rows, classes).orderBy("nll", "i").first()["temperature"]


def metrics(pairs: DataFrame, truth: str = "label", guess: str = "predicted_label") -> DataFrame:
    """``(class, precision, recall, f1, support)`` for each class met, and a row ``macro`` whose ``support`` is the number of rows
    and whose ``accuracy`` is set. Empty divisions count as 0."""
    m = pairs.groupBy(F.col(truth).alias("t"), F.col(guess).alias("g")).agg(F.count("*").alias("n"))
    both = m.select(F.explode(F.array(F.col("t"), F.col("g"))).alias("class"), "t", "g", "n").distinct()
    hit = F.sum(F.when((F.col("t") == F.col("class")) & (F.col("g") == F.col("class")), F.col("n")).otherwise(0))
    per = both.groupBy("class").agg(hit.alias("tp"), F.sum(F.when(F.col("t") == F.col("class"), F.col("n")).otherwise(0)).alias("support"), F.sum(F.when(F.col("g") == F.col("class"), F.col("n")).otherwise(0)).alias("guessed"))
    div = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    per = per.select("class", div(F.col("tp"), F.col("guessed")).alias("precision"), div(F.col("tp"), F.col("support")).alias("recall"), "support", "tp")
    per = per.withColumn("f1", div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    total = per.agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), F.sum("support").alias("support"), (F.sum("tp") / F.sum("support")).alias("accuracy"))
    r = lambda c: F.round(c, 4).alias(c)
    rows = per.select("class", r("precision"), r("recall"), r("f1"), "support", F.lit(None).cast("double").alias("accuracy"))
    return rows.unionByName(total.select(F.lit("macro").alias("class"), r("precision"), r("recall"), r("f1"), "support", r("accuracy")))


def feature_importance(model: PipelineModel, vocabulary: list[str]) -> DataFrame:
    """``(class, term, weight)`` of a logistic head's coefficients."""
    from pyspark.sql import SparkSession

    m = model.stages[-1].coefficientMatrix.toArray()
    rows = [(c, t, float(m[i, j])) for i, c in enumerate(HEAD_CLASSES) for j, t in enumerate(vocabulary) if m[i, j]]
    return SparkSession.active().createDataFrame(rows, "class string, term string, weight double")


def teacher_labels(entries: DataFrame, labels: DataFrame, scores: DataFrame, every: bool = False) -> DataFrame:
    """Labels to learn from: a person's where there is one, else the model's prediction. ``every`` keeps entries without either, and the
    model's prediction as ``class``."""
    h = labels.select(*KEY, F.col("label").alias("__h"))
    s = scores.select(*KEY, F.col("predicted_label").alias("class"))
    j = entries.join(h, KEY, "left").join(s, KEY, "left").withColumn("label", F.coalesce("__h", "class")).drop("__h")
    return j if every else j.drop("class").where("label IS NOT NULL")
