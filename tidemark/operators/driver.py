"""Training and scoring of a profile's model: the gates, the split, and the head its architecture asks for."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import analysed_words, full_text, model_text, recipe_words
from tidemark.operators import features, queries, recipe, store, terms, training
from tidemark.schemas import KEY
from tidemark.session import cut

# Rows to train on before some are held out for calibration, the share and least number of these; rows a student needs.
CALIBRATE_FROM, CALIBRATE_SHARE, CALIBRATE_LEAST, STUDENT_LEAST = 30, 0.15, 5, 20
HIDDEN, MLP_ITERATIONS, ITERATIONS = 256, 500, 1000


@dataclass
class Trained:
    """What training gave: ``success``, or ``error`` with the number of labels; else the head, its temperature and its metrics."""

    success: bool
    label_count: int
    architecture: str
    error: str = ""
    split_note: str = ""
    temperature: float = 1.0
    metrics: DataFrame | None = None
    head: PipelineModel | DataFrame | None = None
    extra: dict = field(default_factory=dict)


def split(rows: DataFrame, seed: int = 42) -> tuple[DataFrame, DataFrame, str, int]:
    """``(train, test, note, smallest class)``: by class, a tenth to a fifth held out; with a class of one row all rows are both."""
    least = rows.groupBy("label").count().agg(F.min("count").alias("m")).first()["m"] or 0
    if least < 2:
        return rows, rows, "All data used for training (some classes have <2 samples)", least
    s = cut(training.stratified_split(rows, "label", training.default_share(rows, "label"), seed))
    n = {r.is_test: r["count"] for r in s.groupBy("is_test").count().collect()}
    share = round(100.0 * n.get(1, 0) / max(1, sum(n.values())))
    return s.where("is_test = 0").drop("is_test"), s.where("is_test = 1").drop("is_test"), f"{100 - share}/{share} train/test split", least


def held_for_calibration(train: DataFrame, least: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows to fit on and rows to calibrate on (None where there are too few of either)."""
    if least < 2 or train.count() < CALIBRATE_FROM:
        return train, None
    s = cut(training.stratified_split(train, "label", CALIBRATE_SHARE, 43))
    held = s.where("is_test = 1").drop("is_test")
    return (s.where("is_test = 0").drop("is_test"), held) if held.count() >= CALIBRATE_LEAST else (train, None)


def train(entries: DataFrame, labels: DataFrame, profile_id: int, config: dict, now: str, make=None, hidden: int = HIDDEN, iterations: int | None = None) -> Trained:
    """Train on a profile's confirmed labels by ``config["model_architecture"]``: ``transformer`` (a hidden layer over vectors; entries without
    one are embedded by ``make``) or anything else (the text head).

    Fewer labels than ``min_labels_to_train``, or vectors for fewer, is no success.
    """
    arch, need = config.get("model_architecture") or "transformer", int(config.get("min_labels_to_train", 20))
    rows = queries.training_rows(entries, labels, profile_id)
    rows = cut(training.sample_weights(rows, now, config.get("label_time_decay_days", 0), config.get("label_time_decay_floor", 0.2), config.get("reasoning_weight_boost", 1.0)))
    n = rows.count()
    if n < need:
        return Trained(False, n, arch, f"Need at least {need} labels to train. Currently have {n}.")
    return (_transformer if arch == "transformer" else _text)(rows, n, need, config, make, hidden, iterations)


def _vectors(rows: DataFrame, dim: int, make) -> DataFrame:
    """Rows with ``features``: their own vector of ``dim`` numbers, else one made now; without either they are left out."""
    ok = F.coalesce((F.size("embedding") == dim) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x)), F.lit(False))
    have, rest = rows.where(ok), rows.where(~ok).drop("embedding")
    if make is not None:
        have = have.unionByName(features.embed(rest, model_text(), make, dim).select(*have.columns))
    return training.with_features(have)


def _transformer(rows: DataFrame, n: int, need: int, config: dict, make, hidden: int, iterations: int | None) -> Trained:
    data = cut(_vectors(rows, int(config.get("embedding_dim", 768)), make).select(*KEY, "label", "weight", "features"))
    if data.count() < need:
        return Trained(False, n, "transformer", "Not enough entries with embeddings. Try syncing first.")
    fit_on, test, note, least = split(data)
    fit_on, held = held_for_calibration(fit_on, least)
    more = training.oversample(training.replicate(fit_on), "label", [*KEY, "copy"])
    head = training.fit_mlp(more.select("label", "features"), hidden, iterations or MLP_ITERATIONS)
    t = training.fit_temperature(training.logits(head.transform(held))) if held is not None else 1.0
    scored = training.calibrated(training.logits(head.transform(test)), t)
    return Trained(True, n, "transformer", split_note=note, temperature=t, head=head, metrics=training.metrics(test.select(*KEY, "label").join(scored, KEY)))


def _text(rows: DataFrame, n: int, need: int, config: dict, make, hidden: int, iterations: int | None) -> Trained:
    fit_on, test, note, least = split(rows)
    fit_on, held = held_for_calibration(fit_on, least)
    values, vocabulary = training.text_values(fit_on)
    head = training.fit_text_head(fit_on, values, iterations or ITERATIONS)
    score = lambda x: training.text_logits(training.text_values_by(x, vocabulary), head)
    t = training.fit_temperature(score(held).join(held.select(*KEY, "label"), KEY)) if held is not None else 1.0
    scored = training.calibrated(score(test), t)
    return Trained(True, n, "tfidf", split_note=note, temperature=t, head=head, metrics=training.metrics(test.select(*KEY, "label").join(scored, KEY)), extra={"vocabulary": vocabulary})


def score(entries: DataFrame, trained: Trained, config: dict, make=None) -> DataFrame:
    """Calibrated scores of entries by a trained head of either architecture; without one there are none."""
    blend = float(config.get("discovery_lead_blend", 0.0))
    if trained.architecture == "transformer":
        got = training.logits(PipelineModel(trained.head.stages[1:]).transform(_vectors(entries, int(config.get("embedding_dim", 768)), make)))  # the first stage reads labels
    else:
        got = training.text_logits(training.text_values_by(entries, trained.extra["vocabulary"]), trained.head)
    return training.calibrated(got, trained.temperature, blend)


@dataclass
class Student:
    """A text head learnt from people's labels and a model's, with the words of all entries (``tokens``), the vectors of those it learnt from
    (``vectors``, with ``class``, the model's own) and the terms of their places."""

    tokens: DataFrame
    vectors: DataFrame
    terms: list[str]
    head: DataFrame


def student(entries: DataFrame, labels: DataFrame, scores: DataFrame, profile_id: int, words=None, iterations: int = ITERATIONS) -> Student | None:
    """None with fewer than ``STUDENT_LEAST`` rows to learn from. Texts are taken apart once, and no term of a text is shuffled on its own
    except in the counts of the vocabulary."""
    words = words or analysed_words
    mine = queries.current_labels(labels).where((F.col("profile_id") == profile_id) & store.confirmed())
    rows = training.teacher_labels(entries, mine, scores, every=True)
    tokens = cut(rows.select(*KEY, "source_type", training.source_name().alias("source"), "label", "class", words(full_text()).alias("words")))
    known = tokens.where("label IS NOT NULL")
    n = known.count()
    if n < STUDENT_LEAST:
        return None
    counts = cut(terms.term_frequencies(known))
    vocabulary = features.vocabulary(counts, n).collect() or features.vocabulary(counts, n, 1, 1.0, 5000).collect()
    vocabulary = sorted((r.term, r.idf) for r in vocabulary)  # 10,000 at most
    sources = sorted(r.source for r in known.select("source").distinct().collect())
    texts = [t for t, _ in vocabulary]
    plain, vectors = training.stored_vectors(terms.tfidf_vectors(known, texts, [x for _, x in vocabulary], sources, [*KEY, "label", "class"]))
    names = texts + [training.SOURCE_TERM + s for s in sources]
    return Student(tokens, plain, names, training.fit_vectors(vectors, names, iterations))


def distil(entries: DataFrame, labels: DataFrame, scores: DataFrame, profile_id: int, patterns: list[str], top_n: int = 200, words=None, iterations: int = ITERATIONS) -> tuple[DataFrame | None, DataFrame | None, Student | None]:
    """``(recipe, head, student)`` distilled from a model's scores: a text head learns the people's labels, else the model's; its signed top
    terms, source types included, boosted by reasons, with the template phrases and patterns, normalised and held within the caps.

    None with fewer than ``STUDENT_LEAST`` rows to learn from.
    """
    learnt = student(entries, labels, scores, profile_id, words, iterations)
    if learnt is None:
        return None, None, None
    top = recipe.signed_top(learnt.head.where(f"abs(weight) >= {recipe.FLOOR} AND term != ''"), top_n)
    source = F.startswith("term", F.lit(training.SOURCE_TERM))
    kind = F.when(source, "source").otherwise("keyword")
    term = F.when(source, F.substring("term", len(training.SOURCE_TERM) + 1, 1000)).otherwise(F.col("term"))
    r = top.where(source | ~recipe.low_signal()).select(kind.alias("kind"), term.alias("term"), "class", F.round("weight", 4).cast("decimal(18,4)").alias("weight"))
    spark = entries.sparkSession
    reasons = labels.where(F.col("profile_id") == profile_id)
    r = cut(recipe.add_priors(recipe.reasoning_boost(r, reasons), recipe.template_priors(spark, patterns)))
    scored = recipe.class_scores_of_tokens(learnt.tokens, r) if words is recipe_words else None
    r = recipe.normalise(r, recipe.upper_median(scored if scored is not None else recipe.class_scores(entries, r)))
    return recipe.stabilise(r), learnt.head, learnt
