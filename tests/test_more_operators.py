"""Models, jobs, SQL functions, machine-label runs, lookups."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions.lenient_json import nested_text
from tidemark.functions.register import register
from tidemark.operators import jobs, machine_labels, queries, training
from tidemark.schemas import CLASSES, ENTRIES, KEY, LABELS, MODELS
from tidemark.sources import models

NOW = "2025-01-01 00:00:00"


def frame(spark, schema, *rows):
    base = {f.name: None for f in schema.fields}
    return spark.createDataFrame([tuple((base | r)[f.name] for f in schema.fields) for r in rows], schema)


def test_models_are_kept_by_profile_and_version(spark, tmp_path):
    from pyspark.ml.linalg import Vectors

    rows = spark.createDataFrame([("feed_item", i, CLASSES[i % 4], Vectors.dense([float(i % 4 == k) for k in range(4)])) for i in range(24)], ["entry_type", "entry_id", "label", "features"])
    m = training.fit_logistic(rows, iterations=20)
    root = str(tmp_path)
    a, b = (models.save_model(spark, root, p, 1, m, t) for p, t in ((1, 2.5), (2, 0.5)))
    assert a != b and models.load_temperature(spark, a) == 2.5 and models.load_temperature(spark, b) == 0.5
    assert models.load_temperature(spark, root + "/none") == 1.0 and models.load_temperature(spark, a, ["x"]) == 1.0
    s = training.calibrated(training.logits(models.load_model(root, 1, 1).transform(rows)))
    r = models.record(spark, frame(spark, MODELS), 1, 1, training.metrics(rows.join(s, KEY)), rows, "tfidf", NOW).first()
    assert r.id == 1 and r.label_count == 24 and json.loads(r.label_distribution)["noise"] == 6 and r.is_active == 1
    d = spark.createDataFrame([('{"noise": 0}', "broken", '{"noise": 3}')], "a string, b string, c string")
    assert d.select(models.distribution("a", "b", "c").alias("x")).first().x == '{"noise": 3}'


def test_sql_functions(spark):
    register(spark)
    r = spark.sql(
        "SELECT slugify(' Ä b ') s, label_entropy(array(0.5D, 0.5D)) e, label_softmax(array(1D, 1D)) p, label_relevance(array(1D, 0D, 0D, 0D)) r, recipe_words('Ein foo_bar Ü2') w, lenient_json('{\"a\": 1,}') j"
    ).first()
    assert (r.s, r.e, r.p, r.r, r.w, json.loads(r.j)) == ("b", 1.0, [0.5, 0.5], 1.0, ["ein", "ü2"], {"a": 1})
    assert [x.ngram for x in spark.sql("SELECT ngram FROM word_ngrams('A b c', 2) ORDER BY position").collect()] == ["a b", "b c"]


def test_student_has_phrases_of_three_and_the_whole_vocabulary(spark, data):
    from tidemark.plans import more

    _, weights, values = more._student(spark, data)
    terms = {r.term for r in weights.where("term != ''").select("term").distinct().collect()}
    assert any(t.count(" ") == 2 for t in terms) and len(terms) > 2000
    assert terms == {r.term for r in values.select("term").distinct().collect()}


def test_tfidf_grams_by_brute_force(spark, tmp_path):
    import math
    import re
    import unicodedata
    from collections import Counter

    from tidemark.plans import core

    texts = ["Été à Zürich heute", "ete a zurich morgen", "Ete in Bern heute", None]
    frame(spark, ENTRIES, *[{"id": i, "entry_type": "feed_item", "entry_id": i, "title": t, "fetched_at": NOW} for i, t in enumerate(texts)]).write.parquet(f"{tmp_path}/entries.parquet")
    grams = []
    for t in texts:
        w = re.findall(r"\b\w\w+\b", "".join(c for c in unicodedata.normalize("NFKD", t or "") if not unicodedata.combining(c)).lower())
        grams.append(Counter(" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)))
    df = Counter(g for c in grams for g in c)
    idf = {g: math.log(5 / (1 + n)) + 1 for g, n in df.items() if 2 <= n <= 0.95 * 4}
    got = {r.term: (r.df, r.idf) for r in core.QUERIES["q38_term_df_idf_grams"](spark, str(tmp_path)).collect()}
    assert got == {g: (df[g], round(x, 6)) for g, x in idf.items()} and "ete zurich" in got
    top = {(r.entry_id, r.term): r.value for r in core.QUERIES["q39_tfidf_l2_topterms_grams"](spark, str(tmp_path)).collect()}
    for i, c in enumerate(grams):
        x = {g: (1 + math.log(n)) * idf[g] for g, n in c.items() if g in idf}
        norm = math.sqrt(sum(v * v for v in x.values()))
        best = sorted(x, key=lambda g: (-round(x[g] / norm, 6), g))[:3]
        assert {g: v for (k, g), v in top.items() if k == i} == {g: round(x[g] / norm, 4) for g in best}


def test_embedder_reads_every_word():
    from tidemark.operators.features import hashing_embedder

    start = "word " * 256
    a, b = hashing_embedder()()([start, start + "quite another end"])
    assert (a != b).any()


def test_heads_have_the_full_size(spark, data, monkeypatch):
    from tidemark.plans import more

    asked = {}

    def head(name):
        def fit(*_, **sizes):
            asked[name] = sizes
            raise InterruptedError

        return fit

    for query, name in ((more.q59_train_lr, "fit_logistic"), (more.q60_train_mlp, "fit_mlp")):
        monkeypatch.setattr(training, name, head(name))
        with pytest.raises(InterruptedError):
            query(spark, data)
    assert asked == {"fit_logistic": {"iterations": 1000}, "fit_mlp": {"hidden": 256, "iterations": 500}}


def test_jobs(spark):
    reg = jobs.Jobs(spark)
    ok = reg.start("count", lambda j: (j.log("begin"), j.step(1, 1), spark.range(5).count())[-1])
    ok.thread.join(60)
    assert ok.state == "done" and ok.result == 5 and ok.logs and reg.get(ok.id) is ok and reg.cancel(ok.id) is False
    bad = reg.start("x", lambda j: 1 / 0)
    bad.thread.join(60)
    assert bad.state == "failed" and bad.error.startswith("ZeroDivisionError")

    def endless(j):
        while True:
            j.step(0, 1)

    long = reg.start("x", endless)
    while long.state != "running":
        pass
    assert reg.cancel(long.id)
    long.thread.join(60)
    assert long.state == "cancelled"


@pytest.mark.parametrize("lefts, rounds", [([5, 3, 0], 2), ([5, 5, 5, 5], 2), ([0], 0)])
def test_until_stalled(lefts, rounds):
    seen, did = iter(lefts), []
    jobs.until_stalled(lambda: next(seen), lambda: did.append(1))
    assert len(did) == rounds


def test_machine_label_run(spark):
    class Client:
        """Labels everything noise; the first entry a lead without a reason unless it is asked alone."""

        def ask(self, prompt):
            ids = [x.split("entry_id: ")[1].split("\n")[0] for x in prompt.split("entry_type: feed_item, ")[1:]]
            rows = [{"entry_id": i, "entry_type": "feed_item", "label": "investigation_lead" if i == "1" else "noise", "reasoning": "r" if len(ids) == 1 else ""} for i in ids]
            return json.dumps({"labels": rows})

    e = frame(spark, ENTRIES, *[{"entry_type": "feed_item", "entry_id": i, "title": f"t{i}"} for i in range(1, 15)])
    own = frame(spark, LABELS, {"profile_id": 1, "entry_type": "feed_item", "entry_id": 14, "label": "noise", "label_source": "manual"})
    pending, outcome = machine_labels.run_batch(e, own, 1, "job", NOW, Client)
    got = {r.entry_id: (r.label, r.pending_job_id) for r in pending.collect()}
    assert len(got) == 13 and got[1] == ("investigation_lead", "job") and got[2][0] == "noise"
    assert {r.entry_id: r.outcome for r in outcome.collect()}[14] == "labelled"


def test_lookups(spark, data):
    p = spark.read.parquet(f"{data}/profiles.parquet")
    assert queries.profile(p).first().is_default == 1 and queries.profile(p, slug="trade").first().id == 2 and queries.profile(p, 99).count() == 0
    assert queries.profiles_in_order(p).first().is_default == 1
    assert queries.models_in_order(spark.read.parquet(f"{data}/models.parquet"), 1).first().version > 1
    e = frame(spark, ENTRIES, {"entry_type": "email", "entry_id": 1}, {"entry_type": "email", "entry_id": 2})
    own = frame(spark, LABELS, {"profile_id": 1, "entry_type": "email", "entry_id": 1, "label": "noise"})
    keys = e.where("entry_id = 1").union(e.where("entry_id = 1"))
    assert queries.lookup(e, keys).count() == 1
    assert {r.entry_id: r.label for r in queries.label_of(own, 1, e).collect()} == {1: "noise", 2: None}
    assert queries.of_type(e, "news").count() == 0 and queries.of_type(e, "all").count() == 2


def test_nested_text(spark):
    d = spark.createDataFrame([('{"data": {"theme": {"accent": "#abc"}}}',), ('{"a":{"b":{"c":{"d":{"accent": "x"}}}}}',), ("broken",), (None,)], "v string")
    assert [r.x for r in d.select(nested_text(F.col("v"), ("accent_color", "accent")).alias("x")).collect()] == ["#abc", None, None, None]
