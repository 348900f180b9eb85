"""Unit tests on literal rows: the behaviour each operator promises."""

import json
import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scores as S
from tidemark.functions import text as X
from tidemark.functions.lenient_json import lenient_object, repair
from tidemark.operators import features, machine_labels, queries, recipe, sampler, store, training
from tidemark.schemas import CLASSES, ENTRIES, KEY, LABELS
from tidemark.sources import packages, settings, sites
from tidemark.sources.snapshots import SnapshotTable
from tidemark.streaming import ingest

NOW = "2025-01-01 00:00:00"


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, (str, type(None))) else 'double' if isinstance(v, float) else 'array<double>' if isinstance(v, list) else 'long'}" for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


def entries(spark, *rows):
    base = {f.name: None for f in ENTRIES.fields}
    return spark.createDataFrame([tuple((base | r).values()) for r in rows], ENTRIES)


def labels(spark, *rows):
    base = {f.name: None for f in LABELS.fields} | {"profile_id": 1, "entry_type": "feed_item", "label": "noise", "updated_at": "2024-01-01 00:00:00"}
    return spark.createDataFrame([tuple((base | r)[f.name] for f in LABELS.fields) for r in rows], LABELS)


E1 = {"entry_type": "feed_item", "entry_id": 1, "title": "t", "description": "d", "content": "c", "source_name": "s", "embedding": [1.0, 2.0], "fetched_at": "2024-01-01 00:00:00"}


@pytest.mark.parametrize(
    "change, kept",
    [({}, True), ({"title": "u"}, False), ({"content": "x"}, False), ({"source_name": "z"}, False), ({"source_name": None}, False), ({"title": None}, True), ({"link": "l", "author": "a", "published_date": "p"}, True)],
)
def test_upsert_keeps_or_drops_the_vector(spark, change, kept):
    out = store.upsert_entries(entries(spark, E1), entries(spark, E1 | change | {"embedding": None}), NOW).first()
    assert (out.embedding is not None) == kept and out.fetched_at == NOW


def test_upsert_last_row_wins_and_new_rows_have_no_vector(spark):
    delta = entries(spark, E1 | {"entry_id": 2, "title": "old", "fetched_at": "1"}, E1 | {"entry_id": 2, "title": "new", "fetched_at": "2"})
    out = {r.entry_id: r for r in store.upsert_entries(entries(spark, E1), delta, NOW).collect()}
    assert out[2].title == "new" and out[2].embedding is None and out[1].fetched_at == E1["fetched_at"]


def test_merge_newer_wins(spark):
    local = labels(spark, {"entry_id": 600, "label": "noise", "updated_at": "2024-01-01"}, {"entry_id": 700, "label": "important", "updated_at": "2024-06-01"})
    remote = spark.createDataFrame(
        [("feed_item", 500, "background", "", "2024-02-01"), ("feed_item", 600, "important", "r", "2024-03-01"), ("feed_item", 700, "noise", "", "2024-02-01"), ("feed_item", 0, "noise", "", "x"), ("", 5, "noise", "", "x"), ("feed_item", 8, " ", "", "x")],
        "entry_type string, entry_id long, label string, reasoning string, labeled_at string",
    )
    m = store.merge_remote_labels(local, remote, 1)
    assert {r.entry_id: (r.action, r.conflict) for r in m.collect()} == {500: ("new", False), 600: ("updated", True), 700: ("kept", True)}
    after = store.apply_merge(local, m, 1, NOW)
    assert {r.entry_id: r.label for r in after.collect()} == {500: "background", 600: "important", 700: "important"}
    assert {r.action for r in store.merge_remote_labels(after, remote, 1).collect()} == {"kept"}  # a second pull changes nothing


def test_two_users_converge(spark):
    a = labels(spark, {"entry_id": 1, "label": "noise", "updated_at": "2024-01-01"})
    b = labels(spark, {"entry_id": 1, "label": "important", "updated_at": "2024-02-01"})
    wire = lambda t: t.select(*KEY, "label", "reasoning", F.col("updated_at").alias("labeled_at"))
    a2 = store.apply_merge(a, store.merge_remote_labels(a, wire(b), 1), 1, NOW, keep_remote_time=True)
    b2 = store.apply_merge(b, store.merge_remote_labels(b, wire(a), 1), 1, NOW, keep_remote_time=True)
    assert a2.first().label == b2.first().label == "important"


def test_pending(spark):
    t = labels(spark, {"entry_id": 1, "pending_job_id": "j"}, {"entry_id": 2, "pending_job_id": " "}, {"entry_id": 3})
    assert t.where(store.confirmed()).count() == 2
    assert store.confirm_job(t, 1, "j").where(store.confirmed()).count() == 3
    assert store.discard_job(t, 1, "j").count() == 2
    assert store.discard_job(t, 1, " ").count() == 3  # a blank job names none
    e = entries(spark, E1, E1 | {"entry_id": 4})
    assert queries.unlabeled(e, t, 1).count() == 1  # pending counts as labelled


def test_profiles(spark):
    p = spark.createDataFrame([], "id long, slug string, display_name string, is_default long, created_at string, training_settings string")
    for _ in range(3):
        p = store.create_profile(p, "desk", "Desk", NOW)
    assert [(r.slug, r.is_default) for r in p.orderBy("id").collect()] == [("desk", 1), ("desk-1", 0), ("desk-2", 0)]
    assert store.set_default_profile(p, 2).where("is_default = 1").first().id == 2
    assert store.delete_profile(1, profiles=p)["profiles"].count() == 2


def test_migrate(spark):
    old = spark.createDataFrame([("feed_item", 1, 9)], "entry_type string, ENTRY_ID int, extra int")
    new = store.migrate(old, LABELS, profile_id=1)
    assert new.columns[: len(LABELS.names)] == LABELS.names and new.first().profile_id == 1 and new.first().extra == 9


@pytest.mark.parametrize("raw, slug", [("  Müller & Söhne ", "m-ller-s-hne"), ("", "default"), (None, "default"), ("--A--", "a")])
def test_slugify(spark, raw, slug):
    assert one(spark, X.slugify(F.col("v")), v=raw) == slug


@pytest.mark.parametrize("raw, slug", [("https://www.a.ch/x/news-Water/index.php", "water"), ("a.ch", "a-ch"), ("https://www.b.org/", "b-org")])
def test_url_identity(spark, raw, slug):
    assert one(spark, X.url_identity(F.col("v"), "news-"), v=raw)["slug"] == slug


def test_tokenizers_differ(spark):
    assert one(spark, X.recipe_words(F.col("v")), v="Das foo_bar ist, 日本ab é a1!") == ["das", "ist", "a1"]
    assert one(spark, X.space_words(F.col("v")), v=" Das  ist, so! ") == ["das", "ist,", "so!"]
    assert one(spark, X.space_words(F.col("v")), v="  ") == []
    assert one(spark, X.ngrams(X.space_words(F.col("v"))), v="a b c") == ["a", "b", "c", "a b", "b c", "a b c"]


def test_signals_and_model_text(spark):
    e = entries(spark, E1 | {"title": "Drittland und Binnenmarkt", "description": None, "content": "x" * 700, "source_name": None})
    t = e.select(X.model_text(["Drittland", "Zoll", "Binnenmarkt", " ", "Drittland", "("]).alias("t")).first().t
    assert t.startswith("signals=Drittland, Binnenmarkt\n\nDrittland und Binnenmarkt\nDrittland") and t.endswith("\n" + "x" * 500)
    assert entries(spark, {"entry_type": "email", "entry_id": 1}).select(X.model_text([]).alias("t")).first().t == "(empty)"


def test_metacharacters_colours_percent(spark):
    assert one(spark, X.strip_metacharacters(F.col("v")), v=" CE-Kennzeichnung(?) ") == "ce-kennzeichnung"
    assert one(spark, X.hex_colour(F.col("v")), v="#ABC") == "#aabbcc" and one(spark, X.hex_colour(F.col("v")), v="xyz") is None
    assert one(spark, X.contrast(F.lit("#ffffff")), v="") == "#000000"
    assert one(spark, X.percent(F.col("v")), v=0.256) == "26%"
    assert one(spark, X.decode_feature(F.col("v")), v="source_type_rss") == "rss"
    assert one(spark, X.analysed_words(F.col("v")), v="Été à la plage_1") == ["ete", "la", "plage_1"]


def test_softmax_round_trip(spark):
    p = [0.5, 0.25, 0.2, 0.05]
    got = one(spark, S.softmax(S.log_probabilities(F.col("v"))), v=p)
    assert all(abs(a - b) < 1e-10 for a, b in zip(got, p))
    assert abs(one(spark, S.entropy(F.col("v")), v=[0.5, 0.5, 0.0, 0.0]) - 1) < 1e-12
    assert one(spark, S.argmax(F.col("v")), v=[0.1, 0.4, 0.4, 0.1]) == "important"
    assert abs(one(spark, S.relevance(F.col("v")), v=[0.25] * 4) - 0.4975) < 1e-12
    assert one(spark, S.lead_blend(F.lit(0.5), F.lit(1.0), 9), v="") == 0.625


@pytest.mark.parametrize("n, k", [(0, 200), (700, 270), (1000, 300), (2000, 400), (9000, 400)])
def test_suggested_keywords(spark, n, k):
    assert one(spark, S.suggested_keywords(F.col("v")), v=n) == k


def test_sample_weights(spark):
    rows = labels(spark, {"entry_id": 1, "updated_at": "2024-05-06 00:00:00"}, {"entry_id": 2, "updated_at": NOW, "reasoning": "r"}, {"entry_id": 3, "updated_at": "junk"})
    w = {r.entry_id: r.weight for r in training.sample_weights(rows, NOW, 120, 0.25, 1.5).collect()}
    assert 0.24 <= w[1] <= 0.26 and w[2] == 1.5 and w[3] == 1.0
    assert {r.weight for r in training.sample_weights(rows, NOW).collect()} == {1.0}
    assert {r.weight for r in training.sample_weights(rows, NOW, reasoning_boost=0).collect()} == {1.0}


@pytest.mark.parametrize("v", ["2024-01-02 03:04:05", "2024-01-02T03:04:05", "2024-01-02T03:04:05Z", "1704164645"])
def test_label_times(spark, v):
    assert one(spark, F.unix_seconds(S.parse_label_time(F.col("v"))), v=v) == 1704164645
    assert one(spark, S.parse_label_time(F.col("v")), v="soon") is None


def test_recipe_scores(spark):
    e = entries(spark, E1 | {"title": "budget budget", "content": None, "description": ""}, E1 | {"entry_id": 2, "title": "weather", "content": "", "description": None})
    r = recipe.from_rows(spark, [("keyword", "budget", "investigation_lead", "1.0"), ("keyword", "budget budget", "noise", "-0.5")])
    s = {x.entry_id: x for x in recipe.recipe_scores(e, r).collect()}
    assert s[2].relevance_score == 0.4975 and s[2].predicted_label == CLASSES[0] and s[1].relevance_score > 0.8
    c = recipe.class_scores(e, r).where("entry_id = 1").first()
    assert float(c.investigation_lead) == 2.0 and float(c.noise) == -0.5


def test_normalise_keeps_short_and_long_texts_close(spark):
    r = recipe.from_rows(spark, [("keyword", "zoll", "important", "0.5")])
    e = entries(spark, E1 | {"title": "zoll"}, E1 | {"entry_id": 2, "title": "zoll " * 3})
    m = recipe.upper_median(recipe.class_scores(e, r))
    assert float(m.first().median) == 1.5  # the element n // 2
    assert float(recipe.normalise(r, m).first().weight) == round(0.5 * 2 / 1.5, 4)
    none = recipe.upper_median(recipe.class_scores(e.limit(0), r))
    assert float(recipe.normalise(r, none).first().weight) == 0.5


def test_signed_top_and_caps(spark):
    w = spark.createDataFrame([("a", f"p{i}", float(i)) for i in range(1, 6)] + [("a", "n1", -1.0)], "class string, term string, weight double")
    assert {r.term for r in recipe.signed_top(w, 4).collect()} == {"p5", "p4", "n1", "p3"}
    r = recipe.from_rows(spark, [("keyword", "a b", "noise", "9"), ("keyword", "ab", "noise", "-9"), ("source", "rss", "noise", "9"), ("keyword", "c", "noise", "0.001")])
    assert {x.term: float(x.weight) for x in recipe.stabilise(r).collect()} == {"a b": 0.24, "ab": -0.12, "rss": 0.08}


def test_reasoning_boost(spark):
    r = recipe.from_rows(spark, [("keyword", "zoll", "important", "0.2")])
    rows = labels(spark, {"entry_id": 1, "label": "important", "reasoning": "zoll zoll"}, {"entry_id": 2, "label": "noise", "reasoning": "zoll wasser"})
    out = {(x.term, x["class"]): float(x.weight) for x in recipe.reasoning_boost(r, rows).collect()}
    assert out["zoll", "important"] == 0.45 and out["zoll", "noise"] == 0.12 and out["wasser", "noise"] == 0.1 and out["zoll wasser", "noise"] == 0.16


def test_patterns_enter_the_recipe(spark):
    p = recipe.pattern_priors(spark, ["CE-Kennzeichnung", "  "])
    assert {(x.term, x["class"]): float(x.weight) for x in p.collect()} == {("ce-kennzeichnung", CLASSES[0]): 0.35, ("ce-kennzeichnung", CLASSES[1]): 0.15}


def test_recipe_document(spark):
    r = recipe.from_rows(spark, [("keyword", 'a "b"', "noise", "0.5"), ("source", "rss", "noise", "-0.25")])
    text = recipe.to_document(r, 3)
    doc = json.loads(text.first().value)
    assert doc["keywords"] == {'a "b"': {"noise": 0.5}} and doc["source_weights"] == {"rss": {"noise": -0.25}} and doc["version"] == 3
    assert sorted(map(tuple, recipe.from_document(spark, text).collect())) == sorted(map(tuple, r.collect()))
    assert recipe.from_document(spark, spark.createDataFrame([("{broken",)], "value string")).count() == 0


def test_tfidf_matches_by_hand(spark):
    e = entries(spark, E1 | {"title": "aa bb", "description": "", "content": "aa"}, E1 | {"entry_id": 2, "title": "aa cc", "description": "", "content": "cc"})
    values, voc = features.fit_tfidf(e, X.full_text(), (1,), X.recipe_words)
    idf = {r.term: r.idf for r in voc.collect()}
    assert abs(idf["aa"] - 1.0) < 1e-12 and abs(idf["bb"] - (math.log(3 / 2) + 1)) < 1e-12
    v = {(r.entry_id, r.term): r.value for r in values.collect()}
    x, y = (1 + math.log(2)) * 1.0, idf["bb"]
    assert abs(v[1, "aa"] - x / math.hypot(x, y)) < 1e-9


def test_split_replicate_oversample(spark):
    rows = spark.createDataFrame([("feed_item", i, "a" if i < 15 else "b") for i in range(20)], "entry_type string, entry_id long, label string")
    s = training.stratified_split(rows, "label", 0.2, 1)
    assert {r.label: r.n for r in s.where("is_test = 1").groupBy("label").agg(F.count("*").alias("n")).collect()} == {"a": 3, "b": 1}
    assert {r.label: r.n for r in training.oversample(rows, "label").groupBy("label").agg(F.count("*").alias("n")).collect()} == {"a": 15, "b": 15}
    w = rows.withColumn("weight", F.when(F.col("label") == "a", 1.0).otherwise(9.0))
    assert training.replicate(w).count() == 15 + 5 * 5
    assert training.stratified_split(rows.limit(0), "label", 0.2, 1).count() == 0


def test_metrics_and_temperature(spark):
    p = spark.createDataFrame([("noise", "noise"), ("noise", "important"), ("important", "important")], "label string, predicted_label string")
    m = {r["class"]: r for r in training.metrics(p).collect()}
    assert m["noise"].recall == 0.5 and m["macro"].accuracy == 0.6667 and m["important"].precision == 0.5
    rows = spark.createDataFrame([([8.0, 0.0, 0.0, 0.0], "background")] * 3 + [([8.0, 0.0, 0.0, 0.0], "noise")] * 3, "logits array<double>, label string")
    assert training.fit_temperature(rows) > 5  # over-confident logits are flattened
    assert training.fit_temperature(rows.limit(2)) == 1.0
    assert training.fit_temperature(rows.withColumn("label", F.lit("other"))) == 1.0


def test_heads_learn(spark):
    from pyspark.ml.linalg import Vectors

    rows = spark.createDataFrame([("feed_item", i, CLASSES[i % 4], Vectors.dense([float(i % 4 == k) + 0.01 * i for k in range(4)])) for i in range(40)], ["entry_type", "entry_id", "label", "features"])
    for model in (training.fit_logistic(rows, iterations=100), training.fit_mlp(rows, hidden=8, iterations=60)):
        s = training.calibrated(training.logits(model.transform(rows)))
        assert training.metrics(rows.join(s, KEY)).where("class = 'macro'").first().accuracy > 0.9
        assert s.where("relevance_score < 0 OR relevance_score > 1").count() == 0


def test_pools_claim_in_order(spark):
    rows = spark.createDataFrame([("feed_item", 1, "new", 1), ("feed_item", 1, "conflict", 1), ("feed_item", 2, "new", 2)], "entry_type string, entry_id long, pool string, rank int")
    assert [(r.entry_id, r.pool) for r in sampler.merge_pools(rows, 5).orderBy("place").collect()] == [(1, "conflict"), (2, "new")]


def test_vectors_and_pooling(spark):
    df = spark.createDataFrame([([1.0, 2.0],), (None,)], "v array<float>")
    back = df.select(features.bytes_to_vector(features.vector_to_bytes(F.col("v"))).alias("v")).collect()
    assert back[0].v == [1.0, 2.0] and back[1].v is None
    t = spark.createDataFrame([("a", 1, [1.0, 3.0], 1), ("a", 1, [3.0, 5.0], 1), ("a", 1, [9.0, 9.0], 0)], "entry_type string, entry_id long, vec array<double>, m int")
    assert features.mean_pool(t, KEY, "vec", "m").first().pooled == [2.0, 4.0]
    e = features.embed(spark.createDataFrame([("a b",), ("",)], "t string"), F.col("t"), dim=8)
    assert [len(r.embedding) for r in e.collect()] == [8, 8]


@pytest.mark.parametrize(
    "text, value",
    [('{"a": 1}', {"a": 1}), ('```json\n{"a": 1}\n```', {"a": 1}), ('{"a": [1, 2,],}', {"a": [1, 2]}), ('{"a": 1\n"b": 2}', {"a": 1, "b": 2}), ('{"a": {"b": "x', {"a": {"b": "x"}}), ("[1]", None), ("", None), (None, None), ("no", None)],
)
def test_lenient_json(spark, text, value):
    got = one(spark, lenient_object(F.col("v")), v=text)
    assert (json.loads(got) if got else None) == value
    assert (json.loads(repair(text)) if repair(text) else None) == value


def test_machine_labels(spark):
    e = entries(spark, *[E1 | {"entry_id": i} for i in range(1, 13)])
    p = machine_labels.batch_prompts(e.coalesce(1))
    assert sorted(len(r["keys"]) for r in p.collect()) == [2, 10]
    reply = '{"labels": [{"entry_id": 1, "entry_type": "feed_item", "label": "noise", "reasoning": ""}, {"entry_id": "2", "entry_type": "feed_item", "label": "investigation_lead", "reasoning": " "}, {"entry_id": 3, "entry_type": "feed_item", "label": "odd"},'
    got = machine_labels.parse_replies(spark.createDataFrame([("c", reply)], "chunk_id string, reply string"))
    m = machine_labels.match(e, got)
    out = {r.entry_id: r.outcome for r in m.collect()}
    assert (out[1], out[2], out[3], out[4]) == ("labeled", "lead without reasoning", "unknown label", "no answer")
    assert machine_labels.to_retry(m).count() == 10
    assert machine_labels.pending_labels(m, 1, "job", NOW).first().pending_job_id == "job"

    class Broken:
        def ask(self, prompt):
            raise ValueError("no")

    assert machine_labels.ask(p, Broken).first().error == "ValueError: no"
    assert machine_labels.Settings.of({"timeout_s": "-5", "retries": "x"}) == machine_labels.Settings(timeout_s=1.0, retries=2)


def test_retries():
    calls = []

    def flaky(p):
        calls.append(p)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert machine_labels.with_retries(flaky, 2, 0)("p") == "ok" and len(calls) == 3


def test_settings(tmp_path):
    assert settings.patterns(["Drittland", "Binnenmarkt", "  ", "Drittland"]) == ["Drittland", "Binnenmarkt"] and settings.patterns("x") == ["x"]
    got = settings.limited({"label_time_decay_floor": 2.0, "reasoning_weight_boost": 10, "label_time_decay_days": 99999, "alert_threshold": 0, "discovery_lead_blend": -1})
    assert got == {"label_time_decay_floor": 1.0, "reasoning_weight_boost": 5.0, "label_time_decay_days": 3650, "alert_threshold": 0.75, "discovery_lead_blend": 0.0}
    f = tmp_path / "c.json"
    assert settings.load(str(f)) == settings.DEFAULTS
    settings.save(str(f), {"recipe_top_keywords": 10})
    assert settings.load(str(f))["recipe_top_keywords"] == 50
    assert settings.effective(settings.DEFAULTS, '{"alert_threshold": 0.5, "other": 1}')["alert_threshold"] == 0.5
    assert settings.set_active({}, 9, {1})["active_profile_id"] is None


def test_packages(spark, tmp_path):
    rows = labels(spark, {"entry_id": 1}, {"entry_id": 2, "label": "important", "reasoning": None}).select(*KEY, "label", "reasoning", "updated_at")
    head = packages.manifest("m", "u", 2, rows)
    head["label_distribution"]["noise"] = 5
    packages.write_package(str(tmp_path / "a.zip"), head, rows)
    (tmp_path / "b.zip").write_bytes(b"broken")
    s = {r.path[-5]: r for r in packages.summaries(spark, str(tmp_path)).collect()}
    assert s["a"].noise == 5 and s["a"].important == 1 and s["a"].label_count == 2 and not s["a"].errors and len(s["b"].errors) == 2
    assert packages.read_labels(spark, str(tmp_path)).count() == 2 and packages.list_packages(spark, str(tmp_path)).count() == 2
    assert packages.safe_path(str(tmp_path), "../x.zip") is None and packages.safe_path(str(tmp_path), "a.zip") is not None
    assert packages.accepts(2, 3) is False and packages.accepts(2, 3, True) and packages.accepts(1, None)


def test_sites(spark, tmp_path):
    f = tmp_path / "answer.json"
    f.write_text(json.dumps({"labels": [{"entry_type": "email", "entry_id": 7, "label": "noise", "labeled_at": "x"}, {"entry_type": "email", "entry_id": "bad"}, 5]}))
    assert [(r.entry_id, r.label) for r in sites.pull(spark, f.as_uri(), "labels").collect()] == [(7, "noise")]
    for doc, ok in (('{"status":"OK"}', True), ('{"data":{"success":true}}', True), ('{"status":"down"}', False), ("junk", False)):
        assert one(spark, sites.status_ok(F.col("v")), v=doc) is ok
    assert one(spark, sites.paired(F.col("v"), F.lit("")), v="u") is False
    assert sites.full_pull_limit(10) == 1000 and "since=x" in sites.address("https://a/b", "entries", "x")
    sites.to_outbox(sites.label_payload(labels(spark, {"entry_id": 1})), str(tmp_path / "out"))
    assert json.loads(spark.read.text(str(tmp_path / "out")).first().value)["entry_id"] == 1


def test_snapshots(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "t"))
    for i in range(3):
        t.write(spark.range(i + 1))
    assert t.version() == 3 and t.read().count() == 3 and t.read(1).count() == 1
    t.vacuum(1)
    assert t.read().count() == 3 and not (tmp_path / "t" / "v=1").exists()


def test_streams(spark, data, tmp_path):
    ev = spark.read.parquet(f"{data}/events.parquet")
    ev.repartition(2).write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "ev"))
    q = ingest.tumbling(stream, late="400 days").writeStream.outputMode("complete").format("memory").queryName("win").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("win").collect())) == sorted(map(tuple, ingest.tumbling(ev).collect()))
    assert ingest.sliding(ev).agg(F.sum("n")).first()[0] == 4 * ev.count()
    assert ingest.sessions(ev).agg(F.sum("n")).first()[0] == ev.count()
    stream = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "ev"))
    q = ingest.retry_queue(stream, "ts", ["user_id"]).writeStream.outputMode("complete").format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination()
    last = {}
    for r in ev.collect():
        last[r.user_id] = max(last.get(r.user_id, r), r, key=lambda x: (str(x.ts), x.event_id))
    got = {r.user_id: r for r in spark.table("once").collect()}
    assert got == last  # a corrected send replaces the one that waits
    assert ingest.sent(spark.table("once"), ev.where("user_id % 2 = 0"), ["user_id"]).where("user_id % 2 = 0").count() == 0


def test_latest_label_state(spark, tmp_path):
    rows = spark.createDataFrame([("email", 1, "noise", "", "2"), ("email", 1, "important", "", "1")], "entry_type string, entry_id long, label string, reasoning string, labeled_at string")
    rows.write.parquet(str(tmp_path / "r"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "r"))
    q = ingest.latest_labels_state(stream).writeStream.outputMode("complete").format("memory").queryName("st").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("st").first().label == "noise" and ingest.latest_labels(rows).first().label == "noise"


def test_machine_batch_order(spark):
    q = spark.createDataFrame([("e", i, p, i) for i, p in enumerate(["uncertain", "uncertain", "conflict", "diverse", "new", "new"])], "entry_type string, entry_id long, pool string, place int")
    assert [r.entry_id for r in sampler.synthetic_rank(q, 5).orderBy("turn").collect()] == [0, 1, 4, 5, 2]
    assert sampler.machine_batch(0) == (1, 120) and sampler.machine_batch(80) == (80, 160) and sampler.machine_batch(999) == (200, 400)


def test_imported_labels_replace_older_ones(spark):
    local = labels(spark, {"entry_id": 1, "label": "noise", "updated_at": "2025-02"}, {"entry_id": 2, "label": "noise", "updated_at": "2025-04", "created_at": "2024"})
    rows = [("feed_item", 1, "important", "why", "2025-01", "t"), ("feed_item", 2, "odd", "x", "2025-05", None), ("feed_item", 3, "important", None, None, "new"), ("feed_item", 3, "noise", None, "2025", "newer"), ("feed_item", 4, " ", None, None, "t"), (None, 5, "noise", None, None, "t")]
    pack = spark.createDataFrame(rows, "entry_type string, entry_id long, label string, reasoning string, updated_at string, title string")
    assert {r.outcome: r.n for r in store.import_labels(local, pack, 1).collect()} == {"imported": 2, "updated": 1, "skipped": 3}
    got = {r.entry_id: (r.label, r.updated_at, r.created_at) for r in store.merge_imported(local, pack, 1).collect()}
    assert got[1][0] == "noise" and got[2] == ("odd", "2025-05", "2024") and got[3][:2] == ("noise", "2025") and len(got) == 3
    e = store.merge_imported_entries(entries(spark, {"entry_type": "feed_item", "entry_id": 1, "title": "old", "link": "l"}), pack, NOW)
    assert {(r.entry_id, r.title, r.link) for r in e.collect()} == {(1, "t", ""), (3, "newer", "")}
