"""The one-pass counts, vectors, sums and explanations of tokenised entries against the long forms, on odd texts."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.functions.text import full_text, recipe_words
from tidemark.operators import driver, explain, features, recipe, terms, training
from tidemark.schemas import CLASSES, KEY
from tidemark.session import cut

TEXTS = ["Budget und Budget, Ölpreis", "", None, "x", "budget", "der Rat der Rat der Rat", "a b c", "Été ÉTÉ été\tbudget\nund budget", "Ölpreis und"]


@pytest.fixture(scope="module")
def entries(spark):
    rng = random.Random(3)
    rows = [("feed_item", i, t, None, "", [None, "", "rss"][i % 3]) for i, t in enumerate(TEXTS)]
    rows += [("mail", i, " ".join(rng.choices(["rat", "der", "budget", "öl", "und", "zoll"], k=rng.randint(0, 9))), "und", " ".join(["viel"] * (i % 3)), "mail") for i in range(40)]
    return spark.createDataFrame(rows, "entry_type string, entry_id long, title string, description string, content string, source_type string")


@pytest.fixture(params=[1, 7, 1 << 19])
def piece(request, monkeypatch):
    monkeypatch.setattr(terms, "PIECE", request.param)


def tokens(entries):
    return cut(entries.select(*KEY, "source_type", training.source_name().alias("source"), recipe_words(full_text()).alias("words")))


def bags(entries):
    w = {(r.entry_type, r.entry_id): r.w for r in entries.select(*KEY, recipe_words(full_text()).alias("w")).collect()}
    return {k: Counter(" ".join(v[i : i + n]) for n in (1, 2, 3) for i in range(len(v) - n + 1)) for k, v in w.items()}


def test_frequencies(spark, entries, piece):
    df, cf = Counter(), Counter()
    for b in bags(entries).values():
        df.update(b.keys())
        cf.update(b)
    got = {r.term: (r.df, r.cf) for r in terms.term_frequencies(tokens(entries)).collect()}
    assert got == {t: (df[t], cf[t]) for t in df}


def test_numbers_beyond_64_bits_are_made_small():
    codes, row = np.array([5, 9, 5, 9, 5, 9, 5]), np.zeros(7, np.int64)
    for base in (10, 1 << 40):
        got = {n: key for n, key, _ in terms._grams(codes, row, base, (1, 2, 3))}
        assert [len(set(got[n].tolist())) for n in (1, 2, 3)] == [2, 2, 2] and (got[3][0] == got[3][2]) and (got[3][0] != got[3][1])


def test_vectors_equal_the_long_form(spark, entries, piece):
    values, vocabulary = training.text_values(entries, words=recipe_words)
    want = defaultdict(dict)
    for r in values.collect():
        want[r.entry_type, r.entry_id][r.term] = r.value
    v = sorted((r.term, r.idf) for r in vocabulary.collect())
    sources = ["mail", "rss", "unknown"]
    names = [t for t, _ in v] + [training.SOURCE_TERM + s for s in sources]
    plain, typed = training.stored_vectors(terms.tfidf_vectors(tokens(entries), [t for t, _ in v], [x for _, x in v], sources, KEY))
    got = {(r.entry_type, r.entry_id): dict(zip([names[i] for i in r.features.indices.tolist()], r.features.values.tolist())) for r in typed.collect()}
    assert got.keys() == want.keys() and all(got[k].keys() == want[k].keys() and all(math.isclose(got[k][t], want[k][t], rel_tol=1e-12) for t in got[k]) for k in got)
    assert all(r.features.indices == sorted(r.features.indices) for r in plain.collect())


def test_scores_of_tokens_are_exact_and_shuffle_no_term(spark, entries, piece):
    r = recipe.from_rows(spark, [("keyword", "der rat der", "noise", "-0.1234"), ("keyword", "budget", "important", "100000.0001"), ("keyword", "budget", "noise", "0.3000"), ("keyword", "und so  weiter geht es", "noise", "1"), ("source", "mail", "background", "0.0600")])
    s = recipe.class_scores_of_tokens(tokens(entries), r)
    assert s.dtypes == recipe.class_scores(entries, r).dtypes
    assert sorted(s.collect()) == sorted(recipe.class_scores(entries, r).collect())
    assert "Generate" not in s._jdf.queryExecution().toString()
    none = recipe.class_scores_of_tokens(tokens(entries), r.where("kind = 'source'"))
    assert sorted(none.collect()) == sorted(recipe.class_scores(entries, r.where("kind = 'source'")).collect())


def test_a_recipe_too_large_to_look_up_is_left_to_the_join(spark, entries, monkeypatch):
    monkeypatch.setattr(recipe, "LOOKUP_TERMS", 1)
    r = recipe.from_rows(spark, [("keyword", "rat", "noise", "0.1"), ("keyword", "budget", "important", "0.2")])
    assert recipe.class_scores_of_tokens(tokens(entries), r) is None


def test_explanation_by_brute_force(spark):
    rng, names = random.Random(5), [f"t{i}" for i in range(30)]
    w = {(c, t): rng.choice([-1, 1]) * rng.choice([0.0005, 0.02, 0.5, 0.50004, rng.random()]) for c in CLASSES for t in names if rng.random() < 0.8}
    rows, want = [], set()
    for k in range(60):
        at = sorted(rng.sample(range(30), rng.randint(0, 30)))
        values, c = [rng.choice([1.0, 0.5, rng.random()]) for _ in at], rng.choice([*CLASSES, None])
        rows.append(("mail", k, c, (0, 30, at, values)))
        adds = [(round(v * w.get((c, names[i]), 0.0), 4), names[i]) for i, v in zip(at, values)]
        for rank, (x, t) in enumerate(sorted((a for a in adds if abs(a[0]) > 0.001), key=lambda a: (-abs(a[0]), a[1]))[:8], 1):
            want.add(("mail", k, rank, t, x, "positive" if x > 0 else "negative"))
    vectors = spark.createDataFrame(rows, f"entry_type string, entry_id long, class string, features {terms.VECTOR}")
    head = spark.createDataFrame([(*k, x) for k, x in w.items()] + [("noise", "", 9.0)], "class string, term string, weight double")
    assert {tuple(r) for r in explain.explain_linear(vectors, names, head).collect()} == want


def test_q61_takes_texts_apart_once(spark, data, monkeypatch):
    """Before, every use of the texts was a table of all their terms."""
    import __spark_entry__

    def never(*_, **__):
        raise AssertionError("terms one row each")

    for module, name in ((features, "term_counts"), (recipe, "hits"), (features, "tfidf")):
        monkeypatch.setattr(module, name, never)
    r = __spark_entry__.queries()["q61_distill_student"](spark, data)
    assert r.columns == ["kind", "term", "class", "weight"] and r.count() > 0


def test_q65_makes_no_recipe(spark, data, monkeypatch):
    """Before, it also boosted, normalised and capped a recipe that it did not read."""
    import __spark_entry__

    def never(*_, **__):
        raise AssertionError("a recipe")

    monkeypatch.setattr(driver.recipe, "reasoning_boost", never)
    r = __spark_entry__.queries()["q65_explain_tfidf"](spark, data)
    assert r.columns == [*KEY, "rank", "feature", "weight", "direction"] and r.where("rank = 1").count() > 0
