import random

import pytest

from tidemark.llm.garble import CHAINS, Judge, affected, fit, garble, garbled_documents, restore

RIGHT = [
    "Die Behörde prüft den Müllvertrag für größere Betriebe und begründet das später",
    "«Das kostet uns 3 Franken», heißt es in Zürich, während die Anwältin schweigt",
    "L’avocate réclame le crédit énergétique après de longues délibérations à Genève",
    "La comisión aprobó el año pasado la inspección según señalan más informes",
    "Spółdzielnia zawiesza kredyt, ponieważ koszty wzrosły, mówią źródła w mieście Łódź",
    "In Ørsuholm gilt das über mehrere Wochen hinweg – und der Prüfer verschärft die Auflagen",
]


def corpus(n=400, seed=0):
    rng = random.Random(seed)
    return [" ".join(rng.choice(RIGHT) for _ in range(3)) for _ in range(n)]


@pytest.fixture(scope="module")
def judge():
    return fit(corpus())


@pytest.mark.parametrize("chain", CHAINS, ids=lambda c: "+".join(">".join(p) for p in c))
def test_chains_invert(chain):
    for t in RIGHT:
        bad = garble(t, chain)
        if bad is not None:
            assert restore(bad, chain) == t


@pytest.mark.parametrize("chain", [c for c in CHAINS if c[0][0] == "utf-8"] + [(("cp1252", "cp437"),), (("cp1252", "cp850"),), (("cp1252", "mac-roman"),)], ids=str)
def test_found_and_restored(judge, chain):
    t = "Ein Satz davor. " + RIGHT[0] + ". " + RIGHT[1]
    bad = garble(t, chain)
    found, lost = judge.text(bad)
    assert affected(found, lost)
    at, out = 0, ""
    for a, z, _, r in found:
        out += bad[at:a] + r
        at = z
    out += bad[at:]
    same = sum(x == y for x, y in zip(out.split(), t.split())) / len(t.split())
    assert same >= 0.9


@pytest.mark.parametrize(
    "text",
    [*RIGHT, "L’écran affichait « Ã© » au lieu de « é », selon Genève.", "Auf dem Ausdruck stand «Ã¶» statt «ö».", "The old display wrote “Ã¼” where “ü” was meant", "Ã, Õ, Ñ; Zürich", "LÉGENDE: É = Genève, Â = 2", "NÃO, JOSÃO DE SÃO", "│ 08:30 │\n├───────┼───────┤", "Привет Ελλάδα 日本語 שלום", "x²+y³≠√2 ± 5 µm", "", "plain ascii", "ä" * 20_000],
)
def test_right_text_is_left_alone(judge, text):
    assert not affected(*judge.text(text))


def test_lost_characters(judge):
    assert affected(*judge.text("der Pr�fer"))


def test_frame(spark):
    texts = corpus(200, 3)
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(500, "vorher richtig: " + garble(RIGHT[0], CHAINS[1]), 1), (501, None, 1), (502, "", 1), (503, "ascii only", 1), (504, "R�ckstand", 1), (None, garble(RIGHT[1], CHAINS[1]), 1), (500, "vorher richtig: " + garble(RIGHT[0], CHAINS[1]), 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, restored int")
    out = garbled_documents(df)
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, []).append(r)
    assert set(got) == {500, 504, None} and len(got[500]) == 2
    assert got[500][0].restored == "vorher richtig: " + RIGHT[0] and got[504][0].restored is None and got[504][0].lost == 1
    assert garbled_documents(df.limit(0)).count() == 0


def test_memo_does_not_change_answers(judge):
    w = garble("Behörde", CHAINS[0])
    assert judge.word(w) == judge.word(w) == Judge(judge.weight, judge.known).word(w)


def test_words_outside_the_sample_are_known(spark):
    """A short stretch in a one-byte chain is found if its word is met anywhere, not only in the fitting sample."""
    name = "Prüfmann"
    bad = garble(name, (("cp1252", "cp850"),))
    rows = [(i, t) for i, t in enumerate(corpus(400, 5))] + [(1000 + i, f"Die Firma nennt {name} im Bericht {i}") for i in range(3)] + [(2000, f"Der Verwalter hat {bad} genannt")]
    got = {r.doc_id: r.restored for r in garbled_documents(spark.createDataFrame(rows, "doc_id long, text string"), sample=100).collect()}
    assert got == {2000: f"Der Verwalter hat {name} genannt"}


def test_lost_characters_go_through_the_classifier(judge):
    assert all(affected(*judge.text(f"der Rat {w} heute")) for w in ("Pr�fung", "Stra��e", "caf�", "�ber"))
    assert not affected(*judge.text('das Zeichen "�" steht da'))  # quoted
    assert judge.lost("Zürich") == 0 and judge.lost("Z�rich") == 1
