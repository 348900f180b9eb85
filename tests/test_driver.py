import json
import random
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from tidemark.operators import driver, machine_labels, store
from tidemark.schemas import CLASSES, ENTRIES, LABELS

NOW = "2025-01-01 00:00:00"
WORDS = {c: [f"{c[:3]}{i}" for i in range(12)] for c in CLASSES}


def tables(spark, n=60, dim=8, missing=0):
    rng = random.Random(7)
    e, y = [], []
    for i in range(n):
        c = CLASSES[i % 4]
        v = None if i < missing else [float(4 * (k == i % 4)) + rng.random() for k in range(dim)]
        base = {f.name: None for f in ENTRIES.fields} | {"entry_type": "feed_item", "entry_id": i, "title": " ".join(rng.sample(WORDS[c], 6)), "content": "und der rat", "source_type": "rss" if i % 2 else "mail", "embedding": v}
        e.append(tuple(base[f.name] for f in ENTRIES.fields))
        label = {f.name: None for f in LABELS.fields} | {"profile_id": 1, "entry_type": "feed_item", "entry_id": i, "label": c, "updated_at": NOW, "reasoning": "wasser" if i % 8 == 0 else ""}
        y.append(tuple(label[f.name] for f in LABELS.fields))
    return spark.createDataFrame(e, ENTRIES), spark.createDataFrame(y, LABELS)


def test_gates(spark):
    e, y = tables(spark, 12)
    t = driver.train(e, y, 1, {"min_labels_to_train": 20}, NOW)
    assert (t.success, t.label_count, t.error) == (False, 12, "Need at least 20 labels to train. Currently have 12.")
    t = driver.train(e, y, 1, {"min_labels_to_train": 5, "embedding_dim": 99}, NOW)
    assert not t.success and "embeddings" in t.error


@pytest.mark.parametrize("arch", ["transformer", "tfidf"])
def test_each_architecture_learns(spark, arch):
    e, y = tables(spark)
    config = {"model_architecture": arch, "embedding_dim": 8}
    t = driver.train(e, y, 1, config, NOW, hidden=6, iterations=60)
    assert t.success and t.architecture == arch and t.split_note == "80/20 train/test split"
    assert t.metrics.where("class = 'macro'").first()["accuracy"] >= 0.9
    s = {r.entry_id: r.predicted_label for r in driver.score(e, t, config).collect()}
    assert sum(s[i] == CLASSES[i % 4] for i in s) >= 0.9 * 60 and len(s) == 60


def test_classes_of_one_row_are_trained_on_whole(spark):
    e, y = tables(spark, 21)
    y = y.where("label != 'noise' OR entry_id = 3")
    t = driver.train(e, y, 1, {"model_architecture": "tfidf", "min_labels_to_train": 5}, NOW, iterations=20)
    assert t.success and t.split_note.startswith("All data") and t.temperature == 1.0


def test_student(spark):
    e, y = tables(spark, 40)
    scores = spark.createDataFrame([("feed_item", i, CLASSES[i % 4]) for i in range(40)], "entry_type string, entry_id long, predicted_label string")
    r, head, _ = driver.distil(e, y.limit(10), scores, 1, ["Zollamt"], 40, iterations=50)
    rows = {(x.kind, x.term, x["class"]): float(x.weight) for x in r.collect()}
    assert all(abs(w) <= {"source": 0.08}.get(k[0], 0.24 if " " in k[1] else 0.12) for k, w in rows.items())
    assert any(k[1] in WORDS["noise"] and k[2] == "noise" and w > 0 for k, w in rows.items())
    assert ("keyword", "zollamt", CLASSES[0]) in rows and ("keyword", "third country", CLASSES[0]) in rows
    assert driver.distil(e.limit(5), y.limit(0), scores, 1, [])[0] is None


def test_profile_changes(spark):
    p = spark.createDataFrame([(1, "a", "A", None, "#fff", 1, NOW, "{}"), (2, "b", "B", "d", None, 0, NOW, "{}")], "id long, slug string, display_name string, description string, accent_color string, is_default long, created_at string, training_settings string")
    got = {r.id: r for r in store.update_profile(p, 2, slug="c", is_default=1, description=None, nothing=3).collect()}
    assert got[2].slug == "c" and got[2].description == "d" and (got[1].is_default, got[2].is_default) == (0, 1)
    with pytest.raises(ValueError):
        store.update_profile(p, 2, slug="a")
    new = store.set_profile_record(p, "Third", "", 3, "third", NOW).where("id = 3").first()
    assert (new.display_name, new.slug, new.is_default) == ("Third", "third", 1)
    assert store.profile_record(store.set_profile_record(p, "One", "x", 1, "", NOW), 1).first().model_name == "One"


def test_http_client():
    seen, replies = [], [(429, "slow down"), (200, '{"text": "one"}'), (400, "bad schema"), (200, '{"text": "two"}'), (400, "no"), (503, "down")]

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            status, text = replies.pop(0)
            self.send_response(status)
            self.end_headers()
            self.wfile.write(text.encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    client = machine_labels.HttpClient(f"http://127.0.0.1:{server.server_port}", machine_labels.Settings(), schema={"type": "object"})
    call = machine_labels.with_retries(client.ask, 1, 0)
    assert call("p") == "one" and call("p") == "two" and "schema" in seen[2] and "schema" not in seen[3]
    with pytest.raises(machine_labels.Refused, match="HTTP 400"):
        call("p")
    replies.append((503, "down"))
    with pytest.raises(machine_labels.Refused, match="HTTP 503"):
        call("p")
    assert not replies
    server.shutdown()
    assert machine_labels.passing(RuntimeError()) is False
