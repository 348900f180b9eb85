"""Queries of single reads and changes of the store, of codecs, and of a whole machine-label run."""

from __future__ import annotations

import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import explain, features, machine_labels, queries, recipe, sampler, store, training
from tidemark.plans import core as C
from tidemark.plans import more as M
from tidemark.schemas import CLASSES, KEY, LABEL_KEY
from tidemark.sources.tables import table
from tidemark.streaming import ingest

Q: dict = {}
SQL: dict[str, str] = {}
_P = C.PROFILE


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- reads


@query(f"WITH {C.E} SELECT entry_type, entry_id, published_date FROM e ORDER BY published_date DESC NULLS LAST, entry_type, entry_id")
def q77_entries_in_order(spark, d):
    return C.entries(spark, d, "published_date").orderBy(*queries.newest())


@query("SELECT id, slug, is_default FROM profiles ORDER BY is_default DESC NULLS LAST, id LIMIT 1")
def q77_default_profile(spark, d):
    return queries.profile(table(spark, d, "profiles")).select("id", "slug", "is_default")


@query("SELECT id, slug FROM profiles WHERE slug = (SELECT max(slug) FROM profiles)")
def q77_profile_by_slug(spark, d):
    p = table(spark, d, "profiles")
    return queries.profile(p, slug=p.agg(F.max("slug")).first()[0]).select("id", "slug")


@query("SELECT id, slug, display_name FROM profiles ORDER BY is_default DESC NULLS LAST, id")
def q77_profiles_in_order(spark, d):
    return queries.profiles_in_order(table(spark, d, "profiles")).select("id", "slug", "display_name")


@query(f"SELECT id, version, accuracy FROM models WHERE profile_id = {_P} ORDER BY version DESC, id DESC")
def q77_models_in_order(spark, d):
    return queries.models_in_order(table(spark, d, "models"), _P).select("id", "version", "accuracy")


@query(f"WITH {C.E} SELECT entry_type, entry_id, title, link FROM e WHERE EXISTS (SELECT 1 FROM remote_labels r WHERE r.entry_type = e.entry_type AND r.entry_id = e.entry_id)")
def q78_lookup(spark, d):
    return queries.lookup(C.entries(spark, d, "title", "link"), table(spark, d, "remote_labels"))


@query(f"WITH {C.L}, k AS (SELECT DISTINCT entry_type, entry_id FROM remote_labels) SELECT k.entry_type, k.entry_id, label, reasoning FROM k LEFT JOIN l ON l.profile_id = {_P} AND l.entry_type = k.entry_type AND l.entry_id = k.entry_id")
def q78_label_of(spark, d):
    return queries.label_of(table(spark, d, "labels"), _P, table(spark, d, "remote_labels"))


@query(f"WITH {C.E} SELECT entry_type, entry_id FROM e WHERE entry_type = 'feed_item'")
def q78_entries_of_type(spark, d):
    return queries.of_type(C.entries(spark, d, "published_date"), "news").select(*KEY)


@query(f"""WITH {C.E}, {C.L}, {M._FREE}, n AS (SELECT * FROM fr ORDER BY published_date DESC NULLS LAST, entry_type, entry_id LIMIT 500)
 SELECT entry_type, entry_id FROM n ORDER BY md5(entry_type || '|' || entry_id || '|7'), entry_type, entry_id LIMIT 20""")
def q78_shuffled_page(spark, d):
    return sampler.shuffled_page(C.entries(spark, d, "published_date"), table(spark, d, "labels"), _P, 7)


# ---------------------------------------------------------------- changes


@query(f"WITH {C.L} SELECT profile_id, label, count(*) AS n FROM l WHERE NOT (profile_id = {_P} AND EXISTS (SELECT 1 FROM remote_labels r WHERE r.entry_type = l.entry_type AND r.entry_id = l.entry_id)) GROUP BY ALL")
def q79_remove_labels(spark, d):
    keys = table(spark, d, "remote_labels").select(F.lit(_P).cast("long").alias("profile_id"), *KEY)
    return store.remove_labels(C.labels(spark, d), keys).groupBy("profile_id", "label").agg(F.count("*").alias("n"))


@query(f"WITH {C.E} SELECT entry_type, entry_id, CASE WHEN EXISTS (SELECT 1 FROM remote_labels r WHERE r.entry_type = e.entry_type AND r.entry_id = e.entry_id) THEN 2 ELSE coalesce(len(embedding), -1) END AS dim FROM e")
def q79_set_embeddings(spark, d):
    v = table(spark, d, "remote_labels").select(*KEY, F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>").alias("embedding"))
    return store.set_embeddings(C.entries(spark, d, "embedding"), v).select(*KEY, F.when(F.col("embedding").isNull(), -1).otherwise(F.size("embedding")).cast("long").alias("dim"))


@query(f"WITH {C.E} SELECT count(*) AS n, CAST(0 AS BIGINT) AS vectors FROM e")
def q79_forget_embeddings(spark, d):
    return store.forget_embeddings(C.entries(spark, d, "embedding")).agg(F.count("*").alias("n"), F.count("embedding").alias("vectors"))


@query(f"SELECT id, profile_id, direction, items_count, details, synced_at FROM sync_log UNION ALL SELECT (SELECT max(id) + 1 FROM sync_log), NULL, 'pull', 3, '3 entries', '{C.NOW}'")
def q80_append_log(spark, d):
    log = table(spark, d, "sync_log")
    return store.append_log(log, None, "pull", 3, "3 entries", C.NOW).select("id", "profile_id", "direction", "items_count", "details", "synced_at")


@query(f"SELECT id, slug, display_name, is_default, created_at FROM profiles UNION ALL SELECT (SELECT max(id) + 1 FROM profiles), (SELECT min(slug) || '-1' FROM profiles), 'New', 0, '{C.NOW}'")
def q80_create_profile(spark, d):
    p = table(spark, d, "profiles")
    return store.create_profile(p, p.agg(F.min("slug")).first()[0], "New", C.NOW).select("id", "slug", "display_name", "is_default", "created_at")


@query("""WITH m AS (SELECT max(id) AS m FROM profiles) SELECT id, slug, CASE WHEN id = m THEN 'Renamed' ELSE display_name END AS display_name, CASE WHEN id = m THEN '#123456' ELSE accent_color END AS accent_color,
 CASE WHEN id = m THEN 1 ELSE 0 END AS is_default FROM profiles, m""")
def q80_update_profile(spark, d):
    p = table(spark, d, "profiles")
    last = p.agg(F.max("id")).first()[0]
    return store.update_profile(p, last, display_name="Renamed", accent_color="#123456", is_default=1, description=None).select("id", "slug", "display_name", "accent_color", "is_default")


@query("SELECT display_name AS model_name, description, created_at, id AS profile_id, slug FROM profiles WHERE id = 1")
def q80_profile_record(spark, d):
    return store.profile_record(table(spark, d, "profiles"), 1)


@query("SELECT CAST(id AS VARCHAR) AS id, slug, 'plain' AS tone FROM profiles")
def q80_migrate(spark, d):
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("slug", T.StringType()), T.StructField("tone", T.StringType())])
    return store.migrate(table(spark, d, "profiles"), schema, tone="plain").select("id", "slug", "tone")


@query(f"""WITH {C.L}, x AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entry_type, entry_id ORDER BY coalesce(labeled_at, '') DESC, label DESC) AS rn FROM remote_labels
 WHERE trim(coalesce(entry_type, '')) <> '' AND trim(coalesce(label, '')) <> '' AND coalesce(entry_id, 0) <> 0) WHERE rn = 1),
 a AS (SELECT x.entry_type, x.entry_id, x.label, coalesce(x.labeled_at, '') AS updated_at FROM x LEFT JOIN l ON l.profile_id = {_P} AND l.entry_type = x.entry_type AND l.entry_id = x.entry_id
 WHERE l.profile_id IS NULL OR coalesce(x.labeled_at, '') > coalesce(l.updated_at, ''))
 SELECT entry_type, entry_id, label, updated_at FROM a UNION ALL SELECT entry_type, entry_id, label, updated_at FROM l WHERE profile_id = {_P} AND NOT EXISTS (SELECT 1 FROM a WHERE a.entry_type = l.entry_type AND a.entry_id = l.entry_id)""")
def q81_labels_after_import(spark, d):
    out = store.merge_imported(C.labels(spark, d), table(spark, d, "remote_labels"), _P)
    return out.where(F.col("profile_id") == _P).select(*KEY, "label", "updated_at")


@query(f"WITH {C.E}, {C.L} SELECT entry_type, entry_id, CASE WHEN label IS NOT NULL THEN coalesce(title, '') || '!' ELSE title END AS title, CASE WHEN label IS NOT NULL THEN '' ELSE link END AS link FROM e LEFT JOIN (SELECT entry_type, entry_id, max(label) AS label FROM l WHERE profile_id = {_P} GROUP BY ALL) USING (entry_type, entry_id)")
def q81_entries_after_import(spark, d):
    e = C.entries(spark, d, "title", "link", "description", "content", "author", "published_date", "source_name", "source_category", "source_type", "fetched_at")
    pack = queries.labeled(e.select(*KEY, "title"), table(spark, d, "labels"), _P).select(*KEY, F.concat(F.coalesce("title", F.lit("")), F.lit("!")).alias("title"), F.col("user_label").alias("label"))
    return store.merge_imported_entries(e, pack, C.NOW).select(*KEY, "title", "link")


# ---------------------------------------------------------------- recipes, codecs, sums


@query(f"WITH {C.R} SELECT kind, term, class, CAST(weight AS DOUBLE) AS weight FROM r")
def q82_recipe_document(spark, d):
    """A recipe written as JSON and read back."""
    return recipe.from_document(spark, recipe.to_document(C.base_recipe(spark), 3)).withColumn("weight", F.col("weight").cast("double"))


@query(f"WITH {C.E}, {C.VEC} SELECT entry_type, entry_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS s FROM v")
def q82_vector_bytes(spark, d):
    """Vectors as bytes and back."""
    e = C.entries(spark, d, "embedding")
    ok = F.coalesce((F.size("embedding") == 64) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x)), F.lit(False))
    back = features.bytes_to_vector(features.vector_to_bytes(F.col("embedding")))
    return e.where(ok).select(*KEY, F.round(F.aggregate(back, F.lit(0.0), lambda a, x: a + x), 4).alias("s"))


@query(f"""WITH {C.E}, {C.VEC}, u AS (SELECT source_type, unnest(v.embedding) AS x, unnest(range(0, 64)) AS i, CASE WHEN e.entry_id % 3 = 0 THEN 0 ELSE 1 END AS m FROM v JOIN e USING (entry_type, entry_id) WHERE source_type IS NOT NULL),
 p AS (SELECT source_type, i, sum(CAST(x AS DOUBLE) * m) / greatest(sum(m), 1e-9) AS x FROM u GROUP BY ALL) SELECT source_type, round(sum(x), 4) AS s, round(max(CASE WHEN i = 5 THEN x END), 4) AS fifth FROM p GROUP BY ALL""")
def q82_mean_pool(spark, d):
    e = C.entries(spark, d, "embedding", "source_type").where("source_type IS NOT NULL")
    ok = F.coalesce((F.size("embedding") == 64) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x)), F.lit(False))
    tokens = e.where(ok).select("source_type", F.transform("embedding", lambda x: x.cast("double")).alias("v"), F.when(F.col("entry_id") % 3 == 0, 0).otherwise(1).alias("m"))
    p = features.mean_pool(tokens, ["source_type"], "v", "m")
    return p.select("source_type", F.round(F.aggregate("pooled", F.lit(0.0), lambda a, x: a + x), 4).alias("s"), F.round(F.col("pooled")[5], 4).alias("fifth"))


@query(f"""WITH {C.ALL_R}, k AS (SELECT h.entry_type, h.entry_id, CAST(weight * n AS DECIMAL(18,4)) AS x FROM h JOIN rs USING (entry_type, entry_id) JOIN r ON r.kind = 'keyword' AND r.term = h.term AND r.class = rs.predicted_label),
 n AS (SELECT entry_type, entry_id, least(8, count(*)) AS n FROM k WHERE abs(x) > 0.001 GROUP BY ALL)
 SELECT rs.entry_type, rs.entry_id, predicted_label AS prediction, greatest({", ".join(f"p_{c}" for c in CLASSES)}) AS confidence, relevance_score, CASE WHEN coalesce(n, 0) < 4 THEN coalesce(n, 0) + 4 ELSE n END AS n_features FROM rs LEFT JOIN n USING (entry_type, entry_id)""")
def q83_explanations(spark, d):
    e = C.entries(spark, d, "title", "description", "content", "source_type")
    r = C.base_recipe(spark)
    s = recipe.recipe_scores(e, r)
    x = explain.explanations(explain.explain_recipe(e, r, s), s)
    return x.select(*KEY, "prediction", "confidence", "relevance_score", F.size("top_features").cast("long").alias("n_features"))


@query(f"WITH {C.E}, {C.VEC}, {C.MODEL} SELECT entry_type, entry_id, {", ".join(f"round(ln(greatest(p[{i + 1}], 1e-9)), 4) AS log_{i}" for i in range(4))} FROM pr")
def q83_log_probabilities(spark, d):
    from tidemark.functions.scores import log_probabilities, softmax

    s = C.model_logits(spark, d).select(*KEY, softmax(F.col("logits"), C.T_MODEL).alias("p"))
    return s.select(*KEY, *[F.round(log_probabilities(F.col("p"))[i], 4).alias(f"log_{i}") for i in range(4)])


@query(f"""WITH {C.E}, {C.L}, {C._MINE}, {C.VEC}, {C.MODEL} SELECT entry_type, entry_id, coalesce(mi.label, ms.predicted_label) AS label FROM e LEFT JOIN mi USING (entry_type, entry_id) LEFT JOIN ms USING (entry_type, entry_id) WHERE coalesce(mi.label, ms.predicted_label) IS NOT NULL""")
def q83_teacher_labels(spark, d):
    mine = C.labels(spark, d).where((F.col("profile_id") == _P) & store.confirmed())
    return training.teacher_labels(C.entries(spark, d, "source_type"), mine, C.model_scores(spark, d)).select(*KEY, "label")


# ---------------------------------------------------------------- machine labels, queues


@query(f"WITH m AS ({M.SQL['q49_llm_batch_match']}) SELECT outcome, count(*) AS n FROM m GROUP BY ALL")
def q84_outcome_counts(spark, d):
    return machine_labels.outcome_counts(M.q49_llm_batch_match(spark, d))


class Echo:
    """A client that labels every item of a prompt by its number; leads get a reason only when asked alone, numbers ending in 9 no answer."""

    def ask(self, prompt: str) -> str:
        items = re.findall(r"entry_type: (\w+), entry_id: (\d+)$", prompt, re.M)
        said = []
        for kind, n in items:
            i = int(n)
            if i % 10 != 9:
                reason = "named" if i % 4 or len(items) == 1 else ""
                said.append(f'{{"entry_id": "{n}", "entry_type": "{kind}", "label": "{CLASSES[i % 4]}", "reasoning": "{reason}"}}')
        return '```json\n{"labels": [' + ",\n".join(said) + ",]}\n```"


@query(f"""WITH {C.E}, {C.L}, m AS (SELECT *, TRUE AS have FROM l WHERE profile_id = {_P}) SELECT entry_type, entry_id, CASE WHEN have IS NULL THEN CASE WHEN entry_id % 10 = 9 THEN 'no answer' ELSE 'labeled' END
 WHEN trim(coalesce(pending_job_id, '')) <> '' THEN 'waits for a decision' ELSE 'labelled' END AS outcome FROM e LEFT JOIN m USING (entry_type, entry_id)""")
def q84_run_batch(spark, d):
    """All eligible entries asked in chunks, failed ones once more alone, and what came of every entry."""
    e = C.entries(spark, d, "title", "description", "content", "source_name", "source_category", "link", "published_date")
    return machine_labels.run_batch(e, C.labels(spark, d), _P, "job", C.NOW, Echo)[1].select(*KEY, "outcome")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def q85_retry_queue(spark, d):
    """Of each sender the last send that waits."""
    e = table(spark, d, "events").select("user_id", "event_id", "ts", "event_type")
    return ingest.retry_queue(e, "ts", ["user_id"]).select("user_id", "event_id", "event_type")


@query(f"WITH {C.L} SELECT profile_id, entry_type, entry_id, label FROM l WHERE NOT EXISTS (SELECT 1 FROM remote_labels r WHERE r.entry_type = l.entry_type AND r.entry_id = l.entry_id)")
def q85_sent(spark, d):
    return ingest.sent(C.labels(spark, d), table(spark, d, "remote_labels")).select(*LABEL_KEY, "label")


QUERIES, ORACLE = Q, SQL
