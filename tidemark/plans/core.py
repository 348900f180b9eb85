"""Queries of the store, the recipes, training, sampling and explanation, with their SQL for a second engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scores as S
from tidemark.functions import text as X
from tidemark.operators import explain, features, queries, recipe, sampler, store, training
from tidemark.schemas import CLASSES, DECIMAL, KEY
from tidemark.sources.tables import table

NOW = "2025-12-01 00:00:00"
PROFILE = 1
JOB = "job-1"

#: The demonstration recipe: words and phrases of the test languages, and two sources.
RECIPE = [
    ("keyword", "budget", "important", "0.4000"), ("keyword", "budget", "noise", "-0.2000"), ("keyword", "permit", "important", "0.3500"),
    ("keyword", "kredit", "background", "0.1500"), ("keyword", "franken", "important", "0.2200"), ("keyword", "einsprachen", "investigation_lead", "0.6100"),
    ("keyword", "einsprachen liegen vor", "investigation_lead", "0.8000"), ("keyword", "das kostet uns", "noise", "0.3300"), ("keyword", "gutachten", "investigation_lead", "0.4500"),
    ("keyword", "recours", "investigation_lead", "0.5200"), ("keyword", "tribunal", "important", "0.2500"), ("keyword", "le tribunal", "important", "0.1800"),
    ("keyword", "commissione", "background", "0.2400"), ("keyword", "reglamento", "background", "0.2700"), ("keyword", "francs", "noise", "0.1100"),
    ("keyword", "behind closed doors", "investigation_lead", "0.9000"), ("keyword", "objections", "investigation_lead", "0.5000"), ("keyword", "audit office", "important", "0.5500"),
    ("keyword", "audit", "noise", "-0.3000"), ("keyword", "umowa", "important", "0.2600"), ("keyword", "contract", "background", "0.1200"), ("keyword", "de", "noise", "0.0500"),
    ("source", "rss", "background", "0.0600"), ("source", "mail", "noise", "0.1000"), ("source", "lex_eu", "important", "0.1500"),
]
PATTERNS = ["Franken", "audit office", r"tribun(al|e)", "Einsprache", "   ", "Franken", "huis clos", "recours ("]


def entries(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return store.current_entries(table(spark, d, "entries"), *cols)


def labels(spark: SparkSession, d: str) -> DataFrame:
    return store.current_labels(table(spark, d, "labels"))


def base_recipe(spark: SparkSession) -> DataFrame:
    return recipe.from_rows(spark, RECIPE)


def _recipe_sql() -> str:
    rows = ", ".join(f"('{k}', '{t}', '{c}', CAST({w} AS DECIMAL(18,4)))" for k, t, c, w in RECIPE)
    return f"r(kind, term, class, weight) AS (VALUES {rows})"


_COLS = "id, entry_type, entry_id, title, description, content, link, author, published_date, source_name, source_category, source_type, fetched_at, embedding"
E = f"e AS (SELECT {_COLS} FROM (SELECT *, row_number() OVER (PARTITION BY entry_type, entry_id ORDER BY fetched_at DESC NULLS LAST) AS rn FROM entries) WHERE rn = 1)"
L = "l AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY profile_id, entry_type, entry_id ORDER BY updated_at DESC NULLS LAST, created_at DESC NULLS LAST, label) AS rn FROM labels) WHERE rn = 1)"
OK = "trim(coalesce(pending_job_id, '')) = ''"
R = _recipe_sql()
WORDS = r"regexp_extract_all(lower({}), '[a-zA-Z0-9\x{{00C0}}-\x{{024F}}]{{2,}}')"
FULL = "coalesce(title, '') || ' ' || coalesce(description, '') || ' ' || coalesce(content, '')"
GRAMS = "list_concat(w, list_concat(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))"
TOK = f"tok AS (SELECT entry_type, entry_id, unnest({GRAMS}) AS term FROM (SELECT entry_type, entry_id, {WORDS.format(FULL)} AS w FROM e))"
HITS = "h AS (SELECT t.entry_type, t.entry_id, t.term, count(*) AS n FROM tok t WHERE t.term IN (SELECT term FROM r WHERE kind = 'keyword') GROUP BY ALL)"
_SUMS = ", ".join(f"coalesce(sum(CASE WHEN class = '{c}' THEN s END), 0) AS {c}" for c in CLASSES)
SCORE = f"""s AS (SELECT entry_type, entry_id, class, CAST(weight * n AS DECIMAL(18,4)) AS s FROM h JOIN r USING (term) WHERE kind = 'keyword'
    UNION ALL SELECT e.entry_type, e.entry_id, class, weight FROM e JOIN r ON r.kind = 'source' AND r.term = e.source_type),
 c AS (SELECT e.entry_type, e.entry_id, {_SUMS} FROM e LEFT JOIN s USING (entry_type, entry_id) GROUP BY ALL)"""
_E = " + ".join(f"exp(CAST({c} AS DOUBLE) - m)" for c in CLASSES)
SOFT = f"""z AS (SELECT *, CAST(greatest({", ".join(CLASSES)}) AS DOUBLE) AS m FROM c),
 p AS (SELECT entry_type, entry_id, {", ".join(f"exp(CAST({c} AS DOUBLE) - m) / ({_E}) AS p_{c}" for c in CLASSES)},
   CASE {" ".join(f"WHEN {c} = greatest({', '.join(CLASSES)}) THEN '{c}'" for c in CLASSES)} END AS predicted_label FROM z)"""
RECIPE_SCORES = f"rs AS (SELECT entry_type, entry_id, round(p_investigation_lead * 1.0 + p_important * 0.66 + p_background * 0.33, 4) AS relevance_score, predicted_label, {', '.join(f'round(p_{c}, 4) AS p_{c}' for c in CLASSES)} FROM p)"
ALL_R = f"{E}, {R}, {TOK}, {HITS}, {SCORE}, {SOFT}, {RECIPE_SCORES}"

# A fixed linear head over the vectors stands for a trained model, so its numbers are the same on any engine.
HEAD = training.HEAD_CLASSES
_W = [[((i * 31 + d * 17) % 13 - 6) / 10.0 for d in range(64)] for i in range(4)]
VEC = "v AS (SELECT entry_type, entry_id, embedding FROM e WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0)"
_LG = ", ".join(f"list_sum(list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) * ([{', '.join(map(str, w))}])[i]))" for w in _W)
T_MODEL = 2.0
MODEL = f"""lg AS (SELECT entry_type, entry_id, [{_LG}] AS lg FROM v),
 ex AS (SELECT entry_type, entry_id, list_transform(lg, lambda x: exp((x - list_max(lg)) / {T_MODEL})) AS x FROM lg),
 pr AS (SELECT entry_type, entry_id, list_transform(x, lambda y: y / list_sum(x)) AS p FROM ex),
 ms AS (SELECT entry_type, entry_id, round({" + ".join(f"p[{HEAD.index(c) + 1}] * {w}" for c, w in (("investigation_lead", 1.0), ("important", 0.66), ("background", 0.33)))}, 4) AS relevance_score,
   (['{"', '".join(HEAD)}'])[list_position(p, list_max(p))] AS predicted_label, {", ".join(f"round(p[{HEAD.index(c) + 1}], 4) AS p_{c}" for c in CLASSES)} FROM pr)"""


def model_logits(spark: SparkSession, d: str) -> DataFrame:
    e = entries(spark, d, "embedding")
    finite = (F.size("embedding") == 64) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x))
    dots = [F.aggregate(F.zip_with("embedding", F.array(*[F.lit(x) for x in w]), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda a, x: a + x) for w in _W]
    return e.where(F.coalesce(finite, F.lit(False))).select(*KEY, F.array(*dots).alias("logits"))


def model_scores(spark: SparkSession, d: str) -> DataFrame:
    return training.calibrated(model_logits(spark, d), T_MODEL)


Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- store reads


@query(f"WITH {E}, {L} SELECT entry_type, entry_id, published_date FROM e WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.profile_id = {PROFILE} AND l.entry_type = e.entry_type AND l.entry_id = e.entry_id)")
def q01_unlabeled_queue(spark, d):
    return queries.unlabeled(entries(spark, d, "published_date"), table(spark, d, "labels"), PROFILE)


@query(f"WITH {E}, {L} SELECT e.entry_type, e.entry_id, title, label AS user_label FROM e JOIN l USING (entry_type, entry_id) WHERE l.profile_id = {PROFILE}")
def q02_labeled_entries(spark, d):
    return queries.labeled(entries(spark, d, "title"), table(spark, d, "labels"), PROFILE)


@query(f"WITH {E}, {L} SELECT l.entry_type, l.entry_id, label, source_type, length({FULL}) AS n_chars FROM l JOIN e USING (entry_type, entry_id) WHERE l.profile_id = {PROFILE} AND {OK}")
def q03_training_set_confirmed(spark, d):
    e = entries(spark, d, "title", "description", "content", "source_type")
    rows = queries.training_rows(e, table(spark, d, "labels"), PROFILE)
    return rows.select(*KEY, "label", "source_type", F.length(X.full_text()).cast("long").alias("n_chars"))


_EXPORTED = ["title", "description", "content", "link", "author", "published_date", "source_name", "source_category", "source_type"]


@query(f"""WITH {E}, {L} SELECT l.entry_type, l.entry_id, label, reasoning, created_at, updated_at, {", ".join(_EXPORTED)},
 CASE WHEN trim(coalesce(label_source, '')) <> '' THEN label_source END AS source FROM l LEFT JOIN e USING (entry_type, entry_id) WHERE l.profile_id = {PROFILE}""")
def q04_export_labels(spark, d):
    rows = queries.export_rows(entries(spark, d, *_EXPORTED), table(spark, d, "labels"), PROFILE)
    return rows.select(*KEY, "label", "reasoning", "created_at", "updated_at", *_EXPORTED, "source")


@query(f"WITH {L} SELECT profile_id, label, count(*) AS n FROM l WHERE {OK} GROUP BY ALL")
def q05_label_distribution(spark, d):
    return queries.label_counts(table(spark, d, "labels"))


@query(f"""WITH {L}, g AS (SELECT DISTINCT profile_id FROM labels), k(label) AS (VALUES {", ".join(f"('{c}')" for c in CLASSES)})
 SELECT profile_id, label, count(l.label) AS n FROM g CROSS JOIN k LEFT JOIN (SELECT * FROM l WHERE {OK}) l USING (profile_id, label) GROUP BY ALL""")
def q06_label_distribution_zero_filled(spark, d):
    return queries.filled_distribution(table(spark, d, "labels"))


@query(f"WITH {E}, {L} SELECT profile_id, source_category, count(*) AS n FROM l JOIN e USING (entry_type, entry_id) WHERE {OK} AND trim(coalesce(source_category, '')) <> '' GROUP BY ALL")
def q07_category_label_counts(spark, d):
    return queries.category_counts(entries(spark, d, "source_category"), table(spark, d, "labels"))


@query(f"WITH {E} SELECT entry_type, entry_id, published_date, source_name FROM e WHERE published_date >= '2025-11-24'")
def q08_recent_entries(spark, d):
    return queries.recent(entries(spark, d, "published_date", "source_name"), NOW, 7)


# ---------------------------------------------------------------- store changes


def _changed(spark, d) -> tuple[DataFrame, DataFrame]:
    """The first delivery of every entry, and its last one with changed titles (rss) and categories (mail)."""
    raw = table(spark, d, "entries")
    base = store.keep_last(raw, KEY, F.col("fetched_at").asc_nulls_last())
    delta = store.keep_last(raw, KEY, F.col("fetched_at").desc_nulls_last())
    title = F.when(F.col("source_type") == "rss", F.concat("title", F.lit(" (updated)"))).otherwise(F.col("title"))
    category = F.when(F.col("source_type") == "mail", F.lit("moved")).otherwise(F.col("source_category"))
    return base, delta.withColumn("title", title).withColumn("source_category", category)


@query(f"""WITH {E}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entry_type, entry_id ORDER BY fetched_at ASC NULLS LAST) AS rn FROM entries) WHERE rn = 1),
 n AS (SELECT *, CASE WHEN source_type = 'rss' THEN title || ' (updated)' ELSE title END AS t2, CASE WHEN source_type = 'mail' THEN 'moved' ELSE source_category END AS c2 FROM e)
 SELECT n.entry_type, n.entry_id, n.t2 AS title, n.c2 AS source_category, '{NOW}' AS fetched_at,
 CASE WHEN f.embedding IS NOT NULL AND NOT (coalesce(f.title <> n.t2, FALSE) OR coalesce(f.source_category, '') <> coalesce(n.c2, '')) THEN 1 ELSE 0 END AS has_vector
 FROM n JOIN f USING (entry_type, entry_id)""")
def q09_upsert_invalidate(spark, d):
    base, delta = _changed(spark, d)
    out = store.upsert_entries(base, delta, NOW)
    return out.select(*KEY, "title", "source_category", "fetched_at", F.col("embedding").isNotNull().cast("int").alias("has_vector"))


_NEWEST_REMOTE = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entry_type, entry_id ORDER BY coalesce(labeled_at, '') DESC, label, coalesce(reasoning, '')) AS rn FROM remote_labels WHERE trim(coalesce(entry_type, '')) <> '' AND trim(coalesce(label, '')) <> '' AND coalesce(entry_id, 0) <> 0) WHERE rn = 1"


@query(f"""WITH {L}, x AS ({_NEWEST_REMOTE}) SELECT coalesce(l.profile_id, {PROFILE}) AS profile_id, coalesce(l.entry_type, x.entry_type) AS entry_type, coalesce(l.entry_id, x.entry_id) AS entry_id,
 coalesce(x.label, l.label) AS label, CASE WHEN x.label IS NOT NULL THEN '{NOW}' ELSE l.updated_at END AS updated_at, coalesce(l.created_at, '{NOW}') AS created_at
 FROM l FULL JOIN x ON l.profile_id = {PROFILE} AND l.entry_type = x.entry_type AND l.entry_id = x.entry_id""")
def q10_label_upsert_latest(spark, d):
    base = labels(spark, d)
    merged = store.merge_remote_labels(base, table(spark, d, "remote_labels"), PROFILE)
    delta = merged.select(
        F.lit(PROFILE).cast("long").alias("profile_id"), *KEY, F.col("remote_label").alias("label"), F.col("remote_reasoning").alias("reasoning"), F.lit("remote").alias("label_source"),
        F.lit(None).cast("string").alias("pending_job_id"), F.lit(None).cast("string").alias("created_at"), F.col("remote_time").alias("updated_at"),
    )
    return store.upsert_labels(base, delta, NOW).select("profile_id", *KEY, "label", "updated_at", "created_at")


_PENDING = "(SELECT min(trim(pending_job_id)) FROM labels WHERE trim(coalesce(pending_job_id, '')) <> '')"


def _some_job(spark, d) -> tuple[int, str]:
    r = table(spark, d, "labels").where(~store.confirmed()).agg(F.min(F.trim("pending_job_id")).alias("j")).first()
    return PROFILE, r["j"] or ""


@query(f"WITH {L} SELECT profile_id, {OK} OR (profile_id = {PROFILE} AND trim(pending_job_id) = {_PENDING}) AS confirmed, count(*) AS n FROM l GROUP BY ALL")
def q11_confirm_pending(spark, d):
    out = store.confirm_job(labels(spark, d), *_some_job(spark, d))
    return out.groupBy("profile_id", store.confirmed().alias("confirmed")).agg(F.count("*").alias("n"))


@query(f"WITH {L} SELECT profile_id, label, count(*) AS n FROM l WHERE NOT coalesce(profile_id = {PROFILE} AND trim(coalesce(pending_job_id, '')) = {_PENDING}, FALSE) GROUP BY ALL")
def q12_discard_pending(spark, d):
    return store.discard_job(labels(spark, d), *_some_job(spark, d)).groupBy("profile_id", "label").agg(F.count("*").alias("n"))


@query(f"""WITH {L}, m AS (SELECT * FROM l WHERE profile_id = {PROFILE}) SELECT outcome, count(*) AS n FROM (SELECT CASE
 WHEN NOT (trim(coalesce(x.entry_type, '')) <> '' AND trim(coalesce(x.label, '')) <> '' AND coalesce(x.entry_id, 0) <> 0) THEN 'skipped'
 WHEN m.label IS NULL AND m.profile_id IS NULL THEN 'imported' WHEN coalesce(x.labeled_at, '') > coalesce(m.updated_at, '') THEN 'updated' ELSE 'skipped' END AS outcome
 FROM remote_labels x LEFT JOIN m ON m.entry_type = x.entry_type AND m.entry_id = x.entry_id) GROUP BY ALL""")
def q13_import_labels_merge(spark, d):
    return store.import_labels(table(spark, d, "labels"), table(spark, d, "remote_labels"), PROFILE)


_MERGE = f"""x AS ({_NEWEST_REMOTE}), mg AS (SELECT x.entry_type, x.entry_id, x.label AS remote_label, l.label AS local_label,
 CASE WHEN l.label IS NULL THEN 'new' WHEN coalesce(x.labeled_at, '') > coalesce(l.updated_at, '') THEN 'updated' ELSE 'kept' END AS action, coalesce(l.label <> x.label, FALSE) AS conflict
 FROM x LEFT JOIN l ON l.profile_id = {PROFILE} AND l.entry_type = x.entry_type AND l.entry_id = x.entry_id)"""


@query(f"WITH {L}, {_MERGE} SELECT * FROM mg")
def q14_pull_labels_merge(spark, d):
    m = store.merge_remote_labels(table(spark, d, "labels"), table(spark, d, "remote_labels"), PROFILE)
    return m.select(*KEY, "remote_label", "local_label", "action", "conflict")


@query(f"WITH {L}, {_MERGE} SELECT action, count(*) AS n, sum(CASE WHEN conflict THEN 1 ELSE 0 END)::BIGINT AS conflicts FROM mg GROUP BY ALL")
def q14_pull_labels_counts(spark, d):
    return q14_pull_labels_merge(spark, d).groupBy("action").agg(F.count("*").alias("n"), F.sum(F.col("conflict").cast("int")).alias("conflicts"))


@query(f"""WITH {L}, {_MERGE}, a AS (SELECT {PROFILE} AS profile_id, entry_type, entry_id, remote_label AS label FROM mg WHERE action <> 'kept')
 SELECT profile_id, label, count(*) AS n FROM (SELECT profile_id, entry_type, entry_id, label FROM l WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.profile_id = l.profile_id AND a.entry_type = l.entry_type AND a.entry_id = l.entry_id) UNION ALL SELECT * FROM a) GROUP BY ALL""")
def q14_labels_after_pull(spark, d):
    base = labels(spark, d)
    out = store.apply_merge(base, store.merge_remote_labels(base, table(spark, d, "remote_labels"), PROFILE), PROFILE, NOW)
    return out.groupBy("profile_id", "label").agg(F.count("*").alias("n"))


@query(f"""WITH {L}, lp AS (SELECT coalesce(max(synced_at), '') AS t FROM sync_log WHERE direction = 'push' AND details ILIKE '%labels pushed%' AND (profile_id = {PROFILE} OR profile_id IS NULL))
 SELECT entry_type, entry_id, label, reasoning, updated_at FROM l, lp WHERE profile_id = {PROFILE} AND {OK} AND coalesce(updated_at, '') > t""")
def q15_push_increment(spark, d):
    return queries.push_increment(table(spark, d, "labels"), table(spark, d, "sync_log"), PROFILE).select(*KEY, "label", "reasoning", "updated_at")


@query(f"SELECT id, profile_id, direction, items_count, details, synced_at FROM sync_log WHERE profile_id = {PROFILE} OR profile_id IS NULL ORDER BY synced_at DESC NULLS LAST, id DESC LIMIT 20")
def q16_recent_syncs(spark, d):
    return queries.recent_syncs(table(spark, d, "sync_log"), PROFILE, 20)


@query("""SELECT direction, synced_at, details, CASE WHEN coalesce(details, '') LIKE 'FAILED%' THEN 0 ELSE 1 END AS ok FROM
 (SELECT *, row_number() OVER (PARTITION BY direction ORDER BY synced_at DESC NULLS LAST, id DESC) AS rn FROM sync_log) WHERE rn = 1""")
def q17_sync_health(spark, d):
    return queries.sync_health(table(spark, d, "sync_log"))


@query("SELECT p.id AS profile_id, coalesce(max(version), 0) + 1 AS next_version FROM profiles p LEFT JOIN models m ON m.profile_id = p.id GROUP BY ALL")
def q18_next_version(spark, d):
    return queries.next_versions(table(spark, d, "models"), table(spark, d, "profiles"))


@query("SELECT profile_id, version, accuracy, f1_score, architecture FROM (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY id DESC) AS rn FROM models WHERE is_active = 1) WHERE rn = 1")
def q19_active_model(spark, d):
    return queries.active_models(table(spark, d, "models")).select("profile_id", "version", "accuracy", "f1_score", "architecture")


@query("""SELECT profile_id, version, row_number() OVER w AS step, lag(version) OVER w AS previous, round(accuracy - lag(accuracy) OVER w, 6) AS accuracy_change,
 label_count - lag(label_count) OVER w AS labels_added FROM models WINDOW w AS (PARTITION BY profile_id ORDER BY version, id)""")
def q20_version_chain(spark, d):
    return queries.version_chain(table(spark, d, "models"))


@query("SELECT profile_id, sum(CASE WHEN version = top THEN 1 ELSE 0 END)::BIGINT AS active, count(*) AS n FROM (SELECT profile_id, version, max(version) OVER (PARTITION BY profile_id) + 0 AS top FROM (SELECT profile_id, version FROM models UNION ALL SELECT profile_id, max(version) + 1 FROM models GROUP BY ALL)) GROUP BY ALL")
def q20_activate_model(spark, d):
    m = table(spark, d, "models")
    top = m.groupBy("profile_id").agg(F.max_by(F.struct(*m.columns), F.struct("version", "id")).alias("x"))
    new = top.select("x.*").withColumn("version", F.col("version") + 1)
    return store.activate_model(m, new).groupBy("profile_id").agg(F.sum("is_active").alias("active"), F.count("*").alias("n"))


# ---------------------------------------------------------------- text

_PAT_SQL = [("Franken", "franken"), ("audit office", "audit office"), ("tribun(al|e)", "tribun(al|e)"), ("Einsprache", "einsprache"), ("huis clos", "huis clos"), ("recours (", r"recours \(")]
_SIG = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({FULL}, '(?i){p}') THEN '{n}' END" for n, p in _PAT_SQL) + "], lambda x: x IS NOT NULL)"


@query(f"""WITH {E}, a AS (SELECT *, {_SIG} AS sg FROM e), b AS (SELECT *, concat_ws('; ', CASE WHEN trim(coalesce(source_type, '')) <> '' THEN 'source_type=' || trim(source_type) END,
 CASE WHEN trim(coalesce(source_name, '')) <> '' THEN 'source=' || left(trim(source_name), 120) END, CASE WHEN trim(coalesce(source_category, '')) <> '' THEN 'category=' || left(trim(source_category), 80) END,
 CASE WHEN len(sg) > 0 THEN 'signals=' || list_aggregate(sg, 'string_agg', ', ') END) AS head,
 concat_ws(chr(10), nullif(trim(title), ''), nullif(trim(title), ''), nullif(trim(description), ''), nullif(left(trim(content), 500), '')) AS body FROM a)
 SELECT entry_type, entry_id, CASE WHEN head = '' THEN '' ELSE head || chr(10) || chr(10) END || CASE WHEN body = '' THEN '(empty)' ELSE body END AS text FROM b""")
def q21_entry_text_signals(spark, d):
    e = entries(spark, d, "title", "description", "content", "source_name", "source_category", "source_type")
    return e.select(*KEY, X.model_text(PATTERNS).alias("text"))


@query(f"WITH {E}, {TOK} SELECT term, count(*) AS n, count(DISTINCT entry_type || entry_id) AS entries FROM tok GROUP BY ALL")
def q22_recipe_ngrams(spark, d):
    t = recipe.entry_terms(entries(spark, d, "title", "description", "content"))
    return t.groupBy("term").agg(F.sum("n").alias("n"), F.count("*").alias("entries"))


_TEXTS = ("title", "description", "content", "source_type")


@query(f"WITH {E}, {R}, {TOK}, {HITS}, {SCORE} SELECT entry_type, entry_id, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in CLASSES)} FROM c")
def q23_recipe_class_scores(spark, d):
    s = recipe.class_scores(entries(spark, d, *_TEXTS), base_recipe(spark))
    return s.select(*KEY, *[F.col(c).cast("double").alias(c) for c in CLASSES])


@query(f"WITH {ALL_R} SELECT predicted_label, count(*) AS n, round(avg(relevance_score), 3) AS mean FROM rs GROUP BY ALL")
def q24_recipe_predict(spark, d):
    s = recipe.recipe_scores(entries(spark, d, *_TEXTS), base_recipe(spark))
    return s.groupBy("predicted_label").agg(F.count("*").alias("n"), F.round(F.avg("relevance_score"), 3).alias("mean"))


@query(f"WITH {ALL_R} SELECT * FROM rs")
def q25_recipe_relevance(spark, d):
    return recipe.recipe_scores(entries(spark, d, *_TEXTS), base_recipe(spark))


@query(f"WITH {ALL_R}, {VEC}, {MODEL} SELECT greatest(0.0, round(coalesce(corr(rs.relevance_score, ms.relevance_score), 0), 4)) AS quality, count(*) AS n FROM rs JOIN ms USING (entry_type, entry_id)")
def q26_recipe_quality(spark, d):
    return recipe.quality(q25_recipe_relevance(spark, d), model_scores(spark, d))


_MED = f"mg AS (SELECT greatest({', '.join(f'abs({c})' for c in CLASSES)}) AS m FROM c), md AS (SELECT list_sort(list(m))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS median FROM mg WHERE m > 0)"


@query(f"WITH {E}, {R}, {TOK}, {HITS}, {SCORE}, {_MED} SELECT kind, term, class, round(CAST(weight AS DOUBLE) * CASE WHEN median >= 0.01 THEN 2.0 / CAST(median AS DOUBLE) ELSE 1 END, 4) AS weight FROM r, md")
def q27_normalize_scale(spark, d):
    r = base_recipe(spark)
    s = recipe.class_scores(entries(spark, d, *_TEXTS), r)
    return recipe.normalise(r, recipe.upper_median(s)).withColumn("weight", F.col("weight").cast("double"))


_STAB = "st AS (SELECT kind, term, class, greatest(-cap, least(cap, weight)) AS weight FROM (SELECT *, CAST(CASE WHEN kind = 'source' THEN 0.08 WHEN contains(term, ' ') THEN 0.24 ELSE 0.12 END AS DECIMAL(18,4)) AS cap FROM r) WHERE abs(greatest(-cap, least(cap, weight))) >= 0.01)"


@query(f"WITH {R}, {_STAB} SELECT kind, term, class, CAST(weight AS DOUBLE) AS weight FROM st WHERE NOT (NOT contains(term, ' ') AND (length(term) < 3 OR term IN ({', '.join(chr(39) + w + chr(39) for w in recipe.LOW_SIGNAL)})))")
def q28_stabilize_weights(spark, d):
    return recipe.stabilise(base_recipe(spark)).where(~recipe.low_signal()).withColumn("weight", F.col("weight").cast("double"))


def _term_weights(spark, d) -> DataFrame:
    """Weights learnt by counting: how much oftener a word occurs in a class's labelled entries than overall."""
    t = recipe.entry_terms(entries(spark, d, "title", "description", "content"))
    mine = labels(spark, d).where((F.col("profile_id") == PROFILE) & store.confirmed()).select(*KEY, F.col("label").alias("class"))
    j = t.join(mine, KEY).groupBy("term", "class").agg(F.count("*").alias("n"))
    total = j.groupBy("term").agg(F.sum("n").alias("t")).where("t >= 3")
    return j.join(total, "term").select("class", "term", (F.col("n") * 1000 - F.floor(F.col("t") * 1000 / 4)).cast("long").alias("weight"))


_TW = f"""tw AS (SELECT class, term, n * 1000 - CAST(floor(t * 1000 / 4) AS BIGINT) AS weight FROM (SELECT term, class, n, sum(n) OVER (PARTITION BY term) AS t FROM
 (SELECT term, label AS class, count(*) AS n FROM (SELECT DISTINCT * FROM tok) JOIN (SELECT entry_type, entry_id, label FROM l WHERE profile_id = {PROFILE} AND {OK}) USING (entry_type, entry_id) GROUP BY ALL)) WHERE t >= 3)"""


@query(f"""WITH {E}, {L}, {TOK}, {_TW}, a AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY CASE WHEN weight > 0 THEN 0 ELSE 1 END, weight DESC, term) AS rp,
 row_number() OVER (PARTITION BY class ORDER BY CASE WHEN weight < 0 THEN 0 ELSE 1 END, weight ASC, term) AS rn FROM tw),
 b AS (SELECT *, CASE WHEN (weight > 0 AND rp <= 20) OR (weight < 0 AND rn <= 21) THEN 1 ELSE 0 END AS f FROM a),
 c AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY f DESC, abs(weight) DESC, term) AS place FROM b) SELECT class, term, weight FROM c WHERE place <= 41""")
def q29_signed_topn(spark, d):
    return recipe.signed_top(_term_weights(spark, d), 41)


@query(f"WITH {R} SELECT class, rank, term, CAST(weight AS DOUBLE) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY abs(weight) DESC, term) AS rank FROM r WHERE kind = 'keyword') WHERE rank <= 4")
def q30_keyword_topn(spark, d):
    return recipe.top_keywords(base_recipe(spark), 4).withColumn("weight", F.col("weight").cast("double"))


def _newer(spark) -> DataFrame:
    """The recipe's next version: commissions and audits gone, one word new, leads heavier."""
    r = base_recipe(spark).where("term NOT IN ('commissione', 'audit')")
    w = F.when(F.col("class") == "investigation_lead", F.col("weight") + F.lit("0.1000").cast(DECIMAL)).otherwise(F.col("weight")).cast(DECIMAL)
    return r.withColumn("weight", w).unionByName(recipe.from_rows(spark, [("keyword", "koalicja", "important", "0.4100")]))


@query(f"""WITH {R}, n AS (SELECT kind, term, class, CAST(weight + CASE WHEN class = 'investigation_lead' THEN 0.1 ELSE 0 END AS DECIMAL(18,4)) AS weight FROM r WHERE term NOT IN ('commissione', 'audit')
 UNION ALL SELECT 'keyword', 'koalicja', 'important', CAST(0.41 AS DECIMAL(18,4))), a AS (SELECT class, term, weight FROM r WHERE kind = 'keyword'), b AS (SELECT class, term, weight FROM n WHERE kind = 'keyword')
 SELECT * FROM (SELECT class, term, CASE WHEN a.weight IS NULL THEN 'new' WHEN b.weight IS NULL THEN 'removed' WHEN abs(b.weight - a.weight) > 0.05 THEN 'shifted' END AS change, CAST(a.weight AS DOUBLE) AS old_weight, CAST(b.weight AS DOUBLE) AS new_weight
 FROM a FULL JOIN b USING (class, term)) WHERE change IS NOT NULL""")
def q31_compare_versions(spark, d):
    c = recipe.compare(base_recipe(spark), _newer(spark))
    return c.withColumns({k: F.col(k).cast("double") for k in ("old_weight", "new_weight")})


LAWFUL = [("keyword", "third country rules", "investigation_lead", "0.5000"), ("keyword", "delegated regulation", "noise", "0.2800"), ("keyword", "market access", "important", "0.3000"), ("keyword", "annex amendment", "noise", "0.3000")]


def _lawful(spark) -> DataFrame:
    return base_recipe(spark).unionByName(recipe.from_rows(spark, LAWFUL))


@query(f"""WITH r(kind, term, class, weight) AS (VALUES {", ".join(f"('{k}', '{t}', '{c}', CAST({w} AS DECIMAL(18,4)))" for k, t, c, w in [*RECIPE, *LAWFUL])}), w AS (SELECT term, sum(CASE WHEN class = 'investigation_lead' THEN weight ELSE 0 END) + 0.7 * sum(CASE WHEN class = 'important' THEN weight ELSE 0 END) AS pos, sum(CASE WHEN class = 'noise' THEN weight ELSE 0 END) AS neg
 FROM r WHERE kind = 'keyword' AND contains(term, ' ') AND ({" OR ".join(f"contains(term, '{m}')" for m in recipe.PHRASE_MARKERS)}) GROUP BY ALL), s AS (SELECT 'positive' AS side, term, pos AS score FROM w UNION ALL SELECT 'negative', term, neg FROM w)
 SELECT side, term, CAST(score AS DOUBLE) AS score, row_number() OVER (PARTITION BY side ORDER BY score DESC, term) AS rank FROM s WHERE score > 0""")
def q32_legal_patterns(spark, d):
    return recipe.phrase_markers(_lawful(spark)).withColumn("score", F.col("score").cast("double"))


@query(f"""WITH {R}, p AS (SELECT 'keyword' AS kind, term, class, w AS weight FROM (VALUES ('franken'), ('audit office'), ('tribunale'), ('einsprache'), ('huis clos'), ('recours')) t(term), (VALUES ('investigation_lead', CAST(0.35 AS DECIMAL(18,4))), ('important', CAST(0.15 AS DECIMAL(18,4)))) c(class, w)
 UNION ALL SELECT * FROM (VALUES {", ".join(f"('keyword', '{t}', '{c}', CAST({w} AS DECIMAL(18,4)))" for t, c, w in recipe.TEMPLATE_PHRASES)}))
 SELECT kind, term, class, CAST(sum(weight) AS DOUBLE) AS weight FROM (SELECT * FROM r UNION ALL SELECT * FROM p) GROUP BY ALL""")
def q33_template_boost(spark, d):
    r = recipe.add_priors(base_recipe(spark), recipe.template_priors(spark, PATTERNS))
    return r.withColumn("weight", F.col("weight").cast("double"))


_REASON = f"""g AS (SELECT label, updated_at, entry_type, entry_id, term, count(*) AS n FROM (SELECT label, updated_at, entry_type, entry_id, unnest({GRAMS}) AS term FROM
 (SELECT label, updated_at, entry_type, entry_id, {WORDS.format("reasoning")} AS w FROM l WHERE profile_id = {PROFILE} AND coalesce(reasoning, '') <> '')) WHERE NOT (NOT contains(term, ' ') AND length(term) < 3) GROUP BY ALL),
 o AS (SELECT *, first_value(label) OVER (PARTITION BY term ORDER BY updated_at DESC NULLS LAST, entry_type, entry_id, label) AS opener FROM g), mm AS (SELECT term, label AS class, sum(n) AS n, first(opener) AS opener FROM o GROUP BY ALL),
 j AS (SELECT coalesce(mm.term, k.term) AS term, coalesce(mm.class, k.class) AS class, coalesce(n, 0) AS n, opener, k.weight, EXISTS (SELECT 1 FROM r WHERE r.kind = 'keyword' AND r.term = mm.term) AS known FROM mm FULL JOIN (SELECT term, class, weight FROM r WHERE kind = 'keyword') k ON k.term = mm.term AND k.class = mm.class),
 b AS (SELECT *, CAST(CASE WHEN contains(term, ' ') THEN 1.8 ELSE 1.5 END AS DECIMAL(18,4)) AS boost, weight IS NULL AND NOT known AND opener = class AS opens FROM j),
 s0 AS (SELECT *, CAST(CASE WHEN weight IS NOT NULL THEN weight WHEN opens THEN CASE WHEN contains(term, ' ') THEN 0.16 ELSE 0.1 END ELSE 0.08 END AS DECIMAL(18,4)) AS s, CAST(least(200, n - CASE WHEN opens THEN 1 ELSE 0 END) AS BIGINT) AS k FROM b)"""


@query(f"""WITH {L}, {R}, {_REASON} SELECT 'keyword' AS kind, term, class, CAST(list_reduce(list_concat([s], list_transform(range(0, k), lambda i: boost)), lambda a, x: CAST(greatest(-1000000000, least(1000000000, round(a * x, 4))) AS DECIMAL(18,4))) AS DOUBLE) AS weight FROM s0
 UNION ALL SELECT kind, term, class, CAST(weight AS DOUBLE) FROM r WHERE kind <> 'keyword'""")
def q34_reasoning_boost(spark, d):
    mine = labels(spark, d).where(F.col("profile_id") == PROFILE)
    return recipe.reasoning_boost(base_recipe(spark), mine).withColumn("weight", F.col("weight").cast("double"))


# ---------------------------------------------------------------- training


@query(f"""WITH {L} SELECT profile_id, entry_type, entry_id, round(CASE WHEN coalesce(try_cast(updated_at AS TIMESTAMP), try_cast(created_at AS TIMESTAMP)) IS NULL THEN 1.0
 ELSE greatest(0.25, pow(0.5, greatest(0, epoch(TIMESTAMP '{NOW}') - epoch(coalesce(try_cast(updated_at AS TIMESTAMP), try_cast(created_at AS TIMESTAMP)))) / 86400.0 / 120)) END * CASE WHEN trim(coalesce(reasoning, '')) <> '' THEN 1.5 ELSE 1 END, 6) AS weight FROM l""")
def q35_sample_weights(spark, d):
    w = training.sample_weights(labels(spark, d), NOW, 120, 0.25, 1.5)
    return w.select("profile_id", *KEY, F.round("weight", 6).alias("weight"))


_MINE = f"mi AS (SELECT * FROM l WHERE profile_id = {PROFILE} AND {OK})"


@query(f"""WITH {L}, {_MINE}, k AS (SELECT count(*) AS n, count(DISTINCT label) AS k FROM mi) SELECT entry_type, entry_id, label,
 CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5(entry_type || '|' || entry_id || '|42'), entry_type, entry_id) <= round(count(*) OVER (PARTITION BY label) * greatest(k * 1.0 / n, least(1 - k * 1.0 / n, 0.2))) THEN 1 ELSE 0 END AS is_test FROM mi, k""")
def q36_stratified_split(spark, d):
    mine = labels(spark, d).where((F.col("profile_id") == PROFILE) & store.confirmed())
    return training.stratified_split(mine.select(*KEY, "label"), "label", 0.2, 42)


@query(f"""WITH {L}, {_MINE}, r0 AS (SELECT entry_type, entry_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(entry_type || '|' || entry_id || '|42'), entry_type, entry_id) - 1 AS r, count(*) OVER (PARTITION BY label) AS n FROM mi)
 SELECT entry_type, entry_id, label, unnest(range(0, CAST(floor(((SELECT max(n) FROM r0) - r - 1) * 1.0 / n) AS BIGINT) + 1)) AS turn FROM r0""")
def q37_oversample_classes(spark, d):
    mine = labels(spark, d).where((F.col("profile_id") == PROFILE) & store.confirmed())
    return training.oversample(mine.select(*KEY, "label"), "label").select(*KEY, "label", F.col("turn").cast("long").alias("turn"))


@query(f"""WITH {L}, {_MINE}, w AS (SELECT entry_type, entry_id, CASE WHEN trim(coalesce(reasoning, '')) <> '' THEN 2.6 ELSE 1.0 END AS w FROM mi)
 SELECT entry_type, entry_id, unnest(range(1, CAST(least(5, greatest(1, round_even(w / (SELECT greatest(min(w), 1e-6) FROM w), 0))) AS BIGINT) + 1)) AS copy FROM w""")
def q37_replicate_weighted(spark, d):
    mine = labels(spark, d).where((F.col("profile_id") == PROFILE) & store.confirmed())
    w = training.sample_weights(mine, NOW, 0, 0.25, 2.6)
    return training.replicate(w).select(*KEY, F.col("copy").cast("long").alias("copy"))


_TF = f"""tf AS (SELECT entry_type, entry_id, term, count(*) AS tf FROM (SELECT entry_type, entry_id, unnest({WORDS.format(FULL)}) AS term FROM e) GROUP BY ALL), nd AS (SELECT count(*) AS n FROM e),
 dfs AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM tf GROUP BY ALL), voc AS (SELECT term, df, cf, ln((1.0 + n) / (1.0 + df)) + 1 AS idf FROM dfs, nd WHERE df >= 2 AND df <= 0.95 * n ORDER BY cf DESC, term LIMIT 10000)"""


def _tfidf(spark, d):
    e = entries(spark, d, "title", "description", "content")
    return features.fit_tfidf(e, X.full_text(), (1,), X.recipe_words)


@query(f"WITH {E}, {_TF} SELECT term, df, cf, round(idf, 6) AS idf FROM voc")
def q38_term_df_idf(spark, d):
    return _tfidf(spark, d)[1].withColumn("idf", F.round("idf", 6))


@query(f"""WITH {E}, {_TF}, x AS (SELECT entry_type, entry_id, term, (1 + ln(tf)) * idf AS x FROM tf JOIN voc USING (term)), u AS (SELECT entry_type, entry_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY entry_type, entry_id)) AS v FROM x)
 SELECT entry_type, entry_id, rank, term, round(v, 4) AS value FROM (SELECT *, row_number() OVER (PARTITION BY entry_type, entry_id ORDER BY round(v, 6) DESC, term) AS rank FROM u) WHERE rank <= 3""")
def q39_tfidf_l2_topterms(spark, d):
    return features.top_terms(_tfidf(spark, d)[0], 3)


def _tfidf_grams(spark, d):
    e = entries(spark, d, "title", "description", "content")
    return features.fit_tfidf(e, X.full_text())


@query()
def q38_term_df_idf_grams(spark, d):
    """The same over words, pairs and triples without accents, the operator's defaults."""
    return _tfidf_grams(spark, d)[1].withColumn("idf", F.round("idf", 6))


@query()
def q39_tfidf_l2_topterms_grams(spark, d):
    return features.top_terms(_tfidf_grams(spark, d)[0], 3)


@query(f"WITH {E}, {VEC}, {MODEL} SELECT * FROM ms")
def q40_linear_head_scores(spark, d):
    return model_scores(spark, d)


_HEADLIST = "['" + "', '".join(HEAD) + "']"


@query(f"""WITH {E}, {L}, {_MINE}, {VEC}, {MODEL}, y AS (SELECT lg, list_position({_HEADLIST}, label) AS y FROM lg JOIN mi USING (entry_type, entry_id)), t AS (SELECT i, 0.25 * pow(48.0, i / 39.0) AS t FROM range(0, 40) r(i)),
 a AS (SELECT i, t, -ln(greatest(1e-9, exp((lg[y] - list_max(lg)) / t) / list_sum(list_transform(lg, lambda x: exp((x - list_max(lg)) / t))))) AS nll FROM y, t)
 SELECT CAST(i AS INTEGER) AS i, round(t, 4) AS temperature, round(avg(nll), 4) AS nll FROM a GROUP BY ALL""")
def q41_temperature_fit(spark, d):
    mine = labels(spark, d).where((F.col("profile_id") == PROFILE) & store.confirmed()).select(*KEY, "label")
    loss = training.temperature_losses(model_logits(spark, d).join(mine, KEY))
    return loss.select("i", F.round("temperature", 4).alias("temperature"), F.round("nll", 4).alias("nll"))


@query(f"""WITH {E}, {L}, {_MINE}, {VEC}, {MODEL}, j AS (SELECT label, predicted_label FROM mi JOIN ms USING (entry_type, entry_id)), k AS (SELECT label AS class FROM j UNION SELECT predicted_label FROM j),
 t AS (SELECT class, (SELECT count(*) FROM j WHERE label = class AND predicted_label = class) AS tp, (SELECT count(*) FROM j WHERE label = class) AS support, (SELECT count(*) FROM j WHERE predicted_label = class) AS g FROM k),
 pr2 AS (SELECT class, CASE WHEN g > 0 THEN tp * 1.0 / g ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp * 1.0 / support ELSE 0 END AS recall, support, tp FROM t),
 f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM pr2)
 SELECT class, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1, support, CAST(NULL AS DOUBLE) AS accuracy FROM f
 UNION ALL SELECT 'macro', round(avg(precision), 4), round(avg(recall), 4), round(avg(f1), 4), CAST(sum(support) AS BIGINT), round(sum(tp) * 1.0 / sum(support), 4) FROM f""")
def q42_metrics_report(spark, d):
    mine = labels(spark, d).where((F.col("profile_id") == PROFILE) & store.confirmed()).select(*KEY, "label")
    return training.metrics(mine.join(model_scores(spark, d), KEY))


# ---------------------------------------------------------------- sampling

_FREE = f"fr AS (SELECT e.* FROM e WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.profile_id = {PROFILE} AND l.entry_type = e.entry_type AND l.entry_id = e.entry_id))"
_NEW = "published_date DESC NULLS LAST, entry_type, entry_id"
_POOL = f"po AS (SELECT * FROM fr ORDER BY {_NEW} LIMIT 200)"
_ENT = "round(" + " + ".join(f"CASE WHEN p_{c} > 0 THEN -p_{c} * log2(p_{c}) ELSE 0 END" for c in CLASSES) + ", 6)"
_UNC = f"un AS (SELECT entry_type, entry_id, {_ENT} AS entropy, greatest({', '.join(f'p_{c}' for c in CLASSES)}) AS top, predicted_label FROM po JOIN ms USING (entry_type, entry_id) ORDER BY entropy DESC, entry_type, entry_id LIMIT 10)"
_TOKS = f"tok AS (SELECT entry_type, entry_id, unnest({GRAMS}) AS term FROM (SELECT entry_type, entry_id, CASE WHEN regexp_replace(lower({FULL}), '^\\s+|\\s+$', '', 'g') = '' THEN [] ELSE regexp_split_to_array(regexp_replace(lower({FULL}), '^\\s+|\\s+$', '', 'g'), '\\s+') END AS w FROM po))"
_SPACE = f"{R}, {_TOKS}, {HITS}, {SCORE.replace('FROM e JOIN', 'FROM po e JOIN').replace('FROM e LEFT', 'FROM po e LEFT')}, {SOFT}"
_CON = f"co AS (SELECT entry_type, entry_id, ms.predicted_label AS model_label, p.predicted_label AS recipe_label, published_date FROM po JOIN ms USING (entry_type, entry_id) JOIN p USING (entry_type, entry_id) WHERE ms.predicted_label <> p.predicted_label ORDER BY {_NEW} LIMIT 5)"
_CC = f"cc AS (SELECT source_category, count(*) AS labelled FROM l JOIN e USING (entry_type, entry_id) WHERE l.profile_id = {PROFILE} AND {OK} AND trim(coalesce(source_category, '')) <> '' GROUP BY ALL)"
_DIV = f"""di AS (SELECT entry_type, entry_id, source_category, coalesce(labelled, 0) AS labelled, published_date FROM (SELECT *, row_number() OVER (PARTITION BY source_category ORDER BY {_NEW}) AS rn FROM fr WHERE trim(coalesce(source_category, '')) <> '') LEFT JOIN cc USING (source_category)
 WHERE rn = 1 ORDER BY labelled, {_NEW} LIMIT 5)"""
_SAMPLER = f"{E}, {L}, {VEC}, {MODEL}, {_FREE}, {_POOL}, {_UNC}, {_SPACE}, {_CON}, {_CC}, {_DIV}"
_QUEUE = f"""al AS (SELECT entry_type, entry_id, 'uncertain' AS pool, 1 AS o, row_number() OVER (ORDER BY entropy DESC, entry_type, entry_id) AS rank FROM un
 UNION ALL SELECT entry_type, entry_id, 'conflict', 2, row_number() OVER (ORDER BY {_NEW}) FROM co UNION ALL SELECT entry_type, entry_id, 'diverse', 3, row_number() OVER (ORDER BY labelled, {_NEW}) FROM di
 UNION ALL SELECT entry_type, entry_id, 'new', 4, row_number() OVER (ORDER BY {_NEW}) FROM (SELECT * FROM po ORDER BY {_NEW} LIMIT 15)),
 qu AS (SELECT entry_type, entry_id, pool, row_number() OVER (ORDER BY o, rank) AS place, o FROM (SELECT *, row_number() OVER (PARTITION BY entry_type, entry_id ORDER BY o, rank) AS k FROM al) WHERE k = 1 QUALIFY row_number() OVER (ORDER BY o, rank) <= 30)"""


def _pool(spark, d, *cols):
    e = entries(spark, d, *dict.fromkeys(["published_date", *cols]))
    return queries.unlabeled(e, table(spark, d, "labels"), PROFILE).orderBy(*queries.newest()).limit(sampler.CANDIDATES)


@query(f"WITH {_SAMPLER} SELECT entry_type, entry_id, entropy, predicted_label || ' (' || CAST(round_even(top * 100, 0) AS INTEGER) || '%)' AS reason FROM un")
def q43_entropy_topk(spark, d):
    return sampler.uncertain(_pool(spark, d), model_scores(spark, d)).select(*KEY, "entropy", "reason")


@query(f"WITH {_SAMPLER} SELECT entry_type, entry_id, model_label, recipe_label FROM co")
def q44_conflicts(spark, d):
    return sampler.conflicts(_pool(spark, d, *_TEXTS), model_scores(spark, d), base_recipe(spark))


@query(f"WITH {_SAMPLER} SELECT entry_type, entry_id, source_category, labelled FROM di")
def q45_diverse(spark, d):
    return sampler.diverse(entries(spark, d, "published_date", "source_category"), labels(spark, d), PROFILE)


def _queue(spark, d, limit):
    e = entries(spark, d, *_TEXTS, "published_date", "source_category")
    return sampler.smart_queue(e, labels(spark, d), model_scores(spark, d), base_recipe(spark), PROFILE, limit)


@query(f"WITH {_SAMPLER}, {_QUEUE} SELECT entry_type, entry_id, pool, place FROM qu")
def q46_smart_queue(spark, d):
    return _queue(spark, d, 30)


@query(f"WITH {_SAMPLER}, {_QUEUE} SELECT pool, count(*) AS n FROM qu GROUP BY ALL")
def q46_pool_histogram(spark, d):
    return sampler.pool_histogram(q46_smart_queue(spark, d))


@query(f"""WITH {_SAMPLER}, {_QUEUE.replace("<= 30", "<= 120")} SELECT entry_type, entry_id, pool, row_number() OVER (ORDER BY CASE pool WHEN 'uncertain' THEN 0 WHEN 'new' THEN 1 WHEN 'conflict' THEN 2 WHEN 'diverse' THEN 3 END, place) AS turn FROM qu QUALIFY turn <= 20""")
def q47_synthetic_rank(spark, d):
    return sampler.synthetic_rank(_queue(spark, d, sampler.machine_batch(20)[1]), 20)


@query(f"WITH {E}, {L}, {VEC}, {MODEL}, {_FREE} SELECT entry_type, entry_id, relevance_score, predicted_label FROM fr JOIN ms USING (entry_type, entry_id) WHERE published_date >= '2025-11-24' ORDER BY relevance_score DESC, {_NEW} LIMIT 30")
def q50_top_recent(spark, d):
    e = queries.recent(entries(spark, d, "published_date"), NOW, 7)
    return sampler.top_recent(e, labels(spark, d), model_scores(spark, d), PROFILE)


@query(f"WITH {E}, {L}, {VEC}, {MODEL} SELECT entry_type, entry_id, label AS user_label, predicted_label, relevance_score FROM l JOIN ms USING (entry_type, entry_id) WHERE profile_id = {PROFILE} AND label <> predicted_label")
def q51_mismatches(spark, d):
    return sampler.mismatches(labels(spark, d), model_scores(spark, d), PROFILE)


@query(f"WITH {E}, {L}, {VEC}, {MODEL} SELECT profile_id, count(*) AS n, round(sum(CASE WHEN label = predicted_label THEN 1 ELSE 0 END) * 100.0 / count(*), 1) AS accuracy FROM l JOIN ms USING (entry_type, entry_id) GROUP BY ALL")
def q52_view_accuracy(spark, d):
    return sampler.shown_accuracy(labels(spark, d), model_scores(spark, d))


# ---------------------------------------------------------------- explanation


@query(f"""WITH {ALL_R}, k AS (SELECT h.entry_type, h.entry_id, h.term, CAST(weight * n AS DECIMAL(18,4)) AS x FROM h JOIN rs USING (entry_type, entry_id) JOIN r ON r.kind = 'keyword' AND r.term = h.term AND r.class = rs.predicted_label)
 SELECT entry_type, entry_id, rank, term, CAST(x AS DOUBLE) AS contribution, CASE WHEN x > 0 THEN 'positive' ELSE 'negative' END AS direction FROM (SELECT *, row_number() OVER (PARTITION BY entry_type, entry_id ORDER BY abs(x) DESC, term) AS rank FROM k WHERE abs(x) > 0.001) WHERE rank <= 8""")
def q53_phrase_contributions(spark, d):
    e = entries(spark, d, *_TEXTS)
    r = base_recipe(spark)
    return recipe.contributions(e, r, recipe.recipe_scores(e, r)).withColumn("contribution", F.col("contribution").cast("double"))


@query(f"""WITH {ALL_R}, k AS (SELECT h.entry_type, h.entry_id, h.term, CAST(weight * n AS DECIMAL(18,4)) AS x FROM h JOIN rs USING (entry_type, entry_id) JOIN r ON r.kind = 'keyword' AND r.term = h.term AND r.class = rs.predicted_label),
 top AS (SELECT entry_type, entry_id, rank, term AS feature, CAST(x AS DOUBLE) AS weight, CASE WHEN x > 0 THEN 'positive' ELSE 'negative' END AS direction FROM (SELECT *, row_number() OVER (PARTITION BY entry_type, entry_id ORDER BY abs(x) DESC, term) AS rank FROM k WHERE abs(x) > 0.001) WHERE rank <= 8),
 nn AS (SELECT rs.*, (SELECT count(*) FROM top WHERE top.entry_type = rs.entry_type AND top.entry_id = rs.entry_id) AS n FROM rs)
 SELECT * FROM top {" ".join(f"UNION ALL SELECT entry_type, entry_id, n + {i + 1}, '{c.replace('_', ' ')}', p_{c}, CASE WHEN p_{c} > 0.25 THEN 'positive' ELSE 'negative' END FROM nn WHERE n < 4" for i, c in enumerate(CLASSES))}""")
def q53_explain_recipe(spark, d):
    e = entries(spark, d, *_TEXTS)
    r = base_recipe(spark)
    return explain.explain_recipe(e, r, recipe.recipe_scores(e, r)).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {E} SELECT DISTINCT source_name, coalesce(nullif(regexp_replace(regexp_replace(lower(trim(coalesce(source_name, ''))), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'default') AS slug FROM e")
def q54_slugify(spark, d):
    return entries(spark, d, "source_name").select("source_name", X.slugify(F.col("source_name")).alias("slug")).distinct()


@query(f"""WITH {E}, u AS (SELECT entry_type, entry_id, trim(coalesce(link, '')) AS s FROM e), f AS (SELECT *, CASE WHEN regexp_matches(s, '^[a-zA-Z][a-zA-Z0-9+.-]*://') THEN s ELSE 'https://' || s END AS a FROM u WHERE s <> ''),
 g AS (SELECT entry_type, entry_id, regexp_replace(lower(regexp_extract(a, '^[^:]+://(?:[^/@]*@)?([^/:?#]+)', 1)), '^www\\.', '') AS host, regexp_replace(regexp_extract(a, '^[^:]+://[^/?#]+([^?#]*)', 1), '(?i)/index\\.php/?$', '') AS path FROM f),
 h AS (SELECT entry_type, entry_id, nullif(coalesce(nullif(regexp_replace(regexp_extract(path, '([^/]+)/*$', 1), '(?i)^news-', ''), ''), host), '') AS display FROM g)
 SELECT entry_type, entry_id, display, CASE WHEN display IS NOT NULL THEN coalesce(nullif(regexp_replace(regexp_replace(lower(trim(display)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'default') END AS slug FROM h""")
def q55_url_identity(spark, d):
    u = entries(spark, d, "link").select(*KEY, X.url_identity(F.col("link"), "news-").alias("u")).where("u IS NOT NULL")
    return u.select(*KEY, "u.display", "u.slug")


@query(f"WITH {L} SELECT profile_id, entry_type, entry_id, CAST(epoch(try_cast(updated_at AS TIMESTAMP)) AS BIGINT) AS at FROM l")
def q56_parse_ts(spark, d):
    return labels(spark, d).select("profile_id", *KEY, F.unix_seconds(S.parse_label_time(F.col("updated_at"))).alias("at"))


@query(f"WITH {L} SELECT 'profiles' AS tab, count(*) AS n FROM profiles WHERE id <> 2 UNION ALL SELECT 'labels', count(*) FROM l WHERE profile_id <> 2 UNION ALL SELECT 'models', count(*) FROM models WHERE profile_id <> 2")
def q58_cascade_delete(spark, d):
    left = store.delete_profile(2, profiles=table(spark, d, "profiles"), labels=labels(spark, d), models=table(spark, d, "models"))
    counts = [t.agg(F.count("*").alias("n")).select(F.lit(k).alias("tab"), "n") for k, t in left.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query(f"WITH {L} SELECT p.id, slug, is_default, count(l.label) AS n_labels FROM profiles p LEFT JOIN (SELECT * FROM l WHERE {OK}) l ON l.profile_id = p.id GROUP BY ALL")
def q66_profile_label_counts(spark, d):
    return queries.profile_label_counts(table(spark, d, "profiles"), table(spark, d, "labels"))


@query(f"""WITH {L}, n AS (SELECT profile_id, count(*) AS n FROM l WHERE {OK} GROUP BY ALL), a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY id DESC) AS rn FROM models WHERE is_active = 1) WHERE rn = 1)
 SELECT a.profile_id, version, CASE WHEN n > 0 THEN least(100.0, round(label_count * 100.0 / n, 1)) ELSE 0.0 END AS coverage FROM a LEFT JOIN n USING (profile_id)""")
def q67_model_coverage(spark, d):
    return queries.coverage(table(spark, d, "models"), table(spark, d, "labels"))


@query("SELECT id, CAST(json_extract(training_settings, '$.alert_threshold') AS DOUBLE) AS alert_threshold, 45 AS half_life FROM profiles")
def q68_merged_settings(spark, d):
    s = store.merge_settings(F.col("training_settings"), F.lit('{"label_time_decay_days": "45"}'))
    p = table(spark, d, "profiles").select("id", F.from_json(s, "map<string,string>").alias("m"))
    return p.select("id", F.col("m")["alert_threshold"].cast("double").alias("alert_threshold"), F.col("m")["label_time_decay_days"].cast("int").alias("half_life"))


@query(f"WITH {E}, {VEC} SELECT d - 1 AS dim, round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS deviation FROM (SELECT unnest(range(1, 65)) AS d, unnest(embedding) AS x FROM (SELECT CAST(embedding AS DOUBLE[]) AS embedding FROM v)) GROUP BY ALL")
def q69_vector_statistics(spark, d):
    e = entries(spark, d, "embedding")
    v = e.where(F.coalesce((F.size("embedding") == 64) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x)), F.lit(False)))
    x = v.select(F.posexplode(F.col("embedding").cast("array<double>")).alias("dim", "x"))
    return x.groupBy(F.col("dim").cast("long").alias("dim")).agg(F.round(F.avg("x"), 4).alias("mean"), F.round(F.stddev_samp("x"), 4).alias("deviation"))


@query(f"WITH {E}, {L}, {VEC} SELECT l.profile_id, v.embedding IS NULL AS missing, count(*) AS n FROM l LEFT JOIN v USING (entry_type, entry_id) WHERE {OK} GROUP BY ALL")
def q70_embedding_misses(spark, d):
    e = entries(spark, d, "embedding")
    v = e.where(F.coalesce((F.size("embedding") == 64) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x)), F.lit(False))).select(*KEY, F.lit(1).alias("have"))
    j = labels(spark, d).where(store.confirmed()).join(v, KEY, "left")
    return j.groupBy("profile_id", F.col("have").isNull().alias("missing")).agg(F.count("*").alias("n"))


@query(f"""WITH {E}, {L}, {VEC}, {MODEL}, h AS (SELECT entry_type, entry_id, label FROM l WHERE profile_id = {PROFILE} AND {OK}) SELECT label, count(*) AS n FROM
 (SELECT coalesce(h.label, ms.predicted_label) AS label FROM e LEFT JOIN h USING (entry_type, entry_id) LEFT JOIN ms USING (entry_type, entry_id)) WHERE label IS NOT NULL GROUP BY ALL""")
def q71_teacher_labels(spark, d):
    mine = labels(spark, d).where((F.col("profile_id") == PROFILE) & store.confirmed())
    t = training.teacher_labels(entries(spark, d, "source_type"), mine, model_scores(spark, d))
    return t.groupBy("label").agg(F.count("*").alias("n"))


QUERIES = Q
ORACLE = SQL
