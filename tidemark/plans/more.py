"""Queries of machine labels, heads, distillation, embedding, packages and streams."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions.lenient_json import lenient_object
from tidemark.operators import driver, explain, features, machine_labels, queries, recipe, store, training
from tidemark.plans import core as C
from tidemark.schemas import CLASSES, KEY
from tidemark.session import scratch
from tidemark.sources import packages
from tidemark.sources.snapshots import SnapshotTable
from tidemark.sources.tables import table
from tidemark.streaming import ingest

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_IN = ", ".join(f"'{c}'" for c in CLASSES)


@query(f"""WITH {C.E}, {C.L}, m AS (SELECT *, TRUE AS have FROM l WHERE profile_id = {C.PROFILE}) SELECT entry_type, entry_id, CASE WHEN have IS NULL THEN NULL WHEN trim(coalesce(pending_job_id, '')) <> '' THEN 'waits for a decision'
 WHEN lower(trim(coalesce(label_source, ''))) = 'gemini' THEN NULL ELSE 'labelled' END AS skip FROM e LEFT JOIN m USING (entry_type, entry_id)""")
def q48_eligible(spark: SparkSession, d: str) -> DataFrame:
    e = C.entries(spark, d, "source_type")
    return machine_labels.eligible(e, C.labels(spark, d), C.PROFILE, replace_own=True).select(*KEY, "skip")


def _replies(spark, d) -> DataFrame:
    """Replies made of the other side's labels, one a type and label, in four shapes: plain, fenced, with trailing commas, cut short."""
    r = table(spark, d, "remote_labels")
    item = F.to_json(F.struct(F.col("entry_id").cast("string").alias("entry_id"), "entry_type", "label", "reasoning"))
    chunk = r.select("entry_type", F.coalesce("label", F.lit("none")).alias("l"), item.alias("i")).groupBy("entry_type", "l").agg(F.array_join(F.sort_array(F.collect_list("i")), ",").alias("items"))
    shape = F.pmod(F.length("items"), F.lit(4))
    body = F.concat(F.lit('{"labels": ['), F.col("items"))
    reply = (
        F.when(shape == 0, F.concat(body, F.lit("]}"))).when(shape == 1, F.concat(F.lit("Here you are:\n```json\n"), body, F.lit("]}\n```")))
        .when(shape == 2, F.concat(body, F.lit(",]\n,}"))).otherwise(body)
    )
    return chunk.select(F.concat_ws("/", "entry_type", "l").alias("chunk_id"), reply.alias("reply"))


@query(f"""WITH {C.E}, a AS (SELECT trim(entry_type) AS entry_type, entry_id, lower(trim(label)) AS label, reasoning FROM remote_labels),
 p AS (SELECT *, CASE WHEN NOT coalesce(label IN ({_IN}), FALSE) THEN 'unknown label' WHEN label = 'investigation_lead' AND trim(coalesce(reasoning, '')) = '' THEN 'lead without reasoning' END AS problem FROM a),
 f AS (SELECT *, row_number() OVER (PARTITION BY entry_type, entry_id ORDER BY problem IS NOT NULL, label, coalesce(reasoning, '')) AS rn FROM p)
 SELECT e.entry_type, e.entry_id, CASE WHEN f.rn IS NOT NULL AND problem IS NULL THEN label END AS label, CASE WHEN f.rn IS NULL THEN 'no answer' ELSE coalesce(problem, 'labeled') END AS outcome FROM e LEFT JOIN f ON f.rn = 1 AND f.entry_type = e.entry_type AND f.entry_id = e.entry_id""")
def q49_llm_batch_match(spark, d):
    answers = machine_labels.parse_replies(_replies(spark, d))
    return machine_labels.match(C.entries(spark, d, "source_type"), answers).select(*KEY, "label", "outcome")


@query(f"""WITH {C.L} SELECT profile_id, entry_type, entry_id, label, coalesce(reasoning, '') AS reasoning FROM l""")
def q57_json_lenient(spark, d):
    """Every label written as a damaged reply and read back."""
    c = C.labels(spark, d)
    body = F.to_json(F.struct("label", F.coalesce("reasoning", F.lit("")).alias("reasoning")))
    cut = F.substring(body, F.lit(1), F.length(body) - 1)
    shape = F.pmod(F.col("entry_id"), F.lit(5))
    reply = (
        F.when(shape == 0, body).when(shape == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(shape == 2, F.concat(cut, F.lit(",\n}")))
        .when(shape == 3, cut).otherwise(F.concat(F.lit("Sure. "), body, F.lit(" Done.")))
    )
    got = c.select("profile_id", *KEY, F.from_json(lenient_object(reply), "label string, reasoning string").alias("x"))
    return got.select("profile_id", *KEY, "x.label", "x.reasoning")


_FREE = f"fr AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.profile_id = {C.PROFILE} AND l.entry_type = e.entry_type AND l.entry_id = e.entry_id))"
_SLICE = "CAST('0x' || substr(md5(entry_type || '|' || entry_id), 1, 8) AS BIGINT)"
_LINE = lambda name, c: f"CASE WHEN coalesce({c}, '') <> '' THEN {len(name) + 3} + length({c}) ELSE 0 END"
_BLOCK = "32 + length(CAST(n % 10 + 1 AS VARCHAR)) + length(entry_type) + length(CAST(entry_id AS VARCHAR)) + " + " + ".join(_LINE(*x) for x in (("source", "source_name"), ("category", "source_category"), ("date", "published_date"), ("title", "title"), ("description", "description"), ("content", "content")))


@query(f"""WITH {C.E}, {C.L}, {_FREE}, g AS (SELECT *, {_SLICE} % (SELECT greatest(1, CAST(ceil(count(*) / 1000.0) AS BIGINT)) FROM fr) AS g FROM fr), n AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY entry_type, entry_id) - 1 AS n FROM g)
 SELECT g || '-' || CAST(floor(n / 10) AS BIGINT) AS chunk_id, count(*) AS n, CAST({len(machine_labels.RULES)} + sum({_BLOCK}) + 2 * (count(*) - 1) AS BIGINT) AS n_chars, '{{}}' AS reply, CAST(NULL AS VARCHAR) AS error FROM n GROUP BY ALL""")
def q49_prompts(spark, d):
    """Prompts of ten entries each for everything the profile has not labelled, and what a client that knows nothing answers."""
    e = C.entries(spark, d, "title", "description", "content", "source_name", "source_category", "link", "published_date")
    p = machine_labels.batch_prompts(queries.unlabeled(e, table(spark, d, "labels"), C.PROFILE))
    asked = machine_labels.ask(p, lambda: machine_labels.Replay({}))
    return asked.select("chunk_id", F.size("keys").cast("long").alias("n"), F.length("prompt").cast("long").alias("n_chars"), "reply", "error")


def _labelled_vectors(spark, d) -> DataFrame:
    e = C.entries(spark, d, "embedding")
    ok = F.coalesce((F.size("embedding") == 64) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x)), F.lit(False))
    v = e.where(ok).select(*KEY, array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    mine = C.labels(spark, d).where((F.col("profile_id") == C.PROFILE) & store.confirmed())
    w = training.sample_weights(mine, C.NOW, 120, 0.25, 1.5)
    return w.select(*KEY, "label", "weight").join(v, KEY)


def _evaluated(model, rows: DataFrame, calibrate: DataFrame) -> DataFrame:
    t = training.fit_temperature(training.logits(model.transform(calibrate)))
    scored = training.logits(model.transform(rows))
    s = training.calibrated(scored, t)
    return training.metrics(rows.select(*KEY, "label").join(s, KEY)).withColumn("temperature", F.lit(t))


@query()
def q59_train_lr(spark, d):
    """Weighted logistic head with a calibrated temperature; metrics on the held-out rows."""
    rows = training.stratified_split(_labelled_vectors(spark, d), "label", 0.2, 42).cache()
    train, test = rows.where("is_test = 0"), rows.where("is_test = 1")
    cal = training.stratified_split(train.drop("is_test"), "label", 0.15, 43)
    model = training.fit_logistic(cal.where("is_test = 0"), "weight", iterations=1000)
    return _evaluated(model, test, cal.where("is_test = 1"))


@query()
def q60_train_mlp(spark, d):
    """One hidden layer on replicated and oversampled rows."""
    rows = training.stratified_split(_labelled_vectors(spark, d), "label", 0.2, 42).cache()
    train, test = rows.where("is_test = 0"), rows.where("is_test = 1")
    more = training.oversample(training.replicate(train.drop("is_test")), "label", [*KEY, "copy"])
    model = training.fit_mlp(more.select("label", "features"), hidden=256, iterations=500)
    return _evaluated(model, test, test)


def _lesson(spark, d):
    """What a text student of the linear head learns from: labels of people first, the head's for the rest. It keeps the recipe's words,
    accents and all, since its terms are looked up among these."""
    e = C.entries(spark, d, "title", "description", "content", "source_type")
    return e, C.labels(spark, d), C.model_scores(spark, d), C.PROFILE


@query()
def q61_distill_student(spark, d):
    """A recipe distilled from the student: signed top words and source types of each class, boosted, normalised, held within the caps."""
    return driver.distil(*_lesson(spark, d), C.PATTERNS, words=X.recipe_words)[0].withColumn("weight", F.col("weight").cast("double"))


@query()
def q62_embed_batch(spark, d):
    """Vectors for the entries that have none, by the hashing model."""
    e = C.entries(spark, d, "title", "description", "content", "source_name", "source_category", "source_type", "embedding")
    v = features.embed_pending(e.withColumn("embedding", F.when(F.size("embedding") == 64, F.col("embedding"))), X.model_text())
    return v.select(*KEY, F.size("embedding").alias("dim"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 4).alias("norm2"))


@query(f"WITH {C.L} SELECT entry_type, entry_id, label, reasoning, updated_at AS labeled_at FROM l WHERE profile_id = {C.PROFILE}")
def q63_package_roundtrip(spark, d):
    """A profile's labels written as a package and read back."""
    folder = scratch(spark, "package")
    mine = C.labels(spark, d).where(F.col("profile_id") == C.PROFILE).select(*KEY, "label", "reasoning", "updated_at")
    packages.write_package(f"{folder}/model.zip", packages.manifest("desk", "0", 1, mine), mine)
    return packages.read_labels(spark, folder).select(*KEY, "label", "reasoning", "labeled_at")


@query(f"WITH {C.L} SELECT 'desk' AS model_name, CAST(7 AS BIGINT) AS version, count(*) AS label_count, {', '.join(f'''CAST(sum(CASE WHEN label = '{c}' THEN 1 ELSE 0 END) AS BIGINT) AS {c}''' for c in CLASSES)} FROM l WHERE profile_id = {C.PROFILE}")
def q63_package_summary(spark, d):
    folder = scratch(spark, "package")
    mine = C.labels(spark, d).where(F.col("profile_id") == C.PROFILE).select(*KEY, "label", "reasoning", "updated_at")
    head = packages.manifest("desk", "0", 7, mine)
    packages.write_package(f"{folder}/model.zip", head, mine)
    return packages.summaries(spark, folder).select("model_name", "version", "label_count", *CLASSES)


@query("""SELECT entry_type, entry_id, title, source_type FROM (SELECT *, row_number() OVER (PARTITION BY entry_type, entry_id ORDER BY fetched_at DESC NULLS LAST) AS rn FROM entries) WHERE rn = 1""")
def q64_stream_ingest_upsert(spark, d):
    """All entries landed as files and upserted by a stream that runs until nothing is left."""
    root = scratch(spark, "stream")
    cols = [c for c in table(spark, d, "entries").columns if c != "embedding"]
    table(spark, d, "entries").select(*cols).repartition(2).write.parquet(f"{root}/landing")
    schema = table(spark, d, "entries").select(*cols).schema
    stream = ingest.landing(spark, f"{root}/landing", schema, files_per_batch=1, fmt="parquet")
    snap = SnapshotTable(spark, f"{root}/entries")
    ingest.ingest_entries(stream, snap, f"{root}/checkpoint", C.NOW).awaitTermination()
    return snap.read().select(*KEY, "title", "source_type")


@query("SELECT entry_type, entry_id, label, reasoning, labeled_at FROM (SELECT *, row_number() OVER (PARTITION BY entry_type, entry_id ORDER BY coalesce(labeled_at, '') DESC, label, coalesce(reasoning, '')) AS rn FROM remote_labels) WHERE rn = 1")
def q64_stream_latest_labels(spark, d):
    root = scratch(spark, "stream")
    src = table(spark, d, "remote_labels")
    src.repartition(3).write.parquet(f"{root}/landing")
    stream = ingest.landing(spark, f"{root}/landing", src.schema, files_per_batch=1, fmt="parquet")
    snap = SnapshotTable(spark, f"{root}/labels")
    ingest.ingest_labels(stream, snap, f"{root}/checkpoint").awaitTermination()
    return snap.read()


@query()
def q65_explain_tfidf(spark, d):
    """What the student's words add to each entry's class."""
    learnt = driver.student(*_lesson(spark, d), words=X.recipe_words)
    return explain.explain_linear(learnt.vectors, learnt.terms, learnt.head)


@query(f"""WITH {C.E} SELECT entry_type, entry_id, CASE WHEN length(title) > 300 THEN left(title, 300) || '...' ELSE title END AS title, left(published_date, 10) AS day,
 CASE WHEN description IS DISTINCT FROM content THEN CASE WHEN length(description) > 400 THEN left(description, 400) || '...' ELSE description END END AS description,
 CASE WHEN length(content) > 600 THEN left(content, 600) || '...' ELSE content END AS content FROM e""")
def q72_display_cards(spark, d):
    e = C.entries(spark, d, "title", "description", "content", "published_date")
    text = F.when(~F.col("description").eqNullSafe(F.col("content")), X.shorten(F.col("description"), 400))
    return e.select(*KEY, X.shorten(F.col("title"), 300).alias("title"), F.substring("published_date", 1, 10).alias("day"), text.alias("description"), X.shorten(F.col("content"), 600).alias("content"))


@query("""WITH a AS (SELECT id, lower(trim(coalesce(accent_color, ''))) AS s FROM profiles), b AS (SELECT id, CASE WHEN regexp_matches(s, '^#[0-9a-f]{3}$') THEN regexp_replace(s, '([0-9a-f])', '\\1\\1', 'g') WHEN regexp_matches(s, '^#[0-9a-f]{6}$') THEN s END AS colour FROM a)
 SELECT id, colour, CASE WHEN colour IS NULL THEN NULL WHEN (CAST('0x' || substr(colour, 2, 2) AS INTEGER) * 299 + CAST('0x' || substr(colour, 4, 2) AS INTEGER) * 587 + CAST('0x' || substr(colour, 6, 2) AS INTEGER) * 114) / 255000.0 > 0.55 THEN '#000000' ELSE '#ffffff' END AS text_colour FROM b""")
def q73_accents(spark, d):
    p = table(spark, d, "profiles").select("id", X.hex_colour(F.col("accent_color")).alias("colour"))
    return p.select("id", "colour", X.contrast(F.col("colour")).alias("text_colour"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY ALL")
def q74_event_windows(spark, d):
    w = ingest.tumbling(table(spark, d, "events"))
    return w.withColumn("total", F.col("total").cast("double"))


@query(f"""WITH {C.L}, k AS (SELECT DISTINCT entry_type, entry_id FROM l) SELECT entry_type, count(*) AS n, sum(CASE WHEN EXISTS (SELECT 1 FROM l WHERE l.profile_id = {C.PROFILE} AND l.entry_type = k.entry_type AND l.entry_id = k.entry_id) THEN 1 ELSE 0 END)::BIGINT AS mine FROM k GROUP BY ALL""")
def q75_labeled_keys(spark, d):
    k = C.labels(spark, d).groupBy(*KEY).agg(F.max(F.when(F.col("profile_id") == C.PROFILE, 1).otherwise(0)).alias("mine"))
    return k.groupBy("entry_type").agg(F.count("*").alias("n"), F.sum("mine").alias("mine"))


@query(f"""WITH {C.E}, {C.VEC}, {C.MODEL} SELECT entry_type, predicted_label, count(*) AS n, round(sum(round((relevance_score * 0.9 + p_investigation_lead * 0.1) * 10000)) / 10000, 1) AS total FROM ms JOIN v USING (entry_type, entry_id) GROUP BY ALL""")
def q76_lead_blend(spark, d):
    from tidemark.functions.scores import lead_blend

    s = C.model_scores(spark, d).withColumn("b", F.round(lead_blend(F.col("relevance_score"), F.col("p_investigation_lead"), 0.1) * 10000))
    return s.groupBy("entry_type", "predicted_label").agg(F.count("*").alias("n"), F.round(F.sum("b") / 10000, 1).alias("total"))


QUERIES = Q
ORACLE = SQL
