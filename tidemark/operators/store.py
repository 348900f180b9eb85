"""The entry, label and model store as pure functions from tables to tables.

A change is never made in place: each function takes the table as it is and returns it as it shall be; the caller
writes a new snapshot (``sources.snapshots``).  Times are passed in, so a rerun gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import blank
from tidemark.schemas import CLASSES, KEY, LABEL_KEY

TEXTS = ["title", "description", "content"]
SOURCES = ["source_name", "source_category", "source_type"]


def confirmed(pending: str = "pending_job_id") -> Column:
    """A label that waits for nobody's decision: no job, or a blank one."""
    return F.trim(blank(pending)) == ""


def of_job(job: str, pending: str = "pending_job_id") -> Column:
    """Labels waiting under one job; a blank job names none."""
    return F.lit(bool(job and job.strip())) & (F.trim(blank(pending)) == F.lit((job or "").strip()))


def valid_label(label: str = "label") -> Column:
    return F.coalesce(F.lower(F.trim(F.col(label))).isin(CLASSES), F.lit(False))


def keep_last(df: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """One row a key, the last in the given order (pass it descending)."""
    rn = "__rn"
    while rn in df.columns:
        rn += "_"
    return df.withColumn(rn, F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col(rn) == 1).drop(rn)


def current_entries(entries: DataFrame, *columns: str) -> DataFrame:
    """Entries without repeated deliveries: the latest ``fetched_at`` of each key. Only ``columns`` (and the key) are carried
    through the shuffle; by default all but the vector."""
    cols = list(columns) or [c for c in entries.columns if c != "embedding"]
    df = entries.select(*dict.fromkeys([*KEY, *cols, "fetched_at"]))
    out = keep_last(df, KEY, F.col("fetched_at").desc_nulls_last())
    return out.select(*dict.fromkeys([*KEY, *cols]))


def current_labels(labels: DataFrame) -> DataFrame:
    """Labels without repeated rows: the latest of each profile and entry."""
    return keep_last(labels, LABEL_KEY, F.col("updated_at").desc_nulls_last(), F.col("created_at").desc_nulls_last(), F.col("label"))


def upsert_entries(base: DataFrame, delta: DataFrame, now: str, ordinal: str | None = None) -> DataFrame:
    """Insert or overwrite entries by key.

    Of a key repeated in ``delta`` the last row counts (by ``ordinal``, else by its own ``fetched_at``).  New rows and changed rows
    get ``fetched_at = now``; a row's vector survives unless a text definitely differs (null against
    anything is no difference) or a source field differs with null as empty.  Changed link, author or date keep it.
    """
    d = keep_last(delta, KEY, F.col(ordinal or "fetched_at").desc_nulls_last())
    data = [c for c in base.columns if c not in (*KEY, "embedding", "fetched_at", "id")]
    d = d.select(*KEY, *[F.col(c).alias(f"__d_{c}") for c in data], F.lit(True).alias("__new"))
    j = base.withColumn("__old", F.lit(True)).join(d, KEY, "full")
    new, old = F.coalesce("__new", F.lit(False)), F.coalesce("__old", F.lit(False))
    changed = F.lit(False)
    for c in TEXTS:
        changed = changed | F.coalesce(F.col(c) != F.col(f"__d_{c}"), F.lit(False))
    for c in SOURCES:
        changed = changed | (blank(c) != blank(f"__d_{c}"))
    out = {c: F.when(new, F.col(f"__d_{c}")).otherwise(F.col(c)) for c in data}
    out["fetched_at"] = F.when(new, F.lit(now)).otherwise(F.col("fetched_at"))
    if "embedding" in base.columns:
        out["embedding"] = F.when(~(new & (changed | ~old)), F.col("embedding"))
    return j.select(*[out.get(c, F.col(c)).alias(c) for c in base.columns])


def set_embeddings(entries: DataFrame, vectors: DataFrame) -> DataFrame:
    """Store vectors by key; keys without an entry are ignored."""
    v = vectors.select(*KEY, F.col("embedding").alias("__v")).dropDuplicates(KEY)
    return entries.join(v, KEY, "left").withColumn("embedding", F.coalesce("__v", "embedding")).select(*entries.columns)


def forget_embeddings(entries: DataFrame) -> DataFrame:
    return entries.withColumn("embedding", F.lit(None).cast(entries.schema["embedding"].dataType))


def upsert_labels(base: DataFrame, delta: DataFrame, now: str) -> DataFrame:
    """Set labels: the last row of a key in ``delta`` (by ``updated_at``) overwrites everything but ``created_at``."""
    d = current_labels(delta)
    rest = [c for c in base.columns if c not in (*LABEL_KEY, "created_at", "updated_at")]
    d = d.select(*LABEL_KEY, *[F.col(c).alias(f"__d_{c}") for c in rest], F.lit(True).alias("__new"))
    j = base.join(d, LABEL_KEY, "full")
    new = F.col("__new").isNotNull()
    out = {c: F.when(new, F.col(f"__d_{c}")).otherwise(F.col(c)) for c in rest}
    out["updated_at"] = F.when(new, F.lit(now)).otherwise(F.col("updated_at"))
    out["created_at"] = F.coalesce("created_at", F.when(new, F.lit(now)))
    return j.select(*[out.get(c, F.col(c)).alias(c) for c in base.columns])


def remove_labels(base: DataFrame, keys: DataFrame) -> DataFrame:
    return base.join(keys.select(*LABEL_KEY).distinct(), LABEL_KEY, "left_anti")


def confirm_job(labels: DataFrame, profile_id: int, job: str) -> DataFrame:
    hit = (F.col("profile_id") == profile_id) & of_job(job)
    return labels.withColumn("pending_job_id", F.when(~F.coalesce(hit, F.lit(False)), F.col("pending_job_id")))


def discard_job(labels: DataFrame, profile_id: int, job: str) -> DataFrame:
    hit = (F.col("profile_id") == profile_id) & of_job(job)
    return labels.where(~F.coalesce(hit, F.lit(False)))


def merge_remote_labels(local: DataFrame, remote: DataFrame, profile_id: int) -> DataFrame:
    """What each remote label does to a profile's labels, one row a valid remote key.

    Rows without type or label or with id 0 or null are left out; of a repeated key the newest counts.  ``action`` is ``new``,
    ``updated`` (remote newer as text, a missing time being the oldest) or ``kept``; ``conflict`` tells that the labels differ, also where the local one stays.
    """
    r = remote.where((F.trim(blank("entry_type")) != "") & (F.trim(blank("label")) != "") & (F.coalesce("entry_id", F.lit(0)) != 0))
    r = keep_last(r, KEY, blank("labeled_at").desc(), F.col("label"), blank("reasoning"))
    r = r.select(*KEY, F.col("label").alias("remote_label"), F.col("reasoning").alias("remote_reasoning"), blank("labeled_at").alias("remote_time"))
    mine = current_labels(local).where(F.col("profile_id") == profile_id)
    mine = mine.select(*KEY, F.col("label").alias("local_label"), blank("updated_at").alias("local_time"))
    j = r.join(mine, KEY, "left")
    action = F.when(F.col("local_label").isNull(), "new").when(F.col("remote_time") > F.col("local_time"), "updated").otherwise("kept")
    conflict = F.coalesce(F.col("local_label") != F.col("remote_label"), F.lit(False))
    return j.select(*KEY, "remote_label", "remote_reasoning", "remote_time", "local_label", "local_time", action.alias("action"), conflict.alias("conflict"))


def apply_merge(local: DataFrame, merged: DataFrame, profile_id: int, now: str, keep_remote_time: bool = False) -> DataFrame:
    """Labels after a merge: new and updated ones come from the other side with source ``remote`` and nothing pending."""
    d = merged.where(F.col("action") != "kept").select(
        F.lit(profile_id).cast("long").alias("profile_id"),
        *KEY,
        F.col("remote_label").alias("label"),
        F.col("remote_reasoning").alias("reasoning"),
        F.lit("remote").alias("label_source"),
        F.lit(None).cast("string").alias("pending_job_id"),
        F.lit(now).alias("created_at"),
        (F.col("remote_time") if keep_remote_time else F.lit(now)).alias("updated_at"),
    )
    rest = local.join(d.select(*LABEL_KEY), LABEL_KEY, "left_anti")
    return rest.unionByName(d.select(*local.columns))


def _imported(local: DataFrame, packaged: DataFrame, profile_id: int) -> DataFrame:
    """The package's rows with their ``outcome``; ``updated_at`` (or ``labeled_at``) is their time, a missing one the oldest."""
    time = [blank(c) for c in ("updated_at", "labeled_at") if c in packaged.columns]
    ok = (F.trim(blank("entry_type")) != "") & (F.trim(blank("label")) != "") & (F.coalesce("entry_id", F.lit(0)) != 0)
    mine = current_labels(local).where(F.col("profile_id") == profile_id).select(*KEY, blank("updated_at").alias("__mine"), F.col("created_at").alias("__created"), F.lit(True).alias("__have"))
    j = packaged.withColumns({"__ok": ok, "__time": F.coalesce(*[F.nullif(t, F.lit("")) for t in time], F.lit(""))}).join(mine, KEY, "left")
    outcome = F.when(~F.col("__ok"), "skipped").when(F.col("__have").isNull(), "imported").when(F.col("__time") > F.col("__mine"), "updated").otherwise("skipped")
    return j.withColumn("outcome", outcome)


def import_labels(local: DataFrame, packaged: DataFrame, profile_id: int) -> DataFrame:
    """Outcome of importing a package's labels: ``imported, updated, skipped`` over all its rows (empty and older ones are skipped)."""
    return _imported(local, packaged, profile_id).groupBy("outcome").agg(F.count("*").alias("n"))


def merge_imported(local: DataFrame, packaged: DataFrame, profile_id: int) -> DataFrame:
    """The label table after an import: newer rows of the package replace the profile's own and keep their times.

    Of a key repeated in the package the newest row counts, then the last label by its text.  The source is ``source`` or
    ``label_source``; nothing is pending afterwards.
    """
    new = keep_last(_imported(local, packaged, profile_id).where("outcome != 'skipped'"), KEY, F.col("__time").desc(), F.col("label").desc())
    have = set(packaged.columns)
    source = F.trim(F.coalesce(*[F.nullif(F.trim(blank(c)), F.lit("")) for c in ("source", "label_source") if c in have], F.lit("")))
    given = {
        "profile_id": F.lit(profile_id).cast("long"), "reasoning": blank("reasoning") if "reasoning" in have else F.lit(""), "label_source": source, "pending_job_id": F.lit(None).cast("string"),
        "created_at": F.coalesce("__created", blank("created_at") if "created_at" in have else F.lit("")), "updated_at": F.col("__time"),
    }
    rows = new.select(*[given.get(c, F.col(c) if c in have else F.lit(None)).cast(local.schema[c].dataType).alias(c) for c in local.columns])
    return local.join(rows.select(*LABEL_KEY), LABEL_KEY, "left_anti").select(*local.columns).unionByName(rows)


def merge_imported_entries(entries: DataFrame, packaged: DataFrame, now: str) -> DataFrame:
    """The entry table after an import: rows of the package that bring a title insert or overwrite their entry."""
    cols = [c for c in entries.columns if c not in ("id", "embedding", "fetched_at")]
    ok = (F.trim(blank("entry_type")) != "") & (F.trim(blank("label")) != "") & (F.coalesce("entry_id", F.lit(0)) != 0) & F.col("title").isNotNull()
    time = next((c for c in ("updated_at", "labeled_at") if c in packaged.columns), None)
    d = packaged.where(ok).select(*[(F.col(c) if c in KEY else blank(c) if c in packaged.columns else F.lit("")).alias(c) for c in cols], (blank(time) if time else F.lit("")).alias("fetched_at"))
    return upsert_entries(entries, d, now)


def activate_model(models: DataFrame, record: DataFrame) -> DataFrame:
    """Add a model as its profile's only active one."""
    added = record.select("profile_id").distinct().withColumn("__a", F.lit(True))
    old = models.join(added, "profile_id", "left").withColumn("is_active", F.when(F.col("__a").isNotNull(), F.lit(0)).otherwise(F.col("is_active")).cast(models.schema["is_active"].dataType))
    return old.select(*models.columns).unionByName(record.withColumn("is_active", F.lit(1).cast(models.schema["is_active"].dataType)).select(*models.columns))


def delete_profile(profile_id: int, **tables: DataFrame) -> dict[str, DataFrame]:
    """A profile's rows removed from every table that has them (``profiles`` by ``id``, others by ``profile_id``)."""
    return {k: t.where(~(F.coalesce(F.col("id" if k == "profiles" else "profile_id"), F.lit(-1)) == profile_id)) for k, t in tables.items()}


def set_default_profile(profiles: DataFrame, profile_id: int) -> DataFrame:
    return profiles.withColumn("is_default", F.when(F.col("id") == profile_id, 1).otherwise(0).cast("long"))


def update_profile(profiles: DataFrame, profile_id: int, **values: object) -> DataFrame:
    """Set columns of one profile (name, description, accent, persona, ...); null values and unknown columns change nothing.

    A profile made the default takes that from the others; a ``slug`` in use by another profile is refused.
    """
    values = {k: v for k, v in values.items() if v is not None and k in profiles.columns and k != "id"}
    if "slug" in values and profiles.where((F.col("slug") == values["slug"]) & (F.col("id") != profile_id)).limit(1).count():
        raise ValueError(f"slug {values['slug']!r} is in use")
    hit = F.col("id") == profile_id
    out = profiles.withColumn("is_default", F.lit(0).cast(profiles.schema["is_default"].dataType)) if values.get("is_default") == 1 else profiles
    return out.select(*[(F.when(hit, F.lit(values[c])).otherwise(F.col(c)).cast(profiles.schema[c].dataType).alias(c) if c in values else F.col(c)) for c in profiles.columns])


def profile_record(profiles: DataFrame, profile_id: int) -> DataFrame:
    """A profile in the older shape of a single model's: ``model_name, description, created_at, profile_id, slug``."""
    return profiles.where(F.col("id") == profile_id).select(F.col("display_name").alias("model_name"), "description", "created_at", F.col("id").alias("profile_id"), "slug")


def set_profile_record(profiles: DataFrame, model_name: str, description: str, profile_id: int, slug: str, now: str) -> DataFrame:
    """Name and description of a profile; one that is missing is added as the default."""
    if profiles.where(F.col("id") == profile_id).limit(1).count():
        return update_profile(profiles, profile_id, display_name=model_name, description=description or "")
    row = {c: None for c in profiles.columns} | {"id": profile_id, "slug": slug, "display_name": model_name, "description": description or "", "is_default": 1, "created_at": now, "training_settings": "{}"}
    return profiles.unionByName(profiles.sparkSession.createDataFrame([tuple(row[c] for c in profiles.columns)], profiles.schema))


def create_profile(profiles: DataFrame, slug: str, name: str, now: str) -> DataFrame:
    """Add a profile: the first one is the default; a slug in use gets the next free number."""
    spark = profiles.sparkSession
    taken = {r.slug for r in profiles.where(F.col("slug").rlike(f"^{slug}(-[0-9]+)?$")).select("slug").collect()}
    free, i = slug, 0
    while free in taken:
        i += 1
        free = f"{slug}-{i}"
    s = profiles.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m"), F.count("*").alias("n")).first()
    row = {c: None for c in profiles.columns} | {"id": s.m + 1, "slug": free, "display_name": name, "is_default": int(s.n == 0), "created_at": now, "training_settings": "{}"}
    return profiles.unionByName(spark.createDataFrame([tuple(row[c] for c in profiles.columns)], profiles.schema))


def merge_settings(settings: Column, changes: Column) -> Column:
    """JSON objects merged, the changes winning; anything but an object counts as empty."""
    m = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))
    kept = F.map_filter(m(settings), lambda k, _: ~F.array_contains(F.map_keys(m(changes)), k))
    return F.to_json(F.map_concat(kept, m(changes)))


def append_log(log: DataFrame, profile_id: int | None, direction: str, n: int, details: str, now: str) -> DataFrame:
    """One more row of the sync log; a missing profile means all."""
    top = log.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]
    row = {"id": top + 1, "profile_id": profile_id, "direction": direction, "items_count": n, "details": details, "synced_at": now}
    return log.unionByName(log.sparkSession.createDataFrame([tuple(row[c] for c in log.columns)], log.schema))


def migrate(df: DataFrame, schema, **defaults: object) -> DataFrame:
    """Bring a table to ``schema``: missing columns are added with their default (else null), types are cast, extra columns kept."""
    have = {c.lower(): c for c in df.columns}
    cols = [(F.col(have[f.name.lower()]) if f.name.lower() in have else F.lit(defaults.get(f.name))).cast(f.dataType).alias(f.name) for f in schema.fields]
    names = {f.name.lower() for f in schema.fields}
    return df.select(*cols, *[F.col(c) for c in df.columns if c.lower() not in names])
