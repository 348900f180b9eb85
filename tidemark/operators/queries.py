"""Reads of the store: queues, distributions, pushes, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scores import day_window
from tidemark.functions.text import blank
from tidemark.operators.store import confirmed, current_labels
from tidemark.schemas import CLASSES, KEY, LABEL_KEY



def newest() -> list[Column]:
    return [F.col("published_date").desc_nulls_last(), F.col("entry_type"), F.col("entry_id")]


def profile(profiles: DataFrame, profile_id: int | None = None, slug: str | None = None) -> DataFrame:
    """One profile: by id, by slug, or the default one (the lowest id if none is marked)."""
    if profile_id is not None:
        return profiles.where(F.col("id") == profile_id)
    if slug is not None:
        return profiles.where(F.col("slug") == slug).orderBy("id").limit(1)
    return profiles.orderBy(F.col("is_default").desc_nulls_last(), "id").limit(1)


def profiles_in_order(profiles: DataFrame) -> DataFrame:
    return profiles.orderBy(F.col("is_default").desc_nulls_last(), "id")


def models_in_order(models: DataFrame, profile_id: int) -> DataFrame:
    return models.where(F.col("profile_id") == profile_id).orderBy(F.col("version").desc(), F.col("id").desc())


def lookup(entries: DataFrame, keys: DataFrame) -> DataFrame:
    """The entries of some keys (a left semi join, for one key or millions)."""
    return entries.join(keys.select(*KEY).distinct(), KEY, "left_semi")


def label_of(labels: DataFrame, profile_id: int, keys: DataFrame) -> DataFrame:
    """Label and reasoning of some keys in a profile; keys without a label give nulls."""
    mine = current_labels(labels).where(F.col("profile_id") == profile_id).select(*KEY, "label", "reasoning")
    return keys.select(*KEY).distinct().join(mine, KEY, "left")


def type_of_alias(alias: str | None) -> str | None:
    """Short names of entry types; anything else means all types."""
    return {"lex": "lex_item", "news": "feed_item"}.get((alias or "").strip().lower())


def of_type(entries: DataFrame, alias: str | None) -> DataFrame:
    t = type_of_alias(alias)
    return entries.where(F.col("entry_type") == t) if t else entries


def unlabeled(entries: DataFrame, labels: DataFrame, profile_id: int) -> DataFrame:
    """Entries the profile has no label for, pending ones counting as labels (left anti join on the key)."""
    return entries.join(labels.where(F.col("profile_id") == profile_id).select(*KEY), KEY, "left_anti")


def labeled(entries: DataFrame, labels: DataFrame, profile_id: int) -> DataFrame:
    """Entries with the profile's label as ``user_label``, pending ones included."""
    mine = current_labels(labels).where(F.col("profile_id") == profile_id)
    return entries.join(mine.select(*KEY, F.col("label").alias("user_label")), KEY)


def training_rows(entries: DataFrame, labels: DataFrame, profile_id: int) -> DataFrame:
    """The profile's confirmed labels with their entries."""
    mine = current_labels(labels).where((F.col("profile_id") == profile_id) & confirmed())
    return mine.drop("profile_id").join(entries, KEY)


def export_rows(entries: DataFrame, labels: DataFrame, profile_id: int) -> DataFrame:
    """The profile's labels, pending ones too, with what is known of their entries; a blank source is left out (null)."""
    mine = current_labels(labels).where(F.col("profile_id") == profile_id).drop("profile_id")
    source = F.when(F.trim(blank("label_source")) != "", F.col("label_source"))
    return mine.join(entries, KEY, "left").withColumn("source", source).drop("label_source")


def label_counts(labels: DataFrame) -> DataFrame:
    """Confirmed labels by profile and class."""
    return current_labels(labels).where(confirmed()).groupBy("profile_id", "label").agg(F.count("*").alias("n"))


def filled_distribution(labels: DataFrame) -> DataFrame:
    """Confirmed labels by profile over all four classes, zeros included."""
    every = labels.select("profile_id").distinct().withColumn("label", F.explode(F.array(*[F.lit(c) for c in CLASSES])))
    return every.join(label_counts(labels), ["profile_id", "label"], "left").fillna(0, ["n"])


def category_counts(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """Entries with a confirmed label by profile and category (blank ones left out)."""
    j = current_labels(labels).where(confirmed()).select(*LABEL_KEY).join(entries.select(*KEY, "source_category"), KEY)
    return j.where(F.trim(blank("source_category")) != "").groupBy("profile_id", "source_category").agg(F.count("*").alias("n"))


def recent(entries: DataFrame, now: str, days: int) -> DataFrame:
    """Entries whose date, as text, is not before the day ``days`` ago."""
    return entries.where(F.col("published_date") >= day_window(now, days))


def last_label_push(log: DataFrame) -> DataFrame:
    """Time of the newest successful label push of each profile that has one; rows without a profile hold for all (null)."""
    hit = (F.col("direction") == "push") & F.col("details").ilike("%labels pushed%")
    return log.where(hit).groupBy("profile_id").agg(F.max("synced_at").alias("last_push"))


def push_increment(labels: DataFrame, log: DataFrame, profile_id: int) -> DataFrame:
    """The profile's confirmed labels changed since its last label push (all of them before the first)."""
    pushes = last_label_push(log.where((F.col("profile_id") == profile_id) | F.col("profile_id").isNull()))
    last = pushes.agg(F.coalesce(F.max("last_push"), F.lit("")).alias("last_push"))
    mine = current_labels(labels).where((F.col("profile_id") == profile_id) & confirmed())
    return mine.where(blank("updated_at") > last.scalar())


def recent_syncs(log: DataFrame, profile_id: int, limit: int = 20) -> DataFrame:
    """The newest log rows of a profile or of all."""
    mine = log.where((F.col("profile_id") == profile_id) | F.col("profile_id").isNull())
    return mine.orderBy(F.col("synced_at").desc_nulls_last(), F.col("id").desc()).limit(limit)


def sync_health(log: DataFrame) -> DataFrame:
    """Of each direction the last row and whether it worked."""
    last = log.groupBy("direction").agg(F.max_by(F.struct("synced_at", "details", "id"), F.struct("synced_at", "id")).alias("x"))
    ok = ~F.startswith(blank("x.details"), F.lit("FAILED"))
    return last.select("direction", F.col("x.synced_at").alias("synced_at"), F.col("x.details").alias("details"), ok.cast("int").alias("ok"))


def active_models(models: DataFrame) -> DataFrame:
    """The latest active model of each profile."""
    w = Window.partitionBy("profile_id").orderBy(F.col("id").desc())
    return models.where("is_active = 1").withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def next_versions(models: DataFrame, profiles: DataFrame) -> DataFrame:
    top = models.groupBy(F.col("profile_id").alias("id")).agg(F.max("version").alias("v"))
    return profiles.select("id").join(top, "id", "left").select(F.col("id").alias("profile_id"), (F.coalesce("v", F.lit(0)) + 1).alias("next_version"))


def version_chain(models: DataFrame) -> DataFrame:
    """Versions of each profile oldest first, with what changed since the one before."""
    w = Window.partitionBy("profile_id").orderBy("version", "id")
    return models.select(
        "profile_id", "version", F.row_number().over(w).alias("step"), F.lag("version").over(w).alias("previous"),
        F.round(F.col("accuracy") - F.lag("accuracy").over(w), 6).alias("accuracy_change"), (F.col("label_count") - F.lag("label_count").over(w)).alias("labels_added"),
    )


def profile_label_counts(profiles: DataFrame, labels: DataFrame) -> DataFrame:
    n = current_labels(labels).where(confirmed()).groupBy(F.col("profile_id").alias("id")).agg(F.count("*").alias("n_labels"))
    return profiles.join(n, "id", "left").select("id", "slug", "is_default", F.coalesce("n_labels", F.lit(0)).cast("long").alias("n_labels"))


def coverage(models: DataFrame, labels: DataFrame) -> DataFrame:
    """Share of today's labels each active model was trained on, in per cent, at most 100."""
    n = current_labels(labels).where(confirmed()).groupBy("profile_id").agg(F.count("*").alias("n_labels"))
    j = active_models(models).select("profile_id", "version", "label_count").join(n, "profile_id", "left")
    share = F.when(F.col("n_labels") > 0, F.least(F.lit(100.0), F.round(F.col("label_count") * 100.0 / F.col("n_labels"), 1))).otherwise(0.0)
    return j.select("profile_id", "version", share.alias("coverage"))
