"""Model artefacts: the fitted pipeline, its calibration and its record, kept by profile and version."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schemas import CLASSES, MODELS


def model_path(root: str, profile_id: int, version: int) -> str:
    """Profile and version are both in the path, so equal versions of two profiles never meet."""
    return f"{root.rstrip('/')}/profile={profile_id}/version={version}"


def save_model(spark: SparkSession, root: str, profile_id: int, version: int, model: PipelineModel, temperature: float, classes: list[str] | None = None) -> str:
    path = model_path(root, profile_id, version)
    model.write().overwrite().save(f"{path}/model")
    doc = {"version": 1, "method": "temperature", "temperature": temperature, "class_names": classes or sorted(CLASSES)}
    spark.createDataFrame([(json.dumps(doc),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/calibration")
    return path


def load_model(root: str, profile_id: int, version: int) -> PipelineModel:
    return PipelineModel.load(f"{model_path(root, profile_id, version)}/model")


def load_temperature(spark: SparkSession, path: str, classes: list[str] | None = None) -> float:
    """The stored temperature; 1.0 where there is none, it is unreadable, or it belongs to other classes."""
    try:
        doc = json.loads(spark.read.text(f"{path}/calibration").first().value)
    except Exception:  # missing or broken: uncalibrated
        return 1.0
    if not isinstance(doc, dict) or doc.get("class_names") != (classes or sorted(CLASSES)):
        return 1.0
    t = doc.get("temperature")
    return float(t) if isinstance(t, (int, float)) and t > 0 else 1.0


def record(spark: SparkSession, models: DataFrame, profile_id: int, version: int, metrics: DataFrame, labels: DataFrame, architecture: str, now: str) -> DataFrame:
    """A model row from its metrics (``training.metrics``) and the labels it was trained on."""
    macro = metrics.where("class = 'macro'").first()
    counts = {r["label"]: r["n"] for r in labels.where(F.col("label").isin(CLASSES)).groupBy("label").agg(F.count("*").alias("n")).collect()}
    top = models.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]
    dist = {c: counts.get(c, 0) for c in CLASSES}
    row = (top + 1, profile_id, version, macro["accuracy"], macro["f1"], sum(dist.values()), json.dumps(dist), architecture, now, 1)
    return spark.createDataFrame([row], MODELS)


def distribution(*columns: str):
    """The first label distribution (JSON) that is not all zero, else the last."""
    kind = "map<string,long>"
    filled = lambda c: F.aggregate(F.map_values(F.coalesce(F.from_json(c, kind), F.create_map().cast(kind))), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0).cast("long"))) > 0
    out = F.col(columns[-1])
    for c in reversed(columns[:-1]):
        out = F.when(filled(c), F.col(c)).otherwise(out)
    return out
