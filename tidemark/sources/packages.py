"""Model packages: zip files of ``manifest.json``, ``labels.json``, ``recipe.json`` and ``calibration.json``."""

from __future__ import annotations

import io
import json
import zipfile
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schemas import CLASSES, KEY

FORMAT = 1
LABEL_LIMIT = 2_000_000


def manifest(name: str, uuid: str, version: int, labels: DataFrame, metrics: dict | None = None, chain: list[dict] | None = None) -> dict:
    counts = {r["label"]: r["n"] for r in labels.groupBy("label").agg(F.count("*").alias("n")).collect()}
    return {
        "manifest_format_version": FORMAT, "model_name": name, "model_uuid": uuid, "version": version, "label_count": sum(counts.values()),
        "label_distribution": {c: counts.get(c, 0) for c in CLASSES}, "metrics": metrics or {}, "version_chain": chain or [],
    }


def write_package(path: str, head: dict, labels: DataFrame, recipe_json: str = "{}", calibration: dict | None = None) -> str:
    """Write a package. A package is one file a person carries, so its labels are counted first and refused beyond ``LABEL_LIMIT``;
    larger label sets are written as JSON directories with ``labels.write.json``."""
    n = labels.count()
    if n > LABEL_LIMIT:
        raise ValueError(f"{n} labels are too many for one package; write them with labels.write.json")
    rows = [json.loads(r) for r in labels.select(F.to_json(F.struct(*labels.columns))).toPandas().iloc[:, 0]]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("manifest.json", json.dumps(head, ensure_ascii=False))
        z.writestr("labels.json", json.dumps(rows, ensure_ascii=False))
        z.writestr("recipe.json", recipe_json)
        z.writestr("calibration.json", json.dumps(calibration or {"version": 1, "method": "temperature", "temperature": 1.0, "class_names": sorted(CLASSES)}))
    sc = labels.sparkSession.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)  # any file system Spark knows
    stream = p.getFileSystem(sc._jsc.hadoopConfiguration()).create(p, True)
    stream.write(bytearray(out.getvalue()))
    stream.close()
    return path


def _member(content: bytes, name: str) -> object:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return json.loads(z.read(name).decode("utf-8"))


def list_packages(spark: SparkSession, folder: str, pattern: str = "*.zip") -> DataFrame:
    """``(path, modified, length)`` of the packages of a folder, newest first."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", F.col("modificationTime").alias("modified"), "length")
    return df.orderBy(F.col("modified").desc(), "path")


def read_labels(spark: SparkSession, folder: str, pattern: str = "*.zip") -> DataFrame:
    """``(path, key, label, reasoning, labeled_at)`` of all packages; broken packages give no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, content in zip(pdf.path, pdf.content):
                try:
                    rows = _member(content, "labels.json")
                except (zipfile.BadZipFile, KeyError, ValueError):
                    continue
                out += [(path, *(None if r.get(k) is None else str(r[k]) for k in (*KEY, "label", "reasoning", "updated_at"))) for r in rows if isinstance(r, dict)]
            yield pd.DataFrame(out, columns=["path", *KEY, "label", "reasoning", "labeled_at"])

    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content")
    rows = raw.mapInPandas(run, "path string, entry_type string, entry_id string, label string, reasoning string, labeled_at string")
    return rows.withColumn("entry_id", F.col("entry_id").try_cast("long"))


def summaries(spark: SparkSession, folder: str, pattern: str = "*.zip") -> DataFrame:
    """One row a package, also for broken ones: name, version, label count, the larger of the manifest's and the counted labels by class, errors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, content in zip(pdf.path, pdf.content):
                errors, head, rows = [], {}, []
                for name in ("manifest.json", "labels.json"):
                    try:
                        got = _member(content, name)
                    except (zipfile.BadZipFile, KeyError, ValueError) as e:
                        errors.append(f"{name}: {type(e).__name__}")
                        continue
                    if name == "manifest.json":
                        head = got if isinstance(got, dict) else {}
                    else:
                        rows = got if isinstance(got, list) else []
                told = head.get("label_distribution") or {}
                counted = Counter(r.get("label") for r in rows if isinstance(r, dict))
                dist = [max(int(told.get(c) or 0), counted.get(c, 0)) for c in CLASSES]
                out.append((path, head.get("model_name"), head.get("version"), int(head.get("label_count") or 0) or len(rows), *dist, errors))
            yield pd.DataFrame(out, columns=["path", "model_name", "version", "label_count", *CLASSES, "errors"])

    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content")
    return raw.mapInPandas(run, f"path string, model_name string, version long, label_count long, {', '.join(f'{c} long' for c in CLASSES)}, errors array<string>")


def accepts(imported: int, local: int | None, force: bool = False) -> bool:
    """May an imported version replace the local one?"""
    return force or local is None or imported >= local


def safe_path(folder: str, name: str, suffix: str = ".zip") -> Path | None:
    """A package's path inside its folder, None for anything that leads out of it."""
    base = Path(folder).resolve()
    p = (base / name).resolve()
    return p if p.suffix == suffix and p.parent == base else None
