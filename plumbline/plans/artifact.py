"""Fitted experiments as folders: a pipeline, and a manifest that is checked before anything is loaded."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict
from datetime import UTC, datetime

import pyspark
from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from plumbline.operators.preprocess import Statistics
from plumbline.plans.experiment import Fitted, Result, Spec
from plumbline.sources.csv_scan import byte_length
from plumbline.sources.scored_csv import slug

FORMAT_VERSION = 1
MAX_BYTES = 100 * 1024 * 1024
#: Keys that a manifest must have, and the types of their values.
REQUIRED = {"format_version": int, "created_at": str, "dataset": dict, "spec": dict, "statistics": dict, "metrics": dict, "verdict": dict, "leakage": list, "versions": dict, "payload_sha256": str}


class ArtifactError(ValueError):
    """code is too-large, invalid-format, unsupported-version, hash-mismatch or schema-mismatch."""

    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


def folder_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 over relative paths and digests of a folder's files, in order of path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    rows = files.select("path", F.sha2("content", 256).alias("sha")).collect()  # a row per file of one model
    lines = sorted(f"{r['path'].partition(path.rstrip('/').rpartition('/')[2])[2]}:{r['sha']}" for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def _write_text(spark: SparkSession, text: str, path: str) -> None:
    spark.range(1).select(F.lit(text).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def save(fitted: Fitted, result: Result, path: str, dataset: str, name: str | None = None, sanitation: dict | None = None, now: datetime | None = None) -> dict:
    """Writes the pipeline and its manifest under path; returns the manifest."""
    spark = SparkSession.getActiveSession()
    fitted.pipeline.write().overwrite().save(f"{path}/pipeline")
    manifest = {
        "format_version": FORMAT_VERSION,
        "created_at": (now or datetime.now(UTC)).isoformat(),
        "dataset": {"name": dataset, "rows": result.spec.rows, "train": result.train_rows, "test": result.test_rows},
        "spec": asdict(fitted.spec),
        "statistics": asdict(fitted.statistics),
        "metrics": result.scores[result.winner],
        "model": result.winner,
        "verdict": asdict(result.verdict),
        "leakage": [list(x) for x in result.leakage],
        "versions": {"pyspark": pyspark.__version__},
        "payload_sha256": folder_digest(spark, f"{path}/pipeline"),
    }
    manifest |= {"model_name": name} if name else {}
    manifest |= {"sanitation": sanitation} if sanitation else {}
    _write_text(spark, json.dumps(manifest), f"{path}/manifest")
    return manifest


def validate(text: str) -> tuple[dict, list[str]]:
    """The manifest and warnings, or ArtifactError; other versions of the engine are a warning only."""
    try:
        manifest = json.loads(text)
    except ValueError:
        raise ArtifactError("invalid-format") from None
    if not isinstance(manifest, dict) or not isinstance(manifest.get("format_version"), int) or isinstance(manifest["format_version"], bool):
        raise ArtifactError("invalid-format")
    if manifest["format_version"] != FORMAT_VERSION:
        raise ArtifactError("unsupported-version")
    if any(not isinstance(manifest.get(k), kind) for k, kind in REQUIRED.items()):
        raise ArtifactError("invalid-format")
    made = manifest["versions"].get("pyspark")
    return manifest, [] if made == pyspark.__version__ else [f"saved by pyspark {made}, read by {pyspark.__version__}"]


def load(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> tuple[Fitted, dict, list[str]]:
    """The fitted experiment, its manifest and warnings. Size, manifest and digest are checked first."""
    if byte_length(spark, f"{path}/manifest") > max_bytes or _size(spark, f"{path}/pipeline") > max_bytes:
        raise ArtifactError("too-large")
    manifest, warnings = validate("\n".join(r["value"] for r in spark.read.text(f"{path}/manifest").collect()))
    if folder_digest(spark, f"{path}/pipeline") != manifest["payload_sha256"]:
        raise ArtifactError("hash-mismatch")
    try:
        spec, statistics = Spec(**manifest["spec"]), Statistics(**manifest["statistics"])
    except TypeError:
        raise ArtifactError("invalid-format") from None
    if set(statistics.medians) != set(spec.numeric) or set(statistics.categories) != set(spec.categorical):
        raise ArtifactError("schema-mismatch")
    return Fitted(spec, statistics, PipelineModel.load(f"{path}/pipeline")), manifest, warnings


def _size(spark: SparkSession, path: str) -> int:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


def file_name(dataset: str, day: datetime) -> str:
    return f"modelo-{slug(dataset, 'experimento')}-{day:%Y-%m-%d}"
