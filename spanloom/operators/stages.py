"""Stages of a study with resume: a rerun begins at the first stage whose inputs, parameters or code have changed.

A stage's output is a folder named by its fingerprint, which takes in its version and parameters, its source files (path,
size, time of change) and the fingerprints of the stages before it. The folder counts once Spark has put its _SUCCESS
mark there, so a stage that was killed is run again and a later one never reads half of it. Nothing but the folders is kept.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Stage:
    """name; make(spark, inputs, **options) with a frame for each of inputs (stages before) and paths (source tables, Parquet);
    version changes when its code does."""

    name: str
    make: Callable[..., DataFrame]
    inputs: tuple[str, ...] = ()
    paths: dict[str, str] = field(default_factory=dict)
    options: dict = field(default_factory=dict)
    version: str = "1"


def _files(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Path, size and time of every file under a path, in order of path."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, each = [], store.listFiles(at, True)
    while each.hasNext():
        f = each.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(found)


def _there(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def plan(spark: SparkSession, stages: list[Stage], root: str) -> list[tuple[Stage, str, bool]]:
    """Each stage with its output folder and whether that is complete; order and names are checked."""
    prints: dict[str, str] = {}
    out = []
    for s in stages:
        missing = [i for i in s.inputs if i not in prints]
        if missing or s.name in prints:
            raise ValueError(f"stage {s.name}: unknown inputs {missing}" if missing else f"two stages are named {s.name}")
        about = [s.name, s.version, s.options, {k: _files(spark, p) for k, p in s.paths.items()}, [prints[i] for i in s.inputs]]
        prints[s.name] = hashlib.sha1(json.dumps(about, sort_keys=True, default=str).encode()).hexdigest()[:16]
        folder = f"{root.rstrip('/')}/{s.name}-{prints[s.name]}"
        out.append((s, folder, _there(spark, f"{folder}/_SUCCESS")))
    return out


def run(spark: SparkSession, stages: list[Stage], root: str, dry_run: bool = False) -> tuple[dict[str, DataFrame], list[tuple[str, str]]]:
    """The frames of all stages, read from their folders, and what was done with each: kept or made (with dry_run,
    kept or due, and only the kept ones' frames)."""
    frames: dict[str, DataFrame] = {}
    report = []
    for s, folder, done in plan(spark, stages, root):
        if not done and not dry_run:
            given = {i: frames[i] for i in s.inputs} | {k: spark.read.parquet(p) for k, p in s.paths.items()}
            s.make(spark, given, **s.options).write.mode("overwrite").parquet(folder)
        report.append((s.name, "kept" if done else "due" if dry_run else "made"))
        if done or not dry_run:
            frames[s.name] = spark.read.parquet(folder)
    return frames, report
