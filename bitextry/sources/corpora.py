"""Corpus readers built on the ordered text scan: manifests, parallel text, JSONL, step predictions."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from urllib.parse import unquote

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitextry.sources.text import read_lines, scan_groups

SPLITS = ("train", "dev")
SIDES = ("src", "trg")
# How prediction files of one evaluation step are named.
STEP_PATTERN = re.compile(r"dev\.step_(\d+)\.pred(?:/|$)")

Manifest = Mapping[str, Mapping[str, Sequence[str]]]


def load_manifest(path: str) -> Manifest:
    """The YAML manifest ``train|dev -> src|trg -> list of paths``."""
    with open(path, encoding="utf-8") as f:
        return check_manifest(yaml.safe_load(f))


def check_manifest(manifest: Manifest) -> Manifest:
    """Every split has both sides, as lists, and the sides are not the same files."""
    for split in SPLITS:
        sides = {side: manifest[split][side] for side in SIDES}
        for side, paths in sides.items():
            if isinstance(paths, str) or not paths:
                raise ValueError(f"{split}.{side} must be a list of paths")
        if list(sides["src"]) == list(sides["trg"]):
            raise ValueError(f"{split}: src and trg name the same files")
    return manifest


def manifest_rows(spark: SparkSession, manifest: Manifest) -> DataFrame:
    """``split, side, file_ord, path``, one row per listed file."""
    rows = [
        (split, side, i, path)
        for split in SPLITS
        for side in SIDES
        for i, path in enumerate(check_manifest(manifest)[split][side])
    ]
    return spark.createDataFrame(rows, "split string, side string, file_ord int, path string")


def read_parallel(spark: SparkSession, manifest: Manifest) -> DataFrame:
    """``split, line_no, src, trg``. One scan numbers all files, and one shuffle brings the sides of a line together.

    A line that a side lacks, or has twice, is an error.
    """
    check_manifest(manifest)
    groups = {f"{split}.{side}": manifest[split][side] for split in SPLITS for side in SIDES}
    lines = scan_groups(spark, groups).select(
        F.substring_index("group", ".", 1).alias("split"),
        F.substring_index("group", ".", -1).alias("side"),
        "line_no",
        "text",
    )
    here = {side: F.col("side") == side for side in SIDES}
    paired = lines.groupBy("split", "line_no").agg(
        *(F.max(F.when(here[side], F.col("text"))).alias(side) for side in SIDES),
        *(F.count(F.when(here[side], 1)).alias(f"_{side}") for side in SIDES),
    )
    place = F.concat_ws("/", "split", "line_no")
    wrong = F.raise_error(F.concat(F.lit("sides differ in length: no partner for row "), place)).cast("boolean")
    both = (F.col("_src") == 1) & (F.col("_trg") == 1)
    return paired.filter(F.when(both, F.lit(True)).otherwise(wrong)).select("split", "line_no", *SIDES)


def read_jsonl(spark: SparkSession, path: str, schema: str = "text string, summary string") -> DataFrame:
    """JSONL with a declared schema; a malformed line is an error, because dropping it would break alignment."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_numbered_jsonl(spark: SparkSession, paths: str | Sequence[str], schema: str = "text string, summary string") -> DataFrame:
    """JSONL records with their ``line_no``; a malformed line is an error."""
    lines = read_lines(spark, paths, "_record")
    parsed = lines.select("line_no", F.from_json("_record", schema, {"mode": "FAILFAST"}).alias("_r"))
    return parsed.select("line_no", "_r.*")


def read_step_predictions(spark: SparkSession, paths: Mapping[int, str | Sequence[str]]) -> DataFrame:
    """``step, line_no, hyp`` from the prediction files of each step."""
    groups = {str(step): [p] if isinstance(p, str) else list(p) for step, p in paths.items()}
    return scan_groups(spark, groups, "hyp").select(F.col("group").cast("int").alias("step"), "line_no", "hyp")


def find_step_predictions(spark: SparkSession, folder: str) -> dict[int, list[str]]:
    """The ``dev.step_{N}.pred`` files (or folders of part files) below ``folder``, by step."""
    steps: dict[int, list[str]] = {}
    for uri in sorted(spark.read.option("recursiveFileLookup", "true").text(folder).inputFiles()):
        found = STEP_PATTERN.search(uri)
        if found:
            steps.setdefault(int(found[1]), []).append(unquote(uri))
    return steps
