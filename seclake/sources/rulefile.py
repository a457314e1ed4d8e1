"""Rule files (JSON or YAML)."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from ..operators.rules import Rule, builtin_rules, merge_rules


def _records(data: dict) -> list[dict]:
    if "rules" in data:
        return data["rules"]
    return [data] if "id" in data else []


def load_rules(spark: SparkSession, path: str, base: list[Rule] | None = None) -> list[Rule]:
    """The built-in (or ``base``) rules followed by the new ones of a file.

    Read through Spark, so that any file system it knows will do.  A rule file is
    configuration of a few kilobytes.
    """
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix not in ("json", "yaml", "yml"):
        raise ValueError(f"unsupported rule file format: {path}")
    text = spark.read.text(path, wholetext=True).first()[0]
    if suffix == "json":
        data = json.loads(text)
    else:
        try:
            import yaml
        except ImportError as missing:
            raise RuntimeError("reading YAML rule files needs PyYAML") from missing
        data = yaml.safe_load(text)
    return merge_rules(builtin_rules() if base is None else base, _records(data))
