"""Tables of one capture kept as Parquet, valid for the same bytes and the same version only."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession

VERSION = "1"


def identity(path: str) -> dict[str, str | int]:
    """SHA-256, size and store version of a file, read in blocks."""
    digest, size = hashlib.sha256(), 0
    with open(path, "rb") as file:
        while block := file.read(1 << 20):
            digest.update(block)
            size += len(block)
    return {"sha256": digest.hexdigest(), "size": size, "version": VERSION}


def save(tables: dict[str, DataFrame], folder: str, who: dict) -> None:
    """Write the tables beside folder, the manifest last, then move them into place at once."""
    fresh = f"{folder}.{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(os.path.join(fresh, name))
    os.makedirs(fresh, exist_ok=True)
    with open(os.path.join(fresh, "manifest.json"), "w") as file:
        json.dump({**who, "tables": sorted(tables)}, file)
    shutil.rmtree(folder, ignore_errors=True)
    os.replace(fresh, folder)


def load(spark: SparkSession, folder: str, who: dict) -> dict[str, DataFrame] | None:
    """The tables, or None where nothing is kept or what is kept belongs to other bytes or another version."""
    try:
        with open(os.path.join(folder, "manifest.json")) as file:
            held = json.load(file)
    except (OSError, ValueError):
        return None
    if any(held.get(k) != v for k, v in who.items()):
        return None
    return {name: spark.read.parquet(os.path.join(folder, name)) for name in held["tables"]}


def clear(folder: str) -> bool:
    """Drop what is kept; whether there was anything."""
    there = os.path.isdir(folder)
    shutil.rmtree(folder, ignore_errors=True)
    return there
