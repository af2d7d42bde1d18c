"""Sinks: CSV, TSV, project folders."""

from __future__ import annotations

import json
import re
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import ROW_ID, col, user_columns
from ..functions.types import type_name


def write_csv(df: DataFrame, path: str, include_row_id: bool = True) -> None:
    """A CSV folder with header; null is empty, empty text is two quotes."""
    names = [c for c in df.columns if include_row_id or c != ROW_ID]
    df.select(*map(col, names)).write.option("header", True).option("escape", '"').option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path)


def file_name(name: str) -> str:
    return re.sub(r'[/\\:*?"<>|]', "_", name)


def export_all_csv(tables: dict[str, DataFrame], root: str) -> list[str]:
    """Each dataset under its name, user columns only; those without columns are left out."""
    if not tables:
        raise ValueError("no datasets to export")
    done = []
    names = [file_name(n).lower() for n, df in tables.items() if user_columns(df)]
    if len(set(names)) < len(names):
        raise ValueError("two datasets would be written under one file name")
    for name, df in tables.items():
        if user_columns(df):
            write_csv(df, f"{root}/{file_name(name)}", include_row_id=False)
            done.append(file_name(name))
    return done


def tsv_lines(block: DataFrame) -> DataFrame:
    """One line per row, cells joined by tabs, null empty, nothing quoted."""
    cells = [F.coalesce(col(c).cast("string"), F.lit("")) for c in user_columns(block)]
    return block.select(F.concat_ws("\t", *cells).alias("value"))


def write_tsv(block: DataFrame, path: str) -> None:
    tsv_lines(block).write.text(path)


def save_project(spark: SparkSession, name: str, tables: dict[str, DataFrame], root: str, source_types: dict[str, str] | None = None, snapshots: dict[str, dict[str, DataFrame]] | None = None) -> None:
    """A folder of Parquet tables, those of named snapshots beside the datasets, and a manifest, which is written last."""

    def store(held: dict[str, DataFrame], folder: str) -> list[dict]:
        sets = []
        for i, (key, df) in enumerate(held.items()):
            df.write.parquet(f"{root}/{folder}/{i}")
            sets.append({"id": str(i), "folder": f"{folder}/{i}", "name": key, "sourceType": (source_types or {}).get(key, "manual"), "columns": [{"name": f.name, "colType": type_name(f.dataType)} for f in df.schema.fields if f.name != ROW_ID]})
        return sets

    now = datetime.now(UTC).isoformat()
    kept = [{"name": key, "datasets": store(held, f"snapshots/{i}")} for i, (key, held) in enumerate((snapshots or {}).items())]
    manifest = json.dumps({"name": name, "version": "1", "createdAt": now, "datasets": store(tables, "data"), "snapshots": kept})
    spark.range(1).select(F.lit(manifest).alias("value")).coalesce(1).write.text(f"{root}/manifest")


def _manifest(spark: SparkSession, root: str) -> dict:
    return json.loads(spark.read.text(f"{root}/manifest", wholetext=True).first()[0])


def open_project(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return {d["name"]: spark.read.parquet(f"{root}/{d['folder']}") for d in _manifest(spark, root)["datasets"]}


def open_snapshots(spark: SparkSession, root: str) -> dict[str, dict[str, DataFrame]]:
    """The tables of each snapshot stored in a project."""
    return {x["name"]: {d["name"]: spark.read.parquet(f"{root}/{d['folder']}") for d in x["datasets"]} for x in _manifest(spark, root)["snapshots"]}
