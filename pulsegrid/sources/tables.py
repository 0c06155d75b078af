"""Tables of a run: declared layers, Parquet in and out, manifest and reports."""

from __future__ import annotations

import csv
import io
import json
import os
from importlib import metadata

import pyarrow.fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions.timecols import date_of_ns

#: Table, layer, partition columns and sort order of what a run writes.
TABLES = {
    "participants": ("truth", [], ["person_id"]),
    "daily_context": ("truth", [], ["person_id", "day_index"]),
    "events": ("truth", [], ["person_id", "start_time_ns", "event_id"]),
    "latent_timeline": ("truth", ["person_id", "date_utc"], ["truth_time_ns"]),
    "artifacts": ("truth", [], ["person_id", "start_time_ns", "artifact_id"]),
    "clock_models": ("truth", [], ["person_id", "device_id"]),
    "native": ("observed", ["person_id", "device_id", "stream_name", "clip_id"], ["second_ns"]),
    "timeline_1hz": ("model_ready", ["person_id", "date_utc"], ["canonical_time_ns"]),
    "labels": ("model_ready", ["person_id", "date_utc"], ["canonical_time_ns"]),
    "splits": ("model_ready", [], ["person_id"]),
    "evaluations": ("model_ready", [], ["person_id", "day_index"]),
    "clip_manifest": ("clips", [], ["clip_id"]),
    "oracle_features": ("oracle_features", ["person_id", "date_utc"], ["canonical_time_ns"]),
    "event_onset_orders": ("oracle_features", [], ["person_id", "event_id"]),
}
#: What holds for tables that are not listed: those of features.
FEATURES = ("model_ready", ["person_id", "date_utc"], ["canonical_time_ns"])
#: Names that may not reach model inputs.
FORBIDDEN = ("truth_", "event_intensity_truth")
SAFETY = {"synthetic": True, "non_diagnostic": True, "not_for_clinical_use": True}


#: Most bytes of a side that is broadcast, as JSON.
BROADCAST_BYTES = 64 << 20


def broadcast_if_small(df: DataFrame, max_rows: int, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Mark for broadcast only a side small in rows and bytes; beyond that Spark's shuffled join is used."""
    size = F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))
    seen = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(size, F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if seen["n"] <= max_rows and seen["bytes"] <= max_bytes else df


def table_path(root: str, name: str) -> str:
    layer = TABLES.get(name, FEATURES)[0]
    return f"{root.rstrip('/')}/{layer}/{name}"


def require_no_truth(df: DataFrame) -> DataFrame:
    """Refuse hidden causes among model inputs."""
    bad = [c for c in df.columns if any(c.startswith(f) or c.endswith("_truth") for f in FORBIDDEN)]
    if bad:
        raise ValueError(f"hidden columns among model inputs: {bad}")
    return df


def write_table(df: DataFrame, root: str, name: str, columns: list[str] | None = None) -> str:
    """Write in declared order, zstd, one group of files for each person and day, only its partitions replaced."""
    layer, parts, order = TABLES.get(name, FEATURES)
    if "date_utc" in parts and "date_utc" not in df.columns:
        df = df.withColumn("date_utc", date_of_ns(F.col(order[0])))
    if layer == "model_ready" and name != "labels":
        require_no_truth(df)
    out = df.select(*columns) if columns else df
    if parts:
        out = out.repartition(*parts).sortWithinPartitions(*parts, *order)
    else:
        out = out.sort(*order)
    writer = out.write.mode("overwrite").option("compression", "zstd").option("partitionOverwriteMode", "dynamic")
    path = table_path(root, name)
    (writer.partitionBy(*parts) if parts else writer).parquet(path)
    return path


def read_table(spark: SparkSession, root: str, name: str, schema=None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(table_path(root, name))


def exists(spark: SparkSession, root: str, name: str) -> bool:
    """Whether a table is there; asked of Spark's own reader, so any store will do."""
    try:
        read_table(spark, root, name)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return False
    return True


def partition_hashes(df: DataFrame, parts: list[str], columns: list[str] | None = None) -> DataFrame:
    """(parts, rows, hash): for each partition the sum of its rows' SHA-256, cut to 128 bits, modulo 2^128, in hex.

    A sum, unlike an exclusive or, counts repeated rows: it depends on the multiset of rows alone, and neither on their
    order nor on tasks.  Four sums of 32-bit words meet within map tasks first, so a hot partition sends a row a task.
    """
    names = sorted(columns or df.columns)
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in names]), {"ignoreNullFields": "false"})
    hexed = df.select(*parts, F.sha2(row, 256).alias("_h"))
    words = [F.conv(F.substring("_h", 1 + 8 * k, 8), 16, 10).cast("long").alias(f"_w{k}") for k in range(4)]
    sums = hexed.select(*parts, *words).groupBy(*parts).agg(F.count(F.lit(1)).alias("rows"), *[F.sum(F.col(f"_w{k}").cast("decimal(20,0)")).alias(f"_w{k}") for k in range(4)])
    # from the lowest word up: 32 bits stay, the rest is carried
    low, out, carry = F.lit(1 << 32).cast("decimal(12,0)"), [], F.lit(0).cast("decimal(30,0)")
    for k in reversed(range(4)):
        whole = F.coalesce(F.col(f"_w{k}"), F.lit(0)).cast("decimal(30,0)") + carry
        out.insert(0, F.lpad(F.lower(F.hex(F.pmod(whole, low).cast("long"))), 8, "0"))
        carry = ((whole - F.pmod(whole, low)) / low).cast("decimal(30,0)")
    return sums.select(*parts, "rows", F.concat(*out).alias("hash"))


def content_hash(df: DataFrame, columns: list[str] | None = None) -> dict[str, int | str]:
    """Count and hash of a table's rows, as ``partition_hashes`` has them for the whole table."""
    r = partition_hashes(df, [], columns).first()
    return {"rows": r["rows"], "hash": r["hash"]}


def differing_hashes(one: DataFrame, two: DataFrame, parts: list[str]) -> DataFrame:
    """(parts, rows_a, rows_b): where two results of ``partition_hashes`` differ; 0 rows where one lacks the partition."""
    same = F.lit(True)
    for p in parts:
        same &= F.col(f"a.{p}").eqNullSafe(F.col(f"b.{p}"))
    both = one.alias("a").join(two.alias("b"), same, "full_outer")
    count = lambda side: F.coalesce(F.col(f"{side}.rows"), F.lit(0).cast("long"))
    apart = ~F.col("a.hash").eqNullSafe(F.col("b.hash")) | (count("a") != count("b"))
    return both.filter(apart).select(*[F.coalesce(F.col(f"a.{p}"), F.col(f"b.{p}")).alias(p) for p in parts], count("a").alias("rows_a"), count("b").alias("rows_b"))


def differing_partitions(a: DataFrame, b: DataFrame, parts: list[str]) -> DataFrame:
    """(parts, rows_a, rows_b): partitions whose multisets of rows differ between two tables."""
    return differing_hashes(partition_hashes(a, parts, a.columns), partition_hashes(b, parts, a.columns), parts)


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def write_text(path: str, text: str) -> None:
    """A small file in any store that Arrow opens."""
    where, name = _store(path)
    where.create_dir(os.path.dirname(name), recursive=True)
    with where.open_output_stream(name, compression=None) as out:
        out.write(text.encode())


def read_text(path: str) -> str:
    where, name = _store(path)
    with where.open_input_stream(name, compression=None) as source:
        return source.read().decode()


def write_json(path: str, value: dict) -> None:
    write_text(path, json.dumps(value, sort_keys=True, indent=1))


def manifest(config_json: str, run: str, seed: int, tables: dict[str, dict]) -> dict:
    return {"run_id": run, "schema_version": "1.0", "root_seed": seed, "config": json.loads(config_json), "tables": tables, **SAFETY}


def html_report(findings: list[dict]) -> str:
    rows = "".join(f"<tr><td>{f['check']}</td><td>{f['violations']}</td><td>{'PASS' if f['passed'] else 'FAIL'}</td></tr>" for f in findings)
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>Validation</title></head><body><p>Synthetic, non-diagnostic, not for clinical use.</p><table><tr><th>check</th><th>violations</th><th>result</th></tr>{rows}</table></body></html>"


def dependency_rows() -> list[dict[str, str]]:
    """Name, version and licence of what is installed, for the provenance folder."""
    out = []
    for d in metadata.distributions():
        m = d.metadata
        out.append({"name": m["Name"] or "", "version": d.version or "", "licence": (m.get("License-Expression") or m.get("License") or "").splitlines()[0] if (m.get("License-Expression") or m.get("License")) else ""})
    return sorted({r["name"]: r for r in out}.values(), key=lambda r: r["name"].lower())


def licence_csv(rows: list[dict[str, str]]) -> str:
    out = io.StringIO()
    w = csv.DictWriter(out, ["name", "version", "licence"])
    w.writeheader()
    w.writerows(rows)
    return out.getvalue()


def bill_of_materials(rows: list[dict[str, str]]) -> dict:
    """The installed packages as a CycloneDX document."""
    parts = [{"type": "library", "name": r["name"], "version": r["version"], "purl": f"pkg:pypi/{r['name'].lower()}@{r['version']}", "licenses": [{"license": {"name": r["licence"]}}] if r["licence"] else []} for r in rows]
    return {"bomFormat": "CycloneDX", "specVersion": "1.5", "version": 1, "components": parts}
