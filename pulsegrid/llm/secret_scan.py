"""Secret scanning over an incremental ledger of content-addressed blobs.

Every version of every path is a blob, named by the SHA-256 of its content.  The ledger holds, for each blob and
rule version that was scanned, the spans found (none is an empty list).  A run scans only the pairs the ledger
lacks, each distinct blob once, appends them, and joins the spans back to all paths and versions that hold the blob.

Defined cases: null content counts as empty; repeated rows give a row each; an empty table gives an empty result;
other columns of the input are ignored, whatever their names; contents are scanned whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.blobs import content_digest, open_ledger, unseen
from pulsegrid.llm.common import materialise, prepare, text_of

#: Base rules, in the order in which they are listed: kind, pattern, the group that is measured, its least length.
BASE_RULES = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)
#: Further rules of the method.
MORE_RULES = (
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("json_web_token", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    ("host_token", r"gh[oprsu]_[A-Za-z0-9]+", 0, 40),
    ("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
)
RULES = BASE_RULES + MORE_RULES
LEDGER_SCHEMA = "blob_id string, rule_version string, spans array<struct<start:int,nth:int,kind:string,stop:int>>"
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("nth", pa.int32()), ("kind", pa.string()), ("stop", pa.int32())]))


def rule_version(rules=RULES) -> str:
    """Digest of the rules: a changed rule is a new version, and blobs are scanned anew under it."""
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def find_spans(text: str, compiled: list[tuple]) -> list[dict]:
    """Leftmost non-overlapping matches of each rule, then without those whose measured group is too short."""
    out = []
    for nth, (kind, pattern, needs, group, least) in enumerate(compiled):
        if needs and not any(x in text for x in needs):
            continue
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                out.append({"start": m.start(), "nth": nth, "kind": kind, "stop": m.end()})
    return sorted(out, key=lambda s: (s["start"], s["nth"]))


def compile_rules(rules) -> list[tuple]:
    """Patterns with ASCII case folding, and characters of which a match must hold one (a cheap test before)."""
    needs = {"assign": ("=", ":"), "access": ("AKIA",), "private_key": ("PRIVATE",), "json_web_token": ("eyJ",), "host_token": ("gh",), "chat_token": ("xox",)}
    # a run of single-class characters is found whole either way, so its least length can go into the pattern
    return [
        (kind, re.compile(f"{p[:-1]}{{{least},}}" if kind == "hex" else p, re.ASCII), needs.get(kind, ()), group, least)
        for kind, p, group, least in rules
    ]


def scan_versions(versions: DataFrame, ledger_path: str, keys: list[str], content_column: str, rules=RULES) -> DataFrame:
    """``keys`` of every row of ``versions`` with ``blob_id``, ``rule_version`` and ``spans`` (by start, then rule)."""
    spark = versions.sparkSession
    prepare(spark)
    version = rule_version(rules)
    content = text_of(content_column)
    keyed = versions.select(content_digest(content).alias("blob_id"), content.alias("content"))
    schema = spark.createDataFrame([], LEDGER_SCHEMA).schema

    def scanned() -> DataFrame:
        return open_ledger(spark, ledger_path, schema).filter(F.col("rule_version") == version)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = compile_rules(rules)
        for b in batches:
            found = pa.array([find_spans(t, compiled) for t in b.column("content").to_pylist()], SPANS)
            yield pa.RecordBatch.from_arrays([b.column("blob_id"), pa.array([version] * b.num_rows, pa.string()), found], names=schema.names)

    unseen(keyed, "blob_id", "content", scanned()).mapInArrow(scan, schema).write.mode("append").parquet(ledger_path)
    # written, so that the join's exchanges can be split where a blob has very many paths
    findings = materialise(scanned().dropDuplicates(["blob_id"]).filter(F.size("spans") > 0), "findings")
    light = versions.select(*keys, content_digest(content).alias("blob_id"))
    none = F.from_json(F.lit("[]"), schema["spans"].dataType)
    return light.join(findings.select("blob_id", "spans"), "blob_id", "left").select(
        *keys, "blob_id", F.lit(version).alias("rule_version"), F.coalesce("spans", none).alias("spans")
    )
