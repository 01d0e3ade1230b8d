"""Sources: repository files, charted entry files, prompt manifests, package manifests."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.functions.text import skipped

MAX_BYTES = 1 << 20


def walk(spark: SparkSession, root: str, content: bool = True) -> DataFrame:
    """path (relative), length and content of the files under root that a walk keeps."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.split("://", 1)[-1].rstrip("/") + "/"
    rel = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), "^" + re.escape("/" + base.lstrip("/")), "")
    kept = files.select(rel.alias("path"), "length", *(["content"] if content else []))
    return kept.where(~skipped(F.col("path")))


def walk_bounded(spark: SparkSession, root: str, most: int) -> tuple[bool, DataFrame | None, int]:
    """(complete, files, scanned): all files, or none where there are more than `most`; never a part."""
    files = walk(spark, root, content=False)
    n = files.limit(most + 1).count()
    return (False, None, most) if n > most else (True, files, n)


def text_of(content: Column) -> Column:
    """struct(text, error): strict UTF-8, or INVALID_UTF8."""
    ok = F.is_valid_utf8(content.cast("string"))
    return F.struct(F.when(ok, content.cast("string")).alias("text"), F.when(~ok, "INVALID_UTF8").alias("error"))


def _file_line(line: str) -> tuple[str, str] | None:
    """`path: digest`; the path may be a JSON string, else the last colon with a space divides."""
    body = line.strip()
    if body.startswith('"'):
        end = re.match(r'"(?:[^"\\]|\\.)*"', body)
        if not end:
            return None
        try:
            name = json.loads(end[0])
        except ValueError:
            name = end[0][1:-1]
        return (name, re.sub(r"^:\s*", "", body[end.end() :]).strip()) if name else None
    at = body.rfind(": ")
    at = at if at >= 0 else body.find(":")
    name = body[:at].strip()
    return (name, body[at + 1 :].strip()) if at >= 0 and name else None


def parse_entry(raw: str, fallback: str) -> dict | None:
    """A charted entry: front matter (id, at, files) and a body whose first heading is the question."""
    text = raw.replace("\r\n", "\n")
    close = text.find("\n---\n", 4)
    if not text.startswith("---\n") or close < 0:
        return None
    entry = {"id": fallback, "at": None, "files": [], "hashes": {}}
    inside = False
    for line in text[4:close].split("\n"):
        if line.startswith(("id: ", "at: ")):
            entry[line[:2]] = line[4:].strip()
            inside = False
        elif line.startswith("files:"):
            inside = True
        elif inside and line.startswith("  "):
            got = _file_line(line)
            if got:
                entry["files"].append(got[0])
                entry["hashes"][got[0]] = got[1]
        elif line.strip():
            inside = False
    body = text[close + 5 :].strip()
    head, _, rest = body.partition("\n")
    entry["question"], entry["details"] = (head[2:].strip(), rest.strip()) if head.startswith("# ") else (body, "")
    return entry


ENTRY = "id string, at string, files array<string>, hashes map<string, string>, question string, details string"


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        got = [parse_entry(t, re.sub(r"^.*/|\.md$", "", p)) for p, t in zip(b["path"], b["value"])]
        yield pd.DataFrame([e for e in got if e], columns=["id", "at", "files", "hashes", "question", "details"])


def charted_entries(spark: SparkSession, folder: str) -> DataFrame:
    """All parsable entry files (*.md) of a store, in no order; sort by at (descending, nulls last) and id to read them."""
    raw = spark.read.text(folder, wholetext=True, pathGlobFilter="*.md").select(F.col("_metadata.file_path").alias("path"), "value")
    return raw.mapInPandas(_entries, ENTRY)


def store_config(spark: SparkSession, path: str) -> bool | None:
    """Whether a store embeds (its default); None where there is no config; raises on a corrupt one."""
    try:
        raw = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())  # one small file
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    try:
        got = json.loads(raw)
    except ValueError:
        raise ValueError("STORE_CONFIG_CORRUPT") from None
    return not (isinstance(got, dict) and got.get("embedding") is False)


EXPECTED = {
    "expected_routing": "string", "expected_status": "string", "expected_file": "string", "expected_range": "array<int>", "expected_anchor": "string", "expected_anchor_status": "string",
    "expected_callers": "array<string>", "expected_callees": "array<string>", "expected_symbol": "string", "expected_valid": "boolean",
}
PROMPT = {
    "id": "string", "category": "string", "name": "string", "query": "string", "tier": "string", "symbols": "array<string>", "path": "string", "direction": "string", "depth": "int",
    "exclude_tests": "boolean", "range": "array<int>", **EXPECTED, "rules_stressed": "array<string>", "regression_ref": "string", "tags": "array<string>",
    "steps": "array<struct<step: int, tool: string, args: map<string, string>, " + ", ".join(f"{k}: {v}" for k, v in EXPECTED.items()) + ">>",
}


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Prompt records of a JSON-lines manifest; blank lines and # comments go. Raises on unknown expectations and on
    empty step lists."""
    raw = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)"))
    keys = F.json_object_keys("value")
    known = F.array(*[F.lit(k) for k in EXPECTED])
    rec = F.from_json("value", ", ".join(f"`{k}` {v}" for k, v in PROMPT.items()))
    rows = raw.select(rec.alias("r"), F.array_except(F.filter(keys, lambda k: k.startswith("expected_")), known).alias("unknown"))
    bad = rows.where((F.size("unknown") > 0) | F.col("r.id").isNull() | (F.size("r.steps") == 0)).limit(1).collect()
    if bad:
        raise ValueError(f"INVALID_MANIFEST: {bad[0].r.id}: {bad[0].unknown}")
    return rows.select("r.*")


def package_entries(text: Column) -> Column:
    """The distinct paths that a package manifest's main, module, bin and exports name."""
    v = F.try_parse_json(text)
    paths = [F.try_variant_get(v, p, "string") for p in ("$.main", "$.module", "$.bin", "$.exports")]
    deep = [F.map_values(F.try_variant_get(v, p, "map<string, string>")) for p in ("$.bin", "$.exports")]
    every = F.concat(F.array(*paths), *[F.coalesce(d, F.array().cast("array<string>")) for d in deep])
    return F.array_distinct(F.filter(every, lambda x: x.isNotNull() & ~x.startswith("{")))
