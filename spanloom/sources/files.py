"""Source files, manifests, source sets, notes and sinks."""

from __future__ import annotations

import json
import os
import re
import tomllib
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.identity import matches_glob
from spanloom.schema import DEPS, NOTES, SHAPE_OF

LANGUAGES = {"py": "python", "rs": "rust", "ts": "ts", "tsx": "ts", "js": "ts", "java": "java", "go": "go", "cs": "cs", "sql": "sql", "c": "c", "h": "c"}
MANIFEST_KINDS = {"Cargo.toml": "cargo", "package.json": "npm", "pyproject.toml": "python", "pom.xml": "maven", "go.mod": "go"}
#: A small extractor's patterns, for the languages that it knows: kind, pattern with the name as its group.
_DEFS = {
    "python": [("class", r"^\s*class\s+(\w+)"), ("function", r"^\s*(?:async\s+)?def\s+(\w+)"), ("comment", r"^\s*#(.*)$")],
    "rust": [("struct", r"^\s*(?:pub\s+)?struct\s+(\w+)"), ("enum", r"^\s*(?:pub\s+)?enum\s+(\w+)"), ("function", r"^\s*(?:pub\s+)?fn\s+(\w+)"), ("comment", r"^\s*//(.*)$")],
    "java": [("class", r"^\s*(?:public\s+)?(?:final\s+)?class\s+(\w+)"), ("method", r"^\s+(?:public|private|protected)\s+[\w<>\[\]]+\s+(\w+)\s*\("), ("comment", r"^\s*//(.*)$")],
    "go": [("function", r"^func\s+(?:\([^)]*\)\s*)?(\w+)"), ("struct", r"^type\s+(\w+)\s+struct"), ("comment", r"^\s*//(.*)$")],
    "ts": [("class", r"^\s*(?:export\s+)?class\s+(\w+)"), ("function", r"^\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)"), ("comment", r"^\s*//(.*)$")],
    "sql": [("table", r"(?i)^\s*create\s+table\s+(\w+)"), ("view", r"(?i)^\s*create\s+view\s+(\w+)"), ("comment", r"^\s*--(.*)$")],
}


def walk(spark: SparkSession, root: str, exclude: list[str] = ()) -> DataFrame:
    """path, rel_path, language, modified, size, content of all files whose extension is known. Globs are filtered by
    path before any content is read on."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").load(root)
    base = "file:" + os.path.abspath(root).rstrip("/") + "/" if "://" not in root else root.rstrip("/") + "/"
    rel = F.regexp_replace(F.regexp_replace("path", "^file:/+", "file:/"), "^" + re.escape(re.sub("^file:/+", "file:/", base)), "")
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    rows = rows.withColumn("rel_path", rel).withColumn("language", F.element_at(known, F.element_at(F.split("path", r"\."), -1)))
    rows = rows.filter(F.col("language").isNotNull() & ~F.col("rel_path").rlike(r"(^|/)\.git/"))
    if exclude:
        rows = rows.filter(~matches_glob("rel_path", list(exclude)))
    return rows.select("path", "rel_path", "language", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), F.decode("content", "UTF-8").alias("text"))


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for path, language, text in zip(pdf["rel_path"], pdf["language"], pdf["text"]):
            stack: list[tuple[int, str]] = []
            for number, line in enumerate((text or "").split("\n"), 1):
                for kind, pattern in _DEFS.get(language, ()):
                    m = re.match(pattern, line)
                    if m:
                        indent = len(line) - len(line.lstrip())
                        while stack and stack[-1][0] >= indent:
                            stack.pop()
                        own = f"{kind}:{m[1].strip()}" if kind != "comment" else f"comment:{number}"
                        identity = "/".join(["lang:" + language, "path:`" + path.replace("`", "``") + "`", *[s for _, s in stack], own])
                        out.append((path, language, kind, m[1].strip(), identity, number, line.strip()))
                        if kind != "comment":
                            stack.append((indent, own))
                        break
        yield pd.DataFrame(out, columns=["rel_path", "language", "kind", "name", "identity", "start_line", "signature"])


def extract(files: DataFrame) -> DataFrame:
    """Definitions of source files by line patterns: a stand-in for real parsers, whose output has the same columns."""
    schema = "rel_path string, language string, kind string, name string, identity string, start_line int, signature string"
    shape = F.create_map(*[F.lit(x) for kv in SHAPE_OF.items() for x in kv])
    return files.select("rel_path", "language", "text").mapInPandas(_extract, schema).withColumn("shape", F.coalesce(F.element_at(shape, F.col("kind")), F.lit("ref")))


def extract_cached(files: DataFrame, cache: DataFrame | None) -> DataFrame:
    """As extract(), but files that a cache knows at the same path, time and size are taken from there."""
    keyed = files.withColumn("cache_key", F.concat_ws("|", "rel_path", "modified", "size"))
    if cache is None:
        return extract(keyed).join(keyed.select("rel_path", "cache_key"), "rel_path")
    missing = keyed.join(cache.select("cache_key").distinct(), "cache_key", "left_anti")
    hits = cache.join(keyed.select("cache_key"), "cache_key", "left_semi")
    return hits.unionByName(extract(missing).join(missing.select("rel_path", "cache_key"), "rel_path"))


def parse_manifest(name: str, text: str) -> list[dict]:
    """Dependency rows of one manifest."""
    kind = MANIFEST_KINDS[name]
    rows: list[dict] = []

    def add(package, dep, version, dep_kind, path=None):
        rows.append({"package_identity": package, "name": dep, "import_root": re.sub(r"[-.]", "_", dep) if kind in ("cargo", "python") else dep, "version": version, "dep_kind": dep_kind, "path": path})

    if kind in ("cargo", "python"):
        data = tomllib.loads(text)
        own = (data.get("package") or data.get("project") or {}).get("name", "")
        if own:
            add(own, own, (data.get("package") or data.get("project")).get("version"), "package")
        for section, what in (("dependencies", "normal"), ("dev-dependencies", "dev"), ("build-dependencies", "build")):
            for dep, spec in (data.get(section) or {}).items() if kind == "cargo" else ():
                add(own, dep, spec if isinstance(spec, str) else spec.get("version"), what, None if isinstance(spec, str) else spec.get("path"))
        for member in (data.get("workspace") or {}).get("members", []):
            add(own, member, None, "workspace_member", member)
        for dep in (data.get("project") or {}).get("dependencies", []):
            m = re.match(r"\s*([\w.-]+)\s*(.*)", dep)
            add(own, m[1], m[2] or None, "normal")
    elif kind == "npm":
        data = json.loads(text)
        add(data.get("name", ""), data.get("name", ""), data.get("version"), "package")
        for section, what in (("dependencies", "normal"), ("devDependencies", "dev"), ("peerDependencies", "peer")):
            for dep, version in (data.get(section) or {}).items():
                add(data.get("name", ""), dep, version, what)
    elif kind == "maven":
        top = ET.fromstring(re.sub(r'\sxmlns="[^"]+"', "", text, count=1))
        own = f"{top.findtext('groupId', '')}:{top.findtext('artifactId', '')}"
        add(own, own, top.findtext("version"), "package")
        for d in top.iter("dependency"):
            add(own, f"{d.findtext('groupId', '')}:{d.findtext('artifactId', '')}", d.findtext("version"), d.findtext("scope", "normal"))
    else:
        own = (re.search(r"^module\s+(\S+)", text, re.M) or [None, ""])[1]
        add(own, own, None, "package")
        for dep, version in re.findall(r"^\s*(?:require\s+)?([\w./-]+\.[\w./-]+)\s+(v[\w.+-]+)", text, re.M):
            add(own, dep, version, "normal")
    return rows


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """Dependencies of all manifests below a folder; workspace members take name and version of their own package row."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    found = found.withColumn("file", F.substring_index("path", "/", -1)).filter(F.col("file").isin(*MANIFEST_KINDS))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, name, content in zip(pdf["path"], pdf["file"], pdf["content"]):
                rows += [{"manifest_uri": path, "manifest_kind": MANIFEST_KINDS[name], **r} for r in parse_manifest(name, bytes(content).decode())]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in DEPS.split(", ")])

    deps = found.select("path", "file", "content").mapInPandas(read, DEPS)
    folder = F.regexp_replace("manifest_uri", "/[^/]*$", "")
    own = deps.filter("dep_kind = 'package'").select(folder.alias("_at"), F.col("name").alias("_name"), F.col("version").alias("_version"), F.col("package_identity").alias("_id"))
    member = F.col("dep_kind") == "workspace_member"
    joined = deps.join(own, member & (F.concat(folder, F.lit("/"), "path") == F.col("_at")), "left")
    pick = lambda c, o: F.when(member, F.coalesce(o, c)).otherwise(F.col(c)).alias(c)
    return joined.select("manifest_uri", "manifest_kind", pick("package_identity", "_id"), pick("name", "_name"), "import_root", pick("version", "_version"), "dep_kind", "path")


def source_groups(files: DataFrame, groups: dict[str, tuple[int, str]]) -> DataFrame:
    """source_group and srcset of files by their declared root folder, the deepest one first."""
    group, srcset = F.lit(None).cast("int"), F.lit("")
    for root, (g, s) in sorted(groups.items(), key=lambda x: len(x[0])):
        inside = (F.col("rel_path") == root) | F.col("rel_path").startswith(root.rstrip("/") + "/")
        group, srcset = F.when(inside, g).otherwise(group), F.when(inside, F.lit(s)).otherwise(srcset)
    return files.withColumn("source_group", group).withColumn("srcset", srcset)


def replace_source_set(sources: DataFrame, srcset: str, rows: DataFrame, most_bytes: int = 64 << 20) -> DataFrame:
    """sources(srcset, uri, language, text) with one set replaced; more text than the quota is an error and changes nothing."""
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if size > most_bytes:
        raise ValueError(f"source set {srcset!r} has {size} bytes; {most_bytes} are allowed")
    fresh = rows.select(F.lit(srcset).alias("srcset"), "uri", "language", "text")
    return sources.filter(F.col("srcset") != srcset).unionByName(fresh)


def remove_source_set(sources: DataFrame, srcset: str) -> DataFrame:
    return sources.filter(F.col("srcset") != srcset)


def notes(spark: SparkSession, rows: list[tuple] = ()) -> DataFrame:
    return spark.createDataFrame(list(rows), NOTES)


def list_notes(table: DataFrame, moniker: str | None = None, include_done: bool = False) -> DataFrame:
    out = table if include_done else table.filter("status <> 'done'")
    return out if moniker is None else out.filter(F.col("moniker") == moniker)


def anchor_notes(table: DataFrame, uris: DataFrame, symbols: DataFrame) -> DataFrame:
    """note_id and anchor: the view or file uri(uri, anchor) first, then a symbol's identity; else orphan."""
    by_uri = uris.select(F.col("uri").alias("moniker"), F.col("anchor").alias("_uri"))
    by_symbol = symbols.select(F.col("identity").alias("moniker"), F.col("symbol_id").cast("string").alias("_symbol"))
    joined = table.join(by_uri, "moniker", "left").join(by_symbol, "moniker", "left")
    return joined.select("note_id", F.coalesce("_uri", "_symbol", F.lit("orphan")).alias("anchor"))


def upsert_notes(table: DataFrame, changed: DataFrame) -> DataFrame:
    return table.join(changed.select("note_id"), "note_id", "left_anti").unionByName(changed)


def write_text(df: DataFrame, path: str, columns: list[str], kind: str = "tsv") -> None:
    """Only the columns asked for, as tsv, json or text of one row a line."""
    out = df.select(*columns)
    if kind == "json":
        out.write.json(path)
    elif kind == "tsv":
        out.write.option("sep", "\t").option("header", "true").csv(path)
    else:
        out.select(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns]).alias("value")).write.text(path)
