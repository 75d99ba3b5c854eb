"""Artifacts and settings: scans of JSON artifacts, lists and fixtures in YAML, the settings of a book in TOML, provenance lines."""

from __future__ import annotations

import hashlib
import json
import os
import tomllib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The mark of an unsigned fixture, the ending of provenance files, the default of the heading pattern's tables.
UNSIGNED = "PENDING_AUTHOR"
SIDECAR = ".provenance.json"
PLUGIN = "legal-citations"
CANDIDATES = "pass_type string, candidates array<struct<canonical_form:string, kind:string, surface_forms:array<string>>>"


def artifacts(spark: SparkSession, folder: str) -> DataFrame:
    """(file, sha256, place, pass_type, canonical_form, kind, surface_forms): candidates of every *.json but provenance files.

    Files are read by the executors, one row a file; place counts the candidates of a file, so
    (file, place) orders them all. A file that is not JSON, or has no pass_type, is an error.
    """
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    files = raw.select(name.alias("file"), F.sha2("content", 256).alias("sha256"), F.decode("content", "UTF-8").alias("text")).where(~F.col("file").endswith(SIDECAR))
    parsed = files.withColumn("j", F.from_json("text", CANDIDATES, {"mode": "FAILFAST"}))
    wrong = F.raise_error(F.concat(F.lit("no pass_type in "), "file")).cast("string")
    rows = parsed.select("file", "sha256", F.coalesce("j.pass_type", wrong).alias("pass_type"), F.posexplode_outer("j.candidates").alias("place", "c"))
    return rows.select("file", "sha256", "place", "pass_type", "c.canonical_form", "c.kind", "c.surface_forms")


def load_yaml(path: str) -> object:
    """A fixture or list; files ending in .json need no YAML reader. An empty file is an empty mapping."""
    with open(path, encoding="utf-8") as f:
        if path.endswith(".json"):
            return json.load(f)
        try:
            import yaml
        except ModuleNotFoundError as e:
            raise RuntimeError(f"{path}: no YAML reader is installed, write the file as JSON") from e
        return yaml.safe_load(f) or {}


def signed(fixture: dict) -> dict:
    """The fixture, if its metadata name an author and the version it was made for; else an error."""
    meta = fixture.get("metadata") or {}
    author = str(meta.get("curated_by") or "").strip()
    if author in ("", UNSIGNED):
        raise ValueError("the fixture is unsigned: set metadata.curated_by")
    if not meta.get("source_index_version"):
        raise ValueError("the fixture does not say for which index it was made: set metadata.source_index_version")
    version = meta.get("schema_version")
    if not isinstance(version, int) or version < 1:
        raise ValueError("metadata.schema_version is a whole number from 1")
    return fixture


def pairs(spark: SparkSession, path: str, names: str = "key string, value string") -> DataFrame:
    """A mapping (overrides, acronyms, jurisdictions, rule systems) as rows by key; nested values as JSON. Curated by hand, so small."""
    found = load_yaml(path)
    if not isinstance(found, dict):
        raise ValueError(f"{path} is no mapping")
    spell = lambda v: v if v is None or isinstance(v, str) else json.dumps(v, sort_keys=True, ensure_ascii=False)
    return spark.createDataFrame([(str(k), spell(v)) for k, v in sorted(found.items(), key=lambda kv: str(kv[0]))], names)


def words(spark: SparkSession, path: str) -> DataFrame:
    """A list (stopwords, phrases) as distinct rows (term) in order."""
    found = load_yaml(path)
    if not isinstance(found, list):
        raise ValueError(f"{path} is no list")
    return spark.createDataFrame([(t,) for t in sorted({str(x) for x in found})], "term string")


@dataclass(frozen=True)
class Book:
    title: str = "Untitled"
    source: str | None = None
    section_fixture: str | None = None
    heading_regex: str | None = None
    folio_fixture: str | None = None
    lemma_overrides: str | None = None
    tables_plugin: str = PLUGIN
    tables_jurisdictions: str | None = None
    raw: dict = field(default_factory=dict)


def book(path: str = "book.toml") -> Book:
    """Settings of a book; paths are relative to the file. A missing file gives the defaults."""
    if not os.path.isfile(path):
        return Book()
    with open(path, "rb") as f:
        data = tomllib.load(f)
    part = lambda name: data.get(name, {})
    base = os.path.dirname(os.path.abspath(path))
    at = lambda p: os.path.join(base, p) if p else None
    return Book(
        part("book").get("title", "Untitled"),
        at(part("book").get("source_pdf")),
        at(part("sections").get("fixture")),
        part("sections").get("heading_regex") or None,
        at(part("folios").get("fixture")),
        at(part("lemma").get("overrides")),
        part("tables").get("plugin", PLUGIN),
        at(part("tables").get("jurisdictions")),
        data,
    )


def file_hash(path: str | None) -> str:
    """SHA-256 of a file, read by blocks; empty without a file."""
    if path is None or not os.path.isfile(path):
        return ""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def provenance(corpus: dict, packages: list[str]) -> dict[str, str]:
    """The fields of a rendered index: those of the corpus metadata and the versions of packages; a package that is not installed is an error."""
    from importlib import metadata

    fields = {k: str(v) for k, v in corpus.items() if not isinstance(v, dict)}
    fields |= {f"{name}_sha256": h for name, h in (corpus.get("hashes") or {}).items()}
    return fields | {f"{p}_version": metadata.version(p) for p in packages}


def metadata_block(fields: dict[str, str]) -> str:
    """The fields as a comment, sorted by key, without the fixed time."""
    return "\n".join(["<!--", "index metadata", *(f"{k}={fields[k]}" for k in sorted(fields) if k != "built_at"), "-->"])
