"""The stored corpus, its audits and its settings."""

import hashlib
import json
import os
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from foliant.plans import ingest
from foliant.sources import configs, corpus, sinks, store

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("store"))
    ingest.run(spark, SF, out)
    return out


def test_store_opens_and_repeats(spark, built, tmp_path):
    found = store.read(spark, built)
    meta = found["metadata"].first()
    assert (meta["n_pages"], meta["n_tokens"]) == (found["pages"].count(), found["tokens"].count())
    assert meta["built_at"] == store.FROZEN and meta["footnote_threshold"] == meta["body_size"] - 1
    for name, key in (("tokens", "token_id"), ("sections", "section_id")):
        n, low, high, each = found[name].agg(F.count("*"), F.min(key), F.max(key), F.countDistinct(key)).first()
        assert (low, high, each) == (1, n, n)
    rows = found["tokens"].orderBy("token_id").select("pdf_page", "token_index").collect()
    assert rows == sorted(rows)
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        ingest.run(spark, SF, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert store.read(spark, str(tmp_path))["metadata"].first() == meta


def test_unfinished_or_altered_store_does_not_open(spark, built, tmp_path):
    spark.createDataFrame([], store.METADATA).write.parquet(f"{tmp_path}/metadata")
    with pytest.raises(ValueError, match="no finished corpus"):
        store.read(spark, str(tmp_path))
    for name in store.SCHEMAS:
        os.symlink(f"{built}/{name}", f"{tmp_path}/{name}")
    os.remove(f"{tmp_path}/pages")
    spark.read.parquet(f"{built}/pages").withColumnRenamed("folio", "leaf").write.parquet(f"{tmp_path}/pages")
    spark.read.parquet(f"{built}/metadata").write.mode("overwrite").parquet(f"{tmp_path}/metadata")
    with pytest.raises(ValueError, match="has columns"):
        store.read(spark, str(tmp_path))


def test_ids_and_parents_across_runs(spark):
    rng = random.Random(1)
    pages = rng.sample(range(5 * corpus.RUN_PAGES), 300)
    rows = [(1, 0, "1", -1)] + [(1, 1, f"1.{n:02d}", p) for n, p in enumerate(sorted(pages[:40]))] + [(1, 2, f"x.{p}", p) for p in pages[40:]]
    rows = [(c, v, r, p + 1) for c, v, r, p in rows]
    got = store.active_parents(spark.createDataFrame(rows, "chapter int, level int, section_ref string, start_page bigint"))
    want, open_section = {}, None
    for _, level, ref, _ in sorted(rows, key=lambda r: (r[3], r[1], r[2])):
        open_section = f"ch1:{ref}" if level == 1 else open_section
        want[f"ch1:{ref}"] = {0: None, 1: "ch1:1", 2: open_section}[level]
    assert {r["global_id"]: r["parent_global_id"] for r in got.collect()} == want
    ids = store.section_ids(got.where("level < 2 OR parent_global_id IS NOT NULL")).orderBy("section_id").collect()
    assert [r["section_id"] for r in ids] == list(range(1, len(ids) + 1))
    assert [(r["start_page"], r["level"]) for r in ids] == sorted((r["start_page"], r["level"]) for r in ids)


def test_a_lost_parent_is_an_error(spark):
    rows = spark.createDataFrame([(1, 3, "1.02.1.1", 5)], "chapter int, level int, section_ref string, start_page bigint")
    with pytest.raises(PySparkException, match="is not among the sections"):
        store.section_ids(store.active_parents(rows)).collect()


def test_audit_bundle(spark, tmp_path):
    ingest.audit_bundle(spark, SF, str(tmp_path))
    starts = [json.loads(r[0]) for r in spark.read.text(f"{tmp_path}/sections.jsonl").collect()]
    assert {s["section_ref"] for s in starts} == {r[0] for r in corpus.section_starts(corpus.pages(spark, SF)).select("section_ref").collect()}
    assert spark.read.csv(f"{tmp_path}/ledger_bounds.csv", header=True).columns == ["section_ref", "start_page", "n"]
    heads = spark.read.text(f"{tmp_path}/pages.txt").where("value LIKE '=== page %'").count()
    assert heads == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_artifacts(spark, tmp_path):
    one = {"pass_type": "noun_phrase", "candidates": [{"canonical_form": "hearsay", "kind": "topic", "surface_forms": ["Hearsay"]}, {"canonical_form": "oath"}]}
    (tmp_path / "b.json").write_text(json.dumps(one))
    (tmp_path / "a.json").write_text(json.dumps({"pass_type": "ner", "candidates": []}))
    (tmp_path / "a.provenance.json").write_text("{}")
    (tmp_path / "notes.txt").write_text("x")
    rows = configs.artifacts(spark, str(tmp_path)).orderBy("file", "place").collect()
    assert [(r["file"], r["place"], r["pass_type"], r["canonical_form"]) for r in rows] == [("a.json", None, "ner", None), ("b.json", 0, "noun_phrase", "hearsay"), ("b.json", 1, "noun_phrase", "oath")]
    assert rows[1]["sha256"] == hashlib.sha256((tmp_path / "b.json").read_bytes()).hexdigest() == configs.file_hash(str(tmp_path / "b.json"))
    (tmp_path / "c.json").write_text("{}")
    with pytest.raises(PySparkException, match="no pass_type in c.json"):
        configs.artifacts(spark, str(tmp_path)).collect()
    (tmp_path / "c.json").write_text("no json")
    with pytest.raises(Exception, match="Malformed records"):
        configs.artifacts(spark, str(tmp_path)).collect()


def test_settings(spark, tmp_path):
    assert configs.book(str(tmp_path / "none.toml")) == configs.Book()
    (tmp_path / "book.toml").write_text('[book]\ntitle = "T"\n[lemma]\noverrides = "o.json"\n')
    got = configs.book(str(tmp_path / "book.toml"))
    assert (got.title, got.lemma_overrides, got.tables_plugin, got.folio_fixture) == ("T", str(tmp_path / "o.json"), configs.PLUGIN, None)
    (tmp_path / "o.json").write_text(json.dumps({"b": "x", "a": ["y", 1]}))
    assert [tuple(r) for r in configs.pairs(spark, got.lemma_overrides).collect()] == [("a", '["y", 1]'), ("b", "x")]
    (tmp_path / "s.json").write_text('["the", "a", "the"]')
    assert [r[0] for r in configs.words(spark, str(tmp_path / "s.json")).collect()] == ["a", "the"]
    with pytest.raises(ValueError, match="no mapping"):
        configs.pairs(spark, str(tmp_path / "s.json"))


def test_unsigned_fixtures_are_refused():
    good = {"metadata": {"curated_by": "a@b", "source_index_version": "1", "schema_version": 1}}
    assert configs.signed(good) is good
    for wrong in ({}, {"metadata": {**good["metadata"], "curated_by": " PENDING_AUTHOR "}}, {"metadata": {**good["metadata"], "source_index_version": ""}}, {"metadata": {**good["metadata"], "schema_version": 0}}):
        with pytest.raises(ValueError):
            configs.signed(wrong)


def test_metadata_block(spark, built):
    fields = configs.provenance(store.read(spark, built)["metadata"].first().asDict(), ["pyspark"])
    lines = configs.metadata_block(fields).split("\n")
    assert lines[:2] == ["<!--", "index metadata"] and lines[-1] == "-->"
    assert [x.split("=")[0] for x in lines[2:-1]] == sorted(fields.keys() - {"built_at"})
    assert "pyspark_version=4.1.2" in lines and not any(x.startswith("built_at=") for x in lines)
    assert any(x.startswith("tokens_sha256=") for x in lines)
