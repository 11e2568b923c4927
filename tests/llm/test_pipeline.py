"""The corpus pipeline: each stage on what the stage before kept, and the whole run."""

import random
from collections import defaultdict

from pyspark.sql.types import StringType, StructField, StructType

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept, before = docs, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = spark.createDataFrame(stage(spark, kept, SF).collect(), docs.schema)
        assert kept.columns == docs.columns, name
        assert 0 < kept.count() <= before, name
        before = kept.count()
    assert before > 0.5 * docs.count()


def test_run_packs_what_is_left(spark):
    by = defaultdict(list)
    for r in corpus_pipeline.run(spark, SF).collect():
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in by.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    assert by


def test_planted_cases(spark):
    """Copies, a benchmark passage and a long repeated passage go; a clean document stays whole."""
    clean = [r for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang is not null and n_chars between 600 and 3000").orderBy("doc_id").limit(3).collect()]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 80").orderBy("item_id").first()["text"]
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    a, b, _ = (r.asDict() for r in clean)
    rows = [a | {"doc_id": 1}, a | {"doc_id": 2}, b | {"doc_id": 3}, b | {"doc_id": 4, "text": b["text"] + f" one more word. {item}"}, a | {"doc_id": 5, "text": "12 34 !! 56"}]
    docs = spark.createDataFrame([tuple(r[f.name] for f in schema) for r in rows], schema)
    stages = dict(corpus_pipeline.STAGES)
    assert {r["doc_id"] for r in stages["near_duplicates"](spark, docs, SF).collect()} >= {1, 3, 5}
    assert 2 not in {r["doc_id"] for r in stages["near_duplicates"](spark, docs, SF).collect()}
    assert 5 not in {r["doc_id"] for r in stages["language_id"](spark, docs, SF).collect()}
    assert 4 not in {r["doc_id"] for r in stages["decontamination"](spark, docs, SF).collect()}
    cut = {r["doc_id"]: r["text"] for r in stages["substring_dedup"](spark, docs, SF).collect()}
    assert cut[1] == a["text"] and cut[2] == "" and cut[4].endswith(item)


def stage_by_stage(spark, docs):
    """What each stage leaves, and the packed rows."""
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        rows = out.collect()
        left[name] = rows
        docs = spark.createDataFrame(rows, out.schema)
    return left


def test_an_empty_table(spark):
    left = stage_by_stage(spark, spark.read.parquet(f"{SF}/documents.parquet").limit(0))
    assert all(rows == [] for rows in left.values())


def test_odd_rows_and_more_columns(spark):
    """Rows without id, unlike rows of one id, rows that repeat, no text, no letters, a very long text; columns named like ours."""
    rng = random.Random(17)
    source = spark.read.parquet(f"{SF}/documents.parquet")
    columns = list(source.columns)
    rows = [r.asDict() for r in source.where("lang is not null and n_chars between 900 and 3000").orderBy("doc_id").limit(60).collect()]
    base = rows[0]
    own = []
    for k, doc_id in enumerate((None, None, 70, 70)):  # words of a language in an order of their own: like no other text
        words = rows[k]["text"].split()
        rng.shuffle(words)
        own.append(rows[k] | {"doc_id": doc_id, "text": " ".join(words)})
    long = " ".join(f"{w}{k}" for k in range(40_000) for w in ("word", "and", "the"))
    rows += [*own, own[0], own[2], base | {"doc_id": 9000, "text": None}, base | {"doc_id": 9001, "text": ""}, base | {"doc_id": 9002, "text": "12 -- 34"}, base | {"doc_id": 9003, "text": long}, rows[5], rows[5]]
    more = ["row", "doc_key", "score", "spans", "__text", "bucket"]
    schema = StructType([*source.schema.fields, *[StructField(c, StringType()) for c in more]])
    docs = spark.createDataFrame([tuple(r[f] for f in columns) + tuple(more) for r in rows], schema)
    left = stage_by_stage(spark, docs)
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert left[name] and all(r.asDict().keys() == set(schema.names) and r["row"] == "row" for r in left[name]), name
    found = {name: [(r["doc_id"], r["text"]) for r in left[name]] for name, _ in corpus_pipeline.STAGES[:-1]}
    known = {(r["doc_id"], r["text"]) for r in own} & set(found["language_id"])
    assert len(known) >= 3
    for name in ("near_duplicates", "substring_dedup", "decontamination"):
        assert all(found[name].count(x) == 1 for x in known), name  # each stays once, and whole
    assert len({t for _, t in found["near_duplicates"]}) == len(found["near_duplicates"])
    assert not {9000, 9001, 9002} & {r["doc_id"] for r in left["language_id"]}
    assert {r["doc_id"] for r in left["packing"]} == {r["doc_id"] for r in left["decontamination"]}
