import hashlib
import math
import re
from collections import defaultdict
from pathlib import Path

import pyarrow as pa

import corpus_pipeline
from tesserae.llm import cotrain, pii
from tesserae.llm.common import pii_key, shared_dir, slices, staged
from tests.conftest import SF
from tests.llm.test_jaccard import survivors
from tests.llm.test_mixing import fill


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, at = docs.columns, {}
    stages = dict(corpus_pipeline.STAGES)
    for name in ("quality", "near_dedup", "pii", "mix"):
        before = docs
        docs = staged(stages[name](spark, before, SF), f"test-{name}")
        assert docs.columns == columns
        at[name] = docs.collect()
        if name == "quality":
            score = {r.doc_id: r.score for r in cotrain.classify(before, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
            assert {r.doc_id for r in at[name]} == {i for i, s in score.items() if s >= 0.5}
    good = at["quality"]
    assert sorted(r.doc_id for r in at["near_dedup"]) == survivors([(r.doc_id, r.text) for r in good])
    assert {r.doc_id: r.text for r in at["pii"]} == {r.doc_id: pii.replace(r.text, key=pii_key(spark))[0] for r in at["near_dedup"]}
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in at["pii"]:
        sizes[r.source] += words(r.text)
    for r in at["mix"]:
        taken[r.source] += words(r.text)
        assert r.n_chars == len(r.text)
    assert dict(taken) == {s: n for s, t in fill(sizes).items() if (n := math.floor(t))}
    out = stages["tokens"](spark, docs, SF).collect()
    assert sorted((r.doc_id, r.decoded_sha256) for r in out) == sorted((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in at["mix"])
    assert all(r.n_tokens == len(r.token_ids) for r in out)


def test_every_stage_on_odd_tables(spark):
    """Nulls, empty and very long texts, repeated rows, extra columns and an empty table, through all stages one after another."""
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    real = [r for r in spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 12").collect()]
    of = lambda **new: tuple(new.get(f.name) for f in schema)
    rows = [tuple(r) for r in real] + [tuple(r) for r in real[:2]]
    rows += [of(doc_id=900), of(doc_id=901, text="", lang="en"), of(doc_id=902, text=" \n ", source="a"), of(doc_id=None, text="no id at all", source="a")]
    rows += [of(doc_id=903, text="Some words of a long text, mail me@x.example.com. " * 20_000, lang="en", source="b"), of(doc_id=904, text="x" * 2_000_000, lang="en", source="b")]
    docs = spark.createDataFrame(rows, schema).selectExpr("*", "1 as key", "'k' as h", "2 as size", "3 as place")
    for name, stage in corpus_pipeline.STAGES:
        out = staged(stage(spark, docs, SF), f"odd-{name}")
        assert name == "tokens" or [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in docs.schema], name
        if name == "near_dedup":
            assert out.count() == out.select("doc_id").distinct().count() < docs.count()
        if name == "pii":
            assert out.where("contains(text, 'me@x.example.com')").count() == 0 and out.count() == docs.count()
        docs = out
    assert docs.count() > 0
    empty = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_no_stage_leaves_a_copy_of_the_texts(spark):
    """What a stage writes for itself is gone once its result has been written; later stages had the first one's copy beside them."""
    top = Path(shared_dir(spark).removeprefix("file:")) / "tesserae"
    folders = lambda: {p.name for p in top.glob("*")}
    before = folders()
    docs = staged(corpus_pipeline.quality(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF), "alone")
    assert {re.sub("-[0-9a-f]{32}", "", x) for x in folders() - before} == {"alone"}
    staged(corpus_pipeline.near_dedup(spark, docs, SF), "alone")
    assert {re.sub("-[0-9a-f]{32}", "", x) for x in folders() - before} == {"alone"}


def test_slices_hold_all_rows_and_few_at_once():
    batches = [pa.RecordBatch.from_pydict({"x": list(range(a, b))}) for a, b in ((0, 1300), (1300, 1300), (1300, 1301))]
    got = [b.column(0).to_pylist() for b in slices(iter(batches))]
    assert sum(got, []) == list(range(1301)) and [len(x) for x in got] == [512, 512, 276, 1]
