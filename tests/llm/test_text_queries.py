"""Registered text queries on the smallest tables, and the pipeline stage by stage."""

from __future__ import annotations

import brute
import pytest
from compare import rows
from pyspark.sql import functions as F

from splicefind.llm import queries


@pytest.fixture(scope="module")
def docs(spark, sf):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


@pytest.mark.parametrize("name", sorted(queries.oracles()))
def test_against_sql(name, spark, sf, duck):
    got, want = queries.registered()[name](spark, sf).toPandas(), duck.sql(queries.oracles()[name]).df()
    assert rows(got) == rows(want)


def test_names():
    assert [sum(k.startswith(f"op{n}_") for k in queries.registered()) for n in range(1, 14)] == [1] * 13


def test_jaccard_query(spark, sf, docs):
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in queries.op2_jaccard_join(spark, sf).collect())
    assert got == sorted(brute.components(docs))


def test_decontaminate_query(spark, sf, docs):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = sorted((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"]) for r in queries.op4_decontaminate(spark, sf).collect())
    assert got == sorted((d, n, h, len(i)) for d, n, h, i in brute.contaminated(docs, items))


def test_substring_query(spark, sf, docs):
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in queries.op5_substring_dedup(spark, sf).collect())
    assert got == sorted(brute.deduped(docs))


def test_classifier_query_on_held_out_rows(spark, sf):
    out = queries.op8_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    n = out.count()
    assert n and out.where("(predicted = 1) = (quality = 1)").count() / n > 0.85


def test_language_query_on_held_out_rows(spark, sf):
    out = queries.op10_language_id(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    n = out.count()
    assert n and out.where("lang_pred = lang").count() / n > 0.9


def test_pipeline_stages(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, state = docs.columns, docs
    for i, (name, stage) in enumerate(p.STAGES):
        before = {r["doc_id"]: r["text"] for r in state.collect()}
        out = stage(spark, state, sf)
        if i == 4:
            assert {r["doc_id"] for r in out.select("doc_id").collect()} == set(before)
            break
        assert out.columns == names
        after = {r["doc_id"]: r["text"] for r in out.collect()}
        assert after.keys() <= before.keys() and len(after) > 0.5 * len(before), name
        pairs = sorted(before.items())
        if name == "jaccard_join":
            assert set(after) == {d for d, _, c in brute.components(pairs) if d == c}
        if name == "substring_dedup":
            want = {d: (n, g) for d, n, g, _ in brute.deduped(pairs)}
            assert set(after) == {d for d, (n, g) in want.items() if n == 0 or g < n}
            assert all(len(brute.words(after[d])) == want[d][0] - want[d][1] for d in after)
        if name == "decontamination":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert set(after) == {d for d, _, h, _ in brute.contaminated(pairs, items) if h == 0}
        state = spark.createDataFrame(out.collect(), docs.schema)


def test_pipeline_stages_on_odd_rows(spark, sf):
    """Null and repeated ids, empty texts, columns that bear inner names; and no rows at all."""
    import corpus_pipeline as p

    item = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy(F.length("text").desc()).first()["text"]
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (None, text), (2, text + " more"), (2, " ".join(f"v{i}" for i in range(50))), (2, " ".join(f"v{i}" for i in range(50))), (None, None), (None, ""), (None, item), (5, item), (8, "few words")]
    schema = "doc_id long, text string, lang string, n_removed long, n_words long, score double, s_words string, digest string, h long, document string, place int"
    df = spark.createDataFrame([(i, t, f"l{k}", k, k, 0.5, "s", "d", k, "doc", k) for k, (i, t) in enumerate(rows)], schema)
    stages = dict(p.STAGES)
    for name, stage in p.STAGES[:-1]:
        assert stage(spark, df.limit(0), sf).columns == df.columns
        assert stage(spark, df.limit(0), sf).count() == 0, name
        assert stage(spark, df, sf).columns == df.columns
    assert stages["packing"](spark, df.limit(0), sf).count() == 0
    kept = {r["lang"] for r in stages["jaccard_join"](spark, df, sf).collect()}
    assert kept == {"l1", "l3", "l5", "l6", "l7", "l9"}  # no id comes first; of alike rows the first by the other columns
    cut = {r["lang"]: r for r in stages["substring_dedup"](spark, df, sf).collect()}
    assert set(cut) == {"l2", "l5", "l6", "l9"} and cut["l2"]["text"] == "more" and cut["l2"]["n_removed"] == 2 and cut["l9"]["n_words"] == 9
    assert {r["lang"] for r in stages["decontamination"](spark, df, sf).collect()} == {f"l{k}" for k in range(10)} - {"l7", "l8"}
    assert stages["quality_classifier"](spark, df, sf).where("score <> 0.5").count() == 0
