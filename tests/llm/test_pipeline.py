"""The pipeline on the awkward documents, stage by stage, and the registered queries against their SQL."""

from __future__ import annotations

from collections import Counter

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from tesserae.llm import oracles, queries  # noqa: E402
from tests.llm import fixture as X  # noqa: E402
from tests.llm.test_operators import brute_components, brute_fingerprint, brute_hits  # noqa: E402
from tests.oracle import DATA, connect, differences  # noqa: E402


def test_stages(spark, tmp_path):
    sf = f"file://{tmp_path}"
    X.documents(spark).write.parquet(f"{sf}/documents.parquet")
    X.benchmark(spark).write.parquet(f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = texts(docs)
        out = stage(spark, docs, sf)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{sf}/{name}")
        docs = spark.read.parquet(f"{sf}/{name}")
        kept[name] = before, docs
    before, after = kept["language_id"]
    assert {d for d, t in before if t and any(map(str.isalpha, t)) and len(t) > 40} <= {d for d, _ in texts(after)}
    assert all(t and any(map(str.isalpha, t)) for _, t in texts(after))
    before, after = kept["line_dedup"]
    assert sum("newsletter!" in t.lower() for _, t in texts(after)) == 1
    left = {d for d, _ in texts(after)}
    # of ten copies and more one is left, here the one without an id, which comes before all others
    assert {d for d, _ in before} - left == set(range(40, 55)) and dict(texts(after))[None] == dict(before)[40]
    before, after = kept["simhash_near_dedup"]
    want = brute_components([brute_fingerprint(t) for _, t in before], [d for d, _ in before])
    assert Counter(d for d, _ in texts(after)) == Counter(set(want))
    before, after = kept["benchmark_decontamination"]
    assert all(brute_hits(t, X.BENCHMARK)[1] == 0 for _, t in texts(after))
    assert {x for x in before if not brute_hits(x[1], X.BENCHMARK)[1]} <= set(texts(after))
    _, after = kept["packing"]
    assert {r.doc_id for r in after.collect()} == {d for d, _ in texts(kept["benchmark_decontamination"][1])}
    assert corpus_pipeline.run(spark, sf).count() == after.count()


@pytest.mark.parametrize("name", sorted(set(oracles.ORACLE_SQL) - {"op5_suffix_array_dedup"}))
def test_equals_sql(spark, name):
    assert not differences(queries.QUERIES[name](spark, f"{DATA}/sf0.001"), oracles.ORACLE_SQL[name], connect("sf0.001"))


def test_suffixes_equal_sql(spark, tmp_path):
    con, sf = connect("sf0.001"), f"file://{tmp_path}"
    spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").where("octet_length(text) < 2000").write.parquet(f"{sf}/documents.parquet")
    con.sql(f"create or replace view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert not differences(queries.QUERIES["op5_suffix_array_dedup"](spark, sf), oracles.SUFFIXES, con)


def test_line_stage_leaves_the_first(spark):
    many = [(k, f"own words of number {k}\nAll rights reserved by nobody in particular\nRead more below", "en") for k in range(12)]
    short = [(20, "All rights reserved by nobody in particular\nshort", "en"), (21, "Read more below\nAll rights reserved by nobody in particular", "en")]
    copies = [(30 + k, "A first line that is copied\n" + ("a SECOND one " if k % 2 else "a second one") + "\nread more below", "en") for k in range(11)]
    rest = [(50, "a second one\nbut no copy of the others", "en"), (60, "", "en"), (61, None, "en"), (62, " \n ", "en")]
    docs = spark.createDataFrame(many + short + copies + rest, "doc_id long, text string, lang string").repartition(3).selectExpr("*", "'x' as n_dropped")
    out = corpus_pipeline.lines(spark, docs, "")
    assert out.columns == docs.columns and {r.n_dropped for r in out.collect()} == {"x"}
    got = {r.doc_id: r.text for r in out.collect()}
    want = {k: f"own words of number {k}" for k in range(1, 12)} | {0: many[0][1], 20: "short", 30: "A first line that is copied\na second one", 50: "but no copy of the others", 60: "", 61: None, 62: " \n "}
    assert got == want
