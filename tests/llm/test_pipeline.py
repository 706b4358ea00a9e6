"""The registered queries against their SQL, and each stage of the pipeline against its operator's rule on its own input."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spanforge.llm import op1_packing, op2_langid, op3_line_rules, queries
from test_near_copies import brute_force


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracles(spark, sf, name):
    db = duckdb.connect()
    for table in ("documents", "conversations", "embeddings"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    want = db.execute(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, sf).toPandas()[list(want.columns)]
    a, b = (x.sort_values(list(want.columns)).reset_index(drop=True) for x in (got, want))
    assert len(a) == len(b) and (a.astype(str) == b.astype(str)).all().all()


def test_stages_follow_their_operators(spark, sf, documents):
    docs = documents
    results = []
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, sf), "stage-test")
        results.append(docs)
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    found = op2_langid.identified(documents).where((F.col("lang_pred") != "und") & (F.col("score") >= 0.5))
    assert ids(results[0]) == ids(found)
    assert ids(results[1]) == ids(op3_line_rules.verdicts(results[0]).where("kept"))
    # the stage's rule is its own: five words and a similarity of 0.8, not the four bits of the registered query
    assert ids(results[2]) == brute_force([(r["doc_id"], r["text"] or "") for r in results[1].select("doc_id", "text").collect()])
    texts = {r["doc_id"]: r["text"] for r in results[2].collect()}
    seen, want = set(), {}
    for i in sorted(texts):
        raw = texts[i].encode()
        gone, own = [False] * len(raw), set()
        for p in range(len(raw) - 49):
            if raw[p : p + 50] in seen:
                gone[p : p + 50] = [True] * 50
            own.add(raw[p : p + 50])
        seen |= own
        want[i] = bytes(b for b, g in zip(raw, gone) if not g).decode(errors="ignore")
    assert {r["doc_id"]: r["text"] for r in results[3].collect()} == want
    assert results[3].columns == documents.columns
    total = results[4].agg(F.sum("length"), F.countDistinct("sequence_id")).first()
    assert ids(results[4]) == ids(results[3]) and total[1] <= -(-total[0] // op1_packing.CAPACITY) * 1.03 + 1


def test_stages_take_awkward_rows(spark, docs_of, sf):
    rows = [(1, None, None, None), (2, "", "en", "h"), (None, "some words here " * 5, "en", None), (3, "one two three four five six seven eight nine ten eleven", "en", "h"), (3, "one two three four five six seven eight nine ten eleven", "en", "h")]
    for table in (rows, []):
        docs = docs_of(table)
        for _, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.written(stage(spark, docs, sf), "stage-test")
        docs.collect()


def test_suffix_stage_keeps_what_the_author_wrote(spark, docs_of, sf):
    shared = "\u00e9" * 30  # 60 bytes; the second copy loses whole characters only
    rows = [(1, "x" + shared), (2, "a\ufffdb " + shared + " z\ufffd"), (3, "\u00e9" + "y" * 60), (4, "\u0169" + "y" * 60)]
    found = {r["doc_id"]: r["text"] for r in corpus_pipeline.suffix_dedup(spark, docs_of(rows), sf).collect()}
    assert found[1] == "x" + shared and found[2] == "a\ufffdb  z\ufffd" and found[3] == "\u00e9" + "y" * 60
    # the last byte of the first character repeats with the y's, so the other one goes too
    assert found[4] == ""
