"""The corpus pipeline against a brute-force version, stage by stage."""

import os
from collections import Counter

import brute
import corpus_pipeline as P
import numpy as np
from pyspark.sql import functions as F

from cohortlab.llm import packing, secrets, toxicity
from cohortlab.llm.stage import shared_dir, table


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    columns = docs.columns
    model = toxicity.train(docs, table(spark, sf, "labels"))
    scored = {r["doc_id"]: r["toxic"] for r in toxicity.score_severity(docs, model).collect()}
    items = [tuple(r) for r in table(spark, sf, "benchmark").select("item_id", "text").collect()]
    steps = dict(P.STAGES)

    def same(df, want):
        assert df.columns == columns
        assert Counter((r["doc_id"], r["text"]) for r in df.collect()) == Counter(want)

    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    docs, rows = steps["toxicity"](spark, docs, sf), [r for r in rows if not scored[r[0]]]
    same(docs, rows)
    docs = steps["near_duplicates"](spark, docs, sf)
    rows = [r for r, (_, comp) in zip(rows, brute.jaccard(rows)) if comp == r[0]]
    same(docs, rows)
    docs = steps["decontamination"](spark, docs, sf)
    rows = [r for r, x in zip(rows, brute.decontaminate([t for _, t in rows], items)) if not x[-1]]
    same(docs, rows)
    docs = steps["secrets"](spark, docs, sf)
    assert docs.columns == columns and {r["doc_id"] for r in docs.collect()} == {i for i, _ in rows}
    clean = {i: t for i, t in rows if not any(brute.secrets(t)[:3])}
    assert {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] in clean} == clean
    assert secrets.scan_secrets(docs).where(F.size("secrets") > 0).count() == 0
    model = packing.WordTokenizer(packing.tokenizer_path()).model
    n = {r["doc_id"]: len(model.encode(r["text"], add_special_tokens=False).ids) + 1 for r in docs.collect()}
    got = Counter()
    for r in steps["packing"](spark, docs, sf).collect():
        got[r["doc_id"]] += r["length"]
    assert got == n


def test_hard_rows(spark, docs, empty, sf):
    keep = [c for c in docs.columns]
    for name, step in P.STAGES[:-1]:
        out = step(spark, docs, sf)
        assert out.columns == keep, name
        assert step(spark, empty, sf).count() == 0
    left = P.drop_near_duplicates(spark, docs, sf).collect()
    ids = [r["doc_id"] for r in left]
    assert ids.count(0) == 1 and 1 not in ids and 2 not in ids and 3 in ids  # copies of row 0 go; wordless rows stay
    assert np.all([r["text"] is None for r in left if r["doc_id"] == 3])


def left_over(spark):
    folder = shared_dir(spark).removeprefix("file://")
    return {f for f in os.listdir(folder) if f.startswith(("llm-", "pipeline-"))}


def test_run_leaves_its_result_only(spark, sf):
    before = left_over(spark)
    out = P.run(spark, sf)
    new = left_over(spark) - before
    assert len(new) == 1 and new.pop().startswith("pipeline-packing") and out.count() > 0


def test_steps_that_write_between_leave_no_tables(spark, sf, tmp_path):
    """A step called with docs read from the last result removes that step's tables; one
    called with docs that still read them does not."""
    P.end_steps(spark)
    before = left_over(spark)
    docs = table(spark, sf, "documents")
    docs = P.drop_near_duplicates(spark, docs, sf)
    own = left_over(spark) - before
    chained = P.drop_contaminated(spark, docs, sf)
    assert own <= left_over(spark)
    chained.write.parquet(f"{tmp_path}/a")
    P.redact_secrets(spark, spark.read.parquet(f"{tmp_path}/a"), sf).write.parquet(f"{tmp_path}/b")
    assert not own & left_over(spark)
    P.end_steps(spark)
    assert left_over(spark) == before
