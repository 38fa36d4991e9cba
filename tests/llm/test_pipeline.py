"""run() against plain versions of its stages, on the smallest tables."""

import os
from collections import Counter

import brute
import duckdb
import pytest

from readweft.llm import op1_mixing as op1
from readweft.llm import op4_quality as op4
from readweft.llm import op6_bpe as op6

pipeline = pytest.importorskip("corpus_pipeline")
FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_run(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    table = spark.read.parquet(f"{FOLDER}/documents.parquet")
    forest = op4.fit(table, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    import pyarrow as pa

    keep = op4.verdicts(op4.stats(pa.array([d[1] for d in docs])), forest)[1]
    for d, k in zip(docs, keep, strict=True):
        n, _, _, _, repeat = brute.stats(d[1])
        assert not (k and (n < 50 or 100 * repeat > 50 * n))
    docs = [d for d, k in zip(docs, keep, strict=True) if k]
    texts = brute.without_boilerplate([(d[3], d[1]) for d in docs])
    docs = [(d[0], t, d[2], d[3]) for d, t in zip(docs, texts, strict=True)]
    found = brute.near([(d[0], d[1]) for d in docs])
    docs = [d for d in docs if found[d[0]][1] == d[0]]
    db = duckdb.connect()
    db.execute("CREATE TABLE left_over (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    db.executemany("INSERT INTO left_over VALUES (?, ?, ?, ?)", docs)
    read = Counter(r[0] for r in db.execute(op1.mix_sql("left_over", "doc_id")).fetchall())
    t = op6.tokenizer(op6.default_path())
    ids = {d[0]: t.encode(d[1]) for d in docs}
    got = pipeline.run(spark, FOLDER).collect()
    assert Counter(r.doc_id for r in got) == read and read
    assert all(r.ids == ids[r.doc_id] and r.n_tokens == len(r.ids) for r in got)


def test_stages(spark):
    assert [n for n, _ in pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "mixing", "bpe"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for _, stage in pipeline.STAGES[:4]:
        assert stage(spark, docs, FOLDER).columns == docs.columns
        assert stage(spark, docs.limit(0), FOLDER).isEmpty()


def test_stages_keep_odd_rows_and_columns(spark):
    """Nulls, empty, long and repeated texts, and columns that operators use themselves."""
    own = ["_text", "_lines", "_dropped", "_domain", "_lang", "_source", "_tokens", "_epoch", "_row", "_ids", "n", "h", "t", "rep", "kept"]
    prose = lambda k, n=60: " ".join(f"w{k}x{i}" for i in range(n))
    texts = [None, "", "a b", prose(1), prose(1), prose(2, 30000), prose(3) + "\nCopyright", *(prose(k) + "\nCopyright" for k in range(10, 30))]
    rows = [(k, t, None if k == 3 else "en", None if k == 4 else "src1", len(t or "")) for k, t in enumerate(texts)]
    rows += [rows[-1], (None, prose(90), "en", "src1", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *(f"'own' as {c}" for c in own))
    kept = {}
    for name, stage in pipeline.STAGES[:4]:
        out = stage(spark, docs, FOLDER)
        found = out.collect()
        assert out.columns == docs.columns and all(r[c] == "own" for r in found for c in own), name
        kept[name] = Counter((r.doc_id, r.text) for r in found)
    every = Counter((r[0], r[1]) for r in rows)
    assert kept["quality_rules"] == Counter({x: n for x, n in every.items() if x[1] and len(x[1].split()) >= 50})
    assert kept["line_dedup"] == Counter((r[0], r[1] if r[1] is None else r[1].replace("\nCopyright", "")) for r in rows)
    assert {x for x in every if x[1] not in (prose(1), "")} | {(3, prose(1)), (1, "")} == set(kept["near_dedup"]) and set(kept["mixing"]) <= set(every)
    assert pipeline.STAGES[4][1](spark, docs, FOLDER).count() == len(rows)
