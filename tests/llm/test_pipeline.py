import glob
import os
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from tidemark.llm import decontaminate, packing, pii, toxicity
from tidemark.llm.queries import ORACLE_SQL, QUERIES


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "decontamination", "pii", "packing"]


def test_run_against_brute_force(spark, data, documents):
    from tests.llm.test_ngram_join import brute

    labels = spark.read.parquet(f"{data}/labels.parquet")
    rows = {r["doc_id"]: r["text"] for r in documents.collect()}
    model = toxicity.fit(documents, labels)
    memo = model.memo()
    rows = {d: t for d, t in rows.items() if model.probability(toxicity.evidence_of(t, memo, model)[0]) < 0.5}
    classes = brute(list(rows.items()))
    rows = {d: t for d, t in rows.items() if classes[d][0] == d}
    benchmark = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    passages = set()
    for _, text in benchmark:
        w = decontaminate.words_of(text)
        passages |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))}
    lengths = {len(x) for x in passages}

    def clean(text):
        w = decontaminate.words_of(text)
        return not any(tuple(w[i : i + n]) in passages for n in lengths for i in range(len(w) - n + 1))

    rows = {d: t for d, t in rows.items() if clean(t)}
    crf = pii.fit(spark.createDataFrame(list(rows.items()), "doc_id long, text string"))
    rows = {d: pii.masked_text(t, pii.spans_of(crf, t)[1]) for d, t in rows.items()}
    ids = {d: np.frombuffer(x + bytes(4), "<u4") for d, x in zip(rows, packing.Encoder(packing.tokenizer_path()).whole(list(rows.values())), strict=True)}
    found = corpus_pipeline.run(spark, data).toPandas()
    assert set(found.doc_id) == set(ids)
    for r in found.itertuples():
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].astype("<u4").tobytes())
    assert found.length.sum() == sum(map(len, ids.values()))


def test_stages_keep_the_columns(spark, data, odd):
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, data)
        assert docs.columns == odd.columns, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, data).count() > 0


def test_stages_of_an_empty_table(spark, data, nothing):
    docs = nothing
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, data)
    assert docs.count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_against_sql(spark, data, name):
    connection = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    found = QUERIES[name](spark, data)
    columns = sorted(found.columns)
    result = connection.execute(ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(str([r[names.index(c)] for c in columns]) for r in result.fetchall())
    assert sorted(str([r[c] for c in columns]) for r in found.collect()) == want
