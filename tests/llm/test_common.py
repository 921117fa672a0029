import pyarrow as pa

from tidemark.llm.common import bounded, durable, with_text


def test_batches_are_cut_by_bytes():
    texts = ["a" * 5, None, "", "b" * 30, "é" * 4, "c"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], names=["id", "text"])
    parts = list(bounded(iter([batch, batch.slice(0, 0), batch.slice(2, 3)]), "text", 10))
    assert [p.column("id").to_pylist() for p in parts] == [[0, 1, 2], [3], [4, 5], [2], [3], [4]]
    assert [x for p in parts[:3] for x in p.column("text").to_pylist()] == texts


def test_small_tables_go_into_few_files(spark):
    table = durable(spark.range(1_000).repartition(4), 1_000)
    assert table.rdd.getNumPartitions() == 1 and table.count() == 1_000
    assert durable(spark.range(1_000).repartition(4)).rdd.getNumPartitions() == 4


def test_new_texts_keep_the_other_columns(odd):
    found = with_text(odd, "text", lambda texts: [t.upper() for t in texts]).collect()
    for new, old in zip(sorted(map(str, found)), sorted(map(str, odd.collect())), strict=True):
        assert len(new) >= len(old)
    assert {(r["doc_id"], r["text"]) for r in found} == {(r["doc_id"], r["text"] and r["text"].upper()) for r in odd.collect()}
