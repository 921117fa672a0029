import zlib

import numpy as np

from tidemark.llm import shards as S


def brute(rows, shards=S.SHARDS):
    """The law, row by row in whole numbers."""
    sized = sorted((-1 if d is None else d, zlib.crc32((t or "").encode()), len((t or "").encode()) + S.ROW_BYTES) for d, t in rows)
    total, upto, out, slots = sum(x[2] for x in sized), 0, [], {}
    for d, crc, size in sized:
        upto += size
        k = min(shards - 1, shards * (2 * upto - size) // (2 * total))
        slots[k] = slots.get(k, -1) + 1
        out.append((d, size, crc, k, slots[k]))
    return sorted(out)


def got(df, **options):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in S.shard(df, **options).collect())


def test_given_documents(documents):
    assert got(documents) == brute([(r["doc_id"], r["text"]) for r in documents.collect()])


def test_odd_rows(odd, nothing):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert got(odd) == brute(rows)
    assert got(odd, shards=3) == brute(rows, 3)
    assert S.shard(nothing).count() == 0


def test_balance_and_law(spark):
    rows = [(i, "x" * (i * 37 % 1000)) for i in range(4000)]
    found = S.shard(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    sizes = found.groupby("shard")["size"].sum()
    assert len(sizes) == S.SHARDS and sizes.max() - sizes.min() <= 2 * found["size"].max()
    assert set(found.law) == {"bytes"} and found.grown_shard.isna().all()
    for _, s in found.groupby("shard"):
        assert (np.sort(s.slot) == np.arange(len(s))).all()


def test_no_python_in_the_plan(documents):
    plan = S.shard(documents)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
