"""Similarity join on word n-grams: a MinHash LSH forest with exact verification.

Two documents are linked when the Jaccard similarity of their sets of five-word
shingles (lower-cased words; a text of one to four words is one shingle) is 0.8 or
more.

1. One Python pass turns each text into a signature of ``TREES * DEPTH`` minima.
   Texts with equal shingle sets are one class from there on, so copies cost nothing.
2. Each tree sorts the classes by their label sequence, which lays its prefix trie
   out flat: the classes under a node are neighbours, and the labels that two
   neighbours share from the start are the depth of the node that parts them.  The
   sort is by range, so no node, however full, has to fit a task.  Each class meets
   the ``REACH`` classes before it, at the deepest node they share, never all of a node.
3. A class's matched prefix starts at full depth and is shortened for everyone until
   ``1 - (1 - s**depth)**trees`` reaches the target recall at the threshold.  From
   there each class shortens its own prefix on, down to ``LEAST_DEPTH``, until the
   share of trees in which its links were hit says that a link is missed by all trees
   with less than the target's chance.  A pair counts at the shorter of its two
   prefixes, if its signatures agree in half the places, far below the threshold.
4. Connected components of those pairs are the candidate groups, and inside a group
   the shingle sets are compared exactly.  A group that fits one task is compared
   where its texts meet.  A larger one is dealt into chunks that each hold the group's
   base set, where each set is written as its differences from the base; sets whose
   sizes alone rule a link out never meet, and the others meet as pairs of blocks of
   bounded rows and shingles.  No text is moved more than twice, and no pair leaves a
   task: it returns numbers of links and a spanning forest.

Defined cases: null and empty texts, and texts without a word, have no shingles and
are never linked; a row with a null id takes no part; rows that repeat an id are
one document (of its texts with a word, the smallest by hash); ties take the
smallest id; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import HEAVY_ROWS, WIDE_ROWS, Memo, bounded, column_names_like, durable, fewer, map_rows, struct_of, texts_of
from tidemark.llm.graph import components

WORD = re.compile(r"\w+")
WIDTH = 5
TREES, DEPTH = 20, 6
#: 9 * inter >= 4 * (a + b) is a Jaccard similarity of 0.8 or more, in whole numbers.
SIMILARITY = 0.8
TARGET_RECALL = 0.999
KEEP = 0.5
#: Neighbours that a class meets in a tree, and the shortest prefix that counts.
REACH, LEAST_DEPTH = 2, 3
#: Classes and shingles in a block, on average; a class with more shingles is a block's best part.
BLOCK, BLOCK_SHINGLES = 500, 400_000
COLUMNS = 4_096
#: Sizes of sets on a logarithmic scale; linked sets are at most one step apart (a hair over 1.25).
STEP = math.log(1.2501)

_random = np.random.default_rng(20_240_607)
_FLIP = _random.integers(0, 2**32, TREES * DEPTH, dtype=np.uint32)
_TIMES = _random.integers(0, 2**32, TREES * DEPTH, dtype=np.uint32) | np.uint32(1)
_PLACE = _random.integers(0, 2**63, WIDTH, dtype=np.uint64) | np.uint64(1)


def word_memo() -> Memo:
    digest = xxhash.xxh3_64_intdigest
    return Memo(lambda w: digest(w.encode("utf-8", "surrogatepass")))


def shingles(text: str, memo: Memo) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct shingles."""
    words = WORD.findall(text.lower())
    if not words:
        return np.empty(0, np.uint64)
    ids = np.array(list(map(memo.__getitem__, words)), np.uint64)
    n = max(1, len(ids) - WIDTH + 1)
    mixed = np.zeros(n, np.uint64)
    for i in range(min(WIDTH, len(ids))):
        mixed = (mixed ^ ids[i : i + n]) * _PLACE[i]
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def signature(hashes: np.ndarray) -> bytes:
    """``TREES * DEPTH`` labels of 16 bits each."""
    x = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    least = np.full(TREES * DEPTH, 2**32 - 1, np.uint32)
    for i in range(0, len(x), 2_048):
        part = x[i : i + 2_048]
        np.minimum(least, ((part[None, :] ^ _FLIP[:, None]) * _TIMES[:, None]).min(1), out=least)
    # the minima of many shingles have zeros on top: mix before taking 16 bits
    least = (least ^ (least >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (least >> np.uint32(16)).astype(">u2").tobytes()


def text_key(column: Column) -> Column:
    """The key that tells texts apart, 16 bytes."""
    return F.unhex(F.md5(column.cast("binary")))


def sketches(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, text_key, set_key, size, sig)`` of each document with a word and an id."""
    schema = pa.schema([("id", pa.int64()), ("text_key", pa.binary()), ("set_key", pa.binary()), ("size", pa.int64()), ("sig", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = word_memo()
        for batch in bounded(batches, "text"):
            out: list[tuple] = []
            for doc, key, text in zip(batch.column("id").to_pylist(), batch.column("text_key").to_pylist(), texts_of(batch, "text"), strict=True):
                hashes = shingles(text, memo)
                if len(hashes) and doc is not None:
                    out.append((doc, key, xxhash.xxh3_128_digest(hashes.tobytes()), len(hashes), signature(hashes)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return documents.select(F.col(id_col).cast("long").alias("id"), text_key(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text")).mapInArrow(run, "id long, text_key binary, set_key binary, size long, sig binary")


def shortest_prefix(similarity: float = SIMILARITY, recall: float = TARGET_RECALL, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix, at most ``depth``, whose worst-case recall reaches the target."""
    while depth > 1 and 1 - (1 - similarity**depth) ** trees < recall:
        depth -= 1
    return depth


def _labels(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A column of label sequences as an array, read where Arrow keeps it."""
    column = batch.column(name).cast(pa.binary())
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(">u2").reshape(len(column), -1)


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels that two sequences share from the start."""
    return np.cumprod(a == b, axis=-1, dtype=np.int32).sum(-1)


NEIGHBOURS = "u long, v long, depth int, tree int, path binary, turn long"


def _neighbours(batches: Iterator[pa.RecordBatch], ends: bool) -> Iterator[pa.RecordBatch]:
    """Pairs of a sorted stretch ``(tree, path, turn, cid)``, with the depth of their node.

    ``ends``: the stretch's first and last ``REACH`` rows follow, as rows without a depth.
    """
    before: list[pa.RecordBatch] = []
    opening: list[pa.RecordBatch] = []
    seen = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if seen < REACH:
            opening.append(batch.slice(0, REACH - seen))
        seen += batch.num_rows
        whole = pa.Table.from_batches([*before, batch]).combine_chunks().to_batches()[0]
        held = sum(x.num_rows for x in before)
        trees, labels, ids = whole.column("tree").to_numpy(), _labels(whole, "path"), whole.column("cid").to_numpy()
        for reach in range(1, REACH + 1):
            first = max(held, reach)  # earlier pairs went out with the batch before
            here, there = np.arange(first, len(ids)), np.arange(first, len(ids)) - reach
            depth = np.where(trees[here] == trees[there], _shared(labels[here], labels[there]), 0)
            kept = depth >= LEAST_DEPTH
            if kept.any():
                nothing = [pa.nulls(int(kept.sum()), k) for k in (pa.int32(), pa.binary(), pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(ids[here][kept]), pa.array(ids[there][kept]), pa.array(depth[kept], pa.int32()), *nothing], names=["u", "v", "depth", "tree", "path", "turn"])
        before = [whole.slice(max(0, whole.num_rows - REACH))]
    if ends:
        for x in [*opening, *before]:
            yield pa.RecordBatch.from_arrays([x.column("cid"), x.column("cid"), pa.nulls(x.num_rows, pa.int32()), x.column("tree"), x.column("path"), x.column("turn")], names=["u", "v", "depth", "tree", "path", "turn"])


def neighbours(classes: DataFrame, n: int) -> DataFrame:
    """``(u, v, depth)`` of classes near each other in a tree's sorted trie; ``classes(cid, sig)``, ``n`` of them."""
    order = ["tree", "path", "turn"]
    labels = [F.substring("sig", 1 + 2 * DEPTH * t, 2 * DEPTH) for t in range(TREES)]
    paths = classes.select("cid", F.posexplode(F.array(*labels)).alias("tree", "path")).withColumn("turn", F.xxhash64("cid", "tree"))
    stretches = paths.repartitionByRange(*order).sortWithinPartitions(*order).select("tree", "path", "turn", "cid")
    found = durable(stretches.mapInArrow(lambda batches: _neighbours(batches, True), NEIGHBOURS), REACH * TREES * n)
    # where one stretch ends and the next begins: at most 2 * REACH rows of each, whatever the input
    seams = found.where("depth is null").select("tree", "path", "turn", F.col("u").alias("cid")).distinct().coalesce(1).sortWithinPartitions(*order)
    across = seams.mapInArrow(lambda batches: _neighbours(batches, False), NEIGHBOURS)
    return found.where("depth is not null").unionByName(across).select("u", "v", "depth")


def _agreement(pairs: DataFrame) -> DataFrame:
    """``pairs(u, v, depth, a, b)`` with the share of equal labels, and the trees that share each prefix's length."""
    names = [f"m{d}" for d in range(LEAST_DEPTH, DEPTH + 1)]

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b = _labels(batch, "a"), _labels(batch, "b")
        together = _shared(a.reshape(len(a), TREES, DEPTH), b.reshape(len(b), TREES, DEPTH))
        hits = [pa.array((together >= d).sum(1), pa.int32()) for d in range(LEAST_DEPTH, DEPTH + 1)]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("u", "v", "depth")), pa.array((a == b).mean(1)), *hits], names=["u", "v", "depth", "s", *names])

    return map_rows(pairs, one, struct_of("u long, v long, depth int, s double, " + ", ".join(f"{n} int" for n in names)))


def candidate_pairs(classes: DataFrame, n: int) -> tuple[DataFrame, int]:
    """Pairs ``(u, v)``, and a bound on their number, that share a prefix of the length that their recall asks for, agreeing in half their labels.

    ``classes(cid, sig)``, ``n`` of them.
    """
    deepest = shortest_prefix()
    near = neighbours(classes, n)
    most = near.count()
    pairs = near.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.max("depth").alias("depth")).where("u < v")
    sig = classes.select("cid", "sig")
    pairs = pairs.join(sig.select(F.col("cid").alias("u"), F.col("sig").alias("a")), "u").join(sig.select(F.col("cid").alias("v"), F.col("sig").alias("b")), "v")
    found = durable(_agreement(pairs.select("u", "v", "depth", "a", "b")).where(F.col("s") >= KEEP), most, WIDE_ROWS)
    linked = found.where((F.col("s") >= SIMILARITY) & (F.col("depth") >= deepest))
    hits = [f"m{d}" for d in range(LEAST_DEPTH, deepest + 1)]
    both = linked.select(F.explode(F.array("u", "v")).alias("cid"), *hits).groupBy("cid").agg(*(F.avg(m).alias(m) for m in hits))
    # the chance that no tree hits a link that is hit as often as this class's own
    missed = {d: F.pow(1 - F.col(f"m{d}") / TREES, F.lit(TREES)) for d in range(LEAST_DEPTH, deepest + 1)}
    own = F.lit(LEAST_DEPTH)
    for d in range(LEAST_DEPTH + 1, deepest + 1):
        own = F.when(missed[d] <= 1 - TARGET_RECALL, F.lit(d)).otherwise(own)
    shorter = both.select("cid", own.alias("own")).where(F.col("own") < deepest)
    # found(u, v) is small beside the classes; a class that shortens pulls in the pairs of its shorter nodes
    more = found.where(F.col("depth") < deepest).select("u", "v", "depth", F.explode(F.array("u", "v")).alias("cid")).join(shorter, "cid").where("depth >= own")
    return found.where(F.col("depth") >= deepest).select("u", "v").unionByName(more.select("u", "v")).distinct(), most


def _forest(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges (class, root) of a spanning forest of a boolean matrix of links."""
    rows, columns, edges = np.ones(len(left), bool), np.ones(len(right), bool), []
    for start in np.flatnonzero(linked.any(1)):
        if not rows[start]:
            continue
        rows[start] = False
        front, root = np.array([start]), int(left[start])
        while len(front):
            new = linked[front].any(0) & columns
            columns &= ~new
            edges += [(int(c), root) for c in right[new] if c != root]
            back = linked[:, new].any(1) & rows
            rows &= ~back
            front = np.flatnonzero(back)
            edges += [(int(c), root) for c in left[front] if c != root]
    return edges


def _least_of_components(linked: np.ndarray, ids: np.ndarray) -> dict[int, int]:
    """Each class's least connected class, by a symmetric boolean matrix of links."""
    left, root = linked.any(1), {}
    for start in np.flatnonzero(left).tolist():
        if not left[start]:
            continue
        found = np.zeros(len(ids), bool)
        found[start] = True
        front = np.array([start])
        while len(front):
            front = np.flatnonzero(linked[front].any(0) & ~found)
            found[front] = True
        left &= ~found
        root |= dict.fromkeys(ids[found].tolist(), int(ids[found].min()))
    return root


def exact_links(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Which shingle sets are similar; ``right`` None: all against all of ``left``."""
    sets = left + (right or [])
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, seen = np.unique(flat, return_inverse=True, return_counts=True)
    shared = seen[column] > 1
    order = np.argsort(column[shared], kind="stable")
    owner, column = owner[shared][order], column[shared][order]
    column = np.cumsum(np.r_[0, np.diff(column) != 0])[: len(column)] if len(column) else column
    n, m = len(left), len(sets) - len(left)
    inter = np.zeros((n, m or n), np.float32)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [start, start + COLUMNS])
        dense = np.zeros((len(sets), min(COLUMNS, int(column[b - 1]) - start + 1)), np.float32)
        dense[owner[a:b], column[a:b] - start] = 1
        inter += dense[:n] @ (dense[n:] if m else dense).T
    a, b = sizes[:n], sizes[n:] if m else sizes
    linked = 9 * inter.astype(np.int64) >= 4 * (a[:, None] + b[None, :])
    if not m:
        np.fill_diagonal(linked, False)
    return linked


LINKS = pa.schema([("cid", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])
#: What the first pass returns: links of whole groups, and the sets of groups that are cut.
MET = pa.schema([*LINKS, ("grp", pa.int64()), ("chunk", pa.int64()), ("n_texts", pa.int64()), ("size", pa.int64()), ("gone", pa.binary()), ("extra", pa.binary())])
Member = tuple[int, int, np.ndarray]  # class, its texts, its shingles


def compare(left: list[Member], right: list[Member] | None = None) -> list[tuple[int, int, int]]:
    """(class, linked texts, root) of classes with a link; ``right`` None: all against all of ``left``.

    The roots are edges of a spanning forest, and of all against all each component's least class.
    """
    if not left or right is not None and not right:
        return []
    linked = exact_links([r[2] for r in left], None if right is None else [r[2] for r in right])
    other = right or left
    a, b = np.array([r[0] for r in left]), np.array([r[0] for r in other])
    links = dict(zip(a.tolist(), (linked @ np.array([r[1] for r in other], np.int64)).tolist(), strict=True))
    if right is not None:
        links |= dict(zip(b.tolist(), (linked.T @ np.array([r[1] for r in left], np.int64)).tolist(), strict=True))
    root = _least_of_components(linked, a) if right is None else dict(_forest(linked, a, b))
    return [(c, n, root.get(c, c)) for c, n in links.items() if n]


def _emit(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _in_runs(batches: Iterator[pa.RecordBatch], keys: list[str], others: list[str]) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """(key, rows) of each run of rows with one key; the rows are read once, as they come."""
    rows = (r for batch in bounded(batches, others[-1]) for r in zip(*(batch.column(c).to_pylist() for c in (*keys, *others)), strict=True))
    for key, run in groupby(rows, lambda r: r[: len(keys)]):
        yield key, (r[len(keys) :] for r in run)


def _meet(members: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """First pass: texts meet their group, or a chunk of it, and are never moved again."""
    total = members.groupBy("grp").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"))
    chunks = durable(total.select("grp", F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int").alias("chunks")), n)
    dealt = members.join(chunks, "grp").join(texts, ["cid", "text_key"]).dropDuplicates(["cid", "text_key"])
    own = F.pmod(F.xxhash64("cid"), F.col("chunks")).cast("int")
    # the group's least class goes to every chunk, ahead of the others, and gives the base set
    is_base = (F.col("cid") == F.col("grp")) & (F.col("chunks") > 1)
    where = F.explode(F.when(is_base, F.concat(F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct(c.alias("chunk"), F.lit(0).alias("turn"))), F.array(F.struct(own.alias("chunk"), F.lit(1).alias("turn"))))).otherwise(F.array(F.struct(own.alias("chunk"), F.lit(1).alias("turn")))))
    dealt = dealt.withColumn("at", where).select("grp", "at.chunk", "at.turn", "chunks", "cid", "n_texts", "text")
    dealt = dealt.repartition(F.col("grp"), F.col("chunk")).sortWithinPartitions("grp", "chunk", "turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, out = word_memo(), []
        for (grp, chunk, chunks), rows in _in_runs(batches, ["grp", "chunk", "chunks"], ["turn", "cid", "n_texts", "text"]):
            if chunks == 1:
                out += [(*x, *[None] * 6) for x in compare([(c, n, shingles(t, memo)) for _, c, n, t in rows])]
            else:
                base = None
                for turn, c, n, t in rows:
                    own = shingles(t, memo)
                    if not turn:
                        base = own
                        if not chunk:  # the base itself, once, for those that decode
                            out.append((None, None, None, grp, chunk, 0, len(own), b"", own.tobytes()))
                        continue
                    gone, extra = np.setdiff1d(base, own, assume_unique=True), np.setdiff1d(own, base, assume_unique=True)
                    out.append((c, None, None, grp, chunk, n, len(own), gone.tobytes(), extra.tobytes()))
                    if len(out) > 2_000:
                        yield _emit(out, MET)
                        out = []
            if len(out) > 2_000:
                yield _emit(out, MET)
                out = []
        if out:
            yield _emit(out, MET)

    return dealt.mapInArrow(run, "cid long, links long, root long, grp long, chunk long, n_texts long, size long, gone binary, extra binary")


def _blocks(met: DataFrame, n: int) -> DataFrame:
    """Second pass, over the sets of groups that were cut: pairs of blocks whose sizes allow a link."""
    step = F.floor(F.log(F.col("size").cast("double")) / STEP).cast("int")
    sets = met.where("grp is not null and cid is not null").select("grp", step.alias("k"), "chunk", "cid", "n_texts", "size", "gone", "extra")
    counts = sets.groupBy("grp", "k").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("n"), F.max("chunk").alias("chunks"))
    counts = durable(counts, n)
    at = lambda shift, name: counts.select("grp", (F.col("k") + shift).alias("k"), F.col("n").alias(name))
    known = counts.join(at(1, "below"), ["grp", "k"], "left").join(at(-1, "above"), ["grp", "k"], "left")
    # block (k, i) meets the blocks of its own step and of the next one; the task of a pair holds both
    none = F.array().cast("array<int>")
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(none)
    task = lambda k1, i1, k2, i2: F.struct(k1.alias("k1"), i1.alias("i1"), k2.alias("k2"), i2.alias("i2"))
    k, i = F.col("k"), F.pmod(F.xxhash64("cid"), F.col("n")).cast("int")
    tasks = F.concat(
        F.transform(upto(F.col("n")), lambda j: task(k, F.least(i, j), k, F.greatest(i, j))),
        F.transform(upto(F.col("above")), lambda j: task(k, i, k + 1, j)),
        F.transform(upto(F.col("below")), lambda j: task(k - 1, j, k, i)),
    )
    # by chunks, so that no group meets its numbers in one task
    by_chunk = known.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks"))))
    dealt = sets.join(by_chunk, ["grp", "k", "chunk"]).select("grp", F.explode(tasks).alias("t"), F.lit(1).alias("turn"), k.alias("k"), i.alias("i"), "cid", "n_texts", "gone", "extra")
    # each task of a group gets its base
    pairs = known.select("grp", F.explode(F.concat(F.flatten(F.transform(upto(F.col("n")), lambda x: F.transform(F.sequence(x, F.col("n") - 1), lambda j: task(k, x, k, j)))), F.flatten(F.transform(upto(F.col("n")), lambda x: F.transform(upto(F.col("above")), lambda j: task(k, x, k + 1, j)))))).alias("t"))
    base = met.where("grp is not null and cid is null").select("grp", "extra")
    bases = pairs.join(base, "grp").select("grp", "t", F.lit(0).alias("turn"), F.lit(0).alias("k"), F.lit(0).alias("i"), F.lit(0).cast("long").alias("cid"), F.lit(0).cast("long").alias("n_texts"), F.lit(None).cast("binary").alias("gone"), "extra")
    dealt = dealt.unionByName(bases).select("grp", "t.*", "turn", "k", "i", "cid", "n_texts", "gone", "extra")
    key = ["grp", "k1", "i1", "k2", "i2"]
    dealt = dealt.repartition(*map(F.col, key)).sortWithinPartitions(*key, "turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (_, k1, i1, k2, i2), rows in _in_runs(batches, key, ["turn", "k", "i", "cid", "n_texts", "gone", "extra"]):
            left, right, base = [], [], None
            for turn, k, i, c, n, gone, extra in rows:
                extra = np.frombuffer(extra, np.uint64)
                if not turn:
                    base = extra
                    continue
                own = np.concatenate([np.setdiff1d(base, np.frombuffer(gone, np.uint64), assume_unique=True), extra])
                (left if (k, i) == (k1, i1) else right).append((c, n, own))
            out += compare(left, None if (k1, i1) == (k2, i2) else right)
            if len(out) > 20_000:
                yield _emit(out, LINKS)
                out = []
        if out:
            yield _emit(out, LINKS)

    return dealt.mapInArrow(run, "cid long, links long, root long")


def verified(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Exact links inside candidate groups.

    ``members(grp, cid, n_texts, size, text_key)`` and ``texts(cid, text_key, text)``,
    whose rows may repeat; returns ``(cid, links, root)`` for each class with a link,
    where ``links`` counts different texts and ``root`` is the least class of its component.
    """
    n = members.count()
    met = durable(_meet(members, texts, n), n, HEAVY_ROWS)
    whole = met.where("grp is null").select("cid", "links", "root")
    if met.where("grp is not null").isEmpty():
        return whole
    cut = durable(_blocks(met, n), n, HEAVY_ROWS)
    links = cut.groupBy("cid").agg(F.sum("links").alias("links"))
    roots = components(cut.select(F.col("cid").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "cid")
    return whole.unionByName(links.join(roots, "cid", "left").select("cid", "links", F.coalesce("root", "cid").alias("root")))


def similarity_classes(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, class_id, n_links, n_copies)`` for each distinct id.

    ``class_id``: least id of the connected component of links; ``n_links``: other,
    different texts that are similar; ``n_copies``: documents with the same shingles.
    """
    slim = durable(sketches(documents, id_col=id_col, text_col=text_col))
    n = slim.count()
    # rows that repeat an id are one document
    once = slim.groupBy("id").agg(F.min(F.struct("text_key", "set_key", "size", "sig")).alias("x")).select("id", "x.*")
    one_text = once.groupBy("set_key", "text_key").agg(F.min("id").alias("cid"), F.count("*").alias("n"), F.first("size").alias("size"), F.first("sig").alias("sig"))
    classes = durable(one_text.groupBy("set_key").agg(F.min(F.struct("cid", "text_key")).alias("x"), F.sum("n").alias("n_copies"), F.count("*").alias("n_texts"), F.first("size").alias("size"), F.first("sig").alias("sig")).select("set_key", "x.*", "n_copies", "n_texts", "size", "sig"), n, WIDE_ROWS)
    groups = components(*candidate_pairs(classes, n))
    groups = groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct())
    members = durable(groups.select(F.col("root").alias("grp"), F.col("node").alias("cid")).join(classes.select("cid", "n_texts", "size", "text_key"), "cid"), n)
    texts = documents.select(F.col(id_col).cast("long").alias("cid"), text_key(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text")).where(F.col("cid").isNotNull() & F.col("text").isNotNull())
    whole = classes.join(verified(members, texts), "cid", "left")
    whole = whole.select("set_key", F.coalesce("root", "cid").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("n_texts") - 1).alias("n_links"), "n_copies")
    linked = once.select("id", "set_key").join(whole, "set_key").select(F.col("id").alias("doc_id"), "class_id", "n_links", "n_copies")
    ids = documents.select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    found = ids.join(linked, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("n_copies", F.lit(1).cast("long")).alias("n_copies"))
    return fewer(found, n, WIDE_ROWS)


def keep_one(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class: that with the least id; rows with a null id all stay.

    Of rows that repeat an id, one with the text that was compared stays.
    """
    gone, same, key = column_names_like(documents, ["copy_of_another", "same_id", "compared_key"])
    copies = similarity_classes(documents, id_col=id_col, text_col=text_col).where("class_id != doc_id").select(F.col("doc_id").alias(gone))
    kept = documents.join(copies, documents[id_col].cast("long") == F.col(gone), "left_anti")
    repeated = documents.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1")
    if repeated.isEmpty():
        return kept
    rows = documents.join(repeated.select(id_col), id_col, "left_semi")
    compared = sketches(rows, id_col=id_col, text_col=text_col).groupBy("id").agg(F.min("text_key").alias(key)).withColumnRenamed("id", same)
    one = kept.join(compared, kept[id_col].cast("long") == F.col(same), "left").where(F.col(key).isNull() | (text_key(F.col(text_col)) == F.col(key)))
    return one.select(kept.columns).dropDuplicates([id_col]).where(F.col(id_col).isNotNull()).unionByName(kept.where(F.col(id_col).isNull()))


def expected_recall(similarity: float, depth: int, trees: int = TREES) -> float:
    return -math.expm1(trees * math.log1p(-(similarity**depth))) if similarity < 1 else 1.0


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS words FROM documents
), t AS (
  SELECT doc_id, len(words) AS n, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM w
), g AS (
  SELECT doc_id, n, place, concat_ws(' ', word, lead(word, 1) OVER x, lead(word, 2) OVER x, lead(word, 3) OVER x, lead(word, 4) OVER x) AS shingle FROM t WINDOW x AS (PARTITION BY doc_id ORDER BY place)
), f AS (
  SELECT doc_id, list_sort(list(DISTINCT shingle)) AS shingles FROM g WHERE place <= greatest(1, n - 4) GROUP BY doc_id
), s AS (
  SELECT doc_id, text, shingles FROM f JOIN documents USING (doc_id)
), c AS (
  SELECT min(doc_id) AS cid, shingles, count(*) AS n_copies, count(DISTINCT text) AS n_texts FROM s GROUP BY shingles
), e AS (
  SELECT cid, len(shingles) AS size, unnest(shingles) AS shingle FROM c
), i AS (
  SELECT cid, size, shingle FROM e WHERE shingle IN (SELECT shingle FROM e GROUP BY shingle HAVING count(*) > 1)
), p AS (
  SELECT a.cid AS u, b.cid AS v FROM i a JOIN i b ON a.shingle = b.shingle AND a.cid <> b.cid GROUP BY a.cid, b.cid, a.size, b.size HAVING 9 * count(*) >= 4 * (a.size + b.size)
), r AS (
  SELECT cid AS u, cid AS v FROM c UNION SELECT r.u, p.v FROM r JOIN p ON r.v = p.u
), k AS (
  SELECT u AS cid, min(v) AS class_id FROM r GROUP BY u
), l AS (
  SELECT p.u AS cid, sum(c.n_texts) AS links FROM p JOIN c ON c.cid = p.v GROUP BY p.u
)
SELECT d.doc_id, coalesce(k.class_id, d.doc_id) AS class_id, CAST(coalesce(l.links, 0) + coalesce(c.n_texts, 1) - 1 AS BIGINT) AS n_links, CAST(coalesce(c.n_copies, 1) AS BIGINT) AS n_copies
FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id LEFT JOIN c ON c.shingles = s.shingles LEFT JOIN k ON k.cid = c.cid LEFT JOIN l ON l.cid = c.cid
"""
