"""Benchmark passages in documents by Wu-Manber multi-pattern search.

Words are the symbols: ASCII letters are lower-cased, and words are runs of digits,
letters and non-ASCII characters.  A pattern is a window of ``WINDOW`` consecutive
words of a benchmark text, or all words of a shorter one.  For the patterns of one
length m, the shift table, indexed by a hash of a block of two words (one for m = 1),
holds how far the search may jump; where it may not, the patterns whose last block and
first block are those of the text are found by binary search in an array sorted by
both, and direct comparison of all words confirms an occurrence.

The benchmark is read as a stream and cut into slices of at most ``MAX_PATTERNS``
windows.  A slice's tables are arrays in a file that executors fetch and workers map,
so nothing is built in a task and no slice has to fit a worker's own memory.  Each text
is searched for one slice after another, in one pass and without a shuffle.

Defined cases: null and empty texts have no words; benchmark texts without words
and null ones have no window; an item id of null is left out; a window that several
items share counts for each; documents that repeat are searched alike; other columns,
whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_schema, bounded, struct_of, texts_of
from tidemark.llm.mapped import DigestArray, mapped, share

#: Over UTF-8 bytes: digits, lower-case letters, and every byte of a non-ASCII character.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
WINDOW = 10
MAX_PATTERNS = 1_000_000
#: The shift table's size is a power of two, at most this one.
SHIFT_BITS = 24
#: Places that are looked up at a time, and words of all slices that a worker holds itself.
AT_ONCE, WORDS = 20_000, 200_000
_TIMES = 0x9E3779B1
_LEAST_BITS = 10


def words_of(text: str) -> list[bytes]:
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower())


def _ends_key(last: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One key of a pattern's last and first block."""
    x = (last * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (first + np.uint64(0x165667B19E3779F9))
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)


def _block(windows: np.ndarray, end: int, width: int) -> np.ndarray:
    """The block of ``width`` words before ``end`` in each window, as one number."""
    last = windows[:, end - 1].astype(np.uint64)
    return last if width == 1 else windows[:, end - 2].astype(np.uint64) << np.uint64(32) | last


def build(benchmark: Iterable[tuple[str, str]], window: int = WINDOW) -> dict[str, np.ndarray]:
    """The tables of some items, as arrays.

    ``words``: the items' words, whose value is their number (0 is any unknown word);
    ``names``: the items; for each length m, ``windows`` sorted by their key, with the
    number of the ``items`` they come from, and ``shift``.
    """
    numbers: dict[bytes, int] = {}
    names: list[bytes] = []
    found: dict[int, list[tuple[np.ndarray, int]]] = defaultdict(list)
    for item, text in benchmark:
        ids = np.array([numbers.setdefault(w, len(numbers) + 1) for w in words_of(text)], np.uint32)
        if len(ids):
            n = min(window, len(ids))
            found[n].append((np.unique(np.lib.stride_tricks.sliding_window_view(ids, n), axis=0), len(names)))
            names.append(item.encode("utf-8", "surrogatepass"))
    out = {f"words.{k}": v for k, v in DigestArray.arrays(numbers.items()).items()}
    out |= {"names.ends": np.cumsum([0, *map(len, names)], dtype=np.int64), "names.blob": np.frombuffer(b"".join(names), np.uint8), "lengths": np.array(sorted(found), np.int32)}
    for m, parts in found.items():
        windows = np.concatenate([w for w, _ in parts])
        items = np.repeat(np.array([i for _, i in parts], np.int32), [len(w) for w, _ in parts])
        width = min(2, m)
        keys = _ends_key(_block(windows, m, width), _block(windows, width, width))
        order = np.argsort(keys, kind="stable")
        far = m - width + 1
        bits = min(SHIFT_BITS, max(_LEAST_BITS, int(16 * far * len(windows)).bit_length()))
        shift = np.full(1 << bits, far, np.uint8 if far < 256 else np.uint32)
        for end in range(width, m + 1):
            block = _block(windows, end, width)
            np.minimum.at(shift, (((block >> np.uint64(32)) * np.uint64(_TIMES)) ^ (block & np.uint64(0xFFFFFFFF))) & np.uint64((1 << bits) - 1), shift.dtype.type(m - end))
        out |= {f"{m}.keys": keys[order], f"{m}.windows": windows[order].reshape(-1), f"{m}.items": items[order], f"{m}.shift": shift}
    return out


class WuManber:
    """The patterns of one length over sequences of word numbers."""

    def __init__(self, arrays: dict[str, np.ndarray], length: int):
        self.length = length
        self.keys, self.items = arrays[f"{length}.keys"], arrays[f"{length}.items"]
        self.windows = arrays[f"{length}.windows"].reshape(-1, length)
        self.shift = memoryview(arrays[f"{length}.shift"])

    def ends(self, ids: list[int]) -> list[int]:
        """Where a pattern can end, by the shift table."""
        m, n, shift, mask, out = self.length, len(ids), self.shift, len(self.shift) - 1, []
        if m == 1:
            return [i for i, x in enumerate(ids, 1) if x and not shift[x & mask]]
        end = m
        while end <= n:
            last = ids[end - 1]
            if not last:  # an unknown word: no pattern covers it
                end += m
                continue
            jump = shift[((ids[end - 2] * _TIMES) ^ last) & mask]
            if jump:
                end += jump
                continue
            out.append(end)
            end += 1
        return out

    def search(self, ids: list[int]) -> Iterator[tuple[int, np.ndarray]]:
        """(start, numbers of the items) of each occurrence."""
        ends, m, width = self.ends(ids), self.length, min(2, self.length)
        for at in range(0, len(ends), AT_ONCE):
            starts = [e - m for e in ends[at : at + AT_ONCE]]
            here = np.array([ids[i : i + m] for i in starts], np.uint32)
            keys = _ends_key(_block(here, m, width), _block(here, width, width))
            low = np.searchsorted(self.keys, keys)
            for i in np.flatnonzero(self.keys[np.minimum(low, len(self.keys) - 1)] == keys).tolist():
                high = int(np.searchsorted(self.keys, keys[i], "right"))
                same = (self.windows[low[i] : high] == here[i]).all(1)
                if same.any():
                    yield starts[i], self.items[low[i] : high][same]


class Patterns:
    """A slice's tables, ready to search texts."""

    def __init__(self, arrays: dict[str, np.ndarray], held: int = WORDS):
        self._words = DigestArray({k: arrays[f"words.{k}"] for k in ("keys", "ends", "blob", "values")})
        self._held = {self._words.string(i): n for i, n in enumerate(self._words.values.tolist())} if len(self._words.keys) <= held else None
        self._ends, self._blob = arrays["names.ends"], arrays["names.blob"]
        self.searches = [WuManber(arrays, m) for m in arrays["lengths"].tolist()]

    def numbers(self, words: list[bytes]) -> list[int]:
        """The words' numbers; 0 is any unknown word.  Those of a long benchmark are looked up in the mapped array."""
        if self._held is not None:
            return list(map(self._held.get, words, repeat(0)))
        own = list(set(words))
        found = dict(zip(own, self._words.find(own), strict=True))
        return [max(0, found[w]) for w in words]

    def name(self, i: int) -> str:
        return self._blob[self._ends[i] : self._ends[i + 1]].tobytes().decode("utf-8", "surrogatepass")

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """(spans of hit words, items with occurring windows) of a whole text's words."""
        ids = self.numbers(words)
        spans, items = [], set()
        for search in self.searches if any(ids) else ():
            for start, found in search.search(ids):
                spans.append((start, start + search.length))
                items.update(found.tolist())
        return spans, set(map(self.name, items))


def find_in(text: str, slices: list[Patterns]) -> tuple[int, list[tuple[int, int]], set[str]]:
    """(words, spans of hit words, items with occurring windows) of a whole text over all slices."""
    words = words_of(text)
    found = [x.find(words) for x in slices] if words else []
    return len(words), merge(list(chain.from_iterable(x for x, _ in found))), set().union(*(x for _, x in found))


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def read_benchmark(benchmark: DataFrame, *, item_col: str = "item_id", text_col: str = "text") -> Iterator[tuple[str, str]]:
    """Its items, a partition at a time."""
    rows = benchmark.where(F.col(item_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t"))
    return ((r["i"], r["t"]) for r in rows.toLocalIterator())


def slices_of(benchmark: Iterable[tuple[str, str]], most: int = MAX_PATTERNS) -> Iterator[list[tuple[str, str]]]:
    """Items in slices of at most ``most`` windows, an item at least; one slice is held at a time."""
    part, room = [], most
    for item, text in benchmark:
        n = len(text) // 2 + 1  # no text has more windows
        if n > room and part:
            yield part
            part, room = [], most
        part.append((item, text))
        room -= n
    if part:
        yield part


def tables(benchmark: DataFrame, *, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW, most: int = MAX_PATTERNS) -> list[str]:
    """The benchmark's slices as shared files, by name."""
    return [share(benchmark.sparkSession, build(part, window)) for part in slices_of(read_benchmark(benchmark, item_col=item_col, text_col=text_col), most)]


def opened_slices(names: list[str]) -> list[Patterns]:
    return [Patterns(mapped(n), WORDS // len(names)) for n in names]


FOUND = struct_of("doc_id long, n_words long, hit_from long[], hit_to long[], items string[]")


def find(documents: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, most: int = MAX_PATTERNS) -> DataFrame:
    """``(doc_id, n_words, hit_from, hit_to, items)``: hit words as spans, and the items found."""
    names = tables(benchmark, item_col=item_col, text_col=item_text_col, window=window, most=most)
    schema = arrow_schema(FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = opened_slices(names)
        for batch in bounded(batches, "text"):
            found = [find_in(t, slices) for t in texts_of(batch, "text")]
            columns = [[n for n, *_ in found], [[a for a, _ in x] for _, x, _ in found], [[b for _, b in x] for _, x, _ in found], [sorted(x) for *_, x in found]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, f.type) for x, f in zip(columns, list(schema)[1:], strict=True))], schema=schema)

    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, FOUND)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from ``find``'s rows."""
    hits = F.aggregate(F.zip_with("hit_to", "hit_from", lambda b, a: b - a), F.lit(0).cast("long"), lambda x, y: x + y)
    return found.select("doc_id", "n_words", hits.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("hit_from") > 0).alias("contaminated"))


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, most: int = MAX_PATTERNS) -> DataFrame:
    """The rows, with all their columns, that hold no window of the benchmark; no shuffle."""
    names = tables(benchmark, item_col=item_col, text_col=item_text_col, window=window, most=most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = opened_slices(names)
        for batch in bounded(batches, text_col):
            yield batch.filter(pa.array([not find_in(t, slices)[1] for t in texts_of(batch, text_col)], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)


def brute_force(text: str, benchmark: list[tuple[str, str]], window: int = WINDOW) -> tuple[int, int, list[str], str]:
    """The definition, word by word; for tests."""
    words, hit, items = words_of(text), set(), set()
    for item, other in benchmark:
        w = words_of(other)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            for j in range(len(words) - n + 1):
                if words[j : j + n] == w[i : i + n]:
                    hit |= set(range(j, j + n))
                    items.add(item)
    names = sorted(items)
    return len(words), len(hit), names, hashlib.sha256(",".join(names).encode()).hexdigest()


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL
), bi AS (
  SELECT item, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0
), bw AS (
  SELECT DISTINCT item, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM bi
), ks AS (
  SELECT DISTINCT k FROM bw
), di AS (
  SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k
), dw AS (
  SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM di
), hits AS (
  SELECT doc_id, i, dw.k AS k, item FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
