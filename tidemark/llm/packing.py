"""Best-fit-decreasing packing of token sequences.

A text's ids are followed by one separator.  A document is first cut into full
windows, which are sequences of their own; what is left of it is a piece shorter than
a window.  Each task packs its own documents, ``GROUP`` pieces at a time: from the
longest to the shortest, each into the open window with the least room that still
fits, found in a segment tree indexed by remaining capacity.  So no text or id is
moved, nothing hangs on how often a row or an id repeats, and a task holds the pieces
of one group.

What a group leaves in windows that are not full enough goes into a second round,
dealt by the window it lay in over groups of the same size.  That round sees a few
hundredths of the pieces, or all of them where the table lies in many tiny partitions,
and its own last windows are all that is padded for good.

Pre-tokens are encoded once and remembered: the text is split by the byte-level
tokenizer's own pattern, and each distinct pre-token goes to the tokenizer alone,
in batches.  A text with a character outside the plain scripts, where Python's
classes could differ from the tokenizer's, goes to the tokenizer whole.

Defined cases: a null or empty text is the separator alone; a null id packs like
any other; rows that repeat are packed once each; an empty table gives no rows; ties
go by id, start, then checksum; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_schema, bounded, durable, struct_of, texts_of

WINDOW = 1024
SEPARATOR = 0
GROUP = 2_000
#: A window that is filled less goes into the second round.
FULL_ENOUGH = 0.98
TOKENIZER = "byte_bpe_50k.json"
#: Room for so many sequences in a task of the first round or a group of the second.
SPAN = 1 << 34
#: Sequences of the second round begin here.
SECOND = 1 << 60
#: Pre-tokens that a worker remembers, about 200 bytes each; then it starts anew.
MEMO = 600_000

# The byte-level pre-tokenizer's pattern, for texts of the characters below.
PIECES = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ʯ]+| ?[0-9]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^\sA-Za-z0-9À-ÖØ-öø-ʯ]+|\s+(?!\S)|\s+")
#: Characters whose letter, digit and space classes agree between Python and the tokenizer.
UNUSUAL = re.compile("[^\t\n\r -~¡-¨«-±´¶-¸»¿-ʯ]")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of whole texts as little-endian 32-bit bytes."""

    def __init__(self, path: str, remember: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        vocabulary = self._tokenizer.get_vocab()
        # a byte-level token is written with one character for each of its bytes
        self._bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self._bytes[list(vocabulary.values())] = [len(t) for t in vocabulary]
        special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._special = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        self._known: dict[str, bytes] = {}
        self._remember = remember

    def whole(self, texts: list[str]) -> list[bytes]:
        """Straight from the tokenizer."""
        return [np.array(e.ids, "<u4").tobytes() for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        """Words that start with a space keep their bounds when they are joined, and take one call."""
        joined, rest = [], []
        for w in words:  # a piece that goes on with a letter is a run of letters
            (joined if w[0] == " " and w[1:2].isalpha() else rest).append(w)
        if joined:
            text = "".join(joined)
            ids = np.array(self._tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            lengths = map(len, joined) if text.isascii() else (len(w) if w.isascii() else len(w.encode()) for w in joined)
            ends = np.searchsorted(np.cumsum(self._bytes[ids]), np.cumsum(np.fromiter(lengths, np.int64, len(joined)))) + 1
            data, at = ids.tobytes(), 0
            for w, end in zip(joined, (4 * ends).tolist(), strict=True):
                self._known[w] = data[at:end]
                at = end
        self._known.update(zip(rest, self.whole(rest), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        split: list[list[str] | None] = []
        for text in texts:
            split.append(None if UNUSUAL.search(text) or self._special.search(text) else PIECES.findall(text))
        if len(self._known) > self._remember:
            self._known.clear()
        known = self._known
        self._learn(list(set().union(*(words for words in split if words)).difference(known)))
        rest = iter(self.whole([t for t, words in zip(texts, split, strict=True) if words is None]))
        return [next(rest) if words is None else b"".join(map(known.__getitem__, words)) for words in split]


@functools.lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    """One encoder for each Python worker, so that its later tasks know the words of earlier ones."""
    return Encoder(path)


class RoomTree:
    """A segment tree over remaining capacities: finds the least one that fits."""

    def __init__(self, capacity: int):
        self._size = 1 << capacity.bit_length()
        self._count = [0] * (2 * self._size)
        self._windows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, window: int) -> None:
        self._windows[room].append(window)
        i = room + self._size
        while i:
            self._count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, window) of the tightest open window with at least ``need`` room."""
        i = need + self._size
        if i >= 2 * self._size:
            return None
        if not self._count[i]:
            while i > 1 and (i & 1 or not self._count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self._size:
                i = 2 * i if self._count[2 * i] else 2 * i + 1
        room = i - self._size
        window = self._windows[room].pop()
        while i:
            self._count[i] -= 1
            i >>= 1
        return room, window


def best_fit_decreasing(lengths: list[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """(window number, offset) of each piece; the lengths must not grow."""
    tree, placed, opened = RoomTree(window), [], 0
    for n in lengths:
        found = tree.take(n)
        if found is None:
            room, number, opened = window, opened, opened + 1
        else:
            room, number = found
        placed.append((number, window - room))
        if room > n:
            tree.add(room - n, number)
    return placed


PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
Piece = tuple  # doc_id, start, length, ids_crc32, doc_tokens, and the ids where they are wanted


def _longest_first(piece: Piece) -> tuple:
    return -piece[2], piece[0] is not None, piece[0] or 0, piece[1], piece[3], piece[4]


def _placed(pieces: list[Piece], first: int, window: int) -> tuple[list[tuple[Piece, int, int]], int]:
    """(piece, sequence, offset) of one group's pieces, sequences from ``first`` on; and the next one."""
    ordered = sorted(pieces, key=_longest_first)
    spots = best_fit_decreasing([p[2] for p in ordered], window)
    return [(p, first + w, o) for p, (w, o) in zip(ordered, spots, strict=True)], first + 1 + max((w for w, _ in spots), default=-1)


def _batch(rows: list[tuple[Piece, int, int]], schema: pa.Schema) -> pa.RecordBatch:
    flat = [(*p[:5], w, o, *p[5:]) for p, w, o in rows]
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*flat, strict=True), schema, strict=True)], schema=schema)


def pack(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, path: str | None = None, with_ids: bool = False, group: int = GROUP) -> DataFrame:
    """A row for each piece with its sequence and offset; every id lies in exactly one piece.

    ``with_ids`` keeps the ids themselves.
    """
    result = struct_of(PACKED + (", ids binary" if with_ids else ""))
    schema = arrow_schema(result)
    columns = [n for n in schema.names if n not in ("sequence_id", "offset")]
    stop = np.array([SEPARATOR], "<u4").tobytes()

    def first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces in full windows, and in windows that are full enough; the others' offset is -1."""
        encoder, free = encoder_of(path or tokenizer_path()), TaskContext.get().partitionId() * SPAN
        out: list[tuple[Piece, int, int]] = []
        rests: list[Piece] = []

        def close() -> None:
            nonlocal free
            placed, free = _placed(rests, free, window)
            filled: Counter = Counter()
            for p, w, _ in placed:
                filled[w] += p[2]
            out.extend((p, w, o if filled[w] >= FULL_ENOUGH * window else -1) for p, w, o in placed)
            rests.clear()

        for batch in bounded(batches, "text"):
            docs, texts = batch.column("doc_id").to_pylist(), texts_of(batch, "text")
            for at in range(0, len(texts), 256):
                for doc, ids in zip(docs[at : at + 256], encoder.encode(texts[at : at + 256]), strict=True):
                    ids += stop
                    n = len(ids) // 4
                    for start in range(0, n, window):
                        part = ids[4 * start : 4 * (start + window)]
                        piece = (doc, start, len(part) // 4, zlib.crc32(part), n, *([part] if with_ids else []))
                        if piece[2] == window:
                            out.append((piece, free, 0))
                            free += 1
                        else:
                            rests.append(piece)
                            if len(rests) >= group:
                                close()
                    if len(out) >= 4 * group:
                        yield _batch(out, schema)
                        out = []
        close()
        if out:
            yield _batch(out, schema)

    def second_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("grp", *columns)), strict=True))
        for grp, run in groupby(rows, lambda r: r[0]):
            placed, _ = _placed([r[1:] for r in run], SECOND + grp * SPAN, window)
            yield _batch(placed, schema)

    cut = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(first_round, result)
    placed = durable(cut)
    left = placed.where("offset < 0")
    groups = max(1, -(-left.count() // group))
    dealt = left.withColumn("grp", F.pmod(F.xxhash64("sequence_id"), F.lit(groups))).select("grp", *columns).repartition(F.col("grp")).sortWithinPartitions("grp")
    return placed.where("offset >= 0").unionByName(dealt.mapInArrow(second_round, result))
