"""Read-only tables of bounded size, in a file that every executor fetches once and every worker maps.

The driver writes the file into the shared folder through Spark's file system, and
Spark hands it to the executors like any other file of the application.  Workers map
it, so its pages are shared by all workers of a machine and count for none of them.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterable

import numpy as np
import xxhash
from pyspark import SparkFiles
from pyspark.sql import SparkSession

from tidemark.llm.common import shared_folder

ALIGN = 64
PART = 4 << 20


def packed(arrays: dict[str, np.ndarray]) -> bytes:
    """One-dimensional arrays as one file: the length of a head, the head, and the arrays, aligned."""
    at, head, parts = 0, {}, []
    for name, array in arrays.items():
        data = np.ascontiguousarray(array).tobytes()
        head[name] = (array.dtype.str, at, len(array))
        parts.append(data + b"\x00" * (-len(data) % ALIGN))
        at += len(parts[-1])
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % ALIGN)
    return b"".join([len(text).to_bytes(8, "little"), text, *parts])


def opened(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped."""
    whole = np.memmap(path, np.uint8, "r")
    start = 8 + int.from_bytes(whole[:8].tobytes(), "little")
    head = json.loads(whole[8:start].tobytes())
    return {name: whole[start + at : start + at + n * np.dtype(kind).itemsize].view(kind) for name, (kind, at, n) in head.items()}


def share(spark: SparkSession, arrays: dict[str, np.ndarray]) -> str:
    """Hand arrays to all executors; returns the name that ``mapped`` takes."""
    data = packed(arrays)
    name = f"tables-{xxhash.xxh3_128_hexdigest(data)}"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{name}")
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path):
        out = system.create(path, True)
        for at in range(0, len(data), PART):
            out.write(data[at : at + PART])
        out.close()
    spark.sparkContext.addFile(system.makeQualified(path).toString())
    return name


@functools.lru_cache(maxsize=64)
def mapped(name: str) -> dict[str, np.ndarray]:
    """The arrays, mapped once by each worker."""
    return opened(SparkFiles.get(name))


class DigestArray:
    """Sorted 64-bit digests of strings, with the full strings and a value behind them.

    All of it are arrays, so that they can lie in a mapped file; strings that differ
    may share a digest.
    """

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.keys, self.ends, self.blob, self.values = (arrays[x] for x in ("keys", "ends", "blob", "values"))

    @staticmethod
    def arrays(entries: Iterable[tuple[bytes, int]]) -> dict[str, np.ndarray]:
        """``entries``: (string, value); of equal strings the last counts."""
        keyed = sorted((xxhash.xxh3_64_intdigest(s), s, v) for s, v in dict(entries).items())
        return {
            "keys": np.array([k for k, *_ in keyed], np.uint64),
            "ends": np.cumsum([0, *(len(s) for _, s, _ in keyed)], dtype=np.int64),
            "blob": np.frombuffer(b"".join(s for _, s, _ in keyed), np.uint8),
            "values": np.array([v for *_, v in keyed], np.int32),
        }

    def string(self, i: int) -> bytes:
        return self.blob[self.ends[i] : self.ends[i + 1]].tobytes()

    def find(self, probes: list[bytes]) -> list[int]:
        """The value of each probe that is one of the strings, else -1."""
        out = [-1] * len(probes)
        if not probes or not len(self.keys):
            return out
        keys = np.array(list(map(xxhash.xxh3_64_intdigest, probes)), np.uint64)
        at = np.searchsorted(self.keys, keys)
        near = np.minimum(at, len(self.keys) - 1)
        for i in np.flatnonzero(self.keys[near] == keys).tolist():
            j = int(at[i])
            while j < len(self.keys) and self.keys[j] == keys[i]:
                if self.string(j) == probes[i]:
                    out[i] = int(self.values[j])
                    break
                j += 1
        return out
