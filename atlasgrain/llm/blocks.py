"""Key exchange between blocks of documents.

Statistics on n-grams need every n-gram of the corpus to meet its equals. Rather than one row for each n-gram, a block
(some 12 MB of text) sends one packed column of its distinct keys to each of many buckets, and gets back one packed
column of answers in the same order. A frequent key is one entry a block, so no bucket is hot; buckets follow the size
of the corpus, so each stays some MB. A key is 64 bits in a bucket chosen by other, independent bits, so the chance that
two different n-grams are taken for one stays below 1e-12 for each key, whatever the size of the corpus. Blocks and buckets
are sized by the memory of a core (``block_bytes``): at 16 GB a core a corpus of 100 TB has some 700,000 of each, so rows
hold some tens of keys.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import SparkSession

BLOCK_BYTES = 12_000_000
BUCKET_BYTES = 12_000_000


def squeeze(a: np.ndarray) -> bytes:
    """An integer array as zstd of its byte planes."""
    a = np.ascontiguousarray(a)
    head = f"{a.dtype.str}:{len(a)}:".encode()
    return head + zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes())


def unsqueeze(data: bytes) -> np.ndarray:
    kind, n, rest = bytes(data).split(b":", 2)
    dtype = np.dtype(kind.decode())
    raw = zstandard.ZstdDecompressor().decompress(rest, max_output_size=max(1, int(n) * dtype.itemsize))
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(dtype.itemsize, int(n)).T).view(dtype).reshape(-1)


def squeeze_sorted(keys: np.ndarray) -> bytes:
    return squeeze(np.diff(keys, prepend=np.uint64(0)))


def unsqueeze_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(data), dtype=np.uint64)


def small(a: np.ndarray) -> np.ndarray:
    """Counts in the narrowest unsigned type."""
    return a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0))


def gather(batches: Iterator[pa.RecordBatch], kind: Callable[[int | None], int] = lambda doc: 0, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, list, list[bytes]]]:
    """(block, kind, doc_ids, texts) of some ``most`` bytes of text; documents of one kind only. Null text is empty.

    Block numbers are unique in a finished job: of several attempts at a task only one is kept.
    """
    held: dict[int, tuple[list, list[bytes]]] = defaultdict(lambda: ([], []))
    sizes: dict[int, int] = defaultdict(int)
    numbers = count((TaskContext.get().partitionId() if TaskContext.get() else 0) << 32)
    for b in batches:
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
            k = kind(doc)
            held[k][0].append(doc), held[k][1].append(text or b"")
            sizes[k] += len(text or b"") + 64
            if sizes[k] >= most:
                yield next(numbers), k, *held.pop(k)
                del sizes[k]
    for k, (ids, texts) in held.items():
        yield next(numbers), k, ids, texts


def local_ids(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Numbers of all words, one after another, the number of words by text, and the distinct words."""
    numbers: dict[bytes, int] = defaultdict(count().__next__)
    n = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    ids = np.fromiter(map(numbers.__getitem__, chain.from_iterable(texts)), dtype=np.int32, count=int(n.sum()))
    return ids, n, list(numbers)


def word_hashes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each word."""
    return tuple(np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), dtype=np.uint64, count=len(words)) for seed in (0, 1))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def by_bucket(keys: np.ndarray, other: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys by (bucket, key), and where each bucket begins in it; buckets come from the other hash."""
    bucket = (mixed(other) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((keys, bucket))
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def bucket_count(text_bytes: int, size: int = 0) -> int:
    return max(1, -(-text_bytes // max(size, BUCKET_BYTES)))


_UNITS = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}


def block_bytes(spark: SparkSession, least: int) -> int:
    """Bytes of text in a block: ``least``, or more where the executors' settings say that a core has more memory.

    Blocks need some 70 bytes of arrays for each byte of text. The number of rows that blocks exchange is about that of
    blocks times that of buckets, so with the corpus it falls with the square of the block size.
    """
    conf = spark.sparkContext.getConf()
    memory, cores = conf.get("spark.executor.memory", ""), conf.get("spark.executor.cores", "")
    if not (m := re.fullmatch(r"(\d+)([kmgt])b?", memory.lower())) or not cores.isdigit():
        return least
    return max(least, int(m[1]) * _UNITS[m[2]] // int(cores) // 120)
