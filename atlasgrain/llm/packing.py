"""Best-fit packing by minimum bin slack.

Pieces of one length are alike, so the packing is found on the histogram of lengths, which has at most ``capacity``
entries whatever the corpus holds. For one bin after another: the longest length left is taken, then a subset-sum over
the lengths left, with bit sets, finds the fullest combination for the rest of the bin. That combination is repeated
for as many bins as the counts allow, so there are a few thousand combinations at most, and they go to the executors.
Pieces get a rank within their length (salted, so that a hot length is not one task's work) and from it their place.

Defined results: null text is empty text, one piece of the end id alone; repeated rows are packed as often as they come;
a null doc_id is kept as it is; an empty table gives an empty result; other columns play no part. A text is tokenised
whole, whatever its length.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import read, spill

CAPACITY = 1024
END_ID = 2
#: How byte-level BPE splits a text before merging.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _ranks(spec: dict) -> dict[bytes, int] | None:
    """Ranks by token, where a tokenizer file is a plain byte-level BPE whose ids rise along its merges; else None."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    usual = {"dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False}
    if model.get("type") != "BPE" or spec.get("normalizer") or any((model.get(k) or v) != v for k, v in usual.items()):
        return None
    if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        return None
    if (spec.get("post_processor") or {"type": "ByteLevel"})["type"] != "ByteLevel":
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    vocab, added = model["vocab"], {t["content"] for t in spec.get("added_tokens", [])}
    merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    single = [vocab.get(c) for c in byte_of]
    names = {t: i for t, i in vocab.items() if t not in added}
    if None in single or merged != sorted(set(merged)) or max(single) >= merged[0] or set(names.values()) != {*single, *merged}:
        return None
    return {bytes(byte_of[c] for c in t): i for t, i in names.items()}


class Encoder:
    """Token ids of texts as little-endian uint32 bytes: those of the tokenizer file, add_special_tokens=False.

    A plain byte-level BPE is run by the faster of the two installed engines, which gives the same ids; a text that
    holds one of the file's added tokens, and any other kind of file, goes to the ``tokenizers`` library as a whole.
    With ``special_as_text`` the strings of special tokens are ordinary text.
    """

    def __init__(self, tokenizer_json: str, special_as_text: bool = False) -> None:
        from tokenizers import Tokenizer

        spec = json.loads(tokenizer_json)
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.encode_special_tokens = special_as_text
        added = [t["content"] for t in spec.get("added_tokens", []) if not (special_as_text and t["special"])]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.fast = None
        if (ranks := _ranks(spec)) is not None:
            import tiktoken

            self.fast = tiktoken.Encoding("file", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __call__(self, text: str) -> bytes:
        if self.fast and not (self.added and self.added.search(text)):
            return np.array(self.fast(text), dtype="<u4").tobytes()
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole if it fits; else full pieces, of which the first may be shorter."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of each row's text (columns as in ``PIECES``); ``tokenizer`` is the path of a tokenizer file."""
    with open(tokenizer or default_tokenizer(), encoding="utf-8") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(content.value)
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = encode(text or "") + end
                rows += [(doc, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(cut(len(ids) // 4, capacity))]
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def _fullest(counts: list[int], room: int) -> list[int]:
    """Lengths (longest first) whose sum comes nearest to ``room``, using each no more often than counted."""
    steps, reach, mask = [], 1, (1 << (room + 1)) - 1
    for length in range(min(room, len(counts) - 1), 0, -1):
        left = min(counts[length], room // length)
        if not left:
            continue
        steps.append((length, left, reach))
        part = 1
        while left:  # binary splitting: multiples 1, 2, 4, ... and the rest
            k = min(part, left)
            reach |= (reach << (k * length)) & mask
            left -= k
            part *= 2
        if reach >> room & 1:
            break
    total, out = reach.bit_length() - 1, []
    for length, left, before in reversed(steps):
        k = next(k for k in range(left + 1) if total >= k * length and before >> (total - k * length) & 1)
        out += [length] * k
        total -= k * length
    return out[::-1]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(number of bins, lengths in each) for all pieces counted in ``histogram``."""
    counts = [0] * (capacity + 1)
    for length, n in histogram.items():
        counts[length] = n
    out, top = [], capacity
    while True:
        while top and not counts[top]:
            top -= 1
        if not top:
            return out
        counts[top] -= 1
        chosen = [top, *_fullest(counts, capacity - top)]
        counts[top] += 1
        need = {x: chosen.count(x) for x in set(chosen)}
        times = min(counts[x] // n for x, n in need.items())
        for x, n in need.items():
            counts[x] -= times * n
        out.append((times, chosen))


def _places(bins: list[tuple[int, list[int]]], capacity: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: first rank of each run of pieces, with the run's first sequence and its offset."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used, sequence = [0] * (capacity + 1), 0
    for times, chosen in bins:
        offset = 0
        for length in chosen:
            runs.setdefault(length, []).append((used[length], sequence, offset))
            used[length] += times
            offset += length
        sequence += times
    return {length: tuple(np.array(c, dtype=np.int64) for c in zip(*r, strict=True)) for length, r in runs.items()}


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``pieces`` with sequence_id and offset."""
    cut_up = spill(pieces(docs, tokenizer, capacity, end_id), "pieces")
    histogram = {int(r[0]): int(r[1]) for r in cut_up.groupBy("length").count().collect()}  # at most `capacity` rows
    places = _places(plan(histogram, capacity), capacity)
    salts = max(64, sum(histogram.values()) // 1_000_000)
    salted = cut_up.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    sizes = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    firsts = sizes.select("length", "salt", F.coalesce(before, F.lit(0)).alias("first"))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start")) - 1)
    ranked = ranked.join(firsts, ["length", "salt"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("first")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            sequence, offset = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
            for x in np.unique(length).tolist():
                at = np.flatnonzero(length == x)
                first, s, o = places[x]
                k = np.searchsorted(first, rank[at], side="right") - 1
                sequence[at], offset[at] = s[k] + rank[at] - first[k], o[k]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, PIECES + ", sequence_id long, offset long")


def op4_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents", "doc_id", "text"))
