"""Benchmark decontamination by latent semantic retrieval.

Terms are the lower-cased words of the benchmark. The documents are read once for each block of items and written as
numbers of terms, all words of all documents in order; what follows reads those. Document frequencies are counted over
the whole corpus. A randomised
SVD of the TF-IDF passages (``WIDTH`` words, one after another) of all documents, with the items themselves as rows,
gives ``RANK`` latent directions: each pass sums A'(A Q) by blocks of terms across the partitions, and only terms x rank
numbers reach the driver. Then every passage of every document (these overlap by half) is projected and compared with every
item; a pair with a cosine of ``LEAST_COSINE`` or more, in which the passage holds ``LEAST_WEIGHT`` or more of the
item's weight (both from the one latent product), is a candidate, with no cap. Passages whose terms are too light to add
up to that weight, whatever their directions, are not projected, which misses nothing. Terms in over ``COMMON_SHARE`` of the
documents have no weight there, so an item that has over ``MOST_COMMON`` of its squared weight on such terms (it leaks
into many documents, or the table is small) is searched without vectors: every stretch of one and a half times its
length that holds ``LEAST_COMMON`` of its words is a candidate, which misses nothing.

A candidate counts if the longest common subsequence with a stretch of at most one and a half times the item's length
holds ``LEAST_COMMON`` of the item's words, and if the item's answer, or else its rarest words, are there too.

The items are the queries, those of over ``WIDTH`` words also in pieces of at most that length, since a passage cannot
hold much of a long item's weight. They are taken in blocks of some ``ITEM_BLOCK`` queries, so what is broadcast is
bounded for a benchmark of any size. Documents never move between partitions.

Defined results: null or empty text matches nothing; an item of under ``LEAST_WORDS`` words is found where it is a whole
line (all words, in order), a null or wordless one nowhere; of equal stretches the first is reported; two
rows with one doc_id both match under it; a null doc_id is reported as null; an empty table of either kind gives an
empty result; other columns play no part. Texts are read whole, whatever their length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import gather, mixed, small, squeeze, unsqueeze
from .common import fresh, read, spill

WIDTH, RANK, EXTRA = 48, 256, 16
LEAST_COSINE, LEAST_WEIGHT, LEAST_COMMON, SURE_COMMON, LEAST_WORDS = 0.25, 0.35, 0.65, 0.85, 5
#: Terms in more than this share of the documents have no weight; items with more than MOST_COMMON on them go by words.
COMMON_SHARE, MOST_COMMON = 0.05, 0.25
ITEM_BLOCK, TERM_BLOCK = 5_000, 2_048
#: Words of passages that the fit looks at together, rows of a run that are added in turn, partial sums that one task adds up.
ENTRIES, RUN, FAN_IN = 16_384, 32, 32
#: Bytes of text that are looked at together.
BLOCK = 3_000_000
_MARKS = ".,;:!?\"'()[]{}|*#$%&<>«»¿¡…-"


def plain(word: bytes) -> str:
    return word.decode("utf-8", "replace").lower().strip(_MARKS)


def item_words(text: str | None) -> list[str]:
    return [w for w in map(plain, (text or "").encode().split()) if w]


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: The marks as bytes: those of one byte as a table, the others as they are.
_MARK = np.zeros(256, dtype=bool)
_MARK[[ord(c) for c in _MARKS if ord(c) < 128]] = True
_WIDE_MARKS = [c.encode() for c in _MARKS if ord(c) >= 128]
#: A word's hash: a polynomial in an odd number over random values of its bytes, mod 2^64, mixed.
_VALUE = np.random.default_rng(17).integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Terms:
    """Numbers of the benchmark's words. Words of documents are told by 64-bit hashes, all of a block at once in numpy."""

    def __init__(self, items: list[list[str]]) -> None:
        self.number = {t: k for k, t in enumerate(sorted({w for x in items for w in x}))}
        self.most = 0
        data = b" ".join(t.encode() for t in self.number)
        starts, ends = self._bounds(np.frombuffer(data, dtype=np.uint8))
        hashes = self._hashes(np.frombuffer(data, dtype=np.uint8), starts, ends)
        self.order = np.argsort(hashes)
        self.keys = hashes[self.order]
        self._index()

    def _index(self) -> None:
        bits = min(22, max(8, len(self.keys).bit_length() + 5))
        self.shift, self.most = np.uint64(64 - bits), 0
        self.slots = np.full(1 << bits, -1, dtype=np.int32)  # the place of one key that begins with these bits
        self.slots[(self.keys >> self.shift).astype(np.int64)] = np.arange(len(self.keys))

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("number", "order", "keys")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._index()

    @staticmethod
    def _bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inside = np.zeros(len(data) + 2, dtype=np.int8)
        inside[1:-1] = ~_SPACE[data]
        change = np.diff(inside)
        return np.flatnonzero(change == 1), np.flatnonzero(change == -1)

    def _hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(data) + 1 > self.most:
            self.most = len(data) + 1
            self.up, self.down = _powers(_BASE, self.most), _powers(_INVERSE, self.most)
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_VALUE[data] * self.up[: len(data)], out=sums[1:])
        return mixed((sums[ends] - sums[starts]) * self.down[starts])

    @staticmethod
    def _stripped(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of words without marks at their ends."""
        starts, ends = starts.copy(), ends.copy()
        for left in (True, False):
            at = np.arange(len(starts))
            while len(at):
                a, b = starts[at], ends[at]
                edge = data[np.minimum(a, len(data) - 1)] if left else data[b - 1]
                step = (_MARK[edge] & (b > a)).astype(np.int64)
                for mark in _WIDE_MARKS:
                    n = len(mark)
                    first = a if left else b - n
                    fits = np.flatnonzero((b - a >= n) & (edge == mark[0 if left else -1]))
                    for k, c in enumerate(mark):
                        fits = fits[data[first[fits] + k] == c]
                    step[fits] = n
                at, step = at[step > 0], step[step > 0]
                if left:
                    starts[at] += step
                else:
                    ends[at] -= step
        return starts, ends

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers of all words (-1: no term), words of marks only left out; words by text."""
        low = [t.decode("utf-8", "replace").lower().encode() for t in texts]
        joined = b" ".join(low)
        data = np.frombuffer(joined, dtype=np.uint8)
        starts, ends = self._bounds(data)
        if not len(starts) or not len(self.keys):
            low = [[w for w in t.split() if w.decode().strip(_MARKS)] for t in low]
            return np.full(sum(map(len, low)), -1, dtype=np.int64), np.array([len(x) for x in low], dtype=np.int64)
        a, b = self._stripped(data, starts, ends)
        keep = b > a
        text_ends = np.cumsum(np.fromiter(map(len, low), dtype=np.int64, count=len(low)) + 1)
        sizes = np.diff(np.searchsorted(starts[keep], text_ends), prepend=0)
        h = self._hashes(data, a[keep], b[keep])
        place = self.slots[(h >> self.shift).astype(np.int64)]
        found = np.where((place >= 0) & (self.keys[place] == h), place, -1).astype(np.int64)
        other = np.flatnonzero((place >= 0) & (found < 0))  # another key begins with the same bits
        if len(other):
            at = np.minimum(np.searchsorted(self.keys, h[other]), len(self.keys) - 1)
            found[other] = np.where(self.keys[at] == h[other], at, -1)
        return np.where(found >= 0, self.order[found], -1), sizes


_NUMBERS = "ids array<long>, found binary, sizes binary"


def _numbers(docs: DataFrame, terms: Terms) -> DataFrame:
    """The documents by blocks, as numbers of terms: doc_ids, then all words (one more than the term, 0: none) and words by
    document, both packed. Written, since words cost far more to tell than such rows to read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, ids, texts in gather(batches, most=BLOCK):
            found, sizes = terms.of(texts)
            packed = [squeeze(small(found + 1)), squeeze(small(sizes))]
            yield pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in packed)], names=["ids", "found", "sizes"])

    return spill(docs.mapInArrow(run, _NUMBERS), "numbers")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """doc_ids, term numbers (-1: no term) and words by document of each row of ``_numbers``."""
    for b in batches:
        for ids, found, sizes in zip(*b.columns, strict=True):
            yield ids.as_py(), unsqueeze(found.as_py()).astype(np.int64) - 1, unsqueeze(sizes.as_py()).astype(np.int64)


def _frequencies(numbers: DataFrame, size: int) -> tuple[int, np.ndarray]:
    """The number of documents, and in how many of them each term occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(size, dtype=np.int64)
        for ids, found, sizes in _blocks(batches):
            n += len(ids)
            at = np.flatnonzero(found >= 0)
            order = np.argsort(small(found[at]), kind="stable")  # so the documents of a term stay in order
            term, owner = found[at][order], np.repeat(np.arange(len(sizes)), sizes)[at][order]
            first = np.append(True, (term[1:] != term[:-1]) | (owner[1:] != owner[:-1]))[: len(term)]
            df += np.bincount(term[first], minlength=size)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], names=["term", "n"])

    out = np.zeros(size, dtype=np.int64)
    rows = numbers.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n")).collect()  # one row a term
    for t, n in rows:
        if t >= 0:
            out[t] = n
    return sum(int(n) for t, n in rows if t < 0), out


class Passages:
    """The passages of some texts, each two of the half-width pieces that a text is cut into."""

    def __init__(self, found: np.ndarray, sizes: np.ndarray, idf: np.ndarray) -> None:
        half = WIDTH // 2
        pieces = np.maximum(-(-sizes // half), 1)
        first = np.cumsum(pieces) - pieces
        at = np.flatnonzero(found >= 0)
        at = at[idf[found[at]] > 0]
        owner = np.repeat(np.arange(len(sizes)), sizes)[at]
        self.terms = found[at]
        self.piece = first[owner] + (at - (np.cumsum(sizes) - sizes)[owner]) // half
        self.doc = np.repeat(np.arange(len(sizes)), pieces)
        self.at = (np.arange(len(self.doc)) - first[self.doc]) * half
        squares = np.bincount(self.piece, weights=idf[self.terms] ** 2, minlength=len(self.doc))
        self.paired = np.append(self.doc[1:] == self.doc[:-1], False)
        self.norm = np.sqrt(squares + np.where(self.paired, np.append(squares[1:], 0), 0))

    def possible(self, lengths: np.ndarray, least: float) -> np.ndarray:
        """The passages whose sums of term rows, given the rows' lengths, can be as long as ``least``; never those without terms."""
        most = np.bincount(self.piece, weights=lengths[self.terms], minlength=len(self.doc))
        most = most + np.where(self.paired, np.append(most[1:], 0), 0)
        return np.flatnonzero((most > 0) & (most * 1.001 >= least))  # sums are rounded

    def vectors(self, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Sums of term ``rows`` for the passages numbered in ``at`` (in order)."""
        pieces = np.union1d(at, at[self.paired[at]] + 1)
        first, last = np.searchsorted(self.piece, pieces), np.searchsorted(self.piece, pieces, side="right")
        n = last - first
        full = np.flatnonzero(n)
        total = np.zeros((len(pieces) + 1, rows.shape[1]), dtype=np.float32)
        if len(full):
            n, first = n[full], first[full]
            total[full] = _sums(rows, self.terms[np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)], n)
        place, paired = np.searchsorted(pieces, at), self.paired[at]
        out = total[place]
        out[paired] += total[place[paired] + 1]
        return out


def _sums(rows: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of ``rows[at]`` by segments of the given sizes, none empty. The k-th rows of all segments are added together,
    long segments in parts of RUN, whose sums are added likewise."""
    parts = -(-sizes // RUN)
    owner = np.repeat(np.arange(len(sizes)), parts)
    skip = RUN * (np.arange(len(owner)) - (np.cumsum(parts) - parts)[owner])
    n = np.minimum(sizes[owner] - skip, RUN)
    order = np.argsort(-n, kind="stable")
    starts, n = ((np.cumsum(sizes) - sizes)[owner] + skip)[order], n[order]
    total = rows.take(at[starts], axis=0)
    for k in range(1, int(n[0])):
        m = int(np.searchsorted(-n, -k))  # segments of over k rows
        total[:m] += rows.take(at[starts[:m] + k], axis=0)
    out = np.empty_like(total)
    out[order] = total
    return out if len(owner) == len(sizes) else _sums(out, np.arange(len(owner)), parts)


def _rows_of(found: np.ndarray, sizes: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms with weight, the number of them by passage and 1 / |passage|^2; passages without such terms are left out."""
    at = np.flatnonzero(found >= 0)
    at = at[idf[found[at]] > 0]
    pieces = -(-sizes // WIDTH)
    owner = np.repeat(np.arange(len(sizes)), sizes)[at]
    row = (np.cumsum(pieces) - pieces)[owner] + (at - (np.cumsum(sizes) - sizes)[owner]) // WIDTH
    entries, counts = np.unique(row * len(idf) + found[at], return_counts=True)
    n = np.unique(row, return_counts=True)[1]
    owner = np.unique(entries // len(idf), return_inverse=True)[1]
    return found[at], n, 1 / np.bincount(owner, weights=(counts * idf[entries % len(idf)]) ** 2)


def _add_gram(out: np.ndarray, terms: np.ndarray, sizes: np.ndarray, scale: np.ndarray, q: np.ndarray) -> None:
    """Adds A'(A q) to ``out``, for rows of unit length given as by _rows_of; weights of terms are left to the caller."""
    ends, a = np.cumsum(sizes), 0
    while a < len(ends):
        first = int(ends[a] - sizes[a])
        b = max(a + 1, int(np.searchsorted(ends, first + ENTRIES, side="right")))
        t, n = terms[first : int(ends[b - 1])], sizes[a:b]
        y = _sums(q, t, n) * scale[a:b, None]
        order = np.argsort(t, kind="stable")
        distinct, often = np.unique(t, return_counts=True)
        out[distinct] += _sums(y, np.repeat(np.arange(b - a), n)[order], often)
        a = b


def _fit(docs: DataFrame, terms: Terms, idf: np.ndarray, items: list[np.ndarray], rank: int, numbers: DataFrame | None = None) -> np.ndarray:
    """The leading right singular directions (terms x rank) of the weighted passages of all documents and of the items.

    ``numbers`` are those of the documents, if they are written already."""
    size, width = len(idf), min(rank + EXTRA, len(idf))

    def to_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found, sizes in _blocks(batches):
            found, sizes, scale = _rows_of(found, sizes, idf)
            if len(sizes):
                # a passage has at most WIDTH words
                packed = [found.astype(np.int32).tobytes(), sizes.astype(np.uint8).tobytes(), scale.astype(np.float32).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([len(sizes)]), *(pa.array([x], pa.binary()) for x in packed)], names=["n", "terms", "sizes", "scale"])

    numbers = _numbers(docs, terms) if numbers is None else numbers
    rows = spill(numbers.mapInArrow(to_rows, "n long, terms binary, sizes binary, scale binary"), "passages")

    boost = 10 * max(1.0, (rows.agg(F.sum("n")).first()[0] or 0) / size)  # items weigh more than the average direction of the passages
    weighty = [x[idf[x] > 0] for x in items if (idf[x] > 0).any()]
    lengths = [(np.bincount(x, weights=idf[x]) ** 2).sum() for x in weighty]
    own = np.concatenate(weighty), np.array([len(x) for x in weighty]), 1 / np.array(lengths)

    def times(q: np.ndarray) -> np.ndarray:
        q = q * idf[:, None]
        shipped = docs.sparkSession.sparkContext.broadcast(q.astype(np.float32))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((size, width))
            for b in batches:
                for x, sizes, scale in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                    _add_gram(out, np.frombuffer(x, np.int32), np.frombuffer(sizes, np.uint8).astype(np.int64), np.frombuffer(scale, np.float32), shipped.value)
            starts = list(range(0, size, TERM_BLOCK))
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(starts), pa.int32()), pa.array(starts, pa.int32()), pa.array([out[s : s + TERM_BLOCK].astype(np.float32).tobytes() for s in starts], pa.binary())], names=["part", "first", "sums"])

        def add(table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(x, dtype=np.float32).astype(float) for x in table["sums"].to_pylist())
            return pa.table({"part": table["part"][:1], "first": table["first"][:1], "sums": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

        sums, parts = rows.mapInArrow(run, _SUMS), rows.rdd.getNumPartitions()
        while parts > 1:  # level by level, so that no task sums the parts of many partitions
            parts = -(-parts // FAN_IN)
            sums = sums.withColumn("part", F.pmod("part", F.lit(parts))).groupBy("part", "first").applyInArrow(add, _SUMS)
        out = np.zeros((size, width))
        for r in sums.collect():  # terms x rank numbers
            block = np.frombuffer(r["sums"], dtype=np.float32).reshape(-1, width)
            out[r["first"] : r["first"] + len(block)] = block
        of_items = np.zeros_like(out)
        _add_gram(of_items, *own, q)
        return idf[:, None] * (out + boost * of_items)  # the items' own directions stay in view

    q = np.linalg.qr(np.random.default_rng(5).standard_normal((size, width)))[0]
    for _ in range(2):
        q = np.linalg.qr(times(q))[0]
    y = q.T @ times(q)
    values, u = np.linalg.eigh((y + y.T) / 2)
    return q @ u[:, np.argsort(-values)[:rank]]


def common(masks: dict[int, int], n: int, stretch: list[int]) -> int:
    """Length of the longest common subsequence of an item of n words and a stretch, by bit-parallel rows."""
    full = (1 << n) - 1
    v = full
    for t in stretch:
        if (m := masks.get(t)) is not None:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


class Item:
    def __init__(self, item_id: int, terms: list[int], keys: list[int]) -> None:
        self.item_id, self.n, self.keys, self.masks = item_id, len(terms), set(keys), {}
        for k, t in enumerate(terms):
            self.masks[t] = self.masks.get(t, 0) | 1 << k

    def places(self, found: np.ndarray, ends: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
        """(text, place) such that every stretch of one text with LEAST_COMMON of the item's words is near a place."""
        mark = np.zeros(size + 1, dtype=bool)  # the last one is for words that are no term
        mark[list(self.masks)] = True
        hits, need = np.flatnonzero(mark[found]), max(1, math.ceil(LEAST_COMMON * self.n - 1e-9))
        last = hits[need - 1 :]
        first = hits[: len(last)]
        owner = np.searchsorted(ends, first, side="right")
        full = (last < first + self.n + self.n // 2) & (last < ends[owner] if len(first) else True)
        text, beyond = -1, 0
        for a, d in zip(first[full].tolist(), owner[full].tolist(), strict=True):
            if d != text or a > beyond:
                # what found() looks at then starts at a and holds all stretches that start up to beyond
                text, beyond = d, a + WIDTH + self.n // 2
                yield d, a + self.n - (int(ends[d - 1]) if d else 0)

    def found(self, doc: np.ndarray, at: int) -> tuple[float, int, int] | None:
        """The best share of the item's words, in order, in a stretch near place ``at``; None if that is no leak."""
        low, high = max(0, at - self.n), min(len(doc), at + WIDTH + self.n)
        near = doc[low:high].tolist()
        if common(self.masks, self.n, near) < LEAST_COMMON * self.n:
            return None
        size, step = self.n + self.n // 2, max(1, self.n // 8)
        best, where = max((common(self.masks, self.n, near[s : s + size]), -s) for s in range(0, max(1, len(near) - size + step), step))
        a = -where
        stretch = set(near[a : a + size])
        if best < LEAST_COMMON * self.n or (best < SURE_COMMON * self.n and 2 * len(self.keys & stretch) < len(self.keys)):
            return None
        return best / self.n, low + a, low + min(len(near), a + size)


def leaks(docs: DataFrame, benchmark: DataFrame, rank: int = RANK) -> DataFrame:
    """doc_id, item_id, common (share of the item's words), cosine (null for items searched by their words), first_word and last_word of each pair found."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    answered = "answer" in benchmark.columns
    usable = benchmark.select(F.col("item_id").cast("long"), "text", F.col("answer").cast("string") if answered else F.lit(None).cast("string").alias("answer")).where("text IS NOT NULL")
    pieces = F.ceil(F.size(F.split("text", r"\s+")) / WIDTH)
    short = _short_leaks(docs, usable)
    blocks = max(1, -(-int(usable.agg(F.sum(F.lit(1) + F.when(pieces > 1, pieces).otherwise(0))).first()[0] or 0) // ITEM_BLOCK))
    out = short
    for k in range(blocks):
        part = usable if blocks == 1 else usable.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        found = _leaks_of(docs, [tuple(r) for r in part.collect()], rank)  # at most some ITEM_BLOCK rows
        if found is not None:
            out = found if out is None else out.union(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], _FOUND)


_FOUND = "doc_id long, item_id long, common double, cosine double, first_word long, last_word long"
_SUMS = "part int, first int, sums binary"


def _short_leaks(docs: DataFrame, usable: DataFrame) -> DataFrame | None:
    """Items of under LEAST_WORDS words are too common to be searched inside sentences; a line that holds such an item and
    nothing else is a leak. They are kept by their words, in blocks of ITEM_BLOCK."""
    few = usable.where(F.size(F.split(F.trim("text"), r"\s+")) < 2 * LEAST_WORDS)
    blocks = max(1, -(-few.count() // ITEM_BLOCK))
    out = None
    for k in range(blocks):
        rows = few.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).select("item_id", "text").collect()  # at most some ITEM_BLOCK rows
        by_words: dict[tuple[str, ...], list] = {}
        for i, t in sorted(map(tuple, rows), key=str):
            if 0 < len(w := item_words(t)) < LEAST_WORDS:
                by_words.setdefault(tuple(w), []).append(i)
        if by_words:
            found = _lines_equal(docs, by_words)
            out = found if out is None else out.union(found)
    return out


def _lines_equal(docs: DataFrame, by_words: dict[tuple[str, ...], list]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                seen, at = set(), 0
                for line in (text or b"").split(b"\n"):
                    words = [p for w in line.split() if (p := plain(w))]
                    for i in by_words.get(tuple(words), ()) if len(words) < LEAST_WORDS else ():
                        if i not in seen:
                            seen.add(i)
                            out.append((doc, i, 1.0, None, at, at + len(words)))
                    at += len(words)
            columns = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()), strict=True)], names=[c.split()[0] for c in _FOUND.split(", ")])

    return docs.mapInArrow(run, _FOUND)


def _leaks_of(docs: DataFrame, block: list[tuple], rank: int) -> DataFrame | None:
    block = sorted([(i, w, item_words(a)) for i, t, a in block if len(w := item_words(t)) >= LEAST_WORDS], key=str)
    if not block:
        return None
    terms = Terms([w + a for _, w, a in block])
    numbers = _numbers(docs, terms)
    n_docs, df = _frequencies(numbers, len(terms.number))
    weight = np.log((1 + n_docs) / (1 + df))
    idf = np.where(df > COMMON_SHARE * n_docs, 0.0, weight)
    numbered = [np.array([terms.number[x] for x in w]) for _, w, _ in block]
    by_words = [k for k, x in enumerate(numbered) if not (idf[x] ** 2).sum() > (1 - MOST_COMMON) * (weight[x] ** 2).sum()]
    directions = _fit(docs, terms, idf, numbered, rank, numbers) if len(by_words) < len(block) else np.zeros((len(idf), 1))
    rows = (idf[:, None] * directions).astype(np.float32)
    cut = [(k, x) for k, y in enumerate(numbered) if len(y) > WIDTH for x in np.array_split(y, -(-len(y) // WIDTH))]
    owner = np.array([*range(len(block)), *(k for k, _ in cut)])
    queries = np.stack([rows[x].sum(axis=0) for x in (*numbered, *(x for _, x in cut))])
    norms = np.linalg.norm(queries, axis=1)
    queries = queries / np.maximum(norms, 1e-9)[:, None]
    items = []
    for (item_id, _, answer), x in zip(block, numbered, strict=True):
        keys = [terms.number[a] for a in answer] or sorted(set(x.tolist()), key=lambda t: (-weight[t], t))[:4]
        items.append(Item(item_id, x.tolist(), keys))
    norms[np.isin(owner, by_words)] = np.inf
    shipped = docs.sparkSession.sparkContext.broadcast((rows, idf, queries.astype(np.float32), norms, owner, items, by_words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, idf, queries, norms, owner, items, by_words = shipped.value
        lengths, least = np.linalg.norm(rows, axis=1), LEAST_WEIGHT * norms.min()
        for ids, found, sizes in _blocks(batches):
            passages, ends = Passages(found, sizes, idf), np.cumsum(sizes)
            best: dict[tuple[int, int], tuple] = {}
            for k in by_words:
                for d, at in items[k].places(found, ends, len(idf)):
                    got = items[k].found(found[ends[d] - sizes[d] : ends[d]], at)
                    if got and got[0] > best.get((d, k), (0,))[0]:
                        best[d, k] = (got[0], None, got[1], got[2])
            heavy = passages.possible(lengths, least)
            for i in range(0, len(heavy), 1024):
                some = heavy[i : i + 1024]
                products = passages.vectors(rows, some) @ queries.T
                cosines = products / np.maximum(passages.norm[some, None], 1e-6)
                seen = (-1, -1)
                near = np.nonzero((cosines >= LEAST_COSINE) & (products >= LEAST_WEIGHT * norms))
                # the pieces of an item come one after another, each passage once, the whole item first
                for r, k, q in sorted(zip(near[0].tolist(), owner[near[1]].tolist(), near[1].tolist(), strict=True)):
                    if (r, k) == seen:
                        continue
                    seen, d = (r, k), int(passages.doc[some[r]])
                    got = items[k].found(found[ends[d] - sizes[d] : ends[d]], int(passages.at[some[r]]))
                    if got and got[0] > best.get((d, k), (0,))[0]:
                        best[d, k] = (got[0], float(cosines[r, q]), got[1], got[2])
            columns = [[ids[d] for d, _ in best], [items[k].item_id for _, k in best], *([v[j] for v in best.values()] for j in range(4))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "item_id", "common", "cosine", "first_word", "last_word"])

    return numbers.mapInArrow(run, _FOUND)


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item."""
    name = fresh(docs, "leak")
    gone = spill(leaks(docs, benchmark).select(F.col("doc_id").alias(name)).distinct(), "leaks")
    return docs.join(gone, docs["doc_id"] == gone[name], "left_anti")


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents", "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
