"""LM scoring by deleted interpolation.

A bigram model over words: the probability of a word after another is a mixture of the maximum-likelihood bigram and
unigram estimates and of a uniform share for words not in the vocabulary. The mixture weights depend on how often the
context was seen (a bucket for each power of two), and are learned by expectation-maximisation on held-out counts: a
tenth of the training documents serve as the held-out part, with estimates from the other nine tenths. The final
estimates use all training documents. Counts are exact over the whole corpus and are gathered by block exchange (see
``blocks``); what goes to the driver is a table of statistics whose size does not depend on the corpus.

Defined results: null text is empty text, which is one end token; a null doc_id has crc32 of nothing, remainder 0, and
so is trained on; rows that repeat a doc_id are each counted and scored; without training documents every word is
unknown and has probability 1; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import block_bytes, bucket_count, by_bucket, gather, local_ids, mixed, small, squeeze, squeeze_sorted, unsqueeze, unsqueeze_sorted, word_hashes
from .common import read, spill, text_mb

FOLDS, TEST_FOLD, TUNE_PARTS = 5, 1, 10
#: Bytes of text in a block: some 70 bytes of arrays for each byte.
BLOCK = 6_000_000
CONTEXTS = 40
STEP = 0.125
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
TRAIN, TUNE, TEST = 0, 1, 2
#: Not words, since words hold no spaces.
END, START = b" end", b" start"


def part(doc: int | None) -> int:
    """Whether a document is tested on, tunes the weights (and is trained on), or is only trained on."""
    c = zlib.crc32(b"" if doc is None else str(doc).encode())
    return TEST if c % FOLDS == TEST_FOLD else TUNE if c // FOLDS % TUNE_PARTS == 0 else TRAIN


_BLOCK = "block long, part int, docs binary, nulls binary, sizes binary, tokens binary, words binary"


def _to_blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.int32()] + [pa.binary()] * 5
    for block, k, ids, texts in gather(batches, part, most):
        # the first document starts with START and END, so that they have numbers 0 and 1
        tokens, sizes, vocabulary = local_ids([[START, END]] + [[*t.translate(_LOWER).split(), END] for t in texts])
        row = [block, k, squeeze(np.array([i or 0 for i in ids], dtype=np.int64)), squeeze(np.array([i is None for i in ids], dtype=np.uint8)), squeeze(sizes[1:]), squeeze(tokens[2:]), zstandard.ZstdCompressor(level=3).compress(b" ".join(vocabulary[2:]))]
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=[x.split()[0] for x in _BLOCK.split(", ")])


class _Block:
    """A block's distinct words and bigrams in exchange order, and which of them each token is."""

    def __init__(self, row: dict, buckets: int) -> None:
        self.sizes, self.tokens = unsqueeze(row["sizes"]), unsqueeze(row["tokens"])
        h, g = word_hashes([START, END, *zstandard.ZstdDecompressor().decompressobj().decompress(row["words"]).split()])
        self.words = by_bucket(h, g, buckets)
        self.word_keys = h
        coded = np.empty(len(self.tokens), dtype=np.int64)  # context and token in one number
        coded[0], coded[1:] = 0, self.tokens[:-1]
        coded[np.cumsum(self.sizes)[:-1]] = 0
        coded *= len(h)
        coded += self.tokens
        pairs, pair_of, self.pair_counts = np.unique(coded, return_inverse=True, return_counts=True)
        del coded
        self.pair_of = pair_of.astype(np.int32)
        self.v, self.w = (pairs // len(h)).astype(np.int32), (pairs % len(h)).astype(np.int32)
        del pairs, pair_of
        self.pair_keys = mixed(h[self.v] * np.uint64(0x9E3779B97F4A7C15) + h[self.w])
        self.pairs = by_bucket(self.pair_keys, g[self.v] * np.uint64(0xD6E8FEB86659FD93) + g[self.w], buckets)
        self.word_counts = np.bincount(self.tokens, minlength=len(h))
        self.word_counts[0] = len(self.sizes)  # START: a context only, once a document

    def sent(self, block: int, part: int) -> Iterator[tuple]:
        for kind, keys, counts, (order, bounds) in ((0, self.word_keys, self.word_counts, self.words), (1, self.pair_keys, self.pair_counts, self.pairs)):
            keys, counts = keys[order], counts[order]
            for k in np.flatnonzero(np.diff(bounds)).tolist():
                x, y = bounds[k : k + 2].tolist()
                yield 2 * k + kind, block, part, squeeze_sorted(keys[x:y]), squeeze(small(counts[x:y]))

    def received(self, table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Of each word and of each pair: all training counts, and those of the tuning part."""
        out = tuple(np.zeros((2, len(order)), dtype=np.int64) for order, _ in (self.words, self.pairs))
        for bucket, counts, tuning in zip(table["bucket"], table["counts"], table["tuning"], strict=True):
            if bucket.is_valid:
                k, kind = divmod(bucket.as_py(), 2)
                order, bounds = (self.words, self.pairs)[kind]
                at = order[bounds[k] : bounds[k + 1]]
                out[kind][0, at], out[kind][1, at] = unsqueeze(counts.as_py()), unsqueeze(tuning.as_py())
        return out


def _own(table: pa.Table, buckets: int) -> tuple[dict, _Block]:
    """The row of a group that holds its block, and the block."""
    row = table.filter(pc.is_valid(table["tokens"])).to_pylist()[0]
    return row, _Block(row, buckets)


_START_KEY = word_hashes([START])[0]


def _count(table: pa.Table) -> pa.Table:
    """Of one bucket: each key's counts over all blocks, for each block in its order; and the bucket's share of V and N."""
    bucket, parts = table["bucket"][0].as_py(), table["part"].to_pylist()
    keys, counts = [unsqueeze_sorted(x) for x in table["keys"].to_pylist()], [unsqueeze(x).astype(np.int64) for x in table["counts"].to_pylist()]
    sizes = [len(x) for x in keys]
    which = np.repeat(np.array(parts), sizes)
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(keys, kind="stable")
    new = np.concatenate(([True], keys[order][1:] != keys[order][:-1]))
    group = np.empty(len(keys), dtype=np.int64)
    group[order] = np.cumsum(new) - 1
    total = np.bincount(group, weights=np.where(which == TEST, 0, counts)).astype(np.int64)
    tuning = np.bincount(group, weights=np.where(which == TUNE, counts, 0)).astype(np.int64)
    cuts = np.cumsum(sizes)[:-1]
    rows = {
        "block": table["block"].to_pylist(),
        "bucket": [bucket] * len(sizes),
        "counts": [squeeze(small(x)) for x in np.split(total[group], cuts)],
        "tuning": [squeeze(small(x)) for x in np.split(tuning[group], cuts)],
        "stats": [None] * len(sizes),
    }
    if bucket % 2 == 0:
        token = keys[order][new] != _START_KEY[0]
        main = total - tuning
        rows["block"].append(-1), rows["bucket"].append(bucket), rows["counts"].append(None), rows["tuning"].append(None)
        rows["stats"].append([int(x) for x in (total[token].sum(), (total[token] > 0).sum(), main[token].sum(), (main[token] > 0).sum())])
    types = {"block": pa.int64(), "bucket": pa.int32(), "counts": pa.binary(), "tuning": pa.binary(), "stats": pa.list_(pa.int64())}
    return pa.table({k: pa.array(v, types[k]) for k, v in rows.items()})


def _bucket_of(context_count: np.ndarray) -> np.ndarray:
    """0 for contexts not seen, else 1 + the count's power of two."""
    return np.where(context_count > 0, np.frexp(np.maximum(context_count, 1).astype(float))[1], 0).clip(0, CONTEXTS - 1)


def _estimates(pair: np.ndarray, context: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.where(context > 0, pair / np.maximum(context, 1), 0.0), word / max(n, 1)


def learn(stats: dict[tuple[int, int, int], int], uniform: float, rounds: int = 60) -> np.ndarray:
    """Mixture weights (uniform, unigram, bigram) by context bucket, by EM on held-out counts.

    ``stats``: counts by (bucket, i, j) where the bigram and unigram estimates are 2 ** (-i * STEP) and 2 ** (-j * STEP);
    -1: zero. Each bucket starts from, and is smoothed by one count of, the weights of all buckets together.
    """
    start = np.array([0.1, 0.3, 0.6])

    def fit(rows: list[tuple[int, int, int]], begin: np.ndarray) -> np.ndarray:
        if not rows:
            return begin
        i, j, n = np.array(rows, dtype=float).T
        p = np.stack([np.full(len(i), uniform), np.where(j < 0, 0, 2.0 ** (-j * STEP)), np.where(i < 0, 0, 2.0 ** (-i * STEP))], axis=1)
        w = begin.copy()
        for _ in range(rounds):
            share = w * p
            share /= share.sum(axis=1, keepdims=True)
            w = (n @ share + begin) / (n.sum() + 1)
        return w

    everything = fit([(i, j, n) for (_, i, j), n in stats.items()], start)
    out = []
    for b in range(CONTEXTS):
        w = fit([(i, j, n) for (c, i, j), n in stats.items() if c == b], everything)
        if b == 0:
            w = np.array([w[0], w[1] + w[2], 0.0])  # no bigram estimate after a context not seen
        out.append(w / w.sum())
    return np.array(out)


def score_corpus(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    most = block_bytes(docs.sparkSession, BLOCK)
    buckets = bucket_count(text_mb(docs)[1], most)
    blocks = spill(docs.mapInArrow(lambda batches: _to_blocks(batches, most), _BLOCK), "blocks")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
        for b in batches:
            for row in b.to_pylist():
                rows = list(_Block(row, buckets).sent(row["block"], row["part"]))
                for i in range(0, len(rows), 256):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 256], strict=True), types, strict=True)], names=["bucket", "block", "part", "keys", "counts"])

    answers = spill(
        blocks.mapInArrow(send, "bucket int, block long, part int, keys binary, counts binary").groupBy("bucket").applyInArrow(_count, "block long, bucket int, counts binary, tuning binary, stats array<long>"), "counts"
    )
    sums = answers.where("stats IS NOT NULL").agg(*[F.coalesce(F.sum(F.col("stats")[k]), F.lit(0)) for k in range(4)]).first()
    n, v, n_main, v_main = map(int, sums)
    empty = {c: F.lit(None).cast("binary") for c in ("docs", "nulls", "sizes", "tokens", "words")}

    def joined(of: DataFrame) -> DataFrame:
        given = answers.where("stats IS NULL").select("block", "bucket", "counts", "tuning").withColumns(empty)
        own = of.drop("part").withColumns({"bucket": F.lit(None).cast("int"), "counts": F.lit(None).cast("binary"), "tuning": F.lit(None).cast("binary")})
        return own, given

    def tune(table: pa.Table) -> pa.Table:
        _, x = _own(table, buckets)
        words, pairs = x.received(table)
        words, pairs = words[0] - words[1], pairs[0] - pairs[1]
        context = words[x.v]
        p2, p1 = _estimates(pairs, context, words[x.w], n_main)
        near = lambda p: np.where(p > 0, np.rint(-np.log2(np.maximum(p, 1e-300)) / STEP), -1).astype(np.int64)
        cells, cell = np.unique(np.stack([_bucket_of(context), near(p2), near(p1)], axis=1), axis=0, return_inverse=True)
        count = np.bincount(cell.reshape(-1), weights=x.pair_counts, minlength=len(cells)).astype(np.int64)
        return pa.table({"b": pa.array(cells[:, 0]), "i": pa.array(cells[:, 1]), "j": pa.array(cells[:, 2]), "n": pa.array(count)})

    own, given = joined(blocks.where(F.col("part") == TUNE))
    tuning = own.unionByName(given.join(own.select("block"), "block", "left_semi").select(*given.columns))
    cells = tuning.groupBy("block").applyInArrow(tune, "b long, i long, j long, n long").groupBy("b", "i", "j").agg(F.sum("n")).collect()  # some thousand cells at any size
    weights = learn({(r[0], r[1], r[2]): int(r[3]) for r in cells}, 1 / (v_main + 1))

    def finish(table: pa.Table) -> pa.Table:
        row, x = _own(table, buckets)
        words, pairs = x.received(table)
        c = words[0]
        base = np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
        p2, p1 = _estimates(pairs[0], c[x.v], c[x.w], n)
        w = weights[_bucket_of(c[x.v])]
        score = np.log10(w[:, 0] / (v + 1) + w[:, 1] * p1 + w[:, 2] * p2)  # one value for each distinct pair
        at = np.cumsum(x.sizes) - x.sizes
        docs, nulls = unsqueeze(row["docs"]), unsqueeze(row["nulls"]).astype(bool)
        total = lambda of, which: pa.array(np.add.reduceat(of[which], at))
        return pa.table({
            "doc_id": pa.array(docs, mask=nulls), "held_out": pa.array([part(None if z else d) == TEST for d, z in zip(docs.tolist(), nulls.tolist(), strict=True)]),
            "n_tokens": pa.array(x.sizes.astype(np.int64)), "n_known": total((c > 0).astype(np.int64), x.tokens), "train_tokens": pa.array(np.full(len(docs), n, dtype=np.int64)), "base_score": total(base, x.tokens), "score": total(score, x.pair_of),
        })

    own, given = joined(blocks)
    return own.unionByName(given).groupBy("block").applyInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op9_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score_corpus(read(spark, sf_dir, "documents", "doc_id", "text"))
