"""Substring dedup: remove words covered by a 13-word window that also starts in a document with a smaller doc_id.

Suffix automata of reference shards, past which documents stream for matching statistics. The whole corpus is its own
reference, so first each block of documents exchanges the hashes of its distinct windows with all others (see
``blocks``) and learns which windows other documents have and the smallest document of each. Stretches of windows that a
document is the smallest one of are references: every repeated window is in one document's references only. Stretches
whose smallest document is another are candidates, and go to the shard of that document. There the automata alone
decide, on the words themselves; spans of 13 or more accepted words go. Hashes only nominate. A shard with many
candidates is dealt to several tasks, and a long reference is cut into several automata, so no task is unbounded.

Windows are judged on the input, not on what is left. Defined results: null text has no words; texts under 13 words
lose nothing; rows that repeat a doc_id are one document and do not remove each other's words; rows with a null doc_id
lose nothing and remove nothing; an empty table gives an empty result; other columns play no part. Texts are read whole,
whatever their length; of equal windows in several places of a document each counts.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import SuffixAutomaton
from .blocks import block_bytes, bucket_count, by_bucket, gather, local_ids, mixed, squeeze, squeeze_sorted, unsqueeze, unsqueeze_sorted, word_hashes
from .common import read, spill, text_mb

WINDOW = 13
#: Bytes of text in a block, words of references in one automaton, words of candidates for one task.
BLOCK, SHARD_WORDS, ASKED_WORDS = 8_000_000, 50_000, 500_000
#: Words that pieces of a cut reference share: more than a window, so that none is lost.
WINDOW_OVERLAP = 4 * WINDOW
_MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def _windows(docs: list[int], words: list[list[bytes]], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start places (among all words of the block), document numbers, keys and other hashes of all windows."""
    ids, n, vocabulary = local_ids(words)
    starts = np.concatenate(([0], np.cumsum(n)))[:-1]
    fits = np.maximum(n - size + 1, 0)
    owner = np.repeat(np.arange(len(docs)), fits)
    at = np.arange(int(fits.sum())) - np.repeat(np.cumsum(fits) - fits, fits) + np.repeat(starts, fits)
    out = []
    for h, m in zip(word_hashes(vocabulary), _MULTIPLIERS, strict=True):
        x = h[ids]
        total = np.zeros(max(len(x) - size + 1, 0), dtype=np.uint64)
        for j in range(size):
            total = total * m + x[j : j + len(total)]
        out.append(mixed(total[at]))
    return at, owner, *out


def _distinct(docs: np.ndarray, owner: np.ndarray, keys: np.ndarray, other: np.ndarray, buckets: int):
    """The distinct windows in exchange order: for each window its number there; keys, smallest doc_id and bucket bounds."""
    unique, first, inverse = np.unique(keys, return_index=True, return_inverse=True)  # documents are in order of doc_id
    order, bounds = by_bucket(unique, other[first], buckets)
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    return place[inverse], unique[order], docs[owner[first[order]]], bounds


def _unpack(row: dict) -> tuple[np.ndarray, list[list[bytes]]]:
    raw = zstandard.ZstdDecompressor().decompress(row["texts"], max_output_size=max(1, row["size"]))
    ends = np.cumsum(unsqueeze(row["sizes"])).tolist()
    return unsqueeze(row["docs"]), [raw[a:b].split() for a, b in zip([0, *ends], ends, strict=False)]


_BLOCK = "block long, size long, docs binary, sizes binary, texts binary"


def _to_blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for block, _, ids, texts in gather(batches, most=most):
        order = sorted(range(len(ids)), key=ids.__getitem__)
        raw = b"".join(texts[k] for k in order)
        row = [block, len(raw), squeeze(np.array([ids[k] for k in order], dtype=np.int64)), squeeze(np.array([len(texts[k]) for k in order], dtype=np.int64)), zstandard.ZstdCompressor(level=3).compress(raw)]
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["block", "size", "docs", "sizes", "texts"])


def _judge(table: pa.Table) -> pa.Table:
    """Of one bucket: for each block and key, whether other blocks have it too, and then the smallest document of all."""
    keys = [unsqueeze_sorted(x) for x in table["keys"].to_pylist()]
    docs = [unsqueeze(x) for x in table["docs"].to_pylist()]
    sizes = [len(x) for x in keys]
    keys, docs = np.concatenate(keys), np.concatenate(docs)
    order = np.lexsort((docs, keys))
    ordered = keys[order]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    group = np.cumsum(new) - 1
    least, shared = np.empty_like(docs), np.empty(len(keys), dtype=bool)
    least[order] = docs[order][np.flatnonzero(new)][group]
    shared[order] = np.bincount(group)[group] > 1
    cuts, pack = np.cumsum(sizes)[:-1], zstandard.ZstdCompressor(level=1).compress
    flags = [pack(np.packbits(x).tobytes()) for x in np.split(shared, cuts)]
    least = [squeeze(x[y]) for x, y in zip(np.split(least, cuts), np.split(shared, cuts), strict=True)]
    return pa.table({"block": table["block"], "bucket": table["bucket"], "flags": pa.array(flags, pa.binary()), "least": pa.array(least, pa.binary())})


def _stretches(at: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each stretch of consecutive windows that agree in ``same``."""
    if not len(at):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    breaks = np.diff(at) != 1
    for x in same:
        breaks |= x[1:] != x[:-1]
    cuts = np.flatnonzero(breaks)
    return np.concatenate(([0], cuts + 1)), np.concatenate((cuts, [len(at) - 1]))


def _spans(automata: list[SuffixAutomaton], words: list[bytes], size: int) -> list[tuple[int, int]]:
    """Maximal half-open spans whose words lie in runs of ``size`` or more that an automaton accepts."""
    found: list[tuple[int, int]] = []
    for automaton in automata:
        for end, n in enumerate(automaton.matching(words)):
            if n >= size:
                found.append((end - n + 1, end + 1))
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _shards(texts: list[list[bytes]], most: int) -> Iterator[SuffixAutomaton]:
    """Automata over the texts in turn, of some ``most`` words each; longer texts are cut, with the windows across a cut kept."""
    held, n = [], 0
    for t in texts:
        for i in range(0, max(1, len(t) - WINDOW_OVERLAP), most):
            part = t[i : i + most + WINDOW_OVERLAP]
            held.append(part)
            n += len(part)
            if n >= most:
                yield SuffixAutomaton(held)
                held, n = [], 0
    if held:
        yield SuffixAutomaton(held)


_NOMINATED = "of long, ref boolean, block long, owner int, start int, n int, text binary"
_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def dedup_corpus(docs: DataFrame, size: int = WINDOW, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 for each row; ``with_text`` adds the kept words as column kept."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    keyed = docs.where("doc_id IS NOT NULL")
    if not 1 <= size <= WINDOW_OVERLAP:
        raise ValueError(f"a window has 1 to {WINDOW_OVERLAP} words")
    most = block_bytes(docs.sparkSession, BLOCK)
    buckets = bucket_count(text_mb(keyed)[1], most)
    blocks = spill(keyed.mapInArrow(lambda batches: _to_blocks(batches, most), _BLOCK), "blocks")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                ids, words = _unpack(row)
                _, keys, least, bounds = _distinct(ids, *_windows(ids, words, size)[1:], buckets)
                full = np.flatnonzero(np.diff(bounds)).tolist()
                rows = [(k, row["block"], squeeze_sorted(keys[bounds[k] : bounds[k + 1]]), squeeze(least[bounds[k] : bounds[k + 1]])) for k in full]
                for i in range(0, len(rows), 256):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 256], strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "block", "keys", "docs"])

    answers = spill(blocks.mapInArrow(send, "bucket int, block long, keys binary, docs binary").groupBy("bucket").applyInArrow(_judge, "block long, bucket int, flags binary, least binary"), "answers")

    def nominate(table: pa.Table) -> pa.Table:
        """Of one block: the stretches that are references, and those that may go, each with the document to hold it against."""
        row = table.filter(pc.is_valid(table["texts"])).to_pylist()[0]
        ids, words = _unpack(row)
        at, owner, keys, other = _windows(ids, words, size)
        place, unique, least, bounds = _distinct(ids, owner, keys, other, buckets)
        most, shared = least.copy(), np.zeros(len(unique), dtype=bool)
        np.maximum.at(most, place, ids[owner])
        several, first = most > least, least
        for bucket, flags, given in zip(table["bucket"], table["flags"], table["least"], strict=True):
            if bucket.is_valid:
                x, y = bounds[bucket.as_py()], bounds[bucket.as_py() + 1]
                raw = zstandard.ZstdDecompressor().decompress(flags.as_py(), max_output_size=int(y - x) // 8 + 1)
                hit = np.unpackbits(np.frombuffer(raw, dtype=np.uint8), count=int(y - x)).astype(bool)
                shared[x:y] = hit
                first[x:y][hit] = unsqueeze(given.as_py())
        of, mine = first[place], ids[owner]
        flat, starts = [w for x in words for w in x], np.concatenate(([0], np.cumsum([len(x) for x in words])))
        out = []
        for ref, on in ((True, (mine == of) & (shared | several)[place]), (False, mine > of)):
            p, o, m = at[on], owner[on], of[on]
            for i, j in zip(*_stretches(p, o, m), strict=True):
                x, y = int(p[i]), int(p[j]) + size
                out.append((int(m[i]), ref, row["block"], int(o[i]), x - int(starts[o[i]]), y - x, b" ".join(flat[x:y])))
        columns = list(zip(*out, strict=True)) or [()] * 7
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
        return pa.table({n.split()[0]: pa.array(c, t) for n, c, t in zip(_NOMINATED.split(", "), columns, kinds, strict=True)})

    def judge(table: pa.Table) -> pa.Table:
        """Of one shard: candidates stream past the automata of its references; what they accept goes, packed by block."""
        rows = table.to_pylist()
        refs = [r["text"].split(b" ") for r in rows if r["ref"]]
        asked = [(r, r["text"].split(b" ")) for r in rows if not r["ref"]]
        found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for automaton in _shards(refs, SHARD_WORDS) if asked else ():
            for r, w in asked:
                found[r["block"]] += [(r["owner"], r["start"] + a, r["start"] + b) for a, b in _spans([automaton], w, size)]
        packed = [(k, *(squeeze(np.array(c, dtype=np.int64)) for c in zip(*v, strict=True))) for k, v in found.items() if v]
        columns = list(zip(*packed, strict=True)) or [()] * 4
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("block", "owners", "firsts", "lasts"), columns, (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)})

    def beside(other: DataFrame) -> DataFrame:
        """Blocks and rows for them, to be grouped by block."""
        mine, theirs = [c for c in other.columns if c != "block"], ("size", "docs", "sizes", "texts")
        left = blocks.withColumns({c: F.lit(None).cast(dict(other.dtypes)[c]) for c in mine})
        return left.unionByName(other.withColumns({c: F.lit(None).cast(dict(blocks.dtypes)[c]) for c in theirs}))

    nominated = spill(beside(answers).groupBy("block").applyInArrow(nominate, _NOMINATED), "nominated")
    total = nominated.where("ref").agg(F.sum(F.col("n").cast("long"))).first()[0] or 0
    sharded = nominated.withColumn("shard", F.pmod(F.xxhash64("of"), F.lit(max(1, -(-int(total) // SHARD_WORDS)))).cast("int"))
    # a shard with many candidates is dealt to several tasks, each with the shard's references
    crowded = spill(sharded.where("NOT ref").groupBy("shard").agg(F.ceil(F.sum("n") / ASKED_WORDS).cast("int").alias("parts")).where("parts > 1"), "crowded")
    dealt = sharded.join(crowded, "shard", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.array(F.pmod(F.xxhash64("block", "owner", "start"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("part", F.explode(F.when(F.col("ref"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(own)))
    verified = spill(dealt.select("shard", "part", "ref", "block", "owner", "start", "text").groupBy("shard", "part").applyInArrow(judge, "block long, owners binary, firsts binary, lasts binary"), "verified")

    def finish(table: pa.Table) -> pa.Table:
        ids, words = _unpack(table.filter(pc.is_valid(table["texts"])).to_pylist()[0])
        n = np.array([len(w) for w in words], dtype=np.int64)
        starts = np.cumsum(n) - n
        change = np.zeros(int(n.sum()) + 1, dtype=np.int64)
        for owners, firsts, lasts in zip(table["owners"], table["firsts"], table["lasts"], strict=True):
            if owners.is_valid:
                base = starts[unsqueeze(owners.as_py())]
                np.add.at(change, base + unsqueeze(firsts.as_py()), 1)
                np.subtract.at(change, base + unsqueeze(lasts.as_py()), 1)
        covered = np.cumsum(change[:-1]) > 0
        out, a = [], 0
        for doc, w in zip(ids.tolist(), words, strict=True):
            hit = covered[a : a + len(w)]
            a += len(w)
            kept = b" ".join([x for x, h in zip(w, hit.tolist(), strict=True) if not h] if hit.any() else w)
            out.append((doc, len(w), int(hit.sum()), hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None))
        columns = list(zip(*out, strict=True)) or [[]] * 5
        named = {"doc_id": pa.array(columns[0], pa.int64()), "n_words": pa.array(columns[1], pa.int64()), "n_removed": pa.array(columns[2], pa.int64()), "kept_sha256": pa.array(columns[3], pa.string())}
        return pa.table(named | ({"kept": pa.array(columns[4], pa.string())} if with_text else {}))

    schema = _RESULT + ", kept string" * with_text
    done = beside(verified).groupBy("block").applyInArrow(finish, schema)
    split = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), "[\x09-\x0d]", " "), " ")
    whole = docs.where("doc_id IS NULL").withColumn("w", F.array_remove(split, "")).select(
        "doc_id", F.size("w").cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.sha2(F.array_join("w", " "), 256).alias("kept_sha256"), *([F.array_join("w", " ").alias("kept")] if with_text else [])
    )
    return done.unionByName(whole)


def dedup_against(docs: DataFrame, reference: list[str], size: int = WINDOW, most_words: int = 500_000) -> DataFrame:
    """doc_id, n_words, n_removed and kept: words go if a run of ``size`` or more also occurs in a reference text.

    Suffix automata of reference shards are broadcast and each document streams past them for matching statistics. The
    reference is bounded by ``most_words``; a longer one belongs in the corpus, for ``dedup_corpus``.
    """
    texts = [t.encode().split() for t in reference]
    if size > WINDOW_OVERLAP or sum(map(len, texts)) > most_words:
        raise ValueError(f"a window of over {WINDOW_OVERLAP} words, or a reference of over {most_words}; give it smaller doc_ids and use dedup_corpus")
    shipped = docs.sparkSession.sparkContext.broadcast(list(_shards(texts, SHARD_WORDS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                w = (text or b"").split()
                hit = np.zeros(len(w), dtype=bool)
                for x, y in _spans(shipped.value, w, size):
                    hit[x:y] = True
                out.append((doc, len(w), int(hit.sum()), b" ".join(x for x, h in zip(w, hit.tolist(), strict=True) if not h).decode()))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["doc_id", "n_words", "n_removed", "kept"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_corpus(read(spark, sf_dir, "documents", "doc_id", "text"))
