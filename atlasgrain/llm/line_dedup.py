"""Line dedup by a deletion-neighbourhood join.

Two lines match if they have the same words, or if both have ``near_words`` words or more (so that one word is at most a
fifth of a line: a similarity of 0.8) and one word changed, added or dropped turns one into the other. Lines without
words are left alone. A line goes if an earlier line of the corpus (by doc_id, then line number) matches it; lines are
judged on the input, not on what is left. ``edits=0`` asks for equal lines only; larger bounds than 1 are refused.

1. Every line is hashed (128 bits); the earliest place of each distinct line is a plain aggregate.
2. A line can only be one edit from another if they share a first or a last half, up to one word of length. Distinct
   lines of which no half occurs elsewhere are done; the others are candidates.
3. For a candidate all variants with one word deleted are emitted as (hash of the variant, place of the deletion), and
   the line itself. Equal variants at equal places mean one changed word; a variant equal to a whole line means one
   added word. That verifies the distance, and each group needs only its earliest member: links grow with the rows,
   never with the square of a group.

A line, half or variant that very many share is reduced where it is read (partial aggregates); joins on it have one row
for it on one side, and adaptive execution splits the other. Texts move compressed.

Defined results: null or empty text has no lines; of two places with the same doc_id and line number none repeats the
other, so rows that repeat a doc_id count as one document whose lines are seen again; rows with a null doc_id are left
alone and remove nothing; an empty table gives an empty result; other columns play no part, whatever their names. Work
on a text is linear in its length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, read, slices, spill

NEAR_WORDS = 5
_digest, _short = xxhash.xxh3_128_digest, xxhash.xxh3_64_intdigest


def _halves(w: list[bytes]) -> list[int]:
    """Keys of which two lines within one word share one.

    For the longer length m of a pair: its first (m - 1) // 2 words, or the last ones that with those make m - 1. A line
    of n words is in pairs with m = n and m = n + 1.
    """
    n = len(w)
    out = [_short(b" ".join(w[:k]), 2 * k) for k in {(n - 1) // 2, n // 2}]
    out += [_short(b" ".join(w[n - k :]), 2 * k + 1) for k in {n - 1 - (n - 1) // 2, n - n // 2}]
    return [x - (1 << 64) if x >= 1 << 63 else x for x in out]


def _columns(digests: list[bytes]) -> list[pa.Array]:
    """128-bit digests as two columns of longs."""
    both = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
    return [pa.array(np.ascontiguousarray(both[:, k])) for k in (0, 1)]


def _lines(batches: Iterator[pa.RecordBatch], near_words: int | None) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        doc, no, line, keys = [], [], [], []
        for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
            for k, x in enumerate((t or b"").split(b"\n")):
                if w := x.split():
                    doc.append(i), no.append(k), line.append(_digest(b" ".join(w))), keys.append(_halves(w) if near_words and len(w) >= near_words else [])
        yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(no, pa.int32()), *_columns(line), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "line_no", "h1", "h2", "keys"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=3).compress
    for b in slices(batches):
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if t is None else squeeze(t) for t in b.column(1).cast(pa.binary()).to_pylist()], pa.binary())], names=["doc_id", "packed"])


def _unpack(data: bytes | None) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data) if data else b""


def _variants(batches: Iterator[pa.RecordBatch], near_words: int) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        doc, no, place, variant = [], [], [], []
        for i, t, wanted in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            lines = _unpack(t).split(b"\n")
            for k in wanted:
                w = lines[k].split() if k < len(lines) else []
                if len(w) < near_words:
                    continue
                doc += [i] * (len(w) + 1)
                no += [k] * (len(w) + 1)
                place += range(-1, len(w))
                joined, at = b" ".join(w), 0
                variant.append(_digest(joined))
                for x in w:
                    end = at + len(x) + 1
                    variant.append(_digest(joined[:at] + joined[end:] if end <= len(joined) else joined[: max(at - 1, 0)]))
                    at = end
        yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(no, pa.int32()), pa.array(place, pa.int32()), *_columns(variant)], names=["doc_id", "line_no", "place", "h1", "h2"])


def repeated_lines(docs: DataFrame, edits: int = 1, near_words: int = NEAR_WORDS) -> DataFrame:
    """doc_id, line_no, of_doc and of_line: each line that goes, and the earliest line that it repeats."""
    if edits not in (0, 1) or near_words < 1:
        raise ValueError("edits is 0 or 1, near_words 1 or more")
    docs = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id IS NOT NULL")
    at = F.struct("doc_id", "line_no")
    lines = spill(docs.mapInArrow(lambda batches: _lines(batches, near_words if edits else None), "doc_id long, line_no int, h1 long, h2 long, keys array<long>"), "lines")
    first = spill(lines.groupBy("h1", "h2").agg(F.min(at).alias("at"), F.count(F.lit(1)).alias("n"), F.first("keys").alias("keys")), "distinct")
    repeated = first.where("n > 1").select("h1", "h2", F.col("at").alias("one"))
    exact = lines.select("doc_id", "line_no", "h1", "h2").join(repeated, ["h1", "h2"]).select(at.alias("at"), "one").where("at > one")
    out = exact
    if edits:
        # rows stay narrow: flat columns, counts in place of least and greatest members (a line has a key once)
        halves = first.select(F.explode("keys").alias("key"), "at.doc_id", "at.line_no")
        shared = halves.groupBy("key").count().where("count > 1").select("key")
        wanted = halves.join(shared, "key", "left_semi").groupBy("doc_id").agg(F.collect_set("line_no").alias("wanted"))
        packed = docs.mapInArrow(_pack, "doc_id long, packed binary").join(wanted, "doc_id").select("doc_id", "packed", "wanted")
        variants = spill(packed.mapInArrow(lambda batches: _variants(batches, near_words), "doc_id long, line_no int, place int, h1 long, h2 long"), "variants")
        whole, cut = variants.where("place < 0").select("h1", "h2", at.alias("one")), variants.where("place >= 0")
        changed = cut.groupBy("h1", "h2", "place").agg(F.min(at).alias("one"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        cut = cut.select("h1", "h2", "place", at.alias("at"))
        pairs = cut.join(changed, ["h1", "h2", "place"]).where("at > one").select("at", "one")
        added = cut.join(whole, ["h1", "h2"]).select("at", "one")
        near = pairs.union(added.where("at > one")).union(added.where("at < one").select(F.col("one").alias("at"), F.col("at").alias("one")))
        out = out.union(near.groupBy("at").agg(F.min("one").alias("one")))
    return out.select("at.doc_id", "at.line_no", F.col("one.doc_id").alias("of_doc"), F.col("one.line_no").alias("of_line")).distinct()


def _without(text: str, gone: str) -> F.Column:
    """The text without the lines numbered in an array column; a null or empty array leaves it as it is."""
    # by place, not by looking each line up: linear in a text of many lines; transform(array(x), f) binds x once
    places = lambda p: F.array_except(F.sequence(F.lit(0), F.size(p) - 1), F.col(gone))
    kept = F.transform(F.array(F.split(F.col(text), "\n")), lambda p: F.transform(places(p), lambda k: F.get(p, k)))[0]
    return F.when(F.size(gone) > 0, F.array_join(kept, "\n")).otherwise(F.col(text))


def drop_lines(docs: DataFrame, edits: int = 1, near_words: int = NEAR_WORDS) -> DataFrame:
    """``docs`` with the repeated lines cut out of their text; all rows and columns stay."""
    doc, gone = fresh(docs, "doc"), fresh(docs, "gone")
    cut = repeated_lines(docs, edits, near_words).groupBy(F.col("doc_id").alias(doc)).agg(F.collect_set("line_no").alias(gone))
    joined = docs.join(cut, docs["doc_id"] == cut[doc], "left")
    return joined.withColumn("text", _without("text", gone)).select(*[f"`{c}`" for c in docs.columns])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        counts, kept = [], []
        for t, gone in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            lines, out = _unpack(t).split(b"\n"), {x["line"] for x in gone}
            counts.append((len(lines), len(gone)))
            kept.append(hashlib.sha256(b"\n".join([x for k, x in enumerate(lines) if k not in out])).hexdigest())
        n = np.array(counts, dtype=np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n[:, 0]), pa.array(n[:, 1]), b.column(2), pa.array(kept, pa.string())], names=["doc_id", "n_lines", "n_removed", "removed", "kept_sha256"])


_REMOVED = "array<struct<line:int,of_doc:bigint,of_line:int>>"


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (sorted array of line, of_doc, of_line), kept_sha256."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    gone = repeated_lines(docs).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("line_no").alias("line"), "of_doc", "of_line"))).alias("removed"))
    packed = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_pack, "doc_id long, packed binary")
    joined = packed.join(gone, "doc_id", "left").select("doc_id", "packed", F.coalesce("removed", F.expr(f"cast(array() as {_REMOVED})")).alias("removed"))
    return joined.mapInArrow(_digests, f"doc_id long, n_lines long, n_removed long, removed {_REMOVED}, kept_sha256 string")
