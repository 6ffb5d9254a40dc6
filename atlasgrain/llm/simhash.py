"""SimHash near-dedup by multi-index hashing.

A 64-bit fingerprint is cut into segments of 21, 21 and 22 bits. Two fingerprints that differ in at most 4 bits differ
in at most 1 bit of the first, or at most 1 of the second, or in none of the third (otherwise 2 + 2 + 1 bits differ).
So every fingerprint is stored under its three segment values and looks up the Hamming balls of radius 1, 1 and 0;
since of two different values exactly one has a 0 at the highest bit that differs, only that one looks the other up.
What is found is verified on the whole 64 bits. Copies collapse into one fingerprint first. For more fingerprints than
segments of 21 bits tell apart there are two of 32 bits, with balls of radius 2 and 1 (otherwise 3 + 2 bits differ).

A segment value that over ``CROWDED`` fingerprints share is not joined: its rows are cut into blocks, each pair of
blocks is compared with numpy, and only a spanning forest of the links found leaves it. So links grow with the rows,
not with the square of a group, and no task holds an unbounded group.

Defined results: null or wordless text has fingerprint zero, and such documents link like any others; texts under four
words hash as one shingle; rows that repeat a doc_id belong to one document; a null doc_id gets the component of equal
fingerprints, null if no other row has one; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, read, spill
from .components import connected_components

SHINGLE = 4
MOST_BITS = 4
#: Up to so many fingerprints three segments serve; beyond, their values would be crowded and two wider ones do.
THREE_SEGMENTS = 1 << 26
CROWDED = 64
BLOCK = 4096
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: bytes | None) -> int:
    """The SimHash of one UTF-8 text, as an unsigned number."""
    w = (text or b"").translate(_LOWER).split()
    if not w:
        return 0
    if len(w) <= SHINGLE:
        h = np.array([xxhash.xxh64_intdigest(b" ".join(w), 42)], dtype=np.uint64)
    else:
        joined = b" ".join(w)
        ends = np.cumsum(np.fromiter(map(len, w), dtype=np.int64, count=len(w)) + 1) - 1
        starts = np.concatenate(([0], ends[:-SHINGLE] + 1))
        digest = xxhash.xxh64_intdigest
        h = np.array([digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)], dtype=np.uint64)
    return majority(h)


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of some 64-bit hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 1 << 15):
        part = np.ascontiguousarray(h[i : i + (1 << 15)]).astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << k for k in np.flatnonzero(2 * ones > len(h)).tolist())


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        prints = np.fromiter((fingerprint(t) for t in b.column(1).cast(pa.binary()).to_pylist()), dtype=np.uint64, count=b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long) for each row."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_fingerprints, "doc_id long, fp long")


def _forest(t: np.ndarray, p: np.ndarray) -> list[tuple[int, int]]:
    """Links (place in t, or len(t) + place in p) that connect what pairs within MOST_BITS connect, each node once."""
    sides, links, offset = (t, p), [], (0, len(t))
    unseen = [np.ones(len(t), dtype=bool), np.ones(len(p), dtype=bool)]
    for root in range(len(t)):
        if not unseen[0][root]:
            continue
        unseen[0][root] = False
        pending = [(t[root : root + 1], 1)]
        while pending:
            frontier, side = pending.pop()
            rest = np.flatnonzero(unseen[side])
            found = np.zeros(len(rest), dtype=bool)
            for i in range(0, len(frontier), 256):
                found |= (np.bitwise_count(frontier[i : i + 256, None] ^ sides[side][rest][None, :]) <= MOST_BITS).any(axis=0)
            if found.any():
                new = rest[found]
                unseen[side][new] = False
                links += [(root, x) for x in (new + offset[side]).tolist()]
                pending.append((sides[side][new], 1 - side))
    return links


def _block_links(table: pa.Table) -> pa.Table:
    kind = table["probe"].to_numpy()
    fp, node = table["fp"].to_numpy().view(np.uint64), table["node"].to_numpy()
    node = np.concatenate([node[kind == 0], node[kind == 1]])
    links = _forest(fp[kind == 0], fp[kind == 1])
    a, b = np.array([x for x, _ in links], dtype=np.int64), np.array([y for _, y in links], dtype=np.int64)
    return pa.table({"a": pa.array(node[a].astype(np.int64)), "b": pa.array(node[b].astype(np.int64))})


def segments(n: int) -> list[tuple[int, int, int]]:
    """Shift, width and radius of the segments for n fingerprints. Radii plus one add up to MOST_BITS + 1, so that two
    fingerprints within MOST_BITS are within the radius in some segment."""
    return [(0, 21, 1), (21, 21, 1), (42, 22, 0)] if n <= THREE_SEGMENTS else [(0, 32, 2), (32, 32, 1)]


def _ball(width: int, radius: int) -> str:
    """All masks of 1 to ``radius`` bits, with their highest bits."""
    masks = [sum(1 << k for k in c) for r in range(1, radius + 1) for c in itertools.combinations(range(width), r)]
    return "array(" + ", ".join(f"named_struct('m', {m}L, 't', {1 << (m.bit_length() - 1)}L)" for m in masks) + ")"


def _segment(shift: int, width: int) -> str:
    return f"(shiftrightunsigned(fp, {shift}) & {(1 << width) - 1}L)"


def links(prints: DataFrame) -> DataFrame:
    """Links (a, b) between nodes; ``prints`` has one row (node, fp) for each distinct fingerprint."""
    cut = segments(prints.count())
    stored = prints.selectExpr("node", "fp", "explode(array(" + ", ".join(f"named_struct('seg', {k}, 'val', {_segment(s, w)})" for k, (s, w, _) in enumerate(cut)) + ")) as k").select("node", "fp", "k.seg", "k.val")
    balls = []
    for k, (s, w, radius) in enumerate(cut):
        val = _segment(s, w)
        balls.append(f"array(named_struct('seg', {k}, 'val', {val}, 'own', true))")
        if radius:
            balls.append(f"transform(filter({_ball(w, radius)}, x -> ({val} & x.t) = 0L), x -> named_struct('seg', {k}, 'val', {val} ^ x.m, 'own', false))")
    looks = prints.selectExpr("node", "fp", f"explode(concat({', '.join(balls)})) as k").select("node", "fp", "k.seg", "k.val", "k.own")
    crowded = spill(stored.groupBy("seg", "val").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWDED), "crowded")
    near = F.bit_count(F.expr("t.fp ^ p.fp")) <= MOST_BITS
    plain = (
        stored.join(crowded, ["seg", "val"], "left_anti").alias("t")
        .join(looks.alias("p"), (F.col("t.seg") == F.col("p.seg")) & (F.col("t.val") == F.col("p.val")) & near & (~F.col("p.own") | F.expr("t.fp < p.fp")))
        .select(F.col("t.node").alias("a"), F.col("p.node").alias("b"))
    )
    if crowded.isEmpty():
        return plain
    looked = looks.join(crowded, ["seg", "val"])
    sizes = spill(looked.groupBy("seg", "val").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("m")).select("seg", "val", F.ceil(F.col("n") / BLOCK).cast("int").alias("nt"), F.ceil(F.col("m") / BLOCK).cast("int").alias("np")), "blocks")
    place = lambda n: F.pmod(F.xxhash64("fp", "node"), F.col(n)).cast("int")
    rows = (
        stored.join(sizes, ["seg", "val"]).withColumns({"bi": place("nt"), "bj": F.explode(F.expr("sequence(0, np - 1)")), "probe": F.lit(0)})
        .select("seg", "val", "bi", "bj", "probe", "fp", "node")
        .union(looks.join(sizes, ["seg", "val"]).withColumns({"bj": place("np"), "bi": F.explode(F.expr("sequence(0, nt - 1)")), "probe": F.lit(1)}).select("seg", "val", "bi", "bj", "probe", "fp", "node"))
    )
    return plain.union(rows.groupBy("seg", "val", "bi", "bj").applyInArrow(_block_links, "a long, b long"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for each row of ``docs``."""
    prints = spill(fingerprints(docs), "prints")
    distinct = spill(prints.groupBy("fp").agg(F.min("doc_id").alias("node")), "distinct")
    parts = connected_components(links(distinct.where("node IS NOT NULL")))
    named = spill(distinct.join(parts, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id")), "named")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_representatives(docs: DataFrame) -> DataFrame:
    """One document of each component stays: the one with the smallest doc_id. Rows with a null doc_id stay."""
    name = fresh(docs, "gone")
    gone = near_duplicates(docs).where("component_id <> doc_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, docs["doc_id"] == gone[name], "left_anti")


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"))
