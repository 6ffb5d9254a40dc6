"""Near copies for stages on word shingles: SimHash and MinHash nominate pairs, exact Jaccard similarity decides.

Two documents are near copies if their sets of ``SHINGLE``-word shingles have a Jaccard similarity of ``LEAST`` (4/5) or
more. Fingerprints of the sets that multi-index hashing finds within a few bits (see ``simhash``) are one source of
pairs. At a similarity of 0.8 fingerprints differ by about 10 of 64 bits, and balls of that radius are too large to look
up, so MinHash bands are the other: a pair at 0.8 shares one of ``BANDS`` bands of ``ROWS`` minima with probability
1 - (1 - 0.8^5)^20 = 0.9996, closer pairs with more. All pairs are verified on the whole sets.

Equal sets collapse first. The members of a band are compared with its least one; where that leaves a band in several
components, all of its pairs in different ones are compared too: in a small band as rows, in a crowded one block by
block in numpy, where only a spanning forest of the links leaves a task. So rows grow with the documents, not with the
square of a group.

Defined results: words and case as in SimHash; texts of under five words have one shingle, the whole text; wordless or
null texts are copies of each other; rows that repeat a doc_id belong to one document; an empty table gives an empty
result; other columns play no part, whatever their names; texts are read whole, whatever their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import local_ids, mixed, word_hashes
from .common import fresh, spill
from .components import connected_components
from .simhash import _LOWER, majority
from .simhash import links as fingerprint_links

SHINGLE, LEAST = 5, (4, 5)
BANDS, ROWS = 20, 5
CROWDED, BLOCK_SHINGLES = 64, 500_000
_SEEDS = np.random.default_rng(11).integers(1, 1 << 63, size=(2, BANDS * ROWS), dtype=np.uint64)


def shingles(texts: list[bytes | None]) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    ids, n, words = local_ids([(t or b"").translate(_LOWER).split() for t in texts])
    h = word_hashes(words)[0][ids] if len(words) else np.zeros(0, dtype=np.uint64)
    out, at = [], 0
    for size in n.tolist():
        w, at = h[at : at + size], at + size
        count = min(size, 1) if size <= SHINGLE else size - SHINGLE + 1
        key = np.full(count, min(size, SHINGLE), dtype=np.uint64)
        for k in range(min(size, SHINGLE)):
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + w[k : k + count])
        out.append(np.unique(key))
    return out


def bands(s: np.ndarray) -> list[int]:
    """One hash a band; an empty set has none."""
    if not len(s):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(s), 2048):
        x = (s[i : i + 2048, None] ^ _SEEDS[0]) * (_SEEDS[1] | np.uint64(1))
        least = np.minimum(least, (x ^ (x >> np.uint64(32))).min(axis=0))
    return [xxhash.xxh3_64_intdigest(b.tobytes()) - (1 << 63) for b in least.reshape(BANDS, ROWS)]


def near(inter: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray | bool:
    """Whether a Jaccard similarity is LEAST or more, in whole numbers."""
    return LEAST[1] * inter >= LEAST[0] * (a + b - inter)


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = shingles(b.column(1).cast(pa.binary()).to_pylist())
        columns = [pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([bands(s) for s in sets], pa.list_(pa.int64())), pa.array(np.array([majority(s) for s in sets], dtype=np.uint64).view(np.int64))]
        yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["doc_id", "digest", "n", "bands", "fp"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in shingles(b.column(1).cast(pa.binary()).to_pylist())], pa.binary())], names=["node", "s"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = []
        for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
            inter = min(len(x), len(y))
            keep.append(bool(near(inter, len(x), len(y))) and bool(near(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _forest(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect what near pairs connect."""
    size = np.array([len(s) for s in sets])
    tokens = np.split(np.unique(np.concatenate(sets), return_inverse=True)[1], np.cumsum(size)[:-1])
    mark, unseen, out = np.zeros(int(size.sum()) + 1, dtype=bool), np.ones(len(sets), dtype=bool), []

    def like(one: int, many: np.ndarray) -> np.ndarray:
        mark[tokens[one]] = True
        inter = np.add.reduceat(mark[np.concatenate([tokens[k] for k in many])].astype(np.int64), np.cumsum(size[many]) - size[many])
        mark[tokens[one]] = False
        return near(inter, size[one], size[many])

    for root in range(len(sets)):
        if not unseen[root]:
            continue
        unseen[root], frontier = False, np.array([root])
        while len(frontier) and unseen.any():
            rest = np.flatnonzero(unseen)
            if len(frontier) < len(rest):
                found = np.zeros(len(rest), dtype=bool)
                for x in frontier:
                    if not found.all():
                        found[~found] = like(x, rest[~found])
            else:
                found = np.array([like(y, frontier).any() for y in rest])
            frontier = rest[found]
            unseen[frontier] = False
            out += [(root, k) for k in frontier.tolist()]
    return out


def _block_links(table: pa.Table) -> pa.Table:
    node = table["node"].to_numpy()
    links = np.array(_forest([np.frombuffer(s, dtype=np.uint64) for s in table["s"].to_pylist()]), dtype=np.int64).reshape(-1, 2)
    return pa.table({"a": pa.array(node[links[:, 0]]), "b": pa.array(node[links[:, 1]])})


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id and component_id of each document; null doc_ids are left out."""
    docs = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id IS NOT NULL")
    prints = spill(docs.mapInArrow(_prints, "doc_id long, digest binary, n long, bands array<long>, fp long"), "shingled")
    nodes = spill(prints.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("fp").alias("fp")), "sets")
    keys = nodes.select("node", "n", F.posexplode("bands").alias("band", "val"))
    shared = keys.groupBy("band", "val").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("m"), F.sum("n").alias("total")).where("m > 1")
    members = spill(keys.join(shared, ["band", "val"]), "members")
    prints_of = spill(nodes.groupBy("fp").agg(F.min("node").alias("node")), "prints")
    equal = nodes.select(F.col("node").alias("a"), "fp").join(prints_of.withColumnRenamed("node", "b"), "fp").where("a <> b").select("a", "b")
    close = spill(fingerprint_links(prints_of).union(equal).distinct(), "close")
    wanted = members.select("node").union(close.select("a")).union(close.select("b")).distinct()
    sets = spill(docs.join(wanted, docs["doc_id"] == wanted["node"]).select("node", "text").distinct().mapInArrow(_sets, "node long, s binary"), "shingles")

    def verified(pairs: DataFrame) -> DataFrame:
        """Links among pairs (a, b)."""
        x, y = sets.select(F.col("node").alias("a"), F.col("s").alias("x")), sets.select(F.col("node").alias("b"), F.col("s").alias("y"))
        return pairs.distinct().join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_verified, "a long, b long")

    links = spill(verified(members.where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).union(close)), "pivots")
    same = nodes.join(prints.select("digest", "doc_id").distinct(), "digest").where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    parts = connected_components(links)
    placed = members.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    split = placed.groupBy("band", "val").agg(F.min("component").alias("c"), F.max("component").alias("d")).where("c <> d").select("band", "val")
    left = spill(placed.where("m > 2").join(split, ["band", "val"]), "split")
    few = left.where(F.col("m") <= CROWDED).select("band", "val", "node", "component")
    other = few.select("band", "val", F.col("node").alias("b"), F.col("component").alias("other"))
    links = links.union(verified(few.join(other, ["band", "val"]).where("node < b AND component <> other").select(F.col("node").alias("a"), "b")))
    many = left.where(F.col("m") > CROWDED)
    if not many.isEmpty():
        blocks = F.ceil(F.col("total") / BLOCK_SHINGLES).cast("int")
        place = F.pmod(F.xxhash64("node"), F.col("k")).cast("int")
        dealt = many.withColumn("k", blocks).withColumn("i", place).withColumn("j", F.explode(F.expr("sequence(0, k - 1)")))
        dealt = dealt.select("band", "val", "node", F.least("i", "j").alias("bi"), F.greatest("i", "j").alias("bj")).join(sets, "node")
        links = links.union(dealt.groupBy("band", "val", "bi", "bj").applyInArrow(_block_links, "a long, b long"))
    parts = connected_components(links.union(same))
    found = prints.select("doc_id").distinct().join(parts, F.col("doc_id") == F.col("node"), "left")
    return found.select("doc_id", F.coalesce("component", "doc_id").alias("component_id"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """Of each component the document with the smallest doc_id stays. Rows with a null doc_id stay."""
    name = fresh(docs, "gone")
    gone = spill(near_copies(docs).where("component_id <> doc_id").select(F.col("doc_id").alias(name)), "copies")
    return docs.join(gone, docs["doc_id"] == gone[name], "left_anti")
