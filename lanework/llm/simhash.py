"""Near-duplicate documents by SimHash, found through tables of distances to reference fingerprints.

A fingerprint's row of the table holds its Hamming distances to reference fingerprints. Two fingerprints that differ in d bits
differ by at most d in every column, so a pair with a larger difference in some column is discarded unseen; what is left is
verified bit by bit. The references are of two kinds. The columns of the empty fingerprint and of those with one bit tell the
bits themselves, so two rows are equal over the columns of a block of bits exactly where the block is equal; they deal the work
out: of ``bits + 1`` blocks a linked pair is equal in one at least, so only fingerprints of one block value, a bucket, meet.
``REFERENCES`` scattered fingerprints make the table that each unit of work precomputes and filters by.

Only distinct fingerprints are dealt, so exact copies cost nothing, and only links that span a unit are kept: at most one per
fingerprint. A bucket of more than ``MOST`` fingerprints is cut into tiles, which also meet a few leaders of the bucket. That
joins a dense group whatever its size; afterwards only fingerprints outside the bucket's largest component still have to meet
the other tiles. If those are many, the bucket is dealt anew by blocks of its remaining bits (the same argument holds there),
up to ``LEVELS`` times; else, and at the last level, they visit every tile in parts of bounded size. No link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanework.llm import _base, _words

SHINGLE = 5
SEED = 42
#: Fingerprints that differ in at most so many bits are linked.
BITS = 4
REFERENCES = 32
MOST, LEADERS, LEVELS = 4096, 8, 3
U64, I64 = np.uint64, np.int64
REFERENCE_TABLE = _words.mix(np.arange(1, REFERENCES + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
#: Columns looked at one after the other: most pairs end at the first few.
COLUMNS = (slice(0, 4), slice(4, 12), slice(12, REFERENCES))


def fingerprint_bits(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, I64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(((2 * counts > len(hashes)).astype(U64) << np.arange(64, dtype=U64)).sum(dtype=U64))


def fingerprint(text: str, size: int) -> int:
    words = text.encode().lower().split()
    joined, size = b" ".join(words), min(size, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - [len(w) for w in words]
    hashed, n = xxhash.xxh64_intdigest, len(words) - size + 1 if words else 0
    return fingerprint_bits(np.fromiter((hashed(joined[s:e], SEED) for s, e in zip(starts[:n].tolist(), ends[size - 1 :].tolist(), strict=False)), U64, n))


def fingerprints(docs: DataFrame, size: int = SHINGLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp long) of every row; a text of fewer words than a shingle has the whole sequence as its one shingle, one without words 0."""

    def make():
        return lambda batch: {"id": batch.column(0), "fp": np.array([fingerprint(x or "", size) for x in batch.column(1).to_pylist()], U64).view(I64)}

    return _base.map_batches(docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")), make, "id long, fp long")


def block_masks(parts: int, levels: int) -> list[list[int]]:
    """For each level the masks of the bits that a bucket's fingerprints share; the children of mask i at the next are i * parts and following."""

    def children(mask: int) -> list[int]:
        free = [b for b in range(64) if not mask >> b & 1]
        return [mask | sum(1 << int(b) for b in block) for block in np.array_split(free, parts)]

    out = [children(0)]
    for _ in range(levels):
        out.append([m for mask in out[-1] for m in children(mask)])
    return out


def _dealt(rows: DataFrame, masks: list[int], parts: int) -> DataFrame:
    """(path, key, fp): rows (path, fp) with one bucket for each mask below their path; one key may stand for two buckets, which costs time only."""
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    table = F.array(*[F.lit(m) for m in signed]).cast("array<bigint>")
    below = rows.select("fp", "path", F.posexplode(F.slice(table, F.col("path") * parts + 1, parts)).alias("i", "mask"))
    path = (F.col("path") * parts + F.col("i")).cast("int")
    return below.select(path.alias("path"), F.xxhash64(path, F.col("fp").bitwiseAND(F.col("mask")), F.lit(len(masks))).alias("key"), "fp")


def _sized(rows: DataFrame, most: int) -> DataFrame:
    """rows of buckets with more than one fingerprint, with their number of tiles and the tile of each."""
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / most).cast("int").alias("tiles"))
    return rows.join(sizes, "key").withColumn("tile", F.pmod(F.xxhash64("fp", F.lit(11)), F.col("tiles")).cast("int"))


def _led(rows: DataFrame) -> DataFrame:
    """(unit, fp): every tile with the leaders of its bucket."""
    unit = lambda tile: F.xxhash64("key", tile, F.lit(0)).alias("unit")
    first = Window.partitionBy("key").orderBy(F.xxhash64("fp", F.lit(17)), "fp")
    leaders = rows.where("tiles > 1").withColumn("place", F.row_number().over(first)).where(F.col("place") <= LEADERS)
    leaders = leaders.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).where("to <> tile")
    return rows.select(unit("tile"), "fp").unionByName(leaders.select(unit("to"), "fp"))


def _visited(rows: DataFrame, most: int) -> DataFrame:
    """(unit, fp): every tile with those of its bucket's fingerprints from other tiles that are outside the bucket's largest component, in parts."""
    rows = rows.withColumn("parts", F.greatest(F.ceil(F.col("others") / most), F.lit(1)).cast("int"))
    unit = lambda tile, part: F.xxhash64("key", tile, part, F.lit(1)).alias("unit")
    own = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(unit("tile", "part"), "fp")
    outside = rows.where("root <> largest").withColumn("to", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).where("to <> tile")
    part = F.pmod(F.xxhash64("fp", F.lit(13)), F.col("parts")).cast("int")
    return own.unionByName(outside.select(unit("to", part), "fp"))


def distance_table(fps: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps[:, None] ^ REFERENCE_TABLE).astype(np.int8)


def spanning_links(fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): links that span every component of these fingerprints.

    Each fingerprint looks once for its neighbours among those that no component has yet.
    """
    table, left, right = distance_table(fps), [], []
    free = np.arange(len(fps))
    while free.size:
        stack, free = [free[0]], free[1:]
        while stack and free.size:
            i, near = stack.pop(), np.arange(len(free))
            for columns in COLUMNS:
                near = near[(np.abs(table[free[near], columns] - table[i, columns]) <= bits).all(1)]
                if not near.size:
                    break
            near = near[np.bitwise_count(fps[free[near]] ^ fps[i]) <= bits]
            if near.size:
                found = free[near]
                left.append(np.full(len(found), i))
                right.append(found)
                stack.extend(found.tolist())
                free = np.delete(free, near)
    none = np.empty(0, I64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _unit_links(units: DataFrame, bits: int) -> DataFrame:
    """(a, b): links that span each unit's fingerprints. A unit may straddle Arrow batches; it is bounded, so it is held until it ends."""
    arrow = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_unit, held = np.empty(0, I64), np.empty(0, I64)

        def links(names: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            edges = [*np.flatnonzero(np.diff(names, prepend=names[0] - 1)).tolist(), len(names)] if len(names) else [0]
            a, b = [np.empty(0, I64)], [np.empty(0, I64)]
            for s, e in zip(edges, edges[1:], strict=False):
                if e - s > 1:
                    i, j = spanning_links(fps[s:e].view(U64), bits)
                    a.append(fps[s:e][i])
                    b.append(fps[s:e][j])
            return pa.RecordBatch.from_arrays([np.concatenate(a), np.concatenate(b)], schema=arrow)

        for batch in batches:
            names, fps = (np.concatenate([x, np.asarray(batch.column(k))]) for k, x in enumerate((held_unit, held)))
            last = int(np.searchsorted(names, names[-1])) if len(names) else 0
            yield links(names[:last], fps[:last])
            held_unit, held = names[last:], fps[last:]
        yield links(held_unit, held)

    width = _base.shuffle_width(units.sparkSession)
    return units.repartition(width, "unit").sortWithinPartitions("unit", "fp").mapInArrow(run, "a long, b long")


def linked(fps: DataFrame, bits: int = BITS, most: int = MOST, levels: int = LEVELS) -> DataFrame:
    """(node, root): the fingerprints that are linked with another one, and one fingerprint of their component. fps: distinct values in a column fp."""
    parts = bits + 1
    masks = block_masks(parts, levels)
    rows, edges, done = _dealt(fps.select("fp", F.lit(0).alias("path")), masks[0], parts), [], []
    for level in range(levels + 1):
        rows = _base.save(_sized(rows, most), "buckets")
        done.append(rows)
        edges.append(_base.save(_unit_links(_led(rows), bits), "links"))
        tiled = rows.where("tiles > 1")
        if tiled.isEmpty():
            break
        roots = _base.components(_union(edges), "links")
        placed = tiled.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        sizes = placed.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("largest"), (F.sum("n") - F.max("n")).alias("others"))
        left = _base.save(placed.join(sizes.where("others > 0"), "key"), "open")
        done += [roots, left]
        few = F.lit(level == levels) | (F.col("others") <= most)
        edges.append(_base.save(_unit_links(_visited(left.where(few), most), bits), "links"))
        many = left.where(~few)
        if level == levels or many.isEmpty():
            break
        rows = _dealt(many.select("fp", "path"), masks[level + 1], parts)
    found = _base.components(_union(edges), "links")
    for old in (*done, *edges):
        _base.release(old)
    return found


def _union(edges: list[DataFrame]) -> DataFrame:
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e)
    return out


def near_duplicates(docs: DataFrame, size: int = SHINGLE, bits: int = BITS, doc_id: str = "doc_id", text: str = "text", most: int = MOST, levels: int = LEVELS) -> DataFrame:
    """(doc_id, fingerprint, component_id, kept) of every row.

    Words are lower-cased (A-Z); a text of fewer words than a shingle has the whole sequence as its one shingle; null, empty and
    blank texts have fingerprint zero and are linked like any other. component_id is the smallest doc_id of a row's component;
    kept marks the rows that carry it. Null ids take part, but never name a component: such a row is kept only if its
    component has no id at all. Equal rows have equal results, one each. An empty table gives an empty result; further columns
    are not read.
    """
    found = _base.save(fingerprints(docs, size, doc_id, text), "fingerprints")
    least = _base.save(found.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    roots = linked(least, bits, most, levels)
    placed = least.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = placed.join(placed.groupBy("root").agg(F.min("least").alias("component_id")), "root").select(F.col("fp").alias("of_fp"), "component_id")
    out = found.join(named, F.col("fp") == F.col("of_fp"), "left")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return out.select(F.col("id").alias("doc_id"), hexed.alias("fingerprint"), "component_id", F.coalesce(F.col("component_id") == F.col("id"), F.col("component_id").isNull()).alias("kept"))
