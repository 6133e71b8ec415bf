"""Near-duplicate documents: banded MinHash candidates, sequential Bayesian pruning, exact verification.

Documents of equal shingle sets form a class; only classes are compared. Classes that share a band of their signatures are
compared signature batch by signature batch: after each, a pair is dropped if its chance of reaching the wanted similarity
(under a uniform prior) is below the miss probability.

A band's bucket of any size is split into blocks. First each block is compared within itself and with a few leaders of its
bucket; of the pairs that survive, those that span the unit, most similar first, are verified on the full sets, each a row
with its two texts. That joins a group of copies, however large, by one pair less than it has classes. Where all classes of
a bucket are then in one component, or all spanning pairs of a small bucket end in one, its other pairs can add nothing.
In the other buckets the classes outside the bucket's largest component visit every block, and every surviving pair of
classes from different components is verified, with the texts of just these classes. So no link is lost, units of work are
bounded, rows grow with a bucket's size times its classes outside the largest component, and texts move once per pair that
may matter. Sets are compared by 128-bit hashes of shingles (see ``_words``).
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanework.llm import _base, _words
from lanework.llm._words import equal_runs

SHINGLE = 5
SIMILARITY = 80  # per cent
BANDS, BAND_ROWS = 24, 4
HASHES, BATCH = 128, 32
MISS = 1e-5
BLOCK = 128
#: Classes of a bucket of several blocks that all its blocks are compared with.
LEADERS = 8
U32, U64 = np.uint32, np.uint64


def keep_at(miss: float, similarity: float, hashes: int = HASHES, batch: int = BATCH) -> list[tuple[int, int]]:
    """(hashes compared, least matches to go on): below it, the posterior chance of the similarity is under ``miss``.

    With a uniform prior, P(s >= t | m of n match) = P(Binomial(n + 1, t) <= m). Signatures keep 8 bits of a hash, so
    unequal ones agree once in 256 times.
    """
    t = similarity + (1 - similarity) / 256
    out = []
    for n in range(batch, hashes + 1, batch):
        chance, m = 0.0, 0
        while m <= n:
            chance += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if chance >= miss:
                break
            m += 1
        out.append((n, m))
    return out


def shingles(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(high and low halves of the distinct shingles' hashes, text by text in ascending order, first shingle of each text with the total)."""
    codes, first = _words.hash_words(texts, lower=True)
    windows = _words.Windows(codes, first)
    counts = np.diff(first)
    short = np.flatnonzero((counts > 0) & (counts < size))
    starts = windows.starts(size)
    starts = np.concatenate([starts, first[short]])
    lengths = np.concatenate([np.full(len(starts) - len(short), size), counts[short]])
    high, low = (windows.hash(starts, lengths, half) for half in (0, 1))
    row = np.searchsorted(first, starts, "right") - 1
    order, fresh = equal_runs(high, low, row)
    kept = order[fresh]
    return high[kept], low[kept], np.searchsorted(row[kept], np.arange(len(texts) + 1))


def similar(n: int, m: int, both: int, similarity: int) -> bool:
    return 100 * both >= similarity * (n + m - both)


def common(high: np.ndarray, low: np.ndarray, first: np.ndarray, i: int, j: int) -> int:
    """Shingles that the sets i and j share."""
    a, b = slice(first[i], first[i + 1]), slice(first[j], first[j + 1])
    pair, half = np.concatenate([high[a], high[b]]), np.concatenate([low[a], low[b]])
    return int(len(pair) - equal_runs(pair, half)[1].sum())


def _family(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = _words.mix(np.arange(1, 2 * n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
    return (seeds[:n] >> U64(32)).astype(U32) | U32(1), (seeds[n:] >> U64(32)).astype(U32)


def signatures(docs: DataFrame, size: int = SHINGLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, key, n_shingles, cls, sig, bands) of every row; cls (128 bits of the set), sig and bands are null for empty sets."""

    def make():
        a, b = _family(HASHES)
        salt = _words.mix(np.arange(1, BANDS * BAND_ROWS + 1, dtype=U64)).reshape(BANDS, BAND_ROWS) | U64(1)

        def one(batch):
            out: dict[str, list] = {"n_shingles": [], "cls": [], "sig": [], "bands": []}
            texts = [x.encode() for x in batch.column(2).to_pylist()]
            for part in _words.chunks([len(x) for x in texts]):
                values, low, first = shingles(texts[part], size)
                counts = np.diff(first)
                full = np.flatnonzero(counts)
                at = first[:-1][full]
                short = (values >> U64(32)).astype(U32)
                sig = np.empty((len(full), HASHES), U32)
                if len(full):
                    for k in range(HASHES):
                        sig[:, k] = np.minimum.reduceat(short * a[k] + b[k], at)
                    cls = np.stack([np.add.reduceat(_words.mix(x ^ U64(0x51ED27)), at) for x in (values, low)], 1)
                    bands = _words.mix((sig[:, : BANDS * BAND_ROWS].astype(U64).reshape(-1, BANDS, BAND_ROWS) * salt).sum(2, dtype=U64)).view(np.int64)
                    small = (sig & U32(255)).astype(np.uint8)
                place = dict(zip(full.tolist(), range(len(full)), strict=True))
                for i, n in enumerate(counts.tolist()):
                    out["n_shingles"].append(n)
                    j = place.get(i)
                    out["cls"].append(None if j is None else cls[j].tobytes())
                    out["sig"].append(None if j is None else small[j].tobytes())
                    out["bands"].append(None if j is None else bands[j])
            return out | {"id": batch.column(0), "key": batch.column(1)}

        return one

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), _base.text_key(doc_id, text).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return _base.map_batches(rows, make, "id long, key long, n_shingles long, cls binary, sig binary, bands array<long>")


def bucketed(classes: DataFrame, block: int) -> DataFrame:
    """(band, cls, blocks, mine) of the bands that more than one class has: how many blocks, and which a class is in."""
    bands = classes.select("cls", F.explode("bands").alias("band"))
    shared = bands.groupBy("band").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.count("*").alias("n")).where("n > 1").drop("n")
    return bands.join(shared, "band").withColumn("mine", F.pmod(F.xxhash64("cls", F.lit(11)), F.col("blocks")).cast("int"))


def led_units(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(unit, side, cls, sig): each block's own rows (side 1), and the bucket's leaders from other blocks (side 0)."""
    own = rows.select(F.struct("band", F.col("mine").alias("i"), F.lit(0).alias("v")).alias("unit"), F.lit(1).alias("side"), "cls")
    first = Window.partitionBy("band").orderBy(F.xxhash64("cls", F.lit(17)), "cls")
    leaders = rows.where("blocks > 1").withColumn("place", F.row_number().over(first)).where(F.col("place") <= LEADERS)
    leaders = leaders.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("i <> mine")
    every = own.unionByName(leaders.select(F.struct("band", "i", F.lit(0).alias("v")).alias("unit"), F.lit(0).alias("side"), "cls"))
    return every.join(classes.select("cls", "sig"), "cls")


def visited_units(rows: DataFrame, classes: DataFrame, unsettled: DataFrame, block: int) -> DataFrame:
    """(unit, side, cls, sig, bands, root) of the unsettled bands, and of bands of several blocks with more than one component: each block with the classes outside the band's largest component as visitors (side 0), in parts of bounded size.

    rows: bucketed rows with root. Signatures join what is left of them.
    """
    sizes = rows.groupBy("band", "root").agg(F.count("*").alias("n"), F.first("blocks").alias("b"))
    bands = sizes.groupBy("band").agg(F.max_by("root", F.struct("n", "root")).alias("largest"), (F.sum("n") - F.max("n")).alias("others"), F.count("*").alias("roots"), F.first("b").alias("b"))
    marked = bands.join(unsettled.withColumn("open", F.lit(True)), "band", "left").where("open or (b > 1 and roots > 1)")
    marked = marked.select("band", "largest", F.greatest(F.ceil(F.col("others") / block), F.lit(1)).cast("int").alias("parts"))
    rows = rows.join(marked, "band")
    own = rows.withColumn("v", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns({"i": F.col("mine"), "side": F.lit(1)})
    visitors = rows.where("root <> largest and blocks > 1").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("i <> mine")
    visitors = visitors.withColumns({"v": F.pmod(F.xxhash64("cls", F.lit(13)), F.col("parts")).cast("int"), "side": F.lit(0)})
    kept = ("band", "i", "v", "side", "cls", "root")
    every = own.select(*kept).unionByName(visitors.select(*kept)).join(classes.select("cls", "sig", "bands"), "cls")
    return every.withColumn("unit", F.struct("band", "i", "v"))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of rows with equal first column, across batches."""
    held: list[pa.RecordBatch] = []
    name = None
    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.column(0).to_pylist()
        edges = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
        for a, b in zip(edges, edges[1:], strict=False):
            if held and names[a] != name:
                yield pa.Table.from_batches(held)
                held = []
            name = names[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


class Links:
    """Union-find over the rows of a unit."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def surviving_pairs(sig: np.ndarray, side: np.ndarray, bounds: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, matches) of the pairs of rows that pass every bound; of each pair one row at least is a block's own (side 1)."""
    left, right, matches = [], [], []
    own = np.flatnonzero(side == 1)
    guests = np.flatnonzero(side == 0)
    for place, i in enumerate(own.tolist()):
        j = np.concatenate([own[place + 1 :], guests])
        same, before = np.zeros(len(j), int), 0
        for upto, least in bounds:
            if not j.size:
                break
            same = same + (sig[j, before:upto] == sig[i, before:upto]).sum(1)
            keep = same >= least
            j, same, before = j[keep], same[keep], upto
        if j.size:
            left.append(np.full(len(j), i))
            right.append(j)
            matches.append(same)
    if not left:
        none = np.empty(0, int)
        return none, none, none
    left, right = np.concatenate(left), np.concatenate(right)
    return np.minimum(left, right), np.maximum(left, right), np.concatenate(matches)


def _unit_rows(table: pa.Table) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    names = table.column("cls").to_pylist()
    return names, np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(len(names), -1), np.array(table.column("side").to_pylist())


def _dealt(rows: DataFrame, *columns: str) -> DataFrame:
    width = _base.shuffle_width(rows.sparkSession)
    name = F.concat_ws(":", "unit.band", "unit.i", "unit.v").alias("name")
    return rows.select(name, "unit.band", *columns).repartition(width, "name").sortWithinPartitions("name", "cls")


def spanning_pairs(units: DataFrame, bounds: list[tuple[int, int]]) -> DataFrame:
    """(band, a, b): of each unit the surviving pairs that span it, most similar first, equally similar ones in one order everywhere."""
    arrow = pa.schema([("band", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])

    def run(batches):
        out: dict[str, list] = {"band": [], "a": [], "b": []}
        for table in _groups(batches):
            names, sig, side = _unit_rows(table)
            band = table.column("band")[0].as_py()
            links = Links(len(names))
            left, right, matches = surviving_pairs(sig, side, bounds)
            for k in np.lexsort((right, left, -matches)).tolist():  # rows stand in the order of their classes
                i, j = int(left[k]), int(right[k])
                if links.join(i, j):
                    for name, value in zip(out, (band, names[i], names[j]), strict=True):
                        out[name].append(value)
            if len(out["band"]) > 50_000:
                yield pa.RecordBatch.from_pydict(out, schema=arrow)
                out = {k: [] for k in out}
        yield pa.RecordBatch.from_pydict(out, schema=arrow)

    return _dealt(units, "cls", "sig", "side").mapInArrow(run, "band long, a binary, b binary")


def class_texts(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cls, text) of the wanted classes, by the row that stands for each. docs: (id, key, text); classes: (cls, id, key)."""
    rows = classes.join(wanted, "cls", "left_semi").select("cls", F.col("id").alias("c_id"), F.col("key").alias("c_key"))
    return docs.join(rows, (F.col("key") == F.col("c_key")) & F.col("id").eqNullSafe(F.col("c_id"))).dropDuplicates(["cls"]).select("cls", "text")


def verified(pairs: DataFrame, size: int, similarity: int) -> DataFrame:
    """(a, b) of the pairs (a, b, text_a, text_b) whose full sets are similar enough."""

    def make():
        def one(batch):
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            left, right = ([x.encode() for x in batch.column(k).to_pylist()] for k in (2, 3))
            good = []
            for part in _words.chunks([len(x) + len(y) for x, y in zip(left, right, strict=True)]):
                n = len(left[part])
                high, low, first = shingles(left[part] + right[part], size)
                sizes = np.diff(first)
                good += [part.start + i for i in range(n) if similar(sizes[i], sizes[n + i], common(high, low, first, i, n + i), similarity)]
            return {"a": [a[i] for i in good], "b": [b[i] for i in good]}

        return one

    return _base.map_batches(pairs.select("a", "b", "text_a", "text_b"), make, "a binary, b binary")


def _open_pairs(table: pa.Table, bounds: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Surviving pairs of rows of different components, in the first band only of those that both are in."""
    _, sig, side = _unit_rows(table)
    roots = np.unique(np.array(table.column("root").to_pylist(), object), return_inverse=True)[1]
    bands = np.array(table.column("bands").to_pylist(), np.int64)
    left, right, _ = surviving_pairs(sig, side, bounds)
    apart = roots[left] != roots[right]
    left, right = left[apart], right[apart]
    here = (bands[0] == table.column("band")[0].as_py()).argmax()
    first = np.concatenate([(bands[left[k : k + 4096]] == bands[right[k : k + 4096]]).argmax(1) for k in range(0, len(left), 4096)] or [left])
    return left[first == here], right[first == here]


OPEN = ("name", "band", "cls", "sig", "side", "bands", "root")


def open_rows(units: DataFrame, bounds: list[tuple[int, int]]) -> DataFrame:
    """(name, band, cls, sig, side, bands, root) of the rows of units that have a surviving pair with a class of another component."""

    def run(batches):
        for table in _groups(batches):
            rows = np.unique(np.concatenate(_open_pairs(table, bounds)))
            if rows.size:
                yield from table.take(pa.array(rows)).select(list(OPEN)).combine_chunks().to_batches()

    return _dealt(units, "cls", "sig", "side", "bands", "root").mapInArrow(run, "name string, band long, cls binary, sig binary, side int, bands array<long>, root binary")


def links_between(rows: DataFrame, bounds: list[tuple[int, int]], size: int, similarity: int) -> DataFrame:
    """(a, b): links that join the components of each unit's open rows (OPEN and text).

    A row's shingles are marked once and counted in all sets of the unit, so its pairs are verified together.
    """

    def run(batches):
        for table in _groups(batches):
            left, right = _open_pairs(table, bounds)
            names = table.column("cls").to_pylist()
            high, low, first = shingles([x.encode() for x in table.column("text").to_pylist()], size)
            order, fresh = equal_runs(high, low)
            ids = np.empty(len(high), np.int64)
            ids[order] = np.cumsum(fresh) - 1
            links, seen, found, sizes = Links(len(names)), {}, [], np.diff(first)
            for i, root in enumerate(table.column("root").to_pylist()):
                links.join(seen.setdefault(root, i), i)
            marked = np.zeros(len(high) + 1, bool)
            for i in np.unique(left).tolist():
                mine = ids[first[i] : first[i + 1]]
                marked[mine] = True
                both = np.add.reduceat(marked[ids], first[:-1], dtype=np.int64)
                marked[mine] = False
                others = right[left == i]
                for j in others[100 * both[others] >= similarity * (sizes[i] + sizes[others] - both[others])].tolist():
                    if links.join(i, j):
                        found.append((names[i], names[j]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)], names=["a", "b"])

    width = _base.shuffle_width(rows.sparkSession)
    return rows.select(*OPEN, "text").repartition(width, "name").sortWithinPartitions("name", "cls").mapInArrow(run, "a binary, b binary")


def linked_classes(docs: DataFrame, classes: DataFrame, size: int, similarity: int = SIMILARITY, miss: float = MISS, block: int = BLOCK) -> DataFrame:
    """(node, root): the classes that are linked with another one, and their component.

    docs: (id, key, text); classes: (cls, n_shingles, sig, bands, id, key).
    """
    bounds = keep_at(miss, similarity / 100)
    rows = bucketed(classes, block)
    spanning = _base.save(spanning_pairs(led_units(rows, classes), bounds), "spanning")
    pairs = spanning.select("a", "b").distinct()
    sizes = lambda c: classes.select(F.col("cls").alias(c), F.col("n_shingles").alias(f"n_{c}"))
    pairs = pairs.join(sizes("a"), "a").join(sizes("b"), "b").where(100 * F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b")).select("a", "b")
    pairs = _base.save(pairs, "pairs")
    wanted = pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct()
    texts = _base.save(class_texts(docs, classes, wanted), "texts")
    of = lambda c: texts.select(F.col("cls").alias(c), F.col("text").alias(f"text_{c}"))
    links = _base.save(verified(pairs.join(of("a"), "a").join(of("b"), "b"), size, similarity), "links")
    roots = _base.components(links, "links")
    at = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    apart = spanning.join(at("a"), "a", "left").join(at("b"), "b", "left").where("coalesce(root_a, a) <> coalesce(root_b, b)")
    unsettled = _base.save(apart.select("band").distinct(), "unsettled")
    for old in (pairs, texts, spanning):
        _base.release(old)
    placed = rows.join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    rows = _base.save(open_rows(visited_units(placed, classes, unsettled, block), bounds), "open")
    if rows.isEmpty():
        return roots
    texts = _base.save(class_texts(docs, classes, rows.select("cls").distinct()), "texts")
    more = _base.save(links_between(rows.join(texts, "cls"), bounds, size, similarity), "links")
    _base.release(texts)
    return roots if more.isEmpty() else _base.components(links.unionByName(more), "links")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, similarity: int = SIMILARITY, doc_id: str = "doc_id", text: str = "text", miss: float = MISS, block: int = BLOCK) -> DataFrame:
    """(doc_id, key, n_shingles, component_id, kept) of every row.

    Words are lower-cased (A-Z); a text of fewer words than a shingle has the whole sequence as its one shingle; null,
    empty and blank texts have no shingle and are linked with nothing. component_id is the smallest doc_id of a row's
    component; kept marks the rows that carry it. Null ids take part, but never name a component: such a row is kept only
    if its component has no id at all. Rows of equal id and text are all kept or none. key is xxhash64(doc_id, text). An
    empty table gives an empty result; further columns are not read.
    """
    spark = docs.sparkSession
    _base.small_batches(spark)
    sigs = _base.save(signatures(docs, size, doc_id, text), "signatures")
    full = sigs.where("cls is not null")
    classes = full.groupBy("cls").agg(F.min(F.struct("id", "key")).alias("row"), *(F.first(c).alias(c) for c in ("n_shingles", "sig", "bands")))
    classes = _base.save(classes.select("cls", "n_shingles", "sig", "bands", "row.id", "row.key"), "classes")
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), _base.text_key(doc_id, text).alias("key"), F.col(text).alias("text"))
    roots = linked_classes(rows, classes, size, similarity, miss, block)
    least = full.groupBy("cls").agg(F.min("id").alias("least"))
    placed = least.join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    named = placed.join(placed.groupBy("root").agg(F.min("least").alias("component_id")), "root").select(F.col("cls").alias("of_cls"), "component_id")
    out = sigs.join(named, F.col("cls") == F.col("of_cls"), "left")
    component = F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias("doc_id"), "key", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("id"), component.isNull()).alias("kept"))
