"""Removal of passages that occur more than once, by level-wise doubling of repeated windows.

The levels are window lengths, each twice the one before, up to the wanted length. A window goes to the next level only if
its start at this level occurs elsewhere too; the last level decides. At the first level not every position needs to be
asked: of the positions at which a shorter window lies inside a wanted window, the one of least hash stands for it (equal
wanted windows have the same one), so one or two positions in ten are exchanged. ``longest_repeats`` goes on doubling from
the wanted length until no candidate survives.

Texts are dealt out once, into a bucketed table, and each level joins them where they lie. A level is one exchange of
hashes: tasks hash the candidate windows of their texts, drop what repeats within a batch to one message, and send messages
to buckets of hashes; a bucket tells which of its hashes came more than once, and whence. So a passage that stands in a
third of all texts costs a message per batch, not one per text. Windows are compared by 128 bits (see ``_words``).
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanework.llm import _base, _words

WINDOW = 35
#: Length at the first level: 9 doubles to 18, and to the wanted 35.
BASE = 9
I64, U64 = np.int64, np.uint64
#: Bytes of texts hashed at once.
CHUNK_BYTES = 2 << 20
#: Bytes of text whose candidates share a bucket (about a sixth as many bytes of hashes at a level).
BUCKET_BYTES = 32 << 20


def level_lengths(window: int, base: int) -> list[int]:
    lengths = [max(1, min(base, window))]
    while lengths[-1] < window:
        lengths.append(min(window, 2 * lengths[-1]))
    return lengths


def least_in_window(values: np.ndarray, width: int) -> np.ndarray:
    """For each i, the first index of the least of values[i : i + width] (cut at the end of the array)."""
    n = len(values)
    best, at, reach = values.copy(), np.arange(n), 1

    def take(best, at, other_best, other_at, shift):
        m = n - shift
        better = other_best[shift:] < best[:m]
        out_best, out_at = best.copy(), at.copy()
        out_best[:m][better] = other_best[shift:][better]
        out_at[:m][better] = other_at[shift:][better]
        return out_best, out_at

    while reach < width:
        shift = min(reach, width - reach)
        if shift < n:
            best, at = take(best, at, best, at, shift)
        reach += shift
    return at


def anchors(windows: _words.Windows, base: int, window: int, inner: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts of all wanted windows, the position that stands for each): the least base window that starts at most window - inner further on."""
    wanted = windows.starts(window)
    if not wanted.size:
        return wanted, wanted
    every = np.arange(windows.n)
    fits = every + base <= windows.end
    values = np.full(windows.n, np.iinfo(np.uint64).max, np.uint64)
    values[fits] = windows.hash(every[fits], base) >> np.uint64(1)
    return wanted, least_in_window(values, window - inner + 1)[wanted]


def pack_rows(*arrays: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.array([len(arrays[0])], I64).tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def unpack_rows(data: bytes, *kinds) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    n, at, out = int(np.frombuffer(raw, I64, 1)[0]), 8, []
    for kind in kinds:
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def _candidates(windows: _words.Windows, lengths: list[int], level: int, wanted_level: int, alive: np.ndarray | None) -> np.ndarray:
    """Starts of the windows to ask about at a level; alive marks the positions that the level before kept."""
    window = lengths[wanted_level]
    if level > wanted_level:
        starts = np.flatnonzero(alive)
        return starts[starts + lengths[level] <= windows.end[starts]]
    if wanted_level == 0:
        return windows.starts(window)
    wanted, stands = anchors(windows, lengths[0], window, lengths[wanted_level - 1])
    if level == wanted_level:
        return wanted[alive[stands]]
    found = np.unique(stands)
    return found if alive is None else found[alive[found]]


def _messages(docs: DataFrame, lengths: list[int], level: int, wanted_level: int, buckets: int) -> DataFrame:
    """Rows (bucket, own, payload): hashes of candidates with their addresses, and what is known to repeat already.

    docs: (id0, key, text, kept): kept holds the positions of the level before (null at the first).
    """

    def make():
        def one(batch):
            ids, keys = (np.asarray(batch.column(k)).astype(I64) for k in (0, 1))
            texts = [(x or "").encode() for x in batch.column(2).to_pylist()]
            kept = batch.column(3).to_pylist()
            out: dict[str, list] = {"bucket": [], "own": [], "payload": []}
            for part in _words.chunks([len(x) for x in texts], CHUNK_BYTES):
                codes, first = _words.hash_words(texts[part])
                windows = _words.Windows(codes, first)
                alive = None
                if level:
                    alive = np.zeros(windows.n, bool)
                    for at, positions in zip(first, kept[part], strict=False):
                        alive[np.frombuffer(positions, np.uint32).astype(I64) + at] = True
                starts = _candidates(windows, lengths, level, wanted_level, alive)
                if not starts.size:
                    continue
                high, low = (windows.hash(starts, lengths[level], half) for half in (0, 1))
                row = np.searchsorted(first, starts, "right") - 1
                place = (starts - first[row]).astype(np.uint32)
                row = row + part.start
                order, fresh = _words.equal_runs(high, low)
                sizes = np.diff(np.append(np.flatnonzero(fresh), len(order)))
                twice = np.zeros(len(order), bool)
                twice[order] = np.repeat(sizes > 1, sizes)
                if twice.any():  # known here already: told to the others once, without an address
                    out["bucket"].append(int(high[0] % U64(buckets)))
                    out["own"].append(True)
                    out["payload"].append(pack_rows(ids[row[twice]], keys[row[twice]], place[twice]))
                index = np.sort(order[fresh])
                bucket = (high[index] % U64(buckets)).astype(I64)
                by_bucket = np.argsort(bucket, kind="stable")
                cuts = np.flatnonzero(np.diff(bucket[by_bucket], prepend=-1))
                for a, b in zip(cuts, np.append(cuts[1:], len(by_bucket)), strict=True):
                    at = index[by_bucket[a:b]]
                    out["bucket"].append(int(bucket[by_bucket[a]]))
                    out["own"].append(False)
                    out["payload"].append(pack_rows(high[at], low[at], ~twice[at], ids[row[at]], keys[row[at]], place[at]))
            return out

        return one

    return _base.map_batches(docs, make, "bucket long, own boolean, payload binary")


def _repeated(messages: DataFrame, parts: int) -> DataFrame:
    """Rows (part, payload): addresses (id, key, place) of candidates whose hash came more than once, dealt by key."""

    def emit(out, ids, keys, place):
        part = (keys.view(U64) % U64(parts)).astype(I64)
        order = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.diff(part[order], prepend=-1))
        for a, b in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
            mine = order[a:b]
            out["part"].append(int(part[mine[0]]))
            out["payload"].append(pack_rows(ids[mine], keys[mine], place[mine]))

    def run(table: pa.Table) -> pa.Table:
        out: dict[str, list] = {"part": [], "payload": []}
        own = table.column("own").to_pylist()
        payloads = table.column("payload").to_pylist()
        for o, p in zip(own, payloads, strict=True):
            if o:
                emit(out, *unpack_rows(p, I64, I64, np.uint32))
        got = [unpack_rows(p, U64, U64, bool, I64, I64, np.uint32) for o, p in zip(own, payloads, strict=True) if not o]
        if got:
            high, low, lone, ids, keys, place = (np.concatenate(x) for x in zip(*got, strict=True))
            order, fresh = _words.equal_runs(high, low)
            sizes = np.diff(np.append(np.flatnonzero(fresh), len(order)))
            again = np.zeros(len(high), bool)
            again[order] = np.repeat(sizes > 1, sizes)
            # A lone hash that another batch sent (once or as known to repeat) repeats; known ones were answered by their own batch.
            again &= lone
            if again.any():
                emit(out, ids[again], keys[again], place[again])
        return pa.table({"part": pa.array(out["part"], pa.int64()), "payload": pa.array(out["payload"], pa.binary())})

    return messages.groupBy("bucket").applyInArrow(run, "part long, payload binary")


def _by_text(repeated: DataFrame) -> DataFrame:
    """(id0, key, kept binary): positions of each text, ascending uint32."""

    def run(table: pa.Table) -> pa.Table:
        ids, keys, place = (np.concatenate(x) for x in zip(*(unpack_rows(p, I64, I64, np.uint32) for p in table.column("payload").to_pylist()), strict=True))
        order = np.lexsort((place, ids, keys))
        ids, keys, place = ids[order], keys[order], place[order]
        edges = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])]))
        ends = np.append(edges[1:], len(keys))
        return pa.table({"id0": ids[edges], "key": keys[edges], "kept": pa.array([np.unique(place[a:b]).tobytes() for a, b in zip(edges, ends, strict=True)], pa.binary())})

    return repeated.groupBy("part").applyInArrow(run, "id0 long, key long, kept binary")


def dealt(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, int]:
    """(table of id0, key and docs' columns as c0, c1, ...; its number of buckets): the table lies in buckets of (key, id0).

    Null ids are 0 there; rows of equal id and text share both. The buckets follow the volume of text.
    """
    spark = docs.sparkSession
    volume = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(_base.shuffle_width(spark), -(-volume // BUCKET_BYTES))
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(0)).alias("id0"), _base.text_key(doc_id, text).alias("key"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)))
    name = f"lanework_texts_{uuid.uuid4().hex}"
    writer = rows.repartition(buckets, "key", "id0").write.bucketBy(buckets, "key", "id0").sortBy("key", "id0")
    writer.option("compression", "zstd").option("path", _base.scratch(spark, "texts")).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the frame knows its files and buckets; they go with the scratch folder
    return table, buckets


def _levels(rows: DataFrame, buckets: int, text: str, lengths: list[int], wanted_level: int):
    """(length, (id0, key, kept) of the positions whose window of that length repeats), level by level, until none is left."""
    rows, kept = rows.select("id0", "key", F.col(text).alias("text")), None
    for level, length in enumerate(lengths):
        asked = rows.withColumn("kept", F.lit(None).cast("binary")) if kept is None else rows.join(kept, ["key", "id0"]).select("id0", "key", "text", "kept")
        kept = _base.save(_by_text(_repeated(_messages(asked, lengths, level, wanted_level, buckets), buckets)), f"windows{length}")
        yield length, kept
        if kept.isEmpty():
            return


def repeated_windows(rows: DataFrame, buckets: int, text: str, window: int = WINDOW, base: int = BASE) -> DataFrame:
    """(id0, key, kept): for every row of a dealt table that has some, the word positions at which a window begins that begins elsewhere too."""
    lengths = level_lengths(window, base)
    kept, before = None, None
    for _, kept in _levels(rows, buckets, text, lengths, len(lengths) - 1):
        if before is not None:
            _base.release(before)
        before = kept
    return kept


def longest_repeats(docs: DataFrame, window: int = WINDOW, base: int = BASE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, longest): the greatest of window, 2 * window, 4 * window, ... words that some passage of a row shares with another place; 0 if none.

    Null ids stay null; rows of equal id and text share their result. An empty table gives an empty result.
    """
    _base.small_batches(docs.sparkSession)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows, buckets = dealt(docs, "doc_id", "text")
    lengths = level_lengths(window, base)
    wanted = len(lengths) - 1
    longest = rows.agg(F.max(F.size(F.split("c1", r"[\x20\x09-\x0D]+")))).first()[0] or 0
    while lengths[-1] * 2 <= longest:
        lengths.append(lengths[-1] * 2)
    found = None
    for length, kept in _levels(rows, buckets, "c1", lengths, wanted):
        if length >= window:
            part = kept.select("id0", "key", F.lit(length).alias("length"))
            found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select(F.col("c0").alias("doc_id"), F.lit(0).alias("longest"))
    best = found.groupBy("key", "id0").agg(F.max("length").alias("longest"))
    return rows.join(best, ["key", "id0"], "left").select(F.col("c0").alias("doc_id"), F.coalesce("longest", F.lit(0)).alias("longest"))


def covered(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Which of n words lie in a window that begins at one of the starts."""
    steps = np.zeros(n + 1, np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + window, n), -1)
    return np.cumsum(steps[:n]) > 0


def _kept_words(text: str, kept: bytes | None, window: int) -> tuple[int, list[bytes]]:
    words = text.encode().split()
    if kept is None:
        return len(words), words
    gone = covered(len(words), np.frombuffer(kept, np.uint32).astype(I64), window)
    return len(words), [words[i] for i in np.flatnonzero(~gone).tolist()]


def remove_repeats(docs: DataFrame, window: int = WINDOW, base: int = BASE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(docs' columns, n_words, n_removed): texts without the words of any window that occurs more than once.

    A text that loses no word stays as it is; others become their kept words joined by blanks. A null text has no words
    and stays null. Windows are judged on the input; equal rows repeat each other wholly. An empty table gives an empty
    result. Columns of the two new names are replaced.
    """
    from pyspark.sql.types import StructType

    docs = docs.drop("n_words", "n_removed")
    names = docs.columns
    joined, place = with_positions(docs, window, base, doc_id, text), names.index(text)
    schema = StructType(joined.schema.fields[:-1] + StructType.fromDDL("n_words long, n_removed long").fields)

    def run(batches):
        for batch in batches:
            texts, counts, removed = [], [], []
            for x, kept in zip(batch.column(place).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                n, words = _kept_words(x or "", kept, window)
                counts.append(n)
                removed.append(n - len(words))
                texts.append(b" ".join(words).decode() if removed[-1] else x)
            columns = list(batch.columns)[:-1]
            columns[place] = pa.array(texts, columns[place].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(removed, pa.int64())], names=schema.names)

    done = joined.mapInArrow(run, schema)
    return done.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)), "n_words", "n_removed")


def digests(docs: DataFrame, window: int = WINDOW, base: int = BASE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256): as remove_repeats, with the kept words hashed where they are made."""

    def make():
        def one(batch):
            out: dict[str, list] = {"n_words": [], "n_removed": [], "kept_sha256": []}
            for x, kept in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                n, words = _kept_words(x or "", kept, window)
                for name, value in zip(out, (n, n - len(words), hashlib.sha256(b" ".join(words)).hexdigest()), strict=True):
                    out[name].append(value)
            return out | {"doc_id": batch.column(0)}

        return one

    joined = with_positions(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), window, base, "doc_id", "text")
    return _base.map_batches(joined, make, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def with_positions(docs: DataFrame, window: int, base: int, doc_id: str, text: str) -> DataFrame:
    """docs' columns as c0, c1, ... and last the positions (binary, null if none) of their repeated windows."""
    _base.small_batches(docs.sparkSession)
    rows, buckets = dealt(docs, doc_id, text)
    kept = repeated_windows(rows, buckets, f"c{docs.columns.index(text)}", window, base)
    return rows.join(kept, ["key", "id0"], "left").select(*(f"c{i}" for i in range(len(docs.columns))), "kept")
