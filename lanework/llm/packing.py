"""Packing documents into fixed windows: a histogram of lengths, non-negative least squares over shallow combinations, a greedy rest.

Documents are cut only where they are longer than a window, so whole windows stand alone and only remainders are combined.
All solving happens on the histogram (at most window / bin_width counts, however many documents there are); documents are
then dealt to the solved slots by their rank within their bin, which Spark computes from per-task counts.
"""

from __future__ import annotations

import re
import struct
import zlib
from itertools import combinations_with_replacement

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanework.llm import _base

WINDOW = 4096
BIN_WIDTH = 16
#: Entries of a worker's tables of pieces and of odd words; beyond it a table starts anew.
CACHE_PIECES, CACHE_WORDS = 300_000, 50_000


def byte_letters() -> list[str]:
    """The printable letter that a byte-level vocabulary writes for each byte: printable Latin-1 stands for itself, others follow from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class _Pieces(dict):
    """Ids of pieces, looked up or made by the merge table."""

    def __init__(self, tokenize):
        super().__init__()
        self.tokenize, self.letters = tokenize, byte_letters()

    def __missing__(self, piece: str) -> bytes:
        tokens = self.tokenize("".join(map(self.letters.__getitem__, piece.encode())))
        found = self[piece] = struct.pack(f"<{len(tokens)}I", *(t.id for t in tokens))
        return found


class WordBpe:
    """Ids of texts as little-endian uint32 bytes.

    The vocabulary's normaliser and splitter never look across ASCII white space. A text of printable ASCII, Latin-1
    letters (normalised already, lower-cased letter by letter) and ASCII white space is split by the splitter's own pattern
    and looked up piece by piece. Any other text is taken word by word: its plain words likewise, the others are left to
    the tokenizer whole.
    """

    PLAIN = re.compile(r"[\x21-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
    OTHER = re.compile(r"[^\x21-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff\x20\x09-\x0d]|<\|")
    SPLIT = re.compile(r"[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|[^\sa-z0-9\xdf-\xf6\xf8-\xff]+")

    def __init__(self, path: str, end_id: int):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end = np.array([end_id], "<u4").tobytes()
        self.known: dict[bytes, bytes] = {}
        self.pieces = _Pieces(self.tokenizer.model.tokenize)

    def plain(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.SPLIT.findall(text.lower())))

    def by_words(self, texts: list[str]) -> list[bytes]:
        split = [x.encode().split() for x in texts]
        known, plain = self.known, self.PLAIN.fullmatch
        if len(known) > CACHE_WORDS:
            known.clear()
        rest = []
        for word in set().union(*split).difference(known):
            text = word.decode()
            if plain(text) and "<|" not in text:
                known[word] = self.plain(text)
            else:
                rest.append(word)
        for i in range(0, len(rest), 20_000):
            part = rest[i : i + 20_000]
            for word, found in zip(part, self.tokenizer.encode_batch_fast([x.decode() for x in part], add_special_tokens=False), strict=True):
                known[word] = np.array(found.ids, "<u4").tobytes()
        return [b"".join(map(known.__getitem__, words)) for words in split]

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        if len(self.pieces) > CACHE_PIECES:
            self.pieces.clear()
        other = self.OTHER.search
        out = [None if x and other(x) else self.plain(x or "") for x in texts]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, found in zip(rest, self.by_words([texts[i] for i in rest]), strict=True):
            out[i] = found
        return [x + self.end for x in out]


_encoders: dict[tuple[str, int], WordBpe] = {}


def encoder_of(path: str, end_id: int) -> WordBpe:
    """One encoder, with what it has learnt, for all tasks of a worker process."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = WordBpe(path, end_id)
    return _encoders[path, end_id]


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 2, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text", bin_width: int = BIN_WIDTH) -> DataFrame:
    """Pieces of every document's ids: whole windows, then the remainder.

    (doc_id, start, length, ids_crc32, doc_tokens, bin, task, rank): rank counts the pieces of a bin within a task. A null
    text counts as empty: one piece that holds the closing id alone. Null ids and equal rows are ordinary rows.
    """

    def make():
        encoder = encoder_of(tokenizer_path, end_id)
        task, seen = TaskContext.get().partitionId(), np.zeros(-(-window // bin_width) + 1, np.int64)

        def one(batch):
            out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "bin", "task", "rank")}
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode_many(batch.column(1).to_pylist()), strict=True):
                n = len(ids) // 4
                for start in range(0, n, window):
                    length = min(window, n - start)
                    slot = -(-length // bin_width)
                    for name, value in zip(out, (doc, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n, slot, task, int(seen[slot])), strict=True):
                        out[name].append(value)
                    seen[slot] += 1
            return out

        return one

    return _base.map_batches(docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")), make, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bin int, task long, rank long")


def _solved(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least squares over the columns in use: their normal equations where they hold, else by singular values."""
    gram = a.T @ a
    try:
        found = np.linalg.solve(gram, a.T @ b)
        if np.abs(a.T @ (b - a @ found)).max() <= 1e-9 * max(1.0, np.abs(b).max()):
            return found
    except np.linalg.LinAlgError:
        pass
    return np.linalg.lstsq(a, b, rcond=None)[0]


def nonnegative_least_squares(options: np.ndarray, b: np.ndarray, settled: float = 1e-9, rounds: int = 2000) -> np.ndarray:
    """Active-set solution of min |ax - b| with x >= 0, where row j of ``options`` names the rows in which column j of a has ones.

    A row named twice counts twice; -1 names none. a itself is never formed: gains are sums of residuals, and only the
    columns in use (at most as many as b has rows) are solved densely. A round takes in the column of largest gain and
    those of at least half of it that share no row with one taken; after a round that gained nothing, the first alone.
    Where that gains nothing either, the solution is reached up to rounding. ``settled`` is the gain that is left alone: a column of
    ones gains that much in residual for each repeat.
    """
    n, rows = len(options), len(b)
    x, passive = np.zeros(n), np.zeros(n, bool)
    before, alone = np.inf, False
    for _ in range(rounds):
        residual = np.append(b, 0.0)
        used = np.flatnonzero(passive)
        if used.size:
            np.subtract.at(residual, options[used].ravel(), np.repeat(x[used], options.shape[1]))
        residual[rows] = 0
        error = float(residual @ residual)
        if error > before * (1 - 1e-9):
            if alone:
                break
            alone = True
        else:
            alone = False
        before = min(before, error)
        gain = residual[options].sum(1)
        gain[passive] = -np.inf
        if passive.all() or gain.max() <= settled:
            break
        taken: set[int] = set()
        top = np.flatnonzero(gain >= max(settled, gain.max() / 2))
        for j in top[np.argsort(-gain[top], kind="stable")].tolist():
            mine = set(options[j].tolist()) - {-1}
            if taken.isdisjoint(mine):
                passive[j] = True
                taken |= mine
            if alone:
                break
        while True:
            at = np.flatnonzero(passive)
            a = np.zeros((rows + 1, at.size))
            np.add.at(a, (options[at].ravel(), np.repeat(np.arange(at.size), options.shape[1])), 1)
            solved = _solved(a[:rows], b)
            if solved.min() > 0:
                x[:] = 0
                x[at] = solved
                break
            bad = solved <= 0
            old = x[at]
            step = np.min(old[bad] / np.maximum(old[bad] - solved[bad], 1e-300))
            x[at] = old + step * (solved - old)
            x[at[x[at] <= 1e-12]] = 0
            passive &= x > 0
            if not passive.any():
                break
    return x


def combinations(slots: int, present: np.ndarray, depth: int = 3) -> list[tuple[int, ...]]:
    """Combinations of at most ``depth`` occurring bins that fill the window exactly."""
    bins = np.flatnonzero(present).tolist()
    have = set(bins)
    found = []
    for size in range(1, depth + 1):
        for head in combinations_with_replacement(bins, size - 1):
            last = slots - sum(head)
            if last in have and (not head or last >= head[-1]):
                found.append((*head, last))
    return found


def solve_patterns(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(combination of bins, how often it is used), together using up the histogram exactly.

    histogram[i]: pieces of bin i; the last bin is the window. Least-squares repeat counts are rounded down to what the
    histogram still has; the rest is packed greedily, largest bin first, each time as often as the counts allow.
    """
    slots = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    patterns: list[tuple[tuple[int, ...], int]] = []
    if left[slots]:
        patterns.append(((slots,), int(left[slots])))
        left[slots] = 0
    options = combinations(slots, left > 0)
    if options:
        table = np.full((len(options), max(map(len, options))), -1, np.int16)
        for j, option in enumerate(options):
            table[j, : len(option)] = option
        repeats = nonnegative_least_squares(table, left.astype(float), settled=0.5)
        for j in np.argsort(-repeats):
            if repeats[j] < 0.5:
                break
            option = options[j]
            times = min(round(float(repeats[j])), *(int(left[i]) // option.count(i) for i in option))
            if times > 0:
                patterns.append((option, times))
                for i in option:
                    left[i] -= times
    while left.any():
        space, chosen = slots, []
        remaining = left.copy()
        top = int(np.flatnonzero(remaining)[-1])
        while top:
            take = int(min(space // top, remaining[top]))
            if take:
                chosen += [top] * take
                remaining[top] -= take
                space -= take * top
            fits = np.flatnonzero(remaining[: min(space, top - 1) + 1])
            top = int(fits[-1]) if fits.size and fits[-1] > 0 else 0
        times = min(int(left[i]) // chosen.count(i) for i in set(chosen))
        patterns.append((tuple(chosen), times))
        for i in chosen:
            left[i] -= times
    return patterns


def pack(pieces: DataFrame, window: int = WINDOW, bin_width: int = BIN_WIDTH) -> DataFrame:
    """Sequence and place of every piece: the columns of pieces but (bin, task, rank), with sequence_id and offset.

    Pieces of a sequence stand gapless from offset 0. An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    pieces = _base.save(pieces, "pieces")
    counts = pieces.groupBy("bin", "task").agg(F.count("*").alias("n"))
    offsets = counts.select("bin", "task", (F.sum("n").over(Window.partitionBy("bin").orderBy("task")) - F.col("n")).alias("before"))
    slots = -(-window // bin_width)
    histogram = np.zeros(slots + 1, np.int64)
    for row in pieces.groupBy("bin").agg(F.count("*").alias("n")).collect():  # at most window / bin_width rows
        histogram[row["bin"]] = row["n"]
    table, sequence = [], 0
    used = np.zeros(slots + 1, np.int64)
    for option, times in solve_patterns(histogram):
        for place, i in enumerate(option):
            table.append((int(i), int(used[i]), int(used[i] + times), sequence, place))
            used[i] += times
        sequence += times
    slot = "struct<rank_from:long,rank_to:long,sequence_from:long,place:int>"
    by_bin: dict[int, list] = {}
    for i, *rest in table:
        by_bin.setdefault(i, []).append(tuple(rest))
    slot_rows = spark.createDataFrame(list(by_bin.items()), f"bin int, slots array<{slot}>")  # as short as the histogram
    ranked = pieces.join(offsets, ["bin", "task"]).withColumn("rank", F.col("rank") + F.col("before"))
    mine = F.filter("slots", lambda s: (F.col("rank") >= s["rank_from"]) & (F.col("rank") < s["rank_to"]))[0]
    placed = ranked.join(F.broadcast(slot_rows), "bin").withColumn("slot", mine).select("*", (F.col("slot.sequence_from") + F.col("rank") - F.col("slot.rank_from")).alias("sequence_id"), F.col("slot.place").alias("place"))
    before = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
