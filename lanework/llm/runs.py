"""Periodic runs in texts, by minimizers of several scales.

A run is a stretch of words in which words q apart are identical, for its smallest q, of at least ``max(MIN_WORDS,
MIN_PERIODS * q)`` words, which no word before or after extends. Periods below ``LAGS`` are found by comparing the text with
itself at each lag. The others belong to scales: a scale of k words stands for the periods from 2k/3 to k. At such a scale
every window of about k/3 neighbouring places has a minimizer, the place whose next k words hash least. Inside a run of
period q the windows q apart hold the same words, so minimizers repeat q apart; and as k words cover a whole period, the same
k words begin nowhere between. So of each run some minimizer and the next one of equal hash are exactly q apart. Such pairs
are seeds: they are extended to both sides word by word, and the stretch is kept if it is long enough and none of the
divisors of q is a period of it too. A seed says that k + q words have period q, so seeds without a run are few, and the work
is a small multiple of the text's length times the number of its scales. A hash only proposes; words decide.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanework.llm import _base, _words

MIN_WORDS, MIN_PERIODS = 24, 3
#: Periods below this are found by lag scans; the first scale begins here.
LAGS = 12
U64 = np.uint64


def sliding(ufunc: np.ufunc, values: np.ndarray, width: int) -> np.ndarray:
    """ufunc (minimum or maximum) over values[i : i + width], for every i at which that many follow."""
    n = len(values)
    if n < width:
        return values[:0]
    tiled = np.concatenate([values, np.full(-n % width, values[-1])]).reshape(-1, width)
    ahead = ufunc.accumulate(tiled, axis=1).ravel()
    behind = ufunc.accumulate(tiled[:, ::-1], axis=1)[:, ::-1].ravel()
    return ufunc(behind[: n - width + 1], ahead[width - 1 : n])


def scales(longest: int, first: int) -> list[tuple[int, int]]:
    """(least period, words of a minimizer) of the scales for periods up to ``longest``; a scale's greatest period is its number of words."""
    out, least = [], first
    while least <= longest:
        out.append((least, 3 * least // 2))
        least = out[-1][1] + 1
    return out


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _words.mix(a * U64(0x9E3779B97F4A7C15) + _words.mix(b + U64(0x632BE59BD9B4E019)))


class Stretches:
    """Hashes of 1, 2, 4, ... words at every place, each made of two of the size before."""

    def __init__(self, ids: np.ndarray):
        self.power, self.hashes = 1, _words.mix(ids.astype(U64) + U64(1))

    def of(self, k: int) -> np.ndarray:
        """Hashes of the k words from each place at which so many follow; k must not fall from call to call."""
        while self.power * 2 <= k:
            self.hashes = _joined(self.hashes[: -self.power], self.hashes[self.power :]) if len(self.hashes) > self.power else self.hashes[:0]
            self.power *= 2
        m = len(self.hashes) - (k - self.power)
        return _joined(self.hashes[:m], self.hashes[k - self.power :]) if m > 0 else self.hashes[:0]


def equal_from(ids: np.ndarray, i: int, lag: int, step: int) -> int:
    """How many places from i on (step 1) or before i (step -1) have the same word as the place ``lag`` further on."""
    n, total, width = len(ids), 0, 64
    while True:
        a, b = (i + total, min(i + total + width, n - lag)) if step > 0 else (max(0, i - total - width), i - total)
        if a >= b:
            return total
        apart = ids[a:b] != ids[a + lag : b + lag]
        if apart.any():
            return total + int((apart if step > 0 else apart[::-1]).argmax())
        total += b - a
        width *= 2


def _prime_factors(q: int) -> list[int]:
    out, f = [], 2
    while f * f <= q:
        if q % f == 0:
            out.append(f)
            while q % f == 0:
                q //= f
        f += 1
    return out + [q] * (q > 1)


def is_smallest(ids: np.ndarray, start: int, length: int, q: int) -> bool:
    """Whether a stretch of period q and at least two periods has no smaller one; it would divide q."""
    return not any(np.array_equal(ids[start : start + length - d], ids[start + d : start + length]) for d in (q // f for f in _prime_factors(q)))


def _lag_stretches(ids: np.ndarray, q: int) -> list[tuple[int, int]]:
    """(start, length) of the stretches of period q that are long enough."""
    if len(ids) <= q:
        return []
    same = np.zeros(len(ids) - q + 2, np.int8)
    same[1:-1] = ids[q:] == ids[:-q]
    edges = np.diff(same)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    long = ends - starts + q >= max(MIN_WORDS, MIN_PERIODS * q)
    return [(s, e - s + q) for s, e in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]


def _seeded_stretches(ids: np.ndarray, hashes: np.ndarray, least: int, k: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the stretches that the minimizers of a scale lead to."""
    width = 2 * least - k + 1
    lowest = sliding(np.minimum, hashes, width)
    if not len(lowest):
        return []
    # A place is a minimizer if one of the windows that hold it has its hash as least one.
    edge = np.zeros(width - 1, U64)
    places = np.flatnonzero(sliding(np.maximum, np.concatenate([edge, lowest, edge]), width) >= hashes)
    order = places[np.argsort(hashes[places], kind="stable")]
    lag = order[1:] - order[:-1]
    seeds = (hashes[order[1:]] == hashes[order[:-1]]) & (lag >= least) & (lag <= k)
    at, lag = order[:-1][seeds], lag[seeds]
    out, end, before = [], 0, 0
    for j in np.lexsort((at, lag)).tolist():
        i, q = int(at[j]), int(lag[j])
        if q == before and i + q < end:
            continue
        back = equal_from(ids, i, q, -1)
        start, before = i - back, q
        end = i + equal_from(ids, i, q, 1) + q
        out.append((start, end - start, q))
    return [(s, n, q) for s, n, q in out if n >= max(MIN_WORDS, MIN_PERIODS * q)]


def runs_of(ids: np.ndarray, longest: int | None = None) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period. ids: one number per distinct word; longest: words of the longest text in them."""
    longest = len(ids) if longest is None else longest
    found = [(s, n, q) for q in range(1, min(LAGS - 1, longest // MIN_PERIODS) + 1) for s, n in _lag_stretches(ids, q)]
    stretches = Stretches(ids)
    for least, k in scales(longest // MIN_PERIODS, LAGS):
        found += _seeded_stretches(ids, stretches.of(k), least, k)
    return sorted({x for x in found if is_smallest(ids, *x)}, key=lambda x: (x[0], x[2]))


def runs_of_texts(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each of some texts, given as words. All are searched together: a word's number holds its text's, so nothing repeats across texts."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    sizes = np.array([len(w) for w in texts], np.int64)
    limits = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(sizes, out=limits[1:])
    ids = np.empty(limits[-1], np.int64)
    for t, words in enumerate(texts):
        codes: dict[bytes, int] = {}
        ids[limits[t] : limits[t + 1]] = [codes.setdefault(w, len(codes)) for w in words]
    ids += np.repeat(np.arange(len(texts), dtype=np.int64) << 32, sizes)
    # Texts of like length together, so that the scales of long ones do not run over short ones.
    classes = np.ceil(np.log2(np.maximum(sizes, 1)) / 2).astype(int)
    for size in np.unique(classes[sizes >= MIN_WORDS]).tolist():
        mine = np.flatnonzero((classes == size) & (sizes >= MIN_WORDS))
        starts = np.zeros(len(mine) + 1, np.int64)
        np.cumsum(sizes[mine], out=starts[1:])
        for s, n, q in runs_of(np.concatenate([ids[limits[t] : limits[t + 1]] for t in mine.tolist()]), int(sizes[mine].max())):
            t = int(np.searchsorted(starts, s, "right")) - 1
            out[mine[t]].append((s - int(starts[t]), n, q))
    return out


def first_periods(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay when every run keeps its first period only."""
    steps = np.zeros(n + 1, np.int64)
    for s, length, q in runs:
        steps[s + q] += 1
        steps[s + length] -= 1
    return np.cumsum(steps[:n]) == 0


def repeated_tail(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which of a text's n words stands at each place once a tenth of all texts, told by their ids, repeats part of its words to its end; null: as it is."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([np.arange(a), a + np.arange(n - a) % p])


def find_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", places: Callable[[int | None, int], np.ndarray | None] | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row.

    Words are the maximal stretches of characters other than ASCII white space; runs are (start, length, period) in words, by
    start, then period; collapsed is the words joined by one blank, without those that some run holds after its first period.
    places(doc_id, n) may tell which of the text's n words to take at each place. Null, empty and blank texts have no words
    and no runs, and collapse to the empty text; null ids stay null; equal rows have equal results, one each; a text is
    handled whole whatever its length. An empty table gives an empty result; further columns are not read.
    """

    def make():
        def one(batch):
            out: dict[str, list] = {"n_words": [], "runs": [], "collapsed": []}
            ids = batch.column(0).to_pylist()
            texts = [(x or "").encode() for x in batch.column(1).to_pylist()]
            for part in _words.chunks([len(x) for x in texts]):
                words = [x.split() for x in texts[part]]
                if places is not None:
                    for t, doc in enumerate(ids[part]):
                        if (order := places(doc, len(words[t]))) is not None:
                            words[t] = [words[t][i] for i in order.tolist()]
                for w, found in zip(words, runs_of_texts(words), strict=True):
                    out["n_words"].append(len(w))
                    out["runs"].append([{"start": s, "length": n, "period": q} for s, n, q in found])
                    out["collapsed"].append(b" ".join([w[i] for i in np.flatnonzero(first_periods(len(w), found)).tolist()] if found else w).decode())
            return out | {"doc_id": batch.column(0)}

        return one

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return _base.map_batches(rows, make, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def run_digests(found: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256): the run of most periods (exactly; ties: smallest start, then period), null without one, and hashes of all runs and of the collapsed text."""
    # a/b against c/d is exact as a*d against c*b: lengths and periods are far below 2^31.
    higher = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda held, x: F.when(higher(x, held), x).otherwise(held))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))))
    rows = found.withColumn("best", best)
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("best.length * 1000L div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
