"""Toxic spans by a linear-chain conditional random field.

Labels say whether a document is toxic, not where. Token labels come from them: Spark counts, over the labelled sample, in
how many different contexts (the words before and after) each word and prefix stands in toxic and in clean documents; a
token of a toxic document is labelled toxic if such a feature is common in toxic and rare in clean ones. Contexts are
counted, not documents, so that copies of one document add nothing.

The field has two states and is trained on windows of tokens, with features of the token and of both its neighbours.
Scoring runs forward-backward over every token of every whole text, so each token has its chance of being toxic; runs of
toxic tokens become spans. A document's score is a logistic function, fitted on the same sample, of its tokens' largest
chance, of the expected number of toxic ones and of their expected share.
"""

from __future__ import annotations

import math
import re
from array import array
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanework.llm import _base

TOKEN = re.compile(r"\w+")
PREFIXES = (4, 5, 6)
#: Bound of the training sample: labelled rows of each class (whole texts).
SAMPLE_ROWS = 1500
#: Bound of the training windows: of each kind (toxic, clean that look alike, other clean) in all, and of each kind from one text.
WINDOWS, WINDOWS_PER_TEXT = 2000, 8
HALF_WINDOW = 4
WIDTH = 2 * HALF_WINDOW + 1
CACHE_WORDS = 150_000
#: A token's log-odds are kept within this bound, which is also what a document without tokens has.
MOST = 30.0
#: Log-odds from which a document's likeliest token is told even if it is rather clean.
LIKELIEST = -4.0
#: How far a segment's result may be from that of the whole text.
EXACT = 1e-12
SEGMENT, CELLS = 512, 1 << 20
#: What the document's score is made of: see ``Tagger.tag``.
TOLD = ("top", "expected", "share")


def features(word: str) -> list[str]:
    """Of a lower-case word: itself and its prefixes."""
    return ["=" + word, *("^" + word[:n] for n in PREFIXES if len(word) >= n)]


def window_features(words: list[str], i: int) -> list[str]:
    """Of a token in its window: its own, and its neighbours' words."""
    found = features(words[i])
    if i:
        found.append("<" + words[i - 1])
    if i + 1 < len(words):
        found.append(">" + words[i + 1])
    return found


@dataclass
class Field:
    """Weights of toxic against clean by feature, bias, transition scores [from, to]; and the document's logistic function: a constant, then the weights of what ``Tagger.tag`` tells."""

    weights: dict[str, float]
    bias: float
    transitions: np.ndarray
    document: tuple[float, ...] = (0.0, 1.0, 0.0, 0.0)

    def emission(self, words: list[str], i: int) -> float:
        return self.bias + sum(self.weights.get(f, 0.0) for f in window_features(words, i))


def usable_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) outside the held-out fifth."""
    return labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, toxic): of each class the usable labelled rows whose ids hash lowest, at most ``rows``; equal texts once."""
    known = usable_labels(labels)
    known = known.withColumn("draw", F.xxhash64("doc_id", F.lit(7)))
    part = lambda y: known.where(F.col("toxic") == y).orderBy("draw", "doc_id").limit(rows)
    chosen = part(1).unionByName(part(0))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where("text is not null").select("text", F.col("toxic").cast("int").alias("toxic")).distinct()


def telling_features(texts: DataFrame, share: float = 0.02, least: int = 3, ratio: float = 50.0) -> list[str]:
    """Features that stand in at least ``share`` as many contexts (and ``least``) as there are toxic texts, and ``ratio`` times as often there as in clean ones.

    A text gives one context of each of its features, the first. The result is short: each entry takes a fixed share of a bounded sample.
    """

    def make():
        def one(batch):
            out: dict[str, list] = {"toxic": [], "feature": [], "context": []}
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = [w.lower() for w in TOKEN.findall(text)]
                first: dict[str, int] = {}
                for i, w in enumerate(words):
                    if "=" + w not in first:
                        for f in features(w):
                            first.setdefault(f, i)
                out["toxic"] += [toxic] * len(first)
                out["feature"] += first
                out["context"] += [" ".join(words[max(0, i - 1) : i + 2]) for i in first.values()]
            return out

        return one

    counts = texts.groupBy("toxic").count().collect()  # two rows
    total = {r["toxic"]: r["count"] for r in counts}
    rows = _base.map_batches(texts.select("text", "toxic"), make, "toxic int, feature string, context string").select("toxic", "feature", F.xxhash64("context").alias("context"))
    seen = rows.groupBy("feature", "context", "toxic").count()
    found = seen.groupBy("feature").agg(F.count_if(F.col("toxic") == 1).alias("a"), F.count_if(F.col("toxic") == 0).alias("b"))
    enough, fair = max(least, share * total.get(1, 0)), max(1, total.get(0, 0)) / max(1, total.get(1, 0))
    return sorted(r["feature"] for r in found.where((F.col("a") >= enough) & (F.col("b") * ratio <= F.col("a") * fair)).select("feature").collect())


def windows(texts: DataFrame, telling: list[str]) -> DataFrame:
    """(words, marks, kind): windows round toxic tokens (1), round tokens of clean texts that share a prefix with a telling feature (2), and evenly spaced ones of clean texts (0)."""
    telling = frozenset(telling)
    near = telling | {f for t in telling for f in features(t[1:])[1:]}

    def make():
        def one(batch):
            out: dict[str, list] = {"words": [], "marks": [], "kind": []}
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = [w.lower() for w in TOKEN.findall(text)]
                wanted = telling if toxic else near
                able = {w for w in set(words) if not wanted.isdisjoint(features(w))}
                at = [i for i, w in enumerate(words) if w in able]
                spread = lambda x: x[:: -(-len(x) // WINDOWS_PER_TEXT) or 1]
                chosen = [(i, 1 if toxic else 2) for i in spread(at)]
                if not toxic:
                    chosen += [(i, 0) for i in spread(list(range(HALF_WINDOW, len(words), WIDTH)))]
                for i, kind in chosen:
                    part = words[max(0, i - HALF_WINDOW) : i + HALF_WINDOW + 1]
                    out["words"].append(part)
                    out["marks"].append([int(kind == 1 and w in able) for w in part])
                    out["kind"].append(kind)
            return out

        return one

    found = _base.map_batches(texts.select("text", "toxic"), make, "words array<string>, marks array<int>, kind int").distinct()
    part = lambda k: found.where(F.col("kind") == k).orderBy(F.xxhash64("words"), "words").limit(WINDOWS)
    return part(0).unionByName(part(1)).unionByName(part(2))


def train(found: list[tuple[list[str], list[int]]], rounds: int = 100, rate: float = 0.3, penalty: float = 1e-3, least: int = 3) -> Field:
    """Full-batch gradient ascent (Adam) on the penalised log-likelihood of labelled windows (words, marks).

    Features of toxic tokens, and of clean ones that share one of their prefixes, get a weight if at least ``least``
    windows hold them, or if none is held as often.
    """
    held: dict[str, int] = {}
    alike = {f for words, marks in found for w, y in zip(words, marks, strict=True) if y for f in features(w)}
    for words, marks in found:
        for f in {f for i, y in enumerate(marks) if y or not alike.isdisjoint(features(words[i])) for f in window_features(words, i)}:
            held[f] = held.get(f, 0) + 1
    known = {f: k for k, f in enumerate(sorted(f for f, n in held.items() if n >= min(least, max(held.values())))) if alike}
    if not known:
        return Field({}, -12.0, np.zeros((2, 2)))
    n, k, most = len(found), len(known), 3 + len(PREFIXES)
    index, gold, there = np.full((n, WIDTH, most), k, np.int32), np.zeros((n, WIDTH), np.int8), np.zeros((n, WIDTH), bool)
    for row, (words, marks) in enumerate(found):
        there[row, : len(words)], gold[row, : len(words)] = True, marks
        for i in range(len(words)):
            mine = [known[f] for f in window_features(words, i) if f in known]
            index[row, i, : len(mine)] = mine
    theta = np.zeros(k + 6)  # features, nothing, bias, transitions
    theta[k + 1] = -3.0
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        grad = gradient(theta, index, gold, there, penalty)[1]
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad * grad
        theta += rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        theta[k] = 0
    return Field({f: float(theta[i]) for f, i in known.items()}, float(theta[k + 1]), theta[k + 2 :].reshape(2, 2).copy())


def gradient(theta: np.ndarray, index: np.ndarray, gold: np.ndarray, there: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    """Mean penalised log-likelihood of the windows and its gradient; theta holds weights, a zero, the bias and the transitions."""
    k, n = len(theta) - 6, len(index)
    score, trans = theta[: k + 1][index].sum(2) + theta[k + 1], theta[k + 2 :].reshape(2, 2)
    marginal, pair, total = _marginals(score, there, trans)
    off = (gold - marginal) * there
    grad = np.zeros_like(theta)
    grad[: k + 1] = np.bincount(index.ravel(), np.repeat(off.ravel(), index.shape[2]), k + 1)
    grad[k], grad[k + 1] = 0, off.sum()
    both = there[:, 1:]
    path = float((score * gold * there).sum() - total.sum())
    for a in (0, 1):
        for b in (0, 1):
            taken = (gold[:, :-1] == a) & (gold[:, 1:] == b) & both
            path += float(trans[a, b] * taken.sum())
            grad[k + 2 + 2 * a + b] = taken.sum() - pair[:, :, a, b][both].sum()
    return path / n - penalty / 2 * float(theta @ theta), grad / n - penalty * theta


def _marginals(score: np.ndarray, there: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over windows at once: chance of toxic at each place, and of each pair of neighbours' states, and the log of the sum over all paths."""
    n, width = score.shape
    emit = np.stack([np.zeros_like(score), score], 2) * there[..., None]
    forward, backward = np.zeros((n, width, 2)), np.zeros((n, width, 2))
    forward[:, 0] = emit[:, 0]
    for t in range(1, width):
        step = np.logaddexp(forward[:, t - 1, :1] + trans[0], forward[:, t - 1, 1:] + trans[1]) + emit[:, t]
        forward[:, t] = np.where(there[:, t, None], step, forward[:, t - 1])
    for t in range(width - 2, -1, -1):
        ahead = emit[:, t + 1] + backward[:, t + 1]
        step = np.stack([np.logaddexp(trans[a, 0] + ahead[:, 0], trans[a, 1] + ahead[:, 1]) for a in (0, 1)], 1)
        backward[:, t] = np.where(there[:, t + 1, None], step, backward[:, t + 1])
    both = forward + backward
    total = np.logaddexp(both[:, :, 0], both[:, :, 1])
    pair = np.zeros((n, width - 1, 2, 2))
    for a in (0, 1):
        for b in (0, 1):
            pair[:, :, a, b] = np.exp(np.minimum(0, forward[:, :-1, a] + trans[a, b] + emit[:, 1:, b] + backward[:, 1:, b] - total[:, 1:]))
    return np.exp(both[:, :, 1] - total), pair, total[:, 0]


class Tagger:
    """Chances of all tokens of whole texts under a Field, for many texts at once."""

    def __init__(self, field: Field):
        self.field = field
        self.trans = np.exp(field.transitions - field.transitions.max())
        # Birkhoff: a step shrinks what it came with by this factor at least, whatever the emissions.
        t = field.transitions
        shrink = math.tanh(abs(t[0, 0] + t[1, 1] - t[0, 1] - t[1, 0]) / 4)
        self.overlap = 1 if shrink < EXACT else math.ceil(math.log(EXACT / (4 * MOST)) / math.log(shrink))
        self.segment = max(SEGMENT, 2 * self.overlap)
        self.cache: dict[str, int] = {}
        self.table = (array("d"), array("d"), array("d"))

    def _word(self, word: str) -> None:
        """Note a word's weights: for itself, for the token after it and for the one before it."""
        weights, low = self.field.weights, word.lower()
        for column, value in zip(self.table, (self.field.bias + sum(weights.get(f, 0.0) for f in features(low)), weights.get("<" + low, 0.0), weights.get(">" + low, 0.0)), strict=True):
            column.append(value)
        self.cache[word] = len(self.cache)

    def emissions(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(emissions of all tokens, first token of each text with the total at the end)."""
        if len(self.cache) > CACHE_WORDS:
            self.cache, self.table = {}, (array("d"), array("d"), array("d"))
        known, ids, first = self.cache, [], [0]
        for text in texts:
            words = TOKEN.findall(text)
            for w in set(words).difference(known):
                self._word(w)
            ids += map(known.__getitem__, words)
            first.append(len(ids))
        ids, first = np.array(ids, np.int64), np.array(first)
        own, after, before = (np.array(x) for x in self.table)
        out = own[ids]
        inner = np.ones(len(ids), bool)
        inner[first[:-1][first[:-1] < len(ids)]] = False  # a text's first token follows nothing
        inner = np.flatnonzero(inner)
        out[inner] += after[ids[inner - 1]]
        out[inner - 1] += before[ids[inner]]
        return np.clip(out, -MOST, MOST), first

    def log_odds(self, emissions: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Log-odds of toxic of every token. Long texts are cut into segments that overlap far enough."""
        starts, ends = first[:-1], first[1:]
        cuts = [np.arange(a, b, self.segment) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        at = np.concatenate(cuts) if cuts else np.zeros(0, int)
        text = np.repeat(np.arange(len(cuts)), [len(c) for c in cuts])
        low, high = np.maximum(at - self.overlap, starts[text]), np.minimum(at + self.segment + self.overlap, ends[text])
        order = np.argsort(high - low, kind="stable")
        out = np.empty(len(emissions))
        i = 0
        while i < len(order):
            j = i + 1
            while j < len(order) and (j - i) * (high - low)[order[j]] < CELLS:
                j += max(1, (j - i) // 8)
            part = order[i : min(j, len(order))]
            found = self._lanes(emissions, low[part], high[part])
            for k, p in enumerate(part.tolist()):
                a, b = at[p], min(at[p] + self.segment, ends[text[p]])
                out[a:b] = found[a - low[p] : b - low[p], k]
            i = j
        return out

    def _lanes(self, emissions: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Forward-backward of emissions[low:high], each its own chain, side by side: log-odds as (place, chain)."""
        (a, b), (c, d) = self.trans
        sizes = high - low
        width = int(sizes.max())
        odds = np.exp(emissions[np.minimum(low + np.arange(width)[:, None], len(emissions) - 1)])
        forward, back = np.empty_like(odds), np.ones_like(odds)
        forward[0] = odds[0]
        for t in range(1, width):
            forward[t] = odds[t] * (b + d * forward[t - 1]) / (a + c * forward[t - 1])
        for t in range(width - 2, -1, -1):
            x = odds[t + 1] * back[t + 1]
            back[t] = np.where(t < sizes - 1, (c + d * x) / (a + b * x), 1.0)
        return np.log(forward * back)

    def tag(self, texts: list[str]) -> tuple[np.ndarray, list[list[dict]]]:
        """Of each text (largest log-odds of a token, log of the expected number of toxic tokens, log of their expected share), and its spans of tokens that are rather toxic, or the likeliest token if none is."""
        emissions, first = self.emissions(texts)
        odds = np.clip(self.log_odds(emissions, first), -MOST, MOST)
        told = np.full((len(texts), 3), -MOST)
        full = np.flatnonzero(np.diff(first))
        spans: list[list[dict]] = [[] for _ in texts]
        if full.size:
            told[full, 0] = np.maximum.reduceat(odds, first[full])
            told[full, 1] = np.log(np.add.reduceat(1 / (1 + np.exp(-odds)), first[full]))
            told[full, 2] = told[full, 1] - np.log(np.diff(first)[full])
        for i in np.flatnonzero(told[:, 0] >= LIKELIEST).tolist():
            mine = odds[first[i] : first[i + 1]]
            hot = np.flatnonzero(mine >= min(0.0, told[i, 0]))
            places = [m.span() for m in TOKEN.finditer(texts[i])]
            cuts = [0, *(np.flatnonzero(np.diff(hot) > 1) + 1).tolist(), len(hot)]
            for x, y in pairwise(cuts):
                run = hot[x:y]
                spans[i].append({"start": places[run[0]][0], "end": places[run[-1]][1], "chance": float(1 / (1 + np.exp(-mine[run].max())))})
        return told, spans


def fit_document(told: np.ndarray, toxic: np.ndarray, share: float = 0.5, penalty: float = 1e-4, rounds: int = 50) -> tuple[float, ...]:
    """Logistic function of the columns of ``told`` by Newton's method: constant and weights, none negative. share: that of toxic documents, for which the sample is weighted."""
    found = np.zeros(1 + told.shape[1])
    if not toxic.any() or toxic.all():
        found[:2] = 0.0 if toxic.any() else -MOST, 1.0
        return tuple(found.tolist())
    each = np.where(toxic, share / toxic.sum(), (1 - share) / (~toxic).sum())
    columns = list(range(len(found)))
    while True:
        x = np.column_stack([np.ones(len(told)), told])[:, columns]
        w = np.zeros(len(columns))
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
            slope = x.T @ (each * (toxic - p)) - penalty * w
            step = np.linalg.solve((x * (each * p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w)), slope)
            w += step * min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        if len(w) == 1 or w[1:].min() >= 0:
            found[columns] = w
            return tuple(found.tolist())
        del columns[1 + int(w[1:].argmin())]


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Field:
    """Trained on the driver, which sees the telling features, bounded windows of words, and two numbers of each sampled text."""
    texts = _base.save(sample(docs, labels, rows), "labelled")
    found = [(r["words"], r["marks"]) for r in windows(texts, telling_features(texts)).collect()]
    field = train(sorted(found))
    told = _tagged(texts, field).select(*TOLD, "toxic").toArrow()
    _base.release(texts)
    share = usable_labels(labels).agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    field.document = fit_document(np.column_stack([told.column(c).to_numpy() for c in TOLD]), told.column("toxic").to_numpy() == 1, share or 0.0)
    return field


def _tagged(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """docs' columns and (top, expected, share, spans)."""
    from pyspark.sql.types import StructType

    _base.small_batches(docs.sparkSession)
    added = ", ".join(f"{c} double" for c in TOLD) + ", spans array<struct<start:int,end:int,chance:double>>"
    schema = StructType(docs.schema.fields + StructType.fromDDL(added).fields)
    kind = _base.pa_schema(docs.sparkSession, added).field(len(TOLD)).type
    place = docs.columns.index(text)

    def run(batches):
        tagger = Tagger(field)
        for batch in batches:
            told, spans = tagger.tag([x or "" for x in batch.column(place).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x) for x in told.T), pa.array(spans, kind)], names=schema.names)

    return docs.mapInArrow(run, schema)


def score(docs: DataFrame, field: Field, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(docs' columns, toxicity, toxic_spans array<struct<start, end, chance>>) of every row, over its whole text.

    Spans are of tokens that are rather toxic; a document that is rather toxic without such a token has its likeliest one.
    Null and empty texts score as one whose tokens are all clean. Null ids and equal rows are ordinary rows; columns of the
    two new names are replaced, others are kept, whatever their names.
    """
    docs = docs.drop("toxicity", "toxic_spans")
    names = docs.columns
    plain = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)))
    tagged = _tagged(plain, field, f"c{names.index(text)}")
    constant, *weights = field.document
    sum_ = sum((F.col(c) * w for c, w in zip(TOLD, weights, strict=True)), F.lit(constant))
    chance = 1 / (1 + F.exp(-sum_))
    spans = F.filter("spans", lambda s: (s["chance"] >= 0.5) | (chance >= 0.5))
    return tagged.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)), chance.alias("toxicity"), spans.alias("toxic_spans"))
