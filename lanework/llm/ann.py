"""Nearest neighbours by NN-descent graphs and greedy graph search.

Equal vectors are one node. Nodes are dealt to shards of bounded size by hash. Each shard gets a neighbour graph by
NN-descent: lists start at random, and in each round Spark joins every node's list with the lists that name it, and the
neighbours of a common node are compared with each other; the rounds end when hardly any entry changes. A query walks the
graph of every shard (a stated query set against all rows, in blocks): it starts from a few fixed nodes, and from one more
in each part of the graph that these do not lead to, and expands the nearest nodes it has seen until none of the nearest
``beam`` is left to expand. Distances are exact, in double precision, on the original vectors.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanework.llm import _base

SHARD = 8192
DEGREE, REVERSE = 20, 20
#: The rounds end when at most this share of the lists' entries changed.
SETTLED = 0.05
BEAM = 96
ENTRIES = 16
#: Offered to each member of a common neighbourhood in a round.
OFFERS = 8
QUERY_BLOCK = 16384


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, vec array<double>) of the rows with an id whose vectors are not null, empty or zero and have only finite components."""
    vec = F.col(embedding).cast("array<double>")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(vec_id).cast("long").alias("vec_id"), vec.alias("vec")).where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & finite & F.exists("vec", lambda x: x != 0))


def nodes_of(points: DataFrame, keep: int) -> DataFrame:
    """(node, vec, ids): one row per distinct vector; ids are its ``keep`` smallest vec_ids, node the smallest.

    Ids are cut to the smallest within spread parts first, so a vector on a third of all rows is no large group.
    """
    spread = F.pmod(F.xxhash64("vec_id"), F.lit(256))
    best = lambda c: F.slice(F.array_sort(F.array_distinct(c)), 1, keep)
    part = points.groupBy("vec", spread.alias("part")).agg(best(F.collect_set("vec_id")).alias("ids"))
    return part.groupBy("vec").agg(best(F.flatten(F.collect_list("ids"))).alias("ids")).select(F.element_at("ids", 1).alias("node"), "vec", "ids")


def _matrix(table: pa.Table, column: str) -> np.ndarray:
    lists = table.column(column).combine_chunks()
    return np.asarray(lists.flatten()).reshape(len(lists), -1)


def _nearest_in(members: np.ndarray, x: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, other, squared distance): for each member of each set (rows of ``members``, -1: none) its nearest fellow members."""
    rows, others, squares = [], [], []
    norms = (x * x).sum(1)
    for part in np.array_split(members, max(1, len(members) * members.shape[1] // 40_000)):
        v = x[np.maximum(part, 0)]
        d = norms[part][:, :, None] + norms[part][:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
        d[np.broadcast_to((part < 0)[:, None, :], d.shape)] = np.inf
        d[np.broadcast_to(part[:, :, None] == part[:, None, :], d.shape)] = np.inf
        k = min(top, part.shape[1])
        at = np.argpartition(d, k - 1, 2)[:, :, :k]
        near = np.take_along_axis(d, at, 2)
        other = np.take_along_axis(np.broadcast_to(part[:, None, :], d.shape), at, 2)
        row = np.broadcast_to(part[:, :, None], at.shape)
        good = (row >= 0) & np.isfinite(near)
        rows.append(row[good])
        others.append(other[good])
        squares.append(near[good])
    return np.concatenate(rows), np.concatenate(others), np.maximum(np.concatenate(squares), 0)


def _best_lists(n: int, rows: np.ndarray, others: np.ndarray, squares: np.ndarray, degree: int) -> list[np.ndarray]:
    """The nearest distinct others of each of n rows."""
    order = np.lexsort((others, squares, rows))
    rows, others = rows[order], others[order]
    _, fresh = np.unique(rows.astype(np.int64) * n + others, return_index=True)
    fresh.sort()
    rows, others = rows[fresh], others[fresh]
    edges = np.searchsorted(rows, np.arange(n + 1))
    return [others[a : min(b, a + degree)] for a, b in zip(edges, edges[1:], strict=False)]


def _entries(links: list[np.ndarray], start: np.ndarray) -> np.ndarray:
    """start and further nodes, one at least in each part of the graph, from which the links lead to every node."""
    reached = np.zeros(len(links), bool)
    found, frontier, at = [start], start, 0
    while True:
        reached[frontier] = True
        while frontier.size:
            near = np.unique(np.concatenate([links[i] for i in frontier.tolist()]))
            frontier = near[~reached[near]]
            reached[frontier] = True
        while at < len(links) and reached[at]:
            at += 1
        if at == len(links):
            return np.concatenate(found)
        frontier = np.array([at])
        found.append(frontier)


GRAPH = "shard int, node long, nbrs array<long>, fresh int"


def _graph_table(shard: int, names: np.ndarray, lists: list[np.ndarray], fresh: list[int]) -> pa.Table:
    return pa.table({"shard": np.full(len(names), shard, np.int32), "node": names, "nbrs": pa.array([names[x] for x in lists], pa.list_(pa.int64())), "fresh": pa.array(fresh, pa.int32())})


def first_graph(nodes: DataFrame, degree: int) -> DataFrame:
    """(shard, node, nbrs, fresh): random lists within a shard, all of it where it is that small."""

    def run(table: pa.Table) -> pa.Table:
        names = np.sort(np.asarray(table.column("node")))
        n, shard = len(names), table.column("shard")[0].as_py()
        rng = np.random.default_rng(shard)
        drawn = (rng.choice(n, min(n, degree + 1), replace=False) for _ in range(n))
        return _graph_table(shard, names, [x[x != i][:degree] for i, x in enumerate(drawn)], [degree] * n)

    return nodes.select("shard", "node").groupBy("shard").applyInArrow(run, GRAPH)


def descend(graph: DataFrame, nodes: DataFrame, degree: int, reverse: int, offers: int, tag: int) -> DataFrame:
    """One round: lists joined with the lists that name their node (a drawn part of them), members compared, best kept; fresh counts a list's new entries."""
    named = graph.select("shard", F.col("node").alias("by"), F.explode("nbrs").alias("node"))
    drawn = F.row_number().over(Window.partitionBy("node").orderBy(F.xxhash64("by", "node", F.lit(tag)), "by"))
    back = named.withColumn("n", drawn).where(F.col("n") <= reverse).groupBy("node").agg(F.collect_list("by").alias("back"))
    joined = graph.join(back, "node", "left").select("shard", "node", "nbrs", "back")

    def run(lists: pa.Table, vectors: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(vectors.column("node")), kind="stable")
        names, x = np.asarray(vectors.column("node"))[order], _matrix(vectors, "vec")[order]
        shard = vectors.column("shard")[0].as_py()
        members = np.full((lists.num_rows, degree + reverse + 1), -1)
        old = []
        for i, (node, nbrs, back) in enumerate(zip(lists.column("node").to_pylist(), lists.column("nbrs").to_pylist(), lists.column("back").to_pylist(), strict=True)):
            group = np.searchsorted(names, np.unique(np.array([node, *nbrs, *(back or [])])))
            members[i, : len(group)] = group
            me, mine = np.searchsorted(names, node), np.searchsorted(names, np.array(nbrs, np.int64))
            old.append((np.full(len(mine), me), mine, ((x[mine] - x[me]) ** 2).sum(1)))
        found = [_nearest_in(members, x, offers), *old]
        best = _best_lists(len(names), *(np.concatenate(x) for x in zip(*found, strict=True)), degree)
        before = {int(me[0]): mine for me, mine, _ in old if len(mine)}
        return _graph_table(shard, names, best, [len(x) - int(np.isin(x, before.get(i, x[:0])).sum()) for i, x in enumerate(best)])

    return joined.groupBy("shard").cogroup(nodes.select("shard", "node", "vec").groupBy("shard")).applyInArrow(run, GRAPH)


def build_index(vectors: DataFrame, neighbours: int = 10, shard: int = SHARD, degree: int = DEGREE, reverse: int = REVERSE, rounds: int | None = None, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(shard, node, vec, ids, links): every usable vector's node, with the graph's links in both directions.

    ids: the node's ``neighbours`` + 1 smallest vec_ids; farther copies of a vector cannot be among that many nearest.
    rounds: how many there are, instead of until the lists are settled.
    """
    nodes = _base.save(nodes_of(usable(vectors, vec_id, embedding), neighbours + 1), "nodes")
    shards = max(1, math.ceil(nodes.count() / shard))
    nodes = _base.save(nodes.withColumn("shard", F.pmod(F.xxhash64("node", F.lit(5)), F.lit(shards)).cast("int")), "sharded")
    graph, turn = _base.save(first_graph(nodes, degree), "graph"), 0
    while turn != rounds:
        before, graph = graph, _base.save(descend(graph, nodes, degree, reverse, OFFERS, turn), "graph")
        _base.release(before)
        turn += 1
        fresh, entries = graph.agg(F.sum("fresh"), F.sum(F.size("nbrs"))).first()
        if rounds is None and (fresh or 0) <= SETTLED * (entries or 0):
            break
    edges = graph.select("node", F.explode("nbrs").alias("to"))
    drawn = F.row_number().over(Window.partitionBy("to").orderBy(F.xxhash64("node", "to"), "node"))
    back = edges.withColumn("n", drawn).where(F.col("n") <= 2 * reverse).groupBy(F.col("to").alias("node")).agg(F.collect_list(F.col("node")).alias("back"))
    links = graph.join(back, "node", "left").select("node", F.array_union("nbrs", F.coalesce("back", F.array().cast("array<long>"))).alias("links"))
    return _base.save(nodes.join(links, "node", "left"), "index")


def greedy(x: np.ndarray, links: list[np.ndarray], query: np.ndarray, beam: int, start: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, distances) of the nearest found, nearest first, ties by row, which is the order of their ids. Rows as far as the beam's last one are expanded too."""
    distance = lambda rows: np.sqrt(((x[rows] - query) ** 2).sum(1))
    seen = np.zeros(len(x), bool)
    expanded = np.zeros(len(x), bool)
    seen[start] = True
    rows, far = start, distance(start)
    while True:
        order = np.lexsort((rows, far))
        order = order[: max(beam, int(np.searchsorted(far[order], far[order[min(beam, len(order)) - 1]], "right")))]
        rows, far = rows[order], far[order]
        frontier = rows[~expanded[rows]]
        if not frontier.size:
            return rows[:top], far[:top]
        expanded[frontier] = True
        near = np.unique(np.concatenate([links[i] for i in frontier.tolist()]))
        near = near[~seen[near]]
        seen[near] = True
        rows, far = np.concatenate([rows, near]), np.concatenate([far, distance(near)])


def search(index: DataFrame, queries: DataFrame, neighbours: int = 10, beam: int = BEAM, entries: int = ENTRIES) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's nearest found, its own id apart; ties go to the smaller id.

    queries: (vec_id, vec). Fewer candidates than wanted are all returned.
    """
    shards = index.agg(F.max("shard")).first()[0]
    blocks = max(1, math.ceil(queries.count() / QUERY_BLOCK))
    asked = queries.select(F.col("vec_id").alias("query_id"), F.col("vec").alias("query"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards or 0))))
    blocked = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(ask: pa.Table, part: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if ask.num_rows and part.num_rows:
            order = np.argsort(np.asarray(part.column("node")), kind="stable")
            names, x = np.asarray(part.column("node"))[order], _matrix(part, "vec")[order]
            ids, links = part.column("ids").to_pylist(), part.column("links").to_pylist()
            links = [np.searchsorted(names, np.array(links[i] or [], np.int64)) for i in order.tolist()]
            start = _entries(links, np.unique(np.linspace(0, len(names) - 1, entries).astype(int)))
            for query, vec in zip(ask.column("query_id").to_pylist(), _matrix(ask, "query"), strict=True):
                near, far = greedy(x, links, vec, beam, start, neighbours + 1)
                got = [(d, i) for r, d in zip(near.tolist(), far.tolist(), strict=True) for i in ids[order[r]] if i != query]
                for score, i in sorted(got)[:neighbours]:
                    for name, value in zip(out, (query, i, score), strict=True):
                        out[name].append(value)
        return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

    found = asked.groupBy("shard", "block").cogroup(blocked.groupBy("shard", "block")).applyInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= neighbours).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, every: int = 100, neighbours: int = 10, shard: int = SHARD, rounds: int | None = None, beam: int = BEAM, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Nearest neighbours of the rows whose id is divisible by ``every``, among all others.

    Rows without an id or with an unusable vector take no part; a row that occurs twice counts once. An empty table gives
    an empty result; further columns are not read.
    """
    _base.small_batches(vectors.sparkSession)
    index = build_index(vectors, neighbours, shard, rounds=rounds, vec_id=vec_id, embedding=embedding)
    return search(index, usable(vectors, vec_id, embedding).where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"]), neighbours, beam)
