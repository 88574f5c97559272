"""Nearest neighbours by largest inner product over balanced posting lists.

Vectors are divided by the largest norm and get one more component, the square root of 1 minus their squared
norm (queries get 0): the largest inner product is then the least distance. Centroids come from
balanced k-means on a hashed sample of at most ``SAMPLE`` vectors; there are at most ``LISTS`` of them, so
sample, centroids and their graph have a fixed bound and travel with the tasks. Every vector
is indexed: a best-first walk over the centroid graph finds its nearest centroids, and it is posted to all whose
distance is within ``boundary`` times the least (boundary vectors are in several lists, at most ``REPLICAS``). A
query walks the same graph and reads the lists within ``ratio`` times its least distance, and
further ones until they hold ``FILL`` times the neighbours asked for; where the walk's farthest list
still counts, all centroids are compared, so no number of lists is a limit.

Equal vectors are one class with its k + 1 smallest ids: with ties to the smaller id no other can
be among k neighbours of another vector or of one of them. Different vectors with equal scores go by their smallest ids, also where a
list or a shard is cut to its k + 1 best. Lists near each other share a shard of at most ``SHARD``
bytes of vectors, where a query's lists are read together and give one k + 1 best. A longer list is a shard of its own, cut into
parts of as many bytes, and a shard's queries into parts of at most ``PART``; each pair of parts is a task's
group, so a hot list is spread.

Nulls: vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without id
or of another length than most. Repeated rows count once. Fewer candidates than k: all of them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from greenledger.llm import common as C
from greenledger.session import cut

SAMPLE = 50_000
LISTS = 4096
LIST_SIZE = 256
REPLICAS = 6
DEGREE = 20
BEAM = 48
FILL = 40
PART = 4096
SHARD = 16 << 20


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``_id`` and ``_v`` of the rows that take part."""
    rows = vectors.select(C.named(id_col).cast("long").alias("_id"), C.named(vector_col).cast("array<double>").alias("_v"))
    sound = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists("_v", lambda x: x != 0)
    rows = rows.filter(F.col("_id").isNotNull() & F.col("_v").isNotNull()).filter(sound)
    sizes = rows.groupBy(F.size("_v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.filter(F.size("_v") == (sizes[0]["n"] if sizes else 0))


def classes(rows: DataFrame, k: int) -> DataFrame:
    """One row per distinct vector with its k + 1 smallest ids; the rank is cut inside the tasks before the shuffle."""
    place = F.row_number().over(W.partitionBy("_v").orderBy("_id"))
    few = rows.distinct().withColumn("_n", place).filter(F.col("_n") <= k + 1)
    return few.groupBy("_v").agg(F.sort_array(F.collect_list("_id")).alias("ids"))


def matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def lift(x: np.ndarray, norm: float, query: bool) -> np.ndarray:
    """Unit scale and one more component; queries are brought to length 1, which keeps the order of their answers."""
    if query:
        x = x / np.sqrt((x**2).sum(1, keepdims=True))
        return np.hstack([x, np.zeros((len(x), 1))]).astype(np.float32)
    x = x / norm
    return np.hstack([x, np.sqrt(np.maximum(0, 1 - (x**2).sum(1, keepdims=True)))]).astype(np.float32)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1), 0)


def balanced_means(x: np.ndarray, lists: int, rounds: int = 10, weight: float = 0.15, seed: int = 4) -> np.ndarray:
    """k-means whose distances grow with the share that a list held in the round before."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), lists, replace=False)]
    share = np.ones(lists, np.float32)
    for _ in range(rounds):
        total, count = np.zeros_like(c, dtype=np.float64), np.zeros(lists)
        scale = None
        for lo in range(0, len(x), 2048):
            d = distances(x[lo : lo + 2048], c)
            scale = d.min(1).mean() if scale is None else scale
            own = (d + weight * scale * share).argmin(1)
            np.add.at(total, own, x[lo : lo + 2048])
            count += np.bincount(own, minlength=lists)
        filled = count > 0
        c = np.where(filled[:, None], total / np.maximum(count, 1)[:, None], x[rng.choice(len(x), lists)]).astype(np.float32)
        share = (count / max(1.0, count.mean())).astype(np.float32)
    return c


class Graph:
    """Centroids, each linked to its nearest and to a few others; searched best first."""

    def __init__(self, c: np.ndarray, seed: int = 9):
        n = len(c)
        rng = np.random.default_rng(seed)
        self.c = c
        near = min(DEGREE - 4, n - 1)
        links = np.zeros((n, near + 4), np.int64)
        for lo in range(0, n, 1024):
            d = distances(c[lo : lo + 1024], c)
            d[np.arange(len(d)), np.arange(lo, lo + len(d))] = np.inf
            if near:
                links[lo : lo + len(d), :near] = np.argpartition(d, near - 1, axis=1)[:, :near]
        links[:, near:] = rng.integers(0, n, (n, 4))
        self.links = links
        self.entries = rng.choice(n, min(n, BEAM), replace=False)

    def search(self, x: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``want`` nearest centroids found for each row, nearest first, with distances (not squared)."""
        beam = max(min(max(BEAM, want), len(self.c)), 1)
        rows = np.arange(len(x))[:, None]
        seen = np.zeros((len(x), len(self.c)), bool)
        ids = np.tile(self.entries[:beam], (len(x), 1))
        seen[rows, ids] = True
        d = distances(x, self.c[self.entries[:beam]])
        done = np.zeros(ids.shape, bool)
        active = np.arange(len(x))
        while len(active):
            open_d = np.where(done[active], np.inf, d[active])
            pick = open_d.argmin(1)
            going = np.isfinite(open_d[np.arange(len(active)), pick])
            active, pick = active[going], pick[going]
            if not len(active):
                break
            done[active, pick] = True
            new = self.links[ids[active, pick]]
            fresh = ~seen[active[:, None], new]
            seen[active[:, None], new] = True
            nd = np.maximum(((x[active][:, None, :] - self.c[new]) ** 2).sum(2), 0)
            first = np.ones(new.shape, bool)  # a link may be named twice in one row
            order = np.argsort(new, axis=1, kind="stable")
            same = np.take_along_axis(new, order, 1)
            np.put_along_axis(first, order[:, 1:], same[:, 1:] != same[:, :-1], 1)
            nd[~(fresh & first)] = np.inf
            all_d, all_i = np.hstack([d[active], nd]), np.hstack([ids[active], new])
            all_done = np.hstack([done[active], np.zeros(new.shape, bool)])
            best = np.argpartition(all_d, beam - 1, axis=1)[:, :beam] if all_d.shape[1] > beam else np.tile(np.arange(all_d.shape[1]), (len(active), 1))
            if ids.shape[1] < beam:
                grown = best.shape[1] - ids.shape[1]
                pad = lambda a, v: np.hstack([a, np.full((len(a), grown), v, a.dtype)])
                ids, d, done = pad(ids, 0), pad(d, np.inf), pad(done, True)
            d[active], ids[active], done[active] = (np.take_along_axis(a, best, 1) for a in (all_d, all_i, all_done))
            done[active] |= ~np.isfinite(d[active])
        order = np.argsort(d, axis=1, kind="stable")[:, :want]
        return np.take_along_axis(ids, order, 1), np.sqrt(np.take_along_axis(d, order, 1))


def _post(graph: Graph, norm: float, boundary: float):
    def post(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                found, d = graph.search(lift(matrix(part.column("_v")), norm, False), REPLICAS)
                inside = (d <= boundary * np.maximum(d[:, :1], 1e-6)) & np.isfinite(d)
                inside[:, 0] = True
                row, col = np.nonzero(inside)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(found[row, col], pa.int32()), part.column("_v").take(at), part.column("ids").take(at)], names=["list", "_v", "ids"])

    return post


def shards(c: np.ndarray, sizes: np.ndarray, room: int) -> np.ndarray:
    """The shard of each list: centroids are halved across their widest direction until the lists hold ``room`` vectors or are one."""
    shard, todo, n = np.zeros(len(c), np.int64), [np.arange(len(c))], 0
    while todo:
        part = todo.pop()
        if len(part) == 1 or sizes[part].sum() <= room:
            shard[part] = n
            n += 1
            continue
        x = c[part] - c[part].mean(0)
        order = part[np.argsort(x @ np.linalg.svd(x, full_matrices=False)[2][0], kind="stable")]
        todo += [order[: len(order) // 2], order[len(order) // 2 :]]
    return shard


def reach(graph: Graph, x: np.ndarray, ratio: float, sizes: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and list of every list that a query reads. Queries for which the farthest list found still counts are compared with all."""
    rows, lists, todo = [], [], np.arange(len(x))
    for every in (False, True):
        if every:
            d = np.sqrt(distances(x[todo], graph.c))
            found = np.argsort(d, axis=1, kind="stable")
            d = np.take_along_axis(d, found, 1)
        else:
            found, d = graph.search(x, BEAM)
        held = np.cumsum(np.where(np.isfinite(d), sizes[found], 0), axis=1)
        short = np.hstack([np.zeros((len(d), 1)), held[:, :-1]]) < need
        inside = (short | (d <= ratio * np.maximum(d[:, :1], 1e-6))) & np.isfinite(d)
        row, col = np.nonzero(inside & (every | ~inside[:, -1:]))
        rows.append(todo[row])
        lists.append(found[row, col])
        todo = todo[inside[:, -1]]
        if every or not len(todo):
            break
    return np.concatenate(rows), np.concatenate(lists)


def _probe(graph: Graph, norm: float, ratio: float, sizes: np.ndarray, need: int, shard: np.ndarray):
    """The lists that a query reads, one row for each of their shards."""
    def probe(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                row, lists = reach(graph, lift(matrix(part.column("_v")), norm, True), ratio, sizes, need)
                order = np.lexsort((shard[lists], row))
                row, lists = row[order], lists[order]
                begin = C.runs(row * (len(shard) + 1) + shard[lists])[0]
                at = pa.array(row[begin])
                groups = pa.ListArray.from_arrays(pa.array(np.append(begin, len(row)), pa.int32()), pa.array(lists, pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(shard[lists[begin]], pa.int32()), part.column("_q").take(at), part.column("_v").take(at), groups], names=["shard", "_q", "_v", "lists"])

    return probe


def _leading(score: np.ndarray, q: np.ndarray, p: np.ndarray, first: np.ndarray, k: int, slack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (query, vector) of all that can be among the k + 1 best by score, then smallest id. Where more than k + 1 are within rounding of
    the last place, exact scores and ids decide."""
    if score.shape[1] <= k + 1:
        at, which = np.divmod(np.arange(score.size), score.shape[1])
        return at, which
    least = -np.partition(-score, k, axis=1)[:, k] - slack
    inside = score >= least[:, None]
    for i in np.flatnonzero(inside.sum(1) > k + 1):
        tied = np.flatnonzero(inside[i])
        order = np.lexsort((first[tied], -(p[tied] * q[i]).sum(1)))
        inside[i, tied[order[k + 1 :]]] = False
    return np.nonzero(inside)


def _nearest(k: int):
    def nearest(key, postings, queries):
        names, out = queries.column("_q").to_numpy(), ([], [], [])
        if postings.num_rows and queries.num_rows:
            q = matrix(queries.column("_v"))
            ids = postings.column("ids").to_pylist()
            # a boundary vector is in several lists of the shard but is one answer
            _, one, column = np.unique([x[0] for x in ids], return_index=True, return_inverse=True)
            p, ids = matrix(postings.column("_v").take(pa.array(one))), [ids[i] for i in one]
            first = np.array([x[0] for x in ids], np.int64)
            slack = 1e-12 * np.sqrt((q**2).sum(1)) * np.sqrt((p**2).sum(1).max())  # scores closer than this may tie
            held = postings.column("list").to_numpy()
            by = np.argsort(held, kind="stable")
            begin = C.runs(held[by])[0]
            members = dict(zip(held[by][begin].tolist(), np.split(column[by], begin[1:])))
            for lo in range(0, len(q), 512):
                part = queries.column("lists").slice(lo, 512).combine_chunks()
                row, read = np.repeat(np.arange(len(part)), np.diff(part.offsets.to_numpy())), part.flatten().to_numpy()
                seen = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
                for name in np.unique(read).tolist():
                    if name not in members:
                        continue
                    asks, own = row[read == name], members[name]
                    score = q[lo + asks] @ p[own].T
                    at, which = _leading(score, q[lo + asks], p[own], first[own], k, slack[lo + asks])
                    seen.append((asks[at], own[which], score[at, which]))
                asks, found, score = (np.concatenate(x) for x in zip(*seen))
                once = np.unique(asks * len(p) + found, return_index=True)[1]
                once = once[np.lexsort((-score[once], asks[once]))]
                for mine in np.split(once, C.runs(asks[once])[0][1:]) if len(once) else []:
                    i = lo + asks[mine[0]]
                    best = found[mine[score[mine] >= score[mine[min(k, len(mine) - 1)]] - slack[i]]]
                    exact = (p[best] * q[i]).sum(1)
                    top = np.lexsort((first[best], -exact))[: k + 1]
                    line = sorted((-s, v) for s, b in zip(exact[top].tolist(), best[top].tolist()) for v in ids[b])[: k + 1]
                    out[0].extend([names[i]] * len(line))
                    out[1].extend(v for _, v in line)
                    out[2].extend(-s for s, _ in line)
        return pa.table({"_q": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    return nearest


def search(vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", boundary: float = 1.15, ratio: float = 1.4) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the k rows of largest inner product found for every row
    that ``queries`` (a condition on ``_id``) names, without the row itself."""
    rows = cut(usable(vectors, id_col, vector_col))
    store = cut(classes(rows, k))
    n = store.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return vectors.sparkSession.createDataFrame([], schema)
    norm = math.sqrt(store.select(F.max(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x * x))).first()[0])
    sample = matrix(store.select("_v", F.xxhash64("_v").alias("p")).orderBy("p").limit(SAMPLE).toArrow().column("_v"))
    x = lift(sample, norm, False)
    graph = Graph(balanced_means(x, max(1, min(LISTS, n // LIST_SIZE, len(x)))))
    posted = cut(store.mapInArrow(_post(graph, norm, boundary), "list int, _v array<double>, ids array<long>"))
    asked = rows.filter(queries).select("_id", "_v", F.xxhash64("_v").alias("_q"))
    distinct = cut(asked.select("_q", "_v").distinct())
    sizes = np.zeros(len(graph.c), np.int64)
    for row in posted.groupBy("list").count().collect():  # at most LISTS rows
        sizes[row["list"]] = row["count"]
    room = max(1, SHARD // (8 * sample.shape[1]))
    shard = shards(graph.c, sizes, room)
    probes = cut(distinct.mapInArrow(_probe(graph, norm, ratio, sizes, FILL * (k + 1), shard), "shard int, _q long, _v array<double>, lists array<int>"))
    size = np.bincount(shard, sizes).astype(np.int64)
    load = np.zeros(len(size), np.int64)
    for row in probes.groupBy("shard").count().collect():  # no more than lists
        load[row["shard"]] = row["count"]
    parts = [F.get(F.array(*[F.lit(int(max(1, -(-v // most)))) for v in counts]), F.col("shard")) for counts, most in ((size, room), (load, PART))]
    every = lambda count: F.explode(F.sequence(F.lit(0), count - 1))
    left = posted.withColumn("shard", F.get(F.array(*[F.lit(int(v)) for v in shard]), F.col("list")))
    left = left.withColumn("pp", F.pmod(F.xxhash64("_v"), parts[0]).cast("int")).withColumn("qp", every(parts[1]))
    right = probes.withColumn("qp", F.pmod(F.col("_q"), parts[1]).cast("int")).withColumn("pp", every(parts[0]))
    found = left.groupBy("shard", "pp", "qp").cogroup(right.groupBy("shard", "pp", "qp")).applyInArrow(_nearest(k), "_q long, vec_id long, score double")
    best = found.groupBy("_q", "vec_id").agg(F.max("score").alias("score"))
    best = best.withColumn("_n", F.row_number().over(W.partitionBy("_q").orderBy(F.desc("score"), "vec_id"))).filter(F.col("_n") <= k + 1)
    lists = best.groupBy("_q").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("top"))
    joined = C.salted_join(asked.select("_id", "_q"), lists, ["_q"], F.col("_id")).select(F.col("_id").alias("query_id"), F.posexplode(F.slice(F.filter("top", lambda t: t["vec_id"] != F.col("_id")), 1, k)).alias("place", "t")).distinct()
    return joined.select("query_id", (F.col("place") + 1).alias("rank"), F.col("t.vec_id").alias("vec_id"), (-F.col("t.s")).alias("score"))
