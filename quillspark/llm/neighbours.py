"""Approximate nearest neighbours with learned partitions.

A neighbour graph over a bounded sample is cut into balanced parts by recursive spectral bisection; a small network learns to
tell the part of a vector from the vector. Every row is indexed under its most probable part, a query goes to
its several most probable parts, and candidates there are reranked by the exact inner product. Parts are stored in blocks of a
bounded number of rows, so a part that holds a common vector is many tasks, each of which returns but its best.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, map_arrow, ship, table


_MOST_HELD = 1_000_000


@dataclass
class Router:
    """A network of one hidden layer over parts."""

    mean: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int = 1

    @property
    def parts(self) -> int:
        return len(self.b2)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def neighbour_graph(x: np.ndarray, k: int, block: int = 1024) -> np.ndarray:
    """The k nearest by inner product of each row, without itself, in blocks of rows."""
    out = np.empty((len(x), k), np.int64)
    for a in range(0, len(x), block):
        s = x[a : a + block] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out[a : a + block] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(graph: np.ndarray, parts: int, rounds: int = 60, seed: int = 7) -> np.ndarray:
    """A part of each node, all of about one size: the graph is halved again and again along its second eigenvector, at the median."""
    n, k = graph.shape
    rng = np.random.default_rng(seed)
    part = np.zeros(n, np.int64)
    rows, cols = np.repeat(np.arange(n), k), graph.ravel()
    while part.max(initial=0) + 1 < parts:
        new = part * 2
        for p in range(part.max() + 1):
            own = np.flatnonzero(part == p)
            if len(own) < 2:
                continue
            place = np.full(n, -1)
            place[own] = np.arange(len(own))
            a, b = place[rows], place[cols]
            inside = (a >= 0) & (b >= 0)
            a, b = a[inside], b[inside]
            degree = np.bincount(a, minlength=len(own)) + np.bincount(b, minlength=len(own)) + 1e-3
            v = rng.standard_normal(len(own))
            for _ in range(rounds):  # power iteration on the lazy walk, without its constant direction
                v = 0.5 * v + 0.5 * (np.bincount(a, v[b], len(own)) + np.bincount(b, v[a], len(own))) / degree
                v -= (v @ degree) / degree.sum()
                v /= np.linalg.norm(v) + 1e-12
            new[own[np.argsort(v, kind="stable")[len(own) // 2 :]]] += 1
        part = new
    return part


def train_router(x: np.ndarray, part: np.ndarray, graph: np.ndarray, parts: int, hidden: int = 128, epochs: int = 30, seed: int = 7) -> Router:
    """Cross-entropy against each row's shares of parts, half its own and half its neighbours', by Adam."""
    rng = np.random.default_rng(seed)
    dim = x.shape[1]
    mean = x.mean(axis=0)
    scale = 1 / (x.std() + 1e-9)
    w = [rng.standard_normal((dim, hidden)) * np.sqrt(2 / dim) * scale, np.zeros(hidden), rng.standard_normal((hidden, parts)) * np.sqrt(1 / hidden), np.zeros(parts)]
    m, v, t = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        rate = 3e-3 * (1 - epoch / epochs) + 1e-4
        for a in range(0, len(x), 128):
            rows = order[a : a + 128]
            share = np.zeros((len(rows), parts))
            np.add.at(share, (np.repeat(np.arange(len(rows)), graph.shape[1]), part[graph[rows]].ravel()), 0.5 / graph.shape[1])
            share[np.arange(len(rows)), part[rows]] += 0.5
            z = x[rows] - mean
            h = np.maximum(z @ w[0] + w[1], 0)
            o = h @ w[2] + w[3]
            p = np.exp(o - o.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            d = (p - share) / len(rows)
            dh = (d @ w[2].T) * (h > 0)
            t += 1
            for i, g in enumerate((z.T @ dh, dh.sum(axis=0), h.T @ d, d.sum(axis=0))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                w[i] -= (rate * scale if i == 0 else rate) * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return Router(mean, *w)


def fit(vectors: DataFrame, rows: int, sample: int = 8192, most: int = 32768, part_rows: int = 1024, each: int = 16, k: int = 10, neighbours: int = 20, aim: float = 0.94) -> Router:
    """The router from a sample of `rows` vectors (vec_id, v) of one dimension, with a power of two of parts, of about `part_rows` rows.

    The sample holds about `sample` rows, or as many more, up to `most`, as give each part `each` of them; fewer parts are made where it holds less for them, at the least one.
    The number of parts a query goes to is the least for which `aim` of the `neighbours` nearest in the sample are in them, as measured on a fifth of the sample.
    """
    wanted = max(1.0, rows / part_rows)
    share = min(1.0, min(max(sample, each * wanted), most) / max(1, rows))
    got = vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_003)) < share * 1_000_003).orderBy("vec_id").select("v").toPandas()["v"]
    x = np.unique(np.stack(got.to_numpy()).astype(np.float64), axis=0) if len(got) else np.zeros((0, 1))
    parts = 1 << max(0, min(round(np.log2(wanted)), int(np.log2(max(1, len(x) / each)))))
    if parts == 1:
        dim = x.shape[1]
        return Router(np.zeros(dim), np.zeros((dim, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1)
    x = x[np.random.default_rng(7).permutation(len(x))]
    held, own = x[: len(x) // 5], x[len(x) // 5 :]
    graph = neighbour_graph(own, min(k, len(own) - 1))
    router = train_router(own, balanced_parts(graph, parts), graph, parts)
    # rows are indexed by the router, so it is the router's parts that count
    indexed = router.logits(own).argmax(axis=1)
    at_place = np.zeros(parts, np.int64)  # how many near ones lie in the query's first part, in its second and so on
    for a in range(0, len(held), 512):
        queries = held[a : a + 512]
        place = np.argsort(np.argsort(-router.logits(queries), axis=1), axis=1)
        s = queries @ own.T
        best = np.argpartition(-s, min(neighbours, len(own)) - 1, axis=1)[:, :neighbours]
        at_place += np.bincount(np.take_along_axis(place, indexed[best], axis=1).ravel(), minlength=parts)
    router.probes = min(parts, int(np.searchsorted(np.cumsum(at_place) / at_place.sum(), aim) + 1))
    return router


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id, v (doubles): rows that are not null, not zero, and have only finite components. Repeated rows stay; other columns aren't read. Empty table: no rows."""
    v = F.col(column).cast("array<double>")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, block: int = 4096, **how: float) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k candidates of largest inner product found for each query, its own row left out; ties to smaller vec_id.

    vectors and queries: vec_id, v, as usable() gives them. Those of the dimension that most vectors have (the smaller one, in a tie) take part. Rows that repeat a vec_id are
    candidates each; a query that is repeated is answered once, by its smallest vector. A query whose parts hold fewer than k candidates is sent to all others too, so
    it gets k, or all there are. Empty table: no rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    largest = vectors.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    dim, rows = (largest["dim"], largest["n"]) if largest else (0, 0)
    fits = vectors.where(F.size("v") == dim)
    router = fit(fits, rows, **how)

    def index(batch: pa.RecordBatch) -> dict:
        return {"vec_id": batch.column("vec_id"), "v": batch.column("v"), "part": router.logits(_matrix(batch.column("v"))).argmax(axis=1).astype(np.int32), "salt": batch.column("salt")}

    def route(first: int, end: int):
        def run(batch: pa.RecordBatch) -> dict:
            best = np.argsort(-router.logits(_matrix(batch.column("v"))), axis=1)[:, first:end]
            of = pa.array(np.repeat(np.arange(len(best)), best.shape[1]))
            return {"vec_id": batch.column("vec_id").take(of), "v": batch.column("v").take(of), "part": best.ravel().astype(np.int32)}

        return run

    schema = "vec_id long, v array<double>, part int"
    indexed = cut(map_arrow(fits.withColumn("salt", F.monotonically_increasing_id()), index, f"{schema}, salt long"), "index")
    # a part's rows are dealt to as many blocks as its size asks for; each query goes to all of them
    sizes = indexed.groupBy("part").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    stored = indexed.join(sizes, "part").select("part", F.pmod(F.xxhash64("vec_id", "salt"), F.col("blocks")).cast("int").alias("block"), F.lit(False).alias("asks"), "vec_id", "v")
    asking = queries.where(F.size("v") == dim).groupBy("vec_id").agg(F.min("v").alias("v"))

    def found(asking: DataFrame, first: int, end: int) -> DataFrame:
        routed = cut(map_arrow(asking, route(first, end), schema, 256), "routed")
        asked = routed.join(sizes, "part").select("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("asks"), "vec_id", "v")
        together = stored.unionByName(asked).repartition("part", "block").sortWithinPartitions("part", "block", "asks")
        return nearest(together.mapInArrow(_answers(k), "query_id long, vec_id long, score double"))

    def nearest(rows: DataFrame) -> DataFrame:
        by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

    out = found(asking, 0, router.probes)
    if router.probes == router.parts:
        return out
    out = cut(out, "nearest")
    enough = out.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
    short = cut(asking.join(enough, "vec_id", "left_anti"), "short")
    if short.isEmpty():
        return out
    return nearest(out.drop("rank").unionByName(found(short, router.probes, router.parts).drop("rank")))


def _answers(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The k best rows of each query within a block, of rows sorted by part, block, and stored ones before those that ask."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, store, sorted_ = None, [], [], None
        best, held = [], 0

        def emit() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in best[0]], names=["query_id", "vec_id", "score"])

        for batch in batches:
            where = np.stack([batch.column("part").to_numpy(), batch.column("block").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)], axis=1)
            starts = np.flatnonzero(np.r_[True, (where[1:] != where[:-1]).any(axis=1)]) if len(where) else []
            for a, b in zip(starts, [*starts[1:], len(where)], strict=True):
                piece = batch.slice(a, b - a)
                if key != tuple(where[a][:2]):
                    key, ids, store, sorted_ = tuple(where[a][:2]), [], [], None
                if not where[a][2]:
                    ids.append(piece.column("vec_id").to_numpy())
                    store.append(_matrix(piece.column("v")))
                    continue
                if not ids:
                    continue
                if sorted_ is None:
                    all_ids = np.concatenate(ids)
                    by = np.argsort(all_ids, kind="stable")
                    sorted_ = all_ids[by], np.concatenate(store)[by]
                for i in range(0, len(piece), 256):
                    best.append(_best(piece.column("vec_id").to_numpy()[i : i + 256], _matrix(piece.column("v").slice(i, 256)), *sorted_, k))
                    held += len(best[-1][0])
                if held > _MOST_HELD:  # parts in one task are merged, within bounded memory
                    best = [_merged(best, k)]
                    held = len(best[0][0])
                    if held > _MOST_HELD // 2:
                        yield emit()
                        best, held = [], 0
        if best:
            best = [_merged(best, k)]
            yield emit()

    return answer


def _best(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of each query, ties to smaller ids; ids are sorted."""
    s = queries @ rows.T
    s[query_ids[:, None] == ids[None, :]] = -np.inf
    n = min(k, len(ids))
    edge = -np.partition(-s, n - 1, axis=1)[:, n - 1]
    # equal vectors may differ in the product's last bits: what is near the edge is summed again, each row in one order
    slack = 1e-12 * (1 + np.linalg.norm(queries, axis=1) * np.linalg.norm(rows, axis=1).max())
    q, at = np.nonzero((s >= (edge - slack)[:, None]) & (s > -np.inf))
    exact = (queries[q] * rows[at]).sum(axis=1)
    by = np.lexsort((ids[at], -exact, q))
    q, at, exact = q[by], at[by], exact[by]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < n
    return query_ids[q[keep]], ids[at[keep]], exact[keep]


def _merged(best: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query out of several lists."""
    q, ids, scores = (np.concatenate(x) for x in zip(*best, strict=True))
    by = np.lexsort((ids, -scores, q))
    q, ids, scores = q[by], ids[by], scores[by]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[keep], ids[keep], scores[keep]


def op8_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """search for the 20 nearest of each row whose vec_id is divisible by 20 among all rows."""
    vectors = usable(table(spark, sf_dir, "embeddings"))
    return search(vectors, vectors.where("vec_id % 20 = 0"))
