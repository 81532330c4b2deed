"""Approximate nearest neighbours: inverted lists of coarse centroids, product-quantised residuals, exact reranking."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from octolith.llm.spark import cut

_CODES = 256
_BLOCK = 1 << 21
#: Components of moved vectors end here: the squares of thousands of them can be added.
_FAR = 1e140
#: More than the rounding error of a distance, as a share of the norms that go into it.
_ROUNDING = 1e-14


def _squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1), 0)


def _blocks(x: np.ndarray, centres: np.ndarray):
    """Runs of rows whose distances to all centres are about ``_BLOCK`` numbers, so that no table of distances grows with the rows."""
    step = max(1, _BLOCK // max(1, len(centres)))
    for at in range(0, len(x), step):
        yield slice(at, at + step)


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, and its squared distance."""
    own, far = np.zeros(len(x), np.int64), np.zeros(len(x))
    for rows in _blocks(x, centres):
        d = _squared(x[rows], centres)
        own[rows] = d.argmin(1)
        far[rows] = d[np.arange(len(d)), own[rows]]
    return own, far


def kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """Lloyd's algorithm from random members; an empty cluster moves to the member that is farthest from its centre."""
    k = min(k, len(x))
    centres = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own, d = _nearest(x, centres)
        size = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        full = size > 0
        centres[full] = sums[full] / size[full, None]
        if not full.all():
            far = np.argsort(-d)[: int((~full).sum())]
            centres[~full] = x[far]
    return centres


@dataclass
class Model:
    """Coarse centroids and a codebook for each group of dimensions, of vectors moved to ``origin`` and scaled by a power of two."""

    origin: np.ndarray
    scale: float
    coarse: np.ndarray
    books: list[np.ndarray]
    cuts: list[int]

    @property
    def dims(self) -> int:
        return self.coarse.shape[1]

    def moved(self, x: np.ndarray) -> np.ndarray:
        """Near the origin, where squares lose no small distances; components stay below ``_FAR``, so that squares don't overflow."""
        with np.errstate(over="ignore"):
            return np.clip((x - self.origin) * self.scale, -_FAR, _FAR)

    def lists(self, x: np.ndarray) -> np.ndarray:
        return _nearest(x, self.coarse)[0]

    def encode(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The codes of moved vectors, and for each how far it can be from what they stand for, rounding included."""
        rest = x - self.coarse[own]
        parts, error = [], np.zeros(len(x))
        for a, b, book in zip(self.cuts, self.cuts[1:], self.books):
            parts.append(_nearest(rest[:, a:b], book)[0])
            error += ((rest[:, a:b] - book[parts[-1]]) ** 2).sum(1)
        error = np.sqrt(error) + _ROUNDING * np.sqrt((x * x).sum(1))
        error[(np.abs(x) >= _FAR).any(1)] = np.inf
        return np.stack(parts, axis=1).astype(np.uint8), error

    def tables(self, rest: np.ndarray) -> np.ndarray:
        """Squared distances of query residuals to the codes: query, group, code."""
        out = np.full((len(rest), len(self.books), _CODES), np.inf)
        for g, (a, b, book) in enumerate(zip(self.cuts, self.cuts[1:], self.books)):
            out[:, g, : len(book)] = _squared(rest[:, a:b], book)
        return out


def fit(sample: np.ndarray, n_rows: int, *, groups: int = 16, seed: int = 7) -> Model:
    """Fits centroids and codebooks: about ``sqrt(n_rows)`` lists, but at most one for two rows of the sample."""
    origin = np.median(sample, axis=0)
    with np.errstate(over="ignore"):
        widest = min(float(np.abs(sample - origin).max()) or 1.0, float(np.finfo(float).max))
    model = Model(origin, 2.0 ** -max(-1000, min(1000, math.frexp(widest)[1])), np.zeros((1, sample.shape[1])), [], np.linspace(0, sample.shape[1], min(groups, sample.shape[1]) + 1).astype(int).tolist())
    sample = model.moved(sample)
    model.coarse = kmeans(sample, max(1, min(round(n_rows**0.5), len(sample) // 2)), seed=seed)
    rest = sample - model.coarse[_nearest(sample, model.coarse)[0]]
    model.books = [kmeans(rest[:, a:b], _CODES, rounds=6, seed=seed) for a, b in zip(model.cuts, model.cuts[1:])]
    return model


def _distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows to a vector; where squares would leave the range of doubles, of scaled differences."""
    with np.errstate(over="ignore"):
        gap = np.abs(x - q)
        d = np.sqrt((gap * gap).sum(1))
        odd = np.flatnonzero(~((d > 1 / _FAR) & (d < _FAR)))
        if len(odd):
            power = np.frexp(gap[odd].max(1))[1]
            near = np.ldexp(gap[odd], -power[:, None])
            d[odd] = np.ldexp(np.sqrt((near * near).sum(1)), power)
    return d


def truth(batches, tests: np.ndarray, model: Model, k: int):
    """Brute force: of the index rows of a task the k + 1 nearest to each test vector, as ``t, score, list, n`` with the number of their ids."""
    t = model.moved(tests)
    norms, limit = (t * t).sum(1), np.full(len(t), np.inf)
    best = [(np.zeros(0), np.zeros(0, np.int32), np.zeros(0, np.int64))] * len(t)
    for batch in batches:
        every, own = _matrix(batch.column("v"), model.dims), np.asarray(batch.column("list"))
        n = np.diff(np.asarray(batch.column("ids").offsets))
        for rows in _blocks(every, t):
            x = model.moved(every[rows])
            d = _squared(x, t)
            slack = 2 * _ROUNDING * model.dims * ((x * x).sum(1).max() + norms)
            if len(x) > k + 1:
                limit = np.minimum(limit, np.partition(d, k, axis=0)[k] + slack)
            for i in range(len(t)):
                at = rows.start + np.flatnonzero(~(d[:, i] > limit[i] + slack[i]))
                if len(at):
                    score, where, ids = (np.concatenate(c) for c in zip(best[i], (_distances(every[at], tests[i]), own[at], n[at])))
                    few = np.argsort(score, kind="stable")[: k + 1]
                    best[i] = score[few], where[few], ids[few]
    merged = [np.concatenate([b[c] for b in best]) for c in range(3)]
    number = np.repeat(np.arange(len(t), dtype=np.int32), [len(b[0]) for b in best])
    yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(merged[0]), pa.array(merged[1], pa.int32()), pa.array(merged[2], pa.int64())], ["t", "score", "list", "n"])


def probes_for(index: DataFrame, tests: np.ndarray, model: Model, k: int, target: float) -> int:
    """The least number of lists in which a share of ``target`` of the tests' true neighbours lies, found by brute force over the whole index."""
    near = index.select("list", "v", "ids").mapInArrow(lambda batches: truth(batches, tests, model, k), "t int, score double, list int, n long")
    near = near.withColumn("at", F.row_number().over(Window.partitionBy("t").orderBy("score", "list"))).where(F.col("at") <= k + 1)
    by_test: dict[int, list] = {}
    for r in near.orderBy("t", "at").collect():
        by_test.setdefault(r["t"], []).append(r)
    x, share = model.moved(tests), np.zeros(len(model.coarse))
    for rows in _blocks(x, model.coarse):
        order = np.argsort(_squared(x[rows], model.coarse), axis=1, kind="stable")
        place = np.argsort(order, axis=1)
        for i in range(len(place)):
            left = k
            for r in by_test.get(rows.start + i, []):
                n = min(left, r["n"] - (r["score"] == 0))
                share[place[i, r["list"]]] += n
                left -= n
    found = np.cumsum(share)
    return int(np.searchsorted(found, target * found[-1])) + 1 if found[-1] else 1


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, v``: different rows whose vector is not null or zero and has finite components only."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    return rows.where(finite & F.exists("v", lambda x: x != 0)).distinct()


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten()).reshape(-1, dims)


def _search(rows: pa.Table, queries: pa.Table, model: Model, k: int) -> pa.Table:
    """The k + 1 nearest ids of a list to each query: exact distances of all rows that can be among them by their codes and errors."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if rows.num_rows and queries.num_rows:
        x, q = _matrix(rows.column("v"), model.dims), _matrix(queries.column("v"), model.dims)
        codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.uint8).reshape(len(x), -1)
        ids, qid, error = rows.column("ids").to_pylist(), np.asarray(queries.column("q")), np.asarray(rows.column("error"))
        centre = model.coarse[rows.column("list")[0].as_py()]
        widest = sum(float((book * book).sum(1).max()) for book in model.books)
        for at in range(0, len(q), 64):
            moved = model.moved(q[at : at + 64])
            rest = moved - centre
            table = model.tables(rest)
            near = np.zeros((len(table), len(x)))
            for g in range(codes.shape[1]):
                near += table[:, g, codes[:, g]]
            slack = _ROUNDING * model.dims * ((rest * rest).sum(1) + widest)
            shift = _ROUNDING * np.sqrt((moved * moved).sum(1))
            exactly = (np.abs(moved) >= _FAR).any(1)
            for i in range(len(table)):
                best = np.arange(len(x))
                if len(x) > k + 1 and not exactly[i]:
                    most = np.sqrt(near[i] + slack[i]) + error
                    least = np.sqrt(np.maximum(near[i] - slack[i], 0)) - error
                    best = np.flatnonzero(least <= np.partition(most, k)[k] + 2 * shift[i])
                exact = _distances(x[best], q[at + i])
                few = np.argsort(exact, kind="stable")[: k + 1] if len(best) <= k + 1 else np.flatnonzero(exact <= np.partition(exact, k)[k])
                pairs = sorted((d, v) for d, j in zip(exact[few].tolist(), best[few].tolist()) for v in ids[j])[: k + 1]
                out.append((np.full(len(pairs), qid[at + i]), np.array([p[1] for p in pairs], np.int64), np.array([p[0] for p in pairs])))
    merged = [np.concatenate([o[c] for o in out]) if out else np.zeros(0) for c in range(3)]
    return pa.table([pa.array(merged[0], pa.int64()), pa.array(merged[1], pa.int64()), pa.array(merged[2], pa.float64())], ["q", "vec_id", "score"])


def search(vectors: DataFrame, queries: DataFrame, *, k: int = 10, most_sample: int = 20_000, chunk_rows: int = 20_000, groups: int = 16, target: float = 0.98, most_tests: int = 400) -> DataFrame:
    """The ``k`` nearest of ``vectors(vec_id, embedding)`` to each row of ``queries`` (same columns), itself (by id) left out.

    Returns ``query_id, rank, vec_id, score``: rank from 1, score the exact Euclidean distance in
    double precision; ties go to the smaller id. The index is fitted on about ``most_sample`` rows,
    or eight for each of its ``sqrt(rows)`` lists if that is more, chosen by a hash, and holds every usable row. Equal vectors
    are one entry with their k + 1 smallest ids, which is all a result can hold. Lists of over
    ``chunk_rows`` entries are cut into chunks.

    Within a list the search is exact. Each query looks into the number of lists that holds a share of ``target`` of the true
    neighbours of up to ``most_tests`` of the queries themselves, chosen by a hash, by brute force over all rows.

    Null, zero and non-finite vectors, null ids and vectors of another length than the most common
    take no part. Repeated rows count once. With fewer than k candidates all are returned; empty
    tables give no rows; other columns are ignored.
    """
    rows = usable(vectors)
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    empty = "query_id long, rank int, vec_id long, score double"
    if length is None:
        return vectors.sparkSession.createDataFrame([], empty)
    dims = length["n"]
    rows = rows.where(F.size("v") == dims)
    first = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    entries = cut(rows.withColumn("n", first).where(F.col("n") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    total = entries.count()
    most_sample = max(most_sample, 8 * round(total**0.5))
    kept = entries.select("v") if total <= most_sample else entries.where(F.pmod(F.xxhash64("v"), F.lit(1 << 20)) < int((1 << 20) * most_sample / total)).select("v")
    sample = _matrix(kept.toArrow().column("v"), dims)
    if not len(sample):
        sample = _matrix(entries.select("v").limit(most_sample).toArrow().column("v"), dims)
    model = fit(sample, total, groups=groups)

    def place(batches):
        for batch in batches:
            x = _matrix(batch.column("v"), dims)
            moved = model.moved(x)
            own = model.lists(moved)
            codes, error = model.encode(moved, own)
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), batch.column("v"), batch.column("ids"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)], ["list", "v", "ids", "codes", "error"])

    index = cut(entries.mapInArrow(place, "list int, v array<double>, ids array<long>, codes binary, error double"))
    sizes = np.zeros((len(model.coarse), 2), dtype=np.int64)  # a row for each list
    for r in index.groupBy("list").agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("ids")).collect():
        sizes[r["list"]] = r["n"], r["ids"]
    chunks = np.maximum(1, -(-sizes[:, 0] // chunk_rows))
    per_list = F.array(*[F.lit(int(c)) for c in chunks]) if chunks.max() > 1 else None
    chunk = F.pmod(F.xxhash64("v"), F.get(per_list, F.col("list"))).cast("int") if per_list is not None else F.lit(0)
    index = index.withColumn("chunk", chunk)

    asked = usable(queries).where(F.size("v") == dims)
    different = asked.groupBy("v").agg(F.min("vec_id").alias("q"))
    most_tests = max(1, min(most_tests, _BLOCK // dims))
    tests = _matrix(asked.orderBy(F.xxhash64("vec_id"), "vec_id").select("v").limit(most_tests).toArrow().column("v"), dims)
    fewest = probes_for(index, tests, model, k, target) if len(tests) else 1

    def probe(batches):
        for batch in batches:
            x, at, lists, parts = model.moved(_matrix(batch.column("v"), dims)), [], [], []
            for rows in _blocks(x, model.coarse):
                order = np.argsort(_squared(x[rows], model.coarse), axis=1, kind="stable")
                there = np.cumsum(sizes[order, 1], axis=1)
                enough = np.maximum(fewest, (there < k + 1).sum(1) + 1)
                for i, n in enumerate(enough.tolist()):
                    for c in order[i, :n].tolist():
                        if sizes[c, 0]:
                            at += [rows.start + i] * int(chunks[c])
                            lists += [c] * int(chunks[c])
                            parts += range(int(chunks[c]))
            picked = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([picked.column("q"), picked.column("v"), pa.array(lists, pa.int32()), pa.array(parts, pa.int32())], ["q", "v", "list", "chunk"])

    probes = different.select("q", "v").mapInArrow(probe, "q long, v array<double>, list int, chunk int")
    found = index.groupBy("list", "chunk").cogroup(probes.groupBy("list", "chunk")).applyInArrow(lambda a, b: _search(a, b, model, k), "q long, vec_id long, score double")
    best = Window.partitionBy("q").orderBy("score", "vec_id")
    found = found.distinct().withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    each = asked.join(different, "v").select(F.col("vec_id").alias("query_id"), "q")
    ranked = each.join(found, "q").where("vec_id <> query_id")
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")).cast("int"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
