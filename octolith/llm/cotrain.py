"""Document quality by co-training: a text view and a metadata view teach each other, calibrated views score all documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from octolith.llm import textbytes
from octolith.llm.spark import cut

_HASHED = 128
_COUNTED = 22
_META = 96
#: Numbers of the text view and of the metadata view.
WIDTHS = (_COUNTED + _HASHED, _META)
SCHEMA = "doc_id long, text_score double, meta_score double, score double, predicted int"

_KIND = np.zeros((256, 6), dtype=np.int32)  # upper, lower, digit, mark, bar-like, high byte
_KIND[65:91, 0] = 1
_KIND[97:123, 1] = 1
_KIND[48:58, 2] = 1
_KIND[[c for c in range(33, 127) if not chr(c).isalnum()], 3] = 1
_KIND[[ord(c) for c in "|#$%&*@^~<>{}[]=_\\"], 4] = 1
_KIND[128:, 5] = 1


def text_view(column: pa.Array) -> np.ndarray:
    """Features of whole texts: shares of character classes, repetition of words and lines, lengths, hashed words."""
    buffer, row_at = textbytes.joined(column)
    n = len(row_at) - 1
    out = np.zeros((n, _COUNTED + _HASHED), dtype=np.float32)
    if not n:
        return out
    starts, ends = textbytes.words(buffer, textbytes.SPACED)
    keys = textbytes.keys(buffer, starts, ends)
    first = np.searchsorted(starts, row_at)
    n_words = np.diff(first)
    sums = np.stack([np.add.reduceat(_KIND[buffer, k], row_at[:-1]) for k in range(6)], axis=1)
    size = np.maximum(np.diff(row_at) - 1, 1)
    out[:, :6] = sums / size[:, None]
    width = ends - starts
    row = np.repeat(np.arange(n), n_words)
    w = np.maximum(n_words, 1)
    mean = np.bincount(row, weights=width, minlength=n) / w
    out[:, 6] = mean / 10
    out[:, 7] = np.bincount(row, weights=width > 20, minlength=n) / w
    out[:, 8] = np.log1p(n_words) / 10
    out[:, 9] = n_words == 0
    last = buffer[np.maximum(ends - 1, 0)] if len(ends) else np.zeros(0, np.uint8)
    initial = buffer[starts] if len(starts) else last
    out[:, 10] = np.bincount(row, weights=_KIND[last, 3], minlength=n) / w
    out[:, 11] = np.bincount(row, weights=_KIND[initial, 0], minlength=n) / w
    out[:, 12] = np.bincount(row, weights=(last == ord(".")), minlength=n) / w
    out[:, 13] = np.bincount(row, weights=_KIND[last, 4] | (last == ord("!")), minlength=n) / w
    follows = np.zeros(len(keys), bool)
    follows[1:] = (keys[1:] == keys[:-1]) & (row[1:] == row[:-1])
    out[:, 14] = np.bincount(row, weights=follows, minlength=n) / w
    newline = np.add.reduceat((buffer == 10).astype(np.int32), row_at[:-1]) - 1
    out[:, 15] = newline / w
    for r, text in enumerate(column.to_pylist()):
        own = np.sort(keys[first[r] : first[r + 1]])
        if len(own):
            kinds = 1 + int((own[1:] != own[:-1]).sum())
            out[r, 16] = kinds / len(own)
            out[r, 17] = kinds / len(own) ** 0.5 / 10
            lines = [x for x in text.split("\n") if x]
            out[r, 18] = 1 - len(set(lines)) / max(1, len(lines))
            out[r, 19] = min(1.0, len(text) / max(1, len(lines)) / 500)
    out[:, 20] = (out[:, 0] > 0.5) * 1.0
    out[:, 21] = (out[:, 13] > 0.3) * 1.0
    bucket = (keys >> np.uint64(40)) % np.uint64(_HASHED)
    hashed = np.bincount(row * _HASHED + bucket.astype(np.int64), minlength=n * _HASHED).reshape(n, _HASHED)
    hashed = np.log1p(hashed)
    out[:, _COUNTED:] = hashed / np.maximum(np.linalg.norm(hashed, axis=1, keepdims=True), 1e-9)
    return out


def meta_view(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    """Features of metadata, never of the text: hashed values of the columns, and magnitudes of numbers."""
    out = np.zeros((batch.num_rows, _META), dtype=np.float32)
    for c, name in enumerate(columns):
        for r, v in enumerate(batch.column(name).to_pylist()):
            if isinstance(v, (int, float)) and not isinstance(v, bool):
                size = np.log1p(abs(v)) if np.isfinite(v) else 0.0
                out[r, 0] += size / 10
                out[r, 1 + int(min(size * 2, 30))] = 1
            else:
                raw = np.frombuffer(f"{c}:{v}".encode(), np.uint8)
                key = textbytes.keys(raw, np.array([0]), np.array([len(raw)]))[0]
                out[r, 32 + int(key % np.uint64(64))] = 1
    return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights (the last one constant) of ridge-penalised logistic regression, by Newton's method."""
    one = np.concatenate([x, np.ones((len(x), 1), x.dtype)], axis=1).astype(np.float64)
    weight = np.ones(len(x)) if weight is None else weight
    w = np.zeros(one.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(one @ w, -30, 30)))
        grad = one.T @ (weight * (p - y)) + penalty * w
        step = np.linalg.solve((one * (weight * p * (1 - p))[:, None]).T @ one + np.diag(penalty), grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def margin(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x.astype(np.float64) @ w[:-1] + w[-1]


@dataclass
class Taught:
    """Rows of the pool that a view labels for the other one: ``kind`` is 2 * view + label; ids and the features of both views."""

    kind: np.ndarray
    ids: list[int]
    views: tuple[np.ndarray, np.ndarray]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def least_sure(good: float, sure: float, lift: float) -> tuple[float, float]:
    """The probability from which on a view may label a row 0 or 1: at least ``sure``, and odds of ``lift`` times those of the class itself, as a view that only knows how frequent a class is has nothing to teach."""
    out = []
    for part in (1 - good, good):
        odds = lift * part / max(1 - part, 1e-9)
        out.append(max(sure, odds / (1 + odds)))
    return out[0], out[1]


def surest(models: list[np.ndarray], views: tuple[np.ndarray, np.ndarray], ids: np.ndarray, given: list[dict[int, int]], least: tuple[float, float], most: tuple[int, int]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For each kind the places of the rows that a view is surest of and hasn't given yet, and how sure it is; ``most`` of each label, ties by id."""
    out = []
    for view in (0, 1):
        p = sigmoid(margin(views[view], models[view]))
        free = ~np.isin(ids, np.fromiter(given[1 - view], np.int64, len(given[1 - view])))
        for label in (0, 1):
            likely = p if label else 1 - p
            at = np.flatnonzero(free & (likely >= least[label]))
            at = at[np.lexsort((ids[at], -likely[at]))][: most[label]]
            out.append((2 * view + label, at, likely[at]))
    return out


def co_train(views: tuple[np.ndarray, np.ndarray], y: np.ndarray, pool, *, rounds: int = 5, most_taught: int = 400, trust: float = 0.5, sure: float = 0.9, lift: float = 3.0) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """The two classifiers after exchanging pseudo-labels, and how many rows of each kind were given in each round.

    In each round either view labels, out of the whole pool, the rows of each class that it is
    surest of (``most_taught`` of them, split as the labels are; see :func:`least_sure`). They join
    the other view's training rows with weight ``trust``, once each. ``pool(models, given, least,
    most)`` returns them as :class:`Taught`.
    """
    given: list[dict[int, int]] = [{}, {}]
    taught: list[list[tuple[np.ndarray, int]]] = [[], []]
    good = float(y.mean()) if len(y) else 0.5
    least, most = least_sure(good, sure, lift), (max(1, round(most_taught * (1 - good))), max(1, round(most_taught * good)))
    models, counts = [fit(v, y) for v in views], []
    for _ in range(rounds):
        found = pool(models, given, least, most)
        new = [0, 0, 0, 0]
        for k, i, *rows in zip(found.kind.tolist(), found.ids, *found.views):
            other = 1 - k // 2
            if i not in given[other]:
                given[other][i] = k % 2
                taught[other].append((rows[other], k % 2))
                new[k] += 1
        counts.append(new)
        if not any(new):
            break
        for view in (0, 1):
            if taught[view]:
                x = np.concatenate([views[view], np.stack([r for r, _ in taught[view]])])
                labels = np.concatenate([y, np.array([label for _, label in taught[view]], float)])
                models[view] = fit(x, labels, np.concatenate([np.ones(len(y)), np.full(len(taught[view]), trust)]))
    return models[0], models[1], counts


@dataclass
class Model:
    views: tuple[np.ndarray, np.ndarray]
    calibration: tuple[np.ndarray, np.ndarray]
    combined: np.ndarray
    columns: list[str]
    #: For each round the rows given: by the text view as 0 and as 1, by the metadata view as 0 and as 1.
    exchanged: list[list[int]] = field(default_factory=list)

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw = [margin(x, w) for x, w in zip((text, meta), self.views)]
        calibrated = np.stack([margin(m[:, None], c) for m, c in zip(raw, self.calibration)], axis=1)
        return sigmoid(calibrated[:, 0]), sigmoid(calibrated[:, 1]), sigmoid(margin(calibrated, self.combined))


def _both(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for whole in batches:
        for batch in textbytes.slices(whole, "text"):
            yield batch, text_view(batch.column("text")), meta_view(batch, columns)


def _numbers(rows: list[bytes], n: int) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, rows)), np.float32).reshape(-1, n)


def _pool(rows: DataFrame):
    """The pool of :func:`co_train` over a table of features: every task takes its surest rows of each kind, and the surest of these are taken."""

    def ask(models, given, least, most) -> Taught:
        def run(batches):
            held: dict[int, list[tuple[float, int, bytes, bytes]]] = {k: [] for k in range(4)}
            for batch in batches:
                ids, raw = np.asarray(batch.column("id")), [batch.column(c) for c in ("text", "meta")]
                views = tuple(_numbers(c.to_pylist(), n) for c, n in zip(raw, WIDTHS))
                for kind, at, likely in surest(models, views, ids, given, least, most):
                    held[kind] += [(-p, int(ids[i]), raw[0][i].as_py(), raw[1][i].as_py()) for i, p in zip(at.tolist(), likely.tolist())]
                    held[kind] = sorted(held[kind], key=lambda r: r[:2])[: most[kind % 2]]
            out = [(kind, *r) for kind in held for r in held[kind]]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.float64(), pa.int64(), pa.binary(), pa.binary()))], ["kind", "far", "id", "text", "meta"])

        every = rows.mapInArrow(run, "kind int, far double, id long, text binary, meta binary")
        place = F.row_number().over(Window.partitionBy("kind").orderBy("far", "id"))
        best = every.withColumn("place", place).where(F.col("place") <= F.when(F.col("kind") % 2 == 0, most[0]).otherwise(most[1])).orderBy("kind", "place").collect()
        return Taught(np.array([r["kind"] for r in best], int), [r["id"] for r in best], tuple(_numbers([r[c] for r in best], n) for c, n in zip(("text", "meta"), WIDTHS)))

    return ask


def train(docs: DataFrame, labels: DataFrame, *, columns: tuple[str, ...] = ("lang", "source", "n_chars"), held_out_of: int = 5, most_labelled: int = 10_000, most_taught: int = 400, rounds: int = 5) -> Model:
    """Learns from rows of ``labels(doc_id, quality)`` whose crc32 of the id is not 0 modulo ``held_out_of``.

    About ``most_labelled`` labelled documents, chosen by a hash of the id, and ``most_taught``
    pseudo-labelled ones a round and view are used; this bounds what the driver fits. The pool is
    every unlabelled document: their features are kept in the shared folder and scored anew in each
    round. A fifth of the labelled rows calibrates the views and their combination. Labels other
    than 0 and 1, null ids and ids with labels that differ are left out; held-out rows are not in
    the pool. Without labels every score is 0.5, without a pool nothing is exchanged.
    """
    columns_ = [c for c in columns if c in docs.columns]
    held_out = F.crc32(F.col("id").cast("string")) % held_out_of == 0
    named = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min("quality").cast("int").alias("y"), F.max("quality").cast("int").alias("most")).where(~held_out)
    named = cut(named.select("id", F.when(F.col("y").isin(0, 1) & (F.col("y") == F.col("most")), F.col("y")).otherwise(-2).alias("y")))
    n = {r["known"]: r["n"] for r in named.groupBy((F.col("y") >= 0).alias("known")).agg(F.count("*").alias("n")).collect()}
    if n.get(True, 0) > most_labelled:
        kept = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int((1 << 20) * most_labelled / n[True])
        named = named.withColumn("y", F.when((F.col("y") < 0) | kept, F.col("y")).otherwise(-2))
    if sum(n.values()) <= 1_000_000:
        named = F.broadcast(named)
    base = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), *columns_).where(F.col("id").isNotNull()).where(~held_out)

    def features(batches):
        for batch, text, meta in _both(batches, columns_):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([r.tobytes() for r in text], pa.binary()), pa.array([r.tobytes() for r in meta], pa.binary())], ["id", "text", "meta"])

    rows = base.mapInArrow(features, "id long, text binary, meta binary").join(named, "id", "left").withColumn("y", F.coalesce("y", F.lit(-1)))
    rows = cut(rows.where("y >= -1"))
    some = sorted(rows.where("y >= 0").collect(), key=lambda r: (r["id"], r["y"], bytes(r["text"])))
    check = np.arange(len(some)) % 5 == 0
    y = np.array([r["y"] for r in some], float)
    views = tuple(_numbers([r[c] for r in some], k) for c, k in zip(("text", "meta"), WIDTHS))
    if not len(y):
        return Model(tuple(np.zeros(k + 1) for k in WIDTHS), (np.array([1.0, 0]),) * 2, np.array([0.5, 0.5, 0.0]), columns_)
    *models, exchanged = co_train(tuple(v[~check] for v in views), y[~check], _pool(rows.where("y = -1").select("id", "text", "meta")), rounds=rounds, most_taught=most_taught)
    raw = [margin(v[check], w) for v, w in zip(views, models)]
    calibration = tuple(fit(m[:, None], y[check], ridge=0.01) for m in raw)
    joint = np.stack([margin(m[:, None], c) for m, c in zip(raw, calibration)], axis=1)
    return Model(tuple(models), calibration, fit(joint, y[check], ridge=0.1), columns_, exchanged)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, text_score, meta_score, score, predicted`` for each row of ``docs``: the calibrated views and their combination (1: good).

    A null or empty text has the features of no words, null metadata are a value of their own.
    Repeated rows are scored again, an empty table gives no rows, other columns are ignored.
    """

    def run(batches):
        for batch, text, meta in _both(batches, model.columns):
            t, m, s = model.scores(text, meta)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(t), pa.array(m), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "text_score", "meta_score", "score", "predicted"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *model.columns)
    return chosen.mapInArrow(run, SCHEMA)


def digest(scored: DataFrame, held_out_of: int = 5) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string")) % held_out_of == 0
    return scored.select("doc_id", held.alias("held_out"), "text_score", "meta_score", "score", "predicted")
