"""SimHash near-duplicates: fingerprints, tiled exact comparison, components."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from octolith.llm import textbytes
from octolith.llm.components import components
from octolith.llm.spark import cut, spread_join, temporary

_QUARTER = 16


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """64 bits, each set if it is set in over half the hashes of the word shingles."""
    words = (text or "").encode().translate(textbytes.LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, seed)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest = xxhash.xxh64_intdigest
    view = [digest(joined[a:b], seed) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())]
    hashes = np.array(view, dtype=np.uint64)
    count = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(count * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *, width: int = 3, seed: int = 42) -> DataFrame:
    """``doc_id, fp`` of each row of ``docs(doc_id, text)``; the 64 bits are a signed long. No text: 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t.as_py(), width, seed) for t in batch.column("text")), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _shifts(radius: int) -> list[tuple[int, int, int, int]]:
    """Differences of the four population counts that a pair within the radius can have; of each pair of opposite ones, one."""
    every = itertools.product(range(-radius, radius + 1), repeat=4)
    return [d for d in every if sum(map(abs, d)) <= radius and d >= (0, 0, 0, 0)]


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of n members reduced to a path through each connected set: no member gets many links."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        np.minimum.at(label, before[a], low)
        np.minimum.at(label, before[b], low)
        label = label[label]
        if (label == before).all():
            break
    members = np.unique(np.concatenate([a, b]))
    members = members[np.argsort(label[members], kind="stable")]
    same = label[members[1:]] == label[members[:-1]]
    return members[:-1][same], members[1:][same]


def _compare(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out_a, out_b = [], []
        left, right = batch.column("left"), batch.column("right")
        lo, ro = np.asarray(left.offsets), np.asarray(right.offsets)
        lv, rv = (np.asarray(x.values).view(np.uint64) for x in (left, right))
        same = batch.column("same").to_pylist()
        for k in range(batch.num_rows):
            x, y = lv[lo[k] : lo[k + 1]], rv[ro[k] : ro[k + 1]]
            links_a, links_b = [], []
            step = max(1, (1 << 18) // max(1, len(y)))
            for at in range(0, len(x), step):
                i, j = np.nonzero(np.bitwise_count(x[at : at + step, None] ^ y) <= radius)
                links_a.append(i + at)
                links_b.append(j)
            i, j = np.concatenate(links_a), np.concatenate(links_b)
            if same[k]:
                i, j = i[i < j], j[i < j]
                both = x
            else:
                both, j = np.concatenate([x, y]), j + len(x)
            if len(i):
                i, j = _forest(i, j, len(both))
                out_a.append(both[i])
                out_b.append(both[j])
        if out_a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o).view(np.int64)) for o in (out_a, out_b)], ["a", "b"])


def links(fps: DataFrame, *, radius: int = 3, tile: int = 8192) -> DataFrame:
    """``a, b``: links that connect the fingerprints of ``fps(fp)`` (all different) exactly as all pairs within the radius do.

    Tiles hold fingerprints whose four 16-bit quarters have the same population counts. A pair of
    tiles is skipped if the counts differ by more than the radius in sum, since each differing bit
    changes one of them by one. Tiles of over ``tile`` members are cut into chunks; there are at
    most 17**4 tiles, so their counts can be broadcast.
    """
    quarter = [F.bit_count(F.col("fp").bitwiseAND(F.lit(0xFFFF << s if s < 48 else -(1 << 48)).cast("long"))) for s in (0, 16, 32, 48)]
    cell = sum((q * 17**k for k, q in enumerate(quarter[1:], 1)), quarter[0]).cast("int")
    placed = fps.withColumn("cell", cell)
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / tile).cast("int").alias("chunks"))
    sizes = F.broadcast(sizes)
    blobs = placed.join(sizes, "cell").withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    blobs = blobs.groupBy("cell", "chunk").agg(F.collect_list("fp").alias("fps"))
    blobs = cut(blobs.withColumn("chunk", F.row_number().over(Window.partitionBy("cell").orderBy("chunk")) - 1))  # without gaps
    steps = F.array(*[F.struct(F.lit(sum(x * 17**k for k, x in enumerate(d))).alias("step"), *[F.lit(x).alias(f"d{k}") for k, x in enumerate(d)]) for d in _shifts(radius)])
    there = F.broadcast(blobs.groupBy(F.col("cell").alias("other")).agg(F.count("*").cast("int").alias("parts")))
    sent = blobs.select("cell", F.col("chunk").alias("left_chunk"), F.col("fps").alias("left"), F.inline(steps))
    for k in range(4):
        count = F.floor(F.col("cell") / 17**k).cast("int") % 17 + F.col(f"d{k}")
        sent = sent.where((count >= 0) & (count <= _QUARTER))
    sent = sent.withColumn("other", F.col("cell") + F.col("step")).join(there, "other")
    # a chunk goes to each chunk of a neighbouring cell, so the chunks of a full cell are compared in tasks of their own
    sent = sent.select(F.col("cell").alias("from"), "left_chunk", "left", F.col("other").alias("cell"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("chunk"))
    met = sent.join(blobs.withColumnRenamed("fps", "right"), ["cell", "chunk"])
    inner = F.col("from") == F.col("cell")
    met = met.where(~inner | (F.col("left_chunk") <= F.col("chunk")))
    met = met.select("left", "right", (inner & (F.col("left_chunk") == F.col("chunk"))).alias("same"))
    return met.mapInArrow(lambda batches: _compare(batches, radius), "a long, b long")


def groups(docs: DataFrame, *, width: int = 3, seed: int = 42, radius: int = 3) -> DataFrame:
    """Near-duplicate groups of ``docs(doc_id, text)``: ``doc_id, fp, component_id`` for each row.

    ``component_id`` is the smallest ``doc_id`` that is reachable over links between fingerprints
    with at most ``radius`` differing bits; exact copies share a fingerprint and need no links.
    Documents without words (null, empty) have fingerprint zero and are linked like any other. A
    null ``doc_id`` is never the smallest; a group of only such rows has a null id. Repeated rows
    are returned again, an empty table gives no rows, other columns are ignored.
    """
    marked = cut(fingerprints(docs, width=width, seed=seed))
    first = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    edges = links(first.select("fp"), radius=radius)
    # fingerprints of one group resemble each other; their hashes carry no order
    number = lambda c: F.xxhash64(c)
    roots = components(edges.select(number("a").alias("a"), number("b").alias("b")))
    rooted = first.withColumn("v", number("fp")).join(roots, "v", "left").withColumn("root", F.coalesce("root", "v"))
    rooted = cut(rooted.select("fp", "first", "root"))
    smallest = cut(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    named = cut(spread_join(rooted, smallest, "root", "fp").select("fp", "component_id"))
    return spread_join(marked, named, "fp", "doc_id").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, *, width: int = 3, seed: int = 42, radius: int = 3) -> DataFrame:
    """One row of ``docs`` for each near-duplicate group: that of the smallest ``doc_id``.

    Rows with a null ``doc_id`` cannot be named and stay. Of rows that repeat the ``doc_id`` one
    stays. All columns stay as they are.
    """
    return keep_first(docs, groups(docs, width=width, seed=seed, radius=radius).where("doc_id = component_id").select("component_id"))


def keep_first(docs: DataFrame, named: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``doc_id`` is in ``named(component_id)``, and those without one. Of rows that repeat a ``doc_id`` the first in the order of all columns stays."""
    kept, number = temporary(docs, "kept_id"), temporary(docs, "kept_number")
    keep = named.select(F.col("component_id").alias(kept)).where(F.col(kept).isNotNull()).distinct()
    rows = docs.where("doc_id is not null").join(keep, F.col("doc_id") == F.col(kept), "left_semi")
    plain = [f.name for f in docs.schema if isinstance(f.dataType, T.AtomicType) and f.name != "doc_id"]
    window = Window.partitionBy("doc_id").orderBy("doc_id", *[docs[f"`{c}`"] for c in plain])
    rows = rows.withColumn(number, F.row_number().over(window)).where(F.col(number) == 1).drop(number)
    return rows.unionByName(docs.where("doc_id is null"))


def digest(grouped: DataFrame) -> DataFrame:
    return grouped.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
