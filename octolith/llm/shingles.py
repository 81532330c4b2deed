"""Near-duplicates by word shingles: SimHash fingerprints compared in tiles, every link confirmed on the whole sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from octolith.llm import textbytes, worker
from octolith.llm.components import components
from octolith.llm.simhash import keep_first
from octolith.llm.spark import cut, spread_join

WIDTH, SIMILARITY = 5, 0.8
_RADIX = 0xD1342543DE82EF95
#: 64-bit words of a fingerprint, and how many of them are compared first.
WORDS, FIRST = 8, 2
_SEEDS = np.random.default_rng(20240205).integers(0, 1 << 63, WORDS, dtype=np.uint64)
#: Sets of a chunk at least, unless its cell has fewer; beyond ``_CHUNKS`` times that, chunks grow with the table.
_CHUNK, _CHUNKS = 8192, 64
#: A tile that has more close pairs than this for each of its sets gives a forest of them first.
_FEW = 4
#: Close pairs that a tile holds at once, and the sides of a block of comparisons.
_HELD, _BLOCK, _MET = 1 << 20, 128, 2048
#: Up to so many ids are broadcast.
_BROADCAST = 1_000_000


def sets(column: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """The sorted, different hashes of each text's word shingles. A text of fewer words has one shingle, a text without words none."""
    buffer, rows = textbytes.joined(column)
    starts, ends = textbytes.words(buffer, textbytes.SPACED)
    keys = np.concatenate([textbytes.keys(buffer, starts, ends), np.zeros(width, np.uint64)])
    at = np.searchsorted(starts, rows)
    hashes, power = np.zeros(len(starts), np.uint64), [np.uint64(pow(_RADIX, k, 1 << 64)) for k in range(width)]
    for k in range(width):
        hashes += keys[k : k + len(starts)] * power[k]
    hashes, out = textbytes.mix(hashes), []
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
        if 0 < hi - lo < width:
            out.append(textbytes.mix(np.array([(keys[lo:hi] * np.array(power[: hi - lo])).sum()], np.uint64)))
        else:
            out.append(np.unique(hashes[lo : max(lo, hi - width + 1)]))
    return out


def fingerprint(own: np.ndarray) -> np.ndarray:
    """SimHash of a set: 512 bits, each set if it is set in over half the hashes of the set's members."""
    count = np.zeros(WORDS * 64, np.int64)
    for at in range(0, len(own), 255):
        hashes = textbytes.mix(own[at : at + 255, None] ^ _SEEDS)
        count += np.unpackbits(hashes.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * count > len(own)).view(np.uint64)


def parities(own: np.ndarray) -> np.ndarray:
    """1,024 bits: whether an odd number of the set's hashes fall on each. Two sets differ in no fewer hashes than in these bits, so they can rule a link out and never rule out a right one."""
    odd = np.bincount((own & np.uint64(1023)).astype(np.int64), minlength=1024) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def reach(bits: int, similarity: float) -> int:
    """How far the fingerprints of two sets of that similarity can be apart, of so many bits.

    A bit of theirs differs with a chance of p = arccos(2s / (1 + s)) / pi if the sets are large, and
    of at most 1.25 p if they are small (at 0.8: 0.1515, and 0.1875 for four members and the same
    with a fifth). Bits are independent, so these are binomial: the radius is six standard
    deviations above the mean at 1.25 p.
    """
    p = 1.25 * math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    return math.ceil(bits * p + 6 * math.sqrt(bits * p * (1 - p)))


def _id(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes())


def _signed(values) -> pa.Array:
    return pa.array(np.asarray(values, np.uint64).view(np.int64))


def _texts(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tid"))


def marked(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id, tid, sid, size, fp`` of each row: hashes of its text and of its set, the set's size and, where a task first meets it, its fingerprint and parities."""

    def run(batches):
        worker.clear()
        seen = set()
        for batch in batches:
            for part in textbytes.slices(batch, "text"):
                sid, size, fp = [], [], []
                for own in sets(part.column("text"), width):
                    sid.append(_id(own))
                    size.append(len(own))
                    fp.append(fingerprint(own).tobytes() + parities(own).tobytes() if len(own) and sid[-1] not in seen else None)
                    seen.add(sid[-1])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tid"), _signed(sid), pa.array(size, pa.int32()), pa.array(fp, pa.binary())], ["doc_id", "tid", "sid", "size", "fp"])

    return _texts(docs).mapInArrow(run, "doc_id long, tid long, sid long, size int, fp binary")


def _step(similarity: float) -> float:
    """Width of a cell of sizes, as a logarithm: similar sets lie in one cell or in neighbouring ones."""
    return max(-math.log(similarity) * 1.001, 1e-3)


def deal(counts: dict[int, int]) -> list[tuple[int, int, int, int]]:
    """``cell, chunk, tile, side``: which tiles each chunk of each cell goes to.

    Cells of sizes have so many sets. Every two chunks of a cell, and of neighbouring cells, meet in
    one tile; a chunk meets itself in a tile of its own, of side -1.
    """
    chunk = max(_CHUNK, -(-sum(counts.values()) // _CHUNKS))
    parts = {cell: -(-n // chunk) for cell, n in counts.items()}
    pairs = [(cell, a, other, b) for cell in sorted(parts) for other in (cell, cell + 1) for a in range(parts[cell]) for b in range(a if other == cell else 0, parts.get(other, 0))]
    out = []
    for tile, (cell, a, other, b) in enumerate(pairs):
        same = (cell, a) == (other, b)
        out += [(cell, a, tile, -1)] if same else [(cell, a, tile, 0), (other, b, tile, 1)]
    return out


def _members(docs: DataFrame, tids: DataFrame, width: int) -> DataFrame:
    """``sid, hashes`` of the sets of the texts with these hashes."""

    def run(batches):
        seen = set()
        for batch in batches:
            for part in textbytes.slices(batch, "text"):
                new = {i: s for s in sets(part.column("text"), width) if (i := _id(s)) not in seen}
                seen |= new.keys()
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in new.values()])]).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, _signed(np.concatenate([np.zeros(0, np.uint64), *new.values()])))
                yield pa.RecordBatch.from_arrays([_signed(list(new)), lists], ["sid", "hashes"])

    if tids.count() <= _BROADCAST:
        tids = F.broadcast(tids)
    chosen = _texts(docs).select("tid", "text").join(tids, "tid", "left_semi").select("text")
    held = chosen.mapInArrow(run, "sid long, hashes array<long>")
    return held.groupBy("sid").agg(F.first("hashes").alias("hashes"))


def _whole_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows again, never parting those of one tile."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = np.asarray(batch.column("tile"))
        cut_at = int(np.searchsorted(last != last[-1], False, side="left")) if last[0] == last[-1] else int(np.flatnonzero(last != last[-1])[-1]) + 1
        if cut_at or (held and held[-1].column("tile")[-1].as_py() != last[0]):
            if held or cut_at:
                yield pa.Table.from_batches([*held, batch.slice(0, cut_at)])
            held = []
        held.append(batch.slice(cut_at))
    if held:
        yield pa.Table.from_batches(held)


def close_pairs(side: np.ndarray, size: np.ndarray, root: np.ndarray, words: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of rows of a tile whose fingerprints are within the radius and whose roots differ, with how far they are apart, block by block.

    Rows are sorted by size. With similar sets the smaller has at least ``similarity`` of the larger
    one's size, so a block of rows meets only the window of such sizes, by exclusive-or and bit
    counts: the first words of all, the rest of those that are close in these. Blocks whose
    population counts all differ beyond the radius are skipped. Of the close pairs those go whose
    parities show more hashes in one set only than two similar sets of these sizes have. A tile of side -1 is one chunk that
    meets itself; of others one side meets the other.
    """
    alone = bool(len(side)) and side[0] < 0
    left, right = (np.arange(len(side)),) * 2 if alone else (np.flatnonzero(side == k) for k in (0, 1))
    if not len(left) or not len(right):
        return
    bits, odd, share = words[:, :WORDS], words[:, WORDS:], (1 - similarity) / (1 + similarity)
    first, radius = reach(FIRST * 64, similarity), reach(WORDS * 64, similarity)
    ones = np.bitwise_count(bits).sum(axis=1, dtype=np.int32)
    sizes = size[right]
    for at in range(0, len(left), _BLOCK):
        rows = left[at : at + _BLOCK]
        lo = at if alone else int(np.searchsorted(sizes, similarity * size[rows[0]] - 1e-9))
        hi = int(np.searchsorted(sizes, size[rows[-1]] / similarity + 1e-9, side="right"))
        for begin in range(lo, hi, _MET):
            met = right[begin : min(begin + _MET, hi)]
            if ones[rows].min() - ones[met].max() > radius or ones[met].min() - ones[rows].max() > radius:
                continue
            far = np.bitwise_count(bits[rows, 0][:, None] ^ bits[met, 0])
            for k in range(1, FIRST):
                far += np.bitwise_count(bits[rows, k][:, None] ^ bits[met, k])
            near = np.flatnonzero(far.reshape(-1) <= first)
            i, j = rows[near // len(met)], met[near % len(met)]
            may = root[i] != root[j]
            may &= np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]) - 1e-9
            if alone:
                may &= i < j
            i, j = i[may], j[may]
            near = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int32) <= radius
            i, j = i[near], j[near]
            apart = np.bitwise_count(odd[i] ^ odd[j]).sum(axis=1, dtype=np.int32) / (share * (size[i] + size[j]) + 1e-6)
            near = apart <= 1
            if near.any():
                yield i[near], j[near], apart[near]


def spanning(u: np.ndarray, v: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Indices of a spanning forest of least weight of the graph of n nodes, by Boruvka's rounds."""
    rank = np.empty(len(u), np.int64)
    rank[np.argsort(weight, kind="stable")] = np.arange(len(u))
    label, chosen, open_ = np.arange(n), [], np.arange(len(u))
    by_rank = np.argsort(rank)
    while True:
        open_ = open_[label[u[open_]] != label[v[open_]]]
        if not len(open_):
            return np.unique(np.concatenate([np.zeros(0, np.int64), *chosen]))
        best = np.full(n, len(u), np.int64)
        np.minimum.at(best, label[u[open_]], rank[open_])
        np.minimum.at(best, label[v[open_]], rank[open_])
        new = by_rank[np.unique(best[best < len(u)])]
        chosen.append(new)
        while True:
            low = np.minimum(label[u[new]], label[v[new]])
            before = label.copy()
            np.minimum.at(label, before[u[new]], low)
            np.minimum.at(label, before[v[new]], low)
            label = label[label]
            if (label == before).all():
                break


def _forest(found: list[tuple], root: np.ndarray) -> list[tuple]:
    """Pairs reduced to a spanning forest of the closest ones over their roots."""
    i, j, apart = (np.concatenate(c) for c in zip(*found))
    nodes = np.unique(root, return_inverse=True)[1].reshape(-1)
    some = spanning(nodes[i], nodes[j], apart, int(nodes.max()) + 1)
    return [(i[some], j[some], apart[some])]


def _compared(batches: Iterator[pa.RecordBatch], similarity: float, forest: bool) -> Iterator[pa.RecordBatch]:
    """The close pairs of each tile. With ``forest`` a tile of many gives a spanning forest of its closest ones, and its number in ``again``."""
    for table in _whole_tiles(batches):
        table = table.combine_chunks()
        tiles, sides, sids, sizes, roots = (np.asarray(table.column(c).combine_chunks()) for c in ("tile", "side", "sid", "size", "root"))
        every = np.frombuffer(b"".join(table.column("fp").to_pylist()), np.uint64).reshape(len(sids), -1)
        edges = np.flatnonzero(np.concatenate([[True], tiles[1:] != tiles[:-1], [True]]))
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
            sid, root, found, many = sids[lo:hi], roots[lo:hi], [], False
            held = 0
            for part in close_pairs(sides[lo:hi], sizes[lo:hi].astype(np.int64), root, every[lo:hi], similarity):
                if not forest:
                    yield _named(sid, root, part[0], part[1], None)
                    continue
                found.append(part)
                held += len(part[0])
                if held > _HELD:
                    found, many = _forest(found, root), True
                    held = len(found[0][0])
            if found:
                many |= held > _FEW * (hi - lo)
                i, j, _ = (np.concatenate(c) for c in zip(*(_forest(found, root) if many else found)))
                yield _named(sid, root, i, j, int(tiles[lo]) if many else None)


def _named(sid: np.ndarray, root: np.ndarray, i: np.ndarray, j: np.ndarray, again: int | None) -> pa.RecordBatch:
    i, j = np.where(sid[i] < sid[j], i, j), np.where(sid[i] < sid[j], j, i)
    return pa.RecordBatch.from_arrays([*(pa.array(c) for c in (sid[i], sid[j], root[i], root[j])), pa.array([again] * len(i), pa.int64())], ["a", "b", "ra", "rb", "again"])


def _close(each: DataFrame, dealt: list[tuple], roots: DataFrame | None, similarity: float) -> DataFrame:
    """Pairs of sets that meet in these tiles, aren't connected yet and whose fingerprints allow a link, with their roots: all, or without roots as :func:`_compared` has it."""
    forest = roots is None
    if forest:
        rooted = each.withColumn("root", F.col("sid"))
    else:
        rooted = each.join(roots.withColumnRenamed("v", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    to = F.broadcast(each.sparkSession.createDataFrame(dealt, "cell int, chunk int, tile long, side int"))
    met = rooted.join(to, ["cell", "chunk"]).select("tile", "side", "sid", "size", "root", "fp")
    met = met.repartition("tile").sortWithinPartitions("tile", "size", "sid")
    return met.mapInArrow(lambda batches: _compared(batches, similarity, forest), "a long, b long, ra long, rb long, again long")


def _confirmed(pairs: DataFrame, held: DataFrame, similarity: float) -> DataFrame:
    """The pairs, and in ``linked`` whether their whole sets are so similar."""
    met = pairs.join(held.select(F.col("sid").alias("a"), F.col("hashes").alias("left")), "a")
    met = met.join(held.select(F.col("sid").alias("b"), F.col("hashes").alias("right")), "b")
    shared = F.size(F.array_intersect("left", "right"))
    return met.select("a", "b", "ra", "rb", (shared >= similarity * (F.size("left") + F.size("right") - shared) - 1e-9).alias("linked"))


def links(docs: DataFrame, mark: DataFrame, *, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """``v, root`` of the sets of ``mark`` that are linked to others: components over pairs of that similarity or more."""
    each = mark.where("fp is not null").groupBy("sid").agg(F.min("tid").alias("tid"), F.first("size").alias("size"), F.first("fp").alias("fp"))
    each = cut(each.withColumn("cell", F.floor(F.log("size") / _step(similarity)).cast("int")))
    dealt = deal({x.cell: x.n for x in each.groupBy("cell").agg(F.count("*").alias("n")).collect()})  # cells are few: logarithms of sizes
    nothing = each.select(F.col("sid").alias("v"), F.col("sid").alias("root")).limit(0)
    if not dealt:
        return nothing
    parts = each.sparkSession.createDataFrame(sorted({cell: chunk + 1 for cell, chunk, _, _ in sorted(dealt)}.items()), "cell int, parts int")
    each = each.join(F.broadcast(parts), "cell").withColumn("chunk", F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int")).drop("parts")
    first = cut(_close(each, dealt, None, similarity))
    some = first.select(F.col("a").alias("sid")).unionByName(first.select(F.col("b").alias("sid"))).distinct()
    held = cut(_members(docs, cut(each.join(some, "sid", "left_semi").select("tid").distinct()), width))
    tried = cut(_confirmed(first.drop("again"), held, similarity))
    linked = tried.where("linked").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    roots = nothing if linked.isEmpty() else cut(components(linked))
    again = {x.again for x in first.where("again is not null").select("again").distinct().collect()}
    if not again:
        return roots
    # a set with a close pair has one in its tile's forest too, so its members are held
    rest = _close(each, [d for d in dealt if d[2] in again], roots, similarity).drop("again").join(tried.select("a", "b"), ["a", "b"], "left_anti")
    linked = cut(_confirmed(cut(rest), held, similarity)).where("linked").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    if linked.isEmpty():
        return roots
    merged = cut(components(linked))
    moved = roots.join(merged.select(F.col("v").alias("root"), F.col("root").alias("to")), "root", "left").select("v", F.coalesce("to", "root").alias("root"))
    return cut(moved.unionByName(merged.join(roots.select("v"), "v", "left_anti")))


def _smallest(docs: DataFrame, width: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """The marks of the rows, and ``sid, component_id`` of each set."""
    mark = cut(marked(docs, width))
    roots = links(docs, mark, width=width, similarity=similarity).withColumnRenamed("v", "sid")
    each = mark.groupBy("sid").agg(F.min("doc_id").alias("first")).join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    each = cut(each)
    return mark, cut(spread_join(each, each.groupBy("root").agg(F.min("first").alias("component_id")), "root", "sid").select("sid", "component_id"))


def groups(docs: DataFrame, *, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """Near-duplicate groups of ``docs(doc_id, text)``: ``doc_id, component_id`` for each row.

    ``component_id`` is the smallest ``doc_id`` reachable over pairs whose sets of word shingles
    have that Jaccard similarity or more; a null ``doc_id`` is never the smallest. Texts without
    words are one group, repeated rows are returned again, an empty table gives no rows, other
    columns are ignored.

    Sets whose sizes allow a link meet in tiles, all of them: nothing is left to chance but a pair
    whose SimHash fingerprints are further apart than :func:`reach` allows. Fingerprints are
    compared by exclusive-or and bit counts; parities of the sets can rule a close pair out, and
    every link is confirmed on the whole sets. A tile with
    many close pairs first gives a spanning forest of the closest, which connects nearly all of a
    large group; what is not connected then is compared without exception. Comparisons number the
    square of the different sets, 4 ns each.
    """
    mark, named = _smallest(docs, width, similarity)
    return spread_join(mark, named, "sid", "doc_id").select("doc_id", "component_id")


def deduplicate(docs: DataFrame, *, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """One row of ``docs`` for each near-duplicate group: that of the smallest ``doc_id``. Rows with a null ``doc_id`` stay; all columns stay as they are."""
    return keep_first(docs, _smallest(docs, width, similarity)[1].select("component_id"))
