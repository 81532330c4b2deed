"""Benchmark decontamination: an FM-index for each shard of the corpus, searched for benchmark phrases."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from octolith.llm import textbytes, worker
from octolith.llm.fmindex import FMIndex

REPORT = "n_words long, n_hit long, item_ids array<string>, spans array<struct<start:long,end:long>>"
_BLOCK_BYTES = 8 << 20
#: Windows looked up at a time.
_WINDOWS = 200_000


@dataclass
class Phrases:
    """Windows of one length: the words of the items one after the other, as vocabulary ids from 1, and where windows and items begin."""

    length: int
    vocabulary: np.ndarray
    words: np.ndarray
    starts: np.ndarray
    item_at: np.ndarray
    names: list[str]

    def owners(self, windows: np.ndarray) -> list[str]:
        return [self.names[k] for k in np.unique(np.searchsorted(self.item_at, self.starts[windows], side="right") - 1).tolist()]

    def within(self, vocabulary_used: np.ndarray) -> np.ndarray:
        """The windows all of whose words are used."""
        upto = np.concatenate([[0], np.cumsum(vocabulary_used[self.words])])
        return np.flatnonzero(upto[self.starts + self.length] - upto[self.starts] == self.length)


def phrase_sets(items: list[tuple[str, str]], window: int) -> list[Phrases]:
    """The windows of some items, a set for each length: ``window``, and the lengths of shorter items. Flat arrays of a few bytes a word."""
    by_length: dict[int, tuple[list[np.ndarray], list[str]]] = {}
    for name, text in items:
        buffer = np.frombuffer(text.encode(), dtype=np.uint8)
        keys = textbytes.keys(buffer, *textbytes.words(buffer, textbytes.ALNUM))
        if n := min(window, len(keys)):
            rows, names = by_length.setdefault(n, ([], []))
            rows.append(keys)
            names.append(name)
    out = []
    for n, (rows, names) in by_length.items():
        vocabulary, ids = np.unique(np.concatenate(rows), return_inverse=True)
        sizes = np.array([len(r) for r in rows])
        item_at = np.cumsum(sizes) - sizes
        room = sizes - n + 1
        starts = np.arange(int(room.sum())) - np.repeat(np.cumsum(room) - room, room) + np.repeat(item_at, room)
        out.append(Phrases(n, vocabulary, (ids + 1).astype(np.int32), starts, item_at, names))
    return out


def _runs(known: np.ndarray, row: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the longest runs of at least ``least`` known words within a row."""
    edge = np.flatnonzero(np.concatenate([[True], (known[1:] != known[:-1]) | (row[1:] != row[:-1]), [True]]))
    start, length = edge[:-1], np.diff(edge)
    keep = known[start] & (length >= least)
    return start[keep], length[keep]


class Shard:
    """Words of some documents, held until there are enough of them for an index."""

    def __init__(self) -> None:
        self.batches: list[pa.RecordBatch] = []
        self.keys: list[np.ndarray] = []
        self.bytes_at: list[tuple[np.ndarray, np.ndarray]] = []
        self.rows: list[np.ndarray] = []
        self.row_start: list[np.ndarray] = []
        self.n_words = self.n_rows = 0

    def add(self, batch: pa.RecordBatch) -> None:
        buffer, row_at = textbytes.joined(batch.column("text"))
        starts, ends = textbytes.words(buffer, textbytes.ALNUM)
        row = np.searchsorted(row_at, starts, side="right") - 1
        self.keys.append(textbytes.keys(buffer, starts, ends))
        self.bytes_at.append(((starts - row_at[row]).astype(np.int32), (ends - row_at[row]).astype(np.int32)))
        self.rows.append(row + self.n_rows)
        self.batches.append(batch)
        self.n_words += len(starts)
        self.n_rows += batch.num_rows

    def search(self, sets: Iterator[Phrases]) -> tuple[np.ndarray, np.ndarray, dict[int, set[str]]]:
        """Words of each row, whether each word is hit, and the items found in each row."""
        keys, row = np.concatenate(self.keys), np.concatenate(self.rows)
        cover = np.zeros(len(keys) + 1, dtype=np.int64)
        found: dict[int, set[str]] = {}
        for phrases in sets:
            at = np.searchsorted(phrases.vocabulary, keys)
            at[at == len(phrases.vocabulary)] = 0
            known = phrases.vocabulary[at] == keys
            n = phrases.length
            # a phrase can only lie within a run of words that occur in phrases
            start, length = _runs(known, row, n)
            if not len(start):
                continue
            text = np.zeros(int(length.sum()) + len(length) + 1, dtype=np.int64)
            shift = np.arange(1, len(length) + 1)
            first = np.cumsum(length) - length
            within = np.arange(int(length.sum())) - np.repeat(first, length)
            source = within + np.repeat(start, length)
            target = within + np.repeat(first + shift, length)
            text[target] = at[source] + 1
            word_of = np.full(len(text), -1, dtype=np.int64)
            word_of[target] = source
            used = np.zeros(len(phrases.vocabulary) + 1, dtype=bool)
            used[text] = True
            used[0] = False
            index, possible = FMIndex(text, len(phrases.vocabulary) + 1), phrases.within(used)
            for begin in range(0, len(possible), _WINDOWS):
                part = possible[begin : begin + _WINDOWS]
                windows, same = np.unique(phrases.words[phrases.starts[part][:, None] + np.arange(n)], axis=0, return_inverse=True)
                low, high = index.search(windows)
                counts = high - low
                which = np.repeat(np.arange(len(counts)), counts)
                rows_at = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low, counts)
                word = word_of[index.locate(rows_at)]
                np.add.at(cover, word, 1)
                np.add.at(cover, word + n, -1)
                if len(word):
                    by_window = np.argsort(same.reshape(-1), kind="stable")
                    first = np.searchsorted(same.reshape(-1)[by_window], np.arange(len(windows) + 1))
                    for r, w in np.unique(np.stack([row[word], which], axis=1), axis=0).tolist():
                        found.setdefault(r, set()).update(phrases.owners(part[by_window[first[w] : first[w + 1]]]))
        return np.bincount(row, minlength=self.n_rows), np.cumsum(cover)[:-1] > 0, found

    def reports(self, sets: Iterator[Phrases]) -> Iterator[tuple[pa.RecordBatch, list[int], list[int], list[list[str]], list[list[tuple[int, int]]], list[list[tuple[int, int]]]]]:
        """Each batch with, for each row: words, hit words, items, removal spans in code points and in bytes."""
        if not self.batches:
            return
        n_words, hit, found = self.search(sets)
        row = np.concatenate(self.rows)
        start, end = (np.concatenate([x[k] for x in self.bytes_at]) for k in (0, 1))
        n_hit = np.bincount(row[hit], minlength=self.n_rows)
        where = np.flatnonzero(hit)
        spans: dict[int, list[tuple[int, int]]] = {}
        if len(where):
            gap = np.concatenate([[True], (where[1:] != where[:-1] + 1) | (row[where[1:]] != row[where[:-1]])])
            first, last = where[gap], where[np.concatenate([np.flatnonzero(gap)[1:] - 1, [len(where) - 1]])]
            for r, a, b in zip(row[first].tolist(), start[first].tolist(), end[last].tolist()):
                spans.setdefault(r, []).append((a, b))
        base = 0
        for batch in self.batches:
            texts, points, bytes_ = batch.column("text"), [], []
            for i in range(batch.num_rows):
                own = spans.get(base + i, [])
                bytes_.append(own)
                if own:
                    raw = np.frombuffer(texts[i].as_py().encode(), dtype=np.uint8)
                    upto = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                    own = [(int(upto[a]), int(upto[b])) for a, b in own]
                points.append(own)
            upto = base + batch.num_rows
            yield batch, n_words[base:upto].tolist(), n_hit[base:upto].tolist(), [sorted(found.get(r, ())) for r in range(base, upto)], points, bytes_
            base = upto


def _shards(batches: Iterator[pa.RecordBatch], blocks: list, shard_words: int) -> Iterator:
    def sets():
        for block in blocks:
            yield from block.value

    worker.clear()
    shard = Shard()
    for whole in batches:
        for batch in textbytes.slices(whole, "text"):
            shard.add(batch)
            if shard.n_words >= shard_words:
                yield from shard.reports(sets())
                shard = Shard()
    yield from shard.reports(sets())


def _blocks(benchmark: DataFrame, window: int) -> list:
    """The benchmark as broadcast blocks of about 8 MB of text each, some 12 bytes a word. The driver holds the text of one block at a time; workers keep all blocks, about three times the benchmark's bytes."""
    spark = benchmark.sparkSession
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 32), F.lit(0))).first()[0]
    n = size // _BLOCK_BYTES + 1
    out = []
    for k in range(n):
        block = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        out.append(spark.sparkContext.broadcast(phrase_sets([tuple(r) for r in block.collect()], window)))
    return out


def scan(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, shard_words: int = 2_000_000) -> DataFrame:
    """What of ``benchmark(item_id, text)`` occurs in ``docs(doc_id, text)``.

    Returns for each row ``doc_id, n_words, n_hit, item_ids, spans``: its words, those inside an
    occurrence of ``window`` consecutive benchmark words (a shorter item counts whole), the sorted
    ids of the items that occur, and merged removal spans in code points.

    Documents are searched where they are read: the words of a shard (about ``shard_words`` words)
    that could belong to a phrase are indexed and all phrases are looked up by backward search.

    A null or empty text has no words; an item with a null id or without words is never found; a
    repeated document is reported once for each row, a repeated item once. Empty tables give no
    rows or no hits. Other columns are ignored.
    """
    blocks = _blocks(benchmark, window)

    def run(batches):
        for batch, n_words, n_hit, items, points, _ in _shards(batches, blocks, shard_words):
            spans = pa.array([[{"start": a, "end": b} for a, b in x] for x in points], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), spans], ["doc_id", "n_words", "n_hit", "item_ids", "spans"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(run, f"doc_id long, {REPORT}")


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, shard_words: int = 2_000_000) -> DataFrame:
    """``docs`` with every removal span cut out of ``text``, as one space, and ``n_chars`` (if present) counted again.

    A document of which no word is left goes; every other row and column stays as it is. Nulls,
    empty texts, repeats and empty tables: as for :func:`scan`; rows without hits are never changed.
    """
    blocks = _blocks(benchmark, window)
    names = docs.columns

    def run(batches):
        for batch, n_words, n_hit, _, _, cuts in _shards(batches, blocks, shard_words):
            if any(cuts):
                texts, keep = batch.column("text").to_pylist(), np.array([not h or h < n for n, h in zip(n_words, n_hit)])
                for i, own in enumerate(cuts):
                    if own:
                        raw, at, parts = texts[i].encode(), 0, []
                        for a, b in own:
                            parts.append(raw[at:a].rstrip(b" "))
                            at = b
                        parts.append(raw[at:])
                        texts[i] = b" ".join(parts).decode().strip(" ")
                columns = {n: batch.column(n) for n in names}
                columns["text"] = pa.array(texts, batch.column("text").type)
                if "n_chars" in columns:
                    counted = [len(t) if own else c for t, own, c in zip(texts, cuts, columns["n_chars"].to_pylist())]
                    columns["n_chars"] = pa.array(counted, columns["n_chars"].type)
                batch = pa.RecordBatch.from_arrays(list(columns.values()), names).filter(pa.array(keep))
            yield batch

    return docs.withColumn("text", F.col("text").cast(T.StringType())).mapInArrow(run, docs.withColumn("text", F.col("text").cast("string")).schema)


def digest(report: DataFrame) -> DataFrame:
    """The columns of the benchmark report, with a digest of the item ids."""
    return report.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


__all__ = ["decontaminate", "digest", "phrase_sets", "scan"]
