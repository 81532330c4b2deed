"""Cost-balanced packing of tokenised documents into fixed-length sequences."""

from __future__ import annotations

import heapq
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from octolith.llm import textbytes, worker

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_cost double"
#: Letters below U+0250 only: there lower-casing first gives the tokenizer's own result.
_LATIN_LIMIT = "ɐ"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Token ids of white-space-delimited chunks, remembered by 64-bit chunk key in flat arrays.

    The tokenizer drops white space and never merges across it, so a text's ids are those of its
    chunks in order. Chunks are cut at ASCII white space only; whatever else a chunk holds is left
    to the tokenizer. Keys disregard the case of A-Z as the tokenizer does, except in chunks with
    ``<|``: the tokenizer's special tokens begin so, and it looks for them before it lowers anything.
    ``most`` bounds the remembered chunks; beyond it all are forgotten and
    learned again, which changes time and never ids. ``most_stems`` does the same for the pieces
    that chunks are made of, which are kept as Python objects and so weigh more.
    """

    def __init__(self, path: str, most: int = 1_000_000, most_stems: int = 100_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.encode = Tokenizer.from_file(path).encode_batch_fast
        self.most, self.most_stems = most, most_stems
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.first = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)
        self.stems: dict[str, list[int]] = {}

    def _stem_ids(self, stems: list[str]) -> None:
        new = [s for s in dict.fromkeys(stems) if s not in self.stems]
        if len(self.stems) + len(new) > self.most_stems:
            self.stems = {s: self.stems[s] for s in stems if s in self.stems}
        for s, e in zip(new, self.encode(new, add_special_tokens=False)):
            self.stems[s] = e.ids

    def _learn(self, chunks: list[str], keys: np.ndarray) -> None:
        # a letter followed by one last full stop or comma is always a border between two pieces
        parts = []
        for c in chunks:
            if max(c) < _LATIN_LIMIT and "<|" not in c:
                c = c.lower()
            if len(c) > 1 and c[-1] in ".," and c[-2].isalpha():
                parts.append((c[:-1], c[-1]))
            else:
                parts.append((c,))
        self._stem_ids([p for x in parts for p in x])
        got = [self.stems[x[0]] + self.stems[x[1]] if len(x) == 2 else self.stems[x[0]] for x in parts]
        count = np.fromiter(map(len, got), np.int32, len(got))
        flat = np.fromiter((i for x in got for i in x), np.uint32, int(count.sum()))
        if len(self.keys) + len(keys) > self.most:
            stems = self.stems
            self.forget()
            self.stems = stems
        first = np.cumsum(count, dtype=np.int64) - count + len(self.ids)
        all_keys = np.concatenate([self.keys, keys])
        order = np.argsort(all_keys)
        self.keys = all_keys[order]
        self.first = np.concatenate([self.first, first])[order]
        self.count = np.concatenate([self.count, count])[order]
        self.ids = np.concatenate([self.ids, flat])

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return at, (self.keys[at] == keys) if len(self.keys) else np.zeros(len(keys), bool)

    @staticmethod
    def _keys(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        keys = textbytes.keys(buffer, starts, ends)
        special = np.flatnonzero((buffer[:-1] == ord("<")) & (buffer[1:] == ord("|")))
        if len(special):
            own = np.unique(np.searchsorted(starts, special, side="right") - 1)
            raw = buffer.tobytes()
            keys[own] = np.array([xxhash.xxh64_intdigest(raw[a:b], 1) for a, b in zip(starts[own].tolist(), ends[own].tolist())], np.uint64)
        return keys

    def batch(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after the other, and the number of each text."""
        buffer, row_at = textbytes.joined(column)
        starts, ends = textbytes.words(buffer, textbytes.SPACED)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(row_at) - 1, np.int64)
        keys = self._keys(buffer, starts, ends)
        order = np.argsort(keys)
        sorted_keys = keys[order]
        new = np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])
        unique, sample = sorted_keys[new], order[new]
        rank = np.empty(len(keys), np.int64)
        rank[order] = np.cumsum(new) - 1
        at, known = self._find(unique)
        if not known.all():
            raw = buffer.tobytes()
            missing = np.flatnonzero(~known)
            if len(self.keys) + len(missing) > self.most:
                missing = np.arange(len(unique))
            s, e = starts[sample[missing]].tolist(), ends[sample[missing]].tolist()
            self._learn([raw[a:b].decode() for a, b in zip(s, e)], unique[missing])
            at, known = self._find(unique)
        counts = self.count[at[rank]].astype(np.int64)
        total = np.cumsum(counts)
        into = np.arange(total[-1]) - np.repeat(total - counts, counts) + np.repeat(self.first[at[rank]], counts)
        upto = np.concatenate([[0], total])[np.searchsorted(starts, row_at)]
        return self.ids[into], np.diff(upto)


def word_ids(path: str) -> WordIds:
    return worker.keep(("packing", path), lambda: WordIds(path))


def assign(lengths: list[int], capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece; lengths are at least 1.

    Whole multiples of the capacity are cut from long documents first. What is left goes in
    descending order to the sequence of lowest estimated cost (``linear * n + quadratic * n * n``
    summed over its pieces) that has room; a piece that is larger than the room is cut there. Every
    full sequence is filled to the last token, and the rest fills sequences of power-of-two length,
    which need no padding.
    """
    out, rest, sequence = [], [], 0
    for d, n in enumerate(lengths):
        whole = n // capacity
        for k in range(whole):
            out.append((d, k * capacity, capacity, sequence, 0))
            sequence += 1
        if n % capacity:
            rest.append((n - whole * capacity, d, whole * capacity))
    rest.sort(key=lambda x: (-x[0], x[1]))
    total = sum(x[0] for x in rest)
    full, tail = divmod(total, capacity)
    heap = [(0.0, sequence + k) for k in range(full)]
    room = {sequence + k: capacity for k in range(full)}
    sequence += full
    ends = []
    for bit in reversed(range(capacity.bit_length())):
        if tail >> bit & 1:
            ends.append(sequence)
            room[sequence] = 1 << bit
            sequence += 1
    size = dict(room)
    ends.reverse()
    for n, d, start in rest:
        while n:
            cost, s = heapq.heappop(heap) if heap else (0.0, ends[-1])
            take = min(n, room[s])
            out.append((d, start, take, s, size[s] - room[s]))
            room[s] -= take
            start += take
            n -= take
            if s < sequence - len(size) + full:
                if room[s]:
                    heapq.heappush(heap, (cost + linear * take + quadratic * take * take, s))
            elif not room[s]:
                ends.pop()
    return out


def _pack_partition(batches: Iterator[pa.RecordBatch], path: str, end_id: int, capacity: int, linear: float, quadratic: float, window: int, ids_too: bool) -> Iterator[pa.RecordBatch]:
    encoder, task = word_ids(path), TaskContext.get()
    base = (task.partitionId() if task else 0) << 33
    held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
    waiting, used = 0, 0

    def flush():
        nonlocal used, waiting
        names = pa.concat_arrays([x[0] for x in held])
        counts = np.concatenate([x[1] for x in held])
        ids = np.concatenate([x[2] for x in held])
        held.clear()
        waiting = 0
        first = np.cumsum(counts) - counts
        pieces = assign(counts.tolist(), capacity, linear, quadratic)
        d, start, length, sequence, offset = (np.array(x, dtype=np.int64) for x in zip(*pieces))
        cost = np.bincount(sequence, weights=linear * length + quadratic * length.astype(float) ** 2)
        view = memoryview(ids.astype("<u4", copy=False)).cast("B")
        at = (first[d] + start).tolist()
        crc = [zlib.crc32(view[4 * a : 4 * (a + n)]) for a, n in zip(at, length.tolist())]
        columns = [names.take(pa.array(d)), start, length, np.array(crc, np.int64), counts[d], base + used + sequence, offset, cost[sequence]]
        used += int(sequence.max()) + 1
        names_out = [x.split()[0] for x in SCHEMA.split(", ")]
        arrays = [x if isinstance(x, pa.Array) else pa.array(x) for x in columns]
        if ids_too:
            arrays.append(pa.array([ids[a : a + n].astype(np.int64) for a, n in zip(at, length.tolist())], pa.list_(pa.int64())))
            names_out.append("ids")
        return pa.RecordBatch.from_arrays(arrays, names_out)

    for whole in batches:
        for batch in textbytes.slices(whole, "text"):
            ids, counts = encoder.batch(batch.column("text"))
            ends = np.cumsum(counts)
            ids = np.insert(ids, ends, end_id)
            held.append((batch.column("doc_id").cast(pa.int64()), counts + 1, ids))
            waiting += len(ids)
            if waiting >= window:
                yield flush()
    if held:
        yield flush()


def pack(docs: DataFrame, tokenizer_path: str | None = None, *, end_id: int = 2, capacity: int = 4096, linear: float = 1.0, quadratic: float = 1 / 4096, window_tokens: int = 1 << 21, with_ids: bool = False) -> DataFrame:
    """Packs ``docs(doc_id, text)`` into sequences of at most ``capacity`` (a power of two) tokens.

    Each input partition is packed where it is read, in windows of about ``window_tokens`` tokens,
    so nothing is shuffled and memory does not grow with the input. Sequence ids are unique over
    the whole result. One row is returned per piece; ``with_ids`` adds the token ids.

    A null or empty text is one end token. A null ``doc_id`` stays null. Repeated rows are packed
    once each. An empty table gives no rows. Other columns are ignored.
    """
    path = tokenizer_path or default_tokenizer()
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")

    def run(batches):
        return _pack_partition(batches, path, end_id, capacity, linear, quadratic, window_tokens, with_ids)

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(run, SCHEMA + (", ids array<long>" if with_ids else ""))
