"""Katz backoff language model: Good-Turing discounted bigram counts over the whole corpus, looked up where they are kept.

The tables of counts never meet in one place. Documents are dealt to shards; each shard sends its
different words (then word pairs) with their training counts to the bucket that keeps them, in one
packed message for each bucket. A bucket sums what it gets and answers each message in its order,
so a shard can score its own documents. All messages are flat arrays, reduced to one entry for each
different word or pair of a shard before anything moves.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from octolith.llm import textbytes
from octolith.llm.spark import partitions

CUTOFF = 5  # counts above are not discounted
_END = np.uint64(0x5DEECE66D1CE4E5B)
_START_ID = 0
_HOT_SHARE = 400  # a word is dealt over many buckets if it is over one in so many tokens
_SALTS = 256
_SHARD_BYTES = 32 << 20
_MESSAGE = "shard int, bucket int, kind int, body binary"
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def pack(values: np.ndarray) -> bytes:
    """Non-negative integers as byte planes, low bytes first; planes that are all zero are left out."""
    values = np.ascontiguousarray(values, dtype="<u8")
    planes = (int(values.max(initial=0)).bit_length() + 7) // 8
    body = values.view(np.uint8).reshape(-1, 8)[:, :planes].T.tobytes()
    return len(values).to_bytes(5, "little") + bytes([planes]) + body


def unpack(body: memoryview) -> tuple[np.ndarray, memoryview]:
    n, planes = int.from_bytes(body[:5], "little"), body[5]
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :planes] = np.frombuffer(body[6 : 6 + n * planes], dtype=np.uint8).reshape(planes, n).T
    return out.reshape(-1).view("<u8").astype(np.int64), body[6 + n * planes :]


def unpack_all(body: bytes) -> list[np.ndarray]:
    rest, out = memoryview(body), []
    while len(rest):
        values, rest = unpack(rest)
        out.append(values)
    return out


def histogram(counts: np.ndarray) -> np.ndarray:
    """How many entries have a count of 1, 2, ... CUTOFF + 1; then all entries above 0, and their sum."""
    seen = counts[counts > 0]
    n = np.bincount(np.minimum(seen, CUTOFF + 2), minlength=CUTOFF + 3)
    return np.array([*n[1 : CUTOFF + 2], len(seen), seen.sum()], dtype=np.int64)


def discounts(n: np.ndarray) -> np.ndarray:
    """Factors for counts 0 .. CUTOFF from counts of counts: Good-Turing, renormalised for the cutoff.

    A factor that is no proper fraction, as small samples give, is replaced by absolute discounting.
    """
    d = np.ones(CUTOFF + 1)
    d[0] = 0
    cut = (n[0] + 2 * n[1]) and n[0] / (n[0] + 2 * n[1])
    absolute = cut if 0 < cut < 1 else 0.5
    far = (CUTOFF + 1) * n[CUTOFF] / n[0] if n[0] else 1.0
    for r in range(1, CUTOFF + 1):
        turing = ((r + 1) * n[r] / (r * n[r - 1]) - far) / (1 - far) if n[r - 1] and far < 1 else -1.0
        d[r] = turing if 0 < turing < 1 else (r - absolute) / r
    return d


@dataclass
class Unigrams:
    """Discounted word probabilities; what is left is the probability of an unknown word."""

    factor: np.ndarray
    total: int
    kinds: int
    scale: float
    unknown: float

    @classmethod
    def of(cls, hist: np.ndarray) -> Unigrams:
        d, total = discounts(hist), int(hist[-1])
        if not total:
            return cls(d, 0, 0, 1.0, 1.0)
        kept = 1 - sum((1 - d[r]) * r * hist[r - 1] for r in range(1, CUTOFF + 1)) / total
        left = max(1 - kept, 1 / (total + 1))
        return cls(d, total, int(hist[-2]), (1 - left) / kept if kept > 0 else 1.0, left)

    def probability(self, count: np.ndarray) -> np.ndarray:
        low = self.factor[np.minimum(count, CUTOFF)] * count
        value = np.where(count > CUTOFF, count, low) * (self.scale / max(self.total, 1))
        return np.where(count > 0, value, self.unknown)

    def sum_over(self, counts: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Probability of sets of known words, from the sum of their counts and how many of them have count 1 .. CUTOFF."""
        r = np.arange(1, CUTOFF + 1)
        return (counts - low @ ((1 - self.factor[1:]) * r)) * (self.scale / max(self.total, 1))


class Shard:
    """The different words and word pairs of some documents."""

    def __init__(self, table: pa.Table, train_of: int, held: int):
        table = table.combine_chunks()
        self.names = table.column("doc_id").to_pylist()
        texts = table.column("text").combine_chunks()
        self.held = np.array([n is not None and zlib.crc32(str(n).encode()) % train_of == held for n in self.names], dtype=bool)
        keys, row = [], []
        done = 0
        for batch in textbytes.slices(pa.RecordBatch.from_arrays([texts], ["text"]), "text"):
            buffer, row_at = textbytes.joined(batch.column("text"))
            starts, ends = textbytes.words(buffer, textbytes.SPACED)
            keys.append(textbytes.keys(buffer, starts, ends))
            row.append(np.searchsorted(row_at, starts, side="right") - 1 + done)
            done += batch.num_rows
        key = np.concatenate([*keys, np.zeros(0, np.uint64)])
        row = np.concatenate([*row, np.zeros(0, np.int64)])
        n = np.bincount(row, minlength=done)
        ends_at = np.cumsum(n)
        self.key = np.insert(key, ends_at, _END)
        self.row = np.insert(row, ends_at, np.arange(done))
        self.n_tokens = n + 1
        self.first = np.cumsum(self.n_tokens) - self.n_tokens
        order = np.argsort(self.key)
        ranked = self.key[order]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        self.words = ranked[new]
        self.word = np.empty(len(ranked), dtype=np.int64)
        self.word[order] = np.cumsum(new) - 1
        self.train = ~self.held[self.row]
        self.word_count = np.bincount(self.word[self.train], minlength=len(self.words))

    def word_parts(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Words in the order of the buckets that keep them, and where each bucket begins."""
        bucket = (self.words >> np.uint64(20)) % np.uint64(n)
        order = np.argsort(bucket, kind="stable")
        return order, np.searchsorted(bucket[order], np.arange(n + 1))

    def pairs(self, n: int, counts: np.ndarray, total: int) -> None:
        """Pairs of a word with the one before it (at the start of a text: a sign of its own), in the order of their buckets.

        Pairs of one history share a bucket, so it can sum over them; those of very frequent
        histories are dealt over many by their second word, and each such bucket is asked for its part.
        """
        start = len(self.words)
        history = np.empty(len(self.word), dtype=np.int64)
        history[1:] = self.word[:-1]
        history[self.first] = start
        pair = history << 32 | self.word
        order = np.argsort(pair)
        ranked = pair[order]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        self.pair_of = np.empty(len(pair), dtype=np.int64)
        self.pair_of[order] = np.cumsum(new) - 1
        h, w = ranked[new] >> 32, ranked[new] & 0xFFFFFFFF
        count = np.bincount(self.pair_of[self.train], minlength=len(h))
        salts = min(n, _SALTS)
        own = np.concatenate([self.words, [np.uint64(0x9E3779B97F4A7C15)]])
        home = ((own >> np.uint64(20)) % np.uint64(n)).astype(np.int64)
        hot = np.concatenate([counts * _HOT_SHARE > total, [True]])
        salt = ((own >> np.uint64(7)) % np.uint64(salts)).astype(np.int64)
        bucket = np.where(hot[h], (home[h] + salt[w]) % n, home[h])
        by = np.argsort(bucket, kind="stable")
        self.h, self.w, self.count, self.order = h[by], w[by], count[by], by
        self.pair_at = np.searchsorted(bucket[by], np.arange(n + 1))
        # histories of each bucket, in order; a frequent one is asked for in all its buckets
        used = np.unique(h)
        asked_h = np.concatenate([used[~hot[used]], np.repeat(used[hot[used]], salts)])
        asked_b = np.concatenate([home[used[~hot[used]]], (np.repeat(home[used[hot[used]]], salts) + np.tile(np.arange(salts), int(hot[used].sum()))) % n])
        by = np.lexsort((asked_h, asked_b))
        self.asked = asked_h[by]
        self.asked_at = np.searchsorted(asked_b[by], np.arange(n + 1))


def _bodies(table: pa.Table) -> list[tuple[int, int, int, list[np.ndarray]]]:
    """(shard, bucket, kind, arrays) of messages, in a fixed order."""
    rows = zip(*(table.column(c).to_pylist() for c in ("shard", "bucket", "kind", "body")))
    return [(s, b, k, unpack_all(x)) for s, b, k, x in sorted(rows, key=lambda r: r[:3])]


def _messages(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [(), (), (), ()]
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], ["shard", "bucket", "kind", "body"])


def _count_words(table: pa.Table, n: int, split) -> pa.Table:
    shard = Shard(table, *split)
    order, at = shard.word_parts(n)
    s = table.column("shard")[0].as_py()
    rows = []
    for b in range(n):
        own = order[at[b] : at[b + 1]]
        rows.append((s, b, 0, pack(shard.words[own]) + pack(shard.word_count[own])))
    return _messages(rows)


def _answer_words(table: pa.Table, n: int) -> pa.Table:
    """Total counts and ids (frequent words first) of the words asked for, and the bucket's histogram."""
    asked = _bodies(table)
    words = np.concatenate([x[3][0] for x in asked])
    unique, which = np.unique(words, return_inverse=True)
    total = np.bincount(which, weights=np.concatenate([x[3][1] for x in asked]), minlength=len(unique)).astype(np.int64)
    rank = np.empty(len(unique), dtype=np.int64)
    rank[np.lexsort((unique, -total))] = np.arange(len(unique))
    hist, rows, done = pack(histogram(total)), [], 0
    for s, b, _, (own, _) in asked:
        mine = which[done : done + len(own)]
        done += len(own)
        rows.append((s, b, 0, pack(total[mine]) + pack(rank[mine] * n + b + 1) + hist))
    return _messages(rows)


def _count_pairs(docs: pa.Table, answers: pa.Table, n: int, split) -> pa.Table:
    if not docs.num_rows:
        return _messages([])
    shard = Shard(docs, *split)
    order, at = shard.word_parts(n)
    counts, ids = np.zeros(len(order), np.int64), np.zeros(len(order) + 1, np.int64)
    hist = np.zeros(CUTOFF + 3, np.int64)
    for _, b, _, (total, number, part) in _bodies(answers):
        counts[order[at[b] : at[b + 1]]] = total
        ids[order[at[b] : at[b + 1]]] = number
        hist += part
    ids[-1] = _START_ID
    shard.pairs(n, counts, int(hist[-1]))
    s = docs.column("shard")[0].as_py()
    rows = [(s, s % n, 1, pack(counts) + pack(hist))]
    for b in range(n):
        asked, own = shard.asked[shard.asked_at[b] : shard.asked_at[b + 1]], slice(shard.pair_at[b], shard.pair_at[b + 1])
        run = np.searchsorted(shard.h[own], asked, side="right") - np.searchsorted(shard.h[own], asked)
        w = shard.w[own]
        rows.append((s, b, 2, pack(ids[asked]) + pack(run) + pack(ids[w]) + pack(counts[w]) + pack(shard.count[own])))
    return _messages(rows)


def _answer_pairs(table: pa.Table) -> pa.Table:
    """For each pair asked for its total count; for each history: its total, followers by count, and what S(h) needs."""
    every = _bodies(table)
    rows = [(s, b, k, b"".join(map(pack, arrays))) for s, b, k, arrays in every if k == 1]
    asked = [x for x in every if x[2] == 2]
    if not asked:
        return _messages(rows)
    histories, dense = np.unique(np.concatenate([x[3][0] for x in asked]), return_inverse=True)
    h = np.repeat(dense, np.concatenate([x[3][1] for x in asked]))
    w, c1, count = (np.concatenate([x[3][k] for x in asked]) for k in (2, 3, 4))
    order = np.lexsort((w, h)) if len(histories) >> 22 or int(w.max(initial=0)) >> 40 else np.argsort(h << 40 | w)
    hs, ws = h[order], w[order]
    new = np.concatenate([[True], (hs[1:] != hs[:-1]) | (ws[1:] != ws[:-1])]) if len(hs) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    total = np.add.reduceat(count[order], first) if len(first) else np.zeros(0, np.int64)
    answer = np.empty(len(h), dtype=np.int64)
    answer[order] = np.repeat(total, np.diff(np.concatenate([first, [len(hs)]])))
    hist = pack(histogram(total))
    seen = total > 0
    ph, pt, pc = hs[first][seen], total[seen], c1[order][first][seen]
    stats = np.zeros((len(histories), 2 + 2 * CUTOFF), dtype=np.int64)
    np.add.at(stats[:, 0], ph, pt)
    np.add.at(stats[:, 1], ph, pc)
    for r in range(1, CUTOFF + 1):
        stats[:, 1 + r] = np.bincount(ph[pt == r], minlength=len(histories))
        stats[:, 1 + CUTOFF + r] = np.bincount(ph[pc == r], minlength=len(histories))
    at_h = at_p = 0
    for s, b, _, (own, run, follow, _, _) in asked:
        mine = stats[dense[at_h : at_h + len(own)]]
        rows.append((s, b, 2, pack(answer[at_p : at_p + len(follow)]) + pack(mine.T.reshape(-1)) + hist))
        at_h += len(own)
        at_p += len(follow)
    return _messages(rows)


def _score(docs: pa.Table, answers: pa.Table, n: int, split) -> pa.Table:
    shard = Shard(docs, *split)
    got = _bodies(answers)
    counts, hist = next(arrays for _, _, k, arrays in got if k == 1)
    shard.pairs(n, counts, int(hist[-1]))
    uni = Unigrams.of(hist)
    r = np.zeros(len(shard.h), np.int64)
    stats = np.zeros((len(shard.words) + 1, 2 + 2 * CUTOFF), dtype=np.int64)
    pair_hist = np.zeros(CUTOFF + 3, np.int64)
    for _, b, k, arrays in got:
        if k == 2:
            answer, own, part = arrays
            r[shard.pair_at[b] : shard.pair_at[b + 1]] = answer
            asked = shard.asked[shard.asked_at[b] : shard.asked_at[b + 1]]
            np.add.at(stats, asked, own.reshape(2 + 2 * CUTOFF, len(asked)).T)
            pair_hist += part
    d = discounts(pair_hist)
    total = np.maximum(stats[:, 0], 1)
    k = np.arange(1, CUTOFF + 1)
    kept = 1 - stats[:, 2 : 2 + CUTOFF] @ ((1 - d[1:]) * k) / total
    left = np.maximum(1 - kept, 0.5 / (total + 0.5))
    scale = np.where(kept > 0, (1 - left) / np.where(kept > 0, kept, 1), 1.0)
    backoff = left / np.maximum(1 - uni.sum_over(stats[:, 1], stats[:, 2 + CUTOFF :]), 1e-300)
    known = stats[:, 0] > 0
    p1 = uni.probability(counts)[shard.w]
    low = np.where(r > CUTOFF, r, d[np.minimum(r, CUTOFF)] * r)
    p = np.where(r > 0, low * scale[shard.h] / total[shard.h], np.where(known[shard.h], backoff[shard.h], 1.0) * p1)
    logp = np.empty(len(p))
    logp[shard.order] = np.log10(p)
    c = counts[shard.word]
    base = np.log10((c + 1) / (uni.total + 1 * (uni.kinds + 1)))
    sums = lambda x: np.add.reduceat(x, shard.first)
    columns = [pa.array(shard.names, pa.int64()), pa.array(shard.held), pa.array(shard.n_tokens), pa.array(sums((c > 0).astype(np.int64))), pa.array(np.full(len(shard.names), uni.total)), pa.array(sums(base)), pa.array(sums(logp[shard.pair_of]))]
    return pa.table(columns, [x.split()[0] for x in SCHEMA.split(", ")])


def score(docs: DataFrame, *, train_of: int = 7, held: int = 2, n_parts: int | None = None) -> DataFrame:
    """Scores every row of ``docs(doc_id, text)`` with a model of those whose crc32 of the id is not ``held`` modulo ``train_of``.

    ``score`` is the log10 probability of the text's words and its end under Katz backoff from
    bigrams to words: a seen pair has its Good-Turing discounted share of its history; what the
    history has left goes to other words in proportion to their own discounted probability,
    normalised exactly over all words not seen after it, the unknown word included. A history
    without discounted counts keeps back 0.5 / (its count + 0.5). ``base_score`` is the add-one
    unigram log10 probability; ``n_known`` counts tokens that occur in training.

    A null or empty text is its end alone. A row with a null id is trained on. Repeated rows count
    each time. An empty table gives no rows; other columns are ignored. ``n_parts`` shards and
    buckets bound the memory of a task; by default there are as many as the session has shuffle
    partitions, or as hold 32 MB of text each if that is more. Words are told apart by 64-bit keys:
    two different ones are taken for the same with a chance of about 2**-60.
    """
    split = train_of, held
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if n_parts is None:
        size = chosen.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        n_parts = max(partitions(docs.sparkSession), -(-size // _SHARD_BYTES))
    n = n_parts
    shards = chosen.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("shard"), "doc_id", "text")
    words = shards.groupBy("shard").applyInArrow(lambda t: _count_words(t, n, split), _MESSAGE)
    words = words.groupBy("bucket").applyInArrow(lambda t: _answer_words(t, n), _MESSAGE)
    pairs = shards.groupBy("shard").cogroup(words.groupBy("shard")).applyInArrow(lambda d, a: _count_pairs(d, a, n, split), _MESSAGE)
    pairs = pairs.groupBy("bucket").applyInArrow(_answer_pairs, _MESSAGE)
    return shards.groupBy("shard").cogroup(pairs.groupBy("shard")).applyInArrow(lambda d, a: _score(d, a, n, split), SCHEMA)
