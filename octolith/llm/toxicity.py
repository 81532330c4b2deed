"""Toxicity: lexicon hits, misspelled ones too, weighed by whether their surroundings quote or abuse."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from octolith.llm import textbytes, worker
from octolith.llm.lexicon import LexiconAutomaton
from octolith.llm.spark import cut

#: Letters and digits, and signs that stand for letters inside a word.
_MARKS = "*@$!"
WORD = textbytes.ALNUM.copy()
WORD[list(_MARKS.encode())] = True

#: Words near a hit that tell of reported speech or of talk about a word.
REPORTING = frozenset("said says wrote called calling quoted quote quotes quoting reported reports term word words slur insult insults insulted tweeted testified alleged sagte schrieb nannte zitierte wort beleidigung dit écrit appelé mot insulte cité dijo escribió llamó palabra insulto citó".split())
#: Words near a hit that address somebody.
ADDRESSING = frozenset("you your you're youre yourself u ur du dich dein deine ihr tu toi vous ton ta te eres usted tú".split())
_OPEN, _CLOSE = "\"“”„«»‘’'`", "\"“”«»‘’'`"

FEATURES = ("any", "weight", "strongest", "kinds", "share", "fuzzy", "addressed", "quoted")
SCHEMA = "doc_id long, score double, predicted int, n_hits long, n_quoted long"


def words(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of UTF-8 text. Signs beyond ASCII are no letters: those of U+00A0-U+00BF (but for the ordinals and the micro sign), U+2000-U+206F and U+3000-U+303F."""
    clean = np.concatenate([buffer, np.zeros(2, np.uint8)])
    a, b, c = clean[:-2], clean[1:-1], clean[2:]
    two = (a == 0xC2) & (b != 0xAA) & (b != 0xB5) & (b != 0xBA)
    three = (a == 0xE2) & ((b == 0x80) | (b == 0x81) & (c < 0xB0)) | (a == 0xE3) & (b == 0x80)
    if two.any() or three.any():
        for mask, n in ((two, 2), (three, 3)):
            at = np.flatnonzero(mask)
            for k in range(n):
                clean[at + k] = 0x20
    return textbytes.words(clean[: len(buffer)], WORD)


def allowed_edits(length: int) -> int:
    """Edits that a term of so many letters may be off: none below 4, one up to 8, two beyond."""
    return 0 if length < 4 else 1 if length <= 8 else 2


@dataclass
class Lexicon:
    """Terms with their log-odds to stand in a toxic document, as written and misspelled."""

    terms: list[str]
    exact: list[float]
    fuzzy: list[float] = field(default_factory=list)


class Matcher:
    """Looks words up in the lexicon, once for each different word of a worker."""

    def __init__(self, lexicon: Lexicon, most: int = 1_000_000):
        self.lexicon, self.most = lexicon, most
        self.automaton = LexiconAutomaton(lexicon.terms, allowed_edits)
        self.keys = np.zeros(0, np.uint64)
        self.value = np.zeros(0, np.int32)

    def look_up(self, word: str) -> int:
        """edits * terms + term, or -1."""
        found = self.automaton.closest(word.strip(_MARKS))
        return -1 if found is None else found[0] * len(self.lexicon.terms) + found[1]

    def batch(self, buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the hits among the words, and their values."""
        keys = textbytes.keys(buffer, starts, ends)
        order = np.argsort(keys)
        ranked = keys[order]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if len(keys) else np.zeros(0, bool)
        unique, sample = ranked[new], order[new]
        at = np.searchsorted(self.keys, unique)
        at[at == len(self.keys)] = 0
        known = self.keys[at] == unique if len(self.keys) else np.zeros(len(unique), bool)
        missing = np.flatnonzero(~known)
        if len(missing):
            raw = buffer.tobytes()
            values = np.fromiter((self.look_up(raw[a:b].decode().lower()) for a, b in zip(starts[sample[missing]].tolist(), ends[sample[missing]].tolist())), np.int32, len(missing))
            found = np.empty(len(unique), np.int32)
            found[known] = self.value[at[known]]
            found[missing] = values
            if len(self.keys) + len(missing) > self.most:
                self.keys, self.value = unique, found
            else:
                every = np.concatenate([self.keys, unique[missing]])
                into = np.argsort(every)
                self.keys, self.value = every[into], np.concatenate([self.value, values])[into]
        else:
            found = self.value[at]
        value = np.empty(len(keys), np.int32)
        value[order] = np.repeat(found, np.diff(np.concatenate([np.flatnonzero(new), [len(keys)]])))
        hits = np.flatnonzero(value >= 0)
        return hits, value[hits]


def matcher(lexicon: Lexicon) -> Matcher:
    """The worker's matcher of these terms; what it has worked out serves all its tasks."""
    return worker.keep(("toxicity", xxhash.xxh64_intdigest("\n".join(lexicon.terms))), lambda: Matcher(lexicon))


def context(before: str, after: str) -> tuple[float, bool]:
    """A factor for a hit between these texts, and whether somebody is addressed.

    Reported speech lowers the factor: a word of reporting close by, or quotation marks around the
    hit. An address raises it back.
    """
    near_before = re.findall(r"[^\W_]+(?:'[^\W_]+)?", before.lower())[-8:]
    near_after = re.findall(r"[^\W_]+(?:'[^\W_]+)?", after.lower())[:6]
    factor = 1.0
    tail, head = before.rstrip(" .,"), after.lstrip(" .,!?")
    tight = bool(tail) and bool(head) and tail[-1] in _OPEN and head[0] in _CLOSE
    opened = any(before.count(a) > before.count(b) if a != b else before.count(a) % 2 for a, b in (('"', '"'), ("“", "”"), ("«", "»"), ("„", "“")))
    closed = any(c in after for c in '"”»“')
    if tight:
        factor *= 0.25
    elif opened and closed:
        factor *= 0.5
    if REPORTING & {*near_before, *near_after}:
        factor *= 0.5 if factor == 1.0 else 0.3
    addressed = bool(ADDRESSING & {*near_before, *near_after})
    if addressed and factor > 0.3:
        factor = max(factor, 0.8)
    return factor, addressed


def features(lexicon: Lexicon, n_words: int, hits: list[tuple[int, float, bool]]) -> list[float]:
    """Numbers for a document from its hits: value of the matcher, context factor, address."""
    n = len(lexicon.terms)
    total = strongest = fuzzy = addressed = quoted = 0.0
    kinds = set()
    for value, factor, talk in hits:
        edits, term = divmod(value, n)
        weight = lexicon.fuzzy[term] * 0.8 ** (edits - 1) if edits else lexicon.exact[term]
        if weight <= 0:
            continue
        if factor < 0.35:
            quoted += 1
            continue
        kinds.add(term)
        total += weight * factor
        strongest = max(strongest, weight * factor)
        fuzzy += bool(edits)
        addressed += talk
    return [float(bool(kinds)), min(total, 20.0) / 5, strongest / 5, min(len(kinds), 8) / 4, min(1.0, 20 * len(kinds) / max(n_words, 20)), min(fuzzy, 4.0) / 4, min(addressed, 4.0) / 4, min(quoted, 4.0) / 4]


def _scan(batch: pa.RecordBatch, matcher: Matcher, reach: int = 80) -> Iterator[tuple[int, list[tuple[int, float, bool]]]]:
    """For each row: its number of words, and its hits with their context."""
    buffer, row_at = textbytes.joined(batch.column("text"))
    starts, ends = words(buffer)
    first = np.searchsorted(starts, row_at)
    hits, values = matcher.batch(buffer, starts, ends)
    by_row = np.searchsorted(hits, first)
    raw = buffer.tobytes()
    for r in range(batch.num_rows):
        own = []
        for k in range(by_row[r], by_row[r + 1]):
            a, b = int(starts[hits[k]]), int(ends[hits[k]])
            before = raw[max(int(row_at[r]), a - reach) : a].decode(errors="ignore")
            after = raw[b : min(int(row_at[r + 1]), b + reach)].decode(errors="ignore")
            own.append((int(values[k]), *context(before, after)))
        yield int(first[r + 1] - first[r]), own


@dataclass
class Model:
    lexicon: Lexicon
    coef: np.ndarray
    offset: float

    def score(self, rows: list[list[float]]) -> np.ndarray:
        return 1 / (1 + np.exp(-(np.asarray(rows) @ self.coef + self.offset)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Ridge-penalised logistic regression by Newton's method."""
    one = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(one.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(one @ w, -30, 30)))
        g = one.T @ (p - y) + penalty * w
        h = (one * (p * (1 - p))[:, None]).T @ one + np.diag(penalty)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Different words of each document, counted by label before anything is shuffled."""
    counts: dict[int, Counter] = {0: Counter(), 1: Counter()}

    def flush():
        words = list(counts[0].keys() | counts[1].keys())
        out = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *[pa.array([counts[y][w] for w in words], pa.int64()) for y in (0, 1)]], ["word", "clean", "toxic"])
        counts[0].clear()
        counts[1].clear()
        return out

    for batch in batches:
        for t, y in zip(batch.column("text"), batch.column("toxic").to_pylist()):
            raw = np.frombuffer(t.as_py().encode(), dtype=np.uint8)
            starts, ends = words(raw)
            text = raw.tobytes()
            counts[y].update({text[a:b].decode().lower().strip(_MARKS) for a, b in zip(starts.tolist(), ends.tolist())} - {""})
        if sum(map(len, counts.values())) > 500_000:
            yield flush()
    yield flush()


def train(docs: DataFrame, labels: DataFrame, *, held_out_of: int = 5, most_labelled: int = 20_000, most_terms: int = 1000, least_docs: int = 3, least_odds: float = 2.0, least_evidence: float = 20.0) -> Model:
    """Learns from rows of ``labels(doc_id, toxic)`` whose crc32 of the id is not 0 modulo ``held_out_of``.

    About ``most_labelled`` labelled documents are used, chosen by a hash of their ids; that bounds
    what the driver fits. A term enters the lexicon if at least ``least_docs`` toxic documents have
    it, its log-odds against clean ones reach ``least_odds``, and both multiplied reach
    ``least_evidence``, so that few terms enter by chance however many words there are. How far its misspellings are
    trusted is learned in the same way from words that are some edits off. Labels other than 0 and
    1, null ids and ids with several labels that differ are left out.
    """
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min("toxic").cast("int").alias("toxic"), F.max("toxic").cast("int").alias("most"))
    known = known.where("toxic = most").where(F.crc32(F.col("id").cast("string")) % held_out_of != 0).select("id", "toxic")
    total = known.count()
    if total > most_labelled:
        known = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int((1 << 20) * most_labelled / total))
    # at most about most_labelled rows of 16 bytes
    sample = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(known), "id")


    sample = cut(sample)
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    words = sample.select("text", "toxic").mapInArrow(_count_words, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    odds = F.log((F.col("toxic") + 0.5) / (n1 + 1.0)) - F.log((F.col("clean") + 0.5) / (n0 + 1.0))
    rows = words.where(f"toxic >= {least_docs} and length(word) >= 3").withColumn("odds", odds).where(F.col("odds") >= least_odds).where(F.col("odds") * F.col("toxic") >= least_evidence).orderBy(F.desc(F.col("odds") * F.sqrt("toxic")), "word").limit(most_terms).collect()
    rows = sorted(rows, key=lambda r: r["word"])
    lexicon = Lexicon([r["word"] for r in rows], [float(r["odds"]) for r in rows], [1.0] * len(rows))

    def hits(batches):
        look = matcher(lexicon)
        for whole in batches:
            for batch in textbytes.slices(whole, "text"):
                got = list(_scan(batch, look))
                yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([x[0] for x in got], pa.int64()), pa.array([[v for v, _, _ in x[1]] for x in got], pa.list_(pa.int64())), pa.array([[f for _, f, _ in x[1]] for x in got], pa.list_(pa.float64())), pa.array([[t for _, _, t in x[1]] for x in got], pa.list_(pa.bool_()))], ["toxic", "n_words", "value", "factor", "talk"])

    scanned = [(r["toxic"], r["n_words"], list(zip(r["value"], r["factor"], r["talk"]))) for r in sample.select("text", "toxic").mapInArrow(hits, "toxic int, n_words long, value array<long>, factor array<double>, talk array<boolean>").where("size(value) > 0").collect()]
    terms = len(lexicon.terms)
    off = {0: Counter(), 1: Counter()}
    for y, _, found in scanned:
        if all(v >= terms for v, _, _ in found):
            off[y].update({v % terms for v, _, _ in found})
    ratio = (n0 + 1) / (n1 + 1)
    lexicon.fuzzy = [float(w) if (w := min(lexicon.exact[t], np.log((off[1][t] + 0.5) / (off[0][t] + 0.5) * ratio))) >= 1.5 else 0.0 for t in range(terms)]
    with_hits = [features(lexicon, n, found) for _, n, found in scanned]
    bare = [(n1 - sum(y for y, _, _ in scanned), 1), (n0 - sum(1 - y for y, _, _ in scanned), 0)]
    x = np.array(with_hits + [[0.0] * len(FEATURES)] * sum(c for c, _ in bare)).reshape(-1, len(FEATURES))
    y = np.array([y for y, _, _ in scanned] + [v for c, v in bare for _ in range(c)], dtype=float)
    coef, offset = fit_logistic(x, y) if len(y) else (np.zeros(len(FEATURES)), -3.0)
    return Model(lexicon, coef, offset)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, predicted, n_hits, n_quoted`` for each row of ``docs(doc_id, text)``; only the text matters.

    A null or empty text has no hits and gets the score of such texts. Repeated rows are scored
    again, an empty table gives no rows, other columns are ignored.
    """

    def run(batches):
        look = matcher(model.lexicon)
        for whole in batches:
            for batch in textbytes.slices(whole, "text"):
                got = list(_scan(batch, look))
                p = model.score([features(model.lexicon, n, found) for n, found in got])
                quoted = [sum(f < 0.35 for _, f, _ in found) for _, found in got]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array([len(x[1]) for x in got], pa.int64()), pa.array(quoted, pa.int64())], ["doc_id", "score", "predicted", "n_hits", "n_quoted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def reject(docs: DataFrame, model: Model, *, least: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose text scores at least ``least``; all columns stay as they are. Rows with null or empty text stay."""

    def run(batches):
        look = matcher(model.lexicon)
        for whole in batches:
            for batch in textbytes.slices(whole, "text"):
                p = model.score([features(model.lexicon, n, found) for n, found in _scan(batch, look)])
                empty = np.array([not t.as_py() for t in batch.column("text")])
                yield batch.filter(pa.array((p < least) | empty))

    typed = docs.withColumn("text", F.col("text").cast("string"))
    return typed.mapInArrow(run, typed.schema)


def digest(scored: DataFrame, held_out_of: int = 5) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string")) % held_out_of == 0
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted", "n_hits", "n_quoted")
