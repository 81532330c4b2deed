"""Main text of web pages: a linear-chain conditional random field over leaf blocks, decoded by Viterbi."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from octolith.llm.blocks import Block, Node, parse
from octolith.llm.pagegen import labelled_pages

SCHEMA = "page_id long, url string, text string, n_chars long, n_blocks long, n_main long"
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CUE = re.compile(r"©|cookie|copyright|all rights reserved|subscribe|newsletter|sign up|log in|advertis|sponsor|privacy|share|follow us|comments?\b|repl(?:y|ies)|read more|related|menu", re.I)


def _own_features(path: Node | None) -> list[str]:
    """Features of a path that its parent's path need not have: the innermost tags by place, an article within another, no names at all."""
    if path is None:
        return ["no-names"]
    out = [f"t0:{path.element.tag}"]
    if path.parent:
        out.append(f"t1:{path.parent.element.tag}")
    if path.articles > 1:
        out.append("nested-article")
    if not path.named:
        out.append("no-names")
    return out


def path_features(path: Node | None) -> list[str]:
    """Tags of all ancestors, the innermost ones by place, and the names (class, id, role) that elements carry."""
    out, node = _own_features(path), path
    while node:
        out += node.new
        node = node.parent
    return sorted(out)


def text_features(block: Block) -> list[str]:
    t = block.text
    n = len(t)
    words = t.count(" ") + 1
    share = block.link_chars / n
    out = ["bias", f"n:{min(9, int(math.log2(n + 1)))}", f"w:{min(8, int(math.log2(words)))}", f"l:{0 if share == 0 else 1 if share < 0.3 else 2 if share < 0.8 else 3}", f"p:{min(4, t.count('.') + t.count(',') + t.count('?') + t.count('!'))}"]
    out.append("end:" + ("." if t[-1] in ".!?…:;\"”»" else "a" if t[-1].isalpha() else "0"))
    if t[0] == "©":
        out.append("starts:©")
    if n < 200:
        out += sorted({f"cue:{c.lower()}" for c in _CUE.findall(t)})
    return out


def pair_kind(a: Block, b: Block) -> int:
    """0: the same parent element; 1: another parent; 2: another parent, and b is a heading."""
    if a.parent == b.parent:
        return 0
    return 2 if b.path and b.path.element.tag in _HEADINGS else 1


class Crf:
    """Two labels (0 other, 1 main). Feature weights, and transition weights for each kind of pair."""

    def __init__(self) -> None:
        self.weight: dict[str, list[float]] = {}
        self.move = np.zeros((3, 2, 2))

    def path_score(self, path: Node | None, known: dict[int, tuple[float, float]]) -> tuple[float, float]:
        """The sum over the features of a path. ``known`` holds, by number, what the marks of the page's elements so far add up to."""
        chain, node = [], path
        while node and node.number not in known:
            chain.append(node)
            node = node.parent
        a, b = known[node.number] if node else (0.0, 0.0)
        for node in reversed(chain):
            own = self._sum(node.new)
            a, b = a + own[0], b + own[1]
            known[node.number] = a, b
        own = self._sum(_own_features(path))
        return a + own[0], b + own[1]

    def _sum(self, names) -> tuple[float, float]:
        a = b = 0.0
        for n in names:
            if w := self.weight.get(n):
                a += w[0]
                b += w[1]
        return a, b

    def decode(self, blocks: list[Block]) -> list[int]:
        """The most likely labels, by Viterbi."""
        if not blocks:
            return []
        moves = self.move.tolist()
        best, back, known = (0.0, 0.0), [], {}
        for k, block in enumerate(blocks):
            p, t = self.path_score(block.path, known), self._sum(text_features(block))
            if k:
                (oo, om), (mo, mm) = moves[pair_kind(blocks[k - 1], block)]
                from_o, from_m = best
                to_o = (from_o + oo, 0) if from_o + oo >= from_m + mo else (from_m + mo, 1)
                to_m = (from_o + om, 0) if from_o + om >= from_m + mm else (from_m + mm, 1)
                back.append((to_o[1], to_m[1]))
                best = (to_o[0], to_m[0])
            best = (best[0] + p[0] + t[0], best[1] + p[1] + t[1])
        label = int(best[1] > best[0])
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]

    def fit(self, pages: list[list[Block]], rounds: int = 6, rate: float = 0.3, ridge: float = 1e-4, seed: int = 3) -> Crf:
        """Maximum likelihood by AdaGrad; marginals by forward-backward in log space."""
        index: dict[str, int] = {}
        data = []
        for blocks in pages:
            if blocks:
                rows = [[index.setdefault(n, len(index)) for n in path_features(b.path) + text_features(b)] for b in blocks]
                kinds = [pair_kind(a, b) for a, b in zip(blocks, blocks[1:])]
                data.append((rows, kinds, [int(b.label == "main") for b in blocks]))
        w, g = np.zeros((len(index), 2)), np.full((len(index), 2), 1e-2)
        gm = np.full((3, 2, 2), 1e-2)
        rng = np.random.default_rng(seed)
        for _ in range(rounds):
            for d in rng.permutation(len(data)).tolist():
                rows, kinds, gold = data[d]
                n = len(rows)
                emit = np.array([w[r].sum(0) for r in rows])
                forward, backward = np.empty((n, 2)), np.zeros((n, 2))
                forward[0] = emit[0]
                for k in range(1, n):
                    x = forward[k - 1][:, None] + self.move[kinds[k - 1]]
                    forward[k] = np.logaddexp(x[0], x[1]) + emit[k]
                for k in range(n - 2, -1, -1):
                    x = self.move[kinds[k]] + (emit[k + 1] + backward[k + 1])[None, :]
                    backward[k] = np.logaddexp(x[:, 0], x[:, 1])
                total = np.logaddexp(*forward[-1])
                node = np.exp(forward + backward - total)
                node[np.arange(n), gold] -= 1
                for r, grad in zip(rows, node):
                    step = grad + ridge * w[r]
                    g[r] += step * step
                    w[r] -= rate * step / np.sqrt(g[r])
                move = np.zeros((3, 2, 2))
                for k, kind in enumerate(kinds):
                    move[kind] += np.exp(forward[k][:, None] + self.move[kind] + (emit[k + 1] + backward[k + 1])[None, :] - total)
                    move[kind, gold[k], gold[k + 1]] -= 1
                gm += move * move
                self.move -= rate * move / np.sqrt(gm)
        self.weight = {n: w[i].tolist() for n, i in index.items()}
        return self

    def __getstate__(self):
        return {"weight": self.weight, "move": self.move}

    def __setstate__(self, state):
        self.__init__()
        self.weight, self.move = state["weight"], state["move"]


_TRAINED: dict[tuple[int, int], Crf] = {}


def train(pages: list[str] | None = None, *, n_pages: int = 500, seed: int = 11) -> Crf:
    """A model of labelled pages (``data-label`` marks, see ``pagegen``), by default ``n_pages`` generated ones. It is fitted on the driver, so the number of pages has to be bounded."""
    if pages is not None:
        return Crf().fit([parse(p) for p in pages])
    if (n_pages, seed) not in _TRAINED:
        _TRAINED[n_pages, seed] = Crf().fit([parse(p) for p in labelled_pages(n_pages, seed)])
    return _TRAINED[n_pages, seed]


def main_text(page: str | None, model: Crf) -> tuple[str, int, int]:
    """The main text, the number of blocks and that of main blocks."""
    blocks = parse(page or "")
    kept = [b.text for b, label in zip(blocks, model.decode(blocks)) if label]
    return " ".join(kept), len(blocks), len(kept)


def extract(pages: DataFrame, model: Crf | None = None) -> DataFrame:
    """``page_id, url, text, n_chars, n_blocks, n_main`` for each row of ``pages(page_id, url, html)``.

    A null or empty page has the empty text. Repeated rows are returned again, an empty table gives
    no rows, other columns are ignored. There is no shuffle.
    """
    model = model or train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [main_text(h.as_py(), model) for h in batch.column("html")]
            text = [x[0] for x in got]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64()), pa.array([x[1] for x in got], pa.int64()), pa.array([x[2] for x in got], pa.int64())], ["page_id", "url", "text", "n_chars", "n_blocks", "n_main"])

    chosen = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return chosen.mapInArrow(run, SCHEMA)
