"""Toxic spans and document scores by a linear-chain conditional random field of two states."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import LOWER, row_wise, text_bytes

_TOKEN = re.compile(rb"[^\x20\x09-\x0D]+")
_EDGE = bytes(x for x in range(33, 127) if not chr(x).isalnum())


def token_features(raw: bytes, prefixes: tuple[int, ...] = (4, 5, 6, 7)) -> list[str]:
    """The word in lower case without marks at its ends, and its first letters."""
    word = raw.decode("utf-8", "replace").lower().strip(_EDGE.decode()) if not raw.isascii() else raw.translate(LOWER).strip(_EDGE).decode()
    return ["=" + word] + [word[:k] for k in prefixes if len(word) > k] if word else []


@dataclass
class Chain:
    """weights: of features that tell the toxic state; start: bias; move: log potentials [from, to]; last: of the document score."""

    weights: dict[str, float]
    bias: float = 0.0
    move: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    last: np.ndarray = field(default_factory=lambda: np.zeros(5))


def blocks(lengths: np.ndarray, most: int = 400_000):
    """Runs of sequence numbers, longest first, whose padded table stays under ``most`` cells (or one sequence)."""
    order = np.argsort(-lengths, kind="stable")
    at = 0
    while at < len(order):
        n = max(1, most // max(1, int(lengths[order[at]])))
        yield order[at : at + n]
        at += n


def marginal_odds(lift: np.ndarray, lengths: np.ndarray, move: np.ndarray):
    """Forward-backward over a padded table (time, sequence) of emission lifts, longest sequence first.

    Two states need one number each way: the ratio of toxic to clean.  Returns the log odds of the toxic state and the
    ratios; steps after a sequence's end are left out of the recursion.
    """
    a = np.exp(move)
    gain = np.exp(np.clip(lift, -30, 30))
    steps, n = lift.shape
    active = [int(np.searchsorted(-lengths, -t, side="left")) for t in range(steps + 1)]  # sequences longer than t
    ahead, back = np.ones((steps, n)), np.ones((steps, n))
    ahead[0] = gain[0]
    for t in range(1, steps):
        k = active[t]
        r = ahead[t - 1, :k]
        ahead[t, :k] = np.clip(gain[t, :k] * (a[0, 1] + r * a[1, 1]) / (a[0, 0] + r * a[1, 0]), 1e-30, 1e30)
    for t in range(steps - 2, -1, -1):
        k = active[t + 1]
        q = gain[t + 1, :k] * back[t + 1, :k]
        back[t, :k] = np.clip((a[1, 0] + a[1, 1] * q) / (a[0, 0] + a[0, 1] * q), 1e-30, 1e30)
    return np.log(ahead) + np.log(back), ahead, back


def table_of(sequences: list[np.ndarray], fill: float = 0.0):
    lengths = np.array([len(x) for x in sequences])
    out = np.full((max(1, int(lengths.max(initial=0))), len(sequences)), fill)
    for i, x in enumerate(sequences):
        out[: len(x), i] = x
    return out, lengths


def document_marks(odds: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """What the document score sees of the marginals: mass, rate, peak, and how many tokens are likelier toxic than not."""
    on = np.arange(len(odds))[:, None] < lengths
    p = np.where(on, 1 / (1 + np.exp(-np.clip(odds, -40, 40))), 0.0)
    sure = np.where(p >= .2, p, 0.0).sum(0)
    return np.stack([np.ones(odds.shape[1]), np.log1p(sure), 10 * sure / np.maximum(lengths, 20), p.max(0, initial=0.0), np.minimum((p >= .5).sum(0), 4) / 4], 1)


def fit(samples: list[tuple[bytes, int]], share: float, epochs: int = 25, least: int = 2, seed: int = 3) -> Chain:
    """Fit on texts with document labels; ``share``: of toxic ones among all labelled documents.

    Tokens are labelled first: in a toxic text, a token is toxic if one of its features is far more frequent in toxic texts, in each of
    two halves of the sample.  The chain is then fitted to those tokens by its gradient (forward-backward
    expectations), and the document score to the labels by weighted logistic regression on the marginals.
    """
    labels = np.array([y for _, y in samples])
    sizes = np.zeros((2, 2))
    np.add.at(sizes, (np.arange(len(samples)) % 2, labels.astype(int)), 1)
    if not sizes.any() or labels.min(initial=1) == 1 or labels.max(initial=0) == 0:
        return Chain({}, -8.0, np.zeros((2, 2)), np.array([np.log(max(share, 1e-3) / max(1 - share, 1e-3)), 0, 0, 0, 0]))
    met = [[Counter(), Counter()] for _ in range(2)]  # documents by half and label
    for y in (1, 0):
        for i, (text, label) in enumerate(samples):
            if label == y:
                found = {f for w in set(text.split()) for f in token_features(w)}
                met[i % 2][y].update(found if y else found & wanted)
        if y:
            wanted = {f for f, n in met[0][1].items() if min(n, met[1][1][f]) >= least}
    lifted = {}
    for f in wanted:
        odds = [np.log((met[k][1][f] + .5) / (sizes[k, 1] + 1)) - np.log((met[k][0][f] + .5) / (sizes[k, 0] + 1)) for k in range(2)]
        if min(odds) > 1.8:
            lifted[f] = float(np.mean(odds))
    del met, wanted
    names = {f: i for i, f in enumerate(sorted(lifted))}
    rows, gold, of_word = [], [], {}
    for text, y in samples:
        words = text.split()
        for w in set(words).difference(of_word):
            of_word[w] = tuple(names[f] for f in token_features(w) if f in names)
        rows.append([of_word[w] for w in words])
        gold.append(np.array([float(bool(y and r)) for r in rows[-1]]))
    # flat feature lists: position of each token's features
    weights = np.array([lifted[f] for f in sorted(lifted)]) if names else np.zeros(0)
    bias, move = -4.0, np.array([[0.0, -1.0], [0.0, 0.0]])
    lengths = np.array([len(r) for r in rows])
    packs = []
    for block in blocks(lengths):
        index = [(t, k, f) for k, i in enumerate(block) for t, fs in enumerate(rows[i]) for f in fs]
        t, k, f = np.array(index, np.int64).reshape(-1, 3).T
        packs.append((t, k, f, lengths[block], table_of([gold[i] for i in block])[0]))
    theta = np.concatenate([weights, [bias], move.ravel()])
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    total = max(1, lengths.sum())
    for step in range(1, epochs + 1):
        grad = np.zeros_like(theta)
        for t, k, f, n, want in packs:
            if not n.max(initial=0):
                continue
            lift = np.full(want.shape, theta[len(weights)])
            np.add.at(lift, (t, k), theta[f])
            m = theta[-4:].reshape(2, 2)
            odds, ahead, back = marginal_odds(lift, n, m)
            on = np.arange(len(lift))[:, None] < n
            gap = np.where(on, want - 1 / (1 + np.exp(-np.clip(odds, -40, 40))), 0.0)
            grad[: len(weights)] += np.bincount(f, gap[t, k], len(weights))
            grad[len(weights)] += gap.sum()
            r, q = ahead[:-1], np.exp(np.clip(lift[1:], -30, 30)) * back[1:]
            a = np.exp(m)
            pair = np.stack([np.full_like(r, a[0, 0]), a[0, 1] * q, r * a[1, 0], r * a[1, 1] * q])
            pair = np.where(on[1:], pair / pair.sum(0), 0.0).sum((1, 2))
            w0, w1 = want[:-1], want[1:]
            seen = np.array([((1 - w0) * (1 - w1) * on[1:]).sum(), ((1 - w0) * w1 * on[1:]).sum(), (w0 * (1 - w1) * on[1:]).sum(), (w0 * w1 * on[1:]).sum()])
            grad[-4:] += seen - pair
        grad = grad / total * 1000 - 1e-3 * theta
        first = .9 * first + .1 * grad
        second = .99 * second + .01 * grad * grad
        theta = theta + .15 * (first / (1 - .9**step)) / (np.sqrt(second / (1 - .99**step)) + 1e-8)
    chain = Chain(dict(zip(sorted(lifted), theta[: len(weights)].tolist())), float(theta[len(weights)]), theta[-4:].reshape(2, 2))
    marks = np.zeros((len(samples), 5))
    for (t, k, f, n, want), block in zip(packs, blocks(lengths)):
        lift = np.full(want.shape, chain.bias)
        np.add.at(lift, (t, k), theta[f])
        marks[block] = document_marks(marginal_odds(lift, n, chain.move)[0], n)
    weight = np.where(labels == 1, share / labels.mean(), (1 - share) / (1 - labels.mean()))
    last = np.zeros(5)
    for _ in range(60):  # Newton steps of a ridge logistic regression
        p = 1 / (1 + np.exp(-np.clip(marks @ last, -30, 30)))
        slope = marks.T @ (weight * (labels - p)) - .05 * last
        bend = (marks * (weight * p * (1 - p))[:, None]).T @ marks + .05 * np.eye(5)
        move_by = np.linalg.solve(bend, slope)
        last = last + move_by * min(1.0, 2.0 / max(np.abs(move_by).max(), 1e-9))
    chain.last = last
    return chain


class Tagger:
    """Scores texts by a fitted chain; the lifts of words are cached, a full cache is emptied."""

    def __init__(self, chain: Chain, most: int = 500_000) -> None:
        self.chain, self.most, self.lifts = chain, most, {}

    def _lift(self, raw: bytes) -> float:
        w = self.chain.weights
        return self.chain.bias + sum(w.get(f, 0.0) for f in token_features(raw))

    def scores(self, data: list[bytes], spans: bool = False) -> list[tuple[float, str | None]]:
        if len(self.lifts) > self.most:
            self.lifts = {}
        cache, sequences = self.lifts, []
        for x in data:
            words = x.split()
            for w in set(words).difference(cache):
                cache[w] = self._lift(w)
            sequences.append(np.array([cache[w] for w in words]))
        lengths = np.array([len(x) for x in sequences])
        out: list = [None] * len(data)
        for block in blocks(lengths):
            table, n = table_of([sequences[i] for i in block])
            odds = marginal_odds(table, n, self.chain.move)[0]
            score = 1 / (1 + np.exp(-np.clip(document_marks(odds, n) @ self.chain.last, -40, 40)))
            for k, i in enumerate(block.tolist()):
                hit = np.flatnonzero(odds[: n[k], k] > 0) if spans else ()
                out[i] = float(score[k]), self._offsets(data[i], hit) if spans else None
        return out

    @staticmethod
    def _offsets(text: bytes, hit) -> str:
        """start:end in code points of each token likelier toxic than not."""
        if not len(hit):
            return ""
        places = [m.span() for m in _TOKEN.finditer(text)]
        point = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
        return ",".join(f"{point[places[i][0]]}:{point[places[i][1]]}" for i in hit)


def remainder(doc: str, of: int):
    return F.pmod(F.crc32(F.col(doc).cast("string").cast("binary")), F.lit(of))


def training_sample(docs: DataFrame, labels: DataFrame, doc: str, text: str, label: str, most_toxic: int, most_clean: int, learnable):
    """Up to ``most_toxic`` and ``most_clean`` labelled texts, drawn by a hash of the id, and the share of toxic among all learnable labels."""
    marked = labels.where(F.col(label).isNotNull() & F.col(doc).isNotNull()).groupBy(F.col(doc).alias("__id")).agg(F.max(label).cast("int").alias("__y"))
    marked = marked.where(learnable("__id"))
    row = marked.agg(F.avg("__y").alias("share")).first()
    rank = F.xxhash64(F.lit("sample"), "__id")
    parts = [marked.where(F.col("__y") == y).orderBy(rank, "__id").limit(n) for y, n in ((1, most_toxic), (0, most_clean))]
    picked = F.broadcast(parts[0].unionByName(parts[1]))  # most_toxic + most_clean rows at most
    rows = docs.join(picked, docs[doc] == picked["__id"]).select("__id", "__y", F.col(text).alias("__text")).collect()
    distinct = {(r["__text"] or ""): (r["__id"], r["__y"]) for r in sorted(rows, key=lambda r: -r["__id"])}
    return [(t.encode(), y) for t, (_, y) in sorted(distinct.items(), key=lambda x: x[1])], row["share"] or 0.0


def score(docs: DataFrame, keep: list[str], chain: Chain, text: str = "text", spans: bool = True) -> DataFrame:
    """``keep`` columns, ``score`` (0 to 1) and ``toxic_spans`` of each whole text.

    A null or empty text has no tokens; its score is that of a document without any sign.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def compute(batches):
        tagger = Tagger(shared.value)
        for batch in batches:
            rows = tagger.scores(text_bytes(batch, text), spans)
            yield [list(c) for c in zip(*rows)] or [[], []]

    return row_wise(docs, keep, text, {"score": "double", "toxic_spans": "string"}, compute)
