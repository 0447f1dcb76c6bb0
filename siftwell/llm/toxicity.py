"""Toxic spans and document scores by a linear-chain conditional random field (operator 2).

Labels are per document, so tokens are labelled first: features (whole words and word beginnings) that
occur in toxic documents far more often than in clean ones mark tokens of toxic documents as toxic; all
tokens of clean documents are clean. A two-state chain is fitted to windows of such tokens by maximum
likelihood. Forward-backward marginals of the chain over a whole text give its offending spans; their sum
and the text's length give the document's score, by a logistic fitted to the labelled documents.

Fitting uses a bounded sample, ``SAMPLE`` labelled documents of either label; scoring covers all texts.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import each_text, per_batch, stored, texts
from siftwell.llm.vocab import Store

#: Labelled documents of either label that are fitted to, at most; the bound of the driver's data.
SAMPLE = 4000
#: Features kept; windows a document gives, and their tokens.
FEATURES, WINDOWS, WIDTH = 3000, 3, 32
PREFIXES = range(3, 10)
EDGES = ".,;:!?#*$%&|<>\"'()[]{}"
THRESHOLD = 0.3
OFFENDING = 0.5


def held_out(doc_id: Column) -> Column:
    """Rows labels are never learned from; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def features(word: str) -> list[str]:
    word = word.strip(EDGES)
    return ["=" + word, *(word[:n] for n in PREFIXES if n < len(word))] if word else []


def tokens(text: str) -> list[str]:
    return text.lower().split()


# --- what is learned from ---------------------------------------------------------------------------

def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """text, toxic of at most ``most`` documents of each label, those with the smallest hashed ids.

    Labels of held-out rows and null labels are left out; a document labelled both ways counts as toxic.
    Near copies would make the words of one document look typical, so of documents whose smallest long
    word by hash is the same only one is taken.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))) \
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = None
    for label in (0, 1):
        part = known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = part if chosen is None else chosen.unionAll(part)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")

    def make():
        def work(batch):
            return {"like": [min((zlib.crc32(w.encode()) for w in set(tokens(t)) if len(w) > 8), default=zlib.crc32(t.encode()))
                             for t in texts(batch)]}

        return work

    return stored(per_batch(rows, make, "like bigint").dropDuplicates(["like", "toxic"]).select("text", "toxic"), "labelled")


def seed_weights(labelled: DataFrame, most: int = FEATURES, per_document: int = 3, fewest: int = 4, ratio: float = 4.0) -> dict[str, float]:
    """Log ratio of a feature's rate in toxic and clean documents, for the ``most`` surest features.

    A document counts a feature ``per_document`` times at most, so repeated text weighs little.
    """
    def make():
        def work(batch):
            seen: dict[str, list[int]] = {}
            for text, toxic in zip(texts(batch), batch.column("toxic").to_pylist()):
                words, found = Counter(tokens(text)), Counter()
                for word, n in words.items():
                    for f in features(word):
                        found[f] += n
                for f, n in found.items():
                    row = seen.setdefault(f, [0, 0, 0])
                    row[toxic] += min(n, per_document)
                    row[2] += toxic
            rows = [(f, *r) for f, r in seen.items()]
            # one row of the batch carries the whole list; the others are empty
            return {"counts": [[dict(zip("fcts", r)) for r in rows]] + [[]] * (batch.num_rows - 1)}

        return work

    counted = per_batch(labelled, make, "counts array<struct<f:string,c:bigint,t:bigint,s:bigint>>", keep=["toxic"]) \
        .select(F.inline("counts")).groupBy("f").agg(F.sum("c").alias("clean"), F.sum("t").alias("toxic"), F.sum("s").alias("documents"))
    sizes = {r["toxic"]: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    n_clean, n_toxic = max(1, sizes.get(0, 0)), max(1, sizes.get(1, 0))
    rate = (F.col("toxic") / n_toxic) / ((F.col("clean") + 0.5) / n_clean)
    best = counted.where((F.col("documents") >= fewest) & (rate >= ratio)) \
        .select("f", F.log(rate).alias("weight"), "toxic").orderBy(F.desc(F.col("weight") * F.col("toxic")), "f").limit(most)
    return {r["f"]: r["weight"] for r in best.collect()}


def seen_features(word: str, known: dict[str, int]) -> tuple[int, ...] | None:
    found = tuple(known[f] for f in features(word) if f in known)
    return found or None


def windows(labelled: DataFrame, names: list[str]) -> list[tuple[int, int, list[tuple[int, tuple[int, ...]]]]]:
    """(toxic, length, [(place, features)]) of up to ``WINDOWS`` windows around the featured tokens of each
    document and one at its start; tokens without a feature need no mention."""
    known = {f: i for i, f in enumerate(names)}

    def make():
        cache = Store(lambda word: seen_features(word, known))

        def work(batch):
            out = []
            for text in texts(batch):
                cache.trim()
                words = tokens(text)
                hits = [(i, f) for i, w in enumerate(words) if (f := cache[w])]
                starts = [0] if words else []
                for i, _ in hits:
                    if len(starts) <= WINDOWS and i >= starts[-1] + WIDTH:
                        starts.append(max(starts[-1] + WIDTH, i - WIDTH // 2))
                out.append([{"n": min(WIDTH, len(words) - s),
                             "at": [i - s for i, _ in hits if s <= i < s + WIDTH],
                             "fs": [list(f) for i, f in hits if s <= i < s + WIDTH]} for s in starts])
            return {"w": out}

        return work

    rows = per_batch(labelled, make, "w array<struct<n:int,at:array<int>,fs:array<array<int>>>>", keep=["toxic"])
    return [(r["toxic"], r["n"], list(zip(r["at"], map(tuple, r["fs"])))) for r in rows.select("toxic", F.inline("w")).collect()]


# --- the chain ---------------------------------------------------------------------------------------

class Chain:
    """States 0 clean and 1 toxic. ``weights`` are evidence for 1 by feature, ``bias`` for any token;
    ``moves`` scores each step from a state to the next."""

    def __init__(self, weights: np.ndarray, bias: float, moves: np.ndarray):
        self.weights, self.bias, self.moves = weights, bias, moves
        self.step = np.exp(moves + np.array([0.0, bias])[None])
        self.powers = [np.eye(2)]

    def gap(self, k: int) -> np.ndarray:
        """Steps over ``k`` tokens without evidence, scaled. The first 64 are kept."""
        if k < 64:
            while len(self.powers) <= k:
                m = self.powers[-1] @ self.step
                self.powers.append(m / m.sum())
            return self.powers[k]
        half = self.gap(k // 2) @ self.gap(k - k // 2)
        return half / half.sum()

    def marginals(self, n: int, places: list[int], evidence: list[float]) -> np.ndarray:
        """Probability of state 1 at ``places`` of a chain of ``n`` tokens, all others without evidence."""
        if not places:
            return np.zeros(0)
        into = [np.exp(self.moves + np.array([0.0, self.bias + e])[None]) for e in evidence]
        first = np.array([1.0, np.exp(self.bias)])
        ahead, forward, last = None, [], -1
        for p, m, e in zip(places, into, evidence):
            if last < 0:
                ahead = np.array([1.0, np.exp(self.bias + e)]) if p == 0 else first @ self.gap(p - 1) @ m
            else:
                ahead = ahead @ self.gap(p - last - 1) @ m
            ahead = ahead / ahead.sum()
            forward.append(ahead)
            last = p
        back = self.gap(n - 1 - last) @ np.ones(2)
        out = [0.0] * len(places)
        for k in range(len(places) - 1, -1, -1):
            both = forward[k] * back
            out[k] = both[1] / both.sum()
            if k:
                back = self.gap(places[k] - places[k - 1] - 1) @ (into[k] @ back)
                back = back / back.sum()
        return np.array(out)


def fit_chain(found: list, seeds: np.ndarray, rounds: int = 150, penalty: float = 1e-3) -> Chain:
    """Maximum likelihood by gradient steps (Adam), with forward and backward passes over all windows at once."""
    size, width = max(1, len(found)), WIDTH
    label, mask = np.zeros((size, width), int), np.zeros((size, width), bool)
    rows, feats = [], []
    for k, (toxic, n, hits) in enumerate(found):
        mask[k, :n] = True
        for place, fs in hits:
            label[k, place] = toxic
            rows += [k * width + place] * len(fs)
            feats += fs
    rows, feats = np.array(rows, int), np.array(feats, int)
    theta = np.concatenate([0.5 * seeds, [-3.0], [0.0, 0.0, 0.5]])  # weights, bias, moves 0-1, 1-0, 1-1
    m, v, rate = np.zeros_like(theta), np.zeros_like(theta), 0.1
    n_w = len(seeds)
    both = mask[:, 1:] & mask[:, :-1]
    for t in range(1, rounds + 1):
        unary = np.zeros((size, width, 2))
        unary[..., 1] = theta[n_w] + np.bincount(rows, theta[feats] if len(feats) else None, size * width).reshape(size, width)
        moves = np.array([[0.0, theta[n_w + 1]], [theta[n_w + 2], theta[n_w + 3]]])
        f = np.zeros((size, width, 2))
        b = np.zeros((size, width, 2))
        f[:, 0] = unary[:, 0]
        for i in range(1, width):
            s = f[:, i - 1, :, None] + moves
            new = np.logaddexp(s[:, 0], s[:, 1]) + unary[:, i]
            f[:, i] = np.where(mask[:, i, None], new, f[:, i - 1])
        for i in range(width - 2, -1, -1):
            s = moves + (unary[:, i + 1] + b[:, i + 1])[:, None]
            b[:, i] = np.where(mask[:, i + 1, None], np.logaddexp(s[..., 0], s[..., 1]), 0.0)
        total = np.logaddexp(f[:, -1, 0], f[:, -1, 1])
        p1 = np.where(mask, np.exp(f[..., 1] + b[..., 1] - total[:, None]), 0)
        pair = np.exp(f[:, :-1, :, None] + moves + (unary[:, 1:] + b[:, 1:])[:, :, None] - total[:, None, None, None]) * both[..., None, None]
        gap = (label - p1) * mask
        grad = np.zeros_like(theta)
        if len(feats):
            grad[:n_w] = np.bincount(feats, gap.ravel()[rows], n_w)
        grad[n_w] = gap.sum()
        for j, (x, y) in enumerate(((0, 1), (1, 0), (1, 1)), 1):
            grad[n_w + j] = ((label[:, :-1] == x) & (label[:, 1:] == y) & both).sum() - pair[..., x, y].sum()
        grad = -grad / size + penalty * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad ** 2
        theta -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
    return Chain(theta[:n_w], float(theta[n_w]), np.array([[0.0, theta[n_w + 1]], [theta[n_w + 2], theta[n_w + 3]]]))


# --- documents ----------------------------------------------------------------------------------------

def summary(total: float, n: int) -> list[float]:
    """What the score depends on: expected toxic tokens, alone and against the length."""
    return [1.0, np.log(total + 0.05), np.log(n + 1.0), np.log((total + 0.05) / (n + 1.0) + 1e-4)]


class Model:
    """The fitted chain, its features and the document logistic; small, so it travels with the tasks."""

    def __init__(self, names: list[str], chain: Chain, document: np.ndarray):
        self.names, self.chain, self.document = names, chain, document

    def reader(self):
        known = {f: i for i, f in enumerate(self.names)}
        weights = self.chain.weights

        def evidence(word: str) -> float | None:
            found = seen_features(word, known)
            return None if found is None else float(weights[list(found)].sum())

        cache = Store(evidence)

        def read(text: str) -> tuple[int, list[int], np.ndarray]:
            cache.trim()
            words = tokens(text)
            hits = [(i, e) for i, w in enumerate(words) if (e := cache[w]) is not None]
            places = [i for i, _ in hits]
            return len(words), places, self.chain.marginals(len(words), places, [e for _, e in hits])

        return read

    def score(self, total: float, n: int) -> float:
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.document, summary(total, n)), -30, 30))))


def fit_document(total: np.ndarray, n: np.ndarray, toxic: np.ndarray, share: float, rounds: int = 30) -> np.ndarray:
    """Logistic by Newton steps; labels are weighted to the share of toxic ones among all labels."""
    x = np.array([summary(*r) for r in zip(total, n)]).reshape(-1, 4)
    have = toxic.mean() if len(toxic) else 0.5
    weight = np.where(toxic == 1, share / max(have, 1e-9), (1 - share) / max(1 - have, 1e-9))
    beta = np.array([-2.0, 0.0, 0.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (toxic - p)) - 0.02 * beta * [0, 1, 1, 1]
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([1e-6, 0.02, 0.02, 0.02])
        step = np.linalg.solve(curve, slope)
        beta = beta + step / max(1.0, np.abs(step).max() / 2)
    return beta


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    """Fit everything to the bounded sample. Without labels of both kinds, documents score by what is
    known of one kind: near 0 without toxic ones."""
    labelled = sample(docs, labels, most)
    seeds = seed_weights(labelled)
    names = sorted(seeds)
    chain = fit_chain(windows(labelled, names), np.array([seeds[f] for f in names]))
    draft = Model(names, chain, np.zeros(4))

    def make():
        read = draft.reader()

        def work(batch):
            got = [read(t) for t in texts(batch)]
            return {"n": [g[0] for g in got], "total": [float(g[2].sum()) for g in got]}

        return work

    rows = per_batch(labelled, make, "n bigint, total double", keep=["toxic"]).collect()
    known = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    share = known.agg(F.avg(F.col("toxic").cast("double"))).head()[0] or 0.0
    total, n, toxic = (np.array([r[c] for r in rows], float) for c in ("total", "n", "toxic"))
    return Model(names, chain, fit_document(total, n, toxic, min(max(share, 0.01), 0.99)))


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, drop_toxic: bool = False) -> DataFrame:
    """``docs`` (or ``keep`` of it) with score, predicted and toxic_spans (start and end of offending words
    in code points, with their marginal). Null and empty texts have a score of their own, that of no words;
    repeated rows score alike; only the text is looked at. ``drop_toxic`` leaves out rows predicted toxic.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model, read = shipped.value, shipped.value.reader()

        def work(batch):
            out = {"score": [], "predicted": [], "toxic_spans": []}
            for text in each_text(batch):
                n, places, p = read(text)
                value = model.score(float(p.sum()), n)
                bad = [(i, x) for i, x in zip(places, p) if x >= OFFENDING]
                words = list(re.finditer(r"\S+", text)) if bad else []
                out["score"].append(value)
                out["predicted"].append(int(value >= THRESHOLD))
                out["toxic_spans"].append([{"start": words[i].start(), "end": words[i].end(), "marginal": float(x)}
                                           for i, x in bad if i < len(words)])
            return out

        return work

    scored = per_batch(docs, make, "score double, predicted int, toxic_spans array<struct<start:int,end:int,marginal:double>>",
                       keep=keep, tidy=True)
    return scored.where("predicted = 0") if drop_toxic else scored
