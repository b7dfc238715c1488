"""Toxicity by a support vector machine on a subsequence string kernel with Nyström landmarks.

The kernel of two words adds up the subsequences of three characters that they share, with gaps:
a subsequence counts less for each character it spans, up to ``SPAN``. A word with an inserted
or doubled character, or with signs between its letters, so stays close to the word it hides;
letters that stand alone are also read together. A text is a bag of words; for each landmark it
has the kernel with its nearest word and how many words come close. The landmark kernel's inverse
root (Nyström) turns the first into coordinates, and a linear support vector machine with a
squared hinge, trained on labelled texts, gives a margin that a fitted sigmoid turns into a score.

Labels say which texts are toxic, not which sentences, so texts are what it is trained on. It is fitted
on a bounded sample, ``ROWS`` texts of each class with the least hashes of their ids; every text
is scored whole. Only the text is an input of the score.

Null and empty texts have no words and get the score of a text without any. Without labels of both
classes the score is the share of toxic labels (0 without labels). Repeated rows are scored alike;
labels that contradict each other count as toxic. An empty table gives an empty table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from paperlode.llm.common import handing_back, words
from paperlode.session import settle

#: Most labelled texts of each class that a model is fitted on.
ROWS = 4_000
LANDMARKS = 96
#: The widest subsequence of three characters, and the weight of each character spanned.
SPAN = 5
DECAY = 0.6
#: From here on a word counts as close to a landmark.
CLOSE = 0.6
#: Longer words are read in pieces of this length that overlap by half.
PIECE = 32
#: Words and tokens that a Python worker remembers.
REMEMBERED = 200_000
#: Tokens of a text that are looked up at once.
CHUNK = 10_000

EDGES = ".,;:!?\"'()[]{}"
LONE = regex.compile(r"(?<!\S)(?:\p{L}[^\p{L}\s]*\s+){2,}\p{L}(?!\S)")


def word_list(text: str | None) -> list[str]:
    """Lower-case words without punctuation at their ends. Words with signs in them are read once
    more by their letters alone, and runs of lone letters as one word."""
    if not text:
        return []
    low = text.lower()
    found = [w for w in (x.strip(EDGES) for x in low.split()) if w]
    found += [x for x in ("".join(filter(str.isalpha, w)) for w in found if not w.isalnum()) if x]
    if any(len(w) == 1 for w in found):
        found += ["".join(c for c in m.group() if c.isalpha()) for m in LONE.finditer(low)]
    if found and max(map(len, found)) > PIECE:
        found = [p for w in found for p in _pieces(w)]
    return found


def words_of(token: str) -> list[str]:
    """The words of ``word_list`` that a token (a run without blanks) gives on its own."""
    if token.isalnum() and len(token) <= PIECE:
        return [token]
    word = token.strip(EDGES)
    found = [word] if word else []
    if found and not word.isalnum():
        letters = "".join(filter(str.isalpha, word))
        found += [letters] if letters else []
    return [p for w in found for p in _pieces(w)]


def lone_words(tokens: list[str]) -> list[str]:
    """Runs of lone letters as one word: three or more tokens that each have one letter, at their
    start, the last one nothing else. The longest run from each start counts, as in ``LONE``."""
    ends = [i for i, t in enumerate(tokens) if len(t) == 1 and t.isalpha()]
    found, free = [], 0
    known: dict[int, bool] = {}

    def lone(i: int) -> bool:
        if i not in known:
            t = tokens[i]
            known[i] = t[0].isalpha() and not any(map(str.isalpha, t[1:]))
        return known[i]

    at = 0
    while at < len(ends):
        start = ends[at]
        while start > free and lone(start - 1):
            start -= 1
        last, i = at, ends[at]
        while i + 1 < len(tokens) and lone(i + 1):
            i += 1
            if last + 1 < len(ends) and ends[last + 1] == i:
                last += 1
        end = ends[last]
        if end - start >= 2:
            found.append("".join(t[0] for t in tokens[start : end + 1]))
            free = end + 1
        at = last + 1
    return [p for w in found for p in _pieces(w)]


def _pieces(word: str) -> list[str]:
    if len(word) <= PIECE:
        return [word]
    return [word[s : s + PIECE] for s in range(0, len(word) - PIECE // 2, PIECE // 2)]


def _codes(items: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, subsequence, weight): all subsequences of all words, equal ones added up. A word
    starts and ends with a sign of its own."""
    body = np.frombuffer("".join([f"\x01{w}\x02" for w in items]).encode("utf-32-le"), "<u4")
    sizes = np.array([len(w) + 2 for w in items])
    owner = np.repeat(np.arange(len(items)), sizes)
    end = np.cumsum(sizes)[owner]
    c = body.astype(np.uint64)
    place = np.arange(len(body))
    who, code, weight = [], [], []
    with np.errstate(over="ignore"):
        for i in range(1, SPAN - 1):
            for j in range(i + 1, SPAN):
                at = place[place + j < end]
                x = c[at] * np.uint64(0x9E3779B97F4A7C15)
                x = (x ^ (x >> np.uint64(29))) + c[at + i] * np.uint64(0xC2B2AE3D27D4EB4F)
                x = (x ^ (x >> np.uint64(31))) * np.uint64(0x165667B19E3779F9) + c[at + j]
                x = x * np.uint64(0xD6E8FEB86659FD93)
                who.append(owner[at])
                code.append(x ^ (x >> np.uint64(32)))
                weight.append(np.full(len(at), DECAY ** (j + 1)))
        w, x, v = np.concatenate(who), np.concatenate(code), np.concatenate(weight)
        mark = x ^ (w.astype(np.uint64) * np.uint64(0x27D4EB2F165667C5))
    order = np.argsort(mark, kind="stable")
    edge = np.ones(len(order), dtype=bool)
    edge[1:] = mark[order[1:]] != mark[order[:-1]]
    first = np.nonzero(edge)[0]
    return w[order[first]], x[order[first]], np.add.reduceat(v[order], first)


class Kernel:
    """Normalised kernels of words with the landmarks."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        w, x, v = _codes(landmarks)
        v = v / np.sqrt(np.bincount(w, v * v, len(landmarks)))[w]
        order = np.argsort(x, kind="stable")
        self.known, self.first = np.unique(x[order], return_index=True)
        self.first = np.append(self.first, len(x))
        self.owner, self.weight = w[order], v[order]

    def __call__(self, items: list[str]) -> np.ndarray:
        m = len(self.landmarks)
        out = np.zeros((len(items), m), dtype=np.float32)
        for s in range(0, len(items), 2_000):
            part = items[s : s + 2_000]
            w, x, v = _codes(part)
            norm = np.sqrt(np.bincount(w, v * v, len(part)))
            at = np.minimum(np.searchsorted(self.known, x), len(self.known) - 1)
            hit = np.nonzero(self.known[at] == x)[0]
            # Few landmarks hold a subsequence: only they are added to.
            first, n = self.first[at[hit]], np.diff(self.first)[at[hit]]
            place = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
            cell = np.repeat(w[hit] * m, n) + self.owner[place]
            worth = np.repeat(v[hit] / norm[w[hit]], n) * self.weight[place]
            out[s : s + len(part)] = np.bincount(cell, worth, len(part) * m).reshape(-1, m)
        return out


@dataclass
class Reader:
    """Texts to features. A text's distinct tokens are counted first; the words of a token and the
    kernels of a word are remembered."""

    kernel: Kernel
    tokens: dict[str, int | tuple[int, ...]] = field(default_factory=dict)
    place: dict[str, int] = field(default_factory=dict)
    store: np.ndarray | None = None
    near: np.ndarray | None = None

    def forget(self) -> None:
        self.tokens, self.place = {}, {}
        room = (REMEMBERED + 8 * CHUNK, len(self.kernel.landmarks))
        self.store, self.near = np.zeros(room, np.float32), np.zeros(room[0], dtype=bool)

    def learn(self, tokens: list[str], others: list[str]) -> bool:
        """Remembers tokens and other words; whether there was room for them."""
        words = {t: words_of(t) for t in tokens}
        new = list(dict.fromkeys(w for own in [*words.values(), others] for w in own if w not in self.place))
        size = len(self.place)
        if size + len(new) > len(self.store) or len(self.tokens) + len(tokens) > 2 * REMEMBERED + CHUNK:
            return False
        part = slice(size, size + len(new))
        self.store[part] = self.kernel(new)
        self.near[part] = (self.store[part] > CLOSE).any(axis=1)
        self.place.update(zip(new, range(size, size + len(new)), strict=True))
        for t, own in words.items():
            at = tuple(self.place[w] for w in own)
            self.tokens[t] = at[0] if len(at) == 1 else at
        return True

    def bag(self, text: str | None) -> tuple[Counter, list[str]]:
        """Tokens of a text with their counts, and words that are not remembered by token: those
        of lone letters and of tokens that are long."""
        found = text.lower().split() if text else []
        counts = Counter(found)
        lengths = set(map(len, counts))
        others = lone_words(found) if 1 in lengths else []
        if lengths and max(lengths) > 2 * PIECE:
            for t in [t for t in counts if len(t) > 2 * PIECE]:
                others += words_of(t) * counts.pop(t)
        return counts, others

    def features(self, texts: list[str | None]) -> np.ndarray:
        m = len(self.kernel.landmarks)
        best, close = np.zeros((len(texts), m), np.float32), np.zeros((len(texts), m))
        if self.store is None:
            self.forget()
        bags: list[tuple[Counter, list[str]]] = []
        for i in range(len(texts)):
            if i % 64 == 0:  # the new tokens of several texts are learned together
                bags = [self.bag(t) for t in texts[i : i + 64]]
                new = {t for counts, _ in bags for t in counts if t not in self.tokens}
                if len(new) <= CHUNK and not self.learn(list(new), []):
                    self.forget()
            counts, others = bags[i % 64]
            tokens, times = list(counts), np.fromiter(counts.values(), np.float64, len(counts))
            parts = [(self._of_tokens, tokens[s : s + CHUNK], times[s : s + CHUNK]) for s in range(0, len(tokens), CHUNK)]
            parts += [(self._of_words, others[s : s + CHUNK]) for s in range(0, len(others), CHUNK)]
            for places, *own in parts:
                at, n = places(*own)
                if len(at):
                    np.maximum(best[i], self.store[at].max(axis=0), out=best[i])
                    some = self.near[at]
                    if some.any():
                        close[i] += n[some] @ np.maximum(self.store[at[some]] - CLOSE, 0)
        return np.hstack([best, np.log1p(close / (1 - CLOSE))]).astype(np.float64)

    def _of_tokens(self, tokens: list[str], times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = list(map(self.tokens.get, tokens))
        if None in found:
            if not self.learn([t for t, f in zip(tokens, found, strict=True) if f is None], []):
                self.forget()
                self.learn(tokens, [])
            found = list(map(self.tokens.__getitem__, tokens))
        several = [(k, f) for k, f in enumerate(found) if f.__class__ is tuple]
        for k, f in several:  # no word, or more than one
            found[k] = f[0] if f else -1
        more = [(p, times[k]) for k, f in several for p in f[1:]]
        at = np.array(found + [p for p, _ in more], dtype=np.int64)
        times = np.append(times, [n for _, n in more])
        return at[at >= 0], times[at >= 0]

    def _of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if any(w not in self.place for w in words) and not self.learn([], words):
            self.forget()
            self.learn([], words)
        return np.array([self.place[w] for w in words], dtype=np.int64), np.ones(len(words))


@dataclass
class Model:
    """All that scoring needs; its size depends on the landmarks alone."""

    landmarks: list[str]
    root: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float
    shift: float
    constant: float | None = None

    def inputs(self, features: np.ndarray) -> np.ndarray:
        m = len(self.landmarks)
        x = np.hstack([features[:, :m] @ self.root, features[:, m:]])
        return np.hstack([(x - self.mean) / self.scale, np.ones((len(x), 1))])

    def score(self, features: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(features), self.constant)
        margin = self.inputs(features) @ self.weights
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -500, 500)))


def svm(x: np.ndarray, y: np.ndarray, cost: float = 0.002, rounds: int = 50) -> np.ndarray:
    """Squared hinge with a ridge, by Newton steps on the rows inside the margin; classes weigh
    alike. The last column of ``x`` is the constant."""
    sign = np.where(y > 0, 1.0, -1.0)
    row = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum()))
    ridge = np.full(x.shape[1], cost)
    ridge[-1] = 1e-6
    w, before = np.zeros(x.shape[1]), None
    for _ in range(rounds):
        inside = sign * (x @ w) < 1
        if before is not None and (inside == before).all():
            break
        before = inside
        a = x[inside] * row[inside, None]
        w = np.linalg.solve(a.T @ x[inside] + np.diag(ridge), a.T @ sign[inside])
    return w


def sigmoid(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift that make margins into shares, by Newton steps."""
    x = np.stack([margin, np.ones(len(margin))], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - 1e-6 * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def _features(rows: DataFrame, text: str, kernel: Kernel) -> tuple[np.ndarray, np.ndarray]:
    """Labels and features of a bounded table of (y, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(kernel)
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                x = reader.features(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(list(x))], names=["y", "x"]
                )

    got = rows.select("y", text).mapInArrow(handing_back(run), "y int, x array<double>").toPandas()
    return got["y"].to_numpy(), np.array(got["x"].tolist()).reshape(len(got), -1)


def landmarks(rows: DataFrame, text: str, totals: dict[int, int], n: int = LANDMARKS) -> list[str]:
    """Words that the classes use most unlike each other, by their log-odds in standard errors;
    at most three that are close to each other, so that none crowds out the rest."""
    cleaned = F.regexp_replace(F.lower(F.col(text)), r"(?<!\S)\p{Punct}+|\p{Punct}+(?!\S)", "")
    per_text = rows.select("y", F.explode(F.array_distinct(words(cleaned))).alias("w"))
    per_text = per_text.filter(F.length("w").between(2, PIECE))
    counts = per_text.groupBy("w").agg(
        F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"), F.count("*").alias("all")
    )
    a, b = F.col("pos") + 0.5, F.col("neg") + 0.5
    odds = F.log(a / (totals[1] - F.col("pos") + 0.5)) - F.log(b / (totals[0] - F.col("neg") + 0.5))
    unlike = odds / F.sqrt(1 / a + 1 / b)
    ranked = counts.filter("all > 2").orderBy(unlike.desc(), "w").limit(8 * n).select("w")
    found, chosen, kernels = [r["w"] for r in ranked.collect()], [], None
    if not found:
        return ["\x03"]
    kernels = Kernel(found)(found)
    for i in range(len(found)):
        if len(chosen) < n and (kernels[i, chosen] > 0.5).sum() < 3:
            chosen.append(i)
    return [found[i] for i in chosen]


def training_sample(
    docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "y"
) -> tuple[DataFrame, dict[int, int]]:
    """(y, text) of at most ``ROWS`` texts of each class, and the labels of each class.

    Ids are chosen from the labels alone, by hashes that reruns agree on, so only chosen texts
    move; the chosen ids are at most 2 ``ROWS`` and therefore broadcast.
    """
    known = labels.groupBy(doc_id).agg(F.max(F.col(label).cast("int")).alias("y"))
    known = settle(known.filter(f"y in (0, 1) and `{doc_id}` is not null"), "labels")
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    at = F.xxhash64(doc_id)
    chosen = [known.filter(F.col("y") == y).orderBy(at, doc_id).limit(ROWS) for y in (0, 1)]
    chosen = settle(chosen[0].union(chosen[1]), "chosen")
    sample = docs.select(doc_id, text).join(F.broadcast(chosen), doc_id)
    sample = sample.dropDuplicates([doc_id]).select("y", text)
    return settle(sample, "toxic"), counts


def fit(sample: DataFrame, counts: dict[int, int], text: str = "text") -> Model:
    """A model of a bounded sample (y, text); ``counts``: labels of each class in the whole."""
    none = np.zeros((1, 1))
    found = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    if len(found) < 2:
        share = float(bool(found.get(1)))
        return Model(["\x03"], none, none, none, none, 0.0, 0.0, constant=share)
    counts = {y: max(counts.get(y, 0), found[y]) for y in (0, 1)}
    totals = found
    chosen = landmarks(sample, text, totals)
    kernel = Kernel(chosen)
    y, x = _features(sample, text, kernel)
    own = kernel(chosen).astype(float)
    values, vectors = np.linalg.eigh((own + own.T) / 2 + 0.01 * np.eye(len(chosen)))
    root = (vectors / np.sqrt(np.maximum(values, 0.01))) @ vectors.T
    model = Model(chosen, root, np.zeros(1), np.ones(1), np.zeros(1), 1.0, 0.0)
    raw = model.inputs(x)[:, :-1]
    model.mean, model.scale = raw.mean(axis=0), raw.std(axis=0) + 0.05
    inputs = model.inputs(x)
    fold = np.random.default_rng(3).permutation(len(y)) % 4
    margin = np.zeros(len(y))
    for f in range(4):
        margin[fold == f] = inputs[fold == f] @ svm(inputs[fold != f], y[fold != f])
    weight = np.where(y > 0, counts[1] / totals[1], counts[0] / totals[0])
    model.slope, model.shift = sigmoid(margin, y, weight)
    model.weights = svm(inputs, y)
    return model


def score(docs: DataFrame, model: Model, text: str = "text", to: str = "score") -> DataFrame:
    """``docs`` without the text and with the score of each whole text."""
    kept = [f for f in docs.schema.fields if f.name not in (text, to)]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(Kernel(model.landmarks))
        for b in batches:
            for s in range(0, b.num_rows, 512):
                part = b.slice(s, 512)
                x = reader.features(part.column(part.schema.get_field_index(text)).to_pylist())
                columns = [part.column(part.schema.get_field_index(c)) for c in names]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(model.score(x), pa.float64())], names=[*names, to]
                )

    schema = StructType([*kept, StructField(to, DoubleType())])
    return docs.select(*names, text).mapInArrow(handing_back(run), schema)
