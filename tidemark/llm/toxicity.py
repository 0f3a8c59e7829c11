"""Toxicity by a subsequence string kernel, Nyström landmarks and a support vector machine.

The kernel of two strings sums, over all their common subsequences of 3 and 4 letters, DECAY to the power of
the stretches that those span in both: inserted characters make a match weaker but don't end it. A sentence
meets a landmark by its best word, or by its best run of pieces of up to SHORT characters, read without the white
space between them ("i d i o t", "id iot"). The landmarks are stretches of words that mark toxic sentences of the
training sample, found by greedy cover, and a few words of clean ones. A landmark stands for its image divided by
that image's length, in the kernel among landmarks and in the features alike, so the inverse root of the former
gives the Nyström map, in which a squared-hinge linear machine is trained. Pairs of a word and a landmark of whose
letters the word lacks more than SCREEN count as 0, in training as in scoring.

Labels are of documents, so the toxic sentences are latent: each round takes from a toxic document the
word that the last machine scores highest (multi-instance learning) and those with a landmark that no
clean document has, with copies into which a letter was inserted; of clean documents each word is clean. A document
scores as its worst word or run, through a logistic fit weighted to the labels' own class shares.

Texts are whole; words longer than WIDTH letters are read in overlapping pieces.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SAMPLE_PER_CLASS = 1000
"""The training sample: at most so many labelled documents of each class, whatever their length; of each its distinct words."""

WIDTH, DECAY, ORDERS = 24, 0.5, (3, 4)
SCREEN = 0.2
LANDMARKS, BACKGROUND = 48, 8
LIKELY, COMMON, HARD = 4000, 400, 20_000
"""Bounds of the fit on its sample: stretches weighed as landmarks, clean words to choose the background from, clean words a round trains on."""

CACHE_WORDS = 150_000
ROWS, WORDS, PAIRS = 500, 20_000, 8192
"""Texts, distinct words and pairs of a word and a landmark that are worked on at a time."""

LONGEST = 9
SHORT = 3
PREDICTED = 0.3
"""The score from which a text counts as toxic."""

_MARKS = r"[^\p{L}\p{N}]+"


def units(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words and runs of a column of texts, lower-cased, without marks; index of each unit; its text).

    A run is a longest series of two or more pieces of up to SHORT characters, joined. What stands between letters
    of a word doesn't count as a gap.
    """
    split = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(column, "").cast(pa.large_string())))
    split = split.combine_chunks() if isinstance(split, pa.ChunkedArray) else split
    flat, bounds = split.flatten(), np.diff(split.offsets.to_numpy())
    owner = np.repeat(np.arange(len(column)), bounds)
    size = pc.utf8_length(flat).to_numpy()
    short = (size > 0) & (size <= SHORT)
    begins = short & ~np.concatenate([[False], short[:-1] & (owner[1:] == owner[:-1])]) if len(flat) else short
    ends = short & ~np.concatenate([short[1:] & (owner[1:] == owner[:-1]), [False]]) if len(flat) else short
    first, last = np.flatnonzero(begins), np.flatnonzero(ends)
    first, last = first[last > first], last[last > first]
    # words lie side by side in the flat array, so a run is one slice of its bytes; every other slice is what is between
    _, offs, data = flat.buffers()
    offs = np.frombuffer(offs, np.int64, len(flat) + 1, flat.offset * 8) if len(flat) else np.zeros(1, np.int64)
    edges = np.concatenate([np.stack([offs[first], offs[last + 1]], axis=1).ravel(), offs[last[-1:] + 1]])
    runs = pa.LargeStringArray.from_buffers(2 * len(first), pa.py_buffer(edges), data).take(pa.array(np.arange(0, 2 * len(first), 2))) if len(first) else pa.array([], pa.large_string())
    raw = pa.concat_arrays([flat, runs]).dictionary_encode()
    bare = pc.replace_substring_regex(raw.dictionary, _MARKS, "").dictionary_encode()
    index = bare.indices.to_numpy()[raw.indices.to_numpy()] if len(raw) else np.empty(0, np.int64)
    return bare.dictionary, index, np.concatenate([owner, owner[first]])


def _letters(words: list[str]) -> np.ndarray:
    """Code points, zero-padded to WIDTH."""
    return np.array(words, f"<U{WIDTH}").view(np.uint32).reshape(len(words), WIDTH)


def _sets(letters: np.ndarray) -> np.ndarray:
    """Of each word the set of its letters as bits (code points share the 63 bits)."""
    bits = np.where(letters > 0, np.uint64(1) << (letters % np.uint32(63)).astype(np.uint64), np.uint64(0))
    return np.bitwise_or.reduce(bits, axis=1)


def kernel(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Subsequence kernel of each row of ``left`` with the same row of ``right``, code points padded with zeros.

    Letter by letter of the left word, ``ahead[n][:, j]`` holds what the common subsequences of n letters that lie
    in the part read and in the first j letters of the right word weigh, counted up to the ends of both.
    """
    rows, m = right.shape
    lam = np.float32(DECAY)
    right = np.where(right == 0, np.uint32(0xFFFFFFFF), right)
    decay = np.triu(lam ** np.maximum(0, np.arange(m)[None, :] - np.arange(m)[:, None])).astype(np.float32)
    ahead = [np.ones((rows, m + 1), np.float32)] + [np.zeros((rows, m + 1), np.float32) for _ in range(max(ORDERS) - 1)]
    out = np.zeros(rows, np.float32)
    for i in range(left.shape[1]):
        equal = (left[:, i, None] == right).astype(np.float32) * (lam * lam)
        for n in range(max(ORDERS), 0, -1):
            met = equal * ahead[n - 1][:, :-1]
            if n in ORDERS:
                out += met.sum(axis=1)
            if n < max(ORDERS):
                ahead[n] *= lam
                ahead[n][:, 1:] += met @ decay
    return out


def _pieces(word: str) -> list[str]:
    if len(word) <= WIDTH:
        return [word]
    half = WIDTH // 2
    return [word[i : i + WIDTH] for i in range(0, len(word) - half, half)]


@dataclass
class Model:
    """A trained machine; without landmarks every text scores ``prior``."""

    landmarks: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.empty(0))
    bias: float = 0.0
    slope: float = 0.0
    offset: float = 0.0
    prior: float = 0.0

    def __post_init__(self) -> None:
        if not self.landmarks:
            return
        self._codes = _letters(self.landmarks)
        self._bits = _sets(self._codes)
        self._need = np.ceil((1 - SCREEN) * np.bitwise_count(self._bits)).astype(np.uint8)
        self._norm = np.sqrt(kernel(self._codes, self._codes))
        self._unit = float(np.median(self._norm))

    def features(self, words: list[str]) -> np.ndarray:
        """Kernel with each landmark over the landmark's length, in units of a usual landmark's; last, the word's own number of letters."""
        letters = _letters(words)
        lengths = (letters > 0).sum(axis=1)
        sets, out = _sets(letters), np.zeros((len(words), len(self.landmarks) + 1), np.float32)
        out[:, -1] = lengths / WIDTH
        near = np.bitwise_count(sets[:, None] & self._bits[None, :]) >= self._need[None, :]
        rows, marks = np.nonzero(near & (lengths >= min(ORDERS))[:, None])
        order = np.argsort(lengths[rows], kind="stable")  # so that a block is as narrow as its words are
        rows, marks = rows[order], marks[order]
        for i in range(0, len(rows), PAIRS):
            r, k = rows[i : i + PAIRS], marks[i : i + PAIRS]
            out[r, k] = kernel(letters[r, : lengths[r[-1]]], self._codes[k, :LONGEST]) / (self._norm[k] * self._unit)
        return out

    def margins(self, words: list[str]) -> np.ndarray:
        """Of each word its signed distance; of a long word that of its worst piece."""
        out = np.full(len(words), -np.inf)
        for a in range(0, len(words), WORDS):
            parts, owner = [], []
            for i, word in enumerate(words[a : a + WORDS]):
                for p in _pieces(word):
                    parts.append(p)
                    owner.append(a + i)
            np.maximum.at(out, owner, self.features(parts) @ self.weights + self.bias)
        return out

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))


def _choose_landmarks(toxic: list[set[str]], clean: list[set[str]]) -> tuple[list[str], list[str]]:
    """Stretches of 4 to 9 letters by greedy cover of the toxic documents, then common clean words; those of them that no clean document has."""
    bad, good = Counter(w for d in toxic for w in d), Counter(w for d in clean for w in d)
    ratio = len(clean) / max(1, len(toxic))
    marked = [w for w, k in bad.items() if k >= 3 and k * ratio >= 8 * (good[w] + 0.5)]
    where: dict[str, set[int]] = defaultdict(set)
    docs_of: dict[str, list[int]] = defaultdict(list)
    for i, d in enumerate(toxic):
        for w in d:
            docs_of[w].append(i)
    for w in marked:
        for size in range(4, LONGEST + 1):
            for i in range(len(w) - size + 1):
                where[w[i : i + size]].update(docs_of[w])
    plain = "\n".join(good)
    likely = sorted(where, key=lambda s: (-len(where[s]), -len(s), s))[:LIKELY]
    spoilt = {s: plain.count(s) for s in likely}
    where = {s: where[s] for s in likely if len(where[s]) > 3 * spoilt[s]}
    wanted, chosen = np.full(len(toxic), 4), []
    while len(chosen) < LANDMARKS:
        gain = lambda s: (sum(1 for i in where[s] if wanted[i] > 0) - 3 * spoilt[s], len(s), s)
        best = max((s for s in where if s not in chosen and not any(s in c or c in s for c in chosen)), key=gain, default=None)
        if best is None or gain(best)[0] < max(2, len(toxic) // 500):
            break
        chosen.append(best)
        wanted[list(where[best])] -= 1
    return (chosen + [w for w, _ in good.most_common(COMMON) if 5 <= len(w) <= 9][:BACKGROUND] if chosen else []), [s for s in chosen if not spoilt[s]]


def _machine(x: np.ndarray, y: np.ndarray, c: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Squared-hinge linear machine by Newton steps on the active rows; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        active = y * (x @ w) < 1
        a = x[active] * c[active, None]
        new = np.linalg.solve(ridge * np.eye(x.shape[1]) + a.T @ x[active], a.T @ y[active])
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w


def fit(rows: list[tuple[set[str], int]], share: float) -> Model:
    """Train on (words, toxic) rows, the words as ``units`` has them; ``share``: the labels' share of toxic documents."""
    toxic_words, clean_words = [w - {""} for w, y in rows if y == 1], [w - {""} for w, y in rows if y == 0]
    if not toxic_words or not clean_words:
        return Model(prior=share)
    landmarks, pure = _choose_landmarks(toxic_words, clean_words)
    if not landmarks:
        return Model(prior=share)
    model = Model(landmarks)
    n = len(landmarks)
    one, two = np.divmod(np.arange(n * n), n)
    gram = kernel(model._codes[one], model._codes[two]).reshape(n, n) / np.outer(model._norm, model._norm)
    values, vectors = np.linalg.eigh(gram.astype(float))
    root = np.eye(n + 1)
    root[:-1, :-1] = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T

    words = sorted({p for d in toxic_words + clean_words for w in d for p in _pieces(w)})
    raw = np.vstack([model.features(words[i : i + WORDS]) for i in range(0, len(words), WORDS)])
    index = {w: i for i, w in enumerate(words)}
    members = lambda docs: [np.array([index[p] for w in d for p in _pieces(w)], np.int64) for d in docs]
    bags, negatives = members(toxic_words), np.array(sorted({index[p] for d in clean_words for w in d for p in _pieces(w)}), np.int64)
    marks = (raw[:, :n] * model._unit / model._norm)[:, : n - BACKGROUND if n > BACKGROUND else n].max(axis=1)
    telling = re.compile("|".join(map(re.escape, pure))) if pure else None
    sure = {i for i in set().union(*(b.tolist() for b in bags)) if telling.search(words[i])} if telling else set()
    rng = np.random.default_rng(7)
    level = marks
    for _ in range(4):
        hard = negatives[np.argsort(-level[negatives], kind="stable")][:HARD]
        witness = np.array(sorted(sure | {int(b[np.argmax(level[b])]) for b in bags if len(b)}))
        varied = []
        for w in (words[i] for i in witness):
            k = int(rng.integers(1, max(2, len(w))))
            varied += [(w[:k] + c + w[k:])[:WIDTH] for c in "xh"]
        x = np.vstack([raw[witness], model.features(varied), raw[hard]]) @ root
        y = np.concatenate([np.ones(len(witness) + len(varied)), -np.ones(len(hard))])
        c = np.where(y > 0, 1 / (y > 0).sum(), 1 / (y < 0).sum())
        w = _machine(x, y, c)
        model.weights, model.bias = root @ w[:-1], float(w[-1])
        level = raw @ model.weights + model.bias
    worst = np.array([level[b].max() if len(b) else model.bias for b in bags + members(clean_words)])
    truth = np.array([1.0] * len(bags) + [0.0] * len(clean_words))
    target = np.where(truth > 0, (len(bags) + 1) / (len(bags) + 2), 1 / (len(clean_words) + 2))
    weight = np.where(truth > 0, share / len(bags), (1 - share) / len(clean_words))
    p = np.zeros(2)
    design = np.stack([worst, np.ones(len(worst))], axis=1)
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(design @ p, -30, 30)))
        hess = design.T @ (design * (weight * q * (1 - q))[:, None]) + 1e-6 * np.eye(2)
        p = p + np.linalg.solve(hess, design.T @ (weight * (target - q)) - 1e-6 * p)
    model.slope, model.offset = map(float, p)
    return model


def held_out(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on a bounded sample of labelled documents, chosen by a hash of doc_id; held-out rows give no labels."""
    C.bound_batches(docs.sparkSession)
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    if not counts:
        return Model()
    share = counts.get(1, 0) / sum(counts.values())
    pick = lambda y: known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id")).limit(SAMPLE_PER_CLASS)
    sample = F.broadcast(pick(0).union(pick(1)))  # 2 * SAMPLE_PER_CLASS rows

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                found, index, owner = units(part.column(1))
                pairs = np.unique(owner.astype(np.int64) * len(found) + index)
                own = np.searchsorted(pairs, np.arange(part.num_rows + 1) * max(1, len(found)))
                lists = pa.ListArray.from_arrays(pa.array(own, pa.int32()), found.cast(pa.string()).take(pa.array(pairs % max(1, len(found)))))
                yield pa.record_batch([part.column(0), lists, part.column(2)], names=["doc_id", "words", "toxic"])

    rows = docs.select(F.col("doc_id").cast("long"), "text").join(sample, "doc_id").select("doc_id", "text", F.col("toxic").cast("int"))
    rows = rows.mapInArrow(words, "doc_id long, words array<string>, toxic int").distinct().orderBy(F.xxhash64("doc_id"), "words").limit(2 * SAMPLE_PER_CLASS)
    return fit([(set(w), y) for _, w, y in sorted((r.doc_id, r.words, r.toxic) for r in rows.collect())], share)


class _Scores:
    """Scores of texts by a model, with what it found for words that were met lately."""

    def __init__(self, model: Model):
        self.model, self.cache = model, {}

    def __call__(self, column: pa.Array) -> np.ndarray:
        m, cache = self.model, self.cache
        if not m.landmarks:
            return np.full(len(column), m.prior)
        found, index, owner = units(column)
        if len(cache) > CACHE_WORDS:
            cache.clear()
        words = found.to_pylist()
        if new := [w for w in words if w not in cache]:
            cache.update(zip(new, m.margins(new).tolist(), strict=True))
        worst = np.full(len(column), -np.inf)
        if words:
            np.maximum.at(worst, owner, np.array([cache[w] for w in words])[index])
        return m.score(np.where(np.isfinite(worst), worst, m.bias))


def reject(docs: DataFrame, model: Model, threshold: float = PREDICTED) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; all columns stay, nothing is shuffled.

    Rows are judged by their texts alone: a null doc_id is no matter, repeated rows stay or go alike, null and empty
    texts score as texts in which no landmark is met.
    """
    C.bound_batches(docs.sparkSession)
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _Scores(sent.value)
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                yield part.filter(pa.array(scores(part.column(at)) < threshold))

    return docs.mapInArrow(run, docs.schema)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1) and predicted (score >= 0.3).

    Null and empty texts score as a text in which no landmark is met. Rows that repeat score alike; a null
    doc_id is kept, and not held out. Only doc_id and text are read.
    """
    C.bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _Scores(sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                yield pa.record_batch([part.column(0), pa.array(scores(part.column(1)), pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= PREDICTED).cast("int").alias("predicted"))
