"""Toxicity scores by a subsequence string kernel, Nyström features and a linear support vector machine.

The kernel of two words sums their common subsequences of three letters, each weighted by how far it is spread in both, so an insult with letters put in, left out or doubled stays near. A second kernel of longer subsequences, weighed against the landmark alone, stays high however many letters stand in the gaps, which the first, weighed against both words, does not. Landmarks are words that distinct toxic training texts hold significantly more often than clean ones. A document has two features for each: how far its nearest word, by either kernel, goes beyond what clean texts reach, which is learned too, and how often its words come near. They are whitened by the landmarks' own kernel matrix (Nyström), a support vector machine weighs them and a logistic curve makes its decision a score.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.bpe import Remembered
from quire.llm.common import bounded_rows, checkpoint, digest, once, whole

#: Labelled documents of each label that are learned from, about, at the most.
ROWS = 6000
#: Letters in a subsequence; what each letter of spread costs.
ORDER, DECAY = 3, 0.9
#: Letters in a subsequence of the second kernel, all of a shorter landmark's; a text's value counts from this share of what the landmark has with a strange letter in every gap, or from what clean texts reach.
LONG, NEARLY = 5, 0.85
#: Landmarks whose level is greater get nothing from the second kernel: clean words come so near them that they have forms of their own there.
CROWDED = 0.65
#: Landmarks at the most, and candidates for them that come to the driver; the fewest distinct toxic texts that hold one; the least likelihood ratio (2 ln) for its being more frequent there, which chance gives less than once in 20 million words.
LANDMARKS, CANDIDATES, LEAST_DOCS, SIGNIFICANT = 96, 600, 3, 30.0
#: A landmark's kernel with each one before it is less than this.
APART = 0.8
#: Lesser kernels count as zero; the share of clean training texts that may go beyond a landmark's level; the share of the way from that level to an equal word after which a feature is whole.
FLOOR, BEYOND, WHOLE_FROM = 0.3, 0.0005, 0.5
#: The share of near words from which the second feature is whole; texts count as this long at the least.
RATE, SHORT = 0.02, 10
#: Lesser eigenvalues of the landmarks' kernel matrix are raised to this; weight of the training rows against the size of the vector machine's weights.
EIGEN, COST = 0.2, 3000.0
#: Longer words are looked at in overlapping windows.
WINDOW, STEP = 24, 12
#: Minimum hashes of a training text in bands: texts that share a band, likely from a similarity of 0.8 on, are near copies.
BANDS, IN_BAND, SHINGLE = 8, 4, 5

#: Code points looked at together; pairs of words compared at once; words that a task remembers; letters told apart by one mask.
SLICE, PAIRS, KEPT, MASK = 1 << 20, 1024, 200_000, 63
POINTS = 0x110000

NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")


def letters(chunk: str) -> str:
    """Lower-case letters of a chunk, without what stands between them."""
    return NOT_LETTERS.sub("", chunk if chunk.isascii() else unicodedata.normalize("NFC", chunk)).lower()


def coded(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters as a matrix of code points, padded by zero, and the lengths."""
    size = max(map(len, words), default=1)
    out = np.zeros((len(words), size), dtype=np.int32)
    for i, w in enumerate(words):
        out[i, : len(w)] = np.frombuffer(w.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return out, np.array([len(w) for w in words])


def raw_kernel(a: np.ndarray, b: np.ndarray, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """Gap-weighted subsequence kernel of the words in rows of a and b, pair by pair; padding matches nothing.

    prefix[i, j] sums subsequences so far that end within the first i and j letters, decayed to there; pairs lie side by side in memory.
    """
    n, m, pairs = a.shape[1], b.shape[1], len(a)
    equal = ((a.T[:, None, :] == b.T[None, :, :]) & (a.T[:, None, :] != 0)) * (decay * decay)
    prefix = np.ones((n + 1, m + 1, pairs))
    for _ in range(order - 1):
        closed = equal * prefix[:-1, :-1]
        prefix = np.zeros((n + 1, m + 1, pairs))
        run = np.empty(pairs)
        for i in range(n):
            run[:] = 0
            for j in range(m):
                run *= decay
                run += closed[i, j]
                np.multiply(prefix[i, j + 1], decay, out=prefix[i + 1, j + 1])
                prefix[i + 1, j + 1] += run
    return (equal * prefix[:-1, :-1]).sum(axis=(0, 1))


def norms_of(codes: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(raw_kernel(codes, codes), 1e-12))


def windows(word: str) -> list[str]:
    return [word[s : s + WINDOW] for s in range(0, len(word) - WINDOW + STEP, STEP)] if len(word) > WINDOW else [word]


class Kernel:
    """Normalised kernels of words against landmarks."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        self.codes, _ = coded(landmarks)
        self.norms = norms_of(self.codes) if landmarks else np.zeros(0)
        self.sets = [frozenset(w) for w in landmarks]
        self.alphabet = sorted(frozenset().union(*self.sets))
        self.needed = np.array([max(min(ORDER, len(s)), len(s) - 1) for s in self.sets], dtype=np.uint8)
        self.long = np.array([min(LONG, len(w)) for w in landmarks], dtype=int)
        self.own = self.whole(self.codes, np.arange(len(landmarks)))
        open_codes, _ = coded(["\0".join(w) for w in landmarks])  # a gap is like padding: it matches nothing
        self.spread = self.whole(open_codes, np.arange(len(landmarks))) / self.own
        self.by_set = Remembered(lambda own: [j for j, s in enumerate(self.sets) if len(own & s) >= self.needed[j]], 50_000)

    def whole(self, codes: np.ndarray, rights: np.ndarray) -> np.ndarray:
        """The second kernel of each row with the landmark of its number."""
        out = np.zeros(len(codes))
        for order in np.unique(self.long[rights]):
            some = np.flatnonzero(self.long[rights] == order)
            out[some] = raw_kernel(codes[some], self.codes[rights[some]], int(order))
        return out

    def of(self, words: list[str]) -> np.ndarray:
        """A row for each word: its kernels, of its nearest window if it is long, zero below FLOOR and where a word lacks two or more of a landmark's letters; then its second kernels as shares of the landmark's own, zero where it lacks any letter or the share is under NEARLY of that with all gaps filled."""
        out, open_ = np.zeros((2, len(words), len(self.landmarks)))
        parts = [(i, part) for i, w in enumerate(words) for part in windows(w)]
        near = [self.by_set[frozenset(part)] for _, part in parts]
        need = sorted((k for k, js in enumerate(near) if js), key=lambda k: len(parts[k][1]))  # by length, so little is padded
        codes, size = coded([parts[k][1] for k in need])
        norms = np.concatenate([norms_of(codes[s : s + PAIRS, : size[s : s + PAIRS].max()]) for s in range(0, len(need), PAIRS)]) if need else np.zeros(0)
        lefts, rights = np.repeat(np.arange(len(need)), [len(near[k]) for k in need]), np.array([j for k in need for j in near[k]], dtype=int)
        owner = np.array([parts[k][0] for k in need], dtype=int)
        for s in range(0, len(lefts), PAIRS):
            left, right = lefts[s : s + PAIRS], rights[s : s + PAIRS]
            value = raw_kernel(codes[left, : size[left[-1]]], self.codes[right]) / (norms[left] * self.norms[right])
            np.maximum.at(out, (owner[left], right), np.where(value >= FLOOR, value, 0.0))
        full = np.array([self.sets[j] <= frozenset(parts[need[i]][1]) for i, j in zip(lefts, rights, strict=True)], dtype=bool)
        lefts, rights = lefts[full], rights[full]
        for s in range(0, len(lefts), PAIRS):
            left, right = lefts[s : s + PAIRS], rights[s : s + PAIRS]
            value = self.whole(codes[left, : size[left[-1]]], right) / self.own[right]
            np.maximum.at(open_, (owner[left], right), np.where(value >= NEARLY * self.spread[right], value, 0.0))
        return np.c_[out, open_]


class Reader:
    """A text's nearest word to each landmark.

    Texts are read as arrays of code points: a mask of each word's letters tells, for all words at once, which could be near a landmark; only those are looked up in a bounded table of words met before.
    """

    def __init__(self, landmarks: list[str]):
        self.kernel = Kernel(landmarks)
        self.space = np.zeros(POINTS, dtype=bool)
        self.space[[i for i in range(0x3001) if chr(i).isspace()]] = True
        self.masks: list[tuple[np.ndarray, np.ndarray]] = []
        for s in range(0, len(self.kernel.alphabet), MASK):
            bits = np.zeros(POINTS, dtype=np.uint64)
            some = self.kernel.alphabet[s : s + MASK]
            for i, c in enumerate(some):
                bits[[ord(x) for x in {c, c.upper()} if len(x) == 1]] = 1 << i
            self.masks.append((bits, np.array([sum(1 << i for i, c in enumerate(some) if c in own) for own in self.kernel.sets], dtype=np.uint64)))
        self.rows: dict[str, np.ndarray | None] = {}

    def near(self, texts: list[str]) -> np.ndarray:
        """A row for each text: for each landmark the greatest kernel of its words, then for each the share of its words that are near, then for each the greatest second kernel."""
        size = len(self.kernel.landmarks)
        out, lengths = np.zeros((len(texts), 3 * size)), np.zeros(len(texts))
        parts: list[tuple[int, str]] = []
        held = 0
        for i, text in enumerate(texts if size else []):
            for part in slices(text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)):
                if held + len(part) > SLICE:
                    self.scan(parts, out, lengths)
                    parts, held = [], 0
                parts.append((i, part))
                held += len(part) + 1
        if parts:
            self.scan(parts, out, lengths)
        out[:, size : 2 * size] /= np.maximum(lengths, SHORT)[:, None]
        return out

    def scan(self, parts: list[tuple[int, str]], out: np.ndarray, lengths: np.ndarray) -> None:
        text = "\n".join(part for _, part in parts)
        data = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        gap = self.space[data]
        starts = np.flatnonzero(~gap & np.r_[True, gap[:-1]])
        if not len(starts):
            return
        ends = np.flatnonzero(~gap & np.r_[gap[1:], True]) + 1
        counts = np.zeros((len(self.kernel.landmarks), len(starts)), dtype=np.uint8)
        for bits, own in self.masks:
            mask = np.bitwise_or.reduceat(bits[data], starts)
            for j in range(len(own)):
                counts[j] += np.bitwise_count(mask & own[j])
        hit = np.flatnonzero((counts >= self.kernel.needed[:, None]).any(axis=0))
        begins = np.cumsum([0, *(len(part) + 1 for _, part in parts[:-1])])
        doc = np.array([i for i, _ in parts])[np.searchsorted(begins, starts, side="right") - 1]
        lengths += np.bincount(doc, minlength=len(lengths))
        words = [text[s:e] for s, e in zip(starts[hit].tolist(), ends[hit].tolist(), strict=True)]
        docs = doc[hit].tolist()
        for at in spelt(np.flatnonzero(ends - starts == 1), doc):
            word = "".join(text[i] for i in starts[at])
            if word.isalpha():
                words.append(word)
                docs.append(int(doc[at[0]]))
        self.look_up(words)
        found = [(i, row) for i, row in zip(docs, map(self.rows.__getitem__, words), strict=True) if row is not None]
        if found:
            owners, size = [i for i, _ in found], len(self.kernel.landmarks)
            rows, gaps = np.split(np.array([row for _, row in found]), [size], axis=1)
            np.maximum.at(out[:, :size], owners, rows)
            np.add.at(out[:, size : 2 * size], owners, np.maximum(rows - FLOOR, 0) / (1 - FLOOR))
            np.maximum.at(out[:, 2 * size :], owners, gaps)

    def look_up(self, words: list[str]) -> None:
        """See that rows holds all words: None where no landmark is near. Kernels of many words together take little longer than of one."""
        new = {w for w in words if w not in self.rows}
        if not new:
            return
        if len(self.rows) + len(new) > KEPT:
            self.rows.clear()
            new = set(words)
        plain = {w: letters(w) for w in new}
        distinct = sorted(set(plain.values()))
        rows = self.kernel.of(distinct)
        values = {p: row.astype(np.float32) if near else None for p, row, near in zip(distinct, rows, rows.any(axis=1), strict=True)}  # copies, so the whole matrix isn't kept
        self.rows |= {w: values[p] for w, p in plain.items()}


def slices(text: str) -> Iterator[str]:
    """The text in parts of about SLICE, cut at white space after a word of two or more letters; where there is none parts overlap by a window."""
    at = 0
    while len(text) - at > SLICE:
        end = next((e for e in range(at + SLICE, at + SLICE // 2, -1) if text[e].isspace() and not text[e - 1].isspace() and not text[e - 2].isspace()), None)
        yield text[at : end or at + SLICE]
        at = end or at + SLICE - WINDOW
    yield text[at:]


def spelt(single: np.ndarray, doc: np.ndarray) -> list[np.ndarray]:
    """Runs of three or more words of one letter each: words spelt out."""
    if len(single) < 3:
        return []
    cuts = np.flatnonzero((np.diff(single) > 1) | (np.diff(doc[single]) != 0)) + 1
    return [run for run in np.split(single, cuts) if len(run) > 2]


def train_svm(x: np.ndarray, y: np.ndarray, each: np.ndarray, cost: float = COST) -> tuple[np.ndarray, float]:
    """Linear support vector machine with squared hinge loss, by Newton steps on the rows within the margin; labels are 1 and -1, both classes weigh the same, their rows as `each` says."""
    weight = cost * each / np.where(y > 0, each[y > 0].sum(), each[y < 0].sum())
    z = np.c_[x, np.ones(len(x))]
    ridge = np.diag([*np.ones(x.shape[1]), 1e-6])
    t = np.zeros(z.shape[1])
    loss = lambda t: t @ ridge @ t + (weight * np.maximum(0, 1 - y * (z @ t)) ** 2).sum()
    for _ in range(40):
        inside = y * (z @ t) < 1
        zi, wi = z[inside], weight[inside]
        step = np.linalg.solve((zi * wi[:, None]).T @ zi + ridge, (zi * wi[:, None]).T @ y[inside]) - t
        size = 1.0
        while size > 1e-4 and loss(t + size * step) > loss(t):
            size /= 2
        if size <= 1e-4 or abs(step).max() < 1e-9:
            break
        t = t + size * step
    return t[:-1], float(t[-1])


def train_logistic(decisions: np.ndarray, y: np.ndarray, each: np.ndarray) -> np.ndarray:
    """(slope, offset) that fit P(label 1), by Newton steps; a little ridge keeps them finite."""
    x, t = np.c_[decisions, np.ones(len(decisions))], np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ t, -30, 30)))
        h = (x * (each * p * (1 - p))[:, None]).T @ x + np.eye(2) * 1e-2
        t = t - np.linalg.solve(h, x.T @ (each * (p - y)) + 1e-2 * t)
    return t


class Scorer:
    """A trained model at work."""

    def __init__(self, model: dict):
        self.model, self.reader = model, Reader(model["landmarks"])

    def scores(self, texts: list[str]) -> np.ndarray:
        m = self.model
        decisions = features(self.reader.near(texts), m["levels"], m["gaps"], self.reader.kernel.spread) @ m["whiten"] @ m["weights"] + m["base"]
        return 1 / (1 + np.exp(-np.clip(decisions * m["curve"][0] + m["curve"][1], -30, 30)))


def features(near: np.ndarray, levels: np.ndarray, gaps: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """How far each kernel goes beyond its level, 0 up to there, 1 from WHOLE_FROM of the way to an equal word, or how far the second goes beyond its own on the way to a word with all gaps filled, whichever is more; then how near the share of near words comes to RATE. Where clean texts reach as far as filled gaps the second says nothing."""
    size = len(levels)
    closed = (near[:, :size] - levels) / ((1 - levels) * WHOLE_FROM)
    room = np.where(spread > gaps, spread - gaps, np.inf) * WHOLE_FROM
    return np.c_[np.clip(np.maximum(closed, (near[:, 2 * size :] - gaps) / room), 0, 1), np.minimum(near[:, size : 2 * size] / RATE, 1)]


def sketch(text: str) -> list[int]:
    """Hashes of bands of minimum hashes of the text's shingles, each with its band's number in it."""
    words = text.lower().split() or [""]
    hashed = np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words], dtype=np.uint64)
    n = max(1, len(words) - SHINGLE + 1)
    shingles = np.zeros(n, dtype=np.uint64)
    for i in range(min(SHINGLE, len(words))):
        shingles = (shingles ^ hashed[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        shingles ^= shingles >> np.uint64(29)
    rng = np.random.default_rng(3)
    factors = rng.integers(1, 1 << 63, BANDS * IN_BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    lows = np.array([(shingles * f >> np.uint64(20)).min() for f in factors], dtype=np.uint64).reshape(BANDS, IN_BAND)
    return [xxhash.xxh64_intdigest(row.tobytes(), b) - (1 << 63) for b, row in enumerate(lows)]


def distinct_texts(sample: DataFrame) -> DataFrame:
    """One row of each group of near copies with one label, of a bounded, checkpointed sample (label, text): a row stays unless an earlier one shares a band with it."""

    @F.pandas_udf("array<long>")
    def bands(texts: pd.Series) -> pd.Series:
        return texts.map(sketch)

    rows = sample.withColumn("row", F.monotonically_increasing_id())
    each = checkpoint(rows.select("row", "label", F.explode(bands("text")).alias("band")))
    first = each.groupBy("label", "band").agg(F.min("row").alias("first"))
    stays = each.join(first, ["label", "band"]).groupBy("row").agg(F.min("first").alias("first")).filter("first = row")
    return rows.join(stays.select("row"), "row", "left_semi").select("label", "text")


def learn(labelled: DataFrame) -> dict:
    """A model from a bounded sample of rows (text, label 0 or 1), near copies once.

    Words are counted on the executors and only the CANDIDATES best come to the driver; so do the features of the sampled texts, a few floats each. Whatever a text's length, all its words count. One label alone gives a constant score.
    """
    sample = checkpoint(distinct_texts(checkpoint(labelled.filter("text IS NOT NULL").select("label", "text"))))
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    constant = {"landmarks": [], "levels": np.zeros(0), "gaps": np.zeros(0), "whiten": np.zeros((0, 0)), "weights": np.zeros(0), "base": 0.0, "curve": np.array([0.0, np.log((pos + 0.5) / (neg + 0.5))])}
    if not pos or not neg:
        return constant

    @F.pandas_udf("array<string>")
    def words(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted({w for c in t.split() if ORDER <= len(w := letters(c)) <= WINDOW}) for t in texts])

    found = sample.select("label", F.explode(words("text")).alias("word")).groupBy("word").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n"))
    both = F.col("p") + F.col("n")
    part = lambda seen, share: F.when(seen > 0, seen * F.log(seen / (both * share))).otherwise(0.0)
    ratio = 2 * (part(F.col("p"), pos / (pos + neg)) + part(F.col("n"), neg / (pos + neg)))
    likelier = found.filter((F.col("p") >= LEAST_DOCS) & (F.col("p") * neg > F.col("n") * pos)).withColumn("ratio", ratio)
    best = likelier.filter(F.col("ratio") >= SIGNIFICANT).orderBy(F.col("ratio").desc(), "word").limit(CANDIDATES)
    held = {r["word"]: r["p"] for r in best.select("word", "p").collect()}
    landmarks = spread(list(held))
    if not landmarks:
        return constant
    shared, key = sample.sparkSession.sparkContext.broadcast(landmarks), digest(landmarks)

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = once(key, lambda: Reader(shared.value))
        for batch in batches:
            yield pd.DataFrame({"label": batch["label"], "near": list(reader.near(batch["text"].tolist()))})

    rows = sample.mapInPandas(featured, "label int, near array<double>").toPandas()
    near, y = np.array(rows["near"].tolist()), rows["label"].to_numpy(float)
    size = len(landmarks)
    kernel = Kernel(landmarks)
    clean = np.sort(near[y == 0], axis=0)
    reached = clean[len(clean) - 1 - int(BEYOND * len(clean))]
    levels = np.clip(reached[:size], FLOOR, 0.95)
    gaps = np.maximum(reached[2 * size :], np.where(levels > CROWDED, 1, NEARLY) * kernel.spread)
    gram, open_ = np.split(kernel.of(landmarks), 2, axis=1)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    whiten = np.kron(np.eye(2), vectors @ np.diag(1 / np.sqrt(np.maximum(values, EIGEN))) @ vectors.T)
    # a landmark alone in a long text is toxic too, as often as texts hold it: no training text need have just one
    x = features(np.r_[near, np.c_[gram, np.zeros_like(gram), open_]], levels, gaps, kernel.spread) @ whiten
    y, each = np.r_[y, np.ones(size)], np.r_[np.ones(len(near)), [float(held[m]) for m in landmarks]]
    weights, base = train_svm(x, np.where(y > 0, 1.0, -1.0), each)
    return {"landmarks": landmarks, "levels": levels, "gaps": gaps, "whiten": whiten, "weights": weights, "base": base, "curve": train_logistic(x @ weights + base, y, each)}


def spread(candidates: list[str]) -> list[str]:
    """The first LANDMARKS candidates that lie APART from those before them."""
    if not candidates:
        return []
    like = Kernel(candidates).of(candidates)[:, : len(candidates)]
    chosen: list[int] = []
    for i in range(len(candidates)):
        if len(chosen) < LANDMARKS and not (like[i, chosen] >= APART).any():
            chosen.append(i)
    return [candidates[i] for i in chosen]


def toxicity(docs: DataFrame, labels: DataFrame, known: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row per row of docs: id, score (0 to 1) and predicted (1 from a score of 0.5), learned from the texts and labels of rows where `known`, a condition on the id, holds.

    Null and empty texts score as texts without any near word. Null labels and ids are left out of training, near copies count once there. Repeated rows stay; other columns are ignored whatever their names; an empty table gives an empty result.
    """
    marked = labels.filter(known).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("id IS NOT NULL AND label IN (0, 1)")
    chosen = bounded_rows(marked, "label", ROWS, "id")  # of the labels alone: about ROWS ids of each of two labels, so they can be broadcast
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    model = learn(texts.join(F.broadcast(chosen), "id"))
    shared, key = docs.sparkSession.sparkContext.broadcast(model), digest(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = once(key, lambda: Scorer(shared.value))
        for batch in batches:
            yield pd.Series(scorer.scores(batch.tolist()), dtype="float64")

    out = docs.select(F.col(id_col).alias("_id"), whole(text_col).alias("_text")).select(F.col("_id").alias(id_col), scored("_text").alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
