"""Language identification: scripts narrow the candidates, then Viterbi over per-word scores labels spans of mixed text.

A word's score for a language is the mean log-likelihood of its letter trigrams there, as a difference from the best language, -6 at the least. Changing the language from one word to the next costs a penalty of 14, so a span of another language has three words at the least where it begins or ends a text, five inside one; shorter ones go to their neighbours. Texts are handled as arrays of code points, a bounded slice at a time.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import bounded_rows, checkpoint, digest, once, whole

#: Rows of each language that are learned from, at the most.
ROWS = 800
#: Letters told apart, the most frequent ones; two more classes stand for other letters of known scripts and for letters of unknown ones, 0 for the rest.
ALPHABET = 94
CLASSES = ALPHABET + 3
OTHER, FOREIGN = CLASSES - 2, CLASSES - 1
POINTS = 0x110000
WEIGHT, PENALTY, FLOOR = 2.0, 14.0, -6.0
#: A script counts as a language's own from this share of its letters.
SCRIPT_SHARE = 0.01
SLICE = 1 << 20


def script(letter: str) -> str:
    """The script a letter's name begins with, as LATIN, CYRILLIC or CJK."""
    return unicodedata.name(letter, "?").split(" ")[0].split("-")[0]


def points(text: str) -> np.ndarray:
    """Code points of the text in lower case."""
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")


def spaces() -> np.ndarray:
    found = np.zeros(POINTS, dtype=bool)
    found[[i for i in range(0x3001) if chr(i).isspace()]] = True
    return found


def trigrams(classes: np.ndarray) -> np.ndarray:
    """A trigram for each place that has a letter: it and both neighbours, non-letters as 0; -1 elsewhere."""
    edged = np.concatenate([[0], classes, [0]]).astype(np.int32)
    edged[edged == FOREIGN] = 0
    tri = (edged[:-2] * CLASSES + edged[1:-1]) * CLASSES + edged[2:]
    return np.where(edged[1:-1] > 0, tri, -1)


@dataclass
class Model:
    languages: list[str]
    letters: dict[str, int]  # class of each letter told apart
    scripts: dict[str, list[bool]]  # the languages written in each script
    rows: np.ndarray  # row of each trigram in scores; the last row for trigrams never seen
    scores: np.ndarray  # log-likelihoods

    def __post_init__(self) -> None:
        self.space = spaces()
        self.classes = np.zeros(POINTS, dtype=np.int16)
        allowed = np.zeros((CLASSES, len(self.languages)), dtype=bool)
        for i in range(POINTS):
            c = chr(i)
            if c.isalpha():
                known = self.scripts.get(script(c))
                self.classes[i] = FOREIGN if known is None else self.letters.get(c, OTHER)
                if known is not None:
                    allowed[self.classes[i]] |= known
        allowed[0] = True
        self.allowed = allowed
        self.narrows = not allowed[:FOREIGN].all()

    def words(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Scores and letters of each word between white space."""
        parts = []
        at = 0
        while at < len(text):
            end = at + SLICE
            while end < len(text) and not text[end - 1].isspace() and end < at + 2 * SLICE:
                end += 1
            parts.append(self.slice(points(text[at:end])))
            at = end
        if not parts:
            return np.zeros((0, len(self.languages))), np.zeros(0)
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def slice(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        gap = self.space[data]
        starts = np.flatnonzero(~gap & np.r_[True, gap[:-1]])
        if not len(starts):
            return np.zeros((0, len(self.languages))), np.zeros(0)
        classes = self.classes[data]
        classes[gap] = 0
        tri = trigrams(classes)
        has = np.flatnonzero(tri >= 0)
        word = np.searchsorted(starts, has, side="right") - 1
        known = np.bincount(word, minlength=len(starts))
        letters = np.bincount(np.searchsorted(starts, np.flatnonzero(classes), side="right") - 1, minlength=len(starts))
        values = self.scores[self.rows[tri[has]]]
        total = np.stack([np.bincount(word, weights=values[:, j], minlength=len(starts)) for j in range(len(self.languages))], axis=1)
        mean = total * (WEIGHT * np.sqrt(known) / np.maximum(known, 1))[:, None]
        if self.narrows:
            barred = np.stack([np.bincount(word, weights=~self.allowed[classes[has], j], minlength=len(starts)) for j in range(len(self.languages))], axis=1) > 0
            mean = np.where(barred & ~barred.all(axis=1, keepdims=True), -np.inf, mean)
        return np.maximum(mean - mean.max(axis=1, keepdims=True), FLOOR), letters


def viterbi(scores: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The best language of each row when every change costs the penalty; the first of equals.

    If no other language gains more than half the penalty over the one with the largest total in any stretch of rows, no change can pay and the path is constant: a stretch in others costs a change at each end or, over all rows, one fewer than its parts.
    """
    n, k = scores.shape
    top = int(scores.sum(axis=0).argmax())
    sums = np.vstack([np.zeros(k), np.cumsum(scores - scores[:, [top]], axis=0)])
    if (sums - np.minimum.accumulate(sums, axis=0)).max() <= penalty / 2:
        return np.full(n, top)
    best, back = scores[0].tolist(), []
    own = list(range(k))
    for row in scores[1:].tolist():
        most = max(best)
        if min(best) < most - penalty:
            at = best.index(most)
            most -= penalty
            back.append([j if best[j] >= most else at for j in own])
            best = [(b if b > most else most) + s for b, s in zip(best, row, strict=True)]
        else:
            back.append(own)
            best = [b + s for b, s in zip(best, row, strict=True)]
    path = [best.index(max(best))]
    for came in reversed(back):
        path.append(came[path[-1]])
    return np.array(path[::-1])


def label(model: Model, text: str) -> tuple[str, float, str]:
    """(language of most letters, its share of certainty, spans as lang:first word:end word)."""
    scores, sizes = model.words(text) if model.languages else (np.zeros((0, 0)), np.zeros(0))
    if not sizes.sum():
        return ("und", 0.0, "") if not model.languages or not any(map(str.isalpha, text)) else (model.languages[0], 0.0, "")
    path = viterbi(scores)
    letters = np.bincount(path, weights=sizes, minlength=len(model.languages))
    best = int(letters.argmax())
    rival = np.delete(scores, best, axis=1).max(axis=1) if len(model.languages) > 1 else np.full(len(path), FLOOR)
    sure = 1 / (1 + np.exp(rival - scores[:, best]))
    score = float((sizes * (path == best) * sure).sum() / sizes.sum())
    cuts = np.flatnonzero(np.r_[True, path[1:] != path[:-1]])
    ends = np.r_[cuts[1:], len(path)]
    return model.languages[best], min(1.0, max(0.0, score)), ",".join(f"{model.languages[path[s]]}:{s}:{e}" for s, e in zip(cuts, ends, strict=True))


def learn(rows: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", most: int = ROWS) -> Model:
    """A model from labelled rows, at most about `most` of each language, chosen by a hash of the id.

    Letters and trigrams are counted on the executors, each as the root of its count in a text, lest a text that repeats itself outweigh the others; what comes to the driver is bounded by Unicode's letters and the trigrams of the alphabet, for each language. Rows with null text or language are left out; no rows give a model without languages.
    """
    named = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id")).filter("lang IS NOT NULL AND text IS NOT NULL")
    sample = checkpoint(bounded_rows(named, "lang", most, "id").select("lang", "text"))

    def counted(of) -> DataFrame:
        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for lang, texts in batch.groupby("lang")["text"]:
                    each = [np.unique(v[v >= 0], return_counts=True) for v in map(of, map(points, texts))]
                    found, at = np.unique(np.concatenate([e[0] for e in each]), return_inverse=True)
                    n = np.bincount(at, weights=np.concatenate([np.ceil(np.sqrt(e[1])) for e in each]), minlength=len(found))
                    yield pd.DataFrame({"lang": lang, "what": found.astype(np.int64), "n": n.astype(np.int64)})

        return sample.mapInPandas(count, "lang string, what long, n long").groupBy("lang", "what").agg(F.sum("n").alias("n")).toPandas()

    chars = counted(lambda p: p)
    chars = chars[np.array([chr(x).isalpha() for x in chars["what"]], dtype=bool)]
    languages = sorted(chars["lang"].unique())
    at = {x: i for i, x in enumerate(languages)}
    in_all = chars.groupby("what")["n"].sum().reset_index().sort_values(["n", "what"], ascending=[False, True])
    letters = {chr(x): i for i, x in enumerate(in_all["what"][:ALPHABET], 1)}
    written = chars.assign(script=[script(chr(x)) for x in chars["what"]]).groupby(["script", "lang"])["n"].sum()
    size = chars.groupby("lang")["n"].sum()
    scripts: dict[str, list[bool]] = {}
    for (name, lang), n in written.items():
        if n >= SCRIPT_SHARE * size[lang]:
            scripts.setdefault(name, [False] * len(languages))[at[lang]] = True
    empty = Model(languages, letters, scripts, np.zeros(CLASSES**3, dtype=np.int32), np.zeros((1, len(languages))))
    if not languages:
        return empty
    classes = empty.classes
    seen = counted(lambda p: trigrams(classes[p]))
    values = sorted(seen["what"].unique())
    counts = np.zeros((len(values) + 1, len(languages)))
    counts[np.searchsorted(values, seen["what"]), seen["lang"].map(at)] = seen["n"]
    rows_of = np.full(CLASSES**3, len(values), dtype=np.int32)
    rows_of[values] = np.arange(len(values))
    return Model(languages, letters, scripts, rows_of, np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * len(counts))))


def labeller(docs: DataFrame, model: Model):
    """A column function text -> struct(lang_pred, score, spans). The model, bounded by the alphabet, is broadcast."""
    parts = model.languages, model.letters, model.scripts, model.rows, model.scores
    shared, key = docs.sparkSession.sparkContext.broadcast(parts), digest(parts)

    @F.pandas_udf("lang_pred string, score double, spans string")
    def labelled(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = once(key, lambda: Model(*shared.value))
        for batch in texts:
            yield pd.DataFrame([label(own, x) for x in batch], columns=["lang_pred", "score", "spans"])

    return labelled


def identify(docs: DataFrame, known: Column, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", most: int = ROWS) -> DataFrame:
    """One row per row of docs: id, lang_pred, score (0 to 1) and spans, learned from the text and language of the rows where `known` holds.

    lang_pred is `und` for texts that are null or without letters; letters of a script that no learned language uses count for none. Equal scores take the first language by name. Repeated rows stay; other columns are ignored; without labelled rows all is `und`; an empty table gives an empty result.
    """
    named = labeller(docs, learn(docs.filter(known), lang_col, text_col, id_col, most))
    return docs.select(F.col(id_col).alias("_id"), whole(text_col).alias("_text")).select("_id", named("_text").alias("l")).select(F.col("_id").alias(id_col), "l.*")
