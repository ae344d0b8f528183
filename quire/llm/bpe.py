"""Byte-pair token counts by heap and linked list, for a word-level byte-pair vocabulary file of the tokenizers library.

What a word costs depends on the word alone, so every task keeps a bounded table of the words that it has met; only a new one is merged. Lower case and words are Python's where a text has but old Latin letters, on which all versions of Unicode agree; chunks between white space that hold others go through the library's own normaliser and splitter.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import whole

#: Unicode white space as the vocabulary's splitter has it, which leaves out U+001C to U+001F.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
SPACES = re.compile(f"[{SPACE}]+")
#: Code points of an early Unicode, composed ones only, and those beyond.
KNOWN = 0x250
BEYOND = re.compile(f"[^\\x00-{chr(KNOWN - 1)}]")
#: Chunks and words that a task remembers; then it starts anew, so its memory stays bounded.
KEPT = 400_000


def word_pattern() -> re.Pattern:
    """The words of the vocabulary file's splitter (letters; a single digit; an English ending; what is none of these) in lower-case text of known code points."""
    met = sorted({c for i in range(KNOWN) for c in chr(i) + chr(i).lower()})
    kind = lambda k: re.escape("".join(c for c in met if unicodedata.category(c)[0] == k))
    return re.compile(f"[{kind('L')}]+|[{kind('N')}]|'s|'t|'re|'ve|'m|'ll|'d|[^{SPACE}{kind('L')}{kind('N')}]+")


WORD = word_pattern()


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else the next free one from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(free)) for b in range(256)]


LETTERS = dict(enumerate(byte_letters()))


def spelt(word: str) -> str:
    """A word's bytes as letters."""
    return word.encode().decode("latin-1").translate(LETTERS)


class Remembered(dict):
    """A bounded table that computes what it lacks."""

    def __init__(self, compute: Callable, most: int = KEPT):
        super().__init__()
        self.compute, self.most = compute, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.compute(key)
        return value


def special_tokens(vocabulary: str) -> tuple[dict[str, int], re.Pattern | None]:
    """Strings and ids of the special tokens, and a pattern whose split keeps them."""
    found = {x["content"]: x["id"] for x in json.loads(vocabulary)["added_tokens"]}
    return found, re.compile("(" + "|".join(map(re.escape, found)) + ")") if found else None


class Reader:
    """What the words of a text give, in order: `of` for a word, spelt in byte letters, and for a special token `special`."""

    def __init__(self, vocabulary: str, of: Callable, special: Callable):
        from tokenizers import Tokenizer

        library = Tokenizer.from_str(vocabulary)
        normal, cut = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.ids, self.specials = special_tokens(vocabulary)
        self.special = special
        self.words = Remembered(lambda word: of(spelt(word)))
        self.odd = Remembered(lambda chunk: [of(word) for word, _ in cut(normal(chunk))])

    def read(self, text: str) -> Iterable:
        if "<|" in text and self.specials is not None and self.specials.search(text):
            return chain.from_iterable([self.special(self.ids[part])] if part in self.ids else self.plain(part) for part in self.specials.split(text))
        return self.plain(text)

    def plain(self, text: str) -> Iterable:
        if text.isascii() or not BEYOND.search(text):
            return self.old_latin(text)
        return chain.from_iterable(self.odd[chunk] if BEYOND.search(chunk) else self.old_latin(chunk) for chunk in SPACES.split(text))

    def old_latin(self, text: str) -> Iterable:
        return map(self.words.__getitem__, WORD.findall(text.lower()))


class Merger:
    """Counts of one vocabulary."""

    def __init__(self, vocabulary: str):
        file = json.loads(vocabulary)
        ids = file["model"]["vocab"]
        end = file["model"].get("end_of_word_suffix") or ""
        self.inner = {x: ids[x] for x in LETTERS.values()}
        self.last = {x: ids[x + end] for x in LETTERS.values()}
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(file["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[ids[left], ids[right]] = rank, ids[left + right]
        self.reader = Reader(vocabulary, self.word, lambda _: 1)

    def word(self, word: str) -> int:
        """Initial symbols less merges."""
        return self.merge(word)[1]

    def merge(self, word: str) -> tuple[list[int], int]:
        """The symbols of a word after all merges, -1 where one went into the symbol before, and how many are left. The heap holds adjacent pairs by rank, then place; a pair is stale once one side has changed."""
        symbols: list[int] = [*map(self.inner.__getitem__, word[:-1]), self.last[word[-1]]]
        count = size = len(symbols)
        before, after = list(range(-1, size - 1)), list(range(1, size + 1))
        heap = [(*r, i, symbols[i], symbols[i + 1]) for i in range(size - 1) if (r := self.ranks.get((symbols[i], symbols[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, merged, at, left, right = heapq.heappop(heap)
            following = after[at]
            if symbols[at] != left or following >= size or symbols[following] != right:
                continue
            symbols[at], symbols[following] = merged, -1
            count -= 1
            beyond = after[at] = after[following]
            if beyond < size:
                before[beyond] = at
                if r := self.ranks.get((merged, symbols[beyond])):
                    heapq.heappush(heap, (*r, at, merged, symbols[beyond]))
            if (ahead := before[at]) >= 0 and (r := self.ranks.get((symbols[ahead], merged))):
                heapq.heappush(heap, (*r, ahead, symbols[ahead], merged))
        return symbols, count

    def count(self, text: str) -> int:
        """Tokens of a text; a special token's string in it is one token."""
        return sum(self.reader.read(text))


@functools.lru_cache(2)
def merger(vocabulary: str) -> Merger:
    return Merger(vocabulary)


def token_counter(spark, path: str) -> Callable[[Column], Column]:
    """A column function that counts tokens. The vocabulary file is read on the driver and broadcast: its size, some MB, doesn't depend on the data."""
    with open(path, encoding="utf-8") as file:
        shared = spark.sparkContext.broadcast(file.read())

    @F.pandas_udf("long")
    def counted(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = merger(shared.value)
        for batch in texts:
            yield pd.Series([own.count(x) for x in batch], dtype="int64")

    return counted


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """One row per row of docs: its id, n_bytes, n_tokens and over_limit (n_tokens > limit).

    Null texts count as empty: 0 bytes, 0 tokens. Repeated rows and ids stay as they are; other columns are ignored whatever their names; an empty table gives an empty result. Texts of any length are counted whole.
    """
    count = token_counter(docs.sparkSession, path)
    counted = docs.select(F.col(id_col).alias(id_col), whole(text_col).alias("_text")).select(id_col, F.octet_length("_text").cast("long").alias("n_bytes"), count("_text").alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
