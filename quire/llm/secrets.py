"""Secret scans with corpus-wide ownership frequency.

One pass over the texts finds candidates; their hashes are then counted by distinct repositories and owners. A value that several owners or repositories hold is a copied example; one that stays with few of both is a live-looking credential. Bare copies of random-looking tokens become spans of their own only if the counts say so.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import checkpoint, joined_by_hot_key, stored, whole

#: The base patterns and the shortest secret of each; the order of the kinds breaks ties of place.
KINDS = ("assign", "access", "hex", "token")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
WORDS = ("passw", "secret", "token", "apikey", "api_key")
SHORTEST_ASSIGN, SHORTEST_ACCESS, SHORTEST_HEX = 6, 20, 24
#: A candidate beyond the base: this long, with letters and digits, and random: this many bits a character, or this share of what its length and alphabet allow at the most.
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
DIGIT = re.compile(r"[0-9]")
RANDOM_BITS, RANDOM_SHARE = 3.5, 0.7
#: Alphabets a value may be drawn from, smallest first, and how many characters each has.
ALPHABETS = ((re.compile(r"[0-9a-f]*|[0-9A-F]*"), 16), (re.compile(r"[0-9a-z]*|[0-9A-Z]*"), 36), (re.compile(r"[0-9A-Za-z]*"), 62))

SCAN_SCHEMA = "n_assign long, n_access long, n_hex long, base_sha256 string, base string, found array<struct<kind:int,start:int,stop:int,value:long>>"


def bits(value: str) -> float:
    """Entropy of its characters."""
    n = len(value)
    return -sum(k / n * math.log2(k / n) for k in Counter(value).values()) if n else 0.0


def looks_random(value: str) -> bool:
    """Whether its entropy is near what a value of its length and alphabet can have, or high by itself."""
    size = next((n for pattern, n in ALPHABETS if pattern.fullmatch(value)), 64)
    return bits(value) >= min(RANDOM_BITS, RANDOM_SHARE * math.log2(max(1, min(size, len(value)))))


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, stop, secret) of the base patterns by kind and place; offsets are code points, stop exclusive.

    A run of 24 or more hex digits found directly is what dropping short runs leaves; the other two drop short matches after matching.
    """
    spans = []
    low = text.lower()
    if any(w in low for w in WORDS):
        spans += [(0, m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= SHORTEST_ASSIGN]
    if "AKIA" in text:
        spans += [(1, m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= SHORTEST_ACCESS]
    spans += [(2, m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    return spans


def more_spans(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Random-looking tokens that touch no base span."""
    if not any(len(w) >= 20 and DIGIT.search(w) for w in text.split()):
        return []
    taken = sorted((s, e) for _, s, e, _ in base)
    spans = []
    for m in TOKEN.finditer(text):
        value = m[0]
        if DIGIT.search(value) and value.strip("0123456789+/_=-") and looks_random(value) and not any(s < m.end() and m.start() < e for s, e in taken):
            spans.append((3, m.start(), m.end(), value))
    return spans


def listed(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e, *_ in sorted(spans, key=lambda x: (x[1], x[0])))


def scan(text: str) -> tuple:
    """A row of SCAN_SCHEMA."""
    base = base_spans(text)
    kinds = Counter(x[0] for x in base)
    found = [{"kind": k, "start": s, "stop": e, "value": xxhash.xxh64_intdigest(v.encode()) - (1 << 63)} for k, s, e, v in [*base, *more_spans(text, base)]]
    text_base = listed(base)
    return kinds[0], kinds[1], kinds[2], hashlib.sha256(text_base.encode()).hexdigest(), text_base, found


SCANNED = ["n_assign", "n_access", "n_hex", "base_sha256", "base", "found"]


def scan_of(text: Column) -> Column:
    """Each text's scan, as a struct."""

    @F.pandas_udf(SCAN_SCHEMA)
    def scan_all(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([scan(x) for x in batch], columns=SCANNED)

    return scan_all(text)


def scanned(docs: DataFrame, id_col: str, text_col: str, owner: Column, repository: Column) -> DataFrame:
    """Each row's scan with its owner and repository, and row, a number of its own; checkpointed, so the texts are read once and the numbers stay."""
    source = docs.select(F.col(id_col).alias("_id"), whole(text_col).alias("_text"), owner.alias("owner"), repository.alias("repository"))
    rows = source.select("_id", "owner", "repository", scan_of(F.col("_text")).alias("s")).select("_id", "owner", "repository", "s.*")
    return checkpoint(rows.withColumn("row", F.monotonically_increasing_id()))


def ownership(rows: DataFrame) -> DataFrame:
    """(value, owners, repositories, spans): each task reduces its candidates to distinct owners before they are shuffled, so a value that stands in a third of all rows is a row an owner. A null owner or repository counts as one of its own."""
    each = rows.select("owner", "repository", F.explode("found.value").alias("value")).groupBy("owner", "repository", "value").agg(F.count("*").alias("n"))
    return each.groupBy("value").agg(F.countDistinct(F.struct("owner")).alias("owners"), F.count("*").alias("repositories"), F.sum("n").alias("spans"))


def judged(rows: DataFrame, few: int) -> DataFrame:
    """(row, spans, n_live, n_example) of the rows with candidates. Live-looking: held by at most `few` owners and at most `few` repositories, whatever a base value looks like; an added span, random by the scan, must also be its owner's alone."""
    marked = joined_by_hot_key(rows.select("row", F.explode("found").alias("f")).select("row", "f.*"), checkpoint(ownership(rows)), "value", "spans")
    live = (F.col("owners") <= few) & (F.col("repositories") <= few)
    stays = (F.col("kind") < 3) | (live & (F.col("owners") <= 1))
    span = F.struct("start", "kind", "stop", live.alias("live"))
    return marked.filter(stays).groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("spans"), F.count_if(live).alias("n_live"), F.count_if(~live).alias("n_example"))


def secret_scan(docs: DataFrame, owner_col: str = "source", repository_cols: tuple[str, ...] = ("source", "lang"), few: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end by start, then kind), n_live and n_example, how many spans look live or copied.

    Null texts count as empty and have no spans. Repeated ids and rows stay rows of their own. Null owners are one owner. Texts of any length are scanned whole; other columns are ignored; an empty table gives an empty result.
    """
    rows = scanned(docs, id_col, text_col, F.col(owner_col).cast("string"), F.to_json(F.struct(*repository_cols)))
    kinds = F.array(*map(F.lit, KINDS))
    names = judged(rows, few).select("row", F.array_join(F.transform("spans", lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"], x["stop"])), ",").alias("all"), "n_live", "n_example")
    joined = rows.select("_id", "n_assign", "n_access", "n_hex", "base_sha256", "row").join(names, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return joined.select(F.col("_id").alias(id_col), "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce("all", F.lit("")).alias("spans"), zero("n_live"), zero("n_example"))


def covered(text: str, spans: list, mask: str) -> str:
    """The text with the mask in place of its spans; spans that touch or overlap become one."""
    parts, at = [], 0
    for start, stop in sorted((x["start"], x["stop"]) for x in spans):
        if start > at or not parts:
            parts += [text[at:start], mask]
        at = max(at, stop)
    return "".join(parts) + text[at:]


def redact(docs: DataFrame, owner_col: str = "source", repository_cols: tuple[str, ...] = ("source", "lang"), few: int = 2, id_col: str = "doc_id", text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """docs, all rows and columns, with every live-looking span replaced by the mask; copied examples stay.

    Null texts stay null; repeated rows are redacted alike. The texts are scanned once and stored with what was found; only those with a candidate are then shuffled. Columns of any name are kept; an empty table gives an empty result.
    """

    @F.pandas_udf("string")
    def cover(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if s is None or not len(s) else covered(t, s, mask) for t, s in zip(texts, spans, strict=True)], dtype=object)

    named = [F.col(f"`{c}`") for c in docs.columns]
    source = docs.select(F.struct(*named).alias("doc"), F.col(owner_col).cast("string").alias("owner"), F.to_json(F.struct(*repository_cols)).alias("repository"), scan_of(whole(text_col))["found"].alias("found"))
    table = stored(source.withColumn("row", F.monotonically_increasing_id()))
    some = F.size("found") > 0
    live = judged(table.filter(some).select("owner", "repository", "found", "row"), few).select("row", F.filter("spans", lambda x: x["live"]).alias("spans")).filter(F.size("spans") > 0)
    changed = table.filter(some).select("doc", "row").join(live, "row", "left").withColumn("doc", F.col("doc").withField(f"`{text_col}`", cover(F.col("doc")[text_col], "spans")))
    return table.filter(~some).select("doc.*").unionByName(changed.select("doc.*"))
