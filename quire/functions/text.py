"""Text functions as columns; Python only where Spark has no function (normal forms, case folding, name-based ids)."""

from __future__ import annotations

import unicodedata
import uuid
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: English words that carry no meaning in a question.
STOP_WORDS = ("and", "are", "can", "did", "does", "for", "from", "has", "have", "how", "into", "its", "say", "says", "that", "the", "their", "then", "there", "these", "this", "those", "was", "were", "what", "when", "where", "which", "who", "why", "with", "would")
#: What stands in place of text to come.
PLACEHOLDERS = (
    r"(?:(?:awaiting|tbd|placeholder|sample placeholder|text unavailable|no text available|not yet added|to be added)[\s.!?…—-]*|lorem ipsum\b.*)",
    r"(?=.*\bawaiting\b)(?=.*\b(?:source|text|translation|verification|upload|import)\b).+",
    r"(?:text unavailable|no text available)(?:\s+(?:for|from|in)\s+(?:(?:this|the)\s+)?(?:book|chapter|source))?[\s.!?…—-]*",
    r"\[(?=[^\]]*(?:\b(?:source|text|book|chapter|awaiting|unavailable|placeholder|tbd)\b|\bnot(?:(?:-| )yet)?(?:-| )added\b|\bto(?:-| )be(?:-| )added\b))[^\]]+\]",
)
#: Names of URL parameters that carry secrets, whole ones, endings, and what makes a key one.
SECRET_NAMES = ("sig", "key", "auth", "authorization", "bearer", "basicauth", "authheader", "authorizationheader", "sessioncookie")
SECRET_ENDINGS = ("token", "secret", "password", "passwd", "credential", "credentials", "signature")
SECRET_KEYS = ("api", "access", "private", "secret", "signing", "encryption", "session")


def squeeze(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def words(text: Column) -> Column:
    """Its words between white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def tokens(text: Column, shortest: int = 3, most: int = 8) -> Column:
    """The first distinct words of letters and digits, case folded, with an apostrophe inside at the most, that are long enough and no stop words."""
    found = F.filter(F.regexp_extract_all(casefolded(text), F.lit(r"[\p{L}\p{N}]+(?:'[\p{L}\p{N}]+)?"), F.lit(0)), lambda w: F.length(w) >= shortest)
    return F.slice(F.array_distinct(F.array_except(found, F.array(*map(F.lit, STOP_WORDS)))), 1, most)


def excerpt(text: Column, size: int, mark: str = "") -> Column:
    """The first `size` characters, with a mark if something is cut."""
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit(mark))).otherwise(text)


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]+>", "")


def has_markup(text: Column) -> Column:
    """A declaration, or a tag that is closed somewhere after its name; names begin with a letter of any script."""
    return text.rlike("<[!?]") | text.rlike(r"</?[\p{L}_:][^<]*>")


def has_control(text: Column) -> Column:
    return text.rlike(r"\p{Cc}")


def is_placeholder(text: Column) -> Column:
    """Nothing but dots and dashes, or words that stand for text to come."""
    plain = squeeze(text)
    return reduce(lambda a, b: a | b, [plain.rlike(f"(?i)^{p}$") for p in PLACEHOLDERS], plain.rlike(r"^[.\-_ ]*$"))


def reference(book: Column, chapter: Column, verse: Column) -> Column:
    return F.format_string("%s %d:%d", book, chapter, verse)


def parsed_reference(text: Column) -> Column:
    """Struct of book, chapter, first and last verse of `Book 3:16-18` or `Bk. 3.16`; nulls where there is none. A lone verse ends where it starts. Numbers have any number of digits; one that no int holds is null."""
    pattern = r"^\s*([1-3]?\s?[A-Za-z][A-Za-z ]*?)\.?\s+(\d+)[:.](\d+)(?:-(\d+))?\s*$"
    part = lambda i: F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))
    first = part(3).try_cast("int")
    return F.struct(part(1).alias("book"), part(2).try_cast("int").alias("chapter"), first.alias("first"), F.when(part(4).isNull(), first).otherwise(part(4).try_cast("int")).alias("last"))


def canonical_key(label: Column, chapter: Column, verse: Column) -> Column:
    """A key such as first_samuel.1.1: a number before the name in words, spaces as underscores."""
    plain = F.lower(squeeze(label))
    for digit, name in (("1", "first"), ("2", "second"), ("3", "third")):
        plain = F.regexp_replace(plain, rf"^{digit}\s?(?=\p{{L}})", f"{name} ")
    return F.concat_ws(".", F.replace(plain, F.lit(" "), F.lit("_")), chapter.cast("string"), verse.cast("string"))


def mentions(text: Column) -> Column:
    """Distinct names after an @ that no word character precedes."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?:^|[^A-Za-z0-9_])@([A-Za-z0-9_-]{3,50})"), F.lit(1)))


def citations(text: Column) -> Column:
    """Distinct bracketed ids, as [kind:12]."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[([a-z_]+:\d+)\]"), F.lit(1)))


def bare_key(text: Column) -> Column:
    """Letters and digits only, in lower case."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def roman(text: Column) -> Column:
    """Value of a Roman numeral: a digit before a larger one counts against it."""
    digit = lambda c: F.when(c == "I", 1).when(c == "V", 5).when(c == "X", 10).when(c == "L", 50).when(c == "C", 100).when(c == "D", 500).when(c == "M", 1000).otherwise(0)
    values = F.transform(F.filter(F.split(F.upper(text), ""), lambda c: c != ""), digit)
    following = F.concat(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.array(F.lit(0)))
    return F.aggregate(F.zip_with(values, following, lambda a, b: F.when(a < b, -a).otherwise(a)), F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))


def path_segment(text: Column) -> Column:
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


def safe_url(url: Column) -> Column:
    """https, a host, and neither credentials, query nor fragment."""
    return F.coalesce(url.rlike(r"^https://[A-Za-z0-9.-]+(:\d+)?(/[^?#@\s]*)?$"), F.lit(False))


def json_text(value: Column) -> Column:
    """A string as JSON writes it, or null."""
    plain = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    named = {"\n": "n", "\r": "r", "\t": "t", "\b": "b", "\f": "f"}
    escaped = reduce(lambda c, x: F.replace(c, F.lit(x), F.lit("\\" + named.get(x, f"u{ord(x):04x}"))), map(chr, range(32)), plain)
    return F.coalesce(F.concat(F.lit('"'), F.when(value.rlike("[\\x00-\\x1f]"), escaped).otherwise(plain), F.lit('"')), F.lit("null"))


def sequence_checksum(*values: Column) -> Column:
    """SHA-256 of the values as a compact JSON list; strings are quoted, numbers and nulls bare."""
    return F.sha2(F.concat(F.lit("["), F.concat_ws(",", *values), F.lit("]")), 256)


def pattern_hits(text: Column, patterns: list[str]) -> Column:
    """How many of the patterns occur at all."""
    return reduce(lambda a, b: a + b, [F.coalesce(text.rlike(p), F.lit(False)).cast("int") for p in patterns])


def _each(function):
    """A function of one text over columns. A few texts at a time are Python's own; the rest of a batch stays in Arrow."""

    @F.arrow_udf(StringType())
    def mapped(texts: pa.Array) -> pa.Array:
        some = (texts.slice(i, 64).to_pylist() for i in range(0, len(texts), 64))
        return pa.concat_arrays([pa.array([None if x is None else function(x) for x in part], pa.string()) for part in some]) if len(texts) else pa.array([], pa.string())

    return mapped


def _where(text: Column, needed: str, function, otherwise: Column) -> Column:
    """The function of those texts alone that hold a character `needed`; Python isn't handed the others."""
    needs = text.rlike(needed)
    return F.when(needs, _each(function)(F.when(needs, text))).otherwise(otherwise)


def _lower(text: Column) -> Column:
    """Case folded, for characters of Latin-1 but for those below."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


#: Characters beyond those whose compatible form, case folded, is their lower case, but for ß: ASCII and the letters of Latin-1.
_UNLIKE = r"[^\x00-\x7f\u00c0-\u00ff]"


def nfc(text: Column) -> Column:
    """The normal form C; texts without characters from U+0300 on are in it."""
    return _where(text, r"[^\x00-\u02ff]", lambda x: unicodedata.normalize("NFC", x), text)


def folded(text: Column) -> Column:
    """NFKC, case folded, other characters than letters and digits as one space."""
    fold = lambda x: unicodedata.normalize("NFKC", x).casefold()
    return F.trim(F.regexp_replace(_where(text, _UNLIKE, fold, _lower(text)), r"[^\p{L}\p{N}]+", " "))


def casefolded(text: Column) -> Column:
    return _where(text, _UNLIKE, str.casefold, _lower(text))


def secret_parameter(name: Column) -> Column:
    """Whether a URL parameter's name tells of a secret, whatever its case and signs; a `value` at its end is no part of it."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", ""), "(value)+$", "")
    spaced = F.lower(F.regexp_replace(name, "(?<=[a-z0-9])(?=[A-Z])", " "))
    return bare.isin(*SECRET_NAMES) | bare.rlike(f"({'|'.join(SECRET_ENDINGS)})$") | bare.rlike(f"({'|'.join(SECRET_KEYS)})key$") | spaced.rlike(rf"(?<![a-z0-9])({'|'.join(SECRET_KEYS)})[^a-z0-9]+key(?![a-z0-9])")


def secret_url(url: Column) -> Column:
    """Whether a parameter of the query or the fragment tells of a secret."""
    names = lambda part: F.transform(F.split(part, "&"), lambda p: F.element_at(F.split(p, "="), 1))
    query, fragment = F.regexp_extract(url, r"\?([^#]*)", 1), F.regexp_extract(url, "#(.*)$", 1)
    return F.exists(names(query), secret_parameter) | (F.contains(fragment, F.lit("=")) & F.exists(names(fragment), secret_parameter))


def bare_word(word: Column) -> Column:
    """Lower case, without punctuation at its ends."""
    return F.lower(F.regexp_replace(word, r"^\p{Punct}+|\p{Punct}+$", ""))


def capitalised(text: Column, longer: int = 3, most: int = 10) -> Column:
    """The first words that begin with a capital and are longer than so many letters."""
    return F.slice(F.filter(words(text), lambda w: (F.length(w) > longer) & w.rlike(r"^\p{Lu}")), 1, most)


def typed_id(text: Column, kind: str) -> Column:
    """The number of an id such as kind:12, else null."""
    return F.when(text.rlike(rf"^{kind}:\d+$"), F.regexp_extract(text, r":(\d+)$", 1)).try_cast("long")


def entity_tag(*values: Column) -> Column:
    """SHA-256 of the values as one JSON object with its keys in order: the same for the same content."""
    return F.sha2(F.to_json(F.struct(*values), {"ignoreNullFields": "false"}), 256)


def utc(text: Column) -> Column:
    """A time of ISO 8601, one without a zone being of UTC; the epoch if there is none."""
    return F.coalesce(text.try_cast("timestamp"), F.timestamp_seconds(F.lit(0)))


def name_id(kind: str, key: Column, space: uuid.UUID = uuid.NAMESPACE_URL) -> Column:
    """A name-based id (version 5), the same for the same kind and key."""
    return _each(lambda x: str(uuid.uuid5(space, f"{kind}:{x}")))(key)
