"""Prose with paragraphs: its normal form, and markup that is told from comparisons such as a < b."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import nfc

#: HTML's element names, old ones too.
ELEMENTS = frozenset(
    "a abbr acronym address applet area article aside audio b base basefont bdi bdo bgsound big blink blockquote body br button canvas caption center cite code col colgroup command content data datalist dd del details dfn dialog dir div dl dt element em embed fieldset figcaption figure font footer form frame frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html i iframe image img input ins isindex kbd keygen label legend li link listing main map mark marquee math media menu menuitem meta meter multicol nav nextid nobr noembed noframes noscript object ol optgroup option output p param picture plaintext portal pre progress "
    "q rb rp rt rtc ruby s samp script search section select shadow slot small source spacer span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr xmp".split()
)
#: Where markup may begin: a declaration, a closing tag, or a name.
OPENING = re.compile(r"<(?:(?P<declared>[!?])|(?P<closing>/)(?!\s)|(?P<name>(?:[^\W\d_]|[_:])(?:[^\W_]|[_.:-])*))")


def is_markup(text: str) -> bool:
    """Whether an angle bracket opens markup. An unfinished tag counts if it names an element; a finished one unless it could be prose: no element, no attribute, no slash, and letters or digits right before and after it."""
    at = 0
    while m := OPENING.search(text, at):
        if m["declared"]:
            return True
        end = text.find(">", m.start())
        if end < 0:
            return bool(m["name"]) and m["name"].lower() in ELEMENTS
        if m["closing"]:
            return True
        name, rest = m["name"].lower(), text[m.end() : end]
        if name in ELEMENTS or set(name) & {"-", ":"} or set(rest) & set("='\"") or rest.rstrip().endswith("/"):
            return True
        inside_word = m.start() > 0 and text[m.start() - 1].isalnum() and text[end + 1 : end + 2].isalnum()
        if not inside_word:
            return True
        at = end + 1
    return False


def has_prose_markup(text: Column) -> Column:
    @F.pandas_udf("boolean")
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) else is_markup(x) for x in texts], dtype=object)

    return F.when(F.contains(text, F.lit("<")), found(text)).when(text.isNotNull(), False)


def paragraphs(text: Column) -> Column:
    """NFC, single spaces, lines without white space at their ends, one empty line between paragraphs at the most. The Unicode line separator ends a line, the paragraph separator a paragraph."""
    lines = F.replace(F.replace(nfc(text), F.lit("\u2028"), F.lit("\n")), F.lit("\u2029"), F.lit("\n\n"))
    spaced = F.regexp_replace(F.regexp_replace(lines, r"(?U)[^\S\n]+", " "), " ?\n ?", "\n")
    return F.regexp_replace(F.regexp_replace(spaced, "\n{3,}", "\n\n"), r"^[ \n]+|[ \n]+$", "")
