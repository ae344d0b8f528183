"""Readers of source files, and sinks, as Spark jobs over folders of files."""

from __future__ import annotations

import io
import re
import stat
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Limits of an archive that is read at all.
MEMBERS, BYTES = 1024, 128 << 20

ROWS = "edition string, book string, chapter int, verse int, text string, locator string"


def unsafe(archive: zipfile.ZipFile) -> str | None:
    """Why an archive is refused: too many or too large members, repeated, absolute or climbing names, links or encryption."""
    infos = archive.infolist()
    if len(infos) > MEMBERS:
        return "too many members"
    if sum(i.file_size for i in infos) > BYTES:
        return "too large"
    if len({i.filename for i in infos}) < len(infos):
        return "repeated names"
    for i in infos:
        if i.filename.startswith(("/", "\\")) or ".." in re.split(r"[/\\]", i.filename) or ":" in i.filename:
            return "unsafe name"
        if stat.S_ISLNK(i.external_attr >> 16):
            return "link"
        if i.flag_bits & 1:
            return "encrypted"
    return None


def archive_members(spark: SparkSession, path: str, suffix: str = ".json") -> DataFrame:
    """The text members of the ZIP files of a folder."""
    return unzipped(spark.read.format("binaryFile").load(path).select("path", "content"), suffix)


def unzipped(files: DataFrame, suffix: str = ".json", declared: DataFrame | None = None) -> DataFrame:
    """(path, sha256, member, body, fault) of archives (path, content), one archive a row of the scan. One that is unsafe or broken, or whose digest isn't the one declared (path, sha256), is one row with its fault."""

    def unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data, digest, wanted in zip(batch["path"], batch["content"], batch["sha256"], batch["wanted"], strict=True):
                rows = []
                if wanted is not None and wanted != digest:
                    yield pd.DataFrame([(name, digest, None, None, "another digest")], columns=["path", "sha256", "member", "body", "fault"])
                    continue
                try:
                    with zipfile.ZipFile(io.BytesIO(data)) as archive:
                        fault = unsafe(archive)
                        if fault:
                            rows.append((name, digest, None, None, fault))
                        else:
                            rows += [(name, digest, m, archive.read(m).decode(), None) for m in sorted(archive.namelist()) if m.endswith(suffix)]
                except (zipfile.BadZipFile, UnicodeDecodeError) as e:
                    rows = [(name, digest, None, None, type(e).__name__)]
                yield pd.DataFrame(rows, columns=["path", "sha256", "member", "body", "fault"])

    summed = files.withColumn("sha256", F.sha2("content", 256))
    if declared is None:
        summed = summed.withColumn("wanted", F.lit(None).cast("string"))
    else:
        summed = summed.join(declared.select("path", F.coalesce("sha256", F.lit("")).alias("wanted")), "path", "left").withColumn("wanted", F.coalesce("wanted", F.lit("")))
    return summed.select("path", "content", "sha256", "wanted").mapInPandas(unzip, "path string, sha256 string, member string, body string, fault string")


def zipped(members: DataFrame, archive: str, member: str, body: str) -> DataFrame:
    """(path, content): one ZIP for each archive, its members in order and with one fixed time, so that the same members give the same bytes. An archive holds at most MEMBERS members."""

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as out:
            for name, text in sorted(zip(group[member], group[body], strict=True)):
                info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
                info.compress_type = zipfile.ZIP_DEFLATED
                out.writestr(info, text)
        return pd.DataFrame({"path": [group[archive].iloc[0]], "content": [data.getvalue()]})

    return members.groupBy(archive).applyInPandas(pack, "path string, content binary")


def array_bundle(members: DataFrame) -> DataFrame:
    """Passages of members that list chapters: [{c, v: [{n, t}]}]; the member's file name is the book."""
    chapters = F.from_json("body", "array<struct<c: int, v: array<struct<n: int, t: string>>>>")
    rows = members.filter("fault IS NULL AND member NOT LIKE '%index.json'").select("sha256", "member", F.explode(chapters).alias("c")).select("sha256", "member", F.col("c.c").alias("chapter"), F.explode("c.v").alias("v"))
    book = F.regexp_extract("member", r"([^/]+)\.json$", 1)
    return rows.select("sha256", book.alias("book"), "chapter", F.col("v.n").alias("verse"), F.col("v.t").alias("text"), F.concat_ws("#", "member", F.concat_ws(":", "chapter", "v.n")).alias("locator"))


def object_bundle(members: DataFrame) -> DataFrame:
    """Passages of members that map editions to chapters: {editions: {code: {chapters: [{number, verses: [{number, text}]}]}}}."""
    shape = "struct<book: string, editions: map<string, struct<chapters: array<struct<number: int, verses: array<struct<number: int, text: string>>>>>>>"
    parsed = members.filter("fault IS NULL").select("sha256", "member", F.from_json("body", shape).alias("b"))
    editions = parsed.select("sha256", "member", F.col("b.book").alias("book"), F.explode("b.editions").alias("edition", "e")).select("sha256", "member", "book", "edition", F.explode("e.chapters").alias("c"))
    verses = editions.select("sha256", "member", "book", "edition", F.col("c.number").alias("chapter"), F.explode("c.verses").alias("v"))
    return verses.select("sha256", "edition", "book", "chapter", F.col("v.number").alias("verse"), F.col("v.text").alias("text"), F.concat_ws("#", "member", F.concat_ws(":", "chapter", "v.number")).alias("locator"))


def contiguous(passages: DataFrame, keys: list[str], declared: DataFrame | None = None) -> DataFrame:
    """(keys, complete): whether verses, with the declared gaps (keys, verse), are 1 to the largest."""
    all_of = passages.select(*keys, "verse") if declared is None else passages.select(*keys, "verse").unionByName(declared.select(*keys, "verse"))
    return all_of.groupBy(*keys).agg(((F.countDistinct("verse") == F.max("verse")) & (F.min("verse") == 1)).alias("complete"))


def verse_lines(spark: SparkSession, path: str) -> DataFrame:
    return parsed_lines(spark.read.text(path))


def parsed_lines(lines: DataFrame) -> DataFrame:
    """(book, chapter, verse, text, blank) of lines (value) `BOOK 1:2 text`; other lines are left out."""
    line = r"^(\S+)\s+(\d+):(\d+)(?:\s+(.*))?$"
    part = lambda i: F.regexp_extract("value", line, i)
    text = F.trim(F.coalesce(part(4), F.lit("")))
    return lines.filter(F.col("value").rlike(line)).select(part(1).alias("book"), part(2).cast("int").alias("chapter"), part(3).cast("int").alias("verse"), text.alias("text"), (text == "").alias("blank"))


def prose(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, chapter, verse, text) of free prose: a line that is a Roman numeral opens a chapter, a number begins a verse; what stands before the first verse is its chapter's verse 0."""
    from quire.functions.text import roman

    heading = F.col("line").rlike(r"^\s*(CHAPTER\s+)?[IVXLCDM]+\.?\s*$")
    lines = docs.select(key, F.posexplode(F.split(text, r"\n")).alias("at", "line")).filter(F.trim("line") != "")
    numeral = F.when(heading, roman(F.regexp_extract("line", r"([IVXLCDM]+)\.?\s*$", 1)))
    chapters = lines.withColumn("chapter", F.last(numeral, ignorenulls=True).over(Window.partitionBy(key).orderBy("at"))).filter(~heading)
    joined = chapters.groupBy(key, "chapter").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: F.trim(x["line"])), " ").alias("body"))
    pieces = F.regexp_extract_all("body", F.lit(r"((?:^|\s)\d+[.)]?\s|^)((?:(?!\s\d+[.)]?\s).)+)"), F.lit(0))
    marked = joined.select(key, "chapter", F.explode(pieces).alias("p"))
    number = F.regexp_extract("p", r"^\s*(\d+)[.)]?\s", 1)
    return marked.select(key, "chapter", F.when(number == "", 0).otherwise(F.try_to_number(number, F.lit("999999"))).cast("int").alias("verse"), F.trim(F.regexp_replace("p", r"^\s*\d+[.)]?\s", "")).alias("text"))


#: Marks of recensions in prose, and which of them is the one to keep.
MAIN, OTHERS = "E", ("G^g", "G^s", "G^{s1}", "G^{s2}")
HEADING = re.compile(r"^([IVXLC]+)\.\s*(.*)$", re.DOTALL)
MARKER = re.compile(r"(?:^|(?<=\s))(\d{1,3})\.\s+")
DIGITS = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100}


def verses_of(text: str | None, chapters: int) -> list[tuple[int, int, str]]:
    """(chapter, verse, text) of prose in several recensions: blocks between empty lines follow each other through three states.

    A block that is a recension's mark opens it and the next block that isn't indented closes it; what stands in another recension than MAIN is left out. A Roman numeral of 1 to `chapters` opens a chapter. A number and a full stop opens a verse; text before a chapter's first number is its verse 1.
    """
    out: dict[tuple[int, int], list[str]] = {}
    chapter, verse, recension = 0, 0, None
    for raw in re.split(r"\r?\n(?:[ \t]*\r?\n)+", text or ""):
        block = " ".join(raw.split())
        if not block:
            continue
        if block == MAIN or block in OTHERS:
            recension = block
            continue
        if recension and not raw.startswith((" ", "\t")):
            recension = None
        if recension in OTHERS:
            continue
        m = HEADING.match(block)
        number = sum(-DIGITS[a] if DIGITS[a] < DIGITS.get(b, 0) else DIGITS[a] for a, b in zip(m[1], m[1][1:] + " ", strict=True)) if m else 0
        if m and 1 <= number <= chapters:
            chapter, verse, block = number, 0, m[2]
        if not chapter:
            continue
        parts = MARKER.split(block)
        if parts[0].strip():
            verse = verse or 1
            out.setdefault((chapter, verse), []).append(parts[0].strip())
        for n, said in zip(parts[1::2], parts[2::2], strict=True):
            verse = int(n)
            out.setdefault((chapter, verse), []).append(said.strip())
    return [(c, v, " ".join(x for x in said if x)) for (c, v), said in sorted(out.items()) if any(said)]


def recension_verses(docs: DataFrame, key: str, text: str, chapters: int = 150) -> DataFrame:
    """(key, chapter, verse, text) of documents in prose with recensions; each document is one sequence by its meaning."""

    @F.pandas_udf("array<struct<chapter: int, verse: int, text: string>>")
    def read(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"chapter": c, "verse": v, "text": t} for c, v, t in verses_of(x, chapters)] for x in texts])

    return docs.select(key, F.explode(read(text)).alias("v")).select(key, "v.*")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of JSON; those that aren't are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def xml_entries(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)


#: Dialects of lexicon files: the tag of an entry, its schema, and where number, word and meaning stand.
DIALECTS = {
    "attributes": ("entry", "_id string, w string, meaning string", ("_id", "w", "meaning")),
    "nested": ("item", "head struct<number: string, form: string>, gloss string", ("head.number", "head.form", "gloss")),
    "strings": ("word", "_strongs string, _lemma string, _VALUE string", ("_strongs", "_lemma", "_VALUE")),
}


def lexicon(spark: SparkSession, path: str, dialect: str, prefix: str) -> DataFrame:
    """(number, word, meaning) of a lexicon in one of three dialects; entries without a number are left out."""
    tag, schema, (number, word, meaning) = DIALECTS[dialect]
    rows = xml_entries(spark, path, tag, schema)
    return rows.select(lexicon_number(F.col(number), prefix).alias("number"), F.col(word).alias("word"), F.col(meaning).alias("meaning")).filter("number IS NOT NULL")


def catalogue_faults(books: DataFrame) -> DataFrame:
    """(id, code) of a catalogue's books (id, name, order, chapters, verses array of counts) that contradict themselves or each other."""
    own = F.array_compact(F.array(
        F.when(F.coalesce(F.trim("name"), F.lit("")) == "", "name_missing"), F.when(F.coalesce(F.col("chapters"), F.lit(0)) < 1, "no_chapters"),
        F.when(F.size("verses") != F.col("chapters"), "chapters_differ"), F.when(F.exists("verses", lambda n: n < 1), "empty_chapter"),
    ))
    single = books.select("id", F.explode(own).alias("code"))
    repeated = lambda column, code: books.groupBy(column).agg(F.collect_set("id").alias("ids"), F.count("*").alias("n")).filter("n > 1").select(F.explode("ids").alias("id"), F.lit(code).alias("code"))
    return single.unionByName(repeated("id", "id_repeated")).unionByName(repeated("order", "order_repeated"))


def chapter_notes(chapters: DataFrame, excluded: list[int]) -> DataFrame:
    """(work, chapter, anchor, locator, body) of chapters (work, chapter, content array of struct anchor, body): entries at the excluded places of the list are left out; locators number what stands at one anchor."""
    each = chapters.select("work", "chapter", F.posexplode("content").alias("at", "n")).filter(~F.array_contains(F.array(*map(F.lit, excluded or [-1])), F.col("at")))
    place = Window.partitionBy("work", "chapter", "n.anchor").orderBy("at")
    nth, several = F.row_number().over(place), F.count("*").over(Window.partitionBy("work", "chapter", "n.anchor")) > 1
    locator = F.concat_ws("#", F.concat_ws(":", "work", "chapter", "n.anchor"), F.when(several, nth))
    return each.select("work", "chapter", F.col("n.anchor").alias("anchor"), locator.alias("locator"), F.col("n.body").alias("body"))


def table(spark: SparkSession, url: str, name: str, fetch: int = 5000, by: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """A table of another database, fetched in batches; by (column, low, high, parts) it is read in parallel."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, fetchsize=str(fetch), **options)
    if by:
        reader = reader.options(partitionColumn=by[0], lowerBound=str(by[1]), upperBound=str(by[2]), numPartitions=str(by[3]))
    return reader.load()


def tables_there(spark: SparkSession, url: str, names: dict[str, str], listing: str, **options: str) -> dict[str, DataFrame]:
    """The tables of an older database, by name with the schema each has there; one that is absent is empty. `listing` is a query of the names there are (column NAME)."""
    there = {str(r[0]).lower() for r in spark.read.format("jdbc").options(url=url, query=listing, **options).load().collect()}
    return {n: table(spark, url, n, **options) if n.lower() in there else spark.createDataFrame([], schema) for n, schema in names.items()}


def reload(rows: DataFrame, path: str, parts: int | None = None) -> None:
    """Deletes what was there and writes rows anew."""
    (rows.coalesce(parts) if parts else rows).write.mode("overwrite").parquet(path)


def lexicon_number(raw: Column, prefix: str) -> Column:
    """Its number in the form H12: as it is, or the first digits after the prefix; null without digits."""
    digits = F.regexp_extract(raw, r"(\d+)", 1)
    return F.when(raw.rlike(r"^[HG]\d+$"), raw).when(digits != "", F.concat(F.lit(prefix), digits))


def commentary(spark: SparkSession, path: str) -> DataFrame:
    """(work, chapter, first, last, kind, body): introductions of books and chapters, and notes on a verse or a range `N-M`, from nested JSON."""
    note = "struct<type: string, number: string, content: array<string>>"
    shape = f"books array<struct<id: string, introduction: string, chapters: array<struct<number: int, introduction: string, content: array<{note}>>>>>"
    books = spark.read.schema(shape).option("multiLine", True).json(path).select(F.explode("books").alias("b"))
    chapters = books.select(F.col("b.id").alias("work"), F.explode("b.chapters").alias("c"))
    none = F.lit(None).cast("int")
    of = lambda df, chapter, first, last, kind, body: df.select("work", chapter.cast("int").alias("chapter"), first.alias("first"), last.alias("last"), F.lit(kind).alias("kind"), body.alias("body"))
    intros = of(books.select(F.col("b.id").alias("work"), "b.introduction"), none, none, none, "book_intro", F.col("introduction"))
    heads = of(chapters.select("work", "c.number", "c.introduction"), F.col("number"), none, none, "chapter_intro", F.col("introduction"))
    notes = chapters.select("work", "c.number", F.explode("c.content").alias("n")).filter("n.type = 'verse'")
    ends = F.split("n.number", "-")
    verses = of(notes, F.col("number"), F.get(ends, 0).cast("int"), F.coalesce(F.get(ends, 1), F.get(ends, 0)).cast("int"), "note", F.array_join("n.content", "\n"))
    return intros.unionByName(heads).unionByName(verses).filter("body IS NOT NULL AND body <> ''")


def replace_partitions(rows: DataFrame, path: str, *by: str) -> None:
    """Writes rows in place of the partitions they fall into; others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def append_snapshot(rows: DataFrame, path: str, by: str) -> None:
    """Adds rows of new publications; one that is already there is refused."""
    spark = rows.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        there = spark.read.parquet(path).select(by).distinct()
        if rows.select(by).distinct().join(there, by, "left_semi").limit(1).count():
            raise ValueError("publications are only added, never changed")
    rows.write.mode("append").partitionBy(by).parquet(path)


def canonical_json(rows: DataFrame) -> DataFrame:
    """(value): each row as JSON with its columns in order of name, the same for the same row."""
    return rows.select(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}).alias("value"))
