"""Token ids as Parquet files: a list column of ids beside the columns that say where each document stands.

Documents are sorted by id over the whole corpus; every file is a range of them, and its rows number themselves. Token ids are dictionary encoded (or delta encoded), as few values are frequent; ids of documents, places and lengths are delta encoded, as they ascend or are short. Row groups and pages have a set size, and Parquet's page index holds the bounds of every page, so a filter on documents or on places reads the pages that it needs, and whoever needs no tokens reads none.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import whole
from quire.llm.packing import encoder

#: Tokens that a task hands on at once, at the least unless its rows end.
BATCH = 1 << 20


@dataclass(frozen=True)
class Layout:
    """How files are written. encoding: of the token ids, "dictionary" or "delta"; bytes before compression."""

    encoding: str = "dictionary"
    row_group_bytes: int = 32 << 20
    page_bytes: int = 128 << 10
    page_rows: int = 1000
    codec: str = "zstd"

    def options(self) -> dict[str, str]:
        if self.encoding not in ("dictionary", "delta"):
            raise ValueError(f"no such encoding: {self.encoding}")
        plain = {f"parquet.enable.dictionary#{name}": "false" for name in ("doc_id", "nth", "start_in_part", "n_tokens")}
        return plain | {
            "parquet.writer.version": "PARQUET_2_0",
            "parquet.enable.dictionary": "true",
            "parquet.enable.dictionary#ids.list.element": str(self.encoding == "dictionary").lower(),
            "parquet.block.size": str(self.row_group_bytes),
            "parquet.page.size": str(self.page_bytes),
            "parquet.page.row.count.limit": str(self.page_rows),
            "compression": self.codec,
        }


def write_tokens(docs: DataFrame, path: str, vocabulary: str, layout: Layout = Layout(), end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> TokenFiles:
    """Encodes every whole text with the vocabulary file, appends end_id, and writes all in ascending order of ids (null first) below path.

    Null and empty texts are the end id alone. Rows that share an id are ordered by a hash of their text; equal rows are written as often as they stand, and a range may part them. Other columns are ignored whatever their names; an empty table gives files without rows. The texts are shuffled once, into ranges.
    """
    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as file:
        shared = spark.sparkContext.broadcast(file.read())
    last = np.array([end_id], dtype="<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(shared.value).ids
        part, nth, start = TaskContext.get().partitionId(), 0, 0

        def made(keys: list, found: list[bytes]) -> pa.RecordBatch:
            nonlocal nth, start
            sizes = np.array([len(x) // 4 for x in found], dtype=np.int64)
            ends = np.cumsum(sizes)
            ids = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(np.frombuffer(b"".join(found), dtype="<i4")))
            n = len(found)
            columns = [keys, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(nth, nth + n)), pa.array(start + ends - sizes), pa.array(sizes), ids]
            nth, start = nth + n, start + int(ends[-1])
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "nth", "start_in_part", "n_tokens", "ids"])

        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            found, size, first = [], 0, 0
            for at, text in enumerate(texts):
                found.append(ids_of(text) + last)
                size += len(found[-1])
                if size >= 4 * BATCH or at == len(texts) - 1:
                    yield made(keys.slice(first, len(found)), found)
                    found, size, first = [], 0, at + 1

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text"))
    order = ["doc_id", F.xxhash64("text"), F.monotonically_increasing_id()]
    placed = rows.repartitionByRange(*order).sortWithinPartitions("doc_id", F.xxhash64("text"))
    made = placed.mapInArrow(encode, f"doc_id {kind}, part int, nth long, start_in_part long, n_tokens long, ids array<int>")
    made.write.options(**layout.options()).parquet(f"{path}/tokens")
    files = TokenFiles(spark, path)
    totals = files.rows("part", "n_tokens").groupBy("part").agg(F.count("*").alias("rows"), F.sum("n_tokens").alias("tokens"))
    # as many rows as there are files
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals.withColumn("start", before).coalesce(1).write.parquet(f"{path}/parts")
    return files


class TokenFiles:
    """Reads what write_tokens wrote."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self, *columns: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/tokens").select(*columns)

    def parts(self) -> DataFrame:
        """One row per file: part, rows, tokens, start (tokens of all files before)."""
        return self.spark.read.parquet(f"{self.path}/parts")

    def _started(self, rows: DataFrame) -> DataFrame:
        starts = F.broadcast(self.parts().select("part", F.col("start").alias("_before")))
        return rows.join(starts, "part").withColumn("start", F.col("_before") + F.col("start_in_part")).drop("_before", "start_in_part")

    def documents(self) -> DataFrame:
        """doc_id, part, nth, n_tokens and start (tokens of all documents before) of every document; no token is read."""
        return self._started(self.rows("doc_id", "part", "nth", "start_in_part", "n_tokens"))

    def tokens(self, where: Column | None = None) -> DataFrame:
        """The documents with their ids; where: a filter on doc_id or n_tokens, which reads only pages that may hold such rows."""
        rows = self.rows("doc_id", "part", "nth", "start_in_part", "n_tokens", "ids")
        return self._started(rows if where is None else rows.filter(where))

    def between(self, first: int, end: int) -> DataFrame:
        """The ids at places first to end - 1 of the whole corpus, by document: doc_id, start (place of the first id given) and ids. Reads the files and pages that hold them."""
        met = self.parts().filter((F.col("start") < end) & (F.col("start") + F.col("tokens") > first))
        bounds = met.agg(F.min_by(F.struct("part", "start"), "part").alias("a"), F.max_by(F.struct("part", "start"), "part").alias("b")).first()
        rows = self.rows("doc_id", "part", "nth", "start_in_part", "n_tokens", "ids")
        if end <= first or bounds["a"] is None:
            rows = rows.filter("part < 0")
        else:
            (a, a_start), (b, b_start) = bounds["a"], bounds["b"]
            rows = rows.filter(F.col("part").between(a, b) & ((F.col("part") < b) | (F.col("start_in_part") < end - b_start)))
            rows = rows.filter((F.col("part") > a) | (F.col("start_in_part") + F.col("n_tokens") > first - a_start))
        rows = self._started(rows)
        skip = F.greatest(F.lit(first) - F.col("start"), F.lit(0)).cast("int")
        take = F.least(F.lit(end) - F.col("start"), F.col("n_tokens")).cast("int") - skip
        return rows.select("doc_id", (F.col("start") + skip).alias("start"), F.slice("ids", skip + 1, take).alias("ids"))


def checksums(files: TokenFiles) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of the ids as little-endian unsigned 32-bit numbers) of every document, all from the ids in the files."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            data, ends = ids.values.to_numpy().astype("<i4", copy=False).tobytes(), ids.offsets.to_numpy()
            view = memoryview(data)
            sums = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            columns = [batch.column("doc_id"), batch.column("part"), batch.column("start_in_part"), pa.array(np.diff(ends).astype(np.int64)), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "start_in_part", "n_tokens", "ids_crc32"])

    rows = files.rows("doc_id", "part", "start_in_part", "ids")
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(summed, f"doc_id {kind}, part int, start_in_part long, n_tokens long, ids_crc32 long")
    return files._started(found).select("doc_id", "start", "n_tokens", "ids_crc32")
