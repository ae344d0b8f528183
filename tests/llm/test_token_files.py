import glob
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quire.llm.token_files import Layout, checksums, write_tokens

WORDS = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, part int, start long, ids string"


@pytest.fixture(scope="module")
def library():
    made = Tokenizer.from_file(WORDS)
    return lambda text: [*made.encode(text or "", add_special_tokens=False).ids, 1]


def brute(rows, library):
    out, start = [], 0
    for key, text in rows:
        ids = library(text)
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def found(files):
    return sorted((tuple(r) for r in checksums(files).select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1])


def test_files_against_the_library(spark, tmp_path, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute([(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect()], library)
    for name, layout in {"a": Layout(), "b": Layout("delta", 1 << 16, 4096, 10, "snappy")}.items():
        assert found(write_tokens(docs.repartition(7), f"{tmp_path}/{name}", WORDS, layout)) == want


def test_nulls_long_texts_repeated_rows_and_other_columns(spark, tmp_path, library):
    rows = [(3, "three"), (None, "no id"), (1, None), (2, ""), (5, "word " * 300_000), (3, "three"), (3, "other"), (4, "Ünï \U0001f600 <|endoftext|> x")]
    files = write_tokens(spark.createDataFrame([(k, t, 9, 9, "x") for k, t in rows], SCHEMA), f"{tmp_path}/t", WORDS)
    got = found(files)
    assert [r[0] for r in got] == [None, 1, 2, 3, 3, 3, 4, 5]
    assert sorted(map(repr, [(r[0], r[2], r[3]) for r in got])) == sorted(repr((b[0], b[2], b[3])) for b in brute(rows, library))
    assert [r[1] for r in got] == list(np.cumsum([0, *[r[2] for r in got[:-1]]]))
    assert found(write_tokens(spark.createDataFrame([], SCHEMA), f"{tmp_path}/empty", WORDS)) == []


def test_many_rows_of_one_id_are_parted(spark, tmp_path, library):
    docs = spark.range(6000).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(F.lit(5)).alias("doc_id"), F.when(F.col("id") % 2 == 0, F.lit("same text here")).otherwise(F.concat(F.lit("text "), F.col("id"))).alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files = write_tokens(docs, f"{tmp_path}/t", WORDS)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert files.parts().agg(F.max("rows")).first()[0] < 3000 and files.parts().agg(F.sum("rows")).first()[0] == 6000
    got = found(files)
    assert [r[0] for r in got] == sorted(r[0] for r in got)
    assert sorted((r[0], r[2], r[3]) for r in got) == sorted((k, len(i), zlib.crc32(np.array(i, dtype="<u4").tobytes())) for k, i in ((r["doc_id"], library(r["text"])) for r in docs.collect()))


def test_encodings_row_groups_and_page_indexes(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").coalesce(1)
    write_tokens(docs, f"{tmp_path}/t", WORDS, Layout(row_group_bytes=1 << 18, page_bytes=16 << 10, page_rows=50))
    write_tokens(docs, f"{tmp_path}/d", WORDS, Layout("delta"))
    kinds, groups = {}, 0
    for path in glob.glob(f"{tmp_path}/t/tokens/*.parquet"):
        meta = pq.ParquetFile(path).metadata
        groups = max(groups, meta.num_row_groups)
        for g in range(meta.num_row_groups):
            for c in range(meta.num_columns):
                chunk = meta.row_group(g).column(c)
                assert chunk.has_offset_index and chunk.has_column_index
                kinds.setdefault(chunk.path_in_schema, set()).update(chunk.encodings)
    assert groups > 1
    assert "RLE_DICTIONARY" in kinds["ids.list.element"]
    assert all("DELTA_BINARY_PACKED" in kinds[c] and "RLE_DICTIONARY" not in kinds[c] for c in ("doc_id", "nth", "start_in_part", "n_tokens"))
    delta = {e for p in glob.glob(f"{tmp_path}/d/tokens/*.parquet") for c in [pq.ParquetFile(p).metadata.row_group(0).column(5)] for e in c.encodings}
    assert "DELTA_BINARY_PACKED" in delta and "RLE_DICTIONARY" not in delta


def test_selective_reads(spark, tmp_path, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    files = write_tokens(docs, f"{tmp_path}/t", WORDS, Layout(page_rows=5))
    every = [i for r in docs.orderBy("doc_id").collect() for i in library(r["text"])]
    assert "ids" not in files.documents()._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1].split("\n")[0]
    some = files.tokens(F.col("doc_id").between(40, 44)).collect()
    assert sorted(r["doc_id"] for r in some) == [40, 41, 42, 43, 44] and all(every[r["start"] : r["start"] + r["n_tokens"]] == list(r["ids"]) for r in some)
    for a, b in ((0, 1), (1000, 9000), (len(every) - 5, len(every) + 100), (0, len(every)), (5, 5), (len(every), len(every) + 1)):
        assert [i for r in files.between(a, b).orderBy("start").collect() for i in r["ids"]] == every[a:b]


def test_layout_is_checked():
    with pytest.raises(ValueError):
        Layout("gzip").options()
