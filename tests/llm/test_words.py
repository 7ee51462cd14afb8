"""Two long words that any polynomial hash over 2^64 takes for one, through the operators that tell words apart."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.llm import bagminhash, decontaminate, kneser_ney, rans, threshold
from tidewheel.llm.common import byte_class, utf8, words

ONE = "".join("ab"[k.bit_count() % 2] for k in range(1024))
OTHER = ONE.translate(str.maketrans("ab", "ba"))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("words"))
    held = lambda k: zlib.crc32(str(k).encode()) % 7 == 2
    trained, scored = next(k for k in range(99) if not held(k)), next(k for k in range(99) if held(k))
    spark.createDataFrame([(trained, OTHER, "en", "s"), (scored, ONE, "en", "s")], "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(0, ONE)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, trained, scored


def test_hashes_differ():
    import pyarrow as pa

    h, _ = words(*utf8(pa.array([ONE, OTHER, ONE.upper()])), byte_class("alnum"))
    assert h[0] == h[2] != h[1]


def test_decontamination_tells_them_apart(spark, folder):
    got = {r.doc_id: (r.n_hit, r.n_items) for r in decontaminate.op3_decontaminate(spark, folder[0]).collect()}
    assert got == {folder[1]: (0, 0), folder[2]: (1, 1)}


def test_the_language_model_knows_one(spark, folder):
    got = {r.doc_id: r.n_known for r in kneser_ney.op4_kneser_ney(spark, folder[0]).collect()}
    assert got == {folder[1]: 2, folder[2]: 1}


def test_tokens_are_the_library_s(spark, folder):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(rans.vocabulary_path())
    got = {r.doc_id: r.ids_crc32 for r in rans.op9_rans_tokens(spark, folder[0]).collect()}
    crc = lambda text: zlib.crc32(np.array([*t.encode(text, add_special_tokens=False).ids, rans.END_ID], "<u4").tobytes())
    assert got == {folder[1]: crc(OTHER), folder[2]: crc(ONE)}


def test_near_duplicates_and_search_tell_them_apart(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    assert bagminhash.classes(docs).filter(F.col("class_id") != F.col("doc_id")).count() == 0
    assert [r.doc_id for r in threshold.search(docs, spark.read.parquet(f"{folder[0]}/benchmark.parquet")).collect()] == [folder[2]]
