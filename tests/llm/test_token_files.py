import glob
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vacantia.llm import token_files as T
from vacantia.llm import tokens
from vacantia.session import new_work_dir

TEXTS = [
    None, "", " ", "one", "a b", "a  b", "  lead", "trail ", "x\n y\n\nz", "tab\t x", "é ß 日本 🙂",
    "<|endoftext|> a <|endoftext|>", "word " * 300, "Don't we'll I'M", "\n", " \n ", "a \n b", "nb sp   x",
    "12 345 6", "a" * 500,
]


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(tokens.BYTE_BPE)
    tokenizer.encode_special_tokens = True
    return lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids


def test_encoder_equals_the_library(plain):
    encoder = tokens.Encoder(tokens.BYTE_BPE)
    texts = [t or "" for t in TEXTS]
    for _ in range(2):  # the second time from memory
        got = [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)]
        assert got == [plain(t) for t in texts]


def test_runs_are_cut_where_the_pattern_cuts(plain):
    """Parts are cut into runs of letters, of signs and line feeds; each run is encoded once."""
    texts = [
        "x one,two &&x12 (a) don't 'll a'll s's", "x one.\nTwo\n\nthree a\n b.\n", "x a\nb\n", "x ²a é1Ω,жÀ×÷",
        "x éa\u0301b a٣b 日,a ab日", "x <|endoftext|>,a a\r\nb \x00a a\x7f a\x85b", "a b ", "a \n ", "nospace,at,all\nb",
    ]
    encoder = tokens.Encoder(tokens.BYTE_BPE)
    got = [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)]
    assert got == [plain(t) for t in texts]
    # What signs stand around a run does not make it new.
    known, tokenize, asked = set(encoder._recent), encoder._model.tokenize, []
    encoder._model = type("Model", (), {"tokenize": lambda _, w: asked.append(w) or tokenize(w)})()
    assert np.frombuffer(encoder.encode(["x one; (neu one:neu"])[0], "<u4").tolist() == plain(
        "x one; (neu one:neu"
    )
    assert " one" in known and asked == ["neu"]


def test_memory_is_bounded(plain, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    encoder = tokens.Encoder(tokens.BYTE_BPE)
    for n in range(10):
        text = " ".join(f"w{k}" for k in range(n * 30, n * 30 + 40))
        assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == plain(text)
        assert len(encoder._recent) + len(encoder._older) <= 200


def want(docs, plain):
    out, at = [], 0
    for doc_id, text in docs:
        ids = np.array([*plain(text), 0], "<u4")
        out.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_files_hold_all_ids_in_order(spark, plain):
    docs = list(enumerate(TEXTS))
    frame = spark.createDataFrame([(*d, 1) for d in docs[::-1]], "doc_id long, text string, ids int")
    path = new_work_dir(spark, "t")
    T.write_tokens(frame, path)
    rows = T.read_tokens(spark, path)
    got = sorted(tuple(r) for r in T.with_checksums(rows).collect())
    assert got == want(docs, plain)
    some = T.read_tokens(spark, path, 3, 5)
    assert sorted(r.doc_id for r in some.collect()) == [3, 4, 5]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(doc_id,3)" in plan


def test_repeated_rows_and_null_ids(spark, plain):
    docs = [(1, "same"), (1, "same"), (None, "none"), (1, "other"), (0, None)]
    path = new_work_dir(spark, "t")
    T.write_tokens(spark.createDataFrame(docs, "doc_id long, text string"), path)
    rows = sorted(T.with_checksums(T.read_tokens(spark, path)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 0, 1, 1, 1]
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows)])[:-1].tolist()


def test_empty_table(spark):
    path = new_work_dir(spark, "t")
    T.write_tokens(spark.createDataFrame([], "doc_id long, text string"), path)
    assert T.with_checksums(T.read_tokens(spark, path)).count() == 0


def test_layout_of_the_files(spark):
    path = new_work_dir(spark, "t")
    T.write_tokens(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), path)
    files = glob.glob(path.removeprefix("file://") + "/*.parquet")
    meta = [pq.ParquetFile(f).metadata for f in files]
    columns = {m.row_group(0).column(i).path_in_schema: m.row_group(0).column(i)
               for m in meta for i in range(m.num_columns)}
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
    assert any("DICTIONARY" in e for e in columns["ids.list.element"].encodings)
    assert columns["doc_id"].has_column_index and columns["doc_id"].has_offset_index
    spans = sorted(
        tuple(r) for r in spark.read.parquet(path).groupBy("part").agg(F.min("doc_id"), F.max("doc_id")).collect()
    )
    assert all(a[2] < b[1] for a, b in zip(spans, spans[1:], strict=False))


def test_runs_are_written_as_bytes_together():
    """All of a batch's runs at once, each as the library's own cutting writes it."""
    runs = [" hend", "été", " Ωмир", "Ԯ", "zaÿ", " ɏԀ"]
    whole = Tokenizer.from_file(tokens.BYTE_BPE)
    cutting = whole.pre_tokenizer
    want = ["".join(text for text, _ in cutting.pre_tokenize_str(r)) for r in runs]
    assert tokens._as_bytes(whole)(runs) == want and tokens._as_bytes(whole)([]) == []
