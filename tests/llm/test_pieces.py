import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from sentencepiece import SentencePieceProcessor

from vacantia.llm import pieces as P

TEXTS = [
    None, "", " ", "a", " a  b ", "one two, three.", "x\ny  \t z", "日本語 テキスト🙂 ", "▁mark", "   lead",
    "trail   ", "a" * 200 + " b", "don't <0x41> <s>", "été Ünïcode", "\n", "12 345",
]


@pytest.fixture(scope="module")
def library():
    sp = SentencePieceProcessor(model_file=P.MODEL)
    return lambda text: sp.encode(text or "")


def test_words_by_merges_equal_the_library(library):
    model = P.load()
    for text in TEXTS:
        got = [i for w in P.words_of(text or "") for i in P.encode_word(w, model)]
        assert got == library(text), text


def test_lattice_equals_the_library(spark, library):
    docs = list(enumerate(TEXTS)) + [(1, "again and again"), (1, "again and again"), (None, "no id")]
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, ids int")
    got = P.encode(spark, frame).collect()
    key = lambda r: (str(r[0]), r[1])
    assert sorted(((r.doc_id, list(r.ids)) for r in got), key=key) == sorted(
        ((d, library(t)) for d, t in docs), key=key
    )
    assert P.encode(spark, frame.limit(0)).count() == 0


def test_fold_without_the_python_task(spark, monkeypatch):
    """Every word up to MOST_FOLDED characters goes through the relational lattice."""
    words = ["▁the", "▁" + "ab" * 30, "▁▁▁▁x", "▁日本", "▁", "▁internationalization", "▁" + "e" * 63]
    frame = spark.createDataFrame([(w,) for w in words], "word string")
    monkeypatch.setattr(P, "encode_word", None)
    got = {r.word: list(r.ids) for r in P.encode_words(spark, frame).collect()}
    monkeypatch.undo()
    assert got == {w: P.encode_word(w, P.load()) for w in words}


def test_decoding_gives_the_text_back(library):
    for text in TEXTS:
        assert P.decode_ids(library(text)) == (text or "").replace("▁", " ")


def test_whole_table(spark, library):
    small = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    got = {r.doc_id: r for r in P.op7_sentencepiece(spark, small).collect()}
    assert len(got) == len(docs)
    for d in docs:
        ids = library(d.text)
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert r.decodes


def test_words_end_where_no_piece_goes_on(library):
    """Line ends and signs make no new words of the ones beside them."""
    assert P.words_of("it.\nAnd") == [P.SPACE + "it", ".", "\n", "And"]
    assert P.words_of("日本 a") == [P.SPACE, "日", "本", P.SPACE + "a"]
    # Windows end within characters of several bytes, texts within windows.
    text = "aé日🙂 " * 60_000
    words, ends = P._cut(pa.array([text, "", text[3:]]), P.MODEL)
    parts = np.split(np.array(words.to_pylist(), object), ends[:-1])
    assert ["".join(p).replace(" ", P.SPACE) for p in parts] == [
        "".join(P.words_of(t)) for t in (text, "", text[3:])
    ]
    assert "".join(P.words_of(text)) == P.SPACE + text.replace(" ", P.SPACE)


def test_texts_stay_where_they_lie(spark, tmp_path, library, monkeypatch):
    """Texts of a file are neither shuffled nor written, rows of several chunks find their words."""
    monkeypatch.setattr(P, "CHUNK_BYTES", 2_000)
    draw = random.Random(7)
    letters = ["the", "tion", "es", " ", "\n", "é", "日", "."]
    rows = [(n % 250, "".join(draw.choices(letters, k=40))) for n in range(300)]
    rows += [(None, "x" * 5_000), (1, None), (1, "")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(
        str(tmp_path / "docs")
    )
    found = P.encode(spark, spark.read.parquet(str(tmp_path / "docs")))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    got = sorted(((r.text, str(r.doc_id), list(r.ids)) for r in found.collect()))
    assert got == sorted((t or "", str(d), library(t)) for d, t in rows)


def test_one_pass_takes_the_merges_the_library_takes(spark, library):
    """All pieces, pieces side by side, runs of one character, runs of spaces with a word after them."""
    draw = random.Random(3)
    pieces = [p for p in P.load().pieces if P.SPACE not in p]
    words = {P.SPACE + p for p in pieces}
    words |= {P.SPACE + "".join(draw.choices(pieces, k=draw.randint(2, 6))) for _ in range(4_000)}
    words |= {P.SPACE * n + w for n in range(2, 40) for w in ("", "the", "a", "日")}
    words |= {P.SPACE + c * n for c in "aeol=-" for n in range(60, 67)}
    frame = spark.createDataFrame([(w,) for w in words], "word string")
    got = {r.word: list(r.ids) for r in P.encode_words(spark, frame).collect()}
    assert got == {w: library(w[1:].replace(P.SPACE, " ")) for w in words}


def test_only_runs_of_spaces_look_for_the_best_edge():
    """Every other piece, encoded alone, comes about by merges of falling score."""
    assert P._loose(P.MODEL) == {p for p in P.load().pieces if len(p) > 2 and not p.strip(P.SPACE)}


def test_words_of_a_chunk_come_once_or_are_let_go(monkeypatch):
    ends = ["the", "tion", "es", "er", "on", "ing", "re", "an", "or", "ti"]
    texts = [" ".join(e + ends[k % 10] + f for e in ends for f in ends) for k in range(200)]
    batch = pa.record_batch(
        {"chunk": pa.array([1] * 150 + [-2] * 50, pa.int64()), "text": pa.array(texts)}
    )
    wanted = {(c, w) for c, t in zip([1] * 150 + [-2] * 50, texts) for w in P.words_of(t)}
    rows = [tuple(r.values()) for b in P._distinct(iter([batch]), P.MODEL) for r in b.to_pylist()]
    assert sorted(rows) == sorted(wanted)
    monkeypatch.setattr(P, "HELD_BYTES", 100)
    monkeypatch.setattr(P, "BATCH_BYTES", 1_000)
    rows = [tuple(r.values()) for b in P._distinct(iter([batch]), P.MODEL) for r in b.to_pylist()]
    assert set(rows) == wanted and len(rows) > len(wanted)


def test_decoding_tells_other_texts_and_unknown_ids(spark, library):
    rows = [("a b", library("a b")), ("a c", library("a b")), ("", []), ("▁é日", library("▁é日"))]
    rows += [("x", []), (" ", library(" ")), ("\ufffd", [P.load().bytes_to_id[0xFF]])]
    ids = pa.array([r[1] for r in rows], pa.list_(pa.int32()))
    texts = pa.array([r[0] for r in rows])
    wanted = [P.decode_ids(i) == t.replace("▁", " ") for t, i in rows]
    assert P._decodes(ids, texts, P.MODEL) == wanted
    # Batches may be parts of others.
    assert P._decodes(ids[1:5], texts[1:5], P.MODEL) == wanted[1:5]
    with pytest.raises(KeyError):
        P._decodes(pa.array([[-1], [5_000_000]], ids.type), texts[:2], P.MODEL)
