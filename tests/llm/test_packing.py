import zlib
from bisect import bisect_left, insort

import numpy as np
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from vacantia.llm import packing as K
from vacantia.llm.tokens import BYTE_BPE


def ids_of(text):
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    tokenizer.encode_special_tokens = True
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


def brute_count(lengths, most):
    """Best-fit decreasing over single pieces."""
    gaps, opened = [], 0
    for length in sorted(lengths, reverse=True):
        at = bisect_left(gaps, length)
        if at == len(gaps):
            opened += 1
            gap = most
        else:
            gap = gaps.pop(at)
        insort(gaps, gap - length)
    return opened


@given(st.lists(st.integers(1, 40), max_size=120))
def test_sweeps_pack_like_single_pieces(lengths):
    counts = {n: lengths.count(n) for n in set(lengths)}
    taken = {}
    placed = {n: 0 for n in counts}
    for length, rank, first, each, offset in K.sweeps(counts, 40).tolist():
        following = [m[1] for m in K.sweeps(counts, 40).tolist() if m[0] == length and m[1] > rank]
        count = min(following, default=counts[length]) - rank
        placed[length] += count
        for nth in range(count):
            taken.setdefault(first + nth // each, []).append((offset + nth % each * length, length))
    assert placed == counts
    for parts in taken.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 40
    assert sorted(taken) == list(range(brute_count(lengths, 40)))


def packed_count(counts, most):
    """Sequences opened; fails if one is filled beyond ``most`` or a piece has no place."""
    filled = {}
    moves = K.sweeps(counts, most).tolist()
    for n, (length, rank, first, each, offset) in enumerate(moves):
        goes_on = n + 1 < len(moves) and moves[n + 1][0] == length
        for nth in range((moves[n + 1][1] if goes_on else counts[length]) - rank):
            sequence = first + nth // each
            assert filled.get(sequence, 0) == offset + nth % each * length
            filled[sequence] = offset + (nth % each + 1) * length
    assert max(filled.values()) <= most
    assert sum(filled.values()) == sum(length * n for length, n in counts.items())
    return len(filled)


def test_a_gap_takes_as_many_pieces_as_it_holds():
    assert packed_count({25: 3, 7: 3, 5: 4}, 40) == 3
    assert packed_count({1248: 6000, 400: 6000, 240: 8000}, 2048) == 6000
    rng = np.random.default_rng(3)
    for _ in range(300):
        lengths = rng.choice(rng.integers(1, 41, 4), rng.integers(1, 200)).tolist()
        counts = {n: lengths.count(n) for n in set(lengths)}
        assert packed_count(counts, 40) == brute_count(lengths, 40), counts


def test_cut():
    assert K.cut(1) == [(0, 1)] and K.cut(2048) == [(0, 2048)]
    assert K.cut(2049) == [(0, 1), (1, 2048)]
    assert K.cut(4100) == [(0, 4), (4, 2048), (2052, 2048)]


def check(rows, docs):
    want = {}
    for doc_id, text in docs:
        ids = ids_of(text)
        for piece, (start, length) in enumerate(K.cut(len(ids))):
            data = np.array(ids[start : start + length], "<u4").tobytes()
            key = (doc_id, piece, start, length, zlib.crc32(data))
            want[key] = want.get(key, 0) + 1
    got, taken = {}, {}
    for r in rows:
        key = (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
        got[key] = got.get(key, 0) + 1
        taken.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert got == want
    for parts in taken.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= K.SEQUENCE
    assert len(taken) == brute_count([k[3] for k, n in want.items() for _ in range(n)], K.SEQUENCE)


def test_pieces_and_places(spark):
    docs = [(1, None), (2, ""), (3, "one two"), (3, "one two"), (None, "x  y <|endoftext|>"),
            (4, "long words here " * 2500), (5, "\n\n a\tb  "), (6, "a" * 3000)]
    frame = spark.createDataFrame([(*d, "z") for d in docs], "doc_id long, text string, piece string")
    check(K.packed_pieces(spark, frame, tokens=False).collect(), docs)
    assert K.packed_pieces(spark, frame.limit(0), tokens=False).count() == 0


def test_whole_table(spark):
    small = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    check(K.op4_best_fit_packing(spark, small).collect(), docs)


def test_sequences_hold_the_documents_tokens(spark):
    docs = [(n, f"text number {n} " * (n * 37 % 300)) for n in range(30)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    placed = K.packed_pieces(spark, frame)
    made = {r.sequence_id: (bytes(r.tokens), r.documents) for r in K.sequences(placed).collect()}
    for r in placed.collect():
        data = made[r.sequence_id][0][4 * r.offset : 4 * (r.offset + r.length)]
        assert data == bytes(r.tokens) and zlib.crc32(data) == r.ids_crc32
        assert (r.doc_id, r.piece, r.offset) in [tuple(d) for d in made[r.sequence_id][1]]
