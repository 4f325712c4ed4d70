"""SentencePiece encoding and decoding by a relational lattice.

A text is normalised as the model says (a dummy prefix, spaces as ``▁``) and cut between any two
characters that stand side by side in no piece of the model. No piece reaches across such a cut, so
words are encoded on their own, and each distinct word once:

* its substrings of up to the longest piece's length are exploded and equi-joined to the piece table;
* the matching edges are grouped by word and sorted by score;
* a Spark ``aggregate`` folds them into the cuts that are left.

The model at hand is a BPE one: its scores are merge ranks, and the Viterbi path, the one of the
highest total score, is not what the model stands for (it prefers "t" + "he" to "the"). So the fold
over the lattice follows the model's own rule: of the edges that join two neighbours, the one with the
highest score, the leftmost if equal, takes their cut away, until none is left. Results are those of
the SentencePiece library.

The cuts of a word are the bits of a long. What happens inside an edge while its ends stand does not
depend on what lies outside. So where every piece, encoded alone, comes about by merges of falling
score, its own the lowest, an edge can only come to join two neighbours by merges of a higher score
than its own, and one pass over the sorted edges takes each merge in turn. Words with a piece of which
that is not so (runs of spaces, whose scores are equal) look for the best edge at each merge.

Words longer than MOST_FOLDED characters follow the same rule in a Python task. The ids of the words
then meet the texts again by chunk, a run of rows of one file with about CHUNK_BYTES of text: a chunk
receives each of its words once, in files in the shared folder, and texts are read where they lie. A
table that is not read from Parquet files is written to some first.

A character that no piece covers becomes the pieces of its UTF-8 bytes.

Defined results: a null text is an empty one and has no pieces. Repeated rows are encoded one by one.
Columns other than doc_id and text are passed by. Decoding gives the text back exactly, but for
characters that cannot be told from ``▁``, which come back as spaces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache
from heapq import heappop, heappush
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import regex
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType
from sentencepiece import SentencePieceProcessor

from vacantia.llm.common import gathered, new_work_dir, slices, table, written

MODEL = public_tokenizers.path("piece_bpe_32k.model")
#: The inner cuts of a word of this length are the bits of a long.
MOST_FOLDED = 64
CHUNK_BYTES = 32 << 20
#: Text whose words are grouped and folded in one task.
FOLDED_BYTES = 16 << 20
#: Distinct words, in bytes, that a task holds back.
HELD_BYTES = 8 << 20
BATCH_BYTES = 2_000_000
#: Bytes whose characters are told apart at a time.
WINDOW = 1 << 18
SPACE = "▁"

#: An edge is a long: rank of its score, start, end and id, from the high bits to the low ones.
_RANK, _START, _END = 36, 30, 23


class Model(NamedTuple):
    """Pieces by text, with id and score; bytes by value; of a size the vocabulary bounds."""

    pieces: dict[str, tuple[int, float]]
    bytes_to_id: list[int]
    longest: int


@cache
def load(path: str = MODEL) -> Model:
    sp = SentencePieceProcessor(model_file=path)
    plain = [
        n
        for n in range(sp.get_piece_size())
        if not (sp.is_control(n) or sp.is_unknown(n) or sp.is_byte(n) or sp.is_unused(n))
    ]
    pieces = {sp.id_to_piece(n): (n, sp.get_score(n)) for n in plain}
    if any(regex.search(rf"[^{SPACE}]{SPACE}", p) for p in pieces):
        raise ValueError("a piece reaches across words")
    return Model(
        pieces,
        [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)],
        max(map(len, pieces)),
    )


class _Borders(NamedTuple):
    """Class of every character, and whether no piece has two classes side by side."""

    kind: np.ndarray
    kinds: int
    apart: np.ndarray


@cache
def _borders(path: str) -> _Borders:
    """Characters within no piece of two or more share class 0; a space stands for the mark."""
    longer = [p.replace(SPACE, " ") for p in load(path).pieces if len(p) > 1]
    characters = sorted(set("".join(longer)))
    kind = np.zeros(0x110000, np.uint16)
    kind[[ord(c) for c in characters]] = np.arange(1, len(characters) + 1)
    kinds = len(characters) + 1
    apart = np.ones((kinds, kinds), bool)
    for piece in longer:
        for left, right in pairwise(piece):
            apart[kind[ord(left)], kind[ord(right)]] = False
    return _Borders(kind, kinds, apart.ravel())


def _normalised(texts: pa.Array) -> pa.Array:
    """Texts with the dummy prefix, as bytes; the mark as a space, which is shorter."""
    spaced = pc.replace_substring(texts, SPACE, " ")
    prefix = pc.if_else(pc.equal(spaced, ""), "", " ")
    return pc.binary_join_element_wise(prefix, spaced, "")


def _cut(texts: pa.Array, path: str) -> tuple[pa.StringArray, np.ndarray]:
    """The words of all texts, with a space for the mark, and where each text's words end."""
    whole = _normalised(texts)
    at = np.frombuffer(whole.buffers()[1], np.int32)[whole.offset : whole.offset + len(whole) + 1]
    if at[-1] == at[0]:
        return pa.array([], pa.string()), np.zeros(len(texts), np.int64)
    data = np.frombuffer(whole.buffers()[2], np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    borders, before = _borders(path), 0
    begins = np.zeros(len(data), bool)
    start = 0
    while start < len(data):
        end = min(start + WINDOW, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:  # within a character
            end += 1
        part = data[start:end]
        points = np.frombuffer(part.tobytes().decode().encode("utf-32-le"), np.uint32)
        kind = np.concatenate(([before], borders.kind[points].astype(np.int64)))
        begins[start:end][part & 0xC0 != 0x80] = borders.apart[kind[:-1] * borders.kinds + kind[1:]]
        start, before = end, kind[-1]
    begins[at[:-1][at[:-1] < len(data)]] = True
    starts = np.append(np.flatnonzero(begins), len(data)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), pa.py_buffer(data))
    return words, np.searchsorted(starts, at[1:])


def words_of(text: str, path: str = MODEL) -> list[str]:
    """The words of a text, normalised."""
    words, _ = _cut(pa.array([text], pa.string()), path)
    return pc.replace_substring(words, " ", SPACE).to_pylist()


def _merged(word: str, pieces: dict[str, tuple[int, float]]) -> tuple[list[int], list[float]]:
    """Merges of one word, best first, kept in a heap: where the symbols end, the losses in turn."""
    n = len(word)
    ends = list(range(1, n + 1))  # of the symbol that starts here; 0 once it is part of another
    before = list(range(-1, n - 1))
    heap: list[tuple[float, int, int]] = []
    losses = []

    def offer(start: int) -> None:
        middle = ends[start]
        if middle < n:
            found = pieces.get(word[start : ends[middle]])
            if found:
                heappush(heap, (-found[1], start, ends[middle]))

    for start in range(n):
        offer(start)
    while heap:
        loss, start, end = heappop(heap)
        middle = ends[start]
        if not middle or middle >= n or ends[middle] != end:
            continue
        losses.append(loss)
        ends[start], ends[middle] = end, 0
        if end < n:
            before[end] = start
            offer(start)
        if before[start] >= 0:
            offer(before[start])
    return ends, losses


@cache
def _loose(path: str) -> frozenset[str]:
    """Pieces that, encoded alone, do not come about by merges of rising loss, their own the greatest."""
    pieces, found = load(path).pieces, []
    for piece in pieces:
        ends, losses = _merged(piece, pieces)
        rising = all(a <= b for a, b in pairwise(losses)) and losses[-1:] != losses[-2:-1]
        if ends[0] != len(piece) or (losses and not rising):
            found.append(piece)
    return frozenset(found)


def encode_word(word: str, model: Model) -> list[int]:
    """The ids of one word, by its merges."""
    ends, _ = _merged(word, model.pieces)
    out, at = [], 0
    while at < len(word):
        piece = model.pieces.get(word[at : ends[at]])
        if piece:
            out.append(piece[0])
        else:
            out += [model.bytes_to_id[b] for b in word[at : ends[at]].encode("utf-8", "replace")]
        at = ends[at]
    return out


def _runs(chunks: pa.Array) -> Iterator[tuple[int, slice]]:
    """Each chunk and its rows, as they come."""
    found = chunks.to_numpy()
    starts = [0, *(np.flatnonzero(found[1:] != found[:-1]) + 1).tolist(), len(found)]
    for start, end in pairwise(starts):
        if start < end:
            yield int(found[start]), slice(start, end)


def _distinct(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """chunk, word: of a chunk's words in a task each once, or a few times if they are very many."""
    now, held, size = None, [], 0

    def unified() -> pa.Array:
        return pc.unique(pa.concat_arrays(held)) if held else pa.array([], pa.string())

    def out(chunk: int, words: pa.Array) -> Iterator[pa.RecordBatch]:
        marked = pc.replace_substring(words, " ", SPACE)
        for start in range(0, len(marked), 50_000):
            part = marked.slice(start, 50_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(part), chunk, np.int64)), part], ["chunk", "word"]
            )

    for batch in gathered(batches, "text", BATCH_BYTES):
        for chunk, rows in _runs(batch.column("chunk")):
            if chunk != now and held:
                yield from out(now, unified())
                held, size = [], 0
            words, _ = _cut(batch.column("text")[rows], path)
            found = pc.unique(words)
            now, size = chunk, size + found.nbytes
            held.append(found)
            if size > HELD_BYTES:
                held = [unified()]
                size = held[0].nbytes
                if 4 * size > 3 * HELD_BYTES:
                    yield from out(now, held[0])
                    held, size = [], 0
    if held:
        yield from out(now, unified())
    held = []
    pa.default_memory_pool().release_unused()


def _bit(place: Column) -> Column:
    """The bit of a cut; place 64 falls on the bit of place 0, a cut that always stands."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int"))


def _place(edge: Column, first: int, bits: int) -> Column:
    return F.shiftright(edge, first).bitwiseAND(F.lit((1 << bits) - 1).cast("long")).cast("int")


def _inside(edge: Column) -> Column:
    """The bits of the cuts from an edge's start to before its end."""
    start, end = _place(edge, _START, 6), _place(edge, _END, 7)
    ones = F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), 64 - (end - start))
    return F.call_function("shiftleft", ones, start)


def _joins(edge: Column, cuts: Column) -> Column:
    """Whether an edge joins two neighbours: its ends stand, and one cut between them."""
    ends = _bit(_place(edge, _START, 6)).bitwiseOR(_bit(_place(edge, _END, 7)))
    return (F.bit_count(cuts.bitwiseAND(_inside(edge))) == 2) & (cuts.bitwiseAND(ends) == ends)


def _join(edge: Column, cuts: Column) -> Column:
    return cuts.bitwiseAND(F.bitwise_not(_inside(edge))).bitwiseOR(
        _bit(_place(edge, _START, 6))
    )


def _fold(edges: Column, length: Column, loose: Column) -> Column:
    """The cuts that are left when no edge joins two neighbours; ``edges`` in order of preference."""

    def in_turn(cuts: Column, edge: Column) -> Column:
        return F.when(_joins(edge, cuts), _join(edge, cuts)).otherwise(cuts)

    def best(cuts: Column, _: Column) -> Column:
        first = F.get(F.filter(edges, lambda e: _joins(e, cuts)), F.lit(0))
        return F.coalesce(_join(first, cuts), cuts)

    every = F.lit(-1).cast("long")
    merges = F.sequence(F.lit(1), length)
    return F.when(loose, F.aggregate(merges, every, best)).otherwise(
        F.aggregate(edges, every, in_turn)
    )


def encode_words(spark: SparkSession, words: DataFrame, path: str = MODEL) -> DataFrame:
    """word, ids of every distinct word, and what other columns ``words`` has."""
    model, loose = load(path), _loose(path)
    others = [c for c in words.columns if c != "word"]
    rank = {s: n for n, s in enumerate(sorted({s for _, s in model.pieces.values()}, reverse=True))}
    pieces = spark.createDataFrame(
        [(p, rank[s] << _RANK | n, p in loose) for p, (n, s) in model.pieces.items()],
        "piece string, code long, loose boolean",
    )
    # Of a long word one substring: it keeps its row.
    length = F.length("word")
    folded = F.when(length <= MOST_FOLDED, length).otherwise(1).alias("n")
    starts = words.select("word", *others, folded).select(
        "*", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n") - 1, F.lit(0)))).alias("start")
    )
    last = F.least(F.col("start") + model.longest, F.greatest("n", F.lit(1)))
    spans = starts.select(
        "word",
        "n",
        "start",
        # What goes along with a word goes with its first character.
        *[F.when(F.col("start") == 0, F.col(c)).alias(c) for c in others],
        F.explode(F.sequence(F.col("start") + 1, last)).alias("end"),
    )
    named = spans.withColumn(
        "piece", F.substring(F.col("word"), F.col("start") + 1, F.col("end") - F.col("start"))
    )
    # The piece table is the model's vocabulary: bounded, so every task has it. A word's first
    # character is kept in any case, so that words without a piece are not lost.
    edge = (
        F.col("code")
        .bitwiseOR(F.shiftleft(F.col("start").cast("long"), _START))
        .bitwiseOR(F.shiftleft(F.col("end").cast("long"), _END))
    )
    edges = (
        named.join(F.broadcast(pieces), "piece", "left")
        .where("code IS NOT NULL OR (start = 0 AND end = 1)")
        .select(
            "word",
            *others,
            edge.alias("edge"),
            (F.col("end") - F.col("start") > 1).alias("joins"),
            F.coalesce("loose", F.lit(False)).alias("loose"),
        )
    )
    # Single characters join nothing: only the others are sorted and folded.
    grouped = edges.groupBy("word").agg(
        F.sort_array(F.collect_list(F.when(F.col("joins"), F.col("edge")))).alias("edges"),
        F.collect_list(F.when(~F.col("joins"), F.col("edge"))).alias("singles"),
        F.max("loose").alias("loose"),
        *[F.first(c, ignorenulls=True).alias(c) for c in others],
    )
    lattice = ("word", "edges", "singles", "cuts")
    cuts = _fold(F.col("edges"), F.length("word"), F.col("loose")).alias("cuts")
    paths = grouped.withColumn("cuts", cuts).select(*lattice, *others)

    def to_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Unknown characters become the ids of their bytes."""
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("word"),
                    _ids(*(batch.column(c) for c in lattice), load(path)),
                    *[batch.column(c) for c in others],
                ],
                ["word", "ids", *others],
            )

    schema = StructType().add("word", "string").add("ids", ArrayType(IntegerType()))
    for c in others:
        schema = schema.add(c, words.schema[c].dataType)
    return paths.mapInArrow(to_ids, schema)


def _ids(
    words: pa.Array, edges: pa.ListArray, singles: pa.ListArray, cuts: pa.Array, model: Model
) -> pa.ListArray:
    """The ids of the edges between neighbouring cuts; of characters without one their bytes."""
    cut = cuts.to_numpy().view(np.uint64)
    length = pc.utf8_length(words).to_numpy().astype(np.int64)
    places = np.where(length > MOST_FOLDED, 0, length)
    first = np.concatenate(([0], np.cumsum(places)))
    found = np.full(first[-1], -1, np.int32)
    one = np.uint64(1)
    for lists in (edges, singles):
        edge = lists.flatten().to_numpy()
        row = np.repeat(np.arange(len(words)), pc.list_value_length(lists).to_numpy())
        start, end = edge >> _START & 63, edge >> _END & 127
        bit = one << start.astype(np.uint64)
        ends = bit | one << (end & 63).astype(np.uint64)
        inside = ~np.uint64(0) >> (64 - end + start).astype(np.uint64) << start.astype(np.uint64)
        own = cut[row]
        left = (own & inside == bit) & (own & ends == ends) & (places[row] > 0)
        found[(first[row] + start)[left]] = (edge & (1 << _END) - 1)[left]
    row = np.repeat(np.arange(len(words)), places)
    place = np.arange(len(row)) - first[row]
    stands = (cut[row] >> place.astype(np.uint64) & one).astype(bool)
    known = stands & (found >= 0)
    at = np.concatenate(([0], np.cumsum(known)))[first]
    lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(found[known]))
    unknown = np.concatenate(([0], np.cumsum(stands & ~known)))[first]
    some = np.flatnonzero((np.diff(unknown) > 0) | (length > MOST_FOLDED))
    mended = []
    for n in some.tolist():
        word, ids = words[n].as_py(), []
        if len(word) > MOST_FOLDED:
            mended.append(encode_word(word, model))
            continue
        span = slice(first[n], first[n + 1])
        for character, own, is_start in zip(word, found[span], stands[span], strict=True):
            if own >= 0:
                ids.append(int(own))
            elif is_start:
                ids += [model.bytes_to_id[b] for b in character.encode("utf-8", "replace")]
        mended.append(ids)
    index = np.arange(len(words))
    index[some] = len(words) + np.arange(len(some))
    return pa.concat_arrays([lists, pa.array(mended, lists.type)]).take(pa.array(index))


def _placed(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, int]:
    """doc_id, text and chunk of every row, read where it lies, and about how many chunks there are."""
    place = ("_metadata.file_path", "_metadata.row_index")
    try:
        named = docs.select("doc_id", "text", *place)
    except AnalysisException:
        copy = written(docs.select("doc_id", "text"), new_work_dir(spark, "texts"))
        named = copy.select("doc_id", "text", *place)
    found = named.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    size, rows = found[0] or 0, found[1]
    chunks = size // CHUNK_BYTES + 1
    each = -(-rows // chunks) or 1
    # Two runs of rows of one hash would be one chunk.
    chunk = F.xxhash64("file_path", F.floor(F.col("row_index") / each))
    text = F.coalesce("text", F.lit("")).alias("text")
    return named.select("doc_id", text, chunk.alias("chunk")), size


class _Known:
    """Words and ids of the chunk that was asked for last."""

    def __init__(self, folder: str):
        self._folder = folder
        self._fs, self._path = fs.FileSystem.from_uri(folder)
        self._chunk, self._words, self._ids = None, None, None

    def ids(self, chunk: int, words: pa.Array) -> pa.ListArray:
        """The ids of each of the chunk's words."""
        if self._chunk != chunk:
            parts = fs.FileSelector(f"{self._path}/chunk={chunk}", allow_not_found=True)
            tables = []
            for file in self._fs.get_file_info(parts):
                if file.base_name.startswith("part-"):
                    with self._fs.open_input_file(file.path) as source:
                        tables.append(pq.ParquetFile(source).read(["word", "ids"], use_threads=False))
            if not tables:
                raise ValueError(f"the texts have changed: chunk {chunk} has no words")
            found = pa.concat_tables(tables).combine_chunks()
            self._chunk = chunk
            self._words, self._ids = (found.column(c).chunk(0) for c in ("word", "ids"))
        at = pc.index_in(words, value_set=self._words)
        if at.null_count:
            raise ValueError(f"the texts have changed: a word of chunk {chunk} is not known")
        return self._ids.take(at)


def _with_ids(
    batches: Iterator[pa.RecordBatch], folder: str, path: str
) -> Iterator[pa.RecordBatch]:
    known = _Known(folder)
    for batch in gathered(batches, "text", BATCH_BYTES):
        for chunk, rows in _runs(batch.column("chunk")):
            texts = batch.column("text")[rows]
            words, ends = _cut(texts, path)
            if len(words):
                coded = words.dictionary_encode()
                marked = pc.replace_substring(coded.dictionary, " ", SPACE)
                lists = known.ids(chunk, marked)
                each = pc.list_value_length(lists).to_numpy()[coded.indices.to_numpy()]
                values = lists.take(coded.indices).flatten()
                ends = np.concatenate(([0], np.cumsum(each)))[ends]
            else:
                values = pa.array([], pa.int32())
            offsets = np.concatenate(([0], ends)).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), values)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")[rows], ids, texts], ["doc_id", "ids", "text"]
            )
    del known
    pa.default_memory_pool().release_unused()


def _uri(path: str) -> str:
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


def encode(spark: SparkSession, docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, ids (array of int) and text of every row of ``docs``."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    placed, size = _placed(spark, docs)
    pairs = placed.select("chunk", "text").mapInArrow(
        lambda batches: _distinct(batches, path), "chunk long, word string"
    )
    words = (
        pairs.repartition(int(size // FOLDED_BYTES) + 1, "word")
        .groupBy("word")
        .agg(F.collect_set("chunk").alias("chunks"))
    )
    by_chunk = (
        encode_words(spark, words, path)
        .select(F.explode("chunks").alias("chunk"), "word", "ids")
        .repartition(int(size // CHUNK_BYTES) + 1, "chunk")
    )
    folder = new_work_dir(spark, "words")
    written(by_chunk, folder, "chunk")
    home = _uri(folder)
    return placed.select("doc_id", "text", "chunk").mapInArrow(
        lambda batches: _with_ids(batches, home, path),
        f"doc_id {id_type}, ids array<int>, text string",
    )


def decode_ids(ids: list[int], path: str = MODEL) -> str:
    """The text of a list of ids."""
    texts, of_byte = _decoder(path)
    out = bytearray()
    for n in ids:
        out += bytes((of_byte[n],)) if n in of_byte else texts[n]
    return out.decode("utf-8", "replace").replace(SPACE, " ")[1:]


@cache
def _decoder(path: str) -> tuple[dict[int, bytes], dict[int, int]]:
    model = load(path)
    texts = {n: p.encode() for p, (n, _) in model.pieces.items()}
    return texts, {n: b for b, n in enumerate(model.bytes_to_id)}


@cache
def _as_bytes(path: str) -> pa.BinaryArray:
    """The bytes of each id, the mark as a space; null where an id has none."""
    texts, of_byte = _decoder(path)
    found = {n: t.replace(SPACE.encode(), b" ") for n, t in texts.items()}
    found |= {n: bytes((b,)) for n, b in of_byte.items()}
    return pa.array([found.get(n) for n in range(max(found) + 1)], pa.binary())


def _decodes(ids: pa.ListArray, texts: pa.Array, path: str) -> list[bool]:
    """Whether decoding gives each text: by its bytes, and where these differ by its characters."""
    flat, table = ids.flatten(), _as_bytes(path)
    inside = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(table)))
    parts = table.take(pc.if_else(inside, flat, None))
    ends = np.concatenate(([0], np.cumsum(pc.list_value_length(ids).to_numpy())))
    each = pc.fill_null(pc.binary_length(parts), 0).to_numpy()
    at = np.concatenate(([0], np.cumsum(each)))[ends].astype(np.int32)
    data = pc.binary_join(pa.ListArray.from_arrays([0, len(parts)], pc.fill_null(parts, b"")), b"")
    whole = pa.BinaryArray.from_buffers(
        pa.binary(), len(ids), [None, pa.py_buffer(at), data[0].as_buffer()]
    )
    same = pc.equal(whole, _normalised(texts).cast(pa.binary())).to_pylist()
    for n in [n for n, is_same in enumerate(same) if not is_same or parts.null_count]:
        same[n] = decode_ids(ids[n].as_py(), path) == texts[n].as_py().replace(SPACE, " ")
    return same


def decode(rows: DataFrame, path: str = MODEL) -> DataFrame:
    """``rows`` with ids and text, as doc_id, n_tokens, ids_crc32 and whether decoding gives the text."""
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            ids = part.column("ids")
            sizes = pc.list_value_length(ids).to_numpy().astype(np.int64)
            ends = np.concatenate(([0], np.cumsum(sizes))).tolist()
            values = memoryview(ids.flatten().to_numpy().astype("<u4", copy=False))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(sizes),
                    pa.array([zlib.crc32(values[a:b]) for a, b in pairwise(ends)], pa.int64()),
                    pa.array(_decodes(ids, part.column("text"), path), pa.bool_()),
                ],
                ["doc_id", "n_tokens", "ids_crc32", "decodes"],
            )

    return rows.select("doc_id", "ids", "text").mapInArrow(
        checked, f"doc_id {id_type}, n_tokens long, ids_crc32 long, decodes boolean"
    )


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode(encode(spark, table(spark, sf_dir, "documents")))
