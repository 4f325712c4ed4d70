"""Removal of byte strings that an earlier document holds, by sorting suffixes deep-shallow.

Every byte covered by a string of SPAN bytes that also starts in a document with a smaller id goes. Such
strings are found in a sorted list of suffixes (cut at SPAN bytes, as nothing beyond them counts), in
buckets so dealt that equal strings are in one bucket:

1. Documents are packed into blocks, a compressed table in the shared folder.
2. The anchor of a string is the place in it whose ANCHOR bytes have the smallest hash, the first of
   several. Equal strings have equal anchors, so equal strings go to one bucket, and neighbouring
   strings with one anchor travel as one piece of text.
3. Blocks first send the hashes of their anchors only. Anchors of one document alone go no further: no
   string around them can be in two. Each block learns which of its anchors are shared, a bit each.
4. Pieces around shared anchors go to their buckets, equal pieces of a block once, with a list of where
   they occur. A passage in a third of all documents is one piece a block.
5. A bucket sorts its suffixes: a multikey quicksort on eight bytes at a time to SHALLOW bytes, then blind
   tries for those that still agree. A trie's spine is its first suffix; each other one is compared with
   the spine once and hangs where it leaves it, by that depth and byte; what hangs at one place is a trie
   below. Neighbours that agree to SPAN bytes are one string, and the smallest id that holds it decides.
6. The stretches found go back to their blocks, which cut them out.

Buckets grow in number with the corpus, and a bucket sorts a bounded number of suffixes at a time.

Defined results: null text is empty, texts shorter than SPAN keep everything. A document's own repeats
stay, and so do those of documents with the same id (repeated rows): none of them is smaller. A null id
is larger than any other. A very long text is a block of its own, and a task needs about 60 bytes of
memory for each byte of a block. What is kept is bytes: a cut may fall inside a character. Columns other
than doc_id and text are passed by. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.llm.common import new_work_dir, table, written

SPAN = 50
ANCHOR = 24
SHALLOW = 32
#: Text of a block, and of all blocks for each bucket.
BLOCK_BYTES = 4 << 20
BUCKET_BYTES = 32 << 20
#: Suffixes sorted at a time.
SORTED = 1 << 18

_PAD = SPAN + 16
_CHUNK = 1 << 16
_NO_ID = np.iinfo(np.int64).max
_M1 = np.uint64(0x9E3779B97F4A7C15)
_M2 = np.uint64(0xC2B2AE3D27D4EB4F)
_M3 = np.uint64(0x165667B19E3779F9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _words_at(buffer: np.ndarray, order: str = "<") -> np.ndarray:
    """The eight bytes from each place on as a number, without a copy."""
    return np.ndarray((len(buffer) - 7,), f"{order}u8", buffer, strides=(1,))


def _anchor_hash(words: np.ndarray, places: np.ndarray | slice) -> np.ndarray:
    if isinstance(places, slice):
        a, b, c = (words[places.start + k : places.stop + k] for k in (0, 8, 16))
    else:
        a, b, c = (words[places + k] for k in (0, 8, 16))
    return _mixed(a * _M1 ^ (b + _M2) * _M3 ^ (c ^ _M3) * _M2)


def _anchors(buffer: np.ndarray, n: int) -> np.ndarray:
    """How far the anchor of the string at each of the first ``n`` places is from the place."""
    words = _words_at(buffer)
    width = SPAN - ANCHOR + 1
    away = np.empty(n, np.uint8)
    low = np.uint64(_CHUNK * 2 - 1)
    for start in range(0, n, _CHUNK):
        end = min(start + _CHUNK, n)
        found = _anchor_hash(words, slice(start, end + width - 1))
        least = (found & ~low) | np.arange(len(found), dtype=np.uint64)
        span = 1
        while span * 2 <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        least = np.minimum(least[: end - start], least[width - span :][: end - start])
        away[start:end] = (least & low).astype(np.int64) - np.arange(end - start)
    return away


class Pieces:
    """Runs of strings of a block that have one anchor: first place, number of strings, anchor, hash."""

    def __init__(self, buffer: np.ndarray, bounds: np.ndarray):
        n = int(bounds[-1])
        self.buffer = buffer
        away = _anchors(buffer, n)
        sizes = np.diff(bounds)
        doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        place = np.arange(n, dtype=np.int32)
        anchor = place + away
        inside = place < (bounds[1:] - SPAN + 1).astype(np.int32)[doc]
        new = inside.copy()
        new[1:] &= (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
        self.start = np.flatnonzero(new)
        numbers = np.cumsum(inside, dtype=np.int32)
        after = np.append(numbers[self.start[1:]] - 1, numbers[-1] if n else 0)
        self.count = after - (numbers[self.start] - 1)
        self.doc = doc[self.start]
        self.away = away[self.start]
        self.hash = _anchor_hash(_words_at(buffer), anchor[self.start])


def _buffer(texts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join([*texts, bytes(_PAD)]), np.uint8)


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """By other bits than those that made the anchor the smallest one."""
    again = _mixed(hashes * _M1) >> np.uint64(32)
    return (again * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _packed(*arrays: np.ndarray) -> bytes:
    """Number arrays, their bytes by significance, compressed."""
    parts = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes = a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes()
        parts += [len(planes).to_bytes(4, "little"), a.dtype.itemsize.to_bytes(1, "little"), planes]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unpacked(data: bytes, *kinds: str) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(data)
    out, at = [], 0
    for kind in kinds:
        size, width = int.from_bytes(data[at : at + 4], "little"), data[at + 4]
        planes = np.frombuffer(data, np.uint8, size, at + 5).reshape(width, -1)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(-1))
        at += 5 + size
    return out


# ----------------------------------------------------------------- blocks

_BLOCKS = "block bigint, n bigint, ids binary, sizes binary, texts binary"


def _packed_blocks(block_bytes: int):
    """Documents in the order they come, about ``block_bytes`` of text to a row."""

    def row(number: int, ids: list[int | None], texts: list[bytes]) -> pa.RecordBatch:
        known = np.array([_NO_ID if i is None else i for i in ids], np.int64)
        null = np.array([i is None for i in ids], np.uint8)
        text = b"".join(texts)
        values = {
            "block": pa.array([number], pa.int64()),
            "n": pa.array([len(text)], pa.int64()),
            "ids": pa.array([_packed(known, null)], pa.binary()),
            "sizes": pa.array([_packed(np.array([len(t) for t in texts], np.int64))], pa.binary()),
            "texts": pa.array([zstandard.ZstdCompressor(level=3).compress(text)], pa.binary()),
        }
        return pa.RecordBatch.from_arrays(list(values.values()), list(values))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, texts, held = [], [], 0
        for batch in batches:
            own = batch.column("text").cast(pa.binary()).to_pylist()
            for i, text in zip(batch.column("doc_id").to_pylist(), own, strict=True):
                text = text or b""
                if ids and held + len(text) > block_bytes:
                    yield row(number, ids, texts)
                    ids, texts, held, number = [], [], 0, number + 1
                ids.append(i)
                texts.append(text)
                held += len(text)
        if ids:
            yield row(number, ids, texts)

    return packed


def _read_block(sizes: bytes, texts: bytes) -> tuple[np.ndarray, np.ndarray]:
    (lengths,) = _unpacked(sizes, "<i8")
    data = zstandard.ZstdDecompressor().decompress(texts)
    return _buffer([data]), np.concatenate(([0], np.cumsum(lengths)))


def _rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names), strict=True)


# ----------------------------------------------------------------- anchors that documents share

_LISTS = "bucket int, block bigint, keys binary"


def _block_keys(pieces: Pieces, buckets: int) -> tuple[np.ndarray, ...]:
    """The distinct anchor keys of a block (bucket, then low half of the hash), in order; their bucket;
    and which key each piece has."""
    bucket = _bucket(pieces.hash, buckets)
    key = (bucket << 32) | (pieces.hash & np.uint64(0xFFFFFFFF)).astype(np.int64)
    keys, of = np.unique(key, return_inverse=True)
    return keys, keys >> 32, of


def _several(of: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Whether a key occurs in documents of several ids."""
    least = np.full(n, _NO_ID)
    most = np.full(n, np.iinfo(np.int64).min)
    np.minimum.at(least, of, ids)
    np.maximum.at(most, of, ids)
    return least != most


def _anchor_lists(buckets: int):
    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, packed_ids, sizes, texts in _rows(batches, "block", "ids", "sizes", "texts"):
            ids, _ = _unpacked(packed_ids, "<i8", "u1")
            pieces = Pieces(*_read_block(sizes, texts))
            if not len(pieces.start):
                continue
            keys, bucket, of = _block_keys(pieces, buckets)
            several = _several(of, ids[pieces.doc], len(keys))
            low = (keys & 0xFFFFFFFF).astype("<u4")
            cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(keys))
            packed = [
                _packed(np.diff(low[a:b], prepend=np.uint32(0)), np.packbits(several[a:b]))
                for a, b in zip(cuts[:-1], cuts[1:], strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(bucket[cuts[:-1]], pa.int32()),
                    pa.array([block] * len(packed), pa.int64()),
                    pa.array(packed, pa.binary()),
                ],
                ["bucket", "block", "keys"],
            )

    return lists


_SHARED = "block bigint, bucket int, kind int, data binary"


def _shared_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each list a bit per key: whether other documents have it, too. Rows come by bucket."""

    def answer(bucket: int, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
        keys, flags, sizes = [], [], []
        for _, data in rows:
            steps, bits = _unpacked(data, "<u4", "u1")
            keys.append(np.cumsum(steps, dtype=np.uint32))
            flags.append(np.unpackbits(bits, count=len(steps)).astype(bool))
            sizes.append(len(steps))
        every, shared = np.concatenate(keys), np.concatenate(flags)
        order = np.argsort(every, kind="stable")
        same = every[order[1:]] == every[order[:-1]]
        shared[order[1:][same]] = True
        shared[order[:-1][same]] = True
        parts = np.split(shared, np.cumsum(sizes)[:-1])
        kept = [(row[0], np.packbits(p).tobytes()) for row, p in zip(rows, parts, strict=True) if p.any()]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in kept], pa.int64()),
                pa.array([bucket] * len(kept), pa.int32()),
                pa.array([0] * len(kept), pa.int32()),
                pa.array([k[1] for k in kept], pa.binary()),
            ],
            ["block", "bucket", "kind", "data"],
        )

    for bucket, rows in _groups(_rows(batches, "bucket", "block", "keys")):
        yield answer(bucket, rows)


def _groups(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Rows that follow each other with one first value, without it."""
    now, held = None, []
    for first, *rest in rows:
        if held and first != now:
            yield now, held
            held = []
        now = first
        held.append(tuple(rest))
    if held:
        yield now, held


# ----------------------------------------------------------------- pieces

_PIECES = "bucket int, block bigint, texts binary, pieces binary, places binary"


def _shared_pieces(buckets: int):
    """Pieces around shared anchors, by bucket; equal ones of a block once. Rows come by block, the bits of
    its anchors before the block itself."""

    def pieces_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("block", "kind", "bucket", "data", "ids", "sizes", "texts")
        for block, rows in _groups(_rows(batches, *names)):
            bits = {bucket: data for kind, bucket, data, *_ in rows if kind == 0}
            if bits:
                _, _, _, ids, sizes, texts = rows[-1]
                found = _sent(block, bits, ids, sizes, texts)
                if found:
                    yield found

    def _sent(block, bits, packed_ids, sizes, texts) -> pa.RecordBatch | None:
        ids, _ = _unpacked(packed_ids, "<i8", "u1")
        buffer, bounds = _read_block(sizes, texts)
        pieces = Pieces(buffer, bounds)
        keys, bucket, of = _block_keys(pieces, buckets)
        shared = np.zeros(len(keys), bool)
        cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(keys))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            data = bits.get(int(bucket[a]))
            if data:
                shared[a:b] = np.unpackbits(np.frombuffer(data, np.uint8), count=b - a)
        chosen = np.flatnonzero(shared[of])
        chosen = chosen[np.argsort(of[chosen], kind="stable")]
        out: list[tuple] = []
        of_bucket = bucket[of[chosen]]
        whole = buffer.tobytes()
        cuts = np.append(np.flatnonzero(np.diff(of_bucket, prepend=-1)), len(chosen))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            own = chosen[a:b]
            starts, counts = pieces.start[own], pieces.count[own]
            numbers: dict[bytes, int] = {}
            ends = (starts + counts + SPAN - 1).tolist()
            which = np.array(
                [
                    numbers.setdefault(whole[i:j], len(numbers))
                    for i, j in zip(starts.tolist(), ends, strict=True)
                ]
            )
            strings, first = list(numbers), np.unique(which, return_index=True)[1]
            order = np.argsort(which, kind="stable")
            docs = pieces.doc[own][order]
            at = (starts[order] - bounds[docs]).astype("<u4")
            out.append(
                (
                    int(of_bucket[a]),
                    zstandard.ZstdCompressor(level=3).compress(b"".join(strings)),
                    _packed(
                        counts[first].astype("u1"),
                        pieces.away[own][first],
                        np.bincount(which, minlength=len(strings)).astype("<u4"),
                    ),
                    _packed(docs.astype("<u4"), at, ids[docs]),
                )
            )
        if not out:
            return None
        return pa.RecordBatch.from_arrays(
            [
                pa.array([o[0] for o in out], pa.int32()),
                pa.array([block] * len(out), pa.int64()),
                *[pa.array([o[n] for o in out], pa.binary()) for n in (1, 2, 3)],
            ],
            ["bucket", "block", "texts", "pieces", "places"],
        )

    return pieces_of


# ----------------------------------------------------------------- sorting

def sorted_strings(buffer: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of ``places`` by the SPAN bytes from each on, and which equal their predecessor in it.

    ``buffer`` goes on for at least SPAN bytes behind every place.
    """
    words = _words_at(buffer, ">")
    n = len(places)
    order = np.argsort(words[places].astype(np.uint64))
    found = words[places[order]]
    new = np.ones(n, bool)
    new[1:] = found[1:] != found[:-1]
    for depth in range(8, SHALLOW, 8):
        slots, group = _tied(new)
        if not len(slots):
            return order, np.zeros(n, bool)
        own = order[slots]
        found = words[places[own] + depth].astype(np.uint64)
        again = np.lexsort((found, group))
        order[slots], found = own[again], found[again]
        differs = np.ones(len(slots), bool)
        differs[1:] = (found[1:] != found[:-1]) | (group[1:] != group[:-1])
        new[slots] = differs
    equal = np.zeros(n, bool)
    slots, group = _tied(new)
    tails = np.ndarray((len(buffer) - SPAN + 1, SPAN - SHALLOW), np.uint8, buffer, SHALLOW, (1, 1))
    while len(slots):
        # One step of all tries: the spine of each is its first suffix.
        own = order[slots]
        tail = tails[places[own]]
        heads = np.flatnonzero(np.diff(group, prepend=-1))
        spine = tail[heads][np.cumsum(np.diff(group, prepend=-1) != 0) - 1]
        apart = tail != spine
        depth = apart.argmax(1)
        at = np.arange(len(own))
        byte, along = tail[at, depth].astype(np.int64), spine[at, depth]
        # Leaving the spine downwards, sooner is smaller; upwards, sooner is larger.
        leaves = np.where(byte < along, depth, 2 * SPAN - depth)
        leaves[~apart.any(1)] = SPAN
        byte[leaves == SPAN] = 0
        again = np.lexsort((byte, leaves, group))
        order[slots], leaves, byte = own[again], leaves[again], byte[again]
        same = np.zeros(len(slots), bool)
        same[1:] = (
            (group[1:] == group[:-1]) & (leaves[1:] == leaves[:-1]) & (byte[1:] == byte[:-1])
        )
        settled = leaves == SPAN
        equal[slots] = same & settled
        new = ~same
        more, group = _tied(new, ~settled)
        slots = slots[more]
    return order, equal


def _tied(new: np.ndarray, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Slots of groups of two or more (``new`` marks a group's first), and their group's number."""
    tied = np.zeros(len(new), bool)
    tied[1:] = ~new[1:]
    tied[:-1] |= ~new[1:]
    if among is not None:
        tied &= among
    slots = np.flatnonzero(tied)
    return slots, np.cumsum(new)[slots]


_SPANS = "block bigint, kind int, data binary"


def _repeated(at_once: int):
    """Where strings start that a document with a smaller id holds, by block. Rows come by bucket."""

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(_rows(batches, "bucket", "block", "texts", "pieces", "places")):
            yield _bucket_repeats(rows, at_once)

    return repeated


def _bucket_repeats(rows: list[tuple], at_once: int = SORTED) -> pa.RecordBatch:
    plain = zstandard.ZstdDecompressor()
    buffer = _buffer([plain.decompress(r[1]) for r in rows])
    pieces = [_unpacked(r[2], "u1", "u1", "<u4") for r in rows]
    places = [_unpacked(r[3], "<u4", "<u4", "<i8") for r in rows]
    counts, away, times = (np.concatenate([p[k] for p in pieces]).astype(np.int64) for k in range(3))
    docs, at, ids = (np.concatenate([p[k] for p in places]) for k in range(3))
    starts = np.concatenate(([0], np.cumsum(counts + SPAN - 1)))[:-1]
    heads = np.concatenate(([0], np.cumsum(times)))
    least = np.minimum.reduceat(ids, heads[:-1])  # of each piece
    first = np.concatenate(([0], np.cumsum(counts)))  # of each piece's strings
    decides = np.empty(first[-1], np.int64)  # the smallest id of each string
    hashes = _anchor_hash(_words_at(buffer), starts + away)
    slices = int(first[-1] // at_once) + 1
    part = (hashes >> np.uint64(8)) % np.uint64(slices)
    for k in range(slices):
        own = np.flatnonzero(part == k)
        if not len(own):
            continue
        inner = _within(counts[own])
        strings = np.repeat(starts[own], counts[own]) + inner
        holders = np.repeat(least[own], counts[own])
        order, equal = sorted_strings(buffer, strings)
        groups = np.flatnonzero(~equal)
        smallest = np.minimum.reduceat(holders[order], groups)
        found = np.empty(len(order), np.int64)
        found[order] = np.repeat(smallest, np.diff(np.append(groups, len(order))))
        decides[np.repeat(first[:-1][own], counts[own]) + inner] = found
    # Every occurrence of every string, and of those that go, stretches of neighbours.
    of = np.repeat(np.arange(len(counts), dtype=np.int32), times)
    ends = np.cumsum(counts[of])
    parts = []
    cuts = np.searchsorted(ends, np.arange(0, ends[-1], at_once), side="right")
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(of)], strict=True):
        number = counts[of[a:b]]
        inner = _within(number)
        which = np.repeat(np.arange(a, b, dtype=np.int32), number)
        gone = decides[np.repeat(first[of[a:b]], number) + inner] < ids[which]
        which, inner = which[gone], inner[gone]
        begins = np.ones(len(inner), bool)
        begins[1:] = (inner[1:] != inner[:-1] + 1) | (which[1:] != which[:-1])
        begins = np.flatnonzero(begins)
        parts.append((which[begins], inner[begins], np.diff(np.append(begins, len(inner)))))
    occurrence, inner, lengths = (np.concatenate(p) for p in zip(*parts, strict=True))
    row = np.repeat(np.arange(len(rows)), [len(p[0]) for p in places])[occurrence]
    cuts = np.searchsorted(row, np.arange(len(rows) + 1))
    out = [
        (
            rows[n][0],
            _packed(
                docs[occurrence[a:b]].astype("<u4"),
                (at[occurrence[a:b]] + inner[a:b]).astype("<u4"),
                lengths[a:b].astype("u1"),
            ),
        )
        for n, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
        if b > a
    ]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([o[0] for o in out], pa.int64()),
            pa.array([0] * len(out), pa.int32()),
            pa.array([o[1] for o in out], pa.binary()),
        ],
        ["block", "kind", "data"],
    )


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each count."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


# ----------------------------------------------------------------- cutting

_KEPT = (
    "doc_id bigint, n_bytes bigint, removed array<struct<start:bigint,length:bigint>>, kept binary"
)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's removed stretches and remaining bytes. Rows come by block, the block itself last."""
    kind = [pa.field("start", pa.int64()), pa.field("length", pa.int64())]
    names = ("block", "kind", "data", "ids", "sizes", "texts")
    for _, rows in _groups(_rows(batches, *names)):
        _, _, packed_ids, sizes, texts = rows[-1]
        ids, null = _unpacked(packed_ids, "<i8", "u1")
        (lengths,) = _unpacked(sizes, "<i8")
        bounds = np.concatenate(([0], np.cumsum(lengths)))
        data = zstandard.ZstdDecompressor().decompress(texts)
        edges = np.zeros(len(data) + 1, np.int32)
        for _, found, *_ in rows[:-1]:
            docs, at, count = _unpacked(found, "<u4", "<u4", "u1")
            start = bounds[docs] + at
            np.add.at(edges, start, 1)
            np.add.at(edges, start + count + SPAN - 1, -1)
        covered = np.cumsum(edges[:-1]) > 0
        kept_before = np.concatenate(([0], np.cumsum(~covered, dtype=np.int32)))
        left = np.frombuffer(data, np.uint8)[~covered].tobytes()
        doc = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        begins = covered.copy()
        begins[1:] &= ~covered[:-1] | (doc[1:] != doc[:-1])
        ends = covered.copy()
        ends[:-1] &= ~covered[1:] | (doc[1:] != doc[:-1])
        begins, ends = np.flatnonzero(begins), np.flatnonzero(ends)
        spans = pa.StructArray.from_arrays(
            [pa.array(begins - bounds[doc[begins]]), pa.array(ends + 1 - begins)], fields=kind
        )
        offsets = np.searchsorted(begins, bounds)
        places = kept_before[bounds].tolist()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64(), mask=null.astype(bool)),
                pa.array(lengths, pa.int64()),
                pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans),
                pa.array([left[a:b] for a, b in zip(places[:-1], places[1:], strict=True)], pa.binary()),
            ],
            ["doc_id", "n_bytes", "removed", "kept"],
        )


def _with_blocks(found: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows about blocks, each block's followed by the block itself."""
    rows = blocks.withColumn("kind", F.lit(1))
    both = found.unionByName(rows.drop("n"), allowMissingColumns=True)
    return both.repartition("block").sortWithinPartitions("block", "kind")


def without_repeats(
    docs: DataFrame, block_bytes: int = BLOCK_BYTES, at_once: int = SORTED
) -> DataFrame:
    """doc_id, n_bytes, removed (start, length), kept (remaining bytes) of each row of ``docs``."""
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    blocks = written(texts.mapInArrow(_packed_blocks(block_bytes), _BLOCKS), new_work_dir(spark, "blocks"))
    size = blocks.agg(F.sum("n")).first()[0] or 0
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(2 * tasks, -(-size // BUCKET_BYTES))
    by_bucket = (
        blocks.select("block", "ids", "sizes", "texts")
        .mapInArrow(_anchor_lists(buckets), _LISTS)
        .repartition("bucket")
        .sortWithinPartitions("bucket")
    )
    shared = by_bucket.mapInArrow(_shared_anchors, _SHARED)
    pieces = (
        _with_blocks(shared, blocks)
        .mapInArrow(_shared_pieces(buckets), _PIECES)
        .repartition("bucket")
        .sortWithinPartitions("bucket")
    )
    found = pieces.mapInArrow(_repeated(at_once), _SPANS)
    return _with_blocks(found, blocks).mapInArrow(_cut, _KEPT)


def op13_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("bigint"), lambda n, r: n + r["length"])
    return found.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("removed").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
