"""Token ids of whole texts, by the tokenizers library.

A byte-level BPE never merges across the pieces its pattern cuts a text into, and a space before a
visible character always starts such a piece. So the parts of a text between single spaces encode on
their own, and a part seen before need not be encoded again: a batch's parts are dictionary-encoded by
Arrow, its distinct ones looked up, and the ids taken back by index.

A new part made of letters and ASCII signs alone is cut on, where the pattern cuts it too: into runs of
letters, runs of signs and single line feeds. The library's model encodes each run of letters that is
not remembered, without searching for the pattern again. Other new parts are joined by line feeds and
encoded in one call; the line feed's id, which stands between them alone, cuts the result. Texts with
runs of spaces or spaces at an end, where that does not hold, are encoded whole.
"""

from __future__ import annotations

import codecs
import gc
import json
import os
import re
from functools import cache
from itertools import chain
from operator import attrgetter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Vocabulary file; it is read where the tasks run.
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 0
#: A Python worker remembers about this many parts and runs, in each of two generations.
REMEMBERED = 400_000

#: Ranges that hold nothing but letters (Latin, Greek, Cyrillic), and visible ASCII but letters and
#: the apostrophe, which the pattern may take together with letters after it.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏΑ-ΡΣ-ώЀ-ҁҊ-ԯ"
_SIGNS = r"!-&(-@\[-`{-~"
_CUTTABLE = rf"\A [{_LETTERS}{_SIGNS}]+(?:\n[{_LETTERS}{_SIGNS}]+)*\z"  # for Arrow
_RUN = re.compile(rf" ?[{_LETTERS}]+| ?[{_SIGNS}]+|\n")


@cache
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def encoder(path: str = BYTE_BPE) -> Encoder:
    """The process's encoder for a vocabulary file; tasks of one Python worker share it."""
    return _encoder(path)


class Encoder:
    """Texts to the bytes of their ids (little-endian unsigned 32-bit), special strings as text."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        self._model = self._tokenizer.model
        self._recent: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._line_feed = self._ids("\n")
        #: One id for a line feed, and no merging of it with a space after it.
        self._cuts = len(self._line_feed) == 4 and self._ids("\n a") == self._line_feed + self._ids(
            " a"
        )
        with open(path, encoding="utf-8") as file:
            steps = json.load(file)
        cutting = steps["pre_tokenizer"] or {}
        #: The pattern is the byte-level one, on texts as they are.
        self._runs = (
            steps["normalizer"] is None
            and cutting.get("type") == "ByteLevel"
            and cutting.get("use_regex", True)
            and not cutting["add_prefix_space"]
        )
        self._as_bytes = _as_bytes(self._tokenizer) if self._runs else None

    def _ids(self, text: str) -> bytes:
        found = self._tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(found, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, without an end."""
        if not texts:
            return []
        # Hundreds of thousands of strings are made and none refers to itself: no search for cycles.
        collects = gc.isenabled()
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            if collects:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        apart = [
            self._cuts and "  " not in t and t[:1] != " " and t[-1:] != " " for t in texts
        ]
        split = pc.split_pattern(
            pa.array([t if a else "" for t, a in zip(texts, apart, strict=True)], pa.string()), " "
        )
        starts = split.offsets.to_numpy()[:-1]
        coded = split.values.dictionary_encode()
        index = coded.indices.to_numpy()
        # A text's first part has no space before it and is no other's.
        firsts = coded.dictionary.take(coded.indices.take(pa.array(starts))).to_pylist()
        times = np.bincount(index, minlength=len(coded.dictionary))
        np.subtract.at(times, index[starts], 1)
        used = np.flatnonzero(times)
        place = np.zeros(len(times), np.int64)
        place[used] = np.arange(len(used))
        index = place[index]
        index[starts] = len(used) + np.arange(len(texts))
        parts = coded.dictionary.take(pa.array(used))
        found = self._remembered(pc.binary_join_element_wise("", parts, " ").to_pylist())
        found += self._plain([f if a else t for t, f, a in zip(texts, firsts, apart, strict=True)])
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        lists = pa.LargeListArray.from_arrays(
            pa.array(np.concatenate(([0], np.cumsum(sizes)))),
            pa.array(np.frombuffer(b"".join(found), "<u4")),
        )
        data = lists.take(pa.array(index)).flatten().to_numpy().tobytes()
        ends = (4 * np.cumsum(np.add.reduceat(sizes[index], starts))).tolist()
        return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _plain(self, texts: list[str]) -> list[bytes]:
        found = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _remembered(self, parts: list[str]) -> list[bytes]:
        """Ids of each part, which has the space before it."""
        if len(self._recent) > REMEMBERED:
            self._recent, self._older = {}, self._recent
        known = self._recent
        found = list(map(known.get, parts))
        missing = [n for n, ids in enumerate(found) if ids is None]
        new = self._not_recent([parts[n] for n in missing])
        if self._runs and new:
            plain = pc.match_substring_regex(pa.array(new, pa.string()), _CUTTABLE).to_pylist()
            cut = [p for p, is_plain in zip(new, plain, strict=True) if is_plain]
            new = [p for p, is_plain in zip(new, plain, strict=True) if not is_plain]
            runs = list(map(_RUN.findall, cut))
            distinct = set(chain.from_iterable(runs)).difference(known)
            self._learn(self._not_recent(list(distinct)))
            get = known.__getitem__
            known.update((p, b"".join(map(get, r))) for p, r in zip(cut, runs) if len(r) > 1)
        self._learn_joined([p for p in new if "\n" not in p and not p.isspace()])
        blank = [p for p in new if "\n" in p or p.isspace()]
        known.update(zip(blank, self._plain(blank), strict=True))
        for n in missing:
            found[n] = known[parts[n]]
        return found

    def _not_recent(self, wanted: list[str]) -> list[str]:
        """Of ``wanted`` what is not remembered from long ago; what is so becomes recent again."""
        ids = list(map(self._older.get, wanted))
        self._recent.update((w, i) for w, i in zip(wanted, ids, strict=True) if i is not None)
        return [w for w, i in zip(wanted, ids, strict=True) if i is None]

    def _learn(self, runs: list[str]) -> None:
        """Runs of letters by the model, all others by the whole tokenizer."""
        letters = [r for r in runs if r[-1].isalpha()]
        written, found, sizes = self._as_bytes(letters), [], []
        for start in range(0, len(written), 500):
            tokens = list(map(self._model.tokenize, written[start : start + 500]))
            found += map(attrgetter("id"), chain.from_iterable(tokens))
            sizes += [4 * len(t) for t in tokens]
        data, ends = np.array(found, "<u4").tobytes(), np.cumsum(sizes, dtype=np.int64).tolist()
        for run, size, end in zip(letters, sizes, ends, strict=True):
            self._recent[run] = data[end - size : end]
        others = [r for r in runs if not r[-1].isalpha()]
        self._recent.update(zip(others, self._plain(others), strict=True))

    def _learn_joined(self, parts: list[str]) -> None:
        known, cut = self._recent, np.frombuffer(self._line_feed, "<u4")[0]
        for start in range(0, len(parts), 2_000):
            group = parts[start : start + 2_000]
            joined = "\n" + "\n".join(group)
            ids = np.array(
                self._tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4"
            )
            places = np.flatnonzero(ids == cut)
            if len(places) != len(group):  # a part whose own ids hold a line feed's
                known.update(zip(group, self._plain(group), strict=True))
                continue
            ends = np.append(places[1:], len(ids)).tolist()
            data = ids.tobytes()
            for part, a, b in zip(group, places.tolist(), ends, strict=True):
                known[part] = data[4 * a + 4 : 4 * b]


def _as_bytes(tokenizer: Tokenizer):
    """A function from runs without line feeds to them as the model writes bytes, told by the tokenizer."""
    visible = {}
    for character in map(chr, range(0x800)):
        written = "".join(text for text, _ in tokenizer.pre_tokenizer.pre_tokenize_str(character))
        visible.update(zip(character.encode(), written, strict=True))
    visible[ord("\n")] = "\n"  # stands between runs
    table = "".join(visible.get(byte, "\ufffe") for byte in range(256))

    def written(runs: list[str]) -> list[str]:
        joined = "\n".join(runs).encode()
        return codecs.charmap_decode(joined, "strict", table)[0].split("\n") if runs else []

    return written
