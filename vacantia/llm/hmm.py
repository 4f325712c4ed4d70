"""Language-model scoring with a hidden Markov model.

Tokens are words (A-Z in lower case) and one end per text. Word counts cover all training documents.
The OWN most frequent words are symbols of their own, so is the end; other words share a symbol by
length and kind, and a word's probability within its class comes from the counts. States are trained
by Baum-Welch: each iteration runs scaled forward and backward recursions over every training document
in its partition and sums expected counts across partitions. The score of a text is the exact
likelihood of its symbols by scaled forward recursion, times each shared word's probability within
its class, in log10.

Documents are encoded once, into a table in the shared folder: symbols as small integers, and the
words outside the FREQUENT ones, which alone are joined with the counts. What reaches the driver has a
fixed bound: the FREQUENT words, the totals per class, and the parameters.

Defined results: a null or empty text is its end alone. With no training documents every count is 0
and the states stay as they begin. Training cuts sequences into segments of SEGMENT tokens, so that
memory is bounded; scoring does not. Repeated rows are scored one by one. A null doc_id has the fold
of an empty text. Columns other than doc_id and text are passed by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.llm.common import crc_fold, gathered, new_work_dir, slices, table, written

OWN = 1_000
FREQUENT = 50_000
STATES = 8
ITERATIONS = 5
SEGMENT = 2_048
#: Added to expected counts, so that no transition or symbol becomes impossible.
PRIOR = 0.05
#: Bytes of text whose words are looked up together, each distinct one once.
TOGETHER = 8_000_000
#: Padded tokens of sequences that are run side by side.
SIDE_BY_SIDE = 300_000

END = ""
_LONGEST = 12
CLASSES = _LONGEST * 3
SYMBOLS = OWN + 1 + CLASSES


def word_class(word: str) -> int:
    """By length, and whether a word is all letters, has a digit, or neither."""
    kind = 0 if word.isalpha() else 1 if any(map(str.isdigit, word)) else 2
    return (min(len(word), _LONGEST) - 1) * 3 + kind


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Text and place among the distinct words of every word, in order; and the distinct words.

    A-Z in lower case, split at ASCII white space only.
    """
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    coded = split.flatten().dictionary_encode()
    text = np.repeat(np.arange(len(split)), split.value_lengths().to_numpy(zero_copy_only=False))
    place = coded.indices.to_numpy()
    # White space at an end of a text leaves an empty word there.
    empty = pc.index(coded.dictionary, "").as_py()
    if empty >= 0:
        kept = place != empty
        text, place = text[kept], place[kept]
    return text, place, coded.dictionary


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, class, n for each few megabytes of texts; the end's class is -1."""
    for part in gathered(batches, "text", TOGETHER):
        _, place, distinct = _words(part.column("text"))
        times = np.bincount(place, minlength=len(distinct))
        there = np.flatnonzero(times)
        found = distinct.take(pa.array(there)).to_pylist()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([*found, END]),
                pa.array([*map(word_class, found), -1], pa.int32()),
                pa.array(np.append(times[there], part.num_rows), pa.int64()),
            ],
            ["word", "class", "n"],
        )


class Lexicon:
    """Counts as the tasks need them; its size does not depend on the corpus."""

    def __init__(self, frequent: list[tuple[str, int]], ends: int, total: int, distinct: int,
                 by_class: dict[int, tuple[int, int]]):
        self.total, self.distinct = total, distinct
        self.ends = ends
        own = dict(frequent[:OWN])
        for word, n in own.items():
            tokens, kinds = by_class[word_class(word)]
            by_class[word_class(word)] = tokens - n, kinds - 1
        self.by_class = [by_class.get(c, (0, 0)) for c in range(CLASSES)]
        #: word to symbol, base log10, log10 within its class (0 for own symbols)
        self.known: dict[str, tuple[int, float, float]] = {}
        for rank, (word, n) in enumerate(frequent):
            if rank < OWN:
                self.known[word] = rank, self.base(n), 0.0
            else:
                kind = word_class(word)
                self.known[word] = OWN + 1 + kind, self.base(n), self.within(n, kind)

    def base(self, n: int) -> float:
        return float(np.log10((n + 0.5) / (self.total + 0.5 * (self.distinct + 1))))

    def within(self, n: int, kind: int) -> float:
        tokens, kinds = self.by_class[kind]
        return float(np.log10((n + 0.5) / (tokens + 0.5 * (kinds + 1))))


def learn_counts(spark: SparkSession, docs: DataFrame, learn: Column) -> tuple[DataFrame, Lexicon]:
    """word, n over all training documents, as a table; and the bounded part of it."""
    counts = written(
        docs.where(learn)
        .select(F.coalesce("text", F.lit("")).alias("text"))
        .mapInArrow(_counted, "word string, class int, n long")
        .groupBy("word", "class")
        .agg(F.sum("n").alias("n")),
        new_work_dir(spark, "counts"),
    )
    totals = counts.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect()
    # Written first: the tasks' shares meet in a task, and the driver gets FREQUENT rows.
    most = counts.where(F.col("word") != END).orderBy(F.desc("n"), "word").limit(FREQUENT)
    top = written(most.select("word", "n"), new_work_dir(spark, "frequent")).collect()
    top.sort(key=lambda r: (-r["n"], r["word"]))
    by_class = {r["class"]: (r["n"], r["kinds"]) for r in totals}
    lexicon = Lexicon(
        [(r["word"], r["n"]) for r in top],
        by_class.get(-1, (0, 0))[0],
        sum(n for n, _ in by_class.values()),
        sum(kinds for _, kinds in by_class.values()),
        by_class,
    )
    return counts.select("word", "n"), lexicon


_ENCODED = (
    "n_tokens long, n_known long, base double, within double, symbols binary, "
    "rare array<struct<word:string,class:int,times:int>>"
)


def encode(docs: DataFrame, held_out: Column, lexicon: Lexicon) -> DataFrame:
    """row, doc_id, held_out and _ENCODED: a text as symbols, and its words outside the lexicon."""
    known, end = lexicon.known, (OWN, lexicon.base(lexicon.ends))
    seen_ends = int(lexicon.ends > 0)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in gathered(batches, "text", TOGETHER):
            n = part.num_rows
            text, place, distinct = _words(part.column("text"))
            words = distinct.to_pylist()
            kind = np.fromiter(map(word_class, words), np.int32, len(words))
            unknown = (-1, 0.0, 0.0)
            looked_up = np.array([known.get(w, unknown) for w in words]).reshape(-1, 3)
            is_rare = looked_up[:, 0] < 0
            symbol = np.where(is_rare, OWN + 1 + kind, looked_up[:, 0]).astype("<u2")
            sizes = np.bincount(text, minlength=n)
            ends = np.cumsum(sizes + 1)
            symbols = np.full(ends[-1], OWN, "<u2")
            symbols[np.arange(len(place)) + text] = symbol[place]
            rare = is_rare[place]
            pairs, times = np.unique(
                text[rare] * len(words) + place[rare], return_counts=True
            )
            of, word = pairs // max(1, len(words)), pairs % max(1, len(words))
            listed = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=n))))
            columns = [
                *[part.column(c) for c in ("row", "doc_id", "held_out")],
                pa.array(sizes + 1, pa.int64()),
                pa.array(sizes - np.bincount(text[rare], minlength=n) + seen_ends, pa.int64()),
                pa.array(np.bincount(text, looked_up[place, 1], n) + end[1]),
                pa.array(np.bincount(text, looked_up[place, 2], n)),
                _binary(symbols, ends),
                pa.ListArray.from_arrays(
                    pa.array(listed, pa.int32()),
                    pa.StructArray.from_arrays(
                        [
                            distinct.take(pa.array(word)),
                            pa.array(kind[word], pa.int32()),
                            pa.array(times, pa.int32()),
                        ],
                        ["word", "class", "times"],
                    ),
                ),
            ]
            yield pa.RecordBatch.from_arrays(
                columns,
                ["row", "doc_id", "held_out", *[x.split()[0] for x in _ENCODED.split(", ")]],
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        held_out.alias("held_out"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).mapInArrow(encoded, f"row long, doc_id {id_type}, held_out boolean, {_ENCODED}")


def _binary(symbols: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes of each run of symbols, given where the runs end."""
    offsets = np.concatenate(([0], symbols.itemsize * ends)).astype(np.int32)
    return pa.Array.from_buffers(
        pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(symbols)]
    )


class Model:
    """Start, transition and emission probabilities; sequences of symbols run side by side."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def begin(cls, shares: np.ndarray, states: int = STATES) -> Model:
        """States that differ much, by fixed pseudo-random factors: near equality EM leaves slowly."""
        rng = np.random.default_rng(20)
        move = rng.dirichlet(np.ones(states), states)
        emit = shares * (rng.gamma(0.3, 1.0, (states, len(shares))) + 0.02)
        return cls(np.full(states, 1 / states), move, emit / emit.sum(axis=1, keepdims=True))

    @classmethod
    def from_counts(cls, counts: np.ndarray, states: int, symbols: int) -> Model:
        """Parameters that make the expected counts most likely, with PRIOR added."""
        start, move, emit = np.split(counts + PRIOR, [states, states + states * states])
        move, emit = move.reshape(states, states), emit.reshape(states, symbols)
        return cls(
            start / start.sum(),
            move / move.sum(axis=1, keepdims=True),
            emit / emit.sum(axis=1, keepdims=True),
        )

    def _forward(self, steps: np.ndarray, active: np.ndarray) -> Iterator[tuple]:
        """Scaled forward probabilities and their scale, a step at a time, longest sequences first."""
        by_symbol = np.ascontiguousarray(self.emit.T)
        alpha = None
        for t, n in enumerate(active.tolist()):
            seen = by_symbol[steps[t, :n]]
            alpha = (self.start if alpha is None else alpha[:n] @ self.move) * seen
            scale = alpha.sum(axis=1)
            alpha = alpha / scale[:, None]
            yield seen, alpha, scale

    def log10_likelihood(self, steps: np.ndarray, active: np.ndarray) -> np.ndarray:
        total = np.zeros(steps.shape[1])
        for _, _, scale in self._forward(steps, active):
            total[: len(scale)] += np.log10(scale)
        return total

    def expected(self, steps: np.ndarray, active: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Expected starts, transitions and emissions, in one array; ``first``: starts of texts."""
        states, symbols = self.emit.shape
        kept = list(self._forward(steps, active))
        move, emit = np.zeros((states, states)), np.zeros((symbols, states))
        beta = np.ones((active[-1], states))
        gammas = []
        for t in range(len(kept) - 1, -1, -1):
            seen, alpha, scale = kept[t]
            n = len(alpha)
            if len(beta) < n:
                beta = np.concatenate((beta, np.ones((n - len(beta), states))))
            gammas.append((steps[t, :n], alpha * beta))
            if t:
                back = seen * beta / scale[:, None]
                move += kept[t - 1][1][:n].T @ back
                beta = back @ self.move.T
        symbol = np.concatenate([g[0] for g in gammas])
        gamma = np.concatenate([g[1] for g in gammas])
        for s in range(states):
            emit[:, s] = np.bincount(symbol, gamma[:, s], symbols)
        start = gammas[-1][1][first].sum(axis=0)
        return np.concatenate((start, (move * self.move).ravel(), emit.T.ravel()))


def side_by_side(sequences: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of sequences of like length: their places, symbols by step, and how many go on."""
    order = sorted(range(len(sequences)), key=lambda n: -len(sequences[n]))
    at = 0
    while at < len(order):
        longest = len(sequences[order[at]])
        group = order[at : at + max(1, SIDE_BY_SIDE // longest)]
        # A group's shortest is at least half as long as its longest, or little is gained.
        group = [n for n in group if 2 * len(sequences[n]) >= longest or longest < 32]
        lengths = np.array([len(sequences[n]) for n in group])
        steps = np.zeros((longest, len(group)), np.int64)
        for column, n in enumerate(group):
            steps[: lengths[column], column] = sequences[n]
        active = np.searchsorted(-lengths, -np.arange(longest), side="left")
        yield np.array(group), steps, active
        at += len(group)


def _gathered(batches: Iterator[pa.RecordBatch], most: int = 1_500_000):
    """Rows of several Arrow batches, about ``most`` symbols at a time."""
    held, size = [], 0
    for batch in batches:
        for part in slices([batch], "symbols", 2 * most):
            held.append(part)
            size += part.column("symbols").nbytes // 2
            if size >= most:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _sequences(part: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(s, "<u2").astype(np.int64) for s in part.column("symbols").to_pylist()]


def train(encoded: DataFrame, lexicon: Lexicon, iterations: int = ITERATIONS) -> Model:
    """Baum-Welch over all training documents; each task sends one vector of expected counts."""
    shares = np.full(SYMBOLS, PRIOR)
    for symbol, base, _ in lexicon.known.values():
        if symbol < OWN:
            shares[symbol] += 10**base * (lexicon.total + 0.5 * (lexicon.distinct + 1))
    shares[OWN] += lexicon.ends
    shares[OWN + 1 :] += [tokens for tokens, _ in lexicon.by_class]
    model = Model.begin(shares / shares.sum())
    texts = encoded.where(~F.col("held_out")).select("symbols")
    size = STATES + STATES * STATES + STATES * SYMBOLS
    for _ in range(iterations):
        now = model

        def counted(batches: Iterator[pa.RecordBatch], now: Model = now) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(size)
            for part in _gathered(batches):
                segments, first = [], []
                for s in _sequences(part):
                    for start in range(0, len(s), SEGMENT):
                        segments.append(s[start : start + SEGMENT])
                        first.append(start == 0)
                first = np.array(first)
                for group, steps, active in side_by_side(segments):
                    sums += now.expected(steps, active, first[group])
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["at", "n"])

        counts = np.zeros(size)
        summed = texts.mapInArrow(counted, "at long, n double").groupBy("at").agg(F.sum("n"))
        for at, n in summed.collect():
            counts[at] = n
        model = Model.from_counts(counts, STATES, SYMBOLS)
    return model


def likelihoods(encoded: DataFrame, model: Model) -> DataFrame:
    """row and log10 likelihood of its whole symbol sequence."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _gathered(batches):
            sequences = _sequences(part)
            out = np.zeros(len(sequences))
            for group, steps, active in side_by_side(sequences):
                out[group] = model.log10_likelihood(steps, active)
            yield pa.RecordBatch.from_arrays(
                [part.column("row").combine_chunks(), pa.array(out)], ["row", "states"]
            )

    return encoded.select("row", "symbols").mapInArrow(scored, "row long, states double")


def score(spark: SparkSession, docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    counts, lexicon = learn_counts(spark, docs, ~held_out)
    encoded = written(encode(docs, held_out, lexicon), new_work_dir(spark, "symbols"))
    states = likelihoods(encoded, train(encoded, lexicon))
    n = F.coalesce("n", F.lit(0))
    tokens = F.array(*[F.lit(t) for t, _ in lexicon.by_class])
    kinds = F.array(*[F.lit(k) for _, k in lexicon.by_class])
    base = F.log10((n + 0.5) / (lexicon.total + 0.5 * (lexicon.distinct + 1)))
    within = F.log10((n + 0.5) / (F.get(tokens, "class") + 0.5 * (F.get(kinds, "class") + 1)))
    rare = (
        encoded.select("row", F.explode("rare").alias("r"))
        .select("row", "r.word", "r.class", "r.times")
        .join(counts, "word", "left")
        .groupBy("row")
        .agg(
            F.sum(base * F.col("times")).alias("rare_base"),
            F.sum(within * F.col("times")).alias("rare_within"),
            F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rare_known"),
        )
    )
    zero = F.lit(0.0)
    return (
        encoded.select("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "within")
        .join(states, "row")
        .join(rare, "row", "left")
        .select(
            "doc_id",
            "held_out",
            "n_tokens",
            (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
            F.lit(lexicon.total).cast("long").alias("train_tokens"),
            (F.col("base") + F.coalesce("rare_base", zero)).alias("base_score"),
            (F.col("states") + F.col("within") + F.coalesce("rare_within", zero)).alias("score"),
        )
    )


def op10_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark, table(spark, sf_dir, "documents"), crc_fold(F.col("doc_id"), 1))
