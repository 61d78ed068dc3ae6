"""Log-bilinear language model trained with noise-contrastive estimation, and add-one unigrams beside it.

Tokens are words and one end a text. The model predicts symbols: the SHORT commonest words and the end stand for themselves,
any other word for its class (by its last letters), within which it has its add-one unigram probability. A symbol's score
is (C2 r[far] + C1 r[near]) . q + b for two symbols of its context: the one before it (near), and the last of the commonest
words before that (far), which tells the language and manner of a text. Since it is a sum of a term of each context symbol,
the normaliser of every context is one matrix product of exponentials, and a token costs a few table lookups.

Training is data-parallel: in every round each task starts from the common parameters, runs noise-contrastive steps in numpy
over all texts of its share, and the parameters are averaged by tokens. All training texts take part in every round; what a
task gives back has a fixed size. Shares, their order and their seeds follow from the documents alone, not from how the
table is split.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accord.llm.common import cutoff, dropped, lean, mapped, pieces, released, table, texts, written
from accord.llm.wordcache import WordCache

#: Symbols: END and the commonest words up to SHORT, then CLASSES. HEAD: words whose counts every worker holds (some MB); rarer words meet their counts in a join.
SHORT, CLASSES, HEAD = 512, 1536, 200_000
SYMBOLS, END = SHORT + CLASSES, 0
WIDTH, NOISE, SHARED, STEP, ROUNDS, RATE = 24, 10, 64, 1024, 2, 0.3
#: Training tokens of a share.
SHARE = 8_000_000
#: Words that a worker remembers, in each of two generations.
CACHED = 500_000
#: Tasks that sum what the training tasks give back.
SUMS = 16
_PUNCTUATION = b".,;:!?\"'()[]{}<>|*-$%&/#"


def tokens(text: bytes) -> list[bytes]:
    """Words of a text with A-Z lower-cased, without the end."""
    return text.lower().split()


def class_of(word: bytes) -> int:
    """One of CLASSES, by the last three bytes of the word before any punctuation and by whether there is some."""
    inner = word.rstrip(_PUNCTUATION)
    return zlib.crc32(inner[-3:], len(inner) < len(word)) % CLASSES


# ------------------------------------------------------------------ counts


def _count(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """Counts of the words of a share; handed on whenever many are held. The empty word stands for the end."""

    def out(held: dict[bytes, int]) -> Iterable[pa.RecordBatch]:
        words = list(held)
        for k in range(0, len(words), 50_000):
            some = words[k : k + 50_000]
            yield pa.record_batch({"word": pa.array(some, pa.binary()).cast(pa.string()), "class": pa.array([class_of(w) for w in some], pa.int32()), "c": pa.array([held[w] for w in some], pa.int64())})

    held: Counter[bytes] = Counter()
    for batch in batches:
        for piece in pieces(batch):
            for text in texts(piece.column("text")):
                held.update(tokens(text))
                held[b""] += 1
            if len(held) > 1_000_000:
                yield from out(held)
                held = Counter()
    yield from out(held)


def counted(training: DataFrame) -> DataFrame:
    """word, class, c of every distinct token of the training texts; the empty word is the end."""
    return training.select("text").mapInArrow(released(_count), "word string, class int, c long").groupBy("word", "class").agg(F.sum("c").alias("c"))


class Vocabulary:
    """The bounded part of the counts that every worker holds."""

    def __init__(self, counts: DataFrame):
        sums = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
        self.n, self.v = int(sums["n"] or 0), int(sums["v"])
        head = sorted(counts.filter(F.col("c") >= cutoff(counts, "c", HEAD)).filter("word <> ''").collect(), key=lambda r: (-r["c"], r["word"]))
        end = counts.filter("word = ''").first()
        self.end_count = int(end["c"]) if end else 0
        self.head = {r["word"].encode(): k for k, r in enumerate(head)}
        self.logs = np.log10(np.array([r["c"] for r in head] + [0], dtype=np.float64) + 1)
        short = head[: SHORT - 1]
        self.symbols = {r["word"].encode(): k + 1 for k, r in enumerate(short)}
        self.end_log = float(np.log10(self.end_count + 1))
        by_class = {r["class"]: (r["n"], r["v"]) for r in counts.filter("word <> ''").groupBy("class").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
        n, v = np.zeros(CLASSES), np.zeros(CLASSES)
        for k, (a, b) in by_class.items():
            n[k], v[k] = a, b
        for r in short:
            n[r["class"]] -= r["c"]
            v[r["class"]] -= 1
        #: log10 of the add-one denominator within each class.
        self.within = np.log10(n + v + 1)
        frequency = np.zeros(SYMBOLS)
        frequency[END] = self.end_count
        frequency[1 : len(short) + 1] = [r["c"] for r in short]
        frequency[SHORT:] = n
        #: Symbols that can't come: no word has them. The classes stay, for words not seen in training.
        self.open = np.ones(SYMBOLS, dtype=bool)
        self.open[len(short) + 1 : SHORT] = False
        smooth = np.where(self.open, frequency + 0.5, 0)
        self.frequency = smooth / smooth.sum()


# ------------------------------------------------------------------ the model


class Model:
    """Parameters as float32 arrays: r, q (symbols x WIDTH), c1, c2 (WIDTH x WIDTH), b."""

    def __init__(self, frequency: np.ndarray, seed: int = 5):
        random = np.random.default_rng(seed)
        self.r = random.normal(0, 0.1, (SYMBOLS, WIDTH)).astype(np.float32)
        self.q = random.normal(0, 0.1, (SYMBOLS, WIDTH)).astype(np.float32)
        self.c1 = (np.eye(WIDTH) * 0.7).astype(np.float32)
        self.c2 = (np.eye(WIDTH) * 0.3).astype(np.float32)
        self.b = np.log(np.maximum(frequency, 1e-12)).astype(np.float32)

    NAMES = ("r", "q", "c1", "c2", "b")

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, x).ravel() for x in self.NAMES])

    def set(self, flat: np.ndarray) -> None:
        at = 0
        for x in self.NAMES:
            own = getattr(self, x)
            setattr(self, x, flat[at : at + own.size].reshape(own.shape).astype(np.float32))
            at += own.size

    def tables(self, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log-probability terms in log10: of the symbol two back, of the last one (with the bias), and the normaliser of both."""
        far = self.r[:SHORT] @ self.c2.T @ self.q.T
        near = self.r @ self.c1.T @ self.q.T + np.where(open_, self.b, -np.inf).astype(np.float32)
        z = np.log(np.exp(far) @ np.exp(near).T)
        return tuple(x / np.float32(np.log(10)) for x in (far, near, z))


def contexts(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Far and near context of each token of a run of texts, each with an END after it: the last of the commonest words before the last token, and the last token. A text begins as if after ENDs."""
    near = np.concatenate([[END], s[:-1]])
    last = np.maximum.accumulate(np.where(s < SHORT, np.arange(len(s)), 0))
    far = np.concatenate([[END, END], s[last[:-2]]])[: len(s)]
    return np.where((near == END) | (far >= SHORT), END, far), near  # before the first of them, END


def _grouped(index: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of rows by index: distinct indices and their sums."""
    order = np.argsort(index.astype(np.uint16), kind="stable")  # 16 bits sort by radix
    index = index[order]
    starts = np.flatnonzero(np.append(True, index[1:] != index[:-1]))
    return index[starts], np.add.reduceat(rows[order], starts, axis=0)


class Trainer:
    """Noise-contrastive steps with per-parameter rates (Adagrad). Each step's NOISE samples a token are SHARED ones for all its tokens, weighted to as many."""

    def __init__(self, model: Model, frequency: np.ndarray, seed: int):
        self.model, self.random = model, np.random.default_rng(seed)
        self.log_noise = np.log(np.maximum(frequency * NOISE, 1e-12)).astype(np.float32)
        self.cumulative = np.cumsum(frequency)
        self.squares = {x: np.full_like(getattr(model, x), 0.05) for x in Model.NAMES}

    def _apply(self, name: str, index, gradient: np.ndarray) -> None:
        squares, values = self.squares[name], getattr(self.model, name)
        squares[index] += gradient * gradient
        values[index] += RATE * gradient / np.sqrt(squares[index])

    def step(self, far: np.ndarray, near: np.ndarray, word: np.ndarray, weight: np.ndarray) -> None:
        m = self.model
        noise = np.minimum(np.searchsorted(self.cumulative, self.random.random(SHARED)), SYMBOLS - 1)
        rf, rn, qw, qn = m.r[far], m.r[near], m.q[word], m.q[noise]
        context = rf @ m.c2.T + rn @ m.c1.T
        true = weight / (1 + np.exp(np.einsum("ij,ij->i", context, qw) + (m.b[word] - self.log_noise[word])))
        false = context @ -qn.T
        false -= m.b[noise] - self.log_noise[noise]
        np.exp(false, out=false)
        false += 1
        np.divide((weight * np.float32(NOISE / SHARED))[:, None], false, out=false)
        by_context = true[:, None] * qw - false @ qn
        self._apply("c1", slice(None), by_context.T @ rn)
        self._apply("c2", slice(None), by_context.T @ rf)
        self._apply("r", *_grouped(np.concatenate([far, near]), np.concatenate([by_context @ m.c2, by_context @ m.c1])))
        at = np.concatenate([word, noise])
        self._apply("q", *_grouped(at, np.concatenate([true[:, None] * context, -(false.T @ context)])))
        index, g = _grouped(at, np.concatenate([true, -false.sum(0)])[:, None])
        self._apply("b", index, g[:, 0])

    def learn(self, symbols: np.ndarray) -> None:
        """One pass over a run of texts, each with one END after it: equal trigrams are one, weighted by their count. A text begins as if after two ENDs."""
        s = symbols.astype(np.int64)
        far, near = contexts(s)
        distinct, times = np.unique((far * SYMBOLS + near) * SYMBOLS + s, return_counts=True)
        order = self.random.permutation(len(distinct))
        distinct, times = distinct[order], times[order].astype(np.float32) / STEP
        for k in range(0, len(distinct), STEP):
            code = distinct[k : k + STEP]
            self.step(code // (SYMBOLS * SYMBOLS), code // SYMBOLS % SYMBOLS, code % SYMBOLS, times[k : k + STEP])


def trained(parts: DataFrame, vocabulary: Vocabulary) -> Model:
    """The model after ROUNDS over all training rows of parts (doc_id, training, symbols)."""
    frequency = vocabulary.frequency
    model = Model(frequency)
    if not vocabulary.n:
        return model
    spark = parts.sparkSession
    order = F.xxhash64("doc_id", "symbols")
    dealt = parts.filter("training").select("doc_id", "symbols").repartition(-(-vocabulary.n // SHARE), order).sortWithinPartitions(order, "doc_id", "symbols").select("symbols")
    for round_ in range(ROUNDS):
        start = model.flat()

        def run(batches: Iterable[pa.RecordBatch], start=start, round_=round_) -> Iterable[pa.RecordBatch]:
            own = Model(frequency)
            own.set(start)
            trainer, n = Trainer(own, frequency, 1000 * round_ + TaskContext.get().partitionId()), 0
            for batch in batches:
                for piece in pieces(batch, 2 << 20):
                    symbols = np.frombuffer(b"".join(piece.column("symbols").to_pylist()), dtype="<u2")
                    trainer.learn(symbols)
                    n += len(symbols)
            if n:
                yield pa.record_batch({"n": pa.array([n], pa.int64()), "flat": pa.array([own.flat().astype("<f4").tobytes()], pa.binary())})

        def summed(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
            total, n = None, 0
            for batch in batches:
                for k, flat in zip(batch.column("n").to_pylist(), batch.column("flat").to_pylist()):
                    part = k * np.frombuffer(flat, dtype="<f4").astype(np.float64)
                    total, n = part if total is None else total + part, n + k
            if n:
                yield pa.record_batch({"n": pa.array([n], pa.int64()), "total": pa.array([total.tobytes()], pa.binary())})

        # A task gives back some 100 KB; they are summed in parallel, so the driver gets SUMS rows at most.
        tasks = written(dealt.mapInArrow(released(run), "n long, flat binary"), "parameters")
        rows = tasks.repartition(SUMS).mapInArrow(summed, "n long, total binary").collect()
        model.set(sum(np.frombuffer(r["total"]) for r in rows) / sum(r["n"] for r in rows))
        dropped(spark, tasks)
    return model


# ------------------------------------------------------------------ scores

_PARTS = "row long, doc_id long, training boolean, n_tokens long, known long, logs double, within double, rare array<struct<word: string, n: long>>, symbols binary"


def symbolised(documents: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """What of each document (doc_id, text, training) doesn't depend on the model: its symbols (two bytes a token), the log10 counts of its head words, those and the denominators within classes, and its rare words."""
    head, logs, within, symbols_of, end_log, end_known = vocabulary.head, vocabulary.logs, vocabulary.within, vocabulary.symbols, vocabulary.end_log, bool(vocabulary.end_count)

    def code(word: bytes) -> int:
        symbol = symbols_of.get(word)
        return ((SHORT + class_of(word) if symbol is None else symbol) << 32) + head.get(word, len(head))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        cache = WordCache(code, CACHED)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for piece in pieces(batch):
                out, names_of, counts_of, ends = [], [], [], [0]
                for doc_id, training, text in zip(piece.column("doc_id").to_pylist(), piece.column("training").to_pylist(), texts(piece.column("text"))):
                    words = tokens(text)
                    codes = np.fromiter(map(cache.__getitem__, words), dtype=np.int64, count=len(words))
                    symbols, places = codes >> 32, codes & 0xFFFFFFFF
                    other = symbols >= SHORT
                    rare: dict[bytes, int] = {}
                    for k in np.flatnonzero(places == len(head)).tolist():
                        rare[words[k]] = rare.get(words[k], 0) + 1
                    known = len(words) - sum(rare.values()) + end_known
                    inner = float(logs[places[other]].sum() - within[symbols[other] - SHORT].sum())
                    out.append((row, doc_id, training, len(words) + 1, known, float(logs[places].sum()) + end_log, inner, np.append(symbols, END).astype("<u2").tobytes()))
                    names_of += rare
                    counts_of += rare.values()
                    ends.append(len(names_of))
                    row += 1
                kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary()]
                columns = [pa.array(c, t) for c, t in zip(zip(*out), kinds)]
                struct = pa.StructArray.from_arrays([pa.array(names_of, pa.binary()).cast(pa.string()), pa.array(counts_of, pa.int64())], names=["word", "n"])
                columns.insert(7, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), struct))
                yield pa.record_batch(columns, names=["row", "doc_id", "training", "n_tokens", "known", "logs", "within", "rare", "symbols"])

    return written(documents.mapInArrow(released(run), _PARTS), "symbols")


def _sequences(parts: DataFrame, model: Model, vocabulary: Vocabulary) -> DataFrame:
    """row, likelihood: log10 probability of each document's symbols."""
    flat, frequency, open_ = model.flat(), vocabulary.frequency, vocabulary.open
    tables: list = []  # made once in each task, from parameters that are a hundredth of their size

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not tables:
            own = Model(frequency)
            own.set(flat)
            tables.extend(own.tables(open_))
        far, near, z = tables
        data = batch.column("symbols").to_pylist()
        s = np.frombuffer(b"".join(data), dtype="<u2").astype(np.int64)
        ends = np.cumsum([len(x) // 2 for x in data])
        before, last = contexts(s)
        each = (far[before, s] + near[last, s] - z[before, last]).astype(np.float64)
        sums = np.add.reduceat(each, np.concatenate([[0], ends[:-1]]))
        return pa.record_batch({"row": batch.column("row"), "likelihood": pa.array(sums)})

    return mapped(parts.select("row", "symbols"), run, "row long, likelihood double")


def scored(documents: DataFrame, training) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every document; training: condition on its columns (null: not) under which a document is learnt from.

    base_score sums log10 of add-one unigrams over the tokens, score is the model's log10 probability of the text with its
    end. A null text is empty: one token, the end. Without training texts every token is unknown and the model is uniform
    over its symbols. Repeated rows are learnt from as often and come back as often, with equal scores; words of equal counts
    are ordered by code point. Texts of any length are taken whole; an empty table gives an empty one. Columns other than doc_id and text play no part beyond the condition.
    """
    lean(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(training, F.lit(False)).alias("training"))
    counts = written(counted(docs.filter("training")), "counts")
    vocabulary = Vocabulary(counts)
    parts = symbolised(docs, vocabulary)
    model = trained(parts, vocabulary)
    likelihoods = _sequences(parts, model, vocabulary)
    # Words of the head have been scored already: those left are rare, so none of them is a hot key.
    rare = parts.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.n").join(counts.select("word", "c"), "word")
    more = rare.groupBy("row").agg(F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("rare_logs"), F.sum("n").alias("more"))
    out = parts.drop("rare", "symbols").join(likelihoods, "row").join(more, "row", "left")
    rest = F.coalesce("rare_logs", F.lit(0.0))
    denominator = float(np.log10(vocabulary.n + vocabulary.v + 1))
    base = F.col("logs") + rest - F.col("n_tokens") * denominator
    known = F.col("known") + F.coalesce("more", F.lit(0))
    return out.select("doc_id", "n_tokens", known.alias("n_known"), F.lit(vocabulary.n).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("likelihood") + F.col("within") + rest).alias("score"))


def held_out(column: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string")), F.lit(7)) == 2, F.lit(False))


def op5_bilinear_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of `documents`; a null doc_id is learnt from. See scored() for nulls, empty and long texts, repeated rows, empty tables and other columns."""
    documents = table(spark, sf_dir, "documents")
    out = scored(documents, ~held_out())
    return out.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
