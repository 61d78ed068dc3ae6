"""Toxic passages by maximum-scoring segments.

Each word scores by its log-odds of standing in toxic rather than other labelled documents, with an informative Dirichlet
prior taken from both (counts are of documents that hold a form; a form is a word or its first 4 to 7 letters, and a word
takes the score of its most telling form). Scores count only as far as they differ from 0 by `CAUTION` standard deviations,
less a constant drift, so that words of clean text score below 0 on average. A linear-time scan finds every maximal
segment of a text; a segment's significance follows the extreme-value law of maximal segment scores, whose two parameters
are fitted on clean labelled documents. A document's evidence is the sum over its segments of their scores in nats beyond
chance, and a logistic curve makes it a probability. Law and curve are cross-fitted: every labelled document is scored with
log-odds from the other folds. No form that CAUTION lets through is left out; what bounds the model is LABELLED, the number
of labelled documents that are learnt from (chosen by a hash of their ids where there are more).
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accord.llm.common import mapped, table, with_texts, written
from accord.llm.wordcache import WordCache

STEMS = (4, 5, 6, 7)
#: Total weight of the prior, in documents; standard deviations by which a score is cut; drift a word.
PRIOR, CAUTION, DRIFT = 20.0, 2.33, 0.3
#: Labelled documents that a model is fitted on, about: the only bound of what is learnt. Folds of the cross-fitting.
LABELLED, FOLDS = 200_000, 4
#: Steps of a nat in which word scores are counted, and of the curve's argument.
FINE, STEPS = 1000, 64
LOW = -12.0

_WORD = re.compile(r"\w+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def forms(word: str) -> list[str]:
    """The word and its stems, marked by a leading sign that no word has."""
    return [word, *("^" + word[:k] for k in STEMS if len(word) > k)]


def log_odds(toxic: int, clean: int, of_toxic: int, of_clean: int, documents: int) -> tuple[float, float]:
    """Log-odds ratio of a form's share of all words, with a Dirichlet prior of PRIOR documents at the joint frequency, and its standard deviation."""
    share = PRIOR / documents
    prior, whole = share * (toxic + clean), share * (of_toxic + of_clean)
    a, b = toxic + prior, clean + prior
    ratio = math.log(a / (of_toxic + whole - a)) - math.log(b / (of_clean + whole - b))
    return ratio, math.sqrt(1 / a + 1 / b)


def cautious(ratio: float, deviation: float) -> float:
    return math.copysign(max(0.0, abs(ratio) - CAUTION * deviation), ratio)


class Scorer:
    """Scores of a text's words, and its maximal segments. model: score by form, with the form's z to choose by."""

    def __init__(self, model: dict[str, tuple[float, float]], most: int = 100_000):
        self.model = model
        self.scores = WordCache(self._score, most)

    def _score(self, word: str) -> float:
        model, best, z = self.model, 0.0, 0.0
        for f in forms(word):
            if f in model:
                score, own = model[f]
                if abs(own) > z:
                    best, z = score, abs(own)
        return best

    def word_scores(self, text: str) -> np.ndarray:
        return np.fromiter(map(self.scores.__getitem__, words(text)), dtype=np.float64) - DRIFT

    def segments(self, scores: np.ndarray) -> list[tuple[int, int, float]]:
        return maximal_segments(scores)


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """(start, end, score) of every maximal scoring segment, left to right: each joins what no extension or part outscores. Linear in the number of scores."""
    totals = np.cumsum(scores)
    starts, ends, left, right = [], [], [], []
    below: list[int] = []  # for each candidate: the last earlier one that begins at a lower total
    for i in np.flatnonzero(scores > 0).tolist():
        after = float(totals[i])
        before = after - float(scores[i])
        start = i
        while True:
            j = len(left) - 1
            while j >= 0 and left[j] >= before:
                j = below[j]
            if j < 0 or right[j] >= after:
                break
            before, start = left[j], starts[j]
            del starts[j:], ends[j:], left[j:], right[j:], below[j:]
        starts.append(start)
        ends.append(i + 1)
        left.append(before)
        right.append(after)
        below.append(j)
    return [(s, e, r - l) for s, e, l, r in zip(starts, ends, left, right)]


def evidence(segments: list[float], n: int, rate: float, size: float) -> float:
    """Nats by which a text's segments exceed chance: sum of rate * score - ln(size * n) over those that do; if none does, the best one's shortfall; LOW for a text without any."""
    if not segments:
        return LOW
    beyond = [rate * s - math.log(max(size * n, 1e-9)) for s in segments]
    over = sum(x for x in beyond if x > 0)
    return over if over > 0 else max(LOW, max(beyond))


def argument(x):
    """What the curve is drawn over: the evidence, its size in logarithms, so that long texts don't outweigh all others."""
    return np.sign(x) * np.log1p(np.abs(x))


def _counts(batch: pa.RecordBatch) -> pa.RecordBatch:
    counts: list[dict[str, int]] = [{} for _ in range(2 * FOLDS)]
    for text, label, fold in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "fold"))):
        distinct = set(words(text or ""))
        seen = set(distinct)
        for k in STEMS:
            seen.update(["^" + w[:k] for w in distinct if len(w) > k])
        into = counts[2 * fold + label]
        for form in seen:
            into[form] = into.get(form, 0) + 1
        into[""] = into.get("", 0) + len(distinct)  # all words
    # A row a form, whatever its folds: those are added up in the aggregate that follows.
    names = list(set().union(*counts))
    columns = {f"n{k}_{y}": pa.array([counts[2 * k + y].get(f, 0) for f in names], pa.int64()) for k in range(FOLDS) for y in (0, 1)}
    return pa.record_batch({"form": pa.array(names, pa.string())} | columns)


def rate_of(scores: list[tuple[float, int]], top: float) -> float:
    """The positive rate at which the mean of exp(rate * score) is 1, from (score, number of clean words); half a word more at `top`, the highest score that a word can have, stands for what clean text has not shown."""
    if top <= 0 or not scores:
        return 1.0
    x = np.array([s for s, _ in scores] + [top])
    n = np.array([k for _, k in scores] + [0.5])
    low, high = 1e-3, 1e-3
    beyond = lambda rate: np.logaddexp.reduce(rate * x + np.log(n)) > math.log(n.sum())
    while not beyond(high) and high < 1e6:
        high *= 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (low, middle) if beyond(middle) else (middle, high)
    return high


def fitted(labelled: DataFrame) -> dict:
    """The model: forms, extreme-value parameters and logistic curve. labelled: doc_id, text, toxic (0 or 1), all for learning.

    Without labels of both kinds, every text gets the share of toxic labels (0.5 without labels). Repeated rows count each.
    """
    fold = F.coalesce(F.pmod(F.crc32(F.concat(F.lit("fold"), F.col("doc_id").cast("string"))), F.lit(FOLDS)), F.lit(0)).cast("int")
    rows = labelled.withColumn("fold", fold)
    n = {(r["fold"], r["toxic"]): r["count"] for r in rows.groupBy("fold", "toxic").count().collect()}
    of = lambda label, without=None: sum(v for (f, y), v in n.items() if y == label and f != without)
    total = sum(n.values())
    prior = (of(1) + 0.5) / (total + 1)
    model = {"forms": {}, "rate": 1.0, "size": 1.0, "curve": (math.log(prior / (1 - prior)), 0.0)}
    if not (of(1) and of(0)):
        return model
    cells = [f"n{k}_{y}" for k in range(FOLDS) for y in (0, 1)]
    counted = written(mapped(rows.select("text", "toxic", "fold"), _counts, "form string, " + ", ".join(f"{c} long" for c in cells)).groupBy("form").agg(*[F.sum(c).alias(c) for c in cells]), "forms")
    whole = counted.filter("form = ''").first()
    if whole is None:
        return model

    def held(row, label: int, without: int | None):
        """Count of a label outside a fold: of the row, or as a column."""
        return sum((F.col(name) if row is None else row[name] for name in (f"n{k}_{label}" for k in range(FOLDS) if k != without)), start=F.lit(0) if row is None else 0)

    def z(without: int | None):
        """The form's log-odds by its standard deviation, as in log_odds(); null where the other folds don't have it."""
        share = PRIOR / (of(0, without) + of(1, without))
        of_clean, of_toxic = held(whole, 0, without), held(whole, 1, without)
        clean, toxic = held(None, 0, without), held(None, 1, without)
        extra = share * (of_toxic + of_clean)
        a, b = toxic + share * (toxic + clean), clean + share * (toxic + clean)
        value = (F.log(a / (of_toxic + extra - a)) - F.log(b / (of_clean + extra - b))) / F.sqrt(1 / a + 1 / b)
        return F.when(toxic + clean > 0, value)

    models: dict[int | None, dict[str, tuple[float, float]]] = {}
    for without in (None, *range(FOLDS)):
        models[without] = {}
        if not (of(0, without) and of(1, without)):
            continue
        own = [held(None, y, without).alias(f"n_{y}") for y in (0, 1)]
        for r in counted.filter("form <> ''").withColumn("z", z(without)).filter(F.abs("z") > CAUTION).select("form", "z", *own).collect():
            ratio, deviation = log_odds(r["n_1"], r["n_0"], held(whole, 1, without), held(whole, 0, without), of(0, without) + of(1, without))
            models[without][r["form"]] = (cautious(ratio, deviation), r["z"])
    model["forms"] = models[None]

    def traced(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text, k in zip(batch.column("text").to_pylist(), batch.column("fold").to_pylist()):
            s = scorers[k].word_scores(text or "")
            values, times = np.unique(np.rint(s * FINE).astype(np.int32), return_counts=True)
            out.append((len(s), [x for _, _, x in maximal_segments(s)], [{"at": v, "n": c} for v, c in zip(values.tolist(), times.tolist())]))
        kind = pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int64())]))
        return pa.record_batch({"toxic": batch.column("toxic"), "n": pa.array([x[0] for x in out], pa.int64()), "segments": pa.array([x[1] for x in out], pa.list_(pa.float64())), "values": pa.array([x[2] for x in out], kind)})

    scorers = [Scorer(models[k], 25_000) for k in range(FOLDS)]  # each task gets its own copy, and its cache lives as long as the task
    traces = written(mapped(rows.select("text", "toxic", "fold"), traced, "toxic int, n long, segments array<double>, values array<struct<at: int, n: long>>"), "toxicity")
    clean = traces.filter("toxic = 0 and n > 0")
    counts = clean.select(F.explode("values").alias("v")).groupBy("v.at").agg(F.sum("v.n").alias("n")).collect()
    top = max((s for s, _ in model["forms"].values()), default=0.0) - DRIFT
    model["rate"] = rate = rate_of(sorted((r["at"] / FINE, r["n"]) for r in counts), top)
    # The size is its likeliest value given the rate.
    best = F.coalesce(F.array_max("segments"), F.lit(0.0))
    shown = clean.agg(F.count(F.lit(1)).alias("docs"), F.sum(F.col("n") * F.exp(-rate * best)).alias("k")).first()
    if shown["docs"]:
        model["size"] = shown["docs"] / max(shown["k"], 1e-300)
    size = max(model["size"], 1e-12)
    beyond = F.transform("segments", lambda s: s * rate - F.log(F.greatest(F.col("n") * size, F.lit(1e-9))))
    over = F.aggregate(beyond, F.lit(0.0), lambda acc, x: acc + F.greatest(x, F.lit(0.0)))
    x = F.when(F.size("segments") == 0, F.lit(LOW)).when(over > 0, over).otherwise(F.greatest(F.lit(LOW), F.array_max(beyond)))
    at = F.rint(F.signum(x) * F.log1p(F.abs(x)) * STEPS)  # a few hundred values, whatever the rows
    points = traces.groupBy(at.alias("at"), "toxic").count().collect()
    model["curve"] = logistic([(r["at"] / STEPS, r["toxic"], r["count"]) for r in points], prior)
    return model


def logistic(points: list[tuple[float, int, int]], prior: float) -> tuple[float, float]:
    """Intercept and slope (0 at least) of the likeliest logistic curve through (x, label, count), by Newton steps with a little damping."""
    a, b = math.log(prior / (1 - prior)), 0.0
    if len({y for _, y, _ in points}) < 2:
        return a, b
    x, y, w = (np.array(c, dtype=float) for c in zip(*points))
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -500, 500)))
        g = np.array([(w * (y - p)).sum(), (w * (y - p) * x).sum() - 0.01 * b])
        v = w * p * (1 - p)
        h = np.array([[v.sum() + 1e-6, (v * x).sum()], [(v * x).sum(), (v * x * x).sum() + 0.01]])
        step = np.linalg.solve(h, g)
        a, b = a + float(np.clip(step[0], -1, 1)), b + float(np.clip(step[1], -1, 1))
        if abs(step).max() < 1e-9:
            break
    return (a, b) if b >= 0 else (math.log(prior / (1 - prior)), 0.0)


def _judged(model: dict):
    """log-odds of a text and its segments, by the model."""
    rate, size, (a, b), scorer = model["rate"], max(model["size"], 1e-12), model["curve"], Scorer(model["forms"])

    def judge(text: str) -> tuple[float, int, list[tuple[int, int, float]]]:
        s = scorer.word_scores(text)
        found = maximal_segments(s)
        return a + b * float(argument(evidence([f[2] for f in found], len(s), rate, size))), len(s), found

    return judge


def scored(documents: DataFrame, model: dict, with_segments: bool = False) -> DataFrame:
    """doc_id, score, predicted and, if asked, segments (start and end word, score, p_value; significant ones first to last).

    Null texts are empty. A text without telling words gets the score of no evidence. Repeated rows come back as often, and
    equal texts score alike; a score of just 0.5 is predicted toxic. Texts of any length are scanned whole. An empty table
    gives an empty one. Other columns play no part.
    """
    rate, size, judge = model["rate"], max(model["size"], 1e-12), _judged(model)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("p_value", pa.float64())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores, spans = [], []
        for text in batch.column("text").to_pylist():
            odds, n, found = judge(text or "")
            scores.append(1 / (1 + math.exp(-max(-500.0, min(500.0, odds)))))
            if with_segments:
                tested = [{"start": i, "end": j, "score": v, "p_value": -math.expm1(-size * n * math.exp(-rate * v))} for i, j, v in found]
                spans.append([t for t in tested if t["p_value"] < 0.05])
        columns = {"doc_id": batch.column("doc_id"), "score": pa.array(scores, pa.float64()), "predicted": pa.array([int(x >= 0.5) for x in scores], pa.int32())}
        return pa.record_batch(columns | ({"segments": pa.array(spans, kind)} if with_segments else {}))

    schema = "doc_id long, score double, predicted int" + ", segments array<struct<start: int, end: int, score: double, p_value: double>>" * with_segments
    return mapped(with_texts(documents), run, schema)


def without_toxic(documents: DataFrame, model: dict) -> DataFrame:
    """The documents that scored() doesn't predict toxic, with all their columns, in one pass. Rows with null or empty texts are judged as empty ones; repeated rows go or stay together."""
    judge = _judged(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([judge(text or "")[0] < 0 for text in batch.column("text").to_pylist()], pa.bool_()))

    return mapped(documents, run, documents.schema)


def remainder(column: str = "doc_id", by: int = 5):
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(by))


def learned(documents: DataFrame, labels: DataFrame) -> dict:
    """fitted() on the documents with a label and a remainder of crc32(doc_id) mod 5 other than 0: all of them, or about LABELLED where there are more. A doc_id labelled twice is toxic if any label says so; null labels and ids don't count."""
    known = labels.filter("toxic in (0, 1)").filter(remainder() != 0).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    n = known.count()
    if n > LABELLED:
        known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 30)) < int((1 << 30) * LABELLED / n))
    # A label is two numbers, so so many of them are a few MB.
    return fitted(with_texts(documents).join(F.broadcast(known), "doc_id").select("doc_id", "text", "toxic"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, learnt from `labels`; see scored() for nulls, empty and long texts, ties and repeated rows. Without labels every score is 0.5."""
    documents = table(spark, sf_dir, "documents")
    out = scored(documents, learned(documents, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(remainder() == 0, F.lit(False)).alias("held_out"), "score", "predicted")
