"""Context-triggered piecewise hashing of texts.

A rolling hash over 7 bytes marks chunk boundaries, each chunk becomes one base-64 character of its hash, and a fingerprint
is `block:characters:characters at twice the block`. The block, 3 * 2**k bytes, is the one at which a text has 32 to 64
chunks if it can. Fingerprints are compared by edit distance (insertions and deletions; a substitution is one of each) where
their block sizes agree or differ by a factor of two, and only if they share a run of 7 characters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from accord.llm.common import lean, pieces, released, table, with_texts, written
from accord.llm.words import mix64

WINDOW, LENGTH, LEAST, RUN = 7, 64, 32, 7
_ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", dtype=np.uint8)
_ROLL = (np.uint64(0x01000193) ** np.arange(WINDOW, dtype=np.uint64)).astype(np.uint32)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, base, dtype=np.uint64))]).astype(np.uint64)


_UP, _DOWN = _powers(_BASE, 1 << 12), _powers(_INVERSE, 1 << 12)


def _characters(sums: np.ndarray, ends: np.ndarray, most: int) -> str:
    """One character a chunk: sums[i] is the hash sum of the bytes up to ends[i]; beyond `most` chunks, the last one takes the rest."""
    if len(ends) > most:
        ends, sums = np.append(ends[: most - 1], ends[-1]), np.append(sums[: most - 1], sums[-1])
    starts = np.append(0, ends[:-1])
    with np.errstate(over="ignore"):
        own = np.diff(sums, prepend=np.uint64(0)) * _DOWN[starts]
    return _ALPHABET[(mix64(own) & np.uint64(63)).astype(np.int64)].tobytes().decode()


def fingerprint(data: bytes) -> str:
    """The fingerprint of a whole text's bytes; equal bytes have equal fingerprints and an empty text has `3::`."""
    global _UP, _DOWN
    n = len(data)
    if not n:
        return "3::"
    if n >= len(_UP):
        size = 1 << n.bit_length()
        _UP, _DOWN = _powers(_BASE, size), _powers(_INVERSE, size)
    c = np.frombuffer(data, dtype=np.uint8).astype(np.uint32)
    with np.errstate(over="ignore"):
        c += np.uint32(1)
        roll = c * _ROLL[0]
        for k in range(1, min(WINDOW, n)):
            roll[k:] += c[:-k] * _ROLL[k]
        roll ^= roll >> np.uint32(15)
        roll *= np.uint32(0x85EBCA6B)
        roll ^= roll >> np.uint32(13)
        k = 0
        while 3 * LENGTH << k < n:
            k += 1
        while True:
            marks = np.flatnonzero(roll & np.uint32((1 << k) - 1) == 0)
            marks = marks[(roll[marks] >> np.uint32(k)) % np.uint32(3) == 0]
            if len(marks) >= LEAST - 1 or not k:
                break
            k -= 1
        ends = marks + 1
        twice = (roll[marks] >> np.uint32(k)) & np.uint32(1) == 0
        if not len(ends) or ends[-1] != n:
            ends, twice = np.append(ends, n), np.append(twice, True)
        twice[-1] = True
        sums = np.add.reduceat(c * _UP[:n], np.append(0, ends[:-1])).cumsum()
    return f"{3 << k}:{_characters(sums, ends, LENGTH)}:{_characters(sums[twice], ends[twice], LENGTH // 2)}"


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit of an integer for each character of a."""
    masks: dict[str, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    v = full = (1 << len(a)) - 1
    for x in b:
        u = v & masks.get(x, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def _likeness(a: str, b: str) -> float:
    runs = {a[i : i + RUN] for i in range(len(a) - RUN + 1)}
    if not any(b[i : i + RUN] in runs for i in range(len(b) - RUN + 1)):
        return 0.0
    return 2 * common_length(a, b) / (len(a) + len(b))


def likeness(a: str, b: str) -> float:
    """0 to 1: one less the edit distance over the total length, the better of the compatible block sizes; equal fingerprints give 1."""
    if a == b:
        return 1.0
    (m, a1, a2), (n, b1, b2) = a.split(":"), b.split(":")
    m, n = int(m), int(n)
    if m == n:
        return max(_likeness(a1, b1), _likeness(a2, b2))
    return _likeness(a1, b2) if m == 2 * n else _likeness(a2, b1) if n == 2 * m else 0.0


def edited(text: str, following: str) -> str:
    """text with its last floor(n/2) code points replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_COLUMNS = [x.split()[0] for x in _RESULT.split(", ")]


def _row(doc: tuple, own: str, following: str, of_following: str) -> tuple:
    text = edited(doc[1], following)
    data = text.encode()
    print_ = fingerprint(data)
    return (doc[0], len(doc[1]), hashlib.sha256(data).hexdigest(), own, print_, likeness(own, print_), likeness(own, of_following))


def _batch(rows: list[tuple], role: str, part: int, texts: list[str | None]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in _COLUMNS]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    arrays = [pa.array(c, t) for c, t in zip(columns, types)]
    n = len(rows)
    return pa.record_batch(arrays + [pa.array([role] * n), pa.array([part] * n, pa.int32()), pa.array(texts, pa.string())], names=[*_COLUMNS, "role", "part", "text"])


def _walk(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """Rows of one range of doc_ids in order: all but the last know their next document; the ends go on with their texts."""
    part, last, own = TaskContext.get().partitionId(), None, ""
    for batch in batches:
        for piece in pieces(batch):
            rows = []
            for doc in zip(piece.column("doc_id").to_pylist(), (x or "" for x in piece.column("text").to_pylist())):
                mark = fingerprint(doc[1].encode())
                if last is None:
                    yield _batch([(doc[0], len(doc[1]), None, mark, None, None, None)], "head", part, [doc[1]])
                else:
                    rows.append(_row(last, own, doc[1], mark))
                last, own = doc, mark
            yield _batch(rows, "row", part, [None] * len(rows))
    if last is not None:
        yield _batch([(last[0], len(last[1]), None, own, None, None, None)], "tail", part, [last[1]])


def _close(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    for batch in batches:
        rows = [_row((x["doc_id"], x["text"]), x["fingerprint"], x["next_text"], x["next_fingerprint"]) for x in batch.to_pylist()]
        yield _batch(rows, "row", 0, [None] * len(rows)).select(_COLUMNS)


def fingerprints(documents: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness; columns as in the contract of op4.

    Null texts are empty. Documents are ordered by doc_id (null first, equal ones by text) and the last is followed by the
    first; a single document follows itself. Texts are shuffled once, by range; only the two ends of each range are joined
    afterwards. Other columns play no part.
    """
    lean(documents.sparkSession)
    docs = with_texts(documents)
    walked = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(released(_walk), f"{_RESULT}, role string, part int, text string")
    made = written(walked, "piecewise")
    ends = made.filter("role <> 'row'")
    heads = ends.filter("role = 'head'").select("part", F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
    # One row for each range: as many as there are tasks, whatever the input.
    parts = heads.select("part")
    order = parts.withColumn("next", F.lead("part").over(Window.orderBy("part"))).withColumn("next", F.coalesce("next", F.min("part").over(Window.partitionBy())))
    tails = ends.filter("role = 'tail'").select("part", "doc_id", "text", "fingerprint")
    closing = tails.join(order, "part").drop("part").join(heads.withColumnRenamed("part", "next"), "next")
    closed = closing.select("doc_id", "text", "fingerprint", "next_text", "next_fingerprint").mapInArrow(released(_close), _RESULT)
    return made.filter("role = 'row'").select(_COLUMNS).unionByName(closed)


def op4_piecewise_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row of `documents`.

    Null texts are empty ones, whose fingerprints are equal. Texts are hashed whole. Rows are in order of doc_id (null first),
    then text; repeated rows follow each other. A single row is its own next document. An empty table gives an empty one; other
    columns play no part.
    """
    return fingerprints(table(spark, sf_dir, "documents"))
