"""Token ids in fixed-width bit-packed files.

A file holds the ids of consecutive documents. Layout, all little-endian: 8 bytes `ACPK0001`; then blocks of BLOCK ids, each
id in `width` bits (the fewest that hold the vocabulary's largest id), as 64-bit words, the last block filled up with zero
ids; then a footer of int64: document ids (and a bit for null), each document's first id within the file, one more for the
end, and each block's byte offset; then 5 int64: width, block, documents, blocks, footer bytes. Any run of ids is read from
the blocks that cover it, each unpacked by a few dozen numpy operations.
"""

from __future__ import annotations

import json
import os
import re
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from accord.llm.common import lean, new_path, pieces, released, table, with_texts, written
from accord.llm.wordcache import WordCache

MAGIC, BLOCK = b"ACPK0001", 4096


def width_of(vocabulary: int) -> int:
    """The bits that ids below `vocabulary` need, 1 at least and 32 at most."""
    width = max(1, (vocabulary - 1).bit_length())
    if width > 32:
        raise ValueError("ids of more than 32 bits")
    return width


def packed(ids: np.ndarray, width: int) -> np.ndarray:
    """64-bit words of ids (a multiple of 64 of them), each in `width` bits."""
    lanes = ids.reshape(-1, 64).T.astype(np.uint64)
    out = np.zeros((width, lanes.shape[1]), dtype=np.uint64)
    for k in range(64):
        at, off = divmod(k * width, 64)
        out[at] |= lanes[k] << np.uint64(off)
        if off + width > 64:
            out[at + 1] |= lanes[k] >> np.uint64(64 - off)
    return np.ascontiguousarray(out.T).reshape(-1)


def unpacked(words: np.ndarray, width: int) -> np.ndarray:
    """The ids that packed() took."""
    lanes = np.ascontiguousarray(words.reshape(-1, width).T)
    out = np.empty((64, lanes.shape[1]), dtype=np.uint32)
    mask = np.uint64((1 << width) - 1)
    for k in range(64):
        at, off = divmod(k * width, 64)
        x = lanes[at] >> np.uint64(off)
        if off + width > 64:
            x = x | lanes[at + 1] << np.uint64(64 - off)
        out[k] = x & mask
    return np.ascontiguousarray(out.T).reshape(-1)


class PackedWriter:
    def __init__(self, stream, width: int):
        self.stream, self.width, self.held, self.n, self.at = stream, width, [], 0, len(MAGIC)
        self.docs: list[int | None] = []
        self.starts: list[int] = [0]
        self.blocks: list[int] = []
        stream.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """ids: unsigned 32-bit, little-endian."""
        self.docs.append(doc_id)
        self.starts.append(self.starts[-1] + len(ids) // 4)
        self.held.append(ids)
        self.n += len(ids) // 4
        if self.n >= 64 * BLOCK:
            self._flush(self.n // BLOCK * BLOCK)

    def _flush(self, n: int) -> None:
        ids = np.frombuffer(b"".join(self.held), dtype="<u4")
        now, rest = ids[:n], ids[n:]
        if len(now) % BLOCK:
            now = np.append(now, np.zeros(-len(now) % BLOCK, dtype=np.uint32))
        for block in range(0, len(now), BLOCK):
            self.blocks.append(self.at + block // 64 * self.width * 8)
        self.stream.write(packed(now, self.width).astype("<u8").tobytes())
        self.at += len(now) // 64 * self.width * 8
        self.held, self.n = [rest.tobytes()], len(rest)

    def close(self) -> int:
        if self.n:
            self._flush(self.n)
        parts = [[x or 0 for x in self.docs], [x is None for x in self.docs], self.starts, self.blocks]
        footer = b"".join(np.asarray(x, dtype="<i8").tobytes() for x in parts)
        self.stream.write(footer + np.array([self.width, BLOCK, len(self.docs), len(self.blocks), len(footer)], dtype="<i8").tobytes())
        self.stream.close()
        return self.starts[-1]


class PackedReader:
    def __init__(self, source):
        """source: a file opened for random access."""
        self.source = source
        size = source.size()
        self.width, self.block, docs, blocks, footer = np.frombuffer(source.read_at(40, size - 40), dtype="<i8").tolist()
        if source.read_at(8, 0) != MAGIC:
            raise ValueError("not a file of packed ids")
        parts = np.frombuffer(source.read_at(footer, size - 40 - footer), dtype="<i8")
        ids, null, self.starts, self.offsets = np.split(parts, np.cumsum([docs, docs, docs + 1]))
        self.docs = [None if z else x for x, z in zip(ids.tolist(), null.tolist())]

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids of positions start to stop."""
        if start >= stop:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        nbytes = self.block // 64 * self.width * 8
        raw = self.source.read_at(int(self.offsets[last]) + nbytes - int(self.offsets[first]), int(self.offsets[first]))
        return unpacked(np.frombuffer(raw, dtype="<u8"), self.width)[start - first * self.block : stop - first * self.block]

    def documents(self, most: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start, ids) of every document, reading about `most` ids at a time."""
        k, starts = 0, self.starts.tolist()
        while k < len(self.docs):
            to = max(k + 1, int(np.searchsorted(self.starts, starts[k] + most, "right")) - 1)
            to = min(to, len(self.docs))
            ids = self.ids(starts[k], starts[to])
            for d in range(k, to):
                yield self.docs[d], starts[d], ids[starts[d] - starts[k] : starts[d + 1] - starts[k]]
            k = to


#: The pre-tokenizer's rule for text up to U+024F, whose white space is written out.
_BLANK = r"\t-\r \x85\xa0"
_TOKEN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_BLANK}\p{{L}}\p{{N}}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+")


#: A blank that white space follows, or the end.
_UNEVEN = re.compile(r" (?=\s|\Z)")


def byte_characters() -> dict[int, str]:
    """The character that byte-level vocabularies write for each byte: itself if it shows, else one from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class WordIds:
    """Ids of a tokenizers model, word by word.

    A text may be cut before every blank that a character other than white space follows, as the pre-tokenizer always begins
    a new token there. What lies between two cuts is looked up in a cache; what isn't there is cut into tokens as the
    pre-tokenizer does and given to the library's model, or to the whole library if it has characters beyond U+024F or the
    file's pre-tokenizer isn't the byte-level one.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.width = width_of(self.library.get_vocab_size())
        rules = json.loads(self.library.to_str())
        added = sorted(rules["added_tokens"], key=lambda t: -len(t["content"]))
        self.added = {t["content"]: np.array([t["id"]], dtype="<u4").tobytes() for t in added}
        self.apart = re.compile("|".join(re.escape(t["content"]) for t in added)) if added else None
        #: Whether added tokens stand for their characters alone, so that a text may be cut at them: the longest of those that begin first.
        self.bare = not any(t[x] for t in added for x in ("single_word", "lstrip", "rstrip"))
        self.plain = (rules["pre_tokenizer"] or {}).get("type") == "ByteLevel" and not rules["pre_tokenizer"]["add_prefix_space"] and rules["normalizer"] is None
        self.tokenize, self.shown = self.library.model.tokenize, byte_characters()
        self.tokens = WordCache(self._token, 150_000)
        self.words = WordCache(self._word, 50_000)
        self.spaced = WordCache(self._after_blank, 600_000)  # words after a blank, without it

    def _token(self, token: str) -> bytes:
        if token.isascii() and token.isprintable() and not token.isspace():
            shown = "\u0120" + token[1:] if token[0] == " " else token
        else:
            shown = token.encode().decode("latin-1").translate(self.shown)
        return self._ids(shown)

    def _word(self, word: str) -> bytes:
        if self.plain and (word.isascii() or max(word) < "\u0250"):
            parts = _TOKEN.findall(word)
            return self._token(word) if len(parts) == 1 else b"".join(map(self.tokens.__getitem__, parts))
        return self._whole(word)

    def _after_blank(self, word: str) -> bytes:
        if self.plain and word.isascii() and word.isalpha():  # one token of the pre-tokenizer's
            return self._ids("\u0120" + word)
        return self._word(" " + word)

    def _ids(self, shown: str) -> bytes:
        ids = array("I", [x.id for x in self.tokenize(shown)])
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as unsigned 32-bit little-endian; equal to encoding the whole text at once. Added tokens in the text become their ids, as in the library."""
        if self.apart is None or not self.apart.search(text):
            return self._stretch(text)
        if not self.bare:
            return self._whole(text)
        out, at = [], 0
        for m in self.apart.finditer(text):
            out += [self._stretch(text[at : m.start()]), self.added[m.group()]]
            at = m.end()
        return b"".join(out) + self._stretch(text[at:])

    def _stretch(self, text: str) -> bytes:
        """Ids of a text without added tokens."""
        if not text:
            return b""
        first, *rest = text.split(" ")
        if not _UNEVEN.search(text):
            return self.words[first] + b"".join(map(self.spaced.__getitem__, rest))
        out, now = [], first
        for x in [*rest, "."]:  # the last only ends what is open
            if x and not x[0].isspace():
                out.append(self.spaced[now[1:]] if now[:1] == " " and now[1:2] not in ("", " ") else self.words[now])
                now = " " + x
            else:
                now += " " + x
        return b"".join(out)


_MODELS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _MODELS:
        _MODELS[path] = WordIds(path)
    return _MODELS[path]


def opened(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a URI or absolute path, as workers reach it."""
    return pa.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_packed(documents: DataFrame, tokenizer_path: str, folder: str, end_id: int = 0) -> DataFrame:
    """Encode every text, append end_id, and write files of ascending doc_id ranges: file, part, n_docs, n_ids of each.

    Null texts are empty (one id, the end). A null doc_id sorts first; equal doc_ids keep the order of their texts. A task
    that is run again writes a new file, and the returned table names only files of tasks that counted.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        model, part = word_ids(tokenizer_path), TaskContext.get().partitionId()
        end = np.array([end_id], dtype="<u4").tobytes()
        writer, name = None, f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.ids"
        for batch in batches:
            for piece in pieces(batch):
                for doc_id, text in zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist()):
                    if writer is None:
                        fs, path = opened(name)
                        fs.create_dir(path.rsplit("/", 1)[0])
                        writer = PackedWriter(fs.open_output_stream(path), model.width)
                    writer.add(doc_id, model.encode(text or "") + end)
        if writer is not None:
            n = writer.close()
            yield pa.record_batch({"file": pa.array([name]), "part": pa.array([part], pa.int32()), "n_docs": pa.array([len(writer.docs)], pa.int64()), "n_ids": pa.array([n], pa.int64())})

    lean(documents.sparkSession)
    ordered = with_texts(documents).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(ordered.mapInArrow(released(run), "file string, part int, n_docs long, n_ids long"), "packed-files")


def read_packed(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of the files that write_packed() names: start counts the ids of all files before, too."""
    spark = files.sparkSession
    # One row a file, as many as there were tasks: their order and totals may go through the driver.
    rows = sorted(files.collect(), key=lambda r: r["part"])
    starts = np.cumsum([0, *[r["n_ids"] for r in rows]]).tolist()
    named = spark.createDataFrame([(r["file"], s) for r, s in zip(rows, starts)], "file string, before long").repartition(max(1, len(rows)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                fs, path = opened(x["file"])
                reader = PackedReader(fs.open_input_file(path))
                out = [(d, x["before"] + s, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for d, s, ids in reader.documents()]
                for k in range(0, len(out), 20_000):
                    columns = list(zip(*out[k : k + 20_000]))
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return named.mapInArrow(released(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row of `documents`, read back from the files.

    Null and empty texts are one id, the end. Texts are encoded whole. Null doc_ids come first; rows that repeat a doc_id keep
    the order of their texts. An empty table gives no file and an empty table; other columns play no part.
    """
    files = write_packed(table(spark, sf_dir, "documents"), default_tokenizer(), new_path(spark, "packed-ids"))
    return read_packed(files)
