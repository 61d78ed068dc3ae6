"""Information-theoretic sanitisation of personal data.

Emails, IP addresses, card and phone numbers are found by rule and are the protected entities. For each entity c and word t
of its documents, document counts over the whole corpus give PMI(c; t) = log2(p(t | c) / p(t)), and its share of the entity's
information IC(c) = -log2 p(c) says how much of the entity the word discloses: 1 if whoever reads t knows c. p(t | c) is
shrunk towards p(t) by half a document of prior, so that an entity of one document has an estimate, and a careful one. Words
whose share exceeds a threshold for some entity are generalised to their kind wherever they stand, in documents without an
entity too, and those beyond a higher one are removed.

Entities that stand in the same documents disclose alike and are counted as one class, so pairs don't multiply within a
document; words too common to disclose any entity are left out before pairs are made.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from accord.llm.common import mapped, table, written

KINDS = ("email", "ip", "card", "phone", "term")
#: Documents that the corpus share of a word counts for beside those of an entity.
PRIOR = 0.5
#: Share of an entity's information from which a word near it is generalised, and removed.
GENERALISE, REMOVE = 0.8, 0.95

#: Put before the names of columns that are joined to documents, so that they clash with none of theirs.
OWN = "sanitise__"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_TERM = re.compile(r"[^\W\d_]{3,}")


def luhn(digits: str) -> bool:
    """Whether the sum with every second digit from the right doubled (less 9 if above 9) is a multiple of 10."""
    total = sum(map(int, digits[-1::-2])) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(x)] for x in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> Iterable[tuple[int, int]]:
    """Matches of the email rule, found from each @, so that long runs of its characters cost linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            done = match.end()
            yield start, done
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the entities of a text, in order; kind counts KINDS, positions are code points. Matches that fail their test are dropped, without another try."""
    found = [(a, 0, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.groups()):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37:
            digits = _NOT_DIGIT.sub("", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def entity(text: str, start: int, kind: int, end: int) -> str:
    """What identifies an entity: its kind and its text without differences of case or of separators."""
    own = text[start:end]
    return f"{KINDS[kind]}:{own.lower() if kind == 0 else own if kind == 1 else _NOT_DIGIT.sub('', own)}"


def words(text: str) -> set[str]:
    """The words of three letters and more of a text, in lower case."""
    return {w.lower() for w in set(_TERM.findall(text))}


def free(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with its entities blanked, so that positions stay."""
    out, at = [], 0
    for a, _, b in spans:
        if b > at:
            out += [text[at : max(a, at)], " " * (b - max(a, at))]
            at = b
    return "".join(out) + text[at:]


_SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
_FOUND = "doc_id long, mark long, base array<struct<start: int, kind: int, end: int>>, entities array<string>, words array<string>, base_sha256 string"


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _find(batch: pa.RecordBatch) -> pa.RecordBatch:
    base, entities, terms, digests = [], [], [], []
    for text in batch.column("text").to_pylist():
        text = text or ""
        spans = base_spans(text)
        base.append([{"start": a, "kind": k, "end": b} for a, k, b in spans])
        digests.append(hashlib.sha256(joined(spans).encode()).hexdigest())
        entities.append(sorted({entity(text, a, k, b) for a, k, b in spans}))
        terms.append(sorted(words(free(text, spans))) if spans else [])
    return pa.record_batch({"doc_id": batch.column("doc_id"), "mark": batch.column("mark"), "base": pa.array(base, pa.list_(_SPAN)), "entities": pa.array(entities, pa.list_(pa.string())), "words": pa.array(terms, pa.list_(pa.string())), "base_sha256": pa.array(digests, pa.string())})


def _marked(documents: DataFrame, *others: str) -> DataFrame:
    text = F.col("text").cast("string")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("mark"), *others)


def _document_counts(marked: DataFrame) -> DataFrame:
    """term, df: the documents of the whole corpus that hold each word."""

    def tally(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: dict[str, int] = {}
        for text in batch.column("text").to_pylist():
            for w in words(text or ""):
                out[w] = out.get(w, 0) + 1
        return pa.record_batch({"term": pa.array(list(out), pa.string()), "n": pa.array(list(out.values()), pa.int64())})

    return mapped(marked.select("text"), tally, "term string, n long").groupBy("term").agg(F.sum("n").alias("df"))


def disclosures(found: DataFrame, marked: DataFrame) -> DataFrame:
    """term, share of the words whose largest share is above GENERALISE, from document counts over the whole corpus."""
    n = float(found.count())
    held = found.filter("size(entities) > 0")
    own = F.xxhash64("doc_id", "mark")
    # The sum of the hashes of its documents tells an entity's class; rows that are equal in all count each.
    of_row = held.select(own.alias("row"), F.explode("entities").alias("entity"))
    classes = of_row.groupBy("entity").agg(F.count(F.lit(1)).alias("held_by"), F.sum(F.col("row").cast("decimal(20,0)")).cast("string").alias("class"))
    classes = written(classes.filter(F.col("held_by") < n), "classes")
    most = classes.agg(F.max("held_by")).first()[0]
    if not most:
        return found.sparkSession.createDataFrame([], "term string, share double")
    # p(t | c) is 1 at most, so a word in more documents than this discloses no entity; 2 % more, for rounding.
    rare = _document_counts(marked).filter(F.col("df") <= 1.02 * n ** (1 - GENERALISE) * most**GENERALISE)
    # Rows of one doc_id and text have one hash and the same words and entities: they are taken once, with their number.
    rows = held.groupBy(own.alias("row")).agg(F.first("words").alias("words"), F.count(F.lit(1)).alias("copies"))
    terms = rows.select("row", "copies", F.explode("words").alias("term")).join(rare, "term")
    of_class = of_row.distinct().join(classes, "entity").select("row", "class", "held_by").distinct()
    pairs = terms.join(of_class, "row").groupBy("class", "held_by", "term", "df").agg(F.sum("copies").alias("both"))
    of_corpus = F.col("df") / F.lit(n)
    mutual = F.log2((F.col("both") + PRIOR * of_corpus) / ((F.col("held_by") + PRIOR) * of_corpus))
    shares = pairs.select("term", (mutual / F.log2(F.lit(n) / F.col("held_by"))).alias("share")).filter(F.col("share") >= GENERALISE)
    return written(shares.groupBy("term").agg(F.max("share").alias("share")), "disclosures")


def _bitmap(terms: DataFrame) -> np.ndarray:
    """Bits of the hashes of the terms, some sixteen a term up to 2^27 in all: what a text is sifted by before words are joined."""
    bits = 1 << min(27, max(16, (16 * terms.count()).bit_length()))

    def mark(batches):
        out = np.zeros(bits, dtype=bool)
        for batch in batches:
            out[[zlib.crc32(t.encode()) & (bits - 1) for t in batch.column("term").to_pylist()]] = True
        yield pa.record_batch({"bits": pa.array([np.packbits(out, bitorder="little").tobytes()], pa.binary())})

    whole = np.zeros(bits // 8, dtype=np.uint8)
    for row in terms.select("term").coalesce(4).mapInArrow(mark, "bits binary").toLocalIterator():
        whole |= np.frombuffer(row["bits"], dtype=np.uint8)
    return whole


def _occurrences(marked: DataFrame, telling: DataFrame) -> DataFrame:
    """doc_id, mark, term, length, starts of the words of all texts whose hash is that of a telling one, outside entities: a row for each spelling in a text."""
    sieve = _bitmap(telling).tobytes()
    last = 8 * len(sieve) - 1

    def look(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, terms, lengths, starts = [], [], [], []
        for k, text in enumerate(batch.column("text").to_pylist()):
            text, wanted = text or "", set()
            for w in set(_TERM.findall(text)):
                h = zlib.crc32(w.lower().encode()) & last
                if sieve[h >> 3] >> (h & 7) & 1:
                    wanted.add(w)
            if wanted:
                places: dict[str, list[int]] = {}
                for m in _TERM.finditer(free(text, base_spans(text))):
                    if m.group() in wanted:
                        places.setdefault(m.group(), []).append(m.start())
                rows += [k] * len(places)
                terms += [w.lower() for w in places]
                lengths += map(len, places)
                starts += places.values()
        at = pa.array(rows, pa.int64())
        return pa.record_batch({"doc_id": batch.column("doc_id").take(at), "mark": batch.column("mark").take(at), "term": pa.array(terms, pa.string()), "length": pa.array(lengths, pa.int32()), "starts": pa.array(starts, pa.list_(pa.int32()))})

    return mapped(marked, look, "doc_id long, mark long, term string, length int, starts array<int>")


def personal_spans(documents: DataFrame) -> DataFrame:
    """doc_id, mark, base, base_sha256, terms of every document.

    mark: hash of the text, to tell rows with one doc_id apart. base: spans of the entities by rule. terms: (start, end,
    removed) of the words that disclose too much of an entity of any document. Null texts are empty. A corpus of copies counts each copy as a
    document. Other columns play no part.
    """
    marked = _marked(documents)
    found = written(mapped(marked, _find, _FOUND), "personal")
    telling = disclosures(found, marked)
    # No hint: telling words grow with the corpus, and Spark's own threshold is one of bytes.
    hits = _occurrences(marked, telling).join(telling, "term")
    spans = F.transform("starts", lambda a: F.struct(a.alias("start"), (a + F.col("length")).alias("end"), (F.col("share") >= REMOVE).alias("removed")))
    # Rows of one doc_id and text give the same spans.
    terms = hits.groupBy("doc_id", "mark").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(spans)))).alias("terms"))
    other = terms.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "terms")
    out = found.join(other, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark").eqNullSafe(F.col("_mark"))), "left")
    none = F.array().cast("array<struct<start: int, end: int, removed: boolean>>")
    return out.select("doc_id", "mark", "base", "base_sha256", F.coalesce("terms", none).alias("terms"))


def all_spans(base: str = "base", terms: str = "terms") -> Column:
    """kind:start:end of all spans by start and kind, comma-joined."""
    ours = F.transform(terms, lambda t: F.struct(t["start"].alias("start"), F.lit(len(KINDS) - 1).alias("kind"), t["end"].alias("end")))
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(F.concat(F.col(base), ours)), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def rewritten(text: str, base: list[tuple[int, int, int]], terms: list[tuple[int, int, bool]]) -> str:
    """The text with entities replaced by their kind, telling words by a sign for a name or a word, or left out with the blank before them. Where spans overlap, the one that begins first stands, and the longer of two."""
    marks = [(a, -b, f"<{KINDS[k].upper()}>") for a, k, b in base]
    marks += [(a, -b, "" if gone else "<NAME>" if text[a].isupper() else "<WORD>") for a, b, gone in terms]
    out, at = [], 0
    for a, b, sign in sorted(marks):
        if a < at:
            at = max(at, -b)
            continue
        out += [text[at : a - 1] if not sign and a > at and text[a - 1] == " " else text[at:a], sign]
        at = -b
    return "".join(out) + text[at:]


def sanitised(documents: DataFrame) -> DataFrame:
    """documents, with the texts rewritten and n_chars, if there is one, counted anew. A null text stays null."""
    names = documents.columns
    spans = personal_spans(documents).filter("size(base) > 0 or size(terms) > 0").dropDuplicates(["doc_id", "mark"])
    keys = spans.select(*[F.col(c).alias(f"{OWN}{c}") for c in ("doc_id", "mark", "base", "terms")])
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(f"{OWN}doc_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col(f"{OWN}mark"))
    rows = documents.join(keys, same, "left").select(*names, f"{OWN}base", f"{OWN}terms")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text, base, terms in zip(*(batch.column(c).to_pylist() for c in ("text", f"{OWN}base", f"{OWN}terms"))):
            out.append(text if not text or not (base or terms) else rewritten(text, [(s["start"], s["kind"], s["end"]) for s in base], [(t["start"], t["end"], t["removed"]) for t in terms]))
        columns = {c: batch.column(c) for c in names} | {"text": pa.array(out, pa.string())}
        if "n_chars" in names:
            columns["n_chars"] = pa.array([None if x is None else len(x) for x in out], pa.int64()).cast(batch.column("n_chars").type)
        return pa.record_batch(columns)

    return mapped(rows, run, documents.schema)


def _of_kind(kind: int):
    # Of one argument: a second one, even with a default, would be the place in the array.
    return lambda s: s["kind"] == kind


def op2_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term of every row of `documents`.

    Null texts are empty: no spans, the digest of the empty text. Texts are searched whole. Repeated rows come back as often,
    with equal spans; rows with a null doc_id come back, too. Spans that begin together are ordered by kind. A word whose share
    is just GENERALISE counts as disclosing. An empty table gives an empty one; other columns play no part.
    """
    found = personal_spans(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(4)]
    n_terms = F.size("terms").cast("long").alias("n_term")
    return found.select("doc_id", *counts, "base_sha256", all_spans().alias("spans"), n_terms)
