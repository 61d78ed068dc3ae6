"""The corpus operators on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

from __future__ import annotations

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from accord.llm import bilinear, components, mixing, near_duplicates, nn_descent, packed_ids, pieces_bpe, piecewise, sanitise, toxicity, warc
from accord.llm.common import new_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, size long, base string, full int, ranges string, mark long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", ",", "."]) for _ in range(n))


def texts() -> list[tuple[int | None, str | None]]:
    long = prose(6000, 1)
    rows = [(1, prose(60, 2)), (2, prose(60, 2)), (3, prose(60, 2) + " more"), (4, None), (5, ""), (6, "one two"), (7, "one two"), (8, long), (9, long + " end"), (9, long + " end"), (25, prose(70, 77)), (10, " \t\n "), (11, "aé中 ▁ x"), (None, "no id here"), (12, "x" * 20_000)]
    return rows + [(20 + i, prose(40 + i, 50 + i)) for i in range(20)]


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(i, t, "en", None if i == 8 else f"src{(i or 0) % 3}", len(t or ""), 1, "k", 2, "b", 3, "r", 4) for i, t in texts()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ------------------------------------------------------------------ near duplicates


def brute_components(rows, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if rows[i][0] is not None and rows[i][0] == rows[j][0] and sets[i] and sets[j]:
                root[top(i)] = top(j)
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]) and rows[i][0] is not None and rows[j][0] is not None:
                root[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return sorted(((d, len(s), least.get(top(i), d)) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_match_brute_force(documents, percent):
    got = near_duplicates.near_duplicates(documents, percent).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute_components(texts(), percent)
    assert all(r.kept == (r.doc_id == r.component_id or r.doc_id is None) for r in got)


def test_near_duplicates_blocks_and_empty(spark, empty, monkeypatch):
    assert near_duplicates.near_duplicates(empty).count() == 0
    base = prose(400, 9).split()
    rows = []
    for i in range(60):  # a family in which few are near the first, with buckets cut into several blocks
        w, r = list(base), random.Random(i)
        for k in r.sample(range(400), i % 9):
            w[k] = f"w{i}x{k}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(near_duplicates, "BLOCK", 8)
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute_components(rows, 85)


def test_deduplicated_keeps_one_of_each(documents):
    kept = near_duplicates.deduplicated(documents).collect()
    ids = [r.doc_id for r in kept]
    assert len([i for i in ids if i is not None]) == len({i for i in ids if i is not None})
    assert {1, 4, 5, 6, 8, 10, 11, 12, None} <= set(ids) and not {2, 7, 9} & set(ids)


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100), (102, 101), (101, 102)], "a long, b long")
    got = {r.id: r.component for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {101: 101, 102: 101}


# ------------------------------------------------------------------ personal data


def test_base_spans_match_plain_rules():
    def plain(t):
        out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            d = re.sub("[^0-9]", "", m.group())
            s = sum(v - 9 * (v > 9) for v in (int(c) * (1 + k % 2) for k, c in enumerate(reversed(d))))
            if 12 <= len(d) <= 19 and s % 10 == 0:
                out.append((m.start(), 2, m.end()))
        out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
        return sorted(out)

    r = random.Random(3)
    parts = list("aB1234567890..@@+-- ()%_é") + ["10.0.0.1", "4111111111111111", "a@b.co", "+1 (555) 123-4567", "255.", "00"]
    for _ in range(20_000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 30)))
        assert sanitise.base_spans(t) == plain(t), t
    assert sanitise.base_spans("1" * 100_000 + "a" * 100_000 + "@") == []


def test_query_of_personal_data(spark, tmp_path):
    rows = [(1, "a@b.co and c@d.org from 10.0.0.1"), (2, "4111 1111 1111 1111"), (3, "+1 (555) 123-4567 or 1.2.3.4"), (4, None), (5, ""), (2, "4111 1111 1111 1111"), (None, "x@y.zz")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sanitise.op2_sanitise(spark, str(tmp_path)).collect()
    want = []
    for d, t in rows:
        base = sanitise.base_spans(t or "")
        text = ",".join(f"{sanitise.KINDS[k]}:{a}:{b}" for a, k, b in base)
        want.append((d, *(sum(k == kind for _, k, _ in base) for kind in range(4)), hashlib.sha256(text.encode()).hexdigest(), text))
    assert sorted(((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, ",".join(s for s in r.spans.split(",") if not s.startswith("term"))) for r in got), key=repr) == sorted(want, key=repr)


def test_disclosing_words_go(spark, empty):
    rows = [(i, f"call 4111 1111 1111 1111 for Zyxwvu today {WORDS[i % 24]}") for i in range(6)] + [(10 + i, f"today is a day for {WORDS[i % 24]} {prose(20, i)}") for i in range(60)] + [(99, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("base", F.lit("clash")).withColumn("terms", F.lit(1))
    got = {r.doc_id: r for r in sanitise.personal_spans(docs).collect()}
    assert len(got[0].base) == 1 and [rows[0][1][t.start : t.end] for t in got[0].terms] == ["call", "Zyxwvu"]
    clean = {r.doc_id: r for r in sanitise.sanitised(docs).collect()}
    assert "4111" not in clean[0].text and "Zyxwvu" not in clean[0].text and "today" in clean[0].text
    assert all(clean[i].text == t for i, t in rows if i >= 10) and clean[0].base == "clash"
    assert sanitise.sanitised(empty).count() == 0 and sanitise.personal_spans(empty).count() == 0


def test_words_by_an_entity_of_one_document(spark):
    rows = [(0, "write today to Qwertz at a.b@c.org")] + [(1 + i, f"write today to {WORDS[i % 24]} at noon") for i in range(99)]
    got = {r.doc_id: r for r in sanitise.personal_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [rows[0][1][t.start : t.end] for t in got[0].terms] == ["Qwertz"] and not any(got[i].terms for i in range(1, 100))


def test_disclosing_words_go_everywhere(spark):
    filler = " ".join(WORDS * 3)
    rows = [(0, f"Qwertz came. {filler} QWERTZ paid by a.b@c.org and c.d@c.org {filler} qwertz"), (1, f"alpha Qwertz beta {filler}")] + [(2 + i, f"came paid and {filler}") for i in range(998)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in sanitise.personal_spans(docs).collect()}
    assert [rows[0][1][t.start : t.end] for t in got[0].terms] == ["Qwertz", "QWERTZ", "qwertz"]
    assert [rows[1][1][t.start : t.end] for t in got[1].terms] == ["Qwertz"] and not any(got[i].terms for i in range(2, 1000))
    clean = {r.doc_id: r.text for r in sanitise.sanitised(docs).collect()}
    assert not any("qwertz" in clean[i].lower() or "@" in clean[i] for i in (0, 1)) and all(clean[i] == rows[i][1] for i in range(2, 1000))


# ------------------------------------------------------------------ fingerprints


def test_piecewise_rows_and_next(documents, empty):
    got = piecewise.fingerprints(documents).collect()
    rows = sorted(texts(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = []
    for k, (d, t) in enumerate(rows):
        t, n = t or "", rows[(k + 1) % len(rows)][1] or ""
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        want.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), piecewise.fingerprint(t.encode())))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint) for r in got), key=repr) == sorted(want, key=repr)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert piecewise.fingerprints(empty).count() == 0


def test_piecewise_likeness():
    a = prose(2000, 1)
    b = a[:5000] + " inserted words here " + a[5000:]
    mark = lambda t: piecewise.fingerprint(t.encode())
    assert piecewise.likeness(mark(a), mark(a)) == 1 and piecewise.likeness(mark(a), mark(b)) > 0.8
    assert piecewise.likeness(mark(a), mark(prose(2000, 2))) < 0.3

    def slow(x, y):
        row = [0] * (len(y) + 1)
        for c in x:
            last = 0
            for j, d in enumerate(y):
                last, row[j + 1] = row[j + 1], last + 1 if c == d else max(row[j + 1], row[j])
        return row[-1]

    r = random.Random(1)
    for _ in range(300):
        x, y = ("".join(r.choice("abc") for _ in range(r.randint(0, 40))) for _ in range(2))
        assert piecewise.common_length(x, y) == slow(x, y)


# ------------------------------------------------------------------ language model


def test_language_model(documents, empty):
    train = F.coalesce("doc_id", F.lit(0)) % 2 == 0
    got = bilinear.scored(documents, train).collect()
    counts: dict[bytes, int] = {}
    for d, t in texts():
        if (d or 0) % 2 == 0:
            for w in [*(t or "").encode().lower().split(), b""]:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    want = []
    for d, t in texts():
        w = [*(t or "").encode().lower().split(), b""]
        want.append((d, len(w), sum(x in counts for x in w), n, round(sum(np.log10((counts.get(x, 0) + 1) / (n + v + 1)) for x in w), 6)))
    assert sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r.score < 0 for r in got)
    alone = bilinear.scored(documents, F.lit(False)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in alone)
    assert bilinear.scored(empty, train).count() == 0


def test_language_model_scores_ignore_the_layout(documents, monkeypatch):
    monkeypatch.setattr(bilinear, "SHARE", 20_000)
    train = F.coalesce("doc_id", F.lit(0)) % 2 == 0
    few, many = (sorted(((r.doc_id, r.n_tokens, r.score) for r in bilinear.scored(documents.repartition(n), train).collect()), key=repr) for n in (1, 5))
    assert [x[:2] for x in few] == [x[:2] for x in many] and np.allclose([x[2] for x in few], [x[2] for x in many], rtol=1e-4)


def test_contexts():
    s = np.array([700, 3, 700, 701, 5, 702, 0, 703, 0, 7, 0])
    far, near = bilinear.contexts(s)
    assert near.tolist() == [0, 700, 3, 700, 701, 5, 702, 0, 703, 0, 7]
    assert far.tolist() == [0, 0, 0, 3, 3, 3, 5, 0, 0, 0, 0]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_language_model_beats_unigrams_on_held_out_texts(spark):
    r = bilinear.op5_bilinear_scores(spark, "/root/testdata/sf0.1").filter("held_out").agg(F.sum("n_tokens"), F.sum("score"), F.sum("base_score")).first()
    assert (r[1] - r[2]) / r[0] >= 0.3


def test_language_model_is_normalised(documents):
    counts = bilinear.counted(documents)
    vocabulary = bilinear.Vocabulary(counts)
    model = bilinear.trained(bilinear.symbolised(documents.withColumn("training", F.lit(True)), vocabulary), vocabulary)
    far, near, z = model.tables(vocabulary.open)
    for a, b in ((0, 0), (1, 2), (300, 5)):
        assert abs((10 ** (far[a] + near[b] - z[a, b]).astype(np.float64)).sum() - 1) < 1e-4
    # Within a class: seen words and one slot for all unseen ones.
    rows = [r for r in counts.collect() if r["word"] and r["word"].encode() not in vocabulary.symbols]
    for k in {r["class"] for r in rows}:
        seen = sum(r["c"] + 1 for r in rows if r["class"] == k)
        assert abs((seen + 1) / 10 ** vocabulary.within[k] - 1) < 1e-9


# ------------------------------------------------------------------ ids


@pytest.mark.parametrize("width", [1, 7, 15, 16, 17, 31, 32])
def test_packing_round_trip(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 64 * 9).astype(np.uint32)
    words = packed_ids.packed(ids, width)
    assert len(words) == 9 * width and (packed_ids.unpacked(words, width) == ids).all()


def test_packed_files(spark, documents, empty):
    path = packed_ids.default_tokenizer()
    model = Tokenizer.from_file(path)
    files = packed_ids.write_packed(documents, path, new_path(spark, "test-ids"))
    got = sorted(packed_ids.read_packed(files).collect(), key=lambda r: r.start)
    start, want = 0, []
    for d, t in sorted(texts(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert [tuple(r) for r in got] == want
    none = packed_ids.write_packed(empty, path, new_path(spark, "test-ids"))
    assert packed_ids.read_packed(none).count() == 0


def test_word_ids_match_library():
    model, library = packed_ids.word_ids(packed_ids.default_tokenizer()), Tokenizer.from_file(packed_ids.default_tokenizer())
    assert np.frombuffer(model.encode("a<|endoftext|>b"), "<u4").tolist() == [64, 50256, 65]
    r = random.Random(1)
    parts = list("Āƀɏɐ²½ªßñĳ\x1f\x0b  aabcdet\n\t'.,!▁éß中ﬁ①\x00 \xa0\x1c\x85  ") + ["the", "ing", "   ", "'s", "\r\n", "　", "10", '"', "<|endoftext|>", "<|endoftext|>", "x" * 100]
    for _ in range(5000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 20)))
        assert model.encode(t) == np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


def test_pieces_match_library(documents, empty):
    model = pieces_bpe.encoder(pieces_bpe.default_model())
    r = random.Random(1)
    parts = list("  aabcdet\n\t'.,!▁éß中ﬁ①\x00 ▁▁  𝒳") + ["the", "ing", "       ", "aaaa", "\r\n", "　", '"', "1000"]
    for _ in range(5000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 30)))
        assert model.encode(t) == model.model.encode(t), t
    for word in ("abracadabra", "ththth", "aaaaaaa", "incomprehensibilities"):
        assert [model.ids[p] for p in model.merged("▁" + word)] == model.encode(word)
    for long in ("x" * 30_000, "ab" * 20_000, "".join(r.choice("abcdefgh中é") for _ in range(30_000)), "incomprehensibilities" * 1500):
        assert model.encode(long) == model.model.encode(long)
    got = pieces_bpe.encoded(documents, pieces_bpe.default_model()).collect()
    assert sorted(((r.doc_id, r.ids, r.decoded) for r in got), key=repr) == sorted(((d, model.model.encode(t or ""), model.model.decode(model.model.encode(t or ""))) for d, t in texts()), key=repr)
    digests = {(r.doc_id, r.n_tokens, r.ids_sha256) for r in pieces_bpe.encoded_digests(documents, pieces_bpe.default_model()).collect()}
    assert digests == {(r.doc_id, len(r.ids), hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest()) for r in got}
    assert pieces_bpe.encoded_digests(empty, pieces_bpe.default_model()).count() == 0


# ------------------------------------------------------------------ archives


def test_archives(spark):
    big, other = "é" * 600, "<p>" + "x" * 2000
    rows = [(1, "http://a", big), (2, "http://b\r\nX: y", big), (3, None, big), (4, "http://d", other), (5, "http://e", "small"), (6, "http://f", "small"), (7, "http://g", None), (7, "http://g", None), (8, "u", other), (8, "u", other)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha1", F.lit("clash")).repartition(3)
    got = warc.read_archives(warc.write_archives(pages, new_path(spark, "test-warc"))).collect()
    top = {1: 3, 2: 3, 4: 8}
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if i in top else "response", top.get(i)))
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got if r.refers_to) == sorted(x for x in want if x[4])
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type) for r in got) == sorted(x[:4] for x in want)
    again = warc.read_archives(warc.write_archives(warc.read_archives(warc.write_archives(pages, new_path(spark, "test-warc"))), new_path(spark, "test-warc"))).collect()
    assert sorted((r.page_id, r.payload_digest, r.record_type) for r in again) == sorted((r.page_id, r.payload_digest, r.record_type) for r in got)
    none = spark.createDataFrame([], pages.schema)
    assert warc.read_archives(warc.write_archives(none, new_path(spark, "test-warc"))).count() == 0


# ------------------------------------------------------------------ toxicity


def test_maximal_segments_match_recursion():
    def slow(s, at=0):
        best, span = 0, None
        for i in range(len(s)):
            total = 0
            for j in range(i, len(s)):
                total += s[j]
                if total > best:
                    best, span = total, (i, j + 1)
        if span is None:
            return []
        i, j = span
        return slow(s[:i], at) + [(at + i, at + j, best)] + slow(s[j:], at + j)

    r = random.Random(5)
    for _ in range(1500):
        s = [r.choice([-3, -2, -1, -1, 1, 2, 3]) + r.random() / 8 for _ in range(r.randint(0, 24))]
        got = toxicity.maximal_segments(np.array(s))
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in slow(s)]
        assert np.allclose([x for _, _, x in got], [x for _, _, x in slow(s)])


def test_toxicity_learns_and_degrades(spark, empty):
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        rows.append((i, prose(80, i) + (" you vile scoundrel, vile knave " if bad else " fine ") + prose(20, i + 1000)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows + [(1000, None), (1001, "")], "doc_id long, text string").withColumn("toxic", F.lit(9))
    labelled = spark.createDataFrame(labels + [(0, None), (None, 1), (5, 1)], "doc_id long, toxic int")
    model = toxicity.learned(docs, labelled)
    got = {r.doc_id: r for r in toxicity.scored(docs, model, with_segments=True).collect()}
    assert all(got[i].predicted == y for i, y in labels)
    assert all(0 <= r.score <= 1 for r in got.values()) and got[1000].predicted == 0
    assert got[0].segments and got[0].segments[0].end > 80
    left = toxicity.without_toxic(docs, model)
    assert left.columns == docs.columns and left.count() == sum(1 for _, y in labels if not y) + 2
    many = docs.filter("doc_id < 60")  # few toxic documents are enough
    few = toxicity.learned(many, labelled)
    assert {i for i, y in labels[:60] if y} == {r.doc_id for r in toxicity.scored(many, few).collect() if r.predicted}
    assert toxicity.scored(docs.union(docs), model).groupBy("doc_id").agg(F.countDistinct("score").alias("n")).filter("n > 1").count() == 0
    none = toxicity.learned(docs, labelled.limit(0))
    assert {r.score for r in toxicity.scored(docs, none).collect()} == {0.5}
    assert toxicity.scored(empty, model).count() == 0


def test_log_odds_and_rate_match_plain_versions(spark):
    r = random.Random(7)
    rows = [(i, " ".join(r.choice(WORDS) for _ in range(30)) + (" scum trash" if i % 4 == 0 and r.random() < 0.8 else ""), int(i % 4 == 0)) for i in range(200)]
    model = toxicity.fitted(spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(3))
    seen: dict[str, list[int]] = {}
    total = [0, 0]
    for _, t, y in rows:
        distinct = set(toxicity.words(t))
        total[y] += len(distinct)
        for f in {f for w in distinct for f in toxicity.forms(w)}:
            seen.setdefault(f, [0, 0])[y] += 1
    want = {}
    for f, (c, t) in seen.items():
        ratio, deviation = toxicity.log_odds(t, c, total[1], total[0], len(rows))
        if abs(ratio / deviation) > toxicity.CAUTION:
            want[f] = (toxicity.cautious(ratio, deviation), ratio / deviation)
    assert set(model["forms"]) == set(want)
    assert all(np.allclose(model["forms"][f], want[f]) for f in want)
    scores = [(-0.3, 900), (0.5, 30), (2.0, 3)]
    rate = toxicity.rate_of(scores, 3.0)
    mean = (sum(n * np.exp(rate * s) for s, n in scores) + 0.5 * np.exp(rate * 3.0)) / 933.5
    assert abs(mean - 1) < 1e-6
    points = [(x / 4, int(x + 8 * r.random() > 6), 1 + x % 3) for x in range(-10, 20)]
    a, b = toxicity.logistic(points, 0.3)
    loss = lambda a, b: sum(w * (np.logaddexp(0, -(a + b * x)) if y else np.logaddexp(0, a + b * x)) for x, y, w in points) + 0.005 * b * b
    assert all(loss(a, b) <= loss(a + da, b + db) + 1e-9 for da in (-0.05, 0, 0.05) for db in (-0.05, 0, 0.05))


# ------------------------------------------------------------------ mixing


def test_targets_and_seats():
    assert mixing.targets([100, 100, 100], [1, 2, 3]) == [50, 100, 150]
    assert mixing.targets([10, 1000], [2, 1]) == [30, 980]
    assert mixing.targets([], []) == [] and mixing.targets([0, 5], [1, 2]) == [0, 5]

    def slow(w, seats):
        got = [0] * len(w)
        for _ in range(seats):
            k = max(range(len(w)), key=lambda i: (w[i] / (2 * got[i] + 1), -i))
            got[k] += 1
        return got

    r = random.Random(2)
    for _ in range(300):
        w = [float(r.randint(0, 50)) for _ in range(r.randint(1, 8))]
        seats = r.randint(0, 120)
        assert mixing.apportioned(w, seats) == (slow(w, seats) if sum(w) else [0] * len(w))


def test_mix(spark, documents, empty):
    got = mixing.mixed(documents).collect()
    sizes = sorted(len((t or "").encode().split()) for _, t in texts())
    assert sorted(r.size for r in got) == sizes and all(0 <= r.taken <= 3 * r.size for r in got)
    by = {}
    for r in got:
        t = by.setdefault((r.source_size, r.target), [0])
        t[0] += r.taken
    assert all(abs(t[0] - target) <= 1 for (_, target), t in by.items())
    again = mixing.mixed(documents.repartition(7)).collect()
    assert sorted((r.doc_id or 0, r.size, r.taken) for r in got) == sorted((r.doc_id or 0, r.size, r.taken) for r in again)
    mix = mixing.mixture(documents)
    assert mix.columns == documents.columns
    words = sum(len((r.text or "").encode().split()) for r in mix.collect())
    assert words == sum(r.taken for r in got)
    assert mixing.mixed(empty).count() == 0 and mixing.mixture(empty).count() == 0


def test_mix_of_small_sources_and_chosen_words(spark):
    rows = [(i, " ".join(f"{i}w{k}" for k in range(40)), "a") for i in range(25)]
    rows += [(100, " ".join(f"bw{k}" for k in range(10)), "b"), (101, " ".join(f"cw{k}" for k in range(40)), "c"), (None, "x y", None), (None, "z", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = {r.source: r.taken for r in mixing.mixed(docs, ("source",)).groupBy(F.col("carried__source").alias("source")).agg(F.sum("taken").alias("taken")).collect()}
    assert (taken["b"], taken["c"], sum(taken.values())) == (30, 120, 1053)
    # Against a plain version: the runs of each shard in permuted order, word by word.
    got = mixing.mixed(docs, ("text", "source")).collect()
    mix = sorted(w for r in mixing.mixture(docs).collect() for w in (r.text or "").split())
    want = []
    for r in got:
        words = (r.carried__text or "").split()
        want += words * r.full + [w for a, b in r.ranges for w in words[a:b]]
        assert r.taken == r.full * r.size + sum(b - a for a, b in r.ranges) and r.taken <= 3 * r.size
    assert mix == sorted(want)


def test_chosen_blocks_match_plain_permutation(spark):
    import math

    import pandas as pd

    docs = spark.createDataFrame([(i, " ".join("w" * (1 + i * k % 7) for k in range(i * 13 % 90)), f"s{i % 3}") for i in range(200)], "doc_id long, text string, source string")
    rows = mixing.mixed(docs, ("source",)).collect()
    order = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(20)).alias("h")).collect()}
    for place, source in enumerate(("s0", "s1", "s2")):
        own = sorted((r for r in rows if r["carried__source"] == source and r.size), key=lambda r: order[r.doc_id])
        n = sum(r.size for r in own)
        sizes = [sum(r.size for r in rows if r["carried__source"] == f"s{k}") for k in range(3)]
        goal = mixing.targets(sizes, [1, 2, 3])
        seats = mixing.apportioned(goal, round(sum(goal)))[place]
        q = mixing._quotas(pd.DataFrame({"place": [place], "shard": [0], "words": [n], "seats": [seats]}), 20).iloc[0]
        blocks = math.ceil(n / mixing.BLOCK)
        turn = sorted(range(blocks), key=lambda b: (b * q["step"] + q["shift"]) % blocks)
        chosen = [w for b in turn for w in range(b * mixing.BLOCK, min(n, (b + 1) * mixing.BLOCK))][: q["rest"]]
        got, at = [], 0
        for r in own:
            got += [at + w for a, b in r.ranges for w in range(a, b)]
            at += r.size
            assert r.full == q["full"]
        assert sorted(chosen) == got and q["full"] * n + q["rest"] == seats


def test_cut():
    assert mixing.cut(" a b\tc  d e ", [(0, 2), (3, 4)]) == "a b\nd" and mixing.cut("a b c", [(0, 1), (1, 3)]) == "a b c"


# ------------------------------------------------------------------ neighbours


def test_nearest(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(400, 16)).astype(np.float32)
    x[100:160] = x[7]  # a group of copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(500, None), (501, [0.0] * 16), (502, [float("nan")] * 16), (503, [None] * 16), (504, [1.0, 2.0]), (None, [1.0] * 16), (505, (x[3] * 1e30).tolist())]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("node", F.lit("clash")).repartition(5)
    got = nn_descent.nearest(table, lambda v: v % 20 == 0).collect()
    kept = {i: np.array(v, dtype=np.float64) for i, v in rows if i is not None and i not in (500, 501, 502, 503, 504)}
    ids = np.array(sorted(kept))
    m = np.stack([kept[i] for i in ids])
    hit = n = 0
    for q in [i for i in ids if i % 20 == 0]:
        s = nn_descent.cosine(kept[q], m)
        s[ids == q] = -9
        order = np.lexsort((ids, -s))[:5]
        mine = sorted((g for g in got if g.query_id == q), key=lambda g: g["rank"])
        assert [g["rank"] for g in mine] == [1, 2, 3, 4, 5]
        hit += len({g.vec_id for g in mine} & set(ids[order].tolist()))
        n += 5
        assert np.allclose([g.score for g in mine], [s[np.searchsorted(ids, g.vec_id)] for g in mine], atol=1e-12)
    assert hit / n >= 0.95
    few = nn_descent.nearest(table.filter("vec_id in (1, 2, 20)"), lambda v: v % 20 == 0).collect()
    assert sorted(g.vec_id for g in few) == [1, 2]
    assert nn_descent.nearest(table.limit(0), lambda v: v % 20 == 0).count() == 0
    assert nn_descent.nearest(table.filter("vec_id = 20"), lambda v: v % 20 == 0).count() == 0


def test_neighbour_rounds_go_on_until_settled(spark, monkeypatch):
    for name, value in (("TREES", 1), ("LEAF", 4), ("NEIGHBOURS", 8), ("SETTLED", 0)):
        monkeypatch.setattr(nn_descent, name, value)
    x = np.random.default_rng(6).normal(size=(3000, 16))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    graph = nn_descent.neighbour_graph(nn_descent._nodes(table, 16, 6), 16)
    assert graph.agg(F.sum("changed")).first()[0] == 0
    assert nn_descent.sizes(3000) < nn_descent.sizes(100_000) < nn_descent.sizes(10_000_000)


def test_nearest_among_near_copies(spark):
    r = np.random.default_rng(8)
    x = (r.normal(size=24) + 0.001 * r.normal(size=(1500, 24))).astype(np.float32)
    x[700:800] = x[3] * np.arange(1, 101, dtype=np.float32)[:, None]  # one direction, many vectors: more ties than a pool holds
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = nn_descent.nearest(table, lambda v: v % 50 == 0).collect()
    m, hit = x.astype(np.float64), 0
    for q in range(0, 1500, 50):
        s = nn_descent.cosine(m[q], m)
        s[q] = -9
        hit += len({g.vec_id for g in got if g.query_id == q} & set(np.lexsort((np.arange(1500), -s))[:5].tolist()))
    assert hit / 150 >= 0.95


# ------------------------------------------------------------------ the pipeline


def test_pipeline_stages(spark, tmp_path, documents):
    import corpus_pipeline

    labels = spark.createDataFrame([(20 + i, int(i == 3)) for i in range(20)], "doc_id long, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = documents
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == documents.columns
            path = str(tmp_path / name)
            out.write.parquet(path)
            docs = spark.read.parquet(path)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() == docs.count() > 0


def test_executors_give_memory_back_before_a_stage(spark, monkeypatch):
    import corpus_pipeline
    from accord.llm import common

    run = spark._jvm.java.lang.Runtime.getRuntime()
    garbage = spark._jvm.java.io.ByteArrayOutputStream(200_000_000)
    before = run.totalMemory() - run.freeMemory()
    del garbage
    common.rested(spark)
    assert run.totalMemory() - run.freeMemory() < before - 100_000_000
    rests = []
    monkeypatch.setattr(common, "rested", rests.append)
    for module, name in ((near_duplicates, "deduplicated"), (sanitise, "sanitised"), (mixing, "mixture"), (pieces_bpe, "encoded_digests")):
        monkeypatch.setattr(module, name, lambda docs, *_, **__: docs)
    monkeypatch.setattr(pieces_bpe, "default_model", lambda: None)
    for _, stage in corpus_pipeline.STAGES[1:]:
        stage(spark, None, "")
    assert rests == [spark] * 4
