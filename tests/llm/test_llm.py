"""Operators of the training-data pipeline against brute force, round trips and held-out labels."""

import collections
import hashlib
import itertools
import math
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewell.llm import bpe, common, lm, media, mixing, neardup, pii, quality, records, toxicity, warc
from tracewell.llm.common import fold_of, shared_dir
from tracewell.llm.queries import QUERIES, vocabulary

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, media string, ids string, score string, k string"
LONG = "alpha beta gamma delta " * 5000
EDGE = [
    (1, "one two three four five six seven eight", "en", "a", 1, "x", "x", "x", "x"),
    (2, None, None, None, None, None, None, None, None),
    (3, "", "en", "a", 0, "x", "x", "x", "x"),
    (None, "mail me: Ann.Lee@mail.example.com or 8.8.8.8", "en", "b", 1, "x", "x", "x", "x"),
    (4, LONG, "en", "b", 1, "x", "x", "x", "x"),
    (5, "one two three four five six seven eight", "en", "c", 1, "x", "x", "x", "x"),
    (5, "one two three four five six seven eight", "en", "c", 1, "x", "x", "x", "x"),
    (6, "漢字 Ünïcode \n\n é  <|endoftext|> \u0000 'tis", "en", "ä", 1, "x", "x", "x", "x"),
    (7, " \t\n ", "en", "c", 1, "x", "x", "x", "x"),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


# 1 media


def test_media_round_trip(spark, edge, none):
    got = media.analyse(media.encode_texts(edge.select("doc_id", "text", "k")))
    by_digest = collections.Counter((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got.collect())
    want = collections.Counter()
    for row in EDGE:
        raw = (row[1] or "").encode()
        p = media.payload_of(raw)
        want[len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])] += 1
    assert by_digest == want
    assert media.analyse(media.encode_texts(none.select("doc_id", "text"))).count() == 0
    clips = media.clip_rows(got.where("doc_id = 4"), "doc_id").orderBy("clip").collect()
    assert clips[0].start_ms == 0 and all(a.end_ms == b.start_ms for a, b in itertools.pairwise(clips))


def test_media_any_bytes_and_foreign_files(spark):
    random.seed(1)
    payloads = [media.payload_of(x) for x in (b"", b"`" * 900, bytes(300), bytes(range(256)) * 40, os.urandom(9000), b"a" + b"`" * 40 + b"b")]
    for p, data in zip(payloads, media.store(payloads), strict=True):
        frames, micros, note = media.frames_of(data)
        raw = np.concatenate([d.coefs for d in media.decode(frames)]).astype(np.int8).view(np.uint8) + np.uint8(media.CENTRE)
        assert raw.tobytes()[: len(p)] == p and micros == 40000 and note == b"payload_bytes=%d" % len(p)
        damaged = data[: data.rindex(b"idx1")]  # without the index the frames are found in the list
        assert media.frames_of(damaged)[0] == frames
    odd = spark.createDataFrame([(1, None), (2, b"RIFF"), (3, b"GIF89a")], "id int, media binary")
    assert [r.n_frames for r in media.analyse(odd).collect()] == [0, 0, 0]


def test_shots_cut_where_histograms_jump():
    dark, light = np.eye(1, media.BINS, 3, dtype=int)[0] * 100, np.eye(1, media.BINS, 50, dtype=int)[0] * 100
    assert media.shots(np.array([dark] * 4 + [light] * 3 + [dark] * 2)) == [(0, 4), (4, 7), (7, 9)]
    assert media.shots(np.zeros((0, media.BINS))) == []


def test_inverse_transform_is_that_of_the_standard():
    block = np.zeros((1, 64))
    block[0, 1] = 16  # the second coefficient of the scan: one horizontal period
    got = (block @ media.inverse_basis()).reshape(8, 8) / 8192
    x = np.arange(8)
    want = 16 / 4 / math.sqrt(2) * np.cos((2 * x + 1) * np.pi / 16)
    assert np.allclose(got, want[None, :], atol=1e-2) or np.allclose(got, want[:, None], atol=1e-2)
    assert media.zigzag()[:6].tolist() == [0, 1, 8, 16, 9, 2]


# 2 mixing


def filled(sizes, weights):
    """Targets by resharing until none is above three times its size."""
    total, capped = sum(sizes.values()), {}
    while True:
        free = {s: w for s, w in weights.items() if s not in capped}
        left = total - sum(capped.values())
        share = {s: left * w / sum(free.values()) for s, w in free.items()}
        over = {s: 3 * sizes[s] for s, t in share.items() if t > 3 * sizes[s]}
        if not over:
            return capped | share
        capped |= over


def test_mixing_meets_targets(spark):
    got = mixing.mix(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    sizes, taken = collections.Counter(), collections.Counter()
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert r.taken <= 3 * r.size and r.taken == r.copies * r.size
    weights = dict(zip(sorted(sizes), itertools.cycle((5, 2, 1))))
    goals = filled(sizes, weights)
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, goals[r.source], rel_tol=1e-9)
    assert all(abs(taken[s] - goals[s]) < 0.02 * goals[s] for s in goals)


def test_mixing_rates_solve_the_dual(spark):
    """Rates are min(cap, exp(lam size / scale)) of one lam per source, and their words meet the target."""
    by_source = collections.defaultdict(list)
    for r in mixing.mix(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect():
        by_source[r.source].append(r)
        assert int(r.rate + 1e-9) <= r.copies <= r.rate + 1
    for rows in by_source.values():
        assert math.isclose(sum(r.rate * r["size"] for r in rows), rows[0].target, rel_tol=1e-6)
        lams = [math.log(r.rate) / r["size"] for r in rows if r["size"] and r.rate < 3]
        assert not lams or max(lams) - min(lams) < 1e-9


def test_mixing_of_many_equal_rows_and_odd_columns(spark):
    rows = [(1, "one two three", "a", 1, 1)] * 3000 + [(i, "w " * (i % 40 + 1), "b", 1, 1) for i in range(2, 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int, `row` int")
    got = mixing.mix(df).collect()
    taken, target = collections.Counter(), {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert len(got) == len(rows) and all(abs(taken[s] - t) < 0.02 * t for s, t in target.items())
    out = mixing.mixed_rows(df)
    assert out.columns == df.columns and out.count() == sum(r.copies for r in got)


def test_mixing_edges(spark, edge, none):
    got = mixing.mix(edge).collect()
    assert len(got) == len(EDGE) and {r.source for r in got} == {"a", "b", "c", "ä", None}
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(edge).collect()))
    assert mixing.mix(none).count() == 0
    out = mixing.mixed_rows(edge)
    assert out.columns == edge.columns and out.count() == sum(r.copies for r in got if r.size)


# 3 archives


def test_warc_query_by_sql(spark):
    got = {r.page_id: r for r in QUERIES["op3_arc_to_warc"](spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(pages)
    assert all(got[p.page_id].payload_digest == hashlib.sha256((p.html or "").encode()).hexdigest() for p in pages)


def test_warc_revisits_and_edges(spark):
    same = "x" * 200
    pages = [(5, "http://a/", same), (2, "http://b b/", same), (9, None, same), (7, "http://c/", "short"), (8, "http://d/", "short"), (1, "http://e/", None), (None, "http://f/", same + "\r\n\r\nWARC/1.1\r\n"), (3, "", "")]
    folder = shared_dir(spark, "warc")
    files = warc.write(warc.convert(warc.parse(warc.pack(spark.createDataFrame(pages, "page_id long, url string, html string"), limit=300))), folder)
    read = warc.read(files, folder)
    got = sorted(((r.page_id if r.page_id is not None else -1, r.payload_bytes, r.record_type, r.refers_to) for r in warc.pages_of(read.where("record_type in ('response', 'revisit')")).collect()))
    assert got == [(-1, 214, "response", None), (1, 0, "response", None), (2, 200, "response", None), (3, 0, "response", None), (5, 200, "revisit", 2), (7, 5, "response", None), (8, 5, "response", None), (9, 200, "revisit", 2)]
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.convert(warc.parse(warc.pack(empty))).count() == 0


def test_arc_versions_and_damage():
    for version in (1, 2):
        name = "x.arc"
        body = b"hello\nworld"
        data = warc.arc_start(version, name, "20010203040506") + warc.arc_header(version, "http://a/", "1.2.3.4", "20010203040506", "text/plain", len(body)) + body + b"\n"
        data += warc.arc_header(version, "http://b/", "1.2.3.4", "2001", "text/html", 99) + b"cut"
        first, second = warc.arc_records(name, data)
        assert first[2:] == ("http://a/", "1.2.3.4", "20010203040506", "text/plain", body, 0, True)
        assert second[6] == b"cut" and second[8] is False
    assert list(warc.arc_records("x", b"")) == [] and list(warc.arc_records("x", b"junk\n")) == []


# 4 quality


def brute_counts(t):
    w = WORD.findall(t)
    windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


def test_quality_counts(spark, edge, none, texts):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for r in quality.measure(spark.read.parquet(f"{SF}/documents.parquet")).collect():
        assert tuple(r[n] for n in names) == brute_counts(texts[r.doc_id])
    got = quality.verdict(quality.measure(edge)).collect()
    assert sorted(tuple(r[n] for n in names) for r in got) == sorted(brute_counts(row[1] or "") for row in EDGE)
    assert not any(r.kept for r in got if r.base_failed)
    assert quality.measure(none).count() == 0


def test_compression_bands(spark):
    random.seed(2)
    words = ["".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=random.randint(2, 9))) for _ in range(3000)]
    plain = " ".join(random.choices(words, weights=[1 / (i + 1) for i in range(3000)], k=4000))
    noise = " ".join("".join(chr(random.randrange(33, 127)) for _ in range(40)) for _ in range(300))
    df = spark.createDataFrame([(1, plain), (2, "buy now cheap " * 2000), (3, noise)], "doc_id long, text string")
    assert {r.doc_id: r.band_failed for r in quality.measure(df).collect()} == {1: False, 2: True, 3: True}


def test_noise_leaves_the_bands():
    random.seed(5)
    import zstandard

    press, limits = zstandard.ZstdCompressor(level=3), quality.Bands()
    letters = "abcdefghijklmnopqrstuvwxyz"
    kinds = {letters + letters.upper() + "0123456789+/": 300, letters: 1600, "0123456789abcdef": 4200}
    for symbols, least in kinds.items():
        for n in (n for n in (300, 450, 600, 900, 1600, 3900, 4200, 12000, 30000) if n >= least):
            raw = " ".join("".join(random.choices(symbols, k=max(8, min(60, n // 25)))) for _ in range(n))[:n].encode()
            assert quality.ratios(raw, limits, press)[0] > limits.limits(n)[1], (symbols, n)
    prose = [r.encode() for r in __import__("pyarrow.parquet").parquet.read_table(f"{SF}/documents.parquet")["text"].to_pylist() if r]
    assert all(quality.ratios(t, limits, press)[0] <= limits.limits(len(t))[1] for t in prose if len(t) >= 256)


# 5 language model


def brute_ppm(train, text, order):
    """PPM (method C, exclusion) by plain dictionaries."""
    counts = collections.defaultdict(collections.Counter)
    edge = bytes([lm.EDGE])
    for t in train:
        s = edge * order + t + edge
        for i in range(order, len(s)):
            for k in range(order + 1):
                counts[s[i - k : i]][s[i]] += 1
    s, total = edge * order + text + edge, 0.0
    for i in range(order, len(s)):
        gone = set()
        for k in range(order, -1, -1):
            c = counts.get(s[i - k : i])
            if not c:
                continue
            left = {x: n for x, n in c.items() if x not in gone}
            n = sum(left.values()) + len(left)
            if s[i] in left:
                total += math.log10(left[s[i]] / n)
                break
            if left:
                total += math.log10(len(left) / n)
            gone |= set(c)
        else:
            total -= math.log10(256 - len(gone))
    return total


def test_lm_against_brute_force(spark, edge, none):
    rows = [(i, t) for i, t in enumerate(["the cat sat on the mat", "the dog sat", "", "Zebra", "the cat", "a cat and a dog", "qqq", "THE mat"])] + [(r[0], r[1]) for r in EDGE if r[0] != 4]
    p = lm.Ppm(order=3, head=3)
    got = collections.Counter()
    for r in lm.scores(spark.createDataFrame(rows, "doc_id long, text string"), p).collect():
        got[r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 8), round(r.score, 8)] += 1
    lower = lambda t: (t or "").encode().lower()
    train = [lower(t) for i, t in rows if fold_of(i) != 1]
    words = collections.Counter(w for t in train for w in [*t.split(), b""])
    n, v = words.total(), len(words)
    want = collections.Counter()
    for i, t in rows:
        own = [*lower(t).split(), b""]
        base = sum(math.log10((words[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        want[i, fold_of(i) == 1, len(own), sum(words[w] > 0 for w in own), n, round(base, 8), round(brute_ppm(train, lower(t), 3), 8)] += 1
    assert got == want
    assert lm.scores(none).count() == 0
    assert lm.scores(edge).count() == len(EDGE)


@pytest.mark.parametrize("capacity", [0, 12, 1_000_000])
def test_lm_capacity_changes_no_score(spark, capacity):
    rows = list(enumerate(["the cat sat on the mat", "the dog sat", "", "Zebra", "the cat", "a cat and a dog", "qqq", "THE mat", "zq the dig", "the cat", "ÿ漢"]))
    got = {r.doc_id: r.score for r in lm.scores(spark.createDataFrame(rows, "doc_id long, text string"), lm.Ppm(order=3, head=3, capacity=capacity)).collect()}
    train = [t.encode().lower() for i, t in rows if fold_of(i) != 1]
    assert len(train) < len(rows)
    for i, t in rows:
        assert math.isclose(got[i], brute_ppm(train, t.encode().lower(), 3), abs_tol=1e-8)


# 6 surrogates


def test_surrogates_are_consistent(spark):
    text = "Mrs. Anna Smith met Mr. Smith. Call +1 (132) 555-0271 or +1-132-555-0271. 4111 1111 1111 1111 4111-1111-1111-1111; not 4111111111111112. 10.0.0.1 A@B.COM a@b.com г-жа Анна Иванова"
    other = "a@b.com and 10.0.0.2 and +1 (132) 555-0272 version 1.2.3 of 2024-01-02"
    df = spark.createDataFrame([(1, text, 5), (2, other, 6), (3, None, 7), (4, "", 8), (5, other, 9)], "doc_id long, text string, n_entities int")
    got = {r.doc_id: r for r in pii.replace(df, "key").collect()}
    a, b = got[1].text, got[2].text
    assert got[3].text is None and got[4].text == "" and got[5].text == b and got[2].n_entities == 3
    for gone in ("Anna Smith", "555-0271", "4111 1111 1111 1111", "10.0.0.1", "a@b.com", "A@B.COM", "Иванова"):
        assert gone not in a
    assert "4111111111111112" in a and "version 1.2.3 of 2024-01-02" in b
    phones = re.findall(r"\+1 \((\d{3})\) (\d{3})-(\d{4}).*?\+1-(\d{3})-(\d{3})-(\d{4})", a)[0]
    assert phones[:3] == phones[3:]
    cards = [re.sub(r"\D", "", x) for x in re.findall(r"\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}", a)]
    assert len(set(cards)) == 1 and cards[0][0] == "4"
    assert sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(cards[0])) % 10 == 0
    female = re.search(r"Mrs\. (\w+) (\w+) met Mr\. (\w+)\.", a)
    assert female[1] in pii.GIVEN["f", "latin"] and female[2] == female[3]
    assert re.search(r"г-жа (\w+) ", a)[1] in pii.GIVEN["f", "cyrillic"]
    mails = re.findall(r"\S+@\S+", a)
    assert mails[0].lower() == mails[1] and mails[0].isupper() and b.startswith(mails[1])


def test_surrogates_stay_distinct(spark):
    entities = spark.createDataFrame([("email", f"{a}@x.org") for a in "abcdefghijklmnopqrstuvwxyz"] + [("ip", f"10.0.{i}.{j}") for i in range(40) for j in range(20)], "kind string, canon string")
    got = pii.surrogates(entities, "k").collect()
    assert len({(r.kind, r.surrogate) for r in got}) == len(got) == 26 + 800
    assert not {r.surrogate for r in got} & {r.canon for r in got}


def test_surrogates_of_a_frequent_surname(spark):
    names = ["".join(x) for x in itertools.product("BDFGKLMNPR", "aeiou", "bdfgklmnpr", "aeiou")]
    rows = [(f"Mr {n} Smith",) for n in names] + [("Herr Νίκος Παπάς",), ("Frau Անի Սարյան",)] + [(f"Herr {n} Иванов",) for n in ("Пётр", "Яков")]
    got = pii.replace(spark.createDataFrame(rows, "text string"), "key").collect()
    assert all(r.n_entities == 1 for r in got) and len({r.text for r in got}) == len(rows) > 2500
    smiths = [r.text for r in got if r.text.startswith("Mr ")]
    assert len({t.split()[-1] for t in smiths}) == 1 and "Smith" not in smiths[0]
    bare = lambda t: t.split(" ", 1)[1]
    assert all(re.fullmatch("[Ͱ-Ͽ ]+", bare(r.text)) for r in got if re.search("[Ͱ-Ͽ]", r.text))
    assert sum(bool(re.fullmatch(f"[{span} ]+", bare(r.text))) for span in ("Ͱ-Ͽ", "\u0530-\u058f", "\u0400-\u04ff") for r in got) == 4


def test_surrogates_of_long_domains_and_odd_columns(spark):
    long = "x@" + "ab." * 200_000 + "com"
    rows = [(1, long, "kept", "kept", "kept", 3), (2, "Mail ann@mail.example.com. Or bob@x.org.5", "a", "b", "c", 4), (3, "clean", "a", "b", "c", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, of string, New string, count string, n int")
    got = {r.doc_id: r for r in pii.replace(df, "key").collect()}
    assert got[1].asDict().keys() == {*df.columns, "n_entities"}
    for r in rows:
        assert (got[r[0]]["of"], got[r[0]]["New"], got[r[0]]["count"], got[r[0]]["n"]) == r[2:]
    assert got[1].n_entities == 1 and got[1].text.endswith("ab.com") and not got[1].text.startswith("x@ab.")
    assert got[2].n_entities == 2 and re.fullmatch(r"Mail [a-z]{3}@[a-p]{10}\.example\. Or [a-z]{3}@[a-p]{10}\.example\.5", got[2].text)


def test_surrogates_keep_the_script(spark):
    df = spark.createDataFrame([(f"{n}@x.org",) for n in ("ανδρέας", "борис", "ありがとう", "გიორგი", "שלום", "anna")], "text string")
    names = [r.text.split("@")[0] for r in pii.replace(df, "key").collect()]
    spans = ("\u0370-\u03ff", "\u0400-\u04ff", "\u3040-\u309f", "\u10a0-\u10ff", "\u0590-\u05ff", "a-z")
    assert all(sum(bool(re.fullmatch(f"[{span}]+[0-9]?", n)) for n in names) == 1 for span in spans)


def plain_hex(*parts):
    seed = "\n".join(parts)
    return hashlib.sha256(f"{seed}\n0".encode()).digest() + hashlib.sha256(f"{seed}\n1".encode()).digest()


def plain_surrogate(key, kind, canon, attempt=0):
    """The surrogate of an address, a number or a Latin name, in plain Python (the first of its domain or surname)."""
    h = plain_hex(key, kind, canon, str(attempt))
    drawn = lambda h, n: "".join(str(h[i % 64] % 10) for i in range(max(n, 1)))
    digits = lambda n: drawn(h, n)
    if kind == "email":
        local, domain = canon.split("@")
        host = "".join(chr(ord("g") + int(c)) if c.isdigit() else c for c in plain_hex(key, "domain", domain, "0").hex()[:10])
        more = drawn(plain_hex(key, "more", canon, str(attempt)), attempt) if attempt else ""
        return "".join(str(h[i % 64] % 10) if c.isdigit() else chr(97 + h[i % 64] % 26) if c.isalpha() else c for i, c in enumerate(local)) + f"{more}@{host}.example"
    if kind == "phone":
        plus = re.match(r"(\+1)?", canon)[0]
        return f"{plus}{2 + h[60] % 8}{digits(len(canon) - len(plus) - 1)}"
    if kind == "ip":
        return f"{10 if canon.startswith('10.') else 240 + h[0] % 15}.{h[1]}.{h[2]}.{1 + h[3] % 254}"
    if kind == "ssn":
        return "9" + digits(8)
    if kind == "card":
        body = canon[0] + digits(len(canon) - 2)
        total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate((body + "0")[::-1]))
        return body + str((10 - total % 10) % 10)
    gender, full = canon.split(":")
    s = plain_hex(key, "surname", full.split(" ")[-1], "0")
    syllables = [a + b for a in "bdfgklmnprstvz" for b in "aeiou"]
    surname = "".join(syllables[s[i] % 70] for i in range(4)).capitalize()
    more = "".join(syllables[h[1 + i] % 70] for i in range(attempt)).capitalize() + " " if attempt else ""
    return f"{pii.GIVEN[gender, 'latin'][h[0] % 16]} {more}{surname}" if " " in full else more + surname


def test_surrogates_equal_a_plain_version(spark):
    entities = [("email", f"user{i}.x@host{i % 3}.org") for i in range(30)] + [("ip", f"10.1.2.{i}") for i in range(30)] + [("ip", f"9.8.7.{i}") for i in range(30)]
    entities += [("ssn", f"{i:09d}") for i in range(100, 130)] + [("card", f"4{i:015d}") for i in range(30)] + [("name", f"{g}:anna{i} smith{i}") for i in range(10) for g in "fmn"] + [("name", "f:lee")]
    entities += [("name", f"f:x{i} lee") for i in range(60)] + [("email", f"{c}@one.org") for c in "abcdefghijklmnopqrstuvwxyz"] + [("phone", f"{p}132555{i:04d}") for i in range(20) for p in ("", "+1")]
    got = {(r.kind, r.canon): (r.attempt, r.surrogate) for r in pii.surrogates(spark.createDataFrame(entities, "kind string, canon string"), "key").collect()}
    assert len(got) == len(entities) and sum(a > 0 for a, _ in got.values()) > 20
    assert all(s == plain_surrogate("key", *e, a) for e, (a, s) in got.items())
    assert len({(k, s) for (k, _), (_, s) in got.items()}) == len(got)


def test_one_letter_mailboxes_end(spark):
    letters = [chr(c) for c in (*range(0x61, 0x7B), *range(0xE0, 0x300), *range(0x1E00, 0x1F00)) if chr(c).isalpha() and chr(c) == chr(c).lower()][:420]
    got = pii.surrogates(spark.createDataFrame([("email", f"{c}@x.org") for c in letters], "kind string, canon string"), "k").collect()
    assert len(letters) == 420 == len({r.surrogate for r in got}) and max(r.attempt for r in got) < 8


def test_surnames_and_domains_stay_distinct(spark, monkeypatch):
    monkeypatch.setitem(pii.SYLLABLES, "latin", ["ba", "be", "bi", "bo", "da", "de", "di", "do"])  # 4,096 surnames at first
    word = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(4))
    names = spark.createDataFrame([("name", f"f:ann {word(i)}") for i in range(3000)] + [("email", f"a@{word(i)}.org") for i in range(20_000)], "kind string, canon string")
    got = pii.surrogates(names, "k").collect()
    assert len({r.surrogate.split()[-1] for r in got if r.kind == "name"}) == 3000
    assert len({r.surrogate.split("@")[1] for r in got if r.kind == "email"}) == 20_000


def test_a_full_space_of_numbers_is_an_error(spark, monkeypatch):
    few = spark.createDataFrame([("ip", f"10.0.0.{i}") for i in range(1, 200)], "kind string, canon string")
    assert pii.surrogates(few, "k").count() == 199
    monkeypatch.setattr(pii, "FORMS", 100_000)
    with pytest.raises(ValueError, match="too many"):
        pii.surrogates(few, "k")


def test_gender_of_a_name_without_one(spark):
    rows = ["Ms Jane Smith", "Dr Jane Smith", "Mr Kim Lee", "Ms Kim Lee", "Prof Kim Lee", "Dr Lee Ray"]
    got = [r.text.split(" ", 1)[1] for r in pii.replace(spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id int, text string"), "k").orderBy("doc_id").collect()]
    assert got[0] == got[1] and got[0].split()[0] in pii.GIVEN["f", "latin"]
    assert len(set(got[2:5])) == 3 and len({x.split()[-1] for x in got[2:5]}) == 1 and len(set(got)) == 5


def test_surrogates_leave_rows_and_clean_texts(spark, edge, none, texts):
    out = pii.replace(edge, "k")
    assert out.columns == [*edge.columns, "n_entities"] and out.count() == len(EDGE)
    assert pii.replace(none, "k").count() == 0
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for r in pii.replace(docs, "k").collect():
        if not r.n_entities:
            assert r.text == texts[r.doc_id]


# 7 and 8 tokens


def odd_texts():
    random.seed(3)
    parts = ["a", "b", " ", "  ", "\n", "'s", "1", "é", "漢", "!!", "\t", " the", "ing", "\u00a0", "\u3000", "\x85", "\x1c", "e\u0301", "\u0301", "Σ", "İ", "<|endoftext|>", "<|", "|>", "😀", ".", ","]
    return ["", " ", "\n", "a  b", "x \n y", "a\n ", "don't we'll\n\n  z", *["".join(random.choice(parts) for _ in range(random.randrange(40))) for _ in range(1500)]]


def test_bpe_equals_the_library(texts):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    own, theirs = bpe.tokenizer(path), Tokenizer.from_file(path)
    every = [*texts.values(), *odd_texts()]
    flat, ends = own.encode(pa.array(every))
    table = bpe.offset_table(path)
    for t, ids, e in zip(every, np.split(flat, ends[:-1]), theirs.encode_batch(every, add_special_tokens=False), strict=True):
        assert ids.tolist() == e.ids, t
        data, _ = table.decode(ids.astype(np.int64), np.array([len(ids)]))
        assert data.tobytes().decode() == theirs.decode(e.ids, skip_special_tokens=False)


def test_bpe_columns(spark, edge, none):
    path = vocabulary("word_bpe_49k.json")
    out = bpe.decode(bpe.encode(edge, path), path)
    assert out.columns == [*[c for c in edge.columns if c != "ids"], "ids", "decoded"]
    assert {r.doc_id: r.decoded for r in out.where("doc_id in (2, 3)").collect()} == {2: "", 3: ""}
    assert bpe.decode(bpe.encode(none, path), path).count() == 0
    rows = lambda df: sorted(map(str, df.select("doc_id", "ids", "decoded").collect()))
    assert rows(bpe.encode(edge, path, decoded="decoded")) == rows(out)


def test_pieces_equal_the_library(texts):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    every = [*texts.values(), *odd_texts()]
    flat, ends = records.pieces(path).encode(pa.array(every))
    for t, ids, e in zip(every, np.split(flat, ends[:-1]), Tokenizer.from_file(path).encode_batch(every, add_special_tokens=False), strict=True):
        assert ids.tolist() == e.ids, t


def test_pieces_of_texts():
    texts = ["a b  b", None, "", "  ", " a b", "\nb\tc ", "c"]
    for sliced in (pa.array(texts), pa.array(["zz", *texts])[1:]):
        distinct, index, ends = common.pieces(sliced)
        assert len(set(distinct)) == len(distinct)
        assert [[distinct[i].decode() for i in x] for x in np.split(index, ends[:-1])] == [["a", " b", "  b"], [], [], ["  "], [" a", " b"], ["\nb", "\tc", " "], ["c"]]
        distinct, index, ends = common.pieces(sliced, np.array([t is not None and "\n" in t for t in texts]))
        assert [distinct[i] for i in np.split(index, ends[:-1])[5]] == [b"\nb\tc "]
    assert common.pieces(pa.array([None, ""]))[2].tolist() == [0, 0]


def test_crc32c():
    def slow(data):
        c = 0xFFFFFFFF
        for x in data:
            c ^= x
            for _ in range(8):
                c = (c >> 1) ^ (records.POLYNOMIAL if c & 1 else 0)
        return c ^ 0xFFFFFFFF

    data = [os.urandom(n) for n in (4, 5, 63, 64, 65, 700)]
    assert records.crc32c(data).tolist() == [slow(x) for x in data] and records.crc32c([b"123456789"])[0] == 0xE3069283


def test_records(spark, edge, none):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    folder = shared_dir(spark, "records")
    index = records.write(edge, path, folder, end_id=2)
    got = records.positions(records.read(index, folder)).orderBy("start").collect()
    theirs = Tokenizer.from_file(path)
    start = 0
    order = sorted(EDGE, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    for r, row in zip(got, order, strict=True):
        ids = np.array([*theirs.encode(row[1] or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (row[0], start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    some = records.read_at(index.where("doc_id = 1"), folder).first()
    assert some.ids == [*theirs.encode(EDGE[0][1], add_special_tokens=False).ids, 2]
    folder = shared_dir(spark, "records")
    assert records.positions(records.read(records.write(none, path, folder, 2), folder)).count() == 0


def test_damaged_record_is_noticed():
    (frame,) = records.frames([b"sixteen bytes..."])
    bad = bytearray(frame)
    bad[20] ^= 1
    n, head, tail = bytes(bad[:8]), int.from_bytes(bad[8:12], "little"), int.from_bytes(bad[-4:], "little")
    with pytest.raises(ValueError, match="checksum"):
        records.check([n], [head], [bytes(bad[12:-4])], [tail])


# 9 toxicity


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    got = [r for r in QUERIES["op9_toxicity"](spark, d).collect() if r.held_out and labels.get(r.doc_id) is not None]
    hit = [labels[r.doc_id] for r in got if r.predicted]
    assert np.mean(hit) > 0.9 and sum(hit) > 0.6 * sum(labels[r.doc_id] for r in got)


def plain_ftrl(rows, p, rounds, state=None):
    """FTRL-proximal with one weight at a time, from a state (z and n by place), which it changes."""
    z, n = state or (collections.defaultdict(float), collections.defaultdict(float))

    def weight(i):
        if i == 1 << p.bits:
            return -z[i] / ((p.beta + math.sqrt(n[i])) / p.alpha)
        return 0.0 if abs(z[i]) <= p.l1 else -(z[i] - math.copysign(p.l1, z[i])) / ((p.beta + math.sqrt(n[i])) / p.alpha + p.l2)

    for _ in range(rounds):
        for places, label in rows:
            w = {i: weight(i) for i in [*places, 1 << p.bits]}
            g = 1 / (1 + math.exp(-sum(w.values()))) - label
            for i in w:
                step = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / p.alpha
                z[i] += g - step * w[i]
                n[i] += g * g
    return weight, [i for i in z if i < 1 << p.bits]


def plain_features(text, bits):
    words = [w for w in (t.lower().translate(None, toxicity.PUNCTUATION) for t in (text or "").encode().split()) if w]
    h, out, wrap = [zlib.crc32(w) for w in words], set(), (1 << 64) - 1
    for i, x in enumerate(h):
        out.add((x * 0x9E3779B97F4A7C15 & wrap) >> 64 - bits)
        for gap, factor in ((1, 0xC2B2AE3D27D4EB4F), (2, 0x165667B19E3779F9)):
            if i + gap < len(h):
                out.add(((x * factor + h[i + gap]) * 0x9E3779B97F4A7C15 & wrap) >> 64 - bits)
    return sorted(out)


def test_toxicity_equals_plain_ftrl(spark):
    p = toxicity.Ftrl(bits=14, shards=1, rounds=2, passes=2)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.fit(docs, labels, p)
    joined = docs.join(labels.groupBy("doc_id").agg(F.max("label").alias("label")), "doc_id").where("label is not null").orderBy(F.xxhash64("doc_id")).collect()
    weight, places = plain_ftrl([(plain_features(r.text, p.bits), r.label) for r in joined], p, p.rounds * p.passes)
    assert dict(zip(model["places"].tolist(), np.round(model["weights"], 9).tolist())) == {i: round(w, 9) for i in places if (w := weight(i))}
    assert math.isclose(model["intercept"][0], weight(1 << p.bits), abs_tol=1e-9)
    for r in toxicity.score(docs, model, p).collect():
        want = sum(weight(i) for i in plain_features(r.text, p.bits) if i in places) + weight(1 << p.bits)
        assert math.isclose(r.score, 1 / (1 + math.exp(-want)), abs_tol=1e-9)


def test_toxicity_shards_equal_plain_ones_that_are_averaged(spark):
    p = toxicity.Ftrl(bits=12, shards=8, rounds=3, passes=2)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.fit(docs, labels, p)
    joined = docs.join(labels, "doc_id").withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(8))).orderBy(F.xxhash64("doc_id")).collect()
    shards = collections.defaultdict(list)
    for r in joined:
        shards[r.shard].append((plain_features(r.text, p.bits), r.label))
    z, n = collections.defaultdict(float), collections.defaultdict(float)
    for _ in range(p.rounds):
        sums = collections.defaultdict(float), collections.defaultdict(float)
        for rows in shards.values():
            own = collections.defaultdict(float, z), collections.defaultdict(float, n)
            plain_ftrl(rows, p, p.passes, own)
            for total, part in zip(sums, own, strict=True):
                for i, x in part.items():
                    total[i] += x
        z, n = (collections.defaultdict(float, {i: x / p.shards for i, x in total.items()}) for total in sums)
    weight, places = plain_ftrl([], p, 0, (z, n))
    assert len(shards) == 8 and dict(zip(model["places"].tolist(), np.round(model["weights"], 9).tolist())) == {i: round(w, 9) for i in places if (w := weight(i))}
    assert math.isclose(model["intercept"][0], weight(1 << p.bits), abs_tol=1e-9)


def test_toxicity_edges(spark, edge, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (5, 0), (5, 1)], "doc_id long, label int")
    model = toxicity.fit(edge, labels)
    got = toxicity.score(edge, model)
    assert got.columns == [*[c for c in edge.columns if c != "score"], "score"]
    assert all(0 <= r.score <= 1 for r in got.collect()) and got.count() == len(EDGE)
    empty = toxicity.fit(none, labels)
    assert {r.score for r in toxicity.score(edge, empty).collect()} == {0.5}
    assert toxicity.score(none, model).count() == 0


# 10 near duplicates


def test_probability_jaccard():
    random.seed(4)
    for _ in range(50):
        a = {k: random.randint(1, 4) for k in random.sample(range(12), random.randint(1, 9))}
        b = {k: random.randint(1, 4) for k in random.sample(range(12), random.randint(1, 9))}
        want = sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in a.keys() | b.keys()) for i in a.keys() & b.keys())
        pack = lambda x: (np.array(sorted(x), np.uint64), np.array([x[k] for k in sorted(x)]))
        assert math.isclose(neardup.probability_jaccard(*pack(a), *pack(b)), want, abs_tol=1e-12)


def test_exactly_four_fifths_is_a_link(spark):
    for union in range(10, 1000, 5):  # both have as many, and `common` of them together
        common = union * 4 // 5
        own = (union - common) // 2
        a, b = np.arange(common + own), np.concatenate([np.arange(common), np.arange(common + own, union)])
        got = neardup.probability_jaccard(a, np.ones(len(a), int), b, np.ones(len(b), int))
        assert got >= 0.8 and neardup.probability_jaccard(a, np.full(len(a), 3), b, np.full(len(b), 2)) >= 0.8
        assert neardup.probability_jaccard(a[1:], np.ones(len(a) - 1, int), b, np.ones(len(b), int)) < 0.8 - neardup.ROUNDING
    shape = lambda keys: np.sort(keys.astype(np.uint64)).tobytes()
    a, b = np.arange(54), np.concatenate([np.arange(48), np.arange(54, 60)])
    shown = spark.createDataFrame([(b"a", shape(a)), (b"b", shape(b))], "id binary, shape binary")
    pairs = spark.createDataFrame([(b"a", b"b")], "a binary, b binary")
    assert [r.similarity for r in neardup.verify(pairs, shown, neardup.NearDup()).collect()] == [0.8]


def test_signatures_estimate_it():
    random.seed(5)
    words = [str(i).encode() for i in range(400)]
    a, b = b" ".join(words), b" ".join([*words[:360], *[b"x%d" % i for i in range(40)]])
    grams, counts, owners = neardup.shingles(pa.array([a, b]), 5)
    sig = neardup.signatures(grams, counts, owners, 2, 2000)
    x, y = (neardup.shingles(pa.array([t]), 5)[:2] for t in (a, b))
    assert abs((sig[0] == sig[1]).mean() - neardup.probability_jaccard(*x, *y)) < 0.04


def near(n, base, edits, seed):
    random.seed(seed)
    out = []
    for _ in range(n):
        w = list(base)
        for i in random.sample(range(len(w)), edits):
            w[i] = f"edit{random.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_near_duplicates_find_every_link(spark):
    random.seed(6)
    fresh = lambda n: [f"w{random.randrange(10**5)}" for _ in range(n)]
    texts, base = [], fresh(300)
    texts += [" ".join(base), *near(60, base, 4, 7), *near(40, base, 30, 8)]
    shared = fresh(60)
    texts += [" ".join([*shared, *fresh(60)]) for _ in range(80)]
    texts += [" ".join(fresh(80)) for _ in range(100)] + ["a b", "a b", "a c", "", None, "x " * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in neardup.classes(df).collect()}
    sets = []
    for t in texts:
        w = (t or "").split()
        sets.append(collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else []))
    links = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if (texts[i] or "") == (texts[j] or "") or (sets[i].keys() & sets[j].keys() and sum((sets[i] & sets[j]).values()) / sum((sets[i] | sets[j]).values()) >= 0.8)]
    group = list(range(len(texts)))
    for i, j in links:
        a, b = group[i], group[j]
        group = [min(a, b) if g in (a, b) else g for g in group]
    assert got == dict(enumerate(group))
    kept = {r.doc_id for r in neardup.keep_one(df).collect()}
    assert kept == set(group)


def test_near_duplicates_whose_leaders_are_unlike_both(spark, monkeypatch):
    random.seed(31)
    word = lambda: "".join(random.choices("abcdefghij", k=6))
    texts = [" ".join(word() for _ in range(80)) for _ in range(40)]
    by_key = sorted(range(40), key=lambda i: hashlib.sha256(texts[i].encode()).digest()[:16])
    twin = texts[by_key[20]] + " end"
    assert hashlib.sha256(twin.encode()).digest()[:16] not in (min(d := [hashlib.sha256(t.encode()).digest()[:16] for t in [*texts, twin]]), max(d))
    # All in one bucket: its leaders are the least and the greatest key.
    banded = neardup.banded
    monkeypatch.setattr(neardup, "banded", lambda *a: banded(*a).withColumn("bands", F.array(F.lit(7).cast("long"))))
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(list(enumerate([*texts, twin])), "doc_id long, text string")).collect()}
    assert got == {i: by_key[20] if i == 40 else i for i in range(41)}


def test_registers_tell_unlike_pairs(spark):
    """All pairs of similarity 0.8 stay, those far below go."""
    random.seed(41)
    p, rows, pairs = neardup.NearDup(), [], []
    for i in range(400):
        words = [f"w{random.randrange(10**6)}" for _ in range(54 + 4)]
        other = [f"v{random.randrange(10**6)}" for _ in range(58)]
        rows += [(3 * i, " ".join(words)), (3 * i + 1, " ".join([*words[:52], *other[:6]])), (3 * i + 2, " ".join([*words[:30], *other[6:34]]))]
        pairs += [(3 * i, 3 * i + 1), (3 * i, 3 * i + 2)]
    df = neardup.banded(spark.createDataFrame(rows, "doc_id long, text string"), p, "doc_id", "text").cache()
    key = {r.doc_id: bytes(r.id) for r in df.collect()}
    left = {(bytes(r.a), bytes(r.b)) for r in neardup.promising(spark.createDataFrame([(key[a], key[b]) for a, b in pairs], "a binary, b binary"), df.select("id", "sketch"), p).collect()}
    assert left == {(key[a], key[b]) for a, b in pairs if b % 3 == 1}  # 48 of 60 shingles: 0.8


def test_prefixes_lose_no_link(spark):
    """All pairs of weighted sets at or above the threshold are met, and few others."""
    random.seed(43)
    base, shapes = list(range(1000, 1100)), []
    for i in range(120):
        own = {k: 1 + (k % 7 == 0) + (random.random() < 0.03) for k in random.sample(base, random.randint(88, 100))}
        own |= {10_000 + 100 * i + j: random.choice((1, 2)) for j in range(random.randint(0, 14))}
        scale = random.choice((1, 1, 3))
        shapes.append({k: n * scale for k, n in own.items()})
    pack = lambda s: (np.array(sorted(s), np.uint64), np.array([s[k] for k in sorted(s)]))
    raw = lambda s: np.repeat(*pack(s)).tobytes()
    bits = lambda s: np.packbits(np.isin(np.arange(neardup.MAP), [hash((k,)) % neardup.MAP for k in s])).tobytes()
    ids = [bytes([i]) * 16 for i in range(len(shapes))]
    shown = spark.createDataFrame([(i, raw(s), bits(s)) for i, s in zip(ids, shapes, strict=True)], "id binary, shape binary, map binary")
    met = spark.createDataFrame([(1, i, ids[k // 2]) for k, i in enumerate(ids)], "bucket long, id binary, class binary")
    got = {(bytes(r.a), bytes(r.b)) for r in neardup.meeting(neardup.prefixes(met, shown, neardup.NearDup()), neardup.NearDup()).collect()}
    links = {(ids[i], ids[j]) for i, j in itertools.combinations(range(len(ids)), 2) if i // 2 != j // 2 and neardup.probability_jaccard(*pack(shapes[i]), *pack(shapes[j])) >= 0.8}
    assert len(links) > 50 and links <= got and len(got) < len(ids) * (len(ids) - 1) / 2 * 0.6
    full = shown.withColumn("map", F.lit(b"\xff" * (neardup.MAP // 8)))  # maps that tell nothing
    more = {(bytes(r.a), bytes(r.b)) for r in neardup.meeting(neardup.prefixes(met, full, neardup.NearDup()), neardup.NearDup()).collect()}
    assert got < more and len(more) < len(ids) * (len(ids) - 1) / 2 * 0.75


def test_recall_of_every_twentieth_document(spark):
    """Rows with ids divisible by 20 against all rows: every link of exact J_P >= 0.8 is within one class."""
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    classes = {r.doc_id: r.class_id for r in neardup.classes(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    sets, holders = {}, collections.defaultdict(set)
    for i, t in docs.items():
        keys, counts, _ = neardup.shingles(pa.array([t]), 5)
        sets[i] = (keys, counts)
        for k in keys.tolist():
            holders[k].add(i)
    links = [(i, j) for i in docs if i % 20 == 0 for j in {j for k in sets[i][0].tolist() for j in holders[k]} - {i} if neardup.probability_jaccard(*sets[i], *sets[j]) >= 0.8 - neardup.ROUNDING]
    found = sum(classes[i] == classes[j] for i, j in links)
    assert len(links) >= 5 and found == len(links)


def test_near_duplicates_edges(spark, edge, none):
    found = neardup.classes(edge).collect()
    assert {r.n_links for r in found} == {0}
    named = neardup.classes(edge.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id")))).collect()
    assert sorted((r.doc_id or "", r.class_id) for r in named) == sorted((f"d{r.doc_id}" if r.doc_id is not None else "", f"d{r.class_id}" if r.class_id is not None else None) for r in found)
    got = sorted(((r.doc_id or 0), r.class_id, r.n_copies) for r in found)
    assert got == [(0, None, 1), (1, 1, 3), (2, 2, 2), (3, 2, 2), (4, 4, 1), (5, 1, 3), (5, 1, 3), (6, 6, 1), (7, 7, 1)]
    assert neardup.classes(none).count() == 0
    assert sorted((r.doc_id or 0) for r in neardup.keep_one(edge).collect()) == [0, 1, 2, 4, 6, 7]
    assert neardup.keep_one(edge).columns == edge.columns


# the pipeline


def plain_groups(texts):
    """The least number of each text's class, by all pairs."""
    sets = []
    for t in texts:
        w = (t or "").encode().split()
        sets.append(collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else []))
    packs = [({k: i for i, k in enumerate(s)}, s) for s in sets]
    group = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        same = (texts[i] or "") == (texts[j] or "")
        if not same and len(packs[i][0].keys() & packs[j][0].keys()) * 2 > len(packs[i][0]):
            names = {k: n for n, k in enumerate(sorted(sets[i].keys() | sets[j].keys()))}
            a, b = ((np.array(sorted(names[k] for k in s)), s) for s in (sets[i], sets[j]))
            count = lambda keys, s: np.array([s[k] for k in sorted(s, key=names.get)])  # noqa: B023, E731
            same = neardup.probability_jaccard(a[0], count(*a), b[0], count(*b)) >= 0.8 - neardup.ROUNDING
        if same:
            x, y = group[i], group[j]
            group = [min(x, y) if g in (x, y) else g for g in group]
    return group


def test_pipeline_stages(spark):
    """Every stage beside what plain Python makes of the same input."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        path = shared_dir(spark, name)
        out.write.parquet(path)
        if name != "bpe":
            assert out.columns == docs.columns
        held[name] = docs.orderBy("doc_id").collect(), (docs := spark.read.parquet(path)).orderBy("doc_id").collect()
    assert list(stages) == ["toxicity", "near_dedup", "pii", "mixing", "bpe"]
    # Documents that the model rejects go, all others stay as they are (the smallest table has too few labels).
    larger = "/root/testdata/sf0.01"
    before = spark.read.parquet(f"{larger}/documents.parquet")
    model = toxicity.fit(before, spark.read.parquet(f"{larger}/labels.parquet").select("doc_id", F.col("toxic").alias("label")))
    weight = dict(zip(model["places"].tolist(), model["weights"].tolist(), strict=True))
    want = [r for r in before.orderBy("doc_id").collect() if sum(weight.get(i, 0) for i in plain_features(r.text, toxicity.Ftrl().bits)) + model["intercept"][0] < 0]
    assert stages["toxicity"](spark, before, larger).orderBy("doc_id").collect() == want and 0 < before.count() - len(want) < 100
    assert held["toxicity"][1] == held["toxicity"][0]
    # One of each class.
    before, after = held["near_dedup"]
    group = plain_groups([r.text for r in before])
    assert after == [r for i, r in enumerate(before) if group[i] == i] and len(after) < len(before)
    # Personal data: only the matches change, each spelling to one other.
    before, after = held["pii"]
    changes = collections.defaultdict(set)
    for a, b in zip(before, after, strict=True):
        cut = re.split(r"(\S+@\S+\.[a-zA-Z]{2,}|\+?[0-9(][0-9 ().-]{5,}[0-9])", a.text or "")
        if len(cut) == 1:
            assert "Mr" in (a.text or "") or a.text == b.text
        assert (a.doc_id, a.lang, a.source) == (b.doc_id, b.lang, b.source) and b.n_chars == len(b.text or "")
        for x in re.findall(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)*\.[a-zA-Z]{2,}", a.text or ""):
            assert x not in (b.text or "")
        for x, y in zip((a.text or "").split(), (b.text or "").split(), strict=False):
            if "@" in x:
                changes[x].add(y)
    assert changes and all(len(v) == 1 for v in changes.values()) and len({*map(str, changes.values())}) == len(changes)
    # The mix: copies within the cap, sources at their targets.
    before, after = held["mixing"]
    size = lambda r: len(WORD.findall(r.text or ""))
    copies, sizes, taken = collections.Counter(r.doc_id for r in after), collections.Counter(), collections.Counter()
    for r in before:
        sizes[r.source] += size(r)
        taken[r.source] += copies[r.doc_id] * size(r)
        assert copies[r.doc_id] <= 3
    goals = filled(sizes, dict(zip(sorted(sizes), itertools.cycle((5, 2, 1)))))
    assert all(abs(taken[s] - goals[s]) < max(0.05 * goals[s], 60) for s in goals)
    assert set(after) <= set(before)
    # Tokens: those of the library.
    before, after = held["bpe"]
    theirs = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    want = {r.doc_id: theirs.encode(r.text or "", add_special_tokens=False).ids for r in before}
    assert all(r.ids == want[r.doc_id] and r.n_tokens == len(r.ids) for r in after) and len(after) == len(before)
    assert all(r.decoded_sha256 == hashlib.sha256(theirs.decode(r.ids, skip_special_tokens=False).encode()).hexdigest() for r in after)


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_edges(spark, edge, none, empty):
    """Nulls, repeats, clashing columns and an empty table go through every stage."""
    import corpus_pipeline

    docs = none if empty else edge
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        path = shared_dir(spark, name)
        out.write.parquet(path)
        if name != "bpe":
            assert out.columns == docs.columns
        docs = spark.read.parquet(path)
    assert (docs.count() == 0) == empty
