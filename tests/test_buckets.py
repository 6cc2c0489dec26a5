"""Buckets of messages alike: arrays against SequenceMatcher, rounds against messages placed one by one."""

import hashlib
import random
import time
from difflib import SequenceMatcher

import numpy as np

from tracewell.streaming import buckets, stateful


def plain(messages, ratio=0.75):
    made, out = [], []
    for m in messages:
        b = m if m in made else next((b for b in made if SequenceMatcher(None, b, m).ratio() >= ratio), None)
        made += [m] if b is None else []
        out.append(b or m)
    return out


def line(users):
    user = random.randrange(users)
    return f'user {user} purchase {{"k": {random.randrange(100)}}} {random.randrange(3000) / 10} {hashlib.md5(str(user).encode()).hexdigest()[:12]}'


def varied(n, letters, longest):
    out = []
    for _ in range(n):
        old = random.choice(out) if out and random.random() < 0.6 else ""
        text = [c for c in old if random.random() < 0.85] + random.choices(letters, k=random.randint(0, longest) if not old else 3)
        out.append("".join(text)[:longest])
    return out


def test_pairs_are_alike_as_by_sequence_matcher():
    random.seed(5)
    for letters, longest in (("ab", 20), ("abcdefg", 64), ("abc é中\0", 70), ("abcdefghij", 192)):
        texts = varied(60, letters, longest)
        left, right = ([a for a in texts for _ in texts], texts * len(texts))
        for ratio in (0.5, 0.75, 1.0):
            assert buckets.alike(left, right, ratio).tolist() == [SequenceMatcher(None, a, b).ratio() >= ratio for a, b in zip(left, right, strict=True)]


def test_no_pair_alike_is_ruled_out():
    random.seed(6)
    for letters, longest in (("abc", 30), ("abcdefg", 64), ("ab中ĭ", 130), ("abcdefghij", 192)):
        texts = varied(90, letters, longest)
        ordered = sorted(range(90), key=texts.__getitem__)
        for low, tile in ((0, 512), (17, 7)):
            hits = buckets.Part(texts).near(buckets.Texts(ordered, [texts[k] for k in ordered]), low, 0.75, tile)
            got = set(map(tuple, hits.tolist()))
            assert len(got) == len(hits) and all(at >= low for _, at in got)
            assert {(k, at) for k in range(90) for at in range(low, 90) if SequenceMatcher(None, texts[at], texts[k]).ratio() >= 0.75} <= got


def test_buckets_of_any_messages():
    random.seed(7)
    for letters, longest, n in (("abcde ", 12, 600), ("abcdefghijklm", 90, 150), ("abcdefg", 260, 60), ("aé中", 9, 300)):
        for ratio in (0.6, 0.75):
            messages = varied(n, letters, longest)
            assert buckets.Buckets(ratio).place(messages)[0] == plain(messages, ratio)
            # In two batches, the second with what the first one made.
            first, made = buckets.Buckets(ratio).place(messages[: n // 3])
            assert first + buckets.Buckets(ratio, made).place(messages[n // 3 :])[0] == plain(messages, ratio)


def test_index_and_arrays_find_the_same():
    random.seed(8)
    messages = [line(300) for _ in range(700)] + ["".join(random.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=30)) for _ in range(700)]
    random.shuffle(messages)
    by_arrays, by_index = buckets.Buckets(0.75), buckets.Buckets(0.75)
    by_arrays.rare, by_index.rare = lambda *_: False, lambda *_: True
    assert by_arrays.place(messages) == by_index.place(messages)
    assert np.array_equal(by_arrays.oldest(messages, 100), by_index.oldest(messages, 100))


def test_a_logger_of_one_pattern_takes_no_long_time():
    """Before, each of these was compared with all buckets by itself (more than 20 s)."""
    random.seed(9)
    messages = [line(1500) for _ in range(6000)]
    began = time.process_time()
    got = stateful.Buckets(0.75).place(messages)[0]
    assert time.process_time() - began < 8
    assert got[:150] == plain(messages[:150])


def test_rounds_give_the_same_buckets(spark):
    from datetime import datetime, timedelta

    random.seed(10)
    texts = [line(40) for _ in range(240)] + varied(60, "abc ", 40) + ["z" * 230 + str(i) for i in range(6)] + ["y" * 9 + "中"]
    rows = [(k, i, None if i < 5 else datetime(2024, 1, 1) + timedelta(minutes=i // 3), random.choice(texts)) for i in range(500) for k in ("a", None)]
    rows += [("late", i, datetime(2025, 1, 1) + timedelta(minutes=i), random.choice(texts)) for i in range(60)] + [("b", 1, datetime(2024, 1, 1), "x"), ("b", 2, None, None)]
    df = spark.createDataFrame(rows, "key string, id long, ts timestamp, message string").repartition(5)
    got = stateful.alike(df, alone=30).collect()
    assert len(got) == len(rows)
    for key in ("a", None, "late", "b"):
        own = sorted((r for r in got if r.key == key and r.message is not None), key=lambda r: (r.ts is not None, r.ts or datetime.min, r.id))
        assert [r.bucket for r in own] == plain([r.message for r in own])
    assert [(r.key, r.id, r.bucket) for r in got if r.message is None] == [("b", 2, None)]
    assert sorted(map(str, got)) == sorted(map(str, stateful.alike(df).collect()))
