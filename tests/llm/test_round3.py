"""What the third round of review found in the operators for training data."""

import random
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
from tokenizers import AddedToken

from tracewell.llm import records, toxicity
from tracewell.llm.queries import vocabulary


def test_shards_send_only_places_that_their_rows_have():
    p = toxicity.Ftrl(bits=10, shards=4, passes=1)
    state = (np.arange(1025, dtype=np.int32), np.full(1025, 0.5), np.full(1025, 2.0))
    none, sent = SimpleNamespace(value=None), SimpleNamespace(value=state)
    packed = toxicity._packed(np.array([3, 900]), np.zeros(2), np.zeros(2))[0]
    rows = pd.DataFrame({"h": [1], "label": [1], "places": [packed], "shard": [2]})
    made = toxicity._shard(sent, p)(rows)
    got = [toxicity._unpacked(*x) for x in zip(made["places"], made["z"], made["n"], strict=True)]
    assert np.concatenate([x[0] for x in got]).tolist() == [3, 900, 1024] and set(made["shard"]) == {2}
    mean = toxicity._mean(sent, 4, p)(made[made["part"] == 0])
    at, z, n = toxicity._unpacked(*mean.iloc[0][["places", "z", "n"]])
    assert at.tolist() == list(range(64)) and (z[at != 3] == 0.5).all() and (n[at != 3] == 2).all()
    assert z[3] == (got[0][1][0] + 3 * 0.5) / 4 and n[3] == (got[0][2][0] + 3 * 2) / 4
    assert len(toxicity._mean(none, 4, p)(made[made["part"] == 0])) == 1
    at, z, _ = toxicity._unpacked(*toxicity._mean(sent, 1, p)(made[made["part"] == 0]).iloc[0][["places", "z", "n"]])
    assert (z[at != 3] == 0.5 / 4).all()  # of four shards only one has rows; the others hold nothing


def equal_to_the_library(tok, texts):
    flat, ends = tok.encode(pa.array(texts))
    theirs = tok.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
    for t, ids, e in zip(texts, np.split(flat, ends[:-1]), theirs, strict=True):
        assert ids.tolist() == e.ids, t


def test_words_are_encoded_once_whatever_signs_stand_at_them():
    tok, seen = records.Pieces(vocabulary("byte_bpe_50k.json")), []
    ids = tok.ids
    tok.ids = lambda words, *more: seen.append(len(words)) or ids(words, *more)
    equal_to_the_library(tok, [" " + "".join(f"{a}{w}{b} " for w in ("wordlet", "otherling", "thirdness") for a in '("[{#' for b in ")]}.,;:!?-")])
    # three words after a sign, five signs behind a blank, ten behind a word, the blank at the end; each pair of signs made words of its own before
    assert seen == [3 + 5 + 10 + 1]


def test_pieces_beside_signs_wide_blanks_and_special_tokens(tmp_path):
    tok = records.Pieces(vocabulary("byte_bpe_50k.json"))
    parts = ["a", " ", "\n", "'", "'s", "'LL", "1", "é", "à", "漢", "!!", ",", "_", "\u00a0", "\u3000", "\u2009", "\u1680", "\x85", "\x1c", "\0", "\u0301", "½", "foo", "<|", "|>"]
    pick = random.Random(8)
    for more in ([], ["<|endoftext|>"]):
        equal_to_the_library(tok, [None, "", *["".join(pick.choice(parts + more) for _ in range(pick.randrange(30))) for _ in range(3000)]])
    # two texts whose pieces would be a special token side by side, and tokens that take blanks beside them
    tok.tokenizer.add_special_tokens([AddedToken("a b", normalized=False), AddedToken("<s>", lstrip=True, rstrip=True, normalized=False)])
    tok.tokenizer.save(str(tmp_path / "own.json"))
    equal_to_the_library(records.Pieces(str(tmp_path / "own.json")), [" x", "y a b c", "a", " b", "a c", "d b", "d <s> e", "<s>\n\nf, <s>", "g<|endoftext|> h,i"])


def test_long_pieces_are_not_remembered():
    tok = records.Pieces(vocabulary("byte_bpe_50k.json"))
    equal_to_the_library(tok, ["a\u00a0b c, " * 500, "x" * 5000, "y " * 300])
    assert len(tok.known) < 20 and max(map(len, tok.known)) <= 100
