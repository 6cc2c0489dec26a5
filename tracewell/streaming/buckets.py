"""Buckets of messages alike: which of them is the oldest that a message is alike, asked for many messages at once."""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterable
from difflib import SequenceMatcher

import numpy as np

#: Texts of at most so many letters are compared as arrays; SequenceMatcher takes any longer ones (from 200 letters on it drops frequent ones).
WIDE = 192


def codes(texts: list[str]) -> np.ndarray:
    """The letters of texts as numbers from 1, a row each; 0 stands behind the end."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    wide = max(1, int(lengths.max(initial=0)))
    flat = np.array(texts, f"U{wide}").view(np.uint32).reshape(len(texts), wide)
    return np.where(np.arange(wide) < lengths[:, None], flat + np.uint32(1), np.uint32(0))


def matched(left: np.ndarray, right: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Whether SequenceMatcher finds as many letters in matching blocks as needed, for pairs of rows of letters.

    As there, the longest block (of several, the first on the left, then on the right) divides a pair, and what stands before
    and behind it is searched in turn; here the parts of all pairs are searched at once, until a pair is decided.
    """
    n, kind = len(left), np.uint8 if max(left.max(initial=0), right.max(initial=0)) < 255 else np.uint32
    left, right, other, total = left.astype(kind), right.astype(kind), kind(np.iinfo(kind).max), np.zeros(n, np.int64)
    # A part: its pair, from and to on the left, from and to on the right.
    parts = np.stack([np.arange(n), np.zeros(n, np.int64), (left > 0).sum(axis=1), np.zeros(n, np.int64), (right > 0).sum(axis=1)])
    while parts.shape[1]:
        size = np.minimum(parts[2] - parts[1], parts[4] - parts[3])
        most = total + np.bincount(parts[0], size, n).astype(np.int64)
        parts = parts[:, (size > 0) & ((most >= need) & (total < need))[parts[0]]]
        parts = parts[:, np.argsort((parts[2] - parts[1]) * 256 + parts[4] - parts[3], kind="stable")]
        found, end = [parts[:, :0]], parts.shape[1]
        while end:
            # Parts of much the same size together.
            rows, columns = parts[2, end - 1] - parts[1, end - 1], (parts[4] - parts[3])[max(0, end - 2048) : end].max()
            start = max(0, end - max(1, min(2048, 2**20 // int(rows * columns))))
            p, i0, i1, j0, j1 = parts[:, start:end]
            span = np.arange(max(rows, columns))[:, None]
            a = np.where(i0 + span[:rows] < i1, left[p, np.minimum(i0 + span[:rows], left.shape[1] - 1)], kind(0))
            b = np.where(j0 + span[:columns] < j1, right[p, np.minimum(j0 + span[:columns], right.shape[1] - 1)], other)
            run, best = np.zeros((columns + 1, end - start), np.uint8), np.zeros(end - start, np.uint8)
            i, j = np.zeros((2, end - start), np.int64)
            for row in range(rows):
                run[1:] = (run[:-1] + np.uint8(1)) * (b == a[row]).view(np.uint8)
                longer = np.flatnonzero(run.max(axis=0) > best)
                if len(longer):
                    own = run[:, longer]
                    i[longer], j[longer], best[longer] = row + 1, own.argmax(axis=0), own.max(axis=0)
            i, j, k = i + i0, j + j0, best.astype(np.int64)
            total += np.bincount(p, k, n).astype(np.int64)
            found += [x[:, k > 0] for x in (np.stack([p, i0, i - k, j0, j - k]), np.stack([p, i, i1, j, j1]))]
            end = start
        parts = np.concatenate(found, axis=1)
    return total >= need


def alike(left: list[str], right: list[str], ratio: float) -> np.ndarray:
    """Whether SequenceMatcher(None, left, right).ratio() is at least `ratio`, for each pair of texts of at most WIDE letters."""
    if len(left) < 4:
        return np.array([SequenceMatcher(None, a, b).ratio() >= ratio for a, b in zip(left, right, strict=True)], bool)
    out = np.zeros(len(left), bool)
    for i in range(0, len(left), 1 << 15):
        a, b = left[i : i + (1 << 15)], right[i : i + (1 << 15)]
        length = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)])
        need = np.ceil(ratio * length / 2 - 1e-9).astype(np.int64)
        need += (length > 0) & (2.0 * need / np.maximum(length, 1) < ratio)
        out[i : i + len(a)] = matched(codes(a), codes(b), need)
    return out


def pairs(text: str) -> list[tuple[str, str, int]]:
    """Neighbouring letters, each time with its number."""
    seen: dict[tuple[str, str], int] = {}
    out = []
    for pair in zip(text, text[1:], strict=False):
        n = seen[pair] = seen.get(pair, 0) + 1
        out.append((*pair, n))
    return out


class Texts:
    """Texts by name, in the order of their letters."""

    def __init__(self, names: list[int], texts: list[str]):
        order = sorted(range(len(texts)), key=texts.__getitem__)
        self.names = np.array([names[k] for k in order], np.int64)
        self.lengths = np.fromiter((len(texts[k]) for k in order), np.int64, len(order))
        self.letters = codes([texts[k] for k in order])

    def keep(self, kept: np.ndarray) -> None:
        self.names, self.lengths, self.letters = self.names[kept], self.lengths[kept], self.letters[kept]


class Part:
    """Messages side by side: for each letter, the bits of its places in each.  Letters whose numbers end in the same eight bits
    share a row, so subsequences can only come out too long.  Those of more than WIDE letters count as empty."""

    def __init__(self, messages: list[str]):
        short = [m if len(m) <= WIDE else "" for m in messages]
        self.n, self.lengths, letters = len(short), np.array([len(m) for m in short], np.int64), codes(short)
        inside, letters = letters > 0, (letters - 1) & 255
        used = np.unique(letters[inside])
        self.rows = np.zeros(256, np.int64)
        self.rows[used] = np.arange(1, len(used) + 1)
        self.bits = np.zeros((-(-letters.shape[1] // 64), len(used) + 1, self.n), np.uint64)
        for i in range(letters.shape[1]):
            at = np.flatnonzero(inside[:, i])
            self.bits[i // 64, self.rows[letters[at, i]], at] |= np.uint64(1 << i % 64)

    def near(self, texts: Texts, low: int, ratio: float, tile: int = 512) -> np.ndarray:
        """Pairs of a text's name and a message's place, from low on, whose longest common subsequence is long enough for the ratio.

        A bit is 0 where the longest subsequence grows (Hyyro); sums carry from word to word.  Texts that begin with the same letters
        share the work up to where they part.
        """
        n, words, hits = self.n - low, len(self.bits), [np.zeros((0, 2), np.int64)]
        now, then = np.empty((2, words, tile, n), np.uint64)
        met = np.empty((tile, n), np.uint64)
        bits, lengths = np.ascontiguousarray(self.bits[:, :, low:]), self.lengths[low:]
        for start in range(0, len(texts.names), tile):
            letters, own = texts.letters[start : start + tile], texts.lengths[start : start + tile]
            same = np.zeros(len(own), np.int64)
            same[1:] = np.logical_and.accumulate(letters[1:] == letters[:-1], axis=1).sum(axis=1)
            rows, ends = self.rows[(letters - 1) & 255], set(own.tolist())
            deep = np.arange(1, own.max() + 1)[:, None]
            first = (own >= deep) & (same < deep)
            nodes, parents = np.cumsum(first, axis=1) - 1, np.zeros(len(own), np.int64)
            ones, before = np.full((len(own), n), 64 * words, np.int16), 1
            now[:, 0] = ~np.uint64(0)
            for d in range(len(deep)):
                at = np.flatnonzero(first[d])
                m, above = len(at), parents[at]
                if m != before or (above != np.arange(m)).any():
                    for w in range(words):
                        np.take(now[w], above, axis=0, out=then[w, :m], mode="clip")
                    now, then = then, now
                for w in range(words):
                    open_, grown, x = now[w, :m], then[w, :m], met[:m]
                    np.take(bits[w], rows[at, d], axis=0, out=x, mode="clip")
                    np.bitwise_and(open_, x, x)
                    np.add(open_, x, grown)
                    if words > 1:
                        over = grown < open_
                        if w:
                            grown += carry  # noqa: F821  set by the word before
                            over |= grown < carry  # noqa: F821
                        carry = over.astype(np.uint64)  # noqa: F841
                    np.subtract(open_, x, open_)
                    np.bitwise_or(open_, grown, open_)
                before, parents = m, nodes[d]
                if d + 1 in ends:
                    done = np.flatnonzero(own == d + 1)
                    ones[done] = np.bitwise_count(now[:, parents[done]]).sum(axis=0, dtype=np.int16)
            both = own[:, None] + lengths
            k, at = np.nonzero((2 * (64 * words - ones) >= ratio * both - 1e-9) & (2 * np.minimum(own[:, None], lengths) >= ratio * both - 1e-9))
            hits.append(np.stack([texts.names[start + k], at + low], axis=1))
        return np.concatenate(hits)


class Buckets:
    """Messages of a logger in the order in which they came up, and what finds those alike.

    Alike is a ratio (twice the letters in matching blocks by both lengths) of at least `ratio`.  Matching blocks are a common
    subsequence, so the longest one bounds them: it is worked out for many messages and PART buckets at a time, oldest first,
    and only what is left is looked at by the ratio itself.

    Where messages have few pairs of neighbouring letters in common, an index of pairs takes less time: with M letters in blocks of
    two messages of T letters together there are at most T - 2M + 1 blocks, so they have at least 3M - 1 - T pairs in common.
    """

    PART, BLOCK = 256, 1 << 17

    def __init__(self, ratio: float, messages: Iterable[str] = ()):
        self.ratio, self.known, self.messages, self.parts, self.seen = ratio, {}, [], {}, 0
        self.lengths, self.holders, self.indexed = array("q"), defaultdict(lambda: array("q")), 0
        self.long = False
        for message in messages:
            self.add(message)

    def add(self, message: str) -> None:
        self.known[message] = len(self.messages)
        self.messages.append(message)
        self.lengths.append(len(message))
        self.long |= len(message) > WIDE

    def candidates(self, message: str, start: int = 0) -> np.ndarray:
        """Places of buckets from start on that have as many pairs in common with the message as the ratio asks for."""
        for at in range(self.indexed, len(self.messages)):
            for pair in pairs(self.messages[at]):
                self.holders[pair].append(at)
        self.indexed = len(self.messages)
        lengths = np.frombuffer(self.lengths, np.int64)[start:]
        own = [x if not start else x[bisect_left(x, start) :] for x in map(self.holders.get, pairs(message)) if x]
        common = np.bincount(np.frombuffer(b"".join(own), np.int64) - start, minlength=len(lengths))
        # First by the least length that the ratio allows.
        near = np.flatnonzero(common >= (1.5 * self.ratio - 1) * len(message) * 2 / (2 - self.ratio) - 1 - 1e-9) if self.ratio > 2 / 3 else np.arange(len(common))
        both = lengths[near] + len(message)
        return start + near[(common[near] >= (1.5 * self.ratio - 1) * both - 1 - 1e-9) & (2 * np.minimum(lengths[near], len(message)) >= self.ratio * both - 1e-9)]

    def rare(self, texts: list[str], start: int) -> bool:
        """Whether the index of pairs takes less time than subsequences (ns, as measured), by some texts and buckets."""
        ours, theirs = ([set(pairs(m)) for m in x[:: len(x) // 24 + 1]] for x in (texts, self.messages))
        common = sum(len(a & b) for a in ours for b in theirs) / len(ours) / len(theirs)
        letters = sum(map(len, texts)) / len(texts)
        dense = 3.5 * letters * (1 if letters <= 64 else letters / 32) * (len(self.messages) - start)
        return 2 * (60_000 + (10 + 4 * common) * (len(self.messages) - start)) < dense

    def long_pairs(self, text: str, places: Iterable[int], found: int) -> int:
        """The oldest of found and those of the places that are alike; what is too long for arrays is looked at one by one."""
        matcher = SequenceMatcher(None, "", text)
        for at in places:
            if 0 <= found < at:
                break
            if len(text) > WIDE or self.lengths[at] > WIDE:
                matcher.set_seq1(self.messages[at])
                if matcher.real_quick_ratio() >= self.ratio and matcher.quick_ratio() >= self.ratio and matcher.ratio() >= self.ratio:
                    return at
        return found

    def oldest(self, texts: list[str], start: int = 0) -> np.ndarray:
        """For each text the place of the oldest bucket from start on that it is alike; -1 if there is none."""
        found, rest = np.full(len(texts), -1), []
        if not texts or len(self.messages) == start:
            return found
        rare, few = self.rare(texts, start), [np.zeros((0, 2), np.int64)]
        for k, text in enumerate(texts):
            if len(text) <= WIDE:
                near = self.candidates(text, start).tolist() if rare else ()
                if rare and len(near) <= 32:
                    few.append(np.array([(k, at) for at in near if self.lengths[at] <= WIDE], np.int64).reshape(-1, 2))
                else:
                    rest.append(k)
        self.settle(texts, found, np.concatenate(few))
        left = Texts(rest, [texts[k] for k in rest])
        for p in range(start // self.PART, -(-len(self.messages) // self.PART)):
            if not len(left.names):
                break
            if p not in self.parts or self.parts[p].n < min(self.PART, len(self.messages) - p * self.PART):
                self.parts[p] = Part(self.messages[p * self.PART : (p + 1) * self.PART])
            self.settle(texts, found, self.parts[p].near(left, max(0, start - p * self.PART), self.ratio) + (0, p * self.PART))
            left.keep(found[left.names] < 0)
        for k, text in enumerate(texts):
            if self.long or len(text) > WIDE:
                found[k] = self.long_pairs(text, self.candidates(text, start).tolist(), found[k])
        return found

    def settle(self, texts: list[str], found: np.ndarray, hits: np.ndarray) -> None:
        """Put the oldest of the pairs (text, bucket) that are alike into found."""
        yes = hits[alike([self.messages[at] for at in hits[:, 1].tolist()], [texts[k] for k in hits[:, 0].tolist()], self.ratio)]
        best = np.full(len(texts), len(self.messages))
        np.minimum.at(best, yes[:, 0], yes[:, 1])
        found[yes[:, 0]] = best[yes[:, 0]]

    def admit(self, texts: list[str]) -> dict[str, int]:
        """The places of texts that no bucket so far is alike, in turn: one alike a text before, or a bucket of its own."""
        out, start = {}, len(self.messages)
        for i in range(0, len(texts), self.PART):
            some = texts[i : i + self.PART]
            found = dict(zip(some, self.oldest(some, start).tolist(), strict=True))
            out |= {t: at for t, at in found.items() if at >= 0}
            some = [t for t in some if found[t] < 0]
            if not some:
                continue
            # Each with all before it; only those that become buckets count.
            short = [k for k, t in enumerate(some) if len(t) <= WIDE]
            if len(some) > 3:
                hits = Part(some).near(Texts(short, [some[k] for k in short]), 0, self.ratio)
            else:
                hits = np.array([(k, at) for k in short for at in short], np.int64).reshape(-1, 2)
            hits = hits[hits[:, 0] > hits[:, 1]]
            yes, before, first = hits[alike([some[k] for k in hits[:, 1].tolist()], [some[k] for k in hits[:, 0].tolist()], self.ratio)], defaultdict(list), len(self.messages)
            for k, at in yes.tolist():
                before[k].append(at)
            for k, text in enumerate(some):
                own = min((self.known[some[at]] for at in before[k] if some[at] in self.known), default=-1)
                if len(short) < len(some):
                    own = self.long_pairs(text, range(first, len(self.messages)), own)
                if own < 0:
                    own = len(self.messages)
                    self.add(text)
                out[text] = own
        return out

    def place(self, messages: Iterable[str]) -> tuple[list[str], list[str]]:
        """The bucket of each message in turn, and the buckets that are new.

        As many messages as came before are asked at once for the buckets of before; those without one are few, once there are many.
        """
        messages, chosen, size = list(messages), [], len(self.messages)
        while len(chosen) < len(messages):
            block = messages[len(chosen) : len(chosen) + min(max(512, self.seen, size), self.BLOCK)]
            self.seen += len(block)
            asked = list(dict.fromkeys(m for m in block if m not in self.known))
            found = dict(zip(asked, self.oldest(asked).tolist(), strict=True))
            found |= self.admit([m for m in asked if found[m] < 0])
            chosen += [m if m in self.known else self.messages[found[m]] for m in block]
        return chosen, self.messages[size:]
