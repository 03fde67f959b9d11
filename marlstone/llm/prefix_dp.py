"""BPE of many words at once by dynamic programming over their prefixes.

The same method as ``bpe.PrefixBpe``, a place of all words at a time: an automaton
over the vocabulary says which tokens end there, longest first; a token is the
last one of that prefix if BPE would keep it apart from the last token of the
prefix before it, which is decided by undoing merges on both sides of the seam.
Each prefix has exactly one last token; back-pointers give the ids.
"""

from __future__ import annotations

import numpy as np

from .bpe import byte_letters
from .word_ids import MergeRounds

END = 256  # the mark after a word's last byte
SLOTS = 20  # bits of the tables
_ODD = np.uint64(0x9E3779B97F4A7C15)


class SlotTable:
    """Numbers below 2 ** 63 to small numbers: one a slot, those that share one in a sorted list."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        keys = keys.astype(np.uint64)
        slots = self.slots(keys)
        alone = np.bincount(slots, minlength=1 << SLOTS)[slots] == 1
        self.crowded = np.uint64(1 << 63)
        self.keys, self.values = np.full(1 << SLOTS, self.crowded - np.uint64(1), np.uint64), np.full(1 << SLOTS, -1, np.int32)
        self.keys[slots[~alone]] = self.crowded
        self.keys[slots[alone]], self.values[slots[alone]] = keys[alone], values[alone]
        order = np.argsort(keys[~alone])
        self.more, self.more_values = keys[~alone][order], values[~alone][order].astype(np.int32)

    @staticmethod
    def slots(keys: np.ndarray) -> np.ndarray:
        return ((keys * _ODD) >> np.uint64(64 - SLOTS)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values, -1 for what is not there."""
        slots = self.slots(keys)
        there = self.keys[slots]
        out = np.where(there == keys, self.values[slots], np.int32(-1))
        odd = np.flatnonzero(there == self.crowded)
        if len(odd) and len(self.more):
            at = np.minimum(np.searchsorted(self.more, keys[odd]), len(self.more) - 1)
            out[odd] = np.where(self.more[at] == keys[odd], self.more_values[at], -1)
        return out


class PrefixDp:
    def __init__(self, vocab: dict[str, int], merges: list, end: str):
        self.rounds = MergeRounds(vocab, merges, end)
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        tokens = {}
        for t, i in vocab.items():
            ended = bool(end) and t.endswith(end)
            stem = t.removesuffix(end) if ended else t
            if all(c in byte_of for c in stem):
                tokens[i] = [byte_of[c] for c in stem] + [END] * ended
        n = max(vocab.values()) + 1
        self.length = np.zeros(n, np.int64)
        self.part = np.full((3, n), -1, np.int64)  # of the merge that makes a token: its rank, its left and its right side
        for k, m in enumerate(merges):
            a, b = m.split(" ") if isinstance(m, str) else m
            made = vocab[a + b]
            if self.part[0, made] < 0:
                self.part[:, made] = k, vocab[a], vocab[b]
        self._automaton(tokens)
        self._sound(tokens)
        self.seen_pairs, self.seen_apart = np.full(1 << SLOTS, (1 << 63) - 1, np.uint64), np.zeros(1 << SLOTS, bool)

    def _automaton(self, tokens: dict[int, list[int]]) -> None:
        """Nodes are prefixes of tokens; longest is the longest token that a node's string ends with, shorter the next one after a token."""
        children: dict[int, int] = {}
        parent, symbol, depth = [0], [0], [0]
        node_of = np.zeros(len(self.length), np.int64)
        for i, word in tokens.items():
            at = 0
            for d, s in enumerate(word):
                key = at << 9 | s
                to = children.get(key)
                if to is None:
                    to = children[key] = len(parent)
                    parent.append(at)
                    symbol.append(s)
                    depth.append(d + 1)
                at = to
            node_of[i], self.length[i] = at, len(word)
        self.step_table = SlotTable(np.array(list(children), np.uint64), np.array(list(children.values()), np.int32))
        parent, symbol, depth = (np.array(x, np.int64) for x in (parent, symbol, depth))
        self.fail, self.longest = np.zeros(len(parent), np.int64), np.full(len(parent), -1, np.int64)
        own = np.full(len(parent), -1, np.int64)
        own[node_of[list(tokens)]] = list(tokens)
        for d in range(1, int(depth.max()) + 1):
            at = np.flatnonzero(depth == d)
            if d > 1:
                self.fail[at] = self.step(self.fail[parent[at]], symbol[at])
            self.longest[at] = np.where(own[at] >= 0, own[at], self.longest[self.fail[at]])
        self.shorter = np.where(self.length > 0, self.longest[self.fail[node_of]], -1)

    def step(self, nodes: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        out = np.zeros(len(nodes), np.int64)
        left, at, s = np.arange(len(nodes)), nodes, symbols.astype(np.uint64)
        while len(left):
            to = self.step_table.get((at.astype(np.uint64) << np.uint64(9)) | s)
            found = to >= 0
            out[left[found]] = to[found]
            on = ~found & (at > 0)  # from the root there is nowhere to fall back to
            left, at, s = left[on], self.fail[at[on]], s[on]
        return out

    def _sound(self, tokens: dict[int, list[int]]) -> None:
        """Tokens that BPE makes of their own bytes."""
        self.stands = np.zeros(len(self.length), bool)
        for ended in (False, True):
            some = [(i, w[: len(w) - ended]) for i, w in tokens.items() if (w[-1] == END) == ended and len(w) > ended]
            if some:
                raw, lens = np.array([b for _, w in some for b in w], np.uint8), np.array([len(w) for _, w in some])
                ids, counts = self.rounds.encode(raw, lens, ended)
                first = np.minimum(np.cumsum(counts) - counts, max(0, len(ids) - 1))
                number = np.array([i for i, _ in some])
                self.stands[number] = (counts == 1) & (ids[first] == number)

    def apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether BPE of each two tokens' text gives just these two."""
        keys = (left.astype(np.uint64) << np.uint64(16)) | right.astype(np.uint64)
        slots = SlotTable.slots(keys)
        out = self.seen_apart[slots]
        new = np.flatnonzero(self.seen_pairs[slots] != keys)
        if len(new):
            found = self._apart(left[new], right[new])
            out[new] = found
            # pairs that share a slot: numpy keeps the last of both assignments, so key and answer go together
            self.seen_pairs[slots[new]], self.seen_apart[slots[new]] = keys[new], found
        return out

    def _apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ok, at, limit = np.ones(len(a), bool), np.arange(len(a)), np.full(len(a), 1 << 60)
        rank, first, second = self.part
        while len(at):
            across = self.rounds.rank(a, b)
            bad = (across != MergeRounds.NONE) & (2 * across.astype(np.int64) < limit)
            ok[at[bad]] = False
            ra, rb = rank[a], rank[b]
            go = ~bad & ((ra >= 0) | (rb >= 0))
            at, a, b, ra, rb = at[go], a[go], b[go], ra[go], rb[go]
            of_left = (rb < 0) | (ra > rb)  # the later merge is undone first; what ties with one on the left stands to its right
            limit = np.where(of_left, 2 * ra, 2 * rb + 1)
            a, b = np.where(of_left, second[a], a), np.where(of_left, b, first[b])
        return ok

    def encode(self, raw: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words (UTF-8, none empty) that stand one after the other in raw, and how many each has."""
        n = len(lens)
        order = np.argsort(-lens, kind="stable")  # longest first: those still running are always the first ones
        size = lens[order]
        start = (np.cumsum(lens) - lens)[order]
        last = np.full((n, int(size[0]) + 2), -1, np.int32)
        node = np.zeros(n, np.int64)
        for i in range(1, int(size[0]) + 2):
            k = n if i == 1 else int(np.searchsorted(-size, -(i - 1), "right"))  # words of i - 1 bytes and more
            ends = size[:k] < i
            symbol = np.where(ends, END, raw[np.minimum(start[:k] + i - 1, len(raw) - 1)].astype(np.int64))
            node[:k] = self.step(node[:k], symbol)
            at = np.flatnonzero(size[:k] != i)  # nothing but the mark's tokens ends where the last byte does
            token = self.longest[node[at]]
            at, token = at[token >= 0], token[token >= 0]
            while len(at):
                before = i - self.length[token]
                left = last[at, before].astype(np.int64)
                good = self.stands[token] & ((before == 0) | (left >= 0))
                seam = np.flatnonzero(good & (before > 0))
                good[seam] = self.apart(left[seam], token[seam])
                last[at[good], i] = token[good]
                token = self.shorter[token[~good]]
                at = at[~good][token >= 0]
                token = token[token >= 0]
        took, at, place = [], np.arange(n), size + 1
        counts = np.zeros(n, np.int64)
        while len(at):
            token = last[at, place].astype(np.int64)
            at, place, token = at[token >= 0], place[token >= 0], token[token >= 0]
            took.append((at, token))
            counts[at] += 1
            place = place - self.length[token]
            at, place = at[place > 0], place[place > 0]
        by_word = np.empty(n, np.int64)
        by_word[order] = counts
        to = (np.cumsum(by_word) - by_word)[order] + counts - 1
        out = np.zeros(int(counts.sum()), np.uint32)
        for k, (at, token) in enumerate(took):
            out[to[at] - k] = token
        return out, by_word
