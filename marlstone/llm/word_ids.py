"""Token ids of whole texts, for operators that need them and do not encode themselves.

The ids are the tokenizers library's.  Merges of all words that a batch brings
for the first time are made together, in rounds over arrays: in each round every
word makes its leftmost merge of lowest rank, as the library's queue would.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from .bpe import byte_letters, encoder

HELD = 100_000  # pieces whose ids by the library a worker holds
LONG = 64  # words and pieces of so many bytes and more are not held; they go to the library's own model
CHUNK = 1 << 20  # bytes of text at once, about


class MergeRounds:
    """BPE of many words at once, over a vocabulary with an end-of-word suffix."""

    NONE = np.uint32(0xFFFFFFFF)

    def __init__(self, vocab: dict[str, int], merges: list, end: str):
        letters = byte_letters()
        missing = 1 << 32
        self.first = np.array([[vocab.get(c + e, missing) for c in letters] for e in ("", end)], np.int64)
        self.known = self.first < missing
        pairs: dict[int, int] = {}
        made = np.zeros(len(merges), np.int64)
        for k, m in enumerate(merges):
            a, b = m.split(" ") if isinstance(m, str) else m
            pairs.setdefault(vocab[a] << 16 | vocab[b], k)
            made[k] = vocab[a + b]
        if max(vocab.values()) >> 16:
            raise ValueError("ids beyond 16 bits")
        self.made = made
        # a table of one key a slot; keys that share a slot are looked up in a sorted list instead
        self.shift = np.uint64(64 - 20)
        keys = np.array(sorted(pairs), np.uint64)
        ranks = np.array([pairs[int(k)] for k in keys], np.uint32)
        slots = self._slots(keys)
        alone = np.bincount(slots, minlength=1 << 20)[slots] == 1
        self.keys, self.ranks = np.zeros(1 << 20, np.uint64), np.full(1 << 20, self.NONE, np.uint32)
        self.crowded = np.uint64(1 << 63)
        self.keys[slots[~alone]] = self.crowded
        self.keys[slots[alone]], self.ranks[slots[alone]] = keys[alone], ranks[alone]
        self.more, self.more_ranks = keys[~alone], ranks[~alone]

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the merge of each a and b, NONE where there is none."""
        keys = (a.astype(np.uint64) << np.uint64(16)) | b.astype(np.uint64)
        slots = self._slots(keys)
        there = self.keys[slots]
        out = np.where(there == keys, self.ranks[slots], self.NONE)
        odd = np.flatnonzero(there == self.crowded)
        if len(odd) and len(self.more):
            at = np.minimum(np.searchsorted(self.more, keys[odd]), len(self.more) - 1)
            out[odd] = np.where(self.more[at] == keys[odd], self.more_ranks[at], self.NONE)
        return out

    def encode(self, raw: np.ndarray, lens: np.ndarray, ended: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words (UTF-8, none empty) that stand one after the other in raw, and how many each has.

        A word with a byte that the vocabulary lacks has no ids.  Without ended the words have no mark of their end.
        """
        ends = np.cumsum(lens)
        last = np.zeros(len(raw), np.int64)
        last[ends - 1] = ended
        sound = np.logical_and.reduceat(self.known[last, raw], ends - lens)
        whole = np.repeat(sound, lens)
        sym, number, n_words = self.first[last[whole], raw[whole]], np.flatnonzero(sound), len(lens)
        lens = lens[sound]
        starts = np.cumsum(lens) - lens
        rank = np.full(len(sym), self.NONE, np.uint32)
        rank[:-1] = self.rank(sym[:-1], sym[1:])
        rank[starts + lens - 1] = self.NONE
        took: list[tuple] = [(np.zeros(0, np.int64),) * 3]
        while len(lens):
            best = np.minimum.reduceat((rank.astype(np.uint64) << np.uint64(32)) | np.arange(len(rank), dtype=np.uint64), starts)
            low = (best >> np.uint64(32)).astype(np.uint32)
            at = (best & np.uint64(0xFFFFFFFF)).astype(np.int64)
            done = low == self.NONE
            if 4 * np.count_nonzero(done) >= len(done):  # take out what is finished
                here = np.repeat(done, lens)
                took.append((number[done], lens[done], sym[here]))
                rel, go = (at - starts)[~done], ~here
                sym, rank, lens, number, low = sym[go], rank[go], lens[~done], number[~done], low[~done]
                starts = np.cumsum(lens) - lens
                at, done = starts + rel, np.zeros(len(lens), bool)
                if not len(lens):
                    break
            act = ~done
            at, low = at[act], low[act]
            sym[at] = self.made[low]
            go = np.ones(len(sym), bool)
            go[at + 1] = False
            sym, rank = sym[go], rank[go]
            lens[act] -= 1
            starts = np.cumsum(lens) - lens
            at -= np.arange(len(at))
            first, final = starts[act], starts[act] + lens[act] - 1
            rank[at] = self.NONE
            right = at[at < final]
            rank[right] = self.rank(sym[right], sym[right + 1])
            left = at[at > first] - 1
            rank[left] = self.rank(sym[left], sym[left + 1])
        number, lens, sym = (np.concatenate(x) for x in zip(*took))
        counts = np.zeros(n_words, np.int64)
        counts[number] = lens
        out = np.empty(len(sym), np.uint32)
        out[spread((np.cumsum(counts) - counts)[number], lens)] = sym
        return out, counts


def spread(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """starts[0], ..., starts[0] + lens[0] - 1, starts[1], ...: the places of runs, one after the other."""
    return np.repeat(starts - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())


SPACE, LETTER, DIGIT, SIGN, ODD = range(5)
_CLASS = np.array([SPACE if b == 32 or 9 <= b <= 13 else DIGIT if 48 <= b <= 57 else LETTER if chr(b).isalpha() else SIGN for b in range(128)] + [ODD] * 128, np.uint8)
_CLASS[0xC3] = LETTER  # U+00C0 to U+00FF; what follows it is seen to below
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_CONTRACTS = np.zeros(256, bool)
_CONTRACTS[list(b"stmdrvlSTMDRVL")] = True
_ODD_NUMBER = np.uint64(0x9E3779B97F4A7C15)


class TextIds:
    """Texts to their ids.

    Words of ASCII and of U+00C0 to U+00FF are found, lower-cased and told
    apart as arrays; whatever else stands between white space (other letters,
    special tokens, contractions, very long words) goes to the library piece by piece.
    """

    def __init__(self, path: str, method: type = MergeRounds):
        """method makes the ids of plain words; other words are the library model's, or PrefixBpe's for another method than merging."""
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.encoder = encoder(path, method is MergeRounds)
        self.rounds = method(model["vocab"], model["merges"], model["end_of_word_suffix"] or "")
        self.held: dict[bytes, np.ndarray] = {}
        self.up = self.down = np.zeros(0, np.uint64)

    def _by_library(self, piece: bytes) -> np.ndarray:
        got = self.held.get(piece)
        if got is None:
            e = self.encoder
            got = np.array([i for w in e.split(piece.decode("utf-8", "replace")) for i in e.ids(w)], np.uint32)
            if len(piece) < LONG:
                if len(self.held) >= HELD:
                    self.held.clear()
                self.held[piece] = got
        return got

    def _keys(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each word."""
        if len(self.up) < len(raw):
            n = 1 << len(raw).bit_length()
            self.up, self.down = (np.cumprod(np.concatenate(([np.uint64(1)], np.full(n - 1, np.uint64(b), np.uint64))), dtype=np.uint64) for b in (int(_ODD_NUMBER), pow(int(_ODD_NUMBER), -1, 1 << 64)))
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.down[: len(raw)], out=total[1:])
        h = (total[ends] - total[starts]) * self.up[starts]
        h ^= h >> np.uint64(32)
        return h * np.uint64(0xD6E8FEB86659FD93)

    def _part(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The ids of text, which starts and ends with white space, and for each byte the number of ids of words that start before it."""
        raw = np.frombuffer(text, np.uint8)
        kind = _CLASS[raw]
        lead = np.flatnonzero(raw == 0xC3)
        lead = lead[raw[lead + 1] >= 0x80]  # a lead byte stands before white space only in text that is no UTF-8
        follow = raw[lead + 1]
        sign = (follow == 0x97) | (follow == 0xB7)
        kind[lead + 1] = np.where(sign, SIGN, LETTER)
        kind[lead[sign]] = SIGN
        low = _LOWER[raw]
        up = lead[(follow < 0x9F) & ~sign]
        low[up + 1] = raw[up + 1] + np.uint8(32)

        odd = kind == ODD
        odd[:-1] |= (raw[:-1] == 39) & _CONTRACTS[raw[1:]] | (raw[:-1] == 60) & (raw[1:] == 124)
        gaps = np.flatnonzero(kind == SPACE)
        if odd.any():  # the whole piece is then one word, which the library takes
            before = np.concatenate(([0], np.cumsum(odd)))[gaps]
            strange = np.flatnonzero(before[1:] > before[:-1])
            kind[spread(gaps[strange] + 1, gaps[strange + 1] - gaps[strange] - 1)] = ODD
        new = np.empty(len(raw), bool)
        new[0] = kind[0] != SPACE
        new[1:] = (kind[1:] != SPACE) & ((kind[1:] != kind[:-1]) | (kind[1:] == DIGIT))
        starts = np.flatnonzero(new)
        stop = np.empty(len(raw), bool)
        stop[-1] = kind[-1] != SPACE
        stop[:-1] = (kind[:-1] != SPACE) & (new[1:] | (kind[1:] == SPACE))
        ends = np.flatnonzero(stop) + 1
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(raw) + 1, np.int64)

        lens = ends - starts
        plain = (kind[starts] != ODD) & (lens < LONG)
        _, once, which = np.unique(self._keys(low, starts[plain], ends[plain]), return_index=True, return_inverse=True)
        at, size = starts[plain][once], lens[plain][once]
        ids, counts = self.rounds.encode(low[spread(at, size)], size) if len(once) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        unknown = counts == 0
        n, place = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        n[plain], place[plain] = counts[which], (np.cumsum(counts) - counts)[which]
        more, size = [ids], len(ids)
        slow = ~plain
        if unknown.any():
            slow[plain] = unknown[which]
        for i in np.flatnonzero(slow).tolist():
            got = self._by_library(text[starts[i] : ends[i]])
            n[i], place[i] = len(got), size
            more.append(got)
            size += len(got)
        out = np.concatenate(more)[spread(place, n)]
        before = np.zeros(len(raw) + 1, np.int64)
        before[ends] = n
        return out, np.cumsum(before)

    def of(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """The ids of each text (UTF-8), as unsigned 32-bit numbers, in the order given."""
        at = 0
        while at < len(texts):
            size, n = 0, 0
            while at + n < len(texts) and (n == 0 or size + len(texts[at + n]) <= CHUNK):
                size += len(texts[at + n])
                n += 1
            group = texts[at : at + n]
            if size <= 2 * CHUNK:
                ids, before = self._part(b"\n" + b"\n".join(group) + b"\n")
                z = 0
                for t in group:
                    a, z = z, z + len(t) + 1
                    yield ids[before[a] : before[z]]
            else:
                yield np.concatenate([self._part(p)[0] for p in self._cut(group[0])])
            at += n

    @staticmethod
    def _cut(text: bytes) -> Iterator[bytes]:
        """Parts of a long text between white space, each with white space around it."""
        at = 0
        while at < len(text):
            z = len(text) if at + CHUNK >= len(text) else max(text.rfind(c, at, at + CHUNK) for c in (b" ", b"\n")) + 1
            if z <= at:  # no white space within a chunk: on to the next
                z = min((k for k in (text.find(c, at + CHUNK) for c in (b" ", b"\n")) if k >= 0), default=len(text) - 1) + 1
            yield b"\n" + text[at:z] + b"\n"
            at = z


@lru_cache(maxsize=4)
def text_ids(path: str) -> TextIds:
    return TextIds(path)
