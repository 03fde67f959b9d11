"""BPE encoding by dynamic programming over prefixes, and decoding.

For a word, every prefix has exactly one token that can end its encoding.  An
automaton over the vocabulary yields, at each position, every token that is a
suffix of the prefix there (longest first, by its suffix links).  Such a token
is the last one if it is what BPE makes of its own characters and BPE would
keep it apart from the last token of the prefix before it; that is decided by
undoing merges on both sides of the seam.  Back-pointers give the ids.
``prefix_dp`` does the same for all words of a batch at once; words that are
long or not of plain letters take this way.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import bounded_batches, table

WORD_END = "\ue000"  # stands for the vocabulary's end-of-word suffix inside the automaton
PLAIN = re.compile("[\x00-ɏ]*")
HELD = 200_000  # entries of a generation of a worker's caches


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in out:
            out[b], extra = chr(extra), extra + 1
    return [out[b] for b in range(256)]


class PrefixBpe:
    """Encoder of single words (already normalised and split, in byte letters)."""

    def __init__(self, vocab: dict[str, int], merges: list, end: str | None):
        self.end = end or ""
        mark = lambda t: t.removesuffix(end) + WORD_END if end and t.endswith(end) else t
        self.ids = {mark(t): i for t, i in vocab.items()}
        self.rank: dict[tuple[str, str], int] = {}
        self.parts: dict[str, tuple[int, str, str]] = {}
        for k, m in enumerate(merges):
            a, b = map(mark, m.split(" ") if isinstance(m, str) else m)
            self.rank.setdefault((a, b), k)
            self.parts.setdefault(a + b, (k, a, b))
        self.seams: dict[tuple[str, str], bool] = {}
        self.sound: dict[str, bool] = {}
        self.suffixes = ahocorasick.Automaton()
        for t in self.ids:
            self.suffixes.add_word(t, t)
        self.suffixes.make_automaton()

    def kept_apart(self, left: str, right: str) -> bool:
        """Whether BPE of the two tokens' text gives just these two.

        Merges are undone from the latest one; a merge across the seam must
        come no earlier than what is still in place beside it.  On equal rank
        the left one goes first.
        """
        known = self.seams.get((left, right))
        if known is not None:
            return known
        a, b, limit, ok = left, right, (1 << 60, 0), True
        while True:
            across = self.rank.get((a, b))
            if across is not None and (across, 0) < limit:
                ok = False
                break
            pa_, pb = self.parts.get(a), self.parts.get(b)
            if pa_ is None and pb is None:
                break
            if pb is None or pa_ is not None and pa_[0] > pb[0]:
                limit, a = (pa_[0], 0), pa_[2]  # a merge of the left token's own: what ties with it stands to its right
            else:
                limit, b = (pb[0], 1), pb[1]
        if len(self.seams) >= 2 * HELD:
            self.seams.clear()
        self.seams[left, right] = ok
        return ok

    def symbols(self, token: str) -> list[str]:
        out = list(token)
        if out and out[-1] == WORD_END:
            out[-2:] = ["".join(out[-2:])]
        return out

    def stands(self, token: str) -> bool:
        """Whether BPE of the token's own characters gives the token."""
        known = self.sound.get(token)
        if known is None:
            at = self.symbols(token)
            while len(at) > 1:
                k, i = min(((self.rank.get(x, 1 << 60), i) for i, x in enumerate(zip(at, at[1:]))), default=(1 << 60, 0))
                if k == 1 << 60:
                    break
                at[i : i + 2] = [at[i] + at[i + 1]]
            known = self.sound[token] = at == [token]
        return known

    def encode(self, word: str) -> list[int]:
        """ids of one word; characters that the vocabulary lacks are left out, as the library does without an unknown token."""
        n = len(word)
        if not n:
            return []
        word += WORD_END if self.end else ""
        last: list[str | None] = [None] * (len(word) + 1)
        apart, stands = self.kept_apart, self.stands
        for at, token in self.suffixes.iter(word):
            at += 1
            if last[at] is not None:
                continue
            before = at - len(token)
            if before == 0 or last[before] is not None and apart(last[before], token):
                if stands(token):
                    last[at] = token
        at, out = len(word), []
        while at > 0:
            if last[at] is None:
                raise ValueError(f"no encoding ends at {at} of {word!r}")
            out.append(self.ids[last[at]])
            at -= len(last[at])
        out.reverse()
        return out


class Encoder:
    """Whole texts, as the tokenizers library encodes them with add_special_tokens=False.

    A text is cut at white space first, which no token crosses.  Pieces of plain
    letters are normalised and split here; others by the library's own
    normaliser and splitter.  ``by_library`` takes the ids of a word from the
    library's model.
    """

    def __init__(self, path: str, by_library: bool = False):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.lib = Tokenizer.from_file(path)
        self.model = self.lib.model
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.cut_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.rule = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        letters = byte_letters()
        self.letters = str.maketrans({chr(b): c for b, c in enumerate(letters)})
        self.bytes = {ord(c): b for b, c in enumerate(letters)}
        self.bpe = None if by_library else PrefixBpe(spec["model"]["vocab"], spec["model"]["merges"], spec["model"]["end_of_word_suffix"])
        names = {i: t for t, i in spec["model"]["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.names = {i: t.encode() for i, t in names.items()}

    def ids(self, word: str | int) -> list[int]:
        """ids of one normalised word; a number is a special token's id."""
        if isinstance(word, int):
            return [word]
        if not (word.isascii() and word.isalpha()):
            word = word.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.model.tokenize(word)] if self.bpe is None else self.bpe.encode(word)

    def split(self, text: str) -> list[str | int]:
        """Normalised words of a piece of text whose borders no token crosses."""
        if "<|" in text:
            parts = self.cut_special.split(text)
            if len(parts) > 1:
                return [w for i, p in enumerate(parts) for w in ([self.special[p]] if i % 2 else self.split(p))]
        if PLAIN.fullmatch(text):
            return self.rule.findall(text.lower())
        return [w.translate(self.bytes).encode("latin-1").decode() for w, _ in self.lib.pre_tokenizer.pre_tokenize_str(self.lib.normalizer.normalize_str(text))]


@lru_cache(maxsize=4)
def encoder(path: str, by_library: bool = False) -> Encoder:
    return Encoder(path, by_library)


class Spelling:
    """What stands for each id, joined by spaces."""

    AT_ONCE = 1 << 16

    def __init__(self, cells: list[bytes]):
        self.raw = np.frombuffer(b"".join([c + b" " for c in cells]), np.uint8)
        self.lens = np.array([len(c) + 1 for c in cells])
        self.starts = np.cumsum(self.lens) - self.lens

    def parts(self, ids: np.ndarray) -> Iterator[bytes]:
        for at in range(0, len(ids), self.AT_ONCE):
            part = ids[at : at + self.AT_ONCE]
            lens = self.lens[part]
            text = self.raw[np.repeat(self.starts[part] - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())].tobytes()
            yield text if at + self.AT_ONCE < len(ids) else text[:-1]

    def digest(self, ids: np.ndarray) -> str:
        h = sha256()
        for part in self.parts(ids):
            h.update(part)
        return h.hexdigest()


@lru_cache(maxsize=4)
def spellings(path: str) -> tuple[Spelling, Spelling]:
    """Ids in decimal, and tokens as the library's decode shows them: this vocabulary has no decoder, so names joined by spaces."""
    names = encoder(path).names
    top = 1 + max(names)
    return Spelling([b"%d" % i for i in range(top)]), Spelling([names.get(i, b"") for i in range(top)])


@lru_cache(maxsize=4)
def prefix_ids(path: str):
    """Ids of whole texts by the dynamic programming over prefixes."""
    from .prefix_dp import PrefixDp
    from .word_ids import TextIds

    return TextIds(path, PrefixDp)


def encode(text: str | None, path: str | None = None) -> list[int]:
    (ids,) = prefix_ids(path or default_path()).of([(text or "").encode()])
    return ids.tolist()


def decode(ids: list[int], path: str | None = None) -> str:
    """The library's decode(ids, skip_special_tokens=False)."""
    return b"".join(spellings(path or default_path())[1].parts(np.array(ids, np.int64))).decode()


def _texts(b: pa.RecordBatch) -> list[bytes]:
    return [x or b"" for x in b.column("text").cast(pa.binary()).to_pylist()]


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (array<int>) and decoded (string) for every row of docs (doc_id, text).

    Null and empty texts have no ids; a null doc_id is a row like any other;
    whole texts of any length are encoded; repeated rows repeat; extra columns
    are ignored; an empty table gives none.
    """
    path, id_type = path or default_path(), docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            ids = list(prefix_ids(path).of(_texts(b)))
            names = spellings(path)[1]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32())), pa.array([b"".join(names.parts(i)).decode() for i in ids], pa.string())], ["doc_id", "ids", "decoded"]
            )

    return bounded_batches(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, ids array<int>, decoded string")


def encoding_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of docs (doc_id, text).

    Null and empty texts have no ids.  Whole texts of any length are encoded;
    repeated rows repeat; extra columns are ignored; an empty table gives none.
    """
    path, id_type = path or default_path(), docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            decimal, names = spellings(path)
            n, ids, plain = [], [], []
            for own in prefix_ids(path).of(_texts(b)):
                n.append(len(own))
                ids.append(decimal.digest(own))
                plain.append(names.digest(own))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(plain, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return bounded_batches(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_digests(table(spark, sf_dir, "documents"))
