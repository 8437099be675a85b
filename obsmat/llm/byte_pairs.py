"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

A text is cut into words by the tokenizer's pattern. For each prefix of a word exactly one token can be the last of its encoding.
A suffix automaton over the vocabulary, fed byte by byte, names the tokens that end at a position, longest first. A token fits
if it is the whole prefix, or if the last token of the prefix before it and this one are a compatible pair: merging by rank
would never join anything across their border. That is decided by the two tokens alone, from the ranks at which the pieces
along their border were made. The last tokens of all prefixes are a table, from which the encoding is read backwards.
So a word costs time in proportion to its length, however long it is, and ids are those of merging pair by pair.
"""

from __future__ import annotations

import json
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The pattern that cuts texts before merging.
PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: Texts with none of these characters are cut by the pattern as above. Scripts that grow with each version of Unicode are
#: left to the tokenizer's own cutter, as what is a letter there depends on the version.
GROWING = regex.compile(r"[\u0528-\u1FFF\u2070-\u209F\uA000-\uABFF\uD7A4-\uFEFF\U00010000-\U0001F2FF\U0001F650-\U0010FFFF]")
#: Words whose ids, and pairs whose answer, a worker remembers; words longer than this are not remembered; text bytes a slice.
WORDS, PAIRS, LONGEST, SLICE = 250_000, 400_000, 48, 4 << 20


def byte_letters() -> list[str]:
    """The letter that stands for each byte in vocabulary files: printable ones for themselves, others from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(others)) for b in range(256)]


class SuffixAutomaton:
    """All substrings of the words, in one automaton. `ends[state]` is the token that the state's longest string is, or -1;
    `shorter[state]` the nearest state along the suffix links, itself excluded, that is a token, or -1."""

    def __init__(self, words: list[tuple[bytes, int]]):
        self.next: list[dict[int, int]] = [{}]
        self.length, self.link = [0], [-1]
        tails = []
        for word, token in sorted(words):
            last = 0
            for byte in word:
                last = self._extended(last, byte)
            tails.append((last, token))
        self.ends = [-1] * len(self.length)
        for state, token in tails:  # a word is the longest string of its state
            self.ends[state] = token
        self.shorter = [-1] * len(self.length)
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            up = self.link[state]
            self.shorter[state] = up if self.ends[up] >= 0 else self.shorter[up]

    def _new(self, length: int, link: int, ways: dict) -> int:
        self.next.append(ways)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, state: int, target: int, byte: int) -> int:
        """A state for the strings of `target` that are at most one byte longer than those of `state`."""
        part = self._new(self.length[state] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = part
        while state >= 0 and self.next[state].get(byte) == target:
            self.next[state][byte] = part
            state = self.link[state]
        return part

    def _extended(self, last: int, byte: int) -> int:
        known = self.next[last].get(byte)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, known, byte)
        new, state = self._new(self.length[last] + 1, 0, {}), last
        while state >= 0 and byte not in self.next[state]:
            self.next[state][byte] = new
            state = self.link[state]
        if state >= 0:
            target = self.next[state][byte]
            self.link[new] = target if self.length[target] == self.length[state] + 1 else self._split(state, target, byte)
        return new


class Vocabulary:
    """Tokens, ranks and the automaton of a vocabulary file of byte-level merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, added = told["model"], told.get("added_tokens") or []
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        cut = told["pre_tokenizer"]
        if not plain or told.get("normalizer") or cut["type"] != "ByteLevel" or cut["add_prefix_space"] or not cut["use_regex"] or any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path} isn't a plain vocabulary of byte-level merges")
        of = {c: b for b, c in enumerate(byte_letters())}
        spell = lambda name: bytes(of[c] for c in name)
        self.id_of = {spell(n): i for n, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in added}
        self.bytes_of = {i: b for b, i in self.id_of.items()} | {i: n.encode() for n, i in self.special.items()}
        #: For each token the rank of its merge (bytes: -1), and the two tokens that it is made of (itself, for bytes).
        self.rank, self.left, self.right, self.merges = {}, {}, {}, {}
        for r, pair in enumerate(model["merges"]):
            a, b = (self.id_of[spell(x)] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            whole = self.id_of[self.bytes_of[a] + self.bytes_of[b]]
            self.merges.setdefault((a, b), r)
            if whole not in self.rank:
                self.rank[whole], self.left[whole], self.right[whole] = r, a, b
        for b in range(256):
            if (i := self.id_of.get(bytes([b]))) is None:
                raise ValueError(f"byte {b} has no token")
            self.rank[i], self.left[i], self.right[i] = -1, i, i
        #: Tokens whose bytes merge to them: their two parts do, and stay as they are until they are joined.
        whole: dict[int, bool] = {}
        for i in sorted(self.rank, key=self.rank.__getitem__):
            whole[i] = self.rank[i] < 0 or (whole[self.left[i]] and whole[self.right[i]] and self._apart(self.left[i], self.right[i], self.rank[i]))
        self.pairs: dict[int, bool] = {}
        self.automaton = SuffixAutomaton([(b, i) for b, i in self.id_of.items() if whole.get(i)])
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self._own = None
        self.path = path
        self._splitter = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        size = max(self.bytes_of) + 1
        self.lengths = np.array([len(self.bytes_of.get(i, b"")) for i in range(size)], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.letters = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(size)), np.uint8)

    def _apart(self, a: int, b: int, until: int) -> bool:
        """Whether no merge of a rank below `until` joins pieces across the border of a and b. Walks back in time: x and y are
        the pieces at the border, made into larger ones at the ranks x_ends and y_ends."""
        x, y, x_ends, y_ends = a, b, until, until
        rank, merges = self.rank, self.merges
        while True:
            joined = merges.get((x, y))
            # the piece on the left is merged first where ranks are equal
            if joined is not None and joined < x_ends and (joined <= y_ends if y_ends < until else joined < until):
                return False
            if rank[x] < 0 and rank[y] < 0:
                return True
            if rank[x] > rank[y]:
                x_ends, x = rank[x], self.right[x]
            else:
                y_ends, y = rank[y], self.left[y]

    def compatible(self, a: int, b: int) -> bool:
        key = a << 20 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._apart(a, b, 1 << 40)
        return known

    def encode_word(self, word: bytes) -> list[int]:
        automaton, pairs = self.automaton, self.pairs
        ways, link, ends, shorter, length = automaton.next, automaton.link, automaton.ends, automaton.shorter, automaton.length
        last, sizes, state, matched, at = [-1], [0], 0, 0, 0
        for byte in word:
            at += 1
            while (to := ways[state].get(byte)) is None:
                state = link[state]
                matched = length[state]
            state = to
            matched += 1  # bytes before here that some token holds; the state's longest string may be longer
            s = state if ends[state] >= 0 and length[state] == matched else shorter[state]
            while True:
                token, size = ends[s], length[s]
                if size == at:
                    break
                before = last[at - size]
                fits = pairs.get(before << 20 | token)
                if fits or (fits is None and self.compatible(before, token)):
                    break
                s = shorter[s]
            last.append(token)
            sizes.append(size)
        out = []
        while at:
            out.append(last[at])
            at -= sizes[at]
        return out[::-1]

    def _cut(self, text: str) -> list[str]:
        if GROWING.search(text) is None:
            return PATTERN.findall(text)
        if self._own is None:
            from tokenizers import Tokenizer

            self._own = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self._own.pre_tokenize_str(text)]

    def _word_ids(self, word: str) -> bytes:
        """A word's ids. Remembered words are in two halves; the older one goes when the newer is full, but for what was used since."""
        ids = self.older.get(word)
        if ids is None:
            ids = array("i", self.encode_word(word.encode())).tobytes()
        if len(word) <= LONGEST:
            if len(self.words) >= WORDS // 2:
                self.older, self.words = self.words, {}
            self.words[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of a text, 4 bytes each. Added tokens stand for themselves where their string occurs."""
        out, at = [], 0
        make = self._word_ids
        for m in [*(self._splitter.finditer(text) if self._splitter else ()), None]:
            piece = text[at : m.start() if m else len(text)]
            get = self.words.get
            out += [get(w) or make(w) for w in self._cut(piece)]
            if m:
                out.append(self.special[m.group()].to_bytes(4, "little"))
                at = m.end()
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids, one after the other."""
        n = self.lengths[ids]
        ends = np.cumsum(n)
        return self.letters[np.arange(ends[-1] if len(n) else 0) + np.repeat(self.starts[ids] - (ends - n), n)]


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, made once in a worker."""
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def _slices(sizes: list[int], most: int):
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if len(sizes) > start:
        yield start, len(sizes)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int) of each whole text. Null texts are empty and have no ids; repeated rows and null doc_ids stay;
    an empty table gives an empty one; other columns are ignored."""

    def each(batches):
        v = vocabulary(path)
        for b in batches:
            sizes = [len(t.as_buffer()) if t.is_valid else 0 for t in b.column(1)]
            for i, j in _slices(sizes, SLICE):
                raw = [v.encode(t.as_buffer().to_pybytes().decode("utf-8", "replace")) if t.is_valid else b"" for t in b.column(1)[i:j]]
                ends = np.cumsum([0] + [len(r) // 4 for r in raw])
                ids = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(raw))])
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids)], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(each, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, text of (doc_id, ids): the bytes of the tokens, with a replacement character for what isn't UTF-8. Null ids are
    an empty text; ids outside the vocabulary stand for nothing. Special tokens are kept."""

    def each(batches):
        v = vocabulary(path)
        for b in batches:
            lists = b.column(1)
            sizes = [len(x) if x.is_valid else 0 for x in lists]
            for i, j in _slices(sizes, SLICE // 4):
                part = lists[i:j]
                ids = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                known = (ids >= 0) & (ids < len(v.lengths))
                ids = np.where(known, ids, 0)
                n = np.where(known, v.lengths[ids], 0)
                at = np.concatenate([[0], np.cumsum(n)])[np.cumsum([0, *sizes[i:j]])]
                letters = v.decode(ids[known])
                raw = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(letters)])
                try:
                    text = raw.cast(pa.string())
                except pa.ArrowInvalid:
                    text = pa.array([x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], part, text], ["doc_id", "ids", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(each, "doc_id long, ids array<int>, text string")


def digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the text in UTF-8)."""
    ids = F.coalesce("ids", F.expr("array_repeat(0, 0)"))
    return decoded.select("doc_id", F.size(ids).cast("long").alias("n_tokens"), F.sha2(F.array_join(ids.cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
