"""Language-model scoring by online logistic context mixing.

A text is scored as the base score has it: its words with A-Z lower-cased, in order, and an end. Each is sent as binary
decisions. First, where the three words before it were seen in training: is it the word that followed them most often? If
not, its path in a prefix code of the most frequent words (an escape and its bytes for others). Several predictors give each
decision's odds:

- the longest context, three words: exact counts of what followed them, over the whole training corpus;
- hashed contexts of the path: the word before; the word two before; the endings of both;
- hashed contexts of bytes: the last three and the last five in the word;
- the decision's frequency by itself, and its frequency in this document so far.

A gate (depth, how well the contexts are known, how the last matches went) picks the weights that mix the predictors' log
odds; a correction by the mixed odds refines the result. Weights, correction and the document's own frequencies go on
learning inside each document, in rounds of 32 words at first, from a start that all documents share. So a document's
score doesn't depend on the others of its task, and the probabilities of all word sequences sum to one at most (hashes of
the longest context's successors have 28 bits). Decisions deeper than the first DEPTH of a path are mixed too, by gates of their own,
from their frequency, the word before, both endings and this document so far (by a hash of the node).

What grows with the corpus stays on the cluster: the counts of the longest contexts are sharded by the context's hash, shards
follow the number of training words, and documents get back one byte for each place. A shard gets each context and
successor once for each block of documents, however often it stands there. What reaches the workers as a whole is bounded by
parameters and doesn't saturate: contexts are the CONTEXTS most frequent words, others are known by their endings.

The shared weights are fitted by Newton steps whose sums run over every 32nd training document, with counts that leave
those documents out.
"""

from __future__ import annotations

import heapq
import zlib
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsmat.llm.common import table

#: Decisions of a path that contexts predict, those in one group of slots, words that are contexts of their own, slots in a page of a table.
DEPTH, UPPER, CONTEXTS, PAGE = 7, 4, 1 << 14, 8192
NODES = (1 << DEPTH) - 1
#: log2 of the slots: word before, word two before, both endings; three bytes, five bytes.
BITS = (22, 21, 21, 20, 20)
SCALE = 511.0
#: Predictors and the bias; gates of paths (depth, knowledge), of matches (count, purity, last matches), of deeper decisions (depth, knowledge) and of bytes.
INPUTS, PATHS, MATCHES, DEEPER, SPELLED = 6, DEPTH * 4, 15 * 4, 4 * 4, 16
DEEP = PATHS + MATCHES
OWN = DEEP + DEEPER
#: Counters of a document's own deeper decisions.
OWN_DEEP = 1 << 10
GATES = OWN + SPELLED
ENDED = 1 << 30
_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
#: Bits of a successor's hash and of a context's key within its shard.
NEXT = np.uint64(28)


def training(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 != 2


def fold(doc_id) -> int:
    """2: held out; 1: a training document that the weights are fitted on; 0: any other."""
    if not training(doc_id):
        return 2
    return int(zlib.crc32(b"w" if doc_id is None else b"w%d" % doc_id) % 32 == 0)


def tokens(text: str | None) -> list[bytes]:
    """The words of a text with A-Z lower-cased."""
    return (text or "").encode().lower().split()


def huffman(weights) -> list[tuple[int, int]]:
    """(length, bits) of each symbol's code word."""
    n = len(weights)
    heap = [(float(w), s) for s, w in enumerate(weights)]
    heapq.heapify(heap)
    kids = []
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (a[0] + b[0], n + len(kids)))
        kids.append((a[1], b[1]))
    out: list = [(0, 0)] * n
    stack = [(heap[0][1], 0, 0)]
    while stack:
        node, length, bits = stack.pop()
        if node < n:
            out[node] = (length, bits)
        else:
            stack += [(kid, length + 1, bits * 2 + side) for side, kid in enumerate(kids[node - n])]
    return out


def logit(n1, n0):
    return np.clip(np.log((n1 + 0.4) / (n0 + 0.4)), -8, 8)


@dataclass
class Code:
    """Words 0 to n - 1, the escape n, the end n + 1: the first DEPTH bits of the code word, left-aligned, how many of them
    there are, log2 of what the deeper ones cost by their frequencies, and the log odds of the nodes above. Then the code of bytes, and the
    deeper decisions: where a symbol's begin and how many there are, and of each its node's hash with the bit as the last one and its log odds."""

    n: int
    head: np.ndarray
    length: np.ndarray
    tail: np.ndarray
    odds: np.ndarray
    byte_at: np.ndarray
    byte_length: np.ndarray
    byte_nodes: np.ndarray
    byte_bits: np.ndarray
    deep_at: np.ndarray
    deep_length: np.ndarray
    deep_marks: np.ndarray
    deep_odds: np.ndarray

    @classmethod
    def from_counts(cls, counts: np.ndarray, rest: int, ends: int, spelled: list[tuple[bytes, int]]) -> Code:
        """counts of the coded words, of all others, of ends; spelled: other words with counts, for the bytes' code."""
        mass = np.append(np.asarray(counts, np.float64), [rest + 1.0, ends + 1.0])
        paths = huffman(mass)
        depth = np.array([d for d, _ in paths])
        head = np.array([b >> (d - DEPTH) if d > DEPTH else b << (DEPTH - d) for d, b in paths], np.uint8)
        length = np.minimum(depth, DEPTH)
        inner = np.zeros((NODES, 2))
        for d in range(DEPTH):
            on = length > d
            np.add.at(inner, ((1 << d) - 1 + (head[on] >> (DEPTH - d)), head[on] >> (DEPTH - 1 - d) & 1), mass[on])
        below = np.bincount(head[depth >= DEPTH], mass[depth >= DEPTH], 1 << DEPTH)
        tail = np.where(depth > DEPTH, np.log2(mass / np.maximum(below[head], 1)), 0.0)
        pairs = np.zeros(256)
        for w, c in spelled:
            pairs += c * np.bincount(np.frombuffer(w + b" ", np.uint8), minlength=256)
        of_bytes = huffman(pairs + 1e-4 * max(1.0, pairs.sum()))  # so no code word has more than 20 bits
        steps = np.array([d for d, _ in of_bytes], np.int64)
        nodes, bits = ([f(d, b, k) for d, b in of_bytes for k in range(d)] for f in (lambda d, b, k: (1 << k) - 1 + (b >> (d - k)), lambda d, b, k: b >> (d - 1 - k) & 1))
        return cls(len(counts), head, length.astype(np.uint8), tail, logit(inner[:, 1], inner[:, 0]).astype(np.float32), np.cumsum(steps) - steps, steps, np.array(nodes, np.uint32), np.array(bits, np.int32), *deeper(paths, mass))


def deeper(paths: list[tuple[int, int]], mass: np.ndarray):
    """(where each symbol's decisions beyond the first DEPTH begin, how many they are, their marks, their log odds times SCALE)."""
    depth, whole = np.array(paths, np.int64).T  # fewer than 63 bits: more would take 10^13 words
    many = np.maximum(depth - DEPTH, 0)
    at = np.cumsum(many) - many
    marks, odds = np.zeros(int(many.sum()), np.uint32), np.zeros(int(many.sum()), np.int16)
    for d in range(DEPTH, int(depth.max())):
        on = np.flatnonzero(depth > d)
        bit = whole[on] >> (depth[on] - d - 1) & 1
        _, node = np.unique(whole[on] >> (depth[on] - d), return_inverse=True)  # numbered by depth, in the order of their bits
        sides = np.bincount(2 * node + bit, mass[on], 2 * (node.max() + 1)).reshape(-1, 2)
        hashed = ((node.astype(np.uint64) << np.uint64(8)) + np.uint64(d)) * _M3 * _M1 >> np.uint64(32)
        marks[at[on] + d - DEPTH] = (hashed.astype(np.uint32) & np.uint32(0xFFFFFFFE)) | bit.astype(np.uint32)
        odds[at[on] + d - DEPTH] = np.rint(logit(sides[:, 1], sides[:, 0]) * SCALE).astype(np.int16)[node]
    return at, many, marks, odds


@dataclass
class Vocabulary:
    """What is known of the dictionary's words, by number; numbers from `code.n` on are spelled, `size` stands for all others."""

    words: pa.Array
    code: Code
    hashes: np.ndarray
    endings: np.ndarray
    base: np.ndarray

    @property
    def size(self) -> int:
        return len(self.words)


def ending(word: bytes) -> int:
    return int.from_bytes(word[-2:], "big")


class Text:
    """Some documents of one block: the arrays that the predictors need, an element a token (words, then an end each)."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, spelled: bytes, v: Vocabulary):
        self.sizes, self.ids = sizes, ids
        self.starts = np.cumsum(sizes) - sizes
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        at = np.arange(len(ids)) - self.starts[self.doc]
        self.end = ids == ENDED
        known = np.where(self.end, v.size, ids)
        hashes, endings = v.hashes[known], v.endings[known]
        self.spelled_at = np.flatnonzero((ids >= v.code.n) & ~self.end)
        self.words = spelled.split()
        endings[self.spelled_at] = np.array([ending(w) for w in self.words], np.int64)
        hashes[self.spelled_at] = np.array([zlib.crc32(w) for w in self.words], np.uint64)
        self.symbol = np.where(self.end, v.code.n + 1, np.minimum(ids, v.code.n))
        self.endings, self.hashes, self.coded = endings, hashes, min(v.code.n, CONTEXTS)
        self.whole = at >= 3  # three words before

    def before(self, x: np.ndarray, k: int, start: int) -> np.ndarray:
        out = np.empty_like(x)
        out[k:] = x[:-k]
        for i in range(k):
            at = self.starts + i
            out[at[i < self.sizes]] = start
        return out

    @cached_property
    def contexts(self) -> list[np.ndarray]:
        """32-bit hashes of the contexts of paths."""
        own, start = np.where(self.symbol < self.coded, self.symbol, CONTEXTS + self.endings), CONTEXTS + 65536
        one, two = self.before(own, 1, start), self.before(own, 2, start)
        both = self.before(self.endings, 1, 65536) * 65537 + self.before(self.endings, 2, 65536)
        return [((x.astype(np.uint64) + np.uint64(k + 1)) * _M1 >> np.uint64(32)).astype(np.uint32) for k, x in enumerate((one, two, both))]

    def places(self, shards: int):
        """(shard and value of each different context with its successor, in order; which of them each token with three words before has)."""
        hashes = self.hashes * _M3
        longest = self.before(hashes, 1, 0) * _M1
        for k in (2, 3):
            longest = (longest ^ longest >> np.uint64(29)) * _M2 + self.before(hashes, k, 0)
        h = longest[self.whole]
        h = (h ^ h >> np.uint64(31)) * _M1
        h ^= h >> np.uint64(30)
        following = (np.where(self.end, np.uint64(1), hashes)[self.whole] * _M2) >> (np.uint64(64) - NEXT)
        shard = (h >> np.uint64(64 - shards)).astype(np.uint16 if shards <= 16 else np.uint32) if shards else np.zeros(len(h), np.uint16)
        value = ((h << np.uint64(shards)) >> NEXT) << NEXT | following
        order = np.argsort(value)
        order = order[np.argsort(shard[order], kind="stable")]
        s, x = shard[order], value[order]
        new = np.ones(len(order), bool)
        new[1:] = (s[1:] != s[:-1]) | (x[1:] != x[:-1])
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        return s[new], x[new], which


def answers(values: np.ndarray, *counts: np.ndarray) -> list[np.ndarray]:
    """For each value (key and successor), by each of the numbers in training given: 0 where its key wasn't seen, else 1 + twice a
    class of how often the key's first successor was seen, in total and against others, + 1 if that is this successor."""
    if not len(values):
        return [np.zeros(0, np.uint8) for _ in counts]
    order = np.argsort(values)
    v = values[order]
    starts = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
    keys = v[starts] >> NEXT
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    alone = np.diff(np.append(first, len(keys)))
    of, again, out = np.repeat(np.arange(len(first)), alone), np.diff(np.append(starts, len(v))), []
    for c in counts:
        n = np.add.reduceat(c[order], starts)
        most, total = np.maximum.reduceat(n, first), np.add.reduceat(n, first)
        at = np.flatnonzero(n == most[of])
        top = at[np.flatnonzero(np.append(True, of[at[1:]] != of[at[:-1]]))]
        kind = (most >= 2) * np.uint8(3) + (most >= 3) * np.uint8(3) + (most >= 6) * np.uint8(3) + (most >= 20) * np.uint8(3) + np.where(most == total, np.uint8(2), (2 * most >= total).astype(np.uint8))
        found = np.where(total > 0, 1 + 2 * kind, 0).astype(np.uint8)[of]
        found[top] += total > 0
        one = np.empty(len(values), np.uint8)
        one[order] = np.repeat(found, again)
        out.append(one)
    return out


def path_slots(text: Text, t: np.ndarray, code: Code):
    """(nodes, bits, valid or not, slots in the three hashed tables) of the paths of tokens t; arrays of DEPTH rows.

    The first UPPER nodes of a context are neighbours in a table, and the nodes below one of their ends.
    """
    head, depth = code.head[text.symbol[t]].astype(np.int32), np.arange(DEPTH, dtype=np.int32)[:, None]
    node = (head[None, :] >> (DEPTH - depth)) + ((1 << depth) - 1)
    bit = head[None, :] >> (DEPTH - 1 - depth) & 1
    below = (head >> (DEPTH - UPPER)).astype(np.uint32)  # the node where the lower part of the path begins
    k = depth[: DEPTH - UPPER]
    lower = (1 << k) - 1 + (head[None, :] >> (DEPTH - UPPER - k) & (1 << k) - 1)
    slots = []
    for c, b in zip(text.contexts, BITS, strict=False):
        h = np.empty((2, len(t)), np.uint32)
        h[0] = c[t]
        h[1] = h[0] ^ (below + np.uint32(1)) * np.uint32(2654435761)
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0xC2B2AE35)
        h >>= np.uint32(32 - b)
        s = np.empty(node.shape, np.int64)
        s[:UPPER] = (h[0] & np.uint32(0xFFFFFFF0)) + node[:UPPER]
        s[UPPER:] = (h[1] & np.uint32(0xFFFFFFF8)) + lower
        slots.append(s)
    return node, bit, code.length[text.symbol[t]][None, :] > depth, slots


def deep_slots(text: Text, t: np.ndarray, code: Code):
    """(which of tokens t each decision beyond the first DEPTH belongs to, its depth, its bit, log odds, its node's number among
    OWN_DEEP, slots in the tables of the word before and of both endings), flat."""
    symbol = text.symbol[t]
    many = code.deep_length[symbol]
    of = np.repeat(np.arange(len(t)), many)
    level = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
    flat = code.deep_at[symbol][of] + level
    mark, slots = code.deep_marks[flat], []
    bit = (mark & np.uint32(1)).astype(np.int32)
    mark = mark & np.uint32(0xFFFFFFFE)
    for k in (0, 2):
        h = text.contexts[k][t][of] ^ mark
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0xC2B2AE35)
        h >>= np.uint32(32 - BITS[k])
        slots.append(h)
    return of, level, bit, code.deep_odds[flat].astype(np.float32) * np.float32(1 / SCALE), (mark >> np.uint32(22)).astype(np.int64), slots


def byte_slots(words: list[bytes], code: Code):
    """(word of each decision, its bit, slots in the two tables of bytes) of spelled words."""
    raw = np.frombuffer(b" ".join([b"", *words, b""])[1:], np.uint8).astype(np.int64)
    size = np.array([len(w) + 1 for w in words], np.int64)
    at = np.arange(len(raw)) - np.repeat(np.cumsum(size) - size, size)
    context = []
    for span in (3, 5):
        c = np.zeros(len(raw), np.uint64)
        for k in range(span, 0, -1):
            c[k:] = (c[k:] + np.where(at[k:] >= k, raw[:-k] + 1, 0).astype(np.uint64)) * _M1
            c ^= c >> np.uint64(29)
        context.append(((c + np.uint64(span)) * _M2 >> np.uint64(32)).astype(np.uint32))
    length = code.byte_length[raw]
    flat = np.repeat(code.byte_at[raw] - (np.cumsum(length) - length), length)
    flat += np.arange(len(flat))
    mark, slots = code.byte_nodes.take(flat) * np.uint32(2654435761), []
    for c, b in zip(context, BITS[3:], strict=True):
        h = np.repeat(c, length)
        h ^= mark
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0xC2B2AE35)
        h >>= np.uint32(32 - b)
        slots.append(h)
    of = np.add.reduceat(length, np.cumsum(size) - size) if len(words) else size
    return np.repeat(np.arange(len(words)), of), code.byte_bits.take(flat), slots


def packed(counts: np.ndarray) -> np.ndarray:
    """From counts (slots, 2) to log odds and a degree of knowledge from 0 to 7, in 16 bits."""
    n0, n1 = counts[:, 0].astype(np.float64), counts[:, 1].astype(np.float64)
    known = np.searchsorted([1, 2, 4, 8, 32, 256, 4096], n0 + n1, side="right")
    return (np.rint(logit(n1, n0) * SCALE).astype(np.int16) << 3) | known.astype(np.int16)


def first_weights() -> np.ndarray:
    """Weights (inputs, gates) before anything is learned."""
    w = np.zeros((INPUTS, GATES), np.float32)
    w[:5, :PATHS] = np.array([0.5, 0.4, 0.2, 0.2, 0.1])[:, None]
    w[0, PATHS:DEEP], w[4, PATHS:DEEP] = 0.7, 0.3
    w[:5, DEEP:OWN] = np.array([0.7, 0.3, 0.2, 0.0, 0.3])[:, None]
    w[:2, OWN:] = 0.5
    return w


_CLASS = np.array([0, 0, 1, 1, 2, 2, 3, 3], np.int32)
#: Log odds of the match classes: counts of 1, 2, 4, 10, 30, pure, mostly or partly.
_MATCH_ODDS = np.array([logit(n, m) for n in (1, 2, 4, 10, 30) for m in (2 * n, n / 2, 0)], np.float32)


def rounds(longest: int):
    """The first and last token of each round: of 32 words at first, of 4096 at most."""
    a, step = 0, 32
    while a < longest:
        yield a, a + step
        a += step
        step = min(4096, a) if a >= 64 else 32


@dataclass
class Model:
    code: Code
    tables: list[np.ndarray]
    weights: np.ndarray
    rate: float = 0.03
    fix_rate: float = 0.03

    def looked_up(self, k: int, slots: np.ndarray):
        raw = self.tables[k].take(slots)
        return (raw >> 3).astype(np.float32) * np.float32(1 / SCALE), raw & 7

    def spelled(self, words: list[bytes], sums=None) -> np.ndarray:
        """log2 probability of each spelled word after the escape, with the shared weights."""
        out = np.zeros(len(words))
        a = 0
        while a < len(words):
            b, n = a, 0
            while b < len(words) and (b == a or n < 20_000):
                n += len(words[b]) + 1
                b += 1
            of, bit, slots = byte_slots(words[a:b], self.code)
            (x0, k0), (x1, k1) = (self.looked_up(k + 3, s) for k, s in enumerate(slots))
            gate = OWN + _CLASS[k0] * 4 + _CLASS[k1]
            z = self.weights[0].take(gate) * x0 + self.weights[1].take(gate) * x1 + self.weights[5].take(gate)
            cost = np.log(1 + np.exp(np.minimum((1 - 2 * bit).astype(np.float32) * z, 80)))
            out[a:b] = np.bincount(of, -cost / np.log(2), b - a)
            if sums is not None:
                none = np.zeros_like(x0)
                sums.add(gate, [x0, x1, none, none, none], z, bit)
            a = b
        return out

    def documents(self, text: Text, match: np.ndarray, sums=None) -> np.ndarray:
        """log2 probability of each document. match: the answer for each token. With `sums` nothing is learned inside documents."""
        order = np.argsort(-text.sizes, kind="stable")
        n = len(order)
        out = np.zeros(n)
        spelled_at = np.flatnonzero((match[text.spelled_at] == 0) | (match[text.spelled_at] & 1 == 1))  # not told by a match
        of_spelled = self.spelled([text.words[i] for i in spelled_at.tolist()], sums)
        w = np.repeat(self.weights[:, None, :OWN], n, axis=1).reshape(INPUTS, n * OWN)
        fix = np.zeros(n * 99, np.float32)
        seen = np.zeros((2, n * NODES))
        own = np.zeros(n * NODES, np.float32)
        seen_deep, own_deep = np.zeros((2, n * OWN_DEEP), np.float32), np.zeros(n * OWN_DEEP, np.float32)
        hits = np.zeros((2, n))
        sizes, starts = text.sizes[order], text.starts[order]
        run_of = self.runs(text, match)
        for a, b in rounds(int(sizes[0]) if n else 0):
            live = int(np.searchsorted(-sizes, -a, side="left"))  # documents longer than a
            many = np.minimum(sizes[:live], b) - a
            doc = np.repeat(np.arange(live), many)
            t = np.arange(len(doc)) + np.repeat(starts[:live] + a - (np.cumsum(many) - many), many)
            kind = match[t]
            on = np.flatnonzero(kind)
            hit = (kind & 1 == 0) & (kind > 0)
            jobs = []
            if len(on):
                c = (kind[on].astype(np.int32) - 1) >> 1
                gate = PATHS + c * 4 + run_of[t[on]]
                mine = logit(hits[1], hits[0]).astype(np.float32)[doc[on]]
                none = np.zeros(len(on), np.float32)
                jobs.append((doc[on], gate, [_MATCH_ODDS[c], none, none, none, mine], hit[on].astype(np.int32), None, 33))
            rest = np.flatnonzero(~hit)
            node, bit, valid, slots = path_slots(text, t[rest], self.code)
            at = doc[rest][None, :]
            (x1, k1), (x2, _), (x3, _) = (self.looked_up(k, s) for k, s in enumerate(slots))
            gate = np.arange(DEPTH, dtype=np.int32)[:, None] * 4 + _CLASS[k1]
            jobs.append((at, gate, [self.code.odds.take(node), x1, x2, x3, own.take(at * NODES + node)], bit, valid, 0))
            of, level, deep_bit, odds, mark, slots = deep_slots(text, t[rest], self.code)
            deep_at = doc[rest][of]
            deep_key = deep_at * OWN_DEEP + mark
            if len(of):
                (x1, k1), (x2, _) = (self.looked_up(k, s) for k, s in zip((0, 2), slots, strict=True))
                gate = DEEP + np.minimum(level >> 1, 3).astype(np.int32) * 4 + _CLASS[k1]
                jobs.append((deep_at, gate, [odds, x1, x2, np.zeros(len(of), np.float32), own_deep.take(deep_key)], deep_bit, None, 66))
            for d, gate, x, bit_, ok, shift in jobs:
                place = d * OWN + gate
                z = w[5].take(place)
                for k in range(5):
                    z += w[k].take(place) * x[k]
                box = d * 99 + shift + (np.clip(z, -8, 8) * np.float32(2) + np.float32(16.5)).astype(np.int32)
                refined = z + fix.take(box)
                sign = (1 - 2 * bit_).astype(np.float32)
                e = np.exp(np.minimum(sign * refined, 80))
                cost = np.log(1 + e)
                if ok is not None:
                    cost *= ok
                out[:live] -= np.bincount(d.ravel() if ok is None else d[0], cost if ok is None else cost.sum(0), live)
                if sums is not None:
                    sums.add(gate, x, z, bit_, ok)
                    continue
                p, box_ = place.ravel(), box.ravel()
                miss = e / (1 + e) * -sign
                if ok is not None:
                    miss = miss * ok
                miss = miss.ravel()
                step = (self.rate / np.sqrt(np.bincount(p, minlength=live * OWN) + 4)).astype(np.float32)
                for k in range(INPUTS):
                    w[k, : live * OWN] += step * np.bincount(p, miss if k == 5 else miss * x[k].ravel(), live * OWN).astype(np.float32)
                fix[: live * 99] += (self.fix_rate * np.bincount(box_, miss, live * 99) / np.sqrt(np.bincount(box_, minlength=live * 99) + 4)).astype(np.float32)
            key = (at * NODES + node)[valid]
            total, ones = np.bincount(key, minlength=live * NODES), np.bincount(key, bit[valid], live * NODES)
            seen[1, : live * NODES] += ones
            seen[0, : live * NODES] += total - ones
            own[: live * NODES] = logit(seen[1, : live * NODES], seen[0, : live * NODES])
            np.add.at(seen_deep.ravel(), deep_bit * np.int64(n * OWN_DEEP) + deep_key, np.float32(1))
            own_deep[deep_key] = logit(seen_deep[1].take(deep_key), seen_deep[0].take(deep_key))
            hits[1, :live] += np.bincount(doc[on], hit[on], live)
            hits[0, :live] += np.bincount(doc[on], ~hit[on], live)
        log2 = np.empty(n)
        log2[order] = out / np.log(2)
        return log2 + np.bincount(text.doc[text.spelled_at[spelled_at]], of_spelled, n)

    @staticmethod
    def runs(text: Text, match: np.ndarray) -> np.ndarray:
        """How many matches in a row ended before each token: 0 none, 1 one, 2 up to three, 3 more."""
        good = (match > 0) & (match & 1 == 0)
        at = np.arange(len(match))
        last_bad = np.maximum.accumulate(np.where(good, -1, at))
        begin = text.starts[text.doc]
        before = np.where(at > begin, at - 1 - np.maximum(np.append(-1, last_bad[:-1]), begin - 1), 0)
        return np.searchsorted([1, 2, 4], before, side="right").astype(np.int32)


class Sums:
    """Gradient and curvature of the log likelihood, by gate."""

    def __init__(self):
        self.gradient, self.curvature = np.zeros((INPUTS, GATES)), np.zeros((INPUTS, INPUTS, GATES))

    def add(self, gate, x, z, bit, ok=None):
        on = slice(None) if ok is None else ok
        gate, bit, p = gate[on].ravel(), bit[on].ravel(), 1 / (1 + np.exp(-z[on].ravel().astype(np.float64)))
        x = [*(i[on].ravel() for i in x), np.ones(len(gate), np.float32)]
        for i in range(INPUTS):
            self.gradient[i] += np.bincount(gate, (bit - p) * x[i], GATES)
            for j in range(i + 1):
                self.curvature[i, j] += np.bincount(gate, p * (1 - p) * x[i] * x[j], GATES)

    def step(self, w: np.ndarray, ridge: float = 4.0) -> np.ndarray:
        """Newton's step from w, held to the first weights by a ridge."""
        full = self.curvature + np.triu(self.curvature.transpose(1, 0, 2).transpose(2, 0, 1), 1).transpose(1, 2, 0)
        pull = self.gradient - ridge * (w - first_weights())
        move = np.linalg.solve(full.transpose(2, 0, 1) + ridge * np.eye(INPUTS), pull.T[:, :, None])[:, :, 0].T
        return (w + np.clip(move, -1, 1)).astype(np.float32)


BLOCK_SCHEMA = "block long, fold int, doc_ids array<long>, sizes array<int>, n_bytes array<long>, ids binary, spelled binary"
BLOCK_TOKENS, BLOCK_DOCS = 1 << 17, 256


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(the words of all texts with A-Z lower-cased, where each text's words begin and the last one's end)."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    values, at = lists.values, lists.offsets.to_numpy()
    real = pc.not_equal(values, "").to_numpy(zero_copy_only=False)  # beside white space at a text's ends
    return values.filter(pa.array(real)), np.append(0, np.cumsum(real))[at]


def pieces(batches, most: int):
    """The batches in slices of about `most` bytes of text, so that a worker's memory is bounded."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        a = 0
        while a < b.num_rows:
            z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, side="right")))
            yield b.slice(a, z - a)
            a = z
        pa.default_memory_pool().release_unused()


def _word_counts(docs: DataFrame) -> DataFrame:
    """word, c over the training documents."""

    def each(batches):
        for b in pieces(batches, 1 << 23):
            words, at = split_words(b.column(1))
            mine = np.array([training(i) for i in b.column(0).to_pylist()], bool)
            found = words.filter(pa.array(np.repeat(mine, np.diff(at)))).value_counts()
            yield pa.RecordBatch.from_arrays([found.field(0).cast(pa.binary()), found.field(1)], ["word", "n"])

    return table(_source(docs).mapInArrow(each, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c")), "lm-words")


def _blocks(docs: DataFrame, shared) -> DataFrame:
    """Blocks of documents of one fold, as numbers of words, each with an end; words without a code are kept beside."""
    names = [x.split()[0] for x in BLOCK_SCHEMA.split(", ")]

    def each(batches):
        v = shared.value
        made = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        for b in pieces(batches, 1 << 22):
            words, at = split_words(b.column(1))
            ids = pc.fill_null(pc.index_in(words, value_set=v.words), v.size).to_numpy(zero_copy_only=False)
            other = ids >= v.code.n
            spelled, spelled_at = words.filter(pa.array(other)).cast(pa.binary()).to_pylist(), np.append(0, np.cumsum(other))[at]
            sizes, n = np.diff(at) + 1, len(at) - 1
            stream = np.full(len(ids) + n, ENDED, np.int32)
            stream[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(at))] = ids
            begin = at[:-1] + np.arange(n)
            doc_ids = b.column(0).to_pylist()
            folds = np.array([fold(i) for i in doc_ids], np.int32)
            n_bytes = pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False)
            for k in np.unique(folds).tolist():
                held: list[int] = []
                of_fold = np.flatnonzero(folds == k).tolist()
                for i in of_fold:
                    held.append(i)
                    if len(held) == BLOCK_DOCS or sizes[held].sum() >= BLOCK_TOKENS or i == of_fold[-1]:
                        made += 1
                        whole = np.concatenate([stream[begin[j] : begin[j] + sizes[j]] for j in held])
                        beside = b" ".join([w for j in held for w in spelled[spelled_at[j] : spelled_at[j + 1]]])
                        yield pa.RecordBatch.from_arrays([pa.array([made], pa.int64()), pa.array([k], pa.int32()), pa.array([[doc_ids[j] for j in held]], pa.list_(pa.int64())), pa.array([sizes[held]], pa.list_(pa.int32())), pa.array([n_bytes[held]], pa.list_(pa.int64())), pa.array([whole.tobytes()], pa.binary()), pa.array([beside], pa.binary())], names)
                        held = []

    return table(_source(docs).mapInArrow(each, BLOCK_SCHEMA), "lm-blocks")


def _text(row: dict, v: Vocabulary) -> Text:
    return Text(np.frombuffer(row["ids"], np.int32).astype(np.int64), np.array(row["sizes"], np.int64), row["spelled"], v)


def _pylist(b: pa.RecordBatch):
    for i in range(b.num_rows):
        yield b.slice(i, 1).to_pylist()[0]
    pa.default_memory_pool().release_unused()


def _tables(blocks: DataFrame, shared) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(tables over all training documents, tables without those of fold 1)."""
    names = ["page", "fold", "data"]

    def count(batches):
        v = shared.value
        found = {}
        for b in batches:
            for row in _pylist(b):
                text = _text(row, v)
                into = found.setdefault(row["fold"], [np.zeros(2 << k, np.uint32) for k in BITS])
                for a in range(0, len(text.ids), 1 << 14):
                    _, bit, valid, slots = path_slots(text, np.arange(a, min(a + (1 << 14), len(text.ids))), v.code)
                    for k, s in enumerate(slots):
                        at = (s << 1) + bit
                        np.add.at(into[k], at.ravel(), np.uint32(1))
                        np.subtract.at(into[k], at[~valid], np.uint32(1))
                    _, _, bit, _, _, slots = deep_slots(text, np.arange(a, min(a + (1 << 14), len(text.ids))), v.code)
                    for k, s in zip((0, 2), slots, strict=True):
                        np.add.at(into[k], (s.astype(np.int64) << 1) + bit, np.uint32(1))
                for a in range(0, len(text.words), 1 << 13):
                    _, bit, slots = byte_slots(text.words[a : a + (1 << 13)], v.code)
                    for k, s in enumerate(slots):
                        np.add.at(into[k + 3], (s.astype(np.int64) << 1) + bit, np.uint32(1))
        pack = zstandard.ZstdCompressor(level=1)
        for k, tables in found.items():
            first = 0
            for x in tables:
                view = x.reshape(-1, 2 * PAGE)
                pages = np.flatnonzero(view.any(axis=1))
                for some in np.array_split(pages, max(1, -(-len(pages) // 64))):
                    yield pa.RecordBatch.from_arrays([pa.array(first + some, pa.int32()), pa.array(np.full(len(some), k), pa.int32()), pa.array([pack.compress(view[i].tobytes()) for i in some], pa.binary())], names)
                first += len(view)

    def add(batches):
        unpack = zstandard.ZstdDecompressor()
        held: dict = {}
        for b in batches:
            for page, k, data in zip(*(b.column(c).to_pylist() for c in names), strict=True):
                c = np.frombuffer(unpack.decompress(data), np.uint32)
                both = held.setdefault(page, np.zeros((2, 2 * PAGE), np.uint64))
                both[0] += c
                if k == 0:
                    both[1] += c
        for page, both in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([page], pa.int32()), *(pa.array([packed(x.reshape(-1, 2)).tobytes()], pa.binary()) for x in both)], ["page", "whole", "without"])

    # each fold by itself, so that a worker holds one set of tables
    each = [blocks.where(f"fold = {k}").mapInArrow(count, "page int, fold int, data binary") for k in (0, 1)]
    parts = each[0].union(each[1])
    done = table(parts.repartition("page").mapInArrow(add, "page int, whole binary, without binary"), "lm-tables").toArrow()
    out = tuple([np.full(1 << b, packed(np.zeros((1, 2)))[0], np.int16) for b in BITS] for _ in range(2))
    starts = np.cumsum([0, *((1 << b) // PAGE for b in BITS)])
    for page, *both in zip(*(done.column(c).to_pylist() for c in ("page", "whole", "without")), strict=True):
        k = int(np.searchsorted(starts, page, side="right")) - 1
        at = (page - int(starts[k])) * PAGE
        for o, data in zip(out, both, strict=True):
            o[k][at : at + PAGE] = np.frombuffer(data, np.int16)
    return out


def _matches(blocks: DataFrame, shared, shards: int):
    """From a condition and "whole" or "without" (fold 1) to those blocks with found: for each shard, in order, the answers to
    its places. shards: log2 of their number."""

    def ask(batches):
        v = shared.value
        for b in batches:
            for row in _pylist(b):
                s, x, which = _text(row, v).places(shards)
                n = np.bincount(which, minlength=len(x)).astype(np.uint32)
                cuts = np.flatnonzero(np.diff(s)) + 1
                named = s[np.append(0, cuts)] if len(s) else s
                yield pa.RecordBatch.from_arrays([pa.array(named.astype(np.int32)), pa.array(np.full(len(named), row["block"], np.int64)), pa.array(np.full(len(named), row["fold"], np.int32)), *(pa.array([p.tobytes() for p in np.split(y, cuts)] if len(s) else [], pa.binary()) for y in (x, n))], ["shard", "block", "fold", "places", "counts"])

    def answer(t: pa.Table) -> pa.Table:
        x, n = (np.concatenate([np.frombuffer(p, kind) for p in t.column(c).to_pylist()]) for c, kind in (("places", np.uint64), ("counts", np.uint32)))
        size = np.array([len(p) // 8 for p in t.column("places").to_pylist()])
        folds = t.column("fold").to_numpy()
        of = np.repeat(folds, size)
        cuts = np.cumsum(size)[:-1]
        both = [np.split(found, cuts) for found in answers(x, np.where(of <= 1, n, 0).astype(np.int64), np.where(of == 0, n, 0).astype(np.int64))]
        return pa.table({"block": t.column("block"), "fold": t.column("fold"), "shard": t.column("shard"), "whole": pa.array([p.tobytes() for p in both[0]], pa.binary()), "without": pa.array([p.tobytes() if k == 1 else b"" for p, k in zip(both[1], folds, strict=True)], pa.binary())})

    asked = blocks.mapInArrow(ask, "shard int, block long, fold int, places binary, counts binary")
    told = table(asked.groupBy("shard").applyInArrow(answer, "block long, fold int, shard int, whole binary, without binary"), "lm-answers")
    return lambda part, name: blocks.where(part).join(told.where(part).groupBy("block").agg(F.sort_array(F.collect_list(F.struct("shard", F.col(name).alias("told")))).alias("found")), "block", "left")


def _answers(row: dict, text: Text, shards: int) -> np.ndarray:
    out = np.zeros(len(text.ids), np.uint8)
    if row["found"]:
        _, _, which = text.places(shards)
        out[text.whole] = np.frombuffer(b"".join(f["told"] for f in row["found"]), np.uint8)[which]
    return out


def _fitted(held: DataFrame, shared, without: list[np.ndarray], shards: int, steps: int) -> np.ndarray:
    """The shared weights, by Newton steps over the documents of fold 1; each step's sums are added up on Spark."""
    spark, w = held.sparkSession, first_weights()
    tables = spark.sparkContext.broadcast(without)
    for _ in range(steps):
        now = w

        def each(batches):
            v, sums = shared.value, Sums()
            model = Model(v.code, tables.value, now)
            for b in batches:
                for row in _pylist(b):
                    text = _text(row, v)
                    model.documents(text, _answers(row, text, shards), sums)
            flat = np.concatenate([sums.gradient.ravel(), sums.curvature.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["at", "value"])

        rows = held.mapInArrow(each, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
        flat = np.zeros(INPUTS * GATES * (1 + INPUTS))
        flat[rows.column("at").to_numpy()] = rows.column("value").to_numpy()
        sums = Sums()
        sums.gradient, sums.curvature = flat[: INPUTS * GATES].reshape(INPUTS, GATES), flat[INPUTS * GATES :].reshape(INPUTS, INPUTS, GATES)
        w = sums.step(w)
    tables.destroy()
    return w


@dataclass
class Base:
    end: float
    total: int
    below: float
    seen_end: int


def train(docs: DataFrame, *, dictionary: int = 1 << 18, shard_tokens: int = 1 << 19, steps: int = 2):
    """(broadcast vocabulary, model, base score's numbers, table of all word counts, blocks with answers, log2 of the shards).

    dictionary bounds what the driver and the workers hold of the words; shard_tokens is about the size of a shard of the
    longest contexts.
    """
    as_text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    mine = F.crc32(as_text.cast("binary")) % 7 != 2
    counts = _word_counts(docs)
    ends = docs.where(mine).count()
    of_words = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    top = counts.orderBy(F.desc("c"), "word").limit(dictionary).toArrow()
    words, c = top.column("word").to_pylist(), top.column("c").to_numpy()
    n = int((c > 1).sum())  # words seen once stand for the unseen: they are spelled
    code = Code.from_counts(c[:n], int(of_words.n - c[:n].sum()), ends, list(zip(words[n:], c[n:].tolist(), strict=True)) or list(zip(words[-1000:], [1] * 1000, strict=False)))
    total = of_words.n + ends
    base = Base(0.0, total, float(total + of_words.v + (ends > 0) + 1), int(ends > 0))
    base.end = float(np.log10((ends + 1) / base.below))
    v = Vocabulary(pa.array(words, pa.binary()).cast(pa.string(), safe=False), code, np.array([*map(zlib.crc32, words), 0], np.uint64), np.array([*map(ending, words), 0], np.int64), np.append(np.log10((c + 1) / base.below), 0.0))
    shared = docs.sparkSession.sparkContext.broadcast(v)
    blocks = _blocks(docs, shared)
    shards = min(24, max(0, int(np.ceil(np.log2(max(1, of_words.n) / shard_tokens)))))
    matched = _matches(blocks, shared, shards)
    whole, without = _tables(blocks, shared)
    weights = _fitted(table(matched("fold = 1", "without"), "lm-held"), shared, without, shards, steps)
    return shared, Model(code, whole, weights), base, counts, matched("fold >= 0", "whole"), shards


def scores(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10), bits_per_byte (of the text's bytes; null
    for empty texts): a row for each row of docs.

    Null texts are empty: one token, the end. Null doc_ids are hashed as an empty text. Repeated rows are scored each; equal
    texts have equal scores; an empty table gives an empty one; without training documents all probabilities are those of
    empty tables.
    """
    shared, model, base, counts, matched, shards = train(docs, **options)
    learned = docs.sparkSession.sparkContext.broadcast((model.tables, model.weights))  # the code is in the vocabulary
    names = ["row", "doc_id", "held_out", "n_tokens", "known", "base", "score", "n_bytes", "rare"]

    def each(batches):
        v = shared.value
        m = Model(v.code, *learned.value)
        for b in batches:
            for row in _pylist(b):
                text = _text(row, v)
                log2 = m.documents(text, _answers(row, text, shards))
                n, d = len(text.sizes), text.doc
                other = text.ids == v.size
                known = np.bincount(d[~text.end], ~other[~text.end], n).astype(np.int64) + base.seen_end
                score = np.bincount(d[~text.end], v.base[text.ids[~text.end]], n) + base.end
                rare = np.array(text.words, object)[text.ids[text.spelled_at] == v.size]
                edges = np.append(0, np.cumsum(np.bincount(d, other, n))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array((row["block"] << 9) + np.arange(n)), pa.array(row["doc_ids"], pa.int64()), pa.array([row["fold"] == 2] * n), pa.array(text.sizes), pa.array(known), pa.array(score), pa.array(log2 * np.log10(2)), pa.array(row["n_bytes"], pa.int64()), pa.ListArray.from_arrays(pa.array(edges), pa.array(rare.tolist(), pa.binary()))], names)

    scored = table(matched.mapInArrow(each, "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, n_bytes long, rare array<binary>"), "lm-scored")
    rare = scored.select("row", F.explode("rare").alias("word")).join(counts, "word", "left")
    rare = rare.groupBy(F.col("row").alias("_row")).agg(F.sum(F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(base.below))).alias("more"), F.count("c").alias("more_known"))
    both = scored.drop("rare").join(rare, F.col("row") == F.col("_row"), "left")
    per_byte = F.when(F.col("n_bytes") > 0, -F.col("score") / F.lit(float(np.log10(2))) / F.col("n_bytes"))
    return both.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(base.total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0e0))).alias("base_score"), "score", per_byte.alias("bits_per_byte"))
