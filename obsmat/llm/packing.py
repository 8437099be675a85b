"""Hierarchical multi-length packing of token sequences.

Each document is cut into full windows of the longest tier; what is left is routed to the tier of its size (2048, 1024,
512, 256). Every tier is packed from its longest pieces on, gaps are filled from shorter pieces, and the last gap by a cut,
so windows are full and their lengths are powers of two; a task pads one window at most. Windows of one tier are put into
step groups of equal tokens. Packing is done where the text is read, in bounded buffers: nothing is shuffled, and a task
that is run again gives the same sequences.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TIERS = (2048, 1024, 512, 256)
END = 1
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
#: Words whose ids a worker remembers.
CACHE_WORDS = 800_000

_tokenizers: dict = {}


class WordIds(dict):
    """From a word (bytes) to its token ids (little-endian unsigned 32-bit, as bytes).

    The tokenizer drops white space and never joins across it, so a text's ids are those of its words in order.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.encode = Tokenizer.from_file(path).encode

    def __missing__(self, word: bytes) -> bytes:
        ids = b"".join(i.to_bytes(4, "little") for i in self.encode(word.decode(), add_special_tokens=False).ids)
        if len(self) < CACHE_WORDS:
            self[word] = ids
        return ids


def word_ids(path: str) -> WordIds:
    if path not in _tokenizers:
        _tokenizers[path] = WordIds(path)
    return _tokenizers[path]


class Packer:
    """Packs the documents of one task. Pieces are (doc_id, start, ids as bytes, tokens of the document)."""

    def __init__(self, base: int, tiers=TIERS, step_tokens: int = 65536):
        self.base, self.tiers, self.step = base, tuple(sorted(tiers, reverse=True)), step_tokens
        self.waiting: dict[int, list] = {}
        self.lengths = 0  # a bit for each length that waits
        self.tokens = 0
        self.sequences = self.groups = 0
        self.open_group: dict[int, list[int]] = {}
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: bytes) -> None:
        total, top, at = len(ids) // 4, self.tiers[0], 0
        while total - at >= top:
            self.emit([(doc_id, at, ids[4 * at : 4 * (at + top)], total)], top)
            at += top
        if at < total:
            self.wait((doc_id, at, ids[4 * at :], total))

    def wait(self, piece) -> None:
        n = len(piece[2]) // 4
        self.waiting.setdefault(n, []).append(piece)
        self.lengths |= 1 << n
        self.tokens += n

    def take(self, n: int):
        found = self.waiting[n].pop()
        if not self.waiting[n]:
            self.lengths &= ~(1 << n)
        self.tokens -= n
        return found

    def longest(self, most: int) -> int:
        """The greatest length waiting that is no more than most, or 0."""
        return max(0, (self.lengths & ((1 << (most + 1)) - 1)).bit_length() - 1)

    def next_above(self, n: int) -> int:
        rest = self.lengths >> (n + 1)
        return n + 1 + ((rest & -rest).bit_length() - 1) if rest else 0

    def emit(self, pieces, tier: int) -> None:
        group = self.open_group.get(tier)
        if group is None or group[1] >= max(1, self.step // tier):
            group = self.open_group[tier] = [self.groups, 0]
            self.groups += 1
        group[1] += 1
        offset = 0
        for doc_id, start, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((doc_id, start, n, zlib.crc32(ids), total, self.base + self.sequences, offset, tier, self.base + group[0]))
            offset += n
        self.sequences += 1

    def pack(self, final: bool) -> None:
        """Full windows from what waits; with final also the rest, in one window that may need padding."""
        for i, tier in enumerate(self.tiers):
            least = self.tiers[i + 1] if i + 1 < len(self.tiers) else 0
            while self.tokens >= tier and (n := self.longest(tier)) > least:
                room, window = tier - n, [self.take(n)]
                while room:
                    if n := self.longest(min(room, least or room)) or self.longest(room):
                        window.append(self.take(n))
                        room -= n
                    else:
                        doc_id, start, ids, total = self.take(self.next_above(room))
                        window.append((doc_id, start, ids[: 4 * room], total))
                        self.wait((doc_id, start + room, ids[4 * room :], total))
                        room = 0
                self.emit(window, tier)
        if final and self.tokens:
            window = []
            while n := self.longest(self.tiers[0]):
                window.append(self.take(n))
            self.emit(window, self.tiers[0])

    def drain(self) -> pa.RecordBatch:
        cols = list(zip(*self.rows, strict=True)) or [()] * 9
        self.rows = []
        kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])


def pack(docs: DataFrame, tokenizer_path: str, *, tiers=TIERS, step_tokens: int = 65536, buffer_tokens: int = 2_000_000) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group.

    A document's ids are those of its text and then id 1; null and empty texts are that id alone. Repeated rows are
    packed as documents of their own; null doc_ids stay null; an empty table gives an empty one. The tokenizer must be
    one that drops white space. Sequences come from single tasks: their ids begin at 2^40 times the task's number.
    """

    def each(batches):
        packer, ids_of = Packer((TaskContext.get().partitionId() if TaskContext.get() else 0) << 40, tiers, step_tokens), word_ids(tokenizer_path)
        end = END.to_bytes(4, "little")
        get = ids_of.__getitem__
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                packer.add(doc_id, b"".join(map(get, raw.split())) + end)
                if packer.tokens >= buffer_tokens:
                    packer.pack(final=False)
                if len(packer.rows) >= 20_000:
                    yield packer.drain()
        packer.pack(final=True)
        yield packer.drain()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(each, SCHEMA)
