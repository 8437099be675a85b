"""Chat formatting with loss masks from offsets.

A conversation is rendered to one string and encoded with offsets; the sorted spans of the assistant turns are
intersected with the sorted token spans by binary search. The marks of the template are special tokens for the tokenizer
(added when it is loaded), so no token crosses from a mark into a text. Control strings inside texts are escaped with a
backslash after their first character, which can be undone.

A conversation's turns come to one task in order and stream through it. So that a task's memory doesn't follow a
conversation's length, or the number of conversations, a long conversation is several rows: pieces that begin at a mark or,
inside a long text, where a tokenizer that is known to begin a word there does so. What is encoded piece by piece has the
tokens of the whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import chain, groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Control strings of common chat templates. `<|` covers the marks above and the tokenizers' own.
_TAIL = r"(?:\||s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>|unk>|pad>)"
_ESCAPE, _UNESCAPE = re.compile(rf"([<\[])(\\*)(?={_TAIL})"), re.compile(rf"([<\[])\\(\\*)(?={_TAIL})")
SCHEMA = "conv_id long, formatted string, n_turns long, token_ids array<int>, token_starts array<int>, token_ends array<int>, loss array<boolean>, piece long"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
#: Code points that a conversation may have in one row, and those of the rows that are sent on together.
PIECE = BATCH = 1 << 17
#: Where white space begins.
_GAP = re.compile(r"(?<=\S)[ \n]")

_tokenizers: dict = {}


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def tokenizer(path: str):
    if path not in _tokenizers:
        from tokenizers import AddedToken, Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        t.add_special_tokens([AddedToken(m, special=True, normalized=False) for m in (TURN, TEXT, END)])
        _tokenizers[path] = t
    return _tokenizers[path]


def cuts_at_gaps(tok) -> bool:
    """Whether no token goes on from a letter or sign to white space, and tokens after such a place don't depend on what is before."""
    from tokenizers.pre_tokenizers import ByteLevel

    p = tok.pre_tokenizer
    return tok.normalizer is None and isinstance(p, ByteLevel) and p.use_regex and not p.add_prefix_space and not any(a.rstrip or re.search(r"\s", a.content) for a in tok.get_added_tokens_decoder().values())


def cut(text: str, most: int) -> Iterator[str]:
    """text in parts, each but the last ended by the first gap after `most` code points."""
    at = 0
    while len(text) - at > most and (gap := _GAP.search(text, at + most)):
        yield text[at : gap.start()]
        at = gap.start()
    yield text[at:]


def render(turns: Iterable[tuple[str, str]], learn: str = "assistant", most: int = PIECE, inside: bool = False) -> Iterator[tuple[str, list[tuple[int, int]], int]]:
    """(formatted, spans of the texts to learn, number of turns that begin here) of each piece of a conversation of (role, text)
    turns. A turn that would make a piece longer than `most` begins the next; with inside, texts longer than that are cut too."""
    out, at, spans, n = [], 0, [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        if at and at + len(head) + len(body) + len(END) > most:
            yield "".join(out), spans, n
            out, at, spans, n = [], 0, [], 0
        n += 1
        out.append(head)
        at += len(head)
        for i, part in enumerate(cut(body, most) if inside else (body,)):
            if i:
                yield "".join(out), spans, n
                out, at, spans, n = [], 0, [], 0
            if part and role == learn:
                spans.append((at, at + len(part)))
            out.append(part)
            at += len(part)
        out.append(END)
        at += len(END)
    if out:
        yield "".join(out), spans, n


def parse(formatted: str) -> list[tuple[str | None, str]]:
    """The turns of a formatted conversation, or of a piece of one; a role is None where the text of the turn before goes on."""
    before, *parts = formatted.split(TURN)
    turns = [(None, unescape(before.removesuffix(END)))] if before else []
    for part in parts:
        role, _, text = part.removesuffix(END).partition(TEXT)
        turns.append((unescape(role), unescape(text)))
    return turns


def loss_mask(spans: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether each token span meets one of the sorted, disjoint spans: the first span that ends after the token's start must begin before its end."""
    if not len(spans):
        return np.zeros(len(starts), bool)
    at = np.searchsorted(spans[:, 1], starts, side="right")
    begin = np.append(spans[:, 0], np.iinfo(np.int64).max)[at]
    return (begin < ends) & (ends > starts)


def encode(formatted: str, spans: list[tuple[int, int]], tok) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, starts, ends, loss) of the tokens of one piece."""
    e = tok.encode(formatted, add_special_tokens=False)
    off = np.fromiter(chain.from_iterable(e.offsets), np.int32, 2 * len(e)).reshape(-1, 2)
    return np.array(e.ids, np.int32), off[:, 0], off[:, 1], loss_mask(np.array(spans, np.int64).reshape(-1, 2), off[:, 0], off[:, 1])


def _formatted(rows: list[tuple]) -> pa.RecordBatch:
    """A batch of (conv_id, formatted, n_turns, piece, (ids, starts, ends, loss)) rows."""
    conv, formatted, n, piece, tokens = zip(*rows, strict=True)
    at = pa.array(np.cumsum([0, *(len(t[0]) for t in tokens)]), pa.int32())
    lists = [pa.ListArray.from_arrays(at, pa.array(np.concatenate(x))) for x in zip(*tokens, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(formatted, pa.string()), pa.array(n, pa.int64()), *lists, pa.array(piece, pa.int64())], ["conv_id", "formatted", "n_turns", "token_ids", "token_starts", "token_ends", "loss", "piece"])


def formatted_batches(batches: Iterable[pa.RecordBatch], tokenizer_path: str, piece: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The rows of batches of (conv_id, role, text) turns in order, given on as soon as they have BATCH code points."""
    tok = tokenizer(tokenizer_path)
    inside = cuts_at_gaps(tok)
    held, size = [], 0
    rows = ((c.as_py(), r.as_py(), t.as_py()) for b in batches for c, r, t in zip(*b.columns, strict=True))
    for conv, own in groupby(rows, itemgetter(0)):
        for k, (text, spans, n) in enumerate(render((x[1:] for x in own), most=piece, inside=inside)):
            held.append((conv, text, n, k, encode(text, spans, tok)))
            size += len(text)
            if size >= BATCH:
                yield _formatted(held)
                held, size = [], 0
    if held:
        yield _formatted(held)


def format_conversations(conversations: DataFrame, tokenizer_path: str, piece: int = PIECE) -> DataFrame:
    """One row a conversation: conv_id, formatted, n_turns, token_ids, token_starts, token_ends (code points), loss, piece.

    A conversation of over `piece` code points has several rows, in order after each other in one partition and numbered from 0
    in `piece`: put together, texts and tokens are those of the whole. n_turns counts the turns that begin in a row, and spans
    count from the row's beginning. Rows are cut between turns and, with a byte-level tokenizer of the usual pattern, where
    white space begins in a text. So a task holds one row, one turn and one batch of turns.

    Turns are ordered by turn, then role and text; null texts and roles are empty; a null conv_id is a conversation of
    its own; repeated rows are repeated turns; an empty table gives an empty one. Different conversations with the same turns
    share nothing.
    """
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", known("role"), known("text"))
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text").select("conv_id", "role", "text")

    return ordered.mapInArrow(lambda batches: formatted_batches(batches, tokenizer_path, piece), SCHEMA)


def under_mask(formatted: str, starts: np.ndarray, ends: np.ndarray, loss: np.ndarray) -> str:
    """The text that the masked tokens cover, unescaped; tokens that share a character count it once."""
    on = np.flatnonzero(loss)
    if not len(on):
        return ""
    before = np.maximum.accumulate(np.concatenate([[0], ends]))[on]
    starts, ends = np.maximum(starts[on], before), np.maximum(ends[on], before)
    apart = np.diff(on) > 1
    last = np.flatnonzero(apart | (starts[1:] > ends[:-1]))  # where what stands together ends
    out, held = [], []
    for a, b, over in zip(starts[[0, *(last + 1)]].tolist(), ends[[*last, -1]].tolist(), [*apart[last].tolist(), True], strict=True):
        held.append(formatted[a:b])
        if over:
            out.append(unescape("".join(held)))
            held = []
    return "".join(out)


class Reading:
    """Reads one conversation back, piece by piece."""

    def __init__(self, conv_id):
        self.conv_id, self.pieces = conv_id, 0
        self.n_turns = self.loss_chars = self.formatted_chars = 0
        self.turns, self.learned = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, starts: np.ndarray, ends: np.ndarray, loss: np.ndarray) -> None:
        for role, text in parse(formatted):
            if role is not None:
                self.turns.update((("\n" if self.n_turns else "") + f"{role}\n").encode())
                self.n_turns += 1
            self.turns.update(text.encode())
        learned = under_mask(formatted, starts, ends, loss)
        self.learned.update(learned.encode())
        self.loss_chars += len(learned)
        self.formatted_chars += len(formatted)
        self.pieces += 1

    def finish(self) -> tuple:
        if self.n_turns:
            self.turns.update(b"\n")
        return self.conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.learned.hexdigest(), self.formatted_chars


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from formatted conversations. The pieces
    of a conversation must come after each other in one partition, as `format_conversations` gives them, or it is an error."""

    def each(batches):
        now, done = None, []
        for b in batches:
            for conv, piece, text, *tokens in zip(*b.columns, strict=True):
                conv, piece = conv.as_py(), piece.as_py()
                if piece == 0:
                    if now is not None:
                        done.append(now.finish())
                    now = Reading(conv)
                if now is None or now.conv_id != conv or now.pieces != piece:
                    raise ValueError(f"piece {piece} of conversation {conv} doesn't follow the one before")
                now.add(text.as_py(), *(x.values.to_numpy(zero_copy_only=False) for x in tokens))
            if done:
                yield _digested(done)
                done = []
        if now is not None:
            yield _digested([now.finish()])

    return formatted.select("conv_id", "piece", "formatted", "token_starts", "token_ends", "loss").mapInArrow(each, DIGESTS)


def _digested(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string()}
    names, types = zip(*(x.split() for x in DIGESTS.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, k in zip(zip(*rows, strict=True), types, strict=True)], list(names))
