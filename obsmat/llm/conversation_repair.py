"""Repair of conversations by a forward Viterbi pass.

A well-formed conversation reads `(s?(ua)+)?` in the initials of its roles: nothing, or turns of user and assistant after at
most one system turn. Four grammar states (nothing yet, after a system, a user, an assistant turn) carry the least
(cost, audit) of all ways to get there, where the audit is the string of the edits' initials: Keep, Rerole, Delete, Insert.
Each turn makes a layer from the one before; insertions then close the layer (two at most lead anywhere).

Comparing audits of one state is safe: costs follow from the letters, so of two audits of equal cost none begins with the
other, and what is appended later doesn't change their order. The letters also fix the repaired roles.

A conversation's turns come to one task in order and stream through it; texts are not gathered. A state from which nothing can
become cheaper than from another is dropped, and what all others have in common of their audits is settled and leaves the
layer, so a layer holds a few turns however long the conversation is. What a task holds of the whole conversation is a 16-byte
digest of each different turn, to know repetitions.
"""

from __future__ import annotations

import hashlib
import os.path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: From each state: the states that a turn may lead to and the initial that it needs.
MOVES = {NOTHING: ((SYSTEM, "s"), (USER, "u")), SYSTEM: ((USER, "u"),), USER: ((ASSISTANT, "a"),), ASSISTANT: ((USER, "u"),)}
ENDS = (NOTHING, ASSISTANT)
ROLES = {USER: "user", ASSISTANT: "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Adjacent initials that are no fault, what counts as white space, and what ends a sentence.
LEGAL, SPACES, STOPS = {"su", "ua", "au"}, "".join(map(chr, [0x20, *range(0x09, 0x0E)])), ".!?"
SUMMARY = "conv_id long, n_turns long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "conv_id long, position long, role string, text string"


class Repair:
    """One conversation. Lines (role, text) of the repaired conversation are given to `sink` in order, as soon as they are settled."""

    def __init__(self, conv_id, sink=None, hold: int = 64):
        self.conv_id, self.sink, self.hold = conv_id, sink or (lambda role, text: None), hold
        self.n = self.gaps = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.first = self.last = self.role = None
        self.turns, self.seen, self.audit, self.written = 0, set(), [], 0
        self.digest = hashlib.sha256()
        self.layer = [None] * 4  # (cost, audit, lines) of each state, or None
        self.layer[NOTHING] = (0, "", ())
        self.close()

    def offer(self, state: int, cost: int, audit: str, lines: tuple) -> None:
        held = self.layer[state]
        if held is None or (cost, audit) < held[:2]:
            self.layer[state] = (cost, audit, lines)

    def close(self) -> None:
        for _ in range(2):
            for state, moves in MOVES.items():
                if (held := self.layer[state]) is not None:
                    for to, _ in moves:
                        if to in ROLES:
                            self.offer(to, held[0] + INSERT, held[1] + "I", (*held[2], (ROLES[to], "")))
        # What goes on from the first two states goes on from the last as well, a system turn deleted instead of kept
        nothing, system, _, assistant = self.layer
        if nothing is not None and assistant[0] + DELETE < nothing[0]:
            self.layer[NOTHING] = None
        if system is not None and assistant[0] < system[0]:
            self.layer[SYSTEM] = None

    def fault(self, role: str, text: str) -> str | None:
        key = hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "replace"), digest_size=16).digest()
        again = key in self.seen
        self.seen.add(key)
        told = text.rstrip(SPACES)
        return "blank" if not told else "duplicate" if again else None if told[-1] in STOPS else "truncated"

    def add(self, turn, role: str, text: str) -> None:
        self.n += 1
        if turn is not None:
            if self.turns == 0:
                self.first = turn
            self.turns += self.turns == 0 or turn != self.last
            self.last = turn
        if self.role is not None:
            self.illegal += self.role[:1] + role[:1] not in LEGAL
        self.role = role
        fault = self.fault(role, text)
        self.blank, self.duplicate, self.truncated = (x + (fault == f) for x, f in ((self.blank, "blank"), (self.duplicate, "duplicate"), (self.truncated, "truncated")))
        before, self.layer = self.layer, [None] * 4
        extra = TRUNCATED if fault == "truncated" else 0
        for state, held in enumerate(before):
            if held is None:
                continue
            cost, audit, lines = held
            self.offer(state, cost + DELETE, audit + "D", lines)
            if fault in ("blank", "duplicate"):
                continue
            for to, initial in MOVES[state]:
                if role[:1] == initial:
                    self.offer(to, cost + extra, audit + "K", (*lines, (role, text)))
                elif to in ROLES:
                    self.offer(to, cost + REROLE + extra, audit + "R", (*lines, (ROLES[to], text)))
        self.close()
        if len(self.layer[ASSISTANT][1]) > self.hold:
            self.settle()

    def write(self, lines) -> None:
        for role, text in lines:
            self.digest.update((("\n" if self.written else "") + f"{role}:{text}").encode("utf-8", "replace"))
            self.sink(role, text)
            self.written += 1

    def settle(self) -> None:
        """Takes out what the audits of all states begin with; equal letters are equal lines."""
        live = [h for h in self.layer if h is not None]
        common = os.path.commonprefix([h[1] for h in live])
        n = len(common) - common.count("D")
        self.write(live[0][2][:n])
        self.audit.append(common)
        self.layer = [h and (h[0], h[1][len(common) :], h[2][n:]) for h in self.layer]

    def finish(self) -> tuple:
        cost, audit, lines = min((self.layer[s] for s in ENDS if self.layer[s] is not None), key=lambda h: h[:2])
        self.write(lines)
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return (self.conv_id, self.n, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, "".join(self.audit) + audit, self.digest.hexdigest())


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, present of a test of the repair: by crc32 of `conv_id:turn` mod 20 a row is dropped (0; a row
    with present = false stays, so that no conversation is lost), loses its text (1), loses its full stops, exclamation and
    question marks (2), stands twice (3) or becomes a user's (4). Nulls of role and text, and within the hashed string, are
    one space; conv_id and turn stay null."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), known("role").alias("role"), known("text").alias("text"))
    rows = rows.withColumn("_by", F.crc32(F.concat_ws(":", known("conv_id"), known("turn")).cast("binary")) % 20)
    by = F.col("_by")
    text = F.when(by <= 1, "").when(by == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.sequence(F.lit(1), F.when(by == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(by == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (by != 0).alias("present"), times.alias("_n")).drop("_n")


def in_order(turns: DataFrame) -> DataFrame:
    """The turns of each conversation after each other in one partition, by turn (nulls first), role and text."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    here = F.coalesce(F.col("present").cast("boolean"), F.lit(False)) if "present" in turns.columns else F.lit(True)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), known("role").alias("role"), known("text").alias("text"), here.alias("present"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")


def _streams(batches, sink_of, done):
    """Feeds sorted batches to one Repair at a time; yields after each batch."""
    now = None
    for b in batches:
        for conv_id, turn, role, text, present in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    done(now.finish())
                now = Repair(conv_id, sink_of(conv_id))
            if present:
                now.add(turn, role, text)
        yield
    if now is not None:
        done(now.finish())
        yield


def repair(turns: DataFrame) -> DataFrame:
    """A row for each conv_id of turns (conv_id, turn, role, text, perhaps present): n_turns, gaps (turn numbers missing between
    the first and the last), the faults blank, duplicate (role and text seen earlier), truncated (no full stop, exclamation or
    question mark at the end), each row counted by its first, illegal (adjacent initials other than su, ua, au), cost and
    audit of the cheapest repair (ties: least audit) and the SHA-256 of its `role:text` lines.

    Null roles and texts are one space, null turns come first and null conv_ids are one conversation; repeated rows are
    repeated turns. Rows whose present is false name their conversation only; one without other rows has zeros, an empty audit and the hash
    of an empty text. Texts are whole; an empty table gives an empty one; other columns are ignored.
    """

    def each(batches):
        held: list[tuple] = []
        for _ in _streams(batches, lambda conv_id: None, held.append):
            if held:
                yield _batch(held, SUMMARY)
                held.clear()

    return in_order(turns).mapInArrow(each, SUMMARY)


def repaired_turns(turns: DataFrame) -> DataFrame:
    """conv_id, position (from 0), role, text of the conversations as `repair` mends them."""

    def each(batches):
        held: list[tuple] = []

        def sink_of(conv_id):
            at = iter(range(1 << 62))
            return lambda role, text: held.append((conv_id, next(at), role, text))

        for _ in _streams(batches, sink_of, lambda summary: None):
            if held:
                yield _batch(held, TURNS)
                held.clear()

    return in_order(turns).mapInArrow(each, TURNS)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    kind = {"long": pa.int64(), "string": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(c, kind[k]) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], list(names))
