"""Repeated byte strings by bucket-pointer refinement.

Every byte offset starts in the bucket of its 8-byte gram. Buckets are refined by the bucket identifiers of later offsets:
the identifier at depth 2h comes from those at depth h of the offset and of the offset h further on, and each level reuses
the one before (8, 16, 32, 64, 128, then up to 200 bytes). Identifiers are content hashes, so documents agree on them
without a global renumbering, and only sorting (shuffling) by identifier compares documents. Buckets of one member are
dropped as early as possible, so few offsets are refined further:

1. Offsets are represented by anchors. The first 100 bytes of a 200-byte string choose one of their offsets (by the least
   initial identifier, the leftmost if tied), so equal strings have their anchors at the same place. A run of strings with
   one anchor is one row. Anchors are bucketed by the 108 bytes that every string of theirs contains.
2. Anchors in buckets of two or more are refined by the whole content of their run. Runs that occur twice are repeated
   from end to end.
3. The other runs of those buckets are cut into groups of eight starts, at places that depend on the distance to the
   anchor alone. Groups are bucketed by the bytes that all eight strings share, and refined by their whole content.
4. Groups that share a bucket but not their content are refined start by start, at depth 200.

A bitmap of fixed size (bits) of the buckets that are still alive is broadcast as a first filter; exact joins follow.
Long texts are read in blocks; a run cut by a block's end is merely decided in a later step. Two identifiers together tell
contents apart (128 bits, in step 4 96).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsmat.llm.common import table

DEPTH = 200
BITS = 27
#: Offsets from which an anchor is chosen, bytes of an anchor's bucket, starts in a group, and bytes refined at once.
CHOICES, OWN, GROUP, BLOCK = 93, 108, 8, 1 << 18

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def first_buckets(a: np.ndarray) -> np.ndarray:
    """An identifier of the 8 bytes at each offset."""
    n = len(a) - 7
    out = np.empty(n, np.uint64)
    for k in range(8):
        m = (n - k + 7) // 8
        if m > 0:
            out[k::8] = np.frombuffer(a[k : k + 8 * m].tobytes(), "<u8")
    out *= _A
    out ^= out >> np.uint64(29)
    out *= _B
    out ^= out >> np.uint64(32)
    return out


def refine(x: np.ndarray, later: np.ndarray) -> np.ndarray:
    """Identifiers from those of an offset and of a later one."""
    z = x * _A
    z ^= later + (x >> np.uint64(31))
    z *= _C
    z ^= z >> np.uint64(29)
    z *= _B
    z ^= z >> np.uint64(32)
    return z


def deep(ids: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Identifiers at depth 8, 16, 32, ... of the offsets `at`, each from two of half the depth."""
    if depth == 8:
        return ids.take(at)
    return refine(deep(ids, at, depth // 2), deep(ids, at + depth // 2, depth // 2))


def between(ids: np.ndarray, begin: np.ndarray, length) -> np.ndarray:
    """Identifiers of strings of 128 to 256 bytes, from those of their first and last 128."""
    return refine(deep(ids, begin, 128), deep(ids, begin + (length - 128), 128))


class Block:
    """The anchors of the 200-byte strings of some pieces of texts (number of the text, offset in it, bytes).

    Arrays with an element a run: piece, lo and hi (first and last start in the joined bytes), pos (the anchor).
    """

    def __init__(self, pieces: list[tuple[int, int, bytes]]):
        a = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8)
        self.ids = ids = first_buckets(a)
        size = np.array([len(p[2]) for p in pieces])
        ends = np.cumsum(size)
        self.text = np.array([p[0] for p in pieces])
        self.shift = np.array([p[1] for p in pieces]) - (ends - size)  # from joined to own offsets
        least = ((ids >> np.uint64(52)).astype(np.uint32) << np.uint32(20)) | np.arange(len(ids), dtype=np.uint32)
        k = 1
        while 2 * k <= CHOICES:
            least = np.minimum(least[:-k], least[k:])
            k *= 2
        least = np.minimum(least[: len(least) - (CHOICES - k)], least[CHOICES - k :])
        at = (least[: len(a) - DEPTH + 1] & np.uint32((1 << 20) - 1)).astype(np.int32)
        first = np.zeros(len(at) + 1, bool)
        first[1:-1] = at[1:] != at[:-1]
        first[(ends - size)[size >= DEPTH]] = True
        first[np.minimum(ends - DEPTH + 1, len(at))] = True  # the strings that cross pieces begin here
        self.lo = np.flatnonzero(first[:-1])
        self.hi = np.append(self.lo[1:], len(at)) - 1
        self.piece = np.searchsorted(ends, self.lo, side="right")
        inside = self.lo <= ends[self.piece] - DEPTH
        self.lo, self.hi, self.piece = self.lo[inside], self.hi[inside], self.piece[inside]
        self.pos = at[self.lo].astype(np.int64)
        self.bucket = refine(deep(ids, self.pos, 64), deep(ids, self.pos + (OWN - 64), 64))

    def runs(self, on: np.ndarray) -> np.ndarray:
        """Identifiers of the whole content of runs."""
        lo, pos = self.lo[on], self.pos[on]
        length = self.hi[on] - lo + DEPTH
        ends = refine(between(self.ids, lo, np.minimum(length, 206)), deep(self.ids, lo + length - 128, 128))
        return refine(ends, (length * 1024 + (pos - lo)).astype(np.uint64))

    def groups(self, on: np.ndarray):
        """Of the runs: (run's place in `on`, lo, hi, bucket, content, identifiers of the strings from lo to hi) of each group."""
        lo, hi, pos = self.lo[on], self.hi[on], self.pos[on]
        number = hi - lo + 1
        run = np.repeat(np.arange(len(on)), number)
        s = np.repeat(lo - (np.cumsum(number) - number), number) + np.arange(len(run))
        k = pos[run] - s
        part = k // GROUP
        strings = between(self.ids, s, DEPTH)
        new = np.ones(len(run), bool)
        new[1:] = (run[1:] != run[:-1]) | (part[1:] != part[:-1])
        a = np.flatnonzero(new)
        b = np.append(a[1:], len(run)) - 1
        shared = between(self.ids, pos[run[a]] - part[a] * GROUP, DEPTH - GROUP + 1)
        content = refine(refine(strings[a], strings[b]), (k[a] * 256 + k[b]).astype(np.uint64))
        return run[a], s[a], s[b], refine(shared, part[a].astype(np.uint64)), content, a, b + 1, strings


def blocks(texts: list[bytes], size: int = BLOCK):
    """Blocks of the texts; pieces of long texts overlap so that each start is in one piece."""
    held, total = [], 0
    for i, raw in enumerate(texts):
        for base in range(0, max(0, len(raw) - DEPTH + 1), size):
            piece = raw[base : base + size + DEPTH - 1]
            held.append((i, base, piece))
            total += len(piece)
            if total >= size:
                yield Block(held)
                held, total = [], 0
    if held:
        yield Block(held)


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column(1)]


def _signed(x) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _alive(keys: DataFrame, bits: int):
    """A broadcast bitmap of the top bits of column bucket; at most 2^(bits-6) words reach the driver."""
    slots = keys.select(F.shiftrightunsigned("bucket", 64 - bits).alias("slot"))
    words = slots.selectExpr("shiftrightunsigned(slot, 6) AS w", "shiftleft(1L, CAST(slot & 63 AS INT)) AS b").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    found = np.zeros(1 << max(0, bits - 6), np.int64)
    found[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return keys.sparkSession.sparkContext.broadcast(found.view(np.uint64))


def _has(bitmap: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    slot = keys >> np.uint64(64 - bits)
    return (bitmap[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


def _count(arrays: list[list[np.ndarray]], names: list[str]) -> pa.RecordBatch:
    """The distinct rows of the columns, with their number n."""
    cols = [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in arrays]
    order = np.lexsort(cols[::-1])
    cols = [c[order] for c in cols]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(order)))
    return pa.RecordBatch.from_arrays([*(_signed(c[at]) for c in cols), pa.array(n.astype(np.int64))], [*names, "n"])


def repeated(docs: DataFrame, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """doc_id, text_hash, spans (array of lo, hi: starts of 200-byte strings that start elsewhere too), only for texts with such."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def buckets(batches):
        for b in batches:
            yield _count([[x.bucket for x in blocks(_texts(b), block)]], ["bucket"])

    many = table(src.mapInArrow(buckets, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).where("n > 1").select("bucket"), "repeat-buckets")
    alive = _alive(many, bits)

    def runs(batches):
        for b in batches:
            found = [[], []]
            for x in blocks(_texts(b), block):
                on = np.flatnonzero(_has(alive.value, x.bucket, bits))
                found[0].append(x.bucket[on])
                found[1].append(x.runs(on))
            yield _count(found, ["bucket", "run"])

    classes = table(src.mapInArrow(runs, "bucket long, run long, n long").groupBy("bucket", "run").agg(F.sum("n").alias("n")), "repeat-runs")
    whole = classes.where("n > 1").select("bucket", "run")
    partly = classes.groupBy("bucket").agg(F.count("*").alias("runs"), F.min("n").alias("least")).where("runs > 1 and least = 1").select("bucket")
    open_ = _alive(table(partly, "repeat-open"), bits)

    def members(batches):
        sent: set = set()  # runs whose groups this task has sent; only saves rows
        for b in batches:
            texts = _texts(b)
            ids = b.column(0)
            digest = np.array([xxhash.xxh64_intdigest(t, 42) for t in texts], np.uint64).view(np.int64)
            for x in blocks(texts, block):
                on = np.flatnonzero(_has(alive.value, x.bucket, bits))
                if not len(on):
                    continue
                run, shift, text = x.runs(on), x.shift[x.piece[on]], x.text[x.piece[on]]
                fresh = np.flatnonzero(_has(open_.value, x.bucket[on], bits))
                fresh = np.array([i for i, r in zip(fresh.tolist(), run[fresh].tolist(), strict=True) if r not in sent and not sent.add(r)], np.int64)
                of, lo, hi, bucket, content, a, z, strings = x.groups(on[fresh]) if len(fresh) else [np.zeros(0, np.int64)] * 8
                of = fresh[of] if len(fresh) else of
                at = np.concatenate([text, text[of]])
                where = np.concatenate([shift, shift[of]])
                edges = np.concatenate([np.zeros(len(on), np.int64), np.append(a, len(strings))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(edges), _signed(strings)) if len(fresh) else pa.array([[]] * len(on), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(at)), pa.array(digest[at]), _signed(np.concatenate([x.bucket[on], bucket.astype(np.uint64)])), _signed(np.concatenate([run, content.astype(np.uint64)])), pa.array(np.concatenate([x.lo[on], lo]) + where), pa.array(np.concatenate([x.hi[on], hi]) + where), lists],
                    ["doc_id", "text_hash", "bucket", "content", "lo", "hi", "strings"],
                )
            if len(sent) > 2_000_000:
                sent.clear()

    found = table(src.mapInArrow(members, "doc_id long, text_hash long, bucket long, content long, lo long, hi long, strings array<long>"), "repeat-members")
    place = ["doc_id", "text_hash", "lo", "hi"]
    sure = found.where("size(strings) = 0").join(whole.withColumnRenamed("run", "content"), ["bucket", "content"], "left_semi").select(place)
    groups = found.where("size(strings) > 0")
    kinds = table(groups.groupBy("bucket", "content").agg(F.count("*").alias("n")), "repeat-groups")
    both = groups.drop("strings").join(kinds.where("n > 1"), ["bucket", "content"], "left_semi").select(place)
    mixed = kinds.groupBy("bucket").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 and least = 1").select("bucket")
    late = groups.join(mixed, "bucket", "left_semi")
    each = late.select("doc_id", "text_hash", F.expr("CAST(bucket & 2147483647 AS INT)").alias("part"), "lo", F.posexplode("strings").alias("i", "string"))
    each = table(each.select("doc_id", "text_hash", (F.col("lo") + F.col("i")).alias("lo"), "part", "string"), "repeat-late")
    twice = table(each.groupBy("part", "string").agg(F.count("*").alias("n")).where("n > 1").select("part", "string"), "repeat-strings")
    last = each.join(twice, ["part", "string"], "left_semi").select("doc_id", "text_hash", "lo", F.col("lo").alias("hi"))
    return sure.unionByName(both).unionByName(last).groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def runs_of(spans) -> list[tuple[int, int]]:
    """The maximal byte runs [begin, end) that the strings starting in the spans cover."""
    if spans is None or not len(spans):
        return []
    out: list[list[int]] = []
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi + DEPTH)
        else:
            out.append([lo, hi + DEPTH])
    return [tuple(x) for x in out]


def cut(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in runs:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


def with_spans(docs: DataFrame, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """docs with _spans, null where nothing repeats. The hash of the text is XXH64 with seed 42 on both sides."""
    found = table(repeated(docs, bits, block).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("spans").alias("_spans")), "repeat-spans")
    keyed = docs.withColumns({"_a": F.col("doc_id").cast("long"), "_b": F.xxhash64(F.col("text").cast("string"))})
    return keyed.join(found, F.col("_a").eqNullSafe(F.col("_id")) & (F.col("_b") == F.col("_hash")), "left").drop("_a", "_b", "_id", "_hash")


def digests(docs: DataFrame, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: a row for each row of docs.

    Null texts count as empty and texts under 200 bytes lose nothing; rows with one text lose it wholly, if it has 200
    bytes, even with the same doc_id; null doc_ids stay null; an empty table gives an empty one.
    """

    def each(batches):
        for b in batches:
            rows = []
            for doc_id, text, spans in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                runs = runs_of(spans.as_py()) if spans.is_valid else []
                rows.append((doc_id, len(raw), sum(e - s for s, e in runs), len(runs), hashlib.sha256(cut(raw, runs)).hexdigest()))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return with_spans(src, bits, block).select("doc_id", "text", "_spans").mapInArrow(each, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, bits: int = BITS, drop_emptied: bool = False) -> DataFrame:
    """docs with the repeated bytes taken out of text; characters that lose a part of their bytes go too; n_chars, if there, follows.

    Every occurrence goes, the first included, as in `digests`. drop_emptied: rows without a word left go too (also those that
    had none before). Null texts stay null, repeated rows lose all they share, extra columns stay, whatever their names.
    """
    plain = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.struct(*docs.columns).alias("_row"))
    found = with_spans(plain, bits)

    def each(batches):
        for b in batches:
            text = [cut(t.as_buffer().to_pybytes(), runs_of(s.as_py())).decode(errors="ignore") if s.is_valid and t.is_valid else t.as_py() for t, s in zip(b.column("text"), b.column("_spans"), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(text, pa.string()), b.column("_row")], ["_text", "_row"])

    row = found.schema["_row"].dataType
    out = found.select("text", "_spans", "_row").mapInArrow(each, f"_text string, _row {row.simpleString()}")
    out = out.where(F.col("_text").rlike(r"[^ \x09-\x0D]")) if drop_emptied else out
    return out.select(*[F.col("_text").alias(c) if c == "text" else F.length("_text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col("_row")[c].alias(c) for c in docs.columns])
