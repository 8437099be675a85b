"""Vector codes: product quantisation by Elkan's form of Lloyd's rounds, in integers.

Vectors are scaled to integers and cut into equal parts; each part position has a codebook. Every row keeps, for each part,
its nearest entry, an upper bound of the distance to it and a lower bound of the distance to each entry, as a table in the
shared folder that the next round reads. When entries move, bounds are shifted by the lengths of the moves. An entry is passed over
only if the triangle inequality puts it strictly further off: its lower bound is above the upper bound, or it lies more than
two upper bounds from the present entry. Bounds are whole numbers, rounded down (lower) and up (upper), and what they leave
is decided by squared distances in whole numbers, ties to the lower index. So the result is that of comparing everything.

Only codebooks, and sums and counts of their entries, pass through the driver; their size is that of the codebooks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from obsmat.llm.common import dropped, table_at

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Lower bounds are kept as unsigned 16-bit numbers; a lower bound may always be lowered to what fits.
MOST = 65535
#: Rows that a worker compares at a time, and labels whose sums may be broadcast.
ROWS, LABELS = 2048, 100_000


def integer_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label, v (array of long, floor(scale * x)) of the rows whose vector is neither null nor empty and holds neither
    nulls nor numbers that aren't finite."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))  # NaN counts as larger than infinity
    rows = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & fine)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"))


def root_down(squares: np.ndarray) -> np.ndarray:
    r = np.sqrt(squares.astype(float)).astype(np.int64)
    r -= r * r > squares
    return r + ((r + 1) * (r + 1) <= squares)


def root_up(squares: np.ndarray) -> np.ndarray:
    r = root_down(squares)
    return r + (r * r < squares)


def all_squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows and entries. Products of small numbers are exact in floating point, which is quicker."""
    widest = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if widest * widest * 4 * x.shape[1] < 1 << 53:
        a, b = x.astype(float), entries.astype(float)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)).astype(np.int64)
    return ((x[:, None, :] - entries[None, :, :]) ** 2).sum(2)


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    gap = x - entries
    return (gap * gap).sum(1)


def first_bounds(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest entry, upper bound, lower bounds) of rows that have none."""
    d = all_squares(x, entries)
    near = d.argmin(1)
    return near, root_up(d[np.arange(len(x)), near]), np.minimum(root_down(d), MOST)


def next_bounds(x, entries, moved, apart, near, upper, lower):
    """The same after the entries have moved by at most `moved`; apart: distances between entries, rounded down.
    Returns also how many distances were worked out."""
    rows = np.arange(len(x))
    upper = upper + moved[near]
    lower = np.maximum(0, lower - moved[None, :])
    far = apart[near]
    maybe = (lower <= upper[:, None]) & (far <= 2 * upper[:, None])
    maybe[rows, near] = False
    open_ = np.flatnonzero(maybe.any(1))
    own = squares(x[open_], entries[near[open_]])
    upper[open_] = root_up(own)
    maybe[open_] &= (lower[open_] <= upper[open_, None]) & (far[open_] <= 2 * upper[open_, None])
    i, j = np.nonzero(maybe)
    d = np.concatenate([squares(x[i[s : s + (1 << 16)]], entries[j[s : s + (1 << 16)]]) for s in range(0, len(i), 1 << 16)] or [np.zeros(0, np.int64)])
    lower[i, j] = np.minimum(root_down(d), MOST)
    if len(i):
        best = np.lexsort((j, d, i))
        best = best[np.append(True, i[best][1:] != i[best][:-1])]
        i, j, d = i[best], j[best], d[best]
        held = np.zeros(len(x), np.int64)
        held[open_] = own
        better = (d < held[i]) | ((d == held[i]) & (j < near[i]))
        i, j, d = i[better], j[better], d[better]
        lower[i, near[i]] = np.minimum(root_down(held[i]), MOST)
        near[i], upper[i] = j, root_up(d)
    return near, upper, lower, len(open_) + int(maybe.sum())


def packed(x: np.ndarray) -> pa.Array:
    """A binary value for each row of x."""
    x = np.ascontiguousarray(x)
    width = x.dtype.itemsize * int(np.prod(x.shape[1:]))
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1) * width).astype(np.int32)), pa.py_buffer(x)])


def unpacked(column: pa.Array, dtype, *shape: int) -> np.ndarray:
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(dtype).reshape(len(column), *shape)


STATE = [("v", "binary"), ("near", "binary"), ("upper", "binary"), ("lower", "binary")]


def bounded(rows: DataFrame, books: np.ndarray, old: np.ndarray | None) -> DataFrame:
    """vec_id, label and the state of each row under the codebooks (parts x entries x width); old: those of the state's bounds,
    None for rows without (v as array)."""
    parts, k, width = books.shape
    moved = None if old is None else root_up(((books - old) ** 2).sum(2))

    def each(batches):
        apart = None if old is None else [root_down(all_squares(e, e)) for e in books]
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                if old is None:
                    v = b.column(2)
                    x = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), parts, width)
                    found = [first_bounds(x[:, p], books[p]) for p in range(parts)]
                else:
                    x = unpacked(b.column(2), "<i4", parts, width).astype(np.int64)
                    near, upper, lower = (unpacked(b.column(c), t, parts, *s).astype(np.int64) for c, t, s in ((3, "<u2", ()), (4, "<i8", ()), (5, "<u2", (k,))))
                    found = [next_bounds(x[:, p], books[p], moved[p], apart[p], near[:, p], upper[:, p], lower[:, p]) for p in range(parts)]
                near, upper, lower = (np.stack([f[c] for f in found], 1) for c in range(3))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), packed(x.astype("<i4")), packed(near.astype("<u2")), packed(upper.astype("<i8")), packed(lower.astype("<u2"))], ["vec_id", "label", *(n for n, _ in STATE)])

    schema = StructType([rows.schema["vec_id"], rows.schema["label"]])
    for name, kind in STATE:
        schema = schema.add(name, kind)
    return rows.mapInArrow(each, schema)


def renewed(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks whose entries are the means, rounded down, of the parts nearest to them; entries without any stay."""
    parts, k, width = books.shape

    def each(batches):
        sums, counts = np.zeros((parts, k, width), np.int64), np.zeros((parts, k), np.int64)
        for b in batches:
            x, near = unpacked(b.column(0), "<i4", parts, width), unpacked(b.column(1), "<u2", parts)
            for p in range(parts):
                np.add.at(sums[p], near[:, p], x[:, p])
                counts[p] += np.bincount(near[:, p], minlength=k)
        p, e = np.nonzero(counts)
        slots = (p * k + e)[:, None] * (width + 1) + np.arange(width + 1)[None, :]
        values = np.concatenate([sums[p, e], counts[p, e][:, None]], 1)
        yield pa.RecordBatch.from_arrays([pa.array(slots.ravel()), pa.array(values.ravel())], ["slot", "value"])

    found = state.select("v", "near").mapInArrow(each, "slot long, value long").groupBy("slot").agg(F.sum("value").alias("value")).toPandas()
    flat = np.zeros(parts * k * (width + 1), np.int64)
    flat[found.slot.to_numpy()] = found.value.to_numpy()
    flat = flat.reshape(parts, k, width + 1)
    counts = flat[:, :, width:]
    return np.where(counts > 0, flat[:, :, :width] // np.maximum(counts, 1), books)


def coded(state: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (two hexadecimal digits a part; four with more than 256 entries), error."""
    parts, k, width = books.shape
    digits = 2 if k <= 256 else 4

    def each(batches):
        for b in batches:
            x, near = unpacked(b.column(2), "<i4", parts, width).astype(np.int64), unpacked(b.column(3), "<u2", parts)
            error = sum(squares(x[:, p], books[p][near[:, p]]) for p in range(parts))
            raw = near.astype(">u2").tobytes().hex() if digits == 4 else near.astype("u1").tobytes().hex()
            code = [raw[i : i + digits * parts] for i in range(0, len(raw), digits * parts)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(code, pa.string()), pa.array(np.asarray(error, np.int64))], ["vec_id", "label", "code", "error"])

    return state.select("vec_id", "label", "v", "near").mapInArrow(each, StructType([state.schema["vec_id"], state.schema["label"]]).add("code", "string").add("error", "long"))


def fit_codes(vectors: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error of each row that integer_vectors keeps; the final codebooks, parts x entries x width).

    Codebooks start as the parts of the `entries` smallest vec_ids (null last, then by vector), fewer if there are fewer rows;
    equal entries may stand in them, the first is then the nearest. Repeated rows stay; an empty table gives an empty one and
    codebooks of no entries. Vectors of different lengths, of a length that isn't a multiple of parts or with numbers too large for exact
    64-bit sums are an error.
    """
    rows = integer_vectors(vectors, scale)
    size = F.size("v")
    seen = rows.agg(F.count("*").alias("n"), F.min(size).alias("low"), F.max(size).alias("high"), F.max(F.array_max(F.transform("v", F.abs))).alias("widest")).first()
    if not seen.n:
        return rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), np.zeros((parts, 0, 0), np.int64)
    if seen.low != seen.high or seen.low % parts:
        raise ValueError(f"vectors of {seen.low} to {seen.high} numbers can't be cut into {parts} equal parts")
    if 4 * seen.widest * seen.widest * seen.low >= 1 << 62 or seen.widest >= 1 << 31 or entries > MOST:
        raise ValueError("numbers or codebooks are too large")
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()
    books = np.array([r.v for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2)
    state, path, old = *table_at(bounded(rows, books, None), "codes-state"), books
    for _ in range(rounds):
        books, old = renewed(state, books), books
        new, its_path = table_at(bounded(state, books, old), "codes-state")
        dropped(state.sparkSession, path)
        state, path = new, its_path
    out, _ = table_at(coded(state, books), "codes")
    dropped(state.sparkSession, path)
    return out, books


def codebooks_text(books: np.ndarray) -> str:
    """All entries' numbers by part, entry and position, joined by commas."""
    return ",".join(map(str, books.ravel().tolist()))


def compress(vectors: DataFrame, **how) -> DataFrame:
    """vec_id, code, error, label_error (the sum of errors over equal labels, nulls together), label, codebooks_sha256.
    See fit_codes for nulls, ties, repeated rows and empty tables; other columns of vectors are ignored, whatever their names."""
    codes, books = fit_codes(vectors, **how)
    sums = codes.groupBy("label").agg(F.sum("error").alias("label_error")).select(F.col("label").alias("_label"), "label_error")
    if sums.count() <= LABELS:
        both = codes.join(F.broadcast(sums), codes["label"].eqNullSafe(sums["_label"]))
    else:  # a label may hold most rows: its rows go to several tasks
        salt = F.pmod(F.xxhash64("vec_id", "code"), F.lit(64))
        left, right = codes.withColumn("_salt", salt), sums.withColumn("_salt", F.explode(F.expr("sequence(0L, 63L)")))
        both = left.join(right, (left["_salt"] == right["_salt"]) & left["label"].eqNullSafe(right["_label"]))
    digest = hashlib.sha256(codebooks_text(books).encode()).hexdigest()
    return both.select("vec_id", "code", "error", "label_error", "label", F.lit(digest).alias("codebooks_sha256"))
