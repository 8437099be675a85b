"""Removal of repeated 200-byte strings against every offset of every text."""

import hashlib

import pytest
from llm_helpers import clashing, empty_docs, odd_docs, odd_rows, prose

from obsmat.llm import suffix_buckets as sb


def by_hand(texts):
    seen = {}
    for raw in texts:
        for i in range(len(raw) - 199):
            s = raw[i : i + 200]
            seen[s] = seen.get(s, 0) + 1
    out = []
    for raw in texts:
        gone = bytearray(len(raw))
        for i in range(len(raw) - 199):
            if seen[raw[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def cases():
    a, b, c = prose(90, 11), prose(60, 12), prose(40, 13)
    near = [a[:k] + "#" + a[k:] for k in range(0, len(a), 23)]
    texts = [a, b + c, c + b, b[30:330], b[31:231], b[500:699], "ab" * 400, "ab" * 101, "ab" * 99 + "a", b + "ü" * 150 + c, *near, prose(50, 14) * 2]
    return [(1000 + i, t, "en", "s", len(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("block", [1 << 18, 300])
def test_every_offset(spark, block):
    rows = odd_rows() + cases()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sb.digests(clashing(df), bits=16, block=block).collect()
    want = [(r[0], *d) for r, d in zip(rows, by_hand([(r[1] or "").encode() for r in rows]), strict=True)]
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)


def test_a_full_bitmap_changes_nothing(spark):
    df = spark.createDataFrame(cases(), "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(map(tuple, sb.digests(df, bits=6).collect())) == sorted(map(tuple, sb.digests(df).collect()))


def test_blocks_of_any_size_agree():
    texts = [t[1].encode() for t in cases()]
    for size in (250, 1000, 1 << 18):
        found = set()
        for x in sb.blocks(texts, size):
            for i, lo, hi in zip(x.text[x.piece], x.lo + x.shift[x.piece], x.hi + x.shift[x.piece], strict=True):
                found |= {(int(i), s) for s in range(lo, hi + 1)}
        assert found == {(i, s) for i, t in enumerate(texts) for s in range(len(t) - 199)}


def test_stage_keeps_columns(spark):
    df = clashing(odd_docs(spark))
    out = sb.without_repeats(df)
    assert out.columns == df.columns and out.count() == len(odd_rows())
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[8] == "" and texts[15] == prose(3, 4) and texts[4] is None
    assert sb.without_repeats(empty_docs(spark)).count() == 0 and sb.digests(empty_docs(spark)).count() == 0
