"""The stages in order, each on what the one before kept and against brute force, and the registered queries."""

import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import public_tokenizers
import pytest
from llm_helpers import clashing, empty_docs, odd_docs, odd_rows, prose

from obsmat.llm import mixing
from obsmat.llm import queries as q
from obsmat.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_on_odd_rows(spark):
    docs = clashing(odd_docs(spark))
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = table(stage(spark, docs, None), "stage")
        assert docs.columns == columns, name
        assert name == "mix" or docs.count() <= before, name
        before = docs.count()
    kept = {r.doc_id for r in docs.collect()}
    assert kept and not {2, 4, 5, 6, 7, 9, 13, 14} & kept
    assert corpus_pipeline.STAGES[-1][1](spark, docs, None).count() > 0


@pytest.mark.parametrize("n", range(5))
def test_stages_on_nothing(spark, n):
    assert corpus_pipeline.STAGES[n][1](spark, empty_docs(spark), None).count() == 0


def base_fails(text):
    w, at = WORD.findall(text or ""), defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i : i + 5])].append(i)
    again = {p + k for v in at.values() if len(v) > 1 for p in v for k in range(5)}
    return len(w) < 10 or 100 * len(again) > 20 * len(w)


def lines_by_hand(rows, max_docs=30, max_percent=5):
    """What the first stage keeps: (doc_id, text)."""
    normal = lambda t: [" ".join(WORD.findall(x)).lower() for x in (t or "").split("\n")]
    whole = lambda t: tuple(x for x in normal(t) if x)
    seen, hosts = defaultdict(set), defaultdict(set)
    for _, t, _, s, _ in rows:
        if whole(t):
            hosts[s or ""].add(whole(t))
        for x in whole(t):
            seen[s or "", x].add(whole(t))
    out = []
    for i, t, _, s, _ in rows:
        gone = [bool(x) and len(seen[s or "", x]) > max(max_docs, max_percent / 100 * len(hosts[s or ""])) for x in normal(t)]
        n = sum(len(x.split()) for x in normal(t))
        lost = sum(len(x.split()) for x, g in zip(normal(t), gone, strict=True) if g) / n if n else 0
        if not base_fails(t) and lost <= 0.5 and n * (1 - lost) >= 10:
            out.append((i, "\n".join(x for x, g in zip(t.split("\n"), gone, strict=True) if not g)))
    return sorted(out, key=str)


def groups_by_hand(rows):
    """What the second stage keeps: the first (doc_id, text) of each group of a Jaccard of 0.8 or more."""
    texts = sorted({r[1] or "" for r in rows})
    w = [t.encode().lower().split() for t in texts]
    sets = [{tuple(x[i : i + 5]) for i in range(max(1, len(x) - 4))} if x else set() for x in w]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(texts)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for i, t, *_ in rows:
        k, key = find(texts.index(t or "")), (i is None, i or 0)
        least[k] = min(least.get(k, key), key)
    return sorted(str(v) for v in least.values())


def without_repeats_by_hand(rows, n=200):
    raw = [(r[1] or "").encode() for r in rows]
    seen = Counter(x[i : i + n] for x in raw for i in range(len(x) - n + 1))
    out = []
    for (i, *_), x in zip(rows, raw, strict=True):
        gone = bytearray(len(x))
        for k in range(len(x) - n + 1):
            if seen[x[k : k + n]] > 1:
                gone[k : k + n] = b"\1" * n
        left = bytes(c for c, g in zip(x, gone, strict=True) if not g).decode(errors="ignore")
        if WORD.search(left):
            out.append((i, left))
    return sorted(out, key=str)


def corpus():
    base = [prose(60, k) for k in range(12)]
    near = " ".join(base[0].split()[:40] + ["changed"] + base[0].split()[41:])
    menu = "home news sport weather and more of all that"
    rows = [(50, base[1] + " " + base[2], "en", "s1"), (51, base[2] + " " + base[3], "en", "s2"), (60, base[0], "en", "s1"), (61, near, "en", "s2"), (62, None, "en", "s1")]
    rows += [(100 + i, f"{menu}\n{prose(30 if i % 3 else 5, 300 + i)}", "en", "h") for i in range(60)]
    return odd_rows() + [(*r, len(r[1] or "")) for r in rows]


def test_lines_stage_by_brute_force(spark):
    got = corpus_pipeline.quality_rules(spark, spark.createDataFrame(corpus(), COLUMNS), None).select("doc_id", "text").collect()
    assert sorted(map(tuple, got), key=str) == lines_by_hand(corpus())


def test_near_stage_by_brute_force(spark):
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(corpus(), COLUMNS), None).collect()
    assert sorted(str((r.doc_id is None, r.doc_id or 0)) for r in got) == groups_by_hand(corpus())
    known = {(r[0], r[1]) for r in corpus()}
    assert all((r.doc_id, r.text) in known for r in got)


def test_repeats_stage_by_brute_force(spark):
    got = corpus_pipeline.repeats(spark, spark.createDataFrame(corpus(), COLUMNS), None).select("doc_id", "text").collect()
    assert sorted(map(tuple, got), key=str) == without_repeats_by_hand(corpus())


def test_mix_stage_by_brute_force(spark):
    """Rows come whole, three times at most, and each source's words are near its target as far as documents allow."""
    rows = [(i, prose(20 + i % 30, i), "en", ("a", "b", None)[i % 3 if i % 7 else 0], 0) for i in range(600)]
    got = corpus_pipeline.mix(spark, spark.createDataFrame(rows, COLUMNS), None).collect()
    known = {r[0]: r for r in rows}
    times = Counter(r.doc_id for r in got)
    assert all(tuple(r)[:4] == known[r.doc_id][:4] for r in got) and max(times.values()) <= 3
    sizes, taken = Counter(), Counter()
    for i, t, _, s, _ in rows:
        sizes[s] += len(t.split())
        taken[s] += times[i] * len(t.split())
    goal = mixing.targets(dict(sizes))
    assert all(abs(taken[s] - goal[s]) <= max(50, 0.002 * goal[s]) for s in goal)


def test_pack_stage_by_brute_force(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    encode = Tokenizer.from_file(path).encode
    rows = [r for r in corpus() if r[0] is not None and r[0] >= 3]
    got = corpus_pipeline.pack(spark, spark.createDataFrame(rows, COLUMNS), None).collect()
    ids = {r[0]: [*encode(r[1] or "", add_special_tokens=False).ids, 1] for r in rows}
    places = defaultdict(list)
    for p in got:
        own = ids[p.doc_id]
        assert p.doc_tokens == len(own) and p.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in own[p.start : p.start + p.length]))
        places[p.sequence_id].append((p.offset, p.length))
    for i, own in ids.items():
        at = sorted((p.start, p.length) for p in got if p.doc_id == i)
        assert [s for s, _ in at] == [sum(n for _, n in at[:k]) for k in range(len(at))] and sum(n for _, n in at) == len(own)
    for spans in places.values():
        spans.sort()
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))] and sum(n for _, n in spans) <= 2048


def test_one_query_for_each_operator():
    names = list(q.queries())
    assert [n.split("_")[0] for n in names if n != "quality_rules_low_limits"] == [f"op{i}" for i in range(1, 14)] + ["pipeline"]
    assert set(q.oracle_sql()) <= set(names)
