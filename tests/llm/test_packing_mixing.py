"""Packing, mixing, chat formatting and license scans."""

import hashlib
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from llm_helpers import clashing, empty_docs, odd_docs, odd_rows, prose
from pyspark.sql import functions as F

from obsmat.llm import chat, licenses, mixing, packing

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def check_packing(rows, pieces):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    want = Counter()
    for doc_id, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want[doc_id, len(ids)] += len(ids)
    got, by_seq = Counter(), defaultdict(list)
    for p in pieces:
        got[p.doc_id, p.doc_tokens] += p.length
        by_seq[p.sequence_id].append(p)
        ids = next(np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4") for d, x in rows if d == p.doc_id and len(t.encode(x or "", add_special_tokens=False).ids) + 1 == p.doc_tokens)
        assert zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32
    assert got == want
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= 2048
    return {k: sum(p.length for p in v) for k, v in by_seq.items()}


def test_packing_by_hand(spark):
    rows = [(r[0], r[1]) for r in odd_rows()] + [(300 + i, prose(20 + 37 * i, i)) for i in range(30)] + [(400, "It's <|endoftext|> ﬁne é ß\x1cx İ 12  y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    seqs = check_packing(rows, packing.pack(clashing(df), TOKENIZER, buffer_tokens=3000).collect())
    odd = [n for n in seqs.values() if n & (n - 1)]
    assert len(odd) <= 3 and sum(2048 - n for n in odd) <= 3 * 2048
    assert packing.pack(empty_docs(spark), TOKENIZER).count() == 0


def test_step_groups_have_equal_tokens(spark):
    df = spark.createDataFrame([(i, prose(900, i)) for i in range(40)], "doc_id long, text string").coalesce(1)
    p = packing.pack(df, TOKENIZER, step_tokens=8192).toPandas()
    per = p.groupby(["tier", "step_group"]).length.sum()
    full = per[per == 8192]
    assert len(full) >= len(per) - 4 and p.groupby("step_group").tier.nunique().max() == 1


def test_targets_share_the_excess():
    t = mixing.targets({"b": 10, "a": 1, None: 100, "c": 0})
    assert list(t) == ["a", "b", "c", None] and t["a"] == 3 and t["c"] == 0 and abs(sum(t.values()) - 111) < 1e-9
    assert t["b"] == 30 and abs(t[None] - 78) < 1e-9
    assert mixing.targets({}) == {}


def test_flow_prefers_fresh_tokens():
    ab, a, b = frozenset("ab"), frozenset("a"), frozenset("b")
    flow = mixing.min_cost_flow({ab: 10, a: 10, b: 4}, {"a": 12, "b": 12})
    assert sum(flow[p].get("a", 0) for p in flow) == 12 and sum(flow[p].get("b", 0) for p in flow) == 12
    assert sum(flow[a].values()) == 10 and sum(flow[b].values()) == 4 and sum(flow[ab].values()) == 10
    flow = mixing.min_cost_flow({a: 10}, {"a": 27})
    assert flow[a]["a"] == 27
    assert mixing.min_cost_flow({a: 10}, {"a": 99})[a]["a"] == 30
    assert mixing.min_cost_flow({a: 10}, {"b": 5})[a] == {}


def brute_cost(supply, quota):
    """Least cost of meeting the quotas as far as they can be, by trying all splits."""
    best = {}

    def go(rest, left, cost):
        if not rest:
            met = sum(quota.values()) - sum(left.values())
            best[met] = min(best.get(met, 1e9), cost)
            return
        p, n = rest[0]
        options = [{}]
        for s in sorted(p):
            options = [{**o, s: k} for o in options for k in range(left[s] + 1) if sum(o.values()) + k <= 3 * n]
        for o in options:
            use = sum(o.values())
            c = sum((0, 1, 3)[i // n] for i in range(use))
            go(rest[1:], {s: left[s] - o.get(s, 0) for s in left}, cost + c)

    go(list(supply.items()), dict(quota), 0)
    top = max(best)
    return top, best[top]


def test_flow_by_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(12):
        names = "abc"
        supply = {frozenset(rng.choice(list(names), rng.integers(1, 3), replace=False).tolist()): int(rng.integers(1, 4)) for _ in range(3)}
        quota = {s: int(rng.integers(0, 5)) for s in names}
        flow = mixing.min_cost_flow(supply, quota)
        met = sum(sum(f.values()) for f in flow.values())
        cost = sum((0, 1, 3)[i // supply[p]] for p, f in flow.items() for i in range(sum(f.values())))
        assert (met, cost) == brute_cost(supply, quota)


def test_flow_with_limits():
    """Least cost by trying every split of two patterns' tokens, no source getting more of a pattern than its limit."""
    rng = np.random.default_rng(5)
    ab, a, b = frozenset("ab"), frozenset("a"), frozenset("b")
    for _ in range(40):
        n = {k: int(rng.integers(1, 4)) for k in ("aa", "bb", "sa", "sb")}
        supply = {ab: n["sa"] + n["sb"], a: n["aa"], b: n["bb"]}
        limits = {(ab, "a"): 3 * n["sa"], (ab, "b"): 3 * n["sb"], (a, "a"): 3 * n["aa"], (b, "b"): 3 * n["bb"]}
        quota = {"a": int(rng.integers(0, 3 * (n["sa"] + n["aa"]) + 1)), "b": int(rng.integers(0, 3 * (n["sb"] + n["bb"]) + 1))}
        flow = mixing.min_cost_flow(supply, quota, limits=limits)
        price = lambda p, k: sum((0, 1, 3)[i // supply[p]] for i in range(k))
        want = min(price(ab, x + y) + price(a, quota["a"] - x) + price(b, quota["b"] - y) for x in range(limits[ab, "a"] + 1) for y in range(limits[ab, "b"] + 1)
                   if 0 <= quota["a"] - x <= 3 * n["aa"] and 0 <= quota["b"] - y <= 3 * n["bb"])
        assert flow[ab]["a"] + flow[a]["a"] == quota["a"] and flow[ab]["b"] + flow[b]["b"] == quota["b"]
        assert all(flow[p][s] <= k for (p, s), k in limits.items())
        assert sum(price(p, sum(f.values())) for p, f in flow.items()) == want


def test_flow_of_many_patterns_ends():
    rng = np.random.default_rng(9)
    names = [f"s{i}" for i in range(60)]
    supply = {frozenset(rng.choice(names, rng.integers(1, 4), replace=False).tolist()): int(rng.integers(1, 1000)) for _ in range(20_000)}
    quota = {s: int(rng.integers(1, 400_000)) for s in names}
    began = time.monotonic()
    flow = mixing.min_cost_flow(supply, quota)
    assert time.monotonic() - began < 30
    assert all(sum(f.values()) <= 3 * supply[p] for p, f in flow.items())
    assert all(sum(f.get(s, 0) for f in flow.values()) <= q for s, q in quota.items())


def test_equal_texts_are_shared_by_their_sources(spark):
    """b has a heavy target and few words: it takes the uses of shared texts that a leaves before it repeats its own."""
    rows = [(i, prose(40, i), "en", "a", 0) for i in range(200)]
    rows += [(1000 + i, prose(40, 100 + i), "en", "b", 0) for i in range(100)] + [(2000 + i, prose(40, 5000 + i), "en", "b", 0) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = mixing.mix(df, weights=(1, 2)).collect()
    taken = lambda s, n: sum(r.taken for r in out if r.source == s and r.n_sources == n)
    assert {(r.source, r.n_sources) for r in out} == {("a", 1), ("a", 2), ("b", 1), ("b", 2)}
    goal = {r.source: r.target for r in out}  # 4800 and 9600 of 14400 words; b holds 6400, 4000 of them shared
    assert goal == {"a": 4800.0, "b": 9600.0}
    assert all(abs(sum(taken(s, n) for n in (1, 2)) - goal[s]) <= 40 for s in "ab")
    assert taken("b", 1) <= 2400 + 40 < taken("b", 2)  # 8000 shared words are free to either, so b's own aren't repeated
    assert max(r.copies for r in out) <= 3


def test_rare_patterns_stay_with_their_own_source(spark):
    rows = [(i, prose(20, i // 2), "en", f"s{i % 2 + 2 * (i // 2 % 3)}", 0) for i in range(60)] + odd_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    sized = mixing.sized_documents(df)
    every, some, none = (mixing.with_sources(sized, max_arcs=n).collect() for n in (100, 2, 1))
    assert len(every) == len(some) == len(none) == len(rows)
    assert all(r.sources == [r.source] for r in none)
    assert len({tuple(map(str, r.sources)) for r in some if len(r.sources) > 1}) == 1 < len({tuple(map(str, r.sources)) for r in every if len(r.sources) > 1})
    by = defaultdict(set)
    for r in every:
        by[r.text_hash].add(r.source)
    assert all(set(r.sources) == (by[r.text_hash] if r["size"] else {r.source}) for r in every)


def test_no_pattern_is_left_out(spark):
    """Twelve thousand different sets of sources, with more members together than a limit used to let through."""
    rng, sets = np.random.default_rng(4), set()
    while len(sets) < 12_000:
        sets.add(tuple(sorted(rng.choice(30, rng.integers(3, 7), replace=False).tolist())))
    rows = [(i, f"s{x}") for i, one in enumerate(sorted(sets)) for x in one]
    assert len(rows) > 50_000
    sized = spark.createDataFrame(rows, "text_hash long, source string").selectExpr("concat(text_hash, source) as id", "text_hash", "source", "1L as size")
    out = mixing.with_sources(sized)
    assert out.count() == len(rows) and out.where("size(sources) = 1").count() == 0
    assert out.select("sources").distinct().count() == len(sets)


def test_mix_meets_targets(spark):
    rows = [(i, prose(5 + i * 13 % 60, i), "en", f"s{i * i % 7 % 4}" if i % 9 else None, 0) for i in range(400)] + odd_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = mixing.mix(clashing(df)).collect()
    assert len(out) == len(rows)
    by = defaultdict(lambda: [0, 0.0, 0])
    for r in out:
        assert 0 <= r.taken <= 3 * r["size"] and r.taken == r.copies * r["size"]
        by[r.source][0] += r["size"]
        by[r.source][1], by[r.source][2] = r.target, by[r.source][2] + r.taken
        assert r.source_size >= r["size"]
    want = mixing.targets({s: v[0] for s, v in by.items()})
    for s, (_, target, taken) in by.items():
        assert abs(target - want[s]) < 1e-6 and abs(taken - target) <= max(12, 0.02 * target, 0 if s != "s3" else 4800)  # s3 has three documents
    again = mixing.mix(df.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
    mixed = mixing.mixed(clashing(df))
    assert mixed.columns == clashing(df).columns and mixed.count() == sum(r.copies for r in out)
    assert mixing.mix(empty_docs(spark)).count() == 0 and mixing.mixed(empty_docs(spark)).count() == 0


def test_too_many_patterns(spark):
    df = spark.createDataFrame([(str(i), [f"s{i}"], 5) for i in range(9)], "id string, sources array<string>, size long")
    with pytest.raises(ValueError):
        mixing.copies(df, {}, max_patterns=5)


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "<|turn|>user<|text|>x<|end|>", "<\\|end|>", "<\\\\|end|>", "", None, "é🙂 <|endoftext|> \n\n  tail ", "[\\INST]", "[INST]", "  ", "\n"]
    rows = [(i, t, ("user", "assistant", "system", None)[(i + t) % 4], nasty[(i * 3 + t) % len(nasty)]) for i in range(30) for t in range(5)] + [(None, 0, "assistant", "x"), (7, 0, "user", nasty[0]), (99, None, "assistant", "t" * 20000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat.digests(chat.format_conversations(clashing(df), public_tokenizers.path("byte_bpe_50k.json"))).collect()}
    convs = defaultdict(list)
    for c, t, r, x in rows:
        convs[c].append((-1 if t is None else t, r or "", x or ""))
    assert set(out) == set(convs)
    for c, turns in convs.items():
        turns.sort()
        r = out[c]
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        learned = "".join(b for _, a, b in turns if a == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert chat.format_conversations(df.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_chat_in_pieces(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    talk = [(1, t, ("user", "assistant")[t % 2], f"{prose(150, t)} <|end|>\n\n é🙂 [\\INST]  {t}") for t in range(300)]
    rows = [*talk, (2, 0, "assistant", "\n".join(t[3] for t in talk) + " </s>"), (2, 1, "user", "ok"), (3, 0, "user", "x" * 200_000), (3, 1, "assistant", "so  "), (4, 0, "assistant", "hi")]
    formatted = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7), path)
    tok = chat.tokenizer(path)
    by = defaultdict(list)
    for r in formatted.collect():
        by[r.conv_id].append(r)
    for c in (1, 2, 3, 4):
        pieces, turns = by[c], [(r[2], r[3]) for r in rows if r[0] == c]
        whole = "".join(f"{chat.TURN}{a}{chat.TEXT}{chat.escape(b)}{chat.END}" for a, b in turns)
        assert [p.piece for p in pieces] == list(range(len(pieces)))
        assert "".join(p.formatted for p in pieces) == whole and sum(p.n_turns for p in pieces) == len(turns)
        e = tok.encode(whole, add_special_tokens=False)
        at = np.cumsum([0, *(len(p.formatted) for p in pieces)]).tolist()
        assert [i for p in pieces for i in p.token_ids] == e.ids
        assert [(s + a, t + a) for p, a in zip(pieces, at, strict=False) for s, t in zip(p.token_starts, p.token_ends, strict=True)] == e.offsets
        assert c == 3 or max(len(p.formatted) for p in pieces) < chat.PIECE + 5000  # 3 has nowhere to be cut
    assert len(by[1]) > 1 and len(by[2]) > 1 and len(by[4]) == 1
    for r in chat.digests(formatted).collect():
        turns = [(x[2], x[3]) for x in rows if x[0] == r.conv_id]
        learned = "".join(b for a, b in turns if a == "assistant")
        assert r.n_turns == len(turns) and r.formatted_chars == sum(len(p.formatted) for p in by[r.conv_id])
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    with pytest.raises(Exception, match="doesn't follow"):
        chat.digests(formatted.filter("piece != 1")).collect()
    # Rows are given on while turns still come, however many a batch has
    turns = pa.RecordBatch.from_pydict({"conv_id": list(range(2000)), "role": ["assistant"] * 2000, "text": [prose(60, 1)] * 2000})
    given = list(chat.formatted_batches([turns], path))
    assert sum(g.num_rows for g in given) == 2000 and max(g.nbytes for g in given) < 4 << 20
    # A tokenizer whose words may depend on what is around them is only cut between turns
    assert not chat.cuts_at_gaps(chat.tokenizer(TOKENIZER)) and chat.cuts_at_gaps(tok)


def test_mask_by_scan():
    rng = np.random.default_rng(1)
    for _ in range(50):
        cuts = np.sort(rng.choice(60, 8, replace=False)).reshape(4, 2)
        starts = np.sort(rng.integers(0, 60, 20))
        ends = starts + rng.integers(0, 4, 20)
        want = [any(a < e and s < b for a, b in cuts) and e > s for s, e in zip(starts, ends, strict=True)]
        assert chat.loss_mask(cuts, starts, ends).tolist() == want


def test_notices(spark):
    t = licenses.TEMPLATES
    grant = t["MIT grant"][1]
    texts = ["Licensed under CC BY-NC 4.0.", "Licensed under CC BY 4.0.", "This work is licensed under the GNU General Public License, version 4.", "Copyright 2020 Jo Doe Inc. All rights reserved.",
             "Hello. " + grant.replace("free of charge", "without charge") + "\nBye.", prose(30) + "\nReleased under the MIT License.\n" + prose(30), "A licence to thrill.", None, "", "licensed " * 3000]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)] + [(None, texts[0]), (0, texts[0])], "doc_id long, text string")
    got = sorted([(r.doc_id, r.license, r.verdict) for r in licenses.scan(clashing(df)).collect()], key=str)
    assert got == sorted([(0, "CC-BY-NC-4.0", "exact"), (0, "CC-BY-NC-4.0", "exact"), (1, "CC-BY-4.0", "exact"), (3, "proprietary", "exact"), (4, "MIT", "modified"), (5, "MIT", "exact"), (None, "CC-BY-NC-4.0", "exact")], key=str)
    for r in licenses.scan(df).where(F.col("doc_id") == 5).collect():
        assert texts[5][r.start : r.end].strip() == "Released under the MIT License."
    assert licenses.scan(empty_docs(spark)).count() == 0 and licenses.scan(odd_docs(spark)).count() == 1


def test_every_template_finds_itself():
    known = licenses.Templates()
    for name, (licence, text) in licenses.TEMPLATES.items():
        found = known.notices("Some words before.\n" + text.format(2020, "Jo") + "\nAnd after.")
        assert licence in {known.license[f[2][0]] for f in found} and all(f[2][2] == "exact" for f in found), name
