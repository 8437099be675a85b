"""The language model: exact base score, a proper distribution, a plain model of the same counts, gains on held-out text."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
from llm_helpers import WORDS, clashing, empty_docs, odd_rows, prose

from obsmat.llm import context_mixing as cm


def lower(t):
    return (t or "").encode().lower().split()


def learn(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2


def test_scores_by_hand(spark):
    plain = [(1000 + i, " ".join(WORDS[(i * 31 + k * (i % 5 + 1)) % len(WORDS)] for k in range(60)).replace("fox", "Fox\n"), "en", "s", 0) for i in range(120)]
    rows = odd_rows() + plain
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = cm.scores(clashing(df), dictionary=40).collect()
    assert len(out) == len(rows)
    count, ends = Counter(), 0
    for i, t, *_ in rows:
        if learn(i):
            count.update(lower(t))
            ends += 1
    n, v = sum(count.values()) + ends, len(count) + 1
    want = sorted(((i, not learn(i), len(lower(t)) + 1, sum(count[w] > 0 for w in lower(t)) + 1, n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in lower(t)) + math.log10((ends + 1) / (n + v + 1)), 6)) for i, t, *_ in rows), key=str)
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out), key=str) == want
    held = [r for r in out if r.held_out and r.doc_id and r.doc_id >= 1000]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(r.score < 0 and math.isfinite(r.score) for r in out)
    sizes = {i: len((t or "").encode()) for i, t, *_ in rows if i is not None}
    assert all(abs(r.bits_per_byte + r.score / math.log10(2) / sizes[r.doc_id]) < 1e-9 if sizes[r.doc_id] else r.bits_per_byte is None for r in out if r.doc_id is not None)
    by_text = {}
    for r in out:
        by_text.setdefault(r.doc_id, set()).add(round(r.score, 6))
    assert len(by_text[1]) == 1  # rows with one text score alike


def test_scores_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(i, prose(40, i % 40)) for i in range(60)], "doc_id long, text string")
    a, b = ({r.doc_id: round(r.score, 4) for r in cm.scores(d, shard_tokens=100).collect()} for d in (df.coalesce(1), df.repartition(5)))
    assert a == b


def test_nothing_to_learn_from(spark):
    assert cm.scores(empty_docs(spark)).count() == 0
    only_held = [i for i in range(100) if not cm.training(i)][:3]
    out = cm.scores(spark.createDataFrame([(i, "some words") for i in only_held], "doc_id long, text string")).collect()
    assert len(out) == 3 and all(r.n_known == 0 and math.isfinite(r.score) for r in out)


def small_model(texts, coded):
    """(vocabulary, tables) of training texts: the arrays that the operator makes."""
    count = Counter(w for t in texts for w in lower(t))
    words = [w for w, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))]
    c = [count[w] for w in words]
    code = cm.Code.from_counts(np.array(c[:coded]), sum(c[coded:]), len(texts), list(zip(words[coded:], c[coded:], strict=True)))
    v = cm.Vocabulary({w: i for i, w in enumerate(words)}, code, np.array([*map(zlib.crc32, words), 0], np.uint64), np.array([*map(cm.ending, words), 0]), np.zeros(len(words) + 1))
    t = as_text(texts, v)
    tables = [np.zeros(2 << b, np.uint32) for b in cm.BITS]
    _, bit, valid, slots = cm.path_slots(t, np.arange(len(t.ids)), code)
    for k, s in enumerate(slots):
        np.add.at(tables[k], (s[valid].astype(np.int64) << 1) + bit[valid], 1)
    _, bit, slots = cm.byte_slots(t.words, code)
    for k, s in enumerate(slots):
        np.add.at(tables[k + 3], (s.astype(np.int64) << 1) + bit, 1)
    return v, [cm.packed(x.reshape(-1, 2)) for x in tables]


def as_text(texts, v):
    ids, sizes, spelled = [], [], []
    for t in texts:
        own = [v.words.get(w, v.size) for w in lower(t)]
        spelled += [w for w, i in zip(lower(t), own, strict=True) if i >= v.code.n]
        ids += [*own, cm.ENDED]
        sizes.append(len(own) + 1)
    return cm.Text(np.array(ids), np.array(sizes), b" ".join(spelled), v)


def known(n):
    return sum(n >= k for k in (1, 2, 4, 8, 32, 256, 4096))


def mixed(w, gate, x, bit):
    z = sum(a * b for a, b in zip(w[:5, gate], x, strict=True)) + w[5, gate]
    return -math.log2(1 + math.exp((1 - 2 * bit) * z))


def plain_scores(train, texts, v, w):
    """The same model with dictionaries of counts, a decision at a time, without learning inside documents."""
    code, counts, spelled_counts = v.code, defaultdict(Counter), defaultdict(Counter)
    symbol = lambda x: min(v.words.get(x, code.n), code.n)
    own = lambda x: ("w", x) if symbol(x) < code.n else ("e", x[-2:])

    def contexts(seq, i):
        at = lambda k: seq[i - k] if i >= k else None
        kind = lambda x: x and own(x)
        return [("1", kind(at(1))), ("2", kind(at(2))), ("b", (at(1) or b"\0\0\0")[-2:], (at(2) or b"\0\0\0")[-2:], at(1) is None, at(2) is None)]

    def path(s):
        head, n = int(code.head[s]), int(code.length[s])
        return [((1 << d) - 1 + (head >> (cm.DEPTH - d)), head >> (cm.DEPTH - 1 - d) & 1, d) for d in range(n)]

    def byte_steps(word):
        raw = word + b" "
        for i, c in enumerate(raw):
            for k in range(int(code.byte_length[c])):
                at = int(code.byte_at[c]) + k
                yield [(span, raw[max(0, i - span) : i], int(code.byte_nodes[at])) for span in (3, 5)], int(code.byte_bits[at])

    follow = defaultdict(Counter)
    for t in train:
        seq = lower(t)
        for i, x in enumerate([*seq, None]):
            for n, b, _ in path(code.n + 1 if x is None else symbol(x)):
                for c in contexts(seq, i):
                    counts[c, n][b] += 1
            if x is not None and symbol(x) == code.n:
                for cs, b in byte_steps(x):
                    for c in cs:
                        spelled_counts[c][b] += 1
            if i >= 3:
                follow[tuple(seq[i - 3 : i])][x] += 1
    odds = lambda c: float(np.rint(cm.logit(c[1], c[0]) * cm.SCALE)) / cm.SCALE
    cls = [0, 0, 1, 1, 2, 2, 3, 3]
    out = []
    for t in texts:
        seq, total, run, matches = lower(t), 0.0, 0, Counter()
        history, taken, ready = [], Counter(), {}
        for i, x in enumerate([*seq, None]):
            if i in {a for a, _ in cm.rounds(10**6 if i > 4096 else 5000)}:
                ready = {"own": {n: (c[0], c[1]) for n, c in taken_by_node(history).items()}, "hits": (matches[0], matches[1])}
            after = follow.get(tuple(seq[i - 3 : i])) if i >= 3 else None
            hit = False
            if after:
                most = max(after.values())
                first = min((s for s, n in after.items() if n == most), key=lambda s: next_hash(s))
                hit, all_ = first == x, sum(after.values())
                k = sum(most >= n for n in (2, 3, 6, 20)) * 3 + (2 if most == all_ else int(2 * most >= all_))
                gate = cm.PATHS + k * 4 + sum(run >= n for n in (1, 2, 4))
                total += mixed(w, gate, [float(cm._MATCH_ODDS[k]), 0, 0, 0, float(cm.logit(ready["hits"][1], ready["hits"][0]))], int(hit))
                matches[int(hit)] += 1
            run = run + 1 if hit else 0
            if hit:
                continue
            s = code.n + 1 if x is None else symbol(x)
            total += float(code.tail[s])
            for n, b, d in path(s):
                c = [counts[c, n] for c in contexts(seq, i)]
                mine = ready["own"].get(n, (0, 0))
                gate = d * 4 + cls[known(sum(c[0].values()))]
                total += mixed(w, gate, [float(code.odds[n]), *map(odds, c), float(cm.logit(mine[1], mine[0]))], b)
                history.append((n, b))
            if s == code.n:
                for cs, b in byte_steps(x):
                    c = [spelled_counts[c] for c in cs]
                    total += mixed(w, cm.OWN + cls[known(sum(c[0].values()))] * 4 + cls[known(sum(c[1].values()))], [*map(odds, c), 0, 0, 0], b)
        out.append(total)
    return out


def taken_by_node(history):
    out = defaultdict(Counter)
    for n, b in history:
        out[n][b] += 1
    return out


def next_hash(word):
    """Ties of successors go to the least hash, as the operator has it."""
    h = 1 if word is None else zlib.crc32(word) * int(cm._M3) % 2**64
    return (h * int(cm._M2) % 2**64) >> (64 - int(cm.NEXT))


def test_a_plain_model_of_the_same_counts_scores_alike(monkeypatch):
    monkeypatch.setattr(cm, "BITS", (23, 23, 23, 22, 22))  # and few texts, so that no two contexts share slots; no Spark here
    train = [" ".join(WORDS[(i * 7 + k * k * (i % 3 + 1)) % len(WORDS)] + ("x" * (k % 9 == 0)) for k in range(50 + i)) for i in range(8)] + ["one lazy dog while seven small birds sing of rain"] * 3
    texts = [*train[:3], "one lazy dog while seven small birds sing of wind", "never seen ωords", "", " ".join(train[4:7])]
    v, tables = small_model(train, 15)
    rng = np.random.default_rng(3)
    w = (cm.first_weights() + rng.normal(0, 0.05, (cm.INPUTS, cm.GATES))).astype(np.float32)
    w[1:5, cm.PATHS : cm.OWN], w[2:5, cm.OWN :] = np.where(np.arange(1, 5)[:, None] == 4, w[1:5, cm.PATHS : cm.OWN], 0), 0
    t, learned = as_text(texts, v), as_text(train, v)
    (_, x, which), (_, y, own) = t.places(0), learned.places(0)
    counts = np.concatenate([np.zeros(len(x), int), np.bincount(own, minlength=len(y))])
    match = np.zeros(len(t.ids), np.uint8)
    match[t.whole] = cm.answers(np.concatenate([x, y]), counts)[0][: len(x)][which]
    got = cm.Model(v.code, tables, w, rate=0.0, fix_rate=0.0).documents(t, match)
    assert np.allclose(got, plain_scores(train, texts, v, w), rtol=1e-4, atol=1e-3)


def test_probabilities_of_all_texts_sum_to_one():
    """All sequences over coded words, a few steps long: the ends' mass grows with length, and stays below one."""
    v, tables = small_model(["a b a", "a a b a b", "b", "a b a c"], 2)
    model, sums = cm.Model(v.code, tables, cm.first_weights()), []
    for depth in range(6):
        texts = [""]
        for _ in range(depth):
            texts = [f"{t} {w}" for t in texts for w in "ab"]
        t = as_text(texts, v)
        sums.append(float((2 ** model.documents(t, np.zeros(len(t.ids), np.uint8))).sum()))
    assert all(s > 0 for s in sums) and sum(sums) < 1
    one = as_text(["a", "b", ""], v)  # the first decision's outcomes: two words, the escape, the end
    assert (2 ** model.documents(one, np.zeros(len(one.ids), np.uint8))).sum() < 1


def test_answers_against_dictionaries():
    rng = np.random.default_rng(5)
    keys, following, n = rng.integers(0, 40, 3000), rng.integers(0, 6, 3000), rng.integers(0, 3, 3000)
    values = keys.astype(np.uint64) << cm.NEXT | following.astype(np.uint64)
    got, none = cm.answers(values, n, 0 * n)
    assert not none.any()
    seen = defaultdict(Counter)
    for k, f, c in zip(keys.tolist(), following.tolist(), n.tolist(), strict=True):
        seen[k][f] += c
    for k, f, g in zip(keys.tolist(), following.tolist(), got.tolist(), strict=True):
        all_, most = sum(seen[k].values()), max(seen[k].values())
        assert (g == 0) == (all_ == 0)
        if g:
            assert (g & 1 == 0) == (f == min(x for x in seen[k] if seen[k][x] == most))
    assert len(cm.answers(np.zeros(0, np.uint64), np.zeros(0, np.int64))[0]) == 0


def test_places_name_equal_contexts_alike():
    v, _ = small_model(["a b c d e", "x a b c d"], 9)
    t = as_text(["a b c d", "q a b c d", "b c d"], v)
    for shards in (0, 3, 18):
        s, x, which = t.places(shards)
        at = np.flatnonzero(t.whole)
        name = {int(i): (int(s[k]), int(x[k])) for i, k in zip(at, which, strict=True)}
        assert name[3] == name[5 + 4] and len(set(name.values())) == len(name) - 3  # d after a b c; the end after b c d
        assert (np.diff(s.astype(int)) >= 0).all()


def test_code_reaches_every_symbol():
    code = cm.Code.from_counts(np.array([5, 4, 3]), 2, 1, [(b"xyz", 2)])
    total = sum(2.0 ** (float(t) - int(n)) for t, n in zip(code.tail, code.length, strict=True))
    assert abs(total - 1) < 1e-9
    assert abs(sum(2.0 ** -int(n) for n in code.byte_length) - 1) < 1e-9 and code.byte_length.max() <= 20
    big = cm.Code.from_counts(np.array([2**k for k in range(30, 0, -1)]), 1, 1, [])
    assert big.length.max() == cm.DEPTH and (big.tail <= 0).all()


def test_newton_finds_the_weights():
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (5, 20000)).astype(np.float32)
    gate = rng.integers(0, 2, 20000)
    z = np.where(gate == 0, 2 * x[0] - x[3], x[4] + 0.5)
    bit = (rng.random(20000) < 1 / (1 + np.exp(-z))).astype(int)
    w = cm.first_weights()
    for _ in range(8):
        s = cm.Sums()
        s.add(gate, list(x), sum(w[k].take(gate) * x[k] for k in range(5)) + w[5].take(gate), bit)
        w = s.step(w, ridge=1e-3)
    assert np.allclose(w[:, 0], [2, 0, 0, -1, 0, 0], atol=0.15) and np.allclose(w[:, 1], [0, 0, 0, 0, 1, 0.5], atol=0.15)


def test_learning_inside_documents_helps():
    """A long document whose words are not those of the corpus."""
    v, tables = small_model([prose(200, i) for i in range(20)], 60)
    word = prose(1, 3)
    t = as_text([" ".join([word, word[::-1]] * 800)], v)
    none = np.zeros(len(t.ids), np.uint8)
    still, learns = (cm.Model(v.code, tables, cm.first_weights(), rate=r, fix_rate=r).documents(t, none)[0] for r in (0.0, 0.03))
    assert learns > still


def test_deeper_decisions_are_mixed_too():
    """Words of long paths that the word before tells: by their frequencies alone each costs its whole code word."""
    rng = np.random.default_rng(7)
    follower = rng.permutation(600)
    pairs = lambda picks: " ".join(f"a{i} b{follower[i]}" for i in picks)
    train = [pairs(rng.integers(0, 600, 40)) for _ in range(300)]
    v, tables = small_model(train, 1200)
    learned = as_text(train, v)
    counts = [np.zeros(2 << b, np.uint32) for b in cm.BITS]
    _, bit, valid, slots = cm.path_slots(learned, np.arange(len(learned.ids)), v.code)
    for k, s in enumerate(slots):
        np.add.at(counts[k], (s[valid] << 1) + bit[valid], 1)
    _, _, bit, _, _, slots = cm.deep_slots(learned, np.arange(len(learned.ids)), v.code)
    for k, s in zip((0, 2), slots, strict=True):
        np.add.at(counts[k], (s.astype(np.int64) << 1) + bit, 1)
    t = as_text([pairs(rng.integers(0, 600, 40))], v)
    none = np.zeros(len(t.ids), np.uint8)
    tell, still = (cm.Model(v.code, x, cm.first_weights(), rate=0.0, fix_rate=0.0).documents(t, none)[0] for x in ([cm.packed(c.reshape(-1, 2)) for c in counts], tables))
    by_frequency = v.code.tail[t.symbol].sum()
    assert by_frequency < -100 and tell - still > -0.2 * by_frequency  # the same upper tables, the deeper ones empty in `still`


def test_deeper_odds_are_the_frequencies():
    """With the frequency's weight alone a code word's deeper decisions cost what `tail` says."""
    counts = np.sort(np.random.default_rng(3).integers(1, 5000, 900))[::-1]
    code = cm.Code.from_counts(counts, 7, 9, [])
    for s in range(0, len(counts) + 2, 13):
        at = slice(code.deep_at[s], code.deep_at[s] + code.deep_length[s])
        bit, odds = code.deep_marks[at] & 1, code.deep_odds[at] / cm.SCALE
        assert abs(-np.log2(1 + np.exp(-(2.0 * bit - 1) * odds)).sum() - code.tail[s]) < 0.1 + 0.02 * len(bit)
