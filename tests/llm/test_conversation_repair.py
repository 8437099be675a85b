"""Repairs against all sequences of edits on short conversations, and against SQL and plain Python on damaged ones."""

import hashlib
import itertools
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from obsmat.llm import conversation_repair as cr

TURN = st.tuples(st.one_of(st.none(), st.integers(0, 6)), st.sampled_from(["user", "assistant", "system", "tool", " "]), st.sampled_from(["Hi.", "No", "Yes!", " ", "", "a?", "b"]))


def faults(turns):
    seen, out = set(), []
    for _, role, text in turns:
        told = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not told else "duplicate" if (role, text) in seen else "truncated" if told[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def brute(turns):
    """The least (cost, audit) and its lines over all ways to keep, rerole or delete each turn and insert up to two between."""
    told, best = faults(turns), None
    each = []
    for (_, role, text), fault in zip(turns, told, strict=True):
        ways, extra = [(2, "D", None)], 5 if fault == "truncated" else 0
        if fault not in ("blank", "duplicate"):
            ways += [(extra, "K", (role, text)), (1 + extra, "R", ("user", text)), (1 + extra, "R", ("assistant", text))]
        each.append(ways)
    inserts = [(0, "", [])] + [(5 * n, "I" * n, [(r, "") for r in rs]) for n in (1, 2) for rs in itertools.product(("user", "assistant"), repeat=n)]
    for chosen in itertools.product(*each):
        slots = [[x for x in inserts] for _ in range(len(turns) + 1)]
        # insertions only where the grammar needs them: walk greedily over all combinations of at most three in total
        for at in itertools.product(*(range(len(s)) for s in slots)) if len(turns) <= 2 else _few(slots):
            cost, audit, lines = 0, "", []
            for i, k in enumerate(at):
                c, a, ls = slots[i][k]
                cost, audit, lines = cost + c, audit + a, lines + ls
                if i < len(chosen):
                    c, a, line = chosen[i]
                    cost, audit, lines = cost + c, audit + a, lines + ([line] if line else [])
            if re.fullmatch(r"(s?(ua)+)?", "".join(r[:1] for r, _ in lines)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, lines)
    return best


def _few(slots):
    for n in range(3):
        for where in itertools.combinations(range(len(slots)), n):
            for ks in itertools.product(range(1, 7), repeat=n):
                at = [0] * len(slots)
                for w, k in zip(where, ks, strict=True):
                    at[w] = k
                yield at


def run(turns, hold=64):
    lines = []
    r = cr.Repair(1, lambda role, text: lines.append((role, text)), hold)
    for t in turns:
        r.add(*t)
    return r.finish(), lines


@settings(max_examples=150, deadline=None)
@given(st.lists(TURN, max_size=3))
def test_short_conversations_against_all_edits(turns):
    turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
    (_, n, gaps, blank, duplicate, truncated, illegal, cost, audit, digest), lines = run(turns)
    want = brute(turns)
    assert (cost, audit, lines) == want
    told = faults(turns)
    assert (n, blank, duplicate, truncated) == (len(turns), *(told.count(f) for f in ("blank", "duplicate", "truncated")))
    ts = [t for t, _, _ in turns if t is not None]
    assert gaps == (max(ts) - min(ts) + 1 - len(set(ts)) if ts else 0)
    assert illegal == sum(a[1][0] + b[1][0] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    assert digest == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()


@settings(max_examples=100, deadline=None)
@given(st.lists(TURN, max_size=60))
def test_settling_early_changes_nothing(turns):
    assert run(turns, hold=0) == run(turns, hold=1 << 30)


def test_layers_stay_small_in_long_conversations():
    r, most = cr.Repair(1, hold=16), 0
    for i in range(30_000):
        r.add(i, ["user", "assistant", "user", "user", "system"][i * i % 5], f"text {i}" + ".!?"[: i % 3])
        most = max(most, max(len(h[1]) for h in r.layer if h))
    assert most < 100 and len(r.finish()[8]) >= 30_000


def damaged_by_hand(rows):
    out, known = [], lambda x: " " if x is None else str(x)
    for conv_id, turn, role, text in rows:
        by = zlib.crc32(f"{known(conv_id)}:{known(turn)}".encode()) % 20
        role, text = known(role), known(text)
        text = "" if by == 1 else re.sub("[.!?]", "", text) if by == 2 else text
        if by:
            out += [(conv_id, turn, "user" if by == 4 else role, text)] * (2 if by == 3 else 1)
    return out


def rows_of_all_kinds():
    rows = [(c, t, ["user", "assistant"][t % 2], f"Turn {t} of {c}." if (c + t) % 9 else f"cut {c}") for c in range(60) for t in range(c % 9 + 1)]
    rows += [(None, None, None, None), (None, 3, "user", "x."), (7, None, "system", "s."), (7, 2, "user", "same turn."), (8, 1, "assistant", None), (None, None, None, None), (90, None, "assistant", "long " * 5000), (91, 5, "Ünïcode", "ß?")]
    lost = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    return rows + rows[:5] + [(lost, 0, "user", "alone.")]


def by_hand(rows):
    left, out = damaged_by_hand(rows), []
    for c in {r[0] for r in rows}:
        mine = sorted((t for t in left if t[0] == c), key=lambda t: (t[1] is not None, t[1] or 0, t[2], t[3]))
        (_, n, *rest), _ = run([t[1:] for t in mine])
        out.append((c, n, *rest))
    return sorted(out, key=str)


def test_conversations_in_frames(spark):
    rows = rows_of_all_kinds()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    from pyspark.sql import functions as F

    for name in ("present", "_by", "_n", "position", "n_turns", "audit"):
        df = df.withColumn(name, F.lit("clash"))
    turns = cr.damaged(df).repartition(7)
    got = cr.repair(turns)
    assert sorted(map(tuple, got.collect()), key=str) == by_hand(rows)
    assert any(r.n_turns == 0 and r.audit == "" and r.repaired_sha256 == hashlib.sha256().hexdigest() for r in got.collect())
    lines = {}
    for r in sorted(cr.repaired_turns(turns).collect(), key=lambda r: r.position):
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for r in got.collect():
        assert hashlib.sha256("\n".join(lines.get(r.conv_id, [])).encode()).hexdigest() == r.repaired_sha256
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert cr.repair(empty).count() == cr.repair(cr.damaged(empty)).count() == cr.repaired_turns(empty).count() == 0


def test_conversations_longer_than_a_batch(spark):
    rows = [(1, t, ["user", "assistant"][t % 2], f"Turn {t}.") for t in range(25_000)] + [(2, 0, "user", "a."), (2, 1, "assistant", "b.")]
    got = {r.conv_id: r for r in cr.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1].audit == "K" * 25_000 and got[1].cost == got[1].illegal == 0 and got[2].audit == "KK"


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_sql_gives_the_same(spark, sf, tmp_path):
    import duckdb

    from obsmat.llm import queries

    rows = rows_of_all_kinds()
    rows = [r for r in rows if r[3] is None or len(r[3]) < 1000]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(map(tuple, queries.op12_conversation_repair(spark, str(tmp_path)).collect()), key=str)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    cols = "conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256"
    want = con.sql(f"SELECT {cols} FROM ({queries.oracle_sql()['op12_conversation_repair']})").fetchall()
    assert got == sorted(want, key=str)
