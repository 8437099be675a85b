"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to). Each pattern offers its tokens once
for free, a second time at a cost and a third time at a higher cost (convex repetition costs); each source asks for its
quota. The flow of least cost says how many tokens each pattern gives. `mix` takes as a row's pattern all sources that hold its text. It is solved on the driver over the patterns and
sources alone: their number is checked against max_patterns, the documents stay on the cluster. Then whole documents are
chosen by seeded hash: all of a pattern as often as its flow covers it, and of the rest those with the smallest hashes.
The hash limit is found from a histogram, so a source with a third of all documents is never sorted in one task.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from obsmat.llm.common import SPACES, table

#: Cost of a token's first, second and third use.
REPEAT_COSTS = (0, 1, 3)
#: Hashes have 62 bits; the first 12 name the bin.
BIN_SHIFT = 50
#: Parts into which the rows of one text are dealt.
SALTS = 8


def targets(sizes: dict[str | None, int], weights: Sequence[float] = (5, 2, 1), most: int = 3) -> dict[str | None, float]:
    """Each source's share of all tokens by weight, at most `most` times its size; the excess goes to the others by weight.

    Sources take the weights in order of code points, null last.
    """
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(names)}
    total, full = float(sum(sizes.values())), set()
    out = dict.fromkeys(names, 0.0)
    while len(full) < len(names):
        left = total - sum(most * sizes[s] for s in full)
        of = sum(weight[s] for s in names if s not in full)
        out |= {s: left * weight[s] / of for s in names if s not in full}
        over = {s for s in names if s not in full and out[s] > most * sizes[s]}
        if not over:
            break
        full |= over
        out |= {s: float(most * sizes[s]) for s in over}
    return out


def min_cost_flow(supply: dict[frozenset, int], quota: dict[str, int], costs: Sequence[int] = REPEAT_COSTS, limits: dict[tuple, int] | None = None) -> dict[frozenset, dict[str, int]]:
    """Tokens that each pattern gives to each of its sources: as much of the quotas as can be met, at the least cost.

    limits: the most that a pattern may give to a source, by (pattern, source); without one only the supply limits it.
    Arcs go from the start to patterns (room for `supply` at each of `costs`), to their sources, to the end. A way pays on its
    first arc only, so the cheapest ways are those over the cheapest use that has room left: uses are opened from the
    cheapest on, and with each as much more is sent as fits, by blocking flows. A dearer use never makes room for a cheaper one.
    """
    patterns, sources = sorted(supply, key=lambda p: sorted(map(str, p))), sorted(quota, key=str)
    node = {("p", p): i + 2 for i, p in enumerate(patterns)} | {("s", s): i + 2 + len(patterns) for i, s in enumerate(sources)}
    to: list[int] = []
    room: list[int] = []
    arcs: list[list[int]] = [[] for _ in range(len(node) + 2)]

    def arc(u, v, cap):
        for a, b, k in ((u, v, cap), (v, u, 0)):
            arcs[a].append(len(to))
            to.append(b)
            room.append(k)
        return len(to) - 2

    def send() -> bool:
        """Fills all shortest ways with room from the start (0) to the end (1); False if there are none."""
        far, line = [0] + [-1] * (len(arcs) - 1), [0]
        for u in line:
            for e in arcs[u]:
                if room[e] and far[to[e]] < 0:
                    far[to[e]] = far[u] + 1
                    line.append(to[e])
        if far[1] < 0:
            return False
        tried, way, u = [0] * len(arcs), [], 0
        while True:
            if u == 1:
                push = min(room[e] for e in way)
                for e in way:
                    room[e] -= push
                    room[e ^ 1] += push
                full = next(i for i, e in enumerate(way) if not room[e])
                u = to[way[full] ^ 1]
                del way[full:]
            while tried[u] < len(arcs[u]) and not (room[arcs[u][tried[u]]] and far[to[arcs[u][tried[u]]]] == far[u] + 1):
                tried[u] += 1
            if tried[u] < len(arcs[u]):
                way.append(arcs[u][tried[u]])
                u = to[way[-1]]
            elif way:
                u = to[way.pop() ^ 1]
                tried[u] += 1
            else:
                return True

    uses = {p: arc(0, node["p", p], 0) for p in patterns}
    given = {(p, s): arc(node["p", p], node["s", s], 1 << 62 if limits is None else limits.get((p, s), 0)) for p in patterns for s in sorted(p, key=str) if s in quota}
    for s in sources:
        arc(node["s", s], 1, quota[s])
    for _ in sorted(costs):
        for p, e in uses.items():
            room[e] += supply[p]
        while send():
            pass
    out: dict = {p: {} for p in patterns}
    for (p, s), e in given.items():
        out[p][s] = room[e ^ 1]
    return out


def _one_more(rows: DataFrame, rest: dict[str, int], near: dict[str, int], rounds: int = 10) -> DataFrame:
    """(pattern, id) of the rows (pattern, id, size, h, bin) to take once more, for each pattern about `rest` tokens, at most
    `near` less where rows that small are left.

    Rows are taken in the order of their hashes, as far as they fit; those too large for what is left are passed over, and
    what is left after them is filled in the next round from the rows further on, `rounds` times at most. A round sums
    sizes by bins of the hash and by finer bins where the limit falls (4096 each), so no window holds more than 4096 rows a
    pattern; the driver gets a row for each pattern. The limit falls between finer bins: a row that shares one, of 2^24,
    with others is taken with them or not at all.
    """
    spark = rows.sparkSession
    frame = lambda d, schema: F.broadcast(spark.createDataFrame(d, schema))  # noqa: E731  a row for each pattern and round, whose number is checked
    state, rules = {p: (-1, g) for p, g in rest.items() if g > 0}, []
    for _ in range(rounds):
        if not state:
            break
        left = rows.join(frame([(p, *x) for p, x in state.items()], "pattern string, start long, gap long"), "pattern").where("h > start and size <= gap")
        by = Window.partitionBy("pattern").orderBy("bin")
        bins = left.groupBy("pattern", "gap", "bin").agg(F.sum("size").alias("size")).withColumn("upto", F.sum("size").over(by))
        cuts = {r.pattern: r for r in bins.groupBy("pattern").agg(F.min(F.when(F.col("upto") > F.col("gap"), F.struct("bin", (F.col("upto") - F.col("size")).alias("before")))).alias("cut"), F.max("upto").alias("all")).collect()}
        inner = [(p, r.cut.bin, r.cut.before) for p, r in cuts.items() if r.cut is not None]
        ends = {}
        if inner:
            edge = left.join(frame(inner, "pattern string, cut_bin int, before long"), "pattern").where("bin = cut_bin")
            edge = edge.groupBy("pattern", "gap", "before", F.shiftright("h", BIN_SHIFT - 12).alias("fine")).agg(F.sum("size").alias("size"), F.max("h").alias("h"))
            edge = edge.withColumn("upto", F.col("before") + F.sum("size").over(Window.partitionBy("pattern").orderBy("fine"))).where("upto <= gap")
            ends = {r.pattern: (r.h, r.upto) for r in edge.groupBy("pattern").agg(F.max("h").alias("h"), F.max("upto").alias("upto")).collect()}
        fresh = {}
        for p, (start, gap) in state.items():
            if p not in cuts:
                continue
            if cuts[p].cut is None:
                rules.append((p, start, 1 << 62, gap))
                continue
            end, used = ends.get(p, ((cuts[p].cut.bin << BIN_SHIFT) - 1, cuts[p].cut.before))
            rules.append((p, start, end, gap))
            if gap - used > near[p]:
                fresh[p] = (end, gap - used)
        state = fresh
    taken = rows.join(frame(rules or [("", 0, 0, 0)], "pattern string, start long, end long, most long"), "pattern")
    return taken.where("h > start and h <= end and size <= most").select("pattern", "id")


def copies(sized: DataFrame, quotas: dict[str | None, float], *, own: str | None = None, seed: int = 17, costs: Sequence[int] = REPEAT_COSTS, max_patterns: int = 100_000, tolerance: float = 0.001) -> DataFrame:
    """sized: id (unique), sources (array), size. Returns id and copies, for rows with at least one copy. What a pattern gives
    is filled up until `tolerance` of it is missing at most, as far as there are rows that fit.

    own names a column with the one of a row's sources that its copies count for. Then rows of a pattern share their uses, and
    their costs, whichever source they count for, no row has more than len(costs) copies, and a source that whole rows
    of its patterns leave short of its quota is filled up from all of its rows.

    Null sources in the array are a source of their own. Rows of size 0 get no copies. More than max_patterns patterns (with
    own: patterns and sources they count for) raise an error: then sources are too fine to be mixed by quota.
    """
    spark = sized.sparkSession
    name = lambda s: F.coalesce(F.concat(F.lit("="), s), F.lit("-"))
    plain = lambda s: None if s == "-" else s[1:]
    members = F.to_json(F.transform(F.array_sort(F.array_distinct("sources")), name))
    mine = F.lit("") if own is None else name(F.col(own))
    rows = sized.where("size > 0").select("id", "size", members.alias("members"), mine.alias("own"), F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id"), 2).alias("h"))
    rows = rows.withColumns({"pattern": F.concat("own", "members"), "bin": F.shiftright("h", BIN_SHIFT).cast("int")})
    found = rows.groupBy("pattern", "members", "own").agg(F.sum("size").alias("size")).limit(max_patterns + 1).collect()
    if len(found) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    sets = {m: frozenset(map(plain, json.loads(m))) for m in {r.members for r in found}}
    supply: dict = {}
    for r in found:
        supply[sets[r.members]] = supply.get(sets[r.members], 0) + int(r["size"])
    limits = None if own is None else {(sets[r.members], plain(r.own)): len(costs) * int(r["size"]) for r in found}
    flow = min_cost_flow(supply, {s: round(q) for s, q in quotas.items()}, costs, limits)
    plan, near = [], {}
    for r in found:
        given = sum(flow[sets[r.members]].values()) if own is None else flow[sets[r.members]].get(plain(r.own), 0)
        times, rest = divmod(given, int(r["size"]))
        near[r.pattern] = int(tolerance * given)
        most = 2 * rest > r["size"]  # then those left out are chosen
        plan.append((r.pattern, times, r["size"] - rest if most else rest, most))
    want = F.broadcast(spark.createDataFrame(plan or [("", 0, 0, False)], "pattern string, times long, part long, most boolean"))
    part = _one_more(rows, {p: n for p, _, n, _ in plan}, near).select(F.col("id").alias("_id"))
    all_ = rows.join(want.select("pattern", "times", "most"), "pattern").join(part, F.col("id") == F.col("_id"), "left")
    all_ = all_.select("id", "own", "size", "h", "bin", (F.col("times") + (F.col("most") != F.col("_id").isNotNull()).cast("long")).alias("copies"))
    if own is not None:
        all_ = table(all_, "mix-copies")
        used = {plain(r.own): int(r.used) for r in all_.groupBy("own").agg(F.sum(F.col("copies") * F.col("size")).alias("used")).collect()}
        marks = {s: "-" if s is None else f"={s}" for s in used}
        short = {marks[s]: round(quotas.get(s, 0)) - n for s, n in used.items()}
        free = all_.where(F.col("copies") < len(costs)).select(F.col("own").alias("pattern"), "id", "size", "h", "bin")
        more = _one_more(free, short, {marks[s]: int(tolerance * quotas.get(s, 0)) for s in used}).select(F.col("id").alias("_id"))
        all_ = all_.join(more, F.col("id") == F.col("_id"), "left").withColumn("copies", F.col("copies") + F.col("_id").isNotNull().cast("long"))
    return all_.where("copies > 0").select("id", "copies")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")).cast("long")


def sized_documents(docs: DataFrame) -> DataFrame:
    """id, doc_id, source, size. Rows with the same doc_id are told apart by text and, if that too is the same, by number."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("text_hash"), word_count(F.col("text")).alias("size"))
    again = Window.partitionBy("doc_id", "text_hash", "source").orderBy("size")
    return rows.withColumn("nth", F.row_number().over(again)).withColumn("id", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("text_hash").cast("string"), F.coalesce("source", F.lit("")), F.col("nth").cast("string")))


def with_sources(sized: DataFrame, *, max_shared: int | None = None, max_arcs: int | None = None) -> DataFrame:
    """sized with `sources`, the sources in which a row's text stands: its membership pattern. Texts of size 0 have their own only.

    Every pattern counts, unless the caller sets a limit: then those of most words do, at most `max_shared` of several sources
    with `max_arcs` members together; rows of others stay with their own source alone, and no row goes. Texts are salted, as
    one may hold a third of all rows.
    """
    texts = sized.where("size > 0").groupBy("text_hash").agg(F.sum("size").alias("words"), F.collect_set(F.struct("source")).alias("sources"))
    texts = texts.where(F.size("sources") > 1).select("text_hash", "words", F.array_sort(F.transform("sources", lambda s: s["source"])).alias("sources"))
    if max_shared is not None or max_arcs is not None:
        most = 1 << 62
        texts = texts.withColumn("key", F.xxhash64("sources"))
        top = texts.groupBy("key", F.size("sources").alias("n")).agg(F.sum("words").alias("words")).orderBy(F.desc("words"), "key").limit(100_000 if max_shared is None else max_shared)
        top = top.withColumn("upto", F.sum("n").over(Window.orderBy(F.desc("words"), "key").rowsBetween(Window.unboundedPreceding, 0))).where(F.col("upto") <= (most if max_arcs is None else max_arcs))
        texts = texts.join(F.broadcast(top.select("key")), "key")
    shared = texts.select("text_hash", "sources", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"))
    rows = sized.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(shared, ["text_hash", "salt"], "left")
    return rows.select(*sized.columns, F.coalesce("sources", F.array("source")).alias("sources"))


def mix(docs: DataFrame, *, weights: Sequence[float] = (5, 2, 1), seed: int = 17, max_sources: int = 20_000, max_patterns: int = 300_000) -> DataFrame:
    """doc_id, text_hash, nth, size, source, source_size, target, copies, taken and n_sources of each row of docs.

    A row counts for its source; its pattern is that of all sources in which its text stands, so sources that share texts
    share their free uses: one that has too few words takes those that another doesn't want before it repeats its own.

    Null texts have size 0, null sources are a source of their own (last), repeated rows are documents of their own,
    an empty table gives an empty one. More than max_sources sources, or max_patterns patterns and sources they count for,
    raise an error; no pattern is left out.
    """
    sized = table(sized_documents(docs), "mix-sizes")
    spark = docs.sparkSession
    found = sized.groupBy("source").agg(F.sum("size").alias("size")).limit(max_sources + 1).collect()
    if len(found) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    by_source = {r.source: int(r["size"]) for r in found}
    goal = targets(by_source, weights)
    patterns = table(with_sources(sized), "mix-patterns")
    chosen = copies(patterns, goal, own="source", seed=seed, max_patterns=max_patterns)
    facts = F.broadcast(spark.createDataFrame([(s, by_source[s], float(goal[s])) for s in by_source] or [(None, 0, 0.0)], "source string, source_size long, target double"))
    rows = patterns.join(facts, patterns["source"].eqNullSafe(facts["source"])).drop(facts["source"])
    times = F.coalesce("copies", F.lit(0)).cast("long")
    return rows.join(chosen, "id", "left").select("doc_id", "text_hash", "nth", "source", "size", "source_size", "target", times.alias("copies"), (times * F.col("size")).alias("taken"), F.size("sources").alias("n_sources"))


def mixed(docs: DataFrame, *, weights: Sequence[float] = (5, 2, 1), seed: int = 17) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with the columns of docs; rows that the mix doesn't take are left out.

    Rows with one doc_id, text and source share their copies evenly; what is left over goes to the least hash of the row, so
    reruns agree. Nulls and empty tables as in `mix`.
    """
    plan = mix(docs, weights=weights, seed=seed).where("copies > 0").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("source").alias("_source"), "copies")
    plan = plan.groupBy("_id", "_hash", "_source").agg(F.sum("copies").alias("_copies"))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("long").alias("_a"), F.xxhash64("text").alias("_b"), F.col("source").cast("string").alias("_c"))
    again = rows.join(plan, F.col("_a").eqNullSafe(F.col("_id")) & (F.col("_b") == F.col("_hash")) & F.col("_c").eqNullSafe(F.col("_source")))
    nth = Window.partitionBy("_id", "_hash", "_source").orderBy(F.xxhash64("_row"))
    n = F.count("*").over(Window.partitionBy("_id", "_hash", "_source"))
    again = again.withColumns({"_n": n, "_nth": F.row_number().over(nth)})
    each = F.floor(F.col("_copies") / F.col("_n")) + F.when(F.col("_nth") <= F.col("_copies") % F.col("_n"), 1).otherwise(0)
    return again.withColumn("_times", F.explode(F.sequence(F.lit(0).cast("long"), each))).where("_times > 0").select(*[F.col("_row")[c].alias(c) for c in docs.columns])
