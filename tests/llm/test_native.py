"""Fingerprints, line quality and host reputation against brute force."""

import hashlib
import re
from collections import defaultdict

from llm_helpers import clashing, empty_docs, odd_docs, odd_rows, prose
from pyspark.sql import functions as F

from obsmat.llm import fingerprints as fp
from obsmat.llm import host_reputation as hr
from obsmat.llm import line_quality as lq

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n=5):
    w = WORD.findall(text or "")
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_fingerprints_follow_the_next_document(spark):
    rows = [r for r in odd_rows() if r[0] is not None]
    out = [r.asDict() for r in fp.fingerprints(odd_docs(spark)).collect()]
    assert len(out) == len(odd_rows())
    order = sorted({r[0]: (r[1] or "") for r in rows}.items(), reverse=True)
    texts = dict(order)
    for r in out:
        if r["doc_id"] is None or r["doc_id"] in (1, 2):  # beside rows that share an id
            continue
        text = texts[r["doc_id"]]
        after = [t for i, t in order if i < r["doc_id"]][0]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = shingles(text), shingles(edited), shingles(after)
        for other, got in ((b, r["near_edited"]), (c, r["near_next"])):
            want = len(a & other) / len(a | other) if a | other else 1.0
            assert abs(want - got) < (1e-9 if len(a | other) <= fp.K else 0.2)
    assert len({r["fingerprint"] for r in out if r["doc_id"] in (1, 2)}) == 1


def test_fingerprints_wrap_around_without_odd_rows(spark):
    texts = {i * 1000 + i % 7: prose(30 + i, i) for i in range(150)}
    out = {r.doc_id: r for r in fp.fingerprints(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    order = sorted(texts, reverse=True)
    for i, d in enumerate(order):
        text, after = texts[d], texts[order[(i + 1) % len(order)]]
        half = len(text) // 2
        assert out[d].edited_sha256 == hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()


def test_fingerprints_of_nothing(spark):
    assert fp.fingerprints(empty_docs(spark)).count() == 0
    assert fp.fingerprints(clashing(odd_docs(spark))).count() == len(odd_rows())


def test_sketches_merge_over_parts(spark):
    whole, parts = prose(2000, 9), []
    w = whole.split()
    parts = [(1, " ".join(w[i : i + 504])) for i in range(0, 2000, 500)]
    df = spark.createDataFrame(parts, "key int, text string").withColumn("sketch", fp.sketch(F.col("text")))
    merged = fp.merge_parts(df, "key").first().sketch
    assert merged == spark.createDataFrame([(whole,)], "text string").select(fp.sketch(F.col("text"))).first()[0]
    est = spark.createDataFrame([(whole, " ".join(w[:1000]))], "a string, b string").select(
        fp.distinct_shingles(fp.sketch(F.col("a"))), fp.containment(fp.sketch(F.col("b")), fp.sketch(F.col("a"))), fp.resemblance(fp.sketch(F.col("a")), fp.sketch(F.col("b")))).first()
    assert abs(est[0] - len(shingles(whole))) < 0.3 * len(shingles(whole)) and est[1] > 0.7 and abs(est[2] - 0.5) < 0.15


def quality_by_hand(rows, max_docs, max_percent=5):
    words = {}
    lines, hosts, known = {}, defaultdict(set), defaultdict(set)
    for n, (_, text, _, source, _) in enumerate(rows):
        w = WORD.findall(text or "")
        raw = [x for x in (text or "").split("\n") if WORD.search(x)]
        normal = [" ".join(WORD.findall(x)).lower() for x in raw]
        wins = defaultdict(list)
        for i in range(len(w) - 4):
            wins[tuple(w[i : i + 5])].append(i)
        again = {p + k for at in wins.values() if len(at) > 1 for p in at for k in range(5)}
        words[n] = (len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(raw) - len(set(raw)), len(again))
        lines[n] = normal
        known[source or ""].update([tuple(normal)] if normal else [])
        for x in normal:
            hosts[source or "", x].add(tuple(normal))
    out = []
    for n, (doc_id, _, _, source, _) in enumerate(rows):
        total = sum(len(x.split()) for x in lines[n])
        lost = sum(len(x.split()) for x in lines[n] if len(hosts[source or "", x]) > max(max_docs, max_percent / 100 * len(known[source or ""]))) / total if total else 0
        failed = words[n][0] < 10 or 100 * words[n][4] > 20 * words[n][0]
        out.append((doc_id, *words[n], failed, not failed and lost <= 0.5 and words[n][0] * (1 - lost) >= 10))
    return sorted(out, key=str)


def boiler_rows():
    shared = "this site uses cookies to keep you signed in and to count visits every day"
    return [(100 + i, f"{shared}\n{prose(12 if i % 2 else 60, 50 + i)}", "en", "host", 0) for i in range(12)]


def test_quality_by_hand(spark):
    rows = odd_rows() + boiler_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = lq.quality(df, max_docs=5).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    want = quality_by_hand(rows, 5)
    assert sorted((tuple(r) for r in got), key=str) == want
    assert {r[0] for r in want if r[-1] and r[0] and r[0] >= 100} == {100, 102, 104, 106, 108, 110}


def test_clean_takes_lines_away_and_keeps_columns(spark):
    df = spark.createDataFrame(odd_rows() + boiler_rows(), "doc_id long, text string, lang string, source string, n_chars long")
    out = lq.clean(clashing(df), max_docs=5)
    assert out.columns == clashing(df).columns
    rows = out.where("doc_id >= 100").collect()
    assert len(rows) == 6 and all("cookies" not in r.text and r.n_chars == len(r.text) for r in rows)
    assert lq.clean(empty_docs(spark)).count() == 0 and lq.quality(empty_docs(spark)).count() == 0


def test_copies_are_not_boilerplate(spark):
    text = "\n".join(prose(20, i) for i in range(5))
    df = spark.createDataFrame([(i, text, "en", "h", 0) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long")
    assert lq.quality(df, max_docs=5).where("kept").count() == 40


def test_all_boilerplate_of_a_page_is_counted(spark):
    """Menu, long notice and footer of documents whose own lines are shorter than the notice and the footer."""
    shared = ["home news sport weather", " ".join(["we use cookies on this site to count visits"] * 3) + ".", "all texts of this site belong to their authors and publishers and may not be copied"]
    rows = [(i, "\n".join([*shared[:2], prose(4 + 7 * (i % 2), 100 + i), *([prose(11, 500 + i)] if i % 2 else []), shared[2]]), "en", "h", 0) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    limits = {"max_lost": 0.9, "max_repeat_percent": 100}
    out = {r.doc_id: r.text for r in lq.clean(df, **limits).collect()}
    assert set(out) == set(range(1, 40, 2)) and not any(x in t.split("\n") for t in out.values() for x in shared)
    assert lq.quality(df, max_repeat_percent=100).where("kept").count() == 0


def test_a_header_and_a_footer_in_all_pages_go(spark):
    rows = [(i, f"welcome to our little site\n{prose(5 if i % 2 else 40, 900 + i)}\nall rights reserved by the owner", "en", "h", 0) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = lq.quality(df).collect()
    assert all(r.lost > 0 and set(r.lines_at) == {0, 2} for r in out) and all(r.kept == (r.doc_id % 2 == 0) for r in out)


def test_one_text_under_two_hosts_is_judged_by_each(spark):
    line = "this notice stands on every page of the first host and nowhere else at all"
    rows = [(i, f"{line}\n{prose(12, 700 + i)}", "en", "a", 0) for i in range(40)] + [(0, f"{line}\n{prose(12, 700)}", "en", "b", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.source: r for r in lq.quality(df).where("doc_id = 0").collect()}
    assert not out["a"].kept and abs(out["a"].lost - 15 / 27) < 1e-9 and out["b"].kept and out["b"].lost == 0


def test_limits_are_numbers_and_shares(spark):
    """A line in 10 of 300 documents is over the number but under 5 %; the longest line of all documents is over both."""
    long_ = "we use cookies " * 30
    rows = [(i, ("\n".join([long_.strip() + ".", "thanks for reading"][: 1 + (i < 10)]) + "\n" + prose(50, 100 + i)), "en", "h", 0) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: r.text for r in lq.clean(df, max_docs=5, max_lost=0.95, max_repeat_percent=100).collect()}
    assert len(out) == 300 and not any("cookies" in t for t in out.values()) and all(("thanks" in t) == (i < 10) for i, t in out.items())


RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
URLS = [("http://A.Example.org/es/1?x#y", "a.example.org", "/es/1", "example.org/es/", "block"), ("https://example.org/en/12#t", "example.org", "/en/12", "example.org/en/1", "block"), ("ftp://q.org/", "q.org", "/", "org/", "allow"),
        ("http://q.org?x", "q.org", "", None, "allow"), ("no url", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("http://b.com/de/x", "b.com", "/de/x", "com/de/", "block"),
        ("http://b.com/fr/x?a/b", "b.com", "/fr/x", "com/fr/", "allow"), ("http://notexample.org.net/es/", "notexample.org.net", "/es/", None, "allow"), ("http://xexample.org/es/", "xexample.org", "/es/", "org/", "allow"),
        ("http://ÄB.net:80/p", "Äb.net:80", "/p", None, "allow"), ("http://a\nb.net/c\nd#e", "a\nb.net", "/c\nd", None, "allow")]


def test_rules_and_urls(spark):
    pages = spark.createDataFrame([(i, u[0], "<html>") for i, u in enumerate(URLS)], "page_id long, url string, html string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in hr.judge(clashing(pages), labels, RULES).collect()}
    assert got == {i: u[1:] for i, u in enumerate(URLS)}
    assert hr.judge(pages.limit(0), labels, RULES).count() == 0


def test_reputation_shrinks_and_blocks(spark):
    rows = [(i, f"http://h{i % 4}.bad.net/p" if i < 200 else f"http://g{i % 40}.good.net/p", None) for i in range(800)] + [(900, "http://new.good.net/", None), (901, "http://new.bad.net/", None), (None, "http://g1.good.net/", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    labels = spark.createDataFrame([(i, 0 if i < 200 else 1, 0) for i in range(800)] + [(0, None, None), (None, 0, 1), (900, None, None)], "doc_id long, quality int, toxic int")
    rep = {r.host: r for r in hr.host_reputation(hr.page_outcomes(pages, labels)).collect()}
    assert rep["h0.bad.net"].n == 50 and rep["h0.bad.net"].mean > 0.9 and rep["g1.good.net"].mean < 0.1
    assert rep["new.good.net"].n == 0 and rep["new.good.net"].mean < rep["new.bad.net"].mean
    assert rep["h0.bad.net"].mean < 1 and rep["g1.good.net"].mean > 0
    out = {(r.page_id, r.verdict) for r in hr.judge(pages, labels, ()).collect()}
    assert (0, "block") in out and (500, "allow") in out and (None, "allow") in out and len(out) == len(rows)


def test_sql_of_the_url_filter_knows_users_ports_and_suffixes(spark):
    """Both sides agree on hosts of every kind, page by page; the suffixes change what a host inherits."""
    import duckdb
    import pandas as pd

    from obsmat.llm.queries import URL_RULES, oracle_sql

    hosts = ["a.co.uk", "b.co.uk", "www.a.co.uk", "co.uk", "uk", "x.com.au", "y.x.com.au", "me.github.io", "you.github.io", "github.io", "u@v.net", "v.net:8080", "p:q@w.v.net:1", "one", "", "a..b", "example.org", "Shop.De", "co.uk.", "1.2.3.4"]
    rows = [(i, None if i % 97 == 5 else f"http://{hosts[i % len(hosts)]}/{i % 3}?x#y") for i in range(400)]
    labels = [(i, (0 if (i * 7 + i // 20) % (2 + i % len(hosts)) else 1) if i % 11 else None, i % 23 == 0) for i in range(0, 400, 2)]
    pages, marks = pd.DataFrame(rows, columns=["page_id", "url"]), pd.DataFrame(labels, columns=["doc_id", "quality", "toxic"]).astype({"quality": "Int64", "toxic": "int"})
    con = duckdb.connect()
    con.register("pages", pages)
    con.register("labels", marks)
    want = con.execute(oracle_sql()["op7_url_filters"]).fetchall()
    got = hr.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame([(a, b, int(c)) for a, b, c in labels], "doc_id long, quality int, toxic int"), URL_RULES)
    assert sorted(map(tuple, got.select("page_id", "host", "path", "rule", "verdict").collect())) == sorted(want)
    assert {"block", "allow"} == {r[4] for r in want if r[3] is None}
    names = spark.createDataFrame([(h,) for h in hosts], "host string").select("host", *(c.alias(n) for c, n in zip(hr.parents(F.col("host")), ("domain", "suffix"), strict=True)))
    found = {r.host: (r.domain, r.suffix) for r in names.collect()}
    assert found["www.a.co.uk"] == ("a.co.uk", "co.uk") and found["p:q@w.v.net:1"] == ("v.net", "net") and found["me.github.io"] == ("me.github.io", "github.io") and found["co.uk"] == ("co.uk", "co.uk")
