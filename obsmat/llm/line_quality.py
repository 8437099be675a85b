"""Quality rules: base rules on words and repetition, then cross-document line frequency.

Lines are normalised and hashed; for each host the distinct documents with a line are counted; lines above the limits are
removed, and documents that lose too much are rejected. Everything is DataFrame expressions. Copies of one document count
once: a document is known by the hash of its normalised text, so a group of thousands of copies doesn't make its own lines
look like boilerplate. Near copies are different documents. One limit is a number of documents, the other a share of the
host's, so that short sentences don't become boilerplate as a host grows. Counting is distinct-then-count, both with a partial
step before the shuffle, so a line that stands in a third of all documents is one row per task. The frequent lines are
broadcast only after their number was checked. The text is read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsmat.llm.common import SPACES, let, shingle_hashes, table, words

SYMBOLS = "#*$%&|<>"


def repeated_words(hashes: Column, size: int) -> Column:
    """Words covered by windows of `size` words whose hash stands in the array twice or more. Sorting, not pairs: n log n."""

    def covered(h):
        def from_sorted(s):
            again = F.transform(s, lambda e, j: F.when((F.get(s, j - 1)["h"] == e["h"]) | (F.get(s, j + 1)["h"] == e["h"]), e["at"]))
            return let(
                F.sort_array(F.filter(again, lambda p: p.isNotNull())),
                lambda at: F.aggregate(F.transform(at, lambda p, j: F.least(F.lit(size), F.coalesce(F.get(at, j + 1) - p, F.lit(size)))), F.lit(0).cast("long"), lambda a, x: a + x),
            )

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at")))), from_sorted))

    return let(hashes, covered)


def base_statistics(docs: DataFrame, *, min_words: int = 10, max_repeat_percent: int = 20, window: int = 5) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed. A null text has no words."""
    text = F.coalesce("text", F.lit(""))
    lined = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \x09-\x0D]"))
    d = docs.withColumns({"_w": words(F.col("text")), "word_chars": F.length(F.regexp_replace(text, SPACES, "")).cast("long"), "n_symbols": F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long"), "n_dup_lines": let(lined, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))})
    d = d.withColumns({"n_words": F.size("_w").cast("long"), "n_repeat_words": F.when(F.size("_w") < window, F.lit(0).cast("long")).otherwise(repeated_words(shingle_hashes(F.col("_w"), window), window))}).drop("_w")
    return d.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")))


def with_lines(docs: DataFrame) -> DataFrame:
    """docs (with text and source) and host_key, doc_key (all normalised lines of the document; null without words), line_keys
    (host and normalised line, in the order of the text's lines; null where a line has no word) and line_words."""
    normal = F.lower(F.regexp_replace(F.coalesce("text", F.lit("")), r"[ \x09\x0B-\x0D]+", " "))
    host = F.coalesce("source", F.lit(""))
    d = docs.withColumn("_lines", F.transform(F.split(normal, "\n"), lambda x: F.trim(x)))
    d = d.withColumns({"_whole": F.array_join(F.filter("_lines", lambda x: x != ""), "\n"), "host_key": F.xxhash64(host)})
    key = F.transform("_lines", lambda x: F.when(x != "", F.xxhash64(F.col("host_key"), x)))
    number = F.transform("_lines", lambda x: F.when(x == "", 0).otherwise(F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1))
    return d.withColumns({"doc_key": F.when(F.col("_whole") != "", F.xxhash64("_whole")), "line_keys": key, "line_words": number}).drop("_lines", "_whole")


def frequent_lines(lined: DataFrame, *, max_docs: int, max_percent: int) -> DataFrame:
    """line_key of the lines that stand in more than max_docs different documents of one host, and in more than max_percent of them."""
    known = lined.where("doc_key is not null")
    lines = known.select("host_key", "doc_key", F.explode(F.array_distinct("line_keys")).alias("line_key")).where("line_key is not null")
    lines = lines.distinct().groupBy("host_key", "line_key").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > max_docs)
    hosts = known.select("host_key", "doc_key").distinct().groupBy("host_key").agg(F.count("*").alias("all_docs")).where(F.col("all_docs") > max_docs)
    return lines.join(hosts, "host_key").where(100 * F.col("n_docs") > max_percent * F.col("all_docs")).select("line_key")


def line_losses(lined: DataFrame, *, max_docs: int, max_percent: int, broadcast_rows: int = 1_000_000) -> DataFrame:
    """row, lost (share of the words that stand in frequent lines), lines_at (those lines' places), only for rows with such lines."""
    found = table(frequent_lines(lined, max_docs=max_docs, max_percent=max_percent), "frequent-lines")
    if found.count() <= broadcast_rows:
        found = F.broadcast(found)
    at = lined.where("doc_key is not null").select("row", "line_words", F.posexplode("line_keys").alias("at", "line_key")).where("line_key is not null")
    gone = at.join(found, "line_key").select("row", "at", F.get("line_words", F.col("at")).alias("n"), F.aggregate("line_words", F.lit(0), lambda a, x: a + x).alias("of"))
    return gone.groupBy("row").agg((F.sum("n") / F.max("of")).alias("lost"), F.collect_list("at").alias("lines_at"))


def judged(docs: DataFrame, *, max_docs: int, max_percent: int, max_lost: float, min_words: int, max_repeat_percent: int, drop: tuple = ()) -> DataFrame:
    """docs (text, source and others, but for `drop`) with base statistics, lost, lines_at and kept. The text is read once: statistics and keys of
    lines are written together, and lines are counted and looked up among the keys."""
    base = base_statistics(with_lines(docs), min_words=min_words, max_repeat_percent=max_repeat_percent)
    base = table(base.drop(*drop).withColumn("row", F.monotonically_increasing_id()), "line-keys")
    lost = line_losses(base, max_docs=max_docs, max_percent=max_percent)
    both = base.drop("host_key", "doc_key", "line_keys", "line_words").join(lost, "row", "left").drop("row")
    share = F.coalesce("lost", F.lit(0e0))
    return both.withColumns({"lost": share, "kept": ~F.col("base_failed") & (share <= max_lost) & (F.col("n_words") * (1 - share) >= min_words)})


def quality(docs: DataFrame, *, max_docs: int = 30, max_percent: int = 5, max_lost: float = 0.5, min_words: int = 10, max_repeat_percent: int = 20) -> DataFrame:
    """doc_id and source of docs with the base statistics, base_failed, lost, lines_at (places of removed lines) and kept, a row
    for each row; columns of other names aren't read.

    Rejected: base_failed; more than max_lost of the words in lines that stand in over max_docs different documents of one
    host and over max_percent of its documents; or fewer than min_words words left. Null texts have no words and fail; null
    and empty sources are one host; a text under two hosts is judged under each by that host's lines; repeated rows each get
    a row and count once; an empty table gives an empty one.
    """
    plain = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"))
    return judged(plain, max_docs=max_docs, max_percent=max_percent, max_lost=max_lost, min_words=min_words, max_repeat_percent=max_repeat_percent, drop=("text",))


def clean(docs: DataFrame, *, max_docs: int = 30, max_percent: int = 5, max_lost: float = 0.5, min_words: int = 10, max_repeat_percent: int = 20) -> DataFrame:
    """The kept documents, without the lines above the limit, with the columns of docs; n_chars, if there, follows the text. Rows
    are judged as in `quality`; extra columns stay, whatever their names."""
    plain = docs.select(F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"), F.struct(*[c for c in docs.columns if c not in ("text", "n_chars")]).alias("_row"))
    q = judged(plain, max_docs=max_docs, max_percent=max_percent, max_lost=max_lost, min_words=min_words, max_repeat_percent=max_repeat_percent).where("kept")
    line = F.split("text", "\n")
    left = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(line) - 1), F.col("lines_at")), lambda i: F.get(F.col("_split"), i)), "\n")
    q = q.withColumn("_split", line).withColumn("_text", F.when(F.col("lines_at").isNull(), F.col("text")).otherwise(left))
    return q.select(*[F.col("_text").alias(c) if c == "text" else F.length("_text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col("_row")[c].alias(c) for c in docs.columns])
