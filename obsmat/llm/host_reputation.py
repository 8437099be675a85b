"""URL filters: explicit rules, then empirical-Bayes reputation of hosts.

The share of bad pages of a host is shrunk through beta-binomial priors: root to public suffix, suffix to registered
domain, domain to host. Each parent's prior strength comes from the spread of its children (method of moments). A host is
blocked if the lower posterior bound of its share of bad pages is above the limit. All steps are DataFrame expressions;
a page's url is reduced to its host before anything is shuffled, and counts are combined before the shuffle, so a hot
host is one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Second labels that registries use under two-letter country domains (co.uk, com.au, ac.jp), and hosting
#: domains whose subdomains belong to different people. Other suffixes are taken as one label.
SECOND_LABELS = ("ac", "co", "com", "edu", "gob", "gov", "gouv", "ltd", "mil", "ne", "net", "nom", "or", "org", "plc", "sch")
SHARED_DOMAINS = ("appspot.com", "blogspot.com", "github.io", "gitlab.io", "herokuapp.com", "netlify.app", "pages.dev", "tumblr.com", "vercel.app", "web.app", "wordpress.com", "workers.dev")


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): the host ends at `/`, `?` or `#` and has A-Z lower-cased; the path ends at `?` or `#`. Both are empty for null or without `://`."""
    u = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, u.substr(F.instr(u, "://") + 3, F.length(u))).otherwise("")
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(raw, UPPER, LOWER), path


def rule_expr(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits, else nulls. A rule is (action, "host/path start")."""
    rule = action = None
    for act, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, start = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        action = F.when(fits, act) if action is None else action.when(fits, act)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, action)


def parents(host: Column) -> tuple[Column, Column]:
    """(registered domain, public suffix) of a host; user names and ports don't count. A suffix has two labels if these are one of
    SHARED_DOMAINS, or a country domain of two letters after one of SECOND_LABELS; else one. A host without a dot is its own
    domain, with an empty suffix; a host that is itself a suffix is its own domain."""
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":\d*$", "")
    two = F.regexp_extract(bare, r"([^.]+\.[^.]+)$", 1)
    suffix = F.when(two.isin(*SHARED_DOMAINS) | two.rlike(rf"^({'|'.join(SECOND_LABELS)})\.[a-z]{{2}}\z"), two).when(F.contains(bare, F.lit(".")), F.substring_index(bare, ".", -1)).otherwise("")
    n = F.size(F.split(suffix, r"\.")) + 1
    return F.when(suffix == "", bare).otherwise(F.array_join(F.slice(F.split(bare, r"\."), -F.least(n, F.size(F.split(bare, r"\."))), n), ".")), suffix


def _strength(children: DataFrame, parent: str, low: float, high: float) -> DataFrame:
    """For each parent its n, bad and the beta-binomial prior strength, from the children's spread: the highest allowed where they don't differ more than by chance, the least without labels."""
    g = children.groupBy(parent).agg(
        F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum((F.col("n") > 0).cast("long")).alias("k"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"),
        F.sum(F.when(F.col("n") > 0, F.col("bad").cast("double") * F.col("bad") / F.col("n")).otherwise(0e0)).alias("bb"),
    )
    g = g.withColumn("_n", F.greatest("n", F.lit(1)).cast("double"))
    m = F.col("bad") / F.col("_n")
    between = (F.col("bb") - F.col("bad") * m) / (m * (1 - m)) - (F.col("k") - 1)
    room = F.col("n") - F.col("nn") / F.col("_n") - (F.col("k") - 1)
    rho = F.when((F.col("k") > 1) & (F.col("bad") > 0) & (F.col("bad") < F.col("n")), F.when(room > 0, between / room))
    return g.select(parent, "n", "bad", F.when(F.col("n") == 0, F.lit(low)).when(rho.isNull() | (rho <= 0), F.lit(high)).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), 1 / rho - 1))).alias("strength"))


def host_reputation(outcomes: DataFrame, *, least_strength: float = 2.0, most_strength: float = 200.0, z: float = 1.645) -> DataFrame:
    """outcomes: host, n (labelled pages), bad. One row a host: n, bad, mean, lower and upper bound of the share of bad pages.

    An empty table gives an empty table; a host without labelled pages has the prior of its domain; null hosts count as "".
    """
    hosts = outcomes.groupBy(F.coalesce("host", F.lit("")).alias("host")).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domain, suffix = parents(F.col("host"))
    hosts = hosts.withColumns({"domain": domain, "suffix": suffix, "root": F.lit("")})
    keys = lambda d: d.withColumns({"suffix": parents(F.col("domain"))[1]})
    domains = keys(_strength(hosts, "domain", least_strength, most_strength))
    suffixes = _strength(domains, "suffix", least_strength, most_strength).withColumn("root", F.lit(""))
    root = _strength(suffixes, "root", least_strength, most_strength)
    root = root.select("root", ((F.col("bad") + 1e0) / (F.col("n") + 2e0)).alias("m0"), F.col("strength").alias("s0"))
    suffixes = suffixes.join(root, "root").select("suffix", ((F.col("bad") + F.col("s0") * F.col("m0")) / (F.col("n") + F.col("s0"))).alias("m1"), F.col("strength").alias("s1"))
    domains = domains.join(suffixes, "suffix").select("domain", ((F.col("bad") + F.col("s1") * F.col("m1")) / (F.col("n") + F.col("s1"))).alias("m2"), F.col("strength").alias("s2"))
    both = hosts.join(domains, "domain")
    total = F.col("n") + F.col("s2")
    mean = (F.col("bad") + F.col("s2") * F.col("m2")) / total
    spread = z * F.sqrt(mean * (1 - mean) / (total + 1))
    return both.select("host", "n", "bad", mean.alias("mean"), F.greatest(F.lit(0e0), mean - spread).alias("lower"), F.least(F.lit(1e0), mean + spread).alias("upper"))


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """host, n, bad of each host: a page is bad if any of its labels says low quality or toxic; a label that says neither (nulls) doesn't count."""
    bad = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    by_page = labels.where("doc_id is not null and (quality is not null or toxic is not null)").groupBy(F.col("doc_id").alias("page_id")).agg(F.max(bad.cast("long")).alias("bad"))
    host, _ = split_url(F.col("url"))
    found = pages.select("page_id", host.alias("host")).join(by_page, "page_id", "left")
    return found.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]], *, max_bad: float = 0.3, z: float = 1.645) -> DataFrame:
    """page_id, host, path, rule, verdict and the host's lower bound, a row for each row of pages (repeated rows too; null ids stay).

    A fitting rule decides; else the page is blocked if its host's lower posterior bound exceeds max_bad.
    """
    host, path = split_url(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path"))
    known = host_reputation(page_outcomes(pages, labels), z=z).select("host", F.col("lower").alias("bad_lower"))
    rule, action = rule_expr(F.col("host"), F.col("path"), rules)
    both = judged.join(known, "host")
    return both.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(action, F.when(F.col("bad_lower") > max_bad, "block").otherwise("allow")).alias("verdict"), "bad_lower")
