"""The registered queries of this subpackage: each applies an operator to its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from obsmat.llm.common import read
from obsmat.llm.host_reputation import SECOND_LABELS, SHARED_DOMAINS

#: Rules of the URL filter: (action, host and start of path).
URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def op1_license_scan(spark, sf_dir):
    from obsmat.llm.licenses import scan

    return scan(read(spark, sf_dir, "documents"))


def op2_fingerprints(spark, sf_dir):
    from obsmat.llm.fingerprints import fingerprints

    return fingerprints(read(spark, sf_dir, "documents"))


def op3_quality_rules(spark, sf_dir):
    from obsmat.llm.line_quality import quality

    q = quality(read(spark, sf_dir, "documents"))
    return q.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def quality_rules_low_limits(spark, sf_dir):
    """The rules with limits that small tables reach: lines in over two documents of a host, and over 2 % of them, go."""
    from obsmat.llm.line_quality import quality

    q = quality(read(spark, sf_dir, "documents"), max_docs=2, max_percent=2)
    return q.select("doc_id", "n_words", "base_failed", F.round("lost", 9).alias("lost"), "kept")


def op7_url_filters(spark, sf_dir):
    from obsmat.llm.host_reputation import judge

    return judge(read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op4_mixing(spark, sf_dir):
    from obsmat.llm.mixing import mix

    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op5_lm_scoring(spark, sf_dir):
    from obsmat.llm.context_mixing import scores

    return scores(read(spark, sf_dir, "documents"))


def op6_chat_formatting(spark, sf_dir):
    import public_tokenizers
    from obsmat.llm.chat import digests, format_conversations

    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return digests(format_conversations(rows.unionByName(more), public_tokenizers.path("byte_bpe_50k.json")))


def op8_simhash_near_dedup(spark, sf_dir):
    from obsmat.llm.simhash import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id", "n_links")


def op9_packing(spark, sf_dir):
    import public_tokenizers
    from obsmat.llm.packing import pack

    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_suffix_array_dedup(spark, sf_dir):
    from obsmat.llm.suffix_buckets import digests

    return digests(read(spark, sf_dir, "documents"))


def op11_vector_codes(spark, sf_dir):
    from obsmat.llm.vector_codes import compress

    return compress(read(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op12_conversation_repair(spark, sf_dir):
    from obsmat.llm.conversation_repair import damaged, repair

    found = repair(damaged(read(spark, sf_dir, "conversations")))
    return found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def op13_byte_pairs(spark, sf_dir):
    import public_tokenizers
    from obsmat.llm.byte_pairs import decode, digests, encode

    path = public_tokenizers.path("byte_bpe_50k.json")
    return digests(decode(encode(read(spark, sf_dir, "documents"), path), path))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_OP3_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS host, row_number() OVER () AS r FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
wins AS (SELECT r, i, array_to_string(ws[i:i+4], ' ') AS g FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - 3, 1))) AS i FROM w WHERE len(ws) >= 5)),
again AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, g) AS c FROM wins) WHERE c > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM again, range(0, 5) AS x(k) GROUP BY r),
lines AS (SELECT r, line FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY r),
texts AS (SELECT r, host, [y FOR y IN [lower(trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'), ' ')) FOR x IN string_split(t, chr(10))] IF y <> ''] AS ls FROM d),
normal AS (SELECT r, host, md5(array_to_string(ls, chr(10))) AS whole, unnest(ls) AS line FROM texts),
hosts AS (SELECT host, count(DISTINCT whole) AS all_docs FROM normal GROUP BY host),
common AS (SELECT host, line FROM (SELECT host, line, count(DISTINCT whole) AS n FROM normal GROUP BY host, line) JOIN hosts USING (host) WHERE n > {max_docs} AND 100 * n > {max_percent} * all_docs),
lost AS (SELECT r, sum(CASE WHEN c.line IS NOT NULL THEN n ELSE 0 END)::DOUBLE / sum(n) AS share FROM
  (SELECT r, host, line, len(string_split(line, ' ')) AS n FROM normal) x LEFT JOIN common c USING (host, line) GROUP BY r),
base AS (SELECT w.doc_id, w.r, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN dup USING (r) LEFT JOIN covered USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND coalesce(share, 0) <= 0.5 AND n_words * (1 - coalesce(share, 0)) >= 10 AS kept
FROM base LEFT JOIN lost USING (r)
"""



def _op3_sql(max_docs: int = 30, max_percent: int = 5) -> str:
    return _OP3_SQL.replace("{max_docs}", str(max_docs)).replace("{max_percent}", str(max_percent))


_LOW_LIMITS_SQL = _op3_sql(2, 2).replace("kept\nFROM base", "kept, round(coalesce(share, 0), 9) + 0e0 AS lost\nFROM base")

_STRENGTH = """CASE WHEN n = 0 THEN 2e0 WHEN k > 1 AND bad > 0 AND bad < n AND n - nn / n - (k - 1) > 0 AND (bb - bad * (bad / n::DOUBLE)) / ((bad / n::DOUBLE) * (1 - bad / n::DOUBLE)) - (k - 1) > 0
  THEN greatest(2e0, least(200e0, (n - nn / n - (k - 1)) / ((bb - bad * (bad / n::DOUBLE)) / ((bad / n::DOUBLE) * (1 - bad / n::DOUBLE)) - (k - 1)) - 1)) ELSE 200e0 END"""
_SUMS = """sum(n) AS n, sum(bad) AS bad, count(*) FILTER (n > 0) AS k, sum(n::DOUBLE * n) AS nn, sum(CASE WHEN n > 0 THEN bad::DOUBLE * bad / n ELSE 0e0 END) AS bb"""

_OP7_SQL = rf"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
l AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY 1),
h0 AS (SELECT host, count(l.bad) AS n, coalesce(sum(l.bad), 0) AS bad FROM p LEFT JOIN l USING (page_id) GROUP BY host),
h1 AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':\d*$', '') AS bare FROM h0),
h2s AS (SELECT *, string_split(bare, '.') AS labels, array_to_string(string_split(bare, '.')[-2:], '.') AS two FROM h1),
h3 AS (SELECT *, CASE WHEN regexp_full_match(two, '({'|'.join(SECOND_LABELS)})\.[a-z]{{2}}') OR two IN {SHARED_DOMAINS} THEN 2 WHEN strpos(bare, '.') > 0 THEN 1 ELSE 0 END AS k FROM h2s),
h AS (SELECT host, n, bad, CASE WHEN k = 0 THEN '' ELSE array_to_string(labels[-k:], '.') END AS suffix,
  array_to_string(labels[-least(k + 1, len(labels)):], '.') AS domain FROM h3),
d AS (SELECT domain, suffix, n, bad, {_STRENGTH} AS s FROM (SELECT domain, suffix, {_SUMS} FROM h GROUP BY domain, suffix)),
s AS (SELECT suffix, n, bad, {_STRENGTH} AS s FROM (SELECT suffix, {_SUMS} FROM d GROUP BY suffix)),
r AS (SELECT (bad + 1e0) / (n + 2e0) AS m, {_STRENGTH} AS s FROM (SELECT {_SUMS} FROM s)),
s2 AS (SELECT suffix, (s.bad + r.s * r.m) / (s.n + r.s) AS m, s.s FROM s, r),
d2 AS (SELECT domain, (d.bad + s2.s * s2.m) / (d.n + s2.s) AS m, d.s FROM d JOIN s2 USING (suffix)),
h2 AS (SELECT host, n + d2.s AS t, (bad + d2.s * d2.m) / (n + d2.s) AS m FROM h JOIN d2 USING (domain)),
b AS (SELECT host, greatest(0e0, m - 1.645 * sqrt(m * (1 - m) / (t + 1))) AS lower FROM h2),
x AS (SELECT page_id, host, path, lower, CASE
  WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/en/1') THEN 'example.org/en/1'
  WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/es/') THEN 'example.org/es/'
  WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/de/') THEN 'com/de/'
  WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/fr/') THEN 'com/fr/'
  WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/') THEN 'org/' END AS rule FROM p JOIN b USING (host))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN lower > 0.3 THEN 'block' ELSE 'allow' END AS verdict FROM x
"""

_LLOYD_HEAD = """
WITH RECURSIVE kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS r, * FROM (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: floor(1024 * x)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
x AS MATERIALIZED (SELECT r, p, v[p * (len(v) // 4) + 1 : (p + 1) * (len(v) // 4)] AS c FROM kept, range(4) t(p)),
book0 AS MATERIALIZED (SELECT p, r - 1 AS e, c FROM x WHERE r <= 256)"""


def _lloyd_round(t: int) -> str:
    near = f"""near{t} AS MATERIALIZED (SELECT r, p, min(d * 256 + e) % 256 AS e, min(d) AS d FROM
  (SELECT r, x.p, e, list_sum(list_transform(list_zip(x.c, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM x JOIN book{t} b USING (p)) GROUP BY r, p)"""
    if t == 4:
        return near
    return near + f""",
sum{t} AS (SELECT p, e, list(m ORDER BY i) AS c FROM (SELECT p, e, i, floor(sum(c)::DOUBLE / count(*))::BIGINT AS m FROM (SELECT p, e, unnest(range(len(c))) AS i, unnest(c) AS c FROM x JOIN near{t} USING (r, p)) GROUP BY p, e, i) GROUP BY p, e),
book{t + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(s.c, b.c) AS c FROM book{t} b LEFT JOIN sum{t} s ON s.p = b.p AND s.e = b.e)"""


_OP11_SQL = ",\n".join([_LLOYD_HEAD, *map(_lloyd_round, range(5))]) + """,
done AS (SELECT r, string_agg(lower(lpad(to_hex(e), 2, '0')), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near4 GROUP BY r),
told AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book4)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN done USING (r), told
"""

#: A state of the repair is its cost, twelve digits, and its audit; so the least text is the least state.
_BIG = "'900000000000'"


def _add(state: str, cost: str, letter: str) -> str:
    return f"(lpad((left({state}, 12)::BIGINT + {cost})::VARCHAR, 12, '0') || substr({state}, 13) || {letter})"


def _turn(state: str, initial: str) -> str:
    """Keep or rerole, from a state."""
    fits = f"r.initial = '{initial}'"
    return f"CASE WHEN r.gone THEN {_BIG} ELSE {_add(state, f'r.extra + CASE WHEN {fits} THEN 0 ELSE 1 END', f"CASE WHEN {fits} THEN 'K' ELSE 'R' END")} END"


_DELETE = {k: _add(f"v.s{k}", "2", "'D'") for k in range(4)}
_OP12_SQL = f"""
WITH RECURSIVE known AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
hashed AS (SELECT *, xor(list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(name, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0])),
  lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295) % 20 AS h FROM known),
damaged AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hashed, range(2) t(n) WHERE h != 0 AND (n = 0 OR h = 3)),
ids AS (SELECT conv_id, row_number() OVER () AS cid FROM (SELECT DISTINCT conv_id FROM conversations)),
rows_ AS (SELECT ids.cid, d.turn, d.role, d.text, row_number() OVER (PARTITION BY ids.cid ORDER BY turn NULLS FIRST, role, text) AS pos FROM damaged d JOIN ids ON d.conv_id IS NOT DISTINCT FROM ids.conv_id),
faults AS (SELECT *, left(role, 1) AS initial, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS told, row_number() OVER (PARTITION BY cid, role, text ORDER BY pos) > 1 AS again FROM rows_),
r AS MATERIALIZED (SELECT *, told = '' AS blank, told != '' AND again AS duplicate, told != '' AND NOT again AND right(told, 1) NOT IN ('.', '!', '?') AS truncated, (told = '' OR again) AS gone,
  CASE WHEN told != '' AND NOT again AND right(told, 1) NOT IN ('.', '!', '?') THEN 5 ELSE 0 END AS extra FROM faults),
layers AS (SELECT cid, 0::BIGINT AS pos, '000000000000' AS s0, {_BIG} AS s1, '000000000005I' AS s2, '000000000010II' AS s3 FROM ids
  UNION ALL SELECT cid, pos, s0, s1, least(u2, {_add('u3', '5', "'I'")}) AS s2, u3 AS s3 FROM (
    SELECT *, least(m3, {_add('u2', '5', "'I'")}) AS u3 FROM (
      SELECT *, least(m2, {_add('s0', '5', "'I'")}, {_add('s1', '5', "'I'")}) AS u2 FROM (
        SELECT v.cid, r.pos, {_DELETE[0]} AS s0, least({_DELETE[1]}, CASE WHEN NOT r.gone AND r.initial = 's' THEN {_add('v.s0', 'r.extra', "'K'")} ELSE {_BIG} END) AS s1,
          least({_DELETE[2]}, {_turn('v.s0', 'u')}, {_turn('v.s1', 'u')}, {_turn('v.s3', 'u')}) AS m2, least({_DELETE[3]}, {_turn('v.s2', 'a')}) AS m3
        FROM layers v JOIN r ON r.cid = v.cid AND r.pos = v.pos + 1)))),
best AS (SELECT cid, left(s, 12)::BIGINT AS cost, substr(s, 13) AS audit FROM (SELECT cid, least(s0, s3) AS s FROM layers QUALIFY row_number() OVER (PARTITION BY cid ORDER BY pos DESC) = 1)),
letters AS (SELECT cid, i, audit[i] AS edit, i - len(replace(audit[:i], 'I', '')) AS inserted, len(replace(audit[:i], 'D', '')) AS place FROM best, unnest(range(1, len(audit) + 1)) t(i)),
lines AS (SELECT l.cid, l.i, l.edit, l.place, r.role, r.text, r.initial FROM letters l LEFT JOIN r ON r.cid = l.cid AND l.edit != 'I' AND r.pos = l.i - l.inserted WHERE l.edit != 'D'),
led AS (SELECT cid, count(*) FILTER (place = 1 AND edit = 'K' AND initial = 's') AS s FROM lines GROUP BY cid),
mended AS (SELECT cid, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY i) AS whole FROM lines JOIN led USING (cid) GROUP BY cid),
counts AS (SELECT cid, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated FROM r GROUP BY cid),
turns AS (SELECT cid, initial, lag(initial) OVER (PARTITION BY cid ORDER BY pos) AS before, pos FROM r),
bad AS (SELECT cid, count(*) FILTER (pos > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY cid)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  cost, audit, sha256(coalesce(whole, '')) AS repaired_sha256 FROM ids JOIN best USING (cid) LEFT JOIN counts USING (cid) LEFT JOIN bad USING (cid) LEFT JOIN mended USING (cid)
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_license_scan, op2_fingerprints, op3_quality_rules, quality_rules_low_limits, op4_mixing, op5_lm_scoring, op6_chat_formatting, op7_url_filters, op8_simhash_near_dedup, op9_packing, op10_suffix_array_dedup, op11_vector_codes, op12_conversation_repair, op13_byte_pairs, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_rules": _op3_sql(), "quality_rules_low_limits": f"SELECT doc_id, n_words, base_failed, lost, kept FROM ({_LOW_LIMITS_SQL})", "op7_url_filters": _OP7_SQL, "op11_vector_codes": _OP11_SQL, "op12_conversation_repair": _OP12_SQL}
