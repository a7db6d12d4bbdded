"""The registered query of each operator, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runpath.llm import bpe, decontaminate, katz, lexical, mixing, near_dedup, pii, repeats, secrets, sharding, topk, toxicity, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_katz": katz.op1_katz,
    "op2_deobfuscated_pii": pii.op2_deobfuscated_pii,
    "op3_suffix_automaton": decontaminate.op3_suffix_automaton,
    "op4_random_secrets": secrets.op4_random_secrets,
    "op5_minhash": near_dedup.op5_minhash,
    "op6_suffix_sort": repeats.op6_suffix_sort,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_virtual_slots": sharding.op8_virtual_slots,
    "op9_pareto_mix": mixing.op9_pareto_mix,
    "op10_branch_bound": topk.op10_branch_bound,
    "op11_block_lanczos": whitening.op11_block_lanczos,
    "op12_prefix_trie": bpe.op12_prefix_trie,
    "op13_threshold_search": lexical.op13_threshold_search,
}

_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3_SQL = rf"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 10) AS m, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS g FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT m FROM win),
d AS (SELECT doc_id, regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
pos AS (SELECT doc_id, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM d, sizes WHERE len(w) >= m),
hit AS (SELECT pos.doc_id, pos.i, pos.m, win.item FROM pos JOIN win ON pos.m = win.m AND array_to_string(pos.w[pos.i:pos.i + pos.m - 1], ' ') = win.g),
words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS l FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(l), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(l, ','), '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP5_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_FOLDED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' ')))) AS g FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON r.id = e.a),
k AS (SELECT id AS doc_id, min(c) AS component_id FROM r GROUP BY id)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, w.doc_id = component_id AS kept FROM w JOIN k USING (doc_id) LEFT JOIN n USING (doc_id)
"""

OP9_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(text, '')) AS digest FROM documents),
k AS (SELECT *, (CAST(('0x' || substr(md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || size || '|' || digest), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0 AS u FROM d),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
num AS (SELECT *, CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS DOUBLE) AS weight, CAST(source_size AS DOUBLE) * 2 AS cap FROM per),
lev AS (SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) * 150 / 100 AS total, coalesce(sum(cap) OVER o, 0.0) AS capped, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0.0) AS remaining FROM num
        WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
un AS (SELECT *, (total - capped) / remaining AS unit FROM lev),
goal AS (SELECT source, source_size, least(cap, coalesce(max(CASE WHEN unit * weight <= cap THEN unit END) OVER () * weight, cap)) AS target FROM un),
g AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS ratio FROM goal),
g2 AS (SELECT *, CAST(floor(ratio) AS BIGINT) AS sure, ratio - floor(ratio) AS f, target - CAST(floor(ratio) AS BIGINT) * source_size AS rest FROM g),
q AS (SELECT k.*, source_size, target, sure, rest, CASE WHEN rest > 0 AND size > 0 AND f > 0 THEN (u / (1 - u)) / (f / (1 - f)) END AS q FROM k JOIN g2 ON k.source IS NOT DISTINCT FROM g2.source),
o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY q, size, doc_id, digest) AS n FROM q WHERE q IS NOT NULL),
c AS (SELECT source, n, doc_id, digest, size <= rest AS took, rest, CASE WHEN size <= rest THEN size ELSE 0 END AS run FROM o WHERE n = 1
      UNION ALL SELECT o.source, o.n, o.doc_id, o.digest, c.run + o.size <= c.rest, c.rest, CASE WHEN c.run + o.size <= c.rest THEN c.run + o.size ELSE c.run END FROM c JOIN o ON o.source IS NOT DISTINCT FROM c.source AND o.n = c.n + 1),
x AS (SELECT q.doc_id, q.size, q.source_size, q.target, q.sure, coalesce(c.took, false) AS extra FROM q LEFT JOIN c ON q.source IS NOT DISTINCT FROM c.source AND q.doc_id = c.doc_id AND q.digest = c.digest)
SELECT doc_id, size, source_size, target, CASE WHEN size > 0 THEN sure + CAST(extra AS BIGINT) ELSE 0 END AS copies, CASE WHEN size > 0 THEN (sure + CAST(extra AS BIGINT)) * size ELSE 0 END AS taken FROM x
"""

#: Strings of some bytes of every text that start more than once, by a hash of their digits.
_REPEATED = """(SELECT doc_id, i FROM (SELECT doc_id, unnest(range(0, k)) AS i, unnest(list_transform(range(0, k), lambda i: hash(substr(h, 2 * i + 1, 2 * {0})))) AS w FROM (SELECT doc_id, h, len(h) // 2 - {0} + 1 AS k FROM b WHERE len(h) >= 2 * {0}))
 QUALIFY count(*) OVER (PARTITION BY w) > 1)"""

OP6_SQL = f"""
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
r AS {_REPEATED.format(400)},
e AS (SELECT doc_id, i, CASE WHEN i <= max(i + 400) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM r),
g AS (SELECT doc_id, min(i) AS lo, max(i) + 400 AS hi FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM e) GROUP BY doc_id, run),
p AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS at_ FROM g),
k AS (SELECT doc_id, string_agg(substr(h, 2 * at_ + 1, 2 * (lo - at_)), '' ORDER BY lo) || any_value(substr(h, 2 * (SELECT max(g.hi) FROM g WHERE g.doc_id = p.doc_id) + 1)) AS kept, sum(hi - lo) AS removed, count(*) AS spans FROM p JOIN b USING (doc_id) GROUP BY doc_id),
s AS (SELECT DISTINCT doc_id FROM {_REPEATED.format(250)})
SELECT b.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256, CASE WHEN s.doc_id IS NULL THEN 0 ELSE 1 END AS has_repeat
FROM b LEFT JOIN k USING (doc_id) LEFT JOIN s USING (doc_id)
"""

_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, len({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(reverse({_DIGITS})[i] AS INTEGER) ELSE [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][CAST(reverse({_DIGITS})[i] AS INTEGER) + 1] END)) % 10 = 0"


def _found(kinds: list[tuple[str, str, str]], order: str) -> str:
    """SQL: (doc_id, spans by kind, digest) of the matches of patterns (kind, pattern, what a match m must be) in every text; matches of a kind don't overlap."""
    parts = []
    for rank, (kind, pattern, test) in enumerate(kinds):
        # Where the matches stand follows from the lengths of what lies between them.
        parts.append(f"""SELECT doc_id, {rank} AS rank, '{kind}' AS kind, m, s, s + length(m) AS e FROM (SELECT doc_id, m, sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) - length(m) AS s
 FROM (SELECT doc_id, unnest(ms) AS m, unnest(string_split_regex(text, '{pattern}')[1:len(ms)]) AS g, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT doc_id, text, regexp_extract_all(text, '{pattern}') AS ms FROM t))) WHERE {test}""")
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k, *_ in kinds)
    return f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), f AS ({' UNION ALL '.join(parts)}), a AS (SELECT doc_id, {counts}, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY {order}) AS l FROM f GROUP BY doc_id)
SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k, *_ in kinds)}, sha256(coalesce(l, '')) AS base_sha256 FROM t LEFT JOIN a USING (doc_id)"""


PII_SQL = _found(
    [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR CAST('0' || left(ltrim(x, '0'), 4) AS INTEGER) > 255)) = 0"),
        ("card", r"[0-9](?:[\x20-]?[0-9])+", f"len({_DIGITS}) BETWEEN 16 AND 19 AND {_LUHN}"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"len({_DIGITS}) BETWEEN 8 AND 15"),
    ],
    "rank, s",
)
_ASSIGN = r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"\x27]?\x20*[:=]\x20*[\"\x27]?[A-Za-z0-9+/_.=-]+"
SECRETS_SQL = _found(
    [("assign", _ASSIGN, r"length(regexp_extract(m, '[:=]\x20*[\"\x27]?([A-Za-z0-9+/_.=-]+)$', 1)) >= 8"), ("access", r"AKIA[A-Z0-9]+", "length(m) >= 16"), ("hex", r"[0-9a-f]+", "length(m) >= 32")],
    "s, rank",
)


def _columns(name: str, *columns: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: QUERIES[name](spark, sf_dir).select(*columns)


#: What SQL can express of queries whose method adds to it: the same queries without what the method adds.
QUERIES |= {
    "pii_base_spans": _columns("op2_deobfuscated_pii", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"),
    "secret_base_spans": _columns("op4_random_secrets", "doc_id", "n_assign", "n_access", "n_hex", "base_sha256"),
    "language_model_counts": lambda spark, sf_dir: QUERIES["op1_katz"](spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 5).alias("base_score")),
    "embedding_deviations": lambda spark, sf_dir: QUERIES["op11_block_lanczos"](spark, sf_dir).where("component = 1").select("vec_id", "n", "deviation"),
}

KATZ_SQL = r"""
WITH RECURSIVE c AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS s, 0 AS at_, 0 AS bit, CAST(4294967295 AS BIGINT) AS crc FROM documents
  UNION ALL SELECT doc_id, s, CASE WHEN bit = 8 THEN at_ + 1 ELSE at_ END, CASE WHEN bit = 8 THEN 0 ELSE bit + 1 END,
   CASE WHEN bit = 0 THEN xor(crc, CAST(ord(s[at_ + 1]) AS BIGINT)) WHEN crc % 2 = 1 THEN xor(crc // 2, 3988292384) ELSE crc // 2 END FROM c WHERE at_ < length(s)),
h AS (SELECT doc_id, xor(crc, 4294967295) % 7 = 2 AS held_out FROM c WHERE at_ = length(s)),
w AS (SELECT doc_id, held_out, unnest(list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' ')) AS w FROM documents JOIN h USING (doc_id)),
k AS (SELECT w, count(*) AS c FROM w WHERE NOT held_out GROUP BY w), n AS (SELECT coalesce(sum(c), 0) AS n, count(*) AS v FROM k)
SELECT doc_id, any_value(held_out) AS held_out, count(*) AS n_tokens, count(k.c) AS n_known, CAST(any_value(n.n) AS BIGINT) AS train_tokens, round(sum(log10((coalesce(k.c, 0) + 1) / (n.n + n.v + 1))), 5) AS base_score
FROM w LEFT JOIN k USING (w), n GROUP BY doc_id
"""


ORACLE_SQL: dict[str, str] = {
    "op3_suffix_automaton": OP3_SQL,
    "op5_minhash": OP5_SQL,
    "op6_suffix_sort": OP6_SQL,
    "pii_base_spans": PII_SQL,
    "secret_base_spans": SECRETS_SQL,
    "language_model_counts": KATZ_SQL,
    "op9_pareto_mix": OP9_SQL,
    "op10_branch_bound": topk.OP10_SQL,
    "embedding_deviations": whitening.DEVIATIONS_SQL,
    "op13_threshold_search": lexical.OP13_SQL,
}
