"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

import re

from surveyq.llm.license_scan import BASE, TEMPLATES
from surveyq.llm.sharding import MULTIPLIER

_LOWER = "translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(column: str, pattern: str) -> str:
    return f"regexp_extract_all({_LOWER.format(t=column)}, '{pattern}')"


_ALNUM, _SOLID = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x20\x09-\x0D]+"


def _regex(markup: str) -> str:
    """A template as a pattern over words that each follow a space."""
    out = []
    for part in re.split(r"(<<optional>>|<</optional>>|<<any \d+>>)", markup):
        if part == "<<optional>>":
            out.append("(?:")
        elif part == "<</optional>>":
            out.append(")?")
        elif part.startswith("<<any "):
            out.append(f"(?: [^ ]+){{0,{part[6:-2]}}}")
        else:
            out += [f" {w}" for w in part.split()]
    return "".join(out) + "(?: |$)"


def _licenses() -> str:
    def places(phrase: str) -> str:
        words = phrase.split()
        wanted = ", ".join(f"'{w}'" for w in words)
        return f"list_filter(range(1, len(w) - {len(words) - 2}), lambda i: w[i : i + {len(words) - 1}] = [{wanted}])"

    cols = ", ".join(f"{places(p)} AS p{k}" for k, (_, p) in enumerate(BASE))
    base = ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, (label, _) in enumerate(BASE))
    whole = ", ".join(f"CASE WHEN regexp_matches(s, '{_regex(m)}') THEN '{label}' END" for label, m in TEMPLATES)
    every = "list_concat(list_concat(p0, p1), p2)"
    text = "array_to_string(list_sort(list_distinct({l})), ',')"
    return f"""
WITH w AS (SELECT doc_id, {_words('text', _ALNUM)} AS w FROM documents),
p AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') AS s, {cols} FROM w),
l AS (SELECT doc_id, len(w) AS n, {every} AS p, list_filter([{base}], lambda x: x IS NOT NULL) AS b, list_filter([{whole}], lambda x: x IS NOT NULL) AS t FROM p)
SELECT doc_id, n AS n_words, len(p) AS n_base, list_min(p) - 1 AS first_word, list_max(p) - 1 AS last_word, {text.format(l='b')} AS base_labels,
  {text.format(l='list_concat(b, t)')} AS labels, CASE WHEN len(t) > 0 THEN 1.0 WHEN len(b) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score FROM l"""


_CONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_words('text', _ALNUM)} AS w FROM documents), b AS (SELECT item_id, {_words('text', _ALNUM)} AS w FROM benchmark),
v AS (SELECT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM (
  SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
g AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM v))),
h AS (SELECT DISTINCT doc_id, i, n, item_id FROM g JOIN v USING (n, g)),
p AS (SELECT doc_id, count(DISTINCT x) AS k FROM (SELECT doc_id, unnest(range(i, i + n)) AS x FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS k, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(p.k, 0) AS n_hit, coalesce(t.k, 0) AS n_items, sha256(coalesce(t.s, '')) AS items_sha256, coalesce(p.k, 0) > 0 AS contaminated
FROM d LEFT JOIN p ON p.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id"""

_LINES = f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS s, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, trim({_LOWER.format(t='s')}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k FROM l),
m AS (SELECT *, length(k) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY k) AS gone FROM k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(s, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id"""

_NEAR = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_words('text', _SOLID)} AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g FROM w),
n AS (SELECT w.doc_id, count(s.g) AS n FROM w LEFT JOIN s ON s.doc_id = w.doc_id GROUP BY w.doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 85 * (a.n + b.n - k)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id)
SELECT n.doc_id, n.n AS n_shingles, min(r.c) AS component_id, n.doc_id = min(r.c) AS kept FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY n.doc_id, n.n"""


def _crc32(hexed: str) -> str:
    """Byte by byte over a hex string, with the table t that _SHARDS derives from the polynomial."""
    digit = lambda at: f"(strpos('0123456789ABCDEF', substr({hexed}, {at}, 1)) - 1)"
    data = f"list_transform(range(1, length({hexed}), 2), lambda i: {digit('i')} * 16 + {digit('i + 1')})"
    return f"xor(4294967295, list_reduce({data}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295))"


def _jump(shards: int) -> str:
    k = f"((acc.k * {MULTIPLIER}::UHUGEINT + 1) % 18446744073709551616::UHUGEINT)"
    step = f"{{'b': acc.j, 'j': floor((acc.j + 1)::DOUBLE * (2147483648.0::DOUBLE / (({k} // 8589934592) + 1)::DOUBLE))::BIGINT, 'k': {k}}}"
    start = "{'b': -1::BIGINT, 'j': 0::BIGINT, 'k': doc_id::UHUGEINT}"
    return f"(list_reduce(range({shards}), lambda acc, x: CASE WHEN acc.j < {shards} THEN {step} ELSE acc END, {start}).b)::INT"


_SHARDS = f"""
WITH t AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, n)) AS t),
h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, hex(encode(doc_id::VARCHAR)) AS hi FROM documents),
c AS (SELECT doc_id, length(h) // 2 + 8 AS size, {_crc32('h')} AS text_crc32, {_crc32('hi')} % 512 AS part, {_jump(24)} AS shard, {_jump(25)} AS grown_shard FROM h, t)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY part, doc_id, text_crc32, size) - 1 AS slot, grown_shard FROM c"""

_TABLE = "t AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, n)) AS t)"

_SNAPSHOTS = f"""
WITH {_TABLE}, d AS (SELECT doc_id AS k, text, lang, source, {_crc32('hex(encode(doc_id::VARCHAR))')} % 16 AS m FROM documents, t),
n AS (SELECT CASE WHEN m IN (3, 4) THEN -1 - k ELSE k END AS k, CASE WHEN m = 1 THEN coalesce(text, '') || '+' ELSE text END AS text,
  CASE WHEN m = 2 THEN source ELSE lang END AS lang, CASE WHEN m = 2 THEN lang WHEN m = 4 THEN NULL ELSE source END AS source FROM d WHERE m IS NULL OR m <> 0
  UNION ALL SELECT -1 - k, text, lang, source FROM d WHERE m = 5),
a AS (SELECT d.*, row_number() OVER (PARTITION BY text ORDER BY k) AS i FROM d WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.k IS NOT DISTINCT FROM d.k)),
b AS (SELECT n.*, row_number() OVER (PARTITION BY text ORDER BY k) AS i FROM n WHERE NOT EXISTS (SELECT 1 FROM d WHERE n.k IS NOT DISTINCT FROM d.k)),
p AS (SELECT 'k' AS how, d.k AS ok, d.text AS ot, d.lang AS ol, d.source AS os, true AS o, n.k AS nk, n.text AS nt, n.lang AS nl, n.source AS ns, true AS n FROM d JOIN n ON d.k IS NOT DISTINCT FROM n.k
  UNION ALL SELECT 'c', a.k, a.text, a.lang, a.source, a.i IS NOT NULL, b.k, b.text, b.lang, b.source, b.i IS NOT NULL FROM a FULL JOIN b ON a.i = b.i AND a.text IS NOT DISTINCT FROM b.text),
c AS (SELECT *, CASE WHEN o AND n THEN concat_ws(',', CASE WHEN ot IS DISTINCT FROM nt THEN 'text' END, CASE WHEN ol IS DISTINCT FROM nl THEN 'lang' END, CASE WHEN os IS DISTINCT FROM ns THEN 'source' END) ELSE '' END AS changed FROM p)
SELECT CASE WHEN n THEN nk ELSE ok END AS key, ok AS old_key, CASE WHEN NOT n THEN 'delete' WHEN NOT o THEN 'insert' WHEN how = 'c' THEN 'rekey' WHEN changed = '' THEN 'same' ELSE 'update' END AS op, changed,
  CASE WHEN n THEN sha256(coalesce(nt, '~') || chr(10) || coalesce(nl, '~') || chr(10) || coalesce(ns, '~')) END AS row_sha256 FROM c"""

_TRIE = f"""
WITH {_TABLE}, r AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS p FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT DISTINCT c, {_crc32('hex(encode(c::VARCHAR))')} % 6 AS h, c - c % 100 AS b FROM r, t),
u AS (SELECT c.c, p AS o, r, x FROM c JOIN r ON r.c = b AND p <= h UNION ALL SELECT c.c, p + 10, r, x FROM c JOIN r ON r.c = c.c AND p > h),
w AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY o) AS d FROM u),
m AS (SELECT c, d, md5(string_agg(length(r) || ':' || r || length(x) || ':' || x, '') OVER (PARTITION BY c ORDER BY d)) AS k, x FROM w UNION ALL SELECT c, 0, '', '' FROM c),
n AS (SELECT d, k, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(length(x)) AS saved FROM m GROUP BY d, k),
e AS (SELECT DISTINCT a.d, a.k, b.k AS up FROM m a JOIN m b ON a.c = b.c AND b.d = a.d - 1),
i AS (SELECT d - 1 AS d, up AS k, count(*) AS n_children FROM e GROUP BY 1, 2),
s AS (SELECT DISTINCT a.d, a.k, b.d AS d2, b.k AS k2 FROM m a JOIN m b ON a.c = b.c AND b.d >= a.d),
y AS (SELECT s.d, s.k, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (i.d IS NULL) AS n_leaves FROM s JOIN n ON n.d = d2 AND n.k = k2 LEFT JOIN i ON i.d = d2 AND i.k = k2 GROUP BY 1, 2),
z AS (SELECT d, k, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS z FROM m JOIN (SELECT c, max(d) AS d FROM m GROUP BY c) USING (c, d) GROUP BY 1, 2)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(i.n_children, 0) AS n_children, n_leaves, saved_tokens, coalesce(z, sha256('')) AS ends_sha256
FROM n JOIN y ON y.d = n.d AND y.k = n.k LEFT JOIN i ON i.d = n.d AND i.k = n.k LEFT JOIN e ON e.d = n.d AND e.k = n.k LEFT JOIN n p ON p.d = n.d - 1 AND p.k = e.up LEFT JOIN z ON z.d = n.d AND z.k = n.k"""

ORACLES = {
    "op1_license_scan": _licenses(),
    "op2_sharding": _SHARDS,
    "op4_decontaminate": _CONTAMINATION,
    "op6_line_dedup": _LINES,
    "op10_near_dup": _NEAR,
    "op12_snapshot_diff": _SNAPSHOTS,
    "op13_prefix_trie": _TRIE,
}
