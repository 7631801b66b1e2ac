"""DuckDB SQL for the queries that SQL can express."""

from itertools import permutations

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UP}', '{LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UP}', '{LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bs AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(greatest(len(w) - 10, 0) + 1)) AS s FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[s + 1:s + n], ' ') AS t FROM bs),
ns AS (SELECT DISTINCT n FROM bw),
ds AS (SELECT k, n, w, unnest(range(len(w) - n + 1)) AS s FROM d, ns WHERE len(w) >= n),
dw AS (SELECT k, n, s, array_to_string(w[s + 1:s + n], ' ') AS t FROM ds),
hit AS (SELECT dw.k, dw.s, dw.n, bw.item_id FROM dw JOIN bw ON dw.t = bw.t AND dw.n = bw.n),
pos AS (SELECT DISTINCT k, unnest(range(s, s + n)) AS p FROM hit),
np AS (SELECT k, count(*) AS n_hit FROM pos GROUP BY k),
it AS (SELECT k, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY k)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(np.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(it.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(it.items, '')) AS items_sha256, coalesce(np.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN np USING (k) LEFT JOIN it USING (k)
"""

OP5 = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
e AS (SELECT k, unnest(l) AS line, generate_subscripts(l, 1) AS p FROM d),
f AS (SELECT k, p, line, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), '{UP}', '{LOW}') AS key FROM e),
c AS (SELECT key FROM f WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT k) >= 10),
g AS (SELECT f.k, f.p, f.line, c.key IS NOT NULL AS hot FROM f LEFT JOIN c ON f.key = c.key),
h AS (SELECT k, count(*) AS n_lines, count(*) FILTER (hot) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT hot), '') AS kept FROM g GROUP BY k)
SELECT d.doc_id, CAST(h.n_lines AS BIGINT) AS n_lines, CAST(h.n_dropped AS BIGINT) AS n_dropped, sha256(h.kept) AS kept_sha256
FROM d JOIN h USING (k)
"""

OP6 = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT h, payload_bytes, max(page_id) AS largest FROM p GROUP BY ALL)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST((CAST(concat('0x', substr(h, CAST(5 * (i // 4) + 1 AS INT), 5)) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31 AS INT) + 1, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> largest THEN largest END AS refers_to
FROM p JOIN g USING (h, payload_bytes)
"""

#: CRC-32 of the ASCII text x, bit by bit; -1 in the list stands for a shift.
CRC32 = """xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(range(length(x)),
  lambda i: list_concat([CAST(ascii(substr(x, CAST(i + 1 AS INT), 1)) AS BIGINT)], [-1, -1, -1, -1, -1, -1, -1, -1])))),
  lambda c, t: CASE WHEN t >= 0 THEN xor(c, t) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)"""


def _field(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE concat(CAST(strlen(CAST({column} AS VARCHAR)) AS VARCHAR), ':', CAST({column} AS VARCHAR)) END"


def _leaf(text: str) -> str:
    return f"sha256(concat({', '.join(map(_field, ('doc_id', 'source', 'lang', 'n_chars', text)))}))"


def _levels(name: str, start: str) -> str:
    """All levels of the trees over ``start`` (g, pos, h, n): level 0 is ``start``, the last the roots."""
    return f"""
{name} AS (
  SELECT 0 AS lvl, g, pos, h, n FROM {start}
  UNION ALL
  SELECT lvl + 1, g, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (max(n) + 2) // 3 FROM {name} WHERE n > 1 GROUP BY lvl, g, pos // 3)"""


OP11 = f"""
WITH RECURSIVE
d AS (SELECT row_number() OVER () AS k, doc_id, source, concat(CASE WHEN source IS NULL THEN 'n' ELSE 's' END, coalesce(source, '')) AS g, {_leaf('text')} AS leaf,
      CASE WHEN doc_id IS NOT NULL AND ({CRC32.replace('x)', 'CAST(doc_id AS VARCHAR))').replace('x,', 'CAST(doc_id AS VARCHAR),')}) % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} END AS other
      FROM documents),
l AS (SELECT k, g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM d),
{_levels('t', 'l')},
r AS (SELECT g, h FROM t WHERE n = 1),
s AS (SELECT 'all' AS g, g AS of, row_number() OVER (ORDER BY g) - 1 AS pos, h, count(*) OVER () AS n FROM r),
{_levels('u', 's')},
low AS (SELECT l.k, t.lvl, t.pos, l.pos // CAST(pow(3, t.lvl) AS BIGINT) AS own, t.h FROM l JOIN t ON t.g = l.g AND t.n > 1 AND t.pos // 3 = l.pos // CAST(pow(3, t.lvl + 1) AS BIGINT)),
high AS (SELECT l.k, 100 + u.lvl AS lvl, u.pos, s.pos // CAST(pow(3, u.lvl) AS BIGINT) AS own, u.h FROM l JOIN s ON s.of = l.g JOIN u ON u.n > 1 AND u.pos // 3 = s.pos // CAST(pow(3, u.lvl + 1) AS BIGINT)),
every AS (SELECT * FROM low UNION ALL SELECT * FROM high),
step AS (SELECT k, lvl, coalesce(string_agg(h, '' ORDER BY pos) FILTER (pos < own), '') AS a, coalesce(string_agg(h, '' ORDER BY pos) FILTER (pos > own), '') AS b,
         row_number() OVER (PARTITION BY k ORDER BY lvl) AS i FROM every GROUP BY k, lvl),
proof AS (SELECT k, sha256(string_agg(concat(a, b), '' ORDER BY i)) AS p, max(i) AS steps FROM step GROUP BY k),
f AS (
  SELECT k, CAST(0 AS BIGINT) AS i, coalesce(other, leaf) AS h FROM d
  UNION ALL
  SELECT f.k, step.i, sha256(concat(step.a, f.h, step.b)) FROM f JOIN step ON step.k = f.k AND step.i = f.i + 1)
SELECT d.doc_id, d.leaf, r.h AS subroot, top.h AS root, coalesce(proof.p, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = top.h AS verified
FROM d JOIN r ON r.g = d.g JOIN (SELECT h FROM u WHERE n = 1) AS top ON true LEFT JOIN proof ON proof.k = d.k JOIN f ON f.k = d.k AND f.i = coalesce(proof.steps, 0)
"""

_ORDERS = ["".join(p) for p in permutations("ABCDE")]
_BIT = {f: 1 << i for i, f in enumerate("ABCDE")}
_STEPS = ", ".join(
    f"('{o}', {k + 1}, {_BIT[f]}, {sum(_BIT[x] for x in o[:k])})" for o in _ORDERS for k, f in enumerate(o)
)

# every order and step counted from the masks themselves, and the removals summed over all orders
OP13 = rf"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS l FROM documents),
least AS (SELECT t, min(doc_id) AS m FROM w GROUP BY t),
lab AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
      CASE WHEN len(l) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(l)) < 50 * len(l) THEN 2 ELSE 0 END
      + CASE WHEN 100 * length(regexp_replace(w.t, '[^A-Z]', '', 'g')) > 3 * length(w.t) THEN 4 ELSE 0 END
      + CASE WHEN regexp_matches(w.t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN w.doc_id > m THEN 16 ELSE 0 END AS mask
      FROM w JOIN least ON w.t = least.t LEFT JOIN lab ON lab.doc_id = w.doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY part, mask),
s(filter_order, step, own, before) AS (VALUES {_STEPS}),
r AS (SELECT part, filter_order, step, own,
        sum(CASE WHEN mask & (before | own) = 0 THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN mask & own > 0 AND mask & before > 0 THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost,
        sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
      FROM c JOIN s ON true GROUP BY part, filter_order, step, own)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM r
"""

ORACLES = {"op6_warc": OP6, "op1_decontaminate": OP1, "op5_line_dedup": OP5, "op11_merkle_manifest": OP11, "op13_filter_audit": OP13}
