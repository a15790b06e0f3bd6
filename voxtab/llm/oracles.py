"""DuckDB SQL of the manifest, the conversation repair and the license scan."""

from __future__ import annotations

from voxtab.llm.licenses import LOWER, SEPARATORS, UPPER, WEIGHTS, keywords, rules


def crc32(text: str) -> str:
    """The CRC-32 of an ASCII string, bit by bit: before every eighth bit the next byte comes in."""
    byte = f"CASE WHEN i % 8 = 0 THEN ascii(substr({text}, CAST(i // 8 + 1 AS INTEGER), 1)) ELSE 0 END"
    bits = f"list_transform(range(8 * length({text})), lambda i: CAST({byte} AS BIGINT))"
    step = "lambda c, e: xor(xor(c, e) >> 1, (xor(c, e) & 1) * 3988292384)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}), {step}), 4294967295::BIGINT)"


def _field(c: str) -> str:
    return f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join([*[_field(c) for c in ('doc_id', 'source', 'lang', 'n_chars')], _field(text)])})"


MERKLE = f"""
    WITH RECURSIVE l AS (
        SELECT row_number() OVER () AS rid, doc_id, source, {_leaf('text')} AS leaf,
               CASE WHEN doc_id IS NOT NULL AND {crc32('doc_id::VARCHAR')} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf('text')} END AS other
        FROM documents),
    n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l),
    tree AS (
        SELECT source, 0 AS lvl, pos, leaf AS h, count(*) OVER (PARTITION BY source) AS n FROM n
        UNION ALL SELECT source, lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 2) // 3 FROM tree WHERE n > 1 GROUP BY source, lvl, pos // 3),
    sub AS (SELECT source, h, lvl AS depth, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos FROM tree WHERE n = 1),
    top AS (
        SELECT 0 AS lvl, pos, h, count(*) OVER () AS n FROM sub
        UNION ALL SELECT lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 2) // 3 FROM top WHERE n > 1 GROUP BY lvl, pos // 3),
    steps AS (
        SELECT n.rid, t.lvl, n.pos // CAST(pow(3, t.lvl) AS BIGINT) AS at, n.source FROM n JOIN (SELECT DISTINCT source, lvl FROM tree WHERE n > 1) t ON t.source IS NOT DISTINCT FROM n.source),
    tops AS (
        SELECT s.source, s.depth, t.lvl, s.pos // CAST(pow(3, t.lvl) AS BIGINT) AS at FROM sub s, (SELECT DISTINCT lvl FROM top WHERE n > 1) t),
    sib AS (
        SELECT s.rid, s.lvl, coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos < s.at), '') AS a, coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos > s.at), '') AS b
        FROM steps s JOIN tree t ON t.source IS NOT DISTINCT FROM s.source AND t.lvl = s.lvl AND t.pos // 3 = s.at // 3 GROUP BY 1, 2
        UNION ALL
        SELECT n.rid, x.depth + x.lvl, x.a, x.b FROM n JOIN (
            SELECT s.source, s.depth, s.lvl, coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos < s.at), '') AS a, coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos > s.at), '') AS b
            FROM tops s JOIN top t ON t.lvl = s.lvl AND t.pos // 3 = s.at // 3 GROUP BY 1, 2, 3) x ON x.source IS NOT DISTINCT FROM n.source),
    fold AS (
        SELECT rid, 0 AS lvl, other AS h FROM n
        UNION ALL SELECT f.rid, f.lvl + 1, sha256(s.a || f.h || s.b) FROM fold f JOIN sib s ON s.rid = f.rid AND s.lvl = f.lvl),
    done AS (SELECT rid, arg_max(h, lvl) AS folded_root FROM fold GROUP BY 1),
    proofs AS (SELECT rid, sha256(string_agg(a || b, '' ORDER BY lvl)) AS proof_sha256 FROM sib GROUP BY 1)
    SELECT n.doc_id, n.leaf, sub.h AS subroot, r.h AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, d.folded_root, d.folded_root = r.h AS verified
    FROM n JOIN sub ON sub.source IS NOT DISTINCT FROM n.source JOIN done d USING (rid) LEFT JOIN proofs p USING (rid), (SELECT h FROM top WHERE n = 1) r
"""

#: States are n (nothing yet), s, u, a. Between rows up to three turns are inserted; then a row is dropped, kept or given the wanted role.
REPAIR = f"""
    WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
    c AS (SELECT *, {crc32('key')} % 20 AS kind FROM k),
    d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
          FROM c, range(2) t(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
    o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS r, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS w FROM d),
    f AS (SELECT *, CASE WHEN w = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(w, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
                 lag(r) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
    ins(q, q2, t, line) AS (VALUES ('n','n','',''), ('n','u','I','user:'), ('n','a','II','user:' || chr(10) || 'assistant:'), ('n','u','III','user:' || chr(10) || 'assistant:' || chr(10) || 'user:'),
        ('s','s','',''), ('s','u','I','user:'), ('s','a','II','user:' || chr(10) || 'assistant:'), ('s','u','III','user:' || chr(10) || 'assistant:' || chr(10) || 'user:'),
        ('u','u','',''), ('u','a','I','assistant:'), ('u','u','II','assistant:' || chr(10) || 'user:'), ('u','a','III','assistant:' || chr(10) || 'user:' || chr(10) || 'assistant:'),
        ('a','a','',''), ('a','u','I','user:'), ('a','a','II','user:' || chr(10) || 'assistant:'), ('a','u','III','user:' || chr(10) || 'assistant:' || chr(10) || 'user:')),
    g(q, r, q2) AS (VALUES ('n','s','s'), ('n','u','u'), ('s','u','u'), ('u','a','a'), ('a','u','u')),
    wants(q, role, q2) AS (VALUES ('n','user','u'), ('s','user','u'), ('u','assistant','a'), ('a','user','u')),
    edit AS (
        SELECT q, q AS q2, conv_id, i, 4 AS cost, 'D' AS e, '' AS line FROM f, (SELECT DISTINCT q FROM ins)
        UNION ALL SELECT g.q, g.q2, conv_id, i, CASE WHEN fault = '' THEN 0 ELSE 3 END, 'K', role || ':' || text FROM f JOIN g USING (r) WHERE fault IN ('', 'truncated')
        UNION ALL SELECT w.q, w.q2, conv_id, i, CASE WHEN fault = '' THEN 3 ELSE 6 END, 'R', w.role || ':' || text FROM f, wants w WHERE fault IN ('', 'truncated')),
    best AS (
        SELECT conv_id, 0 AS i, 'n' AS q, {{'cost': 0, 'audit': '', 'text': ''}} AS v FROM (SELECT DISTINCT conv_id FROM f)
        UNION ALL
        SELECT b.conv_id, b.i + 1, e.q2, min({{'cost': b.v.cost + 3 * length(s.t) + e.cost, 'audit': b.v.audit || s.t || e.e,
                   'text': b.v.text || CASE WHEN s.line <> '' THEN CASE WHEN b.v.text <> '' THEN chr(10) ELSE '' END || s.line ELSE '' END
                           || CASE WHEN e.line <> '' THEN CASE WHEN b.v.text <> '' OR s.line <> '' THEN chr(10) ELSE '' END || e.line ELSE '' END}})
        FROM best b JOIN ins s ON s.q = b.q JOIN edit e ON e.conv_id IS NOT DISTINCT FROM b.conv_id AND e.i = b.i + 1 AND e.q = s.q2 GROUP BY 1, 2, 3),
    last AS (SELECT conv_id, max(i) AS n FROM f GROUP BY 1),
    goal AS (
        SELECT b.conv_id, min({{'cost': b.v.cost + 3 * length(s.t), 'audit': b.v.audit || s.t, 'text': b.v.text || CASE WHEN s.line <> '' AND b.v.text <> '' THEN chr(10) ELSE '' END || s.line}}) AS v
        FROM best b JOIN last ON last.conv_id IS NOT DISTINCT FROM b.conv_id AND last.n = b.i JOIN ins s ON s.q = b.q WHERE s.q2 IN ('n', 'a') GROUP BY 1),
    counts AS (
        SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
               count(*) FILTER (before IS NOT NULL AND before || r NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY 1)
    SELECT c.conv_id, coalesce(n.gaps, 0)::BIGINT AS gaps, coalesce(n.blank, 0) AS blank, coalesce(n.duplicate, 0) AS duplicate, coalesce(n.truncated, 0) AS truncated, coalesce(n.illegal, 0) AS illegal,
           coalesce(g.v.cost, 0)::BIGINT AS cost, coalesce(g.v.audit, '') AS audit, sha256(coalesce(g.v.text, '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN counts n ON n.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN goal g ON g.conv_id IS NOT DISTINCT FROM c.conv_id
"""


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_RULES = ", ".join(f"({i}, {_text(kind)}, {_text(label)}, {p}, [{', '.join(map(_text, keywords(keyword)))}], {_text(pattern)})" for i, kind, label, p, keyword, pattern in rules())
_WEIGHT = "CASE priority " + " ".join(f"WHEN {p} THEN {w}::DOUBLE" for p, w in WEIGHTS.items()) + " END"

LICENSES = rf"""
    WITH rules(no, rule, label, priority, keywords, pattern) AS (VALUES {_RULES}),
    w AS (SELECT row_number() OVER () AS rid, doc_id, trim(regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SEPARATORS}', '  ', 'g'), ' ') AS w FROM documents),
    d AS (SELECT rid, doc_id, CASE WHEN w = '' THEN '' ELSE ' ' || w || ' ' END AS t FROM w),
    m AS (SELECT rid, no, rule, label, priority, string_split_regex(t, pattern) AS gaps, regexp_extract_all(t, pattern) AS hits
          FROM d JOIN rules ON len(list_filter(keywords, lambda k: contains(t, k))) > 0),
    s AS (SELECT rid, no, rule, label, priority, CAST(len(gaps[h]) - len(replace(gaps[h], ' ', '')) AS BIGINT) // 2 AS gap, CAST(len(hits[h]) - len(replace(hits[h], ' ', '')) AS BIGINT) // 2 AS hit, h
          FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS h FROM m WHERE len(hits) > 0)),
    p AS (SELECT *, (sum(gap + hit) OVER (PARTITION BY rid, no ORDER BY h) - hit)::BIGINT AS start, sum(gap + hit) OVER (PARTITION BY rid, no ORDER BY h)::BIGINT AS stop FROM s),
    x AS (SELECT rid, rule = 'base' AS base, label, start, {_WEIGHT} AS weight,
                 NOT EXISTS (SELECT 1 FROM p o WHERE o.rid = p.rid AND o.start <= p.start AND o.stop >= p.stop AND o.priority <= p.priority
                     AND (o.start < p.start OR o.stop > p.stop OR o.priority < p.priority OR o.no < p.no)) AS kept FROM p),
    y AS (SELECT rid, label, count(*) FILTER (base) AS n, min(start) FILTER (base) AS a, max(start) FILTER (base) AS b, max(weight) AS weight FROM x WHERE kept OR base GROUP BY 1, 2),
    z AS (SELECT rid, sum(n) AS n, min(a) AS a, max(b) AS b, string_agg(label, ',' ORDER BY label) FILTER (n > 0) AS base_labels, string_agg(label, ',' ORDER BY label) AS labels, product(1 - weight) AS rest FROM y GROUP BY 1)
    SELECT doc_id, CAST(len(t) - len(replace(t, ' ', '')) AS BIGINT) // 2 AS n_words, coalesce(z.n, 0)::BIGINT AS n_base, z.a AS first_word, z.b AS last_word,
           coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(1 - coalesce(rest, 1), 6) AS score
    FROM d LEFT JOIN z USING (rid)
"""
