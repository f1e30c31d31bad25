"""SQL (DuckDB) that gives the rows of the queries, for those that SQL can express.

The others (models, edit distance, rendering, content-defined chunks, byte strings of whole texts, tokens) are
tested against brute force on small tables.
"""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"

# reach: (node, other) for all nodes that a path of links connects; links has both directions.
REACH = """reach(node, other) AS (
  SELECT a, b FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a)"""

OP1 = f"""WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS s FROM words),
entries AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM entries x JOIN entries y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
{REACH}
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles,
  least(doc_id, coalesce((SELECT min(other) FROM reach WHERE node = doc_id), doc_id)) AS component_id FROM sets"""

OP5 = f"""WITH RECURSIVE usable AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x FOR x IN embedding IF x <> 0]) > 0),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM usable x JOIN usable y ON x.vec_id <> y.vec_id AND len(x.v) = len(y.v)
  WHERE list_cosine_similarity(x.v, y.v) >= 0.9),
{REACH},
found AS (
  SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links,
    least(vec_id, coalesce((SELECT min(other) FROM reach WHERE node = vec_id), vec_id)) AS component_id FROM embeddings)
SELECT *, vec_id = component_id AS kept FROM found"""

URL = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)([^?]*)\??(.*)$"

OP7 = f"""WITH bare AS (SELECT page_id, html, regexp_replace(trim(url), '(?s)#.*$', '') AS bare FROM pages),
parts AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '{URL}', 1)), '^www\\.', ''), ':(80|443)$', '') AS host,
    regexp_replace(regexp_extract(bare, '{URL}', 2), '/+$', '') AS path,
    list_sort([x FOR x IN string_split(regexp_extract(bare, '{URL}', 3), '&') IF x <> '' AND NOT starts_with(x, 'utm_')])
      AS fields FROM bare),
records AS (
  SELECT page_id, CASE WHEN regexp_matches(bare, '{URL}')
      THEN host || path || CASE WHEN len(fields) > 0 THEN '?' || array_to_string(fields, '&') ELSE '' END
    WHEN bare <> '' THEN bare END AS place,
    '"' || md5(html) || '"' AS tag, 'day ' || page_id // 100 AS changed, md5(html) AS digest, strlen(html) AS size,
    page_id + CASE WHEN page_id % 13 = 0 THEN -1000 ELSE 1000 END AS moment FROM parts),
found AS (
  SELECT v.page_id, v.place, v.moment, v.tag, v.changed, max(r.page_id) AS response FROM records v
  LEFT JOIN records r ON r.place = v.place AND r.page_id < v.moment GROUP BY ALL),
judged AS (
  SELECT f.*, r.digest, r.size, CASE WHEN response IS NULL THEN 'no_earlier_response'
    WHEN f.page_id % 77 = 0 THEN 'no_validator'
    WHEN CASE WHEN f.page_id % 11 <> 0 THEN f.page_id % 7 <> 0 AND f.tag = r.tag ELSE f.changed = r.changed END
      THEN 'resolved' ELSE 'validator_mismatch' END AS outcome
  FROM found f LEFT JOIN records r ON r.page_id = f.response)
SELECT page_id * 2 + 1 AS record_id, place AS canonical_url, moment AS captured, response * 2 AS response_id, outcome,
  CASE WHEN outcome = 'resolved' THEN digest END AS digest,
  CASE WHEN outcome = 'resolved' THEN 'content-length: ' || size || '; content-type: text/html; date: moment '
    || moment || '; x-cache: hit' END AS headers
FROM judged"""


OP9 = f"""WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size,
    md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':'
      || len(regexp_extract_all(coalesce(text, ''), '{WORD}')) || ':' || coalesce(md5(text), '')) AS h FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, 3 * source_size AS cap,
    CAST(sum(source_size) OVER () AS BIGINT) AS total FROM sources),
levels AS (
  SELECT *, CAST(total - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS n,
    CAST(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS d
  FROM weighed),
level AS (SELECT arg_max(struct_pack(n, d), n / d) AS best FROM levels),
targets AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), best.n * w / best.d) AS target FROM weighed, level),
planned AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) // source_size ELSE 0 END AS copies,
    CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) % source_size ELSE 0 END AS rest FROM targets),
numbered AS (
  SELECT s.*, source_size, target, copies, rest, row_number() OVER (ORDER BY h, size, doc_id) AS row
  FROM sized s JOIN planned p ON s.source IS NOT DISTINCT FROM p.source),
turns AS (
  SELECT 0 AS turn, row, source, size, h, CAST(rest AS BIGINT) AS remaining, false AS more,
    bool_or(size > 0 AND size <= rest) OVER (PARTITION BY source) AS further FROM numbered
  UNION ALL
  SELECT turn + 1, row, source, size, h, remaining, more,
    bool_or(NOT more AND size > 0 AND size <= remaining) OVER (PARTITION BY source) FROM (
    SELECT * REPLACE (more OR best AS more,
      CAST(remaining - sum(CASE WHEN best THEN size ELSE 0 END) OVER (PARTITION BY source) AS BIGINT) AS remaining) FROM (
      SELECT *, row_number() OVER (PARTITION BY source ORDER BY NOT more AND size > 0 AND size <= remaining DESC,
        size DESC, h DESC, row DESC) = 1 AND NOT more AND size > 0 AND size <= remaining AS best FROM (
        SELECT * REPLACE (more OR prefix AS more,
          CAST(remaining - sum(CASE WHEN prefix THEN size ELSE 0 END) OVER (PARTITION BY source) AS BIGINT) AS remaining) FROM (
          SELECT *, NOT more AND size > 0 AND size <= remaining AND sum(CASE WHEN NOT more AND size <= remaining THEN size
            ELSE 0 END) OVER (PARTITION BY source ORDER BY row ROWS UNBOUNDED PRECEDING) <= remaining AS prefix
          FROM turns WHERE further))))),
ended AS (SELECT row, arg_max(more, turn) AS more FROM turns GROUP BY row)
SELECT doc_id, size, source_size, target, CAST(size * (copies + CASE WHEN more THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM numbered JOIN ended USING (row)"""


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text, bit by bit."""
    byte = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    each = f"list_reduce(list_prepend(xor(c, b), CAST(range(8) AS BIGINT[])), lambda x, i: {byte})"
    codes = f"[CAST(ascii(ch) AS BIGINT) FOR ch IN string_split({text}, '')]"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda c, b: {each}), 4294967295)"


def _field(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _tree(name: str, base: str) -> str:
    """Nodes of all levels of some trees, from rows (tree, pos, size, h)."""
    return f"""{name}(tree, level, pos, size, h) AS (
  SELECT tree, 0, pos, size, h FROM {base} UNION ALL
  SELECT tree, level + 1, pos // 2, (size + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM {name} WHERE size > 1
  GROUP BY tree, level, pos // 2, size)"""


def _path(name: str, base: str, nodes: str) -> str:
    """From rows (row, tree, pos, size, proof, folded) up to the root: siblings are added and folded in."""
    return f"""{name}(row, tree, level, pos, size, proof, folded) AS (
  SELECT row, tree, 0, pos, size, proof, folded FROM {base} UNION ALL
  SELECT p.row, p.tree, p.level + 1, p.pos // 2, (p.size + 1) // 2, proof || coalesce(n.h, ''),
    sha256(CASE WHEN n.pos < p.pos THEN n.h || folded ELSE folded || coalesce(n.h, '') END)
  FROM {name} p LEFT JOIN {nodes} n ON n.tree = p.tree AND n.level = p.level AND n.pos = xor(p.pos, 1) WHERE p.size > 1)"""


_LEAF = ", ".join(map(_field, ("doc_id", "source", "lang", "{n_chars}", "text")))

OP11 = f"""WITH RECURSIVE hashed AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256(concat({_LEAF.format(n_chars="n_chars")})) AS h,
    CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 7 = 0
      THEN sha256(concat({_LEAF.format(n_chars="(n_chars + 1)")})) END AS other FROM documents),
leaves AS (
  SELECT *, row_number() OVER () AS row, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS pos,
    count(*) OVER (PARTITION BY tree) AS size FROM hashed),
{_tree("nodes", "leaves")},
subroots AS (
  SELECT tree AS own, '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS size, h FROM nodes WHERE size = 1),
{_tree("tops", "subroots")},
starts AS (SELECT row, tree, pos, size, '' AS proof, coalesce(other, h) AS folded FROM leaves),
{_path("low", "starts", "nodes")},
crossings AS (
  SELECT l.row, s.tree, s.pos, s.size, l.proof, l.folded FROM low l JOIN subroots s ON s.own = l.tree WHERE l.size = 1),
{_path("high", "crossings", "tops")}
SELECT l.doc_id, l.h AS leaf, s.h AS subroot, t.h AS root, sha256(p.proof) AS proof_sha256, p.folded AS folded_root,
  p.folded = t.h AS verified
FROM leaves l JOIN subroots s ON s.own = l.tree JOIN high p ON p.row = l.row AND p.size = 1, tops t WHERE t.size = 1"""


def _moves() -> str:
    """Every way to pass a row: state before, inserted turns, edit, initial it needs, new role, state after, cost.
    States are the last role initial, or n for none."""
    step = {"n": "su", "s": "u", "u": "a", "a": "u"}
    role = {"u": "user", "a": "assistant"}
    rows = []
    for before in step:
        state, added = before, ""
        for inserts in range(3):
            base = f"'{before}', '{added}', '{'I' * inserts}'"
            rows.append(f"({base}, 'D', NULL, NULL, '{state}', {3 * inserts + 4})")
            rows += [f"({base}, 'K', '{i}', NULL, '{i}', {3 * inserts})" for i in step[state]]
            turn = step[state][-1]
            rows.append(f"({base}, 'R', NULL, '{role[turn]}', '{turn}', {3 * inserts + 3})")
            added, state = added + f"\n{role[turn]}:", turn
    return ", ".join(rows)


OP13 = f"""WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS k
  FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM keyed, unnest(CASE WHEN k = 0 THEN [] WHEN k = 3 THEN [1, 2] ELSE [1] END)),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n,
    regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS ending FROM damaged),
copied AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) AS copy FROM numbered),
faults AS (
  SELECT *, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY n) || role[1] AS pair,
    CASE WHEN ending = '' THEN 'blank' WHEN copy > 1 THEN 'duplicate' WHEN ending NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END
      AS fault FROM copied),
moves(before, added, inserts, edit, needs, role, after, cost) AS (VALUES {_moves()}),
walk AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS n, 'n' AS state, CAST(0 AS BIGINT) AS cost, '' AS audit, '' AS body FROM conversations
  UNION ALL
  SELECT conv_id, n, after, best.cost, best.audit, best.body FROM (
    SELECT f.conv_id, f.n, m.after, min(struct_pack(cost := CAST(w.cost + m.cost
        + CASE WHEN f.fault = 'truncated' AND m.edit <> 'D' THEN 3 ELSE 0 END AS BIGINT),
      audit := w.audit || m.inserts || m.edit,
      body := w.body || m.added || CASE WHEN m.edit = 'D' THEN '' ELSE chr(10) || coalesce(m.role, f.role) || ':' || f.text END)) AS best
    FROM walk w JOIN faults f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.n = w.n + 1
    JOIN moves m ON m.before = w.state AND (m.needs IS NULL OR m.needs = f.role[1])
      AND (m.edit = 'D' OR f.fault NOT IN ('blank', 'duplicate'))
    GROUP BY f.conv_id, f.n, m.after)),
counts AS (
  SELECT c.conv_id, count(n) AS n, coalesce(max(f.turn) - min(f.turn) + 1 - count(DISTINCT f.turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
  GROUP BY c.conv_id),
ends(state, inserts, added) AS (
  VALUES ('n', '', ''), ('a', '', ''), ('u', 'I', '
assistant:'), ('s', 'II', '
user:
assistant:')),
best AS (
  SELECT c.* EXCLUDE (n), min(struct_pack(cost := CAST(w.cost + 3 * length(e.inserts) AS BIGINT), audit := w.audit || e.inserts,
    body := w.body || e.added)) AS way
  FROM counts c JOIN walk w ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.n = c.n JOIN ends e ON e.state = w.state GROUP BY ALL)
SELECT * EXCLUDE (way), way.cost AS cost, way.audit AS audit, sha256(substr(way.body, 2)) AS repaired_sha256 FROM best"""

ORACLES: dict[str, str] = {
    "op1_jaccard_join": OP1,
    "op5_metric_join": OP5,
    "op7_revisits": OP7,
    "op9_mixture": OP9,
    "op11_merkle_manifest": OP11,
    "op13_turn_repair": OP13,
}
