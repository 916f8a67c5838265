"""SQL of the registered queries that SQL can express, for DuckDB."""

from __future__ import annotations

#: Fixed by the contracts.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+"""
HEAD = r"""^(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?"""

ORACLE: dict[str, str] = {}


def _spans(kind: str, rank: int, pattern: str, least: int, head: str | None = None) -> str:
    """Rows (doc_id, kind, rank, b, e): the pieces between matches are walked with the matches."""
    body = f"length(regexp_replace(m, '{head}', ''))" if head else "length(m)"
    return f"""
    SELECT doc_id, '{kind}' AS kind, {rank} AS rank, e - length(m) AS b, e FROM (
      SELECT doc_id, m, sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY k) AS e FROM (
        SELECT doc_id, unnest(ms) AS m, unnest(gs[:len(ms)]) AS g, unnest(range(len(ms))) AS k FROM (
          SELECT doc_id, regexp_extract_all(text, '{pattern}') AS ms,
                 string_split_regex(text, '{pattern}') AS gs
          FROM documents WHERE regexp_matches(text, '{pattern}'))))
    WHERE {body} >= {least}"""


ORACLE["op5_secret_ledger"] = f"""
WITH spans AS ({" UNION ALL ".join([
    _spans("assign", 0, ASSIGN, 6, HEAD), _spans("access", 1, "AKIA[A-Z0-9]+", 20),
    _spans("hex", 2, "[0-9a-f]+", 24),
    _spans("pem", 3, "-----BEGIN [A-Z ]*PRIVATE KEY-----", 1),
    _spans("github", 4, "gh[pousr]_[A-Za-z0-9]{36,}", 40),
    _spans("jwt", 5, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 28),
    _spans("slack", 6, "xox[abprs]-[A-Za-z0-9-]{10,}", 15)])}),
told AS (
  SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access,
         count(*) FILTER (rank = 2) AS n_hex,
         string_agg(kind || ':' || b::BIGINT || ':' || e::BIGINT, ',' ORDER BY b, rank)
           FILTER (rank < 3) AS base,
         string_agg(kind || ':' || b::BIGINT || ':' || e::BIGINT, ',' ORDER BY b, rank) AS spans
  FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
       coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans
FROM documents LEFT JOIN told USING (doc_id)"""

ORACLE["op6_exact_dedup"] = f"""
WITH rows AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS t
              FROM documents),
groups AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM rows GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
FROM rows JOIN groups USING (t)"""

ORACLE["op7_source_mix"] = f"""
WITH RECURSIVE rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size,
         greatest(0.1, coalesce(1 - 4 * (strlen(text)
           - strlen(translate(text, '#*$%&|<>{{}}[]\\=^~_', '')))::DOUBLE / nullif(strlen(text), 0),
           0.1)) AS quality,
         (('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5)
           / 4503599627370496.0::DOUBLE AS u
  FROM documents),
sources AS (
  SELECT source, sum(size) AS source_size,
         ([1, 2, 3])[(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS weight
  FROM rows GROUP BY source),
-- Shares are dealt out again until no source is above three times its size.
deal(round, source, source_size, weight, share, done) AS (
  SELECT 0, source, source_size, weight,
         (SELECT sum(source_size) FROM sources)::DOUBLE * weight / (SELECT sum(weight) FROM sources),
         false
  FROM sources
  UNION ALL
  SELECT round + 1, source, source_size, weight,
         CASE WHEN share >= 3 * source_size THEN 3.0 * source_size
              ELSE share + excess * weight / nullif(open, 0) END, excess <= 0
  FROM (SELECT *, sum(greatest(share - 3 * source_size, 0)) OVER () AS excess,
               sum(weight) FILTER (share < 3 * source_size) OVER () AS open
        FROM deal WHERE NOT done AND round < 100)),
goals AS (SELECT source, source_size, share AS target FROM deal
          WHERE round = (SELECT max(round) FROM deal)),
keyed AS (
  SELECT doc_id, size, source_size, target, -ln(u) / least(1.0, quality) AS key,
         CASE WHEN source_size > 0 THEN floor((target + 1e-6) / source_size) ELSE 0 END AS epoch,
         rows.source AS source
  FROM rows JOIN goals ON rows.source IS NOT DISTINCT FROM goals.source),
summed AS (
  SELECT *, floor(target + 1e-6 - epoch * source_size) AS rest,
         coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM keyed)
SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, round(target, 6) AS target,
       (epoch * size + greatest(0, least(size, rest - before)))::BIGINT AS taken
FROM summed"""

ORACLE["op8_substring_fm"] = f"""
WITH rows AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
long AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS k FROM rows WHERE len(w) >= 35),
windows AS (SELECT doc_id, k, array_to_string(w[k:k + 34], ' ') AS s FROM long),
again AS (SELECT s FROM windows GROUP BY s HAVING count(*) > 1),
hits AS (SELECT doc_id, k FROM windows JOIN again USING (s)),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (
           SELECT doc_id, unnest(range(k, k + 35)) AS p FROM hits) GROUP BY doc_id),
kept AS (SELECT doc_id, w, coalesce(len(ps), 0) AS n_removed,
                coalesce(list_filter(w, lambda x, i: NOT list_contains(ps, i)), w) AS left_over
         FROM rows LEFT JOIN gone USING (doc_id))
SELECT doc_id, len(w)::BIGINT AS n_words, n_removed::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN n_removed = 0 THEN w ELSE left_over END, ' ')) AS kept_sha256
FROM kept"""



def _near(percent: int, kept: str) -> str:
    return f"""
WITH RECURSIVE rows AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{WORD}') AS w
  FROM documents),
sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) END) AS s
  FROM rows),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
           FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
          WHERE 100 * c >= {percent} * (p.n + q.n - c)),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents
                UNION SELECT r.a, w.b FROM reach r JOIN ways w ON r.b = w.a),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id{kept}
FROM least LEFT JOIN sizes USING (doc_id)"""


ORACLE["op9_setsketch"] = _near(85, ", doc_id = component_id AS kept")
ORACLE["op13_voronoi_join"] = _near(80, "")


def _told(field: str) -> str:
    return f"CASE WHEN {field} IS NULL THEN '-' ELSE strlen({field}::VARCHAR) || ':' || {field}::VARCHAR END"


def _leaf(n_chars: str) -> str:
    return f"sha256({' || '.join(_told(c) for c in ('doc_id', 'source', 'lang', n_chars, 'text'))})"


#: CRC-32, bit by bit: the decimal identifier's bytes from the lowest bit on.
CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
  range(1, length(doc_id::VARCHAR) + 1), lambda i: list_transform(range(8),
  lambda b: (ascii((doc_id::VARCHAR)[i]) >> b::INTEGER)::BIGINT & 1)))),
  lambda c, b: xor(c >> 1, (xor(c, b) & 1) * 3988292384)))"""


def _tree(name: str, start: str) -> str:
    """Nodes of all levels from rows (tree, pos, size, h)."""
    return f"""{name}(tree, level, pos, size, h) AS (
  SELECT tree, 0, pos, size, h FROM {start}
  UNION ALL
  SELECT tree, level + 1, pos // 2, (size + 1) // 2, sha256(string_agg(h, '' ORDER BY pos))
  FROM {name} WHERE size > 1 GROUP BY tree, level, pos // 2, size)"""


def _walk(name: str, nodes: str, start: str) -> str:
    """From rows (k, tree, pos, size, h, proof) up to the top of their tree."""
    return f"""{name}(k, tree, level, pos, size, h, proof) AS (
  SELECT k, tree, 0, pos, size, h, proof FROM {start}
  UNION ALL
  SELECT k, w.tree, w.level + 1, w.pos // 2, (w.size + 1) // 2,
         sha256(CASE WHEN n.pos < w.pos THEN n.h ELSE '' END || w.h || CASE WHEN n.pos > w.pos THEN n.h ELSE '' END),
         proof || coalesce(n.h, '')
  FROM {name} w LEFT JOIN {nodes} n ON n.tree = w.tree AND n.level = w.level AND n.pos = xor(w.pos, 1)
  WHERE w.size > 1)"""


ORACLE["op11_merkle_manifest"] = f"""
WITH RECURSIVE hashed AS (
  SELECT doc_id, coalesce('v' || lang, 'n') AS tree, {_leaf("n_chars")} AS h,
         CASE WHEN doc_id IS NOT NULL AND {CRC} % 7 = 0 THEN {_leaf("(n_chars + 1)")} END AS changed
  FROM documents),
leaves AS (SELECT *, row_number() OVER () AS k,
             row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h, changed NULLS FIRST) - 1 AS pos,
             count(*) OVER (PARTITION BY tree) AS size FROM hashed),
{_tree("nodes", "leaves")},
trees AS (SELECT tree AS name, h FROM nodes WHERE size = 1),
places AS (SELECT name, '' AS tree, h, row_number() OVER (ORDER BY name) - 1 AS pos, count(*) OVER () AS size FROM trees),
{_tree("upper", "places")},
root AS (SELECT h FROM upper WHERE size = 1),
starts AS (SELECT k, tree, pos, size, coalesce(changed, h) AS h, '' AS proof FROM leaves),
{_walk("within", "nodes", "starts")},
middles AS (SELECT k, p.tree, p.pos, p.size, w.h, w.proof
            FROM within w JOIN places p ON p.name = w.tree WHERE w.size = 1),
{_walk("over", "upper", "middles")}
SELECT doc_id, l.h AS leaf, t.h AS subroot, root.h AS root, sha256(o.proof) AS proof_sha256, o.h AS folded_root,
       o.h = root.h AS verified
FROM leaves l JOIN trees t ON t.name = l.tree JOIN over o ON o.k = l.k AND o.size = 1, root"""

ORACLE["op12_collocations"] = f"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
      translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents)),
counts AS (
  SELECT lang, m, phrase, count(*) AS a FROM (
    SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda k: array_to_string(w[k:k + m - 1], ' '))) AS phrase
    FROM pieces, (SELECT unnest([1, 2, 3, 4]) AS m)) GROUP BY ALL),
totals AS (SELECT lang, sum(a) AS n FROM counts WHERE m = 1 GROUP BY lang),
candidates AS (SELECT * FROM counts WHERE m > 1 AND a >= 30),
left_over AS (
  SELECT * FROM candidates c WHERE NOT EXISTS (
    SELECT 1 FROM candidates x WHERE x.lang = c.lang AND x.m > c.m AND 100 * x.a >= 80 * c.a
      AND contains(' ' || x.phrase || ' ', ' ' || c.phrase || ' '))),
cuts AS (SELECT lang, phrase, m, a, string_split(phrase, ' ') AS w, unnest(range(1, m)) AS k FROM left_over),
scored AS (
  SELECT c.lang, c.phrase, c.a, k, x.a AS l, y.a AS r, (2000000::HUGEINT * c.a) // (x.a + y.a) AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.m = k AND x.phrase = array_to_string(w[:k], ' ')
  JOIN counts y ON y.lang = c.lang AND y.m = c.m - k AND y.phrase = array_to_string(w[k + 1:], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""
