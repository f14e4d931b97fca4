"""DuckDB statements that compute the same rows as the training-data queries."""

from __future__ import annotations

from .repetition import BASE_WINDOW, Limits

_WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"


def quality_rules(limits: Limits | None = None, table: str = "documents", last: str = "") -> str:
    """Repetition coverage; ``last`` replaces the final SELECT."""
    limits = limits or Limits()
    widths = sorted({w for w, _ in limits.ngrams} | {BASE_WINDOW})
    parts = [
        f"""docs AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM {table}),
words AS (SELECT row_id, doc_id, text, {_WORDS} AS w FROM docs),
base AS (SELECT row_id, doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM words),
split_lines AS (SELECT row_id, line, row_number() OVER (PARTITION BY row_id, line) AS nth FROM (
  SELECT row_id, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
repeated_lines AS (SELECT row_id, count(*) AS n_dup_lines,
  sum(length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g'))) AS dup_line_chars FROM split_lines WHERE nth > 1 GROUP BY 1),
tokens AS (SELECT row_id, w, unnest(range(1, len(w) + 1)) AS i FROM words),
lengths AS (SELECT row_id, i, length(w[i]) AS chars FROM tokens)"""
    ]
    for n in widths:
        parts.append(
            f"""grams_{n} AS (SELECT row_id, i, count(*) OVER (PARTITION BY row_id, g) AS n,
  row_number() OVER (PARTITION BY row_id, g ORDER BY i) AS nth FROM (
  SELECT row_id, i, array_to_string(w[i : i + {n - 1}], ' ') AS g FROM tokens WHERE i + {n - 1} <= len(w))),
in_{n} AS (SELECT row_id, sum(chars) AS dup_{n}gram_chars FROM lengths SEMI JOIN (
  SELECT DISTINCT row_id, i + k AS i FROM grams_{n}, range({n}) t(k) WHERE nth > 1) USING (row_id, i) GROUP BY 1)"""
        )
    parts.append(
        f"""again AS (SELECT row_id, count(DISTINCT i + k) AS n_repeat_words
  FROM grams_{BASE_WINDOW}, range({BASE_WINDOW}) t(k) WHERE n > 1 GROUP BY 1),
counts AS (SELECT doc_id, row_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(dup_line_chars, 0)::BIGINT AS dup_line_chars,
  {", ".join(f"coalesce(dup_{n}gram_chars, 0)::BIGINT AS dup_{n}gram_chars" for n in widths)}
  FROM base LEFT JOIN repeated_lines USING (row_id) LEFT JOIN again USING (row_id)
  {" ".join(f"LEFT JOIN in_{n} USING (row_id)" for n in widths)}),
judged AS (SELECT *, n_words < {limits.min_words} OR 100 * n_repeat_words > {limits.repeat_words} * n_words AS base_failed FROM counts),
rules AS (SELECT * EXCLUDE (row_id), NOT base_failed AND 100 * dup_line_chars <= {limits.line_chars} * word_chars
  AND {" AND ".join(f"100 * dup_{n}gram_chars <= {most} * word_chars" for n, most in limits.ngrams)} AS kept, row_id FROM judged)"""
    )
    return "WITH " + ",\n".join(parts) + "\n" + (last or "SELECT * EXCLUDE (row_id) FROM rules")


_FOLD = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

DECONTAMINATE = f"""WITH items AS (SELECT item_id::VARCHAR AS item_id, {_FOLD} AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
docs AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce({_FOLD}, []) AS w FROM documents),
places AS (SELECT row_id, w, unnest(range(1, len(w) + 1)) AS i FROM docs),
grams AS (SELECT row_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM places, (SELECT DISTINCT n FROM windows) WHERE i + n - 1 <= len(w)),
found AS (SELECT row_id, i, n, item_id FROM grams JOIN windows USING (n, g)),
hits AS (SELECT row_id, count(DISTINCT i + k) AS n_hit FROM (SELECT row_id, i, unnest(range(n)) AS k FROM found) GROUP BY 1),
named AS (SELECT row_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT row_id, item_id FROM found) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (row_id) LEFT JOIN named USING (row_id)"""


REPEATS = f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
nodes AS (SELECT row_number() OVER () AS node, text, n, {_WORDS} AS w FROM (SELECT text, count(*) AS n FROM docs GROUP BY 1)),
windows AS (SELECT node, i, sha256(array_to_string(w[i : i + 49], ' ')) AS g FROM (SELECT node, w, unnest(range(1, len(w) - 48)) AS i FROM nodes WHERE len(w) >= 50)),
twice AS (SELECT node, i FROM (SELECT node, i, count(*) OVER (PARTITION BY g) AS n FROM windows) WHERE n > 1),
covered AS (SELECT DISTINCT node, i + k AS p FROM twice, range(50) t(k)),
islands AS (SELECT node, min(p) - 1 AS s, max(p) AS e FROM (SELECT node, p, p - row_number() OVER (PARTITION BY node ORDER BY p) AS island FROM covered) GROUP BY node, island),
merged AS (SELECT node, sum(e - s)::BIGINT AS words, string_agg(s || ':' || e, ',' ORDER BY s) AS spans FROM islands GROUP BY 1)
SELECT doc_id, len(w) AS n_words, CASE WHEN n > 1 AND len(w) >= 50 THEN len(w) ELSE words END AS n_repeated, CASE WHEN n > 1 AND len(w) >= 50 THEN '0:' || len(w) ELSE spans END AS spans
FROM docs JOIN nodes USING (text) LEFT JOIN merged USING (node) WHERE (n > 1 AND len(w) >= 50) OR spans IS NOT NULL"""

NEAR_DUPLICATES = f"""WITH RECURSIVE docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
nodes AS (SELECT row_number() OVER () AS node, text, w FROM (SELECT text, {_WORDS} AS w FROM (SELECT DISTINCT text FROM docs))),
shingles AS (SELECT DISTINCT node, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT node, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM nodes WHERE len(w) > 0)),
sizes AS (SELECT node, count(*) AS n FROM shingles GROUP BY 1),
shared AS (SELECT x.node AS a, y.node AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.g = y.g AND x.node < y.node GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes p ON p.node = a JOIN sizes q ON q.node = b WHERE c >= 0.8 * (p.n + q.n - c)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reached(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reached r JOIN edges e ON r.b = e.a),
classes AS (SELECT node, least(node, coalesce(m, node)) AS class FROM nodes LEFT JOIN (SELECT a, min(b) AS m FROM reached GROUP BY 1) ON node = a),
named AS (SELECT doc_id, class FROM docs JOIN nodes USING (text) JOIN classes USING (node))
SELECT doc_id, min(doc_id) OVER (PARTITION BY class) AS class_id FROM named"""

_CONTROL = r"<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>"
_ESCAPED = "length(replace({0}, '\\', '\\\\')) + len(regexp_extract_all(replace({0}, '\\', '\\\\'), '" + _CONTROL + "'))"

CONVERSATIONS = f"""WITH turns AS (SELECT conv_id, turn, role AS r0, text AS t0, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (
  SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -1, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) t(i)))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(24 + {_ESCAPED.format("role")} + length(role) - length(replace(role, chr(10), '')) + {_ESCAPED.format("text")})::BIGINT AS formatted_chars
FROM turns GROUP BY 1"""

_FIVE = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((v >> {5 * (7 - i)}) & 31) + 1)::INT, 1)" for i in range(8))

ARCHIVES = f"""WITH p AS (SELECT row_number() OVER () AS row_id, page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT row_id, page_id, html, strlen(html) AS payload_bytes, sha1(html) AS h FROM p),
parts AS (SELECT row_id, k, ('0x' || substr(h, (1 + 10 * k)::INT, 10))::BIGINT AS v FROM d, range(4) t(k)),
named AS (SELECT row_id, string_agg({_FIVE}, '' ORDER BY k) AS payload_digest FROM parts GROUP BY 1),
ranked AS (SELECT page_id, payload_bytes, payload_digest, row_number() OVER w AS r, first(page_id) OVER w AS top FROM d JOIN named USING (row_id)
  WINDOW w AS (PARTITION BY html ORDER BY page_id DESC NULLS LAST, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN r = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN r > 1 THEN top END AS refers_to FROM ranked"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_repeated_passages": REPEATS, "op4_near_duplicates": NEAR_DUPLICATES, "op5_format_conversations": CONVERSATIONS,
        "op6_archive_pages": ARCHIVES, "op7_quality_rules": quality_rules(), "op8_decontaminate": DECONTAMINATE,
    }
