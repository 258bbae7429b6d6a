"""DuckDB SQL for the operators' queries, where SQL can say them."""

SQL: dict[str, str] = {}

_WORDS = r"""list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda w: w <> '')"""

SQL["op3_quality_rules"] = rf"""
WITH worded AS (
    SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {_WORDS} AS words FROM documents
), windows AS (
    SELECT rid, i, list_slice(words, i, i + 7) AS w
    FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM worded)
), twice AS (
    SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, w) AS c FROM windows) WHERE c > 1
), covered AS (
    SELECT rid, count(*) AS n FROM (SELECT DISTINCT rid, i + unnest(range(0, 8)) AS p FROM twice) GROUP BY rid
), measures AS (
    SELECT rid, doc_id, text,
        CAST(len(words) AS BIGINT) AS n_words,
        CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
        CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^ \t-\r]')))
            - len(list_distinct(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^ \t-\r]'))))
            AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
    FROM worded LEFT JOIN covered USING (rid)
), judged AS (
    SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM measures
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT (base_failed
        OR n_symbols * 20 > word_chars
        OR len(regexp_extract_all(text, '\p{{Lu}}')) * 10 > length(text) * 3
        OR n_dup_lines * 2 > len(string_split(text, chr(10)))
        OR word_chars > n_words * 40
        OR len(regexp_extract_all(text, '\p{{L}}')) * 2 < length(text)) AS kept
FROM judged
"""

_TREE = """sha256('R' || array_to_string(list_transform(string_split({0}, chr(10) || chr(10)), lambda s:
        sha256('S' || array_to_string(list_transform(string_split(s, chr(10)), lambda p: sha256('P' || p)), ','))), ','))"""
_SECTIONS = "string_split({0}, chr(10) || chr(10))"
# How many elements two lists share from their starts on, and from their ends back to there.
_START = """coalesce(list_position(list_transform(range(1, least(len({0}), len({1})) + 1), lambda i: {0}[i] <> {1}[i]), true) - 1,
        least(len({0}), len({1})))"""
_TAIL = """coalesce(list_position(list_transform(range(0, least(len({0}), len({1})) - {2}),
            lambda i: {0}[len({0}) - i] <> {1}[len({1}) - i]), true) - 1, least(len({0}), len({1})) - {2})"""

SQL["op10_document_fingerprints"] = f"""
WITH texts AS (
    SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), following AS (
    SELECT rid, doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id, text),
        first_value(text) OVER (ORDER BY doc_id, text)) AS next_text
    FROM texts
), edits AS (
    SELECT *, left(text, length(text) - length(text) // 4) || left(next_text, length(text) // 4) AS edited
    FROM following
), lines AS (
    SELECT rid, kind, unnest(string_split(t, chr(10))) AS line FROM (
        SELECT rid, 'own' AS kind, text AS t FROM edits
        UNION ALL SELECT rid, 'edited', edited FROM edits UNION ALL SELECT rid, 'next', next_text FROM edits)
), windows AS (
    SELECT DISTINCT rid, kind, substr(line, i, 8) AS w
    FROM (SELECT rid, kind, line, unnest(range(1, greatest(length(line) - 7, 1) + 1)) AS i FROM lines WHERE line <> '')
), kinds AS (
    SELECT rid, w, bool_or(kind = 'own') AS a, bool_or(kind = 'edited') AS b, bool_or(kind = 'next') AS c
    FROM windows GROUP BY ALL
), counts AS (
    SELECT rid, count(*) FILTER (a AND b) AS ab, count(*) FILTER (a OR b) AS a_b,
        count(*) FILTER (a AND c) AS ac, count(*) FILTER (a OR c) AS a_c
    FROM kinds GROUP BY rid
), parted AS (
    SELECT rid, {_SECTIONS.format("text")} AS x, {_SECTIONS.format("edited")} AS y FROM edits
), started AS (
    SELECT *, {_START.format("x", "y")} AS s FROM parted
), ended AS (
    SELECT *, {_TAIL.format("x", "y", "s")} AS t FROM started
), pairs AS (
    SELECT rid, i, CASE WHEN i < len(x) - t THEN string_split(x[i + 1], chr(10)) ELSE [] END AS x,
        CASE WHEN i < len(y) - t THEN string_split(y[i + 1], chr(10)) ELSE [] END AS y
    FROM (SELECT *, unnest(range(s, greatest(len(x), len(y)) - t)) AS i FROM ended)
), pairs_started AS (
    SELECT *, {_START.format("x", "y")} AS s FROM pairs
), pairs_ended AS (
    SELECT *, {_TAIL.format("x", "y", "s")} AS t FROM pairs_started
), places AS (
    SELECT rid, i, j FROM (SELECT *, unnest(range(s, greatest(len(x), len(y)) - t)) AS j FROM pairs_ended)
    WHERE (CASE WHEN j < len(x) - t THEN x[j + 1] END) IS DISTINCT FROM (CASE WHEN j < len(y) - t THEN y[j + 1] END)
), changed AS (
    SELECT rid, string_agg(i || ':' || j, ',' ORDER BY i, j) AS changed FROM places GROUP BY rid
)
SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256,
    {_TREE.format("text")} AS fingerprint, {_TREE.format("edited")} AS edited_fingerprint,
    CASE WHEN coalesce(a_b, 0) = 0 THEN 1.0 ELSE CAST(ab AS DOUBLE) / a_b END AS near_edited,
    CASE WHEN coalesce(a_c, 0) = 0 THEN 1.0 ELSE CAST(ac AS DOUBLE) / a_c END AS near_next,
    CAST(list_sum(list_transform({_SECTIONS.format("text")}, lambda q: len(string_split(q, chr(10))))) AS BIGINT) AS n_paragraphs,
    coalesce(changed, '') AS changed
FROM edits LEFT JOIN counts USING (rid) LEFT JOIN changed USING (rid)
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LETTERS = rf"""list_filter(regexp_split_to_array({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"""

SQL["op13_benchmark_decontamination"] = f"""
WITH docs AS (
    SELECT row_number() OVER () AS rid, doc_id, {_LETTERS} AS words FROM documents
), items AS (
    SELECT item_id, {_LETTERS} AS words FROM benchmark
), windows AS (
    SELECT item_id, size, array_to_string(list_slice(words, i, i + size - 1), ' ') AS w
    FROM (SELECT item_id, words, least(len(words), 10) AS size,
            unnest(range(1, len(words) - least(len(words), 10) + 2)) AS i FROM items WHERE len(words) > 0)
), known AS (
    SELECT size, w, list_distinct(list(CAST(item_id AS VARCHAR))) AS ids FROM windows GROUP BY ALL
), spots AS (
    SELECT rid, size, i, array_to_string(list_slice(words, i, i + size - 1), ' ') AS w
    FROM (SELECT rid, words, size, unnest(range(1, len(words) - size + 2)) AS i
        FROM docs, (SELECT DISTINCT size FROM known) WHERE len(words) >= size)
), found AS (
    SELECT rid, i, size, ids FROM spots JOIN known USING (size, w)
), hits AS (
    SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + size)) AS p FROM found) GROUP BY rid
), held AS (
    SELECT rid, count(DISTINCT id) AS n_items, string_agg(DISTINCT id, ',' ORDER BY id) AS ids
    FROM (SELECT rid, unnest(ids) AS id FROM found) GROUP BY rid
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (rid) LEFT JOIN held USING (rid)
"""


def _plus(path: str, cost: str, letter: str) -> str:
    """A path (nine digits of cost, then the audit) after one more edit; null stays null."""
    return f"(printf('%09d', CAST({path}[1:9] AS INTEGER) + {cost}) || {path}[10:] || '{letter}')"


def _keep(kind: str, *places: str) -> str:
    return ", ".join(f"CASE WHEN kind = '{kind}' AND NOT gone THEN {_plus(p, 'cut', 'K')} END" for p in places)


def _rerole(*places: str) -> str:
    return ", ".join(f"CASE WHEN NOT gone THEN {_plus(p, '2 + cut', 'R')} END" for p in places)


_BLANK = r"NOT regexp_matches(text, '[^\x20\x09-\x0D]')"

SQL["op11_conversation_repair"] = rf"""
WITH RECURSIVE bits AS (
    SELECT list(c ORDER BY i) AS tab FROM (
        SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), range(8)),
            lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
        FROM range(256) AS r(i))
), named AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
    FROM conversations
), summed AS (
    SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(name, ''), lambda c: CAST(ascii(c) AS BIGINT))),
        lambda h, b: xor(h >> 8, tab[CAST(xor(h & 255, b) AS INTEGER) + 1])), 4294967295) % 20 AS kind
    FROM named, bits
), damaged AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
        CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
    FROM summed WHERE kind <> 0
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged
), judged AS (
    SELECT *, CASE WHEN {_BLANK} THEN 'blank'
        WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
        WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
        left(role, 1) AS kind,
        lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS next_kind
    FROM placed
), counts AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
        count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
        count(*) FILTER (fault = 'truncated') AS truncated,
        count(*) FILTER (next_kind IS NOT NULL AND kind || next_kind NOT IN ('su', 'ua', 'au')) AS illegal,
        max(i) AS n
    FROM judged GROUP BY conv_id
), lattice AS (
    SELECT conv_id, 0 AS i, n, '000000000' AS p0, CAST(NULL AS VARCHAR) AS p1, '000000002I' AS p2, '000000004II' AS p3
    FROM counts
    UNION ALL
    SELECT conv_id, i, n, p0, p1, q2 AS p2, least(p3, {_plus("q2", "2", "I")}) AS p3 FROM (
        SELECT *, least(p2, {_plus("p0", "2", "I")}, {_plus("p1", "2", "I")}, {_plus("p3", "2", "I")}) AS q2 FROM (
            SELECT conv_id, j.i AS i, n, {_plus("p0", "3", "D")} AS p0,
                least({_plus("p1", "3", "D")}, {_keep("s", "p0")}) AS p1,
                least({_plus("p2", "3", "D")}, {_keep("u", "p0", "p1", "p3")}, {_rerole("p0", "p1", "p3")}) AS p2,
                least({_plus("p3", "3", "D")}, {_keep("a", "p2")}, {_rerole("p2")}) AS p3
            FROM lattice JOIN (
                SELECT conv_id, i, kind, fault IN ('blank', 'duplicate') AS gone,
                    CAST(fault = 'truncated' AS INTEGER) AS cut FROM judged) AS j USING (conv_id)
            WHERE j.i = lattice.i + 1))
), best AS (
    SELECT conv_id, least(p0, p3) AS p FROM lattice WHERE i = n
), letters AS (
    SELECT conv_id, k, letter,
        count(*) FILTER (letter <> 'I') OVER (PARTITION BY conv_id ORDER BY k) AS i,
        count(*) FILTER (letter <> 'D') OVER (PARTITION BY conv_id ORDER BY k) AS out,
        count(*) FILTER (letter <> 'D') OVER (PARTITION BY conv_id) AS whole
    FROM (SELECT conv_id, unnest(range(len(p) - 9)) AS k, unnest(string_split(p[10:], '')) AS letter
        FROM best WHERE len(p) > 9)
), lines AS (
    SELECT l.conv_id, k, CASE WHEN letter = 'K' THEN role WHEN (out - whole) % 2 = 0 THEN 'assistant' ELSE 'user' END
        || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END AS line
    FROM letters AS l LEFT JOIN judged AS j ON j.conv_id = l.conv_id AND j.i = l.i
    WHERE letter <> 'D'
), texts AS (
    SELECT conv_id, string_agg(line, chr(10) ORDER BY k) AS t FROM lines GROUP BY conv_id
)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank,
    coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
    CAST(coalesce(p[1:9], '0') AS BIGINT) AS cost, coalesce(p[10:], '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS c
LEFT JOIN counts USING (conv_id) LEFT JOIN best USING (conv_id) LEFT JOIN texts USING (conv_id)
"""
