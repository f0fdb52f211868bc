"""DuckDB SQL with the rows of those queries that SQL can express."""

from .licenses import ANCHORS, BREAK, RULES, SENTENCES
from .substring_dedup import BREAK as SENTENCE_END
from .substring_dedup import RUNS

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_STRIP = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINE_DEDUP = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, {_STRIP}), '{_UPPER}', '{_LOWER}') AS k FROM lines
), repeated AS (
  SELECT k, max(doc_id) AS keeper FROM keyed
  WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT keyed.*, coalesce(repeated.keeper <> doc_id, false) AS gone
  FROM keyed LEFT JOIN repeated USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_RUN_SQL = " UNION ALL ".join(
    f"""SELECT doc_id, place, place + {k - 1} AS last, list(s) OVER w AS run FROM kept
  WINDOW w AS (PARTITION BY doc_id ORDER BY place ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING) QUALIFY count(*) OVER w = {k} AND sum(words) OVER w >= {least}"""
    for k, least in RUNS
)
SUBSTRING_DEDUP = f"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, string_split(regexp_replace(coalesce(text, ''), '({SENTENCE_END})', '\\1' || chr(1), 'g'), chr(1)) AS parts FROM documents
), units AS (
  SELECT doc_id, unnest(parts) AS unit, generate_subscripts(parts, 1) AS pos FROM cut
), stripped AS (SELECT *, trim(unit, {_STRIP}) AS s FROM units
), kept AS (
  SELECT doc_id, pos, s, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS place, len(regexp_extract_all(s, '[^ \\t\\n\\r\\f\\v]+')) AS words FROM stripped WHERE s <> ''
), runs AS ({_RUN_SQL}
), origins AS (SELECT run, min((doc_id, place)) AS origin FROM runs GROUP BY run HAVING count(*) > 1
), again AS (SELECT r.doc_id, place, last, origin[1] AS first_doc_id FROM runs r JOIN origins o USING (run) WHERE (r.doc_id, place) > origin
), gone AS (SELECT DISTINCT k.doc_id, k.pos FROM kept k JOIN again a ON a.doc_id = k.doc_id AND k.place BETWEEN a.place AND a.last
), origin_ids AS (SELECT doc_id, list_sort(list(DISTINCT first_doc_id)) AS ids FROM again GROUP BY doc_id
), left_over AS (
  SELECT u.doc_id, string_agg(unit, '' ORDER BY pos) FILTER (WHERE g.pos IS NULL) AS rest, count(g.pos) AS n FROM units u LEFT JOIN gone g USING (doc_id, pos) GROUP BY u.doc_id
)
SELECT c.doc_id, CASE WHEN l.n > 0 THEN trim(coalesce(l.rest, ''), {_STRIP}) ELSE c.text END AS text,
       (SELECT count(*) FROM kept k WHERE k.doc_id = c.doc_id) AS n_sentences, l.n AS n_removed, coalesce(o.ids, []::BIGINT[]) AS first_doc_ids
FROM cut c JOIN left_over l USING (doc_id) LEFT JOIN origin_ids o USING (doc_id)
"""


def _license_sql() -> str:
    known = ", ".join(f"'{sentence}': '{name}'" for name, sentence in SENTENCES)
    anchored = " OR ".join(f"contains(s, '{a}')" for a in ANCHORS)
    sql = f"""
SELECT doc_id, regexp_replace(' ' || array_to_string(list_transform(
  string_split_regex(lower(coalesce(text, '')), '{BREAK}'),
  lambda s: CASE WHEN {anchored} THEN coalesce(MAP {{{known}}}[trim(regexp_replace(s, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))], '-') ELSE '-' END
), '  ') || ' ', '(?: - )+', ' - ', 'g') AS r0 FROM documents"""
    for i, (_, ids) in enumerate(RULES):
        run = "".join(f" {x} " for x in ids)
        sql = f"SELECT *, replace(r{i}, '{run}', ' + ') AS r{i + 1} FROM ({sql})"
    times = [f"(length(r{i}) - length(r{i + 1})) // {3 * len(ids) + 2 * len(ids) - 3}" for i, (_, ids) in enumerate(RULES)]
    names = ", ".join(f"CASE WHEN {n} > 0 THEN '{name}' END" for n, (name, _) in zip(times, RULES, strict=True))
    return f"""
SELECT doc_id, trim(r0) AS sentence_ids, n_matches,
       array_to_string(list_filter(hits, lambda x, i: list_position(hits, x) = i), ', ') AS licenses
FROM (SELECT doc_id, r0, CAST({" + ".join(times)} AS BIGINT) AS n_matches,
             list_filter([{names}], lambda x: x IS NOT NULL) AS hits FROM ({sql}))"""


#: Scores are rounded for the ranks: the order of addition differs between engines.
BM25_TOPK = """
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+')) AS term FROM documents
), tfs AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL
), lengths AS (SELECT doc_id, sum(tf) AS length FROM tfs GROUP BY doc_id
), whole AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(length) FROM lengths) / (SELECT count(*) FROM documents)::DOUBLE AS average
), idfs AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tfs, whole GROUP BY term, n
), scored AS (
  SELECT q.doc_id AS query_id, d.doc_id, sum(idf * d.tf * 2.2 / (d.tf + 1.2 * (0.25 + 0.75 * length / average)) ORDER BY q.term) AS score
  FROM tfs q JOIN idfs USING (term) JOIN tfs d USING (term) JOIN lengths l ON l.doc_id = d.doc_id, whole WHERE q.doc_id % 100 = 0 GROUP BY ALL
), ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id)::INT AS rank, doc_id, round(score, 6) AS score FROM scored)
SELECT * FROM ranked WHERE rank <= 10
"""

#: crc32 by bytes: a table of 256 remainders, then one step a byte.
_REMAINDERS = """remainders AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i)
)"""
_CRC32 = "xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, remainders.t[((xor(c, x) & 255) + 1)::INT])), 4294967295)"

#: Words are hashed once each.
RESAMPLE = f"""
WITH {_REMAINDERS}, words AS (
  SELECT doc_id, NULL AS item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM documents
  UNION ALL
  SELECT NULL, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) FROM benchmark
), counted AS (
  SELECT word, count(doc_id) AS s, count(item_id) AS t FROM words GROUP BY word
), bytes AS (
  SELECT word, s, t, list_transform(range(1, 2 * strlen(word), 2), lambda i: ('0x' || substr(hex(word), i::INT, 2))::BIGINT) AS b FROM counted
), hashed AS (
  SELECT word, s, bytes.t, {_CRC32} % 10000 AS bucket FROM bytes, remainders
), buckets AS (SELECT bucket, sum(s)::DOUBLE AS s, sum(t)::DOUBLE AS t FROM hashed GROUP BY bucket
), whole AS (SELECT sum(s) AS s, sum(t) AS t FROM buckets
), gains AS (
  SELECT bucket, floor(1000 * ln((b.t + 1) * (w.s + 10000) / ((b.s + 1) * (w.t + 10000))))::BIGINT AS gain FROM buckets b, whole w
), weighed AS (
  SELECT doc_id, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
  FROM words JOIN hashed USING (word) JOIN gains USING (bucket) WHERE doc_id IS NOT NULL GROUP BY doc_id
), scored AS (
  SELECT d.doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('2024:' || d.doc_id), 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM documents d LEFT JOIN weighed USING (doc_id)
), ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20
)
SELECT s.doc_id, s.n_features, s.weight, s.score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM scored s LEFT JOIN ranked USING (doc_id)
"""

def _before(state: int, system: str) -> str:
    """The least cost before a turn in a state, without an insertion."""
    to, wants = (2, 3, 2)[max(state - 1, 0)], ("u", "a", "u")[max(state - 1, 0)]
    keep = ", ".join(x for x in (f"CASE WHEN initial = '{wants}' THEN c{to} + more END", system) if x)
    return f"least(2 + c{state}, CASE WHEN NOT gone THEN least({keep}, 1 + c{to} + more) END)"


_B = [_before(0, "CASE WHEN initial = 's' THEN c1 + more END"), *(_before(q, "") for q in (1, 2, 3))]
_AT = lambda alias: f"CASE state WHEN 0 THEN {alias}.c0 WHEN 1 THEN {alias}.c1 WHEN 2 THEN {alias}.c2 ELSE {alias}.c3 END"
_TO, _WANTS = "CASE state WHEN 2 THEN 3 ELSE 2 END", "CASE state WHEN 2 THEN 'a' ELSE 'u' END"
_TO_COST = "CASE state WHEN 2 THEN {0}.c3 ELSE {0}.c2 END"

#: Costs to go are found from the last turn backward, edits by a walk forward; states: 0 nothing yet, 1 after s, 2 after u, 3 after a.
CONVERSATION_REPAIR = f"""
WITH RECURSIVE {_REMAINDERS}, named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT) AS b FROM conversations
), hits AS (SELECT conv_id, turn, role, text, {_CRC32} % 20 AS hit FROM named, remainders
), turns AS (
  SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN hit = 1 THEN '' WHEN hit = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM hits WHERE hit <> 0
  UNION ALL SELECT conv_id, turn, role, text FROM hits WHERE hit = 3
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i, count(*) OVER (PARTITION BY conv_id) AS n,
         right(rtrim(text, {_STRIP}), 1) AS mark FROM turns
), counted AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen FROM placed
), marked AS (
  SELECT *, substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS previous, mark = '' AS blank, mark <> '' AND seen > 1 AS duplicate,
         mark <> '' AND seen = 1 AND mark NOT IN ('.', '!', '?') AS truncated, mark = '' OR seen > 1 AS gone,
         CASE WHEN mark <> '' AND seen = 1 AND mark NOT IN ('.', '!', '?') THEN 5 ELSE 0 END AS more FROM counted
), back AS (
  SELECT conv_id, n + 1 AS i, 0 AS c0, 10 AS c1, 5 AS c2, 0 AS c3 FROM marked WHERE i = 1
  UNION ALL
  SELECT conv_id, i, least(b0, 5 + least(b2, 5 + b3)), least(b1, 5 + least(b2, 5 + b3)), least(b2, 5 + b3), least(b3, 5 + b2) FROM (
    SELECT m.conv_id, m.i, {_B[0]} AS b0, {_B[1]} AS b1, {_B[2]} AS b2, {_B[3]} AS b3 FROM back b JOIN marked m ON m.conv_id = b.conv_id AND m.i = b.i - 1)
), walk AS (
  SELECT conv_id, i, n, 0 AS state, '' AS audit, []::VARCHAR[] AS lines FROM (SELECT conv_id, 1 AS i, n FROM marked WHERE i = 1)
  UNION ALL
  SELECT conv_id, CASE edit WHEN 'I' THEN i ELSE i + 1 END, n,
         CASE WHEN edit = 'D' THEN state WHEN edit = 'K' AND initial = 's' THEN 1 ELSE {_TO} END, audit || edit,
         CASE edit WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, role || ':' || text)
           ELSE list_append(lines, CASE state WHEN 2 THEN 'assistant' ELSE 'user' END || ':' || CASE edit WHEN 'R' THEN text ELSE '' END) END
  FROM (
    SELECT w.conv_id, w.i, w.n, state, audit, lines, role, text, initial,
           CASE WHEN m.i IS NULL THEN 'I' WHEN {_AT("b")} = 2 + {_AT("a")} THEN 'D' WHEN {_AT("b")} = 5 + {_TO_COST.format("b")} THEN 'I'
                WHEN NOT gone AND (state = 0 AND initial = 's' AND {_AT("b")} = a.c1 + more OR initial = {_WANTS} AND {_AT("b")} = {_TO_COST.format("a")} + more) THEN 'K' ELSE 'R' END AS edit
    FROM walk w JOIN back b ON b.conv_id = w.conv_id AND b.i = w.i LEFT JOIN back a ON a.conv_id = w.conv_id AND a.i = w.i + 1
    LEFT JOIN marked m ON m.conv_id = w.conv_id AND m.i = w.i WHERE w.i <= w.n OR state IN (1, 2))
), ends AS (SELECT conv_id, audit, sha256(array_to_string(lines, chr(10))) AS hash FROM walk WHERE i > n AND state IN (0, 3)
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE duplicate) AS duplicate,
         count(*) FILTER (WHERE truncated) AS truncated, count(*) FILTER (WHERE previous || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM marked GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(c0, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(hash, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts USING (conv_id) LEFT JOIN ends USING (conv_id) LEFT JOIN back ON back.conv_id = o.conv_id AND back.i = 1
"""

ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": SUBSTRING_DEDUP,
    "op2_bm25_topk": BM25_TOPK,
    "op4_license_scan": _license_sql(),
    "op8_line_dedup": LINE_DEDUP,
    "op11_importance_resampling": RESAMPLE,
    "op13_conversation_repair": CONVERSATION_REPAIR,
}
