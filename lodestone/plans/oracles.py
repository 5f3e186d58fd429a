"""DuckDB SQL for the rows of the registered queries."""

from __future__ import annotations

from ..functions import text as T
from ..operators import evaluate, guard, verify

_CLEAN = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g'),
  '([\p{L}\p{N}_])-\s*\n\s*([\p{L}\p{N}_])', '\1\2', 'g'), '[ \t]{2,}', ' ', 'g'), '(?m)^[ \t]+|[ \t]+$', '', 'g'),
  '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9))"""

_CHUNKS = rf"""
pages AS (SELECT doc_id AS document_id, {_CLEAN} AS c FROM documents),
cut AS (
  SELECT document_id, c, 0 AS s, 0 AS pos FROM pages WHERE c <> '' AND length(c) > 800
  UNION ALL
  SELECT document_id, c, s + CASE
      WHEN length(regexp_extract(w, '(?s)^.*\n\s*\n')) > 400 THEN length(regexp_extract(w, '(?s)^.*\n\s*\n'))
      WHEN length(regexp_extract(w, '(?s)^.*[.!?]\s+')) > 400 THEN length(regexp_extract(w, '(?s)^.*[.!?]\s+'))
      WHEN contains(w, ' ') AND 800 - strpos(reverse(w), ' ') >= 400 THEN 800 - strpos(reverse(w), ' ')
      ELSE 800 END - 120, pos + 1
  FROM (SELECT *, substr(c, s + 1, 800) AS w FROM cut WHERE s + 800 < length(c))),
spans AS (
  SELECT document_id, pos, c, s, lead(s) OVER (PARTITION BY document_id ORDER BY pos) AS t FROM cut),
pieces AS (
  SELECT document_id, pos, trim(CASE WHEN t IS NULL THEN substr(c, s + 1) ELSE substr(c, s + 1, t + 120 - s) END, ' ' || chr(10) || chr(9)) AS text FROM spans
  UNION ALL SELECT document_id, 0, c FROM pages WHERE c <> '' AND length(c) <= 800),
chunks AS (
  SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY pos) - 1 AS chunk_ord, text FROM pieces WHERE text <> '')"""

_TOKEN = "[A-Za-z0-9\u0900-\u097f]+(?:[-/.][A-Za-z0-9]+)*"


def _tokens(text: str) -> str:
    return f"list_transform(regexp_extract_all({text}, '{_TOKEN}'), lambda x: lower(x))"


def _bm25(corpus: str) -> str:
    """Tables of the index over ``corpus`` (chunk_id, text) and the lists of ``asked`` (query_id, question)."""
    return f"""
tok AS (SELECT chunk_id, {_tokens('text')} AS ts FROM {corpus}),
dl AS (SELECT chunk_id, len(ts) AS dl FROM tok),
stat AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
post AS (SELECT term, chunk_id, count(*) AS tf FROM (SELECT chunk_id, unnest(ts) AS term FROM tok) GROUP BY ALL),
raw AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS r FROM post, stat GROUP BY term),
terms AS (SELECT term, df, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_tokens('question')}) AS term FROM asked) GROUP BY ALL),
bs AS (
  SELECT query_id, chunk_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM post JOIN qt USING (term) JOIN terms USING (term) JOIN dl USING (chunk_id), stat GROUP BY ALL),
bm AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM bs) WHERE rank <= 10)"""


def _hashed(table: str, key: str, text: str, name: str) -> str:
    return f"""
{name}1 AS (
  SELECT {key}, code % 64 AS bucket, sum(CASE WHEN (code // 64) % 2 = 0 THEN 1 ELSE -1 END) AS w
  FROM (SELECT {key}, ('0x' || substr(md5(t), 1, 8))::BIGINT AS code FROM (SELECT {key}, unnest({_tokens(text)}) AS t FROM {table})) GROUP BY ALL HAVING w <> 0),
{name} AS (SELECT {key}, bucket, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS w FROM {name}1)"""


def _vector(corpus: str) -> str:
    return f"""{_hashed(corpus, 'chunk_id', 'text', 'hd')}, {_hashed('asked', 'query_id', 'question', 'hq')},
vs AS (SELECT query_id, chunk_id, sum(hd.w * hq.w) AS score FROM hd JOIN hq USING (bucket) GROUP BY ALL),
ve AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM vs) WHERE rank <= 10)"""


_ASKED = "asked AS (SELECT item_id AS query_id, text AS question FROM benchmark)"
_CORPUS = "corpus AS (SELECT doc_id AS chunk_id, text FROM documents)"
_BOTH = f"{_ASKED}, {_CORPUS}, {_bm25('corpus')}, {_vector('corpus')}"
_HITS = """
hits AS (SELECT 'vector' AS retriever, 0 AS ord, query_id, chunk_id, rank, score FROM ve
         UNION ALL SELECT 'bm25', 1, query_id, chunk_id, rank, score FROM bm)"""


def _fused(part: str) -> str:
    return f"""
parts AS (SELECT *, {part} AS part FROM hits),
fused AS (
  SELECT query_id, chunk_id, sum(part) AS s, string_agg(retriever, ',' ORDER BY ord) AS retrievers,
         max(rank) FILTER (ord = 0) AS rank_vector, max(rank) FILTER (ord = 1) AS rank_bm25, count(*) > 1 AS found_by_multiple,
         min(ord * 1000 + rank) AS seen
  FROM parts GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, seen) AS fused_rank FROM fused)"""


_SHOW = "query_id, chunk_id, round(s, 6) AS score, retrievers, rank_vector, rank_bm25, found_by_multiple"
_RRF = _fused("1.0 / (60 + rank)")
_KEY = r"trim(regexp_replace(replace(lower({}), 'ß', 'ss'), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"

_GRAPH = f"""
ent AS (
  SELECT *, substr(sha1(type || '|' || {_KEY.format('name')}), 1, 16) AS entity_id FROM (
    SELECT 'Organization' AS type, c_name AS name, 'c' || c_custkey AS own FROM customer
    UNION ALL SELECT 'Location', n_name, 'n' || n_nationkey FROM nation
    UNION ALL SELECT 'Location', r_name, 'r' || r_regionkey FROM region)),
rawe AS (
  SELECT 'c' || c_custkey AS s, 'n' || c_nationkey AS t, 'LOCATED_IN' AS type FROM customer
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'PART_OF' FROM nation),
edge AS (
  SELECT s, substr(sha1(a.entity_id || '|' || rawe.type || '|' || b.entity_id), 1, 16) AS relationship_id, a.entity_id AS source_id, b.entity_id AS target_id, rawe.type
  FROM rawe JOIN ent a ON a.own = s JOIN ent b ON b.own = t),
told AS (SELECT o_orderkey AS chunk_id, year(o_orderdate) AS document_id, 'c' || o_custkey AS own, 0.7 + (o_orderkey % 30) / 100 AS confidence FROM orders),
ev AS (SELECT relationship_id, chunk_id, document_id, confidence FROM told JOIN edge ON edge.s = told.own),
men AS (SELECT entity_id, chunk_id, document_id FROM told JOIN ent USING (own))"""

_STOP = ", ".join(f"'{w}'" for w in T.GRAPH_STOP_WORDS)
_TOKENS_OF = f"list_filter(list_distinct(regexp_extract_all(lower({{}}), '[a-z0-9]+')), lambda x: x NOT IN ({_STOP}))"
_CUSTOMERS = """
cask AS (
  SELECT c_custkey AS query_id, 'Does ' || c_name || ' work in ' || n_name || ', located in ' || r_name || '?' AS question
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_custkey % 50 = 0)"""
_SEEDS = f"""{_GRAPH}, {_CUSTOMERS},
qtok AS (SELECT query_id, {_TOKENS_OF.format('question')} AS q FROM cask),
nt AS (SELECT entity_id, name, {_TOKENS_OF.format('name')} AS own FROM ent),
cand AS (
  SELECT *, len(list_intersect(own, q)) AS shared FROM nt, qtok WHERE len(list_intersect(own, q)) / len(own) >= 0.6
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, entity_id) <= 25),
seeds AS (
  SELECT query_id, row_number() OVER w AS seed_rank, entity_id, name, round(shared / len(own), 3) AS match FROM cand
  WINDOW w AS (PARTITION BY query_id ORDER BY round(shared / len(own), 3) DESC, length(name) DESC, entity_id) QUALIFY seed_rank <= 5),
hop AS (
  SELECT query_id, relationship_id, source_id, target_id, type
  FROM (SELECT DISTINCT query_id, edge.* FROM edge JOIN seeds ON entity_id IN (source_id, target_id))
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY relationship_id) <= 50)"""

_FOUND = f"""{_SEEDS},
fw AS (
  SELECT hop.query_id, hop.relationship_id, (1 + CASE WHEN a.match IS NOT NULL AND b.match IS NOT NULL THEN 1 ELSE 0 END
           + CASE WHEN type = 'LOCATED_IN' THEN 1 ELSE 0 END) * greatest(coalesce(a.match, 0), coalesce(b.match, 0)) AS w,
         list_filter([a.name, b.name], lambda x: x IS NOT NULL) AS names
  FROM hop LEFT JOIN seeds a ON a.query_id = hop.query_id AND a.entity_id = source_id
           LEFT JOIN seeds b ON b.query_id = hop.query_id AND b.entity_id = target_id),
mn AS (
  SELECT query_id, entity_id, chunk_id, match, name FROM men JOIN seeds USING (entity_id)
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY entity_id, chunk_id) <= 100),
parts AS (
  SELECT query_id, chunk_id, w * confidence AS part, names FROM fw JOIN ev USING (relationship_id)
  UNION ALL SELECT query_id, chunk_id, 0.3 * match, [name] FROM mn),
found AS (
  SELECT query_id, chunk_id, round(s, 4) AS score, entities, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, chunk_id) AS rank
  FROM (SELECT query_id, chunk_id, sum(part) AS s, array_to_string(list_sort(list_distinct(flatten(list(names)))), '|') AS entities FROM parts GROUP BY ALL)
  QUALIFY rank <= 10),
ochunk AS (
  SELECT o_orderkey AS chunk_id, year(o_orderdate) AS document_id, 'orders of ' || year(o_orderdate) AS document_name, 1 AS page_number,
         'Order ' || o_orderkey || ' of ' || c_name || ' in ' || n_name || ' priority ' || o_orderpriority AS text
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""

_CHUNK_IDS = "SELECT document_id || '_chunk_' || chunk_ord AS chunk_id, document_id, chunk_ord, text FROM chunks"
_TOLD = rf"""{_CHUNKS},
told0 AS (
  SELECT *, document_id + chunk_ord AS n, list_filter(string_split(regexp_replace(text, '[ \t\n\x0b\f\r]+', ' ', 'g'), ' '), lambda x: x <> '') AS ws FROM ({_CHUNK_IDS})),
toldc AS (
  SELECT *, ' ' || {_KEY.format('text')} || ' ' AS tk, list_append(list_transform(range(0, (len(ws) - 1) // 5 + 1), lambda k: ws[k * 5 + 1]), 'zzzz') AS named
  FROM told0 WHERE len(ws) > 0)"""
_RAW_ENTITIES = rf"""{_TOLD},
rawent AS (
  SELECT chunk_id, tk, pos, named[pos + 1] AS name, ['Person', 'organization', 'Animal', 'Concept'][(n + pos) % 4 + 1] AS type
  FROM (SELECT *, unnest(range(0, len(named))) AS pos FROM toldc) WHERE pos < 25),
namede AS (SELECT *, trim(trim(regexp_replace(name, '\s+', ' ', 'g')), '"''`.,;:') AS entity_name FROM rawent),
keyed AS (
  SELECT *, {_KEY.format('entity_name')} AS name_key,
         CASE lower(trim(type)) WHEN 'person' THEN 'Person' WHEN 'organization' THEN 'Organization' WHEN 'concept' THEN 'Concept' END AS entity_type FROM namede),
judged AS (
  SELECT *, CASE WHEN length(name_key) < 2 THEN 'empty_or_too_short_name' WHEN entity_type IS NULL THEN 'type_not_allowed:' || type
                 WHEN NOT contains(tk, ' ' || name_key || ' ') THEN 'name_not_found_in_chunk' END AS reason FROM keyed),
accepted AS (SELECT * FROM judged WHERE reason IS NULL QUALIFY row_number() OVER (PARTITION BY chunk_id, name_key ORDER BY pos) = 1)"""
_STRIPPED = "trim(trim({}), '\"''`.,;:')"
_RELATIONS = rf"""{_RAW_ENTITIES},
rel AS (
  SELECT chunk_id, tk, pos, named[pos + 1] AS source, named[pos + 2] AS target, ['related to', 'Works-For', 'likes', 'RELATED_TO'][(n + pos) % 4 + 1] AS type,
         array_to_string(ws[pos * 5 + 1 : pos * 5 + 6], ' ') AS evidence, 0.65 + ((n + pos) % 10) / 20 AS confidence
  FROM (SELECT *, unnest(range(0, len(named) - 1)) AS pos FROM toldc) WHERE pos < 40),
r2 AS (
  SELECT *, trim(regexp_replace(upper(trim(type)), '[^A-Z0-9]+', '_', 'g'), '_') AS relation,
         {_KEY.format(_STRIPPED.format('source'))} AS sk, {_KEY.format(_STRIPPED.format('target'))} AS gk, {_KEY.format('evidence')} AS ek FROM rel),
r3 AS (
  SELECT r2.*, a.entity_type AS st, b.entity_type AS tt, a.name_key AS sn, b.name_key AS tn
  FROM r2 LEFT JOIN accepted a ON a.chunk_id = r2.chunk_id AND a.name_key = sk LEFT JOIN accepted b ON b.chunk_id = r2.chunk_id AND b.name_key = gk),
r4 AS (
  SELECT *, CASE WHEN st IS NULL OR tt IS NULL THEN 'endpoint_not_a_valid_entity' WHEN st = tt AND sn = tn THEN 'self_loop'
    WHEN relation NOT IN ('RELATED_TO', 'WORKS_FOR') THEN 'type_not_allowed:' || relation WHEN confidence < 0.7 THEN 'low_confidence:' || printf('%.2f', confidence)
    WHEN ek = '' OR NOT (contains(tk, ek) OR len(list_filter(string_split(ek, ' '), lambda w: contains(tk, ' ' || w || ' '))) / len(string_split(ek, ' ')) >= 0.8) THEN 'evidence_not_in_chunk'
    WHEN NOT contains(' ' || ek || ' ', ' ' || sn || ' ') OR NOT contains(' ' || ek || ' ', ' ' || tn || ' ') THEN 'entities_not_named_in_evidence'
    WHEN relation = 'WORKS_FOR' AND st <> 'Person' THEN 'source_type_not_allowed:WORKS_FOR:' || st
    WHEN relation = 'WORKS_FOR' AND tt NOT IN ('Organization', 'Company') THEN 'target_type_not_allowed:WORKS_FOR:' || tt END AS reason
  FROM r3),
racc AS (
  SELECT chunk_id, substr(sha1(sid || '|' || relation || '|' || tid), 1, 16) AS relationship_id, relation AS type, evidence, confidence, pos
  FROM (SELECT *, substr(sha1(st || '|' || sn), 1, 16) AS sid, substr(sha1(tt || '|' || tn), 1, 16) AS tid FROM r4 WHERE reason IS NULL)),
rone AS (
  SELECT chunk_id, relationship_id, any_value(type) AS type, max(confidence) AS confidence, arg_min(substr(trim(evidence), 1, 500), pos) AS evidence
  FROM racc GROUP BY chunk_id, relationship_id)"""

_DOT = "\u2024"
_ABBREVIATIONS = "|".join(T.ABBREVIATIONS).replace(".", r"\.")


def _sentences(text: str) -> str:
    """A list: separators are marked, as there is no look-behind to split at."""
    # Twice for initials, as a match uses up its right neighbour.
    c = rf"regexp_replace({text}, '(?i)(^|[^\p{{L}}\p{{N}}_])({_ABBREVIATIONS})\.', '\1\2{_DOT}', 'g')"
    for _ in range(2):
        c = rf"regexp_replace({c}, '(^|[^\p{{L}}\p{{N}}_])([A-Za-z])\.([A-Za-z]\.)', '\1\2{_DOT}\3', 'g')"
    c = rf"regexp_replace({c}, '([.!?।])\s+', '\1' || chr(1), 'g')"
    c = rf"regexp_replace({c}, '\n\s*•\s*|\n{{2,}}', chr(1), 'g')"
    return f"list_filter(list_transform(string_split({c}, chr(1)), lambda p: replace(trim(p, ' •' || chr(10)), '{_DOT}', '.')), lambda p: p <> '')"


_EVIDENCE = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\x{F0A7}\x{F0B7}\x{F076}\x{F0D8}\x{F0FC}▪●]', '•', 'g'),
  '[ \t]+', ' ', 'g'), '([^.!?:।\n])\n([^\n•])', '\1 \2', 'g'), '\s*•\s*', chr(10) || '• ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10))"""

def _mean(c: str, where: str = "true") -> str:
    """To three decimals, exactly: values have no more than that."""
    return f"((2 * sum(CAST(round({c} * 1000) AS BIGINT)) FILTER ({where}) + count({c}) FILTER ({where})) // (2 * count({c}) FILTER ({where}))) / 1000"


_CASES = """
cases AS (
  SELECT doc_id, source AS run, CASE WHEN quality = 1 THEN 'answer' ELSE 'refuse' END AS expected_behavior,
         CASE WHEN toxic = 0 THEN 'answer' ELSE 'refuse' END AS observed_behavior, source,
         trim(regexp_replace(replace(replace(lower(text), 'ß', 'ss'), ',', ''), '\\s+', ' ', 'g')) AS a
  FROM documents JOIN labels USING (doc_id)),
scored AS (
  SELECT doc_id, run, expected_behavior, CAST(expected_behavior = observed_behavior AS DOUBLE) AS behavior_correct,
         CASE WHEN expected_behavior = observed_behavior AND expected_behavior = 'answer' THEN CAST(contains(lower(source), 'src1') AS DOUBLE) END AS source_hit,
         CASE WHEN expected_behavior = observed_behavior AND expected_behavior = 'answer'
              THEN round((contains(a, 'the')::INT + contains(a, '1000')::INT + contains(a, 'that')::INT) / 3, 3) END AS key_facts
  FROM cases)""".replace("\\\\", "\\")

# RE2 has no look-ahead: digits that a card's word follows are one pattern in order.
_SECRETS = [p.replace(r"(?:\d[ -]?){13,19}\b(?=.*\b(card|credit|debit|cvv)\b)", r"(?:\d[ -]?){13,19}\b.*\b(card|credit|debit|cvv)\b") for p in guard.SECRETS]


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _screened(rows: str) -> str:
    """c and v: the category and reason of ``rows`` (any keys, text)."""
    cases = []
    for text in ("cleaned", "text"):
        cases += [f"WHEN regexp_matches({text}, {_quoted(p)}) THEN 'sensitive_data|question contains a secret'" for p in _SECRETS]
        cases += [f"WHEN regexp_matches({text}, {_quoted('(?is)' + p)}) THEN {_quoted('prompt_injection|' + why)}" for p, why in guard.INJECTIONS]
    return rf"""
c AS (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS cleaned FROM ({rows})),
v AS (SELECT *, CASE WHEN cleaned = '' THEN 'invalid|empty question' WHEN length(cleaned) > 1000 THEN 'invalid|question too long'
  WHEN len(regexp_extract_all(cleaned, '\p{{L}}')) < 2 THEN 'invalid|no words in question' {' '.join(cases)}
  WHEN regexp_matches(cleaned, {_quoted(guard.CHIT_CHAT)}) THEN 'chit_chat|greeting or small talk'
  WHEN regexp_matches(cleaned, {_quoted(guard.OUT_OF_SCOPE)}) THEN 'out_of_scope|task is not a question about the documents' ELSE 'ok|' END AS v FROM c)"""


_GUARD = f"""
WITH {_screened("SELECT conv_id, turn, text FROM conversations WHERE role = 'user'")}
SELECT conv_id, turn, split_part(v, '|', 1) AS category, split_part(v, '|', 2) AS reason, sha256(cleaned) AS cleaned_sha256,
       CASE WHEN cleaned <> trim(text) THEN 'collapsed extra whitespace' ELSE '' END AS changes
FROM v"""

_IN_CHUNKS = f"{_ASKED}, {_CHUNKS}, corpus AS ({_CHUNK_IDS}), {_bm25('corpus')}, {_vector('corpus')}, {_HITS}, {_RRF}"
_RERANKED = f"""{_IN_CHUNKS},
logit AS (
  SELECT query_id, chunk_id, fused_rank, text, 8 * len(list_intersect(list_distinct({_tokens('question')}), {_tokens('substr(text, 1, 2000)')})) / greatest(len(list_distinct({_tokens('question')})), 1) - 4 AS x
  FROM ranked JOIN asked USING (query_id) JOIN corpus USING (chunk_id) WHERE fused_rank <= 30),
kept AS (SELECT *, round(1 / (1 + exp(-x)), 4) AS rerank_score FROM logit WHERE round(1 / (1 + exp(-x)), 4) >= 0.3),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, fused_rank) AS rank FROM kept QUALIFY rank <= 5)"""
_CONTEXT = rf"""
WITH RECURSIVE {_RERANKED},
s AS (SELECT query_id, rank, unnest(range(0, len(p))) AS pos, unnest(p) AS sentence FROM (SELECT query_id, rank, {_sentences(_EVIDENCE)} AS p FROM best)),
k AS (SELECT *, regexp_extract_all(replace(lower(sentence), 'ß', 'ss'), '[\p{{L}}\p{{N}}_]+') AS ws FROM s),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id, array_to_string(ws, ' ') ORDER BY rank, pos) = 1 AS fresh FROM k WHERE len(ws) >= 4),
told AS (SELECT query_id, rank, coalesce(string_agg('• ' || sentence, chr(10) ORDER BY pos) FILTER (fresh), '') AS t, count(*) FILTER (NOT fresh) AS again FROM f GROUP BY ALL),
hit AS (SELECT query_id, rank, coalesce(t, '') AS t, coalesce(again, 0) AS again FROM best LEFT JOIN told USING (query_id, rank)),
fold AS (
  SELECT DISTINCT query_id, 0::BIGINT AS rank, 0 AS n, 0::BIGINT AS used, 0 AS dropped, 0::BIGINT AS removed, []::VARCHAR[] AS texts FROM hit
  UNION ALL
  SELECT query_id, h.rank, CASE WHEN take THEN n + 1 ELSE n END, CASE WHEN take THEN used + length(x) ELSE used END, CASE WHEN take THEN dropped ELSE dropped + 1 END,
         CASE WHEN n >= 8 THEN removed ELSE removed + again END, CASE WHEN take THEN list_append(texts, x) ELSE texts END
  FROM (
    SELECT fold.*, hit.rank AS hrank, again, n < 8 AND t <> '' AND (used + length(t) <= 6000 OR n = 0) AS take,
           CASE WHEN used + length(t) <= 6000 THEN t ELSE regexp_replace(substr(t, 1, 6000), '(?s)^(.*) .*$', '\1') || ' …' END AS x
    FROM fold JOIN hit USING (query_id) WHERE hit.rank = fold.rank + 1) h0, LATERAL (SELECT h0.hrank AS rank) h)
SELECT query_id, n AS n_sources, sha256(array_to_string(texts, chr(10) || chr(10))) AS context_sha256, dropped AS dropped_chunks, removed AS removed_duplicate_sentences, n = 0 AS is_empty
FROM fold QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank DESC) = 1"""


_ANSWERED = f"""
WITH RECURSIVE cx AS ({_CONTEXT}), {_screened('SELECT item_id AS query_id, text FROM benchmark')},
j AS (SELECT query_id, split_part(v, '|', 1) AS category, n_sources, v = 'ok|' AS ok, coalesce(n_sources, 0) > 0 AS told FROM v LEFT JOIN cx USING (query_id))
SELECT query_id, category, CASE WHEN NOT ok THEN NULL WHEN told THEN 'The documents describe this [1].' ELSE {_quoted(verify.REFUSAL)} END AS answer,
       CASE WHEN ok THEN true END AS grounded, CASE WHEN ok THEN NOT told END AS insufficient_evidence, ok AND told AS regenerated,
       CASE WHEN ok AND told THEN 1 ELSE 0 END AS n_refs, CASE WHEN ok AND told THEN 1 ELSE 0 END AS supported, CASE WHEN ok AND told THEN 1 ELSE 0 END AS unsupported,
       CASE WHEN ok AND told THEN n_sources END AS n_sources FROM j"""


def _numbers(text: str) -> str:
    bare = f"regexp_extract_all(regexp_replace({text}, '\\[(\\d{{1,2}})\\]', ' ', 'g'), '\\d[\\d,]*(?:\\.\\d+)?')".replace("\\\\", "\\")
    plain = "regexp_replace(CASE WHEN contains(replace(x, ',', ''), '.') THEN regexp_replace(replace(x, ',', ''), '\\.?0*$', '') ELSE replace(x, ',', '') END, '^0+', '')".replace("\\\\", "\\")
    return f"list_distinct(list_transform({bare}, lambda x: CASE WHEN {plain} = '' THEN '0' ELSE {plain} END))"


_ANSWERS = rf"""
WITH a AS (SELECT conv_id AS query_id, arg_max(text || ' It has 12 parts [1].', turn) AS answer FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
src AS (SELECT conv_id AS query_id, turn + 1 AS ref, {_numbers('text')} AS has FROM conversations WHERE role = 'user'),
se AS (SELECT query_id, unnest(range(0, len(p))) AS pos, unnest(p) AS sentence FROM (SELECT query_id, {_sentences('answer')} AS p FROM a)),
c AS (SELECT *, list_distinct(list_transform(regexp_extract_all(sentence, '\[(\d{{1,2}})\]', 1), lambda x: x::INT)) AS cites, {_numbers('sentence')} AS nums FROM se),
told AS (SELECT c.query_id, pos, flatten(list(has)) AS held FROM c JOIN src ON src.query_id = c.query_id AND list_contains(cites, src.ref) GROUP BY ALL),
m AS (
  SELECT c.*, list_filter(nums, lambda x: NOT list_contains(coalesce(held, []), x)) AS missing,
         EXISTS (SELECT 1 FROM src x JOIN src y ON x.query_id = y.query_id AND x.ref <= y.ref WHERE x.query_id = c.query_id AND list_has_all(list_concat(x.has, y.has), c.nums)) AS covered
  FROM c LEFT JOIN told USING (query_id, pos)),
st AS (
  SELECT *, CASE WHEN len(cites) = 0 AND len(nums) > 0 THEN 'unsupported' WHEN len(cites) = 0 THEN 'meta' WHEN len(missing) > 0 AND NOT covered THEN 'unsupported'
                 WHEN len(missing) > 0 THEN 'corrected' ELSE 'supported' END AS status FROM m)
SELECT query_id, count(*) FILTER (status = 'supported') AS supported, count(*) FILTER (status = 'corrected') AS corrected, count(*) FILTER (status = 'unsupported') AS unsupported,
       count(*) FILTER (status = 'meta') AS meta, count(*) FILTER (status = 'unsupported') = 0 AS passed,
       coalesce(bool_or(status IN ('supported', 'corrected') AND len(cites) > 0), false) AS has_supported_facts
FROM a LEFT JOIN st USING (query_id) GROUP BY query_id"""

_ORDER_DOCS = f"""{_GRAPH},
oc AS (SELECT o_orderkey AS chunk_id, CAST(year(o_orderdate) AS VARCHAR) AS document_id FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
left_ AS (SELECT * FROM oc WHERE document_id <> '1996' AND (document_id <> '1995' OR chunk_id % 2 = 0))"""
_BAD = r"(len(regexp_extract_all(text, '\x{FFFD}')) + 5 * len(regexp_extract_all(text, '\(cid:\d+\)'))) / length(regexp_replace(text, '\s', '', 'g'))"
_INGEST = f"""{_CHUNKS},
ch AS (SELECT document_id, count(*) FILTER (NOT coalesce({_BAD} > 0.01, false)) AS good FROM chunks GROUP BY 1),
d AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS document_id, min(CAST(doc_id AS VARCHAR)) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
fate AS (
  SELECT d.*, good, CASE WHEN good IS NULL THEN 'unreadable' WHEN good = 0 THEN 'needs_ocr' WHEN d.document_id <> first THEN 'duplicate' ELSE 'registered' END AS outcome
  FROM d LEFT JOIN ch ON ch.document_id = d.doc_id)"""

_SEGMENTS = f"""{_CHUNKS},
good AS (SELECT * FROM ({_CHUNK_IDS}) WHERE NOT coalesce({_BAD} > 0.01, false)),
dd AS (SELECT doc_id, coalesce(text, '') AS content FROM documents WHERE doc_id IN (SELECT document_id FROM good)),
held AS (SELECT * FROM dd QUALIFY row_number() OVER (PARTITION BY content ORDER BY doc_id % 3, CAST(doc_id AS VARCHAR)) = 1),
kept AS (SELECT * FROM held WHERE doc_id % 50 <> 7),
back AS (
  SELECT * FROM dd WHERE doc_id % 100 = 7 AND content NOT IN (SELECT content FROM kept)
  QUALIFY row_number() OVER (PARTITION BY content ORDER BY CAST(doc_id AS VARCHAR)) = 1),
stored AS (SELECT * FROM kept UNION ALL SELECT * FROM back),
corpus AS (SELECT chunk_id, document_id, text FROM good WHERE document_id IN (SELECT doc_id FROM stored))"""

ORACLES: dict[str, str] = {
    "clean_documents": f"SELECT doc_id, sha256(c) AS clean_sha256, length(c) AS n_clean FROM (SELECT doc_id, {_CLEAN} AS c FROM documents)",
    "chunk_documents": f"WITH RECURSIVE {_CHUNKS} SELECT document_id || '_chunk_' || chunk_ord AS chunk_id, document_id, chunk_ord, text FROM chunks",
    "fixed_chunks": "SELECT doc_id, i AS pos, substr(text, i * 2500 + 1, 2500) AS piece FROM documents, range(0, 100000) r(i) WHERE i * 2500 < length(text)",
    "document_hash_dedup": "SELECT min(doc_id) AS doc_id, sha256(coalesce(text, '')) AS file_hash FROM documents GROUP BY 2",
    "quality_filter": r"""
SELECT doc_id, e OR u > 0.01 AS garbled, CASE WHEN e THEN 'empty' WHEN u > 0.01 THEN 'unmapped_characters' ELSE '' END AS reason, CASE WHEN NOT e AND u > 0.01 THEN round(u, 6) ELSE 0.0 END AS bad_word_ratio
FROM (SELECT doc_id, trim(text) = '' AS e, (len(regexp_extract_all(text, '\x{FFFD}')) + 5 * len(regexp_extract_all(text, '\(cid:\d+\)'))) / length(regexp_replace(text, '\s', '', 'g')) AS u FROM documents)""",
    "upload_validation": """
SELECT doc_id, name, n_bytes, CASE WHEN NOT regexp_matches(lower(name), '\\.(pdf|docx|txt|md)$') THEN 'unsupported_type' WHEN n_bytes > 26214400 THEN 'too_large' WHEN n_bytes = 0 THEN 'empty' END AS reason
FROM (SELECT doc_id, source || ['.pdf', '.txt', '.exe', '.MD'][doc_id % 4 + 1] AS name, strlen(text) AS n_bytes FROM documents)""".replace("\\\\", "\\"),
    "index_stats": "SELECT (SELECT count(*) FROM documents) AS documents, (SELECT sum(ceil(length(text) / 2500))::BIGINT FROM documents) AS chunks, (SELECT count(*) FROM embeddings) AS vectors, (SELECT count(*) FROM documents) AS bm25_chunks",
    "bm25_term_stats": f"WITH {_ASKED}, {_CORPUS}, {_bm25('corpus')} SELECT term, df, round(idf, 6) AS idf FROM terms",
    "bm25_search_batch": f"WITH {_ASKED}, {_CORPUS}, {_bm25('corpus')} SELECT query_id, rank, chunk_id, round(score, 5) AS score FROM bm",
    "bm25_common_words": f"""
WITH corpus AS (
  SELECT o_orderkey AS chunk_id, concat_ws(' ', 'this is an order of goods on the way', CASE WHEN o_orderkey % 3 > 0 THEN 'usual' END,
         CASE WHEN o_orderkey > 4 THEN 'late' END, lower(o_orderpriority),
         CASE WHEN row_number() OVER (ORDER BY o_orderkey) % 2 = 0 THEN 'even' END) AS text FROM orders),
asked AS (
  SELECT trim(concat_ws(' ', w, p)) AS query_id, trim(concat_ws(' ', w, p)) AS question
  FROM (SELECT unnest(['usual', 'late', 'even']) AS w), (SELECT DISTINCT lower(o_orderpriority) AS p FROM orders UNION ALL SELECT '')),
{_bm25('corpus')},
every AS (
  SELECT query_id, chunk_id, score, bs.chunk_id IS NOT NULL AS matched,
         row_number() OVER (PARTITION BY query_id ORDER BY round(coalesce(score, 0), 9) DESC, chunk_id) AS place
  FROM corpus CROSS JOIN asked LEFT JOIN bs USING (query_id, chunk_id))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY place) AS rank, chunk_id, round(score, 5) AS score
FROM every WHERE place <= 10 AND matched""",
    "vector_search_batch": """
SELECT query_id, chunk_id, round(score, 4) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM (
    SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, list_inner_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score
    FROM embeddings v, embeddings q WHERE q.vec_id % 50 = 0)) WHERE rank <= 10""",
    "vector_normalize": """
SELECT vec_id, round(embedding[1]::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS first, 1.0::DOUBLE AS norm FROM embeddings""",
    "hashed_vector_search": f"WITH {_ASKED}, {_CORPUS}, {_vector('corpus')} SELECT query_id, rank, chunk_id, round(score, 5) AS score FROM ve",
    "compare_retrievers": f"WITH {_BOTH}, {_HITS} SELECT query_id, retriever, rank, chunk_id, round(score, 5) AS score FROM hits",
    "rrf_fusion": f"WITH {_BOTH}, {_HITS}, {_RRF} SELECT fused_rank, {_SHOW} FROM ranked",
    "weighted_fusion": f"WITH {_BOTH}, {_HITS}, {_fused('CASE WHEN retriever = ' + repr('bm25') + ' THEN 2.0 ELSE 1.0 END * CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END').replace('FROM hits)', 'FROM hits WINDOW w AS (PARTITION BY query_id, retriever))')} SELECT {_SHOW} FROM ranked",
    "hybrid_search": f"WITH RECURSIVE {_IN_CHUNKS} SELECT fused_rank, {_SHOW} FROM ranked",
    "rerank_threshold": f"WITH RECURSIVE {_RERANKED} SELECT query_id, rank, chunk_id, fused_rank, rerank_score FROM best",
    "sentence_split": f"SELECT doc_id, unnest(range(0, len(p))) AS pos, unnest(p) AS sentence FROM (SELECT doc_id, {_sentences('text')} AS p FROM documents)",
    "context_dedup": rf"""
WITH s AS (SELECT conv_id AS query_id, turn AS hit_rank, unnest(range(0, len(p))) AS pos, unnest(p) AS sentence FROM (SELECT conv_id, turn, {_sentences(_EVIDENCE)} AS p FROM conversations)),
k AS (SELECT *, regexp_extract_all(replace(lower(sentence), 'ß', 'ss'), '[\p{{L}}\p{{N}}_]+') AS ws FROM s),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id, array_to_string(ws, ' ') ORDER BY hit_rank, pos) = 1 AS fresh FROM k WHERE len(ws) >= 4)
SELECT query_id, hit_rank, count(*) AS sentences, count(*) FILTER (NOT fresh) AS repeats, sum(len(ws))::BIGINT AS words FROM f GROUP BY ALL""",
    "entity_ids": f"WITH {_GRAPH} SELECT entity_id, name, type FROM ent",
    "graph_seed_entities": f"WITH {_SEEDS} SELECT query_id, seed_rank, entity_id, name, match FROM seeds",
    "graph_one_hop": f"WITH {_SEEDS} SELECT query_id, relationship_id, source_id, target_id, type FROM hop",
    "graph_search": f"WITH {_FOUND} SELECT query_id, rank, chunk_id, score, entities FROM found",
    "graph_delete_document": f"""
WITH {_GRAPH},
e2 AS (SELECT * FROM ev WHERE document_id > 1998), m2 AS (SELECT * FROM men WHERE document_id > 1998),
g2 AS (SELECT * FROM edge WHERE relationship_id IN (SELECT relationship_id FROM e2)),
gone AS (SELECT * FROM edge WHERE relationship_id IN (SELECT relationship_id FROM ev WHERE document_id <= 1998)),
touched AS (SELECT entity_id FROM men WHERE document_id <= 1998 UNION SELECT source_id FROM gone UNION SELECT target_id FROM gone),
used AS (SELECT entity_id FROM m2 UNION SELECT source_id FROM g2 UNION SELECT target_id FROM g2),
orph AS (SELECT entity_id FROM touched EXCEPT SELECT entity_id FROM used)
SELECT (SELECT count(*) FROM e2) AS n_evidence, (SELECT count(*) FROM m2) AS n_mentions, (SELECT count(*) FROM g2) AS n_edges, (SELECT count(*) FROM orph) AS n_orphans,
       (SELECT count(*) FROM ent WHERE entity_id NOT IN (SELECT entity_id FROM orph)) AS n_entities""",
    "graph_counts": f"WITH {_GRAPH} SELECT (SELECT count(*) FROM ent) AS n_entities, (SELECT count(*) FROM edge) AS n_edges, (SELECT count(*) FROM ev) AS n_evidence, (SELECT count(*) FROM men) AS n_mentions",
    "graph_upsert_evidence": f"WITH {_GRAPH} SELECT relationship_id, round(max(CASE WHEN chunk_id % 2 = 0 THEN confidence ELSE 0.5 END), 6) AS confidence, count(*) AS n_chunks FROM ev GROUP BY 1",
    "entity_validation": f"WITH RECURSIVE {_RAW_ENTITIES} SELECT chunk_id, pos, name_key, entity_type, reason FROM judged",
    "graph_merge": f"""
WITH RECURSIVE {_RAW_ENTITIES}
SELECT substr(sha1(entity_type || '|' || name_key), 1, 16) AS entity_id, any_value(entity_type) AS type, count(DISTINCT chunk_id) AS n_chunks FROM accepted GROUP BY 1""",
    "relationship_validation": f"WITH RECURSIVE {_RELATIONS} SELECT chunk_id, pos, relation, reason FROM r4",
    "input_guardrail": _GUARD,
    "answer_numbers": r"""
SELECT DISTINCT doc_id, CASE WHEN z = '' THEN '0' ELSE z END AS number FROM (
  SELECT doc_id, regexp_replace(CASE WHEN contains(x, '.') THEN regexp_replace(x, '\.?0*$', '') ELSE x END, '^0+', '') AS z FROM (
    SELECT doc_id, replace(unnest(regexp_extract_all(regexp_replace(text, '\[(\d{1,2})\]', ' ', 'g'), '\d[\d,]*(?:\.\d+)?')), ',', '') AS x FROM documents))""",
    "answer_citations": r"""
SELECT conv_id, turn, sha256(trim(regexp_replace(regexp_replace(CASE WHEN r > 2 THEN replace(a, '[' || r || ']', '') ELSE a END, ' +([.,;])', '\1', 'g'), ' {2,}', ' ', 'g'))) AS text_sha256,
       CASE WHEN r <= 2 THEN r::VARCHAR ELSE '' END AS used, CASE WHEN r > 2 THEN r::VARCHAR ELSE '' END AS invalid
FROM (SELECT conv_id, turn, turn % 5 + 1 AS r, text || ' [' || (turn % 5 + 1) || '] .' AS a FROM conversations WHERE role = 'assistant')""",
    "eval_scores": f"WITH {_CASES} SELECT doc_id, behavior_correct, source_hit, key_facts FROM scored",
    "eval_summary": f"WITH {_CASES}, l AS (UNPIVOT (SELECT behavior_correct, source_hit, key_facts FROM scored) ON COLUMNS(*) INTO NAME metric VALUE value) SELECT metric, {_mean('value')} AS mean, count(*) AS n FROM l GROUP BY metric",
    "eval_by_behavior": f"WITH {_CASES} SELECT expected_behavior, count(*) AS total, sum(behavior_correct)::BIGINT AS correct FROM scored GROUP BY 1",
    "eval_compare": f"WITH {_CASES} SELECT run, {_mean('behavior_correct')} AS behavior_correct, {_mean('source_hit')} AS source_hit, {_mean('key_facts')} AS key_facts FROM scored GROUP BY run",
    "relevance_buckets": """
SELECT doc_id, CASE WHEN n_chars > 9000 THEN 'not re-ranked' ELSE CASE WHEN s >= 0.9 THEN 'very high' WHEN s >= 0.6 THEN 'high' WHEN s >= 0.3 THEN 'medium' ELSE 'low' END || ' (' || printf('%.2f', s) || ')' END AS relevance
FROM (SELECT doc_id, n_chars, (n_chars * 200 + 9000) // 18000 / 100 AS s FROM documents)""",
    "context_build": _CONTEXT,
    "answer_check": _ANSWERS,
    "retrieval_counts": f"""
WITH RECURSIVE {_RERANKED}
SELECT query_id, stage, count(*) AS n FROM (
  SELECT query_id, retriever AS stage FROM hits UNION ALL SELECT query_id, 'fused' FROM ranked UNION ALL SELECT query_id, 'returned' FROM best) GROUP BY ALL""",
    "search_metadata": f"""
WITH {_ASKED}, {_CORPUS}, {_bm25('corpus')}
SELECT query_id, rank, chunk_id, chunk_id AS document_id, source AS document_name, 1 AS page_number, sha256(text) AS text_sha256, round(score, 5) AS score FROM bm JOIN documents ON doc_id = chunk_id""",
    "context_render": r"""
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
b AS (
  SELECT conv_id, string_agg('<source id="' || (turn + 1) || '" document="conversation ' || conv_id || '"' || CASE WHEN turn <> 0 THEN ' page="' || turn || '"' ELSE '' END || '>' || chr(10)
           || regexp_replace(text, '(?i)(</?\s*source)', '\1' || chr(8203), 'g') || chr(10) || '</source>', chr(10) || chr(10) ORDER BY turn + 1) AS context FROM t GROUP BY 1),
f AS (SELECT conv_id, string_agg('- the user -[PART_OF]-> talk <source' || chr(8203) || ' ' || conv_id || ' [' || (turn + 1) || ']', chr(10) ORDER BY turn + 1) AS lines FROM t WHERE role = 'user' GROUP BY 1),
c AS (SELECT conv_id, context || CASE WHEN lines IS NULL THEN '' ELSE chr(10) || chr(10) || '<graph_facts>' || chr(10) || lines || chr(10) || '</graph_facts>' END AS context FROM b LEFT JOIN f USING (conv_id))
SELECT conv_id AS query_id, sha256(context) AS context_sha256, length(context) AS char_count FROM c""",
    "graph_hits": f"""
WITH {_FOUND},
nf AS (SELECT query_id, chunk_id, count(*) AS n_facts, round(max(confidence), 6) AS confidence FROM hop JOIN ev USING (relationship_id) GROUP BY ALL)
SELECT query_id, rank, chunk_id, ochunk.document_id, document_name, page_number, text, score, coalesce(n_facts, 0) AS n_facts, confidence
FROM found JOIN ochunk USING (chunk_id) LEFT JOIN nf USING (query_id, chunk_id)""",
    "graph_fusion": f"""
WITH {_FOUND}, asked AS (SELECT * FROM cask), {_bm25('ochunk').replace(' AS terms', ' AS terms')},
both_ AS (SELECT 'bm25' AS retriever, 1 AS ord, query_id, chunk_id, rank FROM bm UNION ALL SELECT 'knowledge_graph', 2, query_id, chunk_id, rank FROM found),
fus AS (SELECT query_id, chunk_id, sum(1.0 / (60 + rank)) AS s, string_agg(retriever, ',' ORDER BY ord) AS retrievers, min(ord * 1000 + rank) AS seen FROM both_ GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, seen) AS fused_rank, chunk_id, round(s, 6) AS score, retrievers FROM fus""",
    "graph_upsert_entities": f"""
SELECT substr(sha1('Organization|' || {_KEY.format('c_name')}), 1, 16) AS entity_id, c_name AS name, 'Organization' AS type,
       CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment || ' segment' WHEN c_custkey % 3 = 0 THEN 'x' ELSE c_mktsegment END AS description FROM customer""",
    "graph_document_status": f"""
WITH {_GRAPH},
m AS (SELECT document_id, count(DISTINCT entity_id) AS entities, count(DISTINCT chunk_id) AS chunks FROM men GROUP BY 1),
r AS (SELECT document_id, count(DISTINCT relationship_id) AS relationships FROM ev GROUP BY 1)
SELECT document_id, entities, chunks, coalesce(relationships, 0) AS relationships FROM m LEFT JOIN r USING (document_id)""",
    "graph_replace": f"""
WITH {_ORDER_DOCS}
SELECT l.document_id, 'done' AS kg_status, count(DISTINCT l.chunk_id) AS kg_chunks, count(DISTINCT entity_id) AS kg_entities, count(DISTINCT relationship_id || '/' || l.chunk_id) AS kg_relationships
FROM left_ l LEFT JOIN men ON men.chunk_id = l.chunk_id LEFT JOIN ev ON ev.chunk_id = l.chunk_id GROUP BY 1""",
    "relationship_merge": f"""
WITH RECURSIVE {_RELATIONS}
SELECT relationship_id, any_value(type) AS type, round(max(confidence), 6) AS confidence, count(DISTINCT nullif(evidence, '')) AS n_evidence, count(DISTINCT chunk_id) AS n_chunks,
       string_agg(DISTINCT chunk_id, ',' ORDER BY chunk_id) AS chunk_ids FROM rone GROUP BY 1""",
    "remove_document": "SELECT document_id, count(*) AS n FROM (SELECT nullif(doc_id % 7, 0) AS document_id FROM documents) WHERE document_id IS DISTINCT FROM 3 GROUP BY 1",
    "register_unnamed": "SELECT min(nullif(doc_id % 7, 0)) AS document_id, sha256(coalesce(text, '')) AS file_hash FROM documents GROUP BY 2",
    "vector_delete": "SELECT count(*) FILTER (vec_id % 7 <> 3) AS n_left, count(*) FILTER (vec_id % 7 = 3) AS removed FROM embeddings",
    "registry_order": "SELECT doc_id, source, row_number() OVER (ORDER BY source, doc_id) AS document_ord FROM documents",
    "split_quality": f"""
SELECT doc_id, CASE WHEN trim(text, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 'empty' WHEN {_BAD} > 0.01 THEN 'unmapped_characters' ELSE '' END AS reason FROM documents""",
    "ingest_documents": f"WITH RECURSIVE {_INGEST} SELECT document_id, outcome FROM fate",
    "incremental_ingest": f"WITH RECURSIVE {_INGEST} SELECT document_id, good AS chunk_count, good AS n_vectors FROM fate WHERE outcome = 'registered'",
    "ingest_stats": f"""
WITH RECURSIVE {_INGEST}
SELECT count(*) AS documents, sum(good)::BIGINT AS chunks, sum(good)::BIGINT AS vectors, sum(good)::BIGINT AS bm25_chunks FROM fate WHERE outcome = 'registered'""",
    "segmented_search": f"WITH RECURSIVE {_ASKED}, {_SEGMENTS}, {_bm25('corpus')} SELECT query_id, rank, chunk_id, round(score, 5) AS score FROM bm",
    "segmented_tables": f"""
WITH RECURSIVE {_SEGMENTS}
SELECT CAST(document_id AS VARCHAR) AS document_id, count(*) AS chunk_count, count(*) AS n_chunks, count(*) AS n_vectors, count(*) AS n_lengths FROM corpus GROUP BY 1""",
    "observed_behavior": """
SELECT doc_id, CASE WHEN toxic <> 0 THEN 'blocked' WHEN quality = 0 OR doc_id % 3 = 0 THEN 'refuse' WHEN doc_id % 5 = 0 THEN 'mentioned_only' ELSE 'answer' END AS observed FROM labels""",
    "eval_run": f"""
WITH {_CASES}, c AS (SELECT s.*, s.doc_id % 10 = 9 AS lost FROM scored s)
SELECT 'run' AS label, count(*) AS cases, count(*) FILTER (lost) AS errors, round(avg(doc_id % 8 / 4) FILTER (NOT lost), 2) AS avg_seconds,
       {_mean('behavior_correct', 'NOT lost')} AS behavior_correct, {_mean('source_hit', 'NOT lost')} AS source_hit,
       {_mean('key_facts', 'NOT lost')} AS key_facts, '800' AS chunk_size FROM c""",
    "presentation": """
WITH d AS (SELECT *, list_filter([CASE WHEN doc_id % 2 > 0 THEN 'Vector' END, CASE WHEN doc_id % 3 > 0 THEN 'BM25' END, CASE WHEN doc_id % 5 > 0 THEN 'Knowledge Graph' END], lambda x: x IS NOT NULL) AS u FROM documents)
SELECT doc_id, CASE len(u) WHEN 0 THEN 'None' WHEN 1 THEN u[1] ELSE 'Hybrid (' || array_to_string(u, ' + ') || ')' END AS method,
       ':green-badge[Keyword] ' || CASE WHEN doc_id % 2 = 0 THEN ':blue-badge[Semantic]' ELSE ':gray-badge[other]' END AS badges,
       '[' || doc_id % 9 || '] ' || CASE WHEN doc_id % 2 = 0 THEN source ELSE coalesce(nullif(lang, ''), source) END AS heading FROM d""",
    "answer_questions": _ANSWERED,
    "verified_answers": _ANSWERS.replace(
        "FROM m)\nSELECT", """FROM m),
sv AS (
  SELECT * REPLACE (CASE WHEN status <> 'unsupported' AND row_number() OVER (PARTITION BY query_id, status = 'unsupported' ORDER BY pos) = 1 THEN 'unsupported' ELSE status END AS status) FROM st)
SELECT""").replace("LEFT JOIN st USING", "LEFT JOIN sv USING").replace(""" AS passed,
       coalesce(bool_or(status IN ('supported', 'corrected') AND len(cites) > 0), false) AS has_supported_facts""", " AS passed"),
    "answer_log": "SELECT conv_id || '-' || turn AS id, trim(coalesce(text, '')) <> '' AS answered, false AS failed FROM conversations WHERE role = 'user'",
    "stored_run": f"WITH {_CASES} SELECT doc_id, behavior_correct, source_hit, key_facts FROM scored",
    "golden_cases": "SELECT CAST(item_id AS VARCHAR) AS id, sha256(text) AS question_sha256, 'answer' AS expected_behavior, CAST(item_id % 7 AS INTEGER) AS page FROM benchmark",
    "saved_uploads": "SELECT doc_id AS document_id, strlen(coalesce(text, '')) AS n_bytes FROM documents",
    "graph_indexing": f"""
WITH {_ORDER_DOCS},
n AS (
  SELECT document_id, count(*) AS kg_chunks, count(*) FILTER (document_id = '1995' OR (document_id = '1994' AND chunk_id % 10 = 0)) AS bad FROM oc GROUP BY 1)
SELECT document_id, CASE WHEN bad = kg_chunks THEN 'failed' WHEN bad > 0 THEN 'partial' ELSE 'done' END AS kg_status,
       CASE WHEN bad < kg_chunks THEN kg_chunks END AS kg_chunks, CASE WHEN bad < kg_chunks THEN bad END AS kg_failed_chunks, bad > 0 AS todo FROM n""",
    "source_labels": "SELECT doc_id, source || CASE WHEN doc_id % 3 > 0 THEN ', page ' || doc_id % 3 ELSE '' END AS label FROM documents",
    "status_banners": f"""
WITH l AS (
  SELECT *, ['chit_chat', 'prompt_injection', 'off_topic'][doc_id % 3 + 1] AS category, ['full', 'partial', 'mentioned_only'][doc_id % 3 + 1] AS coverage
  FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL)
SELECT doc_id, CASE
  WHEN doc_id % 4 = 0 AND category = 'chit_chat' THEN ''
  WHEN doc_id % 4 = 0 THEN CASE WHEN category = 'prompt_injection' THEN 'error' ELSE 'warning' END || ':Not processed: ' || replace(category, '_', ' ') || '.'
  WHEN toxic = 1 THEN 'warning:{evaluate.REFUSED.replace("'", "''")}'
  ELSE concat_ws('|',
    CASE coverage WHEN 'mentioned_only' THEN 'info:Only mentioned in passing: this subject. The documents are about y.' WHEN 'partial' THEN 'info:Part of the question is not covered by the documents.' END,
    CASE WHEN doc_id % 5 > 0 THEN 'warning:Left out, as no source supports it: ' || doc_id % 5 || ' sentence(s).' END,
    CASE WHEN doc_id % 2 > 0 THEN 'info:Citation corrected: ' || doc_id % 2 || ' sentence(s).' END,
    CASE WHEN doc_id % 7 = 0 THEN 'info:Rewritten after a first draft failed its check.' END,
    CASE WHEN quality = 1 AND doc_id % 3 > 0 AND doc_id % 5 = 0 THEN 'success:Based on ' || doc_id % 3 || ' source(s)' || CASE WHEN doc_id % 11 = 0 THEN ', verified' ELSE '' END || '.' END) END AS banners FROM l""",
    "linked_citations": r"""
WITH a AS (SELECT conv_id, turn, turn % 2 + 1 AS ref, replace(coalesce(text, ''), '$', '\$') || ' \$5 [' || (turn % 2 + 1) || '] [9]' AS t FROM conversations),
b AS (SELECT *, regexp_replace(t, '(?m)^(\s*)([#>])', '\1\\\2', 'g') AS u FROM a)
SELECT conv_id, turn, sha256(replace(u, '[' || ref || ']', '[\[' || ref || '\]](#source-' || ref || ' "' || CASE ref WHEN 1 THEN 'the ' || chr(39) || 'first' || chr(39) ELSE 'second [1]' END || '")')) AS linked_sha256 FROM b""",
}
