"""SQL for DuckDB that each registered query must match.

Written from the definitions, not from the plans: patterns are the same fixed
values, spelt for a matcher without look-ahead where needed.
"""

import json

from contract import inputs as i
from deskloom import fixed


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(values) -> str:
    return "[" + ", ".join("NULL" if v is None else q(v) for v in values) + "]"


def pick(values, n: str) -> str:
    return f"({listed(values)})[({n}) % {len(values)} + 1]"


def words_in(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


# --- text -----------------------------------------------------------------------

SPACE = "'" + fixed.WHITESPACE.replace("\x00", "") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {SPACE})"


def squeeze(x: str) -> str:
    return strip(f"regexp_replace({x}, '\\s+', ' ', 'g')")


def normalise(x: str) -> str:
    invisible = r"[\x{00ad}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{2064}\x{feff}]"
    visible = f"regexp_replace({x}, '{invisible}', '', 'g')"
    latin = f"translate({visible}, {q(fixed.CYRILLIC)}, {q(fixed.CYRILLIC_AS_LATIN)})"
    return f"regexp_replace({latin}, '[^\\S\\n]+', ' ', 'g')"


# --- personal data ----------------------------------------------------------------

SSN = (
    r"\b(?:00[1-9]|0[1-9]\d|[1-5]\d\d|6[0-57-9]\d|66[0-57-9]|[78]\d\d)[-\s]?"
    r"(?:0[1-9]|[1-9]\d)[-\s]?(?:000[1-9]|00[1-9]\d|0[1-9]\d\d|[1-9]\d{3})\b"
)


def pii_pattern(name: str) -> str:
    for rule, pattern, fold, _ in fixed.PII_RULES:
        if rule == name:
            return q(("(?i)" if fold else "") + (SSN if name == "ssn" else pattern))
    raise KeyError(name)


def pii_list(text: str) -> str:
    masked = f"regexp_replace({text}, {pii_pattern('credit_card')}, '[CARD-REDACTED]', 'g')"
    tests = [
        f"CASE WHEN regexp_matches({text if n == 'credit_card' else masked}, {pii_pattern(n)}) THEN {q(n)} END"
        for n, *_ in fixed.PII_RULES
    ]
    return f"list_filter([{', '.join(tests)}], lambda x: x IS NOT NULL)"


def redact(text: str, strict: bool = False) -> str:
    for name, _, _, mark in fixed.PII_RULES:
        mark = mark or (fixed.STRICT_PLACEHOLDERS[name] if strict else None)
        if mark:
            text = f"regexp_replace({text}, {pii_pattern(name)}, {q(mark)}, 'g')"
    return text


def rule_list(text: str, value: int) -> str:
    tests = [
        f"CASE WHEN regexp_matches({text}, {q('(?is)' + rule[2])}) THEN {q(rule[value])} END"
        for rule in fixed.INJECTION_RULES
    ]
    return f"list_filter([{', '.join(tests)}], lambda x: x IS NOT NULL)"


# --- tickets ------------------------------------------------------------------------

DOCS = f"""docs AS (
  SELECT doc_id, 'data/' || lang || '/' || source || '/' || doc_id || '.md' AS doc_path, lang AS domain,
         source AS topic, doc_id::VARCHAR AS subtopic, {strip('text')} AS content
  FROM documents)"""

SCANNED = f"""{DOCS}, plain AS (SELECT *, {normalise('content')} AS norm FROM docs),
scanned AS (SELECT *, {pii_list('norm')} AS types FROM plain)"""

ROLLED = f"""lines AS (
  SELECT conv_id, turn, upper(coalesce(role, 'user')) AS role, {strip("coalesce(text, '')")} AS content
  FROM conversations),
rolled AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg('[' || role || ']: ' || content, chr(10) ORDER BY turn) AS conversation_text,
         coalesce(arg_max(content, turn) FILTER (WHERE role = 'USER'),
                  string_agg('[' || role || ']: ' || content, chr(10) ORDER BY turn)) AS last_user_message
  FROM lines WHERE content != '' GROUP BY conv_id)"""

TICKETS = f"""{ROLLED}, issues AS (
  SELECT conv_id, to_json(list(struct_pack(role := role, content := text) ORDER BY turn))::VARCHAR AS issue
  FROM conversations GROUP BY conv_id),
tickets AS (
  SELECT conv_id::VARCHAR AS ticket_id, conv_id, issue, conversation_text, last_user_message,
         {pick([f for f, _ in i.SUBJECTS], 'conv_id')} AS family,
         {strip(pick([s for _, s in i.SUBJECTS], 'conv_id'))} AS subject,
         {strip(pick(i.COMPANY_FIELD, 'conv_id'))} AS company
  FROM rolled JOIN issues USING (conv_id))"""

ASKED = f"""{TICKETS}, asked AS (
  SELECT *, {squeeze(f"substr({strip('''subject || ' ' || last_user_message''')}, 1, {fixed.QUERY_CHARS})")} AS query,
         CASE WHEN lower(company) IN {words_in(i.COMPANIES)} THEN lower(company) END AS domain_filter,
         {normalise("subject || chr(10) || conversation_text")} AS norm
  FROM tickets),
screened AS (
  SELECT *, {rule_list('norm', 1)} AS rule_reasons, {pii_list('norm')} AS types FROM asked)"""

SCORED = ", ".join(f"({n}, {q(label)}, {score})" for n, (label, score) in enumerate(i.SCORES) if label)

JUDGED = f"""{ASKED}, scores(place, label, score) AS (VALUES {SCORED}),
opinions AS (
  SELECT s.*, len(rule_reasons) > 0 AS regex_injection, len(types) > 0 AS pii_detected,
         NOT (len(types) > 0 AND len(rule_reasons) = 0)
           AND (len(rule_reasons) > 0 OR lower(company) IN ('', 'none')) AS opinion_wanted, o.label, o.score
  FROM screened s LEFT JOIN scores o ON o.place = s.conv_id % {len(i.SCORES)}),
judged AS (
  SELECT *, regex_injection OR agrees AS is_injection,
         CASE WHEN agrees THEN list_append(rule_reasons, printf('deberta:%s@%.2f', label, score)) ELSE rule_reasons END AS reasons_found,
         CASE WHEN opinion_wanted THEN coalesce(label, 'unavailable') END AS opinion_label,
         CASE WHEN opinion_wanted THEN coalesce(score, 0.0) END::DOUBLE AS opinion_score
  FROM (SELECT *, coalesce(opinion_wanted AND label = 'INJECTION'
               AND score >= CASE WHEN regex_injection THEN {fixed.SCORE_CONFIRMING} ELSE {fixed.SCORE_SOLE_SIGNAL} END, false) AS agrees
        FROM opinions)),
flagged AS (
  SELECT *, CASE WHEN said = '' THEN 'clean' ELSE said END AS safety_flags FROM (
    SELECT *, concat_ws('; ',
      CASE WHEN is_injection THEN 'INJECTION (' || array_to_string(reasons_found, ', ') || ')' END,
      CASE WHEN pii_detected THEN 'PII (' || array_to_string(types, ', ') || ')' END,
      CASE WHEN opinion_wanted THEN printf('DeBERTa=%s(%.2f)', opinion_label, opinion_score) END) AS said
    FROM judged))"""

VALID = words_in([*i.COMPANIES, fixed.UNKNOWN_COMPANY])
HINT = f"CASE WHEN lower(company) IN {VALID} THEN lower(company) ELSE 'unknown' END"


def field(name: str, default: str) -> str:
    return f"coalesce(raw->>'$.{name}', {q(default)})"


def enum(name: str, allowed, default: str) -> str:
    value = f"raw->>'$.{name}'"
    return f"CASE WHEN {value} IN {words_in(allowed)} THEN {value} ELSE {q(default)} END"


def canned(area, request, risk, reasoning):
    return (
        f"{{'language': 'en', 'true_company': {HINT}, 'product_area': {q(area)}, 'request_type': {q(request)}, "
        f"'risk_level': {q(risk)}, 'reasoning': {q(reasoning)}}}"
    )


LANGUAGE = f"substr({strip('lower(' + field('language', 'en') + ')')}, 1, {fixed.LANGUAGE_CHARS})"
AREA = strip("lower(" + field("product_area", "general") + ")")
COMPANY = strip("lower(" + field("true_company", "") + ")")

CLASSIFIED = f"""{JUDGED}, predicted AS (
  SELECT *, CASE WHEN json_valid(r) AND json_type(TRY_CAST(r AS JSON)) = 'OBJECT' THEN r::JSON END AS raw
  FROM (SELECT *, {pick(i.CLASSIFICATIONS, 'conv_id')} AS r FROM flagged)),
classified AS (
  SELECT * EXCLUDE (c), unnest(c) FROM (
    SELECT *, CASE
      WHEN is_injection THEN {canned("security", "invalid", "critical", fixed.REASONING_INJECTION)}
      WHEN raw IS NULL THEN {canned("general", "product_issue", "medium", fixed.REASONING_FALLBACK)}
      ELSE {{'language': CASE WHEN {LANGUAGE} = '' THEN 'en' ELSE {LANGUAGE} END,
            'true_company': CASE WHEN {COMPANY} IN {VALID} THEN {COMPANY} ELSE {HINT} END,
            'product_area': CASE WHEN {AREA} = '' THEN 'general' ELSE {AREA} END,
            'request_type': {enum("request_type", fixed.REQUEST_TYPES, "product_issue")},
            'risk_level': {enum("risk_level", fixed.RISK_LEVELS, "medium")},
            'reasoning': substr({field("reasoning", "")}, 1, {fixed.REASONING_CHARS})}}
      END AS c
    FROM predicted))"""


def keywords(values) -> str:
    return f"list_filter({listed(values)}, lambda k: contains(lower(conversation_text), k))"


def route(source: str) -> str:
    """Routes for a relation with the classified columns and has_docs."""
    return f"""keyed AS (
  SELECT *, {keywords(fixed.LEGAL_KEYWORDS)} AS legal, {keywords(fixed.FRAUD_KEYWORDS)} AS fraud,
         {keywords(fixed.EXFILTRATION_KEYWORDS)} AS exfil FROM {source}),
placed AS (
  SELECT *, CASE
    WHEN is_injection THEN 1 WHEN risk_level = 'critical' THEN 2 WHEN len(legal) > 0 THEN 3 WHEN len(fraud) > 0 THEN 4
    WHEN len(exfil) > 0 THEN 5 WHEN risk_level = 'high' AND NOT has_docs THEN 6
    WHEN true_company = 'unknown' AND risk_level IN ('high', 'critical') THEN 7 WHEN has_docs THEN 8
    WHEN request_type = 'invalid' THEN 9 WHEN risk_level IN ('low', 'medium') THEN 10 ELSE 11 END AS rule FROM keyed),
routed AS (
  SELECT *, CASE WHEN rule IN (8, 9, 10) THEN 'replied' ELSE 'escalated' END AS status,
    CASE rule
      WHEN 1 THEN list_concat([{q(fixed.REASON_INJECTION)}], CASE WHEN len(reasons_found) > 0 THEN ['patterns: ' || array_to_string(reasons_found[1:3], ', ')] ELSE []::VARCHAR[] END)
      WHEN 2 THEN [{q(fixed.REASON_CRITICAL)}]
      WHEN 3 THEN [{q(fixed.REASON_LEGAL)} || array_to_string(legal[1:3], ', ')]
      WHEN 4 THEN [{q(fixed.REASON_FRAUD)} || array_to_string(fraud[1:3], ', ')]
      WHEN 5 THEN [{q(fixed.REASON_EXFILTRATION)} || array_to_string(exfil[1:2], ', ')]
      WHEN 6 THEN [{q(fixed.REASON_HIGH_NO_DOCS)}]
      WHEN 7 THEN [{q(fixed.REASON_UNKNOWN_COMPANY)}]
      WHEN 8 THEN [{q(fixed.REASON_GROUNDED)}]
      WHEN 9 THEN [{q(fixed.REASON_OUT_OF_SCOPE)}]
      WHEN 10 THEN ['risk_level=' || risk_level || '; no corpus docs but low risk', {q(fixed.REASON_GUIDANCE)}]
      ELSE [{q(fixed.REASON_AMBIGUOUS)}] END AS reasons FROM placed)"""


def respond() -> str:
    """Responses for the relation routed with hit_paths."""
    said = "lower(array_to_string(reasons, ' '))"
    escalation = f"""CASE WHEN contains({said}, 'injection') THEN {q(fixed.RESPONSE_INJECTION)}
      WHEN contains({said}, 'fraud') OR contains({said}, 'identity') THEN {q(fixed.RESPONSE_FRAUD)}
      WHEN contains({said}, 'legal') THEN {q(fixed.RESPONSE_LEGAL)} ELSE {q(fixed.RESPONSE_DEFAULT)} END"""
    tools = listed([name for name, *_ in i.TOOLS])
    known = {name for name, *_ in i.TOOLS}

    def kept(raw):
        """The calls of known tools as JSON text with sorted keys; the other cases have none."""
        try:
            calls = json.loads(raw)["actions_taken"]
        except (TypeError, ValueError, KeyError):
            return "[]"
        calls = calls if isinstance(calls, list) else []
        calls = [c for c in calls if isinstance(c, dict) and (c.get("action") or c.get("name")) in known]
        return json.dumps(calls, separators=(",", ":"), sort_keys=True)

    actions = pick([kept(raw) for raw in i.RESPONSES], "conv_id")
    text = strip("coalesce(a->>'$.response', '')")
    why = strip("coalesce(a->>'$.justification', '')")
    score = "coalesce(TRY_CAST(a->>'$.confidence_score' AS DOUBLE), 0.5)"

    def whole(v):
        return f"""CASE WHEN json_type({v}) = 'VARCHAR' THEN TRY_CAST(CASE WHEN regexp_matches(trim({v}->>'$'), '^[+-]?[0-9]+$') THEN {v}->>'$' END AS INT)
          ELSE TRY_CAST(trunc(TRY_CAST({v}->>'$' AS DOUBLE)) AS INT) END"""

    return f"""answered AS (
  SELECT *, CASE WHEN json_valid(r2) AND json_type(TRY_CAST(r2 AS JSON)) = 'OBJECT' THEN r2::JSON END AS a,
         status = 'escalated' AS up, {escalation} AS escalation
  FROM (SELECT *, {pick(i.RESPONSES, 'conv_id')} AS r2 FROM routed)),
listed AS (
  SELECT *, CASE WHEN json_type(a, '$.used_doc_indices') = 'ARRAY' THEN json_extract(a, '$.used_doc_indices[*]') ELSE [] END AS used,
            CASE WHEN json_type(a, '$.actions_taken') = 'ARRAY' THEN json_extract(a, '$.actions_taken[*]') ELSE [] END AS calls
  FROM answered),
responded AS (
  SELECT *,
    CASE WHEN up AND is_injection THEN {q(fixed.RESPONSE_INJECTION)}
         WHEN a IS NULL THEN CASE WHEN up THEN escalation ELSE {q(fixed.RESPONSE_DIFFICULTIES)} END
         WHEN {text} != '' THEN {text} WHEN up THEN escalation ELSE {q(fixed.RESPONSE_OUT_OF_SCOPE)} END AS response,
    CASE WHEN up AND is_injection THEN 'Prompt injection detected; immediate escalation. Reasons: ' || array_to_string(reasons, ', ')
         WHEN a IS NULL THEN {q(fixed.JUSTIFICATION_FALLBACK)}
         WHEN {why} != '' THEN {why} ELSE {q(fixed.JUSTIFICATION_EMPTY)} END AS answer_why,
    CASE WHEN up AND is_injection THEN {fixed.CONFIDENCE_INJECTION} WHEN a IS NULL THEN {fixed.CONFIDENCE_FALLBACK}
         ELSE greatest(0.0, least(1.0, {score})) END::DOUBLE AS confidence_score,
    CASE WHEN (up AND is_injection) OR a IS NULL THEN '' ELSE coalesce(array_to_string(
      list_transform(list_filter(list_transform(used, lambda v: {whole('v')}), lambda p: p BETWEEN 1 AND len(hit_paths)),
                     lambda p: replace(hit_paths[p], chr(92), '/')), '|'), '') END AS source_documents,
    CASE WHEN (up AND is_injection) OR a IS NULL THEN '[]' ELSE {actions} END AS actions_taken,
    CASE WHEN (up AND is_injection) OR a IS NULL THEN '' ELSE coalesce(array_to_string(
      list_filter(list_transform(list_filter(calls, lambda c: json_type(c) = 'OBJECT'),
        lambda c: coalesce(nullif(c->>'$.action', ''), c->>'$.name', '')), lambda n: list_contains({tools}, n)), ','), '') END AS action_names
  FROM listed)"""


CANNED_HITS = f"""{CLASSIFIED}, hitting AS (
  SELECT *, domain_filter IS NOT NULL AS has_docs,
         CASE WHEN domain_filter IS NOT NULL THEN list_transform(['a', 'b', 'c'], lambda n: 'data' || chr(92) || n || chr(92) || ticket_id)
              ELSE []::VARCHAR[] END AS hit_paths
  FROM classified)"""

# --- retrieval ------------------------------------------------------------------------

LETTERS = r"[\p{L}]+"
STOP = words_in(fixed.STOP_WORDS)


def words(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower({text}), '{fixed.WORD}'), lambda x: x NOT IN {STOP})"


def counted(name: str, source: str, key: str, text: str) -> str:
    """(key, term, tf) of a relation."""
    return f"""{name}_words AS (SELECT {key}, {words(text)} AS w FROM {source}),
{name} AS (
  SELECT {key}, term, count(*) AS tf FROM (
    SELECT {key}, unnest(list_concat(w, list_transform(range(1, len(w)), lambda n: w[n] || ' ' || w[n + 1]))) AS term
    FROM {name}_words) GROUP BY ALL)"""


def weighted(name: str, counts: str, key: str) -> str:
    return f"""{name} AS (
  SELECT {key}, term, tf, raw / sqrt(sum(raw * raw) OVER (PARTITION BY {key})) AS weight
  FROM (SELECT c.*, tf * idf AS raw FROM {counts} c JOIN vocab USING (term)))"""


LEXICON = f"""{DOCS}, {counted('doc_terms', 'docs', 'doc_id', 'content')},
vocab AS (
  SELECT term, df, total, ln(((SELECT count(*) FROM docs) + 1) / (df + 1)) + 1 AS idf
  FROM (SELECT term, sum(tf) AS total, count(*) AS df FROM doc_terms GROUP BY term ORDER BY total DESC, term LIMIT {fixed.VOCABULARY})),
{weighted('doc_weights', 'doc_terms', 'doc_id')}"""


def item_queries(with_domain: bool = True) -> str:
    company = f"lower(trim({pick(i.COMPANY_FIELD, 'item_id')}))"
    wanted = f"CASE WHEN {company} IN {words_in(i.COMPANIES)} THEN {company} END" if with_domain else "NULL::VARCHAR"
    return f"queries AS (SELECT item_id AS query_id, {squeeze('text')} AS query, {wanted} AS domain_filter FROM benchmark)"


TICKET_QUERIES = "queries AS (SELECT ticket_id AS query_id, query, domain_filter FROM flagged)"


def lexical_top(n: int, drop_zero: bool = False) -> str:
    """(query_id, doc_id, score, rank) for the relation queries."""
    return f"""{counted('query_terms', 'queries', 'query_id', 'query')}, {weighted('query_weights', 'query_terms', 'query_id')},
products AS (
  SELECT query_id, doc_id, sum(q.weight * d.weight) AS score
  FROM query_weights q JOIN doc_weights d USING (term) GROUP BY ALL),
lexical AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
    FROM (SELECT q.query_id, d.doc_id, round(coalesce(p.score, 0), 9) AS score
          FROM queries q JOIN docs d ON q.query != '' AND (q.domain_filter IS NULL OR q.domain_filter = d.domain)
          LEFT JOIN products p ON p.query_id = q.query_id AND p.doc_id = d.doc_id)
    {'WHERE score > 0' if drop_zero else ''})
  WHERE rank <= {n})"""


def dense_top(n: int, prefilter: bool = False) -> str:
    """(query_id, doc_id, score, rank) for query_units and doc_units."""
    fits = "(domain_filter IS NULL OR domain_filter = domain)"
    return f"""nearest AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM (
      SELECT q.query_id, q.domain_filter, d.doc_id, d.domain,
             round(list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 9) AS score
      FROM query_units q, doc_units d {'WHERE ' + fits if prefilter else ''}))
  WHERE place <= {n}),
semantic AS (
  SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
  FROM nearest WHERE {fits})"""


SUMS = """SELECT a.vec_id, list_transform(range(1, len(a.embedding) + 1), lambda n: a.embedding[n] + b.embedding[n]) AS embedding
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"""

DOC_UNITS = """doc_units AS (SELECT vec_id AS doc_id, embedding, domain FROM embeddings JOIN docs ON doc_id = vec_id)"""


def fused(n: int) -> str:
    return f"""fused AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_sum DESC, semantic_rank ASC NULLS LAST, lexical_rank ASC NULLS LAST) AS fused_rank
    FROM (
      SELECT query_id, doc_id, s.rank AS semantic_rank, l.rank AS lexical_rank,
             coalesce(s.score, 0) AS semantic_score, coalesce(l.score, 0) AS lexical_score,
             round(coalesce(1.0 / ({fixed.RRF_K} + s.rank), 0) + coalesce(1.0 / ({fixed.RRF_K} + l.rank), 0), 12) AS rrf_sum
      FROM semantic s FULL JOIN lexical l USING (query_id, doc_id)))
  WHERE fused_rank <= {n})"""


HYBRID = f"""{LEXICON}, {item_queries()}, {lexical_top(24)},
query_units AS (SELECT query_id, domain_filter, embedding FROM queries JOIN ({SUMS}) ON vec_id = query_id WHERE query != ''),
{DOC_UNITS}, {dense_top(24)}, {fused(fixed.FILE_CANDIDATES)}"""

FUSED_COLUMNS = f"""query_id, doc_id, fused_rank, coalesce(semantic_rank, 0) AS semantic_rank, coalesce(lexical_rank, 0) AS lexical_rank, round(semantic_score, 6) AS semantic_score,
  round(lexical_score, 6) AS lexical_score, round(1.0 / ({fixed.RRF_K} + fused_rank), 6) AS fused_score, round(rrf_sum, 6) AS rrf_sum"""


def rfind(mark: str, length: int) -> str:
    return f"CASE WHEN strpos(reverse(zone), reverse({mark})) > 0 THEN length(zone) - strpos(reverse(zone), reverse({mark})) - {length - 1} ELSE -1 END"


def chunks(source: str) -> str:
    """(doc_id, chunk_no, start, end, chunk) of a relation; needs WITH RECURSIVE."""
    size, overlap = fixed.CHUNK_CHARS, fixed.CHUNK_OVERLAP
    cut = "(-1)"
    for place, length in enumerate((2, 2, 2, 2, 1), 1):
        cut = f"(CASE WHEN p{place} >= 0 AND p{place} > {cut} THEN p{place} + {length} ELSE {cut} END)"

    def step(alias: str, start: str) -> str:
        return f"""SELECT doc_id, pos, st, CASE WHEN stop < n AND cut >= 0 THEN greatest(low + cut, st + 1) ELSE greatest(stop, st + 1) END AS en
  FROM (SELECT *, {cut} AS cut FROM (
    SELECT *, {rfind("chr(10) || chr(10)", 2)} AS p1, {rfind("'. '", 2)} AS p2, {rfind("'? '", 2)} AS p3, {rfind("'! '", 2)} AS p4, {rfind("chr(10)", 1)} AS p5
    FROM (SELECT *, CASE WHEN stop < n THEN substr(content, low + 1, stop - low) ELSE '' END AS zone
      FROM (SELECT *, greatest(st + 1, stop - {size // 5}) AS low FROM (SELECT *, least(st + {size}, n) AS stop FROM ({start}))))))"""

    first = f"SELECT doc_id, 0 AS pos, 0 AS st, length(content) AS n, content FROM {source} WHERE length(content) > {size}"
    following = f"""SELECT c.doc_id, c.pos + 1 AS pos, CASE WHEN c.en - {overlap} > c.st THEN c.en - {overlap} ELSE c.en END AS st, length(d.content) AS n, d.content
      FROM spans c JOIN {source} d ON d.doc_id = c.doc_id
      WHERE CASE WHEN c.en - {overlap} > c.st THEN c.en - {overlap} ELSE c.en END < length(d.content)"""
    return f"""spans AS ({step('a', first)} UNION ALL {step('b', following)}),
chunks AS (
  SELECT doc_id, 0 AS chunk_no, 0 AS start, length(content) AS "end", content AS chunk FROM {source} WHERE length(content) <= {size}
  UNION ALL
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1, st, en, chunk FROM (
    SELECT doc_id, pos, st, en, {strip("substr(content, st + 1, en - st)")} AS chunk FROM spans JOIN {source} USING (doc_id))
  WHERE chunk != '')"""


def snippets(hits: str) -> str:
    """(query_id, doc_id, chunk_numbers, snippet) for hits of long documents."""
    return f"""{counted('chunk_terms', 'chunks', 'doc_id, chunk_no', 'chunk')},
{weighted('chunk_weights', 'chunk_terms', 'doc_id, chunk_no')},
chunk_scores AS (
  SELECT h.query_id, h.doc_id, c.chunk_no, c.chunk, round(coalesce(s.similarity, 0), 9) AS similarity
  FROM {hits} h JOIN chunks c ON c.doc_id = h.doc_id
  LEFT JOIN (SELECT h.query_id, h.doc_id, w.chunk_no, sum(w.weight * q.weight) AS similarity
             FROM {hits} h JOIN query_weights q ON q.query_id = h.query_id
             JOIN chunk_weights w ON w.doc_id = h.doc_id AND w.term = q.term GROUP BY ALL) s
    ON s.query_id = h.query_id AND s.doc_id = h.doc_id AND s.chunk_no = c.chunk_no),
snippets AS (
  SELECT query_id, doc_id, string_agg(chunk_no::VARCHAR, ',' ORDER BY chunk_no) AS chunk_numbers,
         string_agg(chunk, chr(10) || chr(10) ORDER BY chunk_no) AS snippet
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY similarity DESC, chunk_no) AS place FROM chunk_scores)
  WHERE place <= {fixed.TOP_CHUNKS} GROUP BY ALL)"""


CHUNK_HITS = "hits AS (SELECT doc_id % 40 AS query_id, doc_id FROM docs WHERE doc_id % 40 IN (SELECT query_id FROM queries))"

LONG_HITS = f"""long_hits AS (SELECT query_id, doc_id FROM hits JOIN docs USING (doc_id) WHERE length(content) > {fixed.SMALL_DOC_CHARS}),
long_docs AS (SELECT doc_id, content FROM docs WHERE doc_id IN (SELECT doc_id FROM long_hits))"""

SNIPPED = f"""{LONG_HITS}, {chunks('long_docs')}, {snippets('long_hits')},
snipped AS (
  SELECT h.*, d.doc_path, d.domain, d.topic, d.subtopic, d.content,
         CASE WHEN length(d.content) <= {fixed.SMALL_DOC_CHARS} THEN d.content ELSE coalesce(s.snippet, d.content) END AS snippet
  FROM hits h JOIN docs d USING (doc_id) LEFT JOIN snippets s ON s.query_id = h.query_id AND s.doc_id = h.doc_id)"""

# --- evaluation -------------------------------------------------------------------------

TRUTH = f"""{SCANNED}, truth AS (
  SELECT doc_id, len(types) > 0 AS pii_detected, toxic = 1 AS toxic,
         CASE WHEN len(types) > 0 THEN 'escalated' ELSE 'replied' END AS status,
         CASE WHEN quality = 1 THEN 'replied' ELSE 'escalated' END AS gold,
         round((length(content) % 101) / 100.0, 2)::DOUBLE AS confidence, quality = 1 AS correct
  FROM scanned JOIN labels USING (doc_id))"""


def faulty() -> str:
    from contract.queries import FAULTY

    columns = ", ".join(f"{pick(values, 'doc_id')} AS {name}" for name, values in FAULTY.items())
    return f"faulty AS (SELECT doc_id, {columns} FROM documents)"


FINDINGS = f"""clean AS (
  SELECT doc_id AS row_no, lower(trim(status)) AS status, lower(trim(request_type)) AS request_type, trim(response) AS response,
         trim(confidence_score) AS conf, TRY_CAST(trim(confidence_score) AS DOUBLE) AS score, lower(trim(risk_level)) AS risk,
         lower(trim(pii_detected)) AS pii, lower(trim(language)) AS language, trim(actions_taken) AS actions,
         json_valid(trim(actions_taken)) AS is_json
  FROM faulty),
findings AS (
  SELECT row_no, 'error' AS severity, 'status' AS "check" FROM clean WHERE status NOT IN {words_in(fixed.STATUSES)}
  UNION ALL SELECT row_no, 'error', 'request_type' FROM clean WHERE request_type NOT IN {words_in(fixed.REQUEST_TYPES)}
  UNION ALL SELECT row_no, 'warning', 'response' FROM clean WHERE response = ''
  UNION ALL SELECT row_no, 'warning', 'confidence_score' FROM clean WHERE conf = ''
  UNION ALL SELECT row_no, 'error', 'confidence_score' FROM clean WHERE conf != '' AND score IS NULL
  UNION ALL SELECT row_no, 'error', 'confidence_score' FROM clean WHERE score < 0 OR score > 1
  UNION ALL SELECT row_no, 'warning', 'risk_level' FROM clean WHERE risk = ''
  UNION ALL SELECT row_no, 'error', 'risk_level' FROM clean WHERE risk != '' AND risk NOT IN {words_in(fixed.RISK_LEVELS)}
  UNION ALL SELECT row_no, 'warning', 'pii_detected' FROM clean WHERE pii = ''
  UNION ALL SELECT row_no, 'error', 'pii_detected' FROM clean WHERE pii != '' AND pii NOT IN {words_in(fixed.PII_FLAGS)}
  UNION ALL SELECT row_no, 'warning', 'language' FROM clean WHERE language = '' OR length(language) > 5
  UNION ALL SELECT row_no, 'warning', 'actions_taken' FROM clean WHERE actions = ''
  UNION ALL SELECT row_no, 'error', 'actions_taken' FROM clean WHERE actions != '' AND NOT is_json
  UNION ALL SELECT row_no, 'error', 'actions_taken' FROM clean WHERE actions != '' AND is_json AND json_type(TRY_CAST(actions AS JSON)) != 'ARRAY')"""

VERSIONS = f"""{DOCS}, old AS (SELECT doc_path, content, sha256(content) AS h FROM docs WHERE domain != 'es'),
new AS (SELECT doc_path, c AS content, sha256(c) AS h
        FROM (SELECT *, CASE WHEN domain = 'fr' THEN content || '!' ELSE content END AS c FROM docs WHERE domain != 'de'))"""


def sql() -> dict[str, str]:
    out = {}
    joined_types = "array_to_string(types, '|') AS pii_types"
    out["pii_types"] = f"WITH {SCANNED} SELECT doc_id, len(types) > 0 AS pii_detected, {joined_types} FROM scanned"
    out["pii_type_counts"] = f"WITH {SCANNED} SELECT pii_type, count(*) AS n FROM (SELECT unnest(types) AS pii_type FROM scanned) GROUP BY pii_type"
    out["redact_text"] = f"WITH {DOCS} SELECT doc_id, {redact('content')} AS redacted FROM docs"
    out["redact_strict"] = f"WITH {DOCS}, plain AS (SELECT doc_id, {normalise('content')} AS t FROM docs) SELECT doc_id, {redact('t', True)} AS redacted FROM plain"
    out["conversation_rollup"] = f"WITH {ROLLED} SELECT * FROM rolled"
    out["last_user_message"] = f"WITH {ROLLED} SELECT conv_id, arg_max(content, turn) AS last_user_message FROM lines WHERE role = 'USER' AND content != '' GROUP BY conv_id"
    out["issue_json_roundtrip"] = f"WITH {TICKETS} SELECT ticket_id, conversation_text, last_user_message FROM tickets"
    out["ticket_query"] = f"WITH {ASKED} SELECT ticket_id, query, domain_filter FROM asked"
    disguised = "replace(text, 'e ', chr(1077) || chr(8203) || '  ')"
    out["normalise_text"] = f"SELECT conv_id, turn, {normalise(disguised)} AS normalised FROM conversations"
    out["injection_scan"] = f"""WITH {ASKED} SELECT ticket_id, len(rule_reasons) > 0 AS regex_injection, len(types) > 0 AS pii_detected,
      array_to_string(rule_reasons, '|') AS injection_reasons, {joined_types} FROM screened"""
    out["injection_by_family"] = f"WITH {ASKED} SELECT family, count(*) AS n, avg(CASE WHEN len(rule_reasons) > 0 THEN 1.0 ELSE 0.0 END) AS recall FROM screened GROUP BY family"
    out["rule_tally"] = f"""WITH {ASKED} SELECT family, count(*) FILTER (WHERE ok) AS passed, count(*) FILTER (WHERE NOT ok) AS failed
      FROM (SELECT family, (len(rule_reasons) > 0) = (family != 'none') AS ok FROM screened) GROUP BY family"""
    out["document_injections"] = f"""WITH {SCANNED} SELECT doc_id, len(r) > 0 AS regex_injection, array_to_string(r, '|') AS injection_reasons
      FROM (SELECT doc_id, {rule_list('norm', 1)} AS r FROM scanned)"""
    out["second_opinion"] = f"""WITH {JUDGED} SELECT ticket_id, opinion_wanted, opinion_label, opinion_score, is_injection,
      array_to_string(reasons_found, '|') AS injection_reasons, safety_flags FROM flagged"""
    out["corpus_manifest"] = f"""WITH files AS (
      SELECT regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS p, {strip('html')} AS content FROM pages),
      parts AS (SELECT *, string_split(p, '/') AS s FROM files WHERE contains(p, '/') AND content != '')
      SELECT 'data/' || p AS doc_path, lower(s[1]) AS domain, CASE WHEN len(s) >= 3 THEN s[2] ELSE lower(s[1]) END AS topic,
             CASE WHEN len(s) >= 4 THEN s[3] ELSE regexp_replace(s[-1], '^(.+)[.][^.]*$', chr(92) || '1') END AS subtopic,
             sha256(content) AS content_hash FROM parts"""
    out["corpus_stats"] = f"WITH {DOCS} SELECT domain, topic, count(*) AS documents, sum(length(content))::BIGINT AS characters FROM docs GROUP BY ALL"
    out["manifest_delta"] = f"""WITH {VERSIONS} SELECT doc_path, CASE WHEN old.h IS NULL THEN 'new' WHEN new.h IS NULL THEN 'deleted'
      WHEN old.h = new.h THEN 'same' ELSE 'changed' END AS status FROM old FULL JOIN new USING (doc_path)"""
    out["incremental_refresh"] = f"""WITH {VERSIONS} SELECT doc_path, CASE WHEN old.h = new.h THEN -1 ELSE length(new.content) END::BIGINT AS characters
      FROM new LEFT JOIN old USING (doc_path)"""
    out["term_df"] = f"WITH {LEXICON} SELECT term, sum(tf)::BIGINT AS total, count(*) AS df FROM doc_terms GROUP BY term"
    out["tfidf_weights"] = f"WITH {LEXICON} SELECT doc_id, term, tf, round(weight, 6) AS weight FROM doc_weights"
    out["tfidf_topk"] = f"WITH {LEXICON}, {item_queries()}, {lexical_top(24)} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM lexical"
    out["tfidf_topk_nonzero"] = f"WITH {LEXICON}, {item_queries(False)}, {lexical_top(24, True)} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM lexical"
    out["unit_vectors"] = """SELECT vec_id AS doc_id, place - 1 AS place, round(value / length, 6) AS value FROM (
      SELECT vec_id, unnest(embedding::DOUBLE[]) AS value, unnest(range(1, len(embedding) + 1)) AS place,
             sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS length FROM embeddings)"""

    def dense(domain: str, prefilter: bool, where: str = "") -> str:
        return f"""WITH query_units AS (SELECT item_id AS query_id, {domain} AS domain_filter, embedding FROM benchmark JOIN ({SUMS}) ON vec_id = item_id {where}),
          doc_units AS (SELECT vec_id AS doc_id, label::VARCHAR AS domain, embedding FROM embeddings), {dense_top(24, prefilter)}
          SELECT query_id, doc_id, round(score, 6) AS score, rank FROM semantic"""

    out["dense_topk"] = dense("NULL::VARCHAR", False)
    out["dense_topk_domain"] = dense("(item_id % 10)::VARCHAR", False)
    out["dense_topk_prefilter"] = dense("(item_id % 10)::VARCHAR", True)
    out["dense_topk_short"] = dense("NULL::VARCHAR", False, "WHERE item_id % 7 != 0")
    small = LEXICON.replace(f"LIMIT {fixed.VOCABULARY}", "LIMIT 200")
    out["summarised_topk"] = f"WITH {small}, {item_queries()}, {lexical_top(24)} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM lexical"
    out["clustered_topk"] = out["dense_topk"]
    fresh = LEXICON.replace(DOCS + ", ", "").replace("FROM docs", "FROM newer")
    out["index_refresh"] = f"""WITH {VERSIONS}, newer AS (SELECT doc_id, new.content FROM new JOIN docs USING (doc_path)), {fresh}
      SELECT doc_id, term, tf, round(weight, 6) AS weight FROM doc_weights"""
    out["documents_without_vector"] = "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)"
    out["rrf_fusion"] = f"WITH {HYBRID} SELECT {FUSED_COLUMNS} FROM fused"
    out["chunk_documents"] = f'WITH RECURSIVE {DOCS}, {chunks("docs")} SELECT doc_id, chunk_no::BIGINT AS chunk_no, start::BIGINT AS start, "end"::BIGINT AS "end", chunk FROM chunks'
    out["hybrid_topk"] = f"""WITH RECURSIVE {HYBRID}, hits AS (SELECT * FROM fused WHERE fused_rank <= {fixed.TOP_K}), {SNIPPED}
      SELECT {FUSED_COLUMNS}, doc_path, snippet, snippet = content AS is_full_file FROM snipped"""
    out["chunk_topk"] = f"""WITH RECURSIVE {LEXICON}, {item_queries()},
      {counted('query_terms', 'queries', 'query_id', 'query')}, {weighted('query_weights', 'query_terms', 'query_id')},
      {CHUNK_HITS}, {chunks('docs')}, {snippets('hits')} SELECT query_id, doc_id, chunk_numbers, snippet FROM snippets"""
    place = "('0x' || substr(md5(term), 1, 4))::INT % 64"
    out["chunk_topk_dense"] = f"""WITH RECURSIVE {LEXICON}, {item_queries()},
      {counted('query_terms', 'queries', 'query_id', 'query')}, {weighted('query_weights', 'query_terms', 'query_id')},
      {CHUNK_HITS}, {chunks('docs')}, {counted('chunk_terms', 'chunks', 'doc_id, chunk_no', 'chunk')},
      {weighted('chunk_weights', 'chunk_terms', 'doc_id, chunk_no')},
      a AS (SELECT query_id, {place} AS p, sum(weight) AS w FROM query_weights GROUP BY ALL),
      b AS (SELECT doc_id, chunk_no, {place} AS p, sum(weight) AS w FROM chunk_weights GROUP BY ALL),
      near AS (SELECT h.query_id, h.doc_id, b.chunk_no, round(sum(coalesce(a.w, 0) * b.w), 9) AS similarity
               FROM hits h JOIN b ON b.doc_id = h.doc_id LEFT JOIN a ON a.query_id = h.query_id AND a.p = b.p
               WHERE h.query_id IN (SELECT query_id FROM a) GROUP BY ALL)
      SELECT query_id, doc_id, chunk_no::BIGINT AS chunk_no, round(similarity, 6) AS similarity, place FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY similarity DESC, chunk_no) AS place FROM near)
      WHERE place <= {fixed.TOP_CHUNKS}"""
    out["classify_clamp"] = f"WITH {CLASSIFIED} SELECT ticket_id, language, true_company, product_area, request_type, risk_level, reasoning FROM classified"
    out["route_decision"] = f"WITH {CANNED_HITS}, {route('hitting')} SELECT ticket_id, status, array_to_string(reasons, '|') AS reasons FROM routed"
    out["response_clamp"] = f"""WITH {CANNED_HITS}, {route('hitting')}, {respond()}
      SELECT ticket_id, response, answer_why AS justification, confidence_score, source_documents, action_names FROM responded"""

    out["index_roundtrip"] = out["tfidf_topk"]
    ticket_hits = f"""{LEXICON.replace(DOCS + ', ', '')}, {TICKET_QUERIES}, {lexical_top(24)}"""
    hitting = """hitting AS (
      SELECT c.*, coalesce(len(paths), 0) > 0 AS has_docs, coalesce(paths, []) AS hit_paths
      FROM classified c LEFT JOIN (SELECT query_id, list(doc_path ORDER BY fused_rank) AS paths FROM hits JOIN docs USING (doc_id) GROUP BY query_id)
        ON query_id = ticket_id)"""
    out["triage"] = f"""WITH {DOCS}, {CLASSIFIED}, {ticket_hits},
      query_units AS (SELECT query_id, domain_filter, embedding FROM queries JOIN ({SUMS}) ON vec_id::VARCHAR = query_id WHERE query != ''),
      {DOC_UNITS}, {dense_top(24)}, {fused(fixed.FILE_CANDIDATES)},
      hits AS (SELECT * FROM fused WHERE fused_rank <= {fixed.TOP_K}), {hitting}, {route('hitting')}, {respond()}
      SELECT ticket_id, issue, actions_taken, subject, company, response, product_area, status, request_type,
             reasoning || {q(fixed.ROUTE_PREFIX)} || array_to_string(reasons, '; ') || ' | ' || answer_why AS justification,
             round(confidence_score, 4) AS confidence_score, source_documents, risk_level,
             CASE WHEN pii_detected THEN 'true' ELSE 'false' END AS pii_detected, language FROM responded"""

    from deskloom.plans.triage import CLASSIFICATION_PROMPT

    parts = CLASSIFICATION_PROMPT.split("%s")
    short = f"CASE WHEN {redact('subject')} = '' THEN '(none)' ELSE substr({redact('subject')}, 1, {fixed.SUBJECT_CHARS}) END"
    safe = f"substr({redact('conversation_text')}, 1, {fixed.CONVERSATION_CHARS})"
    values = [short, "CASE WHEN company = '' THEN '(none)' ELSE company END", "safety_flags", safe]
    prompt = " || ".join(f"{q(text)} || {value}" for text, value in zip(parts, values))
    out["classification_prompts"] = f"WITH {JUDGED} SELECT ticket_id, {prompt} AS prompt FROM flagged WHERE NOT is_injection"

    out["response_prompts"] = response_prompts(short, safe)
    out["output_findings"] = f"WITH {faulty()}, {FINDINGS} SELECT * FROM findings"
    out["output_check_summary"] = f"""WITH {faulty()}, {FINDINGS}
      SELECT severity, "check", count(*) AS n FROM (
        SELECT severity, "check" FROM findings
        UNION ALL SELECT 'error', 'headers'
        UNION ALL SELECT 'warning', 'headers'
        UNION ALL SELECT 'error', 'row_count' WHERE (SELECT count(*) FROM conversations) != (SELECT count(*) FROM faulty)) GROUP BY ALL"""
    out["output_report"] = f"""WITH {faulty()}, {FINDINGS}
      SELECT row_no, severity, "check" FROM (
        SELECT *, row_number() OVER (PARTITION BY severity ORDER BY row_no, "check") AS place FROM findings)
      WHERE place <= CASE severity WHEN 'error' THEN {fixed.REPORT_ERRORS} ELSE {fixed.REPORT_WARNINGS} END"""
    out["routing_f1"] = f"""WITH {TRUTH}, counts AS (
        SELECT class, count(*) FILTER (WHERE gold = class AND status = class) AS tp,
               count(*) FILTER (WHERE gold != class AND status = class) AS fp,
               count(*) FILTER (WHERE gold = class AND status != class) AS fn
        FROM truth, (SELECT unnest({listed(fixed.STATUSES)}) AS class) GROUP BY class)
      SELECT class, tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) AS "precision", round(tp / nullif(tp + fn, 0), 6) AS recall,
             round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM counts"""
    out["brier"] = f"""WITH {TRUTH} SELECT count(*) AS n, round(avg((confidence - correct::INT) ** 2), 6) AS brier,
      round(stddev_pop(confidence), 6) AS spread, min(confidence) = max(confidence) AS flat FROM truth"""
    out["calibration_bins"] = f"""WITH {TRUTH} SELECT least(floor(confidence * 10), 9)::BIGINT AS bin, count(*) AS n,
      round(avg(confidence), 6) AS mean_confidence, round(avg(correct::INT), 6) AS share_correct FROM truth GROUP BY bin"""
    text = f"CASE WHEN doc_id % 3 = 0 THEN content || chr(10) || {pick(list(i.PERSONAL.values()), 'doc_id')} ELSE content END"
    out["pii_confusion"] = f"""WITH {DOCS}, plain AS (SELECT doc_id, {normalise(text)} AS norm FROM docs)
      SELECT len({pii_list('norm')}) > 0 AS guess, doc_id % 3 = 0 AS truth, count(*) AS n FROM plain GROUP BY ALL"""
    out["citation_missing"] = """WITH cited AS (
      SELECT 'doc/' || page_id AS doc_path FROM pages UNION ALL SELECT 'doc/x' || (page_id % 3) FROM pages)
      SELECT doc_path, count(*) AS n_citations FROM cited WHERE doc_path NOT IN (SELECT 'doc/' || doc_id FROM documents) GROUP BY doc_path"""
    found = ", ".join(f"regexp_extract_all(content, {pii_pattern(n)})" for n, *_ in fixed.PII_RULES)
    out["pii_echo"] = f"""WITH {DOCS} SELECT doc_id, array_to_string(list_sort(list_filter(list_distinct(flatten([{found}])),
      lambda v: contains(substr(content, length(content) // 2 + 1), v))), '|') AS echoed FROM docs"""
    out["run_diff"] = """SELECT source, lang, n_chars, sum(n)::BIGINT AS surplus FROM (
        SELECT source, lang, n_chars, 1 AS n FROM documents
        UNION ALL SELECT source, lang, CASE WHEN lang = 'fr' THEN n_chars + 1 ELSE n_chars END, -1 FROM documents)
      GROUP BY ALL HAVING sum(n) != 0"""
    out["run_determinism"] = "SELECT 0::BIGINT AS different"
    out["tool_conformance"] = conformance()
    out["recency_rank"] = recency()
    out["misfiled_docs"] = misfiled()
    out["source_disagreement"] = disagreement()
    planted = f"(content || chr(10) || {pick(i.EXAMPLES, 'doc_id')})"
    out["planted_rules"] = f"""WITH {DOCS}, plain AS (SELECT doc_id, {normalise(planted)} AS norm FROM docs)
      SELECT doc_id, array_to_string({rule_list('norm', 1)}, '|') AS injection_reasons, array_to_string({pii_list('norm')}, '|') AS pii_types FROM plain"""
    # Every planted text must be found, so nothing is matched here. The Russian rule cannot match.
    out["planted_tally"] = f"""SELECT expected, count(*) FILTER (expected != 'RU-injection') AS passed,
        count(*) FILTER (expected = 'RU-injection') AS failed
      FROM (SELECT {pick(i.EXPECTED, 'doc_id')} AS expected FROM documents) GROUP BY expected"""
    out["normalise_compatible"] = f"SELECT conv_id, turn, {normalise('text')} AS normalised FROM conversations"
    out["odd_conversations"] = f"""SELECT doc_id, {pick([x for _, x, _ in i.ODD_ISSUES], 'doc_id')} AS conversation_text,
      {pick([x for *_, x in i.ODD_ISSUES], 'doc_id')} AS last_user_message FROM documents"""
    gap = "(conv_id % 3 = 0 OR conv_id % 5 = 0)"
    safe = {
        "response": fixed.RESPONSE_ERROR, "product_area": "unknown", "status": "escalated", "request_type": "product_issue",
        "justification": fixed.JUSTIFICATION_ERROR, "source_documents": "", "risk_level": "high", "pii_detected": "false",
        "language": "en", "actions_taken": "[]",
    }
    made = {"justification": f"reasoning || {q(fixed.ROUTE_PREFIX)} || array_to_string(reasons, '; ') || ' | ' || answer_why",
            "pii_detected": "CASE WHEN pii_detected THEN 'true' ELSE 'false' END"}
    cells = ", ".join(f"CASE WHEN {gap} THEN {q(text)} ELSE {made.get(name, name)} END AS {name}" for name, text in safe.items())
    out["triage_failures"] = f"""WITH {CANNED_HITS}, {route('hitting')}, {respond()}
      SELECT ticket_id, issue, subject, company, {cells},
        CASE WHEN {gap} THEN {fixed.CONFIDENCE_FALLBACK} ELSE round(confidence_score, 4) END::DOUBLE AS confidence_score FROM responded"""
    out["ticket_files"] = f"""WITH {TICKETS} SELECT row_number() OVER (ORDER BY conv_id % 5 != 0, conv_id) AS place, issue,
      coalesce({pick([x for _, x in i.SUBJECTS], 'conv_id')}, '') AS subject,
      CASE WHEN {pick(i.COMPANY_FIELD, 'conv_id')} = 'None' THEN '' ELSE {pick(i.COMPANY_FIELD, 'conv_id')} END AS company FROM tickets"""
    rest = ", ".join(f"{q(c + ' ' + chr(34) + 'x' + chr(34) + ', ')} || doc_id AS {c}" for c in fixed.OUTPUT_COLUMNS[1:])
    out["output_files"] = f"WITH {DOCS} SELECT row_number() OVER (ORDER BY doc_id) AS place, content AS issue, {rest} FROM docs"
    path = "'domain=' || lang || chr(1) || 'topic=' || source || chr(1) || 'page=' || doc_id"
    out["corpus_files"] = f"""SELECT row_number() OVER (ORDER BY {path}) AS place, 'domain=' || lang AS domain,
      'topic=' || source AS topic, 'page=' || doc_id AS subtopic, {strip("text || chr(10)")} AS content,
      sha256({strip('text')}) AS content_hash FROM documents WHERE {strip('text')} != ''"""
    halves = "substr(text, 1, length(text) // 2) || ' ' || substr(text, length(text) // 2 + 1)"
    out["broken_files"] = f"""SELECT 'page=' || doc_id AS subtopic, replace({strip(halves)}, ' ', '_') AS content
      FROM documents WHERE {strip(halves)} != ''"""
    out["checked_files"] = f"""WITH {faulty()}, {FINDINGS} SELECT * FROM findings
      UNION ALL SELECT NULL, 'error', 'headers'
      UNION ALL SELECT NULL, 'error', 'row_count' WHERE (SELECT count(*) FROM conversations) != (SELECT count(*) FROM faulty)"""
    out["tool_files"] = """SELECT unnest(['name', 'action', 'keyed']) AS shape, n_name AS name, 'of ' || n_name AS description FROM nation"""
    out["manifest_files"] = out["manifest_delta"]
    language = f"""WITH {DOCS}, found AS (SELECT doc_id, domain, regexp_extract_all(lower(content), '{LETTERS}') AS w FROM docs),
      hits AS ({" UNION ALL ".join(f"SELECT doc_id, domain, {q(name)} AS language, len(list_filter(w, lambda x: x IN {words_in(profile)})) AS n FROM found" for name, profile in sorted(fixed.LANGUAGE_WORDS.items()))}),
      best AS (SELECT doc_id, domain, CASE WHEN n > 0 THEN language END AS language FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, language) AS place FROM hits) WHERE place = 1)"""
    out["language_id"] = f"{language} SELECT doc_id, domain, language FROM best"
    out["learned_language"] = f"""{profiles(50_000)},
      sums AS (SELECT doc_id, u.language, sum(tf * coalesce(p.weight, u.weight)) AS score
        FROM (SELECT doc_id, gram, count(*) AS tf FROM each JOIN known USING (gram) GROUP BY ALL)
        CROSS JOIN unseen u LEFT JOIN seen p USING (gram, language) GROUP BY doc_id, u.language),
      best AS (SELECT doc_id, language FROM sums QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, language) = 1)
      SELECT doc_id % 3 = 1 AS held_out, language AS guess, domain AS truth, count(*) AS n FROM docs LEFT JOIN best USING (doc_id) GROUP BY ALL"""
    out["language_profiles"] = f"{profiles(2_000)} SELECT gram, language, weight FROM seen UNION ALL SELECT NULL, language, weight FROM unseen"
    out["language_accuracy"] = f"{language} SELECT language AS guess, domain AS truth, count(*) AS n FROM best GROUP BY ALL"
    return out


def response_prompts(short: str, safe: str) -> str:
    from deskloom.plans.triage import RESPONSE_PROMPT

    entries = sorted(i.tool_entries(), key=lambda e: e["name"])
    catalogue = "[" + ",".join(json.dumps(e, separators=(",", ":")) for e in entries) + "]"
    section = f"""CASE WHEN has_docs THEN corpus ELSE {q(fixed.NO_DOCS_SECTION)} END"""
    values = [
        "true_company", "product_area", "risk_level", "status", "language", short, "safety_flags", safe, section,
        q(catalogue[: fixed.TOOLS_CHARS]),
    ]
    prompt = " || ".join(f"{q(text)} || {value}" for text, value in zip(RESPONSE_PROMPT.split("%s"), values))
    one = f"""'<document number=' || fused_rank || ' file=' || doc_path || ' about=' || domain || ' > ' || topic || ' > ' || subtopic
      || '>' || chr(10) || substr(snippet, 1, {fixed.SNIPPET_CHARS}) || chr(10) || '</document>'"""
    return f"""WITH RECURSIVE {DOCS}, {CLASSIFIED}, {LEXICON.replace(DOCS + ', ', '')}, {TICKET_QUERIES}, {lexical_top(24)},
      semantic AS (SELECT query_id, doc_id, score, rank FROM lexical WHERE false), {fused(fixed.FILE_CANDIDATES)},
      hits AS (SELECT * FROM fused WHERE fused_rank <= {fixed.TOP_K}), {SNIPPED},
      hitting AS (
        SELECT c.*, corpus IS NOT NULL AS has_docs, corpus
        FROM classified c LEFT JOIN (SELECT query_id, string_agg({one}, chr(10) ORDER BY fused_rank) AS corpus FROM snipped GROUP BY query_id)
          ON query_id = ticket_id), {route('hitting')}
      SELECT ticket_id, {prompt} AS prompt FROM routed WHERE NOT (status = 'escalated' AND is_injection)"""


def conformance() -> str:
    spec = ", ".join(
        f"({q(name)}, {listed(sorted(properties))}, {listed(sorted(required))}, "
        f"{listed([p for p, kind in properties.items() if kind == 'number'])}, "
        f"{listed([p for p in properties if p in i.DESCRIBED])})"
        for name, properties, required in i.TOOLS
    )
    allowed = " ".join(f"WHEN {q(p)} THEN {listed(text.split(chr(39))[1::2])}" for p, text in i.DESCRIBED.items())
    return f"""WITH tools(name, props, required, numbers, choices) AS (VALUES {spec}),
      rows AS (SELECT DISTINCT conv_id::VARCHAR AS ticket_id, {pick(i.RESPONSES, 'conv_id')} AS r FROM conversations),
      calls AS (SELECT ticket_id, json_extract(r::JSON, '$.actions_taken[*]') AS calls FROM rows
                WHERE r IS NOT NULL AND json_valid(r) AND json_type(TRY_CAST(r AS JSON), '$.actions_taken') = 'ARRAY'),
      named AS (SELECT *, list_transform(calls, lambda c: coalesce(nullif(c->>'$.action', ''), c->>'$.name')) AS names FROM calls),
      flat AS (SELECT ticket_id, names, unnest(range(0, len(calls))) AS position, unnest(calls) AS c, unnest(names) AS action FROM named),
      given AS (SELECT *, CASE WHEN json_type(c, '$.parameters') = 'OBJECT' THEN json_keys(c, '$.parameters') ELSE [] END AS keys FROM flat)
      SELECT ticket_id, position::BIGINT AS position, action, t.name IS NOT NULL AS known,
        coalesce(array_to_string(list_filter(t.required, lambda p: NOT list_contains(keys, p)), '|'), '') AS missing,
        coalesce(array_to_string(list_sort(list_filter(keys, lambda p: t.name IS NOT NULL AND NOT list_contains(t.props, p))), '|'), '') AS "unknown",
        coalesce(array_to_string(list_sort(list_filter(keys, lambda p: CASE
            WHEN list_contains(t.numbers, p) THEN json_type(c, '$.parameters.' || p) NOT IN ('BIGINT', 'UBIGINT', 'DOUBLE')
            WHEN list_contains(t.props, p) THEN json_type(c, '$.parameters.' || p) != 'VARCHAR' ELSE false END)), '|'), '') AS wrong_type,
        coalesce(array_to_string(list_sort(list_filter(keys, lambda p: list_contains(t.choices, p) AND NOT list_contains(
            CASE p {allowed} END, coalesce(json_extract_string(c, '$.parameters.' || p), '')))), '|'), '') AS wrong_value,
        coalesce(action IN {words_in(fixed.DESTRUCTIVE_TOOLS)}, false)
          AND NOT coalesce(list_contains(names[1:position], {q(fixed.VERIFY_TOOL)}), false) AS unverified
      FROM given LEFT JOIN tools t ON t.name = action"""


def recency() -> str:
    return f"""WITH {LEXICON}, {item_queries()}, {lexical_top(24, True)},
      dated AS (SELECT *, ([TIMESTAMP '2026-03-16 20:39:36', NULL, TIMESTAMP '2026-02-19 15:31:00', TIMESTAMP '2017-07-18 16:48:39.721'])[doc_id % 4 + 1] AS d FROM lexical)
      SELECT query_id, doc_id, d::VARCHAR AS doc_date, doc_id % 3 + 1 AS depth,
        row_number() OVER (PARTITION BY query_id ORDER BY d DESC NULLS LAST, doc_id % 3 DESC, rank) AS preferred_rank FROM dated"""


def disagreement() -> str:
    return f"""WITH {LEXICON}, {item_queries(False)}, {lexical_top(24, True)},
      dated AS (SELECT query_id, domain, topic, ([NULL, DATE '2026-03-16', DATE '2026-02-19', DATE '2017-07-18'])[doc_id % 4 + 1] AS d
                FROM lexical JOIN docs USING (doc_id)),
      spans AS (SELECT query_id, domain, topic, count(*) AS n, max(d) - min(d) > 365 AS far FROM dated GROUP BY ALL),
      found AS (SELECT query_id, sum(n)::BIGINT AS sources, coalesce(bool_or(far), false) AS stale, count(DISTINCT domain) > 1 AS mixed FROM spans GROUP BY query_id)
      SELECT *, stale OR mixed AS low_confidence FROM found"""


def profiles(most: int) -> str:
    """Weights of the character sequences of two documents of three, by language."""
    return f"""WITH {DOCS}, padded AS (
        SELECT doc_id, domain, '_' || unnest(regexp_extract_all(lower(content), '{LETTERS}')) || '_' AS word FROM docs),
      each AS (SELECT doc_id, domain, unnest(list_transform(range(1, greatest(length(word) - 1, 2)), lambda i: substr(word, i, 3))) AS gram FROM padded),
      counts AS (SELECT gram, domain AS language, count(*) AS n FROM each WHERE doc_id % 3 != 1 AND domain IS NOT NULL GROUP BY ALL),
      known AS (SELECT gram FROM counts GROUP BY gram ORDER BY sum(n) DESC, gram LIMIT {most}),
      sizes AS (SELECT language, sum(n) + (SELECT count(*) FROM known) AS size FROM counts JOIN known USING (gram) GROUP BY language),
      seen AS (SELECT gram, language, round(ln((n + 1) / size) * 1000)::BIGINT AS weight FROM counts JOIN known USING (gram) JOIN sizes USING (language)),
      unseen AS (SELECT language, round(ln(1 / size) * 1000)::BIGINT AS weight FROM sizes)"""


def misfiled() -> str:
    return f"""WITH {DOCS}, tokens AS (SELECT doc_id, domain, unnest({words('content')}) AS word FROM docs),
      counts AS (SELECT doc_id, word, count(*) AS tf FROM tokens GROUP BY ALL),
      model AS (SELECT word, domain AS candidate, count(*) AS n FROM tokens GROUP BY ALL),
      sizes AS (SELECT candidate, sum(n) + (SELECT count(DISTINCT word) FROM tokens) AS size FROM model GROUP BY candidate),
      scored AS (SELECT doc_id, s.candidate, round(sum(tf * ln(coalesce(n, 0) + 1)) - sum(tf) * ln(size), 6) AS score
                 FROM counts CROSS JOIN sizes s LEFT JOIN model m ON m.word = counts.word AND m.candidate = s.candidate
                 GROUP BY doc_id, s.candidate, size),
      best AS (SELECT doc_id, candidate FROM (
        SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, candidate) AS place FROM scored) WHERE place = 1)
      SELECT doc_id, domain, candidate AS best_domain, coalesce(domain != candidate, false) AS misfiled
      FROM docs LEFT JOIN best USING (doc_id)"""
