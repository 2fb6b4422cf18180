"""SQL for DuckDB that gives the rows of each query, written on its own: words come from a plain cut of each line, runs from
windows, the greedy dictionary scan from a recursion."""

from __future__ import annotations

import re

from ..operators.lexicon import LISTS
from .fixtures import MARKED

# Values of the checks' own, so that a wrong constant in an operator is found.
PACKAGE_ROOTS = "com org net edu gov io android androidx java javax kotlin kotlinx dalvik sun".split()
GENERIC_DOMAINS = "com org net edu gov mil int info biz".split()
SECOND_LABELS = "co ac gov org net edu com nic res mil ltd plc sch nhs".split()
PRIVATE = {"email": r"[\w.%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "ip": r"\d{1,3}(\.\d{1,3}){3}", "digits": r"\d{6}"}
PERSON_CUES = "said says saying told tells telling met meets meeting contacted contact interviewed according regards sincerely spoke speaking signed thanked greeted asked replied confirmed reported"
OTHER_CUES = "debt embedded overlays devices lockscreen complaint settings version policy invoice agreement contract account capital holdings insurance"
TABLE_ROW = r"^-Uid\s+\d+-Pkg\s"
#: Whether a line is a log's, of its words: a date, a time with a fraction, numbers, a level, and a colon at its end or the next word's.
LOG_WORDS = r"list_filter(regexp_split_to_array(trim(regexp_replace(line[1:100], '^(\s*[0-9-]+[T ][0-9:]{8})[.,\s]+', '\1.')), '\s+'), lambda w: NOT regexp_full_match(w, '[0-9]*'))"
LOG_TIME = r"regexp_matches(line[1:100], '^\s*[0-9-]{5,10}[T ]\d\d:\d\d:\d\d[.,\s]+\d')"


def _log_line() -> str:
    after = f"list_filter({LOG_WORDS}, lambda w: NOT regexp_matches(w, '[0-9]{{2}}:[0-9]{{2}}|^[0-9-]{{5,10}}$'))"
    level = f"split_part(split_part(({after})[1], '/', 1), ':', 1)"
    levels = "'V', 'D', 'I', 'W', 'E', 'F', 'VERBOSE', 'DEBUG', 'INFO', 'WARN', 'ERROR', 'FATAL'"
    return f"({LOG_TIME} AND {level} IN ({levels}) AND (contains(({after})[1], ':') OR {level} = ({after})[1] AND contains(coalesce(({after})[2], ''), ':')))"


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _in(name: str) -> str:
    return "(" + _list(LISTS[name])[1:-1] + ")"


def _gold_rows() -> str:
    rows = []
    for k, m in enumerate(MARKED):
        at = 0
        for i, p in enumerate(m.split("**")):
            if i % 2:
                rows.append(f"({k}, {at}, {at + len(p)}, '{p}')")
            at += len(p)
    return ", ".join(rows)


STOP = "|".join(LISTS["stopword"])
PLAIN = _list(m.replace("**", "") for m in MARKED)
RUN = r"[\p{L}_''\-]+"


def spans_of(source: str, counts: bool = False) -> str:
    """Common table expressions from source (doc_id, text) to judged candidates; counts: names are counted in the whole text too."""
    often = "count(*) OVER (PARTITION BY doc_id, lower(text))"
    often = f"greatest({often}, occurrences)" if counts else often
    return rf"""
planted AS (
  SELECT doc_id, coalesce(text, '') || chr(10) || ({PLAIN})[doc_id % {len(MARKED)} + 1] || chr(10) || ({PLAIN})[(doc_id * 7 + 3) % {len(MARKED)} + 1] AS text FROM {source}
), lines AS (
  SELECT doc_id, i AS line_no, ls[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM planted), unnest(range(1, len(ls) + 1)) AS r(i)
), cut AS (
  SELECT doc_id, line_no, regexp_extract_all(line, '{RUN}') AS m, string_split_regex(line, '{RUN}') AS g FROM lines WHERE regexp_matches(line, '\p{{Lu}}')
), words AS (
  SELECT doc_id, line_no, i AS ix, m[i] AS tok, lower(m[i]) AS key,
    (coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s,
    i > 1 AND regexp_matches(m[i - 1], '^\p{{Lu}}') AND (regexp_matches(g[i], '^[ \t]{{1,2}}$')
      OR regexp_matches(g[i], '^\.[ \t]{{1,2}}$') AND (length(m[i - 1]) = 1 OR lower(m[i - 1]) IN {_in('title')})) AS linked
  FROM cut, unnest(range(1, len(m) + 1)) AS r(i) WHERE regexp_matches(m[i], '^\p{{Lu}}')
), flagged AS (
  SELECT *, s + length(tok) AS e, key IN {_in('title')} AS t FROM words
), cuts AS (
  SELECT *, (NOT linked OR t AND NOT coalesce(lag(t) OVER w, true))::INT AS fresh FROM flagged WINDOW w AS (PARTITION BY doc_id, line_no ORDER BY ix)
), numbered AS (
  SELECT *, sum(fresh) OVER (PARTITION BY doc_id, line_no ORDER BY ix) AS run FROM cuts
), runs AS (
  SELECT doc_id, line_no, run, list(struct_pack(s := s, e := e, tok := tok, key := key, t := t) ORDER BY ix) AS ws FROM numbered GROUP BY ALL
), titled AS (
  SELECT doc_id, line_no, list_filter(ws, lambda w: NOT w.t)[1:4] AS part FROM runs WHERE ws[1].t
), bare AS (
  SELECT doc_id, line_no, ws[k * 4 + 1:k * 4 + 4] AS part FROM runs, unnest(range(0, (len(ws) - 1) // 4 + 1)) AS r(k) WHERE NOT ws[1].t
), plain_runs AS (
  SELECT doc_id, line_no, run, list_filter(ws, lambda w: NOT w.t) AS ws FROM runs
), scan AS (
  WITH RECURSIVE scan AS (
    SELECT doc_id, line_no, run, ws, 1 AS i, 0 AS n FROM plain_runs WHERE len(ws) > 0
    UNION ALL
    SELECT doc_id, line_no, run, ws, i + greatest(n, 1) AS i, 0 FROM (
      SELECT doc_id, line_no, run, ws, i, CASE
        WHEN pair AND coalesce(ws[i + 2].key IN {_in('last')}, false) THEN 3 WHEN pair THEN 2 WHEN ws[i].key IN {_in('first')} OR ws[i].key IN {_in('last')} THEN 1 ELSE 0 END AS n
      FROM (SELECT *, coalesce(ws[i].key IN {_in('first')} AND ws[i + 1].key IN {_in('last')} OR ws[i].key IN {_in('last')} AND ws[i + 1].key IN {_in('first')}, false) AS pair FROM scan)
    ) WHERE i + greatest(n, 1) <= len(ws)
  ) SELECT *, coalesce(ws[i].key IN {_in('first')} AND ws[i + 1].key IN {_in('last')} OR ws[i].key IN {_in('last')} AND ws[i + 1].key IN {_in('first')}, false) AS pair FROM scan
), dict AS (
  SELECT doc_id, line_no, CASE WHEN pair AND coalesce(ws[i + 2].key IN {_in('last')}, false) THEN ws[i:i + 2] WHEN pair THEN ws[i:i + 1] ELSE ws[i:i] END AS part
  FROM scan WHERE pair OR ws[i].key IN {_in('first')} OR ws[i].key IN {_in('last')}
), parts AS (
  SELECT *, 'titled' AS pattern, 0.90 AS conf, 0 AS rk FROM titled WHERE len(part) > 0
  UNION ALL SELECT *, 'bare', 0.55, 3 FROM bare WHERE len(part) > 1
  UNION ALL SELECT *, 'dictionary', 0.85, 1 FROM dict WHERE len(part) > 1
  UNION ALL SELECT *, 'dictionary_single_token', 0.40, 2 FROM dict WHERE len(part) = 1
), dets AS (
  SELECT doc_id, line_no, part[1].s AS s, part[-1].e AS e, array_to_string(list_transform(part, lambda w: w.tok), ' ') AS text, pattern, conf, rk FROM parts
), reached AS (
  SELECT *, max(e) OVER (PARTITION BY doc_id, line_no ORDER BY s, e DESC, pattern ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM dets
), grouped AS (
  SELECT *, sum((reach IS NULL OR s >= reach)::INT) OVER (PARTITION BY doc_id, line_no ORDER BY s, e DESC, pattern ROWS UNBOUNDED PRECEDING) AS grp FROM reached
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, line_no, grp ORDER BY rk, e - s DESC, s) AS best FROM grouped
), bests AS (
  SELECT doc_id, line_no, grp, any_value(s) FILTER (best = 1) AS s, any_value(e) FILTER (best = 1) AS e, any_value(text) FILTER (best = 1) AS text, any_value(pattern) FILTER (best = 1) AS top, sum(conf) AS evidence,
    list_sort(list(DISTINCT pattern)) AS pats FROM ranked GROUP BY doc_id, line_no, grp
), odd AS (
  SELECT b.doc_id, b.line_no, b.grp, r.s, r.e, r.text, list_filter(string_split(lower(r.text), ' '), lambda w: w <> lower(b.text))[1] AS other, len(string_split(r.text, ' ')) AS size
  FROM bests b JOIN ranked r USING (doc_id, line_no, grp) WHERE b.top = 'dictionary_single_token' AND r.pattern = 'bare' AND r.s <= b.s AND r.e >= b.e
), wide AS (
  SELECT doc_id, line_no, grp, arg_min(s, s) AS ws, arg_min(e, s) AS we, arg_min(text, s) AS wtext FROM odd
  WHERE regexp_matches(text, '^\S{{2,}}( \p{{Lu}})+ \S{{2,}}$') OR size = 2 AND (other IS NULL OR length(other) >= 2 AND other NOT IN {_in('ambiguous')} AND other NOT IN {_in('calendar')} AND other NOT IN {_in('stopword')}
    AND other NOT IN {_in('location')} AND other NOT IN {_in('organization')} AND other NOT IN {_in('language')} AND (other IN {_in('first')} OR other IN {_in('last')} OR other NOT IN {_in('common')})) GROUP BY ALL
), cands AS (
  SELECT doc_id, line_no, grp, coalesce(ws, s) AS s, coalesce(we, e) AS e, coalesce(wtext, text) AS text, evidence, pats FROM bests LEFT JOIN wide USING (doc_id, line_no, grp)
), occ AS (
  SELECT doc_id, text, len(list_filter(range(1, len(ps)), lambda i: (i = 1 OR ps[i] <> '') AND NOT regexp_matches(right(ps[i], 1), '[\p{{L}}\p{{N}}_]') AND NOT regexp_matches(left(ps[i + 1], 1), '[\p{{L}}\p{{N}}_]'))) AS occurrences
  FROM (SELECT DISTINCT c.doc_id, c.text, string_split(p.text, c.text) AS ps FROM cands c JOIN planted p ON p.doc_id = c.doc_id)
), counted AS (
  SELECT *, lower(text) AS key, {often} AS reps, string_split(lower(text), ' ') AS ws, string_split(text, ' ') AS raw FROM cands{" JOIN occ USING (doc_id, text)" if counts else ""}
), tested AS (
  SELECT *, len(ws) AS n, len(list_filter(ws, lambda w: w IN {_in('first')} OR w IN {_in('last')})) AS known,
    flatten(list_transform(range(1, 6), lambda k: list_transform(range(1, greatest(len(ws) - k + 2, 1)), lambda i: array_to_string(ws[i:i + k - 1], ' ')))) AS pairs,
    list_has_any(pats, ['titled', 'dictionary', 'document_name']) AS strong FROM counted
), failing AS (
  SELECT *, CASE
    WHEN length(text) < 3 OR length(text) > 60 OR n > 5 THEN 'length'
    WHEN len(list_filter(raw, lambda w: NOT regexp_matches(w, '^\p{{Lu}}[\p{{L}}''\-]*\.?$') OR regexp_matches(w, '^\p{{Lu}}{{2,}}s?$') AND lower(w) NOT IN {_in('last')})) > 0 THEN 'structure'
    WHEN regexp_matches(text, '[0-9!@#$%^&*()_+=\[\]{{}}<>/|~`\\]') THEN 'punctuation'
    WHEN len(list_distinct(ws)) < n THEN 'repetition'
    WHEN len(list_filter(raw, lambda w: length(w) <> 1)) = 0 THEN 'initial'
    WHEN regexp_matches(regexp_replace(text, '\p{{Latin}}', '', 'g'), '\p{{L}}') OR len(list_filter(ws, lambda w: w IN {_in('marker')})) > 0 THEN 'language'
    WHEN NOT (strong OR list_contains(pats, 'dictionary_single_token') AND NOT (ws[1] IN {_in('ambiguous')} OR n = 1 AND key IN {_in('calendar')}) OR reps >= 4 AND NOT (n = 1 AND key IN {_in('calendar')})) THEN 'corroboration'
    WHEN len(list_filter(pairs, lambda p: p IN {_in('blacklist')})) > 0 THEN 'blacklist'
    WHEN len(list_filter(pairs, lambda p: p IN {_in('campaign')})) > 0 OR len(list_filter(ws, lambda w: w IN {_in('slogan')})) > 0 THEN 'campaign'
    WHEN len(list_filter(ws, lambda w: w IN {_in('organization')})) > 0 THEN 'organization'
    WHEN len(list_filter(pairs, lambda p: p IN {_in('location')})) > 0 AND NOT (len(list_filter(ws, lambda w: w IN {_in('first')} AND w NOT IN {_in('location')})) > 0 OR n > 1 AND reps >= 4) THEN 'location'
    WHEN len(list_filter(ws, lambda w: w IN {_in('stopword')})) > 0 THEN 'stopword' END AS failed FROM tested
), scored AS (
  SELECT *, CASE WHEN failed IS NOT NULL THEN 0 ELSE evidence + 0.20 + CASE WHEN known * 4 = n THEN 0.17 WHEN known * 4 = n * 3 THEN 0.52 ELSE (round(known * 70.0 / n) / 100)::DECIMAL(6, 2) END
    + CASE WHEN list_contains(pats, 'titled') THEN 0.30 ELSE 0 END + CASE WHEN len(list_filter(raw, lambda w: length(w) = 1)) > 0 THEN 0.05 ELSE 0 END END::DECIMAL(8, 4) AS score,
    strong OR list_contains(pats, 'dictionary_single_token') AND reps >= 4 AS sure, len(list_filter(ws, lambda w: w NOT IN {_in('common')})) = 0 AS common FROM failing
), judged AS (
  SELECT *, CASE WHEN score >= 0.75 AND sure THEN 'accepted' WHEN score >= 0.45 AND NOT sure AND common THEN 'rejected' WHEN score >= 0.45 THEN 'review' ELSE 'rejected' END AS decision FROM scored
), forms AS (
  SELECT doc_id, key, text, count(*) AS n, min((line_no, s)) AS place, max(score) AS best, max(CASE decision WHEN 'accepted' THEN 2 WHEN 'review' THEN 1 ELSE 0 END) AS level FROM judged GROUP BY ALL
), people AS (
  SELECT doc_id, key, first(text ORDER BY n DESC, place) AS display, sum(n)::BIGINT AS occurrences, ['rejected', 'review', 'accepted'][max(level) + 1] AS decision, max(best) AS best_score FROM forms GROUP BY ALL
), names AS (
  SELECT key AS name, sum(occurrences)::BIGINT AS total_occurrences, CASE WHEN bool_or(decision = 'accepted') THEN 'accepted' ELSE 'review' END AS decision, count(*) AS num_documents, min(doc_id) AS first_document
  FROM people WHERE decision <> 'rejected' GROUP BY key
)"""


DOCS = "WITH " + spans_of("documents")
GOLD = f""", picks AS (
  SELECT doc_id, len(string_split(coalesce(text, ''), chr(10))) + 1 AS line_no, doc_id % {len(MARKED)} AS k FROM documents
  UNION ALL SELECT doc_id, len(string_split(coalesce(text, ''), chr(10))) + 2, (doc_id * 7 + 3) % {len(MARKED)} FROM documents
), gold AS (
  SELECT doc_id, line_no, s, e, text FROM picks JOIN (VALUES {_gold_rows()}) AS g(k, s, e, text) USING (k)
), acc AS (
  SELECT * FROM judged WHERE decision = 'accepted'
)"""
SPAN = "doc_id, line_no, s AS span_start, e AS span_end, text"
HIT = "x.doc_id = y.doc_id AND x.line_no = y.line_no AND x.s < y.e AND y.s < x.e"
WORDS = "len(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+'))"
SHARE = f"len(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+'), lambda w: w IN {_in('stopword')})) / greatest({WORDS}, 1)"
HTML = "html"
for _pattern, _to, _flags in (
    (r"<!--.*?-->", "", "gs"), (r"<(script|style|noscript|template|svg|object|iframe)\b.*?</(script|style|noscript|template|svg|object|iframe)>", "", "gis"),
    (r"</?(td|th)\b[^>]*>", " | ", "gi"), (r"</?(p|div|br|li|ul|ol|h[1-6]|nav|article|section|header|footer|table|tr|title|body|head|html)\b[^>]*>", "\n", "gi"), (r"<[^>]+>", "", "g"),
):
    HTML = f"regexp_replace({HTML}, '{_pattern}', '{_to}', '{_flags}')"
for _name, _char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
    HTML = f"replace({HTML}, '{_name}', '{_char}')"
HTML = f"trim(regexp_replace(regexp_replace(regexp_replace({HTML}, '[ \\t]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10))"

#: Words that may name code on a line: the character before each is kept where it tells a host.
NEAR = "line[greatest(s - 150, 0) + 1:e + 150]"
DOTTED = r"regexp_extract_all(" + NEAR + r", '(?:://|@|^|[^.A-Za-z0-9_])[a-z][a-z0-9_]*(?:\.[A-Za-z0-9_]+)+')"
CODE = f"""
      , found AS (SELECT DISTINCT doc_id, line_no, s, unnest({DOTTED}) AS raw FROM judged JOIN lines USING (doc_id, line_no)
      ), bare_names AS (SELECT *, regexp_replace(raw, '^(://|[^a-z])', '') AS name, raw LIKE '@%' OR raw LIKE '://%' AS led FROM found
      ), labelled AS (SELECT *, string_split(name, '.') AS ls FROM bare_names
      ), hosts AS (SELECT *, NOT regexp_matches(name, '[A-Z_]') AND ls[1] NOT IN ({_list(PACKAGE_ROOTS)[1:-1]}) AND length(ls[1]) <> 2
          AND (led OR ls[1] = 'www' OR ls[-1] IN ({_list(GENERIC_DOMAINS)[1:-1]}) OR regexp_matches(ls[-1], '^[a-z]{{2}}$') AND ls[-2] IN ({_list(SECOND_LABELS)[1:-1]})) AS host FROM labelled
      ), code AS (SELECT DISTINCT doc_id, line_no, s FROM hosts WHERE NOT host AND (len(ls) >= 4 OR len(ls) = 3 AND regexp_matches(name, '^[a-z0-9_]+\\.[a-z0-9_]+\\.[A-Z]')
          OR contains(regexp_extract(name, '^([a-z0-9_]+(?:\\.[a-z0-9_]+)+)(?:\\.|$)', 1), '_')))"""
BEFORE_LINE = "JOIN lines USING (doc_id, line_no)"
PEOPLE_LIST = "coalesce(list(struct_pack(name := display, occurrences := occurrences) ORDER BY display, occurrences) FILTER (decision = '{0}'), [])"
SCAN = f""", words_of AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM planted), files AS (
        SELECT doc_id, CASE WHEN len(w) < 30 OR len(list_filter(w, lambda x: x IN {_in('stopword')})) / len(w) >= 0.15 THEN 'ok' ELSE 'skipped: not_english' END AS status FROM words_of
      ), named AS (SELECT doc_id, count(*) AS n, string_agg(display, '; ' ORDER BY display) AS names FROM people WHERE decision = 'accepted' GROUP BY doc_id
      ), scan_rows AS (SELECT doc_id, status, CASE WHEN status = 'ok' THEN coalesce(n, 0) ELSE 0 END AS num_names, CASE WHEN status = 'ok' THEN coalesce(names, '') ELSE '' END AS names FROM files LEFT JOIN named USING (doc_id))"""
RECORDS = """, records AS (SELECT doc_id, line_no, s AS span_start, text, score::DOUBLE AS score, decision, length(text) AS char_length, sha256(CASE WHEN length(line) <= 2000 THEN line ELSE line[greatest(least(s - 1000, length(line) - 2000), 0) + 1:greatest(least(s - 1000, length(line) - 2000), 0) + 2000] END) AS context_sha256
        FROM judged JOIN lines USING (doc_id, line_no) WHERE failed IS NULL)"""
VOUCHED = f""", f AS (SELECT DISTINCT doc_id, lower(raw[1]) AS key FROM judged WHERE decision = 'accepted' AND n >= 2 AND length(raw[1]) >= 2
        AND ws[1] NOT IN {_in('common')} AND ws[1] NOT IN {_in('ambiguous')} AND ws[1] NOT IN {_in('calendar')} AND ws[1] NOT IN {_in('language')})"""

CONTEXT = f"""
      , ctx AS (SELECT j.*, line[:j.s] AS pre, line[j.e + 1:] AS post, code.s IS NOT NULL OR coalesce({_log_line()}, false) OR regexp_matches(line[1:300], '{TABLE_ROW}') AS machine
        FROM judged j JOIN lines USING (doc_id, line_no) LEFT JOIN code ON code.doc_id = j.doc_id AND code.line_no = j.line_no AND code.s = j.s
      ), told AS (SELECT * EXCLUDE (failed, score), CASE WHEN failed IN ('length', 'structure') THEN failed WHEN machine THEN 'system_log' WHEN failed IS NOT NULL THEN failed
          WHEN regexp_matches(lower(pre[-10:]), 'http://|https://|www\\.') OR ltrim(post, ' ' || chr(9))[1:1] = '@' THEN 'context' END AS failed, score
        FROM ctx
      ), weighed AS (SELECT * EXCLUDE (score), CASE WHEN failed IS NOT NULL THEN 0 ELSE score + CASE WHEN lower(regexp_extract(pre, '([A-Za-z'']+)\\s*$', 1)) IN {_in('occupation')} THEN 0.10 ELSE 0 END END::DECIMAL(8, 4) AS score FROM told)
"""
DECIDED = """
      , decided AS (SELECT * EXCLUDE (decision), CASE WHEN score >= 0.75 AND sure THEN 'accepted' WHEN score >= 0.45 AND NOT sure AND common THEN 'rejected' WHEN score >= 0.45 THEN 'review' ELSE 'rejected' END AS decision FROM weighed)"""
ADDED = f"""
      , tokens AS (SELECT DISTINCT doc_id, raw[1] AS tok FROM decided WHERE decision = 'accepted' AND (doc_id, lower(raw[1])) IN (SELECT (doc_id, key) FROM f) AND n >= 2
      ), cands_x AS (SELECT x.doc_id, x.line_no, 0 AS grp, x.s, x.e, x.tok AS text, 0.60 AS evidence, ['document_name'] AS pats FROM flagged x JOIN tokens USING (doc_id, tok)
        WHERE NOT EXISTS (FROM cands y WHERE {HIT}) AND NOT EXISTS (FROM cands y JOIN lines USING (doc_id, line_no) WHERE y.doc_id = x.doc_id AND y.line_no = x.line_no AND y.s IN (x.e + 1, x.e + 2) AND trim(line[x.e + 1:y.s], ' ' || chr(9)) = ''))"""


def _again(sql: str) -> str:
    """The steps from candidates to decisions for the mentions that were added."""
    return re.sub(r"\b(cands|occ|counted|tested|failing|scored|judged|found|bare_names|labelled|hosts|code|ctx|told|weighed|decided)\b", r"\1_x", sql)


WHOLE = spans_of("documents", counts=True)
EXTRACT = "WITH " + WHOLE + CODE + CONTEXT + DECIDED + VOUCHED.replace("FROM judged", "FROM decided") + ADDED + _again(", " + WHOLE[WHOLE.index("occ AS (") : WHOLE.index("), forms AS") + 1] + CODE + CONTEXT + DECIDED) + f"""
      , risen AS (SELECT * EXCLUDE (decision, score), CASE WHEN up THEN score + 0.60 ELSE score END::DECIMAL(8, 4) AS score, CASE WHEN up THEN 'accepted' ELSE decision END AS decision
        FROM (SELECT *, decision = 'review' AND n = 1 AND (doc_id, key) IN (SELECT (doc_id, key) FROM f) AS up FROM decided) UNION ALL BY NAME SELECT * FROM decided_x
      ), edges AS (SELECT DISTINCT doc_id, unnest([ws[1], ws[-1]]) AS key FROM risen WHERE decision = 'accepted' AND n >= 2
      ), wf AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM planted
      ), flat AS (SELECT doc_id FROM wf WHERE len(w) < 30 AND (len(w) = 0 OR len(list_filter(w, lambda x: x IN {_in('stopword')})) / len(w) < 0.15)
      ), final AS (SELECT * EXCLUDE (decision), CASE WHEN decision = 'accepted' AND n = 1 AND NOT list_has_any(pats, ['titled', 'document_name'])
          AND (doc_id IN (FROM flat) OR key IN {_in('common')} AND key IN {_in('last')} AND key NOT IN {_in('first')} AND (doc_id, key) NOT IN (SELECT (doc_id, key) FROM edges)) THEN 'review' ELSE decision END AS decision FROM risen)
"""

NAMES = f"({_in('first')[1:-1]}, {_in('last')[1:-1]})"

ORACLE_SQL = {
    "folded_lookup": f"""WITH w AS (SELECT c_custkey, ['Änna', 'María', 'Jöhn', 'Kellér', 'Łopez', 'Nóvak', 'Lopez', 'Đavid', 'Zoë', 'Straße'][c_custkey % 10 + 1] || CASE WHEN c_custkey % 7 = 0 THEN 'x' ELSE '' END AS word FROM customer
      ), k AS (SELECT c_custkey, word, lower(word) AS key, replace(translate(strip_accents(lower(word)), 'łđ', 'ld'), 'ß', 'ss') AS plain FROM w
      ), u AS (SELECT c_custkey, word, CASE WHEN key NOT IN {NAMES} AND plain IN {NAMES} THEN plain ELSE key END AS key FROM k)
      SELECT c_custkey, word, key, key IN {_in('first')} AS first_name, key IN {_in('last')} AS last_name FROM u""",
    "clean_text": r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(coalesce(text, '') || ' ' || chr(9) || chr(13) || chr(10) || 'end' || chr(1) || chr(13), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '\r\n?', chr(10), 'g'), '[ \t]+\n', chr(10), 'g') AS cleaned FROM documents""",
    "doc_metrics": "SELECT doc_id, length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 1 AS n_lines, length(coalesce(text, '')) AS n_code_points FROM documents",
    "english_gate": f"SELECT doc_id, {WORDS} AS n_words, round_even({SHARE}, 4) AS share, CASE WHEN {WORDS} < 30 THEN 1.0 ELSE round_even({SHARE}, 4) END::DOUBLE AS ratio, {WORDS} < 30 OR {SHARE} >= 0.15 AS english FROM documents",
    "short_non_prose": f"SELECT doc_id, {WORDS} < 30 AND ({WORDS} = 0 OR {SHARE} < 0.15) AS short_non_prose FROM documents",
    "line_index": DOCS + "SELECT doc_id, line_no, length(line) AS n_chars FROM lines",
    "normalize_names": r"""WITH n AS (SELECT c_custkey, trim(trim(regexp_replace(' (' || c_name || '  ' || c_mktsegment || '''s)., ', '\s+', ' ', 'g')), '.,;:()[]{}"''-') AS name FROM customer) SELECT c_custkey, name, regexp_replace(name, '[''’]s$', '') AS stem FROM n""",
    "context_words": DOCS + r"""SELECT doc_id, line_no, s AS span_start, regexp_extract(line[:s], '([A-Za-z'']+)\s*$', 1) AS before, ltrim(line[e + 1:e + 500], ' ' || chr(9))[1:1] AS after,
        line[greatest(s - 20, 0) + 1:s] || '[[' || line[s + 1:e] || ']]' || line[e + 1:e + 20] AS excerpt FROM cands JOIN lines USING (doc_id, line_no)""",
    "bare_spans": DOCS + f"SELECT {SPAN} FROM dets WHERE pattern = 'bare'",
    "titled_spans": DOCS + f"SELECT {SPAN} FROM dets WHERE pattern = 'titled'",
    "dictionary_spans": DOCS + f"SELECT {SPAN}, pattern FROM dets WHERE pattern LIKE 'dictionary%'",
    "overlap_merge": DOCS + "SELECT doc_id, line_no, grp, min(s) AS span_start, max(e) AS span_end, count(*) AS n FROM grouped GROUP BY ALL",
    "canonical_span": DOCS + f"SELECT {SPAN}, evidence::DOUBLE AS evidence, array_to_string(pats, ',') AS patterns FROM cands",
    "stopword_trim": f"SELECT p_partkey, regexp_replace(regexp_replace('The Of ' || p_name || ' and the', '^(?:(?:{STOP}) ){{1,4}}', '', 'i'), '(?: (?:{STOP})){{1,4}}$', '', 'i') AS trimmed FROM part",
    "repetition_counts": DOCS + "SELECT doc_id, key, count(*) AS reps FROM counted GROUP BY ALL",
    "reject_reason": DOCS + "SELECT doc_id, line_no, s AS span_start, text, coalesce(failed, '-') AS failed FROM judged",
    "rule_score": DOCS + "SELECT score::DOUBLE AS score, count(*) AS n FROM judged GROUP BY ALL",
    "decisions": DOCS + "SELECT doc_id, line_no, s AS span_start, text, reps, score::DOUBLE AS score, decision FROM judged",
    "boundary_refine": DOCS + f"""
      , b AS (SELECT text, string_split(text, ' ') AS w, count(*) AS n FROM dets WHERE pattern = 'bare' GROUP BY ALL), k AS (
        SELECT *, list_transform(w, lambda x: lower(x) IN {_in('first')} OR lower(x) IN {_in('last')}) AS known FROM b
      ), p AS (SELECT text, n, unnest(CASE WHEN len(w) = 4 AND (known[1] AND known[2] OR known[3] AND known[4]) THEN [w[1] || ' ' || w[2], w[3] || ' ' || w[4]] ELSE [text] END) AS part FROM k
      ), q AS (SELECT text, n, part, string_split(part, ' ') AS w FROM p)
      SELECT text, n, CASE WHEN len(w) <> 2 THEN part
        WHEN lower(w[1]) IN {_in('organization')} AND lower(w[2]) NOT IN {_in('organization')} AND (lower(w[2]) IN {_in('first')} OR lower(w[2]) IN {_in('last')}) THEN w[2]
        WHEN lower(w[2]) IN {_in('organization')} AND lower(w[1]) NOT IN {_in('organization')} AND (lower(w[1]) IN {_in('first')} OR lower(w[1]) IN {_in('last')}) THEN w[1] ELSE part END AS refined FROM q""",
    "features": DOCS + f"""
      , sizes AS (SELECT doc_id, line_no, grp, count(*) AS n_detections FROM grouped GROUP BY ALL), j AS (SELECT judged.*, n_detections FROM judged JOIN sizes USING (doc_id, line_no, grp))
      , plain AS (SELECT j.*, line[:s] AS pre, line[e + 1:] AS post, list_filter(list_transform(ws, lambda w: regexp_replace(w, '[.''’]+$', '')), lambda w: w <> '') AS stems FROM j JOIN lines USING (doc_id, line_no)
      ), near AS (SELECT *, CASE WHEN len(list_filter(stems, lambda w: w NOT IN {_in('title')} AND w NOT IN {_in('honorific')})) > 0 THEN list_filter(stems, lambda w: w NOT IN {_in('title')} AND w NOT IN {_in('honorific')}) ELSE stems END AS body,
          list_reverse(regexp_extract_all(lower(pre), '[a-z'']+'))[1:3] AS lw, regexp_extract_all(lower(post), '[a-z'']+')[1:3] AS rw, ltrim(post, ' ' || chr(9))[1:1] AS nx, CASE WHEN s = 0 THEN '' ELSE pre[greatest(s - 199, 1):] END AS tail FROM plain)
      SELECT doc_id, line_no, s AS span_start, n AS token_count, length(text) AS char_length, len(list_filter(ws, lambda w: length(w) = 1)) AS initials, len(list_filter(ws, lambda w: w IN {_in('first')})) AS known_first,
        len(list_filter(ws, lambda w: w IN {_in('last')})) AS known_last, round_even(len(list_filter(body, lambda w: w IN {_in('common')})) / len(body), 4) AS common_share, (body[1] IN {_in('ambiguous')})::INT AS first_ambiguous,
        round_even(known / n, 4) AS known_share, (len(list_filter(ws, lambda w: w IN {_in('honorific')})) > 0)::INT AS honorific, round_even(len(list_filter(raw, lambda w: regexp_matches(w, '^\\p{{Lu}}'))) / n, 4) AS capital_share,
        CASE WHEN list_contains(pats, 'titled') THEN 0.9 WHEN list_contains(pats, 'bare') THEN 0.55 ELSE 0 END::DOUBLE AS rule_confidence, CASE WHEN list_contains(pats, 'dictionary') THEN 0.85 WHEN list_contains(pats, 'dictionary_single_token') THEN 0.4 ELSE 0 END::DOUBLE AS list_confidence,
        list_has_any(pats, ['titled', 'bare'])::INT + list_has_any(pats, ['dictionary', 'dictionary_single_token'])::INT AS n_detectors, (regexp_extract(lower(pre), '([a-z'']+)\\s*$', 1) IN {_in('stopword')})::INT AS after_stopword,
        (nx <> '' AND NOT regexp_matches(nx, '[\\p{{L}}\\p{{N}}]'))::INT AS before_punctuation, ((length(tail) - length(replace(tail, '"', ''))) % 2 = 1 OR length(replace(tail, '”', '')) > length(replace(tail, '“', '')))::INT AS quoted,
        list_has_any(lw, string_split('{PERSON_CUES}', ' '))::INT AS person_cue, (list_has_any(rw, string_split('{OTHER_CUES}', ' ')) OR len(list_filter(rw, lambda w: w IN {_in('organization')})) > 0)::INT AS other_cue, (len(lw) = 0 AND len(rw) = 0)::INT AS isolated,
        len(list_filter(body, lambda w: w IN {_in('location')} OR w IN {_in('organization')})) AS place_or_org, list_contains(pats, 'titled')::INT AS titled, list_contains(pats, 'dictionary')::INT AS dictionary,
        list_contains(pats, 'bare')::INT AS bare, n_detections, reps FROM near WHERE failed IS NULL""",
    "propagate_names": DOCS + f"""
      , f AS (SELECT DISTINCT doc_id, raw[1] AS tok FROM judged WHERE decision = 'accepted' AND n >= 2 AND length(raw[1]) >= 2 AND ws[1] NOT IN {_in('common')} AND ws[1] NOT IN {_in('ambiguous')} AND ws[1] NOT IN {_in('calendar')} AND ws[1] NOT IN {_in('language')})
      SELECT x.doc_id, x.line_no, x.s AS span_start, x.e AS span_end, x.tok AS text FROM flagged x JOIN f ON f.doc_id = x.doc_id AND f.tok = x.tok WHERE NOT EXISTS (FROM cands y WHERE {HIT}) AND NOT EXISTS (FROM cands y JOIN lines USING (doc_id, line_no) WHERE y.doc_id = x.doc_id AND y.line_no = x.line_no AND y.s IN (x.e + 1, x.e + 2) AND trim(line[x.e + 1:y.s], ' ' || chr(9)) = '')""",
    "caps": DOCS + f"""
      , edges AS (SELECT DISTINCT doc_id, unnest([ws[1], ws[-1]]) AS key FROM judged WHERE decision = 'accepted' AND n >= 2)
      SELECT doc_id, line_no, s AS span_start, text, CASE WHEN decision = 'accepted' AND n = 1 AND key IN {_in('common')} AND key IN {_in('last')} AND key NOT IN {_in('first')} AND NOT list_contains(pats, 'titled')
        AND (doc_id, key) NOT IN (SELECT (doc_id, key) FROM edges) THEN 'review' ELSE decision END AS decision FROM judged""",
    "evidence_source": DOCS + "SELECT CASE WHEN list_contains(pats, 'titled') THEN 'titled' WHEN list_contains(pats, 'dictionary') THEN 'dictionary' WHEN list_contains(pats, 'dictionary_single_token') THEN 'dictionary_single_token' ELSE 'bare' END AS pattern, decision, count(*) AS n FROM judged GROUP BY ALL",
    "persons": DOCS + "SELECT doc_id, key, display, occurrences, decision, best_score::DOUBLE AS best_score FROM people",
    "low_confidence": DOCS + "SELECT doc_id, key, count(*) AS n FROM judged WHERE failed = 'corroboration' GROUP BY ALL",
    "document_counters": DOCS + "SELECT doc_id, count(*) AS n_candidates, count(*) FILTER (decision = 'accepted') AS n_accepted, count(*) FILTER (decision = 'review') AS n_review, count(*) FILTER (decision = 'rejected') AS n_rejected, count(DISTINCT key) AS n_names FROM judged GROUP BY doc_id",
    "collection_names": DOCS + "SELECT * FROM names",
    "dominance_trim": DOCS + r""", c AS (SELECT key AS name, count(*) AS n FROM counted GROUP BY key), x AS (
        SELECT name, n, unnest([regexp_replace(name, '^\S+ ', ''), regexp_replace(name, ' \S+$', '')]) AS core FROM c
      ), f AS (SELECT x.name, arg_max(x.core, (c.n, x.core)) AS core FROM x JOIN c ON c.name = x.core WHERE x.core <> x.name AND c.n >= 3 AND c.name LIKE '% %' AND c.n >= 3 * x.n GROUP BY x.name)
      SELECT name, n, core FROM c LEFT JOIN f USING (name)""",
    "scan_summary": DOCS + "SELECT (SELECT count(*) FROM documents) AS n_documents, count(DISTINCT doc_id) AS n_with_names, count(*) AS n_names FROM people WHERE decision = 'accepted'",
    "gold_markup": DOCS + GOLD + f"SELECT {SPAN} FROM gold",
    "missed_mentions": DOCS + GOLD + f"SELECT {SPAN} FROM gold x WHERE NOT EXISTS (FROM acc y WHERE {HIT})",
    "false_positives": DOCS + GOLD + f"SELECT {SPAN} FROM acc x WHERE NOT EXISTS (FROM gold y WHERE {HIT})",
    "overlap_metrics": DOCS + GOLD + f""", v AS (SELECT (SELECT count(*) FROM acc x WHERE EXISTS (FROM gold y WHERE {HIT})) AS tp, (SELECT count(*) FROM acc) AS n_predicted,
        (SELECT count(*) FROM gold x WHERE EXISTS (FROM acc y WHERE {HIT})) AS gold_found, (SELECT count(*) FROM gold) AS n_gold)
      SELECT *, round_even(tp / n_predicted, 4) AS precision, round_even(gold_found / n_gold, 4) AS recall, round_even(2 * (tp / n_predicted) * (gold_found / n_gold) / (tp / n_predicted + gold_found / n_gold), 4) AS f1 FROM v""",
    "shape_recall": DOCS + GOLD + f"SELECT CASE WHEN text LIKE '% %' THEN 'multi' ELSE 'single' END AS shape, count(*) AS n_gold, count(*) FILTER (EXISTS (FROM acc y WHERE {HIT})) AS n_found FROM gold x GROUP BY 1",
    "run_diff": DOCS + """, h AS (SELECT key, doc_id % 2 AS k, CASE WHEN bool_or(decision = 'accepted') THEN 'accepted' ELSE 'review' END AS decision FROM people WHERE decision <> 'rejected' GROUP BY ALL)
      SELECT coalesce(b.decision, 'absent') || '->' || coalesce(a.decision, 'absent') AS transition, count(*) AS n FROM (FROM h WHERE k = 0) b FULL JOIN (FROM h WHERE k = 1) a ON a.key = b.key GROUP BY 1""",
    "collision_audit": "WITH l(list_name, key) AS (VALUES " + ", ".join(f"('{n}', '{k}')" for n, keys in LISTS.items() for k in keys) + ") SELECT key, count(*) AS n_lists, string_agg(list_name, ',' ORDER BY list_name) AS lists FROM l GROUP BY key HAVING count(*) > 1",
    "delimiter_sniff": r"""WITH l AS (SELECT o_orderkey, o_orderpriority || d || o_orderstatus || d || 'a,b;c' AS line FROM (SELECT *, [',', ';', chr(9), '|', ' '][o_orderkey % 5 + 1] AS d FROM orders))
      SELECT o_orderkey, CASE WHEN m = 0 THEN ',' WHEN c = m THEN ',' WHEN s = m THEN ';' WHEN t = m THEN chr(9) ELSE '|' END AS delimiter FROM (
        SELECT *, greatest(c, s, t, p) AS m FROM (SELECT o_orderkey, len(string_split(line, ',')) - 1 AS c, len(string_split(line, ';')) - 1 AS s, len(string_split(line, chr(9))) - 1 AS t, len(string_split(line, '|')) - 1 AS p FROM l))""",
    "csv_lines": "SELECT s_suppkey, 'id | name' || chr(10) || s_suppkey || ' | ' || s_name || ' x' AS lines FROM supplier",
    "format_dispatch": "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'txt' WHEN 1 THEN 'csv' WHEN 2 THEN '-' WHEN 3 THEN 'json' ELSE CASE WHEN regexp_matches(lower(url), '\\.(html|htm)$') THEN 'html' ELSE '-' END END AS format FROM pages",
    "html_to_text": f"SELECT page_id, {HTML} AS text FROM pages",
    "json_props_lines": "SELECT event_id, unnest(list_transform(json_keys(props), lambda k: k || ': ' || json_extract_string(props, k))) AS line FROM events",
    "rolling_char_window": """WITH c AS (SELECT conv_id, turn, length(coalesce(text, '')) + 1 AS size, sum(length(coalesce(text, '')) + 1) OVER (PARTITION BY conv_id ORDER BY turn) AS until FROM conversations)
      SELECT t.conv_id, t.turn, min(s.turn) AS first_turn, count(*) AS n_messages, sum(s.size)::BIGINT AS n_chars FROM c t JOIN c s ON s.conv_id = t.conv_id AND s.turn <= t.turn AND (s.turn = t.turn OR t.until - s.until + s.size <= 600) GROUP BY ALL""",
    "session_roster": "WITH messages AS (SELECT conv_id * 10000 + turn AS doc_id, text FROM conversations), " + spans_of("messages") + "SELECT doc_id // 10000 AS conv_id, key AS name, min(doc_id % 10000) AS first_turn, max(doc_id % 10000) AS last_turn, count(*) AS n_seen, bool_or(decision = 'accepted') AS accepted FROM judged GROUP BY ALL",
    "newly_accepted": "WITH messages AS (SELECT conv_id * 10000 + turn AS doc_id, text FROM conversations), " + spans_of("messages") + "SELECT doc_id // 10000 AS conv_id, min(doc_id % 10000) AS turn, key AS name FROM judged WHERE decision = 'accepted' GROUP BY ALL",
    "feedback_dedupe": DOCS + "SELECT key AS name, min(doc_id) AS doc_id FROM people WHERE decision = 'review' AND key NOT IN (SELECT key FROM people WHERE decision = 'accepted') GROUP BY key",
    "candidate_records": DOCS + RECORDS + "SELECT * FROM records",
    "review_records": DOCS + RECORDS + """, firsts AS (SELECT doc_id, key, min((line_no, s)) AS place FROM judged GROUP BY ALL HAVING bool_or(decision = 'review') AND NOT bool_or(decision = 'accepted'))
      SELECT * FROM records WHERE (doc_id, lower(text), (line_no, span_start)) IN (SELECT (doc_id, key, place) FROM firsts)""",
    "stratified_sample": "SELECT * FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR), doc_id) AS rank FROM documents) WHERE rank <= 25",
    "holdout_sample": "SELECT doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents ORDER BY 2, 1 LIMIT 20",
    "class_balance": "SELECT *, least(positive, negative) >= 10 AND greatest(positive, negative) <= 3 * least(positive, negative) AS trainable FROM (SELECT count(*) FILTER (quality = 1) AS positive, count(*) FILTER (quality = 0) AS negative FROM labels)",
    "privacy_scan": " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind FROM documents WHERE regexp_matches(text, '{p}')" for k, p in PRIVATE.items()),
    "latency_quantiles": "SELECT event_type, n, value AS p95 FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) WHERE k = floor(0.95 * (n - 1))",
    "stage_medians": "SELECT event_type, count(*) AS n, (quantile_disc(value, 0.5) + list_sort(list(value))[count(*) // 2 + 1]) / 2 AS median FROM events WHERE value IS NOT NULL GROUP BY event_type",
    "context_rules": DOCS + CODE + CONTEXT + f"""
      SELECT doc_id, line_no, s AS span_start, text, coalesce(failed, '-') AS failed, score::DOUBLE AS score,
        CASE WHEN score >= 0.75 AND sure THEN 'accepted' WHEN score >= 0.45 AND NOT sure AND common THEN 'rejected' WHEN score >= 0.45 THEN 'review' ELSE 'rejected' END AS decision FROM weighed""",
    "occurrences": DOCS + "SELECT doc_id, text, occurrences FROM occ",
    "extract": EXTRACT + "SELECT doc_id, line_no, s AS span_start, text, reps, coalesce(failed, '-') AS failed, score::DOUBLE AS score, decision FROM final",
    "extract_persons": EXTRACT + """, ff AS (SELECT doc_id, key, text, count(*) AS n, min((line_no, s)) AS place, max(score) AS best, max(CASE decision WHEN 'accepted' THEN 2 WHEN 'review' THEN 1 ELSE 0 END) AS level FROM final GROUP BY ALL)
      SELECT doc_id, key, first(text ORDER BY n DESC, place) AS display, sum(n)::BIGINT AS occurrences, ['rejected', 'review', 'accepted'][max(level) + 1] AS decision, max(best)::DOUBLE AS best_score FROM ff GROUP BY ALL""",
    "sentence_starts": DOCS + r"""SELECT doc_id, line_no, s AS span_start, regexp_matches(line[:s], '(^|[.!?][’”]?)[ \t"''‘“(]*$') AS opens,
        (length(tail) - length(replace(tail, '"', ''))) % 2 = 1 OR length(replace(tail, '”', '')) > length(replace(tail, '“', '')) AS quoted
      FROM (SELECT *, CASE WHEN s = 0 THEN '' ELSE line[greatest(s - 199, 1):s] END AS tail FROM flagged JOIN lines USING (doc_id, line_no))""",
    "neighbour_words": DOCS + r"""SELECT doc_id, line_no, s AS span_start, array_to_string(list_reverse(regexp_extract_all(line[:s], '[A-Za-z'']+'))[1:3], ' ') AS before,
        array_to_string(regexp_extract_all(line[e + 1:], '[A-Za-z'']+')[1:3], ' ') AS after FROM judged JOIN lines USING (doc_id, line_no)""",
    "promoted_names": DOCS + VOUCHED + "SELECT doc_id, line_no, s AS span_start, text, CASE WHEN decision = 'review' AND n = 1 AND (doc_id, key) IN (SELECT (doc_id, key) FROM f) THEN CASE WHEN score + 0.60 >= 0.75 THEN 'accepted' ELSE 'review' END ELSE decision END AS decision FROM judged",
    "lone_caps": DOCS + f"""
      , w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM planted), flat AS (SELECT doc_id FROM w WHERE len(w) < 30 AND (len(w) = 0 OR len(list_filter(w, lambda x: x IN {_in('stopword')})) / len(w) < 0.15))
      SELECT doc_id, line_no, s AS span_start, text, CASE WHEN decision = 'accepted' AND n = 1 AND NOT list_contains(pats, 'titled') AND doc_id IN (FROM flat) THEN 'review' ELSE decision END AS decision FROM judged""",
    "collection_merge": DOCS + r""", x AS (SELECT name, total_occurrences AS n, unnest([regexp_replace(name, '^\S+ ', ''), regexp_replace(name, ' \S+$', '')]) AS core FROM names
      ), f AS (SELECT x.name, arg_max(x.core, (c.total_occurrences, x.core)) AS core FROM x JOIN names c ON c.name = x.core WHERE x.core <> x.name AND contains(x.core, ' ') AND c.total_occurrences >= greatest(3, 3 * x.n) GROUP BY x.name)
      SELECT coalesce(core, name) AS name, sum(total_occurrences)::BIGINT AS total_occurrences, min(decision) AS decision, count(*) AS n_forms FROM names LEFT JOIN f USING (name) GROUP BY 1""",
    "person_export": DOCS + """SELECT doc_id, first(text ORDER BY line_no, s) AS person_name, count(*) AS occurrences, CASE WHEN bool_or(decision = 'accepted') THEN 'accepted' ELSE 'review' END AS decision, max(score)::DOUBLE AS best_score,
        string_agg('line ' || line_no || ', col ' || (s + 1), '; ' ORDER BY line_no, s) AS locations, first(array_to_string(pats, ', ') ORDER BY score DESC, line_no, s) AS why FROM judged GROUP BY doc_id, key HAVING bool_or(decision <> 'rejected')""",
    "json_export": DOCS + "SELECT doc_id, to_json(struct_pack(doc_id := doc_id, accepted := a, review := r, rejected := x))::VARCHAR AS json FROM (SELECT doc_id, " + ", ".join(PEOPLE_LIST.format(k) + f" AS {v}" for k, v in (("accepted", "a"), ("review", "r"), ("rejected", "x"))) + " FROM people GROUP BY doc_id)",
    "report_export": DOCS + """SELECT doc_id, 'accepted: ' || len(a) || chr(10) || array_to_string(list_concat(a, ['review: ' || len(r)], r), chr(10)) AS report FROM (SELECT doc_id,
        coalesce(list('  ' || display || ' x' || occurrences ORDER BY '  ' || display || ' x' || occurrences) FILTER (decision = 'accepted'), []) AS a,
        coalesce(list('  ' || display || ' x' || occurrences ORDER BY '  ' || display || ' x' || occurrences) FILTER (decision = 'review'), []) AS r FROM people GROUP BY doc_id)""",
    "scan_export": DOCS + SCAN + "SELECT * FROM scan_rows",
    "scan_metrics": DOCS + SCAN + """, one AS (SELECT count(*)::DOUBLE AS files, count(*) FILTER (status = 'ok')::DOUBLE AS ok, sum(num_names)::DOUBLE AS names, round_even(100 * count(*) FILTER (status = 'ok') / count(*), 2) AS coverage_percent FROM scan_rows)
      SELECT metric, value FROM (UNPIVOT one ON files, ok, names, coverage_percent INTO NAME metric VALUE value)""",
    "one_to_one_matches": DOCS + GOLD + """, g AS (SELECT doc_id, line_no, list(struct_pack(s := s, e := e) ORDER BY s, e) AS gs FROM gold GROUP BY ALL), p AS (SELECT doc_id, line_no, list(struct_pack(s := s, e := e) ORDER BY s, e) AS ps FROM acc GROUP BY ALL
      ), steps AS (
        WITH RECURSIVE steps AS (
          SELECT doc_id, line_no, coalesce(gs, []) AS gs, coalesce(ps, []) AS ps, 1 AS i, []::BIGINT[] AS used FROM g FULL JOIN p USING (doc_id, line_no)
          UNION ALL
          SELECT doc_id, line_no, gs, ps, i + 1, list_concat(used, list_filter(range(1, len(ps) + 1), lambda k: ps[k].s < gs[i].e AND gs[i].s < ps[k].e AND NOT list_contains(used, k))[1:1]) FROM steps WHERE i <= len(gs)
        ) SELECT * FROM steps WHERE i > len(gs)
      )SELECT doc_id, line_no, len(gs) AS n_gold, len(ps) AS n_predicted, len(used) AS n_matched FROM steps""",
    "promotion_gate": DOCS + GOLD + f""", sh AS (SELECT text LIKE '% %' AS multi, count(*) AS n, count(*) FILTER (EXISTS (FROM acc y WHERE {HIT})) AS b, count(*) FILTER (EXISTS (FROM acc y WHERE y.text LIKE '% %' AND {HIT})) AS a FROM gold x GROUP BY 1)
      , t AS (SELECT sum(n) AS n, sum(a) AS a, sum(b) AS b FROM sh), pr AS (SELECT count(*) AS nb, count(*) FILTER (text LIKE '% %') AS na, count(*) FILTER (EXISTS (FROM gold y WHERE {HIT})) AS hb, count(*) FILTER (text LIKE '% %' AND EXISTS (FROM gold y WHERE {HIT})) AS ha FROM acc x
      ), f AS (SELECT round_even(2 * (hb / nb) * (b / n) / (hb / nb + b / n), 4) AS fb, round_even(2 * (ha / na) * (a / n) / (ha / na + a / n), 4) AS fa FROM t, pr)
      SELECT round_even(max(b / n - a / n), 4) AS worst_drop, round_even(any_value(fa - fb), 4) AS f1_gain, max(b / n - a / n) <= 0.02 OR any_value(fa >= fb) AS promote FROM sh, f""",
    "dictionary_recall": DOCS + GOLD + f"SELECT CASE WHEN len(list_filter(string_split(lower(text), ' '), lambda w: w IN {_in('first')} OR w IN {_in('last')})) > 0 THEN 'dictionary_known' ELSE 'unseen' END AS shape, count(*) AS n_gold, count(*) FILTER (EXISTS (FROM acc y WHERE {HIT})) AS n_found FROM gold x GROUP BY 1",
    "domain_metrics": DOCS + GOLD + f""", a AS (SELECT coalesce(source, 'uncategorized') AS domain, count(*) AS n_predicted, count(*) FILTER (EXISTS (FROM gold y WHERE {HIT})) AS tp FROM acc x JOIN documents d USING (doc_id) GROUP BY 1
      ), g AS (SELECT coalesce(source, 'uncategorized') AS domain, count(*) AS n_gold, count(*) FILTER (EXISTS (FROM acc y WHERE {HIT})) AS gold_found FROM gold x JOIN documents d USING (doc_id) GROUP BY 1
      ), b AS (SELECT domain, coalesce(tp, 0) AS tp, coalesce(n_predicted, 0) AS n_predicted, coalesce(gold_found, 0) AS gold_found, coalesce(n_gold, 0) AS n_gold FROM a FULL JOIN g USING (domain)
      ), r AS (SELECT *, tp / nullif(n_predicted, 0) AS p, gold_found / nullif(n_gold, 0) AS q FROM b)
      SELECT domain, tp, n_predicted, gold_found, n_gold, round_even(p, 4) AS precision, round_even(q, 4) AS recall, round_even(2 * p * q / nullif(p + q, 0), 4) AS f1 FROM r""",
    "threshold_what_if": DOCS + """SELECT scenario, threshold, count(*) FILTER (decision = 'accepted' AND (scenario = 'promote' OR score::DOUBLE / 2 >= threshold) OR decision = 'review' AND scenario <> 'cleanup' AND score::DOUBLE / 2 >= threshold) AS n_accepted
      FROM judged, (VALUES ('cleanup'), ('promote'), ('both')) AS a(scenario), (VALUES (0.5::DOUBLE), (0.7::DOUBLE), (0.9::DOUBLE)) AS b(threshold) GROUP BY ALL""",
    "gold_labels": DOCS + GOLD + f"SELECT doc_id, line_no, s AS span_start, text, (EXISTS (FROM gold y WHERE {HIT}))::INT AS label FROM judged x",
    "gold_extension": DOCS + GOLD + f", f AS (SELECT DISTINCT doc_id, string_split(text, ' ')[1] AS tok FROM gold WHERE text LIKE '% %') SELECT x.doc_id, x.line_no, x.s AS span_start, x.e AS span_end, x.tok AS text FROM flagged x SEMI JOIN f ON f.doc_id = x.doc_id AND f.tok = x.tok WHERE NOT EXISTS (FROM gold y WHERE {HIT})",
    "weighted_training_rows": "SELECT doc_id, unnest(range(1, CASE WHEN source = 'web' THEN 4 ELSE 2 END)) AS copy FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "roster_vouchers": "WITH messages AS (SELECT conv_id * 10000 + turn AS doc_id, text FROM conversations), " + spans_of("messages") + """, m AS (SELECT doc_id // 10000 AS conv_id, doc_id % 10000 AS turn, key AS name, decision FROM judged
      ), f AS (SELECT conv_id, string_split(name, ' ')[1] AS name, min(turn) AS since FROM m WHERE decision = 'accepted' AND name LIKE '% %' GROUP BY ALL)
      SELECT DISTINCT conv_id, turn, name, since FROM m JOIN f USING (conv_id, name) WHERE decision = 'review' AND name NOT LIKE '% %' AND since < turn""",
    "classified_decisions": DOCS + f"""
      , x AS (SELECT j.*, doc_id % 10 / 10 AS p, NOT regexp_matches(line[:s], '[A-Za-z'']') AND NOT regexp_matches(line[e + 1:], '[A-Za-z'']') AS isolated, len(list_filter(ws, lambda w: w IN {_in('common')})) = 0 AS uncommon FROM judged j JOIN lines USING (doc_id, line_no)
      ), y AS (SELECT * EXCLUDE (score), CASE WHEN failed IS NOT NULL THEN 0 ELSE score + (1.05 * p::DECIMAL(6, 4))::DECIMAL(8, 4) END::DECIMAL(8, 4) AS score,
          sure OR list_contains(pats, 'dictionary_single_token') AND p >= 0.1 OR uncommon AND reps >= 4 AND (p >= 0.85 OR isolated AND p >= 0.1) AS backed FROM x)
      SELECT doc_id, line_no, s AS span_start, text, score::DOUBLE AS score, CASE WHEN score >= 0.75 AND backed THEN 'accepted' WHEN score >= 0.45 AND NOT backed AND common THEN 'rejected' WHEN score >= 0.45 THEN 'review' ELSE 'rejected' END AS decision FROM y""",
    "folded_names": "SELECT c_custkey, c_name || [' Zizek', ' Lodz', ' Strasse Aero', ' Nguyen', ' Thor'][c_custkey % 5 + 1] AS folded FROM customer",
    "sentence_split": DOCS + r"""SELECT doc_id, line_no, i - 1 AS ix, ss[i] AS sentence FROM (SELECT doc_id, line_no, string_split(regexp_replace(line, '([.!?])\s+(["'']?[A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS ss FROM lines), unnest(range(1, len(ss) + 1)) AS r(i)""",
    "line_chunks": DOCS + """, pieces AS (SELECT doc_id, list(least(2000, size - k * 2000) ORDER BY line_no, k) AS ps FROM (SELECT doc_id, line_no, length(line) + 1 AS size FROM lines), unnest(range(0, (size - 1) // 2000 + 1)) AS r(k) GROUP BY doc_id
      ), fill AS (
        WITH RECURSIVE fill AS (
          SELECT doc_id, ps, 1 AS i, 0::BIGINT AS open, 1 AS n, 0::BIGINT AS longest FROM pieces
          UNION ALL
          SELECT doc_id, ps, i + 1, CASE WHEN open + ps[i] <= 2000 THEN open + ps[i] ELSE ps[i] END, CASE WHEN open + ps[i] <= 2000 THEN n ELSE n + 1 END, greatest(longest, CASE WHEN open + ps[i] <= 2000 THEN open + ps[i] ELSE ps[i] END) FROM fill WHERE i <= len(ps)
        ) SELECT * FROM fill WHERE i > len(ps)
      )SELECT doc_id, n AS n_chunks, longest, open AS last FROM fill""",
    "entity_segments": r"SELECT p_partkey, i - 1 AS ix, ps[i] AS part FROM (SELECT p_partkey, list_filter(list_transform(string_split_regex(p_name || ' 12b ' || p_type || chr(10) || p_brand || ' x', '\n|\S*[0-9]\S*'), lambda x: trim(x)), lambda x: x <> '') AS ps FROM part), unnest(range(1, len(ps) + 1)) AS r(i)",
    "path_excludes": "SELECT page_id, CASE WHEN url LIKE '%7' THEN '*7' WHEN lower(url) LIKE '%/en/%' THEN '*/EN/*' WHEN regexp_matches(url, '/.8$') THEN '?8' ELSE '-' END AS excluded_by FROM pages",
    "window_texts": """WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS text, length(coalesce(text, '')) + 1 AS size, sum(length(coalesce(text, '')) + 1) OVER (PARTITION BY conv_id ORDER BY turn) AS until FROM conversations)
      SELECT t.conv_id, t.turn, length(string_agg(s.text, chr(10) ORDER BY s.turn)) AS n_chars, sha256(string_agg(s.text, chr(10) ORDER BY s.turn)) AS sha256
      FROM c t JOIN c s ON s.conv_id = t.conv_id AND s.turn <= t.turn AND (s.turn = t.turn OR t.until - s.until + s.size <= 600) GROUP BY ALL""",
    "span_check": DOCS + "SELECT doc_id, line_no, s AS span_start, line[s + 1:e] = text AS verbatim FROM judged JOIN lines USING (doc_id, line_no)",
    "name_contexts": DOCS + "SELECT key AS name, first(line[greatest(s - 80, 0) + 1:s] || '[[' || line[s + 1:e] || ']]' || line[e + 1:e + 80] ORDER BY doc_id, line_no, s) AS excerpt FROM judged JOIN lines USING (doc_id, line_no) GROUP BY key",
}
ORACLE_SQL = {k: v.replace(")SELECT", ")\nSELECT") for k, v in ORACLE_SQL.items()}
