"""SQL that states the results of the queries of code diagnostics and rewriting."""

from __future__ import annotations

from glyphmill.functions import scalar as S
from glyphmill.functions import terms
from glyphmill.operators import lint, rewrite
from glyphmill.plans import catalog as catalog_plan
from glyphmill.plans import render as render_plan

_CODES = "(SELECT rec_id, CAST(pos AS INT) AS pos, code FROM (SELECT rec_id, unnest(examples) AS code, generate_subscripts(examples, 1) - 1 AS pos FROM pine_merged_entries) WHERE code IS NOT NULL)"


def _blank_sql(x: str) -> str:
    for quote in ('"', "''"):
        pattern = rf"'{quote}(?:[^{quote}\\]|\\.)*{quote}'"
        found = f"regexp_extract_all({x}, {pattern})[i]"
        x = f"array_to_string(list_transform(regexp_split_to_array({x}, {pattern}), lambda w, i: w || coalesce(left({found}, 1) || repeat(' ', length({found}) - 2) || left({found}, 1), '')), '')"
    return x


def _split_sql(x: str) -> str:
    return rf"regexp_split_to_array(regexp_replace({x}, '(\r\n|[\n\v\f\r])$', ''), '\r\n|[\n\v\f\r]')"


_LINES = f"""(SELECT rec_id, pos, line_no, regexp_replace(l, '(?s)//.*$', '') AS clean, count(*) OVER (PARTITION BY rec_id, pos) AS n_lines
    FROM (SELECT rec_id, pos, unnest(ls) AS l, generate_subscripts(ls, 1) AS line_no FROM (SELECT rec_id, pos, {_split_sql(_blank_sql('code'))} AS ls FROM {_CODES} WHERE code <> '')))"""
_RAW = f"(SELECT rec_id, pos, unnest({_split_sql('code')}) AS raw, generate_subscripts({_split_sql('code')}, 1) AS line_no FROM {_CODES} WHERE code <> '')"
_DECLARED = "regexp_extract(clean, '^\\s*(?:var\\s+|varip\\s+)?(?:\\w+\\s+)?(\\w+)\\s*=(?:[^=>]|$)', 1)"
_MEANINGS = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in S.CODES.items())



def _strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


_HIT = "SELECT rec_id, pos, line_no, '{code}' AS code, '{text}' AS text, '{kind}' AS type FROM l WHERE {condition}"


def _hit(code: str, text: str, condition: str, kind: str = "error") -> str:
    return _HIT.format(code=code, text=text, kind=kind, condition=condition)


def _balance_sql(opening: str, closing: str, extra: str, lacking: str, word: str) -> str:
    """The sum of the signs falls below all before it where one closes that none opened; what stays above its least is open."""
    signs = f"(SELECT rec_id, pos, line_no, n_lines, unnest(g) AS g, generate_subscripts(g, 1) AS j FROM (SELECT *, regexp_extract_all(clean, '[{chr(92)}{opening}{chr(92)}{closing}]') AS g FROM l))"
    summed = f"(SELECT *, sum(CASE WHEN g = '{opening}' THEN 1 ELSE -1 END) OVER w AS s FROM {signs} WINDOW w AS (PARTITION BY rec_id, pos ORDER BY line_no, j))"
    least = f"(SELECT *, least(0, coalesce(min(s) OVER (PARTITION BY rec_id, pos ORDER BY line_no, j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS low FROM {summed})"
    return f"""SELECT rec_id, pos, line_no, '{extra}', 'No {word} was opened for this ''{closing}''', 'error' FROM {least} WHERE s < low
        UNION ALL SELECT rec_id, pos, max(n_lines), '{lacking}', CAST(arg_max(s, line_no * 1000000 + j) - least(0, min(s)) AS BIGINT) || ' of ''{opening}'' never closed by a {word}', 'error' FROM {summed} GROUP BY 1, 2 HAVING arg_max(s, line_no * 1000000 + j) > least(0, min(s))"""


_COLORS = ", ".join(f"'{c}'" for c in lint.OLD_COLORS)
_BARE_LIST = ", ".join(f"'{n}'" for n in lint.BARE_FUNCTIONS)
_LINT = rf"""l AS MATERIALIZED {_LINES}, w AS {_RAW}, d AS (SELECT rec_id, pos, {_DECLARED} AS name, min(line_no) AS first FROM l WHERE {_DECLARED} <> '' GROUP BY 1, 2, 3),
    h AS (SELECT rec_id, pos, bool_or(line_no <= 10 AND contains(raw, '//@version=6')) AS has, arg_min(struct_pack(n := line_no, v := regexp_extract(raw, '^\s*//@version=(\d)', 1)), line_no) FILTER (line_no <= 10 AND regexp_matches(raw, '^\s*//@version=\d')) AS other FROM w GROUP BY 1, 2),
    b AS (SELECT rec_id, pos, line_no, list_min(list_filter([{_BARE_LIST}], lambda n: regexp_matches(clean, '(^|[^\w.])' || n || '\s*[(]'))) AS name FROM l),
    a AS (SELECT rec_id, pos, string_agg(clean, chr(10) ORDER BY line_no) AS code FROM l GROUP BY 1, 2),
    u AS (SELECT l.rec_id, l.pos, l.line_no, regexp_extract(clean, '^\s*(\w+)\s*:=', 1) AS name FROM l WHERE regexp_matches(clean, '^\s*\w+\s*:=')),
    r AS (SELECT rec_id, pos, CASE WHEN other.v <> '6' THEN other.n ELSE 1 END AS line_no, 'LOCAL_VERSION' AS code, CASE WHEN other.v <> '6' THEN 'The code says version ' || other.v || ', not //@version=6' ELSE 'No //@version=6 in the first ten lines' END AS text, 'error' AS type FROM h WHERE NOT has
      UNION ALL SELECT rec_id, pos, min(line_no), 'LOCAL_V5_STUDY', 'study() is now called indicator()', 'error' FROM l WHERE regexp_matches(clean, '\bstudy\s*[(]') GROUP BY 1, 2
      UNION ALL SELECT rec_id, pos, line_no, 'LOCAL_V4_COLOR', 'The color ' || n || ' is now written color.' || n, 'error' FROM (SELECT *, regexp_extract(clean, '\bcolor\s*=\s*(\w+)', 1) AS n FROM l) WHERE n IN ({_COLORS})
      UNION ALL SELECT rec_id, pos, line_no, 'LOCAL_V4_COLOR', 'The color ' || n || ' is now written color.' || n, 'error' FROM (SELECT *, regexp_extract(clean, '\bbgcolor\s*[(]\s*(\w+)', 1) AS n FROM l) WHERE n IN ({_COLORS})
      UNION ALL {_balance_sql('(', ')', 'CE10016', 'CE10015', 'parenthesis')} UNION ALL {_balance_sql('[', ']', 'LOCAL_BRACKET', 'LOCAL_BRACKET', 'bracket')}
      UNION ALL SELECT u.rec_id, u.pos, u.line_no, 'LOCAL_REASSIGN', u.name || ' gets a value by := before its declaration by =', 'error' FROM u LEFT JOIN d ON d.rec_id = u.rec_id AND d.pos = u.pos AND d.name = u.name WHERE d.first IS NULL OR d.first > u.line_no
      UNION ALL {_hit('LOCAL_NA_CMP', 'Nothing equals na; ask na(x)', r"regexp_matches(clean, '==\s*na\b|\bna\s*==')")} UNION ALL {_hit('', 'Everything differs from na; ask not na(x)', r"regexp_matches(clean, '!=\s*na\b|\bna\s*!=')")}
      UNION ALL {_hit('', 'array.get() fails beyond array.size()', r"regexp_matches(clean, 'array[.]get\s*[(]')", 'warning')}
      UNION ALL {_hit('', 'varip without an input() may not keep what it holds', r"regexp_extract(clean, '^\s*varip\s+\w+\s*=\s*(.+)', 1) <> '' AND NOT contains(regexp_extract(clean, '^\s*varip\s+\w+\s*=\s*(.+)', 1), 'input(')", 'warning')}
      UNION ALL SELECT rec_id, pos, 0, '', 'Strategy calls need a strategy() declaration', 'error' FROM a WHERE regexp_matches(code, '\bstrategy[.](entry|exit|close|order|cancel)') AND NOT regexp_matches(code, '\bstrategy\s*[(]')
      UNION ALL {_hit('', 'The argument transp is gone; color.new() takes the transparency', r"regexp_matches(clean, ',\s*transp\s*=')", 'warning')}
      UNION ALL SELECT rec_id, pos, line_no, '', name || '() is now called ta.' || name || '()', 'error' FROM b WHERE name IS NOT NULL)"""

#: (name, pattern outside literals, pattern, replacement, times): RE2 knows no look-behind, so what stands before a call is kept, twice over.
_MIGRATION = [
    (None, rf"(^|[^.\w]){name}\b" if name in rewrite.VALUES else rf"(^|[^.\w]){name}\s*[(]", rf"\1{space}.{name}" + ("" if name in rewrite.VALUES else "("), 2)
    for space, names in rewrite.NAMESPACED.items()
    for name in names
]
_FIXES = [
    ("transp", r",\s*transp\s*=\s*\d+", "", 1), ("implicit_bool", r"\bif\s+(volume|close|open|high|low)(?:(\[\d+\])(\s*)([^<>=!\s]|$)|(\s*)([^<>=!\s\w]|$))", None, 1), ("bool_na", r"\bbool\s+(\w+)\s*=\s*na\b", r"var bool \1 = false", 1),
]
_PREFIX = ("prefix", rf"(^|[^.\w])({'|'.join(rewrite.BARE)})\s*[(]", r"\1ta.\2(", 2)
_STUDY = ("study", r"\bstudy\s*[(]", "indicator(", 1)


def _rewritten(fixes: list, rules: list) -> str:
    """CTEs s0, s1, …: one rule after the other, each where it matches outside literals."""
    steps = [f"s0 AS (SELECT rec_id, pos, code AS was, code, '' AS fixes FROM {_CODES})"]
    for at, (name, pattern, replacement, times) in enumerate([*fixes, *rules]):
        if replacement is None:  # the condition of an if without a comparison; an index is left behind the zero
            new, pattern = r"regexp_replace(code, '\bif\s+(volume|close|open|high|low)(\[|\b\s*$|\b\s*[^<>=!\s\w\[]|\b\s+\w)', 'if \1 > 0\2', 'g')", r"\bif\s+(volume|close|open|high|low)(\[|\b\s*$|\b\s*[^<>=!\s\w\[]|\b\s+\w)"
        else:
            new = "code"
            for _ in range(times):
                new = f"regexp_replace({new}, '{pattern}', '{replacement}', 'g')"
        fixed = f"CASE WHEN hit THEN fixes || CASE WHEN fixes = '' THEN '' ELSE ',' END || '{name}' ELSE fixes END" if name else "fixes"
        steps.append(f"s{at + 1} AS MATERIALIZED (SELECT rec_id, pos, was, CASE WHEN hit THEN {new} ELSE code END AS code, {fixed} AS fixes FROM (SELECT *, regexp_matches({_blank_sql('code')}, '{pattern}') AS hit FROM s{at}))")
    return ", ".join(steps)


_MESSAGES = r"""x AS (SELECT doc_id, regexp_extract_all(text, '\b(C[EW][0-9]{5}) @ ([0-9]{1,9}):([0-9]{1,9}) `([^`\n]*)`') AS ms FROM documents WHERE doc_kind = 'error_report'),
    m AS (SELECT doc_id, i, regexp_extract(e, '^C[EW][0-9]{5}') AS code, CAST(regexp_extract(e, '@ ([0-9]+):', 1) AS INT) AS line, CAST(regexp_extract(e, '@ [0-9]+:([0-9]+)', 1) AS INT) AS col, regexp_extract(e, '`([^`]*)`', 1) AS name, 'Could not find symbol ''' || regexp_extract(e, '`([^`]*)`', 1) || ''' in {scope}' AS text
      FROM (SELECT doc_id, unnest(ms) AS e, generate_subscripts(ms, 1) AS i FROM x))"""
_BEST = catalog_plan.ORACLE["best_version"].replace("SELECT name_key, row_no AS best_row, CASE", "SELECT name_key, row_no AS best_row, CASE", 1)
_ALIASES = ", ".join("({}, '{}', [{}])".format(i, p, ", ".join(f"'{n}'" for n in names)) for i, (p, names) in enumerate(terms.ALIASES))
_FAMILIES = ", ".join("({}, '{}', '{}')".format(i, n, p.replace(r"(?!\s*=)", r"\s*([^=\s]|$)").replace("(?!.*cci)", "")) for i, (n, p) in enumerate(terms.FAMILIES))

ORACLE: dict[str, str] = {
    "lint_counts": f"""WITH {_LINT} SELECT code, 'error' AS type, count(*) AS n, count(DISTINCT (rec_id, pos)) AS n_codes, CAST(sum(line_no) AS BIGINT) AS line_sum FROM r WHERE code IN ('LOCAL_VERSION', 'LOCAL_REASSIGN', 'LOCAL_NA_CMP', 'LOCAL_V4_COLOR') GROUP BY 1""",
    "lint_code": f"WITH {_LINT} SELECT rec_id, pos, CAST(line_no AS INT) AS line_no, code, text, type FROM r",
    "code_summary": f"""WITH w AS (SELECT rec_id, pos, CAST(count(*) AS INT) AS n_lines, CAST(count(*) FILTER (regexp_matches(raw, '^\\s*//')) AS INT) AS n_comments FROM {_RAW} GROUP BY 1, 2)
        SELECT rec_id, pos, any_value(w.n_lines) AS n_lines, count(*) FILTER (regexp_matches(clean, '\\bplot\\w*\\s*\\(')) AS n_plots, count(*) FILTER (regexp_matches(clean, '\\binput(\\.\\w+)?\\s*\\(')) AS n_inputs, count(*) FILTER (regexp_matches(clean, '^\\s*(var|varip)\\s')) AS n_vars,
        any_value(n_comments) AS n_comments, bool_or(regexp_matches(clean, '\\brequest\\.')) AS has_request, CASE WHEN bool_or(regexp_matches(clean, '\\bstrategy\\s*\\(')) THEN 'strategy' WHEN bool_or(regexp_matches(clean, '\\blibrary\\s*\\(')) THEN 'library'
        WHEN bool_or(regexp_matches(clean, '\\b(indicator|study)\\s*\\(')) THEN 'indicator' ELSE 'unknown' END AS script_type FROM {_LINES} l JOIN w USING (rec_id, pos) GROUP BY 1, 2""",
    "migrate_code": f"""WITH {_rewritten([], _MIGRATION)} SELECT rec_id, pos, md5(code) AS digest, code <> was AS changed FROM {{last}}""".format(last=f"s{len(_MIGRATION)}"),
    "repair_code": f"WITH {_rewritten(_FIXES, [])} SELECT rec_id, pos, md5(code) AS digest, fixes FROM s{len(_FIXES)}",
    "repair_calls": f"""WITH {_rewritten([_PREFIX, *_FIXES], [])} SELECT rec_id, pos, md5(code) AS digest, fixes || CASE WHEN contains(code, 'strategy.entry') AND NOT contains(code, 'strategy(') THEN CASE WHEN fixes = '' THEN '' ELSE ',' END || 'declaration' ELSE '' END AS fixes FROM s{len(_FIXES) + 1}""",
    "modernize_code": f"WITH {_rewritten([_FIXES[0], _FIXES[2], _FIXES[1], _STUDY], _MIGRATION)} SELECT rec_id, pos, md5(code) AS digest, fixes FROM s{4 + len(_MIGRATION)}",
    "without_when": f"SELECT rec_id, pos, 'strategy.entry(a, ' || code || ')' AS code FROM {_CODES} WHERE NOT contains(code, '(') AND NOT contains(code, ')') AND NOT contains(code, ',')",
    "compile_diagnostics": f"""WITH {_MESSAGES}, w AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY starts_with(code, 'CW'), i) - 1 AS INT) AS at, bool_and(starts_with(code, 'CW')) OVER (PARTITION BY doc_id) AS success, line, col AS "column", code, CASE WHEN starts_with(code, 'CW') THEN 'warning' ELSE 'error' END AS type, text FROM m)
        SELECT * FROM w UNION ALL SELECT doc_id, 0, false, 0, 0, '', 'error', 'no message' FROM x WHERE len(ms) = 0""",
    "filled_diagnostics": rf"""SELECT rec_id, pos, 'Undeclared identifier ''' || coalesce(nullif(regexp_extract(({_split_sql('code')})[1], '^[\p{{L}}\p{{N}}_.]*'), ''), 'value') || ''' of type other' AS text FROM {_CODES} WHERE code <> ''
        UNION ALL SELECT rec_id, pos, 'Undeclared {{kind}} ''{{identifier}}'' of {{argumentType}}{{typePostfix}} {{other}}' FROM {_CODES} WHERE code = ''""",
    "explained_errors": f"""WITH {_MESSAGES}, e AS ({render_plan.ORACLE['entry_details'].rsplit('SELECT row_no, md5', 1)[0]} SELECT row_no, array_to_string(regexp_split_to_array(detail, '\\r\\n|[\\n\\v\\f\\r]')[1:5], chr(10)) AS docs FROM d),
        b AS ({_BEST}), o AS (SELECT *, lower(regexp_extract(text, '''([a-zA-Z_][a-zA-Z0-9_.]*)''', 1)) AS name_key FROM m WHERE regexp_matches(text, '''([a-zA-Z_][a-zA-Z0-9_.]*)''')),
        f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY starts_with(code, 'CW'), i) AS n FROM o QUALIFY n <= 8),
        k AS (SELECT code, meaning FROM (VALUES {_MEANINGS}) t(code, meaning))
        SELECT doc_id, CAST(n AS INT) AS n, name_key, md5(concat_ws(chr(10), 'Line ' || line || ', Col ' || col || ' [' || f.code || ']', '  ' || text, '  Code: ' || meaning, '  Context: fullName=''' || name || ''', kind=''symbol''')) AS report, md5(docs) AS docs
        FROM f LEFT JOIN k USING (code) LEFT JOIN b USING (name_key) LEFT JOIN e ON e.row_no = b.best_row""",
    "fix_hints": """WITH p AS (SELECT row_number() OVER (ORDER BY namespace) AS o, lower(namespace) || '.' AS p FROM (SELECT DISTINCT namespace FROM discovery_index WHERE namespace <> '')),
        t AS (SELECT doc_id, text, arg_min(p, o) AS f, arg_min(p, struct_pack(l := -length(p), o := o)) AS l FROM documents JOIN p ON contains(lower(text), p) GROUP BY 1, 2),
        q AS (SELECT *, coalesce(nullif(regexp_extract(text, '''([a-zA-Z_][a-zA-Z0-9_.]*)''', 1), ''), 'value') AS quoted FROM t)
        SELECT doc_id, quoted || ': see the pages of ' || f AS first_hint, quoted || ': see the pages of ' || l AS longest_hint FROM q""",
    "query_aliases": f"""WITH docs AS (SELECT rec_id, concat_ws(' ', regexp_replace(name, '([a-z])([A-Z])', '\\1 \\2', 'g'), description) AS text FROM pine_merged_entries), a AS (SELECT * FROM (VALUES {_ALIASES}) t(i, pattern, names)), n AS (SELECT rec_id, i, unnest(names) AS name, generate_subscripts(names, 1) AS j FROM docs JOIN a ON regexp_matches(text, '(?i)' || pattern)),
        d AS (SELECT rec_id, name, min(i * 100 + j) AS spot FROM n GROUP BY 1, 2), x AS (SELECT rec_id, string_agg(name, ',' ORDER BY spot) AS names FROM d GROUP BY 1),
        f AS (SELECT rec_id, i, name FROM docs JOIN (VALUES {_FAMILIES}) t(i, name, pattern) ON CASE WHEN name = 'donchian' THEN regexp_matches(lower(text), '\\bdonchian\\b') OR len(list_filter(string_split(lower(text), chr(10)), lambda l: regexp_matches(l, '\\bchannel\\b') AND NOT contains(regexp_extract(l, '.*\\bchannel\\b(.*)', 1), 'cci'))) > 0 ELSE regexp_matches(lower(text), pattern) END),
        y AS (SELECT rec_id, string_agg(name, ',' ORDER BY i) AS families FROM f GROUP BY 1)
        SELECT rec_id, coalesce(names, '') AS names, coalesce(families, '') AS families FROM x FULL OUTER JOIN y USING (rec_id)""",
    "input_parameters": """WITH r AS (SELECT rec_id, list_filter(list_transform(parameters, lambda p: p.name), lambda n: n IS NOT NULL) AS names FROM pine_merged_entries), v AS (SELECT rec_id, names, names[len(names)] || 'Input' AS variable FROM r WHERE len(names) > 0),
        p AS (SELECT rec_id, variable, unnest(names) AS name, generate_subscripts(names, 1) AS spot, lower(variable) AS v FROM v),
        t AS (SELECT *, lower(name) AS n, CASE WHEN n = v THEN 1 WHEN length(n) < 3 THEN NULL WHEN suffix(v, n) THEN 2 WHEN prefix(v, n) THEN 3 WHEN contains(v, n) OR contains(n, v) THEN 4 END AS tier FROM p)
        SELECT rec_id, any_value(variable) AS variable, arg_min(name, tier * 1000000 + spot) FILTER (tier IS NOT NULL) AS parameter FROM t GROUP BY 1""",
    "input_lines": rf"""WITH p AS (SELECT rec_id, unnest(parameters) AS p, generate_subscripts(parameters, 1) - 1 AS pos FROM pine_merged_entries), a AS (SELECT rec_id, pos, {_strip_sql('p.name')} AS name, {_strip_sql('p."default"')} AS v, lower({_strip_sql('p.name')}) AS n FROM p WHERE trim(p.name) <> ''),
        t AS (SELECT *, CASE WHEN v IS NOT NULL THEN CASE WHEN starts_with(v, '"') OR starts_with(v, '''') THEN 'string' WHEN v IN {S.SERIES!r} THEN 'source' WHEN lower(v) IN ('true', 'false') THEN 'bool' WHEN NOT contains(v, '.') AND regexp_matches(v, '^\s*[+-]?[0-9]+(_[0-9]+)*\s*$') THEN 'int' ELSE 'float' END
          WHEN n IN {S.SERIES!r} THEN 'source' WHEN regexp_matches(n, 'length|period|len') THEN 'int' WHEN regexp_matches(n, 'source|src') THEN 'source' WHEN regexp_matches(n, 'mult|factor') THEN 'float' WHEN regexp_matches(n, 'color|colour') THEN 'color' WHEN regexp_matches(n, 'enable|use|show') THEN 'bool' ELSE 'float' END AS t FROM a),
        d AS (SELECT *, CASE WHEN v IS NOT NULL THEN CASE WHEN t = 'bool' THEN lower(v) ELSE v END WHEN n IN {S.SERIES!r} THEN n WHEN t = 'int' THEN '20' WHEN t = 'source' THEN 'close' WHEN t = 'float' AND regexp_matches(n, 'mult|factor') THEN '2.0' WHEN t = 'color' THEN 'color.blue' WHEN t = 'bool' THEN 'true' ELSE '1.0' END AS d, regexp_replace(regexp_replace(name, '[^A-Za-z0-9_]', '_', 'g'), '^_+|_+$', '', 'g') AS c FROM t)
        SELECT rec_id, CAST(pos AS INT) AS pos, CASE WHEN t IN ('source', 'color') THEN '' ELSE t || ' ' END || CASE WHEN c = '' THEN 'param' WHEN regexp_matches(c, '^[0-9]') THEN '_' || c ELSE c END || ' = input.' || t || '(' || d || ', "' || name || '")' AS line FROM d""",
    "hint_match": """SELECT row_no, min(symbol_id) AS first_match, arg_min(symbol_id, struct_pack(l := -length(builtin_symbols.name), o := symbol_id)) AS longest_match FROM catalog_records JOIN builtin_symbols ON contains(lower(raw_see_also), lower(builtin_symbols.name)) GROUP BY 1""",
    "sanitize_texts": r"""SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS text_digest, CASE WHEN l = '' THEN 'Script' ELSE substring(l, 1, 100) END AS literal,
        CAST(CASE WHEN length(p) > 200 THEN 203 ELSE length(p) END AS INT) AS redacted_chars
        FROM (SELECT doc_id, text, regexp_replace(regexp_replace(translate(text, '"\', '''/'), '[\x00-\x1f]', '', 'g'), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS l,
          regexp_replace(text, '(/[A-Za-z0-9_./ -]+|[A-Z]:\\[\\A-Za-z0-9_. -]+)', '[path]', 'g') AS p FROM documents WHERE text IS NOT NULL)""",
    "error_codes": f"""SELECT code, n, n_docs, coalesce(meaning, '') AS meaning FROM (SELECT code, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\\b(C[EW]\\d{{5}}) @ \\d+:\\d+', 1)) AS code FROM documents) GROUP BY 1) LEFT JOIN (VALUES {_MEANINGS}) m(code, meaning) USING (code)""",
    "error_symbols": """WITH n AS (SELECT doc_id, lower(coalesce(nullif(regexp_extract(h, '''([a-zA-Z_][a-zA-Z0-9_.]*)''', 1), ''), nullif(regexp_extract(h, '(?i)call\\s+[''"]?([a-zA-Z_][a-zA-Z0-9_.]*)', 1), ''), nullif(regexp_extract(h, '(?i)function\\s+[''"]?([a-zA-Z_][a-zA-Z0-9_.]*)', 1), ''))) AS name_key
          FROM (SELECT doc_id, replace(split_part(text, chr(10), 1), '`', '''') AS h FROM documents WHERE doc_kind = 'error_report')),
        b AS (SELECT lower(regexp_replace(name, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) AS name_key, row_no AS best_row FROM catalog_records WHERE name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lower(regexp_replace(name, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g'))
          ORDER BY CASE WHEN (contains(coalesce(syntax,''),'(') AND contains(coalesce(syntax,''),')')) OR coalesce(raw_parameters,'') <> '' THEN 1 WHEN coalesce(syntax,'') <> '' THEN 2 ELSE 3 END,
          CASE WHEN (contains(coalesce(syntax,''),'(') AND contains(coalesce(syntax,''),')')) OR coalesce(raw_parameters,'') <> '' OR coalesce(syntax,'') <> '' THEN 0 ELSE -length(coalesce(document,'')) END, row_no) = 1)
        SELECT doc_id, name_key, best_row FROM n LEFT JOIN b USING (name_key) WHERE name_key IS NOT NULL""",
}
