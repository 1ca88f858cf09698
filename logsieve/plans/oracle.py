"""DuckDB statements that state each query's result a second time, over line tables and windows.

Used by the correctness check only. The Spark side works inside a run's row; here every text is
unnested to lines and put together again with window functions and joins, so the two do not
share logic. They do share the constants: patterns, templates and rule texts.
"""

from __future__ import annotations

import re

from logsieve.functions import text as T
from logsieve.operators import detect as D
from logsieve.operators import extract as X
from logsieve.operators import rules as R
from logsieve.sources import templates as B
from logsieve.sources.runs import ANSI


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def hit(col: str, pattern: str) -> str:
    return f"regexp_matches({col}, {q(pattern)})"


def ext(col: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract({col}, {q(pattern)}, {group})"


def cap(col: str, pattern: str, group: int = 1) -> str:
    return f"nullif({ext(col, pattern, group)}, '')"


def num(col: str, pattern: str, group: int = 1) -> str:
    return f"try_cast({ext(col, pattern, group)} AS INTEGER)"


def trim(col: str) -> str:
    return f"trim({col}, {q(T.WHITE_SPACE)})"


def values(name: str, columns: str, rows: list) -> str:
    cells = ", ".join(
        "(" + ", ".join(q(v) if isinstance(v, str) else str(v) for v in row) + ")" for row in rows
    )
    return f"{name}({columns}) AS (VALUES {cells})"


def fill(body: str, tokens: dict[str, str]) -> str:
    for token, sql in tokens.items():
        body = f"replace({body}, '{{{token}}}', {sql})"
    return body


# ── derived inputs ───────────────────────────────────────────────────────────────────────

_TEXT = fill(
    "body",
    {
        "root": "'/repo/p' || (user_id % 12)",
        "doc": "user_id::VARCHAR",
        "n": "(1 + event_id % 40)::VARCHAR",
        "k": "coalesce(json_extract_string(props, '$.k'), '0')",
    },
)

INPUTS = [
    values("templates", "idx, command, body", [(i, c, t) for i, (c, t) in enumerate(B.TEMPLATES)]),
    f"""runs AS (SELECT event_id AS run_id, '/repo/p' || (user_id % 12) AS project_root, command,
      CASE WHEN body = '' THEN 0 ELSE 1 END AS exit_code,
      CASE WHEN event_id % 10 = 0 THEN '' ELSE {_TEXT} END AS stdout,
      CASE WHEN event_id % 10 = 0 THEN {_TEXT} WHEN event_id % 10 = 5 THEN 'Process exited with code 1' ELSE '' END AS stderr,
      value AS duration_ms, ts
      FROM events JOIN templates ON idx = event_id % {len(B.TEMPLATES)})""",
]


def texts(strip: bool = False) -> str:
    text = "concat_ws(chr(10), nullif(stdout, ''), nullif(stderr, ''))"
    if strip:
        text = f"regexp_replace({text}, {q(ANSI)}, '', 'g')"
    return f"texts AS (SELECT run_id, project_root, {text} AS text FROM runs)"


def line_table(name: str, source: str, column: str, keys: str) -> str:
    return f"""{name} AS (SELECT {keys}, unnest(string_split({column}, chr(10))) AS line,
      generate_subscripts(string_split({column}, chr(10)), 1) - 1 AS line_no FROM {source})"""


def format_case() -> str:
    t = "text"
    h = hit
    return f"""CASE WHEN {h(t, D.TSC_LINE)} THEN 'typescript'
      WHEN {h(t, D.RUST_CODE)} OR {h(t, D.RUST_PANIC)} OR {h(t, D.RUST_ARROW)} THEN 'rust'
      WHEN {h(t, D.GO_ROUTINE)} OR ({h(t, D.GO_PANIC)} AND {h(t, D.GO_FILE)}) OR {h(t, D.GO_TEST)} OR {h(t, D.GO_COMPILE)} THEN 'go'
      WHEN contains(text, {q(D.PY_TRACEBACK)}) OR {h(t, D.PY_FILE)} OR {h(t, D.PY_TEST)} THEN 'python'
      WHEN {h(t, D.JAVA_FRAME)} OR {h(t, D.JAVA_COMPILE)} OR contains(text, {q(D.JAVA_THREAD)}) THEN 'java'
      WHEN {h(t, D.VITEST_BANNER)} OR ({h(t, D.VITEST_ARROW)} AND {h(t, D.VITEST_COUNT)}) THEN 'vitest'
      WHEN {h(t, D.JEST_SUITES)} OR ({h(t, D.JEST_FAIL)} AND {h(t, D.JEST_COUNT)}) THEN 'jest'
      WHEN {h(t, D.ESLINT_SUMMARY)} OR {h(t, D.ESLINT_UNIX)} THEN 'eslint'
      WHEN {h(t, D.NPM_LINE)} THEN 'npm'
      WHEN ({h(t, D.BUILD_FAILED)} AND NOT {h('substr(text, 1, 100)', D.BUILD_TEST)}) OR ({h(t, D.BUILD_MISSING)} AND {h(t, D.BUILD_TOOL)}) THEN 'build'
      WHEN {h(t, D.NODE_ERROR)} OR {h(t, D.NODE_FRAME)} THEN 'node'
      ELSE 'unknown' END"""


FORMATS = f"formats AS (SELECT run_id, project_root, text, {format_case()} AS format FROM texts)"


def resolved(file: str, root: str = "project_root") -> str:
    joined = f"regexp_replace(regexp_replace({root} || '/' || {file}, '/\\./', '/', 'g'), '/\\./', '/', 'g')"
    for _ in range(4):
        joined = f"regexp_replace({joined}, '/[^/]+/\\.\\.(/|\\z)', '\\1')"
    return f"CASE WHEN starts_with({file}, '/') THEN {file} ELSE {joined} END"


def owned(file: str, root: str = "project_root") -> str:
    full = f"({resolved(file, root)})"
    return (
        f"coalesce({file} <> '' AND starts_with({full}, {root}) "
        f"AND NOT contains({full}, 'node_modules'), false)"
    )


def failure_cols(message, etype, raw, name="NULL::VARCHAR", file="NULL::VARCHAR") -> str:
    return (
        f"run_id, failure_idx, {name} AS test_name, {file} AS test_file, "
        f"{message} AS error_message, {etype} AS error_type, {raw} AS raw_output"
    )


def frame_cols(function, file, line, col="NULL::INTEGER", idx="0", keep=False) -> str:
    shown = file if keep else resolved(file)
    return (
        f"run_id, failure_idx, {idx} AS frame_idx, {function} AS function, {shown} AS file, "
        f"{line} AS line, {col} AS col, {owned(file)} AS is_project_file"
    )


def of_format(fmt: str) -> list[str]:
    return [
        f"mine AS (SELECT * FROM formats WHERE format = '{fmt}')",
        line_table("ml", "mine", "text", "run_id, project_root"),
    ]


NO_FRAMES = (
    "SELECT run_id, failure_idx, 0 AS frame_idx, ''::VARCHAR AS function, ''::VARCHAR AS file, "
    "0 AS line, 0 AS col, false AS is_project_file FROM fl WHERE false"
)


def nth(order: str = "line_no", part: str = "run_id") -> str:
    return f"row_number() OVER (PARTITION BY {part} ORDER BY {order}) - 1"


# Each entry: CTEs that end with ``fl`` (failures) and ``fr`` (frames) of one extractor.


def tsc() -> list[str]:
    place = f"'(' || {num('l', X.TSC, 2)} || ',' || {num('l', X.TSC, 3)} || '): error '"
    message = f"{ext('l', X.TSC, 4)} || ': ' || {ext('l', X.TSC, 5)}"
    return of_format("typescript") + [
        f"m AS (SELECT run_id, project_root, {trim('line')} AS l, {nth()} AS failure_idx FROM ml WHERE {hit(trim('line'), X.TSC)})",
        f"fl AS (SELECT {failure_cols(message, q('TypeError'), f'{ext('l', X.TSC, 1)} || {place} || {message}')} FROM m)",
        f"fr AS (SELECT {frame_cols('NULL::VARCHAR', ext('l', X.TSC, 1), num('l', X.TSC, 2), num('l', X.TSC, 3))} FROM m)",
    ]


def eslint_all(source: str = "ml") -> list[str]:
    t = trim("line")
    is_file = (
        f"{t} <> '' AND NOT {hit(t, X.ESLINT_ISSUE)} AND NOT {hit(t, X.ESLINT_TOTAL)} "
        f"AND {hit(t, X.ESLINT_FILE)} AND NOT contains({t}, '  ')"
    )
    p = X.ESLINT_ISSUE
    return [
        f"""marked AS (SELECT *, {is_file} AS is_file,
          last_value(CASE WHEN {is_file} THEN {t} END IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS cur FROM {source})""",
        f"""issues AS (SELECT run_id, project_root, line_no::INTEGER AS line_no, cur AS file, {num('line', p, 1)} AS line, {num('line', p, 2)} AS col,
          {ext('line', p, 3)} AS severity, {ext('line', p, 4)} AS message, {ext('line', p, 5)} AS rule
          FROM marked WHERE NOT is_file AND cur IS NOT NULL AND {hit('line', p)})""",
        """kept AS (SELECT * FROM issues QUALIFY CASE WHEN bool_or(severity = 'error') OVER (PARTITION BY run_id)
          THEN severity = 'error' ELSE row_number() OVER (PARTITION BY run_id ORDER BY line_no) <= 5 END)""",
    ]


def fixable() -> str:
    return "rule IN (" + ", ".join(q(r) for r in X.FIXABLE_RULES) + ")"


def eslint() -> list[str]:
    message = f"'[' || rule || '] ' || message || CASE WHEN {fixable()} THEN {q(X.FIXABLE_SUFFIX)} ELSE '' END"
    etype = "CASE WHEN severity = 'error' THEN 'ESLintError' ELSE 'ESLintWarning' END"
    raw = "file || ':' || line || ':' || col || ' ' || severity || ' ' || message || ' ' || rule"
    return of_format("eslint") + eslint_all() + [
        f"k AS (SELECT *, {nth()} AS failure_idx FROM kept)",
        f"fl AS (SELECT {failure_cols(message, etype, raw)} FROM k)",
        f"fr AS (SELECT {frame_cols('NULL::VARCHAR', 'file', 'line', 'col', keep=True)} FROM k)",
    ]


def npm() -> list[str]:
    t = X.NPM_TEXTS
    mp = t["missing_package"]
    package = f"coalesce({cap('text', X.NPM_PACKAGE)}, {q(mp[2])})"
    message = f"""CASE code
      WHEN 'E404' THEN {q(mp[0])} || {package} || {q(mp[1])}
      WHEN 'ERESOLVE' THEN CASE WHEN {hit('text', X.NPM_PEER.replace("(?>", "(?:"))} THEN {q(t['peer'][0])} || {ext('text', X.NPM_PEER.replace("(?>", "(?:"), 1)} || {q(t['peer'][1])} || {ext('text', X.NPM_PEER.replace("(?>", "(?:"), 2)} || {q(t['peer'][2])} ELSE {q(t['peer_unknown'])} END
      WHEN 'EACCES' THEN {q(t['access'])}
      WHEN 'ENOENT' THEN CASE WHEN {hit('text', X.NPM_SCRIPT)} THEN {q(t['script'][0])} || {ext('text', X.NPM_SCRIPT)} || {q(t['script'][1])} ELSE {q(t['no_entry'])} END
      WHEN 'EINTEGRITY' THEN {q(t['integrity'])} WHEN 'ETARGET' THEN {q(t['target'])}
      ELSE coalesce(note, {q(t['other'])} || code) END"""
    detail = f"""CASE code WHEN 'E404' THEN {ext('text', X.NPM_404)} WHEN 'ERESOLVE' THEN {q(t['peer_hint'])}
      WHEN 'EACCES' THEN {q(t['access_hint'])} WHEN 'EINTEGRITY' THEN {q(t['integrity_hint'])} WHEN 'ETARGET' THEN {q(t['target_hint'])} ELSE '' END"""
    note = trim(f"regexp_replace(line, {q(X.NPM_ANY + chr(92) + 's*')}, '')")
    return of_format("npm") + [
        f"""notes AS (SELECT run_id, arg_min(note, line_no) AS note FROM (SELECT run_id, line_no, {note} AS note FROM ml WHERE {hit('line', X.NPM_ANY)})
          WHERE note <> '' AND NOT starts_with(note, 'code') GROUP BY run_id)""",
        f"c AS (SELECT mine.*, {ext('text', X.NPM_CODE)} AS code, note FROM mine LEFT JOIN notes USING (run_id))",
        f"d AS (SELECT run_id, 0 AS failure_idx, text, code, {message} AS msg, {detail} AS det FROM c WHERE code <> '')",
        f"fl AS (SELECT {failure_cols(f'code || {q(': ')} || msg || CASE WHEN det <> {q('')} THEN {q(t['separator'])} || det ELSE {q('')} END', q('NpmError'), 'text')} FROM d)",
        f"fr AS ({NO_FRAMES})",
    ]


def _py_frame(idx: str) -> str:
    p = X.PY_FRAME
    return frame_cols(cap("line", p, 3), ext("line", p, 1), num("line", p, 2), idx=idx)


def python_blocks(source: str = "mine") -> list[str]:
    p = X.PY_ERROR
    return [
        f"""blocks AS (SELECT run_id, project_root, block, b FROM (SELECT run_id, project_root, unnest(string_split(text, {q(X.PY_MARK)})) AS block,
          generate_subscripts(string_split(text, {q(X.PY_MARK)}), 1) AS b FROM {source}) WHERE b > 1)""",
        line_table("bl", "blocks", "block", "run_id, project_root, b"),
        f"errs AS (SELECT run_id, b, arg_max({trim('line')}, line_no) AS err FROM bl WHERE {hit(trim('line'), p)} GROUP BY ALL)",
        f"bframes AS (SELECT * FROM bl WHERE {hit('line', X.PY_FRAME)})",
        """keptb AS (SELECT run_id, project_root, block, b, err, row_number() OVER (PARTITION BY run_id ORDER BY b) - 1 AS failure_idx
          FROM blocks LEFT JOIN errs USING (run_id, b)
          WHERE err IS NOT NULL OR EXISTS (SELECT 1 FROM bframes f WHERE f.run_id = blocks.run_id AND f.b = blocks.b))""",
        f"""tests AS (SELECT run_id, unnest(regexp_extract_all(text, {q(X.PY_TEST)}, 1)) AS tfile, unnest(regexp_extract_all(text, {q(X.PY_TEST)}, 2)) AS tname,
          unnest(regexp_extract_all(text, {q(X.PY_TEST)}, 3)) AS ttype, generate_subscripts(regexp_extract_all(text, {q(X.PY_TEST)}, 1), 1) - 1 AS k FROM {source})""",
    ]


def python_traced() -> list[str]:
    p = X.PY_ERROR
    return of_format("python") + python_blocks() + [
        f"""fl AS (SELECT keptb.run_id, failure_idx, tname AS test_name, tfile AS test_file, coalesce({cap('err', p, 2)}, 'Python error occurred') AS error_message,
          coalesce({cap('err', p, 1)}, 'Exception') AS error_type, {q(X.PY_MARK)} || block AS raw_output
          FROM keptb LEFT JOIN tests ON tests.run_id = keptb.run_id AND tests.k = keptb.failure_idx)""",
        f"fr AS (SELECT {_py_frame(nth(part='run_id, b'))} FROM bframes JOIN (SELECT run_id, b, failure_idx FROM keptb) USING (run_id, b))",
    ]


def python_alone() -> list[str]:
    p = X.PY_ERROR
    return of_format("python") + python_blocks() + [
        "bare AS (SELECT * FROM mine WHERE run_id NOT IN (SELECT run_id FROM keptb))",
        f"pip AS (SELECT run_id, {ext('text', X.PY_PIP)} AS msg, text FROM bare WHERE {hit('text', X.PY_PIP)})",
        f"""firsts AS (SELECT run_id, project_root, min(line_no) AS pos, arg_min({trim('line')}, line_no) AS err FROM ml
          WHERE run_id IN (SELECT run_id FROM bare) AND run_id NOT IN (SELECT run_id FROM pip) AND {hit(trim('line'), p)} GROUP BY ALL)""",
        f"""fl AS (SELECT run_id, 0 AS failure_idx, NULL::VARCHAR AS test_name, NULL::VARCHAR AS test_file, msg AS error_message, 'PipError' AS error_type, text AS raw_output FROM pip
          UNION ALL SELECT run_id, 0, NULL, NULL, {ext('err', p, 2)}, {ext('err', p, 1)}, text FROM firsts JOIN mine USING (run_id)
          UNION ALL SELECT run_id, k + CASE WHEN pos IS NULL THEN 0 ELSE 1 END, tname, tfile, 'Test failed: ' || ttype, ttype, text
            FROM tests JOIN mine USING (run_id) LEFT JOIN (SELECT run_id, pos FROM firsts) USING (run_id) WHERE run_id IN (SELECT run_id FROM bare) AND run_id NOT IN (SELECT run_id FROM pip))""",
        f"""fr AS (SELECT {_py_frame(nth())} FROM (SELECT ml.*, 0 AS failure_idx FROM ml JOIN (SELECT run_id, pos FROM firsts) f USING (run_id)
          WHERE line_no BETWEEN pos - 3 AND pos - 1 AND {hit('line', X.PY_FRAME)}))""",
    ]


def java_compile() -> list[str]:
    a, m = X.JAVAC, X.MAVEN

    def pick(x: str, y: str) -> str:
        return f"CASE WHEN {hit('line', a)} THEN {x} ELSE {y} END"

    return of_format("java") + [
        f"m AS (SELECT *, {nth()} AS failure_idx, {pick(ext('line', a, 1), ext('line', m, 1))} AS file FROM ml WHERE {hit('line', a)} OR {hit('line', m)})",
        f"fl AS (SELECT {failure_cols(pick(ext('line', a, 3), ext('line', m, 4)), q('CompilerError'), 'line')} FROM m)",
        f"fr AS (SELECT {frame_cols('NULL::VARCHAR', 'file', pick(num('line', a, 2), num('line', m, 2)), pick('NULL', num('line', m, 3)))} FROM m)",
    ]


def java_heads(source: str = "ml") -> str:
    head = f"({hit('line', X.JAVA_HEAD)} AND NOT starts_with(line, ' '))"
    return f"jb AS (SELECT *, {head} AS head, sum({head}::INT) OVER (PARTITION BY run_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS block FROM {source})"


def java_traces() -> list[str]:
    p = X.JAVA_FRAME
    return of_format("java") + [
        f"compiled AS (SELECT DISTINCT run_id FROM ml WHERE {hit('line', X.JAVAC)} OR {hit('line', X.MAVEN)})",
        java_heads(),
        f"jl AS (SELECT *, block - 1 AS failure_idx FROM jb WHERE block > 0 AND (head OR {hit('line', p)}) AND run_id NOT IN (SELECT run_id FROM compiled))",
        "jraw AS (SELECT run_id, failure_idx, string_agg(line, chr(10) ORDER BY line_no) AS raw FROM jl GROUP BY ALL)",
        f"fl AS (SELECT {failure_cols(ext('line', X.JAVA_HEAD, 2), ext('line', X.JAVA_HEAD, 1), 'raw')} FROM jl JOIN jraw USING (run_id, failure_idx) WHERE head)",
        f"fr AS (SELECT {frame_cols(ext('line', p, 1), ext('line', p, 2), num('line', p, 3), idx=nth(part='run_id, failure_idx'))} FROM jl WHERE NOT head)",
    ]


def go_compile() -> list[str]:
    p = X.GO_COMPILE
    return of_format("go") + [
        f"m AS (SELECT *, {nth()} AS failure_idx FROM ml WHERE {hit('line', p)})",
        f"fl AS (SELECT {failure_cols(ext('line', p, 4), q('CompilerError'), 'line')} FROM m)",
        f"fr AS (SELECT {frame_cols('NULL::VARCHAR', ext('line', p, 1), num('line', p, 2), num('line', p, 3))} FROM m)",
    ]


_GO_BARE = f"gone AS (SELECT DISTINCT run_id FROM ml WHERE {hit('line', X.GO_COMPILE)})"
_GO_PANICS = (
    f"{hit('text', X.GO_PANIC)} AND {hit('text', X.GO_ROUTINE)} "
    "AND run_id NOT IN (SELECT run_id FROM gone)"
)


def go_panic() -> list[str]:
    f, s = X.GO_FUNC, X.GO_FRAME
    over = "OVER (PARTITION BY run_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return of_format("go") + [
        _GO_BARE,
        f"p AS (SELECT *, 0 AS failure_idx FROM mine WHERE {_GO_PANICS})",
        f"fl AS (SELECT {failure_cols(ext('text', X.GO_PANIC), q('panic'), 'text')} FROM p)",
        f"""gl AS (SELECT ml.*, 0 AS failure_idx, max(CASE WHEN {hit('line', f)} THEN line_no END) {over} AS fn_at,
          max(CASE WHEN {hit('line', s)} THEN line_no END) {over} AS st_at,
          last_value(CASE WHEN {hit('line', f)} THEN {ext('line', f)} END IGNORE NULLS) {over} AS fn FROM ml JOIN (SELECT run_id FROM p) USING (run_id))""",
        f"fr AS (SELECT {frame_cols('CASE WHEN fn_at > coalesce(st_at, -1) THEN fn END', ext('line', s, 1), num('line', s, 2), idx=nth())} FROM gl WHERE {hit('line', s)})",
    ]


def go_tests() -> list[str]:
    d = X.GO_DETAIL
    return of_format("go") + [
        _GO_BARE,
        f"t AS (SELECT run_id, project_root, text, unnest(regexp_extract_all(text, {q(X.GO_TEST)}, 1)) AS name, generate_subscripts(regexp_extract_all(text, {q(X.GO_TEST)}, 1), 1) - 1 AS failure_idx FROM mine WHERE run_id NOT IN (SELECT run_id FROM gone) AND NOT ({_GO_PANICS}))",
        "fst AS (SELECT t.run_id, failure_idx, min(line_no) AS a FROM t JOIN ml ON ml.run_id = t.run_id AND contains(line, '--- FAIL: ' || name) GROUP BY ALL)",
        f"""near AS (SELECT t.run_id, t.project_root, t.failure_idx, name, line, line_no FROM t JOIN fst USING (run_id, failure_idx)
          JOIN ml ON ml.run_id = t.run_id AND line_no BETWEEN a + 1 AND a + 9 WHERE {hit('line', d)})""",
        f"msgs AS (SELECT run_id, failure_idx, arg_min({ext('line', d, 3)}, line_no) AS msg FROM near GROUP BY ALL)",
        f"fl AS (SELECT {failure_cols(f'coalesce(msg, {q('Test ')} || name || {q(' failed')})', q('TestFailure'), 'text', 'name')} FROM t LEFT JOIN msgs USING (run_id, failure_idx))",
        f"fr AS (SELECT {frame_cols('name', ext('line', d, 1), num('line', d, 2), idx=nth(part='run_id, failure_idx'))} FROM near)",
    ]


def rust_compile() -> list[str]:
    p, a = X.RUST_ERROR, X.RUST_ARROW
    code = cap("l", p, 1)
    return of_format("rust") + [
        f"m AS (SELECT run_id, project_root, line_no, {trim('line')} AS l, {nth()} AS failure_idx FROM ml WHERE {hit(trim('line'), p)})",
        f"""loc AS (SELECT m.run_id, m.project_root, failure_idx, arg_min(line, ml.line_no) AS line FROM m JOIN ml ON ml.run_id = m.run_id
          AND ml.line_no BETWEEN m.line_no + 1 AND m.line_no + 4 AND {hit('line', a)} GROUP BY ALL)""",
        """raws AS (SELECT m.run_id, failure_idx, string_agg(line, chr(10) ORDER BY ml.line_no) AS raw FROM m JOIN ml ON ml.run_id = m.run_id
          AND ml.line_no BETWEEN m.line_no AND m.line_no + 9 GROUP BY ALL)""",
        f"fl AS (SELECT {failure_cols(f'coalesce({q('E')} || {code} || {q(': ')}, {q('')}) || {ext('l', p, 2)}', f'coalesce({q('RustError[E')} || {code} || {q(']')}, {q('RustError')})', 'raw')} FROM m JOIN raws USING (run_id, failure_idx))",
        f"fr AS (SELECT {frame_cols('NULL::VARCHAR', ext('line', a, 1), num('line', a, 2), num('line', a, 3))} FROM loc WHERE {num('line', a, 2)} <> 0)",
    ]


def rust_panic() -> list[str]:
    p = X.RUST_PANIC
    said = cap("text", p, 2)
    thread = ext("text", p, 1)
    return of_format("rust") + [
        f"coded AS (SELECT DISTINCT run_id FROM ml WHERE {hit(trim('line'), X.RUST_ERROR)})",
        f"det AS (SELECT run_id, string_agg({trim('line')}, '; ' ORDER BY line_no) AS det FROM ml WHERE {hit('line', X.RUST_DETAIL)} GROUP BY run_id)",
        f"m AS (SELECT *, 0 AS failure_idx FROM mine LEFT JOIN det USING (run_id) WHERE {hit('text', p)} AND run_id NOT IN (SELECT run_id FROM coded))",
        f"""fl AS (SELECT {failure_cols(f"coalesce(CASE WHEN {said} IS NULL OR {hit('text', X.RUST_ASSERT)} THEN coalesce(nullif(det, ''), {said}) ELSE {said} END, 'panic in thread ''' || {thread} || '''')", q('panic'), 'text', cap('text', X.RUST_TEST))} FROM m)""",
        f"fr AS (SELECT {frame_cols(f'nullif({thread}, {q('main')})', ext('text', p, 3), num('text', p, 4), num('text', p, 5))} FROM m)",
    ]


def generic_blocks(source: str) -> list[str]:
    cuts = [
        (1, f"regexp_replace(text, '\\b(FAIL\\s)', chr(1) || '\\1', 'g')", r"\AFAIL\s"),
        (2, "regexp_replace(text, '([\\n\\r])(\\w*Error:)', '\\1' || chr(1) || '\\2', 'g')", r"\A\w*Error:"),
        (3, "regexp_replace(text, '([✕×✗]\\s)', chr(1) || '\\1', 'g')", r"\A[✕×✗]\s"),
    ]
    tried = " UNION ALL ".join(
        f"SELECT run_id, project_root, {n} AS strategy, list_filter(string_split({cut}, chr(1)), lambda x: x <> '') AS parts, {q(head)} AS head FROM {source}"
        for n, cut, head in cuts
    )
    return [
        f"tried AS ({tried} UNION ALL SELECT run_id, project_root, 4, [text, ''], '' FROM {source} WHERE {trim('text')} <> '')",
        f"""chosen AS (SELECT * FROM tried WHERE len(parts) > 1 AND run_id IN (SELECT run_id FROM {source} WHERE {trim('text')} <> '')
          QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY strategy) = 1)""",
        """pieces AS (SELECT run_id, project_root, strategy, head, unnest(parts) AS block, generate_subscripts(parts, 1) AS i FROM chosen)""",
        """blocks AS (SELECT run_id, project_root, strategy, block, row_number() OVER (PARTITION BY run_id ORDER BY i) - 1 AS failure_idx
          FROM pieces WHERE CASE WHEN strategy = 4 THEN i = 1 ELSE regexp_matches(block, head) END)""",
        line_table("bl", "blocks", "block", "run_id, project_root, failure_idx"),
        f"""einfo AS (SELECT run_id, failure_idx, min_by(l, line_no) FILTER (WHERE is_err) AS err, min_by(l, line_no) FILTER (WHERE l <> '') AS first_line
          FROM (SELECT run_id, failure_idx, line_no, {trim('line')} AS l, {hit(trim('line'), X.ASSERTION)} OR {hit(trim('line'), X.ERROR_LINE)} AS is_err FROM bl) GROUP BY ALL)""",
    ]


def error_message() -> str:
    return f"coalesce({cap('err', X.ASSERTION, 2)}, {cap('err', X.ERROR_LINE, 2)}, first_line, 'Unknown error')"


def error_type() -> str:
    return f"coalesce({cap('err', X.ASSERTION, 1)}, {cap('err', X.ERROR_LINE, 1)})"


def generic_frames() -> list[str]:
    shapes = [(X.STACK_FRAME, 1), (X.ARROW_FRAME, 1), (X.FILE_NOTE, 0)]

    def pick(part) -> str:
        return "CASE " + " ".join(f"WHEN {hit('line', p)} THEN {part(p, s)}" for p, s in shapes) + " END"

    return [
        f"""gf AS (SELECT run_id, project_root, failure_idx, line_no, {pick(lambda p, s: cap('line', p, 1) if s else 'NULL')} AS fn,
          {pick(lambda p, s: ext('line', p, 1 + s))} AS file, {pick(lambda p, s: num('line', p, 2 + s))} AS ln, {pick(lambda p, s: num('line', p, 3 + s))} AS cn
          FROM bl WHERE {' OR '.join(hit('line', p) for p, _ in shapes)})""",
        f"fr AS (SELECT {frame_cols('fn', 'file', 'ln', 'cn', idx=nth(part='run_id, failure_idx'), keep=True)} FROM gf)",
    ]


def generic(source: str = "mine") -> list[str]:
    return generic_blocks(source) + [
        f"fl AS (SELECT {failure_cols(error_message(), error_type(), 'block', cap('block', X.TEST_NAME), cap('block', X.TEST_FILE))} FROM blocks JOIN einfo USING (run_id, failure_idx))",
        *generic_frames(),
    ]


EXTRACTORS = {
    "extract_tsc": tsc, "extract_eslint": eslint, "extract_npm": npm,
    "extract_python": python_traced, "python_standalone": python_alone,
    "extract_java_compile": java_compile, "extract_java_exceptions": java_traces,
    "extract_go_compile": go_compile, "extract_go_panic": go_panic, "extract_go_tests": go_tests,
    "extract_rust_compile": rust_compile, "extract_rust_panic": rust_panic,
}

def all_failures(dispatch: bool = True) -> list[str]:
    """CTEs up to ``failures`` and ``frames`` of every run."""
    base = [*INPUTS, texts(strip=not dispatch)]
    if not dispatch:
        return base + generic("texts") + [
            "failures AS (SELECT * FROM fl)", "frames AS (SELECT * FROM fr)",
        ]
    parts, fls, frs = [], [], []
    for i, build in enumerate(EXTRACTORS.values()):
        inner = ", ".join(build())
        parts += [
            f"fl_{i} AS (WITH {inner} SELECT * FROM fl)",
            f"fr_{i} AS (WITH {inner} SELECT * FROM fr)",
        ]
        fls.append(f"SELECT * FROM fl_{i}")
        frs.append(f"SELECT * FROM fr_{i}")
    rest = ["mine AS (SELECT * FROM formats WHERE format IN ('vitest', 'jest', 'build', 'node', 'unknown'))", *generic()]
    inner = ", ".join(rest)
    parts += [f"fl_g AS (WITH {inner} SELECT * FROM fl)", f"fr_g AS (WITH {inner} SELECT * FROM fr)"]
    return base + [FORMATS] + parts + [
        "failures AS (" + " UNION ALL ".join([*fls, "SELECT * FROM fl_g"]) + ")",
        "frames AS (" + " UNION ALL ".join([*frs, "SELECT * FROM fr_g"]) + ")",
    ]


def statement(ctes: list[str], body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


FRAME_TEXT = (
    "(SELECT run_id, failure_idx, string_agg(concat_ws('|', coalesce(function, '-'), file, line::VARCHAR, "
    "coalesce(col::VARCHAR, '-'), is_project_file::VARCHAR), ';' ORDER BY frame_idx) AS stack FROM {fr} GROUP BY ALL)"
)


def with_stack(fl: str, fr: str) -> str:
    return (
        f"SELECT run_id, failure_idx::INTEGER AS failure_idx, test_name, test_file, error_message, error_type, raw_output, "
        f"coalesce(stack, '') AS stack FROM {fl} LEFT JOIN {FRAME_TEXT.format(fr=fr)} USING (run_id, failure_idx)"
    )


# ── rules ────────────────────────────────────────────────────────────────────────────────


def _condition(test, fields: dict[str, str]) -> str:
    alternatives = []
    for alternative in test:
        parts = []
        for name, pattern in alternative:
            if name == "line":
                parts.append("coalesce(p_line <> 0, false)")
            elif name.startswith("!"):
                parts.append(f"NOT {hit(fields[name[1:]], pattern)}")
            else:
                parts.append(hit(fields[name], pattern))
        alternatives.append("(" + " AND ".join(parts) + ")")
    return "(" + " OR ".join(alternatives) + ")"


def matches() -> list[str]:
    fields = {"m": "error_message", "t": "coalesce(error_type, '')", "raw": "raw_output"}
    tried = ", ".join(
        f"CASE WHEN {_condition(r.test, fields)} THEN {r.rank} END" for r in R.RULES
    )
    return [
        values("rule_dim", "rule_rank, category, confidence", [(r.rank, r.category, r.confidence) for r in R.RULES]),
        f"tested AS (SELECT run_id, failure_idx, error_message, unnest([{tried}]) AS rule_rank FROM failures)",
        "matches AS (SELECT run_id, failure_idx, rule_rank, category, confidence, error_message FROM tested JOIN rule_dim USING (rule_rank))",
        f"""deduped AS (SELECT * FROM matches QUALIFY row_number() OVER (PARTITION BY run_id, category, substr(error_message, 1, {R.KEY_LENGTH})
          ORDER BY failure_idx, rule_rank) = 1)""",
        f"""best AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC,
          failure_idx, rule_rank)::INTEGER AS hyp_idx FROM deduped QUALIFY hyp_idx <= {R.MAX_HYPOTHESES})""",
        f"""ranked AS (SELECT * FROM best UNION ALL SELECT run_id, failure_idx, {R.UNKNOWN_RANK}, 'unknown', 'low', error_message, 1
          FROM failures WHERE failure_idx = 0 AND run_id NOT IN (SELECT run_id FROM best))""",
    ]


def _render(template: str, cells: dict[str, str]) -> str:
    parts = re.split(r"\{(\w+)\}", template)
    out = [f"({cells[p]})" if k % 2 else q(p) for k, p in enumerate(parts) if k % 2 or p]
    return " || ".join(out) if out else "''"


def _text(text: R.Text, base: dict[str, str]) -> str:
    cells = dict(base)
    for name, (pattern, group, fallback) in text.captures.items():
        cells[name] = (
            f"CASE WHEN {hit(base['m'], pattern)} THEN {ext(base['m'], pattern, group)} "
            f"ELSE {_render(fallback, base)} END"
        )
    if "port" in cells:
        names = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in R.PORTS.items())
        cells["service"] = f"CASE {cells['port']} {names} END"
    if isinstance(text.template, str):
        return _render(text.template, cells)
    whens = " ".join(
        f"WHEN {_condition(test, cells)} THEN {_render(template, cells)}"
        for test, template in text.template
        if test is not None
    )
    default = next((_render(t, cells) for test, t in text.template if test is None), "NULL")
    return f"CASE {whens} ELSE {default} END"


def hypotheses() -> list[str]:
    loc = "CASE WHEN coalesce(p_line <> 0, false) THEN p_file || ':' || p_line ELSE coalesce(p_file, 'the source file') END"
    base = {
        "m": "error_message", "loc": loc, "file": "coalesce(p_file, 'the source file')",
        "line": "p_line::VARCHAR", "test": "coalesce(test_name, 'unknown')",
    }
    rules = [*R.RULES, R.UNKNOWN]
    explain = " ".join(f"WHEN {r.rank} THEN {_text(r.explain, base)}" for r in rules)
    fix = " ".join(f"WHEN {r.rank} THEN {_text(r.fix, base)}" for r in rules)
    shown = {
        "m": "error_message",
        "loc": f"error_message || ' | at ' || ({loc})",
        "file": f"error_message || ' | File: ' || {base['file']}",
        "test": f"error_message || ' | Test: ' || {base['test']}",
        "frames": "concat_ws(' | ', error_message, p_frames)",
    }
    evidence = " ".join(f"WHEN {r.rank} THEN {shown[r.evidence]}" for r in rules)
    return [
        """pfr AS (SELECT *, row_number() OVER (PARTITION BY run_id, failure_idx ORDER BY frame_idx) AS nth FROM frames WHERE is_project_file)""",
        """places AS (SELECT run_id, failure_idx, min_by(file, nth) AS p_file, min_by(line, nth) AS p_line,
          string_agg(coalesce(function, '?') || ' at ' || file || ':' || coalesce(line::VARCHAR, 'null'), ' | ' ORDER BY nth) FILTER (WHERE nth <= 5) AS p_frames FROM pfr GROUP BY ALL)""",
        f"""hypotheses AS (SELECT run_id, hyp_idx, category, confidence, CASE rule_rank {explain} END AS explanation,
          CASE rule_rank {evidence} END AS evidence, CASE rule_rank {fix} END AS suggested_fix, failure_idx::INTEGER AS failure_idx, rule_rank
          FROM ranked JOIN (SELECT run_id, failure_idx, test_name FROM failures) USING (run_id, failure_idx) LEFT JOIN places USING (run_id, failure_idx))""",
    ]


def language_case(file: str) -> str:
    pairs = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in T.LANGUAGES.items())
    return f"CASE lower({ext(file, '[^/](' + chr(92) + '.[^./]*)' + chr(92) + 'z')}) {pairs} ELSE 'text' END"


# ── statements ───────────────────────────────────────────────────────────────────────────

ORACLE: dict[str, str] = {}


def _declare_text_part() -> None:
    base = [*INPUTS, texts()]
    plain = [*INPUTS, texts(strip=True)]
    ORACLE["combine_output"] = statement(base, "SELECT run_id, text FROM texts")
    ORACLE["strip_ansi"] = statement(plain, "SELECT run_id, text FROM texts")
    ORACLE["explode_lines"] = statement(
        [*base, line_table("ll", "texts", "text", "run_id")],
        "SELECT run_id, line_no::INTEGER AS line_no, line FROM ll",
    )
    ORACLE["detect_format"] = statement([*base, FORMATS], "SELECT run_id, format FROM formats")
    for name, build in EXTRACTORS.items():
        ORACLE[name] = statement([*base, FORMATS, *build()], with_stack("fl", "fr"))
    ORACLE["tsc_summary"] = statement(
        base,
        f"SELECT run_id, {num('text', X.TSC_SUMMARY, 1)} AS total_errors, {num('text', X.TSC_SUMMARY, 2)} AS total_files FROM texts",
    )
    lint = [*base, FORMATS, *of_format("eslint"), *eslint_all()]
    cells = "run_id, line_no, file, line, col, severity, message, rule"
    ORACLE["eslint_severity_filter"] = statement(lint, f"SELECT {cells} FROM kept")
    ORACLE["eslint_autofixable"] = statement(lint, f"SELECT {cells}, {fixable()} AS auto_fixable FROM issues")
    ORACLE["pair_pytest"] = statement(
        [*base, FORMATS, *of_format("python"), *python_blocks()],
        f"""SELECT keptb.run_id, failure_idx::INTEGER AS k, {cap('err', X.PY_ERROR, 1)} AS error_type, {cap('err', X.PY_ERROR, 2)} AS error_message,
        tfile AS test_file, tname AS test_name FROM keptb LEFT JOIN tests ON tests.run_id = keptb.run_id AND tests.k = failure_idx""",
    )
    chain = [
        *base, FORMATS, *of_format("java"),
        f"hd AS (SELECT *, {hit('line', X.JAVA_CAUSE)} AS caused, row_number() OVER (PARTITION BY run_id ORDER BY line_no) AS hn FROM ml WHERE {hit('line', X.JAVA_HEAD)} AND NOT starts_with(line, ' '))",
        "bk AS (SELECT *, sum(CASE WHEN NOT caused OR hn = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY line_no) - 1 AS block_id FROM hd)",
        f"ch AS (SELECT run_id, block_id::INTEGER AS block_id, (row_number() OVER (PARTITION BY run_id, block_id ORDER BY line_no) - 1)::INTEGER AS chain_pos, {ext('line', X.JAVA_HEAD, 1)} AS error_type, {ext('line', X.JAVA_HEAD, 2)} AS error_message FROM bk)",
    ]
    ORACLE["java_exception_chain"] = statement(chain, "SELECT * FROM ch")
    ORACLE["java_root_causes"] = statement(
        chain, "SELECT * FROM ch QUALIFY chain_pos = max(chain_pos) OVER (PARTITION BY run_id, block_id)"
    )
    blocks = [*plain, *generic_blocks("texts")]
    ORACLE["split_failure_blocks"] = statement(
        blocks, "SELECT run_id, failure_idx::INTEGER AS failure_idx, strategy, block FROM blocks"
    )
    ORACLE["extract_error_info"] = statement(
        blocks,
        f"SELECT run_id, failure_idx::INTEGER AS failure_idx, {error_type()} AS error_type, {error_message()} AS error_message FROM einfo",
    )
    ORACLE["extract_test_info"] = statement(
        blocks,
        f"SELECT run_id, failure_idx::INTEGER AS failure_idx, {cap('block', X.TEST_NAME)} AS test_name, {cap('block', X.TEST_FILE)} AS test_file FROM blocks",
    )
    ORACLE["extract_frames"] = statement(
        [*blocks, *generic_frames()],
        "SELECT run_id, failure_idx::INTEGER AS failure_idx, frame_idx::INTEGER AS frame_idx, function, file, line, col, is_project_file FROM fr",
    )
    bar = hit("text", X.COUNTS_BAR)

    def count(a: int, b: int) -> str:
        return f"CASE WHEN {bar} THEN {num('text', X.COUNTS_BAR, a)} ELSE {num('text', X.COUNTS_TOTAL, b)} END"

    ORACLE["extract_test_counts"] = statement(
        plain,
        f"SELECT run_id, {count(3, 3)} AS total, {count(2, 2)} AS passed, {count(1, 1)} AS failed FROM texts",
    )
    ORACLE["parse_failures"] = statement(all_failures(False), with_stack("failures", "frames"))
    ORACLE["parse_errors"] = statement(all_failures(), with_stack("failures", "frames"))
    ORACLE["parse_long_logs"] = ORACLE["parse_errors"]
    ORACLE["assemble_runs"] = statement(
        all_failures(),
        "SELECT run_id, failure_idx::INTEGER AS failure_idx, test_name, test_file, error_message, error_type FROM failures",
    )
    ORACLE["read_log_lines"] = statement(
        [*base, line_table("ll", "texts", "text", "run_id, project_root")],
        """SELECT regexp_extract(project_root, '([0-9]+)$', 1)::INTEGER AS project,
        row_number() OVER (PARTITION BY project_root ORDER BY run_id, line_no) - 1 AS line_no, line FROM ll""",
    )
    ORACLE["parse_frames"] = statement(
        all_failures(),
        "SELECT run_id, failure_idx::INTEGER AS failure_idx, frame_idx::INTEGER AS frame_idx, function, file, line, col, is_project_file FROM frames",
    )
    ORACLE["normalise_frames"] = statement(
        all_failures(),
        f"""SELECT run_id, failure_idx::INTEGER AS failure_idx, frame_idx::INTEGER AS frame_idx, file, {resolved('file')} AS resolved_file,
        {owned('file')} AS in_project, {language_case('(' + resolved('file') + ')')} AS language
        FROM frames JOIN (SELECT run_id, project_root FROM runs) USING (run_id)""",
    )


def _declare_rule_part() -> None:
    base = [*all_failures(), *matches()]
    cells = "run_id, failure_idx::INTEGER AS failure_idx, rule_rank, category, confidence, error_message"
    ORACLE["match_rules"] = statement(base, f"SELECT {cells} FROM matches")
    ORACLE["dedupe_hypotheses"] = statement(base, f"SELECT {cells} FROM deduped")
    ORACLE["rank_hypotheses"] = statement(base, f"SELECT {cells}, hyp_idx FROM best")
    ORACLE["merge_hypotheses_stream"] = ORACLE["rank_hypotheses"]
    ORACLE["unknown_fallback"] = statement(base, f"SELECT {cells}, hyp_idx FROM ranked")
    full = statement([*base, *hypotheses()], "SELECT * FROM hypotheses")
    ORACLE["explain"] = full
    ORACLE["infer_root_causes"] = full
    ORACLE["infer_root_causes_command"] = statement(
        [*all_failures(False), *matches(), *hypotheses()], "SELECT * FROM hypotheses"
    )
    ORACLE["first_project_location"] = statement(
        all_failures(),
        """SELECT run_id, failure_idx::INTEGER AS failure_idx, file, line, CASE WHEN coalesce(line <> 0, false) THEN file || ':' || line ELSE file END AS location
        FROM frames WHERE is_project_file QUALIFY row_number() OVER (PARTITION BY run_id, failure_idx ORDER BY frame_idx) = 1""",
    )


_declare_text_part()
_declare_rule_part()


# ── other derived inputs ─────────────────────────────────────────────────────────────────

SOURCE_LINES = """source_lines AS (SELECT '/repo/p' || (doc_id % 12) AS project_root, '/repo/p' || (doc_id % 12) || '/src/f' || doc_id || '.ts' AS file,
  unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1)::INTEGER AS line_no FROM documents)"""

FILE_CHANGES = """file_changes AS (SELECT '/repo/p' || (o_custkey % 12) AS project_root, md5(o_orderkey::VARCHAR) AS commit_hash, o_orderdate AS commit_ts,
  o_orderpriority AS subject, CASE WHEN o_orderkey % 5 <> 0 THEN 'work/' || (o_orderkey % 7) END AS branch, 'src/f' || l_partkey || '.ts' AS path, l_linenumber AS change_no,
  'diff --git src/f' || l_partkey || '.ts' || chr(10) || '@@ -1,' || l_linenumber || ' +1 @@' || chr(10) || '-old ' || l_partkey || chr(10) || '+new' || chr(10)
    || repeat('c' || chr(10), (l_quantity * 4)::INTEGER) || '+end' AS diff FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

SEARCH_RESULTS = """search_results AS (SELECT event_id AS run_id, j // 3 AS query_idx, 'query ' || (j // 3) AS query, j % 3 AS result_idx,
  regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
  CASE page_id % 7 WHEN 1 THEN upper(url) WHEN 2 THEN regexp_replace(url, '(://[^/]+)', '\\1:8080') WHEN 3 THEN 'not a url ' || (page_id % 5) ELSE url END AS url,
  html AS content, (page_id * 37 % 100) / 100.0::DOUBLE AS score
  FROM events CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4, 5])::INTEGER AS j) JOIN pages ON page_id = user_id + j * 8)"""

RUN_STEPS = values("steps", "step_idx, step", list(enumerate(B.STEPS))) + """, run_steps AS (SELECT event_id AS run_id, step_idx, step,
  CASE WHEN (event_id + step_idx) % 7 < 4 THEN 'success' WHEN (event_id + step_idx) % 7 < 6 THEN 'skipped' ELSE 'failed' END AS status,
  floor(value + step_idx) AS duration_ms, CASE WHEN (event_id + step_idx) % 7 = 6 AND event_id % 2 = 0 THEN 'boom' END AS error FROM events CROSS JOIN steps)"""

_PROJECT_TOKENS = {"key": "c_custkey::VARCHAR", "name": "lower(c_name)", "segment": "lower(c_mktsegment)"}
PROJECT_FILES = (
    values("manifests", "idx, body", list(enumerate(B.MANIFESTS)))
    + ", "
    + values("placed", "modulus, rest, path, body", B.PROJECT_FILES)
    + f""", project_files AS (SELECT '/repo/p' || c_custkey AS project_root, 'package.json' AS path, {fill('body', _PROJECT_TOKENS)} AS content
  FROM customer JOIN manifests ON idx = c_custkey % {len(B.MANIFESTS)}
  UNION ALL SELECT '/repo/p' || c_custkey, path, {fill('body', _PROJECT_TOKENS)} FROM customer JOIN placed ON c_custkey % modulus = rest)"""
)

MODEL_REPLIES = (
    values("reply_texts", "idx, body", list(enumerate(B.REPLIES)))
    + f""", replies AS (SELECT event_id AS run_id, 'small' AS model, {fill('body', {'doc': 'user_id::VARCHAR'})} AS text
  FROM events JOIN reply_texts ON idx = event_id % {len(B.REPLIES)})"""
)


def locations() -> list[str]:
    """Ordered distinct locations and files, by window over one row per mention."""
    file = f"({resolved('f.file')})"
    test = f"({resolved('test_file')})"
    roots = "JOIN (SELECT run_id, project_root FROM runs) USING (run_id)"
    return [
        f"""mentions AS (SELECT run_id, failure_idx, 0 AS kind, frame_idx, {file} AS file, line FROM frames f {roots} WHERE is_project_file AND f.file <> ''
          UNION ALL SELECT run_id, failure_idx, 1, 0, {test}, 1 FROM failures {roots} WHERE test_file <> '')""",
        """located AS (SELECT run_id, file, line, (row_number() OVER (PARTITION BY run_id ORDER BY failure_idx, kind, frame_idx))::INTEGER AS loc_idx FROM
          (SELECT * FROM mentions WHERE line <> 0 QUALIFY row_number() OVER (PARTITION BY run_id, file, line ORDER BY failure_idx, kind, frame_idx) = 1))""",
        """related AS (SELECT run_id, file, (row_number() OVER (PARTITION BY run_id ORDER BY failure_idx, kind, frame_idx))::INTEGER AS file_idx FROM
          (SELECT * FROM mentions QUALIFY row_number() OVER (PARTITION BY run_id, file ORDER BY failure_idx, kind, frame_idx) = 1))""",
    ]


def snippets() -> list[str]:
    return [
        SOURCE_LINES,
        "sizes AS (SELECT file, max(line_no) AS n_lines, string_agg(text, '') AS whole FROM source_lines GROUP BY file)",
        """picked AS (SELECT run_id, l.file, line, n_lines, row_number() OVER (PARTITION BY run_id ORDER BY loc_idx) AS snippet_idx
          FROM located l JOIN sizes USING (file) WHERE NOT (n_lines = 1 AND whole = '') QUALIFY snippet_idx <= 10)""",
        f"""snips AS (SELECT run_id, snippet_idx::INTEGER AS snippet_idx, p.file, p.line AS focus_line, greatest(1, p.line - 15)::INTEGER AS start_line,
          least(n_lines, p.line + 15)::INTEGER AS end_line, coalesce(string_agg(s.text, chr(10) ORDER BY s.line_no), '') AS content, {language_case('p.file')} AS language
          FROM picked p LEFT JOIN source_lines s ON s.file = p.file AND s.line_no BETWEEN p.line - 15 AND p.line + 15 GROUP BY run_id, snippet_idx, p.file, p.line, n_lines)""",
    ]


def summaries(min_score: float = 0.3) -> list[str]:
    domain = f"coalesce(lower({cap('url', T.DOMAIN)}), url)"
    sentences = f"regexp_extract_all(content, {q(T.SENTENCE)})"
    first_two = f"CASE WHEN len({sentences}) = 0 THEN substr(content, 1, 200) ELSE {trim(f'array_to_string({sentences}[1:2], {q('')})')} END"
    return [
        SEARCH_RESULTS,
        f"""kept AS (SELECT *, {domain} AS domain FROM search_results WHERE score >= {min_score}
          QUALIFY row_number() OVER (PARTITION BY run_id, domain ORDER BY query_idx, result_idx) = 1)""",
        f"""listed AS (SELECT run_id, count(*) OVER (PARTITION BY run_id) AS n, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, query_idx, result_idx) AS rk,
          '- **[' || title || '](' || url || ')**: ' || {first_two} AS line FROM kept)""",
        """summed AS (SELECT run_id, max(n) AS n, string_agg(line, chr(10) ORDER BY rk) FILTER (WHERE rk <= 8) AS body FROM listed GROUP BY run_id)""",
        """summaries AS (SELECT run_id, coalesce(n, 0)::INTEGER AS n_sources, CASE WHEN s.run_id IS NULL THEN '' WHEN n IS NULL THEN 'Web search returned no highly relevant results.'
          ELSE 'Found ' || n || ' relevant source(s) across ' || n || ' domain(s):' || chr(10) || chr(10) || body END AS summary, s.run_id IS NOT NULL AS available
          FROM (SELECT run_id FROM runs) LEFT JOIN (SELECT DISTINCT run_id FROM search_results) s USING (run_id) LEFT JOIN summed USING (run_id))""",
    ]


def replies() -> list[str]:
    t = "regexp_replace(text, '\\A\\s+|\\s+\\z', '', 'g')"
    bare = f"CASE WHEN starts_with({t}, '{{') THEN {t} ELSE regexp_replace(regexp_replace({t}, '\\A```(?:json)?\\n?', ''), '\\n?```\\z', '') END"

    def part(name: str, default: str) -> str:
        return f"CASE WHEN ok THEN coalesce(json_extract_string(j, '$.{name}'), {q(default)}) END"

    return [
        MODEL_REPLIES,
        f"bare AS (SELECT run_id, model, {bare} AS b FROM replies)",
        "jr AS (SELECT run_id, model, json_valid(b) AS ok, CASE WHEN json_valid(b) THEN b END AS j FROM bare)",
        f"""enhanced AS (SELECT run_id, {part('rootCauseNarrative', 'Analysis unavailable')} AS narrative, {part('codeFix', '')} AS code_fix, {part('fixFile', '')} AS fix_file,
          {part('fixExplanation', '')} AS fix_explanation, CASE WHEN ok THEN CASE json_type(j, '$.fixAlternatives') WHEN 'ARRAY' THEN array_to_string(json_extract_string(j, '$.fixAlternatives[*]'), ' | ') ELSE coalesce(json_extract_string(j, '$.fixAlternatives'), '') END END AS alternatives,
          CASE WHEN ok THEN json_extract_string(j, '$.externalSynthesis') END AS external_synthesis, model, NOT ok AS failed FROM jr)""",
    ]


def condensed(dispatch: bool = True) -> list[str]:
    hint = "string_split(summary, chr(10))"
    external = (
        f"trim(list_filter({hint}, lambda l: starts_with(l, '-'))[1]) AS external_hint"
        if dispatch
        else "NULL::VARCHAR AS external_hint, narrative, code_fix, fix_file, fix_explanation, alternatives"
    )
    return [
        *all_failures(dispatch), *matches(), *hypotheses(), *locations(), *snippets(),
        *(summaries() if dispatch else replies()),
        """shown AS (SELECT run_id, file || ':' || coalesce(line::VARCHAR, 'null') AS file FROM frames WHERE failure_idx = 0
          QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY is_project_file DESC, frame_idx) = 1)""",
        f"""condensed AS (SELECT r.run_id, coalesce(f.error_message, 'No failures detected') AS error, shown.file, f.test_name, h.category, h.confidence, h.explanation, h.suggested_fix,
          '// ' || s.file || ' (lines ' || s.start_line || '-' || s.end_line || ')' || chr(10) || s.content AS code_context, {external}
          FROM runs r LEFT JOIN (SELECT * FROM failures WHERE failure_idx = 0) f USING (run_id) LEFT JOIN shown USING (run_id)
          LEFT JOIN (SELECT * FROM hypotheses WHERE hyp_idx = 1) h USING (run_id) LEFT JOIN (SELECT * FROM snips WHERE snippet_idx = 1) s USING (run_id)
          LEFT JOIN {'(SELECT * FROM summaries WHERE available) x' if dispatch else '(SELECT * FROM enhanced WHERE NOT failed) x'} USING (run_id))""",
    ]


def history() -> list[str]:
    return [
        FILE_CHANGES,
        """commits AS (SELECT project_root, commit_hash, commit_ts, min(subject) AS subject, min(branch) AS branch FROM file_changes GROUP BY ALL)""",
        """numbered AS (SELECT *, row_number() OVER (PARTITION BY project_root ORDER BY commit_ts DESC, commit_hash)::INTEGER AS rk FROM commits)""",
        """diffs AS (SELECT project_root, CASE WHEN len(d) > 5000 THEN substr(d, 1, 4997) || '...' ELSE d END AS diff FROM
          (SELECT project_root, string_agg(diff, chr(10) ORDER BY path, change_no) AS d FROM file_changes JOIN (SELECT project_root, commit_hash FROM numbered WHERE rk = 1) USING (project_root, commit_hash) GROUP BY project_root))""",
    ]


def inventory() -> list[str]:
    return [
        PROJECT_FILES,
        "roots AS (SELECT DISTINCT project_root FROM project_files)",
        "pkg AS (SELECT project_root, CASE WHEN json_valid(content) THEN content END AS j FROM project_files WHERE path = 'package.json')",
        "ts AS (SELECT project_root, CASE WHEN json_valid(content) THEN content END AS j FROM project_files WHERE path = 'tsconfig.json')",
        """based AS (SELECT project_root, bool_or(starts_with(path, 'src/')) AS has_src FROM project_files GROUP BY ALL)""",
        """segs AS (SELECT project_root, has_src, path, string_split(CASE WHEN has_src THEN substr(path, 5) ELSE path END, '/') AS p FROM project_files JOIN based USING (project_root)
          WHERE NOT has_src OR starts_with(path, 'src/'))""",
        """tree AS (SELECT DISTINCT project_root, CASE WHEN has_src THEN 'src/' ELSE '' END || array_to_string(p[1:d + 1], '/') AS path, d AS depth, d < len(p) - 1 AS is_dir,
          array_to_string(list_transform(p[1:d + 1], lambda s, i: CASE WHEN i < len(p) THEN '0' ELSE '1' END || lower(s) || chr(2) || s), chr(1)) AS key, p[d + 1] AS name
          FROM segs CROSS JOIN (SELECT unnest([0, 1, 2, 3])::INTEGER AS d)
          WHERE d < len(p) AND len(list_filter(p[1:d + 1], lambda s: starts_with(s, '.') OR s IN ('node_modules', 'dist', 'output', 'coverage'))) = 0)""",
    ]


def queries_of() -> list[str]:
    clean = trim(
        f"regexp_replace(regexp_replace(error_message, {q(T.PATH_IN_TEXT)}, '', 'g'), '\\s{{2,}}', ' ', 'g')"
    )

    def cut(value: str, limit: int = 120) -> str:
        return f"CASE WHEN len({value}) > {limit} THEN substr({value}, 1, {limit - 3}) || '...' ELSE {value} END"

    def library(column: str) -> str:
        whens = " ".join(f"WHEN contains(lower({column}), {q(w)}) THEN {q(w)}" for w in T.LIBRARIES)
        return f"CASE {whens} END"

    from logsieve.operators.external import PATTERN_QUERIES

    known = " ".join(
        f"WHEN {hit('error_message', p)}{' OR error_type = ' + q('AssertionError') if a.startswith('AssertionError') else ''} THEN {q(a)}"
        for p, a in PATTERN_QUERIES
    )
    fix = "coalesce(error_type || ': ', '') || clean || ' fix'"
    stack = "'\"' || error_type || '\" in \"' || fn || '\" typescript'"
    lib = f"lib || ' \"' || {cut('clean', 60)} || '\"'"
    word = f"CASE WHEN regexp_matches(test_file, '\\.spec\\.') THEN 'testing framework' ELSE coalesce({cap('lower(raw_output)', '(vitest|jest|mocha)')}, 'testing') END"
    frame = f"error_type || ' ' || {word} || ' troubleshooting'"
    return [
        """tops AS (SELECT run_id, failure_idx, function AS fn FROM frames WHERE is_project_file QUALIFY row_number() OVER (PARTITION BY run_id, failure_idx ORDER BY frame_idx) = 1)""",
        f"""ready AS (SELECT f.*, fn, {clean} AS clean, coalesce({library('error_message')}, {library('raw_output')}) AS lib FROM failures f LEFT JOIN tops USING (run_id, failure_idx))""",
        f"""asked AS (SELECT run_id, failure_idx, 1 AS c, CASE WHEN clean <> '' THEN {cut(fix)} END AS query FROM ready
          UNION ALL SELECT run_id, failure_idx, 2, {cut(stack)} FROM ready UNION ALL SELECT run_id, failure_idx, 3, {cut(lib)} FROM ready
          UNION ALL SELECT run_id, failure_idx, 4, CASE {known} END FROM ready UNION ALL SELECT run_id, failure_idx, 5, CASE WHEN test_file <> '' THEN {cut(frame)} END FROM ready)""",
        """once AS (SELECT run_id, query, failure_idx, c FROM asked WHERE query IS NOT NULL QUALIFY row_number() OVER (PARTITION BY run_id, query ORDER BY failure_idx, c) = 1)""",
        """questions AS (SELECT run_id, query, (row_number() OVER (PARTITION BY run_id ORDER BY failure_idx, c))::INTEGER AS query_idx FROM once QUALIFY query_idx <= 5)""",
    ]


def _declare_table_part() -> None:
    base = all_failures()
    where = [*base, *locations()]
    ORACLE["failure_locations"] = statement(where, "SELECT * FROM located")
    ORACLE["related_files"] = statement(where, "SELECT * FROM related")
    ORACLE["collect_snippets"] = statement([*where, *snippets()], "SELECT * FROM snips")
    ORACLE["mark_error_lines"] = statement(
        [*where, *snippets(),
         """numbered AS (SELECT run_id, snippet_idx, start_line + generate_subscripts(string_split(content, chr(10)), 1) - 1 AS line_no FROM snips)"""],
        """SELECT run_id, snippet_idx, line_no::INTEGER AS line_no, EXISTS (SELECT 1 FROM frames f WHERE f.run_id = n.run_id AND f.line = n.line_no AND f.is_project_file) AS is_error FROM numbered n""",
    )
    reason = "CASE WHEN line <= 0 THEN 'line must be positive' WHEN col <= 0 THEN 'column must be positive' END"
    ORACLE["validate_frames"] = statement(
        base,
        f"SELECT run_id, failure_idx::INTEGER AS failure_idx, frame_idx::INTEGER AS frame_idx, line, col, {reason} IS NULL AS valid, {reason} AS reason FROM frames",
    )
    names = ", ".join(q(c) for c in R.CATEGORIES)
    why = f"CASE WHEN category NOT IN ({names}) THEN 'unknown category' WHEN confidence NOT IN ('high', 'medium', 'low') THEN 'unknown confidence' END"
    ORACLE["validate_hypotheses"] = statement(
        [*base, *matches(), *hypotheses()],
        f"SELECT run_id, hyp_idx, category, confidence, {why} IS NULL AS valid, {why} AS reason FROM hypotheses",
    )
    found = [*INPUTS, *summaries()]
    ORACLE["dedupe_by_domain"] = statement(
        found, "SELECT run_id, query_idx, query, result_idx, title, url, score, domain FROM kept"
    )
    ORACLE["external_summary"] = statement(found, "SELECT * FROM summaries")
    ORACLE["dedupe_by_url"] = statement(
        [*INPUTS, SEARCH_RESULTS,
         "once AS (SELECT * FROM search_results QUALIFY row_number() OVER (PARTITION BY run_id, url ORDER BY query_idx, result_idx) = 1)"],
        """SELECT run_id, (row_number() OVER (PARTITION BY run_id ORDER BY query_idx, result_idx))::INTEGER AS rk, title, url, substr(content, 1, 200) AS preview FROM once QUALIFY rk <= 8""",
    )
    ORACLE["search_queries"] = statement([*base, *queries_of()], "SELECT * FROM questions")
    ORACLE["hot_files"] = statement(
        [*history(),
         "touched AS (SELECT DISTINCT project_root, path, rk FROM file_changes JOIN (SELECT project_root, commit_hash, rk FROM numbered WHERE rk <= 30) USING (project_root, commit_hash))",
         "counted AS (SELECT project_root, path, count(*) AS changes, min(rk) AS first_rk FROM touched GROUP BY ALL)"],
        "SELECT project_root, path, changes, (row_number() OVER (PARTITION BY project_root ORDER BY changes DESC, first_rk, path))::INTEGER AS rk FROM counted QUALIFY rk <= 10",
    )
    ORACLE["recent_commits"] = statement(history(), "SELECT project_root, rk, commit_hash AS hash, subject FROM numbered WHERE rk <= 10")
    ORACLE["latest_commit"] = statement(
        history(), "SELECT project_root, commit_hash AS hash, substr(commit_hash, 1, 8) AS short_hash, subject, branch FROM numbered WHERE rk = 1"
    )
    ORACLE["diff_for_project"] = statement(history(), "SELECT project_root, diff FROM diffs")
    ORACLE["diff_line_stats"] = statement(
        [*history(),
         "dl AS (SELECT project_root, unnest(string_split(diff, chr(10))) AS l, generate_subscripts(string_split(diff, chr(10)), 1) AS i FROM diffs)"],
        """SELECT project_root, count_if(i <= 500 AND starts_with(l, '+'))::INTEGER AS added, count_if(i <= 500 AND starts_with(l, '-'))::INTEGER AS removed,
        count_if(i <= 500 AND starts_with(l, '@@'))::INTEGER AS ranges, count_if(i <= 500 AND NOT regexp_matches(l, '^(\\+|-|@@)'))::INTEGER AS context, max(i) > 500 AS truncated FROM dl GROUP BY project_root""",
    )
    bar = hit("text", X.COUNTS_BAR)

    def count(a: int, b: int) -> str:
        return f"CASE WHEN {bar} THEN {num('text', X.COUNTS_BAR, a)} ELSE {num('text', X.COUNTS_TOTAL, b)} END"

    counts = [
        *INPUTS, texts(strip=True),
        f"counts AS (SELECT run_id, project_root, {count(3, 3)} AS total, coalesce({count(2, 2)}, 0) AS passed, coalesce({count(1, 1)}, 0) AS failed FROM texts)",
        "filled AS (SELECT run_id, project_root, passed, failed, coalesce(total, passed + failed) AS total FROM counts)",
    ]
    ratio = "CASE WHEN total > 0 THEN passed / total * 100 ELSE 0 END::DOUBLE AS ratio"
    ORACLE["test_pass_ratio"] = statement(counts, f"SELECT run_id, passed, failed, total, {ratio} FROM filled")
    ORACLE["pass_ratio_by_project"] = statement(
        [*counts, "s AS (SELECT project_root, sum(passed)::BIGINT AS passed, sum(failed)::BIGINT AS failed, sum(total)::BIGINT AS total FROM filled GROUP BY ALL)"],
        f"SELECT project_root, passed, failed, total, {ratio} FROM s",
    )
    label = "CASE status WHEN 'success' THEN 'OK' WHEN 'skipped' THEN 'SKIP' ELSE 'FAIL: ' || coalesce(error, 'unknown') END"
    ORACLE["step_summary"] = statement(
        [RUN_STEPS],
        f"SELECT run_id, step, {label} AS label, duration_ms, t.total_ms FROM run_steps JOIN (SELECT run_id, sum(duration_ms) AS total_ms FROM run_steps GROUP BY run_id) t USING (run_id)",
    )
    ORACLE["step_totals"] = statement(
        [RUN_STEPS], "SELECT step, status, count(*) AS runs, sum(duration_ms) AS duration_ms FROM run_steps GROUP BY ALL"
    )
    ORACLE["outcome_counts"] = statement(
        [*base, *matches()],
        """SELECT run_id, coalesce(nf, 0)::INTEGER AS n_failures, coalesce(nh, 0)::INTEGER AS n_hypotheses, CASE WHEN nf > 0 THEN 1 ELSE 0 END AS code FROM runs
        LEFT JOIN (SELECT run_id, count(*) AS nf FROM failures GROUP BY ALL) USING (run_id) LEFT JOIN (SELECT run_id, count(*) AS nh FROM ranked GROUP BY ALL) USING (run_id)""",
    )
    inv = inventory()
    dep = " UNION ALL ".join(
        f"SELECT project_root, unnest(json_keys(j, '$.{f}')) AS name, {d} AS is_dev, generate_subscripts(json_keys(j, '$.{f}'), 1)::INTEGER AS nth FROM pkg WHERE json_exists(j, '$.{f}')"
        for f, d in (("dependencies", "false"), ("devDependencies", "true"))
    )
    ORACLE["dependencies"] = statement(inv, dep)
    ORACLE["scripts"] = statement(
        [*inv, "names AS (SELECT project_root, j, unnest(json_keys(j, '$.scripts')) AS name, generate_subscripts(json_keys(j, '$.scripts'), 1)::INTEGER AS nth FROM pkg WHERE json_type(j, '$.scripts') = 'OBJECT')"],
        "SELECT project_root, name, json_extract_string(j, '$.scripts.\"' || name || '\"') AS command, nth FROM names",
    )
    js = "json_extract_string"
    ORACLE["manifest_facts"] = statement(
        inv,
        f"""SELECT project_root, coalesce({js}(j, '$.name'), 'unknown') AS name, coalesce({js}(j, '$.description'), '') AS description, coalesce({js}(j, '$.type'), 'commonjs') AS type,
        coalesce('Node.js ' || nullif({js}(j, '$.engines.node'), ''), 'Node.js') AS runtime FROM roots LEFT JOIN pkg USING (project_root)""",
    )
    o = "$.compilerOptions"
    ORACLE["compiler_options"] = statement(
        inv,
        f"""SELECT project_root, coalesce(json_extract(j, '{o}.strict')::VARCHAR, 'false') NOT IN ('false', 'null', '0', '-0', '0.0', '""') AS strict, coalesce({js}(j, '{o}.target'), 'unknown') AS target, coalesce({js}(j, '{o}.module'), 'unknown') AS module,
        coalesce(json_extract(j, '{o}.noUncheckedIndexedAccess')::VARCHAR, 'false') NOT IN ('false', 'null', '0', '-0', '0.0', '""') AS unchecked_index, json_extract(j, '{o}.paths')::VARCHAR AS paths FROM ts WHERE json_exists(j, '{o}')""",
    )
    ORACLE["env_vars"] = statement(
        [*inv,
         f"el AS (SELECT project_root, {trim('l')} AS l, i FROM (SELECT project_root, unnest(string_split(content, chr(10))) AS l, generate_subscripts(string_split(content, chr(10)), 1) AS i FROM project_files WHERE path = '.env.example'))"],
        """SELECT project_root, split_part(l, '=', 1) AS name, (row_number() OVER (PARTITION BY project_root ORDER BY i))::INTEGER AS nth FROM el
        WHERE l <> '' AND NOT starts_with(l, '#') AND contains(l, '=') AND NOT starts_with(l, '=')""",
    )
    ORACLE["test_framework"] = statement(
        inv,
        """SELECT project_root, CASE WHEN json_exists(j, '$.devDependencies.vitest') THEN 'vitest' WHEN json_exists(j, '$.devDependencies.jest') THEN 'jest'
        WHEN json_exists(j, '$.devDependencies.mocha') THEN 'mocha' WHEN json_exists(j, '$.devDependencies.ava') THEN 'ava' END AS framework FROM roots LEFT JOIN pkg USING (project_root)""",
    )
    ORACLE["project_language"] = statement(
        inv, "SELECT project_root, CASE WHEN bool_or(path = 'tsconfig.json') THEN 'TypeScript' ELSE 'JavaScript' END AS language FROM project_files GROUP BY ALL"
    )
    ORACLE["file_listing"] = statement(inv, "SELECT project_root, path, depth, is_dir FROM tree")
    from logsieve.operators.inventory import ENTRY_NAME, KNOWN_ENTRIES, TEST_NAME

    ORACLE["key_files"] = statement(
        [*inv,
         values("known_dim", "nth, path", list(enumerate(KNOWN_ENTRIES))),
         f"entries AS (SELECT project_root, name, 0 AS kind, key FROM tree WHERE {hit('name', ENTRY_NAME)})",
         f"tests AS (SELECT project_root, name, 1 AS kind, key FROM tree WHERE NOT is_dir AND {hit('name', TEST_NAME)} QUALIFY row_number() OVER (PARTITION BY project_root ORDER BY key) = 1)",
         "named AS (SELECT * FROM entries UNION ALL SELECT * FROM tests)",
         """everything AS (SELECT * FROM named UNION ALL SELECT p.project_root, p.path, 2, lpad(nth::VARCHAR, 2, '0') FROM project_files p JOIN known_dim USING (path)
           WHERE NOT EXISTS (SELECT 1 FROM named n WHERE n.project_root = p.project_root AND n.name = p.path))"""],
        "SELECT project_root, (row_number() OVER (PARTITION BY project_root ORDER BY kind, key))::INTEGER AS rk, name AS path FROM everything QUALIFY rk <= 5",
    )
    ORACLE["readme_excerpt"] = statement(
        inv,
        "SELECT project_root, substr(content, 1, 500) AS excerpt FROM project_files WHERE path IN ('README.md', 'readme.md') QUALIFY row_number() OVER (PARTITION BY project_root ORDER BY path) = 1",
    )
    ORACLE["parse_enhancements"] = statement(replies(), "SELECT * FROM enhanced")
    ORACLE["condense"] = statement(condensed(), "SELECT * FROM condensed")
    ORACLE["condense_command"] = statement(condensed(False), "SELECT * FROM condensed")


_declare_table_part()


def _declare_stream_part() -> None:
    base = [*all_failures(), *matches()]
    ORACLE["stream_classify"] = statement(
        base,
        """SELECT run_id, ts, format, hyp_idx, category, confidence, failure_idx::INTEGER AS failure_idx, rule_rank FROM ranked
        JOIN (SELECT run_id, ts FROM runs) USING (run_id) JOIN (SELECT run_id, format FROM formats) USING (run_id)""",
    )
    ORACLE["dedupe_failures_stream"] = statement(
        base, f"SELECT DISTINCT run_id, category, substr(error_message, 1, {R.KEY_LENGTH}) AS prefix FROM matches"
    )
    ORACLE["category_rate"] = statement(
        base,
        """SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, date_trunc('day', ts)::TIMESTAMP + INTERVAL 1 DAY AS window_end, category, count(*) AS n
        FROM ranked JOIN (SELECT run_id, ts FROM runs) USING (run_id) GROUP BY ALL""",
    )


_declare_stream_part()


# ── prompts and briefs ───────────────────────────────────────────────────────────────────

NL = "chr(10)"


def agg(expr: str, order: str, where: str = "") -> str:
    return f"string_agg({expr}, {NL} ORDER BY {order})" + (f" FILTER (WHERE {where})" if where else "")


def prompt_parts() -> list[str]:
    head = "file || ' (lines ' || start_line || '-' || end_line || ')'"
    error = "coalesce(nullif(error_type, '') || ': ', '') || error_message"
    return [
        *all_failures(), *matches(), *hypotheses(), *locations(), *snippets(), *summaries(), *history(),
        f"""ft AS (SELECT run_id, {agg(f"concat_ws({NL}, '---' || {NL}, 'ERROR: ' || {error}, CASE WHEN p_line <> 0 THEN 'FILE: ' || p_file || ':' || p_line END, 'TEST: ' || nullif(test_name, ''), '')", 'failure_idx')} AS failed
          FROM failures LEFT JOIN places USING (run_id, failure_idx) GROUP BY run_id)""",
        f"""ct AS (SELECT run_id, {agg(f"'[' || upper(confidence) || '] ' || replace(category, '_', ' ') || ': ' || explanation || {NL} || '  SUGGESTED FIX: ' || suggested_fix || {NL}", 'hyp_idx')} AS causes
          FROM hypotheses GROUP BY run_id)""",
        f"""st AS (SELECT run_id, {agg(f"'--- ' || {head} || ' ---' || {NL} || '```' || language || {NL} || content || {NL} || '```' || {NL}", 'snippet_idx', 'snippet_idx <= 3')} AS agent_code,
          string_agg('### ' || {head} || {NL} || '```' || language || {NL} || content || {NL} || '```', {NL} || {NL} ORDER BY snippet_idx) FILTER (WHERE snippet_idx <= 4) AS model_code
          FROM snips GROUP BY run_id)""",
        f"""pf AS (SELECT run_id, {agg("coalesce(function, '') || ' ' || file || ':' || coalesce(line::VARCHAR, 'null')", 'frame_idx')} AS stack
          FROM frames WHERE failure_idx = 0 AND is_project_file GROUP BY run_id)""",
        f"""ready AS (SELECT r.run_id, r.project_root, failed, causes, agent_code, model_code, stack, CASE WHEN available THEN nullif(summary, '') END AS external, nullif(diff, '') AS diff,
          {error} AS error, category, confidence, explanation, suggested_fix, p_file, p_line
          FROM runs r LEFT JOIN ft USING (run_id) LEFT JOIN ct USING (run_id) LEFT JOIN st USING (run_id) LEFT JOIN pf USING (run_id) LEFT JOIN summaries USING (run_id)
          LEFT JOIN diffs USING (project_root) LEFT JOIN (SELECT run_id, error_type, error_message FROM failures WHERE failure_idx = 0) f USING (run_id)
          LEFT JOIN (SELECT run_id, category, confidence, explanation, suggested_fix FROM hypotheses WHERE hyp_idx = 1) h USING (run_id)
          LEFT JOIN (SELECT run_id, p_file, p_line FROM places WHERE failure_idx = 0) p USING (run_id))""",
    ]


def briefs() -> list[str]:
    js = "json_extract_string"
    o = "$.compilerOptions"
    dep = "json_keys(j, '$.dependencies')"
    scripts = "json_keys(j, '$.scripts')"

    def flag(name: str) -> str:
        value = f"coalesce(json_extract(t.j, '{o}.{name}')::VARCHAR, 'false')"
        return f"CASE WHEN {value} IN ('false', 'null', '0', '-0', '0.0', '\"\"') THEN 'false' ELSE 'true' END"

    def block(title: str, body: str) -> str:
        return f"{q(title)} || {NL} || {body} || {NL}"

    options = " || ".join(
        [
            f"'- strict: ' || {flag('strict')} || {NL}",
            f"'- target: ' || coalesce({js}(t.j, '{o}.target'), 'unknown') || {NL}",
            f"'- module: ' || coalesce({js}(t.j, '{o}.module'), 'unknown') || {NL}",
            f"'- noUncheckedIndexedAccess: ' || {flag('noUncheckedIndexedAccess')}",
            f"coalesce({NL} || '- paths: ' || json_extract(t.j, '{o}.paths')::VARCHAR, '')",
        ]
    )
    framework = "CASE " + " ".join(
        f"WHEN json_exists(p.j, '$.devDependencies.{f}') THEN '{f}'" for f in ("vitest", "jest", "mocha", "ava")
    ) + " END"
    return [
        *inventory(), *history(),
        f"bd AS (SELECT project_root, {agg(chr(39) + '- ' + chr(39) + ' || name', 'i', 'i <= 20')} AS deps FROM (SELECT project_root, unnest({dep}) AS name, generate_subscripts({dep}, 1) AS i FROM pkg WHERE json_exists(j, '$.dependencies')) GROUP BY ALL)",
        f"""bs AS (SELECT project_root, {agg("'- `npm run ' || name || '`: ' || json_extract_string(j, '$.scripts." + chr(34) + "' || name || '" + chr(34) + "')", 'i', 'i <= 10')} AS scr
          FROM (SELECT project_root, j, unnest({scripts}) AS name, generate_subscripts({scripts}, 1) AS i FROM pkg WHERE json_type(j, '$.scripts') = 'OBJECT') GROUP BY project_root)""",
        f"bt AS (SELECT project_root, {agg('repeat(' + chr(39) + '  ' + chr(39) + ', depth) || name || CASE WHEN is_dir THEN ' + q('/') + ' ELSE ' + q('') + ' END', 'key')} AS structure FROM tree GROUP BY project_root)",
        f"""be AS (SELECT project_root, {agg("'- ' || split_part(l, '=', 1)", 'i')} AS env FROM (SELECT project_root, {trim('l')} AS l, i FROM
          (SELECT project_root, unnest(string_split(content, {NL})) AS l, generate_subscripts(string_split(content, {NL}), 1) AS i FROM project_files WHERE path = '.env.example'))
          WHERE l <> '' AND NOT starts_with(l, '#') AND contains(l, '=') AND NOT starts_with(l, '=') GROUP BY project_root)""",
        f"bc AS (SELECT project_root, {agg(chr(39) + '- ' + chr(39) + ' || substr(commit_hash, 1, 7) || ' + q(' ') + ' || subject', 'rk', 'rk <= 5')} AS commits FROM numbered GROUP BY project_root)",
        """bh0 AS (SELECT project_root, path, count(DISTINCT rk) AS changes, min(rk) AS first_rk FROM file_changes JOIN (SELECT project_root, commit_hash, rk FROM numbered WHERE rk <= 30)
          USING (project_root, commit_hash) GROUP BY ALL)""",
        f"""bh AS (SELECT project_root, {agg("'- ' || path || ' (' || changes || ' changes)'", 'rk', 'rk <= 5')} AS hot FROM
          (SELECT *, row_number() OVER (PARTITION BY project_root ORDER BY changes DESC, first_rk, path) AS rk FROM bh0) GROUP BY project_root)""",
        f"""briefs AS (SELECT r.project_root, concat_ws({NL}, '# Project Context' || {NL}, '## Overview', '- **Name**: ' || coalesce({js}(p.j, '$.name'), 'unknown'),
          '- **Description**: ' || nullif({js}(p.j, '$.description'), ''), '- **Language**: ' || CASE WHEN t.project_root IS NULL THEN 'JavaScript' ELSE 'TypeScript' END,
          '- **Module system**: ' || CASE WHEN {js}(p.j, '$.type') = 'module' THEN 'ESM' ELSE 'CommonJS' END,
          '- **Runtime**: ' || coalesce('Node.js ' || nullif({js}(p.j, '$.engines.node'), ''), 'Node.js'), '- **Test framework**: ' || {framework}, '',
          {block('## Dependencies', 'deps')}, CASE WHEN json_exists(t.j, '{o}') THEN {block('## TypeScript Configuration', options)} END,
          {block('## Project Structure', f"'```' || {NL} || structure || {NL} || '```'")}, {block('## Environment Variables', 'env')},
          CASE WHEN commits IS NOT NULL THEN {block('## Recent Git Activity', f"concat_ws({NL}, 'Branch: ' || branch, {NL} || 'Recent commits:' || {NL} || commits, {NL} || 'Most active files:' || {NL} || hot)")} END,
          {block('## Available Scripts', 'scr')}) AS text
          FROM roots r LEFT JOIN pkg p USING (project_root) LEFT JOIN ts t USING (project_root) LEFT JOIN bd USING (project_root) LEFT JOIN bs USING (project_root) LEFT JOIN bt USING (project_root)
          LEFT JOIN be USING (project_root) LEFT JOIN bc USING (project_root) LEFT JOIN bh USING (project_root) LEFT JOIN (SELECT project_root, branch FROM numbered WHERE rk = 1) USING (project_root))""",
    ]


def _declare_prompt_part() -> None:
    ORACLE["project_briefs"] = statement(briefs(), "SELECT project_root, text FROM briefs")
    parts = prompt_parts()
    ORACLE["agent_prompts"] = statement(
        parts,
        f"""SELECT run_id, concat_ws({NL}, 'You are debugging a test failure. Here is the structured analysis:' || {NL}, failed, 'ROOT CAUSE ANALYSIS:' || {NL} || {NL} || causes,
        'RELEVANT CODE:' || {NL} || {NL} || agent_code, 'EXTERNAL CONTEXT (from web search):' || {NL} || external || {NL},
        'GIT DIFF (recent changes that may be relevant):' || {NL} || '```diff' || {NL} || diff || {NL} || '```' || {NL}, '---' || {NL},
        'Please fix this issue. Focus on the root cause analysis above.',
        'Start with ' || replace(category, '_', ' ') || ' in ' || p_file || CASE WHEN p_line <> 0 THEN ' near line ' || p_line ELSE '' END || '.') AS text FROM ready""",
    )
    two = f"{NL} || {NL}"
    shared = [c for c in briefs() if not c.lstrip().startswith(("file_changes AS", "commits AS", "numbered AS", "diffs AS"))]
    ORACLE["enhancement_prompts"] = statement(
        [*parts, *shared],
        f"""SELECT run_id, concat_ws({two}, nullif(substr(text, 1, 2000), ''), '## Error' || {NL} || error, '## Stack Trace' || {NL} || stack,
        '## Heuristic Analysis' || {NL} || 'Category: ' || category || ' (' || confidence || ' confidence)' || {NL} || 'Explanation: ' || explanation || {NL} || 'Suggested fix: ' || coalesce(suggested_fix, 'none'),
        '## Relevant Code' || {NL} || substr(model_code, 1, 3000), '## External Context (web search results)' || {NL} || substr(external, 1, 1500),
        '## Recent Git Changes' || {NL} || '```diff' || {NL} || substr(diff, 1, 1000) || {NL} || '```') AS text FROM ready LEFT JOIN briefs USING (project_root) WHERE error IS NOT NULL""",
    )


    ORACLE["quarantine_packets"] = statement(
        all_failures(),
        """SELECT run_id, project_root, CASE WHEN reasons IS NULL THEN 'accepted' ELSE 'quarantined' END AS status, coalesce(reasons, '') AS reasons,
        coalesce(n, 0)::INTEGER AS n_failures FROM runs LEFT JOIN (SELECT run_id, count(*) AS n FROM failures GROUP BY run_id) USING (run_id)
        LEFT JOIN (SELECT run_id, string_agg(DISTINCT reason, '|' ORDER BY reason) AS reasons FROM (SELECT run_id, CASE WHEN line < 1 THEN 'line must be positive'
          WHEN col < 1 THEN 'column must be positive' END AS reason FROM frames) WHERE reason IS NOT NULL GROUP BY run_id) USING (run_id)""",
    )
    counted = ORACLE["extract_test_counts"]
    ORACLE["assemble_packets_command"] = statement(
        [*all_failures(False), *matches(), *hypotheses(), *replies(), *history(), f"counted AS ({counted})"],
        """SELECT r.run_id, r.command, r.exit_code, total, passed, failed, length(stdout)::INTEGER AS stdout_length, coalesce(errors, '') AS errors,
        coalesce(categories, '') AS categories, n.branch, e.narrative, e.fix_file, e.model FROM runs r LEFT JOIN counted USING (run_id)
        LEFT JOIN (SELECT project_root, branch FROM numbered WHERE rk = 1) n USING (project_root)
        LEFT JOIN (SELECT run_id, string_agg(error_message, '|' ORDER BY failure_idx) AS errors FROM failures GROUP BY run_id) USING (run_id)
        LEFT JOIN (SELECT run_id, string_agg(category, '|' ORDER BY hyp_idx) AS categories FROM hypotheses GROUP BY run_id) USING (run_id)
        LEFT JOIN (SELECT run_id, narrative, fix_file, model FROM enhanced WHERE NOT failed) e USING (run_id)""",
    )
    ORACLE["assemble_packets"] = statement(
        [*parts, RUN_STEPS],
        f"""SELECT r.run_id, r.project_root, '1.0.0' AS version, '(' || format || ' output)' AS command, 1 AS exit_code, NULL::INTEGER AS total, coalesce(n_results, 0) AS n_results, coalesce(errors, '') AS errors, coalesce(categories, '') AS categories,
        coalesce(snippet_starts, '') AS snippet_starts, coalesce(related_files, '') AS related_files, n.commit_hash AS last_commit_hash, n.branch AS branch, len(d.diff)::INTEGER AS diff_length,
        available AS search_available, len(summary)::INTEGER AS summary_length, steps FROM runs r JOIN (SELECT run_id, format FROM formats) USING (run_id) LEFT JOIN (SELECT run_id, count(*) AS n_results FROM search_results GROUP BY run_id) USING (run_id) LEFT JOIN summaries USING (run_id)
        LEFT JOIN (SELECT project_root, commit_hash, branch FROM numbered WHERE rk = 1) n USING (project_root) LEFT JOIN diffs d USING (project_root)
        LEFT JOIN (SELECT run_id, string_agg(error_message, '|' ORDER BY failure_idx) AS errors FROM failures GROUP BY run_id) USING (run_id)
        LEFT JOIN (SELECT run_id, string_agg(category, '|' ORDER BY hyp_idx) AS categories FROM hypotheses GROUP BY run_id) USING (run_id)
        LEFT JOIN (SELECT run_id, string_agg(start_line::VARCHAR, '|' ORDER BY snippet_idx) AS snippet_starts FROM snips GROUP BY run_id) USING (run_id)
        LEFT JOIN (SELECT run_id, string_agg(file, '|' ORDER BY file_idx) AS related_files FROM related GROUP BY run_id) USING (run_id)
        LEFT JOIN (SELECT run_id, string_agg(status, '|' ORDER BY step_idx) AS steps FROM run_steps GROUP BY run_id) USING (run_id)""",
    )


_declare_prompt_part()
