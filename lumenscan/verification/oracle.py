"""The expected result of every query as plain SQL.

For steps and findings the SQL never reads source text: it expands each snippet id to
step rows written by hand and applies the rules to those.  Token-level queries lex the
text with a regular expression of their own.
"""

from __future__ import annotations

import re

from lumenscan.sources.snippets import DEFECTS, EPILOGUE, PRELUDE, SHARDS, SNIPPETS
from lumenscan.verification.snippet_steps import SNIPPET_LOCALS, expected_steps


# Written out here again, so that a wrong value in the package is seen (fixed values).
KEYWORDS = (
    "and", "break", "do", "else", "elseif", "end", "false", "for", "function", "if",
    "in", "local", "nil", "not", "or", "repeat", "return", "then", "true", "until",
    "while", "continue", "type", "export", "typeof", "declare", "const", "class", "extends", "with",
    "extern", "read", "write",
)
VOID_TAGS = (
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr",
)
LOOP_CLASSES = {
    "while": "WhileFlowStep", "for_in": "ForInFlowStep",
    "numeric_for": "NumericForFlowStep", "repeat_until": "RepeatUntilFlowStep",
}
RULES = (
    (1, "empty-function", "info"), (2, "long-function", "warning"), (3, "unreachable", "error"),
    (4, "deep-nesting", "warning"), (5, "deprecated-api", "warning"), (6, "infinite-loop", "warning"),
    (7, "empty-then", "warning"), (8, "wait-in-loop", "warning"), (9, "duplicate-condition", "warning"),
    (10, "identical-actions", "warning"), (11, "nested-loops", "warning"), (12, "self-assignment", "error"),
    (13, "empty-loop", "warning"), (14, "redundant-condition", "warning"), (15, "complex-condition", "info"),
    (16, "nested-closures", "warning"), (17, "magic-numbers", "info"), (18, "global-variable", "error"),
    (19, "instance-in-loop", "warning"), (20, "getchildren-in-loop", "warning"), (21, "unprotected-remote", "error"),
    (22, "connect-leak", "warning"), (23, "yield-in-critical", "error"), (24, "pcall-ignored-result", "warning"),
    (25, "infinite-yield-risk", "warning"), (26, "remote-spam", "warning"), (27, "task-spawn-storm", "warning"),
    (28, "require-in-loop", "warning"), (29, "event-reconnect-loop", "warning"), (30, "unsafe-tonumber", "info"),
)


def lit(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, (int, float)):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def values(name: str, columns: str, rows) -> str:
    body = ",\n".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    return f"{name}({columns}) AS (VALUES\n{body})"


def _corpus() -> list[str]:
    steps = expected_steps()
    snippets = []
    for sn, text in enumerate(SNIPPETS, 1):
        mine = [s for s in steps if s["sn"] == sn]
        tops = sum(s["parent_no"] is None for s in mine)
        snippets.append((sn, text, len(mine), tops, text.count("\n") + 1))
    sql_defect = " ".join(f"WHEN custkey % {m} = {r} THEN {lit(t)}" for m, r, t in DEFECTS)
    return [
        values("snip", "sn, txt, n_steps, n_top, n_lines", snippets),
        values(
            "sstep",
            "sn, k, sub_k, parent_k, branch, ord, kind, label, condition, header, signature, n_then, n_else, n_body, line_k",
            [
                (
                    s["sn"], s["step_no"], s["sub_end"], s["parent_no"], s["branch"], s["ordinal"], s["kind"], s["label"],
                    s["condition"], s["header"], s["signature"], s["n_then"], s["n_else"], s["n_body"], s["line"],
                )
                for s in steps
            ],
        ),
        values(
            "slocal",
            "sn, nth, kind, name, line_k, col",
            [(sn, i, *e) for sn, es in SNIPPET_LOCALS.items() for i, e in enumerate(es)],
        ),
        f"""li AS (
          SELECT o_custkey AS custkey, CAST(o_orderkey % 3 AS INT) AS fn, l_orderkey, l_linenumber,
                 CAST(1 + (l_partkey * 31 + l_suppkey * 7 + l_linenumber) % {len(SNIPPETS)} AS INT) AS sn,
                 CAST(floor(o_orderkey / 3 % {SHARDS}) AS INT) AS shard
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
        """line AS (
          SELECT 'src/c' || custkey || CASE WHEN shard > 0 THEN '_' || shard ELSE '' END || '.luau' AS unit_id,
                 custkey, fn, sn,
                 row_number() OVER (PARTITION BY custkey, shard, fn ORDER BY l_orderkey, l_linenumber, sn) AS seq
          FROM li)""",
        """fbody AS (
          SELECT unit_id, custkey, fn, string_agg(txt, chr(10) ORDER BY seq) AS body, CAST(sum(n_lines) AS INT) AS n_lines
          FROM line JOIN snip USING (sn) GROUP BY ALL)""",
        """fn0 AS (
          SELECT unit_id, 0 AS ord, 'helper' AS fn_name, 'local function helper<T>(x: ((((T)))))' AS signature, NULL AS fn, 5 AS fline
          FROM (SELECT DISTINCT unit_id FROM fbody)
          UNION ALL
          SELECT unit_id, 1 + fn, 'M.f' || custkey || '_' || fn, 'function M.f' || custkey || '_' || fn || '(x)', fn,
                 CAST(6 + sum(n_lines + 2) OVER (PARTITION BY unit_id ORDER BY fn) - (n_lines + 2) AS INT)
          FROM fbody
          UNION ALL
          SELECT unit_id, 9, 'M.e' || custkey, 'function M.e' || custkey || '()', NULL, CAST(6 + sum(n_lines + 2) AS INT)
          FROM fbody WHERE custkey % 7 = 0 GROUP BY unit_id, custkey)""",
        """fns AS (
          SELECT unit_id, CAST(row_number() OVER (PARTITION BY unit_id ORDER BY ord) - 1 AS INT) AS fn_no, fn_name,
                 CASE WHEN ord > 0 THEN 'M' END AS container, signature, fn, fline AS line FROM fn0)""",
        f"""unit AS (
          SELECT unit_id, custkey,
                 {lit(PRELUDE)}
                 || string_agg('function M.f' || custkey || '_' || fn || '(x)' || chr(10) || body || chr(10) || 'end' || chr(10),
                               '' ORDER BY fn)
                 || CASE WHEN custkey % 7 = 0 THEN 'function M.e' || custkey || '()' || chr(10) || 'end' || chr(10) ELSE '' END
                 || {lit(EPILOGUE)} || CASE {sql_defect} ELSE '' END AS content
          FROM fbody GROUP BY unit_id, custkey)""",
        """pos AS (
          SELECT l.unit_id, l.fn, l.sn, f.fn_no, f.fn_name, f.line AS fline, s.n_steps,
                 sum(s.n_steps) OVER w - s.n_steps AS step0, sum(s.n_top) OVER w - s.n_top AS top0,
                 sum(s.n_lines) OVER w - s.n_lines AS line0
          FROM line l JOIN snip s USING (sn) JOIN fns f ON f.unit_id = l.unit_id AND f.fn = l.fn
          WINDOW w AS (PARTITION BY l.unit_id, l.fn ORDER BY l.seq))""",
        """steps AS (
          SELECT unit_id, fn_no, fn_name, CAST(step0 + k AS INT) AS step_no, CAST(step0 + sub_k AS INT) AS sub_end,
                 CAST(step0 + parent_k AS INT) AS parent_no, branch,
                 CAST(CASE WHEN parent_k IS NULL THEN top0 + ord ELSE ord END AS INT) AS ordinal,
                 kind, label, condition, header, signature, n_then, n_else, n_body,
                 CAST(fline + 1 + line0 + line_k AS INT) AS line
          FROM pos JOIN sstep USING (sn)
          UNION ALL
          SELECT unit_id, 0, 'helper', 0, 0, NULL, 'body', 0, 'action', 'return x', NULL, NULL, NULL, 0, 0, 0, 5 FROM unit)""",
    ]


LOOPS = "('while', 'for_in', 'numeric_for', 'repeat_until')"
CONTAINERS = "('if', 'closure', 'while', 'for_in', 'numeric_for', 'repeat_until')"
HANDLER = "(On(Server|Client)(Event|Invoke)|BindableEvent)"
FRAME = r"(Heartbeat|RenderStepped|Stepped)\s*:Connect\("

_CONTEXT = [
    r"""marked AS (
      SELECT *, coalesce(kind = 'action' AND regexp_extract(label, '^\s*([^\s(]*)', 1) IN ('return', 'break', 'continue'), false) AS is_term,
             coalesce(kind = 'action' AND regexp_extract(label, '^\s*([^\s(]*)', 1) IN ('return', 'break'), false) AS is_exit,
             coalesce(CASE kind WHEN 'action' THEN contains(label, 'type(') OR contains(label, 'typeof(')
                           WHEN 'if' THEN contains(condition, 'type(') OR contains(condition, 'typeof(') END, false) AS is_check
      FROM steps)""",
    """sib AS (
      SELECT *, lag(kind) OVER w AS prev_kind, lag(label) OVER w AS prev_label, lag(condition) OVER w AS prev_condition,
             coalesce(bool_or(is_term) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS dead
      FROM marked WINDOW w AS (PARTITION BY unit_id, fn_no, parent_no, branch ORDER BY ordinal))""",
    """sib2 AS (
      SELECT *, dead AND NOT coalesce(lag(dead) OVER (PARTITION BY unit_id, fn_no, parent_no, branch ORDER BY ordinal), false)
             AS first_dead FROM sib)""",
    f"""up AS (
      SELECT d.unit_id, d.fn_no, d.step_no,
             count(*) FILTER (a.kind IN {LOOPS}) AS loop_depth, count(*) FILTER (a.kind = 'if') AS if_depth,
             count(*) FILTER (a.kind = 'closure') AS closure_depth, count(*) AS depth,
             count(*) FILTER (a.dead) AS dead_depth,
             count(*) FILTER (a.kind = 'closure' AND regexp_matches(a.label, '{HANDLER}')) AS critical_depth,
             count(*) FILTER (a.kind = 'closure' AND regexp_matches(a.label, '{FRAME}')) AS frame_depth
      FROM sib2 d JOIN sib2 a ON a.unit_id = d.unit_id AND a.fn_no = d.fn_no AND a.step_no < d.step_no AND d.step_no <= a.sub_end
      GROUP BY ALL)""",
    """down AS (
      SELECT a.unit_id, a.fn_no, a.step_no, bool_or(d.is_exit) AS has_exit, bool_or(d.is_check) AS has_check
      FROM sib2 a JOIN sib2 d ON a.unit_id = d.unit_id AND a.fn_no = d.fn_no AND a.step_no < d.step_no AND d.step_no <= a.sub_end
      GROUP BY ALL)""",
    """ctx AS (
      SELECT s.*, coalesce(loop_depth, 0) > 0 AS in_loop, CAST(coalesce(loop_depth, 0) AS INT) AS loop_depth,
             CAST(coalesce(if_depth, 0) AS INT) AS if_depth, CAST(coalesce(closure_depth, 0) AS INT) AS closure_depth,
             CAST(coalesce(depth, 0) AS INT) AS depth, coalesce(dead_depth, 0) AS dead_depth,
             coalesce(critical_depth, 0) AS critical_depth, coalesce(frame_depth, 0) AS frame_depth,
             coalesce(has_exit, false) AS has_exit, coalesce(has_check, false) AS has_check
      FROM sib2 s LEFT JOIN up USING (unit_id, fn_no, step_no) LEFT JOIN down USING (unit_id, fn_no, step_no))""",
]

_L60 = "left(trim(label), 60)"
_TYPED = "(contains(label, 'type(') OR contains(label, 'typeof('))"
_CLASS = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LOOP_CLASSES.items()) + " END"
_ASSIGN = r"'^([\w.:\[\]]+)\s*=\s*([\w.:\[\]]+)\s*$'"


def _magic(pattern: str) -> tuple[str, str]:
    number = f"regexp_extract(trim(label), '{pattern}', 1)"
    return (
        rf"kind = 'action' AND NOT regexp_matches(label, '^local\s+[A-Z_][A-Z0-9_]*\s*=') AND try_cast({number} AS DOUBLE) > 1",
        rf"'Magic number ' || {number} || ' in function ''' || fn_name || ''': extract to a named constant in Shared/Balance — ' || {_L60}",
    )


# (rule, condition on a row of `ctx`, message); `f` stands for the quoted function name.
_ROW_RULES = [
    ("unreachable", "first_dead AND dead_depth = 0",
     r"'Unreachable code after ''' || regexp_extract(prev_label, '^\s*([^\s(]*)', 1) || ''' in function ' || f || ': ' || "
     f"CASE WHEN kind = 'action' THEN {_L60} ELSE '...' END"),
    ("deep-nesting", "kind = 'if' AND if_depth + 1 > 4",
     "'Nested ' || (if_depth + 1) || ' levels deep in function ' || f || ' (max 4)'"),
    *[("deprecated-api",
       f"kind = 'action' AND contains(label, '{c}') AND NOT contains(split_part(label, '{c}', 1), 'task.') "
       f"AND NOT contains(split_part(label, '{c}', 1), 'coroutine.')",
       f"'Deprecated API ''{c}(...)'' in function ' || f || ': use task.{c}() instead'") for c in ("spawn(", "delay(", "wait(")],
    ("infinite-loop", "kind = 'while' AND condition = 'true' AND NOT has_exit",
     "'''while true'' without break/return in function ' || f"),
    ("infinite-loop", "kind = 'repeat_until' AND condition = 'false' AND NOT has_exit",
     "'''repeat ... until false'' without break/return in function ' || f"),
    ("empty-then", "kind = 'if' AND n_then = 0",
     "'Empty ''then'' branch in function ' || f || ' for condition: ' || condition"),
    ("wait-in-loop", "kind = 'action' AND in_loop AND (contains(lower(label), 'wait(') OR contains(lower(label), 'wait ('))",
     "'wait() inside loop in function ' || f || ' hurts performance: ' || label"),
    ("duplicate-condition", "kind = 'if' AND prev_kind = 'if' AND prev_condition = condition",
     "'Duplicate condition ''' || condition || ''' in function ' || f || ' — likely a copy-paste error'"),
    ("identical-actions", "kind = 'action' AND prev_kind = 'action' AND prev_label = label AND label <> ''",
     f"'Duplicated action in function ' || f || ': ' || {_L60}"),
    ("nested-loops", f"kind IN {LOOPS} AND loop_depth + 1 > 2",
     "(loop_depth + 1) || ' nested loops in function ' || f || ' — O(n^' || (loop_depth + 1) || ') complexity, risky in frame-tight code'"),
    ("self-assignment",
     f"kind = 'action' AND regexp_matches(label, {_ASSIGN}) AND regexp_extract(label, {_ASSIGN}, 1) = regexp_extract(label, {_ASSIGN}, 2)",
     f"'Self-assignment in function ' || f || ': ' || {_L60} || ' — variable assigns to itself'"),
    ("empty-loop", f"kind IN {LOOPS} AND n_body = 0",
     f"'Empty loop body in function ' || f || ': ' || {_CLASS} || ' (' || left(coalesce(header, condition), 40) || ')'"),
    ("redundant-condition", "kind = 'if' AND lower(condition) IN ('true', 'false')",
     "'Hard-coded ''' || condition || ''' condition in function ' || f || ' — dead code or debug leftover'"),
    ("redundant-condition", "kind = 'while' AND lower(condition) = 'false'",
     "'''while false'' in function ' || f || ' — loop never executes'"),
    ("complex-condition", "kind = 'if' AND length(condition) > 80",
     "'Complex condition (' || length(condition) || ' chars) in function ' || f || ' — extract to a named variable'"),
    ("nested-closures", r"kind = 'action' AND len(regexp_extract_all(label, 'function ?\(')) > 1",
     r"len(regexp_extract_all(label, 'function ?\(')) || ' nested closures in function ' || f || ' — callback hell, refactor with named functions'"),
    ("nested-closures", "kind = 'closure' AND closure_depth + 1 > 1",
     "(closure_depth + 1) || ' nested closures in function ' || f || ' — callback hell, refactor with named functions'"),
    ("magic-numbers", *_magic(r"[+\-*/]=\s*(\d+(?:\.\d+)?)\s*(?:--.*)?$")),
    ("magic-numbers", *_magic(r"\.\w+\s*=\s*(\d+(?:\.\d+)?)\s*(?:--.*)?$")),
    ("global-variable", r"kind = 'action' AND regexp_matches(label, '_G\s*[.\[]')",
     f"'_G usage in function ' || f || ': never use global state in production Roblox code — ' || {_L60}"),
    ("instance-in-loop", "kind = 'action' AND in_loop AND contains(label, 'Instance.new(')",
     f"'Instance.new() inside loop in function ' || f || ': use object pooling to avoid GC pressure — ' || {_L60}"),
    ("getchildren-in-loop", r"kind = 'action' AND in_loop AND regexp_matches(label, ':Get(Children|Descendants)\(\)')",
     "':GetChildren() inside loop in function ' || f || ': cache the result outside the loop'"),
    ("unprotected-remote", r"kind = 'action' AND regexp_matches(label, ':(Fire|Invoke)Server\(')",
     f"'Remote call in function ' || f || ': ensure server validates all parameters — ' || {_L60}"),
    ("unprotected-remote",
     f"(kind = 'action' AND regexp_matches(label, '{HANDLER}') AND NOT {_TYPED}) OR "
     "(kind = 'closure' AND (contains(label, 'OnServerEvent') OR contains(label, 'OnServerInvoke')) AND NOT has_check)",
     "'Remote handler in function ' || f || ' has no type validation — exploiters can send any data'"),
    ("yield-in-critical", rf"kind = 'action' AND regexp_matches(label, '{HANDLER}') AND regexp_matches(label, '(task\.)?wait\s*\(')",
     f"'Yield inside critical handler in function ' || f || ': blocks the thread and creates race conditions — ' || {_L60}"),
    ("yield-in-critical", r"kind = 'action' AND critical_depth > 0 AND regexp_matches(label, '(task\.)?wait\s*\(')",
     f"'Yield inside critical handler in function ' || f || ': blocks the thread and creates race conditions — ' || {_L60}",
     "critical_depth"),
    ("pcall-ignored-result",
     r"kind IN ('action', 'closure') AND regexp_matches(label, '(^|\W)x?pcall\s*\(') AND NOT contains(split_part(label, 'pcall(', 1), '=')",
     f"'pcall/xpcall result ignored in function ' || f || ': errors silently swallowed — ' || {_L60}"),
    ("infinite-yield-risk", r"""kind = 'action' AND regexp_matches(label, ':WaitForChild\(\s*["''][^"'']*["'']\s*\)')""",
     f"':WaitForChild() without timeout in function ' || f || ': can hang forever — add a timeout parameter — ' || {_L60}"),
    ("remote-spam", r"kind = 'action' AND in_loop AND regexp_matches(label, ':(FireServer|FireAllClients|FireClient)\s*\(')",
     f"'Remote :Fire*() inside loop in function ' || f || ': rate-limited by Roblox, add debounce — ' || {_L60}"),
    ("remote-spam", r"kind = 'action' AND frame_depth > 0 AND regexp_matches(label, ':(FireServer|FireAllClients|FireClient)\s*\(')",
     f"'Remote :Fire*() inside frame signal handler in function ' || f || ': fires every frame, add throttle — ' || {_L60}",
     "frame_depth"),
    ("task-spawn-storm",
     r"kind IN ('action', 'closure') AND in_loop AND regexp_matches(label, 'task\.spawn\s*\(|coroutine\.wrap\s*\(')",
     f"'task.spawn/coroutine.wrap inside loop in function ' || f || ': scheduler overload, batch or queue instead — ' || {_L60}"),
    ("require-in-loop", "kind = 'action' AND in_loop AND contains(label, 'require(')",
     f"'require() inside loop in function ' || f || ': move outside the loop — ' || {_L60}"),
    ("event-reconnect-loop", "kind IN ('action', 'closure') AND in_loop AND contains(label, ':Connect(')",
     "':Connect() inside loop in function ' || f || ': creates new connection every iteration, leaks memory'"),
    ("unsafe-tonumber",
     r"kind = 'action' AND regexp_matches(label, '(^|\W)tonumber\s*\([^)]+\)') AND NOT regexp_matches(label, '(^|\W)tonumber\s*\([^)]+\)\s+or\s+')",
     "'tonumber() without nil check in function ' || f || ': add fallback like tonumber(x) or 0'"),
]

_TOTALS = """totals AS (
  SELECT f.unit_id, f.fn_no, f.fn_name, f.line, count(s.step_no) AS n_steps,
         coalesce(bool_or(s.kind IN ('action', 'closure') AND contains(s.label, ':Connect(')), false) AS connects,
         coalesce(bool_or(s.kind IN ('action', 'closure') AND (contains(s.label, 'Maid') OR contains(s.label, 'Janitor')
                  OR contains(s.label, 'Trove') OR contains(s.label, ':Disconnect()'))), false) AS cleans
  FROM fns f LEFT JOIN steps s ON s.unit_id = f.unit_id AND s.fn_no = f.fn_no GROUP BY ALL)"""

_FUNCTION_RULES = [
    ("empty-function", "n_steps = 0", "'Function ' || f || ' has an empty body'"),
    ("long-function", "n_steps > 50", "'Function ' || f || ' has ' || n_steps || ' steps (exceeds 50)'"),
    ("connect-leak", "connects AND NOT cleans",
     "':Connect() in function ' || f || ' without cleanup — use Maid/Janitor/Trove to prevent memory leaks'"),
]


def _findings(only: str | None = None) -> str:
    number = {name: (no, severity) for no, name, severity in RULES}
    parts = []
    for source, rules in (("ctx", _ROW_RULES), ("totals", _FUNCTION_RULES)):
        step = "step_no" if source == "ctx" else "CAST(NULL AS INT)"
        for rule, where, message, *times in rules:
            if only and rule != only:
                continue
            no, severity = number[rule]
            repeat = f", generate_series(1, {times[0]})" if times else ""
            message = re.sub(r"(?<=\|\| )f(?= \|\||$)", "'''' || fn_name || ''''", message)
            parts.append(
                f"SELECT unit_id, fn_no, fn_name, {no} AS rule_no, '{rule}' AS rule, '{severity}' AS severity, "
                f"{message} AS message, {step} AS step_no, line FROM {source}{repeat} WHERE {where}"
            )
    return "finding AS (\n" + "\nUNION ALL\n".join(parts) + ")"


# Every file and two copies of it.
_COPIES = "(SELECT unnest(['', '#1', '#2']) AS copy)"

# Two rules that a caller adds (findings_own).
_OWN = """own AS (
  SELECT unit_id, fn_no, fn_name, 101 AS rule_no, 'nested-call' AS rule, 'info' AS severity,
         '''' || label || ''' ' || if_depth || ' deep in ''' || fn_name || '''' AS message, step_no, line
  FROM ctx WHERE kind = 'action' AND (loop_depth > 0 OR if_depth > 0) AND contains(label, '(')
  UNION ALL
  SELECT unit_id, fn_no, fn_name, 102, 'twenty-steps', 'warning', '''' || fn_name || ''' has ' || n_steps || ' steps', NULL, line
  FROM totals WHERE n_steps >= 20)"""


# ---- tokens ------------------------------------------------------------------------------

_WORD = r"[A-Za-z_][A-Za-z0-9_]*"
_NUM = r"0[xX][0-9a-fA-F_]+|0[bB][01_]+|[0-9][0-9_]*(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"
_STR = r'"(?:[^"\\\n]|\\z\s*|\\.)*"?'
_LONG = r"\[\[(?:[^\]])*\]\]|\[==\[(?:[^\]])*\]==\]"
_OPS = r"\.\.\.|\.\.=|//=|==|~=|<=|>=|\.\.|//|->|::|\+=|-=|\*=|/=|%=|\^=|[-+*/%^#&|~<>=:;,.?@]"
_SPACE = r"\s+|--[^\n]*"
_LEX = f"{_SPACE}|{_WORD}|{_NUM}|{_STR}|{_LONG}|{_OPS}|[^\\s]"

_RAW = [
    f"""cut AS (SELECT unit_id, regexp_extract_all(content, {lit(_LEX)}) AS parts FROM unit)""",
    """raw AS (
      SELECT unit_id, unnest(parts) AS text, generate_subscripts(parts, 1) AS i FROM cut)""",
    """raw2 AS (
      SELECT *, CAST(1 + coalesce(sum(length(text) - length(replace(text, chr(10), ''))) OVER b, 0) AS INT) AS line,
             CAST(coalesce(sum(length(text)) OVER b, 0) AS INT) AS start,
             CASE WHEN regexp_matches(text, '^\\s') THEN 'whitespace' WHEN starts_with(text, '--') THEN 'comment'
                  WHEN regexp_matches(text, '^["'']') THEN 'string' WHEN starts_with(text, '`') THEN 'interpolated'
                  WHEN regexp_matches(text, '^\\[=*\\[') THEN 'raw_string' WHEN regexp_matches(text, '^\\.?[0-9]') THEN 'number'
                  WHEN text IN (KEYWORDS) THEN 'keyword' WHEN regexp_matches(text, '^[A-Za-z_]') THEN 'name'
                  WHEN text IN ('(', ')', '[', ']', '{', '}') THEN 'other' ELSE 'operator' END AS cls
      FROM raw WINDOW b AS (PARTITION BY unit_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""".replace(
        "KEYWORDS", ", ".join(lit(k) for k in KEYWORDS)
    ),
    """raw3 AS (
      SELECT *, CAST(start - coalesce(max(CASE WHEN contains(text, chr(10)) THEN start + length(text)
                - length(split_part(text, chr(10), -1)) END)
              OVER (PARTITION BY unit_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS col FROM raw2)""",
    """tok AS (
      SELECT unit_id, CAST(row_number() OVER (PARTITION BY unit_id ORDER BY i) - 1 AS INT) AS tok_no, text, cls, line, start, col
      FROM raw3 WHERE cls NOT IN ('whitespace', 'comment'))""",
    """deep AS (
      SELECT *, CAST(sum(CASE WHEN text IN ('do', 'then', 'function', 'repeat') THEN 1
                              WHEN text IN ('end', 'until', 'elseif') THEN -1 ELSE 0 END) OVER t AS INT) AS depth,
             CAST(sum(CASE WHEN text IN ('(', '[', '{') THEN 1 WHEN text IN (')', ']', '}') THEN -1 ELSE 0 END) OVER t AS INT)
             AS bracket_depth
      FROM tok WINDOW t AS (PARTITION BY unit_id ORDER BY tok_no))""",
]

# Openers meet closers per level by their rank among the openers of that level.
_PAIRS = """pairs AS (
  SELECT o.unit_id, o.text AS opener, c.text AS closer, o.tok_no AS open_tok, min_by(c.tok_no, c.tok_no) AS close_tok, o.lv AS level
  FROM opens o JOIN closes c ON c.unit_id = o.unit_id AND c.grp = o.grp AND c.lv = o.lv AND c.nth = o.nth GROUP BY ALL)"""
_PAIR_PARTS = [
    """opens AS (
      SELECT unit_id, text, tok_no, 'block' AS grp, depth - 1 AS lv, row_number() OVER (PARTITION BY unit_id, depth ORDER BY tok_no) AS nth
      FROM deep WHERE text IN ('do', 'then', 'function', 'repeat')
      UNION ALL
      SELECT unit_id, text, tok_no, 'bracket', bracket_depth - 1, row_number() OVER (PARTITION BY unit_id, bracket_depth ORDER BY tok_no)
      FROM deep WHERE text IN ('(', '[', '{'))""",
    """closes AS (
      SELECT unit_id, text, tok_no, 'block' AS grp, depth AS lv, row_number() OVER (PARTITION BY unit_id, depth ORDER BY tok_no) AS nth
      FROM deep WHERE text IN ('end', 'until', 'elseif')
      UNION ALL
      SELECT unit_id, text, tok_no, 'bracket', bracket_depth, row_number() OVER (PARTITION BY unit_id, bracket_depth ORDER BY tok_no)
      FROM deep WHERE text IN (')', ']', '}'))""",
    _PAIRS,
]

# What each defect behind the epilogue is reported as, by how it begins; it is on the last line of the file.
_PROBLEMS = [
    ('print("open', "unterminated string '\"open'", 6), ('print("open', "unclosed bracket '('", 5), ("do", "unclosed block 'do'", 0),
    ("end", "unexpected 'end'", 0), ("call", "unclosed bracket '('", 4), ("function foo", "no header behind 'function'", 0),
]


def _diagnostics() -> str:
    cases, seen = [], []
    for modulus, rest, text in DEFECTS:
        where = f"custkey % {modulus} = {rest}" + "".join(f" AND NOT ({s})" for s in seen)
        seen.append(f"custkey % {modulus} = {rest}")
        for key, message, col in _PROBLEMS:
            if text.startswith(key):
                cases.append(
                    f"SELECT unit_id, 'error' AS severity, {lit(message)} AS message, "
                    f"CAST(length(content) - length(replace(content, chr(10), '')) AS INT) AS line, {col} AS col FROM unit WHERE {where}"
                )
    return "diag AS (" + " UNION ALL ".join(cases) + ")"


_ELEMENTS = """elem0 AS (
  SELECT unit_id, kind, name, line, col, container, signature FROM unit, (VALUES
    ('constant', 'M', 1, 0, NULL, 'local M'), ('variable', 'count', 2, 0, NULL, 'local count'),
    ('type_alias', 'Id', 3, 0, NULL, 'type Id'), ('type_alias', 'Pair', 4, 0, NULL, 'export type Pair'),
    ('local_function', 'helper', 5, 0, NULL, 'local function helper<T>(x: ((((T)))))')) p(kind, name, line, col, container, signature)
  UNION ALL
  SELECT unit_id, 'function', fn_name, line, 0, NULL, signature FROM fns WHERE fn_no > 0
  UNION ALL
  SELECT p.unit_id, s.kind, s.name, CAST(p.fline + 1 + p.line0 + s.line_k AS INT), s.col, p.fn_name, 'local ' || s.name
  FROM pos p JOIN slocal s USING (sn)),
elem AS (
  SELECT unit_id, CAST(row_number() OVER (PARTITION BY unit_id ORDER BY line, col,
         CASE name WHEN 'ok' THEN 0 WHEN 'err' THEN 1 WHEN 'bb' THEN 1 ELSE 0 END) AS INT) AS elem_no, * EXCLUDE (unit_id) FROM elem0)"""

_STATS = """stats AS (
  SELECT u.unit_id, u.unit_id AS location, t.n AS token_count, coalesce(e.n, 0) AS element_count, coalesce(d.n, 0) AS diagnostic_count
  FROM unit u LEFT JOIN (SELECT unit_id, count(*) AS n FROM tok GROUP BY 1) t USING (unit_id)
  LEFT JOIN (SELECT unit_id, count(*) AS n FROM elem GROUP BY 1) e USING (unit_id)
  LEFT JOIN (SELECT unit_id, count(*) AS n FROM diag GROUP BY 1) d USING (unit_id)),
outcome AS (
  SELECT unit_id, location, '1' AS lexer_version,
         CASE WHEN diagnostic_count > 0 THEN 'succeeded_with_diagnostics' ELSE 'succeeded' END AS status,
         token_count, element_count, diagnostic_count, CAST(NULL AS VARCHAR) AS failure_message FROM stats)"""

STEP_COLUMNS = (
    "unit_id, fn_no, fn_name, step_no, sub_end, parent_no, branch, ordinal, kind, label, condition, header, signature, "
    "n_then, n_else, n_body, line"
)
_SEVERITIES = (
    "count(*) FILTER (severity = 'error') AS error, count(*) FILTER (severity = 'warning') AS warning, "
    "count(*) FILTER (severity = 'info') AS info"
)


def _with(ctes: list[str], select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


def oracle() -> dict[str, str]:
    corpus = _corpus()
    context = corpus + _CONTEXT
    tokens = corpus + _RAW
    all_findings = [*context, _TOTALS, _findings()]
    elements = [*corpus, _ELEMENTS]
    jobs = [*tokens, _ELEMENTS, _diagnostics(), _STATS]
    out = {
        "corpus": _with(corpus, "SELECT unit_id, content FROM unit"),
        "tokens": _with(tokens, "SELECT unit_id, tok_no, text, cls, line, start, col FROM tok"),
        "tokens_pieces": _with(tokens, "SELECT unit_id, tok_no, text, cls, line, start, col FROM tok"),
        # Lexemes add up to the file, and only an unclosed block word or a function without a header is nobody's.
        "ownership": _with(corpus, "SELECT unit_id, CAST(length(content) AS BIGINT) AS n_chars, CAST(CASE WHEN content LIKE '%' || chr(10) || 'do' || chr(10) "
                           "OR content LIKE '%' || chr(10) || 'function foo end' || chr(10) THEN 1 ELSE 0 END AS BIGINT) AS n_unowned FROM unit"),
        "token_classes": _with(tokens, "SELECT unit_id, cls, count(*) AS n_tokens FROM raw2 GROUP BY 1, 2"),
        "token_classes_pieces": _with(tokens, "SELECT unit_id, cls, count(*) AS n_tokens FROM raw2 GROUP BY 1, 2"),
        "block_depth": _with(tokens, "SELECT unit_id, tok_no, text, depth, bracket_depth FROM deep"),
        "block_pairs": _with([*tokens, *_PAIR_PARTS], "SELECT unit_id, opener, closer, open_tok, close_tok, level FROM pairs "
                             "WHERE open_tok < close_tok"),
        "functions": _with(corpus, "SELECT unit_id, fn_no, fn_name, container, signature, line FROM fns"),
        "function_name": _with(corpus, "SELECT unit_id, fn_no, fn_name FROM fns"),
        "function_container": _with(corpus, "SELECT unit_id, fn_no, container FROM fns"),
        "function_signature": _with(corpus, "SELECT unit_id, fn_no, signature FROM fns"),
        "steps": _with(corpus, f"SELECT {STEP_COLUMNS} FROM steps"),
        "skip_return_type": _with(corpus, f"SELECT {STEP_COLUMNS} FROM steps"),
        "statements": _with(corpus, "SELECT unit_id, fn_no, step_no AS stmt_no, line FROM steps"),
        "compact_label": _with(corpus, "SELECT unit_id, fn_no, step_no, " + ", ".join(
            f"CASE WHEN length(coalesce(label, condition, header)) > {n} THEN left(coalesce(label, condition, header), {n - 1}) || '...' "
            f"ELSE coalesce(label, condition, header) END AS {name}" for n, name in ((60, "shown"), (96, "shown_96"))) + " FROM steps"),
        "step_context": _with(context, "SELECT unit_id, fn_no, step_no, kind, in_loop, if_depth, loop_depth, closure_depth FROM ctx"),
        "total_steps": _with(corpus, "SELECT unit_id, fn_no, fn_name, count(*) AS n_steps FROM steps GROUP BY ALL"),
        "max_depth": _with(context, f"SELECT unit_id, fn_no, fn_name, max(depth + CASE WHEN kind IN {CONTAINERS} THEN 1 ELSE 0 END) "
                           "AS max_depth FROM ctx GROUP BY ALL"),
        "corpus_max_depth": _with(context, f"SELECT max(depth + CASE WHEN kind IN {CONTAINERS} THEN 1 ELSE 0 END) AS max_depth FROM ctx"),
        "function_labels": _with(corpus, "SELECT unit_id, fn_no, fn_name, step_no, label FROM steps WHERE kind IN ('action', 'closure')"),
        "exits": _with(context, f"SELECT unit_id, fn_no, step_no, kind FROM ctx WHERE kind IN {CONTAINERS} AND has_exit"),
        "type_checks": _with(context, f"SELECT unit_id, fn_no, step_no, kind FROM ctx WHERE kind IN {CONTAINERS} AND has_check"),
        "terminators": _with(context, r"SELECT unit_id, fn_no, step_no, regexp_extract(label, '^\s*([^\s(]*)', 1) AS word FROM marked "
                             "WHERE is_term"),
        "findings": _with(all_findings, "SELECT * FROM finding"),
        "severity_summary": _with(all_findings, f"SELECT {_SEVERITIES} FROM finding"),
        "rule_counts": _with(all_findings, "SELECT rule_no, rule, count(*) AS n_findings FROM finding GROUP BY 1, 2"),
        "findings_own": _with([*context, _TOTALS, _OWN], "SELECT * FROM own"),
        "rule_counts_own": _with([*all_findings, _OWN], "SELECT rule_no, rule, count(*) AS n_findings "
                                 "FROM (SELECT rule_no, rule FROM finding UNION ALL SELECT rule_no, rule FROM own) GROUP BY 1, 2"),
        "file_report": _with(all_findings, f"""SELECT u.unit_id, u.unit_id AS location, count(rule) AS smell_count, {_SEVERITIES},
            coalesce(string_agg(rule || ':' || coalesce(step_no, -1), ',' ORDER BY fn_no, rule_no, coalesce(step_no, -1)), '') AS smells
            FROM unit u LEFT JOIN finding USING (unit_id) GROUP BY ALL"""),
        "corpus_report": _with(all_findings, f"SELECT (SELECT count(*) FROM unit) AS file_count, count(*) AS total_smells, {_SEVERITIES} "
                               "FROM finding"),
        "write_report": _with(all_findings, f"""SELECT u.unit_id AS source_location, count(rule) AS smell_count, {_SEVERITIES}
            FROM unit u LEFT JOIN finding USING (unit_id) GROUP BY ALL"""),
        "function_index": _with(corpus, """SELECT unit_id, unit_id AS location, count(*) AS function_count,
            string_agg(fn_name, ',' ORDER BY fn_no) AS function_names, replace(unit_id, '.luau', '.nassi.html') AS output_name
            FROM fns GROUP BY ALL"""),
        "diagnostics": _with([*corpus, _diagnostics()], "SELECT * FROM diag"),
        "elements": _with(elements, "SELECT unit_id, elem_no, kind, name, line, col, container, signature FROM elem"),
        "element_container": _with(elements, "SELECT container, count(*) AS n FROM elem GROUP BY 1"),
        "parse_statistics": _with(jobs, "SELECT unit_id, token_count, element_count, diagnostic_count FROM stats"),
        "outcomes": _with(jobs, "SELECT * FROM outcome"),
        "outcomes_by_content": _with(jobs, f"SELECT outcome.* REPLACE (unit_id || copy AS unit_id) FROM outcome, {_COPIES}"),
        "steps_by_content": _with(corpus, f"SELECT s.* REPLACE (unit_id || copy AS unit_id) FROM (SELECT {STEP_COLUMNS} FROM steps) s, {_COPIES}"),
        "job_summary": _with(jobs, """SELECT count(*) AS source_count, count(*) FILTER (status = 'succeeded') AS succeeded_count,
            count(*) FILTER (status = 'succeeded_with_diagnostics') AS succeeded_with_diagnostics_count,
            count(*) FILTER (status = 'technical_failure') AS technical_failure_count FROM outcome"""),
        "job_invariants": _with(corpus, """SELECT unit_id, 'missing outcome' AS violation FROM unit WHERE custkey % 13 = 0
            UNION ALL SELECT unit_id, 'duplicate unit' FROM unit WHERE custkey % 11 = 0
            UNION ALL SELECT unit_id || '.gone', 'unknown unit' FROM unit WHERE custkey % 10 = 0"""),
        "job_report": _with(jobs, """SELECT o.unit_id AS source_location, status, token_count,
            coalesce((SELECT string_agg(kind || ' ' || name, ',' ORDER BY elem_no) FROM elem e WHERE e.unit_id = o.unit_id), '') AS element_list,
            coalesce((SELECT string_agg(message, ',' ORDER BY line, col) FROM diag d WHERE d.unit_id = o.unit_id), '') AS messages
            FROM outcome o"""),
        "job_report_ordered": _with(jobs, """SELECT n AS ordinal, n AS line_no, unit_id AS source_location, status, token_count FROM (
            SELECT *, row_number() OVER (ORDER BY CAST(regexp_extract(unit_id, 'c(\\d+)', 1) AS BIGINT), unit_id) - 1 AS n FROM outcome)"""),
        "read_tree": """SELECT 'd' || doc_id % 20 || '/e' || doc_id % 3 || '/' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.lua' ELSE '.luau' END AS place,
            true AS valid_utf8, length(coalesce(text, '')) AS n_chars, sha256(coalesce(text, '')) AS content_sha2 FROM documents""",
        "decode_source": """SELECT 'doc' || doc_id AS unit_id, doc_id % 7 <> 0 AS valid_utf8,
            CASE WHEN doc_id % 7 <> 0 THEN length(text) END AS n_chars, CASE WHEN doc_id % 7 <> 0 THEN sha256(text) END AS sha2
            FROM documents""",
        "lossless_documents": """SELECT CAST(doc_id AS VARCHAR) AS unit_id, true AS same, length(text) AS n_chars, sha256(text) AS sha2,
            length(text) > 0 AS has_lexemes FROM documents""",
        "lossless_pages": """SELECT CAST(page_id AS VARCHAR) AS unit_id, true AS same, length(html) AS n_chars, sha256(html) AS sha2,
            length(html) > 0 AS has_lexemes FROM pages""",
        "read_steps": _with(corpus, "SELECT unit_id, fn_no, step_no, sub_end FROM steps"),
    }
    for op, kinds in (
        ("elements_function", "'function'"),
        ("elements_local_function", "'local_function'"),
        ("elements_local", "'constant', 'variable'"),
        ("elements_type_alias", "'type_alias'"),
    ):
        out[op] = _with(elements, f"SELECT unit_id, elem_no, kind, name, line, col, container, signature FROM elem WHERE kind IN ({kinds})")
    for op, where in (
        ("steps_if_chain", "kind = 'if'"),
        ("steps_while", "kind = 'while'"),
        ("steps_for", "kind IN ('for_in', 'numeric_for')"),
        ("steps_repeat", "kind = 'repeat_until'"),
        ("steps_do_splice", "(unit_id, fn_no) IN (SELECT unit_id, fn_no FROM pos WHERE sn = 42)"),
        ("steps_closure", "kind = 'closure'"),
    ):
        out[op] = _with(corpus, f"SELECT {STEP_COLUMNS} FROM steps WHERE {where}")
    for _, rule, _ in RULES:
        out[f"findings_{rule}"] = _one_rule(rule, corpus)
    out.update(_sequences())
    return out


_FAR = re.compile(r"\b(in_loop|(loop|if|closure|dead|critical|frame)_depth|has_exit|has_check)\b")


def _one_rule(rule: str, corpus: list[str]) -> str:
    """The findings of one rule, from no more tables than it reads: ancestors and subtrees only where it names them."""
    if rule in [name for name, *_ in _FUNCTION_RULES]:
        return _with([*corpus, _TOTALS, _findings(rule)], "SELECT * FROM finding")
    far = any(_FAR.search(" ".join(parts)) for name, *parts in _ROW_RULES if name == rule)
    context = _CONTEXT if far else [*_CONTEXT[:3], "ctx AS (SELECT * FROM sib2)"]
    return _with([*corpus, *context, _findings(rule)], "SELECT * FROM finding")


def _sequences() -> dict[str, str]:
    void = ", ".join(lit(t) for t in VOID_TAGS)
    tags = [
        r"""clean AS (SELECT page_id, regexp_replace(lower(html), '(?s)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>', '', 'g')
            AS html FROM pages)""",
        """cut AS (SELECT page_id, regexp_extract_all(html, '</?[a-z][a-z0-9]*') AS parts FROM clean)""",
        """raw AS (SELECT page_id, CAST(generate_subscripts(parts, 1) - 1 AS INT) AS pos, unnest(parts) AS raw FROM cut)""",
        f"""tags AS (SELECT page_id, pos, regexp_replace(raw, '^</?', '') AS tag,
            CASE WHEN regexp_replace(raw, '^</?', '') IN ({void}) THEN 0 WHEN starts_with(raw, '</') THEN -1 ELSE 1 END AS delta FROM raw)""",
    ]
    return {
        "adjacent_duplicates": """WITH cut AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
            line AS (SELECT doc_id, CAST(generate_subscripts(parts, 1) - 1 AS INT) AS line_no, unnest(parts) AS line FROM cut),
            prev AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS p FROM line)
            SELECT doc_id, line_no, line FROM prev WHERE p = line""",
        "adjacent_duplicates_turns": """WITH prev AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS p
            FROM conversations) SELECT conv_id, turn, role FROM prev WHERE p = role""",
        "adjacent_duplicates_initials": """WITH prev AS (SELECT conv_id, turn, lower(substr(text, 1, 1)) AS initial,
              lag(lower(substr(text, 1, 1))) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations)
            SELECT conv_id, turn, initial FROM prev WHERE p = initial""",
        "adjacent_duplicates_events": """WITH prev AS (SELECT user_id, event_id, event_type, lag(event_type) OVER
              (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
            SELECT user_id, event_id, event_type FROM prev WHERE p = event_type""",
        "after_terminator": """WITH e AS (SELECT event_id, user_id, event_type, ts, coalesce(bool_or(event_type = 'error')
              OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS dead FROM events),
            f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM e WHERE dead)
            SELECT event_id, user_id, event_type FROM f WHERE nth = 1""",
        "after_terminator_all": """WITH e AS (SELECT event_id, user_id, event_type, coalesce(bool_or(event_type = 'error')
              OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS dead FROM events)
            SELECT event_id, user_id, event_type FROM e WHERE dead""",
        "nesting_depth": _with(tags, "SELECT page_id, pos, tag, delta, CAST(sum(delta) OVER (PARTITION BY page_id ORDER BY pos) AS BIGINT) "
                               "AS depth FROM tags"),
        "inside_block": _with([*tags,
            """marks AS (SELECT page_id, pos, delta, row_number() OVER (PARTITION BY page_id, delta ORDER BY pos) AS nth FROM tags
               WHERE tag = 'article')""",
            """blocks AS (SELECT o.page_id, o.pos AS s, c.pos AS e FROM marks o JOIN marks c
               ON c.page_id = o.page_id AND c.nth = o.nth AND o.delta = 1 AND c.delta = -1)"""],
            """SELECT t.page_id, t.pos, t.tag, count(b.s) AS n_blocks FROM tags t LEFT JOIN blocks b
               ON b.page_id = t.page_id AND b.s < t.pos AND t.pos <= b.e GROUP BY ALL"""),
        "level_pairs_events": """WITH marks AS (SELECT user_id, event_id, CASE event_type WHEN 'view' THEN 1 ELSE -1 END AS delta
              FROM events WHERE event_type IN ('view', 'click')),
            placed AS (SELECT *, sum(delta) OVER (PARTITION BY user_id ORDER BY event_id) + CASE WHEN delta < 0 THEN 1 ELSE 0 END AS level
              FROM marks),
            followed AS (SELECT *, lead(event_id) OVER w AS next_id, lead(delta) OVER w AS next_delta FROM placed
              WINDOW w AS (PARTITION BY user_id, level ORDER BY event_id))
            SELECT user_id, event_id AS "start", next_id AS "end" FROM followed WHERE delta = 1 AND next_delta = -1""",
        "adjacent_duplicates_urls": """WITH p AS (SELECT CAST(length(html) % 10 AS INT) AS digit, url, page_id,
              CAST(length(html) % 100 AS INT) AS size FROM pages),
            prev AS (SELECT *, lag(size) OVER (PARTITION BY digit ORDER BY url, page_id) AS before FROM p)
            SELECT digit, url, page_id, size FROM prev WHERE before = size""",
        "group_missing_partner": """SELECT user_id FROM events GROUP BY user_id
            HAVING bool_or(event_type = 'signup') AND NOT bool_or(event_type = 'purchase')""",
        "group_missing_partner_daily": """SELECT user_id, strftime(ts, '%Y-%m-%d') AS day FROM events GROUP BY ALL
            HAVING bool_or(event_type = 'signup') AND NOT bool_or(event_type = 'purchase')""",
        "bucketed_rule_summary": "SELECT user_id, " + ", ".join(
            f'count(*) FILTER (event_type = \'{t}\') AS "{t}"' for t in ("signup", "purchase", "error", "view", "click")
        ) + " FROM events GROUP BY user_id",
    }
