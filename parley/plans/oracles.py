"""The SQL each job is checked against, written independently of the jobs.

``_BASE`` derives the same inputs from the given tables as ``inputs.py``.
"""

from __future__ import annotations

from parley.plans.inputs import ADMINS, BOT, CHUNK_MS, NEW_IDS
from parley.plans.queries import COOLDOWN_MS, EDIT_MS, NEW_DEFAULT, SHORT_LIMIT, STREAM_LIMIT
from parley.schemas import DEFAULT_COMMANDS, DEFAULT_PROMPT, LENGTH_LIMIT, PARAMETERS

ORACLES: dict[str, str] = {}

_NAMES = [*PARAMETERS, "samplers", "volume"]
_LISTED = ", ".join(f"'{name}'" for name in _NAMES)
_COMMANDS = ", ".join(f"('{k}', '{w}', {str(a).lower()})" for k, (w, a) in DEFAULT_COMMANDS.items())
_OF_KIND = {
    kind: "(" + ", ".join(f"'{n}'" for n, k in PARAMETERS.items() if k == kind) + ")"
    for kind in ("double", "bigint", "boolean")
}
_INT = r"^\s*[+-]?[0-9]+(_[0-9]+)*\s*$"
_DBL = (
    r"^\s*[+-]?(([0-9]+(_[0-9]+)*(\.([0-9]+(_[0-9]+)*)?)?|\.[0-9]+(_[0-9]+)*)"
    r"([eE][+-]?[0-9]+(_[0-9]+)*)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])\s*$"
)

_BASE = f"""
m AS (SELECT conv_id * 4294967296 + turn AS id, conv_id AS user_id,
        TIMESTAMP '2024-01-01 00:00:00' + to_minutes(turn) AS "timestamp",
        turn AS position, role, text AS message FROM conversations),
u AS (SELECT conv_id AS id,
        coalesce(max(text) FILTER (WHERE role = 'system'), '{DEFAULT_PROMPT}') AS system_prompt
      FROM conversations GROUP BY conv_id),
ev AS (SELECT event_id, ts, user_id, event_type, value,
        CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
new_users AS (SELECT user_id AS id, CASE WHEN value >= 20 THEN 'Prompt ' || k
        WHEN value >= 10 THEN '' END AS system_prompt, event_id AS arrival
      FROM ev WHERE event_type = 'signup'),
new_messages AS (SELECT event_id + {NEW_IDS} AS id, user_id,
        CASE event_type WHEN 'view' THEN 'user' WHEN 'click' THEN 'assistant'
          WHEN 'purchase' THEN 'user' WHEN 'signup' THEN 'system' ELSE 'robot' END AS role,
        event_type || ' ' || k AS message, ts AS "timestamp", event_id AS arrival FROM ev),
user_requests AS (SELECT user_id AS id, event_id AS arrival FROM ev
      WHERE event_type = 'error' AND value > 150),
message_requests AS (SELECT user_id * 4294967296 + k // 20 AS id, event_id AS arrival FROM ev
      WHERE event_type = 'click' AND value > 80),
position_requests AS (SELECT user_id, k // 10 AS position, event_id AS arrival FROM ev
      WHERE event_type = 'error' AND value > 80),
prompt_changes AS (SELECT user_id, 'Be number ' || k AS system_prompt, ts, event_id AS seq FROM ev
      WHERE event_type = 'view' AND value > 150),
reset_requests AS (SELECT user_id, CASE WHEN k < 70 THEN 'system-prompt' WHEN k < 90 THEN 'mood' END
        AS parameter, ts, event_id AS seq FROM ev WHERE event_type = 'purchase' AND value > 120),
param_changes AS (SELECT user_id, coalesce([{_LISTED}][k // 5 + 1], 'volume') AS parameter,
        CASE event_type WHEN 'view' THEN CAST(k AS VARCHAR)
          WHEN 'click' THEN ' ' || value || ' ' WHEN 'signup' THEN '1_' || k
          WHEN 'error' THEN CASE WHEN value < 10 THEN 'Yes' WHEN value < 20 THEN 'F'
            WHEN value < 30 THEN ' true ' ELSE k || 'd' END
          ELSE CASE WHEN value < 10 THEN 'nan' WHEN value < 20 THEN '-inf'
            WHEN value < 30 THEN '12345678901234567890' ELSE k || '.5e1' END END AS raw_value,
        ts, event_id AS seq FROM ev),
get_requests AS (SELECT event_id, user_id, CASE WHEN k < 30 THEN 'system-prompt'
        WHEN k < 60 THEN 'mood' END AS parameter FROM ev WHERE event_type = 'view'),
chat AS (SELECT event_id, ts, user_id AS author_id, event_type = 'error' AS is_self,
        value >= 20 AS is_dm,
        CASE WHEN k < 8 THEN '$llm' WHEN k < 16 THEN '$$llm-help'
          WHEN k < 24 THEN '$llm hello ' || event_type
          WHEN k < 34 THEN '$llm-set-param system-prompt Be ' || event_type || ' ' || k
          WHEN k < 38 THEN '$llm-set-param system-prompt' WHEN k < 42 THEN '$llm-set-param'
          WHEN k < 48 THEN '$llm-set-param top_k ' || k
          WHEN k < 54 THEN '$llm-get-param system-prompt' WHEN k < 58 THEN '$llm-get-param'
          WHEN k < 62 THEN '$llm-get-param mood'
          WHEN k < 68 THEN '$llm-reset-param system-prompt' WHEN k < 71 THEN '$llm-reset-param'
          WHEN k < 74 THEN '$llm-reset-param mood' WHEN k < 78 THEN '$llm-reset'
          WHEN k < 83 THEN '$llm-refresh' WHEN k < 87 THEN '$llm-stats'
          WHEN k < 92 THEN '$nope ' || event_type WHEN k < 97 THEN event_type || ' you'
          ELSE '$llm ' END AS content FROM ev),
commands(command_key, cmd, requires_admin) AS (VALUES {_COMMANDS}),
parted AS (SELECT *, ltrim(content, '$') AS bare FROM chat),
named AS (SELECT *, string_split(bare, ' ')[1] AS word,
        CASE WHEN contains(bare, ' ') THEN bare[strpos(bare, ' ') + 1:] END AS rest FROM parted),
routed AS (SELECT event_id, ts, author_id AS user_id,
        CASE WHEN heard AND key IS NOT NULL THEN key WHEN heard AND is_dm THEN 'inference'
          WHEN heard THEN word END AS command_key,
        CASE WHEN heard AND key IS NULL AND is_dm THEN content WHEN heard THEN rest END AS arguments,
        CASE WHEN NOT heard THEN 'ignored' WHEN key = 'inference' AND rest IS NULL THEN 'usage'
          WHEN key IS NOT NULL THEN 'command' WHEN is_dm THEN 'dm_inference' ELSE 'unknown' END AS route
      FROM (SELECT named.*, command_key AS key,
              NOT is_self AND (is_dm OR content[1] = '$') AS heard
            FROM named LEFT JOIN commands ON word = cmd)),
allowed AS (SELECT r.*, route <> 'command' OR NOT coalesce(requires_admin, false)
        OR user_id IN ({", ".join(map(str, ADMINS))}) AS allowed
      FROM routed r LEFT JOIN commands USING (command_key)),
updates AS (SELECT user_id AS reply_id, ts, event_id AS seq,
        CASE event_type WHEN 'signup' THEN '  ' ELSE event_type || k END AS message,
        event_type = 'click' AND value > 50 AS new_message,
        event_type = 'purchase' AND value > 60 AS end_of_message,
        event_type = 'error' AND value > 80 AS end_of_response FROM ev),
turns AS (SELECT event_id + {NEW_IDS} AS turn_id, user_id, 'ask ' || k AS prompt,
        CASE WHEN value < 30 THEN 'reply ' || k END AS answer, ts
      FROM ev WHERE event_type IN ('view', 'purchase')),
fenced AS (SELECT doc_id, CASE WHEN lang = 'en' THEN '```' || source || chr(10) || text || chr(10)
        || '```' || chr(10) || 'end' ELSE text END AS text FROM documents),
chunks AS (SELECT id AS response_id, s - 1 AS seq, words[s] AS content, s = len(words) AS stop, "timestamp" AS ts
      FROM (SELECT id, words, "timestamp", unnest(range(1, len(words) + 1)) AS s
            FROM (SELECT id, "timestamp", regexp_extract_all(message, '[^ \\n]*[ \\n]|[^ \\n]+$') AS words FROM m)))
"""


def _oracle(name: str, select: str, ctes: str = "", recursive: bool = False) -> None:
    more = f",\n{ctes.strip()}" if ctes else ""
    ORACLES[name] = f"WITH {'RECURSIVE ' if recursive else ''}{_BASE.strip()}{more}\n{select.strip()}"


_MESSAGE = 'id, user_id, "timestamp", position, role, message'

_oracle("lookup_users", "SELECT *, false AS penalize_nl FROM u WHERE id IN (SELECT user_id FROM ev)")
_oracle("lookup_messages", "SELECT * FROM m WHERE id IN (SELECT id FROM message_requests)")
_oracle(
    "nth_messages",
    "SELECT * FROM m WHERE EXISTS (SELECT 1 FROM position_requests r "
    "WHERE r.user_id = m.user_id AND r.position = m.position)",
)
_oracle(
    "messages_after",
    "SELECT m.*, from_position FROM m JOIN (SELECT user_id, min(position) AS from_position "
    "FROM position_requests GROUP BY 1) c ON m.user_id = c.user_id WHERE m.position > from_position",
)
_oracle(
    "users_exist",
    "SELECT DISTINCT user_id AS id, user_id IN (SELECT id FROM u) AS user_exists FROM ev",
)
_oracle(
    "users_have_messages",
    "SELECT DISTINCT user_id, user_id IN (SELECT user_id FROM m) AS has_messages FROM ev",
)
_oracle(
    "next_positions",
    "SELECT k.user_id, CAST(count(m.id) AS BIGINT) AS next_position "
    "FROM (SELECT DISTINCT user_id FROM ev) k LEFT JOIN m USING (user_id) GROUP BY 1",
)
_oracle(
    "user_histories",
    "SELECT * FROM m WHERE user_id IN (SELECT id FROM user_requests) ORDER BY user_id, position",
)
_oracle(
    "last_messages",
    "SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY position DESC) = 1",
)

_FIRST_NEW = """first_new AS (SELECT * FROM new_users
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY arrival) = 1),
grown AS (SELECT id, system_prompt FROM u UNION ALL
  SELECT id, coalesce(system_prompt, '%s') FROM first_new WHERE id NOT IN (SELECT id FROM u))""" % DEFAULT_PROMPT
_oracle("add_users", "SELECT * FROM grown", _FIRST_NEW)
_oracle(
    "add_users_status",
    "SELECT n.id, n.arrival, n.id NOT IN (SELECT id FROM u) AND n.arrival = f.arrival AS created "
    "FROM new_users n JOIN first_new f USING (id)",
    _FIRST_NEW,
)
_oracle(
    "get_or_create_users",
    "SELECT * FROM grown WHERE id IN (SELECT id FROM new_users)",
    _FIRST_NEW,
)
_oracle("delete_users", "SELECT * FROM u WHERE id NOT IN (SELECT id FROM user_requests)")
_oracle("delete_users_messages", "SELECT * FROM m WHERE user_id NOT IN (SELECT id FROM user_requests)")
_oracle(
    "delete_users_status",
    "SELECT id, arrival, id IN (SELECT id FROM u) AND "
    "row_number() OVER (PARTITION BY id ORDER BY arrival) = 1 AS deleted FROM user_requests",
)
_oracle(
    "change_default_prompt",
    f"SELECT id, CASE WHEN system_prompt = '{DEFAULT_PROMPT}' THEN '{NEW_DEFAULT}' "
    "ELSE system_prompt END AS system_prompt FROM u",
)
_oracle(
    "change_default_prompt_count",
    f"SELECT count(*) AS rows_changed FROM u WHERE system_prompt = '{DEFAULT_PROMPT}'",
)
_LAST_PROMPT = """last_prompt AS (SELECT user_id, system_prompt FROM prompt_changes
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, seq DESC) = 1)"""
_oracle(
    "change_user_prompts",
    "SELECT coalesce(u.id, p.user_id) AS id, coalesce(p.system_prompt, u.system_prompt) AS system_prompt "
    "FROM u FULL JOIN last_prompt p ON u.id = p.user_id",
    _LAST_PROMPT,
)
_oracle(
    "change_user_prompts_messages",
    'SELECT m.id, m.user_id, "timestamp", position, role, CASE WHEN role = \'system\' THEN '
    "coalesce(p.system_prompt, message) ELSE message END AS message "
    "FROM m LEFT JOIN last_prompt p ON m.user_id = p.user_id",
    _LAST_PROMPT,
)
_oracle(
    "change_user_prompts_rejected",
    "SELECT * FROM prompt_changes WHERE user_id NOT IN (SELECT id FROM u)",
)
_oracle(
    "reset_params",
    f"""SELECT id, CASE WHEN id IN (SELECT user_id FROM reset_requests WHERE parameter = 'system-prompt')
    THEN '{NEW_DEFAULT}' ELSE system_prompt END AS system_prompt FROM u
    UNION ALL SELECT DISTINCT user_id, '{NEW_DEFAULT}' FROM reset_requests
    WHERE parameter = 'system-prompt' AND user_id NOT IN (SELECT id FROM u)""",
)
_oracle(
    "reset_params_status",
    "SELECT *, CASE WHEN parameter IS NULL THEN 'Missing parameter name!' "
    "WHEN parameter = 'system-prompt' THEN 'ok' ELSE 'Unknown parameter: ' || parameter END AS status "
    "FROM reset_requests",
)

_APPENDED = """good AS (SELECT * FROM new_messages WHERE role <> 'robot'),
counts AS (SELECT user_id, count(*) AS n FROM m GROUP BY 1)"""
_oracle(
    "append_messages",
    f"""SELECT {_MESSAGE} FROM m UNION ALL SELECT id, g.user_id, "timestamp",
    coalesce(n, 0) + row_number() OVER (PARTITION BY g.user_id ORDER BY arrival) - 1, role, message
    FROM good g LEFT JOIN counts ON g.user_id = counts.user_id""",
    _APPENDED,
)
_oracle(
    "append_messages_users",
    f"SELECT * FROM u UNION ALL SELECT DISTINCT user_id, '{DEFAULT_PROMPT}' FROM good "
    "WHERE user_id NOT IN (SELECT id FROM u)",
    _APPENDED,
)
_oracle(
    "append_messages_rejected",
    "SELECT * FROM new_messages WHERE role = 'robot' OR user_id NOT IN (SELECT id FROM u)",
)
_oracle(
    "delete_messages",
    'SELECT id, user_id, "timestamp", row_number() OVER (PARTITION BY user_id ORDER BY position) - 1 '
    "AS position, role, message FROM m WHERE id NOT IN (SELECT id FROM message_requests)",
)
_oracle(
    "delete_messages_status",
    "SELECT id, arrival, id IN (SELECT id FROM m) AND "
    "row_number() OVER (PARTITION BY id ORDER BY arrival) = 1 AS deleted FROM message_requests",
)
_FOLDED = """asked AS (SELECT user_id, position, arrival,
    row_number() OVER (PARTITION BY user_id ORDER BY arrival) AS n FROM position_requests),
lists AS (SELECT user_id, list(id ORDER BY position) AS ids FROM m GROUP BY 1),
folded(user_id, n, ids, arrival, position, deleted) AS (
  SELECT q.user_id, 0::BIGINT, coalesce(ids, []), NULL::BIGINT, NULL::BIGINT, NULL::BOOLEAN
  FROM (SELECT DISTINCT user_id FROM asked) q LEFT JOIN lists USING (user_id)
  UNION ALL
  SELECT f.user_id, f.n + 1,
    CASE WHEN a.position < len(f.ids) THEN f.ids[:a.position] || f.ids[a.position + 2:] ELSE f.ids END,
    a.arrival, a.position, a.position < len(f.ids)
  FROM folded f JOIN asked a ON a.user_id = f.user_id AND a.n = f.n + 1)"""
_oracle(
    "delete_by_position",
    """SELECT m.id, m.user_id, "timestamp",
      row_number() OVER (PARTITION BY m.user_id ORDER BY position) - 1 AS position, role, message
    FROM m LEFT JOIN (SELECT user_id, arg_max(ids, n) AS left_over FROM folded GROUP BY 1) f
      ON m.user_id = f.user_id
    WHERE f.user_id IS NULL OR list_contains(left_over, m.id)""",
    _FOLDED,
    recursive=True,
)
_oracle(
    "delete_by_position_status",
    "SELECT user_id, arrival, position, deleted FROM folded WHERE n > 0",
    _FOLDED,
    recursive=True,
)
_oracle("clear_messages", "SELECT * FROM m WHERE user_id NOT IN (SELECT id FROM user_requests)")

_NUMBER = r"regexp_replace(raw_value, '[_\s]', '', 'g')"
_CHECKED = f"""checked AS (SELECT *, CASE WHEN parameter IN {_OF_KIND["double"]}
      AND regexp_matches(raw_value, '{_DBL}') THEN TRY_CAST({_NUMBER} AS DOUBLE) END AS d,
    CASE WHEN parameter IN {_OF_KIND["bigint"]} AND regexp_matches(raw_value, '{_INT}')
      THEN TRY_CAST({_NUMBER} AS BIGINT) END AS i,
    CASE WHEN parameter = 'penalize_nl' THEN CASE WHEN lower(raw_value) IN ('1', 'true', 't', 'yes', 'y')
      THEN true WHEN lower(raw_value) IN ('0', 'false', 'f', 'no', 'n') THEN false END END AS b
  FROM param_changes),
judged AS (SELECT *, d IS NOT NULL OR i IS NOT NULL OR b IS NOT NULL AS valid,
    CASE WHEN isnan(d) THEN NULL ELSE d END AS dv FROM checked)"""
_CELLS = ",\n".join(
    f"arg_max_null({ {'double': 'dv', 'bigint': 'i', 'boolean': 'b'}[kind] }, seq) "
    f"FILTER (WHERE valid AND parameter = '{name}') AS {name}"
    for name, kind in PARAMETERS.items()
)
_oracle(
    "apply_param_changes",
    f"""SELECT id, system_prompt, {", ".join(PARAMETERS)} FROM
    (SELECT id, system_prompt FROM u UNION ALL SELECT DISTINCT user_id, '{DEFAULT_PROMPT}' FROM ev
     WHERE user_id NOT IN (SELECT id FROM u)) known
    LEFT JOIN (SELECT user_id, {_CELLS} FROM judged GROUP BY user_id) w ON known.id = w.user_id""",
    _CHECKED,
)
_oracle(
    "param_audit",
    """SELECT user_id, parameter, raw_value, ts, seq,
      CASE WHEN parameter = 'samplers' THEN 'Samplers order configuration is currently WIP'
        WHEN parameter = 'volume' THEN 'Unknown parameter: volume'
        WHEN valid THEN 'ok' ELSE 'Invalid ' || parameter || ': ' || raw_value END AS status,
      coalesce(CAST(old.i AS VARCHAR), CAST(old.b AS VARCHAR)) AS old_value,
      coalesce(CAST(now.i AS VARCHAR), CAST(now.b AS VARCHAR)) AS new_value,
      old.dv AS old_value_number, now.dv AS new_value_number
    FROM (SELECT *, CASE WHEN valid THEN cell ELSE old END AS now FROM (
      SELECT *, last_value(CASE WHEN valid THEN cell END IGNORE NULLS) OVER (PARTITION BY user_id, parameter
        ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS old
      FROM (SELECT *, {'dv': dv, 'i': i, 'b': b} AS cell FROM judged)))""",
    _CHECKED,
)
_oracle("apply_param_rejected", "SELECT * FROM param_changes WHERE user_id NOT IN (SELECT id FROM u)")
_oracle(
    "get_params",
    """SELECT event_id, user_id, parameter, CASE WHEN parameter = 'system-prompt'
      THEN 'Your system prompt is `' || system_prompt || '`'
      WHEN parameter IS NULL THEN '* **System prompt**: `' || system_prompt || '`'
      ELSE 'Unknown parameter: ' || parameter END AS reply
    FROM get_requests JOIN u ON u.id = user_id""",
)

_PROMPTS = """prompts AS (SELECT user_id, count(*) AS messages,
    string_agg('<|im_start|>' || role || chr(10) || message || '<|im_end|>' || chr(10), '' ORDER BY position)
    || CASE WHEN arg_max(role, position) = 'user' THEN '<|im_start|>assistant' || chr(10) ELSE '' END AS prompt
  FROM m GROUP BY user_id)"""
_oracle("format_chats", "SELECT user_id, prompt FROM prompts", _PROMPTS)
_oracle(
    "user_stats",
    """SELECT user_id, messages, length(prompt) AS prompt_chars, prompt_tokens,
      8192::BIGINT AS context_length, CAST(prompt_tokens AS DOUBLE) / 8192 * 100 AS context_percent
    FROM (SELECT *, len(regexp_extract_all(prompt, '[A-Za-z0-9_]+|[^A-Za-z0-9_ \\t\\n\\r]')) AS prompt_tokens
          FROM prompts)""",
    _PROMPTS,
)
_oracle(
    "stats_replies",
    """SELECT user_id, 'Messages in chat history (including system prompt): ' || messages || chr(10)
      || 'Current prompt length (tokens): ' || tokens || '/8192 ('
      || printf('%.2f', CAST(tokens AS DOUBLE) / 8192 * 100) || '% of available context used)' || chr(10)
      || 'Current prompt length (characters): ' || length(prompt) AS reply
    FROM (SELECT *, len(regexp_extract_all(prompt, '[A-Za-z0-9_]+|[^A-Za-z0-9_ \\t\\n\\r]')) AS tokens
          FROM prompts)""",
    _PROMPTS,
)


def _rindex(text: str, separator: str) -> str:
    """0-based last index by way of the part behind it; NULL without any."""
    tail = f"length(string_split({text}, {separator})[-1])"
    at = f"length({text}) - {tail} - length({separator})"
    return f"CASE WHEN contains({text}, {separator}) THEN {at} END"


_LINE, _STOP, _SPACE = "chr(10)", "'. '", "' '"
_oracle(
    "last_separators",
    f"""SELECT doc_id, CASE WHEN l > 0 THEN l WHEN s > 0 THEN s WHEN w > 0 THEN w END AS position,
      CASE WHEN l > 0 THEN chr(10) WHEN s > 0 THEN '. ' WHEN w > 0 THEN ' ' END AS separator
    FROM (SELECT doc_id, {_rindex("text", _LINE)} AS l, {_rindex("text", _STOP)} AS s,
          {_rindex("text", _SPACE)} AS w FROM documents)""",
)


def _fences(text: str) -> str:
    return f"(length({text}) - length(replace({text}, '```', ''))) // 3"


_oracle(
    "open_fences",
    f"""SELECT doc_id, {_fences("text")} % 2 = 1 AS whole FROM fenced""",
)


def _cut(source: str, columns: str, text: str, limit: int) -> str:
    """One cut of ``text``: columns, done, first and rest."""
    tag_end = "strpos(fence_line, chr(10))"
    return f"""SELECT {columns}, length({text}) < {limit} AS short,
      CASE WHEN length({text}) < {limit} THEN {text}
        WHEN stuck AND {_fences("w")} % 2 = 1 THEN w || chr(10) || '```'
        WHEN stuck THEN w WHEN opened IS NULL THEN head ELSE head || chr(10) || '```' END AS first,
      CASE WHEN length({text}) < {limit} THEN NULL
        WHEN stuck AND {_fences("w")} % 2 = 1 THEN '```' || chr(10) || substr({text}, {limit} + 1)
        WHEN stuck THEN substr({text}, {limit} + 1)
        ELSE coalesce(opened, '') || substr({text}, used + 1) END AS rest
    FROM (SELECT *, coalesce(length(opened) >= used, false) AS stuck
    FROM (SELECT *, CASE WHEN {_fences("head")} % 2 = 1 THEN '```' || CASE WHEN {tag_end} >= 2
            THEN left(fence_line, {tag_end} - 1) ELSE '' END || chr(10) END AS opened
    FROM (SELECT *, string_split(head, '```')[-1] AS fence_line
    FROM (SELECT *, CASE WHEN l > 0 THEN left(w, l) WHEN s > 0 THEN left(w, s + 1)
            WHEN b > 0 THEN left(w, b) ELSE w END AS head,
          CASE WHEN l > 0 THEN l + 1 WHEN s > 0 THEN s + 2 WHEN b > 0 THEN b + 1 ELSE {limit} END AS used
    FROM (SELECT * REPLACE (CASE WHEN l >= fence_end THEN l END AS l, CASE WHEN s >= fence_end THEN s END AS s,
            CASE WHEN b >= fence_end THEN b END AS b)
    FROM (SELECT *, {_rindex("w", _LINE)} AS l, {_rindex("w", _STOP)} AS s, {_rindex("w", _SPACE)} AS b,
            CASE WHEN starts_with(w, '```') THEN strpos(w, chr(10)) ELSE 0 END AS fence_end
    FROM (SELECT *, left({text}, {limit}) AS w FROM {source})))))))"""


_oracle(
    "split_once",
    f"SELECT doc_id, first, rest FROM ({_cut('fenced', 'doc_id', 'text', SHORT_LIMIT)})",
)


def _splits(source: str, limit: int) -> dict[str, str]:
    return {
        "select": "SELECT doc_id, n - 1 AS segment_no, first AS segment FROM steps "
        "WHERE n > 0 AND NOT (n > 1 AND short AND first = '')",
        "ctes": f"""steps(doc_id, n, short, first, rest) AS (
          SELECT doc_id, 0::BIGINT, false, NULL::VARCHAR, text FROM {source} WHERE text IS NOT NULL
          UNION ALL
          {_cut("(SELECT doc_id, n, rest AS body FROM steps WHERE rest IS NOT NULL)", "doc_id, n + 1", "body", limit)})""",
        "recursive": True,
    }


_oracle("split_texts", **_splits("documents", LENGTH_LIMIT))
_oracle("split_fenced_texts", **_splits("fenced", SHORT_LIMIT))

_oracle("route_commands", "SELECT * FROM routed")
_oracle("route_streamed_events", "SELECT * FROM routed")
_oracle("check_permissions", "SELECT * FROM allowed")
_oracle(
    "parse_param_commands",
    """SELECT event_id, ts, user_id,
      CASE WHEN contains(arguments, ' ') THEN string_split(arguments, ' ')[1] END AS parameter,
      CASE WHEN contains(arguments, ' ') THEN arguments[strpos(arguments, ' ') + 1:] END AS raw_value,
      CASE WHEN arguments IS NULL THEN 'missing_args' WHEN contains(arguments, ' ') THEN 'ok'
        ELSE 'missing_value' END AS status
    FROM routed WHERE route = 'command' AND command_key = 'set-param'""",
)
_oracle(
    "removal_reactions",
    f"""SELECT event_id, k AS message_id, {BOT}::BIGINT AS message_author_id, user_id, '💀' AS emoji,
      CASE WHEN k < 30 THEN 'text' WHEN k < 50 THEN 'direct' WHEN k < 60 THEN 'group' ELSE 'thread' END
        AS channel_kind
    FROM ev WHERE event_type IN ('view', 'click', 'error') AND user_id <> {BOT} AND value < 30 AND k < 70""",
)
_oracle(
    "iso_times",
    """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S')
      || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END AS text, ts
    FROM events""",
)

_oracle(
    "assemble_responses",
    "SELECT id AS response_id, message AS response, chunks, true AS complete FROM m "
    "JOIN (SELECT response_id, count(*)::BIGINT AS chunks FROM chunks GROUP BY 1) c ON c.response_id = m.id",
)
_oracle(
    "running_responses",
    """SELECT response_id, seq, content, string_agg(content, '') OVER (
      PARTITION BY response_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS response FROM chunks""",
)
_oracle("chunk_texts", "SELECT response_id, seq, content FROM chunks")

_THROTTLED = f"""ordered AS (SELECT *, row_number() OVER (PARTITION BY reply_id ORDER BY ts, seq) AS n,
    NOT new_message AND trim(message) <> '' AS may FROM updates),
walked(reply_id, n, edit, last) AS (
  SELECT DISTINCT reply_id, 0::BIGINT, false, TIMESTAMP '2024-01-01 00:00:00' FROM updates
  UNION ALL
  SELECT reply_id, n, edit, CASE WHEN edit THEN ts ELSE last END FROM (
    SELECT o.reply_id, o.n, o.ts, w.last, o.may AND (o.end_of_message
      OR epoch_us(o.ts) - epoch_us(w.last) >= {COOLDOWN_MS * 1000}) AS edit
    FROM walked w JOIN ordered o ON o.reply_id = w.reply_id AND o.n = w.n + 1)),
shown AS (SELECT o.*, w.edit FROM ordered o JOIN walked w USING (reply_id, n))"""
_ACTIONS = """SELECT reply_id, seq, ts, message, 'reply' AS action FROM shown WHERE new_message
UNION ALL SELECT reply_id, seq, ts, message, 'edit' FROM shown WHERE edit
UNION ALL SELECT reply_id, seq, ts, message, 'final' FROM shown WHERE end_of_response"""
_oracle("throttle_updates", _ACTIONS, _THROTTLED, recursive=True)
_oracle("throttle_streamed_updates", _ACTIONS, _THROTTLED, recursive=True)

_SEGMENTED = f"""filled(response_id, seq, no, closed, buffer) AS (
  SELECT DISTINCT response_id, -1::BIGINT, 0::BIGINT, NULL::VARCHAR, '' FROM chunks
  UNION ALL
  SELECT response_id, seq, CASE WHEN short THEN no ELSE no + 1 END,
    CASE WHEN short THEN NULL ELSE first END, CASE WHEN short THEN first ELSE rest END
  FROM ({_cut('''(SELECT f.response_id, c.seq, f.no, f.buffer || c.content AS body FROM filled f
      JOIN chunks c ON c.response_id = f.response_id AND c.seq = f.seq + 1)''',
      "response_id, seq, no", "body", STREAM_LIMIT)}))"""
_SEGMENTS = """SELECT f.response_id, f.seq, f.seq + no AS step, ts, length, no AS message_no, buffer AS message,
      content AS chunk, false AS end_of_message, stop AS end_of_response, closed IS NOT NULL AS new_message
    FROM filled f JOIN measured c USING (response_id, seq)
    UNION ALL SELECT f.response_id, f.seq, f.seq + no - 1, ts, length, no - 1, closed, NULL, true, false, false
    FROM filled f JOIN measured c USING (response_id, seq) WHERE closed IS NOT NULL"""
_MEASURED = """measured AS (SELECT *, (sum(length(content)) OVER (PARTITION BY response_id ORDER BY seq))::BIGINT AS length
  FROM chunks)"""
_oracle(
    "segment_streamed_chunks",
    f"""SELECT *, false AS incomplete, min(ts) OVER (PARTITION BY response_id) AS started_ts FROM ({_SEGMENTS})""",
    f"{_SEGMENTED},\n{_MEASURED}",
    recursive=True,
)
# A response's rows are shown in their own order; the first edit waits from its first chunk on.
_oracle(
    "show_streamed_answers",
    """SELECT response_id, step, ts, message, 'reply' AS action FROM decided WHERE new_message
    UNION ALL SELECT response_id, step, ts, message, 'edit' FROM decided WHERE edit
    UNION ALL SELECT response_id, step, ts, message, 'final' FROM decided WHERE end_of_response""",
    f"""{_SEGMENTED},
{_MEASURED},
steps AS (SELECT response_id, step, ts + to_milliseconds(seq * {CHUNK_MS}) AS ts, ts AS started, message, new_message,
    end_of_message, end_of_response, NOT new_message AND regexp_matches(message, '[^ \\t\\n]') AS may
  FROM ({_SEGMENTS}) WHERE response_id IN (SELECT id FROM m WHERE role = 'assistant')),
chained(response_id, step, edit, last) AS (
  SELECT DISTINCT response_id, -1::BIGINT, false, started FROM steps
  UNION ALL
  SELECT response_id, step, edit, CASE WHEN edit THEN ts ELSE last END FROM (
    SELECT s.response_id, s.step, s.ts, c.last, s.may AND (s.end_of_message
      OR epoch_us(s.ts) - epoch_us(c.last) >= {EDIT_MS * 1000}) AS edit
    FROM chained c JOIN steps s ON s.response_id = c.response_id AND s.step = c.step + 1)),
decided AS (SELECT s.*, c.edit FROM steps s JOIN chained c USING (response_id, step))""",
    recursive=True,
)

_STORED_TURNS = f"""known AS (SELECT * FROM u UNION ALL SELECT DISTINCT user_id, '{DEFAULT_PROMPT}' FROM turns
    WHERE user_id NOT IN (SELECT id FROM u)),
lines AS (SELECT turn_id * 3 + 1 AS step, user_id, ts AS "timestamp", 'user' AS role, prompt AS message FROM turns
  UNION ALL SELECT turn_id * 3 + 2, user_id, ts, 'assistant', answer FROM turns WHERE answer IS NOT NULL
  UNION ALL SELECT min(turn_id) * 3, user_id, arg_min(ts, turn_id), 'system', any_value(system_prompt)
    FROM turns JOIN known ON known.id = user_id
    WHERE user_id NOT IN (SELECT user_id FROM m) GROUP BY user_id),
counts AS (SELECT user_id, count(*) AS n FROM m GROUP BY 1)"""
_LINES = f"""SELECT {_MESSAGE} FROM m UNION ALL SELECT -1 - step, l.user_id, "timestamp",
  coalesce(n, 0) + row_number() OVER (PARTITION BY l.user_id ORDER BY step) - 1, role, message
  FROM lines l LEFT JOIN counts ON counts.user_id = l.user_id"""
_oracle("ingest_turns", _LINES, _STORED_TURNS)
_oracle(
    "append_after_turns",
    f"""SELECT {_MESSAGE} FROM told UNION ALL SELECT
    (SELECT max(id) FROM m) + row_number() OVER (ORDER BY arrival), g.user_id, "timestamp",
    coalesce(n, 0) + row_number() OVER (PARTITION BY g.user_id ORDER BY arrival) - 1, role, message
    FROM new_messages g LEFT JOIN (SELECT user_id, count(*) AS n FROM told GROUP BY 1) c
      ON g.user_id = c.user_id WHERE role <> 'robot'""",
    f"{_STORED_TURNS},\ntold AS ({_LINES})",
)
_oracle("store_streamed_turns", _LINES, _STORED_TURNS)
_oracle(
    "store_streamed_answers",
    """SELECT -1 - step AS id, user_id, "timestamp", row_number() OVER (PARTITION BY user_id ORDER BY step) - 1 AS position,
      role, message
    FROM (SELECT 3 * id + 2 AS step, user_id, asked_at AS "timestamp", role, message FROM answers
      UNION ALL SELECT 3 * id + 1, user_id, asked_at, 'user', asked FROM answers
      UNION ALL SELECT 3 * min(answers.id), user_id, arg_min(asked_at, answers.id), 'system', any_value(system_prompt)
        FROM answers JOIN u ON u.id = user_id GROUP BY user_id)""",
    """answers AS (SELECT a.*, b.message AS asked, b."timestamp" AS asked_at
      FROM m a JOIN m b ON b.id = a.id - 1 WHERE a.role = 'assistant')""",
)
_oracle("ingest_turns_users", "SELECT * FROM known", _STORED_TURNS)

_APPLIED = f"""steps AS (SELECT *, CASE WHEN command_key = 'set-param' THEN string_split(arguments, ' ')[1]
      ELSE arguments END AS parameter,
    CASE WHEN command_key = 'reset-param' THEN '{DEFAULT_PROMPT}'
      WHEN contains(arguments, ' ') THEN arguments[strpos(arguments, ' ') + 1:] END AS given
  FROM allowed WHERE route = 'command' AND allowed
    AND command_key IN ('set-param', 'get-param', 'reset-param', 'reset-conversation')),
writes AS (SELECT * FROM steps WHERE command_key IN ('set-param', 'reset-param')
    AND parameter = 'system-prompt' AND given IS NOT NULL),
last_write AS (SELECT user_id, arg_max(given, event_id) AS given FROM writes GROUP BY 1),
everyone AS (SELECT * FROM u UNION ALL SELECT DISTINCT user_id, '{DEFAULT_PROMPT}' FROM steps
  WHERE user_id NOT IN (SELECT id FROM u) AND (command_key = 'get-param'
    OR (command_key = 'set-param' AND given IS NOT NULL)
    OR (command_key = 'reset-param' AND parameter = 'system-prompt')))"""
_PROMPTED = """SELECT id, coalesce(given, system_prompt) AS system_prompt
FROM everyone LEFT JOIN last_write ON user_id = id"""
_oracle("apply_commands", _PROMPTED, _APPLIED)
_oracle("apply_streamed_commands", _PROMPTED, _APPLIED)
_oracle("streamed_user_states", _PROMPTED, _APPLIED)
_oracle(
    "apply_commands_messages",
    """SELECT m.id, m.user_id, "timestamp", position, role, CASE WHEN role = 'system'
      THEN coalesce(given, message) ELSE message END AS message
    FROM m LEFT JOIN last_write w ON w.user_id = m.user_id
    WHERE m.user_id NOT IN (SELECT user_id FROM steps WHERE command_key = 'reset-conversation')""",
    _APPLIED,
)
_REPLIES = """SELECT s.event_id, s.user_id, s.command_key, CASE
      WHEN s.command_key = 'reset-conversation' THEN 'Message history cleared!'
      WHEN s.command_key = 'set-param' AND s.arguments IS NULL THEN 'Missing parameter name and new value!'
      WHEN s.command_key = 'reset-param' AND s.arguments IS NULL THEN 'Missing parameter name!'
      WHEN s.command_key = 'set-param' AND s.given IS NULL THEN 'Missing value of the parameter!'
      WHEN s.command_key = 'get-param' AND parameter IS NULL
        THEN '* **System prompt**: `' || coalesce(before, system_prompt) || '`'
      WHEN s.command_key = 'get-param' AND parameter = 'system-prompt'
        THEN 'Your system prompt is `' || coalesce(before, system_prompt) || '`'
      WHEN parameter = 'system-prompt' THEN concat('Updated system prompt!', chr(10), 'Old: ```', chr(10),
        coalesce(before, system_prompt), chr(10), '```', chr(10), 'New: ```', chr(10), s.given, '```')
      ELSE 'Unknown parameter: ' || parameter END AS reply
    FROM (SELECT s.*, (SELECT arg_max(w.given, w.event_id) FROM writes w
            WHERE w.user_id = s.user_id AND w.event_id < s.event_id) AS before FROM steps s) s
    LEFT JOIN everyone e ON e.id = s.user_id"""
_oracle("apply_commands_replies", _REPLIES, _APPLIED)
_oracle("streamed_command_replies", _REPLIES, _APPLIED)
# A history that is cleared begins anew with the turns behind the clearing, under the last prompt.
_oracle(
    "store_turns_and_commands",
    """SELECT id, user_id, "timestamp", row_number() OVER (PARTITION BY user_id ORDER BY stored DESC, place) - 1 AS position,
      role, message
    FROM (SELECT id, user_id, "timestamp", true AS stored, position AS place, role,
        CASE WHEN role = 'system' THEN coalesce(given, message) ELSE message END AS message
      FROM kept LEFT JOIN last_write USING (user_id)
      UNION ALL SELECT -1 - step, user_id, "timestamp", false, step, role, message FROM later)""",
    f"""{_APPLIED},
clears AS (SELECT user_id, max((ts, event_id)) AS cleared FROM steps WHERE command_key = 'reset-conversation' GROUP BY 1),
kept AS (SELECT * FROM m WHERE user_id NOT IN (SELECT user_id FROM clears)),
since AS (SELECT t.* FROM turns t LEFT JOIN clears USING (user_id) WHERE cleared IS NULL OR (t.ts, t.turn_id) > cleared),
prompts AS (SELECT id, coalesce(given, system_prompt) AS system_prompt FROM (SELECT * FROM u UNION ALL
    SELECT DISTINCT user_id, '{DEFAULT_PROMPT}' FROM turns WHERE user_id NOT IN (SELECT id FROM u)) k
  LEFT JOIN last_write ON user_id = id),
later AS (SELECT turn_id * 3 + 1 AS step, user_id, ts AS "timestamp", 'user' AS role, prompt AS message FROM since
  UNION ALL SELECT turn_id * 3 + 2, user_id, ts, 'assistant', answer FROM since WHERE answer IS NOT NULL
  UNION ALL SELECT min(turn_id) * 3, user_id, arg_min(ts, turn_id), 'system', any_value(system_prompt)
    FROM since JOIN prompts ON prompts.id = user_id
    WHERE user_id NOT IN (SELECT user_id FROM kept) GROUP BY user_id)""",
)

_oracle("read_stored_users", "SELECT *, false AS penalize_nl FROM u")
_MISSES = "role IS NULL OR message IS NULL OR user_id IS NULL OR position IS NULL"
_oracle("read_stored_messages", f"SELECT * FROM m WHERE NOT ({_MISSES})")
_oracle(
    "read_stored_messages_rejected",
    f"""SELECT doc_id + {NEW_IDS} AS id, doc_id AS user_id, '2024-01-01T00:00:00' AS "timestamp",
      0::BIGINT AS position, lang AS role, text AS message, NULL::VARCHAR AS raw_line FROM documents
    UNION ALL SELECT event_id + 2 * {NEW_IDS}, user_id, event_type, k, 'user', event_type, NULL FROM ev
    UNION ALL SELECT id, user_id, strftime("timestamp", '%Y-%m-%dT%H:%M:%S'), position, role, message, NULL FROM m WHERE {_MISSES}
    UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, '{{"id":' || page_id || ',"message":"' || url FROM pages WHERE url IS NOT NULL""",
)
_oracle("snapshot_users", "SELECT * FROM u")
_oracle("snapshot_messages", "SELECT * FROM m")
_oracle("streamed_events", "SELECT * FROM chat")
