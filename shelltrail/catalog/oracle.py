"""The same results as ``queries`` in plain SQL for an independent engine on the same tables."""

from __future__ import annotations

# The parameters of the queries and the fixed values of the policy, stated here once more, so that a wrong
# entry in the library shows.
HERE = "/home/u1/src/api"
CONTEXT = [
    ("PWD", "/home/u1/src/api"), ("HOME", "/home/u1"), ("USER", "u1"), ("SHELL", "/bin/bash"), ("TERM", "xterm"),
    ("ENVIRONMENT", "production"), ("NODE_ENV", "production"), ("AWS_PROFILE", "main"),
]
MAPPED = ["PWD", "HOME", "USER", "SHELL", "NODE_ENV", "LANG"]
ALLOWED = """
PWD OLDPWD USER HOME SHELL LANG LC_ALL TZ EDITOR PAGER BROWSER TMPDIR XDG_CONFIG_HOME XDG_DATA_HOME
XDG_CACHE_HOME NODE_ENV RAILS_ENV DJANGO_SETTINGS_MODULE FLASK_ENV ENVIRONMENT ENV STAGE DEPLOY_ENV
RBENV_VERSION PYENV_VERSION NVM_CURRENT JAVA_HOME GOPATH GOROOT CARGO_HOME RUSTUP_HOME AWS_PROFILE AWS_REGION
GOOGLE_CLOUD_PROJECT AZURE_RESOURCE_GROUP DOCKER_HOST KUBERNETES_NAMESPACE KUBECTL_CONTEXT CI GITHUB_ACTIONS
JENKINS_URL GITLAB_CI TRAVIS CIRCLECI
""".split()
DENIED = """
_ PS1 PS2 PS3 PS4 TERM LINES COLUMNS HISTFILE HISTSIZE HISTCONTROL HISTTIMEFORMAT IFS OPTIND OPTARG OPTERR
RANDOM SECONDS BASH_VERSINFO BASH_VERSION BASH_ARGC BASH_ARGV BASH_ARGV0 BASH_COMMAND BASH_EXECUTION_STRING
BASH_LINENO BASH_SOURCE BASH_SUBSHELL FUNCNAME BASH_REMATCH PIPESTATUS REPLY SHELLOPTS BASHOPTS
""".split()
AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"


def _quoted(values) -> str:
    return "(" + ", ".join(f"'{value}'" for value in values) + ")"


SPACE = r"\t-\r\x1c-\x20\x{85}\p{Z}"
WORD = rf"""(?:[^{SPACE}"'']|"[^"]*(?:"|\z)|''[^'']*(?:''|\z))+"""


def _strip(text: str) -> str:
    return rf"regexp_replace({text}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def _words(text: str) -> str:
    return f"regexp_extract_all({_strip(text)}, '{WORD}')"


def _name(text: str) -> str:
    return f"regexp_extract({_strip(text)}, '^{WORD}')"


def _terms(text: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({text}), '[^\p{{L}}\p{{M}}\p{{N}}_]+'), lambda t: t <> '')"


DENY = (
    r"^___PREEXEC_|^__|^BASH_FUNC_|^_$|^PS[1-4]$|^TERM$|^LINES$|^COLUMNS$|^HIST|^IFS$|^OPT|"
    r"^RANDOM$|^SECONDS$|^BASH_|^FUNCNAME$|^PIPESTATUS$|^REPLY$|^SHELLOPTS$|^BASHOPTS$"
)
ALLOW = (
    r"^[A-Z_]+_(ENV|ENVIRONMENT|STAGE|PROFILE|NAMESPACE|CLUSTER|REGION|ZONE|BRANCH|VERSION|PATH|HOME|ROOT|CONFIG|"
    r"URL|HOST|PORT|KEY)$|^(GIT_|DOCKER_|K8S_|KUBE_|HELM_|TERRAFORM_)"
)
SENSITIVE_ONLY_WORDS = (
    r"(?i)password|secret|key|token|auth|credential|private|session|cookie|cert|ssl|tls|oauth|jwt|bearer|access|"
    r"refresh|salt|hash|signature|license|serial"
)
SENSITIVE = SENSITIVE_ONLY_WORDS + "|url|dsn|connection|endpoint"


def _verdict(sensitive: str = SENSITIVE) -> str:
    return f"""CASE
      WHEN regexp_matches(key, '{DENY}') OR key IN {_quoted(DENIED)} THEN 'deny'
      WHEN NOT (key IN {_quoted(ALLOWED)} OR regexp_matches(key, '{ALLOW}')) THEN 'not_allowed'
      WHEN regexp_matches(key, '{sensitive}') THEN 'hash' ELSE 'plain' END"""


HASHED = "'h8_' || substr(sha256(value), 1, 8)"

# The command events of the sample table; env is a list of (key, value).
EVENTS = """
raw AS (
  SELECT event_id, ts, user_id, event_type, CAST(round(value) AS BIGINT) AS dur,
         CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k
  FROM events),
ev0 AS (
  SELECT event_id, k,
    CASE event_type
      WHEN 'click' THEN 'git commit -m "fix ' || (k % 10) || '"'
      WHEN 'view' THEN CASE WHEN k % 2 = 0 THEN 'ls -la' ELSE 'git status' END
      WHEN 'purchase' THEN 'docker run --rm app:' || (k % 5)
      WHEN 'signup' THEN CASE k % 4 WHEN 0 THEN 'cd ~/src' WHEN 1 THEN 'cd api' WHEN 2 THEN 'cd "/var/log"' ELSE 'cdrecord x' END
      WHEN 'error' THEN 'kubectl get pods -n ns' || (k % 3)
    END AS command,
    CAST(CASE WHEN event_type = 'error' AND k % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS return_code,
    ts AS start_timestamp, ts + to_milliseconds(dur) AS end_timestamp,
    '/home/u' || user_id || CASE k % 4 WHEN 0 THEN '/src/api' WHEN 1 THEN '/src/web' WHEN 2 THEN '/notes' ELSE '/code' END AS pwd,
    'host-' || (user_id % 7) AS hostname, 'u' || user_id AS "user", '/home/u' || user_id AS home,
    CASE WHEN k < 80 THEN '1.0.0' ELSE '1.0.1' END AS config_version
  FROM raw),
ev AS (
  SELECT *, lag(pwd) OVER (PARTITION BY "user" ORDER BY start_timestamp, event_id) AS oldpwd FROM ev0),
entries AS (
  SELECT event_id, hostname, "user", pwd, start_timestamp, e.key AS key, e.value AS value FROM (
    SELECT *, unnest([
      {'key': 'PWD', 'value': pwd}, {'key': 'HOME', 'value': home}, {'key': 'USER', 'value': "user"},
      {'key': 'SHELL', 'value': '/bin/bash'}, {'key': 'TERM', 'value': 'xterm'},
      {'key': 'ENVIRONMENT', 'value': CASE k % 3 WHEN 0 THEN 'production' WHEN 1 THEN 'staging' ELSE 'development' END},
      {'key': 'NODE_ENV', 'value': CASE k % 3 WHEN 0 THEN 'production' WHEN 1 THEN 'staging' ELSE 'development' END},
      {'key': 'API_KEY', 'value': 'secret' || k},
      {'key': 'DATABASE_URL', 'value': 'https://db' || (k % 5) || '.example.com/x'}]) AS e
    FROM ev)),
entries_old AS (
  SELECT * FROM entries
  UNION ALL SELECT event_id, hostname, "user", pwd, start_timestamp, 'OLDPWD', oldpwd FROM ev WHERE oldpwd IS NOT NULL)
"""


def _masked(source: str, name: str = "masked", sensitive: str = SENSITIVE) -> str:
    return f"""{name} AS (
  SELECT event_id, start_timestamp, key, CASE verdict WHEN 'hash' THEN {HASHED} ELSE value END AS value
  FROM (SELECT *, {_verdict(sensitive)} AS verdict FROM {source}) WHERE verdict IN ('hash', 'plain'))"""


SCALARS = "event_id, command, return_code, start_timestamp, end_timestamp, pwd, hostname, config_version"
SQL: dict[str, str] = {}


def _on_events(select: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([EVENTS.strip(), *ctes]) + "\n" + select


def _ev(name: str, select: str, *ctes: str) -> None:
    SQL[name] = _on_events(select, *ctes)


# -- sources, ingest, sinks --

WIRE = f"SELECT {SCALARS[len('event_id, '):]}, 'secret' || k AS api_key FROM ev"
_ev("read_events", WIRE)
_ev("stream_events", WIRE)
DAMAGED = """SELECT command, CASE WHEN event_id % 10 <> 6 THEN return_code END AS return_code, start_timestamp, pwd FROM ev WHERE event_id % 10 < 7"""
_ev("read_damaged_events", DAMAGED)
_ev("stream_damaged_events", DAMAGED)
_ev(
    "split_valid_invalid",
    """SELECT event_id, CASE WHEN event_id % 10 IN (7, 8) THEN 'invalid' ELSE 'valid' END AS status,
      CASE WHEN event_id % 10 NOT IN (7, 8) THEN command END AS command,
      CASE WHEN event_id % 10 NOT IN (6, 7, 8) THEN return_code END AS return_code,
      CASE WHEN event_id % 10 NOT IN (7, 8) THEN start_timestamp END AS start_timestamp
    FROM ev WHERE event_id % 10 <> 9""",
)
CAPTURED = """captured AS (
  SELECT event_id, hostname, "user", pwd, start_timestamp, key, value FROM entries
  UNION ALL SELECT event_id, hostname, "user", pwd, start_timestamp, e.key, e.value FROM (
    SELECT *, unnest([{'key': 'GIT_PAGER', 'value': 'a=b'}, {'key': 'GIT_EDITOR', 'value': ''}, {'key': 'CI', 'value': '2'}]) AS e
    FROM ev WHERE event_id % 10 = 5))"""
_ev(
    "decode_captures",
    """SELECT e.event_id, ' ' || e.command || ' ' AS command, e.pwd, e.start_timestamp, m.key, m.value
    FROM ev e JOIN masked m USING (event_id) WHERE event_id % 10 NOT IN (7, 8, 9)
    UNION ALL SELECT event_id, NULL, NULL, NULL, NULL, NULL FROM ev WHERE event_id % 10 IN (7, 8, 9)""",
    CAPTURED,
    _masked("captured"),
)
_ev(
    "decode_env_blobs",
    """SELECT event_id, key, value FROM masked WHERE event_id % 10 <> 7
    UNION ALL SELECT event_id, 'GIT_PAGER', 'a=b' FROM ev WHERE event_id % 10 <> 7
    UNION ALL SELECT event_id, NULL, NULL FROM ev WHERE event_id % 10 = 7""",
    _masked("entries"),
)
_ev(
    "assemble_events",
    """SELECT e.event_id, command, return_code, start_timestamp, end_timestamp, pwd,
      CASE WHEN e.event_id % 10 = 3 THEN 'unknown' ELSE hostname END AS hostname, '2.0.0' AS config_version,
      CAST(NULL AS VARCHAR) AS ip_address, CAST(n AS INTEGER) AS n_env, 'good' AS status
    FROM ev e JOIN (SELECT event_id, count(*) AS n FROM masked GROUP BY event_id) c USING (event_id)
    WHERE e.event_id % 10 NOT IN (6, 7, 8, 9)
    UNION ALL SELECT event_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'bad' FROM ev WHERE event_id % 10 = 6""",
    CAPTURED,
    _masked("captured"),
)
_ev(
    "write_history",
    f"""SELECT {SCALARS}, strftime(start_timestamp, '%Y-%m-%d') AS event_date
    FROM ev WHERE start_timestamp >= {AS_OF} - INTERVAL 72 HOUR""",
)
SQL["write_history_stream"] = SQL["write_history"]
_ev("rewrite_history", "SELECT event_id, '2.0.0' AS config_version, key, value FROM masked", _masked("entries"))
_ev(
    "ingest_metrics",
    """SELECT count(*) FILTER (event_id % 10 <> 9) AS received, count(*) FILTER (event_id % 10 NOT IN (7, 8, 9)) AS sent,
      count(*) FILTER (event_id % 10 IN (7, 8)) AS errors FROM ev""",
)

# -- projections, filters, predicates --

_ev("filter_by_directory", f"SELECT {SCALARS} FROM ev WHERE pwd = '{HERE}'")
_ev("successful_commands", f"SELECT {SCALARS} FROM ev WHERE return_code = 0")
_ev("failed_commands", f"SELECT {SCALARS} FROM ev WHERE return_code IS DISTINCT FROM 0")
_ev(
    "filter_time_range",
    f"""SELECT {SCALARS} FROM ev WHERE start_timestamp >= {AS_OF} - INTERVAL 100 HOUR
    AND start_timestamp <= TIMESTAMP '2024-01-30 12:00:00'""",
)
_ev(
    "filter_env_equals",
    f"""SELECT {SCALARS} FROM ev WHERE event_id IN
    (SELECT event_id FROM entries WHERE key = 'NODE_ENV' AND value = 'production')""",
)
_ev("filter_env_exists", f"SELECT {SCALARS} FROM ev WHERE oldpwd IS NOT NULL")
_ev(
    "events_with_hashed_env",
    f"SELECT {SCALARS} FROM ev WHERE event_id IN (SELECT event_id FROM masked WHERE value LIKE 'h8!_%' ESCAPE '!')",
    _masked("entries"),
)
_ev(
    "search_command_prefix",
    f"""SELECT event_id, command FROM ev
    WHERE len(list_filter({_terms('command')}, lambda t: starts_with(t, 'git'))) > 0""",
)
SQL["search_command_prefix_documents"] = f"""SELECT doc_id, lang FROM documents
WHERE len(list_filter({_terms('text')}, lambda t: starts_with(t, 'thre'))) > 0"""
_ev(
    "search_command_match",
    f"SELECT event_id, command FROM ev WHERE list_has_any({_terms('command')}, ['docker', 'pods', 'status'])",
)
SQL["search_command_match_conversations"] = f"""SELECT conv_id, turn, role FROM conversations
WHERE list_has_any({_terms('text')}, ['the', 'and', 'que'])"""
_ev("filter_subscription", f"SELECT {SCALARS} FROM ev WHERE hostname = 'host-3' AND return_code = 1")
_ev(
    "match_subscriptions",
    f"""SELECT n_name AS subscriber_id, {SCALARS} FROM ev, nation
    WHERE hostname = 'host-' || (n_nationkey % 7) AND (n_nationkey % 3 <> 0 OR return_code = 1)""",
)
_ev(
    "history_report",
    f"""SELECT event_id, CASE WHEN return_code <> 0 THEN 'fail' ELSE 'ok' END AS status, command,
      strftime(start_timestamp, '%H:%M:%S') AS started, date_diff('millisecond', start_timestamp, end_timestamp) AS duration_ms
    FROM ev WHERE pwd = '{HERE}' AND start_timestamp >= {AS_OF} - INTERVAL 720 HOUR
    ORDER BY start_timestamp DESC, event_id DESC LIMIT 25""",
)


def _live_view(pwd: str) -> str:
    return f"""CASE WHEN length({pwd}) > 20 AND len(string_split({pwd}, '/')) > 2
      THEN '.../' || array_to_string(string_split({pwd}, '/')[-2:], '/') ELSE {pwd} END"""


_ev(
    "live_view_rows",
    f"""SELECT event_id, CASE WHEN return_code <> 0 THEN 'fail' ELSE 'ok' END AS status,
      CASE WHEN length(command) > 50 THEN substr(command, 1, 47) || '...' ELSE command END AS command,
      {_live_view('pwd')} AS pwd, CAST(dur AS DOUBLE) AS duration_ms FROM ev JOIN (SELECT event_id, dur FROM raw) USING (event_id)""",
)
SQL["live_view_conversations"] = f"""
WITH c AS (SELECT conv_id * 1000 + turn AS event_id, role, text, '/chats/' || conv_id || '/' || role || '/' || turn AS pwd FROM conversations)
SELECT event_id, CASE WHEN role = 'user' THEN 'ok' ELSE 'fail' END AS status,
  CASE WHEN length(text) > 50 THEN substr(text, 1, 47) || '...' ELSE text END AS command,
  {_live_view('pwd')} AS pwd, 1000.0::DOUBLE AS duration_ms FROM c"""
_ev("project_source", 'SELECT pwd AS "env_PWD", start_timestamp FROM ev')

# -- environment policy --

_ev("classify_env_vars", f"SELECT event_id, key, value, {_verdict()} AS verdict FROM entries_old")
SQL["hash_values"] = """SELECT page_id, 'h8_' || substr(sha256(url), 1, 8) AS url,
'h8_' || substr(sha256(html), 1, 8) AS html FROM pages"""
_ev("mask_environment", "SELECT event_id, key, value FROM masked", _masked("entries_old"))
_ev(
    "mask_simple",
    f"""SELECT event_id, key, CASE WHEN regexp_matches(key, '(?i)secret|password|key') THEN {HASHED} ELSE value END AS value
    FROM entries""",
)
_ev(
    "capture_noise_filter",
    "SELECT event_id, key || '=' || value AS entry FROM entries UNION ALL SELECT event_id, 'PS3=kept' FROM ev",
)
_ev(
    "policy_audit",
    """SELECT key, verdict, n_events, 1 AS n_variables, CAST(verdict IN ('hash', 'plain') AS BIGINT) AS n_captured, 0 AS is_total FROM judged
    UNION ALL SELECT NULL, NULL, CAST(sum(n_events) AS BIGINT), count(*), count(*) FILTER (verdict IN ('hash', 'plain')), 1 FROM judged""",
    f"judged AS (SELECT key, {_verdict()} AS verdict, count(*) AS n_events FROM entries_old GROUP BY 1, 2)",
)
_ev(
    "leak_check",
    f"""SELECT key, count(*) AS n_events FROM (SELECT *, {_verdict()} AS verdict FROM lax)
    WHERE verdict = 'hash' AND NOT regexp_matches(value, '^h8_[a-f0-9]{{8}}$') GROUP BY key""",
    _masked("entries", "lax", SENSITIVE_ONLY_WORDS),
)

# -- joins --

CONTEXT_ROWS = "context(key, value) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in CONTEXT) + ")"
BOOST = """CASE WHEN key IN ('NODE_ENV', 'RAILS_ENV', 'ENVIRONMENT', 'AWS_PROFILE', 'KUBERNETES_NAMESPACE') THEN 3.0::DOUBLE
  WHEN key IN ('USER', 'HOME', 'SHELL') THEN 2.0 ELSE 1.5 END"""
SKIP = "(contains(key, 'HIST') OR contains(key, 'LESS') OR contains(key, 'LS_COLORS') OR contains(key, 'TERM') OR contains(key, 'PWD') OR {underscore})"
LITERAL = SKIP.format(underscore="contains(key, '_')")
INTENDED = SKIP.format(underscore="key = '_'")
_ev(
    "env_context_match",
    f"""SELECT event_id, CAST(count(*) AS INTEGER) AS matches, sum({BOOST}) AS boost
    FROM entries JOIN context USING (key, value) GROUP BY event_id""",
    CONTEXT_ROWS,
)
HOUR = "hours AS (SELECT hour(end_timestamp) AS hour, count(*) * 1.0::DOUBLE / (SELECT count(*) FROM {source}) AS weight FROM {source} GROUP BY 1)"
_ev(
    "weight_lookup",
    "SELECT event_id, round(weight, 6) AS hour_weight FROM ev JOIN hours ON hour(end_timestamp) = hours.hour",
    HOUR.format(source="ev"),
)
NAMES = f"""names AS (SELECT {_name('command')} AS command_name, count(*) AS n, min(end_timestamp) AS first_seen FROM ev GROUP BY 1)"""
_ev(
    "common_flag",
    f"""SELECT event_id, CAST({_name('command')} IN (SELECT command_name FROM top) AS INTEGER) AS is_common FROM ev""",
    NAMES,
    "top AS (SELECT * FROM names ORDER BY n DESC, first_seen, command_name LIMIT 3)",
)
_ev(
    "existing_directories",
    "SELECT DISTINCT hostname, pwd AS path FROM ev WHERE (hostname, pwd) IN (SELECT (hostname, pwd) FROM ev WHERE return_code = 1)",
)
RECENT_KEYS = f"""recent_keys AS (SELECT key, count(*) AS n_events FROM {{source}}
  WHERE start_timestamp >= {AS_OF} - INTERVAL 24 HOUR GROUP BY key)"""
_ev(
    "unmapped_fields",
    f"SELECT key, n_events FROM recent_keys WHERE key NOT IN {_quoted(MAPPED)}",
    RECENT_KEYS.format(source="entries"),
)

# -- aggregations --

_ev("return_code_distribution", "SELECT return_code, count(*) AS n FROM ev GROUP BY 1")
OVER_TIME = "SELECT date_trunc('hour', start_timestamp) AS bucket, count(*) AS n FROM ev GROUP BY 1"
_ev("commands_over_time", OVER_TIME)
_ev("top_commands", "SELECT command, count(*) AS n FROM ev GROUP BY 1 ORDER BY n DESC, command LIMIT 15")
_ev("command_name_frequency", "SELECT * FROM names ORDER BY n DESC, first_seen, command_name LIMIT 100", NAMES)
_ev("hour_weights", "SELECT CAST(hour AS INTEGER) AS hour, round(weight, 6) AS weight FROM hours", HOUR.format(source="ev"))
_ev(
    "weekday_weights",
    """SELECT CAST(isodow(end_timestamp) - 1 AS INTEGER) AS weekday,
    round(count(*) * 1.0::DOUBLE / (SELECT count(*) FROM ev), 6) AS weight FROM ev GROUP BY 1""",
)
TRANSITIONS = f"""pairs AS (
  SELECT lag(name) OVER (PARTITION BY hostname, "user" ORDER BY end_timestamp, event_id) AS prev_name, name AS next_name
  FROM (SELECT *, {_name('command')} AS name FROM ev WHERE return_code = 0)),
transitions AS (
  SELECT prev_name, next_name, count(*) AS n, count(*) * 1.0::DOUBLE / sum(count(*)) OVER (PARTITION BY prev_name) AS probability
  FROM pairs WHERE prev_name IS NOT NULL GROUP BY 1, 2)"""
_ev("transition_probabilities", "SELECT prev_name, next_name, n, round(probability, 6) AS probability FROM transitions", TRANSITIONS)
_ev(
    "directory_command_probabilities",
    f"""SELECT cwd, command_name, count(*) AS n,
      round(count(*) * 1.0::DOUBLE / sum(count(*)) OVER (PARTITION BY cwd), 6) AS probability
    FROM (SELECT regexp_extract(oldpwd, '[^/]*$') AS cwd, {_name('command')} AS command_name FROM ev
          WHERE return_code = 0 AND oldpwd IS NOT NULL) GROUP BY 1, 2""",
)
SHARED = f"""shared AS (
  SELECT e.event_id, count(c.key) AS matches,
    coalesce(sum(CASE WHEN c.key IS NOT NULL AND NOT {LITERAL.replace('key', 'c.key')} THEN {BOOST.replace('key', 'c.key')} END), 0) AS boosted,
    coalesce(sum(CASE WHEN c.key IS NOT NULL AND NOT {INTENDED.replace('key', 'c.key')} THEN {BOOST.replace('key', 'c.key')} END), 0) AS intended
  FROM entries e LEFT JOIN context c ON e.key = c.key AND e.value = c.value GROUP BY e.event_id),
here AS (SELECT * FROM ev JOIN shared USING (event_id) WHERE pwd = '{HERE}' AND return_code = 0)"""
RECENCY = f"""CASE WHEN epoch({AS_OF}) - epoch(last_used) < 86400 THEN 2.0::DOUBLE WHEN epoch({AS_OF}) - epoch(last_used) < 7 * 86400 THEN 1.0
  WHEN epoch({AS_OF}) - epoch(last_used) < 30 * 86400 THEN 0.5 ELSE 0 END"""


def _hits(score: str, size: int) -> str:
    return f"""hits AS (SELECT *, {score} AS score FROM here),
ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, start_timestamp DESC, event_id) AS hit FROM hits
  QUALIFY hit <= {size}),
used AS (
  SELECT command, count(*) AS frequency, max(start_timestamp) AS last_used,
    arg_max(score, (start_timestamp, -hit)) AS best_score, arg_min(matches, hit) AS matches
  FROM ranked GROUP BY command),
suggested AS (SELECT *, best_score + frequency * 0.1::DOUBLE + {RECENCY} AS final FROM used)"""


CONTEXT_TEXT = """coalesce(nullif(concat_ws(', ', CASE WHEN matches > 0 THEN matches || ' env vars match' END,
  CASE WHEN contains(command, 'git') THEN 'git workflow' END, CASE WHEN contains(command, 'docker') THEN 'docker operations' END,
  CASE WHEN contains(command, 'kubectl') OR contains(command, 'k8s') THEN 'kubernetes' END), ''), 'similar directory')"""
_ev(
    "command_usage",
    "SELECT command, frequency, last_used, round(final, 6) AS score FROM suggested",
    CONTEXT_ROWS,
    SHARED,
    _hits("boosted", 20),
)
HOME_TARGET = """CASE WHEN starts_with(dir, '~') THEN home || substr(dir, 2)
  WHEN NOT starts_with(dir, '/') THEN pwd || '/' || dir ELSE dir END"""


def _evidence(by: str = "") -> str:
    order = "ORDER BY start_timestamp DESC, event_id DESC"
    window = f"OVER (PARTITION BY {by} {order})" if by else f"OVER ({order})"
    return f"""cds AS (
  SELECT *, trim(substr(command, strpos(command, ' ') + 1), '"'' ') AS dir FROM (
    SELECT *, row_number() {window} AS rn FROM ev
    WHERE len(list_filter({_terms('command')}, lambda t: starts_with(t, 'cd'))) > 0)
  WHERE rn <= 500 AND starts_with(command, 'cd ')),
pwds AS (SELECT * FROM (SELECT *, row_number() {window} AS rn FROM ev) WHERE rn <= 200),
seen AS (
  SELECT hostname, "user", {HOME_TARGET} AS path, start_timestamp AS seen FROM cds
  UNION ALL SELECT hostname, "user", pwd, start_timestamp FROM pwds)"""


_ev("directory_usage", "SELECT path, count(*) AS frequency, max(seen) AS last_used FROM seen GROUP BY path", _evidence())
_ev(
    "env_field_usage",
    "SELECT key, n_events FROM recent_keys ORDER BY n_events DESC, key LIMIT 1000",
    RECENT_KEYS.format(source="entries_old"),
)
_ev(
    "config_version_counts",
    f"""SELECT config_version, count(*) AS n_events FROM ev WHERE start_timestamp >= {AS_OF} - INTERVAL 168 HOUR
    GROUP BY 1 ORDER BY n_events DESC, config_version LIMIT 10""",
)
_ev(
    "hashed_event_count",
    f"""SELECT count(DISTINCT event_id) AS n_events FROM masked
    WHERE start_timestamp >= {AS_OF} - INTERVAL 168 HOUR AND starts_with(value, 'h8_')""",
    _masked("entries"),
)
BASIC = """CASE WHEN value IS NULL THEN 'unknown' WHEN starts_with(value, 'h8_') THEN 'hashed'
  WHEN starts_with(value, '/') THEN 'path' WHEN regexp_matches(value, '^https?://') THEN 'url' ELSE 'string' END"""


def _extended(value: str = "value") -> str:
    return rf"""CASE WHEN regexp_matches({value}, '^h8_[a-f0-9]{{8}}$') THEN 'hashed'
  WHEN regexp_matches({value}, '^(/[^\s]*|[A-Z]:\\[^\s]*)$') THEN 'path' WHEN regexp_matches({value}, '^https?://') THEN 'url'
  WHEN regexp_matches({value}, '^\d+\.\d+(\.\d+)?') THEN 'version'
  WHEN regexp_matches({value}, '^(true|false|1|0|yes|no|on|off)$') THEN 'boolean'
  WHEN regexp_matches({value}, '^[+-]?\d+$') THEN 'number' ELSE 'default' END"""


_ev(
    "env_type_consistency",
    f"""SELECT key, value_class, count(*) AS n_events, CAST(count(*) OVER (PARTITION BY key) = 1 AS INTEGER) AS consistent
    FROM (SELECT key, {BASIC} AS value_class FROM masked) GROUP BY 1, 2""",
    _masked("entries"),
)
_ev("ingest_count", "SELECT count(*) AS n_events FROM ev")
_ev("distinct_fields", "SELECT key, count(*) AS n_entries FROM entries GROUP BY key")

# -- order and windows --

IN_ORDER = 'OVER (PARTITION BY hostname, "user" ORDER BY end_timestamp, event_id)'
_ev("previous_command_cut", f"SELECT event_id, command, coalesce(lag(command) {IN_ORDER}, '') AS previous_cmd FROM ev")
_ev("next_command_cut", f"SELECT event_id, command, lead(command) {IN_ORDER} AS next_cmd FROM ev QUALIFY next_cmd IS NOT NULL")
_ev("previous_command", f"SELECT event_id, command, coalesce(lag(command) {IN_ORDER}, '') AS previous_cmd FROM ev")
_ev(
    "next_command",
    f"SELECT event_id, command, lead(command) {IN_ORDER} AS next_cmd FROM ev QUALIFY next_cmd IS NOT NULL",
)
_ev(
    "recent_commands",
    """SELECT event_id, pwd, command FROM ev WHERE return_code = 0
    QUALIFY row_number() OVER (PARTITION BY pwd ORDER BY end_timestamp DESC, event_id DESC) <= 20""",
)
_ev(
    "recent_commands_here",
    f"""SELECT event_id, pwd, command FROM ev WHERE return_code = 0 AND pwd = '{HERE}'
    ORDER BY end_timestamp DESC, event_id DESC LIMIT 20""",
)
LAST = """row_number() OVER (PARTITION BY hostname, "user" ORDER BY start_timestamp DESC, event_id DESC)"""
_ev("last_n_events", f'SELECT {SCALARS}, "user" FROM ev QUALIFY {LAST} <= 20')
_ev("latest_directory", f'SELECT hostname, "user", pwd, start_timestamp FROM ev QUALIFY {LAST} = 1')
_ev(
    "hit_rank",
    "SELECT event_id, score, CAST(hit AS INTEGER) AS hit FROM ranked",
    CONTEXT_ROWS,
    SHARED,
    _hits("boosted", 40),
)

# -- sorts, limits, set operations --

_ev("history_order", f'SELECT {SCALARS}, "user" FROM ev ORDER BY hostname, "user", end_timestamp, event_id')
_ev("top_k_by_time", f"SELECT {SCALARS} FROM ev ORDER BY start_timestamp DESC, event_id DESC LIMIT 200")
_ev("scan_cap", f"SELECT {SCALARS} FROM ev WHERE return_code = 0 ORDER BY end_timestamp, event_id LIMIT 5000")
_ev(
    "score_order",
    "SELECT command, round(final, 6) AS score, frequency FROM suggested ORDER BY round(final, 9) DESC, command LIMIT 40",
    CONTEXT_ROWS,
    SHARED,
    _hits("boosted", 80),
)
_ev(
    "display_rows",
    f"""SELECT CASE WHEN length(command) > 60 THEN substr(command, 1, 57) || '...' ELSE command END AS command,
      round(final, 1) AS score, frequency,
      CASE WHEN hours < 1 THEN CAST(round_even(hours * 60, 0) AS BIGINT) || ' min ago'
        WHEN hours < 24 THEN CAST(round_even(hours, 0) AS BIGINT) || ' hours ago'
        WHEN floor(hours / 24) = 1 THEN '1 day ago' ELSE CAST(floor(hours / 24) AS BIGINT) || ' days ago' END AS used,
      {CONTEXT_TEXT} AS context
    FROM (SELECT *, (epoch({AS_OF}) - epoch(last_used)) / 3600 AS hours FROM suggested ORDER BY round(final, 9) DESC, command LIMIT 3)""",
    CONTEXT_ROWS,
    SHARED,
    _hits("boosted", 6),
)
ANCESTORS = [("/home", 4), ("/home/u1", 3), ("/home/u1/src", 2)]
CURRENT = "current(path, assumed) AS (VALUES ('{}', {}), {})".format(
    HERE, AS_OF, ", ".join(f"('{path}', {AS_OF} - INTERVAL {hours} HOUR)" for path, hours in ANCESTORS)
)
_ev(
    "evidence_union",
    "SELECT path, seen, NULL AS assumed FROM seen UNION ALL SELECT path, NULL, assumed FROM current",
    _evidence(),
    CURRENT,
)
_ev(
    "index_pattern_union",
    f"""SELECT {SCALARS.replace('config_version', "CASE WHEN start_timestamp < TIMESTAMP '2024-01-15' THEN config_version END AS config_version")} FROM ev""",
)
_ev("unique_fields", "SELECT DISTINCT key FROM entries_old")
_ev("except_fields", f"SELECT DISTINCT key FROM entries WHERE key NOT IN {_quoted(MAPPED)}")

# -- ranking and scoring --


def _rarity(total: str, matching: str) -> str:
    return f"ln(1 + ({total} - {matching} + 0.5::DOUBLE) / ({matching} + 0.5))"


WEIGHTS = f"""weights AS (
  SELECT c.key, {BOOST.replace('key', 'c.key')} * {_rarity('count(e.key)', 'count(*) FILTER (e.value = c.value)')} AS weight
  FROM context c JOIN entries e ON e.key = c.key WHERE NOT {LITERAL.replace('key', 'c.key')} GROUP BY c.key),
pwd_weight AS (SELECT {_rarity('count(*)', f"count(*) FILTER (pwd = '{HERE}')")} + 1 AS w FROM ev),
scores AS (
  SELECT e.event_id, round(coalesce(sum(w.weight), 0) + (SELECT w FROM pwd_weight), 9) AS bm25
  FROM entries e LEFT JOIN context c ON e.key = c.key AND e.value = c.value LEFT JOIN weights w ON w.key = c.key
  GROUP BY e.event_id)"""
_ev(
    "context_score",
    "SELECT event_id, round(bm25, 6) AS score FROM here JOIN scores USING (event_id)",
    CONTEXT_ROWS,
    SHARED,
    WEIGHTS,
)
_ev("context_score_intended", "SELECT event_id, intended AS score FROM here", CONTEXT_ROWS, SHARED)
# Masking changes neither the scored variables nor the matches of this context, but drops TERM.
_ev(
    "suggest_commands",
    f"""SELECT command, round(final, 6) AS score, frequency, last_used, '{HERE}' AS directory,
      {CONTEXT_TEXT.replace('matches', '(matches - 1)')} AS context
    FROM suggested ORDER BY round(final, 9) DESC, command LIMIT 10""",
    CONTEXT_ROWS,
    SHARED,
    WEIGHTS,
    _hits("bm25", 20).replace("FROM here", "FROM here JOIN scores USING (event_id)"),
)
_ev(
    "suggest_commands_all_hits",
    f"""SELECT command, round(final, 6) AS score, frequency, last_used, '{HERE}' AS directory,
      {CONTEXT_TEXT.replace('matches', '(matches - 1)')} AS context
    FROM suggested ORDER BY round(final, 9) DESC, command LIMIT 10""",
    CONTEXT_ROWS,
    SHARED,
    WEIGHTS,
    _hits("bm25", 1_000_000_000).replace("FROM here", "FROM here JOIN scores USING (event_id)"),
)
_ev(
    "suggest_commands_plain_contexts",
    f"""SELECT * FROM (SELECT context_id, CAST(row_number() OVER (PARTITION BY context_id ORDER BY round(final, 9) DESC, command) AS INTEGER) AS place,
        command, round(final, 6) AS score, frequency, last_used, '{HERE}' AS directory,
        {CONTEXT_TEXT} AS context FROM
        (SELECT *, best_score + frequency * 0.1::DOUBLE + {RECENCY} AS final FROM
          (SELECT context_id, command, count(*) AS frequency, max(start_timestamp) AS last_used, arg_max(score, (start_timestamp, score, -event_id)) AS best_score,
             arg_max(matches, (score, start_timestamp, -event_id)) AS matches FROM tried GROUP BY 1, 2))) WHERE place <= 4""",
    f"""contexts(context_id, wanted) AS (VALUES ('none', NULL), ('empty', NULL), ('stage', 'production'))""",
    f"""tried AS (SELECT context_id, e.*, CASE WHEN wanted = s.value THEN 1 ELSE 0 END AS matches, CASE WHEN wanted = s.value THEN 3.0::DOUBLE ELSE 0 END AS score
      FROM contexts CROSS JOIN ev e JOIN entries s ON s.event_id = e.event_id AND s.key = 'NODE_ENV' WHERE e.pwd = '{HERE}' AND e.return_code = 0)""",
)
_ev(
    "suggest_commands_bulk",
    f"""SELECT context_id, CAST(place AS INTEGER) AS place, command, round(final, 6) AS score, frequency, last_used, directory,
      {CONTEXT_TEXT} AS context
    FROM (SELECT *, row_number() OVER (PARTITION BY context_id ORDER BY round(final, 9) DESC, command) AS place FROM
      (SELECT *, best_score + frequency * 0.1::DOUBLE + {RECENCY} AS final FROM used)) WHERE place <= 5""",
    """contexts AS (SELECT "user" AS context_id, event_id AS context_event, pwd FROM ev
      QUALIFY row_number() OVER (PARTITION BY "user" ORDER BY start_timestamp DESC, event_id DESC) = 1)""",
    "values_seen AS MATERIALIZED (SELECT key, value, count(*) AS n FROM entries GROUP BY 1, 2)",
    f"""entry_weights AS (SELECT key, value, {_rarity('sum(n) OVER (PARTITION BY key)', 'n')} AS weight FROM values_seen)""",
    f"""pwd_weights AS (SELECT pwd, {_rarity('(SELECT count(*) FROM ev)', 'count(*)')} AS weight FROM ev GROUP BY pwd)""",
    """asked AS MATERIALIZED (SELECT c.context_id, e.key, e.value FROM contexts c JOIN entries e ON e.event_id = c.context_event)""",
    """tried AS MATERIALIZED (SELECT c.context_id, e.* FROM contexts c JOIN ev e ON e.pwd = c.pwd AND e.return_code = 0)""",
    """tried_entries AS MATERIALIZED (SELECT t.context_id, a.event_id, a.key, a.value FROM tried t JOIN entries a USING (event_id))""",
    f"""matched AS (
      SELECT t.context_id, t.event_id, count(*) AS matches,
        coalesce(sum(CASE WHEN NOT {LITERAL.replace('key', 't.key')} THEN {BOOST.replace('key', 't.key')} * w.weight END), 0) AS clauses
      FROM tried_entries t JOIN asked b ON b.context_id = t.context_id AND t.key = b.key AND t.value = b.value
      JOIN entry_weights w ON w.key = t.key AND w.value = t.value GROUP BY 1, 2)""",
    """scored AS (SELECT t.*, matches, round(clauses + weight + 1, 9) AS score FROM tried t JOIN matched USING (context_id, event_id)
      JOIN pwd_weights USING (pwd))""",
    """ranked AS (SELECT *, row_number() OVER (PARTITION BY context_id ORDER BY score DESC, start_timestamp DESC, event_id) AS hit FROM scored
      QUALIFY hit <= 10)""",
    """used AS (SELECT context_id, pwd AS directory, command, count(*) AS frequency, max(start_timestamp) AS last_used,
      arg_max(score, (start_timestamp, -hit)) AS best_score, arg_min(matches, hit) AS matches FROM ranked GROUP BY 1, 2, 3)""",
)
FRECENCY = f"0.7::DOUBLE * (100.0::DOUBLE / (1.0 + (epoch({AS_OF}) - epoch(last_used)) / 3600 / 24.0)) + 0.3::DOUBLE * frequency"
LABEL = "CASE WHEN regexp_extract({0}, '[^/]*$') = '' THEN '/' ELSE regexp_extract({0}, '[^/]*$') END || ' (' || {0} || ')'"
_ev(
    "rank_directories",
    f"""SELECT path, frequency, last_used, round({FRECENCY}, 6) AS score, {LABEL.format('path')} AS label FROM (
      SELECT path, count(*) AS frequency, coalesce(max(seen), max(assumed)) AS last_used FROM (
        SELECT path, seen, NULL AS assumed FROM seen UNION ALL SELECT path, NULL, assumed FROM current) GROUP BY path)
    ORDER BY {FRECENCY} DESC, path LIMIT 20""",
    _evidence(),
    CURRENT,
)
_ev(
    "rank_directories_fleet",
    f"""SELECT hostname, "user", path, frequency, last_used, round({FRECENCY}, 6) AS score, {LABEL.format('path')} AS label,
      CAST(row_number() OVER (PARTITION BY hostname, "user" ORDER BY {FRECENCY} DESC, path) AS INTEGER) AS place
    FROM (SELECT hostname, "user", path, count(*) AS frequency, coalesce(max(seen), max(assumed)) AS last_used
      FROM (SELECT hostname, "user", path, seen, NULL AS assumed FROM seen UNION ALL SELECT * FROM above) GROUP BY 1, 2, 3)
    QUALIFY place <= 10""",
    _evidence('hostname, "user"'),
    f"""cwds AS (SELECT hostname, "user", pwd FROM ev QUALIFY {LAST} = 1),
above AS (
  SELECT hostname, "user", array_to_string(parts[1:i], '/') AS path, CAST(NULL AS TIMESTAMP) AS seen,
    CASE WHEN i = len(parts) THEN {AS_OF} ELSE {AS_OF} - to_hours(len(parts) - i + 1) END AS assumed
  FROM (SELECT *, unnest(range(2, len(parts) + 1)) AS i FROM (SELECT *, string_split(pwd, '/') AS parts FROM cwds)))""",
)
_ev("directory_labels", f"SELECT DISTINCT pwd, {LABEL.format('pwd')} AS label FROM ev")
LIVE = """SELECT hostname, "user", cwd, CAST(place AS INTEGER) AS place, offered[place] AS suggestion FROM (
      SELECT *, unnest(range(1, least(len(offered), 3) + 1)) AS place FROM offers)"""
LIVE_CTE = f"""last20 AS (SELECT * FROM ev QUALIFY {LAST} <= 20),
cwds AS (SELECT hostname, "user", arg_max(pwd, (start_timestamp, event_id)) AS cwd FROM last20 GROUP BY 1, 2 HAVING count(*) >= 5),
offers AS (
  SELECT c.*, list_concat(
    CASE WHEN EXISTS (SELECT 1 FROM last20 l WHERE l.hostname = c.hostname AND l."user" = c."user" AND l.pwd = c.cwd
      AND l.return_code = 0 AND contains(l.command, 'git')) THEN ['git status', 'git log --oneline -10'] ELSE [] END,
    CASE WHEN contains(cwd, 'src') OR contains(cwd, 'code')
      THEN ['ls -la', 'find . -name ''*.go'' -o -name ''*.py'' -o -name ''*.js'''] ELSE [] END) AS offered
  FROM cwds c)"""
_ev("live_suggestions", LIVE, LIVE_CTE)

# -- parsing and schema drift --


def _parsed(keys: str, text: str, source: str) -> str:
    return f"""SELECT {keys}, coalesce(w[1], '') AS command_name, coalesce(array_to_string(w[2:], '|'), '') AS args,
      CAST(greatest(len(w) - 1, 0) AS INTEGER) AS num_args FROM (SELECT *, {_words(text)} AS w FROM {source})"""


_ev("parse_commands", _parsed("event_id", "command", "ev"))
SQL["parse_commands_conversations"] = _parsed("conv_id, turn", "text", "conversations")
SQL["parse_commands_documents"] = _parsed("doc_id", "text", "documents")
_ev(
    "command_records",
    f"""SELECT event_id, command, w[1] AS command_name, CAST(len(w) - 1 AS INTEGER) AS num_args,
      CAST(hour(end_timestamp) AS INTEGER) AS hour, CAST(isodow(end_timestamp) - 1 AS INTEGER) AS weekday,
      coalesce(lag(command) {IN_ORDER}, '') AS previous_cmd, coalesce(regexp_extract(oldpwd, '[^/]*$'), '') AS cwd, return_code
    FROM (SELECT *, {_words('command')} AS w FROM ev)""",
)


def _padded_words(text: str) -> str:
    return f"list_transform(list_filter(regexp_split_to_array(lower({text}), '[{SPACE}]+'), lambda w: w <> ''), lambda w: ' ' || w || ' ')"


GRAMS = """SELECT *, substr(p, s, n) AS ngram FROM (
    SELECT *, unnest(range(1, length(p) - n + 2)) AS s FROM padded, (VALUES (2), (3), (4), (5)) sizes(n))"""
_ev(
    "char_ngram_counts",
    f"SELECT event_id, ngram, count(*) AS n FROM (SELECT event_id, ngram FROM ({GRAMS})) GROUP BY 1, 2",
    f"padded AS (SELECT event_id, unnest({_padded_words('command')}) AS p FROM ev)",
)
SQL["char_ngram_documents"] = f"""WITH padded AS (
  SELECT p, count(*) AS times FROM (SELECT unnest({_padded_words('text')}) AS p FROM documents) GROUP BY p)
SELECT ngram, CAST(sum(times) AS BIGINT) AS n FROM ({GRAMS}) GROUP BY ngram"""
_ev(
    "ngram_vocabulary",
    f"SELECT ngram, count(*) AS n FROM (SELECT ngram FROM ({GRAMS})) GROUP BY 1 ORDER BY n DESC, ngram LIMIT 200",
    f"padded AS (SELECT unnest({_padded_words('command')}) AS p FROM ev)",
)
_ev("classify_env_values", f"SELECT event_id, key, value, {BASIC} AS value_class FROM masked", _masked("entries"))
_ev(
    "classify_env_values_extended",
    f"SELECT event_id, key, value, {_extended()} AS value_class FROM masked",
    _masked("entries"),
)
SQL["classify_page_values"] = f"""SELECT page_id AS event_id, 'URL' AS key, {_extended('url')} AS value_class FROM pages
UNION ALL SELECT page_id, 'HTML', {_extended('html')} FROM pages"""
_ev(
    "field_index_policy",
    """SELECT key, count(*) AS n_events,
      CAST(CASE WHEN regexp_matches(key, '_(URL|DSN|ENDPOINT)$') OR regexp_matches(key, '_(PATH|HOME|ROOT)$') OR key IN ('PWD', 'OLDPWD') THEN 512
        WHEN regexp_matches(key, '_(ENV|ENVIRONMENT|STAGE)$') THEN 32 ELSE 256 END AS INTEGER) AS ignore_above,
      CAST(NOT (regexp_matches(key, '_(URL|DSN|ENDPOINT)$') OR regexp_matches(key, '(HIST|LESS|LS_COLORS|TERM|COLORTERM|LANG|LC_)')) AS INTEGER) AS indexed
    FROM entries_old GROUP BY key""",
)
_ev(
    "drift_report",
    """SELECT 'status' AS section, 1 AS place, CASE WHEN count(*) > 3 THEN 'alert' ELSE 'ok' END AS key, count(*) AS n FROM unmapped
    UNION ALL SELECT 'fields_in_use', 1, '', count(*) FROM recent_keys
    UNION ALL SELECT 'unmapped', row_number() OVER (ORDER BY n_events DESC, key), key, n_events FROM unmapped
    UNION ALL SELECT 'suggestion', row_number() OVER (ORDER BY n_events DESC, key), key, n_events FROM unmapped
      WHERE regexp_matches(key, '(ENV|PROFILE|KEY|URL|HOST|PORT)$')""",
    RECENT_KEYS.format(source="entries"),
    f"unmapped AS (SELECT * FROM recent_keys WHERE key NOT IN {_quoted(MAPPED)})",
)


def _limit(value: str) -> str:
    return f"CASE {_extended(value)} WHEN 'hashed' THEN 32 WHEN 'path' THEN 512 WHEN 'url' THEN 256 WHEN 'default' THEN 256 END"


SQL["oversized_values"] = f"""SELECT field, count(*) AS n_events FROM (
  SELECT 'command' AS field FROM pages WHERE length(html) > 1024
  UNION ALL SELECT 'pwd' FROM pages WHERE length(url) > 512
  UNION ALL SELECT 'env.PAGE_URL' FROM pages WHERE length(url) > {_limit('url')}
  UNION ALL SELECT 'env.PAGE' FROM pages WHERE length(html) > {_limit('html')}) GROUP BY field"""
_ev(
    "version_staleness",
    """SELECT config_version, CAST(config_version IS DISTINCT FROM '1.0.1' AS INTEGER) AS stale, count(*) AS n_events
    FROM ev GROUP BY 1, 2""",
)

# -- streams: the same as over the finished table --

_ev("subscribe", f"SELECT {SCALARS} FROM ev WHERE hostname = 'host-2' AND return_code = 1")
_ev(
    "ingest_stream",
    """SELECT event_id, 'archived' AS status, value AS api_key FROM masked WHERE key = 'API_KEY' AND event_id % 10 NOT IN (7, 8, 9)
    UNION ALL SELECT event_id, 'published', NULL FROM ev WHERE return_code = 0 AND event_id % 10 NOT IN (6, 7, 8, 9)
    UNION ALL SELECT event_id, 'invalid', NULL FROM ev WHERE event_id % 10 IN (7, 8)""",
    _masked("entries"),
)
_ev(
    "ingest_stream_masked",
    "SELECT event_id, value AS api_key FROM masked WHERE key = 'API_KEY'",
    _masked("entries"),
)
UNTIMED = 'row_number() OVER (PARTITION BY hostname, "user" ORDER BY CASE WHEN event_id % 7 <> 3 THEN start_timestamp END DESC NULLS LAST, event_id DESC)'
_ev("recent_untimed_stream", f'SELECT event_id, hostname, "user", command, pwd FROM ev QUALIFY {UNTIMED} <= 5')
_ev("recent_events_stream", f'SELECT event_id, hostname, "user", command, pwd FROM ev QUALIFY {LAST} <= 20')
_ev("live_suggestions_stream", LIVE, LIVE_CTE)
_ev("latest_directory_stream", f'SELECT hostname, "user", pwd, start_timestamp FROM ev QUALIFY {LAST} = 1')
_ev("commands_over_time_stream", OVER_TIME)
_ev("dedupe_stream", f"SELECT {SCALARS} FROM ev")
_ev("dedupe_late_stream", f"SELECT {SCALARS} FROM ev")
# Of the newest third of the time a third of the events come three times.
_ev(
    "stream_metric_totals",
    """SELECT 'feed.' || metric AS metric, CAST(sum(CASE metric WHEN 'published' THEN 1 ELSE CAST(return_code IS DISTINCT FROM 0 AS INTEGER) END * times) AS BIGINT) AS total,
      CAST(3 AS BIGINT) AS batches
    FROM (SELECT return_code, CASE WHEN event_id % 3 = 0 AND floor((epoch(start_timestamp) // 1 - low) * 3 / (high - low + 1)) = 2 THEN 3 ELSE 1 END AS times
      FROM ev, (SELECT min(epoch(start_timestamp) // 1) AS low, max(epoch(start_timestamp) // 1) AS high FROM ev)), (VALUES ('published'), ('failed')) m(metric)
    GROUP BY metric""",
)
_ev("commands_over_time_late_stream", OVER_TIME)
_ev("stream_metrics", "SELECT count(*) AS published, count(*) FILTER (return_code <> 0) AS failed FROM ev")

# -- models --

_ev(
    "command_features",
    f"""SELECT event_id, round(h.weight, 6) AS hour_weight, round(d.weight, 6) AS weekday_weight,
      CAST(g.name IN (SELECT name FROM common) AS INTEGER) AS is_common, CAST(len({_words('command')}) - 1 AS INTEGER) AS num_args,
      coalesce(n_grams, 0) AS n_grams, coalesce(gram_kinds, 0) AS gram_kinds
    FROM good g JOIN hours h ON hour(g.end_timestamp) = h.hour JOIN days d ON isodow(g.end_timestamp) = d.day
      LEFT JOIN grams USING (event_id)""",
    f"good AS (SELECT *, {_name('command')} AS name FROM ev WHERE return_code = 0)",
    "common AS (SELECT name FROM good GROUP BY name ORDER BY count(*) DESC, min(end_timestamp), name LIMIT 100)",
    f"padded AS (SELECT event_id, unnest({_padded_words('command')}) AS p FROM good)",
    f"every_gram AS MATERIALIZED (SELECT event_id, ngram FROM ({GRAMS}))",
    "known AS (SELECT ngram FROM every_gram GROUP BY ngram ORDER BY count(*) DESC, ngram LIMIT 200)",
    """grams AS (SELECT event_id, CAST(count(*) AS BIGINT) AS n_grams, CAST(count(DISTINCT ngram) AS BIGINT) AS gram_kinds
      FROM every_gram WHERE ngram IN (SELECT ngram FROM known) GROUP BY event_id)""",
    HOUR.format(source="good"),
    "days AS (SELECT isodow(end_timestamp) AS day, count(*) * 1.0::DOUBLE / (SELECT count(*) FROM good) AS weight FROM good GROUP BY 1)",
)
_ev(
    "command_features_few",
    f"""SELECT event_id, round(h.weight, 6) AS hour_weight, round(d.weight, 6) AS weekday_weight,
      CAST(g.name IN (SELECT name FROM common) AS INTEGER) AS is_common, CAST(len({_words('command')}) - 1 AS INTEGER) AS num_args,
      coalesce(n_grams, 0) AS n_grams, coalesce(gram_kinds, 0) AS gram_kinds
    FROM good g JOIN hours h ON hour(g.end_timestamp) = h.hour JOIN days d ON isodow(g.end_timestamp) = d.day
      LEFT JOIN grams USING (event_id)""",
    f"good AS (SELECT *, {_name('command')} AS name FROM ev WHERE return_code = 0)",
    "common AS (SELECT name FROM good GROUP BY name ORDER BY count(*) DESC, min(end_timestamp), name LIMIT 2)",
    f"padded AS (SELECT event_id, unnest({_padded_words('command')}) AS p FROM good)",
    f"every_gram AS MATERIALIZED (SELECT event_id, ngram FROM ({GRAMS}))",
    "known AS (SELECT ngram FROM every_gram GROUP BY ngram ORDER BY count(*) DESC, ngram LIMIT 50)",
    """grams AS (SELECT event_id, CAST(count(*) AS BIGINT) AS n_grams, CAST(count(DISTINCT ngram) AS BIGINT) AS gram_kinds
      FROM every_gram WHERE ngram IN (SELECT ngram FROM known) GROUP BY event_id)""",
    HOUR.format(source="good"),
    "days AS (SELECT isodow(end_timestamp) AS day, count(*) * 1.0::DOUBLE / (SELECT count(*) FROM good) AS weight FROM good GROUP BY 1)",
)
_ev(
    "markov_next_command",
    """SELECT prev_name, CAST(rank AS INTEGER) AS rank, next_name, n, round(probability, 6) AS probability FROM (
      SELECT *, row_number() OVER (PARTITION BY prev_name ORDER BY n DESC, next_name) AS rank FROM transitions) WHERE rank <= 3""",
    TRANSITIONS,
)

# A forest cannot be repeated in SQL; what it learns from and the shape of what it says can.
FOLLOWED = """followed AS (SELECT *, lead(command) OVER (PARTITION BY hostname, "user" ORDER BY end_timestamp, event_id) AS next_cmd
  FROM ev WHERE return_code = 0 QUALIFY next_cmd IS NOT NULL)"""
_ev(
    "train_next_command",
    """SELECT 'label' AS fact, next_cmd AS name, count(*) AS n FROM followed GROUP BY next_cmd
    UNION ALL SELECT 'rows', CASE WHEN ((event_id % 1000003) * 7919) % 1000 < 800 THEN 'train' ELSE 'test' END, count(*) FROM followed GROUP BY 2""",
    FOLLOWED,
)
_ev(
    "evaluate_accuracy",
    """SELECT CAST(sum(n) AS BIGINT) AS n_test, round(max(n) * 1.0::DOUBLE / sum(n), 6) AS majority_share, 1 AS not_worse
    FROM (SELECT count(*) AS n FROM followed WHERE ((event_id % 1000003) * 7919) % 1000 >= 800 GROUP BY next_cmd)""",
    FOLLOWED,
)
_ev(
    "predict_next_command",
    """SELECT hostname, "user", least(5, (SELECT count(DISTINCT next_cmd) FROM followed)) AS n_places, 1 AS in_order, 1 AS all_are_commands
    FROM ev WHERE return_code = 0 GROUP BY hostname, "user\"""",
    FOLLOWED,
)
_ev(
    "top_k_probabilities",
    """SELECT count(*) AS n_events, 1 AS sums_to_one, 1 AS complete FROM ev WHERE return_code = 0""",
)
_ev(
    "match_statistics",
    f"""SELECT kind, key, value, CAST(sum(n) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS days FROM (
      SELECT CAST(start_timestamp AS DATE) AS day, 'directory' AS kind, '' AS key, pwd AS value, count(*) AS n FROM ev GROUP BY ALL
      UNION ALL SELECT CAST(start_timestamp AS DATE), 'variable', key, value, count(*) FROM entries WHERE NOT {LITERAL} GROUP BY ALL) GROUP BY 1, 2, 3""",
)
SQL["context_score_kept"] = SQL["context_score"]
CUSTOM = """CASE WHEN regexp_matches(key, '{DENY}') OR key IN ('SHELL') THEN NULL
  WHEN NOT (key IN ('USER', 'SHELL', 'API_KEY', 'TERM') OR regexp_matches(key, '^[A-Z]+_ENV$|^DATA')) THEN NULL
  WHEN regexp_matches(key, '(?i)base|_env') THEN {HASHED} ELSE value END""".format(DENY=DENY, HASHED=HASHED)
_ev("mask_environment_custom", f"SELECT * FROM (SELECT event_id, key, {CUSTOM} AS value FROM entries) WHERE value IS NOT NULL")
