"""The registered queries in DuckDB's SQL, over the generic test tables.

Each is written on its own terms; only the stand-in tables are shared.
"""

from __future__ import annotations

from parley.functions.clock import WEEKDAY_NAMES
from parley.sources.standins import CONFIG_KEYS, CRONS, KINDS, STATES, TEMPLATE

EVENTS_NOW = "TIMESTAMP '2024-01-30 12:30:00'"
ORDERS_NOW = "TIMESTAMP '2001-07-31 12:00:00'"
GAP = 1800

# What each cron sample reads as.
CRON_TEXTS = (
    "每天20:00，每周周一到周四执行",
    "每天10:00，每周周日、周六执行",
    "7月8日周二 15:19:50执行",
    "每天00:32执行",
    "每天0/24:00执行",
    "无效的Cron表达式: 30 8 * * *",
    "每天09:30，每周周一执行",
    "每天8-9:*/15，每月1、15日执行",
    "0分6点1日、3月、?执行",
    "每分钟3点?、3月、五、六周执行",
)


def _listed(values) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


def _case(column: str, values: dict) -> str:
    def literal(v):
        return f"'{v}'" if isinstance(v, str) else str(v)

    whens = " ".join(f"WHEN '{k}' THEN {literal(v)}" for k, v in values.items())
    return f"CASE {column} {whens} END"


TABLES = {
    "messages": f"""
        SELECT event_id AS id,
               CASE WHEN event_id % 3 = 0 THEN 'a' || (user_id % 25) ELSE 'u' || user_id END AS from_user,
               CASE WHEN event_id % 3 = 0 THEN 'u' || user_id ELSE 'a' || (user_id % 25) END AS to_user,
               props AS content, CAST(event_id AS VARCHAR) AS msg_id, ts AS create_at,
               CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS is_ai,
               CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS type,
               {_case('event_type', KINDS)} AS msg_type,
               CAST(floor(epoch(ts)) AS BIGINT) AS create_time,
               'k' || (user_id % 25) AS auth_key
        FROM events""",
    "incoming": f"""
        SELECT event_id AS id, 'u' || user_id AS from_user, 'a' || (user_id % 25) AS to_user,
               user_id, props AS content, CAST(event_id AS VARCHAR) AS msg_id, ts AS create_at,
               {_case('event_type', KINDS)} AS msg_type,
               CAST(floor(epoch(ts)) AS BIGINT) AS create_time,
               'k' || (user_id % 25) AS auth_key
        FROM events""",
    "friends": """
        SELECT c_custkey AS id, c_nationkey AS account_id, CAST(c_custkey % 25 AS INTEGER) AS own_account,
               'av' || c_custkey AS avatar, c_name AS nickname, 'u' || c_custkey AS wxid,
               TIMESTAMP '2024-01-30' + to_hours(CAST(c_custkey % 97 - 48 AS INTEGER)) AS end_time,
               TIMESTAMP '2024-01-30' AS update_time,
               CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_name END AS my_remark,
               CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_mktsegment END AS remark,
               CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END AS is_active,
               CAST(c_custkey % 2 AS INTEGER) AS ai_active,
               CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS user_story,
               CASE WHEN c_custkey % 7 <> 0 THEN CAST(c_custkey % 3 * 5 + 999 AS INTEGER) END AS role_id,
               CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS ai_reply
        FROM customer""",
    "accounts": """
        SELECT n_nationkey AS id, 'k' || n_nationkey AS auth_key, 'a' || n_nationkey AS wx_id,
               n_name AS nickname, 'av' || n_nationkey AS avatar,
               CASE WHEN n_regionkey <> 0 THEN n_name END AS onlineTime, n_name AS other,
               CAST(n_nationkey % 5 AS VARCHAR) AS ws_status
        FROM nation""",
    "tasks": f"""
        SELECT o_orderkey AS id, o_custkey AS friend_id, o_orderpriority AS task_name,
               {_listed(CRONS)}[o_orderkey % 10 + 1] AS cron_expression,
               {_listed(CRON_TEXTS)}[o_orderkey % 10 + 1] AS cron_words,
               CAST(o_orderkey % 10 AS INTEGER) AS cron_no,
               CAST(o_orderkey % 7 AS INTEGER) AS execution_count,
               strftime(o_orderdate, '%Y-%m-%d') AS start_date,
               CASE WHEN o_orderkey % 5 = 0 THEN ''
                    WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate + to_days(CAST(o_orderkey % 60 AS INTEGER)), '%Y-%m-%d')
                    ELSE strftime(o_orderdate + to_days(CAST(o_orderkey % 60 AS INTEGER)), '%Y-%m-%d %H:%M:%S')
               END AS end_date,
               CASE WHEN o_orderstatus <> 'F' THEN 1 ELSE 0 END AS is_active,
               CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + INTERVAL 1 DAY END AS last_execution_time,
               o_orderdate AS create_time, o_orderdate AS update_time
        FROM orders""",
    "roles": f"""
        SELECT CAST(p_partkey + 990 AS INTEGER) AS id, p_name AS name, p_name || '{TEMPLATE}' AS prompt,
               p_size % 5 = 0 AS guarded
        FROM part""",
    "config": f"""
        SELECT s_suppkey AS id, {_listed(CONFIG_KEYS)}[s_suppkey % 5 + 1] AS key,
               CAST(s_suppkey + 480 AS VARCHAR) AS value
        FROM supplier""",
    "admins": """
        SELECT s_suppkey AS id,
               'admin' || (CASE WHEN s_suppkey % 10 = 1 THEN s_suppkey - 1 ELSE s_suppkey END) AS username,
               CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE s_suppkey * 3600 + 1700000000 END AS last_login_time,
               s_suppkey % 11 = 0 AS deleted
        FROM supplier""",
    "state_events": f"""
        SELECT event_id, 'a' || (user_id % 25) AS url, {_case('event_type', STATES)} AS state,
               ts AS timestamp
        FROM events""",
    "bounds": """
        SELECT *, CASE
            WHEN end_date = '' THEN NULL
            WHEN length(end_date) = 10 THEN CAST(end_date AS TIMESTAMP) + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND
            ELSE CAST(end_date AS TIMESTAMP) END AS closes
        FROM tasks""",
    "validity": f"""
        SELECT *, CASE WHEN closes < {ORDERS_NOW} THEN 2
                       WHEN CAST(start_date AS TIMESTAMP) <= {ORDERS_NOW} THEN 1 ELSE 0 END AS validity
        FROM bounds""",
    "eligible": """
        SELECT v.id AS task_id, v.friend_id, f.wxid, f.account_id, f.my_remark, v.task_name,
               CASE WHEN v.is_active <> 1 THEN 'task_inactive'
                    WHEN v.validity <> 1 THEN 'out_of_range'
                    WHEN f.id IS NULL THEN 'friend_missing'
                    WHEN f.is_active <> 1 THEN 'friend_inactive'
                    WHEN f.ai_active <> 1 THEN 'friend_ai_off'
                    ELSE 'ok' END AS verdict
        FROM validity v LEFT JOIN friends f ON f.id + 20 = v.friend_id""",
    "frames": """
        SELECT id AS arrival, auth_key, msg_id,
               CASE WHEN id % 13 <> 0 THEN from_user END AS from_user, to_user,
               CASE WHEN id % 17 = 0 THEN 51 ELSE msg_type END AS msg_type,
               CASE WHEN id % 19 <> 0 THEN content END AS content, create_time
        FROM incoming WHERE id % 10 <> 0 AND id % 11 <> 0""",
    "gaps": f"""
        SELECT *, coalesce(create_time - lag(create_time) OVER w > {GAP}, true) AS begins
        FROM incoming WINDOW w AS (PARTITION BY from_user, to_user ORDER BY create_time, id)""",
    "burst_rows": """
        SELECT *, max(CASE WHEN begins THEN create_time END) OVER (
                   PARTITION BY from_user, to_user ORDER BY create_time, id
                   ROWS UNBOUNDED PRECEDING) AS burst_start
        FROM gaps""",
    "bursts": """
        SELECT from_user, to_user, burst_start, CAST(0 AS BIGINT) AS part, count(*) AS message_count,
               max(create_time) AS last_received,
               string_agg(content, chr(10) ORDER BY create_time, id) AS content
        FROM burst_rows GROUP BY from_user, to_user, burst_start""",
    "status_patches": f"""
        SELECT b.msg_id, CASE WHEN b.user_id % 7 = 0 THEN 'failed' ELSE 'processed' END AS status
        FROM burst_rows b
        WHERE b.burst_start < epoch({EVENTS_NOW}) AND EXISTS (
            SELECT 1 FROM friends f WHERE f.wxid = b.from_user AND f.is_active = 1 AND f.ai_active = 1)""",
    "odd_incoming": """
        SELECT * REPLACE (CASE WHEN id % 23 <> 0 THEN create_time END AS create_time,
                          CASE WHEN id % 29 <> 0 THEN msg_id END AS msg_id)
        FROM incoming""",
    "odd_gaps": f"""
        SELECT *, row_number() OVER w AS number,
               coalesce(create_time - lag(create_time) OVER w > {GAP}, true) AS begins
        FROM odd_incoming
        WINDOW w AS (PARTITION BY from_user, to_user ORDER BY create_time NULLS FIRST, id)""",
    "odd_burst_rows": """
        SELECT *, max(CASE WHEN begins THEN create_time END) OVER w AS burst_start,
               max(CASE WHEN begins THEN number END) OVER w AS burst_number
        FROM odd_gaps
        WINDOW w AS (PARTITION BY from_user, to_user ORDER BY number ROWS UNBOUNDED PRECEDING)""",
    "odd_bursts": """
        SELECT from_user, to_user, burst_start, burst_number,
               CAST(floor(burst_place / 10000) AS BIGINT) AS part, count(*) AS message_count,
               max(create_time) AS last_received, string_agg(content, chr(10) ORDER BY number) AS content
        FROM (SELECT *, number - burst_number AS burst_place FROM odd_burst_rows)
        GROUP BY from_user, to_user, burst_start, burst_number, part""",
    "history": f"""
        SELECT f.wxid AS party_a, 'a' || f.own_account AS party_b, f.id AS friend_id, m.*
        FROM messages m JOIN friends f
          ON (m.from_user = f.wxid AND m.to_user = 'a' || f.own_account)
          OR (m.to_user = f.wxid AND m.from_user = 'a' || f.own_account)
        WHERE m.msg_type = 1""",
    "spoken": """
        SELECT *, CASE WHEN from_user = party_b THEN 'assistant' ELSE 'user' END AS role,
               strftime(create_at, '%Y-%m-%d %H:%M:%S') || ':' || content AS turn_content
        FROM history""",
    "task_lists": """
        SELECT friend_id, count(*) AS task_count,
               string_agg(to_json({'id': id, 'friend_id': friend_id, 'cron_expression': cron_expression,
                          'task_name': task_name, 'is_active': is_active, 'end_date': end_date,
                          'start_date': start_date}), ',' ORDER BY id) AS items
        FROM tasks WHERE is_active = 1 GROUP BY friend_id""",
    "filled": f"""
        SELECT f.*, f.id + 100 AS request_id, r.id AS role_no,
               replace(replace(replace(replace(replace(r.prompt,
                   '{{{{friend_id}}}}', CAST(f.id AS VARCHAR)),
                   '{{{{name}}}}', f.my_remark),
                   '{{{{user_story}}}}', CASE WHEN f.user_story = '' THEN '无' ELSE f.user_story END),
                   '{{{{current_time}}}}', '2024/1/30 12:30:00 {WEEKDAY_NAMES[2]}'),
                   '{{{{task_list}}}}', '[' || coalesce(t.items, '') || ']') AS system_text
        FROM friends f JOIN roles r ON true LEFT JOIN task_lists t ON t.friend_id = f.id
        WHERE f.id % 6 <> 0 AND f.nickname <> ''""",
    "reply_parts": """
        SELECT event_id AS reply_id, user_id, event_id % 9 AS damage, props->>'k' AS k,
               CASE WHEN event_id % 4 = 0 THEN -1 ELSE event_id % 3000 END AS target,
               ['add', 'update', 'delete', 'keep'][event_id % 4 + 1] AS operate
        FROM events""",
    "reply_cron": """
        SELECT *, '{"id":' || target || ',"operate":"' || operate || '","should_update":true,"friend_id":'
               || user_id || ',"task_name":"t' || k || '","cron_expression":"0 0 8 ? * *"}' AS cron
        FROM reply_parts""",
    "reply_docs": """
        SELECT *, '{"continue":false,"message":["m' || k || '","",null,"n' || reply_id || '"],"cron":['
               || cron || '],"summarize":[{"friend_id":' || user_id || ',"task_name":"t' || k
               || '","result":"ok","summarize":"s","suggestion":null,"date":"2024-01-30","score":' || k
               || '}]}' AS base
        FROM reply_cron""",
    "ops": """
        SELECT event_id AS op_seq,
               CASE WHEN event_id % 4 = 0 THEN -1 ELSE event_id % 3000 END AS id,
               ['add', 'update', 'update', 'update', 'delete', 'keep', 'update'][event_id % 7 + 1] AS operate,
               CAST(user_id AS INTEGER) AS friend_id, 't' || event_id AS task_name,
               ['* 1 * * * *', '0 0 8 * * *', NULL][event_id % 3 + 1] AS cron_expression,
               event_id % 2 = 0 AS gives_cron
        FROM events""",
    "runs": """
        SELECT event_id % 3000 AS task_id, ts AS run_time,
               'failed at ' || strftime(ts, '%Y-%m-%d %H:%M:%S') AS error_message
        FROM events""",
    "snapshot": """
        SELECT c_nationkey AS account_id,
               CASE WHEN c_custkey % 3 = 0 THEN 'n' || c_custkey ELSE 'u' || c_custkey END AS wxid,
               c_name || '*' AS nickname, c_mktsegment AS province
        FROM customer WHERE c_custkey % 5 <> 0""",
    "logins": """
        SELECT s_suppkey AS seq, 'a' || (s_suppkey % 40) AS wx_id, 'd' || s_suppkey AS auth_key,
               s_name AS nickname, CAST(s_nationkey AS VARCHAR) AS remaining
        FROM supplier WHERE s_suppkey % 7 <> 0
        QUALIFY row_number() OVER (PARTITION BY s_suppkey % 40 ORDER BY s_suppkey DESC) = 1""",
    "profiles": """
        SELECT s_suppkey AS no, 'k' || (s_suppkey % 30) AS auth_key, s_name AS name
        FROM supplier QUALIFY row_number() OVER (PARTITION BY s_suppkey % 30 ORDER BY s_suppkey DESC) = 1""",
}

# The stand-ins each one is made of.
PARTS = {
    "bounds": ("tasks",),
    "validity": ("tasks", "bounds"),
    "eligible": ("friends", "tasks", "bounds", "validity"),
    "frames": ("incoming",),
    "gaps": ("incoming",),
    "burst_rows": ("incoming", "gaps"),
    "bursts": ("incoming", "gaps", "burst_rows"),
    "status_patches": ("friends", "incoming", "gaps", "burst_rows"),
    "odd_incoming": ("incoming",),
    "odd_gaps": ("incoming", "odd_incoming"),
    "odd_burst_rows": ("incoming", "odd_incoming", "odd_gaps"),
    "odd_bursts": ("incoming", "odd_incoming", "odd_gaps", "odd_burst_rows"),
    "history": ("messages", "friends"),
    "spoken": ("messages", "friends", "history"),
    "task_lists": ("tasks",),
    "filled": ("friends", "roles", "tasks", "task_lists"),
    "reply_cron": ("reply_parts",),
    "reply_docs": ("reply_parts", "reply_cron"),
}

ORACLE: dict[str, str] = {}


def oracle(name: str, tables: str, body: str, with_items: str = "") -> None:
    wanted: list[str] = []
    for table in tables.split():
        for part in (*PARTS.get(table, ()), table):
            if part not in wanted:
                wanted.append(part)
    items = [f"{t} AS ({TABLES[t]})" for t in wanted]
    if with_items:
        items.append(with_items)
    prefix = "WITH " + ",\n".join(items) + "\n" if items else ""
    ORACLE[name] = prefix + body


def _days(now: str, n: int = 20) -> str:
    return (
        f"days AS (SELECT CAST(d AS DATE) AS stat_date FROM generate_series("
        f"CAST({now} AS DATE) - INTERVAL {n - 1} DAY, CAST({now} AS DATE), INTERVAL 1 DAY) g(d))"
    )


def _hours(oldest: int, newest: int) -> str:
    return (
        f"hours AS (SELECT h AS hour_start FROM generate_series("
        f"date_trunc('hour', {EVENTS_NOW} - INTERVAL {oldest} HOUR), "
        f"date_trunc('hour', {EVENTS_NOW} - INTERVAL {newest} HOUR), INTERVAL 1 HOUR) g(h))"
    )


# --- statistics -------------------------------------------------------------

oracle("daily_messages", "messages", """
SELECT stat_date,
       count(CASE WHEN is_ai = 1 THEN 1 END) AS ai_msg_count,
       count(CASE WHEN type = 1 THEN 1 END) AS total_msg_count
FROM days LEFT JOIN messages ON CAST(create_at AS DATE) = stat_date
GROUP BY stat_date ORDER BY stat_date DESC""", _days(EVENTS_NOW))

oracle("daily_tasks", "tasks", """
SELECT stat_date, count(id) AS new_task_count
FROM days LEFT JOIN tasks ON CAST(create_time AS DATE) = stat_date
GROUP BY stat_date ORDER BY stat_date DESC""", _days(ORDERS_NOW))

HOURLY = f"""
SELECT hour_start, strftime(hour_start, '%m-%d %H:%M') AS label, count(id) AS message_count,
       count(CASE WHEN is_ai = 1 THEN 1 END) AS ai_count
FROM hours LEFT JOIN messages
  ON date_trunc('hour', create_at) = hour_start AND create_at >= {EVENTS_NOW} - INTERVAL 24 HOUR
GROUP BY hour_start"""
oracle("hourly_messages", "messages", HOURLY + " ORDER BY hour_start", _hours(24, 1))
oracle("message_summary", "messages", f"""
SELECT CAST(sum(message_count) AS BIGINT) AS total_messages, CAST(sum(ai_count) AS BIGINT) AS ai_messages,
       coalesce(sum(ai_count) / nullif(sum(message_count), 0), 0.0) AS ai_message_ratio
FROM ({HOURLY}) h""", _hours(24, 1))

oracle("hourly_tasks", "", f"""
SELECT hour_start, strftime(hour_start, '%H:%M') AS label,
       (SELECT count(*) FROM events WHERE date_trunc('hour', ts) = hour_start
          AND ts >= {EVENTS_NOW} - INTERVAL 3 HOUR) AS created,
       (SELECT CAST(coalesce(sum(event_id % 7), 0) AS BIGINT) FROM events
         WHERE date_trunc('hour', ts + to_hours(CAST(event_id % 3 AS INTEGER))) = hour_start
          AND ts + to_hours(CAST(event_id % 3 AS INTEGER)) >= {EVENTS_NOW} - INTERVAL 3 HOUR) AS executions
FROM hours ORDER BY hour_start""", _hours(3, 0))

oracle("overview_counts", "accounts messages", """
SELECT (SELECT count(*) FROM customer) AS friends,
       (SELECT count(onlineTime) FROM accounts) AS online,
       (SELECT count(*) FROM messages) AS messages_all,
       (SELECT count(*) FROM messages WHERE type = 1) AS messages_sent""")

oracle("message_kinds", "messages", f"""
SELECT CASE msg_type WHEN 1 THEN 'text' WHEN 3 THEN 'image' WHEN 34 THEN 'voice' ELSE 'other' END AS kind,
       count(*) AS message_count
FROM messages WHERE create_at >= {EVENTS_NOW} - INTERVAL 24 HOUR GROUP BY 1""")

oracle("task_status", "tasks", """
SELECT CASE WHEN is_active = 1 AND last_execution_time IS NOT NULL THEN 'running'
            WHEN is_active = 1 THEN 'pending'
            WHEN execution_count > 0 THEN 'finished' ELSE 'inactive' END AS task_status,
       count(*) AS task_count
FROM tasks GROUP BY 1""")

oracle("conversation_volume", "messages", """
SELECT least(from_user, to_user) AS party_low, greatest(from_user, to_user) AS party_high,
       count(*) AS message_count, min(create_at) AS first_at, max(create_at) AS last_at
FROM messages GROUP BY 1, 2""")

# --- filters, lookups, listings ---------------------------------------------

LISTED = """f.id, f.account_id, f.nickname, f.remark, CAST(f.is_active AS VARCHAR) AS is_active,
       CAST(f.ai_active AS VARCHAR) AS ai_active, CAST(f.ai_reply AS VARCHAR) AS ai_reply,
       a.nickname AS ow_nickname, a.avatar AS ow_avatar"""
oracle("friend_listing", "friends accounts", f"""
SELECT {LISTED} FROM friends f LEFT JOIN accounts a ON a.id = f.account_id
WHERE f.nickname ILIKE '%customer#00%' AND f.remark ILIKE '%u%' AND f.is_active = 1""")
oracle("friend_page", "friends accounts", f"""
SELECT {LISTED}, count(*) OVER () AS total_rows,
       CAST(ceil(count(*) OVER () / 15.0) AS BIGINT) AS total_pages
FROM friends f LEFT JOIN accounts a ON a.id = f.account_id WHERE f.is_active = 0
ORDER BY f.is_active DESC, f.account_id DESC, f.nickname DESC, f.id LIMIT 15 OFFSET 15""")
oracle("friend_ranks", "friends", """
SELECT id, n AS rank, (n - 1) // 15 + 1 AS page, (n - 1) % 15 + 1 AS page_row
FROM (SELECT id, row_number() OVER (ORDER BY is_active DESC NULLS LAST, account_id DESC NULLS LAST,
             nickname DESC NULLS LAST, id) AS n FROM friends)""")
ORACLE["friend_page_by_rank"] = ORACLE["friend_page"]
oracle("friends_with_tasks", "friends tasks", """
SELECT f.id, f.nickname, '' AS part, count(t.id) AS task_count,
       coalesce(string_agg(t.id || '|' || t.task_name || '|' || t.cron_words, ';' ORDER BY t.id), '') AS task_lines
FROM friends f LEFT JOIN tasks t ON t.friend_id = f.id AND t.is_active = 1 GROUP BY f.id, f.nickname""")
oracle("account_friend_counts", "accounts friends", """
SELECT a.id, a.nickname, count(f.id) AS friend_count
FROM accounts a LEFT JOIN friends f ON f.account_id = a.id GROUP BY a.id, a.nickname""")
oracle("search_logs", "", """
SELECT doc_id AS id, lang AS reson, source AS msg, count(*) OVER () AS total_rows,
       CAST(ceil(count(*) OVER () / 10.0) AS BIGINT) AS total_pages
FROM documents WHERE text ILIKE '%the%' AND lang ILIKE '%en%' ORDER BY doc_id DESC LIMIT 10 OFFSET 10""")
oracle("search_all_logs", "", """
SELECT doc_id AS id, lang AS reson, source AS msg, CAST(length(text) AS INTEGER) AS text_length
FROM documents WHERE text ILIKE '%t_e%' AND source ILIKE '%src%'""")
oracle("name_conflicts", "admins", """
SELECT a.id, a.username FROM admins a
WHERE EXISTS (SELECT 1 FROM admins b WHERE b.username = a.username AND b.id <> a.id)""")
oracle("admin_listing", "admins", """
SELECT id, username, '' AS password,
       CASE WHEN last_login_time = 0 THEN '还没登录过'
            ELSE strftime(make_timestamp((last_login_time + 8 * 3600) * 1000000), '%Y-%m-%d %H:%M:%S')
       END AS last_login_time
FROM admins WHERE NOT deleted""")
oracle("password_hashes", "", "SELECT s_suppkey AS id, md5('secret' || s_suppkey || 'salt') AS hash FROM supplier")
oracle("validate_rows", "tasks", """
SELECT id, concat_ws(';',
           CASE WHEN id % 4 = 0 THEN 'name is required' END,
           CASE WHEN end_date <> '' AND length(end_date) = 10 THEN 'start_time has no valid format' END) AS errors
FROM tasks""")
oracle("pair_messages", "messages", """
SELECT id, from_user, to_user FROM messages
WHERE (from_user = 'u7' AND to_user = 'a7') OR (from_user = 'a7' AND to_user = 'u7')""")
oracle("party_messages", "messages accounts", """
SELECT a.id AS account_id, count(*) AS message_count, max(m.create_at) AS last_at
FROM accounts a JOIN messages m ON m.from_user = a.wx_id OR m.to_user = a.wx_id GROUP BY a.id""")
oracle("recent_sent", "messages friends", f"""
SELECT id, to_user FROM messages
WHERE create_at >= {EVENTS_NOW} - INTERVAL 48 HOUR AND type = 1 AND is_ai = 0
  AND to_user IN (SELECT wxid FROM friends WHERE ai_active = 1)""")
oracle("first_contact", "messages", """
SELECT from_user, create_time, id, content FROM messages
QUALIFY row_number() OVER (PARTITION BY from_user ORDER BY create_time, id) = 1""")
oracle("active_tasks", "tasks", """
SELECT id, friend_id, cron_words AS cron_expression_chinese FROM tasks WHERE is_active = 1""")
oracle("tasks_of_friend", "tasks", """
SELECT id, task_name, create_time FROM tasks WHERE friend_id = 7 AND is_active = 1""")

# --- members ----------------------------------------------------------------

LAPSED = f"is_active = 1 AND end_time < {EVENTS_NOW}"
oracle("expired_members", "friends", f"SELECT id, nickname, end_time FROM friends WHERE {LAPSED}")
oracle("expiring_members", "friends", f"""
SELECT id, nickname, end_time FROM friends
WHERE is_active = 1 AND end_time BETWEEN {EVENTS_NOW} AND {EVENTS_NOW} + INTERVAL 24 HOUR""")
oracle("member_reminder", "friends", f"""
SELECT row_number() OVER (ORDER BY block) - 1 AS piece, member_count,
       CASE WHEN row_number() OVER (ORDER BY block) = 1 THEN '注意：' ELSE ',' END || names
         || CASE WHEN lead(block) OVER (ORDER BY block) IS NULL THEN ' 会员已到期' ELSE '' END AS content
FROM (SELECT id // 10000 AS block, count(*) AS member_count,
             string_agg(coalesce(nullif(remark, ''), nickname), ',' ORDER BY id) AS names
      FROM friends WHERE {LAPSED} GROUP BY 1) b""")
oracle("expire_members", "friends", f"""
SELECT id, CASE WHEN {LAPSED} THEN 0 ELSE is_active END AS is_active,
       CASE WHEN {LAPSED} THEN 0 ELSE ai_active END AS ai_active,
       CASE WHEN {LAPSED} THEN {EVENTS_NOW} ELSE update_time END AS update_time
FROM friends""")

# --- changes ----------------------------------------------------------------

oracle("patch_members", "friends", f"""
SELECT id, nickname, CASE WHEN user_story = '' THEN nickname || '!' ELSE remark END AS remark,
       CASE WHEN user_story <> '' THEN role_id WHEN id % 2 = 0 THEN 1009 END AS role_id,
       CASE WHEN user_story = '' THEN {EVENTS_NOW} ELSE update_time END AS update_time
FROM friends""")
oracle("close_tasks", "friends tasks", f"""
SELECT t.id, t.friend_id, CASE WHEN f.id IS NOT NULL THEN 0 ELSE t.is_active END AS is_active,
       CASE WHEN f.id IS NOT NULL THEN {ORDERS_NOW} ELSE t.update_time END AS update_time
FROM tasks t LEFT JOIN friends f ON f.id = t.friend_id AND f.is_active = 0""")
oracle("delete_rows", "roles", """
SELECT id, name, 'kept' AS outcome FROM roles WHERE name NOT LIKE 'red%' OR guarded
UNION ALL SELECT id, name, 'refused' FROM roles WHERE name LIKE 'red%' AND guarded""")
oracle("upsert_contacts", "friends snapshot", f"""
SELECT f.id, f.account_id, f.wxid, coalesce(s.nickname, f.nickname) AS nickname,
       CASE WHEN s.wxid IS NULL THEN f.remark ELSE '' END AS remark,
       coalesce(s.province, 'old') AS province, f.is_active, f.role_id,
       CASE WHEN s.wxid IS NULL THEN f.update_time ELSE {EVENTS_NOW} END AS update_time
FROM friends f LEFT JOIN snapshot s ON s.account_id = f.account_id AND s.wxid = f.wxid
UNION ALL
SELECT (SELECT max(id) FROM friends) + row_number() OVER (ORDER BY account_id, wxid), account_id, wxid,
       nickname, '', province, 0, 1009, {EVENTS_NOW}
FROM snapshot WHERE wxid LIKE 'n%'""")
oracle("snapshot_counts", "accounts snapshot", """
SELECT a.id, CASE WHEN count(s.wxid) = 0 THEN 0 ELSE count(s.wxid) * 2 END AS friend_count
FROM accounts a LEFT JOIN snapshot s ON s.account_id = a.id GROUP BY a.id""")
oracle("upsert_accounts", "accounts logins", """
SELECT CAST(coalesce(a.id, (SELECT max(id) FROM accounts)
           + row_number() OVER (PARTITION BY a.id IS NULL ORDER BY l.seq)) AS INTEGER) AS id,
       coalesce(a.wx_id, l.wx_id) AS wx_id, coalesce(l.auth_key, a.auth_key) AS auth_key,
       CASE WHEN l.wx_id IS NULL THEN a.nickname ELSE l.nickname END AS nickname,
       l.remaining AS auth_key_remaining_time, a.other AS totalOnline,
       coalesce(a.ws_status, '0') AS ws_status
FROM accounts a FULL JOIN logins l ON l.wx_id = a.wx_id""")
oracle("account_profiles", "accounts profiles", """
SELECT a.id, coalesce('w' || p.no, a.wx_id) AS wx_id, coalesce(p.name, a.nickname) AS nickname,
       coalesce('img' || p.no, a.avatar) AS avatar, 'alias' || p.no AS alias, a.onlineTime
FROM accounts a LEFT JOIN profiles p ON p.auth_key = a.auth_key""")
oracle("account_online", "accounts", """
SELECT a.id,
       CASE WHEN s_suppkey IS NULL THEN a.onlineTime WHEN s_suppkey % 3 <> 0 THEN 'on' || s_suppkey END AS onlineTime,
       CASE WHEN s_suppkey IS NULL THEN a.other WHEN s_suppkey % 3 <> 0 THEN 'total' || s_suppkey END AS totalOnline,
       CASE WHEN s_suppkey IS NULL THEN a.other END AS expiryTime,
       CASE WHEN s_suppkey IS NULL THEN a.other END AS loginErrMsg,
       CASE WHEN s_suppkey IS NULL THEN a.other END AS onlineDays
FROM accounts a LEFT JOIN supplier ON 'k' || s_suppkey = a.auth_key""")
oracle("reset_online", "accounts", """
SELECT a.id, a.nickname, CASE WHEN NOT leaves THEN onlineTime END AS onlineTime,
       CASE WHEN NOT leaves THEN other END AS expiryTime, CASE WHEN NOT leaves THEN other END AS loginErrMsg,
       CASE WHEN NOT leaves THEN other END AS onlineDays, CASE WHEN NOT leaves THEN other END AS totalOnline
FROM (SELECT *, id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 3000) AS leaves FROM accounts) a""")
oracle("upsert_by_id", "friends tasks", f"""
SELECT t.id, CASE WHEN f.id IS NULL THEN t.friend_id ELSE f.id END AS friend_id,
       coalesce(f.nickname, t.task_name) AS task_name,
       CASE WHEN f.id IS NULL THEN t.cron_expression ELSE '0 0 8 * * *' END AS cron_expression,
       t.is_active, t.execution_count,
       CASE WHEN f.id IS NULL THEN t.update_time ELSE {ORDERS_NOW} END AS update_time
FROM tasks t LEFT JOIN friends f ON f.id = t.id AND f.id % 3 = 0
UNION ALL
SELECT (SELECT max(id) FROM tasks) + row_number() OVER (ORDER BY id), id, nickname, '0 0 8 * * *', 1, 0,
       {ORDERS_NOW}
FROM friends WHERE id % 3 <> 0""")
oracle("set_all", "friends", "SELECT id, 0 AS ai_reply FROM friends")

# --- tasks ------------------------------------------------------------------

oracle("validity_state", "validity", "SELECT id, end_date, validity FROM validity")
oracle("retire_tasks", "validity", f"""
SELECT id, CASE WHEN validity = 2 THEN 0 ELSE is_active END AS is_active,
       CASE WHEN validity = 2 AND is_active = 1 THEN {ORDERS_NOW} ELSE update_time END AS update_time
FROM validity""")
oracle("task_eligibility", "eligible", """
SELECT o.o_orderkey * 2 AS task_id, e.friend_id, e.wxid, coalesce(e.verdict, 'task_missing') AS verdict
FROM orders o LEFT JOIN eligible e ON e.task_id = o.o_orderkey * 2""")
oracle("task_messages", "eligible", """
SELECT task_id, account_id, wxid,
       CASE WHEN my_remark <> '' THEN my_remark || '，' ELSE '' END || task_name AS content
FROM eligible WHERE verdict = 'ok'""")
oracle("task_log_rows", "eligible", f"""
SELECT CAST(task_id AS INTEGER) AS task_id, task_name,
       CASE verdict WHEN 'ok' THEN '执行完成' ELSE '执行失败' END AS status, {ORDERS_NOW} AS create_at
FROM eligible WHERE verdict = 'ok' OR verdict LIKE 'friend%'""")
oracle("resolve_targets", "tasks friends accounts", """
SELECT r.id AS request_id, r.id AS task_id, r.wxid, r.found AS friend_id, r.account AS account_id,
       a.auth_key, a.wx_id AS sender_wxid
FROM (SELECT t.id, 'u' || t.friend_id AS wxid,
             CASE WHEN t.id % 2 = 1 THEN t.friend_id
                  WHEN f.account_id = t.friend_id % 25 THEN f.id END AS found,
             CASE WHEN t.id % 2 = 1 THEN f.account_id ELSE CAST(t.friend_id % 25 AS INTEGER) END AS account
      FROM tasks t LEFT JOIN friends f ON f.id = t.friend_id) r
LEFT JOIN accounts a ON a.id = r.account""")
oracle("schedule_diff", "tasks", f"""
SELECT coalesce(w.id, p.id) AS id, p.cron AS old_cron, w.cron_expression AS new_cron,
       CASE WHEN p.id IS NULL THEN 'new' WHEN w.id IS NULL THEN 'removed'
            WHEN p.cron IS NOT DISTINCT FROM w.cron_expression THEN 'unchanged' ELSE 'changed' END AS action
FROM (SELECT * FROM tasks WHERE is_active = 1) w
FULL JOIN (SELECT o_orderkey + 10 AS id,
                  CASE WHEN o_orderkey % 3 <> 0 THEN {_listed(CRONS)}[o_orderkey % 10 + 1]
                       WHEN o_orderkey % 2 = 0 THEN '0 0 1 * * *' END AS cron
           FROM orders) p ON p.id = w.id""")
oracle("active_task_json", "task_lists", "SELECT friend_id, '' AS part, task_count, items FROM task_lists")
oracle("apply_task_ops", "tasks ops", f"""
SELECT t.id, t.friend_id, coalesce(n.task_name, t.task_name) AS task_name,
       CASE WHEN c.id IS NULL THEN t.cron_expression ELSE c.cron_expression END AS cron_expression,
       CASE WHEN c.id IS NULL THEN t.start_date END AS start_date,
       CASE WHEN n.id IS NULL THEN t.end_date ELSE '2030-01-01' END AS end_date,
       t.is_active, t.execution_count,
       CASE WHEN c.id IS NULL AND n.id IS NULL THEN t.update_time ELSE {ORDERS_NOW} END AS update_time
FROM tasks t
LEFT JOIN (SELECT * FROM ops WHERE operate = 'update' AND gives_cron
           QUALIFY row_number() OVER (PARTITION BY id ORDER BY op_seq DESC) = 1) c ON c.id = t.id
LEFT JOIN (SELECT * FROM ops WHERE operate = 'update' AND NOT gives_cron
           QUALIFY row_number() OVER (PARTITION BY id ORDER BY op_seq DESC) = 1) n ON n.id = t.id
WHERE t.id NOT IN (SELECT id FROM ops WHERE operate = 'delete')
UNION ALL
SELECT (SELECT max(id) FROM tasks) + row_number() OVER (ORDER BY op_seq), friend_id, task_name,
       cron_expression, NULL, '2030-01-01', 1, 0, {ORDERS_NOW}
FROM ops WHERE operate = 'add' AND id = -1""")
oracle("record_executions", "tasks runs", """
SELECT t.id, CAST(t.execution_count + coalesce(r.n, 0) AS INTEGER) AS execution_count,
       coalesce(r.last_run, t.last_execution_time) AS last_execution_time
FROM tasks t LEFT JOIN (SELECT task_id, count(*) AS n, max(run_time) AS last_run FROM runs GROUP BY 1) r
  ON r.task_id = t.id""")
oracle("record_errors", "tasks runs", """
SELECT t.id, r.error_message, coalesce(r.run_time, t.last_execution_time) AS last_execution_time
FROM tasks t LEFT JOIN (
    SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY run_time DESC) = 1) r
  ON r.task_id = t.id""")

# --- cron -------------------------------------------------------------------

oracle("describe_cron", "tasks", """
SELECT id, cron_expression, cron_words AS cron_expression_chinese FROM tasks""")
oracle("cron_valid", "tasks", "SELECT id, cron_no <> 5 AS cron_valid FROM tasks")


def _fires(start: str, end: str) -> str:
    return f"""
minutes AS (SELECT m FROM generate_series({start}, {end}, INTERVAL 1 MINUTE) g(m)),
clock AS (SELECT m, extract('minute' FROM m) AS mi, extract('hour' FROM m) AS h,
                 extract('day' FROM m) AS dom, extract('month' FROM m) AS mon,
                 extract('dow' FROM m) AS dow FROM minutes),
fires AS (
    SELECT 0 AS cron_no, m AS fire FROM clock WHERE mi = 0 AND h = 20 AND dow BETWEEN 1 AND 4
    UNION ALL SELECT 1, m FROM clock WHERE mi = 0 AND h = 10 AND dow IN (0, 6)
    UNION ALL SELECT 2, m + INTERVAL 50 SECOND FROM clock
              WHERE mi = 19 AND h = 15 AND mon = 7 AND (dom = 8 OR dow = 2)
    UNION ALL SELECT 3, m FROM clock WHERE mi = 32 AND h = 0
    UNION ALL SELECT 4, m FROM clock WHERE mi = 0 AND h = 0
    UNION ALL SELECT 6, m FROM clock WHERE mi = 30 AND h = 9 AND dow = 1
    UNION ALL SELECT 7, m FROM clock WHERE mi % 15 = 0 AND h IN (8, 9) AND dom IN (1, 15)
    UNION ALL SELECT 8, m + to_seconds(s) FROM clock, range(60) r(s)
              WHERE mi = 0 AND h = 6 AND dom = 1 AND mon = 3
    UNION ALL SELECT 9, m FROM clock WHERE h = 3 AND mon = 3 AND dow IN (5, 6))"""


oracle("cron_fires", "tasks", """
SELECT t.id, f.fire AS fire_time FROM tasks t JOIN fires f ON f.cron_no = t.cron_no
""", _fires("TIMESTAMP '2024-03-01'", "TIMESTAMP '2024-03-07 23:59:00'"))


def _zoned(forward: bool) -> str:
    """Hours from UTC of the clocks, and the hour of them that is left out, written in."""
    changed = "TIMESTAMP '2024-03-10 01:00:00'" if forward else "TIMESTAMP '2024-11-03 01:00:00'"
    before, after = (-5, -4) if forward else (-4, -5)
    hours = f"""CASE t.id % 3 WHEN 1 THEN 8 WHEN 2 THEN 0
                ELSE CASE WHEN f.fire < {changed} THEN {before} ELSE {after} END END"""
    missing = "AND NOT (t.id % 3 = 0 AND f.fire >= TIMESTAMP '2024-03-10 00:00:00' AND f.fire < " + (
        "TIMESTAMP '2024-03-10 01:00:00')"
    )
    return f"""
SELECT t.id, CASE t.id % 3 WHEN 0 THEN 'America/Havana' WHEN 1 THEN 'Asia/Shanghai' ELSE 'UTC' END AS zone,
       f.fire AS fire_time, CAST(epoch(f.fire) AS BIGINT) - 3600 * CAST({hours} AS BIGINT) AS fire_epoch
FROM tasks t JOIN fires f ON f.cron_no = t.cron_no {missing if forward else ""}"""


oracle("zoned_fires_forward", "tasks", _zoned(True),
       _fires("TIMESTAMP '2024-03-09'", "TIMESTAMP '2024-03-11 23:59:00'"))
oracle("zoned_fires_back", "tasks", _zoned(False),
       _fires("TIMESTAMP '2024-11-02'", "TIMESTAMP '2024-11-04 23:59:00'"))
NEXT = _fires(ORDERS_NOW, f"{ORDERS_NOW} + INTERVAL 366 DAY") + f""",
firsts AS (SELECT cron_no, min(fire) AS next_fire FROM fires WHERE fire > {ORDERS_NOW} GROUP BY 1)"""
oracle("next_fire", "tasks", """
SELECT t.id, f.next_fire FROM tasks t LEFT JOIN firsts f ON f.cron_no = t.cron_no""", NEXT)
oracle("set_next_execution", "tasks", """
SELECT t.id, CASE WHEN t.is_active = 1 THEN f.next_fire END AS next_execution_time
FROM tasks t LEFT JOIN firsts f ON f.cron_no = t.cron_no""", NEXT)

# --- ingest -----------------------------------------------------------------

oracle("parse_frames", "frames", """
SELECT arrival, auth_key, msg_id, from_user, to_user, msg_type, content, create_time FROM frames""")
ROUTE = """CASE WHEN a.id IS NOT NULL THEN 1 WHEN f.ai_active = 0 THEN 2 WHEN f.ai_active = 1 THEN 3 ELSE 0 END"""
ROUTED = """LEFT JOIN accounts a ON a.wx_id = m.from_user AND a.auth_key = m.auth_key
     LEFT JOIN friends f ON f.wxid = m.from_user AND f.is_active = 1"""
oracle("bad_frames", "incoming", f"""
SELECT id AS arrival, CASE WHEN id % 10 = 0 THEN left(whole, length(whole) - 3) ELSE whole || ' xx' END AS value
FROM (SELECT id, '{{"msg_id":' || id
        || CASE WHEN id % 13 <> 0 THEN ',"from_user_name":{{"str":"' || from_user || '"}}' ELSE '' END
        || ',"to_user_name":{{"str":"' || to_user || '"}},"msg_type":'
        || CASE WHEN id % 17 = 0 THEN 51 ELSE msg_type END || ',"content":{{'
        || CASE WHEN id % 19 <> 0 THEN '"str":' || to_json(content) ELSE '' END || '}},"create_time":'
        || CASE WHEN id % 2 = 0 THEN create_time ELSE create_time * 1000 END || '}}' AS whole
      FROM incoming WHERE id % 10 = 0 OR id % 11 = 0) f""")
oracle("route_messages", "messages accounts friends", f"""
SELECT m.id, m.from_user, {ROUTE} AS route FROM messages m {ROUTED}""")
oracle("message_rows", "frames accounts friends", f"""
SELECT msg_id, from_user, to_user, content, CASE route WHEN 1 THEN 'done' ELSE 'queued' END AS status,
       0 AS is_ai, CASE route WHEN 1 THEN 1 ELSE 0 END AS type, msg_type, create_time,
       {EVENTS_NOW} AS create_at, {EVENTS_NOW} AS update_at
FROM (SELECT m.*, {ROUTE} AS route FROM frames m {ROUTED}) r
WHERE from_user IS NOT NULL AND route <> 0 AND msg_type <> 51 AND content <> ''""")
oracle("stream_messages", "frames accounts friends", f"""
SELECT CASE WHEN arrival % 29 <> 0 THEN msg_id END AS msg_id, from_user, to_user, content,
       CASE route WHEN 1 THEN 'done' ELSE 'queued' END AS status, 0 AS is_ai,
       CASE route WHEN 1 THEN 1 ELSE 0 END AS type, msg_type, create_time,
       {EVENTS_NOW} AS create_at, {EVENTS_NOW} AS update_at
FROM (SELECT m.*, {ROUTE} AS route FROM frames m {ROUTED}) r
WHERE from_user IS NOT NULL AND route <> 0 AND msg_type <> 51 AND content <> ''""")
oracle("dedup_messages", "messages", """
SELECT msg_id, create_time, content FROM messages WHERE type <> 1""")
oracle("merge_bursts", "odd_bursts", "SELECT * FROM odd_bursts")
AI_MEMBERS = "SELECT wxid FROM friends WHERE is_active = 1 AND ai_active = 1"
oracle("stream_bursts", "bursts friends", f"SELECT * FROM bursts WHERE from_user IN ({AI_MEMBERS})")
oracle("burst_status", "odd_burst_rows friends", f"""
SELECT msg_id, CASE WHEN user_id % 7 = 0 THEN 'failed' ELSE 'processed' END AS status
FROM odd_burst_rows
WHERE coalesce(burst_start, 0) < epoch({EVENTS_NOW}) AND from_user IN ({AI_MEMBERS})""")
oracle("set_message_status", "messages status_patches", f"""
SELECT m.id, coalesce(p.status, 'queued') AS status,
       CASE WHEN p.msg_id IS NULL THEN m.create_at ELSE {EVENTS_NOW} END AS update_at
FROM messages m LEFT JOIN status_patches p ON p.msg_id = m.msg_id""")
CODE = "WHEN 'CONNECTING' THEN 0 WHEN 'OPEN' THEN 1 WHEN 'CLOSING' THEN 2 WHEN 'CLOSED' THEN 3 WHEN 'ERROR' THEN 4"
oracle("connection_status", "state_events", f"""
SELECT url, state, since, last_updated, CASE state {CODE} ELSE -1 END AS state_code
FROM (SELECT url, arg_max(state, timestamp) AS state, min(timestamp) AS since, max(timestamp) AS last_updated
      FROM state_events GROUP BY url) s""")
oracle("state_changes", "state_events", """
SELECT * FROM (SELECT *, lag(state) OVER (PARTITION BY url ORDER BY timestamp, event_id) AS previous_state
               FROM state_events) s
WHERE previous_state IS NULL OR previous_state <> state""")
ORACLE["stream_state_changes"] = ORACLE["state_changes"]
oracle("ws_status_patches", "state_events accounts", f"""
SELECT id, ws_status, CAST(code AS VARCHAR) AS new_status, state
FROM (SELECT a.id, a.ws_status, coalesce(s.state, 'NOT_FOUND') AS state,
             CASE s.state {CODE} ELSE 3 END AS code
      FROM accounts a LEFT JOIN (SELECT CASE url WHEN 'a3' THEN 'gone' ELSE url END AS url,
                                        arg_max(state, timestamp) AS state
                                 FROM state_events GROUP BY 1) s ON s.url = a.wx_id) p
WHERE CAST(ws_status AS INTEGER) <> code""")

# --- conversations and prompts ----------------------------------------------


def _config(key: str) -> str:
    return f"(SELECT arg_min(value, id) FROM config WHERE key = '{key}')"


oracle("config_row", "config", f"""
SELECT {_config('hisMsgDay')} AS hisMsgDay, {_config('to_noti_wxid')} AS to_noti_wxid,
       {_config('from_noti_key')} AS from_noti_key""")
oracle("members_with_config", "config friends", f"""
SELECT id, {_config('to_noti_wxid')} AS to_noti_wxid, {_config('from_noti_key')} AS from_noti_key FROM friends""")
oracle("chat_history", "history config", f"""
SELECT party_a, party_b, id, create_time, content FROM history
WHERE create_at >= {EVENTS_NOW} - to_hours(CAST({_config('hisMsgDay')} AS INTEGER))""")
RECENT = f"create_at >= {EVENTS_NOW} - INTERVAL 720 HOUR"
oracle("chat_turns", "spoken", f"""
SELECT party_a, party_b, id, create_time, role, turn_content FROM spoken WHERE {RECENT}""")


def _prompt_oracle(role: str) -> str:
    return f"""
SELECT s.friend_id + 100 AS request_id, 0 AS section, s.create_time, s.id AS message_id, '' AS piece,
       s.role, s.turn_content AS content
FROM spoken s JOIN filled p ON p.id = s.friend_id AND p.role_no = {role} WHERE {RECENT}
UNION ALL
SELECT request_id, 1, NULL, NULL, '', 'system', system_text FROM filled p WHERE role_no = {role}
UNION ALL
SELECT request_id, 2, NULL, NULL, '', 'user', nickname FROM filled p WHERE role_no = {role}"""


oracle("build_prompts", "spoken filled", _prompt_oracle("coalesce(p.role_id, 999)"))
oracle("prompt_arrays", "spoken filled", f"""
SELECT request_id, '' AS part, count(*) AS turn_count,
       CAST(to_json(list({{'role': role, 'content': content}}
                         ORDER BY section, coalesce(create_time, 0), message_id)) AS VARCHAR) AS turns
FROM ({_prompt_oracle("coalesce(p.role_id, 999)")}) t GROUP BY request_id""")
oracle("copy_edit_prompts", "spoken filled", _prompt_oracle("1001"))
oracle("summary_prompts", "spoken filled", f"""
SELECT request_id, 1 AS section, CAST(NULL AS BIGINT) AS create_time, CAST(NULL AS BIGINT) AS message_id,
       '' AS piece, 'system' AS role,
       replace(system_text, '{{{{chatHistory}}}}', '[' || coalesce(h.said, '') || ']') AS content
FROM filled LEFT JOIN (
    SELECT friend_id, string_agg(to_json({{'role': role, 'content': turn_content}}), ',' ORDER BY create_time, id) AS said
    FROM spoken WHERE {RECENT} GROUP BY friend_id) h ON h.friend_id = filled.id
WHERE role_no = 1010
UNION ALL
SELECT request_id, 2, NULL, NULL, '', 'user', nickname FROM filled WHERE role_no = 1010""")
oracle("adhoc_prompts", "roles", """
SELECT doc_id AS request_id, 1 AS section, CAST(NULL AS BIGINT) AS create_time,
       CAST(NULL AS BIGINT) AS message_id, '' AS piece, 'system' AS role, r.prompt AS content
FROM documents LEFT JOIN roles r ON r.id = doc_id % 300 + 990 WHERE text <> ''
UNION ALL SELECT doc_id, 2, NULL, NULL, '', 'user', text FROM documents WHERE text <> ''""")
oracle("owner_prompts", "messages accounts roles", f"""
SELECT a.id + 500 AS request_id, 0 AS section, m.create_time, m.id AS message_id, '' AS piece,
       'user' AS role, m.content
FROM accounts a JOIN messages m ON m.from_user = a.wx_id OR m.to_user = a.wx_id
WHERE m.msg_type = 1 AND {RECENT}
UNION ALL
SELECT id + 500, 1, NULL, NULL, '', 'system',
       (SELECT prompt FROM roles WHERE id = 1000) || ' 我的账号是' || wx_id FROM accounts
UNION ALL
SELECT id + 500, 2, NULL, NULL, '', 'user', nickname FROM accounts""")
oracle("burst_requests", "odd_bursts friends", """
SELECT b.from_user || '/' || b.to_user || '/' || coalesce(CAST(b.burst_start AS VARCHAR), 'n' || b.burst_number)
         AS request_id, f.id AS friend_id, b.part,
       CASE WHEN part > 0 THEN chr(10) ELSE '' END || b.content AS text
FROM odd_bursts b JOIN friends f ON f.wxid = b.from_user AND f.is_active = 1 AND f.ai_active = 1""")
oracle("exchange_log_rows", "", """
SELECT conv_id, 're: ' || arg_min(role, turn) AS reply,
       CAST(to_json(list({'role': role, 'content': text} ORDER BY turn)) AS VARCHAR) AS msg,
       arg_max(text, turn) AS text, '' AS reson
FROM conversations GROUP BY conv_id""")

# --- replies ----------------------------------------------------------------

oracle("repair_json", "reply_docs", """
SELECT reply_id, CASE WHEN damage IN (5, 6) THEN 'balanced' WHEN damage IN (7, 8) THEN 'JSON_PARSE_FAILED'
                      ELSE 'ok' END AS status,
       CASE WHEN damage NOT IN (7, 8) THEN base END AS parsed
FROM reply_docs""")
oracle("reply_messages", "reply_parts", """
SELECT reply_id, 0 AS position, 'm' || k AS content FROM reply_parts WHERE damage < 7
UNION ALL SELECT reply_id, 3, 'n' || reply_id FROM reply_parts WHERE damage < 7""")
_SENT = """'queued' AS status, 1 AS is_ai, 1 AS type, 1 AS msg_type,
       CAST(epoch({now}) AS BIGINT) AS create_time, {now} AS create_at, {now} AS update_at"""
oracle("sent_messages", "burst_rows reply_parts friends accounts", f"""
SELECT b.burst_start, s.position, b.to_user AS from_user, b.from_user AS to_user, s.content,
       {_SENT.format(now=EVENTS_NOW)}
FROM burst_rows b
JOIN (SELECT reply_id, damage, 0 AS position, 'm' || k AS content FROM reply_parts
      UNION ALL SELECT reply_id, damage, 3, 'n' || reply_id FROM reply_parts) s ON s.reply_id = b.id
JOIN friends f ON f.wxid = b.from_user AND f.is_active = 1 AND f.ai_active = 1 AND f.ai_reply = 1
JOIN accounts a ON a.wx_id = b.to_user
WHERE b.begins AND s.damage < 7""")
oracle("reply_task_ops", "reply_parts", """
SELECT reply_id, 0 AS position, target AS id, operate, CAST(user_id AS INTEGER) AS friend_id,
       't' || k AS task_name, '0 0 8 ? * *' AS cron_expression,
       'cron_expression,friend_id,id,operate,should_update,task_name' AS given
FROM reply_parts WHERE damage < 7""")
oracle("reply_summaries", "reply_parts", """
SELECT reply_id, 0 AS position, CAST(user_id AS INTEGER) AS friend_id, 't' || k AS task_name, 'ok' AS result,
       's' AS summarize, CAST(NULL AS VARCHAR) AS suggestion, '2024-01-30' AS date,
       CAST(k AS INTEGER) AS score
FROM reply_parts WHERE damage < 7""")
oracle("task_change_notices", "reply_cron friends", """
SELECT r.reply_id, r.user_id AS friend_id,
       '当前' || f.remark || '的cron任务列表已更新：[' || r.cron || ']' AS content
FROM reply_cron r JOIN friends f ON f.id = r.user_id WHERE r.damage < 7""")
ORACLE["sent_tasks"] = f"""
SELECT t.request_id, t.sender_wxid AS from_user, t.wxid AS to_user, 'hi ' || o.o_orderpriority AS content,
       {_SENT.format(now=ORDERS_NOW)}
FROM ({ORACLE["resolve_targets"]}) t JOIN orders o ON o.o_orderkey = t.request_id
WHERE t.request_id % 6 <> 0 AND coalesce(t.auth_key, '') <> '' AND coalesce(t.wxid, '') <> ''"""
