"""DuckDB oracle SQL for every registered query (see ``callqc.registry``).

Each statement starts with the fixture views as CTEs (the same SQL text Spark uses to
derive them) followed by the query as the reference's handlers would run it, with the
PostgreSQL defaults written out: NULLS FIRST on DESC, NULLS LAST on ASC, ``0.0E0``
double literals, and integer sums cast to BIGINT.  ``AS_OF`` pins CURRENT_DATE.
"""

from __future__ import annotations

from callqc.sources.fixtures import duckdb_ctes

AS_OF = "DATE '2024-01-30'"

F1 = "conversation_analysis ca INNER JOIN conversations_log cl ON ca.conversation_id = cl.id"


def _d(days: int) -> str:
    return f"({AS_OF} - INTERVAL '{days}' DAY)"


def date_pred(date_range: str | None, start: str | None = None, end: str | None = None, col: str = "ca.created_at") -> str:
    if date_range == "today":
        return f"{col} >= {AS_OF}"
    if date_range == "yesterday":
        return f"{col} >= {_d(1)} AND {col} < {AS_OF}"
    if date_range == "last7days":
        return f"{col} >= {_d(7)}"
    if date_range == "last30days":
        return f"{col} >= {_d(30)}"
    if date_range == "custom":
        return f"{col} >= DATE '{start}' AND {col} < DATE '{end}' + INTERVAL '1' DAY"
    return "TRUE"


def cnt(pred: str) -> str:
    return f"CAST(SUM(CASE WHEN {pred} THEN 1 ELSE 0 END) AS BIGINT)"


def kpis(where: str = "TRUE") -> str:
    return f"""
SELECT COALESCE(average_score, 0.0E0) AS average_score,
  COALESCE(average_conversation_score_ai, 0.0E0) AS average_conversation_score_ai,
  COALESCE(average_process_score_human, 0.0E0) AS average_process_score_human,
  COALESCE(average_other_criteria_score_human, 0.0E0) AS average_other_criteria_score_human,
  COALESCE(average_final_score_combined, 0.0E0) AS average_final_score_combined,
  total_conversations,
  COALESCE(positive_sentiment, 0) AS positive_sentiment,
  COALESCE(negative_sentiment, 0) AS negative_sentiment,
  COALESCE(average_silence_percentage, 0.0E0) AS average_silence_percentage,
  COALESCE(average_longest_silence, 0.0E0) AS average_longest_silence,
  COALESCE(CAST(total_silence_seconds AS DOUBLE), 0.0E0) AS total_silence_seconds,
  COALESCE(start_sentiment_positive, 0) AS start_sentiment_positive,
  COALESCE(start_sentiment_negative, 0) AS start_sentiment_negative,
  COALESCE(end_sentiment_positive, 0) AS end_sentiment_positive,
  COALESCE(end_sentiment_negative, 0) AS end_sentiment_negative,
  CASE WHEN COALESCE(start_sentiment_negative, 0) > 0
       THEN CAST(end_sentiment_positive AS DOUBLE) / CAST(start_sentiment_negative AS DOUBLE) * 100.0E0
       ELSE 0.0E0 END AS sentiment_improvement
FROM (
  SELECT AVG(ca.final_percentage_score) AS average_score,
    AVG(ca.conversation_score_ai) AS average_conversation_score_ai,
    AVG(ca.process_score_human) AS average_process_score_human,
    AVG(ca.other_criteria_score_human) AS average_other_criteria_score_human,
    AVG(ca.final_score_combined) AS average_final_score_combined,
    COUNT(*) AS total_conversations,
    {cnt("ca.customer_sentiment_label = 'positive'")} AS positive_sentiment,
    {cnt("ca.customer_sentiment_label = 'negative'")} AS negative_sentiment,
    AVG(cl.silence_percentage) AS average_silence_percentage,
    AVG(cl.longest_silence_gap_seconds) AS average_longest_silence,
    SUM(cl.total_silence_seconds) AS total_silence_seconds,
    {cnt("ca.customer_sentiment_start = 'positive'")} AS start_sentiment_positive,
    {cnt("ca.customer_sentiment_start = 'negative'")} AS start_sentiment_negative,
    {cnt("ca.customer_sentiment_end = 'positive'")} AS end_sentiment_positive,
    {cnt("ca.customer_sentiment_end = 'negative'")} AS end_sentiment_negative
  FROM {F1}
  WHERE {where}
) k
"""


def with_fixtures(query: str) -> str:
    q = query.strip()
    if q.upper().startswith("WITH "):
        return duckdb_ctes() + ",\n" + q[5:]
    return duckdb_ctes() + "\n" + q


def score_trends(where: str) -> str:
    return f"""
SELECT CAST(ca.created_at AS DATE) AS date,
  AVG(ca.final_percentage_score) AS average_score,
  AVG(ca.conversation_score_ai) AS average_ai_score,
  AVG(ca.final_score_combined) AS average_combined_score,
  COUNT(*) AS conversation_count
FROM {F1}
WHERE {where}
GROUP BY CAST(ca.created_at AS DATE)
ORDER BY 1 ASC NULLS LAST
"""


def criteria_scores(where: str = "TRUE") -> str:
    return f"""
SELECT COALESCE(AVG(ca.opening_score), 0.0E0) AS average_opening,
  COALESCE(AVG(ca.listening_score), 0.0E0) AS average_listening,
  COALESCE(AVG(ca.empathy_score), 0.0E0) AS average_empathy,
  COALESCE(AVG(ca.closing_score), 0.0E0) AS average_closing
FROM {F1}
WHERE {where}
"""


def human_criteria_scores(where: str = "TRUE", status: str = "review_completed") -> str:
    return f"""
SELECT COALESCE(AVG(ca.response_process_score), 0.0E0) AS average_response_process,
  COALESCE(AVG(ca.system_updation_score), 0.0E0) AS average_system_updation
FROM {F1}
WHERE ca.review_status = '{status}' AND {where}
"""


def sentiment_distribution(where: str = "TRUE") -> str:
    return f"""
SELECT COALESCE(MAX(CASE WHEN label = 'positive' THEN n END), 0) AS positive,
  COALESCE(MAX(CASE WHEN label = 'negative' THEN n END), 0) AS negative,
  COALESCE(MAX(CASE WHEN label = 'neutral' THEN n END), 0) AS neutral
FROM (
  SELECT ca.customer_sentiment_label AS label, COUNT(*) AS n
  FROM {F1}
  WHERE {where}
  GROUP BY ca.customer_sentiment_label
) g
"""


def top_topics(where: str = "TRUE", limit: int = 10) -> str:
    return f"""
SELECT ca.main_topic AS main_topic, COUNT(*) AS "count"
FROM {F1}
WHERE ca.main_topic IS NOT NULL AND ca.main_topic != '' AND {where}
GROUP BY ca.main_topic
ORDER BY COUNT(*) DESC NULLS FIRST, ca.main_topic ASC NULLS LAST
LIMIT {limit}
"""


def leaderboard(where: str = "TRUE") -> str:
    return f"""
SELECT CAST(ROW_NUMBER() OVER (ORDER BY average_score DESC NULLS FIRST, agent_extension ASC NULLS LAST) AS INTEGER) AS rank,
  agent_extension, total_conversations,
  COALESCE(average_score, 0.0E0) AS average_score,
  COALESCE(average_opening_score, 0.0E0) AS average_opening_score,
  COALESCE(average_listening_score, 0.0E0) AS average_listening_score,
  COALESCE(average_empathy_score, 0.0E0) AS average_empathy_score,
  COALESCE(average_response_score, 0.0E0) AS average_response_score,
  COALESCE(average_closing_score, 0.0E0) AS average_closing_score,
  sentiment_improvement_percent,
  COALESCE(average_silence_percent, 0.0E0) AS average_silence_percent
FROM (
  SELECT cl.agent_sender AS agent_extension, COUNT(*) AS total_conversations,
    AVG(ca.final_percentage_score) AS average_score,
    AVG(ca.opening_score) AS average_opening_score,
    AVG(ca.listening_score) AS average_listening_score,
    AVG(ca.empathy_score) AS average_empathy_score,
    AVG(ca.response_process_score) AS average_response_score,
    AVG(ca.closing_score) AS average_closing_score,
    AVG(cl.silence_percentage) AS average_silence_percent,
    CASE WHEN SUM(CASE WHEN ca.customer_sentiment_start = 'negative' THEN 1 ELSE 0 END) > 0
         THEN (CAST(SUM(CASE WHEN ca.customer_sentiment_end = 'positive' THEN 1 ELSE 0 END) AS DOUBLE)
               / CAST(SUM(CASE WHEN ca.customer_sentiment_start = 'negative' THEN 1 ELSE 0 END) AS DOUBLE)) * 100.0E0
         ELSE 0.0E0 END AS sentiment_improvement_percent
  FROM {F1}
  WHERE cl.agent_sender IS NOT NULL AND {where}
  GROUP BY cl.agent_sender
  HAVING COUNT(*) > 0
) a
"""


AGENTS_LIST = """
SELECT DISTINCT CAST(cl.agent_sender AS VARCHAR) AS agent_sender
FROM conversations_log cl
WHERE cl.agent_sender IS NOT NULL
  AND EXISTS (SELECT 1 FROM conversation_analysis ca WHERE ca.conversation_id = cl.id)
"""

AGENTS_TOTAL = f"SELECT COUNT(*) AS total FROM ({AGENTS_LIST}) a"


CRITERIA = ("opening", "listening", "empathy", "response_process", "system_updation", "closing")
SIGNALS = ("user_sentiment_overall", "agent_tone", "agent_energy", "agent_clarity", "agent_patience")
REVIEW_VALUES = (
    [f"{c}_score_override" for c in CRITERIA]
    + [f"{c}_justification_override" for c in CRITERIA]
    + ["strengths_override", "areas_for_improvement_override"]
    + ["total_weighted_score_human", "final_percentage_score_human",
       "other_criteria_weighted_score_human", "other_criteria_percentage_score_human"]
)

# Payload columns are flattened for hashing, on both sides (see registry.flatten).
PAYLOAD_FLAT = """CAST(len(p.conversation_data) AS BIGINT) AS conversation_turns,
  array_to_string(list_transform(p.conversation_data, lambda e: e.role || ': ' || e.text), chr(10)) AS conversation_text,
  CAST(NULL AS BIGINT) AS silence_intervals"""

CALL_COLS = ", ".join(
    ["cl.agent_sender", "cl.unique_id", "cl.total_duration_seconds", "cl.total_silence_seconds",
     "cl.longest_silence_gap_seconds", "cl.silence_percentage"] + [f"cl.{s}" for s in SIGNALS]
)
REVIEW_COLS = ", ".join(["crh.id AS human_review_id"] + [f"crh.{c}" for c in REVIEW_VALUES] + ["crh.reviewer_id",
                        "qu.full_name AS reviewer_full_name", "qu.username AS reviewer_username"])

F2 = (f"{F1} LEFT JOIN conversation_review_human crh ON ca.id = crh.analysis_id "
      "LEFT JOIN qc_users qu ON crh.reviewer_id = qu.id")


def detail(where: str = "TRUE", order: str | None = None, limit: int | None = None, offset: int = 0,
           reviews: bool = True, extra: str = "") -> str:
    cols = f"ca.* EXCLUDE (created_at), {PAYLOAD_FLAT}, {CALL_COLS}"
    if reviews:
        cols += f", {REVIEW_COLS}"
    cols += ", cl.created_at AS created_at" + extra
    src = F2 if reviews else F1
    sql = f"SELECT {cols}\nFROM {src} LEFT JOIN call_payloads p ON p.call_id = cl.id\nWHERE {where}"
    if order:
        sql += f"\nORDER BY {order}"
    if limit is not None:
        sql += f"\nLIMIT {limit} OFFSET {offset}"
    return sql


LISTING_ORDER = "cl.created_at DESC NULLS FIRST, ca.id ASC NULLS LAST, crh.id ASC NULLS FIRST"


def page_info(where: str, page: int, page_size: int, src: str = F1) -> str:
    return f"""
SELECT total, CAST({page} AS BIGINT) AS page, CAST({page_size} AS BIGINT) AS page_size,
  CAST((total + {page_size} - 1) // {page_size} AS BIGINT) AS total_pages
FROM (SELECT COUNT(*) AS total FROM {src} WHERE {where}) c
"""


def listed(columns: str, order: str, src: str, where: str = "TRUE") -> str:
    """The keys of a listing with their place in its order."""
    return f"SELECT {columns}, ROW_NUMBER() OVER (ORDER BY {order}) AS ordinal FROM {src} WHERE {where}"


PAYLOAD_CHUNKS = """
SELECT conv_id AS call_id, CAST(floor(turn / 2) AS BIGINT) AS chunk, CAST(min(turn) AS BIGINT) AS first_turn, count(*) AS n_turns,
  string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text) AS conversation_text
FROM conversations GROUP BY ALL"""
PAGE_AND_INFO = f"SELECT d.*, i.* FROM ({detail(order=LISTING_ORDER, limit=100, offset=100)}) d CROSS JOIN ({page_info('TRUE', 2, 100)}) i"
LAST_PAGE = detail(order=LISTING_ORDER) + f"\nLIMIT 100 OFFSET (SELECT ((COUNT(*) + 99) // 100 - 1) * 100 FROM {F1})"


def unanalyzed_page(where: str, page: int, page_size: int) -> str:
    return f"""
SELECT id, created_at, unique_id, is_analyzed, agent_sender
FROM conversations_log
WHERE is_analyzed = false AND {where}
ORDER BY created_at DESC NULLS FIRST, id ASC NULLS LAST
LIMIT {page_size} OFFSET {(page - 1) * page_size}
"""


def review_by_analysis(where: str = "TRUE") -> str:
    return f"""
SELECT crh.*, qu.full_name AS reviewer_full_name, qu.username AS reviewer_username
FROM conversation_review_human crh LEFT JOIN qc_users qu ON crh.reviewer_id = qu.id
WHERE {where}
"""


REVIEWED_COLS = ", ".join(
    ["ca.id", "ca.created_at"] + [f"ca.{c}_score" for c in CRITERIA]
    + ["ca.total_weighted_score", "ca.final_percentage_score", "ca.conversation_score_ai", "ca.process_score_human",
       "ca.other_criteria_score_human", "ca.final_score_combined", "cl.agent_sender", "cl.unique_id"]
    + [f"crh.{c}_score_override" for c in CRITERIA]
    + ["crh.total_weighted_score_human", "crh.final_percentage_score_human",
       "crh.other_criteria_weighted_score_human", "crh.other_criteria_percentage_score_human",
       "crh.reviewer_id", "qu.full_name AS reviewer_full_name", "qu.username AS reviewer_username"]
)

REVIEWED_WHERE = "ca.review_status = 'completed' AND cl.qc_status = 'completed'"


def reviewed_page(where: str, page: int, page_size: int) -> str:
    return f"""
SELECT {REVIEWED_COLS}
FROM {F2}
WHERE {REVIEWED_WHERE} AND {where}
ORDER BY ca.created_at DESC NULLS FIRST, ca.id ASC NULLS LAST, crh.id ASC NULLS FIRST
LIMIT {page_size} OFFSET {(page - 1) * page_size}
"""


SCORE_DIFFS = ", " + ", ".join(
    f"CASE WHEN crh.id IS NOT NULL THEN COALESCE(crh.{c}_score_override, 0.0E0) - COALESCE(ca.{c}_score, 0.0E0) END "
    f"AS score_difference_{c}"
    for c in CRITERIA
)


def _w(snap: str, key: str, default: int) -> str:
    return f"COALESCE(TRY_CAST(json_extract_string({snap}, '$.{key}') AS DOUBLE), {default}.0E0)"


def max_possible(snap: str) -> str:
    weights = (("opening", 2), ("listening", 12), ("empathy", 10), ("response_process", 15),
               ("system_updation", 12), ("closing", 4))
    return "(" + " + ".join(_w(snap, k, d) for k, d in weights) + ")"


MAX_SCORE = ("(SELECT COALESCE(MAX(TRY_CAST(setting_value AS DOUBLE)), 4.0E0) FROM qc_settings "
             "WHERE setting_key = 'max_score_per_metric')")

SNAP_PRESENT = "({s} IS NOT NULL AND COALESCE(len(json_keys({s})) > 0, false))"

MAX_POSSIBLE_SCORES = f"""
SELECT id, {SNAP_PRESENT.format(s='weights_snapshot')} AS weights_snapshot_present,
  CASE WHEN {SNAP_PRESENT.format(s='weights_snapshot')} THEN {MAX_SCORE} * {max_possible('weights_snapshot')} END
    AS max_possible_overall_score
FROM conversation_analysis
"""

SUBMISSION_VALUES = ["reviewer_id"] + REVIEW_VALUES

ACTIONS_CTE = f"""
WITH last_sub AS (
  SELECT * FROM review_submissions QUALIFY ROW_NUMBER() OVER (PARTITION BY analysis_id ORDER BY seq DESC) = 1
), decided AS (
  SELECT l.*, r.analysis_id IS NOT NULL AS has_review, ca.weights_snapshot AS snap, ca.id IS NOT NULL AS has_analysis
  FROM last_sub l
  LEFT JOIN (SELECT DISTINCT analysis_id FROM conversation_review_human) r ON r.analysis_id = l.analysis_id
  LEFT JOIN conversation_analysis ca ON ca.id = l.analysis_id
), actions AS (
  SELECT *,
    CASE WHEN has_review THEN 'update' WHEN {SNAP_PRESENT.format(s='snap')} THEN 'insert' ELSE 'reject' END AS action
  FROM decided
)
"""

LAST_SETTINGS = "(SELECT * FROM setting_changes QUALIFY ROW_NUMBER() OVER (PARTITION BY setting_key ORDER BY seq DESC) = 1)"
SETTING_CHANGES_APPLIED = f"""
SELECT s.setting_key, c.updated_by, c.updated_at FROM qc_settings s LEFT JOIN {LAST_SETTINGS} c ON c.setting_key = s.setting_key"""
WEIGHTS_AFTER_CHANGES = f"""
SELECT COALESCE(CAST(c.opening AS DOUBLE), 2.0E0) AS opening, COALESCE(CAST(c.listening AS DOUBLE), 12.0E0) AS listening,
  COALESCE(CAST(c.opening AS DOUBLE), 10.0E0) AS empathy, COALESCE(CAST(c.response_process AS DOUBLE), 16.0E0) AS response_process,
  COALESCE(CAST(c.listening AS DOUBLE), 12.0E0) AS system_updation, COALESCE(CAST(c.response_process AS DOUBLE), 4.0E0) AS closing
FROM (SELECT 1) one LEFT JOIN {LAST_SETTINGS} c ON c.setting_key = 'weights'"""
MAX_SCORE_AFTER_CHANGES = f"""
SELECT COALESCE(CAST(c.setting_value AS DOUBLE), 4.0E0) AS max_score_per_metric
FROM (SELECT 1) one LEFT JOIN {LAST_SETTINGS} c ON c.setting_key = 'max_score_per_metric'"""

# Requests one after the other: a group's state is the list of its users; names and ids are the group's own.
_REQUEST = "seq := {seq}, op := {op}, id := {id}, username := {username}, live := {live}, done := {done}"
_NO_STATE = "CAST([] AS STRUCT(id BIGINT, username VARCHAR, since BIGINT)[])", "CAST([] AS STRUCT(seq BIGINT, reason VARCHAR)[])"
_TAKEN_NAME = "len(list_filter(s.live, lambda x: x.username = e.username)) > 0"
_TAKEN_ID = "len(list_filter(s.live, lambda x: x.id = e.id)) > 0"
USER_CHANGES_CTE = f"""
, requests AS (SELECT grp, list(struct_pack({_REQUEST.format(seq="CAST(seq AS BIGINT)", op="op", id="CAST(id AS BIGINT)", username="CAST(username AS VARCHAR)", live=_NO_STATE[0], done=_NO_STATE[1])}) ORDER BY seq) AS feed
  FROM user_changes GROUP BY grp),
folded AS (SELECT r.grp, list_reduce(list_concat([struct_pack({_REQUEST.format(seq="CAST(-1 AS BIGINT)", op="'start'", id="CAST(0 AS BIGINT)", username="CAST('' AS VARCHAR)", done=_NO_STATE[1],
    live="CASE WHEN u.id IS NULL THEN " + _NO_STATE[0] + " ELSE [struct_pack(id := CAST(u.id AS BIGINT), username := CAST(u.username AS VARCHAR), since := CAST(-1 AS BIGINT))] END")})], feed),
  lambda s, e: struct_pack({_REQUEST.format(seq="e.seq", op="e.op", id="e.id", username="e.username",
    live=f"CASE WHEN e.op = 'delete' THEN list_filter(s.live, lambda x: x.id <> e.id) WHEN e.op = 'create' AND NOT ({_TAKEN_NAME}) AND NOT ({_TAKEN_ID}) THEN list_append(s.live, struct_pack(id := e.id, username := e.username, since := e.seq)) ELSE s.live END",
    done=f"CASE WHEN e.op <> 'create' THEN s.done WHEN {_TAKEN_NAME} THEN list_append(s.done, struct_pack(seq := e.seq, reason := 'duplicate_username')) WHEN {_TAKEN_ID} THEN list_append(s.done, struct_pack(seq := e.seq, reason := 'duplicate_id')) ELSE s.done END")})) AS state
  FROM requests r LEFT JOIN qc_users u ON u.id = r.grp),
living AS (SELECT unnest(state.live, recursive := true) FROM folded UNION ALL SELECT id, username, -1 FROM qc_users WHERE id NOT IN (SELECT grp FROM user_changes)),
sent AS (SELECT l.id, arg_max(c.full_name, c.seq) FILTER (c.full_name IS NOT NULL) AS full_name, arg_max(c.role, c.seq) FILTER (c.role IS NOT NULL) AS role,
    arg_max(c.is_active, c.seq) FILTER (c.is_active IS NOT NULL) AS is_active
  FROM living l JOIN user_changes c ON c.op = 'update' AND c.id = l.id AND c.seq > l.since GROUP BY l.id)
"""
USER_CHANGES_APPLIED = USER_CHANGES_CTE + """
SELECT l.id, l.username, coalesce(s.full_name, CASE WHEN l.since < 0 THEN u.full_name ELSE c.full_name END) AS full_name,
  coalesce(s.role, CASE WHEN l.since < 0 THEN u.role ELSE coalesce(c.role, 'agent') END) AS role,
  coalesce(s.is_active, CASE WHEN l.since < 0 THEN u.is_active ELSE true END) AS is_active,
  CASE WHEN l.since < 0 THEN u.created_at ELSE c.created_at END AS created_at
FROM living l LEFT JOIN sent s ON s.id = l.id LEFT JOIN qc_users u ON u.id = l.id AND l.since < 0
LEFT JOIN user_changes c ON c.seq = l.since"""
USER_CHANGES_REJECTED = USER_CHANGES_CTE + """
SELECT c.seq, c.op, c.id, c.username, d.reason FROM (SELECT unnest(state.done, recursive := true) FROM folded) d JOIN user_changes c ON c.seq = d.seq
UNION ALL SELECT seq, op, id, username, 'empty_update' FROM user_changes WHERE op = 'update' AND full_name IS NULL AND role IS NULL AND is_active IS NULL"""

SUBMIT_ACTIONS = ACTIONS_CTE + """
SELECT analysis_id, seq, action,
  CASE WHEN action = 'reject' THEN CASE WHEN NOT has_analysis THEN 'analysis_not_found'
                                        ELSE 'weights_snapshot_missing' END END AS reason
FROM actions
"""

SUBMIT_REVIEWS = ACTIONS_CTE + f"""
SELECT crh.id, crh.analysis_id,
  {", ".join(f"CASE WHEN u.analysis_id IS NOT NULL THEN u.{c} ELSE crh.{c} END AS {c}" for c in SUBMISSION_VALUES)},
  crh.weights_snapshot, crh.max_possible_overall_score
FROM conversation_review_human crh
LEFT JOIN (SELECT * FROM actions WHERE action = 'update') u ON u.analysis_id = crh.analysis_id
UNION ALL
SELECT analysis_id + 4000000000 AS id, analysis_id, {", ".join(SUBMISSION_VALUES)},
  snap AS weights_snapshot, {MAX_SCORE} * {max_possible('snap')} AS max_possible_overall_score
FROM actions WHERE action = 'insert'
"""

REVIEW_CHANGES = SUBMIT_REVIEWS.replace("LEFT JOIN (SELECT * FROM actions WHERE action = 'update')", "JOIN (SELECT * FROM actions WHERE action = 'update')")

ACCEPTED = "(SELECT analysis_id FROM actions WHERE action <> 'reject')"

HUMAN_AFTER_SUBMIT = ACTIONS_CTE + human_criteria_scores("TRUE").replace("ca.review_status = 'review_completed'", f"(ca.review_status = 'completed' OR ca.id IN {ACCEPTED})")

REVIEW_STATUS_AFTER_SUBMIT = ACTIONS_CTE + f"""
SELECT ca.id, ca.conversation_id,
  CASE WHEN ca.id IN {ACCEPTED} THEN 'completed' ELSE ca.review_status END AS review_status
FROM conversation_analysis ca
"""

QC_STATUS_AFTER_SUBMIT = ACTIONS_CTE + f"""
SELECT cl.id,
  CASE WHEN cl.id IN (SELECT conversation_id FROM conversation_analysis WHERE id IN {ACCEPTED})
       THEN 'completed' ELSE cl.qc_status END AS qc_status
FROM conversations_log cl
"""

REVIEW_STATUS_CHANGES = ACTIONS_CTE + f"""
SELECT id, conversation_id, 'completed' AS review_status FROM conversation_analysis
WHERE id IN {ACCEPTED} AND review_status IS DISTINCT FROM 'completed'
"""

QC_STATUS_CHANGES = ACTIONS_CTE + f"""
SELECT id, 'completed' AS qc_status FROM conversations_log
WHERE qc_status IS DISTINCT FROM 'completed' AND id IN (SELECT conversation_id FROM conversation_analysis WHERE id IN {ACCEPTED})
"""

CONVERSATION_STATUS = f"SELECT ca.id AS analysis_id, ca.review_status, cl.qc_status, cl.unique_id FROM {F1}"

CALL_SIGNALS = (f"SELECT ca.id AS analysis_id, ca.conversation_id, cl.id AS log_id, cl.unique_id, cl.agent_sender, "
                + ", ".join(f"cl.{s}" for s in SIGNALS) + f" FROM {F1}")

CALL_SIGNALS_DIRECT = "SELECT id, unique_id, " + ", ".join(SIGNALS) + " FROM conversations_log"

COMPLETED_SAMPLE = (f"SELECT ca.id, ca.conversation_id, cl.agent_sender, cl.unique_id, "
                    + ", ".join(f"cl.{s}" for s in SIGNALS)
                    + f" FROM {F1} WHERE ca.review_status = 'completed' ORDER BY ca.id ASC LIMIT 1")

USERS_LIST = """
SELECT id, username, full_name, role, is_active, CAST(created_at AS VARCHAR) AS created_at
FROM qc_users
ORDER BY qc_users.created_at DESC NULLS FIRST, id ASC
"""


def overview(date_range: str | None = None, agent: str | None = None, start=None, end=None,
             status: str = "review_completed") -> str:
    """The four global panels side by side, each with its own day-range rules."""
    a = f"cl.agent_sender = '{agent}'" if agent else "TRUE"
    d_all = date_pred(date_range, start, end)
    d_noy = "TRUE" if date_range == "yesterday" else d_all
    return f"""
SELECT * FROM ({kpis(a + " AND " + d_all)}) k
CROSS JOIN ({criteria_scores(a + " AND " + d_noy)}) c
CROSS JOIN ({human_criteria_scores(a + " AND " + d_noy, status)}) h
CROSS JOIN ({sentiment_distribution(a + " AND " + d_noy)}) s
"""
