"""Test tables derived from the driver's parquet files (FIXTURES.md part B).

The derivations are SQL text that runs unchanged on Spark and DuckDB: Spark builds the
views from ``events``, ``supplier`` and ``conversations`` here, and the DuckDB oracle
uses the very same text as CTEs, so an oracle mismatch always points at an operator,
never at the test data.  Table references are ``{name}`` placeholders (braces inside
string literals are doubled).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from callqc.sources.tables import Tables

# Fixed "today" of every date filter in the tests: the events span 2024-01-01 .. 2024-01-30.
AS_OF = "2024-01-30"

# View definitions copied from FIXTURES.md part B (plus the review feed's
# constant columns described there).
VIEW_SQL = {
    "conversations_log": """
SELECT event_id AS id, ts AS created_at,
  concat('CALL', lpad(CAST(event_id AS STRING), 8, '0')) AS unique_id,
  CASE WHEN user_id % 37 = 0 THEN NULL ELSE CAST(1000 + user_id AS STRING) END AS agent_sender,
  event_id % 5 <> 4 AS is_analyzed,
  CASE WHEN event_id % 5 = 4 THEN 'not_started'
       WHEN event_id % 3 = 0 AND event_id % 21 <> 0 THEN 'completed' ELSE 'pending' END AS qc_status,
  60 + (event_id * 37) % 540 AS total_duration_seconds,
  (event_id * 13) % 60 AS total_silence_seconds,
  CAST((event_id * 7) % 20 AS DOUBLE) / 2 AS longest_silence_gap_seconds,
  CASE WHEN event_id % 50 = 0 THEN NULL ELSE CAST((event_id * 13) % 60 AS DOUBLE) / 4 END AS silence_percentage,
  CASE WHEN event_id % 4 = 0 THEN 'positive' WHEN event_id % 4 = 1 THEN 'negative' WHEN event_id % 4 = 2 THEN 'neutral' END AS user_sentiment_overall,
  CASE WHEN event_id % 3 = 0 THEN 'warm' WHEN event_id % 3 = 1 THEN 'flat' END AS agent_tone,
  CASE WHEN event_id % 2 = 0 THEN 'high' ELSE 'low' END AS agent_energy,
  CASE WHEN event_id % 6 < 3 THEN 'clear' ELSE 'unclear' END AS agent_clarity,
  CASE WHEN event_id % 9 < 5 THEN 'patient' END AS agent_patience
FROM {events}
""",
    "analysis_base": """
SELECT event_id + 5000000000 AS id, event_id AS conversation_id, ts + INTERVAL '2' HOUR AS created_at,
  event_id, user_id, event_type,
  CASE WHEN event_id % 41 = 0 THEN NULL ELSE CAST((event_id * 2 + user_id) % 9 AS DOUBLE) / 2 END AS opening_score,
  CAST((event_id * 4 + user_id) % 9 AS DOUBLE) / 2 AS listening_score,
  CAST((event_id * 5 + user_id * 2) % 9 AS DOUBLE) / 2 AS empathy_score,
  CAST((event_id * 7 + user_id) % 9 AS DOUBLE) / 2 AS response_process_score,
  CAST((event_id * 8 + user_id * 4) % 9 AS DOUBLE) / 2 AS system_updation_score,
  CAST((event_id + user_id * 5) % 9 AS DOUBLE) / 2 AS closing_score
FROM {events} WHERE event_id % 5 <> 4
""",
    "analysis_weighted": """
SELECT *, 2 * COALESCE(opening_score, 0) + 12 * listening_score + 10 * empathy_score
  + 15 * response_process_score + 12 * system_updation_score + 4 * closing_score AS total_weighted_score
FROM {analysis_base}
""",
    "conversation_analysis": """
SELECT id, conversation_id, created_at, opening_score, listening_score, empathy_score,
  response_process_score, system_updation_score, closing_score, total_weighted_score,
  CASE WHEN user_id % 29 = 7 THEN NULL ELSE CAST(FLOOR(total_weighted_score * 400 / 220) AS DOUBLE) / 4 END AS final_percentage_score,
  CAST((event_id * 11) % 401 AS DOUBLE) / 4 AS conversation_score_ai,
  CASE WHEN event_id % 3 = 0 THEN CAST((event_id * 17) % 401 AS DOUBLE) / 4 END AS process_score_human,
  CASE WHEN event_id % 3 = 0 THEN CAST((event_id * 19) % 401 AS DOUBLE) / 4 END AS other_criteria_score_human,
  CAST((event_id * 23) % 401 AS DOUBLE) / 4 AS final_score_combined,
  CASE WHEN event_id % 7 < 3 THEN 'positive' WHEN event_id % 7 < 5 THEN 'negative'
       WHEN event_id % 7 = 5 THEN 'neutral' WHEN event_id % 2 = 0 THEN 'mixed' END AS customer_sentiment_label,
  CASE WHEN (event_id + user_id) % 4 = 0 THEN 'positive'
       WHEN (event_id + user_id) % 4 < 3 AND user_id % 19 <> 3 THEN 'negative' ELSE 'neutral' END AS customer_sentiment_start,
  CASE WHEN (event_id * 3 + user_id) % 5 < 2 THEN 'positive'
       WHEN (event_id * 3 + user_id) % 5 = 2 THEN 'negative' ELSE 'neutral' END AS customer_sentiment_end,
  CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 11 = 0 THEN ''
       ELSE concat(event_type, '_', CAST(user_id % 8 AS STRING)) END AS main_topic,
  concat('s', CAST(event_id % 10 AS STRING)) AS strengths,
  concat('a', CAST(event_id % 6 AS STRING)) AS areas_for_improvement,
  CASE WHEN event_id % 3 = 0 THEN 'completed' WHEN event_id % 12 = 1 THEN 'review_completed' ELSE 'pending_review' END AS review_status,
  CASE WHEN event_id % 101 = 0 THEN NULL WHEN event_id % 103 = 0 THEN '{{}}'
       WHEN event_id % 17 = 0 THEN '{{"opening":2,"listening":12,"empathy":10,"responseProcess":20,"systemUpdation":8,"closing":4}}'
       ELSE concat('{{"opening":', CAST(2 + event_id % 3 AS STRING), ',"listening":12,"empathy":10,"response_process":',
                   CAST(10 + event_id % 10 AS STRING), ',"system_updation":12,"closing":4}}') END AS weights_snapshot
FROM {analysis_weighted}
""",
    "conversation_review_human": """
SELECT conversation_id + 9000000000 AS id, id AS analysis_id,
  CASE WHEN conversation_id % 13 = 12 THEN -1 ELSE conversation_id % 10 END AS reviewer_id,
  CASE WHEN conversation_id % 4 = 0 THEN NULL ELSE CAST((conversation_id * 5) % 9 AS DOUBLE) / 2 END AS opening_score_override,
  CAST((conversation_id * 2) % 9 AS DOUBLE) / 2 AS listening_score_override,
  CASE WHEN conversation_id % 8 = 3 THEN NULL ELSE CAST((conversation_id * 4) % 9 AS DOUBLE) / 2 END AS empathy_score_override,
  CAST((conversation_id * 7) % 9 AS DOUBLE) / 2 AS response_process_score_override,
  CAST((conversation_id * 8) % 9 AS DOUBLE) / 2 AS system_updation_score_override,
  CASE WHEN conversation_id % 8 = 1 THEN NULL ELSE CAST(conversation_id % 9 AS DOUBLE) / 2 END AS closing_score_override,
  CASE WHEN conversation_id % 4 <> 0 THEN concat('j', CAST(conversation_id % 5 AS STRING)) END AS opening_justification_override,
  CAST(NULL AS STRING) AS listening_justification_override,
  CAST(NULL AS STRING) AS empathy_justification_override,
  CAST(NULL AS STRING) AS response_process_justification_override,
  CAST(NULL AS STRING) AS system_updation_justification_override,
  CAST(NULL AS STRING) AS closing_justification_override,
  concat('hs', CAST(conversation_id % 4 AS STRING)) AS strengths_override,
  CAST(NULL AS STRING) AS areas_for_improvement_override,
  CAST((conversation_id * 3) % 881 AS DOUBLE) / 4 AS total_weighted_score_human,
  CAST((conversation_id * 5) % 401 AS DOUBLE) / 4 AS final_percentage_score_human,
  CAST((conversation_id * 7) % 641 AS DOUBLE) / 4 AS other_criteria_weighted_score_human,
  CAST((conversation_id * 9) % 401 AS DOUBLE) / 4 AS other_criteria_percentage_score_human,
  weights_snapshot, CAST(220 AS DOUBLE) AS max_possible_overall_score
FROM {conversation_analysis} WHERE review_status <> 'pending_review' AND conversation_id % 30 <> 0
""",
    "qc_users": """
SELECT s.s_suppkey AS id, s.s_name AS username,
  CASE WHEN s.s_suppkey % 5 = 0 THEN NULL ELSE concat('Reviewer ', CAST(s.s_suppkey AS STRING)) END AS full_name,
  CASE WHEN s.s_suppkey % 3 = 0 THEN 'admin' WHEN s.s_suppkey % 3 = 1 THEN 'supervisor' ELSE 'agent' END AS role,
  s.s_suppkey % 7 <> 6 AS is_active, e.ts - INTERVAL '30' DAY AS created_at
FROM {supplier} s JOIN {events} e ON e.event_id = s.s_suppkey
""",
    "qc_settings": """
SELECT 'weights' AS setting_key, '{{"opening":2,"listening":12,"empathy":10,"responseProcess":16,"closing":4}}' AS setting_value
UNION ALL SELECT 'max_score_per_metric', '4'
""",
    "review_submissions": """
SELECT seq, analysis_id, reviewer_id, opening_score_override,
  CAST(NULL AS DOUBLE) AS listening_score_override,
  CAST(NULL AS DOUBLE) AS empathy_score_override,
  CAST(NULL AS DOUBLE) AS response_process_score_override,
  CAST(NULL AS DOUBLE) AS system_updation_score_override,
  CAST(NULL AS DOUBLE) AS closing_score_override,
  CAST(NULL AS STRING) AS opening_justification_override,
  CAST(NULL AS STRING) AS listening_justification_override,
  CAST(NULL AS STRING) AS empathy_justification_override,
  CAST(NULL AS STRING) AS response_process_justification_override,
  CAST(NULL AS STRING) AS system_updation_justification_override,
  CAST(NULL AS STRING) AS closing_justification_override,
  CAST(NULL AS STRING) AS strengths_override,
  CAST(NULL AS STRING) AS areas_for_improvement_override,
  total_weighted_score_human,
  total_weighted_score_human AS final_percentage_score_human,
  total_weighted_score_human AS other_criteria_weighted_score_human,
  total_weighted_score_human AS other_criteria_percentage_score_human
FROM (
  SELECT event_id AS seq, 5000000000 + ((event_id - event_id % 2) * 7) % ((SELECT COUNT(*) FROM {events}) + 5) AS analysis_id, event_id % 10 AS reviewer_id,
    CASE WHEN event_id % 4 = 3 THEN NULL ELSE CAST(event_id % 9 AS DOUBLE) / 2 END AS opening_score_override,
    CAST((event_id * 3) % 881 AS DOUBLE) / 4 AS total_weighted_score_human
  FROM {events} WHERE event_id % 10 IN (2, 3, 6)
) s
""",
    # settings sent with events: weights as numbers (the JSON text is made on the way in), the maximum
    # score, and a key that does not exist
    "setting_changes": """
SELECT event_id AS seq,
  CASE WHEN event_id % 3 = 0 THEN 'weights' WHEN event_id % 3 = 1 THEN 'max_score_per_metric' ELSE 'unknown' END AS setting_key,
  CAST(3 + event_id % 5 AS STRING) AS setting_value, CAST(user_id AS STRING) AS updated_by, ts AS updated_at,
  1 + event_id % 4 AS opening, 2 + user_id % 9 AS listening, event_id % 13 AS response_process
FROM {events} WHERE event_id % 11 = 5
""",
    # requests of every seventh event: names and ids of a group (a user id) are asked for, dropped and
    # asked for again; slot 0 is the reviewer of that number where there is one
    "user_changes": """
SELECT seq, op, CASE WHEN slot = 0 THEN grp ELSE 1000000 + grp * 10 + slot END AS id,
  CASE WHEN op = 'create' THEN CASE WHEN name = 0 THEN concat('Supplier#', lpad(CAST(grp AS STRING), 9, '0'))
    ELSE concat('user-', CAST(grp AS STRING), '-', CAST(name AS STRING)) END END AS username,
  CASE WHEN seq % 3 = 0 THEN NULL ELSE concat('Name ', CAST(seq AS STRING)) END AS full_name,
  CASE WHEN seq % 4 = 1 THEN 'admin' WHEN seq % 4 = 2 THEN 'supervisor' END AS role,
  CASE WHEN op <> 'create' AND seq % 5 = 1 THEN seq % 2 = 0 END AS is_active,
  ts AS created_at, grp
FROM (
  SELECT event_id AS seq, user_id AS grp, (event_id * 5) % 11 % 3 AS slot, (event_id * 3) % 13 % 3 AS name, ts,
    CASE WHEN event_id % 9 < 4 THEN 'create' WHEN event_id % 9 < 6 THEN 'update' ELSE 'delete' END AS op
  FROM {events} WHERE event_id % 7 = 0 OR user_id % 5 = 1
) r
""",
}

BASE_TABLES = ("events", "supplier", "conversations")

# New review ids of the test tables: existing reviews use analysis id + 4e9 (= call id + 9e9).
FIXTURE_REVIEW_ID_OFFSET = 4_000_000_000


# DuckDB form of ``Tables.payloads()`` over the turn rows (Spark folds them with
# sort_array(collect_list(struct(turn, role, text)))).
DUCKDB_PAYLOADS = """
SELECT conv_id AS call_id,
  list(struct_pack(turn := turn, role := role, text := text) ORDER BY turn, role, text) AS conversation_data
FROM conversations GROUP BY conv_id
"""


def duckdb_ctes() -> str:
    """``WITH`` clause defining every fixture view for DuckDB (no trailing query)."""
    names = {n: n for n in list(VIEW_SQL) + list(BASE_TABLES)}
    parts = [f"{name} AS ({sql.format(**names).strip()})" for name, sql in VIEW_SQL.items()]
    parts.append(f"call_payloads AS ({DUCKDB_PAYLOADS.strip()})")
    return "WITH " + ",\n".join(parts)


_CACHE: dict[tuple[str, str], dict[str, DataFrame]] = {}


def fixture_views(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _CACHE:
        frames: dict[str, DataFrame] = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in BASE_TABLES}
        for name, sql in VIEW_SQL.items():
            frames[name] = spark.sql(sql, **frames)
        _CACHE[key] = frames
    return _CACHE[key]


def fixture_tables(spark: SparkSession, sf_dir: str) -> Tables:
    v = fixture_views(spark, sf_dir)
    return Tables(
        conversations_log=v["conversations_log"],
        conversation_analysis=v["conversation_analysis"],
        conversation_review_human=v["conversation_review_human"],
        qc_users=v["qc_users"],
        qc_settings=v["qc_settings"],
        conversation_turns=v["conversations"],
    )


def user_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture_views(spark, sf_dir)["user_changes"].drop("grp")


def setting_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture_views(spark, sf_dir)["setting_changes"]


def review_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture_views(spark, sf_dir)["review_submissions"]
