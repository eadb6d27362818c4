"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per key.

Every entry runs an operator over the whole derived tables of ``sf_dir`` with fixed
parameters; ``callqc.oracle`` holds the matching DuckDB SQL under the same key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callqc.operators import comparison, conversations, dashboard, leaderboard, merges, reviews, scripts, settings, summaries, users
from callqc.plans.facts import analysed_calls, q
from callqc.plans.ordinal import as_listed
from callqc.sources.fixtures import AS_OF, FIXTURE_REVIEW_ID_OFFSET, fixture_tables, review_submissions, setting_changes, user_changes
from callqc.sources.schemas import CRITERIA
from callqc.sources.tables import payload_chunks

Query = Callable[[SparkSession, str], DataFrame]


def _t(spark, sf_dir):
    return fixture_tables(spark, sf_dir)


def flatten(df: DataFrame) -> DataFrame:
    """Nested outputs as scalar columns, so that both engines hash the same values."""
    exprs = []
    for c in df.columns:
        if c == "conversation_data":
            exprs += [
                "CAST(CASE WHEN conversation_data IS NOT NULL THEN size(conversation_data) END AS BIGINT)"
                " AS conversation_turns",
                "CASE WHEN conversation_data IS NOT NULL THEN concat_ws(char(10), "
                "transform(conversation_data, e -> concat(e.role, ': ', e.text))) END AS conversation_text",
            ]
        elif c == "silence_timeline":
            exprs.append("CAST(CASE WHEN silence_timeline IS NOT NULL THEN size(silence_timeline) END AS BIGINT)"
                         " AS silence_intervals")
        elif c == "score_differences":
            exprs += [f"score_differences.{k} AS score_difference_{k}" for k in CRITERIA]
        else:
            exprs.append(q(c))
    return df.selectExpr(*exprs)


def _feed_analyses(spark, sf_dir) -> DataFrame:
    """Analyses referenced by the review-submission feed (a key set derived from the data)."""
    return review_submissions(spark, sf_dir).select("analysis_id").distinct()


# Ids of single look-ups: a completed analysis with a review and payloads, and its call.
ONE_ANALYSIS, ONE_CALL = 5_000_000_003, "CALL00000003"
SOME_ANALYSES = (ONE_ANALYSIS, 5_000_000_005, 5_000_000_006, 4)

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(key: str, fn: Query, sql: str | None) -> None:
    QUERIES[key] = fn
    if sql is not None:
        ORACLE[key] = sql


def _build() -> None:
    from callqc import oracle as o

    # --- dashboard KPIs -------------------------------------------------------------
    register("kpis", lambda s, d: dashboard.kpis(_t(s, d), as_of=AS_OF), o.kpis())
    register("kpis_last7days", lambda s, d: dashboard.kpis(_t(s, d), date_range="last7days", as_of=AS_OF),
             o.kpis(o.date_pred("last7days")))
    register("kpis_yesterday", lambda s, d: dashboard.kpis(_t(s, d), date_range="yesterday", as_of=AS_OF),
             o.kpis(o.date_pred("yesterday")))
    register("kpis_custom_agent",
             lambda s, d: dashboard.kpis(_t(s, d), agent_id="1003", date_range="custom",
                                         start_date="2024-01-05", end_date="2024-01-20", as_of=AS_OF),
             o.kpis("cl.agent_sender = '1003' AND " + o.date_pred("custom", "2024-01-05", "2024-01-20")))


    # --- other dashboard panels ------------------------------------------------------
    cust = ("custom", "2024-01-05", "2024-01-20")
    register("score_trends", lambda s, d: dashboard.score_trends(_t(s, d), as_of=AS_OF),
             o.score_trends(o.date_pred("last7days")))
    register("score_trends_last30days", lambda s, d: dashboard.score_trends(_t(s, d), date_range="last30days", as_of=AS_OF),
             o.score_trends(o.date_pred("last30days")))
    register("score_trends_yesterday_is_all",
             lambda s, d: dashboard.score_trends(_t(s, d), date_range="yesterday", as_of=AS_OF),
             o.score_trends("TRUE"))
    register("score_trends_custom_agent",
             lambda s, d: dashboard.score_trends(_t(s, d), agent_id="1007", date_range="custom",
                                                 start_date=cust[1], end_date=cust[2], as_of=AS_OF),
             o.score_trends("cl.agent_sender = '1007' AND " + o.date_pred(*cust)))
    register("criteria_scores", lambda s, d: dashboard.criteria_scores(_t(s, d), as_of=AS_OF), o.criteria_scores())
    register("criteria_scores_today", lambda s, d: dashboard.criteria_scores(_t(s, d), date_range="today", as_of=AS_OF),
             o.criteria_scores(o.date_pred("today")))
    register("criteria_scores_yesterday_is_all",
             lambda s, d: dashboard.criteria_scores(_t(s, d), date_range="yesterday", as_of=AS_OF),
             o.criteria_scores())
    register("human_criteria_scores", lambda s, d: dashboard.human_criteria_scores(_t(s, d), as_of=AS_OF),
             o.human_criteria_scores())
    register("human_criteria_scores_completed_last30days",
             lambda s, d: dashboard.human_criteria_scores(_t(s, d), date_range="last30days", as_of=AS_OF,
                                                          status="completed"),
             o.human_criteria_scores(o.date_pred("last30days"), status="completed"))
    register("sentiment_distribution", lambda s, d: dashboard.sentiment_distribution(_t(s, d), as_of=AS_OF),
             o.sentiment_distribution())
    register("sentiment_distribution_yesterday_is_all",
             lambda s, d: dashboard.sentiment_distribution(_t(s, d), date_range="yesterday", as_of=AS_OF),
             o.sentiment_distribution())
    register("top_topics", lambda s, d: dashboard.top_topics(_t(s, d), as_of=AS_OF), o.top_topics())
    register("top_topics_50_last7days",
             lambda s, d: dashboard.top_topics(_t(s, d), date_range="last7days", as_of=AS_OF, limit=50),
             o.top_topics(o.date_pred("last7days"), 50))
    register("top_topics_agent_custom",
             lambda s, d: dashboard.top_topics(_t(s, d), agent_id="1003", date_range="custom",
                                               start_date=cust[1], end_date=cust[2], as_of=AS_OF, limit=5),
             o.top_topics("cl.agent_sender = '1003' AND " + o.date_pred(*cust), 5))

    register("dashboard_overview", lambda s, d: dashboard.overview(_t(s, d), as_of=AS_OF), o.overview())
    register("dashboard_overview_yesterday",
             lambda s, d: dashboard.overview(_t(s, d), date_range="yesterday", as_of=AS_OF), o.overview("yesterday"))
    register("dashboard_overview_custom_agent",
             lambda s, d: dashboard.overview(_t(s, d), agent_id="1003", date_range="custom", start_date=cust[1],
                                             end_date=cust[2], as_of=AS_OF, status="completed"),
             o.overview("custom", "1003", cust[1], cust[2], "completed"))

    # --- leaderboard and agents --------------------------------------------------------
    register("leaderboard", lambda s, d: leaderboard.leaderboard(_t(s, d), as_of=AS_OF), o.leaderboard())
    register("leaderboard_last7days",
             lambda s, d: leaderboard.leaderboard(_t(s, d), date_range="last7days", as_of=AS_OF),
             o.leaderboard(o.date_pred("last7days")))
    register("leaderboard_custom",
             lambda s, d: leaderboard.leaderboard(_t(s, d), date_range="custom", start_date=cust[1],
                                                  end_date=cust[2], as_of=AS_OF),
             o.leaderboard(o.date_pred(*cust)))
    register("agents_list", lambda s, d: leaderboard.agents_list(_t(s, d)), o.AGENTS_LIST)
    register("agents_total", lambda s, d: leaderboard.agents_total(_t(s, d)), o.AGENTS_TOTAL)


    # --- conversation listings ---------------------------------------------------------
    register("analyzed_page", lambda s, d: flatten(conversations.analyzed_page(_t(s, d), as_of=AS_OF)),
             o.detail(order=o.LISTING_ORDER, limit=100))
    register("analyzed_page_2_search",
             lambda s, d: flatten(conversations.analyzed_page(_t(s, d), unique_id=" 0_1 ", page=2, page_size=50,
                                                             as_of=AS_OF)),
             o.detail("cl.unique_id ILIKE '%0_1%'", o.LISTING_ORDER, 50, 50))
    register("analyzed_page_filtered",
             lambda s, d: flatten(conversations.analyzed_page(_t(s, d), agent_id="1012", status="completed",
                                                             date_range="last30days", page_size=20, as_of=AS_OF)),
             o.detail("cl.agent_sender = '1012' AND ca.review_status = 'completed' AND " + o.date_pred("last30days"),
                      o.LISTING_ORDER, 20))
    register("analyzed_page_max_size",
             lambda s, d: flatten(conversations.analyzed_page(_t(s, d), page_size=10_000, as_of=AS_OF)),
             o.detail(order=o.LISTING_ORDER, limit=10_000))
    register("analyzed_page_deep",
             lambda s, d: flatten(conversations.analyzed_page(_t(s, d), page=79, page_size=100, as_of=AS_OF)),
             o.detail(order=o.LISTING_ORDER, limit=100, offset=7_800))
    register("analyzed_page_and_info", lambda s, d: _page_and_info(_t(s, d)), o.PAGE_AND_INFO)
    register("analyzed_page_last", lambda s, d: flatten(_last_page(_t(s, d))), o.LAST_PAGE)
    register("analyzed_page_after", lambda s, d: flatten(_next_page(_t(s, d))), o.detail(order=o.LISTING_ORDER, limit=100, offset=100))
    register("analyzed_page_info", lambda s, d: conversations.analyzed_page_info(_t(s, d), as_of=AS_OF),
             o.page_info("TRUE", 1, 100))
    register("analyzed_page_info_filtered",
             lambda s, d: conversations.analyzed_page_info(_t(s, d), agent_id="1012", status="completed",
                                                          date_range="last30days", page=3, page_size=7, as_of=AS_OF),
             o.page_info("cl.agent_sender = '1012' AND ca.review_status = 'completed' AND "
                         + o.date_pred("last30days"), 3, 7))
    register("payload_chunks", lambda s, d: _chunks(_t(s, d)), o.PAYLOAD_CHUNKS)
    register("analyzed_detail",
             lambda s, d: flatten(conversations.analyzed_detail(_t(s, d), _feed_analyses(s, d))),
             o.detail("ca.id IN (SELECT analysis_id FROM review_submissions)"))
    register("analyzed_detail_one",
             lambda s, d: flatten(conversations.analyzed_detail(_t(s, d), ONE_ANALYSIS)), o.detail(f"ca.id = {ONE_ANALYSIS}"))
    register("unanalyzed_page", lambda s, d: conversations.unanalyzed_page(_t(s, d)),
             o.unanalyzed_page("TRUE", 1, 100))
    register("unanalyzed_page_3_agent",
             lambda s, d: conversations.unanalyzed_page(_t(s, d), agent_id="1020", unique_id="call", page=3,
                                                       page_size=2),
             o.unanalyzed_page("agent_sender = '1020' AND unique_id ILIKE '%call%'", 3, 2))
    register("unanalyzed_page_info", lambda s, d: conversations.unanalyzed_page_info(_t(s, d), page_size=30),
             o.page_info("is_analyzed = false", 1, 30, "conversations_log"))

    # --- panels from daily summaries
    def summary(s, d):
        return summaries.summarise(analysed_calls(_t(s, d)))

    register("kpis_from_summaries", lambda s, d: summaries.kpis(summary(s, d), as_of=AS_OF), o.kpis())
    register("score_trends_from_summaries", lambda s, d: summaries.score_trends(summary(s, d), date_range="last30days", as_of=AS_OF),
             o.score_trends(o.date_pred("last30days")))
    register("top_topics_from_summaries", lambda s, d: summaries.top_topics(summary(s, d), date_range="last7days", limit=50, as_of=AS_OF),
             o.top_topics(o.date_pred("last7days"), 50))
    register("leaderboard_from_summaries", lambda s, d: summaries.leaderboard(summary(s, d), date_range="last7days", as_of=AS_OF),
             o.leaderboard(o.date_pred("last7days")))
    register("human_criteria_after_submit", lambda s, d: summaries.human_criteria_scores(_summary_after(s, d), status="completed", as_of=AS_OF), o.HUMAN_AFTER_SUBMIT)

    # --- review queues -------------------------------------------------------------------
    register("pending_reviews", lambda s, d: flatten(reviews.pending_reviews(_t(s, d))),
             o.detail("ca.review_status = 'pending_review'", reviews=False))
    register("pending_reviews_total", lambda s, d: reviews.pending_reviews_total(_t(s, d)),
             f"SELECT COUNT(*) AS total FROM {o.F1} WHERE ca.review_status = 'pending_review'")
    register("completed_reviews", lambda s, d: flatten(reviews.completed_reviews(_t(s, d))),
             o.detail("ca.review_status = 'review_completed'"))
    register("completed_reviews_agent", lambda s, d: flatten(reviews.completed_reviews(_t(s, d), agent_id="1031",
                                                                                      status="completed")),
             o.detail("ca.review_status = 'completed' AND cl.agent_sender = '1031'"))
    register("completed_reviews_total", lambda s, d: reviews.completed_reviews_total(_t(s, d)),
             f"SELECT COUNT(*) AS total FROM {o.F2} WHERE ca.review_status = 'review_completed'")
    register("review_by_analysis", lambda s, d: reviews.review_by_analysis(_t(s, d)), o.review_by_analysis())
    register("review_by_analysis_feed",
             lambda s, d: reviews.review_by_analysis(_t(s, d), _feed_analyses(s, d)),
             o.review_by_analysis("crh.analysis_id IN (SELECT analysis_id FROM review_submissions)"))

    register("review_by_analysis_one", lambda s, d: reviews.review_by_analysis(_t(s, d), ONE_ANALYSIS),
             o.review_by_analysis(f"crh.analysis_id = {ONE_ANALYSIS}"))

    # --- the order in which the rows of a listing come: a running number as a column
    def listed(df, *keys):
        return as_listed(df.select(*keys))

    register("pending_reviews_order", lambda s, d: listed(reviews.pending_reviews(_t(s, d)), "id"),
             o.listed("ca.id", "cl.created_at ASC NULLS LAST, ca.id ASC NULLS LAST", o.F1, "ca.review_status = 'pending_review'"))
    register("completed_reviews_order", lambda s, d: listed(reviews.completed_reviews(_t(s, d)), "id", "human_review_id"),
             o.listed("ca.id, crh.id AS human_review_id", o.LISTING_ORDER, o.F2, "ca.review_status = 'review_completed'"))
    register("score_trends_order", lambda s, d: listed(dashboard.score_trends(_t(s, d), date_range="last30days", as_of=AS_OF), "date"),
             o.listed("date", "date ASC NULLS LAST", f"({o.score_trends(o.date_pred('last30days'))})"))
    register("top_topics_order", lambda s, d: listed(dashboard.top_topics(_t(s, d), limit=50, as_of=AS_OF), "main_topic"),
             o.listed("main_topic", '"count" DESC NULLS FIRST, main_topic ASC NULLS LAST', f"({o.top_topics(limit=50)})"))
    register("agents_list_order", lambda s, d: listed(leaderboard.agents_list(_t(s, d)), "agent_sender"),
             o.listed("agent_sender", "agent_sender ASC NULLS LAST", f"({o.AGENTS_LIST})"))
    register("users_list_order", lambda s, d: listed(users.users_list(_t(s, d)), "id"),
             o.listed("id", "created_at DESC NULLS FIRST, id ASC NULLS LAST", "qc_users"))
    register("leaderboard_order", lambda s, d: listed(leaderboard.leaderboard(_t(s, d), as_of=AS_OF), "agent_extension"),
             o.listed("agent_extension", "rank", f"({o.leaderboard()})"))
    register("analyzed_page_order", lambda s, d: listed(conversations.analyzed_page(_t(s, d), page_size=1000, as_of=AS_OF), "id", "human_review_id"),
             o.listed("ca.id, crh.id AS human_review_id", o.LISTING_ORDER, o.F2) + " QUALIFY ordinal <= 1000")

    # --- comparison ----------------------------------------------------------------------
    register("reviewed_page", lambda s, d: comparison.reviewed_page(_t(s, d), as_of=AS_OF),
             o.reviewed_page("TRUE", 1, 100))
    register("reviewed_page_2_last7days",
             lambda s, d: comparison.reviewed_page(_t(s, d), date_range="last7days", page=2, page_size=25,
                                                   as_of=AS_OF),
             o.reviewed_page(o.date_pred("last7days"), 2, 25))
    register("reviewed_page_info", lambda s, d: comparison.reviewed_page_info(_t(s, d), as_of=AS_OF),
             o.page_info(o.REVIEWED_WHERE, 1, 100))
    register("reviewed_page_info_custom_agent",
             lambda s, d: comparison.reviewed_page_info(_t(s, d), agent_id="1003", date_range="custom",
                                                        start_date=cust[1], end_date=cust[2], page_size=10,
                                                        as_of=AS_OF),
             o.page_info(o.REVIEWED_WHERE + " AND cl.agent_sender = '1003' AND " + o.date_pred(*cust), 1, 10))
    register("score_differences", lambda s, d: flatten(comparison.score_differences(_t(s, d))),
             o.detail(extra=o.SCORE_DIFFS))
    register("score_differences_ids",
             lambda s, d: flatten(comparison.score_differences(_t(s, d), SOME_ANALYSES)),
             o.detail(f"ca.id IN ({', '.join(map(str, SOME_ANALYSES))})", extra=o.SCORE_DIFFS))

    # --- diagnostic look-ups, users, settings-derived scores -------------------------------
    register("conversation_status", lambda s, d: scripts.conversation_status(_t(s, d)), o.CONVERSATION_STATUS)
    register("conversation_status_one", lambda s, d: scripts.conversation_status(_t(s, d), ONE_CALL),
             o.CONVERSATION_STATUS + f" WHERE cl.unique_id = '{ONE_CALL}'")
    register("call_signals", lambda s, d: scripts.call_signals(_t(s, d)), o.CALL_SIGNALS)
    register("call_signals_direct", lambda s, d: scripts.call_signals_direct(_t(s, d)), o.CALL_SIGNALS_DIRECT)
    register("completed_sample", lambda s, d: scripts.completed_sample(_t(s, d)), o.COMPLETED_SAMPLE)
    register("users_list", lambda s, d: users.users_list(_t(s, d)), o.USERS_LIST)
    register("max_possible_scores", lambda s, d: settings.max_possible_scores(_t(s, d)), o.MAX_POSSIBLE_SCORES)

    # --- batch merges -----------------------------------------------------------------------
    register("submit_reviews", lambda s, d: _merge(s, d).reviews, o.SUBMIT_REVIEWS)
    register("submit_review_actions", lambda s, d: _merge(s, d).actions, o.SUBMIT_ACTIONS)
    register("review_status_after_submit",
             lambda s, d: merges.review_status_updates(_t(s, d), _merge(s, d).accepted)[0]
             .select("id", "conversation_id", "review_status"),
             o.REVIEW_STATUS_AFTER_SUBMIT)
    register("qc_status_after_submit",
             lambda s, d: merges.review_status_updates(_t(s, d), _merge(s, d).accepted)[1].select("id", "qc_status"),
             o.QC_STATUS_AFTER_SUBMIT)


    register("review_status_changes",
             lambda s, d: merges.status_changes(_t(s, d), _merge(s, d).accepted)[0].select("id", "conversation_id", "review_status"),
             o.REVIEW_STATUS_CHANGES)
    register("setting_changes_applied", lambda s, d: _settings_after(s, d).qc_settings.select("setting_key", "updated_by", "updated_at"), o.SETTING_CHANGES_APPLIED)
    register("weights_after_changes", lambda s, d: settings.weights(_settings_after(s, d)), o.WEIGHTS_AFTER_CHANGES)
    register("max_score_after_changes", lambda s, d: settings.max_score(_settings_after(s, d)), o.MAX_SCORE_AFTER_CHANGES)
    register("user_changes_applied", lambda s, d: merges.apply_user_changes(_t(s, d).qc_users, user_changes(s, d))[0], o.USER_CHANGES_APPLIED)
    register("user_changes_rejected", lambda s, d: merges.apply_user_changes(_t(s, d).qc_users, user_changes(s, d))[1], o.USER_CHANGES_REJECTED)
    register("review_changes", lambda s, d: _merge(s, d).changed, o.REVIEW_CHANGES)
    register("qc_status_changes", lambda s, d: merges.status_changes(_t(s, d), _merge(s, d).accepted)[1].select("id", "qc_status"), o.QC_STATUS_CHANGES)


def _settings_after(s, d):
    """The tables with the settings that a feed of changes leaves."""
    feed, t = setting_changes(s, d), _t(s, d)
    sent = merges.weights_setting_value(*(F.col(c) for c in ("opening", "listening", "opening", "response_process", "listening", "response_process")))
    value = F.when(F.col("setting_key") == "weights", sent).otherwise(F.col("setting_value"))
    changes = feed.select("seq", "setting_key", value.alias("setting_value"), "updated_by", "updated_at")
    return t.with_(qc_settings=merges.apply_setting_changes(t.qc_settings, changes))


def _summary_after(s, d) -> DataFrame:
    """The summary brought up to date by the changed rows of the merged submissions."""
    t = _t(s, d)
    changed, _ = merges.status_changes(t, _merge(s, d).accepted)
    return summaries.merge(summaries.summarise(analysed_calls(t)), summaries.status_change(t, changed))


def _page_and_info(t) -> DataFrame:
    rows, info = conversations.analyzed_page_and_info(t, page=2, page_size=100, as_of=AS_OF)
    return flatten(rows).crossJoin(F.broadcast(info))  # one row


def _chunks(t) -> DataFrame:
    return payload_chunks(t, chunk=2).selectExpr("call_id", "chunk", "CAST(first_turn AS BIGINT) AS first_turn", "CAST(size(turns) AS BIGINT) AS n_turns",
                                                 "concat_ws(char(10), transform(turns, e -> concat(e.role, ': ', e.text))) AS conversation_text")


def _last_page(t) -> DataFrame:
    pages = conversations.analyzed_page_info(t, as_of=AS_OF).first()["total_pages"]
    return conversations.analyzed_page(t, page=pages, as_of=AS_OF)


def _next_page(t) -> DataFrame:
    page = conversations.analyzed_page(t, as_of=AS_OF).select("created_at", "id", "human_review_id").collect()
    return conversations.analyzed_page_after(t, page[-1], as_of=AS_OF)


def _fixture_review_id(analysis_id):
    return analysis_id + F.lit(FIXTURE_REVIEW_ID_OFFSET)


def _merge(spark, sf_dir):
    return merges.submit_reviews(_t(spark, sf_dir), review_submissions(spark, sf_dir), _fixture_review_id)


_build()


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from callqc.oracle import with_fixtures

    return {k: with_fixtures(v) for k, v in ORACLE.items()}
