"""Small rule tables. All are configuration of a fixed size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.events import SITE

POLICY_ID = "site-intent-v1"

# The intent policy and its rules.
POLICY = (POLICY_ID, SITE, 1, "Visitor intent v1", "ACTIVE", 25, 55, 100)
SIGNAL_RULES = (
    ("general-page-view", "A visitor loaded a public page", "page_view", "PAGE", "ANY", None, "exploration", 2, 4, None, None),
    ("project-page-view", "A visitor opened a project detail page", "page_view", "PAGE", "PREFIX", "/work-single/", "project_interest", 12, 3, None, None),
    ("project-action", "A visitor explicitly opened a project", "project_open", "ANY", "ANY", None, "project_interest", 14, 3, None, None),
    ("content-read-half", "A visitor read at least half of an article or project", "read_progress", "ANY", "ANY", None, "content_depth", 8, 2, None, 50),
    ("engaged-thirty-seconds", "A visitor stayed engaged for at least thirty seconds", "engaged_time", "ANY", "ANY", None, "content_depth", 7, 3, 30, None),
    ("resume-view-cv", "A visitor opened the CV route", "page_view", "PAGE", "EXACT", "/cv", "career_interest", 20, 1, None, None),
    ("resume-view-resume", "A visitor opened the resume route", "page_view", "PAGE", "EXACT", "/resume", "career_interest", 20, 1, None, None),
    ("contact-view", "A visitor reached the contact route", "page_view", "PAGE", "EXACT", "/contact", "contact_intent", 24, 1, None, None),
    ("subscription-started", "A visitor started a subscription workflow", "subscribe_started", "ANY", "ANY", None, "conversion_intent", 28, 1, None, None),
    ("subscription-verified", "A visitor verified a subscription", "subscribe_verified", "ANY", "ANY", None, "conversion_intent", 42, 1, None, None),
    ("recommendation-click", "A visitor followed a recommendation", "recommendation_click", "ANY", "ANY", None, "discovery_intent", 10, 3, None, None),
)
FUNNEL_RULES = (
    ("funnel-v1-home", 1, "home", "Homepage", "Loaded the main portfolio page", 1, "page_view", "PAGE", "EXACT", "/"),
    ("funnel-v1-project-page", 1, "project", "Project interest", "Opened or landed on a project page", 2, "page_view", "PAGE", "PREFIX", "/work-single/"),
    ("funnel-v1-project-action", 1, "project", "Project interest", "Opened or landed on a project page", 2, "project_open", "ANY", "ANY", None),
    ("funnel-v1-resume-cv", 1, "resume", "Resume intent", "Viewed resume or CV content", 3, "page_view", "PAGE", "EXACT", "/cv"),
    ("funnel-v1-resume-route", 1, "resume", "Resume intent", "Viewed resume or CV content", 3, "page_view", "PAGE", "EXACT", "/resume"),
    ("funnel-v1-contact-page", 1, "contact", "Contact or subscribe", "Reached a contact or subscription workflow", 4, "page_view", "PAGE", "EXACT", "/contact"),
    ("funnel-v1-subscribe-start", 1, "contact", "Contact or subscribe", "Reached a contact or subscription workflow", 4, "subscribe_started", "ANY", "ANY", None),
    ("funnel-v1-subscribe-verified", 1, "contact", "Contact or subscribe", "Reached a contact or subscription workflow", 4, "subscribe_verified", "ANY", "ANY", None),
)
ATTRIBUTION_RULES = (
    ("attribution-google", "google.", "Google", "search", 10),
    ("attribution-github", "github.", "GitHub", "developer", 20),
    ("attribution-linkedin", "linkedin.", "LinkedIn", "social", 30),
)
TYPE_DEFAULTS = (
    ("PROJECT", "project_interest", "ADVANCED", 90, "projects", 14),
    ("BLOG", "technical_learning", "INTERMEDIATE", 65, "articles", 8),
    ("LIFE_BLOG", "personal_context", "FOUNDATIONAL", 20, "life", 2),
    ("EXPERIENCE", "career_interest", "ADVANCED", 100, "experience", 18),
)

# Our own: alert rules and content metadata for the shared test data.
ALERT_RULES = (
    (1, SITE, "views", "page_view", "GLOBAL", None, "1d", 5, ">=", 172_800, True, 1),
    (2, SITE, "quiet", "subscribe_verified", "GLOBAL", None, "1d", 3, "<=", 86_400, True, 1),
    (3, SITE, "nation", "click", "COUNTRY", "COUNTRY:NATION_3", "1d", 2, ">=", 60, True, 2),
    (4, SITE, "any region", "page_view", "REGION", "", "5m", 1, ">=", 300, True, 1),
    (5, SITE, "broken", "page_view", "GLOBAL", None, "1d", 1, "unsupported", 60, True, 1),
    (6, SITE, "off", "page_view", "GLOBAL", None, "1d", 1, ">=", 60, False, 1),
)
ALERT_COLUMNS = "rule_id long, site_id string, name string, event_type string, geo_level string, geo_area_id string, granularity string, threshold long, comparator string, cooldown_seconds int, enabled boolean, version int"
METADATA_COLUMNS = (
    "site_id string, content_type string, content_id string, canonical_path string, display_title string, cover_url string, primary_intent string, technical_domains array<string>, "
    "complexity_level string, career_relevance int, recommendation_group string, intent_weight int, metadata_source string, metadata_version int, active boolean"
)
METADATA = tuple(
    (
        SITE, kind, f"c{k}", {("PROJECT", 1): "/work-single/1", ("BLOG", 3): "/blog-single/3"}.get((kind, k)), f"{kind.title()} {k}", None if k % 3 else f"cover-{k}.png",
        "project_interest" if kind == "PROJECT" else "technical_learning", ["spark"], "ADVANCED", 50, kind.lower(), 0 if k == 5 else 3 + k, "ADMIN" if k % 4 == 0 else "SOURCE_PROJECTION",
        1 + k, k != 7,
    )
    for kind in ("PROJECT", "BLOG") for k in range(12)
)


def policies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([POLICY], "policy_id string, site_id string, version int, name string, status string, medium_threshold int, high_threshold int, max_score int")


def signal_rules(spark: SparkSession) -> DataFrame:
    rows = [(POLICY_ID, *r, None) for r in SIGNAL_RULES]
    return spark.createDataFrame(
        rows,
        "policy_id string, rule_key string, description string, event_name string, path_source string, path_match_type string, path_pattern string, intent_dimension string, "
        "base_weight int, max_occurrences int, min_engaged_seconds int, min_progress_percent int, content_type string",
    )


def funnel_rules(spark: SparkSession) -> DataFrame:
    rows = [(r[0], SITE, *r[1:], True) for r in FUNNEL_RULES]
    return spark.createDataFrame(
        rows,
        "rule_id string, site_id string, funnel_version int, step_key string, step_label string, step_description string, step_order int, event_name string, path_source string, "
        "path_match_type string, path_pattern string, active boolean",
    )


def attribution_rules(spark: SparkSession) -> DataFrame:
    rows = [(r[0], SITE, *r[1:], True) for r in ATTRIBUTION_RULES]
    return spark.createDataFrame(rows, "rule_id string, site_id string, host_pattern string, source_label string, source_type string, priority int, active boolean")


def type_defaults(spark: SparkSession) -> DataFrame:
    rows = [(SITE, *r, True) for r in TYPE_DEFAULTS]
    return spark.createDataFrame(
        rows, "site_id string, content_type string, primary_intent string, complexity_level string, career_relevance int, recommendation_group string, intent_weight int, active boolean"
    )


def metadata(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(METADATA), METADATA_COLUMNS)


def alert_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ALERT_RULES), ALERT_COLUMNS)


def sql_values(name: str, columns: str, rows) -> str:
    """A CTE of literal rows for DuckDB."""

    def lit(v) -> str:
        if v is None:
            return "null"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, list):
            return "[" + ", ".join(lit(x) for x in v) + "]"
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    return f"{name}({columns}) as (values " + ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows) + ")"
