"""Visitor journeys, explainable intent scores, attribution, content and cohorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import columns as C
from ..scratch import Scratch
from ..sources.events import SITE

STEP = ("event_id", "site_id", "session_id", "event_name", "event_time", "page_path", "target_path", "referrer_domain", "content_id", "content_type", "engaged_seconds", "progress_percent")
SIGNAL_RULE = ("event_name", "path_source", "path_match_type", "path_pattern", "content_type", "min_engaged_seconds", "min_progress_percent")
MOST_DOMAIN = 255  # and domains to so many
MOST_PATH = 512  # paths are cut to so many characters
FUNNEL_RULE = ("event_name", "path_source", "path_match_type", "path_pattern")


def journey_steps(enriched: DataFrame) -> DataFrame:
    """Step rows of valid events that have a session key."""
    props = F.col("properties")
    key = C.session_key(F.col("session_id"), F.col("anon_id"), F.col("ip_hash"), F.col("device_type"))
    rows = enriched.where(C.validate_required(F.col("event_id"), F.col("event_type"), F.col("site_id")) & F.col("event_time").isNotNull())
    return rows.select(
        "event_id", "site_id", key.alias("session_id"), F.col("event_type").alias("event_name"), "event_time", C.in_parts(C.path_only(F.col("page_url"))).alias("page_path"),
        C.path_only(F.col("target_url")).alias("target_path"), C.domain_only(F.col("referrer")).alias("referrer_domain"), C.property_text(props, "contentId").alias("content_id"),
        C.property_text(props, "contentType").alias("content_type"), C.bounded_int(props, "engagedSeconds", 86_400).alias("engaged_seconds"),
        C.bounded_int(props, "progressPercent", 100).alias("progress_percent"),
    ).where("session_id is not null")


def replay_steps(facts: DataFrame, start: str, end: str, site: str = SITE) -> DataFrame:
    """Steps again from the facts of [start, end)."""
    props = F.col("properties")
    return facts.where((F.col("site_id") == site) & F.col("session_id").isNotNull() & C.range_filter(F.col("event_time"), start, end)).select(
        "event_id", "site_id", "session_id", "event_name", "event_time", "page_path", "target_path", "referrer_domain",
        F.nullif(props["contentId"], F.lit("")).alias("content_id"), F.nullif(props["contentType"], F.lit("")).alias("content_type"),
        C.bounded_int_strict(props, "engagedSeconds", 86_400).alias("engaged_seconds"), C.bounded_int_strict(props, "progressPercent", 100).alias("progress_percent"),
    )


def insert_if_absent(old: DataFrame, new: DataFrame, key: str = "event_id") -> DataFrame:
    """Old rows, and the new ones whose key is not there; of new rows with one key the
    first stays, by event_time where it is there, then by the other columns."""
    first = F.row_number().over(Window.partitionBy(key).orderBy(*sorted((c for c, kind in new.dtypes if c != key and not kind.startswith("map")), key=lambda c: c != "event_time"), F.lit(0)))
    fresh = new.withColumn("_nth", first).where("_nth = 1").drop("_nth").join(old.select(key), key, "left_anti")
    return old.unionByName(fresh.select(*old.columns))


insert_journey_steps = insert_funnel_steps = insert_if_absent


def replace_by_key(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows, and the old ones of other keys."""
    return old.join(new.select(*keys), keys, "left_anti").select(*new.columns).unionByName(new)


def merge_sessions(old: DataFrame, new: DataFrame) -> DataFrame:
    return replace_by_key(old, new, ["site_id", "session_id"])


def merge_snapshots(old: DataFrame, new: DataFrame) -> DataFrame:
    return replace_by_key(old, new, ["site_id", "session_id", "policy_id"])


def active_policy(policies: DataFrame, site: str = SITE) -> DataFrame:
    return policies.where((F.col("site_id") == site) & (F.col("status") == "ACTIVE")).orderBy("policy_id").limit(1)


def _in_range(steps: DataFrame, site: str, start: str, end: str, admin: bool) -> DataFrame:
    rows = steps.where((F.col("site_id") == site) & C.range_filter(F.col("event_time"), start, end))
    return rows if admin else rows.where(C.exclude_admin_prefix(F.col("page_path"), mode="like"))


def journey_summary(steps: DataFrame, start: str, end: str, site: str = SITE, admin: bool = False) -> DataFrame:
    return _in_range(steps, site, start, end, admin).agg(F.count("*").alias("total_events"), F.count_distinct("session_id").alias("unique_visitors"))


# ---------------------------------------------------------------- intent


def _match(rules: DataFrame, steps: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Rule table x steps where the rule holds, each pair once. Rules are a small
    configuration table. A rule is looked up by what it asks of paths, or by its event name
    if it takes any; a step by its paths, by their beginnings of the lengths that rules
    have, and by its event name, so that both meet in a hash join."""
    rules = C.small(rules.select(*[F.col(c).alias(f"r_{c}") for c in rules.columns]))
    kind, pattern, source = F.col("r_path_match_type"), F.col("r_path_pattern"), F.col("r_path_source")
    lengths = sorted(r[0] for r in rules.where(kind == "PREFIX").select(F.char_length(pattern)).distinct().collect() if r[0] is not None and r[0] <= MOST_PATH)

    def key(how: Column | str, text: Column) -> Column:
        return F.struct((F.lit(how) if isinstance(how, str) else how).alias("how"), text.alias("text"))

    def asks(where: str) -> Column:
        how = F.when(kind == "EXACT", f"{where} is").when(kind == "PREFIX", f"{where} begins")
        return F.when(source.isin("ANY", where) & how.isNotNull(), key(how, pattern))

    any_path = F.when(kind == "ANY", key("any path", F.coalesce(C.filled(F.col("r_event_name")), F.lit(""))))
    rules = rules.withColumn("_r", F.explode(F.array_compact(F.array(any_path, asks("PAGE"), asks("TARGET"))))).select("*", F.col("_r.how").alias("_r_how"), F.col("_r.text").alias("_r_text")).drop("_r")

    def offers(where: str, path: str) -> list[Column]:
        begins = [F.when(F.char_length(path) >= n, key(f"{where} begins", F.substring(path, 1, n))) for n in lengths]
        return [F.when(F.col(path).isNotNull(), key(f"{where} is", F.col(path))), *begins]

    offered = F.array(key("any path", F.lit("")), F.when(~C.blank(F.col("event_name")), key("any path", F.col("event_name"))), *offers("PAGE", "page_path"), *offers("TARGET", "target_path"))
    rows = steps.withColumn("_s", F.explode(F.array_compact(offered))).select(*steps.columns, F.col("_s.how").alias("_s_how"), F.col("_s.text").alias("_s_text"))
    by_page = F.coalesce(F.when(kind == "EXACT", F.col("page_path") == pattern).when(kind == "PREFIX", F.col("page_path").startswith(pattern)), F.lit(False))
    once = ~(F.col("_s_how").startswith("TARGET") & (source == "ANY") & by_page)
    holds = C.rule_match({c: F.col(f"r_{c}") for c in fields}, {c: F.col(c) for c in STEP})
    found = rows.join(F.broadcast(rules), (F.col("_s_how") == F.col("_r_how")) & (F.col("_s_text") == F.col("_r_text")) & once & holds)
    return found.drop("_s_how", "_s_text", "_r_how", "_r_text")


def content_of_steps(steps: DataFrame, metadata: DataFrame) -> DataFrame:
    """Each step with the metadata it stands for: by type and id, else by page path,
    else by target path. Metadata grows with the content, so it is not hinted to be
    broadcast; Spark does that where its size allows."""
    meta = metadata.where("active").select(
        F.col("site_id").alias("m_site"), F.struct("content_type", "content_id", "primary_intent", "intent_weight", "display_title").alias("m"),
        F.lower("content_type").alias("m_type"), F.col("content_id").alias("m_id"), F.col("canonical_path").alias("m_path"),
    )
    paths = meta.where(~C.blank(F.col("m_path"))).groupBy("m_site", "m_path").agg(F.max("m").alias("m"))

    def by_path(name: str, column: str):
        side = paths.select(F.col("m_site").alias(f"_{name}_site"), F.col("m_path").alias(f"_{name}_path"), F.col("m").alias(f"_{name}"))
        return side, (F.col("site_id") == F.col(f"_{name}_site")) & (F.col(column) == F.col(f"_{name}_path"))

    direct = meta.select("m_site", "m_type", "m_id", F.col("m").alias("direct"))
    same = (F.col("site_id") == F.col("m_site")) & (F.lower("content_type") == F.col("m_type")) & (F.col("content_id") == F.col("m_id")) & ~C.blank(F.col("content_id"))
    rows = steps.join(direct, same, "left").join(*by_path("page", "page_path"), "left").join(*by_path("target", "target_path"), "left")
    return rows.withColumn("content", F.coalesce("direct", "_page", "_target")).select(*steps.columns, "content")


def intent_parts(steps: DataFrame, rules: DataFrame, metadata: DataFrame) -> DataFrame:
    """What steps count for, per site and session: a row for each rule that matched and for
    each content item with a weight, with n matches, of which ``most`` count ``w`` each.
    Parts of several sets of steps are merged by adding up n."""
    keys = ["site_id", "session_id"]
    hits = _match(rules.drop("policy_id"), steps, SIGNAL_RULE)
    # counts alone are added up by hash; texts in an aggregate would sort all matches
    found = hits.groupBy(*keys, F.col("r_rule_key").alias("signal_key")).agg(F.count("*").alias("n"))
    said = F.min(F.struct(F.col("description"), F.col("intent_dimension").alias("dimension"), F.col("max_occurrences").cast("long").alias("most"), F.col("base_weight").cast("long").alias("w")))
    told = rules.groupBy(F.col("rule_key").alias("signal_key")).agg(said.alias("said"))
    found = found.join(F.broadcast(told), "signal_key").select(*keys, "signal_key", "said.description", "said.dimension", "n", "said.most", "said.w")
    identity = F.concat(F.lit("content:"), "content.content_type", F.lit(":"), "content.content_id")
    title = F.coalesce("content.display_title", F.lit("Matched stored content intent metadata"))
    content = content_of_steps(steps, metadata).where("content.intent_weight > 0").groupBy(*keys, identity.alias("signal_key"), title.alias("description"), F.col("content.primary_intent").alias("dimension"), F.col("content.intent_weight").cast("long").alias("w")).agg(F.count("*").alias("n"))
    return found.unionByName(content.withColumn("most", F.lit(1).cast("long")))


def merge_intent_parts(parts: DataFrame) -> DataFrame:
    """Parts of all batches, what is said of a signal being what the last batch said."""
    said = F.struct("as_of", "description", "dimension", "most", "w")
    rows = parts.groupBy("site_id", "session_id", "signal_key").agg(F.sum("n").alias("n"), F.max(said).alias("said"))
    return rows.select("site_id", "session_id", "signal_key", "said.description", "said.dimension", "n", "said.most", "said.w", "said.as_of")


def intent_spans(steps: DataFrame) -> DataFrame:
    """First and last event of each session; also what merges such rows."""
    first, last = ("first_event", "last_event") if "first_event" in steps.columns else ("event_time", "event_time")
    return steps.groupBy("site_id", "session_id").agg(F.min(first).alias("first_event"), F.max(last).alias("last_event"))


def score_intent(steps: DataFrame, policy: DataFrame, rules: DataFrame, metadata: DataFrame) -> DataFrame:
    """A snapshot per site and session: score, level, dominant dimension, scores by
    dimension and the signals behind them. Matches are counted before rules are joined
    to their weights, so a long session shrinks to a few rows at once."""
    return score_parts(intent_parts(steps, rules, metadata), intent_spans(steps), policy)


def score_parts(parts: DataFrame, spans: DataFrame, policy: DataFrame) -> DataFrame:
    keys = ["site_id", "session_id"]
    n = F.least("n", "most")
    both = parts.select(*keys, F.struct("signal_key", "description", "dimension", n.cast("int").alias("occurrences"), (n * F.col("w")).cast("int").alias("score")).alias("signal"))
    by_dimension = both.groupBy(*keys, F.col("signal.dimension").alias("dimension")).agg(F.sum("signal.score").alias("score"))
    dims = by_dimension.groupBy(*keys).agg(
        F.sum("score").alias("raw"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("dimension", "score")))).alias("dimension_scores"),
        F.min(F.struct((-F.col("score")).alias("s"), "dimension"))["dimension"].alias("dominant_intent"),
    )
    listed = both.groupBy(*keys).agg(F.array_sort(F.collect_list("signal")).alias("contributing_signals"))
    p = policy.select("policy_id", F.col("version").alias("policy_version"), "medium_threshold", "high_threshold", "max_score", F.col("site_id").alias("p_site"))
    rows = spans.join(F.broadcast(p), F.col("site_id") == F.col("p_site")).join(dims, keys, "left").join(listed, keys, "left")
    score = F.least("max_score", F.coalesce("raw", F.lit(0))).cast("int")
    level = F.when(F.col("score") >= F.col("high_threshold"), "HIGH").when(F.col("score") >= F.col("medium_threshold"), "MEDIUM").otherwise("LOW")
    return rows.withColumn("score", score).withColumn("intent_level", level).select(
        *keys, "policy_id", "policy_version", "score", "intent_level", "dominant_intent", "dimension_scores", "contributing_signals", "first_event", "last_event"
    )


def replay_journeys(facts: DataFrame, steps: DataFrame, policy: DataFrame, rules: DataFrame, metadata: DataFrame, start: str, end: str, site: str = SITE, max_sessions: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(all steps, snapshots again of the first sessions of the range, scored over all
    of their steps, which are stored as they are read several times)."""
    every = insert_journey_steps(steps, replay_steps(facts, start, end, site))
    rows = facts.where((F.col("site_id") == site) & F.col("session_id").isNotNull() & C.range_filter(F.col("event_time"), start, end))
    chosen = rows.select("session_id").distinct().orderBy("session_id").limit(max_sessions)
    replayed = Scratch(facts.sparkSession).store(every.where(F.col("site_id") == site).join(chosen, "session_id", "left_semi"), "replayed-steps")
    return every, score_intent(replayed, policy, rules, metadata)


# ---------------------------------------------------------------- read models


def rule_funnel(steps: DataFrame, rules: DataFrame, start: str, end: str, site: str = SITE, admin: bool = False) -> DataFrame:
    """Distinct sessions per step of the newest active version; steps without any stay.
    Rates are of the first step, and of the last step that had sessions."""
    rules = rules.where((F.col("site_id") == site) & F.col("active"))
    newest = Window.partitionBy("site_id")
    rules = rules.withColumn("top", F.max("funnel_version").over(newest)).where("funnel_version = top").drop("top")
    labels = rules.groupBy("step_key").agg(F.max("step_label").alias("step_label"), F.max("step_description").alias("step_description"), F.min("step_order").alias("step_order"))
    hits = _match(rules, _in_range(steps, site, start, end, admin), FUNNEL_RULE)
    counts = hits.groupBy(F.col("r_step_key").alias("step_key")).agg(F.count_distinct("session_id").alias("visitors"))
    rows = labels.join(counts, "step_key", "left").withColumn("visitors", F.coalesce("visitors", F.lit(0)))
    order = Window.partitionBy(F.lit(1)).orderBy("step_order", "step_key")  # as many rows as the funnel has steps
    start_n = F.greatest(F.lit(1), F.first("visitors").over(order))
    previous = F.last(F.nullif("visitors", F.lit(0)), True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return rows.select("*", (F.col("visitors") / start_n).alias("rate_from_start"), (F.col("visitors") / F.greatest(F.lit(1), F.coalesce(previous, start_n))).alias("rate_from_previous"))


def attribution(steps: DataFrame, snapshots: DataFrame, rules: DataFrame, start: str, end: str, site: str = SITE, admin: bool = False, limit: int = 8) -> DataFrame:
    """Sessions by the source of their first known referrer, with the mean score. The
    first rule by priority whose pattern is in the domain names the source."""
    rows = _in_range(steps, site, start, end, admin)
    order = F.when(F.col("referrer_domain").isNotNull(), F.struct("event_time", "event_id"))
    per = rows.withColumn("_o", order).groupBy("session_id").agg(F.min_by("referrer_domain", "_o").alias("referrer_domain"), F.count("*").alias("events"))
    scores = snapshots.where(F.col("site_id") == site).groupBy("session_id").agg(F.max("score").alias("score"))
    per = per.join(scores, "session_id", "left")
    small = rules.where((F.col("site_id") == site) & F.col("active")).select(F.lower("host_pattern").alias("host"), "source_label", "source_type", "priority", "rule_id")
    # a domain is looked up by all of its pieces as long as patterns are
    small = C.small(small)
    lengths = sorted(r[0] for r in small.select(F.char_length("host")).distinct().collect() if r[0] is not None and r[0] <= MOST_DOMAIN)
    low = F.lower("referrer_domain")

    def pieces_of(n: int) -> Column:
        return F.when(F.char_length(low) >= n, F.transform(F.sequence(F.lit(1), F.char_length(low) - n + 1), lambda k: F.substr(low, k, F.lit(n))))

    pieces = [pieces_of(n) for n in lengths]
    pieces = F.array_distinct(F.flatten(F.array_compact(F.array(F.array(F.lit(None).cast("string")), *pieces))))
    domains = per.select("referrer_domain").distinct().where("referrer_domain is not null").withColumn("piece", F.explode(pieces))
    named = domains.join(F.broadcast(small), F.col("piece") == F.col("host"))
    named = named.groupBy("referrer_domain").agg(F.min(F.struct("priority", "rule_id", "source_label", "source_type")).alias("rule"))
    rows = per.join(named, "referrer_domain", "left")
    none = F.col("referrer_domain").isNull()
    rows = rows.select(
        F.coalesce("rule.source_label", F.when(none, "Direct").otherwise(F.col("referrer_domain"))).alias("source"),
        F.coalesce("rule.source_type", F.when(none, "direct").otherwise("referral")).alias("source_type"), "events", F.coalesce("score", F.lit(0)).alias("score"),
    )
    out = rows.groupBy("source", "source_type").agg(
        F.count("*").alias("visitors"), F.sum("events").alias("events"), F.round(F.avg(F.col("score").cast("decimal(10,0)")), 0).cast("int").alias("quality_score")
    )
    return out.orderBy(F.desc("quality_score"), F.desc("events"), "source").limit(limit)


def top_content(steps: DataFrame, metadata: DataFrame, start: str, end: str, site: str = SITE, admin: bool = False, limit: int = 8) -> DataFrame:
    """Content paths by visitors. The choice between id and path is two equi joins, and a
    metadata row that matches both ways, or many events, counts an event once."""
    path = F.coalesce("target_path", "page_path")
    rows = _in_range(steps, site, start, end, admin).withColumn("path", path).where("path is not null and path <> '/'")
    meta = metadata.where((F.col("site_id") == site) & F.col("active")).select(
        F.col("content_type").alias("m_type"), F.col("content_id").alias("m_id"), F.col("canonical_path").alias("m_path"), "display_title", "cover_url"
    )
    contents = rows.groupBy("path", "content_type", "content_id").agg(F.count("*").alias("n"))
    by_id = contents.join(meta, (F.col("content_id") == F.col("m_id")) & (F.col("content_type") == F.col("m_type")))
    by_path = contents.join(meta, F.col("path") == F.col("m_path"))
    named = by_id.unionByName(by_path).groupBy("path").agg(F.max("m_type").alias("m_type"), F.max("display_title").alias("title"), F.max("cover_url").alias("cover_url"))
    totals = rows.groupBy("path").agg(
        F.max("content_type").alias("own_type"), F.count("*").alias("events"), F.count_distinct("session_id").alias("visitors"),
        F.coalesce(F.sum("engaged_seconds"), F.lit(0)).alias("engaged_seconds"),
    )
    out = totals.join(named, "path", "left").select(
        "path", F.coalesce("m_type", "own_type", F.lit("page")).alias("content_type"), F.coalesce("title", "path").alias("title"), "cover_url", "events", "visitors", "engaged_seconds"
    )
    return out.orderBy(F.desc("visitors"), F.desc("events"), F.desc("engaged_seconds"), "path").limit(limit)


def cohort_summary(sessions: DataFrame, steps: DataFrame, start: str, end: str, site: str = SITE) -> DataFrame:
    begin, stop = F.expr(f"timestamp_ntz '{start}'"), F.expr(f"timestamp_ntz '{end}'")
    rows = sessions.where((F.col("site_id") == site) & (F.col("last_event") >= begin) & (F.col("first_event") < stop))
    rows = rows.withColumn("visitor_id", F.coalesce(F.nullif("anon_id", F.lit("")), F.col("session_id")))
    people = rows.groupBy("visitor_id").agg(F.count("*").alias("sessions"), F.sum(F.col("page_views") + F.col("clicks")).alias("events"))
    pages = rows.select("site_id", "session_id", "visitor_id").join(steps.select("site_id", "session_id", "page_path"), ["site_id", "session_id"])
    depth = pages.groupBy("visitor_id").agg(F.count_distinct("page_path").alias("pages"))
    out = people.join(depth, "visitor_id", "left").agg(
        F.count("*").alias("visitors"), F.count_if(F.col("sessions") > 1).alias("returning_visitors"), F.count_if(F.coalesce("pages", F.lit(0)) >= 2).alias("multi_step_visitors"),
        F.coalesce(F.round(F.avg("events"), 9), F.lit(0.0)).alias("average_events"),
    )

    def rate(c: str):
        return F.coalesce(F.try_divide(F.col(c), F.col("visitors")), F.lit(0.0))

    return out.withColumns({"returning_rate": rate("returning_visitors"), "multi_step_rate": rate("multi_step_visitors")})


def last_n_journey_steps(steps: DataFrame, n: int = 24) -> DataFrame:
    """The newest ``n`` steps of each session, with their place in time order."""
    newest = F.row_number().over(Window.partitionBy("site_id", "session_id").orderBy(F.desc("event_time"), F.desc("event_id")))
    return steps.withColumn("rank", newest).where(F.col("rank") <= n)


def _journeys(sessions: DataFrame, snapshots: DataFrame, steps: DataFrame, start: str, end: str, site: str, admin: bool, limit: int, max_steps: int, high: bool) -> DataFrame:
    begin, stop = F.expr(f"timestamp_ntz '{start}'"), F.expr(f"timestamp_ntz '{end}'")
    rows = sessions.where((F.col("site_id") == site) & (F.col("last_event") >= begin) & (F.col("first_event") < stop))
    if not admin:
        rows = rows.where(C.exclude_admin_prefix(F.col("entry_page"), mode="like"))
    intent = snapshots.select("site_id", "session_id", "policy_version", "score", "intent_level", "dominant_intent", "dimension_scores", "contributing_signals")
    rows = rows.join(intent, ["site_id", "session_id"])
    if high:
        rows = rows.where(F.col("intent_level").isin("HIGH", "MEDIUM"))
    order = ([F.desc("score")] if high else []) + [F.desc("last_event"), F.col("session_id")]
    rows = rows.orderBy(*order).limit(limit)
    chosen = F.broadcast(rows.select("site_id", "session_id"))  # ``limit`` rows
    item = F.struct("event_time", "event_id", "event_name", "page_path", "target_path", "content_id", "content_type", "engaged_seconds", "progress_percent")
    listed = last_n_journey_steps(steps.join(chosen, ["site_id", "session_id"], "left_semi"), max_steps).groupBy("site_id", "session_id").agg(F.array_sort(F.collect_list(item)).alias("steps"))
    return rows.join(listed, ["site_id", "session_id"], "left")


def high_intent_journeys(sessions, snapshots, steps, start: str, end: str, site: str = SITE, admin: bool = False, limit: int = 12, max_steps: int = 24) -> DataFrame:
    return _journeys(sessions, snapshots, steps, start, end, site, admin, limit, max_steps, True)


def recent_journeys(sessions, snapshots, steps, start: str, end: str, site: str = SITE, admin: bool = False, limit: int = 12, max_steps: int = 24) -> DataFrame:
    return _journeys(sessions, snapshots, steps, start, end, site, admin, limit, max_steps, False)


def visitor_overview(tables: dict[str, DataFrame], start: str, end: str, site: str = SITE, admin: bool = False) -> dict[str, DataFrame]:
    """All journey read models of a range, from the tables steps, snapshots, sessions,
    metadata, policies, funnel_rules and attribution_rules."""
    t = tables
    return {
        "summary": journey_summary(t["steps"], start, end, site, admin),
        "policy": active_policy(t["policies"], site),
        "funnel": rule_funnel(t["steps"], t["funnel_rules"], start, end, site, admin),
        "attribution": attribution(t["steps"], t["snapshots"], t["attribution_rules"], start, end, site, admin),
        "top_content": top_content(t["steps"], t["metadata"], start, end, site, admin),
        "cohort": cohort_summary(t["sessions"], t["steps"], start, end, site),
        "high_intent": high_intent_journeys(t["sessions"], t["snapshots"], t["steps"], start, end, site, admin),
        "recent": recent_journeys(t["sessions"], t["snapshots"], t["steps"], start, end, site, admin),
    }


# ---------------------------------------------------------------- content metadata

META = (
    "site_id", "content_type", "content_id", "canonical_path", "display_title", "cover_url", "primary_intent", "technical_domains", "complexity_level", "career_relevance",
    "recommendation_group", "intent_weight", "metadata_source", "metadata_version", "active",
)


def project_content_metadata(projects: DataFrame, blogs: DataFrame, life_blogs: DataFrame, experience: DataFrame, defaults: DataFrame, now: str) -> DataFrame:
    """The four content tables as metadata, with the defaults of their type."""
    clock = F.expr(f"timestamp_ntz '{now}'")

    def version(*times: str):
        return F.greatest(F.lit(1), F.floor(F.unix_seconds(F.coalesce(*times, clock).cast("timestamp")) / 60).cast("int"))

    def of(rows: DataFrame, kind: str, path, title: str, cover: str | None, domains: tuple[str, ...], ver, active) -> DataFrame:
        d = defaults.where(F.col("active") & (F.col("content_type") == kind)).select(
            "site_id", "content_type", "primary_intent", "complexity_level", "career_relevance", "recommendation_group", "intent_weight"
        )
        rows = rows.select(
            F.col("id").cast("string").alias("content_id"), path.alias("canonical_path"), F.col(title).alias("display_title"),
            (F.col(cover) if cover else F.lit(None).cast("string")).alias("cover_url"), F.array_compact(F.array(*domains)).alias("technical_domains"),
            F.lit("SOURCE_PROJECTION").alias("metadata_source"), ver.alias("metadata_version"), active.alias("active"),
        )
        return rows.crossJoin(F.broadcast(d.limit(1))).select(*META)  # the defaults of a type are one row

    def path(prefix: str):
        return F.concat(F.lit(prefix), F.col("id").cast("string"))

    yes = F.lit(True)
    return (
        of(projects, "PROJECT", path("/work-single/"), "title", "image_url", ("category", "technology"), version("updated_at", "published_at"), F.coalesce(F.col("publication_status") == "PUBLISHED", F.lit(False)))
        .unionByName(of(blogs, "BLOG", path("/blog-single/"), "title", "image_url", ("category", "tags"), F.lit(1), yes))
        .unionByName(of(life_blogs, "LIFE_BLOG", path("/life-blog/"), "title", "image_url", ("category", "tags"), version("updated_at", "created_at"), F.col("published_at").isNotNull()))
        .unionByName(of(experience, "EXPERIENCE", F.lit(None).cast("string"), "name", None, ("subname",), F.lit(1), yes))
    )


def merge_content_metadata(stored: DataFrame, incoming: DataFrame, mode: str) -> DataFrame:
    """mode ``admin``: incoming wins. ``projection``: unless the stored row is ADMIN.
    ``published``: unless ADMIN or of a later version."""
    keys = ["site_id", "content_type", "content_id"]
    source = {"admin": "ADMIN", "published": "PUBLISH_EVENT", "projection": "SOURCE_PROJECTION"}[mode]
    new = incoming.select(*META).withColumn("metadata_source", F.lit(source))
    both = stored.select(*keys, F.struct(*META).alias("old")).join(new.select(*keys, F.struct(*META).alias("new")), keys, "full")
    free = F.col("old.metadata_source") != "ADMIN"
    wins = {"admin": F.lit(True), "projection": free, "published": free & (F.col("new.metadata_version") >= F.col("old.metadata_version"))}[mode]
    pick = F.when(F.col("old").isNull() | (F.col("new").isNotNull() & wins), F.col("new")).otherwise(F.col("old"))
    return both.select(pick.alias("m")).select("m.*")


def deactivate_deleted_content(stored: DataFrame, source: DataFrame) -> DataFrame:
    """Rows without a source row become inactive, unless they are ADMIN's."""
    there = source.select("content_type", "content_id").distinct().withColumn("_there", F.lit(True))
    rows = stored.join(there, ["content_type", "content_id"], "left")
    return rows.withColumn("active", F.col("active") & (F.col("_there").isNotNull() | (F.col("metadata_source") == "ADMIN"))).select(*stored.columns)


def list_content_metadata(metadata: DataFrame, site: str = SITE, limit: int = 100) -> DataFrame:
    return metadata.where(F.col("site_id") == site).orderBy(F.desc("updated_at"), "content_type", "content_id").limit(max(1, min(500, limit)))


def validate_content_metadata(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected with reason)."""
    def outside(c: str):
        return F.coalesce(~F.col(c).between(0, 100), F.lit(True))

    reason = (
        F.when(C.blank(F.col("content_type")) | C.blank(F.col("content_id")) | C.blank(F.col("primary_intent")), "contentType, contentId and primaryIntent are required")
        .when(outside("career_relevance") | outside("intent_weight"), "careerRelevance and intentWeight must be between 0 and 100")
        .when(F.coalesce(F.col("metadata_version") < 1, F.lit(True)), "metadataVersion must be at least 1")
        .when(~C.blank(F.col("complexity_level")) & ~F.trim("complexity_level").isin("FOUNDATIONAL", "INTERMEDIATE", "ADVANCED"), "complexityLevel is not supported")
    )
    marked = rows.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")
