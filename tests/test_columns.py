"""Column rules on small cases."""

import contextlib
import hashlib
import hmac
import io
import re

import pytest
from pyspark.sql import functions as F

from visitlens.functions import columns as C
from visitlens.operators import rollups
from visitlens.plans import journey_queries
from visitlens.plans import tables as T


def one(spark, *cols, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return tuple(row.select(*cols).first())


@pytest.mark.parametrize(
    "ua, device, browser, os",
    [
        ("Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) Chrome/120.0 Safari/537.36", "desktop", "Chrome", "macOS"),
        ("Mozilla/5.0 (iPhone; CPU iPhone OS 17_0 like Mac OS X) Mobile/15E148 Safari/604.1", "mobile", "Safari", "iOS"),
        ("Mozilla/5.0 (iPad; CPU OS 16_0 like Mac OS X) Safari/604.1", "tablet", "Safari", "iOS"),
        ("Mozilla/5.0 (compatible; Googlebot/2.1; +http://www.google.com/bot.html)", "bot", "unknown", "unknown"),
        ("Mozilla/5.0 (Windows NT 10.0) Chrome/120.0 Edg/120.0", "desktop", "Edge", "Windows"),
        ("Mozilla/5.0 (Linux; Android 14) Chrome/120.0 Mobile", "mobile", "Chrome", "Android"),
        ("Opera/9.80 (X11; Linux x86_64)", "desktop", "Opera", "Linux"),
        ("  ", "unknown", "unknown", "unknown"),
        (None, "unknown", "unknown", "unknown"),
    ],
)
def test_user_agents(spark, ua, device, browser, os):
    ua_ = F.col("ua")
    assert one(spark, C.ua_device(ua_), C.ua_browser(ua_), C.ua_os(ua_), ua=ua) == (device, browser, os)


@pytest.mark.parametrize(
    "device, referrer, score", [("bot", "x", 1.0), ("bot", None, 1.0), ("unknown", None, 0.6), ("desktop", "", 0.1), ("mobile", None, 0.0), ("desktop", "x", 0.0)]
)
def test_bot_score(spark, device, referrer, score):
    assert one(spark, C.bot_score(F.col("d"), F.col("r")), d=device, r=referrer)[0] == pytest.approx(score)


def test_ip_hash_is_hmac_and_incoming_hash_wins(spark):
    want = hmac.new(b"salt", b"1.2.3.4", hashlib.sha256).hexdigest()
    h = C.ip_hash(F.col("ip"), F.col("given"), "salt")
    assert one(spark, h, ip=" 1.2.3.4 ", given=None)[0] == want
    assert one(spark, h, ip="1.2.3.4", given="abc")[0] == "abc"
    assert one(spark, h, ip=" ", given=None)[0] is None


@pytest.mark.parametrize(
    "hint, area",
    [
        ((None, None, None), "GLOBAL"), (("US", "UT", "Provo"), "METRO:US:UT:Provo"), (("US", "UT", None), "REGION:US:UT"), (("US", None, None), "COUNTRY:US"),
        (("US", None, "X"), "METRO:US::X"), (("US", "", None), "REGION:US:"),
    ],
)
def test_geo_snap(spark, hint, area):
    assert one(spark, C.geo_snap(F.col("c"), F.col("r"), F.col("m"))["geo_area_id"], c=hint[0], r=hint[1], m=hint[2])[0] == area


@pytest.mark.parametrize(
    "url, path",
    [
        ("https://a.example/x/y?q=1#z", "/x/y"), ("/rel?x", "/rel"), ("https://a.example", ""), ("https://a.example/a%20b+c", "/a b+c"), ("::bad::?x", "::bad::"), (" ", None),
    ],
)
def test_path_only(spark, url, path):
    assert one(spark, C.path_only(F.col("u")), u=url)[0] == path


@pytest.mark.parametrize("url, host", [("linkedin.com", "linkedin.com"), ("https://a.b/c", "a.b"), (None, None), ("https://a_b.c/", None)])
def test_domain_only(spark, url, host):
    assert one(spark, C.domain_only(F.col("u")), u=url)[0] == host


def test_sessions_and_rollup_keys_differ_without_address(spark):
    cols = [F.col(c) for c in ("s", "a", "ip", "d")]
    assert one(spark, C.session_key(*cols), C.rollup_session_key(*cols), s=" ", a=None, ip=None, d="mobile") == (None, "null:mobile")
    assert one(spark, C.session_key(*cols), C.rollup_session_key(*cols), s="s", a="a", ip="i", d="d") == ("s", "s")


def test_buckets(spark):
    ts = F.expr("timestamp_ntz '2025-01-01 12:07:34'")
    row = spark.range(1).select(C.bucket_floor(ts, "5m").alias("a"), C.bucket_floor(ts, "1d").alias("b")).first()
    assert (row.a.isoformat(), row.b.isoformat()) == ("2025-01-01T12:05:00", "2025-01-01T00:00:00")
    with pytest.raises(ValueError):
        C.bucket_floor(ts, "1h")


def test_parameters():
    assert [C.window_days(*a) for a in (("7d",), ("all",), (None, 3), (None, 0), ())] == [7, None, 3, None, 30]
    assert [C.level_name(x) for x in ("world", "local", "nope", None)] == ["COUNTRY", "METRO", None, None]
    for bad in (lambda: C.window_days("2w"), lambda: C.level_name("global"), lambda: C.range_filter(None, "2024-01-01", "2024-03-01")):
        with pytest.raises(ValueError):
            bad()


def test_filters_take_text_literally(spark):
    rows = spark.createDataFrame([("/blog_100%",), ("/blogX100Y",), (None,)], "p string")
    assert rows.where(C.contains_filter(F.col("p"), "/blog_100%")).count() == 1
    assert rows.where(C.exact_filter(F.col("p"), " /BLOG_100% ")).count() == 1
    assert rows.where(C.contains_filter(F.col("p"), " ")).count() == 3


@pytest.mark.parametrize("url, kept", [("http://localhost:3000/x", False), ("127.0.0.1/a", False), ("https://site.example/localhost", True), (None, True)])
def test_loopback(spark, url, kept):
    cols = [F.col("u"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("8.8.8.8")]
    assert one(spark, C.exclude_loopback(*cols), u=url)[0] is kept


@pytest.mark.parametrize("path, children, like", [("/admin", False, False), ("/admin/x", False, False), ("/administrator", True, False), (None, True, True), ("/x", True, True)])
def test_admin_prefix(spark, path, children, like):
    p = F.col("p")
    assert one(spark, C.exclude_admin_prefix(p), C.exclude_admin_prefix(p, mode="like"), p=path) == (children, like)


def test_properties(spark):
    props = F.from_json(F.lit('{"contentId": " c ", "secret": "x", "rank": "[1]", "engagedSeconds": "99999.7", "progressPercent": "many"}'), "map<string,string>")
    row = spark.range(1).select(
        C.sanitize_properties(props).alias("s"), C.property_text(props, "contentId").alias("t"), C.bounded_int(props, "engagedSeconds", 86_400).alias("e"),
        C.bounded_int(props, "progressPercent", 100).alias("p"), C.bounded_int_strict(props, "engagedSeconds", 200_000).alias("r"),
    ).first()
    assert (set(row.s), row.t, row.e, row.p, row.r) == ({"contentId", "engagedSeconds", "progressPercent"}, "c", 86_400, None, 100_000)


def test_box_over_the_date_line(spark):
    rows = spark.createDataFrame([(0.0, 179.0), (0.0, -179.0), (0.0, 0.0)], "lat double, lng double")
    assert rows.where(C.bbox_filter(F.col("lat"), F.col("lng"), (-10, 10, 170, -170))).count() == 2
    with pytest.raises(ValueError):
        C.bbox_filter(F.col("lat"), F.col("lng"), (-90, 90, -179.9, 179.9), "all")


def test_rollup_of_an_event_without_geo_is_global_only(spark):
    row = spark.createDataFrame(
        [("e", "s", "page_view", "sess", None, "", "", "", False, None, "GLOBAL", "GLOBAL", None, None, None)],
        "event_id string, site_id string, event_type string, session_id string, anon_id string, device_type string, browser string, os string, is_bot boolean, ip_hash string, geo_level string, geo_area_id string, country string, region string, metro string",
    ).withColumns({"event_time": F.expr("timestamp_ntz '2024-01-01 12:03:00'"), "server_time": F.expr("timestamp_ntz '2024-01-01 12:03:00'")})
    got = rollups.rollup_events(row).collect()
    assert {(r.granularity, r.geo_level, r.device_type, r.event_count, r.unique_sessions) for r in got} == {("5m", "GLOBAL", "unknown", 1, 1), ("1d", "GLOBAL", "unknown", 1, 1)}


def test_white_space_alone_is_blank(spark):
    values = [None, "", " ", "\t", "\n \r", "\u000b", "a", " a\t"]
    got = spark.createDataFrame([(v,) for v in values], "v string").select(C.blank(F.col("v")).alias("b"), C.filled(F.col("v")).alias("f")).collect()
    assert [r.b for r in got] == [True] * 6 + [False] * 2 and [r.f for r in got][6:] == ["a", " a\t"]


@pytest.mark.parametrize("of", ["enriched", "facts", "steps"])
def test_no_generated_method_is_too_large_for_the_jvm_to_compile(spark, sf, of):
    """HotSpot leaves methods of more than 8000 bytes to its interpreter."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = {"enriched": T.enriched, "facts": T.facts, "steps": journey_queries.steps}[of](spark, sf)
        with contextlib.redirect_stdout(io.StringIO()) as out:
            df.explain("codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", out.getvalue())]
    assert sizes and max(sizes) < 8000
