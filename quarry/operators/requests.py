"""Requests and clicks: who asks, with what, and which clicks are one."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.plans.registry import Tables, query

# Agents that are no people, and the families of devices and browsers, first match wins.
BOT = r"bot[/;)-]|bot \(|\+https?:|crawler|spider|slurp|facebookexternalhit|embedly|headless|lighthouse|^curl/|^wget/|python-requests|go-http-client|^okhttp/|^java/"
DEVICES = [
    (r"bot|crawler|spider|crawling|headless|slurp|facebookexternalhit|preview", "other"),
    (r"ipad|tablet|kindle|silk|playbook", "tablet"),
    (r"mobi|iphone|ipod|android|windows phone", "mobile"),
    (r"windows nt|macintosh|mac os x|x11|linux|cros", "desktop"),
]
BROWSERS = [
    (r"edg(e|a|ios)?/", "edge"), (r"opr/|opera", "opera"), (r"samsungbrowser", "samsung"), (r"firefox|fxios", "firefox"),
    (r"chrome|crios|chromium", "chrome"),
]
#: Agents that stand in for the request headers the provided events lack, dealt by event id.
AGENTS = (
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 Chrome/126.0 Safari/537.36",
    "Mozilla/5.0 (iPhone; CPU iPhone OS 17_5 like Mac OS X) AppleWebKit/605.1 Version/17.5 Mobile/15E148 Safari/604.1",
    "Mozilla/5.0 (Linux; Android 14; SM-X910) AppleWebKit/537.36 SamsungBrowser/25.0 Chrome/121.0 Safari/537.36",
    "Mozilla/5.0 (compatible; Examplebot/2.1; +http://example.com/bot.html)",
    "Mozilla/5.0 (Linux; Android 13; CUBOT X70) AppleWebKit/537.36 Chrome/125.0 Mobile Safari/537.36",
    "curl/8.5.0",
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 14_5) AppleWebKit/605.1 Version/17.4 Safari/605.1",
    "Mozilla/5.0 (X11; Linux x86_64; rv:127.0) Gecko/20100101 Firefox/127.0",
    "Mozilla/5.0 (Windows NT 10.0) AppleWebKit/537.36 Chrome/126.0 Safari/537.36 Edg/126.0",
    None,
)


def requests(t: Tables) -> DataFrame:
    agents = F.array(*[F.lit(a).cast("string") for a in AGENTS])
    k = F.col("event_id")
    return t.events.select(
        "event_id", "ts", "user_id", "event_type", "value",
        F.get(agents, F.pmod(F.expr("event_id div 3"), F.lit(len(AGENTS))).cast("int")).alias("agent"),
        F.when(k % 17 == 0, "head").otherwise("GET").alias("method"),
        F.when(k % 13 == 0, "Prefetch;prerender").when(k % 13 == 1, "").alias("purpose"),
    )


_AGENTS = ", ".join("NULL" if a is None else f"'{a}'" for a in AGENTS)
REQUESTS_SQL = f"""(SELECT *, ([{_AGENTS}])[event_id // 3 % {len(AGENTS)} + 1] AS agent, CASE WHEN event_id % 17 = 0 THEN 'head' ELSE 'GET' END AS method,
  CASE event_id % 13 WHEN 0 THEN 'Prefetch;prerender' WHEN 1 THEN '' END AS purpose FROM events)"""


def click_kind(method: Column, purpose: Column, agent: Column) -> Column:
    ahead = F.lower(F.coalesce(purpose, F.lit(""))).rlike("prefetch|prerender|preview")
    machine = agent.isNull() | (agent == "") | agent.rlike(f"(?i){BOT}")
    return F.when(F.upper(method) == "HEAD", "head").when(ahead, "prefetch").when(machine, "bot").otherwise("human")


@query(
    "enum_click_kind",
    f"""SELECT event_id, CASE WHEN upper(method) = 'HEAD' THEN 'head' WHEN regexp_matches(lower(coalesce(purpose, '')), 'prefetch|prerender|preview') THEN 'prefetch'
    WHEN agent IS NULL OR agent = '' OR regexp_matches(agent, '(?i){BOT}') THEN 'bot' ELSE 'human' END AS kind FROM {REQUESTS_SQL}""",
)
def enum_click_kind(t: Tables) -> DataFrame:
    return requests(t).select("event_id", click_kind(F.col("method"), F.col("purpose"), F.col("agent")).alias("kind"))


def device(agent: Column) -> Column:
    """Null without an agent; the first 512 characters count."""
    ua = F.lower(F.substring(agent, 1, 512))
    bot, tablet, mobile, desktop = [(ua.rlike(p), name) for p, name in DEVICES]
    wide = ua.contains("android") & ~ua.contains("mobile")
    known = F.when(bot[0], bot[1]).when(tablet[0] | wide, tablet[1]).when(mobile[0], mobile[1]).when(desktop[0], desktop[1]).otherwise("other")
    return F.when(agent.isNotNull() & (agent != ""), known)


def browser(agent: Column) -> Column:
    ua = F.lower(F.substring(agent, 1, 512))
    found = F.when(ua.rlike(BROWSERS[0][0]), BROWSERS[0][1])
    for pattern, name in BROWSERS[1:]:
        found = found.when(ua.rlike(pattern), name)
    found = found.when(ua.contains("safari") & ua.contains("version/"), "safari").otherwise("other")
    return F.when(agent.isNotNull() & (agent != ""), found)


_UA = "lower(left(agent, 512))"
_BROWSER = " ".join(f"WHEN regexp_matches({_UA}, '{p}') THEN '{n}'" for p, n in BROWSERS)


@query(
    "enum_user_agent",
    f"""SELECT event_id, CASE WHEN agent IS NULL OR agent = '' THEN NULL WHEN regexp_matches({_UA}, '{DEVICES[0][0]}') THEN 'other'
      WHEN regexp_matches({_UA}, '{DEVICES[1][0]}') OR (contains({_UA}, 'android') AND NOT contains({_UA}, 'mobile')) THEN 'tablet'
      WHEN regexp_matches({_UA}, '{DEVICES[2][0]}') THEN 'mobile' WHEN regexp_matches({_UA}, '{DEVICES[3][0]}') THEN 'desktop' ELSE 'other' END AS device,
    CASE WHEN agent IS NULL OR agent = '' THEN NULL {_BROWSER} WHEN contains({_UA}, 'safari') AND contains({_UA}, 'version/') THEN 'safari' ELSE 'other' END AS browser FROM {REQUESTS_SQL}""",
)
def enum_user_agent(t: Tables) -> DataFrame:
    return requests(t).select("event_id", device(F.col("agent")).alias("device"), browser(F.col("agent")).alias("browser"))


# The first part of a path and the area it opens.
AREAS = {
    "ara": "search", "urun": "product", "sohbet": "chat", "trendler": "trends", "firsatlar": "deals", "kesfet": "discover",
    "kaydettiklerim": "saved", "gecmis": "history", "alarmlar": "alerts", "blog": "blog",
}
_ROOTS = [*AREAS, "xyz", ""]
_PATHS = f"(SELECT event_id, value * 1000 AS ms, CASE WHEN event_id % 2 = 0 THEN 'https://shop.example' ELSE '' END || '/' || ([{', '.join(repr(r) for r in _ROOTS)}])[event_id % {len(_ROOTS)} + 1] || '?q=1' AS url FROM events)"


@query(
    "enum_page_area",
    f"""SELECT event_id, CASE WHEN root = '' THEN 'home' {" ".join(f"WHEN root = '{k}' THEN '{v}'" for k, v in AREAS.items())} ELSE 'other' END AS area,
    CASE WHEN ms < 0 THEN NULL WHEN ms < 10000 THEN '0-10s' WHEN ms < 30000 THEN '10-30s' WHEN ms < 120000 THEN '30-120s' WHEN ms < 600000 THEN '2-10m' ELSE '10m+' END AS engagement
    FROM (SELECT *, regexp_extract(regexp_replace(url, '^[a-z]+://[^/]*', ''), '^/([^/?#]*)', 1) AS root FROM {_PATHS})""",
)
def enum_page_area(t: Tables) -> DataFrame:
    """The area that an address opens, and how long the page was seen, in buckets."""
    root = F.get(F.array(*map(F.lit, _ROOTS)), F.pmod("event_id", F.lit(len(_ROOTS))).cast("int"))
    url = F.concat(F.when(F.col("event_id") % 2 == 0, "https://shop.example").otherwise(""), F.lit("/"), root, F.lit("?q=1"))
    first = F.regexp_extract(F.regexp_replace(url, "^[a-z]+://[^/]*", ""), "^/([^/?#]*)", 1)
    area = F.when(first == "", "home")
    for k, v in AREAS.items():
        area = area.when(first == k, v)
    ms = F.col("value") * 1000
    seen = F.when(ms < 0, None).when(ms < 10000, "0-10s").when(ms < 30000, "10-30s").when(ms < 120000, "30-120s").when(ms < 600000, "2-10m")
    return t.events.select("event_id", area.otherwise("other").alias("area"), seen.otherwise("10m+").alias("engagement"))


@query(
    "st_click_dedupe",
    """WITH RECURSIVE c AS (SELECT event_id, user_id AS session, event_id % 3 AS offer, ts FROM events WHERE event_type = 'click'),
    n AS (SELECT *, row_number() OVER (PARTITION BY session, offer ORDER BY ts, event_id) AS i FROM c),
    s AS (SELECT event_id, session, offer, i, event_id AS click_id, ts AS stored FROM n WHERE i = 1
      UNION ALL SELECT n.event_id, n.session, n.offer, n.i, CASE WHEN n.ts - s.stored <= INTERVAL 5 SECOND THEN s.click_id ELSE n.event_id END,
        CASE WHEN n.ts - s.stored <= INTERVAL 5 SECOND THEN s.stored ELSE n.ts END FROM s JOIN n ON n.session = s.session AND n.offer = s.offer AND n.i = s.i + 1)
    SELECT event_id, click_id FROM s""",
)
def st_click_dedupe(t: Tables) -> DataFrame:
    """The stored click that each click counts as, by session and offer, within five seconds of it."""
    clicks = t.events.where("event_type = 'click'").select(
        "event_id", F.col("user_id").alias("session"), (F.col("event_id") % 3).alias("offer"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at")
    )
    return stored_clicks(clicks, ["session", "offer"], 5 * 1000000)


def stored_clicks(clicks: DataFrame, own: list[str], window: int) -> DataFrame:
    """event_id and click_id of clicks (event_id, own, at): a click within `window` of a stored one is that one.

    Reused clicks are not stored, so a click is measured against the last stored one, not against the click before it. A click
    that comes later than the window after the one before it is stored whatever came before; only inside a run without such a
    pause the rule goes click by click, and each run is judged apart.
    """
    order = Window.partitionBy(*own).orderBy("at", "event_id")
    fresh = F.coalesce(F.col("at") - F.lag("at").over(order) > window, F.lit(True))
    rows = clicks.withColumn("run", F.sum(fresh.cast("int")).over(order))
    rows = rows.withColumn("size", F.count("*").over(Window.partitionBy(*own, "run")))

    def judge(run: pd.DataFrame) -> pd.DataFrame:
        out, stored, last = [], None, None
        for event_id, at in run.sort_values(["at", "event_id"])[["event_id", "at"]].itertuples(index=False):
            if last is None or at - last > window:
                stored, last = event_id, at
            out.append((event_id, stored))
        return pd.DataFrame(out, columns=["event_id", "click_id"])

    alone = rows.where("size = 1").select("event_id", F.col("event_id").alias("click_id"))
    return alone.unionByName(rows.where("size > 1").groupBy(*own, "run").applyInPandas(judge, "event_id long, click_id long"))
