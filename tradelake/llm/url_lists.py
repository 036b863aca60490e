"""URL filters whose lists change with time.

A list is a table of dated entries: (kind, key, listed_on, action), where the
action is `add` or `remove` and the kind says what the key stands for: `host`,
`domain` (with all hosts below it) or `prefix` (host/first path segment).
Entries of a key become validity intervals [valid_from, valid_to), cut at month
ends; captures meet them by key and month, and the day decides. So every
capture is judged by the entries active when it was fetched.

Entries of a key on one day count once, `remove` winning; adding what is listed
or removing what is not changes nothing. Rows without kind, key, day or a known
action are left out. A capture without URL, host or day is never blocked.
Repeated captures are judged each. Empty lists block nothing; an empty table of
captures gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

KINDS = ("prefix", "host", "domain")  # the most specific first
FAR = "9999-01-01"


def host_of(url: Column) -> Column:
    """Lower case, without user, port and last dot; null if there is none."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return F.nullif(F.rtrim(F.lower(host), F.lit(".")), F.lit(""))


def _prefix(url: Column, host: Column) -> Column:
    segment = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)", 1)
    return F.when(segment != "", F.concat(host, F.lit("/"), segment))


def keys_of(url: Column) -> Column:
    """All (kind, key) that can match a URL."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    starts = F.when(n >= 2, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    key = lambda kind, k: F.struct(F.lit(kind).alias("kind"), k.alias("key"))
    domains = F.transform(starts, lambda i: key("domain", F.array_join(F.slice(labels, i, n), ".")))
    return F.when(host.isNotNull(), F.filter(F.concat(F.array(key("prefix", _prefix(url, host)), key("host", host)), domains),
                                             lambda k: k["key"].isNotNull()))


def intervals(entries: DataFrame) -> DataFrame:
    """(kind, key, valid_from, valid_to) of a table of dated entries."""
    day = entries.where("kind IS NOT NULL AND key IS NOT NULL AND listed_on IS NOT NULL AND action IN ('add', 'remove')")
    # no more rows of a key than days, before its rows meet in one window
    day = day.groupBy("kind", "key", "listed_on").agg(F.max("action").alias("action"))
    by = Window.partitionBy("kind", "key").orderBy("listed_on")
    change = day.withColumn("before", F.lag("action", 1, "remove").over(by)).where("action <> before")
    span = change.withColumn("valid_to", F.coalesce(F.lead("listed_on").over(by), F.lit(FAR).cast("date")))
    return span.where("action = 'add'").select("kind", "key", F.col("listed_on").alias("valid_from"), "valid_to")


def judge(captures: DataFrame, entries: DataFrame, *, url: str = "url", day: str = "fetched_on") -> DataFrame:
    """(row, n_active, blocked, kind, key, listed_on) of every capture; row: all its columns.

    kind, key and listed_on are of the most specific active entry.
    """
    last = captures.agg(F.max(day)).first()[0]
    spans = intervals(entries)
    end = F.least(F.date_sub("valid_to", 1), F.lit(last).cast("date"))
    months = F.sequence(F.trunc("valid_from", "month"), F.trunc(end, "month"), F.expr("INTERVAL 1 MONTH"))
    spans = spans.where(F.col("valid_from") <= end).withColumn("month", F.explode(months))
    numbered = captures.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("_n"))
    asked = numbered.select("row", "_n", F.col(f"row.{day}").alias("_day"), F.explode_outer(keys_of(F.col(f"row.{url}"))).alias("_k"))
    s = spans.select(*(F.col(c).alias(f"s_{c}") for c in spans.columns))
    met = asked.join(s, (F.col("_k.kind") == F.col("s_kind")) & (F.col("_k.key") == F.col("s_key"))
                     & (F.trunc("_day", "month") == F.col("s_month")) & (F.col("_day") >= F.col("s_valid_from"))
                     & (F.col("_day") < F.col("s_valid_to")), "left")
    rank = F.when(F.col("s_kind").isNotNull(), F.struct(
        F.array_position(F.array(*map(F.lit, KINDS)), F.col("s_kind")).alias("kind"), (-F.char_length("s_key")).alias("size"), F.col("s_key").alias("key")))
    best = F.min_by(F.struct("s_kind", "s_key", "s_valid_from"), rank)
    out = met.groupBy("_n").agg(F.first("row").alias("row"), F.count("s_key").alias("n_active"), best.alias("best"))
    return out.select("row", "n_active", (F.col("n_active") > 0).alias("blocked"), F.col("best.s_kind").alias("kind"),
                      F.col("best.s_key").alias("key"), F.col("best.s_valid_from").alias("listed_on"))


def dated_captures(pages: DataFrame) -> DataFrame:
    """pages with a day of fetching, spread over the year 2024 by their id."""
    return pages.select("page_id", "url", F.expr("date_add(DATE '2024-01-01', cast(pmod(page_id * 37, 366) AS int))").alias("fetched_on"))


def derived_entries(pages: DataFrame) -> DataFrame:
    """A dated list over the keys of the pages' URLs; hashes of a key choose whether and when it is listed."""
    keys = pages.select(F.explode(keys_of(F.col("url"))).alias("k")).select("k.*").distinct()
    h = F.conv(F.substring(F.md5(F.concat_ws(":", "kind", "key")), 1, 6), 16, 10).cast("bigint")
    keys = keys.withColumn("h", h).where("h % 4 <> 0")
    add = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("h") % 300).cast("int"))
    off = F.date_add(add, (30 + F.floor(F.col("h") / 7) % 200).cast("int"))
    entry = lambda when, action, day: F.when(when, F.struct(day.alias("listed_on"), F.lit(action).alias("action")))
    e = F.array(entry(F.lit(True), "add", add), entry(F.col("h") % 3 != 0, "remove", off),
                entry(F.col("h") % 5 == 0, "add", F.date_add(off, 40)), entry(F.col("h") % 7 == 0, "add", add))
    return keys.select("kind", "key", F.explode(F.filter(e, lambda x: x.isNotNull())).alias("e")).select("kind", "key", "e.*")


def report(pages: DataFrame) -> DataFrame:
    """One row per page: the verdict of the derived list on the day of fetching."""
    j = judge(dated_captures(pages), derived_entries(pages))
    return j.select(F.col("row.page_id").alias("page_id"), F.col("row.fetched_on").cast("string").alias("fetched_on"),
                    "n_active", "blocked", "kind", "key", F.col("listed_on").cast("string").alias("listed_on"))


REPORT_SQL = r"""
WITH p AS (SELECT row_number() OVER () AS r, page_id, url, DATE '2024-01-01' + CAST(page_id * 37 % 366 AS INT) AS day,
  nullif(rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '.'), '') AS host,
  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)', 1) AS seg FROM pages),
k AS (SELECT r, 1 AS o, 'prefix' AS kind, host || '/' || seg AS key FROM p WHERE host IS NOT NULL AND seg <> ''
  UNION ALL SELECT r, 2, 'host', host FROM p WHERE host IS NOT NULL
  UNION ALL SELECT r, 3, 'domain', array_to_string(string_split(host, '.')[i:], '.')
    FROM (SELECT r, host, unnest(range(1, len(string_split(host, '.')))) AS i FROM p WHERE host IS NOT NULL)),
h AS (SELECT kind, key, CAST('0x' || substr(md5(kind || ':' || key), 1, 6) AS BIGINT) AS h FROM (SELECT DISTINCT kind, key FROM k)),
a AS (SELECT kind, key, h, DATE '2024-01-01' + CAST(h % 300 AS INT) AS d0,
  DATE '2024-01-01' + CAST(h % 300 + 30 + (h // 7) % 200 AS INT) AS d1 FROM h WHERE h % 4 <> 0),
s AS (SELECT kind, key, d0 AS f, CASE WHEN h % 3 <> 0 THEN d1 ELSE DATE '9999-01-01' END AS t FROM a
  UNION ALL SELECT kind, key, d1 + 40, DATE '9999-01-01' FROM a WHERE h % 5 = 0 AND h % 3 <> 0),
m AS (SELECT p.r, k.o, s.* FROM p JOIN k USING (r) JOIN s ON s.kind = k.kind AND s.key = k.key AND p.day >= s.f AND p.day < s.t),
b AS (SELECT r, count(*) AS n, min_by({'kind': kind, 'key': key, 'f': f}, (o, -length(key), key)) AS best FROM m GROUP BY r)
SELECT page_id, CAST(day AS VARCHAR) AS fetched_on, coalesce(n, 0) AS n_active, coalesce(n, 0) > 0 AS blocked,
  best.kind AS kind, best.key AS key, CAST(best.f AS VARCHAR) AS listed_on
FROM p LEFT JOIN b USING (r)
"""
