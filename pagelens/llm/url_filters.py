"""URL filters: dated list entries as validity intervals, joined to captures as of their fetch time (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import without

HOST, DOMAIN, PREFIX = "host", "domain", "prefix"


def host_of(url: Column) -> Column:
    """Lower-case host without user or port; empty where there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def path_of(url: Column) -> Column:
    """Path without query and fragment; '/' where it is empty."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def url_keys(url: Column, labels: list[int], depths: list[int]) -> Column:
    """All keys that cover a URL and that a list can have, ``array<struct<kind,key>>``: its host, the domains of two labels
    or more that it lies in (a host of one label is its own), host with each directory of the path, and the whole path.

    ``labels`` and ``depths`` are the numbers of labels and of slashes that the list's patterns have, see sizes(). Only
    such keys are made, so a URL of very many directories costs what the list asks for, not the square of its length.
    """
    host, path = host_of(url), path_of(url)
    n_labels, n_slashes = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1, F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))
    some = lambda sizes, fits: F.filter(F.array(*map(F.lit, sizes)).cast("array<int>"), fits)
    suffixes = F.transform(some(labels, lambda i: (i <= n_labels) & ((i > 1) | (n_labels == 1))), lambda i: F.call_function("substring_index", host, F.lit("."), -i))
    prefixes = F.transform(some(depths, lambda i: i <= n_slashes), lambda i: F.concat(host, F.call_function("substring_index", path, F.lit("/"), i), F.lit("/")))
    named = lambda kind, keys: F.transform(keys, lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key")))
    every = F.concat(named(HOST, F.array(host)), named(DOMAIN, suffixes), named(PREFIX, F.array_distinct(F.concat(F.array(F.concat(host, path)), prefixes))))
    return F.when(host != "", every)


def sizes(entries: DataFrame) -> tuple[list[int], list[int]]:
    """Numbers of labels that domain patterns have, and of slashes that prefix patterns have: few, as k of them need patterns of k^2 / 2 characters."""
    parts = lambda mark: F.length("pattern") - F.length(F.replace(F.col("pattern"), F.lit(mark), F.lit("")))
    size = F.when(F.col("kind") == DOMAIN, parts(".") + 1).otherwise(parts("/"))
    rows = entries.where(F.col("kind").isin(DOMAIN, PREFIX) & F.col("pattern").isNotNull()).select("kind", size.alias("n")).distinct().collect()
    return tuple(sorted(r["n"] for r in rows if r["kind"] == kind and r["n"] > 0) for kind in (DOMAIN, PREFIX))


def validity(entries: DataFrame) -> DataFrame:
    """Intervals ``(list, kind, pattern, valid_from, valid_to)`` in which a pattern is on a list, from dated entries.

    ``entries(list, kind, pattern, dated, action)``: an ``add`` holds until the pattern's next entry on that list,
    open-ended if there is none; a ``remove`` ends it. Of entries at one instant an add wins. Repeated entries count
    once. Entries without a list, kind, pattern or date, or with another action, are void.
    """
    e = entries.select("list", "kind", "pattern", "dated", "action").dropna().where(F.col("action").isin("add", "remove"))
    e = e.groupBy("list", "kind", "pattern", "dated").agg(F.max((F.col("action") == "add").cast("int")).alias("on"))
    after = F.lead("dated").over(W.partitionBy("list", "kind", "pattern").orderBy("dated"))
    return e.select("list", "kind", "pattern", F.col("dated").alias("valid_from"), after.alias("valid_to"), "on").where("on = 1").drop("on")


def filter_captures(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched_at") -> DataFrame:
    """All columns of ``captures`` and ``url_filter(blocked, n_entries, lists, pattern)``: what was active when fetched.

    ``lists`` are the names, sorted, of the lists that held the capture at its fetch time, ``pattern`` the longest
    entry that did (of equal length the greatest). An interval counts from its first instant up to, not including, its
    end. A capture with a null URL or time, or a URL without a host, is not blocked.

    Each distinct (URL, time) is judged once: its keys, of the sizes that the list's patterns have, meet the
    intervals by equi-join with the time as a further condition, so only active entries come out. A key of very many
    captures is one that AQE splits. Repeated rows repeat; empty tables give no rows or nothing blocked. A column
    ``url_filter`` of ``captures`` is replaced.
    """
    captures = without(captures, "url_filter")
    u, t = F.col(url), F.col(fetched)
    seen = captures.select(u.alias("u"), t.alias("t")).dropna().distinct()
    keys = seen.select("u", "t", F.explode(url_keys(F.col("u"), *sizes(entries))).alias("k")).select("u", "t", F.col("k.kind").alias("kind"), F.col("k.key").alias("pattern"))
    live = keys.join(validity(entries), ["kind", "pattern"]).where((F.col("t") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("t") < F.col("valid_to"))))
    best = F.max(F.struct(F.length("pattern"), "pattern", "kind"))
    hits = live.groupBy("u", "t").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("list")).alias("lists"), best.alias("best"))
    found = F.struct(F.col("n").isNotNull().alias("blocked"), F.coalesce("n", F.lit(0)).alias("n_entries"), F.coalesce("lists", F.expr("cast(array() as array<string>)")).alias("lists"), F.col("best.pattern").alias("pattern"))
    left, right = captures.alias("captures"), hits.alias("hits")
    joined = left.join(right, (F.col(f"captures.{url}") == F.col("hits.u")) & (F.col(f"captures.{fetched}") == F.col("hits.t")), "left")
    return joined.select("captures.*", found.alias("url_filter"))


def captures_of(pages: DataFrame) -> DataFrame:
    """Page captures with the fetch times that the tables lack: one of 366 days by page_id."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(366)).cast("int")).cast("timestamp").alias("fetched_at"))


def entries_of(pages: DataFrame) -> DataFrame:
    """Dated entries for part of the hosts, domains and first directories of ``pages``, by their least page_id.

    Added, removed after 60 to 119 days, and every second one added again.
    """
    host, first = host_of(F.col("url")), F.regexp_extract(path_of(F.col("url")), "^/[^/]+/", 0)
    domain = F.array_join(F.slice(F.split(host, r"\."), -2, 2), ".")
    p = pages.select("page_id", host.alias("host"), F.when(F.size(F.split(host, r"\.")) > 1, domain).alias("domain"), F.when(first != "", F.concat(host, first)).alias("dir")).where("host <> ''")
    one = F.stack(F.lit(3), F.lit("malware"), F.lit(HOST), F.col("host"), F.lit("adult"), F.lit(DOMAIN), F.col("domain"), F.lit("spam"), F.lit(PREFIX), F.col("dir"))
    some = p.select("page_id", one).toDF("page_id", "list", "kind", "pattern").dropna().groupBy("list", "kind", "pattern").agg(F.min("page_id").alias("k"))
    day = F.lit("2024-01-01").cast("date")
    steps = F.array(*[F.struct(F.date_add(day, d.cast("int")).cast("timestamp").alias("dated"), F.lit(a).alias("action"), when.alias("there")) for d, a, when in (
        (F.col("k") % 200, "add", F.lit(True)), (F.col("k") % 200 + 60 + F.col("k") % 60, "remove", F.lit(True)), (F.col("k") % 200 + 150, "add", F.col("k") % 2 == 0))])
    some = some.where("k % 3 <> 0").select("list", "kind", "pattern", F.explode(steps).alias("e")).where("e.there")
    return some.select("list", "kind", "pattern", "e.dated", "e.action")


SQL = r"""
WITH p AS (
  SELECT page_id, url, (DATE '2024-01-01' + (page_id * 37 % 366)::INT)::TIMESTAMP AS t,
    lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host,
    CASE WHEN regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) = '' THEN '/'
         ELSE regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) END AS path FROM pages),
q AS (SELECT *, string_split(host, '.') AS labels, string_split(path, '/') AS dirs, regexp_extract(path, '^/[^/]+/') AS d1 FROM p WHERE host <> ''),
x AS (
  SELECT 'malware' AS list, 'host' AS kind, host AS pattern, page_id FROM q
  UNION ALL SELECT 'adult', 'domain', array_to_string(labels[-2:], '.'), page_id FROM q WHERE len(labels) > 1
  UNION ALL SELECT 'spam', 'prefix', host || d1, page_id FROM q WHERE d1 <> ''),
s AS (SELECT list, kind, pattern, min(page_id) AS k FROM x GROUP BY ALL HAVING min(page_id) % 3 <> 0),
e AS (
  SELECT list, kind, pattern, k % 200 AS d, 1 AS is_add FROM s
  UNION ALL SELECT list, kind, pattern, k % 200 + 60 + k % 60, 0 FROM s
  UNION ALL SELECT list, kind, pattern, k % 200 + 150, 1 FROM s WHERE k % 2 = 0),
v AS (SELECT list, kind, pattern, is_add, (DATE '2024-01-01' + d::INT)::TIMESTAMP AS f,
        (DATE '2024-01-01' + (lead(d) OVER (PARTITION BY list, kind, pattern ORDER BY d))::INT)::TIMESTAMP AS u
      FROM (SELECT list, kind, pattern, d, max(is_add) AS is_add FROM e GROUP BY ALL)),
k AS (
  SELECT DISTINCT url, t, kind, key FROM (
    SELECT url, t, 'host' AS kind, host AS key FROM q
    UNION ALL SELECT url, t, 'prefix', host || path FROM q
    UNION ALL SELECT url, t, 'domain', array_to_string(labels[i:], '.') FROM q, unnest(range(1, greatest(len(labels), 2))) r(i)
    UNION ALL SELECT url, t, 'prefix', host || array_to_string(dirs[1:i], '/') || '/' FROM q, unnest(range(1, greatest(len(dirs), 2))) r(i))),
h AS (SELECT url, t, count(*) AS n, array_to_string(list_sort(list_distinct(list(list))), ',') AS lists, max((length(pattern), pattern))[2] AS pattern
      FROM k JOIN v ON v.kind = k.kind AND v.pattern = k.key AND v.is_add = 1 AND t >= f AND (u IS NULL OR t < u) GROUP BY url, t)
SELECT p.page_id, p.url, h.n IS NOT NULL AS blocked, coalesce(h.n, 0)::BIGINT AS n_entries, coalesce(h.lists, '') AS lists, h.pattern
FROM p LEFT JOIN h ON p.url = h.url AND p.t = h.t
"""
