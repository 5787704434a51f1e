"""URL filters as a temporal list join.

A list is a log of dated entries: (list_name, kind, pattern, listed_at, action). Entries become validity
intervals: an ``add`` holds from its date to the next entry of the same list, kind and pattern. Every capture is
judged by the entries active at its fetch time: its host, the host's parent domains and its path prefixes are
looked up by equality, as far as the list has patterns of their length, and an as-of join finds the last interval of each list that began by the fetch time; it counts
if it hasn't ended. Kinds: ``host`` (the whole host), ``domain`` (the host or any parent domain), ``url`` (host and
leading path segments).

The as-of join is a window over captures and intervals together, sorted by time: a row for each capture, list and
pattern, however long the pattern's history is. Captures are reduced to distinct (url, fetch time) first. A pattern
with more than SALT_ROWS captures is dealt into as many windows as it takes, each with all the pattern's intervals.

Defined cases: a null or unparsable url and a null fetch time match nothing, nor does a url longer than any pattern do
so but by its leading segments; entries with a null field are ignored; of entries at the same instant, a ``remove``
counts; repeated captures get equal rows; an empty list leaves every capture unblocked; other columns of either table
are ignored, or passed through by ``judged``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import maybe_broadcast, written

#: Captures of a pattern that one window takes.
SALT_ROWS = 1_000
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]+)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    """Lower-case host of an absolute url without a final dot; empty if there is none."""
    return F.rtrim(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _HOST, 1)), F.lit("."))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PATH, 1)


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(list_name, kind, pattern, valid_from, valid_to): half-open; an open end is null."""
    names = ["list_name", "kind", "pattern", "listed_at"]
    once = entries.where(" AND ".join(f"{c} IS NOT NULL" for c in [*names, "action"])).groupBy(*names).agg(F.max("action").alias("action"))
    later = F.lead("listed_at").over(W.partitionBy("list_name", "kind", "pattern").orderBy("listed_at"))
    return once.withColumn("valid_to", later).where("action = 'add'").select("list_name", "kind", "pattern", F.col("listed_at").alias("valid_from"), "valid_to")


def sizes_of(entries: DataFrame) -> tuple[list[int], list[int]]:
    """Numbers of labels that listed domains have, and of path segments that listed urls have: each distinct number once.

    A list with patterns of n different sizes has at least n * n / 2 characters, so these are few.
    """
    known = entries.where("kind IN ('domain', 'url') AND pattern IS NOT NULL")
    size = F.regexp_count("pattern", F.when(F.col("kind") == "domain", F.lit("\\.")).otherwise(F.lit("/")))
    found = known.groupBy("kind", size.alias("n")).agg(F.lit(1).alias("one")).collect()
    return sorted(r["n"] + 1 for r in found if r["kind"] == "domain"), sorted(r["n"] for r in found if r["kind"] == "url")


def lookups(host: Column, path: Column, labels: list[int], segments: list[int]) -> Column:
    """The (kind, pattern) pairs under which a capture may be listed: parents and prefixes of the sizes that the list has.

    No other size can match, so a url of very many segments or labels is cut only where the list has patterns as long.
    """
    sizes = lambda n: F.array(*[F.lit(x) for x in n]).cast("array<int>")
    names = F.slice(F.reverse(F.split(host, "\\.")), 1, max(labels, default=1))
    parents = F.transform(F.filter(sizes(labels), lambda n: n <= F.size(names)), lambda n: F.array_join(F.reverse(F.slice(names, 1, n)), "."))
    steps = F.slice(F.filter(F.split(path, "/"), lambda s: s != ""), 1, max(segments, default=0) or 1)
    prefixes = F.transform(F.filter(sizes(segments), lambda n: n <= F.size(steps)), lambda n: F.array_join(F.concat(F.array(host), F.slice(steps, 1, n)), "/"))
    pair = lambda kind: lambda p: F.struct(F.lit(kind).alias("kind"), p.alias("pattern"))
    return F.concat(F.array(pair("host")(host)), F.transform(parents, pair("domain")), F.transform(prefixes, pair("url")))


def url_filter(captures: DataFrame, entries: DataFrame, url: str = "url", fetched_at: str = "fetched_at") -> DataFrame:
    """One row for each distinct (url, fetched_at): host, n_entries, lists (sorted, comma-joined) and blocked."""
    base = captures.select(F.col(f"`{url}`").alias("url"), F.col(f"`{fetched_at}`").alias("fetched_at")).distinct()
    base = base.withColumn("host", host_of(F.col("url")))
    sought = base.where("host != '' AND fetched_at IS NOT NULL").select("url", "fetched_at", F.explode(F.array_distinct(lookups(F.col("host"), path_of(F.col("url")), *sizes_of(entries)))).alias("at")).select("url", "fetched_at", "at.*")
    spans = validity_intervals(entries)
    at = ["list_name", "kind", "pattern"]
    listed = written(sought.join(spans.select(*at).distinct(), ["kind", "pattern"]), "url-listed")
    crowds = listed.groupBy("kind", "pattern").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SALT_ROWS)
    salts = maybe_broadcast(written(crowds.select("kind", "pattern", F.ceil(F.col("n") / SALT_ROWS).alias("salts")), "url-salts"))
    own = listed.join(salts, ["kind", "pattern"], "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("url", "fetched_at"), "salts"), F.lit(0)))
    theirs = spans.join(salts, ["kind", "pattern"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)) - 1)))
    begun = F.struct("valid_from", "valid_to")
    both = own.select(*at, "salt", F.col("fetched_at").alias("time"), F.lit(1).alias("capture"), "url", F.lit(None).cast(spans.select(begun.alias("s")).schema["s"].dataType).alias("span"))
    both = both.unionByName(theirs.select(*at, "salt", F.col("valid_from").alias("time"), F.lit(0).alias("capture"), F.lit(None).cast("string").alias("url"), begun.alias("span")))
    last = F.last("span", ignorenulls=True).over(W.partitionBy(*at, "salt").orderBy("time", "capture"))
    found = both.withColumn("span", last).where("capture = 1 AND span IS NOT NULL AND (span.valid_to IS NULL OR time < span.valid_to)")
    hits = found.groupBy("url", F.col("time").alias("fetched_at")).agg(F.count(F.lit(1)).alias("n_entries"), F.array_join(F.array_sort(F.collect_set("list_name")), ",").alias("lists"))
    out = base.join(hits, ["url", "fetched_at"], "left")
    n = F.coalesce("n_entries", F.lit(0).cast("long"))
    return out.select("url", "fetched_at", "host", n.alias("n_entries"), F.coalesce("lists", F.lit("")).alias("lists"), (n > 0).alias("blocked"))


def judged(captures: DataFrame, entries: DataFrame, url: str = "url", fetched_at: str = "fetched_at") -> DataFrame:
    """``captures`` with the columns of ``url_filter`` in a struct ``verdict``: one row for each capture.

    A column of that name in ``captures`` stays: the struct then is the first of ``verdict_2``, ``verdict_3``, ... that is free.
    """
    found = url_filter(captures, entries, url, fetched_at)
    names, taken = captures.columns, {c.lower() for c in captures.columns}
    name = next(n for n in ("verdict", *(f"verdict_{k}" for k in range(2, len(taken) + 3))) if n not in taken)
    rows = captures.toDF(*[f"c{i}" for i in range(len(names))])
    same = rows[f"c{names.index(url)}"].eqNullSafe(found["url"]) & rows[f"c{names.index(fetched_at)}"].eqNullSafe(found["fetched_at"])
    own = [rows[f"c{i}"].alias(n) for i, n in enumerate(names)]
    return rows.join(found, same, "left").select(*own, F.struct(*[found[c] for c in ("host", "n_entries", "lists", "blocked")]).alias(name))


# The registered query: captures are the rows of ``pages``, fetched at times made from page_id; the list log is
# made from the hosts themselves, so that hosts are listed, delisted and listed again at dates spread over a year.


def dated_captures(pages: DataFrame) -> DataFrame:
    at = F.lit(1_704_067_200) + (F.col("page_id") * 7919 % 365) * 86_400 + F.col("page_id") * 104_729 % 86_400
    return pages.select("page_id", "url", F.timestamp_seconds(at).alias("fetched_at"))


def list_log(pages: DataFrame) -> DataFrame:
    host = host_of(F.col("url"))
    hosts = pages.select(host.alias("host"), F.regexp_extract(path_of(F.col("url")), "^/([^/]+)", 1).alias("step")).where("host != ''")
    code = F.conv(F.substring(F.md5("host"), 1, 7), 16, 10).cast("long")
    hosts = hosts.groupBy("host").agg(F.min("step").alias("step")).withColumn("code", code).withColumn("k", F.col("code") % 10)
    start = F.expr("code div 10 % 200")
    kind = F.when(F.col("k") == 3, "domain").when(F.col("k") == 4, "url").otherwise("host")
    pattern = F.when(F.col("k") == 3, F.regexp_extract("host", r"([^.]+\.[^.]+\.[^.]+)$", 1)).when(F.col("k") == 4, F.concat_ws("/", "host", "step")).otherwise(F.col("host"))
    change = lambda days, action: F.struct(F.timestamp_seconds(F.lit(1_704_067_200) + (start + days) * 86_400).alias("listed_at"), F.lit(action).alias("action"))
    changes = F.when(F.col("k") == 0, F.array(change(0, "add"), change(60, "remove"), change(120, "add"))).when(F.col("k") == 1, F.array(change(0, "add"), change(90, "remove"))).otherwise(F.array(change(0, "add")))
    rows = hosts.where("k <= 4").select(F.concat(kind, F.lit("s")).alias("list_name"), kind.alias("kind"), pattern.alias("pattern"), F.explode(changes).alias("c"))
    return rows.select("list_name", "kind", "pattern", "c.listed_at", "c.action")


ORACLE = r"""
WITH p AS (
  SELECT page_id, url, rtrim(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]+)', 1)), '.') AS host,
         regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path,
         make_timestamp((1704067200 + (page_id * 7919 % 365) * 86400 + page_id * 104729 % 86400) * 1000000) AS fetched_at
  FROM pages
), h AS (
  SELECT host, min(regexp_extract(path, '^/([^/]+)', 1)) AS step, ('0x' || substr(md5(host), 1, 7))::bigint AS code FROM p WHERE host != '' GROUP BY host
), e AS (
  SELECT *, code % 10 AS k, (code // 10) % 200 AS start_day FROM h
), f AS (
  SELECT CASE k WHEN 3 THEN 'domain' WHEN 4 THEN 'url' ELSE 'host' END AS kind,
         CASE k WHEN 3 THEN regexp_extract(host, '([^.]+\.[^.]+\.[^.]+)$', 1) WHEN 4 THEN host || '/' || step ELSE host END AS pattern, k, start_day
  FROM e WHERE k <= 4
), g AS (
  SELECT kind, pattern, start_day + d AS day, action FROM f, (VALUES (0, 'add'), (60, 'remove'), (90, 'remove'), (120, 'add')) v(d, action)
  WHERE d = 0 OR (k = 0 AND d IN (60, 120)) OR (k = 1 AND d = 90)
), i AS (
  SELECT kind, pattern, make_timestamp((1704067200 + day * 86400) * 1000000) AS listed_at, max(action) AS action FROM g GROUP BY ALL
), v AS (
  SELECT * FROM (SELECT *, lead(listed_at) OVER (PARTITION BY kind, pattern ORDER BY listed_at) AS valid_to FROM i) WHERE action = 'add'
), hit AS (
  SELECT c.page_id, count(*) AS n, string_agg(DISTINCT kind || 's', ',' ORDER BY kind || 's') AS lists
  FROM p c JOIN v ON c.fetched_at >= v.listed_at AND (v.valid_to IS NULL OR c.fetched_at < v.valid_to) AND c.host != ''
   AND ((kind = 'host' AND host = pattern) OR (kind = 'domain' AND ends_with('.' || host, '.' || pattern)) OR (kind = 'url' AND starts_with(host || path || '/', pattern || '/')))
  GROUP BY c.page_id
)
SELECT p.page_id, p.url, p.fetched_at, p.host, coalesce(n, 0)::bigint AS n_entries, coalesce(lists, '') AS lists, coalesce(n, 0) > 0 AS blocked
FROM p LEFT JOIN hit USING (page_id)
"""
