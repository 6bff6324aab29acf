"""Temporal list join: every capture against the list entries that were active when it was fetched.

A list is a table of dated entries (key, list, at, active): from ``at`` on, the key (a host, a parent domain or
host/path) is listed or no longer listed.  Entries of a key and list become validity intervals that don't overlap
([at, next at), for those that list); intervals and captures are cut by month, so the as-of join is an equi-join on
(key, month) in which a capture meets the intervals of one month alone, with the two dates as further condition.
Keys that no list has go before that join (a bare top-level domain, say, is a key of a third of all captures), and a
(key, month) of more than ``HOT`` captures is dealt to several tasks, each with a copy of the key's few intervals; nothing is
gathered by host.

Entries of one key, list and date: listed wins.  Entries or captures without key, URL or date match nothing; such
captures are returned as not blocked.  A URL's host is taken in lower case without user and port; its path without
query and fragment.  Repeated captures are returned as often as they came.  An empty list blocks nothing; an empty
table gives no rows.  Results carry the columns of captures and three that are named by the caller's ``prefix``.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from skyloom.sources.staging import written

#: Captures of one key and month that meet their intervals in one task, at most.
HOT = 1 << 20
#: Most keys of the lists that are broadcast.
KEYS = 1 << 18
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"
PATH = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, HOST, 1))


def keys_of(url: Column) -> Column:
    """host, each parent domain, and host/path."""
    labels = F.split(host_of(url), r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.array_distinct(F.array_append(parents, F.concat(host_of(url), F.regexp_extract(url, PATH, 1))))


def validity(entries: DataFrame) -> DataFrame:
    """key, list, since, until (null: still active)."""
    dated = entries.filter("key IS NOT NULL AND list IS NOT NULL AND at IS NOT NULL").groupBy("key", "list", F.col("at").cast("timestamp").alias("since")).agg(F.max("active").alias("active"))
    until = F.lead("since").over(Window.partitionBy("key", "list").orderBy("since"))
    return dated.withColumn("until", until).filter("active").drop("active")


def _month(at: Column) -> Column:
    return F.year(at) * 12 + F.month(at)


def listed_at_fetch(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched", prefix: str = "") -> DataFrame:
    """``captures`` with blocked, lists (the names, sorted, joined by commas) and matched (the longest key)."""
    once = captures.select(F.col(url).alias("u"), F.col(fetched).cast("timestamp").alias("f")).filter("u IS NOT NULL AND f IS NOT NULL").distinct()
    first, last = once.agg(F.min(_month(F.col("f"))), F.max(_month(F.col("f")))).first()
    spans = validity(entries).withColumn("month", F.explode(F.filter(F.sequence(F.greatest(_month(F.col("since")), F.lit(first or 0)), F.greatest(_month(F.col("since")), F.coalesce(_month(F.col("until")), F.lit(last or 0)), F.lit(first or 0))), lambda m: m <= (last or 0))))
    seen = once.select("u", "f", F.explode(keys_of(F.col("u"))).alias("key"), _month(F.col("f")).alias("month"))
    listed = written(spans.select("key").distinct(), "keys")
    seen = written(seen.join(F.broadcast(listed) if listed.count() <= KEYS else listed, "key", "left_semi"), "captures")
    hot = seen.groupBy("key", "month").agg(F.ceil(F.count(F.lit(1)) / HOT).cast("int").alias("parts")).filter("parts > 1")
    hot = F.broadcast(written(hot, "hot"))  # a row for each HOT rows of captures at most
    parts = F.coalesce("parts", F.lit(1))
    seen = seen.join(hot, ["key", "month"], "left").withColumn("part", F.pmod(F.xxhash64("u", "f"), parts))
    spans = spans.join(hot, ["key", "month"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    met = seen.drop("parts").join(spans.drop("parts"), ["key", "month", "part"]).filter((F.col("since") <= F.col("f")) & (F.col("until").isNull() | (F.col("f") < F.col("until"))))
    told = met.groupBy("u", "f").agg(F.array_join(F.sort_array(F.collect_set("list")), ",").alias(f"{prefix}lists"), F.max(F.struct(F.length("key").alias("n"), "key"))["key"].alias(f"{prefix}matched"))
    rows = captures.select(F.struct("*").alias("_row"), F.col(url).alias("_u"), F.col(fetched).cast("timestamp").alias("_f"))
    lists = F.col(f"{prefix}lists")
    rows = rows.join(told, (F.col("_u") == F.col("u")) & (F.col("_f") == F.col("f")), "left")
    rows = rows.select("_row", lists.isNotNull().alias(f"{prefix}blocked"), F.coalesce(lists, F.lit("")).alias(f"{prefix}lists"), f"{prefix}matched")
    return rows.select("_row.*", f"{prefix}blocked", f"{prefix}lists", f"{prefix}matched")
