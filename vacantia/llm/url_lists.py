"""URL filter: captures against dated list entries as they stood at fetch time, in DataFrame operations only.

List events (a host is added or removed at some time) become validity intervals.  Each capture asks for its host and
every parent domain; an equality join on host and epoch followed by the interval test finds what was active.  Epochs
bound the intervals that a capture meets: only those of its host that touch its epoch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPOCH_DAYS = 30
SALT = 16


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and final dot; null for what is no absolute URL."""
    name = F.regexp_extract(F.lower(url), r"^\s*[a-z][a-z0-9+.-]*://([^/?#\\]*@)?([^/?#\\:@]*)", 2)
    name = F.regexp_replace(name, r"\.+$", "")
    return F.when(name != "", name)


def host_and_parents(host: Column) -> Column:
    """The host and its parent domains of two labels or more (a host of one label: itself)."""
    labels = F.split(host, r"\.")
    count = F.size(labels)
    return F.transform(F.sequence(F.lit(1), F.greatest(count - 1, F.lit(1))),
                       lambda i: F.array_join(F.slice(labels, i, count), "."))


def validity_intervals(events: DataFrame) -> DataFrame:
    """list_name, host, valid_from, valid_to of the times between an addition and the next event of that entry.

    `events`: list_name, host, at, added (boolean).  Of several events at one time the removal counts.  An addition
    without later event stays valid for ever (valid_to null).  Events with a null in host, time or kind are left out;
    a null list name is a list of its own.
    """
    clean = (events.where(F.col("host").isNotNull() & F.col("at").isNotNull() & F.col("added").isNotNull())
             .groupBy("list_name", F.lower("host").alias("host"), "at").agg(F.min("added").alias("added")))
    entry = Window.partitionBy("list_name", "host").orderBy("at")
    return (clean.withColumn("valid_to", F.lead("at").over(entry)).where("added")
            .select("list_name", "host", F.col("at").alias("valid_from"), "valid_to"))


def _epoch(at: Column) -> Column:
    return F.floor(F.unix_seconds(at) / F.lit(EPOCH_DAYS * 86400)).cast("long")


def evaluate_captures(captures: DataFrame, events: DataFrame, *, key: str = "page_id", url: str = "url",
                      fetched: str = "fetched_at") -> DataFrame:
    """One row per distinct (key, url, fetch time): host, copies (input rows), n_lists, lists, blocked.

    `lists` are the names of the lists with an active entry for the host or a parent, in order, joined by commas (a null
    name is written as an empty name).  A URL without host and a null fetch time are never blocked.  Intervals are
    closed at the start and open at the end.  An open-ended entry is carried through the captures' last epoch.  A host with a third of all
    captures is split by salt; the entries, one list's size, are repeated for it.
    """
    asked = (captures.select(F.col(key).alias("_key"), F.col(url).alias("_url"), F.col(fetched).alias("_at"))
             .groupBy("_key", "_url", "_at").agg(F.count(F.lit(1)).alias("copies"))
             .withColumn("_host", host_of(F.col("_url"))))
    span = captures.agg(F.min(_epoch(F.col(fetched))).alias("low"), F.max(_epoch(F.col(fetched))).alias("high"))
    # The bounds of the captures' time, one row, keep an entry from being repeated for epochs that no capture has.
    spans = validity_intervals(events).crossJoin(F.broadcast(span))
    low = F.greatest(_epoch(F.col("valid_from")), F.col("low"))
    high = F.least(F.coalesce(_epoch(F.col("valid_to")), F.col("high")), F.col("high"))
    active = (spans.withColumn("_low", low).withColumn("_high", high).where(F.col("_low") <= F.col("_high"))
              .withColumn("_epoch", F.explode(F.sequence("_low", "_high")))
              .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
              .select(F.col("host").alias("_name"), "_epoch", "_salt", "list_name", "valid_from", "valid_to"))
    probes = (asked.withColumn("_name", F.explode_outer(host_and_parents(F.col("_host"))))
              .withColumn("_epoch", _epoch(F.col("_at")))
              .withColumn("_salt", F.pmod(F.xxhash64("_key", "_at"), F.lit(SALT)).cast("int")))
    inside = (F.col("valid_from") <= F.col("_at")) & (F.col("valid_to").isNull() | (F.col("_at") < F.col("valid_to")))
    met = (probes.join(active, ["_name", "_epoch", "_salt"], "left")
           .withColumn("_list", F.when(inside, F.coalesce("list_name", F.lit("")))))
    names = F.array_sort(F.collect_set("_list"))  # at most one per list
    return (met.groupBy("_key", "_url", "_at", "_host", "copies").agg(names.alias("_lists"))
            .select(F.col("_key").alias(key), F.col("_url").alias(url), F.col("_at").alias(fetched),
                    F.col("_host").alias("host"), "copies", F.size("_lists").cast("long").alias("n_lists"),
                    F.array_join("_lists", ",").alias("lists"), (F.size("_lists") > 0).alias("blocked")))


LIST_NAMES = ("malware", "adult", "spam")
START = "2024-01-01 00:00:00"


def dated_captures(pages: DataFrame) -> DataFrame:
    """Pages with a fetch time spread over a year by their id (the tables have none)."""
    at = F.expr(f"timestamp_seconds(unix_seconds(timestamp '{START}') + pmod(page_id * 7919, 31536000))")
    return pages.select("page_id", "url", at.alias("fetched_at"))


def events_from_pages(pages: DataFrame) -> DataFrame:
    """List events derived from the pages: each host and its parent are added and removed at times set by page ids.

    The lowest page id of a name and the number of its pages set list, phase and period, so the events grow with the
    hosts.
    """
    named = pages.select(F.explode(host_and_parents(host_of(F.col("url")))).alias("host"), "page_id")
    hosts = named.groupBy("host").agg(F.min("page_id").alias("low"), F.count(F.lit(1)).alias("n"))
    step = F.explode(F.sequence(F.lit(0), F.lit(4)))
    each = hosts.where("low % 3 <> 0").withColumn("step", step)
    name = F.element_at(F.array(*map(F.lit, LIST_NAMES)), (F.pmod(F.col("low"), F.lit(3)) + 1).cast("int"))
    at = F.expr(f"timestamp_seconds(unix_seconds(timestamp '{START}') + pmod(low * 104729, 2592000)"
                " + step * (864000 + pmod(n * 86400, 5184000)))")
    return each.select(name.alias("list_name"), "host", at.alias("at"), (F.col("step") % 2 == 0).alias("added"))
