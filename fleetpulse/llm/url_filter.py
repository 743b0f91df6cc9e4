"""URL filters over dated lists: entries become validity intervals, and captures meet the entry active when they were fetched.

A capture's verdict depends on its host and day alone, so hosts and days are made distinct before the join; a host with a
third of all captures has no more of those rows than there are days. Column expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetpulse.llm.tables import fresh

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def host_of(url: Column) -> Column:
    """Lower-case host of a URL; empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def domains_of(host: Column) -> Column:
    """The host and its parent domains of two labels or more, longest first."""
    labels = F.split(host, r"\.")
    at = F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1)))
    return F.transform(at, lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def validity(entries: DataFrame) -> DataFrame:
    """(domain, action, valid_from, valid_to): an entry holds until the next one of its domain, the last one for good.

    Of several entries of a domain and day, block wins. Entries without domain, day or a known action are left out.
    """
    known = entries.where("domain IS NOT NULL AND listed_on IS NOT NULL AND action IN ('allow', 'block')")
    daily = known.groupBy(F.lower("domain").alias("domain"), "listed_on").agg(F.max("action").alias("action"))
    following = F.lead("listed_on").over(Window.partitionBy("domain").orderBy("listed_on"))
    return daily.select("domain", "action", F.col("listed_on").alias("valid_from"), following.alias("valid_to"))


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Adds host, domain, listed_on and blocked to every row of `captures` (url, fetched_on, any others).

    The entry of the longest matching domain that is active on the day of the fetch decides; without one, domain and
    listed_on are null and blocked is false, as for null or hostless URLs and null days. `entries` has domain, listed_on and
    action (allow, block). Repeated rows stay; columns with the name of an added one are replaced.
    """
    captures = captures.drop("host", "domain", "listed_on", "blocked").withColumn("host", host_of(F.col("url")))
    on_host, on_day = fresh(captures, "on_host", "on_day")
    keys = captures.select(F.col("host").alias("on_host"), F.col("fetched_on").alias("on_day")).where("on_day IS NOT NULL").distinct()
    asked = keys.select("on_host", "on_day", F.explode(domains_of(F.col("on_host"))).alias("asked"))
    # What holds on a day is settled for each domain and day once, however many hosts lie below the domain.
    held = validity(entries)
    active = (F.col("asked") == F.col("domain")) & (F.col("valid_from") <= F.col("on_day"))
    active &= F.col("valid_to").isNull() | (F.col("on_day") < F.col("valid_to"))
    on = asked.select("asked", "on_day").distinct().join(held, active).select("asked", "on_day", "domain", "action", "valid_from")
    best = F.max(F.struct(F.length("domain").alias("size"), "domain", F.col("valid_from").alias("listed_on"), "action"))
    verdicts = asked.join(on, ["asked", "on_day"]).groupBy("on_host", "on_day").agg(best.alias("best"))
    verdicts = verdicts.select("on_host", "on_day", "best.domain", "best.listed_on", (F.col("best.action") == "block").alias("blocked"))
    verdicts = verdicts.withColumnsRenamed({"on_host": on_host, "on_day": on_day})
    joined = captures.join(verdicts, (F.col("host") == F.col(on_host)) & (F.col("fetched_on") == F.col(on_day)), "left")
    return joined.drop(on_host, on_day).withColumn("blocked", F.coalesce("blocked", F.lit(False)))
