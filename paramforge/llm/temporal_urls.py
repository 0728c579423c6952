"""URL filter with dated lists (DataFrame functions only).

List entries carry a date and an action. The actions of one entry become
validity intervals (an ``add`` holds until the next action of the same list
and key), and every capture is judged by the entries active when it was
fetched: an as-of join, written as an equi-join on the key with the fetch
time inside the interval, so a frequent host is one hash key that Spark may
split, and no entry list is sorted per capture.

Keys: a ``domain`` entry covers the host and its subdomains; a ``prefix``
entry (host/path) covers the paths below it, at ``/`` boundaries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def host(url: Column) -> Column:
    """Lower-case host; empty for a null text or one that is no URL."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+([^?#]*)", 1)


def intervals(entries: DataFrame) -> DataFrame:
    """(list, kind, key, since, until) from (list, kind, key, action, at).

    ``until`` is null while the entry holds. Of actions at one time, a
    removal wins. Entries without a key or time are ignored.
    """
    one = entries.where("key is not null and at is not null").groupBy("list", "kind", "key", "at").agg(F.max(F.col("action") == "remove").alias("removed"))
    nxt = F.lead("at").over(W.partitionBy("list", "kind", "key").orderBy("at"))
    return one.select("list", "kind", "key", F.col("at").alias("since"), nxt.alias("until"), "removed").where("not removed").drop("removed")


def lookup_keys(url: str) -> Column:
    """Structs (kind, key): all domains above the host, all prefixes of the path."""
    labels = F.split(host(F.col(url)), r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.lit("domain").alias("kind"), F.concat_ws(".", F.slice(labels, i, F.size(labels))).alias("key")))
    steps = F.filter(F.split(path(F.col(url)), "/"), lambda s: s != "")
    prefixes = F.transform(
        F.when(F.size(steps) > 0, F.sequence(F.lit(1), F.size(steps))).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat(host(F.col(url)), F.lit("/"), F.concat_ws("/", F.slice(steps, F.lit(1), i))).alias("key")),
    )
    return F.when(host(F.col(url)) != "", F.concat(domains, prefixes))


def judge(captures: DataFrame, entries: DataFrame, url: str = "url", at: str = "at", ident: str = "page_id") -> DataFrame:
    """``ident``, ``at``, blocked, lists, n_active for every row of ``captures``.

    ``lists``: sorted names of the lists with an active entry, joined by a
    comma. A null URL, one without a host, or a capture without a time is
    never blocked. Repeated rows repeat their result.
    """
    rows = captures.select(F.col(f"`{ident}`").alias("ident"), F.col(f"`{url}`").alias("url"), F.col(f"`{at}`").alias("at"))
    asked = rows.where("url is not null and at is not null").select("url", "at").distinct()
    keys = asked.select("url", "at", F.explode(F.array_distinct(lookup_keys("url"))).alias("k")).select("url", "at", "k.*")
    active = keys.join(intervals(entries), ["kind", "key"]).where("at >= since and (until is null or at < until)")
    found = active.groupBy("url", "at").agg(F.array_join(F.sort_array(F.collect_set("list")), ",").alias("lists"), F.count(F.lit(1)).alias("n_active"))
    out = rows.join(found, ["url", "at"], "left")
    return out.select(F.col("ident").alias(ident), "at", F.col("lists").isNotNull().alias("blocked"), F.coalesce("lists", F.lit("")).alias("lists"), F.coalesce("n_active", F.lit(0)).alias("n_active"))
