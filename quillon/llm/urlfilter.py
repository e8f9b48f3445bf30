"""URL filters by dated lists: entries become validity intervals, captures look up those active when fetched."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import unused

#: Captures of a host that one task takes, or a ten-thousandth of all if that is more: at most 10,000 hosts are split.
PER_TASK = 1_000


def host_of(url: F.Column) -> F.Column:
    """Host of a URL in lower case, without user, port, `www.` and a last dot; null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"\.$", ""), r"^www\.", "")
    return F.when(host != "", host)


def intervals(entries: DataFrame) -> DataFrame:
    """(domain, valid_from, valid_to) from dated entries (domain, day date, listed boolean).

    An entry holds until the next one of its domain; valid_to is exclusive, null while it still holds. Of entries
    of one domain and day a removal wins. Entries that say what already holds change nothing; an entry with a null
    in any column is left out, as is a domain that is only removed.
    """
    day = entries.where("domain is not null and day is not null and listed is not null").groupBy(F.lower("domain").alias("domain"), "day").agg(F.min("listed").alias("listed"))
    order = Window.partitionBy("domain").orderBy("day")
    change = day.withColumn("before", F.coalesce(F.lag("listed").over(order), F.lit(False))).where("listed <> before")
    return change.withColumn("valid_to", F.lead("day").over(order)).where("listed").select("domain", F.col("day").alias("valid_from"), "valid_to")


def flag(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """captures with host, is_listed, matched_domain, listed_from, listed_to.

    A capture is listed if an interval of its host, or of a domain above it, holds on the day it was fetched; the
    longest such domain is named. URLs without a host (null, empty, odd) and captures with a null day are not
    listed. All rows stay, repeated ones too; columns of captures with one of the new names are replaced.

    Intervals of a host are one row: whatever its traffic, each capture meets one row. The captures of a busy host are
    dealt to as many tasks as its traffic calls for, each with a copy of that row.
    """
    new = ("host", "is_listed", "matched_domain", "listed_from", "listed_to")
    kept = [c for c in captures.columns if c.lower() not in new]
    host, salt, hit = (unused(captures, c) for c in ("_host", "_salt", "_hit"))
    held = captures.withColumn(host, host_of(F.col(f"`{url}`"))).withColumn(hit, F.to_date(F.col(f"`{fetched}`")))
    hosts = held.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("name")).count()
    labels = F.split("name", r"\.")
    above = hosts.select("name", "count", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("domain"))
    spans = F.struct((-F.length("domain")).alias("rank"), "domain", "valid_from", "valid_to")
    least = max(PER_TASK, held.count() // 10_000)
    busy = hosts.where(F.col("count") > least).select(F.col("name").alias("busy"), F.ceil(F.col("count") / least).cast("int").alias("parts"))
    known = above.join(intervals(entries), "domain").groupBy("name", "count").agg(F.sort_array(F.collect_list(spans)).alias("spans"))
    copies = known.withColumn("copy", F.explode(F.sequence(F.lit(0), F.when(F.col("count") > least, F.ceil(F.col("count") / least).cast("int") - 1).otherwise(F.lit(0))))).select(F.struct("name", "copy", "spans").alias(salt))
    # the captures' columns stay apart in a struct of their own, so none can clash
    rows = held.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(host).alias("at"), F.col(hit).alias("day"))
    rows = rows.join(F.broadcast(busy), F.col("at") == F.col("busy"), "left").withColumn("part", F.pmod(F.monotonically_increasing_id(), F.coalesce("parts", F.lit(1))).cast("int"))
    found = rows.join(copies, (F.col("at") == F.col(f"{salt}.name")) & (F.col("part") == F.col(f"{salt}.copy")), "left")
    first = F.try_element_at(F.filter(F.col(f"{salt}.spans"), lambda x: (x["valid_from"] <= F.col("day")) & (x["valid_to"].isNull() | (F.col("day") < x["valid_to"]))), F.lit(1))
    out = found.withColumn("hit", F.when(F.size(f"{salt}.spans") > 0, first))
    fields = [F.col("row")[c].alias(c) for c in kept]
    return out.select(*fields, F.col("at").alias("host"), F.col("hit").isNotNull().alias("is_listed"), F.col("hit.domain").alias("matched_domain"), F.col("hit.valid_from").alias("listed_from"), F.col("hit.valid_to").alias("listed_to"))
