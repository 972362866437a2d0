"""URL filters with dated lists: each capture is held against the entries active when it was fetched.

Dated entries (add or remove a pattern) become validity intervals: an add
opens one that the pattern's next entry closes. A capture's URL gives its
candidate patterns, the suffixes of its host and the prefixes of its path. An
equi-join on the pattern with an as-of condition on time finds the active
ones. One host may have most captures, so a pattern that more captures ask for
than a task's even share gets as many salts as it has shares: its captures take
one of them, and its intervals, of which there are few, take all. Such patterns
are at most as many as a capture's patterns times the tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
PATH = r"^[a-z][a-z0-9+.-]*://[^/?#]*(/[^?#]*)"


def host_of(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), HOST, 1)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), PATH, 1)


def patterns_of(url: Column, depth: int = 2) -> Column:
    """Host suffixes of two labels or more, and host plus up to ``depth`` leading path segments."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    suffixes = F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(labels, i, n), "."))).otherwise(F.array(host))
    segments = F.filter(F.split(path_of(url), "/"), lambda s: s != "")
    prefixes = F.transform(F.sequence(F.lit(0), F.least(F.size(segments), F.lit(depth))), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(segments, 1, i), "/")))
    return F.when(host != "", F.array_distinct(F.concat(suffixes, F.slice(prefixes, 2, depth)))).otherwise(F.array().cast("array<string>"))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, pattern, since, until): [since, until) of each add; until is null while open.

    ``entries``: list, pattern, listed_at, action ('add' or 'remove'). Of
    entries of one pattern at one time a removal wins. Rows with a null list,
    pattern, time or action count for nothing.
    """
    known = entries.dropna(subset=["list", "pattern", "listed_at", "action"])
    one = known.groupBy("list", "pattern", "listed_at").agg(F.max("action").alias("action"))
    w = Window.partitionBy("list", "pattern").orderBy("listed_at")
    dated = one.withColumn("until", F.lead("listed_at").over(w))
    return dated.filter("action = 'add'").select("list", "pattern", F.col("listed_at").alias("since"), "until")


def hot_patterns(asked: DataFrame, tasks: int) -> DataFrame:
    """(hot, salts): the patterns that more rows ask for than one of ``tasks`` even shares, and how many shares they have."""
    counts = asked.groupBy("asked").agg(F.count("*").alias("n"))
    rows = asked.select("capture", "h").agg(F.count("*").alias("rows"))
    shares = F.ceil(F.col("n") * tasks / F.col("rows")).cast("int")
    return counts.join(F.broadcast(rows)).select(F.col("asked").alias("hot"), shares.alias("salts")).filter("salts > 1")


def active_entries(captures: DataFrame, entries: DataFrame, key: str = "page_id", url: str = "url", fetched: str = "fetched_at") -> DataFrame:
    """(key, list, pattern) of each capture's entries active at its fetch."""
    asked = captures.select(F.col(key).alias("capture"), F.col(fetched).alias("at"), F.xxhash64(key, url, fetched).alias("h"), F.explode(patterns_of(F.col(url))).alias("asked"))
    hot = F.broadcast(hot_patterns(asked, int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    salts = F.coalesce("salts", F.lit(1))
    asked = asked.join(hot, F.col("asked") == F.col("hot"), "left").withColumn("salt", F.pmod("h", salts).cast("int"))
    valid = intervals(entries).join(hot, F.col("pattern") == F.col("hot"), "left").withColumn("of_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    met = (F.col("asked") == F.col("pattern")) & (F.col("salt") == F.col("of_salt")) & (F.col("at") >= F.col("since")) & (F.col("until").isNull() | (F.col("at") < F.col("until")))
    return asked.join(valid, met).select(F.col("capture").alias(key), "list", "pattern")


def judge(captures: DataFrame, entries: DataFrame, key: str = "page_id", url: str = "url", fetched: str = "fetched_at") -> DataFrame:
    """One row a capture: key, n_active, lists (sorted, comma-joined), blocked.

    A null or unparsable URL and a null fetch time match nothing. Rows that
    repeat a key share one verdict over all of them; a null key's rows do too.
    Extra columns are ignored; an empty table gives no rows.
    """
    hits = active_entries(captures, entries, key, url, fetched)
    # partial sums before the shuffle keep a hot host's captures apart
    told = hits.groupBy(key).agg(F.count_distinct("list", "pattern").alias("n_active"), F.array_join(F.sort_array(F.collect_set("list")), ",").alias("lists"))
    told = told.select(F.col(key).alias("hit_key"), "n_active", "lists")
    rows = captures.select(key)
    joined = rows.join(told, F.col(key).eqNullSafe(F.col("hit_key")), "left")
    n = F.coalesce("n_active", F.lit(0))
    return joined.select(key, n.alias("n_active"), F.coalesce("lists", F.lit("")).alias("lists"), (n > 0).alias("blocked"))
