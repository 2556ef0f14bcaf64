"""URL filters by a temporal list join.

Dated list entries ("this pattern was added", "it was removed") become validity
intervals.  Every capture is then judged as of its fetch time: the patterns
that can match its URL are joined by equality, and an entry counts if its
interval holds the fetch time.

A pattern is a host with all its subdomains (``host``), a host with the first
segments of a path (``prefix``: that path and everything below it) or a word in
the path (``word``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

ENTRY_SCHEMA = "kind string, pattern string, category string, day date, active boolean"
RESULTS = {"host", "fetched", "n_hits", "categories", "blocked"}

#: The list that the query uses.
ENTRIES = (
    ("host", "spam-farm.example.org", "spam", "2024-01-01", True),
    ("host", "blog.tiontion.example.com", "blog", "2024-02-01", True),
    ("host", "blog.tiontion.example.com", "blog", "2024-08-01", False),
    ("host", "example.net", "network", "2024-03-01", True),
    ("host", "example.net", "network", "2024-05-01", False),
    ("host", "example.net", "network", "2024-10-01", True),
    ("prefix", "therin.example.net/en", "section", "2024-01-15", True),
    ("prefix", "ththin.example.com/en", "section", "2024-06-15", True),
    ("prefix", "ththin.example.com/en", "section", "2024-09-15", False),
    ("word", "casino", "gambling", "2024-01-01", True),
    ("word", "login", "account", "2024-04-01", True),
    ("word", "fr", "language", "2024-07-01", True),
    ("word", "fr", "language", "2024-07-21", False),
)


def entries(spark: SparkSession, rows=ENTRIES) -> DataFrame:
    """A list as a table: kind, pattern, category, day, active."""
    return spark.createDataFrame(list(rows), "kind string, pattern string, category string, day string, active boolean").withColumn("day", F.to_date("day"))


def intervals(listed: DataFrame) -> DataFrame:
    """(kind, pattern, spans) from dated entries; spans: array<struct<from, until, category>>, until null if still active.

    Of entries of one day and pattern the removing one counts last; adding what
    is active already changes nothing.  Entries without a pattern or a day are
    left out; slashes at a pattern's end don't count.
    """
    known = listed.where("kind is not null and pattern is not null and day is not null and active is not null")
    steps = known.groupBy("kind", F.rtrim(F.lower("pattern"), F.lit("/")).alias("pattern"), "category", "day").agg(F.min("active").alias("active"))
    ordered = F.array_sort(F.collect_list(F.struct("day", "active")))
    runs = steps.groupBy("kind", "pattern", "category").agg(ordered.alias("s"))
    # each adding entry lasts until the next removing one
    removed = F.filter(F.col("s"), lambda e: ~e["active"])
    started = F.filter(F.transform(F.col("s"), lambda e, i: F.struct(e["day"].alias("day"), (e["active"] & ((i == 0) | ~F.try_element_at(F.col("s"), F.greatest(i, F.lit(1)))["active"])).alias("first"))), lambda e: e["first"])
    spans = F.transform(started, lambda e: F.struct(e["day"].alias("from"), F.array_min(F.transform(F.filter(removed, lambda r: r["day"] > e["day"]), lambda r: r["day"])).alias("until"), F.col("category").alias("category")))
    return runs.select("kind", "pattern", spans.alias("spans")).groupBy("kind", "pattern").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def host_of(url: Column) -> Column:
    """The lower-case host without user, port or final dot; empty if the URL has none."""
    found = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.regexp_replace(found, r"\.$", "")


def path_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1))


def _depths(listed: DataFrame) -> tuple[int, int]:
    """Labels of the longest host pattern and path segments of the longest prefix: what a URL has beyond can't be matched."""
    pattern = F.rtrim("pattern", F.lit("/"))
    found = listed.agg(
        F.max(F.when(F.col("kind") == "host", F.size(F.split(pattern, r"\.")))).alias("labels"),
        F.max(F.when(F.col("kind") == "prefix", F.size(F.split(pattern, "/")) - 1)).alias("segments"),
    ).first()
    return found.labels or 0, -1 if found.segments is None else found.segments


def _keys(host: Column, path: Column, labels: int, segments: int) -> Column:
    """array<struct<kind, pattern>> of all patterns that can match."""
    none = F.array().cast("array<string>")
    parts = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))), lambda n: F.array_join(F.slice(parts, -n, n), ".")) if labels else none
    words = F.array_distinct(F.filter(F.split(path, r"[^a-z0-9]+"), lambda w: w != ""))
    steps = F.split(path, "/")  # what stands before the first slash is empty
    below = F.sequence(F.lit(0), F.least(F.size(steps) - 1, F.lit(max(segments, 0))))
    prefixes = F.transform(F.filter(below, lambda n: (n == 0) | (F.get(steps, n) != "")), lambda n: F.concat(host, F.array_join(F.slice(steps, 1, n + 1), "/"))) if segments >= 0 else none
    pairs = lambda kind, values: F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("pattern")))
    with_host = lambda values: F.when(host != "", values).otherwise(none)
    return F.concat(pairs("host", with_host(suffixes)), pairs("prefix", with_host(prefixes)), pairs("word", words))


def filter_captures(captures: DataFrame, listed: DataFrame, url_col: str = "url", fetched: Column | None = None) -> DataFrame:
    """All columns of ``captures`` plus host, fetched, n_hits, categories and blocked.

    n_hits counts the list entries active at the fetch day that match; blocked
    says that there is one; categories are theirs, distinct and sorted, joined
    by commas.  A capture whose URL has no host matches no host entry and no
    prefix (words of its path still count); one whose URL or day is null
    matches none at all.  Equal rows are judged each; an empty table or list
    gives rows without hits.  Columns of the input that bear a result's name
    are replaced.

    Captures with the same URL and day are judged once; the join is by equality
    on the pattern, one row a pattern on the list's side, so a frequent host is
    split by the skew join.
    """
    kept = [c for c in captures.columns if c.lower() not in RESULTS and not c.startswith("__")]
    day = fetched if fetched is not None else F.col("fetched")
    rows = captures.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{url_col}`").alias("__url"), day.cast("date").alias("__day"))
    asked = rows.where("__url is not null and __day is not null").select(F.col("__url").alias("url"), F.col("__day").alias("day")).distinct()
    keys = asked.select("url", "day", F.explode(_keys(host_of(F.col("url")), path_of(F.col("url")), *_depths(listed))).alias("k")).select("url", "day", "k.kind", "k.pattern")
    valid = intervals(listed).select(F.col("kind").alias("__kind"), F.col("pattern").alias("__pattern"), "spans")
    active = lambda s: (s["from"] <= F.col("day")) & (s["until"].isNull() | (F.col("day") < s["until"]))
    hits = keys.join(valid, (F.col("kind") == F.col("__kind")) & (F.col("pattern") == F.col("__pattern"))).select("url", "day", F.filter("spans", active).alias("spans")).where(F.size("spans") > 0)
    judged = hits.groupBy(F.col("url").alias("__u"), F.col("day").alias("__d")).agg(F.sum(F.size("spans")).alias("__hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.transform("spans", lambda s: s["category"]))))).alias("__categories"))
    found = rows.join(judged, (F.col("__url") == F.col("__u")) & (F.col("__day") == F.col("__d")), "left")
    return found.select(
        *[F.col(f"`{c}`") for c in kept], host_of(F.col("__url")).alias("host"), F.col("__day").alias("fetched"), F.coalesce("__hits", F.lit(0)).cast("long").alias("n_hits"),
        F.coalesce(F.array_join("__categories", ","), F.lit("")).alias("categories"), F.col("__hits").isNotNull().alias("blocked"),
    )
