"""URL filters as a temporal list join, in DataFrame operations only.

List entries are dated: a pattern (a host or a parent domain) is put on a list or
taken off it. Per pattern and list they become validity intervals. A capture is
judged by the entries that were active when it was fetched: its host and every
parent domain are looked up as of that time, and the most specific one decides; on
the same pattern ``allow`` goes before ``block``.

Captures are reduced to distinct (host, time) before the lookup, so a host with
many captures is one key per time and its rows meet the answer on (host, time),
not on the host alone; adaptive execution splits what is still large.

Defined results: a NULL URL, or one without a host, has NULL host and is not
blocked; a NULL time has no active entry; entries with a NULL part are ignored;
at one instant a removal goes before an addition; repeated captures give one row
each; an empty list blocks nothing; an empty capture table gives no rows; other
columns of captures are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ADD, REMOVE = "add", "remove"


def host_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    return F.when(host != "", host)


def parents(host: Column) -> Column:
    """The host and its parent domains."""
    labels = F.split(host, r"\.")
    return F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))


def intervals(entries: DataFrame) -> DataFrame:
    """``pattern, list, since, until``: when a pattern was on a list; NULL ``until`` means it still is."""
    whole = entries.select("pattern", "list", "action", "since").dropna()
    # The action in force from an instant on: the last one of that instant, an addition after a removal.
    last = whole.groupBy("pattern", "list", "since").agg((F.max((F.col("action") == ADD).cast("int")) == 1).alias("on"))
    order = Window.partitionBy("pattern", "list").orderBy("since")
    return last.withColumn("until", F.lead("since").over(order)).where("on").drop("on")


def judge(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched_at") -> DataFrame:
    """Captures with ``host``, ``matched_pattern``, ``matched_list`` and ``blocked``."""
    asked = captures.withColumn("host", host_of(F.col(url)))
    keys = asked.select("host", F.col(fetched).alias("__at")).where(F.col("host").isNotNull()).distinct()
    active = intervals(entries)
    open_at = (F.col("since") <= F.col("__at")) & (F.col("until").isNull() | (F.col("__at") < F.col("until")))
    best = F.max(F.struct(F.length("pattern").alias("size"), (F.col("list") == "allow").alias("allow"), "pattern", "list"))
    answers = (
        keys.withColumn("pattern", F.explode(parents(F.col("host"))))
        .join(active, "pattern").where(open_at)
        .groupBy("host", "__at").agg(best.alias("best"))
        .select(
            F.col("host").alias("__host"), "__at", F.col("best.pattern").alias("matched_pattern"),
            F.col("best.list").alias("matched_list"),
        )
    )
    joined = asked.join(answers, (F.col("host") == F.col("__host")) & (F.col(fetched) == F.col("__at")), "left")
    return joined.drop("__host", "__at").withColumn("blocked", F.coalesce(F.col("matched_list") == "block", F.lit(False)))


def entries_of_hosts(pages: DataFrame) -> DataFrame:
    """A dated list made from the hosts of ``pages`` and their parents, by digests of the names.

    Days are counted from the first of the list. Three in four names are listed, some are taken off later and
    some of these put on again; one in four listings is an exception (``allow``).
    """
    digit = lambda k: F.instr(F.lit("0123456789abcdef"), F.substring("digest", k, 1)) - 1
    names = (
        pages.select(host_of(F.col("url")).alias("host")).where(F.col("host").isNotNull()).distinct()
        .select(F.explode(parents(F.col("host"))).alias("pattern")).distinct()
        .withColumn("digest", F.md5(F.encode("pattern", "UTF-8")))
        .where(digit(1) < 12)
    )
    since = digit(2) * 16 + digit(3)
    events = F.array(
        F.struct(F.lit(ADD).alias("action"), since.alias("since"), F.lit(True).alias("used")),
        F.struct(F.lit(REMOVE).alias("action"), (since + 20 + digit(4)).alias("since"), (digit(5) < 10).alias("used")),
        F.struct(F.lit(ADD).alias("action"), (since + 60 + digit(6)).alias("since"), (digit(5) < 5).alias("used")),
    )
    return names.select(
        "pattern", F.when(digit(7) < 4, "allow").otherwise("block").alias("list"), F.explode(events).alias("e")
    ).where("e.used").select("pattern", "list", "e.action", F.col("e.since").cast("long").alias("since"))


SQL = r"""
WITH captures AS (
  SELECT page_id, url, page_id * 7919 % 365 AS fetched_day,
         nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '') AS host
  FROM pages),
hosts AS (SELECT DISTINCT host, string_split(host, '.') AS labels FROM captures WHERE host IS NOT NULL),
suffixes AS (
  SELECT DISTINCT host, array_to_string(labels[k:], '.') AS pattern
  FROM (SELECT host, labels, unnest(range(1, len(labels) + 1)) AS k FROM hosts)),
digits AS (
  SELECT pattern, [instr('0123456789abcdef', substr(md5(pattern), k::INT, 1)) - 1 FOR k IN range(1, 8)] AS d
  FROM (SELECT DISTINCT pattern FROM suffixes)),
listed AS (
  SELECT pattern, CASE WHEN d[7] < 4 THEN 'allow' ELSE 'block' END AS list, d, d[2] * 16 + d[3] AS first_day
  FROM digits WHERE d[1] < 12),
active AS (
  SELECT pattern, list, first_day AS since,
         CASE WHEN d[5] < 10 THEN first_day + 20 + d[4] END AS until FROM listed
  UNION ALL
  SELECT pattern, list, first_day + 60 + d[6], NULL FROM listed WHERE d[5] < 5),
matches AS (
  SELECT c.page_id, c.url, a.pattern, a.list,
         row_number() OVER (PARTITION BY c.page_id, c.url
                            ORDER BY length(a.pattern) DESC, a.list = 'allow' DESC, a.pattern DESC) AS place
  FROM captures c JOIN suffixes s ON c.host = s.host JOIN active a ON a.pattern = s.pattern
  WHERE a.since <= c.fetched_day AND (a.until IS NULL OR c.fetched_day < a.until))
SELECT c.page_id, c.url, c.fetched_day, c.host, m.pattern AS matched_pattern, m.list AS matched_list,
       coalesce(m.list = 'block', FALSE) AS blocked
FROM captures c LEFT JOIN matches m ON m.page_id = c.page_id AND m.url = c.url AND m.place = 1
"""
