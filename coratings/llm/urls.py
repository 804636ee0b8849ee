"""URL verdicts: rules by host and path, and trust that links carry between hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from coratings.llm.staging import BROADCAST_TEXT_ROWS, cut, sized
from coratings.plans.staging import release

DAMPING = 0.85
TOLERANCE = 1e-3  # of a host's mean score: what may still change when the rounds end, and the least score that counts
BLOCK = 8  # rounds between two looks at what has changed
SQL_ROUNDS = 160
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# href in any case, blanks around =, and a value in double, single or no quotes.
HREF = r"""(?i)href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]*)"""


def _parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _ruled(places: DataFrame, rules: DataFrame) -> DataFrame:
    """host, path, rule, action of the longest fitting rule of each distinct host and path."""
    labels = F.split("host", "[.]")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = rules.select("action", "rule", F.substring_index("rule", "/", 1).alias("of"), F.expr("substring(rule, instr(rule, '/'))").alias("under"))
    return (
        places.where("host <> ''").select("host", "path", F.explode(above).alias("of")).join(sized(cut(hosts), BROADCAST_TEXT_ROWS), "of")
        .where(F.col("path").startswith(F.col("under")))
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("rule").alias("size"), "rule", "action")).alias("best"))
        .select("host", "path", "best.rule", "best.action")
    )


def spread(seeds: DataFrame, edges: DataFrame, hosts: int) -> DataFrame:
    """(kind, host, p): trust along links and distrust against them, as personalised PageRank from ``seeds``.

    ``seeds``: kind, host, p, which add up to 1 for a kind. ``edges``: src, dst,
    n. Each round gives every host its share of the seeds and DAMPING of what
    its neighbours pass on, in proportion to n. What hosts without links hold
    goes back to the seeds, so that scores of a kind add up to 1. Rounds go on until no score
    changes by more than TOLERANCE / ``hosts`` in BLOCK of them. Both kinds go in
    one join and one combined aggregate a round.
    """
    if edges.isEmpty():
        return seeds.select("kind", "host", "p")
    both = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "n").union(
        edges.select(F.lit("distrust"), F.col("dst"), F.col("src"), "n")
    )
    total = both.groupBy("kind", "host").agg(F.sum("n").alias("total"))
    links = both.join(total, ["kind", "host"]).select("kind", "host", "to", (F.col("n") / F.col("total") * DAMPING).alias("share"))
    # Hosts without links pass on to one further node, named '', and that to the seeds.
    every = links.select("kind", F.col("to").alias("host")).union(seeds.select("kind", "host")).distinct()
    ends = every.join(links.select("kind", "host").distinct(), ["kind", "host"], "left_anti")
    links = cut(
        links.union(ends.select("kind", "host", F.lit("").alias("to"), F.lit(DAMPING).alias("share")))
        .union(seeds.select("kind", F.lit("").alias("host"), F.col("host").alias("to"), F.col("p").alias("share")))
    )
    start = cut(seeds.select("kind", "host", (F.col("p") * (1 - DAMPING)).alias("p")))
    now = cut(seeds.select("kind", "host", "p"))
    while True:
        before = now
        for _ in range(BLOCK):
            passed = now.join(links, ["kind", "host"]).select("kind", F.col("to").alias("host"), (F.col("p") * F.col("share")).alias("p"))
            now = start.union(passed).groupBy("kind", "host").agg(F.sum("p").alias("p"))
        now = cut(now)
        apart = now.alias("a").join(before.alias("b"), ["kind", "host"], "full").select(F.max(F.abs(F.coalesce("a.p", F.lit(0.0)) - F.coalesce("b.p", F.lit(0.0)))))
        if (apart.first()[0] or 0.0) * hosts <= TOLERANCE:
            return now.where("host <> ''")
        release(before)


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str]], threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust per row of ``pages``.

    ``rules`` are (allow or block, host/path). A rule fits its host and all
    subdomains where the path starts with the rule's; the longest wins (of
    equally long ones the last by name). Pages without a rule get their host's
    verdict: hosts seed trust by their allowed pages and distrust by their
    blocked ones, in proportion to their number; links between hosts carry trust
    forward and distrust backward. A host is blocked if its distrust is at least TOLERANCE of a host's mean score
    and its share of trust and distrust ``threshold`` or more; else it is allowed.

    Links are href attributes in any case, with double, single or no quotes.
    Null urls or html: host and path empty, no links; verdict allow. Repeated
    rows each count as pages. Links within a host are no edges. Empty input:
    no rows.
    """
    spark = pages.sparkSession
    host, path = _parts(F.col("url"))
    read = cut(
        pages.select(
            "page_id", host.alias("host"), path.alias("path"),
            F.transform(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(HREF), 1), lambda h: F.translate(h, UPPER, LOWER)).alias("links"),
        )
    )
    table = spark.createDataFrame(rules, "action string, rule string")
    ruled = cut(_ruled(read.select("host", "path").distinct(), table))
    judged = read.drop("links").join(sized(ruled, BROADCAST_TEXT_ROWS), ["host", "path"], "left")

    kind = F.when(F.col("action") == "allow", "trust").otherwise("distrust")
    seeds = cut(judged.where("action IS NOT NULL").groupBy(kind.alias("kind"), "host").agg(F.count("*").alias("n")))
    totals = seeds.groupBy("kind").agg(F.sum("n").alias("total"))
    seeds = seeds.join(F.broadcast(totals), "kind").select("kind", "host", (F.col("n") / F.col("total")).alias("p"))
    edges = cut(
        read.where("host <> ''").select(F.col("host").alias("src"), F.explode("links").alias("dst")).where("dst <> '' AND src <> dst")
        .groupBy("src", "dst").agg(F.count("*").alias("n"))
    )
    linked = edges.select(F.explode(F.array("src", "dst")).alias("host"))
    hosts = max(1, read.where("host <> ''").select("host").union(linked).distinct().count())
    got = cut(spread(seeds, edges, hosts))
    by_host = cut(
        got.groupBy("host").agg(
            F.sum(F.when(F.col("kind") == "trust", F.col("p")).otherwise(0.0)).alias("trust"),
            F.sum(F.when(F.col("kind") == "distrust", F.col("p")).otherwise(0.0)).alias("distrust"),
        )
    )
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    blocked = (distrust * hosts >= TOLERANCE) & (distrust >= (trust + distrust) * threshold)
    verdict = F.coalesce("action", F.when(blocked, "block").otherwise("allow"))
    return judged.join(sized(by_host, BROADCAST_TEXT_ROWS), "host", "left").select(
        "page_id", "host", "path", "rule", verdict.alias("verdict"), trust.alias("trust"), distrust.alias("distrust")
    )


def rule_list(text: str) -> list[tuple[str, str]]:
    """``allow com/, block net/es/`` as (action, rule) pairs."""
    return [tuple(part.split()) for part in text.split(",")]


def verdict_sql(rules: list[tuple[str, str]], threshold: float = 0.5) -> str:
    """The same verdicts on the pages table in DuckDB's SQL, in SQL_ROUNDS rounds of a recursive query."""
    values = ", ".join(f"('{action}', '{rule}')" for action, rule in rules)
    lower = f"translate({{}}, '{UPPER}', '{LOWER}')"
    host = lower.format(r"regexp_extract(rest, '^[^/?#]*')")
    pattern = HREF.replace("'", "''")
    parts = [f"""
WITH RECURSIVE cut AS (
  SELECT *, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
placed AS (
  SELECT row_number() OVER () AS rid, page_id, {host} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
    regexp_extract_all(coalesce(html, ''), '{pattern}', 1) AS links FROM cut),
rules AS (
  SELECT action, rule, split_part(rule, '/', 1) AS o, substr(rule, instr(rule, '/')) AS under FROM (VALUES {values}) AS r(action, rule)),
best AS (
  SELECT rid, max({{'size': length(rule), 'rule': rule, 'action': action}}) AS b
  FROM placed JOIN rules ON (host = o OR ends_with(host, '.' || o)) AND starts_with(path, under) GROUP BY rid),
judged AS (SELECT placed.*, b.rule AS rule, b.action AS action FROM placed LEFT JOIN best USING (rid)),
seeds AS (
  SELECT kind, host, n / sum(n) OVER (PARTITION BY kind) AS p FROM (
    SELECT CASE action WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host, count(*) AS n FROM judged WHERE action IS NOT NULL GROUP BY ALL)),
edges AS (
  SELECT host AS src, {lower.format("dst")} AS dst, count(*) AS n FROM (SELECT host, unnest(links) AS dst FROM placed WHERE host <> '')
  WHERE dst <> '' AND {lower.format("dst")} <> host GROUP BY ALL),
hosts AS (SELECT count(*) AS n FROM (SELECT host FROM placed WHERE host <> '' UNION SELECT src FROM edges UNION SELECT dst FROM edges)),
both_ways AS (
  SELECT 'trust' AS kind, src AS host, dst AS t, n FROM edges UNION ALL SELECT 'distrust', dst, src, n FROM edges),
links AS (SELECT kind, host, t, n / sum(n) OVER (PARTITION BY kind, host) * {DAMPING} AS share FROM both_ways),
ends AS (
  SELECT kind, t AS host FROM links UNION SELECT kind, host FROM seeds EXCEPT SELECT kind, host FROM links),
steps AS (
  SELECT * FROM links UNION ALL SELECT kind, host, '', {DAMPING} FROM ends UNION ALL SELECT kind, '', host, p FROM seeds
  UNION ALL SELECT DISTINCT kind, ' ', ' ', 1.0 FROM seeds UNION ALL SELECT kind, ' ', host, p * {1 - DAMPING} FROM seeds),
rounds AS (
  SELECT 0 AS round, kind, host, p FROM (SELECT kind, host, p FROM seeds UNION ALL SELECT DISTINCT kind, ' ', 1.0 FROM seeds)
  UNION ALL
  SELECT round + 1, kind, t, sum(p * share) FROM rounds JOIN steps USING (kind, host) WHERE round < {SQL_ROUNDS} GROUP BY round, kind, t),
scores AS (
  SELECT host, sum(CASE WHEN kind = 'trust' THEN p ELSE 0 END) AS trust, sum(CASE WHEN kind = 'distrust' THEN p ELSE 0 END) AS distrust
  FROM rounds WHERE round = {SQL_ROUNDS} AND trim(host) <> '' GROUP BY host)"""]
    return ",".join(parts) + f"""
SELECT page_id, j.host, path, rule,
  coalesce(action, CASE WHEN distrust * (SELECT n FROM hosts) >= {TOLERANCE} AND distrust >= (trust + distrust) * {threshold} THEN 'block' ELSE 'allow' END) AS verdict
FROM judged j LEFT JOIN scores ON j.host = scores.host
"""
