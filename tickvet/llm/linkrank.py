"""URL filter by propagation over the link graph of hosts.

Rules judge what they fit. For all other pages the host decides: trust is a personalised PageRank from hosts by the
share of their pages that rules allow; distrust is one over reversed links, from hosts by the share that rules block (who
links to bad hosts is suspect). Both are scaled so that a host without links keeps its own share. A host is blocked if
its distrust reaches the threshold and exceeds its trust. Links are `href` values with a host of their own; edges
are counted once per pair of hosts and weighted by count.

Only DataFrame functions; every step aggregates before it shuffles, joins are on host with both sides in tables (so that
adaptive execution splits a hot host), and ranks are materialised every 8 rounds.

Edge cases: a null url or one without `://` has empty host and path, fits no rule and is judged as host ''; null html has
no links; repeated pages count each; a page table without links needs no rounds; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickvet.llm.common import collected, discard, materialize

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_path(url: Column) -> tuple[Column, Column]:
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def best_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits as struct(verdict, rule), else null."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links from host to another host."""
    target = F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(r"(?i)\bhref\s*=\s*[\"']?\s*(?:https?:)?//([^/?#\"'\s>]+)"), 1)))
    found = pages.select(host_path(F.col("url"))[0].alias("src"), target.alias("dst"))
    return found.withColumn("dst", ascii_lower(F.col("dst"))).filter("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def converge(seeds: DataFrame, edges: DataFrame, damping: float, tolerance: float, cut: int = 8, fan: int = 1000) -> DataFrame:
    """(kind, host, rank): r = seed + damping x W^T r for each kind, W being the edges' shares by source; each rank short of it by less than tolerance.

    seeds: (kind, host, seed), edges: (kind, src, dst, n). step is what a round adds. Each round adds at most damping times as much as the one
    before, over all hosts, so that after it at most step x damping / (1 - damping) is to come; this is looked at every `cut` rounds.

    A round reads the one before once: a host's row, joined with its links in lists of `fan` at most, gives itself and what flows from it. So a plan
    grows by one join and one aggregate a round, and a host of many links is many rows.
    """
    own = Window.partitionBy("kind", "src")
    shares = edges.withColumn("w", F.col("n") / F.sum("n").over(own)).withColumn("part", F.floor((F.row_number().over(own.orderBy("dst")) - 1) / fan))
    lists = materialize(shares.groupBy("kind", "src", "part").agg(F.collect_list(F.struct("dst", "w")).alias("links")).withColumnRenamed("kind", "of"))
    rank = materialize(seeds.select("kind", "host", F.col("seed").alias("rank"), F.col("seed").alias("step")))
    most = F.coalesce(F.max("total"), F.lit(0.0)).alias("most")
    while collected(rank.groupBy("kind").agg(F.sum("step").alias("total")).agg(most))[0].most * damping / (1 - damping) >= tolerance:
        last = rank
        for _ in range(cut):
            flows = F.transform("links", lambda x: F.struct(x["dst"].alias("host"), F.lit(0.0).alias("rank"), (F.col("step") * x["w"] * damping).alias("step")))
            itself = F.array(F.struct("host", "rank", F.lit(0.0).alias("step")))
            told = F.concat(F.when(F.coalesce("part", F.lit(0)) == 0, itself).otherwise(F.array()), F.when(F.col("links").isNotNull(), flows).otherwise(F.array()))
            met = rank.join(lists, (F.col("kind") == F.col("of")) & (F.col("host") == F.col("src")) & (F.col("step") > 0), "left")
            rank = met.select("kind", F.explode(told).alias("y")).groupBy("kind", "y.host").agg(F.sum("y.rank").alias("rank"), F.sum("y.step").alias("step"))
            rank = rank.select("kind", "host", (F.col("rank") + F.col("step")).alias("rank"), "step")
        rank = materialize(rank)
        discard(last)
    discard(lists)
    return rank.select("kind", "host", "rank")


def judge(pages: DataFrame, rules=RULES, damping: float = 0.85, threshold: float = 0.5, tolerance: float = 1e-8) -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's trust and distrust (rounded to 6 digits)."""
    host, path = host_path(F.col("url"))
    judged = pages.select(F.col("page_id").cast("long"), host.alias("host"), path.alias("path")).withColumn("r", best_rule(F.col("host"), F.col("path"), rules))
    share = lambda verdict: F.sum((F.coalesce(F.col("r.verdict"), F.lit("")) == verdict).cast("double")) / F.count("*")
    hosts = materialize(judged.groupBy("host").agg(share("allow").alias("allow"), share("block").alias("block")))
    edges = materialize(host_edges(pages))
    seeds = hosts.select(F.explode(F.array(F.struct(F.lit("trust").alias("kind"), F.col("allow").alias("seed")), F.struct(F.lit("distrust").alias("kind"), F.col("block").alias("seed")))).alias("y"), "host").select("y.kind", "host", "y.seed")
    if edges.isEmpty():
        ranks = seeds.select("kind", "host", F.col("seed").alias("rank"))
    else:  # trust goes along the links, distrust against them; both in the same rounds
        ways = (F.struct(F.lit("trust").alias("kind"), "src", "dst", "n"), F.struct(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
        ranks = converge(seeds, edges.select(F.explode(F.array(*ways)).alias("y")).select("y.*"), damping, tolerance)
    of = lambda kind: F.round(F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("rank"))), F.lit(0.0)), 6).alias(kind)
    ranks = materialize(ranks.groupBy("host").agg(of("trust"), of("distrust")))
    by_host = F.when((F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust")), "block").otherwise("allow")
    return judged.join(ranks, "host", "left").select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", by_host).alias("verdict"), "trust", "distrust")


def judge_sql(rules=RULES, damping: float = 0.85, rounds: int = 200, threshold: float = 0.5) -> str:
    """The same for DuckDB over a view `pages`; after 200 rounds 1e-14 of the mass is to come."""
    fits = lambda r: f"((host = '{r[1].partition('/')[0]}' OR ends_with(host, '.{r[1].partition('/')[0]}')) AND starts_with(path, '/{r[1].partition('/')[2]}'))"
    longest = sorted(rules, key=lambda r: -len(r[1]))
    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r[1]}'" for r in longest) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r[0]}'" for r in longest) + " END"
    lower = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps = []
    for kind, seed, a, b in (("t", "allow", "src", "dst"), ("d", "block", "dst", "src")):
        steps.append(f"{kind}w AS (SELECT {a} AS src, {b} AS dst, n / sum(n) OVER (PARTITION BY {a}) AS w FROM edges)")
        steps.append(f"{kind} AS (SELECT host, {seed} AS step, 0 AS i FROM hosts WHERE {seed} > 0 UNION ALL SELECT dst, sum(step * w * {damping}), i + 1 FROM {kind} JOIN {kind}w ON host = src WHERE i < {rounds} GROUP BY dst, i)")
    return f"""WITH RECURSIVE parts AS (SELECT page_id, html, coalesce(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END, '') AS rest FROM pages),
cut AS (SELECT page_id, html, {lower(r"regexp_extract(rest, '^([^/?#]*)', 1)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
judged AS (SELECT page_id, html, host, path, {rule} AS rule, {verdict} AS verdict FROM cut),
hosts AS MATERIALIZED (SELECT host, avg(CASE WHEN verdict = 'allow' THEN 1.0::DOUBLE ELSE 0 END) AS allow, avg(CASE WHEN verdict = 'block' THEN 1.0::DOUBLE ELSE 0 END) AS block FROM judged GROUP BY host),
hrefs AS (SELECT host AS src, {lower('dst')} AS dst FROM (SELECT host, unnest(list_distinct(regexp_extract_all(html, '(?i)\\bhref\\s*=\\s*["'']?\\s*(?:https?:)?//([^/?#"''\\s>]+)', 1))) AS dst FROM judged)),
edges AS MATERIALIZED (SELECT src, dst, count(*)::DOUBLE AS n FROM hrefs WHERE src <> dst GROUP BY src, dst),
{", ".join(steps)},
ranks AS (SELECT host, round(coalesce(g.rank, 0), 6) AS trust, round(coalesce(b.rank, 0), 6) AS distrust FROM hosts LEFT JOIN (SELECT host, sum(step) AS rank FROM t GROUP BY host) g USING (host) LEFT JOIN (SELECT host, sum(step) AS rank FROM d GROUP BY host) b USING (host))
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN distrust >= {threshold} AND distrust > trust THEN 'block' ELSE 'allow' END) AS verdict, trust, distrust FROM judged LEFT JOIN ranks USING (host)"""
