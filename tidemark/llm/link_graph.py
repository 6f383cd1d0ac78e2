"""URL filters: listed rules, and trust and distrust propagated over the graph of hosts.

The longest rule that fits a url decides. Where none fits, its host does: personalised PageRank spreads trust from hosts with allowed
pages along links, and the same walk on reversed links spreads distrust from hosts with blocked pages to those that link to them. A host
whose distrust exceeds ``ratio`` times its trust is blocked. Hosts link by absolute hrefs in their pages, and each domain with its
parent domain, so a host of which nothing else is known stands with its domain.

A null url, or one without ``://``, has an empty host and path; it fits no rule and is allowed. Null pages have no links. Repeated pages
count as often as they occur. Mass of hosts without links isn't handed on. Extra columns don't matter: only page_id, url and html are read.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path): the rules that the query applies.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
LINK = r"""(?i)\bhref\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""
DAMPING = 0.85
ROUNDS = 8
RATIO = 1.0


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as a struct (verdict, rule); of equally long ones a blocking one. Rules are literals, so a url is judged where it is read."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[0] == "block")):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(out)
    return out


def edges(pages: DataFrame) -> DataFrame:
    """src, dst, weight of links between hosts and between a domain and its parent; pages has host and html."""
    link = F.explode(F.transform(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1)), lambda h: F.translate(h, UPPER, LOWER)))
    links = pages.where("host <> ''").select(F.col("host").alias("src"), link.alias("dst")).where("src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    names = pages.select("host").unionByName(links.select(F.col("dst").alias("host"))).where("host <> ''").distinct()
    labels = F.split("host", r"\.")
    chain = names.select(labels.alias("l")).where("size(l) > 2").select("l", F.explode(F.sequence(F.lit(1), F.size("l") - 2)).alias("i"))
    up = chain.select(F.array_join(F.slice("l", F.col("i"), F.size("l") - F.col("i") + 1), ".").alias("src"), F.array_join(F.slice("l", F.col("i") + 1, F.size("l") - F.col("i")), ".").alias("dst")).distinct()
    both = up.unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("weight", F.lit(1.0))
    return links.unionByName(both).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagate(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """Scores by (side, host). seeds: side (trust or distrust), host, score. Distrust walks the reversed links."""
    way = links.select(F.lit("trust").alias("side"), "src", "dst", "weight").unionByName(links.select(F.lit("distrust").alias("side"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    total = way.groupBy("side", "src").agg(F.sum("weight").alias("total"))
    step = written(way.join(total, ["side", "src"]).select("side", F.col("src").alias("host"), "dst", (F.col("weight") / F.col("total")).alias("share")), "op10-links")
    seeds = written(seeds.groupBy("side", "host").agg(F.sum("score").alias("score")), "op10-seeds")
    held = seeds.withColumn("score", F.col("score") * (1 - damping))
    state = seeds
    for _ in range(rounds):
        moved = state.join(step, ["side", "host"]).select("side", F.col("dst").alias("host"), (F.col("score") * F.col("share") * damping).alias("score"))
        state = moved.unionByName(held).groupBy("side", "host").agg(F.sum("score").alias("score"))
    return state


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], ratio: float = RATIO, rounds: int = ROUNDS) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust."""
    host, path = host_path(F.col("url"))
    named = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    fit = rule(F.col("host"), F.col("path"), rules)
    ruled = named.drop("html").withColumn("_r", fit)
    seeds = ruled.where("_r is not null and host <> ''").groupBy(F.when(F.col("_r.verdict") == "allow", "trust").otherwise("distrust").alias("side"), "host").agg(F.count("*").cast("double").alias("score"))
    scores = propagate(edges(named), seeds, rounds=rounds)
    by_host = scores.groupBy("host").agg(F.sum(F.when(F.col("side") == "trust", F.col("score"))).alias("trust"), F.sum(F.when(F.col("side") == "distrust", F.col("score"))).alias("distrust"))
    by_host = by_host.select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
    by_host = written(by_host, "op10-scores")
    trust, distrust = (F.coalesce(c, F.lit(0.0)) for c in ("trust", "distrust"))
    verdict = F.coalesce(F.col("_r.verdict"), F.when(distrust > ratio * trust, "block").otherwise("allow"))
    return ruled.join(by_host, "host", "left").select("page_id", "host", "path", F.col("_r.rule").alias("rule"), verdict.alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))


def op10_link_graph(pages: DataFrame) -> DataFrame:
    return judge(pages.select("page_id", "url", "html"), RULES).select("page_id", "host", "path", "rule", "verdict", F.round("trust", 6).alias("trust"), F.round("distrust", 6).alias("distrust"))
