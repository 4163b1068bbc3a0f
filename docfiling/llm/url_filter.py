"""URL filter by rules and link-graph propagation, in DataFrame functions only.

Rules of host and path decide what they fit.  For all other pages, trust flows from the hosts of allowed pages along
host edges, and distrust from the hosts of blocked pages against them (personalised PageRank each, until it has settled); a host whose
distrust outweighs its trust is blocked.  Host edges are the links in the pages' HTML, counted by pair of hosts, and
those of a host to its parent domain and back.

Edge cases: a null url, or one without ://, has neither host nor path, fits no rule and is allowed, as are hosts
that nothing reaches.  Null html has no links.  Repeated rows and rows without an id each get their own row.  An empty
table gives an empty result.  Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

#: Fixed values of the contract: verdict, host, path.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
ROUNDS_TOGETHER = 8
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.substring_index(url, "://", 1)
    after = F.when(F.contains(url, F.lit("://")), url.substr(F.char_length(rest) + 4, F.char_length(url)))
    host = F.translate(F.regexp_extract(after, "^[^/?#]*", 0), _UPPER, _UPPER.lower())
    path = F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, or nulls."""
    name = verdict = None
    for what, of, start in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == of) | host.endswith(f".{of}")) & path.startswith(start)
        name = F.when(fits, of + start) if name is None else name.when(fits, of + start)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    return (name, verdict) if name is not None else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, n of the pages' links and of parent domains; pages has host, links (array of hosts)."""
    links = pages.select(F.col("host").alias("src"), F.explode("links").alias("dst"))
    links = links.filter((F.col("src") != "") & (F.col("dst") != "") & (F.col("src") != F.col("dst"))).groupBy("src", "dst").agg(F.count("*").alias("n"))
    hosts = pages.select(F.col("host").alias("src")).filter("src <> ''").distinct()
    up = hosts.select("src", F.regexp_replace("src", r"^[^.]*\.", "").alias("dst")).filter(F.contains("dst", F.lit(".")) & (F.col("src") != F.col("dst")))
    tree = up.unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("n", F.lit(1).cast("long"))
    return links.unionByName(tree).groupBy("src", "dst").agg(F.sum("n").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, tolerance: float = 1e-6, damping: float = 0.85) -> DataFrame:
    """kind, host, rank, as settled; seeds: kind, host, seed (adding up to 1 for a kind).

    Edges: kind, src, dst, share (adding up to 1 for a kind and src).  Rounds go on until none changes a rank by more than
    tolerance times itself, so no host is newly reached either (ranks below 1e-300 count as none).  Each round is one join
    and one sum; some rounds are written to the shared folder together, so lost executors cost these at most.
    """
    seeds = seeds.select("kind", "host", "seed")
    ends = edges.select("kind", F.col("src").alias("host")).unionByName(edges.select("kind", F.col("dst").alias("host")))
    own = ends.withColumn("seed", F.lit(0.0)).unionByName(seeds).groupBy("kind", "host").agg(F.sum("seed").alias("seed"))
    # a step of each host to itself carries its seed and its rank before
    own = own.select("kind", F.col("host").alias("src"), F.col("host").alias("dst"), F.lit(0.0).alias("share"), F.lit(1.0).alias("keep"), ((1 - damping) * F.col("seed")).alias("base"))
    steps = stage(edges.select("kind", "src", "dst", (damping * F.col("share")).alias("share"), F.lit(0.0).alias("keep"), F.lit(0.0).alias("base")).unionByName(own), "steps")
    rank = seeds.select("kind", "host", F.col("seed").alias("rank"))
    while True:
        for _ in range(ROUNDS_TOGETHER):
            flow = rank.select("kind", F.col("host").alias("src"), "rank").join(steps, ["kind", "src"])
            flow = flow.select("kind", F.col("dst").alias("host"), (F.col("rank") * F.col("share") + F.col("base")).alias("r"), (F.col("rank") * F.col("keep")).alias("b"))
            rank = flow.groupBy("kind", "host").agg(F.sum("r").alias("rank"), F.sum("b").alias("before"))
        rank = stage(rank, "rank")
        if rank.filter(F.abs(F.col("rank") - F.col("before")) > tolerance * F.col("rank") + 1e-300).isEmpty():
            return rank.select("kind", "host", "rank")


def judged(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, tolerance: float = 1e-6, damping: float = 0.85, ratio: float = 1.0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for each row of pages.

    A page without a rule is blocked if its host's distrust exceeds ratio times its trust.
    """
    host, path = host_and_path(F.col(url_col))
    link = r"""(?i)(?:href|src)\s*=\s*["']?[a-z][a-z0-9+.-]*://([^/?#"'\s>]+)"""
    html = F.col(html_col)
    links = F.when(F.contains(html, F.lit("://")), F.array_distinct(F.transform(F.regexp_extract_all(html, F.lit(link), F.lit(1)), lambda h: F.translate(h, _UPPER, _UPPER.lower()))))
    seen = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), F.coalesce(links, F.array().cast("array<string>")).alias("links"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    seen = stage(seen.select("*", name.alias("rule"), verdict.alias("by_rule")), "pages")

    edges = stage(host_edges(seen), "edges")
    ahead = edges.select(F.lit("trust").alias("kind"), "src", "dst", "n")
    back = edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    both = ahead.unionByName(back)
    total = both.groupBy("kind", "src").agg(F.sum("n").alias("total"))
    both = stage(both.join(total, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("total")).alias("share")), "shares")
    seeds = seen.filter(F.col("by_rule").isNotNull()).groupBy(F.when(F.col("by_rule") == "allow", "trust").otherwise("distrust").alias("kind"), "host").agg(F.count("*").alias("n"))
    sizes = {r["kind"]: r["n"] for r in seeds.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    share = F.when(F.col("kind") == "trust", F.col("n") / max(1, sizes.get("trust", 0))).otherwise(F.col("n") / max(1, sizes.get("distrust", 0)))
    seeds = stage(seeds.select("kind", "host", share.alias("seed")), "seeds")
    rank = propagate(both, seeds, tolerance, damping)
    of_host = rank.groupBy("host").agg(F.sum(F.when(F.col("kind") == "trust", F.col("rank"))).alias("trust"), F.sum(F.when(F.col("kind") == "distrust", F.col("rank"))).alias("distrust"))
    of_host = stage(of_host, "hosts")
    out = seen.select("page_id", "host", "path", "rule", "by_rule").join(of_host, "host", "left").fillna(0.0, ["trust", "distrust"])
    method = F.when(F.col("distrust") > ratio * F.col("trust"), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", method).alias("verdict"), "trust", "distrust")
