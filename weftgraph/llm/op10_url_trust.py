"""URL filter by rules and by trust and distrust that spread over the host graph.

Edges are hyperlinks between hosts (absolute or protocol-relative href) and, weaker, the ties between a host and the
domains above it, whether or not these have pages. Trust is a personalised PageRank along the edges from hosts with allowed pages, distrust one against them
from hosts with blocked pages; a host is blocked if its distrust exceeds the threshold times its trust.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.iterate import checkpointed
from weftgraph.llm.common import lower_ascii, materialize, table


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str  # begins with /

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("block", "com", "/en/"), Rule("allow", "example.com", "/en/7"), Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"), Rule("block", "org", "/es/"),
)
MAX_RULES = 1000
DAMPING, THRESHOLD, SITE_WEIGHT = 0.85, 1.0, 0.5
TOLERANCE = 1e-6  # relative change of any host's score in a round at which propagation ends
_ROUNDS = 5  # between two looks at the change
EDGES_OF_A_TASK = 100_000  # of the host graph; a round has as many tasks as that gives, not the session's partitions
_HREF = r"""(?i)<a\s[^>]*href\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def parsed(url):
    """(host, path) of a url; both empty for null or without ://."""
    pattern = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    return lower_ascii(F.coalesce(F.regexp_extract(url, pattern, 1), F.lit(""))), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def ruled(host, path, rules=RULES):
    """The longest rule that fits, as a struct(rule, verdict); null if none does."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES}")
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):  # the longest is tried first
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight) between hosts; pages(host, html).

    A host is tied to its parent, that to its own, and so on up to two labels; to a single label (a top-level domain)
    only if it has pages. IP addresses have no parents. No list of public suffixes is used: co.uk is a domain.
    """
    links = checkpointed(
        pages.select("host", F.explode(F.regexp_extract_all("html", F.lit(_HREF), F.lit(1))).alias("dst"))
        .select(F.col("host").alias("src"), lower_ascii("dst").alias("dst")).where("src != dst and src != ''")
        .groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    )
    own = pages.select("host").where("host != ''").distinct()
    hosts = own.union(links.select("dst")).distinct().where(~F.col("host").rlike(r"\A[0-9.]+(:[0-9]*)?\z"))
    labels = hosts.select(F.split("host", r"\.").alias("l")).where("size(l) > 1")
    above = labels.select("l", F.explode(F.sequence(F.lit(1), F.size("l") - 1)).alias("i"))
    suffix = lambda at: F.array_join(F.slice("l", at, F.size("l")), ".")
    parent = above.select(suffix(F.col("i")).alias("host"), suffix(F.col("i") + 1).alias("parent")).distinct()
    ties = parent.join(own.select(F.col("host").alias("parent"), F.lit(True).alias("paged")), "parent", "left")
    ties = ties.where(F.col("paged") | F.col("parent").rlike(r"[^.]\.[^.]"))
    ties = ties.select(F.explode(F.array(F.struct(F.col("host").alias("src"), F.col("parent").alias("dst")), F.struct(F.col("parent").alias("src"), F.col("host").alias("dst")))).alias("e"))
    return links.unionByName(ties.select("e.*", F.lit(SITE_WEIGHT).alias("weight"))).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tol: float = TOLERANCE) -> DataFrame:
    """(host, kind, score): personalised PageRank of kind 't' along and of kind 'd' against the edges.

    seeds(host, kind, seed): seed masses, made to sum to 1 by kind. Mass of hosts without an edge to follow stays put.
    Rounds go on until no host's score changes by more than tol of itself, so every host that mass can reach has some.
    A round has a task for each EDGES_OF_A_TASK edges: the files of a shuffle grow with the tasks on either side of it, and
    with the session's partitions a small graph would leave more of them than its rows are.
    """
    ways = edges.select(F.col("src").alias("host"), "dst", "weight", F.lit("t").alias("kind")).unionByName(
        edges.select(F.col("dst").alias("host"), F.col("src").alias("dst"), "weight", F.lit("d").alias("kind"))
    )
    out = ways.groupBy("host", "kind").agg(F.sum("weight").alias("out"))
    tasks = max(1, -(-edges.count() // EDGES_OF_A_TASK))
    ways = ways.join(out, ["host", "kind"]).select("host", "kind", "dst", (F.col("weight") / F.col("out")).alias("share"))
    ways = checkpointed(ways.coalesce(tasks)).coalesce(tasks)
    total = seeds.groupBy("kind").agg(F.sum("seed").alias("all"))
    start = seeds.join(F.broadcast(total), "kind").select("host", "kind", (F.col("seed") / F.col("all")).alias("seed"))
    start = checkpointed(start.coalesce(tasks)).coalesce(tasks)
    rank = start.withColumnRenamed("seed", "score")
    off = 1.0
    while off is not None and off > tol:
        for _ in range(_ROUNDS):
            last = rank
            moved = (
                rank.join(ways, ["host", "kind"], "left")
                .select(F.coalesce("dst", "host").alias("host"), "kind", (F.col("score") * F.coalesce("share", F.lit(1.0)) * damping).alias("score"))
            )
            rank = (
                moved.unionByName(start.select("host", "kind", (F.col("seed") * (1 - damping)).alias("score"))).coalesce(tasks)
                .groupBy("host", "kind").agg(F.sum("score").alias("score"))
            )
        both = checkpointed(rank.join(last.withColumnRenamed("score", "last"), ["host", "kind"], "left").coalesce(tasks)).coalesce(tasks)
        # what is next to 0 in a double has no relative change to speak of
        off = both.where("score > 1e-250").agg(F.max(F.abs(F.col("score") - F.coalesce("last", F.lit(0.0))) / F.col("score"))).first()[0]
        rank = both.select("host", "kind", "score")
    return rank


def judge(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """Per page: host, path, the rule that fits, and the verdict: the rule's, else that of the host's trust.

    A null url, or one without ://, has an empty host and path and is allowed unless a rule fits. A host that neither
    trust nor distrust reaches is allowed. Rows with a null page_id stay; repeated rows are rows of their own (each
    counts as a seed). Null html has no links. Extra columns are ignored.
    """
    host, path = parsed(F.col("url"))
    # one pass over the pages' html; what is kept of it is the links, hosts and paths
    slim = pages.select("page_id", host.alias("host"), path.alias("path"))
    slim = slim.withColumn("found", ruled(F.col("host"), F.col("path"), rules))
    edges = checkpointed(host_edges(pages.select(host.alias("host"), "html")))
    seeds = (
        slim.where("found is not null and host != ''")
        .groupBy("host", F.when(F.col("found.verdict") == "allow", "t").otherwise("d").alias("kind"))
        .agg(F.count(F.lit(1)).cast("double").alias("seed"))
    )
    rank = propagate(edges, seeds)
    score = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("score"))), F.lit(0.0))
    hosts = materialize(rank.groupBy("host").agg(score("t").alias("trust"), score("d").alias("distrust")), "hosts")
    return slim.join(hosts, "host", "left").select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", F.when(F.col("distrust") > threshold * F.col("trust"), "block").otherwise("allow")).alias("verdict"),
        "trust", "distrust",
    )


def op10_url_trust(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
