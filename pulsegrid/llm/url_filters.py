"""URL filter with link-graph propagation.

A URL is judged by the longest rule that fits it; where none fits, by its host's place in the link graph.  Personalised
PageRank carries trust forward from hosts with allowed pages, and distrust backward (who links to a blocked host is
suspect) from hosts with blocked pages, over edges between hosts:

* links of the pages' HTML, each counted once a page and target host; links within a host are no edges;
* ``parents``: a host and the domain above it, in both directions, up to two labels.  Sites whose pages link nowhere
  else are reached through it.

A host is blocked where its distrust exceeds ``threshold`` times its trust, both as shares of all; hosts that neither
reaches are allowed.  Iteration ends when what is still on its way is below ``tolerance`` of all mass, which bounds the
error of every share; mass at hosts without edges goes back to the seeds, which the last scaling does at once.

Pages are read once for hosts and links, and once for the verdicts.  Both directions go in one pass: an arc carries its
share of trust and of distrust, so a step is one join of arcs with hosts and one pre-aggregated sum.  A host of very
many links is split by adaptive execution on the arcs' side of that plain join; sums meet within map tasks first.  Each
round of steps is a written table, and the one before it is deleted.

Defined cases: null URLs, and those without ``://``, have an empty host and path, fit no rule and are allowed; an empty
path fits no rule that has a path; hosts are compared as they stand, port and user included; null HTML has no links;
null and repeated page ids are rows like any other; without seeds everything is allowed; an empty table gives no rows.
Rules are a list that the driver holds; of equally long ones that fit, a block goes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import ascii_lower, broadcast_if_small, discard, materialise, prepare

#: The rules of the registered query, (verdict, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
DAMPING, TOLERANCE, THRESHOLD = 0.85, 1e-4, 1.0
#: Steps that one Spark job makes.
STEPS = 4
#: Hosts up to this number are broadcast to the pages, if they are also small in bytes.
BROADCAST_HOSTS = 200_000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return ascii_lower(F.regexp_extract(_text(url), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(_text(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def link_hosts(html: Column, own: Column) -> Column:
    """Distinct hosts that a page links to, in any of the three ways of quoting; relative links lead to its own host."""
    quoted = F.regexp_extract_all(_text(html), F.lit(r"""(?is)<a(?:rea)?\s(?:[^>]*?\s)?href\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^\s"'>/?#]*)"""), F.lit(1))
    hosts = F.transform(quoted, lambda x: ascii_lower(F.regexp_extract(x, r"//(.*)$", 1)))
    return F.array_distinct(F.filter(hosts, lambda h: (h != "") & (h != own)))


def parent_of(host: Column) -> Column:
    """The domain above a host of three labels or more; else null."""
    return F.when(F.size(F.split(host, r"\.")) > 2, F.regexp_extract(host, r"^[^.]*\.(.+)$", 1))


def _suffixes(host: Column) -> Column:
    """A host and all domains above it."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


def fitting_rules(hosts: DataFrame, rules: tuple[tuple[str, str, str], ...]) -> DataFrame:
    """``hosts`` (host) with ``rules``: what its pages may fit, as (-length, order, path, rule, verdict), the longest first.

    Every host and domain above it is looked up by equality; a host's rules come together in one row.
    """
    spark = hosts.sparkSession
    known = [(h, (-len(h + p), int(v != "block"), p, h + p, v)) for v, h, p in rules]
    table = spark.createDataFrame(known, "suffix string, r struct<length:int,nth:int,path:string,rule:string,verdict:string>")
    found = hosts.select("host", F.explode(_suffixes(F.col("host"))).alias("suffix")).join(broadcast_if_small(table, 1_000_000), "suffix")
    return found.groupBy("host").agg(F.array_sort(F.collect_list("r")).alias("rules"))


def fitting(rules: Column, path: Column) -> Column:
    """The longest rule that fits a path, or null."""
    return F.get(F.filter(rules, lambda r: F.startswith(path, r["path"])), F.lit(0))


def host_edges(links: DataFrame, hosts: DataFrame, parents: bool = True) -> DataFrame:
    """(src, dst, weight) between different hosts, from links (src, dst) with one row a page and target."""
    edges = links
    if parents:
        up = hosts.select(F.col("host").alias("src"), F.explode(F.transform(_suffixes(F.col("host")), lambda h: F.struct(h.alias("h"), parent_of(h).alias("p")))).alias("x"))
        pairs = up.select(F.col("x.h").alias("a"), F.col("x.p").alias("b")).filter("b IS NOT NULL").distinct()
        edges = edges.unionByName(pairs.selectExpr("a AS src", "b AS dst")).unionByName(pairs.selectExpr("b AS src", "a AS dst"))
    return edges.filter("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def propagated(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust): PageRank shares from ``seeds`` (host, trusted, blocked: weights) over ``edges``.

    The series of the remaining mass is summed.  Every host has an arc to itself that keeps what has arrived, so a step
    is one join and one aggregate over a plan that grows by a line; some steps are one job, and only two sums of each
    job reach the driver.  Each share is below its limit by at most ``tolerance`` of all mass.
    """
    edges = materialise(edges, "edges")
    out = materialise(edges.groupBy("src").agg(F.sum("weight").alias("n")), "degrees")
    back = materialise(edges.groupBy("dst").agg(F.sum("weight").alias("n")), "degrees")
    forward = edges.join(out, "src").select(F.col("src").alias("host"), F.col("dst").alias("to"), (F.lit(damping) * F.col("weight") / F.col("n")).alias("f"), F.lit(0.0).alias("b"), F.lit(0.0).alias("kept"))
    reverse = edges.join(back, "dst").select(F.col("dst").alias("host"), F.col("src").alias("to"), F.lit(0.0).alias("f"), (F.lit(damping) * F.col("weight") / F.col("n")).alias("b"), F.lit(0.0).alias("kept"))
    every = edges.select(F.col("src").alias("host")).union(edges.select("dst")).union(seeds.select("host")).distinct()
    own = every.select("host", F.col("host").alias("to"), F.lit(0.0).alias("f"), F.lit(0.0).alias("b"), F.lit(1.0).alias("kept"))
    arcs = materialise(forward.unionByName(reverse).unionByName(own).groupBy("host", "to").agg(*[F.sum(c).alias(c) for c in ("f", "b", "kept")]), "arcs")
    totals = seeds.agg(F.sum("trusted").alias("t"), F.sum("blocked").alias("d")).first()
    share = lambda c, total: (F.col(c) / F.lit(float(total)) if total else F.lit(0.0)).alias(c)
    start = seeds.select("host", share("trusted", totals["t"]), share("blocked", totals["d"])).filter("trusted > 0 OR blocked > 0")
    # mass on its way (t, d), and what has come so far (trust, distrust)
    state = materialise(start.select("host", F.col("trusted").alias("t"), F.col("blocked").alias("d"), F.col("trusted").alias("trust"), F.col("blocked").alias("distrust")), "mass")
    sums = [F.sum(c) for c in ("t", "d", "trust", "distrust")]
    while True:
        left = state.agg(*sums).first()
        if max(left[0] or 0.0, left[1] or 0.0) <= tolerance:
            break
        new = state
        for _ in range(STEPS):
            sent = new.join(arcs, "host").select(
                F.col("to").alias("host"), (F.col("t") * F.col("f")).alias("t"), (F.col("d") * F.col("b")).alias("d"),
                (F.col("trust") * F.col("kept") + F.col("t") * F.col("f")).alias("trust"), (F.col("distrust") * F.col("kept") + F.col("d") * F.col("b")).alias("distrust"),
            )
            new = sent.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("t", "d", "trust", "distrust")])
        new = materialise(new, "mass")
        discard(state)
        state = new
    for table in (edges, out, back, arcs):
        discard(table)
    scale = lambda c, total: (F.col(c) / F.lit(total) if total else F.lit(0.0)).alias(c)
    return state.select("host", scale("trust", left[2]), scale("distrust", left[3]))


def judge_urls(
    pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, id_column: str = "page_id", url_column: str = "url", html_column: str = "html",
    damping: float = DAMPING, tolerance: float = TOLERANCE, threshold: float = THRESHOLD, parents: bool = True,
) -> DataFrame:
    """A row for each page: its id, host, path, rule (null where none fits), verdict, and its host's trust and distrust."""
    prepare(pages.sparkSession)
    url = F.col(url_column)
    read = pages.select(host_of(url).alias("host"), path_of(url).alias("path"), F.col(html_column).alias("html")).filter("host <> ''")
    linked = read.select("host", "path", link_hosts(F.col("html"), F.col("host")).alias("to"))
    # one row a host and list of targets, and the paths that decide about seeds are counted after the rules are known
    seen = materialise(linked, "links")
    hosts = materialise(seen.groupBy("host").agg(F.count(F.lit(1)).alias("pages")), "hosts")
    ruled = materialise(hosts.join(fitting_rules(hosts, rules), "host", "left").select("host", "rules"), "rules")
    few = broadcast_if_small(ruled.filter("rules IS NOT NULL"), BROADCAST_HOSTS)
    fits = fitting(F.col("rules"), F.col("path"))["verdict"]
    counted = seen.select("host", "path").join(few, "host").groupBy("host").agg(F.count(F.when(fits == "allow", 1)).alias("trusted"), F.count(F.when(fits == "block", 1)).alias("blocked"))
    links = seen.select(F.col("host").alias("src"), F.explode("to").alias("dst"))
    mass = propagated(host_edges(links, hosts, parents), materialise(counted, "seeds"), damping, tolerance)
    known = materialise(ruled.join(mass, "host", "left").select("host", "rules", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("trust", "distrust"))), "judged")
    discard(seen)
    light = pages.select(F.col(id_column).alias("_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    joined = light.join(broadcast_if_small(known, BROADCAST_HOSTS), "host", "left").withColumn("fit", fitting(F.col("rules"), F.col("path")))
    method = F.when(F.coalesce(F.col("distrust") > F.lit(threshold) * F.col("trust"), F.lit(False)), "block").otherwise("allow")
    return joined.select(F.col("_id").alias(id_column), "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", method).alias("verdict"), "trust", "distrust")
