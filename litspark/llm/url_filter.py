"""URL filters with link-graph propagation: trust from allowed seeds, distrust from blocked ones, a verdict per host.

Rules name a host (with all its subdomains) and the start of a path; the longest
that fits decides a page. Pages without a rule get their host's verdict: host
edges come from hyperlinks between hosts, and from every host to the domain that
contains it and back. Personalised PageRank spreads trust along the edges
from hosts with allowed pages, and distrust against them from hosts with blocked
pages, in a number of rounds or until no score changes by more than a small part
of itself; a host whose distrust exceeds its trust is blocked, however small both are.

A null url, or one without ``://``, has an empty host and path, fits no rule and
is allowed. Repeated rows are judged alike. Null html has no links. An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litspark.llm.common import small
from litspark.session import store

#: (verdict, host, start of the path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"))
DAMPING = 0.85
#: Rounds by default; the query and its SQL go on until the scores have settled.
ROUNDS = 10
#: Largest relative change in a round of settled scores; scores closer than ten times this are equal.
TOLERANCE = 1e-6
#: Changes below this are at the end of what a double holds.
_LEAST = 1e-290
#: Rounds between tables that cut the lineage.
STORE_EVERY = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"""(?i)\bhref\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def domains(host: Column, least: int) -> Column:
    """The host and the domains that contain it, down to ``least`` labels."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.when((host != "") & (n >= least), F.transform(
        F.sequence(F.lit(1), n - (least - 1)), lambda i: F.array_join(F.slice(labels, i, n), "."))).otherwise(
        F.array().cast("array<string>"))


def rules_by_host(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """``host`` and the array of the rules whose host fits it."""
    fits = hosts.select("host", F.explode(domains(F.col("host"), 1)).alias("_domain")).join(
        small(rules.select(F.col("host").alias("_domain"), "path", "verdict")), "_domain")
    return fits.groupBy("host").agg(F.collect_list(F.struct(
        (F.length("_domain") + F.length("path")).alias("n"), F.concat("_domain", "path").alias("rule"), "path", "verdict")).alias("_rules"))


def _longest() -> Column:
    fit = F.filter("_rules", lambda r: F.startswith(F.col("path"), r["path"]))
    return F.array_max(fit)


def host_edges(pages: DataFrame, hosts: DataFrame, html: str = "html") -> DataFrame:
    """``src, dst, w``: links between different hosts, and one step to and from the containing domain."""
    links = pages.select(F.col("host").alias("src"), F.explode(F.transform(
        F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(_LINK), 1),
        lambda h: F.translate(h, _UPPER, _LOWER))).alias("dst"))
    links = links.where("src != dst and src != '' and dst != ''").groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))
    every = hosts.select("host").union(links.select("dst")).distinct()
    chain = every.withColumn("_d", domains(F.col("host"), 2)).where(F.size("_d") > 1)
    up = chain.select(F.explode(F.arrays_zip(
        F.slice("_d", 1, F.size("_d") - 1).alias("src"), F.slice("_d", 2, F.size("_d") - 1).alias("dst"))).alias("e"))
    up = up.select("e.src", "e.dst").distinct()
    both = up.union(up.select("dst", "src")).withColumn("w", F.lit(1.0))
    return links.unionByName(both).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int | None = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """``host, trust, distrust`` from ``seeds(host, trust, distrust)``, each kind's seeds scaled to one.

    Trust follows the edges, distrust runs against them; both spread in one
    aggregation per round, for ``rounds`` or, if None, until all scores have
    settled. For that every host keeps a part of its score in a round, which has
    the same limit and damps the swing between a domain and its hosts.
    """
    kinds = edges.select(F.lit("trust").alias("kind"), "src", "dst", "w").union(
        edges.select(F.lit("distrust"), "dst", "src", "w"))
    out = kinds.groupBy("kind", "src").agg(F.sum("w").alias("_out"))
    steps = store(kinds.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("w") / F.col("_out") * damping).alias("p")), "url-steps")
    long = seeds.select("host", F.explode(F.create_map(
        F.lit("trust"), F.col("trust"), F.lit("distrust"), F.col("distrust"))).alias("kind", "s")).where("s > 0")
    total = long.groupBy("kind").agg(F.sum("s").alias("_all"))
    start = store(long.join(F.broadcast(total), "kind").select("kind", "host", (F.col("s") / F.col("_all")).alias("s")), "url-seeds")
    base = start.withColumn("s", F.col("s") * (1 - damping))
    if rounds is None:
        nodes = steps.select("kind", "src").union(steps.select("kind", "dst")).union(start.select("kind", "host")).distinct()
        loops = nodes.select("kind", "src", F.col("src").alias("dst"), F.lit(1 - 2 / (2 + damping)).alias("p"))
        steps = store(steps.withColumn("p", F.col("p") * (2 / (2 + damping))).unionByName(loops), "url-slow-steps")
        base = base.withColumn("s", F.col("s") * (2 / (2 + damping)))
    scores, steps = start, small(steps)
    done, settled = 0, False
    while done != rounds and not settled:
        sent = scores.select("kind", F.col("host").alias("src"), "s").join(steps, ["kind", "src"]).select(
            "kind", F.col("dst").alias("host"), (F.col("s") * F.col("p")).alias("s"),
            F.when(F.col("src") == F.col("dst"), F.col("s")).otherwise(0.0).alias("old"))
        scores = base.withColumn("old", F.lit(0.0)).unionByName(sent).groupBy("kind", "host").agg(F.sum("s").alias("s"), F.sum("old").alias("old"))
        done += 1
        if done % STORE_EVERY == 0:
            scores = store(scores, f"url-round-{done}")
            # A host reached for the first time had no score before, which is a change of all it has.
            change = F.abs(F.col("s") - F.col("old"))
            settled = rounds is None and scores.where((change > F.col("s") * TOLERANCE) & (change > _LEAST)).isEmpty()
    return scores.groupBy("host").agg(*[
        F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("s"))), F.lit(0.0)).alias(k) for k in ("trust", "distrust")])


def filter_urls(pages: DataFrame, rules=RULES, id_col: str = "page_id", url: str = "url", html: str = "html",
                rounds: int | None = ROUNDS) -> DataFrame:
    """Per page: id, ``host, path, rule, verdict``. ``rules`` is a table or (verdict, host, path) tuples; ``rounds`` None settles."""
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "verdict string, host string, path string")
    named = pages.select(F.col(id_col).alias("_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"),
                         F.col(html).alias("_html") if html in pages.columns else F.lit(None).cast("string").alias("_html"))
    hosts = store(named.select("host").distinct(), "url-hosts")
    ruled = hosts.join(rules_by_host(hosts, rules), "host", "left")
    ruled = store(ruled, "url-rules")
    light = named.drop("_html").join(small(ruled), "host", "left").withColumn("_hit", _longest()).select(
        "_id", "host", "path", F.col("_hit.rule").alias("rule"), F.col("_hit.verdict").alias("_verdict"))
    seeds = light.groupBy("host").agg(F.count_if(F.col("_verdict") == "allow").cast("double").alias("trust"),
                                      F.count_if(F.col("_verdict") == "block").cast("double").alias("distrust"))
    edges = host_edges(named.withColumnRenamed("_html", "html"), hosts)
    scores = propagate(edges, seeds.where("host != ''"), rounds)
    verdicts = store(scores.where(F.col("distrust") > F.col("trust") * (1 + 10 * TOLERANCE)).select("host", F.lit(True).alias("_bad")), "url-verdicts")
    return light.join(small(verdicts), "host", "left").select(
        F.col("_id").alias(id_col), "host", "path", "rule",
        F.coalesce("_verdict", F.when(F.col("_bad"), "block").otherwise("allow")).alias("verdict"))


def oracle(rounds: int = 400, damping: float = DAMPING) -> str:
    """The settled verdicts in SQL: the slowed walk of :func:`propagate` as a recursion, its base as edges from a node of its own."""
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    slow = 2 / (2 + damping)
    return rf"""
    WITH RECURSIVE rules(verdict, rh, rp) AS (VALUES {rules}),
    named AS (SELECT page_id, html, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 1, 's'), '{_UPPER}', '{_LOWER}') host,
        regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 2, 's') path FROM pages),
    light AS MATERIALIZED (SELECT n.page_id, n.host, n.path,
        (SELECT max_by(rh || rp, length(rh || rp)) FROM rules WHERE (n.host = rh OR suffix(n.host, '.' || rh)) AND starts_with(n.path, rp)) AS rule,
        (SELECT max_by(verdict, length(rh || rp)) FROM rules WHERE (n.host = rh OR suffix(n.host, '.' || rh)) AND starts_with(n.path, rp)) AS v
        FROM named n),
    links AS (SELECT host src, lower(unnest(regexp_extract_all(html, '(?i)\bhref\s*=\s*["'']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"''\s>]+)', 1))) dst FROM named),
    chain(h) AS (SELECT host FROM named WHERE host <> '' UNION SELECT dst FROM links UNION
        SELECT substr(h, position('.' IN h) + 1) FROM chain WHERE len(string_split(h, '.')) > 2),
    up AS (SELECT DISTINCT h src, substr(h, position('.' IN h) + 1) dst FROM chain WHERE len(string_split(h, '.')) > 2),
    edges AS (SELECT src, dst, sum(w) w FROM (SELECT src, dst, 1.0::DOUBLE w FROM links WHERE src <> dst AND src <> '' AND dst <> ''
        UNION ALL SELECT src, dst, 1.0 FROM up UNION ALL SELECT dst, src, 1.0 FROM up) GROUP BY ALL),
    kinds AS (SELECT 'trust' kind, src, dst, w FROM edges UNION ALL SELECT 'distrust', dst, src, w FROM edges),
    p AS MATERIALIZED (SELECT kind, src, dst, w / sum(w) OVER (PARTITION BY kind, src) * {damping} p FROM kinds),
    seeds AS (SELECT CASE v WHEN 'allow' THEN 'trust' ELSE 'distrust' END kind, host, count(*)::DOUBLE s FROM light WHERE v IS NOT NULL GROUP BY ALL),
    s0 AS MATERIALIZED (SELECT kind, host, s / sum(s) OVER (PARTITION BY kind) s FROM seeds),
    nodes AS (SELECT kind, src h FROM p UNION SELECT kind, dst FROM p UNION SELECT kind, host FROM s0),
    steps AS MATERIALIZED (SELECT kind, src, dst, p * {slow} p FROM p UNION ALL SELECT kind, h, h, {1 - slow} FROM nodes
        UNION ALL SELECT kind, ' ', host, s * {(1 - damping) * slow} FROM s0 UNION ALL SELECT DISTINCT kind, ' ', ' ', 1.0 FROM s0),
    walk(kind, host, s, r) AS (SELECT kind, host, s, 0 FROM s0 UNION ALL SELECT DISTINCT kind, ' ', 1.0::DOUBLE, 0 FROM s0 UNION ALL
        SELECT w.kind, t.dst, sum(w.s * t.p), w.r + 1 FROM walk w JOIN steps t ON t.kind = w.kind AND t.src = w.host
        WHERE w.r < {rounds} GROUP BY w.kind, t.dst, w.r),
    bad AS (SELECT host FROM walk WHERE r = {rounds} GROUP BY host
        HAVING coalesce(sum(s) FILTER (kind = 'distrust'), 0) > coalesce(sum(s) FILTER (kind = 'trust'), 0) * {1 + 10 * TOLERANCE})
    SELECT page_id, host, path, rule, coalesce(v, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM light"""
