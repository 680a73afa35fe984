"""URL filters in native operations: path rules first, then trust and distrust spread over a graph of hosts.

A rule names a host, with all its subdomains, and the beginning of a path; of
the rules that fit, the longest decides. Where none fits, the host decides.
Hosts are joined by the links of their pages (absolute ones; a link inside a
host says nothing about it) and to the domain above them, both ways. Trust is
personalised PageRank from the hosts whose pages the rules allow, along the
links; distrust is the same from the hosts whose pages the rules block,
against the links. A host is blocked if its distrust is more than MOST_TIMES
its trust.

Mass is counted in whole units, UNIT of them in all, and every flow, computed
from whole counts of pages, is rounded down to units, so results don't depend
on the order of rows. An edge is without flow only where its host has fewer
units than it has links: with a hundred million hosts a mean host has ten
thousand million units. Each round is two
joins of hosts and edges; ranks are checkpointed every CHECKPOINT_ROUNDS.
There are ROUNDS rounds at least, and more until a round reaches no new host
and changes no host's mass by more than TOLERANCE units.

Up to MOST_INLINE rules are one expression; more of them are joined with the
domains of the different hosts, and each host keeps those that may fit it.

Cases: a null url, or one without `://`, has an empty host and path, fits no
rule and is allowed, as is any host without mass; null html has no links;
repeated rows are judged one by one and count as pages; of equally long rules
the first in order of text decides; of equal rules that differ in verdict, a
block; without rules that fit, all is allowed; an empty table gives an empty
table; further columns are not read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linecue.llm.common import checkpointed, joined_apart, table

UNIT = 1_000_000_000_000_000_000
ROUNDS, CHECKPOINT_ROUNDS = 12, 4
#: Units, a millionth of all mass.
TOLERANCE = UNIT // 1_000_000
#: Hundredths of the mass that follow edges; the rest returns to the seeds.
DAMPING = 85
MOST_TIMES = 9
#: Rules that are one expression; more are joined.
MOST_INLINE = 200
#: Rows of hosts that are broadcast to judge the pages; more are joined in a shuffle.
MOST_BROADCAST = 200_000
#: Hosts whose masses are broadcast in each round; more are joined in a shuffle.
MOST_SPREAD = 100_000
#: Edges, or hosts, that one task of a round takes: a graph is small beside its pages, and each task of a shuffle leaves files.
EDGES_A_TASK = 250_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)(?:href|src)\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""


@dataclass(frozen=True)
class Rule:
    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return self.text[len(self.host) :]


RULES = [Rule("block", "com/en/"), Rule("allow", "example.com/en/7"), Rule("allow", "net/de/"), Rule("block", "example.net/de/8"), Rule("block", "org/es/")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def longest_first(rules: list[Rule]) -> list[Rule]:
    """Different rules in the order in which they are tried."""
    return sorted({r.text: r for r in sorted(rules, key=lambda r: r.verdict == "block")}.values(), key=lambda r: (-len(r.text), r.text))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct<text, verdict> of the longest rule that fits, or null; of equally long ones the first in order of text."""
    out = F.lit(None).cast("struct<text:string,verdict:string>")
    for r in reversed(longest_first(rules)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("text"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def ruled(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """rows (host, path, further columns) with fit, the rule that decides."""
    if len(rules) <= MOST_INLINE:
        return rows.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    ordered = longest_first(rules)
    table = rows.sparkSession.createDataFrame([(k, r.host, r.path, r.text, r.verdict) for k, r in enumerate(ordered)], "k long, domain string, path string, text string, verdict string")
    labels = F.split("host", r"\.")
    every = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    hosts = rows.where("host <> ''").select("host").distinct().select("host", F.explode(every).alias("domain"))
    known = hosts.join(table, "domain").groupBy("host").agg(F.sort_array(F.collect_list(F.struct("k", "path", "text", "verdict"))).alias("rules"))
    first = F.get(F.filter("rules", lambda r: F.col("path").startswith(r["path"])), F.lit(0))
    return joined_apart(rows, known, "host", "left").withColumn("fit", F.when(first.isNotNull(), F.struct(first["text"].alias("text"), first["verdict"].alias("verdict")))).drop("rules")


def parent(host: Column) -> Column:
    """The domain above a host of three labels or more, else null."""
    return F.when(F.size(F.split(host, r"\.")) > 2, F.regexp_replace(host, r"^[^.]*\.", ""))


def host_edges(pages: DataFrame) -> DataFrame:
    """(a, b, pages): pages of a that link to b, and 1 for the domain above, both ways. pages: host, html."""
    found = F.transform(F.regexp_extract_all(F.col("html"), F.lit(LINK), 1), lambda h: F.translate(h, UPPER, LOWER))
    linked = pages.where("host <> ''").select(F.col("host").alias("a"), F.explode(F.array_distinct(found)).alias("b"))
    linked = linked.groupBy("a", "b").agg(F.count("*").alias("pages"))
    hosts = linked.select("a").union(linked.select("b")).union(pages.where("host <> ''").groupBy("host").count().select("host")).distinct().toDF("host")
    step = hosts.select(F.explode(domains("host")).alias("a")).distinct().select("a", parent(F.col("a")).alias("b")).where("b is not null")
    both = step.union(step.select("b", "a")).withColumn("pages", F.lit(1).cast("long"))
    return linked.union(both).where("a <> b").groupBy("a", "b").agg(F.sum("pages").alias("pages"))


def domains(host: str) -> Column:
    """The host and all domains of two labels or more above it."""
    labels = F.split(F.col(host), r"\.")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


def gathered(rows: DataFrame, n: int) -> DataFrame:
    """n rows in no more partitions than EDGES_A_TASK asks for."""
    return rows.coalesce(n // EDGES_A_TASK + 1)


def spread(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(host, mass) after `rounds` of personalised PageRank, or more until it has settled; edges: a, b, pages; seeds: host, pages."""
    n_edges, n_seeds = edges.count(), seeds.count()
    edges, seeds = gathered(edges, n_edges), gathered(seeds, n_seeds)
    n_hosts = n_seeds + edges.agg(F.count_distinct("b")).first()[0]
    total = seeds.agg(F.sum("pages").alias("all"))
    start = seeds.join(F.broadcast(total)).select("host", F.floor(F.lit(float(UNIT)) * (F.col("pages") / F.col("all"))).cast("long").alias("seed"))  # one row is broadcast
    out = edges.groupBy("a").agg(F.sum("pages").alias("out"))
    shares = checkpointed(gathered(edges.join(out, "a").select("a", "b", "pages", "out"), n_edges))
    start = checkpointed(start)
    mass = start.select("host", F.col("seed").alias("mass"))
    none, reached, k = F.lit(0).cast("long"), -1, 0
    while True:
        k += 1
        settling = k % CHECKPOINT_ROUNDS == 0
        flow = F.expr("cast(mass as decimal(19,0)) * cast(pages as decimal(18,0)) div cast(out as decimal(18,0))")
        known = F.broadcast(mass) if n_hosts <= MOST_SPREAD else mass
        rows = shares.join(known, shares.a == mass.host).select(F.col("b").alias("host"), flow.alias("flow"), none.alias("seed"), none.alias("before"))
        rows = rows.union(start.select("host", none, "seed", none))
        if settling:
            rows = rows.union(mass.select("host", none, none, "mass"))
        mass = rows.groupBy("host").agg(F.expr(f"({DAMPING} * cast(sum(flow) as decimal(19,0)) + {100 - DAMPING} * cast(sum(seed) as decimal(19,0))) div 100").alias("mass"), F.sum("before").alias("before"))
        if settling:
            mass = checkpointed(gathered(mass, n_hosts))
            now = mass.where("mass > 0 or before > 0").agg(F.count(F.when(F.col("mass") > 0, 1)), F.max(F.abs(F.col("mass") - F.col("before"))), F.count(F.when((F.col("mass") > 0) & (F.col("before") == 0), 1))).first()
            if k >= rounds and now[0] == reached and not now[2] and (now[1] or 0) <= TOLERANCE:
                return mass.select("host", "mass")
            reached = now[0]
        mass = mass.select("host", "mass")


def judge(pages: DataFrame, rules: list[Rule] = RULES, rounds: int = ROUNDS) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page; pages: page_id, url, html."""
    host, path = host_and_path(F.col("url").cast("string"))
    rows = ruled(pages.select("page_id", host.alias("host"), path.alias("path"), F.col("html").cast("string").alias("html")), rules)
    edges = checkpointed(host_edges(rows))
    seeds = checkpointed(rows.where("fit is not null").groupBy("host", F.col("fit.verdict").alias("ruled")).agg(F.count("*").alias("pages")))
    trust = spread(edges, seeds.where("ruled = 'allow'").select("host", "pages"), rounds)
    distrust = spread(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "pages"), seeds.where("ruled = 'block'").select("host", "pages"), rounds)
    blocked = distrust.withColumnRenamed("mass", "distrust").join(trust, "host", "left").where(F.col("distrust") > MOST_TIMES * F.coalesce("mass", F.lit(0)))
    blocked = checkpointed(blocked.select("host", F.lit(True).alias("blocked")))
    few = blocked.count() <= MOST_BROADCAST
    judged = rows.select("page_id", "host", "path", "fit").join(F.broadcast(blocked) if few else blocked, "host", "left")
    return judged.select("page_id", "host", "path", F.col("fit.text").alias("rule"), F.coalesce("fit.verdict", F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url."""
    return judge(table(spark, sf_dir, "pages"))


def _sql_spread(name: str, a: str, b: str, verdict: str) -> str:
    ctes = [
        f"{name}_seed AS (SELECT host, CAST(floor({UNIT}.0::DOUBLE * (pages::DOUBLE / sum(pages) OVER ()::DOUBLE)) AS BIGINT) AS seed FROM seeds WHERE ruled = '{verdict}')",
        f"{name}_share AS (SELECT {a} AS a, {b} AS b, pages::HUGEINT AS pages, (sum(pages) OVER (PARTITION BY {a}))::HUGEINT AS out FROM edges)",
        f"{name}_0 AS (SELECT host, seed AS mass FROM {name}_seed)",
    ]
    for k in range(1, ROUNDS + 1):
        ctes.append(
            f"{name}_{k} AS (SELECT host, CAST(({DAMPING} * sum(flow) + {100 - DAMPING} * sum(seed)) // 100 AS BIGINT) AS mass FROM ("
            f"SELECT b AS host, mass * pages // out AS flow, 0 AS seed FROM {name}_share JOIN {name}_{k - 1} ON a = host UNION ALL SELECT host, 0, seed FROM {name}_seed) GROUP BY host)"
        )
    return ",\n".join(ctes)


def _sql_rules() -> str:
    fits = lambda r: f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.text}'"
    return "CASE " + " ".join(map(fits, longest_first(RULES))) + " END"


ORACLE = f"""
WITH RECURSIVE cut AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut),
named AS (SELECT page_id, html, coalesce(host, '') AS host, coalesce(path, '') AS path FROM parts),
fitted AS (SELECT *, {_sql_rules()} AS rule FROM named),
ruled AS (SELECT *, CASE rule {" ".join(f"WHEN '{r.text}' THEN '{r.verdict}'" for r in RULES)} END AS ruled FROM fitted),
links AS (
  SELECT host AS a, unnest(list_distinct(list_transform(regexp_extract_all(html, '(?i)(?:href|src)\\s*=\\s*["'']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"''\\s<>]+)', 1), lambda h: translate(h, '{UPPER}', '{LOWER}')))) AS b FROM ruled WHERE host <> ''),
linked AS (SELECT a, b, count(*) AS pages FROM links GROUP BY ALL),
hosts AS (SELECT a AS host FROM linked UNION SELECT b FROM linked UNION SELECT host FROM ruled WHERE host <> ''
  UNION SELECT regexp_replace(host, '^[^.]*\\.', '') FROM hosts WHERE len(string_split(host, '.')) > 2),
ups AS (SELECT DISTINCT host AS a, regexp_replace(host, '^[^.]*\\.', '') AS b FROM hosts WHERE len(string_split(host, '.')) > 2),
edges AS (SELECT a, b, CAST(sum(pages) AS BIGINT) AS pages FROM (SELECT * FROM linked UNION ALL SELECT a, b, 1 FROM ups UNION ALL SELECT b, a, 1 FROM ups) WHERE a <> b GROUP BY ALL),
seeds AS (SELECT host, ruled, count(*) AS pages FROM ruled WHERE ruled IS NOT NULL GROUP BY ALL),
{_sql_spread("trust", "a", "b", "allow")},
{_sql_spread("distrust", "b", "a", "block")},
blocked AS (SELECT d.host FROM distrust_{ROUNDS} d LEFT JOIN trust_{ROUNDS} t USING (host) WHERE d.mass > {MOST_TIMES} * coalesce(t.mass, 0))
SELECT page_id, r.host, path, rule, coalesce(ruled, CASE WHEN b.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled r LEFT JOIN blocked b ON r.host = b.host"""
