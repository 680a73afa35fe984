import re
from collections import Counter, defaultdict

from linecue.llm import url_filter as uf
from tests.llm.oracle import same_as_duckdb


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return lower(host), re.match(r"[^?#]*", rest[len(host) :])[0]


def brute(pages, rules=uf.RULES):
    fitted, links, seeds = [], Counter(), {"allow": Counter(), "block": Counter()}
    for page, url, html in pages:
        host, path = split(url)
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rule = min(fits, key=lambda r: (-len(r.text), r.text), default=None)
        fitted.append((page, host, path, rule))
        if host:
            links.update({(host, lower(b)): 1 for b in set(re.findall(uf.LINK, html or ""))})
        if rule:
            seeds[rule.verdict][host] += 1
    hosts = {h for e in links for h in e} | {h for _, h, _, _ in fitted if h}
    for h in list(hosts):
        while h.count(".") > 1:
            up = h.partition(".")[2]
            hosts.add(up)
            h = up
    edges = Counter(links)
    for h in hosts:
        if h.count(".") > 1:
            up = h.partition(".")[2]
            edges[h, up] += 1
            edges[up, h] += 1
    edges = {e: n for e, n in edges.items() if e[0] != e[1] and n}

    def spread(edges, seeds):
        total, out = seeds.total(), Counter()
        for (a, _), n in edges.items():
            out[a] += n
        seed = {h: int(float(uf.UNIT) * (n / total)) for h, n in seeds.items()}
        mass = dict(seed)
        for _ in range(uf.ROUNDS):
            flow = defaultdict(int)
            for (a, b), n in edges.items():
                flow[b] += mass.get(a, 0) * n // out[a]
            mass = {h: (uf.DAMPING * flow[h] + (100 - uf.DAMPING) * seed.get(h, 0)) // 100 for h in {*flow, *seed}}
        return mass

    trust = spread(edges, seeds["allow"])
    distrust = spread({(b, a): n for (a, b), n in edges.items()}, seeds["block"])
    bad = {h for h, m in distrust.items() if m > uf.MOST_TIMES * trust.get(h, 0)}
    return sorted(((p, h, path, r and r.text, r.verdict if r else "block" if h in bad else "allow") for p, h, path, r in fitted), key=str)


PAGES = [
    (1, "http://A.Example.com/en/1?x", '<a href="http://b.spam.io/x">'),
    (2, "https://a.example.com/en/71#y", "<a HREF = '//Good.org/'><img src=http://good.org:80/a>"),
    (3, "http://com/en/", None),
    (4, "http://xcom/en/", ""),
    (5, "http://q.net/de/8", '<a href="http://friend.io"> <a href="/own">'),
    (6, "http://z.example.net/de/8/1", "src=//a.example.com"),
    (7, "http://b.spam.io/", '<a href="http://com/en/">'),
    (8, "http://friend.io/p?://x", '<a href="http://q.net">'),
    (9, None, "x"),
    (10, "no scheme", "y"),
    (11, "http://", None),
    (12, "://h?a/b", None),
    (13, "http://deep.er.still.b.spam.io/#", '<a href="http://B.spam.io"> <a href="http://b.spam.io/2">'),
    (14, "HTTP://ÄB.ORG/es/\n", None),
    (14, "HTTP://ÄB.ORG/es/\n", None),
    (None, "http://a.example.com/fr/", None),
    (16, "http://only.org/es/1", None),
    (17, "http://only.org/x", None),
    (18, "http://sub.only.org/fr", None),
    (15, "http://" + "h" * 5000 + "/" + "p" * 50_000, "z" * 50_000),
]


def test_pages_equal_a_plain_computation(spark):
    df = spark.createDataFrame([(*p, "r") for p in PAGES], "page_id long, url string, html string, rule string").repartition(3)
    got = sorted(map(tuple, uf.judge(df).collect()), key=str)
    assert got == brute(PAGES)
    assert {r[4] for r in got if r[3] is None} == {"allow", "block"}


def test_no_rules_and_empty_table(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    assert {(r.rule, r.verdict) for r in uf.judge(df, rules=[]).collect()} == {(None, "allow")}
    assert uf.judge(df.where("false")).count() == 0


def test_thousands_of_rules(spark):
    rules = [uf.Rule(("allow", "block")[k % 2], f"h{k % 700}.d{k % 7}.org/{'ab'[k % 2] * (k % 5)}") for k in range(5000)] + [uf.Rule("block", "org/x"), uf.Rule("allow", "d3.org/x"), uf.Rule("block", "d4.org/y"), uf.Rule("block", "d4.org/a")]
    rules = list({r.text: r for r in rules}.values())
    pages = [(i, f"http://www.h{i % 900}.d{i % 9}.org/{'ab'[i % 2] * (i % 6)}{'x' * (i % 3 == 0)}", None) for i in range(400)] + [(i, f"http://q{i}.d{i % 9}.org/{'xyab'[i % 4]}", "") for i in range(400, 500)]
    assert len(rules) > uf.MOST_INLINE
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    ruled = lambda rows: sorted(tuple(r) for r in rows if r[3] is not None)
    got = uf.judge(df, rules).collect()
    assert len(got) == len(pages) and ruled(got) == ruled(brute(pages, rules))


def test_ties_and_equal_rules(spark):
    df = spark.createDataFrame([("a.b.org", "/xy")], "host string, path string")
    rules = [uf.Rule("allow", "org/x"), uf.Rule("block", "org/x"), uf.Rule("block", "b.org"), uf.Rule("allow", "org/y")]
    for most in (rules, rules * 100):
        assert tuple(uf.ruled(df, most).first().fit) == ("b.org", "block")
        assert tuple(uf.ruled(df, most[:2] * 150).first().fit) == ("org/x", "block")


def test_query_equals_sql(spark):
    same_as_duckdb(uf.op10_url_filter, uf.ORACLE, spark, "/root/testdata/sf0.01")


def test_rare_edges_and_far_hosts_get_mass(spark):
    far = [(f"h{k}.io", f"h{k + 1}.io", 1) for k in range(20)]
    edges = spark.createDataFrame([("hot.io", "common.io", 5_000_000), ("hot.io", "rare.io", 1), *far], "a string, b string, pages long")
    seeds = spark.createDataFrame([("hot.io", 1), ("h0.io", 1)], "host string, pages long")
    got = {r.host: r.mass for r in uf.spread(edges, seeds).collect()}
    assert got["rare.io"] == 85 * (uf.UNIT // 2 * 15 // 100 // 5_000_001) // 100 > 0
    assert got["common.io"] > got["rare.io"] and got["h20.io"] > 0


def test_a_small_graph_is_not_spread_in_as_many_tasks_as_its_pages_had(spark, monkeypatch):
    far = [(f"h{k}.io", f"h{k + 1}.io", 1 + k % 3) for k in range(200)]
    edges = spark.createDataFrame(far, "a string, b string, pages long").repartition(50)
    seeds = spark.createDataFrame([("h0.io", 1), ("h50.io", 2)], "host string, pages long").repartition(50)
    spark.sparkContext.setJobGroup("small graph", "")
    got = {r.host: r.mass for r in uf.spread(edges, seeds).collect()}
    track = spark.sparkContext.statusTracker()
    jobs = [track.getJobInfo(j) for j in track.getJobIdsForGroup("small graph")]
    tasks = [stage.numTasks for job in jobs for k in job.stageIds if (stage := track.getStageInfo(k))]
    spark.sparkContext.setJobGroup("", "")
    assert len(tasks) > uf.ROUNDS and tasks.count(50) <= 4
    monkeypatch.setattr(uf, "MOST_SPREAD", 0)
    assert {r.host: r.mass for r in uf.spread(edges, seeds).collect()} == got


def test_a_hub_gives_to_each_of_its_neighbours(spark):
    edges = spark.range(50_000).selectExpr("'hub.io' AS a", "concat('n', id, '.io') AS b", "1L + id % 3 AS pages")
    seeds = spark.createDataFrame([("hub.io", 1)], "host string, pages long")
    got = uf.spread(edges, seeds, 4).where("host <> 'hub.io'").groupBy("mass").count().orderBy("mass").collect()
    out = sum(1 + i % 3 for i in range(50_000))
    assert [(r.mass, r["count"]) for r in got] == [(85 * (uf.UNIT * 15 // 100 * n // out) // 100, (50_000 + 3 - n) // 3) for n in (1, 2, 3)]


def test_a_poor_hub_among_many_seeds_gives_to_each_of_its_neighbours(spark):
    links = 300_000
    edges = spark.range(links).selectExpr("'hub.io' AS a", "concat('n', id, '.io') AS b", "1L AS pages")
    seeds = spark.createDataFrame([("hub.io", 2), *((f"s{k}.io", 500_000) for k in range(2_000))], "host string, pages long")
    got = uf.spread(edges, seeds, 4)
    hub = int(float(uf.UNIT) * (2 / 1_000_000_002)) * 15 // 100
    assert hub < 10**12 and got.where("host = 'hub.io'").first().mass == hub
    shares = got.where("host LIKE 'n%'").groupBy("mass").count().collect()
    assert [(r.mass, r["count"]) for r in shares] == [(85 * (hub // links) // 100, links)] and hub // links > 0
