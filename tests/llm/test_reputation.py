import math
from collections import defaultdict

from boughs.llm import reputation
from llm.conftest import rows_of

URLS = [
    ("http://a.Example.ORG/es/1?q=/x#y", "a.example.org", "/es/1", "example.org/es/", "block"),
    ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
    ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
    ("http://notexample.org", "notexample.org", "", None, None),
    ("ftp://x.com?u=http://b.org/", "x.com", "", None, None),
    ("https://x.com/de/#a", "x.com", "/de/", "com/de/", "block"),
    ("https://x.com/fr/a", "x.com", "/fr/a", "com/fr/", "allow"),
    ("://org/", "org", "/", "org/", "allow"),
    ("no host", "", "", None, None),
    ("", "", "", None, None),
    (None, "", "", None, None),
    ("http://Ärger.com\n/x\ny?z", "Ärger.com\n", "/x\ny", None, None),
    ("http://u@h.co.uk:80/a://b", "u@h.co.uk:80", "/a://b", None, None),
]


def test_urls_and_rules(spark):
    pages = spark.createDataFrame([(i, u[0], "h", "r") for i, u in enumerate(URLS)], "page_id bigint, url string, host string, rule string")
    outcomes = spark.createDataFrame([], "page_id bigint, good boolean")
    got = sorted(reputation.judge_urls(pages.select("page_id", "url"), outcomes).collect())
    for r, (_, host, path, rule, verdict) in zip(got, URLS, strict=True):
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")


def test_registered_domains(spark):
    hosts = {"a.b.example.com": ("example.com", "com"), "x.co.uk": ("x.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"),
             "localhost": ("localhost", "localhost"), "1.2.3.4:80": ("1.2.3.4", "ip"), "": ("", ""), "u@h.x.de:8": ("x.de", "de")}
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    domain, suffix = reputation.registered_domain(df["host"])
    for r in df.select("host", domain.alias("d"), suffix.alias("s")).collect():
        assert (r.d, r.s) == hosts[r.host]


def _plain(hosts):
    """host -> (n, k, domain, suffix)  ->  host -> (mean, lower), by loops."""
    n, k = sum(h[0] for h in hosts.values()), sum(h[1] for h in hosts.values())

    def shrink(groups, parent):
        top = sum((g[1] - g[0] * parent(x)) ** 2 for x, g in groups.items())
        base = sum(g[0] * parent(x) * (1 - parent(x)) for x, g in groups.items())
        spread = sum(g[0] * (g[0] - 1) * parent(x) * (1 - parent(x)) for x, g in groups.items())
        rho = min(max((top - base) / spread if spread else 0, 0.001), 0.5)
        return 1 / rho - 1

    def sums(key):
        out = defaultdict(lambda: [0, 0])
        for h in hosts.values():
            out[key(h)][0] += h[0]
            out[key(h)][1] += h[1]
        return out

    root = (k + 1) / (n + 2)
    by_suffix, by_domain = sums(lambda h: h[3]), sums(lambda h: h[2:])
    m = shrink(by_suffix, lambda _: root)
    suffix = {s: (g[1] + m * root) / (g[0] + m) for s, g in by_suffix.items()}
    m = shrink(by_domain, lambda d: suffix[d[1]])
    domain = {d: (g[1] + m * suffix[d[1]]) / (g[0] + m) for d, g in by_domain.items()}
    m = shrink(hosts, lambda h: domain[hosts[h][2:]])
    out = {}
    for h, (hn, hk, d, s) in hosts.items():
        a, b = hk + m * domain[d, s], hn - hk + m * (1 - domain[d, s])
        mean = a / (a + b)
        out[h] = mean, mean - 1.645 * math.sqrt(mean * (1 - mean) / (a + b + 1))
    return out


def test_reputation_equals_plain_shrinkage(spark):
    rows, outcomes, hosts, i = [], [], {}, 0
    for j, (domain, suffix) in enumerate([("a.com", "com"), ("b.com", "com"), ("c.org", "org"), ("d.co.uk", "co.uk")]):
        for sub in range(3):
            host, n = f"s{sub}.{domain}", 4 + 7 * sub
            bad = n if j == 1 else j * sub
            for p in range(n):
                rows.append((i, host))
                outcomes += [(i, p >= bad)] * (1 + p % 2)
                i += 1
            rows.append((i, host))
            i += 1
            hosts[host] = (n, n - min(bad, n), domain, suffix)
    rows.append((None, "new.net"))
    hosts["new.net"] = (0, 0, "new.net", "net")
    outcomes += [(None, True), (3, None), (10**6, False)]
    pages = spark.createDataFrame(rows, "page_id bigint, host string")
    known = spark.createDataFrame(outcomes, "page_id bigint, good boolean")
    want = _plain(hosts)
    got = {r.host: r for r in reputation.host_reputation(pages, known).collect()}
    assert set(got) == set(want)
    for h, (mean, lower) in want.items():
        assert math.isclose(got[h]["mean"], mean, abs_tol=1e-6) and math.isclose(got[h].lower, lower, abs_tol=1e-6)
    assert got["s2.b.com"].lower < 0.5 < got["s2.a.com"].lower


def test_empty_table_and_native_plan(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string")
    out = reputation.judge_urls(pages, spark.createDataFrame([(1, True)], "page_id bigint, good boolean"))
    assert rows_of(out, "page_id") == []
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
