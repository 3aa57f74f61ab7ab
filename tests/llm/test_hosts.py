"""URL parts, rules and link scores against plain Python."""

import re

from barloom.llm import hosts

URLS = [
    "https://Blog.Example.NET/en/1.html?q=/de/#x", "http://a.net", "http://a.net/", "http://net/", "http://xnet/", "HTTP://EXAMPLE.com/de/x",
    "http://m.example.com/DE/x", "http://example.com?x=/de/", "http://o.org/fr/", "http://org/fr#a/b", "ftp://é.org/fr/ü?y", "no scheme/net/",
    "//a.net/x", "", None, "a://b://c/d", "http://example.net/en", "http:///net/",
]


def parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def judge(url):
    host, path = parts(url)
    fit = [r for r in hosts.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: len(r.name), default=None)
    return (host, path, best and best.name, best and best.verdict)


def test_rules(spark):
    df = spark.createDataFrame([(i, u, None, "x") for i, u in enumerate(URLS)], "page_id long, url string, html string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in hosts.url_verdicts(df).collect()}
    for i, u in enumerate(URLS):
        host, path, rule, verdict = judge(u)
        assert got[i][:3] == (host, path, rule) and got[i][3] == (verdict or got[i][3]) and got[i][3] in ("allow", "block")
    assert got[11][3] == got[14][3] == "allow"


def spread(seeds, links, rounds=200):
    trust, distrust = {h: s[0] for h, s in seeds.items()}, {h: s[1] for h, s in seeds.items()}
    out, into = {}, {}
    for (a, b), n in links.items():
        out[a], into[b] = out.get(a, 0) + n, into.get(b, 0) + n
    for _ in range(rounds):
        t, d = {h: s[0] for h, s in seeds.items()}, {h: s[1] for h, s in seeds.items()}
        for (a, b), n in links.items():
            t[b] += 0.85 * trust[a] * n / out[a]
            d[a] += 0.85 * distrust[b] * n / into[b]
        trust, distrust = t, d
    return trust, distrust


def test_trust_and_distrust_spread_over_links(spark):
    link = lambda *u: " ".join(f'<A class="x" HREF = "{x}">y</a>' for x in u)
    pages = [
        ("http://good.org/fr/1", link("http://friend.com/x", "/local", "//Friend.com")),
        ("http://friend.com/1", link("http://good.org/", "https://far.com")),
        ("http://far.com/", link("far.html")),
        ("http://farm.com/", link("http://spam.net/a", "http://spam.net/b", "http://friend.com/")),
        ("http://spam.net/", None),
        ("http://farm2.com/", link("http://farm.com")),
        ("http://half.example.com/de/", ""), ("http://half.example.com/en/", "<a href='mailto:x@y'>"), ("http://half.example.com/en/2", ""),
    ]
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    links = {(r.src, r.dst): r.n for r in hosts.host_links(df).collect()}
    assert links == {("good.org", "friend.com"): 1, ("friend.com", "good.org"): 1, ("friend.com", "far.com"): 1, ("farm.com", "spam.net"): 1, ("farm.com", "friend.com"): 1, ("farm2.com", "farm.com"): 1}
    own = {}
    for u, _ in pages:
        own.setdefault(parts(u)[0], []).append(judge(u)[3])
    seeds = {h: (v.count("allow") / len(v), v.count("block") / len(v)) for h, v in own.items()}
    trust, distrust = spread(seeds, links)
    rows = hosts.url_verdicts(df).collect()
    for r in rows:
        assert abs(r.trust - trust[r.host]) < 1e-4 and abs(r.distrust - distrust[r.host]) < 1e-4
    verdict = {r.page_id: r.verdict for r in rows}
    assert verdict == {0: "allow", 1: "allow", 2: "allow", 3: "block", 4: "block", 5: "block", 6: "block", 7: "allow", 8: "allow"}


def test_empty_table_and_plan(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    df = hosts.url_verdicts(none)
    assert df.count() == 0
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
