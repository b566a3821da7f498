from quarry.llm import urlfilter
from quarry.llm.queries import URL_RULES


def host_path(u):
    if u is None or "://" not in u:
        return "", ""
    rest = u.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    tail = rest[cut:]
    return host, tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]


def rule_of(host, path):
    fit = [(len(h + p), v == "allow", h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[2:] if fit else (None, None)


def node(u):
    h, p = host_path(u)
    if not h:
        return None
    rest = u.split("://", 1)[1].split("#")[0]
    return h + "//" + p + ("?" + rest.split("?", 1)[1] if "?" in rest else "")


def brute(urls, edges):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if node(a) and node(b):
            up[root(node(a))] = root(node(b))
    said = {}
    for n in list(up):
        h, rest = n.split("//", 1)
        said.setdefault(root(n), set()).add(rule_of(h, rest.split("?")[0])[1])
    out = []
    for u in urls:
        h, p = host_path(u)
        rule, verdict = rule_of(h, p)
        if verdict is None:
            s = said.get(root(node(u)), set()) if node(u) in up else set()
            verdict = "block" if "block" in s and "allow" not in s else "allow"
        out.append((h, p, rule, verdict))
    return out


URLS = [None, "", "no scheme", "http://A.Example.NET/en/1?x#y", "https://example.net", "https://example.net/", "http://q.com/a", "http://q.com/b", "http://q.com/c?d=1", "ftp://x.example.com/de/", "http://x.example.com/fr/", "http://w.org/fr/z", "http://w.org/x", "a://b://c/d", "http://notnet/", "http://u:p@h.net:80/en/", "http://k.com", "http://k.com/#f", "http:///en/", "http://É.org/fr/é"]
EDGES = [("http://q.com/a", "http://spam.net/x"), ("http://q.com/b", "http://q.com/a"), ("http://w.org/x", "http://w.org/fr/z"), ("http://w.org/x", "http://bad.net/"), ("http://k.com/", "http://bad.net/q"), (None, "http://q.com/c?d=1"), ("http://q.com/c?d=1", "none"), ("http://q.com/c?d=1", "http://q.com/c?d=1")]


def test_matches_brute_force(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").selectExpr("*", "'h' AS host", "1 AS rule")
    edges = spark.createDataFrame(EDGES, "src string, dst string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(pages, URL_RULES, edges).collect()}
    assert got == dict(enumerate(brute(URLS, EDGES)))
    assert "block" in {got[6][3], got[7][3]} and got[12][3] == "allow"
    none = {r.page_id: r.verdict for r in urlfilter.judge(pages, URL_RULES, edges.where("false")).collect()}
    assert none == {i: x[3] for i, x in enumerate(brute(URLS, []))}
    assert urlfilter.judge(pages.where("false"), [], None).count() == 0


def test_edges_of_pages(spark):
    html = ["<link rel='canonical' href=\"http://z.net/a\">", '<META HTTP-EQUIV="refresh" content="0; URL=/next">', '<link href=rel.html rel=canonical><link rel="icon" href="/i">', None, "refresh", "<link rel=canonical href='../z?a=1&amp;b=2'>", "<link rel=canonical href='//q.org/x'>", "<link rel=canonical href='http://[bad'>"]
    pages = spark.createDataFrame([(f"http://p{i}.com/a/b/c.html", h) for i, h in enumerate(html)], "url string, html string")
    got = {(r.src.split("/")[2], r.dst) for r in urlfilter.html_edges(pages).collect()}
    assert got == {("p0.com", "http://z.net/a"), ("p1.com", "http://p1.com/next"), ("p2.com", "http://p2.com/a/b/rel.html"), ("p5.com", "http://p5.com/a/z?a=1&b=2"), ("p6.com", "http://q.org/x")}
    assert urlfilter.html_edges(pages.where("false")).count() == 0


def test_a_bare_host_is_not_its_root_page(spark):
    pages = spark.createDataFrame([(1, "http://a.net"), (2, "http://a.net/")], "page_id long, url string")
    edges = spark.createDataFrame([("http://a.net/", "http://b.com/")], "src string, dst string")
    assert {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge(pages, URL_RULES, edges).collect()} == {1: (None, "allow"), 2: ("net/", "block")}
