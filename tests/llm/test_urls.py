import random

from tabsieve.llm import urls

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("bad.org", "/", "block"), ("good.org", "/", "allow")]


def rules(spark):
    return spark.createDataFrame(RULES, "host string, path string, verdict string")


def brute(all_urls, links):
    """Verdicts by plain parsing and a walk over the links."""
    def parts(u):
        if u is None or "://" not in u:
            return "", ""
        rest = u.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        path = rest[cut:]
        end = min([path.find(c) for c in "?#" if c in path], default=len(path))
        return ''.join(chr(ord(c) + 32) if 'A' <= c <= 'Z' else c for c in rest[:cut]), path[:end]

    def own(u):
        host, path = parts(u)
        fits = [(h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits, key=lambda f: len(f[0]), default=(None, None))
    group = {u: {u} for u in all_urls}
    for a, b in links:
        merged = group.setdefault(a, {a}) | group.setdefault(b, {b})
        for u in merged:
            group[u] = merged
    out = {}
    for u in all_urls:
        verdicts = {own(x)[1] for x in group[u]}
        inherited = "block" if "block" in verdicts and "allow" not in verdicts else "allow"
        out[u] = (*parts(u), own(u)[0], own(u)[1] or inherited)
    return out


def test_decisions_reach_aliases_equal_to_brute_force(spark):
    rng = random.Random(1)
    hosts = ["a.com", "b.com", "c.com", "x.net", "y.example.net", "bad.org", "sub.bad.org", "good.org", "d.io"]
    known = [f"http://{h}/{p}" for h in hosts for p in ("en/1", "de/2", "3")]
    links = [tuple(rng.sample(known, 2)) for _ in range(9)]
    rows = [(k, u, None) for k, u in enumerate(known)]
    found = urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), rules(spark), "page_id", "url", "html",
                             spark.createDataFrame([*links, (None, known[0])], "src string, dst string")).collect()
    want = brute(known, links)
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in found} == dict(enumerate(want.values()))
    assert "block" in {v[3] for v in want.values() if v[2] is None}  # some decision did travel


def test_pages_name_their_aliases(spark):
    rows = [(1, "http://m.site.com/p/?utm_source=x#top", ""), (2, "https://www.site.com/p", ""),
            (3, "https://other.com/q", '<LINK href="https://bad.org/z" rel="canonical">'),
            (4, "http://third.com/r", '<meta http-equiv="refresh" content="0; url=https://other.com/q">'),
            (5, "http://fourth.com/s", '<link rel=canonical href="/t">'), (6, "http://fourth.com/t", None),
            (7, "http://good.org/a", '<link rel="canonical" href="http://bad.org/z2">'),
            (8, "http://bad.org/z2", ""), (9, "http://plain.com/", '<link rel="canonical" href="http://good.org/a">')]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    verdict = {r["page_id"]: r["verdict"] for r in urls.filter_urls(df, rules(spark), "page_id", "url", "html").collect()}
    assert verdict == {1: "allow", 2: "allow", 3: "block", 4: "block", 5: "allow", 6: "allow", 7: "allow", 8: "block", 9: "allow"}
    forms = df.select(urls.canonical(df.url)).collect()
    assert forms[0][0] == forms[1][0] == "site.com/p"


def test_links_are_resolved(spark):
    page = "https://h.com/a/b/c.html?q=1#f"
    links = {"//o.com/p": "https://o.com/p", "/x/y": "https://h.com/x/y", "d.html": "https://h.com/a/b/d.html", "./e": "https://h.com/a/b/e",
             "../f?g=1": "https://h.com/a/f?g=1", "../../../h": "https://h.com/h", "?z=2": "https://h.com/a/b/c.html?z=2", "..": "https://h.com/a/",
             "http://abs.org/": "http://abs.org/", "#frag": None, "mailto:a@b.c": None, "javascript:void(0)": None, "sub/": "https://h.com/a/b/sub/"}
    rows = [(k, page, f'<link rel="canonical" href="{link}">') for k, link in enumerate(links)]
    rows.append((99, "http://bare.com", "<LINK HREF='next' REL=canonical />"))
    rows.append((100, "http://two.com/", '<link rel="stylesheet" href="/s.css"><link data-x="1" href="/one" rel="canonical"><p><link rel=canonical href=/two>'
                                         '<meta content="5; URL=\'/three\'" http-equiv="Refresh"><meta name="url=x" content="url=/four">'))
    rows.append((101, None, '<link rel="canonical" href="/x">'))
    df = spark.createDataFrame(rows, "id long, url string, html string")
    got = {r["id"]: r["l"] for r in df.select("id", urls.page_links(df.html, df.url).alias("l")).collect()}
    assert [got[k] for k in range(len(links))] == [[v] if v else [] for v in links.values()]
    assert got[99] == ["http://bare.com/next"] and got[100] == ["http://two.com/one", "http://two.com/two", "http://two.com/three"]
    assert not got[101]


def test_forms_are_optional(spark):
    df = spark.createDataFrame([(1, "http://m.bad.org/x", None), (2, "http://www.z.com/x", None), (3, "http://z.com/x", '<link rel="canonical" href="http://bad.org/">')],
                               "page_id long, url string, html string")
    asked = lambda **how: {r["page_id"]: r["verdict"] for r in urls.filter_urls(df, rules(spark), "page_id", "url", "html", **how).collect()}
    assert asked() == {1: "block", 2: "block", 3: "block"} and asked(form=None) == {1: "block", 2: "allow", 3: "block"}


def test_hot_urls_and_components(spark, monkeypatch):
    """A third of the pages has one URL and another third no URL; verdicts are the same with and without broadcasts."""
    rows = [(k, [None, "http://m.bad.org/hot", f"http://s{k % 50}.net/{k % 7}"][k % 3], None) for k in range(900)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = brute({u for _, u, _ in rows}, [])
    for heavy in (10_000, 20, 0):
        monkeypatch.setattr(urls, "HEAVY", heavy)
        got = urls.filter_urls(df, rules(spark), "page_id", "url", "html").collect()
        assert sorted((r["page_id"], r["host"], r["path"], r["rule"] or "", r["verdict"]) for r in got) == sorted(
            (k, *(x or "" for x in want[u])) for k, u, _ in rows)


def test_awkward_rows(spark, monkeypatch):
    rows = [(1, None, None, "r"), (2, "", "x", "r"), (3, "no scheme", "x", "r"), (4, "http://", "x", None), (5, "http://x.NET", "x", "r"),
            (6, "http://x.NET/", "x", "r"), (6, "http://x.NET/", "x", "r"), (None, "http://x.net?q=1", "x", "r"), (8, "a://b://net/", None, "r"),
            (9, "http://" + "a." * 300 + "net/" + "p" * 5000, "x", "r"), (10, "http://y.example.net/en/?a#b", "x", "r"),
            (11, "http://ÄX.net/é", "x", "r")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, rule string")
    want = brute({u for _, u, _, _ in rows}, [("http://x.NET", "http://x.NET/")])  # one canonical form
    for limit in (50_000, 0):  # broadcast rules, then a shuffle join
        monkeypatch.setattr(urls, "BROADCAST_ROWS", limit)
        got = urls.filter_urls(df, rules(spark), "page_id", "url", "html").collect()
        assert (sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got), key=str)
                == sorted(((i, *want[u]) for i, u, _, _ in rows), key=str))
    assert urls.filter_urls(df.limit(0), rules(spark), "page_id", "url", "html").collect() == []
