import math
import random
from collections import Counter, defaultdict

import duckdb

from docindex.llm import url_filter

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    ends = [rest.find(c) for c in "/?#" if c in rest]
    at = min(ends, default=len(rest))
    tail = rest[at:]
    return rest[:at].translate(LOWER), tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]


def rule(host, path, rules):
    fit = [(h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return min(fit, key=lambda r: (-len(r[0]), r[0]), default=(None, None))


def apart(x, n, y, m):
    p, q, pooled = (x + 0.5) / (n + 1), (y + 0.5) / (m + 1), (x + y + 1) / (n + m + 2)
    return abs(p - q) > 1.96 * math.sqrt(pooled * (1 - pooled) * (1 / (n + 1) + 1 / (m + 1)))


def brute(rows, rules):
    """A tree for each host, node by node."""
    seen = [(i, *parts(u)) for i, u in rows]
    fits = [rule(h, p, rules) for _, h, p in seen]
    template = [""] * len(seen)

    def grow(members, level):
        members = [i for i in members if len(segments[i]) > level]
        if not members:
            return
        count = Counter(segments[i][level] for i in members)
        branch = {v: "=" + v if n >= 3 and n >= 0.05 * len(members) else "*" for v, n in count.items()}
        of = defaultdict(list)
        for i in members:
            of[branch[segments[i][level]]].append(i)
        stats = sorted((sum(fits[i][1] == "block" for i in m) / len(m), sum(fits[i][1] == "allow" for i in m) / len(m), b) for b, m in of.items())
        groups = []
        for bad, good, b in stats:
            n = len(of[b])
            now = (round(bad * n), round(good * n), n)
            if not groups or apart(now[0], n, last[0], last[2]) or apart(now[1], n, last[1], last[2]):
                groups.append([])
            groups[-1].append(b)
            last = now
        for g in groups:
            name = "*" if "*" in g else g[0][1:] if len(g) == 1 else "(" + "|".join(sorted(b[1:] for b in g)) + ")"
            inside = [i for b in g for i in of[b]]
            for i in inside:
                template[i] += "/" + name
            grow(inside, level + 1)

    segments = [[] if not p else (p[1:] if p[0] == "/" else p).split("/", 7) for _, _, p in seen]
    hosts = defaultdict(list)
    for i, (_, h, _) in enumerate(seen):
        hosts[h].append(i)
    for members in hosts.values():
        grow(members, 0)
    bad, good = (Counter((h, template[i]) for i, (_, h, _) in enumerate(seen) if fits[i][1] == v) for v in ("block", "allow"))
    out = []
    for i, (page, h, p) in enumerate(seen):
        key = h, template[i]
        purity = (bad[key] + 1) / (bad[key] + good[key] + 2)
        out.append((page, h, p, fits[i][0], fits[i][1] or ("block" if purity >= 0.8 else "allow"), template[i], round(purity, 9)))
    return sorted(out, key=str)


def rounded(df):
    return sorted(((*r[:6], round(r[6], 9)) for r in map(tuple, df.collect())), key=str)


EXTRA = [None, "", "no scheme", "://", "http://", "http://NET/", "http://x.NET", "http://ÄB.Net/x", "http://net?x=/", "http://a.example.net/en/", "http://a.example.net/en", "http://example.com/de/#f", "https://user@h.org:80/fr/x?y#z", "http://notnet/", "a\nb://h.net/\n/x", "http://h//a//b", "http://h.net/" + "a/" * 50, "http://net/" + "x" * 50_000, "http://one?q://two/three"]


def test_judged_as_by_hand(spark):
    rng = random.Random(9)
    hosts = ["a.example.com", "b.example.net", "c.example.org", "d.other.io", "e.example.com"]
    urls = [f"http://{rng.choice(hosts)}/{rng.choice(['de', 'en', 'fr', 'shop', 'x%d' % rng.randrange(99)])}/{rng.choice(['item', 'p', str(rng.randrange(999))])}/{rng.randrange(40)}{rng.choice(['', '/', '.html', '?q=1'])}" for _ in range(700)]
    urls += [f"http://d.other.io/hidden/{i}" for i in range(20)] + ["http://a.example.com/de/same"] * 60 + EXTRA + EXTRA
    rules = [*url_filter.RULES, ("block", "d.other.io", "/hidden/1"), ("block", "other.io", "/hidden/2")]
    rows = [(i // 2 if i % 50 else None, u) for i, u in enumerate(urls)]
    pages = spark.createDataFrame([(i, u, "t", 1.0) for i, u in rows], "page_id long, url string, template string, key double")
    got = url_filter.judge_urls(pages, rules)
    assert got.columns == ["page_id", "url", "key", "host", "path", "rule", "verdict", "template", "purity"]
    assert rounded(got.drop("url", "key")) == brute(rows, rules)
    # /hidden/3 to /hidden/9 have no rule, but nearly all they stand with are blocked.
    assert {r[0] for r in got.where("url rlike 'hidden/[03-9]$'").select("verdict").collect()} == {"block"}
    assert {r[0] for r in got.where("url like '%a.example.com/en/%'").select("verdict").collect()} == {"allow"}


def test_given_pages(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()]
    got = url_filter.op13_url_filter(spark, sf)
    assert rounded(got) == brute(rows, url_filter.RULES)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    host, path = r"translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')", r"regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's')"
    want = con.execute(f"SELECT page_id, {host}, {path} FROM pages").fetchall()
    assert sorted(tuple(r)[:3] for r in got.collect()) == sorted(want)


def test_empty_tables_and_native_plans(spark):
    pages = spark.createDataFrame([(1, "http://net/")], "page_id long, url string")
    assert url_filter.judge_urls(pages.where("false"), url_filter.RULES).count() == 0
    only = url_filter.judge_urls(pages.select("url"), url_filter.RULES)
    assert [tuple(r)[1:5] for r in only.collect()] == [("net", "/", "net/", "block")]
    plan = only._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
