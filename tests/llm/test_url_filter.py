import re

from cohortal.core.settle import settle
from cohortal.llm import url_templates
from tests.llm.helpers import counted


def split(url):
    after = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
    host = re.match(r"[^/?#]*", after)[0]
    path = re.match(r"[^?#]*", after[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def ruled(host, path):
    best = (None, None)
    for verdict, rule in url_templates.RULES:
        name, _, start = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start) and len(rule) > len(best[0] or ""):
            best = (rule, verdict)
    return best


URLS = [
    None, "", "no scheme", "http://", "://x", "HTTP://A.Example.ORG/es/1", "http://example.org/en/12?x=1", "http://example.org", "http://org/", "http://borg/x",
    "http://example.org?q=/es/", "https://x.com/fr/é", "https://x.com/de/", "https://x.com#/de/", "https://Éa.com:80/de/1", "http://a.net/x://y/z", "http://sub.a.com/de/a//b/c/d/e/f",
]


def table(spark):
    many = [f"http://h{k % 3}.org/en/{k}{'.html' if k % 2 else ''}" for k in range(200)] + [f"http://bad.com/de/{k}" for k in range(150)] + [f"http://bad.net/de/{k}" for k in range(40)]
    rows = list(enumerate(URLS + many)) + [(0, None), (None, "http://a.net/"), (None, None)]
    return rows, spark.createDataFrame([(k, u, "p", "h") for k, u in rows], "page_id long, url string, purity string, host string")


def test_hosts_paths_and_rules(spark):
    rows, pages = table(spark)
    out = url_templates.filter_urls(pages, settle).collect()
    expected = [(k, *split(u), ruled(*split(u))[0]) for k, u in rows]
    assert counted((r.page_id, r.host, r.path, r.rule) for r in out) == counted(expected)
    for r in out:
        assert r.verdict in ("allow", "block")
        if r.rule:
            assert r.verdict == ruled(r.host, r.path)[1]
        else:
            assert r.verdict == ("block" if r.purity < url_templates.REJECT else "allow")


def test_templates_generalise_numbers_and_carry_purity(spark):
    _, pages = table(spark)
    out = {r.url: r for r in url_templates.filter_urls(pages, settle).collect()}
    assert out["http://h0.org/en/0"].template == "/en/{n}" and out["http://h1.org/en/1.html"].template == "/en/{n}.html"
    assert out["http://bad.net/de/7"].template == "/de/{n}"
    # The folder was only ever blocked, so a host without a rule is rejected too.
    assert out["http://bad.net/de/7"].rule is None and out["http://bad.net/de/7"].verdict == "block"


def test_paths_are_judged_to_their_last_segment(spark):
    """Labels differ only in the fifth segment; the labelled paths are on hosts that rules decide."""
    rules = (("allow", "a.net/2024/may/day/x/sport/1"), ("block", "a.net/2024/may/day/x/spam/1"))
    urls = [f"http://a.net/2024/may/day/x/{what}/{k}/end" for what in ("sport", "spam") for k in range(100, 300)]
    urls += ["http://b.net/" + "s/" * 40 + "x"]
    pages = spark.createDataFrame([(u,) for u in urls], "url string")
    out = {r.url: r for r in url_templates.filter_urls(pages, settle, rules=rules).collect()}
    assert len(out) == len(urls)
    good, bad = (out[f"http://a.net/2024/may/day/x/{what}/250/end"] for what in ("sport", "spam"))
    assert (good.rule, bad.rule) == (None, None) and (good.verdict, bad.verdict) == ("allow", "block")
    assert (good.template, bad.template) == ("/{n}/may/day/x/sport/{n}/end", "/{n}/may/day/x/spam/{n}/end")
    assert out[urls[-1]].template == "/" + "/".join(["{}"] * 41)


def test_empty_and_unlabelled(spark):
    _, pages = table(spark)
    assert url_templates.filter_urls(pages.limit(0), settle).count() == 0
    plain = url_templates.filter_urls(pages.where("url like '%net%'"), settle).collect()
    assert {r.verdict for r in plain} == {"allow"} and len(plain) == 42
