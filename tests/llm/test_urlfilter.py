import random
import re
from datetime import date, timedelta

from findlode.llm import urlfilter

PAGE = "page_id bigint, url string, fetch_date date, key string"
ENTRY = "kind string, key string, category string, action string, entry_date date, host string"


def keys(url):
    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)[^/?#]*(/[^?#]*)?", url or "")
    if not m:
        return None, []
    host, parts = m[1].lower(), [p for p in (m[2] or "").split("/") if p]
    labels = host.split(".")
    out = [(len(labels) - i - 1, "domain", ".".join(labels[i:])) for i in range(len(labels))] + [(500, "host", host)]
    return host, out + [(i + 1000, "prefix", host + "/" + "/".join(parts[:i]).lower()) for i in range(1, len(parts) + 1)]


def brute(page, entries):
    pid, url, day, _ = page
    host, own = keys(url)
    hits = []
    for weight, kind, key in own:
        past = [(e[4], e[3], e[2]) for e in entries if e[0] == kind and e[1] and e[1].lower() == key and e[4] and e[3] in ("add", "remove") and day and e[4] <= day]
        if past:
            since, action, category = max(past, key=lambda x: (x[0], x[1], x[2] or ""))
            if action == "add":
                hits.append((weight, kind, key, category, since))
    best = max(hits, key=lambda h: h[:3]) if hits else None
    return (pid, host, len(hits), bool(hits), f"{best[1]}:{best[2]}" if best else "", best and best[3], best and str(best[4]))


def test_as_of_join_is_the_list_of_that_day(spark):
    rng = random.Random(9)
    hosts = ["a.example.com", "B.a.example.com", "x.org", "deep.er.x.org"]
    day = lambda: date(2024, 1, 1) + timedelta(days=rng.randrange(60))
    pages = [(i, f"https://{rng.choice(['', 'u:p@'])}{rng.choice(hosts)}{rng.choice(['', ':80'])}/{rng.choice(['', 'p', 'P/q', 'p/q/r.html?x=1', '#f'])}", day(), "k") for i in range(300)]
    pages += [(1000, None, day(), "k"), (1001, "no address", day(), "k"), (1002, "http://x.org", None, "k"), (1003, "", day(), "k"), pages[0], pages[0]]
    entries = [(rng.choice(["domain", "host", "prefix"]), rng.choice(["example.com", "a.example.com", "b.A.example.com", "x.org", "org", "x.org/p", "a.example.com/p/q"]), rng.choice(["c1", "c2"]), rng.choice(["add", "remove"]), day(), "h") for _ in range(120)]
    entries += [(None, "x.org", "c", "add", day(), "h"), ("host", None, "c", "add", day(), "h"), ("host", "x.org", "c", "add", None, "h"), ("host", "x.org", "c", "other", day(), "h"), entries[0]]
    got = sorted(tuple(r) for r in urlfilter.filtered(spark.createDataFrame(pages, PAGE), spark.createDataFrame(entries, ENTRY)).collect())
    want = sorted(brute(p, entries) for p in pages)
    assert [tuple(map(str, x)) for x in got] == [tuple(map(str, x)) for x in want]


def test_empty_tables(spark):
    pages, entries = spark.createDataFrame([(1, "http://x.org/a", date(2024, 1, 1), "k")], PAGE), spark.createDataFrame([("host", "x.org", "c", "add", date(2023, 1, 1), "h")], ENTRY)
    assert urlfilter.filtered(pages.limit(0), entries).count() == 0
    assert [r["blocked"] for r in urlfilter.filtered(pages, entries.limit(0)).collect()] == [False]
    assert [r["blocked"] for r in urlfilter.filtered(pages, entries).collect()] == [True]


def test_long_addresses_and_no_python_in_the_plan(spark):
    pages = spark.createDataFrame([(1, "http://x.org/" + "a/" * 3000, date(2024, 1, 1), "k")], PAGE)
    entries = spark.createDataFrame([("prefix", "x.org/a/a", "c", "add", date(2023, 1, 1), "h")], ENTRY)
    out = urlfilter.filtered(pages, entries)
    assert [r["entry"] for r in out.collect()] == ["prefix:x.org/a/a"]
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().executedPlan().toString())


def test_two_addresses_of_one_page_id_are_told_apart_and_a_hot_key_is_shuffled_away(spark):
    rows = [(1, f"https://a{i}.com/x", "2024-02-01") for i in range(300)] + [(1, "https://a0.com/bad", "2024-02-01")] * 3 + [(None, "https://a0.com/bad", "2024-02-01")]
    captures = spark.createDataFrame(rows, "page_id bigint, url string, fetch_date string")
    entries = spark.createDataFrame([("prefix", "a0.com/bad", "c", "add", "2024-01-01"), ("host", "a7.com", "c", "add", "2024-01-01")], "kind string, key string, category string, action string, entry_date string")
    out = urlfilter.filtered(captures, entries)
    got = [r for r in out.collect() if r["blocked"]]
    assert sorted((r["page_id"] is None, r["host"], r["entry"], r["n_active"]) for r in got) == [(False, "a0.com", "prefix:a0.com/bad", 1)] * 3 + [(False, "a7.com", "host:a7.com", 1), (True, "a0.com", "prefix:a0.com/bad", 1)]
    assert out.count() == len(rows) and "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()
