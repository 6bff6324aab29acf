import datetime as dt

from skyloom.llm import urlfilter


def at(*d):
    return dt.datetime(*d)


ENTRIES = [
    ("bad.example.com", "spam", at(2024, 1, 10), True), ("bad.example.com", "spam", at(2024, 3, 5, 12), False), ("bad.example.com", "spam", at(2024, 3, 5, 12), True), ("bad.example.com", "spam", at(2024, 4, 1), False),
    ("example.com", "adult", at(2024, 2, 1), True), ("example.com", "adult", at(2024, 2, 1), True), ("host.org/a/b", "malware", at(2023, 1, 1), True), ("old.net", "spam", at(2020, 1, 1), True), ("old.net", "spam", at(2021, 1, 1), False),
    (None, "spam", at(2024, 1, 1), True), ("x.net", None, at(2024, 1, 1), True), ("x.net", "spam", None, True), ("future.net", "spam", at(2030, 1, 1), True), ("off.net", "spam", at(2024, 1, 1), False),
]
CAPTURES = [
    (1, "https://bad.example.com/x", at(2024, 1, 9, 23, 59)), (2, "https://bad.example.com/x", at(2024, 1, 10)), (3, "HTTP://User@BAD.Example.COM:80/x?q#f", at(2024, 3, 6)), (4, "https://bad.example.com", at(2024, 4, 1)), (5, "http://example.com/", at(2024, 1, 31)),
    (6, "http://host.org/a/b?x=1", at(2025, 5, 5)), (7, "http://host.org/a", at(2025, 5, 5)), (8, "http://old.net/", at(2020, 12, 31)), (9, "http://old.net/", at(2021, 1, 1)), (10, None, at(2024, 1, 1)), (11, "http://x.net/", None),
    (12, "not a url", at(2024, 1, 1)), (2, "https://bad.example.com/x", at(2024, 1, 10)), (None, "http://deep.sub.bad.example.com/", at(2024, 2, 2)), (14, "http://off.net/", at(2024, 6, 1)), (15, "http://notexample.com/", at(2024, 6, 1)), (16, "", at(2024, 1, 1)),
]


def brute(url, fetched):
    import re

    if not url or fetched is None:
        return False, "", None
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)(?::\d+)?([^?#]*)", url)
    if not m:
        return False, "", None
    host = m[1].lower()
    parts = host.split(".")
    keys = {".".join(parts[k:]) for k in range(len(parts))} | {host + m[2]}
    lists, matched = set(), set()
    for key, name in {(e[0], e[1]) for e in ENTRIES if None not in e[:3]}:
        if key in keys:
            before = [(e[2], e[3]) for e in ENTRIES if e[0] == key and e[1] == name and e[2] is not None and e[2] <= fetched]
            if before and max(before)[1]:
                lists.add(name)
                matched.add(key)
    return bool(lists), ",".join(sorted(lists)), max(matched, key=lambda k: (len(k), k), default=None)


def frames(spark, captures=CAPTURES, entries=ENTRIES):
    c = spark.createDataFrame([(*r, "clash") for r in captures], "page_id long, url string, fetched timestamp, u string")
    return c, spark.createDataFrame(entries, "key string, list string, at timestamp, active boolean")


def test_lists_at_fetch(spark):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    c, e = frames(spark)
    out = urlfilter.listed_at_fetch(c, e)
    assert out.columns == ["page_id", "url", "fetched", "u", "blocked", "lists", "matched"]
    got = sorted(((str(r.page_id), r.blocked, r.lists, str(r.matched)) for r in out.collect()))
    assert got == sorted((str(i), *(brute(u, f)[:2]), str(brute(u, f)[2])) for i, u, f in CAPTURES)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_hot_hosts_are_dealt_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "HOT", 7)
    monkeypatch.setattr(urlfilter, "KEYS", 0)
    captures = [(100 + k, f"http://bad.example.com/p{k}", at(2024, 3, 1 + k % 28)) for k in range(200)] + [(400 + k, f"http://h{k}.net/", at(2024, 3, 1 + k % 28)) for k in range(60)]
    c, e = frames(spark, captures + CAPTURES)
    got = sorted(((str(r.page_id), r.blocked, r.lists, str(r.matched)) for r in urlfilter.listed_at_fetch(c, e).collect()))
    assert got == sorted((str(i), *(brute(u, f)[:2]), str(brute(u, f)[2])) for i, u, f in captures + CAPTURES)


def test_empty(spark):
    c, e = frames(spark)
    assert urlfilter.listed_at_fetch(c.limit(0), e).count() == 0
    assert not any(r.blocked for r in urlfilter.listed_at_fetch(c, e.limit(0)).collect())
