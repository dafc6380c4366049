from __future__ import annotations

import math
import random
import re
from pathlib import Path
from urllib.parse import urlsplit

import duckdb
import pytest
from pyspark.sql import functions as F

from crawlgate import queries
from crawlgate.corpus import URLS
from crawlgate.functions.latin1 import from_text, to_text, trim
from crawlgate.functions.urls import located_target, origin, prepare_url, robots_location
from crawlgate.operators import patterns
from crawlgate.operators.lexer import debug_lines, directives, lines
from crawlgate.plans.policy import compile_policies, debug_policies
from crawlgate.plans.verdicts import check, http_policy, score
from crawlgate.sources.robots_files import FOLDERS, from_files, from_texts, remove_files, to_files, write_debug
from crawlgate.sources.shared import shared_dir
from tests import model


def policies(spark, files, agents):
    table = spark.createDataFrame([(a,) for a in agents], "agent string")
    return compile_policies(from_texts(spark, files), table)


def verdicts(spark, body, agents, urls):
    """{(agent, url): allowed} for one file."""
    table = spark.createDataFrame([(u, "f", u) for u in urls], "url_id string, robots_id string, url string")
    return {(r["agent"], r["url_id"]): r["allowed"] for r in check(table, policies(spark, {"f": body}, agents)).collect()}


LEXED = {
    b"": [],
    b"\n": [("raw", b"", None)],
    b"Disallow: /a": [("disallow", b"/a", None)],
    b"Disallow: /a\r\r\nAllow:/b\r": [("disallow", b"/a", None), ("allow", b"/b", None)],
    b"a\n\nb": [("raw", b"a", None), ("raw", b"", None), ("raw", b"b", None)],
    b"\xef\xbb\xbfallow /x # why": [("allow", b"/x", None)],
    b"\xbballow: /x": [("allow", b"/x", None)],
    b"\xef\x11\xbf: x": [("raw", b"\x11\xbf: x", None)],
    b" \tDISALLOW \t: /p q ": [("disallow", b"/p q", None)],
    b"dissallow/b": [("raw", b"dissallow/b", None)],
    b"Allowed: /x": [("raw", b"Allowed: /x", None)],
    b"disalow:": [("allow", b"/", None)],
    b"Allow:": [("allow", b"", None)],
    b"site map: http://x/\xff": [("sitemap", b"http://x/\xff", None)],
    b"crawl delay: 1e1": [("crawl_delay", b"1e1", 10.0)],
    b"Crawldelay: .5": [("crawl_delay", b".5", 0.5)],
    b"crawl-delay: 5.": [("crawl_delay", b"5.", 5.0)],
    b"crawl-delay: inf": [("crawl_delay", b"inf", math.inf)],
    b"crawl-delay: 9e99": [("crawl_delay", b"9e99", math.inf)],
    b"crawl-delay: -0": [("crawl_delay", b"-0", 0.0)],
    **{b"crawl-delay: " + x: [("raw", b"crawl-delay: " + x, None)] for x in (b"-1", b"x", b"", b"nan", b"1f", b"0x1p3", b".", b"1e", b"\xff")},
    "useragent:　Bot ".encode(): [("user_agent", b"Bot", None)],
    b"allow: /a\x00disallow: /b": [("allow", b"/a", None), ("disallow", b"/b", None)],
    "ſitemap: x".encode(): [("raw", "ſitemap: x".encode(), None)],
}


def test_lexer(spark):
    names = {str(i): body for i, body in enumerate(LEXED)}
    got = {k: [] for k in names}
    rows = directives(from_texts(spark, names)).withColumn("bytes", F.encode("value", "ISO-8859-1"))
    for r in rows.orderBy("line_no").collect():
        got[r["robots_id"]].append((r["kind"], bytes(r["bytes"]), r["delay"]))
    for k, body in names.items():
        assert got[k] == LEXED[body], body
        assert [(a, b) for a, b, _ in model.parsed(body)] == [(a, b) for a, b, _ in LEXED[body]]


def test_trim_is_linear(spark):
    rows = spark.createDataFrame([("x" + " " * 300_000 + "y",), ("  aà　",)], "s string")
    out = [r[0] for r in rows.select(to_text(trim(from_text(F.col("s"))))).collect()]
    assert len(out[0]) == 300_002 and out[1] == "aà"


GROUPS = b"""Crawl-delay: 1
Crawl-delay: 2
Disallow: /nobody
User-agent: Heron
Noindex: /x
Sitemap: http://s/1
user-agent: Ibis
Disallow: /reeds
User-agent: Stork
Crawl-delay: 5
Crawl-delay: 6
User-agent: heron
Disallow: /again
User-agent: Rail
crawl delay: later
Noindex: /between
User-agent: Crake
Crawl-delay: 0.25
Allow: /mud
User-agent: *
Allow: /star
Sitemap: http://s/1
Sitemap: http://s/\xff
User-agent: last
"""


def test_groups_delays_and_sitemaps(spark):
    rows = {r["agent"]: r for r in policies(spark, {"g": GROUPS}, ["Heron", "ibis", "Stork", "rail", "Crake", "Gull", "last", "Heron/2.0"]).collect()}
    rules = {k: [x["pattern"] for x in r["rules"]] for k, r in rows.items()}
    # Lines between that are unknown, or no number, do not part a run of agents.
    assert rules == {"Heron": ["/reeds", "/again"], "ibis": ["/reeds"], "Stork": [], "rail": ["/mud"], "Crake": ["/mud"], "Gull": ["/star"], "last": [], "Heron/2.0": ["/star"]}
    assert {k: r["delay"] for k, r in rows.items()} == {"Heron": 2.0, "ibis": 2.0, "Stork": 5.0, "rail": 0.25, "Crake": 0.25, "Gull": 2.0, "last": 2.0, "Heron/2.0": 2.0}
    assert all(r["sitemaps"] == ["http://s/1", "http://s/1"] for r in rows.values())
    assert rows["Gull"]["matched_agent"] == "*" and rows["Heron"]["matched_agent"] == "heron"


def test_a_file_from_bytes_to_verdicts(spark):
    """Rules of two agents, a longer Allow inside a Disallow, a starred suffix, and URLs whole and relative."""
    body = "\n".join(["User-agent: Lantern", "Disallow: /harbour", "Allow: /harbour/pier", "Disallow: /*/tide.json$", "", "User-agent: *", "Allow: /quay", "Disallow: /", "Sitemap: https://port.example/all.xml"]).encode()
    urls = ["/harbour", "https://port.example/harbour/pier/3", "/log/tide.json", "/log/tide.json?day=2", "/quay?x", "/", "https://port.example/robots.txt"]
    got = verdicts(spark, body, ["lantern", "Buoy"], urls)
    assert [got["lantern", u] for u in urls] == [False, True, False, True, True, True, True]
    assert [got["Buoy", u] for u in urls] == [False, False, False, False, True, False, True]


MATCHES = [
    ("/", "/any", True), ("", "/any", True), ("/oak", "/oaks/7", True), ("/oak", "/Oak", False), ("oak", "/oak", False), ("*oak", "/redoak", True), ("/oak*.svg", "/oak/2/leaf.svg?w=9", True),
    ("/m***n", "/mxxn", True), ("/q$", "/q", True), ("/q$", "/qr", False), ("/q$r", "/q$r", False), ("/q$*", "/q", True), ("/q$*", "/qr", False), ("/q*r$", "/qxrxr", True), ("/qr*rq$", "/qrq", False),
    ("/k.l", "/kxl", False), ("/[k]", "/k", False), ("/ø", "/%C3%B8", True), ("/%71", "/q", False), ("/%D4", "/%d4", False), ("/k*/l*/m*/n*/o*/p*/q*/r*/s*/t*/u*/v", "/k/l/m/n/o/p/q/r/s/t/u/" + "x" * 5000, False),
    ("*", "/", True), ("$", "/", False), ("/*?", "/k?l", True), ("/r*", "*", False), ("r*t", "*rt", True), ("/{box}", "/{box}", True), ("/{box}", "https://h.example/{box}", False), ("/p$", "https://h.example/p#top", False),
]


def test_matching(spark):
    rows = spark.createDataFrame(MATCHES, "p string, u string, m boolean")
    rule = patterns.compiled(F.lit(0), from_text(F.col("p")), F.lit(True))
    rows = rows.select("p", "u", "m", rule.alias("r"), prepare_url(F.col("u")).alias("t")).withColumn("got", patterns.matches(F.col("r"), F.col("t")))
    assert [(r["p"], r["u"]) for r in rows.collect() if r["got"] != r["m"]] == []


def test_equal_length_allows(spark):
    assert verdicts(spark, b"Disallow: /ab\nAllow: /a*", ["x"], ["/ab"]) == {("x", "/ab"): True}
    assert verdicts(spark, b"Disallow: /abc\nAllow: /a*", ["x"], ["/abc"]) == {("x", "/abc"): False}


def test_long_anchored_rule_is_an_error(spark):
    long = b"Disallow: /" + b"a" * 4100
    rows = {r["robots_id"]: r for r in policies(spark, {"x": long + b"$", "y": long, "z": b"Disallow: /" + b"b" * 1_000_000, "w": b"User-agent: q\n" + long + b"$"}, ["bot"]).collect()}
    assert rows["x"]["error"].startswith("Invalid robots.txt rule: /aaa")
    assert rows["y"]["error"] is None and rows["z"]["error"] is None and rows["w"]["error"] is None


PREPARED = {
    "": "/", "https://example.com": "/", "http://h/a/b?c=http://d.e/": "/a/b?c=http://d.e/", "http://h/a?b#c": "/a?b#c", "/á": "/%C3%A1", "/%aa": "/%aa", "/a/../b": "/a/../b",
    "http://h/a/../b/./c": "/b/c", "http://256.1.1.1/a b": "http://256.1.1.1/a%20b", "http://h/a/%2E%2e/b": "/b", "http://h/a/..": "/", "http://h/a/.": "/a/", "http://h/{x}`": "/%7Bx%7D%60", "http://h/?`'": "/?`%27", "localhost:8080/foo": "8080/foo",
    "example.com/x": "example.com/x", "//h/x": "//h/x", "HTTP:\\\\H\\a\\..\\b": "/b", " http://h/ x ": "/%20x", "http://h/a\tb": "/ab", "foo://h/a b?'": "/a%20b?'",
}
LOCATED = {
    # Who asks, what for, and the usual port go; another port and the scheme stay.
    "https://ana:key@depot.example/in/out?q=1#f": ("https://depot.example/robots.txt", None), "http://depot.example:0080?x": ("http://depot.example/robots.txt", None), "HTTPS://DEPOT.example:080": ("https://depot.example:80/robots.txt", None),
    "http://one@two@depot.example:9000/": ("http://depot.example:9000/robots.txt", None), "http:depot.example": ("http://depot.example/robots.txt", None), "http:\\\\depot.example\\x": ("http://depot.example/robots.txt", None),
    # No robots file.
    "dat://depot/": (None, "EmptyHost"), "ftp://depot.example/": (None, "EmptyHost"), "tel:+4930": (None, "SetHostOnCannotBeABaseUrl"), "in/out": (None, "RelativeUrlWithoutBase"), "": (None, "RelativeUrlWithoutBase"),
    "http://::depot.example/": (None, "EmptyHost"), "http://depot.example:70000/": (None, "InvalidPort"), "http://depot.example:8o/": (None, "InvalidPort"), "http://de|pot/": (None, "InvalidDomainCharacter"),
    # Names.
    "http://d%65pot.ex%41mple/": ("http://depot.example/robots.txt", None), "http://öl.example/": ("http://xn--l-0ga.example/robots.txt", None), "http://%C3%96L.example/": ("http://xn--l-0ga.example/robots.txt", None),
    "http://straße.example/": (None, "IdnaUnsupported"), "http://%ff.example/": (None, "IdnaError"), "http://a%2Fb/": (None, "InvalidDomainCharacter"), "http://a%zz/": (None, "InvalidDomainCharacter"), "http://xn--l-0ga.example./": ("http://xn--l-0ga.example./robots.txt", None),
    # Addresses.
    "http://0x7f.1/": ("http://127.0.0.1/robots.txt", None), "http://3232235777/": ("http://192.168.1.1/robots.txt", None), "http://0300.0250.1.1./": ("http://192.168.1.1/robots.txt", None), "http://10.0x0.258/": ("http://10.0.1.2/robots.txt", None),
    "http://256.256.256.256/x": (None, "InvalidIpv4Address"), "http://1.2.3.4.5/": (None, "InvalidIpv4Address"), "http://08.1/": (None, "InvalidIpv4Address"), "http://1..2/": (None, "InvalidIpv4Address"), "http://a.0x/": (None, "InvalidIpv4Address"),
    "http://1.16777216/": (None, "InvalidIpv4Address"), "http://99999999999999999999999/": (None, "InvalidIpv4Address"), "http://0x/": ("http://0.0.0.0/robots.txt", None), "http://1.2.3.4x/": ("http://1.2.3.4x/robots.txt", None), "http://%31.2.3.4/": ("http://1.2.3.4/robots.txt", None),
    "http://[::0:1]:81/": ("http://[::1]:81/robots.txt", None), "http://[2001:DB8:0:0:1:0:0:1]/": ("http://[2001:db8::1:0:0:1]/robots.txt", None), "http://[::ffff:10.1.2.3]/": ("http://[::ffff:a01:203]/robots.txt", None), "http://[0:0:0:0:0:0:0:0]/": ("http://[::]/robots.txt", None),
    "http://[1:0:2:0:3:0:4:0]/": ("http://[1:0:2:0:3:0:4:0]/robots.txt", None), "http://[1::]/": ("http://[1::]/robots.txt", None), "http://[1:2:3:4:5:6:7::]/": ("http://[1:2:3:4:5:6:7:0]/robots.txt", None), "http://[1:2:3:4:5:6:7:8::]/": (None, "InvalidIpv6Address"),
    "http://[::1::]/": (None, "InvalidIpv6Address"), "http://[1:2]/": (None, "InvalidIpv6Address"), "http://[::1.2.3]/": (None, "InvalidIpv6Address"), "http://[::01.2.3.4]/": (None, "InvalidIpv6Address"), "http://[::12345]/": (None, "InvalidIpv6Address"), "http://[::1/": (None, "InvalidIpv6Address"),
}


def test_urls(spark):
    rows = spark.createDataFrame([(u,) for u in PREPARED], "u string").select("u", prepare_url(F.col("u")).alias("p"))
    assert {r["u"]: r["p"] for r in rows.collect()} == PREPARED
    rows = spark.createDataFrame([(u,) for u in LOCATED], "u string").select("u", robots_location(F.col("u")).alias("l"))
    assert {r["u"]: tuple(r["l"]) for r in rows.collect()} == LOCATED
    # One parse gives the same as two.
    every = [*PREPARED, *LOCATED, *URLS, "http://h.example:080/x", "https://h.example:00443?y", "http://h.example:8081#z"]
    rows = spark.createDataFrame([(u,) for u in every], "u string").select("u", located_target(F.col("u")).alias("both"), origin(F.col("u")).alias("o"), prepare_url(F.col("u")).alias("p"))
    assert [(r["u"], r["both"]["origin"], r["both"]["target"]) for r in rows.collect() if (r["o"], r["p"]) != tuple(r["both"])] == []


PARTS = [
    b"User-agent: ", b"user agent:", b"useragent ", b"Disallow: ", b"Dissalow:", b"allow:", b"Allow ", b"Crawl-delay: ", b"sitemap:", b"*", b"bot", b"Bot", b"\xc3\x84", b"/", b"/a", b"/b*", b"$",
    b"**", b"\n", b"\n", b"\r\n", b"\r", b"\0", b"#", b" ", b"\t", b"\xff", b"\xef\xbb\xbf", b"1.5", b"-2", b"7", b"nan", b"%", b'"', b"x y",
]


def test_random_files_by_the_model(spark):
    r = random.Random(11)
    files = {str(i): b"".join(r.choice(PARTS) for _ in range(r.randint(0, 70))) for i in range(250)}
    agents, targets = ["bot", "Ä", "*"], ["/", "/a", "/ab", "/a/b", "/b", "/bx$", "/x%20y", "/a%FF", "/robots.txt"]
    rows = {(p["robots_id"], p["agent"]): p for p in policies(spark, files, agents).collect()}
    for k, body in files.items():
        for a in agents:
            rules, delay, maps = model.policy(body, a)
            p = rows[k, a]
            assert [(x["pattern"], x["is_allowed"]) for x in p["rules"]] == rules, body
            assert p["delay"] == delay and p["sitemaps"] == maps, body
    urls = spark.createDataFrame([(t, k, t) for k in files for t in targets], "url_id string, robots_id string, url string")
    got = check(urls.withColumn("url_id", F.struct("robots_id", "url")), policies(spark, files, agents))
    n = 0
    for v in got.collect():
        rules = model.policy(files[v["url_id"]["robots_id"]], v["agent"])[0]
        assert v["allowed"] == model.allowed(rules, v["url_id"]["url"]), (files[v["url_id"]["robots_id"]], v)
        n += 1
    assert n == len(files) * len(targets) * len(agents)


def test_verdicts_by_origin(spark):
    found = policies(spark, {"one": b"Disallow: /no", "two": b"Disallow: /" + b"a" * 2000 + b"$"}, ["bot"])
    found = found.withColumn("origin", F.when(F.col("robots_id") == "one", "https://one.example").otherwise("https://two.example"))
    urls = [(1, "https://ONE.example/no"), (2, "https://u:p@one.example:443/yes"), (3, "https://two.example/"), (4, "https://three.example/no"), (5, "https://one.example/robots.txt"), (6, "not a url")]
    rows = score(spark.createDataFrame(urls, "url_id int, url string"), found).collect()
    assert {(r["url_id"], r["agent"], r["allowed"], r["reason"]) for r in rows} == {
        (1, "bot", False, "rule"), (2, "bot", True, "no_rule"), (3, "bot", True, "bad_robots"), (4, None, True, "no_robots"), (5, "bot", True, "robots_txt"), (6, None, True, "no_robots"),
    }


def test_invariant_under_repartition(spark):
    files = {str(i): b"User-agent: a\nDisallow: /%d\nUser-agent: *\nAllow: /" % i for i in range(40)}
    agents = spark.createDataFrame([("a",), ("b",)], "agent string")
    one = compile_policies(from_texts(spark, files).repartition(1), agents).orderBy("robots_id", "agent").collect()
    assert one == compile_policies(from_texts(spark, files).repartition(7), agents).orderBy("robots_id", "agent").collect()
    own = spark.createDataFrame([("3", "a")], "robots_id string, agent string")
    assert len(compile_policies(from_texts(spark, files), own).collect()) == 1


def test_files_are_not_shuffled(spark):
    """From bytes to policies a file stays in its row: no exchange but that of the agents' list, and no Python."""
    files = from_texts(spark, {"f": b"a"})
    plan = directives(files)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    table = spark.range(3).selectExpr("'f' || id AS robots_id", "CAST('Disallow: /' AS BINARY) AS content")
    plan = compile_policies(table, spark.createDataFrame([("b",)], "agent string"))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(robots_id" not in plan and "Python" not in plan and "Window" not in plan and plan.count("Sort") == 0


def test_random_bytes(spark):
    """Whatever a file's bytes are, it has a policy, and the model's."""
    r = random.Random(7)
    files = {str(i): bytes(r.randrange(256) for _ in range(r.randint(0, 400))) for i in range(150)}
    files |= {f"w{i}": b"".join(r.choice([b"\n", b"allow:", b"disallow ", b"user-agent:", bytes([r.randrange(256)])]) for _ in range(80)) for i in range(150)}
    rows = {p["robots_id"]: p for p in policies(spark, files, ["bot"]).collect()}
    for k, body in files.items():
        rules, delay, maps = model.policy(body, "bot")
        assert [(x["pattern"], x["is_allowed"]) for x in rows[k]["rules"]] == rules, body
        assert rows[k]["delay"] == delay and rows[k]["sitemaps"] == maps and rows[k]["error"] is None


def test_files_as_a_source_and_sink(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.robots.txt").write_bytes(b"Disallow: /\xff\nAllow: /ok")
    (tmp_path / "a" / "other.csv").write_bytes(b"no")
    files = from_files(spark, str(tmp_path / "a"))
    assert files.count() == 1 and lines(files).count() == 2
    write_debug(debug_lines(directives(files)), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    shown = debug_policies(compile_policies(files, spark.createDataFrame([("b",)], "agent string"))).first()["debug"]
    assert '"pattern":"/ok"' in shown


def test_files_of_many_customers(spark, tmp_path, monkeypatch):
    """Customers' files are in the shared folder a round at a time, in few folders and without checksums, and read in few tasks; none stay."""
    orders = [(k, -20 if k % 50 == 0 else -3 if k % 50 == 1 else None if k % 50 == 2 else k % 301) for k in range(1, 2000)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    found = []

    def seen(*args, **more):
        files = from_files(*args, **more)
        folder = Path(urlsplit(args[1]).path)
        found.append((files.count(), len(list(folder.rglob("*"))), len(list(folder.iterdir())), files.rdd.getNumPartitions()))
        return files

    monkeypatch.setattr(queries, "ROUND_FILES", 100)
    monkeypatch.setattr(queries, "from_files", seen)
    before = set(Path(shared_dir(spark)).rglob("*"))
    ours = sorted((tuple(r) for r in queries.file_source(spark, str(tmp_path)).select("robots_id", "n_bytes", "sha256").collect()), key=repr)
    assert ours == sorted(db.sql(queries.ORACLE_SQL["file_source"]).fetchall(), key=repr)
    assert {-20, -3, None} <= {r[0] for r in ours} and sum(r[1] is not None for r in ours) == sum(n for n, *_ in found)
    assert len(found) in (3, 4) and max(n for n, *_ in found) < 150
    assert all(entries == n + folders and folders <= FOLDERS and tasks <= FOLDERS for n, entries, folders, tasks in found)
    assert not [p for p in set(Path(shared_dir(spark)).rglob("*")) - before if "robots_id" in p.name]


def test_files_in_a_store_that_only_spark_reads(spark, tmp_path):
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.crawlgate.link./in", f"file://{tmp_path}")
    texts = {-4: "Allow: /\u00fc\r", 5: "", 6: "a\nb"}
    for place in ("viewfs://crawlgate/in/a", str(tmp_path / "b c%20d")):
        to_files(spark.createDataFrame(list(texts.items()), "robots_id long, text string"), place)
        assert {int(re.search("robots_id=(-?[0-9]+)", k)[1]): bytes(v) for k, v in from_files(spark, place, "*.txt", tasks=2).collect()} == {k: v.encode() + b"\n" for k, v in texts.items()}
        remove_files(spark, place)
    assert not list(tmp_path.iterdir())


def test_size_limit_is_optional(spark):
    files = from_texts(spark, {"f": b"Disallow: /a\nDisallow: /b"})
    assert lines(files).count() == 2 and lines(files, max_bytes=12).count() == 1


def test_http_policy(spark):
    rows = spark.createDataFrame([(s,) for s in (200, 301, 404, 429, 503)], "s int").select(http_policy(F.col("s")))
    assert [r[0] for r in rows.collect()] == ["parse", "follow", "allow_all", "retry", "disallow_all"]


@pytest.mark.parametrize("name", ["verdicts", "slots"])
def test_streams(spark, tmp_path, name):
    from crawlgate.streaming.verdicts import fetch_slots, stream_verdicts

    found = policies(spark, {"one": b"Crawl-delay: 20\nDisallow: /no"}, ["bot"]).withColumn("origin", F.lit("https://one.example"))
    urls = spark.sql("SELECT id AS url_id, concat('https://one.example/', if(id % 2 = 0, 'no', 'yes')) AS url, timestamp '2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id) AS ts FROM range(10)")
    urls.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(urls.schema).parquet(str(tmp_path / "in"))
    made = stream_verdicts(stream, found) if name == "verdicts" else fetch_slots(stream, found)
    query = made.writeStream.format("memory").queryName(name).outputMode("append" if name == "verdicts" else "complete").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    rows = spark.table(name).collect()
    if name == "verdicts":
        assert sorted(r["url_id"] for r in rows if r["allowed"]) == [1, 3, 5, 7, 9]
    else:
        assert [(r["asked"], r["granted"]) for r in rows] == [(10, 3)]
