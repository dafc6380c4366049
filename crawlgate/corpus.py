"""A few robots files of our own, for queries on tables that hold none.

Hosts are dealt out to them by the length of their name.
"""

from __future__ import annotations

FILES = {
    "t0": """# open house
User-agent: *
Disallow: /private
Disallow: /*?utm_source=
Allow: /private/press
Crawl-delay: 2.5
Sitemap: https://t0.example/sitemap.xml

User-agent: GreedyBot
user agent: OtherBot
Disallow: /
Allow: /en/*$
""",
    "t1": "Crawl-delay: 7\nCrawl-delay: 3\nUser-Agent: TidyBot\rDisallow: /fr/ # no French\r\nDissallow: /de/\nCrawl-delay: soon\nUSERAGENT: *\nDisalow : /*.html$\nAllow: /en\nAllow: /en/\nsite-map: https://t1.example/a.xml # first\nSite Map: https://t1.example/b.xml",
    "t2": "Disallow: /hidden\nDisallow /en/1*\nAllow: /en/1*7\nDisallow: /über\nAllow: \nCrawl-delay: 1e1\n",
    "t3": "User-agent: TidyBot\nDisallow:\n\nUser-agent: *\nDisallow: /\nAllow: /*/en/\nAllow: /en/5\nDisallow: /en/5$\nAllow: /*#top$\nCrawl-delay: -4\nCrawl-delay: 0.5\nNoindex: /x\n",
    "t4": "﻿user-agent: greedybot\nDisallow: /**/2*\nDisallow: /e*n/*8\ndisallaw: /es\nAllow: /es/3\nSitemap: https://t4.example/s.xml\nSitemap: https://t4.example/s.xml\nUser-agent: greedybot\nDisallow: /a$b\nDisallow: /The\nAllowed: /no\n",
}
AGENTS = ("TidyBot", "GreedyBot", "tidybot/2.0", "*")
#: Patterns and texts for the matching queries: each way to match, with signs that other languages of patterns read otherwise.
PATTERNS = ("/", "/kiln", "/kiln*", "*/kiln", "/kiln*.csv", "/m**n", "/q$", "/q*r$", "/q$r", "/q$*", "", "*", "$", "/u*v*w", "/%5b", "/k.l", "/(t|s)+", "/jar*jar$")
TEXTS = ("/", "/kiln", "/kilns.csv", "/kiln/2/ash.csv?full", "/oldkiln", "/Kiln", "/mZn", "/mZno", "/q", "/qr", "/q$r", "/uvvw", "/uwv", "/%5b", "/[", "/k.l", "/kxl", "/robots.txt", "/jar", "/jarjar", "/t")
URLS = (
    "", "https://atlas.example", "http://tiles.atlas.example/5/7?next=https://atlas.example/8", "HTTPS://Clerk:99@Depot.Example:4443", "http://clerk@depot.example:00080?page=2", "https://depot.example:80#top",
    "ftp://mirror.example/iso", "tel:+4930", "/shelf/9", "shelf?row=4", "http://DEPOT.example/Upper", "https://depot.example:0443/x?y", "/ö?ü#ä", "/s p\"q<r>`t", "/{box}%5B",
    "ws://depot.example:80/live", "http:depot.example/one", "https:///depot.example//two", "http://depot.example:65536/", "http://depot.example:port/", "http://de pot.example/", "http://", "gopher://depot.example/",
)

#: Files of many hosts: each order of a customer adds one of these lines to the customer's file.  ``{n}`` is a number, ``<FF>`` a byte that is not UTF-8.
LINES = (
    "User-agent: TidyBot", "user agent: greedybot", "USERAGENT : *", "User-Agent: Other{n}", "Disallow: /shelf/{n}", "Dissallow: /*{n}$", "disalow /box*{n}", "Allow: /shelf/{n}/open", "allow : /*.csv$", "Disallow:",
    "Allow:", "Crawl-delay: {n}.5", "Crawl-delay: -{n}", "crawl delay: soon", "crawldelay 1e{n}", "Sitemap: https://s{n}.example/map.xml # main", "site map: https://s.example/ö", "Noindex: /{n}", "# remark {n}", "",
    "Disallow: /quay<FF>{n}", "sitemap: https://s.example/<FF>", "Disallow: /öl/{n}\u00a0\u3000", "\tAllow:\t/tab{n}\t# why", "Disallow: /a b\"{n}", "Crawl-delay: .{n}", "Disallow: /long{n}" + "x" * 1100 + "$", "Disallow: /long{n}" + "y" * 1100,
)
#: What ends a line.
ENDS = ("\n", "\r\n", "\r", "\n\n", "\x00", "\r\r\n")
#: What a file begins and ends with.
HEADS = ("", "\ufeff", "Crawl-delay: 3\n", "Disallow: /early\n", "User-agent: *\n")
TAILS = ("", "User-agent: Last", "Disallow: /last", "User-agent: TidyBot\n")
#: Links of many shapes: ``{n}`` is a number.
HOSTS = (
    ("http://ana@H{n}.Depot.Example:80/a", "http://h{n}.depot.example"), ("https://depot.example:{n}/", "https://depot.example:{n}"), ("http://d%65pot{n}.ex%41mple/", "http://depot{n}.example"),
    ("http://h{n}.b\u00fccher.example/", "http://h{n}.xn--bcher-kva.example"), ("http://D\u00c9P\u00d4T.example/{n}", "http://xn--dpt-bma0d.example"), ("http://\u6771\u4eac.example/{n}", "http://xn--1lqs71d.example"),
)
#: Hosts that are none, and the error of each.
BROKEN = (
    ("http://256.1.1.{n}/", "InvalidIpv4Address"), ("http://1.2.3.4.5/{n}", "InvalidIpv4Address"), ("http://09.{n}/", "InvalidIpv4Address"), ("http://{n}.0x/g", None), ("http://4294967296/{n}", "InvalidIpv4Address"), ("http://1..{n}/", "InvalidIpv4Address"),
    ("http://[1:2:3:{n}]/", "InvalidIpv6Address"), ("http://[::1::{n}]/", "InvalidIpv6Address"), ("http://[1:2:3:4:5:6:7:8:{n}]/", "InvalidIpv6Address"), ("http://[12345::{n}]/", "InvalidIpv6Address"), ("http://[::1.2.3]/{n}", "InvalidIpv6Address"), ("http://[::{n}/", "InvalidIpv6Address"),
    ("http://a%00b{n}/", "InvalidDomainCharacter"), ("http://a%5Eb{n}/", "InvalidDomainCharacter"), ("http://a%{n}zb/", "InvalidDomainCharacter"), ("http://%FF{n}.example/", "IdnaError"), ("http://h:{n}x/", "InvalidPort"), ("http://:{n}/", "EmptyHost"),
)
