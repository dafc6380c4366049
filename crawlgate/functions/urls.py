"""URL functions by the WHATWG rules, as column expressions.

Hosts of special schemes are decoded, brought to ASCII and, if they are
addresses, written in the one form that an address has; see ``hosts``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlgate.functions.hosts import host_of
from crawlgate.functions.latin1 import from_text, let, lower_ascii, percent_encode

SPECIAL = ("http", "https", "ws", "wss", "ftp", "file")
_DEFAULT_PORTS = {"http": "80", "https": "443", "ws": "80", "wss": "443", "ftp": "21"}
_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"

def parse(url: Column) -> Column:
    """A struct of ``scheme host port path query fragment`` (encoded) and ``error``, null if it parsed.

    The URL is taken as Latin-1 bytes (see ``from_text``).
    """
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(from_text(url), r"^[\x00-\x20]+", ""), r"[\x00-\x20]+$", ""), r"[\t\n\r]", "")
    return let(text, _parsed)


def _parsed(text: Column) -> Column:
    scheme = lower_ascii(F.regexp_extract(text, _SCHEME, 1))
    fragment = F.regexp_extract(text, r"^[^#]*(#[\x00-\xff]*)", 1)
    query = F.regexp_extract(text, r"^[^?#]*(\?[^#]*)", 1)
    body = F.regexp_extract(text, _SCHEME + r"([^?#]*)", 2)
    special = scheme.isin(*SPECIAL)
    body = F.when(special, F.translate(body, "\\", "/")).otherwise(body)
    return let(F.struct(text.alias("text"), scheme.alias("scheme"), special.alias("special"), body.alias("body"), query.alias("query"), fragment.alias("fragment")), _split)


def _split(u: Column) -> Column:
    scheme, special, body = u["scheme"], u["special"], u["body"]
    listed = special & (scheme != "file")
    parted = body.startswith("//")
    cut = F.struct(
        scheme.alias("scheme"),
        special.alias("special"),
        listed.alias("listed"),
        u["query"].alias("query"),
        u["fragment"].alias("fragment"),
        (listed | parted).alias("has_netloc"),
        (~special & ~body.startswith("/")).alias("opaque"),
        F.when(listed, F.regexp_extract(body, r"^/*([^/]*)", 1)).otherwise(F.regexp_extract(body, r"^//([^/]*)", 1)).alias("netloc"),
        F.when(listed, F.regexp_extract(body, r"^/*[^/]*([\x00-\xff]*)", 1)).when(parted, F.regexp_extract(body, r"^//[^/]*([\x00-\xff]*)", 1)).otherwise(body).alias("path"),
    )
    return let(cut, lambda c: let(F.regexp_replace(c["netloc"], r"^[\x00-\xff]*@", ""), lambda after: _hosted(c, after)))


def _hosted(c: Column, after: Column) -> Column:
    bracket = after.startswith("[")
    named = F.struct(
        F.when(bracket, F.regexp_extract(after, r"^(\[[^\]]*\])", 1)).otherwise(F.regexp_extract(after, r"^([^:]*)", 1)).alias("host"),
        F.when(bracket, F.regexp_extract(after, r"^\[[^\]]*\]([\x00-\xff]*)", 1)).otherwise(F.regexp_extract(after, r"^[^:]*([\x00-\xff]*)", 1)).alias("rest"),
        bracket.alias("bracket"),
    )

    def hosted(h: Column) -> Column:
        port = F.regexp_replace(F.regexp_extract(h["rest"], r"^:([0-9]*)$", 1), r"^0+(?=[0-9])", "")
        plain = F.struct(h["host"].alias("host"), F.lit(None).cast("string").alias("error"))
        known = F.when(c["special"] & (h["host"] != ""), host_of(h["host"])).otherwise(plain)
        return let(F.struct(port.alias("port"), known.alias("known")), lambda x: _made(c, h, x["port"], x["known"]))

    return let(named, hosted)


def _made(c: Column, h: Column, port: Column, known: Column) -> Column:
    scheme, host = c["scheme"], h["host"]
    error = (
        F.when(scheme == "", F.lit("RelativeUrlWithoutBase"))
        .when(c["special"] & h["bracket"] & (host == ""), F.lit("InvalidIpv6Address"))
        .when(c["listed"] & (host == ""), F.lit("EmptyHost"))
        .when(c["has_netloc"] & ~h["rest"].rlike(r"^(:[0-9]*)?$"), F.lit("InvalidPort"))
        .when((F.length(port) > 5) | (port.try_cast("int") > 65535), F.lit("InvalidPort"))
        .otherwise(known["error"])
    )
    usual = F.create_map(*[F.lit(x) for kv in _DEFAULT_PORTS.items() for x in kv])
    return F.struct(
        scheme.alias("scheme"),
        known["host"].alias("host"),
        F.when(usual[scheme] == port, F.lit("")).otherwise(port).alias("port"),
        F.when(c["opaque"], percent_encode(c["path"], "control")).otherwise(_path(c["path"], c["special"])).alias("path"),
        F.when(c["special"], percent_encode(c["query"], "query")).otherwise(percent_encode(c["query"], "plain_query")).alias("query"),
        percent_encode(c["fragment"], "fragment").alias("fragment"),
        c["opaque"].alias("opaque"),
        error.alias("error"),
    )


def _path(path: Column, special: Column) -> Column:
    """Dot segments resolved, the rest encoded; a special URL has at least "/"."""
    segments = F.split(F.regexp_replace(path, "^/", ""), "/", -1)
    n = F.size(segments)

    def fold(done: Column, x: Column) -> Column:
        plain = F.lower(F.regexp_replace(x["s"], "%2[eE]", "."))
        last = x["i"] == n - 1
        shorter = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        end = F.when(last, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        return F.when(plain == "..", F.concat(shorter, end)).when(plain == ".", F.concat(done, end)).otherwise(F.concat(done, F.array(x["s"])))

    numbered = F.transform(segments, lambda s, i: F.struct(s.alias("s"), i.alias("i")))
    resolved = F.aggregate(numbered, F.array().cast("array<string>"), fold)
    # Only paths that hold a dot segment are folded.
    dotted = path.rlike(r"(?i)(?:^|/)(?:\.|%2e){1,2}(?:/|$)")
    whole = F.when(dotted, F.concat(F.lit("/"), F.array_join(resolved, "/"))).otherwise(path)
    return let(whole, lambda w: let(F.when(special & ~w.startswith("/"), F.concat(F.lit("/"), w)).otherwise(w), lambda x: percent_encode(x, "path")))


#: Absolute URLs that stay as they are behind the host: a host of letters whose last part is no number, no sign to encode, no
#: dot segment, a short port.
_PLAIN = r"^[Hh][Tt][Tt][Pp][Ss]?://(?:[A-Za-z0-9\-]+[.])*[A-Za-z][A-Za-z0-9\-]*(?::[0-9]{1,4})?(?:(?!.*(?:/[.]|%2[Ee]))[/?#][!#$&(-;=?@A-Z\[\]_a-z~%]*)?\z"


def _plain_target(url: Column) -> Column:
    return let(F.regexp_replace(url, "^[^/]*//[^/?#]*", ""), lambda tail: F.when(tail.startswith("/"), tail).otherwise(F.concat(F.lit("/"), tail)))


def _plain_origin(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(url, "^([^/]*//[^/?#]*)", 1)), "^(http:.*):0*80$|^(https:.*):0*443$", "$1$2"), ":0*(?=[0-9]|$)", ":")


def _target(url: Column, u: Column) -> Column:
    return F.coalesce(F.when(u["error"].isNull(), F.concat(u["path"], u["query"], u["fragment"])), let(from_text(url), lambda t: percent_encode(t, "rule")))


def prepare_url(url: Column) -> Column:
    """The text that rules are matched with: path, query and fragment, or the encoded relative URL.

    Plain URLs, and those that begin with a slash, need no parsing.
    """
    relative = let(from_text(url), lambda t: percent_encode(t, "rule"))
    parsed = let(parse(url), lambda u: _target(url, u))
    return F.when(url == "", F.lit("/")).when(url.rlike(_PLAIN), _plain_target(url)).when(url.startswith("/"), relative).otherwise(parsed)


def _located(u: Column) -> Column:
    error = F.when(u["error"].isNotNull(), u["error"]).when(u["opaque"], F.lit("SetHostOnCannotBeABaseUrl")).when(~u["scheme"].isin("http", "https"), F.lit("EmptyHost"))
    found = F.concat(u["scheme"], F.lit("://"), u["host"], F.when(u["port"] != "", F.concat(F.lit(":"), u["port"])).otherwise(""), F.lit("/robots.txt"))
    return F.struct(F.when(error.isNull(), found).alias("robots_url"), error.alias("error"))


def robots_location(url: Column) -> Column:
    """A struct of ``robots_url`` and ``error``, of which one is null."""
    return let(parse(url), _located)


def located_target(url: Column) -> Column:
    """A struct of ``origin`` and ``target`` (see ``prepare_url``), by one parse, or none for a plain URL."""

    def both(u: Column) -> Column:
        target = F.when(url == "", F.lit("/")).otherwise(_target(url, u))
        return F.struct(F.regexp_replace(_located(u)["robots_url"], "/robots\\.txt$", "").alias("origin"), target.alias("target"))

    plain = F.struct(_plain_origin(url).alias("origin"), _plain_target(url).alias("target"))
    return F.when(url.rlike(_PLAIN), plain).otherwise(let(parse(url), both))


def origin(url: Column) -> Column:
    """Scheme, host and port, by which URLs and robots files meet; null where there is none."""
    return F.regexp_replace(robots_location(url)["robots_url"], "/robots\\.txt$", "")
