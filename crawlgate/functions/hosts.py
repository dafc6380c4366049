"""Hosts of special URLs: decoded, in ASCII, and addresses in the one form that each has.

All columns are Latin-1 (see ``latin1``).  A struct of ``host`` and ``error``
comes back, of which one is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlgate.functions.latin1 import let, lower_ascii, to_text

#: Characters that no domain may have.
_BAD_DOMAIN = r"[\x00-\x20\x7f#%/:<>?@\[\\\]^|]"
#: A last part that makes a domain an IPv4 address, or a broken one.
_NUMBER_LAST = r"(?i)(?:^|[.])(?:[0-9]+|0x[0-9a-f]*)[.]?$"
_PLAIN = r"^(?:[A-Za-z0-9_\-]+[.])*[A-Za-z_\-][A-Za-z0-9_\-]*[.]?$"
#: Letters that newer rules keep and ``java.net.IDN`` replaces or drops.
_DEVIATIONS = "[\u00df\u1e9e\u03c2\u200c\u200d]"


def _result(host: Column | None = None, error: Column | str | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct((none if host is None else host).alias("host"), (none if error is None else F.lit(error) if isinstance(error, str) else error).alias("error"))


def host_of(host: Column) -> Column:
    """The host of a URL of a special scheme; it is not empty."""
    return F.when(host.rlike(_PLAIN), _result(lower_ascii(host))).when(host.startswith("["), _ipv6(host)).otherwise(let(_ascii(host), _named))


def _ascii(host: Column) -> Column:
    """The domain in ASCII and lower case, or its error."""
    # What is no escape stays, as a percent sign.
    signs = F.regexp_replace(F.regexp_replace(host, "%(?![0-9A-Fa-f]{2})", "%25"), "[+]", "%2B")
    decoded = F.when(F.contains(host, F.lit("%")), F.try_url_decode(to_text(signs))).otherwise(to_text(host))

    def known(text: Column) -> Column:
        mapped = F.call_function("try_reflect", F.lit("java.net.IDN"), F.lit("toASCII"), F.lower(text))
        return (
            F.when(text.isNull() | F.contains(text, F.lit("\ufffd")), _result(error="IdnaError"))
            .when(~text.rlike(r"[^\x00-\x7f]"), _result(F.lower(text)))
            .when(F.lower(text).rlike(_DEVIATIONS), _result(error="IdnaUnsupported"))
            .otherwise(let(mapped, lambda m: F.when(m.isNull(), _result(error="IdnaError")).otherwise(_result(F.lower(m)))))
        )

    return let(decoded, known)


def _named(ascii: Column) -> Column:
    host = ascii["host"]
    return (
        F.when(ascii["error"].isNotNull(), _result(error=ascii["error"]))
        .when(host == "", _result(error="EmptyHost"))
        .when(host.rlike(_BAD_DOMAIN), _result(error="InvalidDomainCharacter"))
        .when(host.rlike(_NUMBER_LAST), _ipv4(host))
        .otherwise(_result(host))
    )


def _ipv4(host: Column) -> Column:
    """Up to four numbers, decimal, octal or hexadecimal; the last fills all bytes that are left."""
    parts = F.split(F.regexp_replace(host, "[.]$", ""), "[.]", -1)

    def value(p: Column) -> Column:
        base = F.when(p.rlike("^0[xX][0-9A-Fa-f]*$"), 16).when(p.rlike("^0[0-7]+$"), 8).when(p.rlike("^(?:0|[1-9][0-9]*)$"), 10)
        digits = F.regexp_replace(p, "^0[xX]?0*", "")
        # Numbers of over 15 digits have more than 32 bits in any base.
        large = F.lit(1 << 40).cast("long")
        read = lambda d: F.when(base.isNull(), None).when(d == "", F.lit(0).cast("long")).when(F.length(d) > 15, large).otherwise(F.coalesce(*[F.when(base == k, F.conv(d, k, 10)) for k in (16, 8, 10)]).cast("long"))
        return let(digits, read)

    def address(v: Column) -> Column:
        n = F.size(v)
        last = F.element_at(v, n)
        high = F.aggregate(F.slice(v, 1, n - 1), F.lit(0).cast("long"), lambda sum, x: sum * 256 + x)
        room = F.pow(F.lit(256.0), F.lit(5) - n).cast("long")
        bad = (n > 4) | F.exists(v, lambda x: x.isNull()) | F.exists(F.slice(v, 1, n - 1), lambda x: x > 255) | (last >= room)
        whole = high * room + last
        dotted = F.concat_ws(".", *[F.shiftright(whole, k).bitwiseAND(F.lit(255).cast("long")).cast("string") for k in (24, 16, 8, 0)])
        return F.when(F.coalesce(bad, F.lit(True)), _result(error="InvalidIpv4Address")).otherwise(_result(dotted))

    # More parts than an address has are not read.
    return F.when(F.size(parts) > 4, _result(error="InvalidIpv4Address")).otherwise(let(F.transform(parts, value), address))


def _ipv6(host: Column) -> Column:
    """Eight pieces, one run of zero pieces written as "::", the last two perhaps as an IPv4 address."""
    inside = lower_ascii(F.regexp_extract(host, r"^\[([^\]]*)\]$", 1))
    byte = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    tail = rf"(?:^|:){byte}[.]{byte}[.]{byte}[.]{byte}$"
    pair = lambda text, a, b: F.lower(F.hex(F.regexp_extract(text, tail, a).cast("long") * 256 + F.regexp_extract(text, tail, b).cast("long")))
    pieces = F.when(inside.rlike(tail), F.concat(F.regexp_extract(inside, r"^(.*:)[^:]*$", 1), pair(inside, 1, 2), F.lit(":"), pair(inside, 3, 4))).otherwise(inside)
    listed = lambda text: F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ":", -1))

    def sides(text: Column) -> Column:
        short = F.contains(text, F.lit("::"))
        left = listed(F.when(short, F.substring_index(text, "::", 1)).otherwise(text))
        right = listed(F.when(short, F.regexp_extract(text, "::(.*)$", 1)).otherwise(""))
        return let(F.struct(short.alias("short"), left.alias("left"), right.alias("right")), whole)

    def whole(x: Column) -> Column:
        n = F.size(x["left"]) + F.size(x["right"])
        good = F.forall(F.concat(x["left"], x["right"]), lambda p: p.rlike("^[0-9a-f]{1,4}$")) & F.when(x["short"], n <= 7).otherwise(n == 8)
        filled = F.concat(x["left"], F.array_repeat(F.lit("0"), F.greatest(8 - n, F.lit(0))), x["right"])
        text = F.array_join(F.transform(filled, lambda p: F.regexp_replace(p, "^0+(?=.)", "")), ":")
        return F.when(good, let(text, lambda t: _result(F.concat(F.lit("["), shortest(t), F.lit("]"))))).otherwise(_result(error="InvalidIpv6Address"))

    def shortest(text: Column) -> Column:
        out = text
        for k in range(2, 9):
            # The first of the longest runs; longer ones are tried before.
            run = rf"^(.*?)(?:^|:)0(?::0){{{k - 1}}}(?::|$)(.*)$"
            out = F.when(text.rlike(run), F.concat(F.regexp_extract(text, run, 1), F.lit("::"), F.regexp_extract(text, run, 2))).otherwise(out)
        return out

    return let(pieces, sides)
