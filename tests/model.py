"""One robots file, one agent, one URL at a time: a plain model to hold the tables against."""

from __future__ import annotations

import re
from functools import lru_cache

WORDS = {
    "user_agent": ["user-agent", "user agent", "useragent"],
    "allow": ["allow"],
    "disallow": ["disallow", "dissallow", "dissalow", "disalow", "diasllow", "disallaw"],
    "sitemap": ["sitemap", "site-map", "site map"],
    "crawl_delay": ["crawl-delay", "crawl delay", "crawldelay"],
}
SPACE = [b"\t", b"\n", b"\x0b", b"\x0c", b"\r", b" ", b"\xc2\x85", b"\xc2\xa0"] + [chr(c).encode() for c in (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
NUMBER = re.compile(rb"[+-]?(inf|infinity|nan|\d+(\.\d*)?(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?)", re.I)


def trimmed(value):
    while any(value.startswith(s) for s in SPACE):
        value = value[next(len(s) for s in SPACE if value.startswith(s)) :]
    while any(value.endswith(s) for s in SPACE):
        value = value[: -next(len(s) for s in SPACE if value.endswith(s))]
    return value


def parsed(body):
    """(kind, value, delay) of each line."""
    body = body.replace(b"\0", b"\n")
    for mark in (b"\xef", b"\xbb", b"\xbf"):
        body = body.removeprefix(mark)
    parts = re.split(rb"\r+\n?|\n", body)
    if parts[-1] == b"":
        parts.pop()
    out = []
    for line in parts:
        kind, value, delay = "raw", line, None
        rest = line.lstrip(b" \t")
        for name, words in WORDS.items():
            for w in words:
                if rest[: len(w)].lower() == w.encode() and (m := re.match(rb"[ \t]*:|[ \t]+", rest[len(w) :])):
                    kind, value = name, trimmed(rest[len(w) + m.end() :].split(b"#")[0])
        if kind == "crawl_delay":
            number = float(value) if NUMBER.fullmatch(value) else -1.0
            if number >= 0:
                delay = number
            else:
                kind, value = "raw", line
        if kind == "disallow" and not value:
            kind, value = "allow", b"/"
        out.append((kind, value, delay))
    return out


def encoded(value):
    return "".join(f"%{b:02X}" if b <= 32 or b >= 127 or b in b'"<>`' else chr(b) for b in value)


def policy(body, agent):
    """Rules, delay and sitemaps."""
    lines = parsed(body)
    maps = [v for k, v, _ in lines if k == "sitemap"]
    lines = [x for x in lines if x[0] not in ("sitemap", "raw")]
    agent = agent.lower().encode()
    named = [v.lower() for k, v, _ in lines if k == "user_agent"]
    if agent not in named:
        agent = b"*"
    own, active, before = [], not named, None
    for k, v, d in lines:
        if k == "user_agent":
            if before != "user_agent":
                active = False
            active = active or v.lower() == agent
        elif active:
            own.append((k, v, d))
        before = k
    delay = next((d for k, _, d in own if k == "crawl_delay"), None)
    if delay is None:
        for k, _, d in lines:
            if k == "user_agent":
                break
            if k == "crawl_delay":
                delay = d
    rules = []
    for k, v, _ in own:
        if k in ("allow", "disallow"):
            try:
                v.decode()
            except UnicodeDecodeError:
                continue
            rules.append((encoded(v), k == "allow"))
    sitemaps = []
    for v in maps:
        try:
            sitemaps.append(v.decode())
        except UnicodeDecodeError:
            pass
    return rules, delay, sitemaps


@lru_cache(None)
def glob(pattern, text):
    """Whether the whole text is the pattern, whose stars stand for anything."""
    if not pattern:
        return not text
    if pattern[0] == "*":
        return glob(pattern[1:], text) or (bool(text) and glob(pattern, text[1:]))
    return bool(text) and text[0] == pattern[0] and glob(pattern[1:], text[1:])


def matches(pattern, text):
    if "$" in pattern:
        head, _, tail = pattern.partition("$")
        return not tail.strip("*$") and glob(head, text)
    return glob(pattern + "*", text)


def allowed(rules, target):
    if target == "/robots.txt":
        return True
    found = [(len(p), a) for p, a in rules if matches(p, target)]
    return max(found)[1] if found else True
