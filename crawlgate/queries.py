"""The driver's queries for robots files, and DuckDB SQL written separately for each."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlgate.corpus import AGENTS, BROKEN, ENDS, FILES, HEADS, HOSTS, LINES, PATTERNS, TAILS, TEXTS, URLS
from crawlgate.functions.latin1 import from_text, to_text
from crawlgate.functions.urls import origin, prepare_url, robots_location
from crawlgate.operators import patterns
from crawlgate.operators.groups import agent_key, file_key, grouped
from crawlgate.operators.lexer import debug_lines, directives, lines
from crawlgate.plans.policy import compile_policies, debug_policies, parsed_files
from crawlgate.plans.verdicts import check, score
from crawlgate.sources.robots_files import FOLDERS, from_files, from_texts, remove_files, to_files
from crawlgate.sources.shared import shared_dir


def _quoted(text: str) -> str:
    """A text as an SQL string that Spark and DuckDB read alike."""
    out = "'" + text.replace("'", "''") + "'"
    for c in ("\n", "\r", "\t", "\x00", "\ufeff"):
        out = out.replace(c, f"' || chr({ord(c)}) || '" if ord(c) < 256 else f"' || decode(unhex('EFBBBF')) || '")
    return out


def _chosen(texts, number: str, n: str = "''") -> str:
    """SQL that chooses one of the texts by a number; ``n`` takes the place of ``{n}``."""
    cases = " ".join(f"WHEN {i} THEN " + _quoted(t).replace("{n}", f"' || {n} || '") for i, t in enumerate(texts))
    return f"(CASE ({number}) % {len(texts)} {cases} END)"


#: A customer's file: lines by the orders' keys, what ends them by their prices, and a head and a tail by the customer.
_LINE = _chosen(LINES, "o_orderkey * 7 + o_custkey", "CAST(o_orderkey % 9 + 1 AS VARCHAR(9))") + " || " + _chosen(ENDS, "o_orderkey + o_custkey")
_HEAD, _TAIL = _chosen(HEADS, "o_custkey"), _chosen(TAILS, "o_custkey")


def _customer_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_custkey", "o_orderkey", f"{_LINE} AS line".replace("VARCHAR(9)", "STRING").replace("decode(unhex('EFBBBF'))", "decode(unhex('EFBBBF'), 'UTF-8')"))
    files = orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "line"))).alias("l"))
    head, tail = (x.replace("decode(unhex('EFBBBF'))", "decode(unhex('EFBBBF'), 'UTF-8')") for x in (_HEAD, _TAIL))
    return files.select(F.col("o_custkey").alias("robots_id"), F.concat(F.expr(head), F.array_join(F.transform("l", lambda x: x["line"]), ""), F.expr(tail)).alias("txt"))


def _customer_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each customer with orders."""
    latin = F.regexp_replace(from_text(F.col("txt")), "<FF>", "\u00ff")
    return _customer_texts(spark, sf_dir).select("robots_id", F.encode(latin, "ISO-8859-1").alias("content"))


def _robots(spark: SparkSession) -> DataFrame:
    return from_texts(spark, {k: v.encode() for k, v in FILES.items()})


def _agents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a,) for a in AGENTS], "agent string")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def _text(column: str):
    return F.coalesce(to_text(F.col(column)), F.lit("?"))


def robots_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(_robots(spark)).select("robots_id", F.col("line_no").cast("long").alias("line_no"), _text("line").alias("line"))


def robots_directives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = directives(_robots(spark)).filter("kind <> 'raw'")
    return rows.select("robots_id", F.col("line_no").cast("long").alias("line_no"), "kind", _text("value").alias("value"), F.col("delay").cast("double").alias("delay"))


def directive_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return directives(_robots(spark)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def document_directives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arbitrary text through the lexer: what each document's lines would be."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("robots_id"), F.encode("text", "UTF-8").alias("content"))
    return directives(docs).groupBy("robots_id", "kind").agg(F.count(F.lit(1)).alias("n")).select(F.col("robots_id").alias("doc_id"), "kind", "n")


def agent_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grouped(_robots(spark))
    return rows.select("robots_id", F.col("line_no").cast("long").alias("line_no"), F.col("grp").cast("long").alias("grp"), "n_ua")


def agent_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compile_policies(_robots(spark), _agents(spark)).select("robots_id", "agent", "matched_agent")


def captured_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = compile_policies(_robots(spark), _agents(spark)).select("robots_id", "agent", F.explode("rules").alias("r"))
    return rules.select("robots_id", "agent", F.col("r.seq").cast("long").alias("line_no"), F.col("r.pattern").alias("pattern"), F.col("r.is_allowed").alias("is_allowed"))


def crawl_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compile_policies(_robots(spark), _agents(spark)).select("robots_id", "agent", F.col("delay").cast("double").alias("delay"))


def sitemaps_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed_files(_robots(spark)).select("robots_id", F.posexplode("sitemaps").alias("place", "sitemap")).withColumn("place", F.col("place").cast("long"))


def _rules(spark: SparkSession, given=PATTERNS) -> DataFrame:
    rows = spark.createDataFrame([(p,) for p in given], "raw string")
    return rows.select("raw", patterns.compiled(F.lit(0), from_text(F.col("raw")), F.lit(True)).alias("rule"))


def rule_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(u,) for u in URLS], "raw string")
    return rows.select("raw", patterns.compiled(F.lit(0), from_text(F.col("raw")), F.lit(True))["pattern"].alias("pattern"))


def rule_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rules(spark).select("raw", F.col("rule.mode").alias("mode"), patterns.effective(F.col("rule")).alias("effective"), F.col("rule.n").cast("long").alias("n"))


def _matches(mode: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        texts = F.explode(F.array(*[F.lit(t) for t in TEXTS]))
        rows = _rules(spark).filter(F.col("rule.mode") == mode).select("raw", "rule", texts.alias("target"))
        return rows.select("raw", "target", patterns.matches(F.col("rule"), F.col("target")).alias("matched"))

    return query


def longest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even patterns allow, odd ones forbid: who decides on each text."""
    listed = spark.createDataFrame([(i, p, i % 2 == 0) for i, p in enumerate(PATTERNS)], "i int, p string, a boolean")
    rules = listed.select(patterns.compiled(F.col("i"), from_text(F.col("p")), F.col("a")).alias("rule")).agg(F.collect_list("rule").alias("rules"))
    rows = rules.select("rules", F.explode(F.array(*[F.lit(t) for t in TEXTS])).alias("target"))
    return rows.select("target", patterns.allowed(F.col("rules"), F.col("target")).alias("allowed"))


EXEMPT = ("/robots.txt", "/robots.txt?x", "https://h.example/robots.txt", "https://h.example/robots.txt#f", "/a/robots.txt")


def robots_txt_exempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(u,) for u in EXEMPT], "url string")
    none = F.array(patterns.compiled(F.lit(0), F.lit("/"), F.lit(False)))
    return rows.select("url", prepare_url(F.col("url")).alias("target")).select("url", patterns.allowed(none, F.col("target")).alias("allowed"))


def prepare_url_absolute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", prepare_url(F.col("url")).alias("target"))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir)
    return pages.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("place", "link"))


def prepare_url_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir).select("page_id", F.col("place").cast("long").alias("place"), prepare_url(F.col("link")).alias("target"))


def robots_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", robots_location(F.col("url"))["robots_url"].alias("robots_url"))


def robots_url_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(u,) for u in URLS], "url string")
    return rows.select("url", F.inline(F.array(robots_location(F.col("url")))))


#: Spellings of each directive, good or not.
SPELLINGS = (
    "User-Agent: x", "user agent x", "USERAGENT : x", "Useragents: x", "Allow /x", "allow:x", "Allowed: /x", "Disallow: x", "dissallow x", "Dissalow:x", "disalow : x", "diasllow: x", "disallaw: x", "dissallow/b",
    "Sitemap: x", "site-map: x", "Site Map: x", "sitemaps: x", "Crawl-delay: 1", "crawl delay: 2.5", "crawldelay 3", "Crawl-delay: -1", "Crawl-delay: soon", "# note", "Disallow:", "Disallow: # all", "Disallow : ",
)


def typo_forgiveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = from_texts(spark, {line: line.encode() for line in SPELLINGS})
    return directives(files).select(F.col("robots_id").alias("line"), "kind")


def empty_disallow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Disallow without a path is an Allow of the whole site, which outweighs an empty Allow."""
    files = from_texts(spark, {line: line.encode() for line in SPELLINGS if line.startswith("Disallow")})
    return directives(files).select(F.col("robots_id").alias("line"), "kind", _text("value").alias("value"))


def _host_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policies of each origin among the pages: its file is dealt out by the length of its host."""
    origins = _pages(spark, sf_dir).select(origin(F.col("url")).alias("origin")).distinct()
    number = F.length(F.regexp_replace("origin", "^https?://", "")) % len(FILES)
    files = origins.select("origin", F.concat(F.lit("t"), number).alias("robots_id"))
    return files.join(compile_policies(_robots(spark), _agents(spark)), "robots_id")


def page_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: may each agent fetch each page, and why."""
    urls = _pages(spark, sf_dir).select(F.col("page_id").alias("url_id"), "url")
    return score(urls, _host_policies(spark, sf_dir)).select(F.col("url_id").alias("page_id"), "agent", "allowed", "rule", "reason")


def link_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of each page, judged by the file of the page's host."""
    links = _links(spark, sf_dir)
    number = F.length(F.regexp_extract("url", "^https?://([^/?#]*)", 1)) % len(FILES)
    urls = links.select(F.struct("page_id", "place").alias("url_id"), F.col("link").alias("url"), F.concat(F.lit("t"), number).alias("robots_id"))
    found = check(urls, compile_policies(_robots(spark), _agents(spark)))
    return found.groupBy(F.col("url_id.page_id").alias("page_id"), "agent").agg(F.count(F.lit(1)).alias("links"), F.count_if("allowed").alias("allowed_links"))


def agent_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_verdicts(spark, sf_dir).groupBy("agent").agg(F.count(F.lit(1)).alias("pages"), F.count_if("allowed").alias("allowed_pages"))


def allowed_by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = _pages(spark, sf_dir).select("page_id", F.regexp_extract("url", "^https?://([^/?#]*)", 1).alias("host"))
    return page_verdicts(spark, sf_dir).join(hosts, "page_id").groupBy("host", "agent").agg(F.count(F.lit(1)).alias("pages"), F.count_if("allowed").alias("allowed_pages"))


def delay_by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _host_policies(spark, sf_dir)
    return rows.select("origin", "agent", F.col("delay").cast("double").alias("delay"))


NAMES = ("TidyBot", "ÄBot", "bot/1.0", "*", "A B")


def agent_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How an agent that asks, and one that a file names, are compared."""
    rows = spark.createDataFrame([(n,) for n in NAMES], "agent string")
    return rows.select("agent", to_text(agent_key(F.col("agent"))).alias("asked"), to_text(file_key(from_text(F.col("agent")))).alias("named"))


def file_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(_customer_files(spark, sf_dir))
    # Bytes that are not UTF-8 are shown as the corpus writes them.
    shown = to_text(F.regexp_replace("line", "\u00ff", "<FF>"))
    return rows.select("robots_id", F.col("line_no").cast("long").alias("line_no"), shown.alias("line"))


def file_directives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = directives(_customer_files(spark, sf_dir))
    shown = to_text(F.regexp_replace("value", "\u00ff", "<FF>"))
    return rows.select("robots_id", F.col("line_no").cast("long").alias("line_no"), "kind", shown.alias("value"), F.col("delay").cast("double").alias("delay"))


def file_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grouped(_customer_files(spark, sf_dir))
    return rows.select("robots_id", F.col("line_no").cast("long").alias("line_no"), F.col("grp").cast("long").alias("grp"), "n_ua")


def _customer_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compile_policies(_customer_files(spark, sf_dir), _agents(spark))


def file_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customer_policies(spark, sf_dir).select("robots_id", "agent", "matched_agent")


def file_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = _customer_policies(spark, sf_dir).select("robots_id", "agent", F.explode("rules").alias("r"))
    return rules.select("robots_id", "agent", F.col("r.seq").cast("long").alias("line_no"), F.col("r.pattern").alias("pattern"), F.col("r.mode").alias("mode"), F.col("r.is_allowed").alias("is_allowed"))


def file_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customer_policies(spark, sf_dir).select("robots_id", "agent", F.col("delay").cast("double").alias("delay"))


def file_sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed_files(_customer_files(spark, sf_dir)).select("robots_id", F.posexplode("sitemaps").alias("place", "sitemap")).withColumn("place", F.col("place").cast("long"))


def file_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policies that a rule makes invalid; no other error is ever met, whatever a file holds."""
    return _customer_policies(spark, sf_dir).select("robots_id", "agent", "error", F.size("rules").cast("long").alias("rules"), F.size("sitemaps").cast("long").alias("sitemaps"))


def file_size_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the first 90 bytes of each file are read; signs beyond ASCII are replaced before, so that bytes are characters."""
    plain = _customer_texts(spark, sf_dir).select("robots_id", F.encode(F.regexp_replace("txt", r"[^\x00-\x7f]", "?"), "UTF-8").alias("content"))
    return directives(plain, max_bytes=90).select("robots_id", F.col("line_no").cast("long").alias("line_no"), "kind")


def file_debug(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = debug_lines(directives(_customer_files(spark, sf_dir)).filter("kind in ('user_agent', 'crawl_delay', 'allow')"))
    return shown.select("robots_id", F.col("line_no").cast("long").alias("line_no"), "debug")


def policy_debug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debug_policies(_customer_policies(spark, sf_dir))


#: Files that ``file_source`` has in the shared folder at a time, which bounds its disk and the list of them in the driver.
ROUND_FILES = 100_000


def file_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files as a source: every customer's file written to the shared folder, found by its name and read as bytes.

    Files are written, read and deleted in rounds of about ``ROUND_FILES``.
    """
    path = f"{shared_dir(spark)}/crawlgate-files-{uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    # An estimate is enough: it only says how many rounds there are.
    customers = spark.read.parquet(f"{sf_dir}/orders.parquet").agg(F.approx_count_distinct("o_custkey")).first()[0]
    rounds = max(1, -(-customers // ROUND_FILES))
    # Another hash than that of the folders, so that each round fills all of them.
    number = F.pmod(F.xxhash64("robots_id"), F.lit(rounds)).cast("int")
    texts = _customer_texts(spark, sf_dir).select("robots_id", F.regexp_replace("txt", "<FF>|\u0000", "").alias("text"), number.alias("round"))
    texts.write.partitionBy("round").parquet(f"{path}/texts")
    texts = spark.read.schema(texts.schema).parquet(f"{path}/texts")
    for k in range(rounds):
        to_files(texts.filter((F.col("round") == k) & F.col("text").isNotNull()), f"{path}/{k}")
        found = from_files(spark, f"{path}/{k}", "*.txt", tasks=max(FOLDERS, 4 * spark.sparkContext.defaultParallelism))
        rows = found.select(F.regexp_extract("robots_id", "robots_id=(-?[0-9]+)", 1).cast("long").alias("robots_id"), "content")
        rows.select("robots_id", F.octet_length("content").cast("long").alias("n_bytes"), F.sha2("content", 256).alias("sha256")).write.mode("append").parquet(f"{path}/found")
        remove_files(spark, f"{path}/{k}")
    # A customer without a text has no file.
    none = texts.filter("text IS NULL").select("robots_id", F.lit(None).cast("long").alias("n_bytes"), F.lit(None).cast("string").alias("sha256"))
    return spark.read.schema(none.schema).parquet(f"{path}/found").unionByName(none)


def loose_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that are empty or begin with a star: the first part of a starred rule is searched for, not held at the begin."""
    targets = _pages(spark, sf_dir).select("page_id", F.explode(F.array(F.lit(""), F.concat(F.lit("*"), prepare_url(F.col("url"))))).alias("target"))
    rules = _rules(spark).unionByName(_rules(spark, ("/a*", "a*e", "/*/*1", "b*"))).filter("rule.mode = 'star'").dropDuplicates(["raw"])
    rows = targets.join(F.broadcast(rules), F.lit(True))
    return rows.select("page_id", "target", "raw", patterns.matches(F.col("rule"), F.col("target")).alias("matched"))


def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")


def _location(rows: DataFrame) -> DataFrame:
    return rows.select("o_orderkey", "url", F.inline(F.array(robots_location(F.col("url")))))


def host_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User names, default ports, escapes and letters beyond ASCII in hosts."""
    rows = _numbers(spark, sf_dir).selectExpr("o_orderkey", f"{_chosen([a for a, _ in HOSTS], 'o_orderkey', 'CAST(o_orderkey % 9000 + 1000 AS STRING)')} AS url")
    return _location(rows)


def host_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _numbers(spark, sf_dir).selectExpr("o_orderkey", f"{_chosen([a for a, _ in BROKEN], 'o_orderkey', 'CAST(o_orderkey % 10 AS STRING)')} AS url")
    return _location(rows)


#: The number that a key stands for, and an address of it in many notations.
_IPV4 = "(o_orderkey % 1000000007 * 2654435761 % 4294967296)"
_BYTE = [f"({_IPV4} div {256**k} % 256)" for k in (3, 2, 1, 0)]


def ipv4_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each key as an IPv4 address: one number to four, decimal, octal and hexadecimal."""
    a, b, c, d = _BYTE
    octal = lambda x: f"'0' || conv({x}, 10, 8)"
    hexadecimal = lambda x: f"'0x' || lower(hex({x}))"
    forms = [
        f"{a} || '.' || {b} || '.' || {c} || '.' || {d}",
        f"{_IPV4} || ''",
        hexadecimal(_IPV4),
        f"{octal(a)} || '.' || {hexadecimal(b)} || '.' || ({c} * 256 + {d})",
        f"{hexadecimal(a)} || '.' || {octal(f'({_IPV4} % 16777216)')}",
        f"{a} || '.' || {b} || '.' || {octal(c)} || '.' || {d} || '.'",
    ]
    cases = " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(forms))
    return _location(_numbers(spark, sf_dir).selectExpr("o_orderkey", f"'http://' || (CASE o_orderkey % {len(forms)} {cases} END) || '/p' AS url")).drop("url")


def ipv6_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each key as an IPv6 address whose pieces are zero where a bit of the key is; written in full or with an address of four bytes at its end."""
    piece = lambda k: f"if(shiftright(o_orderkey, {k}) % 2 = 0, 0, o_orderkey % 1000000007 * {7919 + k} % 65535 + 1)"
    full = " || ':' || ".join(f"lpad(hex({piece(k)}), 4, '0')" for k in range(8))
    six = " || ':' || ".join(f"hex({piece(k)})" for k in range(6))
    four = " || '.' || ".join(f"({piece(k)} div 256) || '.' || ({piece(k)} % 256)" for k in (6, 7))
    rows = _numbers(spark, sf_dir).selectExpr("o_orderkey", f"'http://[' || if(o_orderkey % 3 = 0, {six} || ':' || {four}, {full}) || ']:81/' AS url")
    return _location(rows).drop("url")


QUERIES = {
    f.__name__: f
    for f in (
        page_verdicts, robots_lines, robots_directives, typo_forgiveness, empty_disallow, directive_counts, document_directives, agent_groups, agent_resolution, agent_keys, captured_rules, crawl_delays,
        sitemaps_list, rule_encoding, rule_modes, longest_match, robots_txt_exempt, prepare_url_absolute, prepare_url_relative, robots_url, robots_url_cases,
        link_verdicts, agent_comparison, allowed_by_host, delay_by_host, file_lines, file_directives, file_groups, file_agents, file_rules, file_delays, file_sitemaps, file_errors, file_size_cap,
        file_debug, policy_debug, file_source, loose_match, host_names, host_errors, ipv4_hosts, ipv6_hosts,
    )
}
QUERIES |= {"prefix_match": _matches("prefix"), "star_match": _matches("star"), "anchored_match": _matches("regex")}


# --- DuckDB SQL ---------------------------------------------------------------------------------


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(x if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


def _encoded(text: str, signs: str) -> str:
    """Percent-encoding of a string expression, character by character."""
    return f"""array_to_string(list_transform(string_split({text}, ''), lambda c: CASE WHEN c <> '' AND (ord(c) <= 32 OR ord(c) >= 127 OR c IN ({signs})) THEN regexp_replace(hex(encode(c)), '(..)', '%\\1', 'g') ELSE c END), '')"""


_RULE_SIGNS = """'"', '<', '>', '`'"""
_PATH_SIGNS = _RULE_SIGNS + ", '{', '}'"
_QUERY_SIGNS = """'"', '<', '>', ''''"""
_KEYWORD = r"(?:user-agent|user agent|useragent|allow|disallow|dissallow|dissalow|disalow|diasllow|disallaw|sitemap|site-map|site map|crawl-delay|crawl delay|crawldelay)"

def _lines(files: str) -> str:
    """From an SQL of robots_id and txt: files and their lines."""
    return f"""
files(robots_id, txt) AS ({files}),
pieces AS (SELECT robots_id, regexp_split_to_array(ltrim(replace(txt, chr(0), chr(10)), chr(65279)), '\\r+\\n?|\\n') AS a FROM files),
ended AS (SELECT robots_id, CASE WHEN a[len(a)] = '' THEN a[1:len(a) - 1] ELSE a END AS a FROM pieces),
lns AS (SELECT robots_id, unnest(a) AS line, unnest(range(len(a))) AS line_no FROM ended)
"""


_LINES = _lines(f"VALUES {_values([(_quoted(k), _quoted(v)) for k, v in FILES.items()])}")


def _directives(source: str) -> str:
    """From a relation of robots_id, line_no, line: dirs."""
    return f"""
words AS (
  SELECT robots_id, line_no, line,
    regexp_replace(lower(regexp_extract(line, '^[ \\t]*({_KEYWORD.replace("(?:", "(?i:", 1)})(?:[ \\t]*:|[ \\t]+)([^#]*)', 1)), '[- ]', '', 'g') AS w,
    regexp_replace(regexp_extract(line, '^[ \\t]*(?i:{_KEYWORD})(?:[ \\t]*:|[ \\t]+)([^#]*)', 1), '^[\\s\\pZ\\x{{85}}]+|[\\s\\pZ\\x{{85}}]+$', '', 'g') AS v
  FROM {source}),
dirs AS (
  SELECT robots_id, line_no, line,
    CASE WHEN w = 'useragent' THEN 'user_agent' WHEN w = 'allow' THEN 'allow' WHEN w = 'sitemap' THEN 'sitemap'
         WHEN w = 'crawldelay' THEN CASE WHEN regexp_full_match(v, '[+]?([0-9]+([.][0-9]*)?(e[+-]?[0-9]+)?|[.][0-9]+)') THEN 'crawl_delay' ELSE 'raw' END
         WHEN w = '' THEN 'raw' WHEN v = '' THEN 'allow' ELSE 'disallow' END AS kind,
    CASE WHEN w IN ('disallow', 'dissallow', 'dissalow', 'disalow', 'diasllow', 'disallaw') AND v = '' THEN '/' ELSE v END AS value,
    CASE WHEN w = 'crawldelay' THEN TRY_CAST(TRY_CAST(v AS FLOAT) AS DOUBLE) END AS delay
  FROM words)
"""


_GROUPS = """
known AS (SELECT *, kind = 'user_agent' AS ua FROM dirs WHERE kind NOT IN ('sitemap', 'raw')),
firsts AS (SELECT *, ua AND NOT coalesce(lag(ua) OVER (PARTITION BY robots_id ORDER BY line_no), false) AS f FROM known),
grps AS (
  SELECT *, CAST(sum(CAST(f AS INT)) OVER (PARTITION BY robots_id ORDER BY line_no) AS BIGINT) AS grp,
    count(*) FILTER (WHERE ua) OVER (PARTITION BY robots_id) AS n_ua
  FROM firsts)
"""
_POLICIES = f"""
agents(agent) AS (VALUES {_values([(_quoted(a),) for a in AGENTS])}),
asked AS (
  SELECT f.robots_id, a.agent, CASE WHEN EXISTS (SELECT 1 FROM grps g WHERE g.robots_id = f.robots_id AND g.ua AND lower(g.value) = lower(a.agent)) THEN lower(a.agent) ELSE '*' END AS matched
  FROM files f, agents a),
own AS (
  SELECT a.robots_id, a.agent, g.line_no, g.kind, g.value, g.delay FROM asked a JOIN grps g USING (robots_id)
  WHERE g.n_ua = 0 OR g.grp IN (SELECT h.grp FROM grps h WHERE h.robots_id = a.robots_id AND h.ua AND lower(h.value) = a.matched)),
rules AS (SELECT robots_id, agent, line_no, {_encoded("value", _RULE_SIGNS)} AS pattern, kind = 'allow' AS is_allowed FROM own WHERE kind IN ('allow', 'disallow') AND NOT contains(value, '<FF>')),
delays AS (
  SELECT a.robots_id, a.agent, coalesce(
    (SELECT arg_min(delay, line_no) FROM own o WHERE o.robots_id = a.robots_id AND o.agent = a.agent AND o.kind = 'crawl_delay'),
    (SELECT arg_max(delay, line_no) FROM grps g WHERE g.robots_id = a.robots_id AND g.grp = 0 AND g.kind = 'crawl_delay')) AS delay
  FROM asked a)
"""


def _like(pattern: str, target: str) -> str:
    """A rule as LIKE: stars become %, "$" ends it, and with more than stars after it nothing matches."""
    escaped = f"regexp_replace(regexp_replace({pattern}, '([\\\\%_])', '\\\\\\1', 'g'), '[*]+', '%', 'g')"
    return f"""(CASE WHEN NOT contains({pattern}, '$') THEN {target} LIKE {escaped} || '%' ESCAPE '\\'
      ELSE regexp_matches({pattern}, '^[^$]*[$][$*]*$') AND {target} LIKE regexp_replace({escaped}, '[$].*$', '') ESCAPE '\\' END)"""


_BASE = f"WITH {_LINES}, {_directives('lns')}, {_GROUPS}, {_POLICIES}"
_TARGET = f"""coalesce(nullif({_encoded("regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1)", _PATH_SIGNS)}, ''), '/')
    || {_encoded("regexp_extract(url, '^[^?#]*([?][^#]*)', 1)", _QUERY_SIGNS)} || {_encoded("regexp_extract(url, '(#.*)$', 1)", _RULE_SIGNS)}"""
_HOST = "regexp_extract(url, '^https?://([^/?#]*)', 1)"
_PAGES = f"""
targets AS (SELECT page_id, {_HOST} AS host, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS origin, 't' || length({_HOST}) % {len(FILES)} AS robots_id, {_TARGET} AS target FROM pages),
verdicts AS (
  SELECT t.page_id, t.host, a.agent,
    CASE WHEN t.target = '/robots.txt' THEN true ELSE coalesce(d.is_allowed, true) END AS allowed,
    CASE WHEN t.target <> '/robots.txt' THEN d.pattern END AS rule,
    CASE WHEN t.target = '/robots.txt' THEN 'robots_txt' WHEN d.pattern IS NULL THEN 'no_rule' ELSE 'rule' END AS reason
  FROM targets t JOIN asked a USING (robots_id)
  LEFT JOIN (
    SELECT t.page_id, r.agent, max((length(r.pattern), r.is_allowed, r.pattern)) AS m, m[2] AS is_allowed, m[3] AS pattern
    FROM targets t JOIN rules r USING (robots_id) WHERE {_like("r.pattern", "t.target")} GROUP BY ALL) d ON d.page_id = t.page_id AND d.agent = a.agent)
"""
_PATTERN_ROWS = f"pats(i, raw) AS (VALUES {_values([(i, _quoted(p)) for i, p in enumerate(PATTERNS)])}), texts(target) AS (VALUES {_values([(_quoted(t),) for t in TEXTS])})"
_URL_ROWS = f"urls(url) AS (VALUES {_values([(_quoted(u),) for u in URLS])})"
_LINKS = """links AS (SELECT page_id, url, unnest(h) AS link, unnest(range(len(h))) AS place FROM (SELECT page_id, url, regexp_extract_all(html, 'href="([^"]*)"', 1) AS h FROM pages))"""
_LINK_TARGET = f"CASE WHEN link = '' THEN '/' ELSE {_encoded('link', _RULE_SIGNS)} END"
_MODE = "CASE WHEN contains(raw, '$') THEN 'regex' WHEN contains(raw, '*') THEN 'star' ELSE 'prefix' END"


def _match_sql(mode: str) -> str:
    return f"WITH {_PATTERN_ROWS} SELECT raw, target, {_like('raw', 'target')} AS matched FROM pats, texts WHERE {_MODE} = '{mode}'"


ORACLE_SQL = {
    "robots_lines": f"WITH {_LINES} SELECT robots_id, line_no, line FROM lns",
    "robots_directives": f"{_BASE} SELECT robots_id, line_no, kind, value, CASE WHEN kind = 'crawl_delay' THEN delay END AS delay FROM dirs WHERE kind <> 'raw'",
    "typo_forgiveness": f"WITH {_lines(f'VALUES {_values([(_quoted(a), _quoted(a)) for a in SPELLINGS])}')}, {_directives('lns')} SELECT robots_id AS line, kind FROM dirs",
    "empty_disallow": f"""WITH rows(line) AS (VALUES {_values([(_quoted(a),) for a in SPELLINGS if a.startswith('Disallow')])}), cut AS (SELECT line, trim(regexp_replace(regexp_replace(line, '#.*', ''), '^Disallow *:', '')) AS v FROM rows)
        SELECT line, CASE WHEN v = '' THEN 'allow' ELSE 'disallow' END AS kind, CASE WHEN v = '' THEN '/' ELSE v END AS value FROM cut""",
    "directive_counts": f"{_BASE} SELECT kind, count(*) AS n FROM dirs GROUP BY kind",
    "document_directives": f"""WITH pieces AS (SELECT doc_id AS robots_id, regexp_split_to_array(text, '\\r+\\n?|\\n') AS a FROM documents),
        ended AS (SELECT robots_id, CASE WHEN a[len(a)] = '' THEN a[1:len(a) - 1] ELSE a END AS a FROM pieces),
        lns AS (SELECT robots_id, unnest(a) AS line, unnest(range(len(a))) AS line_no FROM ended), {_directives('lns')}
        SELECT robots_id AS doc_id, kind, count(*) AS n FROM dirs GROUP BY ALL""",
    "agent_groups": f"{_BASE} SELECT robots_id, line_no, grp, n_ua FROM grps",
    "agent_resolution": f"{_BASE} SELECT robots_id, agent, matched AS matched_agent FROM asked",
    "agent_keys": f"SELECT agent, lower(agent) AS asked, translate(agent, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS named FROM (VALUES {_values([(_quoted(n),) for n in NAMES])}) t(agent)",
    "captured_rules": f"{_BASE} SELECT robots_id, agent, line_no, pattern, is_allowed FROM rules",
    "crawl_delays": f"{_BASE} SELECT robots_id, agent, delay FROM delays",
    "sitemaps_list": f"{_BASE} SELECT robots_id, row_number() OVER (PARTITION BY robots_id ORDER BY line_no) - 1 AS place, value AS sitemap FROM dirs WHERE kind = 'sitemap'",
    "rule_encoding": f"WITH {_URL_ROWS} SELECT url AS raw, {_encoded('url', _RULE_SIGNS)} AS pattern FROM urls",
    "rule_modes": f"WITH {_PATTERN_ROWS} SELECT raw, {_MODE} AS mode, regexp_replace(raw, '[*]+', '*', 'g') AS effective, CAST(length(raw) AS BIGINT) AS n FROM pats",
    "prefix_match": _match_sql("prefix"),
    "star_match": _match_sql("star"),
    "anchored_match": _match_sql("regex"),
    "longest_match": f"""WITH {_PATTERN_ROWS} SELECT target, CASE WHEN target = '/robots.txt' THEN true ELSE coalesce(arg_max(i % 2 = 0, (length(raw), i % 2 = 0)) FILTER (WHERE {_like('raw', 'target')}), true) END AS allowed
        FROM pats, texts GROUP BY target""",
    "robots_txt_exempt": f"SELECT url, regexp_replace(url, '^https?://[^/]*', '') = '/robots.txt' AS allowed FROM (VALUES {_values([(_quoted(u),) for u in EXEMPT])}) t(url)",
    "prepare_url_absolute": f"SELECT page_id, {_TARGET} AS target FROM pages",
    "prepare_url_relative": f"WITH {_LINKS} SELECT page_id, place, {_LINK_TARGET} AS target FROM links",
    "robots_url": "SELECT page_id, regexp_extract(url, '^(https?://[^/?#]*)', 1) || '/robots.txt' AS robots_url FROM pages",
    "robots_url_cases": f"""WITH {_URL_ROWS}, schemes AS (SELECT url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme FROM urls),
        nets AS (SELECT *, regexp_replace(regexp_extract(url, CASE WHEN scheme IN ('http', 'https', 'ws', 'wss', 'ftp') THEN '^[A-Za-z]+:/*([^/?#]*)' ELSE '^[a-z]+://([^/?#]*)' END, 1), '^.*@', '') AS netloc FROM schemes),
        cut AS (SELECT *, regexp_replace(netloc, ':.*$', '') AS host, regexp_replace(regexp_extract(netloc, ':(.*)$', 1), '^0+([0-9])', '\\1') AS port FROM nets),
        judged AS (SELECT *, CASE WHEN scheme = '' THEN 'RelativeUrlWithoutBase' WHEN scheme = 'tel' THEN 'SetHostOnCannotBeABaseUrl' WHEN host = '' THEN 'EmptyHost'
            WHEN NOT regexp_full_match(port, '[0-9]{{0,5}}') OR TRY_CAST(port AS INT) > 65535 THEN 'InvalidPort' WHEN contains(host, ' ') THEN 'InvalidDomainCharacter' WHEN scheme NOT IN ('http', 'https') THEN 'EmptyHost' END AS error FROM cut)
        SELECT url, CASE WHEN error IS NULL THEN scheme || '://' || lower(host) || CASE WHEN port = '' OR (scheme, port) IN (('http', '80'), ('https', '443')) THEN '' ELSE ':' || port END || '/robots.txt' END AS robots_url, error FROM judged""",
    "page_verdicts": f"{_BASE}, {_PAGES} SELECT page_id, agent, allowed, rule, reason FROM verdicts",
    "link_verdicts": f"""{_BASE}, {_LINKS}, targets AS (SELECT page_id, place, 't' || length({_HOST}) % {len(FILES)} AS robots_id, {_LINK_TARGET} AS target FROM links),
        judged AS (SELECT t.page_id, t.place, a.agent, any_value(t.target) AS target,
            coalesce(arg_max(r.is_allowed, (length(r.pattern), r.is_allowed)) FILTER (WHERE {_like('r.pattern', 't.target')}), true) AS allowed
          FROM targets t JOIN asked a USING (robots_id) LEFT JOIN rules r ON r.robots_id = t.robots_id AND r.agent = a.agent GROUP BY t.page_id, t.place, a.agent)
        SELECT page_id, agent, count(*) AS links, count(*) FILTER (WHERE allowed OR target = '/robots.txt') AS allowed_links FROM judged GROUP BY ALL""",
    "agent_comparison": f"{_BASE}, {_PAGES} SELECT agent, count(*) AS pages, count(*) FILTER (WHERE allowed) AS allowed_pages FROM verdicts GROUP BY agent",
    "allowed_by_host": f"{_BASE}, {_PAGES} SELECT host, agent, count(*) AS pages, count(*) FILTER (WHERE allowed) AS allowed_pages FROM verdicts GROUP BY host, agent",
    "delay_by_host": f"{_BASE}, {_PAGES} SELECT DISTINCT t.origin, d.agent, d.delay FROM targets t JOIN delays d USING (robots_id)",
}


# The customers' files, their lines joined again from the orders.
_CUSTOMERS = f"""WITH {_lines(f"SELECT o_custkey, {_HEAD} || string_agg({_LINE}, '' ORDER BY o_orderkey) || {_TAIL} FROM orders GROUP BY o_custkey")}, {_directives('lns')}, {_GROUPS}, {_POLICIES},
bad AS (SELECT robots_id, agent, arg_min(pattern, line_no) AS pattern FROM rules WHERE contains(pattern, '$') AND length(regexp_replace(pattern, '[*]+', '*', 'g')) > 1024 GROUP BY robots_id, agent),
held AS (SELECT r.* FROM rules r ANTI JOIN bad USING (robots_id, agent)),
held_delays AS (SELECT d.robots_id, d.agent, CASE WHEN b.pattern IS NULL THEN d.delay END AS delay FROM delays d LEFT JOIN bad b USING (robots_id, agent)),
maps AS (SELECT robots_id, value AS sitemap, row_number() OVER (PARTITION BY robots_id ORDER BY line_no) - 1 AS place FROM dirs WHERE kind = 'sitemap' AND NOT contains(value, '<FF>'))"""
#: A float as Java writes it, for the numbers there are.
_JAVA_FLOAT = "CASE WHEN delay >= 1e7 THEN '1.0E' || CAST(round(log10(delay)) AS INT) ELSE CAST(CAST(delay AS FLOAT) AS VARCHAR) END"
_KEY = "o_orderkey % 1000000007"
_PIECES = ", ".join(f"CASE WHEN (o_orderkey >> {k}) % 2 = 0 THEN 0 ELSE {_KEY} * {7919 + k} % 65535 + 1 END" for k in range(8))

ORACLE_SQL |= {
    "file_lines": f"{_CUSTOMERS} SELECT robots_id, line_no, line FROM lns",
    "file_directives": f"{_CUSTOMERS} SELECT robots_id, line_no, kind, CASE WHEN kind = 'raw' THEN line ELSE value END AS value, CASE WHEN kind = 'crawl_delay' THEN delay END AS delay FROM dirs",
    "file_groups": f"{_CUSTOMERS} SELECT robots_id, line_no, grp, n_ua FROM grps",
    "file_agents": f"{_CUSTOMERS} SELECT robots_id, agent, matched AS matched_agent FROM asked",
    "file_rules": f"{_CUSTOMERS} SELECT robots_id, agent, line_no, pattern, {_MODE.replace('raw', 'pattern')} AS mode, is_allowed FROM held",
    "file_delays": f"{_CUSTOMERS} SELECT robots_id, agent, delay FROM held_delays",
    "file_sitemaps": f"{_CUSTOMERS} SELECT robots_id, place, sitemap FROM maps",
    "file_errors": f"""{_CUSTOMERS} SELECT a.robots_id, a.agent, 'Invalid robots.txt rule: ' || b.pattern AS error,
        (SELECT count(*) FROM held h WHERE h.robots_id = a.robots_id AND h.agent = a.agent) AS rules, CASE WHEN b.pattern IS NULL THEN (SELECT count(*) FROM maps m WHERE m.robots_id = a.robots_id) ELSE 0 END AS sitemaps
        FROM asked a LEFT JOIN bad b USING (robots_id, agent)""",
    "file_size_cap": f"""WITH {_lines(f"SELECT o_custkey, substr(regexp_replace({_HEAD} || string_agg({_LINE}, '' ORDER BY o_orderkey) || {_TAIL}, '[^\\x00-\\x7f]', '?', 'g'), 1, 90) FROM orders GROUP BY o_custkey")}, {_directives('lns')}
        SELECT robots_id, line_no, kind FROM dirs""",
    "file_debug": f"""{_CUSTOMERS} SELECT robots_id, line_no, '{{"kind":"' || kind || '","value":"' || value || '"' || CASE WHEN kind = 'crawl_delay' THEN ',"delay":' || {_JAVA_FLOAT} ELSE '' END || '}}' AS debug
        FROM dirs WHERE kind IN ('user_agent', 'crawl_delay', 'allow')""",
    "policy_debug": f"""{_CUSTOMERS}, shown AS (SELECT robots_id, agent, string_agg('{{"pattern":"' || pattern || '","is_allowed":' || CAST(is_allowed AS VARCHAR) || '}}', ',' ORDER BY line_no) AS rules FROM held GROUP BY ALL),
        listed AS (SELECT robots_id, string_agg('"' || sitemap || '"', ',' ORDER BY place) AS maps FROM maps GROUP BY ALL)
        SELECT d.robots_id, d.agent, '{{"rules":[' || coalesce(s.rules, '') || ']' || CASE WHEN delay IS NULL THEN '' ELSE ',"delay":' || {_JAVA_FLOAT} END || ',"sitemaps":[' || CASE WHEN b.pattern IS NULL THEN coalesce(l.maps, '') ELSE '' END || ']}}' AS debug
        FROM held_delays d LEFT JOIN shown s USING (robots_id, agent) LEFT JOIN listed l USING (robots_id) LEFT JOIN bad b USING (robots_id, agent)""",
    "file_source": f"""{_CUSTOMERS}, stored AS (SELECT robots_id, replace(replace(txt, '<FF>', ''), chr(0), '') || chr(10) AS v FROM files) SELECT robots_id, CAST(strlen(v) AS BIGINT) AS n_bytes, sha256(v) AS sha256 FROM stored""",
    "loose_match": f"""WITH pats AS (SELECT DISTINCT raw FROM (VALUES {_values([(_quoted(x),) for x in (*PATTERNS, "/a*", "a*e", "/*/*1", "b*") if "*" in x and "$" not in x])}) t(raw)),
        targets AS (SELECT page_id, {_TARGET} AS target FROM pages), texts AS (SELECT page_id, '' AS target FROM targets UNION ALL SELECT page_id, '*' || target FROM targets)
        SELECT page_id, target, raw, regexp_matches(target, '(?s)' || array_to_string(list_transform(string_split(raw, '*'), lambda x: regexp_escape(x)), '.*')) AS matched FROM texts, pats""",
    "host_names": f"""SELECT o_orderkey, {_chosen([a for a, _ in HOSTS], "o_orderkey", "CAST(o_orderkey % 9000 + 1000 AS VARCHAR)")} AS url, {_chosen([b for _, b in HOSTS], "o_orderkey", "CAST(o_orderkey % 9000 + 1000 AS VARCHAR)")} || '/robots.txt' AS robots_url,
        CAST(NULL AS VARCHAR) AS error FROM orders""",
    "host_errors": f"""SELECT o_orderkey, {_chosen([a for a, _ in BROKEN], "o_orderkey", "CAST(o_orderkey % 10 AS VARCHAR)")} AS url, nullif({_chosen([b or "" for _, b in BROKEN], "o_orderkey")}, '') AS error,
        CASE WHEN error IS NULL THEN 'http://' || o_orderkey % 10 || '.0.0.0/robots.txt' END AS robots_url FROM orders""",
    "ipv4_hosts": f"""WITH n AS (SELECT o_orderkey, {_KEY} * 2654435761 % 4294967296 AS n FROM orders)
        SELECT o_orderkey, 'http://' || (n // 16777216) || '.' || (n // 65536 % 256) || '.' || (n // 256 % 256) || '.' || (n % 256) || '/robots.txt' AS robots_url, CAST(NULL AS VARCHAR) AS error FROM n""",
    "ipv6_hosts": f"""WITH p AS (SELECT o_orderkey, [{_PIECES}] AS p FROM orders),
        spans AS (SELECT s, l FROM range(8) a(s), range(2, 9) b(l) WHERE s + l <= 8),
        runs AS (SELECT o_orderkey, arg_max((s, l), (l, -s)) AS r FROM p, spans WHERE list_sum(p[s + 1:s + l]) = 0 GROUP BY o_orderkey),
        texts AS (SELECT o_orderkey, r[1] AS s, r[2] AS l, list_transform(p, lambda x: lower(hex(x))) AS t FROM p LEFT JOIN runs USING (o_orderkey))
        SELECT o_orderkey, 'http://[' || CASE WHEN l IS NULL THEN array_to_string(t, ':') ELSE array_to_string(t[1:s], ':') || '::' || array_to_string(t[s + l + 1:], ':') END || ']:81/robots.txt' AS robots_url, CAST(NULL AS VARCHAR) AS error FROM texts""",
}
