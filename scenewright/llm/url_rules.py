"""URL filtering by pattern rules indexed by their rarest literal token, with DataFrame functions only.

A rule is a pattern with the verdict `allow` or `block`. A literal token is a run of letters and digits that stands
between other characters in every url that fits, so a url that fits has it among its own tokens. Each rule is filed
under that one of its tokens which is rarest in the urls at hand; a url's tokens fetch the rules filed under them, and
only those run their regular expressions. The index has one row per rule that the driver was given and is broadcast.

Two kinds of rules. Host rules (`example.com/en/`) fit the host and its subdomains if the path starts with the
rule's; the longest decides. Patterns decide where no host rule fits: `*` is anything, `^` a separator or the end,
`||` at the start the beginning of the host or of one of its parent domains, `|` the start or the end. A pattern of
`allow` outweighs one of `block`; without any the url is allowed. Patterns are matched against the url in lower case.

Patterns can be read from a file in the syntax of filter lists: a line each, `@@` before one that allows, `!` before a
comment, and `$domain=a.org|~b.a.org` behind one that holds for some hosts only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scenewright.llm.common import cut, join_hot, lower_ascii

#: The host and the path of a url: after the first ://, up to / ? # or the end, and from there to ? # or the end.
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    name: str
    kind: str  # host or pattern
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    length: int
    #: Hosts, with their subdomains, that the rule holds for (all, if there are none), and those that it doesn't.
    only: tuple[str, ...] = ()
    but: tuple[str, ...] = ()


def _tokens(pattern: str) -> tuple[str, ...]:
    """Runs of letters and digits with other characters or an anchor on both sides."""
    found = []
    for m in re.finditer("[a-z0-9]+", pattern):
        before, after = pattern[: m.start()], pattern[m.end() :]
        if before and not before.endswith("*") and after and not after.startswith("*"):
            found.append(m[0])
    return tuple(dict.fromkeys(found))


def host_rule(verdict: str, name: str) -> Rule:
    """`net/es/`: the host and its subdomains, and paths that start as given. The host is in lower case."""
    host, slash, path = name.partition("/")
    regex = rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(slash + path)}"
    # a path may go on after its last token, unless a sign follows it
    tokens = _tokens(f".{host}/") + _tokens((slash + path).lower())
    return _checked(Rule(name, "host", verdict, regex, tokens, len(name)))


def pattern_rule(verdict: str, name: str, *, strict: bool = True, only: tuple[str, ...] = (), but: tuple[str, ...] = ()) -> Rule:
    """strict: a pattern without a literal token is an error; else it is filed under EVERY and runs for every url."""
    body, regex = name, ""
    if body.startswith("||"):
        body, regex = body[2:], r"^[^:]*://(?:[^/?#]*\.)?"
    elif body.startswith("|"):
        body, regex = body[1:], "^"
    end = r"\z" if body.endswith("|") else ""
    body = body.removesuffix("|")
    for c in body:
        regex += {"*": ".*", "^": r"(?:[^a-z0-9._%-]|\z)"}.get(c) or re.escape(c)
    edged = ("|" if name.startswith("|") else "") + body + ("|" if end else "")
    tokens = _tokens(edged) or (() if strict else (EVERY,))
    return _checked(Rule(name, "pattern", verdict, f"(?s){regex}{end}", tokens, len(name), only, but))


#: The token of rules without one of their own; no url's token has a sign.
EVERY = "*"
#: Options of a filter list that leave a rule as it is for whole pages.
PLAIN_OPTIONS = {"document", "doc", "all", "important", "third-party", "~third-party", "3p", "1p"}


def parsed(line: str) -> Rule | None:
    """The rule of a line of a filter list. None: comments, headers, rules that hide parts of pages, whole regular
    expressions, and rules whose options say that they are for something else than pages."""
    text = line.strip()
    if not text or text[0] in "![" or re.search("#[@?$%]*#", text) or (text.strip("@").startswith("/") and text.endswith("/") and len(text) > 2):
        return None
    verdict = "allow" if text.startswith("@@") else "block"
    body, _, options = text.removeprefix("@@").partition("$")
    only, but = [], []
    for option in filter(None, options.lower().split(",")):
        if option.startswith("domain="):
            for name in filter(None, option.removeprefix("domain=").split("|")):
                (but if name.startswith("~") else only).append(name.removeprefix("~"))
        elif option not in PLAIN_OPTIONS:
            return None
    body = re.sub(r"\*{2,}", "*", body.lower())
    return pattern_rule(verdict, body, strict=False, only=tuple(only), but=tuple(but)) if body.strip("*|") or only else None


def read_rules(spark: SparkSession, path: str) -> list[Rule]:
    """The rules of a filter list, in order; lines that repeat one count once. The driver holds them, as all tasks do."""
    lines = [r.value for r in spark.read.text(path, wholetext=True).collect()]
    found = [r for text in lines for r in map(parsed, text.splitlines()) if r is not None]
    return list(dict.fromkeys(found))


def _checked(rule: Rule) -> Rule:
    if not rule.tokens:
        raise ValueError(f"{rule.name}: a rule needs a literal token with signs or anchors around it")
    return rule


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path; both empty for null and for urls without ://."""
    url = F.coalesce(url, F.lit(""))
    return lower_ascii(F.regexp_extract(url, PARTS, 1)), F.regexp_extract(url, PARTS, 2)


def _url_tokens(url: Column) -> Column:
    return F.array_distinct(F.split(lower_ascii(url), "[^a-z0-9]+"))


def _under(host: Column, domains: Column) -> Column:
    """Whether a host is one of the domains or below one."""
    return F.exists(domains, lambda d: (host == d) | F.endswith(host, F.concat(F.lit("."), d)))


def index(urls: DataFrame, column: str, rules: list[Rule], n: str | None = None) -> DataFrame:
    """The rules as a table, each with the one of its literal tokens that is rarest among the urls' tokens.

    n: a column with the rows that a url stands for. Tokens are counted within tasks first, so that one in every url
    costs no task more than another; the literals, as few as the rules that the driver was given, go to all tasks."""
    spark = urls.sparkSession
    rows = [(i, r.name, r.kind, r.verdict, r.regex, list(r.tokens), r.length, list(r.only), list(r.but)) for i, r in enumerate(rules)]
    told = spark.createDataFrame(
        rows, "id int, rule string, kind string, verdict string, regex string, tokens array<string>, length int, only array<string>, but array<string>"
    )
    literals = told.select("id", F.explode("tokens").alias("token"))
    seen = urls.select((F.col(n) if n else F.lit(1)).alias("n"), F.explode(_url_tokens(F.col(column))).alias("token"))
    seen = seen.join(F.broadcast(literals.select("token").distinct()), "token", "left_semi")
    counts = seen.groupBy("token").agg(F.sum("n").alias("n"))
    rarest = (
        literals.join(counts, "token", "left")
        .groupBy("id")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).getField("token").alias("token"))
    )
    return cut(told.drop("tokens").join(rarest, "id"))


def judge(df: DataFrame, column: str, rules: list[Rule]) -> DataFrame:
    """df with host, path, rule (the host rule that decides, or null), pattern (the pattern that decides where no host
    rule does, or null), verdict and candidates (the rules that the url's tokens fetched, whose expressions ran).

    A null url has no tokens: it is allowed. Repeated urls are judged once, however many rows have them; each row keeps
    its own line. An empty table gives an empty one. Columns of df named like the new ones are replaced."""
    df = df.drop(*[c for c in ("host", "path", "rule", "pattern", "verdict", "candidates") if c != column])
    given = df.select(F.col(column).alias("_url")).where(F.col("_url").isNotNull())
    urls = cut(given.groupBy("_url").agg(F.count("*").alias("_rows")))
    total = urls.agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0]
    # the index has a row for each rule that the driver was given
    filed = F.broadcast(index(urls, "_url", rules, "_rows"))
    host, path = host_and_path(F.col("_url"))
    tokens = _url_tokens(F.col("_url"))
    tokens = F.array_append(tokens, EVERY) if any(EVERY in r.tokens for r in rules) else tokens
    fetched = urls.select("_url", "_rows", F.explode(tokens).alias("token")).join(filed, "token")
    subject = F.when(F.col("kind") == "host", F.concat(host, path)).otherwise(lower_ascii(F.col("_url")))
    fits = F.rlike(subject, F.col("regex"))
    if any(r.only or r.but for r in rules):
        fits = fits & ((F.size("only") == 0) | _under(host, F.col("only"))) & ~_under(host, F.col("but"))
    tried = fetched.withColumn("fits", fits)
    hosts = F.when(F.col("fits") & (F.col("kind") == "host"), F.struct("length", "rule", "verdict"))
    # allow comes before block, then the first rule as listed
    patterns = F.when(F.col("fits") & (F.col("kind") == "pattern"), F.struct((F.col("verdict") != "allow").alias("later"), "id", "rule", "verdict"))
    judged = tried.groupBy("_url", "_rows").agg(F.max(hosts).alias("_host_rule"), F.min(patterns).alias("_pattern"), F.count("*").alias("candidates"))
    found = df.withColumn("_url", F.col(column))
    # urls without candidates fetch nothing; null joins nothing
    whole = cut(urls.join(judged.drop("_rows"), "_url", "left"))
    out = join_hot(found, whole, "_url", "_rows", total).unionByName(found.where("_url is null"), allowMissingColumns=True)
    own_host, own_path = host_and_path(F.col(column))
    return (
        out.withColumn("host", own_host)
        .withColumn("path", own_path)
        .withColumn("rule", F.col("_host_rule.rule"))
        .withColumn("pattern", F.when(F.col("_host_rule").isNull(), F.col("_pattern.rule")))
        .withColumn("verdict", F.coalesce("_host_rule.verdict", "_pattern.verdict", F.lit("allow")))
        .withColumn("candidates", F.coalesce("candidates", F.lit(0)))
        .select(*df.columns, "host", "path", "rule", "pattern", "verdict", "candidates")
    )


#: Fixed values of the query's contract.
HOST_RULES = [
    host_rule("allow", "com/"),
    host_rule("block", "example.com/en/"),
    host_rule("allow", "www.example.com/en/"),
    host_rule("block", "net/es/"),
    host_rule("block", "net/fr/"),
]

#: General words of spam, as they come first and second in names of hosts and pages.
SPAM_HEADS = (
    "adult", "best", "betting", "bingo", "buy", "casino", "cheap", "cialis", "crypto", "detox", "diet", "discount", "easy", "fast", "forex",
    "free", "hot", "instant", "live", "lottery", "luxury", "online", "payday", "pharmacy", "poker", "replica", "sexy", "slots", "spam", "viagra",
)
SPAM_TAILS = (
    "bets", "bonus", "cams", "cash", "casino", "cracks", "credit", "dating", "downloads", "drugs", "escorts", "farm", "handbags", "jackpot", "keygen",
    "loans", "meds", "money", "pills", "poker", "porn", "profit", "serials", "sex", "singles", "slots", "sneakers", "tips", "torrents", "warez", "watches",
)

#: Spam names of hosts and pages (each head with each tail, either order in pages), pages that only serve a session or a
#: shop, files that hold no text, and endless listings.
PATTERN_RULES = [
    *[pattern_rule("block", f"||{head}-{tail}.") for head in SPAM_HEADS for tail in SPAM_TAILS],
    *[pattern_rule("block", f"/{head}-{tail}^") for head in SPAM_HEADS for tail in SPAM_TAILS],
    *[pattern_rule("block", f"/{tail}-{head}^") for head in SPAM_HEADS for tail in SPAM_TAILS],
    *[pattern_rule("block", f"||{word}-*/") for word in ("cheap", "spam", "casino", "viagra", "porn", "xxx", "replica", "payday")],
    *[pattern_rule("block", f"-{word}.*/") for word in ("pills", "farm", "casino", "loans", "porn", "escorts", "replica", "poker")],
    *[pattern_rule("block", f"||{word}^") for word in ("doubleclick.net", "googlesyndication.com", "adservice.google.com", "trackers.example.org")],
    *[pattern_rule("block", f"/{word}^") for word in ("login", "signin", "signup", "register", "cart", "checkout", "wp-admin", "wp-login.php", "cgi-bin", "xmlrpc.php")],
    *[pattern_rule("block", f"/{word}/") for word in ("tag", "tags", "search", "feed", "calendar", "attachment", "print")],
    *[pattern_rule("block", f"^{word}=") for word in ("sessionid", "phpsessid", "jsessionid", "sid", "replytocom", "add-to-cart")],
    *[pattern_rule("block", f".{word}|") for word in ("exe", "zip", "gz", "iso", "dmg", "apk", "jpg", "png", "gif", "mp4", "mp3", "avi", "css", "js")],
    *[pattern_rule("allow", f"/{word}|") for word in ("robots.txt", "sitemap.xml", "license.txt", "readme.txt")],
]



def brute_force_sql(rules: list[Rule], table: str = "pages", key: str = "page_id") -> str:
    """SQL that runs every rule over every url."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    low = "translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    host = f"translate(regexp_extract(coalesce(url, ''), {quoted(PARTS)}, 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    hosts = sorted((i for i, r in enumerate(rules) if r.kind == "host"), key=lambda i: -rules[i].length)
    patterns = sorted((i for i, r in enumerate(rules) if r.kind == "pattern"), key=lambda i: (rules[i].verdict != "allow", i))
    first = lambda order, subject: (  # noqa: E731  the place of the first rule that fits, from 1 on
        "CASE " + " ".join(f"WHEN regexp_matches({subject}, {quoted(rules[i].regex)}) THEN {n}" for n, i in enumerate(order, 1)) + " END"
    )
    of = lambda order, field: "[" + ", ".join(quoted(getattr(rules[i], field)) for i in order) + "]"
    return (
        f"WITH u AS (SELECT {key}, {host} AS host, regexp_extract(coalesce(url, ''), {quoted(PARTS)}, 2) AS path, {low} AS low FROM {table}), "
        f"v AS (SELECT {key}, host, path, {first(hosts, 'host || path')} AS h, {first(patterns, 'low')} AS p FROM u), "
        f"w AS (SELECT *, {of(hosts, 'name')} AS hn, {of(hosts, 'verdict')} AS hv, {of(patterns, 'name')} AS pn, {of(patterns, 'verdict')} AS pv FROM v) "
        f"SELECT {key}, host, path, hn[h] AS rule, CASE WHEN h IS NULL THEN pn[p] END AS pattern, coalesce(hv[h], pv[p], 'allow') AS verdict FROM w"
    )
