"""URL filter: pattern rules indexed by their rarest literal token.

A rule is a regular expression over ``host + path + query`` with the literal
tokens that any match must contain. Rules are rows of a table of any size. One
native pass counts those tokens over all urls; each rule is filed under its
rarest one, and a rule without a token under one that every url has. A url's own
tokens then fetch candidate rules from that index, and only those run their
expressions. While the index is small it is a map in the plan, and the filter is
a row-local SQL expression; beyond INDEX_BYTES it is a table that urls' tokens
are joined with. No Python on either way.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules of this many characters in all, or fewer, are a map in the plan.
INDEX_BYTES = 1_000_000
#: The token of every url: rules without a token of their own are filed under it.
ANY = ""


@dataclass(frozen=True)
class Rule:
    """name: shown for fixed rules; layer 0: fixed rules, whose longest match decides; 1: the method's exceptions; 2: what it blocks."""

    name: str
    pattern: str
    tokens: tuple[str, ...]
    verdict: str
    layer: int = 2


RULES_SCHEMA = "name string, pattern string, tokens array<string>, verdict string, layer int"


def prefix_rule(host: str, path: str, verdict: str) -> Rule:
    """Fits the host and its subdomains where the path begins with `path`."""
    pattern = "^([^/]*\\.)?" + re.escape(host) + re.escape(path)
    return Rule(host + path, pattern, tuple(re.findall("[a-z0-9]+", host)), verdict, 0)


FIXED_RULES = (
    prefix_rule("net", "/", "block"),
    prefix_rule("example.net", "/en/", "allow"),
    prefix_rule("example.com", "/de/", "block"),
    prefix_rule("org", "/fr/", "allow"),
)


def words_of(text: str) -> tuple[str, ...]:
    return tuple(re.findall("[a-z0-9]+", text))


def parsed(lines: Iterable[str]) -> tuple[Rule, ...]:
    """Rules of a list, one to a line: `host: a-b` is a host label (or a part of one at hyphens), `path: a` a segment of the path,
    `query: a` a parameter's name, `re: x` any expression; before them, `except` makes it an exception. Empty lines and those that begin with # are none."""
    out = []
    for line in lines:
        kind, _, body = line.strip().partition(": ")
        if not kind or kind.startswith("#"):
            continue
        verdict, layer = ("allow", 1) if kind.startswith("except ") else ("block", 2)
        kind = kind.removeprefix("except ")
        text = re.escape(body).replace("\\-", "-")
        pattern = {
            "host": f"^([^/?]*[.-])?{text}([.-][^/?]*)?([/?]|$)", "path": f"^[^/?]*/([^?]*/)?{text}([/.?]|$)", "query": f"[?]([^?]*&)?{text}=", "re": body,
        }[kind]
        out.append(Rule(f"{kind}:{body}", pattern, () if kind == "re" else words_of(body), verdict, layer))
    return tuple(out)


# Fixed list: gambling, adult, spam, pharmacy, piracy, advertising and tracking; exceptions are about those subjects, not of them.
METHOD_RULES = parsed(
    """
    host: casino
    host: casinos
    host: poker
    host: free-bets
    host: betting
    host: slots
    host: roulette
    host: jackpot
    host: adult
    host: porn
    host: xxx
    host: nsfw
    host: escorts
    host: spam
    host: viagra
    host: cialis
    host: cheap-pills
    host: replica-watches
    host: payday-loans
    host: warez
    host: torrents
    host: keygen
    host: phishing
    host: malware
    host: ads
    host: adserver
    host: adservice
    host: banners
    host: tracker
    host: tracking
    host: pixel
    path: adserver
    path: affiliate
    path: affiliates
    path: clickthrough
    path: doorway
    path: popunder
    path: trackback
    query: affid
    query: clickid
    query: adclick
    re: ^([^/?]*[.])?[a-z0-9]*(pills|casino)[0-9]+[.]
    re: ^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+(:[0-9]+)?/
    except host: adult-education
    except host: adult-literacy
    except host: spam-filter
    except host: spam-protection
    except host: gambling-help
    except host: malware-analysis
    except path: responsible-gambling
    """.splitlines()
)


def host_of(url: Column) -> Column:
    """After the first :// up to /, ? or #, with A-Z in lower case; empty for null or without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ? or #; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def query_of(url: Column) -> Column:
    """From the first ? after the host up to #, A-Z in lower case; empty for null, without :// or without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*([?][^#]*)", 1), F.lit("")), UPPER, LOWER)


def tokens_of(text: Column) -> Column:
    """The distinct words of a text, and ANY."""
    return F.array_distinct(F.concat(F.split(F.lower(text), "[^a-z0-9]+"), F.array(F.lit(ANY))))


def rules_frame(pages: DataFrame, rules: DataFrame | Iterable[Rule]) -> DataFrame:
    """Rules as a table; those without a pattern or verdict are none, null tokens are no token."""
    if not isinstance(rules, DataFrame):
        tokens = lambda r: F.array(*map(F.lit, r.tokens)).cast("array<string>")
        rows = [F.struct(F.lit(r.name).alias("name"), F.lit(r.pattern).alias("pattern"), tokens(r).alias("tokens"), F.lit(r.verdict).alias("verdict"), F.lit(r.layer).alias("layer")) for r in rules]
        rules = pages.sparkSession.range(1).select(F.inline(F.array(*rows).cast("array<struct<name:string,pattern:string,tokens:array<string>,verdict:string,layer:int>>")))
    tokens = F.filter(F.coalesce("tokens", F.array().cast("array<string>")), lambda t: t.isNotNull() & (t != ANY))
    return rules.filter("pattern is not null and verdict is not null").select(F.coalesce("name", "pattern").alias("name"), "pattern", tokens.alias("tokens"), "verdict", F.coalesce("layer", F.lit(2)).alias("layer"))


def filed(urls: DataFrame, key: Column, rules: DataFrame) -> DataFrame:
    """The rules with the column token: the one of theirs that the fewest urls have, then the least; ANY for rules without. Tokens are counted over all urls."""
    wanted = rules.select(F.explode("tokens").alias("token")).distinct()
    met = urls.select(F.explode(tokens_of(key)).alias("token")).groupBy("token").count()
    counts = wanted.join(met, "token", "left").select("token", F.coalesce("count", F.lit(0)).alias("count"))
    each = rules.select("*", F.explode_outer("tokens").alias("token")).join(counts, "token", "left")
    return each.groupBy("name", "pattern", "verdict", "layer").agg(F.coalesce(F.min_by("token", F.struct("count", "token")), F.lit(ANY)).alias("token"))


def filed_few(urls: DataFrame, key: Column, rules: list[Rule]) -> list[tuple]:
    """As `filed`, for rules that fit into the plan: one pass counts their tokens over all urls, and no more than those come back."""
    wanted = sorted({t for r in rules for t in r.tokens})
    counts = dict.fromkeys(wanted, 0)
    if wanted:
        met = urls.select(F.explode(F.array_intersect(tokens_of(key), F.array(*map(F.lit, wanted)))).alias("token")).groupBy("token").count()
        counts |= {r["token"]: r["count"] for r in met.collect()}
    return [(min(r.tokens, key=lambda t: (counts[t], t), default=ANY), r.name, r.pattern, r.verdict, r.layer) for r in rules]


def _mapped(pages: DataFrame, key: Column, index: list[tuple], found: str) -> DataFrame:
    """Adds the first matching rule of an index that is a map in the plan."""
    by: dict[str, list[Column]] = {}
    for token, name, pattern, verdict, layer in sorted(index):
        by.setdefault(token, []).append(
            F.struct(F.lit(layer).alias("layer"), F.lit(-len(name)).alias("rank"), F.lit(name).alias("name"), F.lit(verdict).alias("verdict"), F.lit(pattern).alias("pattern"))
        )
    if not by:
        return pages.withColumn(found, F.lit(None).cast("struct<layer:int,rank:int,name:string,verdict:string>"))
    table = F.create_map(*[c for t, rs in by.items() for c in (F.lit(t), F.array(*rs))])
    fetched = F.flatten(F.filter(F.transform(tokens_of(key), lambda t: F.try_element_at(table, t)), lambda x: x.isNotNull()))
    hits = F.filter(F.col(f"{found}_fetched"), lambda r: F.rlike(F.col(f"{found}_key"), r["pattern"]))
    staged = pages.withColumns({f"{found}_key": key, f"{found}_fetched": fetched})
    return staged.withColumn(found, F.get(F.sort_array(hits), F.lit(0))).drop(f"{found}_key", f"{found}_fetched")


def _joined(pages: DataFrame, key: Column, index: DataFrame, found: str) -> DataFrame:
    """The same with an index of any size: distinct urls' tokens are joined with it, and only matches are grouped again."""
    urls = pages.select(key.alias(f"{found}_key")).distinct()
    fetched = urls.select(f"{found}_key", F.explode(tokens_of(F.col(f"{found}_key"))).alias("token")).join(index, "token").filter(F.rlike(F.col(f"{found}_key"), F.col("pattern")))
    rule = F.struct("layer", (-F.char_length("name")).alias("rank"), "name", "verdict")
    hits = fetched.groupBy(f"{found}_key").agg(F.min(rule).alias(found))
    return pages.withColumn(f"{found}_key", key).join(hits, f"{found}_key", "left").drop(f"{found}_key")


def filter_urls(pages: DataFrame, url: str = "url", rules: DataFrame | Iterable[Rule] = FIXED_RULES + METHOD_RULES) -> DataFrame:
    """Adds host, path, rule and verdict to every row.

    Among fixed rules (layer 0) that match, the longest name wins, then the
    lesser name; without one, rule is null and the verdict is allow if an
    exception (layer 1) matches, else block if any other of the method's rules
    does, else allow. Rules are a table (see RULES_SCHEMA) or Rule objects, any
    number; null or no tokens: the rule is tried on every url. Null, empty and
    malformed urls have an empty host and path and are allowed unless a rule
    matches the empty text. Repeated rows are judged each on
    its own; columns of the input named host, path, rule or verdict are replaced.
    """
    host, path = host_of(F.col(url)), path_of(F.col(url))
    key = F.concat(host, path, query_of(F.col(url)))
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    found = "_first"
    while found in own:
        found += "_"
    base = pages.select(*own, host.alias("host"), path.alias("path"))
    if isinstance(rules, DataFrame):
        held = rules_frame(pages, rules).agg(F.sum(F.char_length("name") + F.char_length("pattern"))).first()[0] or 0
    else:
        rules = list(rules)
        held = sum(len(r.name) + len(r.pattern) for r in rules)
    if held <= INDEX_BYTES:
        if isinstance(rules, DataFrame):
            rules = [Rule(r["name"], r["pattern"], tuple(r["tokens"]), r["verdict"], r["layer"]) for r in rules_frame(pages, rules).collect()]  # at most INDEX_BYTES
        judged = _mapped(base, key, filed_few(pages, key, rules), found)
    else:
        judged = _joined(base, key, filed(pages, key, rules_frame(pages, rules)), found)
    first = F.col(found)
    return judged.select(*own, "host", "path", F.when(first["layer"] == 0, first["name"]).alias("rule"), F.coalesce(first["verdict"], F.lit("allow")).alias("verdict"))
