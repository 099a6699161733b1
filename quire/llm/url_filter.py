"""URL filters: pattern rules found through their rarest literal token, so that few regular expressions run."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKEN = "[a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """A verdict for the urls that a pattern fits. `literals` are tokens that any fitting url holds, lower-cased.

    `name` and `rank` are what the winning rule reports and wins by.
    """

    verdict: str
    pattern: str
    literals: tuple[str, ...]
    name: str
    rank: int


def host_rule(verdict: str, host: str, path: str = "/") -> Rule:
    """A rule for a host with its subdomains and the paths that start with one; the longest such rule wins."""
    literals = tuple(re.findall(TOKEN, host))
    return Rule(verdict, f"^([^#]*[.])?{re.escape(host)}#{re.escape(path)}", literals, host + path, len(host + path))


def pattern_rule(verdict: str, pattern: str, literals: Sequence[str]) -> Rule:
    """A rule for urls in which a regular expression is found; it yields to every host rule."""
    return Rule(verdict, pattern, tuple(literals), pattern, -1)


def word_rule(verdict: str, *tokens: str) -> Rule:
    """A rule for urls that hold the tokens next to each other, in any order, as whole words."""
    orders = "|".join("[^a-z0-9]".join(x) for x in permutations(tokens))
    return pattern_rule(verdict, f"(?i)(^|[^a-z0-9])({orders})([^a-z0-9]|$)", tokens)


#: Words of hosts and paths that say what a page is, and what is offered how.
ALONE = ("spam", "casino", "porn", "xxx", "viagra", "phishing", "malware", "warez")
OFFERED = ("pills", "meds", "bets", "betting", "poker", "slots", "bonus", "loans", "credit", "cams", "dating", "torrents", "keygen", "cracks")
MANNER = ("cheap", "free", "buy", "best", "online", "win", "instant", "live")
UNWANTED = tuple(word_rule("block", w) for w in ALONE) + tuple(word_rule("block", m, o) for m in MANNER for o in OFFERED)


def after_scheme(url: Column) -> Column:
    """What follows the first ://, empty where there is none."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """Between the first :// and the next /, ? or #, A-Z lower-cased; empty where there is none."""
    host = F.regexp_extract(after_scheme(url), "^[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ? or #; empty where there is none."""
    return F.regexp_extract(after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def rarest_tokens(urls: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(token, filed): every rule under the one of its literals that the fewest rows of urls (tokens) hold."""
    spark = urls.sparkSession
    # As many rows as rules have literals: these tables are bounded by the rules given, not by the data.
    schema = "rule int, verdict string, pattern string, name string, rank int, token string"
    filed = spark.createDataFrame(
        [(i, r.verdict, r.pattern, r.name, r.rank, t) for i, r in enumerate(rules) for t in sorted(set(r.literals))], schema
    )
    literals = [t for r in rules for t in r.literals]
    known = F.array(*[F.lit(t) for t in sorted(set(literals))]) if literals else F.array().cast("array<string>")
    seen = urls.select(F.explode(F.array_intersect("tokens", known)).alias("token")).groupBy("token").agg(
        F.count("*").alias("urls")
    )
    rarest = Window.partitionBy("rule").orderBy(F.coalesce("urls", F.lit(0)), "token")
    index = filed.join(seen, "token", "left").withColumn("place", F.row_number().over(rarest)).where("place = 1")
    return index.groupBy("token").agg(
        F.collect_list(F.struct("rule", "verdict", "pattern", "name", "rank")).alias("filed")
    )


def judge(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url",
          default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict): the fitting rule of highest rank for every url.

    Every rule is filed under the one of its literal tokens that the fewest urls hold, counted over the whole table; a
    url's tokens fetch the rules filed under them, and only those run their expressions. Host rules are tried against
    host and path with a # between, pattern rules against the whole url; a pattern rule gives its verdict but no name.
    Ties of rank go to the first by name. A null url, or one without ://, has an empty host and path and may fit
    pattern rules only; no fitting rule gives the default verdict. Repeated ids are judged row by row.
    """
    urls = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    urls = urls.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    held = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("url", F.lit(""))), F.lit(f"({TOKEN})"), 1))
    urls = urls.withColumn("tokens", held)

    index = rarest_tokens(urls, rules)
    table = index.agg(F.map_from_entries(F.collect_list(F.struct("token", "filed"))).alias("index"))

    found = urls.withColumn("index", table.scalar())  # of bounded size: the rules given
    fetched = F.expr("flatten(transform(array_intersect(tokens, map_keys(index)), t -> index[t]))")
    fits = F.expr(
        "filter(fetched, r -> CASE WHEN r.rank < 0 THEN rlike(coalesce(url, ''), r.pattern)"
        " ELSE rlike(concat(host, '#', path), r.pattern) END)"
    )
    best = F.expr("array_sort(fits, (a, b) -> CASE WHEN a.rank <> b.rank THEN b.rank - a.rank"
                  " WHEN a.name < b.name THEN -1 WHEN a.name > b.name THEN 1 ELSE a.rule - b.rule END)[0]")
    found = found.withColumn("fetched", fetched).withColumn("fits", fits).withColumn(
        "best", F.when(F.size("fits") > 0, best)
    )
    return found.select(
        "id", "host", "path", F.when(F.col("best.rank") >= 0, F.col("best.name")).alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
