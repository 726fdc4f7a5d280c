"""Robots rules as tables: which URLs an agent may fetch, for many hosts at once.

Rules are matched by equi joins. Every rule has a literal head, what stands before its first wildcard. A URL's path is cut to each length that
a head of its host has, so a URL meets exactly the rules whose head it begins with; only those with wildcards are then matched as patterns. The work grows
with the rules that apply and not with URLs times rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillage.functions import urls as U

# Characters that mean the same with and without an escape, as hexadecimal codes.
UNRESERVED = r"^(2D|2E|3[0-9]|4[1-9A-F]|5[0-9A]|5F|6[1-9A-F]|7[0-9A]|7E)$"


def octets(c: Column) -> Column:
    """A path with all but ASCII escaped, escapes in upper case, and needless ones undone, so that equal paths are equal strings."""
    each = F.transform(F.regexp_extract_all(c, F.lit(r"(?s)."), F.lit(0)), lambda x: F.when(x.rlike(r"[^\x00-\x7F]"), F.url_encode(x)).otherwise(x))
    ascii_only = F.when(c.rlike(r"[^\x00-\x7F]"), F.array_join(each, "")).otherwise(c)

    def escape(x: Column) -> Column:
        code = F.upper(F.substring(x, 1, 2))
        plain = F.when(code.rlike(UNRESERVED), F.chr(F.conv(code, 16, 10).cast("bigint"))).otherwise(F.concat(F.lit("%"), code))
        return F.when(x.rlike("^[0-9A-Fa-f]{2}"), F.concat(plain, F.substr(x, F.lit(3)))).otherwise(F.concat(F.lit("%"), x))

    parts = F.split(ascii_only, "%")
    undone = F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), escape), ""))
    return F.when(F.contains(ascii_only, F.lit("%")), undone).otherwise(ascii_only)


def host_of(url: Column) -> Column:
    return F.lower(U.netloc(url))


def target_of(url: Column) -> Column:
    """What rules are compared with: the path and, if there is one, the query."""
    query = F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)
    return octets(F.concat(F.when(U.path(url) == "", "/").otherwise(U.path(url)), query))


def parse_rules(robots: DataFrame, agent: str) -> DataFrame:
    """(host, line, allow, pattern): the rules of robots (host, body) that hold for an agent, a product name such as `crawler`.

    Lines of agents and the rules after them are a group; groups of one agent add up. If any group names the agent, whatever the case, these
    hold, else those of `*`. Empty rules, comments, unknown lines and rules before the first agent don't count. A null body has no
    rules; of several bodies of a host the greatest counts.
    """
    one = robots.filter(F.col("host").isNotNull()).groupBy(F.lower("host").alias("host")).agg(F.max("body").alias("body"))
    lines = one.select("host", F.posexplode(F.split("body", r"\r\n|\r|\n")).alias("line", "text"))
    cut = F.regexp_replace("text", "#.*$", "")
    at = r"^[\s\x{FEFF}]*([A-Za-z-]+)\s*:\s*(.*?)\s*$"
    lines = lines.select("host", "line", F.lower(F.regexp_extract(cut, at, 1)).alias("name"), F.regexp_extract(cut, at, 2).alias("value"))
    lines = lines.filter(F.col("name").isin("user-agent", "allow", "disallow"))
    by_line = Window.partitionBy("host").orderBy("line")  # a file at a time
    names = F.col("name") == "user-agent"
    starts = names & ~F.coalesce(F.lag(names).over(by_line), F.lit(False))
    lines = lines.withColumn("starts", starts.cast("int")).withColumn("group", F.sum("starts").over(by_line)).filter("group > 0")
    whole = Window.partitionBy("host", "group")
    token = F.lower(F.regexp_extract("value", r"^(\*|[A-Za-z_-]*)", 1))
    mine = F.max((names & (token == agent.lower())).cast("int")).over(whole)
    any_one = F.max((names & (token == "*")).cast("int")).over(whole)
    lines = lines.withColumns({"mine": mine, "any_one": any_one})
    lines = lines.withColumn("known", F.max("mine").over(Window.partitionBy("host")))
    rules = lines.filter(~names & (F.col("value") != "") & (((F.col("known") == 1) & (F.col("mine") == 1)) | ((F.col("known") == 0) & (F.col("any_one") == 1))))
    return rules.select("host", "line", (F.col("name") == "allow").alias("allow"), octets(F.col("value")).alias("pattern"))


def _heads(rules: DataFrame, wildcards: bool) -> DataFrame:
    """rules with head, the literal before the first wildcard, and regex, null where the head is all."""
    p = F.regexp_replace("pattern", r"\*+", "*")
    if not wildcards:
        return rules.withColumns({"head": F.col("pattern"), "regex": F.lit(None).cast("string")})
    ends = p.endswith("$")
    body = F.when(ends, F.expr("left(p, length(p) - 1)")).otherwise(F.col("p"))
    quoted = F.concat(F.lit(r"(?s)^\Q"), F.replace(F.replace(F.col("body"), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit("*"), F.lit(r"\E.*\Q")), F.lit(r"\E"), F.when(F.col("ends"), "$").otherwise(""))
    out = rules.withColumn("p", p).withColumn("ends", ends).withColumn("body", body)
    wild = F.col("ends") | F.contains("body", F.lit("*"))
    return out.withColumns({"head": F.substring_index("body", "*", 1), "regex": F.when(wild, quoted)}).drop("p", "ends", "body")


def verdicts(urls: DataFrame, rules: DataFrame, order: str = "longest", wildcards: bool = True) -> DataFrame:
    """(url, allowed, rule) of each different url of urls that is not null.

    rules are those of parse_rules. Of the rules that match, the longest pattern decides, and allow where two are as long; with
    order="first" the one that stands first in the file does. rule is the pattern that decided, null if none matched: then the URL is allowed, as is
    robots.txt itself. `*` stands for any characters and a last `$` for the end, unless wildcards are off.
    """
    if order not in ("longest", "first"):
        raise ValueError(f"no such order: {order}")
    once = urls.select(F.col("url").cast("string").alias("url")).filter("url is not null").distinct()
    once = once.select("url", host_of(F.col("url")).alias("host"), target_of(F.col("url")).alias("target"))
    headed = _heads(rules, wildcards)
    lengths = headed.groupBy("host").agg(F.collect_set(F.length("head")).alias("lengths"))
    cut = once.join(lengths, "host").withColumn("n", F.explode(F.filter("lengths", lambda n: n <= F.length("target"))))
    met = cut.withColumn("head", F.expr("left(target, n)")).join(headed, ["host", "head"])
    hit = met.filter(F.col("regex").isNull() | F.expr("target rlike regex"))
    row = F.struct("allow", "pattern")
    best = F.max_by(row, F.struct(F.length("pattern"), "allow")) if order == "longest" else F.min_by(row, "line")
    decided = hit.groupBy("url").agg(best.alias("r")).select("url", "r.*")
    own = U.path(F.col("url")) == "/robots.txt"
    out = once.select("url").join(decided, "url", "left")
    return out.select("url", (own | F.coalesce("allow", F.lit(True))).alias("allowed"), F.when(~own, F.col("pattern")).alias("rule"))


def with_verdicts(pages: DataFrame, robots: DataFrame, agent: str, order: str = "longest", wildcards: bool = True) -> DataFrame:
    """pages with allowed and rule for their url; a null or relative url is allowed, as no host's rules speak of it."""
    found = verdicts(pages, parse_rules(robots, agent), order, wildcards).withColumnRenamed("url", "_url")
    return pages.join(found, F.col("url") == F.col("_url"), "left").drop("_url").withColumn("allowed", F.coalesce("allowed", F.lit(True)))
