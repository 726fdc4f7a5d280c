"""Robots rules: parsing, and matching against every rule by hand."""

import random
import re
from urllib.parse import quote

from tillage.operators import robots


def rules_of(spark, body, agent="bot"):
    table = spark.createDataFrame([("H.example", body)], "host string, body string")
    return [(r.allow, r.pattern) for r in robots.parse_rules(table, agent).orderBy("line").collect()]


def test_groups(spark):
    body = "Disallow: /early\nUSER-AGENT: other # x\nDisallow: /o\n\nUser-agent: *\r\nuser-agent:Bot/2.1\rDisallow: /a # no\nAllow : /a/b\nNoise\nCrawl-delay: 1\nDisallow:\nUser-agent: *\nDisallow: /rest\nuser-agent: BOT\nAllow: /é%7e%2f\n"
    assert rules_of(spark, body) == [(False, "/a"), (True, "/a/b"), (True, "/%C3%A9~%2F")]
    assert rules_of(spark, body, "unknown") == [(False, "/a"), (True, "/a/b"), (False, "/rest")]
    assert rules_of(spark, None) == rules_of(spark, "") == rules_of(spark, "Disallow: /") == []


def matches(pattern, target):
    end = pattern.endswith("$")
    return re.match(".*".join(map(re.escape, (pattern[:-1] if end else pattern).split("*"))) + (r"\Z" if end else ""), target, re.S) is not None


def test_verdicts_equal_every_rule_tried(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("ab/.?") for _ in range(rng.randrange(1, 7)))
    bodies, rules = [], {}
    for h in range(6):
        rules[f"h{h}.example"] = [(rng.random() < 0.4, "/" + "".join(word() + rng.choice(["", "*", "**"]) for _ in range(rng.randrange(1, 4))) + rng.choice(["", "", "$"])) for _ in range(12)]
        bodies.append((f"h{h}.example", "User-agent: *\n" + "\n".join(f"{'Allow' if a else 'Disallow'}: {p}" for a, p in rules[f"h{h}.example"])))
    urls = [(f"http://h{rng.randrange(7)}.example/{word()}{word()}#f",) for _ in range(600)] + [("http://H1.example",), ("http://h1.example/robots.txt",), (None,), ("/relative",)]
    pages = spark.createDataFrame(urls + urls[:3], "url string")
    got = robots.with_verdicts(pages, spark.createDataFrame(bodies, "host string, body string"), "bot").collect()
    assert len(got) == len(urls) + 3
    first = robots.verdicts(pages, robots.parse_rules(spark.createDataFrame(bodies, "host string, body string"), "bot"), order="first", wildcards=False)
    in_order = {r.url: (r.allowed, r.rule) for r in first.collect()}
    for r in got:
        m = re.match(r"http://([^/#]*)([^#]*)", r.url or "")
        known = rules.get(m[1].lower(), []) if m else []
        target = (m[2] or "/") if m else ""
        hit = sorted(((len(p), a, p) for a, p in known if matches(p, target)), reverse=True)
        if target == "/robots.txt" or not hit:
            assert r.allowed and r.rule is None
        else:
            assert (r.allowed, len(r.rule)) == (hit[0][1], hit[0][0]) and matches(r.rule, target)
        if m and target != "/robots.txt":
            assert in_order[r.url] == next(((a, p) for a, p in known if target.startswith(p)), (True, None))


def test_escapes_and_special_characters(spark):
    body = "User-agent: *\nDisallow: /café\nDisallow: /a\\Eb.*(c)$\nDisallow: /x%2fy\nAllow: /\U0001f600\nDisallow: /%F0"
    urls = {"/caf%c3%a9/1": False, "/café": False, "/cafe": True, "/a\\Eb.z(c)": False, "/a\\Eb.z(c)d": True, "/x%2Fy": False, "/x/y": True, f"/{quote(chr(0x1F600))}": True, "/%f0%9f%98%81": False, "/100%": True}
    pages = spark.createDataFrame([(f"http://e.org{u}",) for u in urls], "url string")
    got = robots.with_verdicts(pages, spark.createDataFrame([("e.org", body)], "host string, body string"), "any").collect()
    assert {r.url[12:]: r.allowed for r in got} == urls
