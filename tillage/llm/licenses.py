"""License scans with a positional rare-token index, in DataFrame functions only.

The index holds, of each licence template, the highest-IDF words of its mandatory key
phrase (IDF over all files scanned) with their places. A file looks up those that it
has; a word at place p of the file and q of a template votes for the template
starting at p - q. Where enough different words vote for one start, the key phrase is
compared word by word at its place, and the template's label is given. As the words
looked up are the key phrase's own, no match is lost to a limit. Phrases
that are labels by themselves (`PHRASES`) are found wherever their words stand together.

A first pass keeps, for each file, its number of words and its licence words; only
files that hold all words of some phrase or key phrase keep their word list.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillage.llm.common import written

# Phrases that are labels by themselves.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Licence notices and the phrase in each that a match must hold.
TEMPLATES = {
    "apache-2.0": ("Licensed under the Apache License, Version 2.0", "apache license version 2 0"),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted",
        "redistribution and use in source and binary forms",
    ),
    "cc-by-nc-4.0": ("Licensed under CC BY-NC 4.0", "cc by nc 4 0"),
    "gpl-3.0": ("is licensed under the GNU General Public License, version 3", "gnu general public license version 3"),
    "mit-notice": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
        "permission is hereby granted free of charge",
    ),
    "mit-release": ("Released under the MIT License", "released under the mit license"),
    "mpl-2.0": ("subject to the terms of the Mozilla Public License, v. 2.0", "mozilla public license v 2 0"),
}

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rare words looked up for each template, and different words that must vote for one start.
RARE_WORDS = 3
VOTES = 2


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def _strings(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def scan_words(docs: DataFrame, text: str = "text", phrases: dict[str, str] = PHRASES, templates: dict[str, tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, seen, words): the count of all words, the licence words among them, and
    the word list of files that hold all words of a phrase or key phrase (else null).

    Lower-casing touches letters outside ASCII too; no licence word has a letter
    that this could make, so the result is the same as with A-Z alone.
    """
    keys = [words_of(p) for p in phrases] + [words_of(k) for _, k in templates.values()]
    vocabulary = sorted({w for t, _ in templates.values() for w in words_of(t)} | {w for k in keys for w in k})
    if any("k" in w for w in vocabulary):
        raise ValueError("licence words must not hold the letter k, which other letters lower to")
    listed = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.regexp_extract_all(F.lower(F.col(text)), F.lit(WORD), F.lit(0)), F.array().cast("array<string>")).alias("words"),
    )
    seen = listed.select("doc_id", "words", F.array_intersect("words", _strings(vocabulary)).alias("seen"))
    could = F.lit(False)
    for k in keys:
        could = could | (F.size(F.array_except(_strings(sorted(set(k))), F.col("seen"))) == 0)
    return seen.select("doc_id", F.size("words").cast("bigint").alias("n_words"), "seen", F.when(could, F.col("words")).alias("words"))


def inverse_frequencies(scanned: DataFrame) -> dict[str, float]:
    """The IDF of each licence word over all files. There are as many rows as licence words."""
    n = scanned.count()
    rows = scanned.select(F.explode("seen").alias("w")).groupBy("w").count().collect()
    return {r["w"]: math.log((1 + n) / (1 + r["count"])) for r in rows}


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once for a row also where use refers to it for each element of an array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _places(words: Column, phrase: list[str]) -> Column:
    """Places, from 0, where a phrase's words stand together."""
    return F.filter(
        F.when(F.size(words) >= len(phrase), F.sequence(F.lit(0), F.size(words) - len(phrase))).otherwise(F.array().cast("array<int>")),
        lambda i: (F.get(words, i) == phrase[0]) & (F.slice(words, i + 1, len(phrase)) == _strings(phrase)),
    )


def licence_matches(scanned: DataFrame, idf: dict[str, float], templates: dict[str, tuple[str, str]] = TEMPLATES, rare_words: int = RARE_WORDS, votes: int = VOTES) -> Column:
    """The column of verified matches: array of (label, start, share of the template's words in place)."""
    postings: dict[str, list[tuple[str, int]]] = {}
    for label, (body, key) in sorted(templates.items()):
        rarest = sorted(set(words_of(key)) & set(idf), key=lambda w: (-idf[w], w))[:rare_words]
        for place, w in enumerate(words_of(body)):
            if w in rarest:
                postings.setdefault(w, []).append((label, place))
    known = sorted(postings, key=lambda w: (-idf[w], w))
    words = F.col("words")
    if not known:
        return F.array().cast("array<struct<t:string,at:int,share:double>>")
    index = F.create_map(*[c for w in known for c in (F.lit(w), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(q).alias("q")) for t, q in postings[w]]))])
    rare = F.filter(_strings(known), lambda w: F.array_contains("seen", w))
    here = _let(rare, lambda rare: F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("p"))), lambda x: F.array_contains(rare, x["w"])))
    voted = F.flatten(F.transform(here, lambda x: F.transform(index[x["w"]], lambda y: F.struct(y["t"].alias("t"), (x["p"] - y["q"]).alias("at"), x["w"].alias("w")))))

    def enough(ordered: Column) -> Column:
        """Starts with as many votes: sorted, a vote and the one `votes` - 1 before it are for the same start."""
        before = lambda x: F.get(ordered, x["i"] - (votes - 1))
        numbered = F.transform(ordered, lambda x, i: F.struct(x["t"].alias("t"), x["at"].alias("at"), i.alias("i")))
        met = F.filter(numbered, lambda x: (x["i"] >= votes - 1) & (before(x)["t"] == x["t"]) & (before(x)["at"] == x["at"]))
        return F.array_distinct(F.transform(met, lambda x: F.struct(x["t"].alias("t"), x["at"].alias("at"))))

    starts = _let(F.array_sort(F.array_distinct(voted)), enough)
    bodies = F.create_map(*[c for t, (body, _) in sorted(templates.items()) for c in (F.lit(t), _strings(words_of(body)))])
    keys = F.create_map(*[c for t, (_, k) in sorted(templates.items()) for c in (F.lit(t), _strings(words_of(k)))])

    def key_place(body: str, key: str) -> int:
        b, k = words_of(body), words_of(key)
        return next(i for i in range(len(b)) if b[i : i + len(k)] == k)

    places = F.create_map(*[c for t, (body, k) in sorted(templates.items()) for c in (F.lit(t), F.lit(key_place(body, k)))])
    verified = F.filter(
        starts,
        lambda x: (x["at"] + places[x["t"]] >= 0) & (F.slice(words, F.greatest(x["at"] + places[x["t"]], F.lit(0)) + 1, F.size(keys[x["t"]])) == keys[x["t"]]),
    )

    def share(x: Column) -> Column:
        hits = F.filter(F.transform(bodies[x["t"]], lambda w, i: (x["at"] + i >= 0) & (F.get(words, F.greatest(x["at"] + i, F.lit(0))) == w)), lambda hit: hit)
        return F.size(hits) / F.size(bodies[x["t"]])

    return F.transform(verified, lambda x: F.struct(x["t"].alias("t"), x["at"].alias("at"), share(x).alias("share")))


def scan_licences(docs: DataFrame, text: str = "text", phrases: dict[str, str] = PHRASES, templates: dict[str, tuple[str, str]] = TEMPLATES, rare_words: int = RARE_WORDS, votes: int = VOTES) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    n_base counts all places of the phrases, first_word and last_word are the
    smallest and largest of them (null if none). labels adds the templates' labels to
    base_labels; both are distinct, sorted and joined by commas, empty if there is
    none. score is the largest share of a template's words in place, 0.5 at least where
    a phrase was found and else 0. spans lists the templates' matches as label:place, joined by commas. A null or
    empty text has no words; repeated rows get equal results; other columns are ignored; an empty table gives no rows.
    """
    scanned = written(scan_words(docs, text, phrases, templates), "licence-words")
    idf = inverse_frequencies(scanned)

    def labelled(phrase: str, label: str) -> Column:
        return F.transform(_places(F.col("words"), words_of(phrase)), lambda i: F.struct(i.alias("at"), F.lit(label).alias("label")))

    found = F.array_sort(F.concat(*[labelled(p, label) for p, label in phrases.items()]))
    none = F.array().cast("array<struct<at:int,label:string>>")
    at = scanned.withColumn("base", F.when(F.col("words").isNotNull(), found).otherwise(none))
    at = at.withColumn("spans", F.when(F.col("words").isNotNull(), licence_matches(scanned, idf, templates, rare_words, votes)).otherwise(F.array().cast("array<struct<t:string,at:int,share:double>>")))
    own = F.transform("base", lambda x: x["label"])
    n = F.size("base").cast("bigint")
    return at.select(
        "doc_id",
        "n_words",
        n.alias("n_base"),
        F.get(F.col("base"), F.lit(0))["at"].cast("bigint").alias("first_word"),
        F.get(F.col("base"), F.size("base") - 1)["at"].cast("bigint").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(own)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(own, F.transform("spans", lambda x: x["t"])))), ",").alias("labels"),
        F.greatest(F.coalesce(F.array_max(F.transform("spans", lambda x: x["share"])), F.lit(0.0)), F.when(n > 0, 0.5).otherwise(0.0)).alias("score"),
        F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["t"], x["at"].cast("string"))), ",").alias("spans"),
    )
