"""Text functions as Column expressions. White space is Unicode white space throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)\s+"
# Names of months, and how dates are written in a text.
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
LONG_DATE = r"\b(" + "|".join(MONTHS) + r")\s+(\d{1,2}),\s*(\d{4})\b"
ISO_DATE = r"\b(\d{4})-(\d{2})-(\d{2})\b"
#: Characters of a passage that tell near-equal ones.
HEAD = 160


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """Words joined by single spaces, nothing at the ends."""
    return F.array_join(words(c), " ")


def words(c: Column) -> Column:
    return F.filter(F.split(c, SPACE), lambda x: x != "")


def word_count(c: Column) -> Column:
    return F.coalesce(F.size(words(c)), F.lit(0))


def token_count(c: Column) -> Column:
    """An estimate of model tokens: words x 1.33, cut to a whole number in integer arithmetic."""
    return (word_count(c) * 133 / F.lit(100)).cast("int")


def sentences(c: Column) -> Column:
    """Sentences: cut after . ! or ? and white space before a capital letter or a quote; blanks dropped."""
    cut = F.split(strip(c), r"""(?<=[.!?])(?U)\s+(?=[A-Z"'])""")
    return F.filter(F.transform(cut, strip), lambda x: x != "")


def fingerprint(c: Column) -> Column:
    """What tells near-equal passages: the first 160 characters, stripped and lower-cased in that order."""
    return F.lower(strip(F.substring(c, 1, HEAD)))


def join_nonempty(separator: str, *cols: Column) -> Column:
    return F.array_join(F.filter(F.array(*[F.coalesce(c, F.lit("")) for c in cols]), lambda x: x != ""), separator)


def first_date(c: Column) -> Column:
    """ISO date of the first long month date in the first 4000 characters, if it is a calendar date, else of the first ISO date, else ''."""
    head = F.substring(F.coalesce(c, F.lit("")), 1, 4000)
    long, iso = LONG_DATE, ISO_DATE
    month = F.lpad(F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.regexp_extract(head, long, 1)).cast("string"), 2, "0")
    day = F.lpad(F.regexp_extract(head, long, 2), 2, "0")
    as_text = lambda y, m, d: F.date_format(F.try_to_date(F.concat_ws("-", y, m, d), "yyyy-MM-dd"), "yyyy-MM-dd")
    found_long = F.when(F.regexp_extract(head, long, 1) != "", as_text(F.regexp_extract(head, long, 3), month, day))
    found_iso = F.when(F.regexp_extract(head, iso, 1) != "", as_text(*[F.regexp_extract(head, iso, i) for i in (1, 2, 3)]))
    return F.coalesce(found_long, found_iso, F.lit(""))


def without_list_marker(c: Column) -> Column:
    """A line without its bullet or its `1.` or `1)`."""
    return strip(F.regexp_replace(strip(c), r"^(?:[-*•]+|\d+[.)])\s*", ""))


def expansion_phrases(answer: Column, question: Column, most: int = 3) -> Column:
    """Lines of a rewrite, without markers, blank or over-long lines, the question and repeats; `most` at most."""
    key = lambda c: F.lower(squeeze(c))
    lines = F.filter(F.transform(F.split(answer, "\n"), without_list_marker), lambda x: (x != "") & (F.length(x) <= 200))
    keyed = F.transform(lines, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x")))
    first = F.filter(keyed, lambda x: (x["k"] != key(question)) & (F.size(F.filter(keyed, lambda y: (y["k"] == x["k"]) & (y["i"] < x["i"]))) == 0))
    return F.slice(F.transform(first, lambda x: x["x"]), 1, most)


def pretty_slug(c: Column) -> Column:
    """A slug as a title: - as spaces, first letters upper-cased, ordinals lower-cased."""

    def word(w: Column) -> Column:
        return F.when(w.rlike(r"(?i)^\d+(st|nd|rd|th)$"), F.lower(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2))))

    return F.array_join(F.transform(words(F.regexp_replace(c, "-", " ")), word), " ")


def human_size(n: Column) -> Column:
    """Bytes as B, KB, MB, GB or TB with one decimal, halves to even."""
    one = lambda unit, power: F.format_string(f"%.1f {unit}", F.bround(n / float(1 << power), 1))
    out = one("TB", 40)
    for power, unit in ((30, "GB"), (20, "MB"), (10, "KB"), (0, "B")):
        out = F.when(n < float(1 << (power + 10)), one(unit, power)).otherwise(out)
    return out
