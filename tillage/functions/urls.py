"""URL functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillage.functions.text import pretty_slug

# Query keys that only filter a view of the same page.
VIEW_ONLY = ["location", "_", "share", "replytocom", "fbclid", "utm_source", "utm_medium", "utm_campaign"]
# Fixed value: the name of an audio file, a date and a campus.
AUDIO_NAME = r"(?i)(\d{8})([a-z]{2,4})\.mp3"
URL = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def scheme(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, URL, 1))


def netloc(u: Column) -> Column:
    return F.regexp_extract(u, URL, 2)


def path(u: Column) -> Column:
    return F.regexp_extract(u, URL, 3)


def path_parts(u: Column) -> Column:
    return F.filter(F.split(path(u), "/"), lambda x: x != "")


def canonical_path(u: Column) -> Column:
    p = F.regexp_replace(path(u), "/+$", "")
    p = F.when(p == "", "/").otherwise(p)
    return F.when(p.startswith("/about/"), F.substr(p, F.lit(7))).otherwise(p)


def _decoded(c: Column) -> Column:
    """A query's key or value without escapes; one that isn't well escaped is left as it is, but for + as space."""
    return F.coalesce(F.try_url_decode(c), F.replace(c, F.lit("+"), F.lit(" ")))


def _encoded(c: Column) -> Column:
    """Escaped as in a form: letters, digits and _.-~ as they are, + for a space."""
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def query_pairs(u: Column) -> Column:
    """array<struct<k, v>> of a query's decoded pairs, in order, without blank values and view-only keys."""
    cut = F.filter(F.split(F.regexp_extract(u, URL, 4), "&"), lambda x: F.instr(x, "=") > 0)
    pairs = F.transform(cut, lambda x: F.struct(_decoded(F.substring_index(x, "=", 1)).alias("k"), _decoded(F.substr(x, F.instr(x, "=") + 1)).alias("v")))
    return F.filter(pairs, lambda p: (p["v"] != "") & ~F.lower(p["k"]).isin(VIEW_ONLY))


def canonical_url(u: Column) -> Column:
    """One URL for one page: no fragment, no view-only or blank query values, the query's pairs sorted and escaped in one
    way, no trailing slash, /about/x as /x, lower-case scheme and host."""
    query = F.array_join(F.transform(F.array_sort(query_pairs(u)), lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")
    return F.concat(scheme(u), F.lit("://"), F.lower(netloc(u)), canonical_path(u), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def site_path(u: Column) -> Column:
    """The canonical path of a URL or of a bare path, for comparison with configured ones."""
    whole = F.when(F.instr(u, "://") > 0, u).otherwise(F.concat(F.lit("http://x/"), F.regexp_replace(u, "^/", "")))
    p = F.regexp_replace(canonical_path(whole), "/+$", "")
    return F.when(p == "", "/").otherwise(p)


def is_message(u: Column, section: str = "messages", listings: tuple[str, ...] = ("archive", "series")) -> Column:
    """A detail page: /<section>/<group>/<page>, where the group isn't a listing."""
    p = path_parts(u)
    return F.coalesce((F.size(p) >= 3) & (F.get(p, F.lit(0)) == section) & ~F.get(p, F.lit(1)).isin(*listings), F.lit(False))


def is_listing(u: Column, section: str = "messages", listings: tuple[str, ...] = ("archive", "series")) -> Column:
    """A page that gains links over time: the root, or anything else under the section."""
    p = path_parts(u)
    return (F.size(p) == 0) | (F.coalesce(F.get(p, F.lit(0)) == section, F.lit(False)) & ~is_message(u, section, listings))


def series_of(u: Column, section: str = "messages") -> Column:
    p = path_parts(u)
    return F.when((F.size(p) >= 2) & (F.get(p, F.lit(0)) == section), pretty_slug(F.get(p, F.lit(1)))).otherwise("")


def priority(u: Column, section: str = "messages", beliefs: tuple[str, ...] = (), content: tuple[str, ...] = (), listings: tuple[str, ...] = ("archive", "series")) -> Column:
    """What to fetch first: listings 0, beliefs 1, content pages 2, messages 3, others 4."""
    p = canonical_path(u)
    return (
        F.when(is_listing(u, section, listings), 0)
        .when(p.isin(*beliefs) if beliefs else F.lit(False), 1)
        .when(p.isin(*content) if content else F.lit(False), 2)
        .when(is_message(u, section, listings), 3)
        .otherwise(4)
    )


def allowed(u: Column, deny: tuple[str, ...]) -> Column:
    """Not holding any of the denied strings, whatever the case."""
    return ~F.exists(F.array(*[F.lit(d.lower()) for d in deny]), lambda d: F.contains(F.lower(u), d)) if deny else F.lit(True)


def same_site(link: Column, page: Column) -> Column:
    return (netloc(link) == "") | (F.lower(netloc(link)) == F.lower(netloc(page)))


def in_scope(u: Column, only_section: bool = True, section: str = "messages", content: tuple[str, ...] = ()) -> Column:
    p = canonical_path(u)
    return p.startswith("/" + section) | p.isin(*content or ("",)) if only_section else F.lit(True)


def slug(u: Column) -> Column:
    s = F.substring(F.array_join(path_parts(u), "-"), 1, 120)
    return F.when(s == "", "index").otherwise(s)


def audio_key(u: Column) -> Column:
    return F.lower(F.concat(scheme(F.trim(u)), F.lit("://"), netloc(F.trim(u)), path(F.trim(u))))


def audio_campus(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, AUDIO_NAME, 2))


def dedup_key(date: Column, campus: Column, audio: Column, url: Column) -> Column:
    """Identity of a recording: its audio file, else date and campus, else (neither known) its page."""
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    return (
        F.when(~blank(audio), F.concat(F.lit("audio:"), audio_key(audio)))
        .when(~blank(date), F.lower(F.concat(F.lit("msg:"), date, F.lit("|"), F.coalesce(campus, F.lit("")))))
        .otherwise(F.concat(F.lit("url:"), canonical_url(url)))
    )
