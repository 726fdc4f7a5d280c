"""The frontier of a crawl as tables: which links come in, which pages are looked at again, what becomes of a fetched page.

A catalog has url (canonical), state (queued, fetched, skipped, error) and source or note.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillage.functions import urls as U


def catalog_add(catalog: DataFrame, links: DataFrame) -> DataFrame:
    """(url, state, source): links (url, source) that the catalog lacks, in canonical form, queued; of several sources of one link the least."""
    new = links.select(U.canonical_url(F.col("url")).alias("url"), "source").filter("url is not null").groupBy("url").agg(F.min("source").alias("source"))
    return new.join(catalog.select("url"), "url", "left_anti").select("url", F.lit("queued").alias("state"), "source")


def links_in_scope(pages: DataFrame, deny: tuple[str, ...] = (), only_section: bool = True, section: str = "messages", content: tuple[str, ...] = ()) -> DataFrame:
    """(url, source): links of pages (url, links) to the same site that are neither denied nor out of scope."""
    each = pages.select(F.col("url").alias("source"), F.explode("links").alias("url"))
    return each.filter(U.same_site(F.col("url"), F.col("source")) & U.allowed(F.col("url"), deny) & U.in_scope(F.col("url"), only_section, section, content))


def revisits(catalog: DataFrame, seeds: DataFrame | None = None, section: str = "messages", listings: tuple[str, ...] = ("archive", "series")) -> DataFrame:
    """(url, state, note): what is queued again to find new pages: listings and seeds (url) that aren't queued now. Detail pages don't change."""
    again = U.is_listing(F.col("url"), section, listings)
    rows = catalog.filter("state <> 'queued'")
    if seeds is not None:
        known = seeds.select(U.canonical_url(F.col("url")).alias("_seed")).distinct()
        rows = rows.join(known, F.col("url") == F.col("_seed"), "left")
        again = again | F.col("_seed").isNotNull()
    return rows.filter(again).select("url", F.lit("queued").alias("state"), F.lit("revisit").alias("note"))


def page_outcomes(pages: DataFrame, beliefs: tuple[str, ...] = (), excluded: tuple[str, ...] = (), section: str = "messages", listings: tuple[str, ...] = ("archive", "series")) -> DataFrame:
    """pages (url, body, audio_url, campus) with is_message, is_belief, state and note; what is kept has state fetched and an empty note.

    A detail page of an excluded campus is skipped. Of a listing only the links count. Audio makes a page a message wherever it stands, and only
    pages without audio are beliefs, if their path is one of beliefs. A page that is neither and has no body is of no use.
    """
    u, none = F.col("url"), lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    detail = U.is_message(u, section, listings)
    skip = detail & F.col("campus").isin(*excluded) if excluded else F.lit(False)
    belief = (U.site_path(u).isin(*beliefs) if beliefs else F.lit(False)) & none("audio_url")
    out = pages.withColumns({"is_message": detail | ~none("audio_url"), "is_belief": belief})
    note = (
        F.when(skip, F.concat(F.lit("campus "), F.col("campus"), F.lit(" excluded")))
        .when(U.is_listing(u, section, listings), "listing")
        .when(~F.col("is_message") & ~F.col("is_belief") & none("body"), "no usable body")
        .otherwise("")
    )
    return out.withColumns({"state": F.when(skip, "skipped").otherwise("fetched"), "note": note})


def catalog_tallies(catalog: DataFrame, section: str = "messages", listings: tuple[str, ...] = ("archive", "series")) -> DataFrame:
    """One row: messages, fetched_messages, queued_messages, queued_listings. A message that isn't queued counts as fetched."""
    detail, listing = U.is_message(F.col("url"), section, listings), U.is_listing(F.col("url"), section, listings)
    queued = F.col("state") == "queued"
    return catalog.agg(
        F.count_if(detail).alias("messages"), F.count_if(detail & ~queued).alias("fetched_messages"),
        F.count_if(detail & queued).alias("queued_messages"), F.count_if(~detail & listing & queued).alias("queued_listings"),
    )


def newest_artefact(files: DataFrame) -> DataFrame:
    """One row: the path and time of the file that was modified last (path, modificationTime); none without files."""
    return files.agg(F.max(F.struct("modificationTime", "path")).alias("x")).filter("x is not null").select("x.path", "x.modificationTime")
