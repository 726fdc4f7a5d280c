"""Main text of HTML pages: what the markup doesn't tell, a suffix array of each host tells.

A page becomes blocks of text. Elements and names of classes say of most blocks that they are the article's or that they are not (menus,
adverts, footers, comments). Those that they say nothing about are judged by repetition: the words of all blocks outside the
article, with a mark between blocks, are the page's stream. The suffixes of all streams of a host are brought together by their first
WINDOW tokens (a suffix array cut at that depth, whose equal neighbours are the repeated substrings). A place of a
stream is covered if such a substring over it stands in MIN_PAGES different pages or more; substrings that overlap make up the long ones.
Covered words of undecided blocks go, unique runs stay.

The array is dealt by host and first tokens, never by host alone, so a hot host spreads over all tasks; how many pages hold a
substring is counted before any row of it is gathered. Copies of a page count once, but pages with different articles count each, even where
all else on them is the same and they have one stream. Only numbers are shuffled, no texts.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillage.llm.common import written

WINDOW = 10
MIN_PAGES = 3

#: Elements whose content is never text of the page, and is read up to their end tag.
RAW = {"script", "style", "title", "textarea", "iframe", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that begin and end a block.
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that end at the next one of the same kind, or of these kinds.
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option", "optgroup"}, "p": BLOCK}
#: Elements that are no part of an article. An article that opens within one of the first kind ends it, as its end tag must be missing.
LOOSE_TAGS = {"nav", "header", "form", "menu"}
SHUT_TAGS = {"footer", "aside", "noscript", "template", "svg", "math", "button", "select", "dialog", "object", "canvas", "audio", "video", "head", "datalist"}
#: Words in class, id and role that say the same of any element.
LOOSE_WORDS = set(
    "nav navbar navigation menu menus breadcrumb breadcrumbs masthead topbar toolbar ad ads advert adverts advertisement advertising adsense banner promo promotion sponsor "
    "sponsored cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login search form skip".split()
)
SHUT_WORDS = set(
    "footer contentinfo complementary sidebar sidebars aside comment comments commentlist disqus respond reply replies discussion share sharing social related recommended recommendations "
    "widget widgets pagination pager hidden".split()
)
#: Words of a name that take back what the rest of it says, and words that may make it the name of a frame around content and more.
UNSAID_WORDS = {"with", "has", "no", "without", "layout"}
FRAME_WORDS = set("main content contents wrap wrapper container page body entry post article".split())
#: Words that say of an element within content that it is no part of it.
READER_WORDS = {"comment", "comments", "commentlist", "disqus"}

_OPEN, _MAIN, _ARTICLE, _LOOSE, _SHUT = range(5)
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*+(?:>|\Z)|[^>]*(?:>|\Z))""", re.S
)
_ATTRIBUTE = re.compile(r"""(?i)\b(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HOST = re.compile(r"(?i)^[a-z][a-z0-9+.-]*:/*(?:[^/?#@]*@)?([^/?#:]*)")


def host_of(url: str | None) -> str:
    found = _HOST.match((url or "").strip())
    return found[1].lower() if found else ""


def _says(names: list[list[str]], words: set[str], within: bool) -> bool:
    """Whether one of an element's names (in words) is a name for what words stand for.

    It is one if it ends in such a word (`main-menu`) or holds one and no word of a frame (`menu-top`). A name with both (`sidebar-wrap`) may be the
    frame of the whole page, so outside an article it isn't; within one it is."""
    for name in names:
        if words.intersection(name) and not UNSAID_WORDS.intersection(name) and (within or name[-1] in words or not FRAME_WORDS.intersection(name)):
            return True
    return False


def _region(tag: str, attributes: str, parent: int) -> int:
    """Where the text of an element belongs, by its own name and marks and by what it stands in."""
    names: list[list[str]] = []
    content, hidden = tag in ("article", "main"), False
    if attributes:
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
                hidden = True
            elif name == "itemprop":
                content |= value.lower() == "articlebody"
            elif name == "role" and value.lower() in ("main", "article"):
                content = True
            elif name in ("class", "id", "role"):
                for token in value.split():
                    if w := [x.lower() for x in _WORD.findall(token)]:
                        names += [w, ["".join(w)]] if len(w) > 1 else [w]  # `sideBar` is a sidebar
    if tag in ("html", "body"):
        return parent
    if hidden or tag in SHUT_TAGS or parent == _SHUT:
        return max(parent, _SHUT)
    if content:
        # A reader's comment may be an article of its own; `comments-open` and the like say something else of one.
        if any(n[0] == "comment" for n in names):
            return _SHUT
        return _ARTICLE if tag != "main" and not re.search(r"(?i)role\s*=\s*[\"']?main", attributes) or parent == _ARTICLE else _MAIN
    within = parent == _ARTICLE
    if _says(names, READER_WORDS | SHUT_WORDS, within):
        return _SHUT
    if _says(names, LOOSE_WORDS, within) or (parent < _MAIN and _says(names, {"header"}, False)):
        return max(parent, _LOOSE)
    if tag in LOOSE_TAGS and not (tag == "header" and parent in (_MAIN, _ARTICLE)):
        return max(parent, _LOOSE)
    return parent


def page_blocks(page: str | None) -> list[tuple[str, int]]:
    """(text, region) of each block of a page, in page order: white space is one space, and no block is empty."""
    page = page or ""
    blocks: list[tuple[str, int]] = []
    pieces: dict[int, list[str]] = {}
    stack: list[tuple[str, int]] = []
    open_tags: dict[str, int] = {}
    region, at = _OPEN, 0

    def flush() -> None:
        for of, parts in pieces.items():
            text = " ".join(_html.unescape("".join(parts)).split())
            if text:
                blocks.append((text, of))
        pieces.clear()

    def pop() -> None:
        tag, _ = stack.pop()
        open_tags[tag] -= 1

    while True:
        found = _TOKEN.search(page, at)
        text = page[at : found.start() if found else len(page)]
        if text:
            pieces.setdefault(region, []).append(text)
        if not found:
            break
        at = found.end()
        if not found[2]:
            continue
        tag = found[2].lower()
        if tag in BLOCK:
            flush()
        elif tag == "br":
            pieces.setdefault(region, []).append(" ")
        if found[1]:
            if open_tags.get(tag):
                while stack[-1][0] != tag:
                    pop()
                pop()
                region = stack[-1][1] if stack else _OPEN
            continue
        if tag in RAW:
            end = re.compile(rf"(?i)</{re.escape(tag)}\b[^>]*>?").search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in VOID:
            continue
        while stack and tag in ENDED_BY.get(stack[-1][0], ()):
            pop()
        if tag in BLOCK and open_tags.get("p"):
            inner = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == "p" or stack[i][0] in BLOCK)
            if stack[inner][0] == "p":
                while len(stack) > inner:
                    pop()
        parent = stack[-1][1] if stack else _OPEN
        region = _region(tag, found[3], parent)
        stack.append((tag, region))
        open_tags[tag] = open_tags.get(tag, 0) + 1
    flush()
    return blocks


class _Page:
    """What the markup decides of a page, and the stream of the rest.

    kept: its text blocks in order; each is a finished text or, if undecided, its words and the place of the first in the stream.
    digest: of host and stream. number: of these and the article, so only copies of a page share it.
    """

    def __init__(self, page: str | None, url: str | None) -> None:
        blocks = page_blocks(page)
        regions = {r for _, r in blocks}
        undecided = _MAIN if _MAIN in regions else _OPEN if _ARTICLE not in regions else -1
        self.kept: list[tuple[str | None, list[str] | None, int]] = []
        self.stream: list[str | None] = []
        self.n_outside = 0
        for text, r in blocks:
            if r == _ARTICLE:
                if self.kept and self.kept[-1][0] is not None:
                    self.kept[-1] = (f"{self.kept[-1][0]}\n\n{text}", None, 0)
                else:
                    self.kept.append((text, None, 0))
                continue
            words = text.split(" ")
            if self.stream:
                self.stream.append(None)
            if r == undecided:
                self.kept.append((None, words, len(self.stream)))
            self.n_outside += len(words)
            self.stream.extend(words)
        self.host = host_of(url)
        joined = "\n".join("" if w is None else w for w in self.stream)
        self.digest = xxhash.xxh3_128_digest(f"{self.host}\n{joined}".encode("utf-8", "surrogatepass"))
        article = "\n".join(text for text, r in blocks if r == _ARTICLE)
        self.number = np.uint64(xxhash.xxh3_64_intdigest(self.digest + article.encode("utf-8", "surrogatepass"))).view(np.int64)

    def suffixes(self, window: int) -> np.ndarray:
        """A number for the host and first window tokens of each suffix that has so many."""
        n = len(self.stream) - window + 1
        if n < 1:
            return np.zeros(0, np.int64)
        seen: dict[str | None, int] = {None: 0x9E3779B97F4A7C15}
        for w in self.stream:
            if w not in seen:
                seen[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        tokens = np.fromiter((seen[w] for w in self.stream), np.uint64, len(self.stream))
        sums = np.full(n, xxhash.xxh3_64_intdigest(self.host.encode()), np.uint64)
        for j in range(window):
            sums = sums * np.uint64(0xD6E8FEB86659FD93) + tokens[j : j + n]
        sums ^= sums >> np.uint64(32)
        return (sums * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


def _streams(pages: DataFrame, window: int, min_pages: int) -> DataFrame:
    """(suffix, stream, page, at): each suffix of each page's stream by the number of its host and first tokens.

    Of pages with one stream a batch gives min_pages, as more don't change whether so many hold a substring."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[bytes, set[int]] = {}
            for url, page in zip(b.column(0).to_pylist(), b.column(1)):
                p = _Page(page.as_py(), url)
                same = seen.setdefault(p.digest, set())
                if p.number in same or len(same) >= min_pages:
                    continue
                same.add(p.number)
                found = p.suffixes(window)
                if len(found):
                    of = pa.array([p.digest], pa.binary()).take(pa.array(np.zeros(len(found), np.int32)))
                    made = [pa.array(found), of, pa.array(np.full(len(found), p.number)), pa.array(np.arange(len(found), dtype=np.int32))]
                    yield pa.RecordBatch.from_arrays(made, names=["suffix", "stream", "page", "at"])

    return pages.mapInArrow(_gathered(run), "suffix bigint, stream binary, page bigint, at int")


def _gathered(run):
    """run with its small batches joined to some thousand rows."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in run(batches):
            held.append(b)
            rows += b.num_rows
            if rows >= 20_000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, rows = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return joined


def repeated_places(pages: DataFrame, window: int = WINDOW, min_pages: int = MIN_PAGES) -> DataFrame:
    """(stream, covered) of (url, html): for each stream with a substring of window tokens that stands in min_pages different pages of
    its host or more, whether each place up to the last covered one is covered."""
    suffixes = written(_streams(pages, window, min_pages), "suffixes")
    counts = suffixes.groupBy("suffix").agg(F.count_distinct("page").alias("n")).filter(F.col("n") >= min_pages).select("suffix")
    starts = suffixes.select("suffix", "stream", "at").join(counts, "suffix").groupBy("stream").agg(F.collect_set("at").alias("starts"))

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            masks = []
            for starts in b.column(1):
                at = np.asarray(starts.values)
                change = np.zeros(at.max() + window + 1, np.int32)
                np.add.at(change, at, 1)
                np.add.at(change, at + window, -1)
                masks.append(np.cumsum(change)[:-1] > 0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(masks, pa.list_(pa.bool_()))], names=["stream", "covered"])

    return written(starts.mapInArrow(cover, "stream binary, covered array<boolean>"), "covered")


def main_text(pages: DataFrame, html: str = "html", window: int = WINDOW, min_pages: int = MIN_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars, n_outside) for each row of pages.

    text: the blocks of the article in page order, joined by an empty line, with character references decoded and white space (Unicode's) as one space; `br` is
    white space. Blocks in an article element (or articleBody) stay whole, whatever repeats. A page without one gives the blocks of its
    main element, or without that all blocks that no element or class name excludes; of these the words go that substrings
    of window tokens cover which stand in min_pages different pages of the host or more. Where both exist, those of main outside the article
    are judged so too. n_chars: code points. n_outside: words outside the article.

    A null html is an empty page and gives an empty text, as does a page without words. A null url is a host of its own. Unclosed and stray tags, comments and quotes are
    read as far as they go. Repeated rows give equal rows and count as one page; null page_ids stay; other columns are ignored; an empty table gives no rows.
    No page is cut: a task holds one page with its stream at a time.
    """
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col(html).alias("_html"))
    covered = repeated_places(rows.select("url", "_html"), window, min_pages)
    kind = rows.schema["page_id"].dataType.simpleString()
    block = pa.list_(pa.struct([("text", pa.string()), ("words", pa.list_(pa.string())), ("at", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            read = [_Page(page.as_py(), url.as_py()) for url, page in zip(b.column(1), b.column(2))]
            kept = [[dict(zip(("text", "words", "at"), k)) for k in p.kept] for p in read]
            made = [pa.array([p.digest for p in read], pa.binary()), pa.array(kept, block), pa.array([p.n_outside for p in read], pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made], names=["page_id", "url", "stream", "kept", "n_outside"])

    read = rows.mapInArrow(run, f"page_id {kind}, url string, stream binary, kept array<struct<text:string,words:array<string>,at:int>>, n_outside bigint")
    judged = read.join(covered, "stream", "left")
    unique = lambda k: F.filter(k["words"], lambda w, i: ~F.coalesce(F.get(F.col("covered"), k["at"] + i), F.lit(False)))
    texts = F.transform("kept", lambda k: F.coalesce(k["text"], F.array_join(unique(k), " ")))
    text = F.array_join(F.filter(texts, lambda t: t != ""), "\n\n")
    return judged.select("page_id", "url", text.alias("text"), F.length(text).cast("bigint").alias("n_chars"), "n_outside")


SQL = r"""
WITH plain(page_id, url, article, other) AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1),
    regexp_replace(coalesce(html, ''), '(?s)<head>.*?</head>|<!--.*?-->|<article>.*?</article>', '', 'g') FROM pages
), blocks AS (
  SELECT page_id, url, list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace(article, '</?(a|b|i|em|strong|span)\b[^>]*>', '', 'g'), '<br>', ' ', 'g'), '<[^>]*>'), lambda t: DECODED), lambda t: t <> '') AS a,
    list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace(other, '</?(a|b|i|em|strong|span)\b[^>]*>', '', 'g'), '<br>', ' ', 'g'), '<[^>]*>'), lambda t: DECODED), lambda t: t <> '') AS o
  FROM plain
)
SELECT page_id, url, array_to_string(a, chr(10) || chr(10)) AS text, CAST(length(array_to_string(a, chr(10) || chr(10))) AS BIGINT) AS n_chars,
  CAST(coalesce(list_sum(list_transform(o, lambda t: len(string_split(t, ' ')))), 0) AS BIGINT) AS n_outside
FROM blocks
""".replace(
    "DECODED",
    r"trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(t, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&#x27;', ''''), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))".replace('\\"', '"'),
)
