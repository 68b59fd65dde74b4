"""Main text of web pages: containers that win their host's vote, by paths of tags and classes."""

import html
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.operators.stored import stored

# Containers a page votes for, from its best on, and paths that a host keeps for its pages.
VOTES_PER_PAGE, PATHS_PER_HOST = 3, 8
# A host's path serves a page where it scores at least this share of the page's own best container.
LEAST_SHARE = 0.3
# Share of a container's score that the container around it gets as well.
PASSED_ON = 0.5
# An element named as an aside is part of the article after all where it has more than this share of the page's
# text outside links, and an article or heading with it.
MOST_TEXT = 0.5

# Elements without content, with content that is not markup, not shown, and of blocks.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe noembed noframes xmp".split())
UNSEEN = RAW | set("head noscript template svg canvas object audio video select datalist".split())
BLOCKS = set("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption "
             "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section "
             "summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = set("body div article main section td blockquote center fieldset form table".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# Open elements that a start tag ends, and the elements within which it looks for them.
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
            "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "thead", "tbody"}}
WITHIN = set("ul ol menu dl table".split())
# Tags, roles, and words of class or id that tell what is not part of the article; words that may follow
# them in a name, and words by which a name tells a state or a topic.
ASIDE_ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
REMARK_WORDS = set("comment comments commentlist disqus replies respond related recommended teaser promo promoted "
                   "sponsor sponsored ad ads advert adverts advertisement".split())
ASIDE_WORDS = REMARK_WORDS | set(
    "adbox adcontainer adsense adslot adunit advertising alert alerts banner breadcrumb breadcrumbs "
    "consent cookie cookies copyright cta disclaimer footer gdpr header login masthead menu menubar modal "
    "nav navbar navigation newsletter notice notices overlay pager pagination paywall popup promotion "
    "share sharing sidebar sidebars signup social subscribe subscription toolbar topbar widget widgets".split())
PART_WORDS = set("area bar block body bottom box button buttons card column container content elements form group heading holder "
                 "icons inner item items left link links list main outer panel post posts primary right row secondary section "
                 "site slot text title toggle top unit wrap wrapper".split())
STATE_WORDS = set("active category closed disabled enabled fixed format has hide is no off on open page show status sticky tag theme type "
                  "with without".split())
MAIN_WORDS = set("article body content entry main post story text".split())

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>"']++|"[^"<]*+"|'[^'<]*+'|["'])*+)>"""
                   r"""|<(/?)([a-zA-Z][^\s/<>]*)([^>]*)>|<[!?][^>]*>""", re.S)
NAMED = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s"'/]|$)""", re.I)
WORDS = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
DIGITS = re.compile(r"[0-9]+")
NOT_SHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def main_text(web_pages: DataFrame, votes_per_page: int = VOTES_PER_PAGE, paths_per_host: int = PATHS_PER_HOST) -> DataFrame:
    """(page_id, url, text) for each row of web_pages (page_id, url, html).

    The library has no web pages among its own records, so these are taken as they are crawled. A page votes
    for its best containers by generalised path: tags and classes from the body down, without digits. They
    are scored by length of text outside links, nearness to it, and names. A host keeps the paths with the
    most votes, `paths_per_host` of them; each page is then extracted again with the first of them that suits it, at
    all its places in page order, or else with its own best container, as is a page of a host's further
    templates. Menus, headers and footers, notices, adverts, forms,
    comments and what is not shown are left out, a header only where it is not an article's with its
    heading. Text is decoded; white space within a block becomes one space, and blocks are joined by one.
    Null and empty html, and pages with nothing else, give an empty text. Null urls are one host. Rows that
    repeat a page come back each. Other columns are ignored.
    """
    pages = web_pages.select("page_id", "url", "html").withColumn("host", host(F.col("url")))
    votes = (pages.select("host", "html").mapInArrow(_voter(votes_per_page), "host string, path string, score double")
             .groupBy("host", "path").agg(F.sum("score").alias("score")))
    rank = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("score"), "path"))
    ranked = votes.withColumn("rank", rank).where(F.col("rank") <= paths_per_host)
    paths = F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda r: r["path"])
    winners = stored(ranked.groupBy("host").agg(paths.alias("paths")))
    return (pages.join(winners, "host", "left").select("page_id", "url", "html", "paths")
            .mapInArrow(_extract, "page_id long, url string, text string"))


def host(url: Column) -> Column:
    """Host of a URL in lower case, empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^\s*(?:[^:/?#]+:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _voter(votes: int):
    def vote(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for of_host, source in zip(batch["host"].to_pylist(), batch["html"].to_pylist(), strict=True):
                best = Page(source or "").best(votes)
                rows.extend((of_host, path, score / best[0][1]) for path, score in best)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.float64()))],
                ["host", "path", "score"])
    return vote


def _extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [Page(source or "").text(paths or [])
                 for source, paths in zip(batch["html"].to_pylist(), batch["paths"].to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(found, pa.string())],
                                         ["page_id", "url", "text"])


class Names(NamedTuple):
    """What an element's attributes tell."""
    piece: str
    aside: bool
    remark: bool
    header: bool
    main: bool
    role: str
    hidden: bool


@lru_cache(maxsize=4096)
def names(attributes: str) -> Names:
    classes, kinds, words, role, hidden = [], set(), set(), "", False
    for name, *values in NAMED.findall(attributes):
        name, value = name.lower(), next(filter(None, values), "")
        if name in ("class", "id"):
            for token in value.split():
                own = WORDS.findall(CAMEL.sub(" ", token).lower())
                words.update(own)
                kinds.add(_aside_word(own))
            if name == "class":
                classes = sorted({DIGITS.sub("", c).replace(">", "") for c in value.split()})
        elif name == "role":
            role = value.lower()
        else:
            hidden = hidden or name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or bool(
                name == "style" and NOT_SHOWN.search(value))
    kinds.discard("")
    return Names("".join("." + c for c in classes), bool(kinds), not kinds.isdisjoint(REMARK_WORDS), kinds == {"header"},
                 not words.isdisjoint(MAIN_WORDS), role, hidden)


def _aside_word(words: list[str]) -> str:
    """The word by which a whole name is that of an aside, if it is one.

    `site-footer` and `comment-list` are, `comments-open`, `no-sidebar` and `tag-newsletter` are not: the name has to end
    with such a word, or to start with one and go on with words for parts.
    """
    if not words or not STATE_WORDS.isdisjoint(words):
        return ""
    if words[-1] in ASIDE_WORDS:
        return words[-1]
    return words[0] if words[0] in ASIDE_WORDS and all(w in PART_WORDS or w in ASIDE_WORDS for w in words[1:]) else ""


class OpenElements:
    """Open elements, the innermost last, with the places of each tag: looking for one takes no walk."""

    def __init__(self):
        self.elements, self.tags = [0], ["body"]
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.bounds: list[int] = []

    def push(self, element: int, tag: str) -> None:
        place = len(self.elements)
        self.elements.append(element)
        self.tags.append(tag)
        self.places.setdefault(tag, []).append(place)
        if tag in BLOCKS and tag != "p":
            self.blocks.append(place)
        if tag in WITHIN:
            self.bounds.append(place)

    def last(self, tag: str) -> int:
        """Place of the innermost element of a tag, 0 for none."""
        places = self.places.get(tag)
        return places[-1] if places else 0

    def cut(self, place: int) -> None:
        """Close the element at a place and all within it."""
        while len(self.elements) > place:
            self.elements.pop()
            self.places[self.tags.pop()].pop()
        for marks in (self.blocks, self.bounds):
            while marks and marks[-1] >= place:
                marks.pop()

    def end_for(self, tag: str) -> None:
        """Close what a start tag closes."""
        if tag in BLOCKS and tag != "br":
            place = max(self.last("p"), self.last("head"))
            if place and place > (self.blocks[-1] if self.blocks else 0):
                self.cut(place)
        bound = self.bounds[-1] if self.bounds else 0
        ended = [places[at] for other in ENDED_BY.get(tag, ()) if (places := self.places.get(other))
                 and (at := bisect_right(places, bound)) < len(places)]
        if ended:
            self.cut(min(ended))


class Page:
    """Elements and texts of a page, in page order; unclosed and stray tags are allowed, at any depth.

    An element has a tag, its parent, the container it is in or is, the node of that container's path, whether it is
    never shown, whether it is named as an aside (and how), and whether it is in a link.
    """

    def __init__(self, source: str):
        self.tags, self.parents, self.container, self.path = ["body"], [-1], [0], [0]
        self.unseen, self.aside, self.linked = [False], [""], [False]
        self.factor = {0: 1.0}
        self.nodes: dict[tuple[int, str], int] = {}  # paths as a trie: the node below a node
        self.above: list[tuple[int, str]] = [(-1, "body")]
        self.texts: list[tuple[int, str]] = []
        self._read(source)
        self.skipped = self._skipped()

    def _read(self, source: str) -> None:
        open_, at, end = OpenElements(), 0, len(source)
        last = source.rfind(">") + 1
        while at < end:
            found = TOKEN.search(source, at, max(last, at)) if at < last else None
            if not found:
                self._text(open_.elements[-1], source[at:])
                break
            if found.start() > at:
                self._text(open_.elements[-1], source[at:found.start()])
            at = found.end()
            tag = (found[2] or found[5] or "").lower()
            if not tag:
                continue
            if tag in BLOCKS:
                self.texts.append((0, " "))
            if found[1] or found[4]:
                if place := open_.last(tag):
                    open_.cut(place)
                continue
            if tag in ("html", "body"):
                if open_.tags[-1] == "head":
                    open_.cut(len(open_.tags) - 1)
                continue
            open_.end_for(tag)
            own = self._add(open_.elements[-1], tag, found[3] or found[6] or "")
            if tag in RAW:
                stop = _end_of(tag).search(source, at)
                at = stop.end() if stop else end
            elif tag not in VOID:
                open_.push(own, tag)

    def _text(self, element: int, raw: str) -> None:
        self.texts.append((element, html.unescape(raw) if "&" in raw else raw))

    def _add(self, parent: int, tag: str, attributes: str) -> int:
        own = len(self.tags)
        named = names(attributes if tag != "a" or "class" in attributes or "hidden" in attributes else "")
        aside = ""
        if tag in ("nav", "footer", "aside", "button", "menu", "dialog"):
            aside = "tag"
        elif named.remark and tag not in ("body", "main"):
            aside = "remark"
        elif tag == "form":
            aside = "form"
        elif tag == "header" or named.header and tag not in ("body", "main", "article"):
            aside = "header"
        elif tag not in ("body", "main", "article") and (named.aside or named.role in ASIDE_ROLES):
            aside = "name"
        elif tag == "article" and named.role in ASIDE_ROLES:
            aside = "name"
        self.tags.append(tag)
        self.parents.append(parent)
        self.unseen.append(self.unseen[parent] or tag in UNSEEN or named.hidden)
        self.aside.append(aside)
        self.linked.append(self.linked[parent] or tag == "a")
        if tag in CONTAINERS:
            key = self.path[parent], tag + named.piece
            if key not in self.nodes:
                self.nodes[key] = len(self.above)
                self.above.append(key)
            self.path.append(self.nodes[key])
            self.container.append(own)
            main = 3.0 if tag == "article" else 2.0 if tag == "main" or named.role == "main" else 1.0
            self.factor[own] = main * (1.5 if named.main else 1.0)
        else:
            self.path.append(self.path[parent])
            self.container.append(self.container[parent])
        return own

    def _skipped(self) -> list[bool]:
        """Elements that are not part of the article, and all within them.

        What is named as an aside is none where it has the page's main element, or most of its text with an article
        or first heading in it, or where it is the header of an article, with a heading.
        """
        n = len(self.tags)
        size, has = [0] * n, [0] * n  # text outside links; 1 for a main element, 2 an article, 4 a first heading, 8 any
        marks = {"main": 1, "article": 2, "h1": 12, **dict.fromkeys(HEADINGS - {"h1"}, 8)}
        for element, text in self.texts:
            if not self.unseen[element] and not self.linked[element]:
                size[element] += len(text) - text.count(" ")
        for element in range(n - 1, 0, -1):
            parent = self.parents[element]
            if not self.unseen[element]:
                has[element] |= marks.get(self.tags[element], 0)
            size[parent] += size[element]
            has[parent] |= has[element]
        most = MOST_TEXT * size[0]
        in_article, skipped = [False] * n, [False] * n
        for element in range(1, n):
            parent, aside = self.parents[element], self.aside[element]
            in_article[element] = in_article[parent] or self.tags[element] in ("article", "main")
            kept = not aside or bool(has[element] & 1) or (
                size[element] > most and bool(has[element] & (4 if aside == "remark" else 6))) or (
                aside == "header" and in_article[parent] and bool(has[element] & 8)) or (
                aside == "form" and (bool(has[element] & 2) or size[element] > most))
            skipped[element] = skipped[parent] or self.unseen[element] or not kept
        return skipped

    def scores(self) -> dict[int, float]:
        """Score of each container path with text, by the path's node."""
        size = dict.fromkeys(self.factor, 0.0)
        for element, text in self.texts:
            if not self.skipped[element] and not self.linked[element]:
                size[self.container[element]] += len("".join(text.split()))
        for place in sorted(size, reverse=True):
            if place:
                size[self.container[self.parents[place]]] += PASSED_ON * size[place]
        found: dict[int, float] = {}
        for place, score in size.items():
            if score > 0 and not self.skipped[place]:
                path = self.path[place]
                found[path] = max(found.get(path, 0.0), score * self.factor[place])
        return found

    def best(self, most: int) -> list[tuple[str, float]]:
        """Paths with the best scores; of equal ones the first on the page."""
        return [(self._written(path), score) for path, score in sorted(self.scores().items(), key=lambda s: (-s[1], s[0]))[:most]]

    def _written(self, path: int) -> str:
        pieces = []
        while path >= 0:
            path, piece = self.above[path]
            pieces.append(piece)
        return ">".join(reversed(pieces))

    def _node(self, path: str) -> int:
        """The node of a written path, -1 if the page has none."""
        node = 0
        for piece in path.split(">")[1:]:
            node = self.nodes.get((node, piece), -1)
            if node < 0:
                break
        return node

    def text(self, paths: list[str]) -> str:
        """Text within the first of the paths that suits the page, or else within its best container."""
        scores = self.scores()
        if not scores:
            return ""
        best, most = min(scores.items(), key=lambda s: (-s[1], s[0]))
        path = next((p for p in map(self._node, paths) if scores.get(p, 0.0) >= LEAST_SHARE * most), best)
        inside = [False] * len(self.tags)
        for element in range(len(self.tags)):
            parent = self.parents[element]
            inside[element] = parent >= 0 and inside[parent] or (
                self.container[element] == element and self.path[element] == path)
        return " ".join("".join(
            text if text == " " or inside[element] and not self.skipped[element] else ""
            for element, text in self.texts).split())


@lru_cache(maxsize=len(RAW))
def _end_of(tag: str) -> re.Pattern[str]:
    return re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I)
