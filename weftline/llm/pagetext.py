"""Main text of HTML pages: the contiguous run of tokens with the largest sum of scores.

A page is read as a sequence of tokens. Words score positive, tags negative; what they score is
learned from pages whose author marked the content (with one ``article`` or ``main`` element):
a token kind that stands inside it in a share p of the cases scores 2p - 1 as a word, and as a
tag -TAG_COST (1 - p). One linear scan finds the run with the largest sum (Bentley's algorithm),
which is widened to whole blocks. Elements that are page furniture by their name, role or class
(menus, sidebars, adverts, forms, reader comments and the like) are one token that costs least,
as tags in marked content do; furniture's text is no part of a run's text.

Two maps over the pages: one counts token kinds on all labelled pages (a row for each kind and
task leaves it), one scores. The kinds are a fixed list, so the table of weights is small at
every size; without a labelled page the priors alone decide.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan as bs

#: What a tag that never stands in content costs, in words.
TAG_COST = 6.0
#: The least that any word gains and any tag costs.
LEAST = 0.02
#: Labelled tokens that a prior counts for.
PRIOR_WEIGHT = 50.0

# Names of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
HEAD = frozenset("base link meta title style script noscript template".split())
FURNITURE = frozenset(
    "head script style title template noscript nav aside footer form fieldset button select textarea option datalist"
    " label dialog menu svg canvas object audio video iframe xmp noembed noframes".split()
)
CONTENT = frozenset({"article", "main"})
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike"
    " strong sub sup time tt u var wbr br".split()
)
TEXT = HEADINGS | (INLINE - {"a"}) | frozenset("p blockquote pre figure figcaption hr address center".split())
LISTS = frozenset("ul ol li dl dt dd table caption colgroup col thead tbody tfoot tr td th".split())
PLAIN = frozenset("html body div section header hgroup summary details".split())
#: An element of these names ends an open one of the group, unless one of the others is between.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}

#: Words of class, id and role that mark furniture; those of the second list by their beginning.
HINTS = frozenset(
    "ad ads adv advert adverts banner sidebar sidenav navbar nav navigation menu menubar submenu breadcrumb breadcrumbs"
    " pagination pager cookie cookies consent gdpr notice notices notification notifications alert alertdialog popup modal"
    " overlay newsletter subscribe subscription signup login share sharing social related recommended footer masthead topbar"
    " toolbar widget widgets copyright promo promotion sponsor sponsored contentinfo complementary search dialog form".split()
)
HINT_BEGINNINGS = ("advert", "sidebar", "cookie", "sponsor", "breadcrumb")
#: Reader comments count as such even on an ``article`` element.
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond responses".split())
#: Only outside of content: an article's own header is a part of it.
HEADERS = frozenset({"header", "banner", "masthead"})
#: Before a hint these take it back, as in has-sidebar.
NOT_A_HINT = frozenset("has no with without".split())

_TOKEN = re.compile(
    r"<(?:!--(?:>|->|.*?(?:--!?>|\Z))"
    r"|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?>(?:[^>\"'=]+|=\s*\"[^\"]*\"|=\s*'[^']*'|[\"'=])*))(?:>|\Z)"
    r"|[!?/][^>]*(?:>|\Z))",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(\"[^\"]*\"?|'[^']*'?|[^\s>]+))?")
_CLASS_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


def _hints(value: str) -> set[str]:
    found = set()
    for name in value.split():
        words = [w.lower() for w in _CLASS_WORDS.findall(name)]
        found |= {w for before, w in zip(["", *words], words) if before not in NOT_A_HINT}
    return found


@lru_cache(4096)
def _marks(rest: str) -> frozenset[str]:
    """Words of an element's class, id and role; 'hidden' if it isn't shown."""
    found = set()
    for name, value in _ATTRIBUTE.findall(rest):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id", "role"):
            found |= _hints(value)
        elif name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            found.add("hidden")
    return frozenset(found)


def _is_furniture(name: str, marks: frozenset[str], in_content: bool) -> bool:
    if name in FURNITURE:
        return True
    if name == "header" and not in_content:
        return True
    if not marks or name in ("html", "body", "main"):
        return False
    if marks & COMMENTS or "hidden" in marks:
        return True
    if name == "article":
        return False
    hints = marks - HEADERS if in_content else marks
    return bool(hints & (HINTS if in_content else HINTS | HEADERS)) or any(h.startswith(HINT_BEGINNINGS) for h in hints)


@dataclass
class Tokens:
    """The tokens of a page: their kinds, words and text (tags: 0 and None), and more by token."""

    kinds: list[str] = field(default_factory=list)
    words: list[int] = field(default_factory=list)
    texts: list[str | None] = field(default_factory=list)
    #: whether a block ends there
    breaks: list[bool] = field(default_factory=list)
    #: whether it stands in an ``article`` or ``main`` element
    inside: list[bool] = field(default_factory=list)
    #: where it begins in the page
    places: list[int] = field(default_factory=list)
    #: outermost ``article`` and ``main`` elements
    contents: int = 0

    def add(self, kind: str, place: int, inside: bool, text: str | None = None, ends: bool = False) -> None:
        self.kinds.append(kind)
        self.words.append(len(text.split()) if text else 0)
        self.texts.append(text)
        self.breaks.append(ends)
        self.inside.append(inside)
        self.places.append(place)


class _Open:
    """The open elements, innermost last."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.count: Counter[str] = Counter()
        self.furniture = -1  # index of the outermost open furniture
        self.inside = 0

    def push(self, name: str, furniture: bool) -> None:
        if furniture and self.furniture < 0:
            self.furniture = len(self.names)
        self.names.append(name)
        self.count[name] += 1
        self.inside += name in CONTENT

    def cut(self, to: int) -> None:
        for name in self.names[to:]:
            self.count[name] -= 1
            self.inside -= name in CONTENT
        del self.names[to:]
        if self.furniture >= to:
            self.furniture = -1

    def find(self, names, stops, inline_only: bool = False) -> int:
        """Index of the innermost open element of some names; -1 if a stop is further inside."""
        if any(self.count[n] for n in names):
            for i in range(len(self.names) - 1, -1, -1):
                if self.names[i] in names:
                    return i
                if self.names[i] in stops or inline_only and self.names[i] not in INLINE:
                    break
        return -1

    def make_room(self, name: str) -> None:
        """End the elements that an opening tag ends by itself."""
        if self.count["head"] and self.names[-1] == "head" and name not in HEAD and name != "head":
            self.cut(len(self.names) - 1)
        if name not in INLINE and (at := self.find(("p",), (), True)) >= 0:
            self.cut(at)
        if name in SIBLINGS and (at := self.find(*SIBLINGS[name])) >= 0:
            self.cut(at)

    def end(self, name: str) -> bool:
        at = self.find((name,), (), name in INLINE)
        if at >= 0:
            self.cut(at)
        return at >= 0


def tokens(page: str) -> Tokens:
    """The tokens of a page, read as browsers read it: tags needn't be closed or well nested."""
    out, stack, at, end = Tokens(), _Open(), 0, len(page)

    def text(to: int) -> None:
        if at == to:
            return
        raw = page[at:to]
        if stack.names[-1:] == ["head"] and not raw.isspace():
            stack.cut(len(stack.names) - 1)
        if stack.furniture < 0:
            kind = "word link" if stack.count["a"] else "word heading" if any(stack.count[h] for h in HEADINGS) else "word"
            out.add(kind, at, stack.inside > 0, entities.unescape(raw) if "&" in raw else raw)

    while at < end:
        found = _TOKEN.search(page, at)
        text(found.start() if found else end)
        if not found:
            break
        at = found.end()
        name = found["name"]
        if name is None or page[at - 1] != ">":  # a comment, or a tag that the page's end cuts
            continue
        name = name.lower()
        known = name if name in INLINE or name in TEXT or name in LISTS or name in PLAIN or name in CONTENT else "other"
        shown = stack.furniture < 0
        if found["end"]:
            inside = stack.inside > 0
            stack.end(name)
            if shown and stack.furniture < 0:
                out.add("/" + known, found.start(), inside and name not in CONTENT, None, name not in INLINE)
            continue
        stack.make_room(name)
        shown = stack.furniture < 0
        marks = _marks(found["rest"]) if len(found["rest"]) > 4 else frozenset()
        furniture = name not in VOID and _is_furniture(name, marks, stack.inside > 0)
        if shown:
            inside = stack.inside > 0
            out.contents += not inside and name in CONTENT and not furniture
            kind = "furniture" if furniture else known
            line = name == "br"
            out.add(kind, found.start(), inside and name not in CONTENT, "\n" if line else None, name not in INLINE)
        if name not in VOID:
            stack.push(name, furniture)
        if name in RAW:
            close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            at = close.start() if close else end
    return out


def prior(kind: str) -> float:
    """The share of a token kind that stands in content, before any page is seen."""
    if kind.startswith("word"):
        return 0.5 if kind == "word link" else 0.95
    name = kind.removeprefix("/")
    for names, share in ((CONTENT, 0.0), (TEXT, 0.98), (LISTS, 0.85), ({"a"}, 0.6), (PLAIN, 0.8)):
        if name in names:
            return share
    return 0.7


def weight(kind: str, inside: int = 0, outside: int = 0) -> float:
    """What a token of a kind scores (a word: each), from its counts on labelled pages."""
    p = (inside + PRIOR_WEIGHT * prior(kind)) / (inside + outside + PRIOR_WEIGHT)
    return max(LEAST, 2 * p - 1) if kind.startswith("word") else -LEAST - TAG_COST * (1 - p)


def best_run(scores: list[float]) -> tuple[int, int]:
    """[from, to) of the contiguous run with the largest sum: the first and longest of equal ones.

    Empty if no score is positive.
    """
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        if total < 0:
            total, start = 0.0, i
        total += score
        if total > best or total == best > 0 and start == found[0]:
            best, found = total, (start, i + 1)
    return found


def extract(page: str, weights: dict[str, float]) -> tuple[str, int, int, int]:
    """(text, blocks in it, from and to in the page) of a page's content; ("", 0, 0, 0) if none."""
    seen = tokens(page)
    scores = []
    for kind, words, inside in zip(seen.kinds, seen.words, seen.inside, strict=True):
        w = weights.get(kind)
        w = weight(kind) if w is None else w
        scores.append(w * words if kind.startswith("word") else -LEAST if inside or kind == "furniture" else w)
    start, stop = best_run(scores)
    if start == stop:
        return "", 0, 0, 0
    while start and not seen.breaks[start - 1] and not seen.breaks[start]:
        start -= 1
    while stop < len(scores) and not seen.breaks[stop]:
        stop += 1
    blocks, block = [], []
    for text, ends in zip(seen.texts[start:stop] + [None], seen.breaks[start:stop] + [True], strict=True):
        if text:
            block.append(text)
        if ends and block:
            blocks.append(" ".join("".join(block).split()))
            block = []
    blocks = [b for b in blocks if b]
    return " ".join(blocks), len(blocks), seen.places[start], seen.places[stop] if stop < len(scores) else len(page)


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Iterator[str]]]:
    for batch in batches:
        yield batch, (x.as_py() or "" for x in batch.column("html"))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    inside, outside = Counter(), Counter()
    for _, pages in _pages(batches):
        for page in pages:
            seen = tokens(page)
            if seen.contents == 1:
                for kind, words, within in zip(seen.kinds, seen.words, seen.inside, strict=True):
                    (inside if within else outside)[kind] += words if kind.startswith("word") else 1
    kinds = sorted(inside | outside)
    yield pa.RecordBatch.from_pydict(
        {
            "kind": pa.array(kinds, pa.string()),
            "inside": pa.array([inside[k] for k in kinds], pa.int64()),
            "outside": pa.array([outside[k] for k in kinds], pa.int64()),
        }
    )


def learn(pages: DataFrame) -> dict[str, float]:
    """Weights by token kind from all pages of ``html`` with one ``article`` or ``main`` element.

    The kinds come from fixed lists of names (under 300), so the result is small at any size.
    """
    counts = pages.select(F.col("html").cast("string").alias("html")).mapInArrow(
        bs.tidy(_count), "kind string, inside long, outside long"
    )
    sums = counts.groupBy("kind").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside")).collect()
    return {r.kind: weight(r.kind, r.inside, r.outside) for r in sums}


def _texts(batches: Iterator[pa.RecordBatch], weights: dict[str, float]) -> Iterator[pa.RecordBatch]:
    for batch, pages in _pages(batches):
        found = [extract(page, weights) for page in pages]
        yield pa.RecordBatch.from_pydict(
            {
                "page_id": batch.column("page_id"),
                "url": batch.column("url"),
                "text": pa.array([f[0] for f in found], pa.string()),
                "n_chars": pa.array([len(f[0]) for f in found], pa.int64()),
                "n_blocks": pa.array([f[1] for f in found], pa.int64()),
                "region_start": pa.array([f[2] for f in found], pa.int64()),
                "region_end": pa.array([f[3] for f in found], pa.int64()),
            }
        )


def main_text(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars, n_blocks, region_start, region_end.

    ``pages`` needs page_id, url and html; other columns are ignored, whatever their names.
    ``text`` is the content: character references decoded, white space inside a block (Unicode's)
    turned into one space, blocks in page order joined by one space. The region is the run's
    place in the html, in code points. A null or empty html, and a page without a word outside
    of furniture, has the empty text, no block and the region 0 to 0; repeated rows and null
    keys stay as they are; an empty table gives none. A page is held whole by its task.
    ``weights`` come from :func:`learn`, by default over the same pages.
    """
    slim = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    kinds = dict(slim.dtypes)
    return slim.mapInArrow(
        bs.tidy(partial(_texts, weights=learn(slim) if weights is None else weights)),
        f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long, n_blocks long, region_start long, region_end long",
    )
