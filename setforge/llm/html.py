"""Main text of web pages from a stream of parser events.

The standard library's parser runs once over the page. Its events are folded into lines, one for each block of text,
with the characters of the block, those of them in links, the tags met since the line before, and the container that
the line stands in. Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, hidden parts and
reader comments that an element, a role or a name says are such are dropped wherever they stand.

The text-to-tag ratio of the lines is smoothed by a Gaussian, and lines above a threshold (the standard deviation, or
the mean if that is less) form clusters. The clusters select the regions of content:

* Where there is a ``main`` with text, only its lines are looked at, and the clusters are theirs.
* Articles count that hold an ``h1`` (unless another ``h1`` stands over more), or else are clusters for the most part,
  if the clusters' text is mostly theirs; a heading of the page before them in ``main`` goes with them. Teasers (by their names) only count where there is no
  other article and no other text has as much.
* Otherwise the region is the deepest container with nearly all of the clusters' text. Of the containers beside it,
  and beside those around it, those go with it that are clusters for the most part, that hold the ``h1``, or that stand
  between clusters; of the others, and of what is mostly links outside of clusters, nothing is kept.

In regions so selected lines are content, short paragraphs and headings too, except for teasers, for containers without
any cluster that are mostly links, and for small containers (with a class or the like) whose own ratio is below the
threshold of the region's lines: boxes whose names say nothing. A page without clusters has no content. Forms and headers
are dropped, but for forms that hold most of the clusters and for an article's title in its header.

Time grows in proportion to the page, however deeply it is nested and however many tags, quotes and comments it leaves open.

References are decoded, white space inside a block (a line break too) becomes one space, blocks are trimmed and joined
by an empty line. Null and empty pages, and pages without content, give an empty text. Whole pages are read. Repeated
rows give repeated results and other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setforge.operators.ordinals import free_names

SIGMA = 1.5
#: Share of the region's text that a container of little text for its tags has at most.
SPARSE = 0.1
#: Share of the clusters' text that the region of a page without articles has at least.
NEARLY_ALL = 0.9
# Element names and the words that mark boilerplate in classes, ids and roles.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("head title script style noscript template iframe object svg math canvas nav footer aside button select textarea dialog menu".split())
#: Dropped too, unless they turn out to hold the article or its title.
DOUBTFUL = frozenset(("form", "header"))
BLOCKS = frozenset(
    "address article blockquote body center dd details div dl dt fieldset figcaption figure form h1 h2 h3 h4 h5 h6 header hr html li main ol p pre section summary table tbody tfoot thead tr ul".split()
)
REGIONS = frozenset("article main section div body html".split()) | DOUBTFUL
CLOSED_BY = {"p": BLOCKS, "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr",)), "td": frozenset(("td", "th", "tr")), "th": frozenset(("td", "th", "tr"))}
#: Beyond those of CLOSED_BY, what ends a dropped paragraph; elements in which a start tag's search for what it ends stops; elements of a head.
ENDS_DROPPED_P = frozenset("aside dialog footer menu nav td th".split())
STOPS = BLOCKS | DROPPED | {"td", "th"}
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
#: A name is one of boilerplate if it has such a word, with words of place before it and words of structure behind it at most:
#: site-header and comment-body are, share-price, has-sidebar and entry-header are not.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense alert alerts banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus feedback footer header leaderboard masthead menu menubar modal nav navbar navigation newsletter notice notification pager pagination popup promo promotion related reply replies respond reviews share sharing sidebar signup social sponsor sponsored subscribe testimonials toolbar widget".split()
)
PLACES = frozenset("blog bottom copyright desktop email first floating gdpr global google inline last left legal main mobile page primary privacy reader readers right second secondary side site sticky sub third top user users".split())
STRUCTURE = frozenset(
    "area article articles author avatar bar block body bottom box btn button buttons card cards col column container content count date entry form group head heading icon icons image img inner item items label left link links list logo main message meta module more note outer overlay panel placeholder post posts right row section slot space stories story text thread title toggle tools top unit units view wide wrap wrapper".split()
)
CARDS = frozenset("card excerpt preview promo teaser tile".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
NEVER_MARKED = frozenset(("html", "body", "main")) | DOUBTFUL
_parts = re.compile(r"[A-Z]?[^\W\d_A-Z]+|[A-Z]+|\d+(?:x\d+)?").findall


def _boilerplate(name: str) -> bool:
    parts = [p.lower() for p in _parts(name)]
    at = [k for k, p in enumerate(parts) if p in MARKS]
    if not at:
        return False
    between = [p for p in parts[at[0] : at[-1]] if p not in MARKS and p not in STRUCTURE]
    return not between and all(p in PLACES for p in parts[: at[0]]) and all(p in STRUCTURE or p in PLACES or p[0].isdigit() for p in parts[at[-1] + 1 :])


def _marked(attrs: list[tuple[str, str | None]]) -> bool:
    """Whether the attributes of an element say that it is boilerplate or hidden."""
    for name, value in attrs:
        if name in ("class", "id"):
            if any(map(_boilerplate, (value or "").split())):
                return True
        elif name == "role":
            if (value or "").strip().lower() in ROLES:
                return True
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        elif name == "style" and "display:none" in (value or "").lower().replace(" ", ""):
            return True
    return False


def _teaser(attrs: list[tuple[str, str | None]]) -> bool:
    return any(not CARDS.isdisjoint(p.lower() for p in _parts(t)) for name, value in attrs if name == "class" for t in (value or "").split())


_opens = re.compile(r"[A-Za-z][A-Za-z0-9:_-]*")
_ends = re.compile(r">|=\s*[\"']")
_comment_end = re.compile(r"--\s*>|--!>")
_raw_end = {name: re.compile(f"</{name}(?![a-z])", re.I) for name in ("script", "style")}


class _Tags:
    """Where tags end, by the quotes of their attributes; what one search without an end has passed, none passes again."""

    def __init__(self, html: str):
        found = list(_ends.finditer(html))
        self.html, self.starts, self.ends = html, [m.start() for m in found], [m.end() for m in found]
        self.last = {q: html.rfind(q) for q in "'\""}
        self.failed: set[int] = set()

    def end(self, at: int) -> int:
        """The place behind the tag that is open at a place, -1 if it never ends."""
        passed, k = [], bisect_left(self.starts, at)
        while k < len(self.starts) and k not in self.failed:
            passed.append(k)
            behind = self.ends[k]
            quote = self.html[behind - 1]
            if quote == ">":
                return behind
            if behind > self.last[quote]:
                break
            k = bisect_left(self.starts, self.html.index(quote, behind) + 1, k)
        self.failed.update(passed)
        return -1


def guarded(html: str) -> str:
    """The page without comments, declarations and the content of scripts and styles, every other ``<`` that begins no whole tag escaped.

    The parser looks to the end of the page for the end of each unfinished tag; here each place is passed once. A comment,
    declaration or script that never ends takes the rest of the page, as in browsers.
    """
    tags, last, last_section = _Tags(html), html.rfind(">"), html.rfind("]]>")
    out, at = [], 0
    while (i := html.find("<", at)) >= 0:
        out.append(html[at:i])
        at = i + 1
        if m := _opens.match(html, i + 1):
            end = tags.end(m.end()) if m.end() <= last else -1
            if end < 0:
                out.append("&lt;")
                continue
            out.append(html[i:end])
            at = end
            if (raw := _raw_end.get(m[0].lower())) and html[end - 2] != "/":
                if not (m := raw.search(html, end)):
                    return "".join(out)
                at = m.start()
        elif html.startswith("/", i + 1):
            end = html.find(">", i) + 1 if i < last else 0
            if not end:
                out.append("&lt;")
                continue
            if _opens.match(html, i + 2):
                out.append(html[i:end])
            at = end
        elif html.startswith("<!--", i):
            if not (m := _comment_end.search(html, i + 2)):
                return "".join(out)
            at = m.end()
        elif html.startswith(("!", "?"), i + 1):
            if i > last:
                return "".join(out)
            section = html.startswith("<![CDATA[", i) and i < last_section
            at = html.index("]]>", i) + 3 if section else html.index(">", i) + 1
        else:
            out.append("&lt;")
    return "".join(out) + html[at:]


class Lines(HTMLParser):
    """Events to lines, and the containers they stand in; containers are numbered in the order of their start tags."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.text: list[str] = []  # of each line
        self.tags: list[int] = []
        self.links: list[int] = []  # characters in links
        self.heading: list[bool] = []  # an h1
        self.region: list[int] = []  # the innermost container, -1 for none
        self.kind: list[str] = []  # of each container: element name, teaser for an article that is one
        self.parent: list[int] = []
        self.named: list[bool] = []  # whether it has attributes; one without them only groups
        self._open: list[str] = []
        self._stops: list[int] = []  # places in _open of elements in STOPS
        self._count: Counter[str] = Counter()  # of the names in _open
        self._regions = [-1]
        self._dropped = 0  # depth at which the dropped part began
        self._parts: list[str] = []
        self._met = self._linked = 0

    def _flush(self) -> None:
        if self._parts:
            text = " ".join("".join(self._parts).split())
            self._parts = []
            if text:
                self.text.append(text)
                self.tags.append(self._met)
                self.links.append(min(self._linked, len(text)))
                self.heading.append(self._count["h1"] > 0)
                self.region.append(self._regions[-1])
                self._met = self._linked = 0

    def _push(self, tag: str) -> None:
        if tag in STOPS:
            self._stops.append(len(self._open))
        self._open.append(tag)
        self._count[tag] += 1

    def _pop(self) -> None:
        tag = self._open.pop()
        self._count[tag] -= 1
        if tag in STOPS:
            self._stops.pop()
        if self._dropped > len(self._open):
            self._dropped = 0
        elif not self._dropped and tag in REGIONS:
            self._regions.pop()

    def _imply(self, tag: str) -> None:
        """End the elements whose end tags a start tag implies, inline elements in them too; in dropped parts as well."""
        while self._stops:
            at = self._stops[-1]
            top = self._open[at]
            dropped_p = self._dropped and top == "p" and tag in ENDS_DROPPED_P
            if tag not in CLOSED_BY.get(top, ()) and not dropped_p and not (top == "head" and tag not in IN_HEAD):
                return
            while len(self._open) > at:
                self._pop()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self._dropped:
            if tag in VOID and tag != "hr":
                return
            self._imply(tag)
            if self._dropped:
                if tag not in VOID:
                    self._push(tag)
                return
        self._met += 1
        if tag == "br":
            self._parts.append(" ")
            return
        if tag in BLOCKS:
            self._flush()
        elif tag in ("td", "th"):
            self._parts.append(" ")
        if tag in VOID and tag != "hr":
            return
        self._imply(tag)
        if tag in VOID:
            return
        self._push(tag)
        if tag in DROPPED or attrs and tag not in NEVER_MARKED and _marked(attrs):
            if tag not in BLOCKS:
                self._parts.append(" ")
            self._dropped = len(self._open)
        elif tag in REGIONS:
            main = ("role", "main") in attrs
            kind = "main" if main else "teaser" if tag == "article" and _teaser(attrs) else tag
            self.parent.append(self._regions[-1])
            self._regions.append(len(self.kind))
            self.kind.append(kind)
            self.named.append(bool(attrs))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in DROPPED | {"svg"}:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if not self._dropped:
            self._met += 1
            if tag in BLOCKS:
                self._flush()
        if tag in VOID or not self._count[tag]:
            return
        while self._open[-1] != tag:
            self._pop()
        self._pop()

    def handle_data(self, data: str) -> None:
        if self._dropped and self._open[-1] == "head" and data.strip():  # text ends a head without an end tag
            self._pop()
        if not self._dropped:
            self._parts.append(data)
            if self._count["a"]:
                self._linked += len(data.strip())

    def close(self) -> None:
        super().close()
        self._flush()


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; at the ends the weights of what is there sum to one."""
    reach = int(3 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    total = np.convolve(ratios, kernel)[reach : reach + len(ratios)]
    return total / np.convolve(np.ones(len(ratios)), kernel)[reach : reach + len(ratios)]


def clusters(chars: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """Which lines stand in clusters of a high text-to-tag ratio."""
    ratio = smoothed(chars / np.maximum(tags, 1))
    return ratio >= min(ratio.std(), ratio.mean())  # where lines are much alike, all of them


class Page:
    """Lines and containers of one page in arrays. Sums over containers hold what is inside them; containers come after those around them."""

    def __init__(self, p: Lines):
        self.chars = np.array([len(t) for t in p.text])
        self.tags, self.links, self.heading, self.region = np.array(p.tags), np.array(p.links), np.array(p.heading), np.array(p.region)
        self.kind, self.parent, self.named = p.kind, p.parent, p.named

    def inside(self, of: set[int]) -> np.ndarray:
        """Which lines stand in the given containers."""
        held = np.zeros(len(self.kind) + 1, bool)  # the last one: no container
        for r, above in enumerate(self.parent):
            held[r] = r in of or held[above]
        return held[self.region]

    def sums(self, values: np.ndarray) -> list[int]:
        """Of the values of the lines in each container; the last one is the whole page's sum."""
        out = np.bincount(self.region % (len(self.kind) + 1), values, len(self.kind) + 1).astype(int).tolist()
        for r in range(len(self.kind) - 1, -1, -1):
            out[self.parent[r]] += out[r]
        return out

    def outermost(self, kind: str, lines: np.ndarray) -> list[int]:
        """The containers of a kind with some of the lines, without those inside others of that kind."""
        some = self.sums(lines)
        under = [False] * (len(self.kind) + 1)
        out = []
        for r, above in enumerate(self.parent):
            under[r] = under[above] or self.kind[r] == kind
            if under[r] and not under[above] and some[r]:
                out.append(r)
        return out

    def doubtful(self) -> np.ndarray:
        """Lines of forms and headers, but for forms with most of the clusters' text, and for the one title of an article in its header."""
        asked = {r for r, kind in enumerate(self.kind) if kind in DOUBTFUL}
        if not asked:
            return np.zeros(len(self.chars), bool)
        weight = self.sums(self.chars * clusters(self.chars, self.tags))
        asked -= {r for r in asked if 2 * weight[r] > weight[-1]}
        out = self.inside(asked)
        under = [False] * (len(self.kind) + 1)  # in an article or main
        for r, above in enumerate(self.parent):
            under[r] = under[above] or self.kind[r] in ("article", "main", "teaser")
        titles = out & self.heading & np.array(under)[self.region]
        if titles.any() and not (self.heading & ~out & np.array(under)[self.region]).any():
            out &= ~titles
        return out

    def chosen(self) -> np.ndarray:
        """Which lines are content."""
        everything = ~self.doubtful()
        mains = self.outermost("main", everything)
        scope = everything & self.inside(set(mains)) if mains else everything
        dense = np.zeros(len(scope), bool)
        if scope.any():
            dense[scope] = clusters(self.chars[scope], self.tags[scope])
        if not dense.any():
            return dense
        teasers = self.inside(set(self.outermost("teaser", scope)))
        weight = self.chars * dense
        if not self.outermost("article", scope) and 2 * weight[teasers & scope].sum() > weight.sum():  # nothing else has as much
            teasers = np.zeros(len(scope), bool)
        own = scope & ~teasers
        menus = self.menus(dense, own)
        if (articles := self.articles(dense, own)) is not None:
            out = articles & own & ~menus
            if mains and not (out & self.heading).any():
                first = int(out.argmax())
                out[:first] |= (self.heading & own)[:first]
        else:
            out = self.around(dense & own, own) & ~menus
        return out & ~self.sparse(out)

    def sparse(self, chosen: np.ndarray) -> np.ndarray:
        """Lines of containers within the region that are no clusters by themselves: little text for their tags, and a small part of it.

        The threshold is that of the region's own lines. Containers with an h1 or without attributes stay.
        """
        out = np.zeros(len(chosen), bool)
        if chosen.sum() < 3:
            return out
        ratio = self.chars[chosen] / np.maximum(self.tags[chosen], 1)
        least = min(ratio.std(), ratio.mean())
        size, tags, headed, lines = self.sums(self.chars * chosen), self.sums(self.tags * chosen), self.sums(self.heading & chosen), self.sums(chosen)
        few = {r for r in range(len(self.kind)) if lines[r] and not headed[r] and self.named[r] and self.kind[r] in ("div", "section") and size[r] < least * max(tags[r], 1) and size[r] < SPARSE * size[-1]}
        return self.inside(few) & chosen

    def menus(self, dense: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Lines in containers without any cluster that are mostly links."""
        some, size, links = self.sums(dense & own), self.sums(self.chars * own), self.sums(self.links * own)
        return self.inside({r for r in range(len(self.kind)) if not some[r] and 2 * links[r] > size[r]})

    def articles(self, dense: np.ndarray, own: np.ndarray) -> np.ndarray | None:
        """The lines of the articles that are content, None if articles don't decide."""
        found = self.outermost("article", own)
        if not found:
            found = self.outermost("teaser", own)
        headed = self.sums(self.heading & own)
        weight, size = self.sums(self.chars * dense * own), self.sums(self.chars * own)
        with_h1 = {r for r in found if headed[r]}
        of = with_h1 or {r for r in found if 2 * weight[r] > size[r]} or {r for r in found if weight[r]}
        theirs = sum(weight[r] for r in of)
        inside = self.inside(of)
        rivals = [weight[r] for r in set(self.region[self.heading & own & ~inside].tolist())]  # what other h1 stand over
        return inside if of and (2 * theirs > weight[-1] or with_h1 and theirs >= max(rivals, default=0)) else None

    def around(self, dense: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The region that holds nearly all text of the clusters, and what goes with it beside it."""
        if not dense.any():
            return own
        weight, size, links, headed = self.sums(self.chars * dense), self.sums(self.chars * own), self.sums(self.links * own), self.sums(self.heading & own)
        deepest = max((r for r in range(len(self.kind)) if weight[r] >= NEARLY_ALL * weight[-1]), default=-1)  # they are nested
        path = {-1}
        while deepest >= 0:
            path.add(deepest)
            deepest = self.parent[deepest]
        inner = max(path)
        at = np.flatnonzero(dense)
        between = (np.arange(len(own)) > at[0]) & (np.arange(len(own)) < at[-1])
        amid, lines = self.sums(between & own), self.sums(own)
        held = [False] * (len(self.kind) + 1)
        for r, above in enumerate(self.parent):
            if r in path:
                held[r] = r == inner
            elif above in path and (above != inner or above == -1):  # beside the region, or beside what is around it
                held[r] = 2 * links[r] <= size[r] and (2 * weight[r] > size[r] or headed[r] > 0 or amid[r] == lines[r])
            else:
                held[r] = above == inner or held[above]
        own_lines = np.isin(self.region, list(path if inner == -1 else path - {inner}))  # of the containers around the region
        return own & (np.array(held)[self.region] | own_lines & (dense | (2 * self.links <= self.chars)))


def content(p: Lines) -> list[str]:
    """The texts of the lines in the regions that the clusters of high text-to-tag ratio select."""
    return [p.text[k] for k in np.flatnonzero(Page(p).chosen())] if p.text else []


def extract(html: str | None) -> str:
    """The main text of one page."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(guarded(html))
    parser.close()
    return "\n\n".join(content(parser))


def main_text(pages: DataFrame, keep: list[str], html_col: str = "html") -> DataFrame:
    """The columns ``keep`` with ``text``, the main text."""
    own = free_names([*keep, "text"], "__html")[0]
    kept = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(html_col).cast("string").alias(own))
    schema = kept.drop(own).schema.add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = pa.array([extract(h) for h in batch.column(batch.num_columns - 1).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], names=[*batch.schema.names[:-1], "text"])

    return kept.mapInArrow(run, schema)


def report(pages: DataFrame) -> DataFrame:
    return main_text(pages, ["page_id", "url"]).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
