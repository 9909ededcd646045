"""Main text of web pages by composite text density.

The page becomes a tree.  Subtrees that are no article text whatever their density (scripts, styles, menus, headers, footers, sidebars,
notices, adverts, forms, reader comments) are set aside.  An element that only its class or id sets aside must be named so as a whole
(sidebar, cookie-notice; not has-comments or widget-content), and it stays if it holds the main element, all articles of the page or, on a page without
an article, most of its text; reader comments then stay only if they hold all of it.

Density decides among what is left.  The composite density of a block relates its characters to its tags and corrects for link text;
marks inside a line (bold, links, breaks) belong to the block around them.  A block's density sum adds up the densities of its child blocks
and of its own text; the block with the greatest sum leads.  From there the path to the body is climbed while density holds: a
block around the lead joins as long as it keeps CLIMB of the lead's density, so headings and short paragraphs come along and
link lists do not.  The least density on the path is the threshold: any other block that reaches it gives its own block of greatest
sum, and own text of path blocks that reaches it stays too.  An article or main element around the lead ends the path there instead of
at the body; it chooses nothing.

What has been taken is judged once more, block by block, against the subtree it stands in.  Names are evidence there, no verdict: a block whose
class or id holds a word of side matter among others (user-comments, ad-box, share-buttons) counts NAME_SHIFT of its density, in the search for the lead as well, and goes
if that is below CLIMB of the densest plain block; a block made of links goes if its density is below CLIMB of the subtree's.  Blocks around the lead are not judged,
so what such a block holds stays where it is the article.

Text leaves in blocks: white space inside a block becomes one space, blocks are joined by newlines.

Defined cases: a null or empty page, or one without text, gives the empty text; markup that is cut off or badly nested is
read as far as it goes; trees of any depth are handled without recursion; repeated rows are extracted each; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from math import e, log

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm.common import read_table, small_batches

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
#: Elements that are never article text.
ASIDE_TAGS = frozenset(
    "script style noscript template iframe object embed applet canvas svg audio video map head title nav footer aside form button select textarea input "
    "option datalist dialog menu noembed noframes".split()
)
#: A class or id made up of such words only says the same, and roles.
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising advertisment adsense sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices "
    "popup modal overlay menu nav navbar navigation breadcrumb breadcrumbs sidebar masthead footer comment comments disqus reply replies respond social share sharing "
    "related recommended recommendations widget widgets newsletter subscribe subscription signup login toolbar pagination pager skip".split()
)
COMMENT_WORDS = frozenset("comment comments disqus reply replies respond".split())
#: What an article element of a reader is called.
COMMENT_NAMES = frozenset("comment comments comment-body comment-item comment-content comment-entry comment-wrapper".split())
ASIDE_NAMES = frozenset("header site-header page-header top-header siteheader pageheader".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
KEPT_TAGS = frozenset("html body main h1 h2 h3 h4 h5 h6".split())
#: A start tag of the key closes an open element of the values, unless one of the stops lies between.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead", "tr", "td", "th"), "thead": ("tbody", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th")}
STOPS = frozenset("ul ol dl table select article section div body main aside nav".split())
CLOSES_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body", "legend"}

_MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*'|["'])*?)(?:>|\Z)""", re.S
)
#: Share of the lead's density that a block around it must keep to join.
CLIMB = 0.5
#: What the density of a block counts that is named after side matter among other words, and prefixes that deny such a name.
NAME_SHIFT, DENIALS = 0.1, ("no-", "has-", "with-", "without-", "hide-", "is-")
#: What sets an element aside: nothing, its name, its name as that of reader comments, or itself.
NOT_ASIDE, NAMED, COMMENTS, ASIDE = range(4)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Page:
    """A parsed page: nodes in document order with their parents, and pieces of text."""

    def __init__(self, html: str):
        self.tag, self.parent, self.aside, self.named = ["#root"], [-1], [False], [NOT_ASIDE]
        self.hinted: dict[int, bool] = {}  # elements with a word of side matter in their names; whether it is one of reader comments
        self.texts: list[tuple[int, int, str]] = []  # node, block, text
        self._stack, self._block, self._open = [0], 0, Counter()
        at = 0
        size = len(html)
        while at < size:
            m = _MARKUP.search(html, at)
            if m is None:
                self._text(html[at:])
                break
            if m.start() > at:
                self._text(html[at : m.start()])
            at = m.end()
            name = m[2]
            if name is None:
                continue
            name = name.lower()
            if m[1]:
                self._end(name)
                continue
            if at == size and not html.endswith(">"):
                break  # the page is cut off inside a tag
            self._start(name, m[3])
            if name in RAW:
                close = re.compile(f"</{name}(?=[\\s/>]|\\Z)", re.I).search(html, at)
                self._text(html[at : close.start() if close else size])
                at = close.start() if close else size
        if any(self.named):
            self._set_aside_by_name()

    def _text(self, text: str) -> None:
        self.texts.append((self._stack[-1], self._block, text))

    def _pop_to(self, place: int) -> None:
        closed = [self.tag[n] for n in self._stack[place:]]
        if any(tag in BLOCK for tag in closed):
            self._block += 1
        self._open.subtract(closed)
        del self._stack[place:]

    def _start(self, name: str, attributes: str) -> None:
        if name == "br":
            self.texts.append((self._stack[-1], self._block, " "))
        if name in CLOSES_P and self._open["p"]:
            for place in range(len(self._stack) - 1, 0, -1):
                tag = self.tag[self._stack[place]]
                if tag == "p":
                    self._pop_to(place)
                    break
                if tag in STOPS or tag in ("td", "th", "li", "dd", "button", "blockquote"):
                    break
        if name in CLOSES and any(self._open[tag] for tag in CLOSES[name]):
            for place in range(len(self._stack) - 1, 0, -1):
                tag = self.tag[self._stack[place]]
                if tag in CLOSES[name]:
                    self._pop_to(place)
                    if name in ("li", "dt", "dd", "option", "td", "th"):
                        break
                elif tag in STOPS:
                    break
        if name in BLOCK:
            self._block += 1
        above = self._stack[-1]
        self.tag.append(name)
        self.parent.append(above)
        kind = self._kind(name, attributes)
        self.aside.append(self.aside[above] or kind == ASIDE)
        self.named.append(kind if kind != ASIDE else NOT_ASIDE)
        if name not in VOID and not (attributes.endswith("/") and name not in BLOCK and name not in RAW and name not in ("a", "b", "i", "span", "em", "strong")):
            self._stack.append(len(self.tag) - 1)
            self._open[name] += 1

    def _end(self, name: str) -> None:
        if not self._open[name]:
            return
        for place in range(len(self._stack) - 1, 0, -1):
            tag = self.tag[self._stack[place]]
            if tag == name:
                self._pop_to(place)
                return
            if name not in BLOCK and tag in STOPS:
                return

    def _kind(self, name: str, attributes: str) -> int:
        if name in ASIDE_TAGS:
            return ASIDE
        inside = self._open["article"] + self._open["main"] > 0
        if name == "header" and not inside:
            return ASIDE
        if not attributes or name in KEPT_TAGS:
            return NOT_ASIDE
        found, hint = NOT_ASIDE, set()
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), unescape((m[2] or "").strip("\"'"))
            if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                return ASIDE
            if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return ASIDE
            if key == "role" and value.lower() in ASIDE_ROLES:
                return ASIDE
            if key in ("class", "id"):
                for part in value.split():
                    words = {w.lower() for w in _WORDS.findall(part)}
                    if not part.lower().startswith(DENIALS):
                        hint |= words & ASIDE_WORDS
                    if name == "article":
                        if part.lower() in COMMENT_NAMES:
                            found = COMMENTS
                    elif words and words <= ASIDE_WORDS:
                        found = max(found, COMMENTS if words & COMMENT_WORDS else NAMED)
                    if not inside and part.lower() in ASIDE_NAMES:
                        found = max(found, NAMED)
        if hint:
            self.hinted[len(self.tag) - 1] = not hint.isdisjoint(COMMENT_WORDS)
        return found

    def _set_aside_by_name(self) -> None:
        """Sets aside what is named so, unless the page would lose its article by it."""
        n, parent, tag, named = len(self.tag), self.parent, self.tag, self.named
        chars, mains, articles, below = [0] * n, [0] * n, [0] * n, [False] * n
        for node, _, text in self.texts:
            if not self.aside[node]:
                chars[node] += len(text.strip())
        for i in range(n - 1, 0, -1):
            if not self.aside[i]:
                if chars[i] and not named[i]:
                    mains[i] += tag[i] == "main"
                    articles[i] += tag[i] == "article"
                for of in (chars, mains, articles):
                    of[parent[i]] += of[i]
        article_outside = False
        for i in range(1, n):
            below[i] = below[parent[i]] or named[i] != NOT_ASIDE
            article_outside |= not below[i] and not self.aside[i] and chars[i] > 0 and tag[i] in ("article", "main")
        for i in range(1, n):
            if named[i] and not self.aside[i]:
                much = chars[i] == chars[0] if named[i] == COMMENTS else 2 * chars[i] > chars[0]
                self.aside[i] = not (mains[i] or not article_outside and (articles[i] or much))
            self.aside[i] |= self.aside[parent[i]]

    def main_text(self) -> str:
        chosen = self._chosen()
        blocks: list[list[str]] = []
        last = None
        for node, block, text in self.texts:
            if chosen[node]:
                if block != last:
                    blocks.append([])
                    last = block
                blocks[-1].append(text)
        lines = (" ".join("".join(map(unescape, b)).split()) for b in blocks)
        return "\n".join(line for line in lines if line)

    def _chosen(self) -> list[bool]:
        """Whether each node's own text belongs to the article."""
        n, parent, tag, aside = len(self.tag), self.parent, self.tag, self.aside
        block = [0] * n  # the block that holds each node, itself if it is one
        above = [0] * n  # the block around it
        in_link, whole, own = [False] * n, [Amounts() for _ in range(n)], [Amounts() for _ in range(n)]
        for i in range(1, n):
            above[i] = block[parent[i]]
            block[i] = i if tag[i] in BLOCK else above[i]
            in_link[i] = tag[i] == "a" or in_link[parent[i]]
            if not aside[i]:
                whole[parent[i]].tag(tag[i])
                if block[i] != i:
                    own[block[i]].tag(tag[i])
        for node, _, text in self.texts:
            if not aside[node]:
                size = len(text.strip())
                whole[node].text(size, in_link[node])
                own[block[node]].text(size, in_link[node])
        for i in range(n - 1, 0, -1):
            if not aside[i]:
                whole[parent[i]].add(whole[i])
        body = next((i for i in range(n) if tag[i] == "body" and whole[i].chars), 0)
        if not whole[0].chars:
            return [False] * n
        ratio = whole[body].links / whole[body].chars
        density, alone = [0.0] * n, [0.0] * n
        for i in range(n):
            if not aside[i] and block[i] == i:
                density[i], alone[i] = whole[i].density(ratio), own[i].density(ratio)
        # what holds most of the text, or all of it if its name is one of comments, is not side matter
        hinted = {i for i, comments in self.hinted.items() if whole[i].chars * (1 if comments else 2) <= whole[0].chars - comments}
        weigh = [1.0] * n
        for i in range(1, n) if hinted else ():
            weigh[i] = NAME_SHIFT if i in hinted else weigh[parent[i]]
        total, best = [a * w for a, w in zip(alone, weigh)], list(range(n))
        for i in range(n - 1, 0, -1):
            total[above[i]] += density[i] * weigh[i]
        for i in range(n - 1, 0, -1):
            if block[i] == i and not aside[i] and total[best[i]] > total[best[above[i]]]:
                best[above[i]] = best[i]
        lead = best[0]
        path, i = [lead], lead
        top = next((k for k in self._ancestors(lead)[::-1] if tag[k] in ("article", "main")), 0)
        while i != top:
            i = above[i]
            path.append(i)
        joined = next((k for k, i in enumerate(path) if density[i] < CLIMB * density[lead]), len(path)) - 1
        threshold = min(density[i] for i in path)
        taken, lines = [False] * n, [False] * n  # whole subtrees, and own text only
        taken[path[joined]] = True
        for i in path[joined + 1 :]:
            lines[i] = alone[i] >= threshold
        along, inside = set(path), [False] * n
        for i in range(n):
            inside[i] = i == top or i > 0 and inside[parent[i]]
            if inside[i] and i not in along and density[i] >= threshold and whole[i].chars:
                taken[best[i]] = True
        around_lead = {0, *self._ancestors(lead)}
        plain = [True] * n  # whether no name below the path speaks against a block
        for i in range(1, n) if hinted else ():
            plain[i] = i in around_lead or plain[parent[i]] and i not in hinted
        densest = max((density[i] for i in range(n) if plain[i] and inside[i] and i not in along), default=0.0)
        densest, usual = CLIMB * max(densest, density[path[joined]]), CLIMB * density[path[joined]]
        chosen, gone = [False] * n, [False] * n
        for i in range(n):
            gone[i] = i > 0 and gone[parent[i]]
            if block[i] == i and i not in around_lead and whole[i].chars and not gone[i]:
                if i in hinted:
                    gone[i] = NAME_SHIFT * density[i] < densest
                else:
                    gone[i] = whole[i].link_tags > 1 and 2 * whole[i].links > whole[i].chars and density[i] < usual
            taken[i] = not aside[i] and not gone[i] and (taken[i] or i > 0 and taken[parent[i]])
            chosen[i] = not aside[i] and (taken[i] or lines[block[i]])
        return chosen

    def _ancestors(self, node: int) -> list[int]:
        """node and the nodes around it, from within."""
        found = []
        while node > 0:
            found.append(node)
            node = self.parent[node]
        return found


class Amounts:
    """Characters and tags of some text, and how many of them are links."""

    __slots__ = ("chars", "tags", "links", "link_tags")

    def __init__(self):
        self.chars = self.tags = self.links = self.link_tags = 0

    def text(self, chars: int, linked: bool) -> None:
        self.chars += chars
        self.links += chars if linked else 0

    def tag(self, name: str) -> None:
        self.tags += 1
        self.link_tags += name == "a"

    def add(self, other: Amounts) -> None:
        self.chars += other.chars
        self.tags += other.tags
        self.links += other.links
        self.link_tags += other.link_tags

    def density(self, body_ratio: float) -> float:
        return composite_density(self.chars, self.tags, self.links, self.link_tags, body_ratio)


def composite_density(chars: int, tags: int, link_chars: int, link_tags: int, body_ratio: float) -> float:
    """Characters for each tag, made smaller by links: C/T log_b((C/LC)(T/LT)), b = ln(C LC/(C - LC) + C LCb/Cb + e); a zero count stands as 1."""
    if not chars:
        return 0.0
    tags, plain = tags or 1, max(1, chars - link_chars)
    base = log(chars / plain * link_chars + body_ratio * chars + e)
    share = log(max(1.0, chars / (link_chars or 1) * tags / (link_tags or 1)))
    return chars / tags * share / max(log(base), 1e-3)


def main_text(html: str | None) -> str:
    return Page(html).main_text() if html else ""


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row."""

    def extracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(h) for h in batch["html"]]
            yield pd.DataFrame({
                "page_id": batch["page_id"].astype("Int64"), "url": batch["url"].astype(object), "text": pd.Series(texts, dtype=object),
                "n_chars": [len(t) for t in texts]
            })

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    return rows.mapInPandas(extracted, "page_id long, url string, text string, n_chars long")


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return extract_pages(read_table(spark, sf_dir, "pages"))
