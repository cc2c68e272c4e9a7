"""Main text of web pages by composite text density.

A page is parsed into a tree (unclosed and misnested tags are closed as browsers
do; scripts, styles and other raw elements have no text).  Elements that show themselves
as other than the article by element, role or being hidden are cut; so are those whose
class or id is wholly made of such names, unless they are headings or sections named
by a topic.  But for <nav>, <footer> and names of comments, an element, role or name cuts
nothing that holds most of the page's text outside links and every <article>, <main>
and <h1>.  Of what is
left, each node has C characters and T tags, of these LC and LT in links; its
composite density (Sun, Song and Liao, 2011) is

    C/T * log(C/LC * T/LT) / log(ln(C/(C - LC) * LC + LCb/Cb * C + e))

with b the body and zeros as ones.  The node with the largest sum of the densities of
its children that are blocks is the core, and all of it is content.  The least density
on the path from the core to the body is the threshold: off that path, subtrees that
reach it belong to the content too.  Where two thirds of the text of a node of the path
below the body reach it, the node's other children do as well, if most of their text is
outside links: so headings and short paragraphs beside the core stay.

Text: character references are decoded, white space in a block is one space,
blocks are trimmed and joined by one space in page order; nothing else is
dropped, nothing is cut off.

Cases: null, empty and text-free html give an empty text; html without tags is
all text; a page whose every part is cut gives an empty text; nesting of any depth
is walked without recursion; rows that repeat an id are extracted one by one; an
empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import html as references
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*+(?:=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": (), "tbody": ("thead", "tbody", "tr", "td", "th")}
SCOPES = frozenset("html body article main section div table ul ol dl td th blockquote aside nav footer header form".split())
# Elements, roles and names that aren't the article.
CUT_TAGS = frozenset("nav footer button select dialog menu svg canvas object audio video map datalist head".split())
#: Elements that may hold the whole page all the same.
CUT_WRAPPERS = frozenset("aside form header".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
CUT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices "
    "comment comments commentlist respond replies disqus discussion sidebar sidebars menu navbar nav navigation breadcrumb breadcrumbs share sharing social related recommended "
    "newsletter subscribe subscription popup modal overlay footer masthead pagination pager widget widgets login signup search toolbar paywall".split()
)
#: Words that only say where or in what form a thing of CUT_NAMES stands: "ad-slot-2" is cut, "related-work" isn't.
FORM_NAMES = frozenset("area bar block body bottom box btn button buttons container count form group header icons inner item items left link links list mobile module outer panel post posts right section site slot stories title top unit wrap wrapper".split())
#: Of CUT_NAMES, those that sections of an article bear as their topic, and those that may well outweigh the article.
TOPICS = frozenset("advert adverts advertisement advertising sponsor sponsors promotion banner cookie cookies consent gdpr notice notices replies discussion menu navigation breadcrumbs share sharing social related recommended newsletter subscription search".split())
COMMENTS = frozenset("comment comments commentlist respond replies disqus discussion".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
KEEP = frozenset(("html", "body", "main"))


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(raw)} if raw and not raw.isspace() else {}


def is_cut(tag: str, attrs: dict[str, str]) -> bool:
    """Whether an element is never text, or hidden."""
    if tag in KEEP:
        return False
    if tag in CUT_TAGS:
        return True
    return bool(attrs) and ("hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", ""), re.I) is not None)


def cut_names(tag: str, attrs: dict[str, str], inside_article: bool) -> set[str]:
    """What names an element as something else than the article: itself, its role, the words of class and id.  Every word of such a name must do so or be of FORM_NAMES."""
    found: set[str] = set()
    if tag in KEEP:
        return found
    if tag in CUT_WRAPPERS and (tag != "header" or not inside_article):
        found.add(f"<{tag}>")
    if attrs.get("role", "").lower() in CUT_ROLES:
        found.add("role")
    if not attrs or tag in HEADINGS:
        return found
    able = CUT_NAMES - TOPICS if tag == "section" else CUT_NAMES if inside_article else CUT_NAMES | {"header"}
    for name in (attrs.get("class", "") + " " + attrs.get("id", "")).lower().split():
        if name in able:
            found.add(name)
        elif tag != "article":
            parts = {p for p in re.split(r"[^a-z0-9]+", name) if p and not p.isdigit()}
            if parts <= able | FORM_NAMES:
                found |= parts & able
    return found


class Page:
    """A parsed page: nodes in page order, and pieces of text with their nodes."""

    def __init__(self, source: str):
        self.tag, self.parent, self.cut = ["#root"], [-1], [False]
        self.named: dict[int, set[str]] = {}
        self.pieces: list[tuple[int, str]] = []
        stack, at, end = [0], 0, len(source)
        articles = 0
        while at < end:
            m = TAG.search(source, at)
            stop = m.start() if m else end
            if stop > at:
                self.pieces.append((stack[-1], source[at:stop]))
            if not m:
                break
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            name = name.lower()
            if m[1] or m[4]:
                if name == "br":
                    self.pieces.append((stack[-1], " "))
                for i in range(len(stack) - 1, 0, -1):
                    open_tag = self.tag[stack[i]]
                    if open_tag == name:
                        articles -= sum(self.tag[n] == "article" for n in stack[i:])
                        del stack[i:]
                        break
                    if name in INLINE and open_tag not in INLINE or name == "p" and open_tag in SCOPES:
                        break
                if name not in INLINE:
                    self.pieces.append((stack[-1], " "))
                continue
            if name in CLOSES_P:
                self._close(stack, ("p",))
            if name in SAME_CLOSES:
                self._close(stack, SAME_CLOSES[name])
            node = len(self.tag)
            self.tag.append(name)
            self.parent.append(stack[-1])
            attrs = attributes(m[3] or m[6] or "")
            self.cut.append(self.cut[stack[-1]] or is_cut(name, attrs))
            if not self.cut[node] and (names := cut_names(name, attrs, articles > 0)):
                self.named[node] = names
            if name not in INLINE:
                self.pieces.append((stack[-1], " "))
            if name in RAW:
                self.cut[node] = True
                close = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(source, at)
                at = close.start() if close else end
                stack.append(node)
            elif name not in VOID:
                stack.append(node)
                articles += name == "article"
        if self.named:
            self._cut_named()

    def _cut_named(self) -> None:
        """Cuts what has the name of something else; not what has most of the text outside links and all articles, unless by the name of comments."""
        n = len(self.tag)
        chars, articles = [0] * n, [0] * n
        in_link = self._in_links()
        for node, text in self.pieces:
            if not self.cut[node] and not in_link[node]:
                chars[node] += sum(map(len, text.split()))
        for i in range(n - 1, 0, -1):
            articles[i] += chars[i] > 0 and self.tag[i] in ("article", "main", "h1")
            chars[self.parent[i]] += chars[i]
            articles[self.parent[i]] += articles[i]
        for i in range(1, n):
            names = self.named.get(i, ())
            wrapper = 2 * chars[i] > chars[0] and articles[i] == articles[0] and COMMENTS.isdisjoint(names)
            self.cut[i] = self.cut[i] or self.cut[self.parent[i]] or bool(names) and not wrapper

    def _in_links(self) -> list[bool]:
        out = [False] * len(self.tag)
        for i in range(1, len(out)):
            out[i] = out[self.parent[i]] or self.tag[i] == "a"
        return out

    def _close(self, stack: list[int], names: tuple[str, ...]) -> None:
        """Closes open elements of these names, up to the nearest scope."""
        for i in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[i]]
            if tag in names:
                del stack[i:]
                return
            if tag in SCOPES:
                return

    def densities(self) -> tuple[list[float], list[float], list[int], list[int]]:
        """Of every node: composite density, the sum of its block children's, characters, and those in links."""
        n = len(self.tag)
        chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        in_link = self._in_links()
        for node, text in self.pieces:
            if not self.cut[node]:
                size = sum(map(len, text.split()))
                chars[node] += size
                link_chars[node] += size * in_link[node]
        for i in range(n - 1, 0, -1):
            if not self.cut[i]:
                p = self.parent[i]
                chars[p] += chars[i]
                link_chars[p] += link_chars[i]
                tags[p] += tags[i] + 1
                link_tags[p] += link_tags[i] + (self.tag[i] == "a")
        body = self.tag.index("body") if "body" in self.tag else 0
        share = link_chars[body] / max(1, chars[body])
        own, sums = [0.0] * n, [0.0] * n
        for i in range(n - 1, -1, -1):
            c, t, lc, lt = chars[i], max(1, tags[i]), link_chars[i], max(1, link_tags[i])
            if c and not self.cut[i]:
                base = math.log(math.log(c / max(1, c - lc) * lc + share * c + math.e))
                top = math.log(max(1.0, c / max(1, lc) * t / lt))
                # a base of e has the logarithm 1, any larger one more
                own[i] = c / t * top / max(1e-3, base) if base > 0 else c / t * top
                if i and self.tag[i] not in INLINE:
                    sums[self.parent[i]] += own[i]
        return own, sums, chars, link_chars

    def content(self) -> list[bool]:
        """Whether each node is of the main text."""
        n = len(self.tag)
        own, sums, chars, link_chars = self.densities()
        body = self.tag.index("body") if "body" in self.tag else 0
        core = max(range(n), key=lambda i: (sums[i] or own[i] * 1e-9, -i))
        path, i = [], core
        while i >= 0:
            path.append(i)
            if i == body:
                break
            i = self.parent[i]
        least = min(own[i] for i in path)
        beside: dict[int, list[int]] = {i: [] for i in path}
        on_path = set(path)
        for i in range(1, n):
            if self.parent[i] in on_path and i not in on_path and not self.cut[i]:
                beside[self.parent[i]].append(i)
        inside = [False] * n
        inside[core] = True
        reached = chars[core]
        for i in path[1:]:
            good = [c for c in beside[i] if own[c] >= least > 0]
            reached += sum(chars[c] for c in good)
            if i != body and 3 * reached >= 2 * chars[i]:
                good += [c for c in beside[i] if 2 * link_chars[c] <= chars[c]]
                inside[i] = True  # its own text, not what is beside the path
            for c in good:
                inside[c] = True
        whole = [core == 0 and not self.cut[0]] + [False] * (n - 1)
        for i in range(1, n):
            p = self.parent[i]
            whole[i] = not self.cut[i] and (whole[p] or inside[i] and (i == core or i not in on_path))
        inside[0] = inside[0] or core == body  # text beside the body
        return [w or inside[i] and not self.cut[i] for i, w in enumerate(whole)]

    def text(self) -> str:
        inside = self.content()
        parts = [references.unescape(text) if "&" in text else text for node, text in self.pieces if inside[node] or text == " "]
        return " ".join("".join(parts).split())


def main_text(source: str | None) -> str:
    return Page(source).text() if source else ""


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text, n_chars; a narrow map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return own.mapInArrow(run, "page_id long, url string, text string, n_chars long")
