"""Main text of web pages by the paths that a host's pages agree on.

A page's containers are scored by their own text (not in links, not in boilerplate), and the deepest one that holds most of
it is the page's vote, as a path of tags and classes with digits generalised. Votes are summed for each host; then every page
is extracted again with its host's winning path, unless the page doesn't have it or has far more text elsewhere. The text
is that of the whole article around the container found.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: A container is preferred to the one around it if it holds this share of that one's score.
DEEPER = 0.6
#: A host's path is used if it holds this share of the page's own best score.
AGREES = 0.5

#: Characters of a path beyond which its upper part is replaced by a digest (nesting can be very deep).
LONG_PATH = 400

# HTML element names by role.
RAW = {"script", "style", "template", "noscript", "iframe", "textarea", "title", "svg", "object", "select", "canvas", "audio", "video", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "button"}
CONTAINER = {"article", "body", "center", "div", "main", "section", "table", "tbody", "td", "tr", "html"}
DROPPED = {"aside", "button", "dialog", "fieldset", "footer", "form", "head", "header", "menu", "nav", "search"}
#: Elements whose class, id and role are judged: those that hold blocks, not blocks themselves.
JUDGED = CONTAINER | {"ul", "ol", "dl", "details", "figure", "search"}
#: What an open element of the first kind is ended by.
ENDS = {"p": BLOCK - {"button"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "head": {"body"}}

# Words of class, id and role attributes that mark what isn't the article.
BOILER = re.compile(
    r"(?:^|[\s_-])(?:ads?(?:slot|box|unit|sense|banner|wrap\w*|container)?|advert\w*|alert|alertdialog|banner\w*|breadcrumb\w*|comment\w*|complementary|consent|contact|contentinfo|cookie\w*|copyright|dialog|disclaimer|"
    r"discussions?|disqus|donate|feedback|footer\w*|gdpr|header\w*|legal|login\w*|masthead|menu\w*|modal|\w*nav|navbar|navigation|newsletter\w*|notices?|notification\w*|overlay|pager|pagination|paywall|popup\w*|promo|promotions?|"
    r"recommend\w*|related\w*|replies|reply|respond|responses|search|share|sharing|sidebar\w*|signup|skip|social\w*|sponsor\w*|subscri\w+|tags|toc|toolbar|topbar|widget\w*)(?:$|[\s_-]|\d)",
    re.I,
)
#: Layout classes that only say whether there is a sidebar or the like.
_LAYOUT = re.compile(r"(?:^|(?<=[\s_-]))(?:has|no|with|without)[-_]\w+", re.I)
_TAG = re.compile(r"<!--|<[!?]|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_NEXT = re.compile(r"""=\s*["']|>""")
_CLOSE = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
_ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?(?=\s|$|/)""", re.I)
_SPACE = re.compile(r"\s+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _marks(attrs: str) -> tuple[str, bool, bool]:
    """The generalised class part of a path, and whether the attributes hide the element or mark boilerplate."""
    found = {m[1].lower(): next((g for g in m.groups()[1:] if g is not None), "") for m in _ATTR.finditer(attrs)}
    words = " ".join(found.get(k, "") for k in ("class", "id", "role"))
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    classes = ".".join(sorted(re.sub(r"\d+", "0", c).lower() for c in found.get("class", "").split()))
    return classes, hidden, bool(words.strip() and BOILER.search(_LAYOUT.sub("", _CAMEL.sub("-", words))))


class Tags:
    """Tags of a page in order, in time linear in its length: (start, end, closing, name, attributes); no name for comments.

    A quoted value may hold a >. From the first tag on whose quote never ends, a tag ends at its first >.
    """

    def __init__(self, html: str):
        self.html, self.quotes, self.last = html, True, html.rfind(">")

    def _end(self, at: int) -> int:
        """Place behind the tag whose name ends at a place; -1 if there is none."""
        if at > self.last:
            return -1
        start = at
        while self.quotes:
            m = _NEXT.search(self.html, at)
            if m is None:
                break
            if m[0] == ">":
                return m.end()
            close = self.html.find(m[0][-1], m.end())
            if close < 0:
                break
            at = close + 1
        self.quotes = False
        return self.html.find(">", start) + 1

    def find(self, at: int) -> tuple[int, int, str, str, str] | None:
        """The first tag from a place on."""
        while m := _TAG.search(self.html, at):
            if m[0] == "<!--":
                close = self.html.find("-->", m.end())
                return m.start(), close + 3 if close >= 0 else len(self.html), "", "", ""
            if m[2] is None:
                close = self.html.find(">", m.end())
                return m.start(), close + 1 if close >= 0 else len(self.html), "", "", ""
            end = self._end(m.end())
            if end > 0:
                return m.start(), end, m[1], m[2].lower(), self.html[m.end() : end - 1]
            at = m.end()
        return None


class Page:
    """Blocks of text in page order, and the containers that hold them."""

    def __init__(self, html: str):
        self.paths: list[str] = [""]
        self.parent: list[int] = [-1]
        self.marked: list[bool] = [False]  # boilerplate by its classes; not if the page's heading or main part is in it
        self.blocks: list[tuple[int, str, int]] = []  # container, text, characters outside links
        self._parse(html)
        for c in range(1, len(self.paths)):
            self.marked[c] = self.marked[c] or self.marked[self.parent[c]]
        self.blocks = [b for b in self.blocks if not self.marked[b[0]]]

    def _parse(self, html: str) -> None:
        stack: list[tuple[str, int, bool]] = [("", 0, False)]  # tag, container, boilerplate
        text: list[str] = []
        links, at, end = 0, 0, len(html)
        opened: Counter[str] = Counter()
        tags, cleared = Tags(html), {0}
        linked = 0

        def flush() -> None:
            nonlocal linked
            if text:
                raw = "".join(text)
                if not stack[-1][2]:
                    words = _SPACE.sub(" ", entities.unescape(raw) if "&" in raw else raw).strip()
                    if words:
                        self.blocks.append((stack[-1][1], words, max(0, len(words) - linked)))
                text.clear()
                linked = 0

        while at < end:
            found = tags.find(at)
            if found is None:
                text.append(html[at:])
                break
            begin, after, closing, tag, attrs = found
            if begin > at:
                piece = html[at:begin]
                text.append(piece)
                linked += len(piece) if links else 0
            at = after
            if not tag:
                continue
            if tag in RAW:
                if not closing and not attrs.endswith("/"):
                    close = _CLOSE[tag].search(html, at)
                    at = close.end() if close else end
                continue
            if tag == "a":
                links = 0 if closing else 1
                continue
            if tag not in BLOCK:
                if tag == "br" or tag in VOID:
                    text.append(" ")
                continue
            flush()
            if closing:
                if opened[tag]:
                    while True:
                        top = stack.pop()[0]
                        opened[top] -= 1
                        if top == tag:
                            break
                continue
            while len(stack) > 1 and tag in ENDS.get(stack[-1][0], ()):
                opened[stack.pop()[0]] -= 1
            classes, hidden, boiler = _marks(attrs) if attrs else ("", False, False)
            boiler = hidden or boiler and tag in JUDGED
            _, container, inside = stack[-1]
            if tag in ("h1", "main") and not inside and not boiler:
                for _, c, _ in reversed(stack):  # what is around a cleared container is cleared
                    if c in cleared:
                        break
                    self.marked[c] = False
                    cleared.add(c)
            if tag in CONTAINER:
                above = self.paths[container]
                if len(above) > LONG_PATH:
                    above = hashlib.md5(above.encode()).hexdigest()
                self.paths.append(f"{above}/{tag}" + (f".{classes}" if classes else ""))
                self.parent.append(container)
                container = len(self.paths) - 1
                # a page is never boilerplate as a whole
                self.marked.append(boiler and tag not in ("html", "body"))
                boiler = False
            if not attrs.endswith("/"):
                # a header inside the article is the article's
                dropped = tag in DROPPED and not (tag == "header" and (opened["article"] or opened["main"]))
                stack.append((tag, container, inside or boiler or dropped))
                opened[tag] += 1
        flush()

    def best(self) -> tuple[int, float]:
        """The deepest container that holds most of the text, and its score."""
        score = [0.0] * len(self.paths)
        for c, _, n in self.blocks:
            score[c] += n
        for c in range(len(self.paths) - 1, 0, -1):  # parents come before their children
            score[self.parent[c]] += score[c]
        weight = [s * (1.5 if re.search(r"/(article|main)[^/]*$", p) else 1.0) for s, p in zip(score, self.paths)]
        children: dict[int, list[int]] = {}
        for c in range(1, len(self.paths)):
            children.setdefault(self.parent[c], []).append(c)
        at = 0
        while below := children.get(at):
            top = max(below, key=lambda c: (weight[c], -c))
            if score[top] <= 0 or weight[top] < DEEPER * score[at]:
                break
            at = top
        return at, score[at]

    def _below(self, tops: set[int]) -> list[bool]:
        inside = [False] * len(self.paths)
        for c in range(len(self.paths)):  # parents come before their children
            inside[c] = c in tops or (c > 0 and inside[self.parent[c]])
        return inside

    def _wholes(self) -> list[int]:
        """For each container the article or main part around it; without one, the widest below the body that adds only text outside links."""
        linked = [0] * len(self.paths)  # blocks that are links for more than half
        for c, t, n in self.blocks:
            linked[c] += 2 * n < len(t)
        for c in range(len(self.paths) - 1, 0, -1):
            linked[self.parent[c]] += linked[c]
        part, wide, out = [-1] * len(self.paths), list(range(len(self.paths))), [0] * len(self.paths)
        for c in range(1, len(self.paths)):  # parents come before their children
            up, tag = self.parent[c], self.paths[c].rsplit("/", 1)[-1].split(".", 1)[0]
            part[c] = c if tag in ("article", "main") else part[up]
            if up > 0 and self.paths[up].rsplit("/", 1)[-1].split(".", 1)[0] not in ("body", "html") and linked[up] == linked[c]:
                wide[c] = wide[up]
            out[c] = part[c] if part[c] >= 0 else wide[c]
        return out

    def text(self, path: str | None) -> str:
        """Blocks of the article around the path if it holds enough of the page, else around the page's own best container."""
        own, own_score = self.best()
        tops = {c for c, p in enumerate(self.paths) if p == path}
        inside = self._below(tops)
        if path is None or sum(n for c, _, n in self.blocks if inside[c]) < AGREES * own_score:
            tops = {own}
        wholes = self._wholes()
        inside = self._below({wholes[c] for c in tops})
        return "\n".join(t for c, t, _ in self.blocks if inside[c])


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths, scores = [], []
        for html in batch.column(1):
            page = Page(html.as_py() or "")
            c, score = page.best()
            paths.append(page.paths[c] if score else None)
            scores.append(int(score))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.string()), pa.array(scores, pa.int64())], names=["host", "path", "score"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [Page(html.as_py() or "").text(path.as_py()) for html, path in zip(batch.column(2), batch.column(3))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def host(url: Column) -> Column:
    """Lower-case host name; null where there is none."""
    found = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    return F.when(found != "", found)


def host_paths(pages: DataFrame) -> DataFrame:
    """host, path and n: what most of its n pages vote for (ties: more text, then the smaller path)."""
    votes = pages.where("host is not null").select("host", "html").mapInArrow(lambda it: _votes(common.trimmed(it)), "host string, path string, score long")
    summed = votes.groupBy("host", "path").agg(F.count("*").alias("votes"), F.sum("score").alias("score"))
    order = F.struct((-F.col("votes")).alias("a"), (-F.col("score")).alias("b"), F.col("path").alias("c"))
    return summed.groupBy("host").agg(F.min_by("path", F.when(F.col("path").isNotNull(), order)).alias("path"), F.sum("votes").alias("n"))


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url and the main text of each page, blocks joined by line ends.

    Null and empty pages have an empty text. Pages without a host (null or odd URLs) use their own best container.
    Repeated rows are extracted each for itself; an empty table gives no rows; other columns are ignored.
    """
    common.ship(df.sparkSession)
    pages = common.pick(df, page_id=id_col, url=url_col, html=html_col).withColumn("host", host(F.col("url")))
    paths = common.written(host_paths(pages), "host_paths")
    total = paths.agg(F.sum("n")).first()[0] or 0
    joined = common.salted_join(pages, paths, "host", total, F.xxhash64("page_id", "url"), "left")
    rows = joined.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", "path")
    return rows.mapInArrow(lambda it: _texts(common.trimmed(it)), "page_id long, url string, text string")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text (empty if none) and its length in code points."""
    return extract(common.table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
