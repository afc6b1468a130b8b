"""Main text of web pages: containers voted on by host, then extracted by the winning path.

1. Each page's containers are scored: the share of the page's plain text they
   hold, times how little of what they hold is boilerplate or link text.
2. The page votes for the tag-class paths of its containers, digits aside.
   Votes are summed by host and path in Spark; each host's best path wins.
3. Each page is extracted again from the container at its host's winning path,
   or from its own best container if it has none there.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adtally.llm.staging import ship, staged
from adtally.llm.url_trees import url_host

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*+)>"
    r"|</?[a-zA-Z][^>]*\Z"
    r"|(?P<text>[^<]+|<)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"(?P<name>[^\s=/\"'>]+)(?:\s*=\s*(?:\"(?P<a>[^\"]*)\"|'(?P<b>[^']*)'|(?P<c>[^\s\"'>]+)))?")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup; it ends at their end tag.
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
CONTAINERS = frozenset("article body center div html main section table tbody td tr".split())
#: What an opened element closes: these, unless one of the scopes lies between.
CLOSES = {
    **{tag: (frozenset(["p"]), frozenset("button table td th caption html".split())) for tag in BLOCKS - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup", "caption"}},
    "li": (frozenset(["li", "p"]), frozenset("ul ol menu dir".split())),
    "dt": (frozenset(["dt", "dd", "p"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd", "p"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th", "p"]), frozenset(["table"])),
    "td": (frozenset(["td", "th", "p"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th", "p"]), frozenset(["tr", "table"])),
    "tbody": (frozenset(["tr", "td", "th", "tbody", "thead", "tfoot", "p"]), frozenset(["table"])),
    "thead": (frozenset(["tr", "td", "th", "tbody", "thead", "tfoot", "p"]), frozenset(["table"])),
    "tfoot": (frozenset(["tr", "td", "th", "tbody", "thead", "tfoot", "p"]), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BOILERPLATE_TAGS = frozenset(
    "nav footer aside form button select input label fieldset menu head script style noscript template textarea title iframe svg canvas "
    "object audio video dialog noembed noframes header".split()
)
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar alert dialog alertdialog form toolbar".split())
#: Parts of class and id names that mark boilerplate, unless the element holds the page's article.
BOILERPLATE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner banners menu menus nav navbar navigation "
    "breadcrumb breadcrumbs sidebar sidebars aside footer header masthead topbar toolbar widget widgets cookie cookies consent gdpr notice notices "
    "alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment "
    "comments commentlist disqus respond replies reply pagination pager copyright disclaimer skip search tags".split()
)
#: Other words for reader comments; they mark article elements as well.
COMMENT_NAMES = frozenset(
    "comment comments commentlist commentary disqus respond replies reply kommentar kommentare leserkommentare commentaire commentaires comentario comentarios".split()
)
#: Whole names that mark running text (paragraphs, quotes, headings) inside an article.
TEXT_NAMES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies newsletter subscribe signup login".split()) | COMMENT_NAMES
TEXT_TAGS = frozenset("p blockquote pre h1 h2 h3 h4 h5 h6 li dd dt td th figure figcaption span em strong b i a code".split())
HIDDEN_STYLE = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.IGNORECASE)
#: Steps of a path that are written out; longer paths begin with a digest of what stands above.
WRITTEN_STEPS = 24
NAME_PARTS = re.compile(r"[A-Za-z][a-z]+|[A-Z]+(?![a-z])|[a-z]+")


class Node:
    """An element: its path among its ancestors, and plain, boilerplate and link characters below it."""

    __slots__ = ("tag", "parent", "step", "digest", "noise", "marked", "region", "story", "keeps", "link", "plain", "waste", "parts", "depth", "container", "article")

    def __init__(self, tag: str, parent: Node | None, attributes: dict[str, str]):
        self.tag, self.parent = tag, parent
        names = sorted({re.sub(r"\d+", "#", x) for x in attributes.get("class", "").split()})
        own = re.sub(r"\d+", "#", attributes.get("id", ""))
        self.step = tag + "".join(f".{x}" for x in names) + (f"@{own}" if own else "")
        self.digest = xxhash.xxh3_64_intdigest(self.step, parent.digest if parent else 0)
        self.article = tag in ("article", "main") or bool(parent and parent.article)
        self.noise = bool(parent and parent.noise) or self._is_boilerplate(attributes)
        named = not self.noise and self._has_boilerplate_name(attributes)
        self.marked = named and tag not in ("html", "body", "main") and not (tag == "header" and self.article)
        self.region = self if self.marked or parent is None else parent.region
        self.story = (tag in ("article", "main") and not named) or bool(parent and parent.story)
        self.keeps = self.container = False
        self.link = bool(parent and parent.link) or tag == "a"
        self.depth = parent.depth + 1 if parent else 0
        self.plain = self.waste = 0
        self.parts: list[str | Node] = []

    def _is_boilerplate(self, attributes: dict[str, str]) -> bool:
        if self.tag in ("html", "body"):
            return False
        if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or HIDDEN_STYLE.search(attributes.get("style", "")):
            return True
        if self.tag in ("article", "main") or (self.tag == "header" and self.article):
            return False  # of an article's own header only the headings are taken
        return self.tag in BOILERPLATE_TAGS or attributes.get("role", "").lower() in BOILERPLATE_ROLES

    def _has_boilerplate_name(self, attributes: dict[str, str]) -> bool:
        """Outside of articles any part of a name counts, inside whole names; an article itself is marked as a comment only."""
        names = f"{attributes.get('class', '')} {attributes.get('id', '')}"
        if names == " ":
            return False
        if self.tag == "article":
            return any(x.lower() in COMMENT_NAMES for x in NAME_PARTS.findall(names))
        if self.parent is not None and self.parent.article:
            meant = TEXT_NAMES if self.tag in TEXT_TAGS else BOILERPLATE_NAMES | COMMENT_NAMES
            return any(x.lower() in meant for x in names.split())
        return any(x.lower() in BOILERPLATE_NAMES or x.lower() in COMMENT_NAMES for x in NAME_PARTS.findall(names))

    def path(self) -> str:
        """The steps from the page down; of a deep element the last ones, behind a digest of those above."""
        steps, node = [], self
        while node is not None and len(steps) < WRITTEN_STEPS:
            steps.append(node.step)
            node = node.parent
        return ">".join(([f"{node.digest:016x}"] if node is not None else []) + steps[::-1])


def parsed(page: str) -> list[Node]:
    """The page's elements in order; the first is a root that stands for the page."""
    root = Node("html", None, {})
    nodes, stack, at = [root], [root], 0
    opened: dict[str, int] = {}  # elements of a tag on the stack

    def close(first: int) -> None:
        for node in stack[first:]:
            opened[node.tag] -= 1
        del stack[first:]

    def enter(node: Node) -> None:
        stack.append(node)
        opened[node.tag] = opened.get(node.tag, 0) + 1

    while at < len(page):
        found = TOKEN.match(page, at)
        if found is None:  # a tag that never ends
            break
        at = found.end()
        text = found["text"]
        if text is not None:
            stack[-1].parts.append(text)
            continue
        tag = found["tag"] or found["tag2"]
        if tag is None:
            if found[0].startswith("<![CDATA["):
                stack[-1].parts.append(html.escape(found[0][9:].removesuffix("]]>")))
            continue
        tag = tag.lower()
        if found["end"] or found["end2"]:
            for i in range(len(stack) - 1, 0, -1) if opened.get(tag) else ():
                if stack[i].tag == tag:
                    close(i)
                    break
                if stack[i].tag in ("table", "article", "main") and tag not in BLOCKS:
                    break
            continue
        rest = found["rest"] if found["tag"] else found["rest2"]
        attributes = {m["name"].lower(): html.unescape(m["a"] or m["b"] or m["c"] or "") for m in ATTRIBUTE.finditer(rest)} if rest.strip(" /\n\t") else {}
        if tag in ("html", "body") and opened.get(tag):
            continue
        if tag == "html":
            continue
        closes, scopes = CLOSES.get(tag, (frozenset(), frozenset()))
        if closes:
            keep = len(stack)
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in closes:
                    keep = i
                elif stack[i].tag in scopes or (stack[i].tag in BLOCKS and stack[i].tag != "p" and tag not in ("tr", "td", "th", "tbody", "thead", "tfoot")):
                    break
            close(keep)
        node = Node(tag, stack[-1], attributes)
        stack[-1].parts.append(node)
        nodes.append(node)
        if tag in RAW:
            closing = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.IGNORECASE).search(page, at)
            at = len(page) if closing is None else closing.start()
            if closing is not None:
                at = page.find(">", at) + 1 or len(page)
        elif tag not in VOID and not rest.endswith("/"):
            enter(node)
        elif rest.endswith("/") and tag not in VOID and tag in BLOCKS:
            enter(node)
    settle_names(nodes)
    return nodes


def settle_names(nodes: list[Node]) -> None:
    """Marks elements with a boilerplate name as noise, but for those that hold the page's article.

    Each marked element is a region of the text below it that isn't in another
    one, and so is the page without any.  If the page's own region has hardly any article, the
    marked region with most text of an article or main is kept, with what
    stands around it.  Without such text it is the largest region, if that is
    most of the page's text or the page's own has hardly any.
    """
    root, sizes, stories = nodes[0], {}, {}
    for node in nodes:
        if not node.noise and not node.link:
            size = sum(len(x) - x.count(" ") - x.count("\n") for x in node.parts if isinstance(x, str))
            sizes[node.region] = sizes.get(node.region, 0) + size
            if node.story:
                stories[node.region] = stories.get(node.region, 0) + size
    own, own_story = sizes.pop(root, 0), stories.pop(root, 0)
    best = max(stories, key=stories.get, default=None)
    if best is None or not stories[best]:
        best = max(sizes, key=sizes.get, default=None)
        if best is not None and not (sizes[best] * 2 > own + sum(sizes.values()) or own * 10 < sizes[best]):
            best = None
    if best is not None and own_story * 10 < sizes[best]:
        while best is not None:
            best.keeps, best = True, best.parent
    for node in nodes:
        node.noise = node.noise or bool(node.parent and node.parent.noise) or (node.marked and not node.keeps)
        node.container = node.tag in CONTAINERS and not node.noise


def measured(nodes: list[Node]) -> None:
    """Sums characters up the tree: plain ones, and those in boilerplate or links."""
    for node in reversed(nodes):
        for part in node.parts:
            if isinstance(part, str):
                size = len(part) - part.count(" ") - part.count("\n")
                if node.noise or node.link:
                    node.waste += size
                else:
                    node.plain += size
        if node.parent is not None:
            node.parent.plain += node.plain
            node.parent.waste += node.waste


def scored(nodes: list[Node]) -> list[tuple[float, Node]]:
    """Containers that hold plain text, the best first; of equal ones the innermost, then the first on the page."""
    total = nodes[0].plain
    held = [(x.plain / total * x.plain / (x.plain + x.waste), x) for x in nodes if x.container and x.plain] if total else []
    return sorted(held, key=lambda x: (-round(x[0], 9), -x[1].depth))


def blocks_of(container: Node) -> list[str]:
    """Texts of the container's blocks in page order, without boilerplate."""
    out: list[str] = []
    line: list[str] = []

    def end() -> None:
        if line and (text := " ".join(html.unescape("".join(line)).split())):
            out.append(text)
        line.clear()

    # An explicit stack: pages may nest deeper than Python calls.
    todo: list[tuple[Node, int, bool]] = [(container, 0, False)]
    while todo:
        node, i, headings = todo.pop()
        if i == 0 and node.tag in BLOCKS:
            end()
        while i < len(node.parts):
            part = node.parts[i]
            i += 1
            if isinstance(part, str):
                if not headings or node.tag in HEADINGS:
                    line.append(part)
            elif part.tag == "br" or (part.tag in VOID and part.tag == "hr"):
                line.append(" ")
            elif not part.noise:
                todo += [(node, i, headings), (part, 0, (headings or part.tag == "header") and part.tag not in HEADINGS)]
                break
        else:
            if node.tag in BLOCKS:
                end()
    end()
    return out


def votes(page: str | None) -> dict[str, float]:
    """Paths of the page's containers with their best scores."""
    nodes = parsed(page or "")
    measured(nodes)
    best: dict[int, tuple[float, Node]] = {}
    for score, node in scored(nodes):
        best.setdefault(node.digest, (score, node))
    return {node.path(): score for score, node in best.values()}


def main_text(page: str | None, path: str | None) -> str:
    """Text of the best container at ``path``, or of the page's best one if none lies there."""
    nodes = parsed(page or "")
    measured(nodes)
    ranked = scored(nodes)
    if not ranked:
        return ""
    depth = path.count(">") if path else -1
    alike = (node for _, node in ranked if path and (node.depth == depth or depth >= WRITTEN_STEPS) and node.path() == path)
    chosen = next(alike, ranked[0][1])
    return "\n".join(blocks_of(chosen))


def winning_paths(pages: DataFrame) -> DataFrame:
    """``host, path``: for each host the path with most votes, ties to the first in order.  ``pages``: host, html."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple[str, str], float] = {}
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for path, score in votes(page.as_py()).items():
                    sums[host, path] = sums.get((host, path), 0.0) + score
            hosts, paths = [x[0] for x in sums], [x[1] for x in sums]
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(list(sums.values()), pa.float64())], ["host", "path", "votes"])

    sums = pages.select("host", "html").mapInArrow(counted, "host string, path string, votes double")
    # Whole millionths add up alike in any order.
    sums = sums.groupBy("host", "path").agg(F.sum(F.round(F.col("votes") * 1_000_000).cast("long")).alias("votes"))
    return sums.groupBy("host").agg(F.min_by("path", F.struct(-F.col("votes"), F.col("path"))).alias("path"))


def extract(pages: DataFrame, url_column: str = "url", html_column: str = "html", text: str = "text", size: str = "n_chars") -> DataFrame:
    """``pages`` with the main text and its code points; columns of those names are replaced.

    Pages without url share the host of no name.  A null or empty page, or one
    without plain text, has the empty text.  Repeated pages are extracted each.
    """
    ship(pages.sparkSession)
    kept = [F.col(f"`{c}`") for c in pages.columns if c not in (text, size)]
    rows = pages.select(F.struct(*kept).alias("page"), url_host(F.col(url_column).cast("string")).alias("host"), F.col(html_column).cast("string").alias("html"))
    winners = staged(winning_paths(rows)).withColumnsRenamed({"host": "__host", "path": "__path"})

    @F.pandas_udf("string")
    def extracted(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for pages, paths in batches:
            yield pd.Series([main_text(page, path) for page, path in zip(pages, paths, strict=True)], dtype=object)

    # Spark sends the hosts to all tasks only below its own size limit.
    joined = rows.join(winners, F.col("host") == F.col("__host"), "left")
    done = joined.select("page", extracted("html", "__path").alias("__text"))
    return done.select("page.*", F.col("__text").alias(text), F.char_length("__text").cast("long").alias(size))
