"""Main-text extraction by tag-path ratios.

A page is read as a stream of tags and texts. Each text belongs to the path of open elements it stands under, from the root
down (names with their class or id), and each path gets the characters and the punctuation marks of all texts under it and the number of
its nodes. The text ratio (characters per node) and the punctuation ratio (marks per node) of a path are smoothed over
neighbouring texts in page order with a Gaussian, fused by multiplication, and paths are chosen whose fused ratio reaches a share of
the page's standard deviation. Texts in an article or main element weigh more, by as much as the page's weight stands in such elements; a
heading weighs as much as the text below it, if that is more; a class, id or role that says otherwise (a whole token, and not on html,
body, main or article) takes most of a path's weight.

The weight of the chosen paths is added up towards the root. The main text's container is the lowest path that still holds most of it, and all
of a container counts: its tables, quotes, code, captions and lists have low ratios of their own. What is left out of it are elements and class words
that the page's furniture uses (menus, headers, footers, sidebars, notices, adverts, forms, comments; scripts and styles have no text) and blocks
of nearly nothing but links. Outside the container chosen paths stay. Paths are numbers in a tree, so time grows with the page and not with its depth.

Kept texts are gathered by block element: character references decoded, white space turned to one blank, blocks joined by
one line break. Defined results: a null or empty page gives an empty text; unclosed, stray and cut-off tags are tolerated; a page
without any scoring path gives the empty text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import bounded_batches

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
NOT_TEXT = frozenset("head nav header footer aside form menu button select dialog script style noscript template iframe svg math textarea title object canvas".split())
ARTICLE = frozenset("article main".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Emphasis inside a text, which without a class is part of the path around it.
PHRASE = frozenset("abbr b bdi bdo big cite code del dfn em font i ins kbd mark q s samp small strong sub sup tt u var".split())
#: Elements whose class words say nothing about the text inside.
FRAME = ARTICLE | {"html", "body"}
# Words in a class, id or role that mark what is not main text.
NOT_TEXT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer disqus footer form header login masthead menu menubar modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted replies respond share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split()
)
#: What texts in an article or main element weigh at most; others weigh 1.
ARTICLE_FACTOR = 4.0
#: What texts under a class, id or role of NOT_TEXT_WORDS weigh.
MARKED_FACTOR = 0.02
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_MARKER = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
_PUNCT = re.compile(r"[.,;:!?¡¿、。，！？…\"'()]")
_BLANK = re.compile(r"\s+")
#: Elements that an opening tag of the same kind closes.
CLOSES = {"p": BLOCK - {"body", "html"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}


#: Elements that hold text and are no container of a whole article.
TEXTUAL = HEADING | frozenset("p blockquote pre ul ol dl li dt dd table caption thead tbody tfoot tr td th figure figcaption address details summary hgroup hr center a".split()) | PHRASE
#: The part of the chosen weight that a container holds, and the one from which a child of the body counts whole.
HOLDS, COUNTS = 0.8, 0.2
#: The part of link text from which a block is a menu.
LINKS = 0.8


class Paths:
    """The tag paths of a page as a tree of numbers; 0 is the root, and a path's number is larger than that of the one above."""

    def __init__(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.name, self.up, self.barred, self.article, self.marks, self.heading, self.link = [""], [0], [False], [False], [0], [False], [False]

    def below(self, up: int, name: str, tokens: list[str]) -> int:
        """The path of an element under up. Emphasis without a class belongs to the path around it."""
        if not tokens and name in PHRASE:
            return up
        marked = name not in FRAME and not NOT_TEXT_WORDS.isdisjoint(tokens)
        key = (up, name, marked, *sorted({w for v in tokens for w in _WORD.findall(v)}))
        at = self.ids.get(key)
        if at is None:
            at = self.ids[key] = len(self.name)
            own_header = name == "header" and self.article[up]  # an article's own heading is part of it
            self.name.append(name)
            self.up.append(up)
            self.barred.append(self.barred[up] or name in NOT_TEXT and not own_header)
            self.article.append(self.article[up] or name in ARTICLE)
            self.marks.append(self.marks[up] + marked)
            self.heading.append(self.heading[up] or name in HEADING)
            self.link.append(self.link[up] or name == "a")
        return at

    def sums(self, own: np.ndarray) -> list[float]:
        """What each path and all below it have together."""
        out = own.tolist()
        for k in range(len(out) - 1, 0, -1):
            out[self.up[k]] += out[k]
        return out


@dataclass
class Piece:
    path: int
    block: int
    text: str


def pieces(page: str, paths: Paths) -> Iterator[Piece]:
    """The texts of a page in order, with their tag path and the number of their block."""
    stack: list[tuple[str, int]] = []
    at, block, n = 0, 0, len(page)

    def text(raw: str) -> Iterator[Piece]:
        if raw:
            yield Piece(stack[-1][1] if stack else 0, block, html.unescape(raw))

    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            yield from text(page[at:])
            return
        yield from text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if page.startswith("<![CDATA[", m.start()):
                yield from text(html.escape(m[0][9:].removesuffix("]]>"), quote=False))
            continue
        name = m[2].lower()
        if m[1]:
            if name in BLOCK:
                block += 1
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
                if stack[k][0] in ("article", "main", "body", "table", "nav", "footer", "aside") and name not in BLOCK:
                    break
            continue
        if name in BLOCK:
            block += 1
            while stack and name in CLOSES.get(stack[-1][0], ()):
                stack.pop()
            # a paragraph left open is closed by the next block even under unclosed inline elements
            if name in CLOSES["p"]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p":
                        del stack[k:]
                        break
                    if stack[k][0] in BLOCK:
                        break
        if name == "br":
            yield from text(" ")
        if name in VOID or m[3].rstrip().endswith("/") and name not in BLOCK and name not in RAW:
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else n
            continue
        tokens = [v for x in _MARKER.finditer(m[3]) for v in (x[2] or x[3] or x[4] or "").lower().split()] if "=" in m[3] else []
        stack.append((name, paths.below(stack[-1][1] if stack else 0, name, tokens)))


def smooth(x: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    k = np.exp(-0.5 * (np.arange(-2, 3) / sigma) ** 2)
    return np.convolve(x, k)[2:-2] / np.convolve(np.ones_like(x), k)[2:-2]


def main_paths(paths: Paths, chosen: np.ndarray, weight: np.ndarray, chars: np.ndarray) -> list[bool]:
    """Of each path: is its text main text? weight is what the chosen paths have by themselves, chars what all have."""
    n, total = len(paths.name), paths.sums(weight)
    kids: list[list[int]] = [[] for _ in range(n)]
    for k in range(1, n):
        kids[paths.up[k]].append(k)
    top = 0
    while paths.name[top] != "article" and kids[top]:
        k = max(kids[top], key=total.__getitem__)
        if total[k] < HOLDS * total[top] or paths.name[k] in TEXTUAL or weight[k] > total[k] / 2:
            break
        top = k
    if paths.name[top] in ("", "html", "body"):  # no element holds the article and nothing else
        whole = {k for k in kids[top] if paths.name[k] in TEXTUAL or total[k] >= COUNTS * total[top]}
    else:
        whole = {top}
    letters, links = paths.sums(chars), paths.sums(np.where(paths.link, chars, 0.0))
    inside, menu, out = [False] * n, [False] * n, [False] * n
    for k in range(n):
        up = paths.up[k]
        inside[k] = k in whole or inside[up]
        block = paths.name[k] in BLOCK and not paths.heading[k] and k != top and total[k] < COUNTS * total[top]
        menu[k] = menu[up] or block and letters[k] > 0 and links[k] >= LINKS * letters[k]
        out[k] = not paths.barred[k] and paths.marks[k] <= paths.marks[top] and not menu[k] and (inside[k] or bool(chosen[k]))
    return out


def extract(page: str | None, share: float = 0.25) -> str:
    """The main text of a page; share is the part of the fused ratios' standard deviation that a path has to reach."""
    if not page:
        return ""
    paths = Paths()
    found = list(pieces(page, paths))
    live = [p for p in found if not paths.barred[p.path] and not p.text.isspace()]
    if not live:
        return ""
    at, n = np.array([p.path for p in live]), len(paths.name)
    size = np.array([len(_BLANK.sub(" ", p.text).strip()) for p in live])
    add = lambda values: np.bincount(at, values, n)
    chars, nodes = add(size), np.maximum(np.bincount(at, minlength=n), 1)
    length = smooth((chars / nodes)[at])
    marks = smooth((add([len(_PUNCT.findall(p.text)) for p in live]) / nodes)[at])
    fused = length * (marks + 0.1) * np.where(np.array(paths.marks)[at] > 0, MARKED_FACTOR, 1.0)
    for k in range(len(live) - 2, -1, -1):  # a heading has no sentences: it counts as much as the text below it
        if paths.heading[at[k]]:
            fused[k] = max(fused[k], fused[k + 1])
    within = np.array(paths.article)[at]
    # articles count as much as they hold of the page: teasers beside a body give no advantage, an article that is the body gives all
    fused *= np.where(within, 1 + (ARTICLE_FACTOR - 1) * fused[within].sum() / fused.sum(), 1.0)
    score = add(fused) / nodes
    chosen = (score >= share * float(np.std(fused))) & (chars > 0)
    taken = main_paths(paths, chosen, np.where(chosen, add(fused), 0.0), chars)
    lines: list[str] = []
    last, part = None, []
    for p in found:
        if not taken[p.path]:
            continue
        if p.block != last:
            lines.append("".join(part))
            last, part = p.block, []
        part.append(p.text)
    lines.append("".join(part))
    return "\n".join(x for x in (_BLANK.sub(" ", y).strip() for y in lines) if x)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row."""
    bounded_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(x) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_pydict({"page_id": b.column("page_id"), "url": b.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(x) for x in texts], pa.int64())})

    kinds = dict(pages.select("page_id", "url").dtypes)
    return pages.select("page_id", "url", F.col("html")).mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
