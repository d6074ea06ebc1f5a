"""Main text of web pages from flat blocks and a decision tree.

A page is cut at block-level tags into flat text blocks. A block is described by its own
word count and link density, those of its neighbours, and where it stands: inside chrome
(menus, footers, adverts, comments, known by tag or by a whole name in class, id or role),
inside an article, a heading or a list item. An article or main lifts the chrome around it; inside
one, names of furniture such as post-comments or share-buttons are chrome too. A decision tree,
trained on the small labelled table below, says which blocks are main text.

The scan is linear in the page, whatever is left open or unclosed in it.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from detlake.llm.common import with_computed

# Tags that end a block, tags without content, tags whose content is no text.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup "
    "option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style noscript template textarea iframe svg xmp title".split())
# Of these, the ones that run to the end of the page if nothing closes them, as HTML says.
ENDLESS_TAGS = frozenset("script style textarea iframe xmp title".split())
# Chrome by tag, and by the words of a class, id or role.
CHROME_TAGS = frozenset("nav aside footer form menu button select dialog head".split())
CHROME_WORDS = frozenset(
    "ad ads advert advertisement adverts advertising alert banner bottombar breadcrumb breadcrumbs byline captcha "
    "comment comments consent contentinfo cookie cookies copyright disqus feedback footer form gdpr header login "
    "masthead menu modal nav navbar navigation newsletter notice notification pager pagination popup promo promoted "
    "promotion reader recommended related replies reply respond search share sharing sidebar signup skip social "
    "sponsor sponsored subscribe tags toc toolbar topbar widget widgets".split()
)
# Words that place chrome; a name is chrome if all its words are from these two.
PLACE_WORDS = frozenset(
    "area bar block body bottom box container form global holder inner item left link links list main outer page panel "
    "primary right secondary section site top wrap wrapper".split()
)
# Words that name parts of an article's furniture together with a chrome word, and
# chrome words that also name parts of the article proper.
FURNITURE_WORDS = frozenset("article button buttons content entry icons items post posts slot story text title unit".split())
ARTICLE_PARTS = frozenset("byline header reader search tags toc".split())
ARTICLE_TAGS = frozenset(("article", "main"))
ARTICLE_WORDS = frozenset("article content entry post story main body text".split())

# A tag whose quotes do not close before the next tag ends at its first ">".
_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<[!?][^>]*>|</?[A-Za-z](?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*>|</?[A-Za-z][^>]*>|[^<]+|<", re.S
)
_NAME = re.compile(r"</?([A-Za-z][A-Za-z0-9:-]*)")
_LABELS = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORDS = re.compile(r"[a-z]+")


# Tags whose id is a slug of their text, not the name of a part of the page.
SLUG_TAGS = frozenset("h1 h2 h3 h4 h5 h6 p article main".split())


def names(tag: str, piece: str, inside: bool = False) -> tuple[bool, bool]:
    """Whether the names in a tag say chrome, and whether they say article. ``inside``: an article is open."""
    chrome = article = False
    for m in _LABELS.finditer(piece):
        if m[1].lower() == "id" and tag in SLUG_TAGS:
            continue
        for name in (m[2] or m[3] or m[4] or "").lower().split():
            words = set(_WORDS.findall(name))
            if words & CHROME_WORDS and words <= CHROME_WORDS | PLACE_WORDS:
                chrome = True
            elif inside and words & (CHROME_WORDS - ARTICLE_PARTS) and words <= CHROME_WORDS | PLACE_WORDS | FURNITURE_WORDS:
                chrome = True
            elif words & ARTICLE_WORDS:
                article = True
    return chrome, article


@dataclass
class Block:
    text: str
    words: int
    linked: int
    chrome: bool
    article: bool
    heading: bool
    item: bool


def flat_blocks(page: str) -> list[Block]:
    """The blocks with words, in page order."""
    blocks: list[Block] = []
    # Open containers: (tag, inside chrome, inside an article).
    stack: list[tuple[str, bool, bool]] = [("", False, False)]
    parts: list[str] = []
    linked_parts: list[str] = []
    links, heading, item, at = 0, False, False, 0
    open_tags: Counter[str] = Counter()
    never_closed: set[str] = set()
    last_close = page.rfind(">")

    def flush() -> None:
        nonlocal parts, linked_parts
        words = html.unescape("".join(parts)).split()
        if words:
            inside = stack[-1]
            linked = len(html.unescape(" ".join(linked_parts)).split())
            blocks.append(Block(" ".join(words), len(words), min(linked, len(words)), inside[1], inside[2], heading, item))
        parts, linked_parts = [], []

    while at < len(page):
        if at > last_close and page[at] == "<" and not page.startswith("<!--", at):
            piece = "<"  # nothing ends a tag from here on
            at += 1
        else:
            token = _TOKEN.match(page, at)
            at = token.end()
            piece = token[0]
        if piece[0] != "<" or piece == "<":
            parts.append(piece)
            if links:
                linked_parts.append(piece)
            continue
        name = _NAME.match(piece)
        if not name:
            continue
        tag, closing = name[1].lower(), piece[1] == "/"
        if tag in RAW_TAGS and not closing:
            if tag in BLOCK_TAGS:
                flush()
            if tag == "svg" and piece.endswith("/>"):
                continue
            end = None if tag in never_closed else re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at, last_close + 1)
            if end or tag in ENDLESS_TAGS:
                at = end.end() if end else len(page)
            else:
                never_closed.add(tag)
        elif tag == "a":
            links = max(links - 1, 0) if closing else min(links + 1, 1)
        elif tag == "br":
            parts.append(" ")
        elif tag in BLOCK_TAGS or tag == "button":
            flush()
            heading, item = (tag in ("h1", "h2", "h3", "h4", "h5", "h6"), tag == "li") if not closing else (False, False)
            if closing:
                while open_tags[tag]:
                    ended = stack.pop()[0]
                    open_tags[ended] -= 1
                    if ended == tag:
                        break
            elif tag not in VOID_TAGS:
                if tag in ("p", "li") and stack[-1][0] == tag:
                    open_tags[stack.pop()[0]] -= 1
                _, chrome, article = stack[-1]
                own_chrome, own_article = names(tag, piece, article)
                if tag in ARTICLE_TAGS:
                    chrome, own_article = False, True
                if tag == "header" and not article:
                    chrome = True
                if tag in CHROME_TAGS or own_chrome and tag not in ("html", "body"):
                    chrome = True
                article = article or own_article
                stack.append((tag, chrome, article))
                open_tags[tag] += 1
                links = 0
    flush()
    return blocks


FEATURES = ("words", "density", "prev_words", "prev_density", "next_words", "next_density", "chrome", "article", "heading", "item")


def features(blocks: list[Block]) -> list[tuple[float, ...]]:
    shape = [(0.0, 0.0), *((float(b.words), b.linked / b.words) for b in blocks), (0.0, 0.0)]
    return [
        (*shape[i + 1], *shape[i], *shape[i + 2], float(b.chrome), float(b.article), float(b.heading), float(b.item))
        for i, b in enumerate(blocks)
    ]


# Labelled blocks. Columns as in FEATURES, then 1 for main text.
LABELLED = """
1 1.0 0 0.0 1 1.0 1 0 0 1 0
2 1.0 1 1.0 1 1.0 1 0 0 1 0
1 1.0 2 1.0 9 0.0 1 0 0 1 0
8 0.0 1 1.0 12 0.0 1 0 0 0 0
40 0.0 1 1.0 12 0.0 1 0 0 0 0
25 0.1 60 0.0 80 0.0 1 1 0 0 0
9 0.0 120 0.0 0 0.0 1 0 0 0 0
6 0.2 35 0.0 0 0.0 1 0 0 0 0
30 0.0 90 0.0 25 0.0 1 1 0 0 0
55 0.0 25 0.0 9 0.0 1 1 0 0 0
140 0.0 60 0.0 90 0.0 1 1 0 0 0
95 0.02 12 0.0 130 0.0 1 1 0 0 0
180 0.0 20 0.0 2 0.0 1 1 0 0 0
3 0.0 40 0.0 150 0.0 1 1 0 0 0
4 0.1 60 0.0 120 0.0 1 1 0 0 0
6 0.0 35 0.0 110 0.0 1 1 1 0 0
3 1.0 150 0.0 50 0.0 1 1 0 1 0
3 0.0 2 0.5 5 0.0 1 0 1 0 0
12 0.0 0 0.0 3 1.0 1 0 0 0 0
10 0.0 8 0.0 9 0.0 0 1 1 0 1
5 0.0 1 1.0 40 0.0 0 1 1 0 1
9 0.0 10 0.0 22 0.0 0 1 0 0 1
22 0.0 9 0.0 95 0.0 0 1 0 0 1
95 0.0 22 0.0 1 0.0 0 1 0 0 1
1 0.0 95 0.0 40 0.0 0 1 0 0 1
3 0.0 40 0.0 60 0.05 0 1 0 0 1
60 0.05 3 0.0 2 0.0 0 1 0 0 1
2 0.0 60 0.0 8 0.0 0 1 0 0 1
130 0.02 30 0.0 9 0.0 0 1 0 0 1
7 0.0 30 0.0 6 0.0 0 1 0 1 1
6 0.4 7 0.0 12 0.0 0 1 0 1 1
2 1.0 80 0.0 60 0.0 0 1 0 0 1
9 1.0 45 0.0 30 0.0 0 1 0 0 1
15 0.6 50 0.0 70 0.0 0 1 0 0 1
5 0.0 40 0.0 6 0.5 0 1 0 0 1
1 0.0 30 0.0 2 0.5 0 1 0 0 1
1 0.0 9 1.0 3 1.0 0 1 0 0 1
12 0.0 4 0.0 5 1.0 0 1 1 0 1
4 1.0 5 1.0 4 1.0 0 1 0 1 1
5 1.0 4 1.0 1 0.0 0 1 0 1 1
1 0.0 5 1.0 0 0.0 0 1 0 0 1
2 0.0 0 0.0 0 0.0 0 1 0 0 1
3 0.5 4 1.0 0 0.0 0 1 0 0 1
45 0.0 5 0.0 50 0.0 0 0 0 0 1
80 0.03 45 0.0 60 0.0 0 0 0 0 1
25 0.0 80 0.0 45 0.1 0 0 0 0 1
16 0.0 60 0.0 40 0.0 0 0 0 0 1
12 0.1 30 0.0 55 0.0 0 0 0 0 1
6 0.0 3 0.0 70 0.0 0 0 1 0 1
5 0.0 60 0.0 60 0.0 0 0 0 0 1
4 0.0 40 0.0 25 0.0 0 0 1 0 1
18 0.0 30 0.0 22 0.0 0 0 0 1 1
40 0.0 30 0.0 2 1.0 0 0 0 0 1
35 0.0 0 0.0 0 0.0 0 0 0 0 1
60 0.0 10 0.0 3 0.0 0 0 0 0 1
28 0.05 20 0.0 4 1.0 0 0 0 0 1
18 0.0 0 0.0 0 0.0 0 0 0 0 1
21 0.1 3 1.0 2 0.0 0 0 0 0 1
90 0.0 2 1.0 1 1.0 0 0 0 0 1
8 0.0 40 0.0 3 1.0 0 0 0 0 1
4 0.0 35 0.0 2 1.0 0 0 0 0 1
2 0.0 28 0.0 30 0.0 0 0 0 0 1
5 0.0 0 0.0 0 0.0 0 0 0 0 1
4 1.0 3 1.0 50 0.0 0 0 0 0 0
2 1.0 1 1.0 45 0.0 0 0 0 1 0
5 1.0 60 0.0 4 1.0 0 0 0 0 0
3 0.8 45 0.0 0 0.0 0 0 0 0 0
20 0.9 60 0.0 18 0.9 0 0 0 0 0
2 0.0 5 0.0 3 0.0 0 0 0 0 0
3 0.0 1 1.0 2 1.0 0 0 0 0 0
2 1.0 3 1.0 2 1.0 0 0 0 1 0
6 1.0 2 1.0 4 1.0 0 0 0 1 0
12 0.9 6 1.0 9 0.8 0 0 0 0 0
4 0.5 2 1.0 0 0.0 0 0 0 0 0
7 0.0 4 1.0 0 0.0 0 0 0 0 0
5 0.0 3 1.0 6 0.0 0 0 0 0 0
3 0.0 6 0.0 4 0.5 0 0 0 0 0
1 0.0 0 0.0 2 1.0 0 0 0 0 0
120 0.02 90 0.0 80 0.0 1 0 0 0 1
150 0.0 60 0.0 0 0.0 1 0 0 0 1
85 0.0 40 0.0 110 0.05 1 0 0 0 1
6 0.0 2 1.0 95 0.0 1 0 1 0 1
"""


def labelled() -> tuple[list[tuple[float, ...]], list[int]]:
    rows = [tuple(map(float, line.split())) for line in LABELLED.strip().splitlines()]
    return [r[:-1] for r in rows], [int(r[-1]) for r in rows]


def grow_tree(rows: list[tuple[float, ...]], marks: list[int], depth: int = 6, least: int = 1):
    """A classification tree by Gini impurity: (feature, threshold, low, high) or a class."""
    yes = sum(marks)
    if not depth or yes in (0, len(marks)):
        return int(2 * yes > len(marks))

    def impurity(part: list[int]) -> float:
        share = sum(part) / len(part)
        return 2 * share * (1 - share) * len(part)

    best = None
    for f in range(len(rows[0])):
        values = sorted({r[f] for r in rows})
        for low, high in zip(values, values[1:], strict=False):
            cut = (low + high) / 2
            left = [m for r, m in zip(rows, marks, strict=True) if r[f] <= cut]
            right = [m for r, m in zip(rows, marks, strict=True) if r[f] > cut]
            if min(len(left), len(right)) >= least:
                score = impurity(left) + impurity(right)
                if best is None or score < best[0] - 1e-12:
                    best = (score, f, cut)
    if best is None or best[0] >= impurity(marks) - 1e-12:
        return int(2 * yes > len(marks))
    _, f, cut = best
    sides = [[(r, m) for r, m in zip(rows, marks, strict=True) if (r[f] > cut) == s] for s in (False, True)]
    low, high = (grow_tree([r for r, _ in s], [m for _, m in s], depth - 1, least) for s in sides)
    return f, cut, low, high


@cache
def block_tree():
    return grow_tree(*labelled())


def decide(tree, row: tuple[float, ...]) -> int:
    while not isinstance(tree, int):
        f, cut, low, high = tree
        tree = high if row[f] > cut else low
    return tree


def main_text(page: str) -> str:
    blocks = flat_blocks(page)
    tree = block_tree()
    return "\n".join(b.text for b, row in zip(blocks, features(blocks), strict=True) if decide(tree, row))


def extract_text(df: DataFrame, page: str = "html", out: str = "text") -> DataFrame:
    """``df`` without ``page``, with ``out``, the main text ("" if there is none).

    Null and empty pages give "". A column named like ``out`` is replaced; other columns
    and repeated rows pass unchanged; an empty table gives an empty table. Very long pages are
    read whole, in time that grows with their length.
    """
    source = df.withColumn(page, F.coalesce(F.col(f"`{page}`").cast("string"), F.lit("")))
    return with_computed(source, page, {out: "string"}, lambda: lambda pages: [[main_text(v.as_py()) for v in pages]])


def op8_html_text(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract_text(pages).withColumn("n_chars", F.length("text").cast("long"))
