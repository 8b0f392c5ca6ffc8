"""Main text of web pages: flat text blocks classified by a decision tree.

A page is cut at block-level tags into flat blocks of text. A block's features are its word count and link density, those of its neighbours before
and after, and two marks of the containers it lies in: whether one is boilerplate by its element, role, class or id, and whether the block is
inside an article (1), outside on a page that has one (-1), or on a page without (0). A decision tree (CART, Gini impurity), trained when the module is
first used on the small labelled table below, says which blocks are main text; they are joined in page order.

Defined results: null, empty and text-free html gives an empty text with 0 characters; unclosed tags, comments and quotes end at the end of
the page; repeated rows give a row each; a null page_id or url is carried along; ties of splits go to the first feature and the least threshold; other
columns are left out. A page of any length is one row's work.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "boilerplate", "article")

#: Labelled blocks: the features above, and whether the block is main text.
LABELLED = (
    # menus, headers, footers, adverts, notices, forms, comments: marked containers
    (1, 1.0, 0, 0.0, 1, 1.0, 1, -1, 0), (1, 1.0, 1, 1.0, 1, 1.0, 1, -1, 0), (3, 1.0, 1, 1.0, 12, 0.0, 1, -1, 0), (9, 0.0, 2, 1.0, 5, 0.0, 1, -1, 0),
    (14, 0.1, 60, 0.0, 0, 0.0, 1, -1, 0), (6, 0.0, 80, 0.0, 0, 0.0, 1, -1, 0), (40, 0.0, 30, 0.0, 25, 0.0, 1, -1, 0), (120, 0.0, 45, 0.0, 10, 0.0, 1, -1, 0),
    (35, 0.0, 50, 0.0, 42, 0.0, 1, 1, 0), (8, 0.0, 50, 0.0, 20, 0.0, 1, 1, 0), (90, 0.02, 12, 0.0, 70, 0.0, 1, 1, 0), (2, 1.0, 55, 0.0, 2, 1.0, 1, 1, 0),
    (2, 1.0, 0, 0.0, 2, 1.0, 1, 0, 0), (25, 0.0, 2, 1.0, 70, 0.0, 1, 0, 0), (60, 0.0, 80, 0.0, 40, 0.0, 1, 0, 0), (150, 0.0, 90, 0.0, 0, 0.0, 1, 0, 0),
    # inside the article: long and short paragraphs, headings, lists of links
    (8, 0.0, 6, 0.0, 70, 0.0, 0, 1, 1), (1, 0.0, 9, 0.0, 4, 0.0, 0, 1, 1), (3, 0.0, 60, 0.0, 55, 0.0, 0, 1, 1), (75, 0.0, 8, 0.0, 60, 0.0, 0, 1, 1),
    (250, 0.0, 40, 0.0, 2, 0.0, 0, 1, 1), (30, 0.2, 75, 0.0, 20, 0.0, 0, 1, 1), (20, 0.45, 75, 0.0, 20, 0.0, 0, 1, 1), (2, 0.0, 2, 0.0, 0, 0.0, 0, 1, 1),
    (12, 0.0, 0, 0.0, 7, 0.0, 0, 1, 1), (45, 0.05, 30, 0.0, 8, 0.0, 0, 1, 1), (5, 0.0, 3, 0.0, 2, 0.0, 0, 1, 1), (8, 0.0, 0, 0.0, 3, 0.0, 0, 1, 1),
    (4, 0.0, 12, 0.0, 0, 0.0, 0, 1, 1), (11, 0.0, 5, 0.0, 5, 0.0, 0, 1, 1), (6, 0.0, 1, 0.0, 4, 0.0, 0, 1, 1), (13, 0.0, 2, 0.0, 1, 0.0, 0, 1, 1), (4, 1.0, 75, 0.0, 5, 1.0, 0, 1, 0), (3, 1.0, 4, 1.0, 6, 1.0, 0, 1, 0),
    # outside an article that the page has
    (2, 1.0, 0, 0.0, 1, 1.0, 0, -1, 0), (10, 0.0, 3, 1.0, 8, 0.0, 0, -1, 0), (7, 0.0, 75, 0.0, 0, 0.0, 0, -1, 0), (28, 0.0, 1, 1.0, 9, 0.0, 0, -1, 0), (60, 0.1, 20, 0.0, 30, 0.0, 0, -1, 0),
    # pages without an article: by words and links
    (70, 0.0, 6, 0.0, 55, 0.0, 0, 0, 1), (55, 0.02, 70, 0.0, 60, 0.0, 0, 0, 1), (25, 0.0, 60, 0.0, 45, 0.0, 0, 0, 1), (18, 0.0, 40, 0.0, 3, 1.0, 0, 0, 1),
    (6, 0.0, 2, 1.0, 70, 0.0, 0, 0, 1), (4, 0.0, 60, 0.0, 65, 0.0, 0, 0, 1), (9, 0.0, 45, 0.0, 50, 0.0, 0, 0, 1), (30, 0.15, 3, 0.0, 40, 0.0, 0, 0, 1), (120, 0.01, 1, 1.0, 1, 1.0, 0, 0, 1),
    (1, 1.0, 0, 0.0, 1, 1.0, 0, 0, 0), (2, 1.0, 2, 1.0, 2, 1.0, 0, 0, 0), (4, 1.0, 3, 1.0, 80, 0.0, 0, 0, 0), (5, 0.0, 2, 1.0, 3, 1.0, 0, 0, 0), (7, 0.0, 4, 0.0, 3, 0.6, 0, 0, 0),
    (15, 0.7, 60, 0.0, 12, 0.8, 0, 0, 0), (25, 0.6, 4, 0.5, 5, 1.0, 0, 0, 0), (3, 0.0, 5, 0.0, 0, 0.0, 0, 0, 0), (6, 0.2, 9, 0.5, 0, 0.0, 0, 0, 0), (8, 0.0, 6, 0.0, 4, 0.0, 0, 0, 0), (40, 0.9, 70, 0.0, 60, 0.0, 0, 0, 0),
)

#: Elements that end a block, those that hold others and are tracked to their end tag, and those that are boilerplate as such.
BREAKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
HOLDERS = frozenset("article aside blockquote button dialog div dl fieldset figure footer form header li main menu nav ol section select table td th tr ul".split())
BOILERPLATE = frozenset("aside button dialog footer form menu nav select".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar tablist".split())
MARKS = re.compile(
    r"(?:^|[^a-z])(?:ads?|adverts?|advertisement|advertising|alert|banner|breadcrumbs?|byline|comments?|consent|cookies?|copyright|disclaimer|disqus|footer|gdpr|header|login|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|outbrain|overlay|pager|pagination|popup|promo|promoted|recommended|related|replies|respond|search|share|sharing|sidebar|signup|skip|social|sponsor|sponsored|subscribe|subscription|taboola|tags|teaser|toolbar|widget)(?:$|[^a-z])"
)
#: Of a page's words outside links: a named container that holds more is no boilerplate.
MOST = 0.5
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|object|textarea|title|math|canvas|audio|video)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-z][a-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-z][a-z0-9:-]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)",
    re.IGNORECASE | re.DOTALL,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.IGNORECASE)


def marked(name: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element is boilerplate by its kind or role, and whether by its names."""
    kind, named = name in BOILERPLATE or name == "header" and not in_article, False
    for key, value in _ATTRIBUTE.findall(attributes) if attributes else ():
        key, value = key.lower(), value.strip("\"'").lower()
        if in_article:  # an article's own header holds its title
            value = value.replace("header", "").replace("byline", "")
        if key in ("class", "id"):
            named |= name not in ("article", "main", "body", "html") and bool(MARKS.search(value))
        else:
            kind |= bool(key == "role" and value in ROLES or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value) or key == "hidden" and value != "until-found")
    return kind, named


def blocks(page: str) -> list[tuple[str, int, float, int, int]]:
    """(text, words, link density, boilerplate, article) of each flat block with a word."""
    found: list[tuple[str, int, float, bool, int, tuple[int, ...]]] = []
    parts: list[str] = []
    linked: list[str] = []
    outside = ("", False, False, ())
    stack: list[tuple[str, bool, bool, tuple[int, ...]]] = []  # element, boilerplate by kind, article, named containers, with what holds them
    own: tuple[bool, tuple[int, ...]] = False, ()  # of the paragraph itself
    link, names = 0, 0
    has_article = False

    def close() -> None:
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            words = len(text.split(" "))
            links = min(words, len(entities.unescape(" ".join(linked)).split()))
            up = stack[-1] if stack else outside
            found.append((text, words, links / words, own[0] or up[1], int(up[2]), up[3] + own[1]))
        parts.clear()
        linked.clear()

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
            if link:
                linked.append(parts[-1])
        at = m.end()
        name = m[3] or m[6]
        if not name:
            if m[1]:
                parts.append(" ")
            continue
        name, end, attributes = name.lower(), bool(m[2] or m[5]), m[4] or m[7] or ""
        if name == "a":
            link = 0 if end else 1
        elif name == "br":
            parts.append(" ")
        elif name in BREAKS:
            close()
            link, own = 0, (False, ())
            if name in HOLDERS and end:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
            elif not end and (attributes or name in HOLDERS):
                if name in ("li", "tr", "td", "th") and stack and stack[-1][0] == name:
                    stack.pop()
                up = stack[-1] if stack else outside
                kind, named = marked(name, attributes, up[2])
                names += named
                if name in HOLDERS:
                    starts = name in ("article", "main")
                    has_article |= starts
                    inherited = () if starts and not up[2] else up[3]
                    stack.append((name, up[1] or kind, starts or up[2], inherited + ((names,) if named else ())))
                else:
                    own = kind, (names,) if named else ()
    if at < len(page):
        rest = page[at:]
        parts.append(rest[: rest.rfind("<")] if re.search(r"<[a-zA-Z/!][^>]*\Z", rest) else rest)
        if link:
            linked.append(parts[-1])
    close()
    held: dict[int, float] = {}
    for _, words, links, _, _, marks in found:
        for k in marks:
            held[k] = held.get(k, 0) + words * (1 - links)
    total = sum(words * (1 - links) for _, words, links, *_ in found)
    void = {k for k, n in held.items() if n > MOST * total}
    return [(t, w, d, int(b or any(k not in void for k in marks)), a if a else -1 if has_article else 0) for t, w, d, b, a, marks in found]


def grow(rows: list[tuple], depth: int = 6) -> tuple | float:
    """A decision tree: (feature, threshold, tree at most it, tree above it), or the share of main text in a leaf."""
    share = sum(r[-1] for r in rows) / len(rows)
    if not depth or share in (0, 1):
        return share
    gini = lambda part: len(part) * (p := sum(r[-1] for r in part) / len(part)) * (1 - p) if part else 0.0
    best = None
    for f in range(len(FEATURES)):
        values = sorted({r[f] for r in rows})
        for a, b in zip(values[:-1], values[1:], strict=True):
            cut = (a + b) / 2
            left, right = [r for r in rows if r[f] <= cut], [r for r in rows if r[f] > cut]
            if best is None or gini(left) + gini(right) < best[0] - 1e-12:
                best = gini(left) + gini(right), f, cut, left, right
    if best is None:
        return share
    return best[1], best[2], grow(best[3], depth - 1), grow(best[4], depth - 1)


def decide(tree: tuple | float, row: tuple) -> bool:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree >= 0.5


def main_text(page: str | None, tree: tuple | float) -> str:
    found = blocks(page or "")
    kept = []
    for k, (text, words, links, boilerplate, article) in enumerate(found):
        before, after = found[k - 1] if k else ("", 0, 0.0), found[k + 1] if k + 1 < len(found) else ("", 0, 0.0)
        if decide(tree, (words, links, before[1], before[2], after[1], after[2], boilerplate, article)):
            kept.append(text)
    return " ".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row."""
    tree = grow(list(LABELLED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(0, batch.num_rows, 200):
                part = batch.slice(row, 200)
                texts = [main_text(h.as_py(), tree) for h in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
