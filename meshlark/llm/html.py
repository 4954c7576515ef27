"""Main text of web pages: flat text blocks, kept or dropped by a decision tree.

A block's features are its words and link density, those of the blocks before and after it, and what the elements
around it say of themselves. The tree is fitted on the small labelled table below.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|textarea|iframe|xmp)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][\w:-]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>",
    re.S | re.I,
)
_ATTR = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Elements that end a block of text (and an open paragraph), elements without content, elements whose content is not shown as text, and what may stand in a head.
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
UNSHOWN = set("head noscript template svg math object select audio video canvas".split())
HEAD = set("base link meta noscript script style template title head html".split())
#: What an opening element closes, and where the search for it ends.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "a": ({"a"}, {"td", "th", "table"})}
HEADINGS = {f"h{k}" for k in range(1, 7)}
BOILER_TAGS = set("nav footer aside form menu dialog button fieldset".split())
BOILER_ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words in class and id names of parts that are not the article.
BOILER_WORDS = set(
    "ad ads adbox advert adverts advertisement advertising adsense sponsor sponsored promo promoted promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead topbar comment comments commentlist reply replies respond disqus discussion "
    "share sharing social related recommended recommendations newsletter subscribe subscription signup login cookie cookies consent gdpr popup modal overlay pagination pager copyright widget widgets toolbar notice notices notification alert banner form".split()
)
COMMENT_WORDS = set("comment comments reply replies".split())
WEAK_WORDS = set("header side search tags legal disclaimer meta".split())
CONTENT_WORDS = set("article post entry content story main body text".split())
NOT_PARTS = set("has with no without".split())

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "boiler", "article", "heading")
#: The labelled table: the features above and whether the block belongs to the article.
LABELLED = [
    # outside any article element, nothing said: long text without links stays, short or linked text goes
    (45, 0.0, 30, 0.0, 60, 0.0, 0, 0, 0, 1), (80, 0.02, 9, 0.0, 12, 0.0, 0, 0, 0, 1), (25, 0.0, 40, 0.05, 35, 0.0, 0, 0, 0, 1), (18, 0.0, 50, 0.0, 44, 0.0, 0, 0, 0, 1), (120, 0.1, 0, 0.0, 0, 0.0, 0, 0, 0, 1),
    (7, 0.0, 60, 0.0, 55, 0.0, 0, 0, 0, 1), (5, 0.0, 33, 0.0, 80, 0.0, 0, 0, 0, 1), (9, 0.0, 0, 0.0, 70, 0.0, 0, 0, 1, 1), (4, 0.0, 50, 0.0, 40, 0.0, 0, 0, 1, 1), (30, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 1),
    (1, 1.0, 1, 1.0, 1, 1.0, 0, 0, 0, 0), (2, 1.0, 0, 0.0, 1, 1.0, 0, 0, 0, 0), (12, 0.9, 3, 1.0, 10, 0.8, 0, 0, 0, 0), (40, 0.8, 12, 0.7, 20, 0.9, 0, 0, 0, 0), (6, 0.6, 4, 1.0, 50, 0.0, 0, 0, 0, 0),
    (3, 0.0, 2, 1.0, 2, 1.0, 0, 0, 0, 0), (5, 0.0, 1, 1.0, 6, 0.0, 0, 0, 0, 0), (4, 0.5, 6, 0.0, 0, 0.0, 0, 0, 0, 0), (6, 0.0, 5, 0.0, 0, 0.0, 0, 0, 0, 0), (8, 0.7, 70, 0.0, 4, 1.0, 0, 0, 0, 0),
    # inside an article element, nothing said: all stays, links included
    (45, 0.0, 30, 0.0, 60, 0.0, 0, 1, 0, 1), (3, 0.0, 4, 0.0, 9, 0.0, 0, 1, 0, 1), (2, 0.0, 0, 0.0, 0, 0.0, 0, 1, 0, 1), (6, 0.0, 1, 1.0, 20, 0.0, 0, 1, 1, 1), (1, 0.0, 90, 0.0, 1, 0.0, 0, 1, 0, 1),
    (10, 0.0, 8, 0.0, 90, 0.0, 0, 1, 1, 1), (30, 0.4, 20, 0.0, 10, 0.0, 0, 1, 0, 1), (5, 1.0, 40, 0.0, 60, 0.0, 0, 1, 0, 1), (12, 0.0, 8, 0.0, 0, 0.0, 0, 1, 0, 1), (150, 0.1, 5, 0.0, 7, 0.0, 0, 1, 0, 1),
    (2, 1.0, 3, 1.0, 2, 1.0, 0, 1, 0, 1), (8, 0.9, 9, 0.0, 70, 0.0, 0, 1, 0, 1), (70, 0.8, 30, 0.0, 20, 0.0, 0, 1, 0, 1), (4, 0.0, 3, 0.0, 2, 0.0, 0, 1, 0, 1),
    (5, 0.0, 0, 0.0, 0, 0.0, 0, 1, 0, 1), (5, 0.0, 0, 0.0, 0, 0.0, 0, 1, 1, 1), (7, 0.0, 80, 0.0, 0, 0.0, 0, 1, 0, 1), (4, 0.0, 3, 0.0, 0, 0.0, 0, 1, 0, 1), (9, 0.0, 6, 1.0, 0, 0.0, 0, 1, 1, 1),
    (6, 0.0, 5, 0.0, 0, 0.0, 0, 1, 0, 1), (8, 0.7, 70, 0.0, 4, 1.0, 0, 1, 0, 1), (1, 1.0, 1, 1.0, 1, 1.0, 0, 1, 0, 1), (2, 1.0, 0, 0.0, 1, 1.0, 0, 1, 0, 1), (3, 0.0, 2, 1.0, 2, 1.0, 0, 1, 0, 1), (6, 0.6, 4, 1.0, 50, 0.0, 0, 1, 0, 1),
    (5, 0.0, 1, 1.0, 6, 0.0, 0, 1, 0, 1), (12, 0.9, 3, 1.0, 10, 0.8, 0, 1, 0, 1), (4, 0.5, 6, 0.0, 0, 0.0, 0, 1, 0, 1), (3, 0.0, 0, 0.0, 0, 0.0, 0, 1, 0, 1), (40, 0.8, 12, 0.7, 20, 0.9, 0, 1, 0, 1),
    # outside an article, last on the page: what follows unlinked text stays, and so does a heading
    (7, 0.0, 80, 0.0, 0, 0.0, 0, 0, 0, 1), (4, 0.0, 25, 0.0, 0, 0.0, 0, 0, 0, 1), (9, 0.0, 14, 0.0, 0, 0.0, 0, 0, 0, 1), (5, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1, 1), (6, 0.0, 5, 0.0, 0, 0.0, 0, 0, 1, 1), (3, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0), (4, 0.0, 3, 1.0, 0, 0.0, 0, 0, 0, 0),
    (1, 0.0, 12, 0.0, 0, 0.0, 0, 0, 0, 1), (2, 0.0, 40, 0.0, 50, 0.0, 0, 0, 0, 1), (3, 0.0, 60, 0.02, 9, 0.0, 0, 0, 0, 1), (2, 0.0, 15, 0.0, 0, 0.0, 0, 0, 0, 1), (3, 0.0, 25, 0.0, 3, 0.0, 0, 0, 0, 1), (1, 0.0, 2, 0.0, 1, 1.0, 0, 0, 0, 0), (2, 0.0, 3, 0.0, 0, 0.0, 0, 0, 0, 0),
    # within a part that says it is something else: all goes, long text and headings included
    (45, 0.0, 30, 0.0, 60, 0.0, 1, 0, 0, 0), (9, 0.0, 6, 1.0, 12, 0.0, 1, 0, 0, 0), (1, 1.0, 1, 1.0, 1, 1.0, 1, 0, 0, 0), (120, 0.0, 40, 0.0, 0, 0.0, 1, 0, 0, 0), (5, 0.0, 90, 0.0, 0, 0.0, 1, 0, 1, 0),
    (45, 0.0, 30, 0.0, 60, 0.0, 1, 1, 0, 0), (9, 0.0, 50, 0.0, 12, 0.0, 1, 1, 0, 0), (3, 1.0, 60, 0.0, 70, 0.0, 1, 1, 0, 0), (100, 0.0, 80, 0.0, 60, 0.0, 1, 1, 0, 0), (4, 0.0, 90, 0.0, 30, 0.0, 1, 1, 1, 0),
    (20, 0.2, 10, 0.1, 0, 0.0, 1, 1, 0, 0), (2, 0.0, 2, 0.0, 2, 0.0, 1, 0, 0, 0), (30, 0.0, 2, 1.0, 3, 1.0, 1, 0, 1, 0), (8, 0.0, 0, 0.0, 45, 0.0, 1, 0, 0, 0),
]


def fit_tree(rows: np.ndarray, depth: int = 10) -> tuple | int:
    """(feature, threshold, tree at most, tree above) by Gini impurity, or a class."""
    x, y = rows[:, :-1], rows[:, -1].astype(int)
    if depth == 0 or y.min() == y.max():
        return int(y.mean() >= 0.5)
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= cut
            cost = sum(len(p) * p.mean() * (1 - p.mean()) for p in (y[low], y[~low]))
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, float(cut), low)
    if best is None:
        return int(y.mean() >= 0.5)
    _, f, cut, low = best
    return f, cut, fit_tree(rows[low], depth - 1), fit_tree(rows[~low], depth - 1)


@functools.cache
def tree() -> tuple | int:
    return fit_tree(np.array(LABELLED, dtype=float))


def _classify(node: tuple | int, x: tuple) -> int:
    while not isinstance(node, int):
        node = node[2] if x[node[0]] <= node[1] else node[3]
    return node


def _says(tag: str, attrs: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element says that it is no part of the article, and whether it is not shown."""
    boiler, unseen = tag in BOILER_TAGS or (tag == "header" and not in_article), tag in UNSHOWN
    for name, *value in _ATTR.findall(attrs):
        name, given = name.lower(), "".join(value)
        if name == "hidden" or (name == "aria-hidden" and given.lower() == "true") or (name == "style" and _UNSEEN.search(given)):
            unseen = True
        elif name in ("class", "id", "role") and tag not in ("html", "body"):
            names = {x for x in re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", given).lower()) if x}
            if name == "role":
                boiler = boiler or bool(names & BOILER_ROLES)
            elif tag in ("main", "article"):
                boiler = boiler or bool(names & COMMENT_WORDS)
            elif not names & NOT_PARTS and (names & BOILER_WORDS or (names & WEAK_WORDS and not names & CONTENT_WORDS)):
                boiler = True
    return boiler, unseen


def blocks(page: str) -> list[tuple[str, int, float, int, int, int]]:
    """The text blocks of a page in order: text, words, link density, boiler, article, heading.

    Elements that may be left open (p, li, td, head ...) end where HTML ends them; an end tag without its element says nothing.
    """
    out: list[tuple] = []
    text: list[str] = []
    linked = 0
    top = ("", False, False, False, False, False)  # tag, boiler, article, unseen, link, heading
    stack, count = [top], Counter()

    def flush() -> None:
        nonlocal linked
        raw = html.unescape("".join(text))
        words = raw.split()
        if words:
            out.append((" ".join(words), len(words), min(1.0, linked / len(raw)), int(top[1]), int(top[2]), int(top[5])))
        text.clear()
        linked = 0

    def close(k: int) -> None:
        """Ends the elements from place k of the stack on."""
        nonlocal top
        if any(e[0] in BLOCKS for e in stack[k:]) or stack[-1][1:4] != stack[k - 1][1:4]:
            flush()
        count.subtract(e[0] for e in stack[k:])
        del stack[k:]
        top = stack[-1]

    def close_open(tags: set[str], within: set[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in tags:
                return close(k)
            if stack[k][0] in within:
                return None
        return None

    def put(part: str) -> None:
        nonlocal linked
        if not top[3]:
            text.append(part)
            linked += len(part) if top[4] else 0

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            put(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag, attrs = tag.lower(), m["attrs"]
        if m["end"]:
            if count[tag] > 0:
                close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag))
            elif tag in BLOCKS:
                flush()
            continue
        if count["head"] > 0 and tag not in HEAD:
            close_open({"head"}, set())
        if tag in BLOCKS:
            if count["p"] > 0:
                close_open({"p"}, {"td", "th", "table", "caption", "button"})
            flush()
        if tag in CLOSES and any(count[x] > 0 for x in CLOSES[tag][0]):
            close_open(*CLOSES[tag])
        if tag in VOID:
            if tag in ("br", "img", "input"):
                put(" ")
        elif not re.search(r"(?:^|[\s\"'])/\Z", attrs):
            boiler, unseen = _says(tag, attrs, top[2])
            new = (tag, top[1] or boiler, top[2] or tag in ("article", "main"), top[3] or unseen, top[4] or tag == "a", top[5] or tag in HEADINGS)
            if new[1:4] != top[1:4]:
                flush()
            stack.append(new)
            count[tag] += 1
            top = new
    if at < len(page):
        rest = page[at:]
        put(rest[: rest.find("<")] if re.search(r"<[a-zA-Z/!][^>]*\Z", rest) else rest)
    flush()
    return out


def main_text(page: str) -> str:
    found = blocks(page)
    kept = []
    for i, (text, words, links, boiler, article, heading) in enumerate(found):
        before = found[i - 1][1:3] if i else (0, 0.0)
        after = found[i + 1][1:3] if i + 1 < len(found) else (0, 0.0)
        if _classify(tree(), (words, links, *before, *after, boiler, article, heading)):
            kept.append(text)
    return " ".join(kept)


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """keep columns, text and n_chars of every page. A null page, or one without an article, gives empty text; repeated rows are pages of their own.

    Keep columns may be null and have any name but text, n_chars and _html; other columns of pages play no part.
    """
    rows = pages.select(*keep, F.coalesce(F.col(html_col), F.lit("")).alias("_html"))
    schema = rows.select(*keep).withColumn("text", F.lit("")).withColumn("n_chars", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [main_text(x.as_py()) for x in batch.column("_html")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], names=[*keep, "text", "n_chars"])

    return rows.mapInArrow(run, schema)
