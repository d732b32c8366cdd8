"""Main text of web pages: a page is cut into flat blocks of text, and a decision tree tells article from the rest.

A block is what stands between two block-level tags. It is judged by its words and the share of them that are links, by
those of the blocks before and after it, and by where its markup puts it: inside an element that by tag, role, class
or id is menu, advert, comment or the like, inside an article, in a heading, in a paragraph. The tree is grown from the
labelled table below each time, which takes milliseconds, and goes to the tasks as a handful of numbers.
"""

from __future__ import annotations

import html as markup
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_batch, rows, short_batches, texts

BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup p pre search section summary table tbody td tfoot th thead tr ul".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
UNSEEN = frozenset("audio button canvas datalist head noscript object select svg template video".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = HEADINGS | frozenset("p blockquote pre figcaption".split())
# Tags whose start ends an element that is still open on top.
CLOSES = {t: frozenset({"p"}) for t in BLOCKS} | {"li": frozenset({"p", "li"}), "dd": frozenset({"p", "dd", "dt"}), "dt": frozenset({"p", "dd", "dt"}), "td": frozenset({"p", "td", "th"}), "th": frozenset({"p", "td", "th"}), "tr": frozenset({"p", "td", "th", "tr"})}
ASIDE = frozenset("nav footer aside dialog menu search".split())
ASIDE_ROLES = frozenset("navigation contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
# Words in a class or an id: what is beside an article, what is on top of a page, what holds an article.
BESIDE = frozenset("nav navbar navigation menu submenu breadcrumb breadcrumbs pagination pager footer copyright sidebar aside widget widgets related recommended recommendations trending popular share sharing social follow ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion promoted cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login form search comment comments reply replies respond responses discussion disqus feedback banner notification notifications announcement toc tags tagcloud".split())
ON_TOP = frozenset("header masthead topbar".split())
HOLDS = frozenset("article content entry main post story".split())
NOT_ITSELF = re.compile(r"(?:^|[-_])(?:has|with|no|open|closed|without)(?:[-_]|$)")

_TAG = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/>]*+)|([!?/]))")
_ATTRIBUTE = re.compile(r"""[\s/]*+(?:([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>]*+)))?)?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _marks(attributes: dict[str, str]) -> tuple[bool, bool, bool]:
    """(beside, on top, holds) as an element's attributes tell."""
    names = [n for n in f"{attributes.get('class', '')} {attributes.get('id', '')}".split() if not NOT_ITSELF.search(n)]
    said = {w.lower() for n in names for w in _WORD.findall(n)} | {w for n in names for w in re.split(r"[-_]", n.lower())}
    role = attributes.get("role", "").strip().lower()
    unseen = "hidden" in attributes or attributes.get("aria-hidden", "").strip().lower() == "true" or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", ""), re.I))
    return bool(said & BESIDE) or role in ASIDE_ROLES or unseen, bool(said & ON_TOP) or role == "banner", bool(said & HOLDS) or role in ("main", "article")


def _entered(name: str, attributes: dict[str, str], state: tuple) -> tuple:
    """(beside, form, article, unseen) inside an element."""
    beside, form, article, unseen = state
    if name in ("html", "body"):
        return state
    marked, on_top, holds = _marks(attributes) if attributes else (False, False, False)
    if name in ("article", "main"):
        # An article's own class says what it holds ("post with-sidebar"); one among comments is still a comment.
        return beside or (marked and not holds), False, True, unseen
    on_top = (on_top or name == "header") and not holds and not article
    return beside or marked or on_top or name in ASIDE, form or name == "form", article or holds, unseen or name in UNSEEN


def blocks(page: str) -> list[tuple]:
    """(text, words, linked words, beside, article, heading, prose) of each block with text, in page order. Linear in
    the page's length, whatever is left open in it."""
    out, text, linked = [], [], []
    stack, opened = [("", (False, False, False, False))], {}
    link = 0  # depth at which a link was opened
    pos, end = 0, len(page)

    def flush():
        name, (beside, form, article, unseen) = stack[-1]
        if text and not unseen:
            words = "".join(text).split()
            if words:
                out.append((" ".join(words), len(words), min(len("".join(linked).split()), len(words)), beside or form, article, name in HEADINGS, name in PROSE))
        text.clear()
        linked.clear()

    def leave(name):
        nonlocal link
        while True:
            top, _ = stack.pop()
            opened[top] -= 1
            if top == name:
                break
        if len(stack) < link:
            link = 0

    def say(raw):
        if "&" in raw:
            raw = markup.unescape(raw)
        text.append(raw)
        if link:
            linked.append(raw)

    while pos < end:
        m = _TAG.search(page, pos)
        if m is None:
            say(page[pos:])
            break
        if m.start() > pos:
            say(page[pos : m.start()])
        pos = m.end()
        if m[1] or m[4]:
            # A comment, or a declaration that ends at the next >.
            close = page.find("-->" if m[1] else ">", pos - 2 if m[1] else pos)
            pos = end if close < 0 else close + (3 if m[1] else 1)
            continue
        name, attributes = m[3].lower(), {}
        while page[pos : pos + 1] != ">":
            a = _ATTRIBUTE.match(page, pos)
            pos = a.end()
            if a[1]:
                attributes.setdefault(a[1].lower(), markup.unescape(a[2] or a[3] or a[4] or ""))
            elif pos >= end:
                break
            elif page[pos] != ">":
                pos += 1
        pos += 1
        if pos > end:
            break  # a tag that never ends is no text
        block = name in BLOCKS
        if m[2]:
            if block or name in UNSEEN:
                flush()
            if opened.get(name):
                leave(name)
            if name == "a":
                link = 0
            continue
        if name in RAW:
            close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, pos)
            pos = close.start() if close else end
            continue
        if block:
            flush()
            while stack[-1][0] in CLOSES[name]:
                leave(stack[-1][0])
            if name != "hr":
                stack.append((name, _entered(name, attributes, stack[-1][1])))
                opened[name] = opened.get(name, 0) + 1
        elif name in UNSEEN:
            flush()
            stack.append((name, _entered(name, attributes, stack[-1][1])))
            opened[name] = opened.get(name, 0) + 1
        elif name == "a":
            link = len(stack)
        elif name == "br":
            say(" ")
    flush()
    return out


FEATURES = ("density", "beside", "article", "words", "prose", "heading", "before", "density_before", "after", "density_after")
# Blocks labelled by hand, a line each, pages parted by empty lines: words, linked words, beside, article,
# heading, prose, and whether the block belongs to the main text.
LABELLED = """
1 1 1 0 0 0 0
2 2 1 0 0 0 0
1 1 1 0 0 0 0
9 0 1 0 0 0 0
8 0 0 1 1 1 1
24 0 0 1 0 1 1
70 2 0 1 0 1 1
1 0 0 1 0 1 1
110 0 0 1 0 1 1
6 0 1 0 0 0 0

1 1 1 0 0 0 0
30 0 1 0 0 0 0
5 0 0 1 1 1 1
2 0 0 1 0 1 1
8 1 1 0 0 0 0

3 0 1 0 1 1 0
1 1 1 0 0 0 0
12 0 0 1 1 1 1
160 6 0 1 0 1 1
4 0 0 1 1 1 1
7 0 0 1 0 0 1
3 0 0 1 0 0 1
11 4 0 1 0 0 1
1 0 0 1 0 0 1
45 12 0 1 0 1 1
14 0 0 1 0 1 1
9 9 0 1 0 0 0
8 8 0 1 0 0 0
7 7 0 1 0 0 0
38 0 1 1 0 1 0
52 1 1 1 0 1 0
6 2 1 0 0 0 0

2 2 0 0 0 0 0
1 1 0 0 0 0 0
1 1 0 0 0 0 0
2 2 0 0 0 0 0
7 0 0 0 1 1 1
48 0 0 0 0 1 1
85 3 0 0 0 1 1
3 0 0 0 0 1 1
62 5 0 0 0 1 1
5 0 0 0 1 1 1
33 0 0 0 0 1 1
1 1 0 0 0 0 0
1 1 0 0 0 0 0
10 10 0 0 0 1 0
12 11 0 0 0 0 0
9 0 0 0 0 0 0
7 2 0 0 0 0 0

1 1 0 0 0 0 0
3 2 0 0 0 0 0
95 0 0 0 0 0 1
130 4 0 0 0 0 1
41 1 0 0 0 0 1
20 18 0 0 0 0 0
6 4 0 0 0 0 0
5 0 0 0 0 0 0

4 4 1 0 0 0 0
6 0 0 0 1 1 1
15 0 0 0 0 1 1
12 0 0 0 0 1 1
4 0 0 0 0 1 1
60 0 1 0 0 1 0
44 0 1 0 0 0 0
120 3 1 0 0 1 0

25 0 1 0 0 1 0
2 0 1 0 0 0 0
10 0 0 1 1 1 1
55 55 0 1 0 1 0
210 9 0 1 0 1 1
30 0 0 1 0 1 1
18 0 1 1 0 0 0
6 0 1 1 1 1 0
90 0 0 1 0 0 1
3 3 0 1 0 1 0
16 1 1 0 0 1 0

3 0 0 1 1 1 1
1 0 0 1 0 1 1

6 0 0 0 1 1 1
35 0 0 0 0 1 1
2 0 0 0 0 1 1

1 0 0 1 0 1 1

1 1 1 0 0 0 0
18 0 0 0 0 1 1

2 2 0 0 0 0 0
3 3 0 0 0 0 0
2 2 0 0 0 0 0
4 0 0 0 0 0 0

75 2 0 0 0 0 1

1 0 0 1 0 1 1
1 0 0 1 0 1 1
2 0 0 1 0 0 1
5 1 1 0 0 0 0

1 1 0 1 0 0 0
2 0 0 1 0 0 1
5 0 0 1 0 1 1
3 3 0 1 0 0 0
3 0 0 1 1 1 1
1 0 0 1 0 1 1
4 4 0 1 0 0 0
4 4 0 1 0 0 0
2 0 0 1 0 0 1
9 3 0 1 0 0 1

5 0 1 0 0 0 0
12 2 0 1 0 0 1
3 3 0 1 0 0 0
6 0 0 1 0 1 1

22 12 1 0 0 0 0
5 1 0 1 1 1 1
10 1 0 1 0 1 1
6 1 0 1 0 1 1
4 2 0 1 0 1 1
3 1 0 1 0 0 1
30 8 1 0 0 1 0
14 3 1 1 0 1 0
18 6 0 1 0 1 1
5 5 0 1 0 0 0
40 10 1 0 0 0 0
4 1 1 0 0 0 0

26 7 1 0 0 1 0
8 1 0 0 1 1 1
20 4 0 0 0 1 1
9 1 0 0 0 1 1
5 2 0 0 0 0 0

2 2 0 1 0 0 0
80 0 0 1 0 0 1
35 1 0 1 0 0 1

4 4 0 0 0 0 0
60 1 0 0 0 0 1
25 0 0 0 0 0 1

6 6 0 0 0 0 0
90 2 0 0 0 0 1
4 0 0 0 0 0 1
70 0 0 0 0 0 1
7 0 0 0 0 0 1
55 3 0 0 0 0 1
6 0 0 0 0 0 0

2 2 0 0 0 0 0
3 0 0 0 0 1 0
1 1 0 0 0 0 0
1 1 0 0 0 0 0
4 0 0 0 0 1 0
3 3 0 0 0 0 0
2 0 0 0 0 0 0
1 0 0 0 0 0 0
4 0 0 0 0 0 0
10 0 0 0 1 1 1
66 4 0 0 0 1 1
34 0 0 0 0 1 1
2 0 0 0 0 0 0
6 6 0 0 0 0 0
7 7 0 0 0 0 0
3 0 0 0 0 0 0
5 0 0 0 0 0 0
8 1 0 0 0 0 0
"""


def labelled() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the table."""
    pages = [[[int(v) for v in line.split()] for line in page.splitlines()] for page in LABELLED.strip().split("\n\n")]
    table = np.array([r for p in pages for r in p])
    return features(table[:, :6], np.repeat(np.arange(len(pages)), [len(p) for p in pages])), table[:, 6] == 1


def features(found: np.ndarray, page: np.ndarray) -> np.ndarray:
    """A row for each block of found (words, linked, beside, article, heading, prose) by page; beyond a page's ends stand
    0 words and no links."""
    words, density = found[:, 0].astype(float), found[:, 1] / np.maximum(found[:, 0], 1)
    out = np.zeros((len(found), len(FEATURES)))
    beside, article, heading, prose = found[:, 2:6].T
    out[:, :6] = np.stack([density, beside, article, words, prose, heading], axis=1)
    same = np.flatnonzero(page[1:] == page[:-1])
    out[same + 1, 6], out[same + 1, 7] = words[same], density[same]
    out[same, 8], out[same, 9] = words[same + 1], density[same + 1]
    return out


class Tree:
    """A binary decision tree grown by Gini impurity; of equal splits the first feature and the lowest threshold count."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 2):
        self.nodes: list[list] = []  # feature, threshold, left, right, share of true
        self._grow(x, y, depth, least)
        self.table = np.array(self.nodes, float)

    def _grow(self, x, y, depth, least) -> int:
        at = len(self.nodes)
        self.nodes.append([-1, 0.0, at, at, float(y.mean())])
        best = (y.mean() * (1 - y.mean()) * len(y) - 1e-9, None, None)
        for f in range(x.shape[1]) if depth and 0 < y.mean() < 1 else ():
            order = np.argsort(x[:, f], kind="stable")
            v, c = x[order, f], np.cumsum(y[order])
            cut = np.flatnonzero(v[1:] > v[:-1]) + 1
            cut = cut[(cut >= least) & (len(v) - cut >= least)]
            if len(cut):
                n, true, rest = cut, c[cut - 1], c[-1] - c[cut - 1]
                impurity = true * (n - true) / n + rest * (len(v) - n - rest) / (len(v) - n)
                k = int(impurity.argmin())
                if impurity[k] < best[0] - 1e-9:
                    best = (impurity[k], f, (v[cut[k] - 1] + v[cut[k]]) / 2)
        if best[1] is not None:
            low = x[:, best[1]] <= best[2]
            self.nodes[at][:2] = best[1:]
            self.nodes[at][2] = self._grow(x[low], y[low], depth - 1, least)
            self.nodes[at][3] = self._grow(x[~low], y[~low], depth - 1, least)
        return at

    def share(self, x: np.ndarray) -> np.ndarray:
        """The share of true labels in the leaf of each row."""
        at = np.zeros(len(x), np.int64)
        while True:
            feature = self.table[at, 0].astype(np.int64)
            inner = np.flatnonzero(feature >= 0)
            if not len(inner):
                return self.table[at, 4]
            low = x[inner, feature[inner]] <= self.table[at[inner], 1]
            at[inner] = np.where(low, self.table[at[inner], 2], self.table[at[inner], 3]).astype(np.int64)


def trained() -> Tree:
    return Tree(*labelled())


def main_texts(pages: list[str], tree: Tree) -> list[str]:
    found = [blocks(p) for p in pages]
    flat = [b for f in found for b in f]
    if not flat:
        return [""] * len(pages)
    number = np.repeat(np.arange(len(pages)), [len(f) for f in found])
    keep = tree.share(features(np.array([b[1:] for b in flat], float), number)) > 0.5
    out: list[list[str]] = [[] for _ in pages]
    for k in np.flatnonzero(keep).tolist():
        out[number[k]].append(flat[k][0])
    return ["\n".join(t) for t in out]


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages (page_id, url, html); null html is empty and gives an empty
    text. Rows are judged one by one, so that equal pages give equal texts. Other columns are not read; an empty table
    gives no rows. What is never closed holds up to the end of the page; a tag, comment, script or style that never ends
    hides what follows it."""
    short_batches(pages.sparkSession)
    tree = trained()
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = main_texts(texts(batch, "html"), tree)
        schema = pa.schema([batch.schema.field("page_id"), batch.schema.field("url"), ("text", pa.string()), ("n_chars", pa.int64())])
        return rows(schema, batch.column("page_id"), batch.column("url"), found, [len(t) for t in found])

    return pages.select("page_id", "url", "html").mapInArrow(by_batch(run), f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
