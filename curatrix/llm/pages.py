"""Main text of web pages: flat text blocks classified by a decision tree.

A page is flattened to text blocks (what lies between block-level tags). Each block has its number of
words and the share of them inside links, the same of the blocks before and after it, and where it stands: in
an article element (or in none while the page has one), in a region that by its element or its whole name (of
class, id or role) is a menu, header, footer, sidebar, notice, advert, form or the readers' comments, in
something of which one word of the name says so, in a heading. All of these are features; a small decision
tree, grown on a labelled table of blocks from pages of several kinds, tells article text from the rest.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from curatrix.llm import common

#: Elements whose content is no text of the page and no markup; they run on to their end tag. Fixed values.
SILENT = "script|style|iframe|title|textarea"
#: Elements whose content is no text of the page; without an end tag only the tag itself is left out. Fixed values.
SOFT = frozenset("noscript template svg object canvas audio video select datalist button annotation annotation-xml".split())
#: Elements that stay inside a block; all others end it. Fixed values.
INLINE = frozenset(
    """a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br
    math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom menclose msub msup msubsup munder mover munderover
    mmultiscripts mprescripts mtable mtr mtd mlabeledtr maction semantics""".split()
)
#: Elements that are open until they are closed, so that what is in them stands in a region. Fixed values.
REGIONS = frozenset("article main section div nav header footer aside form fieldset dialog menu ul ol dl table figure details blockquote body".split())
ASIDE = frozenset("nav header footer aside form fieldset dialog menu".split())
#: Words of class, id and role attributes that mark a region as no article text. Fixed values.
MARKS = frozenset(
    """ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar nav navbar
    navigation menu breadcrumb breadcrumbs footer header masthead cookie cookies consent gdpr notice notices alert popup
    modal overlay comment comments disqus respond replies discussion share sharing social related recommended
    newsletter subscribe signup login search pagination pager toolbar widget complementary contentinfo form responses
    reactions feedback disclaimer topbar adbox adslot adunit adsense cta""".split()
)
#: Words that make a name speak of a layout, not of a region. Fixed values.
LAYOUT = frozenset("has with without no is not".split())
#: Words that may stand beside such a word in a name of a region. Fixed values.
BESIDE = frozenset(
    """box list container wrapper wrap inner outer section area block unit slot panel module thread item items link links button
    buttons bar left right top bottom inline post posts article articles story stories form header site page global primary
    secondary mobile desktop sticky user users reader readers visitor visitors entry""".split()
)
#: Words that, as an id inside an article, name a section of its text as well as they name a region. Fixed values.
TOPICS = frozenset("discussion reactions responses feedback search notice notices alert navigation menu social sharing share banner form consent disclaimer promotion advertising".split())

# possessive parts: a tag that never ends costs no second look
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<silent>{SILENT})(?=[\s/>])(?:[^>]*+(?<=/)>|[^>]*+>.*?(?:</(?P=silent)\s*+>|\Z))"
    r"|<option(?=[\s/>])[^>]*+>[^<]*+"  # any tag ends it
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*+)(?P<attrs>(?:\"[^\"]*+\"|'[^']*+'|[^>\"'])*+)>|<(?=[a-z!?/])[^>]*+>",
    re.S | re.I,
)
_CLOSE = {tag: re.compile(rf"</{tag}\s*+>", re.I) for tag in SOFT}
_LOOSE = re.compile(r"<[a-z/!?]", re.I)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)


@dataclass
class Block:
    text: str
    words: int
    linked: int
    article: bool
    region: bool
    hint: bool
    heading: bool

    @property
    def density(self) -> float:
        return self.linked / self.words


def _said(name: str, kind: str, inside: bool) -> tuple[bool, bool]:
    """Whether a class, id or role as a whole names such a region, and whether a word of it does."""
    words = [w for w in re.split(r"[^a-z0-9]+", name) if w]
    if not words or LAYOUT & set(words):
        return False, False
    hint = bool(set(words) & MARKS)
    if hint and inside and kind == "id" and len(words) == 1 and words[0] in TOPICS:
        return False, False
    return hint and set(words) <= MARKS | BESIDE, hint


def _place(tag: str, attrs: str, inside: bool) -> tuple[bool, bool]:
    """(region, hint) of an element; ``inside`` an article."""
    if tag in ASIDE:
        return True, True
    if not attrs.strip():
        return False, False
    if _HIDDEN.search(attrs):
        return True, True
    if tag in ("body", "main", "article"):  # their classes describe the layout
        return False, False
    said = [_said(name, m[1].lower(), inside) for m in _ATTR.finditer(attrs) for name in m[2].lower().strip("\"'").split()]
    return any(r for r, _ in said), any(h for _, h in said)


def blocks(page: str | None) -> list[Block]:
    """The text blocks of a page in its order. Null: none."""
    page = page or ""
    out: list[Block] = []
    open_regions: list[tuple[str, bool, bool, bool]] = []  # element, in an article, in a region, in what may be one
    pieces: list[str] = []
    linked: list[str] = []
    in_link = heading = False

    def flush() -> None:
        text = " ".join(entities.unescape("".join(pieces)).split())
        if text:
            _, article, region, hint = open_regions[-1] if open_regions else ("", False, False, False)
            n = len(text.split())
            out.append(Block(text, n, min(n, len(entities.unescape("".join(linked)).split())), article, region, hint, heading))
        pieces.clear(), linked.clear()

    def text(s: str) -> None:
        if s:
            pieces.append(s)
            if in_link:
                linked.append(s)

    # a tag that is cut off at the end of the page is no text
    tail = page.rfind(">") + 1
    if loose := _LOOSE.search(page, tail):
        page = page[: loose.start()]
    at = 0
    unclosed: set[str] = set()
    while m := _TOKEN.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag in SOFT:
            if not m["end"] and not m["attrs"].endswith("/") and tag not in unclosed:
                if close := _CLOSE[tag].search(page, at):
                    at = close.end()
                else:
                    unclosed.add(tag)
            continue
        if tag in INLINE:
            if tag == "br":
                text(" ")
            elif tag == "a":
                in_link = not m["end"]
                if linked:
                    linked.append(" ")
            continue
        flush()
        in_link = False
        heading = bool(re.fullmatch(r"h[1-6]", tag)) and not m["end"]
        if tag not in REGIONS:
            continue
        if not m["end"]:
            _, article, region, hint = open_regions[-1] if open_regions else ("", False, False, False)
            own_region, own_hint = _place(tag, m["attrs"] or "", article)
            text_begins = tag in ("article", "main")  # a name around it says nothing of what is in it
            open_regions.append((tag, article or text_begins, own_region or (region and tag != "main"), own_hint or own_region or (hint and not text_begins)))
        else:
            for i in range(len(open_regions) - 1, -1, -1):
                if open_regions[i][0] == tag:
                    del open_regions[i:]
                    break
    text(page[at:])
    flush()
    return out


FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "article", "region", "hint", "heading")


def features(found: list[Block]) -> np.ndarray:
    """One row a block. ``article``: 1 in one, 0 outside where the page has one, a half where it has none."""
    some = any(b.article and not b.region for b in found)
    own = np.array([(b.words, b.density, b.article if some else 0.5, b.region, b.hint, b.heading) for b in found], np.float64).reshape(-1, 6)
    none = np.zeros((1, 2))
    before, after = np.vstack([none, own[:-1, :2]]), np.vstack([own[1:, :2], none])
    return np.hstack([own[:, :2], before, after, own[:, 2:]])


# ---------------------------------------------------------------- labelled table and tree

PAGES, SEED = 8, 3


def labelled_pages(n: int = PAGES, seed: int = SEED) -> list[tuple[str, str, list[int]]]:
    """``n`` pages of each kind, drawn from rules: kind, html, and for each of its blocks whether it is article text."""
    rng = np.random.default_rng(seed)

    def words(lo: int, hi: int) -> str:
        return " ".join(["word"] * int(rng.integers(lo, hi + 1)))

    def link(lo: int = 1, hi: int = 4) -> str:
        return f'<a href="/x">{words(lo, hi)}</a>'

    def pick(*names: str) -> str:
        return names[int(rng.integers(len(names)))]

    def paragraph(lo: int = 1, hi: int = 120) -> tuple[str, int]:
        inside = f" {link()} {words(1, 20)}" if rng.random() < 0.3 else ""
        return f"<p>{words(lo, hi)}{inside}</p>", 1

    def prose(lo: int = 12, hi: int = 140) -> tuple[str, int]:
        inside = f" {link(1, 5)} {words(3, 20)}" if rng.random() < 0.4 else ""
        return f"<p>{words(lo, hi)}{inside}</p>", 1

    def heading(level: int = 2) -> tuple[str, int]:
        return f"<h{level}>{words(1, 12)}</h{level}>", 1

    def no(html: str) -> tuple[str, int]:
        return html, 0

    def menu() -> list[tuple[str, int]]:
        return [("<nav><ul>", -1), *[no(f"<li>{link(1, 2)}</li>") for _ in range(int(rng.integers(2, 8)))], ("</ul></nav>", -1)]

    def links(n: int) -> list[tuple[str, int]]:
        return [no(f"<div>{link(1, 4)} {link(1, 3)}</div>") for _ in range(n)]

    def inside(around: str, parts: list[tuple[str, int]]) -> list[tuple[str, int]]:
        return [(f"<{around}>", -1), *parts, (f"</{around.split()[0]}>", -1)]

    def zone(*names: str) -> str:
        return f'{pick("div", "section")} {pick("class", "id")}="{pick(*names)}"'

    def bar(around: str, lo: int = 1, hi: int = 40) -> list[tuple[str, int]]:
        return inside(around, [no(p) for p, _ in (paragraph(lo, hi) for _ in range(int(rng.integers(1, 4))))])

    def foot() -> list[tuple[str, int]]:
        return bar("footer", 2, 30)

    def talk() -> list[tuple[str, int]]:
        return inside(zone("comments", "reader-comments", "comments-list", "user-comments", "disqus-thread"), [no(heading()[0]), *[no(paragraph(2, 80)[0]) for _ in range(3)]])

    def advert() -> list[tuple[str, int]]:
        return bar(f'div class="{pick("ad", "ad-box", "sponsored", "promo", "advert", "newsletter-signup", "cookie-notice")}"', 2, 40)

    def body(n: int) -> list[tuple[str, int]]:
        out = [heading(1)]
        for _ in range(n):
            r = rng.random()
            if r < 0.55:
                out.append(paragraph())
            elif r < 0.65:
                out.append(heading())
            elif r < 0.75:
                out += [(f"<li>{words(1, 8)}</li>", 1) for _ in range(2)]
            elif r < 0.9:
                out.append((f"<li>{link(1, 9)}</li>", 1))  # lists of links belong to an article
            else:
                out += inside(f'section {pick("id", "class")}="{pick("public-notice", "share-prices", "search-engines", "feedback-loops", "related-work", "social-history", "ad-hoc")}"', [heading(), paragraph(2), (f"<p>{link(1, 4)} {words(2, 9)}</p>", 1)])
        return out

    def news() -> list[tuple[str, int]]:
        text = body(int(rng.integers(2, 9)))
        text[2:2] = pick("", "x") and advert()
        return menu() + advert() + inside("article", text + (talk() if rng.random() < 0.4 else [])) + links(2) + foot()

    def blog() -> list[tuple[str, int]]:
        around = f'div class="{pick("content-with-sidebar", "page-no-sidebar", "wrap", "site-wrapper", "layout-sidebar-right")}"'
        return menu() + inside(around, inside("main", body(int(rng.integers(2, 7)))) + bar(zone("sidebar", "widget", "sidebar-right"), 1, 60)) + talk() + foot()

    def bare() -> list[tuple[str, int]]:
        text = [heading(1)]
        for _ in range(int(rng.integers(2, 6))):
            text.append(prose())
            if rng.random() < 0.3:
                text += [(f"<p>{words(1, 9)}</p>", 1), prose(), heading(), prose()]
        return links(int(rng.integers(1, 4))) + text + links(int(rng.integers(1, 4))) + [no(f"<p>{words(1, 5)} {link(4, 9)}</p>")]

    def wrapped() -> list[tuple[str, int]]:
        around = f'div class="{pick("content-with-sidebar", "page-no-sidebar", "layout-sidebar-right", "entry-share-above", "post-ads-free")}"'
        hinted = inside(f'div class="{pick("top-navigation-row", "my-footer-row", "page-social-strip", "legal-notice-row")}"', [no(f"<p>{words(1, 9)}</p>"), no(f"<p>{link(2, 6)}</p>"), no(f"<p>{words(2, 6)} {link(1, 3)}</p>")])
        return menu() + inside(around, [heading(1), prose(), prose(), heading(), prose(20), prose()]) + hinted + bar(zone("footer", "site-footer", "sidebar"), 2, 50)

    def forum() -> list[tuple[str, int]]:
        return menu() + inside("article", [heading(1), prose(), paragraph()]) + talk() + talk() + bar("form", 1, 10) + foot()

    out = []
    for kind in (news, blog, bare, wrapped, forum):
        for _ in range(n):
            parts = kind()
            out.append((kind.__name__, "<body>" + "".join(h for h, _ in parts) + "</body>", [y for _, y in parts if y >= 0]))
    return out


def labelled_table(n: int = PAGES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of :func:`labelled_pages`."""
    rows, labels = [], []
    for _, html, y in labelled_pages(n, seed):
        found = blocks(html)
        assert len(found) == len(y)
        rows.append(features(found))
        labels += y
    return np.vstack(rows), np.array(labels)


@dataclass
class Tree:
    """A binary decision tree: ``feature`` at most ``cut`` goes left. Leaves have the share of label 1."""

    share: float
    feature: int = -1
    cut: float = 0.0
    left: Tree | None = field(default=None, repr=False)
    right: Tree | None = field(default=None, repr=False)

    @classmethod
    def grow(cls, x: np.ndarray, y: np.ndarray, depth: int = 7, least: int = 3) -> Tree:
        """Splits by the lowest Gini impurity; first feature, then lowest cut, at a tie."""
        node = cls(float(y.mean()))
        if depth == 0 or len(y) < 2 * least or node.share in (0.0, 1.0):
            return node
        best = (node.share * (1 - node.share) * len(y) - 1e-9, -1, 0.0)
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for cut in (values[:-1] + values[1:]) / 2:
                side = x[:, f] <= cut
                a, b = y[side], y[~side]
                if min(len(a), len(b)) >= least:
                    cost = a.mean() * (1 - a.mean()) * len(a) + b.mean() * (1 - b.mean()) * len(b)
                    if cost < best[0] - 1e-12:
                        best = (cost, f, float(cut))
        if best[1] >= 0:
            node.feature, node.cut = best[1], best[2]
            side = x[:, node.feature] <= node.cut
            node.left, node.right = cls.grow(x[side], y[side], depth - 1, least), cls.grow(x[~side], y[~side], depth - 1, least)
        return node

    def shares(self, x: np.ndarray) -> np.ndarray:
        if self.feature < 0:
            return np.full(len(x), self.share)
        side = x[:, self.feature] <= self.cut
        out = np.empty(len(x))
        out[side], out[~side] = self.left.shares(x[side]), self.right.shares(x[~side])
        return out


def train() -> Tree:
    return Tree.grow(*labelled_table())


def main_text(page: str | None, tree: Tree) -> tuple[str, int]:
    """The article's blocks joined by line breaks, and their number."""
    found = blocks(page)
    if not found:
        return "", 0
    kept = [b.text for b, s in zip(found, tree.shares(features(found)), strict=True) if s >= 0.5]
    return "\n".join(kept), len(kept)


_RESULT = StructType([StructField("text", StringType()), StructField("n_chars", LongType()), StructField("n_blocks", IntegerType())])


def extractor(tree: Tree):
    """UDF of an html column: text, n_chars, n_blocks."""

    @pandas_udf(_RESULT)
    def run(pages: pd.Series) -> pd.DataFrame:
        rows = [main_text(p, tree) for p in pages]
        return pd.DataFrame({"text": [t for t, _ in rows], "n_chars": [len(t) for t, _ in rows], "n_blocks": [n for _, n in rows]}, columns=[f.name for f in _RESULT])

    return run


def op8_block_tree(spark, sf_dir: str) -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars, n_blocks.

    Null and empty pages, and pages without article text, have an empty text; very long ones are read whole;
    repeated rows equal ones; an empty table gives no rows; other columns are not read."""
    common.small_batches(spark)
    pages = common.table(spark, sf_dir, "pages")
    return pages.select("page_id", "url", extractor(train())(F.col("html")).alias("r")).select("page_id", "url", "r.*")
