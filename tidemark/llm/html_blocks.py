"""HTML main text by flat text blocks and a decision tree (operator 3).

A page is cut into flat blocks of text at block-level tags.  Each block has its
number of words and its link density, those of the blocks before and after it,
whether it stands in the page's article, and whether it is a heading or an item.
Blocks that the page itself marks as something else than its article are out:
those in a menu, footer, sidebar or form, in a part whose class, id or role says
so (`BOILER_NAMES`), in a header outside the article, and reader comments, which
are articles inside an article that has begun.  A decision tree (CART, Gini) over
words and link densities tells main text from the rest among all other blocks; it
is trained on the small table of labelled pages in `LABELLED`, each time the same
way, and never sees tags' names.

A mark that holds the article itself (`<div class="has-sidebar">` around a whole
page, a form around everything) doesn't count.

Tags may be unclosed or badly nested and pages may be cut off anywhere.  A page is
read once, from left to right; neither depth nor length costs more than their
share.

Cases: null and empty pages, and pages without main text, give an empty text;
repeated rows give a row each; rows with a null id are kept; other columns are
ignored, whatever their names; an empty table gives an empty result; a very long
page is read whole, and batches of pages are bounded by bytes.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._store import small_batches

# HTML's element names by what they mean here.
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
CONTAINER = frozenset("address article aside blockquote details dialog div dl fieldset figure footer form header main menu nav ol section table ul li".split())
SKIPPED = frozenset("script style noscript template textarea iframe svg select button title canvas map datalist annotation annotation-xml".split())
RAW = frozenset("script style textarea title".split())
SPACED = frozenset("br td th img input label option".split())
BOILER_TAGS = frozenset("nav footer aside form menu dialog fieldset".split())
BOILER_NAMES = frozenset(
    "ad ads adv advert advertisement adverts advertising banner breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies copyright discussion disqus feedback footer form gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices notification alert pager pagination popup popular promo promoted promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toc toolbar topbar trending warning widget".split()
)
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: The rest of a tag: a quoted value may hold '>'; a quote that is never closed is a character like others.
_REST = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+""")
_ATTR = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.IGNORECASE)
_ANCHOR = re.compile(r"<(/?)a(?=[\s/>])", re.IGNORECASE)
_SPACE = re.compile(r"\s+")
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Part:
    """A container of a page, or a single block whose own tag is named."""

    tag: str
    above: Part | None
    boiler: bool  # its tag or a name says that it isn't the article
    header: bool
    depth: int
    blocks_before: int  # blocks when it began
    words_before: int
    words: int = 0  # inside it, once it is closed
    text_before: bool = False  # of an article: has a paragraph of its own been seen?
    item: bool = False
    comment: bool = False
    holds_main: bool = False
    in_main: bool = False
    out: bool = False


@dataclass
class Block:
    text: str
    words: int
    linked: int
    part: Part | None
    heading: bool

    @property
    def density(self) -> float:
        return self.linked / self.words if self.words else 0.0

    @property
    def in_article(self) -> bool:
        return self.part is not None and self.part.in_main

    @property
    def marked_out(self) -> bool:
        return self.part is not None and self.part.out

    @property
    def item(self) -> bool:
        return self.part is not None and self.part.item


def _names(tag: str) -> frozenset[str]:
    found: set[str] = set()
    for m in _ATTR.finditer(tag):
        found.update(_SPLIT.split(_CAMEL.sub(" ", m[1].strip("\"'")).lower()))
    return frozenset(found)


class _Reader:
    """Reads a page into blocks and the parts they stand in."""

    def __init__(self, page: str):
        self.page = page
        self.blocks: list[Block] = []
        self.parts: list[Part] = []  # in order of their beginnings
        self.stack: list[Part] = []
        self.open_: Counter[str] = Counter()  # tags on the stack
        self.articles: list[Part] = []  # articles on the stack
        self.total = 0
        self.text: list[str] = []
        self.linked: list[str] = []
        self.link_end = -1  # a link lasts until here, and beyond blocks
        self.in_link = False
        self.heading = False
        self.single: Part | None = None  # a named block that is no container

    def read(self) -> None:
        page, at, n = self.page, 0, len(self.page)
        anchors = [(m.start(), not m[1]) for m in _ANCHOR.finditer(page)]
        closed = {a: b for (a, opens), (b, again) in zip(anchors, anchors[1:], strict=False) if opens and not again}
        while at < n:
            lt = page.find("<", at)
            if lt < 0:
                self.say(page[at:])
                break
            if lt > at:
                self.say(page[at:lt])
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                at = n if end < 0 else end + 3
                continue
            after = page[lt + 1 : lt + 2]
            closing = after == "/"
            m = None if after in ("!", "?") else _NAME.match(page, lt + 1 + closing)
            if m is None:
                if closing or after in ("!", "?"):
                    end = page.find(">", lt)
                    at = n if end < 0 else end + 1
                else:
                    self.say("<", decode=False)
                    at = lt + 1
                continue
            end = _REST.match(page, m.end()).end()
            at = end + 1
            name = m[0].lower()
            if name in SKIPPED:
                self.text.append(" ")
                if not closing and page[end - 1] != "/":
                    over = _closer(name).search(page, at)
                    if over:
                        at = page.find(">", over.start()) + 1 or n
                    elif name in RAW:
                        at = n
            elif name == "a":
                self.linked.append(" ")
                self.in_link = not closing
                self.link_end = -1 if closing else closed.get(lt, -1)
            elif name in BLOCK:
                self.block_tag(name, page[lt:end], closing)
            elif name in SPACED:
                self.text.append(" ")
        self.close_block()
        while self.stack:
            self.pop()

    def say(self, text: str, decode: bool = True) -> None:
        if decode and "&" in text:
            text = html_lib.unescape(text)
        self.text.append(text)
        if self.in_link:
            self.linked.append(text)

    def close_block(self) -> None:
        text = _SPACE.sub(" ", "".join(self.text)).strip()
        if text:
            part = self.single or (self.stack[-1] if self.stack else None)
            words = text.count(" ") + 1
            self.blocks.append(Block(text, words, len("".join(self.linked).split()), part, self.heading))
            self.total += words
            if self.articles and not self.heading and part.depth >= self.articles[-1].depth:
                self.articles[-1].text_before = True
        self.text.clear()
        self.linked.clear()

    def block_tag(self, name: str, tag: str, closing: bool) -> None:
        self.close_block()
        if self.link_end < 0:  # a link that isn't closed ends with its block
            self.in_link = False
        if name[0] == "h" and name[1:].isdigit():
            self.heading = not closing
        elif name != "p" or not closing:
            self.heading = False
        if self.single is not None:
            self.single.words = self.total - self.single.words_before
            self.single = None
        if closing:
            if name in CONTAINER and self.open_[name]:
                while self.pop() != name:
                    pass
            return
        names = _names(tag) if " " in tag or "\n" in tag or "\t" in tag else frozenset()
        if name not in CONTAINER:
            if names & BOILER_NAMES:
                self.single = self.begin(name, names)
        elif not tag.endswith("/"):
            if name == "li" and self.stack and self.stack[-1].tag == "li":  # an item ends the one before it
                self.pop()
            self.stack.append(self.begin(name, names))
            self.open_[name] += 1
            if name == "article":
                self.articles.append(self.stack[-1])

    def begin(self, name: str, names: frozenset[str]) -> Part:
        above = self.stack[-1] if self.stack else None
        said = names & BOILER_NAMES
        part = Part(name, above, name in BOILER_TAGS or bool(said - {"header"}), name == "header" or "header" in said, len(self.stack) + 1, len(self.blocks), self.total)
        part.item = name == "li" or above is not None and above.item
        # an article inside one that has begun is a reader's comment
        part.comment = name == "article" and any(a.text_before for a in self.articles[-1:])
        self.parts.append(part)
        return part

    def pop(self) -> str:
        part = self.stack.pop()
        self.open_[part.tag] -= 1
        part.words = self.total - part.words_before
        if self.articles and self.articles[-1] is part:
            self.articles.pop()
        return part.tag


@lru_cache(maxsize=64)
def _closer(name: str) -> re.Pattern:
    return re.compile(rf"</{name}\b", re.IGNORECASE)


def blocks_of(page: str) -> list[Block]:
    """Flat text blocks in page order, with the parts that they stand in."""
    reader = _Reader(page)
    reader.read()
    # the article: a main or article part that no mark is around; where there is none, the longest of all (else all that
    # holds a first heading or most of the page) makes the marks around it void
    marked: dict[int, bool] = {}
    clean, any_ = [], []
    for p in reader.parts:
        marked[id(p)] = p.boiler or p.comment or p.above is not None and marked[id(p.above)]
        if p.tag in ("main", "article") and p.words and not p.comment and not p.boiler:
            any_.append(p)
            if not marked[id(p)]:
                clean.append(p)
    mains = clean
    if not clean and any_:
        best = max(any_, key=lambda p: (p.words, -p.words_before))
        if 2 * best.words > reader.total:
            mains = [best]
    for p in mains:
        p.in_main = True
    if not clean:
        holds = mains[0] if mains else next((b.part for b in reader.blocks if b.heading), None)
        while holds is not None:
            if mains or 10 * holds.words > 6 * reader.total:
                holds.holds_main = True
            holds = holds.above
    for p in reader.parts:
        up = p.above
        p.in_main = p.in_main or up is not None and up.in_main
        said = p.boiler and not p.holds_main and not (not mains and 10 * p.words > 6 * reader.total)
        # an article's own header is part of it, a page's is not
        p.out = said or p.comment or p.header and not p.in_main and not p.holds_main or up is not None and up.out
    return reader.blocks


#: What the tree looks at. Names of tags, classes and ids are not among it.
FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "in_article", "heading", "item")


def features_of(page: str) -> tuple[list[Block], list[tuple[float, ...]]]:
    blocks = blocks_of(page)
    size = [(float(b.words), b.density) for b in blocks]
    around = [(0.0, 1.0), *size, (0.0, 1.0)]  # beyond the ends: as a link without words
    return blocks, [(*around[k + 1], *around[k], *around[k + 2], float(b.in_article), float(b.heading), float(b.item)) for k, b in enumerate(blocks)]


# The labelled table: blocks of made-up pages; a text that starts with "+" is main text.
# Each page stands for one page per entry of LENGTHS; {W} is a run of so many words, turn by turn.
LENGTHS = (4, 9, 17, 40, 95, 210, 420)
LABELLED = (
    '<nav><ul><li><a href=x>-Home</a><li><a href=x>-News</a><li><a href=x>-About us</a></ul></nav><div class="ad">-Buy now and save a lot today</div><article><h1>+A title of some words</h1><p>+{W}<p>+{W}<p>+Short.<p>+{W}</article><footer>-&copy; 2020 Example, all rights reserved</footer>',
    '<nav><a href=x>-Start</a></nav><div class="ad">-Eight words that tell you what to buy.</div><article><h1>+One</h1><p>+One two three.<p>+Four</article><footer>-&copy; site and a few words about the owner of it, and more. And more words.</footer>',
    "<article><p>+A B C D E | F G H | I J<p>+{W}<p><a href=x>+Linked words</a> in text<p>+{W}</article><aside><p>-{W}</p><a href=x>-More like this</a></aside>",
    '<header><a href=x>-Logo</a><p>-The site with a slogan of words</p></header><main><h1>+Heading</h1><p>+{W}</p><ul><li>+first thing</li><li>+second thing that is longer</li></ul><p>+{W}</p></main><div id="comments"><h2>-Comments</h2><div class="comment"><p>-{W}</p></div><p>-I agree.</p></div>',
    '<div id="header">-Site name</div><div id="menu"><ul><li><a href=x>-One</a></li><li><a href=x>-Two</a></li></ul></div><div id="content"><h2>+News of the day</h2><p>+{W}</p><p>+{W}</p><p>+Fine.</p></div><div id="sidebar"><p>-{W}</p><a href=x>-Archive</a></div><div id="footer">-Imprint and contact</div>',
    "<div><a href=x>-Home</a> <a href=x>-Forum</a></div><div><h1>+Plain page</h1>+{W}</div><div>+{W}</div><div>+{W}</div><div><a href=x>-Next page</a></div><div>-All rights reserved</div>",
    '<div class="cookie-notice"><p>-We use cookies to make this site better for all. {W}</p></div><article><header><h1>+Title in a header</h1></header><p>+{W}</p><form><p>-Your mail address</p></form><p>+{W}</p><div class="related"><a href=x>-Other story</a><p>-{W}</p></div></article><section class="comments"><p>-{W}</p><p>-Nice</p></section>',
    '<main><article><h1>+Short piece</h1><p>+Ten words are in this paragraph, so it is short.</p><blockquote>+A saying of someone</blockquote><pre>+x = 1</pre><table><tr><td>+cell one</td><td>cell two</td></tr></table></article></main><form>-Search the site {W}</form><footer><p>-{W}</p></footer>',
    '<body><p>+{W}</p><p>+{W}</p><p>+{W}</p><p><a href=x>-Back</a></p></body>',
    '<p><a href=x>-Top</a> <a href=x>-Index</a></p><div>+{W}</div><div>+{W}</div><div>+Not many words in this one, but among long ones.</div><div>+{W}</div><div>-Contact us</div>',
    '<p>+{W}</p><p>+{W}</p><p>+{W}</p><p>+{W}</p>',
    '<h1>+A heading first</h1><p>+{W}</p><p>+{W}</p><h2>+Part</h2><p>+{W}</p><p><a href=x>-More</a> <a href=x>-Older</a></p><p>-Terms of use</p>',
    '<div><h1>+Start</h1><p>+{W}</p><p>+Few words here, then more.</p><p>+{W}</p></div><div><a href=x>-Next</a> | <a href=x>Last</a></div><div>-Made by someone</div>',
    '<div><a href=x>-Home</a> <a href=x>Shop</a></div><table><tr><td><h2>+Headline of it</h2><p>+{W}</p><p>+Said someone.</p><p>+{W}</p></td></tr></table><div><a href=x>-Write to us</a></div>',
    '<div>-Welcome, guest</div><div><a href=x>-Log in</a></div><h1>+The story</h1><div>+{W}</div><h3>+Its end</h3><div>+{W}</div><div>-Seen 12 times</div><div><a href=x>-Back to top</a></div>',
    '<nav><a href=x>-Home</a></nav><article><h1>+Cut off</h1><p>+{W}<p><a href=x>+A link alone</a><p>+Few words at the end',
    '<article><h1>+Lone</h1><p><a href=x>+Only a link</a></p><p>+End</p></article>',
    '<main><p>+{W}</p><p><a href=x>+See this page</a></p><p>+Last.</p></main>',
    '<article><h1>+Tiny</h1></article>',
    '<article><p><a href=x>+Linked start</a></p><p>+Some words after it</p><p><a href=x>+Linked end</a></p></article>',
    '<div class="newsletter"><h3>-Subscribe to our letter</h3><p>-{W}</p></div><div class="post"><h1>+A post</h1><p>+Hello there.</p><p>+{W}</p></div><div class="share"><a href=x>-Share</a></div><ul><li><a href=x>-One other story with a long title</a></li><li><a href=x>-Another story</a></li></ul>',
    '<aside class="notice">-Notice: the site will be down on Sunday</aside><article><h1>+Words</h1><ul><li>+item</li><li><a href=x>+linked item</a></li></ul><p>+{W}</p><h2>+Part two</h2><p>+{W}</p><aside>-A word from our sponsor and so on</aside><p>+End.</p></article><div class="popup">-Wait! Do not go. {W}</div>',
)


def labelled_blocks() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the table's blocks, but for those that the page marks as something else."""
    x, y = [], []
    for page in LABELLED:
        runs = page.split("{W}")
        for shift in range(len(LENGTHS)) if len(runs) > 1 else (0,):
            made = [runs[0]]
            for k, rest in enumerate(runs[1:]):
                made += ["word " * LENGTHS[(shift + 3 * k) % len(LENGTHS)], rest]
            blocks, features = features_of("".join(made))
            x += [f for f, b in zip(features, blocks, strict=True) if not b.marked_out]
            y += [b.text.startswith("+") for b in blocks if not b.marked_out]
    return np.array(x), np.array(y)


def train_tree(x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 3):
    """A CART: (feature, limit, tree where <= limit, tree where above), or a class at a leaf. Ties go to the first feature and the lowest limit."""
    share = y.mean()
    if depth == 0 or share in (0.0, 1.0):
        return bool(share >= 0.5)
    best = (2 * share * (1 - share) - 1e-12, None, None)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for limit in (values[:-1] + values[1:]) / 2:
            low = x[:, f] <= limit
            n = int(low.sum())
            if min(n, len(y) - n) < least:
                continue
            a, b = y[low].mean(), y[~low].mean()
            gini = (n * 2 * a * (1 - a) + (len(y) - n) * 2 * b * (1 - b)) / len(y)
            if gini < best[0]:
                best = (gini - 1e-12, f, float(limit))
    if best[1] is None:
        return bool(share >= 0.5)
    low = x[:, best[1]] <= best[2]
    return (best[1], best[2], train_tree(x[low], y[low], depth - 1, least), train_tree(x[~low], y[~low], depth - 1, least))


def classify(tree, features: tuple[float, ...]) -> bool:
    while not isinstance(tree, bool):
        tree = tree[2] if features[tree[0]] <= tree[1] else tree[3]
    return tree


def main_text(page: str, tree) -> tuple[str, int, int]:
    """Main text of a page, its number of blocks, and the number of all blocks."""
    blocks, features = features_of(page)
    kept = [b.text for b, f in zip(blocks, features, strict=True) if not b.marked_out and classify(tree, f)]
    return "\n\n".join(kept), len(kept), len(blocks)


def extract_main_text(df: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = (), tree=None) -> DataFrame:
    """(id, keep..., text, n_chars, n_blocks, n_all_blocks) for each row."""
    small_batches(df.sparkSession)
    tree = train_tree(*labelled_blocks()) if tree is None else tree
    cols = [F.col(f"`{id_col}`").alias("id"), F.col(f"`{html_col}`").cast("string").alias("html"), *(F.col(f"`{c}`").alias(f"k{k}") for k, c in enumerate(keep))]
    pages = df.select(*cols)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [main_text((h or b"").decode("utf-8", "replace"), tree) for h in batch.column("html").cast(pa.binary()).to_pylist()]
            texts = [g[0].encode("utf-8", "replace").decode() for g in got]
            carried = [batch.column("id"), *(batch.column(f"k{k}") for k in range(len(keep)))]
            yield pa.RecordBatch.from_arrays([*carried, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64())], names)

    head = [f for f in pages.schema.fields if f.name != "html"]
    names = [f.name for f in head] + ["text", "n_chars", "n_blocks", "n_all_blocks"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in head) + ", text string, n_chars long, n_blocks long, n_all_blocks long"
    out = pages.mapInArrow(extract, schema)
    return out.select(F.col("id").alias(id_col), *(F.col(f"k{k}").alias(c) for k, c in enumerate(keep)), "text", "n_chars", "n_blocks", "n_all_blocks")


def op3_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every row of `pages`."""
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"), keep=("url",))
