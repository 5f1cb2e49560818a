"""Main text of web pages: block structure, and a style tree of each site that shows what its pages share."""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoframe.llm import spans
from mnemoframe.llm.url_filter import host_and_path
from mnemoframe.plans.session import cut_lineage

#: A node or block is noise below this importance.
IMPORTANCE = 0.05
#: Weight of a node's content against its presentation.
CONTENT = 0.9
#: With fewer pages the evidence is thin: shared blocks go only where they are less than what stays.
FEW_PAGES = 5
#: A page with fewer words of its own is a copy of others, and what it shares is its text.
OWN_WORDS = 20
#: Low branches that are broadcast; more are joined.
BROADCAST_ROWS = 200_000
#: Elements inside each other; the text of deeper ones belongs to the last one.
DEPTH = 512

# HTML elements by their role
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object canvas audio video xmp noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Elements that never hold main text.
APART = frozenset("aside button datalist dialog fieldset footer form head header label legend menu nav optgroup option search select".split()) | RAW
#: Roles that never hold main text.
APART_ROLES = frozenset("alert alertdialog banner button complementary contentinfo dialog form menu menubar navigation search status tablist toolbar".split())
#: Words of class or id that name what is no main text.
APART_WORDS = frozenset("ad ads alert alerts announcement advert advertisement advertising adverts banner banners breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header masthead menu menus modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted promotion related reply replies respond share sharing sidebar sidebars signup skip social sponsor sponsored subscribe subscription toolbar widget widgets".split())
#: Elements that a new one of the same group closes.
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements through which no end tag of an inner element reaches.
BARRIERS = frozenset("article aside body div dl footer form header html main nav ol section table td th ul".split())

_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_PLAIN = re.compile(r"[^>\"']*")
#: What differs from page to page in a shared block: addresses, numbers, marks.
_VARYING = re.compile(r"[a-z][a-z0-9+.-]*://\S+|(?<!\w)\d+(?!\w)|[^\w\s]+|_+")
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


def _apart(tag: str, attributes: str) -> tuple[bool, str]:
    """Whether an element is no main text by its name, role, class or id, and its style."""
    if not attributes or attributes == "/":
        return tag in APART, tag
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    style = f"{tag}.{found.get('class', '')}#{found.get('id', '')}"
    if tag in APART or "hidden" in found or found.get("aria-hidden") == "true" or found.get("role", "").lower() in APART_ROLES:
        return True, style
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I):
        return True, style
    if tag in ("html", "body", "article", "main"):
        return False, style
    words = re.findall(r"[a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", f"{found.get('class', '')} {found.get('id', '')}").lower())
    return any(w in APART_WORDS for w in words), style


def _tags(source: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, name, attributes) of each tag, comment and declaration (these without a name), from the place that send() names.

    Every character is read a bounded number of times: a quote without a partner is a character like others, and once a tag has run to
    the end of the page inside quotes, quotes are no longer looked at.
    """
    at, size = 0, len(source)
    last = source.rfind(">")
    alone = {'"': source.rfind('"'), "'": source.rfind("'")}
    quotes = True
    while True:
        start = source.find("<", at)
        if start < 0:
            return
        if source.startswith("<!--", start) or source.startswith("<![CDATA[", start):
            mark = "-->" if source[start + 2] == "-" else "]]>"
            end = source.find(mark, start + 4)
            at = (yield start, size if end < 0 else end + len(mark), "", "") or (size if end < 0 else end + len(mark))
            continue
        if source.startswith(("<!", "<?"), start):
            end = source.find(">", start) + 1 or size
            at = (yield start, end, "", "") or end
            continue
        if start > last:
            return
        name = _NAME.match(source, start + 1)
        if name is None:
            at = start + 1
            continue
        k = name.end()
        while True:
            k = _PLAIN.match(source, k).end() if quotes else max(source.find(">", k), -1)
            if k < 0 or k >= size:
                # no end: quotes hide it, or there is none
                if not quotes:
                    return
                quotes, k = False, name.end()
                continue
            if source[k] == ">":
                break
            close = source.find(source[k], k + 1) if k < alone[source[k]] else -1
            k = k + 1 if close < 0 else close + 1
        at = (yield start, k + 1, name[0], source[name.end():k]) or k + 1


class Page:
    """Blocks of text of a page, in order: (node, text, inside an article, inside a main element).

    A node is a number made of the styles from the root down, and `above` names the node over each.
    """

    def __init__(self, source: str):
        self.blocks: list[tuple[int, str, bool, bool]] = []
        self.children: dict[int, list[str]] = {}
        self.above: dict[int, int] = {}
        # tag, node, apart, article, main
        self.stack: list[tuple[str, int, bool, bool, bool]] = [("", 0, False, False, False)]
        self.open_tags: Counter[str] = Counter()
        self.deeper = 0
        self.text: list[str] = []
        at, size = 0, len(source)
        tags, skip = _tags(source), None
        while True:
            try:
                start, end, name, attributes = tags.send(skip)
            except StopIteration:
                break
            skip = None
            if start > at:
                self.add(source[at:start])
            at = end
            if not name:
                continue
            tag = name.lstrip("/").lower()
            if name[0] == "/":
                self.close(tag)
            else:
                self.open(tag, attributes)
                if tag in RAW and tag not in ("svg", "math", "object", "canvas", "audio", "video", "template"):
                    found = re.compile(rf"</{tag}\b", re.I).search(source, at)
                    at = skip = (source.find(">", found.end()) + 1 or size) if found else size
                    self.close(tag)
        if at < size:
            self.add(source[at:])
        self.flush()

    def add(self, text: str) -> None:
        if not self.stack[-1][2]:
            self.text.append(text)

    def flush(self) -> None:
        if self.text:
            text = " ".join(html.unescape("".join(self.text)).split())
            if text:
                top = next(x for x in reversed(self.stack) if x[0] in BLOCKS or not x[0])
                self.blocks.append((top[1], text, top[3], top[4]))
            self.text = []

    def open(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS:
            self.flush()
            self.end_paragraph()
            for other in CLOSED_BY.get(tag, ()):
                self.close(other, stop=("ul", "ol", "dl", "table"))
        elif tag == "br":
            self.add(" ")
        if tag in VOID:
            return
        if len(self.stack) > DEPTH:
            self.deeper += 1
            return
        apart, style = _apart(tag, attributes)
        above = self.stack[-1]
        node = above[1]
        if tag in BLOCKS:
            node = _below(above[1], style)
            self.above.setdefault(node, above[1])
            if not above[2]:
                self.children.setdefault(above[1], []).append(style)
        self.stack.append((tag, node, above[2] or apart, above[3] or tag == "article", above[4] or tag == "main"))
        self.open_tags[tag] += 1

    def cut(self, k: int) -> None:
        for x in self.stack[k:]:
            self.open_tags[x[0]] -= 1
        del self.stack[k:]

    def end_paragraph(self) -> None:
        if not self.open_tags["p"]:
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] == "p":
                self.cut(k)
                return
            if self.stack[k][0] in BARRIERS:
                return

    def close(self, tag: str, stop: tuple[str, ...] = ()) -> None:
        if tag in BLOCKS:
            self.flush()
        if self.deeper and not stop:
            self.deeper -= tag not in VOID
            return
        if not self.open_tags[tag]:
            return
        for k in range(len(self.stack) - 1, 0, -1):
            name = self.stack[k][0]
            if name == tag:
                self.cut(k)
                return
            if name in stop or name in BARRIERS and tag not in BARRIERS:
                return

    def main(self) -> list[tuple[int, str]]:
        """(node, text) of the blocks of the articles; without any, of the main elements; else of the whole page."""
        for k in (2, 3):
            some = [b[:2] for b in self.blocks if b[k]]
            if some:
                return some
        return [b[:2] for b in self.blocks]


def _number(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


@lru_cache(100_000)
def _below(node: int, style: str) -> int:
    return _number(f"{node}/{style}")


def _feature(text: str) -> int:
    """A block's text without what differs between pages that share it: case, space, numbers, addresses and marks."""
    return _number(" ".join(_VARYING.sub(" ", text.lower()).split()) or text)


def _branches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, print, node, kind, feature, n) of each page: its blocks' texts (kind 1) and its nodes' children (kind 0). print: the page's main text."""
    for b in spans.slices(batches, "html", 8 << 20):
        rows = []
        for host, source in zip(b.column("host").to_pylist(), b.column("html").to_pylist()):
            page = Page(source or "")
            main = [(node, _feature(text)) for node, text in page.main()]
            mark = _number(" ".join(str(f) for _, f in main))
            rows += [(host, mark, node, 1, f, n) for (node, f), n in Counter(main).items()]
            # the nodes over the main text
            over: set[int] = set()
            for node, _ in main:
                while node not in over:
                    over.add(node)
                    node = page.above.get(node, 0)
            rows += [(host, mark, node, 0, _number(" ".join(c)), 1) for node, c in page.children.items() if node in over]
        columns = list(zip(*rows)) or [()] * 6
        types = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        yield pa.record_batch([pa.array(x, t) for x, t in zip(columns, types)], ["host", "print", "node", "kind", "feature", "n"])


def low_branches(rows: DataFrame, importance: float) -> DataFrame:
    """(host, node, feature, m): blocks of low importance, and nodes (feature null) whose presentation and content are low.

    With p the shares of a feature's occurrences in the pages that hold its node, and m these pages, a block's importance is
    1 - entropy(p) / log m: one that stands in every page has 0, one that stands in a single page 1. With few pages only what
    stands in all of them is low. A node's presentation is the entropy of its lists of children to the base m, its content the
    mean importance of its blocks. Pages of equal main text count once, so copies are no evidence, and neither is a single page.
    """
    # numbers only; pages are parsed once for them
    once = cut_lineage(rows.where("host != ''").mapInArrow(_branches, "host string, print long, node long, kind int, feature long, n long").groupBy("host", "node", "kind", "feature", "print").agg(F.max("n").alias("n")))
    features = once.groupBy("host", "node", "kind", "feature").agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.log("n")).alias("spread"), F.count("*").alias("pages"))
    pages = once.select("host", "node", "print").distinct().groupBy("host", "node").agg(F.count("*").alias("m")).where("m > 1")
    # sums over features of what entropies to the base m are made of: no feature of a large node is joined with it
    block, lists = F.col("kind") == 1, F.col("kind") == 0
    sums = features.groupBy("host", "node").agg(
        F.sum(F.when(block, F.col("all"))).alias("total"),
        F.sum(F.when(block, F.col("all") * F.log("all") - F.col("spread"))).alias("shared"),
        F.sum(F.when(lists, F.col("pages"))).alias("held"),
        F.sum(F.when(lists, F.col("pages") * F.log("pages"))).alias("alike"))
    nodes = sums.join(pages, ["host", "node"])
    content = 1 - F.col("shared") / (F.col("total") * F.log("m"))
    presentation = F.coalesce((F.col("held") * F.log("m") - F.col("alike")) / (F.col("m") * F.log("m")), F.lit(0.0))
    low_nodes = nodes.where((1 - CONTENT) * presentation + CONTENT * content < importance).select("host", "node", F.lit(None).cast("long").alias("feature"), "m")
    # what stands in a single page has importance 1
    repeated = features.where("kind = 1 and pages > 1").join(pages, ["host", "node"])
    value = 1 - (F.log("all") - F.col("spread") / F.col("all")) / F.log("m")
    return low_nodes.union(repeated.where(value < importance).select("host", "node", "feature", "m"))


def without_shared(blocks: list[tuple[int, str]], low: list) -> list[tuple[int, str]]:
    """The blocks of a page without those of its site that are low; a copy of other pages stays whole."""
    nodes = {x["node"]: x["m"] for x in low if x["feature"] is None}
    features = {(x["node"], x["feature"]): x["m"] for x in low if x["feature"] is not None}
    held = [nodes.get(node) or features.get((node, _feature(text))) for node, text in blocks]
    own = [b for b, m in zip(blocks, held) if m is None]
    shared = [(text, m) for (_, text), m in zip(blocks, held) if m is not None]
    if not shared or sum(len(text.split()) for _, text in own) < OWN_WORDS:
        return blocks
    if min(m for _, m in shared) < FEW_PAGES and sum(len(text) for text, _ in shared) > sum(len(text) for _, text in own):
        return blocks
    return own


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in spans.slices(batches, "html", 8 << 20):
        texts = []
        for source, low in zip(b.column("html").to_pylist(), b.column("low").to_pylist()):
            blocks = Page(source or "").main()
            texts.append("\n\n".join(t for _, t in (without_shared(blocks, low) if low else blocks)))
        yield pa.record_batch({"id": b.column("id"), "url": b.column("url"), "text": pa.array(texts, pa.string())})


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", importance: float = IMPORTANCE) -> DataFrame:
    """One row for each row of pages: page_id, url, text, n_chars (its code points).

    A page is cut into blocks. Blocks inside navigation, headers, footers, sidebars, forms, scripts, styles and whatever its role,
    class or id names as menu, advert, notice, comment or the like are left out; of the rest count those in articles, else those
    in main elements, else all. White space in a block is one space, character references are decoded, blocks are joined by an
    empty line.

    Then the pages of a host are merged into a style tree (see low_branches): blocks and nodes of low importance go from each page,
    on sites of any size. A page that would keep fewer than 20 words of its own is a copy of others and stays whole; where fewer
    than 5 different pages speak, shared blocks go only if they are less than what stays. Only counts of hashed branches are shuffled, combined before; a host may hold any part of the pages.

    Null and empty html, and pages without main text, give an empty text; null URLs and those without :// belong to no site;
    null page_ids and repeated rows are rows like others (equal pages count once in a tree); columns other than the three named
    ones are not looked at; an empty table gives no rows. Unclosed and crossed elements end where HTML ends them, or with the page; elements more than 512 deep count as their
    ancestor there; quotes without a partner are characters. Time and memory follow the length of a page, whatever stands in it.
    """
    url: Column = F.col("url")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).withColumn("host", host_and_path(url)[0])
    # a host has few low branches: each stands in nearly all of its pages
    low = cut_lineage(low_branches(rows.select("host", "html"), importance).groupBy("host").agg(F.collect_list(F.struct("node", "feature", "m")).alias("low")))
    low = F.broadcast(low) if (low.agg(F.sum(F.size("low"))).first()[0] or 0) <= BROADCAST_ROWS else low
    joined = rows.join(low, "host", "left").select("id", "url", "html", "low")
    texts = joined.mapInArrow(_texts, "id long, url string, text string")
    return texts.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))
