"""Main text of web pages from flat blocks (operator 11).

A page is cut into flat text blocks in one pass over its markup, without a
tree: start and end tags of block elements end a block, inline elements do
not. A block is described by its word count and link density, those of its
neighbours, the kind of its element, whether it holds a stock phrase of page
furniture, and the nearest part of the page that its author declared around
it (``PLACES``). A decision tree tells main text from furniture; it is trained
by Spark on the small labelled table ``EXAMPLES`` and goes to the tasks as a
table of nodes. A page is read by one task and nothing is shuffled.

Defined results: null and empty pages have an empty text; elements left open
end with the element around them, a page cut short ends its last block;
character references are decoded, unknown ones stay as they are; blocks of
white space alone are none; repeated rows are extracted again; an empty table
gives an empty result; further columns pass through.
"""
from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fraudlens.llm.common import ship
from fraudlens.session import scratch_path

ship(__name__)

#: The part of the page around a block: furniture, outside a declared main
#: part, no main part declared, main part.
PLACES = {"f": 0, "o": 1, "u": 2, "m": 3}
KINDS = {"p": 0, "h": 1, "l": 2, "d": 3}
FEATURES = ["words", "density", "words_before", "density_before", "words_after", "density_after",
            "kind", "place", "phrase"]

UNSEEN = {"script", "style", "template", "noscript", "iframe", "noembed", "noframes", "object", "svg", "math",
          "canvas", "audio", "video", "textarea", "select", "option", "button", "title", "datalist", "map"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font",
          "i", "img", "input", "ins", "kbd", "label", "mark", "nobr", "q", "ruby", "rb", "rt", "rp", "s", "samp", "small",
          "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track",
        "wbr", "keygen", "frame", "basefont", "bgsound"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
LISTS = {"li", "dt", "dd", "td", "th"}
PARAGRAPHS = {"p", "pre", "blockquote", "figcaption"}
#: Elements that end when another of their kind starts.
SELF_ENDING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"},
               "th": {"td", "th"}, "tr": {"tr"}, "option": {"option"}}
ONE_P = ("p",)
#: What a search for such an element to end does not leave.
SCOPES = {"ul", "ol", "dl", "table", "div", "article", "section", "aside", "main", "body", "nav", "header",
          "footer", "form", "blockquote", "td", "th"}

FURNITURE_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog", "fieldset"}
MAIN_TAGS = {"article", "main"}
#: Words of class, id and role values that name page furniture.
FURNITURE = set("""ad ads adv advert adverts advertisement advertising adsense adslot banner sponsor sponsored
sponsors promo promotion promoted cookie cookies consent gdpr ccpa notice notices notification alert popup modal
overlay newsletter subscribe subscription signup signin login register paywall menu nav navbar navigation
breadcrumb breadcrumbs toolbar topbar masthead header footer colophon copyright legal disclaimer sidebar aside
widget widgets related recommended recommendations trending popular teaser share sharing social follow comment
comments commentlist disqus reply replies respond discussion tags tagcloud pager pagination skip search
searchform contentinfo complementary dialog form""".split())
COMMENTS = {"comment", "comments", "commentlist", "disqus", "reply", "replies", "respond", "discussion"}
MAIN = set("""article articlebody content main story post entry text maincontent postcontent entrycontent
articlecontent storybody""".split())
#: First words of names that tell what else a page has.
STATES = {"has", "with", "without", "no", "is", "js"}
#: Phrases of page furniture, for pages that declare no parts; told of blocks
#: of at most ``PHRASE_WORDS`` words.
PHRASE_WORDS = 30
PHRASE = re.compile(
    r"©|\(c\) ?\d{4}|\bcopyright\b|all rights reserved|\bcookies?\b|privacy policy|terms of (?:use|service)|"
    r"\bsubscribe\b|\bnewsletter\b|\badvertis|\bsponsored\b|\b(?:sign|log) ?(?:in|up)\b|\bleave a (?:comment|reply)|"
    r"\b\d+ comments?\b|\bread more\b|\bshare this\b|\bfollow us\b|\bskip to\b|\brelated (?:articles|posts)|"
    r"\balle rechte vorbehalten|\btous droits réservés|\btodos los derechos reservados", re.I)

COMMENT = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))", re.S)
DECLARATION = re.compile(r"<[!?/][^>]*(?:>|\Z)")
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)"
                 r"((?:=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))|[^>])*+)(?:>|\Z)")
ATTRIBUTE = re.compile(r"(?<![^\s/\"'])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?",
                       re.I)
NAME = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
NO_DISPLAY = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


# ------------------------------------------------------------------- blocks
def declared(tag: str, attributes: str) -> str | None:
    """What an element says of its content: ``c`` reader comments, ``f``
    furniture by its element, ``n`` furniture by a name, ``m`` main part."""
    names, hidden = set(), False
    for a, *values in ATTRIBUTE.findall(attributes) if attributes else ():
        a, value = a.lower(), "".join(values)
        if a == "hidden" or (a == "aria-hidden" and value == "true"):
            hidden = True
        elif a == "style":
            hidden = hidden or bool(NO_DISPLAY.search(value))
        elif a in ("class", "id", "role"):
            for name in value.split():
                parts = [w.lower() for w in NAME.split(name)]
                if parts[0] not in STATES:
                    names.update(parts, ["".join(parts)])
    if names & COMMENTS:
        return "c"
    if hidden or tag in FURNITURE_TAGS:
        return "f"
    if tag in MAIN_TAGS:
        return "m"
    if names & FURNITURE and not names & MAIN:
        return "n"
    return "m" if names & MAIN else None


def kind_of(tag: str) -> str:
    return "h" if tag in HEADINGS else "l" if tag in LISTS else "p" if tag in PARAGRAPHS else "d"


class Scan:
    """The open elements and the open block of a page. Places of open elements
    are kept by tag, so nothing is searched however deep a page nests."""

    def __init__(self):
        self.out: list[tuple] = []
        self.stack: list[tuple[str, str | None]] = []     # tag and the part it leads to
        self.at: dict[str, list[int]] = {}
        self.block_at: list[int] = []
        self.scope_at: list[int] = []
        self.text: list[str] = []
        self.linked = 0
        self.any_main = False

    def last(self, tags) -> int:
        last = -1
        for t in tags:
            held = self.at.get(t)
            if held and held[-1] > last:
                last = held[-1]
        return last

    def part(self) -> str | None:
        return self.stack[-1][1] if self.stack else None

    def add(self, text: str) -> None:
        self.text.append(text)
        if self.at.get("a"):
            self.linked += len(text.split())

    def flush(self) -> None:
        words = "".join(self.text).split()
        if words:
            kind = kind_of(self.stack[self.block_at[-1]][0]) if self.block_at else "d"
            self.out.append((" ".join(words), kind, self.part(), len(words), min(self.linked, len(words))))
        self.text, self.linked = [], 0

    def close_to(self, i: int) -> None:
        while len(self.stack) > i:
            tag, _ = self.stack.pop()
            self.at[tag].pop()
            if tag not in INLINE:
                self.block_at.pop()
                if tag in SCOPES:
                    self.scope_at.pop()

    def end(self, tag: str) -> None:
        i = self.last([tag])
        if tag not in INLINE:
            self.flush()
        elif self.block_at and self.block_at[-1] > i:
            return                               # an inline element does not end the block it stands around
        if i >= 0:
            self.close_to(i)

    def start(self, tag: str, attributes: str) -> None:
        if tag not in INLINE:
            self.flush()
            # inline elements left open end with their block; a link may hold blocks
            while self.stack and self.stack[-1][0] in INLINE and self.stack[-1][0] != "a":
                self.close_to(len(self.stack) - 1)
            i = self.last(SELF_ENDING.get(tag, ONE_P))
            # a cell is a scope that another cell ends
            scopes = [k for k in self.scope_at[-2:] if k != i]
            if i >= 0 and (not scopes or i > scopes[-1]):
                self.close_to(i)
        if tag in VOID or tag in ("html", "body", "head"):
            return
        if tag == "a":
            self.end(tag)
        part = self.lead(tag, attributes)
        self.any_main = self.any_main or part == "m"
        if tag not in INLINE:
            self.block_at.append(len(self.stack))
            if tag in SCOPES:
                self.scope_at.append(len(self.stack))
        self.at.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, part))

    def lead(self, tag: str, attributes: str) -> str | None:
        inherited = self.part()
        if inherited in ("c", "f"):
            return inherited                     # nothing inside is main text
        if tag == "header" and inherited != "m":
            return "n"
        says = declared(tag, attributes)
        if says == "m" and inherited == "n" and tag not in MAIN_TAGS:
            return inherited
        return says or inherited


def blocks(html: str) -> list[tuple[str, str, str, int, int]]:
    """(text, kind, place, words, linked words) of a page's blocks in order."""
    scan = Scan()
    at, end = 0, len(html)
    while at < end:
        lt = html.find("<", at)
        if lt < 0:
            lt = end
        if lt > at:
            scan.add(unescape(html[at:lt]))
        if lt == end:
            break
        if html.startswith("<!--", lt):
            at = COMMENT.match(html, lt).end()
            continue
        found = TAG.match(html, lt)
        if not found:
            other = DECLARATION.match(html, lt)
            if not other and lt + 1 < end:
                scan.add("<")
            at = other.end() if other else lt + 1
            continue
        at = found.end()
        closing, tag, attributes = found[1], found[2].lower(), found[3]
        if tag == "br":
            scan.add(" ")
        elif closing:
            scan.end(tag)
        elif tag in UNSEEN:
            if not attributes.endswith("/"):
                over = re.compile(f"</{re.escape(tag)}(?=[\\s/>]|\\Z)[^>]*>?", re.I).search(html, at)
                at = over.end() if over else end
            scan.add(" ")
        else:
            scan.start(tag, attributes)
    scan.flush()
    place = {"m": "m", "c": "f", "f": "f", "n": "f", None: "o" if scan.any_main else "u"}
    return [(text, kind, place[part], n, linked) for text, kind, part, n, linked in scan.out]


def described(found: list[tuple[str, str, int, int, bool]]) -> list[tuple]:
    """Features of a page's blocks from (kind, place, words, linked, phrase)."""
    sizes = [(0, 0.0), *[(words, linked / max(1, words)) for _, _, words, linked, _ in found], (0, 0.0)]
    return [(*sizes[i + 1], *sizes[i], *sizes[i + 2], KINDS[kind], PLACES[place], phrase and words <= PHRASE_WORDS)
            for i, (kind, place, words, _, phrase) in enumerate(found)]


# ------------------------------------------------------------ training table
#: The labelled table: one page a line, its blocks as kind, place, words,
#: linked words, ``!`` for a stock phrase and ``+`` for main text.
EXAMPLES = """
l.f.1.1 l.f.2.2 l.f.1.1 d.f.9.0 h.m.6.0+ p.m.48.2+ p.m.3.0+ p.m.71.0+ p.m.1.0+ d.f.7.1!
l.f.1.1 l.f.1.1 h.m.9.0+ p.m.5.0+ p.m.2.0+ p.m.120.4+ h.m.3.0+ l.m.8.0+ l.m.4.0+ l.m.11.1+ p.f.64.0 p.f.22.0 d.f.5.2!
d.f.14.0! h.m.4.0+ p.m.1.0+ p.m.2.0+ p.m.3.0!+ p.f.31.0 p.m.6.0+ d.f.12.6
p.o.18.0 l.o.2.2 l.o.3.3 h.m.8.0+ p.m.33.1+ p.m.12.12+ p.m.54.0+ p.o.40.0! h.o.2.0 l.o.7.7 l.o.6.6
h.o.3.3 p.o.26.0 h.m.5.0+ p.m.90.0!+ d.m.40.0+ d.m.4.0+ p.f.80.0 p.f.45.1 p.f.3.0 p.o.9.0
h.o.2.0 p.o.61.0 p.m.15.0+ l.m.3.0+ l.m.2.2+ l.m.9.0+ p.m.4.4+ p.m.2.0!+ p.o.35.0 p.o.110.0
h.m.7.0+ l.m.2.2 l.m.3.3 l.m.2.2 l.m.4.4 p.m.60.1+ p.m.9.3+ l.m.6.1+ l.m.5.2+ p.m.12.0!+ p.f.3.0!
l.u.1.1 l.u.1.1 l.u.2.2 h.u.7.0+ p.u.52.1+ p.u.8.0+ p.u.66.0+ p.u.3.0+ d.u.6.1! d.u.3.3
d.u.2.2 d.u.2.2 d.u.1.1 d.u.40.1+ d.u.57.0+ d.u.5.0+ d.u.38.0+ d.u.4.4 d.u.6.6 d.u.8.0!
p.u.5.5 p.u.9.9 h.u.6.0+ p.u.25.0+ p.u.31.3+ p.u.12.0+ p.u.44.0+ h.u.2.0+ p.u.29.0+ p.u.20.2! p.u.11.1!
l.u.3.3 l.u.2.2 d.u.9.0! p.u.75.0+ l.u.6.0+ l.u.9.0+ l.u.12.1+ p.u.41.0+ l.u.5.5 l.u.7.7 l.u.4.4 d.u.10.0!
h.u.4.4 p.u.17.0! h.u.8.0+ p.u.101.0+ p.u.64.2+ p.u.1.0+ p.u.37.0+ h.u.2.0 l.u.6.6 l.u.8.8 p.u.6.0!
d.u.1.1 d.u.1.1 d.u.3.0 d.u.88.0+ d.u.2.0+ d.u.93.3+ d.u.3.2 d.u.2.2 d.u.5.0!
l.u.2.2 l.u.1.1 d.u.8.0 l.u.3.3 h.u.9.0+ p.u.30.0+ p.u.4.0+ p.u.22.0+ l.u.2.2 d.u.6.0 l.u.2.2
"""


#: Word counts say nothing of a block whose part is declared: such pages are
#: also read with all their counts multiplied by these.
SCALES = (0.2, 0.5, 1, 2, 5)


def labelled(examples: str = EXAMPLES) -> list[tuple[float, tuple]]:
    rows = []
    for line in examples.strip().splitlines():
        for scale in SCALES if ".u." not in line else (1,):
            found, labels = [], []
            for cell in line.split():
                kind, place, words, rest = cell.split(".")
                words, linked = (math.ceil(int(n) * scale) for n in (words, rest.strip("!+")))
                found.append((kind, place, words, linked, "!" in rest))
                labels.append(float(rest.endswith("+")))
            rows += zip(labels, described(found))
    return rows


def train(spark: SparkSession, examples: str = EXAMPLES, depth: int = 8) -> list[tuple]:
    """The decision tree as rows (feature, threshold, left, right, verdict),
    the root first; feature is -1 in leaves."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.linalg import Vectors
    table = spark.createDataFrame([(y, Vectors.dense([float(v) for v in x])) for y, x in labelled(examples)],
                                  ["label", "features"]).coalesce(1)
    model = DecisionTreeClassifier(maxDepth=depth, maxBins=64, seed=1).fit(table)
    path = scratch_path(spark, "block-tree")
    model.write().save(path)
    found = spark.read.parquet(f"{path}/data").select(
        "id", "prediction", "leftChild", "rightChild", F.col("split.featureIndex").alias("f"),
        F.try_element_at("split.leftCategoriesOrThreshold", F.lit(1)).alias("t")).orderBy("id").collect()
    return [(r.f if r.leftChild >= 0 else -1, r.t or 0.0, r.leftChild, r.rightChild, r.prediction > 0.5)
            for r in found]


def verdicts(tree: list[tuple], x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), bool)
    todo = [(0, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        feature, threshold, left, right, verdict = tree[node]
        if feature < 0:
            out[rows] = verdict
        elif len(rows):
            small = x[rows, feature] <= threshold
            todo += [(left, rows[small]), (right, rows[~small])]
    return out


def main_texts(pages: list[str | None], tree: list[tuple]) -> list[str]:
    found = [blocks(html or "") for html in pages]
    x = [row for page in found for row in described(
        [(kind, place, n, linked, n <= PHRASE_WORDS and bool(PHRASE.search(text)))
         for text, kind, place, n, linked in page])]
    kept = iter(verdicts(tree, np.array(x, float).reshape(len(x), len(FEATURES))).tolist())
    return ["\n".join([b[0] for b in page if next(kept)]) for page in found]


def extract(pages: DataFrame, tree: list[tuple] | None = None, html: str = "html",
            out: str = "main_text") -> DataFrame:
    """All columns but the page, plus the main text ``out``."""
    tree = tree or train(pages.sparkSession)
    kept = [c for c in pages.columns if c not in (html, out)]
    shape = pages.select(*[F.col(f"`{c}`") for c in kept], F.lit("").alias(out)).schema
    source = pages.select(*[F.col(f"`{c}`") for c in kept], F.col(html).cast("string").alias(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = main_texts(batch.column(len(kept)).to_pylist(), tree)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())],
                                             names=batch.schema.names)
    return source.mapInArrow(run, shape)
