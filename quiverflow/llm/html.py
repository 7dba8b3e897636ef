"""Main text of web pages: boosted trees judge DOM nodes, a tree-shaped decoding joins the judgements.

The model is trained here, on pages that `training_pages` makes from a seed; it is a few
hundred small trees and goes to the executors with the function.
"""

from __future__ import annotations

import functools
import html
import random
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import read, slices

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S
)
ATTR = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their contents are no text of the page: scripts, styles, drawings, what stands in for them, and the controls of forms.
DROPPED = frozenset("head script style title noscript template iframe svg select textarea button".split())
RAW = frozenset("script style title textarea noscript iframe template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math mi mn mo mrow msub msup mtext object button select option svg q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: Start tags that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dt dd".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}


@dataclass
class Node:
    tag: str
    attrs: str
    parent: int
    own: list[int] = field(default_factory=list)  # child nodes
    length: int = 0
    linked: int = 0
    words: int = 0
    stops: int = 0
    below: int = 0
    paragraphs: int = 0


def dom(page: str) -> tuple[list[Node], list[tuple[int, int, str, bool]]]:
    """Judged nodes (blocks, and inline elements with a class or id), and texts as (node, block, text, in a link).

    Character references are decoded after the markup is cut.  Unclosed elements end with their parents,
    end tags without a start count for nothing, and an open paragraph ends where a block begins.
    """
    nodes, texts = [Node("#page", "", -1)], []
    open_: list[tuple[str, int]] = [("#page", 0)]
    places: dict[str, list[int]] = {}  # of the open elements of each tag
    last = page.rfind(">") + 1  # no tag ends behind it
    block, at, gone, links = 0, 0, 0, 0
    low: str | None = None

    def pop_to(k: int) -> None:
        nonlocal gone, links
        for tag, _ in reversed(open_[k:]):
            places[tag].pop()
            gone -= tag in DROPPED
            links -= tag == "a"
        del open_[k:]

    def nearest(tags) -> int:
        """The place of the innermost open element of these, or 0."""
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def put(text: str) -> None:
        if text and not gone:
            texts.append((open_[-1][1], block, html.unescape(text), links > 0))

    while m := TOKEN.search(page, at, last):
        put(page[at : m.start()])
        at = len(page) if m[0].startswith("<!--") and not m[0].endswith("-->") else m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closing, attrs = tag.lower(), (m[1] or m[4]) == "/", m[3] or m[6] or ""
        if closing:
            if k := nearest((tag,)):
                pop_to(k)
            block += tag not in INLINE
            continue
        if tag == "br" or tag == "wbr" or tag == "img":
            if tag == "br":
                put(" ")
            continue
        if tag in RAW:
            low = page.lower() if low is None or len(low) != len(page) else low
            end = low.find(f"</{tag}", at)
            close = page.find(">", end) if end >= 0 else -1
            at = close + 1 if close >= 0 else len(page)
            continue
        if tag in ENDS_P:
            k = nearest(("p", "td", "th", "table", "button"))
            if k and open_[k][0] == "p":
                pop_to(k)
        if tag in SAME:
            k = nearest(SAME[tag] | SCOPE[tag])
            if k and open_[k][0] in SAME[tag]:
                pop_to(k if tag != "tr" or open_[k][0] == "tr" else k)
        block += tag not in INLINE
        if tag in VOID or attrs.endswith("/") and tag not in INLINE and tag not in ENDS_P:
            continue
        here = open_[-1][1]
        if tag not in DROPPED and not gone and (tag not in INLINE or "class" in attrs or "id=" in attrs):
            nodes.append(Node(tag, attrs, here))
            nodes[here].own.append(len(nodes) - 1)
            here = len(nodes) - 1
        gone += tag in DROPPED
        places.setdefault(tag, []).append(len(open_))
        open_.append((tag, here))
        links += tag == "a"
    if at < len(page):
        put(page[at:])
    return nodes, texts


#: Word stems in class, id and role, by what they speak of.
HINTS = {
    "main": "article content post entry main story body text prose",
    "menu": "nav menu breadcrumb crumb toc pagination pager topbar tabs",
    "head": "header masthead banner brand logo hero",
    "foot": "footer foot copyright legal colophon contentinfo",
    "side": "sidebar aside side widget related recommend rail complementary trending popular",
    "ad": "ad ads advert advertisement adslot sponsor sponsored promo promotion dfp taboola outbrain commercial",
    "notice": "cookie consent gdpr notice alert modal popup overlay dialog toast disclaimer banner",
    "talk": "comment comments reply replies disqus discussion respond thread responses",
    "form": "form login signup subscribe newsletter search register contact",
    "share": "share social tags meta byline toolbar author bio",
}
STEM = {w: k for k, words in enumerate(HINTS.values()) for w in words.split()}
TAGS = ("p", "div", "article", "main", "section", "nav", "header", "footer", "aside", "form", "ul", "ol", "li", "h1", "h2", "h3", "table", "td", "blockquote", "pre", "figure", "figcaption", "body", "span", "dialog", "address", "details")
TAG_AT = {t: k for k, t in enumerate(TAGS)}
WORDS = re.compile(r"[a-z]+")


def hints(attrs: str) -> list[int]:
    out = [0] * len(HINTS)
    for name, a, b, c in ATTR.findall(attrs):
        if name.lower() in ("class", "id", "role", "aria-label", "itemprop"):
            for w in WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", a or b or c).lower()):
                k = STEM.get(w, STEM.get(w.removesuffix("s")))
                if k is not None:
                    out[k] = 1
    return out


def features(nodes: list[Node], texts: list[tuple[int, int, str, bool]]) -> np.ndarray:
    """One row for each node: tag, attribute tokens (own, above), subtree densities, depth, siblings, place."""
    n = len(nodes)
    first = [10**9] * n
    for k, (i, _, t, link) in enumerate(texts):
        node = nodes[i]
        node.length += len(t.strip())
        node.linked += len(t.strip()) * link
        node.words += len(t.split())
        node.stops += sum(map(t.count, ".,!?;:"))
        first[i] = min(first[i], k)
    for i in range(n - 1, 0, -1):
        a, b = nodes[i], nodes[nodes[i].parent]
        a.below += 1
        for k in ("length", "linked", "words", "stops", "below"):
            setattr(b, k, getattr(b, k) + getattr(a, k))
        b.paragraphs += a.paragraphs + (a.tag == "p")
        first[nodes[i].parent] = min(first[nodes[i].parent], first[i])
    total, depth = max(1, nodes[0].length), [0] * n
    own, above = [hints(x.attrs) for x in nodes], [[0] * len(HINTS) for _ in nodes]
    marks = [0] * n  # 1 article or main, 2 nav, header, footer, aside, form above
    rows = np.zeros((n, len(TAGS) + 2 * len(HINTS) + 19), np.float32)
    place, longest, alike = [0] * n, [nodes[0].length] * n, [Counter({nodes[0].tag: 1})] * n  # of a node's siblings, itself included
    for x in nodes:
        most, tags = max((nodes[j].length for j in x.own), default=0), Counter(nodes[j].tag for j in x.own)
        for k, j in enumerate(x.own):
            place[j], longest[j], alike[j] = k, most, tags
    for i, x in enumerate(nodes):
        p = nodes[x.parent] if i else x
        if i:
            depth[i] = depth[x.parent] + 1
            above[i] = [a | b for a, b in zip(above[x.parent], own[x.parent], strict=True)]
            marks[i] = marks[x.parent] | (p.tag in ("article", "main")) | 2 * (p.tag in ("nav", "header", "footer", "aside", "form", "dialog"))
        kin, k = len(p.own) if i else 1, place[i]
        if x.tag in TAG_AT:
            rows[i, TAG_AT[x.tag]] = 1
        rows[i, len(TAGS) :] = [
            *own[i], *above[i],
            np.log1p(x.length), x.length / total, x.linked / max(1, x.length), x.words / (x.below + 1), x.stops / max(1, x.words), x.length / max(1, x.words),
            x.below, x.paragraphs, depth[i], k, kin - k - 1, x.length / max(1, longest[i]), x.length / max(1, p.length),
            alike[i][x.tag] / kin, min(first[i], len(texts)) / max(1, len(texts)), marks[i] & 1, marks[i] >> 1, bool(x.attrs.strip()), len(x.own),
        ]
    return rows


def boosted(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.2, bins: int = 32, l2: float = 1.0) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Gradient-boosted complete trees under logistic loss, split on histograms of quantile bins.

    Each tree: features and thresholds of its inner nodes in level order, and values of its leaves.
    """
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
    score, trees = np.zeros(len(y)), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p) + 1e-6
        at, feats, limits = np.zeros(len(y), np.int64), [], []
        for level in range(depth):
            m = 1 << level
            best, pick = np.full(m, 1e-9), np.zeros((m, 2), np.int64)
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                key = at * (len(c) + 1) + binned[:, f]
                gs, hs = (np.cumsum(np.bincount(key, v, m * (len(c) + 1)).reshape(m, -1), 1) for v in (g, h))
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs[:, :-1] ** 2 / (hs[:, :-1] + l2) + (gt - gs[:, :-1]) ** 2 / (ht - hs[:, :-1] + l2) - gt**2 / (ht + l2)
                k = gain.argmax(1)
                better = gain[np.arange(m), k] > best
                best[better], pick[better] = gain[np.arange(m), k][better], np.stack([np.full(m, f), k], 1)[better]
            feats += pick[:, 0].tolist()
            limits += [cuts[f][k] if best[j] > 1e-9 else np.inf for j, (f, k) in enumerate(pick)]
            f = pick[at, 0]
            at = 2 * at + (x[np.arange(len(y)), f] > np.array(limits[-m:])[at])
        leaves = -rate * np.bincount(at, g, 1 << depth) / (np.bincount(at, h, 1 << depth) + l2)
        score += leaves[at]
        trees.append((np.array(feats), np.array(limits), leaves))
    return trees


def raw_score(trees, x: np.ndarray) -> np.ndarray:
    out, rows = np.zeros(len(x)), np.arange(len(x))
    for feats, limits, leaves in trees:
        at = np.zeros(len(x), np.int64)
        while at[0] < len(feats):
            at = 2 * at + 1 + (x[rows, feats[at]] > limits[at])
        out += leaves[at - len(feats)]
    return out


def decode(nodes: list[Node], score: np.ndarray) -> np.ndarray:
    """The likeliest set of kept nodes in which no node is kept below a dropped one.

    With a node's log odds s, keeping it gains s; a node kept or dropped takes part with all
    its descendants' choices, best ones first computed from the leaves up.
    """
    best = score.astype(float).copy()
    for i in range(len(nodes) - 1, 0, -1):
        best[nodes[i].parent] += max(0.0, best[i])
    keep = np.zeros(len(nodes), bool)
    keep[0] = True
    for i in range(1, len(nodes)):
        keep[i] = keep[nodes[i].parent] and best[i] > 0
    return keep


def main_texts(pages: list[str | None], trees) -> list[str]:
    """Blocks of the kept nodes in page order, white space inside a block as one space, joined by two newlines."""
    parsed = [dom(page or "") for page in pages]
    scores = raw_score(trees, np.concatenate([features(*p) for p in parsed])) if parsed else []
    out, at = [], 0
    for nodes, texts in parsed:
        keep = decode(nodes, scores[at : at + len(nodes)])
        at += len(nodes)
        blocks: dict[int, list[str]] = {}
        for i, block, t, _ in texts:
            if keep[i]:
                blocks.setdefault(block, []).append(t)
        out.append("\n\n".join(t for b in blocks.values() if (t := " ".join("".join(b).split()))))
    return out


def training_pages(n: int = 500, seed: int = 11) -> list[str]:
    """Made pages; data-k tells of each element whether it belongs to the article (1) or not (0)."""
    r = random.Random(seed)
    syllables = "ka lo mi ren tor sal ve un dri pa en ous al be st ing on er li du".split()

    def words(lo: int, hi: int) -> str:
        out = ["".join(r.choices(syllables, k=r.randint(1, 4))) for _ in range(r.randint(lo, hi))]
        text = " ".join(w + r.choice([""] * 7 + [".", ","]) for w in out)
        return text.capitalize() + r.choice(["", ".", "."])

    def attrs(names: str, bare: float = 0.15) -> str:
        if not names or r.random() < bare:
            return ""
        name = r.choice(names.split())
        return f' {r.choice(["class", "class", "class", "id"])}="{r.choice(["", "", "", "x-", "site-", "c3 "])}{name}{r.choice(["", "", "", "-box", "_1", " wide"])}"'

    def el(tag: str, inner: str, keep: int, names: str = "", bare: float = 0.15) -> str:
        return f'<{tag} data-k="{keep}"{attrs(names, bare)}>{inner}</{tag}>'

    def links(k: int, tag: str = "li") -> str:
        return "".join(el(tag, f'<a href="/{words(1, 1)}">{words(1, 5)}</a>' + r.choice(["", "", words(1, 3)]), 0) for _ in range(k))

    def prose(keep: int, lo: int = 1, hi: int = 6) -> str:
        out = []
        for _ in range(r.randint(lo, hi)):
            text = words(1, r.choice([3, 10, 40, 120]))
            if r.random() < 0.3:
                text = f"<b>{text}</b> {words(1, 20)}"
            if r.random() < 0.15:
                text += f' <a href="#">{words(1, 4)}</a> {words(1, 9)}'
            out.append(f'<p data-k="{keep}"><b>{text}<br>' if r.random() < 0.1 else el("p", text, keep) if r.random() < 0.9 else f'<p data-k="{keep}">{text}')
        return "".join(out)

    def junk() -> str:
        kind = r.randrange(12)
        if kind == 0:
            tag = r.choice(["nav", "nav", "div", "ul"])
            inner = links(r.randint(2, 9))
            return el(tag, inner if tag == "ul" else el("ul", inner, 0), 0, HINTS["menu"], 0.5 if tag == "nav" else 0)
        if kind == 1:
            return el(r.choice(["header", "header", "div"]), r.choice(["", el("h1", words(1, 4), 0), el("div", words(1, 4), 0, "logo brand")]) + el("p", words(1, 9), 0), 0, HINTS["head"], 0)
        if kind == 2:
            tag = r.choice(["footer", "footer", "div"])
            return el(tag, r.choice(["&copy; ", ""]) + words(2, 25) + r.choice(["", el("p", words(2, 12), 0), el("ul", links(3), 0)]), 0, HINTS["foot"], 0.7 if tag == "footer" else 0)
        if kind == 3:
            tag = r.choice(["aside", "aside", "div", "section"])
            return el(tag, r.choice(["", el("h3", words(1, 4), 0)]) + r.choice([el("ul", links(4), 0), prose(0, 1, 3)]), 0, HINTS["side"], 0.6 if tag == "aside" else 0)
        if kind in (4, 5, 6):
            return el(r.choice(["div", "div", "p", "section", "aside"]), words(1, 30) if r.random() < 0.6 else prose(0, 1, 2), 0, HINTS["ad"], 0)
        if kind == 7:
            return el(r.choice(["div", "div", "section", "dialog", "p"]), words(2, 30) + r.choice(["", "<button>OK</button>", el("p", words(3, 20), 0)]), 0, HINTS["notice"], 0)
        if kind in (8, 9):
            tag = r.choice(["section", "div", "ol"])
            one = lambda: el("li" if tag == "ol" else r.choice(["div", "article"]), r.choice(["", el("span", words(1, 2), 0, "author name"), el("h4", words(1, 2), 0)]) + prose(0, 1, 2), 0, "comment reply response comment-body", 0.1)
            return el(tag, r.choice(["", el("h2", words(1, 3), 0), el("h3", words(1, 3), 0)]) + "".join(one() for _ in range(r.randint(1, 5))), 0, "comments comment-list discussion replies responses", 0)
        if kind == 10:
            return el("form", el("label", words(1, 4), 0) + "<input name=q>" + r.choice(["", el("p", words(2, 15), 0)]) + "<button>Go</button>", 0, HINTS["form"], 0.5)
        return el("div", el("form", words(1, 6) + "<input>", 0), 0, HINTS["form"], 0)

    def article() -> str:
        title = el(r.choice(["h1", "h1", "h2"]), words(2, 14), 1)
        parts = [title if r.random() < 0.85 else el("header", title + r.choice(["", el("p", words(1, 8), 1, "byline meta author date")]), 1)] if r.random() < 0.9 else []
        for _ in range(r.randint(1, 5)):
            parts.append(r.choices([
                prose(1), el("h2", words(1, 8), 1), el("ul", "".join(el("li", words(1, 15), 1) for _ in range(r.randint(1, 5))), 1), el("blockquote", r.choice([words(4, 40), prose(1, 1, 2)]), 1),
                el("table", "".join(f'<tr data-k="1">{el("td", words(1, 4), 1)}{el("td", words(1, 4), 1)}</tr>' for _ in range(r.randint(1, 4))), 1), el("pre", words(3, 30), 1), el("figure", el("figcaption", words(2, 12), 1), 1),
                el(r.choice(["div", "section"]), prose(1), 1, HINTS["main"] + " lead chapter part", 0.5),
            ], [8, 2, 2, 1, 1, 0.5, 0.7, 2])[0])
            if r.random() < 0.22:
                parts.append(junk())
        inner = "".join(parts)
        for _ in range(r.choice([0, 0, 0, 1])):
            inner = el("div", inner, 1, HINTS["main"], 0.4)
        tag = r.choice(["article", "article", "article", "div", "main", "section"])
        return el(tag, inner, 1, HINTS["main"], 0.8 if tag in ("article", "main") else 0.05)

    pages = []
    for _ in range(n):
        body = "".join(junk() for _ in range(r.randint(0, 4))) + article() + "".join(junk() for _ in range(r.randint(0, 4)))
        for _ in range(r.choice([0, 0, 1, 2])):
            body = el(r.choice(["div", "div", "main"]), body, 1, "page wrapper container site row main content layout", 0.3)
        pages.append(f'<!DOCTYPE html><html data-k="1"><head><title>{words(1, 6)}</title><style>p{{margin:0}}</style></head><body data-k="1">{body}</body></html>')
    return pages


def labelled(pages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the pages' judged nodes (those with text)."""
    xs, ys = [], []
    for page in pages:
        nodes, texts = dom(page)
        y, known = np.zeros(len(nodes)), np.zeros(len(nodes), bool)
        for i, x in enumerate(nodes):
            if m := re.search(r'data-k="(.)"', x.attrs):
                y[i], known[i] = int(m[1]), True
                x.attrs = x.attrs.replace(m[0], "")
        x = features(nodes, texts)
        known &= np.array([v.length > 0 for v in nodes])
        xs.append(x[known])
        ys.append(y[known])
    return np.concatenate(xs), np.concatenate(ys)


@functools.lru_cache(1)
def page_model() -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The trees, trained once for each process; the same everywhere, as pages and seed are fixed."""
    return boosted(*labelled(training_pages()))


def extract_pages(pages: DataFrame, column: str = "html", trees=None) -> DataFrame:
    """pages without `column`, with `text` (main text, empty if none) and `n_chars` (its code points).

    Whole pages, each by itself; a null or empty page has an empty text.  Repeated rows give repeated
    results.  Columns named `text` or `n_chars` are replaced.  Markup that is no page at all is read as far as it goes.
    """
    import pyarrow as pa

    trees = trees or page_model()
    pages = pages.drop(*(c for c in ("text", "n_chars") if c != column))
    kept = [f for f in pages.schema.fields if f.name != column]

    def run(batches):
        for b in slices(batches):
            texts = main_texts(b.column(column).to_pylist(), trees)
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*(f.name for f in kept), "text", "n_chars"])

    from pyspark.sql.types import LongType, StringType, StructField, StructType

    return pages.mapInArrow(run, StructType([*kept, StructField("text", StringType()), StructField("n_chars", LongType())]))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
