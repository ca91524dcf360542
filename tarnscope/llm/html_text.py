"""Main text of web pages: boosted trees over DOM nodes and hierarchical decoding."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import escape, unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnscope.llm.boosting import Trees, fit_trees
from tarnscope.llm.common import with_fields

INLINE = frozenset((
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label",
    "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
))
VOID = frozenset((
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
))
RAW = frozenset(("script", "style", "textarea", "title"))
# Formulas and drawings stand in a line of text; a block tag inside ends them, as browsers do.
FOREIGN = frozenset(("math", "svg"))
# An opening tag of the first kind ends an open one of the second, as far as the third.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
CLOSES_P = frozenset((
    "address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2",
    "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul",
))
SCOPE = frozenset((
    "article", "aside", "blockquote", "body", "button", "caption", "div", "footer", "form", "header", "html", "li", "main", "nav",
    "section", "table", "td", "th",
))
GOOD_WORDS = frozenset(("article", "body", "content", "entry", "main", "post", "story", "text", "blog", "page", "column", "detail"))
BAD_WORDS = frozenset((
    "ad", "ads", "advert", "advertisement", "alert", "aside", "banner", "bar", "breadcrumb", "breadcrumbs", "button", "buttons", "comment",
    "commentlist", "comments", "consent", "cookie", "cookies", "copyright", "disclaimer", "discuss", "discussion", "footer", "form", "gdpr",
    "header", "hidden", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pager", "pagination",
    "popup", "promo", "promotion", "recommended", "related", "replies", "reply", "respond", "rss", "search", "share", "sharing", "sidebar",
    "signup", "social", "sponsor", "sponsored", "subscribe", "tags", "teaser", "toolbar", "warning", "widget",
))
BAD_TAGS = frozenset(("nav", "footer", "aside", "form", "header", "button", "select", "dialog", "menu", "fieldset"))
GOOD_TAGS = frozenset(("article", "main", "section"))
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"']+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
DROP = "data-drop"
N_FEATURES = 24
SAMPLE_PAGES, LONGEST_SAMPLE = 300, 60_000


class Node:
    __slots__ = ("tag", "parent", "children", "good", "bad", "dropped", "depth", "chars", "links", "marks", "tags", "paragraphs", "fields")

    def __init__(self, tag: str, parent: int, depth: int):
        self.tag, self.parent, self.depth = tag, parent, depth
        self.children: list[int] = []
        self.good = self.bad = self.chars = self.links = self.marks = self.tags = self.paragraphs = self.fields = 0
        self.dropped = False


def parse(html: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block elements in page order, parents first, and the texts with the element that holds them. A
    block boundary is an empty text. Tags that were left open are closed as browsers do."""
    nodes, texts, stack = [Node("html", -1, 0)], [], [(0, "html")]
    at, n_links, n_foreign = 0, 0, 0

    def say(piece: str) -> None:
        if piece:
            piece = unescape(piece)
            here = next(i for i, _ in reversed(stack) if i >= 0)
            texts.append((here, piece))
            size = len(piece) - sum(map(str.isspace, piece))
            node = nodes[here]
            node.chars += size
            node.links += size if n_links else 0
            node.marks += sum(map(piece.count, ".,;:!?"))

    def close(k: int) -> None:
        nonlocal n_links, n_foreign
        n_links -= sum(t == "a" for _, t in stack[k:])
        n_foreign -= sum(t in FOREIGN for _, t in stack[k:])
        if any(i >= 0 for i, _ in stack[k:]):
            texts.append((0, ""))
        del stack[k:]

    while m := TOKEN.search(html, at):
        say(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][1] == tag:
                    close(k)
                    break
                if tag in INLINE and stack[k][1] in SCOPE:
                    break
            continue
        if tag in ("html", "body"):
            continue
        if tag in RAW:
            end = re.compile(f"</{tag}(?=[\\s/>])[^>]*>", re.I).search(html, at)
            if end:
                at = end.end()
            elif tag in ("script", "style"):
                at = len(html)
            continue
        if n_foreign and (tag in CLOSES_P or tag in CLOSES):
            close(next(k for k, (_, t) in enumerate(stack) if t in FOREIGN))
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][1] == "p":
                    close(k)
                    break
                if stack[k][1] in SCOPE:
                    break
        if tag in CLOSES:
            ended, scope = CLOSES[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][1] in scope:
                    break
                if stack[k][1] in ended:
                    close(k)
                    if tag != "tr":
                        break
        here = next(i for i, _ in reversed(stack) if i >= 0)
        if tag in INLINE or tag in FOREIGN or n_foreign:
            nodes[here].tags += 1
            if tag == "br":
                texts.append((here, " "))
            elif tag not in VOID and not ((n_foreign or tag in FOREIGN) and m[3].endswith("/")):
                stack.append((-1, tag))
                n_links += tag == "a"
                n_foreign += tag in FOREIGN
            continue
        texts.append((0, ""))
        if tag in ("input", "hr", "img"):
            nodes[here].fields += tag == "input"
        if tag in VOID:
            continue
        node = Node(tag, here, nodes[here].depth + 1)
        node.fields += tag in ("button", "select", "option")
        for name, value in ATTRIBUTE.findall(m[3]):
            if name.lower() in ("class", "id", "role", "itemprop", "aria-label"):
                words = [w.lower() for w in WORD.findall(value)]
                node.good += sum(w in GOOD_WORDS for w in words)
                node.bad += sum(w in BAD_WORDS for w in words)
            if name == DROP:
                node.dropped = True
        nodes[here].children.append(len(nodes))
        stack.append((len(nodes), tag))
        nodes.append(node)
    say(html[at:])
    return nodes, texts


def features(nodes: list[Node]) -> np.ndarray:
    """Of every node: size and density of its subtree, its attribute words and those above, its
    depth, and its place among its siblings."""
    n = len(nodes)
    own = np.array([(x.chars, x.links, x.marks, x.tags + 1, x.fields, x.tag == "p") for x in nodes], float)
    total = own.copy()
    parent = np.array([x.parent for x in nodes])
    for i in range(n - 1, 0, -1):
        total[parent[i]] += total[i]
    out = np.zeros((n, N_FEATURES))
    above = np.zeros((n, 4))
    for i, x in enumerate(nodes):
        tag = (x.tag in GOOD_TAGS, x.tag in BAD_TAGS)
        if i:
            above[i] = above[parent[i]]
        chars, links, marks, tags, fields, paragraphs = total[i]
        kin = nodes[x.parent].children if i else [0]
        sizes = [total[j, 0] for j in kin]
        at = kin.index(i) if len(kin) < 50 else int(np.searchsorted(kin, i))
        out[i] = (
            np.log1p(chars), np.log1p(tags), chars / tags, links / (chars + 1), marks / (chars + 1), fields / tags, np.log1p(paragraphs),
            chars / (total[0, 0] + 1), x.depth, at / len(kin), len(kin), chars / (max(sizes) + 1), chars / (sum(sizes) + 1),
            sum(nodes[j].tag == x.tag for j in kin) / len(kin), min(x.good, 3), min(x.bad, 3), tag[0], tag[1], *np.minimum(above[i], 3),
            x.tag == "p", x.tag in ("ul", "ol", "dl", "li", "table"),
        )
        above[i] += (x.good > 0, x.bad > 0, *tag)
    return out


def decode(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """Kept nodes of the best consistent choice: what stands in a dropped node is dropped with it."""
    keep, drop = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    best = keep.copy()
    for i in range(len(nodes) - 1, 0, -1):
        best[nodes[i].parent] += max(best[i], drop[i])
        drop[nodes[i].parent] += drop[i]
    out = np.zeros(len(nodes), bool)
    out[0] = best[0] >= drop[0]
    for i in range(1, len(nodes)):
        out[i] = out[nodes[i].parent] and best[i] >= drop[i]
    return out


def blocks(texts: list[tuple[int, str]], kept: np.ndarray) -> str:
    """Texts of kept nodes; white space inside a block is one space, blocks are lines."""
    lines, now = [], []
    for node, piece in [*texts, (0, "")]:
        if piece:
            if kept[node]:
                now.append(piece)
        elif now:
            line = " ".join("".join(now).split())
            if line:
                lines.append(line)
            now = []
    return "\n".join(lines)


def _pick(rng: np.random.Generator, values: list) -> str:
    return values[int(rng.integers(len(values)))]


def made_page(rng: np.random.Generator, lines: list[str]) -> str:
    """A page of known structure: lines of given pages in a random layout, with what is no article
    marked by an attribute that the features do not see."""
    name = lambda *words: f' {_pick(rng, ["class", "id"])}="{_pick(rng, list(words))}"'
    line = lambda: escape(_pick(rng, lines))
    short = lambda: escape(" ".join(_pick(rng, lines).split()[: int(rng.integers(1, 12))]))
    links = lambda: "<ul>" + "".join(f'<li><a href="/{i}">{short()}</a></li>' for i in range(rng.integers(2, 9))) + "</ul>"
    off = f" {DROP}=1"

    def noise(kind: str) -> str:
        if kind == "menu":
            return f"<nav{off}>{links()}</nav>" if rng.random() < 0.5 else f"<div{off}{name('menu', 'navbar', 'main-nav', 'breadcrumbs')}>{links()}</div>"
        if kind == "header":
            return f"<header{off}><div>{short()}</div><form><input></form></header>" if rng.random() < 0.5 else f"<div{off}{name('header', 'masthead', 'site-header')}>{short()}</div>"
        if kind == "footer":
            return f"<footer{off}>&copy; {short()} {line()}</footer>" if rng.random() < 0.6 else f"<div{off}{name('footer', 'copyright', 'site-footer')}><p>{short()}</p></div>"
        if kind == "side":
            inside = links() if rng.random() < 0.5 else f"<h3>{short()}</h3><p>{line()}</p>"
            return f"<aside{off}>{inside}</aside>" if rng.random() < 0.4 else f"<div{off}{name('sidebar', 'widget', 'related', 'recommended-posts')}>{inside}</div>"
        if kind == "notice":
            return f"<div{off}{name('cookie-notice', 'alert', 'notice', 'gdpr-consent', 'banner')}><p>{short()}</p>{'<button>OK</button>' if rng.random() < 0.5 else ''}</div>"
        if kind == "ad":
            return f"<div{off}{name('ad', 'advert', 'sponsored', 'promo', 'ads-box')}>{short() if rng.random() < 0.6 else line()}</div>"
        if kind == "form":
            return f"<form{off}><label>{short()}</label><input><button>{short()}</button><p>{short()}</p></form>"
        if kind == "share":
            return f"<div{off}{name('share', 'social', 'tags')}>{links()}</div>"
        said = "".join(f"<div{name('comment', 'reply')}><b>{short()}</b><p>{line()}</p></div>" for _ in range(rng.integers(1, 6)))
        return f"<{_pick(rng, ['section', 'div'])}{off}{name('comments', 'discussion', 'comment-list', 'replies')}>{said}</div></section>"

    parts = [f"<h1>{short()}</h1>"]
    for _ in range(rng.integers(1, 10)):
        kind = rng.random()
        if kind < 0.7:
            parts.append(f"<p>{line()}" + ("</p>" if rng.random() < 0.8 else "<br>"))
        elif kind < 0.8:
            parts.append(f"<h2>{short()}</h2>")
        elif kind < 0.87:
            parts.append("<ul>" + "".join(f"<li>{_pick(rng, [short(), line()])}</li>" for _ in range(rng.integers(2, 6))) + "</ul>")
        elif kind < 0.91:
            parts.append(f"<blockquote><p>{line()}</p></blockquote>")
        elif kind < 0.94:
            parts.append(f"<table><tr><td>{short()}</td><td>{short()}</td></tr></table>")
        else:
            parts.append(noise(_pick(rng, ["ad", "share", "form", "side", "notice"])))
    tag = _pick(rng, ["article", "article", "main", "div", "section", "div"])
    label = "" if tag in ("article", "main") and rng.random() < 0.6 or rng.random() < 0.15 else name("content", "post", "entry-content", "article-body", "story", "main-text")
    page = f"<{tag}{label}>{''.join(parts)}</{tag}>"
    before = "".join(noise(k) for k in ("header", "menu", "notice", "ad", "side") if rng.random() < 0.45)
    after = "".join(noise(k) for k in ("share", "comments", "side", "form", "ad", "footer") if rng.random() < 0.4)
    for _ in range(rng.integers(0, 3)):
        page = f"<div{'' if rng.random() < 0.4 else name('container', 'wrapper', 'page', 'row')}>{page}</div>"
        if rng.random() < 0.5:
            page, before = before + page, ""
    return f"<html><body>{before}{page}{after}</body></html>"


def train_extractor(pages: list[str], *, layouts: int = 1_200, seed: int = 5) -> Trees:
    """Trees fitted to layouts made of the lines of some pages."""
    lines = []
    for html in pages:
        nodes, texts = parse(html)
        lines += [x for x in blocks(texts, np.ones(len(nodes), bool)).split("\n") if len(x) > 20]
    lines = lines or ["Some words of an ordinary sentence, with a clause, and an end."]
    rng = np.random.default_rng(seed)
    xs, ys = [], []
    for _ in range(layouts):
        nodes, _ = parse(made_page(rng, lines))
        out = np.zeros(len(nodes), bool)
        for i, node in enumerate(nodes):
            out[i] = node.dropped or (i > 0 and out[node.parent])
        xs.append(features(nodes))
        ys.append(~out)
    return fit_trees(np.concatenate(xs), np.concatenate(ys).astype(float))


def extract_text(pages: DataFrame, *, html: str = "html", text: str = "text", sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """Add ``text``, the main text of every whole page.

    Boosted trees score every block element from the size and density of its subtree, its attribute
    words, depth and siblings; the best choice in which no kept element stands in a dropped one
    decides. The trees are fitted on layouts made of lines of at most ``sample_pages`` pages, chosen by
    a hash, none longer than ``LONGEST_SAMPLE`` characters.

    Null and empty pages, and pages without kept text, give the empty text. Repeated pages give equal
    texts. All other columns stay; a column named ``text`` is replaced. Very long pages are read whole.
    """
    share = F.pmod(F.xxhash64(html), F.lit(1_000_003)) < int(1_000_003 * min(1.0, 4 * sample_pages / max(pages.count(), 1)))
    some = pages.where(share & (F.length(html) <= LONGEST_SAMPLE)).select(F.col(html).alias("html")).orderBy(F.xxhash64("html"), "html").limit(sample_pages)
    shared = pages.sparkSession.sparkContext.broadcast(train_extractor([r["html"] for r in some.collect()]))
    out = pages.drop(text)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                parsed = [parse(h or "") for h in batch.column(html).to_pylist()]
                odds = trees.log_odds(np.concatenate([features(nodes) for nodes, _ in parsed]))
                ends = np.cumsum([len(nodes) for nodes, _ in parsed])[:-1]
                found = [blocks(texts, decode(nodes, o)) for (nodes, texts), o in zip(parsed, np.split(odds, ends), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*batch.schema.names, text])

    return out.mapInArrow(extract, with_fields(out, **{text: T.StringType()}))
