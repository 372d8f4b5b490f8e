"""Main-text extraction by a tree-structured graphical model over the DOM.

Each element and each text is a node that is either the article's or not. A node's own potential is linear in its
features (tag, words of class, id and role, text length, share of text in links); each parent-child edge has a 2 x 2
potential by kind of child. Messages go up from the leaves and down from the root (sum-product, exact on trees), in log
space and for many pages at once, level by level. Texts with a marginal of 0.5 or more are the article's. Weights are
fitted by maximum likelihood on labelled pages, whose gradient needs the same marginals.

Blocks: texts between two block-level tags; character references are decoded, white space in a block is one space, blocks
are joined by one space. Script, style, template and head text, comments and markup are never text.

Defined results: null, empty or text-free html gives ""; unclosed or stray tags follow the usual implied ends; elements
opened within MAX_DEPTH others stay beside each other there, as in browsers; a quote left
open in a tag ends with the tag; pages are independent, so repeated rows repeat their result; an empty table gives an
empty table; other columns are not read. Whole pages are read, however long, in time that grows with their length.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from echofold.llm.batches import lean, slices
from echofold.llm.html_pages import labelled_page

TRAINING_PAGES = 240
STEPS = 300
SLICE_BYTES = 1 << 20
MAX_DEPTH = 512
#: Fixed values of HTML: elements without content, elements whose content is raw, block-level elements, and implied ends.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe template svg math".split())
SKIP = set("script style title noscript iframe template svg math head".split())
BLOCK = set("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul caption head".split())
CLOSES_P = BLOCK - set("br td th tr tbody thead tfoot caption option legend html head body".split())
SAME_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "option": ({"option"}, {"select"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*("[^"]*"?|'[^']*'?|[^\s"'>]+)""")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_WORDS = re.compile(r"[a-z]+")


class Page:
    """A page as nodes in document order, a parent before its children; texts have tag '#'."""

    __slots__ = ("block", "mark", "parent", "tag", "text", "words")

    def __init__(self, source: str):
        self.tag, self.parent, self.words, self.mark = ["#root"], [-1], [()], [""]
        self.text: list[str] = [""]
        self.block: list[int] = [0]
        stack, block, at, n = [0], 0, 0, len(source)
        opened: dict[str, int] = {}  # elements on the stack, by tag
        beyond: dict[str, int] = {}  # open elements that the stack's depth left out, by tag
        low = None

        def add(tag: str, words: tuple, mark: str, text: str) -> None:
            self.tag.append(tag)
            self.parent.append(stack[-1])
            self.words.append(words)
            self.mark.append(mark)
            self.text.append(text)
            self.block.append(block)

        def push(tag: str) -> None:
            if len(stack) > MAX_DEPTH:
                beyond[tag] = beyond.get(tag, 0) + 1
            else:
                stack.append(len(self.tag) - 1)
                opened[tag] = opened.get(tag, 0) + 1

        def pop_to(tags: set[str], scope: set[str]) -> None:
            if not any(opened.get(t) for t in tags):
                return
            for k in range(len(stack) - 1, 0, -1):
                tag = self.tag[stack[k]]
                if tag in tags:
                    for x in stack[k:]:
                        opened[self.tag[x]] -= 1
                    del stack[k:]
                    beyond.clear()
                    return
                if tag in scope:
                    return

        while at < n:
            lt = source.find("<", at)
            if lt < 0:
                lt = n
            if lt > at:
                add("#", (), "", source[at:lt])
            if lt == n:
                break
            if source.startswith("<!--", lt):
                end = source.find("-->", lt + 4)
                at = n if end < 0 else end + 3
                continue
            nxt = source[lt + 1 : lt + 2]
            if nxt in ("!", "?"):
                end = source.find(">", lt)
                at = n if end < 0 else end + 1
                continue
            closing = nxt == "/"
            named = _NAME.match(source, lt + 1 + closing)
            if not named:
                if closing:
                    end = source.find(">", lt)
                    at = n if end < 0 else end + 1
                else:
                    add("#", (), "", "<")
                    at = lt + 1
                continue
            tag, first = named.group().lower(), named.end()
            end = source.find(">", first)
            if end < 0:
                break
            double, single = source.count('"', first, end), source.count("'", first, end)
            while (double % 2 or (single % 2 and not double)) and source.find("=", first, end) >= 0:
                more = source.find(">", end + 1)
                if more < 0 or source.find("<", end, more) >= 0:
                    break
                double, single, end = double + source.count('"', end, more), single + source.count("'", end, more), more
            inside = source[first:end]
            at = end + 1
            if tag in BLOCK:
                block += 1
            if closing:
                if beyond.get(tag):
                    beyond[tag] -= 1
                elif tag == "p":
                    pop_to({"p"}, {"table", "td", "th", "body"})
                elif tag not in VOID:
                    pop_to({tag}, {"td", "th", "table"} - {tag} if tag not in ("table", "tr", "tbody", "html", "body") else set())
                continue
            if tag in CLOSES_P:
                pop_to({"p"}, {"table", "td", "th", "body", "button"})
            if tag in SAME_ENDS:
                pop_to(*SAME_ENDS[tag])
            if tag == "body":
                pop_to({"head"}, set())
            words, mark = (), ""
            if "=" in inside:
                found = []
                for name, value in _ATTRIBUTE.findall(inside):
                    name, value = name.lower(), value.strip("\"'")
                    if name in ("class", "id", "role"):
                        found += _WORDS.findall(value.lower())
                    elif name == "data-main":
                        mark = value
                words = tuple(found)
            add(tag, words, mark, " " if tag == "br" else "")
            if tag in RAW:
                low = low or source.lower()
                end = low.find(f"</{tag}", at)
                if tag not in SKIP:
                    stack.append(len(self.tag) - 1)
                    add("#", (), "", source[at : n if end < 0 else end])
                    stack.pop()
                gt = -1 if end < 0 else source.find(">", end)
                at = n if gt < 0 else gt + 1
            elif tag not in VOID and not inside.endswith("/") or tag in ("p", "div", "li"):
                push(tag)


def features(page: Page) -> tuple[list[list[str]], np.ndarray]:
    """Feature names of each node, and its edge kind: 0 block, 1 inline, 2 text."""
    n = len(page.tag)
    own, linked = [0] * n, [0] * n
    for k in range(n - 1, 0, -1):
        if page.tag[k] == "#":
            own[k] = len(page.text[k])
        if page.tag[k] == "a":
            linked[k] = own[k]
        up = page.parent[k]
        own[up] += own[k]
        linked[up] += linked[k]
    names, kind = [], np.zeros(n, np.int64)
    for k in range(n):
        tag = page.tag[k]
        size = min(own[k].bit_length(), 8)
        if tag == "#":
            kind[k] = 2
            names.append([f"text{size}", f"in-{page.tag[page.parent[k]]}"])
            continue
        kind[k] = 0 if tag in BLOCK else 1
        share = 4 * linked[k] // own[k] if own[k] else 5
        names.append([f"<{tag}>", f"size{size}", f"links{share}", *(f".{w}" for w in page.words[k])])
    return names, kind


def forest_of(pages: list[tuple[list[list[str]], np.ndarray, list[int]]], index: dict[str, int], grow: bool = False) -> dict:
    """Pages as one forest: parents, depth levels, edge kinds and sparse features."""
    parent, kinds, cols, rows, base = [], [], [], [], 0
    for names, kind, up in pages:
        parent += [base + p if p >= 0 else -1 for p in up]
        kinds.append(kind)
        for k, own in enumerate(names):
            for name in own:
                col = index.setdefault(name, len(index)) if grow else index.get(name, -1)
                if col >= 0:
                    cols.append(col)
                    rows.append(base + k)
        base += len(up)
    parent = np.array(parent, np.int64)
    deep: list[int] = []
    for p in parent.tolist():  # a parent comes before its children
        deep.append(deep[p] + 1 if p >= 0 else 0)
    depth = np.array(deep, np.int64)
    order = np.argsort(depth, kind="stable")
    edges = np.searchsorted(depth[order], np.arange(depth.max() + 2)) if base else np.zeros(1, int)
    return {"parent": parent, "levels": [order[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)], "kind": np.concatenate(kinds) if kinds else np.zeros(0, np.int64), "col": np.array(cols, np.int64), "row": np.array(rows, np.int64), "n": base}


def _add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def sum_product(forest: dict, unary: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log beliefs of each node (n x 2), of each edge to the parent (n x 2 parent x 2 child), and log Z (summed); unary is n log-odds, edge 3 x 2 x 2."""
    n, parent, levels = forest["n"], forest["parent"], forest["levels"]
    up = np.zeros((n, 2))
    up[:, 1] = unary
    sent = np.zeros((n, 2))
    E = edge[forest["kind"]]
    for level in reversed(levels[1:]):
        m = _add(up[level, 0, None] + E[level, :, 0], up[level, 1, None] + E[level, :, 1])
        sent[level] = m
        np.add.at(up, parent[level], m)
    belief = up.copy()
    pair = np.zeros((n, 2, 2))
    for level in levels[1:]:
        outside = belief[parent[level]] - sent[level]
        pair[level] = outside[:, :, None] + E[level] + up[level, None, :]
        belief[level] += _add(outside[:, 0, None] + E[level, 0, :], outside[:, 1, None] + E[level, 1, :])
    z = _add(up[levels[0], 0], up[levels[0], 1]).sum() if n else 0.0
    return belief, pair, z


def labels_of(page: Page) -> np.ndarray:
    out = np.zeros(len(page.tag), np.int64)
    for k in range(1, len(out)):
        out[k] = int(page.mark[k]) if page.mark[k] else out[page.parent[k]]
    return out


def train(sources: list[str], steps: int = STEPS, rate: float = 0.15, decay: float = 1e-4) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """Feature index, weights and edge potentials (3 x 2 x 2) that make the marked labels likeliest."""
    pages = [Page(s) for s in sources]
    index: dict[str, int] = {}
    f = forest_of([(*features(p), p.parent) for p in pages], index, grow=True)
    y = np.concatenate([labels_of(p) for p in pages])
    w, edge = np.zeros(len(index)), np.zeros((3, 2, 2))
    child = np.flatnonzero(f["parent"] >= 0)
    seen_w = np.bincount(f["col"], weights=y[f["row"]].astype(float), minlength=len(w))
    seen_e = np.zeros((3, 2, 2))
    np.add.at(seen_e, (f["kind"][child], y[f["parent"][child]], y[child]), 1)
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, edge)]
    for step in range(1, steps + 1):
        unary = np.bincount(f["row"], weights=w[f["col"]], minlength=f["n"])
        belief, pair, _ = sum_product(f, unary, edge)
        p = 0.5 + 0.5 * np.tanh((belief[:, 1] - belief[:, 0]) / 2)
        both = np.exp(pair[child] - pair[child].max(axis=(1, 2), keepdims=True))
        both /= both.sum(axis=(1, 2), keepdims=True)
        want_e = np.zeros((3, 2, 2))
        np.add.at(want_e, f["kind"][child], both)
        grads = (seen_w - np.bincount(f["col"], weights=p[f["row"]], minlength=len(w))) / len(pages) - decay * w, (seen_e - want_e) / len(pages) - decay * edge
        for x, g, (m, v) in zip((w, edge), grads, state, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g**2 - v)
            x += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return index, w, edge


@lru_cache(maxsize=1)
def trained(pages: int = TRAINING_PAGES) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    return train([labelled_page(k) for k in range(pages)])


def marginals(pages: list[Page], model: tuple[dict[str, int], np.ndarray, np.ndarray]) -> list[np.ndarray]:
    index, w, edge = model
    f = forest_of([(*features(p), p.parent) for p in pages], index)
    belief, _, _ = sum_product(f, np.bincount(f["row"], weights=w[f["col"]], minlength=f["n"]) if f["n"] else np.zeros(0), edge)
    p = 0.5 + 0.5 * np.tanh((belief[:, 1] - belief[:, 0]) / 2)
    return np.split(p, np.cumsum([len(x.tag) for x in pages])[:-1])


def text_of(page: Page, p: np.ndarray) -> str:
    blocks: dict[int, list[str]] = {}
    for k, text in enumerate(page.text):
        if text and p[k] >= 0.5 and page.tag[k] == "#":
            blocks.setdefault(page.block[k], []).append(text)
    joined = (" ".join(_html.unescape("".join(x)).split()) for x in blocks.values())
    return " ".join(x for x in joined if x)


def extract_texts(sources: list[str | None], model: tuple[dict[str, int], np.ndarray, np.ndarray]) -> list[str]:
    pages = [Page(s or "") for s in sources]
    return [text_of(page, p) for page, p in zip(pages, marginals(pages, model), strict=True)] if pages else []


def extract(pages: DataFrame, key: str = "page_id", html: str = "html", model: tuple | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """Per row: key, text string (the article's), n_chars long (its code points), and the columns named in also."""
    kind = pages.schema[key].dataType.simpleString()
    more = [f"also{k}" for k in range(len(also))]
    held = pages.sparkSession.sparkContext.broadcast(model or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "h", SLICE_BYTES):
            texts = extract_texts(part.column(1).to_pylist(), held.value)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64()), *part.columns[2:]], ["key", "text", "n_chars", *more])

    schema = ", ".join(["key " + kind, "text string", "n_chars long", *(f"{m} {pages.schema[c].dataType.simpleString()}" for m, c in zip(more, also, strict=True))])
    found = pages.select(pages[key].alias("key"), pages[html].alias("h"), *[pages[c].alias(m) for m, c in zip(more, also, strict=True)]).mapInArrow(lean(run), schema)
    return found.withColumnsRenamed({"key": key} | dict(zip(more, also, strict=True)))
