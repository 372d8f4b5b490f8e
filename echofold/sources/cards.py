"""Cards on HTML pages as raw rows.

Markup has no built-in reader, so one Arrow UDF a page lists what stands on each card: images, links, and one token for
each text node. Which of them is the name, a value or an age is told by built-in functions over those arrays. A token
that touches a subscript (within one, or its element holds one) is never part of a value, as joined figures would make
plausible wrong numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echofold.functions.parse import BASE58, column_source, mint_from_href, mint_from_image, trimmed
from echofold.functions.pieces import pieces
from echofold.functions.text import label_key
from echofold.model import RAW_ROW

#: Fixed values of HTML and of the cards: labels, and the shapes of money, ages, and shortened keys.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
MARKET_CAP = ["MC", "MCAP", "M.CAP", "MKT CAP", "MARKET CAP"]
VOLUME = ["V", "VOL", "VOLUME"]
MONEY = r"^(?i)\$?[0-9][0-9,]*(?:\.[0-9]+)?\s*[KMBT]?$"
NUMBER = r"[0-9]+(?:\.[0-9]+)?"
DURATION, LONE_NUMBER, LONE_UNIT = rf"^(?i){NUMBER}\s*[smhdw]$", f"^{NUMBER}$", "^(?i)[smhdw]$"
SHORTENED = r"^.{2,}(?:\.{3}|…).{2,}$"
PIECES, HEADING_TOKENS = 4, 6
DEEPEST = 512
CARD = f"{RAW_ROW}, source string, attrMint string, tokens array<string>"
LISTED = "array<struct<attribute: string, images: array<struct<src: string, alt: string>>, links: array<string>, tokens: array<struct<text: string, sub: boolean>>, heading: string>>"

LISTED_ARROW = pa.list_(pa.struct([("attribute", pa.string()), ("images", pa.list_(pa.struct([("src", pa.string()), ("alt", pa.string())]))), ("links", pa.list_(pa.string())), ("tokens", pa.list_(pa.struct([("text", pa.string()), ("sub", pa.bool_())]))), ("heading", pa.string())]))
#: Pages whose tokens a task's Python holds at a time.
PAGE_BYTES = 1 << 18


@dataclass(frozen=True)
class Markup:
    """Where cards keep what is read: the key attribute, the column element, and the routes of fallback links."""

    attribute: str = "data-pulse-token-address"
    column: str = "section"
    launch: str = "coin"
    pair: str = "meme"


@dataclass
class Node:
    """An element as ranges: how many tokens, images, links and subscripts stood before it began, and before it ended."""

    tag: str
    column: int | None  # the nearest column that it is in or is
    begin: tuple[int, int, int, int]
    end: tuple[int, int, int, int] | None = None
    key: str | None = None


class Listing(HTMLParser):
    """A page's elements and tokens in one pass. Elements over DEEPEST deep are siblings, as in browsers."""

    def __init__(self, source: str, markup: Markup):
        super().__init__(convert_charrefs=True)
        self.markup, self.subs, self.within_sub = markup, 0, 0
        self.texts: list[tuple[str, int, bool]] = []  # text, its element, whether that is within a subscript
        self.images: list[dict] = []
        self.links: list[str] = []
        self.nodes, self.open = [Node("", None, (0, 0, 0, 0))], [0]
        self.feed(source)
        self.close()
        while self.open:
            self._end()

    def _now(self) -> tuple[int, int, int, int]:
        return len(self.texts), len(self.images), len(self.links), self.subs

    def _end(self) -> None:
        node = self.nodes[self.open.pop()]
        node.end = self._now()
        self.within_sub -= node.tag == "sub"

    def parse_marked_section(self, i, report=1):
        return self.parse_bogus_comment(i)  # what HTML has for "<![", which the parser would refuse

    def handle_starttag(self, tag, attrs):
        values = {k: v or "" for k, v in attrs}
        if tag == "img" and "src" in values:
            self.images.append({"src": values["src"], "alt": values.get("alt")})
        if tag == "a" and "href" in values:
            self.links.append(values["href"])
        self.subs += tag == "sub"
        if len(self.open) > DEEPEST and tag not in VOID:
            self._end()
        own = len(self.nodes)
        self.nodes.append(Node(tag, own if tag == self.markup.column else self.nodes[self.open[-1]].column, self._now(), key=values.get(self.markup.attribute)))
        if tag in VOID:
            self.nodes[own].end = self._now()
        else:
            self.open.append(own)
            self.within_sub += tag == "sub"

    def handle_endtag(self, tag):
        if any(self.nodes[k].tag == tag for k in self.open[1:]):
            while self.nodes[self.open[-1]].tag != tag:
                self._end()
            self._end()

    def handle_data(self, data):
        if text := " ".join(data.split()):
            self.texts.append((text, self.open[-1], self.within_sub > 0))

    def cards(self) -> list[dict]:
        """The cards in document order, each as LISTED has it; a token touches a subscript if its element holds one, too."""
        holds = [node.end[3] > node.begin[3] for node in self.nodes]
        tokens = [{"text": text, "sub": sub or holds[own]} for text, own, sub in self.texts]
        out = []
        for node in (x for x in self.nodes if x.key is not None):
            column = self.nodes[node.column] if node.column is not None else None
            (t, i, k, _), (t_end, i_end, k_end, _) = node.begin, node.end
            heading = [x["text"] for x in tokens[column.begin[0] : min(column.end[0], column.begin[0] + HEADING_TOKENS)]] if column else []
            out.append({"attribute": node.key, "images": self.images[i:i_end], "links": self.links[k:k_end], "tokens": tokens[t:t_end], "heading": " ".join(heading)})
        return out


def listed(source: str | None, markup: Markup) -> list[dict]:
    return Listing(source or "", markup).cards()


def _text(tokens: Column, k: Column) -> Column:
    return F.get(tokens, k)["text"]


def _first(values: Column) -> Column:
    return F.get(F.filter(values, lambda x: x.isNotNull()), F.lit(0))


def _money_after(tokens: Column, k: Column) -> Column:
    """The longest run of up to PIECES tokens after place k that reads as money and touches no subscript."""
    runs = [F.slice(tokens, k + 2, n) for n in range(PIECES, 0, -1)]
    texts = [F.array_join(F.transform(run, lambda t: t["text"]), "") for run in runs]
    return F.coalesce(*[F.when(~F.exists(run, lambda t: t["sub"]) & text.rlike(MONEY), text) for run, text in zip(runs, texts, strict=True)])


def labelled(tokens: Column, labels: list[str]) -> Column:
    """The value that goes with one of the labels: told by the first token that is a label with a value behind it, or
    that has label and value in one; where a subscript is touched there, the value is null and no later one is taken."""

    def told(token: Column, k: Column) -> Column:
        key = label_key(token["text"])
        behind = F.when(F.get(tokens, k + 1)["sub"], F.struct(F.lit(None).cast("string").alias("value")))
        behind = F.coalesce(behind, F.when(_money_after(tokens, k).isNotNull(), F.struct(_money_after(tokens, k).alias("value"))))
        rests = [F.when(key.startswith(x) & (key != x), trimmed(F.substr(token["text"], F.lit(len(x) + 1)))) for x in labels]
        rest = _first(F.array(*[F.when(r.rlike(MONEY), r) for r in rests]))
        merged = F.when(rest.isNotNull(), F.struct(F.when(~token["sub"], rest).alias("value")))
        return F.when(key.isin(labels), behind).otherwise(merged)

    return _first(F.transform(tokens, told))["value"]


def age_from(tokens: Column, start: Column) -> Column:
    """The first age at place start or later: one token, or a number and its unit in two."""

    def told(k: Column) -> Column:
        text, following = _text(tokens, k), _text(tokens, k + 1)
        return F.when(text.rlike(DURATION), text).when(text.rlike(LONE_NUMBER) & following.rlike(LONE_UNIT), F.concat(text, following))

    places = F.when(start < F.size(tokens), F.sequence(start, F.size(tokens) - 1))
    return _first(F.transform(places, told))


def cards(pages: DataFrame, key: str = "page_id", html: str = "html", markup: Markup = Markup()) -> DataFrame:
    """key, pos, and the columns of CARD, a row for each card in document order."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in pieces(batch["html"], PAGE_BYTES):
                piece = batch.slice(at, n)
                yield pa.RecordBatch.from_arrays([piece[key], pa.array([listed(x, markup) for x in piece["html"].to_pylist()], LISTED_ARROW)], [key, "cards"])

    link = lambda route: mint_from_href(F.get(F.filter("links", lambda x: x.contains(f"/{route}/")), F.lit(0)), route)
    own = F.when(trimmed(F.col("attribute")).rlike(BASE58), trimmed(F.col("attribute")))
    own_key = pages.schema[key].dataType.simpleString()
    lists = pages.select(key, F.col(html).alias("html")).mapInArrow(read, f"`{key}` {own_key}, cards {LISTED}")
    rows = lists.select(key, F.posexplode("cards").alias("pos", "card")).select(key, "pos", "card.*")
    rows = rows.withColumn("attrMint", own).withColumn("mint", F.coalesce("attrMint", _first(F.transform("images", lambda i: mint_from_image(i["src"]))), link(markup.launch), link(markup.pair)))
    rows = rows.withColumns({"image": F.get(F.filter("images", lambda i: F.col("mint").isNull() | F.coalesce(mint_from_image(i["src"]) == F.col("mint"), F.lit(False))), F.lit(0)), "anchor": F.array_position(F.transform("tokens", lambda t: t["text"].rlike(SHORTENED)), True).cast("int") - 1})
    tokens, anchor = F.col("tokens"), F.when(F.col("anchor") >= 0, F.col("anchor"))
    rows = rows.withColumns({"shown": _text(tokens, anchor + 2), "unnamed": F.coalesce(_text(tokens, anchor + 2).rlike(DURATION), F.lit(False))})
    return rows.select(
        key, "pos", F.concat(F.lit(f"/{markup.pair}/"), "mint").alias("mintHref"), _text(tokens, anchor).alias("mintText"), F.coalesce(F.col("image.alt"), F.when(~F.col("unnamed"), F.col("shown"))).alias("name"),
        _text(tokens, anchor + 1).alias("symbol"), F.col("image.src").alias("imageUrl"), F.lit(None).cast("string").alias("metadataUri"), labelled(tokens, MARKET_CAP).alias("marketCap"), labelled(tokens, VOLUME).alias("volume"),
        age_from(tokens, anchor + F.when(F.col("unnamed"), 2).otherwise(3)).alias("age"), column_source(F.col("heading")).alias("source"), "attrMint", F.transform(tokens, lambda t: t["text"]).alias("tokens"),
    )


#: What a capture must not hold when it is handed on.
FORBIDDEN = {
    "jwt": r"\beyJ[A-Za-z0-9_-]{10,}", "bearer token": r"(?i)\bBearer\s+[A-Za-z0-9._-]{10,}", "api key": r"(?i)\b(?:api[_-]?key|secret|privateKey)\b\s*[:=]",
    "email address": r"[\w.+-]+@[\w-]+\.[\w.]{2,}", "hydration payload": r"self\.__next_f",
}


def wanted_sections(html: Column, markup: Markup = Markup()) -> Column:
    """The column elements that hold a card or a link to a pair, in page order; an element that holds others of its kind is read as those."""
    begin, end = f"<{markup.column}", rf"(?i)</{markup.column}\s*>"
    inner = F.transform(F.filter(F.split(F.regexp_replace(html, rf"(?i){begin}\b", begin), end), lambda x: x.contains(begin)), lambda x: F.substring_index(x, begin, -1))
    shown = rf"""(?i)\s{markup.attribute}\s*=|<a\b[^>]*\bhref\s*=\s*["'][^"']*/{markup.pair}/"""
    return F.transform(F.filter(inner, lambda x: x.rlike(shown)), lambda x: F.concat(F.lit(begin), x, F.lit(f"</{markup.column}>")))


def scrubbed(pages: DataFrame, key: str = "page_id", html: str = "html", markup: Markup | None = None) -> DataFrame:
    """key, html without scripts, styles, frames and icons and with data URIs replaced, and refused: the forbidden patterns left.

    markup: only its wanted sections are kept, and a page without one is refused, too. A page with an empty refused may be handed on.
    """
    text = F.regexp_replace(html, r"(?is)<(script|noscript|style|iframe|svg)\b[^>]*>.*?</\1\s*>|<link\b[^>]*>", "")
    text = F.regexp_replace(text, r"""(?i)(<img\b[^>]*\bsrc\s*=\s*["'])data:[^"']*""", "$1data:image/gif;base64,R0lGODlhAQABAAAAACw=")
    rows = pages.select(key, text.alias("html"))
    if markup is not None:
        rows = rows.withColumn("html", F.array_join(wanted_sections(F.col("html"), markup), "\n"))
    hits = [F.when(F.col("html").rlike(p), F.lit(name)) for name, p in FORBIDDEN.items()]
    none = [F.when(F.coalesce(F.col("html"), F.lit("")) == "", F.lit("no sections"))] if markup is not None else []
    return rows.withColumn("refused", F.array_compact(F.array(*hits, *none)))
