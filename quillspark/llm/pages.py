"""Main text of HTML pages by equivalence-class template deduction (operator 10).

Each page is read once into tokens: an opening tag at its place (the path of open elements, with class and id), and a
block of text at its place. A token's occurrence vector says how often each page of a host holds it. Tokens of a host
with equal vectors form an equivalence class; a class that most pages of the host share, and that has tokens enough not
to be chance, belongs to the host's template. Pages of a host that say the same are one page here, and a class needs
three pages that differ, or a copied text would look like template. Vectors are never gathered: the sum over pages of a
random number of the page times the occurrences is a fingerprint of the vector, so classes come from sums that start
before the shuffle, and a host with a third of all pages costs no more than another.

A class is part of the template only if the places that its tokens stand in are: places are hashes of the place around
them and their own name, so classes nest as elements do. What a page holds besides blocks of its host's template, the same text at the same place of most
pages, is its slots. Which slots are the main text is told by tags and names: slots inside a place that names its role
(menu, header, footer, sidebar, notice, advert, form, comments) are dropped, and if the page marks its main part
(article, main), the slots inside are the text. A name such as no-comments or has-sidebar names no role, and a place that
holds the marked main part, or more than half of the page's text that is not template, is text whatever its name, but for
comments beside other text. A form or a field set is such a place too, though text if it is wrapped around nearly all there
is; the header of a marked main part is its heading; a marked part that holds less than a third of what isn't template is a
teaser, and all slots are text. A marked main part that is template for the most part is left whole, as
edited copies of one article share more than they differ in.

Defined results: a null or empty page, and one with no text, gives the empty text; a page whose URL is null or names no host has no template;
unclosed, misnested and cut-off markup is read as far as it goes, whatever its depth; what is no UTF-8 reads as U+FFFD; pages are read whole; equal pages give equal texts; a
host of fewer than three distinct contents has no template and is read by its own structure; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as K
from .runtime import Scratch, table, tune

#: An attribute: a quote opens a value only straight after the equals sign; anywhere else it is a character like others.
_ATTRIBUTE = r"[^\s/>][^\s/>=]*(?:\s*=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^\s>\"'][^\s>]*)?)?"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[\s/]+|{_ATTRIBUTE})*+)(?:>|\Z)", re.S)
_EACH = re.compile(rf"[\s/]+|({_ATTRIBUTE})", re.S)
_WHITE = re.compile(r"\s+")
_ROLE_PART = re.compile(r"[a-z]+")

#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup.
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
SKIPPED = RAW - {"textarea", "title"}
#: Elements that stand in a line of text; all others start a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that an opening block tag closes where their end tag is left out, and up to where.
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li", ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
#: Elements and words in class, id or role that name a role other than the main text.
OUT = frozenset("nav header footer aside script style noscript template iframe button select option textarea title head svg canvas object audio video input".split())
#: Elements that are another role too, unless they are wrapped around nearly all that the page says.
WRAPPERS = frozenset("form fieldset label dialog menu".split())
OUT_WORDS = frozenset("ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments cookie cookies disqus footer header login masthead menu modal nav navbar navigation newsletter notice pagination popup promo promoted related reply replies search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget alert complementary contentinfo".split())
#: Words beside one of these that take its role from a name: what a place is without, or stands beside.
NOT_WORDS = frozenset("has have no non not with without is hide hides show shows free".split())
#: Words of a text whose parts may be named so: an entry's header is its heading.
TEXT_WORDS = frozenset("article content entry main post story text".split())
#: Roles that may well outweigh the text.
REPLIES = frozenset("comment comments disqus replies reply".split())
MAIN = frozenset(("article", "main"))

#: A form or the like is a wrapper of the text if it holds so many times what stands beside it in no named place.
WRAPPED = 4
#: A marked main part that holds less than one in so many characters of the text is one teaser of several, or beside the text.
TEASER = 3
MIN_SHARE = 0.5
#: Distinct contents of a host that hold a class of its template: two pages alone don't tell a template from a text that both carry.
MIN_PAGES = 3
MIN_CLASS = 2


class Role:
    """A place whose name says that it is not the main text; ``parent`` is the named place around it. Places are numbered as they open."""

    __slots__ = ("number", "parent", "replies", "wrapper")

    def __init__(self, number: int, replies: bool, parent: Role | None, wrapper: bool = False) -> None:
        self.number, self.replies, self.parent, self.wrapper = number, replies, parent, wrapper


#: Where no named place is around.
NOWHERE = Role(0, False, None)


class Block:
    """A block of text; ``role`` is the innermost named place around it, ``above`` the one around its outermost marked main
    part (None without one), ``out`` whether an element's kind rules it out."""

    __slots__ = ("above", "out", "path", "role", "text")

    def __init__(self, path: int, text: str, above: Role | None, out: bool, role: Role) -> None:
        self.path, self.text, self.above, self.out, self.role = path, text, above, out, role


def role_of(value: str) -> str:
    """The word of a class, id or role that names another role than the main text, else the empty text."""
    for whole in value.split():
        words = _ROLE_PART.findall(whole)
        named = next((w for w in words if w in OUT_WORDS), "")
        if named and not any(w in NOT_WORDS for w in words) and not (named == "header" and any(w in TEXT_WORDS for w in words)):
            return named
    return ""


@lru_cache(maxsize=4096)
def _names(attributes: str) -> tuple[str, str, bool]:
    """A place's name from class and id; the word that names another role; does it name the main part?"""
    if "=" not in attributes:
        return "", "", False
    name, role, main = "", "", False
    for key, _, value in (x.partition("=") for x in _EACH.findall(attributes)):
        key, value = key.strip().lower(), value.strip()
        if key not in ("class", "id", "role"):
            continue
        if value[:1] in ("'", '"'):
            value = value[1:].removesuffix(value[0])
        value = html.unescape(value).strip().lower()
        role = role or role_of(value)
        main = main or (key == "role" and value == "main")
        if key != "role" and not any(c.isdigit() for c in value):
            name += f".{value}"
    return name, role, main


def read(page: str) -> tuple[list[Block], list[tuple[int, int]]]:
    """Blocks of text in order, and the places of opening tags, each with the place around it.

    A place is a hash of the one around it and of its own name, so depth costs nothing."""
    blocks: list[Block] = []
    places: list[tuple[int, int]] = []
    # (element, place, named place around the main part, ruled out?, named place)
    stack: list[tuple[str, int, Role | None, bool, Role]] = [("", 0, None, False, NOWHERE)]
    opened: dict[str, int] = {}  # how many of an element are on the stack
    held: list[str] = []
    raw: str | None = None
    named = 0

    def flush() -> None:
        if held:
            text = _WHITE.sub(" ", html.unescape("".join(held))).strip()
            held.clear()
            if text:
                _, path, above, out, role = stack[-1]
                blocks.append(Block(path, text, above, out, role))

    def close_to(depth: int) -> None:
        flush()
        while len(stack) > depth:
            opened[stack.pop()[0]] -= 1

    def push(name: str, place: int, above: Role | None, out: bool, role: Role) -> None:
        opened[name] = opened.get(name, 0) + 1
        stack.append((name, place, above, out, role))

    at, size = 0, len(page)
    while at < size:
        if raw is not None:
            end = re.compile(rf"</{re.escape(raw)}(?=[\s/>]|\Z)", re.I).search(page, at)
            at, raw = (end.start() if end else size), None
            continue
        found = _TOKEN.search(page, at)
        if found is None:
            held.append(page[at:])
            break
        if found.start() > at:
            held.append(page[at : found.start()])
        at = found.end()
        if found.group(2) is None:
            continue
        name, attributes = found.group(2).lower(), found.group(3)
        if found.group(1):
            if name == "br":
                held.append(" ")
                continue
            if not opened.get(name):
                if name not in INLINE:
                    flush()
            elif name in INLINE:
                depth = len(stack) - 1
                while stack[depth][0] != name and stack[depth][0] in INLINE:
                    depth -= 1
                if stack[depth][0] == name:
                    while len(stack) > depth:
                        opened[stack.pop()[0]] -= 1
            else:
                close_to(next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == name))
            continue
        if name == "br":
            held.append(" ")
            continue
        if name in VOID:
            if name not in INLINE:
                flush()
            continue
        if name in INLINE:
            _, path, above, out, role = stack[-1]
            _, word, _ = _names(attributes)
            if word and not out and role is NOWHERE:
                flush()
                named += 1
                push(name, path, above, out, Role(named, word in REPLIES, role))
            elif name == "label" and not out:
                flush()
                named += 1
                push(name, path, above, out, Role(named, False, role, True))
            elif out or role is not NOWHERE:
                push(name, path, above, out, role)
            continue
        if name in SKIPPED:  # no boundary of a block: what stands before and after it reads on
            end = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = end.start() if end else size
            continue
        flush()
        if name in CLOSES_P:
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] not in INLINE), 0)
            if depth and stack[depth][0] == "p":
                close_to(depth)
        elif name in SIBLINGS:
            ends, bounds = SIBLINGS[name]
            lowest = len(stack)
            for k in range(len(stack) - 1, 0, -1) if any(opened.get(x) for x in ([ends] if isinstance(ends, str) else ends)) else ():
                if stack[k][0] in bounds:
                    break
                if stack[k][0] in ends:
                    lowest = k
            if lowest < len(stack):
                close_to(lowest)
        if name == "body":
            if opened.get("head"):
                close_to(next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == "head"))
        label, word, marked = _names(attributes)
        _, path, above, out, role = stack[-1]
        place = token(str(path), name + label)
        places.append((place, path))
        if not attributes.rstrip().endswith("/") or name in RAW:
            if word and name not in ("html", "body", "main"):
                named += 1
                role = Role(named, word in REPLIES, role)
            elif name in WRAPPERS:
                named += 1
                role = Role(named, False, role, True)
            # The header of a marked main part is its heading.
            out = out or (name in OUT and not (name == "header" and above is not None))
            if above is None and not out and (name in MAIN or marked):
                above = role
            push(name, place, above, out, role)
            if name in RAW:
                raw = name
    flush()
    return blocks, places


def token(*parts: str) -> int:
    return xxhash.xxh3_64_intdigest("\x1f".join(parts)) - (1 << 63)


def text_token(block: Block) -> int:
    return token("text", str(block.path), block.text)


def tokens_of(blocks: list[Block], places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Tokens with the places that they stand in: opening tags and blocks of text."""
    return places + [(text_token(b), b.path) for b in blocks]


def _around(roles: list[Role]) -> list[Role]:
    """The named places and all those around them, outer ones first."""
    found: dict[int, Role] = {}
    for role in roles:
        while role is not NOWHERE and role.number not in found:
            found[role.number] = role
            role = role.parent
    return [found[k] for k in sorted(found)]


def _within(blocks: list[Block], kept: set[int]) -> set[int]:
    """Numbers of the named places of blocks that are kept with all those around them; 0 for no place."""
    fine = {0}
    for role in _around([b.role for b in blocks] + [b.above for b in blocks if b.above is not None]):
        if role.number in kept and role.parent.number in fine:
            fine.add(role.number)
    return fine


def _whole(live: list[Block]) -> set[int]:
    """Named places that are not what their names say: they hold the marked main part, or most of what the page says."""
    clear = [b for b in live if b.role is NOWHERE]
    kept: set[int] = set()
    if not any(b.above is not None for b in clear):
        kept = {r.number for r in _around([b.above for b in live if b.above is not None]) if not (r.replies and clear)}
    scope, fine = live, _within(live, kept)
    if any(b.above is not None and b.role.number in fine for b in live):
        scope = [b for b in live if b.above is not None and b.above.number in fine]
    sizes: dict[int, int] = {}
    for b in scope:
        sizes[b.role.number] = sizes.get(b.role.number, 0) + len(b.text)
    total = sum(sizes.values())
    around = _around([b.role for b in scope])
    for role in reversed(around):  # inner ones first
        sizes[role.parent.number] = sizes.get(role.parent.number, 0) + sizes.get(role.number, 0)
    beside = WRAPPED * sum(len(b.text) for b in clear)
    return kept | {r.number for r in around if 2 * sizes.get(r.number, 0) > total and not (r.replies and clear) and not (r.wrapper and sizes[r.number] < beside)}


def main_text(page: str, template: frozenset[int] | set[int]) -> str:
    blocks, _ = read(page)
    slots = [b for b in blocks if not b.out]
    if any(b.role is not NOWHERE for b in slots):
        fine = _within(slots, _whole([b for b in slots if text_token(b) not in template]))
        slots = [b for b in slots if b.role.number in fine]
    fresh = [b for b in slots if text_token(b) not in template] or slots
    sizes = [sum(len(b.text) for b in fresh if (b.above is not None) == here) for here in (True, False)]
    marked = any(b.above is not None for b in slots) and TEASER * sizes[0] >= sum(sizes)
    if marked:
        slots = [b for b in slots if b.above is not None]
    if template:
        left = [b for b in slots if text_token(b) not in template]
        # A main part that is template for the most part is one of many edited copies, not a frame with little in it.
        if not marked or 2 * sum(len(b.text) for b in left) > sum(len(b.text) for b in slots):
            slots = left
    return "\n\n".join(b.text for b in slots)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))


def content_of(blocks: list[Block]) -> int:
    """A fingerprint of what a page says: copies of a text are one content, whatever stands around it."""
    said = {b.text for b in blocks if not b.out and b.role is NOWHERE} or {b.text for b in blocks if not b.out} or {b.text for b in blocks}
    return token("content", *sorted(said))


def occurrences(pages: DataFrame) -> DataFrame:
    """(host, content, token, place, n): how often each content of a host holds each token, and the place it stands in.

    Copies of a page count once a host, or a text that is copied often would be its host's template. Pages whose URL
    names no host have nothing in common that a template could be taken from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents, found, places, counts = [], [], [], []
            for page in K.strings(batch.column(1)):
                blocks, tags = read(page or "")
                n: dict[tuple[int, int], int] = {(token("page"), 0): 1}
                for t in tokens_of(blocks, tags):
                    n[t] = n.get(t, 0) + 1
                own = sorted(n)
                contents.append(content_of(blocks))
                found.append([t for t, _ in own])
                places.append([p for _, p in own])
                counts.append([n[t] for t in own])
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (found, places, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(contents, pa.int64()), *lists], ["host", "content", "found", "places", "counts"])

    seen = pages.where("host <> ''").select("host", "html").mapInArrow(run, "host string, content long, found array<long>, places array<long>, counts array<long>")
    distinct = seen.groupBy("host", "content").agg(F.min(F.struct("found", "places", "counts")).alias("page"))
    each = distinct.select("host", "content", F.explode(F.arrays_zip("page.found", "page.places", "page.counts")).alias("t"))
    return each.select("host", "content", F.col("t.found").alias("token"), F.col("t.places").alias("place"), F.col("t.counts").alias("n"))


def classes_of(found: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, tokens, places, pages, all_pages): the equivalence classes of tokens that MIN_PAGES contents or more hold.

    The sum over contents of a random number times the occurrences is a fingerprint of a token's occurrence vector."""
    random = F.xxhash64(F.lit("page"), "content")
    va, vb = F.col("n") * F.shiftrightunsigned(random, 34), F.col("n") * random.bitwiseAND(F.lit(0x3FFFFFFF))
    by_token = found.groupBy("host", "token", "place").agg(F.count("*").alias("pages"), F.sum(va.cast("decimal(38,0)")).alias("va"), F.sum(vb.cast("decimal(38,0)")).alias("vb"))
    by_token = scratch.keep(by_token.where(F.col("pages") >= MIN_PAGES))
    classes = by_token.where(F.col("token") != token("page")).groupBy("host", "pages", "va", "vb").agg(F.collect_list(F.struct("token", "place")).alias("tokens"))
    total = by_token.where(F.col("token") == token("page")).select(F.col("host").alias("of_host"), F.col("pages").alias("all_pages"))
    return classes.join(total, F.col("host") == F.col("of_host")).select("host", F.col("tokens.token").alias("tokens"), F.col("tokens.place").alias("places"), "pages", "all_pages")


def templates(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, template array<long>): the tokens of the valid classes of each host, nested.

    A class is valid if half of the host's contents hold it, if it has MIN_CLASS tokens (the place that a text stands in
    counts), and if each place that its tokens stand in is held by the host's template too, or is one of its own."""
    # Tokens that most pages of a host hold are no more than twice those of its mean page.
    shared = classes_of(occurrences(pages), scratch).where(F.col("pages") >= MIN_SHARE * F.col("all_pages"))
    held = shared.groupBy("host").agg(F.flatten(F.collect_list("tokens")).alias("held"), F.collect_list(F.struct("tokens", "places")).alias("classes"))
    nested = F.filter("classes", lambda c: (F.size(c["tokens"]) >= MIN_CLASS) & (F.size(F.array_except(F.filter(c["places"], lambda p: p != 0), F.col("held"))) == 0))
    return held.select("host", F.flatten(F.transform(nested, lambda c: c["tokens"])).alias("template")).where(F.size("template") > 0)


def extract(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of pages."""
    rows = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
    found = scratch.keep(templates(rows, scratch)).withColumnRenamed("host", "of_host")
    joined = rows.join(found, F.col("host") == F.col("of_host"), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str | None, frozenset[int]] = (None, frozenset())
        for batch in batches:
            texts = []
            for name, page, template in zip(batch.column("host").to_pylist(), K.strings(batch.column("html")), batch.column("template"), strict=True):
                if last[0] != name:
                    last = (name, frozenset(template.as_py() or ()))
                texts.append(main_text(page or "", last[1]))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = dict(pages.dtypes)["page_id"]
    return joined.select("page_id", "url", "html", "host", "template").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return extract(table(spark, sf_dir, "pages"), Scratch(spark, "op10"))


