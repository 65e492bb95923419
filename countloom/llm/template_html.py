"""Main text of web pages by template deduction over the pages of a host.

A page is a sequence of tokens: tags by their path (with class and id), and text blocks by path and
text.  Over a host's pages a token has an occurrence vector (how often it is on each page); tokens
with equal vectors form an equivalence class.  A class is valid if it occurs on LEAST_PAGES
different pages and its tokens keep their order (each is always preceded by the same one).  Classes nest: what
stands before a class's tokens belongs to the class itself or to one other, its parent, which must be valid and on all its
pages too; the root is the class of the page itself.  A class belongs to the template if its parent does and it is on NEARLY all pages
that have the parent; so text that some pages share is content, and what every page repeats is not.  Text of
the template's classes of two tokens or more is left out, and the slots that remain are judged by where they lie and extracted.

Vectors are never built: a vector's fingerprint is a sum over pages of hashes of (page, occurrences), so
the pages of a host, however many, are only ever summed up, within tasks first.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countloom.llm.common import bounded_batches, cut, give_back, utf8_list

#: Different pages that a class needs, and its least share of the pages that have its parent.
LEAST_PAGES, NEARLY = 4, 0.9
#: Pages are told apart by this many sets of 63 bits, each by a hash of its own: four pages pass for three once in 10 ** 8 times.
MASKS = 8
#: Template tokens of all hosts that may be broadcast; beyond it they are joined.
BROADCAST_TOKENS = 1_000_000

OPEN = re.compile(r"<(?:(/?)([a-zA-Z][a-zA-Z0-9:-]*)|[!?])")
STOP = re.compile("[>\"']")
NAMES = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
SPACE = re.compile(r"\s+")

# Elements and words that say what a part of a page is.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg canvas select xmp noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hgroup html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog button head".split())
BOILERPLATE_WORDS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead topbar footer sidebar aside widget widgets ad ads adv advert adverts"
    " advertisement advertising banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices alert popup modal overlay"
    " newsletter subscribe subscription signup comment comments reply replies respond disqus discussion share sharing social related"
    " recommended recommendations login toolbar pagination pager skip copyright".split()
)
#: Words that say nothing beside those: a class is boilerplate if all its words are of either kind and one of the former.
NEUTRAL_WORDS = frozenset(
    "a the and for of in on to site page blog post article entry main global primary secondary top bottom left right center upper lower mobile desktop"
    " box block bar section container wrapper wrap area list item items links link inner outer row col column group panel text content title heading"
    " icon icons button buttons btn form box1 box2 fixed sticky js is unit slot zone".split()
)
#: Words that decide where a name begins or ends with one, whatever its other words, but for these exceptions.
STRONG_WORDS = frozenset("nav navbar menu breadcrumbs sidebar footer advert adverts advertisement promo sponsored newsletter cookie cookies comment comments disqus".split())
EXCEPTIONS = frozenset("with has no law open closed layout page theme body class main content article".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
MAIN = frozenset("article main".split())
MAIN_WORDS = frozenset("article post entry story content main".split())
#: An open element of the left ends when one of the right begins.
CLOSES = {"p": BLOCKS - {"html", "body", "head"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "head": {"body"}, "option": {"option"}}


class Element:
    __slots__ = ("name", "path", "boiler", "main")

    def __init__(self, name: str, path: int, boiler: bool, main: bool):
        self.name, self.path, self.boiler, self.main = name, path, boiler, main


class Block:
    """A run of text between block boundaries; `path` is its element's token."""

    __slots__ = ("path", "text", "linked", "boiler", "main")

    def __init__(self, element: Element, text: str, linked: int):
        self.path, self.text, self.linked = element.path, text, linked
        self.boiler, self.main = element.boiler, element.main


def is_boilerplate(value: str) -> bool:
    """Whether one of a class attribute's names speaks of boilerplate and of nothing else, or begins or ends with a word that decides."""
    for one in value.split():
        order = [w.lower() for w in PARTS.findall(one) if not w.isdigit()]
        words = set(order)
        if not words.isdisjoint(BOILERPLATE_WORDS) and words <= BOILERPLATE_WORDS | NEUTRAL_WORDS:
            return True
        if words and words.isdisjoint(EXCEPTIONS) and not STRONG_WORDS.isdisjoint((order[0], order[-1])):
            return True
    return False


@functools.lru_cache(maxsize=20_000)
def marks(name: str, attributes: str) -> tuple[str, bool, bool]:
    """(path step, boilerplate, main) of an element by its name and attributes."""
    step, boiler, main = name, name in BOILERPLATE, name in MAIN
    for m in NAMES.finditer(attributes):
        kind, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if kind == "hidden" or kind == "aria-hidden" and value == "true":
            boiler = boiler or kind == "hidden" or name not in ("body", "main", "article")
        elif kind == "role":
            boiler, main = boiler or value.lower() in BOILERPLATE_ROLES, main or value.lower() in ("main", "article")
        elif kind == "itemprop":
            main = main or value == "articleBody"
        else:
            step += f".{value}" if kind == "class" else f"#{value}"
            boiler = boiler or name not in ("body", "html", "main", "article") and is_boilerplate(value)
            main = main or any({w.lower() for w in PARTS.findall(one)} <= MAIN_WORDS | NEUTRAL_WORDS and not {w.lower() for w in PARTS.findall(one)}.isdisjoint(MAIN_WORDS) for one in value.split())
    return step, boiler, main


class Tags:
    """Tags of a page in order, in time proportional to its length."""

    def __init__(self, page: str):
        self.page = page
        self.last = {c: page.rfind(c) for c in ">\"'"}
        self.quotes = True  # until a tag turns out not to end because of them

    def end(self, at: int) -> int:
        """Place after the > that ends a tag; -1 if none does."""
        page, place = self.page, at
        while self.quotes:
            m = STOP.search(page, place)
            if m is None:
                self.quotes = False
            elif m[0] == ">":
                return m.end()
            else:
                place = page.find(m[0], m.end()) + 1 if m.start() < self.last[m[0]] else m.end()
        return page.find(">", at) + 1 or -1

    def next(self, at: int) -> tuple[int, int, str | None, bool, str] | None:
        """(begin, end, name or None for comments and the like, closing, attributes) of the next tag from `at` on."""
        if at > self.last[">"]:
            return None
        m = OPEN.search(self.page, at)
        if m is None or m.start() > self.last[">"]:
            return None
        if self.page.startswith("<!--", m.start()):
            end = self.page.find("-->", m.start() + 4)
            return m.start(), end + 3 if end >= 0 else len(self.page), None, False, ""
        if m[2] is None:
            return m.start(), self.page.find(">", m.end()) + 1, None, False, ""
        end = self.end(m.end())
        return None if end < 0 else (m.start(), end, m[2].lower(), bool(m[1]), self.page[m.end() : end - 1])


@functools.lru_cache(maxsize=200)
def closing(name: str) -> re.Pattern:
    return re.compile(rf"</{name}\b[^>]*>", re.IGNORECASE)


#: The token of the page itself.
PAGE = 0


def blocks(page: str) -> tuple[list[Block], dict[int, tuple[int, int]]]:
    """Text blocks in page order, and for each element token (occurrences, the token first seen before it)."""
    out: list[Block] = []
    paths: dict[int, tuple[int, int]] = {}
    stack, text, linked, in_link, before = [Element("", PAGE, False, False)], [], 0, 0, PAGE
    open_names: Counter = Counter()
    hidden: list[str] = []  # open inline elements that are boilerplate, and those inside them
    hidden_names: Counter = Counter()
    tags, at, end = Tags(page), 0, len(page)

    def flush():
        nonlocal linked
        if text:
            whole = SPACE.sub(" ", html.unescape("".join(text))).strip(" ")
            if whole:
                out.append(Block(stack[-1], whole, linked))
            text.clear()
        linked = 0

    def put(part: str):
        nonlocal linked
        if part and not hidden:
            text.append(part)
            linked += len(part) if in_link else 0

    while at < end:
        tag = tags.next(at)
        if tag is None:
            put(page[at:])
            break
        begin, after, name, close, attributes = tag
        put(page[at:begin])
        at = after
        if name is None:
            continue
        if not close and name in RAW and not attributes.endswith("/"):
            found = closing(name).search(page, at) if page.find("</", at) >= 0 else None
            at = found.end() if found else end if name in ("script", "style") else at
            continue
        if name in ("br", "hr"):
            put(" ")
            if name == "hr":
                flush()
            continue
        if name == "a":
            in_link = 0 if close else 1
        if name not in BLOCKS and name != "button":
            if close:
                while hidden_names[name]:
                    inner = hidden.pop()
                    hidden_names[inner] -= 1
                    if inner == name:
                        break
            elif name not in VOID and not attributes.endswith("/") and (hidden or attributes and marks(name, attributes)[1]):
                hidden.append(name)
                hidden_names[name] += 1
            continue
        flush()
        if hidden:  # no inline element reaches over a block's boundary
            hidden.clear()
            hidden_names.clear()
        if close:
            while open_names[name]:
                inner = stack.pop().name
                open_names[inner] -= 1
                if inner == name:
                    break
            continue
        while len(stack) > 1 and name in CLOSES.get(stack[-1].name, ()):
            open_names[stack.pop().name] -= 1
        step, boiler, main = marks(name, attributes)
        top = stack[-1]
        if name == "header" and not (top.main or main):
            boiler = True
        path = token(top.path, step)
        count, first = paths.get(path, (0, before))
        paths[path] = count + 1, first
        before = path
        if name not in VOID and not attributes.endswith("/"):
            stack.append(Element(name, path, top.boiler or boiler, top.main or main and not (top.boiler or boiler)))
            open_names[name] += 1
    flush()
    return out, paths


def token(path: int, text: str) -> int:
    """The token of a step or of a text below a path: signed 64 bits, never that of the page."""
    return (xxhash.xxh64_intdigest(text, path & (1 << 64) - 1) | 1) - (1 << 63)


def host_of(url: str | None) -> str:
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


VECTORS = "host string, token bigint, v1 bigint, v2 bigint, pages bigint, first_before bigint, last_before bigint, is_text boolean, " + ", ".join(f"mask{k} bigint" for k in range(MASKS))


def _vectors(batches):
    """Per batch and host: tokens with the sums that make their vectors' fingerprints, and bits for the hashes of their pages."""
    for batch in batches:
        sums: dict[tuple[str, int], list] = {}
        for url, raw in zip(batch.column(0).to_pylist(), utf8_list(batch.column(1)), strict=True):
            if not raw:
                continue
            host, own = host_of(url), xxhash.xxh64_intdigest(raw)
            found, paths = blocks(raw.decode("utf-8", "replace"))
            tokens = {p: (n, before, False) for p, (n, before) in paths.items()}
            for b in found:
                t = token(b.path, f"\x00{b.text}")
                tokens[t] = tokens.get(t, (0,))[0] + 1, b.path, True
            tokens[PAGE] = 1, PAGE, False
            bits = [1 << xxhash.xxh64_intdigest(raw, k) % 63 for k in range(MASKS)]
            for t, (n, before, is_text) in tokens.items():
                mixed = xxhash.xxh64_intdigest(own.to_bytes(8, "little"), n)
                row = sums.get((host, t))
                if row is None:
                    sums[host, t] = [mixed & 0x3FFFFFFF, mixed >> 34, 1, before, before, is_text, *bits]
                else:
                    row[0] += mixed & 0x3FFFFFFF
                    row[1] += mixed >> 34
                    row[2] += 1
                    row[3], row[4] = min(row[3], before), max(row[4], before)
                    for k, bit in enumerate(bits, 6):
                        row[k] |= bit
        rows = [(h, t, *v) for (h, t), v in sums.items()]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * (8 + MASKS)
        kinds = [pa.string(), *[pa.int64()] * 6, pa.bool_(), *[pa.int64()] * MASKS]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in VECTORS.split(", ")])
    give_back()


def templates(pages: DataFrame, *, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, template): sorted text tokens of the nested valid classes of a host."""
    bounded_batches(pages.sparkSession)
    sums = pages.select("url", "html").mapInArrow(_vectors, VECTORS)
    per = sums.groupBy("host", "token").agg(
        F.sum("v1").alias("v1"),
        F.sum("v2").alias("v2"),
        F.sum("pages").alias("pages"),
        F.min("first_before").alias("before"),
        (F.min("first_before") == F.max("last_before")).alias("ordered"),
        F.max("is_text").alias("is_text"),
        F.greatest(*(F.bit_count(F.bit_or(f"mask{k}")) for k in range(MASKS))).alias("different"),
    )
    per = cut(per.filter(F.col("different") >= least_pages).withColumn("class", F.xxhash64("v1", "v2", "pages")).drop("v1", "v2"))
    # the class that each token's predecessor belongs to
    others = per.select(F.col("host").alias("at"), F.col("token").alias("before"), F.col("class").alias("above"), F.col("pages").alias("on"))
    placed = per.join(others.withColumnRenamed("before", "other"), (F.col("host") == F.col("at")) & (F.col("before") == F.col("other")), "left").drop("at", "other")
    parents = F.collect_set(F.when(F.col("above") != F.col("class"), F.col("above")))
    classes = placed.groupBy("host", "class").agg(
        F.count("*").alias("size"),
        F.max("pages").alias("pages"),
        F.min("ordered").alias("ordered"),
        F.min(F.col("above").isNotNull() & (F.col("on") >= F.col("pages"))).alias("below"),
        parents.alias("parents"),
        F.max(F.when(F.col("token") == PAGE, True)).alias("root"),
        F.collect_set(F.when(F.col("is_text"), F.col("token"))).alias("tokens"),
    )
    # a single tag may hold others, but no text goes on its account
    tokens = F.when(F.col("size") >= 2, F.col("tokens")).otherwise(F.array().cast("array<bigint>"))
    valid = cut(classes.filter("ordered and (root or below and size(parents) <= 1)").select("host", "class", "root", F.get("parents", 0).alias("parent"), "pages", tokens.alias("tokens")))
    level = taken = valid.filter("root")
    while True:
        above = level.select(F.col("host").alias("at"), F.col("class").alias("above"), F.col("pages").alias("on"))
        below = valid.filter("root is null").join(above, (F.col("host") == F.col("at")) & (F.col("parent") == F.col("above")))
        level = cut(below.filter(F.col("pages") >= NEARLY * F.col("on")).select(*valid.columns))
        if level.isEmpty():
            break
        taken = taken.unionAll(level)
    return taken.groupBy("host").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("tokens")))).alias("template"))


def main_text(page: str, template: frozenset[int] = frozenset()) -> str:
    """The blocks of the article, joined by blank lines."""
    found, _ = blocks(page)
    slots = [b for b in found if not b.boiler]
    main = [b for b in slots if b.main]
    # without a part that is marked as the article: slots with text of their own
    chosen = main or [b for b in slots if 2 * b.linked <= len(b.text)]
    own = [b for b in chosen if token(b.path, f"\x00{b.text}") not in template] if template else chosen
    if own is not chosen:
        left, whole = (sum(len(b.text) for b in x) for x in (own, chosen))
        # copies of one article under several addresses share it all: that is no template
        if left and (not main or 2 * left >= whole):
            chosen = own
    return "\n\n".join(b.text for b in chosen)


def _texts(batch, templates_of):
    texts = []
    for raw, template in zip(utf8_list(batch.column("html")), templates_of, strict=True):
        texts.append(main_text(raw.decode("utf-8", "replace"), template) if raw else "")
    columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])


def _extract(sent, batches):
    none = frozenset()
    for batch in batches:
        yield _texts(batch, [sent.value.get(host_of(u), none) for u in batch.column("url").to_pylist()])
    give_back()


def _extract_joined(batches):
    for batch in batches:
        yield _texts(batch, [frozenset(t or ()) for t in batch.column("template").to_pylist()])
    give_back()


def extract(pages: DataFrame, *, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars) of every row.

    Null and empty pages have the empty text; very long ones take time in proportion to their length; pages without a
    usable url are a host of their own; repeated rows give repeated results, and count as one page of the host; other
    columns, whatever their names, are not read; an empty table has no rows.  Ties: equal blocks of a page are all
    template or all content, and stay in page order.  Of hosts with fewer than `least_pages` different
    pages the slots are judged by place alone.
    """
    spark = pages.sparkSession
    pages = pages.select(pages["page_id"].cast("bigint").alias("page_id"), pages["url"].alias("url"), pages["html"].alias("html"))
    found = cut(templates(pages, least_pages=least_pages).filter(F.size("template") > 0))
    result = "page_id bigint, url string, text string, n_chars bigint"
    if (found.agg(F.sum(F.size("template") + 8)).first()[0] or 0) <= BROADCAST_TOKENS:
        sent = spark.sparkContext.broadcast({r["host"]: frozenset(r["template"]) for r in found.collect()})  # of checked size
        return pages.mapInArrow(functools.partial(_extract, sent), result)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    joined = pages.withColumn("host", host).join(found, "host", "left")  # skewed hosts are split by Spark
    return joined.select("page_id", "url", "html", "template").mapInArrow(_extract_joined, result)
