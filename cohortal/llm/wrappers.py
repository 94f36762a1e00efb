"""Main text of web pages by wrapper induction.

Every page of a host is aligned with the closer one of two reference pages by
simple tree matching, which gives its text blocks the slots of the reference.
Blocks without a counterpart there, and pages of another layout, have the path
of the block as their slot, so every block of every page counts. Over all pages of a host, slots whose texts keep repeating are
template; slots whose texts vary are content. What elements say of themselves
(``nav``, ``footer``, ``article``, class names) is the prior: it decides where a
slot has too few pages, and evidence against it has to be stronger.
"""

from __future__ import annotations

import hashlib
import html as html_module
import json
import re
from collections.abc import Generator, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from cohortal.llm.url_templates import host_and_path
from cohortal.llm.words import small_batches

MIN_PAGES = 5  # different pages a slot needs before its texts count as evidence
REPEATED = 0.5  # share of pages with a text seen on others, from which a neutral slot is template
CONSTANT = 0.8  # inside an article: share of pages with one text, from which that text is template, or with repeated texts, from which the slot is
ALIGNED = 0.5  # share of nodes a page has in common with a reference of its layout
SURE_PAGES = 30  # different pages a slot of a dropped element needs to be taken for content
VARYING = 0.05  # share of pages with a text seen on others, up to which such a slot is content

DROPPED, NEUTRAL, ARTICLE = 0, 1, 2

#: Elements by role: fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr img".split())
UNSEEN_TAGS = frozenset("head title button select option textarea object audio video canvas map".split())  # no text of the page, whatever varies there
DROP_TAGS = frozenset("head title nav footer aside form menu dialog button select option textarea fieldset object audio video canvas map".split())
ARTICLE_TAGS = frozenset(("article", "main"))
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_NAMES = (
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert "
    "sidebar side-bar menu nav navbar navigation breadcrumb breadcrumbs toc header masthead topbar footer foot comment comments disqus reply replies respond "
    "share sharing social related recommended newsletter subscribe signup login search pagination pager popup modal overlay skip widget copyright legal"
).split()
_DROP_NAME = re.compile(r"(?:^|[\s_-])(?:" + "|".join(_NAMES) + r")(?:$|[\s_-])", re.I)
_KEEP_NAME = re.compile(r"(?:^|[\s_-])(?:article|articlebody|post|entry|story|content|main|body)(?:$|[\s_-])", re.I)
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|math|iframe)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)


@dataclass
class Node:
    """A block element, or a text block (tag ``#``)."""

    tag: str
    name: str = ""
    zone: int = NEUTRAL
    children: list[Node] = field(default_factory=list)
    text: str = ""
    slot: int = 0
    path: bytes = b""  # with the places among elements of the same tag and name
    tags: bytes = b""
    size: int = 1
    unseen: bool = False


def _zone(tag: str, attributes: str, parent: Node, in_article: bool) -> tuple[int, str]:
    if parent.zone == DROPPED:
        return DROPPED, ""
    named = " ".join(x for m in _ATTRIBUTE.finditer(attributes) for x in m.groups()[1:] if x) if attributes.strip() else ""
    if tag in DROP_TAGS or tag == "header" and not in_article:
        return DROPPED, named
    if tag not in ARTICLE_TAGS and tag != "body" and tag != "html":
        if named and _DROP_NAME.search(named) and not _KEEP_NAME.search(named) or attributes and _HIDDEN.search(attributes):
            return DROPPED, named
    if tag in ARTICLE_TAGS:
        return ARTICLE, named
    return parent.zone, named


def parse(page: str) -> Node:
    """A tolerant block tree: inline elements are transparent, unclosed and stray tags do no harm."""
    root = Node("#root")
    stack = [root]
    words: list[str] = []

    def flush() -> None:
        text = " ".join(html_module.unescape("".join(words)).split())
        words.clear()
        if text:
            stack[-1].children.append(Node("#", zone=stack[-1].zone, text=text, unseen=stack[-1].unseen))

    at = 0
    for m in _MARKUP.finditer(page):
        if m.start() > at:
            words.append(page[at : m.start()])
        at = m.end()
        raw_tag = m[3] or m[6]
        if raw_tag is None:
            continue
        tag, closing, attributes = raw_tag.lower(), bool(m[2] or m[5]), m[4] or m[7] or ""
        if tag in ("br", "hr", "wbr"):
            words.append(" " if tag != "wbr" else "")
            continue
        if tag in INLINE and not (attributes and not closing and _HIDDEN.search(attributes)):
            continue
        if tag in VOID:
            continue
        flush()
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if tag in CLOSES_P and stack[-1].tag == "p":
            stack.pop()
        if stack[-1].tag in SELF_CLOSING.get(tag, ()):
            stack.pop()
        zone, named = _zone(tag, attributes, stack[-1], any(n.tag in ARTICLE_TAGS for n in stack))
        unseen = stack[-1].unseen or tag in UNSEEN_TAGS or bool(attributes and _HIDDEN.search(attributes))
        node = Node(tag, named, zone, unseen=unseen)
        stack[-1].children.append(node)
        if attributes.endswith("/") and tag not in CLOSES_P:
            continue
        stack.append(node)
    if at < len(page):
        words.append(page[at:])
    flush()
    return root


def leaves(node: Node) -> Iterator[Node]:
    """The text blocks in page order."""
    work = [node]
    while work:
        top = work.pop()
        if top.tag == "#":
            yield top
        work.extend(reversed(top.children))


def _count(node: Node) -> int:
    order, work = [], [node]
    while work:
        top = work.pop()
        order.append(top)
        work.extend(top.children)
    for top in reversed(order):
        top.size = 1 + sum(c.size for c in top.children)
    return node.size


def _digest(*parts: bytes) -> bytes:
    return hashlib.blake2b(b"\0".join(parts), digest_size=8).digest()


_NUMBERED = re.compile(r"\S*\d\S*")


def _name_paths(root: Node) -> None:
    """Set the paths of all nodes; names with digits differ from page to page and are left out."""
    work = [root]
    while work:
        top = work.pop()
        places: dict[bytes, int] = {}
        for child in top.children:
            tag = child.tag.encode()
            own = b" ".join((tag, " ".join(_NUMBERED.sub("", child.name).split()).encode("utf-8", "replace")))
            places[own] = places.get(own, -1) + 1
            child.path = _digest(top.path, own, b"%d" % places[own])
            child.tags = _digest(top.tags, tag)
            work.append(child)


def simple_tree_match(one: Node, two: Node) -> tuple[int, list[tuple[Node, Node]]]:
    """Largest number of matched nodes of two trees whose roots match, order kept, and the matched text blocks.

    Equal text-only children at both ends are matched at once, which is as good
    as any other match of them; the rest goes through the usual table. Open
    matches wait on a stack of their own, so trees may have any depth.
    """
    open_matches, result = [_match(one, two)], None
    while open_matches:
        try:
            inner = open_matches[-1].send(result)
        except StopIteration as done:
            open_matches.pop()
            result = done.value
        else:
            open_matches.append(_match(*inner))
            result = None
    return result


def _match(one: Node, two: Node) -> Generator[tuple[Node, Node], tuple[int, list], tuple[int, list]]:
    """The match of two nodes; asks for the matches of their children."""
    if one.tag != two.tag:
        return 0, []
    if one.tag == "#":
        return 1, [(one, two)]
    a, b = one.children, two.children
    plain = lambda x, y: x.tag == y.tag and x.name == y.name and all(c.tag == "#" for c in x.children) and all(c.tag == "#" for c in y.children)
    total, pairs = 1, []

    def both(x: Node, y: Node) -> None:
        nonlocal total
        n = min(len(x.children), len(y.children)) if x.tag != "#" else 0
        total += 1 + n
        pairs.extend(zip(x.children, y.children) if x.tag != "#" else [(x, y)])

    head = 0
    while head < min(len(a), len(b)) and plain(a[head], b[head]):
        both(a[head], b[head])
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and plain(a[-1 - tail], b[-1 - tail]):
        both(a[-1 - tail], b[-1 - tail])
        tail += 1
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if not a or not b:
        return total, pairs
    width = len(b) + 1
    best = [0] * ((len(a) + 1) * width)
    found: dict[tuple[int, int], tuple[int, list]] = {}
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            here = max(best[(i - 1) * width + j], best[i * width + j - 1])
            if x.tag == y.tag:
                inner = (1, [(x, y)]) if x.tag == "#" else (yield x, y)
                found[i, j] = inner
                here = max(here, best[(i - 1) * width + j - 1] + inner[0])
            best[i * width + j] = here
    i, j = len(a), len(b)
    total += best[-1]
    while i and j:
        here = best[i * width + j]
        if here == best[(i - 1) * width + j]:
            i -= 1
        elif here == best[i * width + j - 1]:
            j -= 1
        else:
            pairs.extend(found[i, j][1])
            i, j = i - 1, j - 1
    return total, pairs


def text_hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def align(page: str, references: list[Node]) -> list[Node]:
    """The page's text blocks with their slots: those of the closest reference, or negative ones from their paths.

    A block takes a reference's slot where the tags above both are the same.
    """
    tree = parse(page)
    _name_paths(tree)
    size = _count(tree)
    best = (0.0, [])
    for reference in references:
        n, pairs = simple_tree_match(tree, reference)
        score = n / max(1, size, reference.size)
        if score >= ALIGNED and score > best[0]:
            best = (score, pairs)
    found = list(leaves(tree))
    for leaf in found:
        leaf.slot = int.from_bytes(leaf.path, "little") | -(1 << 63)
    for mine, theirs in best[1]:
        if mine.tags == theirs.tags:
            mine.slot = theirs.slot
    return found


def skeleton(page: str) -> str:
    """All that an alignment needs of a reference page: its elements and their names, and where text is, but not the text.

    A line per node in page order: its depth, tag and quoted name.
    """
    lines, work = [], [(c, 0) for c in reversed(parse(page).children)]
    while work:
        node, depth = work.pop()
        lines.append(f"{depth} {node.tag} {json.dumps(node.name)}")
        work.extend((c, depth + 1) for c in reversed(node.children))
    return "\n".join(lines)


def reference_tree(bones: str, number: int) -> Node:
    """The tree of a skeleton with the slots of its text blocks."""
    tree = Node("#root")
    path = [tree]
    for line in bones.split("\n") if bones else ():
        depth, tag, name = line.split(" ", 2)
        del path[int(depth) + 1 :]
        node = Node(tag, json.loads(name))
        path[-1].children.append(node)
        path.append(node)
    _name_paths(tree)
    for slot, leaf in enumerate(leaves(tree)):
        leaf.slot = (number << 32) + slot
    _count(tree)
    return tree


MARKS = ArrayType(StructType([StructField("zone", IntegerType()), StructField("slot", LongType()), StructField("h", LongType())]))
SMALL_BYTES = 96 << 20  # estimated size up to which a table about hosts is sent to every task, so that no page is shuffled


def _by_host(pages: DataFrame, hosts: DataFrame, bytes_each: float) -> DataFrame:
    """``pages`` with the settled columns about their host (``_host``); pages stay where they are while that table is small."""
    few = hosts.count() * bytes_each <= SMALL_BYTES
    return pages.join(F.broadcast(hosts) if few else hosts, pages["host"] == hosts["_host"], "left")


def _skeletons(references: DataFrame) -> DataFrame:
    """(host, one, two) with skeletons in place of pages; ``two`` is null where both are one page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            bones = [[skeleton(x) if x else None for x in column] for column in (one, [None if x == y else y for x, y in zip(one, two)])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.string()) for x in bones]], names=["host", "one", "two"])

    return references.select("host", "one", "two").mapInArrow(run, "host string, one string, two string")


def _mean_bytes(hosts: DataFrame, size: Column) -> float:
    return float(hosts.agg(F.avg(size)).first()[0] or 0) + 100


def _aligned(pages: DataFrame, references: DataFrame, columns: list[str]) -> DataFrame:
    """``columns``, host, the hash of the longest block, texts and marks of the blocks of every page; the html goes."""
    named = references.select(F.col("host").alias("_host"), "one", "two")
    wide = _mean_bytes(references, F.length("one") + F.coalesce(F.length("two"), F.lit(0)))
    joined = _by_host(pages, named, wide).select(*columns, "host", "_html", "one", "two")
    kind = pa.list_(pa.struct([("zone", pa.int32()), ("slot", pa.int64()), ("h", pa.int64())]))
    n = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[str, list[Node]] = {}
        for batch in batches:
            longest, texts, marks = [], [], []
            for host, page, one, two in zip(*[batch.column(n + k).to_pylist() for k in range(4)]):
                if host not in trees:
                    if len(trees) > 256:
                        trees.clear()
                    trees[host] = [reference_tree(x, k) for k, x in enumerate((one, two)) if x is not None]
                found = [x for x in align(page, trees[host]) if not x.unseen]
                hashes = [text_hash(x.text) for x in found]
                longest.append(max(((len(x.text), h) for x, h in zip(found, hashes)), default=(0, None))[1])
                texts.append([x.text for x in found])
                marks.append([{"zone": x.zone, "slot": x.slot, "h": h} for x, h in zip(found, hashes)])
            arrays = [*batch.columns[: n + 1], pa.array(longest, pa.int64()), pa.array(texts, pa.list_(pa.string())), pa.array(marks, kind)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[: n + 1], "page", "texts", "marks"])

    schema = joined.select(*columns, "host").schema.add("page", LongType()).add("texts", ArrayType(StringType())).add("marks", MARKS)
    return joined.mapInArrow(run, schema)


def _slot_statistics(aligned: DataFrame) -> DataFrame:
    """Per host, the texts and slots that are template and the slots that are content, where the pages tell.

    Pages with the same longest block are counted once, so copies of an article
    do not look like a template.
    """
    each = aligned.select("host", "page", F.explode("marks").alias("x"))
    once = each.groupBy("host", F.col("x.slot").alias("slot"), F.col("x.zone").alias("zone"), F.col("x.h").alias("h"), "page").agg(F.lit(1).alias("one"))
    texts = once.groupBy("host", "slot", "zone", "h").agg(F.count("*").alias("n"))
    top = F.max(F.struct("n", "h"))
    slots = texts.groupBy("host", "slot", "zone").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("again"), top.alias("top"))
    slots = slots.where(F.col("n") >= MIN_PAGES)
    zone, n, again = F.col("zone"), F.col("n"), F.col("again")
    same = F.col("top.n") >= CONSTANT * n
    constant = F.when((zone == ARTICLE) & same, F.struct("slot", F.col("top.h").alias("h")))
    repeated = F.when((zone == NEUTRAL) & (again >= REPEATED * n) | (zone == ARTICLE) & ~same & (again >= CONSTANT * n), F.col("slot"))
    varying = F.when((zone == NEUTRAL) & (again < REPEATED * n) | (zone == DROPPED) & (n >= SURE_PAGES) & (again <= VARYING * n), F.struct("slot", "zone"))
    return slots.groupBy("host").agg(F.collect_list(constant).alias("constant"), F.collect_list(repeated).alias("repeated"), F.collect_list(varying).alias("varying"))


def extract_text(pages: DataFrame, settle, *, html: str = "html", url: str = "url", page: str = "page_id") -> DataFrame:
    """One row per page: page id, url, text, n_chars.

    Text blocks in page order, joined by one space. A null or empty html gives
    an empty text; null and unreadable urls share the host ``""``. Repeated rows
    and null ids are kept row by row. A block whose slot shows what it is, is kept
    or left out by that. The others go by their elements: if a page has an
    ``article`` or ``main`` with text, only that counts, else what is not dropped.
    """
    rows = pages.select(F.col(page).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("_html"))
    host, _ = host_and_path(F.col("url"))
    rows = rows.withColumn("host", host)
    place = F.xxhash64("_html", "url")
    ends = rows.where("_html <> ''").select("host", place.alias("h")).groupBy("host").agg(F.min("h").alias("lo"), F.max("h").alias("hi"))
    ends = settle(ends, "wrapper-ends")
    picked = rows.withColumn("h", place).join(ends.withColumnRenamed("host", "_host"), (F.col("host") == F.col("_host")) & ((F.col("h") == F.col("lo")) | (F.col("h") == F.col("hi"))))
    references = picked.groupBy("host").agg(F.min(F.when(F.col("h") == F.col("lo"), F.col("_html"))).alias("one"), F.min(F.when(F.col("h") == F.col("hi"), F.col("_html"))).alias("two"))
    small_batches(pages.sparkSession)
    references = settle(_skeletons(references), "wrapper-references")
    aligned = settle(_aligned(rows, references, ["page_id", "url"]), "wrapper-blocks")
    template = settle(_slot_statistics(aligned), "wrapper-slots").withColumnRenamed("host", "_host")
    wide = _mean_bytes(template, 16 * (F.size("constant") + F.size("repeated") + F.size("varying")))
    both = _by_host(aligned, template, wide)
    said = lambda name, value: F.coalesce(F.array_contains(name, value), F.lit(False))
    bare = F.size(F.filter("marks", lambda x: x["zone"] == ARTICLE)) == 0

    def counts(x: Column) -> Column:
        slot, zone = x["slot"].alias("slot"), x["zone"].alias("zone")
        template = said("repeated", slot) & (x["zone"] != DROPPED) | (x["zone"] == ARTICLE) & said("constant", F.struct(slot, x["h"].alias("h")))
        prior = (x["zone"] == ARTICLE) | (x["zone"] == NEUTRAL) & bare
        return ~template & (prior | said("varying", F.struct(slot, zone)))

    text = F.array_join(F.filter("texts", lambda _, i: counts(F.get(F.col("marks"), i))), " ")
    return both.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
