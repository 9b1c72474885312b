"""Main text of web pages by consensus of their hosts: each page scores its containers, hosts vote on generalised paths, pages are read again by the winners."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimp.llm.common import bound_batches, stored

#: A container is a page's choice if it holds this share of the weight of all text outside boilerplate, articles this share.
SHARE, ARTICLE_SHARE = 0.75, 0.5
#: A path wins with this share of its host's votes (the first one always), so a host has ten winners at most.
WINNING = 0.1
#: A block with the same path and text on this share of a host's pages, and so many at least, is boilerplate, unless it and its like hold most of the page.
REPEATED, REPEATED_PAGES = 0.5, 5
#: What class names mark as boilerplate is read after all if the text outside is less than this share.
LEFT = 0.05
#: A host's rows are dealt over so many keys where the join with its winners is shuffled.
SALTS = 16

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>""", re.S)
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text up to their end tag; without one, only the first two swallow the rest of the page.
_CODE, _RAW = frozenset("script style".split()), frozenset("script style textarea title iframe xmp noembed noframes".split())
#: Elements inside a line that hide what they hold; block elements end the foreign ones.
_FOREIGN, _UNSEEN = frozenset("svg math".split()), frozenset("svg math noscript template".split())
_ENDS_FOREIGN = frozenset("p ul ol dl li table div h1 h2 h3 h4 h5 h6 body blockquote pre article section main footer nav aside header".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big center cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small strike strong sub sup time tt u var".split())
_BOILER = frozenset("head nav footer aside button select option datalist menu dialog header audio video canvas object map".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog menu menubar toolbar".split())
_CONTAINER = frozenset("body div article section main td center blockquote form".split())
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption".split())
_LISTS = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
#: Words of class names and ids that mark what is not the article, and those that say nothing beside them. A name counts only if all of
#: its words are of these two kinds and one is a mark: 'ad-box' and 'related-posts' do, 'social-policy', 'has-sidebar' and 'related-work' don't.
_COMMENTS = frozenset("comment comments disqus".split())
_MARKS = _COMMENTS | frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs consent cookie cookies footer gdpr login masthead menu modal nav navbar navigation newsletter notice overlay pager pagination popup promo promoted related share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget widgets".split())
_NEUTRAL = frozenset("area article articles bar bottom box col column container form group header heading holder icons inner item items left link links list outer page panel post posts reader readers right row section side site slot thread title top unit user users wrap wrapper".split())
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Node:
    """An element. number: its place in page order; key: a hash of its generalised path; hard: not read; soft: class names call it boilerplate; last: number of the last element in it."""

    __slots__ = ("tag", "label", "parent", "number", "key", "hard", "soft", "comments", "in_article", "last", "weight", "blocks", "others")

    def __init__(self, tag: str, attrs: str, parent: Node | None, number: int):
        found: dict[str, str] = {}
        if attrs:
            for name, a, b, c in _ATTR.findall(attrs):
                found.setdefault(name.lower(), a or b or c)
        self.tag, self.parent, self.number, self.last = tag, parent, number, number
        self.weight = self.blocks = self.others = 0  # of the text in it, of its blocks, and of those that aren't prose
        classes = re.sub(r"\d+", "#", found.get("class", "")).lower().split()
        self.label = ".".join([tag, *sorted(set(classes))])
        above = parent if tag != "body" else None
        self.key = xxhash.xxh3_64_intdigest(f"{above.key if above else ''}/{self.label}".encode("utf-8", "replace")) >> 1
        self.in_article = tag in ("article", "main") or bool(parent and parent.in_article)
        self.hard = bool(parent and parent.hard) or (tag in _BOILER and not (tag == "header" and parent is not None and parent.in_article)) or tag in _UNSEEN
        self.hard = self.hard or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or found.get("role", "").lower() in _ROLES or bool(re.search(r"display\s*:\s*none", found.get("style", ""), re.I))
        self.soft, self.comments = tag == "form", False
        if tag not in ("html", "body", "article", "main") and ("class" in found or "id" in found):
            for name in (*found.get("class", "").split(), *found.get("id", "").split()):
                words = {w.lower() for w in _WORDS.findall(name)}
                if words & _MARKS and words <= _MARKS | _NEUTRAL:
                    self.soft = True
                    self.comments = self.comments or bool(words & _COMMENTS)

    def path(self) -> str:
        out, node = [], self
        while node is not None:
            out.append(node.label)
            node = node.parent if node.tag != "body" else None
        return "/".join(reversed(out))


class Block:
    """A block of text, the element that holds it, and its weight: characters less twice those in links."""

    __slots__ = ("text", "node", "weight")

    def __init__(self, text: str, node: Node, weight: int):
        self.text, self.node, self.weight = text, node, weight

    def key(self) -> int:
        return xxhash.xxh3_64_intdigest(f"{self.node.key}/{self.text}".encode("utf-8", "replace")) >> 1


def parse(page: str) -> tuple[list[Node], list[Block]]:
    """All elements that hold text or other elements, in page order, and the blocks of text that are not hidden or boilerplate by tag. Each character and each element is looked at a fixed number of times."""
    root = Node("#page", "", None, 0)
    nodes, out, stack, opened = [root], [], [root], Counter()
    unclosed: set[str] = set()
    parts: list[str] = []
    linked = at = links = drawing = 0  # drawing: the place in the stack of the outermost foreign element
    end = len(page)

    def close_block() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:  # gathered outside hidden elements
                holder = next(n for n in reversed(stack) if n.tag != "span" and not n.hard)
                out.append(Block(text, holder, max(0, len(text) - 2 * linked)))
            parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if stack[-1].hard:
            return
        text = html.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if links:
            linked += len(text.strip())

    def pop_to(k: int) -> None:
        nonlocal drawing
        drawing = 0 if k <= drawing else drawing
        for n in stack[k:]:
            n.last = len(nodes) - 1
            opened[n.tag] -= 1
        del stack[k:]

    def push(tag: str, attrs: str) -> None:
        nonlocal drawing
        if tag in _FOREIGN and not drawing:
            drawing = len(stack)
        node = Node(tag, attrs, stack[-1], len(nodes))
        nodes.append(node)
        stack.append(node)
        opened[tag] += 1

    while at < end:
        m = _TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        closing, tag, attrs = (m[1], m[2], m[3]) if m[2] is not None else (m[4], m[5], m[6])
        if tag is None:
            continue
        tag = tag.lower()
        if closing:
            if tag == "a":
                links = max(0, links - 1)
            elif tag == "br":
                add(" ")
            elif tag not in _INLINE:
                if drawing and opened[tag]:
                    k = next((k for k in range(len(stack) - 1, drawing - 1, -1) if stack[k].tag == tag), None)
                    pop_to(drawing if k is None else k)
                    if k is not None:  # the end of the drawing or of a part of it
                        continue
                if tag not in ("span", *_UNSEEN):
                    close_block()
                if opened[tag]:
                    k = next(k for k in range(len(stack) - 1, -1, -1) if stack[k].tag == tag)
                    if tag not in ("span", *_UNSEEN) or all(n.tag == "span" or n.hard for n in stack[k:]):
                        pop_to(k)
            continue
        if tag in _RAW:
            close = None if tag in unclosed else re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            if close is None:
                unclosed.add(tag)
            at = close.end() if close else end if tag in _CODE else at
            continue
        if tag == "a":
            links += 1
            continue
        if tag in _INLINE:
            continue
        if tag in _VOID:
            if tag == "hr":
                close_block()
            elif tag == "br":
                add(" ")
            continue
        if tag == "span" or tag in _UNSEEN:
            if not (tag in _FOREIGN and attrs.endswith("/")):
                push(tag, attrs)
            continue
        if drawing:
            if tag not in _ENDS_FOREIGN:  # an element of the drawing
                if not attrs.endswith("/"):
                    push(tag, attrs)
                continue
            pop_to(drawing)
        close_block()
        links = 0 if tag in _CONTAINER else links
        if opened["p"]:
            p = next((k for k in range(len(stack) - 1, -1, -1) if stack[k].tag == "p" or stack[k].tag in _CONTAINER), None)
            if p is not None and stack[p].tag == "p":
                pop_to(p)
        if tag in _LISTS and opened[tag]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag == tag:
                    pop_to(k)
                    break
                if stack[k].tag in _LISTS[tag]:
                    break
        push(tag, attrs)
    close_block()
    pop_to(0)
    return nodes, out


def readable(page: str) -> tuple[list[Node], list[Block]]:
    """The elements, weighed by the text in them, and the blocks that no class name calls boilerplate; all blocks where next to nothing is left then, reader comments excepted."""
    nodes, found = parse(page)
    marked, comments = [False] * len(nodes), [False] * len(nodes)
    for n in nodes[1:]:  # parents come first
        marked[n.number] = n.soft or marked[n.parent.number]
        comments[n.number] = n.comments or comments[n.parent.number]
    kept = [b for b in found if not marked[b.node.number]]
    rest = [b for b in found if not comments[b.node.number]]
    if sum(b.weight for b in kept) < LEFT * sum(b.weight for b in rest):
        kept = rest
    for b in kept:
        b.node.weight += b.weight
        b.node.blocks += 1
        b.node.others += not (b.weight and b.node.tag in _PROSE)
    for n in reversed(nodes[1:]):
        n.parent.weight += n.weight
        n.parent.blocks += n.blocks
        n.parent.others += n.others
    return nodes, kept


def best_container(nodes: list[Node]) -> Node | None:
    """The page's own choice: the outermost article or main element that holds enough, else the deepest container that holds most of the weight, and of those around it as many as add nothing but prose."""
    total = nodes[0].weight
    if not total:
        return None
    for tag in ("article", "main"):
        fit = [n for n in nodes if n.tag == tag and n.weight >= ARTICLE_SHARE * total]
        if fit:
            return fit[0]
    best = nodes[0]
    for n in nodes:  # the deepest of those that hold so much lie inside one another
        if n.tag in _CONTAINER and n.weight >= SHARE * total:
            best = n
    if best is nodes[0]:
        return None
    core, around = best, best.parent
    while around is not None and around.number and around.tag not in ("body", "html") and around.others == core.others:
        if around.blocks > best.blocks and around.tag in _CONTAINER:
            best = around
        around = around.parent
    return best


def main_text(page: str, paths: list[int], repeated: frozenset[int]) -> str:
    """The blocks inside the first of the host's paths that holds as much as half of what the page's own choice does, one a line; else inside the page's own choice, or all."""
    nodes, found = readable(page)
    if repeated:
        others = [b for b in found if b.key() not in repeated]
        if 2 * sum(b.weight for b in others) >= sum(b.weight for b in found):
            found = others
    own = best_container(nodes)
    kept = [b for b in found if own is None or own.number <= b.node.number <= own.last]
    least = sum(b.weight for b in kept) / 2
    for path in paths:
        held = [False] * len(nodes)
        for n in nodes:  # parents come first
            held[n.number] = n.key == path or (n.parent is not None and held[n.parent.number])
        got = [b for b in found if held[b.node.number]]
        if got and sum(b.weight for b in got) >= least:
            kept = got
            break
    return "\n".join(b.text for b in kept)


_PAGE, _PATH, _BLOCK = 0, 1, 2


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def consensus(rows: DataFrame) -> DataFrame:
    """host, paths (the winners, most votes first) and repeated (keys of blocks that stand on most pages) from rows of host and html.

    Votes and blocks are counted by host and key and combined before the shuffle, so a host with a third of all pages is no hot
    group; what reaches a share of the host's pages is bounded by that share.
    """

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                nodes, found = readable(page)
                got.append((host, _PAGE, 0, 0))
                if (best := best_container(nodes)) is not None:
                    got.append((host, _PATH, best.key, best.weight))
                got += [(host, _BLOCK, key, 0) for key in {x.key() for x in found}]
            yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int64(), pa.int64()))], ["host", "kind", "key", "weight"])

    counts = rows.select("host", "html").mapInArrow(vote, "host string, kind int, key long, weight long").groupBy("host", "kind", "key").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))
    counts = stored(counts.where((F.col("kind") != _BLOCK) | (F.col("n") >= REPEATED_PAGES)), "host-votes")
    pages = counts.where(F.col("kind") == _PAGE).select("host", F.col("n").alias("pages"))
    each = counts.where(F.col("kind") != _PAGE).join(pages, "host")
    wins = (F.col("kind") == _PATH) & (F.col("n") >= WINNING * F.col("pages"))
    again = (F.col("kind") == _BLOCK) & (F.col("n") >= REPEATED * F.col("pages"))
    first = F.max(F.when(F.col("kind") == _PATH, F.struct("n", "weight", "key")))
    by_votes = F.reverse(F.array_sort(F.collect_list(F.when(wins, F.struct("n", "weight", "key")))))
    out = each.groupBy("host").agg(first.alias("first"), by_votes.alias("won"), F.collect_list(F.when(again, F.col("key"))).alias("repeated"))
    return out.select("host", F.when(F.size("won") > 0, F.transform("won", lambda w: w["key"])).when(F.col("first").isNotNull(), F.array("first.key")).otherwise(F.array().cast("array<long>")).alias("paths"), "repeated")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: id, url, text (empty if none), n_chars.

    The hosts' winners are a written table: Spark broadcasts it under the session's limit; beyond, host and a salt are the key
    of a shuffled join. Null or empty html: empty text; a null url votes with the pages that have no host and stays null; null
    ids stay null, repeated rows stay repeated (and vote each), ties of votes go to the weight and then the larger key, an
    empty table gives an empty table; other columns are not read. Deep nesting and long pages take time in proportion.
    """
    bound_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("k"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("host", host_of(F.col("url")))
    winners = stored(consensus(rows), "host-paths")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [main_text(page, paths or [], frozenset(repeated or ())) for page, paths, repeated in zip(*(b.column(k).to_pylist() for k in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string())], ["k", "url", "text"])

    salted = winners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = rows.withColumn("salt", F.pmod(F.hash("k", "url"), F.lit(SALTS))).join(salted, ["host", "salt"], "left").select("k", "url", "html", "paths", "repeated")
    return joined.mapInArrow(read, "k long, url string, text string").select(F.col("k").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
