"""Main text of web pages by wrapper induction: pages of a host are aligned, constant nodes are template, varying slots content.

A page becomes a tree of its block elements (inline markup is read through), with one leaf for each run of text. Siblings of the
same shape in a row become one node whose leaves hold a list of texts. Trees of one host are merged into its wrapper by simple tree
matching: nodes match if their labels (tag and class) agree, and the ordered matching of children with the most matched nodes is taken.
A wrapper's leaf remembers whether its texts were always the same, and which of them were the same at its begin and end.
What stayed the same over at least EVIDENCE different titles and EVIDENCE different longest texts is template, so copies of one
page make nothing a template.

Each task merges the pages it reads into one wrapper a host and hands on these; they are merged in two rounds, row by row,
so no task holds the pages of a host. A wrapper keeps at most WRAPPER_NODES nodes (the rarest go; a text without a node is
content). Wrappers go to the pages by broadcast while all are under BROADCAST_BYTES; beyond that only those of hosts with more than
one in HOT_SHARE pages do (so fewer than HOT_SHARE), and the other pages go to their host's wrapper by a shuffle.

Of what is not template, `extract` keeps what lies in the article (or main element, where there is one), without menus, headers,
footers, sidebars, notices, adverts, forms and comments, told by tag, role and words of class and id; in pages without such an element,
blocks that are mostly links go as well. Nothing else is dropped or cut.

Defined results: null or empty html gives an empty text; a page whose url is null or has no host has no wrapper; repeated rows
are rows of their own; elements nested deeper than MAX_DEPTH are read as part of the one above; an unclosed comment, tag or script
reaches to the end. Extra columns are never looked at. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import html as markup
import json
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import cut, discard, map_texts, text_runs
from millrace.session import ship

#: Different titles, and different longest texts, over which a text must stay the same to be template.
EVIDENCE = 3
#: Texts at the begin and at the end of a slot that are compared one by one; the whole slot is compared by a hash besides.
EDGE = 16
MAX_DEPTH = 100
WRAPPER_NODES = 2_000
#: Pairs of children up to which their best matching is sought; longer lists of children are matched greedily, in order.
ALIGN_PAIRS = 40_000
#: Nodes of all wrappers that a task holds before it hands them on.
HELD_NODES = 100_000
MERGE_SALTS = 32
BROADCAST_BYTES = 16_000_000
HOT_SHARE = 200

# Element names of the HTML standard.
_VOID = frozenset("area base col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var picture".split())
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: An element that begins ends an open one of these, unless one of the others lies between.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "tr", "td", "th"}, {"table"})}
# What is never main text, by tag, by role, and by words of class and id.
_DROP_TAGS = frozenset("head nav aside footer form button select option datalist label textarea template noscript iframe object svg canvas audio video dialog menu fieldset".split())
_DROP_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
_DROP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner sidebar sidebars nav navbar navigation menu menus breadcrumb breadcrumbs footer masthead comment comments commentlist respond disqus reply replies "
    "cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup share sharing social related recommended recommendations widget widgets toolbar pager pagination login copyright skip".split()
)
_COMMENT_WORDS = frozenset("comment comments reply replies ad ads advert advertisement promo sponsored related".split())
_NEGATED = frozenset("no has with without".split())

_MARK = re.compile(r"""<!--.*?(?:--!?>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?>(?:"[^"]*"|'[^']*'|[^>"'])*)>|[^>]*(?:>|\Z))|<[!?/][^>]*(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")
_TELLING = re.compile(r"class|id|role|style|hidden|itemprop", re.I)
_RAW_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I) for tag in _RAW}
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    """A block element of a page, or (label '#') a run of text; `drop` if its markup says that it is no main text, `main` if it says the opposite."""

    __slots__ = ("label", "kids", "leaf", "drop", "main", "size", "holds_main")

    def __init__(self, label: str, leaf: int | None = None, drop: bool = False, main: bool = False) -> None:
        self.label, self.kids, self.leaf, self.drop, self.main, self.size, self.holds_main = label, [], leaf, drop, main, 0, main


class Page:
    """The tree, title and texts of a page: text, its link characters, whether it may be main text, of each leaf in page order."""

    def __init__(self, html: str) -> None:
        self.texts: list[str] = []
        self.links: list[int] = []
        self.title = ""
        self.root = Node("root")
        self._read(html)
        self._weigh(self.root)
        self.kept = [False] * len(self.texts)
        self.has_main = self.root.holds_main
        self._keep(self.root, not self.has_main, False)

    def _read(self, html: str) -> None:
        stack, tags, run, linked, link_depth, at = [self.root], ["root"], [], 0, False, 0

        def text_ends() -> None:
            nonlocal linked
            if not run:
                return
            text = " ".join(markup.unescape("".join(run)).split())
            if text:
                stack[-1].kids.append(Node("#", len(self.texts)))
                self.texts.append(text)
                self.links.append(min(linked, len(text)))
            run.clear()
            linked = 0

        def close(place: int) -> None:
            nonlocal link_depth
            text_ends()
            del stack[place:], tags[place:]
            link_depth = False

        def open_at(names: frozenset | set, walls: frozenset | set) -> int:
            for place in range(len(tags) - 1, 0, -1):
                if tags[place] in names:
                    return place
                if tags[place] in walls:
                    return 0
            return 0

        while mark := _MARK.search(html, at):
            start, end = mark.span()
            if start > at:
                run.append(html[at:start])
                linked += start - at if link_depth else 0
            at = end
            ends, tag, rest = mark.groups()
            if tag is None:
                continue
            tag = tag.lower()
            if tag == "br":
                run.append(" ")
            elif ends:
                if tag == "a":
                    link_depth = False
                if place := open_at({tag}, ()):
                    close(place)
            elif tag in _RAW:
                stop = _RAW_ENDS[tag].search(html, at)
                inside = html[at : stop.start()] if stop else html[at:]
                if tag == "title" and not self.title:
                    self.title = " ".join(markup.unescape(inside).split())
                at = stop.start() if stop else len(html)
            elif tag in _VOID:
                if tag == "hr":
                    text_ends()
                continue
            else:
                drop, main, words = _told_by(tag, rest)
                if tag in _INLINE and not drop:
                    link_depth = link_depth or tag == "a"
                    continue
                if tag in _ENDS and (place := open_at(*_ENDS[tag])):
                    while (more := open_at(*_ENDS[tag])) and more < place:
                        place = more
                    close(place)
                if tag in _ENDS_P and (place := open_at({"p"}, {"table", "button", "td", "th"})):
                    close(place)
                text_ends()
                if rest.endswith("/>") and tag in ("svg", "object"):
                    continue
                if len(stack) < MAX_DEPTH:
                    node = Node(f"{tag}.{words}" if words else tag, drop=drop, main=main)
                    stack[-1].kids.append(node)
                    stack.append(node)
                    tags.append(tag)
        run.append(html[at:])
        linked += len(html) - at if link_depth else 0
        text_ends()

    def _weigh(self, node: Node) -> None:
        for kid in node.kids:
            self._weigh(kid)
            node.size += kid.size
            node.holds_main |= kid.holds_main and not kid.drop
        if node.leaf is not None:
            node.size = len(self.texts[node.leaf])

    def _keep(self, node: Node, inside: bool, in_main: bool) -> None:
        """What markup says of a dropped element does not hold if the main element, or nearly all text of a page without one, lies in it."""
        for kid in node.kids:
            if kid.leaf is not None:
                self.kept[kid.leaf] = inside
                continue
            header = kid.label.partition(".")[0] == "header" and not in_main and not kid.holds_main
            drops = (kid.drop or header) and not kid.holds_main and not (not self.has_main and kid.label.startswith(("form", "div")) and kid.size > 0.8 * self.root.size)
            if kid.drop and kid.main:
                drops = True
            if not drops:
                self._keep(kid, inside or kid.main, in_main or kid.main)


def _told_by(tag: str, rest: str) -> tuple[bool, bool, str]:
    """(no main text, main text, class without digits) by an element's tag and attributes."""
    main, drop = tag in ("article", "main"), tag in _DROP_TAGS
    if len(rest) < 4 or not _TELLING.search(rest):
        return drop, main, ""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(rest)}
    role = found.get("role", "").lower()
    main |= role in ("main", "article") or "articlebody" in found.get("itemprop", "").lower()
    drop |= role in _DROP_ROLES or "hidden" in found or found.get("aria-hidden") == "true" or bool(_HIDDEN.search(found.get("style", "")))
    classes = found.get("class", "")
    words = [w.lower() for w in _WORD.findall(f"{classes} {found.get('id', '')}")]
    if tag not in ("body", "html"):
        telling = _COMMENT_WORDS if main else _DROP_WORDS
        drop |= any(w in telling and not (k and words[k - 1] in _NEGATED) for k, w in enumerate(words))
    return drop, main, re.sub(r"\d+", "0", classes)


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=7).digest(), "big")


def slots(page: Page) -> list:
    """The page's tree with siblings of one shape in a row as one node: [label, kids, leaves or None]."""

    def made(node: Node) -> tuple[list, int]:
        if node.leaf is not None:
            return ["#", [], [node.leaf]], 1
        kids, shapes = [], []
        for kid in node.kids:
            one, shape = made(kid)
            if shapes and shapes[-1] == shape:
                _append(kids[-1], one)
            else:
                kids.append(one)
                shapes.append(shape)
        return [node.label, kids, None], hash((node.label, *shapes))

    return made(page.root)[0]


def _append(into: list, other: list) -> None:
    if into[2] is not None:
        into[2] += other[2]
    for a, b in zip(into[1], other[1], strict=True):
        _append(a, b)


def wrapper_of(page: Page) -> list:
    """The wrapper of one page: [label, kids, pages, None or [hash of all texts, first hashes, last hashes (from the end), titles, longest texts]]."""
    hashes, title = [_digest(t) for t in page.texts], _digest(page.title)
    longest = max(zip(map(len, page.texts), hashes, strict=True), default=(0, 0))[1]

    def made(slot: list) -> list:
        if slot[2] is None:
            return [slot[0], [made(k) for k in slot[1]], 1, None]
        of = [hashes[i] for i in slot[2]]
        return ["#", [], 1, [_digest(str(of)), of[:EDGE], of[: -EDGE - 1 : -1], [title], [longest]]]

    return made(slots(page))


def matched(a: list, b: list, seen: dict) -> int:
    """Nodes that the best ordered matching of two trees with equal labels at the top matches."""
    if a[0] != b[0]:
        return 0
    if not a[1] or not b[1]:
        return 1
    key = (id(a), id(b))
    if key not in seen:
        seen[key] = 1 + sum(matched(x, y, seen) for x, y in pairs(a[1], b[1], seen))
    return seen[key]


def pairs(a: list, b: list, seen: dict) -> list[tuple[list, list]]:
    """Matched children of two nodes, in order: those of the ordered matching with the most matched nodes."""
    left, right = [x[0] for x in a], [y[0] for y in b]
    if left == right and len(set(left)) == len(left):
        return list(zip(a, b, strict=True))
    if len(a) * len(b) > ALIGN_PAIRS:
        found, at = [], 0
        for x in a:
            for k in range(at, len(b)):
                if b[k][0] == x[0]:
                    found.append((x, b[k]))
                    at = k + 1
                    break
        return found
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        row, above = best[i + 1], best[i]
        for j, y in enumerate(b):
            row[j + 1] = max(above[j + 1], row[j], above[j] + matched(x, y, seen) if left[i] == right[j] else 0)
    found, i, j = [], len(a), len(b)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            found.append((a[i], b[j]))
    return found[::-1]


def _common(a: list[int], b: list[int]) -> list[int]:
    n = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))  # noqa: B905
    return a[:n]


def merge(a: list, b: list, seen: dict | None = None) -> list:
    """The wrapper of what wrappers a and b stand for; a is changed. Children without a match stay, each after what it came after."""
    seen = {} if seen is None else seen
    a[2] += b[2]
    if a[3] is not None:
        x, y = a[3], b[3]
        a[3] = [x[0] if x[0] == y[0] else None, _common(x[1], y[1]), _common(x[2], y[2]), *(sorted({*x[k], *y[k]})[:EVIDENCE] for k in (3, 4))]
        return a
    if b[1]:
        partner = {id(y): x for x, y in pairs(a[1], b[1], seen)}
        own = {id(x): k for k, x in enumerate(a[1])}
        kids, at = [], 0
        for y in b[1]:
            if (x := partner.get(id(y))) is None:
                kids.append(y)
            else:
                place = own[id(x)]
                kids += a[1][at:place]
                kids.append(merge(x, y, seen))
                at = place + 1
        a[1] = kids + a[1][at:]
    return a


def nodes_of(wrapper: list) -> int:
    return 1 + sum(map(nodes_of, wrapper[1]))


def pruned(wrapper: list) -> list:
    """A wrapper of at most WRAPPER_NODES nodes: if it has more, the half of them that most pages have stay, first ones first."""
    if nodes_of(wrapper) <= WRAPPER_NODES:
        return wrapper
    order: list[list] = []
    _listed(wrapper, order)
    # A node has at most the pages of the one above, and comes after it: what stays hangs together.
    stay = {id(node) for node in sorted(order, key=lambda node: -node[2])[: WRAPPER_NODES // 2]}
    for node in order:
        node[1] = [k for k in node[1] if id(k) in stay]
    return wrapper


def _listed(node: list, into: list[list]) -> None:
    into.append(node)
    for kid in node[1]:
        _listed(kid, into)


def template_leaves(wrapper: list, page: Page) -> set[int]:
    """Leaves of page that its host's wrapper says are template."""
    found: set[int] = set()
    seen: dict = {}
    hashes: dict[int, int] = {}

    def of(leaf: int) -> int:
        if leaf not in hashes:
            hashes[leaf] = _digest(page.texts[leaf])
        return hashes[leaf]

    def walk(node: list, slot: list) -> None:
        if slot[2] is None:
            for x, y in pairs(node[1], slot[1], seen):
                walk(x, y)
            return
        whole, first, last, titles, longest = node[3]
        if len(titles) < EVIDENCE or len(longest) < EVIDENCE:
            return
        leaves = slot[2]
        if whole is not None and whole == _digest(str([of(i) for i in leaves])):
            found.update(leaves)
            return
        for edge, order in ((first, leaves), (last, leaves[::-1])):
            for known, leaf in zip(edge, order):  # noqa: B905
                if known != of(leaf):
                    break
                found.add(leaf)

    walk(wrapper, slots(page))
    return found


def main_text(html: str, wrapper: list | None) -> str:
    """The blocks of a page that are neither template nor told to be no main text, joined by empty lines."""
    page = Page(html)
    template = template_leaves(wrapper, page) if wrapper else ()
    kept = [i for i in range(len(page.texts)) if page.kept[i] and i not in template]
    if not page.has_main:
        kept = [i for i in kept if page.links[i] <= 0.5 * len(page.texts[i])]
    return "\n\n".join(page.texts[i] for i in kept)


def _merged(wrappers: DataFrame) -> DataFrame:
    """Wrappers (host, wrapper as JSON) merged within each partition, in which the rows of a host follow each other."""

    def run(batches):
        host, held = None, None
        for batch in batches:
            for now, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if now == host:
                    held = pruned(merge(held, json.loads(blob)))
                    continue
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array([host]), pa.array([json.dumps(held, separators=(",", ":"))])], names=["host", "wrapper"])
                host, held = now, json.loads(blob)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([host]), pa.array([json.dumps(held, separators=(",", ":"))])], names=["host", "wrapper"])

    return wrappers.select("host", "wrapper").mapInArrow(run, "host string, wrapper string")


def host_of(url: Column) -> Column:
    """The lower-case host of an address, empty if it has none."""
    return F.lower(F.coalesce(F.regexp_extract(url.cast("string"), "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def induce(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper) of each host, as a written table."""
    ship(pages.sparkSession)

    def run(batches):
        held: dict[str, list] = {}
        nodes = 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(held), type=pa.string()), pa.array([json.dumps(w, separators=(",", ":")) for w in held.values()], type=pa.string())], names=["host", "wrapper"])

        for batch in batches:
            hosts = batch.column(0).to_pylist()
            for start, texts in text_runs(batch.column(1)):
                for host, html in zip(hosts[start : start + len(texts)], texts, strict=True):
                    made = wrapper_of(Page(html))
                    if host in held:
                        before = nodes_of(held[host])
                        held[host] = pruned(merge(held[host], made))
                        nodes += nodes_of(held[host]) - before
                    else:
                        held[host] = pruned(made)
                        nodes += nodes_of(made)
                    if nodes > HELD_NODES:
                        yield out()
                        held, nodes = {}, 0
        yield out()

    rows = pages.select(host_of(F.col(f"`{url_col}`")).alias("host"), F.col(f"`{html_col}`").alias("html")).filter("host != ''")
    first = rows.mapInArrow(run, "host string, wrapper string").withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(MERGE_SALTS)))
    dealt = _merged(first.repartition("host", "salt").sortWithinPartitions("host", "salt", "wrapper"))
    return cut(_merged(dealt.repartition("host").sortWithinPartitions("host", "wrapper")), "wrappers")


def _work(known: Callable[[], dict[str, str]]) -> Callable:
    """What map_texts calls for each run of pages: wrappers are looked up by host, or come in rows ahead of their pages."""

    def make() -> Callable:
        blobs = known()
        parsed: dict[str, list] = {}
        nodes = 0

        def wrapper(host: str, blob: str | None) -> list | None:
            nonlocal nodes
            if blob is not None:
                parsed.clear()
                parsed[host] = json.loads(blob)
            elif host not in parsed and host in blobs:
                parsed[host] = json.loads(blobs[host])
                nodes += nodes_of(parsed[host])
                if nodes > HELD_NODES:
                    last = parsed[host]
                    parsed.clear()
                    parsed[host], nodes = last, nodes_of(last)
            return parsed.get(host)

        def work(texts: list[str], hosts: list[str], given: list[str | None]) -> tuple[list, list]:
            out = []
            for html, host, blob in zip(texts, hosts, given, strict=True):
                found = wrapper(host, blob)
                out.append(main_text(html, found) if blob is None else "")
            return out, [len(t) for t in out]

        return work

    return make


def extract(pages: DataFrame, keep: list[str], url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Columns `keep` of pages with `text`, the main text, and `n_chars`, its code points."""
    wrappers = induce(pages, url_col, html_col)
    outputs = {"text": "string", "n_chars": "long"}
    host, none = host_of(F.col(f"`{url_col}`")), F.lit(None).cast("string")
    context = pages.sparkSession.sparkContext
    if wrappers.agg(F.coalesce(F.sum(F.length("wrapper") + F.length("host")), F.lit(0))).first()[0] <= BROADCAST_BYTES:
        sent = context.broadcast({r["host"]: r["wrapper"] for r in wrappers.collect()})
        discard(wrappers)
        return map_texts(pages, html_col, keep, outputs, _work(lambda: sent.value), [host, none])
    # Hosts with more than one in HOT_SHARE pages are fewer than HOT_SHARE.
    sizes = pages.groupBy(host.alias("host")).count()
    total = pages.count()
    hot = wrappers.join(sizes.filter(F.col("count") * HOT_SHARE > total).select("host"), "host")
    sent = context.broadcast({r["host"]: r["wrapper"] for r in hot.collect()})
    hot_hosts = list(sent.value)
    placed = pages.select(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)), F.col(f"`{html_col}`").alias("page"), host.alias("host"), none.alias("wrapper"))
    names = [f"k{i}" for i in range(len(keep))]
    mostly = map_texts(placed.filter(F.col("host").isin(hot_hosts)), "page", names, outputs, _work(lambda: sent.value), [F.col("host"), F.col("wrapper")])
    rest = placed.filter(~F.col("host").isin(hot_hosts)).withColumn("is_page", F.lit(1)).unionByName(wrappers.filter(~F.col("host").isin(hot_hosts)).withColumn("is_page", F.lit(0)), allowMissingColumns=True)
    rest = rest.repartition("host").sortWithinPartitions("host", "is_page")
    rest = map_texts(rest, "page", [*names, "is_page"], outputs, _work(dict), [F.col("host"), F.col("wrapper")]).filter("is_page = 1").drop("is_page")
    return mostly.unionByName(rest).toDF(*keep, *outputs)
