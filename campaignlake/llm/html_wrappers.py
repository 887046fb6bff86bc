"""Main text of web pages by wrappers: union-free regular expressions inferred from the pages of one host.

A page becomes a tree of elements with their class, id and role. A block whose whole text stands on at least half of its host's
pages (two at least) is a token of the template: its text belongs to its key, so it never folds into its neighbours. All other
text is a slot. Siblings that repeat fold into repeated groups. The different trees of a host are aligned with each other: tokens
that match are merged, those that do not become optional groups, so the result stays free of unions.

The host's main region is the article element, or else the element that holds most of the changing text and is no block of running text. Every page is then matched
against its host's wrapper, which binds its elements to the wrapper's nodes, each at its own place: two paragraphs of one key are
two slots if a token parts them. A token is template if it is no heading, stands in the wrapper before or after all
changing slots of the main region and reads as a notice, an advert or a menu; it goes on every page that has it, optional or not.
Other equal text is the article's. Pages of a host without such tokens are not matched, since a match would decide nothing there.
Regions that are never content (navigation, footers, adverts, forms, comments, ...) are known by their element, or by a name in their
class, id or role that consists of such words.

Pages of a hot host are first folded into the different trees they have, which are merged in staged rounds of about FAN_IN trees a
task until one wrapper is left; tokens are counted by host and text. A host has at most twice as many tokens as its mean page has
blocks, and a wrapper grows with the longest page and the different elements, not with the number of pages.

Defined cases: null and empty html give empty text; pages without any element are one block of text; an element that does not
fit its host's wrapper is read by the general rules, and so is a page without a host; repeated rows give repeated rows; unclosed
elements end with their parent; elements nested deeper than MAX_DEPTH are read as children of that depth; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campaignlake.llm.common import staged

MAX_DEPTH = 120
MAIN_SHARE = 0.7
FAN_IN = 200
LONGEST_TANDEM = 4
KNOWN_HOSTS = 1000

# Fixed values of HTML: elements without content, with raw content, and those that begin a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg math object canvas title xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th "
    "thead tr ul".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup "
    "time tt u var".split()
)
ENDS = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]),
}
SCOPES = frozenset("ul ol dl table select body html article section div".split())

NEVER = frozenset("head nav header footer aside form button select input label dialog menu".split()) | RAW
BOILERPLATE = frozenset(
    "ad ads advert advertisement adverts adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies "
    "disqus discussion footer gdpr header login masthead menu nav navbar navigation newsletter notice notices notification pagination "
    "pager popup promo related replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar "
    "topbar widget".split()
)

# Words that only say which part of a region an element is: `site-footer` is a footer, `ad-free` is no advert.
PARTS = frozenset(
    "site page main top bottom left right primary secondary inner outer area block box bar body container content form group header "
    "item items inner link links list panel row section slot title widget wrap wrapper".split()
)
# Blocks of running text: such a block is part of a main region, never the whole of one.
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl li dt dd pre blockquote address figcaption caption details summary tr".split())
# Elements that hold all regions, and the article itself, are never excluded for their class.
WHOLE = frozenset(["html", "body", "main", "article"])

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
_HEADING = re.compile(r"h[1-6]")
_NOTICE = re.compile(
    r"\b(?:subscri(?:be|ption)|newsletter|(?:our|this site uses|we use) cookies|cookie (?:policy|settings|notice)|advertisement|advertorial|"
    r"sponsored|sign up|log in|follow us|share this|privacy policy|terms of (?:use|service)|all rights reserved|copyright)\b|\u00a9",
    re.I,
)


class Node:
    """An element, or with key `()` a repeated group of siblings. On a page, `said` has its own pieces of text."""

    __slots__ = ("key", "children", "optional", "repeated", "text", "said")

    def __init__(self, key: str, children: list | None = None, optional=False, repeated=False, text=False):
        self.key, self.children, self.optional, self.repeated, self.text = key, children or [], optional, repeated, text
        self.said: list[str] = []

    def packed(self) -> list:
        return [self.key, self.optional * 1 + self.repeated * 2 + self.text * 4, [c.packed() for c in self.children]]

    @staticmethod
    def unpacked(x: list) -> Node:
        return Node(x[0], [Node.unpacked(c) for c in x[2]], bool(x[1] & 1), bool(x[1] & 2), bool(x[1] & 4))


#: Parts an element's key from the hash of its text, for tokens of the template.
TOKEN = " #"


@lru_cache(maxsize=10_000)
def element_key(tag: str, attributes: str) -> str:
    """Element with the names of its class, id and role, their words joined by hyphens; digits, which differ from page to
    page, stay out."""
    names = [name for m in _ATTRIBUTE.finditer(attributes) for name in (m[2] or m[3] or m[4] or "").lower().split()]
    return " ".join([tag, *sorted({"-".join(_WORD.findall(name)) for name in names} - {""})])


def boilerplate(name: str) -> bool:
    """A name that says nothing but that its region is no content: all its words do, or name a part of such a region."""
    words = set(name.split("-"))
    return bool(words & BOILERPLATE) and words <= BOILERPLATE | PARTS


@lru_cache(maxsize=10_000)
def excluded(key: str) -> bool:
    tag, *names = key.split(" ")
    return tag in NEVER or (tag not in WHOLE and any(map(boilerplate, names)))


def outside(path: tuple[str, ...]) -> bool:
    """Whether a path leads into a region that is never content. A heading in an article's own header is content."""
    for i, key in enumerate(path):
        if excluded(key):
            tag, *names = key.split(" ")
            own = tag == "header" and not any(map(boilerplate, names)) and any(k.split(" ", 1)[0] == "article" for k in path[:i])
            if not (own and any(_HEADING.fullmatch(k.split(" ", 1)[0]) for k in path[i + 1 :])):
                return True
    return False


def stream(source: str) -> Iterator[tuple[str, str]]:
    """("open", key), ("close", tag), ("text", text) and ("gap", "") events; elements closed by others get their close."""
    stack: list[str] = []
    at = 0

    def until(tags: frozenset[str], stop: frozenset[str]) -> Iterator[tuple[str, str]]:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i] in tags:
                while len(stack) > i:
                    yield "close", stack.pop()
                return
            if stack[i] in stop:
                return

    while at < len(source):
        m = _TOKEN.search(source, at)
        if m is None:
            yield "text", source[at:]
            break
        if m.start() > at:
            yield "text", source[at : m.start()]
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            yield from until(frozenset([tag]), frozenset())
        elif tag in VOID:
            yield "gap", tag
        elif tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
            at = end.end() if end else len(source)
        else:
            if tag in BLOCK:
                yield from until(frozenset(["p"]), SCOPES - {"div", "section", "article"})
            if tag in ENDS:
                yield from until(ENDS[tag], SCOPES - {"div", "section", "article"})
            stack.append(tag)
            yield "open", element_key(tag, m[3])
    while stack:
        yield "close", stack.pop()


def parsed(source: str) -> tuple[list[tuple[tuple[str, ...], str | None, Node]], Node]:
    """(pieces, tree): each piece of text with its path of keys and its element, text None at block ends."""
    root = Node("")
    nodes, paths, pieces = [root], [()], []
    for kind, value in stream(source):
        if kind == "open":
            tag = value.split(" ", 1)[0]
            deep = len(paths) > MAX_DEPTH
            node = nodes[-1] if deep or tag in INLINE else Node(value)
            if node is not nodes[-1]:
                nodes[-1].children.append(node)
            nodes.append(node)
            paths.append(paths[-1] if deep else (*paths[-1], value))
            if tag in BLOCK:
                pieces.append((paths[-1], None, node))
        elif kind == "close":
            nodes.pop()
            paths.pop()
            if value in BLOCK:
                pieces.append((paths[-1], None, nodes[-1]))
        elif kind == "gap":
            pieces.append((paths[-1], None if value == "hr" else " ", nodes[-1]))
            nodes[-1].said.append(" ")
        else:
            pieces.append((paths[-1], value, nodes[-1]))
            nodes[-1].said.append(value)
    return pieces, root


def block_of(path: tuple[str, ...]) -> tuple[str, ...]:
    """The path without the inline elements at its end: text slots belong to blocks."""
    n = len(path)
    while n and path[n - 1].split(" ", 1)[0] not in BLOCK:
        n -= 1
    return path[:n] if n else path


def text_mark(node: Node) -> str | int:
    """Hash of the whole text of an element without elements in it; else 1 if it has text of its own, 0 if not."""
    text = " ".join("".join(node.said).split())
    if not text or node.children:
        return int(bool(text))
    return hashlib.blake2b(html.unescape(text).encode("utf-8", "replace"), digest_size=8).hexdigest()


def marked(node: Node) -> list:
    """[key, text mark, children] of a page's element."""
    return [node.key, text_mark(node), [marked(c) for c in node.children]]


def shaped(page: list, tokens: frozenset[str] | set[str]) -> Node:
    """The page's tree with its host's `tokens` as part of the keys, repeats folded."""
    key, mark, children = page
    if mark in tokens:
        key += TOKEN + mark
    return Node(key, folded([shaped(c, tokens) for c in children]), text=bool(mark))


def tree(source: str, tokens: frozenset[str] = frozenset()) -> Node:
    """The page's token stream, repeats folded."""
    return shaped(marked(parsed(source)[1]), tokens)


def folded(nodes: list[Node]) -> list[Node]:
    """Runs of equal siblings, then of equal groups of siblings, as one repeated node each."""
    for period in range(1, LONGEST_TANDEM + 1):
        out: list[Node] = []
        i = 0
        keys = [n.key for n in nodes]
        while i < len(nodes):
            times = 1
            while keys[i : i + period] == keys[i + times * period : i + (times + 1) * period] and len(keys) - i >= (times + 1) * period:
                times += 1
            if times == 1:
                out.append(nodes[i])
                i += 1
                continue
            group = nodes[i : i + period]
            for k in range(1, times):
                group = [merged(a, b) for a, b in zip(group, nodes[i + k * period : i + (k + 1) * period], strict=True)]
            if period == 1:
                group[0].repeated = True
                out.append(group[0])
            else:
                out.append(Node("()", group, repeated=True))
            i += times * period
        nodes = out
    return nodes


def merged(a: Node, b: Node) -> Node:
    """Both streams in one expression: children that align are merged, others are optional."""
    children, i = [], 0
    places: dict[str, list[int]] = {}
    for j, n in enumerate(b.children):
        places.setdefault(n.key, []).append(j)
    for n in a.children:
        j = next((j for j in places.get(n.key, ()) if j >= i), None)
        if j is None:
            n.optional = True
            children.append(n)
            continue
        for skipped in b.children[i:j]:
            skipped.optional = True
            children.append(skipped)
        children.append(merged(n, b.children[j]))
        i = j + 1
    for rest in b.children[i:]:
        rest.optional = True
        children.append(rest)
    return Node(a.key, folded(children), a.optional or b.optional, a.repeated or b.repeated, a.text or b.text)


def expression(node: Node) -> str:
    """The wrapper as a regular expression over tokens, for reading."""
    inner = ("#TEXT " if node.text else "") + " ".join(expression(c) for c in node.children)
    body = f"( {inner} )" if node.key == "()" else f"<{node.key}> {inner} </>"
    return body + ("+" if node.repeated else "") + ("?" if node.optional else "")


# ---- inference over a table

def page_host(url) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


FACT = "host string, kind string, name string, pages long, chars long, low string, high string"
_FACT = pa.schema(
    [("host", pa.string()), ("kind", pa.string()), ("name", pa.string()), ("pages", pa.int64()), ("chars", pa.int64())]
    + [(x, pa.string()) for x in ("low", "high")]
)


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trees of a batch's pages, and by host its texts of blocks and its slots by key path, with counts."""
    for batch in batches:
        trees: dict[tuple[str, str], int] = {}
        texts: dict[tuple[str, str], int] = {}
        found: dict[tuple[str, str], list] = {}
        slot_of: dict[tuple[str, ...], tuple[str, ...] | None] = {}
        for host, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            pieces, root = parsed(source or "")
            page = marked(root)
            shape = json.dumps(page, separators=(",", ":"))
            trees[host, shape] = trees.get((host, shape), 0) + 1
            for mark in set(_marks(page)):
                texts[host, mark] = texts.get((host, mark), 0) + 1
            own: dict[tuple[str, ...], list[str]] = {}
            for path, text, _ in pieces:
                if text and not text.isspace():
                    if path not in slot_of:
                        slot_of[path] = None if outside(path) else block_of(path)
                    if slot_of[path] is not None:
                        own.setdefault(slot_of[path], []).append(text)
            for path, said in own.items():
                whole = "".join(said)
                mark = hashlib.blake2b(" ".join(whole.split()).encode("utf-8", "replace"), digest_size=8).hexdigest()
                x = found.setdefault((host, json.dumps(path)), [0, 0, mark, mark])
                x[:] = [x[0] + 1, x[1] + len(whole), min(x[2], mark), max(x[3], mark)]
        rows = [(h, "tree", t, n, 0, "", "") for (h, t), n in trees.items()]
        rows += [(h, "text", t, n, 0, "", "") for (h, t), n in texts.items()]
        rows += [(h, "slot", p, *x) for (h, p), x in found.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _FACT, strict=True)], schema=_FACT)


def _marks(page: list) -> Iterator[str]:
    if isinstance(page[1], str):
        yield page[1]
    for child in page[2]:
        yield from _marks(child)


_STREAM = pa.schema([("host", pa.string()), ("name", pa.string()), ("pages", pa.int64())])


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Different folded trees of each host in a batch, with its tokens."""
    for batch in batches:
        found: dict[tuple[str, str], int] = {}
        for host, page, n, tokens in zip(*(batch.column(x).to_pylist() for x in ("host", "name", "pages", "tokens")), strict=True):
            shape = json.dumps(shaped(json.loads(page), set(tokens or ())).packed(), separators=(",", ":"))
            found[host, shape] = found.get((host, shape), 0) + n
        yield pa.RecordBatch.from_pylist([dict(host=h, name=s, pages=n) for (h, s), n in found.items()], _STREAM)


def _merge(key: tuple, group: pa.Table) -> pa.Table:
    """One wrapper of a group's streams, the most frequent first."""
    host = group.column("host")[0].as_py()
    order = sorted(zip(group.column("pages").to_pylist(), group.column("name").to_pylist(), strict=True), key=lambda x: (-x[0], x[1]))
    wrapper = Node.unpacked(json.loads(order[0][1]))
    for _, shape in order[1:]:
        wrapper = merged(wrapper, Node.unpacked(json.loads(shape)))
    row = dict(host=host, name=json.dumps(wrapper.packed(), separators=(",", ":")), pages=sum(n for n, _ in order))
    return pa.Table.from_pylist([row], _STREAM)


def walk(node: Node, path: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], Node]]:
    """Nodes below a wrapper's node in order, with their paths of plain keys."""
    for child in node.children:
        if child.key == "()":
            yield from walk(child, path)
        else:
            own = (*path, child.key.split(TOKEN, 1)[0])
            yield own, child
            yield from walk(child, own)


def article_paths(wrapper: Node) -> list[tuple[str, ...]]:
    """Paths of the outermost articles, or else of the main elements."""
    paths = {p for p, _ in walk(wrapper) if not any(map(excluded, p))}
    for tag in ("article", "main"):
        found = {p for p in paths if p[-1].split(" ")[0] == tag or (tag == "main" and "main" in p[-1].split(" ")[1:])}
        outer = [p for p in found if not any(p[:n] in found for n in range(1, len(p)))]
        if outer:
            return sorted(outer)
    return []


def heaviest(slots: DataFrame) -> DataFrame:
    """(host, heavy): the deepest path of each host that holds MAIN_SHARE of its changing text, as a JSON array."""
    changing = slots.where("pages < 2 or low <> high").select("host", "chars", F.from_json("name", "array<string>").alias("path"))
    total = changing.groupBy("host").agg(F.sum("chars").alias("total"))
    ends = F.explode(F.sequence(F.lit(1), F.size("path")))
    prefixes = changing.where(F.size("path") > 0).select("host", "chars", "path", ends.alias("depth"))
    mass = prefixes.groupBy("host", F.slice("path", F.lit(1), F.col("depth")).alias("path")).agg(F.sum("chars").alias("chars"))
    running = F.substring_index(F.element_at("path", -1), " ", 1).isin(*sorted(RUNNING))
    held = mass.where(~running).join(total, "host").where(F.col("chars") >= MAIN_SHARE * F.col("total"))
    return held.groupBy("host").agg(F.to_json(F.max(F.struct(F.size("path").alias("depth"), "path"))["path"]).alias("heavy"))


def _rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What extraction needs of a host: its main region's paths, and its wrapper if tokens of it may be template."""
    for batch in batches:
        out = []
        for name, heavy in zip(batch.column("name").to_pylist(), batch.column("heavy").to_pylist(), strict=True):
            wrapper = Node.unpacked(json.loads(name))
            regions = article_paths(wrapper) or ([tuple(json.loads(heavy))] if heavy else [])
            out.append(json.dumps({"regions": regions, "wrapper": json.loads(name) if edge_tokens(wrapper, regions) else None}))
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(out, pa.string())], ["host", "rules"])


def merged_streams(streams: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """(host, name, pages): one wrapper for each host. Each round merges groups of about `fan_in` streams, so no task's
    group grows with the host; hosts that are done are passed on."""
    while streams.groupBy("host").count().where("count > 1").limit(1).count():
        groups = streams.groupBy("host").agg(F.ceil(F.count("*") / fan_in).alias("groups"))
        dealt = streams.join(groups, "host").withColumn("salt", F.pmod(F.xxhash64("name"), "groups")).drop("groups")
        streams = staged(dealt.groupBy("host", "salt").applyInArrow(_merge, "host string, name string, pages long"), "wrappers")
    return streams


def infer_wrappers(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(wrappers, rules) by host of `pages` (host, html).

    The small tables by host are staged before their joins, so both sides of a join are plain and Spark either broadcasts the
    small one by its size or splits a hot host's partition of the other."""
    facts = staged(pages.select("host", "html").mapInArrow(_facts, FACT), "page-facts")
    trees = facts.where("kind = 'tree'").select("host", "name", "pages")
    sizes = staged(trees.groupBy("host").agg(F.sum("pages").alias("total")), "page-counts")
    texts = facts.where("kind = 'text'").groupBy("host", "name").agg(F.sum("pages").alias("n")).where("n > 1")
    frequent = staged(texts.join(sizes, "host").where("2 * n >= total").select("host", "name"), "frequent-texts")
    tokens = staged(frequent.groupBy("host").agg(F.collect_list("name").alias("tokens")), "tokens")
    shape = "host string, name string, pages long"
    streams = trees.join(tokens, "host", "left").mapInArrow(_streams, shape).groupBy("host", "name").agg(F.sum("pages").alias("pages"))
    wrappers = merged_streams(staged(streams, "streams"))
    slots = facts.where("kind = 'slot'").groupBy("host", "name").agg(
        F.sum("pages").alias("pages"), F.sum("chars").alias("chars"), F.min("low").alias("low"), F.max("high").alias("high")
    )
    rules = wrappers.join(heaviest(slots), "host", "left").mapInArrow(_rules, "host string, rules string")
    return wrappers, staged(rules, "wrapper-rules")


# ---- extraction

def edge_tokens(wrapper: Node, regions: list[tuple[str, ...]]) -> set[int]:
    """Identities of the wrapper's tokens that stand before or after all changing slots of the main region, headings left out."""
    slots = [
        (p, n) for p, n in walk(wrapper) if n.text and not outside(p) and (not regions or any(p[: len(r)] == r for r in regions))
    ]
    changing = [i for i, (_, n) in enumerate(slots) if TOKEN not in n.key]
    if not changing:
        return set()
    return {
        id(n)
        for i, (p, n) in enumerate(slots)
        if TOKEN in n.key and not changing[0] < i < changing[-1] and not any(_HEADING.fullmatch(k.split(" ", 1)[0]) for k in p)
    }


class Wrapper:
    """A host's rules, ready for matching."""

    def __init__(self, rules: dict):
        self.regions = [tuple(r) for r in rules["regions"]]
        self.root = Node.unpacked(rules["wrapper"]) if rules["wrapper"] else None
        self.edges = edge_tokens(self.root, self.regions) if self.root else set()
        self.tokens = {n.key.split(TOKEN, 1)[1] for _, n in walk(self.root) if TOKEN in n.key} if self.root else set()
        self._plans: dict[int, tuple[dict[str, list[int]], list[tuple[Node, int]]]] = {}

    def _plan(self, node: Node) -> tuple[dict[str, list[int]], list[tuple[Node, int]]]:
        """Places of each key among the node's children, and for each place its node and the first place that may follow it."""
        if id(node) not in self._plans:
            line: list[tuple[Node, int]] = []

            def add(children: list[Node], start: int | None) -> None:
                for child in children:
                    if child.key == "()":
                        add(child.children, len(line) if start is None else start)
                    else:
                        after = start if start is not None else len(line) + (not child.repeated)
                        line.append((child, after))

            add(node.children, None)
            places: dict[str, list[int]] = {}
            for i, (child, _) in enumerate(line):
                places.setdefault(child.key, []).append(i)
            self._plans[id(node)] = (places, line)
        return self._plans[id(node)]

    def _line(self, element: Node, node: Node, fitted: dict[tuple[int, int], bool]) -> Iterator[tuple[Node, Node | None, bool]]:
        """(child, slot, whether all below it fits) for the children of a page's element. Every child takes the first place that
        its predecessor leaves open and that all below it fits: since everything may be left out and groups may repeat, that
        leaves most to the children after it. If it fits none, it takes the first of its key, or none."""
        places, line = self._plan(node)
        at = 0
        for child in element.children:
            mark = text_mark(child)
            key = child.key + TOKEN + mark if mark in self.tokens else child.key
            open_places = places.get(key, [])
            open_places = open_places[bisect_left(open_places, at) :]
            found = next((j for j in open_places if self._fits(child, line[j][0], fitted)), None)
            j = open_places[0] if found is None and open_places else found
            if j is None:
                yield child, None, False
            else:
                at = line[j][1]
                yield child, line[j][0], found is not None

    def _fits(self, element: Node, node: Node, fitted: dict[tuple[int, int], bool]) -> bool:
        pair = (id(element), id(node))
        if pair not in fitted:
            fitted[pair] = all(fits for _, _, fits in self._line(element, node, fitted))
        return fitted[pair]

    def bind(self, page: Node) -> dict[int, Node]:
        """The wrapper's node for each element of a page that matches."""
        bound: dict[int, Node] = {}
        fitted: dict[tuple[int, int], bool] = {}
        todo = [(page, self.root)]
        while todo:
            for child, slot, _ in self._line(*todo.pop(), fitted):
                if slot is not None:
                    bound[id(child)] = slot
                    todo.append((child, slot))
        return bound

    def template(self, root: Node, pieces: list[tuple[tuple[str, ...], str | None, Node]]) -> set[int]:
        """Identities of a page's elements that are bound to a template token at the region's edge."""
        bound = {x for x, slot in self.bind(root).items() if id(slot) in self.edges} if self.edges else set()
        said: dict[int, list] = {}
        for path, text, node in pieces:
            if text and id(node) in bound:
                x = said.setdefault(id(node), ["", 0])
                link = any(key.split(" ", 1)[0] == "a" for key in path)
                x[:] = [x[0] + text, x[1] + len(text) * link]
        return {i for i, (text, linked) in said.items() if 2 * linked > len(text) or _NOTICE.search(" ".join(html.unescape(text).split()))}


def main_text(source: str, wrapper: Wrapper | None = None) -> str:
    """Blocks of a page's main region, without excluded regions and template tokens, joined by line ends."""
    pieces, root = parsed(source)
    template = wrapper.template(root, pieces) if wrapper else set()
    regions = wrapper.regions if wrapper and wrapper.regions else general_regions(root, pieces)
    fits = [r for r in regions if any(t and t.strip() and p[: len(r)] == r for p, t, _ in pieces)]
    blocks: list[list[str]] = [[]]
    verdict: dict[tuple[str, ...], bool] = {}
    for path, text, node in pieces:
        if text is None:
            blocks.append([])
            continue
        if path not in verdict:
            verdict[path] = (not fits or any(path[: len(r)] == r for r in fits)) and not outside(path)
        if verdict[path] and id(node) not in template:
            blocks[-1].append(html.unescape(text))
    lines = (" ".join("".join(b).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def general_regions(root: Node, pieces: list[tuple[tuple[str, ...], str | None, Node]]) -> list[tuple[str, ...]]:
    """Main region of a page on its own."""
    found = article_paths(root)
    if found:
        return found
    mass: dict[tuple[str, ...], int] = {}
    total = 0
    for path, text, _ in pieces:
        if text and text.strip() and not outside(path):
            total += len(text)
            for n in range(1, len(block_of(path)) + 1):
                mass[path[:n]] = mass.get(path[:n], 0) + len(text)
    held = [p for p, c in mass.items() if c >= MAIN_SHARE * total and p[-1].split(" ", 1)[0] not in RUNNING]
    return [max(held, key=lambda p: (len(p), p))] if held else []


def _extract(keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Wrapper] = {}
        for batch in batches:
            out = []
            for source, rules in zip(batch.column("_html").to_pylist(), batch.column("rules").to_pylist(), strict=True):
                if rules is not None and rules not in known:
                    if len(known) >= KNOWN_HOSTS:
                        known.clear()
                    known[rules] = Wrapper(json.loads(rules))
                out.append(main_text(source or "", known.get(rules)))
            columns = [pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.select(keep).columns, *columns], [*keep, "text", "n_chars"])

    return run


def page_texts(pages: DataFrame, keep: list[str]) -> DataFrame:
    """`keep` (page_id, url, ...) of each row of `pages` (url, html) with the main text and its code points."""
    hosted = pages.select(*keep, page_host(pages["url"]).alias("host"), pages["html"].cast("string").alias("_html"))
    _, rules = infer_wrappers(hosted.select("host", F.col("_html").alias("html")))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*keep).schema)
    return hosted.join(rules, "host", "left").mapInArrow(_extract(keep), f"{fields}, text string, n_chars long")
