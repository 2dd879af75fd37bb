"""Main text of web pages by wrappers inferred per host.

A page is read as nested tokens: block elements (with their classes) and texts. Repeated runs of siblings are
folded into groups. The pages of a host are aligned one after the other with what is known of the host so far:
where two texts differ they become a slot, an element that only one side has becomes optional, a run of equal
siblings becomes a repeated group. No alternatives are formed, so the result is a union-free regular expression
over tokens, the host's wrapper. It says where the slots are that hold the article.

Wrappers are merged where the pages are read, then per host and salt, then per host, so a host with most of the
pages is never gathered in one task. What travels back to the pages is a rule of a few names per host.

Defined cases: a null or empty page has an empty text; a null url, or one without a host, belongs to the host
named by the empty string; repeated rows are extracted each; broken markup is read as far as it goes (open elements end
with their parent); an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.frames import bounded, map_arrow, map_batches
from tallyweave.session import stored

#: Partial wrappers of a host are merged in so many parts first.
SALTS = 16
#: In wrappers, texts below this depth stand side by side in the element above. Pages are read at any depth.
DEPTH = 40
#: Texts are fixed on hosts of so many pages.
FIXED_PAGES = 3
#: Pages with so many times more in fixed texts than in others are copies of one another.
COPIES = 2
#: A host's partial wrapper leaves a task when the task knows so many hosts.
HOSTS_HELD = 2_000

# Fixed names of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr img".split()
)
RAW = "script|style|noscript|template|svg|iframe|object|canvas|textarea|title|math"
#: Of these, the ones that hold nothing where the start tag ends in "/>".
CLOSES_ITSELF = "svg|math|object|canvas"
LEFT_OUT = frozenset(
    "head nav header footer aside form button select option fieldset label legend dialog menu datalist audio video "
    "applet frameset".split()
)
#: An open element of this kind ends where an article or the main part begins.
ENDS_AT_ARTICLE = frozenset("nav header aside form menu".split())
#: An element is closed by the start of one of these beside it.
CLOSED_BY = {
    "p": frozenset(
        "p div ul ol dl table article section aside nav header footer main form h1 h2 h3 h4 h5 h6 pre blockquote figure hr "
        "address fieldset details".split()
    ),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "option": frozenset(["option"]),
}
#: What holds such elements: the search for one to close stops there.
HOLDS = frozenset("ul ol dl table div article section main aside nav header footer form td th body html".split())
#: Words in class, id or role that mark what is not the article.
ASIDE_WORDS = frozenset(
    "nav navbar navigation menu sidebar ad ads adbox advert adverts advertisement advertising sponsor sponsored promo "
    "banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup "
    "comment comments commentlist disqus reply replies respond footer header masthead breadcrumb breadcrumbs pagination "
    "pager share sharing social related recommended recommendations toolbar login widget search complementary "
    "contentinfo form hidden".split()
)
#: Words that may stand beside them in a name; a name with any other word ("search-results") says nothing.
NEUTRAL_WORDS = frozenset(
    "list box bar block section area wrap wrapper container content inner outer item items link links button buttons top bottom "
    "left right main site page module panel region row col column text title icon group unit the a of".split()
)
#: Blocks of text are judged by these words only.
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote figure figcaption li dt dd td th tr".split())
TEXT_ASIDE_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored cookie cookies consent newsletter comment comments "
    "commentlist disqus reply replies respond hidden".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist reply replies disqus respond".split())
MAIN_WORDS = frozenset(["main", "articlebody"])

TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?:{CLOSES_ITSELF})(?=[\s/])(?:[^<>\"']|\"[^\"]*\"|'[^']*')*(?<=/)>"
    rf"|<({RAW})(?=[\s/>])(?:[^<>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:_-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-a-zA-Z0-9_:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORD = re.compile(r"[a-z]+")


@dataclass
class Node:
    """An element of a page, or a text (name ``#``)."""

    name: str
    token: str
    aside: bool = False
    main: bool = False
    text: str = ""
    linked: bool = False
    children: list[Node] = field(default_factory=list)


def marked(name: str, marks: frozenset[str]) -> bool:
    """Whether a class, id or role is one of the words, or made of them and neutral ones."""
    words = set(WORD.findall(name))
    return bool(words & marks) and words <= marks | NEUTRAL_WORDS


def element(name: str, attributes: str) -> Node:
    if not attributes.strip():
        return Node(name, name, name in LEFT_OUT, name == "main")
    found = {k.lower(): (a or b or c) for k, a, b, c in ATTRIBUTE.findall(attributes)}
    classes = f"{found.get('class', '')} {found.get('id', '')}".lower()
    named = f"{classes} {found.get('role', '')}".lower().split()
    marks = COMMENT_WORDS if name in ("main", "article") else TEXT_ASIDE_WORDS if name in TEXT_BLOCKS else ASIDE_WORDS
    aside = name in LEFT_OUT or name not in ("html", "body") and any(map(marked, named, [marks] * len(named)))
    style = found.get("style", "").replace(" ", "").lower()
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in style:
        aside = True
    main = name == "main" or found.get("role", "").lower() == "main" or found.get("itemprop", "").lower() in MAIN_WORDS
    names = sorted(set(re.sub(r"\d+", "0", classes).split()))
    return Node(name, ".".join([name, *names]), aside, main)


def parse(page: str) -> Node:
    """The page as a tree; texts keep their white space until blocks are joined."""
    root = Node("", "")
    stack, anchors = [root], 0
    opened: Counter[str] = Counter()

    def add_text(text: str) -> None:
        if text:
            last = stack[-1].children
            if last and last[-1].name == "#":
                last[-1].text += text
                last[-1].linked &= anchors > 0 or not text.strip()
            else:
                last.append(Node("#", "#", text=text, linked=anchors > 0 or not text.strip()))

    def cut(k: int) -> None:
        opened.subtract(n.name for n in stack[k:])
        del stack[k:]

    def close_to(name: str, stops: frozenset[str]) -> None:
        if not opened[name]:
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].name == name:
                cut(k)
                return
            if stack[k].name in stops:
                return

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            add_text(html.unescape(page[at : m.start()]))
        at = m.end()
        name = m.group(3)
        if not name:
            if page.startswith("<![CDATA[", m.start()):
                add_text(m.group()[9:-3])
            continue
        name = name.lower()
        if m.group(2):
            if name == "a":
                anchors = max(0, anchors - 1)
            elif name not in INLINE and name not in VOID:
                if name == "p" and not opened["p"]:
                    add_text(" ")
                close_to(name, frozenset())
            continue
        if name == "br" or name == "hr":
            add_text(" ")
        if name == "a":
            anchors = 1
        if name in INLINE or name in VOID:
            continue
        anchors = 0
        while stack[-1].name in CLOSED_BY and name in CLOSED_BY[stack[-1].name]:
            cut(len(stack) - 1)
        for open_name, closers in CLOSED_BY.items():
            if name in closers:
                close_to(open_name, HOLDS - {open_name})
        node = element(name, m.group(4))
        if name in ("article", "main") and not opened["article"] and not opened["main"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name in ENDS_AT_ARTICLE:
                    cut(k)
        stack[-1].children.append(node)
        stack.append(node)
        opened[name] += 1
    if at < len(page):
        add_text(html.unescape(page[at:]))
    return root


# Wrappers ----------------------------------------------------------------------
# An item is [token, optional, repeated, text, chars, flags, children, always, blocks]. text: a fixed text, or None for a
# slot; flags: 1 aside, 2 main; children of an element, or of a group of siblings (token "()"); always: keys of the texts
# that every page read so far shows here, with their chars; chars (not of links) and blocks: of all texts that came here.
Item = list


def below(path: bytes, token: str) -> bytes:
    """The place of an element below the place ``path``."""
    return hashlib.blake2b(path + token.encode("utf-8", "replace"), digest_size=12).digest()


def key(path: bytes, text: str) -> str:
    """A text at its place."""
    return hashlib.blake2b(path + b"#" + text.encode("utf-8", "replace"), digest_size=12).hexdigest()


def item(node: Node, path: bytes, depth: int) -> Item:
    if node.name == "#":
        text = " ".join(node.text.split())
        return ["#", False, False, text, 0 if node.linked else len(text), 0, [], {key(path, text): 0 if node.linked else len(text)}, 1]
    inner = items(node.children, below(path, node.token), depth + 1)
    return [node.token, False, False, None, 0, node.aside + 2 * node.main, inner, {}, 0]


def items(nodes: list[Node], path: bytes = b"", depth: int = 1) -> list[Item]:
    """The children of a node as items, with repeated runs folded. What is left out anyway is not looked into."""
    found = []
    for n, place, level in deep(nodes, path, depth) if depth >= DEPTH else ((n, path, depth) for n in nodes):
        if n.name == "#" and not n.text.strip():
            continue
        found.append([n.token, False, False, None, 0, 1, [], {}, 0] if n.aside else item(n, place, level))
    return fold(found)


def deep(nodes: list[Node], path: bytes, depth: int) -> Iterator[tuple[Node, bytes, int]]:
    """The texts at any depth below, in order, with their places. Above the last level, articles and main parts come whole."""
    todo = [(n, path) for n in reversed(nodes)]
    while todo:
        n, place = todo.pop()
        if n.name == "#" or depth == DEPTH and not n.aside and (n.name == "article" or n.main):
            yield n, place, depth
        elif not n.aside:
            inner = below(place, n.token)
            todo += [(x, inner) for x in reversed(n.children)]


def fold(row: list[Item]) -> list[Item]:
    """Runs of one to three siblings that repeat at once become one repeated item or group."""
    for period in (1, 2, 3):
        out: list[Item] = []
        for x in row:
            out.append(x)
            if len(out) >= 2 * period and all(out[-k][0] == out[-k - period][0] for k in range(1, period + 1)):
                again = [out.pop() for _ in range(period)][::-1]
                first = [out.pop() for _ in range(period)][::-1]
                both = [join(a, b, True) for a, b in zip(first, again)]
                if period == 1:
                    both[0][2] = True
                    out.append(both[0])
                else:
                    out += both
                    for y in both:
                        y[2] = True
        row = out
    return row


def join(a: Item, b: Item, same: bool = False) -> Item:
    """Two items of the same token as one; ``same``: siblings, which the same pages show."""
    text = a[3] if a[3] == b[3] else None
    always = a[7] | b[7] if same else {k: n for k, n in a[7].items() if k in b[7]}
    return [a[0], a[1] or b[1], a[2] or b[2], text, a[4] + b[4], a[5] | b[5], align(a[6], b[6], same), always, a[8] + b[8]]


def lone(x: Item, same: bool) -> Item:
    """An item that one side only has. If the sides are different pages, no text of it is on all pages."""
    found = x if same else seldom(x)
    return [x[0], True, *found[2:]]


def seldom(x: Item) -> Item:
    return [*x[:6], [seldom(y) for y in x[6]], {}, x[8]]


def align(a: list[Item], b: list[Item], same: bool = False) -> list[Item]:
    """Two sequences as one: items of the longest common subsequence are joined, all others become optional."""
    if not a or not b:
        return [lone(x, same) for x in a or b]
    if [x[0] for x in a] == [x[0] for x in b]:
        return [join(x, y, same) for x, y in zip(a, b)]
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, below, token = best[i], best[i + 1], a[i][0]
        for j in range(m - 1, -1, -1):
            row[j] = below[j + 1] + 1 if token == b[j][0] else max(below[j], row[j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i][0] == b[j][0]:
            out.append(join(a[i], b[j], same))
            i, j = i + 1, j + 1
        elif j == m or i < n and best[i + 1][j] >= best[i][j + 1]:
            out.append(lone(a[i], same))
            i += 1
        else:
            out.append(lone(b[j], same))
            j += 1
    return fold(out)


def expression(row: list[Item]) -> str:
    """A wrapper as text: ``tag(...)`` elements, ``#`` slots, quoted fixed texts, ``?`` optional, ``+`` repeated."""
    out = []
    for token, optional, repeated, text, _, _, inner, *_ in row:
        body = ("#" if text is None else json.dumps(text)) if token == "#" else f"{token}({expression(inner)})"
        out.append(body + "+" * repeated + "?" * optional)
    return " ".join(out)


def slot_chars(x: Item, fixed: frozenset[str]) -> int:
    """Characters in the texts (not links, not fixed texts) below an item."""
    if x[5] & 1:
        return 0
    own = x[4] if x[0] == "#" and (x[3] is None or fixed.isdisjoint(x[7])) else 0
    return own + sum(slot_chars(y, fixed) for y in x[6])


def texts_of(row: list[Item]) -> Iterator[Item]:
    """The texts of a wrapper in page order, without what is left out anyway."""
    for x in row:
        if not x[5] & 1:
            if x[0] == "#":
                yield x
            yield from texts_of(x[6])


def fixed_texts(row: list[Item], pages: int) -> list[str]:
    """Keys of the texts that all pages show at one place and that are not left out anyway. Where nearly all is on all
    pages, these are copies of one article, and none of it is fixed."""
    found: dict[str, int] = {}
    chars = blocks = 0
    if pages < FIXED_PAGES:
        return []
    for x in texts_of(row):
        found.update(x[7])
        chars, blocks = chars + x[4], blocks + x[8]
    same, n = pages * sum(found.values()), pages * len(found)
    if same >= COPIES * (chars - same) and n >= COPIES * (blocks - n):
        return []
    return sorted(found)


def regions(row: list[Item], token: str) -> list[Item]:
    """Outermost items of a token, as in :func:`_named`."""
    out = []
    for x in row:
        if not x[5] & 1:
            article = token.split(".")[0] == "article" == x[0].split(".")[0]
            out += [x] if x[0] == token or article else regions(x[6], token)
    return out


def rule(wrapper: list[Item], pages: int) -> dict:
    """Where the article is: the token of its element, and the fixed texts beside slots that are not part of it.
    An article element comes first (what it holds is then sorted into slots and fixed texts as elsewhere), then the main part, then the smallest element with most of the slots; there
    the texts beside it that are neither links nor fixed belong to the article too."""

    def search(row: list[Item], path: list[str], wanted) -> list[str] | None:
        for x in row:
            if x[0] != "#" and not x[5] & 1:
                if wanted(x):
                    return [*path, x[0]]
                if found := search(x[6], [*path, x[0]], wanted):
                    return found
        return None

    for wanted in (lambda x: x[0].split(".")[0] == "article", lambda x: x[5] & 2):
        if found := search(wrapper, [], wanted):
            return {"root": found[-1], "fixed": fixed_texts(regions(wrapper, found[-1]), pages)}
    path: list[str] = []
    fixed = fixed_texts(wrapper, pages)
    known = frozenset(fixed)
    row, total = wrapper, sum(slot_chars(x, known) for x in wrapper)
    while total:
        inner = max((x for x in row if x[0] != "#"), key=lambda x: slot_chars(x, known), default=None)
        if inner is None or slot_chars(inner, known) < 0.7 * total or inner[2]:
            break
        path.append(inner[0])
        row = inner[6]
    return {"root": path[-1] if path else "", "fixed": fixed, "beside": True}


def extract(page: str, found: dict) -> str:
    """The article of a page by its host's rule; a page that does not have the rule's element is read by its own."""
    tree = parse(page)
    roots, beside = _named(tree, found["root"]), found.get("beside", False)
    if found["root"] and not roots:
        alone = rule(items(tree.children), 1)
        roots, beside = _named(tree, alone["root"]), alone.get("beside", False)
    fixed = set(found["fixed"])
    blocks: list[tuple[str, bool, bool]] = []  # text, fixed, may stay though fixed
    own: list[int] = []  # places of texts in the article that are this page's own
    # Without links: what stands beside the roots.
    todo = [(root, path, False, "") for root, path in reversed(roots)]
    if beside or not roots:
        todo = [(tree, b"", bool(roots), "")]
    whole = {id(root) for root, _ in roots}
    while todo:
        node, path, outside, parent = todo.pop()
        if node.name != "#":
            outside = outside and id(node) not in whole
            inner = below(path, node.token) if fixed and node is not tree else path
            todo += [(x, inner, outside, node.name) for x in reversed(node.children) if not x.aside]
        elif not (outside and node.linked):
            text = " ".join(node.text.split())
            if text:
                same = bool(fixed) and key(path, text) in fixed
                inside = bool(roots) and not outside and not node.linked
                if inside and not same:
                    own.append(len(blocks))
                blocks.append((text, same, inside and parent in TEXT_BLOCKS))
    # A fixed heading, paragraph or list item between texts of this page's own is a part that the articles of a host
    # share; a fixed text in a mere container, or before or after all of them, is a frame.
    return " ".join(
        text for i, (text, same, stays) in enumerate(blocks) if not same or stays and own and own[0] < i < own[-1]
    )


def _named(tree: Node, token: str) -> list[tuple[Node, bytes]]:
    """Outermost elements of a token that are not left out, with the places that hold them; an article also under other
    classes. None for the empty token."""
    if not token:
        return []
    name = token.split(".")[0]
    out: list[tuple[Node, bytes]] = []
    todo = [(x, b"") for x in reversed(tree.children)]
    while todo:
        x, path = todo.pop()
        if x.name != "#" and not x.aside:
            if x.token == token or name == "article" and x.name == "article":
                out.append((x, path))
            else:
                inner = below(path, x.token)
                todo += [(y, inner) for y in reversed(x.children)]
    return out


# On Spark ----------------------------------------------------------------------


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def _batch(rows: list[tuple[str, int, str, int]]) -> pa.RecordBatch:
    hosts, salts, wrappers, pages = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(hosts), pa.array(salts, pa.int32()), pa.array(wrappers), pa.array(pages, pa.int64())],
        names=["host", "salt", "wrapper", "pages"],
    )


PARTIAL = "host string, salt int, wrapper string, pages bigint"


def infer(pages: DataFrame) -> DataFrame:
    """host, wrapper (as JSON) and pages of every host."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known: dict[str, tuple[list[Item], int]] = {}
        salt = TaskContext.get().partitionId() % SALTS

        def leave() -> pa.RecordBatch:
            rows = [(name, salt, json.dumps(w, ensure_ascii=False), n) for name, (w, n) in known.items()]
            known.clear()
            return _batch(rows)

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = items(parse(text.as_py() or "").children)
                before = known.get(name)
                known[name] = (found, 1) if before is None else (align(before[0], found), before[1] + 1)
                if len(known) >= HOSTS_HELD:
                    yield leave()
        if known:
            yield leave()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Partial wrappers that come sorted by host and salt; one row for each."""
        key, wrapper, total = None, [], 0
        for batch in batches:
            for name, salt, text, n in zip(*[c.to_pylist() for c in batch.columns]):
                if key != (name, salt):
                    if key is not None:
                        yield _batch([(*key, json.dumps(wrapper, ensure_ascii=False), total)])
                    key, wrapper, total = (name, salt), json.loads(text), n
                else:
                    wrapper, total = align(wrapper, json.loads(text)), total + n
        if key is not None:
            yield _batch([(*key, json.dumps(wrapper, ensure_ascii=False), total)])

    # Wrappers are merged in the order of their texts, not of their arrival, so a repeated run gives the same.
    order = ["host", "salt", "pages", "wrapper"]
    partial = map_batches(pages.select(host(F.col("url")).alias("host"), "html"), read, PARTIAL)
    salted = map_batches(partial.repartition("host", "salt").sortWithinPartitions(*order), merge, PARTIAL)
    single = salted.withColumn("salt", F.lit(0)).repartition("host").sortWithinPartitions(*order)
    whole = map_batches(single, merge, PARTIAL)
    return whole.drop("salt")


def rules(wrappers: DataFrame) -> DataFrame:
    """host and its rule, as JSON."""

    def decide(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = [json.dumps(rule(json.loads(w), n)) for w, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["host", "rule"])

    return map_arrow(wrappers.select("host", "wrapper", "pages"), decide, "host string, rule string")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    found = stored(rules(infer(pages)), "rules")
    size = found.agg(F.count("*").alias("n"), F.sum(F.length("rule")).alias("chars")).first()
    # Rules are broadcast while they are few and short.
    small = bounded(found, max(size["n"], (size["chars"] or 0) // 100))
    rows = pages.select("page_id", "url", "html", host(F.col("url")).alias("p_host"))
    joined = rows.join(small, F.col("p_host") == F.col("host"), "left").select("page_id", "url", "html", "rule")
    ids = pages.schema["page_id"].dataType.simpleString()
    nothing = {"root": "", "fixed": []}

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, dict] = {None: nothing}
        texts = []
        for page, text in zip(batch.column(2), batch.column(3).to_pylist()):
            if text not in known:
                known[text] = json.loads(text)
            texts.append(extract(page.as_py() or "", known[text]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )

    return map_arrow(joined, run, f"page_id {ids}, url string, text string, n_chars bigint")
