"""Main text of web pages by union-free wrapper inference per host.

A page's token stream becomes a tree of block elements and text slots in which
equal neighbours are one repeated group. Trees of one host are aligned one
after another into a wrapper: element against element in order, a part that
only one side has becomes optional, unlike counts become a repeated group, and
unlike texts become a slot, while a text that all pages share stays literal.

A page's text is what the page's own main container holds, without menus, footers,
adverts and the like by their names. An article or main element is kept whole;
in a container found without one, the wrapper's literals are template.

Trees are grouped by shape before they are aligned, and a host's wrappers meet in
rounds of about FAN_IN to a group, so a host with a third of all pages is no single task.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import table
from .url_filter import host_of

# Fixed lists of HTML element names and of class, id and role words.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr html head body meta link base".split()
)
RAW = frozenset("script style textarea title xmp noframes".split())
VOID = frozenset("hr input col area source track param embed keygen".split())
DROPPED = frozenset("script style title textarea noscript template iframe object svg math canvas audio video nav footer aside form button select option dialog menu input label xmp noframes".split())
DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay sidebar comment comments disqus replies respond "
    "share sharing social related newsletter subscribe signup breadcrumb breadcrumbs menu nav navbar navigation pagination footer masthead toolbar widget contentinfo complementary search login".split()
)
#: A compound class or id names an element by its last word before words of place or layout, unless a word says what the element has or lacks.
PLACES = frozenset("area bar block body box buttons col column container content group inner item items left links list outer panel posts articles right row section slot stories top bottom unit wrap wrapper".split())
QUALIFIERS = frozenset("has have no not non with without hide hides show shows is".split())
#: Elements whose id names them; on headings, sections, paragraphs and the like it is the anchor of their subject.
ID_NAMED = frozenset("div ul ol dl table header".split())
MAIN = frozenset("article main".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Texts in these are blocks of a text even if they are links as a whole.
PROSE = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre".split())
#: Blocks of elements below this level hang from their ancestor at it; whether they are dropped or in an article is kept.
MAX_DEPTH = 60
#: A text is a literal of the wrapper if at least so many different pages have it and none has another in its place.
LITERAL_PAGES = 3
#: Wrappers of one host that are merged in one group of a round, about.
FAN_IN = 64
#: Wrappers of this many bytes in all, or fewer, are broadcast; beyond, they are joined.
BROADCAST_BYTES = 16_000_000

_MARK = r"<!--(?:-?>|.*?(?:-->|\Z))|<[!?][^>]*+(?P<mark>>?)"
#: Comments and declarations, and tags; what has no end takes the rest of the page.
_MARKS = re.compile(_MARK, re.S)
_TOKEN = re.compile(_MARK + r"""|<(?P<slash>/?)(?P<tag>[a-zA-Z][^\s/<>"']*+)(?P<attrs>(?:[^>"']|"[^"<]*+"|'[^'<]*+'|["'])*+)(?P<end>>?)""", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_WORD = re.compile("[a-z0-9]+")
_LETTER = re.compile(r"\w")
_HREF = re.compile(r"(?:^|\s)href\s*=", re.I)

# A tree node is [label, dropped, children, texts]; label "#" is a text slot, whose texts are the strings of its places, each
# with whether it is more than links.
# A child that stands for several equal neighbours keeps all their texts in the order of the page.


def _names(token: str) -> bool:
    """Whether a class, id or role says that its element is no part of a text."""
    words = _WORD.findall(token)
    if not QUALIFIERS.isdisjoint(words):
        return False
    while len(words) > 1 and (words[-1] in PLACES or words[-1].isdigit()):
        words.pop()
    return bool(words) and words[-1] in DROPPED_WORDS


def _label(tag: str, attrs: str) -> tuple[str, bool, bool]:
    """Label of an element (its name and its first class), whether its kind marks it as no part of a text, and whether a word does."""
    named = False
    first = ""
    name = tag
    for m in _ATTRIBUTE.finditer(attrs):
        value = html.unescape(m[2] or m[3] or m[4] or "").lower()
        named = named or ((m[1].lower() != "id" or tag in ID_NAMED) and any(map(_names, value.split())))
        if m[1].lower() == "class" and value.split():
            first = "." + re.sub(r"\d+", "0", value.split()[0])
        if m[1].lower() == "role" and value == "main":
            name = "main"
    return name + first, tag in DROPPED or bool(attrs and _HIDDEN.search(attrs)), named


def parse(page: str) -> list:
    """The tree of a page. Unclosed elements end where HTML lets them; unmatched ends are ignored.

    A word never drops an article or main element or what holds one, but it does drop parts of an article. Articles that a
    word names (comments, say) save what holds them only on pages without any other. Each text below MAX_DEPTH levels
    is a block of its own under the ancestor at that level: dropped if any element around it is, and an article's if it is in one.
    """
    root: list = ["", False, [], []]
    stack, tags, by_word, run = [root], [""], [False], []
    count: dict[str, int] = {"": 1}
    known: dict[tuple[str, str], tuple[str, bool, bool]] = {}
    saved: dict[bool, list[list]] = {}
    done = [0, 0]  # how many open elements have been looked through for `saved`
    deep: list[tuple[list, list]] = []  # (element, its parent) of those below MAX_DEPTH, parents first
    blocks: list[tuple[list, list]] = []  # (block of the tree, the deep element it is in)
    linked = plain = False

    def take(text: str) -> None:
        nonlocal plain
        run.append(text)
        plain = plain or not linked and _LETTER.search(html.unescape(text)) is not None

    def flush() -> None:
        nonlocal linked, plain
        text, prose = "".join(run), plain or tags[-1] in PROSE
        run.clear()
        linked = plain = False
        if text and not text.isspace():
            text = " ".join(html.unescape(text).split())
            if text:
                slot = ["#", False, [], [(text, prose)]]
                if len(stack) > MAX_DEPTH:
                    block = ["~", False, [slot], []]
                    blocks.append((block, stack[-1]))
                    stack[MAX_DEPTH - 1][2].append(block)
                else:
                    stack[-1][2].append(slot)

    def close(tag: str) -> None:
        """Ends the innermost element of this name and what is in it."""
        nonlocal words
        flush()
        while True:
            last = tags.pop()
            stack.pop()
            words -= by_word.pop()
            count[last] -= 1
            if last == tag:
                done[:] = (min(n, len(tags)) for n in done)
                return

    at = start = words = 0  # words: how many of by_word are set
    token = _TOKEN
    while (m := token.search(page, start)) is not None:
        if m["mark"] == "":  # no > follows: all is text but a comment, which takes the rest
            start = page.find("<!--", m.start())
            take(page[at:start] if start >= 0 else page[at:])
            at = len(page)
            break
        tag = m["tag"] if token is _TOKEN else None
        if tag is not None and not m["end"]:  # a tag without an end is text, and no tag in it has one, as quotes never hold a <
            token, start = _MARKS, m.start() + 1
            continue
        take(page[at : m.start()])
        at = start = m.end()
        if tag is None:
            continue
        tag, attrs = tag.lower(), m["attrs"]
        if m["slash"]:
            if tag in INLINE:
                if tag == "body":
                    flush()
                elif tag == "a":
                    linked = False
            elif count.get(tag):
                close(tag)
            elif tag == "p":
                flush()
            continue
        if tag in RAW:
            shut = re.compile(f"</{tag}", re.I).search(page, at)
            last = page.find(">", shut.start()) if shut else -1
            at = start = last + 1 if last >= 0 else len(page)
            continue
        if tag in INLINE:
            if tag == "br":
                run.append(" ")
            elif tag == "body":
                flush()
            elif tag == "a":
                linked = _HREF.search(attrs) is not None
            continue
        flush()
        if tag in CLOSES_P and count.get("p"):
            close("p")
        for other in SIBLINGS.get(tag, ()):
            if tags[-1] == other:
                close(other)
        if tag in VOID:
            continue
        key = (tag, attrs)
        if key not in known:
            known[key] = _label(*key)
        label, dropped, named = known[key]
        if tag == "header":
            dropped = dropped or not any(count.get(t) for t in MAIN)
        is_main = label.split(".")[0] in MAIN
        if is_main and not dropped:
            inner = len(tags)
            while inner > done[named] and words and tags[inner - 1] != "article":
                inner -= 1
            saved.setdefault(named, []).extend(n for n, w in zip(stack[inner:], by_word[inner:]) if w)
            done[named] = len(tags)
        by_word.append(named and not dropped and not is_main)
        words += by_word[-1]
        node = [label, dropped or by_word[-1], [], []]
        if len(stack) < MAX_DEPTH:
            stack[-1][2].append(node)
        else:
            deep.append((node, stack[-1]))
        stack.append(node)
        tags.append(tag)
        count[tag] = count.get(tag, 0) + 1
    take(page[at:])
    flush()
    for n in saved.get(False, saved.get(True, [])):
        n[1] = False
    state: dict[int, tuple[bool, bool]] = {}  # of deep elements: dropped, in an article
    for node, parent in deep:
        dropped, article = state.get(id(parent), (False, False))
        state[id(node)] = dropped or node[1], article or not dropped and not node[1] and node[0].split(".")[0] in MAIN
    for block, element in blocks:
        block[1], article = state[id(element)]
        block[0] = "article" if article else "~"
    return root


def shape(node: list) -> str:
    """Shape of a tree whose repeats are grouped: labels in brackets, + after a repeated group."""
    return node[0] + ("!" if node[1] else "") + ("(" + ",".join(c[4] + ("+" if c[5] else "") for c in node[2]) + ")" if node[2] else "")


def _slots(node: list) -> list[list]:
    """The text slots below a node, in order."""
    if node[0] == "#":
        return [node]
    return [s for c in node[2] for s in _slots(c)]


def group(node: list) -> list:
    """Groups equal neighbours, and equal pairs of neighbours, of every element into one that repeats. Adds shape and repeat flag to each node."""
    done: list[list] = []
    for c in node[2]:
        c = group(c)
        done.append(c)
        for size in (1, 2):
            if len(done) >= 2 * size and all(done[-size + k][4] == done[-2 * size + k][4] and done[-size + k][4] != "#" for k in range(size)):
                for k in range(size):
                    old, new = done[-2 * size + k], done[-size + k]
                    for a, b in zip(_slots(old), _slots(new)):
                        a[3] += b[3]
                    old[5] = True
                del done[-size:]
                break
    node = [node[0], node[1], done, node[3], "", False]
    node[4] = shape(node)
    return node


# A wrapper node is {l: label, c: children, o: optional, r: repeated}; a slot has h: hash of its one text or null if
# texts differ, p: up to LITERAL_PAGES hashes of pages that have it, a: whether any of its texts is more than links.


def first_wrapper(node: list, page: int) -> dict:
    """The wrapper of one page."""
    if node[0] == "#":
        hashes = {zlib.crc32(t.encode("utf-8", "surrogatepass")) for t, _ in node[3]}
        return {"l": "#", "o": False, "r": False, "h": hashes.pop() if len(hashes) == 1 else None, "p": [page], "a": any(a for _, a in node[3])}
    return {"l": node[0], "o": False, "r": node[5], "c": [first_wrapper(c, page) for c in node[2]]}


def _aligned(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of equal labels in the order of both lists, in time n log n: common ends first; between them the k-th of a label meets the k-th, as many as go in order."""
    lo = 0
    while lo < len(a) and lo < len(b) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < len(a) - lo and hi < len(b) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    places: dict[str, list[int]] = {}
    for j in range(lo, len(b) - hi):
        places.setdefault(b[j], []).append(j)
    taken: dict[str, int] = {}
    tops: list[int] = []  # least end of an increasing run of each length, with the pair it ends with
    ends: list[tuple[int, int, int]] = []  # (i, j, index of the pair before)
    last: list[int] = []
    for i in range(lo, len(a) - hi):
        k = taken.get(a[i], 0)
        taken[a[i]] = k + 1
        js = places.get(a[i], ())
        if k < len(js):
            at = bisect_left(tops, js[k])
            ends.append((i, js[k], last[at - 1] if at else -1))
            if at == len(tops):
                tops.append(js[k])
                last.append(len(ends) - 1)
            else:
                tops[at], last[at] = js[k], len(ends) - 1
    middle: list[tuple[int, int]] = []
    at = last[-1] if last else -1
    while at >= 0:
        i, j, at = ends[at]
        middle.append((i, j))
    return [(k, k) for k in range(lo)] + middle[::-1] + [(len(a) - hi + k, len(b) - hi + k) for k in range(hi)]


def merge(a: dict, b: dict) -> dict:
    """Aligns two wrappers with the same label."""
    if a["l"] == "#":
        pages = sorted({*a["p"], *b["p"]})[:LITERAL_PAGES]
        return {"l": "#", "o": a["o"] or b["o"], "r": a["r"] or b["r"], "h": a["h"] if a["h"] == b["h"] else None, "p": pages, "a": a["a"] or b["a"]}
    out, i, j = [], 0, 0
    optional = lambda n: n | {"o": True}
    for x, y in [*_aligned([n["l"] for n in a["c"]], [n["l"] for n in b["c"]]), (len(a["c"]), len(b["c"]))]:
        out += [optional(n) for n in a["c"][i:x]] + [optional(n) for n in b["c"][j:y]]
        if x < len(a["c"]):
            out.append(merge(a["c"][x], b["c"][y]))
        i, j = x + 1, y + 1
    folded: list[dict] = []
    for n in out:  # neighbours of one label where one is optional are a repeated group
        if folded and n["l"] != "#" and folded[-1]["l"] == n["l"] and (n["o"] or folded[-1]["o"]):
            both = folded[-1]["o"] and n["o"]
            folded[-1] = merge(folded[-1], n) | {"r": True, "o": both}
        else:
            folded.append(n)
    return {"l": a["l"], "o": a["o"] or b["o"], "r": a["r"] or b["r"], "c": folded}


def _literal(slot: dict) -> bool:
    return slot["h"] is not None and len(slot["p"]) >= LITERAL_PAGES


def mark(w: dict) -> dict:
    """Adds k: no literal, to every slot."""
    if w["l"] == "#":
        w["k"] = not _literal(w)
    else:
        for c in w["c"]:
            mark(c)
    return w


def apply(wrapper: dict, node: list) -> list[dict | None]:
    """The wrapper's slots of a grouped page's text slots, slot by slot in the page's order; None where it has none."""
    if node[0] == "#":
        return [wrapper]
    match = dict((y, x) for x, y in _aligned([c["l"] for c in wrapper["c"]], [c[0] for c in node[2]]))
    first: dict[str, dict] = {}
    for w in wrapper["c"]:
        first.setdefault(w["l"], w)
    out: list[dict | None] = []
    for y, c in enumerate(node[2]):
        if y in match:
            out += apply(wrapper["c"][match[y]], c)
        else:  # a repeated group of the wrapper takes further neighbours of its label
            out += apply(first[c[0]], c) if c[0] in first else [None] * len(_slots(c))
    return out


def _mains(node: list) -> list[list]:
    """The outermost article and main elements of a page that are not dropped and have text."""
    if node[0] == "#" or node[1]:
        return []
    if node[0].split(".")[0] in MAIN:
        return [node] if any(_live(node)) else []
    return [x for c in node[2] for x in _mains(c)]


def _live(node: list, live: bool = True) -> list[bool]:
    """Which text slots below a node are in no dropped element, in order."""
    if node[0] == "#":
        return [live]
    live = live and not node[1]
    return [x for c in node[2] for x in _live(c, live)]


def kept(wrapper: dict, node: list) -> list[bool]:
    """Which text slots of a grouped page are its text, in order.

    The container is the page's own article or main element, kept whole. Without one it is the lowest element that holds
    all blocks that are not dropped, no literals and not links only; literals are left out of it.
    """
    live = _live(node)
    at_slot = {id(s): k for k, s in enumerate(_slots(node))}
    places = lambda n: {at_slot[id(s)] for s in _slots(n)}
    mains = _mains(node)
    if not mains:
        own = apply(wrapper, node)
        live = [x and (w is None or w["k"]) for x, w in zip(live, own)]
        free = {k for k, x in enumerate(live) if x}
        blocks = {k for k in free if own[k] is None or own[k]["a"]} or free
        at: list | None = node
        while at:
            mains = [at]
            at = next((c for c in at[2] if blocks and blocks <= places(c)), None)
    inside = {k for n in mains for k in places(n)}
    return [x and k in inside for k, x in enumerate(live)]


def text_of(page: str | None, wrapper: dict, memo: dict[tuple, list[bool]], host: str) -> str:
    """The kept blocks of a page in its order, joined by blank lines."""
    tree = parse(page or "")
    flat: list[list] = []

    def number(n: list) -> None:
        if n[0] == "#":
            n[3] = [(len(flat), n[3][0][0])]
            flat.append(n)
        for c in n[2]:
            number(c)

    number(tree)
    grouped = group(tree)
    key = (host, grouped[4])
    if key not in memo:
        if len(memo) > 5000:
            memo.clear()
        memo[key] = kept(wrapper, grouped)
    places = sorted(p for slot, k in zip(_slots(grouped), memo[key]) if k for p in slot[3])
    return "\n\n".join(t for _, t in places)


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, shape, wrapper) of every batch: one row for each host and shape in it."""
    for batch in batches:
        held: dict[tuple[str, str], dict] = {}
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            if page:
                node = group(parse(page))
                w = first_wrapper(node, zlib.crc32(page.encode("utf-8", "surrogatepass")))
                key = (host, node[4])
                held[key] = merge(held[key], w) if key in held else w
        yield _wrapper_rows((h, s, w) for (h, s), w in held.items())


def _wrapper_rows(rows) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [(), (), ()]
    return pa.record_batch({"host": pa.array(cols[0], pa.string()), "shape": pa.array(cols[1], pa.string()), "w": pa.array([json.dumps(w) for w in cols[2]], pa.string())})


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges runs of rows with equal host and group, in the order of their shapes; the first shape names the result."""
    held: tuple | None = None
    row: tuple | None = None
    for batch in batches:
        for host, part, s, w in zip(*(batch.column(c).to_pylist() for c in ("host", "part", "shape", "w"))):
            key, w = (host, part), json.loads(w)
            if key == held:
                row = (host, row[1], merge(row[2], w))
            else:
                if row:
                    yield _wrapper_rows([row])
                held, row = key, (host, s, w)
    if row:
        yield _wrapper_rows([row])


_WRAPPERS = "host string, shape string, w string"


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """(host, w): each host's wrapper, from columns host and html of all pages. Each round merges a host's wrappers in groups of about FAN_IN."""
    rows = pages.select("host", "html").mapInArrow(_shapes, _WRAPPERS).withColumn("part", F.xxhash64("shape"))
    while True:
        # equal shapes first, then groups by a hash of the shape
        dealt = rows.repartition("host", "part").sortWithinPartitions("host", "part", "shape", "w")
        rows = table(dealt.mapInArrow(_folded, _WRAPPERS), "wrappers")
        most = rows.groupBy("host").count().agg(F.max("count")).first()[0] or 0
        if most <= 1:
            return rows.select("host", "w")
        groups = -(-most // FAN_IN) if most > FAN_IN else 1
        rows = rows.withColumn("part", F.pmod(F.xxhash64("shape", F.lit(groups)), F.lit(groups)))


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo: dict[tuple, list[bool]] = {}
    marked: dict[str, dict] = {}
    for batch in batches:
        texts = []
        for host, page, w in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "w"))):
            if not page or w is None:
                texts.append("")
                continue
            if host not in marked:
                if len(marked) > 500:
                    marked.clear()
                marked[host] = mark(json.loads(w))
            texts.append(text_of(page, marked[host], memo, host))
        yield pa.record_batch({c: batch.column(c) for c in batch.schema.names if c not in ("html", "w", "host")} | {"text": pa.array(texts, pa.string())})


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages.

    Null and empty pages, and pages without text of their own, have an empty
    text. A null or malformed url counts as one host of its own, "". Repeated
    rows are each extracted; copies of a page do not make its texts literals,
    and no text of an article or main element is left out for being a literal.
    Other columns are not read.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), host_of(F.col(url)).alias("host"), F.col(page).alias("html"))
    wrappers = infer_wrappers(rows)
    size = wrappers.agg(F.sum(F.octet_length("w"))).first()[0] or 0
    joined = rows.join(F.broadcast(wrappers) if size <= BROADCAST_BYTES else wrappers, "host", "left")
    kinds = f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string"
    return joined.mapInArrow(_extracted, kinds).withColumn("n_chars", F.char_length("text").cast("long"))
