"""Main text of web pages by wrappers, inferred as union-free regular expressions.

The pages of a host come from a few templates. Their token streams are aligned
one after another, level by level of the element tree, with the wrapper built so
far: equal elements match, neighbours that repeat become repeated groups (single
elements or runs of two or three), elements found on some pages only become
optional groups, and texts that differ become text slots, while texts that stay
the same are part of the template if the pages' other texts differ: copies of a
page, also with other scripts or adverts, count once. Tasks build a wrapper per host from their
pages (and so combine before the shuffle); wrappers are merged by the same
alignment, in two steps, so that no task holds more of a host than wrappers.

With the host's wrapper a page is read again: menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles and comments are left out by element
and by class (but not what holds the whole main part, and inside it no heading
or section for its id, no running text around a marked word, and no element
whose class only begins or ends like one, as share-price does). The template's
own texts are left out too; inside the main part only if they are linked or
stand outside paragraphs and headings and are no sentence. Where the host's
wrapper has an article (or main) element, only that is read, by whichever holds
the page's text, else all but lists of links.

Nulls: a null html is an empty text, a null url is a host of its own. A page
without the article that its host has elsewhere is read by what it has itself,
without the template's texts. Elements nested deeper than MAX_DEPTH are read as parts of
the element at that depth. Repeated rows get the same text; an empty table gives
an empty result; other columns are ignored."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from intentlane.llm.common import materialise, table

MAX_DEPTH = 100
TEMPLATE_PAGES = 3     # a text is the template's if it is the same on all of at least so many pages of different texts
HOSTS_PER_FLUSH = 500
_SALTS = 64

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|textarea|iframe|noframes|title|xmp)\b[^>]*>.*?(?:</(?P=raw)[^>]*>|\Z)"
    r"|<[!?][^>]*>?"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>"
    r"|</?[a-zA-Z][^>]*>?", re.S | re.I)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

#: part of the running text around them
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small "
                    "span strike strong sub sup time tt u var wbr br img".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_FLOW = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
_ENDS_P = _FLOW | frozenset("address article aside div dl fieldset figure footer form header hr main nav ol section table ul".split())
_SIBLINGS = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)),
             "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
_SKIPPED = frozenset("nav footer aside form noscript template svg button select option dialog menu head object canvas "
                     "audio video map fieldset input label legend".split())
_SKIPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner promo promotion sponsor sponsored sidebar nav navbar "
    "navigation menu breadcrumb breadcrumbs footer masthead comment comments disqus reply replies respond cookie cookies consent "
    "notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related "
    "recommended recommendations widget widgets toolbar pagination pager tagcloud skip complementary contentinfo search gdpr".split())
#: reader comments: left out wherever they stand
_COMMENT_WORDS = frozenset("comment comments disqus reply replies respond".split())
#: what a class says besides a skipped word without naming something else
_GENERIC = frozenset(
    "a all and bar block blocks body bottom box boxes btn button buttons card cards center col column container content count "
    "cta custom feed footer form group head header heading holder icon icons image img inline inner item items label left line link "
    "links list main media message mobile more new news note of on outer page panel post posts right row section site slot "
    "small stories story sub summary tag tags text this title to tool tools top unit up us view wide with wrap wrapper x".split())
_ANCHORED = frozenset("h1 h2 h3 h4 h5 h6 section".split())
_PAGE_HEADER = frozenset(("header", "banner", "masthead"))
_MAIN_WORDS = frozenset("content article post entry story main".split())
_NEGATING = frozenset("has with no without".split())


# ---------------------------------------------------------------------- pages

class Element:
    __slots__ = ("tag", "key", "kids", "skipped", "marked", "main")

    def __init__(self, tag: str, attrs: str = "", outer: "Element | None" = None):
        words: list[str] = []
        classes: list[str] = []
        names = ""
        inside = outer.main if outer else ""
        anchors = inside and (tag in _ANCHORED or tag in _INLINE)  # their ids are made from headings
        if attrs and ("=" in attrs):
            for kind, *value in _ATTR.findall(attrs):
                text = next((v for v in value if v), "")
                if kind.lower() == "class":
                    names = ".".join(sorted(re.sub(r"\d+", "#", text).split()))
                if kind.lower() != "id" or not anchors:
                    classes += _CAMEL.sub("-", text).lower().split()
                    words += re.split(r"[^a-z0-9]+", _CAMEL.sub("-", text).lower())
        self.tag = tag
        self.key = ("flow" if tag in _FLOW else tag) + ("." + names if names else "")
        self.kids: list[Element | tuple[str, bool]] = []
        marked = {w for before, w in zip([""] + words, words) if before not in _NEGATING}
        by_tag = tag in _SKIPPED or (tag == "header" and not inside)
        #: left out for its class or id alone
        says = marked & _SKIPPED_WORDS
        if says and inside and not says & _COMMENT_WORDS and not _all_generic(classes):
            says = frozenset()      # the class names a thing of its own
        self.marked = not by_tag and tag not in ("html", "body", "main", "article") and (
            (bool(says) and not (inside and says <= _PAGE_HEADER))
            or (bool(marked & _PAGE_HEADER) and not inside))
        self.skipped = by_tag or self.marked
        self.main = inside
        if not self.skipped:
            if tag == "article" or tag == "main" or "main" in words and "role" in attrs:
                if inside in ("article", "main", "both") and inside != tag:
                    self.main = "both"      # the one in the other
                else:
                    self.main = tag if tag in ("article", "main") else "main"
            elif not inside and marked & _MAIN_WORDS and tag not in ("html", "body"):
                self.main = "class"


def _all_generic(classes: list[str]) -> bool:
    """Whether some class with a skipped word says nothing else."""
    for one in classes:
        parts = {w for w in re.split(r"[^a-z]+", one) if w}
        if parts & _SKIPPED_WORDS and parts <= _SKIPPED_WORDS | _GENERIC:
            return True
    return False


def parse(page: str | None) -> Element:
    """The element tree of a page; a text is (text, all of it links)."""
    root = Element("html")
    stack = [root]
    text: list[str] = []
    marks: list[list] = []      # open inline elements with a skipped class: tag, same tags in it, depth of the stack
    plain = False               # some of the text is outside them
    linked = unlinked = False
    in_link = 0
    at = 0
    page = page or ""

    def flush() -> None:
        nonlocal linked, unlinked, plain
        if text:
            whole = " ".join(html.unescape("".join(text)).split())
            if whole and plain:     # a marked element beside plain text is part of it; alone it is left out
                stack[-1].kids.append((whole, linked and not unlinked))
            text.clear()
        linked = unlinked = plain = False

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            piece = page[at:m.start()]
            text.append(piece)
            if not piece.isspace():
                linked, unlinked = linked or in_link > 0, unlinked or in_link == 0
                plain = plain or not marks
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag, closing, attrs = tag.lower(), bool(m["close"]), m["attrs"]
        if tag in _INLINE:
            if tag == "br":
                text.append(" ")
            elif tag == "a":
                in_link = max(0, in_link - 1) if closing else in_link + 1
            if marks and marks[-1][0] == tag and tag not in _VOID:
                marks[-1][1] += -1 if closing else 1
                if marks[-1][1] < 0:
                    marks.pop()
            elif not closing and attrs and tag not in _VOID and _is_skipped(attrs, stack[-1]) \
                    and page.find(f"</{m['tag']}", at) >= 0:
                marks.append([tag, 0, len(stack)])
            continue
        if closing:
            open_ = next((n for n in range(len(stack) - 1, 0, -1) if stack[n].tag == tag), 0)
            if open_ or tag in _ENDS_P:
                flush()
            if open_:
                del stack[open_:]
                while marks and marks[-1][2] > len(stack):      # never closed: no further than what holds it
                    marks.pop()
            continue
        flush()
        in_link = 0 if tag in _ENDS_P else in_link
        if tag in ("html", "body") and len(stack) <= 2:
            if tag == "body":
                del stack[1:]
            continue
        if tag in _ENDS_P and stack[-1].tag == "p":
            stack.pop()
        if tag in _SIBLINGS:
            ends, scope = _SIBLINGS[tag]
            for n in range(len(stack) - 1, 0, -1):
                if stack[n].tag in scope:
                    break
                if stack[n].tag in ends.split():
                    del stack[n:]
                    break
        if tag in _VOID:
            continue
        element = Element(tag, attrs, stack[-1])
        stack[-1].kids.append(element)
        if len(stack) < MAX_DEPTH and not attrs.endswith("/"):
            stack.append(element)
    if at < len(page):
        text.append(page[at:])
        unlinked = plain = True
    flush()
    _uncover_main(root)
    return root


def _is_skipped(attrs: str, outer: Element) -> bool:
    return "=" in attrs and Element("span", attrs, outer).skipped


def _uncover_main(root: Element) -> None:
    """Where the page's main part is only within elements left out for their
    class or id, the outermost one with most text in it is read after all."""
    while True:
        hidden, todo = [], [root]
        while todo:
            x = todo.pop()
            if isinstance(x, tuple):
                continue
            if x.marked and x.skipped:
                hidden.append(x)
            elif not x.skipped:
                if x.main:
                    return
                todo += reversed(x.kids)
        sizes = [_main_size(x) for x in hidden]
        if not any(sizes):
            return
        hidden[sizes.index(max(sizes))].skipped = False


def _main_size(element: Element) -> int:
    """Characters in article and main elements that are not left out by their tag."""
    size, todo = 0, [(element, False)]
    while todo:
        x, inside = todo.pop()
        if isinstance(x, tuple):
            size += len(x[0]) if inside else 0
        elif x.marked or not x.skipped:
            todo += [(kid, inside or x.main in ("article", "main", "both")) for kid in x.kids]
    return size


Group = tuple[str, list]   # key, and the neighbours that share it: elements, texts, or runs (lists of groups)


def folded(kids: list) -> list[Group]:
    """Neighbours of one key are one repeated group, and so are runs of two or three keys that repeat."""
    groups: list[Group] = []
    for kid in kids:
        key = "#text" if isinstance(kid, tuple) else kid.key
        if groups and groups[-1][0] == key:
            groups[-1][1].append(kid)
        else:
            groups.append((key, [kid]))
    for period in (2, 3):
        if len(groups) < 2 * period:
            break
        keys = [k for k, _ in groups]
        out, n = [], 0
        while n < len(groups):
            times = 1
            while keys[n:n + period] == keys[n + times * period:n + (times + 1) * period]:
                times += 1
            if times > 1:
                out.append(("(" + " ".join(keys[n:n + period]) + ")",
                            [groups[n + i * period:n + (i + 1) * period] for i in range(times)]))
                n += times * period
            else:
                out.append(groups[n])
                n += 1
        groups = out
    return groups


def _groups_of(item) -> list[Group]:
    return item if isinstance(item, list) else folded(item.kids)


# -------------------------------------------------------------------- wrappers
# A wrapper node is [key, repeated, optional, pages, text, main, parts, digests]: text is
# the template's text of a text slot, or None where texts differ; main as in Element;
# digests are the lowest TEMPLATE_PAGES digests of the pages with this text slot.

KEY, REPEATED, OPTIONAL, PAGES, TEXT, MAIN, PARTS, DIGESTS = range(8)


def new_wrapper(key: str = "html") -> list:
    return [key, False, False, 0, None, "", [], []]


def digest(page: Element) -> int:
    """Of the texts that are not left out: copies of a page have the same."""
    h = xxhash.xxh64()
    todo: list = [page]
    while todo:
        x = todo.pop()
        if isinstance(x, tuple):
            h.update(x[0].encode("utf-8", "surrogatepass") + b"\n")
        elif not x.skipped:
            todo += reversed(x.kids)
    return h.intdigest()


def _lowest(digests: list[int], others: list[int]) -> list[int]:
    return sorted({*digests, *others})[:TEMPLATE_PAGES]


_PLAIN_CELLS = 2_500        # of a table kept as Python lists
_TABLE_CELLS = 4_000_000    # of a table kept at all; longer lists are cut in halves


def _lengths(a: np.ndarray, b: np.ndarray, keep: bool) -> np.ndarray:
    """Longest common subsequence of every beginning of ``a`` with every
    beginning of ``b`` (all rows, or the last one): a row follows from the one
    before by one running maximum."""
    rows = [np.zeros(len(b) + 1, np.int32)]
    for x in a:
        row = np.zeros(len(b) + 1, np.int32)
        np.maximum.accumulate(np.maximum(rows[-1][1:], rows[-1][:-1] + (b == x)), out=row[1:])
        if keep:
            rows.append(row)
        else:
            rows[0] = row
    return np.stack(rows) if keep else rows[0]


def _matched_long(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """As ``matched``, in memory linear in the lists: tables that would be too
    large are cut where the best halves meet."""
    codes: dict[str, int] = {}
    x, y = (np.array([codes.setdefault(k, len(codes)) for k in keys], np.int32) for keys in (a, b))
    out: list[tuple[int, int]] = []
    todo = [(0, len(x), 0, len(y))]
    while todo:
        i, p, j, q = todo.pop()
        if i == p or j == q:
            continue
        if (p - i) * (q - j) > _TABLE_CELLS and p - i > 1:
            middle = (i + p) // 2
            both = _lengths(x[i:middle], y[j:q], False) + _lengths(x[middle:p][::-1], y[j:q][::-1], False)[::-1]
            cut = j + int(both.argmax())
            todo += [(middle, p, cut, q), (i, middle, j, cut)]
            continue
        best = _lengths(x[i:p][::-1], y[j:q][::-1], True)[::-1, ::-1]
        n, m = i, j
        while n < p and m < q:
            if x[n] == y[m]:
                out.append((n, m))
                n, m = n + 1, m + 1
            elif best[n + 1 - i, m - j] >= best[n - i, m + 1 - j]:
                n += 1
            else:
                m += 1
    return out


def matched(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence of two key lists, as index pairs."""
    n = 0
    while n < len(a) and n < len(b) and a[n] == b[n]:
        n += 1
    head = [(i, i) for i in range(n)]
    a, b = a[n:], b[n:]
    if not a or not b:
        return head
    if len(a) * len(b) > _PLAIN_CELLS:
        return head + [(i + n, j + n) for i, j in _matched_long(a, b)]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            head.append((i + n, j + n))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return head


def _weave(parts: list, others: list, pairs: list[tuple[int, int]], make, join, seen: bool) -> list:
    """Matched parts are joined; what only one side has becomes optional, in its place."""
    out, i, j = [], 0, 0
    for a, b in [*pairs, (len(parts), len(others))]:
        for part in parts[i:a]:
            part[OPTIONAL] = True
            out.append(part)
        for other in others[j:b]:
            part = make(other)
            part[OPTIONAL] = part[OPTIONAL] or seen
            out.append(part)
        if a < len(parts):
            out.append(join(parts[a], others[b]))
        i, j = a + 1, b + 1
    return out


def learn_page(wrapper: list, item, of_page: int | None = None) -> None:
    """Align one element (or run) of a page with its wrapper node, in place."""
    of_page = digest(item) if of_page is None else of_page
    groups = _groups_of(item)
    seen = wrapper[PAGES] > 0
    wrapper[PAGES] += 1

    def join(part: list, group: Group) -> list:
        part[REPEATED] = part[REPEATED] or len(group[1]) > 1
        for x in group[1]:
            if isinstance(x, tuple):
                part[TEXT] = x[0] if part[PAGES] == 0 or part[TEXT] == x[0] else None
                part[PAGES] += 1
                if of_page not in part[DIGESTS]:
                    part[DIGESTS] = _lowest(part[DIGESTS], [of_page])
            else:
                if not isinstance(x, list) and not x.skipped and x.main:
                    part[MAIN] = x.main
                learn_page(part, x, of_page)
        return part

    wrapper[PARTS] = _weave(wrapper[PARTS], groups, matched([p[KEY] for p in wrapper[PARTS]], [g[0] for g in groups]),
                            lambda g: join(new_wrapper(g[0]), g), join, seen)


def merge(a: list, b: list) -> list:
    """Align two wrappers of one host."""
    if not a[PAGES] or not b[PAGES]:
        return a if a[PAGES] else b
    out = [a[KEY], a[REPEATED] or b[REPEATED], a[OPTIONAL] or b[OPTIONAL], a[PAGES] + b[PAGES],
           a[TEXT] if a[TEXT] == b[TEXT] else None, a[MAIN] or b[MAIN], [], _lowest(a[DIGESTS], b[DIGESTS])]
    out[PARTS] = _weave(a[PARTS], b[PARTS], matched([p[KEY] for p in a[PARTS]], [p[KEY] for p in b[PARTS]]),
                        lambda x: x, merge, True)
    return out


def main_kind(wrapper: list) -> str:
    """What the host's pages are read by: article, main, class, or nothing."""
    found, todo = set(), [wrapper]
    while todo:
        node = todo.pop()
        found.add(node[MAIN])
        todo += node[PARTS]
    return next((k for k in ("article", "main", "class") if k in found or (k != "class" and "both" in found)), "")


def read_page(page: Element, wrapper: list | None, kind: str) -> list[str]:
    """The blocks of a page, in order."""
    out: list[str] = []

    def walk(item, node: list | None) -> None:
        groups = _groups_of(item)
        parts = node[PARTS] if node else []
        of = dict((j, parts[i]) for i, j in matched([p[KEY] for p in parts], [g[0] for g in groups])) if parts else {}
        for n, (_, items) in enumerate(groups):
            part = of.get(n)
            for x in items:
                if isinstance(x, tuple):
                    inside = place[-1]
                    if _template(part) and (not inside.main or x[1] or not _running(inside, x[0])):
                        continue
                    if kind and not _within(inside.main, kind):
                        continue
                    if not kind and x[1] and inside.tag in ("li", "ul", "ol", "td", "div", "html"):
                        continue
                    out.append(x[0])
                elif isinstance(x, list):
                    walk(x, part)
                elif not x.skipped:
                    place.append(x)
                    walk(x, part)
                    place.pop()

    place = [page]
    walk(page, wrapper)
    return out


def _within(main: str, kind: str) -> bool:
    return bool(main) if kind == "class" else main in (kind, "both")


def _template(part: list | None) -> bool:
    return part is not None and part[TEXT] is not None and len(part[DIGESTS]) >= TEMPLATE_PAGES


def _running(element: Element, text: str) -> bool:
    """A paragraph's or heading's text, or a sentence: content even if all pages have it."""
    return element.tag in _FLOW or (text[-1] in ".!?:;…。" and text.count(" ") >= 4)


def _held(page: Element) -> dict[str, int]:
    """Characters of the page by the kind of main part that would read them."""
    sizes = dict.fromkeys(("article", "main", "class"), 0)
    todo: list[Element] = [page]
    while todo:
        x = todo.pop()
        for kid in x.kids:
            if isinstance(kid, tuple):
                for kind in sizes:
                    sizes[kind] += len(kid[0]) if _within(x.main, kind) else 0
            elif not kid.skipped:
                todo.append(kid)
    return sizes


def _page_kind(sizes: dict[str, int], wanted: str) -> str:
    """The kind a page is read by: the host's, unless another main part of the
    page holds more than twice the text (an article that is only a teaser)."""
    own = [k for k in ("article", "main", "class") if sizes[k]]
    if not own:
        return ""
    kind = wanted if wanted in own else own[0]
    for other in own:
        if sizes[other] > 2 * sizes[kind]:
            kind = other
    return kind


def main_text(page: str | None, wrapper: list | None) -> str:
    tree = parse(page)
    sizes = _held(tree)
    own = _page_kind(sizes, "")
    kind = _page_kind(sizes, main_kind(wrapper)) if wrapper else own
    blocks = read_page(tree, wrapper, kind)
    if not blocks and kind != own:  # this page lacks what its host's pages have
        blocks = read_page(tree, wrapper, own)
    return "\n".join(blocks)


# ------------------------------------------------------------------------ jobs

def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/?#:]*)", 1)), F.lit(""))


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper as JSON) from (host, html) rows: all pages of every host."""
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.string()), pa.array([json.dumps(w) for w in held.values()], pa.string())],
                names=["host", "wrapper"])
            held.clear()
            return batch

        for batch in batches:
            for host, page in zip(batch["host"], batch["html"]):
                learn_page(held.setdefault(host.as_py(), new_wrapper()), parse(page.as_py()))
                if len(held) >= HOSTS_PER_FLUSH:
                    yield out()
        yield out()

    def merge_all(rows: pa.Table) -> pa.Table:
        merged = new_wrapper()
        for text in sorted(rows["wrapper"].to_pylist()):
            merged = merge(merged, json.loads(text))
        return pa.table({"host": rows["host"].slice(0, 1), "wrapper": pa.array([json.dumps(merged)], pa.string())})

    partial = pages.mapInArrow(learn, "host string, wrapper string").withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(_SALTS)))
    return (partial.groupBy("host", "salt").applyInArrow(merge_all, "host string, wrapper string")
            .groupBy("host").applyInArrow(merge_all, "host string, wrapper string"))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars), one row per page."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"),
                        F.col(html_col).alias("html"))
    wrappers = materialise(infer_wrappers(rows.select("host", "html")), "html-wrappers")
    kind = rows.schema["id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list] = {}
        for batch in batches:
            texts = []
            for page, wrapper in zip(batch["html"], batch["wrapper"]):
                wrapper = wrapper.as_py()
                if wrapper not in known:
                    if len(known) > 200:
                        known.clear()
                    known[wrapper] = json.loads(wrapper)
                texts.append(main_text(page.as_py(), known[wrapper]))
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["id", "url", "text", "n_chars"])

    return (rows.join(wrappers, "host").select("id", "url", "html", "wrapper")
            .mapInArrow(read, f"id {kind}, url string, text string, n_chars bigint")
            .withColumnsRenamed({"id": id_col, "url": url_col}))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))
