"""HTML extraction by wrappers: union-free regular expressions over the token streams of a host's pages.

A page's tags are a balanced stream, read level by level. Two streams are aligned by their elements' labels
and names (class and id without tokens with digits), with texts that both have as anchors. Where the numbers of
equal neighbours differ they become a repeated group, what only one stream has becomes
optional, and text becomes a constant while all pages agree on it and a slot from the first that
does not. A text that only one page or equal pages have stays apart from
slots while ``SHARE`` of the pages have it. The result is
again such an expression, so wrappers merge in any order: each
task folds its pages by host, partial wrappers meet by (host, salt) and then by host, and no task sees
more than partial wrappers of a host. Neighbouring optional elements of equal label and name, and of
equal label if fewer than ``SHARE`` of the pages have them, become one repeated element, so a level does not grow with the host.

The wrapper then says which slots hold the article: below its ``article`` or ``main`` element, without the blocks that are constant
on ``MAJOR`` of the host's pages (headings stay), else below the lowest element with most of the text that varies, without constants and
lists of links. Pages are joined with their host's wrapper and read once more.

A level of two pages is aligned in a table of at most ``TABLE`` cells: longer ones are cut where a text that each has once is in
both, and what is longer still in proportion, so the work grows with a page's length and not with its square.
"""

from __future__ import annotations

import html as entities
import json
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from zlib import crc32

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from daygrain.llm.common import as_table, ascii_lower, fresh

# Elements without content of their own, elements inside a line, and what is never article text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small "
                   "span strike strong sub sup time tt u var".split())
RAW = frozenset("script style textarea title noscript template iframe svg math canvas object select button audio video xmp".split())
NEVER = frozenset("head nav footer aside".split())
SELDOM = frozenset("form dialog menu fieldset".split())  # as NAMED: only without most of the text
WHOLE = frozenset("html body article main".split())  # their classes tell of the page, not of them
NAMED = frozenset("ad ads advert advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice "
                  "alert popup modal overlay newsletter subscribe subscription signup login sidebar menu nav navbar navigation breadcrumb "
                  "breadcrumbs pagination pager footer comment comments reply replies disqus respond share sharing social related "
                  "recommended widget toolbar search masthead copyright complementary contentinfo dialog".split())
CONTENT = frozenset("articlebody main".split())
PLAIN = frozenset("site page section area block box container wrapper wrap inner list item items left right top bottom bar".split())
_TALK = frozenset("comment comments reply replies disqus respond".split())
#: Which elements an opening tag closes if they are open (HTML's optional end tags).
CLOSES = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
_ENDS_P = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                    "header hr main menu nav ol p pre section table ul li".split())
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"""
                    r"""|<([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>|<([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_WORD = re.compile(r"[a-z]+")
SALTS = 64
HOSTS_AT_ONCE = 1000
COPIES_KNOWN = 200_000  # page hashes that a task remembers
SHARE = 0.1
COMMON = 0.2  # a text that this share of a host's pages has is none of their own
MAJOR = 0.5  # nor is one below an article or main element that this share has
TABLE = 1 << 18  # cells of one alignment; longer levels are cut at their anchors, or else in proportion
DEEPEST = 100  # elements below this depth only part blocks, but for the outermost that decide what is article text


def name_of(tag: str, attributes: str) -> str:
    """Class and id, without tokens that may differ from page to page by a number."""
    if tag in WHOLE or "=" not in attributes:
        return ""
    return " ".join(sorted({"#" * (m[1].lower() == "id") + t for m in _ATTRIBUTE.finditer(attributes) if m[1].lower() in ("class", "id")
                            for t in (m[2] or m[3] or m[4] or "").split() if not any(map(str.isdigit, t))}))


def label_of(tag: str, attributes: str) -> str:
    """The tag with the known words of its class, id, role and itemprop.

    A token counts if all its words are known: ``site-footer`` and ``cookie-notice`` do, ``no-sidebar`` does not.
    """
    if "=" not in attributes:
        return tag
    known = CONTENT if tag in WHOLE else NAMED | CONTENT
    words: set[str] = set()
    for m in _ATTRIBUTE.finditer(attributes):
        for token in (m[2] or m[3] or m[4] or "").lower().split():
            parts = set(_WORD.findall(token))
            if parts <= known | PLAIN:
                words |= parts & known
    return ".".join([tag, *sorted(words)])


def events(page: str) -> Iterator[tuple]:
    """("open", label, name) / ("close", tag) of block elements and ("text", string, in a link), balanced."""
    stack: list[tuple] = []  # open block tags; what each decides, None if it only parts blocks
    known: Counter = Counter()  # how many of each tag are open
    deciding: set[str] = set()  # below the depth limit
    links = at = levels = 0

    def end() -> tuple:
        nonlocal levels
        top, decides = stack.pop()
        known[top] -= 1
        if decides is None:
            return "text", " ", False
        levels -= 1
        deciding.discard(decides)
        return "close", top

    for m in _TOKEN.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at:
            yield "text", page[at:m.start()], links > 0
        at = m.end()
        close, tag, attributes = m[1], m[2] or m[4], m[3] or m[5] or ""
        if close:
            close = close.lower()
            if close == "a":
                links = max(0, links - 1)
            elif close == "br" or close == "p" and not known["p"]:
                yield "text", " ", False
            elif known[close]:
                while True:
                    top = stack[-1][0]
                    yield end()
                    if top == close:
                        break
        elif tag:
            tag = tag.lower()
            if tag in RAW:
                if not attributes.endswith("/"):
                    raw_end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                    at = raw_end.end() if raw_end else len(page)
                yield "text", " ", False
            elif tag in VOID:
                yield "text", "" if tag == "wbr" else " ", False
            elif tag == "a":
                links += 1
            elif tag not in INLINE:
                closes = CLOSES.get(tag, "").split()
                if tag in _ENDS_P:
                    closes.append("p")
                while stack and stack[-1][0] in closes:
                    yield end()
                links = 0
                label, decides = label_of(tag, attributes), ""
                if levels >= DEEPEST:
                    decides = "never" if tag in NEVER else "named" if _excluded(label) else "article" if tag == "article" else "root" if _is_root(label) else None
                    if decides in deciding:
                        decides = None
                known[tag] += 1
                stack.append((tag, decides))
                if decides is None:
                    yield "text", " ", False
                    continue
                levels += 1
                if decides:
                    deciding.add(decides)
                yield "open", label, name_of(tag, attributes)
        elif page.startswith("<![CDATA[", m.start()):
            yield "text", " ", False
    if at < len(page):
        yield "text", page[at:], False
    while stack:
        yield end()


# -- wrappers: nodes [label, children, text, chars, link chars, optional, repeated, pages, name, text of all below] ----
LABEL, CHILDREN, TEXT, CHARS, LINKED, OPTIONAL, REPEATED, PAGES, NAME, DEEP = range(10)


def page_wrapper(page: str) -> list:
    """The expression of one page."""
    root = ["", [], "", 0, 0, False, False, 1, "", ""]
    stack, texts = [root], [[]]
    for kind, *rest in events(page):
        if kind == "open":
            node = [rest[0], [], "", 0, 0, False, False, 1, rest[1], ""]
            stack[-1][CHILDREN].append(node)
            stack.append(node)
            texts.append([])
        elif kind == "close":
            _finish(stack.pop(), texts.pop())
        else:
            texts[-1].append(rest)
    _finish(root, texts.pop())
    return root


def _finish(node: list, texts: list) -> None:
    for text, linked in texts:
        n = len(text.strip())
        node[CHARS] += n
        node[LINKED] += n * linked
    node[TEXT] = _constant([t for t, _ in texts])
    node[DEEP] = _below(node[TEXT], [x[DEEP] for x in node[CHILDREN]])


def _constant(texts: list[str]) -> str:
    text = " ".join(" ".join(texts).split())
    return "=%08x" % crc32(text.encode("utf-8", "surrogatepass")) if text else ""


def _below(own: str, children: list[str]) -> str:
    said = [x for x in children if x]
    return "=%08x" % crc32(" ".join([own, *said]).encode()) if said else own


def _sum(a: list, b: list, most: int | None = None) -> list:
    """The expression that covers both nodes, of different pages or of at most ``most`` pages; they have the same label."""
    pages = a[PAGES] + b[PAGES] if most is None else min(most, a[PAGES] + b[PAGES])
    return [a[LABEL], align(a[CHILDREN], b[CHILDREN], pages), a[TEXT] if a[TEXT] == b[TEXT] else "*", a[CHARS] + b[CHARS],
            a[LINKED] + b[LINKED], a[OPTIONAL] or b[OPTIONAL], a[REPEATED] or b[REPEATED], pages,
            a[NAME] if a[NAME] == b[NAME] else "*", a[DEEP] if a[DEEP] == b[DEEP] else "*"]


def _group(items: list, pages: int) -> list:
    """One repeated node for neighbours of the same label."""
    out = items[0]
    for x in items[1:]:
        out = _sum(out, x, pages)
    if len(items) > 1:
        out[REPEATED] = True
    return out


def _optional(x: list) -> list:
    return [*x[:OPTIONAL], True, *x[REPEATED:]]


def _same(x: list, pages: int, least: int = 1) -> bool:
    """Whether the text of the node and of all below is one text so far, on a share of all pages."""
    return x[DEEP].startswith("=") and x[PAGES] >= max(least, SHARE * pages)


def _runs(items: list) -> list[list]:
    out: list[list] = []
    for x in items:
        if out and (out[-1][0][LABEL], out[-1][0][NAME]) == (x[LABEL], x[NAME]):
            out[-1].append(x)
        else:
            out.append([x])
    return out


def align(a: list, b: list, pages: int) -> list:
    """One level of two expressions that together are of ``pages`` pages.

    Runs of elements of equal label and name are aligned, those with a text in common first; what is left is optional.
    """
    if not a or not b:
        return settle([_optional(x) for x in a or b], pages)
    return settle(_align_runs(_runs(a), _runs(b), pages), pages)


def _anchors(a: list, b: list) -> list[tuple[int, int]]:
    """Places (in a, in b) of the keys that each side has once, in an order that both keep (the longest such run); None is no key."""
    once = [{k: i for k, i in zip(x, range(len(x))) if n[k] == 1} for x in (a, b) for n in (Counter(x),)]
    pairs = [(i, once[1][k]) for k, i in once[0].items() if k is not None and k in once[1]]
    tails: list[int] = []  # of increasing runs, by length: the least last place in b
    at: list[int] = []
    back: list[int] = []
    for n, (_, j) in enumerate(pairs):
        k = bisect_left(tails, j)
        tails[k:k + 1] = [j]
        at[k:k + 1] = [n]
        back.append(at[k - 1] if k else -1)
    out, n = [], at[-1] if at else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def _cuts(n: int, k: int, anchors: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Places (in the first, in the second level) at which a pair of levels of ``n`` and ``k`` parts is cut into small tables."""
    out = [(0, 0)]
    for i, j in [*anchors, (n, k)]:
        x, y = out[-1]
        if (i - x) * (j - y) <= TABLE and (i, j) != (n, k):
            if (i - x + 1) * (j - y + 1) <= TABLE // 8:
                continue  # several anchors to a table
        pieces = max(1, math.isqrt(max(0, (i - x) * (j - y) - 1) // TABLE) + 1) if (i - x) * (j - y) > TABLE else 1
        out += [(x + (i - x) * p // pieces, y + (j - y) * p // pieces) for p in range(1, pieces + 1)]
    return out


def _align_runs(left: list, right: list, pages: int) -> list:
    """Two levels as runs; what fits is summed, what is left is optional."""
    if not left or not right:
        return [_optional(x) for r in left or right for x in r]
    keys = [[(r[0][LABEL], r[0][NAME]) for r in x] for x in (left, right)]
    if keys[0] == keys[1] and len(set(keys[0])) == len(keys[0]):
        return [y for r, t in zip(left, right) for y in _align_run(r, t, pages)]
    if len(left) * len(right) > TABLE:
        whole = [[(*k, r[0][DEEP]) if len(r) == 1 and r[0][DEEP].startswith("=") else None for k, r in zip(ks, side)]
                 for ks, side in zip(keys, (left, right))]
        cuts = _cuts(len(left), len(right), _anchors(*whole))
        return [y for (i, j), (x, z) in zip(cuts, cuts[1:]) for y in _align_runs(left[i:x], right[j:z], pages)]
    said = [[{x[DEEP] for x in r if x[DEEP].startswith("=")} for r in x] for x in (left, right)]

    def worth(i: int, j: int) -> int:
        (label, name), (other, its) = keys[0][i], keys[1][j]
        if label != other or name != its and "*" not in (name, its):
            return 0
        return 1 + (name == its) + 3 * (not said[0][i].isdisjoint(said[1][j]))

    n, k = len(left), len(right)
    best = [[0] * (k + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        here, below = best[i], best[i + 1]
        for j in range(k - 1, -1, -1):
            w = worth(i, j) if keys[0][i][0] == keys[1][j][0] else 0
            here[j] = max(below[j], here[j + 1], below[j + 1] + w if w else 0)
    out, i, j = [], 0, 0
    while i < n or j < k:
        w = worth(i, j) if i < n and j < k else 0
        if w and best[i][j] == best[i + 1][j + 1] + w:
            out += _align_run(left[i], right[j], pages)
            i, j = i + 1, j + 1
        elif j == k or i < n and best[i + 1][j] >= best[i][j + 1]:
            out += map(_optional, left[i])
            i += 1
        else:
            out += map(_optional, right[j])
            j += 1
    return out


def _align_run(a: list, b: list, pages: int) -> list:
    """Two runs of equal elements: texts that both have are anchors; between them, a mismatch in number is a repetition."""
    if len(a) == len(b) == 1:
        return [_sum(a[0], b[0])]
    if len(a) * len(b) > TABLE:
        cuts = _cuts(len(a), len(b), _anchors(*[[x[DEEP] if x[DEEP].startswith("=") else None for x in run] for run in (a, b)]))
        return [y for (i, j), (x, z) in zip(cuts, cuts[1:]) for y in (_align_run(a[i:x], b[j:z], pages) if i < x and j < z else
                                                                      map(_optional, a[i:x] or b[j:z]))]
    texts = [[x[DEEP] if x[DEEP].startswith("=") else (side, i) for i, x in enumerate(run)] for side, run in enumerate((a, b))]
    out, i, j = [], 0, 0
    for m in SequenceMatcher(None, *texts, autojunk=False).get_matching_blocks():
        out += _between(a[i:m.a], b[j:m.b], pages)
        out += [_sum(x, y) for x, y in zip(a[m.a:m.a + m.size], b[m.b:m.b + m.size])]
        i, j = m.a + m.size, m.b + m.size
    return out


def _between(a: list, b: list, pages: int) -> list:
    """Neighbours without a text in common; what several pages have stays apart.

    Of the longer side, those join the shorter that have or lack elements as it does and whose text varies.
    """
    rest = [[x for x in side if not _same(x, pages, 3)] for side in (a, b)]
    short, long = sorted(rest, key=len)
    kinds = {bool(x[CHILDREN]) for x in short}
    fit = sorted(long, key=lambda x: (bool(x[CHILDREN]) not in kinds, x[DEEP] != "*"))[:len(short)]
    chosen = {id(x) for x in fit}
    partner = {id(y): x for x, y in zip(short, (y for y in long if id(y) in chosen))}
    order, other = (a, b) if long is rest[0] else (b, a)
    fixed = [i for i, x in enumerate(other) if _same(x, pages, 3)]
    first = next((i for i in range(len(other)) if i not in fixed), 0)
    return [*(_optional(other[i]) for i in fixed if i < first),
            *(_sum(partner[id(x)], x) if id(x) in partner else _optional(x) for x in order),
            *(_optional(other[i]) for i in fixed if i >= first)]


def settle(items: list, pages: int) -> list:
    """Optional neighbours of equal role, in whatever order, and neighbouring paragraphs that vary become repeated.

    Their role is equal if label and name are, or the label and neither is on ``SHARE`` of the pages.
    """
    out: list[list] = []  # groups
    at: dict = {}
    for x in items:
        if _same(x, pages):
            if not x[OPTIONAL]:
                at = {}
            out.append([x])
            continue
        if not x[OPTIONAL]:
            last = out[-1][-1] if out else None
            if (last and x[LABEL].split(".")[0] in ("p", "li") and x[TEXT] == last[TEXT] == "*" and not x[CHILDREN] and not last[CHILDREN]
                    and (x[LABEL], x[NAME]) == (last[LABEL], last[NAME])):
                out[-1].append(x)
            else:
                at = {}
                out.append([x])
            continue
        key = x[LABEL] if x[PAGES] < SHARE * pages else (x[LABEL], x[NAME])
        if key in at:
            at[key].append(x)
        else:
            at[key] = [x]
            out.append(at[key])
    return [_group(g, pages) if len(g) > 1 else g[0] for g in out]


def expression(node: list) -> str:
    """The wrapper as text, for reading: <label ...>, #text for a slot, ( )? and ( )+."""
    inner = ("#text " if node[TEXT] == "*" else "'' " if node[TEXT] else "") + " ".join(expression(x) for x in node[CHILDREN])
    said = f"<{node[LABEL]} {inner.strip()}>" if node[LABEL] else inner
    return f"({said})" + "+" * node[REPEATED] + "?" * node[OPTIONAL] if node[REPEATED] or node[OPTIONAL] else said


# -- what is article text --------------------------------------------------------------------------------------------
def _excluded(label: str) -> bool:
    tag, *words = label.split(".")
    return tag in NEVER or tag in SELDOM or bool(NAMED.intersection(words))


def _spared(root: list, constants: bool) -> set[int]:
    """The elements excluded by a word or as a form that hold most of the text of the pages they are on.

    Readers' words often outweigh an article: an element named after them is spared only if it holds all but a rest.
    """
    mass = _weigh(root, constants, None)
    out: set[int] = set()

    def visit(x: list) -> None:
        tag, *words = x[LABEL].split(".")
        if tag not in NEVER and _excluded(x[LABEL]):
            share = 0.95 if _TALK.intersection(words) else 0.8
            if mass.get(id(x), 0) * root[PAGES] > share * mass[id(root)] * x[PAGES]:
                out.add(id(x))
        for y in x[CHILDREN]:
            visit(y)

    visit(root)
    return out


def _is_root(label: str) -> bool:
    tag, *words = label.split(".")
    return tag in ("article", "main") or bool(CONTENT.intersection(words))


KEEP, DROP, SPARE = 1, 0, 2


def decide(root: list) -> list:
    """The wrapper's marks: [label, KEEP / DROP / SPARE / None (as above it), repeated, children, name, text of all below].

    KEEP starts the article.
    """
    constants = root[PAGES] > 2
    if constants and not _weigh(root, True, None)[id(root)]:  # nothing varies: copies of one page
        constants = False
    spared = _spared(root, constants)
    roots = _named_roots(root, spared)
    drops: list[list] = []
    if not roots:
        mass = _weigh(root, constants, spared)
        if not mass[id(root)]:
            mass = _weigh(root, False, spared)
        node = root
        while mass[id(root)]:
            heavy = [x for x in node[CHILDREN] if mass.get(id(x), 0) >= 0.8 * mass[id(root)]]
            if not heavy or heavy[0][LABEL].split(".")[0] in ("p", "li"):
                break
            node = heavy[0]
        roots = [node]
        drops = _weightless(node, mass)
    elif constants:
        drops = [y for x in roots for y in _repeated_blocks(x, root[PAGES])]
    said: dict[int, int] = {id(x): DROP for x in drops} | {i: SPARE for i in spared} | {id(x): KEEP for x in roots}

    def marks(x: list) -> list:
        return [x[LABEL], said.get(id(x)), x[REPEATED], [marks(y) for y in x[CHILDREN]], x[NAME], x[DEEP]]

    return marks(root)


_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def _repeated_blocks(article: list, pages: int) -> list:
    """The outermost elements of an article whose text most pages of the host have; none if that is all it has."""
    out: list = []
    rest = 0

    def visit(node: list) -> None:
        nonlocal rest
        rest += node[CHARS]
        for x in node[CHILDREN]:
            if x[DEEP].startswith("=") and x[PAGES] >= max(3, MAJOR * pages) and x[LABEL].split(".")[0] not in _HEADINGS:
                out.append(x)
            else:
                visit(x)

    visit(article)
    return out if rest else []


def _named_roots(node: list, spared: set[int]) -> list:
    """The outermost article or main elements; of a main with articles in it, the articles."""
    out = []
    for x in node[CHILDREN]:
        tag = x[LABEL].split(".")[0]
        if _excluded(x[LABEL]) and id(x) not in spared or tag == "header":
            continue
        inner = [] if tag == "article" else _named_roots(x, spared)
        out += inner or ([x] if _is_root(x[LABEL]) else [])
    return out


def _weigh(node: list, constants: bool, spared: set[int] | None) -> dict[int, int]:
    """By node, the characters of text that is not linked, excluded or, if ``constants`` are known, the same on all pages.

    Only tags of ``NEVER`` exclude if ``spared`` is None.
    """
    mass: dict[int, int] = {}

    pages = node[PAGES]

    def total(x: list) -> int:
        same = constants and x[TEXT] != "*" and x[PAGES] >= max(2, COMMON * pages)
        own = 0 if same else max(0, x[CHARS] - 2 * x[LINKED])
        tag = x[LABEL].split(".")[0]
        left_out = tag == "header" or (tag in NEVER if spared is None else _excluded(x[LABEL]) and id(x) not in spared)
        mass[id(x)] = 0 if left_out else own + sum(map(total, x[CHILDREN]))
        return mass[id(x)]

    total(node)
    return mass


def _weightless(node: list, mass: dict[int, int]) -> list:
    return [y for x in node[CHILDREN] for y in ([x] if not mass.get(id(x)) else _weightless(x, mass))]


def page_tree(page: str) -> list:
    """[label, parts, name, text of all below]; parts are strings and elements in page order."""
    root: list = ["", [], "", ""]
    stack = [root]
    for kind, said, *more in events(page):
        if kind == "text":
            stack[-1][1].append(said)
        elif kind == "open":
            stack[-1][1].append([said, [], more[0], ""])
            stack.append(stack[-1][1][-1])
        else:
            x = stack.pop()
            x[3] = _below(_constant([y for y in x[1] if isinstance(y, str)]), [y[3] for y in x[1] if not isinstance(y, str)])
    return root


def _worth(element: list, mark: list) -> int:
    """How well an element falls to a mark; a constant that is left out takes only its own text."""
    if element[0] != mark[0] or mark[4] not in (element[2], "*"):
        return 0
    same = mark[5] == element[3]
    if mark[1] == DROP and mark[5].startswith("=") and not same:
        return 0
    return 1 + (mark[4] == element[2]) + 3 * (same and mark[5] != "")


def _matched(elements: list, marks: list) -> list:
    """The mark that each element of a level falls to: the best alignment with the wrapper's level, in order."""
    if len(marks) == 1:
        return [marks[0] if _worth(e, marks[0]) else _other(e, _index(marks)) for e in elements]
    index = _index(marks)
    if len(elements) * len(marks) <= TABLE:
        return _in_order(elements, marks, index)
    cuts = _cuts(len(elements), len(marks), _anchors([(e[0], e[2], e[3]) if e[3] else None for e in elements],
                                                     [(m[0], m[4], m[5]) if m[5].startswith("=") else None for m in marks]))
    return [m for (i, j), (x, z) in zip(cuts, cuts[1:]) for m in _in_order(elements[i:x], marks[j:z], index)]


def _in_order(elements: list, marks: list, index: dict) -> list:
    n, k = len(elements), len(marks)
    best = [[0] * (k + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        here, below, e = best[i], best[i + 1], elements[i]
        for j in range(k - 1, -1, -1):
            w = _worth(e, marks[j]) if e[0] == marks[j][0] else 0
            here[j] = max(below[j], here[j + 1], w + below[j if marks[j][2] else j + 1] if w else 0)
    out, j = [], 0
    for i, e in enumerate(elements):
        while j < k and best[i][j] == best[i][j + 1]:
            j += 1
        w = _worth(e, marks[j]) if j < k else 0
        if w and best[i][j] == w + best[i + 1][j if marks[j][2] else j + 1]:
            out.append(marks[j])
            j += not marks[j][2]
        else:
            out.append(_other(e, index))
    return out


def _index(marks: list) -> dict:
    """The first mark by (label, name, text), (label, name) and label; constants that are left out only by their text."""
    index: dict = {}
    for m in marks:
        index.setdefault((m[0], m[4], m[5]), m)
        if not (m[1] == DROP and m[5].startswith("=")):
            index.setdefault((m[0], m[4]), m)
        if m[1] != DROP:
            index.setdefault(m[0], m)
    return index


def _other(element: list, index: dict) -> list | None:
    """For an element out of order: the mark that fits it best, or one of its label that is not left out."""
    label, name, text = element[0], element[2], element[3]
    for key in ((label, name, text), (label, "*", text)) if text else ():
        if key in index:
            return index[key]
    return index.get((label, name)) or index.get((label, "*")) or index.get(label)


def extract(page: str, wrapper: list | None) -> str:
    """The article's text by a host's wrapper; by the page's own where the wrapper's elements are not in it."""
    tree = page_tree(page)
    text = _read(tree, wrapper) if wrapper else None
    if text is None:
        text = _read(tree, decide(page_wrapper(page)))
    return text or ""


def _read(tree: list, wrapper: list) -> str | None:
    """None if no element that starts the article occurs."""
    out: list[str] = []
    seen = wrapper[1] == KEEP

    def walk(node: list, mark: list | None, inside: bool) -> None:
        nonlocal seen
        elements = [x for x in node[1] if not isinstance(x, str)]
        marks = iter(_matched(elements, mark[3]) if mark and elements else [None] * len(elements))
        for x in node[1]:
            if isinstance(x, str):
                if inside:
                    out.append(x)
                continue
            m = next(marks)
            starts = m is not None and m[1] == KEEP
            seen |= starts
            out.append(" ")
            said = m[1] if m is not None else None
            walk(x, m, (inside or starts) and (said in (KEEP, SPARE) or said is None and not _excluded(x[0])))
            out.append(" ")

    walk(tree, wrapper, seen)
    return " ".join(entities.unescape("".join(out)).split()) if seen else None


# -- Spark -----------------------------------------------------------------------------------------------------------
def _fold_pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    wrappers: dict[str, list] = {}
    seen: set = set()  # copies of a page are one page, or a large group of them would make its text a constant of the host

    def rows() -> pd.DataFrame:
        return pd.DataFrame({"host": list(wrappers), "salt": [crc32(json.dumps(w).encode()) % SALTS for w in wrappers.values()],
                             "wrapper": [json.dumps(w) for w in wrappers.values()]})

    for batch in batches:
        for host, page in zip(batch["host"], batch["html"]):
            copy = hash((host, page))
            if copy in seen:
                continue
            if len(seen) >= COPIES_KNOWN:
                seen.clear()
            seen.add(copy)
            new = page_wrapper(page or "")
            wrappers[host] = _sum(wrappers[host], new) if host in wrappers else new
        if len(wrappers) >= HOSTS_AT_ONCE:
            yield rows()
            wrappers.clear()
    if wrappers:
        yield rows()


def _merge(rows: pd.DataFrame) -> list:
    """In the order of the texts, so that the result does not depend on the order of arrival."""
    first, *more = (json.loads(w) for w in sorted(rows["wrapper"]))
    for w in more:
        first = _sum(first, w)
    return first


def _merge_part(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"host": rows["host"].iloc[:1], "wrapper": [json.dumps(_merge(rows))]})


def _merge_host(rows: pd.DataFrame) -> pd.DataFrame:
    merged = _merge(rows)
    return pd.DataFrame({"host": rows["host"].iloc[:1], "expression": [expression(merged)], "wrapper": [json.dumps(decide(merged))]})


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, expression, wrapper): the expression inferred from every page of each host, and what it marks as article."""
    parts = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).mapInPandas(
        _fold_pages, "host string, salt int, wrapper string")
    salted = parts.groupBy("host", "salt").applyInPandas(_merge_part, "host string, wrapper string")
    return salted.groupBy("host").applyInPandas(_merge_host, "host string, expression string, wrapper string")


def _extract_column(page: Column, wrapper: Column) -> Column:
    @F.arrow_udf("string")
    def run(pages: pa.Array, rules: pa.Array) -> pa.Array:
        known: dict = {None: None}
        out = []
        for p, r in zip(pages.to_pylist(), rules.to_pylist()):
            if r not in known:
                known[r] = json.loads(r)
            out.append(extract(p or "", known[r]))
        return pa.array(out, pa.string())
    return run(page, wrapper)


def extract_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with ``out``: the main text, blocks in page order joined by one space; empty if there is none.

    A null html is an empty page; null urls and urls without :// share one wrapper. Truncated pages end where they
    end. ``out`` replaces a column of that name.
    """
    table = as_table(wrappers(pages, url_col, html_col).select(F.col("host").alias("_host"), F.col("wrapper").alias("_wrapper")))
    host, rule = fresh(pages, "_page_host"), fresh(pages, "_page_wrapper")
    table = table.toDF(host, rule)
    # the join's sides are sized from what was written: Spark broadcasts wrappers only if they are few
    joined = pages.withColumn(host, host_of(F.col(url_col))).join(table, host, "left")
    return joined.withColumn(out, _extract_column(F.col(html_col), F.col(rule))).drop(host, rule)
