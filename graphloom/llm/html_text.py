"""Main text of web pages by wrappers, union-free regular expressions per host.

A page is a stream of tags and texts.  Pages of one host are aligned one after
the other, element by element: an element that only one side has becomes
optional, neighbours of equal signature become one repeated group, texts that
differ become a slot, texts that all pages have stay constant.  What comes out, the
wrapper, is an expression of elements, options, repetitions and slots without
alternatives.  It then says what belongs to the article; every page is cut along it.

What the markup itself says is taken from HTML's own elements and roles: nav, aside,
footer, forms and the like never hold the article, an article inside an article is a
comment, and an ``article`` or else ``main`` is where it stands.  No class name has a
meaning.  The rest follows from the wrapper, of at least SAME_PAGES different pages:

* Constant: a paragraph, container or text with the same words on every page that
  has its part is template, as long as most of the text around it differs.
* Few texts: a container with half as many different texts as pages or fewer
  (adverts, notices) is template, on the same condition; inside the article a text
  must be met FEW_INSIDE times on average, and what follows the first heading is its lead.
* Optional and repeated: at the end of the article, a container that some pages
  lack and that holds a repeated group of containers is a list of comments or links
  if these are made of elements, not of bare text, and no heading names the list; under
  a heading, if each also holds a part that is all link or that never changes
  (an author, "Reply").  It is less than TEMPLATE_SHARE of the article.  Steps,
  questions and answers, and other text in containers stay.
* Where nothing names the article, it is the innermost container beside which there
  are only such parts, site headers, and text inside links; nothing in it is left out
  for being short, and headings, list items and cells never are.

Pages that lack the article's part are cut along the next best, first of their host
and then of the page alone, where nothing but the markup can tell.

Bounds: a wrapper has MAX_DEPTH levels; what lies deeper counts for the element at
that level, and is kept or left out with it.  A level of more than MAX_PARTS parts
forgets class names, and if that is not enough the order of its elements, so that
aligning costs the same however names and orders vary.

Distribution: each task folds those pages of a host that have the same outline
(the expression without its texts), which needs no alignment and gives the same in
any order.  Outlines are then aligned in the order of their digests, along a tree
whose branches are the digests' leading bits: sorted partitions are folded as they
stream by, so that a host of a third of all pages is spread over thousands of
branches, and none is held whole.  Files, tasks and partitions, and so lost executors,
make no difference.  Only the decision, a few paths a host, meets the pages again: by
broadcast where all decisions together are small, else by a join on the host.  Pages
stay whole, and all of them count for the wrapper.

Defined results: a null page is an empty one and gives an empty text; a page
without host, or with none of its host's parts, is judged by its own wrapper;
repeated rows give equal rows and count once as evidence; of several articles on a
page those beside the one with most text are taken, single ones before repeated ones;
unclosed and misplaced tags are repaired as browsers do for paragraphs and list
items, others are ignored; other columns of the table are not read.
"""

from __future__ import annotations

import hashlib
import html as _html
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.textkernel import tidy
from graphloom.llm.url_rules import host_of

_RAW = re.compile(r"<(?:!--|(script|style|noscript|template|textarea|iframe|svg|title)\b)", re.I)
_TOKEN = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<[!?/][^>]*>|([^<]+)|<[a-zA-Z/!?][^>]*\Z|(<)""")
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_DIGITS = re.compile(r"\d+")
_HELD = re.compile(r"<(?:article|main|h1|h2)\b", re.I)
_FORM_END = re.compile(r"</form\b", re.I)

#: Elements and roles of the HTML and ARIA standards, by what they are for.
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
HEAD = frozenset("base link meta title style script noscript template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table body html article section div".split())
NOT_CONTENT = frozenset("head nav aside footer form button select option dialog menu object audio video canvas".split())
NOT_CONTENT_ROLES = frozenset("navigation complementary banner contentinfo search form dialog alertdialog alert status menu menubar toolbar tablist".split())
TEXT_LEVEL = frozenset("p h1 h2 h3 h4 h5 h6 hgroup ul ol dl li dt dd table thead tbody tfoot tr td th blockquote pre figure figcaption caption address summary details".split())
CONTAINERS = frozenset("div section article".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: What may be template inside an article; headings, items and cells name what follows them.
DROPPABLE = frozenset("p div section #".split())

SAME_PAGES = 4
#: Template may be this share of the text it stands in.
TEMPLATE_SHARE = 0.5
#: Pages to a text from which few texts are template: beside the article, and in it.
FEW_BESIDE, FEW_INSIDE = 2, 5
#: Of the host's text; see decide.
LITTLE = 0.1
SKETCH = 32
MAX_DEPTH, MAX_PARTS = 100, 64
#: Bits of an outline's digest that name its branch, level by level.
BRANCH_BITS = (12, 6, 0)
#: Parts that a task holds before it emits them.
HELD_PARTS = 100_000
BROADCAST_BYTES = 64 << 20
ROOT, SKIP, DROP = 1, 2, 3


@lru_cache(100_000)
def _named(tag: str, attrs: str) -> tuple[str, bool]:
    """(signature, whether its role says that it is no content) of an element."""
    names, out = [], False
    for m in _ATTR.findall(attrs):
        value = "".join(m[1:])
        if m[0].lower() == "role":
            out = out or value.strip().lower() in NOT_CONTENT_ROLES
            if value.strip().lower() in ("main", "article"):
                names.append(f"role={value.strip().lower()}")
        else:
            names += _DIGITS.sub("", value.replace(".", "-")).split()
    return (tag if tag in ("html", "body") else ".".join([tag, *names])), out and tag not in ("html", "body", "main", "article")


def tag_of(sig: str) -> str:
    return sig.partition(".")[0]


def _is(sig: str, name: str) -> bool:
    tag, *names = sig.split(".")
    return tag == name or f"role={name}" in names


def events(page: str) -> Iterator[tuple[int, str, str]]:
    """(1, tag, attributes) opens, (-1, tag, "") closes, (0, "", text): a balanced stream."""
    stack: list[str] = []
    places: dict[str, list[int]] = {}  # of each open element's tag in the stack
    scopes = [-1]

    def push(tag: str) -> None:
        places.setdefault(tag, []).append(len(stack))
        if tag in SCOPES:
            scopes.append(len(stack))
        stack.append(tag)

    def pop() -> str:
        tag = stack.pop()
        places[tag].pop()
        if tag in SCOPES:
            scopes.pop()
        return tag

    page = _without_raw(page)
    form_end = held = -1  # next places found, looked for once
    for m in _TOKEN.finditer(page):
        slash, tag, attrs, text = m[1], m[2], m[3], m[4] or m[5]
        if text:
            yield 0, "", text
        elif tag:
            tag = tag.lower()
            if slash:
                if places.get(tag):
                    while (top := pop()) != tag:
                        yield -1, top, ""
                    yield -1, tag, ""
                continue
            if places.get("head") and tag not in HEAD:
                while (top := pop()) != "head":
                    yield -1, top, ""
                yield -1, "head", ""
            if tag in VOID:
                yield 1, tag, ""
                yield -1, tag, ""
                continue
            if tag not in INLINE and (at := places.get("p")) and at[-1] > scopes[-1]:
                while (top := pop()) != "p":
                    yield -1, top, ""
                yield -1, "p", ""
            for closed in CLOSES.get(tag, ()):
                if (at := places.get(closed)) and at[-1] > scopes[-1]:
                    least = at[-1]
                    while len(stack) > least:
                        yield -1, pop(), ""
            if tag == "form" and not attrs.endswith("/"):
                if form_end < m.end():
                    form_end = end.start() if (end := _FORM_END.search(page, m.end())) else len(page)
                if held < m.end():
                    held = at.start() if (at := _HELD.search(page, m.end())) else len(page)
                if held < form_end:
                    tag = "div"  # a form around the whole page; its end tag then closes nothing
            if not attrs.endswith("/") or tag in INLINE:
                push(tag)
                yield 1, tag, attrs
    while stack:
        yield -1, stack.pop(), ""


@lru_cache(16)
def _closing(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\s*>", re.I)


def _without_raw(page: str) -> str:
    """The page without comments, scripts and the like; one pass, however many of them stay open."""
    kept, at, last = [], 0, page.rfind(">")
    while m := _RAW.search(page, at):
        begin = m.start()
        if m[1] is None:
            end = page.find("-->", m.end())
            end = len(page) if end < 0 else end + 3
        elif last < m.end():  # no element begins any more
            kept.append(page[at : m.end()])
            at = m.end()
            continue
        else:
            close = _closing(m[1].lower()).search(page, page.find(">", m.end()) + 1)
            end = close.end() if close else len(page)
        kept.append(page[at:begin])
        at = end
    kept.append(page[at:])
    return "".join(kept)


def stream(page: str) -> Iterator[tuple[int, str, int]]:
    """(1, signature, 0) and (-1, "", 0) of block elements, (0, text, characters in links) of blocks of text.

    What HTML says is no content is left out; texts are decoded, with single spaces.
    """
    buffer: list[str] = []
    linked = links = hidden = articles = 0
    marks: list[tuple[bool, bool]] = []  # of each open block element: hidden, an article

    def flush() -> tuple[int, str, int] | None:
        nonlocal linked
        text = " ".join("".join(buffer).split())
        within, linked = min(linked, len(text)), 0
        buffer.clear()
        return (0, text, within) if text else None

    for kind, tag, more in events(page):
        if kind == 0:
            if not hidden:
                text = _html.unescape(more) if "&" in more else more
                buffer.append(text)
                if links:
                    linked += len(" ".join(text.split()))
        elif tag in INLINE:
            if tag == "a":
                links += kind
            elif tag == "br" and kind > 0 and not hidden:
                buffer.append(" ")
        elif kind > 0:
            if buffer and (block := flush()):
                yield block
            sig, out = _named(tag, more) if "=" in more else (tag, False)
            article = tag == "article" or "role=article" in sig
            hide = out or tag in NOT_CONTENT or article and articles > 0
            marks.append((hide, article))
            hidden += hide
            articles += article
            if not hidden:
                yield 1, sig, 0
        else:
            if buffer and (block := flush()):
                yield block
            if not hidden:
                yield -1, "", 0
            hide, article = marks.pop()
            hidden -= hide
            articles -= article
    if buffer and (block := flush()):
        yield block


def _digest(texts: list[str]) -> int:
    return int.from_bytes(hashlib.blake2b("\n".join(texts).encode("utf-8", "surrogatepass"), digest_size=7).digest())


def _least(a: list[int], b: list[int]) -> list[int]:
    return a if a == b else sorted({*a, *b})[:SKETCH]


def _about(sketch: list[int]) -> float:
    """How many different numbers were sketched; exact under SKETCH."""
    return len(sketch) if len(sketch) < SKETCH else (SKETCH - 1) * 2.0**56 / max(1, sketch[-1])


class Part:
    """A node of a wrapper: an element or (signature "#") a text.

    ``same``: digests and lengths of the texts that every page has here (of a
    repeated group, of its items); ``texts`` and ``pages`` are sketches (the
    smallest digests) of the different texts here and of the pages that have it.
    ``count`` is that of all pages, copies included.  ``mode`` is 1 if the children's
    names are forgotten, 2 if their order is too.
    """

    __slots__ = ("sig", "many", "optional", "mode", "count", "chars", "linked", "same", "texts", "pages", "children")

    def __init__(self, sig: str):
        self.sig, self.many, self.optional, self.mode, self.count = sig, False, False, 0, 1
        self.chars = self.linked = 0
        self.same: dict[int, int] = {}
        self.texts: list[int] = []
        self.pages: list[int] = []
        self.children: list[Part] = []

    @property
    def running(self) -> int:
        """Characters outside links."""
        return self.chars - self.linked

    def walk(self) -> Iterator[Part]:
        left = [self]
        while left:
            p = left.pop()
            yield p
            left += reversed(p.children)

    def pack(self) -> str:
        rows, left = [], [(self, -1)]
        while left:
            p, parent = left.pop()
            rows.append([parent, p.sig, int(p.many), int(p.optional), p.mode, p.count, p.chars, p.linked, [x for kv in p.same.items() for x in kv], p.texts, p.pages])
            left += [(c, len(rows) - 1) for c in reversed(p.children)]
        return json.dumps(rows, ensure_ascii=False)

    @staticmethod
    def unpack(packed: str) -> Part:
        parts: list[Part] = []
        for parent, sig, many, optional, mode, count, chars, linked, same, texts, pages in json.loads(packed):
            p = Part(sig)
            p.many, p.optional, p.mode, p.count, p.chars, p.linked, p.texts, p.pages = bool(many), bool(optional), mode, count, chars, linked, texts, pages
            p.same = dict(zip(same[::2], same[1::2], strict=True))
            if parent >= 0:
                parts[parent].children.append(p)
            parts.append(p)
        return parts[0]

    def outline(self) -> tuple[int, int]:
        """(digest of all that alignment looks at, number of parts)."""
        said, left, n = [], [self], 0
        while left:
            p = left.pop()
            n += 1
            said.append(f"{p.sig}\n{len(p.children)} {p.many:d}{p.optional:d}{p.mode}")
            left += reversed(p.children)
        return _digest(said), n

    def expression(self) -> str:
        body = ("SAME" if self.same else "TEXT") if self.sig == "#" else f"<{self.sig}>{''.join(c.expression() for c in self.children)}</>"
        return f"({body})" + ("*" if self.many and self.optional else "+" if self.many else "?") if self.many or self.optional else body


def merge(a: Part, b: Part, together: bool = False) -> Part:
    """Align two parts of one signature, in place of the first.  ``together``: both are of one page."""
    a.many, a.optional = a.many or b.many or together and a.sig != "#", a.optional or b.optional
    a.chars, a.linked = a.chars + b.chars, a.linked + b.linked
    if together:
        a.same.update(b.same)
    else:
        a.count += b.count
        a.same = {k: n for k, n in a.same.items() if k in b.same}
    a.texts, a.pages = _least(a.texts, b.texts), _least(a.pages, b.pages)
    if a.children or b.children:
        mode = max(a.mode, b.mode)
        for p in (a, b):
            while p.mode < mode:
                coarsen(p)
        a.children = (bag if mode == 2 else align)(a.children, b.children, together)
        while len(a.children) > MAX_PARTS and a.mode < 2:
            coarsen(a)
    return a


def coarsen(p: Part) -> None:
    """Let a level forget its elements' names, then their order."""
    p.mode += 1
    for c in p.children:
        c.sig = tag_of(c.sig)
    p.children = fold(p.children) if p.mode == 1 else bag(p.children, [], True)


def bag(xs: list[Part], ys: list[Part], together: bool) -> list[Part]:
    """One part for each element name; xs have one at most unless all are of one page."""
    out: dict[str, Part] = {}
    for p in xs:
        out[p.sig] = merge(out[p.sig], p, True) if p.sig in out else p
    own = set(out)
    theirs: dict[str, Part] = {}
    for p in ys:
        theirs[p.sig] = merge(theirs[p.sig], p, True) if p.sig in theirs else p
    for sig, p in theirs.items():
        out[sig] = merge(out[sig], p, together) if sig in own else _option(p)
    if ys:
        for sig in own - set(theirs):
            _option(out[sig])
    return list(out.values())


def _option(p: Part) -> Part:
    p.optional = True
    return p


def align(xs: list[Part], ys: list[Part], together: bool = False) -> list[Part]:
    """One list that fits both: common elements in order are merged, the rest becomes optional."""
    i = 0
    while i < len(xs) and i < len(ys) and xs[i].sig == ys[i].sig:
        i += 1
    head = [merge(x, y, together) for x, y in zip(xs[:i], ys[:i], strict=True)]
    xs, ys = xs[i:], ys[i:]
    if xs or ys:
        size = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
        for p in range(len(xs) - 1, -1, -1):
            for q in range(len(ys) - 1, -1, -1):
                size[p][q] = size[p + 1][q + 1] + 1 if xs[p].sig == ys[q].sig else max(size[p + 1][q], size[p][q + 1])
        p = q = 0
        while p < len(xs) or q < len(ys):
            if p < len(xs) and q < len(ys) and xs[p].sig == ys[q].sig:
                head.append(merge(xs[p], ys[q], together))
                p, q = p + 1, q + 1
            elif q == len(ys) or p < len(xs) and size[p + 1][q] >= size[p][q + 1]:
                head.append(_option(xs[p]))
                p += 1
            else:
                head.append(_option(ys[q]))
                q += 1
    return fold(head)


def fold(parts: list[Part]) -> list[Part]:
    """Neighbours of equal signature become one repeated group."""
    out: list[Part] = []
    for p in parts:
        if out and out[-1].sig == p.sig:
            merge(out[-1], p, together=True)
        else:
            out.append(p)
    return out


def page_part(page: str) -> Part:
    """The wrapper of one page; inline elements belong to the text around them."""
    root = Part("")
    stack, begins, texts, deep = [root], [0], [], 0
    last = (-1, -1, 0)

    def close(p: Part, begin: int) -> None:
        nonlocal last
        if begin < len(texts):
            if last[:2] != (begin, len(texts)):
                last = (begin, len(texts), _digest(texts[begin:]))
            p.same, p.texts = {last[2]: sum(map(len, texts[begin:]))}, [last[2]]
        p.children = fold(p.children)
        while len(p.children) > MAX_PARTS and p.mode < 2:
            coarsen(p)
        p.chars, p.linked = sum(c.chars for c in p.children) + p.chars, sum(c.linked for c in p.children) + p.linked

    for kind, what, within in stream(page):
        if kind == 0:
            if deep:
                stack[-1].chars += len(what)
                stack[-1].linked += within
            else:
                p, d = Part("#"), _digest([what])
                p.chars, p.linked, p.same, p.texts = len(what), within, {d: len(what)}, [d]
                stack[-1].children.append(p)
            texts.append(what)
        elif kind > 0:
            if len(stack) > MAX_DEPTH:
                deep += 1
                continue
            p = Part(what)
            stack[-1].children.append(p)
            stack.append(p)
            begins.append(len(texts))
        elif deep:
            deep -= 1
        else:
            close(stack.pop(), begins.pop())
    close(root, 0)
    own = root.texts or [_digest([])]
    for p in root.walk():
        p.pages = own
    return root


def wrapper_of(pages: Iterable[str]) -> Part | None:
    """The wrapper of some pages, one after the other."""
    out: Part | None = None
    for page in pages:
        own = page_part(page)
        out = own if out is None else merge(out, own)
    return out


def _template(p: Part, few: int = FEW_BESIDE) -> bool:
    """A container with few texts for its many pages."""
    pages = _about(p.pages)
    return not p.many and pages >= SAME_PAGES and few * _about(p.texts) <= pages


def _listing(p: Part) -> bool:
    """A container that some pages lack, of which or in which containers repeat."""
    if not p.optional or tag_of(p.sig) not in CONTAINERS or _about(p.pages) < SAME_PAGES:
        return False
    return p.many or any(c.many and c.chars and tag_of(c.sig) in CONTAINERS for c in p.children)


def _comments(p: Part) -> bool:
    """A listing whose items look like those of readers: made of elements, and under a heading with marks of their own."""
    if not _listing(p):
        return False
    items = [p] if p.many else [c for c in p.children if c.many and c.chars and tag_of(c.sig) in CONTAINERS]
    inside = [[x for c in item.children for x in c.walk() if x.chars] for item in items]
    if any(not item.running for item in items):
        return True  # links
    if not all(any(x.sig != "#" for x in xs) for xs in inside):
        return False
    if not any(tag_of(x.sig) in HEADINGS for x in p.walk()):
        return True
    return all(any(not x.running or x.same and tag_of(x.sig) not in HEADINGS for x in xs) for xs in inside)


class Decision:
    """Paths through a wrapper: roots of the article, parts to skip, constant items to drop.

    Parts of one signature below one parent are one node; it is skipped only if all are.
    """

    def __init__(self, wrapper: Part) -> None:
        self.rows: list[list] = [[-1, "", wrapper.mode, 0, []]]  # parent, signature, mode, what, digests
        self.at: dict[tuple[int, str], int] = {}

    def add(self, path: list[Part], what: int, digests: Iterable[int] = ()) -> None:
        node = 0
        for p in path[1:]:
            if (node, p.sig) not in self.at:
                self.at[node, p.sig] = len(self.rows)
                self.rows.append([node, p.sig, p.mode, 0, []])
            node = self.at[node, p.sig]
        row = self.rows[node]
        row[2] = max(row[2], path[-1].mode)
        row[3] = row[3] or what
        row[4] = sorted({*row[4], *digests})

    def skip(self, path: list[Part], skipped: list[Part]) -> None:
        if all(c in skipped for c in path[-2].children if c.sig == path[-1].sig and c.chars):
            self.add(path, SKIP)


def _within(out: Decision, path: list[Part], left: list[Part]) -> None:
    """Skip and drop what is template below an article's root."""
    root = path[-1]
    if _about(path[0].pages) < SAME_PAGES:
        return
    skips: list[list[Part]] = []
    drops: list[list[Part]] = []
    lists: list[list[Part]] = []
    todo = [path]
    while todo:
        here = todo.pop()
        at = here[-1]
        held = [c for c in at.children if c.chars and c not in left]
        steady = max((i for i, c in enumerate(held) if not c.optional), default=len(held))
        lead = next((i + 1 for i, c in enumerate(held) if tag_of(c.sig) in HEADINGS), -1)
        for i, c in enumerate(held):
            tag = tag_of(c.sig)
            if at is root and i > steady and _comments(c) and c.running <= TEMPLATE_SHARE * root.running:
                lists.append([*here, c])
                continue
            if tag in CONTAINERS and i != lead and _template(c, FEW_INSIDE):
                skips.append([*here, c])
                continue
            if tag in DROPPABLE and not (tag == "#" and tag_of(at.sig) in TEXT_LEVEL) and c.same and _about(c.pages) >= SAME_PAGES:
                drops.append([*here, c])
            todo.append([*here, c])
    mass = sum(p[-1].running for p in skips) + sum(sum(p[-1].same.values()) * p[-1].count for p in drops)
    if mass > TEMPLATE_SHARE * sum(c.running for c in root.children if c not in left):
        skips, drops = [], []
    for p in [*skips, *lists]:
        out.skip(p, [q[-1] for q in [*skips, *lists]])
    for p in drops:
        out.add(p, DROP, p[-1].same)


def _descend(path: list[Part], without: list[Part]) -> tuple[list[Part], list[Part]]:
    """(path of the innermost container that holds the article, parts beside to leave out)."""
    left: list[Part] = list(without)
    while True:
        at = path[-1]
        held = [c for c in at.children if c.chars and c not in left]
        few = [c for c in held if tag_of(c.sig) in CONTAINERS and _template(c)]
        if sum(c.running for c in few) > TEMPLATE_SHARE * sum(c.running for c in held):
            few = []

        def beside(c: Part, few: list[Part] = few) -> bool:
            tag = tag_of(c.sig)
            return tag == "header" or c.sig != "#" and tag not in TEXT_LEVEL and (not c.running or _comments(c) or c in few)

        sure = [i for i, c in enumerate(held) if not beside(c)]
        if sure:
            left += [c for i, c in enumerate(held) if tag_of(c.sig) == "header" or not sure[0] <= i <= sure[-1]]
            held = [c for c in held if c not in left]
        if len(held) != 1 or held[0].many or held[0].sig == "#" or tag_of(held[0].sig) in TEXT_LEVEL:
            return path, left
        path = [*path, held[0]]


def decide(wrapper: Part) -> list[list[list]]:
    """Decisions, best first: along the article, along main, along the running text."""
    found: dict[str, list[list[Part]]] = {"article": [], "main": []}
    todo, heads = [[wrapper]], []
    while todo:
        path = todo.pop()
        for name in found:
            if _is(path[-1].sig, name):
                found[name].append(path)
        for c in reversed(path[-1].children):
            if tag_of(c.sig) != "header":
                todo.append([*path, c])
            elif tag_of(path[-1].sig) in ("", "html", "body"):
                heads.append([*path, c])  # of the site
    out: list[Decision] = []
    articles = [p for p in found["article"] if not any(_is(x.sig, "article") for x in p[:-1])]
    # One inside a section, of little text, is a comment rather than the article.
    sure = [p for p in articles if not (any(tag_of(x.sig) == "section" for x in p) and p[-1].running < LITTLE * wrapper.running)]
    sure.sort(key=lambda p: (_template(p[-1]), p[-1].many, -p[-1].running, len(p)))
    groups: dict[int, list[list[Part]]] = {}
    for p in sure:
        groups.setdefault(id(p[-2]), []).append(p)
    for group in groups.values():
        one = Decision(wrapper)
        for p in group:
            if p is group[0] or not _template(p[-1]):
                one.add(p, ROOT)
                _within(one, p, [])
        out.append(one)
    starts = [max(found["main"], key=lambda p: p[-1].running)] if found["main"] else []
    for start in [*starts, [wrapper]]:
        path, left = _descend(start, [p[-1] for p in articles])
        one = Decision(wrapper)
        one.add(path, ROOT)
        _within(one, path, left)
        for n in range(len(start), len(path) + 1):
            for c in path[n - 1].children:
                if c in left:
                    one.skip([*path[:n], c], left)
        for p in articles:
            if p not in sure:
                one.skip(p, left)
        for p in heads:
            one.skip(p, [q[-1] for q in heads])
        out.append(one)
    return [d.rows for d in out]


def cut(page: str, rows: list[list], template: bool = False) -> tuple[str, bool]:
    """(text, whether a root was met) of a page along a decision; ``template``: constant items stay."""
    kids: list[dict[str, int]] = [{} for _ in rows]
    for i, r in enumerate(rows):
        if i:
            kids[r[0]][r[1]] = i
    drops = [frozenset(() if template else r[4]) for r in rows]
    met = rows[0][3] == ROOT
    inside, skipped = int(met), 0
    stack: list[tuple[int, int, int]] = [(0, 0, 0)]  # node or -1, what it did, first block
    blocks: list[str] = []
    slots = {i: kids[i]["#"] for i in range(len(rows)) if "#" in kids[i]}
    for kind, what, _ in stream(page):
        node = stack[-1][0]
        if kind == 0:
            if inside and not skipped:
                slot = slots.get(node)
                if slot is None or _digest([what]) not in drops[slot]:
                    blocks.append(what)
        elif kind > 0:
            child = -1
            if node >= 0 and kids[node]:
                child = kids[node].get(tag_of(what) if rows[node][2] else what, -1)
            did = rows[child][3] if child >= 0 else 0
            if did == ROOT:
                inside, met = inside + 1, True
            skipped += did == SKIP
            stack.append((child, did, len(blocks)))
        else:
            child, did, begin = stack.pop()
            inside -= did == ROOT
            skipped -= did == SKIP
            if did == DROP and begin < len(blocks) and _digest(blocks[begin:]) in drops[child]:
                del blocks[begin:]
    return "\n".join(blocks), met


def extract(page: str, decisions: list[list[list]] | None) -> str:
    """The page's article, along its host's parts or else its own."""
    for own in (decisions or [], None):
        for rows in decide(page_part(page)) if own is None else own:
            text, met = cut(page, rows)
            if met and not text:  # an article of nothing but template is kept
                text = cut(page, rows, template=True)[0]
            if met and (text or rows[0][3] != ROOT):
                return text
    return ""


FOLDED = "host string, outline long, wrapper string"


def _emit(found: Iterable[tuple[str, int, Part]]) -> pa.RecordBatch:
    rows = [(h, o, p.pack()) for h, o, p in found]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))], names=["host", "outline", "wrapper"])


def _fold_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages of equal host and outline become one part; several rows of one outline may leave a task."""
    found: dict[tuple[str, int], Part] = {}
    held = 0
    for batch in batches:
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = page_part(page or "")
            key, size = (host, (said := own.outline())[0]), said[1]
            if key in found:
                merge(found[key], own)
                continue
            found[key] = own
            held += size
            if held >= HELD_PARTS:
                yield _emit((h, o, p) for (h, o), p in found.items())
                found.clear()
                held = 0
    yield _emit((h, o, p) for (h, o), p in found.items())


def _fold_sorted(bits: int):
    """Fold rows that arrive by host and outline, as long as the outlines' leading bits are the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host, outline, same, whole = None, 0, None, None  # the branch's first outline; the parts of the present one
        last = 0
        done: list[tuple[str, int, Part]] = []
        for batch in batches:
            for h, o, packed in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                part = Part.unpack(packed)
                if same is not None and (h, o) == (host, last):
                    merge(same, part)
                    continue
                if same is not None:
                    whole = same if whole is None else merge(whole, same)
                if whole is not None and (h != host or o >> (56 - bits) != outline >> (56 - bits)):
                    done.append((host, outline, whole))
                    whole = None
                if whole is None:
                    host, outline = h, o
                last, same = o, part
                if len(done) >= 1000:
                    yield _emit(done)
                    done = []
        if same is not None:
            done.append((host, outline, same if whole is None else merge(whole, same)))
        yield _emit(done)

    return run


def _decide_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        said = [json.dumps(decide(Part.unpack(w)), ensure_ascii=False) for w in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(said, pa.string())], names=["host", "decision"])


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper) of every host; the wrapper as JSON (see Part.pack)."""
    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).filter("host <> ''")
    folded = rows.mapInArrow(_fold_pages, FOLDED)
    for bits in BRANCH_BITS:
        branch = F.shiftrightunsigned("outline", 56 - bits)
        folded = folded.repartition("host", branch).sortWithinPartitions("host", "outline").mapInArrow(_fold_sorted(bits), FOLDED)
    return folded.select("host", "wrapper")


def _cutter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str | None, list | None] = {None: None}
    for batch in batches:
        texts = []
        for page, said in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if said not in known:
                if len(known) > 10_000:
                    known.clear()
                    known[None] = None
                known[said] = json.loads(said)
            texts.append(extract(page or "", known[said]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])
        tidy()


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``; see the module."""
    from graphloom.llm.scratch import Scratch

    scratch = Scratch(pages.sparkSession, "wrappers")
    said = scratch.save(wrappers(pages, url_col, html_col).mapInArrow(_decide_rows, "host string, decision string"), "decisions")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    size = said.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length("decision")), F.lit(0))).first()[0]
    rows = rows.join(F.broadcast(said) if size <= BROADCAST_BYTES else said, "host", "left").select("page_id", "url", "html", "decision")
    return rows.mapInArrow(_cutter, "page_id long, url string, text string, n_chars long")
