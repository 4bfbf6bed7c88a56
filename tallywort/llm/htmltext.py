"""HTML extraction by equivalence-class template deduction.

A page's tokens are its block elements, named by their path with classes; its texts, named by path and wording; and
all words of its texts, named by path and word.

1. Pages are parsed once and stored. Texts and words that can't be on ``MIN_SHARE`` of their host's pages are left out
   first: each part of a host's pages lists the codes (16 bits of a hash) on ``LISTED`` of its pages or more with the
   pages beyond that, and what isn't listed has no more, so sums of the lists bound every token from above. At most
   four times a mean page's codes are left of a host; tokens that only share such a code fall away once counted.
   A token's occurrence vector says how often it occurs on each page of the host. Vectors are compared by
   fingerprint: the sum over pages of a page's random weight times the count, a sum that is built up in the
   tasks, so that no host's pages are ever gathered and a host with a third of all pages is a few rows a task.
2. Tokens of a host with equal vectors form an equivalence class. A class is valid if it has ``MIN_TOKENS``
   tokens or more, occurs on ``MIN_SHARE`` of the host's pages and on ``MIN_PAGES`` or more, and nests: its tokens
   lie between two neighbouring tokens of any larger class, or around it, never across.
3. The valid classes, nested, are the host's template. Its texts and words are the same on page after page; the
   rest fills slots. Elements of the template that occur once a page are its regions. Beside tokens the tasks sum up
   words and link characters below each element, so each region has a mass: its words that the template doesn't
   hold, less their share in links.
4. The main region is found from the page downwards: into a region as long as it holds ``MAJOR`` of the mass of the
   one around it and, unless it is an article, leaves no bare text and few paragraphs behind. Masses of elements that say they are navigation, footers, forms or comments
   count ``SAID`` as much, and of those whose class hints at it ``HINTED``.
5. Slots of the main region that say so go; those that hint go if they hold no more than ``MINOR`` of its mass;
   outside articles, those that are mostly links or mostly template words go. Template texts go, and what else is in
   the main region is the page's text.

A page without the host's main region, or of a host with too few pages for a template, is judged by its own masses.
A block is the text between two block-level tags. Character references are decoded, white space runs become
one space, blocks are trimmed and joined by line breaks; a ``<br>`` is white space inside its block. Text that is cut
off at the end of a page counts, a tag that is cut off doesn't. Null and empty pages, and pages without text, give an
empty text. A page that would lose its whole text to the template, as where all pages of a host are equal, keeps it.
Null URLs share a host. Repeated pages are extracted alike. An empty table gives an empty table. Other columns pass
unused. Time and memory grow with a page's length however deep it nests.
"""

from __future__ import annotations

import html as entities
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .urlfilter import host_of

MIN_TOKENS, MIN_PAGES, MIN_SHARE = 2, 8, 0.5
#: Part of the pages in a part of a host's from which a text or word is listed.
LISTED = MIN_SHARE / 2
#: Words of a text that are tokens (all); a region's part of the mass around it; parts of a mass that said and hinted boilerplate counts.
LEAD, MAJOR, SAID, HINTED = None, 0.6, 0.02, 0.3
#: Part of the page's mass that may stay behind in paragraphs beside a region that is no article.
LEFT = 0.05
#: Part of the main region's mass that a hinting slot may hold and go; shares of links and of template words that make a slot go.
MINOR, MAX_LINK_SHARE, MAX_TEMPLATE_SHARE = 0.3, 0.5, 0.8
#: Rows of partial sums, and codes of a part of the pages, that a task holds.
FLUSH, PART = 150_000, 4_000_000

#: Element names of HTML by role, and words of classes and ids by convention.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe noembed noframes template xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("html head body option select".split())
AUTO_CLOSE = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
BOILERPLATE = frozenset("nav aside footer form head dialog menu fieldset".split())
MUTE = frozenset("button select datalist svg canvas audio video object map label".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion banner banners "
    "cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription sidebar sidebars menu menus nav "
    "navbar navigation breadcrumb breadcrumbs footer masthead replies reply respond related recommended share "
    "sharing social widget widgets toolbar pagination pager login signup skip".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist disqus".split())
HEADER_WORDS = frozenset("header topbar".split())
NEGATIONS = frozenset("no has with without".split())
CONTENT = frozenset("article main".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|</[^>]*(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


#: What an element's name, role and classes tell.
NOTHING, HINT, SAYS, ARTICLE, PROSE = range(5)


def _hash(*parts: int | str) -> int:
    return xxhash.xxh3_64_intdigest("\t".join(map(str, parts))) - 2**63


@dataclass
class Element:
    """A path of a page: its parent's, and sums over its elements and what is below them."""

    parent: int
    told: int
    first: int
    count: int = 0
    words: int = 0
    chars: int = 0
    links: int = 0


@dataclass
class Block:
    path: int
    text: str
    words: list[str]


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    elements: dict[int, Element] = field(default_factory=dict)


@dataclass
class Template:
    """A host's main region, the paths in it that go, and hashes of the texts of the template."""

    region: int
    dropped: frozenset[int] = frozenset()
    texts: frozenset[int] = frozenset()


def _told(name: str, attributes: dict[str, str], inside: bool) -> int:
    if name in BOILERPLATE or name == "header" and not inside or attributes.get("role", "").lower() in BOILER_ROLES:
        return SAYS
    if name == "article":
        return ARTICLE
    if name in ("html", "body", "main"):
        return NOTHING
    out = PROSE if name in PARAGRAPHS else NOTHING
    for word in f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split():
        parts = [x for x in re.split(r"[^a-z0-9]+", word) if x]
        if parts and parts[0] not in NEGATIONS:
            ends = {parts[0], parts[-1]}
            if ends & COMMENT_WORDS:
                return SAYS
            if ends & BOILER_WORDS or not inside and ends & HEADER_WORDS:
                out = HINT
    return out


def _is_hidden(name: str, attributes: dict[str, str]) -> bool:
    return name in MUTE or "hidden" in attributes or attributes.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", attributes.get("style", "")))


@dataclass(slots=True)
class _Open:
    """An element that is open: its path's hash, and sums of what is below it."""

    name: str
    path: int
    own: bool  # has a path of its own
    inside: bool = False  # an article or main part
    link: bool = False
    mute: bool = False
    words: int = 0
    chars: int = 0
    links: int = 0


class _Stack:
    """The open elements, with the places of each name, so that looking for a name doesn't walk the stack."""

    def __init__(self, bottom: _Open, page: Page):
        self.items, self.places, self.page = [bottom], {}, page

    def last(self, *names: str) -> int:
        """The highest place of an element of these names; 0 if none is open."""
        return max((p[-1] for n in names if (p := self.places.get(n))), default=0)

    def push(self, x: _Open) -> None:
        self.places.setdefault(x.name, []).append(len(self.items))
        self.items.append(x)

    def cut(self, place: int) -> None:
        """Close the elements from a place on."""
        while len(self.items) > place:
            x = self.items.pop()
            self.places[x.name].pop()
            above = self.items[-1]
            above.words += x.words
            above.chars += x.chars
            above.links += x.links
            if x.own:
                e = self.page.elements[x.path]
                e.words += x.words
                e.chars += x.chars
                e.links += x.links


def parse(source: str) -> Page:
    """Blocks and elements of a page; an element comes behind its parent."""
    page = Page()
    stack = _Stack(_Open("", 0, True), page)
    page.elements[0] = Element(0, NOTHING, 0, 1)
    parts: list[str] = []
    linked = turn = 0

    def end_block() -> None:
        nonlocal parts, linked, turn
        if parts:
            words = "".join(parts).split()
            if words:
                top, text = stack.items[-1], " ".join(words)
                page.blocks.append(Block(top.path, text, words))
                top.words += len(words)
                top.chars += len(text)
                top.links += min(linked, len(text))
                turn += 1
        parts, linked = [], 0

    at, size = 0, len(source)
    while at < size:
        m = _TAG.search(source, at)
        stop = m.start() if m else size
        if stop > at and not stack.items[-1].mute:
            text = source[at:stop]
            parts.append(entities.unescape(text) if "&" in text else text)
            if stack.items[-1].link:
                linked += len(text)
        if m is None:
            break
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        if m[2] is None and not m[0].endswith(">"):
            break  # a tag that the end of the page cuts off
        name = name.lower()
        if m[1] or m[4]:
            if name in BLOCK:
                end_block()
            if place := stack.last(name):
                stack.cut(place)
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in BLOCK:
            end_block()
            if name in CLOSES_P and (place := stack.last("p")) > stack.last("button", "td", "th", "table", "li"):
                stack.cut(place)
            if name in AUTO_CLOSE:
                scope, places = stack.last(*SCOPE[name]), [p for n in AUTO_CLOSE[name] if (p := stack.last(n))]
                if places and max(places) > scope:
                    stack.cut(max(places))
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(source, at)
            at = size if end is None else (source.find(">", end.end()) + 1 or size)
            continue
        if name in VOID:
            continue
        attributes = {k.lower(): a or b or c or "" for k, a, b, c in _ATTRIBUTE.findall(m[3] or m[6] or "")}
        top = stack.items[-1]
        x = _Open(name, top.path, name in BLOCK, top.inside or name in CONTENT, top.link or name == "a", top.mute or _is_hidden(name, attributes))
        if x.own:
            x.path = _hash(top.path, name, *sorted(attributes.get("class", "").split()), attributes.get("id", "") if not any(c.isdigit() for c in attributes.get("id", "")) else "")
            e = page.elements.get(x.path)
            if e is None:
                e = page.elements[x.path] = Element(top.path, _told(name, attributes, x.inside), turn)
            e.count += 1
            turn += 1
        stack.push(x)
    end_block()
    stack.cut(1)
    bottom = stack.items[0]
    root = page.elements[0]
    root.words, root.chars, root.links = bottom.words, bottom.chars, bottom.links
    return page


def nested(tokens: list[tuple[int, float, int, int]]) -> list[int]:
    """Of tokens (hash, mean place on a page, class, class size), the hashes of the classes that nest: larger classes
    come first, and a class is left out if it lies across the gaps of one that came before."""
    classes: dict[int, list[tuple[float, int]]] = {}
    for h, place, c, _ in tokens:
        classes.setdefault(c, []).append((place, h))
    taken: list[np.ndarray] = []
    out: list[int] = []
    for c in sorted(classes, key=lambda c: (-len(classes[c]), min(classes[c]))):
        places = np.array(sorted(p for p, _ in classes[c]))
        gaps = [np.unique(np.searchsorted(t, places)) for t in taken]
        around = [places[0] <= t[0] and places[-1] >= t[-1] for t in taken]
        if all(len(g) == 1 or a for g, a in zip(gaps, around, strict=True)) or not taken:
            taken.append(places)
            out += [h for _, h in classes[c]]
    return out


def chosen(elements: dict[int, Element], regions: set[int], template_words: dict[int, int]) -> Template:
    """The main region and what goes of it, by the masses of the elements. elements: sums over pages; regions: paths that
    occur once a page; template_words: the template's words by path, those in paths below it not included."""
    order = sorted((h for h in elements if h), key=lambda h: elements[h].first)
    below: dict[int, list[int]] = {}
    for h in order:
        below.setdefault(elements[h].parent, []).append(h)
    walk, stack = [], [0]  # from the page downwards; paths whose parents aren't known count as the page's
    seen = set()
    while stack:
        h = stack.pop()
        if h not in seen:
            seen.add(h)
            walk.append(h)
            stack += reversed(below.get(h, ()))
        if not stack:
            stack = [h for h in order if h not in seen and elements[h].parent not in elements][:1]
    fixed = {h: template_words.get(h, 0) for h in walk}
    for h in reversed(walk):
        if h and elements[h].parent in fixed:
            fixed[elements[h].parent] += fixed[h]
    plain = {h: max(0, elements[h].words - fixed[h]) for h in walk}
    if not plain[0]:  # all pages are equal
        plain = {h: elements[h].words for h in walk}
    mass = {h: plain[h] * (1 - elements[h].links / max(1, elements[h].chars)) for h in walk}
    factor = {NOTHING: 1.0, HINT: HINTED, SAYS: SAID, ARTICLE: 1.0, PROSE: 1.0}
    direct = {h: max(0.0, mass[h] - sum(mass[c] for c in below.get(h, ()))) for h in walk}
    weighed: dict[int, float] = {}
    for h in reversed(walk):
        weighed[h] = factor[elements[h].told] * (direct[h] + sum(weighed[c] for c in below.get(h, ())))
    region, left = 0, 0.0
    while elements[region].told != ARTICLE:
        # an article that is no region, as on a page with several, is left together with what is beside it
        best = max((c for c in below.get(region, ()) if c in regions), key=lambda c: (weighed[c], -elements[c].first), default=None)
        if best is None or weighed[best] <= 0 or weighed[best] < MAJOR * weighed[region]:
            break
        if elements[best].told != ARTICLE:
            left += sum(mass[c] for c in below[region] if c != best and elements[c].told == PROSE)
            if direct[region] > 0 or left > LEFT * weighed[0]:
                break
        region = best
    is_article, dropped = elements[region].told == ARTICLE, set()
    stack = list(below.get(region, ()))
    while stack:
        h = stack.pop()
        e = elements[h]
        minor = mass[h] <= MINOR * weighed[region]
        few = not is_article and e.told != ARTICLE and (e.links > MAX_LINK_SHARE * e.chars or fixed[h] >= MAX_TEMPLATE_SHARE * max(1, e.words) and minor)
        if e.told == SAYS or e.told == HINT and minor or few:
            dropped.add(h)
        else:
            stack += below.get(h, ())
    return Template(region, frozenset(dropped))


#: A page as stored: its random weights, its elements (path, then the numbers of Element), the paths of its blocks, and
#: their texts, which hold no line breaks.
STORED = {"one": pa.int64(), "two": pa.int64(), "elements": pa.list_(pa.int64()), "paths": pa.list_(pa.int64()), "text": pa.string()}
NUMBERS = 8


def _weights(page_id: object, source: str) -> tuple[int, int]:
    weight = xxhash.xxh3_64_intdigest(f"{page_id} {xxhash.xxh3_64_intdigest(source)}")
    return weight & 0x3FFFFFFF, weight >> 32 & 0x3FFFFFFF


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (page_id, url, host, html): the pages as stored."""
    for batch in batches:
        rows = []
        for page_id, source in zip(batch.column(0), batch.column(3), strict=True):
            source = source.as_py() or ""
            page = parse(source)
            elements = [x for h, e in page.elements.items() for x in (h, e.parent, e.told, e.first, e.count, e.words, e.chars, e.links)]
            rows.append((*_weights(page_id.as_py(), source), elements, [b.path for b in page.blocks], "\n".join(b.text for b in page.blocks)))
        cols = zip(*rows, strict=True) if rows else [()] * len(STORED)
        arrays = [pa.array(c, t) for c, t in zip(cols, STORED.values(), strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *arrays], ["page_id", "url", "host", *STORED])


def _blocks(paths: pa.ListScalar, text: pa.StringScalar) -> list[Block]:
    at = paths.values.to_numpy().tolist()
    return [Block(p, x, x.split(" ")) for p, x in zip(at, text.as_py().split("\n") if at else (), strict=True)]


def _page(elements: pa.ListScalar, paths: pa.ListScalar, text: pa.StringScalar) -> Page:
    numbers = elements.values.to_numpy().reshape(-1, NUMBERS).tolist()
    return Page(_blocks(paths, text), {h: Element(*x) for h, *x in numbers})


#: Kinds of rows of the partial sums.
PAGE, ELEMENT, TEXT, WORD = range(4)
SUMS = ["one", "two", "pages", "times", "place", "words", "chars", "links"]


def _code(path: int, word: str) -> int:
    return zlib.crc32(word.encode(), path & 0xFFFFFFFF) & 0xFFFF


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of stored pages (host, paths, text), part by part and host by host: the pages, the most of them that a code not listed is
    on, the codes of texts and words on LISTED of the pages or more, and on how many beyond that most."""
    names, types = ["host", "pages", "most", "codes", "more"], [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    found: dict[str, list[np.ndarray]] = {}

    def part() -> pa.RecordBatch:
        rows = []
        for host, pages in found.items():
            most = math.ceil(len(pages) * LISTED) - 1
            codes, counts = np.unique(np.concatenate(pages), return_counts=True)
            often = counts > most
            rows.append((host, len(pages), most, codes[often].tobytes(), (counts[often] - most).astype("<u4").tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    held = 0
    for batch in batches:
        for host, paths, text in zip(*batch.columns, strict=True):
            by_path: dict[int, set[str]] = {}
            codes = set()
            for b in _blocks(paths, text):
                by_path.setdefault(b.path, set()).update(b.words)
                codes.add(_hash("text", b.path, b.text) & 0xFFFF)
            for path, words in by_path.items():
                codes |= {_code(path, w) for w in words}
            found.setdefault(host.as_py(), []).append(np.fromiter(codes, "<u2", len(codes)))
            held += len(codes)
            if held > PART:
                yield part()
                found, held = {}, 0
    if found:
        yield part()


def _often(group: pd.DataFrame) -> pd.DataFrame:
    """Of a host's lists, the codes that may be on MIN_SHARE and MIN_PAGES of its pages; a list holds four mean pages' codes at most."""
    codes, which = np.unique(np.frombuffer(b"".join(group["codes"]), "<u2"), return_inverse=True)
    bound = np.bincount(which, np.frombuffer(b"".join(group["more"]), "<u4"), len(codes)) + group["most"].sum()
    codes = codes[bound >= max(MIN_PAGES, group["pages"].sum() * MIN_SHARE)]
    return pd.DataFrame({"_host": [group["host"].iloc[0]], "wanted": [codes.tobytes()], "n": [len(codes)]})


class _Wanted:
    """The codes of a host whose texts and words are counted."""

    def __init__(self, codes: bytes):
        self.codes = frozenset(np.frombuffer(codes, "<u2").tolist())
        self.hashes: dict[tuple[int, str], int] = {}

    def words(self, b: Block) -> list[int]:
        """Hashes of the block's words that are counted, repeated ones too."""
        if len(self.hashes) > FLUSH:
            self.hashes.clear()
        out = []
        for w in b.words:
            if _code(b.path, w) in self.codes:
                h = self.hashes.get((b.path, w))
                if h is None:
                    h = self.hashes[b.path, w] = _hash("word", b.path, w)
                out.append(h)
        return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums by host and token. Batches are of (host, page_id, html), of which all tokens are counted, or of stored
    pages (host, wanted, ...), of which the elements and the texts and words of the codes wanted are."""
    names = ["host", "token", "kind", "parent", "told", *SUMS]
    types = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), *[pa.int64()] * len(SUMS)]

    def flush() -> pa.RecordBatch:
        cols = zip(*((*k, *v) for k, v in found.items()), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    found: dict[tuple, list[int]] = {}
    known: dict[str, _Wanted] = {}
    for batch in batches:
        stored = "wanted" in batch.schema.names
        for row in zip(*batch.columns, strict=True):
            host, wanted = row[0].as_py(), None
            if stored:
                wanted = known.get(host)
                if wanted is None:
                    if len(known) > 1000:
                        known.clear()
                    wanted = known[host] = _Wanted(row[1].as_py() or b"")
                one, two, page = row[2].as_py(), row[3].as_py(), _page(*row[4:])
            else:
                source = row[2].as_py() or ""
                (one, two), page = _weights(row[1].as_py(), source), parse(source)
            tokens: dict[tuple, list[int]] = {}
            for h, e in page.elements.items():
                tokens[h, ELEMENT if h else PAGE, e.parent, e.told] = [e.count, e.first, e.words, e.chars, e.links]
            for i, b in enumerate(page.blocks):
                text = _hash("text", b.path, b.text)
                whole = wanted is not None and text & 0xFFFF in wanted.codes
                if whole or wanted is None:
                    tokens.setdefault((text, TEXT, b.path, NOTHING), [0, i, len(b.words), 0, 0])[0] += 1
                for h in wanted.words(b) if wanted else [_hash("word", b.path, w) for w in b.words]:
                    x = tokens.setdefault((h, WORD, b.path, NOTHING), [0, i, 0, 0, 0])
                    x[0] += 1
                    x[2] += not whole  # a whole text's words are in its own number
            for key, (n, place, words, chars, links) in tokens.items():
                x = found.setdefault((host, *key), [0] * len(SUMS))
                x[0] += one * n
                x[1] += two * n
                x[2] += 1
                x[3] += n
                x[4] += place
                x[5] += words
                x[6] += chars
                x[7] += links
        if len(found) > FLUSH:
            yield flush()
            found = {}
    if found:
        yield flush()


def template_of(group: pd.DataFrame) -> Template:
    """A host's template from the sums of its tokens of valid classes; its elements and the page's own row come whether
    their classes are valid or not."""
    rows = list(group.itertuples(index=False))
    valid = set(nested([(r.token, r.place / r.pages, r.cls, r.size) for r in rows if r.kind != PAGE and r.size >= MIN_TOKENS]))
    elements = {r.token: Element(r.parent, r.told, r.place / r.pages, r.times, r.words, r.chars, r.links) for r in rows if r.kind in (PAGE, ELEMENT)}
    regions = {r.token for r in rows if r.kind == ELEMENT and r.token in valid and r.times == r.pages}
    words: dict[int, int] = {}
    for r in rows:
        if r.token in valid and r.kind in (TEXT, WORD):
            words[r.parent] = words.get(r.parent, 0) + (r.words if r.kind == WORD else r.words // r.pages * r.times)
    found = chosen(elements, regions, words)
    return Template(found.region, found.dropped, frozenset(r.token for r in rows if r.kind == TEXT and r.token in valid))


def stored(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, ...) of every page: what parse finds in it."""
    slim = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), "html")
    ids = slim.schema["page_id"].dataType.simpleString()
    return common.materialize(slim.mapInArrow(_stored, f"page_id {ids}, url string, host string, one long, two long, elements array<long>, paths array<long>, text string"), "html-pages")


def wanted(pages: DataFrame) -> tuple[DataFrame, int]:
    """(_host, wanted) of stored pages: the codes of texts and words that may be on MIN_SHARE and MIN_PAGES of its host's pages;
    and how many these are."""
    lists = pages.select("host", "paths", "text").mapInArrow(_listed, "host string, pages long, most long, codes binary, more binary")
    found = common.materialize(lists.groupBy("host").applyInPandas(_often, "_host string, wanted binary, n long"), "html-wanted")
    return found.drop("n"), found.agg(F.sum(F.col("n") + 1)).first()[0] or 0


def templates(pages: DataFrame) -> DataFrame:
    """(host, region, dropped, texts) of stored pages: the template of each host with enough pages. Tokens on fewer than
    MIN_SHARE of its pages fall away before a host's rows meet, so these are at most twice a mean page's tokens."""
    may, n = wanted(pages)
    both = common.join_by_id(pages, may, F.col("host") == F.col("_host"), "left", n)
    parts = both.select("host", "wanted", "one", "two", "elements", "paths", "text").mapInArrow(_counted, "host string, token long, kind int, parent long, told int, " + ", ".join(f"{c} long" for c in SUMS))
    sums = common.materialize(
        parts.groupBy("host", "token", "kind", "parent", "told").agg(*(F.sum(c).alias(c) for c in SUMS)).where(F.col("pages") >= MIN_PAGES), "html-tokens"
    )
    hosts = common.materialize(sums.where(F.col("kind") == PAGE).select("host", F.col("pages").alias("all_pages")), "html-hosts")
    often = sums.join(hosts, "host").where(F.col("pages") >= F.col("all_pages") * MIN_SHARE).drop("all_pages")
    often = common.materialize(often.withColumn("cls", F.xxhash64("one", "two", "pages")), "html-often")
    sizes = common.materialize(often.where(F.col("kind") != PAGE).groupBy("host", "cls").agg(F.count("*").cast("int").alias("size")), "html-classes")
    both = often.join(sizes, ["host", "cls"], "left").withColumn("size", F.coalesce("size", F.lit(0)))
    both = both.where((F.col("size") >= MIN_TOKENS) | F.col("kind").isin(PAGE, ELEMENT)).drop("one", "two")

    def decide(group: pd.DataFrame) -> pd.DataFrame:
        t = template_of(group)
        return pd.DataFrame({"host": [group["host"].iloc[0]], "region": [t.region], "dropped": [sorted(t.dropped)], "texts": [sorted(t.texts)]})

    return both.groupBy("host").applyInPandas(decide, "host string, region long, dropped array<long>, texts array<long>")


def text_of(page: Page, template: Template | None) -> str:
    """The text of a page's main region."""
    region = template
    if region is None or region.region and region.region not in page.elements:
        region = chosen(page.elements, {h for h, e in page.elements.items() if e.count == 1}, {})
    kept = {0: region.region == 0}
    for h, e in page.elements.items():
        if h:
            kept[h] = (kept[e.parent] or h == region.region) and h not in region.dropped
    slots = [b for b in page.blocks if kept[b.path]]
    own = [b for b in slots if _hash("text", b.path, b.text) not in template.texts] if template is not None else slots
    return "\n".join(b.text for b in own or slots)


def main_text(source: str, template: Template | None) -> str:
    return text_of(parse(source), template)


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every page."""
    common.bound_batches(pages)
    slim = stored(pages)
    found = common.materialize(templates(slim).select(F.col("host").alias("_host"), F.struct("region", "dropped", "texts").alias("_template")), "html-templates")
    rows = found.agg(F.sum(1 + F.size("_template.dropped") + F.size("_template.texts"))).first()[0] or 0
    both = common.join_by_id(slim, found, F.col("host") == F.col("_host"), "left", rows).select("page_id", "url", "host", "_template", "elements", "paths", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Template] = {}
        for batch in batches:
            texts = []
            for host, t, *page in zip(*batch.columns[2:], strict=True):
                template = None
                if t.is_valid:
                    template = known.get(host := host.as_py())
                    if template is None:
                        if len(known) > 1000:
                            known.clear()
                        region, dropped, whole = t.as_py().values()
                        template = known[host] = Template(region, frozenset(dropped), frozenset(whole))
                texts.append(text_of(_page(*page), template))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    ids = slim.schema["page_id"].dataType.simpleString()
    return both.mapInArrow(run, f"page_id {ids}, url string, text string, n_chars long")
