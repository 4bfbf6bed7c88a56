"""A directory's business search: the queries that a master row asks, the candidates on its result pages, and whether the
chain of pages that a query leads through was seen in full.

A page is parsed once, in its task; what it mentions is merged by aggregates. Nothing of a page is gathered but its
mentions of one profile, and of those a few best values are kept.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import product
from urllib.parse import parse_qs, urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywort.functions.text import aliases, blank, match_text, plain_term
from tallywort.operators.profiles import PROFILE, STATE_AND_ZIP, address_in, name_from_slug, profile_base

#: How far around an anchor its card is looked for, in elements and characters; result pages of a query.
LEVELS, LEAST_CARD, MOST_CARD = 6, 20, 1400
MAX_PAGES = 3
#: Elements without an end, those that end where the next of their kind begins, and those whose text isn't shown.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
ENDED_BY_NEXT = {"p", "li", "dt", "dd", "td", "th", "tr", "option"}
HIDDEN = {"script", "style", "template"}
#: Ways of saying that a search found nothing.
NOTHING = [" ".join(w for w in words if w) for words in product(["no", "0"], ["", "matching"], ["business", "businesses", "result", "results"])] + [
    " ".join(w for w in words if w) for words in product(["could not find", "couldn t find"], ["", "any"], ["business", "businesses", "result", "results"])
]
FIELDS = ["address", "city", "state", "zip"]
MENTION = "page_id long, place int, kind string, url string, name string, card string, " + ", ".join(f"{f} string" for f in FIELDS)


# --- reading a result page -----------------------------------------------------------------------------------------

class _Page(HTMLParser):
    """The shown text of a page in pieces, each element's stretch of them, its anchors and its scripts."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.pieces: list[str] = []
        self.ends_at = [0]  # characters up to the end of each piece, with a space behind each
        self.parent: list[int] = []
        self.begin: list[int] = []
        self.end: list[int] = []
        self.stack: list[tuple[str, int]] = []
        self.open: Counter[str] = Counter()
        self.anchors: list[tuple[int, dict]] = []
        self.scripts: list[list[str]] = []

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.handle_endtag("a")
        elif tag in ENDED_BY_NEXT and self.stack and self.stack[-1][0] == tag:
            self._close()
        self.parent.append(self.stack[-1][1] if self.stack else -1)
        self.begin.append(len(self.pieces))
        self.end.append(len(self.pieces))
        node = len(self.parent) - 1
        if tag == "a":
            self.anchors.append((node, dict(attrs)))
        if tag == "script":
            self.scripts.append([])
        if tag not in VOID:
            self.stack.append((tag, node))
            self.open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._close()

    def _close(self) -> str:
        tag, node = self.stack.pop()
        self.open[tag] -= 1
        self.end[node] = len(self.pieces)
        return tag

    def handle_endtag(self, tag):
        if self.open[tag] > 0:
            while self._close() != tag:
                pass

    def handle_data(self, data):
        if self.open["script"]:
            if self.scripts:
                self.scripts[-1].append(data)
        elif not any(self.open[t] for t in HIDDEN) and (piece := " ".join(data.split())):
            self.pieces.append(piece)
            self.ends_at.append(self.ends_at[-1] + len(piece) + 1)

    def finish(self) -> None:
        self.close()
        while self.stack:
            self._close()

    def size(self, node: int) -> int:
        return max(0, self.ends_at[self.end[node]] - self.ends_at[self.begin[node]] - 1)

    def text(self, node: int) -> str:
        return " ".join(self.pieces[self.begin[node] : self.end[node]])

    def card(self, node: int) -> str:
        """The text of the nearest element around an anchor that is of a card's size and names a place; without one, of
        the farthest of a card's size, else of the anchor."""
        best = self.text(node)
        for _ in range(LEVELS):
            node = self.parent[node]
            if node < 0:
                break
            if LEAST_CARD <= self.size(node) <= MOST_CARD:
                best = self.text(node)
                if re.search(STATE_AND_ZIP, best):
                    break
        return best


def _objects(scripts: list[list[str]]) -> Iterator[dict]:
    """All objects in scripts that are JSON, outer ones before inner ones, in order."""
    for parts in scripts:
        raw = "".join(parts).strip()
        if raw[:1] not in ("{", "["):
            continue
        try:
            todo = [json.loads(raw)]
        except (ValueError, RecursionError):
            continue
        while todo:
            node = todo.pop()
            if isinstance(node, dict):
                yield node
                todo.extend(reversed(list(node.values())))
            elif isinstance(node, list):
                todo.extend(reversed(node))


def _plain(*values) -> str:
    """The first value that is a filled scalar."""
    return next((" ".join(str(v).split()) for v in values if isinstance(v, (str, int, float)) and str(v).strip()), "")


def _page_number(url: str) -> int:
    said = (parse_qs(urlsplit(url).query).get("page") or ["1"])[0]
    return max(1, int(said)) if said.strip().isdigit() else 1


def _next_page(page: _Page, url: str, path: str) -> str:
    """The link to the next result page: one that calls itself so, else the first to the following number."""
    number, fallback = _page_number(url), ""
    for node, attrs in page.anchors:
        try:
            link = urljoin(url, attrs.get("href") or "")
            if not attrs.get("href") or urlsplit(link).path.rstrip("/") != path:
                continue
        except ValueError:
            continue
        label = " ".join([page.text(node), attrs.get("aria-label") or "", attrs.get("rel") or ""]).lower()
        if "next" in label:
            return link
        if not fallback and _page_number(link) == number + 1:
            fallback = link
    return fallback


def mentions_of(html: str, url: str, profile: str, path: str) -> list[tuple]:
    """A page's mentions of profiles, anchors first and then embedded objects, behind one row of the page itself: kind,
    url, name, card and location."""
    page = _Page()
    page.feed(html)
    page.finish()
    words = " " + " ".join(re.sub("[^a-z0-9]+", " ", " ".join(page.pieces).lower()).split()) + " "
    none = any(f" {said} " in words for said in NOTHING)
    out = [("page", _next_page(page, url, path), "none" if none else "", "", "", "", "", "")]
    is_profile = re.compile(profile)
    for node, attrs in page.anchors:
        try:
            link = urljoin(url, attrs.get("href") or "")
        except ValueError:
            continue
        if attrs.get("href") and is_profile.search(link):
            out.append(("anchor", link, page.text(node), page.card(node)[:MOST_CARD], "", "", "", ""))
    for item in _objects(page.scripts):
        raw = _plain(item.get("profileUrl"), item.get("profileURL"), item.get("url"))
        try:
            link = urljoin(url, raw)
        except ValueError:
            continue
        if not raw or not is_profile.search(link):
            continue
        at = item.get("address")
        if isinstance(at, dict):
            place = (_plain(at.get("streetAddress"), at.get("address")), _plain(at.get("addressLocality"), at.get("city")), _plain(at.get("addressRegion"), at.get("state")), _plain(at.get("postalCode"), at.get("postalcode")))
        else:
            place = (_plain(at), _plain(item.get("city")), _plain(item.get("state")), _plain(item.get("postalcode"), item.get("postalCode")))
        out.append(("object", link, _plain(item.get("businessName"), item.get("name")), "", *place))
    return out


#: Pages that a Python worker gets at once, where the session doesn't set a number of its own, and characters of mentions that leave it at once.
PAGES_A_BATCH, FLUSH_CHARS = 500, 1 << 20
_ROWS_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def mention_batches(batches: Iterator[pa.RecordBatch], profile: str, path: str) -> Iterator[pa.RecordBatch]:
    """The mentions of the pages (page_id, url, html) of batches, page by page; what a worker holds is a batch of pages, one page's
    mentions and FLUSH_CHARS of others."""
    names, kinds = ["page_id", "place", "kind", "url", "name", "card", *FIELDS], [pa.int64(), pa.int32(), *[pa.string()] * 8]

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    rows, chars = [], 0
    for batch in batches:
        for page_id, url, html in zip(*batch.columns, strict=True):
            for place, m in enumerate(mentions_of(html.as_py() or "", url.as_py() or "", profile, path)):
                rows.append((page_id.as_py(), place, *m))
                chars += sum(map(len, m))
                if chars >= FLUSH_CHARS:
                    yield flush()
                    rows, chars = [], 0
    if rows:
        yield flush()


def mentions(pages: DataFrame, profile: str = PROFILE, path: str = "/search") -> DataFrame:
    """What result pages (page_id, url, html) mention, each parsed once: a row of kind page for each (url: the link to
    the next page; name: "none" where it says that nothing was found), and one for each anchor and embedded object whose
    URL matches the pattern profile. Null html is an empty page; a page_id should be a page's own."""
    conf = pages.sparkSession.conf
    if conf.get(_ROWS_SETTING) == "10000":
        conf.set(_ROWS_SETTING, str(PAGES_A_BATCH))

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(lambda batches: mention_batches(batches, profile, path), MENTION)


def candidates(found: DataFrame) -> DataFrame:
    """(page_id, profile_url, name, address, city, state, zip, card_text, place, n_mentions): the profiles of each page,
    merged from its mentions: the longest name of its anchors (of equal ones the first; an empty one as the URL spells
    it), else the first of its objects; of each location part the first that is filled, anchors' cards before objects."""
    m = found.where("kind <> 'page'").withColumn("profile_url", profile_base(F.col("url")))
    m = m.withColumn("name", F.when(F.col("name") == "", name_from_slug(F.col("profile_url"))).otherwise(F.col("name"))).withColumn("at", address_in(F.col("card")))
    part = lambda f: F.when(F.col("kind") == "anchor", F.col(f"at.{f}")).otherwise(F.upper(f) if f == "state" else F.col(f))
    m = m.select("page_id", "profile_url", "kind", "place", "name", "card", *(part(f).alias(f) for f in FIELDS))
    anchor = F.col("kind") == "anchor"
    longest = F.max_by("name", F.when(anchor, F.struct(F.length("name"), -F.col("place"))))
    first = lambda c, ok: F.min_by(c, F.when(ok, F.col("place")))
    return m.groupBy("page_id", "profile_url").agg(
        F.coalesce(longest, first("name", ~anchor)).alias("name"), *(F.coalesce(first(f, F.col(f) != ""), F.lit("")).alias(f) for f in FIELDS),
        F.coalesce(first("card", anchor), F.lit("")).alias("card_text"), F.min("place").alias("place"), F.count("*").alias("n_mentions"),
    )


# --- queries and chains of pages -----------------------------------------------------------------------------------

def location_query(city: Column, state: Column, zip_code: Column) -> Column:
    """How a place is asked for: city and state, with the ZIP if there is one; else the ZIP, else the state."""
    c, s, z = F.trim(blank(city)), F.upper(F.trim(blank(state))), F.trim(blank(zip_code))
    both = F.concat(c, F.lit(", "), s, F.when(z != "", F.concat(F.lit(" "), z)).otherwise(""))
    return F.when((c != "") & (s != ""), both).when(z != "", z).otherwise(s)


def search_url(endpoint: str, term: Column, location: Column, page: Column) -> Column:
    where = F.when(location != "", F.concat(F.lit("&find_loc="), F.url_encode(location))).otherwise("")
    return F.concat(F.lit(endpoint + "?find_country=USA&find_text="), F.url_encode(term), F.lit("&page="), F.greatest(page, F.lit(1)).cast("string"), where)


def asked(url: Column) -> Column:
    """(term, location, page) that a search URL asks for, term and location in the form in which they are compared."""
    said = lambda name: F.coalesce(F.try_url_decode(F.regexp_extract(blank(url), rf"[?&]{name}=([^&#]*)", 1)), F.lit(""))
    number = F.trim(said("page")).try_cast("int")
    return F.struct(match_text(said("find_text")).alias("term"), match_text(said("find_loc")).alias("location"), F.greatest(F.coalesce(number, F.lit(1)), F.lit(1)).alias("page"))


def searches(master: DataFrame, owner: str, endpoint: str) -> DataFrame:
    """(owner, url, term, location): the first pages of the searches for each master row's names, one for each term and
    place that differ once folded."""
    where = location_query(F.col("city"), F.col("state"), F.col("zip"))
    named = master.select(F.col(owner).alias("owner"), where.alias("where"), F.posexplode(aliases(F.col("contractor_name"), F.col("related_companies"))).alias("place", "alias"))
    terms = named.withColumn("said", plain_term(F.col("alias"))).where("said <> ''")
    keyed = terms.withColumns({"term": match_text(F.col("said")), "location": match_text(F.col("where"))})
    first = keyed.groupBy("owner", "term", "location").agg(F.min(F.struct("place", "said", "where")).alias("f"))
    return first.select("owner", search_url(endpoint, F.col("f.said"), F.col("f.where"), F.lit(1)).alias("url"), "term", "location")


def result_pages(found: DataFrame, pages: DataFrame) -> DataFrame:
    """(term, location, page, next_term, next_location, next_page, recognised, n_candidates) of result pages (page_id,
    url) and their mentions. A page without candidates is recognised only if it says that there are none."""
    per = found.groupBy("page_id").agg(
        F.count(F.when(F.col("kind") != "page", 1)).alias("n_candidates"), F.bool_or((F.col("kind") == "page") & (F.col("name") == "none")).alias("none"),
        F.max(F.when(F.col("kind") == "page", F.col("url"))).alias("next"),
    )
    j = pages.select("page_id", "url").join(per, "page_id", "left")
    own, following = asked(F.col("url")), F.when(blank(F.col("next")) != "", asked(F.col("next")))
    return j.select(
        own["term"].alias("term"), own["location"].alias("location"), own["page"].alias("page"), following["term"].alias("next_term"), following["location"].alias("next_location"),
        following["page"].alias("next_page"), ((F.col("n_candidates") > 0) | F.coalesce("none", F.lit(False))).alias("recognised"), F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"),
    )


def page_chains(pages: DataFrame, key: list[str], max_pages: int = MAX_PAGES) -> DataFrame:
    """(*key, n_pages, complete, reason): whether each query's result pages (key, page, next_*key, next_page, recognised)
    were seen from the first to one without a next.

    What breaks a chain is its reason: missing (no first page), unknown (a page of unknown layout), foreign (the next page
    is another query's), loop (it isn't a later one), gap (pages are left out, or the next was not fetched) or too_long
    (more than max_pages). The first page that breaks it decides; n_pages counts the pages up to there. A broken chain
    makes its owner incomplete, never empty. Of several rows of a page, any unknown one counts, and the least next page.

    As only the pages numbered up to max_pages can matter, each is one conditional aggregate; no query's pages are sorted
    or gathered.
    """
    same = F.lit(True)
    for k in key:
        same = same & F.col(f"next_{k}").eqNullSafe(F.col(k))
    verdict = (
        F.when(~F.coalesce("recognised", F.lit(False)), "unknown").when(F.col("next_page").isNull(), "end").when(~same, "foreign")
        .when(F.col("next_page") <= F.col("page"), "loop").when(F.col("next_page") > F.col("page") + 1, "gap").otherwise("next")
    )
    rank = ["unknown", "foreign", "loop", "gap", "next", "end"]
    told = pages.withColumn("_v", F.array_position(F.array(*map(F.lit, rank)), verdict))
    seen = told.groupBy(*key).agg(*(F.min(F.when(F.col("page") == i, F.col("_v"))).alias(f"_{i}") for i in range(1, max_pages + 1)))
    reason, n = F.lit("too_long"), F.lit(max_pages)
    for i in range(max_pages, 0, -1):
        v = F.coalesce(F.col(f"_{i}"), F.lit(0).cast("long"))
        broken = F.element_at(F.array(*map(F.lit, rank)), F.greatest(v, F.lit(1)).cast("int"))
        reason = F.when(v == 0, "missing" if i == 1 else "gap").when(v == rank.index("end") + 1, "").when(v == rank.index("next") + 1, reason).otherwise(broken)
        n = F.when(v == 0, i - 1).when(v == rank.index("next") + 1, n).otherwise(i)
    return seen.select(*key, n.cast("int").alias("n_pages"), (reason == "").alias("complete"), reason.alias("reason"))


def owner_searches(searches_: DataFrame, chains: DataFrame) -> DataFrame:
    """(owner, n_queries, n_incomplete, complete, reasons): each owner's searches (owner, term, location), complete only if
    every chain is; a search without any page counts as missing. reasons are the distinct ones, of which there are six."""
    j = searches_.join(chains, ["term", "location"], "left").withColumn("reason", F.coalesce("reason", F.lit("missing")))
    bad = F.col("reason") != ""
    return j.groupBy("owner").agg(
        F.count("*").alias("n_queries"), F.count(F.when(bad, 1)).alias("n_incomplete"), (F.count(F.when(bad, 1)) == 0).alias("complete"),
        F.array_sort(F.collect_set(F.when(bad, F.col("reason")))).alias("reasons"),
    )
