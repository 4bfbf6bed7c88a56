"""Records from HTML: JSON-LD, tables, definition lists and labelled blocks, in that order of trust.

Parsing needs a stack of open elements, so pages go through one vectorised map; everything after it, the
first-wins dedupe and the merging of partial records, is DataFrame work.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywort.functions import finders

#: Labels by field. Labels of the master table come before general ones.
MASTER_LABELS = {
    "bidder_id": ["id", "bidder id", "contractor id"],
    "contractor_name": ["contractor_name", "contractor name", "bidder name"],
    "related_companies": ["related_companies", "related companies", "related company", "affiliated companies"],
    "address_1": ["address_1", "address 1", "primary address"],
    "city": ["city"],
    "state": ["state"],
    "zip": ["zip", "zip code", "postal code"],
    "additional_address": ["additional_address", "additional address", "secondary address"],
    "additional_address_city": ["additional_address_city", "additional address city", "secondary address city"],
    "additional_address_state": ["additional_address_state", "additional address state", "secondary address state"],
    "additional_address_zip": ["additional_address_zip", "additional address zip", "secondary address zip"],
    "dfi": ["dfi", "department of financial institutions", "wisconsin dfi"],
    "wc": ["wc", "workers comp", "workers compensation", "worker's compensation"],
    "wc_date": ["wc_date", "wc date", "workers comp date", "workers compensation date"],
    "osha_severe_violations": ["osha_severe_violations", "osha severe violations", "severe osha violations"],
    "years": ["years", "year(s)", "violation years"],
    "osha": ["osha", "osha flag"],
    "state_federal_debarment": ["state_federal_debarment", "state federal debarment", "state/federal debarment", "debarment"],
    "mndol_ineligibility": ["mndol_ineligibility", "mndol ineligibility", "mn dol ineligibility", "minnesota dol ineligibility"],
    "public_works_projects_budget_time_quality_complaint": [
        "public_works_projects_budget_time_quality_complaint", "public works projects budget time quality complaint", "public works complaint",
    ],
    "federal_court": ["federal_court", "federal court"],
    "circuit_court": ["circuit_court", "circuit court"],
    "ccap_show150": ["ccap_show150", "ccap show150", "ccap show 150", "ccap"],
    "environmental_violations": ["environmental_violations", "environmental violations"],
    "prevailing_wage_violations": ["prevailing_wage_violations", "prevailing wage violations"],
    "dwd": ["dwd", "department of workforce development", "wisconsin dwd"],
    "dwd_substance_abuse_plan": ["dwd_substance_abuse_plan", "dwd substance abuse plan", "substance abuse plan"],
    "better_business_bureau_complaints": ["better_business_bureau_complaints", "better business bureau complaints", "bbb complaints", "bbb"],
    "misc_violations": ["misc_violations", "misc violations", "miscellaneous violations"],
    "tax_liability": ["tax_liability", "tax liability"],
}
LABELS = {
    "name": ["name", "full name", "person", "person name", "contact", "contact name", "member", "attorney"],
    "company": ["company", "company name", "business", "business name", "legal business name", "organization", "organisation", "employer", "firm"],
    "owner": ["owner", "owner name", "business owner", "business owner name", "name of owner"],
    "phone": ["phone", "telephone", "tel", "mobile", "cell"],
    "address": ["address", "street address", "mailing address", "business address", "physical address"],
    "location": ["location", "business location", "city", "city/state", "city / state", "city, state"],
    "osha_status": ["osha status", "osha violation status", "osha violations status"],
    "osha_details": ["osha violations", "open osha violations", "osha details", "osha violation details", "osha findings"],
    "date": ["date", "updated", "update date", "filed", "filed date", "record date", "created"],
    "external_id": ["record id", "case id", "license id", "number", "record number"],
}
#: Classes of elements that hold one record each, types of JSON-LD that describe a business or person, and
#: elements without an end.
RECORD_CLASSES = ["card", "result", "results-item", "listing", "listing-item", "record", "profile", "directory-item"]
TYPES = ["Person", "Organization", "LocalBusiness", "ProfessionalService", "Attorney"]
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]
FIELDS = [*LABELS, *MASTER_LABELS]
_FIELD_OF = {label: f for table in (LABELS, MASTER_LABELS) for f, labels in table.items() for label in labels}
MAX_HEADING = 160


def field_for(label: str) -> str | None:
    """The field that a header or label names."""
    return _FIELD_OF.get(" ".join(label.lower().split()).rstrip(":").rstrip())


def safe_link(href: str, page: str) -> str:
    """The link's absolute URL if it is plain http(s), else the page's."""
    try:
        url = urljoin(page, href)
        parts = urlsplit(url)
        return url if parts.scheme in ("http", "https") and parts.hostname and not parts.username else page
    except ValueError:
        return page


def has_signal(record: dict) -> bool:
    """Whether a record names someone and says something of them."""
    who = ("name", "company", "owner", "contractor_name")
    what = [f for f in FIELDS if f not in who]
    return any(record.get(f) for f in who) and (any(record.get(f) for f in what) or bool(record.get("company") and record.get("owner")))


#: Least and greatest length of a block that is read as a record, and what is looked for in its text.
MIN_BLOCK, MAX_BLOCK = 20, 5000
FINDERS = {"phone": finders.find_phone, "address": finders.find_street, "date": finders.find_date}


class _Reader(HTMLParser):
    """Collects JSON-LD, table rows, definition pairs, label lines and links of a page in one pass."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[str] = []
        self.json: list[str] = []
        self.tables: list[list[list[tuple[str, str]]]] = []
        self.lists: list[list[tuple[str, str]]] = []
        self.blocks: list[list[str]] = []
        self.heads: list[str] = []
        self.links: list[str] = []
        self.base = ""
        self.text: list[str] = []
        self.href = ""
        self.ld = False
        self.open_blocks: list[tuple[int, int]] = []  # depth, and number of the block
        self.whole: set[int] = set()  # blocks that hold one record each
        self.block_texts: dict[int, list[str]] = {}
        self.block_heads: dict[int, str] = {}
        self.block_links: dict[int, str] = {}

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "base" and a.get("href"):
            self.base = a["href"]
        if tag == "link" and "next" in (a.get("rel") or "").lower().split() and a.get("href"):
            self.links.append(a["href"])
        if tag == "script":
            self.ld = (a.get("type") or "").lower() == "application/ld+json"
            if self.ld:
                self.json.append("")
        if tag in ("table",):
            self.tables.append([])
        if tag == "tr" and self.tables:
            self.tables[-1].append([])
        if tag == "dl":
            self.lists.append([])
        if tag in ("article", "section", "li", "div"):
            self.blocks.append([])
            self.open_blocks.append((len(self.stack), len(self.blocks) - 1))
            if tag == "article" or set((a.get("class") or "").lower().split()) & set(RECORD_CLASSES):
                self.whole.add(len(self.blocks) - 1)
        if tag in ("td", "th", "dt", "dd", "p", "h1", "h2", "h3", "h4", "li", "span", "strong"):
            self.text, self.href = [], ""
        if tag == "a" and a.get("href"):
            self.links.append(a["href"])
            self.href = self.href or a["href"]
            for _, i in self.open_blocks:
                self.block_links.setdefault(i, a["href"])
        if tag not in VOID:
            self.stack.append(tag)

    def handle_data(self, data):
        if self.stack and self.stack[-1] in ("script", "style"):
            if self.ld and self.json:
                self.json[-1] += data
            return
        self.text.append(data)
        for _, i in self.open_blocks:
            if i in self.whole:
                self.block_texts.setdefault(i, []).append(data)

    def handle_endtag(self, tag):
        if tag not in self.stack:
            return
        while self.stack and self.stack.pop() != tag:
            pass
        closed = [i for depth, i in self.open_blocks if depth >= len(self.stack)]
        self.open_blocks = [x for x in self.open_blocks if x[0] < len(self.stack)]
        value = " ".join("".join(self.text).split())
        if tag in ("td", "th") and self.tables and self.tables[-1]:
            self.tables[-1][-1].append((value, self.href))
        elif tag in ("dt", "dd") and self.lists:
            self.lists[-1].append((tag, value))
        elif tag in ("h1", "h2", "h3", "h4"):
            self.heads.append(value)
            for _, i in self.open_blocks:
                if 2 <= len(value) <= MAX_HEADING:
                    self.block_heads.setdefault(i, value)
        elif tag in ("p", "li", "div", "article", "section") and self.blocks and value:
            own = closed[-1:] or [i for _, i in self.open_blocks[-1:]] or [len(self.blocks) - 1]
            self.blocks[own[0]].append(value)
            for _, i in self.open_blocks:
                if i != own[0] and i in self.whole:
                    self.blocks[i].append(value)
            self.text = []


def _walk(node, found: list[dict]) -> None:
    """Typed JSON-LD objects, inner ones before outer ones."""
    for child in node if isinstance(node, list) else node.values() if isinstance(node, dict) else ():
        _walk(child, found)
    if isinstance(node, dict):
        kinds = node.get("@type")
        if set(kinds if isinstance(kinds, list) else [kinds]) & set(TYPES):
            found.append(node)


def records_of(html: str, url: str) -> list[dict]:
    """A page's records, in order of trust, each with the extractor that made it."""
    r = _Reader()
    r.feed(html or "")
    r.close()
    page = safe_link(r.base, url) if r.base else url
    out: list[dict] = []
    for text in r.json:
        try:
            found: list[dict] = []
            _walk(json.loads(text), found)
        except ValueError:
            continue
        for n in found:
            address = n.get("address")
            if isinstance(address, dict):
                address = ", ".join(str(address[k]) for k in ("streetAddress", "addressLocality", "addressRegion", "postalCode") if address.get(k))
            kinds = n["@type"] if isinstance(n["@type"], list) else [n["@type"]]
            who = "name" if "Person" in kinds or "Attorney" in kinds else "company"
            out.append({who: str(n.get("name") or ""), "phone": str(n.get("telephone") or ""), "address": str(address or ""), "source_url": safe_link(str(n.get("url") or ""), page), "extractor": "jsonld"})
    for rows in r.tables:
        header = [field_for(t) for t, _ in rows[0]] if rows else []
        for row in rows[1:]:
            rec = {f: t for f, (t, _) in zip(header, row, strict=False) if f and t}
            link = next((h for _, h in row if h), "")
            out.append({**rec, "source_url": safe_link(link, page) if link else url, "extractor": "table"})
    for items in r.lists:
        rec, label = {}, None
        for tag, t in items:
            if tag == "dt":
                label = field_for(t)
            elif label and label not in rec:
                rec[label] = t
        out.append({**rec, "source_url": url, "extractor": "list"})
    for i, lines in enumerate(r.blocks):
        body = " ".join(" ".join(r.block_texts.get(i, [])).split()) or " ".join(lines)
        if MIN_BLOCK <= len(body) <= MAX_BLOCK:
            rec = {}
            for line in lines:
                label, mark, value = line.partition(":")
                f = field_for(label) if mark else None
                if f and value.strip():
                    rec[f] = value.strip()
            if i in r.whole:
                for f, find in FINDERS.items():
                    if f not in rec and (value := find(body)):
                        rec[f] = value
            if rec and "name" not in rec and "company" not in rec and (head := r.block_heads.get(i) or (r.heads[:1] or [""])[0]):
                rec["name"] = head
            link = r.block_links.get(i) if i in r.whole else None
            out.append({**rec, "source_url": safe_link(link, page) if link else url, "extractor": "block"})
    return [x for x in out if has_signal(x)]


COLUMNS = ["source_url", "extractor", *FIELDS]


def extract_records(pages: DataFrame) -> DataFrame:
    """(page_id, place, source_url, extractor, fields) of pages (page_id, url, html)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, i, *(r.get(c, "") for c in COLUMNS)) for p, u, h in zip(b["page_id"], b["url"], b["html"], strict=True) for i, r in enumerate(records_of(h or "", u or ""))]
            yield pd.DataFrame(rows, columns=["page_id", "place", *COLUMNS])

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, place int, " + ", ".join(f"{c} string" for c in COLUMNS))


def first_wins(records: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Of records of equal key the first in order."""
    rest = [c for c in records.columns if c not in key and c not in order]
    best = records.groupBy(*key).agg(F.min(F.struct(*order, *rest)).alias("_r"))
    return best.select(*key, *(F.col(f"_r.{c}").alias(c) for c in (*order, *rest)))


def merged_profiles(records: DataFrame, key: str) -> DataFrame:
    """One record a profile: the longest name, and of other fields the first that is filled, by place."""
    filled = lambda c: F.min_by(c, F.when(F.col(c) != "", F.col("place")))
    rest = [c for c in FIELDS if c != "name" and c in records.columns]
    longest = F.max_by("name", F.struct(F.length("name"), -F.col("place")))
    return records.groupBy(key).agg(longest.alias("name"), *(F.coalesce(filled(c), F.lit("")).alias(c) for c in rest))
