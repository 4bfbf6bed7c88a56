"""The finite list of suspended and debarred vendors of one state, as published on a search page."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywort.functions.text import aliases, company_core, location_parts
from tallywort.operators.extract import VOID
from tallywort.operators.findings import active_on
from tallywort.operators.identity import location_corroborates

#: Classes of the page's parts, and the kinds of dates that an entry states.
LIST, ENTRY, HEADING = "search-results", "results", "result-link"
KINDS = ["Suspension", "Debarment"]
SCHEMA = "name string, lines array<string>, fields map<string,string>, anchor string"


class _Entries(HTMLParser):
    """Entries of a list page: the heading's link, rows of two cells as fields, rows of one as address lines."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, set[str]]] = []
        self.entries: list[dict] = []
        self.cells: list[str] = []
        self.all: list[str] = []

    def _within(self, name: str) -> int:
        return next((i + 1 for i in range(len(self.stack) - 1, -1, -1) if name in self.stack[i][1]), 0)

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        classes = set((a.get("class") or "").split())
        if ENTRY in classes and self._within(LIST):
            self.entries.append({"name": None, "lines": [], "fields": {}, "anchor": ""})
        elif self.entries and self._within(ENTRY):
            if tag == "a" and self._within(HEADING) and self.entries[-1]["name"] is None:
                self.entries[-1] |= {"name": "", "anchor": a.get("id") or ""}
            if tag == "tr":
                self.cells = []
            if tag == "td":
                self.cells.append("")
        if tag not in VOID:
            self.stack.append((tag, classes))

    def handle_data(self, data):
        self.all.append(data)
        names = [t for t, _ in self.stack]
        if self.entries and self._within(ENTRY):
            if "td" in names and self.cells:
                self.cells[-1] += data
            elif "a" in names and self._within(HEADING):
                self.entries[-1]["name"] += data

    def handle_endtag(self, tag):
        if tag == "tr" and self.entries and self._within(ENTRY):
            cells = [" ".join(c.split()) for c in self.cells]
            if len(cells) == 2:
                self.entries[-1]["fields"][cells[0].rstrip(":")] = cells[1]
            elif len(cells) == 1:
                self.entries[-1]["lines"].append(cells[0])
            self.cells = []
        if tag in [t for t, _ in self.stack]:
            while self.stack.pop()[0] != tag:
                pass


def entries_of(html: str) -> list[dict]:
    """A page's entries. An error if the page doesn't state that it shows all of them, or shows another number: from a
    list that may be incomplete nothing is concluded."""
    reader = _Entries()
    reader.feed(html or "")
    reader.close()
    shown = re.search(r"Results +([0-9]+) *- *([0-9]+) +of +([0-9]+)", " ".join(" ".join(reader.all).split()))
    n = len(reader.entries)
    if shown is None or [int(x) for x in shown.groups()] != [1, n, n]:
        raise ValueError("the list is incomplete or its layout changed")
    for e in reader.entries:
        e["name"] = " ".join((e["name"] or "").split())
        if not e["name"]:
            raise ValueError("an entry has no name")
    return reader.entries


def listed_vendors(pages: DataFrame) -> DataFrame:
    """(url, place, name, address, city, state, zip, fields, source_url) of the entries of list pages (url, html)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(u, i, e["name"], e["lines"], e["fields"], e["anchor"]) for u, h in zip(b["url"], b["html"], strict=True) for i, e in enumerate(entries_of(h))]
            yield pd.DataFrame(rows, columns=["url", "place", "name", "lines", "fields", "anchor"])

    found = pages.select("url", "html").mapInPandas(run, f"url string, place int, {SCHEMA}")
    located = F.filter(F.transform("lines", location_parts), lambda p: p["state"] != "")
    where = lambda part: F.coalesce(F.get(located, F.lit(0))[part], F.lit("")).alias(part)
    return found.select(
        "url", "place", "name", F.coalesce(F.get("lines", F.lit(0)), F.lit("")).alias("address"), where("city"), where("state"), where("zip"),
        "fields", F.concat("url", F.lit("#"), "anchor").alias("source_url"),
    )


def active(vendors: DataFrame, today: Column) -> DataFrame:
    """(url, place, active): whether an entry's suspension or debarment holds today; null where its dates are unclear."""
    one = lambda k: F.struct(F.coalesce(F.element_at("fields", F.lit(f"{k} Date")), F.lit("")).alias("start"), F.coalesce(F.element_at("fields", F.lit(f"{k} End Date")), F.lit("")).alias("end"))
    terms = vendors.select(F.struct("url", "place").alias("entry"), F.explode(F.array(*map(one, KINDS))).alias("term"))
    return active_on(terms.select("entry", "term.start", "term.end"), "entry", today).select("entry.url", "entry.place", "active")


def candidates(vendors: DataFrame, contractors: DataFrame) -> DataFrame:
    """(owner, url, place, confirmed): contractors (owner, contractor_name, related_companies, address_1, city, state,
    zip) one of whose names has the core of an entry's name; confirmed where their locations agree."""
    named = contractors.select("*", F.explode(aliases(F.col("contractor_name"), F.col("related_companies"))).alias("_alias")).withColumn("_core", company_core(F.col("_alias")))
    v = vendors.select("url", "place", *(F.col(c).alias(f"v_{c}") for c in ("address", "city", "state", "zip")), company_core(F.col("name")).alias("_core")).where("_core <> ''")
    both = v.join(named, "_core")
    there = {k: F.col(f"v_{k}") for k in ("address", "city", "state", "zip")}
    own = {"address": F.col("address_1"), "city": F.col("city"), "state": F.col("state"), "zip": F.col("zip")}
    return both.groupBy("owner", "url", "place").agg(F.bool_or(location_corroborates(there, own)).alias("confirmed"))
