"""Result pages of a business search, chains of pages, finders and aliases in running text."""

import itertools
import json
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallywort.functions import finders, urls
from tallywort.sources import business_search as bs
from tallywort.sources import payloads

HOST = "https://directory.example"
P = HOST + "/us/wi/madison/profile/roofing/"


def merged(spark, html, url=HOST + "/search?find_text=x&page=1"):
    found = bs.mentions(spark.createDataFrame([(1, url, html)], "page_id long, url string, html string"))
    return {r["profile_url"].rsplit("/", 1)[1]: r for r in bs.candidates(found).collect()}


CARDS = """
<html><body><script>var x = "<a href='/us/wi/madison/profile/roofing/not-this-1'>";</script><style>a{}</style><main>
<article class="r"><h3><a href="/us/wi/madison/profile/roofing/acme-roofing-0694-1000">Acme</a></h3><p>Roofing</p>
  <div>12 Oak Rd, Madison, WI 53703</div><a href="/us/wi/madison/profile/roofing/acme-roofing-0694-1000/complaints?x=1">Acme Roofing &amp; Sons</a></article>
<article><a href="/us/wi/dane/profile/paving/gamma-paving-0694-2000"><img src=x></a><p>Dane, WI 53529-1234<p>no end tags<li>one<li>two</article>
<article><a href="/about">About</a><a href="/us/wi/dane/profile/paving/far-off-0694-3000">Far</a></article>
</main></body></html>
"""
OBJECTS = """<div id=root></div><script type="application/json">%s</script><script>not json {</script><script type="application/ld+json">[{"url": 5}, null]</script>"""


def test_cards_of_anchors(spark):
    got = merged(spark, CARDS)
    assert set(got) == {"acme-roofing-0694-1000", "gamma-paving-0694-2000", "far-off-0694-3000"}
    a = got["acme-roofing-0694-1000"]
    assert (a["name"], a["address"], a["city"], a["state"], a["zip"], a["n_mentions"]) == ("Acme Roofing & Sons", "12 Oak Rd", "Madison", "WI", "53703", 2)
    g = got["gamma-paving-0694-2000"]
    assert (g["name"], g["address"], g["city"], g["zip"]) == ("Gamma Paving", "", "Dane", "53529-1234")
    assert got["far-off-0694-3000"]["name"] == "Far" and "About" in got["far-off-0694-3000"]["card_text"]


def test_objects_fill_what_anchors_lack(spark):
    data = {"results": [
        {"businessName": "Long Name of Acme Incorporated", "profileUrl": P + "acme-1000", "address": {"streetAddress": "1 Elm St", "addressLocality": "Madison", "addressRegion": "wi", "postalCode": 53703}},
        {"name": "Alpha", "url": P + "alpha-2000", "address": "9 Park Dr", "city": "Verona", "state": "wi", "postalcode": "53593", "more": {"profileURL": P + "inner-3000"}},
        {"name": "Alpha again", "url": P + "alpha-2000", "city": "Other"}, {"name": "no url"},
    ]}
    got = merged(spark, f'<a href="{P}acme-1000">Acme</a>' + OBJECTS % json.dumps(data))
    a, b, c = got["acme-1000"], got["alpha-2000"], got["inner-3000"]
    assert (a["name"], a["address"], a["state"], a["zip"]) == ("Acme", "1 Elm St", "WI", "53703")
    assert (b["name"], b["address"], b["city"], b["state"], b["zip"], b["n_mentions"]) == ("Alpha", "9 Park Dr", "Verona", "WI", "53593", 2)
    assert c["name"] == "Inner" and c["city"] == ""


def test_merge_matches_brute_force(spark):
    r = random.Random(4)
    rows, want = [], {}
    for page in range(30):
        for place in range(1, r.randint(2, 14)):
            kind, n = r.choice(["anchor", "object"]), r.randrange(4)
            rows.append((page, place, kind, f"{P}biz-{n}0000" + r.choice(["", "/complaints", "?q"]), r.choice(["", "A", "Bb", "Cc", "Dddd"]), "", *(r.choice(["", "x", "y"]) for _ in range(4))))
    rows.sort(key=lambda x: (x[0], x[1]))
    for page, _, kind, url, name, _, *parts in rows:
        key = page, re.sub(r"[?].*|/complaints$", "", url)
        e = want.setdefault(key, {"anchors": [], "objects": [], "parts": ["", "", "", ""]})
        e["anchors" if kind == "anchor" else "objects"].append(name or "Biz")
        if kind == "object":
            shown = [parts[0], parts[1], parts[2].upper(), parts[3]]
            e["parts"] = [a or b for a, b in zip(e["parts"], shown, strict=True)]
    got = {(x["page_id"], x["profile_url"]): (x["name"], [x[f] for f in bs.FIELDS]) for x in bs.candidates(spark.createDataFrame(rows, bs.MENTION)).collect()}
    assert got == {k: (max(e["anchors"], key=len) if e["anchors"] else e["objects"][0], e["parts"]) for k, e in want.items()}


def test_odd_pages(spark):
    deep = "<div>" * 3000 + f'<a href="{P}deep-1000">Deep</a>' + "</div>" * 10
    for html, n in [(None, 0), ("", 0), ("<a href>", 0), ("<a href='http://[bad'>x</a>", 0), (deep, 1), ("</p></p><<a", 0), ("<script>" + "[" * 100_000 + "</script>", 0)]:
        assert len(merged(spark, html)) == n
    assert bs.candidates(bs.mentions(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


def test_mentions_leave_a_worker_as_they_are_found(spark):
    html = "".join(f'<p>Port, WI 53703 <a href="{P}biz-{i}">{"Long name " * 100}</a></p>' for i in range(40))
    asked = []

    def pages():
        for b in range(20):
            asked.append(b)
            yield pa.RecordBatch.from_pydict({"page_id": [10 * b + i for i in range(10)], "url": [HOST] * 10, "html": [html] * 9 + [None]})

    got, ahead = [], 0
    for batch in bs.mention_batches(pages(), bs.PROFILE, "/search"):
        assert batch.nbytes < 4 * bs.FLUSH_CHARS
        ahead = max(ahead, len(asked) - len({x // 10 for x in got}))
        got += batch["page_id"].to_pylist()
    assert ahead < 5 and len(got) == 20 * (9 * 41 + 1)
    bs.mentions(spark.createDataFrame([], "page_id long, url string, html string"))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000


def test_searches_and_pages(spark):
    master = [(1, '*Acme* "Roofing", Inc.', "ACME ROOFING INC;Beta | Gamma", "Madison", "wi", "53703"), (2, "Beta", "", "", "", "53703"), (3, "", "", "X", "", ""), (4, "Delta & Co", None, "", "il", None)]
    df = spark.createDataFrame(master, "pk long, contractor_name string, related_companies string, city string, state string, zip string")
    got = {(r["owner"], r["url"]) for r in bs.searches(df, "pk", HOST + "/search").collect()}
    tail = "&find_loc=Madison%2C+WI+53703"
    at = HOST + "/search?find_country=USA&find_text="
    assert got == {(1, f"{at}Acme+Roofing+%2C+Inc.&page=1{tail}"), (1, f"{at}Beta&page=1{tail}"), (1, f"{at}Gamma&page=1{tail}"), (2, f"{at}Beta&page=1&find_loc=53703"), (4, f"{at}Delta+%26+Co&page=1&find_loc=IL")}
    said = spark.createDataFrame([(at + "Acme+%26+Sons&page=x",), (at + "%zz&page=3",), (None,)], "u string").select(bs.asked(F.col("u")).alias("a")).collect()
    assert [tuple(r["a"]) for r in said] == [("acme and sons", "", 1), ("", "", 3), ("", "", 1)]


def test_next_links_and_recognition(spark):
    at = HOST + "/search?find_text=acme&page="
    pages = [
        (1, at + "1", f'<a href="{P}acme-1000">Acme</a><a href="/search?find_text=acme&page=2">2</a>'),
        (2, at + "2", f'<a href="{P}acme-1000">Acme</a><a href="/search?find_text=acme&page=3">3</a><a aria-label="Next page" href="/search?find_text=other&page=3">&gt;</a>'),
        (3, HOST + "/search?find_text=none&page=1", "<p>Sorry, we couldn't find any businesses.</p>"),
        (4, HOST + "/search?find_text=odd", "<div>Loading complete</div>"),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    out = bs.result_pages(bs.mentions(df), df)
    got = {(r["term"], r["page"]): (r["next_term"], r["next_page"], r["recognised"], r["n_candidates"]) for r in out.collect()}
    assert got == {("acme", 1): ("acme", 2, True, 1), ("acme", 2): ("other", 3, True, 1), ("none", 1): (None, None, True, 0), ("odd", 1): (None, None, False, 0)}
    chains = {r["term"]: (r["n_pages"], r["reason"]) for r in bs.page_chains(out, ["term", "location"]).collect()}
    assert chains == {"acme": (2, "foreign"), "none": (1, ""), "odd": (1, "unknown")}
    asked = spark.createDataFrame([(7, "acme", ""), (7, "none", ""), (8, "none", ""), (9, "never", "")], "owner long, term string, location string")
    owners = {r["owner"]: (r["n_queries"], r["complete"], r["reasons"]) for r in bs.owner_searches(asked, bs.page_chains(out, ["term", "location"])).collect()}
    assert owners == {7: (2, False, ["foreign"]), 8: (1, True, []), 9: (1, False, ["missing"])}


def walk(pages, query, most):
    """A chain followed page by page."""
    page = 1
    for seen in itertools.count(1):
        rows = [p for p in pages if p[0] == query and p[1] == page]
        if not rows:
            return (seen - 1, "missing" if page == 1 else "gap")
        if not all(p[4] for p in rows):
            return seen, "unknown"
        _, _, to, following, _ = rows[0]
        if following is None:
            return seen, ""
        if to != query:
            return seen, "foreign"
        if following <= page:
            return seen, "loop"
        if following > page + 1:
            return seen, "gap"
        if page == most:
            return seen, "too_long"
        page = following


@pytest.mark.parametrize("most", [1, 3, 5])
def test_chains_match_a_walk(spark, most):
    r = random.Random(most)
    pages = []
    for q in range(150):
        for page in range(1, 7):
            if r.random() < 0.9:
                following = r.choices([None, page + 1, page, page + 2], [2, 8, 1, 1])[0]
                pages.append((q, page, None if following is None else q if r.random() < 0.9 else q + 1, following, r.random() < 0.92))
    df = spark.createDataFrame(pages + pages[:40], "q long, page int, next_q long, next_page int, recognised boolean")
    got = {x["q"]: (x["n_pages"], x["reason"], x["complete"]) for x in bs.page_chains(df, ["q"], most).collect()}
    want = {q: walk(pages, q, most) for q in {p[0] for p in pages}}
    assert got == {q: (*v, v[1] == "") for q, v in want.items()}


def test_finders():
    phones = {"call (608) 555-1234.": "(608) 555-1234", "+1 608 555 1234": "+1 608 555 1234", "12 345 6789": "", "6085551234": "6085551234", "1-608-555-1234 x": "1-608-555-1234", "a1 608-555-12345": ""}
    assert {t: finders.find_phone(t) for t in phones} == phones
    dates = {"2024-13-01 or 2/29/2023": "", "(2/29/24)": "2/29/24", "on Sept. 3 2021": "Sept. 3 2021", "May 3, 2024; x": "May 3, 2024", "may I 2024": "", "March 32, 2024": "", "1-2-2024": "1-2-2024"}
    assert {t: finders.find_date(t) for t in dates} == dates
    streets = {"77 N. 5th Ave. East; x": "77 N. 5th Ave. East", "1 Street": "", "5 of them, Oak Street": "", "at 12 Long Oak Street, Madison": "12 Long Oak Street", "9 Elm Rd\nnext": "9 Elm Rd", "1234567 Oak Rd": ""}
    assert {t: finders.find_street(t) for t in streets} == streets


def test_secrets():
    cases = {
        "token = abc, x": "token = [redacted], x", 'password: "a b" c': "password: [redacted] c", "api_key='q": "api_key=[redacted]", "mytoken=1": "mytoken=1", "cookie=": "cookie=",
        "TOKENS=3": "TOKENS=3", "token=token=abc d": "token=[redacted] d", "Secret : z;API-Key:y": "Secret : [redacted];API-Key:[redacted]", "": "",
    }
    assert {t: urls.hide_secrets(t) for t in cases} == cases


def naive_places(texts, aliases):
    out = []
    for i, text in texts:
        flat = " ".join((text or "").split())
        low = flat.casefold()
        for owner, alias in aliases:
            needle = " ".join(alias.split()).casefold()
            at = low.find(needle) if len(needle) >= 4 else -1
            while at >= 0:
                out.append((i, owner, alias, at, flat[max(0, at - 260) : at], flat[at : at + 720]))
                at = low.find(needle, at + len(needle))
    return sorted(out)


@pytest.mark.parametrize("chars", [payloads.AUTOMATON_CHARS, 40, 1])
def test_aliases_match_brute_force(spark, chars):
    r = random.Random(6)
    words = ["aaaa", "aa", "Acme", "ACME", "co", "roof", "the", "é"]
    texts = [(i, r.choice([" ", "\n", "  "]).join(r.choices(words, k=r.choice([0, 3, 40, 900])))) for i in range(25)] + [(99, None), (100, ""), (3, "acme co acme co")]
    aliases = [(1, "acme co"), (2, "ACME  co"), (3, "aaaa"), (4, "aaaa aa"), (5, "aa"), (6, "the roof the"), (7, "acme"), (7, "acme"), (8, ""), (9, "é the")]
    got = payloads.alias_places(spark.createDataFrame(texts, "text_id long, text string"), spark.createDataFrame(aliases, "owner long, alias string"), chars=chars)
    assert sorted(map(tuple, got.collect())) == naive_places(texts, aliases)


def test_aliases_where_folding_lengthens(spark):
    texts = spark.createDataFrame([("a", "Große STRASSE, straße ﬁn ΟΔΟΣ")], "text_id string, text string")
    aliases = spark.createDataFrame([(1, "Strasse"), (2, "οδος"), (3, "ße s")], "owner long, alias string")
    got = {(r["owner"], r["at"], r["after"][:7]) for r in payloads.alias_places(texts, aliases).collect()}
    assert got == {(1, 6, "STRASSE"), (1, 15, "straße "), (2, 25, "ΟΔΟΣ"), (3, 3, "ße STRA")}
    assert payloads.alias_places(texts, aliases.limit(0)).count() == 0
