"""JSON, XML and text payloads of registries as tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywort.functions.text import clean_text

INSPECTION = "activity_nr string, estab_name string, site_address string, site_city string, site_state string, site_zip string, open_date string, close_case_date string, naics_code string"
VIOLATION = "activity_nr string, citation_id string, delete_flag string, viol_type string, issuance_date string, current_penalty string, initial_penalty string, standard string, nr_instances string, nr_exposed string"
PAGE_LIMIT = 5000


def api_rows(responses: DataFrame, schema: str, body: str = "body") -> DataFrame:
    """Rows of responses of the form {"data": [{...}]}, names in any case. Another form is an error, never no rows."""
    wide = F.regexp_replace(F.col(body), r'"([A-Za-z_]+)"(\s*:)', '"$1"$2')
    maps = F.from_json(wide, "data array<map<string,string>>", {"mode": "PERMISSIVE"})
    ok = F.when(maps["data"].isNull(), F.raise_error(F.lit("not a data response")).cast("array<map<string,string>>")).otherwise(maps["data"])
    rest = [c for c in responses.columns if c != body]
    rows = responses.select(*rest, F.explode(ok).alias("_row"))
    lower = F.transform_keys("_row", lambda k, _: F.lower(k))
    fields = [x.split()[0] for x in schema.split(", ")]
    return rows.select(*rest, *(F.trim(F.coalesce(F.element_at(lower, F.lit(f)), F.lit(""))).alias(f) for f in fields))


def next_offsets(responses: DataFrame, body: str = "body", limit: int = PAGE_LIMIT) -> DataFrame:
    """Requests whose answer was a full page, with the offset of the next one."""
    n = F.size(F.from_json(body, "data array<map<string,string>>")["data"])
    return responses.where(n >= limit).withColumn("offset", F.col("offset") + limit).drop(body)


def inspection_query(term: Column, offset: int = 0) -> Column:
    """Filter, sort and fields of an inspection search by name, as the API takes them."""
    like = F.to_json(F.struct(F.lit("estab_name").alias("field"), F.lit("like").alias("operator"), F.concat(F.lit("%"), term, F.lit("%")).alias("value")))
    fields = ",".join(x.split()[0] for x in INSPECTION.split(", "))
    return F.concat(F.lit(f"limit={PAGE_LIMIT}&offset={offset}&fields={fields}&sort=desc&sort_by=open_date&filter_object="), F.url_encode(like))


def sitemap(xml: Column) -> Column:
    """Entries (loc, lastmod) of a sitemap or sitemap index. Document types and entities are refused."""
    unsafe = xml.rlike(r"(?i)<!(DOCTYPE|ENTITY)")
    entries = F.regexp_extract_all(xml, F.lit(r"(?s)<(?:url|sitemap)\b[^>]*>(.*?)</(?:url|sitemap)>"), F.lit(1))
    pick = lambda e, tag: F.trim(F.regexp_extract(e, rf"(?s)<{tag}\b[^>]*>(.*?)</{tag}>", 1))
    found = F.transform(entries, lambda e: F.struct(pick(e, "loc").alias("loc"), pick(e, "lastmod").alias("lastmod")))
    return F.when(unsafe, F.raise_error(F.lit("a sitemap with a document type")).cast("array<struct<loc:string,lastmod:string>>")).otherwise(F.filter(found, lambda s: s["loc"] != ""))


#: Fixed value: the sentence between a name and a date by which a list publishes its entries.
DEBARRED = " has been debarred from any public works project for a period of four years effective "


def illinois_entries(texts: DataFrame, text: str = "text") -> DataFrame:
    """(name, effective, termination) of debarment sentences, one text node a row; a term is four years. A text that has
    the sentence without a readable date is an error."""
    parts = F.split(F.concat(clean_text(F.col(text)), F.lit(" ")), f"(?i){DEBARRED}", 2)
    said = texts.select(F.trim(parts[0]).alias("name"), F.regexp_replace(F.trim(F.get(parts, F.lit(1))), r"\.$", "").alias("day")).where("day is not null and name <> ''")
    start = F.try_to_timestamp("day", F.lit("MMMM d, yyyy")).cast("date")
    found = said.select("name", F.coalesce(start, F.raise_error(F.lit("unreadable date")).cast("date")).alias("effective"))
    return found.select("name", F.col("effective").cast("string").alias("effective"), F.add_months("effective", 48).cast("string").alias("termination"))


#: Characters of context before and from the start of a place that names an alias, an alias's least length,
#: and the actions that a list states.
BEFORE, AFTER, MIN_ALIAS = 260, 720, 4
ACTIONS = ["debarment", "debarred", "suspended", "ineligible"]
#: Hits that leave a task at once.
HITS_A_BATCH = 1_000


#: Characters of the aliases that one automaton holds.
AUTOMATON_CHARS = 1 << 21
_automata: dict[str, ahocorasick.Automaton] = {}


def lower_letters(text: str) -> str:
    """Lower case letter by letter, as databases have it: every letter stays one, whatever stands around it."""
    low = text.lower()
    return low if len(low) == len(text) and "Σ" not in text else "".join(c.lower()[0] for c in text)


def _automaton(key: str, aliases: list[tuple[str, str]], fold: Callable[[str], str]) -> ahocorasick.Automaton:
    """The automaton of some aliases (alias, cleaned alias), kept in the worker until another one is asked for."""
    if key not in _automata:
        _automata.clear()
        made, by_needle = ahocorasick.Automaton(), {}
        for alias, clean in aliases:
            by_needle.setdefault(fold(clean), []).append(alias)
        for needle, names in by_needle.items():
            if len(needle) >= MIN_ALIAS:
                made.add_word(needle, (needle, names))
        if len(made):
            made.make_automaton()
        _automata[key] = made
    return _automata[key]


def _folded(text: str, fold: Callable[[str], str]) -> tuple[str, list[int] | None]:
    """The folded text, and the place in the text of each of its characters where folding lengthens it."""
    low = fold(text)
    if len(low) == len(text):
        return low, None
    parts = [fold(c) for c in text]
    return "".join(parts), [i for i, p in enumerate(parts) for _ in p]


def places_in(text: str, automaton: ahocorasick.Automaton, fold: Callable[[str], str] = str.casefold) -> Iterator[tuple[list[str], int]]:
    """(aliases, place) of the needles in a cleaned text, in one pass; places of one needle don't overlap."""
    if not len(automaton):
        return
    low, back = _folded(text, fold)
    free: dict[str, int] = {}
    for last, (needle, names) in automaton.iter(low):
        start = last - len(needle) + 1
        if start >= free.get(needle, 0):
            free[needle] = last + 1
            yield names, start if back is None else back[start]


def alias_places(
    texts: DataFrame, aliases: DataFrame, before: int = BEFORE, after: int = AFTER, chars: int = AUTOMATON_CHARS,
    fold: Callable[[str], str] = str.casefold, clean: Callable[[Column], Column] = clean_text,
) -> DataFrame:
    """(text_id, owner, alias, at, before, after): every place of the cleaned texts (text_id, text) that names an alias
    (owner, alias) in any case, from the left and not overlapping; at counts from 0. Aliases of fewer than MIN_ALIAS
    characters are left out. fold says which letters are the same (by default ß is ss, with lower_letters it is itself),
    clean how white space is put in order.

    A text is read once, by an automaton of all aliases, and only its hits leave the task. Aliases are counted first: an
    automaton holds about `chars` characters, and more aliases are dealt over several automata by their hashes, each with
    a pass of its own over the texts, so that what is broadcast stays bounded. Owners join the hits by the alias.
    """
    spark = texts.sparkSession
    named = aliases.select("alias", clean(F.col("alias")).alias("needle")).where(F.length("needle") > 0).distinct()
    parts = int(named.agg(F.sum(F.length("needle"))).first()[0] or 0) // chars + 1
    flat = texts.select("text_id", clean(F.col("text")).alias("flat"))
    schema = T.StructType([texts.schema["text_id"], *(T.StructField(c, T.IntegerType() if c == "at" else T.StringType()) for c in ("alias", "at", "before", "after"))])
    names = schema.names

    def searcher(held, key: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(key, held.value, fold)
            for batch in batches:
                rows = []
                for text_id, text in zip(batch.column(0), batch.column(1), strict=True):
                    said = text.as_py()
                    for found, at in places_in(said, automaton, fold):
                        rows += [(text_id.as_py(), alias, at, said[max(0, at - before) : at], said[at : at + after]) for alias in found]
                        if len(rows) >= HITS_A_BATCH:
                            yield _batch(rows, batch.schema.field(0).type, names)
                            rows = []
                if rows:
                    yield _batch(rows, batch.schema.field(0).type, names)

        return run

    hits = None
    for part in range(parts):
        own = named if parts == 1 else named.where(F.pmod(F.xxhash64("needle"), F.lit(parts)) == part)
        held = spark.sparkContext.broadcast([(r["alias"], r["needle"]) for r in own.collect()])
        found = flat.mapInArrow(searcher(held, uuid.uuid4().hex), schema)
        hits = found if hits is None else hits.union(found)
    return hits.join(aliases.select("owner", "alias"), "alias").select("text_id", "owner", "alias", "at", "before", "after")


def _batch(rows: list[tuple], id_type: pa.DataType, names: list[str]) -> pa.RecordBatch:
    kinds = [id_type, pa.string(), pa.int32(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def wisconsin_hits(texts: DataFrame, aliases: DataFrame) -> DataFrame:
    """(owner, name, effective, termination, action, context): places of the lists' texts that name an alias, with an
    action, a date and "statewide" from there on. The first date begins the term, the second ends it, or Indefinite."""
    own = texts.select(F.xxhash64("text").alias("text_id"), "text").dropDuplicates(["text_id"])
    words = F.split(F.regexp_replace(F.col("after"), r"[^A-Za-z0-9/]+", " "), " ")
    dates = F.filter(words, lambda w: w.rlike(r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"))
    action = F.get(F.filter(F.transform(words, F.lower), lambda w: w.isin(ACTIONS)), F.lit(0))
    has = lambda word: F.exists(words, lambda w: F.lower(w) == word)
    end = F.coalesce(F.get(dates, F.lit(1)), F.when(has("indefinite"), "Indefinite").otherwise(""))
    hits = alias_places(own, aliases).where(action.isNotNull() & (F.size(dates) > 0) & F.lower("after").contains("statewide"))
    out = hits.select("owner", F.col("alias").alias("name"), dates[0].alias("effective"), end.alias("termination"), F.initcap(action).alias("action"), F.concat_ws(" ", "before", "after").alias("context"), "at")
    key = ["owner", "name", "effective", "termination", "action"]
    return out.groupBy(*key).agg(F.min_by("context", "at").alias("context"))


def complaint_summary(text: Column) -> Column:
    """(total, closed): complaints of three years and those closed in twelve months, null where not stated. Before each
    statement of a period the words are read backwards to a number, over words of complaints only."""
    words = F.split(F.trim(F.lower(clean_text(text))), " ")

    def stated(period: list[str], needed: list[str], allowed: list[str]) -> Column:
        n = len(period)
        ends = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.concat_ws(" ", F.slice(words, i + 1, F.lit(n))).rlike("^" + " ".join(period) + r"\b"))

        def number(i: Column) -> Column:
            back = F.reverse(F.slice(words, F.greatest(i - 3, F.lit(0)) + 1, F.least(i, F.lit(3))))
            places = F.sequence(F.lit(0), F.greatest(F.size(back) - 1, F.lit(0)))
            first = F.get(F.filter(places, lambda j: F.coalesce(F.get(back, j).rlike("^[0-9][0-9,]*$"), F.lit(False))), F.lit(0))
            between = F.slice(back, F.lit(1), first)
            fits = F.forall(between, lambda w: w.isin([*needed, *allowed])) & F.exists(between, lambda w: w.isin("complaint", "complaints"))
            for w in needed:
                fits = fits & F.array_contains(between, w)
            return F.when(first.isNotNull() & fits, F.translate(F.get(back, first), ",", "").try_cast("int"))

        return F.get(F.filter(F.transform(ends, number), lambda x: x.isNotNull()), F.lit(0))

    plain = ["complaint", "complaints"]
    total = stated(["in", "the", "last", "3", "years?"], [], [*plain, "total"])
    closed = stated(["in", "the", "last", "12", "months?"], ["closed"], plain)
    return F.struct(total.alias("total"), closed.alias("closed"))


def disabled_source(spark, reason: str) -> tuple[DataFrame, str]:
    """A source that isn't collected: no rows and a reason, so that nothing is concluded from it."""
    return spark.createDataFrame([], "owner long, value string"), reason
