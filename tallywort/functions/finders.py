"""Finders in running text: the first phone number, date and street address, read word by word.

They are decisions on neighbouring words rather than patterns: digits of a phone are grouped as such numbers are written, a
date is what a calendar accepts, and an address is a house number with a kind of street some words later. The columns are
Arrow UDFs, which see only texts that hold a digit.
"""

from __future__ import annotations

import calendar
from datetime import date
from itertools import groupby

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Kinds of streets by their short forms.
STREETS = {
    "ave": "avenue", "blvd": "boulevard", "cir": "circle", "ct": "court", "dr": "drive", "hwy": "highway", "ln": "lane", "pkwy": "parkway", "pl": "place",
    "rd": "road", "st": "street", "ter": "terrace", "way": "way",
}
KINDS = {*STREETS, *STREETS.values()}
MONTHS = {name.lower() for n in range(1, 13) for name in (calendar.month_name[n], calendar.month_abbr[n])} | {"sept"}
#: Sizes of the groups of digits of a phone number, without a leading 1.
GROUPS = [[3, 3, 4], [3, 7], [6, 4], [10]]
#: Words of a phone number at most; words between house number and kind of street; characters kept behind the kind.
PHONE_WORDS, STREET_WORDS, STREET_REST = 4, 10, 80
AROUND, ENDINGS = "([{\"'<", ".,;:!?)]}\"'>"


def find_phone(text: str) -> str:
    """Up to four neighbouring words whose digits are grouped like a phone number's."""
    words = text.split()
    for i, word in enumerate(words):
        if not any(c.isdigit() for c in word):
            continue
        for n in range(1, PHONE_WORDS + 1):
            said = " ".join(words[i : i + n]).rstrip(".,;:!?").lstrip("[{\"'<")
            if not set(said) <= set("0123456789()+-. "):
                break
            sizes = [len(list(g)) for digit, g in groupby(said, str.isdigit) if digit]
            digits = [c for c in said if c.isdigit()]
            if sizes in GROUPS or digits[:1] == ["1"] and (sizes[:1] == [1] and sizes[1:] in GROUPS or sizes in ([4, 3, 4], [11])):
                return said
    return ""


def _numeric(word: str) -> bool:
    """Whether a word is a date of numbers: year first with hyphens, or month first with hyphens or slashes."""
    for sign in "-/":
        parts = word.split(sign)
        if len(parts) == 3 and all(p.isascii() and p.isdigit() for p in parts):
            sizes = [len(p) for p in parts]
            if sign == "-" and sizes == [4, 2, 2]:
                year, month, day = map(int, parts)
            elif max(sizes[:2]) <= 2 and sizes[2] in (2, 4):
                month, day, year = map(int, parts)
                year += 2000 if sizes[2] == 2 else 0
            else:
                return False
            try:
                return date(year, month, day) is not None
            except ValueError:
                return False
    return False


def find_date(text: str) -> str:
    """A word that is a date of numbers, or a month's name with a day and a year behind it."""
    words = text.split()
    for i, word in enumerate(words):
        plain = word.lstrip(AROUND).rstrip(ENDINGS)
        if _numeric(plain):
            return plain
        if plain.lower() in MONTHS and i + 2 < len(words):
            day, year = words[i + 1].rstrip(","), words[i + 2].rstrip(ENDINGS)
            if day.isascii() and day.isdigit() and 1 <= int(day[:3]) <= 31 and len(year) == 4 and year.isascii() and year.isdigit():
                return " ".join([word.lstrip(AROUND), words[i + 1], year])
    return ""


def find_street(text: str) -> str:
    """From a house number to the comma, semicolon or line end after a kind of street."""
    for line in text.splitlines():
        words = line.split()
        for i, word in enumerate(words):
            number = word.lstrip(AROUND)
            if not (number.isascii() and number.isdigit() and len(number) <= 6):
                continue
            for j in range(i + 1, min(i + 2 + STREET_WORDS, len(words))):
                if j > i + 1 and words[j].rstrip(ENDINGS).lower() in KINDS:
                    rest, size = [], 0
                    for k in range(j, len(words)):
                        plain = words[k].rstrip(",;")
                        if k > j and size + len(plain) + 1 > STREET_REST:
                            break
                        rest.append(plain)
                        size += (len(plain) + 1) * (k > j)
                        if plain != words[k]:
                            break
                    return " ".join([number, *words[i + 1 : j], *rest])
                if words[j][-1] in ",;:" or not any(c.isalnum() for c in words[j]):
                    break
    return ""


def _column(find):
    @F.pandas_udf(T.StringType())
    def found(s: pd.Series) -> pd.Series:
        return s.map(find, na_action="ignore")

    def first(c: Column) -> Column:
        return F.coalesce(found(F.when(c.rlike("[0-9]"), c.cast("string"))), F.lit(""))

    return first


#: Columns of the first phone number, date and street address of a text, as they stand there, or the empty text.
first_phone, first_date, first_street = _column(find_phone), _column(find_date), _column(find_street)
