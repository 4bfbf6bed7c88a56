"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tallywort.llm import spelling


def fold(x):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) < len(b):
        a, b = b, a
    return any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute(rows, min_chars=6, min_count=5, ratio=5):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = fold(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            n[run] += 1
    words = {w: k for w, k in n.items() if len(w) >= min_chars and k >= min_count}
    near = {w: [v for v in words if one_apart(w, v)] for w in words}
    form = {}
    for w, k in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * k else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), k, len(near[w]), words.get(form[w], -1)) for w, k in words.items())


def got(df):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], -1 if r["form_n"] is None else r["form_n"]) for r in df.collect())


def made(seed=5, n=260):
    r = random.Random(seed)
    stems = ["".join(r.choice("abé") for _ in range(r.randint(5, 9))) for _ in range(25)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "ababab", "bababa", "ÿ×÷àÀé"]
    rows = []
    for i in range(n):
        words = []
        for _ in range(60):
            w = r.choices(stems, [1 / (k + 1) ** 2 for k in range(len(stems))])[0]
            if r.random() < 0.25:
                k = r.randrange(len(w))
                w = r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice("abé") + w[k:], w[:k] + r.choice("abé") + w[k + 1 :]])
            words.append(w.upper() if r.random() < 0.1 else w)
        rows.append((i, r.choice([" ", "1", "-"]).join(words)))
    return [*rows, (None, "aaaaaa bababa"), (7, None), (8, ""), rows[3], rows[3], (-4, "x" * 70_000 + " " + "x" * 69_999)]


@pytest.mark.parametrize("bucket", [spelling.KEYS_A_BUCKET, 64])
def test_matches_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(spelling, "KEYS_A_BUCKET", bucket)
    rows = made()
    want = brute(rows)
    assert len(want) > 100 and any(w[1] and w[1] != w[2] for w in want)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS word", "3 AS n", "4 AS best", "5 AS doc")
    assert got(spelling.variants(df)) == want


def test_long_words_and_small_limits(spark):
    rows = [(1, "q" * 3000 + " " + "q" * 2999 + " " + "q" * 2999), (2, "q" * 2998 + "w" + " ab ac abc")]
    assert got(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"), min_chars=2, min_count=1, ratio=2)) == brute(rows, 2, 1, 2)


@pytest.mark.parametrize("bits", [4, 12])
def test_collisions_of_hashes_make_no_links(spark, bits):
    rows = made(9, 80)
    assert got(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"), hash_bits=bits)) == brute(rows)


def test_keys_agree_with_strings():
    words = ["abcabc", "abcab", "abcbabc", "aab", "ab", "", "aaa"]
    e = spelling.keys_of(words, np.arange(len(words)))

    def rest(x):
        w, at = words[x["id"]], x["at"]
        return {spelling.OPEN: (at, w[:at] + "*" + w[at + 1 :]), spelling.DELETED: w[:at] + w[at + 1 :], spelling.WHOLE: w}[int(x["kind"])]

    by = {}
    for x in e:
        by.setdefault(rest(x), set()).add(int(x["key"]))
    assert all(len(v) == 1 for v in by.values()) and len({k for v in by.values() for k in v}) == len(by)
    assert sum(x["id"] == 6 and x["kind"] == spelling.DELETED for x in e) == 1


def test_empty_and_bad(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError, match="frequent"):
        spelling.variants(spark.createDataFrame([], "doc_id long, text string"), ratio=1)
