"""The pipeline over the smallest tables, and its stages' contracts."""

import os
import random
from collections import Counter
from decimal import Decimal

import pytest
import xxhash

import corpus_pipeline
from tallywort.llm import mixing, pieces, quality, queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.common.materialize(stage(spark, docs, DATA), name)
        assert docs.count() > 0
        if name != names[-1]:
            assert docs.columns == columns
    assert docs.where("not round_trip").count() == 0


def test_one_query_an_operator():
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in queries.QUERIES) == 1
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def spark_hash(*values):
    """Spark's xxhash64 of values: int as four bytes if wrapped in a list, else as eight; null leaves the seed."""
    seed = 42
    for v in values:
        if v is not None:
            data = v.encode() if isinstance(v, str) else v[0].to_bytes(4, "little", signed=True) if isinstance(v, list) else v.to_bytes(8, "little", signed=True)
            seed = xxhash.xxh64_intdigest(data, seed)
    return seed - 2**64 if seed >= 2**63 else seed


def brute_quality(docs):
    words, chars = {}, {}
    for d in docs:
        text = (d["text"] or "").encode()
        for lang in {d["lang"], None}:
            words.setdefault(lang, Counter()).update(text.lower().split())
            chars[lang] = chars.get(lang, 0) + quality.histogram(text)
    refs = {}
    for lang, c in words.items():
        best = sorted(c, key=lambda w: (-c[w], w))[: quality.TOP_WORDS]
        n = [c[w] for w in best]
        refs[lang] = quality.Reference.of(chars[lang], best, [*n, sum(c.values()) - sum(n)])
    return [d for d in docs if quality.measured((d["text"] or "").encode(), refs[d["lang"]])[-1]]


def fold(x):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)


def brute_lines(docs):
    spaces = " \t\n\x0b\x0c\r"
    holders = {}
    for d in docs:
        for line in (d["text"] or "").split("\n"):
            holders.setdefault(fold(line.strip(spaces)), set()).add(d["doc_id"])
    out = []
    for d in docs:
        keys = [(x, fold(x.strip(spaces))) for x in (d["text"] or "").split("\n")]
        kept = [x for x, k in keys if len(k) < 10 or len(holders[k]) < 2 or min(holders[k]) == d["doc_id"]]
        out.append({**d, "text": "\n".join(kept)})
    return out


def brute_join(docs, k=5, percent=80):
    sets = {}
    for d in docs:
        w = fold(d["text"]).split()
        sets[d["doc_id"]] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    group = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                low, high = sorted((group[a], group[b]))
                group = {i: low if g == high else g for i, g in group.items()}
    return [d for d in docs if group[d["doc_id"]] == d["doc_id"]]


def brute_mix(docs, block_words, seed=mixing.SEED):
    rows = [{**d, "size": len(d["text"].split()), "d1": spark_hash([1], d["text"]), "d2": spark_hash([2], d["text"])} for d in docs]
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
    order = sorted((x for x in sizes if x is not None), key=lambda x: x.encode()) + [None] * (None in sizes)
    weight, full = {x: (3, 1, 2)[i % 3] for i, x in enumerate(order)}, set()
    while True:
        level = (1.5 * sum(sizes.values()) - sum(2 * sizes[x] for x in full)) / max(1, sum(weight[x] for x in order if x not in full))
        more = {x for x in order if x not in full and weight[x] * level >= 2 * sizes[x]}
        if not more:
            break
        full |= more
    target = {x: 2.0 * sizes[x] if x in full else weight[x] * level for x in order}
    shards = {x: spark_hash(x, 0) for x in order}  # sources here are smaller than a shard
    blocks = {x: -(-sizes[x] // block_words) for x in order}
    votes = {x: target[x] if sizes[x] else 0.0 for x in order}
    total = round(float(sum(round(Decimal(v), 6) for v in votes.values())) / block_words)
    quotients = sorted((-votes[x] / (2 * k + 1), shards[x], k, x or "") for x in order for k in range(2 * blocks[x]))[:total]
    quota = Counter(shard for _, shard, _, _ in quotients)
    out = []
    for x in order:
        n, q = max(1, blocks[x]), quota[shards[x]]
        base, rest, turn = q // n, q - q // n * blocks[x], spark_hash([seed + 2], shards[x]) % n
        taken = [j for j in range(n) if ((j + 1) * rest + turn) // n > (j * rest + turn) // n]
        stream = sorted((r for r in rows if r["source"] == x), key=lambda r: (spark_hash([seed], r["doc_id"], r["d1"]), r["doc_id"], r["d1"], r["d2"], r["size"]))
        start = 0
        for r in stream:
            out += [(r["doc_id"], r["text"])] * (base if r["size"] else 0)
            own = [i for j in taken for i in range(max(0, j * block_words - start), min(r["size"], (j + 1) * block_words - start))]
            start += r["size"]
            if own:
                spans = [m.span() for m in mixing._WORD.finditer(r["text"])]
                runs = [[own[0]]]
                for a, b in zip(own, own[1:]):
                    runs[-1].append(b) if b == a + 1 else runs.append([b])
                whole = len(own) == r["size"]
                out.append((r["doc_id"], r["text"] if whole else "\n".join(r["text"][spans[p[0]][0] : spans[p[-1]][1]] for p in runs)))
    return out


def test_run_matches_brute_force(spark, tmp_path):
    """Rows of run() on a small table against the five stages by brute force."""
    r = random.Random(12)
    vocab = ["the", "of", "and", "to", "in", "stone", "river", "light", "walk", "house", "tree", "wind", "cold", "old"] + ["".join(r.choices("abcdefgh", k=5)) for _ in range(60)]
    sentence = lambda n: " ".join(r.choices(vocab, weights=[8] * 5 + [1] * 69, k=n)) + "."
    shared = [sentence(12) for _ in range(3)]
    docs = []
    for i in range(70):
        lines = [sentence(r.choice([6, 14, 40])) for _ in range(r.randint(1, 8))]
        if i % 3 == 0:
            lines.insert(r.randint(0, len(lines)), r.choice(shared).upper() + " ")
        docs.append({"doc_id": i, "text": "\n".join(lines), "lang": r.choice(["en", "de", None]), "source": r.choice(["a", "b", "c", None])})
    for i in range(70, 90):
        words = docs[r.randrange(70)]["text"].split(" ")
        words[r.randrange(len(words))] = "changed"
        docs.append({**docs[i - 70], "doc_id": i, "text": " ".join(words)})
    for i in range(120, 132):  # one line each, so that the line dedup leaves the copies to the join
        words = docs[-6]["text"].split(" ") if i >= 126 else sentence(90).split(" ")
        words[r.randrange(len(words))] = "changed"
        docs.append({"doc_id": i, "text": " ".join(words), "lang": "en", "source": r.choice(["a", "b"])})
    docs += [{"doc_id": 200 + i, "text": t, "lang": "en", "source": "a"} for i, t in enumerate([None, "", "\n \n", "few words", "# $ " * 80, "again and again " * 60, sentence(3000)])]
    table = [(d["doc_id"], d["text"], d["lang"], d["source"], len(d["text"] or "")) for d in docs]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    kept = brute_quality(docs)
    alone = brute_join(brute_lines(kept))
    assert 20 < len(alone) < len(kept) < len(docs)
    codec = pieces.Codec(pieces.read_model(pieces.model_bytes()))
    want = sorted((i, codec.encode(t)) for i, t in brute_mix(alone, corpus_pipeline.BLOCK_WORDS))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((x["doc_id"], list(x["ids"])) for x in out) == want
    facts = {d["doc_id"]: (d["lang"], d["source"]) for d in docs}
    assert all((x["lang"], x["source"]) == facts[x["doc_id"]] and x["round_trip"] and x["n_ids"] == len(x["ids"]) for x in out)
