"""The import by rounds against a row-by-row fold."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallywort.operators import imports, schema

COLS = [c for c in schema.COLUMNS if c != "id"]
FIELDS = ", ".join(f"{c} string" for c in COLS)


def table(spark, rows, head):
    """Rows (number, id, name, address, city) as a master or a file."""
    blank = dict.fromkeys(COLS, "")
    full = [(n, i, *({**blank, "contractor_name": name, "address_1": addr, "city": city}[c] for c in COLS)) for n, i, name, addr, city in rows]
    return schema.master_norms(spark.createDataFrame(full, f"{head}, {FIELDS}"))


def fold(master, file):
    entities = [{"pk": pk, "row": tuple(r), "outcome": "kept"} for pk, *r in sorted(master)]
    norm = lambda x: " ".join(x.lower().split())
    for _, *r in sorted(file):
        own, name, addr = r[0].strip(" "), norm(r[1]), norm(r[2] + " " + r[3])
        hits = [e for e in entities if own and e["row"][0] == own][:1]
        if not hits and name:
            hits = [e for e in entities if norm(e["row"][1]) == name]
            if len(hits) > 1:
                hits = [e for e in hits if addr and norm(e["row"][2] + " " + e["row"][3]) == addr]
        if len(hits) != 1:
            entities.append({"pk": None, "row": tuple(r), "outcome": "inserted"})
        else:
            e = hits[0]
            if e["outcome"] != "inserted":
                e["outcome"] = "updated" if e["row"] != tuple(r) or e["outcome"] == "updated" else "unchanged"
            e["row"] = tuple(r)
    top = max((e["pk"] for e in entities if e["pk"]), default=0)
    for n, e in enumerate((e for e in entities if e["pk"] is None), top + 1):
        e["pk"] = n
    return sorted((e["pk"], *e["row"], e["outcome"]) for e in entities)


def merged(spark, master, file, rounds):
    out = imports.merge_master(table(spark, master, "pk long, bidder_id string"), table(spark, file, "line long, id string"), rounds)
    return sorted((r["pk"], r["bidder_id"], r["contractor_name"], r["address_1"], r["city"], r["outcome"]) for r in out.collect())


def made(seed, n_names, n_ids, size, addresses=("1 Oak St", "2 Elm St", "")):
    r = random.Random(seed)
    names = [f"Firm {chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(n_names)] + [""]
    ids = [""] * (n_ids // 3 + 1) + [str(i) for i in range(n_ids)]
    row = lambda: (r.choice(names), r.choice(addresses), r.choice("xy"))
    unique = r.sample([i for i in ids if i], min(size, n_ids))
    master = [(k + 1, unique[k] if k < len(unique) and r.random() < 0.8 else "", *row()) for k in range(size)]
    file = [(k + 1, r.choice([r.choice(ids), f" {r.choice(ids)} "]) if r.random() < 0.8 else "", *row()) for k in range(2 * size)]
    # rows that repeat what there is
    return master, [(line, *r.choice(master)[1:]) if r.random() < 0.3 else (line, *x) for line, *x in file]


@pytest.mark.parametrize(("seed", "n_names", "n_ids", "size"), [(1, 3, 5, 8), (2, 40, 60, 50), (3, 200, 200, 120)])
def test_equals_a_fold(spark, seed, n_names, n_ids, size):
    master, file = made(seed, n_names, n_ids, size)
    want = fold(master, file)
    assert merged(spark, master, file, imports.ROUNDS) == want


def test_repeated_ids_nulls_and_empty_files(spark):
    master = [(1, "7", "A", "", "x"), (2, "7", "B", "", "x"), (3, "", "C", "", "y")]
    file = [(1, "7", "C", "", "x"), (2, "", "A", "", "y"), (3, "7", "B", "", "z"), (4, "7", "B", "", "w")]
    assert merged(spark, master, file, imports.ROUNDS) == fold(master, file)
    assert merged(spark, master, [], imports.ROUNDS) == fold(master, [])
    assert merged(spark, [], [(1, None or "", "", "", ""), (2, "5", "", "", "")], imports.ROUNDS) == fold([], [(1, "", "", "", ""), (2, "5", "", "", "")])


def test_a_round_settles_what_nothing_hinders(spark):
    """A thousand rows that share a name but leave it as it is are settled in one round, also behind each other."""
    state = spark.range(1, 1001).select(F.col("id").alias("ref"), F.col("id").cast("string").alias("id"), F.lit("same").alias("name"), F.lit("").alias("addr"))
    opened = spark.range(1, 3001).select(F.col("id").alias("line"), (F.col("id") % 1000 + 1).cast("string").alias("id"), F.lit("same").alias("name"), F.lit("").alias("addr"))
    judged = imports._round(opened, state)
    assert judged.where("settled").count() == 3000
    loud = opened.withColumn("name", F.when(F.col("line") == 1500, "other").otherwise(F.col("name")))
    assert imports._round(loud, state).where("settled").agg(F.max("line")).first()[0] == 1499


def test_a_chain_and_a_shared_name(spark):
    """A chain of ids and names: row i takes entity i over and names it like entity i + 1, so that only one can settle in
    a round; and one name that all rows of a file share, each taking over what the one before brought."""
    n = 30
    master = spark.range(1, n + 1).selectExpr("id AS pk", "string(id) AS bidder_id", "concat('n', id) AS contractor_norm", "'' AS address_norm")
    file = spark.range(1, n + 1).selectExpr("id AS line", "string(id) AS id", "concat('n', id + 1) AS contractor_norm", "'' AS address_norm")
    found = imports.resolved(master, file)
    assert found.count() == n and found.where("line <> ref").count() == 0
    found = imports.resolved(master.limit(0), file.selectExpr("line", "concat('x', line) AS id", "'same' AS contractor_norm", "'' AS address_norm"))
    assert found.count() == n and found.where(F.col("ref") != imports.NEW + 1).count() == 0


def test_replay_of_many_rows():
    """A group of 100,000 rows of one name, and one of 100,000 names in a chain, by keys alone."""
    n = 100_000
    lines = range(1, n + 1)
    hub = pd.DataFrame({"line": lines, "ref": -1, "id": [f"x{i}" for i in lines], "name": "same", "addr": ""})
    assert (imports.replay(hub)["ref"] == imports.NEW + 1).all()
    entities = pd.DataFrame({"line": 0, "ref": lines, "id": [str(i) for i in lines], "name": [f"n{i}" for i in lines], "addr": ""})
    rows = entities.assign(line=lines, ref=-1, name=[f"n{i + 1}" for i in lines])
    out = imports.replay(pd.concat([rows, entities]))
    assert (out["line"] == out["ref"]).all() and len(out) == n


def test_counts(spark):
    master, file = made(6, 9, 9, 9)
    m, f = table(spark, master, "pk long, bidder_id string"), table(spark, file, "line long, id string")
    c = imports.import_counts(imports.merge_master(m, f), imports.resolved(m, f)).first()
    want = [x[-1] for x in fold(master, file)]
    assert (c["inserted"], c["updated"], c["unchanged"], c["master_total"], c["rows_total"]) == (want.count("inserted"), want.count("updated"), want.count("unchanged"), len(want), len(file))
