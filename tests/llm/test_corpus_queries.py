"""Registered corpus queries on the smallest tables: check SQL where there is some, brute force for the pipeline."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from antecede.llm import queries
from scripts.check_oracles import compare

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in os.listdir(FOLDER):
        connection.execute(f"create view {file.split('.')[0]} as select * from '{FOLDER}/{file}'")
    return connection


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_check_sql(spark, duck, name):
    got = entry.queries()[name](spark, FOLDER).toArrow()
    assert compare(got, duck.execute(queries.ORACLES[name]).to_arrow_table()).startswith("ok")


def test_every_operator_is_registered_once():
    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()


def fives(text):
    w = WORD.findall((text or "").lower())
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def test_pipeline_stages(spark, duck, tmp_path):
    docs, results = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    columns = docs.columns
    for place, (name, function) in enumerate(corpus_pipeline.STAGES):
        function(spark, docs, FOLDER).write.parquet(str(tmp_path / str(place)))
        docs = spark.read.parquet(str(tmp_path / str(place)))
        assert docs.columns == columns if place < 4 else docs.columns[: len(columns)] == columns
        results.append({r.doc_id: r for r in docs.collect()})
    clean, lines, near, safe, mixed = results

    own = duckdb.connect()
    own.execute(f"create view documents as select * from '{tmp_path}/0/*.parquet'")
    want = {d: t for d, t in own.execute(f"select doc_id, text from ({queries.ORACLES['op7_line_dedup']})").fetchall()}
    assert {d: r.text for d, r in lines.items()} == want and all(r.n_chars == len(r.text) for r in lines.values())

    sets, parent = {d: fives(r.text) for d, r in lines.items()}, {d: d for d in lines}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    assert set(near) == {d for d in ids if root(d) == d} and all(near[d] == lines[d] for d in near)

    items = [re.findall(r"[^\W_]+", t.lower()) for (t,) in duck.execute("select text from benchmark").fetchall()]
    held = {d for d, r in near.items() for w in items if " ".join(w) in " ".join(re.findall(r"[^\W_]+", (r.text or "").lower()))}
    assert set(safe) == set(near) - held

    assert set(mixed) <= set(safe) and all(0 < r.taken <= 2 * r["size"] for r in mixed.values())
    assert all(r["size"] == len(WORD.findall(r.text)) for r in mixed.values())
    total = sum(len(WORD.findall(r.text or "")) for r in safe.values())
    assert abs(sum(r.taken for r in mixed.values()) - 1.5 * total) < 64 * 2 * len({r.source for r in mixed.values()})
