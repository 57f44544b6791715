from __future__ import annotations

from collections import Counter

import brute
import corpus_pipeline
from lattice.llm import language, sharding

SF = "/root/testdata/sf0.001"


def test_run_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    judge = language.Judge(language.learn(docs))
    rows = sorted((r for r in docs.collect() if not judge(r["text"])[3]), key=lambda r: r["doc_id"])
    fps = [brute.simhash(r["text"]) for r in rows]
    rows = [r for k, (r, x) in enumerate(zip(rows, brute.groups(len(rows), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4), strict=True)) if k == x]
    rows = [r for r, judged in zip(rows, brute.decontaminate([r["text"] for r in rows], items), strict=True) if not judged[1]]
    by_id = {r["doc_id"]: r for r in rows}
    copies = {d: taken // size for d, size, _, _, taken in brute.mix([(r["doc_id"], r["text"], r["source"]) for r in rows]) if size}
    table = sharding.lookup_table()
    import hashlib

    want = Counter()
    for d, n in copies.items():
        if n:
            want[(*by_id[d], table[int(hashlib.md5(str(d).encode()).hexdigest()[:15], 16) % sharding.SLOTS])] = n
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == [*corpus_pipeline.COLUMNS, "shard"]
    assert Counter(tuple(r) for r in out.collect() if brute.spaced(r["text"])) == want


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_stages_take_odd_rows(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and clashing names, stage by stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    some = docs.collect()
    first = some[0]
    odd = [
        (None, None, None, None, None), (None, first["text"], None, first["source"], 1), (first["doc_id"], first["text"], first["lang"], first["source"], 1), (first["doc_id"], first["text"], first["lang"], first["source"], 1),
        (10**6, "", "en", None, 0), (10**6 + 1, (some[3]["text"] + "\n") * 300, None, "s", None), (10**6 + 1, some[4]["text"], None, "s", None), (10**6 + 2, "12 ?!", None, None, 5),
    ]
    df = docs.unionByName(spark.createDataFrame(odd, docs.schema)).repartition(3)
    clash = {"of": "1", "row": "'r'", "shard": "2", "key": "3", "draw": "4", "size": "5", "body": "'b'", "place": "6", "Score": "7"}
    for name, stage in corpus_pipeline.STAGES:
        before = Counter((r["doc_id"], r["text"]) for r in df.collect())
        out = stage(spark, df.selectExpr("*", *[f"{v} AS {k}" for k, v in clash.items() if k.lower() not in [c.lower() for c in df.columns]]), SF)
        assert out.columns[:5] == list(corpus_pipeline.COLUMNS)
        rows = out.collect()
        after = Counter((r["doc_id"], r["text"]) for r in rows)
        assert set(after) <= set(before), name
        if name == "language":
            assert (None, None) not in after and (10**6, "") not in after and after[(first["doc_id"], first["text"])] == before[(first["doc_id"], first["text"])]
        if name == "near_dedup":
            assert max(after.values()) == 1 and after[(first["doc_id"], first["text"])] == 1 and (None, first["text"]) not in after
        if name == "sharding":
            assert after == before and all(r["shard"] for r in rows)
        df = spark.createDataFrame([tuple(r)[:5] for r in rows], docs.schema)
