import corpus_pipeline
from shared import SF
from llm.helpers import edge_docs, empty_docs
from llm.test_ngram_join import brute
from llm.test_secrets import brute as spans
from pelorus.llm import mixing
from pelorus.llm.common import stage


def test_stages_keep_the_columns_and_act(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, []
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = stage(step(spark, docs, SF), name)
        assert docs.columns == columns
        kept.append({(r["doc_id"], r["text"]): r for r in docs.collect()})
    known, single, masked, mixed = kept
    assert 190 <= len(known) <= 200
    want = {c for _, _, c in brute([k for k in known], 5, 80, 100)}
    assert {k for k, _ in single} == want
    assert {k for k, _ in masked} == want and not any(spans(t) for _, t in masked)
    sizes = {}
    for r in masked.values():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len((r["text"] or "").encode().split())
    goals = mixing.targets(sizes)
    for s, goal in goals.items():
        got = sum(len(r["text"].encode().split()) for r in docs.where(docs["source"].eqNullSafe(s)).collect())
        assert abs(got - goal) <= mixing.BLOCK_WORDS + 1
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert sum(r["doc_tokens"] for r in rows if r["start"] == 0) == sum(r["length"] for r in rows) and max(r["offset"] + r["length"] for r in rows) <= 2048


def test_run_gives_the_same_rows_again(spark):
    key = lambda rows: sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    assert key(corpus_pipeline.run(spark, SF).collect()) == key(corpus_pipeline.run(spark, SF).collect())
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard", "secret_scan", "mixing", "packing"]


def test_edges(spark):
    docs, at = edge_docs(spark), {}
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, stage(docs, "edge"), SF)
        at[name] = out.collect()
        assert name == "packing" or out.columns == docs.columns
        assert step(spark, stage(empty_docs(spark), "edge"), SF).count() == 0
    ids = lambda name: sorted(r["doc_id"] or -1 for r in at[name])
    assert ids("language_id") == [-1, 4, 4, 5, 6, 8]  # with a letter
    assert ids("ngram_jaccard") == [-1, 1, 2, 3, 4, 5, 6, 7, 8]  # one of the two equal rows
    texts = lambda rows: sorted((str(r["doc_id"]), str(r["text"])) for r in rows)
    assert texts(at["secret_scan"]) == texts(docs.collect())  # no secret in them
    whole = {r["doc_id"]: (r["text"] or "").split() for r in docs.collect()}
    assert set(ids("mixing")) <= {-1, 4, 5, 6, 7, 8} and all(r["text"] and set(r["text"].split()) <= set(whole[r["doc_id"]]) for r in at["mixing"])
    assert ids("packing") == sorted([-1, 1, 2, 3, 4, 4, 6, 7, 8] + [5] * sum(r["doc_id"] == 5 for r in at["packing"]))
    assert sum(r["length"] for r in at["packing"]) == sum(r["doc_tokens"] for r in at["packing"] if r["start"] == 0)
