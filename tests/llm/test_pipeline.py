from collections import Counter, defaultdict

import corpus_pipeline
from corpus_pipeline import STAGES, run

from tests.llm.test_line_dedup import brute_force as lines_by_hand
from tests.llm.test_ngram_join import brute_force as classes_by_hand
from wiresift.llm import mixing, toxicity
from wiresift.llm.common import text_key
from wiresift.llm.packing import plan_bins

PATH = "/root/testdata/sf0.001"


def as_rows(df):
    return [tuple(r) for r in df.collect()]


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{PATH}/documents.parquet")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{PATH}/labels.parquet").collect()}
    kept = {}
    for name, stage in STAGES:
        out = stage(spark, docs, PATH)
        if name != "packing":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        before, after = as_rows(docs), as_rows(out)
        kept[name] = len(after)
        if name == "toxicity":
            assert set(after) <= set(before)
            gone = {r[0] for r in before} - {r[0] for r in after}
            assert not any(labels.get(i) == 0 for i in gone)
            model = toxicity.fit(docs, spark.read.parquet(f"{PATH}/labels.parquet"))
            sums = model.sums([r[1] for r in before])
            assert gone == {r[0] for r, p in zip(before, model.above(sums)[:, 0], strict=True) if p >= 0.5}
        elif name == "line_dedup":
            keys = {r["doc_id"]: r["k"] for r in docs.select("doc_id", text_key().alias("k")).collect()}
            want = lines_by_hand([r[:2] for r in before], [keys[r[0]] for r in before])
            assert sorted(after) == sorted((r[0], want[r[:2]], *r[2:]) for r in before)
        elif name == "ngram_jaccard":
            classes = classes_by_hand([r[:2] for r in before])
            first = {}
            for i, r in enumerate(before):
                first.setdefault(classes[i][0], []).append(r[0])
            assert {r[0] for r in after} == {min(ids) for ids in first.values()} and set(after) <= set(before)
        elif name == "source_mix":
            choice = {r["doc_id"]: r for r in mixing.mix(mixing.measured(docs)).collect()}
            assert Counter(r[0] for r in after) == Counter({i: r["copies"] for i, r in choice.items() if r["copies"]})
            taken, target = defaultdict(int), {}
            for r in choice.values():
                taken[r["source"]] += r["size"] * r["copies"]
                target[r["source"]] = r["target"]
            for source, words in target.items():
                longest = max(r["size"] for r in choice.values() if r["source"] == source)
                assert abs(taken[source] - words) <= longest / 2 + 1
        else:
            pieces = [r.asDict() for r in out.collect()]
            lengths = Counter(r["length"] for r in pieces)
            counts = [lengths.get(x, 0) for x in range(1025)]
            assert len({r["sequence_id"] for r in pieces}) == sum(times for times, _ in plan_bins(counts))
            assert {r["doc_id"] for r in pieces} == {r[0] for r in before}
        docs = spark.createDataFrame(after, out.schema)
    assert kept["toxicity"] >= kept["ngram_jaccard"] > 100


def test_run_is_the_stages_in_order(spark):
    out = run(spark, PATH)
    docs = spark.read.parquet(f"{PATH}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, PATH)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert Counter(as_rows(out.select(*columns))) == Counter(as_rows(docs.select(*columns)))
    assert corpus_pipeline.ORACLE_SQL is None
