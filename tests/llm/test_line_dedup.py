from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wiresift.llm.line_dedup import LAST, SHARED, SMALL, dedup_lines, described, documents_without_lines, keyed, near, op4_prefix_line_dedup, prefixes, rarities, words

SCHEMA = "doc_id long, text string, key string, no int, nos string"


def brute_force(rows, keys, threshold=0.8):
    """{(doc_id, text): text} by comparing every line with every earlier one."""
    lines, seen = {}, []
    for (doc_id, text), key in sorted({(r, k) for r, k in zip(rows, keys, strict=True)}, key=lambda p: (p[0][0] if p[0][0] is not None else LAST, p[1])):
        if text is None:
            lines[(doc_id, text)] = None
            continue
        kept = []
        for line in text.split("\n"):
            own = {w for w in line.lower().replace("\t", " ").split(" ") if w}
            if not own or not any(len(own & s) >= threshold * len(own | s) - 1e-9 for s in seen):
                kept.append(line)
            if own:
                seen.append(own)
        lines[(doc_id, text)] = "\n".join(kept)
    return lines


def corpus(seed=0, docs=60):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(200)]
    chance = 1 / np.arange(1, 201)
    base = [rng.choice(vocabulary, rng.integers(1, 25), p=chance / chance.sum()).tolist() for _ in range(50)]
    rows = []
    for i in range(docs):
        lines = []
        for _ in range(int(rng.integers(1, 9))):
            line = list(base[int(rng.integers(0, len(base)))])
            for _ in range(int(rng.integers(0, 4))):
                line[int(rng.integers(0, len(line)))] = str(rng.choice(vocabulary))
            lines.append(" ".join(line).upper() if rng.random() < 0.1 else " ".join(line))
        rows.append((i, "\n".join(lines)))
    return rows


def check(spark, rows):
    docs = spark.createDataFrame([(i, t, "k", 3, "n") for i, t in rows], SCHEMA).repartition(3)
    keys = {(r["doc_id"], r["text"]): r["key"] for r in keyed(docs.select("doc_id", "text")).collect()}
    want = brute_force(rows, [keys[r] for r in rows])
    expected = sorted(str((i, want[(i, t)])) for i, t in rows)
    out = dedup_lines(docs).collect()
    assert sorted(str((r["doc_id"], r["text"])) for r in out) == expected
    whole = documents_without_lines(docs)
    assert whole.columns == docs.columns
    assert sorted(str((r["doc_id"], r["text"])) for r in whole.collect()) == expected
    return out


def test_against_all_pairs(spark):
    rows = corpus() + [(100, None), (101, ""), (102, "\n\n \t\n"), (None, "w1 w2 w3\nonly here"), (7, "w1 w2 w3"), (104, "one\n\none\nONE  one"), (105, "x y\n" * 3000)]
    out = check(spark, rows + [(104, "one\n\none\nONE  one")])
    assert sum(r["removed_lines"] for r in out) > 100


@pytest.mark.parametrize("hot", [2000, 3])
def test_more_corpora(spark, monkeypatch, hot):
    monkeypatch.setattr("wiresift.llm.line_dedup.HOT_LINES", hot)
    check(spark, corpus(hot, 40))


def test_a_family_of_variants(spark):
    words_ = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(words_[:i % 40] + [f"changed{i}"] + words_[i % 40 + 1 :])) for i in range(200)]
    out = check(spark, rows)
    assert sum(r["removed_lines"] for r in out) == 199


def test_filters_lose_nothing(spark):
    rows = corpus(5, 25)
    docs = keyed(spark.createDataFrame(rows, "doc_id long, text string"))
    lines = docs.select(F.col("doc").alias("at"), F.posexplode(F.split("text", "\n")).alias("no", "line"))
    grades = rarities(docs)
    p = prefixes(described(lines, grades, 0.8))
    met = p.alias("a").join(p.alias("b"), F.col("a.word") == F.col("b.word")).where(near("a", "b", 0.8))
    met = Counter((r[0], r[1], r[2], r[3]) for r in met.select("a.at", "a.no", "b.at", "b.no").collect())
    sets = {(r["at"], r["no"]): set(r["w"]) for r in lines.select("at", "no", words(F.col("line")).alias("w")).collect()}
    for a, x in sets.items():
        for b, y in sets.items():
            if len(x & y) >= 0.8 * len(x | y):
                assert met[(*a, *b)] >= (SHARED if len(x) >= SMALL else 1 if x else 0)


def test_a_family_costs_a_pair_a_line(spark):
    """Twice the variants make about twice the pairs, not four times."""
    import wiresift.llm.line_dedup as module

    made = []
    for n in (300, 600):
        rng, words_ = np.random.default_rng(0), [f"w{i}" for i in range(60)]
        rows = [(i, " ".join(words_[:k] + [f"changed{i}"] + words_[k + 1 :])) for i, k in enumerate(rng.integers(0, 60, n).tolist())]
        own = keyed(spark.createDataFrame(rows, "doc_id long, text string")).select("doc", "key", "text")
        first = module.first_lines(own)
        lines = module.stored(described(module.lines_of(module.once(own), first, "first"), rarities(own), 0.8), "test-lines")
        tried = module.nearest_first(lines, 0.8)
        matched = module.similar(tried, module.once(own), first, 0.8).select("y.*")
        assert matched.count() == n - 1
        marked = lines.join(matched.withColumn("gone", F.lit(1)), ["at", "no"], "left").withColumn("open", F.col("gone").isNull()).drop("gone")
        made.append(tried.count() + module.meeting(marked, 0.8).count())
    assert made[1] <= 2.2 * made[0]


def variants(spark, n, changed=4):
    """``n`` lines of 54 words each, 50 of which all share: each two are at the threshold."""
    import wiresift.llm.line_dedup as module

    rows = [(i, 0, " ".join([f"w{k}" for k in range(50)] + [f"own{i}x{k}" for k in range(changed)])) for i in range(n)]
    lines = spark.createDataFrame(rows, "at long, no int, line string")
    docs = lines.select(F.col("line").alias("text"))
    return described(lines, rarities(docs), 0.8).withColumn("open", F.col("at") >= 0), module


def test_lines_of_a_family_meet_once(spark):
    lines, module = variants(spark, 30)
    for family, most in ((True, 1), (False, 20)):
        met = module.encounters(lines.withColumn("family", F.lit(family)), 0.8)
        assert met.distinct().count() == 30 * 29 // 2
        assert met.count() <= most * 30 * 29 // 2


@pytest.mark.parametrize("hot", [20_000, 20, 3])
def test_families_meet_whichever_words_are_hot(spark, monkeypatch, hot):
    monkeypatch.setattr("wiresift.llm.line_dedup.HOT_LINES", hot)
    lines, module = variants(spark, 24)
    assert module.meeting(lines.withColumn("family", F.col("at") % 3 > 0), 0.8).count() == 24 * 23 // 2


def test_rows_of_long_lines_stay_short(spark):
    """A family's line of n words has about n / 5 prefix rows; with all words before its own each, they would grow with n squared."""
    lines, module = variants(spark, 3, changed=400)
    rows = module.keyed_rows(lines.withColumn("family", F.lit(True))).withColumn("n", F.size("prior"))
    assert rows.agg(F.max("place")).first()[0] > 50
    assert rows.agg(F.max("n")).first()[0] == module.PRIOR


@pytest.mark.parametrize("hot, fewer", [(20_000, 1), (20, 0)])
def test_a_second_shared_word_is_asked_for_only_where_words_are_hot(spark, monkeypatch, hot, fewer):
    monkeypatch.setattr("wiresift.llm.line_dedup.HOT_LINES", hot)
    lines, module = variants(spark, 24, changed=0)
    lines = lines.where("at < 1") if fewer else lines
    longest = lines.agg(F.max(F.size("prefix"))).first()[0]
    single = module.keyed_rows(lines).where("size(prior) = 0")
    assert single.groupBy("at").count().agg(F.max("count")).first()[0] == (longest - 1 if fewer else longest * (longest - 1) // 2)


@pytest.mark.parametrize("hot", [20_000, 20])
def test_prefix_rows_are_dealt_out_once(spark, monkeypatch, hot):
    """Hot words are few and sent to the rows; both sides of a join by word are one exchange."""
    monkeypatch.setattr("wiresift.llm.line_dedup.HOT_LINES", hot)
    lines, module = variants(spark, 30)
    lines = module.stored(lines.withColumn("family", F.lit(True)), "test-lines")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for joined in (module.encounters(lines, 0.8), module.offers(lines, 0.8, 0.6)):
            joined.collect()
            plan = joined._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
            assert "ReusedExchange" in plan
            assert plan.count("SortMergeJoin") == 1
            assert not any("SortMergeJoin" in line and ("LeftAnti" in line or "LeftSemi" in line) for line in plan.split("\n"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_a_text_of_very_many_lines(spark):
    text = "\n".join(f"line number {i} of this text, {i * 7} words, {i % 1000} more" for i in range(100_000))
    docs = spark.createDataFrame([(1, text), (2, "line number 5 of this text, 35 words, 5 more")], "doc_id long, text string")
    out = {r["doc_id"]: r for r in dedup_lines(docs).collect()}
    assert out[1]["lines"] == 100_000 and out[2]["text"] == "" and out[2]["removed_lines"] == 1


def test_clashing_columns_come_back(spark):
    names = ["doc", "key", "kept", "_doc", "_key", "_nos", "nos", "at", "lines", "_rows", "_row"]
    rows = [(i, "one two three four five\nother words here now " + str(i % 2), *range(len(names))) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    out = documents_without_lines(docs)
    assert out.columns == docs.columns
    assert all(tuple(r)[2:] == tuple(range(len(names))) for r in out.collect()) and out.count() == 4
    assert dedup_lines(docs).count() == 4


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame(corpus(3, 10), "doc_id long, text string")
    plan = dedup_lines(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert dedup_lines(empty).count() == 0 and documents_without_lines(empty).count() == 0


def test_registered_query(spark):
    path = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    want = brute_force(rows, [0] * len(rows))
    out = op4_prefix_line_dedup(spark, path).collect()
    assert sorted((r["doc_id"], r["text"]) for r in out) == sorted((i, want[(i, t)]) for i, t in rows)


def test_a_word_s_lines_meet_by_size(spark):
    """Lines of very different size do not come to one key, and of those at the threshold none are parted."""
    import wiresift.llm.line_dedup as module

    sizes = [*range(1, 30), *range(30, 400, 3)]
    rows = spark.createDataFrame([(n, n, 0, 7) for n in sizes], "at long, size int, place int, word int")
    keys = {}
    for r in module.banded(rows, 0.8).collect():
        keys.setdefault(r["word"], []).append((r["at"], r["up"]))
    met = Counter(frozenset((a, b)) for of_key in keys.values() for a, up in of_key for b, also in of_key if a < b and not (up and also))
    assert max(met.values()) == 1
    assert all(met[frozenset((a, b))] for a in sizes for b in sizes if a < b and a >= 0.8 * b - 1e-9)
    assert 3 * sum(len(of_key) ** 2 for of_key in keys.values()) < len(sizes) ** 2


@pytest.mark.parametrize("gap", ["\t", "  ", "\v", " \f ", "\r"])
def test_words_between_any_white_space(spark, gap):
    line = gap.join(["", "Öl", "b", "C", "b", ""])
    docs = spark.createDataFrame([(line,)], "text string")
    assert sorted(docs.select(words(F.col("text"))).first()[0]) == ["b", "c", "öl"]
    assert sorted(g for g in rarities(docs) if g) == sorted(int(256 * np.log2(1 + n)) for n in (2, 1, 1))


def test_packed_rows_come_back(spark):
    import wiresift.llm.line_dedup as module

    top = (1 << 31) - 1
    rows = [(5, 1 << 40, 3, 47, 2, -1, 1 << 62, True, False, [9]), (-6, top, top, top, top - 1, 0, -(1 << 63), False, True, []), (7, 0, 1 << 30, 65536, 65535, 1, 2, True, True, [1, 2])]
    frame = spark.createDataFrame(rows, "word int, at long, no int, size int, place int, even long, odd long, open boolean, up boolean, prior array<bigint>")
    assert sorted(tuple(r) for r in module.unpacked(module.packed(frame)).select(*frame.columns).collect()) == sorted(rows)
