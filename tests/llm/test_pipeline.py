"""The pipeline's stages on planted documents, each held against what it must keep and drop."""

import random

import pytest

import corpus_pipeline
from waymark.llm.decontaminate import tokens_of

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    """Documents before and after each stage, on the small tables with planted rows."""
    from waymark.scratch import Scratch

    scratch = Scratch(spark, "test-pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rng = random.Random(1)
    word = lambda: "".join(rng.choice(["ba", "ke", "lo", "mi", "nu"]) for _ in range(4))
    base = [word() for _ in range(200)]
    near = list(base)
    near[100] = "changed"
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    planted = [(90001, " ".join(base)), (90002, " ".join(base)), (90003, " ".join(near)), (90004, " ".join(word() for _ in range(150))), (90005, f"{' '.join(word() for _ in range(60))} {item} {' '.join(word() for _ in range(60))}"), (90006, None), (90007, "")]
    extra = spark.createDataFrame([(i, t, "en", "planted", len(t or "")) for i, t in planted], docs.schema)
    tables = [scratch.keep(docs.unionByName(extra), "docs")]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(scratch.keep(stage(spark, tables[-1], SF), name))
    return tables


def ids(table):
    return {r.doc_id for r in table.select("doc_id").collect()}


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash", "decontaminate", "packing"]
    assert all(t.columns == stages[0].columns for t in stages[:5])


def test_toxicity_keeps_clean_rows(spark, stages):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = ids(stages[0]) - ids(stages[1])
    assert gone and not gone & set(range(90001, 90008))
    assert sum(labels.get(i) == 0 for i in gone) <= 0.02 * sum(x == 0 for x in labels.values())


def test_exact_keeps_the_largest_id(stages):
    before = {r.doc_id: r.text or "" for r in stages[1].collect()}
    want = {}
    for i, t in before.items():
        want[t] = max(i, want.get(t, i))
    assert ids(stages[2]) == set(want.values())


def test_near_copies_leave_one(stages):
    left = ids(stages[3])
    assert len({90002, 90003} & left) == 1 and 90004 in left
    assert len(left) > 0.9 * stages[2].count()


def test_benchmark_documents_go(spark, stages):
    items = [" ".join(tokens_of(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    held = {r.doc_id for r in stages[3].collect() if any(f" {i} " in f" {' '.join(tokens_of(r.text))} " for i in items)}
    assert ids(stages[3]) - ids(stages[4]) == held and 90005 not in ids(stages[4])


def test_packing_takes_all_that_is_left(stages):
    assert ids(stages[5]) == ids(stages[4])
    rows = stages[5].collect()
    assert sum(r.length for r in rows) == sum({r.doc_id: r.doc_tokens for r in rows}.values())


def test_entry_registers_the_pipeline():
    import re

    import __spark_entry__

    assert "pipeline" in __spark_entry__.queries() and {f"op{n}_" for n in range(1, 11)} == {m[0] for q in __spark_entry__.queries() if (m := re.match(r"op\d+_", q))}


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_odd_rows_pass_each_stage(spark, name):
    """Null, repeated, empty and very long rows, columns with the names that the stages might use, empty tables."""
    stage = dict(corpus_pipeline.STAGES)[name]
    rng = random.Random(3)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(60_000))
    rows = [(1, "one text", "x"), (1, "one text", "x"), (1, "another", "x"), (None, "one text", "y"), (None, None, None), (2, "", "x"), (None, long, "x"), (3, "\x00퟿ 𝔘 é", "x")]
    names = ["_id", "_sha", "_nth", "_digest", "text_key", "kept_id", "score", "path", "_"]
    schema = "doc_id long, text string, source string, lang string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    frame = spark.createDataFrame([(*r, "en", None, *[f"{n}{i}" for n in names]) for i, r in enumerate(rows)], schema)
    got = stage(spark, frame, SF)
    assert stage(spark, frame.limit(0), SF).collect() == []
    if name == "packing":
        assert sorted(str(r.doc_id) for r in got.filter("start = 0").collect()) == sorted(str(r[0]) for r in rows)
        return
    assert got.columns == frame.columns
    left = sorted(r["_id"] for r in got.collect())
    keeps = {"toxicity": range(8), "decontaminate": range(8), "exact_dedup": [0, 2, 5, 6, 7], "simhash": [0, 1, 2, 5, 6, 7]}
    assert left == [f"_id{i}" for i in keeps[name]] and left == sorted(r["_id"] for r in got.collect())


def test_rows_without_an_id_are_judged(spark):
    """A toxic row, a contaminated one and a near copy without ids go; their clean neighbours stay."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = ids(stages["toxicity"](spark, docs, SF))
    toxic = docs.filter(~docs.doc_id.isin(sorted(kept))).limit(1).first()
    nameless = spark.createDataFrame([(None, toxic.text, "en", "s", 1)], docs.schema)
    assert stages["toxicity"](spark, docs.unionByName(nameless), SF).filter("doc_id IS NULL").count() == 0
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    held = spark.createDataFrame([(None, f"before {item} after", "en", "s", 1), (None, "clean", "en", "s", 1)], docs.schema)
    assert [r.text for r in stages["decontaminate"](spark, held, SF).collect()] == ["clean"]


def test_near_stage_equals_all_pairs(spark, stages):
    """Rows that the near-copy stage keeps on the given tables, against the similarity of all pairs."""
    from tests.llm.test_near_copies import near_pairs

    rows = sorted((r.doc_id, r.text) for r in stages[2].collect() if r.text and r.text.split())
    label = {i: i for i, _ in rows}
    pairs = near_pairs([t for _, t in rows])
    for _ in range(len(pairs)):
        for a, b in pairs:
            label[rows[a][0]] = label[rows[b][0]] = min(label[rows[a][0]], label[rows[b][0]])
    blank = sorted(r.doc_id for r in stages[2].collect() if not (r.text and r.text.split()))[:1]
    assert ids(stages[3]) == set(label.values()) | set(blank)
