"""Line and exact duplicates, shards and manifests: odd rows, batches, round trips."""

import hashlib
import math
import random
from collections import defaultdict

import pytest

from waymark.llm.exact_dedup import Claimed, DigestIndex, buckets_for, exact_dedup
from waymark.llm.line_dedup import line_dedup
from waymark.llm.sharding import Conflict, Shard, ShardStore, plan_runs, tier


# -- lines ---------------------------------------------------------------------


def slow_lines(docs, least, chars):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    seen = defaultdict(set)
    for i, text in docs:
        for line in (text or "").split("\n"):
            seen[key(line)].add(i)
    common = {k for k, ids in seen.items() if len(ids) >= least and len(k) >= chars}
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in common]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


@pytest.mark.parametrize("least,chars", [(3, 1), (2, 3)])
def test_lines_equal_a_slow_version(spark, least, chars):
    rng = random.Random(least)
    lines = ["Foo", " foo\t", "FOO ", "Éa", "éa", "", " ", " foo", "ab", "é", "x y", "a\rb"]
    docs = [(i % 37, "\n".join(rng.choice(lines) + rng.choice(["", "", str(rng.randrange(30))]) for _ in range(rng.randrange(12)))) for i in range(45)]
    docs += [(100, None), (101, ""), (None, "Foo\nonly"), (None, "Foo"), (102, "Foo\n" * 40_000)]
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n_lines int").repartition(4)
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in line_dedup(frame, least, chars).collect()), key=str)
    assert got == sorted(slow_lines(docs, least, chars), key=str)


def test_lines_of_an_empty_table(spark):
    assert line_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# -- exact -----------------------------------------------------------------------


def test_exact_odd_rows(spark):
    docs = [(1, "a"), (5, "a"), (3, "a"), (2, None), (4, ""), (7, "b"), (7, "b"), (None, "c"), (None, "c"), (8, "A"), (9, "a "), (None, "a")]
    rows = exact_dedup(spark.createDataFrame([(*d, True) for d in docs], "doc_id long, text string, kept boolean")).collect()
    assert len(rows) == len(docs)
    by = defaultdict(list)
    for r in rows:
        assert r.text_sha256 in {hashlib.sha256((t or "").encode()).hexdigest() for _, t in docs}
        by[r.text_sha256].append(r)
    sizes = sorted((len(g), g[0].group_size, g[0].keep_id, sum(r.kept for r in g)) for g in by.values() if g[0].keep_id is not None)
    assert sizes == [(1, 1, 8, 1), (1, 1, 9, 1), (2, 2, 4, 1), (2, 2, 7, 1), (4, 4, 5, 1)]
    nulls = [g for g in by.values() if g[0].keep_id is None]
    assert len(nulls) == 1 and sum(r.kept for r in nulls[0]) == 1
    assert exact_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_index_persists_over_batches(spark, tmp_path):
    index = DigestIndex(spark, f"file://{tmp_path}/index", buckets=4)
    frame = lambda *d: spark.createDataFrame(list(d), "doc_id long, text string")
    first = {r.doc_id: r.kept for r in index.add(frame((1, "a"), (2, "b"))).collect()}
    second = {r.doc_id: (r.kept, r.keep_id) for r in index.add(frame((9, "a"), (3, "c"), (4, "c"))).collect()}
    assert first == {1: True, 2: True} and second == {9: (False, 1), 3: (False, 4), 4: (True, 4)}
    assert index.rows().count() == 3
    plan = index.rows().hint("merge").join(index.rows().select("digest"), "digest")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan


def test_a_repeated_batch_gets_the_same_answer(spark, tmp_path):
    """The first try dies between the append and its answer; the job is run again under its batch's name."""
    index = DigestIndex(spark, f"file://{tmp_path}/index", buckets=4)
    frame = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id long, text string")
    index.add(frame.filter("doc_id = 3"), batch="old").count()
    append = DigestIndex._release
    try:
        DigestIndex._release = lambda self: 1 / 0
        with pytest.raises(ZeroDivisionError):
            index.add(frame, batch="new")
    finally:
        DigestIndex._release = append
    assert index.rows().count() == 2
    with pytest.raises(Claimed):
        index.add(frame, batch="other")
    again = {r.doc_id: (r.kept, r.keep_id) for r in index.add(frame, batch="new").collect()}
    assert again == {1: (False, 2), 2: (True, 2), 3: (False, 3)} and index.rows().count() == 2
    assert {r.doc_id: r.kept for r in index.add(frame, batch="later").collect()} == {1: False, 2: False, 3: False}


def test_buckets_grow_and_tables_go(spark, tmp_path):
    assert [buckets_for(n) for n in (0, 1, 16_000_000, 16_000_001, 10**12)] == [16, 16, 16, 32, 1 << 16]
    tables = lambda: {t.name for t in spark.catalog.listTables() if t.name.startswith("digest_index")}
    before = tables()
    index = DigestIndex(spark, f"file://{tmp_path}/index", buckets=2)
    index.add(spark.createDataFrame([(i, str(i)) for i in range(50)], "doc_id long, text string")).count()
    wide = index.rebucket(f"file://{tmp_path}/wide", 8)
    assert wide.buckets == 8 and index.buckets == 2 and sorted(wide.rows().collect()) == sorted(index.rows().collect())
    index.drop(), wide.drop()
    exact_dedup(spark.createDataFrame([(1, "a")], "doc_id long, text string")).collect()
    assert tables() == before


# -- shards -----------------------------------------------------------------------


def test_runs_are_of_one_tier_and_near_the_target():
    rng = random.Random(5)
    shards = tuple(Shard(f"p{i}", 1, rng.choice([1, 2, 3, 5, 20, 40, 70, 120]) * 1000) for i in range(200))
    runs = plan_runs(shards, 100_000, floor_bytes=1500, fanout=4)
    assert runs and len({s.path for r in runs for s in r}) == sum(map(len, runs))
    for run in runs:
        assert len({tier(s.bytes, 1500, 4) for s in run}) == 1 and sum(s.bytes for s in run) <= 100_000 and len(run) > 1
        assert all(s.bytes < 50_000 for s in run)
    assert plan_runs((), 10) == [] and plan_runs((Shard("a", 1, 5),) * 2, 1000, 1) == []


def test_round_trip_and_versions(spark, tmp_path):
    rng = random.Random(6)
    rows = [(rng.choice([i, i, None]), rng.choice([None, "", f"text {i} " * rng.randrange(60)]), i) for i in range(900)] + [(3, "same", 1)] * 5
    schema = "doc_id long, text string, run int"
    store = ShardStore(spark, f"file://{tmp_path}/s", target_bytes=30_000, floor_bytes=512)
    for k in range(3):
        store.append(spark.createDataFrame(rows[k::3], schema).repartition(12))
    before = store.manifest()
    after = store.compact()
    assert len(after.shards) < len(before.shards) / 2 and after.version > before.version
    assert sorted(map(str, store.read().collect())) == sorted(map(str, store.read(before.version).collect()))
    assert sorted(map(str, ((r.doc_id, r.text, r.run) for r in store.read().collect()))) == sorted(map(str, rows))
    assert sum(s.rows for s in after.shards) == len(rows)
    assert not plan_runs(after.shards, 30_000, 512)
    assert store.vacuum() > 0 and store.versions() == [after.version] and store.read().count() == len(rows)
    assert store.append(spark.createDataFrame([], schema)).shards == after.shards


def test_a_version_is_committed_once(spark, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/s")
    base = store.append(spark.createDataFrame([(1,)], "a int"))
    store._commit(base, base.schema, base.shards)
    with pytest.raises(Conflict):
        store._commit(base, base.schema, ())
    assert store.manifest().shards == base.shards and math.isclose(len(store.versions()), 2)


def test_query_over_odd_tables(spark, tmp_path):
    """Empty, null and repeated rows, and columns with the names that the store might use itself."""
    from waymark.llm.sharding import op10_sharding

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "a", "en", "x", 1), (1, "a", "en", "x", 1), (None, None, None, None, None), (2, "", "de", "y", 0), (3, "long " * 100_000, "fr", "z", 500_000)]
    for name, some in (("full", rows), ("empty", [])):
        spark.createDataFrame(some, schema).repartition(2).write.parquet(f"file://{tmp_path}/{name}/documents.parquet")
        got = op10_sharding(spark, f"file://{tmp_path}/{name}").collect()
        want = [(i, la, so, n, hashlib.sha256((t or "").encode()).hexdigest()) for i, t, la, so, n in some]
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_columns_of_any_name_are_stored(spark, tmp_path):
    frame = spark.createDataFrame([(i, f"p{i}", i, "m") for i in range(40)], "run int, shard_path string, path int, _metadata string").repartition(8)
    store = ShardStore(spark, f"file://{tmp_path}/s", target_bytes=1 << 20, floor_bytes=64)
    before = store.append(frame)
    after = store.compact()
    assert len(after.shards) < len(before.shards) and sorted(store.read().collect()) == sorted(frame.collect())
    assert store.read().columns == frame.columns


def test_a_writer_that_was_late_appends_again(spark, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/s")
    first = store.append(spark.createDataFrame([(1,)], "a int"))
    stale = [first]
    newest = store.manifest
    store._commit(first, first.schema, first.shards)
    store.manifest = lambda version=None: stale.pop() if stale else newest(version)
    assert store.append(spark.createDataFrame([(2,)], "a int")).version == 3
    assert sorted(r.a for r in store.read().collect()) == [1, 2]
