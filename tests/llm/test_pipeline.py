"""The pipeline: every stage against a plain version on its own input, and odd rows."""

from __future__ import annotations

import corpus_pipeline as cp
from tests.conftest import SF_SMALL
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_near_dup import brute as groups
from veracity.sources.tables import read_table


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_every_stage_on_its_own_input(spark):
    docs = read_table(spark, SF_SMALL, "documents")
    columns = docs.columns
    stages = dict(cp.STAGES)
    assert list(stages) == ["language_id", "near_dup", "decontamination", "mixing", "sharding"]
    kept = cp.materialise(stages["language_id"](spark, docs, SF_SMALL), "t")
    lettered = [r["doc_id"] for r in docs.collect() if r["text"] and any(c.isalpha() for c in r["text"])]
    assert kept.columns == columns and ids(kept) == sorted(lettered)

    before = [(r["doc_id"], r["text"]) for r in kept.collect()]
    kept = cp.materialise(stages["near_dup"](spark, kept, SF_SMALL), "t")
    want = groups(before, 5, 80)
    assert kept.columns == columns and ids(kept) == sorted(i for i, (_, c) in want.items() if c == i)

    before = [(r["doc_id"], r["text"]) for r in kept.collect()]
    items = [(r["item_id"], r["text"]) for r in read_table(spark, SF_SMALL, "benchmark").collect()]
    kept = cp.materialise(stages["decontamination"](spark, kept, SF_SMALL), "t")
    want = contaminated(before, items)
    assert kept.columns == columns and ids(kept) == sorted(i for i, x in want.items() if not x[3])

    from veracity.llm import mixing
    sampled = {r["doc_id"] for r in mixing.mix(kept).collect() if r["sampled"]}
    kept = cp.materialise(stages["mixing"](spark, kept, SF_SMALL), "t")
    assert kept.columns == columns and set(ids(kept)) == sampled and sampled

    last = stages["sharding"](spark, kept, SF_SMALL)
    rows = last.collect()
    assert last.columns == [*columns, "v_slot", "shard"] and len(rows) == len(sampled)
    assert len({(r["v_slot"], r["shard"]) for r in rows}) == len({r["v_slot"] for r in rows})
    assert {r["shard"] for r in rows} <= set(range(cp.SHARDS))
    assert ids(cp.run(spark, SF_SMALL)) == ids(last)


def test_odd_rows_pass_every_stage(spark, edge_docs, empty_docs):
    for name, stage in cp.STAGES:
        got = stage(spark, edge_docs, SF_SMALL)
        assert got.count() <= edge_docs.count(), name
        assert [c for c in got.columns if c not in ("v_slot", "shard")] == [
            c for c in edge_docs.columns if c not in ("v_slot", "shard")], name
        assert stage(spark, empty_docs, SF_SMALL).count() == 0, name
