"""Steps that are done once, within a row or by all tasks, and the same results as by the plainer way."""

from __future__ import annotations

import random
from pathlib import Path

from pyspark.sql import functions as F

from tradeloom.operators import checklist as C
from tradeloom.operators import heads as H
from tradeloom.operators import ordering as O
from tradeloom.operators import review as V
from tradeloom.operators import specs as S
from tradeloom.operators.batches import Flow, Stage
from tradeloom.plans import checklist, stores
from tradeloom.sources.shared import work_path
from tradeloom.sources.sinks import write_texts


def shuffled(spark, df) -> tuple[list[tuple], int]:
    """The rows of ``df``, sorted, and how many rows were written to shuffles for them."""
    sc = spark.sparkContext
    jvm, store = sc._gateway.jvm, sc._jsc.sc().statusStore()

    def written() -> int:
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(jvm.java.util.ArrayList(), False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = written()
    rows = sorted(map(tuple, df.collect()))
    return rows, written() - before


def test_votes_within_a_row(spark):
    rng = random.Random(7)
    rows = [(i // 9, i % 9, *rng.choices(["a", "b", "c", "", None], k=3)) for i in range(400)]
    wide = spark.createDataFrame(rows, "doc_id int, pos int, x string, y string, z string")
    ranks = {"x": 2, "y": 2, "z": 5}
    long = wide.select("doc_id", "pos", F.explode(F.array(*[F.struct(F.col(c).alias("token"), F.lit(p).alias("priority")) for c, p in ranks.items()])).alias("r")).select("doc_id", "pos", "r.*")
    got, n = shuffled(spark, O.votes_across(wide, [(F.col(c), p) for c, p in ranks.items()]).select("doc_id", "pos", F.coalesce("token", F.lit("-")), "votes"))
    by_place, m = shuffled(spark, O.token_votes(long).select("doc_id", "pos", F.coalesce("token", F.lit("-")), "votes"))
    assert got == by_place and n == 0 and m <= 3 * len(rows)


def test_stages_meet_their_documents_once(spark):
    n, add = 400, lambda d: d.withColumn("value", F.col("value") + 1)
    docs = lambda more: spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") * 10 + F.when(F.col("id") % 4 == 0, more).otherwise(0)).alias("value"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    root, stages = work_path(spark, "flow"), [Stage(s, add) for s in "abc"]
    try:
        Flow(spark, root, stages).run(docs(0)).count()

        class Later:
            def collect(self):
                return Flow(spark, root, stages).run(docs(1)).collect()

        rows, written = shuffled(spark, Later())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert rows == [(i, i * 10 + (i % 4 == 0) + 3) for i in range(n)]
    assert written < 20 * n


def test_gate_within_a_row(spark, sf):
    inputs = checklist._inputs(spark, sf)
    columns = ["shipment_id", "blocker_count", "warning_count", "blockers", "passed"]
    assert sorted(map(tuple, C.gated(*inputs).select(columns).collect())) == sorted(map(tuple, C.gate(C.checked(*inputs)).select(columns).collect()))
    assert "collect_set" not in C.gated(*inputs)._jdf.queryExecution().optimizedPlan().toString()


def test_rules_of_the_same_texts_are_found_as_one(spark):
    rules = [(i, f"10{i % 3}", ["Glue", None, ""][i % 3], [["tape roll", "tape"], ["x"], None][i % 4 % 3]) for i in range(2000)] + [(5, "102", "Roll", ["more"])]
    asked = [("tape", "all"), ("ro", "patterns"), ("10", "code"), ("glue", "all"), ("", "all"), ("zz", "all"), ("tape", "all")]
    r = spark.createDataFrame(rules, "id int, code string, category string, patterns array<string>")
    rows, n = shuffled(spark, V.rules_queried(r, spark.createDataFrame(asked, "word string, field string")))
    assert rows == sorted({(w, f, x.id, x.code) for w, f in asked if w for x in V.rules_found(r, w, f).select("id", "code").collect()})
    assert n < 3 * len(rules)


def test_items_are_made_once(spark):
    spec = {"name": "s", "detect": {"all_of": ["Shop"]}, "items": {"strategy": "line", "pattern": r"^(\d+) x (\S+) (\S+)$", "field_map": {"quantity": 1, "sku": 2, "total_cost": 3}, "types": {"quantity": "integer", "total_cost": "currency"}, "generated_fields": {"unit_cost": "total_cost / quantity"}}}
    docs = spark.createDataFrame([(1, "Shop\n2 x A 9.00\n2 x B 3.00"), (2, "Shop\nnothing"), (3, "else")], "doc_id int, text string")
    found = S.items_of(S.parsed(docs, [spec]))
    assert sorted((r.doc_id, r.item, r.sku, r.unit_cost, r.total_cost) for r in found.collect()) == [(1, 1, "A", 4.5, 9.0), (1, 2, "B", 1.5, 3.0)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(\\d+) x (\\S+)") == 4  # the whole and three groups


def test_texts_become_files_by_all_tasks(spark):
    path = work_path(spark, "texts")
    write_texts(spark.range(0, 200, 1, 1).select(F.concat(F.lit("t"), "id").alias("text")), path)
    files = sorted(Path(path.removeprefix("file:")).rglob("*.txt"))
    assert sorted(f.read_text() for f in files) == sorted(f"t{i}\n" for i in range(200))
    assert len({f.parent for f in files}) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_manifests_in_steps(spark):
    docs = spark.range(500).select(F.col("id").alias("k")).select(F.col("k").alias("doc_id"), F.expr(stores._MANIFEST).alias("text"))
    assert sorted(H.manifests(docs).select("doc_id", "m").collect()) == sorted(docs.select("doc_id", H.manifest(F.col("text")).alias("m")).collect())


def test_declarations_are_dealt_once_and_compressed(spark, sf, tmp_path, monkeypatch):
    """Lines are shuffled by file and no more; a file has whole declarations of its hundred, in order, and takes a part of their bytes."""
    import gzip
    from xml.etree import ElementTree

    from tradeloom.plans import files

    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    monkeypatch.setattr(files, "work_path", lambda _, name: str(tmp_path / name))

    class Written:
        def collect(self):
            return files._declarations(spark, sf).select("tariff_code").collect()

    read, n = shuffled(spark, Written())
    assert len(read) == lines.count() and n <= 1.5 * len(read)
    found, held = [], [p for p in (tmp_path / "declarations").iterdir() if p.name.startswith("part-")]
    for p in held:
        with gzip.open(p, "rt") as text:
            root = ElementTree.fromstring(text.read())
        assert root.tag == "Declarations" and 0 < len(root) <= files.DECLARATIONS
        found += [[int(i.findtext("Item_number")) for i in each] for each in root]
    assert sorted(map(len, found)) == sorted(r["count"] for r in lines.groupBy("l_orderkey").count().collect())
    assert all(each == list(range(1, len(each) + 1)) for each in found)
    assert sum(p.stat().st_size for p in held) < 100 * len(read)  # as texts they have about three times as many
