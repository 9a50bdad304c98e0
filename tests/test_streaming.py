import random

from trees import lineage, shapes

from grove.streaming import LineageTable


def test_nodes_wait_for_their_parents(spark, tmp_path):
    edges = shapes()["sparse"]
    order = list(edges)
    random.Random(3).shuffle(order)
    source, schema = tmp_path / "in", "tree_id long, id long, ancestor_id long"
    for i in range(0, len(order), 14):
        spark.createDataFrame([(1, *e) for e in order[i : i + 14]] + [(2, i, 0 if i else i)], schema).coalesce(1).write.parquet(str(source / f"{i:03d}"))
    table = LineageTable(spark, str(tmp_path / "table"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source / "*"))
    table.start(stream, str(tmp_path / "checkpoint")).awaitTermination()
    rows = table.nodes().filter("tree_id = 1").collect()
    assert {(r.id, r.ancestor_id, r.node_depth, r.root_id) for r in rows} == {(i, a, len(lineage(edges, i)) - 1, lineage(edges, i)[-1]) for i, a in edges}
    assert table.waiting().count() == 0


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    table = LineageTable(spark, str(tmp_path))
    schema = "tree_id long, id long, ancestor_id long"
    table.add(spark.createDataFrame([(1, 0, 0), (1, 5, 9)], schema), 0)
    assert [r.id for r in table.waiting().collect()] == [5]
    second = spark.createDataFrame([(1, 9, 0), (1, 0, 0)], schema)
    for _ in range(2):
        table.add(second, 1)
        assert {(r.id, r.node_depth) for r in table.nodes().collect()} == {(0, 0), (9, 1), (5, 2)}
    assert table.waiting().count() == 0
