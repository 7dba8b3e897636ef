"""Sequences, tries, trees, versions, JSON and the mutation log."""

import json

import pytest
from pyspark.sql import functions as F

from quiverflow.graph import PropertyGraph
from quiverflow.operators.listops import Seq
from quiverflow.operators.tree import Tree
from quiverflow.operators.trie import Trie
from quiverflow.sources.pg_json import from_rows, is_pg, load, to_json
from quiverflow.streaming.live import Live, apply_log, follow

#: A vertex with two labels, array values, edges without ids.
TEXT = (
    '{"nodes":[{"id":"ship-1","labels":["Vessel"],"properties":{"title":["Petrel"],"decks":[4]}},{"id":"port-7","labels":["Place","Harbour"],"properties":{"title":["Lerwick"],"berths":["north","quay 2"]}}],'
    '"edges":[{"from":"ship-1","to":"port-7","labels":["MOORED_AT","REGISTERED_IN"],"properties":{"year":[1987]}},{"from":"port-7","to":"ship-1","labels":["SUPPLIES"],"properties":{"year":[1990]}}]}'
)


def test_sequences(spark):
    s = Seq.of(spark, 21, 8, 34, 13, 55, 5, 89)
    assert s.after(lambda v: v == 13).toArray() == [55, 5, 89] and s.before(lambda v: v == 13).toArray() == [21, 8, 34]
    assert s.takeWhile(lambda v: v < 50).toArray() == [21, 8, 34, 13] and s.skipWhile(lambda v: v != 5).toArray() == [5, 89]
    assert s.skip(5).toArray() == [5, 89] and s.take(2).toArray() == [21, 8] and (s.head(), s.last()) == (21, 89)
    assert s.every(lambda v: v > 4) and not s.some(lambda v: v > 90) and s.reject(lambda v: v > 10).toArray() == [8, 5]
    assert Seq.of(spark, 7, 7, 2, 9, 2).distinct().toArray() == [7, 2, 9] and Seq.range(spark, -1, -4).toArray() == [-1, -2, -3, -4]
    assert s.sort().toArray() == sorted([21, 8, 34, 13, 55, 5, 89]) and s.equals(Seq.of(spark, 0, 21, 8, 34, 13, 55, 5, 89).skip(1)) and not s.equals(s.take(3))


def test_trie(spark):
    t = Trie.fromArray(spark, [("tern", 1), ("gull", 2), ("teal", 3)])
    assert t.keys() == ["tern", "teal", "gull"] and t.words == 3 and t.nodes == 11
    assert t.get("gull") == 2 and t.hasPartial("te") and not t.has("te") and not t.remove("gull").has("gull")
    assert t.add("tern", 9).toMap() == {"tern": 9, "teal": 3, "gull": 2} and t.keyHasValue("teal", 3) and sorted(t.values()) == [1, 2, 3]


def test_tree(spark):
    t = Tree.from_(spark, "a", "a").addChild("a", "b", "b").addChild("a", "c", "c").addChild("b", "d", "d")
    assert t.depthFirst() == ["a", "b", "d", "c"] and t.breadthFirst() == ["a", "b", "c", "d"]
    assert t.depth("d") == 2 and t.contains("a", "d") and t.remove("b").depthFirst() == ["a", "c", "d"] and t.detach("b").depthFirst() == ["a", "c"]
    assert Tree.deserialize(spark, t.serialize()).equals(t) and t.setValue("c", "x").depthFirst()[-1] == "x" and t.clone().equals(t)
    with pytest.raises(ValueError):
        t.move("b", "d")


def test_tree_ids_are_no_sql_and_trees_may_be_deep(spark):
    t = Tree.from_(spark, "r", "r").addChild("r", "q", "o'x {t}")
    assert [r["value"] for r in t.walk("o'x {t}").collect()] == ["q"] and t.depth("o'x {t}") == 1
    chain = [(f"n{k}", f"n{k - 1}" if k else None, 0, str(k)) for k in range(150)]
    assert Tree(spark.createDataFrame(chain, "id string, parent_id string, pos int, value string")).walk().count() == 150


def test_versions_and_events(modern):
    live = Live(modern, lambda g: g.V().hasLabel("PERSON").count())
    new = modern.addVertex(["PERSON"], {"name": "zoe"}, "9")
    assert live.value == [5] and new.getProperty("9", "name") == "zoe" and not modern.hasVertex("9")
    assert new.removeVertex("1").edgeCount() == 3
    off = modern.on("@vertex/remove", lambda e: e.preventDefault())
    assert modern.removeVertex("1") is modern
    off()
    live.stop()


def test_mutation_log(spark, modern):
    log = spark.createDataFrame([("addVertex", "9", ["PERSON"], None, None), ("addEdge", "90", ["KNOWS"], "1", "9"), ("addEdge", "91", ["KNOWS"], "1", "none"), ("removeVertex", "3", None, None, None)], "op string, id string, labels array<string>, src string, dst string")
    g = apply_log(modern, log)
    assert g.vertices.count() == 6 and g.edges.filter(F.col("id").isin("90", "91")).count() == 1 and g.edges.count() == 4


def test_mutation_log_of_labels_and_properties(spark, modern):
    rows = [("addLabelToVertex", "1", ["ADMIN"], None, None, 1), ("removeLabelFromVertex", "2", ["PERSON"], None, None, 1), ("setVertexProperty", "1", None, "age", "30", 1), ("setVertexProperty", "1", None, "age", "31", 2), ("removeVertexProperty", "2", None, "age", None, 1), ("setEdgeProperty", "7", None, "note", "old", 1)]
    g = apply_log(modern, spark.createDataFrame(rows, "op string, id string, labels array<string>, key string, value string, version long"))
    assert sorted(g.V().hasLabel("ADMIN").values("age").toArray()) == [31] and g.V().hasLabel("PERSON").count().toArray() == [3]
    assert g.V("2").values("age").toArray() == [] and g.E().has("note", "old").id().toArray() == ["7"]
    with pytest.raises(ValueError):
        apply_log(modern, spark.createDataFrame([("paint", "1")], "op string, id string"))


def test_follow_restarts(spark, modern, tmp_path):
    seen = []
    spark.createDataFrame([("addVertex", "9", ["PERSON"])], "op string, id string, labels array<string>").coalesce(1).write.json(str(tmp_path / "log"))
    for more in (None, "10"):
        if more:
            spark.createDataFrame([("addVertex", more, ["PERSON"])], "op string, id string, labels array<string>").coalesce(1).write.mode("append").json(str(tmp_path / "log"))
        stream = spark.readStream.schema("op string, id string, labels array<string>").json(str(tmp_path / "log"))
        follow(seen[-1] if seen else modern, stream, seen.append, str(tmp_path / "check")).awaitTermination()
    assert [g.V().hasLabel("PERSON").count().toArray() for g in seen] == [[5], [6]]


def test_properties_are_merged_and_removed_together(modern):
    kinds = []
    offs = [modern.on(f"@vertex/{k}", lambda e: kinds.append(e.type)) for k in ("setProperties", "removeProperty", "removeProperties")]
    g = modern.setProperties("vertex", "1", {"age": 30, "town": "x"})
    assert g.V("1").values("name", "town").toArray() == ["marko", "x"] and g.V("1").values("age").toArray() == [30]
    assert g.removeProperties("vertex", "1", ["name", "town"]).V("1").valueMap().toArray() == [{"age": 30}]
    assert kinds == ["@vertex/setProperties", "@vertex/removeProperties"]
    assert sorted(map(str, modern.setProperty("vertex", "1", "age", "old").V().values("age").toArray())) == ["27", "32", "35", "old"]
    for off in offs:
        off()


def test_json(spark):
    g = PropertyGraph.from_json(spark, TEXT)
    assert sorted(r["id"] for r in g.edges.collect()) == ["port-7-[SUPPLIES]->ship-1", "ship-1-[MOORED_AT,REGISTERED_IN]->port-7"]
    assert g.V().hasLabel("Harbour").outE("SUPPLIES").inV().values("title").toArray() == [["Petrel"]]
    assert json.loads(to_json(g, "ship-1")) == {"id": "ship-1", "labels": ["Vessel"], "properties": {"decks": [4.0], "title": ["Petrel"]}}
    assert is_pg(json.loads(g.to_json())) and PropertyGraph.from_json(spark, g.to_json()).size() == 4
    with pytest.raises(ValueError):
        PropertyGraph.from_json(spark, TEXT.replace('"to":"port-7"', '"to":"none"'))


def test_json_read_in_few_jobs(spark, tmp_path):
    """However many properties there are, reading takes the same jobs; elements are dealt out before they are parsed."""
    jobs, long = [], [123456789012345678901234, "x"]
    for n in (2, 12):
        props = lambda k: {f"p{i}": [[k], [f"s{k}"], long][i % 3] for i in range(n)}  # noqa: B023, E731
        nodes = [{"id": f"v{k}", "labels": ["A"], "properties": props(k)} for k in range(4)]
        edges = [{"from": f"v{k}", "to": "v0", "labels": ["B"], "properties": {"w": [k + x], "late": [x]}} for k in range(4) for x in (0, 0.5)]
        rows = [(kind, k, json.dumps(x)) for kind, xs in (("node", nodes), ("edge", edges)) for k, x in enumerate(xs)]
        spark.sparkContext.setJobGroup(f"json {n}", "")
        g = from_rows(spark.createDataFrame(rows, "kind string, seq long, json string").coalesce(1))
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"json {n}")))
        (tmp_path / f"{n}.json").write_text(json.dumps({"nodes": nodes, "edges": edges}))
        for read in (g, load(spark, str(tmp_path / f"{n}.json"))):
            want = {f"p{i}": [[2.0], ["s2"], ["123456789012345678901234", "x"]][i % 3] for i in range(n)}
            assert read.vertices.filter("id = 'v2'").first().asDict() == {"id": "v2", "seq": 2, "labels": ["A"]} | want
            assert sorted((r["id"], r["w"], r["late"]) for r in read.edges.collect()) == [(f"v{k}-[B]->v0", [float(k)], [0.0]) for k in range(4)]
            assert "REPARTITION_BY_COL" in read.vertices._jdf.queryExecution().toString()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1]
