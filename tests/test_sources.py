"""Readers, writers and streams."""

import pytest

from velspar.operators import taxonomy
from velspar.sources import files
from velspar.streaming import manifests


def test_notation_records(spark, tmp_path):
    (tmp_path / "n.txt").write_text("N 2\nC 25\n; 26\n$\nN 25\nC 25G\n$\nN 25G\n$\n")
    got = {r["node"]: r["children"] for r in files.read_notations(spark, str(tmp_path / "n.txt")).collect()}
    assert got == {"2": ["25", "26"], "25": ["25G"], "25G": []}
    edges = files.edges_of(files.read_notations(spark, str(tmp_path / "n.txt")))
    assert taxonomy.closure(spark, edges).where("node = '25G' and ancestor = '2'").first()["distance"] == 2
    lines = {r["line"] for r in files.skos_triples(files.read_notations(spark, str(tmp_path / "n.txt")), "http://x/").collect()}
    assert "<http://x/25G> <http://www.w3.org/2004/02/skos/core#broader> <http://x/25> ." in lines and len(lines) == 12


def test_triples_round_trip(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("# c\nhead\trelation\ttail\n\na\tin\tb\n b \tin\tc\n")
    got = files.read_triples(spark, str(tmp_path / "t.tsv"), True)
    assert sorted(map(tuple, got.collect())) == [("a", "in", "b"), ("b", "in", "c")]
    files.write_triples(got, str(tmp_path / "out"))
    assert sorted(map(tuple, files.read_triples(spark, str(tmp_path / "out")).collect())) == [("a", "in", "b"), ("b", "in", "c")]
    (tmp_path / "bad.tsv").write_text("a\tb\n")
    with pytest.raises(Exception, match="three parts"):
        files.read_triples(spark, str(tmp_path / "bad.tsv")).collect()


def test_jsonl_and_digest(spark, tmp_path):
    df = spark.createDataFrame([("b", 2, None), ("a", 1, "x")], "id string, n int, z string")
    files.write_jsonl(df, str(tmp_path / "j"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "j").glob("part*"))) == '{"id":"a","n":1,"z":"x"}\n{"id":"b","n":2,"z":null}\n'
    back = files.read_jsonl(spark, str(tmp_path / "j"), "id string, n int, z string")
    assert files.manifest_digest(back) == files.manifest_digest(df.orderBy("id"))
    assert files.file_digests(spark, str(tmp_path / "j")).count() >= 1


def test_label_map_and_embeddings(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"b.jpg": [" 25G", "25G", "", "11"],\n "a.jpg": []}')
    got = files.manifest_of(files.read_label_map(spark, str(tmp_path / "m.json")), "set").orderBy("id").collect()
    assert [(r["id"], r["labels"], r["split"]) for r in got] == [("set:a.jpg", [], None), ("set:b.jpg", ["11", "25G"], None)]
    files.save_embeddings(spark.createDataFrame([(1, [3.0, 4.0])], "id int, vector array<double>"), str(tmp_path / "e"), {"model": "m"})
    table, metadata = files.load_embeddings(spark, str(tmp_path / "e"))
    assert metadata == {"model": "m"} and table.first()["id"] == "1" and [round(x, 6) for x in table.first()["vector"]] == [0.6, 0.8]
    with pytest.raises(ValueError):
        files.save_embeddings(spark.createDataFrame([(1, [1.0]), (1, [1.0])], "id int, vector array<double>"), str(tmp_path / "f"), {})


def test_stream_resumes(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for k in range(2):
        (source / f"{k}.json").write_text(f'{{"id": "{k}"}}\n')
        manifests.append(manifests.records(spark, str(source), "id string"), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == k + 1
