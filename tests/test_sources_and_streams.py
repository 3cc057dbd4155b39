import json
import zipfile

from pyspark.sql import functions as F
from pyspark.sql import types as T

from fondaco.sources import files, sinks
from fondaco.streaming.intake import append_once, latest_windows, stream_files, windowed_counts


def test_register_glossary_inventory(spark, tmp_path):
    (tmp_path / "r.csv").write_text("id,intestazione_pdf,nome\n1,,Rossi\n")
    r = files.read_register(spark, str(tmp_path / "r.csv"), T.StructType(files.REGISTER.fields[:3])).first()
    assert (r.id, r.intestazione_pdf, r.nome) == ("1", "", "Rossi")
    g = tmp_path / "g"
    g.mkdir()
    (g / "a.json").write_text(json.dumps({"entries": [{"@id": "x", "term": "Zug"}, {"@id": "x", "term": "Bataillon"}]}))
    assert [(e["@id"], e.term) for e in files.read_glossary(spark, str(g)).collect()] == [("x", "Bataillon")]
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "a.txt").write_text("a")
    (raw / "a.txt.metadata.json").write_text("{}")
    (raw / "b.txt").write_text("b")
    names = {p.path.rsplit("/", 1)[1] for p in files.inventory(spark, str(raw)).collect()}
    assert names == {"a.txt.metadata.json", "b.txt"}


def test_office_and_loose_csv(spark, tmp_path):
    p = tmp_path / "x.docx"
    with zipfile.ZipFile(p, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:t>Uno</w:t></w:p><w:p><w:t>Due</w:t></w:p></w:document>')
    df = spark.createDataFrame([(p.read_bytes(),), (b"no",), (None,)], "c binary")
    assert [r.t for r in df.select(files.docx_text(F.col("c")).alias("t")).collect()] == ["Uno\nDue", None, None]
    t = spark.createDataFrame([("nome;anno\nRossi;1920\n;\n",), ("",), (None,)], "t string").select(files.csv_text(F.col("t")).alias("t"))
    got = [r.t for r in t.collect()]
    assert got == ["Riga 1. nome: Rossi; anno: 1920", "", None]
    row = t.select(files.csv_rows(F.col("t")).alias("r")).first().r[0]
    assert row.row == 1 and [(f.k, f.v) for f in row.fields] == [("nome", "Rossi"), ("anno", "1920")]


def test_store_sinks(spark, tmp_path):
    a = spark.createDataFrame([(1, "r1"), (2, "r1")], "id int, run string")
    path = str(tmp_path / "store")
    assert sinks.append_store(a, path, "id", "run") == 2
    assert sinks.append_store(a.unionByName(spark.createDataFrame([(3, "r2")], "id int, run string")), path, "id", "run") == 1
    sinks.replace_run(spark.createDataFrame([(9, "r1")], "id int, run string"), path, "run")
    assert {r.id for r in spark.read.parquet(path).collect()} == {9, 3}
    sinks.write_extract(a, str(tmp_path / "csv"), ["id"])
    assert [r.id for r in spark.read.csv(str(tmp_path / "csv"), header=True).orderBy("id").collect()] == ["1", "2"]


def test_streams_match_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = [{"k": f"k{i % 7}", "at": f"2024-01-0{1 + i % 3}T00:00:00", "kind": "ab"[i % 2]} for i in range(20)]
    (src / "1.json").write_text("\n".join(map(json.dumps, rows)))
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("at", T.TimestampType()), T.StructField("kind", T.StringType())])
    s = lambda: stream_files(spark, str(src), schema)
    out, cp = str(tmp_path / "o"), str(tmp_path / "c")
    append_once(s(), "k", "at", "10 days", out, cp)
    (src / "2.json").write_text("\n".join(map(json.dumps, rows[:3] + [{"k": "new", "at": "2024-01-02T00:00:00", "kind": "a"}])))
    append_once(s(), "k", "at", "10 days", out, cp)
    assert sorted(r.k for r in spark.read.parquet(out).collect()) == sorted({r["k"] for r in rows} | {"new"})
    w, wc = str(tmp_path / "w"), str(tmp_path / "wc")
    windowed_counts(s(), "at", "1 day", "5 days", ["kind"], w, wc)
    batch = spark.read.schema(schema).json(str(src)).groupBy(F.window("at", "1 day").start.alias("d"), "kind").count()
    assert sorted(map(tuple, latest_windows(spark, w, ["window_start", "kind"]).collect())) == sorted(map(tuple, batch.collect()))


def test_adapter_source(spark):
    from fondaco.sources.adapters import AdapterSource

    class Echo:
        def schema(self):
            return "k string, n int"

        def plan(self):
            return [{"k": "a", "n": 2}, {"k": "b", "n": 1}]

        def fetch(self, request):
            yield from ((request["k"], i) for i in range(request["n"]))

    class EchoSource(AdapterSource):
        adapter = Echo()

        @classmethod
        def name(cls):
            return "echo_adapter"

    spark.dataSource.register(EchoSource)
    assert sorted(map(tuple, spark.read.format("echo_adapter").load().collect())) == [("a", 0), ("a", 1), ("b", 0)]
