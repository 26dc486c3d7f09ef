"""Alignment files are read with all cells of a line."""

from pyspark.sql import functions as F

from phonospark.sources import readers, sinks


def test_long_alignment_line(spark, tmp_path):
    cells = [f"c{i}" for i in range(10050)]
    (tmp_path / "a.msa").write_text("title\nsub\n" + "\t".join(["Name..", *cells]) + "\nalone\nShort\tx\n")
    got = {r["name"]: r["cells"] for r in readers.read_alignments(spark, str(tmp_path / "*.msa")).collect()}
    assert got == {"Name": cells, "Short": ["x"]}


def test_tables_of_features(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("GRAPHEME\tFEATURES\np\tstop|voiceless\n\u00e3\tvowel\np\tstop|bilabial\n")
    got = {r.grapheme: r.features for r in readers.read_categorical(spark, str(tmp_path / "a.tsv")).collect()}
    assert got == {"p": ["bilabial", "stop"], "a\u0303": ["vowel"]}
    (tmp_path / "v.tsv").write_text("GRAPHEME\tFEATURES\np\tx (any)=+|y=-\np\tx (any)=-|y=-\n")
    assert [r.features for r in readers.read_valued(spark, str(tmp_path / "v.tsv")).collect()] == [["x (any)=?", "y=-"]]
    (tmp_path / "l.tsv").write_text("GLOTTOCODE\tNAME\na\tOld\nb\tB\na\tNew\n")
    assert {r.GLOTTOCODE: r.NAME for r in readers.read_languages(spark, str(tmp_path / "l.tsv")).collect()} == {"a": "New", "b": "B"}
    (tmp_path / "i.tsv").write_text("INVENTORY\tGLOTTOCODE\tSEGMENTS\n1\ta\tp  t k\n")
    assert readers.read_inventories(spark, str(tmp_path / "i.tsv")).first().segments == ["p", "t", "k"]


def test_forms(spark, tmp_path):
    d = tmp_path / "set" / "cldf"
    d.mkdir(parents=True)
    (d / "forms.csv").write_text("ID,Segments\n1,p a + t\n2,\n")
    assert [tuple(r) for r in readers.read_forms(spark, str(tmp_path / "*/cldf/forms.csv")).collect()] == [("set", "1", ["p", "a", "t"])]


def test_rebuilt_cells(spark):
    rows = spark.createDataFrame([("\u0261", "+", ".", "+"), ("q", ".", "-", ".")], "GRAPHEME string, x string, y string, z string")
    up = spark.createDataFrame([("g", "N", "0"), ("p", "+", "+")], "Name string, x string, y string")
    assert sorted(tuple(r) for r in readers.rebuilt(rows, up).collect()) == [("q", "?", "-", "?"), ("\u0261", "?", "0", "+")]


def test_payloads(spark):
    r = spark.sql("SELECT 'ok' s, 1.5D v, double('NaN') n").select(sinks.payload(F.col("s"), F.col("v")).alias("a"), sinks.payload(F.lit("parse-error"), F.col("v")).alias("b"), sinks.number_payload(F.col("s"), F.col("n")).alias("c"), sinks.number_payload(F.col("s"), F.col("v")).alias("d")).first()
    assert tuple(r) == ('{"ok":true,"value":1.5}', '{"ok":false,"error":"parse-error"}', '{"ok":true,"value":null}', '{"ok":true,"value":1.5}')


def test_short_numbers(spark):
    values = [0.0, -0.0, 1.0, -1.5, 100000.0, 999999.4, 999999.6, 1000000.0, 123456789.0, 0.1, 1 / 3, 2 / 3, 0.0001, 0.00012345678, 0.00001, 1.5e-7, 1e100, -1e-100, 120.0, 1200.5, 0.142857142857, 3.0e5]
    got = [r.x for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(sinks.short_number(F.col("v")).alias("x")).collect()]
    assert got == ["%.6g" % v for v in values]
    assert spark.sql("SELECT double('inf') a, double('NaN') b").select(sinks.short_number(F.col("a")), sinks.short_number(F.col("b"))).first()[:] == (None, None)
