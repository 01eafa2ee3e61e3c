"""Known answers for rules that a SQL twin of the same reading could not catch."""

from pyspark.sql import functions as F

from contrasieve.operators import graph, rules
from contrasieve.sources import delimited, tables


def test_stored_outcomes_follow_the_order_of_the_rules(spark):
    rows = [
        ("subenquadramento_real", 3, "nao", "subenquadramento_real"),
        ("subenquadramento_real", 0, "parcial", "rito_parcial"),
        ("subenquadramento_real", 2, "?", "rotulacao_incorreta_processo_ok"),
        ("subenquadramento_real", 1, None, "rito_parcial"),
        ("indeterminado_llm_falhou", 0, " SIM ", "rotulacao_incorreta_processo_ok"),
        ("indeterminado_llm_falhou", None, "Não", "rito_parcial"),
        ("indeterminado_pdf_ilegivel", 5, "sim", "indeterminado_pdf_ilegivel"),
        ("rotulacao_incorreta_processo_ok", 0, "parcial", "rotulacao_incorreta_processo_ok"),
    ]
    df = spark.createDataFrame(rows, "current string, mk int, verdict string, want string")
    got = df.select(rules.reapply_verdict(F.col("current"), F.col("mk"), F.col("verdict")).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in got)


def test_csv_keeps_signs_digits_and_the_dialect_of_the_file(spark, tmp_path):
    values = [-5.5, 0.123456789, 1234567.25, None]
    df = spark.createDataFrame([(v,) for v in values], "v double").coalesce(1)
    for brazilian in (True, False):
        delimited.write_csv(df.withColumn("w", F.lit("x")), str(tmp_path / str(brazilian)), brazilian=brazilian)
        back = delimited.read_review_csv(spark, str(tmp_path / str(brazilian)), ["v"])
        assert {r["v"] for r in back.collect()} == set(values)
    path = tmp_path / "mixed.csv"
    path.write_text("a;v\n1;1.234,50\n2;1.234\n3;abc\n")
    assert [r["v"] for r in delimited.read_review_csv(spark, str(path), ["v"]).collect()] == [1234.5, 1234.0, None]


def test_fingerprint_tells_nulls_apart(spark):
    marks = {
        tables.fingerprint(spark.createDataFrame([row], "a string, b string, c string"), [F.col("a"), F.col("b"), F.col("c")]).first()["fingerprint"]
        for row in (("k", None, "x"), ("k", "x", None), ("k", "", "x"), ("kx", None, None))
    }
    assert len(marks) == 4


def test_betweenness_follows_long_paths(spark):
    edges = spark.createDataFrame([(f"v{i:02}", f"v{i + 1:02}", 1.0) for i in range(45)], "src string, dst string, weight double")
    got = {r["vertex"]: r["betweenness"] for r in graph.betweenness(edges, sources=46).collect()}
    assert got["v22"] == got["v23"] == 506

