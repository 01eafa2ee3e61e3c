import json

from pyspark.sql import functions as F

from contrasieve.operators import joins
from contrasieve.sources import delimited, tables


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_csv_with_mark_comma_and_padded_header(spark, tmp_path):
    path = tmp_path / "review.csv"
    path.write_text("﻿id; valor ;rotulo_verdade\n1;1.234,50;nao\n2;abc;eng_obra\n", encoding="utf-8")
    df = delimited.read_review_csv(spark, str(path), ["valor"])
    assert df.columns == ["id", "valor", "rotulo_verdade"]
    assert rows(df, "id") == [("1", 1234.5, "nao"), ("2", None, "eng_obra")]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 1.5, "a;b"), (2, 1234567.25, 'q"q')], "id int, v double, t string")
    for i, br in enumerate((True, False)):
        delimited.write_csv(df, str(tmp_path / str(i)), brazilian=br)
        back = delimited.read_review_csv(spark, str(tmp_path / str(i)), ["v"])
        assert rows(back, "id") == [("1", 1.5, "a;b"), ("2", 1234567.25, 'q"q')]


def test_nested_record_defaults(spark, tmp_path):
    recs = [
        {"categoriaProcesso": {"id": 8, "nome": "Serviços"}, "unidadeOrgao": {"ufSigla": "SP"}, "objetoContrato": "obra"},
        {"categoriaProcesso": None, "objetoContrato": None, "valorGlobal": "10.5"},
    ]
    path = tmp_path / "r.json"
    path.write_text("\n".join(json.dumps(r) for r in recs))
    flat = tables.flatten_record(spark.read.schema(tables.contract_ddl("dataPublicacaoPortal")).json(str(path)))
    out = {r["categoriaProcessoId"]: r for r in flat.collect()}
    assert out[8]["ufSigla"] == "SP" and out[8]["municipioNome"] == "" and out[8]["objetoContrato"] == "obra"
    assert out[None]["ufSigla"] == "" and out[None]["objetoContrato"] == "" and out[None]["valorGlobal"] == "10.5"


def test_accumulate_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    once = tables.accumulate(old, new, ["k"])
    assert rows(once, "k") == [(1, "a"), (2, "B"), (3, "C")] == rows(tables.accumulate(once, new, ["k"]), "k")
    assert rows(tables.insert_absent(old, new, ["k"]), "k") == [(1, "a"), (2, "b"), (3, "C")]


def test_upsert_keeps_reviewer_columns(spark):
    old = spark.createDataFrame([(1, 5, "ana"), (2, 6, None)], "k int, mk int, who string")
    new = spark.createDataFrame([(2, 9), (3, 1)], "k int, mk int")
    assert rows(tables.upsert(old, new, ["k"], ["mk"]), "k") == [(1, 5, "ana"), (2, 9, None), (3, 1, None)]


def test_partitions_are_replaced_not_duplicated(spark, tmp_path):
    path = str(tmp_path / "p")
    df = spark.createDataFrame([(1, "SP", "2024-01-05"), (2, "RJ", "2024-02-01"), (3, "SP", None)], "id int, st string, d string")
    df = df.withColumn("d", F.to_timestamp("d"))
    tables.write_partitions(df, path, "d", "st")
    tables.write_partitions(df.filter("id = 1"), path, "d", "st")
    assert rows(spark.read.parquet(path).select("id", "uf"), "id") == [(1, "SP"), (2, "RJ")]


def test_coverage_and_first_present(spark):
    df = spark.createDataFrame([("2024-01",)] * 3 + [("2024-03",)], "m string")
    assert rows(tables.coverage(df, "m", "2024-01-01", "2024-03-01", 2), "month") == [
        ("2024-01", 3, "completo"), ("2024-02", 0, "ausente"), ("2024-03", 1, "parcial"),
    ]
    assert df.select(tables.first_present(df, ["x", "M"])).first()[0].startswith("2024")


def test_signals_do_not_fan_out(spark):
    base = spark.createDataFrame([(1,), (2,)], "k int")
    many = spark.createDataFrame([(1, False), (1, True), (1, None)], "k int, changed boolean")
    out = joins.attach_signals(base, "k", [(many, {"changed": F.max("changed")}), (None, {"p": F.lit(None)})])
    assert rows(out, "k") == [(1, True, None), (2, None, None)]


def test_code_evidence(spark):
    reg = spark.createDataFrame(
        [("strong", "1", []), ("possible", "2", ["1"]), ("secondary", "9", ["1", "2"]), ("none", "9", None)], "s string, p string, o array<string>"
    )
    ref = spark.createDataFrame([("0000001", True), ("0000002", False)], "code string, strong boolean")
    assert rows(joins.code_evidence(reg, "s", "p", "o", ref), "s") == [("none", 0.0), ("possible", 3.0), ("secondary", 1.5), ("strong", 3.0)]


def test_resolve_purchase(spark):
    df = spark.createDataFrame([("12345678000199-1-000001/2024", None), ("12345678000199-2-000002/2024", None), ("k", "own")], "key string, own string")
    det = spark.createDataFrame([("12345678000199-2-000002/2024", "d")], "key string, detail_purchase string")
    out = joins.resolve_purchase(df, "key", "own", det).select("key", "resolved")
    assert [r[1] for r in rows(out, "key")] == ["12345678000199-1-000001/2024", "d", "own"]


def test_cut_lineage_uses_the_shared_folder(spark):
    from contrasieve.session import cut_lineage, shared_folder

    cut = cut_lineage(spark.range(5))
    assert cut.count() == 5 and shared_folder(spark) in cut.inputFiles()[0]
    assert shared_folder(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
