import pytest

from cohortlens.sources import read_csv, write_csv


def test_types_are_inferred(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Patient_ID,age,name,flag\n1,20.5,"a, b",true\n2,,"say ""x""\nnext",false\n')
    df = read_csv(spark, str(tmp_path / "a.csv"))
    assert dict(df.dtypes) == {"Patient_ID": "int", "age": "double", "name": "string", "flag": "boolean"}
    assert [tuple(r) for r in df.collect()] == [(1, 20.5, "a, b", True), (2, None, 'say "x"\nnext', False)]


def test_malformed_rows(spark, tmp_path):
    (tmp_path / "b.csv").write_text("id,v\n1,2.0\n2,oops\n3,4.0\n")
    path, schema = str(tmp_path / "b.csv"), "id int, v double"
    with pytest.raises(Exception):
        read_csv(spark, path, schema).collect()
    assert [r.v for r in read_csv(spark, path, schema, malformed="null").orderBy("id").collect()] == [2.0, None, 4.0]
    assert [r.id for r in read_csv(spark, path, schema, malformed="drop").orderBy("id").collect()] == [1, 3]
    with pytest.raises(ValueError):
        read_csv(spark, path, schema, malformed="ignore")


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'q"uote', 0.1), (2, None, -5.0), (3, "line\nend; x", None)], "id bigint, s string, v double")
    write_csv(df, str(tmp_path / "out"), separator=";")
    back = read_csv(spark, str(tmp_path / "out"), df.schema, separator=";")
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)
