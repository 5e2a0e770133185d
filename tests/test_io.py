import os
import tempfile

import pytest

from clusterlens.sources import io as IO


def test_csv_multiline_quotes_and_na_tokens(spark):
    d = tempfile.mkdtemp(prefix="cl-io-")
    path = os.path.join(d, "raw.csv")
    with open(path, "w", encoding="utf-8") as fh:
        fh.write('anime_id,Name,Score\n1,"Multi\nline ""quoted""",7.5\n2,NA,UNKNOWN\n')
    df = IO.read_csv(spark, path)
    rows = df.orderBy("anime_id").collect()
    assert rows[0]["Name"] == 'Multi\nline "quoted"'
    assert rows[1]["Name"] is None and rows[1]["Score"] == "UNKNOWN"
    ing, mapping = IO.ingest(df, required=["anime_id", "Name"])
    assert ing.columns == ["anime_id", "name", "score"] and mapping["name"] == "Name"
    assert ing.orderBy("anime_id").first()["name"] == 'Multi line "quoted"'
    with pytest.raises(ValueError):
        IO.validate_columns(df, ["anime_id", "Missing"])


def test_sinks_skip_existing_and_csv_arrays(spark):
    d = tempfile.mkdtemp(prefix="cl-io-")
    df = spark.createDataFrame([(1, ["a", "b"])], "id int, tags array<string>")
    IO.write_table(df, os.path.join(d, "t.parquet"))
    IO.write_table(spark.createDataFrame([(2, ["c"])], "id int, tags array<string>"), os.path.join(d, "t.parquet"))
    assert [r["id"] for r in spark.read.parquet(os.path.join(d, "t.parquet")).collect()] == [1]  # not overwritten
    IO.write_table(df, os.path.join(d, "t.csv"), overwrite=True)
    back = spark.read.option("header", True).csv(os.path.join(d, "t.csv")).first()
    assert back["tags"] == '["a","b"]'
    with pytest.raises(ValueError):
        IO.write_table(df, os.path.join(d, "t.xlsx"))


def test_stages_are_reused_only_if_whole_and_current(spark, tmp_path):
    src, out = str(tmp_path / "in.parquet"), str(tmp_path / "out.parquet")
    spark.range(20).write.parquet(src)
    made = []

    def stage(params=None, fail=False):
        df = spark.read.parquet(src)
        mark = os.path.getmtime(os.path.join(out, "_SUCCESS")) if os.path.exists(os.path.join(out, "_SUCCESS")) else None
        got = IO.write_stage(df.selectExpr("id * 2 AS x"), out, params)
        made.append(mark != os.path.getmtime(os.path.join(out, "_SUCCESS")))
        return sorted(r[0] for r in got.collect())

    want = [2 * i for i in range(20)]
    assert stage() == want and made[-1]
    assert stage() == want and not made[-1]                       # nothing changed
    assert stage({"k": 3}) == want and made[-1]                   # other parameters
    assert stage({"k": 3}) == want and not made[-1]
    part = next(f for f in os.listdir(out) if f.startswith("part"))
    os.remove(os.path.join(out, part))                            # a file is lost
    assert stage({"k": 3}) == want and made[-1]
    os.remove(os.path.join(out, "_SUCCESS"))                      # a write that did not end
    assert stage({"k": 3}) == want and made[-1]
    spark.range(20, 25).write.mode("append").parquet(src)         # new input
    assert stage({"k": 3}) == [2 * i for i in range(25)] and made[-1]


def test_half_written_tables_are_written_again(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    IO.write_table(spark.range(3), path)
    os.remove(os.path.join(path, "_SUCCESS"))
    IO.write_table(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5


def test_feature_names_stay_with_a_matrix(spark, tmp_path):
    from clusterlens.operators import features as FE
    wide = spark.createDataFrame([(1, 2.0, 3.0)], "id int, `a b` double, c double")
    m = FE.as_matrix(wide, ["id"], ["a b", "c"])
    m.write.parquet(str(tmp_path / "m"))
    back = spark.read.parquet(str(tmp_path / "m"))
    assert FE.feature_names(back) == ["a b", "c"] and back.first()["features"] == [2.0, 3.0]


def test_csv_header_with_quotes(spark, tmp_path):
    path = tmp_path / "h.csv"
    path.write_text('id,"a ""quoted"", name"\n1,x\n')
    for multi in (True, False):
        df = IO.read_csv(spark, str(path), multi_line=multi)
        assert df.columns == ["id", 'a "quoted", name'] and df.first()[1] == "x"
