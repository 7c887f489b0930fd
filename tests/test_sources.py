from datetime import datetime

from ferrowatch import schemas
from ferrowatch.sources import staging, tables


def test_csv_binds_by_position_and_reads_empty_text_as_null(spark, make, tmp_path, rows_of):
    path = str(tmp_path / "logs")
    tables.write_table(make([(1, "", 2.5), (2, "x", None)], "a int, b string, c double"), path)
    tables.write_table(make([(1, "", 2.5), (2, "x", None)], "a int, b string, c double"), path)
    typed = tables.read_table(spark, path, schema="p int, q string, r double")
    assert rows_of(typed, "p", "q", "r") == [(1, None, 2.5), (2, "x", None)]
    assert tables.read_table(spark, path).schema["a"].dataType.typeName() == "integer"
    text = tables.read_table(spark, path, infer=False)
    assert {f.dataType.typeName() for f in text.schema} == {"string"}
    cast = tables.cast_columns(text, {"a": "int", "b": "double"})
    assert rows_of(cast, "a", "b") == [(1, None), (2, None)]


def test_other_formats_and_partitions(spark, make, tmp_path, rows_of):
    df = make([(1, "x"), (2, "y")], "a int, b string")
    for fmt in ("parquet", "json", "orc"):
        path = str(tmp_path / fmt)
        tables.write_table(df, path, fmt, partition_by=["b"])
        assert rows_of(tables.read_table(spark, path, fmt), "a", "b") == [(1, "x"), (2, "y")]


def test_stage_uses_the_shared_folder(spark, make, rows_of):
    df = make([(1, datetime(2024, 1, 1))], "a int, t timestamp")
    staged = staging.stage(df, "thing")
    assert staged.inputFiles()[0].removeprefix("file://").startswith(spark.conf.get(staging.CHECKPOINT_DIR))
    assert rows_of(staged) == rows_of(df)


def test_stage_schemas_have_the_expected_widths():
    widths = [len(s) for s in (schemas.INTEGRATED, schemas.FEATURED, schemas.ALERTED, schemas.SCORED, schemas.ITEMISED)]
    assert widths == [40, 54, 63, 74, 75]
    assert [len(f) for f in (schemas.ALERT_FEATURES, schemas.NEED_FEATURES, schemas.ITEM_FEATURES)] == [28, 19, 20]


def test_csv_is_written_compressed(make, tmp_path):
    path = tmp_path / "t"
    tables.write_table(make([(1, "a")], "k int, t string"), str(path))
    assert {file.name[-7:] for file in path.glob("part-*")} == {".csv.gz"}
