import pytest

from ocellus.sources.locate import backend, jdbc_address, locate, read_table, shown


def test_order_of_places(tmp_path):
    parts = {"PAPER_DB_HOST": "h", "PAPER_DB_NAME": "n", "PAPER_DB_PASSWORD": "p@/s"}
    assert locate("x", {"PAPER_DB_URL": "a"}) == "x"
    assert locate(None, {"PAPER_DB_URL": "a", "DATABASE_URL": "b"}) == "a" and locate(None, {"DATABASE_URL": "b"} | parts) == "b"
    assert locate(None, parts) == "mysql://root:p%40%2Fs@h:3306/n?charset=utf8mb4"
    with pytest.raises(ValueError):
        locate(None, {"PAPER_DB_HOST": "h"})
    with pytest.raises(FileNotFoundError):
        locate(None, {}, str(tmp_path))
    for name in ("b.sqlite", "a.sqlite"):
        (tmp_path / name).touch()
    assert locate(None, {}, str(tmp_path)).endswith("a.sqlite")


def test_addresses():
    assert jdbc_address("mysql+pymysql://u:p%40@h:1/n?charset=x") == ("jdbc:mysql://h:1/n", {"user": "u", "password": "p@"})
    assert jdbc_address("/tmp/a.sqlite") == ("jdbc:sqlite:/tmp/a.sqlite", {}) and jdbc_address("sqlite:////tmp/a.db")[0] == "jdbc:sqlite:/tmp/a.db"
    assert [backend(x) for x in ("/data", "a.sqlite", "postgresql://h/n", "jdbc:mysql://h/n", "file:///x")] == ["parquet", "sqlite", "postgresql", "mysql", "parquet"]
    assert shown("mysql://u:secret@h/n") == "mysql://u:***@h/n"
    with pytest.raises(ValueError):
        jdbc_address("mysql://")


def test_reading(spark, tmp_path):
    spark.range(3).selectExpr("id", "id * 2 b").write.parquet(str(tmp_path / "t.parquet"))
    assert read_table(spark, "t", str(tmp_path), ["b"]).columns == ["b"]
