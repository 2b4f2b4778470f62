import pytest

TURKISH = "yağmur kitap deniz güneş sokak pencere bahçe mektup orman çarşı defter katip balıkçı öğretmen gemi köprü masa kapı göl harita".split()
ENGLISH = "which their window harbour letter silent morning copied the ledger shelf with those bridges between winter clerks wrote about stone".split()


@pytest.fixture(scope="session")
def turkish():
    return TURKISH


@pytest.fixture(scope="session")
def english():
    return ENGLISH


@pytest.fixture
def tables(spark, tmp_path):
    """Writes tables below a folder and returns it; every query reads its tables from there."""

    def put(**frames):
        for name, df in frames.items():
            df.write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return put


@pytest.fixture(scope="session")
def duck(small):
    from pathlib import Path

    import duckdb

    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for p in Path(small).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c
