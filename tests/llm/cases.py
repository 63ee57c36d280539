"""Small inputs with the odd cases that every operator must bear, and a DuckDB to compare with."""

import duckdb
import pandas as pd

DATA = "/root/testdata"
PASSAGE = " ".join(f"passage{k} word{k * 7 % 13}" for k in range(60))
LONG = " ".join(f"w{k * k % 977}" for k in range(60_000))  # 300 KB
PERIODIC = "Haen " * 400
DOCUMENTS = [
    (1, "the quick brown fox jumps over the lazy dog"),
    (2, "The QUICK brown fox jumps over the lazy dog"),
    (3, None),
    (4, ""),
    (5, "   \n\t "),
    (6, "two words"),
    (7, "Two words"),
    (8, "intro here " + PASSAGE + " and an end"),
    (9, "another start é " + PASSAGE + " ßand a different end"),
    (10, LONG),
    (11, LONG + " tail"),
    (12, PERIODIC),
    (13, PERIODIC + "x"),
    (14, "MIT license, mit LICENSE; Licensed under CC BY-NC 4.0. cc by"),
    (15, "x" * 5000),
    (16, "日本語のテキスト " * 40),
    (17, "Licensed under the Apache License, Version 2.0. GNU General Public License gnu general public"),
    (-5, "negative id with a text of its own, don't split it's 're"),
    (18, PASSAGE),
    (18, PASSAGE),  # a repeated row
    (None, "no id " + PASSAGE),
    (None, None),
    (20, "á combining  double  spaces\r\n\r\n\ttabs nbsp \x1c fs   ls end "),
]


def documents(spark, rows=DOCUMENTS):
    """Rows with extra columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "xx", None, None if t is None else len(t), -1, "clash") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, a int, component_id string")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def sample(spark, sf="sf0.001", n=None):
    return spark.read.parquet(f"{DATA}/{sf}/documents.parquet")


def oracle(sql, **tables):
    """``sql`` over pandas tables, rows sorted by all columns, columns by name."""
    with duckdb.connect() as db:
        for name, table in tables.items():
            db.register(name, table)
        return ordered(db.sql(sql).df())


def ordered(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].astype(object).where(lambda x: x.notna(), None)
    return frame.sort_values(list(frame.columns), key=lambda c: c.map(str), ignore_index=True)


def same(got: pd.DataFrame, want: pd.DataFrame) -> None:
    got, want = ordered(got), ordered(want)
    assert list(got.columns) == list(want.columns)
    a, b = [tuple(r) for r in got.to_numpy()], [tuple(r) for r in want.to_numpy()]
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x == y
