"""Small tables with the odd rows that every operator must take."""

import os
import tempfile

import duckdb

SF = "/root/testdata/sf0.001"


def write(spark, **tables):
    """A folder with the given DataFrames as <name>.parquet, as the queries read them."""
    folder = tempfile.mkdtemp(prefix="daygrain-llm-", dir="/tmp")
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return folder


def oracle(folder, sql, *tables):
    con = duckdb.connect()
    for t in tables:
        path = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    return cols, sorted(map(repr, cur.fetchall()))


def same_as_oracle(df, folder, sql, *tables):
    cols, rows = oracle(folder, sql, *tables)
    assert sorted(df.columns) == sorted(cols)
    assert sorted(repr(tuple(r)) for r in df.select(cols).collect()) == rows


ODD_TEXTS = [None, "", " ", "\n", "\n\n", "one line", "A shared line of text\nother", "a SHARED line of text\t\nÉcole privée ici\n",
             "école privée ici\nA shared line of text\nA shared line of text", "x" * 30000, "word " * 20000, "a\x00b \x0b\x0c é 漢字 🎉",
             "one line", "▁ marks ▁▁ here", "short\nshort"]


def documents(spark, texts=ODD_TEXTS, partitions=3):
    """The odd texts with columns whose names clash with those that operators add."""
    rows = [(i, t, "en", None, 0 if t is None else len(t), "mine", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, hash int").repartition(partitions)
