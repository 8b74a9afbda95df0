import random

import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def edge_texts():
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 7))) for _ in range(400)]
    say = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    shared = say(60)
    base = say(120)
    texts = [None, "", "  \n\t ", "one", "one two", base, base, base.replace("a", "b", 3), base + " tail",
             say(40) + " " + shared + " " + say(30), shared + ". " + say(50), say(30) + "\n" + shared,
             ("same line here\n" * 80), "x" * 5000, "la " * 3000, say(9000), "naïve ÉCLAIR 漢字 🙂 " * 30,
             "a\r\nb\x0bc\x0cd\te", "<|endoftext|> a <|endoftext|>", "# $ % & | < > * " * 20, say(70).upper()]
    return texts + [say(rnd.randint(50, 300)) for _ in range(25)]


def edge_rows():
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 4}", None) for i, t in enumerate(edge_texts())]
    rows += [(None, "no id at all", None, None, None), (None, None, None, None, None)]
    return rows + [rows[5], rows[9], rows[9]]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and long texts, copies and repeated rows,
    and extra columns whose names clash with outputs and inner names."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame(edge_rows(), SCHEMA)
    for c in ("size", "target", "fp", "key", "kept", "score", "start", "a", "task", "copies", "u", "rate"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf_docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def oracle():
    """Run SQL over given Spark rows (as ``documents``) in DuckDB."""
    import duckdb
    import pyarrow as pa

    def run(sql, df, name="documents"):
        con = duckdb.connect()
        con.register(name, df.toArrow() if hasattr(df, "toArrow") else pa.Table.from_pandas(df.toPandas()))
        cur = con.execute(sql)
        cols = [c[0] for c in cur.description]
        return [dict(zip(cols, r)) for r in cur.fetchall()]
    return run


@pytest.fixture(scope="session")
def same():
    def check(df, expected):
        cols = sorted(expected[0]) if expected else []
        key = lambda r: tuple(map(repr, r))
        got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key)
        assert got == sorted((tuple(r[c] for c in cols) for r in expected), key=key)
    return check
