import sys
from pathlib import Path

import pyarrow.parquet as pq
import pytest

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parents[1])]

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def rows():
    """Rows of a given table as dicts."""
    return lambda name: pq.read_table(f"{DATA}/{name}.parquet").to_pylist()


@pytest.fixture(scope="session")
def query(spark):
    """Result of a registered query over the small tables, as dicts."""
    from evspark.llm.queries import QUERIES

    return lambda name: [r.asDict(recursive=True) for r in QUERIES[name](spark, DATA).collect()]


DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, component_id string, id int, node int, key string, tags map<string,string>"
LONG = "Long lines stand here, over and over again. " * 4000
BASE = " ".join(f"word{i}" for i in range(60))
CASES = [
    (None, None, None, None),
    (None, BASE, "en", "b"),
    (None, BASE, "en", "b"),
    (1, None, "en", "a"),
    (2, "", "en", "a"),
    (3, " \n\t", None, None),
    (4, BASE, "en", "a"),
    (5, BASE.upper() + " ", "fr", "a"),
    (6, BASE.replace("word59", "other"), "fr", "b"),
    (7, "only four words here", "en", "b"),
    (8, "Only\tfour  words here", "en", "c"),
    (8, "Only\tfour  words here", "en", "c"),
    (8, "another text under the same id, which is a little longer", "en", "c"),
    (9, LONG, "en", "c"),
    (10, "x" * 200_000, "en", "d"),
    (11, "Shared line over ten\nshort\n  SHARED LINE OVER TEN\nown line of eleven", "en", "d"),
    (12, "shared line over ten \nshort\nother line of twelve\n", "de", "d"),
    (13, "É unit ünïcode — <|endoftext|> it's\u00a0fine\r\n 中文 🙂", "de", None),
    (14, "É unit ünïcode — <|endoftext|> it's\u00a0fine\r\n 中文 🙂", "de", None),
]


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names operators use too."""
    return spark.createDataFrame([(*r[:4], 1, "s", "c", 2, 3, "k", {"a": "b"}) for r in CASES], DOCS)


@pytest.fixture(scope="session")
def doc_rows():
    return [dict(zip(("doc_id", "text", "lang", "source"), r, strict=True)) for r in CASES]


@pytest.fixture(scope="session")
def same():
    """Compare rows in any order, by the columns of the wanted ones."""

    def check(got, want):
        got = [r if isinstance(r, dict) else r.asDict(recursive=True) for r in got]
        columns = list(want[0]) if want else []
        left, right = (sorted((tuple(r[c] for c in columns) for r in some), key=repr) for some in (got, want))
        assert left == right

    return check
