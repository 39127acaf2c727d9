import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('checkpoint')}").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


#: Texts that every operator on documents must take: null, empty, blanks, long, ties, repeated lines, other alphabets.
ODD = [None, "", " ", "\n\n", "a" * 5000, "same text here for all of us", "same text here for all of us", "Ünïcödé ñandú 漢字 😀 text", "x y z\r\n" * 300, "\x00 odd \x01 bytes", "one", "A B C D E F G"]


@pytest.fixture()
def odd(spark):
    """Documents with odd texts, a null id, a repeated row and extra columns with the names of results and working columns."""
    names = ["kept", "__text", "spans", "row", "id", "key", "body", "line", "batch", "root", "n", "m", "page", "kind", "lower", "score", "items", "fp", "bin_id", "bands", "component_id"]
    more = ["extra"] * len(names)
    rows = [(i, t, "en", "src0", 1, 2, *more) for i, t in enumerate(ODD)] + [(None, "no id at all", None, None, None, None, *([None] * len(names))), (5, ODD[5], "en", "src0", 1, 2, *more)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_lines int, n_dropped int, " + ", ".join(f"{n} string" for n in names))


@pytest.fixture()
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
