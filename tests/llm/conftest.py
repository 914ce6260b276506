"""Small document tables: the given ones with hard rows added, an empty one, and one of nulls."""

from __future__ import annotations

import pandas as pd
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TINY = "/root/testdata/sf0.001"
PASSAGE = " ".join(f"passage{k} of shared words" for k in range(20)) + "."
HARD = [
    (900_001, None, "en", "web", None),
    (900_002, "", "en", "web", 0),
    (900_003, " \n\t \r\n", "en", None, 6),
    (900_004, "one", None, "web", 3),
    (900_005, "long " * 60_000, "en", "web", 300_000),
    (900_006, "a" * 200_000, "en", "web", 200_000),
    (900_007, "the same text\nof two lines", "en", "web", 26),
    (900_007, "the same text\nof two lines", "en", "web", 26),
    (900_008, "the same text\nof two lines", "en", "web", 26),
    (None, "the same text\nof two lines", "en", "web", 26),
    (None, None, None, None, None),
    (900_009, "ünïcödé 漢字 \U0001f600 text with odd blanks\x0band\x0cbreaks", "en", "web", 45),
    (900_010, f"First words here. {PASSAGE} Last words there.", "en", "web", 600),
    (900_011, f"Other words here. {PASSAGE} Nothing more.", "en", "web", 600),
    (900_012, "one two three four five six seven eight nine ten " * 12, "en", "web", 588),
    (900_013, "'; DROP TABLE x; -- \\ \" ${y} {z}", "en", "w/e'b", 32),
]


def documents(rows) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"])


def _saved(spark, folder, frame) -> str:
    plain = lambda x: None if pd.isna(x) else x if isinstance(x, str) else int(x)
    rows = [tuple(map(plain, r)) for r in frame.astype(object).itertuples(index=False)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def given() -> pd.DataFrame:
    return pd.read_parquet(f"{TINY}/documents.parquet")[["doc_id", "text", "lang", "source", "n_chars"]]


@pytest.fixture(scope="session")
def mixed_dir(spark, tmp_path_factory, given) -> str:
    return _saved(spark, tmp_path_factory.mktemp("mixed"), pd.concat([given.astype(object), documents(HARD).astype(object)]))


@pytest.fixture(scope="session")
def empty_dir(spark, tmp_path_factory, given) -> str:
    return _saved(spark, tmp_path_factory.mktemp("empty"), given.head(0))


@pytest.fixture(scope="session")
def null_dir(spark, tmp_path_factory) -> str:
    return _saved(spark, tmp_path_factory.mktemp("null"), documents([(None,) * 5] * 3))


@pytest.fixture(scope="session")
def rows(spark, mixed_dir) -> list:
    """The rows of mixed_dir."""
    return spark.read.parquet(f"{mixed_dir}/documents.parquet").collect()
