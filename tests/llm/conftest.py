from __future__ import annotations

import random

import pytest

ODD_SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, digest string, "
    "shard string, bin string, label string, key string, row string, id string, h string"
)
FILLER = ("x",) * 8


def odd_texts() -> list[str | None]:
    """Null, empty, blank, odd, repeated and very long texts."""
    rng = random.Random(4)
    prose = " ".join(rng.choice(["the", "and", "of", "Haus", "été", "niño"]) for _ in range(300))
    return [
        None, None, "", "", " \t\n", "one", "one", "two words", prose, prose, prose + " end",
        "x" * 5000, "\n".join([prose] * 2), "été ñ 中文 😂 " * 60, "a b\x1cc\x85d\xa0e", "0" * 5000,
        " ".join(f"w{i}" for i in range(60000)),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    """Texts above under ids with gaps, one repeated row and two null ids; clashing columns."""
    rows = [(3 * i + 1, t, "en" if i % 2 else None, None, None, *FILLER) for i, t in enumerate(odd_texts())]
    rows += [rows[8], (None, "no id", "en", "s", 5, *FILLER), (None, None, None, None, None, *FILLER)]
    return spark.createDataFrame(rows, ODD_SCHEMA)


@pytest.fixture(scope="session")
def no_rows(spark):
    return spark.createDataFrame([], ODD_SCHEMA)


def collected(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]
