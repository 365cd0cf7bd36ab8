from __future__ import annotations

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))


def prose(g: random.Random, n: int, size: int = 300) -> str:
    return " ".join(f"w{g.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows() -> list[tuple]:
    """(doc_id, text): nulls, blanks, copies, repeats, rows that repeat whole, odd signs and a long text."""
    g = random.Random(11)
    shared, base = prose(g, 60), prose(g, 120)
    words = base.split()
    near = " ".join([*words[:50], "changed", *words[51:]])
    out = [
        (1, base), (2, base), (3, near), (4, shared), (5, f"{prose(g, 30)}\n{shared}\t{prose(g, 20)}"), (6, None), (7, ""), (8, "  \n\t "), (9, "One  two\nthree"),
        (10, "a " * 80), (11, f"line one\nline two\nline three\n{prose(g, 9)}"), (12, f"{prose(g, 5)}\nline one\nline two\nline three"), (13, "12 34 !!"), (14, f"é日本 ñ {shared.upper()}"),
        (15, prose(g, 60000, 40000)), (16, f"{shared} {shared}"), (None, "no id here at all, but text"), (17, prose(g, 200)), (17, prose(g, 200)), (18, base), (18, base),
    ]
    return out


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """These rows with columns whose names the operators use themselves."""
    extra = "chunk bucket key size node label text_kept rejected slot shard row spans items record h1 r th d pos".split()
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in extra)
    return spark.createDataFrame([(i, t, "en" if i != 3 else None, "s", len(t or ""), *["x"] * len(extra)) for i, t in odd_rows], schema).repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
