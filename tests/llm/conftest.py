import random

import pytest

#: Columns whose names the operators use for themselves.
CLASH = "block long, class string, n long, score double, pack binary, toxic_score double, kept_text string, gid long, rank int"


@pytest.fixture(scope="session")
def docs_of(spark):
    """documents with their usual columns and others of clashing names, from (doc_id, text) or (doc_id, text, lang)."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src", None if r[1] is None else len(r[1]), 1, "c", 2, 0.5, b"p", 0.1, "k", 3, 4) for r in rows]
        return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}")

    return make


@pytest.fixture(scope="session")
def odd():
    """Nulls, empty, short, long and repeated texts, and repeated rows."""
    rng = random.Random(11)
    words = ["the", "of", "and", "alpha", "beta", "gamma", "Δelta", "über", "x1", "naïve", "it's", "日本", "end."]
    text = lambda n: " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(n))
    base = [text(rng.randrange(1, 80)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100, None), (101, ""), (102, " \n\t "), (103, "one"), (104, "one two"), (105, base[3]), (106, base[3]), (None, base[4]), (None, None), (107, text(30_000)), (108, "a" * 5000), (109, "tab\tand nbsp em \x1c sep")]
    long = base[5] + " " + text(60)
    rows += [(110, long), (111, long.upper()), (112, long.replace("alpha", "omega", 1)), (113, text(20) + long), (114, long)]
    return [*rows, rows[0], rows[50 - 1]]
