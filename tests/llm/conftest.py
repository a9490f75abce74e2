import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, n string, key int, id string, matches int, `Target` double"
WORDS = {"en": "the of and ing thon erst wheth ould ight".split(), "de": "der und sch keit ung ein ver lich heit".split()}


def sentence(rng, lang="en", n=40):
    return " ".join("".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def documents(spark):
    """Small documents with copies, near copies, nulls, empties, a very long text, repeated rows and clashing columns."""
    rng = random.Random(7)
    rows = []
    for i in range(120):
        lang = "de" if i % 3 == 0 else "en"
        text = sentence(rng, lang, rng.randint(5, 80))
        rows.append((i, text, lang, f"s{i % 4}" if i % 9 else None, len(text)))
    long = sentence(rng, "en", 60_000)
    base = sentence(rng, "en", 120).split()
    near = [*base[:60], "changed", *base[61:]]
    rows += [(200, long, "en", "s1", len(long)), (201, None, None, None, None), (202, "", "en", "s1", 0), (203, " \t\n", None, "s2", 3), (204, "one", "en", "s2", 3), (205, "one", "en", "s3", 3)]
    rows += [(206, " ".join(base), "en", "s1", 500), (207, " ".join(near), "en", "s1", 500), (208, " ".join(base), "en", "s0", 500), (209, "12 34 !!", "en", "s0", 8), (210, "x" * 700_000, "en", "s0", 700_000)]
    rows += [rows[5], rows[5], (None, "a row without an id", "en", "s1", 19), (211, "Émile ÉCOLE, été", "de", "s3", 16)]
    extra = ("x", "y", 1, "z", 2, 0.5)
    return spark.createDataFrame([(*r, *extra) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
