import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string"


def _words(r, n, syllables):
    return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Nulls everywhere, empty and very long texts, repeated rows, copies, odd characters, clashing columns."""
    r = random.Random(5)
    en, fr = ["the", "on", "re", "th", "ing", "er"], ["que", "le", "é", "ou", "eau", "ç"]
    out = []
    for i in range(60):
        lang = "en" if i % 2 else "fr"
        body = _words(r, r.randint(1, 120), en if i % 2 else fr)
        out.append((i, body + ".\n" + body[: r.randint(0, 30)], lang, "s", len(body), 0.5, "x"))
    base = _words(r, 100, en)
    cut = base.split()
    out += [(100, base, "en", "s", 1, None, None), (101, base, "en", None, 1, None, None), (102, " ".join([*cut[:95], "zz", *cut[96:]]), "en", None, None, None, None), (103, " ".join([*cut[:50], *_words(r, 50, fr).split()]), "en", None, None, None, None)]
    out += [(104, None, None, None, None, None, None), (105, "", None, None, None, None, None), (106, " \n\t ", "en", None, None, None, None), (107, "a", None, None, None, None, None), (108, "12 34 !!", "en", None, None, None, None), (109, "one two three four", "en", None, None, None, None), (110, "One two\tthree  four", "en", None, None, None, None)]
    out += [(111, _words(r, 9000, en), "en", "s", 1, None, None), (112, "x" * 50_000, None, None, None, None, None), (None, "lonely text without an id", "en", None, None, None, None), (113, "é́ naïve 　wide\x1cspace ﻿ <|endoftext|> don't Σας ²", "fr", None, None, None, None)]
    out += [out[3], out[3]]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 2), 0) for i in range(60)] + [(3, 0, 0), (None, 1, 1), (50, None, None)], "doc_id long, quality int, toxic int")
