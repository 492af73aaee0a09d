"""Documents with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

import random

import pytest

DDL = "doc_id long, text string, lang string, source string, n_chars long, bucket string, size string, n string"
_WORDS = {
    "en": "the house of river and stone with night wind over small green field again".split(),
    "de": "der grosse wald und die alte strasse mit dem kleinen haus über grünen wiesen".split(),
    "fr": "le grand château et la rivière avec une petite forêt sous les étoiles".split(),
}


def prose(seed: int, n: int, lang: str = "en") -> str:
    r = random.Random(seed)
    return " ".join(r.choice(_WORDS[lang]) + r.choice(["", "", ",", f"x{r.randrange(400)}"]) for _ in range(n))


def rows() -> list[tuple]:
    out = []
    for i in range(60):
        lang = ("en", "de", "fr")[i % 3]
        out.append((i, prose(i, 40 + i, lang), lang, f"s{i % 4}"))
    base = prose(1000, 200)
    for i in range(60, 70):  # near copies, and exact ones
        words = base.split()
        if i > 64:
            words[i - 50] = f"changed{i}"
        out.append((i, " ".join(words), "en", "s0"))
    out += [
        (70, None, "en", "s1"), (71, "", None, None), (72, " \t\n", "en", "s2"), (73, "word", "en", "s2"), (74, "WORD", "en", "s2"),
        (75, "12345 !!! 678", "en", "s3"), (None, prose(3, 20), "en", "s3"), (None, None, None, None), (76, prose(5, 9000), "en", "s1"),
        (5, prose(5, 45, "fr"), "fr", "s1"), (5, prose(5, 45, "fr"), "fr", "s1"), (77, "Ünïcode ÀÉ 東京 test", "en", "é"),
    ]
    return [(*r, len(r[1] or ""), "b", "z", "q") for r in out]


@pytest.fixture(scope="session")
def doc_rows():
    return rows()


@pytest.fixture(scope="session")
def docs(spark, doc_rows):
    return spark.createDataFrame(doc_rows, DDL).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DDL)
