"""Source states of an extracted file after edits, and their place in an answer."""

import pytest

from depscape.engine import Repository
from depscape.operators.freshness import source_states

BEFORE = '''"""Déjà."""


@cached
def price(item,
          rate):
    return item * rate


def total(items):
    return sum(price(i, 2) for i in items)
'''


@pytest.mark.parametrize(
    ("after", "changed"),
    [
        (BEFORE, set()),
        (BEFORE.replace("item * rate", "item + rate"), set()),
        (BEFORE.replace("@cached", "@cachet"), set()),
        (BEFORE.replace("def price", "def prize"), {"price"}),
        ("\n" + BEFORE, {"price", "mod"}),  # the one without a signature is still named on its line
        (BEFORE + "x = 1\n", {"mod"}),
        ("", {"price", "total", "mod"}),
        (None, {"price", "total", "mod"}),
    ],
)
def test_states(spark, after, changed):
    def at(text):
        return len(BEFORE[: BEFORE.index(text)].encode())

    size = len(BEFORE.encode())
    rows = [
        ("mod", "m.py", "mod", "module", 1, 0, size, ""),
        ("price", "m.py", "price", "function", 4, at("@cached"), at("\n\n\ndef total"), "def price(item, rate)"),
        ("total", "m.py", "total", "function", 10, at("def total"), size, None),
    ]
    symbols = spark.createDataFrame(rows, "id string, path string, name string, kind string, start_line int, start_byte int, end_byte int, signature string")
    files = spark.createDataFrame([("m.py", bytearray(after.encode()) if after is not None else None)], "path string, content binary")
    got = {r["id"]: r["state"] for r in source_states(symbols, files).collect()}
    assert {i for i, s in got.items() if s != "fresh"} == changed
    assert (set(got.values()) == {"missing"}) == (after is None)


def test_answers_tell_of_changed_sources(spark, tmp_path):
    tree = tmp_path / "tree"
    tree.mkdir()
    (tree / "m.py").write_text(BEFORE)
    repo = Repository(spark, f"file://{tree}", f"file://{tmp_path}/graph")
    repo.index()
    causes = lambda: repo.blast("m.price")["completeness"]["causes"]["source_changed"]
    assert causes() == 0
    (tree / "m.py").write_text(BEFORE.replace("def price", "def prize"))
    assert causes() == 1
    (tree / "m.py").unlink()
    assert causes() == 2
