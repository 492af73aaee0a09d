"""Shell commands as search plans."""

import pytest

from depscape.operators.search import SearchSpec, alternatives, identifiers
from depscape.plans import shell
from depscape.plans.answer import greedy_fill, pack_lines


def stages(cmd):
    s = shell.split(cmd)
    return None if s is None else [(x.join, x.stages, x.discard) for x in s]


def test_split():
    assert stages("grep a b | head -5 && ls; pwd") == [(None, ["grep a b", "head -5"], False), ("&&", ["ls"], False), (";", ["pwd"], False)]
    assert stages("grep 'a|b;c' x 2>/dev/null") == [(None, ["grep 'a|b;c' x"], False)]
    assert stages("grep x f >/dev/null || echo no") == [(None, ["grep x f"], True), ("||", ["echo no"], False)]
    assert shell.split("X=$(grep a b | head -1); echo $X")[0].assign == "X"


@pytest.mark.parametrize("cmd", ["a `b`", "(a)", "a < b", "a &", "a > out", "a | ", "&& a", "echo 'x", "a && "])
def test_split_refuses(cmd):
    assert shell.split(cmd) is None


def test_search_spec():
    s = shell.search_spec("grep -rn --include=*.py -w foo src/".split())
    assert s.patterns == ["foo"] and s.word and s.globs == ["*.py"] and s.paths == ["src"]
    assert shell.search_spec(["grep", r"a\|b(", "f.py"]).patterns == [r"a|b\("]
    assert shell.search_spec(["grep", "x"]) is None and shell.search_spec(["grep", "-P", "x", "f"]) is None
    rg = shell.search_spec("rg -t py -C 2 x".split())
    assert rg.globs == ["*.py", "*.pyi"] and (rg.before, rg.after) == (2, 2)


def test_stages():
    assert shell.stage("head -20").lines == 20 and shell.stage("head -c 100").bytes == 100
    assert shell.stage("grep -v test").kind == "drop_tests" and shell.stage("grep -vi foo").invert
    assert shell.stage("wc -l").kind == "transform" and shell.stage("cat").kind == "noop" and shell.stage("tee x").kind == "real"


def test_variables():
    assert shell.expand("grep $A \"$A\" '$A'", {"A": "x y"}) == "grep x y \"x y\" '$A'"
    assert shell.references("$A ${B} '$C'", {"A": "", "B": "", "C": ""}) == ["A", "B"]
    assert shell.quote("a b") == "'a b'" and shell.quote("a/b.py") == "a/b.py"


def test_read_only():
    assert shell.read_only("git log | head -3") and shell.read_only("sed -n '1,5p' f")
    assert not shell.read_only("sed -i s/a/b/ f") and not shell.read_only("rm x") and not shell.read_only("find . -delete")


def test_identifiers():
    assert identifiers(SearchSpec([r"\bfoo\b|a\.bar"])) == [("foo", "foo"), ("bar", "a.bar")]
    assert identifiers(SearchSpec(["foo("])) is None and alternatives("(a|b)") is None
    assert SearchSpec(["Foo"], smart_case=True, unicode=False).regex() == "(?:Foo)"


def test_packing():
    lines, lost = pack_lines([f"a.py:{i}: hit" for i in range(10)], ["a.py"] * 10, 70)
    assert lines[-1].startswith("a.py: ") and lost == 0 and sum(len(x) + 1 for x in lines) <= 70
    assert greedy_fill([("a", 5), ("b", 9), ("c", 3)], 8) == ["a", "c"]
