"""Facts of single files: ids, scopes, imports, references, recovery from syntax errors."""

from depscape.model import blake3, symbol_id
from depscape.sources.python_facts import extract, is_test_path, module_path

SOURCE = b'''import os
import pkg.util as u
from ..core import Base as B, helper
from .star import *

__all__ = ["Shop", "run"]


def run(x: int) -> "Shop":  # entry
    s = Shop(x)
    s.open()
    u.log("a")
    return helper(os.getcwd())


class Shop(B, metaclass=Meta):
    @property
    def name(self):
        return self.load()

    def load(self):
        def inner():
            return self.missing()

        return inner()

    def _hidden(self):
        super()._hidden()
        make()()


@app.route("/x")
def view():
    return print(Shop.load)
'''


def facts(path="a/b/mod.py", source=SOURCE):
    f = extract(path, source)
    q = {s["id"]: s["qualified"] for s in f["symbols"]}
    edges = {
        (e["kind"], q[e["src"]], q.get(e["dst_id"]) or (e["name"], e["qualifier"], e["import_path"]), e["site_line"], e["prov"]) for e in f["edges"]
    }
    return f, edges


def test_ids():
    assert blake3(b"").hex().startswith("af1349b9f5f9a1a6a0404dea36dcc949")
    assert symbol_id("python", "app/core.py", "app.core.parse", "function") == "07062f12fd1bba433b9365f6b44277f1"
    assert blake3(b"x" * 1025) != blake3(b"x" * 1024)


def test_symbols():
    f, _ = facts()
    by = {s["qualified"]: s for s in f["symbols"]}
    assert f["parse_ok"] and list(by)[0] == "a.b.mod"
    assert by["a.b.mod.run"]["signature"] == 'def run(x: int) -> "Shop"' and by["a.b.mod.run"]["exported"]
    assert by["a.b.mod.Shop.load.inner"]["kind"] == "function" and by["a.b.mod.Shop.load"]["kind"] == "method"
    assert not by["a.b.mod.Shop._hidden"]["exported"] and not by["a.b.mod.view"]["exported"]
    name = by["a.b.mod.Shop.name"]
    assert SOURCE[name["start_byte"] :].startswith(b"@property") and name["start_line"] == 17


def test_edges():
    _, edges = facts()
    m = "a.b.mod"
    assert ("imports", m, ("<module>", None, "<external>:os"), 1, "extracted") in edges
    assert ("imports", m, ("Base", None, "a.core.Base"), 3, "extracted") in edges
    assert ("imports", m, ("*", None, "a.b.star"), 4, "extracted") in edges
    assert ("calls", f"{m}.run", f"{m}.Shop", 10, "extracted") in edges
    assert ("calls", f"{m}.run", ("open", "s", None), 11, "extracted") in edges
    assert ("calls", f"{m}.run", ("log", "u", "pkg.util.log"), 12, "extracted") in edges
    assert ("calls", f"{m}.run", ("getcwd", "os", "<external>:os.getcwd"), 13, "extracted") in edges
    assert ("inherits", f"{m}.Shop", ("Base", None, "a.core.Base"), 16, "extracted") in edges
    assert ("calls", f"{m}.Shop.name", f"{m}.Shop.load", 19, "resolved") in edges
    assert ("calls", f"{m}.Shop.load.inner", ("missing", "self", None), 23, "extracted") in edges
    assert ("calls", f"{m}.Shop._hidden", ("_hidden", "super()", None), 28, "extracted") in edges
    assert ("calls", f"{m}.Shop._hidden", ("<dynamic>", "make()", None), 29, "extracted") in edges
    assert ("references", f"{m}.view", ("route", "app", None), 32, "extracted") in edges
    assert not any(e[0] == "calls" and e[2] == ("route", "app", None) for e in edges)


def test_broken_file_keeps_its_definitions():
    f, edges = facts("p/x.py", b"def ok():\n    return 1\n\n\ndef bad(:\n    pass\n\n\ndef after():\n    return ok()\n")
    assert not f["parse_ok"]
    assert [(s["name"], s["signature"]) for s in f["symbols"][1:]] == [("ok", "def ok()"), ("bad", "def bad("), ("after", "def after()")]
    assert ("calls", "p.x.after", "p.x.ok", 10, "extracted") in edges


def test_hopeless_and_empty_files():
    assert len(extract("e.py", b"")["symbols"]) == 1 and extract("e.py", b"")["parse_ok"]
    assert not extract("e.py", b"\x00\xff(((")["parse_ok"]


def test_paths():
    assert module_path("pkg/__init__.py") == ("pkg", ["pkg"]) and module_path("./a/b.pyi") == ("a.b", ["a"])
    assert is_test_path("tests/x.py") and is_test_path("a/test_b.py") and is_test_path("conftest.py") and not is_test_path("a/contest.py")
