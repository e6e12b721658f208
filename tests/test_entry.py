"""The optional part may be absent, or lack a library; the core stays."""

import sys

import pytest

import __spark_entry__ as E


class _Missing:
    def __init__(self, name):
        self.name = name

    def find_spec(self, name, path=None, target=None):
        if name == self.name or name.startswith(self.name + "."):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)


@pytest.fixture
def without(monkeypatch):
    def hide(name):
        for loaded in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("kinrank.llm") or m == name
                       or m.startswith(name + ".")]:
            monkeypatch.delitem(sys.modules, loaded)
        monkeypatch.setattr(sys, "meta_path", [_Missing(name), *sys.meta_path])

    return hide


@pytest.mark.parametrize("name", ["corpus_pipeline", "kinrank.llm"])
def test_the_optional_part_may_be_absent(without, name):
    without(name)
    names = E.queries()
    assert "top_neighbors" in names and not any(n.startswith("op1") or n == "pipeline" for n in names)
    assert set(E.oracle_sql()) <= set(names)


def test_a_missing_library_of_the_optional_part_warns(without):
    without("zstandard_or_other")  # nothing needs it: all stays
    pytest.importorskip("corpus_pipeline")
    without("public_tokenizers")
    with pytest.warns(UserWarning, match="public_tokenizers"):
        names = E.queries()
    assert "top_neighbors" in names and "pipeline" not in names
