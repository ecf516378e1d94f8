import sys

import pytest

import __spark_entry__ as entry


def without_llm(monkeypatch, **modules):
    for name in [n for n in sys.modules if n.startswith("tidelog.llm")]:
        monkeypatch.delitem(sys.modules, name)
    for name, module in modules.items():
        monkeypatch.setitem(sys.modules, name.replace("__", "."), module)


@pytest.mark.parametrize("library", ["ahocorasick", "tidelog__llm__leak"])
def test_a_missing_library_surfaces(monkeypatch, library):
    without_llm(monkeypatch, **{library: None})
    with pytest.raises(ImportError):
        entry.queries()


def test_a_broken_import_surfaces(monkeypatch):
    without_llm(monkeypatch, tidelog__llm__abuse=type(sys)("tidelog.llm.abuse"))
    with pytest.raises(ImportError):
        entry.queries()


@pytest.mark.parametrize("missing", ["tidelog__llm", "tidelog__llm__queries"])
def test_the_core_alone_without_the_subpackage(monkeypatch, missing):
    without_llm(monkeypatch, **{missing: None})
    assert entry._modules() == entry._CORE
