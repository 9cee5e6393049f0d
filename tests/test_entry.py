"""The driver contract also holds without the training-data folders."""
import sys

import __spark_entry__ as E


class _Absent:
    """Finds nothing under the given names, as if the folders were deleted."""
    names = ("fraudlens.llm", "corpus_pipeline")

    def find_spec(self, name, path=None, target=None):
        if name in self.names or name.startswith("fraudlens.llm."):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
        return None


def test_entry_without_training_data(monkeypatch):
    for name in [n for n in sys.modules if n.startswith(_Absent.names)]:
        monkeypatch.delitem(sys.modules, name)
    import fraudlens
    monkeypatch.delattr(fraudlens, "llm", raising=False)
    monkeypatch.setattr(sys, "meta_path", [_Absent(), *sys.meta_path])
    names = E.queries()
    assert "d08_scoring_record" in names and len(names) > 130
    assert not any(n.startswith("op") and n[2:3].isdigit() for n in names) and "pipeline" not in names
    assert set(E.oracle_sql()) <= set(names)


def test_entry_runs(spark):
    assert E.entry(spark).count() > 0
