"""The driver contract where the optional part, or a package that it needs, is missing."""

import subprocess
import sys

ROOT = __file__.rsplit("/", 2)[0]


def listed(hidden: str) -> tuple[int, int, str]:
    """(queries, corpus queries, warnings) of the entry with a module hidden."""
    code = f"""
import importlib.abc, sys, warnings
class Hidden(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name == {hidden!r}:
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Hidden())
sys.path.insert(0, {ROOT!r})
with warnings.catch_warnings(record=True) as told:
    warnings.simplefilter("always")
    import __spark_entry__ as E
names = E.queries()
assert set(E.oracle_sql()) <= set(names)
print(len(names), sum(n.startswith("op") or n == "pipeline" for n in names), [str(w.message) for w in told])
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True)
    n, corpus, told = done.stdout.strip().split("\n")[-1].split(" ", 2)
    return int(n), int(corpus), told


def test_entry_survives_what_is_missing():
    for hidden in ("corpus_pipeline", "redline.llm", "ahocorasick", "zstandard", "xxhash"):
        n, corpus, told = listed(hidden)
        assert n > 90 and corpus == 0 and "without the corpus operators" in told, hidden
