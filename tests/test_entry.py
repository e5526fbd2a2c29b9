"""The entry point with and without the text subpackage."""

from __future__ import annotations

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

BLOCK = """
import importlib.abc, sys
class Gone(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name == {name!r}:
            raise {kind}("gone: " + name, name={reported!r})
sys.meta_path.insert(0, Gone())
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
print(len(entry.queries()), len(entry.oracle_sql()))
"""


def run(name, kind="ModuleNotFoundError", reported=None):
    code = BLOCK.format(name=name, kind=kind, reported=reported or name, root=ROOT)
    return subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)


def test_a_missing_module_leaves_the_other_queries():
    whole = run("nothing_of_this_name")
    assert whole.returncode == 0, whole.stderr
    everything = int(whole.stdout.split()[0])
    for name in ("ahocorasick", "zstandard", "xxhash", "tapeloom.llm", "corpus_pipeline"):
        part = run(name)
        assert part.returncode == 0, part.stderr
        assert 200 < int(part.stdout.split()[0]) <= everything
        if name.startswith("tapeloom") or not os.path.isdir(f"{ROOT}/tapeloom/llm"):
            continue
        assert int(part.stdout.split()[0]) < everything and ("no text queries" in part.stderr) == (name != "corpus_pipeline")


def test_an_error_in_own_code_is_not_hidden():
    if os.path.isdir(f"{ROOT}/tapeloom/llm"):
        broken = run("tapeloom.llm.common", "ImportError")
        assert broken.returncode != 0 and "gone: tapeloom.llm.common" in broken.stderr
