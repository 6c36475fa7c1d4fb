"""The package, its entry and its queries without the training-data subpackage."""

import os
import re
import shutil
import subprocess
import sys

from .conftest import ROOT


def test_entry_without_the_llm_folders(tmp_path):
    for name in ("bitextmill", "tests", "__spark_entry__.py", "corpus_pipeline.py"):
        source = os.path.join(ROOT, name)
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
        elif os.path.exists(source):  # the pipeline goes with the subpackage
            shutil.copy(source, tmp_path / name)
    for folder in ("bitextmill/llm", "tests/llm"):
        shutil.rmtree(tmp_path / folder, ignore_errors=True)
    (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); assert not any(n.startswith('op') or n == 'pipeline' for n in q); assert 'leverage_report' in q and 'xliff_new' in q"
    path = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and os.path.realpath(p) != os.path.realpath(ROOT)]  # not this repository
    env = os.environ | {"PYTHONPATH": os.pathsep.join(path)}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120, env=env)
    assert out.returncode == 0, out.stderr[-800:]
    out = subprocess.run([sys.executable, "-m", "pytest", "tests", "--collect-only", "-q"], cwd=tmp_path, capture_output=True, text=True, timeout=180, env=env)
    assert out.returncode == 0, out.stdout[-800:]


def test_nothing_else_imports_the_subpackage():
    for folder, _, names in os.walk(os.path.join(ROOT, "bitextmill")):
        if os.path.basename(folder) == "llm":
            continue
        for name in names:
            if name.endswith(".py"):
                with open(os.path.join(folder, name), encoding="utf-8") as f:
                    assert not re.search(r"^\s*(?:from|import)\b.*\bllm\b", f.read(), re.M), os.path.join(folder, name)
