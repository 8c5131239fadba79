"""The entry module with and without the optional text operators."""
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
ASK = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and len(q) > 150; print(sum(k == 'pipeline' or k[:2] == 'op' and k[2].isdigit() for k in q))"


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_text_operators(tmp_path, pipeline):
    shutil.copytree(ROOT / "hiemal", tmp_path / "hiemal", ignore=lambda folder, names: [n for n in names if n in ("llm", "__pycache__")])
    if pipeline:
        (tmp_path / "hiemal" / "llm" / "__pycache__").mkdir(parents=True)  # what a deleted package may leave
        (tmp_path / "corpus_pipeline.py").write_text("import hiemal.llm.byte_bpe\n")
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", ASK], cwd=tmp_path, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    assert out.stdout.strip() == "0"
