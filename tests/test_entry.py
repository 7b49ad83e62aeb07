"""The entry file offers the warehouse queries whatever the text part needs and does not find."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("missing", ["public_tokenizers", "pyarrow", "tidemark.llm", "corpus_pipeline"])
def test_text_part_is_optional(missing):
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; print(*sorted(e.queries()))"
    out = subprocess.run([sys.executable, "-W", "error::SyntaxWarning", "-c", code], cwd=ROOT, capture_output=True, text=True, check=True)
    names = out.stdout.split()
    assert "scd2_apply" in names and len(names) > 160 and not any(n.startswith("op1") or n == "pipeline" for n in names)
    assert "left out" in out.stderr
