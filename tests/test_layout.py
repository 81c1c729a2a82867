"""The library does not lean on its llm subpackage."""

import re
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_nothing_imports_llm():
    for file in (ROOT / "groundwire").rglob("*.py"):
        if "llm" not in file.relative_to(ROOT / "groundwire").parts:
            assert not re.search(r"(?m)^\s*(from|import)\s.*\bllm\b", file.read_text()), file
