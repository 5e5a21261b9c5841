"""Documents with every awkward row that the operators must take."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from llm_tables import prose  # noqa: E402


@pytest.fixture(scope="session")
def awkward():
    """Null and empty texts, blanks, null ids, ties, repeated rows, one long text, odd characters."""
    base = prose(3, 120)
    return [
        (1, base), (2, base), (2, base), (3, None), (4, ""), (5, " \t\n "), (6, "one"), (7, "One Two"),
        (None, base), (None, None), (8, prose(4, 30_000)), (9, "É x\x1cy 😀 A.B,c"), (10, "shti " * 600),
        (11, base.replace(" ", "  ", 5)), (12, base[:400] + " changed " + base[400:]),
    ]
