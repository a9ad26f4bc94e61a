"""Registered operators against their SQL at the smallest scale."""
import pytest

import __spark_entry__ as entry
from check_oracles import compare, connect
from conftest import SF
from lexloom.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    assert compare(QUERIES[name](spark, SF), connect(SF), ORACLES[name]) is None


def test_registered():
    found = entry.queries()
    assert sorted(int(k[2:].split("_")[0]) for k in found if k[:2] == "op" and k[2].isdigit()) == list(range(1, 14))
    assert "pipeline" in found and set(QUERIES) <= set(found)


def test_broadcasts_are_bounded():
    """Two operators send a value to all tasks: a fitted model, of which the sample bounds
    the size, and a slice of the benchmark of a number of characters."""
    from pathlib import Path

    from lexloom.llm import common
    sources = {p.name: p.read_text() for p in Path(common.__file__).parent.glob("*.py")}
    assert sorted(n for n, text in sources.items() if "broadcast(" in text) == ["decontaminate.py", "toxicity.py"]
    assert "SLICE_CHARS" in sources["decontaminate.py"] and "SAMPLE_" in sources["toxicity.py"]
    assert not any("crossJoin" in text or "localCheckpoint" in text for text in sources.values())
