"""Every query of the core against its SQL on the smallest tables."""

import pytest
from verify import DATA, compare, connect

from reelgrid.plans import registry

FOLDER = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, con, name):
    ok, text = compare(spark, name, registry.queries()[name], registry.oracle_sql()[name], FOLDER, con)
    assert ok, text


def test_the_rest_runs_without_the_text_package():
    import pathlib
    import re

    root = pathlib.Path(registry.__file__).resolve().parent.parent
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"reelgrid\.llm|from \.llm", p.read_text()), p
