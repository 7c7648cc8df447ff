"""Every registered query against its reference SQL."""

import pytest
from compare import differences

from thicket.catalog import ENTRIES


@pytest.mark.parametrize("name", list(ENTRIES))
def test_query(name, spark, sf_dir, duck):
    entry = ENTRIES[name]
    df = entry.run(spark, sf_dir)
    if entry.sql is None:
        assert df.count() > 0
        return
    found = [d for d in differences(df, duck, entry.sql) if d != "both sides are empty"]
    assert not found, "\n".join(found)
