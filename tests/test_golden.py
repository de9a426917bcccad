import os

import golden
import pytest
from compare import rows_match

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", list(golden.QUERIES))
def test_samples(spark, name):
    rows_match(spark, golden.QUERIES[name], golden.ORACLE_SQL[name], SF)
