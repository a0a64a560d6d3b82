"""No query on one request or random lists sends users or catalog whole through the driver."""

import re

import pytest

from __spark_entry__ import queries
from tests.conftest import SMALL


@pytest.mark.parametrize("name", ["X16", "X17", "X17_shape"])
def test_users_and_catalog_are_not_broadcast(spark, name):
    plan = queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"BroadcastHashJoin \[([^\]]*)\]", plan)
    keys = [{re.sub(r"#\d+$", "", k.strip()) for k in found.split(",")} for found in keys]
    assert not [k for k in keys if k & {"user_id", "product_id", "payload_id", "place"}]
