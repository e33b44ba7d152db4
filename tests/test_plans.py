"""What the plans must look like at any size."""

import contextlib
import io
import os

import pytest

from skeinframe.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(registry.queries()["flagship_masked_aggregation"](spark, DATA))
    assert "PushedFilters: [IsNotNull(l_discount)" in text or "GreaterThanOrEqual(l_discount,0.05)" in text
    assert "l_comment" not in text and "l_suppkey" not in text and "HashAggregate" in text


@pytest.mark.parametrize("name", [n for n in registry.queries() if n.startswith("arith_")])
def test_elementwise_stays_in_the_jvm_without_shuffle(spark, name):
    text = plan(registry.queries()[name](spark, DATA))
    assert "Exchange" not in text and "Python" not in text and "Arrow" not in text and "[codegen id" in text


@pytest.mark.parametrize(("name", "node"), [("topk", "WindowGroupLimit"), ("topk_all", "TakeOrderedAndProject"), ("tensor_matmul", "BroadcastHashJoin"), ("reduce_lanes", "HashAggregate")])
def test_nodes(spark, name, node):
    text = plan(registry.queries()[name](spark, DATA))
    assert node in text and "CartesianProduct" not in text


@pytest.mark.parametrize("name", ["tensor_moddims", "tensor_shift", "tensor_flip", "tensor_tile", "tensor_join", "tensor_lower", "tensor_transpose", "tensor_index"])
def test_reshaping_is_free_of_shuffles(spark, name):
    assert "Exchange" not in plan(registry.queries()[name](spark, DATA))


def test_dense_kernels_read_their_column_alone(spark):
    text = plan(registry.queries()["fft"](spark, DATA))
    assert "MapInArrow" in text and "Exchange" not in text
