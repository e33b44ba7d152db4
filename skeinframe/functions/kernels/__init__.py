"""numpy functions of one dense array, for skeinframe.operators.dense.apply."""
