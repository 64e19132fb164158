import pytest


@pytest.fixture(scope="session")
def sheet(spark):
    """A sheet of texts: (row_id, value), plus columns whose names operators use inside."""

    def make(values, clash=False):
        df = spark.createDataFrame(list(enumerate(values)) if not values or not isinstance(values[0], tuple) else values, "row_id bigint, value string")
        if clash:
            for name in ("cell", "node", "at", "words", "spans", "row", "cell_key", "n_hit", "kept", "token", "part"):
                df = df.selectExpr("*", f"'x' AS `{name}`")
        return df

    return make
