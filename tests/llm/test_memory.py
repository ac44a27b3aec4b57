"""Python workers live on between tasks; what a batch or a model took must not stay with them."""

from pathlib import Path

import pandas as pd
import pytest

from wardcast.llm import shared

MB = 1 << 20


@pytest.fixture
def one_by_one(spark):
    """Batches of one row."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "1")
    yield spark
    spark.conf.set(name, before)


def tools():
    """Functions that workers, which don't have this module, get by value."""

    def crowd(kept: list) -> None:
        """Take 200 MB in small pieces and free all but the last, which keeps the C library from giving any back by itself."""
        pieces = [bytes(1_000) for _ in range(200 * MB // 1_000)]
        kept.append(pieces[-1])

    def held() -> int:
        """MB that this process holds of its own."""
        lines = Path("/proc/self/status").read_text().splitlines()
        return next(int(line.split()[1]) for line in lines if line.startswith("RssAnon:")) // 1024

    return crowd, held


def test_batch_leaves_no_memory_behind(one_by_one):
    if shared.trimmer() is None or not Path("/proc/self/status").exists():
        pytest.skip("needs glibc and /proc")
    crowd, held = tools()
    kept = []

    def measured(values: pd.Series) -> pd.Series:
        before = held()
        if values.iloc[0] == 0:
            crowd(kept)
        return pd.Series([before] * len(values))

    def both(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"mb": measured(values)})

    rows = one_by_one.range(0, 2, 1, 1)
    for column in (shared.value_udf(measured, "long")("id"), shared.fields_udf(both, "mb long")("id")["mb"]):
        first, second = (r[0] for r in rows.select(column).collect())
        assert second - first < 50


def test_model_leaves_only_itself_behind(spark):
    if shared.trimmer() is None or not Path("/proc/self/status").exists():
        pytest.skip("needs glibc and /proc")
    crowd, held = tools()
    kept, before = [], held()
    shared.Sent(spark, None).made(lambda _: crowd(kept))
    assert held() - before < 50
