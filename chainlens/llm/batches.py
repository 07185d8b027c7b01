"""Arrow batches of bounded size for the Python operators."""

from __future__ import annotations

from pyspark.sql import DataFrame

ROWS, BYTES = 512, 8 << 20


def bounded(df: DataFrame) -> DataFrame:
    """The same DataFrame, in a session whose Arrow batches hold at most ``ROWS`` rows or about ``BYTES``.

    Whole texts go to Python; ten thousand of them at a time would fill an executor's
    memory outside the heap. A smaller setting of the session stays as it is.
    """
    conf = df.sparkSession.conf
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS),
                       ("spark.sql.execution.arrow.maxBytesPerBatch", BYTES)):
        now = (conf.get(name) or "").removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            conf.set(name, str(most))
    return df
