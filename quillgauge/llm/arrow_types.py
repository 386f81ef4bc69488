"""Arrow types of columns whose type the caller's table decides."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType


def arrow_type(kind: DataType) -> pa.DataType:
    return to_arrow_type(kind)
