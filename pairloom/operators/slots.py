"""Places for models, and operators named in a configuration.

A slot maps Arrow batches with a model that each worker process makes once; networks are not part of this library. What
models found elsewhere comes in columns (plans/curation.py).
"""

from __future__ import annotations

import importlib
from collections.abc import Callable, Mapping
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DataType, StructField, StructType


def instantiate(config: Mapping):
    """The class or function named by `target`, called with `params`."""
    if "target" not in config:
        raise KeyError("a configuration needs a target")
    module, _, name = config["target"].rpartition(".")
    return getattr(importlib.import_module(module), name)(**config.get("params", {}))


@lru_cache(maxsize=8)
def _model(make: Callable):
    return make()


def apply_model(df: DataFrame, make: Callable[[], Callable[[dict], object]], to: str, kind: str, arrow: pa.DataType) -> DataFrame:
    """df with a column `to`: the model's answer for each row. make() runs once in each worker process."""
    schema = StructType([*df.schema, StructField(to, DataType.fromDDL(kind))])

    def run(batches):
        model = _model(make)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([model(r) for r in batch.to_pylist()], arrow)], names=[*batch.schema.names, to])

    return df.mapInArrow(run, schema)
