"""Outputs of a run's stages as typed tables by thread and stage: a run that broke off goes on behind its last whole stage.

Only stages with a declared schema are stored and read; what is written is that schema, and what is read is compared with it. A stage is whole
when its writer has committed; whatever else lies at its place is a partial output, which is never read and is overwritten.
"""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

Stage = Callable[[dict[str, DataFrame]], DataFrame]


def _plain(schema: T.DataType) -> object:
    """Names and types, whatever may be null."""
    if isinstance(schema, T.StructType):
        return [(f.name, _plain(f.dataType)) for f in schema.fields]
    if isinstance(schema, T.ArrayType):
        return ["array", _plain(schema.elementType)]
    if isinstance(schema, T.MapType):
        return ["map", _plain(schema.keyType), _plain(schema.valueType)]
    return schema.simpleString()


class Checkpoints:
    """path: a folder that driver and executors share; schemas: what each stage's output is."""

    def __init__(self, spark: SparkSession, path: str, schemas: dict[str, T.StructType]):
        self.spark, self.path, self.schemas = spark, path.rstrip("/"), schemas

    def _at(self, thread: str, stage: str) -> str:
        if stage not in self.schemas:
            raise ValueError(f"stage {stage!r} has no declared schema")
        return f"{self.path}/thread={quote(thread, safe='')}/stage={quote(stage, safe='')}"

    def whole(self, thread: str, stage: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self._at(thread, stage)}/_SUCCESS")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def save(self, thread: str, stage: str, output: DataFrame) -> None:
        output.to(self.schemas[stage] if stage in self.schemas else output.schema).write.mode("overwrite").parquet(self._at(thread, stage))

    def load(self, thread: str, stage: str) -> DataFrame:
        at = self._at(thread, stage)
        if not self.whole(thread, stage):
            raise ValueError(f"the output of {stage!r} is not whole")
        found = self.spark.read.parquet(at)
        if _plain(found.schema) != _plain(self.schemas[stage]):
            raise ValueError(f"the output of {stage!r} is {found.schema.simpleString()}, not {self.schemas[stage].simpleString()}")
        return found.to(self.schemas[stage])

    def run(self, thread: str, stages: dict[str, Stage]) -> tuple[str, dict[str, DataFrame]]:
        """('completed', 'resumed' or 'started', outputs by stage): each stage takes the outputs before it. From the first stage that is not whole all run again."""
        for stage in stages:
            self._at(thread, stage)
        names = list(stages)
        done = next((i for i, s in enumerate(names) if not self.whole(thread, s)), len(names))
        outputs = {s: self.load(thread, s) for s in names[:done]}
        for stage in names[done:]:
            self.save(thread, stage, stages[stage](dict(outputs)))
            outputs[stage] = self.load(thread, stage)
        return "completed" if done == len(names) else "resumed" if done else "started", outputs
