"""``Episodes``: a lazy table of episode records with stratified slicing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from episodeframe.schema import EPISODE, STRATUM

FIELDS = ("run_id", "model", "task")


class Episodes:
    """Every method returns a new plan; nothing is computed or collected."""

    def __init__(self, df: DataFrame) -> None:
        self.df = df

    # ------------------------------------------------------------ building
    @classmethod
    def of(cls, spark: SparkSession, rows: list[dict]) -> Episodes:
        """From dicts in the order given; absent fields are null, extra keys raise."""
        names = EPISODE.names
        data = []
        for i, row in enumerate(rows):
            if unknown := set(row) - set(names):
                raise ValueError(f"unknown fields: {sorted(unknown)}")
            data.append(tuple({"episode": 0, "strata": {}, "ord": i, **row}.get(n) for n in names))
        return cls(spark.createDataFrame(data, EPISODE))

    def union(self, other: Episodes) -> Episodes:
        return Episodes(self.df.unionByName(other.df, allowMissingColumns=True))

    # -------------------------------------------------------------- strata
    @property
    def strata_columns(self) -> list[str]:
        return [c for c in self.df.columns if c.startswith(STRATUM)]

    def promote(self, *keys: str) -> Episodes:
        """Keys of the strata map as ``s_<key>`` columns; without names, all keys that occur (one small job)."""
        found = keys or tuple(sorted(r[0] for r in self.df.select(F.explode(F.map_keys("strata"))).distinct().collect()))
        return Episodes(self.df.select("*", *(F.col("strata")[k].alias(STRATUM + k) for k in found)))

    def _key(self, name: str) -> Column:
        if name in FIELDS:
            return F.col(name)
        if STRATUM + name in self.df.columns:
            return F.col(STRATUM + name)
        return F.col("strata")[name] if "strata" in self.df.columns else F.lit(None)

    # ----------------------------------------------------------- selection
    def slice(self, **equals) -> Episodes:
        """Rows equal in all keys; None matches rows without the stratum."""
        out = self.df
        for name, value in equals.items():
            out = out.where(self._key(name).eqNullSafe(F.lit(value)))
        return Episodes(out)

    def filter(self, predicate: Column | Callable) -> Episodes:
        """A column; or a Python function of a dict, evaluated in Arrow batches."""
        if isinstance(predicate, Column):
            return Episodes(self.df.where(predicate))
        kind = self.df.schema

        def run(batches):
            for batch in batches:
                import pyarrow as pa

                yield batch.filter(pa.array([bool(predicate(r)) for r in batch.to_pylist()], pa.bool_()))

        return Episodes(self.df.mapInArrow(run, kind))

    def query(self, score_min: float | None = None, score_max: float | None = None, success: bool | None = None, models: list[str] | None = None, tasks: list[str] | None = None, **strata) -> Episodes:
        """Inclusive bounds (a NaN score passes both) and memberships; a list stratum is a membership too."""
        out = self.df
        if score_min is not None:
            out = out.where(F.isnan("score") | (F.col("score") >= score_min))
        if score_max is not None:
            out = out.where(F.isnan("score") | (F.col("score") <= score_max))
        if success is not None:
            out = out.where(F.col("success") == success)
        if models is not None:
            out = out.where(F.col("model").isin(list(models)))
        if tasks is not None:
            out = out.where(F.col("task").isin(list(tasks)))
        for name, value in strata.items():
            key = self._key(name)
            out = out.where(key.isin(list(value)) if isinstance(value, (list, tuple, set)) else key.eqNullSafe(F.lit(value)))
        return Episodes(out)

    def completed(self) -> Episodes:
        """Without infrastructure errors."""
        return Episodes(self.df.where(~F.col("failure_mode").eqNullSafe("missing_reward")))

    def scores(self) -> DataFrame:
        return self.df.select("score")

    def numbered(self, *order: str) -> Episodes:
        """``episode`` counted from 0 within (run, model, task).

        Rows are dealt to all shuffle partitions by number: numbers and names that
        compress well would else be put together in few tasks by their size in the shuffle.
        """
        from pyspark.sql import Window

        keys = ("run_id", "model", "task")
        dealt = self.df.repartition(int(self.df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
        w = Window.partitionBy(*keys).orderBy(*(order or ("ord",)))
        return Episodes(dealt.withColumn("episode", (F.row_number().over(w) - 1).cast("int")))

    def write(self, path: str, mode: str = "errorifexists") -> None:
        """Parquet partitioned the way slices read it."""
        self.df.write.mode(mode).partitionBy("model", "run_id").parquet(path)

    def write_jsonl(self, path: str, mode: str = "errorifexists") -> None:
        """Canonical JSONL, one record a line, absent fields left out; ``read_jsonl`` reads it back."""
        self.df.write.mode(mode).json(path)
