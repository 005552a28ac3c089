"""What all algorithms share: frozen, range-checked parameters and the contract of ``execute``."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import ClassVar

from pydantic import BaseModel, ConfigDict
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapsmith.functions import geometry as g
from mapsmith.operators.features import random_ids
from mapsmith.operators.model import Features, GeometryTypeError, InvalidCRSError, MissingReferenceError, check_projected, check_types


@dataclass(frozen=True)
class Reference:
    """What the reference table whose key a parameter names must hold."""

    types: frozenset[str]
    required: bool = False


class Algorithm(BaseModel):
    """Parameters are the fields; subclasses say which geometries they take and write ``_execute``."""

    model_config = ConfigDict(frozen=True, extra="ignore", arbitrary_types_allowed=True)

    accepts: ClassVar[frozenset[str]] = frozenset()
    references: ClassVar[dict[str, Reference]] = {}
    needs_projected: ClassVar[bool] = True
    keeps_identity: ClassVar[bool] = True

    def execute(self, data: Features, reference_data: dict[str, Features] | None = None, *, strict: bool = False) -> Features:
        """``strict`` looks at all geometry types first (a job for each table); otherwise a row of another type
        fails the job that reads it."""
        given = reference_data or {}
        self.validate_tables(data, given, strict)
        tables = {field: given[getattr(self, field)].plain() for field in self.references if getattr(self, field) in given}
        plain = data.plain() if strict else self.guarded(data.plain(), self.accepts)
        out = self._execute(plain, tables)
        if not self.keeps_identity:
            out = random_ids(out)
        return data.of(out) if set(data.plain().columns) <= set(out.columns) else replace(data, df=self._renamed(out, data))

    @staticmethod
    def _renamed(out: DataFrame, data: Features) -> DataFrame:
        names = {"geom": data.geom, "fid": data.fid, "_ord": data.ord}
        return out.select([F.col(c).alias(names.get(c, c)) for c in out.columns])

    @staticmethod
    def guarded(df: DataFrame, accepted: frozenset[str]) -> DataFrame:
        kind = F.coalesce(g.geom_type("geom"), F.lit("null"))
        return df.withColumn("geom", F.when(kind.isin(*accepted), F.col("geom")).otherwise(F.raise_error(F.concat(F.lit("geometry type not accepted: "), kind)).cast("binary")))

    def validate_tables(self, data: Features, given: dict[str, Features], strict: bool) -> None:
        if strict and not check_types(data.df, self.accepts, data.geom):
            raise GeometryTypeError(f"Input data must only contain geometries of following types: {', '.join(sorted(self.accepts))}.")
        if self.needs_projected:
            check_projected(data.crs)
        elif data.crs is None:
            raise InvalidCRSError("the table has no coordinate system")
        for field, wanted in self.references.items():
            table = given.get(getattr(self, field))
            if table is None:
                if wanted.required:
                    raise MissingReferenceError
                continue
            if strict and not check_types(table.df, wanted.types, table.geom):
                raise GeometryTypeError(f"Reference data must only contain geometries of following types: {', '.join(sorted(wanted.types))}.")
            if table.crs != data.crs:
                raise InvalidCRSError("reference data has another coordinate system")

    def _execute(self, df: DataFrame, ref: dict[str, DataFrame]) -> DataFrame:
        raise NotImplementedError
