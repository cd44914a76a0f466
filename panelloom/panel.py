"""Names of the roles that the columns of a panel play."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Panel:
    """One row per (month, security): key, factors and forward returns."""

    date: str
    key: tuple[str, ...]
    features: tuple[str, ...]
    label_reg: str | None = None
    label_cla: str | None = None
    label_fm: str | None = None
    sector: str | None = None
    extra: tuple[str, ...] = field(default_factory=tuple)
    types: dict[str, T.DataType] = field(default_factory=dict)  # where they differ from ``schema``

    def columns(self) -> list[str]:
        named = [self.date, *self.key, *self.features]
        named += [c for c in (self.label_reg, self.label_cla, self.label_fm, self.sector) if c]
        return list(dict.fromkeys([*named, *self.extra]))

    def schema(self) -> T.StructType:
        """Explicit schema for text sources; keys are long, factors double, unless ``types`` says so."""
        kinds: dict[str, T.DataType] = {self.date: T.DateType()}
        kinds.update({k: T.LongType() for k in self.key})
        for name in (self.label_cla, self.sector):
            if name:
                kinds[name] = T.IntegerType()
        kinds.update(self.types)
        return T.StructType(
            [T.StructField(c, kinds.get(c, T.DoubleType())) for c in self.columns()]
        )

    def check(self, df: DataFrame) -> DataFrame:
        """Fail early on missing columns; return the panel's columns only."""
        missing = [c for c in self.columns() if c not in df.columns]
        if missing:
            raise ValueError(f"panel lacks columns {missing}")
        return df.select(*self.columns())

    def normalise(self, df: DataFrame) -> DataFrame:
        """Month-start dates and NULL instead of NaN, so that both mean 'missing'."""
        kinds = dict(df.dtypes)
        out = []
        for c in df.columns:
            if c == self.date:
                out.append(F.trunc(c, "month").alias(c))
            elif kinds[c] in ("double", "float"):
                out.append(F.nanvl(c, F.lit(None).cast("double")).alias(c))
            else:
                out.append(F.col(c))
        return df.select(*out)
