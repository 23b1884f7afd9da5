"""Schemas of the input tables. Reading with a schema spares the pass that infers one."""

from __future__ import annotations

from pyspark.sql.types import (
    DateType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)


def _struct(**fields) -> StructType:
    return StructType([StructField(name, kind()) for name, kind in fields.items()])


# Column names of the files.
WEATHER_RAW = _struct(
    Site=StringType,
    ObservationDate=DateType,
    TAverage_pred=DoubleType,
    TMin_pred=DoubleType,
    TMax_pred=DoubleType,
    WindSpeed_pred=DoubleType,
    HRAverage_pred=DoubleType,
    HRMax_pred=DoubleType,
    HRMin_pred=DoubleType,
    Rainfall_pred=DoubleType,
    PAR_pred=DoubleType,
)

WEATHER = _struct(
    Site=StringType,
    date=DateType,
    timestep=IntegerType,
    duration=IntegerType,
    months_after_planting=IntegerType,
    T=DoubleType,
    Tmin=DoubleType,
    Tmax=DoubleType,
    Wind=DoubleType,
    Rh=DoubleType,
    Rh_max=DoubleType,
    Rh_min=DoubleType,
    Precipitations=DoubleType,
    Ri_PAR_f=DoubleType,
    Rg=DoubleType,
)

OBSERVATIONS = _struct(
    site=StringType,
    genotype=StringType,
    months_after_planting=IntegerType,
    date=DateType,
    nb_leaves_emitted=DoubleType,
)

EDGES = _struct(node=LongType, parent=LongType, symbol=StringType)

PARAMETERS = _struct(Site=StringType, path=StringType, value=StringType)
