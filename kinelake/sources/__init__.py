"""Readers of recordings; register(spark) makes the binary formats available to spark.read.format()."""

from __future__ import annotations

from pyspark.sql import SparkSession

from kinelake.sources.avro import EmpaticaSource
from kinelake.sources.binary import AxivitySource, GeneActivSource, NumpySource
from kinelake.sources.hdf5 import ApdmSource


def register(spark: SparkSession) -> None:
    for source in (ApdmSource, AxivitySource, EmpaticaSource, GeneActivSource, NumpySource):
        spark.dataSource.register(source)
