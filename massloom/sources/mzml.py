"""mzML as a Spark data source: spark.read.format("mzml").load(folder).

One file is one partition and is parsed as a stream of elements on an executor, so a
file of any size takes the memory of one spectrum. Indexes inside files aren't needed.
"""

from __future__ import annotations

import base64
import glob
import os
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: fixed values: accessions of the controlled vocabulary
MS_LEVEL, NEGATIVE, POSITIVE = "MS:1000511", "MS:1000129", "MS:1000130"
SCAN_TIME, MINUTE = "MS:1000016", "UO:0000031"
ZLIB, NO_COMPRESSION = "MS:1000574", "MS:1000576"
MZ_ARRAY, INTENSITY_ARRAY, TIME_ARRAY = "MS:1000514", "MS:1000515", "MS:1000595"
CENTROID = "MS:1000127"
TYPES = {"MS:1000519": "<i4", "MS:1000520": "<f2", "MS:1000521": "<f4", "MS:1000522": "<i8", "MS:1000523": "<f8"}

SPECTRA = "sample string, scan int, ms_level int, polarity int, time double, centroid boolean, mz array<double>, spint array<double>"
CHROMATOGRAMS = "sample string, name string, time array<double>, spint array<double>"


def _tag(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _params(e: ElementTree.Element) -> dict[str, ElementTree.Element]:
    return {x.get("accession"): x for x in e if _tag(x) == "cvParam"}


def decode_array(e: ElementTree.Element) -> tuple[str | None, np.ndarray, bool]:
    """(accession of the kind, values, whether it is in minutes) of a binaryDataArray; empty data give an empty array."""
    p = _params(e)
    kind = next((k for k in (MZ_ARRAY, INTENSITY_ARRAY, TIME_ARRAY) if k in p), None)
    text = next((x.text for x in e if _tag(x) == "binary"), None)
    minutes = kind is not None and p[kind].get("unitAccession") == MINUTE
    if not text or not text.strip():
        return kind, np.zeros(0), minutes
    dtype = next((t for a, t in TYPES.items() if a in p), None)
    if dtype is None or not (ZLIB in p or NO_COMPRESSION in p):
        raise NotImplementedError("an encoding of binary data that isn't supported")
    data = base64.b64decode(text)
    return kind, np.frombuffer(zlib.decompress(data) if ZLIB in p else data, dtype).astype(float), minutes


def _arrays(e: ElementTree.Element) -> dict[str, np.ndarray]:
    out = {}
    for x in e.iter():
        if _tag(x) == "binaryDataArray":
            kind, values, minutes = decode_array(x)
            if kind:
                out[kind] = values * 60.0 if minutes else values
    return out


def parse(path: str, what: str = "spectra") -> Iterator[tuple]:
    """Rows of a file: spectra with their scan number from 0, or chromatograms with time in seconds."""
    sample = os.path.splitext(os.path.basename(path))[0]
    scan = 0
    above: list = []
    for event, e in ElementTree.iterparse(path, events=("start", "end")):
        if event == "start":
            above.append(e)
            continue
        above.pop()
        if _tag(e) == "spectrum":
            if what == "spectra":
                p = _params(e)
                time = None
                for s in e.iter():
                    if _tag(s) == "cvParam" and s.get("accession") == SCAN_TIME:
                        time = float(s.get("value")) * (60.0 if s.get("unitAccession") == MINUTE else 1.0)
                a = _arrays(e)
                yield (
                    sample, scan, int(p[MS_LEVEL].get("value")) if MS_LEVEL in p else 1, -1 if NEGATIVE in p else 1 if POSITIVE in p else None, time, CENTROID in p,
                    a.get(MZ_ARRAY, np.zeros(0)).tolist(), a.get(INTENSITY_ARRAY, np.zeros(0)).tolist(),
                )
            scan += 1
            # taken out of its list, which else would hold every emptied element
            above[-1].remove(e)
        elif _tag(e) == "chromatogram":
            if what == "chromatograms":
                a = _arrays(e)
                yield sample, e.get("id"), a.get(TIME_ARRAY, np.zeros(0)).tolist(), a.get(INTENSITY_ARRAY, np.zeros(0)).tolist()
            above[-1].remove(e)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str, what: str):
        self.path, self.what = path, what

    def partitions(self) -> list[InputPartition]:
        path = self.path.removeprefix("file://")
        names = sorted(glob.glob(os.path.join(path, "*.mzML"))) if os.path.isdir(path) else sorted(glob.glob(path))
        return [_File(n) for n in names]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return parse(partition.path, self.what)


class MzmlSource(DataSource):
    """Option ``what``: spectra (default) or chromatograms."""

    @classmethod
    def name(cls) -> str:
        return "mzml"

    def schema(self) -> str:
        return CHROMATOGRAMS if self.options.get("what") == "chromatograms" else SPECTRA

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("what", "spectra"))


def read_mzml(spark: SparkSession, path: str, what: str = "spectra") -> DataFrame:
    """Spectra or chromatograms of the mzML files in a folder, or of one file."""
    spark.dataSource.register(MzmlSource)
    return spark.read.format("mzml").option("what", what).load(path)


def signals_of(spectra: DataFrame) -> DataFrame:
    """Array form to long form: one row for each signal."""
    from pyspark.sql import functions as F

    z = spectra.withColumn("_z", F.explode(F.arrays_zip("mz", "spint")))
    return z.select("sample", "scan", "ms_level", "polarity", "time", F.col("_z.mz").alias("mz"), F.col("_z.spint").alias("spint"))


def write_mzml(path: str, spectra: list[dict], compress: bool = True, minutes: bool = False) -> None:
    """Writes a small mzML file of {time, ms_level, polarity, mz, spint}: for tests and exchange."""

    def array(values: list[float], kind: str) -> str:
        data = np.asarray(values, "<f8").tobytes()
        text = base64.b64encode(zlib.compress(data) if compress else data).decode() if len(values) else ""
        return f'<binaryDataArray><cvParam accession="MS:1000523"/><cvParam accession="{ZLIB if compress else NO_COMPRESSION}"/><cvParam accession="{kind}"/><binary>{text}</binary></binaryDataArray>'

    with open(path, "w", encoding="utf-8") as f:
        f.write('<?xml version="1.0" encoding="utf-8"?>\n<mzML xmlns="http://psi.hupo.org/ms/mzml"><run><spectrumList>\n')
        for k, s in enumerate(spectra):
            sign = NEGATIVE if s.get("polarity") == -1 else POSITIVE
            t = s["time"] / 60 if minutes else s["time"]
            f.write(
                f'<spectrum index="{k}" id="scan={k}"><cvParam accession="{MS_LEVEL}" value="{s.get("ms_level", 1)}"/><cvParam accession="{sign}"/><cvParam accession="{CENTROID}"/>'
                f'<scanList><scan><cvParam accession="{SCAN_TIME}" value="{t!r}" unitAccession="{MINUTE if minutes else "UO:0000010"}"/></scan></scanList>'
                f"<binaryDataArrayList>{array(s['mz'], MZ_ARRAY)}{array(s['spint'], INTENSITY_ARRAY)}</binaryDataArrayList></spectrum>\n"
            )
        f.write("</spectrumList></run></mzML>\n")
