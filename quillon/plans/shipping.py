"""Making the package importable in Python workers, wherever the driver found it."""

from __future__ import annotations

import io
import pathlib
import zipfile
import zlib

from pyspark.sql import SparkSession

import quillon
from quillon.plans.workspace import filesystem, shared_root

_shipped: set[str] = set()


def ensure_importable(spark: SparkSession) -> None:
    """Gives the package to the workers of a session, once: as a zip file in the shared folder."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = pathlib.Path(quillon.__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(root.rglob("*.py")):
            archive.writestr(zipfile.ZipInfo(str(path.relative_to(root.parent))), path.read_bytes())
    place = f"{shared_root(spark)}/quillon-{zlib.crc32(data.getvalue()):08x}-{context.applicationId}.zip"
    fs, path = filesystem(spark, place)
    stream = fs.create(path, True)
    stream.write(data.getvalue())
    stream.close()
    context.addPyFile(place)
    _shipped.add(context.applicationId)
