"""Making the library importable in Python workers that do not see this folder."""

from __future__ import annotations

import hashlib
import io
import os
import zipfile

from pyspark.sql import SparkSession

from lectern.operators.lineage import shared_folder

PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def archive() -> bytes:
    """The package's modules as a zip, byte for byte the same for the same sources."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as packed:
        for folder, _, names in sorted(os.walk(PACKAGE)):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    entry = zipfile.ZipInfo(os.path.relpath(path, os.path.dirname(PACKAGE)))
                    with open(path, "rb") as file:
                        packed.writestr(entry, file.read())
    return out.getvalue()


def ship(spark: SparkSession) -> None:
    """Put the package on every worker's path, once per application, by way of the shared folder."""
    context = spark.sparkContext
    if getattr(context, "_lectern_shipped", False):
        return
    data = archive()
    path = f"{shared_folder(spark)}/lectern-{hashlib.sha256(data).hexdigest()[:16]}.zip"
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(context._jsc.hadoopConfiguration())
    if not store.exists(at):
        stream = store.create(at, True)
        stream.write(bytearray(data))
        stream.close()
    context.addPyFile(str(store.makeQualified(at).toString()))
    context._lectern_shipped = True
