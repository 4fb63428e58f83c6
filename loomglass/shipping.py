"""Makes this package importable in Python workers."""

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> None:
    """Send the package's modules to the executors, once a session, unless their path has it already."""
    context = spark.sparkContext
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "_loomglass_shipped", False):
        return
    if ROOT.suffix == ".zip" or not ROOT.is_dir():  # it came as an archive, which Spark sent
        return
    archive = Path(tempfile.mkdtemp(prefix="loomglass-")) / "loomglass.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted((ROOT / "loomglass").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    context.addPyFile(str(archive))
    context._loomglass_shipped = True
