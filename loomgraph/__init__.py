"""Property graphs on Spark: openCypher, graph algorithms, streaming, vector search, knowledge graphs."""


def ship(spark) -> None:
    """Sends the package's source to the executors of a cluster on which it is not installed."""
    import shutil
    import tempfile
    from pathlib import Path

    home = Path(__file__).resolve().parent
    archive = shutil.make_archive(f"{tempfile.mkdtemp()}/loomgraph", "zip", home.parent, home.name)  # the driver serves it
    spark.sparkContext.addPyFile(archive)
