"""Files that tasks write and read themselves, in folders every executor can reach."""

from __future__ import annotations

import uuid
from urllib.parse import urlsplit

from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.session import ensure_checkpoint_dir


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def resolve(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI or an absolute path."""
    scheme = urlsplit(uri).scheme
    if scheme in ("", "file"):
        return pafs.LocalFileSystem(), urlsplit(uri).path
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1) if scheme == "s3a" else uri)


def new_file(folder: str, suffix: str):
    """(name, stream) of a file with a name of its own, so that a repeated task never touches another's file.

    Only files named in a written manifest count; what a lost task left behind is never read.
    """
    system, path = resolve(folder)
    system.create_dir(path, recursive=True)
    name = f"{uuid.uuid4().hex}{suffix}"
    return f"{folder}/{name}", system.open_output_stream(f"{path}/{name}", compression=None)


def written(df: DataFrame, folder: str) -> DataFrame:
    """``df`` as a table in ``folder``: cuts lineage and survives lost executors."""
    df.write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows, else as it is. Count a written table, not a plan."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, lengthened where ``df`` has a column of that name in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


NO_ID = -(1 << 62)


def row_marks(id_col: str, text_col: str) -> list[Column]:
    """What tells rows apart where ids repeat: the id (null ids count as equal) and the text's hash."""
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), F.xxhash64(text_col)]
