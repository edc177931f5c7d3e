"""Opening files by URI inside tasks, on any filesystem Arrow knows."""

from __future__ import annotations

import sys

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle


def filesystem_and_path(uri: str) -> tuple[pafs.FileSystem, str]:
    """Accepts plain paths, file:/a, file:///a and Hadoop-style scheme://... URIs."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    scheme, rest = uri.split("://", 1)
    return pafs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}://{rest}")


def arrow_opens(uri: str) -> bool:
    """Whether Arrow has a filesystem for the URI's scheme, and its libraries; Spark may have
    others."""
    try:
        filesystem_and_path(uri)
    except (pa.ArrowInvalid, OSError):
        return False
    return True


def ship_by_value(module_name: str) -> None:
    """Let tasks run this module's functions without the package installed there."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


ship_by_value(__name__)
