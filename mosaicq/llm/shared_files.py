"""Files in the shared folder, opened by tasks."""

from __future__ import annotations

import re


def open_shared(uri: str, write: bool = False):
    """A file of the shared folder; folders on the way are made when writing."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", uri))
    if not write:
        return store.open_input_file(path)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    return store.open_output_stream(path, compression=None)
