"""Binary files in the shared folder, on any file system that pyarrow knows by its URI."""

import re

from pyarrow import fs


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI; a path without a scheme is local."""
    if not re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:", uri):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def create(uri: str):
    """A new file to be written from start to end; its folder is made."""
    system, path = place(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path, compression=None)


def open_read(uri: str):
    system, path = place(uri)
    return system.open_input_file(path)
