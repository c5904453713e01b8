from .files import load, from_rows, read_files_stream, spread, view
from .tables import ensure_chunks, ensure_parts, ensure_schema, qualified, read_table_stream, write_stream

__all__ = [
    "load", "from_rows", "read_files_stream", "spread", "view", "ensure_chunks", "ensure_parts",
    "ensure_schema", "qualified", "read_table_stream", "write_stream",
]
