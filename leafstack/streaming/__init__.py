from .ingest import ingest_chunks, ingest_numbered_chunks, ingest_raw, ingest_rejects, load_all
from .upserts import (
    bucket_of, committed_version, expire_versions, read_version, upsert_stream, write_version,
)

__all__ = [
    "ingest_chunks", "ingest_numbered_chunks", "ingest_raw", "ingest_rejects", "load_all",
    "bucket_of", "committed_version", "expire_versions", "read_version", "upsert_stream", "write_version",
]
