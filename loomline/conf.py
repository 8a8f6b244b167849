"""Engine settings."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConf:
    """Limits and sizes of the two pipelines, and where tables live (``root`` is a shared folder)."""

    root: str = "loomline-data"
    window_pages: int = 10
    window_overlap: int = 2
    chunk_chars: int = 1200
    chunk_overlap: int = 200
    top_chunks: int = 8
    top_events: int = 12
    batch_windows: int = 2
    concurrency: int = 5
    embed_dim: int = 64
    embed_batch: int = 96
    digest_chars: int = 12000
    prompt_chars: tuple[int, ...] = (14000, 4500, 2000)
    max_hops: int = 80
    model_partitions: int = 5
    #: Folders that the rows of a document's tables are spread over.
    buckets: int = 64
    #: Updates of jobs after which their log is compacted.
    job_updates: int = 200

    def table(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"
