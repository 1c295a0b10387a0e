"""Every tunable of the library in one place."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    """Names, sizes and thresholds. The defaults are the reference values."""

    database: str = "default"
    raw_table: str = "raw_docs"
    chunk_table: str = "doc_chunks"
    eval_table: str = "eval_set"
    key_column: str = "id"
    text_column: str = "content"
    uri_column: str = "source"

    chunk_size: int = 500
    chunk_overlap: int = 10
    arrow_batch_rows: int = 10

    embedding_dim: int = 64
    k: int = 5
    nprobe: int = 3

    eval_questions: int = 25

    routes: tuple[str, ...] = ("code", "general", "tables", "dashboards")
    route_rules: tuple[tuple[str, tuple[str, ...]], ...] = field(
        default=(
            ("tables", ("finance", "accounts", "orders", "customers")),
            ("dashboards", ("marketing", "dashboard", "report", "reports")),
            ("code", ("code", "python", "sql", "function")),
        )
    )
