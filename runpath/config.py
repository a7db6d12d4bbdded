"""Settings of a project with their defaults, and places in files."""

from __future__ import annotations

from dataclasses import dataclass, field

from runpath import fixed


@dataclass(frozen=True)
class ParserConfig:
    use_clang: bool = False
    compile_commands: str | None = None
    extensions: tuple[str, ...] = ("c", "h")
    exclude_dirs: tuple[str, ...] = (".git", "build", "node_modules")


@dataclass(frozen=True)
class IndexConfig:
    storage_path: str | None = None
    incremental: bool = True
    max_memory_mb: int = 2048
    buckets: int = 64


@dataclass(frozen=True)
class AnalysisConfig:
    track_async: bool = True
    resolve_func_ptrs: bool = True
    max_call_depth: int = fixed.TREE_DEPTH
    knowledge_paths: tuple[str, ...] = ()


@dataclass(frozen=True)
class BatchConfig:
    """Globs on file names of a batch scan."""

    include: tuple[str, ...] = ("*.c", "*.h")
    exclude: tuple[str, ...] = ()


@dataclass(frozen=True)
class Config:
    project_root: str = "."
    parser: ParserConfig = field(default_factory=ParserConfig)
    index: IndexConfig = field(default_factory=IndexConfig)
    analysis: AnalysisConfig = field(default_factory=AnalysisConfig)


@dataclass(frozen=True)
class Location:
    """A range in a file; lines count from 1, columns from 0. Without an end it ends on its first line."""

    file: str
    line: int
    column: int = 0
    end_line: int | None = None
    end_column: int | None = None

    @property
    def last_line(self) -> int:
        return self.line if self.end_line is None else self.end_line

    def __str__(self) -> str:
        return f"{self.file}:{self.line}:{self.column}"
