"""The intermediate tables of the operators: those of the library."""

from quietwire.sources.staging import delete, release, shared_dir, stage, staged_tables

__all__ = ["delete", "release", "shared_dir", "stage", "staged_tables"]
