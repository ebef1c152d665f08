"""Errors, and the stable code of any error. The codes are fixed values: callers in other languages compare them."""

from __future__ import annotations

from .operators.context import ContextAssemblyError


class SnapshotLoadError(ValueError):
    """Source files that don't make a consistent snapshot."""

    code = "snapshot_load_error"


class StoredIndexError(ValueError):
    """A stored index that is missing, damaged or of another format."""

    code = "sqlite_index_error"


class VectorIndexError(ValueError):
    """A stored vector index that is missing, damaged or doesn't fit."""

    code = "vector_sidecar_error"


class RetrievalError(ValueError):
    """A search that can't be run as configured."""

    code = "retrieval_error"


class EvaluationLoadError(ValueError):
    """Evaluation cases that can't be read."""

    code = "evaluation_load_error"


class EmbeddingError(ValueError):
    """An embedder that returned something else than it should."""

    code = "embedding_provider_error"


class FusionError(ValueError):
    """Rankings that can't be fused as configured."""

    code = "fusion_error"


class EvaluationError(ValueError):
    """Results that can't be evaluated or compared."""

    code = "evaluation_error"


class VectorRetrievalError(ValueError):
    """A vector search that doesn't fit its index."""

    code = "vector_retrieval_error"


class UsageError(ValueError):
    """A command line that can't be understood."""

    code = "usage_error"


ContextAssemblyError.code = "context_assembly_error"


def diagnostic_code(error: BaseException) -> str:
    """The code of an error: its own, else one for files, for input, or for anything else."""
    if isinstance(code := getattr(type(error), "code", None), str):
        return code
    if isinstance(error, OSError):
        return "io_error"
    return "invalid_input" if isinstance(error, (ValueError, TypeError, LookupError)) else "internal_error"
