"""Default parameters of the corpus analyses."""

from __future__ import annotations

from dataclasses import dataclass

# Defaults of chunking, sampling, lexical grid and semantic measures.
CHUNK_CHARS = 768
MAX_CHUNKS = 2048
MAX_DOCUMENTS = 50_000
MAX_CHUNKS_PER_DOCUMENT = 2
SAMPLE_SEED = 20260505
SCAN_DOCUMENTS = 50_000
RESERVOIR_DOCUMENTS = 12_000
TOKENIZERS = ("punct", "stable")
ORDERS = (1, 2, 3)
VOCABULARIES = (256, 512, 1024)
JS_EPSILON = 1e-12
CLUSTERS = 24
CLUSTER_SEEDS = 10
CLUSTER_ROUNDS = 25
CLUSTER_SWEEP = (12, 16, 24, 32, 48)
ALPHAS = (0.0, 0.1, 0.25, 0.5, 0.75, 1.0)
PROJECTIONS = 256
NEAR_CEILING = 0.65
TOLERANCE = 5e-4
METRICS = ("lexical_js", "rho", "semantic_cluster_js", "compression_abs_diff", "top1_abs_diff", "top5_abs_diff")


@dataclass(frozen=True)
class Chunking:
    """``per_document`` and ``per_corpus``: budgets, or None for all."""

    chars: int = CHUNK_CHARS
    per_document: int | None = MAX_CHUNKS_PER_DOCUMENT
    per_corpus: int | None = MAX_CHUNKS
    documents: int | None = MAX_DOCUMENTS

    @property
    def least(self) -> int:
        """Characters that a window must keep after stripping."""
        return max(64, self.chars // 4)


def least_vocabulary(size: int) -> int:
    """Grams that a cell's vocabulary needs to be used."""
    return max(16, min(size, 64))
