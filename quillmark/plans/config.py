"""Run configurations, the ladder of rungs, and configuration fingerprints."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values.
PARSER_VERSION = 2
JUDGE_VERSION = "v2"
#: Fields added later: they enter a fingerprint only when they differ from their default.
_LATER = {"confidence_source": "composite", "require_provenance": False, "exclude_superseded": False}


@dataclass(frozen=True)
class RunConfig:
    """One way of answering.  ``label`` is not part of the identity.

    Fixed values: the names of the fields, and their defaults, enter the fingerprints of
    rows already recorded.
    """

    id: str
    label: str = ""
    retrieval: str = "dense"
    rerank: bool = False
    require_citations: bool = False
    verifier: str = "off"
    abstain: bool = False
    chunk_tokens: int = 400
    chunk_overlap: int = 64
    top_k_retrieve: int = 20
    top_k_context: int = 6
    rrf_k: int = 60
    temperature: float = 0.2
    agreement_samples: int = 3
    abstain_threshold: float = 0.5
    generator_model: str = "gemini-3.5-flash-lite"
    verifier_model: str = "openai/gpt-oss-120b"
    reranker_model: str = "cross-encoder/ms-marco-MiniLM-L-6-v2"
    confidence_source: str = "composite"
    require_provenance: bool = False
    exclude_superseded: bool = False

    @property
    def cites(self) -> bool:
        return self.require_citations


def ladder() -> list[RunConfig]:
    """Rungs A to J, each the previous one with one safeguard more."""
    changes: list[tuple[str, str, dict]] = [
        ("A", "dense retrieval", {}),
        ("B", "hybrid retrieval", {"retrieval": "hybrid"}),
        ("C", "reranking", {"rerank": True}),
        ("D", "required citations", {"require_citations": True}),
        ("E", "verified claims", {"verifier": "drop_unsupported"}),
        ("F", "abstention", {"abstain": True}),
        ("G", "answerability gate", {"confidence_source": "answerability", "abstain_threshold": 0.75}),
        ("H", "provenance", {"require_provenance": True}),
        ("I", "current versions", {"exclude_superseded": True}),
        ("J", "ten passages", {"top_k_context": 10}),
    ]
    rungs, rung = [], RunConfig("A")
    for name, label, change in changes:
        rung = replace(rung, id=name, label=label, **change)
        rungs.append(rung)
    return rungs


def fingerprint(config) -> str:
    """First ten hex digits of the hash of the configuration's canonical JSON.

    Takes any mapping or dataclass, so rows written by other tools can be checked.
    """
    fields = dict(config) if isinstance(config, dict) else asdict(config)
    kept = {k: v for k, v in fields.items() if k != "label" and not (k in _LATER and v == _LATER[k])}
    return hashlib.sha256(json.dumps(kept, sort_keys=True).encode()).hexdigest()[:10]


def rung_name(config_id: Column, configs: list[RunConfig] | None = None) -> Column:
    """``id · label`` for a rung of the ladder, other ids as they are."""
    out = config_id
    for c in configs or ladder():
        out = F.when(config_id == c.id, f"{c.id} · {c.label}").otherwise(out)
    return out


def configs_table(spark: SparkSession, configs: list[RunConfig]) -> DataFrame:
    """``config_id, config_fingerprint, cites``: a dimension of as many rows as there are rungs."""
    return spark.createDataFrame(
        [(c.id, fingerprint(c), c.cites) for c in configs], "config_id string, config_fingerprint string, cites boolean")
