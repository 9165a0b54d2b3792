"""The settings file: which key sets which parameter of which operator.

Parameters live beside the operator that uses them, with their defaults. A settings file names
them by published keys, which are fixed values; this table is the only place that knows both.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, fields
from pathlib import Path
from typing import Any

from lodestone.operators.graph import Damage, Linking
from lodestone.operators.learning import Descent, GateRules
from lodestone.operators.packing import Context
from lodestone.operators.policies import Worth
from lodestone.operators.retrieval import Depths
from lodestone.operators.traversal import Reach


@dataclass(frozen=True)
class Files:
    """Inputs and outputs of a run; an empty model folder is ``<output>/models``."""

    corpus: str = ""
    training: str = ""
    evaluation: str = ""
    output: str = "outputs/experiment"
    models: str = ""
    measured_gains: str = ""

    @property
    def model_folder(self) -> str:
        return self.models or f"{self.output}/models"


@dataclass(frozen=True)
class Report:
    """What an evaluation compares, how often it resamples, whether and in which steps it goes on."""

    classic: bool = False
    oracle: bool = False
    resamples: int = 2000
    resume: bool = True
    batch_questions: int = 10_000


# The keys. One line each: key, owner, parameter.
TABLE: tuple[tuple[str, type, str], ...] = (
    ("corpus_path", Files, "corpus"),
    ("train_queries_path", Files, "training"),
    ("eval_queries_path", Files, "evaluation"),
    ("output_dir", Files, "output"),
    ("model_dir", Files, "models"),
    ("learning.counterfactual_labels_path", Files, "measured_gains"),
    ("retrieval.bm25_k", Depths, "lexical"),
    ("retrieval.dense_k", Depths, "dense"),
    ("retrieval.rerank_k", Depths, "fused"),
    ("retrieval.rrf_k", Depths, "rank_offset"),
    ("retrieval.seed_k", Context, "seeds"),
    ("retrieval.final_k", Context, "passages"),
    ("retrieval.evidence_token_budget", Context, "tokens"),
    ("graph.max_hops", Reach, "hops"),
    ("graph.frontier_cap", Reach, "frontier"),
    ("graph.max_actions", Reach, "actions"),
    ("graph.entity_mode", Linking, "entities"),
    ("graph.min_entity_df", Linking, "least_df"),
    ("graph.max_entity_df_ratio", Linking, "most_share"),
    ("graph.edge_dropout_rate", Damage, "dropout"),
    ("graph.false_edge_ratio", Damage, "false_links"),
    ("graph.corruption_seed", Damage, "seed"),
    ("learning.epochs", Descent, "epochs"),
    ("learning.learning_rate", Descent, "rate"),
    ("learning.l2", Descent, "l2"),
    ("learning.random_seed", Descent, "seed"),
    ("learning.training_rows", Descent, "rows"),
    ("learning.calibration_fraction", GateRules, "held_back"),
    ("learning.gate_calibration_method", GateRules, "method"),
    ("learning.gate_calibration_folds", GateRules, "folds"),
    ("learning.gate_target_recall", GateRules, "recall"),
    ("learning.gate_threshold_bootstrap_samples", GateRules, "resamples"),
    ("learning.gate_threshold_quantile", GateRules, "quantile"),
    ("learning.reader_gain_weight", Worth, "reader"),
    ("learning.token_cost_weight", Worth, "tokens"),
    ("learning.hop_cost_weight", Worth, "hops"),
    ("learning.noise_cost_weight", Worth, "noise"),
    ("evaluation.include_classic_baselines", Report, "classic"),
    ("evaluation.include_oracle_upper_bound", Report, "oracle"),
    ("evaluation.bootstrap_samples", Report, "resamples"),
    ("evaluation.resume_checkpoint", Report, "resume"),
    ("evaluation.batch_questions", Report, "batch_questions"),
)
REQUIRED = ("corpus_path", "train_queries_path", "eval_queries_path")
# Keys of other implementations that ask for nothing here (caches, model servers, progress).
WITHOUT_EFFECT = ("cache_dir", "evaluation.latency_percentiles", "evaluation.progress_every", "ollama")


class Settings:
    """``settings[Owner]`` gives the parameters of an owner."""

    def __init__(self, **values: Any):
        """``values`` by key, with ``__`` for the dot."""
        self._set({key.replace("__", "."): value for key, value in values.items()})

    def _set(self, values: dict[str, Any]) -> None:
        known = {key: (owner, name) for key, owner, name in TABLE}
        unknown = sorted(key for key in values if key not in known)
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        given: dict[type, dict[str, Any]] = {owner: {} for _, owner, _ in TABLE}
        for key, value in values.items():
            owner, name = known[key]
            default = next(f.default for f in fields(owner) if f.name == name)
            if isinstance(default, str):
                value = "" if value is None else str(value)
            elif isinstance(default, bool) != isinstance(value, bool) or not isinstance(value, (int, float)):
                raise ValueError(f"setting {key} must be like {default!r}")
            given[owner][name] = value
        self._owners = {owner: owner(**found) for owner, found in given.items()}

    def __getitem__(self, owner: type) -> Any:
        return self._owners[owner]

    @classmethod
    def from_dict(cls, values: dict[str, Any]) -> Settings:
        flat: dict[str, Any] = {}
        for key, value in values.items():
            if key in WITHOUT_EFFECT:
                continue
            if isinstance(value, dict):
                flat |= {f"{key}.{inner}": v for inner, v in value.items()}
            else:
                flat[key] = value
        flat = {key: value for key, value in flat.items() if key not in WITHOUT_EFFECT}
        missing = [key for key in REQUIRED if not flat.get(key)]
        if missing:
            raise ValueError(f"setting missing: {', '.join(missing)}")
        settings = cls()
        settings._set(flat)
        return settings

    @classmethod
    def load(cls, path: str) -> Settings:
        return cls.from_dict(json.loads(Path(path).read_text(encoding="utf-8")))

    def flat(self) -> dict[str, Any]:
        """Every key with its value."""
        return {key: getattr(self[owner], name) for key, owner, name in TABLE}
