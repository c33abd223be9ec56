"""Option dataclasses shared by the operators. Values are checked on construction."""

from __future__ import annotations

from dataclasses import dataclass, field


def _no_repeats(name: str, values: tuple[str, ...]) -> None:
    if len(set(values)) != len(values):
        raise ValueError(f"{name} lists a column twice: {sorted(values)}")


@dataclass(frozen=True)
class DatasetOptions:
    """Column contract of a training table."""

    target: str
    positive_class: str = "Yes"
    renames: dict[str, str] = field(default_factory=dict)
    id_columns: tuple[str, ...] = ()
    drop_columns: tuple[str, ...] = ()
    required_columns: tuple[str, ...] = ()
    numeric_features: tuple[str, ...] = ()
    categorical_features: tuple[str, ...] = ()
    numeric_coercion_columns: tuple[str, ...] = ()
    na_values: tuple[str, ...] = ()
    infer_remaining_features: bool = False

    def __post_init__(self) -> None:
        for name in (
            "id_columns",
            "drop_columns",
            "required_columns",
            "numeric_features",
            "categorical_features",
            "numeric_coercion_columns",
        ):
            _no_repeats(name, tuple(getattr(self, name)))

    def sections(self) -> dict[str, tuple[str, ...]]:
        """Column lists that must exist in the table, by section name."""
        return {
            "data.required_columns": tuple(self.required_columns),
            "data.id_columns": tuple(self.id_columns),
            "data.drop_columns": tuple(self.drop_columns),
            "data.numeric_features": tuple(self.numeric_features),
            "data.categorical_features": tuple(self.categorical_features),
            "data.numeric_coercion_columns": tuple(self.numeric_coercion_columns),
        }


@dataclass(frozen=True)
class FeatureSpec:
    """Numeric and categorical feature names, in model order."""

    numeric: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()

    @property
    def all(self) -> tuple[str, ...]:
        return (*self.numeric, *self.categorical)


@dataclass(frozen=True)
class SplitOptions:
    test_size: float = 0.2
    validation_size: float = 0.1
    seed: int = 42

    def __post_init__(self) -> None:
        if not 0 < self.test_size < 1:
            raise ValueError("test_size must lie strictly between 0 and 1")
        if not 0 <= self.validation_size < 1:
            raise ValueError("validation_size must lie in [0, 1)")
        if self.test_size + self.validation_size >= 1:
            raise ValueError("test_size and validation_size must leave rows for training")


@dataclass(frozen=True)
class ModelOptions:
    name: str = "logistic_regression"
    C: float = 1.0
    balanced: bool = True
    max_iter: int = 1000
    tol: float = 1e-8
    decision_threshold: float = 0.5
    solver: str = "lbfgs"

    def __post_init__(self) -> None:
        if self.name != "logistic_regression":
            raise ValueError("only 'logistic_regression' is supported as model name")
        if self.C <= 0:
            raise ValueError("C must be positive")
        if self.solver not in ("lbfgs", "newton"):
            raise ValueError("solver must be 'lbfgs' or 'newton'")
        if not 0 <= self.decision_threshold <= 1:
            raise ValueError("decision_threshold must lie in [0, 1]")


@dataclass(frozen=True)
class DriftOptions:
    window_size: int = 200
    min_samples: int = 100
    numeric_bin_count: int = 10
    categorical_top_k: int = 10
    warning_threshold: float = 0.1
    drift_threshold: float = 0.25
    min_drifted_features: int = 2
    enabled: bool = True

    def __post_init__(self) -> None:
        if self.min_samples < 1 or self.window_size < self.min_samples:
            raise ValueError("window_size must be at least min_samples, and both positive")
        if self.numeric_bin_count < 1 or self.categorical_top_k < 1:
            raise ValueError("numeric_bin_count and categorical_top_k must be at least 1")
        if not 0 <= self.warning_threshold <= self.drift_threshold:
            raise ValueError("warning_threshold must not exceed drift_threshold")
        if self.min_drifted_features < 1:
            raise ValueError("min_drifted_features must be at least 1")


@dataclass(frozen=True)
class RetrainingOptions:
    enabled: bool = True
    backend: str = "request_table"
    workflow_id: str | None = "model_training"
    cooldown_minutes: int = 240

    def __post_init__(self) -> None:
        if self.cooldown_minutes < 0:
            raise ValueError("cooldown_minutes must not be negative")


@dataclass(frozen=True)
class RegistryOptions:
    enabled: bool = True
    metric: str = "f1"
    split: str = "validation"
    greater_is_better: bool = True
    alias: str | None = None
