"""Configuration of builds and audits, and the rules that couple settings."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace
from typing import Literal, get_args

# The named setting that the published experiments use.
PERIODS = {"November 2013": (1383284733, 1383861599)}
REGIONS = {"Milano": (9.07954122975, 9.27899377165, 45.394252415050005, 45.541507186800004)}  # min lon, max lon, min lat, max lat


# The names by which settings are chosen.
Mode = Literal["reference_prior", "marginal_prior"]
Classifier = Literal["LR", "RF", "MLP"]
Activity = Literal["constant", "true", "lognormal", "exp", "powerlaw"]
PartialTrace = Literal["random", "time_and_top_k_locations", "only_rois_greedy", "only_rois_top_k_locations"]


def period(name: str) -> tuple[int, int]:
    if name not in PERIODS:
        raise ValueError(f"unknown period {name!r}; known: {sorted(PERIODS)}")
    return PERIODS[name]


def region(name: str) -> tuple[float, float, float, float]:
    if name not in REGIONS:
        raise ValueError(f"unknown region {name!r}; known: {sorted(REGIONS)}")
    return REGIONS[name]


def to_bool(text: str | bool) -> bool:
    """Exactly 'True' or 'False', or a boolean."""
    if isinstance(text, bool):
        return text
    if text not in ("True", "False"):
        raise ValueError(f"expected True or False, not {text!r}")
    return text == "True"


@dataclass(frozen=True)
class BuildConfig:
    """Building a bundle of aggregates from traces."""

    group_size: int = 1000
    n_targets: int = 50
    min_visits: int = 10
    reference_size: int = 2500
    train: int = 400
    test: int = 100
    validation: int = 100
    seed: int = 42

    def __post_init__(self) -> None:
        for name in ("train", "test", "validation"):
            if getattr(self, name) % 2:
                raise ValueError(f"{name} must be even: half of the groups have the target")
        if self.reference_size < self.group_size:
            raise ValueError("groups of the reference cannot be larger than it is")


@dataclass(frozen=True)
class AuditConfig:
    """Auditing a bundle. Use `coupled()` for the settings that follow from others."""

    mode: Mode = "reference_prior"
    dataset: str = ""
    experiment: str | None = None
    seed: int = 2023
    group_size: int = 1000
    n_targets: int | None = None
    n_groups: int = 100
    train_size: int = 400
    validation_size: int = 100
    paired: bool = True
    suppress: int = 0
    dp_eps: float | None = None
    dp_sens: int | None = None
    classifier: Classifier = "LR"
    lr_max_iter: int = 100
    lr_tol: float = 1e-4
    lr_c: float = 1.0
    rf_trees: int | None = 100
    rf_depth: int | None = 5
    scaler: Literal["Standard", "MinMax"] | None = "Standard"
    pca: float = 0.0
    reuse_synthetic: bool = False
    reuse_from: Literal["first", "random"] = "first"
    n_synthetic: int = 5000
    cluster_size: int = 10
    activity: Activity = "exp"
    log_compression: bool = False
    power_transform: bool = False
    true_mean: bool = False
    skew: float = 3.0
    partial: PartialTrace | None = None
    partial_fraction: float | None = 1.0
    top_k: int | None = None
    squash: bool = False

    def __post_init__(self) -> None:
        for name, kind in (("mode", Mode), ("classifier", Classifier), ("activity", Activity), ("partial", PartialTrace)):
            if (value := getattr(self, name)) not in get_args(kind) and not (value is None and name == "partial"):
                raise ValueError(f"unknown {name} {value!r}")
        for name in ("n_groups", "train_size", "validation_size"):
            if getattr(self, name) % 2:
                raise ValueError(f"{name} must be even: half of the groups have the target")
        if self.partial in ("time_and_top_k_locations", "only_rois_top_k_locations") and not self.top_k:
            raise ValueError(f"{self.partial} needs top_k")
        if self.activity == "true" and not self.true_mean:
            raise ValueError("users' own numbers of visits are known only together with their mean: set true_mean")
        if not 0 <= self.pca < 1:
            raise ValueError("pca is a share of the variance, 0 for none")
        if self.suppress < 0:
            raise ValueError("the suppression threshold cannot be negative")

    @property
    def noisy(self) -> bool:
        """Noise needs both a budget and a sensitivity."""
        return self.dp_eps is not None and self.dp_sens is not None

    @property
    def raw(self) -> bool:
        return self.suppress == 0 and not self.noisy

    def coupled(self) -> AuditConfig:
        """Suppression without noise compresses marginals, noise denoises them; settings without effect are emptied."""
        changed: dict[str, object] = {"log_compression": self.suppress > 0 and self.dp_eps is None}
        if self.dp_eps is not None:
            changed["power_transform"] = True
        if self.partial is None:
            changed |= {"partial_fraction": None, "top_k": None}
        if self.classifier != "RF":
            changed |= {"rf_trees": None, "rf_depth": None}
        return replace(self, **changed)

    def row(self) -> dict[str, str]:
        """The settings as strings, for run metadata."""
        return {k: str(v) for k, v in asdict(self).items()}

    def tag(self) -> str:
        """A short name of the run, as files used to be named by."""
        parts = [self.mode, self.dataset, f"m{self.group_size}", f"k{self.suppress}"]
        if self.noisy:
            parts.append(f"eps{self.dp_eps:g}_sens{self.dp_sens}")
        if self.partial:
            parts.append(f"{self.partial}_{self.partial_fraction if self.top_k is None else self.top_k}")
        return "_".join(p for p in [*parts, self.classifier, self.experiment or ""] if p)


#: The published sweeps.
SWEEPS: dict[str, list[dict[str, object]]] = {
    "suppression": [{"suppress": k} for k in range(6)],
    "event_dp": [{"dp_eps": e, "dp_sens": 1} for e in (0.1, 0.5, 1.0, 5.0, 10.0)],
    "user_day_dp": [{"dp_eps": e, "dp_sens": 10} for e in (0.1, 0.5, 1.0, 5.0, 10.0)],
    "partial_trace": [{"partial": "random", "partial_fraction": f, "dp_eps": 1.0, "dp_sens": 1, "suppress": 1} for f in (0.1, 0.25, 0.5, 0.75, 1.0)],
}


def sweep(base: AuditConfig, name: str) -> list[AuditConfig]:
    return [replace(base, **change).coupled() for change in SWEEPS[name]]
