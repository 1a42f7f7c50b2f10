"""Run configuration: typed sections and a strict YAML reader."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass, replace

from poseweave.operators.residuals import Hallucination, Normals, ProblemOptions, Weights
from poseweave.plans.solve import SolverOptions

CHOICES = {
    "mode": ("batch", "incremental"),
    "normals.method": ("pca", "hybrid", "weighted"),
    "solver.backend": ("lm", "ceres"),
    "solver.linear_solver": ("eigen", "cholmod"),
}


@dataclass(frozen=True)
class MapOptions:
    nx: int = 100
    ny: int = 100
    min: tuple[float, float] = (-25.0, -25.0)
    max: tuple[float, float] = (25.0, 25.0)
    auto_domain: bool = False
    auto_domain_margin: float = 5.0
    initial_value: float = 0.0
    init_from_scans: bool = False
    init_signed: bool = True


@dataclass(frozen=True)
class RunConfig:
    dataset_dir: str
    ground_truth_poses: str = ""
    initial_poses: str = ""
    relations_file: str = ""
    output_dir: str = "out"
    mode: str = "batch"
    increment_size: int = 1
    iterations_per_increment: int = 10
    snapshot_every: int = 0
    map: MapOptions = field(default_factory=MapOptions)
    problem: ProblemOptions = field(default_factory=ProblemOptions)
    solver: SolverOptions = field(default_factory=SolverOptions)


SECTIONS = {"map": MapOptions, "weights": Weights, "hallucination": Hallucination, "normals": Normals, "solver": SolverOptions}
# Options of the problem that are spelled at the top level of a file.
FLAT_PROBLEM = ("huber_delta", "smooth_gradient", "smooth_gradient_step", "active_region", "active_margin")


def _typed(kind, value, name: str):
    if name in CHOICES and value not in CHOICES[name]:
        raise ValueError(f"unknown {name} {value!r}")
    default = kind
    if isinstance(default, bool):
        if not isinstance(value, bool):
            raise ValueError(f"{name} must be true or false")
        return value
    if isinstance(default, tuple):
        return tuple(float(v) for v in value[:2])
    return type(default)(value)


def _section(kind, given: dict | None, scope: str):
    base = kind()
    known = {f.name for f in fields(kind) if not is_dataclass(getattr(base, f.name))}
    for key in given or {}:
        if key not in known:
            raise ValueError(f"the configuration has no setting {scope}.{key}")
    return replace(base, **{k: _typed(getattr(base, k), v, f"{scope}.{k}") for k, v in (given or {}).items()})


def parse_config(tree: dict) -> RunConfig:
    """A run configuration from a parsed YAML tree; unknown keys and values raise."""
    plain = {f.name for f in fields(RunConfig)} - {"map", "problem", "solver"}
    for key in tree:
        if key not in plain and key not in SECTIONS and key not in FLAT_PROBLEM:
            raise ValueError(f"the configuration has no setting {key}")
    if "dataset_dir" not in tree:
        raise ValueError("the configuration names no dataset_dir")
    parts = {name: _section(kind, tree.get(name), name) for name, kind in SECTIONS.items()}
    base = RunConfig(dataset_dir=str(tree["dataset_dir"]))
    options = base.problem
    problem = replace(options, weights=parts["weights"], hallucination=parts["hallucination"], normals=parts["normals"],
                      **{k: _typed(getattr(options, k), tree[k], k) for k in FLAT_PROBLEM if k in tree})
    return replace(base, map=parts["map"], problem=problem, solver=parts["solver"],
                   **{k: _typed(getattr(base, k), tree[k], k) for k in plain if k in tree and k != "dataset_dir"})


def load_config(path: str) -> RunConfig:
    import yaml

    with open(path) as handle:
        return parse_config(yaml.safe_load(handle) or {})


def jittered(config: RunConfig, output_dir: str, relative_jitter: float) -> RunConfig:
    """The same run with λ scaled by 1 + jitter and its own output folder."""
    solver = replace(config.solver, lambda_init=config.solver.lambda_init * (1.0 + relative_jitter))
    return replace(config, solver=solver, output_dir=output_dir)
