"""Methods and their hyperparameters by stage and name, and the parsing of hyperparameters given as text."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Param:
    name: str
    kind: str  # str, int, float, bool, csv_int, json
    default: Any = None
    required: bool = False
    advanced: bool = False


@dataclass(frozen=True)
class Method:
    key: str
    stage: str
    about: str
    params: tuple[Param, ...] = field(default=())


def _methods(*methods: Method) -> dict[str, dict[str, Method]]:
    out: dict[str, dict[str, Method]] = {}
    for m in methods:
        out.setdefault(m.stage, {})[m.key] = m
    return out


_PAIRS = (Param("block_size", "int", 2048), Param("r_min", "float"), Param("clamp_negative", "bool", False))
_CLUSTERS = (Param("n_clusters", "int", required=True), Param("random_state", "int", 42), Param("kmeans_nstart", "int", 10, advanced=True), Param("kmeans_itermax", "int", 100, advanced=True))

METHODS = _methods(
    Method("none", "preprocess", "series as they are"),
    Method("gaussian_smoothing", "preprocess", "Gaussian smoothing along time", (Param("fwhm_samples", "float", 3.0, required=True), Param("truncate", "float", 3.0, advanced=True), Param("n_jobs", "int", -1), Param("chunk_size", "int", 20000, advanced=True), Param("edge_mode", "str", "mirror", advanced=True))),
    Method("bspline", "preprocess", "penalised B-spline coefficients", (Param("interior", "int", 60), Param("order", "int", 4), Param("penalty", "float", 1e-8), Param("penalised", "int", 2, advanced=True))),
    Method("fpca", "preprocess", "functional principal component loadings", (Param("components", "int", 60), Param("center", "bool", False), Param("scale", "bool", False))),
    Method("none", "similarity", "no graph"),
    Method("correlation", "similarity", "Pearson over all pairs", (*_PAIRS, Param("chunk_size", "int"), Param("n_jobs", "int"), Param("prestandardized", "bool", False, advanced=True))),
    Method("cosine", "similarity", "cosine over all pairs", _PAIRS),
    Method("l2", "similarity", "L2 distance over all pairs as a weight", (*_PAIRS, Param("sigma", "float"), Param("shape", "str", "rbf"))),
    Method("srvf", "similarity", "square-root velocity distance over all pairs as a weight", (*_PAIRS, Param("sigma", "float"), Param("shape", "str", "rbf"))),
    Method("partial", "similarity", "ridge partial correlation over all pairs", (*_PAIRS, Param("ridge", "float", 1.0))),
    Method("correlation26", "similarity", "Pearson between 26-neighbours", (Param("r_min", "float"), Param("clamp_negative", "str", "auto"))),
    Method("cosine26", "similarity", "cosine between 26-neighbours", (Param("r_min", "float"), Param("standardized", "bool", False))),
    Method("l2_26", "similarity", "L2 distance between 26-neighbours as a weight", (Param("kernel", "str", "rbf"), Param("scale", "float"), Param("r_min", "float"), Param("standardized", "bool", True))),
    Method("srvf26", "similarity", "square-root velocity distance between 26-neighbours", (Param("warp", "str", "none"), Param("kernel", "str", "rbf"), Param("scale", "float"), Param("smooth", "bool", False), Param("r_min", "float"))),
    Method("partial26", "similarity", "ridge partial correlation between 26-neighbours", (Param("ridge", "float", 1.0), Param("prestandardized", "bool", True), Param("r_min", "float"))),
    Method("spectral", "clustering", "normalised-cut spectral clustering", (*_CLUSTERS, Param("remove_isolated", "bool", True), Param("enforce_nonnegative", "bool", True, advanced=True), Param("eig_solver", "str", "auto", advanced=True), Param("randomized_oversample", "int", 20, advanced=True), Param("randomized_n_iter", "int", 2, advanced=True), Param("randomized_switch_n_nodes", "int", 15000, advanced=True))),
    Method("greedy_modularity", "clustering", "greedy modularity, cut at n_clusters or at its best", (Param("n_clusters", "int"), Param("top_k", "int", 200))),
    Method("silhouette", "report", "cluster silhouettes", (Param("unassigned_labels", "csv_int", (-1, 0)),)),
    Method("clusters_3d", "visualization", "rows of a 3-D scatter", (Param("include_unassigned", "bool", True), Param("unassigned_labels", "csv_int", (-1, 0)), Param("subject_id", "int"))),
)


#: Users' similarities by name: a function of the voxel table and the hyperparameters.
KERNELS: dict[str, Callable[..., Any]] = {}


def register_kernel(key: str, kernel: Callable[..., Any], about: str = "", params: tuple[Param, ...] = ()) -> None:
    """Make kernel(voxels, **hyperparameters), which gives subject_id, i_idx, j_idx, w, a similarity method of this name."""
    if key in METHODS["similarity"] and key not in KERNELS:
        raise ValueError(f"{key} is a built-in similarity")
    METHODS["similarity"][key] = Method(key, "similarity", about, params)
    KERNELS[key] = kernel


def get_method(stage: str, key: str) -> Method:
    try:
        return METHODS[stage][key]
    except KeyError:
        raise ValueError(f"no {stage} method {key}") from None


def choices(stage: str) -> list[str]:
    if stage not in METHODS:
        raise ValueError(f"no stage {stage}")
    return list(METHODS[stage])


def cast(value: Any, kind: str) -> Any:
    """Text or a value as kind; empty text is None."""
    if value is None or isinstance(value, str) and not value.strip():
        return None
    if kind == "int":
        return int(value)
    if kind == "float":
        return float(value)
    if kind == "bool":
        return value.strip().lower() in ("1", "true", "yes", "on") if isinstance(value, str) else bool(value)
    if kind == "csv_int":
        return tuple(int(x) for x in value.split(",") if x.strip()) if isinstance(value, str) else tuple(int(x) for x in value)
    if kind == "json":
        return json.loads(value) if isinstance(value, str) else value
    return str(value)


def parse(method: Method, values: dict | list | None = None) -> dict:
    """Defaults, then values by name or in the order of the parameters; unknown names and missing required ones are refused. A
    False given by position alone (an untouched box) doesn't undo a default True."""
    out = {p.name: p.default for p in method.params}
    if isinstance(values, dict):
        if unknown := set(values) - set(out):
            raise TypeError(f"unknown hyperparameters of {method.key}: {sorted(unknown)}")
        given = values.items()
    else:
        given = [(p.name, v) for p, v in zip(method.params, values or []) if not (p.kind == "bool" and p.default is True and v is False)]
    kinds = {p.name: p.kind for p in method.params}
    for name, value in given:
        value = cast(value, kinds[name])
        if value is not None:
            out[name] = value
    if missing := [p.name for p in method.params if p.required and out[p.name] is None]:
        raise ValueError(f"{method.key} needs {', '.join(missing)}")
    return out
