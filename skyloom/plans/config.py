"""Settings of a map-making run: defaults, parameter file, precedence and checks."""

from __future__ import annotations

import dataclasses
import re
from dataclasses import dataclass

from skyloom.operators.solver import Templates

#: Names that parameter files may use for the settings here; those of None mean nothing on Spark.
ALIASES = {
    "Lambda": "bandwidth", "Z_2lvl": "z_2lvl", "enlFac": "enlarge", "bs_red": "block_reduction", "polybaseline_length": "poly_baseline", "hwpssbaseline_length": "plate_baseline",
    "ptcomm_flag": None, "mcmode": None,
}
_LINE = re.compile(r"^\s*([A-Za-z_]\w*)\s*=\s*(.*?)\s*(?:#.*)?$")


@dataclass
class Config:
    path_output: str = ""
    ref: str = ""
    nside: int = 64
    nnz: int = 3
    map_maker: str = "ML"
    solver: int = 0
    bandwidth: int = 16384
    tol: float = 1e-6
    maxiter: int = 3000
    enlarge: int = 1
    block_reduction: bool = False
    ortho_alg: int = 1
    precond: int = 0
    z_2lvl: int = 0
    fsample: float = 0.0
    apodise: str = "chebwin"
    npoly: int = 0
    nhwp: int = 0
    sss: bool = False
    sbins: int = 0
    poly_baseline: float = 10.0
    plate_baseline: float = 10.0
    sweeps_from_flags: bool = False
    uniform_w: bool = False
    noiseless: bool = False
    remove_mean: bool = True
    shared_mask: int = 1
    det_mask: int = 1
    signal_fraction: float = 1.0
    downscale: float = 1.0
    rcond_cut: float = 0.1
    coordinates: str = "C"
    limit_det: int = 0
    product: str = "auto"
    fft_size: str = "cost"

    def products(self) -> dict:
        """How products with the noise's bands are made: ``auto`` by cost, or direct, fft, full; the transforms' length, or the rule for it."""
        return {"method": self.product, "fft_size": int(self.fft_size) if str(self.fft_size).isdigit() else self.fft_size}

    def checked(self) -> Config:
        if not self.path_output or not self.ref:
            raise ValueError("path_output and ref are required")
        if self.nnz != 3:
            raise ValueError("nnz must be 3")
        if self.map_maker not in ("ML", "MT"):
            raise ValueError("map_maker is ML or MT")
        if self.nside < 1 or self.nside & (self.nside - 1):
            raise ValueError("nside must be a power of two")
        if self.precond not in (0, 1, 2):
            raise ValueError("precond is 0, 1 or 2")
        if self.map_maker == "MT" and self.solver != 0:
            raise ValueError("templates need solver 0")
        if self.product not in ("auto", "direct", "fft", "full") or not (self.fft_size in ("band", "fixed", "cost") or str(self.fft_size).isdigit()):
            raise ValueError("product is auto, direct, fft or full, and fft_size band, fixed, cost or a length")
        if self.shared_mask < 0 or self.det_mask < 0:
            raise ValueError("flag masks can't be negative")
        diagonal = self.noiseless or self.uniform_w or self.map_maker == "MT"
        return dataclasses.replace(self, bandwidth=1) if diagonal else self

    def templates(self) -> Templates:
        return Templates(self.npoly, self.sbins if self.sss else 0, self.nhwp, max(1, int(self.plate_baseline * self.fsample)))


def read_parameters(text: str) -> dict[str, str]:
    """``key = value`` lines; # begins a comment."""
    out = {}
    for line in text.splitlines():
        if (m := _LINE.match(line)) and not line.lstrip().startswith("#"):
            out[m[1]] = m[2]
    return out


def _typed(name: str, value):
    kind = type(getattr(Config(), name))
    if isinstance(value, str) and kind is bool:
        return value.strip().lower() in ("1", "true", "yes", "t")
    return kind(value)


def _own_names(given: dict) -> dict:
    out = {}
    for name, value in given.items():
        if name == "fixed_polybase":  # baselines of a fixed length, or else sweeps by their flags
            out["sweeps_from_flags"] = not _typed("sweeps_from_flags", value)
        elif (own := ALIASES.get(name, name)) is not None:
            out[own] = value
    return out


def build(file: str = "", traits: dict | None = None, params: dict | None = None) -> Config:
    """Traits overwrite the file, params overwrite traits."""
    merged = _own_names(read_parameters(file)) | _own_names(traits or {}) | _own_names(params or {})
    known = {f.name for f in dataclasses.fields(Config)}
    if unknown := set(merged) - known:
        raise ValueError(f"unknown parameters: {', '.join(sorted(unknown))}")
    return Config(**{k: _typed(k, v) for k, v in merged.items()}).checked()


def as_toml(config: Config) -> str:
    """The effective parameters."""
    show = lambda v: str(v).lower() if isinstance(v, bool) else f'"{v}"' if isinstance(v, str) else repr(v)
    return "".join(f"{f.name} = {show(getattr(config, f.name))}\n" for f in dataclasses.fields(config))
