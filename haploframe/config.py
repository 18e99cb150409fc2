"""Settings of the imputation model and its pipeline."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Log value that stands for zero, in likelihoods and as the first term of every log-sum.
LOG_ZERO = -999.0
#: A missing allele at the edges where numbers are needed; NULL elsewhere.
MISSING = 255
AS_IMPLEMENTED, DOCUMENTED = "as_implemented", "documented"


class ImputationError(ValueError):
    """Input that can't be imputed."""


@dataclass(frozen=True)
class HMMParameters:
    theta: float = 0.001
    rho_rate: float = 4.0
    ne: int = 10000
    num_states: int = 8
    use_pbwt_selection: bool = True


@dataclass(frozen=True)
class ImputationConfig:
    hmm: HMMParameters = field(default_factory=HMMParameters)
    mode: str = AS_IMPLEMENTED
    selector: str = "auto"
    deterministic: bool = False
    seed: int = 12345
    strict_markers: bool = False
    region: str = ""
    #: Markers of one step of forward-backward; longer sequences go window by window. 0: all at once.
    window_size: int = 10000
    output_dosages: bool = False
    output_probabilities: bool = False

    def __post_init__(self):
        if not 1 <= self.hmm.num_states:
            raise ImputationError("at least one state is needed")
        if self.mode not in (AS_IMPLEMENTED, DOCUMENTED):
            raise ImputationError(f"no mode {self.mode!r}")
