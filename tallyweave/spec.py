"""Parameters of a frequency summary."""

from __future__ import annotations

from dataclasses import dataclass, replace

#: Columns of the IPv4 5-tuple, in the byte order of the packed key.
FLOW_KEY = ("src_ip", "dst_ip", "src_port", "dst_port", "proto")

# Defaults every summary is built with unless told otherwise.
DEFAULT_SEED = 0x2D31E867
DEFAULT_LAYER_SEED = 0xDEADBEEF
DEFAULT_ROW_SEEDS = (0x2D31E867, 0x6AD611C4, 0x00000000, 0xFFFFFFFF)

#: One hash split into 16-bit lanes, one lane per row. Families of 32-bit hashes take two, with the first two row seeds.
LANE_FAMILIES = ("xx", "fast", "md5", "jhash", "murmur3", "siphash", "xxhash64")
#: One 32-bit hash per row, each with its own seed.
ROW_FAMILIES = ("xx_rows", "xxhash32_rows", "fasthash32_rows", "md5_rows")


@dataclass(frozen=True)
class SketchSpec:
    """Shape, hashing and sampling of a summary.

    The number of cells is ``layers * rows * cols``. It is set here and does not
    depend on the data, which is what makes it safe to ship cells to every task.
    """

    keys: tuple[str, ...] = FLOW_KEY
    rows: int = 4
    cols: int = 512
    family: str = "xx"
    seed: int = DEFAULT_SEED
    row_seeds: tuple[int, ...] = DEFAULT_ROW_SEEDS
    layers: int = 1
    layer_seed: int = DEFAULT_LAYER_SEED
    heap_size: int = 15
    p: float = 1.0
    sample_seed: int = 1234

    def __post_init__(self) -> None:
        if self.family not in LANE_FAMILIES + ROW_FAMILIES:
            raise ValueError(f"unknown hash family {self.family!r}")
        if not self.keys:
            raise ValueError("at least one key column is needed")
        if self.cols < 1 or self.cols & (self.cols - 1):
            raise ValueError("cols must be a power of two")
        if self.cols > 1 << self.sign_bit:
            raise ValueError(f"cols must leave bit {self.sign_bit} free for the sign")
        lanes = len(self.row_seeds) if self.family in ROW_FAMILIES else 4
        if not 1 <= self.rows <= lanes:
            raise ValueError(f"rows must be between 1 and {lanes} for {self.family!r}")
        if not 1 <= self.layers <= 32:
            raise ValueError("layers must be between 1 and 32")
        if self.heap_size < 1:
            raise ValueError("heap_size must be positive")
        if not 0.0 < self.p <= 1.0:
            raise ValueError("p must be in (0, 1]")

    @property
    def sign_bit(self) -> int:
        """Hash bit that decides the sign of an update: +1 when set."""
        return 31 if self.family in ROW_FAMILIES else 15

    @property
    def layer_size(self) -> int:
        return self.rows * self.cols

    @property
    def cell_count(self) -> int:
        return self.layers * self.layer_size

    def with_(self, **changes) -> "SketchSpec":
        return replace(self, **changes)
