"""How an array is split over devices.

A dimension has a global size, a number of pieces and a place in the order of devices (0 is the slowest).  A
dimension of size 1 with more than one piece is a replica dimension: its pieces are copies.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import prod

from shardflow.mesh import DeviceList
from shardflow.types import width


@dataclass(frozen=True)
class Dim:
    size: int
    sharding: int = 1
    permutation: int = 0

    @property
    def replica(self) -> bool:
        return self.size == 1 and self.sharding > 1

    @property
    def extent(self) -> int:
        return self.size // self.sharding

    @property
    def tail(self) -> int:
        """How many places lie behind the last piece."""
        return self.size % self.sharding


@dataclass(frozen=True)
class Sharding:
    """With ``tails`` sizes needn't divide: tiles are whole pieces, the array keeps what lies behind the last of them (less
    than a cell for each piece), and no shard holds it.  Without, such sizes are rejected."""

    dims: tuple[Dim, ...]
    devices: DeviceList
    tails: bool = False

    @classmethod
    def of(cls, text: str, start: int = 0, n: int | None = None, tails: bool = False) -> Sharding:
        """From text such as ``8/2@0, 1/4@1`` (size, pieces, place); devices default to one a piece."""
        dims = []
        for part in text.split(","):
            body, _, place = part.strip().partition("@")
            size, _, pieces = body.partition("/")
            dims.append(Dim(int(size), int(pieces or 1), int(place or 0)))
        return cls(tuple(dims), DeviceList(start, n if n is not None else prod(d.sharding for d in dims)), tails)

    # predicates

    @property
    def total_sharding(self) -> int:
        return prod(d.sharding for d in self.dims if d.size > 1)

    @property
    def num_real_dims(self) -> int:
        return len(self.dims) - any(d.size < d.sharding for d in self.dims)

    @property
    def num_local_elements(self) -> int:
        return prod(d.extent for d in self.dims if d.size > 1)

    @property
    def full_dimension_product(self) -> int:
        return prod(d.size for d in self.dims)

    @property
    def partially_replicated(self) -> bool:
        return 1 < self.total_sharding < self.devices.n

    @property
    def fully_sharded(self) -> bool:
        return self.total_sharding == self.devices.n

    @property
    def replicated(self) -> bool:
        return self.total_sharding == 1

    @property
    def shards(self) -> int:
        return prod(d.sharding for d in self.dims)

    @property
    def replicas(self) -> int:
        return prod(d.sharding for d in self.dims if d.replica)

    @property
    def real(self) -> tuple[int, ...]:
        """Places of the dimensions that cells have."""
        return tuple(k for k, d in enumerate(self.dims) if not d.replica)

    def shard_bytes(self, dtype: str) -> int:
        return self.num_local_elements * width(dtype)

    def short(self, dtype: str) -> str:
        return f"TYPE={dtype} [ {' '.join(str(d.size) for d in self.dims)} ] % [ {' '.join(str(d.sharding) for d in self.dims)} ]"

    def stride(self, dim: int) -> int:
        """How far shards are apart that differ by one in a dimension."""
        order = sorted(range(len(self.dims)), key=lambda k: (self.dims[k].permutation, k))
        return prod(self.dims[k].sharding for k in order[order.index(dim) + 1 :])

    def validate(self) -> Sharding:
        """Pieces must be as many as devices, and sizes must divide unless tails may belong to no shard."""
        if self.shards != self.devices.n:
            raise ValueError(f"{self.shards} pieces on {self.devices.n} devices")
        for k in self.real:
            if self.dims[k].tail and not (self.tails and self.dims[k].extent):
                raise ValueError(f"size {self.dims[k].size} doesn't divide into {self.dims[k].sharding} pieces")
        if sorted(d.permutation for d in self.dims) != list(range(len(self.dims))) and any(d.permutation for d in self.dims):
            raise ValueError("places must be all different")
        return self
