"""Device lists: contiguous half-open ranges of logical device ids."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class DeviceList:
    start: int
    n: int

    def __post_init__(self):
        if self.n < 0:
            raise ValueError("a device list can't have a negative size")

    @property
    def stop(self) -> int:
        return self.start + self.n

    @property
    def empty(self) -> bool:
        return self.n == 0

    def __len__(self) -> int:
        return self.n

    def __iter__(self) -> Iterator[int]:
        return iter(range(self.start, self.stop))

    def __getitem__(self, k: int) -> int:
        if not 0 <= k < self.n:
            raise IndexError(k)
        return self.start + k

    def __contains__(self, other: int | DeviceList) -> bool:
        if isinstance(other, DeviceList):
            return self.start <= other.start and other.stop <= self.stop
        return self.start <= other < self.stop

    def slice(self, begin: int, n: int) -> DeviceList:
        if begin < 0 or n < 0 or begin + n > self.n:
            raise IndexError((begin, n))
        return DeviceList(self.start + begin, n)

    def shard_id(self, device: int) -> int | None:
        return device - self.start if device in self else None

    def contains_column(self, device: Column) -> Column:
        """Whether a device column is in the list: the mask of a gang."""
        return (device >= self.start) & (device < self.stop)

    def shard_column(self, device: Column) -> Column:
        """The shard of a device column, null outside the list."""
        return F.when(self.contains_column(device), device - self.start)
