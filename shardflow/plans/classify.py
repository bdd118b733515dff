"""The class of a move between two layouts; decided on the driver before a plan is built."""

from __future__ import annotations

from enum import Enum

from shardflow.layout import Sharding


class Move(str, Enum):
    POINT_TO_POINT = "point_to_point"
    SCATTER_GATHER = "scatter_gather"
    GATHER = "gather"
    SCATTER = "scatter"
    BROADCAST = "broadcast"
    PARTIAL_TO_REPLICATED = "partial_to_replicated"
    NO_OP = "no_op"
    UNSUPPORTED = "unsupported"


class UnsupportedReshard(ValueError):
    """A move that has no strategy of its own; ``reshard`` does it anyway unless it is strict."""


def split_dim(src: Sharding) -> int | None:
    """The dimension along which replicas can share the sending of their tile: the first that divides."""
    return next((k for k in src.real if src.dims[k].size % (src.dims[k].sharding * src.replicas) == 0), None)


def classify(src: Sharding, dst: Sharding, device: int | None = None) -> Move:
    """The class of a move; for a device that has no part in a move between replicas it is a no-op."""
    to_one, from_one = dst.replicated, src.replicated
    if src.fully_sharded and to_one:
        return Move.GATHER
    if dst.fully_sharded and from_one:
        return Move.SCATTER
    if from_one and to_one:
        if src.devices.n < dst.devices.n:
            return Move.BROADCAST
        idle = device is not None and device not in dst.devices and (src.devices.shard_id(device) is None or src.devices.shard_id(device) >= dst.devices.n)
        return Move.NO_OP if idle else Move.POINT_TO_POINT
    if src.partially_replicated and to_one:
        return Move.PARTIAL_TO_REPLICATED if split_dim(src) is not None else Move.UNSUPPORTED
    if len(src.dims) != len(dst.dims):
        return Move.UNSUPPORTED
    differ = sum(a != b for a, b in zip(src.dims, dst.dims, strict=True))
    if differ == 0 and src.devices.n == dst.devices.n:
        return Move.POINT_TO_POINT
    return Move.SCATTER_GATHER if differ == 1 else Move.UNSUPPORTED
