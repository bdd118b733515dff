"""Operators on sharded arrays."""

from shardflow.operators.array import ArrayCache, ShardedArray
from shardflow.operators.blocks import BlockedArray, matmul, matmul_kernel
from shardflow.operators.reshard import reshard, reshard_to

__all__ = ["ArrayCache", "BlockedArray", "ShardedArray", "matmul", "matmul_kernel", "reshard", "reshard_to"]
