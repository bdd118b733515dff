"""The queries of the array library over the tables, each with the SQL that must give the same rows."""

from shardflow.catalogue import blocks, layouts, stores
from shardflow.catalogue.arrays import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "blocks", "layouts", "stores"]
