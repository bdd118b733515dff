"""Deferred dataflow on lazy DataFrames.

A future is a lazy DataFrame, a view is a snapshot, a store is a chain of versions.  DataFrames don't change, so a
reader of a version never waits for or sees later writes; what is left to keep is that each version is built on the
one before, which lineage does.  Spark schedules the work.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardflow.mesh import DeviceList
from shardflow.operators.array import ShardedArray


@dataclass(frozen=True)
class View:
    """What a store or future held when the view was taken; it can't be written."""

    df: DataFrame

    def view(self) -> View:
        return self


@dataclass
class Store:
    """A mutable cell of a DataFrame or an array: every write is a new version.

    A task that asks for a store to write (:func:`defer`) gets a child: its versions are the task's own until it ends,
    then the last of them becomes the parent's next version.  Children have children of their own.  While a child is
    open the store can't be read or written, and views taken before stay as they are.
    """

    versions: list[DataFrame] = field(default_factory=list)
    parent: Store | None = None
    #: For each version of the parent that a child made: the child's versions and those of its children.
    made_by: dict[int, Store] = field(default_factory=dict)
    writer: Store | None = None

    @classmethod
    def create(cls, df: DataFrame) -> Store:
        return cls([df])

    @property
    def df(self) -> DataFrame:
        if self.writer is not None:
            raise RuntimeError("a task still writes the store")
        if not self.versions:
            raise LookupError("the store is empty")
        return self.versions[-1]

    @property
    def version(self) -> int:
        return len(self.versions) - 1

    def view(self) -> View:
        return View(self.df)

    def write(self, change: Callable[[DataFrame], DataFrame]) -> Store:
        self.versions.append(change(self.df))
        return self

    def child(self) -> Store:
        """A store for one task to write, which begins with the current version."""
        self.writer = Store([self.df], self)
        return self.writer

    def close(self) -> None:
        """End a child: its last version is the parent's next, if it has written."""
        parent = self._ended()
        if self.version:
            parent.versions.append(self.df)
            parent.made_by[parent.version] = self

    def drop(self) -> None:
        """End a child, and its children, without a trace."""
        if self.writer is not None:
            self.writer.drop()
        self._ended()

    def _ended(self) -> Store:
        if self.parent is None or self.parent.writer is not self:
            raise RuntimeError("the store isn't open as a child")
        if self.writer is not None:
            raise RuntimeError("a task still writes the store")
        self.parent.writer = None
        return self.parent

    def tree(self) -> list[tuple[str, DataFrame]]:
        """All versions with their numbers: 2.1 is the first that the writer of version 2 made."""
        out = []
        for n, df in enumerate(self.versions):
            if n in self.made_by:
                out += [(f"{n}.{path}", x) for path, x in self.made_by[n].tree() if path != "0"]
            out.append((str(n), df))
        return out

    def checkpoint(self) -> Store:
        """Cut the lineage of a long chain: the current version is written to the shared checkpoint folder."""
        now = self.df
        self.versions[-1] = replace(now, cells=now.cells.checkpoint(), box=None) if isinstance(now, ShardedArray) else now.checkpoint()
        return self

    def wait(self) -> None:
        """Compute the current version."""
        now = self.df
        (now.cells if isinstance(now, ShardedArray) else now).write.format("noop").mode("overwrite").save()


class Writers(list):
    """Several stores for one task to write: their new versions appear together or not at all.

    ``durable``: they are computed and written to the shared checkpoint folder first, so that a version that can't be
    computed keeps the others from appearing, too."""

    def __init__(self, stores: list[Store], durable: bool = False):
        super().__init__(stores)
        self.durable = durable


@dataclass
class Token:
    """That a task without a result has ended: what it wrote (:meth:`wait` computes it), and no value."""

    written: list[Store] = field(default_factory=list)
    done: bool = False

    def wait(self) -> None:
        """Compute the versions that the task wrote, once."""
        if not self.done:
            for s in self.written:
                s.wait()
            self.done = True


@dataclass(frozen=True)
class After:
    """Tasks that begin when others have ended, with all that they wrote computed: for what no lineage orders, such as
    a table that one task writes and another reads."""

    tokens: tuple[Token, ...]

    def defer(self, task: Callable[..., Any], *args: Any) -> Any:
        for t in self.tokens:
            t.wait()
        return defer(task, *args)


@dataclass(frozen=True)
class Future:
    """One value that is still to be computed: a DataFrame of one row and one column."""

    df: DataFrame

    def view(self) -> View:
        return View(self.df)

    def get(self) -> Any:
        """Compute it and wait for it; a table that isn't one value is an error."""
        rows = self.df.take(2)
        if len(rows) != 1 or len(rows[0]) != 1:
            raise ValueError("not one row of one column")
        return rows[0][0]


def after(*tokens: Token) -> After:
    return After(tokens)


def _asks_for(task: Callable[..., Any]) -> list[Any]:
    """What a task's parameters are annotated with; the last counts for all further arguments."""
    try:
        return [p.annotation for p in inspect.signature(task, eval_str=True).parameters.values()]
    except (NameError, TypeError, ValueError):
        return []


def defer(task: Callable[..., Any], *args: Any) -> Any:
    """Call a task on deferred values: stores and views become the DataFrames they hold, tuples stay tuples.  Nothing
    is computed; a task may defer further tasks, whose results are its own.

    A parameter annotated ``Store`` gets a store to write (a child of the argument), one annotated ``View`` a view,
    and for :class:`Writers` a list of stores to write.  What the task wrote is handed over when it returns; when
    it fails, nothing is.  A task that returns nothing gives a :class:`Token`.
    """
    wanted = _asks_for(task)
    children: list[Store] = []
    durable: list[Store] = []

    def resolve(x: Any, want: Any = None) -> Any:
        if isinstance(x, Writers):
            mine = [s.child() for s in x]
            children.extend(mine)
            durable.extend(mine if x.durable else [])
            return mine
        if isinstance(x, Store) and want is Store:
            children.append(x.child())
            return children[-1]
        if isinstance(x, Store | View | Future):
            return x.view() if want is View else x.df
        return type(x)(resolve(y) for y in x) if isinstance(x, list | tuple) else x

    try:
        out = task(*[resolve(x, wanted[min(k, len(wanted) - 1)] if wanted else None) for k, x in enumerate(args)])
        for c in children:
            if c.writer is not None:
                raise RuntimeError("a task that the task began still writes")
        for c in durable:
            if c.version:
                c.checkpoint()
    except BaseException:
        for c in reversed(children):
            if c.parent is not None and c.parent.writer is c:
                c.drop()
        raise
    for c in children:
        c.close()
    return Token([c.parent for c in children if c.version and c.parent is not None]) if out is None else out


def across(df: DataFrame, devices: DeviceList, device: str = "device") -> DataFrame:
    """Rows of the devices in a list: others have no part in what follows."""
    return df.filter(devices.contains_column(F.col(device)))
