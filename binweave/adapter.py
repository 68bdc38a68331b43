"""The interface that older linked-filter libraries have, over a Session: dense groups with bins as keys."""

from __future__ import annotations

from binweave.operators.histograms import dense
from binweave.session import DimensionHandle, Session


class ClassicGroup:
    def __init__(self, handle: DimensionHandle):
        self._handle = handle

    def all(self):
        """(key, value) of every bin, those without rows included."""
        group = self._handle.group()
        return dense(group._hist(), self._handle.dim).selectExpr("bin AS key", "count AS value")


class ClassicDimension:
    def __init__(self, handle: DimensionHandle):
        self._handle = handle

    def filter(self, bounds: tuple[float, float]) -> ClassicDimension:
        self._handle.filter(bounds)
        return self

    def filter_all(self) -> ClassicDimension:
        self._handle.clear()
        return self

    def group(self) -> ClassicGroup:
        return ClassicGroup(self._handle)


class Classic:
    """dimension, when_idle and dispose of a session."""

    def __init__(self, session: Session):
        self._session = session

    def dimension(self, name: str) -> ClassicDimension:
        return ClassicDimension(self._session.dimension(name))

    def when_idle(self) -> None:
        self._session.when_idle()

    def dispose(self) -> None:
        self._session.dispose()
