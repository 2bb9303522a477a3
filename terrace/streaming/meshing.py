"""Surfaces kept up with a field that changes: a micro-batch of changed blocks makes anew the patches it touches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from terrace.operators.tables import Versions
from terrace.operators.voxels import remeshed

PATCHES = "bx long, by long, bz long, cell string, k int, ids array<string>, points array<double>"


def mesher(field: Callable[[], DataFrame], versions: Versions, block: int, origin: tuple[float, float, float], size: float) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` over changed blocks ``(bx, by, bz)``: publishes the patches after them as version ``batch_id``.

    ``field`` gives the field as of now. Patches of other blocks stay as they are;
    a batch that comes again is not published twice.
    """

    def run(dirty: DataFrame, batch_id: int) -> None:
        latest = versions.latest()
        if batch_id <= latest:
            return
        before = versions.read(latest) if latest >= 0 else dirty.sparkSession.createDataFrame([], PATCHES)
        versions.publish(remeshed(field(), before, dirty, block, origin, size), latest)

    return run
