"""Committed batches and tombstones: what a reader of the table sees."""

import pytest

from tessellar.errors import LimitExceeded, NotReady
from tessellar.sources import otlp
from tessellar.sources.event_time import EventTimePolicy
from tessellar.streaming.ingest import Ingest

from .helpers import at, series, store
from .test_ingest import gauge, messages


def test_a_batch_is_read_when_it_is_whole(spark, tmp_path):
    taken = Ingest(spark, str(tmp_path / "table"), EventTimePolicy(drop_outdated=False), window_ms=5_000, ooo_window_ms=60_000)
    with pytest.raises(NotReady):
        taken.read()
    taken.take(messages(spark, [gauge("g", 1.0, 1_000)]), 0)
    note, taken._note = taken._note, lambda *_, **__: None  # a batch that stops before its commit
    taken.take(messages(spark, [gauge("g", 2.0, 2_000)]), 1)
    assert taken.read().count() == 1
    taken._note = note
    taken.take(messages(spark, [gauge("g", 2.0, 2_000)]), 1)
    assert taken.read().count() == 2


def test_tombstones_stay(spark, tmp_path):
    taken = Ingest(spark, str(tmp_path / "table"), EventTimePolicy(drop_outdated=False), window_ms=5_000, ooo_window_ms=60_000)
    taken.take(messages(spark, [gauge("g", float(k), 1_000 * k) for k in range(1, 13)]), 0)
    assert taken.retain(5_000).count() == 8 and taken.read().count() == 8  # the window that ends at 5 s goes
    assert taken.retain(4_000).count() == 8  # an older cutoff brings nothing back
    assert otlp.watermarks(messages(spark, [gauge("g", 1.0, 7), gauge("g", None, 0)])).first()["min_ms"] == 7


def test_limits(spark):
    held = store(spark, series("m{a=b}", [1, 2, 3, 4, 5]) + series("m{a=c}", [1, 2, 3, 4, 5]), unique=True)
    assert at(spark, held.limited(samples=10, series=2, values=2), 'sum(m{a=~"b|c"})') == {"": 10}
    for limits in ({"samples": 9}, {"series": 1}, {"values": 1}):
        with pytest.raises(LimitExceeded):
            at(spark, held.limited(**limits), 'sum(sum_over_time(m{a=~"b|c"}[1m]))')
