"""A batch of a player costs one read and one write of state, and a timer is set once until it fires."""

from types import SimpleNamespace

from pyspark.sql import Row

from skillspark.streaming.attempts import _Served


class Handle:
    def __init__(self):
        self.value, self.calls = None, []

    def getValueState(self, *_):
        return self

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def clear(self):
        self.calls.append("clear")
        self.value = None

    def registerTimer(self, at):
        self.calls.append(("register", at))

    def deleteTimer(self, at):
        self.calls.append(("delete", at))


def test_calls_of_a_batch():
    handle, s = Handle(), 1_000_000
    served = _Served(3, 100 * s)
    served.init(handle)
    row = lambda at, is_result, id_, puzzle: Row(at=at * s, is_result=is_result, id=id_, puzzle_id=puzzle)
    out = list(served.handleInputRows((7,), iter([row(12, 1, 3, "a"), row(10, 0, 1, "a"), row(11, 0, 2, "b")]), None))
    assert [tuple(r) for r in out] == [(3, 7, "a", 1)]
    assert handle.calls == ["get", ("register", 111_001), "update"]
    handle.calls.clear()
    assert [r.serve_id for r in served.handleInputRows((7,), iter([row(30, 0, 4, "c"), row(40, 1, 5, "b"), row(41, 1, 6, "b")]), None)] == [2, None]
    assert handle.calls == ["get", "update"]
    handle.calls.clear()
    now = SimpleNamespace(getCurrentWatermarkInMs=lambda: 112_000)
    assert list(served.handleExpiredTimer((7,), now, None)) == []
    assert handle.calls == ["get", ("register", 130_001), "update"]  # the timer was too early for the serving that is open
    handle.calls.clear()
    now = SimpleNamespace(getCurrentWatermarkInMs=lambda: 131_000)
    assert list(served.handleExpiredTimer((7,), now, None)) == [] and handle.calls == ["get", "clear"]
