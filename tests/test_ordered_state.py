"""How much is asked of the state for many rows of a key."""

import pickle
import random
from collections import Counter

from fleetseal.streaming import ordered


class State:
    """Value and map state of one key, and the timer, in memory; counts the calls."""

    def __init__(self):
        self.calls, self.values, self.maps = Counter(), {}, {}

    def getValueState(self, name, schema):
        return Value(self, name)

    def getMapState(self, name, key, value):
        return Map(self, name)

    def registerTimer(self, at):
        self.timer = at

    def deleteTimer(self, at):
        self.timer = None


class Value:
    def __init__(self, state, name):
        self.state, self.name = state, name

    def exists(self):
        self.state.calls[self.name] += 1
        return self.name in self.state.values

    def get(self):
        self.state.calls[self.name] += 1
        return self.state.values[self.name]

    def update(self, value):
        self.state.calls[self.name] += 1
        self.state.values[self.name] = value

    def clear(self):
        self.state.calls[self.name] += 1
        self.state.values.pop(self.name, None)


class Map(Value):
    def _map(self):
        self.state.calls[self.name] += 1
        return self.state.maps.setdefault(self.name, {})

    def keys(self):
        return list(self._map())

    def containsKey(self, key):
        return key in self._map()

    def getValue(self, key):
        return self._map()[key]

    def updateValue(self, key, value):
        self._map()[key] = value

    def removeKey(self, key):
        del self._map()[key]

    def clear(self):
        self._map().clear()


class Frame:
    def __init__(self, *columns):
        self.columns = list(columns)


class Mark:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return self.at


def opened(processor):
    state = State()
    processor.init(state)
    return processor, state


def taken(found):
    return [row for packed in found for row in pickle.loads(packed["rows"])]


def given(processor, rows, mark=0):
    packed = [{"rows": pickle.dumps(rows[i:i + 700])} for i in range(0, len(rows), 700)]
    return taken(processor.handleInputRows(("h",), iter(packed), Mark(mark)))


def test_windows_ask_the_state_by_runs_not_by_rows(monkeypatch):
    monkeypatch.setattr(ordered, "_ORDERED", 4000)
    monkeypatch.setattr(ordered, "_SHORT", 50)
    windows, state = opened(ordered._Windows(Frame("seq", "due", "__key"), ["seq"], 75))
    rows = [(i, 1000 + i * 7, "h") for i in range(20_000)]
    shuffled = random.Random(1).sample(rows, len(rows))
    assert given(windows, shuffled) == []
    middle = 1000 + 10_000 * 7
    found = taken(windows.handleExpiredTimer(("h",), Mark(middle), None))
    found += taken(windows.handleExpiredTimer(("h",), Mark(10**9), None))
    # A window takes eleven rows: 70 ms after its first row there is one more, 77 ms after it the next opens.
    assert found == [(i, 1000 + i // 11 * 77, False) for i in range(20_000)]
    assert not state.maps["runs"] and not state.values and sum(state.calls.values()) < 1000


def test_bindings_are_kept_by_parts_of_the_names():
    bound, state = opened(ordered._Bound(Frame("host", "bucket", "due", "rank", "seq", "op", "name", "value")))
    row = lambda i, op, name, value=None: ("h", 0, 1000 + i, 0, i, op, name, value)
    rows = [row(i, ("bind", "use", "unbind", "use")[i % 4], f"n{i // 4 % 10}", f"v{i}") for i in range(8000)]
    given(bound, [*rows, row(8000, "bind", "kept", "k"), row(8001, "mark", None)])
    found = taken(bound.handleExpiredTimer(("h",), Mark(10**6), None))
    assert [(r[1], r[3]) for r in found] == [(i, f"v{i - 1}" if i % 4 == 1 else None) for i in range(1, 8000, 2)]
    assert sum(state.calls.values()) < 300
    use = lambda i: (row(10**6 + i, "use", "kept"))
    given(bound, [use(1), row(10**6 + 2, "clear", None), use(3)], 10**6)
    found = taken(bound.handleExpiredTimer(("h",), Mark(2 * 10**6), None))
    assert [(r[3], r[4], r[6]) for r in found] == [("k", True, True), (None, False, True)] and not state.maps["bound"]
