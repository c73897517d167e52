"""How often a key's state is asked for: each call is a round trip."""

import pandas as pd

from orrery.streaming.signals import RunSignals


class Store:
    def __init__(self):
        self.calls, self.value, self.timers = 0, None, set()

    def getValueState(self, name, schema):
        return self

    getListState = getValueState

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def clear(self):
        self.calls, self.value = self.calls + 1, None

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.discard(at)


class At:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms

    getExpiryTimeInMs = getCurrentWatermarkInMs


def test_three_calls_a_key_and_batch():
    store, runs = Store(), RunSignals(3, 10**9)
    runs.init(store)
    rows = pd.DataFrame({"at": [3000, 1000, 2000, 9000], "value": ["a", "a", "a", "b"]})
    assert list(runs.handleInputRows(("k",), iter([rows]), At(0))) == [] and store.calls == 3 and store.timers == {1}
    store.timers.clear()  # as Spark does with the one that expires
    (out,) = runs.handleExpiredTimer(("k",), At(5), At(1))
    assert out.values.tolist() == [["k", "a", 1000, 3000]] and store.calls == 6 and store.timers == {9}
    list(runs.handleInputRows(("k",), iter([pd.DataFrame({"at": [7000], "value": ["c"]})]), At(5)))
    assert store.timers == {7}  # an earlier observation takes the timer's place
    assert list(runs.handleExpiredTimer(("k",), At(3 * 10**6), At(7))) == [] and store.value is None
