"""How often the processors ask their state: a fixed number of times per key and batch."""

import pandas as pd

from shoplens.streaming.neighbours import ReviewProcessor
from shoplens.streaming.state import ProfileProcessor


class State:
    def __init__(self, calls):
        self.calls, self.value = calls, None

    def __getattr__(self, name):
        def call(*args):
            self.calls.append(name)
            if name in ("update", "updateValue"):
                self.value = args[0]
            return self.value
        return call


class Handle:
    def __init__(self):
        self.calls = []

    def getValueState(self, *args):
        return State(self.calls)

    def getMapState(self, *args):
        return State(self.calls)


def test_review_processor_reads_and_writes_once():
    handle, p = Handle(), ReviewProcessor(10)
    p.init(handle)
    rows = pd.DataFrame({"product_id": [f"p{i}" for i in range(25)], "event_id": [f"e{i:02d}" for i in range(25)][::-1],
                         "timestamp": pd.to_datetime(["2024-01-01"] * 24 + [None])})
    out = pd.concat(p.handleInputRows(("u",), iter([rows]), None))
    assert list(out["review_number"].dropna()) == [10, 20]
    # by time, then id; the row without a time is the last
    assert list(out["event_id"]) == ["e10", "e20"]
    assert handle.calls == ["get", "update"]
    assert list(pd.concat(p.handleInputRows(("u",), iter([rows[:5]]), None))["review_number"]) == [30]


def test_profile_of_interactions_reads_and_writes_once():
    handle, p = Handle(), ProfileProcessor("user_id", "products_count")
    p.init(handle)
    rows = pd.DataFrame({"kind": ["interaction"] * 7, "partner": list("abcdefg"), "rating_num": [None] * 7,
                         "event_id": list("abcdefg"), "timestamp": pd.to_datetime(["2024-01-01"] * 7)})
    (out,) = p.handleInputRows(("u",), iter([rows]), None)
    assert out["interactions"][0] == 7 and out["reviews"][0] == 0
    assert handle.calls == ["get", "update"]
