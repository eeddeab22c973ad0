"""Workers outlive tasks: what they hold for later ones goes when they wait."""

import time

import numpy as np
import psutil

from intelweave.llm import common


def _blocks(n):
    for _ in range(n):
        yield [bytes(100) for _ in range(200_000)]


def _held_while(batches):
    for b in batches:
        common.alone("states", lambda: np.ones(8 << 20))
        yield len(b)


def test_a_waiting_worker_lets_go(monkeypatch):
    monkeypatch.setattr(common, "IDLE_S", 0.2)
    size = lambda: psutil.Process().memory_info().rss >> 20
    before = size()
    task = common.rested(_held_while)(_blocks(2))
    assert next(task) == 200_000
    time.sleep(0.5)
    assert "states" in common._held and size() - before >= 64  # not while the task runs
    assert list(task) == [200_000]
    again = common.rested(_held_while)(_blocks(1))
    assert next(again) == 200_000 and "states" in common._held  # the next task finds it
    again.close()
    time.sleep(0.8)
    assert not common._held and size() - before < 32


def test_tasks_of_one_worker_may_nest(monkeypatch):
    monkeypatch.setattr(common, "IDLE_S", 0.1)
    outer, inner = common.rested(_held_while)(_blocks(2)), common.rested(_held_while)(_blocks(1))
    assert next(outer) == 200_000 and list(inner) == [200_000]
    time.sleep(0.4)
    assert "states" in common._held
    outer.close()
    time.sleep(0.4)
    assert not common._held
