"""Tests of what the reviewer of round 3 found, about keyed state."""

from __future__ import annotations

import json

from quarrystone.streaming import paths, state

HOUR = 3_600_000
SCHEMA = "entry long, severity int, recorded long, attempts long, resolved_at long"


def test_neighbouring_entries_share_a_state(spark, tmp_path):
    def batch(k: int, rows: list[tuple]) -> int:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{k}.json").write_text("".join(json.dumps(dict(zip(names, r))) + "\n" for r in rows))
        stream = paths.ledger_stream(spark, f"file://{tmp_path}/in", SCHEMA)
        query = state.append_updates(state.repair_states(stream), f"file://{tmp_path}/updates", f"file://{tmp_path}/state")
        query.awaitTermination()
        return query.lastProgress.stateOperators[0].numRowsTotal

    many = [(k, 1, HOUR, 0, None) for k in range(1000, 1500)]
    odd = [(-1, None, HOUR, None, None), (-300, 2, HOUR, 5, None), (2**53 + 1, 1, HOUR, 1, 2**60 + 1), (None, 1, HOUR, 1, None), (3, 1, None, 1, None), (5, 1, HOUR, 5, None), (5, 3, HOUR - 1, 1, None)]
    held = batch(0, many + odd)
    assert held <= 8  # before: one state for each of 505 entries
    batch(1, [(1001, 4, 2 * HOUR + 1, 2, None), (7, 1, 2 * HOUR + 1, 0, 2 * HOUR)])  # moves the clock past the timers of all others
    batch(2, [(-300, 1, 2 * HOUR + 2, 0, None)])  # was given up and is seen anew
    found = {r.entry: tuple(r)[1:] for r in state.present(spark, f"file://{tmp_path}/updates").collect()}
    assert len(found) == 505 and set(found) == {*range(1000, 1500), -1, -300, 2**53 + 1, 5, 7}
    assert found[1000] == (1, 1, HOUR, 2 * HOUR + 1, "due", 2)
    assert found[1001] == (4, 2, HOUR, 2 * HOUR + 1, "open", 2)
    assert found[-1] == (None, 1, HOUR, 2 * HOUR + 1, "due", 2)
    assert found[-300] == (1, 0, 2 * HOUR + 2, 2 * HOUR + 2, "open", 1)
    assert found[2**53 + 1] == (1, 1, HOUR, HOUR, "resolved", 1)
    assert found[5] == (3, 5, HOUR - 1, HOUR, "given_up", 2)
    assert found[7] == (1, 0, 2 * HOUR + 1, 2 * HOUR + 1, "open", 1)
