"""The store of applied changes: what events said before a compaction still counts."""

import pytest

from pathlore.streaming import apply as ap
from tests.test_apply import batch, begun, state


@pytest.mark.parametrize(("share", "order"), [(0.01, (0, 1, 2, 3)), (100, (3, 0, 2, 1))])
def test_a_directory_that_goes_twice(spark, tmp_path, monkeypatch, share, order):
    """/v/d goes at 10 and again at 30; a file that came into it between goes with it, whether or not deltas went into a
    new base in between. /v/e goes at 10, and at 30 when it is a file: what was in it until 10 stays gone."""
    monkeypatch.setattr(ap, "SHARE", share)
    at = begun(spark, tmp_path, ["/v/d/", "/v/d/a.txt", "/v/e/", "/v/e/b.txt", "/v/f.txt"])
    batches = [
        [(10, "/v/d", None), (10, "/v/e", None)], [(20, "/v/d/new.txt", 7), (12, "/v/e/new.txt", 8)],
        [(20, "/v/e", 9), (30, "/v/d", None)], [(30, "/v/e", None), (40, "/v/d/last.txt", 6)],
    ]
    for number, i in enumerate(order):
        ap.apply_batch(batch(spark, *batches[i]), at, "s", number)
    assert state(spark, at) == {"/v/f.txt": 4, "/v/e/new.txt": 8, "/v/d/last.txt": 6}
