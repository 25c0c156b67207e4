"""A stream in order keeps many keys in few entries of the state store."""

import pytest

from shellac import streaming
from test_jobs import BASE, replayed, streamed


@pytest.mark.parametrize("name", ["limiter", "crawl"])
def test_entries_grow_with_buckets_not_with_keys(spark, tmp_path, name):
    guard = streaming.request_limiter(3) if name == "limiter" else streaming.crawl_guard(warn=4, block=6)
    rows = [{"event_id": i, "ip": f"k{i * 7 % 200}" if i % 9 else None, "ms": BASE + i * 50, "weight": 1 + i % 3, "free": i % 17 == 0, "success": False} for i in range(1200)]
    closing = [{"event_id": 5000 + i, "ip": "closing", "ms": BASE + (700 + 100 * i) * streaming.MINUTE, "weight": 1, "free": True, "success": False} for i in range(2)]
    got, query = streamed(spark, tmp_path, [rows[::2], rows[1::2], closing[:1], closing[1:]], guard, f"buckets_{name}", in_order=True, slice_ms=20_000, buckets=3)
    assert {k: v for k, v in got.items() if k[0] < 5000} == replayed(spark, rows, guard) and len(got) >= 1200
    most = max(o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"])
    assert 0 < most < 100
