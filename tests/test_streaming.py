from __future__ import annotations

import json

from lexigrove.streaming import audits


def test_audit_files_add_up(spark, tmp_path):
    (tmp_path / "a").mkdir()
    put = lambda name, rows: (tmp_path / "a" / f"{name}.json").write_text(json.dumps({"cluster_definitions_version": 1, "assignments": rows}))
    put("one", [{"text_id": "1", "cluster_id": "c1", "confidence": 4}, {"text_id": "2", "cluster_id": "", "confidence": None}])
    q = audits.watch(spark, str(tmp_path / "a"), str(tmp_path / "check"), "watched")
    try:
        q.processAllAvailable()
        put("two", [{"text_id": "3", "cluster_id": "c1", "confidence": 2}])
        q.processAllAvailable()
        got = {r.cluster_id: (r.n, r.mean_confidence) for r in spark.table("watched").collect()}
    finally:
        q.stop()
    assert got == {"c1": (2, 3.0), "": (1, None)}
