import json

import numpy as np

from quarrylab import cli
from quarrylab.plans.health import batch_health_check
from quarrylab.plans.store import Store
from quarrylab.streaming.append import append_stream


def test_stream_into_a_table(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "event_type", "value")
    events.write.parquet(str(tmp_path / "in"))
    with Store(spark, tmp_path / "store") as store:
        store.create_table("events", {"event_id": "INTEGER PRIMARY KEY", "event_type": "TEXT", "value": "REAL"})
        for _ in range(2):  # started again, it takes in nothing twice
            stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
            query = append_stream(stream, store, "events", str(tmp_path / "checkpoint"), availableNow=True)
            assert query.awaitTermination(120)
        assert store.get_row_count("events") == events.count()


def test_health_and_command_line(spark, tmp_path, capsys):
    with Store(spark, tmp_path / "store") as store:
        store.create_table("cells", {"id": "INTEGER PRIMARY KEY", "data": "BLOB"})
        store.save_array("cells", np.arange(4.0), "data")
        store.create_table("none", {"id": "INTEGER PRIMARY KEY"})
        assert store.is_loadable()
        store.update_where("cells", {"data_hash": "0"}, "id = 1")
        assert not store.is_loadable("cells")
        store.truncate_table("cells")
        assert store.get_row_count("cells") == 0
    found = batch_health_check(spark, [tmp_path / "store", tmp_path / "gone"])
    assert found["summary"] == {"HEALTHY": 0, "ISSUES_FOUND": 1, "CRITICAL": 1}
    assert cli.main(["inspect", str(tmp_path / "store"), "--json"]) == 0
    assert [t["table_name"] for t in json.loads(capsys.readouterr().out)] == ["cells", "none"]
    assert cli.main(["check-health", str(tmp_path / "store")]) == 1
    assert cli.main(["check-health", str(tmp_path / "store"), "--fix"]) == 2
    capsys.readouterr()
    before = sorted((tmp_path / "store").rglob("*"))
    assert cli.main(["check-health", str(tmp_path / "store"), "--fix", "--dry-run"]) == 1 and "would mend" in capsys.readouterr().out
    assert sorted((tmp_path / "store").rglob("*")) == before
    cli.main(["check-health", str(tmp_path / "store"), "-q"])
    assert "advice" not in capsys.readouterr().out
