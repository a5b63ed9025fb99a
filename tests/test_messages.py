import json

import pytest
from pyspark.sql import Row

from chainlake.plans.streams import _fed
from chainlake.streaming import messages
from chainlake.streaming.messages import MessageWriter


def some(spark, numbers):
    return spark.createDataFrame([(f"events:{n % 3}", json.dumps({"n": n}), n) for n in numbers], messages.MESSAGE)


def test_each_message_is_delivered_once_over_restarts(spark, tmp_path):
    folder, check = f"file://{tmp_path}/out", f"file://{tmp_path}/check"
    _fed(spark, [some(spark, range(40)), some(spark, range(40, 60))], "messages-test", lambda s: messages.publish(s, folder, check))
    got = messages.delivered(spark, folder).collect()
    assert sorted(r.position for r in got) == list(range(60)) and len(got) == 60
    for name in (tmp_path / "out" / "_staged").iterdir():
        rows = [json.loads(x) for x in name.read_text().splitlines()]
        assert rows == sorted(rows, key=lambda r: (r["key"], r["position"]))


def test_failed_and_replayed_batches(spark, tmp_path):
    """Killed after staging, aborted, killed after publishing: what a replay stages again isn't delivered twice."""
    writer = MessageWriter(str(tmp_path))
    stage = lambda n: writer.write(iter([Row(key="k", value=str(n), position=n)]))
    stage(1)  # the task's batch is lost here
    writer.abort([stage(1), None], 0)
    writer.commit([stage(1), writer.write(iter([])), None], 0)
    writer.commit([stage(1)], 0)  # the batch is replayed, as its commit wasn't noted
    writer.commit([stage(2)], 1)
    assert sorted(r.position for r in messages.delivered(spark, str(tmp_path)).collect()) == [1, 2]
    assert messages.delivered(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(TypeError):
        writer.write(iter([Row(key=b"k", value="v", position=1)]))
