import pytest
from pyspark.sql import functions as F

from chainlake.operators.snapshots import Snapshots


def rows(spark, blocks, note="a", chain_id=1):
    return spark.createDataFrame([(chain_id, b, f"0x{b % 3}", note) for b in blocks], "chain_id int, block_number long, address string, note string")


def seen(state):
    """(table, block, note) of all tables, through the newest state."""
    return sorted((t, r.block_number, r.note) for t in ("raw", "decoded") for r in state.read(t).collect())


def made(spark, path):
    state = Snapshots(spark, f"file://{path}")
    for blocks in ([5, 99_999], [100_000, 100_001, 250_000]):
        state.append({"raw": rows(spark, blocks), "decoded": rows(spark, blocks, "d")})
    return state


def repaired(spark, state):
    new = {"raw": rows(spark, [100_001, 100_002, 7], "new"), "decoded": rows(spark, [100_001], "dnew")}
    return state.rewrite_reorg(1, 100_000, 100_050, new)


AFTER = sorted([(t, b, n) for t, n in (("raw", "a"), ("decoded", "d")) for b in (5, 99_999, 100_000, 250_000)] + [("raw", 100_001, "new"), ("raw", 100_002, "new"), ("decoded", 100_001, "dnew")])


def test_repair_delete_compact_restore_and_vacuum(spark, tmp_path):
    state = made(spark, tmp_path)
    before = seen(state)
    assert repaired(spark, state) == 3 and seen(state) == AFTER
    assert [tuple(r) for r in state.read("reorgs").select("block_number", "tip", "depth", "below_finality").collect()] == [(100_000, 100_050, 50, False)]
    assert state.restore(2) == 4 and seen(state) == before
    assert state.restore(3) == 5 and seen(state) == AFTER
    state.delete_range(1, 0, 99_999)
    assert seen(state) == [x for x in AFTER if x[1] > 99_999]
    state.append({"raw": rows(spark, [120_000])})
    state.compact(200_000)
    assert seen(state) == sorted([x for x in AFTER if x[1] > 99_999] + [("raw", 120_000, "a")])
    assert len([p for p in state.state()["raw"]["parts"] if p[1] == 1]) == 1
    assert state.vacuum(keep=1) > 3 and len(state.versions()) == 1 and ("raw", 120_000, "a") in seen(state)
    assert state.read("raw", {(1, 2)}).count() == 1 and state.read("raw", {(9, 9)}).count() == 0


@pytest.mark.parametrize("step", range(5))
def test_a_failure_at_any_step_leaves_the_old_state_or_the_new(spark, tmp_path, monkeypatch, step):
    """Writes of tables and the publication fail in turn, before and after they are done; another attempt then succeeds."""
    state = made(spark, tmp_path)
    before, calls = seen(state), []

    def failing(f, late):
        def run(*args):
            calls.append(f.__name__)
            out = f(*args) if late or len(calls) != step + 1 else None
            if len(calls) == step + 1:
                raise OSError("lost")
            return out

        return run

    with monkeypatch.context() as m:
        m.setattr(state, "_written", failing(state._written, step % 2))
        m.setattr(state, "_publish", failing(state._publish, step == 4))
        if step < 4:
            with pytest.raises(OSError):
                repaired(spark, state)
        else:
            repaired(spark, state)  # three tables and a publication: there is no fifth step
    assert seen(state) == (AFTER if step == 4 else before)
    if step < 4:
        repaired(spark, state)
    assert seen(state) == AFTER


def test_a_reader_keeps_its_state_and_writers_cant_overwrite(spark, tmp_path):
    state = made(spark, tmp_path)
    held = state.read("raw")
    repaired(spark, state)
    assert held.where("note = 'new'").count() == 0 and held.count() == 5
    with pytest.raises(Exception, match="exist"):
        state._publish(state.state(), state.versions()[-1])
    scan = state.read("raw").where((F.col("chain_id") == 1) & (F.col("block_bucket") == 2))
    assert "block_bucket" in scan._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:200]
